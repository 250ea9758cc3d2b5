"""Processing status of documents, folded over their events.

A transition table says which event is legal in which state, where it leads and
what it sets. Applying it to one event after the other is a scan with an
associative step: a run of events is a function from the state before to the
state after, and functions compose. The batch form sorts all events by document
and time over range partitions; a partition hands on, for the documents that
reach beyond it, the composed function of its run, so a document may have any
number of events and still be folded by many tasks. The stream keeps the state of
each document and applies the same step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bindery.functions.text import limited
from bindery.session import shared_dir

STATES = ("PENDING", "PARSING", "OCR_PROCESSING", "COMPLETED", "FAILED")

#: event -> (states in which it is legal, state after it, what it sets). ``parsed`` leads on by what the parser found.
#: Sets: page_count and is_scanned from the event or as given, failure_reason from the event or to null.
TRANSITIONS = {
    "parse_started": (("PENDING", "COMPLETED", "FAILED", "OCR_PROCESSING"), "PARSING", {}),
    "parsed": (("PARSING",), "COMPLETED", {"page_count": "event", "is_scanned": False, "failure_reason": None}),
    "parsed_scanned": (("PARSING",), "OCR_PROCESSING", {"page_count": "event", "is_scanned": True, "failure_reason": None}),
    "parse_failed": (("PARSING",), "FAILED", {"failure_reason": "event"}),
    "ocr_skipped": (("OCR_PROCESSING", "COMPLETED"), "COMPLETED", {}),
    "ocr_done": (("OCR_PROCESSING",), "COMPLETED", {"page_count": "event", "is_scanned": True, "failure_reason": None}),
    "ocr_failed": (("OCR_PROCESSING",), "FAILED", {"failure_reason": "event"}),
}

#: The table as numbers: state after each (event, state), -1 where illegal.
_EVENTS = {e: i for i, e in enumerate(TRANSITIONS)}
_NEXT = np.array([[STATES.index(after) if s in legal else -1 for s in STATES] for legal, after, _ in TRANSITIONS.values()] + [[-1] * len(STATES)])
_START = STATES.index("PENDING")
_STEP = np.where(_NEXT < 0, np.arange(len(STATES)), _NEXT)


def steps(states: np.ndarray, events: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states after, legal) of one event for each of several start states or documents; unknown events are illegal."""
    after = _NEXT[events, states]
    return np.where(after < 0, states, after), after >= 0


def _codes(events: pd.Series) -> np.ndarray:
    return np.array([_EVENTS.get(e, len(_EVENTS)) for e in events], np.int64)


def _code(event: Column) -> Column:
    """Number of the event, one past the last for an unknown or null one."""
    out = F.lit(len(_EVENTS))
    for name, i in _EVENTS.items():
        out = F.when(event == name, i).otherwise(out)
    return out


def _scanned(part: np.ndarray, doc: np.ndarray, events: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each run of a document in a range, for each row the state after its run so far for each state before the run).

    A scan by doubling: as many passes as the longest run has binary digits.
    """
    n = len(doc)
    new = np.ones(n, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
    firsts = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(firsts, np.diff(np.append(firsts, n)))
    after, back = _STEP[events], 1
    while back <= place.max():
        at = np.flatnonzero(place >= back)
        after[at] = np.take_along_axis(after[at], after[at - back], 1)
        back *= 2
    return firsts, after


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the first and the last document of each range, the state after its run for each state before it.

    Only these can reach beyond their range. Rows come sorted by range and place.
    """
    part, doc, after = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(STATES)), np.int64)  # the run that may go on
    before = -1  # the range of the run before that one
    for batch in batches:
        if not len(batch):
            continue
        p, d = batch["part"].to_numpy(), batch["doc"].to_numpy()
        firsts, scan = _scanned(p, d, batch["event"].to_numpy())
        ends = scan[np.append(firsts[1:], len(d)) - 1]
        p, d = p[firsts], d[firsts]
        if len(doc) and doc[0] == d[0] and part[0] == p[0]:
            ends[0] = ends[0][after[0]]
        elif len(doc):
            p, d, ends = np.append(part, p), np.append(doc, d), np.vstack([after, ends])
        edge = (np.append(before, p[:-2]) != p[:-1]) | (p[1:] != p[:-1]) if len(p) > 1 else np.empty(0, bool)
        if edge.any():
            yield pd.DataFrame({"part": p[:-1][edge], "doc": d[:-1][edge], "after": ends[:-1][edge].tolist()})
        before = p[-2] if len(p) > 1 else before
        part, doc, after = p[-1:], d[-1:], ends[-1:]
    if len(doc):
        yield pd.DataFrame({"part": part, "doc": doc, "after": after.tolist()})


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every event with the states before and after; ``_start`` is the state before a document's first event in its range."""
    held, state = None, _START
    names = pa.array(STATES)
    for batch in batches:
        if not batch.num_rows:
            continue
        part, doc, events, start = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_part", "_doc", "_code", "_start")]
        firsts, scan = _scanned(part, doc, events)
        begun = start[firsts].astype(np.int64)
        if held == (part[0], doc[0]):
            begun[0] = state
        n = len(doc)
        after = scan[np.arange(n), np.repeat(begun, np.diff(np.append(firsts, n)))]
        before = np.append(0, after[:-1])
        before[firsts] = begun
        held, state = (part[-1], doc[-1]), after[-1]
        kept = [i for i, c in enumerate(batch.schema.names) if c not in _HELPERS]
        columns = [batch.column(i) for i in kept] + [names.take(pa.array(before)), names.take(pa.array(after)), pa.array(_NEXT[events, before] >= 0)]
        yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[i] for i in kept] + ["status_before", "status_after", "is_legal"])


_HELPERS = ("_part", "_seq", "_doc", "_code", "_start")


def fold(events: DataFrame, order: list[str]) -> DataFrame:
    """``events`` (document_id, event, ...) with ``status_before``, ``status_after`` and ``is_legal``.

    Events of a document are taken in ``order``, which should name every event
    differently; equal ones come in any order. A document starts PENDING. Illegal
    and unknown events change nothing and are marked. Rows with a null document are
    one document. The events are written once, sorted, to the shared folder.
    """
    spark, path = events.sparkSession, shared_dir(events.sparkSession, "events")
    keys = ["document_id", *order]
    placed = events.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_seq", F.monotonically_increasing_id())
    placed.write.parquet(path)
    # part: the range a row lies in
    stored = spark.read.schema(placed.schema).parquet(path).withColumns({
        "_part": F.shiftright("_seq", 33), "_doc": F.xxhash64(F.col("document_id").isNull(), "document_id"), "_code": _code(F.col("event"))})
    slim = stored.select(F.col("_part").alias("part"), "_seq", F.col("_doc").alias("doc"), F.col("_code").alias("event"))
    dealt = slim.repartition("part").sortWithinPartitions("part", "_seq").drop("_seq")
    edges = dealt.mapInPandas(_composed, "part long, doc long, after array<long>")
    # only documents that span ranges need a start other than PENDING: at most two for each range
    spans = Window.partitionBy("doc")
    several = edges.withColumn("_n", F.count(F.lit(1)).over(spans)).filter("_n > 1")
    told = several.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("part", "after"))).alias("runs"))  # a run for each range
    starts = told.select("doc", F.posexplode("runs").alias("i", "run"), "runs").select(F.col("doc").alias("_doc"), F.col("run.part").alias("_part"), F.aggregate(
        F.slice("runs", F.lit(1), F.col("i")), F.lit(_START).cast("long"), lambda s, r: F.get(r.after, s.cast("int"))).alias("_start"))
    # at most two rows for each range
    begun = stored.join(F.broadcast(starts), ["_doc", "_part"], "left").withColumn("_start", F.coalesce("_start", F.lit(_START))) \
        .select(*events.columns, *_HELPERS).repartition("_part").sortWithinPartitions("_part", "_seq")
    told_apart = [T.StructField("status_before", T.StringType()), T.StructField("status_after", T.StringType()), T.StructField("is_legal", T.BooleanType())]
    return begun.mapInArrow(_applied, T.StructType([*events.schema.fields, *told_apart]))


def _setting(column: str):
    """(legal event sets ``column``, the value it sets)."""
    sets = {e: how[column] for e, (_, _, how) in TRANSITIONS.items() if column in how}
    value = F.lit(None)
    for e, how in sets.items():
        value = F.when(F.col("event") == e, F.col(column) if how == "event" else F.lit(how)).otherwise(value)
    return F.col("is_legal") & F.col("event").isin(*sets), value


def current(folded: DataFrame, order: list[str], reason_chars: int | None = None) -> DataFrame:
    """A row for each document: status, page_count, is_scanned, failure_reason, n_events, n_illegal.

    A column is what the last legal event that sets it says; null before one does.
    """
    at = F.struct(*order)
    out = []
    for column, kind in (("page_count", "long"), ("is_scanned", "boolean"), ("failure_reason", "string")):
        sets, value = _setting(column)
        out.append(F.max_by(F.struct(value.cast(kind).alias("v")), F.when(sets, at)).alias(column))
    found = folded.groupBy("document_id").agg(F.max_by("status_after", at).alias("status"), *out, F.count(F.lit(1)).alias("n_events"),
                                              F.count_if(~F.col("is_legal")).alias("n_illegal"))
    return found.select("document_id", "status", "page_count.v", "is_scanned.v", "failure_reason.v", "n_events", "n_illegal") \
        .toDF("document_id", "status", "page_count", "is_scanned", "failure_reason", "n_events", "n_illegal") \
        .withColumn("failure_reason", limited("failure_reason", reason_chars))


def illegal(folded: DataFrame) -> DataFrame:
    """Events that met a state in which they are not legal, with that state."""
    return folded.filter("not is_legal")


def apply_status(documents: DataFrame, states: DataFrame) -> DataFrame:
    """``documents`` with what their events say: processing_status, page_count, is_scanned, failure_reason; others as they were."""
    known = states.select("document_id", F.struct("status", "page_count", "is_scanned", "failure_reason").alias("_state"))
    joined = documents.join(known, "document_id", "left")
    names = {"processing_status": "status", "page_count": "page_count", "is_scanned": "is_scanned", "failure_reason": "failure_reason"}
    kept = {c: F.col(c) if c in documents.columns else F.lit(None) for c in names}
    return joined.withColumns({c: F.when(F.col("_state").isNotNull(), F.col(f"_state.{n}")).otherwise(kept[c]) for c, n in names.items()}).drop("_state")


def fold_stream(events: DataFrame, order: list[str]) -> DataFrame:
    """The same fold over a stream: (document_id, event, order..., status_before, status_after, is_legal).

    Events of one trigger are taken in ``order``; one that comes in a later trigger
    is applied then, whatever its time. Documents without an id are left to the batch form.
    """
    kinds = {f.name: f.dataType for f in events.schema.fields}
    given = ["document_id", "event", *order]
    shape = T.StructType([T.StructField(c, kinds[c]) for c in given] + [
        T.StructField("status_before", T.StringType()), T.StructField("status_after", T.StringType()), T.StructField("is_legal", T.BooleanType())])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else _START
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")  # one document's events of one trigger
        before, after, legal = [], [], []
        for event in _codes(rows["event"]):
            to = _NEXT[event, at]
            before.append(STATES[at])
            legal.append(bool(to >= 0))
            at = int(to) if to >= 0 else at
            after.append(STATES[at])
        state.update((at,))
        yield rows[given].assign(status_before=before, status_after=after, is_legal=legal)

    return events.filter("document_id is not null").select(*given).groupBy("document_id").applyInPandasWithState(
        run, shape, T.StructType([T.StructField("state", T.IntegerType())]), "append", GroupStateTimeout.NoTimeout)
