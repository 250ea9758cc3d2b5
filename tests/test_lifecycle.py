import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from bindery.operators import lifecycle as L
from bindery.streaming import pending
from bindery.sources import store

SCHEMA = "document_id long, event_no long, event string, page_count long, failure_reason string"


def brute(rows):
    """{(document, event_no): (before, after, legal)} and the last state of each document."""
    out, last = {}, {}
    for doc, no, event, pages, reason in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        state = last.setdefault(doc, dict(status="PENDING", page_count=None, is_scanned=None, failure_reason=None))
        legal, after, sets = L.TRANSITIONS.get(event, ((), None, {}))
        before, ok = state["status"], state["status"] in legal
        if ok:
            state["status"] = after
            for k, v in sets.items():
                state[k] = {"page_count": pages, "failure_reason": reason}[k] if v == "event" else v
        out[doc, no] = (before, state["status"], ok)
    return out, last


def histories(rng, docs, hot):
    rows = []
    for doc in [*range(docs), None]:
        n = hot if doc == 3 else rng.randint(1, 9)
        rows += [(doc, i, rng.choice([*L.TRANSITIONS, "renamed", None]), rng.randint(1, 9), f"r{i}") for i in range(n)]
    rng.shuffle(rows)
    return rows


def test_fold_like_one_event_after_the_other(spark):
    rows = histories(random.Random(2), 40, 3000)  # one document has most of all events and spans every range
    events = spark.createDataFrame(rows, SCHEMA)
    folded = L.fold(events, ["event_no"])
    want, last = brute(rows)
    assert {(r.document_id, r.event_no): (r.status_before, r.status_after, r.is_legal) for r in folded.collect()} == want
    states = {r.document_id: r for r in L.current(folded, ["event_no"]).collect()}
    assert set(states) == set(last)
    for doc, state in last.items():
        assert {k: states[doc][k] for k in state} == state
    assert L.illegal(folded).count() == sum(not ok for _, _, ok in want.values())


def test_no_events(spark):
    folded = L.fold(spark.createDataFrame([], SCHEMA), ["event_no"])
    assert folded.count() == 0 == L.current(folded, ["event_no"]).count()


def test_same_fold_in_a_stream(spark, tmp_path):
    rows = [r for r in histories(random.Random(4), 12, 40) if r[0] is not None]
    landed, ck, out = (str(tmp_path / n) for n in ("landed", "ck", "out"))
    for low, high in ((0, 3), (3, 20), (20, 99)):  # three runs, each with later events
        spark.createDataFrame([r for r in rows if low <= r[1] < high], SCHEMA).coalesce(1).write.mode("append").parquet(landed)
        stream = L.fold_stream(spark.readStream.schema(SCHEMA).parquet(landed), ["event_no"])
        pending.run_available(stream, out, ck)
    got = {(r.document_id, r.event_no): (r.status_before, r.status_after, r.is_legal) for r in spark.read.parquet(out).collect()}
    assert got == brute(rows)[0]


TEXTS = "document_id long, file_extension string, text string, landed_at timestamp"


def land(spark, path, *rows):
    spark.createDataFrame([(i, "pdf", t) for i, t in rows], "document_id long, file_extension string, text string").withColumn("landed_at", F.current_timestamp()) \
        .coalesce(1).write.mode("append").parquet(path)


def test_document_in_two_files_and_two_runs(spark, tmp_path):
    landed, out, ck = (str(tmp_path / n) for n in ("landed", "out", "ck"))

    def run():
        stream = pending.each_once(pending.stream_documents(spark, landed, spark.read.parquet(landed).schema, files_per_batch=1))
        pending.run_available(pending.process(stream, 4000), out, ck)
        return sorted(r.document_id for r in spark.read.parquet(out).collect())

    land(spark, landed, (1, "loss run"), (2, "other"), (3, None))
    land(spark, landed, (1, "loss run"), (4, ""), (4, ""))
    assert run() == [1, 2, 3, 4] == run()
    land(spark, landed, (2, "other"), (1, "another revision"))
    assert run() == [1, 1, 2, 3, 4]


def test_stopped_run_goes_on_without_loss_or_repeat(spark, tmp_path):
    landed, table, ck = (str(tmp_path / n) for n in ("landed", "table", "ck"))
    land(spark, landed, (1, "a"), (2, "b"))
    land(spark, landed, (2, "b"), (3, "c"))
    real, calls = store.replace, []

    def breaks(*args, **how):
        calls.append(1)
        if len(calls) == 2:
            real(*args, **how)  # the rows are in, the batch is not marked done
            raise RuntimeError("driver lost")
        real(*args, **how)

    def run():
        stream = pending.each_once(pending.stream_documents(spark, landed, spark.read.parquet(landed).schema, files_per_batch=1))
        pending.run_into(pending.process(stream, 4000), table, ck, buckets=4)
        return sorted(r.document_id for r in store.load(spark, table).collect())

    store.replace = breaks
    try:
        try:
            run()
        except Exception as exc:  # noqa: BLE001
            assert "driver lost" in str(exc)
        else:
            raise AssertionError("the run was to stop")
    finally:
        store.replace = real
    assert run() == [1, 2, 3] == run()


def test_repeats_within_a_time(spark, tmp_path):
    landed, out, ck = (str(tmp_path / n) for n in ("landed", "out", "ck"))
    land(spark, landed, (1, "a"), (1, "a"))
    stream = pending.each_once(pending.stream_documents(spark, landed, spark.read.parquet(landed).schema), within="1 hour", event_time="landed_at")
    pending.run_available(stream, out, ck)
    assert spark.read.parquet(out).count() == 1


def test_scan_by_doubling_and_edges_of_ranges():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 9, 400)
    lengths[[7, 90]] = 700, 1300
    doc = np.repeat(np.arange(len(lengths)), lengths)
    event = rng.integers(0, len(L._NEXT), len(doc))
    part = np.sort(rng.integers(0, 6, len(doc)))
    want = {}
    for p, d, e in zip(part.tolist(), doc.tolist(), event):
        want[p, d] = L.steps(want.get((p, d), np.arange(len(L.STATES))), e)[0]
    rows = pd.DataFrame({"part": part, "doc": doc, "event": event})
    for size in (1, 37, len(rows)):
        got = pd.concat(list(L._composed(iter([rows[i:i + size] for i in range(0, len(rows), size)]))))
        edges = {k for p in range(6) for docs in [doc[part == p]] for k in ((p, docs[0]), (p, docs[-1]))}
        assert {(p, d): a for p, d, a in zip(got["part"], got["doc"], got["after"])} == {k: want[k].tolist() for k in edges}
        assert len(got) == len(edges)
