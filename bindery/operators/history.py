"""Decisions over time, change history, stage logs and model-call usage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from bindery.operators.ranking import next_within


def supersede(decisions: DataFrame) -> DataFrame:
    """Adds superseded_by (the next decision of the submission) and is_current."""
    linked = next_within(decisions, ["submission_id"], ["created_at", "decision_id"], "decision_id", "superseded_by")
    return linked.withColumn("is_current", F.col("superseded_by").isNull())


def audit_changes(before: DataFrame, after: DataFrame, key: str, entity: str, actor: str | None = None) -> DataFrame:
    """One row per created, deleted or changed entity, with old and new values of what changed as JSON."""
    columns = [c for c in before.columns if c != key]
    b = before.select(F.col(key), F.struct(*columns).alias("_old"))
    a = after.select(F.col(key), F.struct(*columns).alias("_new"))
    j = b.join(a, key, "full")
    action = F.when(F.col("_old").isNull(), "CREATED").when(F.col("_new").isNull(), "DELETED").otherwise("UPDATED")
    differs = reduce(lambda x, y: x | y, [~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")) for c in columns])

    def changed(side: str):
        return F.to_json(F.struct(*[F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.col(f"{side}.{c}")).alias(c) for c in columns]))

    return j.filter(F.col("_old").isNull() | F.col("_new").isNull() | differs).select(
        F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), action.alias("action"),
        F.lit(actor).cast("string").alias("actor"),
        F.when(F.col("_old").isNotNull(), changed("_old")).alias("old_value"),
        F.when(F.col("_new").isNotNull(), changed("_new")).alias("new_value"))


def append_audit(changes: DataFrame, path: str) -> None:
    """The trail is append-only."""
    changes.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def audit_query(trail: DataFrame, *, entity_type: str | None = None, entity_id: str | None = None, actor: str | None = None,
                action: str | None = None, since=None, until=None) -> DataFrame:
    for column, value in (("entity_type", entity_type), ("entity_id", entity_id), ("actor", actor), ("action", action)):
        if value is not None:
            trail = trail.filter(F.col(column) == value)
    if since is not None:
        trail = trail.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        trail = trail.filter(F.col("created_at") < F.lit(until).cast("timestamp"))
    return trail


SKETCH = 400  # values that a quantile sketch keeps on its first level
LOG_SCHEMA = "stage string, status string, document_id string, submission_id string, duration_ms bigint"


def parse_stage_log(lines: DataFrame, line: str = "line") -> DataFrame:
    kept = [c for c in lines.columns if c != line]
    return lines.select(*kept, F.from_json(line, LOG_SCHEMA).alias("e")).select(*kept, "e.*")


def stage_metrics(log: DataFrame) -> DataFrame:
    """Runs, failures and durations by stage; ``p95_ms`` is the exact discrete 95th percentile.

    The percentile is read off the distinct durations of a stage, which are counted
    on the mapper and sorted; no list of durations is held.
    """
    ended = F.col("status").isin("SUCCESS", "FAILURE")
    failed = F.col("status") == "FAILURE"
    duration = F.when(ended, F.col("duration_ms"))
    metrics = log.groupBy("stage").agg(
        F.count_if(F.col("status") == "STARTED").alias("started"), F.count_if(F.col("status") == "SUCCESS").alias("succeeded"),
        F.count_if(failed).alias("failed"), F.try_divide(F.count_if(failed), F.count_if(ended)).alias("failure_rate"),
        F.avg(duration).alias("mean_ms"), F.min(duration).alias("min_ms"), F.max(duration).alias("max_ms"), F.count(duration).alias("_timed"))
    counts = log.filter(ended & F.col("duration_ms").isNotNull()).groupBy("stage", "duration_ms").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy("stage").orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counts.select(F.col("stage").alias("_stage"), "duration_ms", F.sum("_n").over(so_far).alias("_upto"))
    of_stage = F.col("stage").eqNullSafe(F.col("_stage"))
    p95 = reached.join(metrics.select("stage", "_timed"), of_stage).filter(F.col("_upto") * 100 >= F.col("_timed") * 95) \
        .groupBy("_stage").agg(F.min("duration_ms").alias("p95_ms"))
    return metrics.join(p95, of_stage, "left").drop("_stage", "_timed")


def stage_runs(log: DataFrame) -> DataFrame:
    """Starts paired with their ends per (stage, document): how many of each, and what is still open."""
    return log.groupBy("stage", "document_id").agg(
        F.count_if(F.col("status") == "STARTED").alias("started"), F.count_if(F.col("status") == "SUCCESS").alias("succeeded"),
        F.count_if(F.col("status") == "FAILURE").alias("failed"), F.max_by("status", F.struct("ts", "event_id")).alias("last_status")) \
        .withColumn("is_open", F.col("last_status") == "STARTED")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def match_runs(log: DataFrame) -> DataFrame:
    """A row for each run: stage, document_id, started_at, ended_at, outcome, duration_ms, start_id, end_id.

    Events of a (stage, document) are taken by (ts, event_id). A start belongs to
    the next end, unless another start comes first. ``outcome``: SUCCESS or
    FAILURE of the end; RESTARTED, a start that another one followed; OPEN, one
    that nothing followed; ORPHAN, an end without a start, which keeps the duration
    that it states. Other durations are the time between the two events. Events
    with another status are left out; null stages and documents are groups too.
    """
    keys = ["stage", "document_id"]
    events = log.filter(F.col("status").isin("STARTED", "SUCCESS", "FAILURE")).withColumns({
        "_event": F.struct("status", "ts", "event_id"), "_back": -_micros("ts"), "_back_id": -F.col("event_id")})
    events = next_within(events, keys, ["ts", "event_id"], "_event", "_next")
    events = next_within(events, keys, ["_back", "_back_id"], "status", "_before")
    start = F.col("status") == "STARTED"
    ends = F.col("_next.status").isin("SUCCESS", "FAILURE")
    runs = events.filter(start | F.coalesce(F.col("_before") != "STARTED", F.lit(True)))
    closed = start & F.coalesce(ends, F.lit(False))
    return runs.select(
        *keys, F.when(start, F.col("ts")).alias("started_at"), F.when(closed, F.col("_next.ts")).when(~start, F.col("ts")).alias("ended_at"),
        F.when(~start, "ORPHAN").when(closed, F.col("_next.status")).when(F.col("_next").isNull(), "OPEN").otherwise("RESTARTED").alias("outcome"),
        F.when(closed, F.floor((_micros("_next.ts") - _micros("ts")) / 1000)).when(~start, F.col("duration_ms")).cast("long").alias("duration_ms"),
        F.when(start, F.col("event_id")).alias("start_id"), F.when(closed, F.col("_next.event_id")).when(~start, F.col("event_id")).alias("end_id"))


def duration_sketches(runs: DataFrame, by: list[str]) -> DataFrame:
    """A quantile sketch of the durations of closed runs for each of ``by``: rows of bounded size that merge like counts."""
    closed = runs.filter(F.col("outcome").isin("SUCCESS", "FAILURE"))
    return closed.groupBy(*by).agg(F.kll_sketch_agg_bigint("duration_ms", SKETCH).alias("sketch"), F.count(F.lit(1)).alias("n_runs"))


def merged_quantiles(sketches: DataFrame, by: list[str], ranks: dict[str, float]) -> DataFrame:
    """Durations at the given ranks from merged sketches, off by about 1.33 % of the runs in rank at most (99 % sure; exact up to ``SKETCH`` runs)."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), F.sum("n_runs").alias("n_runs"))
    return merged.select(*by, "n_runs", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(n) for n, q in ranks.items()])


def model_usage(calls: DataFrame) -> DataFrame:
    """Tokens, latency and truncated share by model."""
    return calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        (F.sum("prompt_tokens") + F.sum("completion_tokens")).alias("total_tokens"), F.avg("latency_ms").alias("mean_latency_ms"),
        (F.count_if(F.col("finish_reason") == "length") / F.count(F.lit(1))).alias("truncated_share"))
