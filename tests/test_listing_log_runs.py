import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bindery.operators import history as H, paging as P, version_log as VL


def test_every_page_like_a_sorted_list(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(20)])) for i in range(503)]
    items = spark.createDataFrame(rows, "id long, at int").repartition(7)
    order = [F.col("at").desc_nulls_last(), F.col("id")]
    want = [r.id for r in items.orderBy(*order).collect()]
    found = P.listing(items, order)
    assert found.total == 503
    for page, size in ((1, 50), (3, 50), (11, 50), (12, 50), (1, 503), (2, 400), (503, 1)):
        got = found.page(page, size).collect()
        assert [r.id for r in got] == want[(page - 1) * size:page * size]
        assert all((r.total, r.page, r.page_size, r.pages) == (503, page, size, -(-503 // size)) for r in got)
    with pytest.raises(ValueError):
        found.page(0)
    assert P.listing(items.limit(0), order).page().collect() == []


def test_a_deep_page_reads_its_ranges_only(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = P.listing(spark.range(20_000), [F.col("id")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found.ranges) > 8
    page = found.page(10_000, 1)
    assert [r.id for r in page.collect()] == [9999]
    files = {f for f in page.inputFiles()}
    scan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "_range" in scan and len(files) >= 1
    assert sum(n <= 9999 < n + k for _, n, k in found.ranges) == 1


def test_numbered_like_the_order(spark):
    rows = spark.range(1000).orderBy(F.xxhash64("id"))
    want = {r.id: i for i, r in enumerate(rows.collect(), 1)}
    assert {r.id: r.place for r in P.numbered(rows).collect()} == want


UPLOADS = "submission_id long, original_filename string, document_id long, uploaded_at timestamp, checksum_sha256 string, uploaded_by string, change_note string"


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def test_version_log_over_batches(spark):
    rng = random.Random(2)
    log, want, doc = None, defaultdict(list), 0
    for batch in range(4):
        rows = []
        for _ in range(60):
            doc += 1
            rows.append((rng.choice([1, 2, None]), rng.choice("abc"), doc, at(batch * 10 + rng.randint(0, 5)), rng.choice(["x", "y", None]), "u", None))
        fresh = VL.append(log, spark.createDataFrame(rows, UPLOADS))
        log = fresh if log is None else log.unionByName(fresh)
        log = spark.createDataFrame(log.collect(), log.schema)
        for r in sorted(rows, key=lambda r: (r[3], r[2])):
            if r[0] is not None:
                want[r[0], r[1]].append(r[2])
        # the batch once more changes nothing
        assert VL.append(log, spark.createDataFrame(rows, UPLOADS)).count() == 0
    got = defaultdict(dict)
    for r in log.collect():
        if r.submission_id is not None:
            got[r.submission_id, r.original_filename][r.version_number] = r.document_id
    assert {k: [v[i] for i in range(1, len(v) + 1)] for k, v in got.items()} == dict(want)
    then = {(r.submission_id, r.original_filename): r.document_id for r in VL.state(log, at(15)).filter("is_current_version and submission_id is not null").collect()}
    assert then == {k: [d for d in v if d <= 120][-1] for k, v in want.items()}
    now = {(r.submission_id, r.original_filename): (r.document_id, r.n_versions) for r in VL.current(log).filter("submission_id is not null").collect()}
    assert now == {k: (v[-1], len(v)) for k, v in want.items()}
    assert VL.current(log, at(-1)).count() == 0


EVENTS = "event_id long, stage string, status string, document_id string, ts timestamp, duration_ms long"


def test_runs_like_a_walk_over_the_events(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["P", "O", None]), rng.choice(["STARTED", "SUCCESS", "FAILURE", "OTHER"]), rng.choice(["d1", "d2", None]), at(rng.randint(0, 40)), 7) for i in range(400)]
    want, open_ = set(), {}
    for i, stage, status, doc, ts, ms in sorted(rows, key=lambda r: (r[4], r[0])):
        key, held = (stage, doc), open_.get((stage, doc))
        if status == "STARTED":
            if held:
                want.add((*key, held[1], None, "RESTARTED", None, held[0], None))
            open_[key] = i, ts
        elif status != "OTHER":
            if held:
                want.add((*key, held[1], ts, status, int((ts - held[1]).total_seconds() * 1000), held[0], i))
                open_.pop(key)
            else:
                want.add((*key, None, ts, "ORPHAN", ms, None, i))
    want |= {(*key, ts, None, "OPEN", None, i, None) for key, (i, ts) in open_.items()}
    got = [tuple(r) for r in H.match_runs(spark.createDataFrame(rows, EVENTS)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sketches_merge(spark):
    rng = random.Random(4)
    values = [(rng.choice("ab"), rng.randint(0, 9), int(rng.expovariate(0.001)), "SUCCESS") for _ in range(20_000)] + [("a", 1, None, "OPEN")]
    runs = spark.createDataFrame(values, "stage string, day int, duration_ms long, outcome string")
    found = H.merged_quantiles(H.duration_sketches(runs, ["stage", "day"]), ["stage"], {"p95": 0.95})
    for r in found.collect():
        mine = sorted(v for s, _, v, o in values if s == r.stage and o == "SUCCESS")
        rank = sum(v <= r.p95 for v in mine)
        assert r.n_runs == len(mine) and abs(rank - 0.95 * len(mine)) <= 0.0165 * len(mine) + 1
