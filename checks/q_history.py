"""Risk, history and the incremental form."""

from pyspark.sql import functions as F

from bindery import fixed
from bindery.operators import history as H, relational as R, risk as K, validate as V
from bindery.session import shared_dir
from bindery.sources.derived import SQL
from bindery.sources import store
from bindery.streaming import pending
from checks.q_classify import CHAIN
from checks.q_guardrails import redaction
from checks.q_ingest import CLEAN
from checks.q_relational import VERSIONED
from checks.q_validate import ASSEMBLED, UNWRAPPED, currency
from checks.registry import lits, query

SCORES = ("scores", """select s.submission_id, total_delta, coalesce(n_factors, 0) as n_factors, greatest(0, least(100, 50 + total_delta)) as final_score from v_submissions s
  left join (select submission_id, cast(sum(delta) as bigint) as total_delta, count(*) as n_factors from v_risk_factors group by submission_id) using (submission_id)""")
CATEGORY = "case when final_score is null then 'UNDETERMINED' when final_score <= 39 then 'LOW' when final_score <= 69 then 'MEDIUM' else 'HIGH' end"


@query("i01_risk_scores", "v_submissions v_risk_factors", [SCORES], "select submission_id, total_delta, n_factors, final_score from scores")
def _(t):
    return K.risk_scores(t.v_submissions, t.v_risk_factors).select("submission_id", "total_delta", "n_factors", "final_score")


@query("i01_score_breakdown", "v_submissions v_risk_factors", [SCORES], f"""
select s.submission_id, final_score, {CATEGORY} as category, ordinal, name, delta from scores s left join (
  select submission_id, name, delta, row_number() over (partition by submission_id order by name, delta) as ordinal from v_risk_factors) using (submission_id)""")
def _(t):
    broken = K.score_breakdown(K.risk_scores(t.v_submissions, t.v_risk_factors), t.v_risk_factors)
    b = F.from_json("score_breakdown", "final_score bigint, category string")
    return broken.withColumn("b", b).select("submission_id", "b.final_score", "b.category", "ordinal", "name", "delta")


@query("i02_risk_category", "v_submissions v_risk_factors", [SCORES], f"select {CATEGORY} as category, count(*) as n from scores group by 1")
def _(t):
    return K.risk_scores(t.v_submissions, t.v_risk_factors).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


TREND = ("trend", """select *, severity - lag(severity) over (partition by submission_id order by policy_year) as change from (
   select submission_id, year(date_of_loss) as policy_year, count(*) as n_claims, cast(sum(cast(paid as decimal(18,4)) + cast(reserve as decimal(18,4))) as double) / count(*) as severity from v_claims group by all)""")
FEATURES = ("features", f"""select s.submission_id, coalesce(n_claims / years, 0) as claims_per_year, coalesce(total_incurred, 0) as total_incurred, latest as latest_severity_change,
    coalesce(years - claim_years, 0) as loss_free_years, abs(a - f) / greatest(abs(a), abs(f), 1e-9) as revenue_discrepancy, coalesce(missing_count, 0) as missing_count, coalesce(conflict_count, 0) as conflict_count
  from v_submissions s
  left join (select submission_id, cast(sum(n_claims) as double) as n_claims, max(policy_year) - min(policy_year) + 1 as years, count(*) as claim_years, arg_max(struct_pack(c := change), policy_year).c as latest from trend group by submission_id) using (submission_id)
  left join (select submission_id, cast(sum(cast(paid as decimal(18,4)) + cast(reserve as decimal(18,4))) as double) as total_incurred from v_claims group by submission_id) using (submission_id)
  left join (select submission_id, max(case when document_type = 'ACORD_APPLICATION' and field_name = 'annual_revenue' then {currency('value')} end) as a,
      max(case when document_type = 'FINANCIAL_STATEMENT' and field_name = 'total_revenue' then {currency('value')} end) as f from assembled group by submission_id) using (submission_id)
  left join (select submission_id, count(*) filter (where issue_type = 'MISSING') as missing_count, count(*) filter (where issue_type = 'CONFLICT') as conflict_count from v_issues where not is_resolved group by submission_id) using (submission_id)""")
# the fixture states revenue only under annual_revenue; financial statements repeat it
RENAMED = (ASSEMBLED[0], ASSEMBLED[1].replace("field_ordinal, field_name,", "field_ordinal, case when d.document_type = 'FINANCIAL_STATEMENT' and field_name = 'annual_revenue' then 'total_revenue' else field_name end as field_name,"))


@query("i03_factor_features", "v_submissions v_claims v_fields v_issues", [VERSIONED, UNWRAPPED, RENAMED, TREND, FEATURES], """
select submission_id, round(claims_per_year, 6) as claims_per_year, total_incurred, round(latest_severity_change, 6) as latest_severity_change,
  loss_free_years, round(revenue_discrepancy, 6) as revenue_discrepancy, missing_count, conflict_count, missing_count = 0 as is_complete from features""")
def _(t):
    fields = V.assemble(t.v_fields, R.assign_versions(t.v_documents)).withColumn("field_name", F.when(
        (F.col("document_type") == "FINANCIAL_STATEMENT") & (F.col("field_name") == "annual_revenue"), "total_revenue").otherwise(F.col("field_name")))
    f = K.factor_features(t.v_submissions, t.v_claims, fields, t.v_issues)
    digits = {"claims_per_year": 6, "latest_severity_change": 6, "revenue_discrepancy": 6}
    return f.withColumns({c: F.round(c, d) for c, d in digits.items()}).withColumn("loss_free_years", F.col("loss_free_years").cast("long"))


@query("i03_coverage_lines", "v_documents v_fields", [VERSIONED, UNWRAPPED, ASSEMBLED], """
select submission_id, cast(case when s.jt = 'ARRAY' then len(cast(cast(s.v as json) as varchar[])) else 1 end as bigint) as n_lines from (
  select submission_id, arg_min(struct_pack(v := value, jt := jt), document_id * 100 + field_ordinal) as s from assembled
  where document_type = 'ACORD_APPLICATION' and field_name = 'lines_requested' group by submission_id)""")
def _(t):
    return K.coverage_lines(V.lines_requested(V.assemble(t.v_fields, R.assign_versions(t.v_documents))))


@query("i04_loss_metrics", "v_claims", sql="""
select submission_id, count(*) as total_claims, cast(sum(cast(paid as decimal(18,4))) as double) as total_paid, cast(sum(cast(paid as decimal(18,4)) + cast(reserve as decimal(18,4))) as double) as total_incurred, count(*) filter (where status = 'open') as open_claims_count,
  max(paid) as largest_claim_amount, cast(min(date_of_loss) as date) as period_start, cast(max(date_of_loss) as date) as period_end, round(cast(sum(cast(paid as decimal(18,4)) + cast(reserve as decimal(18,4))) as double) / max(o_totalprice) * 100, 4) as loss_ratio
from v_claims join orders on submission_id = o_orderkey group by submission_id""")
def _(t):
    premiums = t.orders.select(F.col("o_orderkey").alias("submission_id"), F.col("o_totalprice").alias("premium"))
    m = K.loss_metrics(t.v_claims, premiums)
    return m.withColumn("loss_ratio", F.round("loss_ratio", 4))


@query("i05_decision_values", "v_decisions", sql=f"""
select decision, decision in {lits(fixed.DECISIONS)} as accepted, count(*) as n from v_decisions group by all""")
def _(t):
    good, bad = K.human_decisions(t.v_decisions)
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.groupBy("decision", "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("i05_recommendation_values", "v_decisions", sql=f"""
select recommendation, recommendation in {lits(fixed.RECOMMENDATIONS)} as accepted, count(*) as n from (
  select case decision when 'REFERRED' then 'SENIOR_REVIEW' when 'ADDITIONAL_INFO' then 'ADDITIONAL_INFO_REQUIRED' else decision end as recommendation from v_decisions) group by all""")
def _(t):
    renamed = t.v_decisions.select(F.when(F.col("decision") == "REFERRED", "SENIOR_REVIEW").when(F.col("decision") == "ADDITIONAL_INFO", "ADDITIONAL_INFO_REQUIRED")
                                   .otherwise(F.col("decision")).alias("recommendation"))
    good, bad = K.recommendations(renamed)
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.groupBy("recommendation", "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("j01_supersede_decisions", "v_decisions", sql="""
select decision_id, submission_id, superseded_by, superseded_by is null as is_current from (
  select *, lead(decision_id) over (partition by submission_id order by created_at, decision_id) as superseded_by from v_decisions)""")
def _(t):
    return H.supersede(t.v_decisions).select("decision_id", "submission_id", "superseded_by", "is_current")


AFTER = "v_submissions v_patches"
CHANGES = ("changes", """select coalesce(b.submission_id, a.submission_id) as id, b.submission_id is null as created, a.submission_id is null as deleted,
    b.applicant_name as oa, a.applicant_name as na, b.broker_name as ob, a.broker_name as nb, b.status as os, a.status as ns
  from (select submission_id, applicant_name, broker_name, status from v_submissions where created_by <> 3) b full join (
     select s.submission_id, coalesce(p.applicant_name, s.applicant_name) as applicant_name, coalesce(p.broker_name, s.broker_name) as broker_name, s.status
     from v_submissions s left join v_patches p using (submission_id) where created_by <> 4) a on a.submission_id = b.submission_id""")


def changes(t):
    columns = ["submission_id", "applicant_name", "broker_name", "status"]
    s = t.v_submissions
    before = s.filter("created_by <> 3").select(*columns)
    after = R.patch(s.filter("created_by <> 4"), t.v_patches, "submission_id").select(*columns)
    return H.audit_changes(before, after, "submission_id", "submission")


@query("j02_audit_changes", AFTER, [CHANGES], """
select cast(id as varchar) as entity_id, case when created then 'CREATED' when deleted then 'DELETED' else 'UPDATED' end as action,
  case when not created and oa is distinct from na then oa end as old_applicant, case when not deleted and oa is distinct from na then na end as new_applicant,
  case when not deleted and ob is distinct from nb then nb end as new_broker
from changes where created or deleted or oa is distinct from na or ob is distinct from nb or os is distinct from ns""")
def _(t):
    get = F.get_json_object
    return changes(t).select("entity_id", "action", get("old_value", "$.applicant_name").alias("old_applicant"),
                             get("new_value", "$.applicant_name").alias("new_applicant"), get("new_value", "$.broker_name").alias("new_broker"))


@query("j02_trail_of_one", AFTER, [CHANGES], """
select action from (select *, case when created then 'CREATED' when deleted then 'DELETED' else 'UPDATED' end as action from changes
  where created or deleted or oa is distinct from na or ob is distinct from nb or os is distinct from ns)
where id = (select min(submission_id) from v_submissions where created_by = 3)""")
def _(t):
    path = shared_dir(t.spark, "audit")
    H.append_audit(changes(t).withColumn("actor", F.lit("batch")), path)
    one = t.v_submissions.filter("created_by = 3").agg(F.min("submission_id").cast("string")).first()[0]
    trail = t.spark.read.parquet(path)
    found = H.audit_query(trail, entity_id=one, actor="batch", since="2000-01-01", until="2200-01-01")
    return found.select("action")


@query("j02_audit_trail", AFTER, [CHANGES], """
select case when created then 'CREATED' when deleted then 'DELETED' else 'UPDATED' end as action, count(*) as n from changes
where created or deleted or oa is distinct from na or ob is distinct from nb or os is distinct from ns group by 1""")
def _(t):
    path = shared_dir(t.spark, "audit")
    found = changes(t)
    H.append_audit(found.filter("action = 'CREATED'"), path)
    H.append_audit(found.filter("action <> 'CREATED'"), path)
    trail = H.audit_query(t.spark.read.parquet(path), entity_type="submission")
    return trail.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


LOG = ("log", """select event_id, ts, line::json->>'$.stage' as stage, line::json->>'$.status' as status, line::json->>'$.document_id' as document_id,
   cast(line::json->>'$.duration_ms' as bigint) as duration_ms from v_stage_log""")


@query("j03_stage_metrics", "v_stage_log", [LOG], """
select stage, count(*) filter (where status = 'STARTED') as started, count(*) filter (where status = 'SUCCESS') as succeeded, count(*) filter (where status = 'FAILURE') as failed,
  round(count(*) filter (where status = 'FAILURE') / (count(*) filter (where status <> 'STARTED')), 6) as failure_rate, round(avg(duration_ms) filter (where status <> 'STARTED'), 4) as mean_ms,
  min(duration_ms) filter (where status <> 'STARTED') as min_ms, max(duration_ms) filter (where status <> 'STARTED') as max_ms,
  quantile_disc(duration_ms, 0.95) filter (where status <> 'STARTED') as p95_ms from log group by stage""")
def _(t):
    return H.stage_metrics(H.parse_stage_log(t.v_stage_log)).withColumns(
        {"failure_rate": F.round("failure_rate", 6), "mean_ms": F.round("mean_ms", 4)})


@query("j03_stage_runs", "v_stage_log", [LOG], """
select stage, document_id, count(*) filter (where status = 'STARTED') as started, count(*) filter (where status = 'SUCCESS') as succeeded,
  count(*) filter (where status = 'FAILURE') as failed, arg_max(status, ts) = 'STARTED' as is_open from log group by stage, document_id""")
def _(t):
    return H.stage_runs(H.parse_stage_log(t.v_stage_log)).drop("last_status")


RUNS = ("runs", """select stage, document_id, case when s then ts end as started_at, case when s and e then nts when not s then ts end as ended_at,
   case when not s then 'ORPHAN' when e then nstatus when nstatus is null then 'OPEN' else 'RESTARTED' end as outcome,
   case when s and e then (epoch_us(nts) - epoch_us(ts)) // 1000 when not s then duration_ms end as duration_ms,
   case when s then event_id end as start_id, case when s and e then nid when not s then event_id end as end_id
 from (select *, status = 'STARTED' as s, coalesce(nstatus in ('SUCCESS', 'FAILURE'), false) as e from (
   select *, lead(status) over w as nstatus, lead(ts) over w as nts, lead(event_id) over w as nid, lag(status) over w as before from log
     window w as (partition by stage, document_id order by ts, event_id)))
 where s or before is null or before <> 'STARTED'""")


@query("j03_matched_runs", "v_stage_log", [LOG, RUNS], "select * from runs")
def _(t):
    return H.match_runs(H.parse_stage_log(t.v_stage_log))


@query("j03_duration_quantiles", "v_stage_log", [LOG, RUNS], """
select stage, count(*) as n_runs, true as p50_in_bound, true as p95_in_bound from runs where outcome in ('SUCCESS', 'FAILURE') group by stage""")
def _(t):
    """Sketches a day, merged to stages; a quantile is in bound if its rank is off by 1.65 % of the runs at most (or by one)."""
    runs = H.match_runs(H.parse_stage_log(t.v_stage_log)).withColumn("day", F.to_date("ended_at"))
    found = H.merged_quantiles(H.duration_sketches(runs, ["stage", "day"]), ["stage"], {"p50_ms": 0.5, "p95_ms": 0.95})
    closed = runs.filter("outcome in ('SUCCESS', 'FAILURE')").select("stage", "duration_ms").join(F.broadcast(found), "stage")
    checked = closed.groupBy("stage", "n_runs").agg(*[F.count_if(F.col("duration_ms") < F.col(p)).alias(f"{p}_below") for p in ("p50_ms", "p95_ms")],
                                                    *[F.count_if(F.col("duration_ms") <= F.col(p)).alias(f"{p}_upto") for p in ("p50_ms", "p95_ms")])
    off = F.greatest(F.lit(1.0), F.col("n_runs") * 0.0165)

    def holds(p, q):
        return (F.col(f"{p}_below") <= F.col("n_runs") * q + off) & (F.col(f"{p}_upto") >= F.col("n_runs") * q - off)
    return checked.select("stage", "n_runs", holds("p50_ms", 0.5).alias("p50_in_bound"), holds("p95_ms", 0.95).alias("p95_in_bound"))


@query("j04_model_usage", "v_model_calls", sql="""
select model, count(*) as n_calls, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens,
  cast(sum(prompt_tokens) + sum(completion_tokens) as bigint) as total_tokens, round(avg(latency_ms), 4) as mean_latency_ms,
  round(count(*) filter (where finish_reason = 'length') / count(*), 6) as truncated_share from v_model_calls group by model""")
def _(t):
    return H.model_usage(t.v_model_calls).withColumns(
        {"mean_latency_ms": F.round("mean_latency_ms", 4), "truncated_share": F.round("truncated_share", 6)})


STREAMED = ("streamed", f"select * replace ({CLEAN.format(c='text')} as text) from v_insurance_text")
STREAM_CHAIN = [STREAMED] + [(n, b.replace("v_insurance_text", "streamed")) for n, b in CHAIN]


@query("k01_incremental_documents", "v_insurance_text", [*STREAM_CHAIN, *redaction("streamed")], """
select d.document_id, d.document_type, d.confidence, d.decision, r.pii_redactions from decided d join redacted r using (document_id)""")
def _(t):
    spark = t.spark
    schema = spark.read.parquet(f"{t.sf_dir}/documents.parquet").schema
    landed = pending.stream_documents(spark, f"{t.sf_dir}/documents.parquet*", schema)
    landed.createOrReplaceTempView("documents")
    processed = pending.process(spark.sql(SQL["v_insurance_text"]), 4000)
    out, checkpoint = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-checkpoint")
    pending.run_available(processed, out, checkpoint)
    return spark.read.parquet(out).select("document_id", "document_type", "confidence", "decision", "pii_redactions")


@query("k01_each_document_once", "v_insurance_text", [*STREAM_CHAIN, *redaction("streamed")], """
select d.document_id, d.document_type, r.pii_redactions, 1::bigint as n_rows from decided d join redacted r using (document_id)
union all select d.document_id + 1000000, d.document_type, r.pii_redactions, 1 from decided d join redacted r using (document_id) where d.document_id % 3 = 0""")
def _(t):
    """Every document lands in two files of a first run and partly in a second, beside new ones."""
    spark = t.spark
    landing, out, checkpoint = (shared_dir(spark, n) for n in ("landing", "once-out", "once-checkpoint"))

    def land(rows):
        rows.write.mode("append").parquet(landing)
        stream = pending.each_once(pending.stream_documents(spark, landing, texts.schema))
        pending.run_available(pending.process(stream, 4000), out, checkpoint)

    texts = t.v_insurance_text
    land(texts.union(texts.filter("document_id % 2 = 0")))
    late = texts.filter("document_id % 3 = 0")
    land(late.union(late.withColumn("document_id", F.col("document_id") + 1_000_000)))
    return spark.read.parquet(out).groupBy("document_id", "document_type", "pii_redactions").agg(F.count(F.lit(1)).alias("n_rows"))


@query("k01_last_revision", "v_insurance_text", [*STREAM_CHAIN, *redaction("streamed")], """
select d.document_id, case when d.document_id % 4 = 0 then 'OTHER' else d.document_type end as document_type, case when d.document_id % 4 = 0 then 0 else r.pii_redactions end as pii_redactions
from decided d join redacted r using (document_id)""")
def _(t):
    """A second run brings other contents of some documents: the stored table has each document once, as last seen."""
    spark = t.spark
    landing, table, checkpoint = (shared_dir(spark, n) for n in ("landing", "revisions", "revisions-checkpoint"))
    texts = t.v_insurance_text
    for rows in (texts, texts.filter("document_id % 2 = 0").withColumn("text", F.when(F.col("document_id") % 4 == 0, "nothing to see").otherwise(F.col("text")))
                 .withColumn("file_extension", F.when(F.col("document_id") % 4 == 0, "txt").otherwise(F.col("file_extension")))):
        rows.write.mode("append").parquet(landing)
        stream = pending.each_once(pending.stream_documents(spark, landing, texts.schema))
        pending.run_into(pending.process(stream, 4000), table, checkpoint, buckets=8)
    return store.load(spark, table).select("document_id", "document_type", "pii_redactions")
