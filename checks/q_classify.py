"""Classification."""

from pyspark.sql import functions as F

from bindery import fixed
from bindery.operators import classify as C
from bindery.plans.classification import classified_documents
from checks.registry import lit, lits, query

SAMPLE = """case when length(text) <= 6000 then text else substring(text, 1, 3000) || chr(10)
  || substring(text, cast(greatest(3000, length(text) // 2 - 1000) as int) + 1, 2000) || chr(10) || right(text, 1000) end"""
BASE = ("base", f"select document_id, source, file_extension, text, {SAMPLE} as sample, lower({SAMPLE}) as lc from v_insurance_text")


def hits(patterns):
    return " + ".join(f"cast(regexp_matches(lc, {lit(p)}) as int)" for p in patterns) or "0"


def required(patterns):
    return " and ".join(f"regexp_matches(lc, {lit(p)})" for p in patterns) or "true"


def score_sql(rule):
    _, req, bonus, neg, ext = rule
    return (f"case when {required(req)} then round(greatest(0e0, least(1e0, cast(file_extension in {lits(ext)} as int) * 0.05e0"
            f" + {'0.45e0' if req else '0e0'} + ({hits(bonus)}) / {len(bonus)}.0e0 * 0.5e0 - ({hits(neg)}) * 0.2e0)), 4) else 0e0 end")


SCORED = ("scored", "select document_id, source, text, lc, unnest(["
          + ", ".join(f"{{'ordinal': {i}, 'document_type': {lit(r[0])}, 'score': {score_sql(r)}}}"
                      for i, r in enumerate(fixed.CLASSIFICATION_RULES, 1)) + "], recursive := true) from base")
RANKED = ("ranked", """select *, row_number() over (partition by document_id order by score desc, ordinal) as r from scored""")
PATTERN_ROWS = ", ".join(f"({i}, {j}, {lit(p)})" for i, r in enumerate(fixed.CLASSIFICATION_RULES, 1) for j, p in enumerate(r[2], 1))
TOP = ("top2", f"""select a.document_id, a.source, a.text, a.lc, a.document_type as t1, a.ordinal as o1, a.score as s1, b.document_type as t2, b.score as s2
  from ranked a join ranked b on a.document_id = b.document_id and a.r = 1 and b.r = 2""")
MATCHED = ("matched", f"""select document_id, string_agg(pattern, '; ' order by j) as m from (
    select document_id, j, pattern, row_number() over (partition by document_id order by j) as n
    from top2 join (values {PATTERN_ROWS}) as p(i, j, pattern) on p.i = o1 where regexp_matches(lc, pattern)) where n <= 4 group by document_id""")
RULES = ("rules", """select document_id, source, text,
    case when s1 < 0.30e0 then 'OTHER' else t1 end as rules_type,
    case when s1 < 0.30e0 then round(1 - s1, 3) else round(s1, 3) end as rules_confidence,
    case when s1 < 0.30e0 then case when s1 > 0.1e0 then t1 end when s1 - s2 < 0.12e0 and s2 > 0.15e0 then t2 end as rules_alternative,
    s1 >= 0.30e0 and s1 - s2 < 0.12e0 and s2 > 0.15e0 as is_ambiguous,
    case when s1 < 0.30e0 then 'No strong rule match (best score ' || printf('%.2f', s1) || ' < threshold 0.3)'
      else 'Rule match for ' || t1 || coalesce(': ' || m, '')
        || case when s1 - s2 < 0.12e0 and s2 > 0.15e0 then ' (ambiguous with ' || t2 || ', gap=' || printf('%.2f', s1 - s2) || ')' else '' end end as rules_reason
  from top2 left join matched using (document_id)""")
SHORT_HIT = " or ".join(f"regexp_matches(substring(text, 1, 2000), {lit('(?i)' + p)})" for p in fixed.SHORT_INJECTION_PATTERNS)
DECIDED = ("decided", f"""select *, case when trim(text) = '' then 'no_text' when not is_ambiguous and rules_confidence >= 0.75e0 then 'accepted' else 'second_opinion' end as decision,
    case when trim(text) = '' then 'OTHER' else rules_type end as document_type,
    case when trim(text) = '' then 0e0 else rules_confidence end as confidence,
    case when trim(text) = '' then {lit(fixed.NO_TEXT_REASON)} else rules_reason end as reason,
    ({SHORT_HIT}) as short_hit,
    case when is_ambiguous then rules_type || ',' || rules_alternative || ',OTHER' else {lit(','.join(fixed.DOCUMENT_TYPES))} end as candidates
  from rules""")
CHAIN = [BASE, SCORED, RANKED, TOP, MATCHED, RULES, DECIDED]
RESPONSES = ("normal", f"""select document_id, raw_response, ok as so_valid,
    case when ok then case when upper(trim(j->>'$.document_type')) in {lits(fixed.DOCUMENT_TYPES)} then upper(trim(j->>'$.document_type')) else 'OTHER' end end as so_type,
    case when ok then greatest(0e0, least(1e0, coalesce(try_cast(j->>'$.confidence' as double), 0.72e0))) end as so_confidence,
    case when ok then '[LLM: unknown] ' || coalesce(j->>'$.reason', 'LLM classification') end as so_reason,
    case when ok and upper(trim(j->>'$.alternative_type')) in {lits(fixed.DOCUMENT_TYPES)} then upper(trim(j->>'$.alternative_type')) end as so_alternative
  from (select *, case when json_valid(raw_response) then cast(raw_response as json) end as j, json_valid(raw_response) as ok from v_class_responses)""")


def rules(t):
    return C.classify_by_rules(t.v_insurance_text)


@query("c01_text_sample", "v_insurance_text", [BASE], "select document_id, sample, cast(length(sample) as bigint) as n_chars from base")
def _(t):
    s = t.v_insurance_text.select("document_id", C.sample_text(F.col("text")).alias("sample"))
    return s.withColumn("n_chars", F.length("sample").cast("long"))


@query("c02_effective_extension", "v_uploads", sql="""
select upload_id, case when filename like '%.%' then lower(split_part(filename, '.', -1)) else '' end as extension from v_uploads""")
def _(t):
    return t.v_uploads.select("upload_id", C.effective_extension(F.lit(None).cast("string"), F.col("filename")).alias("extension"))


FEATURES = ("features", "select document_id, unnest([" + ", ".join(
    f"{{'document_type': {lit(r[0])}, 'required_ok': {required(r[1])}, 'n_bonus': case when {required(r[1])} then {hits(r[2])} end,"
    f" 'n_negative': case when {required(r[1])} then {hits(r[3])} else 0 end, 'ext_hit': file_extension in {lits(r[4])}}}"
    for r in fixed.CLASSIFICATION_RULES) + "], recursive := true) from base")


@query("c03_pattern_features", "v_insurance_text", [BASE, FEATURES], """
select document_type, required_ok, n_bonus, n_negative, ext_hit, count(*) as n_documents from features group by all""")
def _(t):
    featured = C.features(t.v_insurance_text)
    entries = [F.struct(F.lit(n).alias("document_type"), F.col(f"f_{n}.required_ok").alias("required_ok"),
                        F.length(F.regexp_replace(F.col(f"f_{n}.bonus"), "0", "")).alias("n_bonus"),
                        F.col(f"f_{n}.negatives").alias("n_negative"), F.col(f"f_{n}.ext_hit").alias("ext_hit"))
               for n in C.rule_names()]
    return featured.select(F.inline(F.array(*entries))).groupBy(
        "document_type", "required_ok", "n_bonus", "n_negative", "ext_hit").agg(F.count(F.lit(1)).alias("n_documents"))


@query("c04_rule_scores", "v_insurance_text", [BASE, SCORED], """
select document_type, score, count(*) as n_documents, min(document_id) as first_document from scored group by all""")
def _(t):
    scored = t.v_insurance_text.transform(C.features).transform(C.scores)
    return scored.select("document_id", F.inline("scores")).groupBy("document_type", "score").agg(
        F.count(F.lit(1)).alias("n_documents"), F.min("document_id").alias("first_document"))


@query("c05_rank_types", "v_insurance_text", CHAIN[:6],
       "select document_id, rules_type, rules_confidence, rules_alternative, is_ambiguous from rules")
def _(t):
    return rules(t).select("document_id", "rules_type", "rules_confidence", "rules_alternative", "is_ambiguous")


@query("c06_reason_text", "v_insurance_text", CHAIN[:6], "select document_id, rules_reason from rules")
def _(t):
    return rules(t).select("document_id", "rules_reason")


@query("c07_score_map", "v_insurance_text", [BASE, SCORED], "select document_id, document_type, score from scored")
def _(t):
    return C.score_map(t.v_insurance_text.transform(C.features).transform(C.scores))


@query("c08_acceptance_decision", "v_insurance_text", CHAIN, """
select document_id, decision, case when decision = 'second_opinion' then candidates end as candidates, document_type, confidence, reason from decided""")
def _(t):
    return C.decide(rules(t)).select("document_id", "decision", F.array_join("candidate_types", ",").alias("candidates"),
                                     "document_type", "confidence", "reason")


@query("c09_normalise_responses", "v_class_responses", [RESPONSES],
       "select document_id, so_valid, so_type, so_confidence, so_reason, so_alternative from normal")
def _(t):
    return C.normalise_responses(t.v_class_responses).select(
        "document_id", "so_valid", "so_type", "so_confidence", "so_reason", "so_alternative")


MERGED = ("merged", f"""select d.document_id, answered, second, agree,
    case when answered and second then ty else d.document_type end as document_type,
    case when answered then round(case when agree then least(mx + 0.05e0, 1e0) else mx end, 3) else confidence end as confidence,
    case when answered then case when second then rs else rules_reason end || case when agree then ' [rules and LLM agree]' else '' end
      when decision = 'second_opinion' then reason || case when responded then {lit(fixed.INVALID_RESPONSE_NOTE)} else {lit(fixed.NO_RESPONSE_NOTE)} end else reason end as reason,
    case when answered and second then coalesce(al, rules_alternative) when answered then coalesce(rules_alternative, al) else rules_alternative end as alternative_type,
    case when not answered then 'deterministic' when second and not agree then 'llm:' || mo else 'deterministic+llm' end as classified_by
  from (select *, ty = rules_type as agree, cf >= rules_confidence as second, greatest(cf, rules_confidence) as mx from (
    select d.*, n.so_valid is not null as responded, d.decision = 'second_opinion' and (short_hit or coalesce(so_valid, false)) as answered,
      case when short_hit then 'OTHER' else so_type end as ty, case when short_hit then 0e0 else so_confidence end as cf,
      case when short_hit then {lit(fixed.BLOCKED_REASON)} else so_reason end as rs, case when not short_hit then so_alternative end as al,
      case when short_hit then 'none' else 'unknown' end as mo
    from decided d left join normal n using (document_id))) d""")


@query("c10_merge_opinions", "v_insurance_text v_class_responses", [*CHAIN, RESPONSES, MERGED],
       "select document_id, document_type, confidence, reason, alternative_type, classified_by from merged")
def _(t):
    merged = C.merge_opinions(C.decide(rules(t)), C.normalise_responses(t.v_class_responses))
    return merged.select("document_id", "document_type", "confidence", "reason", "alternative_type", "classified_by")


CURRENT = ("current_docs", """select *, lead(document_id) over (partition by submission_id, original_filename order by uploaded_at, document_id) is null as is_current
  from v_documents""")


@query("c11_eligibility_summary", "v_documents", [CURRENT], """
select submission_id, count(*) as n_documents, """ + ", ".join(
    f"count(*) filter (where document_type = '{t}') as n_{t.lower()}" for t in fixed.DOCUMENT_TYPES) + """
from current_docs where is_current and processing_status in ('COMPLETED', 'CLASSIFYING') group by submission_id""")
def _(t):
    from bindery.operators.relational import assign_versions
    return assign_versions(t.v_documents).transform(C.eligible_documents).transform(C.type_counts)


@query("c12_second_opinion_requests", "v_insurance_text", CHAIN, """
select document_id, candidates, substring(text, 1, 2000) as excerpt,
  replace(replace(""" + lit(C.SECOND_OPINION_TEMPLATE) + """, '{candidates}', '  - ' || replace(candidates, ',', chr(10) || '  - ')), '{excerpt}', substring(text, 1, 2000)) as prompt
from decided where decision = 'second_opinion' and not short_hit""")
def _(t):
    return C.second_opinion_requests(C.decide(rules(t))).withColumn(
        "candidates", F.array_join("candidate_types", ",")).drop("candidate_types")


@query("c_flagship_type_counts", "v_insurance_text", CHAIN, """
select document_type, decision, count(*) as n_documents, round(avg(confidence), 4) as mean_confidence from decided group by all""")
def _(t):
    return classified_documents(t.v_insurance_text)
