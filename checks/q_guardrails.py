"""Guardrails."""

from pyspark.sql import functions as F

from bindery import fixed
from bindery.operators import guardrails as G
from checks.registry import lit, query

MAX_TOKENS = 2000
AVAILABLE = (MAX_TOKENS - 1524) * 4


def first_hit(patterns, column):
    return "case " + " ".join(f"when regexp_matches({column}, {lit('(?i)' + p)}) then {i}" for i, p in enumerate(patterns, 1)) + " end"


def redaction(source):
    """Chained CTEs that redact one pattern after the other."""
    ctes, prev = [], source
    for i, (name, pattern, replacement, ic) in enumerate(fixed.PII_PATTERNS):
        p = lit(("(?i)" if ic else "") + pattern)
        ctes.append((f"r{i}", f"select * exclude (text), len(regexp_extract_all(text, {p})) as n_{name}, "
                              f"regexp_replace(text, {p}, {lit(replacement)}, 'g') as text from {prev}"))
        prev = f"r{i}"
    total = " + ".join(f"n_{p[0]}" for p in fixed.PII_PATTERNS)
    ctes.append(("redacted", f"select *, {total} as pii_redactions from {prev}"))
    return ctes


SCANNED = ("scanned", f"select document_id, source, text, {first_hit(fixed.INJECTION_PATTERNS, 'text')} as injection_pattern from v_insurance_text")
CUT = f"""case when length(text) > {AVAILABLE} then substring(text, 1, {int(AVAILABLE * 0.7)}) || {lit(fixed.TRUNCATION_MARKER)} || right(text, {int(AVAILABLE * 0.3)}) else text end"""
SANITISED = ("sanitised", f"""select document_id, source, injection_pattern, pii_redactions, length(text) > {AVAILABLE} as was_truncated,
  case when injection_pattern is null then {CUT} end as text from redacted""")
CHAIN = [SCANNED, *redaction("scanned"), SANITISED]


@query("d01_injection_scan", "v_insurance_text", [SCANNED], "select document_id, injection_pattern from scanned")
def _(t):
    return G.scan_injection(t.v_insurance_text).select("document_id", "injection_pattern")


@query("d01_quarantine", "v_insurance_text", [SCANNED],
       "select document_id, injection_pattern, text from scanned where injection_pattern is not null")
def _(t):
    return G.split_flagged(G.scan_injection(t.v_insurance_text))[1].select("document_id", "injection_pattern", "text")


@query("d02_narrow_injection_scan", "v_insurance_text",
       sql=f"select document_id, {first_hit(fixed.SHORT_INJECTION_PATTERNS, 'substring(text, 1, 2000)')} as injection_pattern from v_insurance_text")
def _(t):
    return G.scan_injection_head(t.v_insurance_text).select("document_id", "injection_pattern")


@query("d03_pii_redaction", "v_insurance_text", redaction("v_insurance_text"),
       "select document_id, text, n_ssn, n_card, n_routing, n_secret, n_bearer, pii_redactions from redacted")
def _(t):
    return G.redact_pii(t.v_insurance_text).select(
        "document_id", "text", "n_ssn", "n_card", "n_routing", "n_secret", "n_bearer", "pii_redactions")


@query("d04_token_estimate", sql="select doc_id, cast(greatest(1, length(text) // 4) as int) as tokens from documents")
def _(t):
    return t.documents.select("doc_id", G.token_estimate(F.col("text")).alias("tokens"))


@query("d05_token_budget", sql=f"select doc_id, length(text) > {AVAILABLE} as was_truncated, {CUT} as text from documents")
def _(t):
    return t.documents.select("doc_id", "text").transform(G.enforce_token_budget, MAX_TOKENS)


@query("d06_sanitise_input", "v_insurance_text", CHAIN, "select * exclude (source) from sanitised")
def _(t):
    return t.v_insurance_text.transform(G.sanitise_input, MAX_TOKENS).select(
        "document_id", "injection_pattern", "pii_redactions", "was_truncated", "text")


VIOLATIONS = "list_filter([" + ", ".join(
    f"case when regexp_matches(raw_response, {lit('(?i)' + p)}) then {lit('Forbidden pattern in LLM output: ' + p[:60])} end"
    for p in fixed.FORBIDDEN_OUTPUT_PATTERNS) + \
    ", case when trim(raw_response) <> '' and not json_valid(raw_response) then 'LLM returned invalid JSON' end], lambda x: x is not null)"


@query("d07_output_check", "v_responses", sql=f"""
select document_id, array_to_string(v, '; ') as violations, len(v) = 0 as passed, length(raw_response) > 50000 as was_truncated,
  substring(raw_response, 1, 50000) as raw_response from (select *, {VIOLATIONS} as v from v_responses)""")
def _(t):
    return G.check_output(t.v_responses, expect_json=True).select(
        "document_id", F.array_join("violations", "; ").alias("violations"), "passed", "was_truncated", "raw_response")


STRIPPED = ("stripped", r"""select *, trim(regexp_replace(regexp_replace(trim(raw_response, chr(10) || ' '), '^(```json)?(```)?', ''), '```$', ''), chr(10) || ' ') as j from v_responses""")
REQUIRED = ["applicant_name", "annual_revenue"]


@query("d08_json_validation", "v_responses", [STRIPPED], f"""
select document_id, case when not json_valid(j) then 'not_json' when json_type(j) <> 'OBJECT' then 'not_object'
    when len(m) > 0 then 'missing_keys' else 'ok' end as status, case when json_valid(j) then array_to_string(m, ',') end as missing
from (select *, list_filter(['applicant_name', 'annual_revenue'], lambda k: not list_contains(case when json_valid(j) then json_keys(j) end, k)) as m from stripped)""")
def _(t):
    return G.validate_json(t.v_responses, REQUIRED).select(
        "document_id", "status", F.array_join("missing_keys", ",").alias("missing"))


@query("d09_disclaimer", "v_responses", sql=f"select document_id, {lit(fixed.DISCLAIMER)} || raw_response as raw_response from v_responses")
def _(t):
    return G.with_disclaimer(t.v_responses.select("document_id", "raw_response"), "raw_response")


@query("d10_guardrail_report", "v_insurance_text", CHAIN, """
select source, count(*) as n_texts, count(injection_pattern) as n_flagged, count(*) filter (where pii_redactions > 0) as n_redacted,
  cast(sum(pii_redactions) as bigint) as total_redactions, count(*) filter (where was_truncated) as n_truncated from sanitised group by source""")
def _(t):
    return t.v_insurance_text.transform(G.sanitise_input, MAX_TOKENS).transform(G.guardrail_report)


SCHEMA_RESPONSES = """select conv_id * 1000 + turn as document_id, case turn % 4
   when 0 then '{"submission_id": "00000000-0000-0000-0000-' || lpad(cast(conv_id as varchar), 12, '0') || '", "company_name": "C' || cast(conv_id as varchar) || '", "employee_count": ' || cast(conv_id % 50 - 5 as varchar) || ', "confidence": 0.5, "unknown": 1}'
   when 1 then '{"submission_id": "00000000-0000-0000-0000-000000000001", "annual_revenue": 12.5, "confidence": ' || cast(1 + conv_id % 2 as varchar) || '.0, "requested_coverages": ["GL", "Auto"]}'
   when 2 then '{"company_name": "No id", "years_in_business": "many"}' else 'prose' end as raw_response
 from conversations"""


@query("d11_schema_validation", "", [("resp", SCHEMA_RESPONSES)], f"""
select document_id, errors = '' as is_valid, errors,
   case when errors = '' then (j->>'$.company_name') end as company_name, case when errors = '' then cast(j->>'$.employee_count' as bigint) end as employee_count,
   case when errors = '' then cast(j->>'$.annual_revenue' as double) end as annual_revenue,
   case when errors = '' then coalesce(cast(j->>'$.confidence' as double), 0e0) end as confidence,
   case when errors = '' then coalesce(array_to_string(cast(j->'$.requested_coverages' as varchar[]), ','), '') end as coverages
 from (select *, array_to_string(list_filter([
      case when j is null then 'response: not an object' end,
      case when (j->>'$.submission_id') is null then 'submission_id: uuid required' end,
      case when (j->'$.years_in_business') is not null and try_cast(j->>'$.years_in_business' as double) is null then 'years_in_business: integer expected' end,
      case when cast(j->>'$.employee_count' as double) < 0 then 'employee_count: must be >= 0' end,
      case when not cast(j->>'$.confidence' as double) between 0 and 1 then 'confidence: must be between 0 and 1' end], lambda x: x is not null), '; ') as errors
   from (select *, case when json_valid(raw_response) then cast(raw_response as json) end as j from resp))""")
def _(t):
    t.conversations.createOrReplaceTempView("conversations")
    responses = t.spark.sql(SCHEMA_RESPONSES.replace("as varchar", "as string"))
    return G.validate_schema(responses).select(
        "document_id", "is_valid", F.array_join("schema_errors", "; ").alias("errors"), "company_name", "employee_count",
        "annual_revenue", "confidence", F.array_join("requested_coverages", ",").alias("coverages"))
