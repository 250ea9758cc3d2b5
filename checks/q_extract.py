"""Extraction and evidence."""

from pyspark.sql import functions as F

from bindery import fixed
from bindery.operators import catalogue, evidence as V, extract as E, relational as R
from checks.q_guardrails import SCANNED, STRIPPED, redaction
from checks.q_relational import VERSIONED
from checks.q_validate import CATALOGUE, UNWRAPPED, title
from checks.registry import lit, query


@query("e01_field_catalogue", "v_documents", sql=f"""
select document_type, name as field_name, ordinal, label, field_type, required, count(*) as n_documents
from v_documents d join {CATALOGUE} using (document_type) group by all""")
def _(t):
    counts = t.v_documents.groupBy("document_type").agg(F.count(F.lit(1)).alias("n_documents"))
    return catalogue.table(t.spark).join(counts, "document_type").drop("description")


LINES = ("lines", f"""select document_type, string_agg('- ' || label || ' (' || name || ')' || case when description <> '' then ': ' || description else '' end
   || case when required then ' [REQUIRED]' else '' end, chr(10) order by ordinal) as field_list from {CATALOGUE} group by document_type""")
TYPED = ("typed", f"""select document_id, case document_id % 14 {' '.join(f"when {i} then {lit(x)}" for i, x in enumerate(fixed.DOCUMENT_TYPES))} end as document_type, text from v_insurance_text""")
PARTS = E.EXTRACTION_TEMPLATE.replace("{document_type}", "\0").replace("{guidelines}", "\0").replace("{field_list}", "\0").replace("{document_text}", "\0").split("\0")
PROMPT = ("prompts", f"""select document_id, document_type, {lit(PARTS[0])} || {title("lower(document_type)")} || {lit(PARTS[1] + PARTS[2])}
   || coalesce(field_list, 'Extract all relevant insurance information.') || {lit(PARTS[3])} || text || {lit(PARTS[4])} as text from typed left join lines using (document_type)""")


def typed(t):
    types = F.array(*[F.lit(x) for x in fixed.DOCUMENT_TYPES])
    return t.v_insurance_text.select("document_id", F.element_at(types, (F.col("document_id") % 14 + 1).cast("int")).alias("document_type"), "text")


@query("e02_extraction_requests", "v_insurance_text", [LINES, TYPED, PROMPT, *redaction("prompts")], """
select r.document_id, r.document_type, p.text as prompt_used, pii_redactions, length(r.text) > 9904 as was_truncated
from redacted r join prompts p using (document_id)""")
def _(t):
    return E.extraction_requests(typed(t), catalogue.table(t.spark), 4000).select(
        "document_id", "document_type", "prompt_used", "pii_redactions", "was_truncated")


@query("e02_custom_prompts", "v_insurance_text", [TYPED], """
select document_id, 'List the claims of' || chr(10) || text || chr(10) || 'as a table' as with_place,
  'Which cover?' || chr(10) || chr(10) || 'DOCUMENT TEXT:' || chr(10) || '<document_text>' || chr(10) || text || chr(10) || '</document_text>' as appended from typed""")
def _(t):
    docs = typed(t)
    placed = E.prompt_requests(docs, "List the claims of\n{document_text}\nas a table").withColumnRenamed("prompt", "with_place")
    return placed.join(E.prompt_requests(docs, "Which cover?").withColumnRenamed("prompt", "appended"), "document_id")


TEMPLATES = [("loss_run", "Claims of ${document_id}:\n${document_text}"), ("acord_gl", "Liability {document_id} [{field_list}] {document_text}"),
             ("generic", "{document_type}: {field_list}\n{rag_context}\n{document_text}")]


@query("e03_fill_templates", "v_insurance_text", [TYPED], """
select document_id, case document_type when 'LOSS_RUN' then 'Claims of ' || cast(document_id as varchar) || ':' || chr(10) || text
   when 'ACORD_GL' then 'Liability ' || cast(document_id as varchar) || ' [a, b] ' || text
   else document_type || ': a, b' || chr(10) || 'No guideline context available.' || chr(10) || text end as prompt from typed""")
def _(t):
    templates = t.spark.createDataFrame(TEMPLATES, "template_name string, template string")
    return E.fill_templates(typed(t), templates, document_id=F.col("document_id").cast("string"), document_type=F.col("document_type"),
                            field_list=F.lit("a, b"), rag_context=F.lit(E.NO_CONTEXT), document_text=F.col("text")).select("document_id", "prompt")


@query("e03_guarded_summaries", "v_insurance_text", [SCANNED, *redaction("scanned")], f"""
select document_id, injection_pattern, pii_redactions, case when injection_pattern is null then 'Ref SUB-' || cast(document_id as varchar) || chr(10) || '{E.NO_CONTEXT}' || chr(10)
   || case when length(text) > 9904 then substring(text, 1, 6932) || {lit(fixed.TRUNCATION_MARKER)} || right(text, 2971) else text end end as prompt from redacted""")
def _(t):
    template = "Ref ${submission_number}\n${rag_context}\n${document_text}"
    docs = t.v_insurance_text.select("document_id", F.col("text").alias("document_text"))
    number = F.concat(F.lit("SUB-"), F.col("document_id").cast("string"))
    return E.fill_guarded(docs, template, 4000, submission_number=number, rag_context=F.lit(E.NO_CONTEXT)).select(
        "document_id", "injection_pattern", "pii_redactions", "prompt")


@query("e04_parse_responses", "v_responses", [STRIPPED], "select document_id, case when json_valid(j) then j end as json_text from stripped")
def _(t):
    return E.parse_responses(t.v_responses).select("document_id", "json_text")


ROWS = ("field_rows", f"""select submission_id, document_id, '{fixed.RAW_OUTPUT_FIELD}' as field_name, '{fixed.RAW_OUTPUT_LABEL}' as field_label, 1e0 as confidence, raw_response as shown from v_responses
 union all select submission_id, document_id, k, {title('k')}, 0.9e0, case when jt = 'OBJECT' then array_to_string(list_sort(json_keys(cast(v as json))), ',') else v end from (
   select submission_id, document_id, k, json_extract_string(j, '$.' || k) as v, json_type(j, '$.' || k) as jt from (
     select *, unnest(json_keys(j)) as k from stripped where json_valid(j) and json_type(j) = 'OBJECT')) where k <> '{fixed.RAW_OUTPUT_FIELD}'""")


def response_fields(t):
    return E.field_rows(t.v_responses)


@query("e05_field_rows", "v_responses", [STRIPPED, ROWS], "select * from field_rows")
def _(t):
    from bindery.functions.values import unwrap
    raw = F.get_json_object("field_value", "$.raw")
    return response_fields(t).withColumn("shown", F.when(F.col("field_name") == fixed.RAW_OUTPUT_FIELD, raw)
                                         .when(F.col("field_name") == "limits", F.array_join(F.sort_array(F.json_object_keys("field_value")), ","))
                                         .otherwise(unwrap("field_value"))) \
        .drop("field_value")


@query("e06_output_evidence", "v_responses", sql="""
select submission_id, document_id, 'Prompt of ' || raw_response as source_text, true as is_active from v_responses""")
def _(t):
    prompts = t.v_responses.select("document_id", F.concat(F.lit("Prompt of "), "raw_response").alias("prompt_used"))
    return E.output_evidence(t.v_responses, prompts).select("submission_id", "document_id", "source_text", "is_active")


FRESH = "conv_id * 1000 + turn as document_id, conv_id as submission_id from conversations where role = 'assistant' and length(text) > 100"


@query("e07_replace_fields", "v_responses", [STRIPPED, ROWS, ("fresh", f"select {FRESH}")], """
select document_id, field_name, false as is_new from field_rows where document_id not in (select document_id from fresh)
union all select document_id, 'rerun', true from fresh""")
def _(t):
    old = response_fields(t).select("document_id", "field_name", F.lit(False).alias("is_new"))
    new = t.conversations.filter("role = 'assistant' and length(text) > 100").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("document_id"), F.lit("rerun").alias("field_name"), F.lit(True).alias("is_new"))
    return E.replace_fields(old, new)


@query("e07_retire_evidence", "v_responses", [("fresh", f"select {FRESH}")], """
select document_id, document_id not in (select document_id from fresh) as is_active from v_responses union all select document_id, true from fresh""")
def _(t):
    old = t.v_responses.select("document_id", F.lit(True).alias("is_active"))
    new = t.conversations.filter("role = 'assistant' and length(text) > 100").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("document_id"), F.lit(True).alias("is_active"))
    return E.retire_evidence(old, new)


@query("e08_fill_applicant", "v_submissions v_responses", [STRIPPED, ROWS], """
select s.submission_id, coalesce(s.applicant_name, f) as applicant_name from v_submissions s left join (
  select submission_id, arg_min(shown, document_id * 10 + case field_name when 'applicant_name' then 1 when 'named_insured' then 2 else 3 end) as f
  from field_rows where field_name in ('applicant_name', 'named_insured', 'insured_name') and shown <> '' group by submission_id) using (submission_id)""")
def _(t):
    return E.fill_applicant(t.v_submissions, response_fields(t)).select("submission_id", "applicant_name")


@query("e09_extraction_eligibility", "v_documents", [VERSIONED], """
select document_id, document_type from versioned where is_current_version and processing_status <> 'FAILED'
  and document_type is not null and document_type not in ('EVIDENCE_PHOTO', 'IDENTITY_DOCUMENT')""")
def _(t):
    return E.eligible_documents(R.assign_versions(t.v_documents)).select("document_id", "document_type")


OVERRIDES = """select document_id, field_name, field_ordinal, '{"value": "fixed"}' as override_value,
   case when confidence < 0.5e0 then 'verified by phone' else 'typo' end as override_reason, 1 as asked from v_fields where field_name = 'annual_revenue'
  union all select document_id, field_name, field_ordinal, '{"value": "fixed again"}', 'verified by letter', 2 from v_fields where field_name = 'annual_revenue' and document_id % 3 = 0
  union all select document_id, field_name, field_ordinal, '{"value": "fixed last"}', 'hm', 3 from v_fields where field_name = 'annual_revenue' and document_id % 5 = 0"""


def overrides(t):
    t.v_fields.createOrReplaceTempView("v_fields")
    return t.spark.sql(OVERRIDES)


@query("e10_effective_values", "v_fields", [("o", OVERRIDES)], """
select f.document_id, f.field_name, o.document_id is not null as is_overridden, coalesce(override_value, field_value) as effective_value
from v_fields f left join (select document_id, field_ordinal, arg_max(override_value, asked) as override_value from o where length(override_reason) >= 10 group by all) o
   on f.document_id = o.document_id and f.field_ordinal = o.field_ordinal""")
def _(t):
    return E.apply_overrides(t.v_fields, overrides(t), ["document_id", "field_name", "field_ordinal"], ["asked"])[0].select(
        "document_id", "field_name", "is_overridden", "effective_value")


@query("e10_rejected_overrides", "v_fields", [("o", OVERRIDES)], """
select document_id, override_reason, case when length(override_reason) < 10 then 'reason too short' else 'superseded' end as why
from (select *, max(asked) filter (where length(override_reason) >= 10) over (partition by document_id) as last from o) where length(override_reason) < 10 or asked < last""")
def _(t):
    return E.apply_overrides(t.v_fields, overrides(t), ["document_id", "field_name", "field_ordinal"], ["asked"])[1].select("document_id", "override_reason", "why")


@query("e11_extraction_summary", "v_documents v_fields", [UNWRAPPED], f"""
select d.document_id, d.document_type, count(c.name) filter (where f.field_name is not null) as fields_found, count(c.name) as fields_attempted,
  coalesce(string_agg(c.name, ',' order by c.name) filter (where c.required and f.field_name is null), '') as missing_fields
from v_documents d left join {CATALOGUE} using (document_type)
  left join (select distinct document_id, field_name from unwrapped where value is not null) f on f.document_id = d.document_id and f.field_name = c.name
where d.document_type is not null group by d.document_id, d.document_type""")
def _(t):
    return E.extraction_summary(t.v_documents, t.v_fields).withColumn("missing_fields", F.array_join("missing_fields", ",")) \
        .withColumns({c: F.col(c).cast("long") for c in ("fields_found", "fields_attempted")})


MATCHED = ("matched", r"""select *, row_number() over (partition by document_id, field_name order by method, page_number) as rn from (
   select c.document_id, c.field_name, c.source_text, trim(source_text, E' \n\r\t') as cit, p.page_number, p.text,
     case when contains(p.text, trim(source_text, E' \n\r\t')) then 1 else 2 end as method
   from v_citations c join v_pages p on c.document_id = p.document_id and contains(lower(p.text), lower(trim(source_text, E' \n\r\t'))))""")


def location_query(name, method, code):
    @query(name, "v_citations v_pages", [MATCHED], f"""
    select document_id, field_name, page_number, cit as matched_text, {1.0 if code == 1 else 0.9}e0 as confidence from matched where rn = 1 and method = {code}""")
    def _(t):
        located = V.locate_verbatim(t.v_citations, t.v_pages)
        return located.filter(F.col("match_method") == method).select("document_id", "field_name", "page_number", "matched_text", "confidence")


location_query("e12_exact_location", "exact", 1)
location_query("e13_case_insensitive_location", "case_insensitive", 2)


def noisy(t):
    """Quotes of 250 characters with every 'e' read as 'c', as an OCR engine might."""
    return t.documents.filter("length(text) >= 300").select(
        F.col("doc_id").alias("document_id"), F.lit("noisy").alias("field_name"),
        F.translate(F.substring("text", 31, 250), "e", "c").alias("source_text"))


@query("e14_fuzzy_location")
def _(t):
    return V.map_citations(noisy(t), t.v_pages).drop("section")


# Short pages quoted whole with every 25th character lost: long windows hide frequent characters from the matcher, these are found for certain.
PLANTED = "select document_id, 'page_' || cast(page_number as string) as field_name, page_number, regexp_replace(text, '(?s)(.{24}).', '$1~') as source_text from v_pages where length(text) between 60 and 199"


@query("e14_planted_passages", "v_pages", sql="select document_id, field_name, page_number, 'fuzzy' as match_method from (select *, 'page_' || cast(page_number as varchar) as field_name from v_pages) where length(text) between 60 and 199")
def _(t):
    t.v_pages.createOrReplaceTempView("v_pages")
    return V.map_citations(t.spark.sql(PLANTED).drop("page_number"), t.v_pages).select("document_id", "field_name", "page_number", "match_method")


TITLED = """select document_id, page_number, '# Part ' || cast(page_number as varchar) || chr(10) || 'short line' || chr(10) || text as text from v_pages"""
HEADED = ("headed", """select document_id, field_name, page_number, list_reverse(list_transform(string_split(left(text, instr(lower(text), lower(cit)) - 1), chr(10)), lambda x: trim(x, E' \\n\\r\\t'))) as lines from matched where rn = 1""")
SECTIONS = ("sections", r"""select document_id, field_name, page_number, lines,
   list_position(list_transform(lines, lambda s: regexp_matches(s, '^#{1,3} ') or (length(s) >= 4 and upper(s) = s and lower(s) <> s and regexp_matches(replace(s, ' ', ''), '^\p{L}+$'))), true) as h,
   list_position(list_transform(lines, lambda s: length(s) > 80 and not (regexp_matches(s, '^#{1,3} ') or (upper(s) = s and lower(s) <> s and regexp_matches(replace(s, ' ', ''), '^\p{L}+$')))), true) as stop from headed""")


@query("e15_section_heading", "v_citations v_pages", [("titled", TITLED), (MATCHED[0], MATCHED[1].replace("v_pages", "titled")), HEADED, SECTIONS], """
select document_id, field_name, page_number, case when h > 0 and (stop is null or stop = 0 or h < stop) then trim(ltrim(lines[h], '#')) end as section from sections""")
def _(t):
    t.v_pages.createOrReplaceTempView("v_pages")
    titled = t.spark.sql(TITLED.replace("as varchar", "as string"))
    return V.locate_verbatim(t.v_citations, titled).select("document_id", "field_name", "page_number", "section")


@query("e16_map_citations", "v_citations v_pages", [MATCHED], """
select c.document_id, c.field_name, m.page_number, case m.method when 1 then 'exact' when 2 then 'case_insensitive' else 'not_found' end as match_method,
  case m.method when 1 then 1e0 when 2 then 0.9e0 else 0e0 end as confidence
from v_citations c left join matched m on m.document_id = c.document_id and m.field_name = c.field_name and rn = 1 where c.source_text <> ''""")
def _(t):
    return V.map_citations(t.v_citations, t.v_pages).select("document_id", "field_name", "page_number", "match_method", "confidence")
