"""Field values and validation."""

from pyspark.sql import functions as F

from bindery import fixed
from bindery.functions import values as X
from bindery.functions.similarity import ratio, sequence_ratio
from bindery.functions.text import title_case
from bindery.operators import catalogue, issue_evidence as IE, relational as R, validate as V
from bindery.plans import validation as P
from checks.q_relational import VERSIONED
from checks.registry import lit, lits, query

AS_OF = "1998-06-01"
NUM = lit(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$")
FORMATS = "['%m/%d/%Y', '%m-%d-%Y', '%Y-%m-%d', '%m/%d/%y', '%d/%m/%Y', '%B %d, %Y']"


def plain(s):
    return f"case when regexp_matches({s}, {NUM}) then cast(replace({s}, '_', '') as double) end"


def currency(v):
    s = f"regexp_replace({v}, '[$,\\s]', '', 'g')"
    return (f"case when upper(right({s}, 1)) = 'M' then {plain(f'left({s}, -1)')} * 1e6"
            f" when upper(right({s}, 1)) = 'K' then {plain(f'left({s}, -1)')} * 1e3 else {plain(s)} end")


def norm(v):
    return f"trim(regexp_replace(regexp_replace(lower({v}), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def title(v):
    """Title case of an underscore name in SQL."""
    return f"array_to_string(list_transform(string_split({v}, '_'), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ')"


UNWRAPPED = ("unwrapped", """select *, field_value->>'$.value' as value, json_type(field_value, '$.value') as jt from v_fields""")
ASSEMBLED = ("assembled", """select f.submission_id, f.document_id, d.document_type, field_ordinal, field_name, confidence, value, jt,
   case when jt = 'VARCHAR' then '''' || value || '''' else value end as shown
 from unwrapped f join versioned d using (document_id) where is_current_version and document_type is not null""")
BASE = [VERSIONED, UNWRAPPED, ASSEMBLED]
VIEWS = "v_documents v_fields"


def assembled(t):
    return V.assemble(t.v_fields, R.assign_versions(t.v_documents))


def scalar_query(name, expr, spark_expr):
    @query(name, "v_fields", [UNWRAPPED], f"select field_name, value, {expr} as parsed, count(*) as n from unwrapped group by all")
    def _(t):
        got = t.v_fields.select("field_name", X.unwrap("field_value").alias("value"))
        return got.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("parsed", spark_expr("value"))


scalar_query("f01_unwrap", "value", lambda c: F.col(c))
scalar_query("f02_parse_currency", currency("value"), X.parse_currency)
scalar_query("f03_parse_date", f"cast(try_strptime(value, {FORMATS}) as date)", X.parse_date)
scalar_query("f04_to_number", f"coalesce({currency('value')}, {plain('trim(value)')})", X.to_number)
scalar_query("f05_normalise_string", f"coalesce({norm('value')}, '')", X.normalise_string)


@query("f06_similar_neighbours")
def _(t):
    pairs = t.customer.alias("a").join(t.customer.alias("b"), F.col("a.c_custkey") + 1 == F.col("b.c_custkey"))
    return pairs.select(F.col("a.c_custkey").alias("c_custkey"), F.round(sequence_ratio("a.c_name", "b.c_name"), 6).alias("ratio"))


@query("f07_label", "v_fields", sql=f"select field_name, {title('field_name')} as label, count(*) as n from v_fields group by all")
def _(t):
    return t.v_fields.groupBy("field_name").agg(F.count(F.lit(1)).alias("n")).withColumn("label", title_case("field_name"))


@query("g01_input_assembly", VIEWS, BASE, "select submission_id, document_id, document_type, field_name, value, confidence from assembled")
def _(t):
    return assembled(t).select("submission_id", "document_id", "document_type", "field_name", "value", "confidence")


def chain(name, *conditions):
    return "case " + " ".join(conditions) + " end"


CLEAN = "trim(regexp_replace(value, '[,$]', '', 'g'))"
DAY = f"cast(try_strptime(value, {FORMATS}) as date)"
MESSAGES = {
    "non_negative": f"case when {plain(CLEAN)} is null then 'Value ' || shown || ' is not a valid number' when {plain(CLEAN)} < 0 then 'Value ' || shown || ' must be a non-negative number' end",
    "not_stale": f"case when date '{AS_OF}' - {DAY} > 90 then 'Effective date ' || shown || ' is more than 90 days in the past' end",
    "email": f"case when value <> '' and not regexp_matches(trim(value), {lit(fixed.EMAIL_PATTERN)}) then 'Value ' || shown || ' does not look like a valid email address' end",
    "experience_mod": f"case when not {plain('trim(value)')} between 0.5 and 3 then 'Experience mod factor ' || shown || ' is outside the normal range (0.50–3.00). Verify this value.' end",
    "coinsurance": f"case when not {plain('rtrim(trim(value), ' + lit('%') + ')')} between 50 and 100 then 'Coinsurance ' || shown || '% is outside the normal range (50–100%)' end",
}
FIELD_SQL = " union all ".join(f"""select submission_id, 'INVALID' as issue_type, '{sev}' as severity, field_name, 'Invalid Value: ' || {title('field_name')} as title,
   {MESSAGES[kind]} as description, 'Verify the value for ''' || field_name || ''' in the source document.' as suggested_action, document_id
   from assembled where field_name = '{f}' and value is not null {'and document_type in ' + lits(types) if types else ''}""" for f, kind, sev, types in fixed.FIELD_RULES)
FIELD = ("field_violations", f"select * from ({FIELD_SQL}) where description is not null")


def field_rule_query(name, kinds):
    rules = [r for r in fixed.FIELD_RULES if r[1] in kinds]
    names = lits(r[0] for r in rules)

    @query(name, VIEWS, [*BASE, FIELD], f"select document_id, field_name, severity, description from field_violations where field_name in {names}")
    def _(t):
        return V.field_violations(assembled(t), AS_OF, rules).select("document_id", "field_name", "severity", "description")


field_rule_query("g02_non_negative_numbers", {"non_negative"})
field_rule_query("g03_stale_effective_date", {"not_stale"})
field_rule_query("g04_email_format", {"email"})
field_rule_query("g05_experience_modifier", {"experience_mod"})
field_rule_query("g06_coinsurance", {"coinsurance"})


@query("g07_field_rules", VIEWS, [*BASE, FIELD], "select * from field_violations")
def _(t):
    return V.field_violations(assembled(t), AS_OF)


@query("g08_future_date", VIEWS, BASE, f"""
select document_id, 'Date ' || shown || ' is in the future' as description from assembled where field_name = 'policy_expiration_date' and {DAY} > date '{AS_OF}'""")
def _(t):
    rules = [("policy_expiration_date", "not_future", "WARNING", None)]
    return V.field_violations(assembled(t), AS_OF, rules).select("document_id", "description")


LAST = ("last_values", """select submission_id, document_id, document_type, field_name, arg_max(struct_pack(v := value, jt := jt), field_ordinal) as s
  from assembled group by all""")
FACTS = ("facts", f"""select submission_id, document_id, document_type,
   max(case when field_name = 'policy_effective_date' then s.v end) as effective, max(case when field_name = 'policy_expiration_date' then s.v end) as expiration,
   max(case when field_name = 'annual_revenue' then s.v end) as revenue, max(case when field_name = 'employee_count' then s.v end) as employees,
   list(field_name) filter (where s.v is not null) as present from last_values group by submission_id, document_id, document_type""")


@query("g09_document_field_pivot", VIEWS, [*BASE, LAST], "select document_id, field_name, s.v as value from last_values")
def _(t):
    return V.last_values(assembled(t)).select("document_id", "field_name", "value")


def day(v):
    return f"cast(try_strptime({v}, {FORMATS}) as date)"


ORDER = ("date_order", f"""select submission_id, 'INVALID' as issue_type, 'ERROR' as severity, 'policy_effective_date/policy_expiration_date' as field_name,
   'Cross-Field Issue: Policy Effective Date vs Policy Expiration Date' as title, 'Expiration date (' || expiration || ') must be after effective date (' || effective || ')' as description,
   'Verify both field values and correct any discrepancies.' as suggested_action, document_id from facts where {day('expiration')} <= {day('effective')}""")
RATIO = ("revenue_ratio", f"""select *, case when round_even(ratio, 0) = 0 and ratio < 0 then '-0' else format('{{:,}}', cast(round_even(ratio, 0) as bigint)) end as r from (
   select *, {currency('revenue')} / {plain('trim(employees)')} as ratio from facts where document_type = 'ACORD_APPLICATION' and {plain('trim(employees)')} > 0)""")
REVENUE = ("revenue_violations", """select submission_id, 'INVALID' as issue_type, 'WARNING' as severity, 'annual_revenue/employee_count' as field_name,
   'Cross-Field Issue: Annual Revenue vs Employee Count' as title, 'Revenue per employee ($' || r || ') is unusually ' || case when ratio < 5000 then 'low' else 'high' end
     || '. Verify annual revenue and employee count.' as description, 'Verify both field values and correct any discrepancies.' as suggested_action, document_id
   from revenue_ratio where ratio < 5000 or ratio > 50000000""")


def facts(t):
    return V.document_facts(V.last_values(assembled(t)))


@query("g10_date_order", VIEWS, [*BASE, LAST, FACTS, ORDER], "select * from date_order")
def _(t):
    return V.date_order_violations(facts(t))


@query("g11_revenue_per_employee", VIEWS, [*BASE, LAST, FACTS, RATIO, REVENUE], "select * from revenue_violations")
def _(t):
    return V.revenue_per_employee_violations(facts(t))


CAND = ("candidates", f"""select *, coalesce({currency('value')}, {plain('trim(value)')}) as number, {day('value')} as day, coalesce({norm('value')}, '') as norm
  from assembled where confidence >= 0.4 and field_name not in {lits(fixed.IGNORED_FOR_CONFLICT + [fixed.RAW_OUTPUT_FIELD])}""")
GROUPS = ("conflict_groups", """select *, case when first.number is not null then 'number' when first.day is not null then 'date' else 'text' end as kind from (
   select submission_id, field_name, count(*) as n, arg_min(struct_pack(number := number, day := day), document_id * 100 + field_ordinal) as first,
     min(number) as min_number, max(number) as max_number, count(number) as n_numbers, min(day) as min_day, max(day) as max_day, count(day) as n_days,
     count(*) filter (where norm <> '') as n_texts, count(distinct norm) filter (where norm <> '') as n_distinct
   from candidates group by submission_id, field_name) where n >= 2""")


def candidates(t):
    return V.conflict_candidates(assembled(t))


def groups(t):
    return V.conflict_groups(V.conflict_texts(candidates(t)))


@query("g12_conflict_candidates", VIEWS, [*BASE, CAND], "select submission_id, field_name, count(*) as n from candidates group by all having count(*) >= 2")
def _(t):
    return groups(t).select("submission_id", "field_name", "n")


@query("g13_conflict_dispatch", VIEWS, [*BASE, CAND, GROUPS], "select submission_id, field_name, kind, n_texts, n_distinct from conflict_groups")
def _(t):
    return groups(t).select("submission_id", "field_name", "kind", "n_texts", "n_distinct")


def money(v):
    """``{:,.2f}``"""
    r = f"round_even({v}, 2)"
    return f"(format('{{:,}}', cast(trunc({r}) as bigint)) || right(printf('%.2f', {r}), 3))"


NUMERIC = ("numeric_conflicts", f"""select submission_id, 'CONFLICT' as issue_type, 'ERROR' as severity, field_name, 'Conflicting values for ''' || {title('field_name')} || '''' as title,
   'Documents report different values for ''' || field_name || '''. Range: ' || {money('min_number')} || ' – ' || {money('max_number')} || ' (' || printf('%.1f', relative * 100) || '% difference).' as description,
   'Review all documents and confirm the correct value for ''' || field_name || '''. Contact the broker for clarification.' as suggested_action, cast(null as bigint) as document_id
  from (select *, abs(max_number - min_number) / greatest(abs(min_number), abs(max_number), 1e-9) as relative from conflict_groups where kind = 'number' and n_numbers >= 2 and (min_number <> 0 or max_number <> 0))
  where relative > 0.05""")
DATED = ("date_conflicts", f"""select submission_id, 'CONFLICT' as issue_type, 'ERROR' as severity, field_name, 'Conflicting dates for ''' || {title('field_name')} || '''' as title,
   'Documents show different dates for ''' || field_name || '''. Dates span ' || cast(max_day - min_day as varchar) || ' days: ' || cast(min_day as varchar) || ' – ' || cast(max_day as varchar) || '.' as description,
   'Confirm the correct ' || replace(field_name, '_', ' ') || ' with the broker.' as suggested_action, cast(null as bigint) as document_id
  from conflict_groups where kind = 'date' and n_days >= 2 and max_day - min_day > 7""")


@query("g14_numeric_conflicts", VIEWS, [*BASE, CAND, GROUPS, NUMERIC], "select * from numeric_conflicts")
def _(t):
    return V.numeric_conflicts(groups(t))


@query("g15_date_conflicts", VIEWS, [*BASE, CAND, GROUPS, DATED], "select * from date_conflicts")
def _(t):
    return V.date_conflicts(groups(t))


# The texts that the fixture's text fields take, percentages included; which of them are alike is the standard library's word.
SAID = ["acme roofing", "acme roofing inc", "borealis foods", "notanemail", "abexamplecom", "gl property umbrella", "workers comp", "unknown", *map(str, range(130))]
ALIKE = "(values " + ", ".join(f"({lit(a)}, {lit(b)}, {r!r}e0)" for a in SAID for b in SAID if a < b and (r := ratio(a, b)) >= fixed.SIMILAR_RATIO) + ") as r(a, b, ratio)"
TEXTUAL = ("text_conflicts", f"""select submission_id, 'CONFLICT' as issue_type, 'ERROR' as severity, field_name, 'Conflicting information for ''' || {title('field_name')} || '''' as title,
   'Documents provide different values for ''' || field_name || ''': ' || shown || '.' as description,
   'Verify the correct value for ''' || field_name || ''' with the broker.' as suggested_action, cast(null as bigint) as document_id
 from (select submission_id, field_name, min(coalesce(ratio, 0)) filter (where next is not null) as least, string_agg('''' || norm || '''', ', ' order by norm) filter (where place <= 4) as shown
   from (select *, lead(norm) over w as next, row_number() over w as place from (select distinct submission_id, field_name, norm from candidates join conflict_groups using (submission_id, field_name)
       where kind = 'text' and n_texts >= 2 and n_distinct > 1 and norm <> '') window w as (partition by submission_id, field_name order by norm)) left join {ALIKE} on a = norm and b = next
   group by all) where least < {fixed.SIMILAR_RATIO}""")


@query("g16_text_conflicts", VIEWS, [*BASE, CAND, GROUPS, TEXTUAL], "select * from text_conflicts")
def _(t):
    texts = V.conflict_texts(candidates(t)).checkpoint()
    return V.text_conflicts(texts, V.conflict_groups(texts))


MEMBERS = ("members", """select submission_id, field_name, document_id, arg_max(value, field_ordinal) as value, count(*) as occurrences from candidates
  where (submission_id, field_name) in (select (submission_id, field_name) from numeric_conflicts union all select (submission_id, field_name) from date_conflicts) group by all""")


@query("g17_conflict_members", VIEWS, [*BASE, CAND, GROUPS, NUMERIC, DATED, MEMBERS], "select * from members")
def _(t):
    c = P.kept_together(candidates(t).select(*V.KEYS, "document_id", "field_ordinal", "value", "number", "day", "norm"))
    return V.conflict_members(c, V.figure_conflicts(V.conflict_groups(V.conflict_texts(c))))


EVERYWHERE = ("missing_everywhere", f"""select submission_id, 'MISSING' as issue_type, 'ERROR' as severity, field_name, 'Required Field Missing: ' || {title('field_name')} as title,
   '''' || {title('field_name')} || ''' was not found in any document in this submission. This field is required for underwriting.' as description,
   'Request the ' || {title('field_name')} || ' from the broker.' as suggested_action, cast(null as bigint) as document_id
  from v_submissions sub, (values ('applicant_name'), ('policy_effective_date')) as r(field_name)
  where not exists (select 1 from last_values l where l.submission_id = sub.submission_id and l.field_name = r.field_name and l.s.v is not null)""")
CATALOGUE = "(values " + ", ".join(f"({lit(r[0])}, {r[1]}, {lit(r[2])}, {lit(r[3])}, {lit(r[4])}, {str(r[5]).lower()}, {lit(r[6])})" for r in catalogue.rows()) + \
    ") as c(document_type, ordinal, name, label, field_type, required, description)"
IN_DOCUMENTS = ("missing_in_documents", f"""select f.submission_id, 'MISSING' as issue_type, 'WARNING' as severity, c.name as field_name, 'Required Field Missing: ' || label as title,
   rtrim('''' || label || ''' was not found in document (type: ' || f.document_type || '). ' || c.description) as description,
   'Request the ''' || label || ''' from the broker or locate it in the submitted documents.' as suggested_action, f.document_id
  from facts f join {CATALOGUE} on c.document_type = f.document_type and required and c.name not in ('applicant_name', 'policy_effective_date')
  where not list_contains(coalesce(present, []), c.name)""")
DEDUP = ("missing_once", """select * exclude (rn) from (select *, row_number() over (partition by submission_id, field_name, title order by document_id) as rn from missing_in_documents) where rn = 1""")
MISSING_VIEWS = VIEWS + " v_submissions"


@query("g18_missing_everywhere", MISSING_VIEWS, [*BASE, LAST, EVERYWHERE], "select * from missing_everywhere")
def _(t):
    return V.missing_everywhere(t.v_submissions, facts(t))


@query("g19_missing_in_documents", VIEWS, [*BASE, LAST, FACTS, IN_DOCUMENTS], "select * from missing_in_documents")
def _(t):
    return V.missing_in_documents(facts(t))


@query("g20_deduplicate", VIEWS, [*BASE, LAST, FACTS, IN_DOCUMENTS, DEDUP], "select * from missing_once")
def _(t):
    return V.deduplicate(V.missing_in_documents(facts(t)))


TYPES = ("present_types", "select submission_id, list(distinct document_type) filter (where document_type is not null) as types from versioned where is_current_version group by submission_id")
FORMS = ("missing_forms", f"""select submission_id, 'MISSING' as issue_type, 'WARNING' as severity, cast(null as varchar) as field_name, 'Missing Form for Requested Coverage: ' || line as title,
   'Coverage ''' || line || ''' was requested but the corresponding form (' || form || ') was not found in the submission.' as description,
   'Request the ' || {title('lower(form)')} || ' form from the broker.' as suggested_action, cast(null as bigint) as document_id
  from (select submission_id, unnest(case when s.jt = 'ARRAY' then cast(cast(s.v as json) as varchar[]) else [s.v] end) as line from (
      select submission_id, arg_min(struct_pack(v := value, jt := jt), document_id * 100 + field_ordinal) as s from assembled
      where document_type = 'ACORD_APPLICATION' and field_name = 'lines_requested' group by submission_id))
  join (values {', '.join(f'({lit(a)}, {lit(b)})' for a, b in fixed.COVERAGE_FORM.items())}) as m(k, form) on m.k = lower(trim(line))
  left join present_types using (submission_id) where not coalesce(list_contains(types, form), false)""")
RULES = ("submission_rules", f"""select submission_id, 'MISSING' as issue_type, 'WARNING' as severity, cast(null as varchar) as field_name, title, description, suggested_action, cast(null as bigint) as document_id
  from (select s.submission_id, coalesce(types, []) as types from v_submissions s left join present_types using (submission_id)),
    (values {', '.join(f'({i}, {lit(a)}, {lit(b)}, {lit(c)})' for i, (a, b, c) in enumerate(V.SUBMISSION_RULES))}) as r(i, title, description, suggested_action)
  where (i = 0 and not list_contains(types, 'ACORD_APPLICATION'))
     or (i = 1 and not list_contains(types, 'LOSS_RUN') and list_has_any(types, ['ACORD_APPLICATION', 'ACORD_GL', 'ACORD_PROPERTY', 'ACORD_WORKERS_COMP']))""")


@query("g21_missing_forms", VIEWS, [*BASE, TYPES, FORMS], "select * from missing_forms")
def _(t):
    docs = R.assign_versions(t.v_documents)
    return V.missing_forms(V.lines_requested(V.assemble(t.v_fields, docs)), V.present_types(docs))


@query("g22_submission_rules", "v_documents v_submissions", [VERSIONED, TYPES, RULES], "select * from submission_rules")
def _(t):
    return V.submission_rule_violations(t.v_submissions, V.present_types(R.assign_versions(t.v_documents)))


ALL = [*BASE, FIELD, LAST, FACTS, ORDER, RATIO, REVENUE, CAND, GROUPS, NUMERIC, DATED, EVERYWHERE, IN_DOCUMENTS, DEDUP, TYPES, FORMS, RULES,
       ("violations", " union all by name ".join(f"select * from {n}" for n in (
           "field_violations", "date_order", "revenue_violations", "numeric_conflicts", "date_conflicts", "missing_everywhere",
           "missing_once", "missing_forms", "submission_rules"))),
       ("report", """select s.submission_id, count(v.title) as total_issues, count(*) filter (where severity = 'ERROR') as error_count,
          count(*) filter (where severity = 'WARNING') as warning_count, count(*) filter (where issue_type = 'CONFLICT') as conflict_count,
          count(*) filter (where issue_type = 'MISSING') as missing_count, count(*) filter (where issue_type = 'INVALID') as invalid_count
         from v_submissions s left join violations v using (submission_id) group by s.submission_id""")]


def validation(t, **options):
    return P.run(t.v_fields, R.assign_versions(t.v_documents), t.v_submissions, AS_OF, by_submission=True, **options)


@query("g23_report_counts", MISSING_VIEWS, ALL, "select * from report")
def _(t):
    return validation(t, compare_texts=False).report


@query("g23_string_ids", MISSING_VIEWS, ALL, "select * from report")
def _(t):
    def text(df):
        return df.withColumn("document_id", F.format_string("%012d-id", "document_id"))
    return P.run(text(t.v_fields), text(R.assign_versions(t.v_documents)), t.v_submissions, AS_OF, compare_texts=False, by_submission=True).report


WITH_TEXTS = [(n, f"{body} union all by name select * from text_conflicts") if n == "violations" else (n, body) for n, body in ALL]
WITH_TEXTS.insert([n for n, _ in ALL].index("violations"), TEXTUAL)


@query("g23_report_counts_with_texts", MISSING_VIEWS, WITH_TEXTS, "select * from report")
def _(t):
    return validation(t).report


@query("g24_refresh_issues", MISSING_VIEWS + " v_issues", ALL, """
select submission_id, issue_type, severity, title, description, document_id, is_resolved, issue_id from (
  select submission_id, issue_type, severity, null as title, null as description, null as document_id, is_resolved, issue_id from v_issues where is_resolved
  union all select submission_id, issue_type, severity, title, description, document_id, false, null from violations)""")
def _(t):
    fresh = V.refresh_issues(t.v_issues, validation(t, compare_texts=False).violations, t.v_submissions)
    return fresh.select("submission_id", "issue_type", "severity", "title", "description", "document_id", "is_resolved", "issue_id")


KEY = "sha256(" + " || chr(31) || ".join(f"coalesce(cast({{p}}{c} as varchar), chr(30))" for c in IE.CONTENT) + ")"
EVIDENCE = [*ALL, MEMBERS, ("doc_values", "select document_id, field_name, arg_max(value, field_ordinal) as value, count(*) as occurrences from assembled group by all"),
            ("evidence", f"""select distinct v.submission_id, {KEY.format(p='v.')} as issue_key, m.document_id, m.value, m.occurrences from violations v join members m using (submission_id, field_name) where issue_type = 'CONFLICT'
  union all select distinct v.submission_id, {KEY.format(p='v.')}, v.document_id, d.value, coalesce(d.occurrences, 0) from violations v left join doc_values d on d.document_id = v.document_id and d.field_name = v.field_name
    where issue_type <> 'CONFLICT' and v.document_id is not null""")]


@query("g17_issue_evidence", MISSING_VIEWS, EVIDENCE, "select * from evidence")
def _(t):
    return validation(t, compare_texts=False).evidence


STORED = "select submission_id, issue_type, cast(null as string) as field_name, cast(issue_id as string) as title, cast(null as string) as description, issue_id as document_id, is_resolved, issue_id from v_issues"


@query("g24_refresh_evidence", MISSING_VIEWS + " v_issues", [*EVIDENCE, ("stored", STORED)], f"""
select submission_id, {KEY.format(p='stored.')} as issue_key, document_id, 'as stored' as value, 1::bigint as occurrences from stored where is_resolved union all select * from evidence""")
def _(t):
    t.v_issues.createOrReplaceTempView("v_issues")
    stored = IE.with_key(t.spark.sql(STORED))
    before = stored.select("submission_id", "issue_key", "document_id", F.lit("as stored").alias("value"), F.lit(1).cast("long").alias("occurrences"))
    return IE.refresh_evidence(before, stored, validation(t, compare_texts=False).evidence, t.v_submissions)


@query("g25_status_transition", MISSING_VIEWS, ALL, """
select submission_id, case when error_count = 0 then 'READY_FOR_REVIEW' else 'VALIDATING_DATA' end as status from report""")
def _(t):
    return V.advance_status(t.v_submissions, validation(t, compare_texts=False).report).select("submission_id", "status")


@query("g26_issue_summary", "v_issues", sql="""
select submission_id, count(*) as total_issues, count(*) filter (where not is_resolved) as unresolved, count(*) filter (where is_resolved) as resolved,
  count(*) filter (where not is_resolved and severity = 'ERROR') as errors, count(*) filter (where not is_resolved and severity = 'WARNING') as warnings,
  count(*) filter (where not is_resolved and issue_type = 'CONFLICT') as conflicts, count(*) filter (where not is_resolved and issue_type = 'MISSING') as missing,
  count(*) filter (where not is_resolved and issue_type = 'INVALID') as invalid from v_issues group by submission_id""")
def _(t):
    return V.issue_summary(t.v_issues)


@query("g26_issues_in_order", "v_issues", sql="select issue_id, submission_id, severity, issue_type, is_resolved from v_issues")
def _(t):
    return V.issues_in_order(t.v_issues).select("issue_id", "submission_id", "severity", "issue_type", "is_resolved")


RESOLUTIONS = """select issue_id + case when severity = 'ERROR' and issue_type = 'INVALID' then 99 else 0 end as issue_id, submission_id,
   case issue_type when 'CONFLICT' then 'confirmed with broker' when 'MISSING' then 'ok' else 'accepted as it is' end as resolution_note from v_issues where not is_resolved"""


def resolutions(t):
    t.v_issues.createOrReplaceTempView("v_issues")
    return t.spark.sql(RESOLUTIONS).withColumns({"resolved_by": F.lit(1), "resolved_at": F.lit("2024-01-01 00:00:00").cast("timestamp")})


@query("g27_resolve_issues", "v_issues", [("res", RESOLUTIONS)], """
select i.issue_id, i.is_resolved or r.issue_id is not null as is_resolved, r.resolution_note from v_issues i
 left join res r on i.issue_id = r.issue_id and i.submission_id = r.submission_id and length(r.resolution_note) >= 10""")
def _(t):
    return V.resolve_issues(t.v_issues, resolutions(t))[0].select("issue_id", "is_resolved", "resolution_note")


@query("g27_rejected_resolutions", "v_issues", [("res", RESOLUTIONS)], """
select r.issue_id, case when length(resolution_note) < 10 then 'note too short' else 'issue not found' end as reject_reason from res r
 where length(resolution_note) < 10 or not exists (select 1 from v_issues i where i.issue_id = r.issue_id and i.submission_id = r.submission_id)""")
def _(t):
    return V.resolve_issues(t.v_issues, resolutions(t))[1].select("issue_id", "reject_reason")
