"""Validation of the extracted fields of many submissions at once.

Violations are rows (submission_id, issue_type, severity, field_name, title,
description, suggested_action, document_id). A violation of one document names
it in ``document_id``; the documents of a conflict, of which there may be any
number, are rows of ``conflict_members``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery import fixed
from bindery.functions.barrier import compute_once
from bindery.functions.similarity import sequence_ratio
from bindery.functions.text import fixed_point, limited, strip, title_case
from bindery.functions.values import (normalise_string, parse_currency, parse_date, to_double, to_number,
                                      wrapped_variant)
from bindery.operators import catalogue
from bindery.operators.ranking import next_within

VIOLATION = ["submission_id", "issue_type", "severity", "field_name", "title", "description", "suggested_action", "document_id"]


# --- inputs -----------------------------------------------------------------
def assemble(fields: DataFrame, documents: DataFrame) -> DataFrame:
    """Fields of current documents with a valid type, values unwrapped once.

    A document belongs to one submission. Joined on both, so tables that lie
    together by submission are joined, and grouped afterwards, where they lie
    (``session.keep_partitions``). The raw extracted value counts, not an override.
    """
    typed = documents.filter("is_current_version").filter(F.col("document_type").isin(fixed.DOCUMENT_TYPES)) \
        .select("submission_id", "document_id", "document_type")
    joined = fields.select("submission_id", "document_id", "field_ordinal", "field_name", "field_value",
                           F.coalesce("confidence", F.lit(0.0)).alias("confidence")).join(typed, ["submission_id", "document_id"])
    v, kind = F.col("_v"), F.coalesce(F.schema_of_variant("_v"), F.lit("STRING"))
    parsed = compute_once(joined, _v=wrapped_variant("field_value"))
    return parsed.select(
        *joined.columns, F.when(v.isNotNull(), F.try_variant_get(v, "$", "string")).otherwise(F.col("field_value")).alias("value"),
        (kind == "STRING").alias("is_text"), (kind.startswith("ARRAY") | kind.startswith("OBJECT")).alias("is_nested"),
        (~kind.isin("STRING", "VOID") & F.coalesce(F.try_variant_get(v, "$", "double") == 0, F.lit(False))).alias("is_zero"),
        F.coalesce(strip("field_value") == "null", F.lit(True)).alias("is_absent"))


def _shown(value: Column, is_text: Column) -> Column:
    """The value as a message quotes it: text in quotes, numbers bare."""
    quoted = F.when(value.contains("'") & ~value.contains('"'), F.concat(F.lit('"'), value, F.lit('"'))) \
        .otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.when(is_text, quoted).otherwise(value)


# --- single fields ----------------------------------------------------------
def _check(kind: str, value: Column, shown: Column, as_of: Column) -> Column:
    """Error message of a check, null when it passes."""
    if kind == "non_negative":
        n = to_double(F.regexp_replace(value, "[,$]", ""))
        return F.when(n.isNull(), F.concat(F.lit("Value "), shown, F.lit(" is not a valid number"))) \
            .when(n < 0, F.concat(F.lit("Value "), shown, F.lit(" must be a non-negative number")))
    if kind == "not_stale":
        return F.when(F.datediff(as_of, parse_date(value)) > fixed.STALE_DAYS,
                      F.concat(F.lit("Effective date "), shown, F.lit(f" is more than {fixed.STALE_DAYS} days in the past")))
    if kind == "not_future":
        return F.when(parse_date(value) > as_of, F.concat(F.lit("Date "), shown, F.lit(" is in the future")))
    if kind == "email":
        return F.when((value != "") & ~strip(value).rlike(fixed.EMAIL_PATTERN),
                      F.concat(F.lit("Value "), shown, F.lit(" does not look like a valid email address")))
    if kind == "experience_mod":
        low, high = fixed.EXPERIENCE_MOD_RANGE
        return F.when(~to_double(value).between(low, high), F.concat(
            F.lit("Experience mod factor "), shown, F.lit(" is outside the normal range (0.50–3.00). Verify this value.")))
    if kind == "coinsurance":
        low, high = fixed.COINSURANCE_RANGE
        n = to_double(F.regexp_replace(strip(value), "%+$", ""))
        return F.when(~n.between(low, high), F.concat(
            F.lit("Coinsurance "), shown, F.lit("% is outside the normal range (50–100%)")))
    raise ValueError(kind)


def field_violations(assembled: DataFrame, as_of: str | None = None, rules=None) -> DataFrame:
    """All single-field rules in one projection: a field has at most one rule per type."""
    rules = fixed.FIELD_RULES if rules is None else rules
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    value, shown = F.col("value"), _shown(F.col("value"), F.col("is_text"))
    message, severity = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("string"))
    for name, kind, level, types in rules:
        applies = F.col("field_name") == name
        if types:
            applies = applies & F.col("document_type").isin(types)
        message = message.when(applies, _check(kind, value, shown, today))
        severity = severity.when(applies, F.lit(level))
    named = assembled.filter(F.col("field_name").isin([r[0] for r in rules])).filter("value is not null")
    checked = compute_once(named, _message=message)
    return checked.filter("_message is not null").select(
        "submission_id", F.lit("INVALID").alias("issue_type"), severity.alias("severity"), "field_name",
        F.concat(F.lit("Invalid Value: "), title_case("field_name")).alias("title"), F.col("_message").alias("description"),
        F.concat(F.lit("Verify the value for '"), "field_name", F.lit("' in the source document.")).alias("suggested_action"),
        "document_id")


# --- fields of one document -------------------------------------------------
def last_values(assembled: DataFrame) -> DataFrame:
    """Last value of each field of each document."""
    return assembled.groupBy("document_id", "submission_id", "document_type", "field_name").agg(
        F.max_by(F.struct("value", "is_zero"), F.col("field_ordinal")).alias("_last")).select(
        "submission_id", "document_id", "document_type", "field_name",
        F.col("_last.value").alias("value"), F.col("_last.is_zero").alias("is_zero"))


def document_facts(last: DataFrame) -> DataFrame:
    """One row per document with what the cross-field and missing-field rules read.

    ``present`` only collects names some rule requires, so it stays small.
    """
    def of(name: str, column: str = "value") -> Column:
        return F.max(F.when(F.col("field_name") == name, F.col(column)))
    wanted = sorted({r[2] for r in catalogue.rows() if r[5]})
    return last.groupBy("document_id", "submission_id", "document_type").agg(
        of("policy_effective_date").alias("effective"), of("policy_expiration_date").alias("expiration"),
        of("annual_revenue").alias("revenue"), of("annual_revenue", "is_zero").alias("revenue_is_zero"),
        of("employee_count").alias("employees"),
        F.collect_set(F.when(F.col("field_name").isin(wanted) & F.col("value").isNotNull(), F.col("field_name"))).alias("present"))


def _cross_field(facts: DataFrame, a: str, b: str, severity: str, message: Column) -> DataFrame:
    label = {n: n.replace("_", " ").title() for n in (a, b)}
    return facts.withColumn("_message", message).filter("_message is not null").select(
        "submission_id", F.lit("INVALID").alias("issue_type"), F.lit(severity).alias("severity"),
        F.lit(f"{a}/{b}").alias("field_name"), F.lit(f"Cross-Field Issue: {label[a]} vs {label[b]}").alias("title"),
        F.col("_message").alias("description"),
        F.lit("Verify both field values and correct any discrepancies.").alias("suggested_action"), "document_id")


def date_order_violations(facts: DataFrame) -> DataFrame:
    wrong = parse_date("expiration") <= parse_date("effective")
    message = F.when(wrong, F.concat(F.lit("Expiration date ("), "expiration", F.lit(") must be after effective date ("),
                                     "effective", F.lit(")")))
    return _cross_field(facts, "policy_effective_date", "policy_expiration_date", "ERROR", message)


def revenue_per_employee_violations(facts: DataFrame) -> DataFrame:
    low, high = fixed.REVENUE_PER_EMPLOYEE_RANGE
    staffed = facts.filter("document_type = 'ACORD_APPLICATION' and not coalesce(revenue_is_zero, false)") \
        .withColumn("_employees", to_double("employees")).filter("_employees > 0")
    ratio = parse_currency("revenue") / F.col("_employees")
    verdict = F.when(ratio < low, "low").when(ratio > high, "high")
    message = F.concat(F.lit("Revenue per employee ($"), F.format_number(ratio, 0), F.lit(") is unusually "), verdict,
                       F.lit(". Verify annual revenue and employee count."))
    return _cross_field(staffed, "annual_revenue", "employee_count", "WARNING", message)


# --- the same field in several documents ------------------------------------
KEYS = ["submission_id", "field_name"]


def comparable(assembled: DataFrame, include_raw_output: bool = False) -> DataFrame:
    """Values that are compared between documents."""
    ignored = fixed.IGNORED_FOR_CONFLICT + ([] if include_raw_output else [fixed.RAW_OUTPUT_FIELD])
    return assembled.filter(~F.col("is_absent") & ~F.col("field_name").isin(ignored)
                            & (F.col("confidence") >= fixed.CONFLICT_MIN_CONFIDENCE))


def conflict_candidates(assembled: DataFrame, include_raw_output: bool = False) -> DataFrame:
    """Comparable values with their number, date and normalised-text readings."""
    spaced = F.when(F.col("is_nested"), F.regexp_replace("value", "([,:])", "$1 ")).otherwise(F.col("value"))
    # a projection computes what the readings share (the stripped value) once, a generator would not
    read = comparable(assembled, include_raw_output).withColumn("_read", F.struct(to_number("value").alias("number"), parse_date("value").alias("day"), normalise_string(spaced).alias("norm")))
    return compute_once(read, **{c: F.col(f"_read.{c}") for c in ("number", "day", "norm")}).drop("_read")


KINDS = ["number", "date", "text"]


def _row_order(df: DataFrame) -> Column:
    """(document_id, field_ordinal) as one comparable value.

    For integral ids a decimal, which a hash aggregate can update in place; a
    struct would make every aggregate a sort.
    """
    if df.schema["document_id"].dataType.typeName() in ("long", "integer"):
        return (F.col("document_id").cast("decimal(20,0)") * F.lit(1_000_000).cast("decimal(7,0)") + F.col("field_ordinal")).cast("decimal(28,0)")
    return F.struct("document_id", "field_ordinal")


def conflict_texts(candidates: DataFrame) -> DataFrame:
    """Figures per group and distinct text: a hot group shrinks to its distinct texts on each mapper."""
    kind = F.when(F.col("number").isNotNull(), 0).when(F.col("day").isNotNull(), 1).otherwise(2)
    ordered = candidates.withColumns({"_order": _row_order(candidates), "_kind": kind})
    return ordered.groupBy(*KEYS, "norm").agg(
        F.count(F.lit(1)).alias("n"), F.min("_order").alias("first"), F.min_by("_kind", "_order").alias("kind"),
        F.min("number").alias("min_number"), F.max("number").alias("max_number"), F.count("number").alias("n_numbers"),
        F.min("day").alias("min_day"), F.max("day").alias("max_day"), F.count("day").alias("n_days"))


def conflict_groups(per_text: DataFrame) -> DataFrame:
    """Figures per group of at least two rows, with the kind of its first row. No list of rows is ever built."""
    has_text = F.col("norm") != ""
    groups = per_text.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.min_by("kind", "first").alias("_kind"),
        F.min("min_number").alias("min_number"), F.max("max_number").alias("max_number"), F.sum("n_numbers").alias("n_numbers"),
        F.min("min_day").alias("min_day"), F.max("max_day").alias("max_day"), F.sum("n_days").alias("n_days"),
        F.sum(F.when(has_text, F.col("n")).otherwise(0)).alias("n_texts"), F.count_if(has_text).alias("n_distinct"))
    names = F.array(*[F.lit(k) for k in KINDS])
    return groups.filter("n >= 2").withColumn("kind", F.get(names, F.col("_kind"))).drop("_kind")


# Rows without a document carry a null text: it takes the type of the ids they are united with, UUIDs included.
def _conflict(df: DataFrame, title: Column, description: Column, action: Column) -> DataFrame:
    return df.select("submission_id", F.lit("CONFLICT").alias("issue_type"), F.lit("ERROR").alias("severity"), "field_name",
                     title.alias("title"), description.alias("description"), action.alias("suggested_action"),
                     F.lit(None).cast("string").alias("document_id"))


def _titled(prefix: str) -> Column:
    return F.concat(F.lit(f"Conflicting {prefix} for '"), title_case("field_name"), F.lit("'"))


def figure_conflicts(groups: DataFrame, kinds: tuple[str, ...] = ("number", "date")) -> DataFrame:
    """Numbers more than 5 % apart and dates more than 7 days apart, in one pass over the groups."""
    low, high, name = F.col("min_number"), F.col("max_number"), F.col("field_name")
    relative = F.abs(high - low) / F.greatest(F.abs(low), F.abs(high), F.lit(1e-9))
    numeric = (F.col("kind") == "number") & (F.col("n_numbers") >= 2) & (relative > fixed.NUMERIC_TOLERANCE)
    dated = (F.col("kind") == "date") & (F.col("n_days") >= 2) & (F.col("_span") > fixed.DATE_TOLERANCE_DAYS)
    found = groups.filter(F.col("kind").isin(*kinds)).withColumn("_span", F.datediff("max_day", "min_day")).filter(numeric | dated)
    by_number = F.col("kind") == "number"
    range_text = F.concat(F.lit("Documents report different values for '"), name, F.lit("'. Range: "), F.format_number(low, 2), F.lit(" – "),
                          F.format_number(high, 2), F.lit(" ("), fixed_point(relative * 100, 1), F.lit("% difference)."))
    span_text = F.concat(F.lit("Documents show different dates for '"), name, F.lit("'. Dates span "), F.col("_span").cast("string"),
                         F.lit(" days: "), F.col("min_day").cast("string"), F.lit(" – "), F.col("max_day").cast("string"), F.lit("."))
    ask_number = F.concat(F.lit("Review all documents and confirm the correct value for '"), name, F.lit("'. Contact the broker for clarification."))
    ask_date = F.concat(F.lit("Confirm the correct "), F.replace(name, F.lit("_"), F.lit(" ")), F.lit(" with the broker."))
    return _conflict(found, F.when(by_number, _titled("values")).otherwise(_titled("dates")),
                     F.when(by_number, range_text).otherwise(span_text), F.when(by_number, ask_number).otherwise(ask_date))


def numeric_conflicts(groups: DataFrame) -> DataFrame:
    return figure_conflicts(groups, ("number",))


def date_conflicts(groups: DataFrame) -> DataFrame:
    return figure_conflicts(groups, ("date",))


def text_conflicts(per_text: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups whose sorted distinct texts have two unlike neighbours.

    The Arrow UDF sees only neighbouring pairs of groups that disagree at all.
    """
    open_groups = groups.filter("kind = 'text' and n_texts >= 2 and n_distinct > 1").select(*KEYS)
    texts = per_text.filter("norm <> ''").select(*KEYS, "norm").join(open_groups, KEYS)
    pairs = next_within(texts, KEYS, ["norm"], "norm", "_next")
    unlike = pairs.filter("_next is not null").withColumn("_ratio", sequence_ratio("norm", "_next")) \
        .groupBy(*KEYS).agg(F.min("_ratio").alias("_least")).filter(F.col("_least") < fixed.SIMILAR_RATIO).select(*KEYS)
    quoted = texts.withColumn("_shown", _shown(F.col("norm"), F.lit(True)))
    shown = smallest(quoted, KEYS, "norm", "_shown", 4)
    found = unlike.join(shown, KEYS)
    name = F.col("field_name")
    return _conflict(
        found, _titled("information"),
        F.concat(F.lit("Documents provide different values for '"), name, F.lit("': "), F.array_join("_few", ", "), F.lit(".")),
        F.concat(F.lit("Verify the correct value for '"), name, F.lit("' with the broker.")))


def smallest(df: DataFrame, keys: list[str], by: str, shown: str, k: int) -> DataFrame:
    """``shown`` of the k smallest ``by`` per group; Spark limits the groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(by)
    few = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("_rank", F.col(shown).alias("text"))))
    return few.groupBy(*keys).agg(F.transform(ordered, lambda x: x.text).alias("_few"))


def conflict_members(candidates: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Documents of each conflict: last value per document, and how many rows it had."""
    involved = candidates.join(conflicts.select(*KEYS).hint("merge"), KEYS, "left_semi")  # conflicts look smaller to Spark than they are
    return involved.groupBy(*KEYS, "document_id").agg(
        F.max_by("value", "field_ordinal").alias("value"), F.count(F.lit(1)).alias("occurrences"))


# --- missing fields and forms -----------------------------------------------
def missing_everywhere(submissions: DataFrame, facts: DataFrame) -> DataFrame:
    """Globally required fields that no document of a submission has."""
    has = [F.max(F.array_contains("present", n)).alias(f"_has_{n}") for n in fixed.GLOBALLY_REQUIRED]
    per_submission = facts.groupBy("submission_id").agg(*has)
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(f"_has_{n}", F.lit(False)), F.lit(n)) for n in fixed.GLOBALLY_REQUIRED]))
    rows = submissions.select("submission_id").join(per_submission, "submission_id", "left").select(
        "submission_id", F.explode(missing).alias("field_name"))
    label = title_case("field_name")
    return rows.select(
        "submission_id", F.lit("MISSING").alias("issue_type"), F.lit("ERROR").alias("severity"), "field_name",
        F.concat(F.lit("Required Field Missing: "), label).alias("title"),
        F.concat(F.lit("'"), label, F.lit("' was not found in any document in this submission. "
                                          "This field is required for underwriting.")).alias("description"),
        F.concat(F.lit("Request the "), label, F.lit(" from the broker.")).alias("suggested_action"),
        F.lit(None).cast("string").alias("document_id"))


def _lacking(facts: DataFrame) -> DataFrame:
    """(submission_id, document_id, document_type, f): catalogue rows that a document's type requires and the document lacks."""
    wanted = F.filter(catalogue.required_by_type(F.col("document_type"), fixed.GLOBALLY_REQUIRED),
                      lambda r: ~F.array_contains("present", r["name"]))
    return facts.select("submission_id", "document_id", "document_type", F.explode(wanted).alias("f"))


def _lacking_shown(rows: DataFrame) -> DataFrame:
    label = F.col("f.label")
    return rows.select(
        "submission_id", F.lit("MISSING").alias("issue_type"), F.lit("WARNING").alias("severity"), F.col("f.name").alias("field_name"),
        F.concat(F.lit("Required Field Missing: "), label).alias("title"),
        F.rtrim(F.concat(F.lit("'"), label, F.lit("' was not found in document (type: "), "document_type", F.lit("). "),
                         F.col("f.description"))).alias("description"),
        F.concat(F.lit("Request the '"), label, F.lit("' from the broker or locate it in the submitted documents.")).alias("suggested_action"),
        "document_id")


def missing_in_documents(facts: DataFrame) -> DataFrame:
    """Fields a document's type requires and the document lacks."""
    return _lacking_shown(_lacking(facts))


def missing_once(facts: DataFrame) -> DataFrame:
    """``deduplicate(missing_in_documents(facts))``; texts are made of the rows that stay."""
    first = _lacking(facts).groupBy("submission_id", F.col("f.name").alias("name"), F.col("f.label").alias("label")).agg(
        F.min(F.struct("document_id", "document_type", "f.description")).alias("d"))
    return _lacking_shown(first.select("submission_id", "d.document_id", "d.document_type", F.struct("name", "label", "d.description").alias("f")))


def deduplicate(violations: DataFrame) -> DataFrame:
    """One row per (submission, type, field, title): the one of the first document."""
    keys = ["submission_id", "issue_type", "field_name", "title"]
    rest = [c for c in VIOLATION if c not in keys]
    return violations.groupBy(*keys).agg(F.min(F.struct("document_id", *[c for c in rest if c != "document_id"])).alias("_first")) \
        .select(*keys, "_first.*").select(*VIOLATION)


def present_types(documents: DataFrame) -> DataFrame:
    """Types of a submission's current documents: at most 14 values each."""
    valid = F.when(F.col("document_type").isin(fixed.DOCUMENT_TYPES), F.col("document_type"))
    return documents.filter("is_current_version").groupBy("submission_id").agg(F.collect_set(valid).alias("types"))


def lines_requested(assembled: DataFrame) -> DataFrame:
    """Coverage lines of the first application that states any: one row per line."""
    stated = assembled.filter("document_type = 'ACORD_APPLICATION' and field_name = 'lines_requested' and not is_absent")
    first = stated.groupBy("submission_id").agg(F.min_by(
        F.struct("value", "is_nested"), F.struct("document_id", "field_ordinal")).alias("s"))
    listed = F.when(F.col("s.is_nested") & F.col("s.value").startswith("["), F.from_json("s.value", "array<string>")) \
        .when(F.col("s.value") != "", F.array("s.value"))
    return first.select("submission_id", F.explode(listed).alias("line"))


def missing_forms(lines: DataFrame, types: DataFrame) -> DataFrame:
    """Requested coverage lines without their form."""
    expected = F.create_map(*[F.lit(x) for pair in fixed.COVERAGE_FORM.items() for x in pair])
    wanted = lines.withColumn("_form", F.element_at(expected, strip(F.lower("line")))).filter("_form is not null")
    lacking = wanted.join(types, "submission_id", "left").filter(~F.coalesce(F.array_contains("types", F.col("_form")), F.lit(False)))
    return lacking.select(
        "submission_id", F.lit("MISSING").alias("issue_type"), F.lit("WARNING").alias("severity"),
        F.lit(None).cast("string").alias("field_name"),
        F.concat(F.lit("Missing Form for Requested Coverage: "), "line").alias("title"),
        F.concat(F.lit("Coverage '"), "line", F.lit("' was requested but the corresponding form ("), "_form",
                 F.lit(") was not found in the submission.")).alias("description"),
        F.concat(F.lit("Request the "), title_case("_form"), F.lit(" form from the broker.")).alias("suggested_action"),
        F.lit(None).cast("string").alias("document_id"))


SUBMISSION_RULES = [
    ("ACORD 125 Application Not Found",
     "No ACORD 125 Commercial Lines Application was identified in this submission. "
     "ACORD 125 is the primary application form required for commercial underwriting.",
     "Request the ACORD 125 form from the broker before proceeding."),
    ("Loss Run Report Not Provided",
     "A loss run report was not found in this submission. Loss runs are required to evaluate prior claims history.",
     "Request 3-5 years of loss run reports from the broker."),
]


def submission_rule_violations(submissions: DataFrame, types: DataFrame) -> DataFrame:
    """No application at all; a coverage form without a loss run."""
    has = submissions.select("submission_id").join(types, "submission_id", "left") \
        .withColumn("types", F.coalesce("types", F.expr("cast(array() as array<string>)")))
    triggers = F.array(*[F.lit(x) for x in fixed.LOSS_RUN_TRIGGER_TYPES])
    broken = [~F.array_contains("types", "ACORD_APPLICATION"),
              F.arrays_overlap("types", triggers) & ~F.array_contains("types", "LOSS_RUN")]
    texts = [F.struct(*[F.lit(x).alias(n) for x, n in zip(rule, ("title", "description", "suggested_action"))]) for rule in SUBMISSION_RULES]
    found = F.array_compact(F.array(*[F.when(b, t) for b, t in zip(broken, texts)]))
    return has.select("submission_id", F.explode(found).alias("r")).select(
        "submission_id", F.lit("MISSING").alias("issue_type"), F.lit("WARNING").alias("severity"),
        F.lit(None).cast("string").alias("field_name"), "r.*", F.lit(None).cast("string").alias("document_id"))


# --- issues -----------------------------------------------------------------
def report_counts(submissions: DataFrame, violations: DataFrame) -> DataFrame:
    counts = violations.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("total_issues"), F.count_if(F.col("severity") == "ERROR").alias("error_count"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_count"),
        *[F.count_if(F.col("issue_type") == t.upper()).alias(f"{t}_count") for t in ("conflict", "missing", "invalid")])
    names = [c for c in counts.columns if c != "submission_id"]
    return submissions.select("submission_id").join(counts, "submission_id", "left").fillna(0, names)


def refresh_issues(issues: DataFrame, violations: DataFrame, validated: DataFrame, title_chars: int | None = None,
                   description_chars: int | None = None, action_chars: int | None = None) -> DataFrame:
    """Unresolved issues of validated submissions give way to the new violations; resolved ones stay."""
    marked = validated.select("submission_id").distinct().withColumn("_validated", F.lit(True))
    kept = issues.join(marked, "submission_id", "left").filter(F.col("is_resolved") | F.col("_validated").isNull()).drop("_validated")
    fresh = violations.select(
        "submission_id", "issue_type", "severity", "field_name", limited("title", title_chars).alias("title"),
        limited("description", description_chars).alias("description"),
        limited("suggested_action", action_chars).alias("suggested_action"), "document_id",
        F.lit(False).alias("is_resolved"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def advance_status(submissions: DataFrame, report: DataFrame) -> DataFrame:
    """READY_FOR_REVIEW without errors, else VALIDATING_DATA; unvalidated submissions keep their status."""
    errors = report.select("submission_id", "error_count")
    return submissions.join(errors, "submission_id", "left").withColumn(
        "status", F.when(F.col("error_count").isNull(), F.col("status"))
        .when(F.col("error_count") == 0, "READY_FOR_REVIEW").otherwise("VALIDATING_DATA")).drop("error_count")


def issue_summary(issues: DataFrame) -> DataFrame:
    open_ = ~F.col("is_resolved")
    return issues.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("total_issues"), F.count_if(open_).alias("unresolved"), F.count_if("is_resolved").alias("resolved"),
        F.count_if(open_ & (F.col("severity") == "ERROR")).alias("errors"),
        F.count_if(open_ & (F.col("severity") == "WARNING")).alias("warnings"),
        F.count_if(open_ & (F.col("issue_type") == "CONFLICT")).alias("conflicts"),
        F.count_if(open_ & (F.col("issue_type") == "MISSING")).alias("missing"),
        F.count_if(open_ & (F.col("issue_type") == "INVALID")).alias("invalid"))


def issues_in_order(issues: DataFrame) -> DataFrame:
    """By submission, severity, type, newest first: a range-partitioned sort."""
    return issues.orderBy("submission_id", "severity", "issue_type", F.col("created_at").desc(), "issue_id")


def resolve_issues(issues: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated issues, rejected resolutions with reason).

    ``resolutions``: issue_id, submission_id, resolution_note, resolved_by, resolved_at.
    """
    keys = ["submission_id", "issue_id"]
    long_enough = F.coalesce(F.length("resolution_note") >= fixed.MIN_REASON_CHARS, F.lit(False))
    good = resolutions.filter(long_enough).select(*keys, "resolution_note", "resolved_by", "resolved_at")
    updated = issues.join(good, keys, "left").withColumn("is_resolved", F.col("is_resolved") | F.col("resolved_by").isNotNull())
    known = issues.select(*keys).withColumn("_known", F.lit(True))
    rejected = resolutions.join(known, keys, "left").withColumn(
        "reject_reason", F.when(~long_enough, "note too short").when(F.col("_known").isNull(), "issue not found")) \
        .filter("reject_reason is not null").drop("_known")
    return updated, rejected
