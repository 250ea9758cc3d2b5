"""Screening and redaction of texts before, and of responses after, a model call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from bindery import fixed
from bindery.functions.barrier import compute_once
from bindery.functions.jsontext import object_keys, strip_fences
from bindery.functions.text import first_match_sql, is_blank, unicode_pattern


def scan_injection(df: DataFrame, text: str = "text", out: str = "injection_pattern") -> DataFrame:
    """Adds the number of the first injection pattern found (null: none)."""
    lowered = compute_once(df, _lowered=F.lower(F.col(text)))
    return compute_once(lowered, **{out: F.expr(first_match_sql(f"`{text}`", "_lowered", fixed.INJECTION_PATTERNS))}) \
        .drop("_lowered")


def scan_injection_head(df: DataFrame, text: str = "text", out: str = "injection_pattern") -> DataFrame:
    """The narrower scan used before classification: six patterns, first 2 000 characters."""
    head = F.substring(F.col(text), 1, fixed.SECOND_OPINION_CHARS)
    staged = compute_once(df, _head=head, _lowered=F.lower(head))
    return compute_once(staged, **{out: F.expr(first_match_sql("_head", "_lowered", fixed.SHORT_INJECTION_PATTERNS))}) \
        .drop("_head", "_lowered")


def split_flagged(scanned: DataFrame, flag: str = "injection_pattern") -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows)."""
    return scanned.filter(F.col(flag).isNull()).drop(flag), scanned.filter(F.col(flag).isNotNull())


def redact_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Redacts in pattern order; each count is taken on the text as redacted so far."""
    names = []
    for name, pattern, replacement, ignore_case in fixed.PII_PATTERNS:
        p = unicode_pattern(pattern, ignore_case)
        found = F.regexp_count(F.col(text), F.lit(p))
        df = compute_once(df, **{f"n_{name}": found})
        df = compute_once(df, **{text: F.when(F.col(f"n_{name}") > 0, F.regexp_replace(text, p, replacement))
                                 .otherwise(F.col(text))})
        names.append(f"n_{name}")
    return df.withColumn("pii_redactions", sum((F.col(n) for n in names[1:]), F.col(names[0])))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / fixed.CHARS_PER_TOKEN).cast("int"))


def enforce_token_budget(df: DataFrame, max_tokens: int, text: str = "text") -> DataFrame:
    """Cuts the middle out of texts over the budget, keeping 70 % head and 30 % tail."""
    if max_tokens <= fixed.RESERVED_TOKENS:
        raise ValueError(f"max_tokens must exceed {fixed.RESERVED_TOKENS}")
    available = (max_tokens - fixed.RESERVED_TOKENS) * fixed.CHARS_PER_TOKEN
    head, tail = int(available * 0.70), int(available * 0.30)
    over = F.length(text) > available
    cut = F.concat(F.substring(text, 1, head), F.lit(fixed.TRUNCATION_MARKER),
                   F.right(F.col(text), F.lit(tail)) if tail else F.col(text))
    return df.withColumn("was_truncated", over).withColumn(text, F.when(F.col("was_truncated"), cut).otherwise(F.col(text)))


def sanitise_input(df: DataFrame, max_tokens: int, text: str = "text") -> DataFrame:
    """Injection scan, redaction and budget. Flagged rows keep their flag and get no text."""
    flagged = F.col("injection_pattern").isNotNull()
    return (df.transform(scan_injection, text)
            .transform(redact_pii, text)
            .transform(enforce_token_budget, max_tokens, text)
            .withColumn(text, F.when(~flagged, F.col(text))))


def check_output(df: DataFrame, content: str = "raw_response", expect_json: bool = False) -> DataFrame:
    """Forbidden patterns -> violations, length cap, optional JSON check, passed flag.

    The response is capped as downstream columns expect; ``full_<content>`` keeps it whole.
    """
    c = F.col(content)
    found = [F.when(c.rlike(unicode_pattern(p, True)), F.lit(f"Forbidden pattern in LLM output: {p[:60]}"))
             for p in fixed.FORBIDDEN_OUTPUT_PATTERNS]
    capped = F.substring(c, 1, fixed.MAX_OUTPUT_CHARS)
    if expect_json:
        found.append(F.when(~is_blank(capped) & F.try_parse_json(capped).isNull(), "LLM returned invalid JSON"))
    return (df.withColumn("violations", F.array_compact(F.array(*found)))
            .withColumn("was_truncated", F.length(content) > fixed.MAX_OUTPUT_CHARS)
            .withColumns({f"full_{content}": c, content: capped})
            .withColumn("passed", F.size("violations") == 0))


def validate_json(df: DataFrame, required: list[str], content: str = "raw_response") -> DataFrame:
    """status: ok, not_json, not_object or missing_keys, with the list of missing keys."""
    text = strip_fences(content)
    keys = object_keys(F.col("_json"))
    missing = F.array_except(F.array(*[F.lit(k) for k in required]), keys)
    return (df.withColumn("_json", text)
            .withColumn("missing_keys", F.when(keys.isNotNull(), missing))
            .withColumn("status", F.when(F.try_parse_json("_json").isNull(), "not_json")
                        .when(F.col("missing_keys").isNull(), "not_object")
                        .when(F.size("missing_keys") > 0, "missing_keys").otherwise("ok"))
            .drop("_json"))


def with_disclaimer(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, F.concat(F.lit(fixed.DISCLAIMER), F.col(text)))


def guardrail_report(sanitised: DataFrame, by: str = "source") -> DataFrame:
    return sanitised.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(F.col("injection_pattern").isNotNull()).alias("n_flagged"),
        F.count_if((F.col("pii_redactions") > 0)).alias("n_redacted"),
        F.sum("pii_redactions").cast("long").alias("total_redactions"),
        F.count_if("was_truncated").alias("n_truncated"))


# --- typed schema of a whole extraction response ----------------------------
TEXT_KEYS = ["company_name", "dba_name", "business_type", "industry", "business_operations", "effective_date",
             "expiration_date", "primary_contact_name", "primary_contact_email", "primary_contact_phone",
             "mailing_address", "extraction_notes"]
WHOLE_KEYS = ["years_in_business", "employee_count", "location_count"]
LIST_KEYS = ["requested_coverages", "missing_fields"]
UUID = r"^(urn:uuid:)?\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"


def validate_schema(df: DataFrame, content: str = "raw_response") -> DataFrame:
    """Checks a response against the extraction schema.

    Adds ``schema_errors`` (key: what is wrong), ``is_valid`` and the typed
    columns; unknown keys are ignored and absent keys are null.
    """
    v, text = F.col("_v"), F.col("_json")

    def raw(key: str) -> Column:
        return F.try_variant_get(v, f"$.{key}", "variant")

    def kind(key: str) -> Column:
        return F.coalesce(F.schema_of_variant(raw(key)), F.lit("VOID"))

    def number(key: str) -> Column:
        return F.try_variant_get(v, f"$.{key}", "double")

    errors = [F.when(object_keys(text).isNull(), "response: not an object")]
    errors.append(F.when(~F.coalesce(F.try_variant_get(v, "$.submission_id", "string").rlike(UUID), F.lit(False)),
                         "submission_id: uuid required"))
    for key in TEXT_KEYS:
        errors.append(F.when(~kind(key).isin("STRING", "VOID"), f"{key}: string expected"))
    for key in WHOLE_KEYS:
        whole = number(key).isNotNull() & (number(key) == F.floor(number(key)))
        errors.append(F.when((kind(key) != "VOID") & ~F.coalesce(whole, F.lit(False)), f"{key}: integer expected"))
        if key != "years_in_business":
            errors.append(F.when(number(key) < 0, f"{key}: must be >= 0"))
    errors.append(F.when((kind("annual_revenue") != "VOID") & number("annual_revenue").isNull(),
                         "annual_revenue: number expected"))
    errors.append(F.when(raw("confidence").isNotNull() & number("confidence").isNull(), "confidence: number expected"))
    errors.append(F.when(~number("confidence").between(0, 1), "confidence: must be between 0 and 1"))
    for key in LIST_KEYS:
        errors.append(F.when(raw(key).isNotNull() & ~kind(key).isin("ARRAY<STRING>", "ARRAY<VOID>"),
                             f"{key}: list of strings expected"))
    checked = (df.withColumn("_json", strip_fences(content)).withColumn("_v", F.try_parse_json("_json"))
               .withColumn("schema_errors", F.array_compact(F.array(*errors))))
    good = F.size("schema_errors") == 0
    typed = [F.when(good, F.try_variant_get(v, f"$.{k}", "string")).alias(k) for k in ["submission_id", *TEXT_KEYS]]
    typed += [F.when(good, F.try_variant_get(v, f"$.{k}", "long")).alias(k) for k in WHOLE_KEYS]
    typed += [F.when(good, number("annual_revenue")).alias("annual_revenue"),
              F.when(good, F.coalesce(number("confidence"), F.lit(0.0))).alias("confidence")]
    typed += [F.when(good, F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"),
                                      F.array().cast(T.ArrayType(T.StringType())))).alias(k) for k in LIST_KEYS]
    kept = [c for c in df.columns if c not in {"submission_id"}]
    keep_id = [F.col("submission_id").alias("source_submission_id")] if "submission_id" in df.columns else []
    return checked.select(*kept, *keep_id, "schema_errors", good.alias("is_valid"), *typed)
