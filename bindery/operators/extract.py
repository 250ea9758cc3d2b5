"""Requests for, and field rows from, offline extraction; overrides and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindery import fixed
from bindery.functions.barrier import compute_once
from bindery.functions.jsontext import is_object, strip_fences
from bindery.functions.text import limited, title_case
from bindery.functions.values import unwrap
from bindery.operators import catalogue, guardrails

EXTRACTION_TEMPLATE = (
    "Extract the fields below from this {document_type} document.\n{guidelines}\n"
    "FIELDS TO EXTRACT:\n{field_list}\n\n"
    "For every field give its value, the exact text that supports it and your confidence; say so if a required field "
    "is absent.\n\n{document_text}")


# --- requests ---------------------------------------------------------------
def field_list(spark_table: DataFrame) -> DataFrame:
    """One text per type: ``- label (name): description [REQUIRED]`` lines in catalogue order."""
    line = F.concat(F.lit("- "), "label", F.lit(" ("), "field_name", F.lit(")"),
                    F.when(F.col("description") != "", F.concat(F.lit(": "), "description")).otherwise(""),
                    F.when(F.col("required"), " [REQUIRED]").otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))
    return spark_table.groupBy("document_type").agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("field_list"))


def fill(template: Column, **values: Column) -> Column:
    """Replaces ``${name}`` and ``{name}`` by the values, each value inserted once and not re-read.

    Placeholders are first turned into marks no text contains, so a value that
    happens to hold ``{other_name}`` stays as it is.
    """
    marked = template
    for i, name in enumerate(values):
        mark = f"\ue000{i}\ue001"
        marked = F.replace(F.replace(marked, F.lit("${" + name + "}"), F.lit(mark)), F.lit("{" + name + "}"), F.lit(mark))
    pieces = F.split(marked, "[\ue000\ue001]")
    # pieces alternate between text and the number of a value
    chosen = F.array(*[F.coalesce(v, F.lit("")) for v in values.values()])
    return F.array_join(F.transform(pieces, lambda p, i: F.when(
        (i % 2 == 1), F.get(chosen, p.try_cast("int"))).otherwise(p)), "")


def extraction_requests(documents: DataFrame, fields: DataFrame, max_tokens: int, context: DataFrame | None = None,
                        template: str = EXTRACTION_TEMPLATE, text: str = "text") -> DataFrame:
    """Default extraction request per document: sanitised prompt and its audit copy.

    ``documents``: document_id, document_type, text. ``context``: document_id,
    guidelines. Prompts with an injection phrase come out flagged, without text.
    """
    lists = field_list(fields)          # 12 rows of the fixed catalogue
    joined = documents.join(F.broadcast(lists), "document_type", "left")
    if context is not None:
        joined = joined.join(context, "document_id", "left")
    guidelines = F.col("guidelines") if context is not None else F.lit(None).cast("string")
    prompt = fill(F.lit(template), document_type=title_case("document_type"),
                  guidelines=F.when(guidelines != "", F.concat(F.lit("UNDERWRITING GUIDELINES (from knowledge base):\n"), guidelines, F.lit("\n"))),
                  field_list=F.coalesce("field_list", F.lit("Extract all relevant insurance information.")),
                  document_text=F.col(text))
    built = compute_once(joined, prompt=prompt).select(
        "document_id", "document_type", "prompt", F.col("prompt").alias("prompt_used"))
    return guardrails.sanitise_input(built, max_tokens, "prompt").select(
        "document_id", "document_type", "prompt", "prompt_used", "injection_pattern", "pii_redactions", "was_truncated")


def prompt_requests(documents: DataFrame, template: str, text: str = "text") -> DataFrame:
    """Request with a caller's own prompt; the text is appended where it has no placeholder."""
    if "{document_text}" in template:
        prompt = F.replace(F.lit(template), F.lit("{document_text}"), F.col(text))
    else:
        prompt = F.concat(F.lit(template + "\n\nDOCUMENT TEXT:\n<document_text>\n"), F.col(text), F.lit("\n</document_text>"))
    return documents.select("document_id", prompt.alias("prompt"))


TEMPLATE_NAMES = {"ACORD_APPLICATION", "ACORD_GL", "ACORD_PROPERTY", "ACORD_AUTO", "ACORD_WORKERS_COMP", "ACORD_UMBRELLA",
                  "LOSS_RUN", "FINANCIAL_STATEMENT", "BROKER_EMAIL"}
NO_CONTEXT = "No guideline context available."


def fill_templates(documents: DataFrame, templates: DataFrame, **values: Column) -> DataFrame:
    """Type-specific template (template_name, template), else the one called ``generic``.

    The template table holds one row per type and is small by nature; it is
    joined without a hint.
    """
    named = templates.select(F.col("template_name").alias("_name"), F.col("template").alias("_own"))
    generic = templates.filter("template_name = 'generic'").agg(F.max("template").alias("t")).scalar()
    joined = documents.join(named, F.lower("document_type") == F.col("_name"), "left").withColumn("_generic", generic)
    return joined.select(*documents.columns, fill(F.coalesce("_own", "_generic"), **values).alias("prompt"))


def fill_guarded(documents: DataFrame, template: str, max_tokens: int, text: str = "document_text", **values: Column) -> DataFrame:
    """Summaries and score explanations: ``text`` is sanitised before it goes into the template, the other values are not.

    Flagged texts leave the prompt null; the guardrail columns say why.
    """
    safe = guardrails.sanitise_input(documents, max_tokens, text)
    prompt = fill(F.lit(template), **{text: F.col(text)}, **values)
    return safe.withColumn("prompt", F.when(F.col("injection_pattern").isNull(), prompt))


# --- responses --------------------------------------------------------------
def parse_responses(responses: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Adds ``json_text``: the fence-free JSON of any kind, null when it is none."""
    text = strip_fences(raw)
    return compute_once(responses, _text=text).withColumn(
        "json_text", F.when(F.try_parse_json("_text").isNotNull(), F.col("_text"))).drop("_text")


def field_rows(responses: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Raw-output row per response, and one row per top-level key of JSON objects."""
    parsed = parse_responses(responses, raw)
    raw_rows = parsed.select(
        "submission_id", "document_id", F.lit(fixed.RAW_OUTPUT_FIELD).alias("field_name"), F.lit(fixed.RAW_OUTPUT_LABEL).alias("field_label"),
        F.to_json(F.struct(F.col(raw).alias("raw"))).alias("field_value"), F.lit(fixed.RAW_CONFIDENCE).alias("confidence"))
    objects = parsed.filter(is_object("json_text")).withColumn("_v", F.parse_json("json_text"))
    exploded = objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(
        "submission_id", "document_id", "key", "value")
    value = F.to_json("value")
    wrapped = F.when(F.schema_of_variant("value").startswith("OBJECT"), value).otherwise(
        F.concat(F.lit('{"value":'), F.coalesce(value, F.lit("null")), F.lit("}")))
    keys = exploded.filter(F.col("key") != fixed.RAW_OUTPUT_FIELD).select(
        "submission_id", "document_id", F.col("key").alias("field_name"), title_case("key").alias("field_label"),
        wrapped.alias("field_value"), F.lit(fixed.KEY_CONFIDENCE).alias("confidence"))
    return raw_rows.unionByName(keys)


def output_evidence(responses: DataFrame, prompts: DataFrame, prompt_chars: int | None = None) -> DataFrame:
    """Evidence row of each response: its prompt, no page."""
    used = prompts.select("document_id", limited("prompt_used", prompt_chars).alias("source_text"))
    return responses.select("submission_id", "document_id").join(used, "document_id", "left").select(
        "submission_id", "document_id", F.lit(fixed.RAW_OUTPUT_FIELD).alias("field_name"), F.lit(None).cast("int").alias("page_number"),
        F.lit(None).cast("string").alias("section"), "source_text", F.lit(True).alias("is_active"))


def replace_fields(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Re-run: fields of re-extracted documents give way to the fresh ones."""
    redone = fresh.select("document_id").distinct()
    return existing.join(redone, "document_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def retire_evidence(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Re-run: old evidence of re-extracted documents stays but is inactive; fresh is appended."""
    redone = fresh.select("document_id").distinct().withColumn("_redone", F.lit(True))
    old = existing.join(redone, "document_id", "left").withColumn(
        "is_active", F.col("is_active") & F.col("_redone").isNull()).drop("_redone")
    return old.unionByName(fresh, allowMissingColumns=True)


def fill_applicant(submissions: DataFrame, fields: DataFrame, name_chars: int | None = None) -> DataFrame:
    """A missing applicant_name is filled from the first document naming one, by key priority."""
    priority = F.array_position(F.array(*[F.lit(k) for k in fixed.APPLICANT_KEYS]), F.col("field_name"))
    named = fields.filter(F.col("field_name").isin(fixed.APPLICANT_KEYS)).withColumn("_value", unwrap("field_value")) \
        .filter("_value is not null and _value <> ''")
    best = named.groupBy("submission_id").agg(
        F.min_by(limited("_value", name_chars), F.struct("document_id", priority)).alias("_found"))
    return submissions.join(best, "submission_id", "left").withColumn(
        "applicant_name", F.coalesce("applicant_name", "_found")).drop("_found")


def eligible_documents(documents: DataFrame, custom_prompt: bool = False) -> DataFrame:
    """Current documents extraction applies to."""
    ready = documents.filter("is_current_version and processing_status <> 'FAILED'")
    if custom_prompt:
        return ready
    return ready.filter(F.col("document_type").isNotNull() & ~F.col("document_type").isin(fixed.NO_FIELD_TYPES))


def apply_overrides(fields: DataFrame, overrides: DataFrame, keys: list[str], order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(fields with effective_value, overrides that do not count, with ``why``). A reason needs 10 characters.

    Of several justified overrides of a field the newest counts, by ``order``
    (default: the reason and the value, so that the choice is always the same);
    ``why`` is ``reason too short`` or ``superseded``.
    """
    justified = F.coalesce(F.length("override_reason") >= fixed.MIN_REASON_CHARS, F.lit(False))
    at = F.struct(*(order or []), "override_reason", "override_value")
    newest = overrides.filter(justified).groupBy(*keys).agg(F.max(F.struct(at.alias("at"), "override_value", "override_reason")).alias("_o"))
    good = newest.select(*keys, "_o.override_value", "_o.override_reason", F.lit(True).alias("_overridden"))
    joined = fields.join(good, keys, "left").withColumn("is_overridden", F.coalesce("_overridden", F.lit(False))).drop("_overridden")
    effective = joined.withColumn("effective_value", F.when(F.col("is_overridden"), F.col("override_value")).otherwise(F.col("field_value")))
    late = overrides.filter(justified).join(newest.select(*keys, F.col("_o.at").alias("_at")), keys).filter(~at.eqNullSafe(F.col("_at"))).drop("_at")
    return effective, overrides.filter(~justified).withColumn("why", F.lit("reason too short")).unionByName(
        late.withColumn("why", F.lit("superseded")).select(*overrides.columns, "why"))


def extraction_summary(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """Per document: fields found, fields attempted and required fields not found.

    Found names are reduced to the catalogue's before they are collected, so a
    document contributes at most one short list.
    """
    spark = documents.sparkSession
    wanted = catalogue.table(spark).groupBy("document_type").agg(
        F.collect_list("field_name").alias("names"), F.sort_array(F.collect_list(F.when(F.col("required"), F.col("field_name")))).alias("required"))
    known = sorted({r[2] for r in catalogue.rows()})
    filled = fields.filter(F.col("field_name").isin(known)).withColumn("_value", unwrap("field_value")).filter("_value is not null")
    found = filled.groupBy("document_id").agg(F.collect_set("field_name").alias("found"))
    empty = F.expr("cast(array() as array<string>)")
    joined = documents.select("document_id", "document_type").filter("document_type is not null") \
        .join(F.broadcast(wanted), "document_type", "left").join(found, "document_id", "left") \
        .withColumns({c: F.coalesce(c, empty) for c in ("names", "required", "found")})
    return joined.select("document_id", "document_type", F.size(F.array_intersect("names", "found")).alias("fields_found"),
                         F.size("names").alias("fields_attempted"), F.array_except("required", "found").alias("missing_fields"))
