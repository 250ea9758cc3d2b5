"""From landed files and parsed pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery import fixed
from bindery.functions.barrier import compute_once
from bindery.functions.text import clean_text, is_blank, limited, lower_extension, strip

EMPTY = "cast(array() as array<string>)"


# --- admission --------------------------------------------------------------
def admit(uploads: DataFrame) -> DataFrame:
    """Adds ``extension`` and ``reject_reason`` (null: accepted).

    ``uploads``: upload_id, submission_id, uploaded_at, filename, size_bytes and,
    if the content is to be judged too, mime_type (see ``resolve_mime``).
    The count limit is checked first and counts the distinct filenames accepted
    before: once 20 are in, every later upload of the submission is refused.
    """
    base = F.substring_index(F.regexp_replace("filename", "/+$", ""), "/", -1)
    extension = lower_extension(base)
    own_fault = (F.when(is_blank("filename"), "empty filename")
                 .when(~base.contains("."), "no extension")
                 .when(~extension.isin(fixed.ALLOWED_EXTENSIONS), "extension not allowed")
                 .when(F.col("size_bytes") > fixed.MAX_UPLOAD_BYTES, "file too large")
                 .when(F.col("size_bytes") == 0, "file is empty"))
    if "mime_type" in uploads.columns:
        own_fault = own_fault.when(~F.coalesce(F.col("mime_type").isin(fixed.ALLOWED_MIMES), F.lit(False)), "type not allowed")
    checked = uploads.withColumn("extension", extension).withColumn("_fault", own_fault)
    arrival = F.struct("uploaded_at", "upload_id")
    # first good upload of each filename, then the 20th of them; both pre-aggregated
    firsts = checked.filter("_fault is null").groupBy("submission_id", "filename").agg(F.min(arrival).alias("arrived"))
    w = Window.partitionBy("submission_id").orderBy("arrived")
    full = (firsts.withColumn("_nth", F.row_number().over(w))
            .filter(F.col("_nth") <= fixed.MAX_DOCUMENTS_PER_SUBMISSION)
            .groupBy("submission_id").agg(F.max("arrived").alias("_full_at"), F.count(F.lit(1)).alias("_names"))
            .filter(F.col("_names") == fixed.MAX_DOCUMENTS_PER_SUBMISSION).drop("_names"))
    late = F.coalesce(arrival > F.col("_full_at"), F.lit(False))
    return checked.join(full, "submission_id", "left").withColumn(
        "reject_reason", F.when(late, "too many documents").otherwise(F.col("_fault"))).select(
        *uploads.columns, "extension", "reject_reason")


def split_admitted(admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)."""
    return admitted.filter("reject_reason is null").drop("reject_reason"), admitted.filter("reject_reason is not null")


# --- MIME and routing -------------------------------------------------------
def detect_mime(head_hex: Column, extension: Column) -> Column:
    """MIME type from the file signature; where there is none, from the extension."""
    by_extension = F.element_at(F.create_map(*[F.lit(x) for kv in fixed.EXTENSION_MIME.items() for x in kv]), extension)
    detected = F.when(head_hex.startswith(fixed.ZIP_SIGNATURE), F.when(extension.isin("docx", "xlsx"), by_extension)
                      .otherwise("application/zip"))
    for signature, mime in fixed.MAGIC_MIME:
        detected = detected.when(head_hex.startswith(signature), mime)
    return detected.otherwise(F.coalesce(by_extension, F.lit("application/octet-stream")))


def resolve_mime(files: DataFrame, content: str = "content", filename: str = "filename") -> DataFrame:
    """Adds mime_type, mime_allowed and mime_mismatch (the detected type wins; text/plain never mismatches)."""
    extension = lower_extension(filename)
    expected = F.element_at(F.create_map(*[F.lit(x) for kv in fixed.EXTENSION_MIME.items() for x in kv]), extension)
    head = F.hex(F.substring(F.col(content).cast("binary"), 1, 8))
    return (files.withColumn("mime_type", detect_mime(head, extension))
            .withColumn("mime_allowed", F.col("mime_type").isin(fixed.ALLOWED_MIMES))
            .withColumn("mime_mismatch", F.coalesce((F.col("mime_type") != expected) & (F.col("mime_type") != "text/plain"), F.lit(False))))


def parser_family(mime: Column, extension: Column) -> Column:
    """First family that takes the MIME type or the extension, else ``unsupported``."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    e = F.regexp_replace(F.lower(F.coalesce(extension, F.lit(""))), r"^\.+", "")
    chain = F.when(F.lit(False), F.lit(""))
    for family, exact, parts, extensions in fixed.PARSER_FAMILIES:
        takes = e.isin(extensions)
        if exact:
            takes = takes | m.isin(exact)
        for p in parts:
            takes = takes | m.contains(p)
        chain = chain.when(takes, family)
    return chain.otherwise("unsupported")


# --- tables -----------------------------------------------------------------
def to_table(raw: DataFrame, cells: str = "raw") -> DataFrame:
    """``array<array<string>>`` -> headers and rows (arrays aligned with headers).

    The first row is the header iff all its cells are filled; otherwise columns
    are Col_0, Col_1, ... and it is data. Short rows are padded, long ones cut;
    of equal headers the last value counts, as in a dictionary.
    """
    norm = F.transform(cells, lambda row: F.transform(row, lambda c: strip(F.coalesce(c, F.lit("")))))
    staged = compute_once(raw, _norm=norm).withColumn("_first", F.coalesce(F.get("_norm", F.lit(0)), F.expr(EMPTY)))
    is_header = (F.size("_first") > 0) & F.forall("_first", lambda c: c != "")
    width = F.size("_first")
    names = F.when(width == 0, F.expr(EMPTY)).when(is_header, F.col("_first")).otherwise(
        F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.concat(F.lit("Col_"), i.cast("string"))))
    data = F.when(is_header, F.expr("slice(_norm, 2, greatest(size(_norm) - 1, 0))")).otherwise(F.col("_norm"))
    staged = staged.withColumn("headers", names).withColumn("_data", data) \
        .withColumn("_last_of", F.transform("headers", lambda h: F.size("headers") - F.array_position(F.reverse("headers"), h)))
    rows = F.transform("_data", lambda row: F.transform("_last_of", lambda i: F.coalesce(F.get(row, i.cast("int")), F.lit(""))))
    return compute_once(staged, rows=rows).drop("_norm", "_first", "_data", "_last_of")


def row_maps(headers: Column, rows: Column) -> Column:
    """Rows as maps header -> cell."""
    names = F.array_distinct(headers)
    return F.transform(rows, lambda row: F.map_from_arrays(
        names, F.transform(names, lambda h: F.element_at(row, F.array_position(headers, h).cast("int")))))


def table_text(headers: Column, rows: Column) -> Column:
    """``a | b``, a rule as long as the header line, then the rows."""
    head = F.array_join(headers, " | ")
    lines = F.transform(rows, lambda row: F.array_join(row, " | "))
    rule = F.array_join(F.array_repeat(F.lit("-"), F.length(head)), "")
    return F.when(F.size(headers) == 0, "").otherwise(F.array_join(F.concat(F.array(head, rule), lines), "\n"))


def tables_text(tables: DataFrame, key: str = "document_id") -> DataFrame:
    """All tables of a document, each under ``[Table i — Page p]``, in page and table order."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "table_index", table_text(F.col("headers"), F.col("rows")).alias("text"))))
    parts = F.transform(ordered, lambda t, i: F.concat(
        F.lit("[Table "), (i + 1).cast("string"), F.lit(" — Page "), t.page_number.cast("string"), F.lit("]\n\n"), t.text))
    return tables.groupBy(key).agg(F.array_join(parts, "\n\n").alias("tables_text"))


def filled_rows(cells: Column) -> Column:
    """Rows of a sheet that have a cell with something in it."""
    return F.filter(cells, lambda row: F.exists(row, lambda c: F.coalesce(c != "", F.lit(False))))


def preview_text(banner: Column, headers: Column, rows: Column, limit: int = fixed.PREVIEW_ROWS, tell_more: bool = True) -> Column:
    """Banner, header and first rows; how many more there are is told of files, not of sheets."""
    head = F.array(banner, F.array_join(headers, " | "))
    shown = F.transform(F.slice(rows, 1, limit), lambda row: F.array_join(row, " | "))
    more = F.when((F.size(rows) > limit) & F.lit(tell_more), F.array(F.concat(F.lit("... ("), (F.size(rows) - limit).cast("string"), F.lit(" more rows)")))) \
        .otherwise(F.expr(EMPTY))
    return clean_text(F.when(F.size(headers) == 0, banner).otherwise(F.array_join(F.concat(head, shown, more), "\n")))


def normalise_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, clean_text(text))


# --- pages and documents ----------------------------------------------------
def detect_scanned(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents averaging under 50 characters a page need OCR."""
    average = F.sum(F.length(F.coalesce("text", F.lit("")))) / F.count(F.lit(1))
    return pages.groupBy(key).agg((average < fixed.SCANNED_CHARS_PER_PAGE).alias("needs_ocr"))


def assemble_documents(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """page_count, total_chars, is_empty, table_count, full_text of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.array_sort(F.collect_list(F.when(~is_blank("text"), F.struct("page_number", "text"))))
    tables = F.sum("table_count") if "table_count" in pages.columns else F.lit(0)
    return pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("page_count"), F.sum(F.length(text)).alias("total_chars"),
        (F.sum(F.length(text)) == 0).alias("is_empty"), tables.cast("long").alias("table_count"),
        F.array_join(F.transform(kept, lambda p: p.text), "\n\n").alias("full_text"))


def ocr_pages(words: DataFrame, key: str = "document_id") -> DataFrame:
    """OCR words -> page text, mean confidence, word count and low-confidence flag.

    A word at a block or paragraph boundary (level 3 or 4, not the first box)
    is followed by a line break, unless the text so far ends in one.
    """
    page = ["document_id" if key == "document_id" else key, "page_number"]
    word = strip(F.coalesce("word", F.lit("")))
    good = (F.col("conf") > 0) & (word != "")
    boxes = F.array_sort(F.collect_list(F.struct("word_seq", F.when(good, word).alias("word"), F.col("level").isin(3, 4).alias("breaks"))))
    # word, then a break mark; runs of breaks without a word between collapse to one
    pieces = F.flatten(F.transform(boxes, lambda b, i: F.array_compact(F.array(
        b.word, F.when(b.breaks & (i > 0), F.lit("\n"))))))
    joined = F.array_join(F.col("_pieces"), " ")
    squeezed = F.regexp_replace(joined, "\n( \n)+", "\n")
    # a break cannot open the text, and ends are stripped
    text = F.regexp_replace(F.regexp_replace(strip(squeezed), " {2,}", " "), "\n{3,}", "\n\n")
    grouped = words.groupBy(*page).agg(
        pieces.alias("_pieces"), F.avg(F.when(good, F.col("conf").cast("double"))).alias("_mean"), F.count_if(good).alias("word_count"))
    mean = F.coalesce("_mean", F.lit(-1.0))
    return grouped.select(*page, text.alias("text"), mean.alias("mean_confidence"), "word_count",
                          ((mean >= 0) & (mean < fixed.OCR_LOW_CONFIDENCE)).alias("is_low_confidence"))


def merge_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages with their OCR text: placeholders are replaced, real text is appended to."""
    p = pages.select("document_id", "page_number", F.col("text").alias("_text"), F.lit(True).alias("_parsed"))
    o = ocr.select("document_id", "page_number", F.col("text").alias("_ocr"), "mean_confidence", "word_count", "is_low_confidence")
    real = ~is_blank("_text") & ~F.col("_text").startswith("[Image")
    text = F.when(F.col("_ocr").isNull(), F.col("_text")).when(F.col("_parsed") & real, F.concat("_text", F.lit(fixed.OCR_MARKER), "_ocr")) \
        .otherwise(F.col("_ocr"))
    return p.join(o, ["document_id", "page_number"], "full").select(
        "document_id", "page_number", text.alias("text"), "mean_confidence", "word_count", "is_low_confidence")


def ocr_documents(merged: DataFrame) -> DataFrame:
    """Document-level OCR figures of merged pages; such documents need no OCR any more."""
    mean = F.avg(F.when(F.col("mean_confidence") >= 0, F.col("mean_confidence")))
    low = F.array_sort(F.collect_list(F.when(F.col("is_low_confidence"), F.col("page_number"))))
    return merged.groupBy("document_id").agg(
        F.round(F.coalesce(mean, F.lit(-1.0)), 1).alias("ocr_mean_confidence"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("ocr_total_words"), low.alias("ocr_low_confidence_pages"),
        F.lit(False).alias("needs_ocr"))


def choose_extraction(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Pages of the primary extraction, or of the fallback where the primary is thin.

    Fallback pages keep the primary's ``table_count`` by page number.
    """
    thin = detect_scanned(primary).filter("needs_ocr").select("document_id")
    kept = primary.join(thin, "document_id", "left_anti").select(
        "document_id", "page_number", "text", "table_count", F.lit("primary").alias("extraction"))
    tables = primary.select("document_id", "page_number", "table_count")
    replaced = fallback.select("document_id", "page_number", "text").join(thin, "document_id", "left_semi") \
        .join(tables, ["document_id", "page_number"], "left")
    return kept.unionByName(replaced.select(
        "document_id", "page_number", clean_text("text").alias("text"), F.coalesce("table_count", F.lit(0)).alias("table_count"),
        F.lit("fallback").alias("extraction")))


# --- status and reports -----------------------------------------------------
def process_pending(documents: DataFrame, results: DataFrame, reason_chars: int | None = None) -> DataFrame:
    """New status of current PENDING documents from their parse results.

    ``results``: document_id, needs_ocr, page_count, error. Rows that wait are
    narrow and are looked up by hash; results with their long errors pass by and
    are not sorted.
    """
    pending = documents.filter("is_current_version and processing_status = 'PENDING'")
    failed = F.col("error").isNotNull()
    return pending.hint("shuffle_hash").join(results, "document_id").withColumns({
        "processing_status": F.when(failed, "FAILED").when(F.col("needs_ocr"), "OCR_PROCESSING").otherwise("COMPLETED"),
        "failure_reason": F.when(failed, limited("error", reason_chars)),
        "is_scanned": F.when(~failed, F.col("needs_ocr"))}).drop("error", "needs_ocr")


def processing_summary(processed: DataFrame, by: str = "submission_id") -> DataFrame:
    """Documents, pages, tables, characters and open OCR work per submission."""
    return processed.groupBy(by).agg(
        F.count(F.lit(1)).alias("documents_processed"), F.sum("page_count").alias("pages"), F.sum("table_count").alias("tables"),
        F.sum("total_chars").alias("chars"), F.count_if("needs_ocr").alias("need_ocr"))
