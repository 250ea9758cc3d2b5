"""Sources and ingestion."""

from pyspark.sql import functions as F

from bindery import fixed
from bindery.operators import ingest as I, lifecycle as L, relational as R
from bindery.session import shared_dir
from bindery.sources import files as S, store
from checks.q_relational import VERSIONED
from checks.registry import lits, query


def landed(t, sep=","):
    """The part table as delimited files, one folder per brand (as a submission)."""
    path = shared_dir(t.spark, "landed")
    parts = t.part.select("p_partkey", "p_name", F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_type")).alias("p_type"),
                          "p_size", F.regexp_replace("p_brand", "#", "-").alias("submission_id"))
    parts.repartition(8, "submission_id").write.partitionBy("submission_id").option("header", True).option("sep", sep).csv(path)
    return path


@query("a01_scan_landed_files", sql="""
select replace(p_brand, '#', '-') as submission_id, true as has_content from part group by p_brand""")
def _(t):
    files = S.landed_files(t.spark, landed(t), "*.csv")
    return files.groupBy(F.replace("submission_id", F.lit("submission_id="), F.lit("")).alias("submission_id")).agg(
        F.min(F.length("content") == F.col("size_bytes")).alias("has_content"))


BASENAME = "string_split(rtrim(filename, '/'), '/')[-1]"
ADMITTED = ("admitted", f"""select u.*, case when uploaded_at > full_at or (uploaded_at = full_at and upload_id > full_id) then 'too many documents' else fault end as reject_reason from faults u
  left join (select submission_id, uploaded_at as full_at, upload_id as full_id from (
     select *, row_number() over (partition by submission_id order by uploaded_at, upload_id) as nth from (
       select submission_id, filename, min(uploaded_at) as uploaded_at, arg_min(upload_id, struct_pack(a := uploaded_at, b := upload_id)) as upload_id from faults where fault is null group by submission_id, filename))
     where nth = {fixed.MAX_DOCUMENTS_PER_SUBMISSION}) using (submission_id)""")
FAULTS = ("faults", f"""select *, case when base like '%.%' then lower(string_split(base, '.')[-1]) else '' end as extension,
   case when trim(filename) = '' then 'empty filename' when base not like '%.%' then 'no extension'
     when lower(string_split(base, '.')[-1]) not in {lits(fixed.ALLOWED_EXTENSIONS)} then 'extension not allowed'
     when size_bytes > {fixed.MAX_UPLOAD_BYTES} then 'file too large' when size_bytes = 0 then 'file is empty' end as fault
  from (select *, {BASENAME} as base from uploads)""")


def admission(name, uploads_sql, spark_uploads):
    @query(name, "v_uploads", [("uploads", uploads_sql), FAULTS, ADMITTED], "select upload_id, extension, reject_reason from admitted")
    def _(t):
        return I.admit(spark_uploads(t)).select("upload_id", "extension", "reject_reason")


admission("a02_admission_check", "select * from v_uploads", lambda t: t.v_uploads)
# one submission per 200 orders and a name per part, so that the limit of 20 names is met
admission("a02_admission_limit", """select upload_id, submission_id // 200 as submission_id, uploaded_at, case when filename like 'doc%' then 'p' || cast(upload_id % 60 as varchar) || '.pdf' else filename end as filename, size_bytes from v_uploads""",
          lambda t: t.v_uploads.withColumns({
              "filename": F.when(F.col("filename").startswith("doc"), F.concat(F.lit("p"), (F.col("upload_id") % 60).cast("string"), F.lit(".pdf"))).otherwise(F.col("filename")),
              "submission_id": F.floor(F.col("submission_id") / 200)}))


TYPED = """select *, case upload_id % 3 when 0 then 'application/pdf' when 1 then 'application/x-msdownload' end as mime_type from v_uploads"""


@query("a02_mime_rejection", "v_uploads", [("uploads", TYPED), (FAULTS[0], FAULTS[1].replace(
    "when size_bytes = 0 then 'file is empty'", f"when size_bytes = 0 then 'file is empty' when coalesce(mime_type not in {lits(fixed.ALLOWED_MIMES)}, true) then 'type not allowed'")), ADMITTED],
    "select upload_id, extension, reject_reason from admitted")
def _(t):
    mime = F.when(F.col("upload_id") % 3 == 0, "application/pdf").when(F.col("upload_id") % 3 == 1, "application/x-msdownload")
    return I.admit(t.v_uploads.withColumn("mime_type", mime)).select("upload_id", "extension", "reject_reason")


@query("a02_accepted_rejected_split", "v_uploads", [("uploads", "select * from v_uploads"), FAULTS, ADMITTED], """
select coalesce(reject_reason, 'accepted') as outcome, count(*) as n from admitted group by 1""")
def _(t):
    accepted, rejected = I.split_admitted(I.admit(t.v_uploads))
    return accepted.select(F.lit("accepted").alias("outcome")).unionByName(rejected.select(F.col("reject_reason").alias("outcome"))) \
        .groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


MIMES = "case ext " + " ".join(f"when '{k}' then '{v}'" for k, v in fixed.EXTENSION_MIME.items()) + " end"
HEADS = """select page_id, case page_id % 6 when 0 then 'a.pdf' when 1 then 'b.docx' when 2 then 'c.csv' when 3 then 'd.png' when 4 then 'e.exe' else 'f.jpg' end as filename,
   case page_id % 5 when 0 then '%PDF-1.7 ' when 1 then 'PK' || chr(3) || chr(4) else '' end || html as content from pages"""


@query("a03_mime_resolution", "", [("heads", HEADS)], f"""
select page_id, mime_type, mime_type in {lits(fixed.ALLOWED_MIMES)} as mime_allowed,
  coalesce(mime_type <> {MIMES} and mime_type <> 'text/plain', false) as mime_mismatch
from (select *, case when content like '%%PDF%' and left(content, 4) = '%PDF' then 'application/pdf'
    when left(content, 4) = 'PK' || chr(3) || chr(4) then case when ext in ('docx', 'xlsx') then {MIMES} else 'application/zip' end
    else coalesce({MIMES}, 'application/octet-stream') end as mime_type from (select *, string_split(filename, '.')[-1] as ext from heads))""")
def _(t):
    t.pages.createOrReplaceTempView("pages")
    return I.resolve_mime(t.spark.sql(HEADS)).select("page_id", "mime_type", "mime_allowed", "mime_mismatch")


@query("a04_checksum", sql="select page_id, sha256(html) as checksum_sha256 from pages")
def _(t):
    return S.with_checksum(t.pages.select("page_id", F.col("html").cast("binary").alias("content"))).select("page_id", "checksum_sha256")


@query("a05_parser_routing", "v_documents", sql="""
select file_extension, mime, case when mime = 'application/pdf' or file_extension = 'pdf' then 'pdf' when file_extension in ('docx', 'doc') then 'docx'
   when mime = 'text/csv' or file_extension = 'csv' then 'csv' when file_extension in ('png', 'jpg', 'jpeg') then 'image' else 'unsupported' end as family, count(*) as n
from (select *, case when k % 5 = 0 then 'application/pdf' when k % 5 = 1 then 'text/csv' else 'application/octet-stream' end as mime from v_documents) group by all""")
def _(t):
    mime = F.when(F.col("k") % 5 == 0, "application/pdf").when(F.col("k") % 5 == 1, "text/csv").otherwise("application/octet-stream")
    routed = t.v_documents.withColumn("mime", mime).withColumn("family", I.parser_family(F.col("mime"), F.col("file_extension")))
    return routed.groupBy("file_extension", "mime", "family").agg(F.count(F.lit(1)).alias("n"))


@query("a06_read_delimited", sql="""
select cast(p_partkey as varchar) as p_partkey, p_name, case when p_size % 7 <> 0 then p_type end as p_type, cast(p_size as varchar) as p_size from part""")
def _(t):
    return S.read_delimited(t.spark, landed(t))


@query("a06_csv_documents", sql="""
select cast(p_partkey as varchar) as p_partkey, p_name, case when p_size % 7 <> 0 then p_type else '' end as p_type, cast(p_size as varchar) as p_size from part""")
def _(t):
    files = S.landed_files(t.spark, landed(t, ";"), "*.csv").select("path", "content")
    parsed = I.to_table(S.csv_documents(files))
    return parsed.select("headers", F.explode("rows").alias("row")).select(
        *[F.element_at("row", F.array_position("headers", c).cast("int")).alias(c) for c in ("p_partkey", "p_name", "p_type", "p_size")])


def ragged(t):
    """Parts as files with a repeated and a blank name in the header; every ninth row has a cell too many."""
    path = shared_dir(t.spark, "ragged")
    line = F.concat_ws(",", "p_partkey", "p_brand", F.when(F.col("p_partkey") % 9 == 0, F.lit("x,y")).otherwise(F.lit("x")))
    header = t.part.agg(F.lit("key,key,").alias("line"))
    rows = t.part.select(line.alias("line"))
    header.union(rows).coalesce(1).write.text(path)
    return S.csv_documents(S.landed_files(t.spark, path, "*.txt").select("path", "content"))


@query("a06_csv_rejects", sql="select p_partkey, p_brand, 4 as n_cells from part where p_partkey % 9 = 0")
def _(t):
    cells = S.csv_rejects(ragged(t)).select("cells")
    return cells.select(F.col("cells")[0].cast("long").alias("p_partkey"), F.col("cells")[1].alias("p_brand"), F.size("cells").alias("n_cells"))


@query("a06_csv_header_names", sql="""select cast(p_partkey as varchar) as "key", p_brand as "key.1", 'x' as "Unnamed: 2" from part where p_partkey % 9 <> 0""")
def _(t):
    return I.to_table(ragged(t)).select("headers", F.explode("rows").alias("row")).select(
        *[F.element_at("row", F.array_position("headers", c).cast("int")).alias(c) for c in ("key", "key.1", "Unnamed: 2")])


@query("a07_sniff_delimiter", sql="select '|' as delimiter, true as found")
def _(t):
    heads = S.sniff_delimiters(S.file_heads(t.spark, landed(t, "|")))
    return heads.groupBy("delimiter").agg((F.count(F.lit(1)) > 0).alias("found"))


RAW = "transform(split(raw_text, '\n'), line -> split(line, '[|]')) as raw"


def tables(t):
    return I.to_table(t.v_raw_tables.selectExpr("table_id", RAW.replace("\n", "\\n")))


TABLE = ("tabled", """select table_id, case when not blank then names else ['Col_0', 'Col_1', 'Col_2'] end as headers,
    list_transform(case when blank then lines else lines[2:] end, lambda l: list_transform([1, 2, 3], lambda i: coalesce(string_split(l, '|')[i], ''))) as rows
  from (select *, list_contains(names, '') as blank from (select *, string_split(raw_text, chr(10)) as lines, string_split(string_split(raw_text, chr(10))[1], '|') as names from v_raw_tables))""")
ROWTEXT = "list_transform(rows, lambda r: array_to_string(r, ' | '))"


@query("a08_header_inference", "v_raw_tables", [TABLE], f"""
select table_id, array_to_string(headers, ',') as headers, array_to_string({ROWTEXT}, ';') as rows from tabled""")
def _(t):
    return tables(t).select("table_id", F.array_join("headers", ",").alias("headers"),
                            F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), ";").alias("rows"))


TEXT = f"array_to_string(headers, ' | ') || chr(10) || repeat('-', length(array_to_string(headers, ' | '))) || chr(10) || array_to_string({ROWTEXT}, chr(10))"


@query("a09_table_text", "v_raw_tables", [TABLE], f"select table_id, {TEXT} as table_text from tabled")
def _(t):
    return tables(t).select("table_id", I.table_text(F.col("headers"), F.col("rows")).alias("table_text"))


@query("a09_tables_of_document", "v_raw_tables", [TABLE], f"""
select table_id // 4 as document_id, string_agg('[Table ' || cast(i as varchar) || ' — Page ' || cast(table_id % 4 + 1 as varchar) || ']' || chr(10) || chr(10) || txt, chr(10) || chr(10) order by i) as tables_text
 from (select table_id, {TEXT} as txt, row_number() over (partition by table_id // 4 order by table_id) as i from tabled) group by 1""")
def _(t):
    placed = tables(t).select(F.floor(F.col("table_id") / 4).alias("document_id"), (F.col("table_id") % 4 + 1).alias("page_number"),
                              F.lit(0).alias("table_index"), "headers", "rows")
    return I.tables_text(placed)


@query("a10_row_preview", "v_raw_tables", [TABLE], rf"""
select table_id, regexp_replace('[CSV: t.csv]' || chr(10) || array_to_string(headers, ' | ') || chr(10) || array_to_string({ROWTEXT.replace('(rows', '(rows[1:2]')}, chr(10))
   || case when len(rows) > 2 then chr(10) || '... (' || cast(len(rows) - 2 as varchar) || ' more rows)' else '' end, ' +(\n|$)', '\1', 'g') as preview from tabled""")
def _(t):
    return tables(t).select("table_id", I.preview_text(F.lit("[CSV: t.csv]"), F.col("headers"), F.col("rows"), 2).alias("preview"))


@query("a10_sheet_preview", "v_raw_tables", [TABLE], rf"""
select table_id, regexp_replace('[Sheet: S' || cast(table_id as varchar) || ']' || chr(10) || array_to_string(headers, ' | ') || chr(10) || array_to_string({ROWTEXT.replace('(rows', '(rows[1:2]')}, chr(10)),
   ' +(\n|$)', '\1', 'g') as page_text from tabled""")
def _(t):
    """Sheets with blank rows between: these are no rows of the table."""
    spaced = t.v_raw_tables.withColumn("raw_text", F.concat(F.lit("||\n"), F.replace("raw_text", F.lit("\n"), F.lit("\n||\n\n"))))
    sheets = spaced.selectExpr("table_id", RAW.replace("\n", "\\n")).withColumn("raw", I.filled_rows(F.col("raw")))
    banner = F.concat(F.lit("[Sheet: S"), F.col("table_id").cast("string"), F.lit("]"))
    return I.to_table(sheets).select("table_id", I.preview_text(banner, F.col("headers"), F.col("rows"), 2, tell_more=False).alias("page_text"))


CLEAN = r"trim(regexp_replace(regexp_replace(replace({c}, E'\r\n', E'\n'), '[ \t\r\f\v]+(\n|$)', '\1', 'g'), '\n{{4,}}', E'\n\n\n', 'g'), E' \n\t\r')"
PADDED = "replace(text, '. ', '.  ' || chr(10) || ' ' || chr(10) || chr(10) || chr(9) || chr(10) || chr(10))"


@query("a11_normalise_text", sql=f"select doc_id, {CLEAN.format(c=PADDED)} as text from documents")
def _(t):
    return I.normalise_text(t.documents.selectExpr("doc_id", f"{PADDED} as text"))


@query("a12_scanned_detector", "v_pages", sql="select document_id, sum(length(text)) / count(*) < 50 as needs_ocr from v_pages group by document_id")
def _(t):
    return I.detect_scanned(t.v_pages)


ASSEMBLED = ("assembled", """select document_id, count(*) as page_count, cast(sum(length(text)) as bigint) as total_chars, sum(length(text)) = 0 as is_empty,
   coalesce(string_agg(text, chr(10) || chr(10) order by page_number) filter (where trim(text, E' \\n\\t\\r') <> ''), '') as full_text from v_pages group by document_id""")


@query("a13_assemble_documents", "v_pages", [ASSEMBLED], "select * from assembled")
def _(t):
    return I.assemble_documents(t.v_pages).drop("table_count")


OCR = ("ocr", r"""select document_id, page_number, trim(regexp_replace(regexp_replace(regexp_replace(trim(pieces, E' \n'), '\n( \n)+', E'\n', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', E'\n\n', 'g')) as text,
   coalesce(mean, -1) as mean_confidence, word_count, mean is not null and mean < 60 as is_low_confidence from (
  select document_id, page_number, avg(cast(conf as double)) filter (where good) as mean, count(*) filter (where good) as word_count,
    coalesce(string_agg(trim(case when good then w else '' end || case when level in (3, 4) and word_seq > first then ' ' || chr(10) else '' end, ' '), ' ' order by word_seq) filter (where good or (level in (3, 4) and word_seq > first)), '') as pieces
   from (select *, trim(word, E' \n\t\r') as w, conf > 0 and trim(word, E' \n\t\r') <> '' as good, min(word_seq) over (partition by document_id, page_number) as first from v_ocr_words)
   group by document_id, page_number)""")


@query("a14_ocr_pages", "v_ocr_words", [OCR], "select document_id, page_number, text, round(mean_confidence, 4) as mean_confidence, word_count, is_low_confidence from ocr")
def _(t):
    return I.ocr_pages(t.v_ocr_words).withColumn("mean_confidence", F.round("mean_confidence", 4))


MERGED = ("merged_pages", """select document_id, page_number, case when o.document_id is null then p.text when p.document_id is not null and trim(p.text, E' \\n\\t\\r') <> '' and not starts_with(p.text, '[Image')
   then p.text || chr(10) || chr(10) || '[OCR TEXT]' || chr(10) || o.text else o.text end as text, mean_confidence, word_count, is_low_confidence
  from placeholder p full join ocr o using (document_id, page_number)""")
PLACEHOLDER = ("placeholder", "select document_id, page_number, case when document_id % 3 = 0 then '[Image file]' when document_id % 3 = 1 then ' ' else text end as text from v_pages")


def merged(t):
    pages = t.v_pages.withColumn("text", F.when(F.col("document_id") % 3 == 0, "[Image file]").when(F.col("document_id") % 3 == 1, " ").otherwise(F.col("text")))
    return I.merge_ocr(pages, I.ocr_pages(t.v_ocr_words))


@query("a15_merge_ocr_pages", "v_pages v_ocr_words", [OCR, PLACEHOLDER, MERGED], "select document_id, page_number, text, word_count from merged_pages")
def _(t):
    return merged(t).select("document_id", "page_number", "text", "word_count")


@query("a15_ocr_documents", "v_pages v_ocr_words", [OCR, PLACEHOLDER, MERGED], """
select document_id, round(coalesce(avg(mean_confidence) filter (where mean_confidence >= 0), -1), 1) as ocr_mean_confidence,
  cast(coalesce(sum(word_count), 0) as bigint) as ocr_total_words,
  coalesce(string_agg(cast(page_number as varchar), ',' order by page_number) filter (where is_low_confidence), '') as low_pages, false as needs_ocr
from merged_pages group by document_id""")
def _(t):
    return I.ocr_documents(merged(t)).withColumn("low_pages", F.array_join("ocr_low_confidence_pages", ",")).drop("ocr_low_confidence_pages")


@query("a16_parsed_round_trip", "v_pages", [ASSEMBLED], "select document_id, page_count, total_chars, is_empty, full_text, document_id // 5 as submission_id from assembled")
def _(t):
    path = shared_dir(t.spark, "parsed")
    docs = I.assemble_documents(t.v_pages).drop("table_count").withColumn("submission_id", F.floor(F.col("document_id") / 5))
    S.save_parsed(docs, path, buckets=8)
    return S.load_parsed(t.spark, path)


RESULTS = """select document_id, k % 4 = 0 as needs_ocr, k % 7 + 1 as page_count, case when k % 5 = 0 then repeat('ParserError: ', 300) end as error from v_documents"""


def results(t):
    t.v_documents.createOrReplaceTempView("v_documents")
    return t.spark.sql(RESULTS)


@query("a17_process_pending", "v_documents", [VERSIONED, ("results", RESULTS)], """
select document_id, page_count, case when error is not null then 'FAILED' when needs_ocr then 'OCR_PROCESSING' else 'COMPLETED' end as processing_status, error as failure_reason
from versioned join results using (document_id) where is_current_version and processing_status = 'PENDING'""")
def _(t):
    return I.process_pending(R.assign_versions(t.v_documents), results(t)).select("document_id", "page_count", "processing_status", "failure_reason")


# The same table, applied event by event.
NEXT = "case " + " ".join(f"when event = '{e}' and status in ({', '.join(repr(s) for s in legal)}) then '{after}'" for e, (legal, after, _) in L.TRANSITIONS.items()) + " end"
FOLDED = ("folded", f"""with recursive numbered as (select *, row_number() over (partition by document_id order by event_at, event_no) as i from v_document_events),
    step as (select document_id, 0 as i, 'PENDING' as status, cast(null as varchar) as before, false as is_legal from (select distinct document_id from v_document_events)
      union all select document_id, i, coalesce(to_, status), status, to_ is not null from (
        select n.document_id, n.i, s.status, {NEXT} as to_ from step s join numbered n on n.document_id = s.document_id and n.i = s.i + 1))
    select n.*, step.before as status_before, step.status as status_after, step.is_legal from numbered n join step using (document_id, i)""")


def folded(t):
    return L.fold(t.v_document_events, ["event_at", "event_no"])


@query("a17_event_fold", "v_document_events", [FOLDED], "select document_id, event_no, event, status_before, status_after, is_legal from folded")
def _(t):
    return folded(t).select("document_id", "event_no", "event", "status_before", "status_after", "is_legal")


@query("a17_illegal_transitions", "v_document_events", [FOLDED], "select document_id, event_no, event, status_before from folded where not is_legal")
def _(t):
    return L.illegal(folded(t)).select("document_id", "event_no", "event", "status_before")


LAST = "arg_max(struct_pack(v := {v}), i) filter (where is_legal and event in ({events})).v"
CURRENT = ("states", f"""select document_id, arg_max(status_after, i) as status, count(*) as n_events, count(*) filter (where not is_legal) as n_illegal,
   {LAST.format(v="page_count", events="'parsed', 'parsed_scanned', 'ocr_done'")} as page_count,
   {LAST.format(v="event <> 'parsed'", events="'parsed', 'parsed_scanned', 'ocr_done'")} as is_scanned,
   {LAST.format(v="failure_reason", events="'parsed', 'parsed_scanned', 'ocr_done', 'parse_failed', 'ocr_failed'")} as failure_reason from folded group by document_id""")


@query("a17_document_states", "v_document_events", [FOLDED, CURRENT], "select * from states")
def _(t):
    return L.current(folded(t), ["event_at", "event_no"])


@query("a17_apply_status", "v_document_events", [FOLDED, CURRENT], """
select document_id, coalesce(status, processing_status) as processing_status, page_count, is_scanned, failure_reason from v_documents left join states using (document_id)""")
def _(t):
    states = L.current(folded(t), ["event_at", "event_no"])
    return L.apply_status(t.v_documents, states).select("document_id", "processing_status", "page_count", "is_scanned", "failure_reason")


REWRITTEN = "select document_id, page_count + 100 as page_count, cast(0 as bigint) as total_chars, true as is_empty, 'parsed again' as full_text, document_id // 5 as submission_id from assembled where document_id % 7 = 3"


@query("a16_replace_documents", "v_pages", [ASSEMBLED, ("redone", REWRITTEN)], """
select document_id, page_count, total_chars, is_empty, full_text, document_id // 5 as submission_id from assembled
 where document_id not in (select document_id from redone) and document_id % 7 <> 5 union all select * from redone""")
def _(t):
    path = shared_dir(t.spark, "parsed")
    docs = I.assemble_documents(t.v_pages).drop("table_count").withColumn("submission_id", F.floor(F.col("document_id") / 5))
    S.save_parsed(docs, path, buckets=8)
    stored = S.load_parsed(t.spark, path)
    again = stored.filter("document_id % 7 = 3").withColumns({
        "page_count": F.col("page_count") + 100, "total_chars": F.lit(0).cast("long"), "is_empty": F.lit(True), "full_text": F.lit("parsed again")})
    store.replace(again, path, ["submission_id", "document_id"], removed=stored.filter("document_id % 7 = 5"))
    return S.load_parsed(t.spark, path)


@query("a18_processing_summary", "v_pages", [ASSEMBLED], """
select document_id // 5 as submission_id, count(*) as documents_processed, cast(sum(page_count) as bigint) as pages, cast(0 as bigint) as tables,
  cast(sum(total_chars) as bigint) as chars, count(*) filter (where total_chars / page_count < 50) as need_ocr from assembled group by 1""")
def _(t):
    docs = I.assemble_documents(t.v_pages).join(I.detect_scanned(t.v_pages), "document_id")
    return I.processing_summary(docs.withColumn("submission_id", F.floor(F.col("document_id") / 5)))


THIN = "case when document_id % 4 = 0 then left(text, 20) else text end"


@query("a19_choose_extraction", "v_pages", [
    ("prim", f"select document_id, page_number, {THIN} as text, page_number % 3 as table_count from v_pages"),
    ("thin", "select document_id from prim group by document_id having sum(length(text)) / count(*) < 50")], f"""
select document_id, page_number, text, table_count, 'primary' as extraction from prim where document_id not in (select document_id from thin)
union all select v.document_id, page_number, {CLEAN.format(c='v.text')} as text, table_count, 'fallback' from v_pages v join prim p using (document_id, page_number) where v.document_id in (select document_id from thin)""")
def _(t):
    pages = t.v_pages
    primary = pages.selectExpr("document_id", "page_number", f"{THIN} as text", "page_number % 3 as table_count")
    return I.choose_extraction(primary, pages)
