"""Relational queries."""

from pyspark.sql import functions as F

from bindery.operators import knowledge as K, paging, relational as R, version_log as VL
from checks.registry import in_order, query

VERSIONED = ("versioned", """select *, cast(row_number() over (partition by submission_id, original_filename order by uploaded_at, document_id) as int) as version_number,
  lead(document_id) over (partition by submission_id, original_filename order by uploaded_at, document_id) is null as is_current_version from v_documents""")


def versioned(t):
    return R.assign_versions(t.v_documents)


@query("b01_list_submissions", "v_submissions v_users", sql="""
select s.submission_id, s.status, ua.full_name as assigned_name, uc.full_name as creator_name, total,
   2 as page, 50 as page_size, cast(greatest(1, ceil(total / 50)) as bigint) as pages
 from (select *, count(*) over () as total from v_submissions where status = 'COMPLETED' order by created_at desc, submission_id limit 50 offset 50) s
   left join v_users ua on s.assigned_to = ua.user_id left join v_users uc on s.created_by = uc.user_id""")
def _(t):
    return R.list_submissions(t.v_submissions, t.v_users, status="COMPLETED", page=2, page_size=50).select(
        "submission_id", "status", "assigned_name", "creator_name", "total", "page", "page_size", "pages")


@query("b02_document_counts", "v_submissions v_documents", [VERSIONED], """
select submission_id, count(document_id) as n_documents from v_submissions
  left join (select submission_id, document_id from versioned where is_current_version) using (submission_id) group by submission_id""")
def _(t):
    return R.document_counts(t.v_submissions, versioned(t))


@query("b03_submission_numbers", "v_submissions", sql="""
select submission_id, 'SUB-' || strftime(created_at, '%Y%m%d') || '-' ||
   case when n < 10000 then lpad(cast(n as varchar), 4, '0') else cast(n as varchar) end as submission_number
 from (select *, row_number() over (partition by strftime(created_at, '%Y%m%d') order by created_at, submission_id) as n from v_submissions)""")
def _(t):
    return R.number_submissions(t.v_submissions).select("submission_id", "submission_number")


@query("b03_continue_numbers", "v_submissions", sql="""
select submission_id, 'SUB-' || strftime(created_at, '%Y%m%d') || '-' ||
   case when n < 10000 then lpad(cast(n as varchar), 4, '0') else cast(n as varchar) end as submission_number
 from (select *, row_number() over (partition by strftime(created_at, '%Y%m%d') order by status = 'COMPLETED' desc, created_at, submission_id) as n from v_submissions)
 where status <> 'COMPLETED'""")
def _(t):
    s = t.v_submissions
    old = R.number_submissions(s.filter("status = 'COMPLETED'"))
    return R.number_submissions(s.filter("status <> 'COMPLETED'"), old).select("submission_id", "submission_number")


@query("b04_documents_of_submission", "v_documents", [VERSIONED], """
select document_id, original_filename, version_number, row_number() over (order by uploaded_at, document_id) as place from versioned
where is_current_version and submission_id = (select min(o_orderkey) from orders)""")
def _(t):
    first = t.orders.agg(F.min("o_orderkey")).scalar()
    chosen = t.v_documents.filter(F.col("submission_id") == first)
    current = R.documents_of(R.assign_versions(chosen), first)
    return in_order(current.select("document_id", "original_filename", "version_number"))


@query("b04_all_versions_of_submission", "v_documents", [VERSIONED], """
select document_id, original_filename, version_number, is_current_version, row_number() over (order by uploaded_at, document_id) as place from versioned
where submission_id = (select min(o_orderkey) from orders)""")
def _(t):
    first = t.orders.agg(F.min("o_orderkey")).scalar()
    chosen = R.documents_of(R.assign_versions(t.v_documents.filter(F.col("submission_id") == first)), first, current_only=False)
    return in_order(chosen.select("document_id", "original_filename", "version_number", "is_current_version"))


@query("b05_assign_versions", "v_documents", [VERSIONED],
       "select document_id, submission_id, original_filename, version_number, is_current_version from versioned")
def _(t):
    return versioned(t).select("document_id", "submission_id", "original_filename", "version_number", "is_current_version")


SECOND = "processing_status = 'PENDING'"


@query("b05_append_versions", "v_documents", [
    ("base", f"""select *, row_number() over w as version_number, lead(document_id) over w is null as is_current_version from v_documents where not {SECOND}
      window w as (partition by submission_id, original_filename order by uploaded_at, document_id)"""),
    ("fresh", f"select submission_id, original_filename, max(document_id) as document_id from v_documents where {SECOND} group by all")], """
select document_id, version_number, is_current_version and fresh_id is null as is_current_version from
  (select b.*, f.document_id as fresh_id from base b left join fresh f using (submission_id, original_filename))
union all select f.document_id, coalesce(max(b.version_number), 0) + 1, true from fresh f left join base b using (submission_id, original_filename) group by f.document_id""")
def _(t):
    docs = t.v_documents
    base = R.assign_versions(docs.filter(f"not ({SECOND})")).select(
        "submission_id", "original_filename", "document_id", "version_number", "is_current_version")
    fresh = docs.filter(SECOND).groupBy("submission_id", "original_filename").agg(F.max("document_id").alias("document_id"))
    return R.append_version(base, fresh).select("document_id", F.col("version_number").cast("long").alias("version_number"), "is_current_version")


# Uploads with what their version row says; two batches, the second with some uploads of the first again.
UPLOADED = """select *, md5(cast(file_size_bytes as string)) as checksum_sha256, 'user' || cast(k % 9 as string) as uploaded_by,
   case when ln > 1 then 'revision ' || cast(ln as string) end as change_note from v_documents"""
FULL_LOG = ("full_log", f"""select submission_id, original_filename, document_id, checksum_sha256, uploaded_by, change_note, uploaded_at,
   cast(row_number() over (partition by submission_id, original_filename order by not early, uploaded_at, document_id) as int) as version_number
 from (select *, k % 3 <> 0 as early from ({UPLOADED}))""")


def version_log_of(t):
    t.v_documents.createOrReplaceTempView("v_documents")
    uploads = t.spark.sql(UPLOADED)
    first = uploads.filter("k % 3 <> 0")
    log = VL.append(None, first)
    return log.union(VL.append(log, uploads.filter("k % 3 = 0").union(first.filter("k % 2 = 0"))))


@query("b05_version_log", "v_documents", [FULL_LOG], "select * from full_log")
def _(t):
    return version_log_of(t)


@query("b05_versions_as_of", "v_documents", [FULL_LOG], """
select submission_id, original_filename, document_id, version_number, version_number = max(version_number) over (partition by submission_id, original_filename) as is_current_version
from full_log where uploaded_at <= date '1995-06-30'""")
def _(t):
    return VL.state(version_log_of(t), "1995-06-30").select("submission_id", "original_filename", "document_id", "version_number", "is_current_version")


@query("b05_current_versions", "v_documents", [FULL_LOG], """
select submission_id, original_filename, max(version_number) as version_number, arg_max(checksum_sha256, version_number) as checksum_sha256,
  arg_max({'v': change_note}, version_number).v as change_note, count(*) as n_versions from full_log group by submission_id, original_filename""")
def _(t):
    return VL.current(version_log_of(t)).select("submission_id", "original_filename", "version_number", "checksum_sha256", "change_note", "n_versions")


@query("b05_changed_contents", "v_documents", [FULL_LOG], """
select document_id, version_number from (select *, lag(checksum_sha256) over (partition by submission_id, original_filename order by version_number) as before from full_log)
where before is not null and checksum_sha256 <> before""")
def _(t):
    return VL.changed_contents(version_log_of(t)).select("document_id", "version_number")


@query("b06_version_history", "v_documents", [VERSIONED], """
select submission_id, original_filename, version_number, document_id, file_size_bytes, is_current_version,
  row_number() over (order by submission_id, original_filename, version_number) as place from versioned""")
def _(t):
    return in_order(R.version_history(versioned(t)).drop("uploaded_at"))


@query("b07_list_knowledge_documents", "v_knowledge_documents", sql="""
select document_id, title, total, pages from (select *, count(*) over () as total, cast(greatest(1, ceil(count(*) over () / 20)) as bigint) as pages
 from v_knowledge_documents where status = 'ACTIVE' and category = 'cat1') order by effective_date desc, document_id limit 20""")
def _(t):
    return K.list_documents(t.v_knowledge_documents, status="ACTIVE", category="cat1", page_size=20).select(
        "document_id", "title", "total", "pages")


@query("b08_eligible_knowledge_documents", "v_knowledge_documents", sql="""
select document_id, title, version from v_knowledge_documents where status = 'ACTIVE' and is_indexed""")
def _(t):
    return K.eligible_documents(t.v_knowledge_documents).select("document_id", "title", "version")


@query("b09_eligible_chunks", "v_knowledge_documents v_knowledge_chunks", sql="""
select chunk_id, document_id, chunk_index, title from v_knowledge_chunks join v_knowledge_documents using (document_id)
where status = 'ACTIVE' and is_indexed and embedding is not null""")
def _(t):
    return K.eligible_chunks(t.v_knowledge_chunks, t.v_knowledge_documents).select("chunk_id", "document_id", "chunk_index", "title")


@query("b09_eligible_chunks_as_of", "v_knowledge_documents v_knowledge_chunks", sql="""
select chunk_id, document_id from v_knowledge_chunks join v_knowledge_documents using (document_id)
where status = 'ACTIVE' and is_indexed and embedding is not null and effective_date <= date '2024-01-04'""")
def _(t):
    return K.eligible_chunks(t.v_knowledge_chunks, t.v_knowledge_documents, as_of="2024-01-04").select("chunk_id", "document_id")


@query("b10_chunks_per_document", "v_knowledge_chunks", sql="""
select document_id, count(*) as n_chunks, min(chunk_index) as first_chunk, max(chunk_index) as last_chunk from v_knowledge_chunks group by document_id""")
def _(t):
    return K.chunk_counts(t.v_knowledge_chunks)


@query("b10_chunks_in_order", "v_knowledge_chunks", sql="""
select chunk_index, chunk_id, chunk_text, row_number() over (order by chunk_index) as place from v_knowledge_chunks where document_id = (select min(vec_id % 200) from embeddings)""")
def _(t):
    chunks = t.v_knowledge_chunks
    return in_order(chunks.filter(F.col("document_id") == chunks.agg(F.min("document_id")).scalar()).orderBy("chunk_index").select(
        "chunk_index", "chunk_id", "chunk_text"))


@query("b11_user_directory", "v_users v_roles", sql="""
select user_id, full_name, role_name, total, pages from (select u.*, r.name as role_name, count(*) over () as total,
   cast(greatest(1, ceil(count(*) over () / 10)) as bigint) as pages from v_users u join v_roles r using (role_id) where is_active and r.name = 'UNDERWRITER')
order by created_at desc, user_id limit 10""")
def _(t):
    return R.user_directory(t.v_users, t.v_roles, is_active=True, role="UNDERWRITER", page_size=10).select(
        "user_id", "full_name", "role_name", "total", "pages")


BATCH = """select 'user' || cast(c_custkey as varchar) || '@example.com' as email from customer"""


@query("b12_email_lookup", "v_users", sql=f"select user_id, full_name from v_users where lower(trim(email)) in ({BATCH})")
def _(t):
    batch = t.customer.select(F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"))
    return R.lookup(batch, t.v_users.withColumn("email", R.normal_email("email")), "email").select("user_id", "full_name")


@query("b12_email_exists", "v_users", sql=f"""
select email, email in (select lower(trim(email)) from v_users) as "exists" from ({BATCH})""")
def _(t):
    batch = t.customer.select(F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"))
    return R.existence(batch, t.v_users.withColumn("email", R.normal_email("email")), "email")


@query("b12_submission_number_lookup", "v_submissions", sql="""
select submission_id from (select *, row_number() over (partition by strftime(created_at, '%Y%m%d') order by created_at, submission_id) as n from v_submissions) where n = 1""")
def _(t):
    numbered = R.number_submissions(t.v_submissions)
    wanted = t.v_submissions.select(F.concat(F.lit("SUB-"), F.date_format("created_at", "yyyyMMdd"), F.lit("-0001")).alias("submission_number"))
    return R.lookup(wanted, numbered, "submission_number").select("submission_id")


@query("b13_row_visibility", "v_submissions v_users v_roles", sql="""
select u.user_id as caller_id, count(s.submission_id) as n_visible, min(s.submission_id) as first_id
 from v_users u join v_roles r using (role_id) join v_submissions s on r.name <> 'ADMIN' and s.created_by = u.user_id group by u.user_id
union all select u.user_id, count(*), min(s.submission_id) from v_users u join v_roles r using (role_id), v_submissions s where r.name = 'ADMIN' group by u.user_id""")
def _(t):
    return R.visible_counts(t.v_submissions, R.callers(t.v_users, t.v_roles))


@query("b13_visible_to_one", "v_submissions", sql="select submission_id from v_submissions where created_by = 7")
def _(t):
    return R.visible_rows(t.v_submissions, "UNDERWRITER", 7).select("submission_id")


@query("b14_patch_merge", "v_submissions v_patches", sql="""
select s.submission_id, coalesce(p.applicant_name, s.applicant_name) as applicant_name, coalesce(p.broker_name, s.broker_name) as broker_name, s.status
from v_submissions s left join v_patches p using (submission_id)""")
def _(t):
    return R.patch(t.v_submissions, t.v_patches, "submission_id").select("submission_id", "applicant_name", "broker_name", "status")


@query("b15_deep_page", "v_documents", sql="""
select document_id, total, 1000::int as page, 5::int as page_size, cast(ceil(total / 5) as bigint) as pages, row_number() over (order by uploaded_at desc, document_id) as place
from (select *, count(*) over () as total from v_documents order by uploaded_at desc, document_id limit 5 offset 4995)""")
def _(t):
    page = paging.listing(t.v_documents, R.newest_first("document_id", "uploaded_at")).page(1000, 5)
    return in_order(page.select("document_id", "total", "page", "page_size", "pages"))


@query("b15_page_envelope", "v_submissions", sql="""
select submission_id, total, 3 as page, 100 as page_size, cast(greatest(1, ceil(total / 100)) as bigint) as pages
from (select *, count(*) over () as total from v_submissions order by created_at desc, submission_id limit 100 offset 200)""")
def _(t):
    return R.page_of(t.v_submissions, R.newest_first("submission_id"), 3, 100).select("submission_id", "total", "page", "page_size", "pages")


@query("b16_submission_with_relations", "v_submissions v_documents v_users", sql="""
select s.submission_id, ua.full_name as assigned_name, uc.full_name as creator_name, ordinal, document_id, original_filename, document_type
 from v_submissions s left join v_users ua on s.assigned_to = ua.user_id left join v_users uc on s.created_by = uc.user_id
  left join (select *, row_number() over (partition by submission_id order by document_id) as ordinal from v_documents) d using (submission_id)""")
def _(t):
    return R.with_documents(t.v_submissions, t.v_documents, t.v_users).select(
        "submission_id", "assigned_name", "creator_name", "ordinal", "document_id", "original_filename", "document_type")


@query("b17_dashboard", "v_submissions", sql="""
select status, count(*) as n_submissions, (select count(*) from v_submissions) as total from v_submissions group by status""")
def _(t):
    return R.dashboard(t.v_submissions)


@query("b17_newest", "v_submissions", sql="select submission_id, status from v_submissions order by created_at desc, submission_id limit 5")
def _(t):
    return R.recent(t.v_submissions).select("submission_id", "status")
