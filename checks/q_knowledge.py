"""Knowledge base and retrieval."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from bindery.functions.text import is_blank
from bindery.functions.vectors import encode
from bindery.operators import ingest as I, knowledge as K, vector_index as VI
from bindery.session import shared_dir
from checks.registry import query

WORDS = ("worded", r"""select *, len(w) as n from (select *, string_split_regex(trim(text, E' \n\r\t'), '\s+') as w from v_knowledge_documents where trim(text, E' \n\r\t') <> '')""")
CHUNKS = ("chunked", r"""select document_id, title, category, version, effective_date, i as chunk_index,
   case when n < 20 then trim(text, E' \n\r\t') else array_to_string(w[i * 360 + 1 : i * 360 + 400], ' ')
      || case when merges and i = windows - 1 then ' ' || array_to_string(w[windows * 360 + 1 : n], ' ') else '' end end as chunk_text,
   case when n >= 20 then i * 360 end as word_start, case when n >= 20 then least(i * 360 + 400, n) end as word_end,
   case when n < 20 then text else array_to_string(w[i * 360 + 1 : i * 360 + 400], ' ') end as section_source
  from (select *, unnest(generate_series(0, windows - 1)) as i from (
     select *, case when merges then opened - 1 else opened end as windows from (
       select *, n - (opened - 1) * 360 < 20 and opened > 1 as merges from (
         select *, cast(ceil(n / 360.0) as bigint) as opened from worded))))""")


def chunked(t):
    return K.chunk_texts(t.v_knowledge_documents)


@query("h01_chunk_texts", "v_knowledge_documents", [WORDS, CHUNKS],
       "select document_id, chunk_index, chunk_text, word_start, word_end from chunked")
def _(t):
    return chunked(t).select("document_id", "chunk_index", "chunk_text", "word_start", "word_end")


HEADING = r"""(trim(x) like '# %' or trim(x) like '## %' or (upper(trim(x)) = trim(x) and lower(trim(x)) <> trim(x) and length(trim(x)) between 6 and 79))"""


@query("h02_chunk_section", "v_knowledge_documents", [WORDS, CHUNKS], rf"""
select document_id, chunk_index, case when h like '# %' or h like '## %' then trim(ltrim(h, '#')) else h end as section
from (select *, trim(list_filter(string_split(section_source, chr(10)), lambda x: {HEADING})[1]) as h from chunked)""")
def _(t):
    return chunked(t).select("document_id", "chunk_index", "section")


@query("h03_chunk_metadata", "v_knowledge_documents", [WORDS, CHUNKS], """
select document_id, chunk_index, 'demo-encoder' as embedding_model, title, category, version, cast(effective_date as varchar) as effective_date from chunked""")
def _(t):
    return K.with_metadata(chunked(t), "demo-encoder").select("document_id", "chunk_index", "embedding_model", "chunk_metadata.*")


def hashing_encoder():
    """A stand-in encoder: word counts hashed into 32 dimensions."""
    def run(texts):
        out = np.zeros((len(texts), 32))
        for i, text in enumerate(texts):
            for word in text.split():
                out[i, hashlib.md5(word.encode()).digest()[0] % 32] += 1
        return out
    return run


@query("h04_embed_chunks", "v_knowledge_documents", [WORDS, CHUNKS], r"""
select document_id, chunk_index, dimension, cast(cast(n / sqrt(sum(n * n) over (partition by document_id, chunk_index)) as float) as double) as value from (
  select document_id, chunk_index, cast('0x' || left(md5(word), 2) as int) % 32 as dimension, count(*) as n
  from (select document_id, chunk_index, unnest(regexp_extract_all(chunk_text, '\S+')) as word from chunked) group by all)""")
def _(t):
    vectors = encode(chunked(t).select("document_id", "chunk_index", "chunk_text"), "chunk_text", hashing_encoder)
    return vectors.select("document_id", "chunk_index", F.posexplode("embedding").alias("dimension", "value")).filter("value != 0") \
        .withColumn("value", F.col("value").cast("double"))


@query("h05_build_index", "v_knowledge_documents v_knowledge_chunks", sql="""
select chunk_id, document_id, chunk_index, title, version, len(embedding) as dimensions from v_knowledge_chunks join v_knowledge_documents using (document_id)
where status = 'ACTIVE' and is_indexed and embedding is not null""")
def _(t):
    index = K.build_index(t.v_knowledge_chunks, t.v_knowledge_documents, shared_dir(t.spark, "index"))
    return index.select("chunk_id", "document_id", "chunk_index", "title", "version", F.size("embedding").cast("long").alias("dimensions"))


ELIGIBLE = ("eligible", """select * from v_knowledge_chunks join v_knowledge_documents using (document_id) where status = 'ACTIVE' and is_indexed and embedding is not null""")
SCORED = ("hits", """select *, round(score, 4) as similarity from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (
   select query_id, chunk_id, document_id, chunk_text, section, title, version, round(list_dot_product(cast(embedding as double[]), cast(query_embedding as double[])), 7) as score from eligible, v_queries))
  where rank <= 5 and score >= 0.3""")


def index(t):
    return K.eligible_chunks(t.v_knowledge_chunks, t.v_knowledge_documents)


def one_query(t):
    first = t.v_queries.orderBy("query_id").limit(1).collect()[0]
    return list(first.query_embedding)


@query("h06_search_one", "v_knowledge_documents v_knowledge_chunks v_queries", [ELIGIBLE, SCORED],
       "select chunk_id, document_id, similarity from hits where query_id = (select min(query_id) from v_queries)")
def _(t):
    return K.search(index(t), one_query(t)).select("chunk_id", "document_id", "similarity")


def hits(t):
    return K.search_batch(index(t), t.v_queries)


@query("h07_search_batch", "v_knowledge_documents v_knowledge_chunks v_queries", [ELIGIBLE, SCORED],
       "select query_id, rank, chunk_id, similarity from hits")
def _(t):
    return hits(t).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "similarity")


@query("h05_clustered_index", "v_knowledge_documents v_knowledge_chunks", [ELIGIBLE], "select count(*) as n_vectors, true as all_within from eligible")
def _(t):
    """Every eligible vector is in one cluster, and no farther from its centroid than the radius says."""
    chunks = index(t)
    made = VI.build(chunks)
    members = made.blocks.select("cluster", F.explode("ids").alias("chunk_id")).join(chunks.select("chunk_id", "embedding"), "chunk_id").join(F.broadcast(made.clusters), "cluster")
    apart = F.sqrt(F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    return members.agg(F.count(F.lit(1)).alias("n_vectors"), F.bool_and(apart <= F.col("radius") + 1e-6).alias("all_within"))


@query("h07_search_by_index", "v_knowledge_documents v_knowledge_chunks v_queries", [ELIGIBLE, SCORED],
       "select query_id, rank, chunk_id, similarity from hits")
def _(t):
    found = VI.search(VI.build(index(t)), t.v_queries)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "similarity")


@query("h07_string_ids", "v_knowledge_documents v_knowledge_chunks v_queries", [ELIGIBLE, SCORED],
       "select 'q' || lpad(cast(query_id as varchar), 12, '0') as query_id, rank, 'c' || lpad(cast(chunk_id as varchar), 12, '0') as chunk_id, similarity from hits")
def _(t):
    def text(c, letter):
        return F.concat(F.lit(letter), F.lpad(F.col(c).cast("string"), 12, "0")).alias(c)

    chunks = index(t).withColumn("chunk_id", text("chunk_id", "c"))
    found = K.search_batch(chunks, t.v_queries.select(text("query_id", "q"), "query_embedding"))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "similarity")


@query("h08_assemble_context", "v_knowledge_documents v_knowledge_chunks v_queries", [ELIGIBLE, SCORED], """
select query_id, coalesce(context, '') as context from v_queries left join (select query_id,
   string_agg('[' || cast(rank as varchar) || '] ' || title || ' ' || version || ' — ' || coalesce(section, 'Section Unknown') || chr(10) || chunk_text, chr(10) || chr(10) order by rank) as context
  from hits group by query_id) using (query_id)""")
def _(t):
    return K.context_for(t.v_queries, hits(t))


@query("h09_search_preview", "v_knowledge_documents", [WORDS, CHUNKS], """
select document_id, chunk_index, case when length(chunk_text) > 300 then substring(chunk_text, 1, 300) || '...' else chunk_text end as chunk_text from chunked""")
def _(t):
    return K.search_preview(chunked(t)).select("document_id", "chunk_index", "chunk_text")


@query("h10_approve_and_index", "v_knowledge_documents", [WORDS, CHUNKS], """
select document_id, case when d.status = 'DRAFT' then 'ACTIVE' else d.status end as status, coalesce(n, 0) as chunk_count, coalesce(n, 0) > 0 as is_indexed
from v_knowledge_documents d left join (select document_id, count(*) as n from chunked group by document_id) using (document_id)""")
def _(t):
    docs = t.v_knowledge_documents
    drafts = docs.filter("status = 'DRAFT'").select("document_id", F.lit(1).alias("approved_by"))
    return K.index_state(K.approve(docs, drafts), chunked(t)).select("document_id", "status", "chunk_count", "is_indexed")


@query("h10_replace_chunks", "v_knowledge_documents v_knowledge_chunks", [WORDS, CHUNKS], """
select document_id, chunk_index, chunk_text from v_knowledge_chunks where document_id not in (select document_id from v_knowledge_documents where status = 'DRAFT')
union all select document_id, chunk_index, chunk_text from chunked where document_id in (select document_id from v_knowledge_documents where status = 'DRAFT')""")
def _(t):
    drafts = t.v_knowledge_documents.filter("status = 'DRAFT'")
    columns = ["document_id", "chunk_index", "chunk_text"]
    return K.replace_chunks(t.v_knowledge_chunks.select(*columns), K.chunk_texts(drafts).select(*columns), drafts)


@query("h10_delete_documents", "v_knowledge_documents v_knowledge_chunks", sql="""
select chunk_id from v_knowledge_chunks where document_id not in (select document_id from v_knowledge_documents where status = 'ARCHIVED')""")
def _(t):
    return K.delete_documents(t.v_knowledge_chunks, t.v_knowledge_documents.filter("status = 'ARCHIVED'")).select("chunk_id")


@query("h11_knowledge_text", "v_pages", sql="""
select document_id, string_agg(text, chr(10) || chr(10) order by page_number) as text from v_pages where trim(text) <> '' group by document_id""")
def _(t):
    texts = I.assemble_documents(t.v_pages).select("document_id", F.col("full_text").alias("text"))
    return texts.filter(~is_blank("text"))
