"""Guideline documents: listing, chunking, indexing, retrieval, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery import fixed
from bindery.functions.text import LINE_BREAK, SPACE, is_blank, preview, strip
from bindery.functions.vectors import block_top_k, dot
from bindery.operators.relational import filter_equal, newest_first, page_of


# --- listing and eligibility ------------------------------------------------
def list_documents(documents: DataFrame, *, status: str | None = None, category: str | None = None,
                   page: int = 1, page_size: int = 50, at: str = "effective_date") -> DataFrame:
    return page_of(filter_equal(documents, status=status, category=category), newest_first("document_id", at), page, page_size)


def eligible_documents(documents: DataFrame, as_of: str | None = None) -> DataFrame:
    """ACTIVE and indexed; with ``as_of`` also inside their effective window."""
    chosen = documents.filter("status = 'ACTIVE' and is_indexed")
    if as_of is None:
        return chosen
    day = F.lit(as_of).cast("date")
    chosen = chosen.filter(F.col("effective_date").isNull() | (F.col("effective_date") <= day))
    if "expiration_date" in documents.columns:
        chosen = chosen.filter(F.col("expiration_date").isNull() | (F.col("expiration_date") >= day))
    return chosen


def eligible_chunks(chunks: DataFrame, documents: DataFrame, as_of: str | None = None) -> DataFrame:
    """Embedded chunks of eligible documents, with what a citation needs."""
    docs = eligible_documents(documents, as_of).select("document_id", "title", "category", "version", "effective_date")
    return chunks.filter("embedding is not null").join(docs, "document_id")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_index").alias("first_chunk"),
                                             F.max("chunk_index").alias("last_chunk"))


# --- chunking ---------------------------------------------------------------
def _is_heading(line: Column) -> Column:
    s = strip(line)
    shouted = (F.upper(s) == s) & (F.lower(s) != s)
    return s.startswith("# ") | s.startswith("## ") | (shouted & (F.length(s) > 5) & (F.length(s) < 80))


def section_of(text: Column | str) -> Column:
    """First heading-like line, its marks removed."""
    lines = F.split(F.col(text) if isinstance(text, str) else text, LINE_BREAK)
    first = strip(F.get(F.filter(lines, _is_heading), F.lit(0)))
    marked = first.startswith("# ") | first.startswith("## ")
    return F.when(marked, strip(F.regexp_replace(first, "^#+", ""))).otherwise(first)


def chunk_texts(documents: DataFrame, text: str = "text", size: int = fixed.CHUNK_WORDS,
                overlap: int = fixed.CHUNK_OVERLAP, least: int = fixed.CHUNK_MIN_WORDS) -> DataFrame:
    """One row per word window: chunk_index, chunk_text, word_start, word_end, section. Narrow.

    A last window below ``least`` words is appended to the window before it; a
    whole text below ``least`` words is one chunk, trimmed. Blank texts yield none.
    The columns of ``documents`` other than the text come along.
    """
    stride = size - overlap
    words = F.split(strip(text), f"(?U){SPACE}+")
    n = F.size("_words")
    # a window opens at every stride below n; the last one is dropped if too short
    opened = F.ceil(n / stride).cast("int")
    tail = n - (opened - 1) * stride
    merges = (tail < least) & (opened > 1)
    kept = documents.filter(~is_blank(text)).withColumn("_words", words)
    staged = kept.withColumns({"_n": n, "_windows": F.when(merges, opened - 1).otherwise(opened), "_merges": merges})

    def window(i: Column) -> Column:
        """A chunk is cut inside the array: neither text nor words cross the explode."""
        start = i * stride
        joined = F.array_join(F.slice("_words", start + 1, F.lit(size)), " ")
        extra = F.array_join(F.slice("_words", F.col("_windows") * stride + 1, F.lit(size)), " ")
        whole = F.when(F.col("_merges") & (i == F.col("_windows") - 1), F.concat_ws(" ", joined, extra)).otherwise(joined)
        return F.struct(i.alias("chunk_index"), F.when(short, strip(text)).otherwise(whole).alias("chunk_text"),
                        F.when(~short, start).alias("word_start"), F.when(~short, F.least(start + size, F.col("_n"))).alias("word_end"),
                        F.when(short, strip(text)).otherwise(joined).alias("_head"))

    short = F.col("_n") < least
    columns = [c for c in documents.columns if c != text]
    rows = staged.select(*columns, F.explode(F.transform(F.sequence(F.lit(0), F.col("_windows") - 1), window)).alias("_c"))
    return rows.select(*columns, "_c.chunk_index", "_c.chunk_text", "_c.word_start", "_c.word_end", section_of(F.col("_c._head")).alias("section"))


def with_metadata(chunks: DataFrame, model: str) -> DataFrame:
    return chunks.withColumn("embedding_model", F.lit(model)).withColumn("chunk_metadata", F.struct(
        "title", "category", "version", F.col("effective_date").cast("string").alias("effective_date")))


# --- index and search -------------------------------------------------------
def build_index(chunks: DataFrame, documents: DataFrame, path: str) -> DataFrame:
    """Writes the searchable vectors as a table and returns it as read back."""
    (eligible_chunks(chunks, documents)
     .select("chunk_id", "document_id", "chunk_index", "chunk_text", "section", "title", "version", "embedding")
     .write.mode("overwrite").parquet(path))
    return chunks.sparkSession.read.parquet(path)


def search(index: DataFrame, query: list[float], top_k: int = fixed.TOP_K,
           min_similarity: float = fixed.MIN_SIMILARITY) -> DataFrame:
    """The ``top_k`` chunks most similar to one query vector; weak ones dropped."""
    if not 1 <= top_k <= 20:
        raise ValueError("top_k must be between 1 and 20")
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = index.withColumn("_score", F.round(dot("embedding", vector), 7))
    best = scored.orderBy(F.col("_score").desc(), "chunk_id").limit(top_k)
    return best.filter(F.col("_score") >= min_similarity).withColumn("similarity", F.round("_score", 4)).drop("_score")


def search_batch(index: DataFrame, queries: DataFrame, top_k: int = fixed.TOP_K,
                 min_similarity: float = fixed.MIN_SIMILARITY) -> DataFrame:
    """(query_id, rank, similarity, chunk columns) for every query of a batch."""
    found = block_top_k(queries.select("query_id", "query_embedding"), index.select("chunk_id", "embedding"),
                        top_k, min_similarity)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    return best.join(index.drop("embedding"), "chunk_id").withColumn("similarity", F.round("score", 4)).drop("score")


def assemble_context(hits: DataFrame) -> DataFrame:
    """Cited chunk texts of each query (at most top_k), joined by blank lines; '' without hits."""
    page = F.when(F.col("page_number") != 0, F.concat(F.lit(" (page "), F.col("page_number").cast("string"), F.lit(")"))) \
        if "page_number" in hits.columns else F.lit(None)
    cited = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("Unknown Document")), F.lit(" "),
                     F.coalesce("version", F.lit("")), F.coalesce(page, F.lit("")), F.lit(" — "),
                     F.coalesce(F.when(F.col("section") != "", F.col("section")), F.lit("Section Unknown")), F.lit("\n"), F.col("chunk_text"))
    parts = F.array_sort(F.collect_list(F.struct("rank", cited.alias("text"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p.text), "\n\n").alias("context"))


def context_for(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Every query with its context, empty where nothing was similar enough."""
    return queries.select("query_id").join(assemble_context(hits), "query_id", "left").fillna("", ["context"])


def search_preview(hits: DataFrame) -> DataFrame:
    return hits.withColumn("chunk_text", preview("chunk_text", fixed.PREVIEW_CHARS))


# --- lifecycle --------------------------------------------------------------
def approve(documents: DataFrame, approvals: DataFrame) -> DataFrame:
    """Documents named in ``approvals`` (document_id, approved_by) become ACTIVE whatever they were."""
    return documents.join(approvals.withColumn("_hit", F.lit(True)), "document_id", "left").withColumn(
        "status", F.when(F.col("_hit"), "ACTIVE").otherwise(F.col("status"))).drop("_hit")


def replace_chunks(chunks: DataFrame, fresh: DataFrame, documents: DataFrame) -> DataFrame:
    """Re-indexing: chunks of the re-indexed documents give way to the fresh ones."""
    return chunks.join(documents.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh)


def index_state(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """is_indexed and chunk_count of each document from its chunks."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.drop("is_indexed", "chunk_count").join(counts, "document_id", "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0))).withColumn("is_indexed", F.col("chunk_count") > 0)


def delete_documents(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    return chunks.join(removed.select("document_id").distinct(), "document_id", "left_anti")
