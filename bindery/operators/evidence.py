"""Where in a document a quoted passage stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindery import fixed
from bindery.functions.grams import folded, grams, grams_of_map, place_of, similar_windows, tier_of
from bindery.functions.text import is_blank, strip
from bindery.session import shared_dir

BLOCK = 32  # citations that a page meets at a time
LOCATED = ["document_id", "field_name", "source_text", "page_number", "section", "matched_text", "match_method", "confidence"]


def find_heading(text: Column, citation: Column) -> Column:
    """Nearest heading above the citation on its page.

    Lines are walked upwards: ``#``, ``##``, ``###`` lines and all-capital
    alphabetic lines of 4 or more characters are headings; another line of more
    than 80 characters ends the search.
    """
    at = F.instr(F.lower(text), F.lower(citation))
    before = F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0)))
    lines = F.reverse(F.transform(F.split(before, "\n"), strip))

    def heading(s: Column) -> Column:
        marked = s.rlike("^#{1,3} ")
        letters = F.replace(s, F.lit(" "), F.lit(""))
        capital = (F.length(s) >= 4) & (F.upper(s) == s) & (F.lower(s) != s) & letters.rlike(r"^\p{L}+$")
        return F.when(marked, strip(F.regexp_replace(s, "^#+", ""))).when(capital, s)

    start = F.struct(F.lit(None).cast("string").alias("found"), F.lit(False).alias("stopped"))

    def step(state: Column, s: Column) -> Column:
        done = state.found.isNotNull() | state.stopped
        return F.when(done, state).otherwise(F.struct(
            heading(s).alias("found"), (heading(s).isNull() & (F.length(s) > 80)).alias("stopped")))

    return F.when(at > 0, F.aggregate(lines, start, step).found)


def _keyed(citations: DataFrame) -> DataFrame:
    """Citations with _cite, a short key of their text, and _citation, the text to look for (null if blank)."""
    return citations.withColumns({"_cite": F.md5(F.coalesce("source_text", F.lit(""))),
                                  "_citation": F.when(~is_blank("source_text"), strip("source_text"))})


KEY = ["document_id", "_cite"]


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder, where several branches read it."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def page_index(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """Inverted index of page grams: (document_id, tier, gram, page_number), of the grams that citations have.

    ``wanted``: document_id, tier, gram. A page gives the few grams that its
    document's citations can ask for: those of the tiers of their lengths, and of
    neighbouring grams only the one with the smallest hash. A bitmap of fixed size
    for each document leaves out most grams that no citation has before they move;
    in a document with very many citations it leaves out fewer.
    """
    return _postings(wanted, pages).join(wanted.distinct(), ["document_id", "tier", "gram"], "left_semi")


def _postings(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    asked = wanted.groupBy("document_id").agg(F.collect_set("tier").alias("_tiers"),  # at most one entry for each tier
                                              F.bitmap_construct_agg(place_of("gram")).alias("_map"))
    keyed = pages.select("document_id", "page_number", folded("text").alias("_text")).join(asked, "document_id")
    return keyed.select("document_id", "page_number", F.inline(grams_of_map("_text", "_tiers", "_map")))


def candidate_pages(keyed: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, _cite, page_number): for each citation the pages that hold its rarest gram; every page with the citation is among them."""
    cites = keyed.filter("_citation is not null").select(*KEY, folded("_citation").alias("_text")).distinct()
    tiers = F.array(tier_of(F.length("_text")))
    wanted = written(cites.select(*KEY, F.inline(grams("_text", tiers))), "citation-grams")
    postings = written(page_index(wanted.select("document_id", "tier", "gram"), pages), "page-grams")
    counts = postings.groupBy("document_id", "tier", "gram").agg(F.count(F.lit(1)).alias("_n"))
    # a gram that no page holds is the rarest of all: the citation is nowhere
    met = wanted.join(counts, ["document_id", "tier", "gram"], "left")
    rarest = met.groupBy(*KEY).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "tier", "gram")).alias("r")) \
        .filter("r.n > 0").select(*KEY, "r.tier", "r.gram")
    return rarest.join(postings, ["document_id", "tier", "gram"]).select(*KEY, "page_number")


def _locate(keyed: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, _cite, page_number, exact): the first page with the text as it is, else the first ignoring case.

    A citation, once however often it is quoted, meets the pages that hold its rarest gram.
    """
    wanted = keyed.filter("_citation is not null").select(*KEY, "_citation").distinct()
    met = candidate_pages(keyed, pages).join(wanted, KEY).join(pages.select("document_id", "page_number", "text"), ["document_id", "page_number"])
    loose = met.filter(F.contains(F.lower("text"), F.lower("_citation")) | F.contains("text", F.col("_citation")))
    hits = loose.select(*KEY, "page_number", F.contains("text", F.col("_citation")).alias("exact"))
    return written(hits.groupBy(*KEY).agg(F.min(F.struct((~F.col("exact")).alias("loose"), "page_number")).alias("h")).select(
        *KEY, "h.page_number", (~F.col("h.loose")).alias("exact")), "located")


def _placed(found: DataFrame, pages: DataFrame, columns: list[str]) -> DataFrame:
    """``found`` (with page_number and matched_text) and the section on the one page that was found."""
    page = pages.select("document_id", "page_number", F.col("text").alias("_text"))
    return found.join(page, ["document_id", "page_number"], "left").withColumn(
        "section", find_heading(F.col("_text"), F.col("matched_text"))).select(*columns)


def locate_verbatim(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """Citations found exactly or, failing that, ignoring case."""
    keyed = _keyed(citations)
    found = keyed.join(_locate(keyed, pages), KEY).select(
        "document_id", "field_name", "source_text", "page_number", F.col("_citation").alias("matched_text"),
        F.when(F.col("exact"), "exact").otherwise("case_insensitive").alias("match_method"), F.when(F.col("exact"), 1.0).otherwise(0.9).alias("confidence"))
    return _placed(found, pages, LOCATED)


def fuzzy_matches(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, _cite, page_number, window, ratio): the window of at least 0.75 similarity, the first one on ties.

    ``wanted``: document_id, _cite, _citation. Windows of max(length, 300)
    characters begin every quarter window. A page meets the citations of its
    document in blocks of about ``BLOCK``; which windows can reach the ratio is
    counted over the places of characters and pairs, and only those are cut.
    """
    long_ = wanted.filter(F.length("_citation") >= fixed.FUZZY_MIN_CITATION)
    blocks = long_.groupBy("document_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    dealt = long_.join(blocks, "document_id").withColumn("_block", F.pmod(F.xxhash64("_cite"), "_blocks"))
    passages = dealt.groupBy("document_id", "_block").agg(F.collect_list(F.struct(F.col("_cite").alias("key"), F.col("_citation").alias("passage"))).alias("_passages"))
    met = pages.filter(F.length("text") > 0).select("document_id", "page_number", "text").join(passages, "document_id")
    similar = similar_windows(fixed.FUZZY_WINDOW, fixed.FUZZY_MIN_RATIO)
    scored = met.select("document_id", "page_number", F.inline(similar("_passages", "text"))).withColumnRenamed("key", "_cite")
    return scored.groupBy(*KEY).agg(F.max_by(F.struct("page_number", "window", "ratio"), F.struct(
        "ratio", (-F.col("page_number")).alias("p"), (-F.col("start")).alias("s"))).alias("best")).select(*KEY, "best.*")


def map_citations(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """All non-empty citations with page, section, method and confidence.

    ``match_method``: exact, case_insensitive, fuzzy or not_found.
    """
    keyed = _keyed(citations.filter("source_text <> ''"))
    found = _locate(keyed, pages)
    still = keyed.filter("_citation is not null").select(*KEY, "_citation").distinct().join(found, KEY, "left_anti")
    fuzzy = fuzzy_matches(still, pages).withColumnRenamed("page_number", "_fuzzy_page")
    looked = keyed.join(found, KEY, "left").join(fuzzy, KEY, "left")
    hit, near = F.col("page_number").isNotNull(), F.col("_fuzzy_page").isNotNull()
    placed = looked.select(
        "document_id", "field_name", "source_text", F.coalesce("page_number", "_fuzzy_page").alias("page_number"),
        F.when(hit, F.col("_citation")).otherwise(F.col("window")).alias("matched_text"),
        F.when(F.col("exact"), "exact").when(hit, "case_insensitive").when(near, "fuzzy").otherwise("not_found").alias("match_method"),
        F.when(F.col("exact"), 1.0).when(hit, 0.9).otherwise(F.coalesce(F.round("ratio", 3), F.lit(0.0))).alias("confidence"))
    return _placed(placed, pages, LOCATED)
