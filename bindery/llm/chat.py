"""Quotation linking: who answers whom, and conversations in reply order without their quotes.

Lines that start with '>' are quotes, as deep as they have such marks. Runs of
quoted lines of one depth are passages; a passage, its paragraphs, its lines and
its sentences are normalised and hashed, at every depth, and meet the hashes of
what earlier messages of the conversation said in their own words. Everything is
column expressions, joins and aggregations; hashes of own words are reduced to
their first message before anything is joined, so a text that a conversation
repeats a thousand times is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindery.llm.common import written

#: Quote marks at the start of a line, and the line that introduces a quote.
MARKS = r"^\s{0,3}((?:>[ \t]?)+)"
INTRO = r"(?i)^[^\n]{0,200}\b(?:wrote|said|writes|schrieb|escribió|a écrit)\b[^\n]{0,20}:\s*$"


def _depth(line: Column) -> Column:
    return F.regexp_count(F.regexp_extract(line, MARKS, 1), F.lit(">"))


def _norm(text: Column) -> Column:
    """Letters and digits in lower case, anything else one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _hash(normal: Column) -> Column:
    return F.sha2(normal, 256)


def parse(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per message: conv, turn, role, own (text without quotes and their introductions), lines (depth, text of each line)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.transform(F.split(text, r"\r\n?|\n", -1), lambda x: F.struct(_depth(x).alias("depth"), F.regexp_replace(x, MARKS, "").alias("line")))
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), text.alias("text"))
    plain = ~F.col("text").contains(">")
    rows = rows.withColumn("lines", F.when(~plain, lines.alias("lines")).otherwise(F.array().cast("array<struct<depth:int,line:string>>")))
    following = F.expr("slice(lines, 2, size(lines))")
    introduces = F.zip_with("lines", following, lambda x, y: F.struct(
        x["depth"].alias("depth"), x["line"].alias("line"), (F.coalesce(y["depth"], F.lit(0)) > 0).alias("intro")))
    kept = F.filter(introduces, lambda x: (x["depth"] == 0) & ~(x["intro"] & x["line"].rlike(INTRO)))
    own = F.when(plain, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return rows.withColumn("own", F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")).drop("text")


def _parts(text: Column) -> Column:
    """Normalised pieces by which a text may be quoted: whole, by paragraph, by line, by sentence."""
    sentences = F.split(F.regexp_replace(text, r"\n+", " "), r"(?<=[.!?])\s+")
    pieces = F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n"), sentences)
    return F.filter(F.array_distinct(F.transform(pieces, _norm)), lambda x: x != "")


def passages(parsed: DataFrame) -> DataFrame:
    """(conv, turn, depth, passage): runs of quoted lines of one depth, in their lines."""
    quoting = parsed.filter(F.exists("lines", lambda x: x["depth"] > 0))
    # the first line of each run, then the lines up to the next; built inside the array, so only passages cross the explode
    at = F.expr("filter(transform(lines, (x, i) -> if(i = 0 or get(lines, i - 1).depth != x.depth, i, null)), x -> x is not null)")
    starts = quoting.select("conv", "turn", "lines", at.alias("at"))
    run = F.transform("at", lambda first, k: F.struct(F.get("lines", first)["depth"].alias("depth"), F.array_join(F.transform(
        F.slice(F.col("lines"), first + 1, F.coalesce(F.get(F.col("at"), k + 1), F.size("lines")) - first), lambda x: x["line"]), "\n").alias("passage")))
    return starts.select("conv", "turn", F.explode(F.filter(run, lambda r: r["depth"] > 0)).alias("p")).select("conv", "turn", "p.*")


def quotations(parsed: DataFrame) -> DataFrame:
    """Per message, depth and earlier message whose words stand there: conv, turn, depth, source, pieces (found ones).

    A piece belongs to the first message of the conversation that said it, if that
    is an earlier one.
    """
    asked = passages(parsed).filter("conv is not null and turn is not null") \
        .select("conv", "turn", "depth", F.explode(_parts(F.col("passage"))).alias("words")).select("conv", "turn", "depth", _hash(F.col("words")).alias("hash"))
    asked = written(asked.distinct(), "quoted")
    # own words of conversations that quote at all
    busy = asked.select("conv").distinct()
    said = parsed.filter("conv is not null and turn is not null").select("conv", "turn", "own").join(busy, "conv", "left_semi")
    said = said.select("conv", "turn", F.explode(_parts(F.col("own"))).alias("words"))
    first = said.groupBy("conv", _hash(F.col("words")).alias("hash")).agg(F.min("turn").alias("source"))
    found = asked.join(first, ["conv", "hash"]).filter("source < turn")
    return found.groupBy("conv", "turn", "depth", "source").agg(F.count(F.lit(1)).alias("pieces"))


def link(quoted: DataFrame) -> DataFrame:
    """Per message that quotes an earlier one: conv, turn, reply_to, linked (pieces found at all depths), quoted_turns.

    The shallowest depth at which anything is found names the message that is
    answered: the one that most pieces come from, the latest of equals. Deeper
    quotes were the words of others when that message was written; they are linked
    to their own originals. ``quoted_turns`` lists depth:turn pairs in order.
    """
    rank = F.struct((-F.col("depth")).alias("shallow"), "pieces", "source")
    # pairs of a message: as many as there are messages that it quotes
    pairs = F.transform(F.sort_array(F.collect_set(F.struct("depth", "source"))), lambda p: F.concat_ws(":", p["depth"].cast("string"), p["source"].cast("string")))
    return quoted.groupBy("conv", "turn").agg(F.max(rank).alias("b"), F.sum("pieces").alias("linked"), F.array_join(pairs, ",").alias("quoted_turns")) \
        .select("conv", "turn", F.col("b.source").alias("reply_to"), "linked", "quoted_turns")


def roots(links: DataFrame) -> DataFrame:
    """Per linked message the first message of its chain of answers: (conv, turn, root). Chains halve each round."""
    chain = written(links.select("conv", "turn", F.col("reply_to").alias("root")), "replies")
    while True:
        up = chain.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"))
        step = written(chain.join(up, ["conv", "root"], "left").select("conv", "turn", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        chain = step.select("conv", "turn", "root")
        if step.filter("moved").isEmpty():
            return chain


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per message: conv_id, turn, role, reply_to, thread_turn, n_quote_lines, n_linked, quoted_turns, text (own words), formatted.

    Ordered by (conv_id, thread_turn, turn) the messages are in reply order: an
    answer follows the message it quotes, after earlier answers to the same
    thread. ``thread_turn`` is the turn of the message that the chain of quotes
    starts with, for a message that quotes nothing earlier its own turn.
    ``formatted`` is the message in the form "<|role|>\\ntext".

    A null text is empty; a null role is "unknown"; messages with a null
    conversation or turn are linked with nothing. Several messages of one turn
    share the link of the turn; their quotes count together. An empty table gives no rows. Other columns are
    not read.
    """
    parsed = parse(messages, conv_col, turn_col, role_col, text_col)
    links = written(link(quotations(parsed)), "links")
    chains = links.join(roots(links), ["conv", "turn"])
    role = F.coalesce("role", F.lit("unknown"))
    n_quotes = F.size(F.filter("lines", lambda x: x["depth"] > 0))
    rows = parsed.select("conv", "turn", "role", "own", n_quotes.cast("long").alias("n_quote_lines"))
    return rows.join(chains, ["conv", "turn"], "left").select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "reply_to", F.coalesce("root", "turn").alias("thread_turn"),
        "n_quote_lines", F.coalesce("linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("quoted_turns", F.lit("")).alias("quoted_turns"), F.col("own").alias(text_col),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("own")).alias("formatted"))
