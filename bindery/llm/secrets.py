"""Secret scans: pattern candidates, then a random forest that removes false positives.

Everything is a column expression. A text is cut at its candidates, so gaps and
matches give each candidate its place and its neighbours. The forest is trained
by Spark's own trainer on labelled findings and then written out as one
expression of its splits, which runs beside the other built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery.llm.common import written

#: What may be a secret - a long run of token characters, what follows "=", or a quoted value.
CANDIDATE = r"""[A-Za-z0-9+/_.~-]{16,}(?:={1,2}(?![A-Za-z0-9+/=_.~-]))?|(?<==)[A-Za-z0-9+/_.~-]{8,}(?:={1,2}(?![A-Za-z0-9+/=_.~-]))?|(?<=["'])[^\s"']{8,}+(?=["'])"""
NAME = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)"
#: Words before a value that name a credential, as the text ends before the value.
ASSIGNED = rf"""(?i){NAME}\w*["']?\s*[:=]+\s*["']?$"""
#: The value after such a name, of six characters or more, quoted or up to the next blank; before it, a cheap
#: look at the last characters. Only Java's expressions look behind over parts of any length.
AFTER_NAME = (r"""(?:(?<=[:=])|(?<=[:=]["'])|(?<=[:=]\s)|(?<=[:=]\s["'])|(?<=\s\s)(?<=[:=]\s{2,20})|(?<=\s\s["'])(?<=[:=]\s{2,20}["']))"""
              rf"""(?<=(?i:{NAME})\w{{0,40}}["']?\s{{0,20}}[:=]{{1,3}}\s{{0,20}}["']?)"""
              r"""(?:(?<=")[^"\r\n]{6,128}(?=")|(?<=')[^'\r\n]{6,128}(?=')|(?![:=])(?:[^\s"'&]{6,}(?=&\w{1,40}=)|[^\s"']{5,}[^\s"',;.)\]}>]|(?!["'])\S{5,}[^\s"',;.)\]}>]))""")
PATTERN = f"{AFTER_NAME}|{CANDIDATE}"
NEAR = 100  # characters beside a value that are looked at; a name and its value are never further apart in PATTERN
#: Tokens that their form alone gives away.
FORMS = (r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|"
         r"AIza[A-Za-z0-9_-]{35}|[spr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)$")
#: Frequent letter pairs of the languages at hand, a small dictionary of word parts.
PAIRS = ("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li "
         "ch ei ie sc un ge be el la qu ue ai au ci os ad ll do ta").split()
TRAIN_ROWS = 20_000  # labelled findings the forest is fitted on, those with the smallest hashes
TREES, DEPTH, SEED = 15, 5, 7
MARKER = "<SECRET>"
FEATURES = ("length", "digit_share", "upper_share", "mark_share", "transitions", "coverage", "distinct_share", "hex_only", "has_slash",
            "assigned", "quoted", "words_before", "words_after")


def features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Length, character transitions, dictionary coverage, path, and the neighbouring words."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")

    def count(pattern: str, of: Column = value) -> Column:
        return F.regexp_count(of, F.lit(pattern)).cast("double")

    return {
        "length": n,
        "digit_share": count("[0-9]") / n,
        "upper_share": count("[A-Z]") / n,
        "mark_share": count("[^A-Za-z0-9]") / n,
        "transitions": count("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])") / n,
        "coverage": count("(?i)" + "|".join(PAIRS)) * 2 / n,
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hex_only": value.rlike("^[0-9a-fA-F]+$").cast("double"),
        "has_slash": count("/"),
        "assigned": before.rlike(ASSIGNED).cast("double"),
        "quoted": before.rlike("[\"']$").cast("double"),
        "words_before": count(r"\p{L}{2,}", before),
        "words_after": count(r"\p{L}{2,}", after),
    }


def _cut(text: Column) -> tuple[Column, Column]:
    """Matches, and the gaps around them (one more)."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.split(text, PATTERN, -1)


def _previous(matches: Column) -> Column:
    """Per match the one before it, which may hold the name of a credential."""
    return F.slice(F.concat(F.array(F.lit("")), matches), F.lit(1), F.size(matches))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per candidate of a whole text: id, place (from 0 in its text), start (characters before it), value, before, after."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).filter(F.col("_text").rlike(PATTERN)) \
        .withColumn("_row", F.monotonically_increasing_id())
    matches, gaps = _cut(F.col("_text"))
    near = F.transform(gaps, lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(NEAR)).alias("tail"), F.left(g, F.lit(NEAR)).alias("head")))
    rows = found.select("_id", "_row", matches.alias("_m"), near.alias("_g")).select("_id", "_row", F.posexplode(F.arrays_zip(
        F.col("_m").alias("value"), _previous(F.col("_m")).alias("last"), F.slice("_g", 1, F.size("_m")).alias("g"),
        F.slice("_g", 2, F.size("_m")).alias("h"))).alias("place", "c"))
    sofar = Window.partitionBy("_row").orderBy("place")
    ends = F.sum(F.col("c.g.n") + F.length("c.value")).over(sofar)
    return rows.select(F.col("_id").alias("doc_id"), "place", (ends - F.length("c.value")).alias("start"), F.col("c.value").alias("value"),
                       F.right(F.concat("c.last", "c.g.tail"), F.lit(NEAR)).alias("before"), F.col("c.h.head").alias("after"))


def label(found: DataFrame) -> DataFrame:
    """Labelled findings of a corpus without any. Secrets: values of a known form, and values assigned to a credential's
    name that mix letters with digits or symbols. None: values without digits or symbols, and, where no name is before
    them, numbers, dotted names and parts of addresses. Other candidates have no label."""
    value, assigned = F.col("value"), F.col("before").rlike(ASSIGNED)
    mixes = value.rlike("[0-9!#$%^&*@?]") & value.rlike("[A-Za-z]")
    usual = value.rlike(r"^[0-9.+/_~-]+$|^[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+$") | F.col("before").rlike("(?:@|://)$") | F.col("after").startswith("@")
    secret = F.when(value.rlike(FORMS) | (assigned & mixes), F.lit(1.0)).when(~value.rlike("[0-9]") | (~assigned & usual), F.lit(0.0))
    return found.withColumn("label", secret).filter("label is not null")


def train(docs: DataFrame, findings: DataFrame | None = None, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text"):
    """Fits the forest and returns ``score(value, before, after) -> Column``.

    ``findings`` (value, before, after, label) are labelled findings; without
    them those of ``label`` are used. The ``train_rows`` with the smallest
    hashes are fitted on; derived secrets also without their surroundings, so
    that the forest knows a bare token. A value of a known form scores 1. Where
    a class has no finding, a candidate scores 1 if it is assigned to a
    credential's name, else 0.
    """
    if findings is not None:
        labelled = findings
    else:
        # a token of 16 characters or more is told without its name, a password is not
        alone = F.when((F.col("label") == 1) & (F.length("value") >= 16), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        labelled = label(candidates(docs, id_col, text_col)).withColumn("_alone", F.explode(alone))
        labelled = labelled.select("value", *[F.when(F.col("_alone"), F.lit(" ")).otherwise(F.col(c)).alias(c) for c in ("before", "after")], "label")
    chosen = labelled.select("value", "before", "after", "label").orderBy(F.xxhash64("value", "before", "after"), "value", "before", "after").limit(train_rows)
    chosen = written(chosen.select("label", *[c.alias(n) for n, c in features(F.col("value"), F.col("before"), F.col("after")).items()]), "findings")
    classes = {r.label for r in chosen.select("label").distinct().collect()}
    if classes != {0.0, 1.0}:
        return lambda value, before, after: F.coalesce((value.rlike(FORMS) | before.rlike(ASSIGNED)).cast("double"), F.lit(0.0))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(chosen.coalesce(4))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(vectors)
    trees = [_splits(t._java_obj.rootNode()) for t in forest.trees]

    def score(value: Column, before: Column, after: Column) -> Column:
        known = features(value, before, after)
        # features once, then every tree looks them up
        row = F.array(F.struct(*[known[n].alias(n) for n in FEATURES]))
        voted = F.transform(row, lambda f: reduce(lambda a, b: a + b, [_expression(t, f) for t in trees]) / len(trees))[0]
        return F.when(value.rlike(FORMS), F.lit(1.0)).otherwise(voted)

    return score


def _splits(node):
    """A tree as (feature, threshold, left, right), its leaves as the share of secrets."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = node.impurityStats().stats()
        return float(stats[1]) / max(float(stats[0]) + float(stats[1]), 1e-9)
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _splits(node.leftChild()), _splits(node.rightChild())


def _expression(tree, row: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, threshold, left, right = tree
    return F.when(row[name] <= threshold, _expression(left, row)).otherwise(_expression(right, row))


def scan(docs: DataFrame, score, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per candidate: doc_id, place, start, length, value_sha256, score, is_secret.

    Null and blank texts and texts without candidates have no rows; a null id
    stays null; a repeated row repeats its findings. An empty table gives no
    rows. The value itself is not returned. Other columns are not read.
    """
    found = candidates(docs, id_col, text_col)
    rated = found.withColumn("score", score(F.col("value"), F.col("before"), F.col("after")))
    return rated.select(F.col("doc_id").alias(id_col), "place", F.col("start").cast("long").alias("start"), F.length("value").alias("length"),
                        F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), (F.col("score") >= least).alias("is_secret"))


def redact(docs: DataFrame, score, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``MARKER``; null texts stay null, other columns as they are."""
    text = F.col(text_col)
    matches, gaps = _cut(text)
    n = F.size(matches)
    around = F.arrays_zip(matches.alias("value"), _previous(matches).alias("last"), F.slice(gaps, F.lit(1), n).alias("g"), F.slice(gaps, F.lit(2), n).alias("h"))

    def piece(c: Column) -> Column:
        secret = score(c["value"], F.right(F.concat(c["last"], c["g"]), F.lit(NEAR)), F.left(c["h"], F.lit(NEAR))) >= least
        return F.concat(F.when(secret, F.lit(MARKER)).otherwise(c["value"]), c["h"])

    rebuilt = F.when(text.rlike(PATTERN), F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(around, piece), ""))).otherwise(text)
    return docs.withColumn(text_col, rebuilt)
