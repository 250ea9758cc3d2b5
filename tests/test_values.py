import datetime as dt

import pytest
from pyspark.sql import functions as F

from bindery.functions import text as X, values as V
from bindery.functions.similarity import ratio


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


CURRENCY = [(None, None), ("", None), ("0", 0.0), ("5M", 5e6), ("2.5k", 2500.0), ("$1,000.50", 1000.5), ("1 000", 1000.0), ("1 000", 1000.0),
            ("-3", -3.0), ("5d", None), ("5f", None), ("1e3", 1000.0), ("abc", None), ("M", None), ("1_000", 1000.0), (".5", 0.5), ("5.", 5.0)]


def test_currency(spark):
    assert column(spark, [v for v, _ in CURRENCY], V.parse_currency) == [x for _, x in CURRENCY]


DATES = [("03/04/2024", dt.date(2024, 3, 4)), ("13/04/2024", dt.date(2024, 4, 13)), ("3-4-2024", dt.date(2024, 3, 4)), ("2024-02-30", None),
         ("2024-2-9", dt.date(2024, 2, 9)), ("3/4/75", dt.date(1975, 3, 4)), ("3/4/24", dt.date(2024, 3, 4)), ("3/4/68", dt.date(2068, 3, 4)),
         ("3/4/69", dt.date(1969, 3, 4)), ("March 4, 2024", dt.date(2024, 3, 4)), ("march  4,  2024", dt.date(2024, 3, 4)),
         (" 03/04/2024 ", dt.date(2024, 3, 4)), ("31/12/2023", dt.date(2023, 12, 31)), ("n/a", None), ("", None), (None, None), ("0000-01-01", None)]


def test_dates(spark):
    assert column(spark, [v for v, _ in DATES], V.parse_date) == [x for _, x in DATES]


def test_unwrap(spark):
    cases = [('{"value": null}', None), ('{"value": "A"}', "A"), ('{"value": 0}', "0"), ('{"value": ["GL", "P"]}', '["GL","P"]'), ('{"a": 1}', '{"a":1}'),
             ("plain", "plain"), ("null", None), (None, None), ('"x"', "x")]
    got = column(spark, [v for v, _ in cases], V.unwrap)
    assert [g.replace(" ", "") if g and g[0] in "[{" else g for g in got] == [x for _, x in cases]


def test_zero_is_only_the_number(spark):
    assert column(spark, ['{"value": 0}', '{"value": "0"}', '{"value": 0.0}', '{"value": 3}', None], V.is_zero) == [True, False, True, False, False]


def test_normalise_string(spark):
    assert column(spark, ["  Acme, Inc. ", "Café — Ünïted  Co", None, "!!!"], V.normalise_string) == ["acme inc", "café ünïted co", "", ""]


def test_plain_texts_are_normalised_like_others(spark):
    pieces = ["a", "B9", "_", " ", "  ", "\n", "\t", "\u00a0", "-", "$", "^`|~", "é", "ß", "—", "½", "a b"]
    values = [x + y + z for x in pieces for y in pieces for z in pieces]
    def slow(c):
        return X.strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""), rf"(?U){X.SPACE}+", " "))
    assert column(spark, values, V.normalise_string) == column(spark, values, slow)


@pytest.mark.parametrize("name", ["annual_revenue", "loss_count_3yr", "fein", "o'neil_x", "a__b"])
def test_title_case(spark, name):
    assert column(spark, [name], X.title_case) == [name.replace("_", " ").title()]


def brute_clean(text):
    if not text:
        return ""
    out, blanks = [], 0
    for line in text.splitlines():
        line = line.rstrip()
        blanks = 0 if line else blanks + 1
        if line or blanks <= 2:
            out.append(line)
    return "\n".join(out).strip()


def test_clean_text(spark):
    texts = [None, "", "a  \nb", "a\n\n\n\n\nb", "a\r\nb\rc", "\n\n a \n \n\t\n \n\nb\n", "x y", "a\n\n\nb", "  lead\n\n"]
    assert column(spark, texts, X.clean_text) == [brute_clean(t) for t in texts]


def test_similarity_examples():
    assert ratio("acme roofing", "acme roofing inc") == pytest.approx(0.857, abs=1e-3)
    assert ratio("acme roofing", "borealis foods") < 0.8
    assert ratio(None, "x") is None


def test_literal_prefixes_never_hide_a_match():
    import re
    from bindery import fixed
    samples = ["from: a", "dear x", "loss  history", "claim history", "claims history", "unaudited", "drivers license", "driver's licence", "vin ", "@a.bc",
               "blanket limit", "state id", "expiry date", "workers comp", "self-insured retention", "identification card", "profit & loss"]
    for rule in fixed.CLASSIFICATION_RULES:
        for p in [*rule[1], *rule[2], *rule[3]]:
            prefixes = X.literal_prefixes(p)
            for s in samples:
                if re.search(p, s) and prefixes is not None:
                    assert any(x in s for x in prefixes), (p, s)
