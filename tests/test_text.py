import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators.features import text_views
from inkwell.operators.terms import char_wb_ngrams, word_ngrams


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def features(spark, value, family):
    df = spark.createDataFrame([(value,)], "t string")
    return tx.with_features(df, "t", family).drop("t").first().asDict()


@pytest.mark.parametrize(
    "raw, want",
    [
        ("A&nbsp;b &amp; c", "A b & c"), ("ﬁne day\n x ", "fine day x"), (None, ""), ("", ""),
        ("plain  text", "plain text"), ("&lt;b&gt;", "<b>"),
    ],
)
def test_normalize_raw(spark, raw, want):
    assert one(spark, raw, tx.normalize_raw) == want


def test_cleaners(spark):
    raw = "Don't MISS: https://a.b/c?d=1 www.x.com Well-known!? É"
    assert one(spark, raw, tx.clean_strict) == "don t miss well known"
    assert one(spark, raw, tx.clean_light) == "don't miss well-known!?"
    assert one(spark, "A\t B", tx.clean_lower) == "a b"
    for cleaner in (tx.clean_strict, tx.clean_light, tx.clean_lower):
        once = one(spark, raw, cleaner)
        assert one(spark, once, cleaner) == once


def test_wide_style_features(spark):
    got = features(spark, "Sources: 'crisis' at UNO, U.S. says... Ok?", tx.style_features_18)
    assert got["scare_quote_count"] == 1 and got["ends_question"] == 1 and got["ellipsis_count"] == 1
    assert got["allcaps_word_count"] == 2  # "UNO," and "U.S."
    assert got["has_says"] == 1 and got["has_sources"] == 1 and got["has_report"] == 0
    assert got["n_words"] == 7
    # istitle: Sources:, Ok? and, because every letter run is one capital, U.S.
    assert got["title_case_ratio"] == pytest.approx(3 / 7)


def test_empty_and_null_texts(spark):
    for value in ("", None):
        got = features(spark, value, tx.style_features_16)
        assert got["n_words"] == 0 and got["starts_with_quote"] == 1 and got["mean_word_len"] == 0.0
        assert features(spark, value, tx.style_features_18)["n_words"] == 1


def test_title_case_follows_letter_runs(spark):
    words = {"It'S": 1, "It's": 0, "DON'T": 0, "Aa-Bb": 1, "3Rd": 1, "a": 0, "1": 0}
    for word, want in words.items():
        assert features(spark, word, tx.style_features_18)["title_case_ratio"] == want, word


def test_allcaps_counts_sharp_s_as_small(spark):
    assert features(spark, "STRAßE UNO", tx.style_features_16)["allcaps_word_ratio"] == 0.5


def test_eda_flags_use_unicode_word_bounds(spark):
    got = features(spark, "ÉTAT USA 'it' x", tx.eda_flags)
    assert got["caps3_word_count"] == 1 and got["has_single_quotes"] == 1


def test_stem_and_preview(spark):
    assert one(spark, "voting nations quickly reported", tx.stem) == "vot na quick report"
    assert one(spark, "abcdef ghij", lambda t: tx.preview(t, 8)) == "abcdef …"
    assert one(spark, "  ", tx.preview) == "(none)"


def test_word_dropout_keeps_short_texts(spark):
    key = F.lit(1)
    assert one(spark, "two words", lambda t: tx.word_dropout(t, key, 1.0)) == "two words"
    assert one(spark, "all of these go", lambda t: tx.word_dropout(t, key, 1.0)) == "all of these go"
    many = " ".join(f"w{i}" for i in range(2000))
    kept = len(one(spark, many, lambda t: tx.word_dropout(t, key, 0.1)).split())
    assert 1700 < kept < 1900


def test_ngrams(spark):
    assert one(spark, "The quick fox a", lambda t: word_ngrams(t, 1, 3)) == [
        "the", "quick", "fox", "the quick", "quick fox", "the quick fox",
    ]
    assert one(spark, "the big the", lambda t: word_ngrams(t, 2, 2, ["the"])) == []
    assert one(spark, "a xyzzy", char_wb_ngrams) == [
        " a ", " xy", "xyz", "yzz", "zzy", "zy ", " xyz", "xyzz", "yzzy", "zzy ", " xyzz", "xyzzy", "yzzy ",
    ]
    assert one(spark, "", lambda t: word_ngrams(t, 1, 2)) == []


def test_both_views_take_one_pass_through_python(spark):
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() or c in (0x180E, 0x200B, 0xFEFF))
    texts = [
        None, "", "  plain  Text\t\n", "A&nbsp;b &amp;amp;lt; c", "&amp;amp;amp;", "ﬁne&#10;&#x1c;day x", "É ß &copy www.a.b/&amp;x https://c.d?e=1 &lt",
        f"a{'b'.join(spaces)}&amp;{spaces}", "&am\rp; &#38; amp;", *[f"&amp;{i} é" for i in range(200)],
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(1)
    views = text_views(df, "t")
    raw = tx.normalize_raw(F.col("t"))
    want = df.withColumn("text", raw).withColumn("text_clean", tx.clean_strict(F.col("text")))
    assert sorted(views.collect()) == sorted(want.collect())
    assert views._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
