"""Counts inside the row, vocabularies with and without a lookup, vectors and singular directions, against plain Python and numpy."""

import collections
import math
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from inkwell.operators import counting as ct, features as ft
from inkwell.operators.counting import Analyzer

TEXTS = [
    "Storm hits the coast, the coast holds", "the market fell", None, "", "a b", "Coast to coast: the storm", "x" * 50 + " y1 y1 y1",
    "Ünder é日本 the coast", "the the the the", "one two three four five six seven",
]


def grams(text, analyzer):
    text = (text or "").lower()
    if analyzer.kind == "char":
        out = []
        for word in text.split():
            word = f" {word} "
            for n in range(analyzer.n_min, analyzer.n_max + 1):
                own = [word[i : i + n] for i in range(len(word) - n + 1)]
                out += own or ([word] if n == analyzer.n_min else [])
        return collections.Counter(out)
    found = [t for t in re.findall(r"\w{2,}", text) if t not in analyzer.stop]
    return collections.Counter(" ".join(found[i : i + n]) for n in range(analyzer.n_min, analyzer.n_max + 1) for i in range(len(found) - n + 1))


ANALYZERS = [Analyzer(), Analyzer(n_max=3), Analyzer(n_min=2, n_max=2, stop=("the",)), Analyzer("char", 3, 5), Analyzer("char", 2, 2)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "key int, text string")


def rows_of(df):
    return {r["key"]: {t["term"]: t["weight"] for t in r["_terms"]} for r in df.collect()}


@pytest.mark.parametrize("analyzer", ANALYZERS, ids=repr)
@pytest.mark.parametrize("lookup", [ct.LOOKUP_BYTES, 0], ids=["looked up", "joined"])
def test_weights_equal_plain_python(monkeypatch, texts, analyzer, lookup):
    monkeypatch.setattr(ct, "LOOKUP_BYTES", lookup)
    monkeypatch.setattr(ct, "BATCH_TOKENS", 5)
    counts = [grams(t, analyzer) for t in TEXTS]
    df = collections.Counter(term for own in counts for term in own)
    kept = {t: math.log((1 + len(TEXTS)) / (1 + n)) + 1 for t, n in df.items() if n <= 0.9 * len(TEXTS)}
    vocabulary = ct.Vocabulary.fit(texts, "text", analyzer, 1, 0.9)
    assert vocabulary.size == len(kept)
    table = vocabulary.table.orderBy("id").collect()
    assert [r["term"] for r in table] == sorted(kept, key=str.encode) and [r["id"] for r in table] == list(range(len(kept)))
    got = rows_of(ct.weighted(texts, "text", analyzer, vocabulary, True))
    for key, own in enumerate(counts):
        want = {t: (1 + math.log(n)) * kept[t] for t, n in own.items() if t in kept}
        norm = math.sqrt(sum(w * w for w in want.values()))
        assert got[key] == pytest.approx({t: w / norm for t, w in want.items()})
    vectors = ct.weighted(texts, "text", analyzer, vocabulary, True, "v").select("key", "text", vector_to_array("v").alias("v")).collect()
    for row in vectors:
        assert row["text"] == TEXTS[row["key"]] and len(row["v"]) == len(kept)
        assert {table[i]["term"]: w for i, w in enumerate(row["v"]) if w} == pytest.approx(got[row["key"]])


def test_a_vocabulary_beyond_the_limit_is_never_collected(monkeypatch, spark):
    monkeypatch.setattr(ct, "LOOKUP_BYTES", 1000)
    many = spark.range(300).select(F.col("id").alias("key"), F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), F.col("id") % (k + 2)) for k in range(40))).alias("text"))
    monkeypatch.setattr(ct.Vocabulary, "held", lambda self: pytest.fail("collected"))
    model = ft.TfidfVectors("text", "v", minDF=2).fit(many)
    assert model.vocabulary.bytes > 1000
    assert model.transform(many).agg(F.sum(F.size(F.filter(vector_to_array("v"), lambda x: x != 0)))).first()[0] > 0


def test_size_keeps_the_most_frequent(texts):
    vocabulary = ct.Vocabulary.fit(texts, "text", Analyzer(), size=2)
    assert [r["term"] for r in vocabulary.table.orderBy("term").collect()] == ["coast", "the"]


def test_no_texts(spark):
    empty = spark.createDataFrame([], "key int, text string")
    assert ct.Vocabulary.fit(empty, "text", Analyzer()).size == 0
    with pytest.raises(ValueError):
        ft.TfidfVectors("text", "v").fit(empty)


def test_numbers_are_ranks(spark):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("term"))
    got = ct.numbered(rows.repartition(7), "term", "id").orderBy("id").collect()
    terms = [r["term"] for r in got]
    assert terms == sorted(terms) and [r["id"] for r in got] == list(range(5000))


def test_singular_directions(spark):
    rnd = np.random.default_rng(2)
    x = (rnd.standard_normal((200, 6)) * [9, 7, 5, 3, 2, 1]) @ rnd.standard_normal((6, 60)) + 0.01 * rnd.standard_normal((200, 60))
    x[rnd.random((200, 60)) < 0.3] = 0
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "key int, a array<double>").select("key", array_to_vector("a").alias("v")).repartition(5)
    projection, values = ft.svd_projection(df, "v", 4, "low")
    want = np.linalg.svd(x)
    assert np.allclose(values, want[1][:4], rtol=1e-5)
    assert np.allclose(projection.matrix.T @ projection.matrix, np.eye(4), atol=1e-9)
    assert np.allclose(np.abs(np.sum(projection.matrix * want[2][:4].T, axis=0)), 1, atol=1e-4)
    low = {r["key"]: r["low"].toArray() for r in projection.transform(df).collect()}
    assert np.allclose([low[i] for i in range(200)], x @ projection.matrix)


def test_entries_of_mixed_vectors(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T

    rows = [(Vectors.sparse(4, [1, 3], [2.0, 5.0]),), (Vectors.dense([1.0, 0.0, 3.0, 0.0]),), (Vectors.sparse(4, [], []),), (Vectors.dense([0.0, 7.0, 0.0, 0.0]),)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("v", VectorUDT())])).coalesce(1)
    batch = df.select(F.unwrap_udt("v").alias("v")).toArrow().combine_chunks().to_batches()[0]
    at, places, values = ft.entries(batch["v"])
    dense = np.zeros((4, 4))
    dense[at, places] = values
    assert np.array_equal(dense, [[0, 2, 0, 5], [1, 0, 3, 0], [0] * 4, [0, 7, 0, 0]])
    assert isinstance(batch["v"], pa.StructArray)


def test_fused_features_list_both_sides(spark):
    style = spark.createDataFrame([(1, 1.0), (2, 2.0)], "key int, s double")
    vectors = spark.createDataFrame([(2, [5.0, 6.0]), (3, [7.0, 8.0])], "key int, e array<float>")
    got = {r["key"]: (r["features"] and list(r["features"]), r["missing"]) for r in ft.fuse_features(style, vectors, "key", ["s"], "e", check=False).collect()}
    assert got == {1: (None, "vector"), 2: ([2.0, 5.0, 6.0], None), 3: (None, "style")}
    with pytest.raises(ValueError):
        ft.fuse_features(style, vectors, "key", ["s"], "e")
    both = ft.fuse_features(style.filter("key = 2"), vectors.filter("key = 2"), "key", ["s"], "e").collect()
    assert [list(r["features"]) for r in both] == [[2.0, 5.0, 6.0]]


def test_joined_rows_keep_their_columns(monkeypatch, spark, texts):
    """Vectors, repeated keys and null columns travel with a batch through the join."""
    vocabulary = ct.Vocabulary.fit(texts, "text", Analyzer())
    marked = texts.unionByName(texts).withColumn("own", array_to_vector(F.array(F.col("key").cast("double")))).withColumn("none", F.lit(None).cast("string"))
    looked_up = ct.weighted(marked, "text", Analyzer(), vocabulary, True, "v")
    monkeypatch.setattr(ct, "LOOKUP_BYTES", 0)
    joined = ct.weighted(marked, "text", Analyzer(), vocabulary, True, "v")
    assert joined.schema == looked_up.schema
    plain = lambda df: sorted((r["key"], r["text"] or "", r["none"], list(r["own"]), [round(x, 9) for x in r["v"].toArray()]) for r in df.collect())
    assert plain(joined) == plain(looked_up) and len(plain(joined)) == 2 * len(TEXTS)


def test_a_term_meets_the_vocabulary_once_a_batch(monkeypatch, spark):
    """Rows that share their terms don't each send them through the join."""
    monkeypatch.setattr(ct, "LOOKUP_BYTES", 0)
    same = spark.range(400, numPartitions=2).select(F.col("id").alias("key"), F.lit("one two three four").alias("text"))
    vocabulary = ct.Vocabulary.fit(same, "text", Analyzer())
    met = []
    joined = type(same).join
    monkeypatch.setattr(type(same), "join", lambda self, *a, **k: met.append(self) or joined(self, *a, **k))
    assert ct.weighted(same, "text", Analyzer(), vocabulary, True, "v").count() == 400
    assert sum(df.count() for df in met) < 50


def test_word_totals_merge_rows_of_one_key(spark):
    from inkwell.operators import terms as tm

    rows = [(1, "aa bb aa"), (2, "aa"), (2, "aa cc"), (None, "cc"), (None, "cc dd"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "key int, text string")
    grouped = tm.term_counts(df, "key", tm.word_ngrams(F.col("text"), 1, 2)).groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs"))
    got = tm.term_totals(df, "key", "text", Analyzer(n_max=2))
    as_set = lambda found: {(r["term"], r["n"], r["docs"]) for r in found.collect()}
    assert as_set(got) == as_set(grouped) and ("aa", 4, 2) in as_set(got) and ("cc", 3, 2) in as_set(got)
    exploded = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_tokens" in line and "MapInArrow" in line]
    assert exploded  # rows are counted in place


def test_directions_in_feature_blocks(monkeypatch, spark):
    """A matrix that stays in tables gives the directions and projections of one that is held whole."""
    rnd = np.random.default_rng(3)
    x = (rnd.standard_normal((120, 6)) * [9, 7, 5, 3, 2, 1]) @ rnd.standard_normal((6, 70)) + 0.01 * rnd.standard_normal((120, 70))
    x[rnd.random((120, 70)) < 0.3] = 0
    x[5] = 0
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "key int, a array<double>").select("key", array_to_vector("a").alias("v")).repartition(3)
    whole, values = ft.svd_projection(df, "v", 4, "low")
    for name, limit in (("MATRIX_BYTES", 0), ("FEATURE_BLOCK", 16), ("ROW_BLOCK", 500), ("RECORD", 200)):
        monkeypatch.setattr(ft, name, limit)
    monkeypatch.setattr(ft, "_gram_product", lambda *a: pytest.fail("held whole"))
    blocks, again = ft.svd_projection(df, "v", 4, "low")
    assert np.allclose(again, values, rtol=1e-6)
    plain = lambda model: {r["key"]: (r["low"].toArray(), r["v"].toArray()) for r in model.transform(df).collect()}
    want, got = plain(whole), plain(blocks)
    assert got.keys() == want.keys() == set(range(120))
    assert all(np.allclose(got[i][0], want[i][0], atol=1e-3) and np.array_equal(got[i][1], x[i]) for i in got)


@pytest.mark.parametrize("size, limits", [(1, (1, 1.0)), (25, (2, 0.3)), (10_000, (2, 0.98))], ids=repr)
def test_most_frequent_ngrams_by_length(monkeypatch, spark, size, limits):
    """The terms kept are those of a whole count, and n-grams with a rare part are not counted."""
    rnd = np.random.default_rng(5)
    words = ["aa", "bb", "cc", "dd", "ee", *(f"rare{i}" for i in range(200))]
    p = np.array([20, 12, 9, 5, 4, *[0.25] * 200])
    rows = [" ".join(rnd.choice(words, 1 + i % 12, p=p / p.sum())) for i in range(300)] + [None, "", "the aa"]
    df = spark.createDataFrame(list(enumerate(rows)), "key int, text string").repartition(3)
    analyzer, (min_df, max_df) = Analyzer(n_max=4, stop=("the",)), limits
    counted = [grams(text, analyzer) for text in rows]
    total, docs = sum(counted, collections.Counter()), collections.Counter(t for own in counted for t in own)
    allowed = sorted((t for t in total if min_df <= docs[t] <= max_df * len(rows)), key=lambda t: (-total[t], t))[:size]
    made = []
    whole = ct.term_stats
    monkeypatch.setattr(ct, "term_stats", lambda df, col, a: made.append(a.n_max) or whole(df, col, a))
    found = ct.Vocabulary.fit(df, "text", analyzer, min_df, max_df, size)
    want = {t: math.log((1 + len(rows)) / (1 + docs[t])) + 1 for t in allowed}
    got = dict(zip(found.held()["term"].to_pylist(), found.held()["idf"].to_pylist()))
    assert got == pytest.approx(want) and made == [1]
    few = {r["term"] for r in ct.frequent_stats(df, "text", analyzer, min_df, max_df, size).collect()}
    assert size > 25 or len(few) < len(total) / 4
    monkeypatch.setattr(ct, "LOOKUP_BYTES", 60)  # too many terms to be sent: all are counted
    assert ct.frequent_stats(df, "text", analyzer, 1, 1.0, 10_000) is None
    terms = lambda v: {r["term"] for r in v.table.select("term").collect()}
    assert terms(ct.Vocabulary.fit(df, "text", analyzer, min_df, max_df, size)) == set(allowed)


def test_workers_that_count_load_no_pandas():
    code = "import sys, inkwell.operators.counting; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], timeout=120).returncode == 0


def test_directions_a_few_columns_at_a_time(monkeypatch, spark):
    """A round shuffles some columns of the matrix at once, and gives what it gives with all of them."""
    rnd = np.random.default_rng(4)
    x = (rnd.standard_normal((60, 5)) * [9, 7, 5, 3, 2]) @ rnd.standard_normal((5, 50))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "key int, a array<double>").select("key", array_to_vector("a").alias("v")).repartition(3)
    for name, limit in (("MATRIX_BYTES", 0), ("FEATURE_BLOCK", 16), ("ROW_BLOCK", 500), ("RECORD", 200), ("SLICE", 4)):
        monkeypatch.setattr(ft, name, limit)
    widths, met = [], ft._RowBlocks._met
    monkeypatch.setattr(ft._RowBlocks, "_met", lambda self, parts, turn, *rest: widths.append(turn.shape[1]) or met(self, parts, turn, *rest))
    model, values = ft.svd_projection(df, "v", 3, "low")
    assert max(widths) == 4 and len(widths) > 6 and np.allclose(values, np.linalg.svd(x)[1][:3], rtol=1e-6)
    low = {r["key"]: r["low"].toArray() for r in model.transform(df).collect()}
    want = x @ np.linalg.svd(x)[2][:3].T
    assert all(np.allclose(np.abs(low[i]), np.abs(want[i]), atol=1e-3) for i in range(60))
