"""Queries: term tables, feature vectors, models, topics, evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from inkwell.functions import text as tx
from inkwell.operators import evaluate as ev, features as ft, folding as fd, models as md, splits as sp, terms as tm, topics as tp
from inkwell.operators.counting import Analyzer
from inkwell.plans.intake import PREDICTIONS_SQL, predictions
from inkwell.plans.registry import query
from inkwell.plans.texts import STYLE_16_NAMES, STYLE_16_SQL
from inkwell.plans.views import articles, headlines, table
from inkwell.session import spread, written

STOP = ("the", "and", "of", "to", "in", "that", "is", "for", "with", "de", "la", "der", "die", "und")

# ---- term tables -----------------------------------------------------------

TOKENS_SQL = r"regexp_extract_all(lower(title), '[\p{L}\p{N}_]{2,}')"
GRAMS_SQL = f"""@headlines, tok AS (SELECT doc_id, outlet, {TOKENS_SQL} AS t FROM headlines),
    grams AS (SELECT doc_id, outlet, unnest(t) AS term FROM tok
        UNION ALL SELECT doc_id, outlet, unnest([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) FROM tok),
    tf AS (SELECT doc_id, outlet, term, count(*) AS tf FROM grams GROUP BY 1, 2, 3)"""


def weight_sql(keep: str, tf: str) -> str:
    return f"""vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM headlines)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf
        GROUP BY term HAVING {keep}),
    raw AS (SELECT doc_id, outlet, term, ({tf}) * idf AS w FROM tf JOIN vocab USING (term)),
    weights AS (SELECT doc_id, outlet, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@query(f"WITH {GRAMS_SQL} SELECT term, sum(tf)::BIGINT AS n, count(*) AS docs FROM tf GROUP BY term")
def word_ngrams(spark, d):
    return tm.term_totals(headlines(spark, d), "doc_id", "title", Analyzer(n_max=2))


@query(r"""WITH @headlines, w AS (SELECT doc_id, ' ' || x || ' ' AS p FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(title), '\s+')) AS x
        FROM headlines) WHERE x <> ''),
    pn AS (SELECT p, count(*) AS n FROM w GROUP BY p),
    g AS (SELECT n, unnest([substr(p, i, k) FOR i IN range(1, greatest(length(p) - k + 1, 1) + 1)]) AS term
        FROM pn, (VALUES (3), (4), (5)) AS s(k) WHERE k = 3 OR length(p) >= k)
    SELECT term, sum(n)::BIGINT AS n FROM g GROUP BY term""")
def char_wb_ngrams(spark, d):
    return tm.char_term_counts(headlines(spark, d), [], "title", 3, 5).withColumnRenamed("tf", "n")


@query(f"""WITH {GRAMS_SQL}, {weight_sql("count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM headlines)", "1 + ln(tf)")}
    SELECT doc_id, term, round(weight, 6) AS weight FROM weights""")
def tfidf(spark, d):
    return tm.tfidf(headlines(spark, d), "doc_id", "title", Analyzer(n_max=2), min_df=2, max_df=0.95, sublinear=True)


@query(f"""WITH {GRAMS_SQL}, {weight_sql("count(*) >= 5 AND count(*) <= 0.95 * (SELECT count(*) FROM headlines)", "1 + ln(tf)")},
    m AS (SELECT term, coalesce(sum(weight) FILTER (outlet = 'A'), 0) AS a, coalesce(sum(weight) FILTER (outlet = 'B'), 0) AS b FROM weights GROUP BY term),
    t AS (SELECT sum(a) AS sa, sum(b) AS sb, count(*) AS v FROM m),
    o AS (SELECT term, a, b, ln(((a + 0.5) / (sa + 0.5 * v)) / ((b + 0.5) / (sb + 0.5 * v))) AS odds FROM m, t),
    s AS (SELECT 'A' AS side, term, a AS mass, odds AS log_odds FROM o UNION ALL SELECT 'B', term, b, -odds FROM o)
    SELECT side, term, round(mass, 6) AS mass, round(log_odds, 6) AS log_odds, row_number() OVER (PARTITION BY side ORDER BY round(log_odds, 9) DESC, term) AS rank
    FROM s QUALIFY row_number() OVER (PARTITION BY side ORDER BY round(log_odds, 9) DESC, term) <= 20""")
def distinctive_terms(spark, d):
    weights = tm.tfidf(
        headlines(spark, d), "doc_id", "title", Analyzer(n_max=2), min_df=5, max_df=0.95, sublinear=True, keep=["outlet"]
    )
    return tm.distinctive_terms(weights, "outlet", "A", "B", 0.5, 20)


@query(f"""WITH @headlines, tok AS (SELECT lang, unnest({TOKENS_SQL}) AS term FROM headlines),
    c AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY 1, 2),
    f AS (SELECT term, sum(n) AS f FROM c GROUP BY term),
    s AS (SELECT lang, term, n, n / (sum(n) OVER (PARTITION BY lang))::DOUBLE
        * ln(1 + (SELECT sum(n) / count(DISTINCT lang)::DOUBLE FROM c) / f) AS score FROM c JOIN f USING (term))
    SELECT lang, term, n, round(score, 6) AS score, row_number() OVER (PARTITION BY lang ORDER BY round(score, 12) DESC, term) AS rank
    FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(score, 12) DESC, term) <= 10""")
def class_tfidf(spark, d):
    return tm.class_tfidf(headlines(spark, d), "lang", tm.tokens(F.col("title")), 10)


# ---- feature vectors -------------------------------------------------------


@query("""WITH @headlines, f AS (SELECT doc_id, outlet, length(title)::DOUBLE AS chars, length(regexp_replace(title, '[^!]', '', 'g'))::DOUBLE AS marks FROM headlines),
    s AS (SELECT avg(chars) AS mc, stddev_pop(chars) AS sc, avg(marks) AS mm, stddev_pop(marks) AS sm FROM f WHERE outlet = 'A')
    SELECT doc_id, round((chars - mc) / sc, 6) + 0.0 AS chars, round((marks - mm) / CASE WHEN sm = 0 THEN 1 ELSE sm END, 6) + 0.0 AS marks FROM f, s""")
def scale(spark, d):
    df = headlines(spark, d).select(
        "doc_id", "outlet", F.length("title").alias("chars"), tx.punct_counts_6(F.col("title"))["n_exclaim"].alias("marks")
    )
    return ft.scale_columns(df, df.filter("outlet = 'A'"), ["chars", "marks"]).drop("outlet")


def _labelled(spark, d) -> DataFrame:
    """Both text views, a 0/1 label and a stratified train / test split, as a written table.

    Cleaning runs once; every fit and every score reads the view it needs.
    """
    rows = headlines(spark, d).select("doc_id", "title", "outlet", "category")
    split = sp.stratified_split(rows, "outlet", "doc_id", 0.25, 1)
    labelled = split.withColumn("label", (F.col("outlet") == "A").cast("double"))
    return spread(written(ft.text_views(labelled, "title").drop("title"), "views"), "doc_id")


def _parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("split = 'train'"), df.filter("split = 'test'")


def _cleaned(spark, d) -> DataFrame:
    """What a model of the cleaned text needs; every other column would travel through Python with the tokens."""
    return _labelled(spark, d).select("doc_id", "label", "split", "text_clean")


def _score(pipeline: Pipeline, spark, d) -> DataFrame:
    """Fit on the train part, predict the test part."""
    train, test = _parts(_cleaned(spark, d))
    return ev.predict_table(pipeline.fit(train), test, "doc_id", ["label"])


def _word_view(**options) -> list:
    """Words in two documents or more, without those in nearly all."""
    return ft.tfidf_stages("text_clean", "features", min_df=2, max_df=0.95, sublinear=True, **options)


@query()
def feature_union(spark, d):
    df = _labelled(spark, d)
    union = ft.feature_union().fit(_parts(df)[0]).transform(df)
    parts = F.unwrap_udt("features")
    return union.select("doc_id", parts["size"].alias("size"), F.size(parts["values"]).alias("filled"))


@query()
def embed_text(spark, d):
    return ft.embed_text(headlines(spark, d), "doc_id", "title")


@query()
def reduce(spark, d):
    """Two principal components of the given vectors, and their variance shares."""
    vectors = ft.as_vector(table(spark, d, "embeddings"), "embedding", "v")
    model = ft.pca(vectors, "v", 2, "low")
    low = vector_to_array("low")
    shares = [float(x) for x in model.explainedVariance]
    return model.transform(vectors).select(
        "vec_id", low[0].alias("pc1"), low[1].alias("pc2"), *[F.lit(s).alias(f"share{i + 1}") for i, s in enumerate(shares)]
    )


@query(f"""WITH {STYLE_16_SQL}, s AS (SELECT doc_id, {' + '.join(STYLE_16_NAMES)} AS total FROM style),
    v AS (SELECT vec_id, list_sum(embedding::DOUBLE[]) AS total, len(embedding) AS n FROM embeddings)
    SELECT coalesce(doc_id, vec_id) AS doc_id, CASE WHEN doc_id IS NULL OR vec_id IS NULL THEN 0 ELSE {len(STYLE_16_NAMES)} + n END AS size,
        round(coalesce(s.total + v.total, 0), 4) AS total,
        CASE WHEN doc_id IS NULL THEN 'style' WHEN vec_id IS NULL THEN 'vector' END AS missing
    FROM s FULL JOIN v ON doc_id = vec_id""")
def fuse_features(spark, d):
    """Style and embedding side by side; keys of one side only are listed with what they lack."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    style = tx.with_features(headlines(spark, d).select("doc_id", "title"), "title", tx.style_features_16).drop("title")
    names = [c for c in style.columns if c != "doc_id"]
    fused = ft.fuse_features(style, vectors, "doc_id", names, "embedding", check=False)
    empty = F.array().cast("array<double>")
    values = F.when(F.col("missing").isNull(), vector_to_array("features")).otherwise(empty)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return fused.select("doc_id", "missing", values.alias("values")).select(
        "doc_id", F.size("values").alias("size"), F.round(total, 4).alias("total"), "missing"
    )


# ---- models ----------------------------------------------------------------


@query()
def logistic_baseline(spark, d):
    return _score(md.logistic_baseline("text_clean", STOP), spark, d)


@query()
def logistic_improved(spark, d):
    return _score(md.logistic_improved("text_clean", STOP), spark, d)


@query()
def linear_svm(spark, d):
    """Class-balanced weights."""
    train, test = _parts(_cleaned(spark, d))
    svm = md.linear_svm(1.0, weightCol="weight")
    model = Pipeline(stages=[*_word_view(), svm]).fit(md.class_weights(train))
    return ev.predict_table(model, test, "doc_id", ["label"])


@query()
def naive_bayes(spark, d):
    return _score(Pipeline(stages=[*_word_view(), md.naive_bayes("complement", 0.5)]), spark, d)


@query()
def tree_ensembles(spark, d):
    """Random forest and boosted trees on SVD-reduced text, side by side."""
    df = _cleaned(spark, d)
    weighted = Pipeline(stages=_word_view()).fit(_parts(df)[0]).transform(df).select("doc_id", "label", "split", "features")
    projection, _ = ft.svd_projection(_parts(weighted)[0], "features", 100, "low")
    train, test = _parts(written(projection.transform(weighted).drop("features"), "low"))
    forest = md.random_forest(200, 0, featuresCol="low").fit(train)
    boosted = md.boosted_trees(300, 4, 0.05, 0.8, 0, featuresCol="low").fit(train)
    scored = forest.transform(test).select("doc_id", "label", "low", F.col("prediction").alias("forest"))
    return boosted.transform(scored).select("doc_id", "label", F.col("forest"), F.col("prediction").alias("boosted"))


@query()
def kernel_svm_rbf(spark, d):
    vectors = ft.as_vector(table(spark, d, "embeddings"), "embedding", "features")
    labelled = vectors.withColumn("label", (F.col("label") < 5).cast("double"))
    split = sp.stratified_split(labelled, "label", "vec_id", 0.25, 1)
    model = md.kernel_svm_rbf(_parts(split)[0], size=128, max_iter=20)
    return ev.predict_table(model, _parts(split)[1], "vec_id", ["label"])


def _folded(spark, d, k: int, repeats: int = 2) -> DataFrame:
    """Texts with a stratified fold per repeat, as a narrow table."""
    rows = _labelled(spark, d).select("doc_id", "label", "split", "outlet", "text_clean")
    return written(sp.repeated_folds(rows, "outlet", "doc_id", k, repeats, 3).drop("outlet"), "folds")


#: Words in two documents or more, without those in nearly all.
LIMITS = {"min_df": 2, "max_df": 0.95}


@query()
def calibrate_scores(spark, d):
    """Three folds; the vocabulary of each has not seen the rows that its sigmoid is fitted on."""
    train, test = _parts(_folded(spark, d, 3, 1))
    counts = fd.HeldOutCounts(train, "text_clean", Analyzer(), fd.fold_conditions(["fold_0"], 3), 2)
    view = lambda held: counts.view(held, **LIMITS)
    train, score = counts.encoded(train), counts.encoded(test.select("doc_id", "label", "text_clean"))
    out = md.calibrate_scores(train, score, md.linear_svm(1.0), "fold_0", 3, view)
    return out.select("doc_id", "label", "probability", "prediction")


@query()
def stack_models(spark, d):
    """Calibrated margins and two probabilities; every base and its vocabulary are fitted per fold."""
    train, test = _parts(_folded(spark, d, 3, 2))
    counts = fd.HeldOutCounts(train, "text_clean", Analyzer(), fd.nested_conditions("fold_0", "fold_1", 3), 2)
    view = lambda held: counts.view(held, **LIMITS)
    bases = {
        "svm": md.Calibrated(md.linear_svm(1.0, 25), "fold_1", 3), "logistic": md.logistic(1.0, 25), "bayes": md.naive_bayes("multinomial")
    }
    train, score = counts.encoded(train), counts.encoded(test.select("doc_id", "label", "text_clean"))
    out = md.stack_models(train, score, bases, "doc_id", "fold_0", 3, view)
    return out.select("doc_id", "label", vector_to_array("probability")[1].alias("probability"), "prediction")


@query()
def grid_search(spark, d):
    """Regularisation and n-gram grid under rolling folds, each with the vocabulary of its own prefix."""
    rows = articles(spark, d).select("doc_id", "title", "outlet", "ts")
    df = ft.text_views(rows.withColumn("label", (F.col("outlet") == "A").cast("double")), "title")
    df = written(sp.rolling_slices(df.select("doc_id", "label", "ts", "text_clean"), "ts", "doc_id", 3).select("label", "text_clean", "slice"), "slices")
    slot = F.col("slice")
    later = {f"after {i}": slot.isNull() | (slot > i) for i in range(3)}
    counts = fd.HeldOutCounts(df, "text_clean", Analyzer(n_max=2), later, 2)
    folds = {f"after {i}": (slot <= i, slot == i + 1) for i in range(3)}
    configs = md.grid(n_max=[1, 2], **{k: [v] for k, v in LIMITS.items()}, c=[0.1, 1.0, 10.0])
    return fd.search(df, counts, folds, configs, lambda c: md.logistic(c["c"]))


@query()
def repeated_grid_search(spark, d):
    """The grid under stratified 5-fold cross-validation, three times over."""
    train = _parts(_folded(spark, d, 5, 3))[0]
    folds = fd.fold_conditions(["fold_0", "fold_1", "fold_2"], 5)
    counts = fd.HeldOutCounts(train, "text_clean", Analyzer(n_max=2), folds, 2)
    configs = md.grid(n_max=[1, 2], **{k: [v] for k, v in LIMITS.items()}, c=[0.1, 1.0])
    return fd.search(train.drop("doc_id", "split"), counts, fd.train_only(folds), configs, lambda c: md.logistic(c["c"], 25))


@query()
def random_search(spark, d):
    """A hundred seeded draws from a product grid of text and model settings, judged on the held-out part."""
    df = _labelled(spark, d).select("label", "text_clean", "split")
    test = {"test": F.col("split") == "test"}
    counts = fd.HeldOutCounts(df, "text_clean", Analyzer(n_max=3), test, 2)
    configs = md.grid(
        n_max=[1, 2, 3], min_df=[2, 5], max_df=[0.95, 0.7], sublinear=[True, False], c=[0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0]
    )
    return fd.search(df, counts, fd.train_only(test), md.draw_configs(configs, 100, 0), lambda c: md.logistic(c["c"], 25))


@query()
def ablate(spark, d):
    """Stop words and stemming, with the rest of the pipeline held fixed."""
    df = _cleaned(spark, d)
    stemmed = written(ft.stemmed(df, "text_clean"), "stemmed")  # read by every pass of two variants
    variants = {}
    for name, base, stop in (
        ("plain", df, ()), ("stop words removed", df, STOP), ("stemmed", stemmed, ()), ("stop + stem", stemmed, STOP),
    ):
        stages = [*_word_view(stop=stop), md.logistic(1.0)]
        variants[name] = (*_parts(base), Pipeline(stages=stages))
    return md.experiment(variants)


@query()
def predict_table(spark, d):
    """Scores from a model that sees URL slugs or headlines alike."""
    df = _cleaned(spark, d)
    model = Pipeline(stages=[*_word_view(), md.naive_bayes("multinomial")]).fit(_parts(df)[0])
    pages = table(spark, d, "pages").select("page_id", "url")
    inputs = ev.model_input(pages, "url").withColumn("text_clean", tx.clean_strict(F.col("text")))
    return ev.predict_table(model, inputs, "page_id")


# ---- topics ----------------------------------------------------------------


@query()
def topics_from_vectors(spark, d):
    return tp.topics_from_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def cluster_sweep(spark, d):
    return tp.cluster_sweep(table(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def lda_topics(spark, d):
    df = ft.text_views(headlines(spark, d).select("doc_id", "title"), "title").select("doc_id", "text_clean")
    assigned, _ = tp.lda_topics(df, "doc_id", "text_clean", k=13, stop=STOP)
    return assigned


@query()
def cluster_vectors(spark, d):
    vectors = ft.as_vector(table(spark, d, "embeddings"), "embedding", "v")
    with md.kept(vectors) as kept:
        flat = tp.cluster_vectors(kept, "v", 2, restarts=3)
        tree = tp.cluster_vectors(kept, "v", 2, kind="hierarchy")
    both = tree.transform(flat.transform(vectors).withColumnRenamed("cluster", "kmeans")).withColumnRenamed("cluster", "hierarchy")
    return both.groupBy("kmeans", "hierarchy").agg(F.count(F.lit(1)).alias("n"))


# ---- evaluation ------------------------------------------------------------


@query(f"WITH {PREDICTIONS_SQL} SELECT count(*) AS n, round(avg((label = prediction)::INT), 6) AS accuracy FROM predictions")
def accuracy(spark, d):
    return ev.accuracy(predictions(spark, d), "label", "prediction")


@query(f"""WITH {PREDICTIONS_SQL} SELECT count(*) AS n, round(greatest(avg((label = prediction)::INT), avg((label <> prediction)::INT)), 6) AS accuracy FROM predictions""")
def accuracy_best_mapping(spark, d):
    named = predictions(spark, d).withColumn("label", F.when(F.col("label") == 1, "alpha").otherwise("beta"))
    return ev.accuracy(named, "label", "prediction", "best")


@query(f"""WITH {PREDICTIONS_SQL}, c AS (SELECT label::VARCHAR AS class, (SELECT count(*) FROM predictions p WHERE p.label = q.label AND p.prediction = q.label) AS t,
        (SELECT count(*) FROM predictions p WHERE p.prediction = q.label) AS p, (SELECT count(*) FROM predictions p WHERE p.label = q.label) AS s
        FROM (VALUES (0), (1)) AS q(label)),
    m AS (SELECT class, coalesce(t / nullif(p, 0)::DOUBLE, 0) AS precision, coalesce(t / nullif(s, 0)::DOUBLE, 0) AS recall, s FROM c),
    f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, s::BIGINT AS support FROM f
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(s)::BIGINT FROM f
    UNION ALL SELECT 'weighted avg', round(sum(precision * s) / sum(s), 6), round(sum(recall * s) / sum(s), 6), round(sum(f1 * s) / sum(s), 6), sum(s)::BIGINT FROM f""")
def class_report(spark, d):
    return ev.class_report(predictions(spark, d), "label", "prediction", [0, 1])


@query(f"""WITH {PREDICTIONS_SQL} SELECT l::BIGINT AS label, p::BIGINT AS prediction,
    (SELECT count(*) FROM predictions q WHERE q.label = l AND q.prediction = p) AS n FROM (VALUES (0), (1)) AS a(l), (VALUES (0), (1)) AS b(p)""")
def confusion(spark, d):
    return ev.confusion(predictions(spark, d), "label", "prediction", [0, 1])


@query(f"""WITH {PREDICTIONS_SQL} SELECT category, count(*) AS n, round(avg((label <> prediction)::INT), 6) AS error_rate
    FROM predictions GROUP BY category HAVING count(*) >= 5""")
def error_rate_by(spark, d):
    return ev.error_rate_by(predictions(spark, d), "category", "label", "prediction", 5)


RUNS_SQL = f"""{PREDICTIONS_SQL}, runs AS (SELECT category AS model, CASE WHEN lang IN ('de', 'en') THEN 'stratified' ELSE 'temporal' END AS split,
    avg((label = prediction)::INT) AS accuracy FROM predictions GROUP BY 1, 2)"""


def _runs(spark, d):
    pred = predictions(spark, d)
    split = F.when(F.col("lang").isin("de", "en"), "stratified").otherwise("temporal")
    hit = (F.col("label") == F.col("prediction")).cast("int")
    return pred.groupBy(F.col("category").alias("model"), split.alias("split")).agg(F.avg(hit).alias("accuracy"))


@query(f"""WITH {RUNS_SQL}, w AS (SELECT model, max(accuracy) FILTER (split = 'stratified') AS s, max(accuracy) FILTER (split = 'temporal') AS t FROM runs GROUP BY model)
    SELECT model, round(s, 6) AS stratified, round(t, 6) AS temporal, round(s - t, 6) + 0.0 AS gap, s = (SELECT max(s) FROM w) AS best_stratified,
        t = (SELECT max(t) FROM w) AS best_temporal FROM w""")
def compare_runs(spark, d):
    return ev.compare_runs(_runs(spark, d))


@query(f"WITH {RUNS_SQL} SELECT model, split, round(accuracy, 6) AS accuracy FROM runs WHERE split = 'stratified' ORDER BY runs.accuracy DESC, model LIMIT 10")
def best_run(spark, d):
    return ev.best_run(_runs(spark, d).filter("split = 'stratified'"), "accuracy", "model", 10)
