"""Stages keep documents whose extra columns are named like the stages' own helpers."""

import pytest
from pyspark.sql import functions as F

from inkwell.llm.mixing import mixed_documents
from inkwell.llm.ngram_join import one_of_each
from inkwell.llm.privacy import redact

NAMES = [
    "id", "key", "own", "size", "copies", "row_hash", "target", "rate", "p", "n", "root", "rep", "kind", "start", "end", "match", "_id", "_key", "_text",
    "_text_key", "_base", "_spans", "_added", "_first", "_copies", "_rows", "_take", "_source", "_stratum", "_n", "_block", "component", "node",
]


@pytest.mark.parametrize("stage", [redact, one_of_each, mixed_documents], ids=lambda f: f.__name__)
def test_helper_names_as_columns(spark, stage):
    rows = [(i, f"text number {i} of source with a mail x{i}@y.org in it", "en", ("a", "b", None)[i % 3], 9) for i in range(30)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    named = plain.select("*", *(F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")).alias(name) for name in NAMES))
    got = stage(named)
    assert got.columns == named.columns
    found = got.collect()
    assert found and all(r[name] == f"{name}-{r['doc_id']}" for r in found for name in NAMES)
    order = lambda rs: sorted(repr([r[c] for c in plain.columns]) for r in rs)
    assert order(found) == order(stage(plain).collect())
