"""Sentiment and entities from tables of words and phrases.

Re-aimed: the values come from a valence table and a gazetteer the caller
supplies, without negation or booster rules and without a statistical tagger, so
scores are comparable between groups but not equal to a rule engine's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inkwell.functions.text import let
from inkwell.operators.profile import value_share
from inkwell.session import written

# Normalisation constant of the compound score, entity types.
COMPOUND_ALPHA = 15
ENTITY_TYPES = ("PERSON", "ORG", "GPE", "NORP")


#: A word from its first to its last letter or digit; a word has one such part at most.
BARE = r"(?U)([\p{L}\p{N}](?:\S*[\p{L}\p{N}])?)"


def bare_words(text: Column) -> Column:
    """Words without leading and trailing punctuation; none of a null text."""
    found = F.regexp_extract_all(text, F.lit(BARE), 1)
    return F.coalesce(found, F.array().cast("array<string>"))


def _met(df: DataFrame, key_col: str, tokens: Column, following: int, listed: DataFrame, fits: Column) -> DataFrame:
    """Rows that carry a key's number of words (``_n``) or one listed word with its entry.

    Texts are split once: their words leave the row together with an entry for the count
    and meet the list, which Catalyst broadcasts if its written size allows it.  The
    count's entry has a word of its own that no list holds, so that it spreads.
    """

    def entries(words: Column) -> Column:
        later = lambda i: [F.get(words, i + k).alias(f"_w{k}") for k in range(1, following + 1)]
        count = F.struct(
            F.concat(F.lit(" "), F.col(key_col).cast("string")).alias("_w0"),
            *[F.lit(None).cast("string").alias(f"_w{k}") for k in range(1, following + 1)], F.size(words).alias("_n"),
        )
        own = F.transform(words, lambda w, i: F.struct(w.alias("_w0"), *later(i), F.lit(None).cast("int").alias("_n")))
        return F.concat(F.array(count), own)

    spoken = df.select(key_col, F.inline(let(tokens, entries)))
    met = spoken.join(listed, fits, "left")
    return met.filter(F.col("_n").isNotNull() | F.col("_listed").isNotNull())


def lexicon_sentiment(df: DataFrame, key_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """``(key, compound, neg, pos, neu)``; ``lexicon`` is ``(token, valence)``.

    All words that are not listed count as neutral, so rows without any listed word
    keep zero scores.
    """
    listed = written(lexicon, "lexicon").select(F.col("token").alias("_token"), F.col("valence").alias("_valence"), F.lit(1).alias("_listed"))
    met = _met(df, key_col, bare_words(F.lower(F.col(text_col))), 0, listed, F.col("_w0") == F.col("_token"))
    v = F.col("_valence")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = met.groupBy(key_col).agg(
        total(v).alias("_s"),
        total(F.when(v > 0, v + 1)).alias("_pos"),
        total(F.when(v < 0, 1 - v)).alias("_neg"),
        (F.sum("_n") - F.count(F.when(v != 0, 1))).alias("_neu"),
    )
    whole = F.nullif(F.col("_pos") + F.col("_neg") + F.col("_neu"), F.lit(0.0))
    part = lambda c: F.coalesce(F.col(c) / whole, F.lit(0.0))
    return sums.select(
        key_col,
        (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + COMPOUND_ALPHA)).alias("compound"),
        part("_neg").alias("neg"), part("_pos").alias("pos"), part("_neu").alias("neu"),
    )


def entity_counts(df: DataFrame, key_col: str, text_col: str, gazetteer: DataFrame, max_words: int = 3) -> DataFrame:
    """Counts per entity type, total, and person / organisation ratios per row.

    ``gazetteer`` is ``(phrase, type)``.  Every listed phrase of up to
    ``max_words`` words counts, also inside a longer one: a word meets the phrases it
    begins, and the words after it decide.
    """
    parts = F.split("phrase", " ")
    listed = written(gazetteer, "gazetteer").filter(F.size(parts) <= max_words).select(
        *[F.get(parts, F.lit(k)).alias(f"_p{k}") for k in range(max_words)], F.col("type").alias("_type"), F.lit(1).alias("_listed")
    )
    fits = F.col("_w0") == F.col("_p0")
    for k in range(1, max_words):
        fits = fits & (F.col(f"_p{k}").isNull() | (F.col(f"_w{k}") == F.col(f"_p{k}")))
    met = _met(df, key_col, bare_words(F.col(text_col)), max_words - 1, listed, fits)
    names = [f"{t.lower()}_count" for t in ENTITY_TYPES]
    found = met.groupBy(key_col).agg(
        *[F.count(F.when(F.col("_type") == t, 1)).alias(c) for t, c in zip(ENTITY_TYPES, names)],
        F.count("_type").alias("total_ents"),
    )
    at_least_one = F.greatest(F.col("total_ents"), F.lit(1))
    return found.withColumns(
        {
            "person_to_ent_ratio": F.col("person_count") / at_least_one,
            "org_to_ent_ratio": F.col("org_count") / at_least_one,
        }
    )


def sentiment_by(scored: DataFrame, dims: Sequence[str], min_n: int = 5) -> DataFrame:
    """Mean sentiment per combination of dimensions with at least ``min_n`` rows."""
    return (
        scored.dropna(subset=list(dims)).groupBy(*dims)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("compound").alias("mean_compound"))
        .filter(F.col("n") >= min_n)
    )


def author_bias(df: DataFrame, author_col: str, group_col: str) -> DataFrame:
    """Share of each author's articles per group."""
    return value_share(df, group_col, [author_col])
