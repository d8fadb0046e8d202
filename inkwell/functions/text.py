"""Headline text expressions: cleaning, tokens, style markers.

Everything here is ``Column -> Column`` on built-in functions.  The only Python
is :func:`_unescape_nfkc` and :func:`_both_views`, and they see nothing but the rows that
hold ``&`` or a non-ASCII character.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Character sets and patterns that define the feature semantics.
# Java's Unicode-aware \s plus the separators \x1c-\x1f; a plain list of ranges
# matches the same characters five times slower.
SPACE = r"\s\x1c-\x1f"
GAP = rf"(?U)[{SPACE}]+"
EDGE_GAP = rf"(?U)^[{SPACE}]+|[{SPACE}]+$"
SOLID = rf"[^{SPACE}]"
WORD_START = rf"(?<!{SOLID})"
WORD_END = rf"(?!{SOLID})"
QUOTE_CHARS = "\"‘’“”"
EM_DASH = "—"
URL_TEXT = r"https?://\S+|www\.\S+"
STEM_SUFFIX = r"(ing|tions?|ments?|edly|ness|ly|ed|es|s)\b"
SAYS = r"\b(says?|said)\b"
REPORT = r"\b(reports?|reported)\b"
SOURCES = r"\bsources?\b"
ALLEGEDLY = r"\b(allegedly|accused|claims?)\b"
ALLCAPS_RUN = r"\b[A-Z]{3,}\b"

UPPER = r"\p{Lu}"
UPPER_AFTER_LETTER = r"[\p{Lu}\p{Ll}]\p{Lu}"
LOWER_AFTER_OTHER = r"(^|[^\p{Lu}\p{Ll}])\p{Ll}"


#: Texts that are Python strings at once; the rest of a batch stays in Arrow.
DECODED_TEXTS = 64
#: ``GAP`` for Python: the white space of Unicode and \x1c-\x1f.
PYTHON_GAP = re.compile("[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
VIEWS = T.StructType([T.StructField("text", T.StringType()), T.StructField("again", T.StringType())])


def _decoded(text: str) -> str:
    return unicodedata.normalize("NFKC", html.unescape(text))


def _in_portions(texts: pa.Array, value: Callable, kind: pa.DataType) -> pa.Array:
    """``value`` of every text that is not null, a few texts at a time."""
    parts = [pa.array([], kind)]
    for at in range(0, len(texts), DECODED_TEXTS):
        own = texts.slice(at, DECODED_TEXTS).to_pylist()
        parts.append(pa.array([None if t is None else value(t) for t in own], kind))
    return pa.concat_arrays(parts)


@F.arrow_udf(T.StringType())
def _unescape_nfkc(texts: pa.Array) -> pa.Array:
    return _in_portions(texts, _decoded, pa.string())


@F.arrow_udf(VIEWS)
def _both_views(texts: pa.Array) -> pa.Array:
    """The text decoded and squeezed, and that decoded once more where it changes by that."""

    def views(text: str) -> dict[str, str | None]:
        once = PYTHON_GAP.sub(" ", _decoded(text)).strip(" ")
        again = _decoded(once)
        return {"text": once, "again": None if again == once else again}

    return _in_portions(texts, views, pa.struct([("text", pa.string()), ("again", pa.string())]))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_GAP, "")


def squeeze(text: Column) -> Column:
    """Collapse whitespace runs to one blank and strip."""
    return F.trim(F.regexp_replace(text, GAP, " "))


def is_missing(value: Column) -> Column:
    """NULL, or nothing but whitespace."""
    return value.isNull() | (strip(value.cast("string")) == "")


def _undecoded(text: Column) -> Column:
    """The text where decoding can change it, else NULL."""
    return F.when(text.contains("&") | text.rlike(r"[^\x00-\x7F]"), text)


def unescape(text: Column) -> Column:
    """HTML entities decoded and NFKC applied; NULL becomes ''."""
    return F.coalesce(_unescape_nfkc(_undecoded(text)), text, F.lit(""))


def normalize_raw(text: Column) -> Column:
    return squeeze(unescape(text))


def _cleaned(decoded: Column, keep: str | None) -> Column:
    lowered = F.lower(decoded)
    if keep is not None:
        lowered = F.regexp_replace(lowered, rf"(?U){URL_TEXT}", " ")
        lowered = F.regexp_replace(lowered, rf"(?U)[^{keep}{SPACE}]", " ")
    return squeeze(lowered)


def _cleaner(keep: str | None) -> Callable[[Column], Column]:
    return lambda text: _cleaned(unescape(text), keep)


STRICT = "a-z0-9"
clean_strict = _cleaner(STRICT)
clean_light = _cleaner(r"a-z0-9\-'!?")
clean_lower = _cleaner(None)


def raw_and_clean(text: Column) -> tuple[Column, Column]:
    """``normalize_raw(text)`` and ``clean_strict`` of that, with one pass through Python for both."""
    both = _both_views(_undecoded(text))
    raw = F.coalesce(both["text"], squeeze(F.coalesce(text, F.lit(""))))
    return raw, _cleaned(F.coalesce(both["again"], raw), STRICT)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used several times, or inside a lambda, is otherwise computed at
    every use; inside a lambda over an array that is quadratic.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"(?U){SOLID}+"))


def n_chars(text: Column) -> Column:
    return F.length(text)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _n_capital_words(text: Column) -> Column:
    return _count(text, rf"(?U){WORD_START}\p{{Lu}}")


def _n_allcaps_words(text: Column) -> Column:
    """Words of two or more characters with a capital and no small letter."""
    return _count(
        text, rf"(?U){WORD_START}(?={SOLID}*\p{{Lu}})[^{SPACE}\p{{Ll}}]{{2,}}{WORD_END}"
    )


def _is_title_case(word: Column) -> Column:
    return (
        word.rlike(UPPER) & ~word.rlike(UPPER_AFTER_LETTER) & ~word.rlike(LOWER_AFTER_OTHER)
    )


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def length_features(text: Column) -> dict[str, Column]:
    return {"word_count": n_words(text), "char_count": F.length(text)}


def eda_flags(text: Column) -> dict[str, Column]:
    return {
        "has_single_quotes": _flag(text.rlike(r"'[^']{1,40}'")),
        "ends_question": _flag(text.endswith("?")),
        "has_colon": _flag(text.contains(":")),
        "has_caps3": _flag(text.rlike(rf"(?U){ALLCAPS_RUN}")),
        "starts_with_number": _flag(text.rlike(r"(?U)^\d")),
        "caps3_word_count": _count(text, rf"(?U){ALLCAPS_RUN}"),
    }


def style_markers_8(text: Column) -> dict[str, Column]:
    # An empty headline still counts as one (empty) word, hence the floor of 1.
    total = F.greatest(n_words(text), F.lit(1))
    return {
        "has_question": _flag(text.contains("?")),
        "has_exclaim": _flag(text.contains("!")),
        "has_colon": _flag(text.contains(":")),
        "has_quote": _flag(text.rlike(f"[{QUOTE_CHARS}]")),
        "has_emdash": _flag(text.contains(EM_DASH)),
        "cap_word_ratio": _n_capital_words(text) / total,
        "allcap_word_ratio": _n_allcaps_words(text) / total,
        "digit_ratio": _count(text, r"\p{Nd}") / F.greatest(F.length(text), F.lit(1)),
    }


def style_features_16(text: Column) -> dict[str, Column]:
    count, chars = n_words(text), F.length(text)
    per_word, per_char = F.greatest(count, F.lit(1)), F.greatest(chars, F.lit(1))
    return {
        "len_chars": chars,
        "n_words": count,
        "mean_word_len": F.length(F.regexp_replace(text, GAP, "")) / per_word,
        "caps_word_ratio": _n_capital_words(text) / per_word,
        "allcaps_word_ratio": _n_allcaps_words(text) / per_word,
        "digit_ratio": _count(text, r"\p{Nd}") / per_char,
        "punct_ratio": _count(text, rf"(?U)[^\p{{L}}\p{{N}}{SPACE}]") / per_char,
        "has_question": _flag(text.contains("?")),
        "has_exclaim": _flag(text.contains("!")),
        "has_colon": _flag(text.contains(":")),
        "n_quotes": _count(text, f"[{QUOTE_CHARS}]"),
        "n_emdash": _count_char(text, EM_DASH),
        "n_hyphen": _count_char(text, "-"),
        "n_comma": _count_char(text, ","),
        # '' counts as starting with a quote: the empty prefix is in every set.
        "starts_with_quote": _flag((text == "") | text.rlike(f"^[{QUOTE_CHARS}]")),
        "ends_with_question": _flag(text.endswith("?")),
    }


def style_features_18(text: Column) -> dict[str, Column]:
    """Lexical part of the wide style set; ``n_words`` is floored at 1 here."""
    total = F.greatest(n_words(text), F.lit(1))
    distinct = F.size(F.array_distinct(words(text)))
    return {
        "ends_question": _flag(text.endswith("?")),
        "scare_quote_count": _count(text, r"'[^']{2,30}'"),
        "ellipsis_count": _count(text, r"\.\.\."),
        "exclamation_count": _count_char(text, "!"),
        "has_colon": _flag(text.contains(":")),
        "allcaps_word_count": _n_allcaps_words(text),
        "title_case_ratio": F.size(F.filter(words(text), _is_title_case)) / total,
        "has_says": _flag(text.rlike(rf"(?iU){SAYS}")),
        "has_report": _flag(text.rlike(rf"(?iU){REPORT}")),
        "has_sources": _flag(text.rlike(rf"(?iU){SOURCES}")),
        "has_allegedly": _flag(text.rlike(rf"(?iU){ALLEGEDLY}")),
        "n_words": total,
        "starts_with_number": _flag(text.rlike(r"(?U)^\d")),
        "type_token_ratio": distinct / total,
    }


def punct_counts_6(text: Column) -> dict[str, Column]:
    marks = {"n_exclaim": "!", "n_question": "?", "n_dquote": '"', "n_colon": ":", "n_hyphen": "-"}
    return {name: _count_char(text, mark) for name, mark in marks.items()} | {
        "len_chars": F.length(text)
    }


# The feature subsets kept at each selection stage.  The person
# columns come from ``operators.lexicon.entity_counts``.
SELECTED = {
    7: ("has_colon", "starts_with_number", "n_words", "char_count",
        "ends_question", "allcaps_word_count", "person_to_ent_ratio"),
    6: ("word_count", "char_count", "has_single_quotes", "ends_question",
        "has_colon", "has_caps3"),
    5: ("n_words", "scare_quote_count", "has_colon", "person_to_ent_ratio", "person_count"),
}


def style_selected(text: Column, stage: int) -> dict[str, Column]:
    """Text-derived members of one selection stage."""
    known = length_features(text) | eda_flags(text) | style_features_18(text)
    return {name: known[name] for name in SELECTED[stage] if name in known}


def stem(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){STEM_SUFFIX}", "")


def preview(text: Column, limit: int = 200) -> Column:
    flat = squeeze(text)
    return (
        F.when(is_missing(text), F.lit("(none)"))
        .when(F.length(flat) <= limit, flat)
        .otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))
    )


def unit_hash(*parts: Column) -> Column:
    """Uniform value in [0, 1) from md5: the same on every engine and partitioning."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def title_with_subtitle(
    title: Column, subtitle: Column, mode: str, key: Column | None = None, seed: int = 0
) -> Column:
    """``title``, ``full`` or ``mix`` (a seeded half of the rows keeps its subtitle)."""
    short = F.coalesce(title, F.lit(""))
    full = strip(F.concat_ws(" ", short, F.coalesce(subtitle, F.lit(""))))
    if mode == "title":
        return short
    if mode == "full":
        return full
    if mode == "mix":
        return F.when(unit_hash(key, F.lit(seed)) < 0.5, full).otherwise(short)
    raise ValueError(f"unknown mode {mode!r}")


def word_dropout(text: Column, key: Column, rate: float = 0.1, seed: int = 0) -> Column:
    """Drop about ``rate`` of the words; short or emptied texts stay as they are."""
    def drop(tokens: Column) -> Column:
        kept = F.filter(tokens, lambda w, i: unit_hash(key, i, F.lit(seed)) >= rate)
        return let(
            kept,
            lambda left: F.when(
                (F.size(tokens) > 2) & (F.size(left) > 0), F.array_join(left, " ")
            ).otherwise(text),
        )

    return let(words(text), drop)


def with_features(df, text_col: str, *families: Callable[[Column], dict[str, Column]]):
    """Append every feature of the given families as columns; a NULL text counts as empty."""
    features: dict[str, Column] = {}
    for family in families:
        features.update(family(F.coalesce(F.col(text_col), F.lit(""))))
    return df.withColumns(features)
