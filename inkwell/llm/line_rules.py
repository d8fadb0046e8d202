"""Line-first cleaning in built-in functions (operator 6).

Every line is judged by itself; failing lines and repeats of kept lines are
removed, and a document that loses too much of its text is rejected.  All work on
a document stays inside its row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkwell.llm.common import SPACE_CLASS, SPACES, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
#: Percent of words in repeated windows above which a document fails.
MOST_REPEATED = 30
#: Share of the lines' characters that a kept document may lose.
MOST_LOST = 0.5
#: Share of symbols among a line's characters above which it fails.
MOST_SYMBOLS = 0.05
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "enable javascript", "lorem ipsum", "privacy policy",
    "terms of service", "terms of use", "use of cookies",
)


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space, cut at single blanks after the other kinds became blanks."""
    for space in SPACES[1:]:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def line_fault(line: Column, symbols: Column) -> Column:
    """The first rule that a line with words breaks, else null."""
    word, gap = "[^" + SPACE_CLASS[1:] + "+", SPACE_CLASS + "+"
    four_words = line.rlike(gap.join([word] * 4))
    ended = line.rlike(r"[.!?:;)\"'…”»]" + SPACE_CLASS + "*$")
    lower = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate |= lower.contains(phrase)
    return (
        F.when(symbols > MOST_SYMBOLS * F.char_length(line), "punctuation")
        .when(~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}"), "capitals")
        .when(~four_words & ~ended, "navigation")
        .when(boilerplate, "boilerplate")
    )


def step(docs: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a column that stays a step of its own.

    The condition is always true, but not deterministic to Catalyst: it neither merges
    the step into a lambda, which would run it again for every element, nor moves a
    later filter below it, nor derives constraints, whose number doubles with every step.
    """
    return docs.withColumn(name, F.when(F.monotonically_increasing_id() >= 0, column))


def repeated_words(docs: DataFrame) -> DataFrame:
    """Add n_repeat_words for a column ``_words``: words in windows of eight that occur twice or more.

    Windows are compared by hash; only where two are equal are they sorted, by hash and place.
    """
    last = F.size("_hash") - WINDOW
    docs = step(docs, "_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    docs = step(
        docs, "_windows",
        F.when(last < 0, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get("_hash", i + k) for k in range(WINDOW))))),
    )
    docs = step(
        docs, "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )

    def again(item: Column, j: Column) -> Column:
        before = F.when(j > 0, F.get("_sorted", j - 1)["h"])
        after = F.get("_sorted", j + 1)["h"]
        return F.coalesce(before == item["h"], F.lit(False)) | F.coalesce(after == item["h"], F.lit(False))

    docs = step(docs, "_places", F.sort_array(F.transform(F.filter("_sorted", again), lambda item: item["i"])))
    reach = F.transform("_places", lambda p, j: F.least(F.coalesce(F.get("_places", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda total, n: total + n)
    return step(docs, "n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_hash", "_windows", "_sorted", "_places")


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, clean_text, counts, faults (the rules that lines broke), base_failed, kept.

    A null text is an empty one; texts without words have no lines and fail.  Rows are
    judged by themselves, so repeated rows get equal results.
    """
    blank = F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), blank).alias("_text"))
    rows = step(rows, "_words", words_of(F.col("_text")))
    rows = repeated_words(rows)
    letters = F.aggregate("_words", F.lit(0).cast("long"), lambda total, w: total + F.char_length(w))
    rows = step(step(rows, "n_words", F.size("_words").cast("long")), "word_chars", letters).drop("_words")
    rows = step(rows, "_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^" + SPACE_CLASS[1:])))
    rows = step(rows, "_counted", F.transform("_lines", lambda x: F.struct(x.alias("line"), n_symbols(x).alias("symbols"))))
    rows = step(
        rows, "_judged",
        F.transform("_counted", lambda x: F.struct(x["line"].alias("line"), line_fault(x["line"], x["symbols"]).alias("fault"))),
    )
    good = F.transform(F.filter("_judged", lambda x: x["fault"].isNull()), lambda x: x["line"])
    rows = step(rows, "_good", F.array_distinct(good))

    def chars(lines: str) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda total, x: total + F.char_length(x))

    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.select(
        "doc_id", F.array_join("_good", "\n").alias("clean_text"), "n_words", "word_chars",
        F.aggregate("_counted", F.lit(0).cast("long"), lambda total, x: total + x["symbols"]).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        chars("_lines").alias("line_chars"), chars("_good").alias("clean_chars"),
        F.filter(F.transform("_judged", lambda x: x["fault"]), lambda x: x.isNotNull()).alias("faults"),
        base_failed.alias("base_failed"),
    )
    return step(rows, "kept", ~F.col("base_failed") & (F.col("line_chars") - F.col("clean_chars") <= MOST_LOST * F.col("line_chars")))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP6_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text,
        list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM t),
wins AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
         FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
            FROM again, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
judged AS (SELECT doc_id, list_filter(lines, lambda x:
    NOT (length(x) - length(translate(x, '#*$%&|<>', '')) > {MOST_SYMBOLS} * length(x))
    AND NOT (NOT regexp_matches(x, '\p{{Ll}}') AND regexp_matches(x, '\p{{Lu}}'))
    AND NOT (len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) < 4
             AND NOT regexp_matches(x, '[.!?:;)"''\x{{2026}}\x{{201D}}\x{{00BB}}][\x20\x09-\x0D]*$'))
    AND NOT regexp_matches(lower(x), '{"|".join(BOILERPLATE)}')) AS good
  FROM w),
counts AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        length(array_to_string(lines, '')) AS line_chars, length(array_to_string(list_distinct(good), '')) AS clean_chars
  FROM w JOIN judged USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
           AND line_chars - clean_chars <= {MOST_LOST} * line_chars AS kept
FROM counts
"""
