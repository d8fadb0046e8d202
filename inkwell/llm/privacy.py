"""Personal data by patterns and by bootstrapped contexts, in built-in functions (operator 5).

Plain patterns find the base spans inside each row.  They are the seeds: the words
around them are lexical patterns, and everything shaped like an identifier is an
instance that some patterns surround.  A pattern is as good for a kind as the
instances it surrounds are of that kind, an unknown instance as good as its
patterns; a few rounds of scoring over the pattern-instance graph carry the kinds
from the seeds to unknown instances, and those that score high are added.

Long runs cannot blow up a pattern: every repetition is possessive or over one
character class, and a match never starts inside a run that has failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkwell.llm.common import enclosed, stored, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Shapes of possible identifiers: numbers with their punctuation, and anything around an at sign.
SHAPE = rf"[+(]?[0-9][\x20().0-9/:-]*[0-9]|(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9._-]++"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
#: Characters around an instance in which its context words are looked for.
CONTEXT = 80
ROUNDS = 4
#: A pattern needs so many different seeds of a kind; scores are then smoothed by PRIOR unknown instances.
LEAST_SEEDS, PRIOR = 3, 1.0
#: Score from which an unknown instance is added.
ADD_FROM = 0.6
#: Digits that an added instance of a numeric kind needs.
LEAST_DIGITS = {"ip": 4, "card": 12, "phone": 7}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(IP_PARTS)
    n = F.char_length(_digits(match))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), F.call_function("luhn_check", _digits(match))).otherwise(False)
    return (n >= 9) & (n <= 15)


def _placed(matches: str, text: str) -> Column:
    """array<struct<start, end, match>> of matches that follow one another; in code points, end exclusive.

    Each match is the first occurrence of its string after the match before it.
    """
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    zero = F.struct(F.lit(1).alias("next"), none.alias("found"))

    def step(state: Column, match: Column) -> Column:
        at = F.position(match, F.col(text), state["next"])
        end = at - 1 + F.char_length(match)
        span = F.struct((at - 1).alias("start"), end.alias("end"), match.alias("match"))
        return F.struct((end + 1).alias("next"), F.concat(state["found"], F.array(span)).alias("found"))

    return F.when(F.size(matches) > 0, F.aggregate(matches, zero, step, lambda s: s["found"])).otherwise(none)


def with_base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``_text`` (null: empty) and ``_base``: array<struct<kind, start, end, match>> by kind as listed, then start."""
    docs = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    some = F.col("_text").rlike("[0-9@]")
    none = F.array().cast("array<string>")
    parts = []
    for kind in KINDS:
        docs = docs.withColumn(f"_m_{kind}", F.when(some, F.regexp_extract_all("_text", F.lit(PATTERNS[kind]), 0)).otherwise(none))
        parts.append(
            F.transform(
                F.filter(_placed(f"_m_{kind}", "_text"), lambda s: _passes(kind, s["match"])),
                lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")),
            )
        )
    return docs.withColumn("_base", F.concat(*parts)).drop(*(f"_m_{k}" for k in KINDS))


def _instances(docs: DataFrame) -> DataFrame:
    """A row per identifier-shaped span: id, key, start, end, match, kind (null: unknown), patterns.

    ``docs`` has id, key, _text and _base.
    """
    shaped = docs.where(F.col("_text").rlike("[0-9@]"))
    shaped = shaped.withColumn("_m", F.regexp_extract_all("_text", F.lit(SHAPE), 0))
    shaped = shaped.withColumn("_shaped", F.filter(_placed("_m", "_text"), lambda s: F.char_length(s["match"]) >= 5))

    def hits(span: Column) -> Column:
        return F.exists("_base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))

    unknown = F.transform(
        F.filter("_shaped", lambda s: ~hits(s)),
        lambda s: F.struct(F.lit(None).cast("string").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")),
    )
    rows = shaped.select("id", "key", "_text", F.explode(F.concat("_base", unknown)).alias("s")).select("id", "key", "_text", "s.*")
    before = F.substring("_text", F.greatest(F.col("start") - CONTEXT + 1, F.lit(1)), F.least(F.col("start"), F.lit(CONTEXT)))
    after = F.substring("_text", F.col("end") + 1, F.lit(CONTEXT))

    def words(text: Column) -> Column:
        bare = F.transform(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", ""))
        return F.filter(F.transform(bare, lambda w: F.regexp_replace(w, "[0-9]", "0")), lambda w: w != "")

    rows = rows.withColumn("_left", F.slice(F.reverse(words(before)), 1, 2)).withColumn("_right", F.slice(words(after), 1, 1))
    patterns = F.array_compact(
        F.array(
            F.when(F.size("_left") == 2, F.concat(F.lit("left "), F.element_at("_left", 2), F.lit(" "), F.element_at("_left", 1))),
            F.when(
                (F.size("_left") > 0) & (F.size("_right") > 0),
                F.concat(F.lit("both "), F.element_at("_left", 1), F.lit(" _ "), F.element_at("_right", 1)),
            ),
        )
    )
    return rows.select("id", "key", "start", "end", "match", "kind", patterns.alias("patterns"))


def discovered(docs: DataFrame) -> DataFrame:
    """id, key, kind, start, end of spans that contexts add to the base spans of id, key, _text, _base."""
    instances = stored(_instances(docs), "instances")
    # the graph: an instance is a string, with its kind where it is a seed; counted before anything is joined
    edges = stored(
        instances.select("match", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "match").agg(F.max("kind").alias("kind")),
        "context-graph",
    )
    seeds = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").count().where(F.col("count") >= LEAST_SEEDS)
    # only patterns with enough seeds can score, so the rounds work on their edges alone
    edges = stored(edges.join(seeds.select("pattern").distinct(), "pattern", "left_semi"), "context-edges")
    known = edges.where("kind IS NOT NULL").select("match", "kind", F.lit(1.0).alias("score")).distinct()
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    scores = known
    for _ in range(ROUNDS):
        support = edges.select("pattern", "match").join(scores, "match").groupBy("pattern", "kind").agg(F.sum("score").alias("support"))
        good = (
            support.join(size, "pattern").join(seeds.drop("count"), ["pattern", "kind"], "left_semi")
            .select("pattern", "kind", (F.col("support") / (F.col("n") + PRIOR)).alias("confidence"))
        )
        # an instance is wrong for a kind only if all its patterns are: noisy or
        guessed = (
            edges.where("kind IS NULL").select("match", "pattern").join(good, "pattern").groupBy("match", "kind")
            .agg((1 - F.exp(F.sum(F.log(1.0 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
        )
        scores = stored(known.union(guessed), "context-scores")
    best = (
        scores.join(known.select("match"), "match", "left_anti").groupBy("match")
        .agg(F.max(F.struct(F.round("score", 9).alias("score"), "kind")).alias("best")).select("match", "best.*")
        .where(F.col("score") >= ADD_FROM)
    )
    n = F.char_length(_digits(F.col("match")))
    plausible = F.when(F.col("kind") == "email", F.col("match").contains("@"))
    for kind, least in LEAST_DIGITS.items():
        plausible = plausible.when(F.col("kind") == kind, (n >= least) & ~F.col("match").contains("@"))
    best = best.where(plausible).select("match", "kind")
    return stored(instances.where("kind IS NULL").drop("kind", "patterns").join(best, "match").select("id", "key", "kind", "start", "end"), "discovered")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with ``_base`` and ``_spans`` (base and added, array<struct<kind, start, end>>, sorted).

    A null text is empty.  Rows that agree in id and text have the same spans.  Where
    no context is learned, nothing is added; base spans always stay.
    """
    rows = with_base_spans(docs, text_col).withColumn("_key", F.xxhash64("_text"))
    added = discovered(rows.select(F.col(id_col).alias("id"), F.col("_key").alias("key"), "_text", "_base"))
    by_row = added.groupBy(F.col("id").alias("_id"), F.col("key").alias("_text_key")).agg(F.collect_set(F.struct("kind", "start", "end")).alias("_added"))
    joined = rows.join(
        stored(by_row, "added-spans"), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text_key")), "left"
    ).drop("_id", "_text_key", "_key")
    bare = F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    ordered = F.transform(
        F.sort_array(
            F.transform(
                F.concat(bare, F.coalesce("_added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))),
                lambda s: F.struct(F.array_position(F.array(*(F.lit(k) for k in KINDS)), s["kind"]).alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
            )
        ),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return joined.withColumn("_spans", ordered).drop("_added")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; the outermost of overlapping spans counts.

    Texts without spans, null and empty ones among them, stay as they are; rows equal in
    id and text are changed alike; other columns are kept, whatever their names.
    """
    rows = find_personal_data(enclosed(docs, id=id_col, text=text_col), "id", "text")
    by_start = F.sort_array(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("done"), F.lit("").alias("text"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("_text"), state["done"] + 1, F.greatest(s["start"] - state["done"], F.lit(0)))
        more = F.struct((-s["back"]).alias("done"), F.concat(state["text"], gap, F.lit("["), s["kind"], F.lit("]")).alias("text"))
        return F.when(s["start"] >= state["done"], more).otherwise(F.struct(F.greatest(state["done"], -s["back"]).alias("done"), state["text"].alias("text")))

    clean = F.aggregate(by_start, zero, step, lambda s: F.concat(s["text"], F.substring(F.col("_text"), s["done"] + 1, F.char_length("_text"))))
    changed = F.when(F.size("_spans") > 0, clean).otherwise(F.col("text"))
    return rows.select(*(changed.alias(c) if c == text_col else F.col(f"own.`{c}`").alias(c) for c in docs.columns))


def op5_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    return rows.select("doc_id", *counts, F.sha2(_listed("_base").cast("binary"), 256).alias("base_sha256"), _listed("_spans").alias("spans"))
