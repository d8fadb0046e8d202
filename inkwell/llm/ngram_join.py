"""Exact Jaccard join of word-shingle sets (operator 10).

Texts with equal sets collapse to one representative first.  A tile holds the
representatives of one band of size, and the larger ones of the next, that share a
rare shingle: with the shingles of every set in one common order, two sets of
similarity t or more share one of their first n - ceil(t n) + 1, and as a band
spans a factor 1 / t, the larger is of the same band or the next.  The order puts
frequent shingles last, as a table of counters estimates them, so a passage that
many texts share makes no tile.

A large group of near copies is contracted before pairs are made.  In every round
each member of a tile meets one pivot of the tile's largest component, and what is
linked becomes one component.  A pivot is a member that has the shared shingle early
in its order: few rare shingles, as edits make them, stand before it, so it is near
the middle of its group.  Then all pairs of different components that share a tile are
compared, if what follows the shared shingle in the order can still make up the
overlap.  A pair is first bounded by its bitmap signatures: bits of one that the
other lacks stand for shingles it lacks.  Pairs that pass are decided by
intersecting the sorted sets.  No link between components is lost: the estimates
only change the order, the rounds only what is already known to be linked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from inkwell.llm.common import components, enclosed, stored, table
from inkwell.llm.shingles import mixed, shingle_sets
from inkwell.llm.tokens import release, sliced

#: Similarity as a ratio of whole numbers.
SIMILAR = (75, 100)
#: Counters that estimate in how many texts a shingle is: 4 MB, whatever the size of the corpus.
COUNTERS = 1 << 20
#: Members of a tile that one task pairs with all others; larger tiles are split by salt.
SHARE = 1000
#: Rounds of contraction go on while more pairs than this for each text are possible and a round
#: leaves at most WORTH of them.  Both change the order of work, not the result.
PER_TEXT, WORTH = 4, 0.95


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    a = mixed(shingles + np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = mixed(shingles ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def signature(shingles: np.ndarray) -> bytes:
    """A bitmap of twice the set's size or more, a power of two; bit = hash modulo its width."""
    width = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """No two sets with these signatures and sizes share more shingles."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def is_similar(shared: int, n_a: int, n_b: int, similar: tuple[int, int] = SIMILAR) -> bool:
    return similar[1] * shared >= similar[0] * (n_a + n_b - shared)


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """Rows (id, n, f1, f2) of every text, and a row with the counters of every task."""

    def profile(batches):
        release()
        counters = np.zeros(COUNTERS, np.uint32)
        names = ["is_text", "id", "n", "f1", "f2", "counters"]
        for batch in sliced(batches):
            sets = shingle_sets(batch.column(1), width)
            prints = [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(sets), bool)), batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.nulls(len(sets), pa.binary())], names,
            )
            cells = np.concatenate([np.zeros(0, np.uint64), *sets]) & np.uint64(COUNTERS - 1)
            cells, times = np.unique(cells, return_counts=True)
            counters[cells.astype(np.int64)] += times.astype(np.uint32)
        packed = zstandard.ZstdCompressor(level=1).compress(counters.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([False]), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([packed], pa.binary())], names)

    return docs.mapInArrow(profile, "is_text boolean, id long, n long, f1 long, f2 long, counters binary")


def _counters(profile: DataFrame) -> np.ndarray:
    """The counters of all tasks, added up in a tree; no task and not the driver holds more than two."""

    def add(a: bytes, b: bytes) -> bytes:
        x, y = (np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint32) for c in (a, b))
        return zstandard.ZstdCompressor(level=1).compress((x + y).tobytes())

    rows = profile.where("NOT is_text").select("counters").rdd.map(lambda r: bytes(r[0]))
    none = zstandard.ZstdCompressor(level=1).compress(np.zeros(COUNTERS, np.uint32).tobytes())
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(rows.treeAggregate(none, add, add, 3)), np.uint32)


def _postings(docs: DataFrame, width: int, counters: np.ndarray, similar: tuple[int, int]) -> DataFrame:
    """Rows (key, id, n, place, null) of each text's first shingles in the common order, and one (null, id, n, null, signature)."""
    known = docs.sparkSession.sparkContext.broadcast(counters)

    def post(batches):
        counted = known.value
        for batch in sliced(batches):
            sets = shingle_sets(batch.column(1), width)
            ids = np.asarray(batch.column(0))
            keys = []
            for s in sets:
                n = len(s)
                first = n - -(-similar[0] * n // similar[1]) + 1 if n else 0
                # rare ones first; of equally frequent ones those with the smaller hash
                frequent = np.minimum(counted[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
                order = np.argsort((frequent << np.uint64(40)) | (s >> np.uint64(24)), kind="stable")
                keys.append(s[order[:first]])
            counts = np.array([len(k) for k in keys], np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            total = int(counts.sum())
            names = ["key", "id", "n", "place", "signature"]
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids, counts)),
                     pa.array(np.repeat(sizes, counts)), pa.array(np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)),
                     pa.nulls(total, pa.binary())], names,
                )
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(ids), pa.int64()), pa.array(ids), pa.array(sizes), pa.nulls(len(ids), pa.int64()), pa.array([signature(s) for s in sets], pa.binary())], names,
            )

    return docs.mapInArrow(post, "key long, id long, n long, place long, signature binary")


def _bounded(pairs: DataFrame, signatures: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose signatures allow the similarity."""

    def bound(batches):
        for batch in sliced(batches):
            x = batch.to_pydict()
            ok = [
                is_similar(overlap_bound(sa, na, sb, nb), na, nb, similar)
                for sa, na, sb, nb in zip(x["sa"], x["na"], x["sb"], x["nb"])
            ]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda side: signatures.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("signature").alias(f"s{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(bound, "a long, b long")


def _decided(pairs: DataFrame, texts: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def decide(batches):
        for batch in sliced(batches, 256):
            ok = [
                is_similar(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), similar)
                for s, t in zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda side: texts.select(F.col("id").alias(side), F.col("text").alias(f"t{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb").mapInArrow(decide, "a long, b long")


def band_limits(similar: tuple[int, int] = SIMILAR) -> list[int]:
    """The least size of every band; a similar larger set is at most one band up.  Exact, for sizes below 2 ** 40."""
    more, less = similar[::-1] if 4 * similar[1] >= 5 * similar[0] else (5, 4)
    limits, k = [], 0
    while not limits or limits[-1] < 1 << 40:
        limits.append(-(-(more**k) // less**k))
        k += 1
    return limits


def _can_be_similar(a: str, b: str, similar: tuple[int, int]) -> Column:
    """Whether sizes and places (n, place after the prefixes) allow it; exact where the key is the first that both share."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    left = F.least(n - F.col(f"p{a}"), m - F.col(f"p{b}"))
    return (F.least(n, m) * similar[1] >= F.greatest(n, m) * similar[0]) & ((similar[0] + similar[1]) * left >= similar[0] * (n + m))


def _member(turn: int) -> Column:
    """A member as a pivot, the least one best: by place, which later turns blur."""
    blur = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(100)) * turn
    return F.struct(((F.col("place") + 1) * (blur + 100)).alias("order"), "id", "n", "place")


def _tiles(posted: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Rows (key, band, home, id, n, place, many, pivot) of tiles with two members or more, one of them of the tile's own band.

    ``pivot`` is one member (order, id, n, place) of the tile.  Keys of a single text
    go before bands are made; bands need no other exchange.
    """
    values = band_limits(similar)
    limits = F.array(*(F.lit(x).cast("long") for x in values))
    # an estimate of the place in the limits, from 1, put right by the limits themselves
    near = F.least(F.greatest(F.floor(F.log(F.col("n")) / math.log(values[-1]) * (len(values) - 1)).cast("int") + 1, F.lit(2)), F.lit(len(values) - 1))
    band = near + (F.col("n") >= F.element_at(limits, near + 1)).cast("int") - (F.col("n") < F.element_at(limits, near)).cast("int")
    by_key, by_tile = Window.partitionBy("key"), Window.partitionBy("key", "band")
    shared = posted.where("key IS NOT NULL").select("key", "id", "n", "place").withColumn("m", F.count("*").over(by_key)).where("m > 1").drop("m")
    banded = shared.withColumn("own", band).select(
        "key", "id", "n", "place", F.explode(F.array(F.struct(F.col("own").alias("band"), F.lit(True).alias("home")), F.struct((F.col("own") - 1).alias("band"), F.lit(False).alias("home")))).alias("tile"),
    ).select("key", "tile.band", "tile.home", "id", "n", "place")
    return (
        banded.withColumn("many", F.count("*").over(by_tile)).withColumn("homes", F.sum(F.col("home").cast("long")).over(by_tile))
        .withColumn("pivot", F.min(_member(0)).over(by_tile)).where("many > 1 AND homes > 0").drop("homes")
    )


def _met(tiles: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """A pair (a, b) for every member b: of the pivots that it may be similar to, the one it meets in most tiles."""
    pairs = tiles.select(
        F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"),
        F.col("pivot.id").alias("a"), F.col("pivot.n").alias("na"), F.col("pivot.place").alias("pa"),
    ).where("a <> b").where(_can_be_similar("a", "b", similar))
    return pairs.groupBy("b", "a").count().groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b")


def _opened(tiles: DataFrame, groups: DataFrame, turn: int) -> tuple[DataFrame, int]:
    """The tiles that hold several components, with labels and a new pivot, and how many pairs these allow.

    The pivot is a member of the component with most members in the tile; another one in every turn.
    """
    labelled = tiles.drop("many", "pivot", "label").join(groups.withColumnRenamed("node", "id"), "id", "left")
    labelled = stored(labelled.withColumn("label", F.coalesce("component", "id")).drop("component"), "labelled-tiles")
    by_label = labelled.groupBy("key", "band", "label").agg(F.count("*").alias("c"), F.min(_member(turn)).alias("first"))
    by_tile = by_label.groupBy("key", "band").agg(
        F.sum("c").alias("many"), F.sum(F.col("c") * F.col("c")).alias("within"), F.max_by(F.struct("c", "first", "label"), F.struct("c", -F.col("first.order"), "label")).alias("top")
    ).where("top.c < many")
    by_tile = stored(by_tile.select("key", "band", "many", "within", F.col("top.first").alias("pivot"), F.col("top.label").alias("top")), "tile-pivots")
    possible = by_tile.agg(F.sum(F.col("many") * F.col("many") - F.col("within"))).first()[0]
    return labelled.join(by_tile.drop("within"), ["key", "band"]), (possible or 0) // 2


def _merged(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links; known components are single nodes for them."""
    if groups is None:
        return stored(components(links), "groups")
    label = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = stored(components(between).withColumnRenamed("component", "final"), "merged-groups")
    known = groups.join(merged.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    alone = merged.join(groups.select("node"), "node", "left_anti").select("node", F.col("final").alias("component"))
    return stored(known.union(alone), "groups")


def _cross_pairs(tiles: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b), a not the larger, of different components in one tile; a is of the tile's own band.

    The smaller members of a tile are dealt out by salt, SHARE to a part, and every part meets all members.
    """
    parts = F.ceil(F.col("many") / SHARE).cast("int")
    left = tiles.where("home").select(
        "key", "band", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"),
        F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("label").alias("la"),
    )
    right = tiles.select(
        "key", "band", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
        F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("label").alias("lb"),
    )
    return (
        left.join(right, ["key", "band", "part"]).where("la <> lb").where("na < nb OR (na = nb AND a < b)")
        .where(_can_be_similar("a", "b", similar)).select("a", "b").distinct()
    )


def similar_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similar: tuple[int, int] = SIMILAR
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) for every row.

    Null, empty and wordless texts have no shingles and link with nothing.  Ids name
    documents: rows that repeat an id are one document, linked by any of its rows.
    Rows with a null id are counted but link with nothing and have no component.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = stored(_profile(docs, width), "profile")
    texts = profile.where("is_text").drop("is_text", "counters")
    members = texts.where("n > 0 AND id IS NOT NULL")
    classes = members.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"))
    repeated = stored(members.groupBy("id").agg(F.count("*").alias("m")).where("m > 1").select("id"), "repeated-ids")
    copies = members.join(classes, ["f1", "f2", "n"]).where("id <> rep").select("id", "rep")
    copies = stored(copies.join(repeated, "id", "left_anti"), "copies")
    originals = docs.where("id IS NOT NULL").join(copies.select("id"), "id", "left_anti")
    posted = stored(_postings(originals, width, _counters(profile), similar), "postings")
    signatures = posted.where("key IS NULL AND n > 0").drop("key", "place")

    tiles = stored(_tiles(posted, similar), "tiles")
    texts_of = stored(originals.join(tiles.select("id").distinct(), "id", "left_semi"), "candidates")

    def links_among(pairs: DataFrame, label: str) -> DataFrame:
        bounded = stored(_bounded(stored(pairs, f"{label}-pairs"), signatures, similar), f"{label}-bounded")
        return stored(_decided(bounded, texts_of, width, similar), label)

    # contraction: members against pivots, while that pays
    before = (tiles.agg(F.sum(F.col("many") - 1)).first()[0] or 0) // 2
    enough = PER_TEXT * texts_of.count()
    groups, turn = _merged(None, links_among(_met(tiles, similar), "pivot-links")), 1
    tiles, possible = _opened(tiles, groups, turn)
    while enough < possible <= WORTH * before:
        before, turn = possible, turn + 1
        tiles = stored(tiles, "open-tiles")
        apart = tiles.where(F.col("label") != F.col("top")).drop("top")
        groups = _merged(groups, links_among(_met(apart, similar), "pivot-links"))
        tiles, possible = _opened(tiles.drop("top"), groups, turn)
    # what is left: every pair of different components
    roots = _merged(groups, links_among(_cross_pairs(tiles, similar), "cross-links")).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    follows = copies.join(roots, "rep", "left").select(F.col("id").alias("doc_id"), F.coalesce("root", "rep").alias("root"))
    named = roots.select(F.col("rep").alias("doc_id"), "root").union(follows)
    return texts.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles")).join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays.

    Of rows that repeat an id one stays; rows with a null id stay.  Null, empty and
    wordless texts are near copies of nothing; other columns are kept as they are,
    whatever their names.
    """
    found = stored(similar_texts(docs, id_col, text_col), "near-copies")
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("m"), F.min("component_id").alias("c"))
    ids = stored(ids.where("m > 1 OR c <> doc_id").select(F.col("doc_id").alias("_id"), (F.col("c") == F.col("doc_id")).alias("_first")), "not-single")
    rows = enclosed(docs, id=id_col)
    single = rows.join(ids, F.col("id") == F.col("_id"), "left_anti")
    again = rows.join(ids.where("_first").select("_id"), F.col("id") == F.col("_id"), "left_semi")
    return single.unionByName(again.dropDuplicates(["id"])).select("own.*")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles
  FROM w),
p AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, hash(unnest(shingles)) AS shingle FROM s),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents
          UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, min(root) AS component_id
FROM s JOIN reach ON node = doc_id GROUP BY doc_id, shingles
"""
