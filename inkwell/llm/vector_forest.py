"""Near-duplicate vectors by a forest of random-projection trees (operator 9).

Equal vectors collapse to one representative first.  Each tree halves a group of
vectors again and again at the median of a random projection; vectors near the
median go to both sides, so that close vectors seldom part.  A group's splits are
fitted on a bounded sample of it, but every vector goes down every tree.  A group
whose splits would part too many of its sampled links, such as a cluster of near
copies, is not split but compared whole, whatever its size.  Leaves
that are still too large are groups of the next round.  Vectors are compared in
double precision within the leaves, in blocks; a pair that meets in several
leaves counts in the first one only, and each leaf hands on counts and a spanning
forest of its links, never its pairs.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from inkwell.llm.common import components, stored, table

LEAST_COSINE = 0.93
TREES = 6
#: Vectors of a leaf, share of a group on each side of the median that goes both ways.
LEAF, SPILL = 512, 0.08
#: About so many vectors of a group fit its splits; fixed, whatever the size of the group.
SAMPLE = 4096
#: Sampled vectors of a node whose links show what a split parts.
PROBE = 512
#: Share of the sampled links that the splits above a leaf leave together, at least; a split that would part more is not made,
LEAST_TOGETHER = 0.7
#: if this share of the sampled pairs, and so many of them, are links.
DENSE, LEAST_SEEN = 0.002, 8
#: Vectors that one task sends down the trees.
DEAL = 20_000
#: Rounds after which the leaves are compared as they are.
ROUNDS = 8


def _number(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little", signed=True)


def fit_tree(sample: np.ndarray, size: int, seed: int, leaf: int = LEAF, spill: float = SPILL, least: float = LEAST_COSINE):
    """A tree of ("split", direction, low, high, left, right) and ("leaf", number, is final).

    ``size`` is the number of vectors of the whole group; the rows of ``sample`` have
    length 1.  A node is final when it cannot be split, since too many projections are
    equal or since the split would part too many links of at least ``least``.
    """
    random = np.random.default_rng(seed & (2**63 - 1))

    def parted(rows: np.ndarray, places: np.ndarray, low: float, high: float) -> float:
        """Share of the links among some rows that a split parts; 0 where links are too few to tell."""
        if len(rows) > PROBE:
            chosen = random.choice(len(rows), PROBE, replace=False)
            rows, places = rows[chosen], places[chosen]
        links = sample[rows] @ sample[rows].T >= least
        np.fill_diagonal(links, False)
        seen = links.sum() / 2
        if seen < LEAST_SEEN or seen < DENSE * len(rows) * (len(rows) - 1) / 2:
            return 0.0
        return links[places < low][:, places > high].sum() / seen

    def grow(rows: np.ndarray, expected: float, path: str, together: float):
        if expected <= leaf or len(rows) < 16:
            return "leaf", _number(seed, path), expected <= leaf
        direction = random.standard_normal(sample.shape[1]).astype(np.float32)
        places = sample[rows] @ direction
        low, high = np.quantile(places, [0.5 - spill, 0.5 + spill])
        left, right = rows[places <= high], rows[places >= low]
        if len(left) > 0.8 * len(rows) or len(right) > 0.8 * len(rows):
            return "leaf", _number(seed, path), True
        together *= 1 - parted(rows, places, low, high)
        if together < LEAST_TOGETHER:
            return "leaf", _number(seed, path), True
        share = expected / len(rows)
        return (
            "split", direction, low, high, grow(left, share * len(left), path + "l", together),
            grow(right, share * len(right), path + "r", together),
        )

    return grow(np.arange(len(sample)), float(size), "", 1.0)


def descend(tree, vectors: np.ndarray):
    """(leaf number, is final, rows) for all leaves that vectors reach."""
    waiting = [(tree, np.arange(len(vectors)))]
    while waiting:
        node, rows = waiting.pop()
        if not len(rows):
            continue
        if node[0] == "leaf":
            yield node[1], node[2], rows
        else:
            _, direction, low, high, left, right = node
            places = vectors[rows] @ direction
            waiting += [(left, rows[places <= high]), (right, rows[places >= low])]


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float32) for v in column])


def _unit(column) -> np.ndarray:
    vectors = _matrix(column).astype(np.float64)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def forest(
    vectors: DataFrame, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, least: float = LEAST_COSINE
) -> DataFrame:
    """(tree leaf as ``node``, id, n, vec) for every leaf that a vector reaches; vectors has (node, id, n, vec).

    The node of the input is the root group; vectors of different groups never meet.
    """
    done, rows = None, vectors.withColumn("final", F.lit(False))
    for turn in range(ROUNDS):
        sizes = stored(rows.groupBy("node").agg(F.count("*").alias("size"), F.max("final").alias("whole")), "node-sizes")
        open_nodes = sizes.where((F.col("size") > leaf) & ~F.col("whole"))
        if turn and not open_nodes.limit(1).count():
            break
        if not turn:
            open_nodes = sizes  # every group is planted at least once, so that it has leaves
        finished = rows.join(open_nodes.select("node"), "node", "left_anti")
        if turn:
            done = stored(finished if done is None else done.union(finished), "leaves")
        growing = rows.drop("final").join(open_nodes.select("node", "size"), "node")
        n_trees = trees if turn == 0 else 1

        chosen = growing.where(F.pmod(F.xxhash64("id", "node"), F.col("size")) < SAMPLE)
        models = stored(chosen.groupBy("node").applyInPandas(_fitter(n_trees, leaf, spill, least), "node long, model binary"), "trees")
        parts = F.ceil(F.col("size") / DEAL).cast("int")
        dealt = growing.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("size")
        copies = models.join(open_nodes.select("node", "size"), "node").select(
            "node", "model", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
        )
        rows = stored(
            dealt.groupBy("node", "part").cogroup(copies.groupBy("node", "part")).applyInPandas(
                _send, "node long, id long, n long, vec binary, final boolean"
            ),
            "forest",
        )
    every = rows if done is None else done.union(rows.join(done.select("node").distinct(), "node", "left_anti"))
    return every.select("node", "id", "n", "vec")


def _fitter(trees: int, leaf: int, spill: float, least: float):
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        node = int(frame["node"].iat[0])
        frame = frame.sort_values("id")
        sample = _unit(frame["vec"]).astype(np.float32)
        grown = [fit_tree(sample, int(frame["size"].iat[0]), _number(node, t), leaf, spill, least) for t in range(trees)]
        whole = [tree for tree in grown if tree[0] == "leaf" and tree[2]]
        grown = whole[:1] or grown  # where all meet in one leaf, other trees add nothing
        return pd.DataFrame({"node": [node], "model": [pickle.dumps(grown)]})

    return fit


def _send(frame: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    kinds = {"node": "int64", "id": "int64", "n": "int64", "vec": object, "final": bool}
    if frame.empty:
        return pd.DataFrame({k: pd.Series(dtype=v) for k, v in kinds.items()})
    if model.empty:  # no vector of the group fell into its sample
        return frame.assign(final=True)[list(kinds)]
    vectors = _unit(frame["vec"]).astype(np.float32)
    out = []
    for tree in pickle.loads(model["model"].iat[0]):
        for number, final, rows in descend(tree, vectors):
            out.append(frame.iloc[rows][["id", "n", "vec"]].assign(node=number, final=final))
    return pd.concat(out)[list(kinds)]


def _met_before(nodes_a, nodes_b, node: int) -> np.ndarray:
    """Whether two vectors share a leaf whose number is below ``node``, for every pair."""
    places: dict[int, int] = {}
    earlier = [[places.setdefault(x, len(places)) for x in nodes if x < node] for nodes in nodes_a]
    others = [[places[x] for x in nodes if x < node and x in places] for nodes in nodes_b]
    is_in = [np.zeros((len(rows), len(places)), np.float32) for rows in (earlier, others)]
    for matrix, rows in zip(is_in, (earlier, others)):
        for k, own in enumerate(rows):
            matrix[k, own] = 1
    return is_in[0] @ is_in[1].T > 0


def _spanning(links: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (row, column) that join all that a table of links joins, without cycles between its rows and columns."""
    a, b, new = [], [], np.ones(links.shape[1], bool)
    unseen = links.any(axis=1)
    for start in np.flatnonzero(unseen).tolist():
        waiting = [start] if unseen[start] else []
        unseen[start] = False
        while waiting:
            row = waiting.pop()
            for column in np.flatnonzero(links[row] & new).tolist():
                a.append(row)
                b.append(column)
                new[column] = False
                reached = np.flatnonzero(links[:, column] & unseen).tolist()
                unseen[reached] = False
                a += reached
                b += [column] * len(reached)
                waiting += reached
    return a, b


def _compare(least: float):
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        """Counts (id, None, count) and links (id, other, 0) of one tile of a leaf."""
        node, low, high = int(frame["node"].iat[0]), int(frame["low"].iat[0]), int(frame["high"].iat[0])
        frame = frame.sort_values("id").reset_index(drop=True)
        first, second = frame[frame["own"] == low], frame[frame["own"] == high]
        if first.empty or second.empty:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "other": pd.Series(dtype="Int64"), "links": pd.Series(dtype="int64")})
        links = _unit(first["vec"]) @ _unit(second["vec"]).T >= least
        ids_a, ids_b = first["id"].to_numpy(), second["id"].to_numpy()
        if low == high:
            links &= ids_a[:, None] < ids_b[None, :]
        # the smallest common leaf is the one in which the pair counts
        links &= ~_met_before(first["nodes"], second["nodes"], node)
        n_a, n_b = first["n"].to_numpy(), second["n"].to_numpy()
        counted = pd.DataFrame({"id": np.concatenate([ids_a, ids_b]), "links": np.concatenate([links @ n_b, n_a @ links])})
        counted = counted[counted["links"] > 0].groupby("id", as_index=False)["links"].sum()
        a, b = _spanning(links | links.T if low == high else links)
        joined = pd.DataFrame({"id": ids_a[a], "other": ids_b[b], "links": 0})
        return pd.concat([counted.assign(other=None), joined])[["id", "other", "links"]].astype(
            {"id": "int64", "other": "Int64", "links": "int64"}
        )

    return compare


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = LEAST_COSINE, trees: int = TREES, leaf: int = LEAF,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors are compared when their labels are equal and not null and their lengths
    agree.  Null and zero vectors, those with null or non-finite components and rows
    without an id link with nothing.  Equal vectors link with each other, whatever the
    forest does; repeated rows of one id count as vectors of their own.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<float>").alias("v"))
    usable = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    good = rows.where(usable)
    classes = good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = stored(classes, "vector-classes")
    members = stored(good.join(classes, ["label", "v"]).select("id", "rep", "n"), "vector-members")
    planted = classes.select(
        F.xxhash64("label", F.size("v")).alias("node"), F.col("rep").alias("id"), "n", _as_bytes(F.col("v")).alias("vec")
    )
    leaves = stored(forest(stored(planted, "planted"), trees, leaf, least=least), "forest-leaves")
    nodes = stored(leaves.groupBy("id").agg(F.collect_set("node").alias("nodes")), "vector-leaves")
    # leaves are compared in tiles of blocks; nearly all are a single block
    sizes = leaves.groupBy("node").agg(F.ceil(F.count("*") / (2 * leaf)).cast("int").alias("blocks"))
    own = leaves.join(nodes, "id").join(sizes, "node").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    compared = stored(
        tiles.select("node", "low", "high", "own", "id", "n", "vec", "nodes").groupBy("node", "low", "high")
        .applyInPandas(_compare(least), "id long, other long, links long"),
        "compared",
    )
    counts = compared.where("other IS NULL").groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(compared.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    groups = stored(groups.select(F.col("node").alias("rep"), "component"), "vector-components")
    found = members.join(counts, "rep", "left").join(groups, "rep", "left").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    out = found.union(rows.where(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(
        F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


@F.pandas_udf(T.BinaryType())
def _as_bytes(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: np.asarray(v, np.float32).tobytes())


def op9_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN embedding::DOUBLE[] END AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM v WHERE label IS NOT NULL AND v IS NOT NULL),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) >= 0.93 * (a.norm * b.norm)),
reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings
          UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b),
parts AS (SELECT node AS vec_id, min(root) AS component_id FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM parts LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""
