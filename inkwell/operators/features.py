"""Feature vectors for MLlib: TF-IDF views, style block, embeddings, reduction."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.storagelevel import StorageLevel

from inkwell.functions.text import raw_and_clean, stem, style_features_16, with_features
from inkwell.operators.counting import Analyzer, Vocabulary, weighted
from inkwell.session import delete_scratch, scratch_path, written


class TableWriter(DefaultParamsWriter):
    """Parameters, and the tables of a model next to them."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        for name, table in self.instance.tables().items():
            table.write.parquet(f"{path}/{name}")


class TableReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        model.restore(lambda name: self.sparkSession.read.parquet(f"{path}/{name}"))
        return model


class TableModel(Model, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """A model that is saved as parameters and tables: ``tables()`` gives them, ``restore(read)`` takes them."""

    def write(self) -> TableWriter:
        return TableWriter(self)

    @classmethod
    def read(cls) -> TableReader:
        return TableReader(cls)


class _TextView(HasInputCol, HasOutputCol):
    """How a text column becomes weighted terms; shared by the estimator and its model."""

    analyzer = Param(Params._dummy(), "analyzer", "word or char", TypeConverters.toString)
    nMin = Param(Params._dummy(), "nMin", "shortest n-gram", TypeConverters.toInt)
    nMax = Param(Params._dummy(), "nMax", "longest n-gram", TypeConverters.toInt)
    stopWords = Param(Params._dummy(), "stopWords", "words to drop", TypeConverters.toListString)
    sublinear = Param(Params._dummy(), "sublinear", "use 1 + ln(count)", TypeConverters.toBoolean)

    def _view(self) -> Analyzer:
        get = self.getOrDefault
        return Analyzer(get("analyzer"), get("nMin"), get("nMax"), tuple(get("stopWords")))


class TfidfVectors(Estimator, _TextView, DefaultParamsReadable, DefaultParamsWritable):
    """A text column to normalised TF-IDF vectors with ``idf = ln((1 + n) / (1 + df)) + 1``.

    Counts stay in the row; partial sums by term are all that is shuffled to fit.  The
    vocabulary is a table: it goes to the tasks if its measured size allows it and is
    joined by term otherwise.  ``vocabSize`` keeps the most frequent terms, 0 all that
    the document frequencies allow.
    """

    vocabSize = Param(Params._dummy(), "vocabSize", "terms kept, by corpus frequency; 0: all", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "least number of documents", TypeConverters.toFloat)
    maxDF = Param(Params._dummy(), "maxDF", "largest share of documents", TypeConverters.toFloat)

    def __init__(
        self, inputCol=None, outputCol=None, analyzer="word", nMin=1, nMax=1, stopWords=(), vocabSize=0, minDF=1.0, maxDF=1.0, sublinear=False,
    ):
        super().__init__()
        self._setDefault(analyzer="word", nMin=1, nMax=1, stopWords=[], vocabSize=0, minDF=1.0, maxDF=1.0, sublinear=False)
        if inputCol:
            self._set(
                inputCol=inputCol, outputCol=outputCol, analyzer=analyzer, nMin=nMin, nMax=nMax, stopWords=list(stopWords),
                vocabSize=vocabSize, minDF=float(minDF), maxDF=float(maxDF), sublinear=sublinear,
            )

    def _fit(self, df: DataFrame) -> "TermWeights":
        get = self.getOrDefault
        return self.model(Vocabulary.fit(df, self.getInputCol(), self._view(), get("minDF"), get("maxDF"), get("vocabSize") or None))

    def model(self, vocabulary: Vocabulary) -> "TermWeights":
        """The model with a vocabulary counted elsewhere."""
        if not vocabulary.size:
            raise ValueError("no term is left in the vocabulary")
        get = self.getOrDefault
        out = TermWeights()
        out._set(
            inputCol=self.getInputCol(), outputCol=self.getOutputCol(), analyzer=get("analyzer"), nMin=get("nMin"), nMax=get("nMax"),
            stopWords=get("stopWords"), sublinear=get("sublinear"),
        )
        out.vocabulary = vocabulary
        return out


class TermWeights(TableModel, _TextView):
    """Fitted :class:`TfidfVectors`; ``vocabulary.table`` has the terms with their places in the vectors."""

    vocabulary: Vocabulary

    def __init__(self):
        super().__init__()
        self._setDefault(analyzer="word", nMin=1, nMax=1, stopWords=[], sublinear=False)

    def _transform(self, df: DataFrame) -> DataFrame:
        return weighted(df, self.getInputCol(), self._view(), self.vocabulary, self.getOrDefault("sublinear"), self.getOutputCol())

    def tables(self) -> dict[str, DataFrame]:
        return {"terms": self.vocabulary.table}

    def restore(self, read: Callable[[str], DataFrame]) -> None:
        self.vocabulary = Vocabulary(read("terms"), True)


class StyleVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The 16 style features of a text column as one vector."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        if inputCol:
            self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        features = style_features_16(F.coalesce(F.col(self.getInputCol()), F.lit("")))
        values = F.array(*[c.cast("double") for c in features.values()])
        return df.withColumn(self.getOutputCol(), array_to_vector(values))


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Explicit map whose inner product approximates an RBF kernel (Rahimi & Recht 2007)."""

    size = Param(Params._dummy(), "size", "number of random features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the random directions", TypeConverters.toInt)

    def __init__(self, inputCol=None, outputCol=None, size=256, gamma=1.0, seed=0):
        super().__init__()
        self._setDefault(size=256, gamma=1.0, seed=0)
        if inputCol:
            self._set(inputCol=inputCol, outputCol=outputCol, size=size, gamma=gamma, seed=seed)

    def _transform(self, df: DataFrame) -> DataFrame:
        size, gamma, seed = (self.getOrDefault(p) for p in ("size", "gamma", "seed"))

        @F.pandas_udf("array<double>")
        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weights = None
            for batch in batches:
                if not len(batch):
                    yield pd.Series([], dtype=object)
                    continue
                x = np.vstack(batch.to_numpy())
                if weights is None:
                    rng = np.random.default_rng(seed)
                    weights = rng.normal(0.0, np.sqrt(2.0 * gamma), (x.shape[1], size))
                    shift = rng.uniform(0.0, 2.0 * np.pi, size)
                yield pd.Series(list(np.sqrt(2.0 / size) * np.cos(x @ weights + shift)))

        return df.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol()))))


def entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the stored elements of a batch of vectors, sparse or dense, in order of rows."""
    kinds, _, indices, values = (vectors.field(k) for k in range(4))
    sizes = np.diff(values.offsets.to_numpy())
    rows = np.repeat(np.arange(len(sizes)), sizes)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    sparse = kinds.to_numpy(zero_copy_only=False)[rows] == 0
    if not len(flat):
        return rows, rows, flat
    places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    return rows, places, flat


def _times(vectors: pa.StructArray, matrix: np.ndarray) -> np.ndarray:
    """Vectors times a (features x k) matrix, column by column."""
    rows, places, values = entries(vectors)
    return np.stack([np.bincount(rows, values * matrix[places, j], len(vectors)) for j in range(matrix.shape[1])], axis=1)


class LinearProjection(TableModel):
    """Multiplies each vector by a fixed (features x k) matrix, e.g. SVD directions."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None, matrix: np.ndarray | None = None):
        super().__init__()
        self.matrix = matrix
        if inputCol:
            self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        name, out = self.getInputCol(), self.getOutputCol()
        shipped = df.sparkSession.sparkContext.broadcast(self.matrix)
        kept = [n for n in df.columns if n != out]

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low = _times(batch["_v"], shipped.value)
                values = pa.ListArray.from_arrays(np.arange(len(low) + 1, dtype=np.int32) * low.shape[1], pa.array(low.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), values], [*kept, "_v"])

        kinds = T.StructType([*(df.schema[n] for n in kept), T.StructField("_v", T.ArrayType(T.DoubleType()))])
        rows = df.select(*kept, F.unwrap_udt(name).alias("_v")).mapInArrow(project, kinds)
        return rows.select(*kept, array_to_vector("_v").alias(out))

    def tables(self) -> dict[str, DataFrame]:
        rows = pa.table({"place": np.arange(len(self.matrix)), "row": pa.array(list(self.matrix), pa.list_(pa.float64()))})
        return {"matrix": SparkSession.active().createDataFrame(rows)}

    def restore(self, read: Callable[[str], DataFrame]) -> None:
        self.matrix = np.array(read("matrix").orderBy("place").toArrow()["row"].to_pylist())


def text_views(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``text`` (cased) and ``text_clean`` (lowercase alphanumerics)."""
    raw, clean = raw_and_clean(F.col(text_col))
    return df.withColumns({"text": raw, "text_clean": clean})


def tfidf_stages(
    input_col: str, out: str, analyzer: str = "word", n_min: int = 1, n_max: int = 1,
    min_df: float = 1.0, max_df: float = 1.0, vocab_size: int | None = None, sublinear: bool = False,
    stop: Sequence[str] = (),
) -> list:
    """Pipeline stages for one TF-IDF view.

    The vocabulary is what ``min_df`` and ``max_df`` leave; ``vocab_size`` cuts it to the
    most frequent terms only where a model is defined that way.
    """
    return [TfidfVectors(input_col, out, analyzer, n_min, n_max, stop, vocab_size or 0, min_df, max_df, sublinear)]


def feature_union(out: str = "features") -> Pipeline:
    """Word, character and scaled style blocks, each from its own text view."""
    return Pipeline(
        stages=[
            *tfidf_stages("text_clean", "_word", n_min=1, n_max=2, min_df=2, max_df=0.95, sublinear=True),
            *tfidf_stages("text", "_char", "char", 3, 5, min_df=2, max_df=0.98, sublinear=True),
            StyleVector("text", "_style_raw"),
            StandardScaler(inputCol="_style_raw", outputCol="_style", withMean=False, withStd=True),
            VectorAssembler(inputCols=["_word", "_char", "_style"], outputCol=out),
        ]
    )


def scale_columns(df: DataFrame, fit_on: DataFrame, cols: Sequence[str], with_mean: bool = True) -> DataFrame:
    """Standardise columns with mean and population std of ``fit_on`` (train rows only).

    MLlib's ``StandardScaler`` divides by the sample std; the population form here
    is larger by ``sqrt(n / (n - 1))``.  A constant column is left unscaled.
    """
    one = {"_all": F.lit(0)}
    stats = fit_on.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in cols],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"_s_{c}") for c in cols],
    ).withColumns(one)
    scaled = {}
    for c in cols:
        centred = F.col(c) - F.col(f"_m_{c}") if with_mean else F.col(c).cast("double")
        scaled[c] = centred / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return (
        df.withColumns(one).join(F.broadcast(stats), "_all").withColumns(scaled)
        .drop("_all", *[f"_{k}_{c}" for c in cols for k in "ms"])
    )


def as_vector(df: DataFrame, array_col: str, out: str) -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def fuse_features(
    style: DataFrame, vectors: DataFrame, key_col: str, style_cols: Sequence[str], vector_col: str,
    out: str = "features", check: bool = True,
) -> DataFrame:
    """Join both feature sets by key and assemble one vector.

    With ``check``, keys present on one side only or repeated raise an error; without,
    every key of either side comes back, ``missing`` names the side without it (style or
    vector) and its vector is null.
    """
    if check:
        tally = style.select(key_col, F.lit(1).alias("s"), F.lit(0).alias("v")).unionByName(
            vectors.select(key_col, F.lit(0).alias("s"), F.lit(1).alias("v"))
        )
        odd = tally.groupBy(key_col).agg(F.sum("s").alias("s"), F.sum("v").alias("v")).filter("s <> 1 or v <> 1")
        if not odd.isEmpty():
            raise ValueError("feature sets do not match one to one")
    left = style.select(key_col, F.array(*(F.col(c).cast("double") for c in style_cols)).alias("_style"))
    right = vectors.select(key_col, F.col(vector_col).cast("array<double>").alias("_dense"))
    joined = left.join(right, key_col, "inner" if check else "full_outer")
    fused = array_to_vector(F.concat("_style", "_dense"))  # null where a side is
    if check:
        return joined.select(key_col, fused.alias(out))
    missing = F.when(F.col("_style").isNull(), "style").when(F.col("_dense").isNull(), "vector")
    both = F.when(missing.isNull(), F.concat("_style", "_dense"))
    return joined.select(key_col, both.alias("_both"), missing.alias("missing")).select(
        key_col, F.when(F.col("_both").isNotNull(), array_to_vector(F.coalesce("_both", F.array().cast("array<double>")))).alias(out), "missing"
    )


#: Directions fitted beyond those asked for, rounds at most, change of a squared singular value that ends them.
OVERSAMPLE, ROUNDS, TOLERANCE = 10, 6, 1e-7
#: Features of a block of a product that is summed in one place.
FEATURE_BLOCK = 8192


def _gram_product(rows: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """X'X times a (features x k) matrix, for vectors X in column ``v``.

    Every task sums its rows into a (features x k) array; the sums of a block of features meet in one place.
    """
    spark, (size, width) = rows.sparkSession, matrix.shape
    shipped = spark.sparkContext.broadcast(matrix)

    def partial(batches):
        total = np.zeros((width, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            at, places, values = entries(batch["v"])
            low = _times(batch["v"], shipped.value)
            for j in range(width):
                total[j] += np.bincount(places, values * low[at, j], size)
        for start in range(0, size, FEATURE_BLOCK):
            part = np.ascontiguousarray(total[:, start : start + FEATURE_BLOCK])
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([start], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["start", "sums"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(part) for part in parts["sums"]], axis=0)
        return pd.DataFrame({"start": parts["start"].iloc[:1], "sums": [total.tobytes()]})

    kinds = "start int, sums binary"
    out = np.zeros((width, size))
    for row in rows.mapInArrow(partial, kinds).groupBy("start").applyInPandas(add, kinds).toLocalIterator():
        part = np.frombuffer(bytes(row["sums"])).reshape(width, -1)
        out[:, row["start"] : row["start"] + part.shape[1]] = part
    shipped.unpersist()
    return out.T


#: A (features x k) matrix of more bytes stays in tables of feature blocks, and is never collected nor sent whole.
MATRIX_BYTES = 32 << 20
#: Stored elements of a block of rows that one task multiplies, and of one record of it.
ROW_BLOCK, RECORD = 4 << 20, 1 << 18
#: Columns of a matrix in feature blocks that are multiplied at a time.
SLICE = 16
#: Feature blocks whose random start is drawn in one stream.
SECTION = 64

PARTS = "start int, sums binary"


def _matrix(part, width: int) -> np.ndarray:
    return np.frombuffer(part.as_py()).reshape(-1, width)


def _parts(start: Sequence[int], sums: Sequence[np.ndarray]) -> pa.Table:
    return pa.table({"start": pa.array(start, pa.int32()), "sums": pa.array([np.ascontiguousarray(x).tobytes() for x in sums], pa.binary())})


class _RowBlocks:
    """Vectors cut into blocks of rows, to be multiplied by a matrix that lies in blocks of features.

    A block of rows receives the matrix rows of the features that it holds, and no others.
    """

    def __init__(self, df: DataFrame, vector_col: str):
        """``df`` has the vectors; its other columns come back from :meth:`project`."""
        self.own = [n for n in df.columns if n != vector_col]
        own, fields = self.own, T.StructType([df.schema[n] for n in df.columns if n != vector_col])

        def cut(batches):
            number, held, seen = TaskContext.get().partitionId() << 32, 0, 0
            for batch in batches:
                ends = batch["_v"].field(3).offsets.to_numpy()
                at = 0
                while at < batch.num_rows:
                    end = min(max(at + 1, int(np.searchsorted(ends, ends[at] + RECORD, "right")) - 1), batch.num_rows)
                    part = batch.slice(at, end - at)
                    rows, places, values = entries(part["_v"])
                    if held and held + len(rows) > ROW_BLOCK:
                        number, held, seen = number + 1, 0, 0
                    columns = pa.StructArray.from_arrays([part[n] for n in own], own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number]), pa.array([seen], pa.int32()), pa.array([(rows + seen).astype(np.int32).tobytes()], pa.binary()),
                            pa.array([places.astype(np.int32).tobytes()], pa.binary()), pa.array([values.astype(float).tobytes()], pa.binary()),
                            pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), columns),
                        ],
                        ["block", "first", "rows", "places", "values", "own"],
                    )
                    held, seen, at = held + len(rows), seen + part.num_rows, end

        kinds = T._parse_datatype_string("block long, first int, rows binary, places binary, values binary").add("own", T.ArrayType(fields))
        stored = F.col(vector_col) if isinstance(df.schema[vector_col].dataType, T.StructType) else F.unwrap_udt(vector_col)
        self.tiles = df.select(*own, stored.alias("_v")).mapInArrow(cut, kinds).persist(StorageLevel.MEMORY_AND_DISK)
        self.fields = fields

        def wanted(table: pa.Table) -> pa.Table:
            ids = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table["places"]]))
            starts, at = np.unique(ids // FEATURE_BLOCK, return_index=True)
            return pa.table({
                "block": pa.array(np.full(len(starts), table["block"][0].as_py(), np.int64)), "start": pa.array(starts.astype(np.int32)),
                "ids": pa.array([part.tobytes() for part in np.split(ids, at[1:])] if len(starts) else [], pa.binary()),
            })

        needs = self.tiles.select("block", "places").groupBy("block").applyInArrow(wanted, "block long, start int, ids binary")
        self.needs = needs.persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        self.tiles.unpersist()
        self.needs.unpersist()

    def _met(self, parts: DataFrame, turn: np.ndarray, run, kinds):
        """``run(tiles, ids, matrix)`` for every block of rows, with its rows of the matrix of ``parts`` times ``turn``."""

        def send(needs: pa.Table, part: pa.Table) -> pa.Table:
            blocks, ids, sums = [], [], []
            if needs.num_rows and part.num_rows:
                own = _matrix(part["sums"][0], len(turn)) @ turn
                for block, want in zip(needs["block"].to_pylist(), needs["ids"]):
                    places = np.frombuffer(want.as_py(), np.int32)
                    blocks.append(block)
                    ids.append(places.tobytes())
                    sums.append(own[places % FEATURE_BLOCK].tobytes())
            return pa.table({"block": pa.array(blocks, pa.int64()), "ids": pa.array(ids, pa.binary()), "sums": pa.array(sums, pa.binary())})

        def meet(tiles: pa.Table, sent: pa.Table) -> pa.Table:
            ids = [np.frombuffer(x.as_py(), np.int32) for x in sent["ids"]]
            order = sorted(range(len(ids)), key=lambda k: ids[k][0])
            matrix = [np.frombuffer(sent["sums"][k].as_py()).reshape(-1, turn.shape[1]).T for k in order]
            matrix = np.concatenate(matrix, axis=1) if order else np.zeros((turn.shape[1], 0))
            ids = np.concatenate([ids[k] for k in order]) if order else np.zeros(0, np.int32)
            flat = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in tiles[name]])
            return run(tiles, flat("rows", np.int32), np.searchsorted(ids, flat("places", np.int32)), flat("values", float), ids, matrix)

        sent = self.needs.groupBy("start").cogroup(parts.groupBy("start")).applyInArrow(send, "block long, ids binary, sums binary")
        return self.tiles.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(meet, kinds)

    def gram_product(self, parts: DataFrame, turn: np.ndarray, size: int) -> tuple[DataFrame, str, np.ndarray]:
        """X'X times (``parts`` times ``turn``) by feature block as a table with its path, and the product of X (parts turn) with itself.

        A few columns at a time are sent to the rows and summed, and written, so that
        nothing depends on the shuffle files of those before and Spark's cleaner can delete them.
        """
        spark, width = parts.sparkSession, turn.shape[1]
        paths = []
        for first in range(0, width, SLICE):
            paths.append(scratch_path(spark, "columns"))
            sums = self._slice_product(parts, turn[:, first : first + SLICE], size)
            sums.withColumn("at", F.lit(first)).write.parquet(paths[-1])
            spark._jvm.System.gc()
        slices = spark.read.schema(f"{PARTS}, at int").parquet(*paths)

        def beside(table: pa.Table, part: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _parts([], [])
            order = np.argsort(table["at"].to_numpy())
            found = [_matrix(table["sums"][int(k)], min(SLICE, width - table["at"][int(k)].as_py())) for k in order]
            whole = np.concatenate(found, axis=1)
            return _parts([table["start"][0].as_py(), -1], [whole, (_matrix(part["sums"][0], len(turn)) @ turn).T @ whole])

        def inner(batches):
            total = np.zeros((width, width))
            for batch in batches:
                for part in batch["sums"]:
                    total += _matrix(part, width)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        path = scratch_path(spark, "round")
        slices.groupBy("start").cogroup(parts.filter("start >= 0").groupBy("start")).applyInArrow(beside, PARTS).write.parquet(path)
        for old in paths:
            delete_scratch(spark, old)
        product = spark.read.schema(PARTS).parquet(path)
        sums = product.filter("start < 0").select("sums").mapInArrow(inner, "sums binary").toLocalIterator()
        found = sum((np.frombuffer(bytes(r["sums"])).reshape(width, width) for r in sums), np.zeros((width, width)))
        return product.filter("start >= 0"), path, found

    def _slice_product(self, parts: DataFrame, turn: np.ndarray, size: int) -> DataFrame:
        """X'X times (``parts`` times ``turn``) by feature block, for few columns."""
        width = turn.shape[1]

        def turned(batches):
            for batch in batches:
                for start, part in zip(batch["start"].to_pylist(), batch["sums"]):
                    yield _parts([start], [_matrix(part, len(turn)) @ turn]).combine_chunks().to_batches()[0]

        def multiply(tiles, rows, places, values, ids, matrix):
            low = np.stack([np.bincount(rows, values * column[places]) for column in matrix]) if len(rows) else np.zeros((width, 1))
            sums = np.stack([np.bincount(places, values * own[rows], len(ids)) for own in low]).T
            starts, at = np.unique(ids // FEATURE_BLOCK, return_index=True)
            found = _parts(starts.tolist(), np.split(sums, at[1:]) if len(starts) else [])
            return found.append_column("ids", pa.array([part.tobytes() for part in np.split(ids, at[1:])] if len(starts) else [], pa.binary()))

        def add(table: pa.Table) -> pa.Table:
            start = table["start"][0].as_py()
            total = np.zeros((min(FEATURE_BLOCK, size - start * FEATURE_BLOCK), width))
            for ids, sums in zip(table["ids"], table["sums"]):
                total[np.frombuffer(ids.as_py(), np.int32) % FEATURE_BLOCK] += _matrix(sums, width)
            return _parts([start], [total])

        few = parts.mapInArrow(turned, PARTS)  # only these columns are shuffled
        return self._met(few, np.eye(width), multiply, f"{PARTS}, ids binary").groupBy("start").applyInArrow(add, PARTS)

    def project(self, parts: DataFrame, width: int, out: str) -> DataFrame:
        """The other columns of the rows, and their vectors times the matrix of ``parts``, as a list."""
        names = self.own

        def multiply(tiles, rows, places, values, ids, matrix):
            order = np.argsort(tiles["first"].to_numpy())
            own = pa.concat_arrays([tiles["own"][int(k)].values for k in order])
            low = np.stack([np.bincount(rows, values * column[places], len(own)) for column in matrix], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * width, pa.array(low.ravel()))
            return pa.table([*(own.field(k) for k in range(len(names))), lists], [*names, out])

        return self._met(parts, np.eye(width), multiply, T.StructType([*self.fields.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def _random_parts(spark: SparkSession, size: int, width: int, seed: int) -> DataFrame:
    """A random (features x width) matrix by feature block; a section of blocks continues one stream of numbers."""
    blocks = -(-size // FEATURE_BLOCK)

    def draw(batches):
        for batch in batches:
            for section in batch["id"].to_pylist():
                rng = np.random.default_rng([seed, section] if section else seed)
                for start in range(section * SECTION, min((section + 1) * SECTION, blocks)):
                    drawn = rng.standard_normal((min(FEATURE_BLOCK, size - start * FEATURE_BLOCK), width))
                    yield _parts([start], [drawn]).combine_chunks().to_batches()[0]

    sections = -(-blocks // SECTION)
    return spark.range(0, sections, 1, sections).mapInArrow(draw, PARTS).persist(StorageLevel.MEMORY_AND_DISK)


def _self_product(parts: DataFrame, width: int) -> np.ndarray:
    """P'P of a matrix P in feature blocks; every task sends (width x width) numbers."""

    def product(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for part in batch["sums"]:
                own = _matrix(part, width)
                total += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    found = parts.filter("start >= 0").select("sums").mapInArrow(product, "sums binary").toLocalIterator()
    return sum((np.frombuffer(bytes(r["sums"])).reshape(width, width) for r in found), np.zeros((width, width)))


def _orthonormal(gram: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Turn that makes the columns of P orthonormal, from P'P; ``turns`` bring them close to it, null ones go."""
    near = turns.T @ gram @ turns
    lengths = np.sqrt(np.maximum(np.diag(near), 0))
    held = np.flatnonzero(lengths > 1e-13 * max(lengths.max(), 1e-300))
    turns = turns[:, held] / lengths[held]
    values, sides = np.linalg.eigh(turns.T @ gram @ turns)
    kept = values > 1e-13 * values.max()
    return turns @ (sides[:, kept] / np.sqrt(values[kept]))


def _signs(parts: DataFrame, turn: np.ndarray) -> np.ndarray:
    """Sign of the greatest element by size of every column of P times ``turn``."""

    def greatest(batches):
        best = np.zeros(turn.shape[1])
        for batch in batches:
            for part in batch["sums"]:
                own = _matrix(part, len(turn)) @ turn
                top = own[np.abs(own).argmax(axis=0), range(own.shape[1])]
                best = np.where(np.abs(top) > np.abs(best), top, best)
        yield pa.RecordBatch.from_arrays([pa.array([best.tolist()])], ["best"])

    found = [r["best"] for r in parts.filter("start >= 0").select("sums").mapInArrow(greatest, "best array<double>").toLocalIterator()]
    found = np.array(found)
    return np.sign(found[np.abs(found).argmax(axis=0), range(turn.shape[1])])


class BlockProjection(TableModel):
    """A :class:`LinearProjection` whose matrix stays a table of feature blocks."""

    width = Param(Params._dummy(), "width", "columns of the matrix", TypeConverters.toInt)

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None, parts: DataFrame | None = None, width: int | None = None):
        super().__init__()
        self.parts = parts
        if inputCol:
            self._set(inputCol=inputCol, outputCol=outputCol, width=width)

    def _transform(self, df: DataFrame) -> DataFrame:
        name, out = self.getInputCol(), self.getOutputCol()
        kept = [n for n in df.columns if n != out]
        blocks = _RowBlocks(df.select(*[n for n in kept if n != name], F.col(name), F.col(name).alias("_copy")), "_copy")
        low = blocks.project(self.parts, self.getOrDefault("width"), "_low")
        return low.select(*kept, array_to_vector("_low").alias(out))

    def tables(self) -> dict[str, DataFrame]:
        return {"matrix": self.parts}

    def restore(self, read: Callable[[str], DataFrame]) -> None:
        self.parts = read("matrix")


def _block_projection(rows: DataFrame, size: int, k: int, width: int, name: str, out: str, seed: int) -> tuple[BlockProjection, list[float]]:
    """The rounds of :func:`svd_projection` on a matrix in feature blocks; the driver holds (k x k) numbers."""
    spark = rows.sparkSession
    blocks = _RowBlocks(rows.withColumn("none", F.lit(None).cast("int")), "v")
    parts, place = _random_parts(spark, size, width, seed), None
    turn, before = _orthonormal(_self_product(parts, width), np.eye(width)), None
    for left in reversed(range(ROUNDS)):
        product, path, inner = blocks.gram_product(parts, turn, size)
        rows.unpersist()  # the blocks have them
        gram = _self_product(product, turn.shape[1])
        values, turns = np.linalg.eigh((inner + inner.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        if before is not None and np.abs(values[:k] - before[: len(values[:k])]).max() <= TOLERANCE * max(values[0], 1e-300):
            break
        if left:
            parts.unpersist()
            delete_scratch(spark, place)
            before, parts, place, turn = values[:k], product, path, _orthonormal(gram, turns)
    order = np.flatnonzero(values[:k] > 1e-12 * max(float(values[0]), 1e-300))
    turn = (turn @ turns)[:, order]
    turn = turn * _signs(parts, turn)

    def finish(batches):
        for batch in batches:
            for start, part in zip(batch["start"].to_pylist(), batch["sums"]):
                yield _parts([start], [_matrix(part, len(turn)) @ turn]).combine_chunks().to_batches()[0]

    found = written(parts.filter("start >= 0").mapInArrow(finish, PARTS), "directions")
    parts.unpersist()
    for round_path in {place, path}:
        delete_scratch(spark, round_path)
    blocks.close()
    return BlockProjection(name, out, found, len(order)), [float(x) for x in np.sqrt(values[order])]


def svd_projection(
    df: DataFrame, vector_col: str, k: int, out: str, seed: int = 0
) -> tuple[LinearProjection | BlockProjection, list[float]]:
    """Truncated SVD directions of a vector column and its singular values.

    Block power iteration from random directions: each round multiplies by X'X in one
    pass over the rows and makes the columns orthonormal again, until the squared
    singular values stand still.  The driver holds (features x k) numbers, never
    features x features; beyond ``MATRIX_BYTES`` they stay in tables of feature blocks.
    """
    rows = df.select(F.unwrap_udt(vector_col).alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
    size = rows.agg(F.max(F.coalesce("v.size", F.size("v.values")))).first()[0] or 1
    width = min(k + OVERSAMPLE, size)
    if size * width * 8 > MATRIX_BYTES:
        try:
            return _block_projection(rows, size, k, width, vector_col, out, seed)
        finally:
            rows.unpersist()
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))
    before = np.full(width, np.inf)
    for _ in range(ROUNDS):
        product = _gram_product(rows, basis)
        inner = basis.T @ product
        values, turns = np.linalg.eigh((inner + inner.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        directions = basis @ turns
        if np.abs(values[:k] - before[:k]).max() <= TOLERANCE * max(values[0], 1e-300):
            break
        before = values
        basis, _ = np.linalg.qr(product)
    rows.unpersist()
    order = np.flatnonzero(values[:k] > 1e-12 * max(float(values[0]), 1e-300))
    directions = directions[:, order]
    # Singular vectors have no sign of their own; fix it so that reruns agree.
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), range(len(order))])
    return LinearProjection(vector_col, out, directions), [float(x) for x in np.sqrt(values[order])]


def pca(df: DataFrame, vector_col: str, k: int, out: str):
    """Fitted PCA model; ``explainedVariance`` holds the variance shares."""
    return PCA(inputCol=vector_col, outputCol=out, k=k).fit(df)


def embed_text(
    df: DataFrame, key_col: str, text_col: str, k: int = 64, vocab_size: int | None = None,
    encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
) -> DataFrame:
    """``(key, embedding)``: any encoder, by default latent semantic analysis.

    Re-aimed: pretrained sentence encoders plug in through ``encoder``, which is
    built once per Python worker stream and maps a list of texts to a matrix.
    """
    if encoder is not None:
        narrow = df.select(key_col, text_col)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = encoder()
            for batch in batches:
                matrix = np.asarray(encode(batch[text_col].tolist()))
                yield pd.DataFrame({key_col: batch[key_col], "embedding": list(matrix)})

        key_type = narrow.schema[key_col].dataType.simpleString()
        return narrow.mapInPandas(run, f"{key_col} {key_type}, embedding array<double>")
    views = written(text_views(df.select(key_col, text_col), text_col).select(key_col, "text_clean"), "views")
    weights = Pipeline(
        stages=tfidf_stages("text_clean", "_tfidf", min_df=2, vocab_size=vocab_size, sublinear=True)
    ).fit(views).transform(views).select(key_col, "_tfidf")
    projection, _ = svd_projection(weights, "_tfidf", k, "_lsa")
    return projection.transform(weights).select(key_col, vector_to_array("_lsa").alias("embedding"))


def stemmed(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, stem(F.col(col)))


def style_table(df: DataFrame, text_col: str) -> DataFrame:
    return with_features(df, text_col, style_features_16)
