"""Term counts inside the row, a batch of rows at a time.

A row's n-grams become numbers of the distinct terms of its batch, and equal ones are
counted there, so that no (row, term) pair is shuffled.  Only partial sums by term leave a
task for the vocabulary; weights are looked up and normalised next to the counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from pyspark.storagelevel import StorageLevel

from inkwell.functions.text import words
from inkwell.session import scratch_path, written

# Token pattern, a run of two or more word characters.
TOKEN = r"([\p{L}\p{N}_]{2,})"
#: Tokens, or n-grams cut from them, that are counted at once; a single longer text is counted alone.
BATCH_TOKENS = 1 << 18
#: N-grams of one length that a word gives to a character analyzer, about.
WORD_GRAMS = 6
#: A vocabulary of at most so many bytes of terms is sent to the tasks; a larger one is joined.
LOOKUP_BYTES = 32 << 20


@dataclass(frozen=True)
class Analyzer:
    """How a text becomes terms: runs of words, or character n-grams inside padded words."""

    kind: str = "word"
    n_min: int = 1
    n_max: int = 1
    stop: tuple[str, ...] = ()

    def tokens(self, text):
        """Column of the units that n-grams are cut from."""
        if self.kind == "char":
            return words(F.lower(text))
        found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)
        if not self.stop:
            return found
        return F.filter(found, lambda t: ~t.isin(*self.stop))

    @property
    def batch_tokens(self) -> int:
        """Tokens that give about ``BATCH_TOKENS`` n-grams."""
        return max(1, BATCH_TOKENS // ((self.n_max - self.n_min + 1) * (WORD_GRAMS if self.kind == "char" else 1)))

    def counted(self, lists: pa.ListArray) -> "Counts":
        """Counts of the terms of every row."""
        rows, units = _flat(lists)
        codes = units.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cut = self._word_grams if self.kind == "word" else self._char_grams
        return Counts.of(len(lists), *cut(rows, codes, units.dictionary))

    def _word_grams(self, rows, codes, names):
        """(rows, terms, times, names): an n-gram extends the one of length n - 1 at its place by one token."""
        found_rows, found, all_names, base = [], [], [], 0
        grams, gram_names, starts = codes, names, np.arange(len(codes))
        for n in range(1, self.n_max + 1):
            if n > 1:
                shorter = np.empty(len(codes), np.int64)
                shorter[starts] = grams
                starts = np.flatnonzero(rows[: max(len(codes) - n + 1, 0)] == rows[n - 1 :])
                pairs, grams = np.unique(shorter[starts] * len(names) + codes[starts + n - 1], return_inverse=True)
                heads, tails = (pa.array(part) for part in np.divmod(pairs, max(len(names), 1)))
                gram_names = pc.binary_join_element_wise(gram_names.take(heads), names.take(tails), " ")
            if n >= self.n_min:
                found_rows.append(rows[starts])
                found.append(grams + base)
                all_names.append(gram_names)
                base += len(gram_names)
        return np.concatenate(found_rows), np.concatenate(found), None, pa.concat_arrays(all_names)

    def _char_grams(self, rows, codes, names):
        """Every distinct word is cut once; a padded word shorter than n gives itself for the least n only."""
        once = Counts.of(int(rows[-1]) + 1 if len(rows) else 0, rows, codes, None, names)
        number: dict[str, int] = {}
        cut = []
        for word in names.to_pylist():
            padded = f" {word} "
            grams = [padded[i : i + self.n_min] for i in range(max(len(padded) - self.n_min + 1, 1))]
            for n in range(self.n_min + 1, self.n_max + 1):
                grams += [padded[i : i + n] for i in range(len(padded) - n + 1)]
            cut.append([number.setdefault(gram, len(number)) for gram in grams])
        lengths = np.array([len(own) for own in cut], np.int64)
        flat = np.array([gram for own in cut for gram in own], np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(lengths) else lengths
        times = lengths[once.terms]
        ends = np.cumsum(times)
        inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
        grams = flat[np.repeat(first[once.terms], times) + inner]
        return np.repeat(once.rows, times), grams, np.repeat(once.counts, times), pa.array(list(number), pa.string())


@dataclass(frozen=True)
class Counts:
    """Entries (row, term, count) of a batch in order of rows; terms are places in ``names``."""

    size: int
    rows: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    names: pa.Array

    @staticmethod
    def of(size: int, rows, terms, times, names) -> "Counts":
        width = max(len(names), 1)
        if times is None:
            pairs, counts = np.unique(rows * width + terms, return_counts=True)
        else:
            pairs, place = np.unique(rows * width + terms, return_inverse=True)
            counts = np.bincount(place, times, len(pairs)).astype(np.int64)
        return Counts(size, *np.divmod(pairs, width), counts, names)

    def lists(self, *columns: pa.Array) -> list[pa.ListArray]:
        """Columns of the entries as one list per row."""
        offsets = pa.array(np.searchsorted(self.rows, np.arange(self.size + 1)).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, column) for column in columns]


class Phrases:
    """Word n-grams as paths of word numbers: they are found in texts by numbers alone, without making their texts."""

    def __init__(self, terms: pa.Array):
        lists = pc.split_pattern(terms, " ")
        offsets, units = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        codes, lengths = units.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets)
        self.size, self.words, self.width = max(len(terms), 1), units.dictionary, max(len(units.dictionary), 1)
        #: For each length, the sorted keys (path of the words before, last word), and the term that ends there or -1.
        self.keys, self.ends = [], []
        path, alive = np.zeros(len(lengths), np.int64), np.arange(len(lengths))
        for n in range(1, int(lengths.max(initial=0)) + 1):
            alive = alive[lengths[alive] >= n]
            keys, path[alive] = np.unique(path[alive] * self.width + codes[offsets[alive] + n - 1], return_inverse=True)
            last = alive[lengths[alive] == n]
            ends = np.full(len(keys), -1, np.int64)
            ends[path[last]] = last
            self.keys.append(keys)
            self.ends.append(ends)

    def walk(self, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length, (row of every token, places of tokens where a path starts, paths)."""
        rows, units = _flat(lists)
        known = pc.index_in(units.dictionary, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        words = known[units.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)
        starts = np.flatnonzero(words >= 0)
        paths = np.zeros(len(starts), np.int64)
        for n, keys in enumerate(self.keys):
            inside = starts + n < len(rows)
            starts, paths = starts[inside], paths[inside]
            going = (rows[starts] == rows[starts + n]) & (words[starts + n] >= 0)
            starts, paths = starts[going], paths[going]
            wanted = paths * self.width + words[starts + n]
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            found = keys[at] == wanted
            starts, paths = starts[found], at[found]
            yield rows, starts, paths

    def counted(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, terms, counts) of the terms in every row."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for ends, (rows, starts, paths) in zip(self.ends, self.walk(lists)):
            terms = ends[paths]
            listed = terms >= 0
            found.append((rows[starts[listed]], terms[listed]))
        rows, terms = (np.concatenate(part) for part in zip(*found))
        pairs, counts = np.unique(rows * self.size + terms, return_counts=True)
        return *np.divmod(pairs, self.size), counts


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(row, unit) of all elements."""
    sizes = np.diff(lists.offsets.to_numpy()) * (lists.is_valid().to_numpy(zero_copy_only=False))
    return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().dictionary_encode()


def portions(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` list elements."""
    for batch in batches:
        offsets = batch[name].offsets.to_numpy()
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, min(end, batch.num_rows) - at)
            at = end


TOKENS = "_tokens"


def term_stats(texts: DataFrame, text_col: str, analyzer: Analyzer) -> DataFrame:
    """``(term, df, total)``; the empty term counts the texts.  Partial sums of whole batches are all that is shuffled."""
    return _summed(texts, text_col, analyzer, analyzer.counted)


def _summed(texts: DataFrame, text_col: str, analyzer: Analyzer, count: Callable[[pa.ListArray], Counts]) -> DataFrame:
    def partial(batches):
        for batch in portions(batches, TOKENS, analyzer.batch_tokens):
            found = count(batch[TOKENS])
            n = len(found.names)
            terms = pa.concat_arrays([found.names.cast(pa.string()), pa.array([""])])
            df = np.append(np.bincount(found.terms, minlength=n), batch.num_rows)
            total = np.append(np.bincount(found.terms, found.counts, n).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays([terms, pa.array(df), pa.array(total)], ["term", "df", "total"])

    tokens = texts.select(analyzer.tokens(F.col(text_col)).alias(TOKENS))
    sums = tokens.mapInArrow(partial, "term string, df long, total long")
    return sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def longer_stats(texts: DataFrame, text_col: str, analyzer: Analyzer, shorter: pa.Array) -> DataFrame:
    """:func:`term_stats` of the word n-grams whose first and last n - 1 words are both among ``shorter``, all of n - 1 words."""
    shared = texts.sparkSession.sparkContext.broadcast(shorter)
    made: list[Phrases] = []

    def count(lists: pa.ListArray) -> Counts:
        if not made:
            made.append(Phrases(shared.value))
        for rows, starts, paths in made[0].walk(lists):
            pass
        ends, width = made[0].ends[-1], len(shared.value)
        at = np.full(len(rows) + 1, -1, np.int64)
        at[starts] = ends[paths]
        n = len(made[0].ends) + 1
        starts = starts[(at[starts] >= 0) & (at[starts + 1] >= 0)]  # the second one ends n - 1 tokens on
        starts = starts[rows[starts] == rows[starts + n - 1]]
        pairs, terms = np.unique(at[starts] * width + at[starts + 1], return_inverse=True)
        heads, tails = (shared.value.take(pa.array(part)) for part in np.divmod(pairs, width))
        tails = pc.replace_substring_regex(tails, "^.* ", "")
        return Counts.of(len(lists), rows[starts], terms, None, pc.binary_join_element_wise(heads, tails, " "))

    return _summed(texts, text_col, analyzer, count)


def frequent_stats(texts: DataFrame, text_col: str, analyzer: Analyzer, min_df: float, max_df: float, size: int) -> DataFrame | None:
    """The rows of :func:`term_stats` that can be among the ``size`` most frequent terms, and the number of texts.

    No n-gram is found oftener, nor in more texts, than a shorter one inside it.  So each
    length is counted only where both parts of n - 1 words reach the total of the
    ``size``-th term so far, and the sums of rare n-grams are never made.  None, if more
    terms reach it than may be sent to the tasks.
    """
    spark, schema = texts.sparkSession, pa.schema([("term", pa.string()), ("df", pa.int64()), ("total", pa.int64())])
    single = replace(analyzer, n_max=1)
    words = term_stats(texts, text_col, single).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = words.filter("term = ''").agg(F.max("df")).first()[0] or 0
        listed = words.filter((F.col("term") != "") & (F.col("df") >= min_df) & (F.col("df") <= max_df * n))
        least = listed.orderBy(F.col("total").desc()).limit(size).agg(F.count("*").alias("n"), F.min("total").alias("total")).first()
        bound = least["total"] if least["n"] == size else 0
        found, stats = [], words
        for length in range(1, analyzer.n_max + 1):
            if length > 1:
                shorter = pa.concat_arrays(found[-1]["term"].chunks or [pa.array([], pa.string())])
                if not len(shorter):
                    break
                stats = longer_stats(texts, text_col, single, shorter).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                reach = stats.filter((F.col("term") != "") & (F.col("df") >= min_df) & (F.col("total") >= bound))
                if (reach.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0) > LOOKUP_BYTES:
                    return None
                found.append(reach.select("term", "df", "total").toArrow().cast(schema))
            finally:
                if length > 1:
                    stats.unpersist()
            whole = pa.concat_tables(found)
            totals = whole["total"].to_numpy()[whole["df"].to_numpy() <= max_df * n]
            if len(totals) >= size:
                bound = max(bound, int(np.partition(totals, -size)[-size]))
    finally:
        words.unpersist()
    texts_row = pa.table([pa.array([""]), pa.array([n], pa.int64()), pa.array([0], pa.int64())], schema=schema)
    return spark.createDataFrame(pa.concat_tables([*found, texts_row]).combine_chunks())


def numbered(terms: DataFrame, key: str, out: str) -> DataFrame:
    """Rank of every row by a unique key, from 0, as a written table.

    Range partitions are sorted apart; a row's number is its place in its partition
    plus the sizes of the partitions before, of which there are few.
    """
    path = scratch_path(terms.sparkSession, "numbered")
    ordered = terms.repartitionByRange(key).sortWithinPartitions(key)
    # the low 33 bits are the place in a partition, the high ones the partition
    ordered.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    placed = terms.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    earlier = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(earlier), "_part").select(*terms.columns, (F.col("_before") + place).cast("int").alias(out))


class Vocabulary:
    """Terms with number and inverse document frequency, as a table that is never collected unless it is small.

    ``idf = ln((1 + n) / (1 + df)) + 1``; pruned by document frequency, and by corpus
    frequency to ``size`` terms if that is given.  Numbers are ranks by term.
    """

    def __init__(self, terms: DataFrame, numbered_terms: bool = False):
        """``terms`` has term and idf, with ``numbered_terms`` also id."""
        self._terms, self._numbered = terms, numbered_terms
        row = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()
        self.size, self.bytes = int(row[0]), int(row[1])
        self._held = self._shared = None

    @staticmethod
    def fit(texts: DataFrame, text_col: str, analyzer: Analyzer, min_df: float = 1, max_df: float = 1.0, size: int | None = None) -> "Vocabulary":
        if size and analyzer.kind == "word" and analyzer.n_min == 1 < analyzer.n_max:
            few = frequent_stats(texts, text_col, analyzer, min_df, max_df, size)
            if few is not None:
                return Vocabulary.of_stats(few, min_df, max_df, size)
        stats = term_stats(texts, text_col, analyzer)
        stats = stats.filter((F.col("df") >= min_df) | (F.col("term") == "")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return Vocabulary.of_stats(stats, min_df, max_df, size)
        finally:
            stats.unpersist()

    @staticmethod
    def of_stats(stats: DataFrame, min_df: float = 1, max_df: float = 1.0, size: int | None = None) -> "Vocabulary":
        """``stats`` as :func:`term_stats` gives them, read three times here and not again."""
        n = stats.filter("term = ''").agg(F.max("df")).first()[0] or 0
        kept = stats.filter((F.col("term") != "") & (F.col("df") >= min_df) & (F.col("df") <= max_df * n))
        if size:
            kept = kept.orderBy(F.col("total").desc(), F.col("term").asc()).limit(size)
        found = Vocabulary(kept.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")))
        found.held() if found.small else found.table
        return found

    @property
    def small(self) -> bool:
        return self.bytes <= LOOKUP_BYTES

    def held(self) -> pa.Table:
        """Terms in order of their numbers, for a vocabulary whose size was checked."""
        if not self.small:
            raise ValueError(f"a vocabulary of {self.bytes} bytes is not collected")
        if self._held is None:
            self._held = self._terms.select("term", "idf").toArrow().sort_by("term")
        return self._held

    @property
    def table(self) -> DataFrame:
        """``(term, id, idf)``."""
        if not self._numbered:
            spark = self._terms.sparkSession
            if self.small:
                ids = pa.array(np.arange(self.size, dtype=np.int32))
                self._terms = spark.createDataFrame(self.held().append_column("id", ids)).select("term", "id", "idf")
            else:
                self._terms = written(numbered(self._terms, "term", "id").select("term", "id", "idf"), "vocabulary")
            self._numbered = True
        return self._terms

    def shared(self):
        """Broadcast (terms, idf) in order of numbers."""
        if self._shared is None:
            held = self.held()
            terms = pa.concat_arrays(held["term"].cast(pa.string()).chunks or [pa.array([], pa.string())])
            self._shared = self._terms.sparkSession.sparkContext.broadcast((terms, held["idf"].to_numpy()))
        return self._shared


def _weights(counts: np.ndarray, idf: np.ndarray, sublinear: bool) -> np.ndarray:
    return (np.log(counts) + 1 if sublinear else counts.astype(float)) * idf


def _normal(rows: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Weights divided by the length of their row's vector."""
    norms = np.sqrt(np.bincount(rows, weights * weights, size))
    return weights / norms[rows]


def weighted(
    texts: DataFrame, text_col: str, analyzer: Analyzer, vocabulary: Vocabulary, sublinear: bool, vector: str | None = None, plain: bool = False
) -> DataFrame:
    """The rows with a list ``_terms`` of (id, term, weight), L2-normalised, in order of ids.

    With ``vector``, a sparse vector column of that name instead; with ``plain``, counts instead of weights.  With a small
    vocabulary everything happens in the row.  Otherwise the distinct terms of a batch
    leave it, each with the rows that hold it, to meet the vocabulary by a join on the
    term, and come back by the number of the batch; the rows' other columns travel once,
    on an entry of their own.
    """
    names = [n for n in texts.columns if n != vector]
    texts = texts.select(*names)
    tokens = texts.withColumn(TOKENS, analyzer.tokens(F.col(text_col)))
    if not vocabulary.small:
        return _by_join(tokens, texts, analyzer, vocabulary, sublinear, vector, plain)
    shared, size = vocabulary.shared(), vocabulary.size

    def look_up(batches):
        terms, idf = shared.value
        phrases = Phrases(terms) if analyzer.kind == "word" else None
        most = max(analyzer.batch_tokens, min(len(terms), 4 * analyzer.batch_tokens))  # a portion hashes all terms
        for batch in portions(batches, TOKENS, most):
            if phrases is not None:
                rows, ids, counts = phrases.counted(batch[TOKENS])
            else:
                found = analyzer.counted(batch[TOKENS])
                ids = pc.index_in(found.names, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)[found.terms]
                listed = np.flatnonzero(ids >= 0)
                listed = listed[np.lexsort((ids[listed], found.rows[listed]))]
                rows, ids, counts = found.rows[listed], ids[listed], found.counts[listed]
            weights = counts.astype(float) if plain else _normal(rows, _weights(counts, idf[ids], sublinear), batch.num_rows)
            column = _listed(batch.num_rows, rows, ids, weights, size if vector else None, lambda: terms.take(pa.array(ids)))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), column], [*names, vector or "_terms"])

    return tokens.mapInArrow(look_up, _with_listed(texts, vector))


LISTED = "array<struct<id: int, term: string, weight: double>>"


def _with_listed(texts: DataFrame, vector: str | None) -> T.StructType:
    from pyspark.ml.linalg import VectorUDT  # brings pandas along, which the tasks' workers do without

    own = T.StructField(vector, VectorUDT()) if vector else T.StructField("_terms", T._parse_datatype_string(LISTED))
    return T.StructType([*texts.schema.fields, own])


def _listed(size: int, rows: np.ndarray, ids: np.ndarray, weights: np.ndarray, width: int | None, terms) -> pa.Array:
    """Entries in order of (row, id) as sparse vectors of ``width`` elements as Spark stores them, or as lists with their terms."""
    numbers, values = pa.array(ids.astype(np.int32)), pa.array(weights)
    if width is None:
        return Counts(size, rows, ids, ids, numbers).lists(pa.StructArray.from_arrays([numbers, terms(), values], ["id", "term", "weight"]))[0]
    offsets = pa.array(np.searchsorted(rows, np.arange(size + 1)).astype(np.int32))
    filled = [pa.ListArray.from_arrays(offsets, x, type=pa.list_(pa.field("element", x.type, False))) for x in (numbers, values)]
    columns = [pa.array(np.zeros(size, np.int8)), pa.array(np.full(size, width, np.int32)), *filled]
    kinds = [pa.field(n, c.type, n != "type") for n, c in zip(("type", "size", "indices", "values"), columns)]
    return pa.StructArray.from_arrays(columns, fields=kinds)


#: Bytes of vocabulary that a bucket of terms holds, about, and buckets at least.
BUCKET_BYTES, BUCKETS = 4 << 20, 64
_FACTORS = np.random.default_rng(1).integers(1, 1 << 63, 64, dtype=np.uint64)


def _buckets(terms: pa.Array, n: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its terms) by a hash of the bytes."""
    offsets = terms.offsets.to_numpy() if hasattr(terms, "offsets") else np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1]
    raw = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(terms) else np.zeros(0, np.uint8)
    lengths, sums = np.diff(offsets), np.zeros(len(terms), np.uint64)
    filled = np.flatnonzero(lengths)
    if len(filled):
        starts = (offsets[:-1] - offsets[0])[filled]
        inside = np.arange(len(raw)) - np.repeat(starts, lengths[filled])
        sums[filled] = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * _FACTORS[inside % len(_FACTORS)], starts)
    bucket = ((sums >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return [(int(bucket[part[0]]), part) for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(part)]


def _packed(**columns) -> bytes:
    """Columns as one compressed value: a row of a shuffle takes many times the bytes of a term."""
    batch, sink = pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns.values()], list(columns)), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _by_join(
    tokens: DataFrame, texts: DataFrame, analyzer: Analyzer, vocabulary: Vocabulary, sublinear: bool, vector: str | None, plain: bool
) -> DataFrame:
    names, size = texts.columns, vocabulary.size
    buckets = max(BUCKETS, -(-vocabulary.bytes // BUCKET_BYTES))

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "_batch", "data", "own"])

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                term = batch["term"].cast(pa.string())
                yield listed([
                    (bucket, 0, None, _packed(term=term.take(pa.array(at)), id=batch["id"].take(pa.array(at)), idf=batch["idf"].take(pa.array(at))), None)
                    for bucket, at in _buckets(term, buckets)
                ])

    def count(batches):
        task, place = TaskContext.get().partitionId(), 0
        for batch in portions(batches, TOKENS, analyzer.batch_tokens):
            found, number = analyzer.counted(batch[TOKENS]), (task << 32) + place
            terms = found.names.cast(pa.string())
            counts = _packed(**{n: x.astype(np.int32) for n, x in (("rows", found.rows), ("terms", found.terms), ("counts", found.counts))})
            rows = [(b, 1, number, _packed(term=terms.take(pa.array(at)), place=at.astype(np.int32)), None) for b, at in _buckets(terms, buckets)]
            yield listed([(number % buckets, 1, number, counts, _packed(**{n: batch[n] for n in names})), *rows])
            place += 1

    kinds = "bucket int, kind int, _batch long, data binary, own binary"
    entries = vocabulary.table.mapInArrow(pack, kinds).union(tokens.mapInArrow(count, kinds))
    # in a bucket the vocabulary comes first
    entries = entries.repartition("bucket").sortWithinPartitions("bucket", "kind")

    def look_up(batches):
        bucket, known, vocab, waiting, held = None, [], None, [], 0

        def found():
            nonlocal vocab, waiting, held
            if not waiting:
                return None
            if vocab is None:
                vocab = pa.Table.from_batches(known).combine_chunks() if known else None
            if vocab is None:
                waiting, held = [], 0
                return None
            terms = pa.concat_arrays([part["term"] for _, part in waiting])
            at = pc.index_in(terms, value_set=vocab["term"].combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False)
            out, first = [], 0
            for number, part in waiting:
                own = at[first : first + part.num_rows]
                first += part.num_rows
                here = np.flatnonzero(own >= 0)
                columns = {n: vocab[n].combine_chunks().take(pa.array(own[here])) for n in ("id", "idf")}
                if not vector:
                    columns["term"] = part["term"].take(pa.array(here))
                out.append((0, 1, number, _packed(place=part["place"].take(pa.array(here)), **columns), None))
            waiting, held = [], 0
            return listed(out) if out else None

        for batch in batches:
            for k in range(batch.num_rows):
                to, kind, data = batch["bucket"][k].as_py(), batch["kind"][k].as_py(), batch["data"][k].as_py()
                if to != bucket:
                    done = found()
                    if done is not None:
                        yield done
                    bucket, known, vocab = to, [], None
                if kind == 0:
                    known.append(_unpacked(data))
                elif batch["own"][k].is_valid:
                    yield batch.slice(k, 1)
                else:
                    waiting.append((batch["_batch"][k].as_py(), _unpacked(data)))
                    held += waiting[-1][1].num_rows
                    # every look-up hashes the vocabulary of the bucket
                    if held >= max(BATCH_TOKENS, sum(part.num_rows for part in known)):
                        done = found()
                        if done is not None:
                            yield done
        done = found()
        if done is not None:
            yield done

    def weigh(table: pa.Table) -> pa.Table:
        owns = pc.is_valid(table["own"])
        own = table.filter(owns)
        held = _unpacked(own["own"][0].as_py())
        rows, terms, counts = (x.to_numpy() for x in _unpacked(own["data"][0].as_py()).columns)
        met = [_unpacked(data.as_py()) for data in table.filter(pc.invert(owns))["data"]]
        n = int(terms.max(initial=-1)) + 1
        number, weight, entry = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n, np.int64)
        first = 0
        for part in met:
            at = part["place"].to_numpy()
            number[at], weight[at], entry[at] = part["id"].to_numpy(), part["idf"].to_numpy(), first + np.arange(len(at))
            first += len(at)
        ids = number[terms]
        order = np.flatnonzero(ids >= 0)
        order = order[np.lexsort((ids[order], rows[order]))]
        rows, ids, counts, terms = (x[order] for x in (rows, ids, counts, terms))
        weights = counts.astype(float) if plain else _normal(rows, _weights(counts, weight[terms], sublinear), held.num_rows)
        strings = lambda: pa.concat_arrays([part["term"] for part in met] or [pa.array([], pa.string())]).take(pa.array(entry[terms]))
        column = _listed(held.num_rows, rows, ids, weights, size if vector else None, strings)
        return pa.table([*held.columns, column], [*names, vector or "_terms"])

    met = entries.mapInArrow(look_up, kinds).select("_batch", "data", "own")
    return met.groupBy("_batch").applyInArrow(weigh, _with_listed(texts, vector))
