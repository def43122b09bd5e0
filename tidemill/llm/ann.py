"""Approximate nearest neighbours by multi-index hashing.

Codes are signs of learned rotations (iterative quantisation of the principal axes, from several starts, fitted on a bounded
sample). A code is cut into substrings of about log2(rows) bits, and each is indexed: the index is one table of (substring and its
value, row, code). A query probes each substring's values within a few flipped bits, so by the pigeonhole principle every code
within substrings * (flips + 1) - 1 bits is met, and most of those some way beyond. What is met is joined by key, held to a
Hamming radius on the code, and reranked by the exact cosine of the original vectors.

How many substrings, how long, how many flips and which radius is measured: a bounded set of queries is searched by brute
force over all rows, and the cheapest setting that finds TARGET of their true neighbours is taken. Equal vectors are one row of the
index, so copies meet no one twice. Queries that find too few neighbours are searched in blocks by brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that the rotations are fitted on and queries whose true neighbours set the parameters, at most about.
SAMPLE, CALIBRATE = 2048, 256
#: Share of true neighbours that probing has to meet, and of these the share that the radius has to keep.
TARGET, WITHIN = 0.96, 0.975
#: Bits that substrings are taken from, at most; bits that the Hamming check compares (as longs).
POOL, CHECK = 2560, 512
NEAREST = 5
#: Bits of a substring, at least; a query's probes of a substring have to leave out all but one in so many of its values, so that the
#: index is one at every size.
SHORTEST, SELECTIVE = 8, 16
#: Probes of one substring, at most; what a shuffled row costs beside a pair of rows that meet.
PROBES, SHUFFLED = 600, 6
INDEX_BLOCK, QUERY_BLOCK = 16384, 2048
ITERATIONS = 8


@dataclass
class Index:
    """How codes are made and probed."""

    mean: np.ndarray
    axes: np.ndarray  # dimensions x bits of the pool
    bits: int = 0  # of a substring
    substrings: int = 0
    flips: int = 0
    radius: int = 0

    def signs(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return (unit - self.mean) @ self.axes > 0

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """A long for each vector and substring: the substring's number above its value."""
        parts = signs[:, : self.substrings * self.bits].reshape(len(signs), self.substrings, self.bits)
        return (parts @ (1 << np.arange(self.bits))) | (np.arange(self.substrings) << 32)

    def code(self, signs: np.ndarray) -> np.ndarray:
        """The first CHECK bits as longs."""
        held = np.zeros((len(signs), CHECK), bool)
        held[:, : min(CHECK, signs.shape[1])] = signs[:, :CHECK]
        return np.packbits(held, axis=1, bitorder="little").view("<i8")

    def flipped(self) -> list[int]:
        """What a value is combined with (exclusive or) to probe around it."""
        return [sum(1 << b for b in some) for k in range(self.flips + 1) for some in combinations(range(self.bits), k)]


def fit_rotations(sample: np.ndarray, pool: int = POOL) -> Index:
    """Rotations of the principal axes towards the corners of a cube, each from a start of its own."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = x.mean(axis=0)
    centred, d = x - mean, x.shape[1]
    _, vectors = np.linalg.eigh(centred.T @ centred)
    z, rng, found = centred @ vectors, np.random.default_rng(7), []
    for _ in range(-(-pool // d)):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ITERATIONS):
            u, _, vt = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ vt).T
        found.append((vectors @ r)[:, rng.permutation(d)])
    return Index(mean, np.hstack(found)[:, :pool])


def calibrate(index: Index, queries: np.ndarray, neighbours: np.ndarray, rows: int, asked: int) -> Index:
    """Sets the parameters by pairs of queries and their true neighbours (a row each), for so many rows and queries."""
    a, b = index.signs(queries), index.signs(neighbours)
    index.radius = int(np.quantile((a != b)[:, :CHECK].sum(axis=1), WITHIN, method="higher"))
    best, pool, log = None, a.shape[1], max(3, int(np.log2(max(rows, 2))))
    for bits in sorted({min(30, pool, max(SHORTEST, log - k)) for k in (6, 5, 4, 3, 2, 1, 0)}):
        parts = pool // bits
        apart = (a != b)[:, : parts * bits].reshape(len(a), parts, bits).sum(axis=2)
        for flips in range(bits + 1):
            probes = sum(comb(bits, k) for k in range(flips + 1))
            if probes > PROBES or probes * SELECTIVE > 2**bits:
                break
            met = np.maximum.accumulate(apart <= flips, axis=1).mean(axis=0)
            enough = np.flatnonzero(met >= TARGET)
            n = int(enough[0]) + 1 if len(enough) else parts
            cost = n * (SHUFFLED * (rows + asked * probes) + asked * rows * probes / 2.0**bits)
            order = (not len(enough), -round(float(met[n - 1]), 2) if not len(enough) else 0, cost)
            if best is None or order < best[0]:
                best = order, bits, n, flips
    _, index.bits, index.substrings, index.flips = best
    return index


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, width = column.flatten().to_numpy(zero_copy_only=False), width or int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _codes(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            signs = index.signs(_matrix(part.column(1), index.axes.shape[0]))
            keys, code = index.keys(signs), index.code(signs)
            places = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
            lengths = pa.array(np.diff(part.column(1).offsets.to_numpy()).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), lengths, pa.ListArray.from_arrays(places, pa.array(keys.reshape(-1))), *map(pa.array, code.T)], names=["cls", "len", "keys", *_CODE])


_CODE = [f"c{i}" for i in range(CHECK // 64)]


def coded(vectors: DataFrame, index) -> DataFrame:
    """cls, len, keys and code of vectors (cls, vector)."""
    code = ", ".join(f"{c} long" for c in _CODE)
    return vectors.select("cls", "vector").mapInArrow(lambda it: _codes(common.trimmed(it), index.value), f"cls long, len int, keys array<long>, {code}")


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, always summed in the same order."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            score = _cosines(_matrix(part.column(2)), _matrix(part.column(3)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], names=["q", "cls", "score"])


def _meet(rows: pa.Table, queries: pa.Table, nearest: int) -> pa.Table:
    """The best classes of a block for each query of its length, all of those that tie; brute force."""
    found: list[tuple[np.ndarray, ...]] = []
    if len(rows) and len(queries):
        held, asked = rows["vector"].combine_chunks(), queries["vector"].combine_chunks()
        sizes, wanted = np.diff(held.offsets.to_numpy()), np.diff(asked.offsets.to_numpy())
        for d in set(wanted.tolist()) & set(sizes.tolist()):
            mine, theirs = np.flatnonzero(wanted == d), np.flatnonzero(sizes == d)
            x, y = _matrix(asked.take(pa.array(mine)), d), _matrix(held.take(pa.array(theirs)), d)
            rough = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
            k = min(nearest, len(theirs))
            least = np.partition(rough, len(theirs) - k, axis=1)[:, len(theirs) - k]
            i, j = np.nonzero(rough >= least[:, None] - 1e-9)
            found.append((queries["q"].to_numpy()[mine[i]], rows["cls"].to_numpy()[theirs[j]], _cosines(x[i], y[j])))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    q, cls, score = (np.concatenate(c) for c in zip(none, *found))
    return pa.table({"q": q, "cls": cls, "score": score})


def by_force(vectors: DataFrame, queries: DataFrame, nearest: int) -> DataFrame:
    """q, cls and score: the best of ``vectors`` (cls, vector) for each of ``queries`` (cls, vector), block against block."""
    index_blocks, query_blocks = max(1, -(-vectors.count() // INDEX_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "cls"), F.lit(n)).cast("int")
    left = vectors.select("cls", "vector", dealt("index", index_blocks).alias("ib"), every(query_blocks).alias("qb"))
    right = queries.select(F.col("cls").alias("q"), "vector", dealt("query", query_blocks).alias("qb"), every(index_blocks).alias("ib"))
    return left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb")).applyInArrow(lambda a, b: _meet(a, b, nearest), "q long, cls long, score double")


def _best(scored: DataFrame, nearest: int) -> DataFrame:
    """Of each query's scored classes those that rank among the nearest; ties stay."""
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    return scored.withColumn("__r", F.rank().over(order)).where(F.col("__r") <= nearest).drop("__r")


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row (a number of its own), vec_id, vector (doubles) and key (equal for equal vectors) of the rows that take part.

    With a null, empty or zero vector, or one with null or non-finite components, a row takes no part. Rows without an id,
    and rows that share one, are rows like any other. Columns besides the two named are ignored.
    """
    rows = common.pick(df, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    key = F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit("b"), "vector").alias("b"))  # 128 bits
    return common.written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", key.alias("key")), "vectors")


def fit(classes: DataFrame, asked: DataFrame, nearest: int = NEAREST, sample: int = SAMPLE) -> Index:
    """Rotations by a sample of ``classes``, parameters by true neighbours among all of them."""
    total, queries = classes.count(), asked.count()

    def drawn(df: DataFrame, n: int, of: int) -> DataFrame:
        draw = F.pmod(F.xxhash64(F.lit("draw"), "cls"), F.lit(1 << 30))
        return df.where(draw < int((1 << 30) * min(1.0, 2 * n / max(1, of)))).orderBy(draw, "cls").limit(n)

    got = drawn(classes, sample, total).collect() or classes.limit(1).collect()
    d = classes.agg(F.max(F.size("vector"))).first()[0]
    index = fit_rotations(_matrix(pa.array([r["vector"] for r in got], pa.list_(pa.float64())), d))
    some = common.written(drawn(asked, CALIBRATE, queries), "calibrate")
    near = _best(by_force(classes, some, nearest + 1).where("q <> cls"), nearest)
    pairs = near.join(classes.select("cls", F.col("vector").alias("b")), "cls").join(some.select(F.col("cls").alias("q"), F.col("vector").alias("a")), "q")
    pairs = pairs.orderBy("q", F.desc("score"), "cls").limit(4 * CALIBRATE * nearest).select("a", "b").collect()
    if not pairs:  # one vector, or none of a query's length: any setting does
        index.bits, index.substrings, index.flips, index.radius = 1, 1, 0, CHECK
        return index
    a, b = (_matrix(pa.array([r[c] for r in pairs], pa.list_(pa.float64())), d) for c in "ab")
    return calibrate(index, a, b, total, queries)


def meetings(classes: DataFrame, asked: DataFrame, index: Index) -> DataFrame:
    """Pairs q, cls of which a substring is within the flips and the code within the radius, each once."""
    model = classes.sparkSession.sparkContext.broadcast(index)  # dimensions x POOL numbers
    flips = F.array(*[F.lit(f).cast("long") for f in index.flipped()])
    held = coded(classes, model).select("cls", "len", *_CODE, F.explode("keys").alias("key"))
    probes = coded(asked, model).select(F.col("cls").alias("q"), F.col("len").alias("qlen"), *[F.col(c).alias(f"q{c}") for c in _CODE], F.explode("keys").alias("value"))
    probes = probes.select("*", F.explode(F.transform(flips, lambda f: F.col("value").bitwiseXOR(f))).alias("key")).drop("value")
    apart = F.lit(0)
    for c in _CODE:
        apart = apart + F.bit_count(F.col(c).bitwiseXOR(F.col(f"q{c}")))
    # never broadcast: rows grow many times between the files Spark sizes a side by and the join
    met = held.hint("merge").join(probes.hint("merge"), "key").where((F.col("len") == F.col("qlen")) & (apart <= index.radius) & (F.col("q") != F.col("cls")))
    return met.select("q", "cls").distinct()


def search(rows: DataFrame, queries: DataFrame, nearest: int = NEAREST, sample: int = SAMPLE, index: Index | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for each of ``queries`` against all other ``rows`` (queries: some of the rows of ``usable``).

    Vectors are compared with those of their own length. All candidates, if there are fewer than ``nearest``; ties go to the
    smaller vec_id, null last. Each row that shares an id is a query, and a candidate, of its own. No rows: no result.
    """
    spark = rows.sparkSession
    common.ship(spark)
    copies = Window.partitionBy("key").orderBy(F.asc_nulls_last("vec_id"), "row")  # Spark limits groups before the shuffle
    firsts = rows.withColumn("k", F.row_number().over(copies)).where(F.col("k") <= nearest + 1)
    firsts = common.written(firsts.withColumn("cls", F.first("row").over(copies)), "firsts")
    classes = firsts.where("k = 1").select("cls", "vector")
    if not classes.limit(1).count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sets = queries.groupBy("key").agg(F.count("*").alias("n"))
    asked = common.written(sets.join(firsts.where("k = 1").select("key", "cls", "vector"), "key"), "asked")
    index = index or fit(classes, asked, nearest, sample)
    pairs = meetings(classes, asked, index).union(asked.select(F.col("cls").alias("q"), "cls"))  # its own copies too
    wide = asked.select(F.col("cls").alias("q"), F.col("vector").alias("a"))
    met = pairs.join(classes, "cls").join(wide, "q").select("q", "cls", "a", "vector")
    scored = common.written(_best(met.mapInArrow(lambda it: _rerank(common.trimmed(it)), "q long, cls long, score double"), nearest + 1), "scored")
    found = common.written(_answers(scored, firsts, nearest), "found")
    there = rows.groupBy(F.size("vector").alias("len")).agg(F.count("*").alias("there"))  # a row per length
    wanted = asked.withColumn("len", F.size("vector")).join(there, "len").select("cls", "vector", F.least("there", F.lit(nearest + 1)).alias("wanted"))
    short = common.written(wanted.join(found, wanted.cls == found.q, "left").where(F.coalesce(F.size("best"), F.lit(0)) < F.col("wanted")).select("cls", "vector"), "short")
    if short.limit(1).count():
        forced = _answers(_best(by_force(classes, short, nearest + 1), nearest + 1), firsts, nearest)
        found = common.written(found.join(short.select(F.col("cls").alias("q")), "q", "left_anti").unionByName(forced), "found")
    answers = common.written(asked.join(found, asked.cls == found.q).select("key", "n", "best"), "answers")
    each = common.salted_join(queries.select("row", "vec_id", "key"), answers, "key", queries.count(), F.xxhash64("row"))
    others = F.slice(F.filter("best", lambda b: b["row"] != F.col("row")), 1, nearest)
    each = each.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "b"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _answers(scored: DataFrame, firsts: DataFrame, nearest: int) -> DataFrame:
    """q and best: its nearest + 1 rows, itself maybe among them, as a sorted array."""
    rows = scored.join(firsts.select("cls", "vec_id", "row"), "cls")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    top = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= nearest + 1)
    return top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "row", "score"))).alias("best"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every row whose vec_id is divisible by 50, among all other rows."""
    rows = usable(common.table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where("vec_id % 50 = 0"))
