"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprints are made once per text; equal ones collapse to one row before any join. Two fingerprints within
RADIUS bits have, on a ring of SEGMENTS segments, a start from which every chain of consecutive segments differs in at most
its proportional share of the budget: the first segment not at all, the first two together in at most one bit, and all in
at most RADIUS. The join key is the first segment with the second one at one of its admissible differences, so that the full
Hamming check sees only pairs that already satisfy the chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Bits of the ring's segments, from the lowest.
SEGMENTS = (22, 21, 21)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at a time.
_BLOCK = 1 << 17


def fingerprint(text: str | None) -> int:
    """Bit b is set if it is set in more than half of the shingles' hashes (repeats counted); 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(joined, SEED)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    at = np.concatenate([[0], np.cumsum(n)])
    starts, ends = at[: len(words) - SHINGLE + 1].tolist(), (at[SHINGLE:] - 1).tolist()
    view = memoryview(joined)
    total = np.zeros(64, np.int64)
    for i in range(0, len(starts), _BLOCK):
        h = np.array([xxh64_intdigest(view[a:b], SEED) for a, b in zip(starts[i : i + _BLOCK], ends[i : i + _BLOCK])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``keep`` and fp (its 64 bits as a signed long), a row per input row. Null and empty texts: 0."""
    common.ship(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])
    return rows.mapInArrow(lambda it: _fingerprints(common.trimmed(it)), schema)


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, sum(SEGMENTS[:i])).bitwiseAND(F.lit((1 << SEGMENTS[i]) - 1))


def _key(i: int, first: Column, second: Column) -> Column:
    """Segment i and the next, with i itself in the top bits."""
    return F.shiftleft(F.lit(i).cast("long"), 60).bitwiseOR(F.shiftleft(first, 24)).bitwiseOR(second)


def candidate_links(prints: DataFrame) -> DataFrame:
    """All pairs a < b (as longs) of distinct fingerprints within RADIUS bits; ``prints`` has one column fp, distinct."""
    k = len(SEGMENTS)
    index, probe = [], []
    for i in range(k):
        j = (i + 1) % k
        first, second = _segment(F.col("fp"), i), _segment(F.col("fp"), j)
        index.append(_key(i, first, second))
        probe += [_key(i, first, second.bitwiseXOR(F.lit(flip))) for flip in [0, *(1 << b for b in range(SEGMENTS[j]))]]
    a = prints.select(F.col("fp").alias("a"), F.explode(F.array(*index)).alias("key"))
    b = prints.select(F.col("fp").alias("b"), F.explode(F.array(*probe)).alias("key"))
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # never broadcast: rows grow many times between the files Spark sizes a side by and the join
    return a.hint("merge").join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & (far <= RADIUS)).select("a", "b").distinct()


def rooted(classes: DataFrame) -> DataFrame:
    """Adds root, the least fingerprint reachable over links, to rows that each have a distinct fingerprint fp."""
    links = common.written(candidate_links(classes.select("fp")), "links")
    linked = components(links)  # only fingerprints with links
    return common.written(classes.join(linked, classes.fp == linked.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node"), "rooted")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links), one row per input row.

    Null, empty and blank texts have fingerprint 0 and link like any other. Null ids take part but name no
    component unless no other id is there (then null). Repeated rows stay repeated. An empty table gives no rows. Columns
    besides the two named are ignored.
    """
    picked = common.pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = common.written(fingerprints(picked, ["doc_id"]), "fingerprints")
    found = rooted(common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes"))
    names = common.written(found.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "names")
    named = common.salted_join(found.select("root", "fp", F.col("n").alias("copies")), names, "root", found.count(), F.xxhash64("fp"))
    named = common.written(named.select("fp", F.col("copies").alias("n"), "component_id"), "named")
    return common.salted_join(rows, named, "fp", rows.count(), F.xxhash64("doc_id")).select("doc_id", "fp", "component_id")


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of linked fingerprints: the one with the smallest id (null comes last), of equal ids
    the one whose columns have the smallest hash, of equal rows any one.

    Rows are told apart by a number of their own, so rows that share an id are lost only to a row they are linked with.
    Null and blank texts are one group. An empty table stays empty; columns may have any names.
    """
    text, doc_id = common.place(df, text_col), common.place(df, id_col)
    plain = common.positional(df)
    hashed = [c for c, kind in plain.dtypes if "map<" not in kind and kind != "variant"]  # Spark hashes no maps
    rows = fingerprints(plain.withColumn("whole", F.xxhash64(*hashed)), [*plain.columns, "whole"], text)
    rows = common.written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "whole", "row")
    found = rooted(common.written(rows.groupBy("fp").agg(F.min(order).alias("first")), "classes"))
    first = common.written(found.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row")), "first")
    # a hash join builds on the numbers, so the texts are shuffled but not sorted
    return rows.join(first.hint("shuffle_hash"), "row", "left_semi").select(*plain.columns).toDF(*df.columns)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component. Null and blank texts have fingerprint zero; a component without an id is null."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
