"""What the operators of this package share: the shared folder, written tables, size-checked joins."""

from __future__ import annotations

import atexit
import ctypes
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has no more rows than this (a row is a key and a few numbers).
BROADCAST_ROWS = 100_000
#: A key is hot if more than one in this many of all rows have it, so fewer keys than this are.
HOT = 10_000

_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package through the shared folder, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = f"{shared_dir(spark)}/tidemill_code.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


_libc = None


def trimmed(batches: Iterator) -> Iterator:
    """The same record batches; between them a Python worker gives freed memory back, as it lives on beside the JVM's heap."""
    global _libc
    if _libc is None:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            _libc = ctypes.CDLL("libc.so.6")
            _libc.malloc_trim
        except (OSError, AttributeError):  # another C library: nothing to do
            _libc = False
    for batch in batches:
        yield batch
        if _libc:
            _libc.malloc_trim(0)
    if _libc:
        _libc.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; only where that is unset and the session local, one of our own."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        _scratch[app] = f"{base.rstrip('/')}/tidemill-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _scratch[app])
    return _scratch[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended already; its folder is left to the cluster's cleaner
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder in the shared file system."""
    _drop(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors lose nothing."""
    path = new_folder(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._tidemill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    if path := getattr(df, "_tidemill_path", None):
        drop_folder(df.sparkSession, path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its counted rows stay within BROADCAST_ROWS; else as it is, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, total: int, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` with what ``keyed`` (one row per key; n: how many rows have it) holds for their key; ``how``: inner or left.

    A small ``keyed`` is broadcast. Else hot keys are split into parts of about total / HOT rows by ``spread``, a hash that
    differs from row to row, and their rows in ``keyed`` are repeated for each part: at most HOT rows more. Rows without a
    key are spread too.
    """
    counted = keyed.count()
    if counted <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed.drop("n")), key, how)
    part = max(1, total // HOT)
    salts = F.ceil(F.col("n") / part).cast("int")
    hot = keyed.where(F.col("n") > part).select(F.col(key).alias("__hot"), salts.alias("__salts"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    many = F.when(F.col(key).isNull(), HOT).otherwise(F.coalesce("__salts", F.lit(1)))
    marked = marked.withColumn("__salt", F.pmod(spread, many).cast("int")).drop("__hot", "__salts")
    parts = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return marked.join(parts, [key, "__salt"], how).drop("__salt")


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: whatever its columns are called, none clashes with an operator's."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """What ``positional`` calls a column of ``df``."""
    return f"c{df.columns.index(name)}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under fixed names: other columns, whatever they are called, can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(new) for new, c in columns.items()])
