"""What the operators share: the cluster's shared folder, word splitting, skew-safe joins."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has more rows than this and than a HOT_KEYS-th of all rows, so at most HOT_KEYS keys are hot.
HOT_ROWS, HOT_KEYS, SALTS = 50_000, 10_000, 32

#: Bytes of an Arrow batch of texts: each is in memory on both sides of a worker.
BATCH = 8 << 20

#: A-Z to a-z, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and every ASCII byte that is no letter or digit becomes a space.
ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: What this driver made and removes at its end.
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, as in tests, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark.sparkContext, "_halyard_shared", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="halyard-")
            spark.sparkContext._halyard_shared = base
            _made.append(base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when this driver ends."""
    path = f"{shared_base(spark)}/halyard/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove(path: str) -> None:
    fs, at = open_fs(path)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:
        fs.delete_dir(at)


@atexit.register
def _remove_made() -> None:
    for path in _made:
        remove(path)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow filesystem and the path in it; a bare path is local."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that hands its free memory back at the end, as the worker stays for tasks of other stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return wrapped


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a Spark context; Arrow batches of BATCH bytes where none are set."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # Spark's own default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    sc = spark.sparkContext
    if getattr(sc, "_halyard_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="halyard-zip-"), "halyard_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(os.path.join(root, "halyard")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._halyard_shipped = True


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """About `limit` rows at most, chosen by a hash of `key`; fewer rows stay as they are."""
    total = df.count()
    if total <= limit:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 32)) < int(limit / total * (1 << 32)))


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, weight: str, total: int, spread: str) -> DataFrame:
    """rows left-joined with lookup, which has one row a key and in `weight` its number of rows.

    Hot keys (at most HOT_KEYS of them, so that list may be broadcast) are spread over SALTS partitions by a hash of
    `spread`. Null keys match a null key of lookup.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = lookup.where(F.col(weight) > least).select(F.col(key).alias("_k"), F.lit(True).alias("_hot"))
    left = rows.join(F.broadcast(hot), rows[key].eqNullSafe(hot["_k"]), "left").drop("_k")
    left = left.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    right = lookup.withColumnRenamed(key, "_k").withColumn("_s", F.explode(F.when(F.col(weight) > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(weight)
    return left.join(right, (left["_salt"] == right["_s"]) & left[key].eqNullSafe(right["_k"]), "left").drop("_k", "_s", "_salt")


def words_of(text: str | None, table: bytes = ALNUM) -> list[bytes]:
    """The words of a text: its UTF-8 through `table`, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(table).split()


def mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit hash of two, the order counting."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt * 0x165667B19E3779F9 & (1 << 64) - 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))
