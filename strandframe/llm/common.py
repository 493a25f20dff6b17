"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a local one is made only where none is set and Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="strandframe-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(df: DataFrame) -> None:
    """Asks the driver to let go of what no table needs any more, so that its shuffle files and checkpoints are deleted.

    Spark deletes them when the driver's JVM collects its garbage, which a driver with memory to spare does late. Tables that
    Python has dropped are handed over by a thread that looks once a second; what hangs on them goes with the second collection.
    """
    gc.collect()
    time.sleep(1.1)
    for _ in range(2):
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and written as Parquet in the shared checkpoint folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column | str) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column | str) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(key: Column | str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null keys count as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def utf8(values: pa.Array) -> Iterator[bytes | None]:
    """The bytes of each text of an Arrow array, without decoding them."""
    if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type):
        width = np.int64
    elif pa.types.is_string(values.type) or pa.types.is_binary(values.type):
        width = np.int32
    else:
        values, width = values.cast(pa.string()), np.int32
    n = len(values)
    if not n:
        return
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, dtype=width)[values.offset : values.offset + n + 1].tolist()
    data = memoryview(data) if data is not None else memoryview(b"")
    valid = values.is_valid().to_pylist() if values.null_count else None
    for i in range(n):
        yield bytes(data[ends[i] : ends[i + 1]]) if valid is None or valid[i] else None


class KeyFilter:
    """Which keys may be in a set: one bit for each value of 26 bits of a key, so 8 MB however many keys there are.

    Keys are 64-bit hashes. A full filter lets all keys pass; what passes is still to be joined.
    """

    SHIFT, BITS = 20, 26

    def __init__(self, keys: DataFrame, column: str) -> None:
        at = F.shiftrightunsigned(column, self.SHIFT).bitwiseAND(F.lit((1 << self.BITS) - 1)).alias("at")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
        words = keys.select(at).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
        bits = np.zeros(1 << (self.BITS - 6), dtype=np.uint64)
        bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
        self.handed = keys.sparkSession.sparkContext.broadcast(bits)

    def __getstate__(self) -> dict:
        return {"handed": self.handed}

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys.view(np.uint64) >> np.uint64(self.SHIFT)) & np.uint64((1 << self.BITS) - 1)
        return (self.handed.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    def where(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of df whose key may be in the set."""

        @F.arrow_udf("boolean")
        def there(keys: pa.Array) -> pa.Array:
            return pa.array(self(keys.to_numpy(zero_copy_only=False)))

        return df.where(there(column))
