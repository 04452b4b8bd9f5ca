"""Reading, lineage cuts and word streams that several operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where there is one machine and none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plyframe-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder of ``spark.checkpoint.dir``."""
    shared(df.sparkSession)
    return df.checkpoint()


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: smaller than a checkpoint, of known size.

    It is deleted when the driver ends; the shuffle files that made it go at once.
    """
    spark = df.sparkSession
    folder = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def keyed(rows: DataFrame) -> DataFrame:
    """``rows(doc, text, ...)``, with ``key`` if an id has more than one row: a hash of the text for rows of such ids, else 0."""
    again = written(rows.where("doc is not null").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("again")), "ids")
    if again.isEmpty():
        return rows
    joined = rows.join(again, F.col("doc") == F.col("again"), "left")
    return joined.withColumn("key", F.when(F.col("again").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("bigint"))).drop("again")


def hex16(fingerprint: Column) -> Column:
    """A 64-bit pattern as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


#: Byte values: A-Z lower-cased, and whether a byte is white space (0x20, 0x09 to 0x0D).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """multiplier**0 .. multiplier**(n-1) modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate(([1], np.full(max(n, 1 << 16) - 1, _MULTIPLIER, dtype=np.uint64))).astype(np.uint64).cumprod(dtype=np.uint64)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of many texts as flat arrays.

    A word is a run of bytes that aren't ASCII white space, A-Z lower-cased. ``hash`` has
    64 bits for each word, ``start`` and ``end`` are byte offsets into ``data``, and text i
    owns words ``first[i]`` to ``first[i + 1]``; ``base[i]`` is where its bytes begin.
    """

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.zeros(0, np.uint8)
        self.data = data
        self.base = offsets - offsets[0]
        space = SPACE[data]
        word = ~space
        before = np.empty_like(space)
        before[:1] = True
        before[1:] = space[:-1]
        inner = self.base[1:-1]
        opens = word & before
        if len(inner):
            inside = inner[inner < len(data)]
            opens[inside] |= word[inside]
        after = np.empty_like(space)
        after[-1:] = True
        after[:-1] = space[1:]
        closes = word & after
        if len(inner):
            last = inner[inner > 0] - 1
            closes[last] |= word[last]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.base)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        """Of each word: sum of byte * multiplier**place, places counted from the word's end."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        width = self.end - self.start
        out = np.zeros(len(width), np.uint64)
        low = LOWER[self.data]
        m = np.uint64(_MULTIPLIER)
        live = np.arange(len(width))
        step = 0
        while len(live):
            if step == 32:  # what is left are very long words
                p = powers(int(width[live].max()) + 1)
                for i in live:
                    rest = low[self.start[i] + step : self.end[i]].astype(np.uint64) + np.uint64(1)
                    out[i : i + 1] = out[i : i + 1] * p[len(rest)] + (rest * p[: len(rest)][::-1]).sum(dtype=np.uint64)
                break
            out[live] = out[live] * m + low[self.start[live] + step] + np.uint64(1)
            step += 1
            live = live[width[live] > step]
        return mix(out)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words and the index of each one's first word; none crosses texts."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.zeros(n, np.uint64)
        m = np.uint64(0xD6E8FEB86659FD93)
        for i in range(k):
            out = out * m + self.hash[i : i + n]
        doc = self.doc()
        at = np.flatnonzero(doc[:n] == doc[k - 1 : k - 1 + n])
        return mix(out[at]), at


def slices(batch: pa.RecordBatch, column: int, limit: int = 2 << 20):
    """``batch`` in runs of rows of about ``limit`` bytes of a string column; a longer row is alone."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(at, end - at)
        at = end
    trim()


def trim() -> None:
    """Gives freed memory back to the system: a worker lives on for other stages."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
