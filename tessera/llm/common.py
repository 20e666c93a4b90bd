"""Shared helpers: shared-folder tables, vectorised hashing, Arrow batch limits."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import time
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches stay below this many bytes and rows, so a Python worker's memory is bounded.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000

#: Tables saved, of all stages, between two collections of the driver's garbage.
SAVES = 6

WORD_SPLIT = "[ \\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches sent to Python hold at most `rows` rows and about BATCH_BYTES bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session has none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            path = current.get()
        elif spark.sparkContext.master.partition("[")[0] == "local":
            path = "file://" + tempfile.mkdtemp(prefix="tessera-ckpt-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def trim_native(spark: SparkSession) -> bool:
    """Let the driver's JVM give back native memory that its threads and compilers have freed; False where it can't."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array

    def filled(kind, values: list):
        out = array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # by the interface: the server's class can't be reached from outside its module
        of = jvm.java.lang.Class.forName
        invoke = of("javax.management.MBeanServer").getMethod("invoke", filled(jvm.java.lang.Class, [of(k) for k in kinds]))
        invoke.invoke(server, filled(jvm.java.lang.Object, [name, "systemTrimNativeHeap", array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)]))
    except Py4JError:  # another JVM or C library
        return False
    return True


class Tables:
    """Parquet tables in the shared folder. They cut lineage and survive lost executors.

    Steps leave garbage behind in the driver, and its threads and compilers keep native memory that they have freed;
    both would grow from step to step, so every SAVES tables the one is collected and the other given back.
    """

    saved = 0

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        Tables.saved += 1
        if Tables.saved % SAVES == 0:
            self.collect()
        return self.spark.read.schema(df.schema).parquet(path)

    def collect(self) -> None:
        """Collect the driver's garbage, Python's handles first, and give freed native memory back where the JVM can."""
        gc.collect()
        self.spark._jvm.System.gc()
        trim_native(self.spark)

    def release(self) -> None:
        """Let Spark delete the shuffle files of steps that nothing refers to any more."""
        for _ in range(2):  # first the driver's handles go, then what they held
            gc.collect()
            time.sleep(0.2)
            self.collect()
            time.sleep(0.3)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the maximal runs of [^\\x20\\x09-\\x0D]; null and empty give an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WORD_SPLIT), lambda w: w != "")


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Long texts are hashed in segments of about this many bytes, cut at white space.
SEGMENT = 1 << 20

#: Words of more bytes are hashed one by one.
LONG_WORD = 64

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word of the ASCII-lowered text, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= 2 * SEGMENT:
        return _word_hashes(raw)
    space = np.flatnonzero(_SPACE[raw])
    cut = np.unique(space[np.minimum(np.searchsorted(space, np.arange(SEGMENT, len(raw), SEGMENT)), len(space) - 1)]) if len(space) else []
    return np.concatenate([_word_hashes(x) for x in np.split(raw, cut)])


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    data = _FOLD[raw]
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, n = edge[::2], edge[1::2] - edge[::2]
    eights = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    h = mix(n.astype(np.uint64) * _MULTIPLY)
    for j in range(0, min(int(n.max(initial=0)), LONG_WORD), 8):
        some = np.flatnonzero(n > j)
        eight = eights[start[some] + j] & _LOW_BYTES[np.minimum(n[some] - j, 8)]
        h[some] = mix((h[some] ^ eight) * _MULTIPLY)
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + n[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; with fewer words, of all its words as one."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), np.uint64)
    for j in range(min(k, len(w))):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + w[j : j + n])
    return np.unique(h)
