"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where that is unset: on one machine, as in tests, a local one; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandlake-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/strandlake-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unwritten(*dfs: DataFrame) -> None:
    """Deletes the files of tables that `written` gave and that nothing reads any more."""
    for df in dfs:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; none for null."""
    text = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body (and lambdas in it) use it."""
    return F.transform(F.array(value), body)[0]


class Memory(dict):
    """What a function gave for the keys met lately, in two generations of at most `entries` each: when the younger
    is full it becomes the elder, and what is met again moves back. Keys over `longest` are not kept, so the memory is bounded in bytes."""

    def __init__(self, of, entries: int, longest: int = 64):
        self.of, self.entries, self.longest, self.elder = of, entries, longest, {}

    def __missing__(self, key):
        out = self.elder.get(key, self)
        if out is self:
            out = self.of(key)
            if len(key) > self.longest:
                return out
        if len(self) >= self.entries:
            self.elder = dict(self)
            self.clear()
        self[key] = out
        return out


#: What is kept in a worker from one task to the next: a name, and what drops it.
KEPT: dict[str, Callable[[], None]] = {}


def relieve() -> None:
    """Drops what earlier operators' tasks kept in this worker, which Spark reuses, and gives freed memory back."""
    while KEPT:
        KEPT.popitem()[1]()
    trimmed()


def trimmed() -> None:
    """Gives this process's freed memory back."""
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def relieve_driver(spark: SparkSession) -> bool:
    """Gives back what the driver has freed, in Python and in its JVM, where compiling the code of many plans leaves much in glibc's arenas.
    The JVM collects its garbage first, so that shuffles and broadcasts which no plan refers to go too. Whether the JVM could: OpenJDK on Linux can from 17.0.9 on."""
    trimmed()
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def listed(kind, *items):
        out = new(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    jvm.System.gc()
    try:
        # By the interface's method, as Py4J doesn't see those of the server's own class.
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kinds = [jvm.java.lang.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", listed(jvm.java.lang.Class, *kinds))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(server, listed(jvm.Object, name, "systemTrimNativeHeap", listed(jvm.Object), listed(jvm.String)))
    except Py4JError:
        return False
    return True


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else as it is (a shuffled join, which AQE splits where skewed)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def labelled_sample(labels: DataFrame, rows: int, seed: str = "s") -> DataFrame:
    """About `rows` labelled rows, by the hash of the id: the documented bound on what classifiers fit on."""
    n = labels.count()
    if n <= rows:
        return labels
    return labels.where(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) < int((1 << 30) * rows / n))
