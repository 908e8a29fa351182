"""Helpers that the corpus operators share: written tables, splits and text batches as numpy arrays."""

from __future__ import annotations

import contextlib
import gc
import pickle
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract, U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step handles; bounds a worker's memory whatever the Arrow batch holds.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Unset, as in tests: a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gridloom.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("gridloom.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` has made and that nothing reads any more.

    The driver collects its garbage then, so that Spark removes the shuffles and broadcasts of finished steps and the
    heap of a driver that runs many small steps does not grow to its limit.
    """
    for df in tables:
        spark = df.sparkSession
        base = f"{shared_dir(spark)}/gridloom/"
        for folder in {f[: f.rindex("/")] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if "/gridloom/" in folder and base.split(":", 1)[-1].lstrip("/") in folder:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tidy(tables[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage, and give the memory that its JVM and its Python have freed back to the system.

    Hundreds of driver threads free native memory in dozens of arenas that the C library keeps; the JVM's own command
    trims them where it has one.
    """
    release()
    spark._jvm.System.gc()
    jvm = spark._jvm
    named = jvm.java.lang.Class.forName

    def array(kind, items: list):
        out = spark.sparkContext._gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    # through reflection on the public interface, since the server's own class is not open to py4j
    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, [named(k) for k in kinds]))
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    with contextlib.suppress(Py4JJavaError):  # another JVM or C library
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, [commands, "systemTrimNativeHeap", None, None]))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 modulo 3; a null id counts as the empty text's crc32, 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 3 == 1


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, so that other columns of an input never clash with an operator's own."""
    return df.select(*[df[f"`{n}`"] for n in names])


def bounded(sample: DataFrame, order: Column, most_bytes: int) -> list:
    """Rows of a small drawn ``sample`` in the order of a hash, whole texts, until they hold ``most_bytes`` bytes of text."""
    from pyspark.sql import Window

    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(order, "text").rowsBetween(Window.unboundedPreceding, 0))
    return sample.withColumn("__so_far", so_far).where(F.col("__so_far") <= most_bytes).drop("__so_far").collect()


def ship(spark: SparkSession, value) -> Callable:
    """A function that gives ``value`` on executors: broadcast once, classes included, so nothing is imported there."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def worker_state(owner: str) -> dict:
    """What a Python worker keeps from one task to the next for one ``owner``.

    Workers outlive the stage that filled them, so the first task of another owner drops what the last one kept and
    gives freed memory back to the system.
    """
    kept = sys.modules.setdefault("_gridloom_worker", types.ModuleType("_gridloom_worker")).__dict__
    if kept.get("owner") != owner:
        kept["owner"], kept["held"] = owner, {}
        release()
    return kept["held"]


def release() -> None:
    """Give memory that Python and Arrow have freed back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Columns of documents that operators read by name.
NAMED = ("doc_id", "text", "lang", "source")


def wrap(docs: DataFrame) -> DataFrame:
    """``docs`` with every column that operators do not read renamed, so that none clashes with their own."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in NAMED else f"__c{i}") for i, c in enumerate(docs.columns)])


def unwrap(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a wrapped table under their names again, without those that an operator has added."""
    return df.select(*[F.col(c if c in NAMED else f"__c{i}").alias(c) for i, c in enumerate(columns)])


def with_text(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and, last, the text as ``__text``."""
    return docs.select(*[docs[f"`{n}`"] for n in keep], docs["text"].alias("__text"))


def slices(column, step: int = STEP_BYTES):
    """Cut an Arrow string column into (first row, last row, UTF-8 bytes, offsets) pieces of about ``step`` bytes.

    Null texts are empty pieces. A single text longer than ``step`` is a piece of its own and stays whole.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(offsets, offsets[a] + step, side="right")) - 1
        b = min(max(b, a + 1), len(column))
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def text_steps(column, step: int = STEP_BYTES):
    """:func:`slices` with texts longer than ``step`` cut at white space: (first row, last row, bytes, offsets, more).

    ``more`` says that the one text of this step goes on in the next one. A stretch without white space stays whole.
    """
    for a, b, raw, offsets in slices(column, step):
        if b - a > 1 or len(raw) <= step:
            yield a, b, raw, offsets, False
            continue
        at = 0
        while at < len(raw):
            end = min(at + step, len(raw))
            if end < len(raw):
                while end < len(raw):
                    space = np.flatnonzero(_SPACE[raw[end : end + step]])
                    if len(space):
                        end += int(space[0]) + 1
                        break
                    end = min(end + step, len(raw))
            yield a, b, raw[at:end], np.array([0, end - at]), end < len(raw)
            at = end


#: Rows of an Arrow batch: long texts come in tens of megabytes a batch with Spark's default of 10,000.
BATCH_ROWS = 1000


def arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of BATCH_ROWS rows, and a worker that gives its memory back after each task.

    The number of rows is the session's setting, which is only changed where it has Spark's default.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def seg_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts`` (the last entry is the end); empty segments give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply); wraps on purpose."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of each text, and where each text's words start.

    A word's hash is the mixed sum of its bytes times powers of an odd number, made without any Python object.
    """
    n_docs = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    inside = ~_SPACE[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    edge = offsets[:-1]
    first[edge[edge < len(raw)]] = True  # a text's first byte follows nothing
    first &= inside
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    number = np.cumsum(first, dtype=np.int32) - 1
    at = np.arange(len(raw), dtype=np.int32) - starts.astype(np.int32)[np.maximum(number, 0)]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(at[inside].max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))  # one for each place of the longest word
        terms = (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers[np.minimum(at, len(powers) - 1)]
        terms[~inside] = 0
        hashes = mix64(np.add.reduceat(terms, starts))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def joined(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most_rows: int = 50_000, salts: int = 32) -> DataFrame:
    """``big`` joined with a written table ``small`` on ``keys`` (null equals null), hot keys in ``big`` included.

    ``small`` is counted: up to ``most_rows`` rows it is broadcast. Beyond, each of its rows is dealt to ``salts``
    places and ``big`` picks one by a hash of its row, so one key is spread over that many tasks, and adaptive
    execution can split further since both sides are plain exchanges.
    """
    condition = lambda a, b: [a[f"`{k}`"].eqNullSafe(b[f"`__{k}`"]) for k in keys]
    other = small.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in keys], *[F.col(f"`{c}`") for c in small.columns if c not in keys])
    if small.limit(most_rows + 1).count() <= most_rows:
        out = big.join(F.broadcast(other), condition(big, other), how)
    else:
        other = other.withColumn("__salt2", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        mine = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        out = mine.join(other, [*condition(mine, other), mine["__salt"] == other["__salt2"]], how).drop("__salt", "__salt2")
    return out.drop(*[f"__{k}" for k in keys])
