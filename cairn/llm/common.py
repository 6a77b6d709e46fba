"""What the training-data operators share: the shared folder, written tables, unique documents."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).

    Where it is unset, a session in one process (as in tests) gets a temporary
    folder; on a cluster that folder would be each machine's own, so it is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}/{name}"


#: Drops a statement's shuffle files as soon as it ends: what is written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of a statement."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._cairn_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches small enough, in rows and in bytes, that very long texts fit a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def give_back() -> None:
    """Return a Python worker's freed memory to the system: workers live on, idle, beside the next stage's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def unique_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with one row per non-null doc_id, null text as empty.

    Rows that repeat a doc_id count once, with their smallest text. The usual
    case, no repeats, is found by reading the id column alone and costs no
    shuffle of texts.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull())
    repeated = named.groupBy("doc_id").count().filter("count > 1").limit(1)
    if repeated.isEmpty():
        return named
    return named.groupBy("doc_id").agg(F.min("text").alias("text"))


def by_row(docs: DataFrame, key: str = "row_key") -> DataFrame:
    """docs with a key for each row, in order of doc_id with nulls last.

    Where ids are unique and not null the key is the id. Else rows are sorted,
    numbered and written, so that rows that share an id keep their own texts.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    return materialize(docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn(key, F.monotonically_increasing_id()), "rows")


def meet(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """rows with the columns of their group, which is there for each of them; groups is a written table with one row a key.

    A group of more rows than a partition's even share is broadcast, at least
    those of more than a thousandth of all rows: there are fewer of them than
    partitions, or a thousand. Their rows are dealt by `spread`, only those of
    others by the key, so no task gets more than its share of one group.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    shares = max(1000, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = F.struct(*[c for c in groups.columns if c != key])
    large = F.col(size) * shares > total
    hot = groups.filter(large).select(key, own.alias("_hot"))
    cold = groups.filter(~large).select(F.col(key).alias("_at"), own.alias("_cold"))
    apart = F.concat(F.lit("spread "), F.coalesce(F.col(spread), F.monotonically_increasing_id()).cast("string"))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("_to", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(apart))
    return marked.hint("merge").join(cold, F.col("_to") == F.col("_at"), "left").withColumn("_own", F.coalesce("_hot", "_cold")).select(*rows.columns, "_own.*")


# 64-bit mixing constants (odd, from the golden ratio and two common finalizers).
C1 = np.uint64(0x9E3779B97F4A7C15)
C2 = np.uint64(0xBF58476D1CE4E5B9)
C3 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over uint64 arrays; the argument is not changed."""
    x = x + C1
    x ^= x >> np.uint64(30)
    x *= C2
    x ^= x >> np.uint64(27)
    x *= C3
    x ^= x >> np.uint64(31)
    return x


def pair64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of an ordered pair of identifiers."""
    out = a * C1
    out += b * C2
    out ^= out >> np.uint64(32)
    return out


def long_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column (nulls as empty) end to end, and the n+1 offsets."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def binary_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """As long_bytes, of a binary column without nulls."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(batches, most: int = 16 << 20):
    """Group Arrow record batches into tables of about `most` bytes of text, splitting larger batches by rows.

    What a table's work has freed goes back to the system before the next one.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)
        total, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = int(np.searchsorted(total, before + most - size, side="right"))
            end = min(max(end, at + 1 if not held else at), batch.num_rows)
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(total[end - 1] - before)
            if end < batch.num_rows or size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                give_back()
            at = end
    if held:
        yield pa.Table.from_batches(held)
    give_back()
