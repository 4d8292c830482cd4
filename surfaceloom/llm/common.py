"""Helpers shared by the corpus operators: tables, shared-folder tables, text slices, connected components."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surfaceloom.shipping import shared_dir, ship

#: Bytes of text that a worker turns into NumPy arrays at once; every array costs eight times as much.
SLICE_BYTES = 1 << 19
#: Spark then removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's bound on the bytes of a batch sent to Python, and the bound that these operators ask for: a batch is held by the
#: executor and by the worker, and its default of 64 MB is more than what the operators themselves hold.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_settled: dict[str, list[str]] = {}


def ready(spark: SparkSession) -> None:
    """Sends the package to the workers and bounds the bytes of a batch for them; a smaller bound of the session stays."""
    ship(spark)
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH)) <= BATCH_BYTES:
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to a table in the shared folder and reads it again: lineage ends here, and lost executors lose nothing.

    The table stays until forget() or release(): what reads it is lazy.
    """
    spark = df.sparkSession
    ready(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _settled.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(schema).parquet(path)
    out.settled_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _settled[spark.sparkContext.applicationId].remove(path)


def forget(*tables: DataFrame) -> None:
    """Removes settled tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t.settled_at)


def release(spark: SparkSession) -> None:
    """Removes all tables that operators have settled in this application; results that weren't written are lost with them."""
    for path in list(_settled.get(spark.sparkContext.applicationId, ())):
        _remove(spark, path)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that hands freed memory back at its end, as the worker stays for other steps."""

    @functools.wraps(run)
    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return wrapped


def numbered(docs: DataFrame) -> DataFrame:
    """row (all columns of docs as one, so that no name can clash) and number, which tells any two rows apart."""
    return settle(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df where it's a table in files as it stands, so that it can be read again and again; else it is settled."""
    plan = df._jdf.queryExecution().analyzed()
    files = plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"
    return df if files else settle(df, name)


def text_key() -> Column:
    """A hash that tells rows with one doc_id, or without any, apart by their texts; repeated rows share it."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("text").cast("string"))


def text_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes of column `text` each; a longer row stands alone."""
    sizes = np.fromiter((0 if x is None else x for x in pc.binary_length(batch.column("text")).to_pylist()), np.int64, batch.num_rows)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def packed_texts(text: pa.Array) -> pa.Array:
    """Each text's bytes, compressed, behind their number (8 bytes, little-endian). Null is empty."""
    raw = [b"" if x is None else x for x in text.cast(pa.binary()).to_pylist()]
    return pa.array([len(x).to_bytes(8, "little") + _codec().compress(x, asbytes=True) for x in raw], pa.binary())


def unpacked_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """text_slices() of a batch whose column `text` is packed, with the texts' bytes in it; a column of strings is taken as it is."""
    at = batch.schema.get_field_index("text")
    if not pa.types.is_binary(batch.schema.field(at).type):
        yield from text_slices(batch, limit)
        return
    start, raw, total = 0, [], 0
    for i, x in enumerate(batch.column(at)):
        x = x.as_buffer()
        size = int.from_bytes(x[:8], "little")
        if total and total + size > limit:
            yield batch.slice(start, i - start).set_column(at, "text", pa.array(raw, pa.binary()))
            start, raw, total = i, [], 0
        raw.append(_codec().decompress(x[8:], size, asbytes=True) if size else b"")
        total += size
    if raw:
        yield batch.slice(start).set_column(at, "text", pa.array(raw, pa.binary()))


@functools.cache
def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def joined_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows after one another, and where each row starts (one more for the end). Null is empty."""
    raw = [b"" if x is None else x for x in text.cast(pa.binary()).to_pylist()]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=starts[1:])
    return np.frombuffer(b"".join(raw), np.uint8), starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def byte_words(seed: int) -> np.ndarray:
    """A 64-bit word for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1) + np.uint64(seed))


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: columns u, v (long). Returns node, root: every node of an edge and the smallest node it can reach. No edges:
    an empty table. Each round is two shuffles of the edges and ends in a table in the shared folder; the number of
    rounds follows the logarithm of the longest chain.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    by_u = Window.partitionBy("u")
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(seen)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(by_u), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(by_u))
        small = small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        before, now = now, settle(small, "edges")
        forget(before)
