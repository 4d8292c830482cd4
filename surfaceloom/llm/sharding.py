"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split on one more bit.

A row's hash is the first 60 bits of the MD5 of its id. A bucket is a prefix; it is a shard if its bytes fit the limit, or
if nothing tells its rows apart any more; otherwise its two halves, one bit longer, take its place. The sizes of all
prefixes up to STEP bits come out of one aggregate, so a round settles STEP splits at once, and only the rows of buckets
that are still too large go into the next. Nothing grows on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfaceloom.llm.common import settle, table

LIMIT, BITS, STEP = 1 << 20, 60, 15


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, bytes, depth, shard (its bits), shard_bytes and shard_rows for each row of docs.

    bytes is the text's UTF-8 length, 0 for null. A row above the limit is a shard of its own, as are rows whose hashes
    are the same (repeated ids, and all rows with a null id); these shards alone may be above the limit. A table that
    fits is one shard of depth 0; an empty one has none. Other columns, whatever their names, are ignored.
    """
    rows = settle(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes")).withColumn(
            "hash", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
        ),
        "rows",
    )
    done = None
    for base in range(0, BITS, STEP):
        key = F.shiftrightunsigned("hash", BITS - base - STEP)
        # at most 2**STEP rows for each bucket that came in; partial sums are made before they are dealt
        sizes = rows.groupBy(key.alias("key")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        sizes = settle(sizes, "prefixes")
        each = sizes.select("*", F.explode(F.sequence(F.lit(base), F.lit(base + STEP))).alias("depth"))
        each = each.withColumn("bucket", F.expr(f"shiftrightunsigned(key, {base + STEP} - depth)"))
        fits = (
            each.groupBy("depth", "bucket")
            .agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"), F.min("low").alias("low"), F.max("high").alias("high"))
            .where((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high")) | (F.col("depth") == BITS))
        )
        found = each.select("key", "depth", "bucket").join(fits, ["depth", "bucket"]).groupBy("key").agg(F.min_by(F.struct("depth", "bucket", "shard_bytes", "shard_rows"), "depth").alias("s"))
        placed = rows.withColumn("key", key).join(found, "key", "left")
        now = placed.where("s is not null").select("doc_id", "bytes", "s.*")
        done = now if done is None else done.unionAll(now)
        left = settle(placed.where("s is null").select("doc_id", "bytes", "hash"), "oversized")
        if base + STEP == BITS or left.isEmpty():
            break
        rows = left
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(bucket), depth, '0')"))
    return done.select("doc_id", "bytes", F.col("depth").cast("int").alias("depth"), bits.alias("shard"), "shard_bytes", "shard_rows")


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """docs as one folder for each shard, each row once.

    Rows with one doc_id, or without any, are in one shard, whatever their texts, so shards are joined back by id. No rows:
    an empty folder. A column of docs named shard is refused, as the folders have that name.
    """
    if "shard" in docs.columns:
        raise ValueError("docs has a column named shard")
    at = assign(docs, limit).select(F.col("doc_id").alias("doc_id_"), F.concat(F.lit("s"), "shard").alias("shard")).distinct()
    docs.join(at, docs["doc_id"].cast("long").eqNullSafe(at["doc_id_"])).drop("doc_id_").repartition("shard").write.partitionBy("shard").parquet(path)


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, {BITS // 4}))::BIGINT AS hash FROM documents
), each AS (
  SELECT doc_id, bytes, hash, depth, hash >> ({BITS} - depth) AS bucket FROM rows, (SELECT unnest(range(0, {BITS} + 1)) AS depth)
), fits AS (
  SELECT depth, bucket, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM each GROUP BY depth, bucket
  HAVING sum(bytes) <= {LIMIT} OR min(hash) = max(hash) OR depth = {BITS}
), placed AS (
  SELECT doc_id, bytes, depth, bucket, shard_bytes, shard_rows, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS n FROM each JOIN fits USING (depth, bucket)
)
SELECT doc_id, bytes, depth::INTEGER AS depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bucket), depth::INTEGER, '0') END AS shard, shard_bytes, shard_rows
FROM placed WHERE n = 1
"""
