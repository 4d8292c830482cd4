"""Near-duplicate embeddings by Euclidean p-stable hashing, with exact cosine checks.

A table's bucket is the floors of PROJECTIONS random projections of the normalised vector, shifted and cut at WIDTH. For
vectors at cosine 0.9 (distance 0.447) a projection agrees with probability 0.82, so that one of the TABLES tables holds
both with 0.985; at 0.95 with 0.9997. Vectors travel in the precision that they have in the table. Identical vectors are one class with a weight, and go through once. Buckets above
TILE are cut into tiles that are compared two by two, so a task holds two tiles at most and no pair is made a row: a tile
returns, for each vector, the weight of the links that no earlier table has found and one link of its component there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfaceloom.llm.common import components, lean, mix, settle, table
from surfaceloom.llm.vectors import proper, width

TABLES, PROJECTIONS, WIDTH, TILE, SEED = 28, 10, 2.0, 512, 5


class Tables:
    def __init__(self, size: int):
        rng = np.random.default_rng(SEED)
        self.lines = rng.standard_normal((size, TABLES * PROJECTIONS))
        self.shift = rng.uniform(0, WIDTH, TABLES * PROJECTIONS)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """A number for each vector and table."""
        cells = np.floor((unit @ self.lines + self.shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, PROJECTIONS)
        total = np.zeros((len(unit), TABLES), np.uint64) + mix(np.arange(1, TABLES + 1, dtype=np.uint64))
        for i in range(PROJECTIONS):
            total = mix(total ^ (cells[:, :, i] + np.uint64(0x9E3779B97F4A7C15)))
        return total


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pack(size: int, kind: str):
    """vec_id and, of proper vectors that are not zero, their components as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = proper(batch.column(1), size)
            full = (x != 0).any(1)
            out: list[bytes | None] = [None] * batch.num_rows
            for i, v in zip(rows[full].tolist(), x[full] + 0.0, strict=True):
                out[i] = v.astype(kind).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vector"])

    return run


def _buckets(size: int, kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(size)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = np.frombuffer(b"".join(part.column(1).to_pylist()), kind).reshape(-1, size).astype(np.float64)
                codes = tables.codes(unit(x))
                own = np.repeat(part.column(0).to_numpy(), TABLES)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(x))), pa.array(codes.ravel().view(np.int64))], ["node", "place", "bucket"])

    return run


def _links(size: int, least: float, kind: str):
    def linked(node: np.ndarray, side: np.ndarray, weight: np.ndarray, x: np.ndarray, place: int, tables: Tables) -> Iterator[tuple]:
        x = unit(x)
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        if side.max() > 0:  # two tiles: only what is between them
            near &= side[:, None] != side[None, :]
        a, b = np.nonzero(near)
        if not len(a):
            return
        if place:  # what an earlier table holds as well was counted there
            some = np.unique(a)
            codes = np.zeros((len(x), place), np.uint64)
            codes[some] = tables.codes(x[some])[:, :place]
            new = ~(codes[a] == codes[b]).any(1)
            a, b = a[new], b[new]
            if not len(a):
                return
        links = np.bincount(a, weight[b], len(x)).astype(np.int64)
        label = np.arange(len(x))
        while True:
            now = label.copy()
            np.minimum.at(now, a, label[b])
            if (now == label).all():
                break
            label = now
        for i in np.unique(a).tolist():
            yield int(node[i]), int(node[label[i]]), int(links[i])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, rest = Tables(size), None
        every = pa.schema([("bucket", pa.int64()), ("tile", pa.int64()), ("node", pa.int64()), ("side", pa.int32()), ("place", pa.int32()), ("weight", pa.int64()), ("vector", pa.binary())])

        def groups(rows: pa.RecordBatch, whole: bool):
            bucket, tile = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])))
            ends = np.append(first[1:], rows.num_rows)
            last = len(first) if whole else len(first) - 1
            out: list[tuple] = []
            side, place, weight = rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(5).to_numpy()
            node = rows.column(2).to_numpy()
            raw = rows.column(6).to_pylist()
            for a, b in zip(first[:last].tolist(), ends[:last].tolist(), strict=True):
                if b - a > 1:
                    x = np.frombuffer(b"".join(raw[a:b]), kind).reshape(-1, size).astype(np.float64)
                    out.extend(linked(node[a:b], side[a:b], weight[a:b], x, int(place[a]), tables))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            left = None if whole else rows.slice(int(first[-1]))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v", "links"]), left

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.cast(every) if batch.schema != every else batch
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            found, rest = groups(rows, False)
            yield found
        if rest is not None:
            yield groups(rest, True)[0]

    return run


def near(df: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each row of df (vec_id, embedding).

    Links are pairs of rows with cosine >= least that share a bucket; n_links counts rows, copies too. Vectors that are
    null, zero, of another length than most, or that hold null or non-finite components link with nothing and are their
    own component, and kept. A null vec_id can be linked but names no component (one of null ids alone has a null id); repeated
    rows, and different vectors with one vec_id, are rows that link by their vectors. An empty table gives none. Other
    columns, whatever their names, are ignored.
    """
    size = width(df)
    kind = "<f4" if df.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    packed = settle(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(lean(_pack(size, kind)), "vec_id long, vector binary"), "vectors")
    # copies are one node, with a number of its own: ids can be null or stand at different vectors
    nodes = packed.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = settle(nodes.select("node", "vector").mapInArrow(lean(_buckets(size, kind)), "node long, place int, bucket long"), "buckets")
    full = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    tiled = (
        keys.join(full, "bucket")
        .withColumn("cuts", F.ceil(F.col("n") / TILE))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
        .select("bucket", (F.least("own", "other") * F.col("cuts") + F.greatest("own", "other")).alias("tile"), "node", (F.col("own") > F.col("other")).cast("int").alias("side"), "place")
    )
    rows = tiled.join(nodes.drop("first"), "node").select("bucket", "tile", "node", "side", "place", "weight", "vector")
    found = settle(rows.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "node").mapInArrow(lean(_links(size, least, kind)), "u long, v long, links long"), "links")
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("others"))
    roots = components(found.where("u <> v").select("u", "v"))
    rooted = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # the smallest id that is not null
    named = rooted.select("node", "root").join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    by_node = nodes.join(counts, "node", "left").join(named, "node").select("vector", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = packed.join(by_node, "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings"))
