"""Exact top-k by integer inner product on a pivot-distance index.

Vectors get one component more, which lifts them all to the length of the longest; a query gets 0 there. Then the inner
product falls as the Euclidean distance rises, and the triangle inequality bounds it. The index keys a vector by its
nearest pivot and the distance to it; sorted so, it is cut into blocks of SHELL vectors, thin annuli around a pivot. A
query first looks into the annulus that it lies in itself, which gives a score that its k-th answer has at least; then it
expands to the annuli around each pivot that can hold a better one, and to no others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surfaceloom.llm.common import lean, settle, table
from surfaceloom.llm.vectors import proper, width

SCALE, K, SHELL = 1024, 10, 512
#: Pivots, and the vectors that they are fitted on at most (the first by a hash of their number).
PIVOTS, FIT_ROWS = 64, 4096
#: Rounding of distances; bounds are widened by it.
SLACK = 1e-6

BLOCK = "block long, pivot int, low double, high double, ids array<long>, vectors binary"


def scaled(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


class Space:
    """The lifted space: the longest vector's squared length and the pivots."""

    def __init__(self, longest: float, sample: np.ndarray):
        self.longest = longest
        x = self.lift(sample)
        rng = np.random.default_rng(3)
        chosen = [0]
        gap = ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(PIVOTS, len(x)) and gap.max() > 0:  # far from those there are, then averaged
            chosen.append(int(rng.choice(len(x), p=gap / gap.sum())))
            gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
        self.pivots = x[chosen]
        for _ in range(8):
            near = self.distances(x).argmin(1)
            total = np.zeros_like(self.pivots)
            np.add.at(total, near, x)
            count = np.bincount(near, minlength=len(total))
            self.pivots = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], self.pivots)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0, self.longest - (x * x).sum(1)))]

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """To each pivot."""
        square = (lifted * lifted).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0, square))


def scores(q: np.ndarray, x: np.ndarray, longest: float) -> np.ndarray:
    """Inner products; doubles are exact below 2**53, which no partial sum exceeds then."""
    if longest < 2**52:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def best(score: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest, ties to the smaller id, without the query's own id."""
    ok = np.flatnonzero(ids != own)
    if len(ok) > k:
        ok = ok[score[ok] >= np.partition(score[ok], len(ok) - k)[len(ok) - k]]
    return ok[np.lexsort((ids[ok], -score[ok]))][:k]


def search(df: DataFrame, asked: str = "vec_id % 100 = 0", k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: the k best other rows for every row where `asked` holds.

    Components are taken as floor(1024 * x). Rows with a null vec_id, and vectors that are null, of another length than
    most, or hold null or non-finite components take no part. Ties go to the smaller vec_id. Rows that repeat a query's
    vec_id are the query itself, by the vector whose bytes sort first if they differ; other repeated rows are answers of
    their own. Fewer than k others: all of them. An empty table gives none. Other columns, whatever their names, are
    ignored.
    """
    size = width(df)
    schema = "vec_id long, vector binary, square double"
    # vectors travel in the narrowest type that holds every component
    proper_ = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    peak = df.agg(F.max(F.array_max(F.transform(F.filter("embedding", proper_), lambda v: F.abs(v.cast("double")))))).first()[0] or 0.0
    kind = next((k for k, most in (("<i2", 2**15), ("<i4", 2**31)) if SCALE * (peak + 1) < most), "<f8")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = proper(batch.column(1), size)
            x = scaled(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([v.astype(kind).tobytes() for v in x], pa.binary()), pa.array((x * x).sum(1))], ["vec_id", "vector", "square"])

    packed = settle(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null").mapInArrow(lean(pack), schema), "vectors")
    longest = packed.agg(F.max("square")).first()[0]
    if longest is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    load = lambda raw: np.frombuffer(b"".join(raw), kind).reshape(-1, size).astype(np.float64)
    sample = packed.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(FIT_ROWS).select("vector").collect()  # bounded
    space = Space(longest, load([bytes(r.vector) for r in sample]))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = space.distances(space.lift(load(batch.column(1).to_pylist())))
            near = far.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])], ["vec_id", "vector", "pivot", "distance"])

    def shells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring rows of a pivot, SHELL at a time."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        rest: pa.Table | None = None
        for batch in [*batches, None]:
            rows = pa.Table.from_batches([batch]) if batch is not None else None
            if rest is not None:
                rows = rest if rows is None else pa.concat_tables([rest, rows])
            if rows is None:
                return
            pivot, distance, ids = (rows.column(n).to_numpy() for n in ("pivot", "distance", "vec_id"))
            vectors = rows.column("vector").to_pylist()
            change = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1])) if len(pivot) else []
            cuts = [c for a, b in zip(change, [*change[1:], len(pivot)], strict=True) for c in range(a, b, SHELL)]
            ends = [*cuts[1:], len(pivot)]
            if batch is not None and cuts:  # the last may go on
                rest = rows.slice(cuts[-1])
                cuts, ends = cuts[:-1], ends[:-1]
            out = [(number + i, pivot[a], distance[a], distance[b - 1], ids[a:b], b"".join(vectors[a:b])) for i, (a, b) in enumerate(zip(cuts, ends, strict=True))]
            number += len(out)
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["block", "pivot", "low", "high", "ids", "vectors"])

    placed = packed.select("vec_id", "vector").mapInArrow(lean(place), "vec_id long, vector binary, pivot int, distance double")
    index = settle(placed.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id").mapInArrow(lean(shells), BLOCK), "index")

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the annuli that may hold its answers, after a look into its own."""
        for batch in batches:
            out = []
            for own, vector, ids, vectors in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                q, x, ids = load([vector]), load([vectors]), np.array(ids)
                score = scores(q, x, longest)[0]
                top = best(score, ids, own, k)
                square = float((q * q).sum())
                reach = np.sqrt(max(0.0, square + longest - 2 * float(score[top[-1]]))) if len(top) == k else np.inf
                far = space.distances(np.c_[q, np.zeros(1)])[0]
                slack = SLACK * (1 + np.sqrt(longest))
                out += [(own, vector, p, f - reach - slack, f + reach + slack) for p, f in enumerate(far.tolist())]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["query_id", "vector", "pivot", "from", "to"])

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = ids = x = None
        for batch in batches:
            out = []
            for number, own, vector, these, vectors in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if own is None:
                    block, ids, x = number, np.array(these), load([vectors])
                    continue
                assert block == number
                score = scores(load([vector]), x, longest)[0]
                out += [(own, int(ids[i]), int(score[i])) for i in best(score, ids, own, k)]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    homes = index.select(F.explode("ids").alias("query_id"), "block").where(asked.replace("vec_id", "query_id")).dropDuplicates(["query_id"])
    queries = homes.join(packed.where(asked).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")), "query_id")
    asks = settle(queries.join(index, "block").select("query_id", "vector", "ids", "vectors").mapInArrow(lean(ask), 'query_id long, vector binary, pivot int, `from` double, `to` double'), "asks")
    open_ = asks.join(index.select("block", "pivot", "low", "high"), "pivot").where("low <= to and high >= from").select("block", "query_id", "vector", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("vectors"))
    blocks = index.select("block", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("binary").alias("vector"), "ids", "vectors")
    answers = open_.unionAll(blocks).repartition("block").sortWithinPartitions("block", F.col("query_id").asc_nulls_first()).mapInArrow(lean(answer), "query_id long, vec_id long, score long")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
