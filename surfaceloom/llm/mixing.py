"""Mixing sources to target weights: blocks of words, multinomial counts for each shard, permutations, a join by index.

The words of a source, in the order of its documents, are cut into blocks of a fixed length. The mix is a row of slots,
dealt to output shards; a shard draws how many slots each source gets from a multinomial whose weights are the slots that
the sources still have to fill, so that the sums come out at the targets. Slot j of a source takes the block at place j of
an endless row of pseudorandom permutations of the source's blocks: a block comes a second time only after all came once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surfaceloom.llm.common import mix, numbered, settle, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, BLOCK, SHARD_SLOTS, SEED = (5, 2, 1), Fraction(3, 2), 2, 64, 1 << 16, 7
#: Shards at most (above SHARD_SLOTS times as many slots shards get larger), and slots that one row is exploded to at most.
SHARDS, RUN_SLOTS = 1 << 13, 1 << 16


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, most: int = MOST) -> list[Fraction]:
    """share of all sizes dealt by weight; none above `most` times its size, the excess dealt again to the others."""
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    out = [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        for i in over or open_:
            out[i] = Fraction(most * sizes[i]) if over else unit * weights[i]
        left -= sum(out[i] for i in over)
        open_ = open_ - over if over else set()
    return out


def draw(slots: list[int], per_shard: int, seed: int) -> Iterator[tuple[int, int, int, int]]:
    """(shard, source, first slot of the source, count), where count > 0. Every source fills exactly its slots."""
    rng = np.random.default_rng(seed)
    left, done, shard = np.array(slots, np.int64), np.zeros(len(slots), np.int64), 0
    while total := int(left.sum()):
        size = min(per_shard, total)
        got = np.minimum(rng.multinomial(size, left / total), left)
        while short := size - int(got.sum()):  # where a source has no slots left, the others draw on
            rest = left - got
            got += np.minimum(rng.multinomial(short, rest / rest.sum()), rest)
        for s in np.flatnonzero(got):
            yield shard, int(s), int(done[s]), int(got[s])
        done, left, shard = done + got, left - got, shard + 1


def permuted(place: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size) for each key, at `place`: a Feistel network, walked until it is inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = place.astype(np.uint64), np.arange(len(place))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        a, b = out[todo] >> h, out[todo] & m
        for step in range(4):
            a, b = b, a ^ (mix(b + k + np.uint64(step * 0xA0761D6478BD642F & (1 << 64) - 1)) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


class Mix:
    """The tables of one mix of docs (doc_id, text, source; null text: no words).

    sources: source, idx, source_size, target. rows: doc_id, idx, size, start (its first word's place in the source), one
    for each row of docs, repeated ones too. slots: shard, idx, slot, block. pieces: the part of a row in a block, with
    `times`, how often the mix takes that block. The driver holds a line for each source, for each
    source of a shard (SHARDS of them at most), and for each partition of the sort of ids.
    `number` names a column that tells rows apart; rows and pieces then carry it.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, number: str | None = None):
        spark = docs.sparkSession
        self.block = block
        self.number = [number] if number else []
        # rows of one doc_id and size, in an order that hangs on their texts first
        ties = [F.xxhash64("text").alias("tie"), number] if number else []
        order = ["doc_id", "size", *(["tie", number] if number else [])]
        sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"), *ties)
        # a source's documents in order, whatever number of tasks they take
        sized = settle(sized.repartitionByRange("source", *order).sortWithinPartitions("source", *order).withColumn("part", F.spark_partition_id()), "sizes")
        per = sized.groupBy("source", "part").agg(F.sum("size").alias("words")).collect()
        total: dict = {}
        for r in per:
            total[r.source] = total.get(r.source, 0) + r.words
        names = sorted((s for s in total if s is not None)) + [None] * (None in total)
        sizes = [total[s] for s in names]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, most)
        blocks = [-(-n // block) for n in sizes]
        self.counts = [min(most * b, round(t * b / n)) if n else 0 for t, b, n in zip(goal, blocks, sizes, strict=True)]
        self.sources = spark.createDataFrame([(s, i, n, float(t)) for i, (s, n, t) in enumerate(zip(names, sizes, goal, strict=True))], "source string, idx int, source_size long, target double")
        number = {s: i for i, s in enumerate(names)}
        before, at = [], {}
        for r in sorted(per, key=lambda r: (number[r.source], r.part)):
            before.append((number[r.source], r.source, r.part, at.get(r.source, 0)))
            at[r.source] = at.get(r.source, 0) + r.words
        before = spark.createDataFrame(before, "idx int, source_ string, part_ int, before long")
        inside = Window.partitionBy("idx", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.rows = (
            sized.join(before, F.col("source").eqNullSafe(F.col("source_")) & (F.col("part") == F.col("part_")))
            .withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
            .select("doc_id", "idx", "size", "start", *self.number)
        )
        size_of = np.array(blocks or [1], np.int64)

        @F.pandas_udf("long")
        def block_of(idx: pd.Series, slot: pd.Series) -> pd.Series:
            i, j = idx.to_numpy(np.int64), slot.to_numpy(np.int64)
            n = size_of[i]
            key = mix((i * 1_000_003 + j // n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
            return pd.Series(permuted(j % n, n, key))

        # the driver holds a line for each source of each of SHARDS shards, whatever the number of words
        per_shard = max(shard_slots, -(-sum(self.counts) // SHARDS))
        shards = spark.createDataFrame(list(draw(self.counts, per_shard, seed)), "shard long, idx int, first long, n long")
        runs = shards.select("shard", "idx", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN_SLOTS))).alias("run"))
        runs = runs.select("shard", "idx", (F.col("first") + F.col("run") * RUN_SLOTS).alias("low"), (F.col("first") + F.least(F.col("n"), (F.col("run") + 1) * RUN_SLOTS) - 1).alias("high"))
        self.slots = runs.repartition("shard", "low").select("shard", "idx", F.explode(F.sequence("low", "high")).alias("slot")).withColumn("block", block_of("idx", "slot"))

    def pieces(self) -> DataFrame:
        times = self.slots.groupBy("idx", "block").agg(F.count("*").alias("times"))
        b = self.block
        parts = (
            self.rows.where("size > 0")
            .select("*", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block"))
            .withColumn("from", F.greatest(F.col("start"), F.col("block") * b))
            .withColumn("to", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b))
        )
        # a merge: times grows with the words, and its size is not known before it is made
        return parts.join(times.hint("merge"), ["idx", "block"], "left").select("doc_id", "idx", "size", "start", *self.number, "block", "from", "to", F.coalesce("times", F.lit(0)).alias("times"))

    def taken(self) -> DataFrame:
        """doc_id, idx, size, start, taken."""
        some = self.pieces().groupBy("doc_id", "idx", "size", "start").agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken"))
        return some.unionByName(self.rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def shares(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    Null texts have no words and take none; a null source is a source, the last one; a null doc_id sorts first in its
    source; repeated rows each count; very long texts spread over as many blocks as they fill. An empty table gives none. A
    source without words has target 0. Columns other than these three, whatever their names, are ignored.
    """
    made = Mix(docs, **options)
    return made.taken().join(made.sources, "idx").select("doc_id", "size", "source_size", "target", F.col("taken").cast("long"))


def remix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a row's text is the words taken, blank-separated, those taken twice after the others.

    Same columns; n_chars counts the new text; documents of which nothing is taken go. A document that is taken once as a
    whole keeps its text. A row takes its own words, whatever other rows have its doc_id or none. Texts without words stay
    as they are.
    """
    rows = numbered(docs)
    made = Mix(rows.select("row.doc_id", "row.text", "row.source", "number"), **options, number="number")
    parts = made.pieces().groupBy("number").agg(F.sort_array(F.collect_list(F.struct(F.col("from") - F.col("start"), F.col("to") - F.col("start"), "times"))).alias("parts_"))

    @F.pandas_udf("string")
    def take(texts: pd.Series, parts: pd.Series) -> pd.Series:
        import re

        out = []
        for text, runs in zip(texts, parts, strict=True):
            if runs is None:  # no words; a udf sees all rows
                out.append(text)
                continue
            runs = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in runs]
            if all(r[2] == 1 for r in runs):
                out.append(text)
                continue
            spans = [m.span() for m in re.finditer(WORD, text)]
            got = []
            for copy in range(max(r[2] for r in runs)):
                for a, b, times in runs:
                    if times > copy:
                        got.append(text[spans[a][0] : spans[b - 1][1]])
            out.append(" ".join(got) if got else None)
        return pd.Series(out, dtype=object)

    joined = rows.join(parts, "number", "left")
    made = joined.withColumn("text_", F.when(F.col("parts_").isNull(), F.col("row.text")).otherwise(take(F.col("row.text"), F.col("parts_"))))
    kept = made.where(F.col("parts_").isNull() | F.col("text_").isNotNull())
    new = {"text": F.col("text_")} | ({"n_chars": F.length("text_").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return kept.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents"))
