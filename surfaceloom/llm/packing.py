"""Packing: documents become fixed-length training sequences by dynamic programming that keeps their order.

Cuts may stand after a document, after a sentence, or (dearest) every few tokens inside a long sentence. A window from
cut i to cut j costs its padding, a fixed price for each sequence and the price of truncating at j. As padding is
`size - (j - i)`, the best i for every j is the smallest `cost[i] + i` among cuts within `size` tokens, which a monotone
queue hands out in constant time; the windows that need no padding at a power of two are tried one by one.

Each input partition is a stream of its own and one plan: nothing is shuffled. The plan goes on from batch to batch; what
all its possible continuations have in common is dealt out and forgotten, so a task holds about HORIZON tokens and the
cuts are those that a plan of the whole stream makes. A task that is run again deals the same sequences (a sequence's
number is the partition's number and a running one).
"""

from __future__ import annotations

import base64
import functools
import heapq
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfaceloom.llm.common import lean, ready, table, text_slices

SIZE = 1024
#: Prices in tokens of padding: for a sequence, and for a cut after a document, after a sentence and inside one.
SEQUENCE, AFTER = 16, {"document": 0, "sentence": 4, "inside": 24}
#: Inside a sentence cuts may stand this many tokens apart.
STEP = 32
#: A stream that holds so many tokens looks for what it can deal out.
HORIZON = 1 << 16
END = 0

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts by the public byte-level vocabulary, as the tokenizers library gives them for it.

    They come from the same vocabulary's rank file, whose library is faster, holds less memory and takes special tokens'
    strings for ordinary text; tests hold it against tokenizers.
    """

    def __init__(self, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.tokens = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ends, self.opens = (np.zeros(max(ranks.values()) + 1, bool) for _ in range(2))
        for word, rank in ranks.items():
            self.ends[rank] = word[-1:] in (b".", b"!", b"?", b"\n")
            self.opens[rank] = word[:1] in (b" ", b"\n")

    def encode(self, text: str | None) -> np.ndarray:
        """A text's ids and, behind them, the end id."""
        return np.array([*self.tokens.encode_ordinary(text or ""), END], "<u4")


@functools.lru_cache(maxsize=1)
def encoder(ranks_path: str | None = None) -> Encoder:
    """One for each worker."""
    return Encoder(ranks_path)


class Plan:
    """The cheapest windows over a row of cuts that goes on and on.

    Cuts rise, none stands more than `size` after the one before. Ties go to the earlier start, which only a window that
    ends in a power of two can beat.
    """

    def __init__(self, size: int = SIZE):
        self.size, self.powers = size, [1 << k for k in range(5, size.bit_length()) if 1 << k < size]
        self.at, self.cost, self.back = [0], [0], [0]
        self.queue = deque([0])

    def extend(self, cuts: np.ndarray, prices: np.ndarray) -> None:
        """Takes more cuts and the price of truncating at each."""
        size, at, cost, back, queue = self.size, self.at, self.cost, self.back, self.queue
        base = len(at)
        low = base
        while low and at[low - 1] >= at[-1] - size:
            low -= 1
        near = np.concatenate([np.array(at[low:], np.int64), cuts])
        starts, ends = [], []  # windows that are a power of two long
        for p in self.powers:
            where = np.searchsorted(near, cuts - p)
            hit = np.flatnonzero((near[np.minimum(where, len(near) - 1)] == cuts - p) & (where < len(near)))
            starts.append(where[hit] + low)
            ends.append(hit + base)
        order = np.argsort(np.concatenate(ends), kind="stable")
        starts, ends = np.concatenate(starts)[order].tolist(), [*np.concatenate(ends)[order].tolist(), -1]
        k, j = 0, base
        for c, price in zip(cuts.tolist(), prices.tolist(), strict=True):
            while c - at[queue[0]] > size:
                queue.popleft()
            front = queue[0]
            length = c - at[front]
            best = cost[front] + (size - length if length & (length - 1) else 0)
            while ends[k] == j:
                i = starts[k]
                k += 1
                if cost[i] < best:
                    best, front = cost[i], i
            best += SEQUENCE + price
            at.append(c)
            cost.append(best)
            back.append(front)
            key = best + c
            while queue and cost[queue[-1]] + at[queue[-1]] > key:
                queue.pop()
            queue.append(j)
            j += 1

    def _to(self, j: int) -> list[int]:
        found = []
        while j:
            found.append(self.at[j])
            j = self.back[j]
        return found[::-1]

    def settled(self) -> list[int]:
        """The cuts that every continuation has in common; the plan goes on from the last of them."""
        n = len(self.at)
        low = n - 1
        while low and self.at[low - 1] > self.at[-1] - self.size:
            low -= 1
        # ancestors of all places that a later window may start at, until they are one
        live = [-i for i in range(low, n)]
        heapq.heapify(live)
        seen = set(range(low, n))
        while len(live) > 1:
            i = self.back[-heapq.heappop(live)]
            if i not in seen:
                seen.add(i)
                heapq.heappush(live, -i)
        root = -live[0]
        found = self._to(root)
        spent = self.cost[root]
        self.at, self.back = self.at[root:], [0, *(i - root for i in self.back[root + 1 :])]
        self.cost = [c - spent for c in self.cost[root:]]
        # of what stands before the root nothing can be a start any more
        self.queue = deque(i - root for i in self.queue if i >= root)
        return found

    def finish(self) -> list[int]:
        """The rest; the last cut is always made."""
        return self._to(len(self.at) - 1)


class Stream:
    """Documents in, pieces of sequences out."""

    def __init__(self, encoder: Encoder, partition: int, size: int):
        self.encoder, self.size, self.plan = encoder, size, Plan(size)
        self.next = partition << 40
        self.docs: deque[tuple] = deque()  # (doc_id, where it begins in the stream, ids)
        self.end = self.dealt = 0
        self.patience = HORIZON

    def add(self, docs: list[tuple[int | None, np.ndarray]]) -> Iterator[tuple]:
        if not docs:
            return
        ids = np.concatenate([x for _, x in docs])
        price = np.full(len(ids) + 1, -1, np.int64)
        sentence = self.encoder.ends[ids]
        sentence[:-1] &= self.encoder.opens[ids[1:]]
        price[1:][sentence] = AFTER["sentence"]
        price[np.cumsum([len(x) for _, x in docs])] = AFTER["document"]
        price[0] = 0
        at = np.flatnonzero(price >= 0)
        gaps = np.diff(at)
        wide = np.flatnonzero(gaps > STEP)
        if len(wide):
            many = (gaps[wide] - 1) // STEP
            more = np.repeat(at[wide], many) + STEP * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1)
            price[more] = AFTER["inside"]
            at = np.flatnonzero(price >= 0)
        self.plan.extend(at[1:] + self.end, price[at[1:]])
        for doc_id, x in docs:
            self.docs.append((doc_id, self.end, x))
            self.end += len(x)
        if self.end - self.dealt > self.patience:
            yield from self.deal(self.plan.settled())
            self.patience = max(HORIZON, 2 * (self.end - self.dealt))

    def close(self) -> Iterator[tuple]:
        yield from self.deal(self.plan.finish())

    def deal(self, cuts: list[int]) -> Iterator[tuple]:
        """The pieces of the sequences that end at cuts."""
        for to in cuts:
            at = first = self.dealt
            while at < to:
                doc_id, begin, ids = self.docs[0]
                start, stop = at - begin, min(to - begin, len(ids))
                yield doc_id, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), len(ids), self.next, at - first
                at = begin + stop
                if stop == len(ids):
                    self.docs.popleft()
            self.dealt = to
            self.next += 1


def pack(docs: DataFrame, size: int = SIZE, ranks_path: str | None = None) -> DataFrame:
    """Every document's ids, ended by id 0, cut into pieces of sequences of at most `size` tokens (a power of two).

    docs: doc_id (long), text. Returns SCHEMA, one row per piece; a sequence is the pieces with its sequence_id by
    offset. Null and empty texts have their end id alone; a null doc_id is kept as it is; repeated rows are packed as
    often as they occur; very long texts are cut like any other; an empty table gives none. Other columns, whatever their
    names, are ignored.
    """
    ready(docs.sparkSession)

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stream = Stream(encoder(ranks_path), TaskContext.get().partitionId(), size)
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            for part in text_slices(batch):
                texts = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                if rows := list(stream.add([(doc_id, stream.encoder.encode(text)) for doc_id, text in texts])):
                    yield made(rows)
        if rows := list(stream.close()):
            yield made(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
