"""Substring dedup by sliding sentence spans: a sentence goes if a run of sentences that covers it stood somewhere before.

From every sentence a span runs forward, and one backward, over RUN sentences and on until it has WORDS words; a sentence
of LONE words is a span by itself. A run of sentences that recurs is covered by the spans inside it, however short its
sentences are. Spans are hashed; the first place of each hash comes out of one aggregate with partial sums, so a span that
stands in a third of all documents is a row a task, and the hashes that recur are joined back to the spans (the only place
where a hash has all its rows, in a join whose large partitions Spark splits).

A text is cut into sentences without loss, each with the blanks and marks behind it, and put together again from those
that stay: what isn't removed stays as it is, byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfaceloom.llm.common import byte_words, joined_bytes, lean, mix, settle, table, text_key, text_slices
from surfaceloom.llm.shingles import _BLANK, interval_hashes, powers

#: A sentence as a pattern: blanks, all before a mark or line feed, and what of marks and blanks follows it.
BLANK = r"\x20\x09-\x0D"
SENTENCE, WORD = rf"[{BLANK}]*[^.!?\n]*(?:[.!?\n][.!?{BLANK}]*)?", rf"[^{BLANK}]+"
#: Sentences of a span, the words that it grows to (0: every run of RUN sentences), and the words of a sentence that is a
#: span by itself (0: none is).
RUN, WORDS, LONE = 2, 12, 40
_BYTES = byte_words(17), byte_words(19)


class Sentences(NamedTuple):
    """The sentences of some texts: bytes, where each begins (one more for the end), words before it, and each text's
    first sentence (one more for the end)."""

    raw: np.ndarray
    begin: np.ndarray
    words: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, text: pa.Array) -> Sentences:
        raw, starts = joined_bytes(text)
        none = np.zeros(1, np.int64)
        if not len(raw):
            return cls(raw, none, none, np.zeros(len(starts), np.int64))
        blank, mark = _BLANK[raw], (raw == 46) | (raw == 33) | (raw == 63)
        between = blank | mark
        edge = np.zeros(len(raw) + 1, bool)
        edge[starts] = True
        low = np.flatnonzero(between & (edge[:-1] | ~np.append(False, between[:-1])))
        high = np.flatnonzero(between & (edge[1:] | ~np.append(between[1:], False))) + 1
        # a run of marks and blanks ends a sentence if it has a mark or a line feed; at a text's start, only with a mark
        marks, feeds = (np.append(0, np.cumsum(x)) for x in (mark, raw == 10))
        ends = (marks[high] > marks[low]) | ((feeds[high] > feeds[low]) & ~edge[low])
        start = edge[:-1].copy()
        start[high[ends & (high < len(raw))]] = True
        begin = np.append(np.flatnonzero(start), len(raw))
        word = ~blank & (start | np.append(True, blank[:-1]))
        words = np.append(0, np.cumsum(word))[begin]
        return cls(raw, begin, words, np.searchsorted(begin, starts))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each sentence without the blanks around it."""
        full = np.flatnonzero(~_BLANK[self.raw])
        at = np.searchsorted(full, self.begin)
        some = np.flatnonzero(at[1:] > at[:-1])
        out = []
        for words in _BYTES:
            key = np.zeros(len(self.begin) - 1, np.uint64)
            key[some] = interval_hashes(self.raw, full[at[some]], full[at[some + 1] - 1] + 1, words)
            out.append(key)
        return out[0], out[1]

    def spans(self, words: int, lone: int) -> tuple[np.ndarray, ...]:
        """text, number of the first sentence in it, sentences, and the two hashes of each span."""
        n = len(self.begin) - 1
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        i = np.arange(n)
        ahead = np.maximum(np.searchsorted(self.words, self.words[:-1] + words), i + RUN)
        behind = np.minimum(np.searchsorted(self.words, self.words[1:] - words, "right") - 1, i + 1 - RUN)
        f = np.flatnonzero(ahead <= self.first[text + 1])
        b = np.flatnonzero(behind >= self.first[text])
        alone = np.flatnonzero(np.diff(self.words) >= lone) if lone else i[:0]
        both = np.unique(np.concatenate([i[f] << 32 | (ahead[f] - i[f]), behind[b] << 32 | (i[b] + 1 - behind[b]), alone << 32 | 1]))
        start, size = both >> 32, both & 0xFFFFFFFF
        up, down = powers(n + 1)
        hashes = []
        for key in self.keys():
            sums = np.append(np.uint64(0), np.cumsum(key * up[:-1], dtype=np.uint64))
            hashes.append(mix((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64)).view(np.int64))
        return text[start], start - self.first[text[start]], size, *hashes


def spans(docs: DataFrame, words: int = WORDS, lone: int = LONE) -> DataFrame:
    """doc, own (text_key()), at (number of the first sentence), n (sentences), and the span's hash as two numbers.

    docs: doc_id, text; doc is doc_id, the smallest number for null.
    """

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                text, at, n, h1, h2 = Sentences.of(part.column("text")).spans(words, lone)
                doc, own = (part.column(c).to_numpy()[text] for c in ("doc", "own"))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(own), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h1), pa.array(h2)], ["doc", "own", "at", "n", "h1", "h2"])

    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), text_key().alias("own"), "text").where("text <> ''")
    return keyed.mapInArrow(run, "doc long, own long, at int, n int, h1 long, h2 long")


def covered(docs: DataFrame, words: int = WORDS, lone: int = LONE) -> DataFrame:
    """doc, own and gone: the numbers of the sentences that a span covers which isn't the first of its kind."""
    place = F.struct("doc", "own", "at")
    found = spans(docs, words, lone)
    again = settle(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1").select("h1", "h2", "first"), "spans")
    later = found.join(again, ["h1", "h2"]).where(F.col("first") != place)
    # a document's own sentences: as many as it has
    return later.groupBy("doc", "own").agg(F.collect_set(F.struct("at", "n")).alias("gone"))


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            found = Sentences.of(part.column("text"))
            blank = np.append(0, np.cumsum(~_BLANK[found.raw]))
            raw = found.raw.tobytes()
            total, removed, kept = [], [], []
            for i, spans_ in enumerate(part.column("gone").to_pylist()):
                a, b = int(found.first[i]), int(found.first[i + 1])
                low, high = int(found.begin[a]), int(found.begin[b])
                total.append(b - a if blank[high] > blank[low] else 0)
                gone = np.zeros(b - a + 1, np.int64)
                for s in spans_ or ():
                    gone[s["at"]] += 1
                    gone[s["at"] + s["n"]] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                removed.append(int(gone.sum()))
                if not removed[-1]:
                    kept.append(raw[low:high])
                    continue
                first = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
                kept.append(b"".join(raw[found.begin[a + x] : found.begin[a + y]] for x, y in zip(first[::2], first[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_sentences", "n_removed", "kept"])


def dedup(docs: DataFrame, words: int = WORDS, lone: int = LONE) -> DataFrame:
    """doc_id, n_sentences, n_removed and kept (the text without the sentences that go) for each row of docs.

    The first place of a span is that of the smallest doc_id, then of the first sentence. Null and empty texts, and texts
    of blanks, have no sentences; a null doc_id comes first; texts with one doc_id, or without any, are documents of their
    own, in the order of a hash; repeated rows count as one document; very long texts are taken as a whole; an empty table
    gives none. Other columns, whatever their names, are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = covered(docs, words, lone)
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), text_key().alias("own"))
    return keyed.join(gone, ["doc", "own"], "left").select("doc_id", "text", "gone").mapInArrow(lean(_cut), "doc_id long, n_sentences long, n_removed long, kept string")


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_extract_all(coalesce(text, ''), '{SENTENCE}'), lambda x: x <> '') AS p FROM documents
), keyed AS (
  SELECT doc_id, list_transform(p, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS s FROM docs
), counted AS (
  SELECT doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, '{WORD}'))) AS c FROM keyed
), rows AS (
  SELECT doc_id, unnest(range(0, len(s))) AS pos, s, c FROM counted
), grown AS (
  SELECT *, list_filter(range({RUN}, {RUN + WORDS + 50}), lambda n: pos + n <= len(c) AND list_sum(c[pos + 1:pos + n]) >= {WORDS})[1] AS f,
    list_filter(range({RUN}, {RUN + WORDS + 50}), lambda n: pos + 1 - n >= 0 AND list_sum(c[pos + 2 - n:pos + 1]) >= {WORDS})[1] AS b
  FROM rows
), spans AS (
  SELECT DISTINCT doc_id, pos, f AS n, s[pos + 1:pos + f] AS k FROM grown WHERE f IS NOT NULL
  UNION SELECT doc_id, pos + 1 - b, b, s[pos + 2 - b:pos + 1] FROM grown WHERE b IS NOT NULL
  UNION SELECT doc_id, pos, 1, s[pos + 1:pos + 1] FROM grown WHERE c[pos + 1] >= {LONE}
), later AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS place FROM spans
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM later WHERE place > 1
), lists AS (
  SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, t, p, s, coalesce(gone, []) AS gone FROM docs JOIN keyed USING (doc_id) LEFT JOIN lists USING (doc_id)
)
SELECT doc_id, CASE WHEN s = [''] THEN 0 ELSE len(s) END::BIGINT AS n_sentences, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(p, lambda x, i: NOT list_contains(gone, i - 1)), ''), '')) AS kept_sha256
FROM kept
"""
