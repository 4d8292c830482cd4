"""Substring dedup: every byte in a string of LENGTH bytes that also starts earlier goes; a logarithmic index family finds it.

Anchors. Of a window of LENGTH bytes the smallest hash among its strings of SEED bytes is its anchor, so equal windows have
equal anchors. Neighbouring windows with one anchor are a run, and the bytes that they cover its stretch: at most
2 LENGTH bytes, some 25 windows as a rule. A suffix array of all bytes is thereby thinned out to the suffixes at runs, and
a suffix to the fingerprint of its stretch.

The family. Documents come in batches. A batch's thinned suffixes are sorted and merge-scanned with the levels of what came
before, in one pass over sorted rows that remembers two of them: a stretch that is known is removed as a whole, the first
of its kind goes into a new level, and if different stretches share an anchor, their windows are compared one by one.
Levels are sorted tables in the shared folder; levels of about equal size merge, so there are logarithmically many.

Rows are in proportion to the text however often a passage recurs, and no pairs are made. Windows of an anchor that few
stretches share are compared in memory, an anchor at a time; of the others each window is a row of a sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfaceloom.llm.common import SLICE_BYTES, byte_words, lean, mix, settle, table, text_key, text_slices
from surfaceloom.llm.shingles import powers

LENGTH, SEED = 100, 32
#: Bytes of a very long text that are looked at together (less than 2**24), stretches that are compared together, and
#: stretches of an anchor above which its windows are sorted by Spark.
PART, SOME, HOT = 1 << 19, 1 << 12, 1 << 12
_WORDS = byte_words(11)
_NONE = -(1 << 63)
class Hashes:
    """Fingerprints of any substrings of some bytes."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_WORDS[raw] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice, salt: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + np.asarray(salt, np.uint64))


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts that begin at starts (one more for the end): text, first window, windows, anchor, fingerprint, and
    whether a window may recur within the run itself."""
    width = LENGTH - SEED + 1
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    hashes = Hashes(raw)
    n = len(raw) - SEED + 1
    seeds = hashes.of(slice(0, n), slice(SEED, SEED + n), 1)
    at = (smallest((seeds & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64), width) & np.uint64(0xFFFFFF)).astype(np.int64)
    anchor = seeds[at]
    size = np.diff(starts)
    text = np.repeat(np.arange(len(size)), np.maximum(0, size - LENGTH + 1))
    if not len(text):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    before = np.concatenate([[0], np.cumsum(np.maximum(0, size - LENGTH + 1))])
    window = np.arange(len(text)) - before[text] + starts[text]
    mine = anchor[window]
    first = np.flatnonzero(np.append(True, (mine[1:] != mine[:-1]) | (text[1:] != text[:-1])))
    length = np.diff(np.append(first, len(text)))
    cuts = -(-length // width)  # where a run of one anchor is longer than any window's choice, as in repeated bytes
    part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    low = np.repeat(first, cuts) + part * width
    length = np.minimum(width, np.repeat(length, cuts) - part * width)
    a, b = window[low], window[low + length - 1]
    return text[low], a - starts[text[low]], length, anchor[a], hashes.of(a, b + LENGTH, length.astype(np.uint64) + np.uint64(2)), at[a] != at[b]


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, offset in its text, bytes, starts): some texts, or overlapping parts of a long one, at a time."""
    raw: list[bytes] = []
    at: list[tuple[int, int]] = []

    def flush():
        starts = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) for x in raw], out=starts[1:])
        out = np.array([r for r, _ in at]), np.array([o for _, o in at]), np.frombuffer(b"".join(raw), np.uint8), starts
        raw.clear()
        at.clear()
        return out

    held = 0
    for row, text in enumerate(batch.column("text").cast(pa.binary())):
        text = text.as_py() or b""
        for offset in range(0, max(1, len(text) - LENGTH + 1), PART):
            raw.append(text[offset : offset + PART + LENGTH - 1])
            at.append((row, offset))
            held += len(raw[-1])
            if held > SLICE_BYTES:
                yield flush()
                held = 0
    if raw:
        yield flush()


@lean
def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, own = batch.column("doc").to_numpy(), batch.column("own").to_numpy()
        for row, offset, raw, starts in texts_of(batch):
            text, first, length, anchor, mark, again = runs(raw, starts)
            if len(text):
                at = (first + offset[text]) << 8 | length << 1 | again
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor.view(np.int64), mark.view(np.int64), doc[row[text]], own[row[text]], at)], ["anchor", "mark", "doc", "own", "at"])


#: The places of a key in the order of arrival.
PLACE = ("batch", "doc", "own", "at")
#: What a scan says of a row: its stretch is known, its windows have to be compared, or it is the first of its kind.
KNOWN, ASKED, FIRST = range(3)


def _scan(current: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The merge scan: rows of a batch and of the levels, sorted by anchor, mark and PLACE."""
    names = ["anchor", "mark", *PLACE]

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * len(names)  # of the last anchor the first key's and the last key's first row
        sent = np.zeros(0, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(sent)
            rows = [np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, names, strict=True)]
            sent = np.append(sent, np.zeros(batch.num_rows, bool))
            anchor, mark, number, *_, at = rows
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (mark[1:] != mark[:-1]))
            head = np.flatnonzero(new)
            first = head[np.cumsum(new) - 1]
            # a place that comes twice is a repeated row, not a repetition
            known = np.flatnonzero(~new & (number == current) & np.logical_or.reduce([c != c[first] for c in rows[2:]]))
            group = np.cumsum(np.append(True, anchor[head[1:]] != anchor[head[:-1]])) - 1
            ask = ((np.bincount(group) > 1)[group] | (at[head] & 1 == 1)) & ~sent[head]
            fresh = head[(head >= old) & (number[head] == current)]
            take = np.concatenate([known, head[ask], fresh])
            kind = np.repeat(np.array([KNOWN, ASKED, FIRST], np.int32), [len(known), ask.sum(), len(fresh)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(c[take]) for c in rows)], ["kind", *names])
            sent[head[ask]] = True
            keep = np.unique([head[np.searchsorted(group, group[-1])], head[-1]])
            held, sent = [c[keep] for c in rows], sent[keep]

    return run


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for."""
    names = ["anchor", "hot", "batch", "doc", "own", "at"]
    for batch in batches:
        for part in text_slices(batch):
            out: tuple[list, ...] = tuple([] for _ in range(7))
            for doc, own, text, asked in zip(part.column("doc").to_pylist(), part.column("own").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), part.column("asked").to_pylist(), strict=True):
                for r in asked:
                    start, length = r["at"] >> 8, (r["at"] & 255) >> 1
                    for col, x in zip(out, (r["anchor"], r["hot"], r["batch"], doc, own, r["at"], text[start : start + length - 1 + LENGTH]), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary()), strict=True)], [*names, "bytes"])


def _windows(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of the stretches: the row, its place in the text, and its fingerprint, told apart by anchors."""
    raw = rows.column("bytes").to_pylist()
    starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    count = np.diff(starts) - LENGTH + 1
    row = np.repeat(np.arange(len(raw)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = starts[row] + place
    anchor = rows.column("anchor").to_numpy()[row].view(np.uint64)
    key = mix(anchor ^ mix(Hashes(np.frombuffer(b"".join(raw), np.uint8)).of(begin, begin + LENGTH, 3)))
    return row, (rows.column("at").to_numpy()[row] >> 8) + place, key


def _compare(current: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Known windows of the current batch's stretches, as runs; rows by anchor and PLACE."""

    def known(rows: pa.Table) -> pa.RecordBatch:
        number, doc, own = (rows.column(c).to_numpy() for c in PLACE[:3])
        row, place, key = _windows(rows)
        order = np.argsort(key, kind="stable")  # the places of a key rise, as rows do
        new = np.append(True, key[order[1:]] != key[order[:-1]])
        first = np.empty(len(key), np.int64)
        first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        a, b = row, row[first]
        other = (number[a] != number[b]) | (doc[a] != doc[b]) | (own[a] != own[b]) | (place != place[first])
        hit = np.flatnonzero(other & (number[a] == current))
        start = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]]))) if len(hit) else hit
        length = np.diff(np.append(start, len(hit)))
        low = hit[start]
        return pa.RecordBatch.from_arrays([pa.array(doc[row[low]]), pa.array(own[row[low]]), pa.array(place[low] << 8 | length << 1)], ["doc", "own", "at"])

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, SOME):
                part = pa.Table.from_batches([batch.slice(start, SOME)])
                held = part if held is None else pa.concat_tables([held, part])
                if held.num_rows >= SOME:
                    anchor = held.column("anchor").to_numpy()
                    whole = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                    if whole:
                        yield known(held.slice(0, whole))
                        held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield known(held)

    return run


@lean
def _each_window(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SOME):
            rows = pa.Table.from_batches([batch.slice(start, SOME)])
            row, place, key = _windows(rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(rows.column(c).to_numpy()[row]) for c in PLACE[:3]), pa.array(place)], ["key", *PLACE])


class Family:
    """The levels, and what is asked of them: add() takes batches in the order of arrival.

    Levels hold the thinned suffixes that are the first of their kind (anchor, mark, PLACE). texts_of_earlier batches are
    kept as they were given, as an earlier stretch is looked up again when another one shares its anchor.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.texts: DataFrame | None = None
        self.batches = 0

    def add(self, keyed: DataFrame, last: bool = False) -> DataFrame:
        """doc, own and at of the batch's known windows: runs, each start << 8 | windows << 1.

        keyed: doc, own, text. If it is the last batch, no level is made of it.
        """
        current, self.batches = self.batches, self.batches + 1
        self.texts = keyed if self.texts is None else self.texts.unionAll(keyed)
        order = ("anchor", "mark", *PLACE)
        found = keyed.mapInArrow(_runs, "anchor long, mark long, doc long, own long, at long").select("anchor", "mark", F.lit(current).cast("long").alias("batch"), "doc", "own", "at")
        for _, level in self.levels:
            found = found.unionAll(level)
        scanned = found.repartition("anchor").sortWithinPartitions(*order).mapInArrow(_scan(current), "kind int, " + ", ".join(f"{c} long" for c in order))
        decided = settle(scanned.where(F.col("kind") != FIRST) if last else scanned, "suffixes")
        if not last:
            self._grow(decided.where(F.col("kind") == FIRST).select(*order))
        asked = decided.where(F.col("kind") == ASKED)
        hot = asked.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot"))
        asked = asked.join(hot, "anchor", "left").groupBy("doc", "own").agg(F.collect_list(F.struct("anchor", "batch", "at", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("asked"))  # a document's own runs
        pieces = settle(self.texts.join(asked, ["doc", "own"]).select("doc", "own", "text", "asked").mapInArrow(lean(_stretches), "anchor long, hot boolean, batch long, doc long, own long, at long, bytes binary"), "stretches")
        few = pieces.where(~F.col("hot")).repartition("anchor").sortWithinPartitions("anchor", *PLACE).mapInArrow(_compare(current), "doc long, own long, at long")
        # the windows of the other anchors by one aggregate each, which adds up in parts
        places = pieces.where("hot").mapInArrow(_each_window, "key long, " + ", ".join(f"{c} long" for c in PLACE))
        firsts = places.groupBy("key").agg(F.min(F.struct(*PLACE)).alias("first"))
        many = places.join(firsts, "key").where((F.col("batch") == current) & (F.struct(*PLACE) != F.col("first"))).select("doc", "own", F.shiftleft("at", 8).bitwiseOR(F.lit(2)).alias("at"))
        return decided.where(F.col("kind") == KNOWN).select("doc", "own", "at").unionAll(few).unionAll(many)

    def _grow(self, first: DataFrame) -> None:
        """A new level; those of about equal size become one."""
        self.levels.append((first.count(), first))
        while len(self.levels) > 1 and self.levels[-2][0] < 2 * self.levels[-1][0]:
            (m, a), (n, b) = self.levels.pop(-2), self.levels.pop()
            merged = settle(a.unionAll(b).repartition("anchor").sortWithinPartitions("anchor", "mark", *PLACE), "level")
            self.levels.append((m + n, merged))


@lean
def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in text_slices(whole)):
        out: tuple[list, ...] = ([], [], [], [])
        for text, known in zip(batch.column("text").cast(pa.binary()), batch.column("known"), strict=True):
            raw = np.frombuffer(text.as_py() or b"", np.uint8)
            if known.is_valid and len(known):
                at = known.values.to_numpy()
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, at >> 8, 1)
                np.add.at(edge, (at >> 8) + ((at & 255) >> 1) - 1 + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
            else:
                gone = np.zeros(len(raw), bool)
            kept = raw[~gone].tobytes()
            for col, x in zip(out, (len(raw), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()), strict=True):
                col.append(x)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc (doc_id; null is -2**63), own (text_key()) and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc"), text_key().alias("own"), F.col("text").cast("string").alias("text"))


def repeats(docs: DataFrame, batches: int = 2) -> DataFrame:
    """doc, own and known: runs of windows that also start earlier, each start << 8 | windows << 1. docs goes into the
    family in `batches` parts, by doc_id."""
    rows = keyed(docs)
    bounds = sorted(set(docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02) or ())) if batches > 1 else []
    family, found, low = Family(), None, None
    for high in [*map(int, bounds), None]:
        part = rows if low is None else rows.where(F.col("doc") > low)
        part = part if high is None else part.where(F.col("doc") <= high)
        now = settle(family.add(part, last=high is None), "known")
        found, low = now if found is None else found.unionAll(now), high
    return found.groupBy("doc", "own").agg(F.collect_list("at").alias("known"))


def dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs.

    Earlier is a smaller doc_id, or an earlier start in the same document. Null and empty texts have no bytes; texts
    shorter than LENGTH keep all; a null doc_id comes before all others. Texts with one doc_id, or without any, are
    documents of their own, in the order of a hash; repeated rows count as one document, which does not repeat itself at
    the same place. An empty table gives none. Very long texts are looked at in overlapping parts. Other columns,
    whatever their names, are ignored. The result is the same for any number of batches.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = named.select("doc_id", F.coalesce("doc_id", F.lit(_NONE)).alias("doc"), text_key().alias("own"), "text")
    return rows.join(repeats(named, batches), ["doc", "own"], "left").select("doc_id", "text", "known").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), windows AS (
  SELECT doc_id, p, md5(substr(x, 2 * p + 1, {2 * LENGTH})) AS w FROM (SELECT doc_id, x, unnest(range(0, n - {LENGTH - 1})) AS p FROM docs)
), known AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS place FROM windows) WHERE place > 1
), runs AS (
  SELECT doc_id, p, sum(CASE WHEN p <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) AS before FROM known)
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM runs GROUP BY doc_id, run
), ends AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low, a AS high FROM (
    SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n, n + 1 FROM docs)
), kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * low + 1, 2 * (high - low)), '' ORDER BY high, low) AS k FROM ends JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, (n - strlen(k) // 2)::BIGINT AS n_removed, coalesce(s.c, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM docs JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS c FROM spans GROUP BY doc_id) AS s USING (doc_id)
"""
