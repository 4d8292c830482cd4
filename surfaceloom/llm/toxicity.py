"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel counts the letter triples that two strings share as subsequences, each occurrence weighted by DECAY to the
power of its span (at most SPAN characters), normalised: a letter put between two others weakens a triple a little, in
both the string and its own norm, so a gapped insult stays close to the plain one. What is no letter is a gap.

A sentence is a bag of strings: its words, and its runs of neighbouring words with all that is no letter taken out, which
is how an insult with blanks inside, or one of two words, becomes one string. Labels stand for documents, so their
sentences inherit them, and a bag counts by its worst string (multiple-instance learning): in the sentences of toxic
documents the strings that tell the labels apart are witnesses and examples of label 1, every string of clean sentences
is an example of label 0. The examples are mapped onto landmarks (Nyström), a linear machine is trained there by dual
coordinate ascent, and two rounds add the clean strings that it gets wrong. A logistic curve takes a document's best
two strings and its number of hits to a probability. The sum over landmarks is linear in a string's triples, so
scoring needs one weight for each triple, and the values of all runs of a text come out of running sums.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfaceloom.llm.common import lean, ready, table, text_slices

DECAY, SPAN, WINDOW, STRIDE = 0.7, 9, 24, 12
LETTERS = 26
#: A run of words: letters and words at most.
RUN_LETTERS, RUN_WORDS = 14, 7
#: Bounds of the fit: labelled rows, the bytes of their texts in sum (each row's text is taken as a whole or not at all),
#: landmarks of either kind, clean strings of the first round, and wrong ones that a round adds.
FIT_ROWS, FIT_BYTES = 4000, 1 << 25
TOXIC_MARKS, CLEAN_MARKS, CLEAN_STRINGS, WRONG_STRINGS = 48, 80, 3000, 400
#: Words whose values a worker remembers (about 150 bytes each), and triples that are looked at together.
CACHE, ENTRIES = 100_000, 200_000

_CODE = np.full(256, LETTERS, np.uint8)
_CODE[97:123] = np.arange(26)
_CODE[65:91] = np.arange(26)
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){3,}\S(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _combos(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array([c for c in itertools.combinations(range(n), 3) if c[2] - c[0] < SPAN], np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1).astype(np.float64)


class Strings:
    """Sparse triples of strings: row, triple and weight, summed by row and triple, and each row's norm is 1 (or 0)."""

    combos: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(which strings, row of each entry, triple, weight), some strings at a time."""
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            by_length.setdefault(len(s), []).append(i)
        for n, which in by_length.items():
            if n < 3:
                continue
            if n not in cls.combos:
                cls.combos[n] = _combos(n)
            at, weight = cls.combos[n]
            some = max(1, ENTRIES // len(at))
            for a in range(0, len(which), some):
                own = np.array(which[a : a + some])
                codes = _CODE[np.frombuffer("".join([strings[i] for i in own]).encode("latin-1", "replace"), np.uint8)].reshape(len(own), n).astype(np.int32)
                x, y, z = codes[:, at[:, 0]], codes[:, at[:, 1]], codes[:, at[:, 2]]
                ok = (x < LETTERS) & (y < LETTERS) & (z < LETTERS)
                row, col = np.nonzero(ok)
                key = row * LETTERS**3 + ((x * LETTERS + y) * LETTERS + z)[ok]
                if not len(key):
                    continue
                order = np.argsort(key, kind="stable")
                key, w = key[order], weight[col[order]]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                w, key = np.add.reduceat(w, first), key[first]
                row = key // LETTERS**3
                norm = np.sqrt(np.bincount(row, w * w, len(own)))
                yield own, row, key % LETTERS**3, w / norm[row]

    @classmethod
    def dense(cls, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), LETTERS**3), np.float32)
        for own, row, triple, w in cls.of(strings):
            out[own[row], triple] = w
        return out

    @classmethod
    def times(cls, strings: list[str], matrix: np.ndarray) -> np.ndarray:
        """The strings' normalised triples times a vector, or a matrix with a row for each triple."""
        out = np.zeros((len(strings), *matrix.shape[1:]))
        for own, row, triple, w in cls.of(strings):
            if matrix.ndim == 1:
                out[own] = np.bincount(row, w * matrix[triple], len(own))
            else:
                for a in range(0, len(row), 20_000):  # a block holds as many products as there are columns
                    r = row[a : a + 20_000]
                    first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                    out[own[r[first]]] += np.add.reduceat(w[a : a + 20_000, None] * matrix[triple[a : a + 20_000]], first)
        return out


def windows(token: str) -> list[str]:
    return [token] if len(token) <= WINDOW else [token[i : i + WINDOW] for i in range(0, len(token) - STRIDE, STRIDE)]


def tokens(text: str) -> set[str]:
    """The words of a text, and its runs of single characters joined."""
    found = set(text.split())
    found.update(m[0].replace(" ", "").replace("\t", "") for m in _SPACED.finditer(text))
    return found


@functools.lru_cache(maxsize=1)
def _least_norms() -> np.ndarray:
    """The norm of a string of n letters if none of its triples occurs twice; others are longer."""
    return np.array([np.sqrt((_combos(n)[1] ** 2).sum()) if n > 2 else 1.0 for n in range(RUN_LETTERS + 1)])


class Runs(NamedTuple):
    """The runs of some texts: where each begins and ends in the row of all their letters, and its text."""

    letters: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Runs:
        raw = np.frombuffer("\n".join([*texts, ""]).encode("latin-1", "replace"), np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        stop = (raw == 46) | (raw == 33) | (raw == 63)
        code = _CODE[raw]
        at = np.flatnonzero(code < LETTERS)
        none = np.zeros(0, np.int64)
        if not len(at):
            return cls(code[at].astype(np.int32), none, none, none)
        word = np.cumsum(blank)[at]
        sentence = np.cumsum((raw == 10) | (stop & np.append(blank[1:], True)))[at]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        stops, sentence = np.append(first[1:], len(at)), sentence[first]
        begin, end = [], []
        for more in range(1, RUN_WORDS):
            if more >= len(first):
                break
            a, b = first[:-more], stops[more:]
            ok = (sentence[:-more] == sentence[more:]) & (b - a <= RUN_LETTERS) & (b - a > 2)
            begin.append(a[ok])
            end.append(b[ok])
        begin, end = (np.concatenate(x) if x else none for x in (begin, end))
        bounds = np.cumsum([len(t) + 1 for t in texts])
        return cls(code[at].astype(np.int32), begin, end, np.searchsorted(bounds, at[begin], "right"))

    def bounds(self, triples: np.ndarray) -> np.ndarray:
        """What the normalised value of each run is at most, if it is positive: of every triple each occurrence, summed up."""
        x, n = self.letters, len(self.letters)
        total = np.zeros(len(self.begin))
        far, near = x * LETTERS**2, x * LETTERS
        for span in range(2, SPAN):
            if n <= span:
                break
            sums = np.zeros(n - span + 1)
            value = np.zeros(n - span)
            for middle in range(1, span):
                value += triples[far[: n - span] + near[middle : n - span + middle] + x[span:]]
            np.cumsum(value * DECAY ** (span + 1), out=sums[1:])
            total += sums[np.clip(np.maximum(self.begin, self.end - span), 0, n - span)] - sums[np.minimum(self.begin, n - span)]
        return total / _least_norms()[self.end - self.begin]

    def string(self, i: int) -> str:
        return (self.letters[self.begin[i] : self.end[i]] + 97).astype(np.uint8).tobytes().decode()


class Model(NamedTuple):
    """Weights of triples, bias, and the logistic curve's coefficients; the last is its constant."""

    triples: np.ndarray
    bias: float
    curve: np.ndarray

    def strings(self, found: list[str]) -> np.ndarray:
        """The machine's value of each token: of its best window."""
        parts = [windows(t) for t in found]
        values = Strings.times([w for p in parts for w in p], self.triples) + self.bias
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        return np.maximum.reduceat(values, starts) if len(found) else np.zeros(0)

    def runs(self, texts: list[str], least: float = 0.0) -> list[dict[str, float]]:
        """Of each text the runs with a value above `least`, and these."""
        out: list[dict[str, float]] = [{} for _ in texts]
        found = Runs.of(texts)
        some = np.flatnonzero(found.bounds(self.triples) + self.bias > least)
        named = [found.string(i) for i in some.tolist()]
        distinct = list(dict.fromkeys(named))
        values = dict(zip(distinct, (Strings.times(distinct, self.triples) + self.bias).tolist(), strict=True))
        for i, s in zip(found.text[some].tolist(), named, strict=True):
            if values[s] > least:
                out[i][s] = values[s]
        return out

    def features(self, values: list[float], runs: dict[str, float]) -> list[float]:
        """Of a text's words and of its runs with a positive value: a run counts like a word."""
        top = sorted([*values, *runs.values()], reverse=True)[:2]
        top = [max(-1.0, v) for v in [*top, -1.0, -1.0]]
        return [top[0], top[1], np.log1p(sum(v > 0 for v in values) + len(runs)), 1.0]

    def probability(self, rows: list[list[float]]) -> np.ndarray:
        z = np.array(rows).reshape(-1, len(self.curve)) @ self.curve
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 4.0, rounds: int = 12) -> np.ndarray:
    """A linear support vector machine (hinge loss, no bias) by dual coordinate ascent; weight scales a row's cost."""
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1) + 1e-12
    rng = np.random.default_rng(1)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0), cost * weight[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def _letters(word: str) -> str:
    return re.sub("[^a-z]", "", word.lower())


def fit(rows: list[tuple[str, int]]) -> Model:
    """rows: text and label. Without both labels, or without telling words, the base rate is all that is learnt."""
    one: dict[str, str] = {}  # equal words are one object
    sentences = [(label, [tuple(one.setdefault(t, t) for t in tokens(s)) for s in _SENTENCE.split(text)]) for text, label in rows]
    toxic = sum(label for label, _ in sentences)
    rate = (toxic + 0.5) / (len(rows) + 1) if rows else 0.01
    flat = Model(np.zeros(LETTERS**3), -1.0, np.array([0, 0, 0, np.log(rate / (1 - rate))]))
    fold = functools.lru_cache(1 << 16)(_letters)
    seen, copies, single = {0: Counter(), 1: Counter()}, set(), []
    for (text, label), (_, found) in zip(rows, sentences, strict=True):
        all_, row = {fold(t) for s in found for t in s}, text.split()
        # of near copies, which share their smallest hash of three words as a rule, one is counted
        if (mark := (label, min((zlib.crc32(" ".join(x).encode()) for x in zip(row, row[1:], row[2:])), default=0))) not in copies:
            copies.add(mark)
            seen[label].update(all_)
            single.append((text, label))
    toxic, clean_ = (sum(m[0] == label for m in copies) for label in (1, 0))
    odds = {t: np.log((n + 0.5) / (toxic + 1)) - np.log((seen[0][t] + 0.5) / (clean_ + 1)) for t, n in seen[1].items() if len(t) >= 3 and n >= 3}
    # twenty times likelier in a toxic document, also if it had come a standard deviation less often
    telling = lambda t: odds[t] + np.log(1 - seen[1][t] ** -0.5) > 3 or (odds[t] > 3 and seen[1][t] >= 5 and seen[0][t] == 0)
    witness = {t for t in odds if telling(t)}
    both = _pairs(single, witness, fold)
    seen[0].update(both[0])
    seen[1].update(both[1])
    odds = {t: np.log((n + 0.5) / (toxic + 1)) - np.log((seen[0][t] + 0.5) / (clean_ + 1)) for t, n in both[1].items() if t not in odds}
    pairs = {t for t in odds if telling(t)}
    if not witness | pairs:
        return flat
    good = Counter(t for label, found in sentences if label for s in found for t in {fold(t) for t in s} & witness) + Counter({t: seen[1][t] for t in pairs})
    bad = Counter(t for label, found in sentences if not label for s in found for t in {fold(t) for t in s} - witness if len(t) >= 3)
    marked = [t for t, _ in sorted(good.items(), key=lambda x: (-x[1], x[0]))][:TOXIC_MARKS]
    pool = list(dict.fromkeys(w for t, _ in sorted(bad.items(), key=lambda x: (-x[1], x[0])) for w in windows(t)))
    if not pool:
        return flat
    rng = np.random.default_rng(2)
    clean = [pool[i] for i in sorted(rng.choice(len(pool), min(len(pool), CLEAN_STRINGS), replace=False))]
    marks = [*marked, *(clean[i] for i in sorted(rng.choice(len(clean), min(len(clean), CLEAN_MARKS), replace=False)))]
    basis = Strings.dense(marks)
    value, vector = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    keep = value > 1e-4
    to_features = vector[:, keep] / np.sqrt(value[keep])  # Nyström: k(x, marks) times this
    mapped = lambda s: np.c_[Strings.times(s, basis.T.astype(np.float64)) @ to_features, np.ones(len(s))]
    positives = sorted(good)
    gapped = [c.join(t) for t in positives for c in ".*"]  # the same with inserted characters
    model = flat
    for again in (True, True, False):
        x = mapped([*positives, *gapped, "", *clean])
        y = np.r_[np.ones(len(positives) + len(gapped)), -np.ones(len(clean) + 1)]
        weight = np.where(y > 0, max(1.0, len(clean) / (len(positives) + len(gapped)) / 4), 1.0)
        weight[len(positives) + len(gapped)] = len(clean)  # what has no triples is clean
        w = machine(x, y, weight)
        triples = basis.T.astype(np.float64) @ (to_features @ w[:-1])
        model = Model(triples, float(w[-1]), flat.curve)
        if again:
            value = Strings.times(pool, triples) + w[-1]
            wrong = [(value[i], pool[i]) for i in np.argsort(-value)[:WRONG_STRINGS] if value[i] > -1]
            # runs of clean sentences count like words
            runs = {s: v for part in _parts([text for text, label in rows if not label]) for found in model.runs(part, -0.25) for s, v in found.items() if not any(t in s for t in positives)}
            wrong += sorted(((v, s) for s, v in runs.items()), reverse=True)[:WRONG_STRINGS]
            clean = list(dict.fromkeys([*clean, *(s for _, s in wrong)]))
    known: dict[str, float] = {}
    table_ = []
    all_runs = (r for part in _parts([text for text, _ in rows]) for r in model.runs(part))
    for (_, found), runs in zip(sentences, all_runs, strict=True):
        all_ = set().union(*found)
        new = [t for t in all_ if t not in known]
        known.update(zip(new, model.strings(new).tolist(), strict=True))
        table_.append(model.features([known[t] for t in all_], runs))
    return model._replace(curve=logistic(np.array(table_), np.array([label for label, _ in sentences], float)))


def _parts(texts: list[str], size: int = 1 << 18) -> Iterator[list[str]]:
    """The texts, some at a time."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held > size:
            yield part
            part, held = [], 0
    if part:
        yield part


def _pairs(rows: list[tuple[str, int]], witness: set[str], fold: Callable[[str], str]) -> tuple[Counter, Counter]:
    """In how many clean and toxic rows two neighbouring words stand, as one string; those that eight toxic rows have at least (there are many pairs)."""

    def of(text: str) -> set[str]:
        out = set()
        for sentence in _SENTENCE.split(text):
            words = list(map(fold, sentence.split()))
            out.update(a + b for a, b in zip(words, words[1:]) if a and b and len(a + b) <= RUN_LETTERS and a not in witness and b not in witness)
        return out

    toxic = Counter(t for text, label in rows if label for t in of(text))
    toxic = Counter({t: n for t, n in toxic.items() if n >= 8})
    return Counter(t for text, label in rows if not label for t in of(text) if t in toxic), toxic


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most: int = FIT_BYTES) -> list[tuple[str, int]]:
    """Labelled texts with crc32(doc_id) mod 5 <> 0, each as a whole: the first by a hash of doc_id, `rows` rows and
    `most` bytes at most. Of rows that repeat an id and a text one is taken."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(held_out("doc_id") == F.lit(False))
    # broadcast: two numbers for each of `rows` rows at most
    told = F.broadcast(told.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("own", F.xxhash64("text"))
    sizes = texts.join(told, "doc_id").select("doc_id", "toxic", "own", F.octet_length("text").alias("n")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "own").limit(rows).collect()
    taken, held = [], 0
    for r in sizes:
        if held + r.n <= most:
            held += r.n
            taken.append((r.doc_id, r.own, r.toxic))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long, own long, toxic int"))
    got = texts.join(chosen, ["doc_id", "own"]).dropDuplicates(["doc_id", "own"]).collect()
    return [(r.text, r.toxic) for r in sorted(got, key=lambda r: (r.doc_id, r.text))]


def held_out(doc_id: str):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score, the probability that label 1 fits the whole text; one row for each row of docs.

    Null is an empty text; it gets the score of a text without words, as does one of blanks. Nothing but text is looked
    at, so repeated rows get one score and a null doc_id means nothing; texts of any length are taken as a whole. A table
    without rows gives none. Columns may have any names; a kept one can't be called score.
    """
    if "score" in keep:
        raise ValueError("a column to keep has the name of the result")
    ready(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    schema = rows.select("row").withColumn("score", F.lit(0.0)).schema

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for part in text_slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = [tokens(t) for t in texts]
                if len(known) > CACHE:
                    known.clear()
                new = list(set().union(*found).difference(known))
                known.update(zip(new, model.strings(new).tolist(), strict=True))
                features = [model.features(list(map(known.__getitem__, t)), r) for t, r in zip(found, model.runs(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(model.probability(features), pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, schema).select("row.*", "score")


def train(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    return fit(sample(docs, labels, **bounds))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
