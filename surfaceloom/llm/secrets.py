"""Secret scans over a ledger of blobs: each content is scanned once for each version of each rule.

A history is a table of paths and texts (every version that ever stood at a path). Texts are addressed by SHA-256; the
ledger holds the pairs of blob and rule version that were scanned before, with what they found. A scan takes one copy of
each blob that has pairs not in the ledger, runs just these rules over its whole text, and joins what is known about
every blob back to all paths that hold it. A new rule version costs one pass over the distinct blobs; new files cost
only themselves; and as the ledger is a table, a scan that broke off goes on with the pairs that are missing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfaceloom.llm.common import lean, settle, table


class Rule(NamedTuple):
    """A pattern and the least length of a match, or of one of its groups. Later versions of a kind are scanned anew."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1
    flags: int = re.ASCII
    #: One of these is in the lower-cased text of every match; none: hexadecimal runs, told by their length.
    hints: tuple[str, ...] = ()
    #: A pattern with an open front, told from behind so that a long run of its characters is read once: the characters of
    #: the front, where a match begins in them, and the rest of the pattern.
    front: tuple[str, str, str] | None = None


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, flags=re.ASCII | re.IGNORECASE, hints=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", "AKIA[A-Z0-9]+", 20, hints=("akia",)),
    Rule("hex", "[0-9a-f]+", 24),
)
_NAME = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: What this operator finds besides.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", hints=("private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", hints=("eyj",), front=(_NAME + "_-", "eyJ[A-Za-z0-9_-]{8}", r"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*")),
    Rule("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@", hints=("://",), front=(_NAME + "+.-", "[A-Za-z]", r"://[^\s/:@]+:[^\s/@]+@")),
)
RULES = BASE + MORE

_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def spans_of(rule: Rule, text: str, lower: str | None = None) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, in code points, without those that are too short."""
    if rule.hints:
        lower = text.lower() if lower is None else lower
        if not any(h in lower for h in rule.hints):
            return []
    elif b"x" * rule.least not in text.encode().translate(_HEX):
        return []
    if rule.front:
        return list(_from_behind(rule, text))
    return [m.span() for m in re.finditer(rule.pattern, text, rule.flags) if len(m[rule.group]) >= rule.least]


def _from_behind(rule: Rule, text: str) -> Iterator[tuple[int, int]]:
    """The same matches as those of the whole pattern."""
    chars, opens, rest = rule.front
    opens, rest = re.compile(opens, rule.flags), re.compile(rest, rule.flags)
    done = at = 0
    while m := rest.search(text, at):
        low = m.start()
        while low > done and text[low - 1] in chars:
            low -= 1
        first = opens.search(text, low, m.start())
        if first:
            yield first.start(), m.end()
            done = at = m.end()
        else:
            at = m.start() + 1


def _tag(rule: Rule) -> str:
    return f"{rule.kind}/{rule.version}"


def address(text: Column) -> Column:
    """The SHA-256 of a text (null: empty)."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def blobs(history: DataFrame, path: str = "doc_id") -> DataFrame:
    """path and the address of its text."""
    return history.select(F.col(path).alias("path"), address(F.col("text")).alias("blob"))


def scan(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """New ledger rows: blob, rules (kind/version, those that were run now) and found (map of rule to starts and ends).

    A blob is scanned at one of its paths, whichever sorts first; a null text is an empty blob, a null path a path like
    any other, repeated rows are one blob. Columns other than path and text are ignored; no rows, no ledger rows.
    """
    wanted = blobs(history, path).groupBy("blob").agg(F.min("path").alias("path"))
    every = F.array(*(F.lit(_tag(r)) for r in rules))
    if ledger is None:
        wanted = wanted.withColumn("rules", every)
    else:
        known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))  # a blob's rules: as many as there are
        wanted = wanted.join(known, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("known", F.array().cast("array<string>")))).where(F.size("rules") > 0).drop("known")
    texts = history.select(F.col(path).alias("path_"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # by path, not by blob: the many copies of a blob are spread over all tasks
    once = texts.join(wanted, F.col("path_").eqNullSafe(F.col("path"))).where(address(F.col("text")) == F.col("blob")).select("blob", "rules", "text")
    by_tag = {_tag(r): r for r in rules}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for tags, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                lower = text.lower()
                spans = ((tag, [x for s in spans_of(by_tag[tag], text, lower) for x in s]) for tag in tags)
                found.append([x for x in spans if x[1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.map_(pa.string(), pa.list_(pa.int64())))], ["blob", "rules", "found"])

    # of repeated rows one stays
    return once.mapInArrow(lean(run), "blob binary, rules array<string>, found map<string, array<long>>").groupBy("blob").agg(F.first("rules").alias("rules"), F.first("found").alias("found"))


def findings(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """What the ledger knows about every row of history: path, blob, found (map of kind to spans), one row for each row.

    Kinds without spans are left out of the map.
    """
    tags = [_tag(r) for r in rules]
    kinds = F.create_map(*(F.lit(x) for r in rules for x in (_tag(r), r.kind)))
    by_blob = (
        ledger.where(F.size("found") > 0)
        .select("blob", F.explode("found").alias("rule", "spans"))
        .where(F.col("rule").isin(tags))
        .groupBy("blob")
        .agg(F.map_from_entries(F.collect_list(F.struct(kinds[F.col("rule")], "spans"))).alias("found"))  # as many as rules
    )
    return blobs(history, path).join(by_blob, "blob", "left").select("path", "blob", "found")


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {r.kind: i for i, r in enumerate(RULES)}
    base = {r.kind for r in BASE}
    for batch in batches:
        rows = []
        for path, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = dict(found or ())
            spans = sorted(((s, order[k], k, e) for k, v in found.items() for s, e in zip(v[::2], v[1::2], strict=True)))
            said = [(k, f"{k}:{s}:{e}") for s, _, k, e in spans]
            own = ",".join(x for k, x in said if k in base)
            rows.append((path, *(len(found.get(r.kind, ())) // 2 for r in BASE), hashlib.sha256(own.encode()).hexdigest(), ",".join(x for _, x in said)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every finding's text replaced by [SECRET]; findings that overlap or touch become one.

    Returns the same columns and rows; n_chars, where there is one, counts the new text. Cuts are joined back by doc_id and
    text, so rows with one doc_id, or without any, can have different texts; repeated rows stay. Null and empty texts stay
    as they are, very long ones are scanned as a whole; an empty table gives none; columns may have any names.
    """
    ledger = settle(scan(docs, None, rules), "ledger")
    flat = findings(docs, ledger, rules).where("found is not null").select(F.col("path").alias("path_"), F.col("blob").alias("blob_"), F.flatten(F.map_values("found")).alias("cuts_")).dropDuplicates(["path_", "blob_"])

    @F.pandas_udf("string")
    def without(texts, cuts):
        out = []
        for text, cut in zip(texts, cuts, strict=True):
            if cut is not None and len(cut):
                merged: list[list[int]] = []
                for s, e in sorted(zip(map(int, cut[::2]), map(int, cut[1::2]), strict=True)):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                kept, at = [], 0
                for s, e in merged:
                    kept += [text[at:s], "[SECRET]"]
                    at = e
                text = "".join([*kept, text[at:]])
            out.append(text)
        import pandas as pd

        return pd.Series(out, dtype=object)

    # a row stands in one column, so that no name of its own can clash
    joined = docs.select(F.struct("*").alias("row")).join(flat, F.col("row.doc_id").eqNullSafe(F.col("path_")) & (address(F.col("row.text")) == F.col("blob_")), "left")
    text = F.when(F.col("cuts_").isNull(), F.col("row.text")).otherwise(without(F.col("row.text"), F.col("cuts_")))
    changed = joined.withColumn("text_", text)
    new = {"text": F.col("text_")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cuts_").isNull(), F.col("row.n_chars")).otherwise(F.length("text_").cast(docs.schema["n_chars"].dataType))
    return changed.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a history of two commits, the even doc_ids and then all: the second scan sees unseen blobs alone."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ledger = settle(scan(docs.where(F.pmod("doc_id", F.lit(2)) == 0)), "ledger")
    ledger = ledger.unionAll(settle(scan(docs, ledger), "ledger"))
    return findings(docs, ledger).select("path", "found").mapInArrow(lean(_digest), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _match_sql(i: int, rule: Rule) -> str:
    """A rule's matches in DuckDB: kind, lengths of what lies between them, of themselves, and of the group that counts."""
    letters = (lambda c: f"[{c.lower()}{c.upper()}]" if c.isalpha() else c) if rule.flags & re.IGNORECASE else str
    pattern = rule.pattern
    if rule.flags & re.IGNORECASE:  # the names alone: the classes hold both cases
        pattern = re.sub(r"[a-z]+(?=[|)_])|[a-z](?=\?)", lambda m: "".join(map(letters, m[0])), pattern.replace("key)", "k" + "ey)"))
    pattern = pattern.replace(r"\s", r"\t\n\x0B\f\r ").replace("[0-9a-f]+", "[0-9a-f]{24,}").replace("'", "''")
    return f"SELECT doc_id, {i} AS k, '{rule.kind}' AS kind, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) AS own, list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x)) AS said, {rule.least} AS least FROM docs"


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), rules AS (
  {" UNION ALL ".join(_match_sql(i, r) for i, r in enumerate(RULES))}
), each AS (
  SELECT *, unnest(range(1, len(own) + 1)) AS i FROM rules WHERE len(own) > 0
), found AS (
  SELECT doc_id, k, kind, (list_sum(gaps[1:i]) + coalesce(list_sum(own[1:i - 1]), 0))::BIGINT AS a, own[i] AS n FROM each WHERE said[i] >= least
), told AS (
  SELECT doc_id, a, k, kind, kind || ':' || a || ':' || (a + n) AS s FROM found
), lists AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(s, ',' ORDER BY a, k) FILTER (k < {len(BASE)}) AS base, string_agg(s, ',' ORDER BY a, k) AS spans FROM told GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (doc_id)
"""
