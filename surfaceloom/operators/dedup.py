"""Set operations of a deduplication: first arrivals, bare endpoints, covered key sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfaceloom.functions.query import tagged
from surfaceloom.options import SurfaceOptions
from surfaceloom.plans.surface import gated, parsed, signed
from surfaceloom.shipping import ship


def first_arrivals(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Of the rows with a signature the one that came first. Each task sends one row of a signature at most."""
    rest = [c for c in df.columns if c not in ("base", "sig")]
    firsts = df.groupBy("base", "sig").agg(F.min_by(F.struct(*rest), ord_col).alias("first_"))
    return firsts.select(*(c if c in ("base", "sig") else F.col("first_")[c].alias(c) for c in df.columns))


def decorated(df: DataFrame) -> DataFrame:
    """df with decorated: whether a signature of the same base has more than the base."""
    more = df.groupBy("base").agg(F.max(F.col("sig") != F.col("base")).alias("decorated"))
    return df.join(more, "base").select(*df.columns, "decorated")


def fold_bare(df: DataFrame) -> DataFrame:
    """Bare rows with a decorated sibling go: those whose signature is the base of another one."""
    more = df.where(F.col("sig") != F.col("base")).select(F.col("base").alias("sig")).distinct()
    return df.join(more, "sig", "left_anti").select(*df.columns)


def covering_pairs(df: DataFrame) -> DataFrame:
    """sub and sup: signatures of one group of which the first one's key multiset is a proper part of the second one's.

    A set that covers another holds all its keys, the rarest of the group too. So each set asks by its rarest key alone,
    and is held only against the sets that have it. Equal sets of a group are one signature.
    """
    sets = df.where(F.col("grp").isNotNull()).select("sig", "grp", tagged(F.col("keys")).alias("set"))
    each = sets.select("sig", "grp", "set", F.explode("set").alias("key"))
    spread = each.groupBy("grp", "key").agg(F.count("*").alias("n"))
    asks = each.join(spread.where("n > 1"), ["grp", "key"], "left").groupBy("sig", "grp", "set").agg(F.min_by(F.struct("key", "n"), F.struct(F.coalesce("n", F.lit(1)), "key")).alias("rarest"))
    # a set whose rarest key nobody else has is covered by nothing
    asks = asks.where("rarest.n is not null").select("sig", "grp", "set", F.col("rarest.key").alias("key"))
    wider = F.expr("size(w.set) > size(a.set) and size(array_except(a.set, w.set)) = 0")
    return asks.alias("a").join(each.select("sig", "grp", "key", "set").alias("w"), ["grp", "key"]).where(wider).select(F.col("a.sig").alias("sub"), F.col("w.sig").alias("sup"))


def covered(df: DataFrame) -> DataFrame:
    """sig of every row whose key multiset is a proper part of another's in its group."""
    return covering_pairs(df).select(F.col("sub").alias("sig")).distinct()


def merge_covered(df: DataFrame) -> DataFrame:
    return df.join(covered(df), "sig", "left_anti")


class _CappedGroup:
    """Key sets of one group in order of arrival; a new one is compared with at most `cap` that are still there.

    Sets of one size lie in a shelf; the newest shelf and the newest set of a shelf are looked at first. The new set goes
    if a larger one covers it, and then asks no further; smaller ones that it covers go.
    """

    def __init__(self, cap: int):
        self.cap, self.shelves, self.order, self.gone = cap, {}, [], set()

    def take(self, number: int, keys: frozenset) -> None:
        asked, size = 0, len(keys)
        spent = lambda: self.cap != 0 and asked >= self.cap
        covered_ = False
        for width in reversed(self.order):
            if width == size or covered_ or spent():
                continue
            for other, held in reversed(self.shelves[width]):
                if other in self.gone:
                    continue
                asked += 1
                if width > size and keys <= held:
                    covered_ = True
                    break
                if width < size and held <= keys:
                    self.gone.add(other)
                if spent():
                    break
        if size not in self.shelves:
            self.shelves[size] = []
            self.order.append(size)
        self.shelves[size].append((number, keys))
        if covered_:
            self.gone.add(number)


def merge_capped(df: DataFrame, cap: int, ord_col: str = "ord") -> DataFrame:
    """Covered key sets go as far as `cap` comparisons for each record find them, in order of arrival.

    What comes of it hangs on the order, so a group is one task's work: its sets only, not its rows' other columns.
    """
    ship(df.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ord_col)
        group = _CappedGroup(cap)
        for i, keys in enumerate(rows["set"]):
            group.take(i, frozenset(keys))
        return pd.DataFrame({"sig": rows["sig"].iloc[sorted(group.gone)]})

    sets = df.where(F.col("grp").isNotNull()).select("sig", "grp", ord_col, tagged(F.col("keys")).alias("set"))
    return df.join(sets.groupBy("grp").applyInPandas(run, "sig string"), "sig", "left_anti")


def keyed(df: DataFrame, line: str = "line", options: SurfaceOptions = SurfaceOptions()) -> DataFrame:
    """Rows that pass the gate, with their signatures."""
    return signed(gated(parsed(df if line == "line" else df.withColumnRenamed(line, "line")), options), options)


def dedup(df: DataFrame, line: str = "line", ord_col: str = "ord", options: SurfaceOptions = SurfaceOptions()) -> DataFrame:
    """ord_col and out: the URLs of `line` that stay, each with the number of its first arrival.

    ord_col has to tell rows apart and gives their order. Null and empty lines go.
    """
    rows = keyed(df.where(F.octet_length(line) > 0), line, options).select(ord_col, "sig", "base", "grp", "keys", "out")
    if not options.merging:
        return first_arrivals(rows, ord_col).select(ord_col, "out")
    # What the branches need besides travels in one column, so that all ask for the same columns and the exchange of the
    # first arrivals is reused.
    load = F.concat(F.array("out", "grp"), F.coalesce("keys", F.array().cast("array<string>")))
    rows = fold_bare(first_arrivals(rows.select(ord_col, "sig", "base", load.alias("load")), ord_col))
    rows = rows.select(ord_col, "sig", F.get("load", F.lit(0)).alias("out"), F.get("load", F.lit(1)).alias("grp"), F.slice("load", 3, F.size("load")).alias("keys"))
    rows = merge_capped(rows, options.merge_cap, ord_col) if options.merge_cap else merge_covered(rows)
    return rows.select(ord_col, "out")


def fresh(df: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose output is not among those of an earlier run."""
    return df.join(known.select("out"), "out", "left_anti").select(*df.columns)


def stats(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: n_in non-empty lines, n_out rows kept."""
    both = lines.where(F.octet_length("line") > 0).select(F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(kept.select(F.lit(0).alias("i"), F.lit(1).alias("o")))
    return both.agg(F.coalesce(F.sum("i"), F.lit(0)).alias("n_in"), F.coalesce(F.sum("o"), F.lit(0)).alias("n_out"))
