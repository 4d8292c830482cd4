"""N-gram Jaccard join through a token-group matrix.

Documents with the same shingle set are one class. Classes are partitioned into groups of similar ones, each group's
union of tokens is stored, and a query opens a group only if its overlap with the union allows a member that is similar
enough; opened groups are compared exactly. What keeps the matrix sparse:

* Candidates. Two sets of sizes q <= s that are similar enough differ in at most H tokens, H following from the sizes. A
  level of sizes cuts the token space into H + 1 + 2w parts by hash, so 2w + 1 parts at least are the same in both;
  even if either set leaves out its w emptiest parts, one is left. A part's tokens as a whole are a signature, so only
  sets with an equal signature can be similar. No similar pair is lost, and a passage that many documents share gives no
  signature unless it fills a whole part of the set.
* Groups. A class joins the pivot with which it shares most signatures (a bucket's pivot is its smallest class).
* Queries. First each class is held against its pivot, which links most copies. After that only classes in buckets that
  hold other components are queries, and they ask only groups with such members with which they share as many signatures
  as two similar sets have to. Such groups are looked up in a query's smallest buckets, so many that one has to be shared.
* The matrix. The union of tokens of each group that is asked is a stored table of (group, token), over a fixed slice of
  the token space. Queries are joined to it by token: what a query has in the slice and the union has not is missing from
  every member, which bounds the overlap with any. Texts are moved for the groups that qualify alone, and these are cut
  into blocks of bounded size.

A group of any size costs rows in proportion to it: no pairs of its members are ever listed. A bucket lists the groups for
those queries alone that have no smaller ones to look them up in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surfaceloom.llm.common import components, forget, lean, mix, packed_texts, settle, table, text_slices, unpacked_slices
from surfaceloom.llm.shingles import sets

#: Tokens of a block of a group, and queries that one copy of a block answers.
BLOCK_TOKENS, BLOCK_QUERIES = 1 << 19, 4096
#: The matrix holds tokens whose hash is 0 modulo this. What it leaves out counts as overlap, so the bound stays one: at
#: 0.8 a group with members of a query's size is opened if it holds 56 % of the query's slice; 89 % with 1, at four times
#: the rows.
SLICE = 4
#: Sets may be this large; the last level takes what is larger.
LARGEST = 1 << 40
#: Classes that a task remembers, so as to hand out their signatures once; more of them are handed out again.
SEEN = 100_000


class Levels:
    """Size levels for intersection >= num/den of the union: level l joins the sizes in [bounds[l], bounds[l + 2])."""

    def __init__(self, num: int, den: int):
        bounds = [1]
        while bounds[-1] < LARGEST:
            bounds.append(max(bounds[-1] + 1, den * (bounds[-1] - 1) // num + 1))
        self.bounds = np.array(bounds, np.int64)
        # |A| + |B| - 2 |A and B|, as |A and B| >= num (|A| + |B|) / (num + den)
        apart = (den - num) * 2 * (self.bounds[2:] - 1) // (den + num)
        self.spare = np.where(apart >= 7, 1 + apart // 40, 0)
        self.parts = apart + 1 + 2 * self.spare
        assert len(self.parts) < 256  # a signature's lowest byte is its level

    def of(self, sizes: np.ndarray) -> list[np.ndarray]:
        """The two levels of each size; -1 where only equal sets are similar enough."""
        own = np.searchsorted(self.bounds, sizes, "right") - 1
        out = []
        for level in (own, own - 1):
            level = np.where((level >= 0) & (level < len(self.parts)), level, -1)
            out.append(np.where((level >= 0) & (self.parts[level] > 1), level, -1))
        return out


def _labelled(signs: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    return (signs & ~np.uint64(255)) | np.asarray(level).astype(np.uint64)


def signatures(tokens: np.ndarray, at: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and the row of each. tokens rise within a row."""
    sizes = np.diff(at)
    scrambled = mix(tokens + np.uint64(0xA0761D6478BD642F))
    all_rows, all_signs = [], []
    for level in levels.of(sizes):
        rows = np.flatnonzero((level >= 0) & (sizes > 0))
        if not len(rows):
            continue
        k, w = levels.parts[level[rows]], levels.spare[level[rows]]
        count = sizes[rows]
        starts = np.concatenate([[0], np.cumsum(count)])
        own = np.repeat(np.arange(len(rows)), count)
        take = np.arange(starts[-1]) - starts[own] + at[rows][own]
        part = ((tokens[take] >> np.uint64(32)) * k[own].astype(np.uint64)) >> np.uint64(32)
        slot = own * (1 << 40) + part.astype(np.int64)
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        sums = np.add.reduceat(scrambled[take], first)
        inside = np.diff(np.append(first, len(slot)))
        row, number = own[first], part[first]
        have = np.bincount(row, minlength=len(rows))
        # the w emptiest parts of a row are left out, those without tokens first
        drop = np.maximum(0, w - (k - have))
        keep = np.ones(len(row), bool)
        for r in np.flatnonzero(drop):
            a = np.searchsorted(row, r)
            keep[a + np.argsort(inside[a : a + have[r]], kind="stable")[: drop[r]]] = False
        name = level[rows][row].astype(np.uint64) << np.uint64(40)
        all_signs.append(_labelled(mix(sums ^ mix(name + number)), level[rows][row])[keep])
        all_rows.append(rows[row][keep])
        for r in np.flatnonzero(k - have > w):  # more empty parts than may be left out
            a = np.searchsorted(row, r)
            empty = np.setdiff1d(np.arange(k[r]), number[a : a + have[r]].astype(np.int64))[w[r] :]
            all_signs.append(_labelled(mix(mix((np.uint64(level[rows[r]]) << np.uint64(40)) + empty.astype(np.uint64)) + np.uint64(1)), level[rows[r]]))
            all_rows.append(np.full(len(empty), rows[r]))
    if not all_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(all_signs), np.concatenate(all_rows)


def marked(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id, mark (a hash of the text; both tell rows apart that aren't repeated), text and more."""
    return docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"), *more)


def classes(docs: DataFrame, n: int, num: int, den: int, signed: bool) -> DataFrame:
    """doc_id, mark, n_shingles and class (a hash of the set) of every row; signed: class and signs, once for a class and task.

    docs: doc_id, mark, text, as marked() makes them. Signatures are made in a pass of their own, as they are much more than
    the rest and needed once.
    """
    names = ["class", "signs"] if signed else ["doc_id", "mark", "n_shingles", "class"]
    given = T.StructType([*docs.select("doc_id", "mark").schema, T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = Levels(num, den), set()
        for batch in batches:
            for part in text_slices(batch):
                tokens, at = sets(part.column("text"), n)
                size = np.diff(at)
                sums = np.zeros(len(size), np.uint64)
                full = np.flatnonzero(size)
                if len(full):
                    sums[full] = np.add.reduceat(mix(tokens ^ np.uint64(0xD6E8FEB86659FD93)), at[:-1][full])
                own = mix(sums + size.astype(np.uint64)).view(np.int64)
                if not signed:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(size), pa.array(own)], names)
                    continue
                new = np.zeros(len(size), bool)
                for i, c in zip(full.tolist(), own[full].tolist(), strict=True):
                    if c not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(c)
                        new[i] = True
                take = np.repeat(new, size)
                at_new = np.concatenate([[0], np.cumsum(np.where(new, size, 0))])
                signs, row = signatures(tokens[take], at_new, levels)
                order = np.argsort(row, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(offsets, pa.array(signs[order].view(np.int64)))], names)

    return docs.select("doc_id", "mark", "text").mapInArrow(lean(run), "class long, signs array<long>" if signed else given)


def opened(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links between the queries and the members of each block: u, v.

    rows: grp, block, query (0: member, 1: query), class, text (as it is, or packed). Of the links within a block those that
    join something are returned, which is as good for components.
    """

    class Block:
        def __init__(self, key):
            self.key, self.members, self.tokens, self.index, self.root = key, [], [], None, {}

        def find(self, x: int) -> int:
            path = []
            while (up := self.root.get(x, x)) != x:
                path.append(x)
                x = up
            for p in path:
                self.root[p] = x
            return x

        def build(self) -> None:
            """The group's row of the matrix: its union of tokens, with the members that hold each."""
            self.size = np.array([len(t) for t in self.tokens], np.int64)  # a block can be without members
            flat = np.concatenate(self.tokens) if self.tokens else np.zeros(0, np.uint64)
            order = np.argsort(flat, kind="stable")
            self.owner = np.repeat(np.arange(len(self.tokens)), self.size)[order]
            flat = flat[order]
            first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
            self.union, self.ends = flat[first], np.append(first, len(flat))
            self.tokens, self.index = [], True

        def links(self, own: int, query: np.ndarray) -> Iterator[tuple[int, int]]:
            if self.index is None:
                self.build()
            q = len(query)
            if not len(self.union) or not q:
                return
            least = max(int(self.size.min()), -(-num * q // den))
            at = np.searchsorted(self.union, query)
            at = at[self.union[np.minimum(at, len(self.union) - 1)] == query]
            if len(at) * (num + den) < num * (q + least):
                return  # no member can be similar enough: the group stays closed
            a, length = self.ends[at], self.ends[at + 1] - self.ends[at]
            total = np.cumsum(length)
            both = np.bincount(self.owner[np.repeat(a - total + length, length) + np.arange(total[-1])], minlength=len(self.size))
            for m in np.flatnonzero(den * both >= num * (q + self.size - both)):
                u, v = self.find(own), self.find(self.members[m])
                if u != v:
                    self.root[max(u, v)] = min(u, v)
                    yield own, self.members[m]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(None)
        for batch in batches:
            us, vs = [], []
            for part in unpacked_slices(batch):
                tokens, at = sets(part.column("text"), n)
                cols = [part.column(i).to_pylist() for i in range(4)]
                for i, (g, b, query, own) in enumerate(zip(*cols, strict=True)):
                    if (g, b) != block.key:
                        block = Block((g, b))
                    mine = tokens[at[i] : at[i + 1]]
                    if query:
                        for u, v in block.links(own, mine):
                            us.append(u)
                            vs.append(v)
                    else:
                        block.members.append(own)
                        block.tokens.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    dealt = rows.select("grp", "block", "query", "class", "text").repartition("grp", "block").sortWithinPartitions("grp", "block", "query", "class")
    return dealt.mapInArrow(lean(run), "u long, v long")


def blocks(members: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows for opened(): members (grp, class, n) cut into blocks by tokens, each block copied for its share of queries.

    queries: grp, class.
    """
    shape = (
        members.groupBy("grp")
        .agg(F.sum("n").alias("tokens"))
        .join(queries.groupBy("grp").agg(F.count("*").alias("asked")), "grp")
        .select("grp", F.ceil(F.col("tokens") / BLOCK_TOKENS).alias("cuts"), F.ceil(F.col("asked") / BLOCK_QUERIES).alias("copies"))
    )
    side = lambda df, query, fixed, many: (
        df.join(shape, "grp")
        .withColumn("fixed", F.pmod(F.xxhash64("class", F.lit(query)), F.col(fixed)))
        .withColumn("each", F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1)))
        .withColumn("block", (F.col("each") * F.col(fixed) + F.col("fixed")) if query == 0 else (F.col("fixed") * F.col("cuts") + F.col("each")))
        .select("grp", "block", F.lit(query).alias("query"), "class")
    )
    return side(members, 0, "cuts", "copies").unionAll(side(queries, 1, "copies", "cuts")).join(texts.hint("merge"), "class")


def shingled(rows: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """rows (grp, class, share) with a row for each shingle of the class in the slice: token, 32 bits of its hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in unpacked_slices(batch):
                tokens, at = sets(part.column("text"), n)
                inside = tokens % np.uint64(SLICE) == 0
                at = np.append(0, np.cumsum(inside))[at]
                short = (tokens[inside] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                held = [part.column(c) for c in ("grp", "class", "share")]
                yield pa.RecordBatch.from_arrays([*held, pa.ListArray.from_arrays(at.astype(np.int32), pa.array(short))], ["grp", "class", "share", "tokens"])

    found = rows.join(texts.hint("merge"), "class").select("grp", "class", "share", "text").mapInArrow(lean(run), "grp long, class long, share long, tokens array<int>")
    return found.select("grp", "class", "share", F.explode("tokens").alias("token"))


def qualifying(members: DataFrame, queries: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of queries (grp, class, n) whose overlap with the group's union of tokens allows a member that is similar.

    members: grp, class, n. The unions are stored as a table. It holds 32 bits of a token; of tokens that fall together
    fewer are missing, so no group is closed wrongly. A group that many ask stands in copies, each for a bounded share of
    the queries. Rows of tokens are dealt by their token too, so a large group's are no one task's.
    """
    shape = (
        members.groupBy("grp")
        .agg(F.min("n").alias("least"))
        .join(queries.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("copies")), "grp")
    )
    # what a group's tokens need of its shape goes with its classes
    known = members.join(shape, "grp").select("grp", "class", F.col("copies").alias("share"))
    matrix = settle(shingled(known, texts, n).groupBy("grp", "token").agg(F.max("share").alias("copies")), "matrix")
    rows = matrix.select("grp", "token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("share"))
    asked = queries.join(shape, "grp").withColumn("share", F.pmod(F.xxhash64("class"), F.col("copies")))
    missing = (
        shingled(asked.select("grp", "class", "share"), texts, n)
        .join(rows.hint("merge"), ["grp", "share", "token"], "left_anti")
        .groupBy("grp", "class")
        .agg(F.count("*").alias("missing"))
    )
    least = F.greatest("least", F.ceil(F.col("n") * num / den))
    overlap = F.col("n") - F.coalesce("missing", F.lit(0))  # at most
    found = asked.join(missing, ["grp", "class"], "left").where(overlap * (num + den) >= num * (F.col("n") + least))
    found = settle(found.select("grp", "class"), "qualifying")
    forget(matrix)
    return found


def inside(mixed: DataFrame) -> DataFrame:
    """The groups of each bucket, with the least and the greatest component of their members there."""
    return mixed.groupBy("sign", "grp").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.first("members").alias("members"))


def candidates(mixed: DataFrame, num: int, den: int) -> DataFrame:
    """Groups that classes may have to ask: grp, class, level, n and needed, the signatures that they have to share.

    mixed: sign, class, n, root, grp, members (of the group) and held (rows of the bucket), of buckets with more than one
    component. Two sets that are similar enough differ in so few parts that they share `needed` signatures of the level of
    the smaller one; so many has a query to share with a group. Of a query's m signatures in mixed buckets, one at least of
    any m - needed + 1 is then shared. The ones with the smallest buckets are looked up, so a bucket of what many texts have
    in common lists no pairs for those that would need others too.
    """
    levels = Levels(num, den)  # 256 rows at most
    level_rows = [(i, int(k - 2 * w), int(levels.bounds[i + 1]), int(levels.bounds[i + 2])) for i, (k, w) in enumerate(zip(levels.parts, levels.spare, strict=True))]
    level_table = mixed.sparkSession.createDataFrame(level_rows, "level int, parts long, middle long, top long")
    # the other's size at most: at a set's own level any, at the one below the sizes of that level's lower half
    other = F.when(F.col("n") < F.col("middle"), F.least(F.floor(F.col("n") * den / num), F.col("top") - 1)).otherwise(F.col("middle") - 1)
    needed = F.greatest(F.lit(1), F.col("parts") - F.floor((F.col("n") + other) * (den - num) / (den + num)))
    by_level = Window.partitionBy("class", "level")
    rarest = (
        mixed.withColumn("level", level_of("sign"))
        .withColumns({"m": F.count("*").over(by_level), "nth": F.row_number().over(by_level.orderBy("held", "sign"))})
        .join(F.broadcast(level_table), "level")
        .withColumn("needed", needed)
        .where("nth <= m - needed + 1")
    )
    return (
        rarest.alias("q").join(inside(mixed).alias("g"), "sign")
        # the smaller group asks the larger; and there is a member of another component
        .where("(q.members < g.members or (q.members = g.members and q.grp <= g.grp)) and (q.root <> g.low or q.root <> g.high)")
        .select(F.col("g.grp").alias("grp"), F.col("q.class").alias("class"), "level", "n", "needed")
        .distinct()
    )


def shared_enough(pairs: DataFrame, mixed: DataFrame) -> DataFrame:
    """grp, class and n of the candidates that share as many signatures as they have to."""
    signs = mixed.select("class", level_of("sign").alias("level"), "sign", "root")
    counted = (
        pairs.where("needed > 1")
        .join(signs.hint("merge"), ["class", "level"])
        .join(inside(mixed).hint("merge"), ["sign", "grp"])
        .where("root <> low or root <> high")
        .groupBy("grp", "class", "level")
        .agg(F.count("*").alias("common"), F.first("needed").alias("needed"), F.first("n").alias("n"))
        .where("common >= needed")
    )
    return pairs.where("needed = 1").select("grp", "class", "n").unionAll(counted.select("grp", "class", "n")).distinct()


def level_of(sign: str) -> Column:
    return F.col(sign).bitwiseAND(255).cast("int")


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable by links, for each row of docs.

    Rows link when intersection / union of their shingle sets (n words each, A-Z lower-cased) is num/den or more. Empty
    and null texts have no shingles, link with nothing and are their own component, as are rows with a null doc_id that
    link with nothing; repeated rows link with each other. An empty table gives none. Sets are told apart by 64-bit
    hashes of their shingles and by a 64-bit hash of the whole; texts of any length are taken as a whole. Other columns,
    whatever their names, are ignored. The links themselves are not listed: of those within a block the ones that join
    something are kept, which gives the same components.
    """
    found = grouped(marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), n, num, den)
    full = found.where("n_shingles > 0")
    smallest = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return full.join(smallest, "root").select("doc_id", "n_shingles", "component_id").unionAll(
        found.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )


def grouped(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, mark, n_shingles and root, a number for its component, of each row of docs; without shingles root says nothing.

    docs: doc_id of any type, mark and text, as marked() makes them. They are read several times and aren't stored; the
    texts of classes that share a signature are, packed.
    """
    base = settle(classes(docs, n, num, den, False), "classes")
    by_sign = Window.partitionBy("sign")
    shared = settle(
        classes(docs, n, num, den, True)
        .select("class", F.explode("signs").alias("sign"))
        .withColumns({"low": F.min("class").over(by_sign), "high": F.max("class").over(by_sign)})
        .where("low < high")
        .select("sign", "class", "low"),
        "buckets",
    )
    pivots = shared.where("class <> low").distinct().groupBy("class", "low").agg(F.count("*").alias("shared"))
    pivots = pivots.groupBy("class").agg(F.max_by("low", F.struct("shared", "low")).alias("pivot"))
    sized = base.where("n_shingles > 0").groupBy("class").agg(F.min(first_row()).alias("first"), F.first("n_shingles").alias("n"))
    nodes = settle(shared.select("class").distinct().join(pivots, "class", "left").join(sized, "class").select("class", F.coalesce("pivot", "class").alias("pivot"), "n", "first.doc_id", "first.mark"), "nodes")
    heads = nodes.select(F.col("doc_id").alias("head_id"), F.col("mark").alias("head_mark"), "class").hint("merge")  # the same plan at every size
    texts = settle(
        docs.join(heads, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("mark") == F.col("head_mark")))
        .select("class", "text")
        .mapInArrow(lean(_of_class(n)), "class long, text binary"),
        "texts",
    )
    heads = nodes.select(F.col("pivot").alias("grp")).distinct()
    of_pivot = heads.join(nodes.select(F.col("class").alias("grp"), "n"), "grp").select("grp", F.col("grp").alias("class"), "n")
    first = settle(opened(blocks(of_pivot, nodes.where("class <> pivot").select(F.col("pivot").alias("grp"), "class"), texts), n, num, den), "links")
    linked = components(first)
    # a group is the classes of a pivot that are linked with it, or the others
    known = nodes.join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    of_heads = known.select(F.col("class").alias("pivot"), F.col("root").alias("head_root"))
    known = settle(known.join(of_heads, "pivot", "left").withColumn("grp", F.xxhash64("pivot", F.coalesce(F.col("root") == F.col("head_root"), F.lit(False)))).select("class", "n", "root", "grp"), "groups")
    weights = known.groupBy("grp").agg(F.count("*").alias("members"))
    mixed = (
        shared.select("sign", "class").distinct()
        .join(known.join(weights, "grp"), "class")
        .withColumns({"low": F.min("root").over(by_sign), "high": F.max("root").over(by_sign), "held": F.count("*").over(by_sign)})
        .where("low < high")
    )
    mixed = settle(mixed.select("sign", "class", "n", "root", "grp", "members", "held"), "mixed")
    forget(shared)
    pairs = settle(candidates(mixed, num, den), "pairs")
    asks = settle(shared_enough(pairs, mixed), "asks")
    forget(mixed, pairs)
    of = lambda queries: known.join(queries.select("grp").distinct(), "grp").select("grp", "class", "n")
    open_ = qualifying(of(asks), asks, texts, n, num, den)
    more = settle(opened(blocks(of(open_), open_, texts), n, num, den), "links")
    roots = components(first.unionAll(more)).withColumnRenamed("node", "class")
    forget(texts, nodes, known, asks, open_, first, more)
    return base.join(roots, "class", "left").select("doc_id", "mark", "n_shingles", F.coalesce("root", "class").alias("root"))


def first_row() -> Column:
    """Orders rows: the smallest doc_id comes first, none last; ties go to the smaller mark."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")


def _of_class(n: int):
    """Keeps, of rows (class, text), those whose text is of the class: others can have its id and mark. One each, packed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: set[int] = set()
        for batch in batches:
            for part in text_slices(batch):
                if len(last) >= SEEN:
                    last.clear()  # repeated rows stand together, and a class that comes twice links with itself
                tokens, at = sets(part.column("text"), n)
                size = np.diff(at)
                sums = np.zeros(len(size), np.uint64)
                full = np.flatnonzero(size)
                if len(full):
                    sums[full] = np.add.reduceat(mix(tokens ^ np.uint64(0xD6E8FEB86659FD93)), at[:-1][full])
                same = mix(sums + size.astype(np.uint64)).view(np.int64) == part.column("class").to_numpy()
                keep = []
                for ok, c in zip(same.tolist(), part.column("class").to_pylist(), strict=True):
                    keep.append(ok and c not in last)
                    if keep[-1]:
                        last.add(c)
                part = part.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column("class"), packed_texts(part.column("text"))], ["class", "text"])

    return run


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), 4, 85, 100)
