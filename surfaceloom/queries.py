"""A query for each operator, over the table of URLs (or the table that an operator is about)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfaceloom.corpus import urls
from surfaceloom.functions import gate, query, segments, text
from surfaceloom.operators import dedup as ops
from surfaceloom.options import SurfaceOptions
from surfaceloom.plans.surface import gated, parsed, query_counts, signed
from surfaceloom.shipping import shared_dir
from surfaceloom.sources import lines

Query = Callable[[SparkSession, str], DataFrame]
c = F.col
FOLD, LOOSE = SurfaceOptions(fold_ids=True), SurfaceOptions(keep_invalid=True)
OPTIONS = {
    "default": SurfaceOptions(),
    "flag_fold_ids": FOLD,
    "flag_keep_invalid": LOOSE,
    "flag_keep_assets": SurfaceOptions(keep_assets=True),
    "flag_case_sensitive": SurfaceOptions(case_sensitive=True),
    "flag_whole_query": SurfaceOptions(whole_query=True),
    "flag_raw_segments": SurfaceOptions(raw_segments=True),
    "flag_raw_hosts": SurfaceOptions(raw_hosts=True),
    "flag_raw_output": SurfaceOptions(raw_output=True),
    "flag_fold_case_raw": SurfaceOptions(fold_ids=True, case_sensitive=True, raw_output=True),
}


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(urls(spark, sf_dir))


def _segment_rows(df: DataFrame, options: SurfaceOptions) -> DataFrame:
    all_ = segments.segments(c("path"))
    kept = segments.kept_segments(all_)
    return df.select("ord", F.array_join(segments.tokens(all_, kept, options), "/").alias("template"), F.array_join(kept, "/").alias("kept"))


def _each_segment(df: DataFrame) -> DataFrame:
    """One row for each distinct segment."""
    return df.select(F.explode(segments.segments(c("path"))).alias("segment")).distinct()


def _each_token(df: DataFrame) -> DataFrame:
    return df.where("query is not null").select(F.explode(F.split("query", "&")).alias("token")).distinct()


#: Columns of the parsed table.
FIELD_COLUMNS: dict[str, dict[str, Callable[[], Column]]] = {
    "p1_scheme_split": {"scheme": lambda: text.scheme_split(c("line"))[0], "rest": lambda: text.scheme_split(c("line"))[1]},
    "p2_scheme_repair": {"scheme": lambda: text.scheme_repair(c("line"))[0], "rest": lambda: text.scheme_repair(c("line"))[1]},
    "p3_authority": {"authority": lambda: c("auth"), "tail": lambda: c("tail")},
    "p4_host_port": {"host": lambda: c("host"), "port": lambda: c("port")},
    "p5_default_port": {"is_default": lambda: c("default_port")},
    "p6_fragment_cut": {"unfragmented": lambda: text.unfragmented(c("tail"))},
    "p7_path_query": {"path": lambda: c("path"), "query": lambda: c("query")},
    "p8_host_lower": {"host": lambda: text.lower(c("host"))},
    "p9_scheme_lower": {"scheme": lambda: text.lower(c("scheme"))},
    "p10_clean_host": {"host": lambda: text.clean_host(text.lower(c("host")))},
    "p11_valid_host": {"valid": lambda: text.valid_host(c("host"))},
    "g1_segments": {"n": lambda: F.size(segments.segments(c("path"))).cast("long"), "joined": lambda: F.array_join(segments.segments(c("path")), " ")},
    "g2_index_document": {"dropped": lambda: (F.size(segments.segments(c("path"))) - F.size(segments.kept_segments(segments.segments(c("path"))))).cast("long")},
    "q1_query_keys": {"keys": lambda: F.array_join(query.keys(c("query")), "&"), "loose": lambda: F.array_join(query.keys(c("query"), LOOSE), "&")},
    "q2_key_count": {"n": lambda: F.coalesce(F.size(query.keys(c("query"))), F.lit(0)).cast("long")},
    "q5_graph_query": {"graph": lambda: query.is_graph_query(c("query"))},
    "q7_clean_query": {"cleaned": lambda: query.clean(c("query")), "loose": lambda: query.clean(c("query"), LOOSE)},
    "q8_static_query": {"counts": lambda: query_counts(SurfaceOptions())},
    "f1_bad_path_bytes": {"bad": lambda: gate.bad_path_bytes(c("path"))},
    "f2_bad_query_bytes": {"bad": lambda: gate.bad_query_bytes(c("query"))},
    "f3_leading_comma": {"bad": lambda: gate.leading_comma(c("query"))},
    "f4_marks": {"in_path": lambda: gate.marked(c("path")), "in_query": lambda: gate.marked(c("query"))},
    "f5_path_marks": {"bad": lambda: gate.path_marked(c("path"))},
    "f6_any_mark": {"bad": lambda: gate.marked(c("path")) | gate.path_marked(c("path")) | gate.marked(c("query"))},
    "f7_clock": {"bad": lambda: gate.clock(c("path")) | gate.clock(c("query"))},
    "f8_bad_name": {"bad": lambda: gate.bad_name(c("query"))},
    "f9_embedded_domain": {"first": lambda: gate.embedded_domain(text.first_segment(c("path"))), "last": lambda: gate.embedded_domain(c("last"))},
    "f10_glued_domain": {"in_segment": lambda: gate.glued_domain(text.first_segment(c("path"))), "in_host": lambda: gate.glued_domain(c("auth"))},
    "f11_schema_file": {"bad": lambda: gate.schema_file(c("last"))},
    "f12_mangled_script": {"bad": lambda: gate.mangled_script(c("last"))},
    "f13_static_kind": {"kind": lambda: gate.static_kind(c("last"))},
    "f14_cut_ending": {"bad": lambda: gate.cut_ending(c("last"))},
    "f15_scanner_tag": {"bad": lambda: gate.scanner_tag(c("last"))},
    "f16_header_line": {"bad": lambda: gate.header_line(c("last"))},
    "f17_hash_junk": {"bad": lambda: gate.hash_junk(c("last"))},
    "f18_repeated_segment": {"bad": lambda: gate.repeated_segment(c("path"))},
    "f19_repeated_chunk": {"bad": lambda: gate.repeated_chunk(c("path"))},
    "f20_empty_port": {"bad": lambda: gate.empty_port(c("port"))},
    "f21_embedding_host": {"embeds": lambda: gate.host_embeds(c("host")), "shallow": lambda: gate.shallow(c("tail"))},
    "f22_garbage": {"garbage": lambda: gate.garbage(c("path"), c("query")), "reasons": lambda: F.array_join(gate.reason_names(c("path"), c("query")), ",")},
    "n1_noise": {"noise": lambda: gate.noise(c("path"))},
}
#: Columns of the table of distinct segments, and of distinct query tokens.
SEGMENT_COLUMNS: dict[str, dict[str, Callable[[], Column]]] = {
    "g3_section": {"section": lambda: segments.is_section(c("segment"))},
    "g4_number": {"number": lambda: segments.is_number(c("segment"))},
    "g5_uuid": {"uuid": lambda: segments.is_uuid(c("segment"))},
    "g6_hex": {"hex": lambda: segments.is_hex(c("segment"))},
    "g7_numbered_slug": {"slug": lambda: segments.is_numbered_slug(c("segment"))},
    "g8_text_slug": {"slug": lambda: segments.is_text_slug(c("segment"))},
    "g9_id_stem": {"stem": lambda: segments.id_stem(c("segment"))},
    "g10_mixed_id_stem": {"stem": lambda: segments.mixed_id_stem(c("segment"))},
    "g11_hashed": {"hashed": lambda: segments.is_hashed(c("segment")), "label": lambda: segments.hash_label(c("segment"))},
}
TOKEN_COLUMNS: dict[str, dict[str, Callable[[], Column]]] = {
    "q3_junk_token": {"junk": lambda: query.is_junk(c("token"))},
    "q4_value_url": {"url": lambda: query.holds_url(query.value(c("token")))},
    "q6_payload": {"payload": lambda: query.is_payload(query.value(c("token")))},
}
TEMPLATES = {"g12_templates": SurfaceOptions(), "g12_templates_folded": FOLD, "g13_raw_segments": SurfaceOptions(raw_segments=True), "g14_case_sensitive": SurfaceOptions(fold_ids=True, case_sensitive=True)}


def _fields(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(spark, sf_dir).select("ord", *(f().alias(n) for n, f in FIELD_COLUMNS[name].items()))


def _segments(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each_segment(fields(spark, sf_dir)).select("segment", *(f().alias(n) for n, f in SEGMENT_COLUMNS[name].items()))


def _tokens(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each_token(fields(spark, sf_dir)).select("token", *(f().alias(n) for n, f in TOKEN_COLUMNS[name].items()))


def _templates(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment_rows(fields(spark, sf_dir), TEMPLATES[name])


def _dedup(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dedup(urls(spark, sf_dir), options=OPTIONS[name])


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keyed(urls(spark, sf_dir)).select("ord", "sig", "base", "grp", "keys", "out")


def s1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a table's texts, cut at line feeds alone."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.posexplode(F.split("html", "\n")).alias("n", "line"))


def s2_carriage_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("url", F.repeat(F.lit("\r"), (c("page_id") % 3).cast("int"))).alias("line"))
    return made.withColumn("line", lines.stripped(c("line")))


def s3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines count: carriage returns alone, which follow every line here, don't."""
    made = s1_lines(spark, sf_dir)
    made = made.select("page_id", F.explode(F.array("line", F.lit("\r\r"))).alias("line"))
    return lines.records(made).groupBy("page_id").agg(F.count("*").alias("n"))


def s4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines out of two sources of text files: the URLs with carriage returns, and the pages' texts; how often each comes."""
    import uuid

    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.select(F.concat("url", F.repeat(F.lit("\r"), (c("page_id") % 3).cast("int")))).write.text(f"{folder}/urls")
    pages.select("html").write.text(f"{folder}/texts")
    return lines.read_lines(spark, f"{folder}/urls", f"{folder}/texts").groupBy(c("source").cast("long").alias("source"), "line").agg(F.count("*").alias("n"))


def s5_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources, the pages and all URLs; the first one's lines come first."""
    one = lines.read_table(spark, f"{sf_dir}/pages.parquet", "url", "page_id")
    rows = lines.union(one, lines.records(urls(spark, sf_dir)))
    return ops.dedup(rows).select(c("ord.source").cast("long").alias("source"), c("ord.ord").alias("ord"), "out")


def s8_ordered_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a deduplication writes as text files in order, read again: every line's place."""
    import uuid

    from pyspark.sql import Window

    folder = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    lines.write_lines(ops.dedup(urls(spark, sf_dir)), folder)
    rows = lines.read_lines(spark, folder).select("ord.*", "line").toDF("source", "file", "block", "id", "out")
    part = ["file", "block"]
    sizes = rows.groupBy(*part).agg(F.count("*").alias("n"))  # a row for each block of a file
    before = sizes.select(*part, (F.sum("n").over(Window.orderBy(*part)) - c("n")).alias("before"))
    return rows.join(before, part).select((c("before") + F.row_number().over(Window.partitionBy(*part).orderBy("id"))).alias("place"), "out")


def s7_stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the pages table, deduplicated on sight into a table."""
    import uuid

    from surfaceloom.streaming.surface import first_seen

    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id AS ord", "url AS line")
    source.repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", "100").parquet(f"{folder}/in")
    first_seen(stream, f"{folder}/out", f"{folder}/checkpoint", LOOSE).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("ord", "out")


def s9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urls(spark, sf_dir)
    return ops.stats(rows, ops.dedup(rows))


def s10_table_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dedup(lines.read_table(spark, f"{sf_dir}/pages.parquet", "url", "page_id"))


def q9_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("ord", "sig", "base", "grp")


def a1_first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_arrivals(_keyed(spark, sf_dir)).select("ord", "sig")


def a2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that pass, signatures and lines kept of each host."""
    rows = signed(gated(fields(spark, sf_dir), SurfaceOptions()), SurfaceOptions()).withColumn("host", text.lower(c("host")))
    return rows.groupBy("host").agg(F.count("*").alias("n"), F.count_distinct("sig").alias("signatures"))


def a3_decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.decorated(ops.first_arrivals(_keyed(spark, sf_dir))).select("ord", "base", "decorated")


def j1_fold_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fold_bare(ops.first_arrivals(_keyed(spark, sf_dir))).select("ord", "sig")


def j2_merge_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.merge_covered(ops.first_arrivals(_keyed(spark, sf_dir))).select("ord", "sig")


def j3_covering_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signatures that another one covers, each with every one that does."""
    return ops.covering_pairs(ops.first_arrivals(_keyed(spark, sf_dir)))


def j4_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many key sets of each size a group has: sets of one size never cover each other."""
    rows = ops.first_arrivals(_keyed(spark, sf_dir)).where("grp is not null")
    return rows.groupBy("grp", F.size("keys").cast("long").alias("size")).agg(F.count("*").alias("n"))


def j5_capped_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dedup(urls(spark, sf_dir), options=SurfaceOptions(merge_cap=2))


def j5_no_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dedup(urls(spark, sf_dir), options=SurfaceOptions(merge_cap=-1))


def o1_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dedup(urls(spark, sf_dir)).orderBy("ord")


def u2_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run adds to what a first run over some of the lines has put out."""
    rows = urls(spark, sf_dir)
    return ops.fresh(ops.dedup(rows), ops.dedup(rows.where("ord < 2000000000000")))


def w1_arrival_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's place among those of its signature."""
    from pyspark.sql import Window

    return _keyed(spark, sf_dir).select("ord", F.row_number().over(Window.partitionBy("sig").orderBy("ord")).cast("long").alias("place"))


def e2_raw_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line as it was read, beside the signature, which is the same either way."""
    return ops.keyed(urls(spark, sf_dir), options=SurfaceOptions(raw_output=True)).select("ord", "sig", "out")


def e1_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keyed(urls(spark, sf_dir)).select("ord", "out")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for many, run in ((FIELD_COLUMNS, _fields), (SEGMENT_COLUMNS, _segments), (TOKEN_COLUMNS, _tokens), (TEMPLATES, _templates), (OPTIONS, _dedup)):
        out |= {name if many is not OPTIONS else name.replace("default", "dedup"): partial(run, name) for name in many}
    for f in (s1_lines, s2_carriage_returns, s3_records, s4_files, s5_union, s7_stream_first_seen, s8_ordered_sink, s9_stats, s10_table_source, q9_signatures, a1_first_arrivals, a2_counts, a3_decorated):
        out[f.__name__] = f
    for f in (j1_fold_bare, j2_merge_covered, j3_covering_pairs, j4_set_sizes, j5_capped_merge, j5_no_merge, o1_ordered, u2_fresh, w1_arrival_rank, e1_output, e2_raw_output):
        out[f.__name__] = f
    return out
