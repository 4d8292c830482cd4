"""The staged plan of a deduplication: parse, gate, signature. Each stage is a projection or a filter, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfaceloom.functions import gate, query, segments, text
from surfaceloom.options import SurfaceOptions


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once a row, whatever is built on them.

    Projections alone would be merged, and every use of a column would compute it anew; a generator of one row is a line
    that the optimizer doesn't draw expressions across, and it stays inside code generation.
    """
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def parsed(df: DataFrame, line: str = "line") -> DataFrame:
    """df with scheme, auth (authority), host, port, default_port, tail (behind the authority), path, query and last."""
    scheme, rest = text.scheme_repair(F.col(line))
    cut = staged(df, scheme=scheme, rest_=rest)
    cut = staged(cut, auth=text.authority(F.col("rest_")))
    cut = staged(cut, host=text.host(F.col("auth")), port=text.port(F.col("auth")), tail=F.substring(F.col("rest_"), F.length("auth") + 1, F.length("rest_")))
    path = text.path(F.col("tail"))
    fields = staged(cut, default_port=text.default_port(F.col("scheme"), F.col("port")), path=path, query=text.query(F.col("tail")), last=text.last_segment(path))
    return fields.drop("rest_")


def gated(df: DataFrame, options: SurfaceOptions) -> DataFrame:
    """Rows of a parsed table that the gate and the asset filter let through."""
    path, asked = F.col("path"), F.col("query")
    if not options.keep_invalid:
        df = df.where(~gate.bad_host(F.col("auth"), F.col("host"), F.col("port"), F.col("tail"))).where(~gate.garbage(path, asked, F.col("last")))
    return df if options.keep_assets else df.where(~gate.noise(path))


def query_counts(options: SurfaceOptions) -> Column:
    """Whether there is a query that counts: a static file's doesn't."""
    there = F.coalesce(F.col("query") != "", F.lit(False))
    return there if options.keep_invalid else there & (gate.static_kind(F.col("last")) != 1)


def clean_host(options: SurfaceOptions) -> Column:
    host = text.lower(F.col("host"))
    return host if options.raw_hosts else text.clean_host(host)


def signed(df: DataFrame, options: SurfaceOptions) -> DataFrame:
    """A parsed table with sig, base, grp (null: no key set), keys and out."""
    all_ = segments.segments(F.col("path"))
    parts = staged(df, asked_=query_counts(options), host_=clean_host(options), all_=all_, kept_=segments.kept_segments(all_))
    site = F.concat(text.lower(F.col("scheme")), F.lit("://"), F.col("host_"), F.when(F.col("port").isNotNull() & ~F.col("default_port"), F.concat(F.lit(":"), F.col("port"))).otherwise(""), F.lit("/"))
    whole = F.col("asked_") & (F.lit(True) if options.whole_query else query.is_graph_query(F.col("query")))
    parts = staged(parts, site_=site, path_=F.array_join(segments.tokens(F.col("all_"), F.col("kept_"), options), "/"), whole_=whole)
    parts = staged(parts, front_=F.concat("site_", "path_"), keys_=F.when(F.col("asked_") & ~F.col("whole_"), query.keys(F.col("query"), options)))
    named = F.coalesce(F.size("keys_") > 0, F.lit(False))
    sig = F.concat("front_", F.when(F.col("whole_"), F.concat(F.lit("?"), F.col("query"))).when(named, F.concat(F.lit("?"), F.array_join("keys_", "&"))).otherwise(""))
    rest = F.when(F.col("asked_"), query.clean(F.col("query"), options)).otherwise("")
    out = F.concat("site_", F.array_join("kept_", "/"), F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))
    made = staged(
        parts,
        sig=sig,
        grp=F.when(named, F.concat("front_", F.lit("?"))) if options.merging else F.lit(None).cast("string"),
        keys=F.when(named, F.col("keys_")),
        out=F.col("line") if options.raw_output else out,
    )
    return made.withColumn("base", F.regexp_extract("sig", "(?s)^[^;?]*", 0)).drop("asked_", "host_", "all_", "kept_", "site_", "path_", "front_", "whole_", "keys_")
