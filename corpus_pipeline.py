"""A pipeline from raw documents to training sequences; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surfaceloom.llm import jaccard, mixing, packing, secrets, toxicity
from surfaceloom.llm.common import settle, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this table's labels, calls toxic go.

    Null, empty and very long texts are scored as they are, repeated rows alike; clean rows stay whatever else they hold,
    null ids too. Extra columns stay, whatever their names. An empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    # a row stands in one column, so that no name of its own can clash
    return toxicity.score(docs.select(F.struct("*").alias("row"), "text"), model, ("row",)).where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that shingles of five words link at 0.8 or more, one with the smallest doc_id stays (none comes last).

    Repeated rows are such rows. Null, empty and blank texts link with nothing and stay, each of them; very long texts are
    compared as a whole. Ties go to the smaller hash of the text. Extra columns stay. An empty table stays empty.
    """
    docs = stored(docs, "rows")
    # a row stands in one column, so that no name of its own can clash
    rows = jaccard.marked(docs, F.struct("*").alias("row"))
    found = jaccard.grouped(rows.drop("row"), 5, 80, 100)
    heads = found.where("n_shingles > 0").groupBy("root").agg(F.min(jaccard.first_row()).alias("first")).select("first.doc_id", "first.mark", F.lit(True).alias("one"))
    stay = heads.unionAll(found.where("n_shingles = 0").select("doc_id", "mark", F.lit(False)).distinct())
    keys = ["none", "id", "mark"]
    keyed = lambda df, *more: df.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "mark", *more)
    # repeated rows share the keys: the join has them together already
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.col("row").cast("string"))))
    return keyed(rows, "row").join(keyed(stay, "one").hint("merge"), keys).withColumn("nth", nth).where("not one or nth = 1").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is blanked; the documents stay, repeated ones and those without id, text or words too.

    Very long texts are scanned as a whole; extra columns stay; an empty table stays empty.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document's text becomes the words that the mix takes of it, repeats included.

    Every row takes its own words, repeated ones and those without an id too; a null source is a source. Rows without words
    stay as they are. Extra columns stay. An empty table stays empty.
    """
    return mixing.remix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences; null and empty texts have an end id alone. An empty table has none."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: No stage of this pipeline as a whole can be told in SQL; tests/llm hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all sequences that the stages make of documents, each stage's rows written and read again. Odd
    rows and tables fare as the stages say.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
