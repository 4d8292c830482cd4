"""The pipeline against a plain version of its stages, and the oracles of the corpus operators."""

import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from surfaceloom.llm import common, jaccard
from surfaceloom.llm.registry import ORACLES, QUERIES
from tests.llm.test_corpus_operators import WORD, base_spans, linked, unpacked

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append({r.doc_id: r for r in docs.collect()} if i < 4 else docs.collect())
        assert i == 4 or docs.columns == columns
    clean, single, blank, mixed, pieces = kept
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in clean) >= 0.98 * sum(v == 0 for v in labels.values())
    component = linked([(i, r.text) for i, r in clean.items()], 5, 80, 100)
    assert set(single) == {i for i, (_, c) in component.items() if i == c}
    assert set(blank) == set(single) and not any(base_spans(r.text) for r in blank.values())
    assert all(blank[i].text == r.text for i, r in single.items() if "[SECRET]" not in blank[i].text)
    total, taken = (sum(len(WORD.findall(r.text)) for r in x.values()) for x in (blank, mixed))
    assert abs(taken - 1.5 * total) < 0.02 * total and set(mixed) <= set(blank)
    found, _ = unpacked(pieces)
    assert set(found) == set(mixed) and all(sum(x[0] for x in p.values()) == next(iter(p.values()))[2] for p in found.values())


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, a), (9, a), (None, a), (5, b), (None, b), (None, c), (None, c), (None, ""), (3, None)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), DIR)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(5, a), (5, b), (None, c), (None, ""), (3, None)], "doc_id long, text string").collect()))


def test_near_copies_store_packed_texts_alone(spark, tmp_path, monkeypatch):
    rng, rows = random.Random(9), []
    vocabulary = [f"palabra{i}" for i in range(300)]
    for i in range(60):
        words = rng.choices(vocabulary, k=400)
        rows += [(4 * i + k, " ".join(words[: 400 - k]), rng.randbytes(2000)) for k in range(4)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, extra binary").write.parquet(path)
    stored = {}

    def settle(df, name="table"):
        out = common.settle(df, name)
        stored[out.settled_at] = sum(p.stat().st_size for p in Path(out.settled_at.removeprefix("file:")).glob("*.parquet"))
        return out

    for module in (jaccard, corpus_pipeline):
        monkeypatch.setattr(module, "settle", settle)
    monkeypatch.setattr(common, "numbered", lambda docs: settle(docs))
    got = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(path), DIR)
    assert sorted(r.doc_id for r in got.collect()) == [4 * i for i in range(60)] and got.columns == ["doc_id", "text", "extra"]
    assert len(stored) > 5  # neither the rows nor the texts as they are
    assert sum(stored.values()) < 0.6 * sum(len(t) for _, t, _ in rows)


def test_packed_texts_are_the_texts():
    texts = ["", None, "a", "ñ " * 9000, "z" * 2_000_000, "b c", "x" * 400_000, "y" * 300_000, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), common.packed_texts(pa.array(texts))], ["class", "text"])
    assert batch.nbytes < 10_000
    slices = list(common.unpacked_slices(batch))
    assert [x for s in slices for x in s.column("text").to_pylist()] == [(t or "").encode() for t in texts]
    assert [x for s in slices for x in s.column("class").to_pylist()] == list(range(9))
    assert all(s.num_rows == 1 or s.nbytes < 2 * common.SLICE_BYTES for s in slices) and len(slices) > 3


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    got, expected = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_every_operator_has_one_query():
    import __spark_entry__

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert {"pipeline", *QUERIES} < set(__spark_entry__.queries()) and set(ORACLES) < set(__spark_entry__.oracle_sql())
