"""Deduplication of URLs: cases by hand, options, order, and properties over many shapes."""

import itertools

import pytest

from surfaceloom.operators.dedup import _CappedGroup, dedup, fresh, keyed, stats
from surfaceloom.options import SurfaceOptions
from surfaceloom.sources.lines import read_lines, union, write_lines

H = "https://h.example.com"


def run(spark, lines, **options):
    df = spark.createDataFrame(list(enumerate(lines)), "ord long, line string")
    return [r.out for r in dedup(df, options=SurfaceOptions(**options)).orderBy("ord").collect()]


CASES = [
    # numeric ids stay, unless they fold or stand under a listing word
    ([f"{H}/v1/users/1", f"{H}/v1/users/2"], {}, [f"{H}/v1/users/1", f"{H}/v1/users/2"]),
    ([f"{H}/v1/users/1", f"{H}/v1/users/2"], {"fold_ids": True}, [f"{H}/v1/users/1"]),
    ([f"{H}/products/41", f"{H}/products/42"], {}, [f"{H}/products/41"]),
    # titles fold, short leaves stay
    ([f"{H}/blog/how-i-wrote-a-parser", f"{H}/blog/what-we-learned-here", f"{H}/news/2024-recap"], {}, [f"{H}/blog/how-i-wrote-a-parser", f"{H}/news/2024-recap"]),
    ([f"{H}/blog/how-i-wrote-a-parser", f"{H}/blog/what-we-learned-here"], {"raw_segments": True}, [f"{H}/blog/how-i-wrote-a-parser", f"{H}/blog/what-we-learned-here"]),
    # key sets: covered ones go, whatever the order; repeats count
    ([f"{H}/s?id=1", f"{H}/s?id=2", f"{H}/s?role=1", f"{H}/s?id=3&role=2"], {}, [f"{H}/s?id=3&role=2"]),
    ([f"{H}/p?id=1&token=2", f"{H}/p?token=3&id=4", f"{H}/p?id=1&id=2"], {}, [f"{H}/p?id=1&token=2", f"{H}/p?id=1&id=2"]),
    ([f"{H}/p?id=1", f"{H}/p?id=1&id=2"], {}, [f"{H}/p?id=1&id=2"]),
    # a bare endpoint goes if it has a decorated sibling, before or after
    ([f"{H}/a", f"{H}/a?x=1"], {}, [f"{H}/a?x=1"]),
    ([f"{H}/a;v=1/b", f"{H}/a/", f"{H}/b"], {}, [f"{H}/a;v=1/b", f"{H}/b"]),
    # assets
    ([f"{H}/a.css", f"{H}/a.js.map", f"{H}/a.PNG", f"{H}/a.json"], {}, [f"{H}/a.js.map", f"{H}/a.json"]),
    ([f"{H}/a.css?x=1"], {"keep_assets": True}, [f"{H}/a.css"]),
    ([f"{H}/a.css", f"{H}/a{{b}}"], {"keep_invalid": True}, [f"{H}/a{{b}}"]),
    # one form for hosts, ports, slashes, index documents and fragments
    (["HTTP://H.Example.com:80//A//index.html#x", "http://h.example.com/a"], {}, ["http://h.example.com/A"]),
    (["http://h.example.com/A", "http://h.example.com/a"], {"case_sensitive": True}, ["http://h.example.com/A", "http://h.example.com/a"]),
    (["https://https://h.example.com/x"], {}, [f"{H}/x"]),
    (["https://2f2fh.example.com/x"], {}, [f"{H}/x"]),
    (["https://2f2fh.example.com/x"], {"raw_hosts": True}, ["https://2f2fh.example.com/x"]),
    ([f"{H}//x/#top"], {"raw_output": True}, [f"{H}//x/#top"]),
    # payload values are blanked, targets of redirects stay
    ([f"{H}/p?q=1+union+select", f"{H}/r?next=//evil.example"], {}, [f"{H}/p?q=", f"{H}/r?next=//evil.example"]),
    ([f"{H}/g?query={{me}}", f"{H}/g?query={{you}}", f"{H}/g"], {}, [f"{H}/g?query={{me}}", f"{H}/g?query={{you}}"]),
    # every value counts, and what is put out is clean all the same
    ([f"{H}/x?a=1", f"{H}/x?a=2", f"{H}/x"], {"whole_query": True}, [f"{H}/x?a=1", f"{H}/x?a=2", f"{H}/x"]),
    # surprising drops
    (["http://www.company.com/x", f"{H}/web.config", f"{H}/a.c", f"{H}/x/a01", f"{H}/x.jsp;jsessionid=A"], {}, []),
    (["", None, f"{H}/a"], {}, [f"{H}/a"]),
    ([], {}, []),
]


@pytest.mark.parametrize("lines,options,expected", CASES, ids=range(len(CASES)))
def test_cases(spark, lines, options, expected):
    assert run(spark, lines, **options) == expected


SHAPES = [f"{H}/{p}{q}" for p, q in itertools.product(("a", "b/", "c;v=1", "item/7", "x/y-z-00000000001"), ("", "?k=1", "?k=1&m=2", "?m=1&k=3&m=4", "?z", "?debug", "?ssl"))]


def test_properties(spark):
    once = run(spark, SHAPES)
    assert run(spark, once) == once
    sig = lambda lines: {r.sig for r in keyed(spark.createDataFrame(list(enumerate(lines)), "ord long, line string")).collect()}
    assert sig(run(spark, SHAPES[::-1])) == sig(once)


def test_cap(spark):
    lines = [f"{H}/a?{'&'.join(f'{k}=1' for k in ks)}" for n in (1, 2, 3) for ks in itertools.combinations("pqrs", n)]
    assert run(spark, lines, merge_cap=1000) == run(spark, lines)
    assert len(run(spark, lines, merge_cap=-1)) == len(lines)
    assert len(run(spark, lines)) <= len(run(spark, lines, merge_cap=1)) < len(lines)
    group = _CappedGroup(1)
    for i, keys in enumerate(("a", "b", "ab")):
        group.take(i, frozenset(keys))
    assert group.gone == {1}  # one comparison: the newest of the smaller ones


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(f"{H}/2\r\n\r\n{H}/1\r\r\n{H}/x\ry".encode())
    (tmp_path / "b.txt").write_bytes(f"{H}/1\n{H}/3\n".encode())
    rows = read_lines(spark, str(tmp_path / "b.txt"), str(tmp_path / "a.txt"))
    assert [r.line for r in rows.orderBy("ord").collect()] == [f"{H}/1", f"{H}/3", f"{H}/2", f"{H}/1", f"{H}/x\ry"]
    kept = dedup(rows)
    write_lines(kept, str(tmp_path / "out"), single_file=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [f"{H}/1", f"{H}/3", f"{H}/2"]
    assert tuple(stats(rows, kept).first()) == (5, 3)
    with pytest.raises(ValueError):
        read_lines(spark)


def test_union_and_fresh(spark):
    a, b = (spark.createDataFrame(list(enumerate(x)), "ord long, line string") for x in ([f"{H}/1", f"{H}/2"], [f"{H}/2", f"{H}/3"]))
    both = dedup(union(b, a))
    assert [r.out for r in both.orderBy("ord").collect()] == [f"{H}/2", f"{H}/3", f"{H}/1"]
    assert [r.out for r in fresh(both, dedup(a)).collect()] == [f"{H}/3"]


def test_streams(spark, tmp_path):
    from surfaceloom.streaming.surface import first_seen, on_sight, refresh

    for i, lines in enumerate(([f"{H}/1", f"{H}/1#x", f"{H}/2"], [f"{H}/2/", f"{H}/2?a=1", f"{H}/3"])):
        spark.createDataFrame([(10 * i + j, x) for j, x in enumerate(lines)], "ord long, line string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ord long, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    loose = SurfaceOptions(keep_invalid=True)
    first_seen(stream(), str(tmp_path / "out"), str(tmp_path / "c1"), loose).awaitTermination()
    assert sorted(r.out for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"{H}/1", f"{H}/2", f"{H}/2?a=1", f"{H}/3"]
    refresh(stream(), str(tmp_path / "lines"), str(tmp_path / "kept"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.out for r in spark.read.parquet(str(tmp_path / "kept/version=1")).collect()) == [f"{H}/1", f"{H}/2?a=1", f"{H}/3"]
    with pytest.raises(ValueError):
        on_sight(stream(), SurfaceOptions())
    assert on_sight(stream(), loose).isStreaming


def test_plan_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(0, H)], "ord long, line string")
    plan = dedup(df)._jdf.queryExecution().executedPlan().toString()
    before, after = plan.index("partial_min_by"), plan.index("Exchange")
    assert before > after  # of each signature a task sends one row: the plan is told from its end
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
