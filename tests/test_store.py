"""Stores with versions: updates of touched buckets only, jobs that die between steps, writers that meet, odd rows."""

import pytest
from pyspark.sql import functions as F

from sextant.functions.text import url_parts
from sextant.operators import sessions
from sextant.sources.store import Store

SCHEMA = "item_id int, name string, vector array<double>"


def rows(spark, data):
    return spark.createDataFrame([(i, n, [float(i or 0)]) for i, n in data], SCHEMA)


def content(df):
    return sorted((r.item_id, r.name) for r in df.collect())


def test_updates_rewrite_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "s")
    a = Store.create(rows(spark, [(i, "a") for i in range(200)] + [(None, "x")]), path, "item_id", 16)
    b = a.upsert(rows(spark, [(3, "b"), (900, "b"), (None, "y")]))
    changed = {k for k in b.folders if b.folders[k] != a.folders.get(k)}
    assert len(changed) == len(set(a._touched(rows(spark, [(3, ""), (900, "")])))) <= 2
    want = sorted([(i, "a") for i in range(200) if i != 3] + [(3, "b"), (900, "b")])
    assert content(Store.open(spark, path).read()) == want and content(a.read()) == [(i, "a") for i in range(200)]
    c = b.delete(rows(spark, [(i, "") for i in range(200)]).select("item_id"))
    assert content(c.read()) == [(900, "b")] and len(c.folders) == 1
    c.vacuum()
    assert content(Store.open(spark, path).read()) == [(900, "b")] and Store.open(spark, path).version == 3
    d = c.delete(rows(spark, [(900, "")]))
    assert content(d.read()) == content(Store.open(spark, path).read()) == [] and d.upsert(rows(spark, [(1, "z")])).read().count() == 1


def test_a_job_that_dies_leaves_the_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    a = Store.create(rows(spark, [(1, "a"), (2, "a")]), path, "item_id", 4)

    def dies(self):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", dies)
        for change in (lambda: a.upsert(rows(spark, [(1, "b")])), lambda: a.delete(rows(spark, [(1, "")])), lambda: Store.create(rows(spark, []), path, "item_id")):
            with pytest.raises(RuntimeError):
                change()
            assert content(Store.open(spark, path).read()) == [(1, "a"), (2, "a")]
    # A manifest that was begun only doesn't count.
    (tmp_path / "s/manifest/00000002").mkdir()
    assert Store.open(spark, path).version == 1
    (tmp_path / "s/manifest/00000002").rmdir()
    b = a.upsert(rows(spark, [(1, "b")]))
    with pytest.raises(Exception, match="(?i)exists"):
        a.upsert(rows(spark, [(2, "c")]))
    assert content(Store.open(spark, path).read()) == content(b.read()) == [(1, "b"), (2, "a")]


def test_repeated_keys_and_merges(spark, tmp_path):
    data = [(1, x) for x in "abcdef"]
    got = {tuple(content(Store.create(rows(spark, d).repartition(n), str(tmp_path / f"r{n}{d[0][1]}"), "item_id").read())) for d in (data, data[::-1]) for n in (1, 3)}
    assert len(got) == 1 and len(next(iter(got))) == 1
    empty = Store.create(rows(spark, []), str(tmp_path / "e"), "item_id")
    assert content(empty.read()) == [] and empty.read().columns == ["item_id", "name", "vector"]
    s = lambda d: spark.createDataFrame(d, "session_id string, created_at int, updated_at int")
    store = Store.create(s([("a", 1, 1), ("b", 1, 1)]), str(tmp_path / "m"), "session_id").upsert(s([("a", 5, 6), ("c", 7, 7)]), sessions.upsert)
    assert sorted(map(tuple, store.read().collect())) == [("a", 1, 6), ("b", 1, 1), ("c", 7, 7)]
    with pytest.raises(FileNotFoundError):
        Store.open(spark, str(tmp_path / "none"))


def test_url_parts(spark):
    urls = ["HTTP://user:pw@Host.Example:8080/a/b?x=1&y=&x=a%20b+c&z=%zz#frag?no=1", "no address at all", "", None, "s://h|t?k", "//h/p?=v"]
    parts = url_parts(F.col("u"))
    got = [tuple(r) for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(*[parts[c] for c in ("scheme", "host", "port", "path", "query")], parts["params"].cast("string")).collect()]
    assert got == [
        ("http", "host.example", "8080", "/a/b", "x=1&y=&x=a%20b+c&z=%zz", "[{x, 1}, {x, a b c}, {z, %zz}]"), ("", "", "", "no address at all", "", "[]"), ("", "", "", "", "", "[]"),
        (None,) * 6, ("s", "h|t", "", "", "k", "[]"), ("", "h", "", "/p", "=v", "[{, v}]"),
    ]
