"""Keyed tables: what a step touches, which version is read, and what failures leave."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperlane.sources.keyed import Conflict, KeyedStore, Table, Version

COLUMNS = "id long, part string, v string"


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "tables"), {"t": Table(COLUMNS, ("id", "part"), ("id",), 16), "big": Table("id long, v string", ("id",), buckets=1000), "set": Table("a string, b string", ("a", "b"), ("a",), 4)})


def rows(spark, *values):
    return spark.createDataFrame(list(values), COLUMNS)


def content(store, name="t", **how):
    return sorted(map(tuple, store.read(name, **how).collect()), key=repr)


def files(store, name):
    return {str(p.relative_to(store.root)) for p in Path(store.root, name, "data").rglob("*.parquet")}


def test_changes_are_merged_by_version(spark, store):
    assert content(store) == [] and store.version("t") == 0
    assert store.upsert("t", rows(spark, (1, "a", "x"), (1, "b", "x"), (2, None, "x"), (None, None, "x"), (1, "a", "w")), order="v") == 4
    assert store.upsert("t", rows(spark, (1, "a", "y"), (None, None, "y"), (3, "c", "y"))) == 3
    assert store.erase("t", spark.createDataFrame([(1, "b"), (2, None), (9, "none")], "id long, part string")) == 3
    assert content(store) == [(1, "a", "y"), (3, "c", "y"), (None, None, "y")]
    assert store.upsert("t", rows(spark, (1, "b", "z"))) == 1 and content(store) == [(1, "a", "y"), (1, "b", "z"), (3, "c", "y"), (None, None, "y")]
    assert content(store, number=3) == [(1, "a", "y"), (3, "c", "y"), (None, None, "y")]  # the version before stays readable
    before = content(store)
    assert store.compact("t") > 0 and content(store) == before and store.compact("t") == 0
    assert all(len(w) == 1 for w in store.state("t").writes.values())
    assert store.upsert("t", rows(spark, (7, "q", "q")).limit(0)) == 0 and content(store) == before


def test_insert_adds_what_is_not_there(spark, store):
    pair = lambda *v: spark.createDataFrame(list(v), "a string, b string")
    assert store.insert("set", pair(("x", "1"), ("x", "1"), ("x", None), ("y", "1"))) == 3
    assert store.insert("set", pair(("x", "1"), ("x", None), ("x", "2"))) == 1
    assert content(store, "set") == [("x", "1"), ("x", "2"), ("x", None), ("y", "1")]
    assert store.write("set", pair(("z", "1"))) == 1 and content(store, "set") == [("z", "1")]
    assert store.write("set", pair(("z", "1")).limit(0)) == 0 and content(store, "set") == []


def test_one_percent_touches_its_buckets_only(spark, store):
    """A hundredth of the keys, in as many buckets as they fall in; all other files stay as they are."""
    store.write("big", spark.range(20_000).selectExpr("id", "'old' as v"))
    before, stamps = files(store, "big"), {}
    for f in before:
        stamps[f] = os.stat(f"{store.root}/{f}").st_mtime_ns
    few = spark.range(0, 20_000, 100).selectExpr("id", "'new' as v")
    touched = set(store.buckets_of("big", few))
    assert store.upsert("big", few) == 200 and 100 < len(touched) <= 200
    after = files(store, "big")
    assert before < after and all(os.stat(f"{store.root}/{f}").st_mtime_ns == stamps[f] for f in before)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in after - before} == touched
    got = store.read("big").groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {"old": 19_800, "new": 200}
    some = sorted(touched)[:3]
    plan = store.read("big", some)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in plan.inputFiles()} == set(some)  # a step that knows its keys reads their buckets only
    # the changed buckets are put together; the others keep their files
    assert store.compact("big") == len(touched)
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept <= files(store, "big") and store.read("big").filter("v = 'new'").count() == 200


def test_a_crash_leaves_the_old_version(spark, store):
    store.upsert("t", rows(spark, (1, "a", "x"), (2, "b", "x")))
    broken = F.udf(lambda i: 1 / (i - 5) and "y", "string")  # fails when the last rows are written
    with pytest.raises(Exception):
        store.upsert("t", spark.range(200).repartition(8).select("id", F.lit("p").alias("part"), broken("id").alias("v")))
    assert content(store) == [(1, "a", "x"), (2, "b", "x")] and store.version("t") == 1
    left = [p for p in Path(store.root, "t", "data").iterdir() if p.name.startswith("write=00000002")]
    assert store.upsert("t", rows(spark, (2, "b", "y"))) == 1 and content(store) == [(1, "a", "x"), (2, "b", "y")]
    assert not any(p.exists() for p in left)  # what the failed step left is gone


def test_a_second_writer_fails(spark, store):
    store.upsert("t", rows(spark, (1, "a", "x")))
    with pytest.raises(Conflict):
        store._commit("t", Version(1, {}, {}))
    assert content(store) == [(1, "a", "x")]


def test_many_changes_are_put_together(spark, store):
    for k in range(store.most_changes + 3):
        store.upsert("t", rows(spark, (1, "a", f"v{k:02d}"), (k, "b", "x")))
    assert max(map(len, store.state("t").writes.values())) <= store.most_changes
    assert (1, "a", f"v{store.most_changes + 2:02d}") in content(store) and len(content(store)) == store.most_changes + 4
    assert len(os.listdir(f"{store.root}/t/manifest")) <= 2 * store.keep  # with checksum files
