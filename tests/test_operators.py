import itertools

import pytest
from pyspark.sql import functions as F

from kvlake.functions.ranges import KeyRange
from kvlake.operators import compaction, lww, scan, validate
from kvlake.operators.compaction import CompactionConfig, due_levels, level_due

LOG = "key binary, value binary, seq bigint, is_delete boolean"


def log(spark, rows):
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), s, v is None) for k, v, s in rows], LOG)


def test_latest_and_live(spark):
    found = log(spark, [(b"a", b"1", 1), (b"a", b"", 2), (b"b", b"1", 1), (b"b", None, 3), (b"c", b"x", 5), (b"c", None, 4)])
    assert {bytes(r.key): (bytes(r.value), r.seq) for r in lww.live(found, ["key"]).collect()} == {b"a": (b"", 2), b"c": (b"x", 5)}


def test_null_of_the_newest_wins(spark):
    df = spark.createDataFrame([(1, 2.0, 1), (1, None, 2)], "k int, v double, s int")
    assert lww.live(lww.log_of(df, ["k"], ["v"], "s"), ["k"]).first().v is None


@pytest.mark.parametrize("start,end,a,b", [(s, e, a, b) for s, e in itertools.product((None, b"key_005"), (None, b"key_020")) for a, b in itertools.product((True, False), repeat=2)])
def test_all_bounds(spark, start, end, a, b):
    keys = [f"key_{i:03}".encode() for i in (5, 10, 15, 20, 25)]
    rows = log(spark, [(k, b"v", i) for i, k in enumerate(keys)])
    within = KeyRange(start and bytearray(start), end and bytearray(end), a, b)
    expected = [k for k in keys if (start is None or k > start or a and k == start) and (end is None or k < end or b and k == end)]
    assert [bytes(r.key) for r in scan.scan(rows, within).collect()] == expected


def test_inverted_and_prefix(spark):
    rows = log(spark, [(w.encode(), b"v", i) for i, w in enumerate(["apple", "application", "banana", "band", "bandana"])] + [(b"\xff\xff", b"v", 9)])
    assert scan.scan(rows, KeyRange(bytearray(b"z"), bytearray(b"a"))).count() == 0
    assert [bytes(r.key) for r in scan.scan_prefix(rows, bytearray(b"band")).collect()] == [b"band", b"bandana"]
    assert [bytes(r.key) for r in scan.scan_prefix(rows, bytearray(b"\xff")).collect()] == [b"\xff\xff"]
    assert scan.scan_prefix(rows, b"").count() == 6


def test_key_filters_reach_the_scan(spark, tmp_path):
    log(spark, [(b"a", b"1", 1)]).write.parquet(str(tmp_path / "log"))
    rows = spark.read.parquet(str(tmp_path / "log"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan(scan.get(rows, bytearray(b"a")))
    pushed = plan(scan.scan_prefix(rows, bytearray(b"a")))
    assert "GreaterThanOrEqual(key" in pushed and "LessThan(key" in pushed


def test_merge_keeps_the_newest_source(spark):
    newer, older = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "new"), (2, None)], [(1, "old"), (2, "old"), (3, "old")]))
    assert {r.k: (r.v, r.source) for r in lww.merged([newer, older], ["k"], ["v"]).collect()} == {1: ("new", 0), 2: (None, 0), 3: ("old", 1)}


@pytest.mark.parametrize("levels,expected", [
    ([], None), ([(4, 40)], None), ([(5, 50)], 0), ([(0, 0), (2, 10)], None), ([(0, 0), (3, 10)], 1), ([(0, 0), (3, 20), (1, 10)], 1),
    ([(0, 0), (3, 19), (1, 10)], None), ([(0, 0), (3, 19), (1, 0)], 1), ([(0, 0), (3, 19), (3, 10)], 2), ([(5, 1), (3, 20), (1, 10)], 0),
])
def test_planner(spark, levels, expected):
    config = CompactionConfig(4, 2, 3)
    assert level_due(levels, config) == expected
    # Each level's bytes are those of its first table. A level without tables isn't in the metadata; it is never due.
    rows = [(level, size if i == 0 else 0) for level, (tables, size) in enumerate(levels) for i in range(tables)]
    found = due_levels(spark.createDataFrame(rows, "level int, size bigint"), config).collect()
    assert [r.level for r in found] == ([] if expected is None else [expected])


def test_compaction_merge(spark):
    rows = log(spark, [(b"a", b"1", 1), (b"a", None, 2), (b"b", b"1", 1)])
    assert compaction.merge(rows, drop_deletes=True).count() == 1
    assert compaction.merge(rows, drop_deletes=False).where("is_delete").count() == 1


def test_validators(spark):
    tables = spark.createDataFrame([(0, 1, 10, 20), (1, 1, 20, 30), (2, 1, 31, 25), (3, 0, 1, 99), (4, 0, 5, 6), (4, 2, 1, 2)], "id bigint, level int, min_key int, max_key int")
    assert [(r.id, r.n) for r in validate.duplicate_ids(tables).collect()] == [(4, 2)]
    assert sorted((r.id, r.violation) for r in validate.misordered(tables).collect()) == [(1, "overlaps"), (2, "inverted")]
    assert validate.inconsistent(tables, tables.where("id != 1")).collect()[0][:] == (1, 3, 2)
    assert {r.check for r in validate.all_violations(tables.withColumn("x", F.lit(1)), 4).collect()} == {"duplicate id", "key order", "next id"}
