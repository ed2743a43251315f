import random

import pytest

from kvlake.functions.ranges import KeyRange
from kvlake.operators.compaction import CompactionConfig
from kvlake.sources.manifest import ConflictError, Edit, Manifest, TableMeta, replay
from kvlake.store import InvalidInputError, ReadOnlyError, Store, StoreConfig
from kvlake.streaming.ingest import ingest

SMALL = StoreConfig(compaction=CompactionConfig(2, 2, 3))


def content(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def test_contract(spark, tmp_path):
    with Store(spark, f"{tmp_path}/s") as s:
        for i in (2, 3, 1):
            s.set(f"key{i}".encode(), f"value{i}".encode())
        s.set(b"key1", b"again")
        s.set(b"empty", b"")
        s.delete(b"key3")
        assert (s.get(b"key1"), s.get(b"key3"), s.get(b"none"), s.get(b"empty")) == (b"again", None, None, b"")
        assert content(s.scan()) == [(b"empty", b""), (b"key1", b"again"), (b"key2", b"value2")]
        assert s.flush() and not s.flush()
        assert content(s.scan_prefix(b"key")) == [(b"key1", b"again"), (b"key2", b"value2")]
        s.set(b"key2", b"newer")
        assert content(s.scan(KeyRange(b"key2"))) == [(b"key2", b"newer")]
        with pytest.raises(ReadOnlyError):
            Store(spark, f"{tmp_path}/s")
        with pytest.raises(InvalidInputError):
            s.set(b"k", None)
        s.view("kv")
        assert spark.sql("SELECT count(*) FROM kv WHERE value = X'6e65776572'").first()[0] == 1
    with pytest.raises(ReadOnlyError):
        s.set(b"a", b"b")
    with Store(spark, f"{tmp_path}/s") as s:
        assert s.get(b"key2") == b"newer" and s.get(b"key3") is None
        row = s.status().first()
        assert (row.tables, row.entries, row.log_batches) == (1, 4, 1)
        assert s.violations().isEmpty()


def test_bulk_writes(spark, tmp_path):
    with Store(spark, f"{tmp_path}/s") as s:
        rows = spark.range(100).selectExpr("cast(format_string('key_%03d', id) as binary) AS key", "cast(concat('v', id) as binary) AS value", "id % 10 = 0 AS is_delete")
        assert s.write(rows, batch_id=7) == 0 and s.write(rows, batch_id=7) is None
        assert s.scan(KeyRange(b"key_010", b"key_020", end_included=True)).count() == 9
        twice = spark.createDataFrame([(bytearray(b"k"), bytearray(b"1"), 1), (bytearray(b"k"), bytearray(b"2"), 2)], "key binary, value binary, n int")
        with pytest.raises(InvalidInputError):
            s.write(twice)
        s.write(twice, order="n")
        assert s.get(b"k") == b"2"


def test_snapshot_reads(spark, tmp_path):
    with Store(spark, f"{tmp_path}/s") as s:
        for v in (b"1", b"2"):
            s.set(b"k", v)
            s.flush()
        assert content(s.scan(version=0)) == [(b"k", b"1")] and content(s.scan()) == [(b"k", b"2")]


def test_random_model(spark, tmp_path):
    """Random puts, deletes, flushes, compactions and re-openings against a dict."""
    rnd, model, path = random.Random(5), {}, f"{tmp_path}/s"
    s = Store(spark, path, SMALL)
    for step in range(1200):
        key = f"k{rnd.randrange(60):02}".encode()
        what = rnd.random()
        if what < 0.70:
            model[key] = value = f"v{step}".encode() if rnd.random() < 0.9 else b""
            s.set(key, value)
        elif what < 0.983:
            model.pop(key, None)
            s.delete(key)
        elif what < 0.994:
            s.flush()
        elif what < 0.997:
            s.compact()
        else:
            s.close()
            s = Store(spark, path, SMALL)
        if step % 100 == 99:
            assert content(s.scan()) == sorted(model.items())
            assert s.get(key) == model.get(key)
            assert s.violations().isEmpty()
    s.flush()
    while s.compact():
        pass
    assert content(s.scan()) == sorted(model.items())
    s.close()


def meta(i, level=0):
    return TableMeta(i, level, 1024, 100, b"\x01\x02\x03", b"\x09\x08\x07")


def test_replay():
    flush = lambda seq, i: Edit("flush", seq, added=[meta(i)])
    state = replay([flush(0, 0), flush(1, 1)])
    assert (len(state.levels()[0]), state.next_table_id) == (2, 2)
    state = replay([flush(0, 0), flush(1, 1), Edit("begin_compaction", 2), Edit("commit_compaction", 3, deleted=[0, 1], added=[meta(2, 1)])])
    assert ([len(x) for x in state.levels()], state.next_table_id) == ([0, 1], 3)
    state = replay([flush(0, 0), Edit("snapshot", 1, added=[meta(5, 1)], next_table_id=10), flush(2, 10)])
    assert (sorted(state.tables), state.next_table_id) == ([5, 10], 11)


def test_commits_conflict(spark, tmp_path):
    m = Manifest(spark, f"{tmp_path}/m")
    before = m.state()
    after = m.commit(Edit("flush", added=[meta(0)]), before)
    with pytest.raises(ConflictError):
        m.commit(Edit("flush", added=[meta(1)]), before)
    for i in range(1, 120):
        after = m.commit(Edit("flush", wal_ids=[i], added=[meta(i)]), after)
    assert len(m.edits()) < 60 and sorted(m.state().tables) == list(range(120)) and m.state().flushed_wal == 119
    with pytest.raises(ValueError):
        Edit.from_json('{"kind": "other", "added": []}')


def test_streaming_ingest(spark, tmp_path):
    source = f"{tmp_path}/in"
    for i in range(3):
        spark.range(10 * i, 10 * i + 20).selectExpr("cast(cast(id as string) as binary) AS key", f"cast('{i}' as binary) AS value").write.mode("append").parquet(source)
    with Store(spark, f"{tmp_path}/s", SMALL) as s:
        stream = spark.readStream.schema("key binary, value binary").option("maxFilesPerTrigger", 100).parquet(source)
        ingest(stream.dropDuplicates(["key"]), s, checkpoint=f"{tmp_path}/c", flush_batches=1).awaitTermination()
        assert s.scan().count() == 40


def test_periodic_tasks(spark, tmp_path):
    """A failing run doesn't end the task; stopping does."""
    import time

    from kvlake.streaming.ingest import periodic

    runs = []

    def task(run):
        runs.append(run)
        if run == 0:
            raise ValueError("the first run fails")

    query = periodic(spark, task, checkpoint=f"{tmp_path}/c", every="200 milliseconds")
    until = time.time() + 30
    while len(runs) < 3 and time.time() < until:
        time.sleep(0.1)
    query.stop()
    query.awaitTermination()
    assert runs[:3] == [0, 1, 2] and not query.isActive


def test_lock_of_a_dead_writer(spark, tmp_path):
    Store(spark, f"{tmp_path}/s").set(b"a", b"1")  # never closed: what wasn't synced is lost
    with pytest.raises(ReadOnlyError):
        Store(spark, f"{tmp_path}/s")
    with Store(spark, f"{tmp_path}/s", break_lock=True) as s:
        assert s.get(b"a") is None
    reader = Store(spark, f"{tmp_path}/s", read_only=True)
    with pytest.raises(ReadOnlyError):
        reader.set(b"a", b"1")


def keyed(spark, low, high):
    return spark.range(low, high).selectExpr("cast(format_string('key_%05d', id) as binary) AS key", "cast(concat('v', id) as binary) AS value")


def test_log_batches_are_pruned(spark, tmp_path):
    with Store(spark, f"{tmp_path}/s") as s:
        s.write(keyed(spark, 0, 50))
        s.write(keyed(spark, 100, 150))
        s.write(keyed(spark, 0, 0))
        within = KeyRange(b"key_00110", b"key_00120")
        folders = {f.rsplit("/", 2)[1] for f in s.log(within).inputFiles()}
        assert folders == {"00000001"} and s.scan(within).count() == 10
        rows = s.log_batches().collect()
        assert [(r.entries, r.min_key, r.max_key) for r in rows] == [(50, b"key_00000", b"key_00049"), (50, b"key_00100", b"key_00149"), (0, None, None)]
    (tmp_path / "s/wal/00000000/_batch.json").unlink()  # as if the writer had died before it
    with Store(spark, f"{tmp_path}/s") as s:
        assert s.scan(KeyRange(b"key_00010", b"key_00020")).count() == 10
        assert s.log(within).inputFiles() and s.scan(within).count() == 10


def test_rows_that_cannot_be_stored(spark, tmp_path):
    with Store(spark, f"{tmp_path}/s") as s:
        for bad in ([(None, bytearray(b"1"), False, 1)], [(bytearray(b"a"), None, False, 1)], [(bytearray(b"a"), bytearray(b"1"), None, 1)], [(bytearray(b"a"), bytearray(b"1"), False, -1)], [(bytearray(b"a"), bytearray(b"1"), False, 1 << 32)]):
            with pytest.raises(InvalidInputError):
                s.write(spark.createDataFrame(bad, "key binary, value binary, is_delete boolean, n bigint"), order="n")
        assert s.log().count() == 0 and not s.flush()


def test_compaction_shuffles_once(spark, tmp_path):
    from kvlake.operators import compaction

    rows = keyed(spark, 0, 500).selectExpr("key", "value", "1L AS seq", "false AS is_delete")
    rows.write.parquet(f"{tmp_path}/r")
    merged = compaction.merge(spark.read.parquet(f"{tmp_path}/r"), drop_deletes=True, ranged=True).sortWithinPartitions("key")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1, plan


def test_keys_share_prefixes(spark, tmp_path):
    import pyarrow.parquet as pq

    from kvlake.sources.runs import RunFormat

    with Store(spark, f"{tmp_path}/s", StoreConfig(run_format=RunFormat(row_group_bytes=1 << 20, page_bytes=1 << 12))) as s:
        s.write(keyed(spark, 0, 3000))
        s.flush()
        files = list((tmp_path / "s/sst/00000000").glob("*.parquet"))
        column = pq.ParquetFile(files[0]).metadata.row_group(0).column(0)
        assert column.path_in_schema == "key" and "DELTA_BYTE_ARRAY" in column.encodings and column.total_uncompressed_size < 3000 * 9 / 2
        assert s.scan().count() == 3000


def test_checksums(spark, tmp_path):
    with Store(spark, f"{tmp_path}/s") as s:
        s.write(keyed(spark, 0, 3000).coalesce(1))
    file = next((tmp_path / "s/wal/00000000").glob("*.parquet"))
    raw = bytearray(file.read_bytes())
    raw[len(raw) // 2] ^= 0xFF
    file.write_bytes(raw)
    for crc in (tmp_path / "s/wal/00000000").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="(?i)crc|corrupt|could not verify"):
        Store(spark, f"{tmp_path}/s", StoreConfig(verify=True), read_only=True).log().collect()


def test_formats_that_are_not_known(spark, tmp_path):
    from kvlake.store import BatchMeta

    text = Edit("flush", 0, added=[meta(0)]).to_json()
    assert '"format": 1' in text and Edit.from_json(text).added == [meta(0)] and Edit.from_json(text.replace('"format": 1, ', "")).kind == "flush"
    with pytest.raises(ValueError, match="format 2"):
        Edit.from_json(text.replace('"format": 1', '"format": 2'))
    with pytest.raises(ValueError, match="format 3"):
        BatchMeta.from_json('{"format": 3, "entries": 1, "min_key": null, "max_key": null}')


def test_operations_run_once_at_a_time(spark, tmp_path):
    from kvlake.store import BusyError

    with Store(spark, f"{tmp_path}/s", SMALL) as s:
        assert s.is_operation_safe()
        s.set(b"a", b"1")
        with s._only("flush"):
            assert not s.is_operation_safe() and s.metrics()["flush_running"]
            with pytest.raises(BusyError):
                s.flush()
        with pytest.raises(ValueError), s._only("compaction"):
            assert s.status().first().compactions == 1
            raise ValueError
        assert s.is_operation_safe() and s.flush()
        found = s.metrics()
        assert (found["level_tables"], found["next_table_id"], found["log_batches"], found["next_batch"]) == ([1], 1, 0, 1) and found["level_bytes"][0] > 0


def test_scheduler(spark, tmp_path):
    import time

    from kvlake.streaming.ingest import Scheduler

    scheduler, runs, once = Scheduler(spark, f"{tmp_path}/c"), [], []
    query = scheduler.register("tick", runs.append, "200 milliseconds")
    scheduler.spawn(lambda: once.append(1))
    scheduler.spawn(lambda: 1 / 0)  # is logged
    until = time.time() + 30
    while len(runs) < 2 and time.time() < until:
        time.sleep(0.1)
    scheduler.shutdown()
    n = len(runs)
    assert n >= 2 and once == [1] and not query.isActive
    time.sleep(0.5)
    assert len(runs) == n


@pytest.mark.parametrize("within", [KeyRange(a, b, x, y) for a in (None, 0, 10, 15, 29, 30, 99) for b in (None, 5, 10, 20, 21, 99) for x, y in ((True, False), (False, True))])
def test_blocks_of_a_range(spark, within):
    from kvlake.sources.runs import blocks_in

    first = [10, 20, 30]
    index = spark.createDataFrame(list(enumerate(first)), "block int, first_key int")
    # The slice by the positions of the bounds in the sorted first keys.
    begin = 0 if within.start is None else max(0, sum(f <= within.start for f in first) - 1)
    end = 3 if within.end is None else sum(f <= within.end if within.end_included else f < within.end for f in first)
    assert sorted(r.block for r in blocks_in(index, within).collect()) == list(range(begin, end))


@pytest.mark.parametrize("order,ranged", [(None, True), ("n", False)])
def test_flushes_of_distinct_keys_shuffle_once(spark, tmp_path, monkeypatch, order, ranged):
    from kvlake.operators import compaction

    seen, merge = [], compaction.merge
    monkeypatch.setattr(compaction, "merge", lambda rows, **how: seen.append(how["ranged"]) or merge(rows, **how))
    with Store(spark, f"{tmp_path}/s") as s:
        s.write(keyed(spark, 0, 300).selectExpr("*", "1 AS n"), order=order)
    with Store(spark, f"{tmp_path}/s") as s:
        s.set(b"key_00005", b"newer")
        assert s.flush() and seen == [ranged] and s.scan().count() == 300 and s.get(b"key_00005") == b"newer"
        assert [k for k, _ in content(s.scan())] == sorted(f"key_{i:05}".encode() for i in range(300))
