"""The registered key/value queries and their DuckDB equivalents, name by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlake.functions import format as fmt
from kvlake.functions import checksums, keycode
from kvlake.functions.ranges import KeyRange, text_prefix_range
from kvlake.operators import chunks, compaction, lww, scan, status, validate
from kvlake.session import scratch
from kvlake.sources import runs
from kvlake.sources.manifest import EDITS, replayed
from kvlake.store import Store, StoreConfig
from kvlake.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _FOUND[name] = (f, sql)
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, keys: list[str] | None = None, is_delete=None) -> DataFrame:
    """The event log: key user_id or more, seq event_id."""
    return lww.log_of(_table(spark, sf_dir, "events"), keys or ["user_id"], ["value"], "event_id", is_delete)


# Last write wins

_LATEST = "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id"


@query("kv_latest_events", _LATEST)
def kv_latest_events(spark, sf_dir):
    return lww.live(_events(spark, sf_dir), ["user_id"], ["value"])


@query("kv_latest_window", "SELECT user_id, value, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def kv_latest_window(spark, sf_dir):
    newest = Window.partitionBy("user_id").orderBy(F.desc("seq"))
    return _events(spark, sf_dir).withColumn("r", F.row_number().over(newest)).where("r = 1").select("user_id", "value", "seq")


@query("kv_composite_key", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY ALL")
def kv_composite_key(spark, sf_dir):
    return lww.live(_events(spark, sf_dir, ["user_id", "event_type"]), ["user_id", "event_type"], ["value"])


@query("kv_delete", "SELECT user_id, value, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_id % 7 <> 0")
def kv_delete(spark, sf_dir):
    return lww.live(_events(spark, sf_dir, is_delete=F.col("event_id") % 7 == 0), ["user_id"], ["value"])


@query("kv_upsert_orders", """SELECT o_orderkey, arg_max(price, seq) AS price, CAST(max(seq) AS BIGINT) AS seq FROM (
  SELECT o_orderkey, o_totalprice AS price, 0 AS seq FROM orders UNION ALL
  SELECT o_orderkey, o_totalprice * 2, 1 FROM orders WHERE o_orderkey % 10 = 0) GROUP BY o_orderkey""")
def kv_upsert_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(0).alias("seq"))
    again = orders.where("o_orderkey % 10 = 0").select("o_orderkey", (F.col("price") * 2).alias("price"), F.lit(1).alias("seq"))
    return lww.live(lww.log_of(orders.unionByName(again), ["o_orderkey"], ["price"], "seq"), ["o_orderkey"], ["price"])


@query("kv_merge_sources", """SELECT user_id, event_type, arg_min(value, source) AS value, min(source) AS source FROM (
  SELECT user_id, event_type, arg_max(value, event_id) AS value, CAST(2 - event_id % 3 AS INTEGER) AS source FROM events GROUP BY ALL) GROUP BY ALL""")
def kv_merge_sources(spark, sf_dir):
    """Three sources that together hold all events; a key is in one, two or all of them."""
    keys, events = ["user_id", "event_type"], _table(spark, sf_dir, "events")
    part = lambda i: lww.live(lww.log_of(events.where(F.col("event_id") % 3 == i), keys, ["value"], "event_id"), keys, ["value"])
    return lww.merged([part(2), part(1), part(0)], keys, ["value"])


@query("kv_log_replay_order", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events")
def kv_log_replay_order(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("event_id")
    return _table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(order).cast("bigint").alias("version"))


@query("kv_duplicate_seqs", "SELECT user_id, event_id // 2 AS seq, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def kv_duplicate_seqs(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 2).alias("seq"))
    return lww.duplicate_seqs(log, ["user_id"])


# Point, range and prefix reads

for _name, _key in (("hit", 42), ("miss", 10**9)):

    @query(f"kv_get_{_name}", f"SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events WHERE user_id = {_key} GROUP BY user_id")
    def _get(spark, sf_dir, key=_key):
        return scan.get(_events(spark, sf_dir), key, key_col="user_id", values=["value"])


@query("kv_get_many", "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) GROUP BY user_id")
def kv_get_many(spark, sf_dir):
    keys = _table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("user_id"))
    return scan.get_many(_events(spark, sf_dir), keys, key_col="user_id", values=["value"])


_RANGES = {
    "full": (KeyRange(), "TRUE"),
    "half_open": (KeyRange(20, 60), "user_id >= 20 AND user_id < 60"),
    "closed": (KeyRange(20, 60, end_included=True), "user_id >= 20 AND user_id <= 60"),
    "open": (KeyRange(20, 60, start_included=False), "user_id > 20 AND user_id < 60"),
    "open_closed": (KeyRange(20, 60, start_included=False, end_included=True), "user_id > 20 AND user_id <= 60"),
    "from": (KeyRange(20), "user_id >= 20"),
    "after": (KeyRange(20, start_included=False), "user_id > 20"),
    "below": (KeyRange(end=60), "user_id < 60"),
    "upto": (KeyRange(end=60, end_included=True), "user_id <= 60"),
    "inverted": (KeyRange(60, 20), "FALSE"),
}
for _name, (_range, _sql) in _RANGES.items():

    @query(f"kv_scan_{_name}", f"SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events WHERE {_sql} GROUP BY user_id ORDER BY user_id")
    def _scan(spark, sf_dir, within=_range):
        return scan.scan(_events(spark, sf_dir), within, key_col="user_id", values=["value"])


@query("kv_scan_prefix", "SELECT c_name, c_acctbal, c_custkey AS seq FROM customer WHERE starts_with(c_name, 'Customer#0000001') ORDER BY c_name")
def kv_scan_prefix(spark, sf_dir):
    log = lww.log_of(_table(spark, sf_dir, "customer"), ["c_name"], ["c_acctbal"], "c_custkey")
    return scan.scan(log, text_prefix_range("Customer#0000001"), key_col="c_name", values=["c_acctbal"])


@query("kv_scan_prefix_bytes", "SELECT hex(encode(c_name)) AS key_hex, c_custkey AS seq FROM customer WHERE starts_with(c_name, 'Customer#00000002') ORDER BY 1")
def kv_scan_prefix_bytes(spark, sf_dir):
    log = _table(spark, sf_dir, "customer").select(F.encode("c_name", "UTF-8").alias("key"), F.col("c_acctbal").alias("value"), F.col("c_custkey").alias("seq"), F.lit(False).alias("is_delete"))
    return scan.scan_prefix(log, bytearray(b"Customer#00000002")).select(F.hex("key").alias("key_hex"), "seq")


# Key encoding

_HEX_I64 = "lpad(hex(CAST(CAST({} AS HUGEINT) + 9223372036854775808 AS UBIGINT)), 16, '0')"


@query("keycode_i64", f"SELECT o_orderkey, {_HEX_I64.format('o_orderkey')} AS encoded FROM orders")
def keycode_i64(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.hex(keycode.encode_i64(F.col("o_orderkey"))).alias("encoded"))


@query("keycode_u64", "SELECT o_orderkey, lpad(hex(CAST(o_orderkey AS UBIGINT)), 16, '0') AS encoded FROM orders")
def keycode_u64(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.hex(keycode.encode_u64(F.col("o_orderkey"))).alias("encoded"))


@query("keycode_str", "SELECT c_custkey, hex(encode(c_name)) || '0000' AS encoded FROM customer")
def keycode_str(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", F.hex(keycode.encode_string(F.col("c_name"))).alias("encoded"))


@query("keycode_bool", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '01' ELSE '00' END AS encoded FROM orders")
def keycode_bool(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.hex(keycode.encode_bool(F.col("o_orderstatus") == "F")).alias("encoded"))


@query("keycode_tuple", f"SELECT event_id, {_HEX_I64.format('user_id')} || hex(encode(event_type)) || '0000' AS encoded FROM events")
def keycode_tuple(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.select("event_id", F.hex(keycode.encode(F.struct("user_id", "event_type"), events.select("user_id", "event_type").schema)).alias("encoded"))


@query("keycode_array", f"SELECT o_orderkey, {_HEX_I64.format('o_orderkey')} || {_HEX_I64.format('o_custkey')} AS encoded FROM orders")
def keycode_array(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.hex(keycode.encode(F.array("o_orderkey", "o_custkey"), "array<bigint>")).alias("encoded"))


@query("keycode_variant", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '00' ELSE '01' || hex(encode(c_mktsegment)) || '0000' END AS encoded FROM customer")
def keycode_variant(spark, sf_dir):
    even = F.col("c_custkey") % 2 == 0
    encoded = F.when(even, keycode.encode_variant(0)).otherwise(keycode.encode_variant(1, keycode.encode_string(F.col("c_mktsegment"))))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.hex(encoded).alias("encoded"))


@query("keycode_f64_order", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS place FROM customer")
def keycode_f64_order(spark, sf_dir):
    coded = _table(spark, sf_dir, "customer").withColumn("encoded", keycode.encode_f64(F.col("c_acctbal")))
    return coded.select("c_custkey", F.rank().over(Window.partitionBy("c_nationkey").orderBy("encoded")).cast("bigint").alias("place"))


@query("keycode_order", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, -c_custkey) AS place FROM customer")
def keycode_order(spark, sf_dir):
    encoded = keycode.encode_tuple(keycode.encode_string(F.col("c_mktsegment")), keycode.encode_i64(-F.col("c_custkey")))
    coded = _table(spark, sf_dir, "customer").withColumn("encoded", encoded)
    return coded.select("c_custkey", F.rank().over(Window.partitionBy("c_nationkey").orderBy("encoded")).cast("bigint").alias("place"))


@query("keycode_roundtrip", "SELECT c_custkey, c_custkey AS i, c_custkey AS u, c_name AS s, c_acctbal AS f, c_custkey % 2 = 0 AS b FROM customer")
def keycode_roundtrip(spark, sf_dir):
    c = F.col
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", keycode.decode_i64(keycode.encode_i64(c("c_custkey"))).alias("i"), keycode.decode_u64(keycode.encode_u64(c("c_custkey"))).cast("bigint").alias("u"),
        keycode.decode_string(keycode.encode_string(c("c_name"))).alias("s"), keycode.decode_f64(keycode.encode_f64(c("c_acctbal"))).alias("f"),
        keycode.decode_bool(keycode.encode_bool(c("c_custkey") % 2 == 0)).alias("b"),
    )


@query("keycode_roundtrip_long", "SELECT doc_id, coalesce(text, '') AS s, octet_length(encode(coalesce(text, ''))) AS n, sha256(coalesce(text, '')) AS b_sha256, doc_id AS i FROM documents")
def keycode_roundtrip_long(spark, sf_dir):
    """Whole texts as keys, alone and in a tuple."""
    text = F.coalesce("text", F.lit(""))
    pair = keycode.decode_tuple(keycode.encode_tuple(keycode.encode_bytes(F.encode(text, "UTF-8")), keycode.encode_i64(F.col("doc_id"))), "binary", "bigint")
    found = _table(spark, sf_dir, "documents").select("doc_id", keycode.decode_string(keycode.encode_string(text)).alias("s"), pair.alias("pair"))
    return found.select("doc_id", "s", F.octet_length("s").cast("bigint").alias("n"), F.sha2("pair._1", 256).alias("b_sha256"), F.col("pair._2").alias("i"))


@query("checksum_continued", "SELECT c_custkey, TRUE AS crc32c, TRUE AS crc64 FROM customer")
def checksum_continued(spark, sf_dir):
    """Whether checksums of two values one after the other are those of both together."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    same = lambda f: f(segment, f(name)) == f(F.concat(name, segment))
    return _table(spark, sf_dir, "customer").select("c_custkey", same(checksums.crc32c).alias("crc32c"), same(checksums.crc64).alias("crc64"))


@query("format_kv", """SELECT c_custkey, '"' || c_name || '" → "' || c_mktsegment || '"' AS shown FROM customer""")
def format_kv(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", fmt.key_value(F.encode("c_name", "UTF-8"), F.encode("c_mktsegment", "UTF-8")).alias("shown"))


# Runs, blocks and metadata

#: lineitem as runs of 1000 order keys, in levels by number.
_META = """SELECT l_orderkey // 1000 AS id, CAST((l_orderkey // 1000) % 3 AS INTEGER) AS level, count(*) AS entry_count, min(l_orderkey) AS min_key, max(l_orderkey) AS max_key,
  sum(octet_length(encode(l_returnflag)) + octet_length(encode(l_linestatus)) + 8) AS size FROM lineitem GROUP BY 1"""


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("id", F.floor(F.col("l_orderkey") / 1000))
    size = F.octet_length("l_returnflag") + F.octet_length("l_linestatus") + 8
    return runs.run_metadata(rows, "id", "l_orderkey", size).withColumn("level", (F.col("id") % 3).cast("int"))


@query("memtable_size", "SELECT event_id // 1000 AS batch, CAST(sum(8 + octet_length(encode(props))) AS BIGINT) AS size, count(*) AS entries FROM events GROUP BY 1")
def memtable_size(spark, sf_dir):
    key = keycode.encode_i64(F.col("user_id"))
    rows = _table(spark, sf_dir, "events").withColumn("batch", F.floor(F.col("event_id") / 1000))
    return rows.groupBy("batch").agg(F.sum(F.octet_length(key) + F.octet_length("props")).alias("size"), F.count(F.lit(1)).alias("entries"))


@query("run_metadata", f"SELECT id, level, entry_count, min_key, max_key, CAST(size AS BIGINT) AS size FROM ({_META})")
def run_metadata(spark, sf_dir):
    return _metadata(spark, sf_dir)


@query("run_prune_get", f"SELECT id, min_key, max_key FROM ({_META}) WHERE min_key <= 4321 AND max_key >= 4321")
def run_prune_get(spark, sf_dir):
    return runs.runs_for(_metadata(spark, sf_dir), F.lit(4321)).select("id", "min_key", "max_key")


@query("sparse_index_find", "SELECT arg_max(block, first_key) AS block, max(first_key) AS first_key FROM (SELECT o_orderkey // 128 AS block, min(o_orderkey) AS first_key FROM orders GROUP BY 1) WHERE first_key <= 4321")
def sparse_index_find(spark, sf_dir):
    blocks = _table(spark, sf_dir, "orders").withColumn("block", F.floor(F.col("o_orderkey") / 128))
    return runs.find_block(runs.sparse_index(blocks, "block", "o_orderkey"), F.lit(4321), "block")


@query("sparse_index_range", "SELECT block, first_key FROM (SELECT o_orderkey // 128 AS block, min(o_orderkey) AS first_key FROM orders GROUP BY 1) WHERE block BETWEEN 1000 // 128 AND 2000 // 128")
def sparse_index_range(spark, sf_dir):
    blocks = _table(spark, sf_dir, "orders").withColumn("block", F.floor(F.col("o_orderkey") / 128))
    return runs.blocks_in(runs.sparse_index(blocks, "block", "o_orderkey"), KeyRange(1000, 2000, end_included=True))


@query("compaction_plan", f"""WITH l AS (SELECT level, count(*) AS tables, CAST(sum(size) AS BIGINT) AS size FROM ({_META}) GROUP BY level),
  n AS (SELECT *, lead(size) OVER (ORDER BY level) AS next_size, lead(level) OVER (ORDER BY level) AS next_level FROM l)
  SELECT min(level) AS level FROM n WHERE CASE WHEN level = 0 THEN tables > 1000000 ELSE tables >= 3 AND (next_level IS NULL OR size // greatest(next_size, 1) >= 1) END HAVING min(level) IS NOT NULL""")
def compaction_plan(spark, sf_dir):
    return compaction.due_levels(_metadata(spark, sf_dir), compaction.CompactionConfig(level0_threshold=1_000_000, size_ratio=1, max_tables=3))


@query("compact_merge", "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id HAVING max(event_id) % 4 <> 3 ORDER BY user_id")
def compact_merge(spark, sf_dir):
    """Four runs that together hold all events; the mutations of one are deletes."""
    part = lambda i: compaction.merge(_table(spark, sf_dir, "events").where(F.col("event_id") % 4 == i).select(F.col("user_id").alias("key"), "value", F.col("event_id").alias("seq"), F.lit(i == 3).alias("is_delete")), drop_deletes=False)
    merged = compaction.merge(part(0).unionByName(part(1)).unionByName(part(2)).unionByName(part(3)), drop_deletes=True, ranged=True)
    return merged.select(F.col("key").alias("user_id"), "value", "seq").orderBy("user_id")


@query("manifest_replay", """WITH e AS (SELECT event_id AS seq, user_id, event_id % 5 AS k FROM events),
  a AS (SELECT seq AS id, seq FROM e WHERE k < 4), d AS (SELECT seq - 7 AS id, seq AS gone FROM e WHERE k = 3)
  SELECT id, CAST(CASE WHEN id % 5 = 3 THEN 1 ELSE 0 END AS INTEGER) AS level, id * 10 AS entry_count FROM a
  WHERE seq >= 100 AND NOT EXISTS (SELECT 1 FROM d WHERE d.id = a.id AND gone >= 100 AND gone > a.seq)""")
def manifest_replay(spark, sf_dir):
    """An edit log from events: flushes, each fifth a compaction that drops the table of seven before, each fifth a begin;
    commit 100 is a snapshot with its own table only."""
    k, seq = F.col("event_id") % 5, F.col("event_id")
    kind = F.when(seq == 100, "snapshot").when(k == 3, "commit_compaction").when(k == 4, "begin_compaction").otherwise("flush")
    table = F.struct(seq.alias("id"), F.when(k == 3, 1).otherwise(0).cast("int").alias("level"), F.lit(0).cast("bigint").alias("size"), (seq * 10).alias("entry_count"), F.lit(b"").alias("min_key"), F.lit(b"").alias("max_key"))
    none = F.array().cast("array<bigint>")
    edits = _table(spark, sf_dir, "events").select(
        kind.alias("kind"), seq.alias("seq"), none.alias("wal_ids"), F.lit(0).cast("bigint").alias("job_id"), F.lit(0).alias("source_level"), F.lit(0).alias("target_level"),
        F.when(k == 3, F.array(seq - 7)).otherwise(none).alias("deleted"), F.array(table).alias("added"), (seq + 1).alias("next_table_id"),
    )
    assert [f.split()[0] for f in EDITS.split(", ")] == edits.columns
    return replayed(edits).select("id", "level", "entry_count")


@query("validate_ids", "SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def validate_ids(spark, sf_dir):
    return validate.duplicate_ids(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query("validate_ordering", """WITH t AS (SELECT event_id AS id, CAST(user_id % 3 AS INTEGER) AS level, event_id * 10 AS min_key, event_id * 10 + CAST(floor(value) AS BIGINT) % 40 - 5 AS max_key FROM events),
  s AS (SELECT *, max(max_key) OVER (PARTITION BY level ORDER BY min_key, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM t)
  SELECT id, level, CASE WHEN min_key > max_key THEN 'inverted' ELSE 'overlaps' END AS violation FROM s WHERE min_key > max_key OR level > 0 AND min_key <= reached""")
def validate_ordering(spark, sf_dir):
    whole = F.floor("value")
    tables = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).cast("int").alias("level"), (F.col("event_id") * 10).alias("min_key"), (F.col("event_id") * 10 + whole % 40 - 5).alias("max_key"))
    return validate.misordered(tables)


@query("validate_all", """WITH t AS (SELECT event_id // 2 AS id, CAST(user_id % 3 AS INTEGER) AS level, event_id * 10 AS min_key, event_id * 10 + CAST(floor(value) AS BIGINT) % 40 - 5 AS max_key FROM events),
  s AS (SELECT *, max(max_key) OVER (PARTITION BY level ORDER BY min_key, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM t)
  SELECT 'duplicate id' AS check, id, CAST(count(*) AS VARCHAR) AS detail FROM t GROUP BY id HAVING count(*) > 1 UNION ALL
  SELECT 'key order', id, CASE WHEN min_key > max_key THEN 'inverted' ELSE 'overlaps' END FROM s WHERE min_key > max_key OR level > 0 AND min_key <= reached UNION ALL
  SELECT 'next id', id, '400' FROM t WHERE id >= 400""")
def validate_all(spark, sf_dir):
    tables = _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2).alias("id"), (F.col("user_id") % 3).cast("int").alias("level"), (F.col("event_id") * 10).alias("min_key"), (F.col("event_id") * 10 + F.floor("value") % 40 - 5).alias("max_key"))
    return validate.all_violations(tables, 400)


@query("validate_counts", f"""WITH m AS ({_META}), a AS (SELECT level, count(*) AS n FROM m GROUP BY 1), b AS (SELECT level, count(*) AS n FROM m WHERE id % 4 <> 1 GROUP BY 1)
  SELECT level, coalesce(a.n, 0) AS expected, coalesce(b.n, 0) AS found FROM a FULL JOIN b USING (level) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def validate_counts(spark, sf_dir):
    metadata = _metadata(spark, sf_dir)
    return validate.inconsistent(metadata, metadata.where("id % 4 <> 1"))


@query("store_status", f"""SELECT count(*) AS tables, CAST(sum(size) AS BIGINT) AS table_bytes, CAST(sum(entry_count) AS BIGINT) AS entries, CAST(max(level) + 1 AS BIGINT) AS levels, CAST(sum(CAST(level = 0 AS BIGINT)) AS BIGINT) AS level0_tables,
  max(id) + 1 AS next_table_id, 12 AS log_batches, 3456 AS log_bytes, 0 AS compactions, TRUE AS too_many_batches, FALSE AS too_many_compactions FROM ({_META})""")
def store_status(spark, sf_dir):
    return status.status(_metadata(spark, sf_dir), log_batches=12, log_bytes=3456)


# A store in a folder of its own

#: All events as three log batches, in the order of these; a batch's fifth events are deletes.
_BATCHES = "event_id % 3"
_NEWEST = "SELECT user_id, arg_max(value, ({0}, event_id)) AS value FROM events GROUP BY user_id HAVING arg_max(event_id, ({0}, event_id)) % 5 <> 0"


def _batch(spark: SparkSession, sf_dir: str, i: int) -> DataFrame:
    rows = _table(spark, sf_dir, "events").where(F.expr(_BATCHES) == i)
    return rows.select(keycode.encode_i64(F.col("user_id")).alias("key"), F.col("value").cast("string").cast("binary").alias("value"), (F.col("event_id") % 5 == 0).alias("is_delete"), "event_id")


def _stored(spark: SparkSession, sf_dir: str, *, flush: tuple[int, ...] = (), config: StoreConfig | None = None) -> str:
    """The path of a store of all batches, flushed after those given."""
    path = scratch(spark, "store")
    with Store(spark, path, config) as store:
        for i in range(3):
            store.write(_batch(spark, sf_dir, i), order="event_id")
            if i in flush:
                store.flush()
            store.needs_compaction() and store.compact()
    return path


def _content(rows: DataFrame) -> DataFrame:
    return rows.select(keycode.decode_i64(F.col("key")).alias("user_id"), F.col("value").cast("string").cast("double").alias("value"))


@query("store_log_replay", f"SELECT user_id, event_id, event_id % 5 = 0 AS is_delete, row_number() OVER (PARTITION BY user_id ORDER BY {_BATCHES}, event_id) AS version FROM events")
def store_log_replay(spark, sf_dir):
    """The mutations that a store finds in its log when it is opened again, with checksums compared."""
    log = Store(spark, _stored(spark, sf_dir), StoreConfig(verify=True), read_only=True).log()
    order = Window.partitionBy("user_id").orderBy("seq")
    rows = log.select(keycode.decode_i64(F.col("key")).alias("user_id"), (F.col("seq") % (1 << 32)).alias("event_id"), "is_delete", "seq")
    return rows.withColumn("version", F.row_number().over(order).cast("bigint")).drop("seq")


@query("store_recover", _NEWEST.format(_BATCHES))
def store_recover(spark, sf_dir):
    """A store that is opened again with a flushed run and unflushed batches."""
    return _content(Store(spark, _stored(spark, sf_dir, flush=(1,)), read_only=True).scan(ordered=False))


@query("store_flush", _NEWEST.format(_BATCHES))
def store_flush(spark, sf_dir):
    """Runs of level 0 only, one for each batch."""
    return _content(Store(spark, _stored(spark, sf_dir, flush=(0, 1, 2)), read_only=True).scan(ordered=False))


@query("store_compact", _NEWEST.format(_BATCHES))
def store_compact(spark, sf_dir):
    """Runs that are merged as soon as there are two: the last one is alone in its level, without deletes."""
    config = StoreConfig(compaction=compaction.CompactionConfig(level0_threshold=1, max_tables=100))
    store = Store(spark, _stored(spark, sf_dir, flush=(0, 1, 2), config=config), read_only=True)
    return _content(store.scan(ordered=False))


@query("store_snapshot", f"SELECT user_id, arg_max(value, ({_BATCHES}, event_id)) AS value FROM events WHERE {_BATCHES} < 2 GROUP BY user_id HAVING arg_max(event_id, ({_BATCHES}, event_id)) % 5 <> 0")
def store_snapshot(spark, sf_dir):
    """The store as of its second commit, read after the third."""
    return _content(Store(spark, _stored(spark, sf_dir, flush=(0, 1, 2)), read_only=True).scan(ordered=False, version=1))


@query("store_tables", f"SELECT {_BATCHES} AS id, 0 AS level, count(DISTINCT user_id) AS entry_count, min(user_id) AS min_key, max(user_id) AS max_key FROM events GROUP BY 1")
def store_tables(spark, sf_dir):
    """Metadata of the tables that flushes made."""
    tables = Store(spark, _stored(spark, sf_dir, flush=(0, 1, 2)), read_only=True).tables()
    return tables.select("id", "level", "entry_count", *(keycode.decode_i64(F.col(c)).alias(c) for c in ("min_key", "max_key")))


@query("store_buffer", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN upper(n_name) ELSE n_name END AS n_name FROM nation WHERE n_nationkey % 5 <> 4 ORDER BY n_nationkey")
def store_buffer(spark, sf_dir):
    """Single writes, some of them synced, some overwritten or deleted, and read before any flush. A nation is a row."""
    store = Store(spark, scratch(spark, "store"))
    rows = _table(spark, sf_dir, "nation").select(keycode.encode_i64(F.col("n_nationkey").cast("bigint")).alias("key"), "n_nationkey", "n_name").collect()
    for r in rows:
        store.set(r["key"], r["n_name"].encode())
    store.sync()
    for r in rows:
        if r["n_nationkey"] % 3 == 0:
            store.set(r["key"], r["n_name"].upper().encode())
        if r["n_nationkey"] % 5 == 4:
            store.delete(r["key"])
    found = store.scan()
    return found.select(keycode.decode_i64(F.col("key")).cast("int").alias("n_nationkey"), F.col("value").cast("string").alias("n_name")).orderBy("n_nationkey")


@query("store_ingest", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def store_ingest(spark, sf_dir):
    """A stream of all events into a store, which is flushed as it fills."""
    events, path = _table(spark, sf_dir, "events"), scratch(spark, "store")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")  # a stream takes a folder or a pattern
    rows = stream.select(keycode.encode_i64(F.col("user_id")).alias("key"), F.col("value").cast("string").cast("binary").alias("value"), "event_id")
    with Store(spark, path) as store:
        ingest.ingest(rows, store, checkpoint=f"{path}/checkpoint", order="event_id", flush_batches=1).awaitTermination()
    return _content(Store(spark, path, read_only=True).scan(ordered=False))


@query("store_levels", f"SELECT 1 AS level, count(DISTINCT user_id) AS entries, 1 AS tables FROM events WHERE user_id IN ({_NEWEST.format(_BATCHES).replace(', arg_max(value, (event_id % 3, event_id)) AS value', '')})")
def store_levels(spark, sf_dir):
    """What is in each level when runs are merged as soon as there are two: keys whose newest mutation isn't a delete."""
    config = StoreConfig(compaction=compaction.CompactionConfig(level0_threshold=2, max_tables=100))
    tables = Store(spark, _stored(spark, sf_dir, flush=(0, 1, 2), config=config), read_only=True).tables()
    return tables.groupBy("level").agg(F.sum("entry_count").alias("entries"), F.count(F.lit(1)).cast("int").alias("tables"))


# Time chunks

@query("time_chunk_count", "SELECT time_bucket(INTERVAL '1 hour', ts) AS chunk, count(*) AS n FROM events GROUP BY 1")
def time_chunk_count(spark, sf_dir):
    return chunks.chunked(_table(spark, sf_dir, "events"), "ts").groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


@query("time_chunk_latest", "SELECT time_bucket(INTERVAL '1 day', ts) AS chunk, user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def time_chunk_latest(spark, sf_dir):
    log = lww.log_of(chunks.chunked(_table(spark, sf_dir, "events"), "ts", "1 day"), ["chunk", "user_id"], ["value"], "event_id")
    return lww.live(log, ["chunk", "user_id"], ["value"]).drop("seq")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
