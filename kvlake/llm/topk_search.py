"""Exact search for the k vectors of largest inner product, by three-phase uniform threshold.

Each vector is cut into LISTS slices of its components. A query's score for a vector is the sum of the slices' partial
scores; a slice's partial scores of all vectors are one of the query's lists. Lists are apart, and each is held in blocks of
vectors: a task has one slice of the vectors of a block.
  1. Each block of a list sends its largest partial scores, all blocks together 2 k of a list and one each at least. These
     are candidates, whose scores are made in full; the k-th largest of them is a score that at least k vectors reach.
  2. A list's share of that score is the cutoff that goes out with the queries: a vector whose partial scores are all below
     it is below the score. Each list sends its entries that reach the cutoff. An entry that wasn't sent is below the
     cutoff, which bounds sums from above.
  3. Vectors whose bound reaches the first phase's score are looked up in the lists that haven't sent them. With that their
     scores are complete, and each block gives its k best.
The answer is exact; ties go to the smaller id.

Queries and vectors meet as blocks: each block of queries is sent to each block of vectors, as a stated set of queries
against all rows needs. Blocks of vectors stay where they are while the queries come. Cutoffs travel in the blocks of
queries, so that nothing is broadcast whose size grows.

Defined cases: vectors that are null or hold null or non-finite components take no part; of rows with the same id the
vector that is least in the order of arrays stands for all; rows with a null id are left out; only vectors of the query's
length are compared; scores that don't fit 64 bits raise an error. With no other vector a query has no rows. Columns
besides id and vector, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 20
LISTS = 2
#: Vectors and queries in a block, and pairs that are looked up at once.
BLOCK, QUERIES, PAIRS = 4096, 512, 1 << 16
#: Below every score that counts.
NONE = -(2**63)
#: Sent entries of a list: ids of the blocks' queries and vectors, the queries' scores of the first phase (packed 64-bit
#: integers), and each entry's place among the queries, place among the vectors and partial score (see _packed).
ENTRIES = "dim int, block int, vector_block int, list int, query_ids binary, vector_ids binary, kth binary, q binary, v binary, s binary"


def _smallest(values: np.ndarray) -> np.ndarray:
    """values in the fewest bytes that hold them all."""
    for kind in (np.int8, np.int16, np.int32):
        if not values.size or np.iinfo(kind).min <= values.min() and values.max() <= np.iinfo(kind).max:
            return values.astype(kind)
    return values


def _packed(values: np.ndarray) -> bytes:
    """Integers in the fewest bytes, behind their width."""
    small = _smallest(values)
    return bytes([small.itemsize]) + small.tobytes()


def _loose(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<i{packed[0]}", offset=1).astype(np.int64)


def _blocks(vectors: DataFrame, lists: int, blocks: int) -> DataFrame:
    """Blocks of vectors of the same length, by slices: dim, block, list, ids, values (packed integers of width bytes), and
    more columns of vectors, packed."""
    extra = [c for c in vectors.columns if c not in ("vec_id", "v")]

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        values = _smallest(np.asarray(table.column("part").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64))
        first = [table.column(c)[0].as_py() for c in ("dim", "block", "list")]
        longs = [np.asarray(table.column(c), np.int64).tobytes() for c in ("vec_id", *extra)]
        kinds = [pa.int32()] * 4 + [pa.binary()] * (2 + len(extra))
        row = [*first, values.itemsize, longs[0], values.tobytes(), *longs[1:]]
        return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["dim", "block", "list", "width", "ids", "values", *extra])

    edge = lambda j: F.floor(F.size("v") * j / lists).cast("int")
    parts = F.array(*(F.slice("v", edge(j) + 1, edge(j + 1) - edge(j)) for j in range(lists)))
    sliced = vectors.select("vec_id", *extra, F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.posexplode(parts).alias("list", "part"))
    more = "".join(f", {c} binary" for c in extra)
    return sliced.groupBy("dim", "block", "list").applyInArrow(packed, f"dim int, block int, list int, width int, ids binary, values binary{more}")


def _met(queries: DataFrame, held: DataFrame, blocks: int, lists: int) -> DataFrame:
    """Each block of queries beside each block of vectors of the same length, in the list's place."""
    sent = queries.withColumn("vector_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "vector_block", "list"]
    tasks = max(blocks * lists, common.partitions_for(queries.sparkSession, 0, 1))
    return sent.repartition(tasks, *keys).join(_renamed(held).repartition(tasks, *keys).hint("merge"), keys)


def _renamed(held: DataFrame) -> DataFrame:
    return held.select("dim", F.col("block").alias("vector_block"), "list", F.col("width").alias("vector_width"), F.col("ids").alias("vector_ids"), F.col("values").alias("vector_values"))


def _unpacked(row: dict, of: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{of}ids"], np.int64)
    return ids, np.frombuffer(row[f"{of}values"], f"<i{row[f'{of}width']}").reshape(len(ids), -1)


def _safe(q: np.ndarray, v: np.ndarray, lists: int) -> type:
    """The type for inner products: doubles where they fit 53 bits, integers where the sums over all lists fit 63."""
    most = [max(-int(x.min()), int(x.max())) if x.size else 0 for x in (q, v)]
    bound = most[0] * most[1] * q.shape[1]
    if bound < 1 << 53:
        return np.float64
    if bound * lists < 1 << 63:
        return np.int64
    raise OverflowError("inner products beyond 64 bits")


def _products(q: np.ndarray, v: np.ndarray, lists: int) -> np.ndarray:
    """The exact inner products of each row of q with each of v."""
    kind = _safe(q, v, lists)
    return (q.astype(kind) @ v.astype(kind).T).astype(np.int64)


def _first_phase(batches: Iterator[pa.RecordBatch], *, most: int, lists: int) -> Iterator[pa.RecordBatch]:
    """query_id, vec_ids of a block's largest partial scores, without the query's own vector."""
    for batch in batches:
        for row in batch.to_pylist():
            (qi, q), (vi, v) = _unpacked(row), _unpacked(row, "vector_")
            partial = _products(q, v, lists)
            partial[qi[:, None] == vi[None, :]] = NONE
            n = min(most, len(vi))
            top = vi[np.argpartition(partial, len(vi) - n, axis=1)[:, len(vi) - n :]]
            out = [(q, [v for v in own if v != q]) for q, own in zip(qi.tolist(), top.tolist(), strict=True)]
            yield _batch(out, ["query_id", "vec_ids"], [pa.int64(), pa.list_(pa.int64())])


def _entries(row: dict, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    values = [*(row[c] for c in ("dim", "block", "vector_block", "list", "ids", "vector_ids", "kth")), *map(_packed, (q, v, s))]
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if i < 4 else pa.binary()) for i, x in enumerate(values)], names=names)


def _second_phase(batches: Iterator[pa.RecordBatch], *, lists: int) -> Iterator[pa.RecordBatch]:
    """Entries (ENTRIES) of a list that reach the cutoff."""
    for batch in batches:
        for row in batch.to_pylist():
            (qi, q), (vi, v) = _unpacked(row), _unpacked(row, "vector_")
            partial = _products(q, v, lists)
            a, b = np.nonzero((partial >= _cutoff(np.frombuffer(row["kth"], np.int64), lists)[:, None]) & (qi[:, None] != vi[None, :]))
            yield _entries(row, a, b, partial[a, b])


def _cutoff(kth: np.ndarray, lists: int) -> np.ndarray:
    """The least partial score that one of the lists must have for a sum of kth."""
    return kth // lists + (kth % lists > 0)


class _Pairs:
    """The pairs of a block of queries and a block of vectors of which entries were sent, as places in the blocks."""

    def __init__(self, table: pa.Table, lists: int):
        rows = table.to_pylist()
        self.first = rows[0]
        sent = [[_loose(r[c]) for c in ("q", "v", "s")] for r in rows]
        q, v, s = (np.concatenate(x) for x in zip(*sent, strict=True))
        at = np.repeat([r["list"] for r in rows], [len(x[0]) for x in sent])
        order = np.lexsort((at, v, q))
        q, v, s, at = q[order], v[order], s[order], at[order]
        new = np.ones(len(q), bool)
        new[1:] = (np.diff(q) != 0) | (np.diff(v) != 0)
        begin = np.flatnonzero(new)
        self.q, self.v = q[begin], v[begin]
        self.known = np.zeros((lists, len(begin)), bool)
        self.known[at, np.cumsum(new) - 1] = True
        self.sum = np.add.reduceat(s, begin) if len(begin) else s
        self.query_ids, self.vector_ids, kth = (np.frombuffer(self.first[c], np.int64) for c in ("query_ids", "vector_ids", "kth"))
        self.kth = kth[self.q]


def _missing(table: pa.Table, *, lists: int) -> pa.Table:
    """For each list the pairs (q, v) that it hasn't sent and whose bound reaches the first phase's score."""
    p = _Pairs(table, lists)
    unsent = lists - p.known.sum(axis=0)
    # An entry that wasn't sent is less than the cutoff. Without a score of the first phase all were sent.
    reach = (unsent > 0) & (p.sum + unsent * (_cutoff(p.kth, lists) - 1) >= p.kth)
    rows = [(p.first["dim"], p.first["block"], p.first["vector_block"], j, _packed(p.q[want]), _packed(p.v[want])) for j in range(lists) if (want := reach & ~p.known[j]).any()]
    kinds = [pa.int32()] * 4 + [pa.binary()] * 2
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["dim", "block", "vector_block", "list", "q", "v"])


def _third_phase(batches: Iterator[pa.RecordBatch], *, lists: int) -> Iterator[pa.RecordBatch]:
    """Entries (ENTRIES) of the pairs that were looked up."""
    for batch in batches:
        for row in batch.to_pylist():
            (_, q), (_, v) = _unpacked(row), _unpacked(row, "vector_")
            a, b = _loose(row["q"]), _loose(row["v"])
            kind, s = _safe(q, v, lists), np.empty(len(a), np.int64)
            for at in range(0, len(a), PAIRS):
                own = slice(at, at + PAIRS)
                s[own] = np.einsum("ij,ij->i", q[a[own]].astype(kind), v[b[own]].astype(kind))
            yield _entries(row, a, b, s)


def _best(table: pa.Table, *, k: int, lists: int) -> pa.Table:
    """query_id, vec_ids, scores: a block's k best of the pairs that are complete."""
    p = _Pairs(table, lists)
    full = p.known.all(axis=0) & (p.sum >= p.kth)
    q, v, s = p.query_ids[p.q[full]], p.vector_ids[p.v[full]], p.sum[full]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    edge = np.flatnonzero(np.diff(q, prepend=q[:1] - 1, append=q[-1:] + 1)) if len(q) else []
    rows = [(int(q[a]), v[a : min(b, a + k)].tolist(), s[a : min(b, a + k)].tolist()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pa.Table.from_batches([_batch(rows, ["query_id", "vec_ids", "scores"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())])])


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    """The k best scores for each query, with rank."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(queries: DataFrame, vectors: DataFrame, *, k: int = K, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score for queries and vectors of vec_id bigint and v array<bigint>, with distinct ids; a
    written table."""
    spark, since = vectors.sparkSession, common.made()
    common.python_workers(spark)
    vectors, queries = common.written(vectors.select("vec_id", "v"), "vectors"), common.written(queries.select("vec_id", "v"), "queries")
    blocks, query_blocks = max(1, -(-vectors.count() // BLOCK)), max(1, -(-queries.count() // QUERIES))
    held = common.written(_blocks(vectors, lists, blocks), "vector-blocks")

    def first(batches):
        return _first_phase(batches, most=-(-2 * k // blocks), lists=lists)

    local = _met(_blocks(queries, lists, query_blocks), held, blocks, lists).mapInArrow(first, "query_id bigint, vec_ids array<bigint>")
    candidates = local.select("query_id", F.explode("vec_ids").alias("vec_id")).distinct()
    score = F.aggregate(F.zip_with("qv", "vv", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    known = candidates.join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id").join(vectors.select("vec_id", F.col("v").alias("vv")), "vec_id")
    kth = _ranked(known.select("query_id", "vec_id", score.alias("score")), k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    # Without k other vectors all are in the answer, and the cutoff lets all through.
    asked = queries.join(common.written(kth, "cutoffs"), "vec_id", "left").select("vec_id", "v", F.coalesce("kth", F.lit(NONE)).alias("kth"))
    asked = common.written(_blocks(asked, lists, query_blocks), "query-blocks")

    def second(batches):
        return _second_phase(batches, lists=lists)

    def missing(table):
        return _missing(table, lists=lists)

    def third(batches):
        return _third_phase(batches, lists=lists)

    def best(table):
        return _best(table, k=k, lists=lists)

    sent = common.written(_met(asked, held, blocks, lists).mapInArrow(second, ENTRIES), "second")
    pairs = ["dim", "block", "vector_block"]
    wanted = sent.groupBy(*pairs).applyInArrow(missing, "dim int, block int, vector_block int, list int, q binary, v binary")
    places = wanted.join(asked, ["dim", "block", "list"]).join(_renamed(held), ["dim", "vector_block", "list"])
    resolved = common.written(places.mapInArrow(third, ENTRIES), "third")
    found = sent.unionByName(resolved).groupBy(*pairs).applyInArrow(best, "query_id bigint, vec_ids array<bigint>, scores array<bigint>")
    entries = found.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("e")).select("query_id", F.col("e.vec_ids").alias("vec_id"), F.col("e.scores").alias("score"))
    return common.finished(_ranked(entries, k).select("query_id", "rank", "vec_id", "score"), "top", since)


def quantised(embeddings: DataFrame, *, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component, for the rows that take part, one for each id."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("bigint")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = common.made()
    vectors = common.written(quantised(common.table(spark, sf_dir, "embeddings")), "quantised")
    found = search(vectors.where("vec_id % 20 = 0"), vectors)
    common.sweep(spark, since=since, but=found.__dict__["written_path"])
    return found


SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
