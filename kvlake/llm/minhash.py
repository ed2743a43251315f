"""Near-duplicate documents by MinHash: fast similarity sketches, banding, exact verification, components.

A document's set holds its distinct runs of SHINGLE words, ASCII letters lower-cased; shingles are 64-bit hashes. The
sketch fills t = BANDS x ROWS coordinates by rounds of hashed placement, so that short texts fill all of them too and
estimates concentrate. Documents that share a band are candidates. A pair right at the similarity asked for is missed
with a probability of 1e-9 at 0.8 with 40 bands of 4 rows, and of 7e-9 at 0.85 with 32 of 5. Links are confirmed on full
sets.

Skew: documents with the same set form a class, of which one member goes on. In a bucket no list of all pairs is made.
Every member is first compared with the least one, which joins most of a large group; then only members outside the
bucket's largest component are compared with the others. Comparisons are cut into blocks of bounded numbers and bytes of
sets (a set beyond that is a block's only one). Links leave a block only where they join components. Joins on buckets,
sets and components deal hot keys over several tasks.
Components come from rounds of hooking and contraction over written edge tables.

Defined cases: null and empty texts, and texts without words, have an empty set and are linked with nothing; rows with a
null doc_id are linked with nothing and kept, with a null component_id; rows that repeat a doc_id are told apart by their
sets, and each is kept if doc_id is its component's; an empty table gives no rows. Extra columns, whatever their names, are
carried by deduplicate().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .slices import SPACE, Hashes, mix

#: Words of a shingle, percent of similarity, rows of a band and bands.
SHINGLE, PERCENT, ROWS, BANDS = 5, 80, 4, 40
#: Members of either side in a block of a large group, the most in a group that goes whole, rows of small groups put
#: together, and columns of a block's matrices.
LEFT, RIGHT, SMALL, PACK, COLUMNS = 256, 512, 128, 500, 2048
#: Bytes of the sets of either side of a block, of a group that goes whole, and of small groups put together.
BLOCK_BYTES = 8 << 20
#: Bytes of text handled at once.
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(size of each set, hashes of all sets' shingles one after another, each set sorted). A text with fewer than k words
    has its whole sequence as the only shingle, one without words none."""
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edges = np.flatnonzero(np.diff(SPACE[raw], prepend=True))
    start, end = edges[0::2], edges[1::2]
    limits = np.cumsum([len(t) + 1 for t in texts])
    words = np.bincount(np.searchsorted(limits, start, side="right"), minlength=len(texts))
    hashes = Hashes(Hashes(raw)(start, end))
    number = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(len(texts)), number)
    first = np.repeat(np.cumsum(words) - words, number) + np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    value = hashes(first, first + np.minimum(words, k)[owner])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return np.bincount(owner[new], minlength=len(texts)), value[new]


def sketches(sizes: np.ndarray, values: np.ndarray, coordinates: int) -> np.ndarray:
    """Fast similarity sketches, a row for each set; rows of empty sets are meaningless.

    In round i < t every element falls into a random one of the t coordinates, in round t + i into coordinate i; a
    coordinate keeps the least (round, hash). Rounds go on for the sets that still have an empty coordinate, and after
    round 2t - 1 there is none. Two sets agree in a coordinate with the probability of their Jaccard similarity."""
    t, n = coordinates, len(sizes)
    table = np.full((n, t), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    todo = values
    for i in range(2 * t):
        if not len(owner):
            break
        h = mix(todo ^ np.uint64((i + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        column = (h >> np.uint64(40)) % np.uint64(t) if i < t else np.full(len(h), i - t, np.uint64)
        key = owner * t + column.astype(np.int64)
        value = np.uint64(i << 48) | ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16))
        np.minimum.at(table.reshape(-1), key, value)
        left = ~(table != np.iinfo(np.uint64).max).all(axis=1)[owner]
        owner, todo = owner[left], todo[left]
    return table


def bands(table: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each band of rows coordinates."""
    n, t = table.shape
    out = np.zeros((n, t // rows), np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + table[:, r::rows][:, : t // rows])
    return out


def _fingerprints(texts: list[bytes], shingle: int, rows: int, count: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    sizes, values = shingle_sets(texts, shingle)
    ends = (np.cumsum(sizes) * 8).tolist()
    raw = memoryview(values).cast("B") if len(values) else b""
    prints = [hashlib.blake2b(raw[e - 8 * s : e], digest_size=16).digest() for e, s in zip(ends, sizes.tolist(), strict=True)]
    return sizes, prints, bands(sketches(sizes, values, rows * count), rows)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows of about CHUNK_BYTES, and their texts: those of the whole batch aren't made at once."""
    column = batch.column("text").cast(pa.large_binary())
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        if size and size + n > CHUNK_BYTES:
            yield at, i, column.slice(at, i - at).to_pylist()
            at, size = i, 0
        size += n + 1
    if at < len(column):
        yield at, len(column), column.slice(at).to_pylist()


@common.releasing
def _sketched(batches: Iterator[pa.RecordBatch], *, shingle: int, rows: int, count: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in _chunks(batch):
            sizes, prints, keys = _fingerprints(texts, shingle, rows, count)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), count).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("text_hash").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), keys], names=["doc_id", "text_hash", "n_shingles", "print", "bands"])


@common.releasing
def _sets(batches: Iterator[pa.RecordBatch], *, shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in _chunks(batch):
            sizes, values = shingle_sets(texts, shingle)
            parts = [x.tobytes() for x in np.split(values, np.cumsum(sizes)[:-1])]
            prints = [hashlib.blake2b(p, digest_size=16).digest() for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(prints, pa.binary()), pa.array(parts, pa.binary())], names=["doc_id", "print", "set"])


def _node(doc_id: str, fingerprint: str) -> Column:
    """16 bytes that sort like doc_id and tell apart texts that share one."""
    return F.concat(F.unhex(F.lpad(F.hex(F.col(doc_id).bitwiseXOR(F.lit(-(2**63)))), 16, "0")), F.substring(F.col(fingerprint), 1, 8))


def _links_of(left: np.ndarray, right: np.ndarray, comps: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(left, right) of sets that are linked and in different components, one for each left set and component at most."""
    sizes = np.asarray([len(s) for s in sets])
    values, index = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(index) > 1
    column = np.cumsum(often) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)[often[index]]
    column = column[index[often[index]]]
    both = np.zeros((len(left), len(right)), np.float32)
    place = {int(d): i for i, d in enumerate(left)}, {int(d): i for i, d in enumerate(right)}
    rows = [np.asarray([p.get(d, -1) for d in range(len(sets))]) for p in place]
    for at in range(0, int(often.sum()), COLUMNS):
        own = (column >= at) & (column < at + COLUMNS)
        matrices = []
        for r, n in zip(rows, both.shape, strict=True):
            m = np.zeros((n, COLUMNS), np.float32)
            mine = own & (r[owner] >= 0)
            m[r[owner[mine]], column[mine] - at] = 1
            matrices.append(m)
        both += matrices[0] @ matrices[1].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    _, code = np.unique(np.asarray(comps, object), return_inverse=True)
    hit = (100 * both >= percent * union) & (code[left][:, None] != code[right][None, :])
    found = []
    for i, j in zip(*np.nonzero(hit), strict=True):
        found.append((int(left[i]), int(right[j]), int(code[right[j]])))
    return [(i, j) for (i, _), j in {(i, c): j for i, j, c in reversed(found)}.items()]


def _compared(table: pa.Table, percent: int) -> pa.Table:
    """Links in a table of groups, between components: each group's left sets against its right ones."""
    a, b = [], []
    group = table.column("group").to_pylist()
    node, comp, raw = (table.column(c).to_pylist() for c in ("node", "comp", "set"))
    is_left, is_right = table.column("is_left").to_pylist(), table.column("is_right").to_pylist()
    members: dict[bytes, dict[bytes, int]] = {}
    for i, (g, n) in enumerate(zip(group, node, strict=True)):
        first = members.setdefault(g, {}).setdefault(n, i)
        is_left[first] |= is_left[i]
        is_right[first] |= is_right[i]
    for rows in members.values():
        own = list(rows.values())
        left = np.asarray([k for k, i in enumerate(own) if is_left[i]], np.int64)
        right = np.asarray([k for k, i in enumerate(own) if is_right[i]], np.int64)
        if len(left) and len(right):
            for i, j in _links_of(left, right, [comp[i] for i in own], [np.frombuffer(raw[i], np.uint64) for i in own], percent):
                a.append(comp[own[i]])
                b.append(comp[own[j]])
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _verified(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: components linked by left and right members (group, node, comp, n of shingles, is_left, is_right; a written
    table) of each group. Large groups are cut into blocks, small ones are put together."""
    of = lambda side, x: F.coalesce(F.sum(F.when(F.col(side), x)), F.lit(0))
    n, one = F.col("n"), F.lit(1)
    sizes = members.groupBy("group").agg(F.count(one).alias("size"), *(of(side, x).alias(name) for name, side, x in (("nl", "is_left", one), ("nr", "is_right", one), ("wl", "is_left", n), ("wr", "is_right", n))))
    rows, shingles = members.agg(F.count(one), F.coalesce(F.sum("n"), F.lit(0))).first()
    packs = max(common.partitions_for(members.sparkSession, rows, PACK), 4 * common.partitions_for(members.sparkSession, 8 * shingles, BLOCK_BYTES))
    blocks = lambda count, weight, most: F.greatest(F.ceil(F.col(count) / most), F.ceil(F.col(weight) * 8 / BLOCK_BYTES), F.lit(1).cast("long"))
    nl, nr = blocks("nl", "wl", LEFT), blocks("nr", "wr", RIGHT)
    sizes = common.written(sizes.select("group", "size", nl.alias("nl"), nr.alias("nr"), ((nl == 1) & (nr == 1) & (F.col("nl") + F.col("nr") <= SMALL)).alias("whole")), "group-sizes")
    known = common.join_salted(members, sizes, "group", F.col("size"), rows, F.col("node")).join(sets, "node")
    # Sets are joined once a member, then go to each of its blocks.
    own, first, span = F.xxhash64("node"), F.lit(0).cast("long"), lambda x: F.sequence(F.lit(0).cast("long"), x - 1)
    place = lambda lb, rb, left, right: F.struct(lb.alias("lb"), rb.alias("rb"), left.alias("is_left"), right.alias("is_right"))
    yes, no = F.lit(True), F.lit(False)
    as_left = F.when(F.col("is_left"), F.transform(span(F.col("nr")), lambda b: place(F.pmod(own, F.col("nl")), b, yes, no)))
    as_right = F.when(F.col("is_right"), F.transform(span(F.col("nl")), lambda b: place(b, F.pmod(own, F.col("nr")), no, yes)))
    as_small = F.array(place(first - 1, F.pmod(F.xxhash64("group"), F.lit(packs)), F.col("is_left"), F.col("is_right")))
    none = F.array().cast("array<struct<lb:bigint,rb:bigint,is_left:boolean,is_right:boolean>>")
    places = F.when(F.col("whole"), as_small).otherwise(F.concat(F.coalesce(as_left, none), F.coalesce(as_right, none)))
    dealt = known.select("group", "node", "comp", "set", F.explode(places).alias("at")).select("group", "node", "comp", "at.*", "set")
    task = F.when(F.col("lb") < 0, F.xxhash64("rb")).otherwise(F.xxhash64("group", "lb", "rb"))

    def compared(table: pa.Table) -> pa.Table:
        return _compared(table, percent)

    return dealt.select(task.alias("task"), "group", "node", "comp", "is_left", "is_right", "set").groupBy("task").applyInArrow(compared, "a binary, b binary")


def relabelled(labels: DataFrame, newer: DataFrame) -> DataFrame:
    """labels (node, comp) with comp replaced by that of newer (node, comp) where that has it as a node."""
    labels = common.written(labels, "labels-before")
    used = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("uses"))
    sized = used.join(newer.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp", "left")
    sized = common.written(sized.select("comp", "uses", F.coalesce("new", "comp").alias("new")), "label-sizes")
    found = common.join_salted(labels, sized, "comp", F.col("uses"), labels.count(), F.col("node"))
    return found.select("node", F.col("new").alias("comp"), *(c for c in labels.columns if c not in ("node", "comp")))


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node of each component of links (a, b), as a written table. In a round every node hooks to the
    first of itself and its neighbours, in the order of nodes at first (stars end at once) and then in one that is random in
    each round, and edges go between what their ends hook to; a part of the nodes is gone after each round. Nodes follow
    their hooks in the end."""
    since = common.made()
    edges = common.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    rounds: list[DataFrame] = []
    while n := edges.count():
        at = F.lit(0).cast("long") if not rounds else F.lit(len(rounds)).cast("long")
        place = lambda c: F.struct((F.xxhash64(c, at) if rounds else at).alias("order"), F.col(c).alias("node"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(place("v")).alias("first"), F.count(F.lit(1)).alias("size"))
        hooks = common.written(first.select(F.col("u").alias("node"), F.least(place("u"), "first")["node"].alias("comp"), "size"), "hooks")
        rounds.append(hooks)
        moved = edges
        for end in ("u", "v"):
            sized = hooks.select(F.col("node").alias(end), F.col("comp").alias(f"new_{end}"), "size")
            moved = common.join_salted(moved, sized, end, F.col("size"), n, F.xxhash64("u", "v")).drop("size")
        moved = moved.select(F.greatest("new_u", "new_v").alias("u"), F.least("new_u", "new_v").alias("v")).where("u != v").distinct()
        done = common.written(moved, "edges")
        common.discard(edges)
        edges = done
    labels = (rounds[0] if rounds else links.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)).select("node", "comp")
    for hooks in rounds[1:]:
        labels = relabelled(labels, hooks)
    labels = common.written(labels, "labels")
    least = common.written(labels.groupBy("comp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("size")), "least")
    found = common.join_salted(labels, least, "comp", F.col("size"), labels.count(), F.col("node"))
    return common.finished(found.select("node", F.col("least").alias("comp")), "components", since)


def _doc_id(node: str) -> Column:
    """The doc_id of a node."""
    first = F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)")
    return (first - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def near_duplicates(documents: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, count: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents, and text_hash (xxhash64 of the text) and chosen,
    which unlike kept holds for one text only of a component with several texts of its least doc_id; a written table."""
    since = common.made()
    common.python_workers(documents.sparkSession)
    columns = F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")
    texts, dealt = documents.select(*columns), common.spread(documents).select(*columns)
    sketched = common.written(dealt.withColumn("text_hash", F.xxhash64("text")).mapInArrow(partial(_sketched, shingle=shingle, rows=rows, count=count), "doc_id bigint, text_hash bigint, n_shingles bigint, print binary, bands array<bigint>"), "sketches")

    # Classes: documents with the same set. Only one of each is compared.
    in_class = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = sketched.where(in_class).groupBy("print").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("size"))
    classes = common.written(classes.select("print", "least.text_hash", "bands", "n", "size", _node("least.doc_id", "print").alias("node")), "classes")

    # Buckets with several classes; of buckets with the same members one is enough.
    keyed = classes.select("node", "n", F.posexplode("bands").alias("band", "key")).select("node", "n", F.xxhash64("band", "key").alias("bucket"))
    shape = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
    chosen = common.written(shape.where("size > 1").groupBy("size", "pivot", "sum").agg(F.min("bucket").alias("bucket")).select("bucket", "pivot", "size"), "buckets")
    members = common.written(common.join_salted(keyed, chosen, "bucket", F.col("size"), classes.count() * count, F.col("node")).drop("size"), "members")

    wanted = members.select("node").distinct().select(_doc_id("node").alias("doc_id")).distinct()
    sets = texts.join(wanted, "doc_id", "left_semi").mapInArrow(partial(_sets, shingle=shingle), "doc_id bigint, print binary, set binary")
    sets = common.written(sets.select(_node("doc_id", "print").alias("node"), "set"), "sets")

    # First every member against the least of its bucket; that joins most of a group.
    stars = members.select(F.col("pivot").alias("group"), "node", F.col("node").alias("comp"), "n", (F.col("node") == F.col("pivot")).alias("is_left")).distinct()
    stars = common.written(stars.withColumn("is_right", ~F.col("is_left")), "stars")
    comps = components(_verified(stars, sets, percent))

    # Then, in each bucket, those outside its largest component against all members of other components: every pair that
    # is left has one of them.
    known = common.written(members.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"), "n"), "known")
    shares = known.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = shares.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("size"))
    largest = common.written(largest.where("comps > 1").select("bucket", "largest", "size"), "largest")
    open_rows = common.join_salted(known, largest, "bucket", F.col("size"), known.count(), F.col("node"))
    open_rows = open_rows.select(F.col("bucket").cast("string").cast("binary").alias("group"), "node", "comp", "n", (F.col("comp") != F.col("largest")).alias("is_left"), F.lit(True).alias("is_right"))
    more = components(_verified(common.written(open_rows, "open"), sets, percent))

    labels = classes.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "print", "text_hash", "size")
    labels = relabelled(labels, more).select("print", "size", _doc_id("comp").alias("component_id"), F.when(F.col("comp") == F.col("node"), F.col("text_hash")).alias("chosen_hash"))
    labels = common.written(labels, "labels")
    found = common.join_salted(sketched.where(in_class).drop("bands"), labels, "print", F.col("size"), sketched.count(), F.xxhash64("doc_id", "text_hash"))
    found = found.withColumn("kept", F.col("doc_id") == F.col("component_id")).withColumn("chosen", F.col("kept") & F.col("text_hash").eqNullSafe(F.col("chosen_hash")))
    alone = sketched.where(~in_class).withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id"))).withColumn("kept", F.lit(True)).withColumn("chosen", F.lit(True))
    columns = ["doc_id", "n_shingles", "component_id", "kept", "text_hash", "chosen"]
    return common.finished(found.select(columns).unionByName(alone.select(columns)), "near-duplicates", since)


def deduplicate(documents: DataFrame, **parameters: int) -> DataFrame:
    """documents without all but one text of each component; parameters are near_duplicates'."""
    i, h = common.unused(documents, "_id"), common.unused(documents, "_hash")
    chosen = near_duplicates(documents, **parameters).where("chosen").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(common.text_of()) == F.col(h))
    return documents.join(chosen, same, "left_semi")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=3, percent=85, rows=5, count=32).select("doc_id", "n_shingles", "component_id", "kept")
