import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvlake.llm import common, exact_dedup, minhash, substring_dedup

from .conftest import ODD


def varied(seed, n, changes=6):
    """Documents with exact copies, near copies at all distances and shared passages."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 4)))
    bases = [[word() for _ in range(rnd.randrange(2, 90))] for _ in range(max(1, n // 12))]
    out = []
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.randrange(changes)):
            words[rnd.randrange(len(words))] = word()
        if rnd.random() < 0.2:
            words += rnd.choice(bases)[: rnd.randrange(2, 40)]
        out.append((i, rnd.choice((" ", "\n", "  ")).join(words)))
    return out


def brute_windows(rows, k):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1 if i is not None else 0):
            s = tuple(w[j : j + k])
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        w, gone = (t or "").encode().split(), set()
        for j in range(len(w) - k + 1 if i is not None else 0):
            if first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("rows", [ODD, varied(1, 150), varied(2, 150, 1), [(i, "one two three " * 30) for i in range(20)]])
def test_repeats(spark, sf_dir, rows):
    found = substring_dedup.op2_substring_dedup(spark, sf_dir(rows)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute_windows(rows, 13), key=str)


def test_repeats_without_rows(spark, sf_dir):
    assert substring_dedup.op2_substring_dedup(spark, sf_dir([])).count() == 0


@pytest.mark.parametrize("chunk", [60, 300, 1 << 20])
def test_chunks_and_buckets(monkeypatch, chunk):
    """Segments of long texts, several chunks and buckets give what one gives."""
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    rows = varied(3, 60)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    by = {}
    for b in substring_dedup._cut(iter([batch]), k=13, buckets=5):
        for r in b.to_pylist():
            by.setdefault(r["bucket"], []).append(r)
    gone = {}
    for v in by.values():
        found = substring_dedup._repeats(pa.table({"decided": [r["decided"] for r in v], "packed": [r["packed"] for r in v]}), 13)
        for r in found.to_pylist():
            gone.setdefault(r["doc_id"], set()).update(range(r["lo"], r["hi"]))
    assert {i: len(gone.get(i, ())) for i, _ in rows} == {i: n for i, _, n, _ in brute_windows(rows, 13)}


def test_colliding_hashes_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup.Hashes, "__call__", lambda self, a, b: np.zeros(len(a), np.uint64))
    rows = varied(4, 12)
    found = substring_dedup._super_k_mers([(i, zlib.crc32(t.encode()), 0, t.encode()) for i, t in rows], 13, 1)
    table = substring_dedup._repeats(pa.table({"decided": [r[1] for r in found], "packed": [r[2] for r in found]}), 13)
    gone = {}
    for r in table.to_pylist():
        gone.setdefault(r["doc_id"], set()).update(range(r["lo"], r["hi"]))
    assert {i: len(gone.get(i, ())) for i, _ in rows} == {i: n for i, _, n, _ in brute_windows(rows, 13)}


def brute_components(rows, k=3, percent=85):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(sets[a]), None if i is None else least[find(a)], i is None or least[find(a)] == i) for a, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("rows", [ODD, varied(5, 250), varied(6, 200, 3)])
def test_near_duplicates(spark, sf_dir, rows):
    found = minhash.op5_minhash(spark, sf_dir(rows)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute_components(rows), key=str)


def test_near_duplicates_without_rows(spark, sf_dir):
    assert minhash.op5_minhash(spark, sf_dir([])).count() == 0


def test_large_groups_go_in_blocks(spark, sf_dir, monkeypatch):
    for name, n in (("LEFT", 4), ("RIGHT", 8), ("SMALL", 3)):
        monkeypatch.setattr(minhash, name, n)
    rows = varied(7, 150, 4)
    found = minhash.op5_minhash(spark, sf_dir(rows)).collect()
    assert sorted(map(tuple, found)) == sorted(brute_components(rows))


def test_near_dedup_of_rows(spark, docs):
    rows = varied(8, 80, 2) + [(None, "q r s t"), (500, None), (501, ""), (600, "a b c d e f"), (600, "A b c d e f")]
    kept = minhash.deduplicate(docs(rows))
    expected = {i for i, _, _, kept_ in brute_components(rows, 5, 80) if kept_}
    assert {r.doc_id for r in kept.collect()} == expected and kept.where("doc_id = 600").count() == 1
    assert kept.columns == docs(rows).columns


def test_sketches():
    rnd = np.random.default_rng(1)
    sets = [rnd.integers(0, 2**64, n, dtype=np.uint64) for n in (1, 2, 10, 500)]
    sets.append(np.concatenate((sets[3][:400], rnd.integers(0, 2**64, 100, dtype=np.uint64))))
    sets = [np.unique(s) for s in sets]
    table = minhash.sketches(np.asarray([len(s) for s in sets]), np.concatenate(sets), 160)
    assert (table != np.iinfo(np.uint64).max).all()  # every coordinate is filled, even by one element
    assert abs((table[3] == table[4]).mean() - 400 / 600) < 0.15
    # The reference: rounds one element at a time.
    for s, row in zip(sets, table, strict=True):
        alone = minhash.sketches(np.asarray([len(s)]), s, 160)
        assert (alone[0] == row).all()


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(1, 60)], [(1, i) for i in range(2, 40)] + [(50, i) for i in range(51, 70)] + [(39, 69)]])
def test_components(spark, edges):
    key = lambda i: bytearray(i.to_bytes(4, "big"))
    links = spark.createDataFrame([(key(a), key(b)) for a, b in edges], "a binary, b binary")
    group = {n: n for e in edges for n in e}
    for _ in edges:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    found = minhash.components(links).collect()
    assert {int.from_bytes(r.node, "big"): int.from_bytes(r.comp, "big") for r in found} == group and len(found) == len(group)


def test_exact_verdicts(spark, sf_dir):
    rows = ODD + [(100 + i, "hot") for i in range(300)]
    found = exact_dedup.op7_exact_dedup(spark, sf_dir(rows)).collect()
    best, size = {}, {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
        size[t or ""] = size.get(t or "", 0) + 1
    expected = [(i, best[t or ""], size[t or ""], i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_exact_without_rows(spark, sf_dir):
    assert exact_dedup.op7_exact_dedup(spark, sf_dir([])).count() == 0


def test_index_grows(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = index.add(docs([(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c")]))
    assert sorted((str(r.doc_id), r.text) for r in first.collect()) == [("2", "a"), ("4", ""), ("5", "b"), ("None", "c")]
    second = index.add(docs([(6, "a"), (7, "d"), (8, "d"), (9, "e")]).withColumn("digest", F.lit("clash")).withColumn("_n", F.lit(1)))
    assert sorted((r.doc_id, r.text, r.digest) for r in second.collect()) == [(8, "d", "clash"), (9, "e", "clash")]
    assert index.table().count() == 6
    late = exact_dedup.verdicts(docs([(10, "a"), (11, "f")]), index)
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in late.collect()) == [(10, 2, False), (11, 11, True)]
    plan = index.unseen(index.table().limit(3))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    index.drop()


def test_small_batches_on_a_large_index(spark, docs, monkeypatch):
    index, salted = exact_dedup.DigestIndex(spark, buckets=3), []

    def watched(rows, sized, key, size, total, by, join=common.join_salted):
        salted.append((sized.count(), sized.where(size * common.HOT_SHARE > total).count()))
        return join(rows, sized, key, size, total, by)

    monkeypatch.setattr(common, "join_salted", watched)
    assert exact_dedup.verdicts(docs([(i, f"text {i % 1500}") for i in range(3000)]), index).where("kept").count() == 1500
    found = exact_dedup.verdicts(docs([(9001, "text 7"), (9002, "new"), (9003, "new")]), index).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == [(9001, 1507, 2, False), (9002, 9003, 2, False), (9003, 9003, 2, True)]
    assert salted == [(1500, 0), (2, 2)]
    index.drop()
