"""Removal of passages that an earlier document has too, by super-k-mers of words.

A window is K consecutive words. Its minimiser is the least hash among its runs of GRAM words; consecutive windows of a
document with the same minimiser form a super-k-mer, which travels as one packed string of words to the bucket of its
minimiser, so that a word is sent about three times rather than K times. In a bucket the windows are sorted by hash,
equal hashes are confirmed on the words' bytes, and every window but those of the smallest doc_id is reported. Reports
meet their document again as ranges of words.

Skew: of equal super-k-mers in a chunk of documents only that of the smallest doc_id travels; the windows of the others
are decided on the spot. A passage in any number of documents therefore reaches its bucket at most once a chunk.
Minimisers are counted first: each task keeps the frequent ones of its texts (Misra and Gries), and those that hold more
than HOT_BUCKETS of a bucket's worth of windows are hot. Windows of a hot minimiser are told apart further, by their second
least hash, and such a bucket is dealt over salted groups, as many as the root of the number of chunks, each of which sends
on only the windows that it leaves; so neither a common run of words nor a passage that is everywhere makes a group large.
Texts longer than a chunk are cut into segments that share K - 1 words.

Defined cases: null and empty texts have no words; documents with fewer than K words lose nothing; rows with a null
doc_id take no part and lose nothing; rows that repeat a doc_id don't remove each other's words, and are told apart by
their texts; repeats within one document stay, unless a smaller doc_id has them too. Columns besides doc_id and text, whatever
their names, take no part.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .slices import SPACE, Hashes, gather, mix, same_slices

K = 13
GRAM = 3
#: Bytes of text handled at once, and text bytes for each bucket.
CHUNK_BYTES = 1 << 22
BUCKET_BYTES = 4 << 20
#: Of the compression of packed strings.
LEVEL = 6
#: Part of a bucket's worth of windows beyond which a minimiser is hot, and the least share of all windows that this may be:
#: there are no more than 2 / HOT_SHARE hot minimisers, 1.6 MB of hashes.
HOT_BUCKETS, HOT_SHARE = 0.5, 1e-5


def _min_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of width values, by doubling."""
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        values = np.minimum(values[:-step], values[step:])
        covered += step
    return values


def _second_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least value but the minimum of all runs of width values; the largest number where a run has one value only."""
    least, second, covered = values, np.full(len(values), np.iinfo(np.uint64).max), 1
    while covered < width:
        step = min(covered, width - covered)
        sides = (least[:-step], second[:-step]), (least[step:], second[step:])
        least = np.minimum(sides[0][0], sides[1][0])
        second = np.minimum(*(np.where(a > least, a, b) for a, b in sides))
        covered += step
    return second


def _segments(text: bytes, k: int) -> Iterator[tuple[int, bytes]]:
    """(index of the first word, text) of parts of about CHUNK_BYTES that share k - 1 words."""
    first, at = 0, 0
    while len(text) - at > CHUNK_BYTES:
        end = at + CHUNK_BYTES
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        words = text[at:end].split()
        if end == len(text) or len(words) < k:
            if end == len(text):
                break
            k_words, back = words[max(0, len(words) - k + 1) :], end
        else:
            k_words, back = words[len(words) - k + 1 :], end
        yield first, text[at:end]
        for word in reversed(k_words):
            back = text.rfind(word, at, back)
        if back <= at:  # few and huge words: go on one word further at least
            break
        first, at = first + len(words) - len(k_words), back
    yield first, text[at:]


class _Chunk:
    """Segments of documents, as one buffer of words with a blank behind each, and their super-k-mers: runs (first window,
    number of windows), the minimiser of each, whether it is hot, and its place (what gives the bucket)."""

    def __init__(self, segments: list[tuple[int, int, int, bytes]], k: int, hot: np.ndarray):
        ids, crcs, firsts, texts = zip(*segments, strict=True)
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = SPACE[raw]
        edges = np.flatnonzero(np.diff(space, prepend=True))
        start, end = edges[0::2], edges[1::2]
        size = end - start
        keep = ~space
        keep[end] = True
        self.buf = raw[keep]
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.buf[self.end] = 0x20
        limits = np.cumsum([len(t) + 1 for t in texts])
        self.segment = np.searchsorted(limits, start, side="right")
        self.ids, self.crcs = np.asarray(ids, np.int64), np.asarray(crcs, np.int64)
        counts = np.bincount(self.segment, minlength=len(ids))
        self.word = np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(np.asarray(firsts), counts)
        n = len(start) - k + 1
        self.runs = (np.zeros(0, np.int64),) * 2
        self.minimiser = self.place = np.zeros(0, np.uint64)
        self.hot = np.zeros(0, bool)
        if n <= 0:
            return
        self.bytes = Hashes(self.buf)
        words = self.bytes(self.start, self.end)
        grams = Hashes(words)(np.arange(len(words) - GRAM + 1), np.arange(GRAM, len(words) + 1))
        least = _min_of(grams, k - GRAM + 1)
        valid = self.segment[:n] == self.segment[k - 1 :]
        is_hot, place = np.isin(least, hot) if len(hot) else np.zeros(n, bool), least
        if is_hot.any():
            place = np.where(is_hot, mix(least ^ mix(_second_of(grams, k - GRAM + 1))), least)
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | (place[1:] != place[:-1]) | (self.segment[1:n] != self.segment[: n - 1]) | ~valid[:-1]
        first = np.flatnonzero(new & valid)
        stop = np.concatenate((np.flatnonzero(new | ~valid), [n]))
        self.runs = first, stop[np.searchsorted(stop, first, side="right")] - first  # first window, windows
        self.minimiser, self.place, self.hot = least[first], place[first], is_hot[first]


def _packed(ids: np.ndarray, crcs: np.ndarray, words: np.ndarray, counts: np.ndarray, text: bytes) -> bytes:
    """The columns, ids as differences and bytes of equal weight together, and the text, compressed."""
    head = np.asarray([len(ids)], "<i8").tobytes()
    columns = (np.diff(ids, prepend=0).astype("<i8"), crcs.astype("<u4"), words.astype("<i4"), counts.astype("<i4"))
    return zstandard.compress(head + b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns) + text, LEVEL)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.decompress(blob)
    n, at, found = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in ("<i8", "<u4", "<i4", "<i4"):
        width = int(kind[-1])
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        found.append(np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64))
        at += n * width
    found[0] = np.cumsum(found[0])
    return *found, raw[at:]


NO_MINIMISER = np.zeros(0, np.uint64)


def _super_k_mers(segments: list[tuple[int, int, int, bytes]], k: int, buckets: int, hot: np.ndarray = NO_MINIMISER) -> list[tuple[int, bool, bytes, bool]]:
    """(bucket, decided, packed, hot): super-k-mers for the buckets, and ranges of words decided on the spot."""
    c = _Chunk(segments, k, hot)
    first, windows = c.runs
    if not len(first):
        return []
    start, size = c.start[first], c.end[first + windows + k - 2] - c.start[first]
    ids, crcs = c.ids[c.segment[first]], c.crcs[c.segment[first]]
    hashes = c.bytes(start, start + size)
    order = np.lexsort((ids, hashes))
    leader = np.maximum.accumulate(np.where(np.diff(hashes[order], prepend=~hashes[order[0]]) != 0, np.arange(len(order)), 0))
    later, leads = order, order[leader]
    known = ids[later] > ids[leads]
    known[known] = same_slices(c.buf, start[later[known]], size[later[known]], start[leads[known]], size[leads[known]])
    done, sent = later[known], later[~known]
    out = []
    if len(done):
        out.append((int(ids[done[0]] % buckets), True, _packed(ids[done], crcs[done], c.word[first[done]], windows[done] + k - 1, b""), False))
    bucket = (c.place[sent] % np.uint64(buckets)).astype(np.int64) * 2 + c.hot[sent]
    sent, bucket = sent[by := np.lexsort((sent, bucket))], bucket[by]
    text = gather(c.buf, start[sent], size[sent] + 1)
    text_end = np.cumsum(size[sent] + 1)
    edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        own = sent[a:b]
        out.append((int(bucket[a]) // 2, False, _packed(ids[own], crcs[own], c.word[first[own]], windows[own] + k - 1, text[(text_end[a - 1] if a else 0) : text_end[b - 1]].tobytes()), bool(bucket[a] % 2)))
    return out


def _chunks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Segments (doc_id, crc, first word, text) of about CHUNK_BYTES together."""
    held, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = text.encode()
            crc = zlib.crc32(raw)
            for first, part in _segments(raw, k) if len(raw) > CHUNK_BYTES else [(0, raw)]:
                held.append((doc_id, crc, first, part))
                size += len(part)
                if size >= CHUNK_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _cut(batches: Iterator[pa.RecordBatch], *, k: int, buckets: int, hot: np.ndarray = NO_MINIMISER, salts: int = 1) -> Iterator[pa.RecordBatch]:
    """bucket, salt (below 0 where no minimiser is hot), decided, packed."""
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    for number, segments in enumerate(_chunks(batches, k)):
        rows = _super_k_mers(segments, k, buckets, hot)
        salt = (part + number) % salts
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([salt if r[3] else -1 for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "salt", "decided", "packed"])
    common.release_memory()


def _frequent(batches: Iterator[pa.RecordBatch], *, k: int, most: int, least: float = 0) -> Iterator[pa.RecordBatch]:
    """minimiser, windows: the number of windows of minimisers in a task's texts, and of all with a null minimiser. No more
    than most are kept: beyond that the next one's number is taken off all, so that what is missing from any number is
    less than the windows divided by most. Those below the share least of the windows aren't sent."""
    values, numbers, total = NO_MINIMISER, np.zeros(0, np.int64), 0
    for segments in _chunks(batches, k):
        c = _Chunk(segments, k, NO_MINIMISER)
        total += int(c.runs[1].sum())
        values, at = np.unique(np.concatenate((values, c.minimiser)), return_inverse=True)
        numbers = np.bincount(at, weights=np.concatenate((numbers, c.runs[1])), minlength=len(values)).astype(np.int64)
        if len(values) > most:
            numbers = numbers - np.partition(numbers, len(numbers) - most - 1)[len(numbers) - most - 1]
            values, numbers = values[numbers > 0], numbers[numbers > 0]
    sent = numbers >= least * total
    values, numbers = values[sent], numbers[sent]
    yield pa.RecordBatch.from_arrays([pa.array([*values.view(np.int64).tolist(), None], pa.int64()), pa.array([*numbers.tolist(), total], pa.int64())], names=["minimiser", "windows"])
    common.release_memory()


def hot_minimisers(rows: DataFrame, k: int, buckets: int) -> np.ndarray:
    """Every minimiser with more than HOT_BUCKETS of a bucket's share of the windows of rows (doc_id, text), and perhaps
    some with half of that."""
    share = max(HOT_BUCKETS / buckets, HOT_SHARE)
    # Each of the two bounds takes a quarter of the share off a number at most.
    counted = rows.mapInArrow(partial(_frequent, k=k, most=int(4 / share) + 1, least=share / 4), "minimiser bigint, windows bigint")
    counted = common.written(counted.groupBy("minimiser").agg(F.sum("windows").alias("windows")), "minimisers")
    total = counted.where("minimiser IS NULL").select("windows").first()
    found = counted.where(F.col("minimiser").isNotNull() & (F.col("windows") > (total[0] if total else 0) * share / 2)).select("minimiser").toArrow()
    common.discard(counted)
    return found.column("minimiser").to_numpy().astype(np.int64).view(np.uint64)


def _word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, a block of the buffer at a time, as they take several times its memory."""
    found, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES)))
        base = int(start[at])
        found[at:to] = Hashes(buf[base : int(end[to - 1])])(start[at:to] - base, end[at:to] - base)
        at = to
    return found


def _judged(table: pa.Table, k: int, *, pass_on: bool) -> tuple[np.ndarray, bytes | None]:
    """Ranges of words (doc_id, crc, lo, hi) of a bucket's windows that a smaller doc_id has; and the others as packed
    super-k-mers, if they are to be passed on."""
    ranges, left = [np.zeros((4, 0), np.int64)], None
    ids, crcs, words, counts, texts = [], [], [], [], []
    for decided, blob in zip(table.column("decided").to_pylist(), table.column("packed").to_pylist(), strict=True):
        i, c, w, n, text = _unpacked(blob)
        if decided:
            ranges.append(np.stack((i, c, w, w + n)))
        else:
            ids.append(i), crcs.append(c), words.append(w), counts.append(n), texts.append(text)
    if ids:
        ids, crcs, words, counts = (np.concatenate(x) for x in (ids, crcs, words, counts))
        buf = np.frombuffer(b"".join(texts), np.uint8)
        del texts
        end = np.flatnonzero(buf == 0x20)
        start = np.concatenate(([0], end[:-1] + 1))
        hashes = Hashes(_word_hashes(buf, start, end))
        windows = counts - k + 1
        begin = np.cumsum(counts) - counts
        by_id = np.argsort(ids, kind="stable")  # windows in the order of doc_id: the first of equals is the smallest
        owner = np.repeat(by_id, windows[by_id])
        at = np.arange(len(owner)) - np.repeat(np.cumsum(windows[by_id]) - windows[by_id], windows[by_id])
        word = begin[owner] + at
        value = hashes(word, word + k)
        order = np.argsort(value, kind="stable")
        value = value[order]
        leader = np.maximum.accumulate(np.where(np.diff(value, prepend=~value[0]) != 0, np.arange(len(order)), 0))
        leads = order[leader]
        found = np.flatnonzero(order != leads)
        a, b = word[order[found]], word[leads[found]]
        same = same_slices(buf, start[a], end[a + k - 1] - start[a], start[b], end[b + k - 1] - start[b])
        hit = np.zeros(len(owner), bool)
        hit[order[found]] = same & (ids[owner[order[found]]] > ids[owner[leads[found]]])
        for v in np.unique(value[found[~same]]):  # different windows with the same hash
            least: dict[bytes, int] = {}
            for j in np.sort(order[value == v]).tolist():
                w = buf[start[word[j]] : end[word[j] + k - 1]].tobytes()
                hit[j] = ids[owner[j]] > least.setdefault(w, int(ids[owner[j]]))
        for chosen in (hit, ~hit) if pass_on else (hit,):
            at_hit = np.flatnonzero(chosen)
            if not len(at_hit):
                continue
            new = np.ones(len(at_hit), bool)
            new[1:] = (np.diff(at_hit) != 1) | (owner[at_hit[1:]] != owner[at_hit[:-1]])
            a, b = at_hit[new], at_hit[np.append(new[1:], True)]
            own = owner[a]
            if chosen is hit:
                ranges.append(np.stack((ids[own], crcs[own], words[own] + at[a], words[own] + at[b] + k)))
            else:
                first, size = start[word[a]], end[word[b] + k - 1] + 1 - start[word[a]]
                left = _packed(ids[own], crcs[own], words[own] + at[a], at[b] - at[a] + k, gather(buf, first, size).tobytes())
    return np.concatenate(ranges, axis=1), left


RANGES = "doc_id bigint, crc bigint, lo int, hi int"


def _range_arrays(found: np.ndarray) -> list[pa.Array]:
    return [pa.array(found[0]), pa.array(found[1]), pa.array(found[2], pa.int32()), pa.array(found[3], pa.int32())]


def _repeats(table: pa.Table, k: int) -> pa.Table:
    """Ranges of words (RANGES) of a bucket's windows that a smaller doc_id has."""
    return pa.table(_range_arrays(_judged(table, k, pass_on=False)[0]), names=["doc_id", "crc", "lo", "hi"])


def _repeats_of_part(table: pa.Table, k: int) -> pa.Table:
    """The same of one group of a bucket. Of a salted one a last row has the bucket and what is passed on."""
    salted = table.column("salt")[0].as_py() >= 0
    found, left = _judged(table, k, pass_on=salted)
    ranges, n = _range_arrays(found), found.shape[1]
    if left is not None:
        ranges = [pa.concat_arrays([x, pa.nulls(1, x.type)]) for x in ranges]
    more = left is not None
    bucket = pa.array([None] * n + [table.column("bucket")[0].as_py()] * more, pa.int32())
    return pa.table([*ranges, bucket, pa.array([None] * n + [left] * more, pa.binary())], names=["doc_id", "crc", "lo", "hi", "bucket", "packed"])


def repeated_ranges(documents: DataFrame, *, k: int = K) -> DataFrame:
    """doc_id, crc (of the text), lo, hi: ranges of words, which may overlap, of all windows that a smaller doc_id has. A
    helper table remains."""
    spark = documents.sparkSession
    common.python_workers(spark)
    columns = F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")
    size = documents.select(*columns).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Twice as many as partitions: several in each even out.
    buckets = max(common.partitions_for(spark, size, BUCKET_BYTES), 2 * common.partitions_for(spark, 0, 1))
    rows = common.spread(documents).select(*columns).where("doc_id IS NOT NULL")
    hot, salts = hot_minimisers(rows, k, buckets), 1 + math.isqrt(common.partitions_for(spark, size, CHUNK_BYTES))
    cut = rows.mapInArrow(partial(_cut, k=k, buckets=buckets, hot=hot, salts=salts), "bucket int, salt int, decided boolean, packed binary")

    def of_part(table: pa.Table) -> pa.Table:
        return _repeats_of_part(table, k)

    def repeats(table: pa.Table) -> pa.Table:
        return _repeats(table, k)

    judged = common.written(cut.groupBy("bucket", "salt").applyInArrow(of_part, f"{RANGES}, bucket int, packed binary"), "repeats")
    left = judged.where("packed IS NOT NULL").select("bucket", F.lit(False).alias("decided"), "packed")
    return judged.where("packed IS NULL").select("doc_id", "crc", "lo", "hi").unionByName(left.groupBy("bucket").applyInArrow(repeats, RANGES))


def _keep(words: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    kept, at = [], 0
    for lo, hi in sorted(ranges):
        kept += words[at:lo] if lo > at else []
        at = max(at, hi)
    return kept + words[at:]


def _removed(batches: Iterator[pa.RecordBatch], *, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, kept_n, digests, kept_texts = [], [], [], []
        for text, los, his in zip(*(batch.column(c).to_pylist() for c in ("text", "lo", "hi")), strict=True):
            words = text.encode().split()
            kept = _keep(words, list(zip(los, his, strict=True))) if los else words
            joined = b" ".join(kept)
            n.append(len(words)), kept_n.append(len(words) - len(kept)), digests.append(hashlib.sha256(joined).hexdigest()), kept_texts.append(joined.decode() if texts else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(kept_n, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(documents: DataFrame, *, k: int = K, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null unless texts) for every row of documents, as a written
    table."""
    since = common.made()
    ranges = repeated_ranges(documents, k=k).groupBy("doc_id", "crc").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    rows = rows.withColumn("crc", F.crc32(F.col("text").cast("binary")))
    met = rows.join(ranges, ["doc_id", "crc"], "left").select("doc_id", "text", F.col("ranges.lo").alias("lo"), F.col("ranges.hi").alias("hi"))
    kept = met.mapInArrow(partial(_removed, texts=texts), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    return common.finished(kept, "without-repeats", since)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM hits),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM
         (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
