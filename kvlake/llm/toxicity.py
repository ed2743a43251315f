"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's logit is a bias and the sum of the weights of its words; a word has the features of its whole and of its
first bytes, hashed. A document's score is the noisy-or of its sentences, 1 - prod(1 - p). Only documents have labels, so
that the loss is the documents' and its gradient reaches the sentences through the noisy-or; locate() then gives the
sentences that made the score.

The model is trained by one task from a bounded sample of labelled rows (SAMPLE of each label, those of the least hashes
of doc_id, and SAMPLE_BYTES of text); only its weights come to the driver. Every text is scored whole: a long one is read
in parts that are cut between words, and a sentence goes on from part to part. Rows whose crc32(doc_id as text) mod 3 is 1
are never learnt from.

Defined cases: a null text is empty, and an empty text's score is 0; labels that are null, or whose doc_id is null or
without a document, aren't learnt from; of several labels the largest counts, of several texts of a doc_id the least is
learnt from; without labels of both kinds every score is 0. Repeated rows are scored alike; an empty table gives no rows.
Extra columns are carried, one with the name of the score's under another name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .slices import Hashes

#: Labelled documents of each label to learn from at most, and bytes of all their texts together. Texts are learnt from
#: whole; in the order of the hashes of their doc_id, those with which the sum stays below are taken.
SAMPLE = 4000
SAMPLE_BYTES = 64 << 20
#: Documents of those learnt from in which a feature must be, and how much more often among toxic ones, in standard
#: deviations; other features weigh nothing.
LEAST_DOCUMENTS = 5
LEAST_DEVIATION = 4.5
#: Hashed features, and the lengths in bytes of the beginnings of words that are features.
FEATURES = 1 << 21
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
#: Bytes of text handled at once, besides the rest of a word.
CHUNK_BYTES = 1 << 20

#: Kinds of bytes: 0 separates words, 1 belongs to a word, 2 ends a sentence. Bytes of letters beyond ASCII are in words.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[[0x2E, 0x21, 0x3F, 0x0A]] = 2


@dataclass
class Sentences:
    """Sentences of texts; feature indices of all words, a row for each word."""

    text: np.ndarray  # of each sentence
    begin: np.ndarray  # first word of each sentence
    features: np.ndarray
    start: np.ndarray  # byte at which each sentence's first word begins, in its text
    end: np.ndarray


def sentences(texts: list[bytes]) -> Sentences:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[raw]
    edges = np.flatnonzero(np.diff(kind == 1, prepend=False))
    start, end = edges[0::2], edges[1::2]
    limits = np.cumsum([len(t) + 1 for t in texts])
    number = np.cumsum(kind == 2)[start]  # sentence ends before each word
    own = np.searchsorted(limits, start, side="right")
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(number) != 0) | (np.diff(own) != 0)
    begin = np.flatnonzero(new)
    hashes = Hashes(raw)
    features = np.empty((len(start), 1 + len(PREFIXES)), np.int32)
    for i, n in enumerate((None, *PREFIXES)):
        stop = end if n is None else np.minimum(start + n, end)
        salt = np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        features[:, i] = ((hashes(start, stop) ^ salt) % np.uint64(FEATURES)).astype(np.int32)
    shift = (limits - [len(t) + 1 for t in texts])[own[begin]] if len(begin) else begin
    last = np.append(begin[1:], len(start)) - 1 if len(begin) else begin
    return Sentences(own[begin], begin, features, start[begin] - shift, end[last] - shift)


def _segments(text: bytes) -> Iterator[bytes]:
    """Parts of a long text of about CHUNK_BYTES, cut behind sentences where there are any, else between words."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        kind = _KIND[np.frombuffer(text, np.uint8, CHUNK_BYTES, at)]
        ends = np.flatnonzero(kind == 2)
        ends = ends if len(ends) else np.flatnonzero(kind == 0)
        cut = at + int(ends[-1]) + 1 if len(ends) else at + CHUNK_BYTES
        while not len(ends) and cut < len(text):  # to the end of a word that is longer
            kind = _KIND[np.frombuffer(text, np.uint8, min(CHUNK_BYTES, len(text) - cut), cut)]
            ends = np.flatnonzero(kind != 1)
            cut += int(ends[0]) if len(ends) else len(kind)
        yield text[at:cut]
        at = cut
    yield text[at:]


def chunks(texts: list[bytes]) -> Iterator[tuple[Sentences, bool]]:
    """Sentences of texts, some short texts or a part of a long one at a time, with places in texts and in the text; and
    whether the first sentence goes on with the last one before."""
    held: list[bytes] = []
    size = first = 0
    for i, text in enumerate([*texts, None]):
        if held and (text is None or size + len(text) > CHUNK_BYTES):
            s = sentences(held)
            s.text += first
            yield s, False
            held, size = [], 0
        if text is None:
            return
        if len(text) <= CHUNK_BYTES:
            first = first if held else i
            held.append(text)
            size += len(text) + 1
            continue
        at, is_open = 0, False
        for part in _segments(text):
            ends, s = _KIND[np.frombuffer(part, np.uint8)] == 2, sentences([part])
            if len(s.begin):
                goes_on = is_open and not ends[: s.start[0]].any()
                is_open = not ends[s.end[-1] :].any()
                s.text += i
                s.start += at
                s.end += at
                yield s, goes_on
            else:
                is_open = is_open and not ends.any()
            at += len(part)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def __getstate__(self) -> tuple[bytes, bytes, float]:
        """Weights that aren't zero: what is sent to workers is a small part of FEATURES."""
        at = np.flatnonzero(self.weights).astype("<i4")
        return at.tobytes(), self.weights[at].astype("<f4").tobytes(), float(self.bias)

    def __setstate__(self, state: tuple[bytes, bytes, float]) -> None:
        self.weights, self.bias = np.zeros(FEATURES, np.float32), state[2]
        self.weights[np.frombuffer(state[0], "<i4")] = np.frombuffer(state[1], "<f4")

    def evidence(self, s: Sentences) -> np.ndarray:
        """The sum of the weights of each sentence."""
        if not len(s.begin):
            return np.zeros(0)
        return np.add.reduceat(self.weights[s.features].sum(axis=1, dtype=np.float64), s.begin)

    def scored(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, start, end, logit) of sentences, all of each once."""
        held = None
        for s, goes_on in chunks(texts):
            found = [s.text, s.start, s.end, self.evidence(s)]
            if held is not None and goes_on:
                found[1][0] = held[1][0]
                found[3][0] += held[3][0]
            elif held is not None:
                found = [np.concatenate(x) for x in zip(held, found, strict=True)]
            held = [x[-1:].copy() for x in found]  # more of it may follow
            yield *(x[:-1] for x in found[:3]), self.bias + found[3][:-1]
        if held is not None:
            yield *held[:3], self.bias + held[3]

    def surprise(self, texts: list[bytes]) -> np.ndarray:
        """-log(1 - score) of each text: sentences add up."""
        total = np.zeros(len(texts))
        for text, _, _, logit in self.scored(texts):
            total += np.bincount(text, weights=np.logaddexp(0, logit), minlength=len(texts))
        return total


def _telling(texts: list[bytes], y: np.ndarray) -> np.ndarray:
    """Which features are in LEAST_DOCUMENTS documents and, by LEAST_DEVIATION, more often in toxic ones."""
    seen, last = np.zeros((2, FEATURES), np.int32), np.zeros(0, np.int64)
    for s, _ in chunks(texts):
        owner = np.repeat(s.text, np.diff(np.append(s.begin, len(s.features))))
        pairs = np.sort((s.features + FEATURES * owner[:, None]).ravel())  # much faster than hashing them
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        if len(last) and len(pairs) and last[-1] // FEATURES == s.text[0]:  # another part of a long text
            pairs, last = np.setdiff1d(pairs, last, assume_unique=True), np.union1d(last, pairs)
        elif len(pairs):
            last = pairs
        seen += np.bincount(y[pairs // FEATURES].astype(np.int64) * FEATURES + pairs % FEATURES, minlength=2 * FEATURES).reshape(2, FEATURES)
    n, often = np.asarray([(1 - y).sum(), y.sum()]), np.flatnonzero(seen.sum(axis=0) >= LEAST_DOCUMENTS)
    seen = seen[:, often]
    share = seen.sum(axis=0) / n.sum()
    deviation = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n).sum())
    used = np.zeros(FEATURES, bool)
    used[often[deviation >= LEAST_DEVIATION]] = True
    return used


def _uses(texts: list[bytes], used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document of each sentence, and sentence and feature of each use of a used feature."""
    found, n = [[np.zeros(0, np.int64)] for _ in range(3)], 0
    for s, goes_on in chunks(texts):
        word, kind = np.nonzero(used[s.features])
        n -= goes_on
        for x, more in zip(found, (s.text[int(goes_on) :], n + np.searchsorted(s.begin, word, side="right") - 1, s.features[word, kind]), strict=True):
            x.append(more)
        n += len(s.begin)
    return tuple(np.concatenate(x) for x in found)


def train(texts: list[bytes], labels: list[int], *, epochs: int = 8, rate: float = 0.05, decay: float = 0.1, batch: int = 64, bias: float = -4.0, seed: int = 7) -> Model:
    """RMSprop, with a rate that falls to nothing, over batches of documents on the noisy-or's log loss. Weights are never
    negative: words add evidence, and harmless ones in a long sentence hide none. With one label only, the model scores 0."""
    model = Model(np.zeros(FEATURES, np.float32), bias)
    if len(set(labels)) < 2:
        return Model(model.weights, -np.inf)
    y = np.asarray(labels, float)
    weight = (1 - y).sum() / y.sum()  # both labels count alike
    rng = np.random.default_rng(seed)
    used = _telling(texts, y)
    text, sentence, feature = _uses(texts, used)
    batches = []  # of each: the document of each sentence, and sentence and feature of each use
    for at in range(0, len(texts), batch):
        a, b = np.searchsorted(text, (at, at + batch))
        c, d = np.searchsorted(sentence, (a, b))
        batches.append((text[a:b] - at, sentence[c:d] - a, feature[c:d]))
    squares, bias_square = np.full(FEATURES, 1e-4, np.float32), 1e-4
    steps = [p for _ in range(epochs) for p in rng.permutation(len(batches))]
    for step, p in enumerate(steps):
        pace = rate * (1 - step / len(steps))
        (text, sentence, feature), own = batches[p], y[p * batch : (p + 1) * batch]
        z = model.bias + np.bincount(sentence, weights=model.weights[feature], minlength=len(text))
        total = np.bincount(text, weights=np.logaddexp(0, z), minlength=len(own)) + 1e-9
        outer = (1 - own) - weight * own / np.expm1(np.minimum(total, 50))
        by_sentence = outer[text] / (1 + np.exp(-np.maximum(z, -30))) / len(own)
        at, inverse = np.unique(feature, return_inverse=True)
        gradient = np.bincount(inverse, weights=by_sentence[sentence], minlength=len(at)) + decay * model.weights[at] / len(own)
        squares[at] = 0.95 * squares[at] + 0.05 * gradient**2
        model.weights[at] = np.maximum(model.weights[at] - pace * gradient / np.sqrt(squares[at]), 0)
        slope = by_sentence.sum()
        bias_square = 0.95 * bias_square + 0.05 * slope**2
        model.bias -= pace * slope / np.sqrt(bias_square)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def learn(documents: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """A model from at most sample documents of each label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of = lambda toxic: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = of(0).unionByName(of(1))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = common.written(rows.where(F.octet_length("text") <= SAMPLE_BYTES).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over the sample
    fits = rows.select("doc_id", F.sum(F.octet_length("text").cast("long")).over(order).alias("bytes")).where(F.col("bytes") <= SAMPLE_BYTES)
    common.python_workers(documents.sparkSession)
    chosen = rows.join(F.broadcast(fits.select("doc_id")), "doc_id").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = chosen.select("text", "toxic").mapInArrow(_trained, "at binary, weights binary, bias double").first()
    common.discard(rows)
    model = train([], [])
    if found:  # a row from a partition with rows
        model.__setstate__((bytes(found["at"]), bytes(found["weights"]), found["bias"]))
    return model


@common.releasing
def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model's state, from the rows of a partition in their order."""
    texts, labels = [], []
    for batch in batches:
        texts += [t.lower().encode() for t in batch.column("text").to_pylist()]
        labels += batch.column("toxic").to_pylist()
    if not labels:
        return
    state = train(texts, labels).__getstate__()
    del texts
    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(state, (pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["at", "weights", "bias"])


@common.releasing
def _scored(batches: Iterator[pa.RecordBatch], *, model: Model, column: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py().lower().encode() for t in batch.column(column)]  # one by one: no second copy of them all
        score = pa.array(-np.expm1(-model.surprise(texts)))
        names = [n for n in batch.schema.names if n != column]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), score], names=[*names, name])


def score(documents: DataFrame, model: Model, *columns: str, name: str = "score") -> DataFrame:
    """columns of documents (all by default) and the score, as name. A column of that name is renamed, see set_aside."""
    common.python_workers(documents.sparkSession)
    column = common.unused(documents, "_scored")
    rows = common.spread(documents).select(*(F.col(f"`{c}`") for c in columns or documents.columns), common.text_of().alias(column))
    rows = common.set_aside(rows, name)
    schema = rows.drop(column).schema.add(name, "double")
    return rows.mapInArrow(partial(_scored, model=model, column=column, name=name), schema)


def _located(batches: Iterator[pa.RecordBatch], *, model: Model, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            lower, whole = text.lower().encode(), text.encode()
            # Small forms of other lengths move what follows: their characters are matched one by one.
            moved = None if len(lower) == len(whole) else _places(text)
            for _, start, end, logit in model.scored([lower]):
                p = 1 / (1 + np.exp(-logit))
                for j in np.flatnonzero(p >= least).tolist():
                    a, b = int(start[j]), int(end[j])
                    if moved is not None:
                        a, b = int(moved[a]), int(moved[b])
                    rows.append((doc_id, a, b, float(p[j]), whole[a:b].decode(errors="replace")))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "end", "score", "sentence"])


def _places(text: str) -> np.ndarray:
    """For each byte of the text's small form, and for its end, the byte of text where its character begins."""
    sizes = [(len(c.encode()), len(c.lower().encode())) for c in text]
    own, small = np.asarray(sizes, np.int64).T
    return np.append(np.repeat(np.cumsum(own) - own, small), own.sum())


def locate(documents: DataFrame, model: Model, *, least: float = 0.5) -> DataFrame:
    """doc_id, start, end (bytes), score, sentence: the sentences whose own score is least or more."""
    common.python_workers(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return rows.mapInArrow(partial(_located, model=model, least=least), "doc_id bigint, start bigint, end bigint, score double, sentence string")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    model = learn(documents, common.table(spark, sf_dir, "labels"))
    rows = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    return score(rows, model, "doc_id").select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
