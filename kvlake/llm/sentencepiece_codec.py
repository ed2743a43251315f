"""SentencePiece encoding and decoding with a prefix table.

For a merge-type (BPE) model every prefix of a text has one last token. An automaton over the pieces yields those that
end at each position; the last token of a prefix is the one among them that is compatible with the last token of the
prefix before it. Two tokens are compatible when the concatenation of their texts is encoded as just these two. The ids
are then recovered backwards from the end. Time is linear in the text, whatever its length.

A text is cut into units before characters where no piece can reach across: pieces hold the space symbol only at their
start, and characters outside the vocabulary stand alone. A bounded cache keeps units and compatible pairs.

Defined cases: a null text is empty; an empty text has no ids (besides an end id that is asked for); control strings in
a text are ordinary text; decode() gives U+FFFD for each invalid byte, as the library does; rows may repeat, and an empty
table gives no rows; a column that has the name of a result's is kept under another name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import common

SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "
#: Units kept, in two generations of this size each, the longest unit kept, and pairs kept.
CACHE_UNITS = 250_000
LONGEST_UNIT = 48
CACHE_PAIRS = 1_000_000


class PieceCodec:
    """Encodes and decodes as the merge-type model in path does, whose normalizer is the identity with a dummy prefix."""

    def __init__(self, path: str, *, cache_units: int = CACHE_UNITS):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        self.is_byte, self.control, self.unknown = set(), set(), model.unk_id()
        self.end_id = model.eos_id()
        automaton = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_id[value] = i
                self.is_byte.add(i)
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.control.add(i)
                self.bytes_of.append(UNKNOWN_SURFACE.encode() if model.is_unknown(i) else b"")
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                automaton.add_word(piece, (i, len(piece)))
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        automaton.make_automaton()
        self.matches = automaton.iter
        self.piece = {i: p for p, i in self.ids.items()}
        characters = {c for p in self.ids for c in p}
        if not characters <= self.ids.keys() or any(SPACE in p.lstrip(SPACE) for p in self.ids) or model.normalize(f" a  {SPACE}\nＡ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}{SPACE}\nＡ{SPACE}":
            raise ValueError("a merge-type model with an identity normalizer, a dummy prefix and space symbols only at the start of pieces is needed")
        alone = "".join(re.escape(c) for c in "\t\n\r" if c not in characters)
        self.split = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")).findall
        self.pairs: dict[int, bool] = {}
        self.limit = cache_units
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The definition: merge the adjacent pair that makes the best piece, the leftmost of equals, until none is left.
        For short texts, as it takes quadratic time."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the text of tokens a and b is encoded as just these; with a below 0, whether b's text is as b alone."""
        right = self.piece[b]
        return self.merged(right) == [right] if a < 0 else self.merged(self.piece[a] + right) == [self.piece[a], right]

    def encode_unit(self, text: str) -> list[int]:
        n, pairs, tokens = len(text), self.pairs, len(self.bytes_of)
        last, length = [-1] * (n + 1), [1] * (n + 1)  # -1: the beginning, or a character outside the vocabulary
        for end, (token, size) in self.matches(text):
            end += 1
            if last[end] >= 0:
                continue
            key = (last[end - size] + 1) * tokens + token
            fits = pairs.get(key)
            if fits is None:
                if len(pairs) > CACHE_PAIRS:
                    pairs.clear()
                fits = pairs[key] = self._compatible(last[end - size], token)
            if fits:
                last[end], length[end] = token, size
        ids, end = [], n
        while end:
            if last[end] < 0:
                ids += [self.byte_id[b] for b in reversed(text[end - 1].encode())]
            else:
                ids.append(last[end])
            end -= length[end]
        return ids[::-1]

    def encode(self, text: str, *, end: bool = False) -> np.ndarray:
        """The ids of text, with the end id if asked for."""
        units = self.split(SPACE + text.replace(" ", SPACE)) if text else []
        young, old = self.young, self.old
        try:
            packed = b"".join(map(young.__getitem__, units))
        except KeyError:
            absent = set(units).difference(young)
            for unit in absent:
                young[unit] = old.get(unit) or np.asarray(self.encode_unit(unit), dtype="<u4").tobytes()
            packed = b"".join(map(young.__getitem__, units))
            for unit in absent:
                if len(unit) > LONGEST_UNIT:
                    del young[unit]
            if len(young) > self.limit:
                self.old, self.young = young, {}
        if end:
            packed += np.asarray([self.end_id], dtype="<u4").tobytes()
        return np.frombuffer(packed, dtype="<u4")

    def decode(self, ids: list[int]) -> str:
        """The text of ids. The space of the dummy prefix goes; control ids give nothing."""
        while ids and ids[0] in self.control and ids[0] != self.unknown:
            ids = ids[1:]
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        if ids and ids[0] not in self.is_byte and ids[0] != self.unknown and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)


def _lenient(raw: bytes) -> str:
    """Decodes UTF-8 with U+FFFD for each byte that begins no valid character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append("�")
        at += size
    return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each worker process."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _encode(batches: Iterator[pa.RecordBatch], *, model: str, text_col: str, end: bool) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    for batch in batches:
        ids = [c.encode(t or "", end=end).astype(np.int32) for t in batch.column(text_col).to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "ids"])


def encode(df: DataFrame, *, model: str, text_col: str = "text", end: bool = False) -> DataFrame:
    """df with a column ids (array<int>), the tokens of text_col."""
    common.python_workers(df.sparkSession)
    df = common.set_aside(df, "ids")
    schema = StructType([*df.schema.fields, StructField("ids", ArrayType(IntegerType()))])
    return df.mapInArrow(partial(_encode, model=model, text_col=text_col, end=end), schema)


def _decode(batches: Iterator[pa.RecordBatch], *, model: str, ids_col: str) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    for batch in batches:
        texts = pa.array([c.decode(x or []) for x in batch.column(ids_col).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])


def decode(df: DataFrame, *, model: str, ids_col: str = "ids") -> DataFrame:
    """df with a column decoded, the text of the tokens in ids_col (null: empty)."""
    common.python_workers(df.sparkSession)
    df = common.set_aside(df, "decoded")
    schema = StructType([*df.schema.fields, StructField("decoded", StringType())])
    return df.mapInArrow(partial(_decode, model=model, ids_col=ids_col), schema)


def _digests(batches: Iterator[pa.RecordBatch], *, model: str) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    decimal = [str(i) for i in range(len(c.bytes_of))]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        n, of_ids, of_text = [], [], []
        for text in batch.column("text").to_pylist():
            ids = c.encode(text or "", end=True).tolist()
            n.append(len(ids))
            of_ids.append(sha(" ".join(map(decimal.__getitem__, ids))))
            of_text.append(sha(c.decode(ids)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def model_path() -> str:
    """The model for the registered query."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, then decodes what it encoded, in one pass over the texts: ids of a document never leave the worker."""
    common.python_workers(spark)
    rows = common.spread(common.table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_digests, model=model_path()), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
