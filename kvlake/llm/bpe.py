"""Byte-pair encoders with the ids of the tokenizers library.

"byte" vocabularies (byte-level BPE) run in tiktoken, which merges by rank: the tokenizer file's merges are in the order
of their ids, so that an id is a rank. It needs no cache and takes a third of the library's time.

"word" vocabularies (lower case, white space only separates, word ends marked) run in tiktoken too, behind a bounded
cache: in plain texts (NOT_PLAIN finds nothing) a run of other characters is encoded alike wherever it stands, and a text
is the concatenation of its runs. A byte in a word is written as two, a mark and the byte, with another mark for the last
one, so that the symbols of word ends are byte strings of their own. A text with any other character goes to the library
as a whole.

Ids come as little-endian unsigned 32-bit integers. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

#: Characters for which Python and the library agree on white space, letters, digits and lower case: tab, LF, CR,
#: printable ASCII, and Latin up to U+024F without no-break space, soft hyphen, the dotted capital I and two letters whose
#: small forms are far off. Small letters go up to U+02AF.
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-įı-ȹȻ-Ƚȿ-ɏ]")

#: Fixed value: how byte-level BPE cuts a text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A run of white space that is cut off before a text is matched: the pattern looks ahead behind it, for which the matcher
#: goes back over the whole run, and gives up beyond about a million characters.
LONG_BLANKS = 100_000
BLANKS = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_BLANKS},}}")

#: Runs kept, in two generations of this size each, besides as many words, and the longest kept: about 90 MB.
CACHE_UNITS = 160_000
LONGEST_UNIT = 48

#: Fixed value: the words of the "word" vocabularies, for lower-cased plain texts.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ʯ]+|[0-9²³¹¼-¾]|[^\sa-zªµºÀ-ÖØ-öø-ʯ0-9²³¹¼-¾]+")
WORD_END = "</w>"
#: The mark for the last byte of a word, which isn't in UTF-8; that for the others is zero, which isn't in plain texts.
LAST = b"\xff"


def byte_symbols() -> dict[str, int]:
    """The character that byte-level BPE writes for each byte: printable bytes stand for themselves, the others are
    numbered from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _marked(word: bytes, last: bool) -> bytes:
    out = word.decode("latin-1").encode("utf-16-be")  # a zero before each byte
    return out[:-2] + LAST + out[-1:] if last else out


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ByteEncoder:
    """Encodes texts exactly as the byte-level tokenizer in path does without special tokens."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            tokenizer = json.load(f)
        model, byte = tokenizer["model"], byte_symbols()
        ids = [model["vocab"]["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in model["merges"]]
        if tokenizer["pre_tokenizer"]["type"] != "ByteLevel" or tokenizer["pre_tokenizer"]["add_prefix_space"] or tokenizer["normalizer"] or ids != sorted(ids):
            raise ValueError("a byte-level tokenizer whose ids follow its merges is needed")
        special = {t["content"] for t in tokenizer["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        encoding = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode, self._piece = encoding.encode_to_numpy, encoding._encode_single_piece

    def _plain(self, text: str) -> bytes:
        return self._encode(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        if len(text) < LONG_BLANKS:
            return self._plain(text)
        # By the pattern a run is a piece, without its last character where something follows.
        found, at = [], 0
        for run in BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            found += [self._plain(text[at : run.start()]), np.asarray(self._piece(text[run.start() : end].encode()), "<u4").tobytes()]
            at = end
        return b"".join([*found, self._plain(text[at:])])


class WordEncoder:
    """Encodes texts exactly as the tokenizer in path does without special tokens; their strings are ordinary text."""

    def __init__(self, path: str, *, cache_units: int = CACHE_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        with open(path, encoding="utf-8") as f:
            tokenizer = json.load(f)
        model, byte = tokenizer["model"], byte_symbols()
        special = {t["content"] for t in tokenizer["added_tokens"]}
        ids = [model["vocab"]["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in model["merges"]]
        if model["end_of_word_suffix"] != WORD_END or ids != sorted(ids):
            raise ValueError("a tokenizer with word ends whose ids follow its merges is needed")
        ranks = {}
        for token, i in model["vocab"].items():
            if token not in special:
                ranks[_marked(bytes(byte[c] for c in token.removesuffix(WORD_END)), token.endswith(WORD_END))] = i
        ranks |= {bytes([b]): len(model["vocab"]) + b for b in range(256)}  # never left over
        self._word = tiktoken.Encoding("word-end", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.path, self.tokenizer = path, None
        self.limit = cache_units
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = True
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, run: str) -> bytes:
        found, known = b"", self.words
        for word in WORDS.findall(run.lower()):
            ids = known.get(word)
            if ids is None:
                if len(known) > self.limit:
                    known.clear()
                if word.isascii():
                    marked = word.encode("utf-16-be")
                    ids = _little(self._word(marked[:-2] + LAST + marked[-1:]))
                else:
                    ids = _little(self._word(_marked(word.encode(), True)))
                if len(word) <= LONGEST_UNIT:
                    known[word] = ids
            found += ids
        return found

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        if NOT_PLAIN.search(text):
            return self._library([text])[0]
        units, young = text.split(), self.young
        try:
            return b"".join(map(young.__getitem__, units))
        except KeyError:
            absent = set(units).difference(young)
        old, run = self.old, self._run
        for unit in absent:
            young[unit] = old.get(unit) or run(unit)
        found = b"".join(map(young.__getitem__, units))
        for unit in absent:
            if len(unit) > LONGEST_UNIT:
                del young[unit]
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return found


KINDS = {"byte": ByteEncoder, "word": WordEncoder}
_encoders: dict[tuple[str, str], ByteEncoder | WordEncoder] = {}


def encoder(path: str, kind: str) -> ByteEncoder | WordEncoder:
    """One encoder for each worker process."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = KINDS[kind](path)
    return _encoders[path, kind]


def byte_vocabulary() -> str:
    """The byte-level vocabulary for the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_vocabulary() -> str:
    """The word-end vocabulary for the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
