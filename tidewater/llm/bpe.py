"""BPE encoding and decoding with a vocabulary file of the tokenizers library.

A word's merges run on a contiguous rank array: part boundaries and the ranks of adjacent parts in
lists; the least rank (leftmost of equals) is looked up, its boundary deleted and the two neighbouring
ranks refreshed, until no pair has a rank. Words longer than LONG parts, for which those scans would
grow with the square of the length, take the same merges from a heap. Results of white-space
separated pieces are kept in a dictionary of bounded size in each Python worker.

The kind of file understood: NFC, white space collapsed, lower case; a splitting pattern; byte-level
symbols; an end-of-word suffix; special tokens cut out of the raw text; no decoder, so that
decoding joins tokens with blanks.

Defined results: null text counts as empty; empty or white text has no ids and decodes to ""; texts
of any length are encoded whole; repeated rows and extra columns are kept apart (only the columns named
are read); an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, lean

#: White space of the library's pattern engine (Python's also has \x1c-\x1f).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The library knows Unicode 16 (and lower cases of 17), Python may know less and the pattern module more. First and last
#: code point of where Unicode 16 added letters and digits; lower cases that Unicode 16 and 17 added, by first and last code point, and
#: the lower case of the first.
ADDED = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4), (0x11380, 0x113E2), (0x116D0, 0x116E3),
    (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF),
]
LOWER = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
_LOWER = {first + i: low + i for first, last, low in LOWER for i in range(last - first + 1)}
#: Words with more parts use a heap; pieces kept in a worker's dictionary and again in the one before; longest kept there.
LONG, KEPT, KEPT_LENGTH = 64, 80_000, 64
#: Bits of an id; the rank of a pair that is never merged.
BITS = 20
MASK, NONE = (1 << BITS) - 1, 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    kept = set(plain)
    return [chr(b) if b in kept else chr(next(other)) for b in range(256)]


def _added(cp: int) -> bool:
    return any(first <= cp <= last for first, last in ADDED)


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        # a pair of ids, packed, gives its rank and, in the low bits, the id it becomes
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << BITS | self.vocab[b]] = rank << BITS | self.vocab[a + b]
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + suffix] for s in symbols]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(split.replace("\\s", SPACE))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word."""
        inner = self.inner
        parts = [inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > LONG:
            return self._merged_by_heap(parts)
        get = self.ranks.get
        ranks = [get(a << BITS | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i] = new = least & MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << BITS | new, NONE)
            if i < len(ranks):
                ranks[i] = get(new << BITS | parts[i + 1], NONE)
        return parts

    def _merged_by_heap(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        alive = [True] * n
        heap = [(get(parts[i] << BITS | parts[i + 1], NONE), i, parts[i], parts[i + 1]) for i in range(n - 1)]
        heap = [x for x in heap if x[0] != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = rank & MASK, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (found := get(parts[left] << BITS | parts[after[left]], NONE)) != NONE:
                    heapq.heappush(heap, (found, left, parts[left], parts[after[left]]))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def _words(self, piece: str) -> list[str]:
        if max(piece) < "\u0378" or not any(unicodedata.category(c) == "Cn" for c in piece):  # below, all are assigned
            return self.split.findall(piece)
        known = "".join(c if unicodedata.category(c) != "Cn" or _added(ord(c)) else "\ue000" for c in piece)
        return [piece[m.start() : m.end()] for m in self.split.finditer(known)]

    def _piece(self, piece: str) -> bytes:
        """Packed ids of text without white space and special tokens."""
        if out := self.older.get(piece):
            self.kept[piece] = out
            return out
        if piece.isascii() and piece.isalpha():
            ids = self.merged(piece.lower().encode())
        else:
            plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            if max(plain) >= "\u1c89":
                plain = plain.translate(_LOWER)
            ids = [i for word in self._words(plain.lower()) for i in self.merged(word.encode())]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT:  # what was used since the last time stays in older
                self.older, self.kept = self.kept, {}
            self.kept[piece] = out
        return out

    def _run(self, text: str) -> list[bytes]:
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        pieces = [p for p in re.split(f"[{SPACE}]+", text) if p] if odd else text.split()
        get, piece = self.kept.get, self._piece
        return [get(p) or piece(p) for p in pieces]

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut and "<" in text and self.cut.search(text):
            found: list[bytes] = []
            for part in self.cut.split(text):
                found += [struct.pack("<I", self.special[part])] if part in self.special else self._run(part)
        else:
            found = self._run(text)
        return b"".join(found)

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids, and the text decoded from them."""
        ids = self.ids(text)
        return ids, self.decode(unpacked(ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; unknown ids are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for batch in batches:
            keys, texts, found, size, start = batch.column(0), batch.column(1), [], 0, 0
            for i, value in enumerate(texts):
                found.append(coder.ids(value.as_py() or ""))
                size += len(found[-1])
                if size >= 1 << 20 or i == len(texts) - 1:
                    yield pa.record_batch([keys.slice(start, len(found)), pa.array(found, pa.binary())], names=["key", "ids"])
                    found, size, start = [], 0, i + 1

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for batch in batches:
            found, size, start = [], 0, 0
            for i, value in enumerate(batch.column("ids")):
                found.append(coder.decode(unpacked(value.as_py() or b"")))
                size += len(found[-1])
                if size >= 1 << 20 or i == batch.num_rows - 1:
                    rows = batch.slice(start, len(found))
                    yield pa.record_batch([*rows.columns, pa.array(found, pa.string())], names=[*rows.schema.names, "decoded"])
                    found, size, start = [], 0, i + 1

    return run


def decode(df: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """keep, ids and decoded (string, the text of the column ids) of every row; null ids decode to ""."""
    bounded_batches(df.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    found = df.select(*[F.col(c).alias(n) for n, c in zip(names, keep, strict=True)], F.col(ids).alias("ids")).mapInArrow(lean(_decoded(vocabulary)), f"{kinds}, ids binary, decoded string")
    return found.withColumnsRenamed(dict(zip(names, keep, strict=True)) | {"ids": ids})


def encode(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (binary, little-endian unsigned 32-bit) and decoded (string, read from ids again) of every row.

    vocabulary: path of the file, there on every executor.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    found = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(lean(_encoded(vocabulary)), f"key {kind}, ids binary")
    return decode(found, vocabulary, keep=("key",)).withColumnRenamed("key", key)


def digests(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, ids_sha256 and decoded_sha256."""
    return encoded.select(*keep, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
