"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token exactly one token can be the last one of its encoding.  An
automaton over the vocabulary gives, at each end, the tokens that are suffixes of the prefix;
the longest one that is compatible with the last token of what stands before it is that token.  Two
tokens are compatible if their joined bytes encode to just these two.  Back-pointers from the whole
prefix give the exact ids.  Time is linear in the text, also for very long pre-tokens.

Pre-tokens that were met before come from a table of bounded size in each Python worker.

Defined cases: a null or empty text has no ids and decodes to the empty text; ids and texts are those
of the whole text whatever its length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The pre-token pattern of this kind of vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens that a worker remembers, about 200 bytes each, and the longest one it does.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64
#: Texts without a character from here on are cut by the same pattern in Python's own expressions, which have no \p{}.
LATIN_END = 0x250


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def latin_pattern() -> str:
    """PATTERN for texts of characters below LATIN_END, with the classes written out."""

    def ranges(holds) -> str:
        found = [c for c in range(LATIN_END) if holds(chr(c))]
        starts = [c for c in found if c - 1 not in found]
        ends = [c for c in found if c + 1 not in found]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))

    letters, numbers = (ranges(lambda c, k=k: unicodedata.category(c).startswith(k)) for k in "LN")
    spaces = ranges(lambda c: c in "\t\n\x0b\x0c\r \x85\xa0")
    return PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")


class Remembered(dict):
    """pre-token -> ids as little-endian 32-bit integers, worked out where it is missing."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        found = self.encode(piece.encode())
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class PrefixBpe:
    """Encoder and decoder for a byte-level BPE vocabulary file (JSON, as the tokenizers library writes it)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.decoded = self.bytes_of | {i: s.encode() for s, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.byte_id = {b: vocab[c] for c, b in letters.items()}
        self.automaton = ahocorasick.Automaton()
        for i, raw in self.bytes_of.items():
            self.automaton.add_word(raw.decode("latin-1"), (len(raw), i))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.any_pieces = regex.compile(PATTERN).findall
        self.latin_pieces, self.beyond = re.compile(latin_pattern()).findall, re.compile(f"[^\\u0000-\\u{LATIN_END - 1:04x}]").search
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.known = Remembered(self.encode_piece)

    def merged(self, raw: bytes) -> list[int]:
        """Merges by rank, for the few bytes of one or two tokens."""
        ids = [self.byte_id[b] for b in raw]
        while len(ids) > 1:
            best = min(((self.merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.merge[ids[k], ids[k + 1]][1]]
        return ids

    def compatible(self, left: int | None, right: int) -> bool:
        """left None: right stands alone."""
        fits = self.fits.get((left, right))
        if fits is None:
            if len(self.fits) >= 1_000_000:
                self.fits.clear()
            fits = self.fits[left, right] = self.merged(self.bytes_of.get(left, b"") + self.bytes_of[right]) == ([right] if left is None else [left, right])
        return fits

    def encode_piece(self, raw: bytes) -> tuple[int, ...]:
        last: list[int | None] = [None] * (len(raw) + 1)
        size = [0] * (len(raw) + 1)
        known, compatible, done = self.fits.get, self.compatible, 0
        for end, (length, token) in self.automaton.iter(raw.decode("latin-1")):
            if end < done:  # longer tokens come first, and one of them ends here
                continue
            left = last[end + 1 - length]
            if left is None and end + 1 > length:
                continue
            fits = known((left, token))
            if compatible(left, token) if fits is None else fits:
                done = end + 1
                last[done], size[done] = token, length
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return tuple(ids)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return self.any_pieces(text) if self.beyond(text) else self.latin_pieces(text)

    def encode_raw(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        known = self.known.__getitem__
        parts = self.split(text) if self.split else [text]
        if len(parts) == 1:
            return b"".join(map(known, self.pieces(text)))
        return b"".join(struct.pack("<I", self.special[part]) if k % 2 else b"".join(map(known, self.pieces(part))) for k, part in enumerate(parts))

    def encode(self, text: str) -> list[int]:
        return numbers(self.encode_raw(text))

    def decode(self, ids) -> str:
        return b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", errors="replace")


def numbers(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


_coders: dict[str, PrefixBpe] = {}


def coder(path: str) -> PrefixBpe:
    """One for each vocabulary in a Python worker."""
    if path not in _coders:
        _coders[path] = PrefixBpe(path)
    return _coders[path]


def bpe_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(vocab_path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch["text"]:
                raw = bpe.encode_raw(text)
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(numbers(raw)).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_ids(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(vocab_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": [bpe.encode(t) for t in batch["text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(encoded, "doc_id long, ids array<int>")


def bpe_texts(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id and text of rows of bpe_ids(); null ids decode to the empty text."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(vocab_path)
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "text": pd.Series(["" if ids is None else bpe.decode(map(int, ids)) for ids in batch["ids"]], dtype=object)
            })

    return encoded.select("doc_id", "ids").mapInPandas(texts, "doc_id long, text string")


def byte_bpe_path() -> str:
    """The 50k byte-level vocabulary that is installed on driver and executors."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.llm.common import read_table, small_batches

    small_batches(spark)
    return bpe_digests(read_table(spark, sf_dir, "documents"), byte_bpe_path())
