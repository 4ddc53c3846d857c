"""Exact byte-pair encoding without a merge loop, and decoding by offsets.

A vocabulary file of the tokenizers library gives the merges.  An Aho-Corasick automaton over all
token strings finds the longest token at each byte; tokens are taken from left to right, each one
checked against its left neighbour in a table of compatible pairs, and a position from which no
token fits is never tried again.  This gives the tokens that merging in rank order gives, in time
linear in the bytes.  Decoding looks each id up in a table of byte offsets.

Texts are first cut into pre-tokens, whose ids a worker remembers in a cache of bounded size.
Special tokens that stand in a text are one id each, as in the library.  A null text is empty and
has no ids; no text is cut off.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that byte-level vocabularies cut texts by.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens a worker remembers; the cache starts anew beyond it.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are encoded but not remembered.
CACHE_BYTES = 64

Batches = Iterator[pa.RecordBatch]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, their ids, and what the encoder looks up."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = byte_letters()
        ids = model["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]

        # Inside, a token is numbered by rank: bytes first, then merges in their order.
        names = [name for name in letters if name in ids]
        number = {name: i for i, name in enumerate(names)}
        self.parts: list[tuple[int, int] | None] = [None] * len(names)
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = number[left], number[right]
            if left + right not in number:
                number[left + right] = len(names)
                names.append(left + right)
                self.parts.append(pair)
            self.merged.setdefault(pair, number[left + right])
        self.ids = np.array([ids[name] for name in names], dtype=np.uint32)
        self.strings = [bytes(letters[c] for c in name) for name in names]
        self.lengths = [len(s) for s in self.strings]
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}

        self.automaton = ahocorasick.Automaton()
        for i, string in enumerate(self.strings):
            self.automaton.add_word(string.decode("latin-1"), i)
        self.automaton.make_automaton()
        by_string = {s: i for i, s in enumerate(self.strings)}
        self.shorter = [self._longest_prefix(s, by_string) for s in self.strings]
        self.compatible: dict[tuple[int, int], bool] = {}

        # Decoding: the bytes of id i are blob[offsets[i]:offsets[i + 1]].
        of_id = dict(zip(self.ids.tolist(), self.strings, strict=True))
        of_id |= {i: content.encode() for content, i in self.special.items()}
        widths = np.zeros(max(of_id) + 1, dtype=np.int64)
        for i, string in of_id.items():
            widths[i] = len(string)
        self.offsets = np.concatenate(([0], np.cumsum(widths)))
        self.blob = np.frombuffer(b"".join(of_id[i] for i in sorted(of_id)), dtype=np.uint8)

        self.pre_tokens = regex.compile(PRE_TOKENS)
        specials = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None

    @staticmethod
    def _longest_prefix(string: bytes, by_string: dict[bytes, int]) -> int:
        for end in range(len(string) - 1, 0, -1):
            if string[:end] in by_string:
                return by_string[string[:end]]
        return -1

    def fits(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the two tokens side by side; kept in a table."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) > 4 * CACHE_ENTRIES:
                self.compatible.clear()
            known = self.compatible[left, right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo the merges of both sides, latest first; a merge across the border that would have come earlier joins them."""
        bound = len(self.strings)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            # A merge across the border must come before the one undone next.  Of equal ranks
            # the left one was made first.
            undo_left, undo_right = self.parts[left], self.parts[right]
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or (undo_left is not None and left > right):
                bound, left = left, undo_left[1]
            else:
                bound, right = right + 1, undo_right[0]

    def longest_at(self, text: str) -> list[int]:
        """For each byte the longest token that starts there."""
        longest = [0] * len(text)
        for end, token in self.automaton.iter(text):
            longest[end + 1 - self.lengths[token]] = token
        return longest

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of one pre-token."""
        longest = self.longest_at(piece.decode("latin-1"))
        size, lengths, shorter = len(piece), self.lengths, self.shorter
        open_at = bytearray(b"\x01") * (size + 1)
        taken: list[int] = []
        at, token = 0, longest[0] if size else -1
        while at < size:
            last = taken[-1] if taken else -1
            while token >= 0:
                end = at + lengths[token]
                if open_at[end] and (last < 0 or self.fits(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at += lengths[token]
                token = longest[at] if at < size else -1
            else:
                open_at[at] = 0
                token = taken.pop()
                at -= lengths[token]
        return taken

    def encode_ids(self, piece: str) -> bytes:
        """Little-endian 32-bit ids of one pre-token."""
        return self.ids[self.encode_piece(piece.encode())].astype("<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        starts, ends = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1]
        widths = ends - starts
        before = np.cumsum(widths) - widths
        return self.blob[np.repeat(starts - before, widths) + np.arange(widths.sum())].tobytes()

    def spans(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary stretches of a text, and the special tokens between them with their ids."""
        if self.split_special is None or not any(s in text for s in self.special):
            yield text, None
            return
        for i, part in enumerate(self.split_special.split(text)):
            if part:
                yield part, self.special[part] if i % 2 else None


class Cache(dict):
    """Pre-token to what ``make`` gives for it; bounded."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        value = self.make(piece)
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = value
        return value


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def id_cache(path: str) -> Cache:
    return Cache(vocabulary(path).encode_ids)


def encode(path: str, text: str) -> bytes:
    """Little-endian 32-bit ids of a text."""
    known, cache = vocabulary(path), id_cache(path)
    parts = []
    for span, special in known.spans(text):
        if special is None:
            parts.extend(map(cache.__getitem__, known.pre_tokens.findall(span)))
        else:
            parts.append(np.uint32(special).astype("<u4").tobytes())
    return b"".join(parts)


def _encode_batches(path: str, column: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                rows = batch.slice(row, 64)
                ids = [encode(path, text.as_py() or "") for text in rows.column(column)]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(ids, type=pa.binary())], names=[*rows.schema.names, "token_ids"]
                )

    return run


def encode_texts(documents: DataFrame, path: str, column: str = "text") -> DataFrame:
    """All columns, and ``token_ids``: the ids of ``column`` as little-endian 32-bit integers.

    ``path`` names the vocabulary file, which all workers have.
    """
    documents = documents.drop("token_ids")
    schema = documents.select("*", F.lit(b"").alias("token_ids")).schema
    return documents.mapInArrow(_encode_batches(path, column), schema)


def decode_ids(encoded: DataFrame, path: str, column: str = "token_ids", output: str = "decoded") -> DataFrame:
    """All columns, and the text that the ids of ``column`` stand for; null ids are none."""
    encoded = encoded.drop(output)
    schema = encoded.select("*", F.lit("").alias(output)).schema

    def run(batches: Batches) -> Batches:
        known = vocabulary(path)
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                rows = batch.slice(row, 64)
                texts = [
                    known.decode(np.frombuffer(ids.as_py() or b"", dtype="<u4")).decode("utf-8", "replace")
                    for ids in rows.column(column)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(texts, type=pa.string())], names=[*rows.schema.names, output]
                )

    return encoded.mapInArrow(run, schema)


def round_trip(documents: DataFrame, path: str, column: str = "text") -> DataFrame:
    """All columns, ``token_ids`` of ``column``, their number ``n_tokens``, and ``decoded_sha256`` of the text they stand for.

    One pass: a task that encodes and decodes one after the other holds two workers, each with its
    own vocabulary and cache, and the executor keeps both for later tasks.
    """
    documents = documents.drop("token_ids", "n_tokens", "decoded_sha256")
    added = [F.lit(b"").alias("token_ids"), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("decoded_sha256")]
    schema = documents.select("*", *added).schema

    def run(batches: Batches) -> Batches:
        known = vocabulary(path)
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                rows = batch.slice(row, 64)
                ids = [encode(path, text.as_py() or "") for text in rows.column(column)]
                texts = [known.decode(np.frombuffer(i, dtype="<u4")).decode("utf-8", "replace") for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns,
                        pa.array(ids, type=pa.binary()),
                        pa.array([len(i) // 4 for i in ids], type=pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], type=pa.string()),
                    ],
                    names=schema.names,
                )

    return documents.mapInArrow(run, schema)


def round_trip_digests(documents: DataFrame, path: str) -> DataFrame:
    """Per document its token count, the digest of its ids, and that of the text decoded from them."""

    def run(batches: Batches) -> Batches:
        known = vocabulary(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column("text"):
                ids = encode(path, text.as_py() or "")
                decoded = known.decode(np.frombuffer(ids, dtype="<u4")).decode("utf-8", "replace")
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, type=pa.int64()),
                    pa.array(of_ids, type=pa.string()),
                    pa.array(of_text, type=pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
