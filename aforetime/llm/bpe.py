"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is cut before white space that follows other characters; no token of
the pattern spans such a cut, so the pieces are encoded by themselves and each
distinct piece once per worker. A word's merges are found in a segment tree
over its byte positions: each leaf holds the rank of the pair that begins
there, each node the leftmost minimum below it, and a merge updates the leaves
of its live neighbours in logarithmic time.

Defined results
---------------
* A null or empty text gives an empty list. Strings of special tokens are
  ordinary text.
* One row per row, repeated rows included; whole texts of any length. An empty
  table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the vocabulary's word pattern.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = re.compile(r"\s*\S+|\s+")
#: Controls that Python counts as white space and the pattern doesn't.
ODD_CONTROLS = re.compile("[\x1c-\x1f]")
#: A worker forgets its pieces beyond this number, and never keeps longer ones.
CACHED_PIECES = 300_000
CACHED_LENGTH = 80
TEXTS_PER_BATCH = 500
NEVER = 1 << 62


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word by repeated merging of its leftmost lowest-ranked pair."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    parts: list[bytes] = [word[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    size = 1 << (n - 1).bit_length()
    tree = [NEVER] * (2 * size)

    def pair(i: int) -> int:
        j = after[i]
        rank = ranks.get(parts[i] + parts[j]) if j < n else None
        return NEVER if rank is None else rank * size + i  # ordered by rank, then position

    def update(i: int, key: int) -> None:
        at = size + i
        tree[at] = key
        at >>= 1
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left < right else right
            at >>= 1

    for i in range(n):
        tree[size + i] = pair(i)
    for at in range(size - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])
    while tree[1] < NEVER:
        i = tree[1] % size
        j = after[i]
        parts[i] += parts[j]
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        update(j, NEVER)
        update(i, pair(i))
        if before[i] >= 0:
            update(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class Encoder(dict):
    """Piece → its ids as int32 bytes; a missing piece is encoded on first sight."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.words: dict[str, bytes] = {}
        self.find = regex.compile(WORDS).findall

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join([self.word(w) for w in self.find(piece)])
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            ids = array("i", merge_word(word.encode("utf-8", "replace"), self.ranks)).tobytes()
            if len(word) <= CACHED_LENGTH:
                if len(self.words) >= CACHED_PIECES:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD_CONTROLS.search(text):
            return b"".join([self.word(w) for w in self.find(text)])
        return b"".join(map(self.__getitem__, PIECE.findall(text)))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a rank file (one base64 token and its rank per line), once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Encoder(ranks)


def encode_corpus(documents: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every document; `path` names the rank file, which every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_PER_BATCH):
                batch = whole.slice(start, TEXTS_PER_BATCH)
                encoded = [encode(t) for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(e) // 4 for e in encoded)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(encoded), dtype=np.int32))
                ids = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
