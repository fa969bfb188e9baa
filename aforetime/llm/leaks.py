"""Passages of held-out items inside a training corpus.

The word n-grams that a document shares with an item are the seeds of the pair,
however many documents hold them; a Smith–Waterman alignment around the seeds
scores it. Pairs of equal stretches (copies) are aligned once. Documents and
items are compared as sequences of words; quoting, wrapping and markup between
the words of a passage fall away, and so does what a notebook's file format
puts between two cells. Every other word between them counts as a gap.

A pair is a leak if the aligned stretch spans `min_words` words of the item
and enough of the stretch's words match; for items that are code it must touch
`min_lines` of the item's lines, or all of them if there are fewer. An item is
code if most of its lines look like code (`text.is_code`).

Defined results
---------------
* Null and empty texts contain nothing; an item of fewer than NGRAM words is
  never contained. Repeated documents give repeated rows, an item given twice
  is one item per id (the longest text counts).
* One row per document id and item id. Whole texts are read. Empty tables give
  no rows. Further columns are ignored.
* Items are broadcast in blocks of ITEM_BLOCK; the corpus is read once a block,
  so any number of items is handled.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforetime.llm.text import between_cells, is_code, plain, words
from aforetime.storage import shuffle_parts, small_side, written

NGRAM = 4
ITEM_BLOCK = 5_000
MATCH, MISMATCH, GAP = 2, -2, -1
#: What any number of words between two parts of a passage (an output, another cell) costs at most.
LONG_GAP = 12
#: Id of every word that an item doesn't hold; it matches nothing.
FOREIGN = 0
#: Alignments computed at once: at most so many pairs, and matrix cells.
PAIRS_AT_ONCE = 64
CELLS_AT_ONCE = 4_000_000
#: Words of stretches in a record batch, about.
WORDS_AT_ONCE = 2_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def grams(ids: np.ndarray) -> np.ndarray:
    """64-bit hashes of the n-grams of a sequence of word ids."""
    if len(ids) < NGRAM:
        return np.empty(0, np.int64)
    wide = np.lib.stride_tricks.sliding_window_view(ids.astype(np.uint64), NGRAM)
    mixed = wide * _MIX[:NGRAM]
    mixed ^= mixed >> np.uint64(29)
    folded = mixed[:, 0]
    for k in range(1, NGRAM):
        folded = folded * np.uint64(0x9E3779B97F4A7C15) + mixed[:, k]
    return (folded ^ (folded >> np.uint64(32))).view(np.int64)


class Items:
    """A block of items as word-id sequences with the line of each word."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.sequences: dict[int, np.ndarray] = {}
        self.lines: dict[int, np.ndarray] = {}
        self.code: dict[int, bool] = {}
        for item, text in sorted(rows, key=lambda r: len(r[1])):
            ids, lines = [], []
            for number, line in enumerate(plain(text).split("\n")):
                for word in words(line):
                    ids.append(self.vocabulary.setdefault(word, len(self.vocabulary) + 1))
                    lines.append(number)
            self.sequences[item] = np.array(ids, dtype=np.int64)
            self.lines[item] = np.array(lines, dtype=np.int64)
            self.code[item] = is_code(text)
        #: Distinct words of each item.
        self.own = {item: np.unique(s) for item, s in self.sequences.items()}
        own = {item: np.unique(grams(s)) for item, s in self.sequences.items()}
        self.grams, at = np.unique(np.concatenate([*own.values(), np.empty(0, np.int64)]), return_inverse=True)
        #: Numbers of each item's n-grams, and the items of each n-gram.
        self.grams_of = dict(zip(own, np.split(at, np.cumsum([len(g) for g in own.values()])), strict=False))
        order = np.argsort(at, kind="stable")
        owners = np.repeat(np.array(list(own), dtype=np.int64), [len(g) for g in own.values()])[order]
        self.owners = np.split(owners, np.cumsum(np.bincount(at, minlength=len(self.grams)))[:-1])

    def read(self, text: str | None) -> np.ndarray:
        """Ids of a document's words in order, FOREIGN for a word of no item."""
        own = self.vocabulary
        return np.array([own.get(w, FOREIGN) for w in words(plain(between_cells(text or "")))], dtype=np.int64)


def align(document: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, float]:
    """Positions of the item that match in the best local alignment with a document, and its score."""
    return align_many([(document, item)])[0]


def align_many(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, float]]:
    """Smith–Waterman alignments of (document, item) pairs, a row of all their matrices at a time.

    Gaps along a row are a running maximum, and so are long gaps in the
    document, down the columns. Shorter sequences are padded with words that
    match nothing.
    """
    n, m = max(len(d) for d, _ in pairs), max(len(i) for _, i in pairs)
    documents, items = np.full((n, len(pairs)), -1, dtype=np.int64), np.full((len(pairs), m), -2, dtype=np.int64)
    for k, (document, item) in enumerate(pairs):
        documents[: len(document), k], items[k, : len(item)] = document, item
    # where all rows would take too much memory only every `stride`-th is kept, and the traceback computes those between anew
    stride = n if (n + 1) * (m + 1) * len(pairs) <= CELLS_AT_ONCE else max(1, int(n**0.5))
    kept = np.zeros((2, n // stride + 1, len(pairs), m + 1), dtype=np.int32)
    best, ends = np.zeros(len(pairs), dtype=np.int32), np.zeros((len(pairs), 2), dtype=np.int64)
    whole = np.zeros((n + 1, len(pairs), m + 1), dtype=np.int32) if stride == n else None
    above, highest = kept[0, 0], np.zeros((len(pairs), m + 1), dtype=np.int32)
    for i in range(1, n + 1):
        row = whole[i] if whole is not None else np.empty_like(above)
        _next_row(above, highest, documents[i - 1], items, row)
        if whole is None and i % stride == 0:
            kept[0, i // stride], kept[1, i // stride] = row, highest
        above, top = row, row.max(axis=1)
        better = np.flatnonzero(top > best)
        best[better] = top[better]
        ends[better, 0], ends[better, 1] = i, row[better].argmax(axis=1)
    out = []
    for k, (document, item) in enumerate(pairs):
        i, j = map(int, ends[k])
        words_of, wanted = document.tolist(), item.tolist()
        matched: list[int] = []
        first, rows = 0, whole[:, k, :] if whole is not None else None

        def row_of(at: int, k: int = k) -> np.ndarray:
            nonlocal first, rows
            if rows is None or not first <= at < first + len(rows):
                first = at // stride * stride
                rows = np.zeros((min(stride, n + 1 - first), m + 1), dtype=np.int32)
                rows[0], upper = kept[0, first // stride, k], kept[1, first // stride, k : k + 1].copy()
                for step in range(1, len(rows)):
                    _next_row(rows[step - 1 : step], upper, documents[first + step - 1, k : k + 1], items[k : k + 1], rows[step : step + 1])
            return rows[at - first]

        while i and j and (here := int(row_of(i)[j])) > 0:
            left, before = int(row_of(i)[j - 1]), row_of(i - 1)
            same = words_of[i - 1] == wanted[j - 1]
            if here == before[j - 1] + (MATCH if same else MISMATCH):
                if same:
                    matched.append(j - 1)
                i, j = i - 1, j - 1
            elif here == before[j] + GAP:
                i -= 1
            elif here == left + GAP:
                j -= 1
            else:
                i -= 1
                while row_of(i)[j] != here + LONG_GAP:
                    i -= 1
        out.append((np.array(matched[::-1], dtype=np.int64), int(best[k])))
    return out


def _next_row(above: np.ndarray, highest: np.ndarray, words_at: np.ndarray, items: np.ndarray, row: np.ndarray) -> None:
    """Fill `row` of all matrices from the row above, the highest scores above it and the documents' words at it."""
    ramp = -GAP * np.arange(row.shape[1], dtype=np.int32)
    step = np.where(items == words_at[:, None], np.int32(MATCH), np.int32(MISMATCH))
    np.maximum(highest, above, out=highest)
    row[:, 0] = 0
    np.maximum(above[:, :-1] + step, above[:, 1:] + GAP, out=row[:, 1:])
    np.maximum(row, highest - LONG_GAP, out=row)
    np.maximum(row, 0, out=row)
    row += ramp
    np.maximum.accumulate(row, axis=1, out=row)
    row -= ramp


def _regions(at: np.ndarray, reach: int, end: int) -> list[tuple[int, int]]:
    """Stretches of the document around seed positions, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for p in np.sort(at):
        low, high = max(0, int(p) - reach), min(end, int(p) + reach + NGRAM)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def longest(length: int) -> int:
    """Words of a document that an alignment with an item of `length` words spans at most, long gaps aside.

    Its gaps cost less than its at most `length` matches bring.
    """
    return (1 - MATCH // GAP) * length


def _pieces(low: int, high: int, length: int) -> list[tuple[int, int]]:
    """A long stretch in pieces that overlap so that each alignment with an item of `length` words is whole in one.

    Alignments with a long gap may go on for longer; of those the better part is kept.
    """
    most = longest(length)
    if high - low <= 4 * most:
        return [(low, high)]
    return [(at, min(high, at + 4 * most)) for at in range(low, high - most, 3 * most)]


def _hits(items: Items):
    def shared(sequence: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Each item that shares an n-gram with a document, and the stretches around those n-grams."""
        found = grams(sequence)
        if not len(items.grams) or not len(found):
            return
        at = np.minimum(np.searchsorted(items.grams, found), len(items.grams) - 1)
        places = np.flatnonzero(items.grams[at] == found)
        at = at[places]
        if not len(at):
            return
        for item in np.unique(np.concatenate([items.owners[g] for g in np.unique(at)])).tolist():
            own = places[np.isin(at, items.grams_of[item])]
            length = len(items.sequences[item])
            pieces = [p for r in _regions(own, longest(length), len(sequence)) for p in _pieces(*r, length)]
            # words of other items are foreign, too
            stretches = [np.where(np.isin(part, items.own[item]), part, FOREIGN).astype(np.int32) for part in (sequence[a:b] for a, b in pieces)]
            yield item, list({part.tobytes(): part for part in stretches}.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rows, held = batch.schema.field(0).type, [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for item, stretches in shared(items.read(text)):
                    same = blake2b(np.int64(item).tobytes(), digest_size=16)
                    for stretch in stretches:
                        same.update(np.int64(len(stretch)).tobytes() + stretch.tobytes())
                    rows.append((key, item, same.digest(), stretches))
                    held += sum(map(len, stretches))
                    if held >= WORDS_AT_ONCE:
                        yield _batch(rows, kind)
                        rows, held = [], 0
            yield _batch(rows, kind)

    return run


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = {"doc": kind, "item": pa.int64(), "same": pa.binary(), "stretches": pa.list_(pa.list_(pa.int32()))}
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, types.values(), strict=True)], names=list(types)
    )


def _score(items: Items):
    def finish(held: list[tuple[int, int, np.ndarray, np.ndarray]]) -> dict[int, tuple[int, np.ndarray]]:
        """Best alignment of each row number in (row, item, stretch, item's words)."""
        best: dict[int, tuple[int, np.ndarray]] = {}
        for (row, _, _, _), (matched, score) in zip(held, align_many([(d, i) for _, _, d, i in held]), strict=True):
            if score > best.get(row, (0, None))[0]:
                best[row] = (score, matched)
        return best

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stretches = []
            for row, (item, own) in enumerate(zip(batch["item"], batch["stretches"], strict=True)):
                for stretch in own:
                    stretches.append((row, item, np.asarray(stretch, dtype=np.int64), items.sequences[item]))
            stretches.sort(key=lambda x: (len(x[2]), len(x[3])))
            best: dict[int, tuple[int, np.ndarray]] = {}
            while stretches:
                cells = len(stretches[-1][2]) * max(len(x[3]) for x in stretches[-PAIRS_AT_ONCE:])
                take = max(1, min(PAIRS_AT_ONCE, CELLS_AT_ONCE // max(1, cells)))
                for row, found in finish(stretches[-take:]).items():
                    best[row] = max(best.get(row, found), found, key=lambda b: b[0])
                del stretches[-take:]
            rows = []
            for row, (score, matched) in sorted(best.items()):
                item = batch["item"].iat[row]
                line_of = items.lines[item]
                touched, sizes = np.unique(line_of[matched], return_counts=True)
                full = int((sizes >= 0.5 * np.bincount(line_of)[touched]).sum())
                span = int(matched[-1] - matched[0] + 1)
                rows.append((batch["same"].iat[row], score, len(matched), span, full, len(np.unique(line_of)), items.code[item]))
            yield pd.DataFrame(rows, columns=["same", "score", "matched", "span", "lines", "item_lines", "is_code"])

    return run


def leak_scores(
    documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text"
) -> DataFrame:
    """(key, item key, score, matched, span, lines, item_lines, is_code) of every pair that shares an n-gram."""
    spark = documents.sparkSession
    clean = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_key).cast("bigint").alias("item"), F.col(item_text).alias("text")
    )
    clean = clean.groupBy("item").agg(F.max_by("text", F.length("text")).alias("text"))
    blocks = max(1, -(-clean.count() // ITEM_BLOCK))
    parts: list[DataFrame] = []
    for block in range(blocks):
        # at most about ITEM_BLOCK items at once on the driver and in each task
        rows = clean.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        held = Items([(r["item"], r["text"]) for r in rows])
        kind = documents.schema[key].dataType.simpleString()
        touched = written(
            documents.select(key, text).mapInArrow(
                _hits(held), f"doc {kind}, item bigint, same binary, stretches array<array<int>>"
            ),
            "leaks",
        )
        # equal digests are equal stretches of the same item
        distinct = touched.groupBy("same").agg(F.first("item").alias("item"), F.first("stretches").alias("stretches"))
        # an alignment costs far more than its bytes suggest, so the pairs are spread by number
        distinct = distinct.repartition(2 * max(shuffle_parts(spark), spark.sparkContext.defaultParallelism))
        scored = written(
            distinct.mapInPandas(_score(held), "same binary, score int, matched int, span int, lines int, item_lines int, is_code boolean"),
            "aligned",
        )
        pairs = touched.select("doc", "item", "same").join(small_side(scored), "same")
        parts.append(pairs.drop("same"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.withColumnsRenamed({"doc": key, "item": item_key})


def leaks(scores: DataFrame, *, min_words: int = 20, min_lines: int = 7, identity: float = 0.7) -> DataFrame:
    """The pairs whose aligned stretch is long and alike enough; code is measured in lines, other text in words."""
    lines = F.col("lines") >= F.least(F.lit(min_lines), F.col("item_lines"))
    long = F.when(F.col("is_code"), lines).otherwise(F.col("span") >= min_words)
    return scores.where(long & (F.col("matched") >= identity * F.col("span")))
