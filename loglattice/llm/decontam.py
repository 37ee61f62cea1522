"""Benchmark decontamination with SimHash windows.

Every benchmark item is compared with all windows of its own number of words in all texts; a
shorter text is compared as a whole, where its size allows the similarity.  A window's
fingerprint is the 64-bit SimHash of its five-word shingles weighted by how often they occur.
Fingerprints are found by multi-index hashing: the 64 bits are cut into four blocks, and a pair
within ``RADIUS`` bits differs by at most ``RADIUS // 4`` in some block, so looking each block up
among the item's block values and all values that near finds every pair within the radius.
Candidates are verified by the exact weighted Jaccard similarity of their shingles.

A window without any shingle of an item has similarity 0, so only windows that hold at least
one shingle of the block of items at hand are fingerprinted; nothing that could be verified is
lost by that.  An item or text of fewer than five words is one shingle of all its words: they
match where they are equal.

Items are the query set.  They are taken in blocks of bounded size, one job a block, and only
one block is in the driver or in a task at a time; what a job finds is written before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm import textkit as tk
from loglattice.llm.textkit import U64

THRESHOLD = 0.8
RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
#: A block of items has about so many items and words.
BLOCK_ITEMS, BLOCK_WORDS = 1_000, 100_000
#: Windows fingerprinted at once.
PART = 32_768
_K = tk.SHINGLE_WORDS
_GATE = 1 << 22


def simhash(shingles: np.ndarray, starts: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows of ``span`` shingles that begin at ``starts``.

    A shingle that occurs twice in a window counts twice: that is its weight.
    """
    return _prints(_bit_sums(shingles), starts, span)


def _bit_sums(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros((len(shingles) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=total[1:])
    return total


def _prints(total: np.ndarray, starts: np.ndarray, span: np.ndarray) -> np.ndarray:
    ones = total[starts + span] - total[starts]
    return np.packbits(ones * 2 > span[:, None], axis=1).view("<u8").ravel()


def _near_values(flips: int) -> np.ndarray:
    """All 16-bit masks of at most ``flips`` bits."""
    return np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(BLOCK_BITS), k)], dtype=np.uint16)


class ItemIndex:
    """A block of items by number of words: shingle multisets, fingerprints, block lookups."""

    def __init__(self, names: list[str], texts: list[str], radius: int = RADIUS):
        self.names, self.radius = names, radius
        words, off = tk.word_hashes(*tk.text_bytes(pa.array(texts, pa.large_string())))
        sh, s_off = tk.shingle_hashes(words, off)
        self.shingles, place = np.unique(sh, return_inverse=True)
        self.gate = np.zeros(_GATE, dtype=bool)
        self.gate[(self.shingles & U64(_GATE - 1)).astype(np.int64)] = True
        #: Of each item the numbers of its shingles among ``shingles``, and how often it has each.
        self.bags: list[tuple[np.ndarray, np.ndarray]] = [np.unique(place[a:b], return_counts=True) for a, b in zip(s_off[:-1], s_off[1:], strict=True)]
        width = np.diff(s_off)
        #: For each number of shingles: the items, their fingerprints, and per block a sorted list of near values with their items.
        self.tables = {}
        masks = _near_values(radius // BLOCKS)
        for size in np.unique(width[width > 0]).tolist():
            items = np.flatnonzero(width == size)
            fp = simhash(sh, s_off[:-1][items], np.full(len(items), size))
            blocks = []
            for b in range(BLOCKS):
                near = ((fp >> U64(b * BLOCK_BITS)).astype(np.uint16)[:, None] ^ masks).ravel()
                item = np.repeat(np.arange(len(items), dtype=np.int32), len(masks))
                order = np.argsort(near, kind="stable")
                blocks.append((near[order], item[order]))
            self.tables[size] = (items, fp, blocks)

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item of this size, distance) for all pairs within the radius."""
        _, fp, blocks = self.tables[size]
        found = []
        for b, (near, item) in enumerate(blocks):
            value = (prints >> U64(b * BLOCK_BITS)).astype(np.uint16)
            lo, hi = np.searchsorted(near, value, "left"), np.searchsorted(near, value, "right")
            n = hi - lo
            window = np.repeat(np.arange(len(prints)), n)
            place = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append(window * np.int64(len(fp)) + item[place])
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(fp), pair % len(fp)
        distance = np.bitwise_count(prints[window] ^ fp[item]).astype(np.int64)
        near = distance <= self.radius
        return window[near], item[near], distance[near]

    def members(self, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of shingles that items have, and which they are."""
        if not len(self.shingles):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.gate[(sh & U64(_GATE - 1)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.shingles, sh[at]), len(self.shingles) - 1)
        same = self.shingles[which] == sh[at]
        return at[same], which[same]

    def hits(self, sh: np.ndarray, off: np.ndarray, threshold: float) -> list[tuple[int, str, int, int, int, float]]:
        """The best window of every item found in the rows of ``sh``: (row, item, first shingle, shingles, distance, similarity)."""
        at, which = self.members(sh)
        if not len(at):
            return []
        reach = max(self.tables)
        row = np.searchsorted(off, at, side="right") - 1
        # Windows that may hold one begin at most ``reach`` shingles before it in its row.
        change = np.zeros(len(sh) + 1, dtype=np.int32)
        np.add.at(change, np.maximum(at - reach + 1, off[row]), 1)
        np.add.at(change, at + 1, -1)
        starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for k in range(0, len(starts), PART):
            self._part(sh, off, at, which, starts[k : k + PART], reach, threshold, best)
        return [(r, self.names[i], start, span, d, s) for (r, i), (s, start, span, d) in sorted(best.items())]

    def _part(self, sh, off, at, which, starts, reach, threshold, best) -> None:
        row = np.searchsorted(off, starts, side="right") - 1
        begin, end = off[row], off[row + 1]
        # Bits are summed over the shingles of these windows alone: ``where`` maps a place to its sum.
        first, last = int(starts[0]), int(min(end[-1], starts[-1] + reach))
        change = np.zeros(last - first + 1, dtype=np.int32)
        np.add.at(change, starts - first, 1)
        np.add.at(change, np.minimum(starts + reach, end) - first, -1)
        needed = np.cumsum(change[:-1]) > 0
        where = np.concatenate([[0], np.cumsum(needed)])
        total = _bit_sums(sh[first:last][needed])
        lo, hi = np.searchsorted(at, [first, last])
        held = np.zeros(last - first + 1, dtype=np.int32)
        held[at[lo:hi] - first + 1] = 1
        held = np.cumsum(held)
        for size, (items, _, _) in self.tables.items():
            span = np.minimum(size, end - begin)
            # A text shorter than the item is one window, where the item could still be that similar.
            fits = (span >= size * threshold) & (starts + span <= end)
            fits[fits] = held[(starts + span - first)[fits]] > held[(starts - first)[fits]]
            use = np.flatnonzero(fits)
            if not len(use):
                continue
            prints = _prints(total, where[starts[use] - first], span[use])
            for w, i, d in zip(*self.candidates(size, prints), strict=True):
                u, item = use[w], int(items[i])
                start, n, r = int(starts[u]), int(span[u]), int(row[u])
                a, b = np.searchsorted(at, [start, start + n])
                has, count = np.unique(which[a:b], return_counts=True)
                own, times = self.bags[item]
                _, x, y = np.intersect1d(has, own, assume_unique=True, return_indices=True)
                both = int(np.minimum(count[x], times[y]).sum())
                s, start = both / (size + n - both), start - int(begin[u])
                old = best.get((r, item))
                if s >= threshold and (old is None or (-s, start) < (-old[0], old[1])):
                    best[r, item] = (s, start, n, int(d))


_FOUND = pa.schema([("item", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("distance", pa.int32()), ("similarity", pa.float64())])
FOUND = "item string, first_word int, n_words int, distance int, similarity double"
_built: dict[int, ItemIndex] = {}


def _scan(names: list[str], texts: list[str], radius: int, threshold: float):
    key = hash((tuple(names), tuple(texts), radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = ItemIndex(names, texts, radius)
        index = _built[key]
        for batch in batches:
            text = batch.column("text")
            for a, b in tk.column_slices(text):
                words, off = tk.word_hashes(*tk.text_bytes(text.slice(a, b - a)))
                found = index.hits(*tk.shingle_hashes(words, off), threshold)
                if not found:
                    continue
                n_words = np.diff(off)
                row = pa.array([a + f[0] for f in found])
                cells = [(name, start, min(span + _K - 1, int(n_words[r])), d, s) for r, name, start, span, d, s in found]
                columns = [pa.array(c, t) for c, t in zip(zip(*cells, strict=True), _FOUND.types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("th").take(row), *columns], ["id", "th", *_FOUND.names])

    return run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[str], list[str]]]:
    """The items with their names as text, in blocks of bounded size; of repeated rows one is kept."""
    items = benchmark.select(F.coalesce(benchmark[f"`{id_col}`"].cast("string"), F.lit("")).alias("name"), F.lower(benchmark[f"`{text_col}`"]).alias("text")).filter("text is not null").distinct()
    size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0))).first()
    n = max(1, -(-size[0] // BLOCK_ITEMS), -(-size[1] // BLOCK_WORDS))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n)))
    for k in range(n):
        got = dealt.filter(F.col("block") == k).select("name", "text").orderBy("name", "text").toArrow()
        if got.num_rows:
            yield got.column("name").to_pylist(), got.column("text").to_pylist()


def found_in(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, th, item, first_word, n_words, distance, similarity): the items found in each text with their best
    windows, th being a hash of the text.  The table is written, block by block.

    Null and empty texts and items hold nothing.  Equal rows of ``docs`` give equal rows; windows
    of equal similarity: the first one.
    """
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(text).alias("th"), F.lower(text).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, th bigint, {FOUND}"
    run = tk.Scratch(docs.sparkSession, "benchmark-items")
    found = None
    for k, (names, texts) in enumerate(item_blocks(benchmark, item_id, item_text)):
        block = run.keep(tk.map_arrow(rows, _scan(names, texts, radius, threshold), schema), f"block-{k:06d}")
        found = block if found is None else found.unionByName(block)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per text and item found in it: (id_col, item_id, first_word, n_words, distance, similarity).

    Words are counted from 0; see ``found_in``.
    """
    found = found_in(docs, benchmark, id_col, text_col, item_id, item_text)
    return found.select(F.col("id").alias(id_col), F.col("item").cast(dict(benchmark.dtypes)[item_id]).alias("item_id"), "first_word", "n_words", "distance", "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns as they were."""
    p = tk.fresh(docs)
    gone = found_in(docs, benchmark, id_col, text_col, item_id, item_text).select(F.col("id").alias(f"{p}id"), F.col("th").alias(f"{p}th")).distinct()
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    return docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(text) == F.col(f"{p}th")), "left_anti")
