"""Benchmark decontamination by SimHash windows and exact shingle similarity."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.shared import cut, give_back, numbered, table, with_safe_names
from sparkquarry.llm.words import mix, ngrams, ranges, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints have 128 bits in 8 blocks of 16; two that differ in RADIUS bits at most have a
#: block in which they differ in 3 at most. At a similarity of 0.8 about 19 bits differ, give or take 4.
WORDS, BLOCKS, RADIUS = 2, 8, 31
KNOWN = 100_000  # similarities of a document's windows that are kept at once, about
PIECE = 4096  # windows whose fingerprints are made at once
#: Items are sent to tasks in blocks of so many characters of text, and so many items, at most.
BLOCK_CHARS, BLOCK_ITEMS = 8_000_000, 20_000
_BITS = np.arange(64, dtype=np.uint64)
_WEIGHT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _within(bits: int) -> np.ndarray:
    """All 16-bit numbers with so many bits set at most."""
    every = np.arange(1 << 16)
    return every[_WEIGHT[every & 0xFF] + _WEIGHT[every >> 8] <= bits].astype(np.uint16)


#: An item stands under the values one bit away from its own, and a window looks up those two bits away: three in all.
_STORED, _PROBED = _within(1), _within(RADIUS // BLOCKS - 1)


def signs(shingles: np.ndarray) -> np.ndarray:
    """For every shingle a row of 128 numbers, 1 or -1 by the bits of two hashes."""
    both = np.stack([shingles, mix(shingles + np.uint64(1))], axis=1)[:, :, None]
    return ((((both >> _BITS) & np.uint64(1)).astype(np.int32) << 1) - 1).reshape(-1, 64 * WORDS)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHashes of rows of weighted sums, as bytes."""
    return np.packbits(sums > 0, axis=1, bitorder="little")


class BlockIndex:
    """Fingerprints by the values near those of each of their blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.tables = prints, []
        for block in np.ascontiguousarray(prints).view("<u2").T:
            values = (block[:, None] ^ _STORED).ravel()
            order = np.argsort(values, kind="stable")
            present = np.zeros(1 << 16, bool)
            present[values] = True
            self.tables.append((present, values[order], (order // len(_STORED)).astype(np.int64)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of all pairs that are near in a block, each once."""
        found = []
        for block, (present, values, owners) in zip(np.ascontiguousarray(prints).view("<u2").T, self.tables):
            probes = block[:, None] ^ _PROBED
            rows, columns = np.nonzero(present[probes])
            wanted = probes[rows, columns]
            low, high = np.searchsorted(values, wanted), np.searchsorted(values, wanted, side="right")
            found.append(np.repeat(rows, high - low) * len(self.prints) + owners[ranges(low, high - low)])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of all pairs that differ in RADIUS bits at most."""
        rows, items = self.near(prints)
        apart = _WEIGHT[prints[rows] ^ self.prints[items]].sum(1)
        return rows[apart <= RADIUS], items[apart <= RADIUS]


def _pieces(first: np.ndarray, last: np.ndarray, wide: int) -> Iterator[np.ndarray]:
    """The places of all the ranges first..last (both ascending), each once, in pieces of `PIECE` places and
    twice that distance at most; places further apart than `wide` come in pieces of their own."""
    kept = first <= last
    first, last = first[kept], last[kept]
    opens = np.flatnonzero(np.append(True, first[1:] > last[:-1] + 1)) if len(first) else np.zeros(0, np.int64)
    found: list[np.ndarray] = []
    for a, b in zip(first[opens].tolist(), last[np.append(opens[1:], len(first)) - 1].tolist() if len(first) else []):
        while a <= b:
            if found and (a - int(found[-1][-1]) > wide or a - int(found[0][0]) >= 2 * PIECE or sum(map(len, found)) >= PIECE):
                yield np.concatenate(found)
                found = []
            end = min(b, a + PIECE - 1 - sum(map(len, found)))
            found.append(np.arange(a, end + 1))
            a = end + 1
    if found:
        yield np.concatenate(found)


class Items:
    """The benchmark's items by length, with an index of their fingerprints for each."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.by_size: dict[int, list[tuple[int, Counter]]] = defaultdict(list)
        prints: dict[int, list[np.ndarray]] = defaultdict(list)
        #: shingle size -> shingle -> lengths of the items that hold it
        holders: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item_id, hashes in items:
            size = len(hashes)
            if not size:
                continue
            own = ngrams(hashes, min(SHINGLE, size))
            self.by_size[size].append((item_id, Counter(own.tolist())))
            prints[size].append(fingerprints(signs(own).sum(0, keepdims=True))[0])
            for s in own.tolist():
                holders[min(SHINGLE, size)][s].add(size)
        self.index = {size: BlockIndex(np.stack(p)) for size, p in prints.items()}
        self.gates = {}
        for n, held in holders.items():
            keys = np.array(sorted(held), np.uint64)
            table_ = np.zeros(1 << 20, bool)
            table_[keys >> np.uint64(44)] = True
            self.gates[n] = (keys, [sorted(held[int(k)]) for k in keys], table_)

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity) of the best window for each item found.

        A window can only be similar to an item if it holds one of its shingles, so
        fingerprints are made of the windows around such shingles.
        """
        hashes = word_hashes(text)
        for n, (keys, sizes, table_) in self.gates.items():
            own = ngrams(hashes, n)
            near = np.flatnonzero(table_[own >> np.uint64(44)])
            if not len(near):
                continue
            place = np.minimum(np.searchsorted(keys, own[near]), len(keys) - 1)
            hit = keys[place] == own[near]
            at, place = near[hit], place[hit]
            sums = np.append(np.uint64(0), np.cumsum(mix(own), dtype=np.uint64))  # of two windows with equal shingles, in any order, they grow alike
            holding: dict[int, list[int]] = defaultdict(list)
            for k in np.unique(place).tolist():
                for size in sizes[k]:
                    holding[size].append(k)
            for size, of_size in holding.items():
                own_at = at[np.isin(place, of_size)]
                first, last = np.maximum(0, own_at - size + n), np.minimum(own_at, max(0, len(hashes) - size))
                yield from self._best(own, sums, _pieces(first, last, size - n + 1), size, n)

    def _best(self, own: np.ndarray, totals: np.ndarray, pieces: Iterator[np.ndarray], size: int, n: int) -> Iterator[tuple[int, int, int, float]]:
        wide = size - n + 1
        best: dict[int, tuple[float, int]] = {}
        known: dict[tuple[int, int], float] = {}
        for piece in pieces:
            if len(known) > KNOWN:
                known.clear()
            low, high = int(piece[0]), min(int(piece[-1]) + wide, len(own))
            sums = np.zeros((high - low + 1, 64 * WORDS), np.int32)
            np.cumsum(signs(own[low:high]), axis=0, out=sums[1:])
            prints = fingerprints(sums[np.minimum(piece + wide, high) - low] - sums[piece - low])
            rows, items = self.index[size].within(prints)
            for row, item in zip(rows.tolist(), items.tolist()):
                at = int(piece[row])
                item_id, wanted = self.by_size[size][item]
                alike = (int(totals[min(at + wide, len(own))] - totals[at]), item)
                if alike not in known:  # text that repeats has few different windows
                    window = Counter(own[at : at + wide].tolist())
                    both = (window & wanted).total()
                    known[alike] = both / (window.total() + wanted.total() - both)
                similarity = known[alike]
                if similarity >= SIMILARITY and similarity > best.get(item_id, (0.0, 0))[0]:
                    best[item_id] = (similarity, at)
        for item_id, (similarity, at) in sorted(best.items()):
            yield item_id, at, size, similarity


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, in order of item_id and text."""
    block, chars = [], 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").distinct().sort("item_id", "text").toLocalIterator():
        if block and (chars + len(row["text"]) > BLOCK_CHARS or len(block) >= BLOCK_ITEMS):
            yield block
            block, chars = [], 0
        block.append((row["item_id"], row["text"]))
        chars += len(row["text"])
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Passages of `docs` that repeat a benchmark item: doc_id, item_id, start_word, n_words, similarity.

    For every item, windows of its length slide over the whole text. The 128-bit SimHash of a
    window (over its 5-word shingles, weighted by their counts) must lie within 31 bits of the
    item's, which the index of their blocks finds without fail; the counted shingles must then
    have a Jaccard similarity of 0.8 or more, which is computed exactly. The best window of
    each document and item is returned, the first if windows tie. Items of fewer than five words
    count as one shingle; documents shorter than an item are one window. Null, empty and blank
    texts and items match nothing; repeated items with one item_id may each give a row; rows
    that repeat a doc_id are judged alone. Other columns are ignored.

    The items are a query set: they go to the tasks in blocks of at most 20,000 items and 8
    million characters each, so that none outgrows a task however large the benchmark is.
    """
    spark, found = docs.sparkSession, None
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    names = [part.split()[0] for part in schema.split(", ")]
    for block in _item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            items = Items([(i, word_hashes(t)) for i, t in sent.value])
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch["doc_id"], batch["text"]) for m in items.matches(t)]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})
            del items
            give_back()

        part = docs.select("doc_id", "text").mapInPandas(search, schema)
        found = part if found is None else found.unionByName(part)
    return found


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; each row is judged alone, whatever its doc_id.

    Null and empty texts hold no passage and stay; without benchmark items all rows stay.
    """

    def clean(own: DataFrame) -> DataFrame:
        rows = numbered(own, "row")
        found = contaminated(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
        leaks = cut(found.select(F.col("doc_id").alias("leak")).distinct(), "leaks")
        return rows.join(leaks, F.col("row") == F.col("leak"), "left_anti").drop("row")

    return with_safe_names(clean, docs, "text")
