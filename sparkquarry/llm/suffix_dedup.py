"""Exact substring dedup over sampled suffixes, sorted outside memory.

Suffixes that share their first 50 bytes stand together in a suffix array. Sorting every
suffix of a corpus is out of reach of its time budget here, so a sample is sorted and what
holds for the suffixes between is derived from it: in every 50 bytes the suffix whose first
24 bytes have the smallest hash is sampled (all of them, if they tie), a choice that equal
strings make alike. Sampled suffixes, with a hash of the 26 bytes before and the 50 after
their start, are sorted by ranges of hashes in tasks of their own (Spark keeps what waits on
disk). Where that neighbourhood stands in an earlier document too, all strings over it do;
where it stands there in part, the neighbourhoods themselves are compared, 50 bytes at a time.
A gram that many neighbourhoods share, as at the edges of a passage that a source repeats, would
fill a task with these; its strings are spread over tasks by their own hashes instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.blocks import documents_of, in_blocks
from sparkquarry.llm.shared import cut, free, table
from sparkquarry.llm.words import mix, pack, pack_sorted, unpack, unpack_sorted

LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM  # bytes before, and after, a sampled gram that one string with it can take in
SPAN = LENGTH + REACH  # a neighbourhood
BITS = 48  # of a gram's hash
PER_RANGE = 400_000
BLOCK_CHARS = 1_500_000  # a task holds about 100 bytes for each
OUTSIDE = 256  # stands for what is before or after a document
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_CODES = mix(np.arange(1, 258, dtype=np.uint64) * _PRIME)

SAMPLES, COVERED, WANTED, CROWDED = 0, 1, 2, 3
CROWD = 2_000  # neighbourhoods of one gram, from which on they are spread over tasks by the strings in them
_SENT = "kind int, key int, block long, one binary, two binary, three binary"
_NAMES = [part.split()[0] for part in _SENT.split(", ")]


def hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbouring codes along the last axis, by doubling."""
    part, size, kept, count = _CODES[codes], 1, {}, codes.shape[-1] - k + 1
    while True:
        if k & size:
            kept[size] = part
        if size * 2 > k:
            break
        part = mix(part[..., :-size] * _PRIME + part[..., size:])
        size *= 2
    out, at = None, 0
    for size in sorted(kept, reverse=True):
        part = kept.pop(size)[..., at : at + count]
        out = part if out is None else mix(out * _PRIME + part)
        at += size
    return out


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of every `width` neighbours."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return x if size == width else best(x[: len(x) - (width - size)], x[width - size :])


class _Bytes:
    """A block's documents as codes, each between gaps, with its sampled suffixes."""

    def __init__(self, data: bytes):
        docs = documents_of(data)
        self.doc_ids = [d for d, *_ in docs]
        texts = [t.encode("utf-8", "replace") for *_, t in docs]
        self.sizes = np.array([len(t) for t in texts])
        self.first = REACH + np.cumsum(self.sizes + REACH) - self.sizes - REACH
        self.codes = np.full(int(self.sizes.sum()) + REACH * (len(docs) + 1) + LENGTH, OUTSIDE, np.uint16)
        for at, text in zip(self.first, texts):
            self.codes[at : at + len(text)] = np.frombuffer(text, np.uint8)

    def sample(self) -> None:
        """Find the sampled suffixes; equal ones (by key and neighbourhood) are one class."""
        grams = hashes(self.codes, GRAM)
        width = REACH + 1  # grams in a string
        least = _slide(grams, width, np.minimum)
        inside = np.zeros(len(least) + 1, np.int8)
        known = np.array([d is not None for d in self.doc_ids]) & (self.sizes >= LENGTH)
        np.add.at(inside, self.first[known], 1)
        np.add.at(inside, (self.first + self.sizes - LENGTH + 1)[known], -1)
        least = np.where(np.cumsum(inside[:-1]) > 0, least, 0)  # strings inside one document
        pad = np.zeros(width - 1, np.uint64)
        self.at = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), width, np.maximum) == grams) & (grams > 0))
        around = hashes(self.codes, SPAN)[self.at - REACH]
        # Sampled grams have small hashes; mixed once more they fall into all ranges alike.
        keys = mix(grams[self.at] * _PRIME) >> np.uint64(64 - BITS)
        numbers = np.array([0 if d is None else d for d in self.doc_ids], np.int64)
        docs = numbers[np.searchsorted(self.first, self.at, side="right") - 1]
        order = np.lexsort((docs, around, keys))
        self.at, keys, around, docs = self.at[order], keys[order], around[order], docs[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (around[1:] != around[:-1])
        start = np.flatnonzero(new)
        self.count = np.diff(np.append(start, len(keys)))
        self.keys, self.around, self.least = keys[start], around[start], docs[start]
        self.docs, self.earliest = docs, docs == np.repeat(self.least, self.count)


def _zigzag(ids: np.ndarray) -> np.ndarray:
    return ((ids << 1) ^ (ids >> 63)).view(np.uint64)


def _unzigzag(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(1)).view(np.int64) ^ -(ids & np.uint64(1)).view(np.int64)


def _edges(buckets: int) -> np.ndarray:
    return np.arange(1, buckets, dtype=np.uint64) << np.uint64(BITS - buckets.bit_length() + 1)


def _send(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, data in zip(batch["block"], batch["docs"]):
            block = _Bytes(data)
            block.sample()
            cuts = np.searchsorted(block.keys, _edges(buckets))
            parts = zip(np.split(block.keys, cuts), np.split(block.around, cuts), np.split(_zigzag(block.least), cuts))
            rows = [(SAMPLES, key, name, pack_sorted(k), pack(a), pack(d)) for key, (k, a, d) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=_NAMES)


def _judge(key: tuple, cells: pd.DataFrame, crowd: int) -> pd.DataFrame:
    """Flags of each block's classes: COVERED if their neighbourhood stands in an earlier document,
    WANTED if only their gram stands elsewhere in another neighbourhood, CROWDED if in more than
    `crowd` of them, else 0."""
    full = [len(c) > 1 for c in cells["one"]]
    none = np.zeros(0, np.uint64)
    keys = [unpack_sorted(c) if f else none for c, f in zip(cells["one"], full)]
    sizes = [len(k) for k in keys]
    flags = np.zeros(sum(sizes), np.uint8)
    if len(flags):
        keys = np.concatenate(keys)
        around = np.concatenate([unpack(c) if f else none for c, f in zip(cells["two"], full)])
        docs = _unzigzag(np.concatenate([unpack(c) if f else none for c, f in zip(cells["three"], full)]))
        order = np.lexsort((docs, around, keys))
        keys, around, docs = keys[order], around[order], docs[order]
        new_key = np.append(True, keys[1:] != keys[:-1])
        new = new_key | np.append(True, around[1:] != around[:-1])
        group, start = np.cumsum(new_key) - 1, np.flatnonzero(new_key)
        lowest, highest = np.minimum.reduceat(docs, start), np.maximum.reduceat(docs, start)
        others = np.where(lowest != highest, np.bincount(group, new), 0)[group]
        class_least = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
        flags[order] = np.where(docs > class_least, COVERED, np.where(others > crowd, CROWDED, np.where(others > 1, WANTED, 0)))
    return pd.DataFrame({"kind": SAMPLES, "key": key[0], "block": cells["block"], "one": [f.tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])], "two": b"", "three": b""})


def _follow(own: pd.DataFrame, flags: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Of one block: where covered suffixes are, and the neighbourhoods that are to be compared."""
    block, name = _Bytes(own["docs"].iloc[0]), own["block"].iloc[0]
    block.sample()
    flag = np.concatenate([np.frombuffer(f, np.uint8) for f in flags.sort_values("key")["one"]])
    flag_of = np.repeat(flag, block.count)
    covered = np.sort(block.at[~block.earliest | (flag_of == COVERED)]).astype(np.uint64)
    rows = [(COVERED, int(name) % buckets, name, pack_sorted(covered) if len(covered) else b"", b"", b"")]
    wanted = np.flatnonzero((flag_of == WANTED) & block.earliest)
    keys = np.repeat(block.keys, block.count)[wanted]
    cuts = np.searchsorted(keys, _edges(buckets))
    for key, part in enumerate(np.split(np.arange(len(wanted)), cuts)):
        if len(part):
            at = block.at[wanted[part]]
            around = block.codes[at[:, None] + np.arange(-REACH, LENGTH)]
            meta = np.stack([keys[part], block.docs[wanted[part]].view(np.uint64), at.astype(np.uint64)])
            rows.append((WANTED, key, name, (around & 0xFF).astype(np.uint8).tobytes(), np.packbits(around == OUTSIDE).tobytes(), meta.tobytes()))
    return pd.DataFrame(rows + _strings(block, int(name), np.flatnonzero((flag_of == CROWDED) & block.earliest), buckets), columns=_NAMES)


def _strings(block: _Bytes, name: int, which: np.ndarray, buckets: int) -> list[tuple]:
    """The strings over these sampled suffixes, by ranges of their hashes; those that an earlier
    document of the block holds are told at once."""
    if not len(which):
        return []
    starts = np.unique(block.at[which][:, None] + np.arange(-REACH, 1))
    outside = np.append(0, np.cumsum(block.codes == OUTSIDE))
    starts = starts[(starts >= 0) & (outside[np.minimum(starts + LENGTH, len(block.codes))] == outside[np.maximum(starts, 0)])]
    whole = hashes(block.codes, LENGTH)[starts]
    numbers = np.array([0 if d is None else d for d in block.doc_ids], np.int64)
    docs = numbers[np.searchsorted(block.first, starts, side="right") - 1]
    order = np.lexsort((docs, whole))
    starts, whole, docs = starts[order], whole[order], docs[order]
    first = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
    least = np.repeat(docs[first], np.diff(np.append(first, len(whole))))
    rows, later = [], np.sort(starts[docs > least]).astype(np.uint64)
    if len(later):
        rows.append((COVERED, name % buckets, name, b"", pack_sorted(later), b""))
    starts, whole, docs = (x[docs == least] for x in (starts, whole, docs))
    cuts = np.searchsorted(whole, np.arange(1, buckets, dtype=np.uint64) << np.uint64(65 - buckets.bit_length()))
    for key, part in enumerate(np.split(np.arange(len(whole)), cuts)):
        if len(part):
            rows.append((CROWDED, key, name, pack_sorted(whole[part]), pack(_zigzag(docs[part])), starts[part].astype(np.uint64).tobytes()))
    return rows


def _compare_strings(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """For strings of one range of hashes: where each block has some that an earlier document holds."""
    whole = [unpack_sorted(c) for c in cells["one"]]
    docs = [_unzigzag(unpack(c)) for c in cells["two"]]
    every, owner = np.concatenate(whole), np.concatenate(docs)
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
    least = np.empty(len(every), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owner[order], first), np.diff(np.append(first, len(every))))
    rows, at = [], 0
    for block, own, starts in zip(cells["block"], docs, cells["three"]):
        hit = least[at : at + len(own)] < own
        at += len(own)
        if hit.any():
            rows.append((WANTED, key[1], block, pack_sorted(np.sort(np.frombuffer(starts, np.uint64)[hit])), b"", b""))
    return pd.DataFrame(rows, columns=_NAMES)


def _compare(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """For every wanted suffix, which of the strings around it also start in an earlier document."""
    if key[0] == CROWDED:
        return _compare_strings(key, cells)
    if key[0] != WANTED:
        return cells
    metas = [np.frombuffer(m, np.uint64).reshape(3, -1) for m in cells["three"]]
    meta = np.concatenate(metas, axis=1)
    around = np.frombuffer(b"".join(cells["one"]), np.uint8).reshape(-1, SPAN).astype(np.uint16)
    outside = [np.unpackbits(np.frombuffer(o, np.uint8), count=m.shape[1] * SPAN).reshape(-1, SPAN) for o, m in zip(cells["two"], metas)]
    around[np.concatenate(outside).astype(bool)] = OUTSIDE
    keys, docs = meta[0], meta[1].view(np.int64)
    order = np.argsort(keys, kind="stable")
    found = np.zeros((len(keys), REACH + 1), bool)
    for part in _by_key(order, keys, 10_000):
        strings = hashes(around[part], LENGTH)
        count = _slide((around[part] == OUTSIDE).T.astype(np.uint8), LENGTH, np.maximum).T
        inside = count == 0
        owner = np.repeat(docs[part], REACH + 1)[inside.ravel()]
        whole = (strings ^ mix(keys[part])[:, None]).ravel()[inside.ravel()]
        by = np.argsort(whole, kind="stable")
        if not len(by):
            continue
        start = np.flatnonzero(np.append(True, whole[by][1:] != whole[by][:-1]))
        least = np.repeat(np.minimum.reduceat(owner[by], start), np.diff(np.append(start, len(by))))
        hit = np.empty(len(by), bool)
        hit[by] = least < owner[by]
        mask = np.zeros(inside.size, bool)
        mask[np.flatnonzero(inside.ravel())] = hit
        found[part] = mask.reshape(inside.shape)
    rows, at = [], 0
    for block, own in zip(cells["block"], metas):
        part = found[at : at + own.shape[1]]
        at += own.shape[1]
        which, offset = np.nonzero(part)
        starts = np.unique(own[2][which].astype(np.int64) - REACH + offset)
        if len(starts):
            rows.append((WANTED, key[1], block, pack_sorted(starts.astype(np.uint64)), b"", b""))
    return pd.DataFrame(rows, columns=_NAMES)


def _by_key(order: np.ndarray, keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """`order` in parts of about `size` that no key crosses."""
    new = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    cuts = new[np.searchsorted(new, np.arange(size, len(order), size), side="right") - 1]
    yield from (p for p in np.split(order, np.unique(cuts)) if len(p))


def _cut_out(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    """Every document of a block without the bytes that earlier documents hold."""
    block = _Bytes(own["docs"].iloc[0])
    change = np.zeros(len(block.codes) + 1, np.int32)
    covered = [d for k, d in zip(parts["kind"], parts["one"]) if k == COVERED]
    found = [d for k, d in zip(parts["kind"], parts["one"]) if k == WANTED] + list(parts["two"])
    # A covered suffix covers its neighbourhood; a string that was found covers its 50 bytes.
    for before, told in ((REACH, covered), (0, found)):
        for at in (unpack_sorted(d).astype(np.int64) for d in told if d):
            np.add.at(change, at - before, 1)
            np.add.at(change, at + LENGTH, -1)
    gone = (np.cumsum(change[:-1]) > 0) & (block.codes != OUTSIDE)
    rows = []
    for doc_id, first, size in zip(block.doc_ids, block.first, block.sizes):
        out, text = gone[first : first + size], block.codes[first : first + size].astype(np.uint8)
        spans = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0)).astype(np.int64)
        kept = text[~out].tobytes()
        rows.append((doc_id, int(size), int(out.sum()), kept, spans[::2], spans[1::2]))
    return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "kept", "starts", "stops"]).astype({"doc_id": "Int64"})


def dedup_substrings(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (binary), starts and stops (of the removed runs) of every row.

    A byte is removed if it lies in a string of 50 bytes of its document (as UTF-8) that also
    starts in a document with a smaller doc_id; strings never cross documents and are judged on
    the input. Null and empty texts have no bytes. Rows that repeat a doc_id are one document
    here: they take nothing from each other. Rows without doc_id neither lose nor take bytes.
    Removal may cut a character in two, so what is kept is binary. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("train"), "text")
    blocks = in_blocks(source, BLOCK_CHARS)
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1 << max(4, math.ceil(math.log2(chars / 14 / PER_RANGE + 1)))
    sent = blocks.mapInPandas(lambda b: _send(b, buckets), _SENT)
    flags = cut(sent.groupBy("key").applyInPandas(lambda key, cells: _judge(key, cells, crowd), _SENT), "suffix-flags")
    asked = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInPandas(lambda own, f: _follow(own, f, buckets), _SENT)
    runs = cut(asked.groupBy("kind", "key").applyInPandas(_compare, _SENT), "suffix-runs")
    free(flags)
    schema = "doc_id long, n_bytes long, n_removed long, kept binary, starts array<long>, stops array<long>"
    return blocks.groupBy("block").cogroup(runs.groupBy("block")).applyInPandas(_cut_out, schema)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.col("kept"), 256).alias("kept_sha256")
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), kept)
