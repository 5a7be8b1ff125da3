"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of 1, 2, 3, 4, 6, 8, 12, 16, ... preceding words, without end; the start of
a text counts as a word of contexts. A context that occurs `least_count` times in training is
kept if what follows it there is likelier under its own distribution than under that of its
longest kept suffix, by `cutoff` nats in all; each occurrence is judged without itself, so that
rare contexts don't pass by repeating what they have seen. Distributions are smoothed along
kept states only: (g + s p) / (N + s), for a word that follows g of a context's N occurrences
and has probability p in the longest kept suffix, and at the root by 0.1 occurrences of any
word. Of several weights s each context takes the one that gains most. A word is scored by the
longest kept context before it.

Contexts grow by a length a round. A context grows no further if its training occurrences, of
words that it has seen before, leave less than `cutoff` nats to gain, or less than `least_left`
nats for each occurrence. Growth ends when no context is left to grow.

Documents are kept in compressed blocks of word numbers, several of which make a part. Each
round the blocks send hashes of n-grams and the gains of contexts, by ranges of hashes, to tasks
that add them up and send counts and verdicts back, in the order in which they were asked. An
n-gram is only asked for if the shorter ones in it occur twice. What a block needs of the corpus
so comes to it, and no task or driver holds the model whole. All that the blocks of a part send
to a range is one row; parts and ranges both grow with the root of the input, and ranges shrink
with what a round has to ask, so that rows grow in proportion to the input.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.shared import cut, cut_in_buckets, free, give_back, table
from sparkquarry.llm.words import mix, pack, pack_sorted, unpack, unpack_sorted

BLOCK_CHARS, BLOCK_DOCS = 3_000_000, 50_000
START, END = 0, 1  # numbers of the two marks in every block's vocabulary
_MARKS = np.array([0x5EED, 0xE0F], np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
ASK, GAIN = range(2)
ROUND, KEPT, SCORES = range(3)  # what a row holds: questions or their answers, what a part hands to itself, scores
NAT = 256  # what one nat of gain counts as
GROW = 64  # a verdict is the number of the weight that a context is kept with, 0 if it isn't, and this if it grows
FULL = 4  # rounds whose answers are kept and gone through again; then a block's state is carried on
SMALL = 8  # from this round on only documents that contexts still grow for are carried on, with the state
_SENT = "key int, part int, kind int, data binary"
_NAMES = [part.split()[0] for part in _SENT.split(", ")]


def range_count(keys: float) -> int:
    """How many ranges of hashes so many keys are dealt to: a power of two that grows with their root."""
    return 1 << max(4, math.ceil(math.log2(math.sqrt(keys) / 64 + 1)))


def part_count(blocks: int) -> int:
    """How many parts so many blocks make, six times their root if there are enough."""
    return min(blocks, math.ceil(6 * math.sqrt(blocks))) or 1


_compressor, _decompressor = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeeze(data: bytes) -> bytes:
    return _compressor.compress(data)


def _release(data: bytes) -> bytes:
    return _decompressor.decompress(data)


def _packed(numbers: np.ndarray) -> bytes:
    return _squeeze(pack(numbers))


def _in_blocks(source: DataFrame, parts: int) -> DataFrame:
    """(part, block, docs): the documents (doc_id, train, text) as numbers of words of a block's own
    vocabulary; the blocks are dealt to so many parts, and the table to buckets by part."""

    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = found = len(self) + 2
            return found

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, size, ids, train, numbers, texts = 0, 0, [], [], Numbers(), []

        def flush() -> pd.DataFrame:
            sizes = np.array([len(t) for t in texts])
            words = np.concatenate(texts)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
            order = np.lexsort((hashes, -np.bincount(words, minlength=len(hashes) + 2)[2:]))  # most frequent first, ascending within a count
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            rows = pickle.dumps((ids, np.array(train, bool), sizes, _squeeze(pack_sorted(hashes[order])), _packed(place[words - 2] + 2)), protocol=5)
            block = (TaskContext.get().partitionId() << 32) | seq
            part = int(mix(np.array([block + 1], np.uint64) * _PRIME)[0] >> np.uint64(20)) % parts
            return pd.DataFrame([(part, block, rows)], columns=["part", "block", "docs"])

        for batch in batches:
            for doc_id, learn, text in zip(batch["doc_id"], batch["train"], batch["text"]):
                # On bytes, lower() and split() know ASCII letters and ASCII white space only.
                words = (text or "").encode("utf-8", "replace").lower().split()
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                train.append(bool(learn))
                texts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                size += len(text or "")
                if size >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                    yield flush()
                    seq, size, ids, train, numbers, texts = seq + 1, 0, [], [], Numbers(), []
        if ids:
            yield flush()

    stored = source.select("doc_id", "train", "text").mapInPandas(store, "part int, block long, docs binary")
    return cut_in_buckets(stored, "lm-blocks", "part", parts // 2)


class _Block:
    """A block's symbols in a row: of every document START, its words, END."""

    def __init__(self, data: bytes):
        self.doc_ids, self.doc_train, sizes, hashes, packed = pickle.loads(data)
        self.hashes = np.append(_MARKS, unpack_sorted(_release(hashes)))
        self.sizes = sizes + 1  # tokens: words and the end
        ends = np.cumsum(sizes + 2)
        self.starts = ends - sizes - 2
        self.symbols = np.full(int(ends[-1]), END, np.int32)
        inner = np.ones(len(self.symbols), bool)
        inner[self.starts] = inner[ends - 1] = False
        self.symbols[self.starts] = START
        self.symbols[inner] = unpack(_release(packed))
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 2)
        self.train = self.doc_train[self.doc]
        self._at_all: dict[int, np.ndarray] = {}

    def grams(self, at: np.ndarray, length: int, bits: int) -> np.ndarray:
        """Keys of the n-grams of that length which end at these places."""
        return self._hashed(at, length) >> np.uint64(64 - bits)

    def _hashed(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of n-grams, each made of those of its halves."""
        if length == 1:
            return self.hashes[self.symbols[at]]
        # In ns, about: every word of every n-gram apart, or all places of the block at every halving.
        if length in self._at_all or length * (10_000 + 15 * len(at)) > math.log2(length) * (10_000 + 6 * len(self.symbols)):
            return self._everywhere(length)[at]
        last = 1 if length % 2 else length // 2
        return mix(self._hashed(at - last, length - last) * _PRIME + self._hashed(at, last))

    def _everywhere(self, length: int) -> np.ndarray:
        """The hashes at all places of the block, those of n-grams that begin before it are 0."""
        if length not in self._at_all:
            if length == 1:
                self._at_all[1] = self.hashes[self.symbols]
            else:
                last = 1 if length % 2 else length // 2
                front, back = self._everywhere(length - last), self._everywhere(last)
                found = self._at_all[length] = np.zeros(len(self.symbols), np.uint64)
                found[last:] = mix(front[:-last] * _PRIME + back[last:])
        return self._at_all[length]

    def asked(self, at: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of these places, and which one each has."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if length > 1:
            return np.unique(self.grams(at, length, bits), return_inverse=True)
        words = np.flatnonzero(np.bincount(self.symbols[at], minlength=len(self.hashes)))  # few, and each once
        keys, of = np.unique(mix(np.uint64(length) * _PRIME + self.hashes[words]) >> np.uint64(64 - bits), return_inverse=True)
        rank = np.zeros(len(self.hashes), np.int64)
        rank[words] = of
        return keys, rank[self.symbols[at]]


class _Post:
    """What the blocks of a part send to the tasks of the ranges: a row for each range."""

    def __init__(self, ranges: int):
        self.ranges, self.to = ranges, defaultdict(list)

    def add(self, kind: int, length: int, block: int, keys: np.ndarray, bits: int, *values) -> None:
        """Keys, ascending; each value is (array, how to pack it), with where each key's part of it starts if that isn't one by one."""
        edges = np.arange(1, self.ranges, dtype=np.uint64) << np.uint64(bits - self.ranges.bit_length() + 1)
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        for key, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                self.to[key].append((block, kind, length, _squeeze(pack_sorted(keys[a:b])), *[how(v[at[0][a] : at[0][b]] if at else v[a:b]) for v, how, *at in values]))

    def rows(self, part: int) -> list[tuple]:
        return [(key, part, ROUND, pickle.dumps(sent, protocol=5)) for key, sent in self.to.items()]


def _fixed(nats: np.ndarray) -> np.ndarray:
    """Nats as whole numbers of `NAT` to one, of which sums are the same in whatever order and parts they are made."""
    return np.rint(nats * NAT)


def _signed(numbers: np.ndarray) -> bytes:
    """Whole numbers, those below zero dealt in between the others."""
    numbers = np.ascontiguousarray(numbers).astype(np.int64).reshape(-1)
    return _packed(((numbers << 1) ^ (numbers >> 63)).astype(np.uint64))


def _unsigned(data: bytes) -> np.ndarray:
    numbers = unpack(_release(data))
    return (numbers >> np.uint64(1)).astype(np.int64) ^ -(numbers & np.uint64(1)).astype(np.int64)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every key the sums of the values that its equals have, and which of the keys come first."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return *(np.add.reduceat(v[order], first)[group] for v in values), order[first]


def _judged(kind: int, cells: list[tuple], weights: tuple[float, ...], cutoff: float, least_left: float) -> tuple[list[np.ndarray], int, int]:
    """Sums of counts, or verdicts on contexts, for the keys of every cell; how many keys there are
    that training has, and how often it has them."""
    keys = [unpack_sorted(_release(cell[3])) for cell in cells]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    told = lambda i: np.concatenate([unpack(_release(cell[i])) for cell in cells]).astype(np.int64)
    if kind == ASK:
        counts, first = _sums(np.concatenate(keys), told(4))
        return np.split(counts, ends), int((counts[first] > 0).sum()), int(counts[first].sum())
    n, again = told(4), told(5)
    values = np.zeros((len(weights) + 1, len(n)), np.int64)
    values[:, again > 0] = np.concatenate([_unsigned(cell[6]).reshape(len(weights) + 1, -1) for cell in cells], axis=1)
    n, once, *gains, left, _ = _sums(np.concatenate(keys), n, n - again, *values)
    n = np.maximum(n, 1)
    gains = np.stack([g + once * _fixed(np.log(w / (n - 1 + w))) for g, w in zip(gains, weights)])
    left = left - once * _fixed(np.maximum(cutoff / n, least_left))
    return np.split(np.where(gains.max(0) >= cutoff * NAT, gains.argmax(0) + 1, 0) + GROW * (left >= 0), ends), 0, 0


def _answer(rows: pd.DataFrame, *limits) -> pd.DataFrame:
    """What a range's task sends back; rows of other kinds pass."""
    sent = [pickle.loads(data) if kind == ROUND else [] for kind, data in zip(rows["kind"], rows["data"])]
    told, of = [[None] * len(cells) for cells in sent], defaultdict(list)
    for i, cells in enumerate(sent):
        for k, cell in enumerate(cells):
            of[cell[1], cell[2]].append((i, k))
    types = tokens = keys = 0
    for (kind, length), where in of.items():
        numbers, *totals = _judged(kind, [sent[i][k] for i, k in where], *limits)
        for (i, k), x in zip(where, numbers):
            told[i][k] = (*sent[i][k][:3], _packed(x))
            keys += len(x)
        if length == 1 and kind == ASK:
            types, tokens = totals
    data = [pickle.dumps(cells, protocol=5) if kind == ROUND else data for kind, data, cells in zip(rows["kind"], rows["data"], told)]
    out = rows.assign(data=data, types=0, tokens=0, keys=0)
    out.iloc[0, -3:] = types, tokens, keys
    give_back()
    return out


class _Numbers:
    """The answers for a part by block, kind and length, in the order of their keys."""

    def __init__(self, rows: pd.DataFrame):
        self.parts = defaultdict(list)
        for data in rows[rows["kind"] == ROUND].sort_values("key")["data"]:
            for *name, x in pickle.loads(data):
                self.parts[tuple(name)].append(x)

    def __getitem__(self, name: tuple[int, int, int]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[unpack(_release(x)).astype(np.int64) for x in self.parts.get(name, ())]])


def context_length(m: int) -> int:
    """How many words the contexts have that round m judges, from the second round on: 1, 2, 3, 4, 6, 8, 12, 16, ..."""
    k = m - 1
    return k if k < 4 else (2 + k % 2) << (k // 2 - 1)


class _Growth:
    """The tokens of a block that contexts still grow for, round by round.

    After round m: `at`, the tokens that have a frequent context of the round's length; how
    often that occurs (`n`) and the n-gram of it and the token does (`seen`); the token's
    probability in the longest context known to be kept, with all counts (`kept`) and without its
    own (`apart`); `held`, how often the next longer context occurs, as far as known; `asked` and
    `asked_contexts`, where n-grams end that counts are wanted of.
    """

    PLACES, NUMBERS, CHANCES = ("at", "asked", "asked_contexts"), ("n", "seen", "held"), ("kept", "apart")

    def __init__(self, block: _Block, bits: int, weights: tuple[float, ...], least_count: int, cutoff: float, least_left: float, max_depth: float):
        self.block, self.bits, self.weights = block, bits, weights
        self.least_count, self.cutoff, self.least_left, self.max_depth = least_count, cutoff, least_left, max_depth

    def begin(self, counts: np.ndarray, types: int, tokens: int) -> None:
        block = self.block
        number = np.empty(len(block.hashes), np.int64)
        number[1:] = counts[np.unique(block.hashes[1:], return_inverse=True)[1]]
        number[START] = number[END]  # texts start as often as they end
        count = number[block.symbols]
        self.at = np.flatnonzero(block.symbols != START)
        self.seen, own = count[self.at], block.train[self.at]
        self.kept = (self.seen + 0.1) / (tokens + 0.1 * (types + 1))
        self.apart = np.maximum(self.seen - own + 0.1, 0.1) / np.maximum(tokens - own + 0.1 * (types + 1), 0.1)
        self.n = self.seen
        self.scores = np.zeros(len(block.sizes))
        self._look_ahead(1, count)

    def _keep(self, which: np.ndarray) -> None:
        """Go on with these tokens; the others have their score."""
        self.scores += np.bincount(self.block.doc[self.at[~which]], np.log10(self.kept[~which]), len(self.scores))
        for name in ("at", *self.NUMBERS, *self.CHANCES):
            setattr(self, name, getattr(self, name)[which])

    def _alive(self) -> np.ndarray:
        """Tokens whose n-gram occurs more often than here."""
        return self.seen >= np.where(self.block.train[self.at], 2, 1)

    def _look_ahead(self, m: int, count: np.ndarray | None) -> None:
        """What the next round will need. `count` has, by place, how often the n-gram of m words ends
        there that the next context is, -1 where nobody asked; without it contexts are asked for too."""
        length, after = context_length(m + 1), context_length(m + 2)
        self.asked_contexts = np.zeros(0, np.int64)
        if count is not None:
            self.held = np.maximum(count[self.at - 1], 0)
        else:
            self.held = np.where(self.at - length >= self.block.starts[self.block.doc[self.at]], self.least_count, 0)
        if length > self.max_depth:
            self.held[:] = 0
        open_ = self.held >= self.least_count
        self.asked = self.at[open_ & self._alive()]
        if count is None:
            self.asked_contexts = self.at[open_] - 1
        elif after == length + 1:  # the round after the next one will know its contexts from these
            before = self.at[open_] - 1
            before = before[before - self.block.starts[self.block.doc[before]] >= length]
            shorter = count[before - 1]
            marked = np.zeros(len(self.block.symbols), bool)
            marked[self.asked] = marked[before[(shorter < 0) | (shorter >= self.least_count)]] = True
            self.asked = np.flatnonzero(marked)

    def by_place(self, m: int, counts: np.ndarray, flags: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """The counts of the n-grams that round m asked for and the verdicts of the round before, one for each place."""
        told = counts[self.block.asked(self.asked, context_length(m) + 1, self.bits)[1]] if len(self.asked) else counts[:0]
        if flags is None or not len(self.at):
            return told, flags
        return told, flags[self.block.asked(self.at - 1, context_length(m - 1), self.bits)[1]]

    def advance(self, m: int, counts: np.ndarray, contexts: np.ndarray, flags: np.ndarray | None, again: bool = False) -> None:
        """Round m: take in counts of n-grams and verdicts, by place (see `by_place`), and counts of contexts.
        A round that is gone through `again` has told its gains."""
        block, length = self.block, context_length(m)
        go = self.held >= self.least_count
        if flags is not None and len(self.at):
            told = flags
            own, choice = block.train[self.at], told % GROW
            weight = np.array([0.0, *self.weights])[choice]
            with np.errstate(invalid="ignore", divide="ignore"):
                self.kept = np.where(choice > 0, (self.seen + weight * self.kept) / (self.n + weight), self.kept).astype(np.float32)
                self.apart = np.where(choice > 0, (self.seen - own + weight * self.apart) / (self.n - own + weight), self.apart).astype(np.float32)
            go &= told >= GROW
        count = np.full(len(block.symbols), -1, np.int64)
        count[self.asked] = counts
        if len(self.asked_contexts):
            of = np.zeros(len(block.symbols), np.int64)
            of[self.asked_contexts] = contexts[block.asked(self.asked_contexts, length, self.bits)[1]]
            self.held = of[self.at - 1]
            go &= self.held >= self.least_count
        self._keep(go)
        own = block.train[self.at]
        self.seen = np.where(self._alive(), count[self.at], own)
        self.n = self.held
        if not again:
            # Training occurrences of words that the context has seen elsewhere too; what the others gain depends on n alone.
            self.more = np.flatnonzero(own & (self.seen > 1))
            seen, n, apart = self.seen[self.more] - 1, self.n[self.more] - 1, self.apart[self.more].astype(np.float64)
            chances = [(seen + w * apart) / (n + w) for w in self.weights]
            # What is left to gain, less this occurrence's part of what there must be for the context to grow.
            left = -np.log(chances[0]) - np.maximum(self.cutoff / (n + 1), self.least_left)
            self.gain = [_fixed(x) for x in (*[np.log(c / apart) for c in chances], left)]
        self._look_ahead(m, count if context_length(m + 1) == length + 1 else None)

    def gains(self, m: int, name: int, post: _Post) -> None:
        length = context_length(m)
        keys, back = self.block.asked(self.at - 1, length, self.bits)
        n, again = np.bincount(back, self.block.train[self.at], len(keys)).astype(np.int64), np.bincount(back[self.more], minlength=len(keys))
        ends = np.append(0, np.cumsum(again > 0))
        of = ends[back[self.more]]
        gains = np.stack([np.bincount(of, g, ends[-1]) for g in self.gain], axis=1)  # a row for each context, which is what is cut into ranges
        post.add(GAIN, length, name, keys, self.bits, (n, _packed), (again, _packed), (gains, lambda x: _signed(x.T), ends))

    def asks(self, m: int, name: int, post: _Post) -> None:
        length = context_length(m + 1)
        for places, size in ((self.asked, length + 1), (self.asked_contexts, length)):
            keys, back = self.block.asked(places, size, self.bits)
            post.add(ASK, size, name, keys, self.bits, (np.bincount(back, self.block.train[places], len(keys)).astype(np.uint64), _packed))

    def save(self) -> bytes:
        numbers = [pack_sorted(getattr(self, x)) for x in self.PLACES] + [pack(getattr(self, x)) for x in self.NUMBERS]
        return _squeeze(pickle.dumps((numbers, [getattr(self, x).astype(np.float32) for x in self.CHANCES], self.scores), protocol=5))

    def load(self, data: bytes) -> None:
        numbers, chances, self.scores = pickle.loads(_release(data))
        for name, x in zip((*self.PLACES, *self.NUMBERS), numbers):
            setattr(self, name, (unpack_sorted(x) if name in self.PLACES else unpack(x)).astype(np.int64))
        for name, x in zip(self.CHANCES, chances):
            setattr(self, name, x.astype(np.float64))

    def shrink(self) -> tuple[bytes, list[tuple[int, float]]]:
        """Go on with the documents that have a token left. Returns these as a block's data, and the
        (doc, score) of the others, docs by their numbers in the block."""
        block, open_ = self.block, np.zeros(len(self.block.sizes), bool)
        open_[block.doc[self.at]] = True
        ended = [(block.doc_ids[d], float(self.scores[d])) for d in np.flatnonzero(~open_)]
        inside = open_[block.doc]
        place = np.cumsum(inside) - 1
        words = block.symbols[inside & (block.symbols > END)]
        numbers, of = np.unique(words, return_inverse=True)
        ids = [block.doc_ids[d] for d in np.flatnonzero(open_)]
        rows = (ids, block.doc_train[open_], block.sizes[open_] - 1, _squeeze(pack_sorted(block.hashes[numbers])), _packed(of + 2))
        for name in self.PLACES:
            setattr(self, name, place[getattr(self, name)])
        self.scores = self.scores[open_]
        return pickle.dumps(rows, protocol=5), ended


def suffix_tree_scores(
    docs: DataFrame, train, weights: tuple[float, ...] = (1.0, 8.0, 64.0), least_count: int = 2, cutoff: float = 2.0, least_left: float = 0.25,
    max_depth: int | None = None,
) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row.

    `train` is a boolean column: which rows the model learns from. Tokens are the words of the
    whole text (white space parts them, A-Z are lower-cased), then one end. base_score is the
    unigram log10 probability with 0.1 added to every count, score that of the suffix tree;
    n_known counts tokens seen in training, train_tokens all of the training tokens. A null,
    empty or blank text is its end alone. Rows that repeat are scored, and learned from, each
    for itself. Without training rows both scores are 0 (the end, or any word, is all there is
    to expect). Other columns are ignored. Contexts have any of the
    lengths above, up to `max_depth` words if it is given.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), "text")
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, words = _in_blocks(source, part_count(chars // BLOCK_CHARS)), chars / 6
    bits = min(60, max(40, math.ceil(math.log2(words + 1)) + 12))
    depth = math.inf if max_depth is None else max_depth
    answers = f"{_SENT}, types long, tokens long, keys long"

    def growth(block: _Block) -> _Growth:
        return _Growth(block, bits, weights, least_count, cutoff, least_left, depth)

    def first(own: pd.DataFrame) -> pd.DataFrame:
        post = _Post(range_count(words))
        for name, data in zip(own["block"], own["docs"]):
            block = _Block(data)
            keys, back = np.unique(block.hashes[1:], return_inverse=True)
            tokens = block.symbols[block.train & (block.symbols != START)]
            post.add(ASK, 1, name, keys, 64, (np.bincount(back[tokens - 1], minlength=len(keys)).astype(np.uint64), _packed))
        return pd.DataFrame(post.rows(own["part"].iloc[0]), columns=_NAMES)

    def answered(sent: DataFrame, m: int) -> DataFrame:
        return cut(sent.groupBy("key").applyInPandas(lambda rows: _answer(rows, weights, cutoff, least_left), answers), f"lm-round-{m}")

    def over(told: DataFrame, run, schema: str) -> DataFrame:
        return blocks.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(run, schema)

    rounds = [answered(blocks.groupBy("part").applyInPandas(first, _SENT), 1)]
    totals = rounds[0].agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = totals[0] or 0, totals[1] or 0

    def step(own: pd.DataFrame | None, rows: pd.DataFrame, m: int, ranges: int) -> pd.DataFrame:
        part, told = int(rows["part"].iloc[0]), _Numbers(rows)
        kept = {name: x for data in rows.loc[rows["kind"] == KEPT, "data"] for name, x in pickle.loads(data).items()}
        post, keep, scores = _Post(ranges), {}, {}
        for name in sorted(kept) if own is None else own["block"].tolist():
            memory, state, docs = kept.get(name, ([], b"", b""))
            block = _Block(docs or own.loc[own["block"] == name, "docs"].iloc[0])
            grown = growth(block)
            if m > FULL:
                grown.load(state)
            else:
                grown.begin(told[name, ASK, 1], types, tokens)
            for k, known in enumerate(memory, 2):  # an earlier run of these rounds has found which count and verdict belong to which place
                counts, flags = (unpack(_release(x)).astype(np.int64) if x else None for x in known)
                grown.advance(k, counts, told[name, ASK, 0], flags, again=True)
            if m > 1:
                length = context_length(m)
                counts, flags = grown.by_place(m, told[name, ASK, length + 1], told[name, GAIN, context_length(m - 1)] if m > 2 else None)
                grown.advance(m, counts, told[name, ASK, length], flags)
                memory = [*memory, (_packed(counts), _packed(flags) if flags is not None else b"")] if m < FULL else []
                grown.gains(m, name, post)
            grown.asks(m, name, post)
            if m >= SMALL:
                if m == SMALL:
                    block.doc_ids = list(range(len(block.sizes)))
                docs, scores[name] = grown.shrink()
                if len(grown.at):
                    keep[name] = (memory, grown.save(), docs)
            elif m > 1:
                keep[name] = (memory, grown.save() if m >= FULL else b"", b"")
        found = post.rows(part)
        for kind, held in ((KEPT, keep), (SCORES, scores)):
            if any(held.values()):
                found.append((part % ranges, part, kind, pickle.dumps(held, protocol=5)))
        give_back()
        return pd.DataFrame(found, columns=_NAMES)

    def carried_on(m: int, ranges: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return step(None, rows, m, ranges)

        return run

    def with_blocks(m: int, ranges: int):
        def run(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            return step(own, rows, m, ranges)

        return run

    m, ranges = 1, range_count(words)
    while m <= SMALL or not rounds[-1].where(F.col("kind") == KEPT).isEmpty():
        told = rounds[-1]
        if 1 < m <= FULL:
            told = told.unionByName(rounds[0])
        if m > 1:  # no round asks for much more than the one before
            ranges = range_count(told.agg(F.sum("keys")).first()[0] or 0)
        if m <= SMALL:
            sent = over(told, with_blocks(m, ranges), _SENT)
        else:
            sent = told.where(F.col("kind") != SCORES).groupBy("part").applyInPandas(carried_on(m, ranges), _SENT)
        rounds.append(answered(sent, m + 1))
        if 1 < m <= SMALL:  # later ones hold scores
            free(rounds.pop(-2))
        m += 1

    def score(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        told, found = _Numbers(rows), []
        ended = defaultdict(list)
        for data in rows.loc[rows["kind"] == SCORES, "data"]:
            for name, x in pickle.loads(data).items():
                ended[name] += x
        for name, data in zip(own["block"], own["docs"]):
            block = _Block(data)
            grown = growth(block)
            grown.begin(told[name, ASK, 1], types, tokens)
            doc = block.doc[grown.at]
            total = lambda x: np.bincount(doc, x, len(block.sizes))  # noqa: B023, E731
            known, base = total(grown.seen > 0), total(np.log10(grown.kept))
            scores = np.zeros(len(block.sizes))
            scores[[d for d, _ in ended[name]]] = [x for _, x in ended[name]]
            found.append(pd.DataFrame({
                "doc_id": pd.array(block.doc_ids, dtype="Int64"), "train": block.doc_train, "n_tokens": block.sizes,
                "n_known": known.astype(np.int64), "train_tokens": tokens, "base_score": base, "score": scores,
            }))
        return pd.concat(found)

    schema = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    told = rounds[0]
    for other in rounds[1:]:
        told = told.unionByName(other.where(F.col("kind") == SCORES))
    return over(told, score, schema)


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    out = suffix_tree_scores(docs, train)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), *out.columns[2:])
