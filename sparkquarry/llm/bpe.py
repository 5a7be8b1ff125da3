"""BPE encoding and decoding with a pair occurrence index.

All distinct new words of a slice of texts are merged together: an index maps every adjacent pair of
symbols to all its positions, the pairs that have a rank wait in a heap, and the lowest
rank is applied at all its positions at once; only the lists of the neighbouring pairs
change. Ranks are local to a word, so this gives each word the merges it would get alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkquarry.llm.shared import give_back, table

#: About so much memory a Python worker spends on words whose ids it keeps; then it starts afresh.
CACHED_BYTES, WORD_BYTES = 32_000_000, 160
SLICE_CHARS = 500_000
SURROGATES = range(0xD800, 0xE000)


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


def merge_words(words: list[list[int]], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[list[int]]:
    """The symbols of each word after all merges; `ranks` maps a pair to (rank, merged symbol)."""
    symbols: list[int] = []
    for word in words:
        symbols += word
        symbols.append(-1)  # no pair spans two words
    size = len(symbols)
    following = list(range(1, size + 1))
    preceding = list(range(-1, size - 1))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for at, pair in enumerate(zip(symbols, symbols[1:])):
        if pair in ranks:
            places[pair].append(at)
    active = [(ranks[pair][0], pair) for pair in places]
    heapq.heapify(active)
    while active:
        _, pair = heapq.heappop(active)
        left, right = pair
        merged = ranks[pair][1]
        for at in sorted(places.pop(pair)):
            after = following[at]
            if symbols[at] != left or after >= size or symbols[after] != right:
                continue  # an earlier merge took one of the two
            symbols[at], symbols[after] = merged, -2
            following[at] = nearest = following[after]
            if nearest < size:
                preceding[nearest] = at
                new = (merged, symbols[nearest])
                if new in ranks:
                    if new not in places:
                        heapq.heappush(active, (ranks[new][0], new))
                    places[new].append(at)
            before = preceding[at]
            if before >= 0:
                new = (symbols[before], merged)
                if new in ranks:
                    if new not in places:
                        heapq.heappush(active, (ranks[new][0], new))
                    places[new].append(before)
    out, word = [], []
    for symbol in symbols:
        if symbol == -1:
            out.append(word)
            word = []
        elif symbol != -2:
            word.append(symbol)
    return out


class WordBpe:
    """A byte-level BPE vocabulary with word ends: composed, lower-cased text in words."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        spec = json.loads(spec)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [token_of.get(i, "") for i in range(max(token_of) + 1)]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters]
        self.ranks = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # The pattern's \s is Unicode's White_Space, which regex's \p{White_Space} names exactly.
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.newer = self._newer_letters()
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _newer_letters(self) -> np.ndarray:
        """Code points that Python and the library may know from different versions of Unicode.

        These are all that Python's own tables don't assign, and the marks and letters with
        case that came after the oldest version it has tables of and that differ.
        """
        newer, old, normal = np.zeros(0x110000, bool), unicodedata.ucd_3_2_0, self.library.normalizer.normalize_str
        for c in range(0x80, 0x110000):
            if c in SURROGATES:
                continue
            x = chr(c)
            kind = unicodedata.category(x)
            if kind == "Cn":
                newer[c] = c < 0xE0000
            elif kind != "Co" and old.category(x) == "Cn":
                newer[c] = kind[0] == "M" or bool(unicodedata.decomposition(x)) or (kind[0] == "L" and normal(x) != self._lower(x))
        return newer

    @staticmethod
    def _lower(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # str.lower() alone would write a sigma at a word's end in its final form.
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def _is_newer(self, text: str) -> bool:
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            return bool(self.newer[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].any())

    def _split(self, text: str) -> list[str]:
        if self._is_newer(text):
            text = self.library.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(self._lower(text))

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special token stands as one word."""
        if "<|" not in text:
            return self._split(text)
        found: list[str] = []
        for part in self.specials.split(text):
            if part in self.special:
                found.append(part)
                self.known.setdefault(part, np.array([self.special[part]], "<i4").tobytes())
            else:
                found += self._split(part)
        return found

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that aren't known yet, all together."""
        new = [w for w in words if w not in self.known]
        coded = []
        for word in new:
            data = word.encode("utf-8", "replace")
            coded.append([self.inner[b] for b in data[:-1]] + [self.last[data[-1]]])
        for word, ids in zip(new, merge_words(coded, self.ranks)):
            self.known[word] = found = np.array(ids, "<i4").tobytes()
            self.held += WORD_BYTES + len(found) + 4 * len(word)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.held > CACHED_BYTES:
            self.known.clear()
            self.held = 0
        split = [self.words(t) for t in texts]
        self.learn({w for words in split for w in words})
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<i4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary has no decoder: its tokens are joined by blanks."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _tokenizer(spec: str) -> WordBpe:
    return WordBpe(spec)


def _slices(sizes: list[int], chars: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows, as (first, behind the last), of about so many characters or one longer row."""
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and held + size > chars:
            yield first, i
            first, held = i, 0
        held += size
    if len(sizes) > first:
        yield first, len(sizes)


def _with_columns(docs: DataFrame, spec: str, columns: Callable[[WordBpe, list[str]], list[pa.Array]], schema: str) -> DataFrame:
    """`docs` plus columns made of its texts, a slice of `SLICE_CHARS` at a time, so that no batch's ids are held at once."""
    names = [part.split()[0] for part in schema.split(", ")]
    text, before = docs.columns.index("text"), [f"other_{i}" for i in range(len(docs.columns))]  # names that Spark can take
    safe = docs.toDF(*before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
            for low, high in _slices(sizes, SLICE_CHARS):
                part = batch.slice(low, high - low)
                made = columns(bpe, [t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*before, *names])
                del made
        give_back()

    types = T.StructType([*safe.schema.fields, *T._parse_datatype_string(schema).fields])
    return safe.mapInArrow(run, types).toDF(*docs.columns, *names)


def read_spec(path: str) -> str:
    """The tokenizer file, read by the driver; a vocabulary has a fixed size of a few MB."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """`docs` plus n_tokens, ids (array<int>) and decoded, over the whole `text` of each row.

    A null or empty text has no ids and decodes to "". Special tokens that a text spells out
    become their ids, as the public library does unless told otherwise. Rows that repeat are
    coded each. Other columns pass through; input columns with these three names are replaced.
    """

    def columns(bpe: WordBpe, texts: list[str]) -> list[pa.Array]:
        ids = bpe.encode(texts)
        sizes = np.array([len(i) for i in ids])
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, "<i4")]).astype(np.int32)))
        return [pa.array(sizes.astype(np.int64)), lists, pa.array([bpe.decode(i) for i in ids], pa.string())]

    return _with_columns(docs.drop("n_tokens", "ids", "decoded"), read_spec(tokenizer_path), columns, "n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """As encode_decode, but SHA-256 digests instead of the ids and the decoded text."""

    def columns(bpe: WordBpe, texts: list[str]) -> list[pa.Array]:
        decimal = [str(i) for i in range(len(bpe.tokens))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        ids = bpe.encode(texts)
        coded = [sha(" ".join(map(decimal.__getitem__, i.tolist()))) for i in ids]
        return [pa.array([len(i) for i in ids], pa.int64()), pa.array(coded, pa.string()), pa.array([sha(bpe.decode(i)) for i in ids], pa.string())]

    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    return _with_columns(docs, read_spec(tokenizer_path), columns, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids and what they decode to; null texts have no ids."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
