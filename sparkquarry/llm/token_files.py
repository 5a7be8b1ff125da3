"""Token ids in directly addressable codes, written by shards in document order.

A segment's ids are split into chunks of 8 bits, the lowest first. Level k holds the k-th
chunk of all ids that have one, a bitmap that tells which of these go on to level k + 1,
and a directory of the bitmap's running counts every 512 bits. Any id is found by one step
and one rank a level, without decoding its neighbours.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.llm.bpe import byte_letters, read_spec
from sparkquarry.llm.shared import cut, table

MAGIC = b"DAC1"
STEP = 512  # bits of a bitmap between two entries of its directory
SEGMENT_IDS = 1 << 20
CACHED_WORDS = 400_000


def pack(ids: np.ndarray) -> bytes:
    """`ids` (whole numbers from 0 to 2**32 - 1) as directly addressable codes."""
    rest = np.asarray(ids, dtype=np.uint32)
    levels = []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        counts = np.concatenate(([0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), STEP), dtype=np.uint32)))) if len(more) else [0]
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), np.asarray(counts[:-1], dtype="<u4").tobytes()))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(b"".join(parts) for _, *parts in levels)


class Codes:
    """Reads what `pack` has made."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (count,) = struct.unpack_from("<I", data, 4)
        sizes = struct.unpack_from(f"<{count}Q", data, 8)
        at, self.levels = 8 + 8 * count, []
        for n in sizes:
            parts = []
            for size, kind in ((n, np.uint8), ((n + 7) // 8, np.uint8), ((n + STEP - 1) // STEP, np.dtype("<u4"))):
                parts.append(np.frombuffer(data, kind, size, at))
                at += size * np.dtype(kind).itemsize
            self.levels.append(parts)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The i-th id, by ranks alone."""
        found = 0
        for level, (chunks, bits, directory) in enumerate(self.levels):
            found |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                return found
            block = i // STEP
            before = np.unpackbits(bits[block * STEP // 8 : (i >> 3) + 1], bitorder="little")[: i - block * STEP]
            i = int(directory[block]) + int(before.sum())
        return found

    def all(self) -> np.ndarray:
        found = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            upper, found = found, chunks.astype(np.uint32)
            more = np.unpackbits(bits, bitorder="little", count=len(chunks)).astype(bool)
            found[more] |= upper << np.uint32(8)
        return found


class _ByWord:
    """The public library's ids of whole texts, with each distinct word encoded once.

    The pre-tokenizer's pattern cuts texts into words that the vocabulary's merges never
    cross; the library encodes the words, and special tokens that a text spells out.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        space = r"\p{White_Space}"
        pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|{space}+(?!\P{{White_Space}})|{space}+"
        self.words = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if self.specials is None or not self.specials.search(text):
            return self.words.findall(text)
        return [w for part in self.specials.split(text) for w in ([part] if self.specials.fullmatch(part) else self.words.findall(part))]

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        words = self.split(text)
        for word in set(words).difference(self.known):
            if self.specials is not None and self.specials.fullmatch(word):
                ids = [self.library.token_to_id(word)]
            else:
                ids = [t.id for t in self.library.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))]
            self.known[word] = np.array(ids, dtype="<u4").tobytes()
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype="<u4")


@lru_cache(maxsize=2)
def _by_word(spec: str) -> _ByWord:
    return _ByWord(spec)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write the ids of all texts in ascending doc_id order; return the written segments.

    A row is one segment: shard and segment (their order is that of the ids), shard_start
    (ids before it in its shard), doc_ids, lengths (ids of each document, its end id
    included) and codes. A segment ends after the document that takes it to `segment_ids`
    ids, so a longer document has one of its own. Each document gets `end_id` at its end;
    a null or empty text has no other id. Documents without doc_id come first; rows that
    repeat a doc_id stay together, ordered by text. Other columns are ignored.
    """
    spec = read_spec(tokenizer_path)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_word, shard = _by_word(spec), TaskContext.get().partitionId()
        segment = start = held = 0
        doc_ids, parts = [], []

        def flush() -> pd.DataFrame:
            row = (shard, segment, start, doc_ids, [len(p) for p in parts], pack(np.concatenate(parts)))
            return pd.DataFrame([row], columns=["shard", "segment", "shard_start", "doc_ids", "lengths", "codes"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(by_word.encode(text or ""), np.uint32(end_id))
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                parts.append(ids)
                held += len(ids)
                if held >= segment_ids:
                    yield flush()
                    segment, start, held, doc_ids, parts = segment + 1, start + held, 0, [], []
        if parts:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    schema = "shard int, segment int, shard_start long, doc_ids array<long>, lengths array<long>, codes binary"
    return cut(ordered.mapInPandas(write, schema), "token-files")


def read_token_files(segments: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian 32-bit numbers) and, if asked for, ids."""
    totals = segments.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_ids"))
    # A row per shard, of which there are as many as the writer had tasks.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    # A row a shard, as many as the writer had tasks: bounded, so the codes needn't move.
    placed = segments.join(F.broadcast(offsets), F.col("shard") == F.col("_shard")).select((F.col("_before") + F.col("shard_start")).alias("start"), "doc_ids", "lengths", "codes")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, doc_ids, lengths, codes in zip(batch["start"], batch["doc_ids"], batch["lengths"], batch["codes"]):
                ids = Codes(codes).all().astype("<u4")
                ends = np.cumsum(lengths)
                rows = [
                    (None if pd.isna(d) else int(d), start + e - n, n, zlib.crc32(ids[e - n : e].tobytes()))
                    + ((ids[e - n : e],) if with_ids else ())
                    for d, n, e in zip(doc_ids, lengths, ends)
                ]
                for k in range(0, len(rows), 500):
                    yield pd.DataFrame(rows[k : k + 500], columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [part.split()[0] for part in schema.split(", ")]
    return placed.mapInPandas(read, schema)


def tokens_at(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, at, token) of the tokens that `wanted` (doc_id, at: from 0, the end id included) asks for.

    Codes are addressed one by one: of a segment that holds wanted tokens nothing but these is
    decoded, and other segments don't move. Tokens that don't exist are left out, nulls match
    nothing; of rows that repeat a doc_id each answers.
    """
    at = wanted.where("doc_id IS NOT NULL AND at >= 0").select("doc_id", F.col("at").cast("long").alias("at")).distinct()
    held = segments.select("shard", "segment", F.posexplode("doc_ids").alias("place", "_doc"), "lengths")
    start = F.aggregate(F.slice("lengths", F.lit(1), F.col("place")), F.lit(0).cast("long"), lambda a, x: a + x)
    met = held.join(at, F.col("_doc") == F.col("doc_id")).where(F.get("lengths", F.col("place")) > F.col("at"))
    asked = met.select(F.col("shard").alias("_shard"), F.col("segment").alias("_segment"), "doc_id", "at", (start + F.col("at")).alias("position"))
    asked = asked.groupBy("_shard", "_segment").agg(F.collect_list(F.struct("doc_id", "at", "position")).alias("asked"))
    rows = segments.select("shard", "segment", "codes").join(asked, (F.col("shard") == F.col("_shard")) & (F.col("segment") == F.col("_segment")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data, places in zip(batch["codes"], batch["asked"]):
                codes = Codes(data)
                yield pd.DataFrame([(p["doc_id"], p["at"], codes[p["position"]]) for p in places], columns=["doc_id", "at", "token"])

    return rows.select("codes", "asked").mapInPandas(read, "doc_id long, at long, token long")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    segments = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(segments, with_ids=False)
