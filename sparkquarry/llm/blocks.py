"""Documents in compressed blocks of bounded size, which later passes read again and again."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparkquarry.llm.shared import cut

BLOCK_CHARS, BLOCK_DOCS = 5_000_000, 50_000


def in_blocks(source: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, docs) of `source` (doc_id, train, text), written to the shared folder.

    A block ends with the document that takes it to `block_chars` characters; documents are
    never cut. Null texts become empty.
    """

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, size, docs = 0, 0, []

        def flush() -> pd.DataFrame:
            data = zstandard.ZstdCompressor(level=3).compress(pickle.dumps(docs, protocol=5))
            return pd.DataFrame([((TaskContext.get().partitionId() << 32) | seq, data)], columns=["block", "docs"])

        for batch in batches:
            for doc_id, train, text in zip(batch["doc_id"], batch["train"], batch["text"]):
                docs.append((None if pd.isna(doc_id) else int(doc_id), bool(train), text or ""))
                size += len(text or "")
                if size >= block_chars or len(docs) >= BLOCK_DOCS:
                    yield flush()
                    seq, size, docs = seq + 1, 0, []
        if docs:
            yield flush()

    return cut(source.select("doc_id", "train", "text").mapInPandas(store, "block long, docs binary"), "blocks")


def documents_of(data: bytes) -> list[tuple[int | None, bool, str]]:
    """The documents of a block, as `in_blocks` has written them."""
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))
