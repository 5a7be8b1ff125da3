"""Lenient CSV of any size, read in splits by many tasks.

Whether a line starts inside of quotes depends on every quotation mark before it in its file. So
each split first tells how many marks it has, and how many records of several lines start in it
if it begins outside of quotes, and if it begins inside; running sums over a file's splits then
say which, and which number its first such record has. That table has a row for each split, no
more than the driver itself plans by. With it every line is judged by itself: it is a record if
it starts and ends outside of quotes, and else a part of one, which is put together with its
neighbours by its number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquarry.functions import js

#: Values in the table of splits that is sent to every task; a larger one is joined by a shuffle.
BROADCAST_VALUES = 4_000_000
#: Text that a task takes apart at once.
PIECE_BYTES = 1 << 22
BOM = "﻿"


def header_name(name: str | None, position: int) -> str:
    """A CSV header in snake case; an empty one is called after its place, from 1."""
    return re.sub(r"[^a-z0-9]+", "_", (name or "").strip().lower()).strip("_") or f"column_{position}"


def csv_rows(text: str, returns_end_rows: bool = True) -> Iterator[list[str]]:
    """Rows of cells. A quotation mark opens or closes quoting wherever it stands; two of them, inside
    of quotes, are one; commas and line ends (CR, LF or both) count outside of quotes only. Without
    `returns_end_rows` a CR outside of quotes is left out instead."""
    row, cell, quoted = [], [], False
    parts = re.findall(r'"|,|\r\n|\r|\n|[^",\r\n]+', text)
    at = 0
    while at < len(parts):
        part = parts[at]
        at += 1
        if part == '"':
            if quoted and parts[at : at + 1] == ['"']:
                cell.append('"')
                at += 1
            else:
                quoted = not quoted
        elif quoted or part not in (",", "\r\n", "\r", "\n"):
            cell.append(part)
        elif part == ",":
            row.append("".join(cell))
            cell = []
        elif part != "\r" or returns_end_rows:
            yield [*row, "".join(cell)]
            row, cell = [], []
    if row or cell:
        yield [*row, "".join(cell)]


def _numbered(lines: DataFrame) -> DataFrame:
    """`lines` (file, block, value; as a text source reads them) plus at, a line's place in its split, quotes, its
    quotation marks, and before, those before it in its split."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, before = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            quotes = pc.count_substring(batch.column("value"), '"').cast(pa.int64()).to_numpy()
            file, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block"))
            edges = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(quotes)]
            places, sums = np.empty(len(quotes), np.int64), np.empty(len(quotes), np.int64)
            for a, b in zip(edges, edges[1:]):
                if (file[a], block[a]) != last:
                    last, at, before = (file[a], block[a]), 0, 0
                running = before + np.cumsum(quotes[a:b])
                places[a:b], sums[a:b] = np.arange(at, at + b - a), running - quotes[a:b]
                at, before = at + b - a, int(running[-1])
            columns = [batch.column(c) for c in ("file", "block", "value")] + [pa.array(x) for x in (places, quotes, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "value", "at", "quotes", "before"])

    return lines.select("file", "block", "value").mapInArrow(count, "file string, block long, value string, at long, quotes long, before long")


def _pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of no more than so many bytes of text, or of one row."""
    sums, at = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, "right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def _odd(x: Column) -> Column:
    return x % 2 == 1


def _splits(numbered: DataFrame) -> DataFrame:
    """(file, block, inside, base): does the split begin inside of quotes, and how many records of several lines start before it?"""
    starts = lambda inside: F.sum(F.when(_odd(F.col("quotes")) & (_odd(F.col("before")) == inside), 1).otherwise(0))
    told = numbered.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), starts(False).alias("outside_starts"), starts(True).alias("inside_starts"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = told.withColumn("inside", _odd(F.coalesce(F.sum("quotes").over(before), F.lit(0))))
    own = F.when(F.col("inside"), F.col("inside_starts")).otherwise(F.col("outside_starts"))
    return inside.withColumn("own", own).select("file", "block", "inside", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))


def _records(placed: DataFrame) -> DataFrame:
    """(file, block, at, text, whole) of records, from numbered lines with `inside` and `base`; whole is false for one that never ends."""
    opened = placed.withColumn("opened", _odd(F.col("before") + F.col("inside").cast("long")))
    single = opened.where(~F.col("opened") & ~_odd(F.col("quotes"))).select("file", "block", "at", F.col("value").alias("text"), F.lit(True).alias("whole"))
    parts = opened.where(F.col("opened") | _odd(F.col("quotes")))
    start = (~F.col("opened")).cast("long")
    record = F.col("base") + F.sum(start).over(Window.partitionBy("file", "block").orderBy("at"))
    lines = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    joined = parts.withColumn("record", record).groupBy("file", "record").agg(lines.alias("lines"), (~_odd(F.sum("quotes"))).alias("whole"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    return single.unionByName(joined.select("file", F.get("lines", F.lit(0))["block"].alias("block"), F.get("lines", F.lit(0))["at"].alias("at"), text.alias("text"), "whole"))


def _parsed(records: DataFrame, returns_end_rows: bool) -> DataFrame:
    """(file, block, at, sub, cells) of the rows of records; more than one where a lone CR ends rows."""

    cells = pa.list_(pa.list_(pa.string()))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda t: [t.split(",")] if '"' not in t and "\r" not in t else list(csv_rows(t + "\n", returns_end_rows))
        for batch in batches:  # a batch may have thousands of long records: only some are Python's objects at once
            for piece in _pieces(batch):
                made = pa.array([plain(t) for t in piece.column("text").to_pylist()], cells)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("file", "block", "at")), made], names=["file", "block", "at", "rows"])

    text = F.when((F.col("block") == 0) & (F.col("at") == 0), F.regexp_replace("text", f"^{BOM}", "")).otherwise(F.col("text"))
    rows = records.select("file", "block", "at", text.alias("text")).mapInArrow(rows_of, "file string, block long, at long, rows array<array<string>>")
    return rows.select("file", "block", "at", F.posexplode("rows").alias("sub", "cells"))


def read_csv(spark: SparkSession, path: str | list[str], profile: str = "lead") -> DataFrame:
    """CSV files with headers, each by its own header; columns that a file lacks are empty in its rows.

    Quoting is lenient (see csv_rows); missing cells are empty, and of equal headers the last
    column of a file is kept. Profile "lead": headers in snake case, cells trimmed, rows of blank
    cells left out (before the header too), a lone CR ends a row, rows in the order of file names and lines. "registry": headers with their
    blanks squeezed, cells as they are, all rows kept, a CR outside of quotes dropped. "research":
    the same, without rows whose cells are all empty. A byte-order mark is dropped. Columns stand in
    the order of the headers' first appearance, by file name.

    Files are read in splits; a quoted cell may reach over any of them. Only LF divides lines for
    that, so a file that has none but CR is one task's work, and every file is read as if it ended
    in LF. No rows: one column, column_1, and no rows.
    """
    lead = profile == "lead"
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    splits = _splits(_numbered(lines)).collect()  # a row for each split, as the driver's own plan has
    kinds = "file string, block long, inside boolean, base long"
    blank = F.col("cells").isNull() if not lead else ~F.exists("cells", lambda c: js.trim(c) != "")

    def first_rows(of: DataFrame, told: list) -> dict[str, tuple]:
        place = F.struct("block", "at", "sub")
        found = _parsed(_records(of).where("whole" if told is None else "true"), lead).where(~blank).groupBy("file").agg(F.min_by("cells", place).alias("cells"), F.min(place).alias("place"))
        return {r["file"]: (list(r["cells"]), tuple(r["place"])) for r in found.collect()}

    # Headers stand in the first split, but for files that start with very many blank lines.
    start = _numbered(lines.where("block = 0")).withColumns({"inside": F.lit(False), "base": F.lit(0).cast("long")})
    heads = first_rows(start, None)
    missing = {s["file"] for s in splits} - set(heads)
    if missing:
        late = spark.createDataFrame([tuple(s) for s in splits if s["file"] in missing], kinds)
        heads |= first_rows(_numbered(lines).join(late, ["file", "block"]), splits)
    name = header_name if lead else (lambda h, i: " ".join(h.split()))
    places = {f: {name(h, i + 1): i for i, h in enumerate(cells)} for f, (cells, _) in sorted(heads.items())}
    names = list(dict.fromkeys(n for of_file in places.values() for n in of_file))
    if not names:
        return spark.createDataFrame([], "column_1 string")
    rows = [(*s, [places[s["file"]].get(n, -1) for n in names], *heads[s["file"]][1]) for s in splits if s["file"] in heads]
    told = spark.createDataFrame(rows, f"{kinds}, slots array<int>, head_block long, head_at long, head_sub long")
    told = F.broadcast(told) if len(rows) * (len(names) + 10) <= BROADCAST_VALUES else told
    numbered = _numbered(lines).join(told.select("file", "block", "inside", "base"), ["file", "block"])
    parsed = _parsed(_records(numbered), lead).join(told.drop("inside", "base"), ["file", "block"])
    after = F.struct("block", "at", "sub") > F.struct("head_block", "head_at", F.col("head_sub").cast("int").alias("sub"))
    cell = lambda k: F.coalesce(F.when(F.get("slots", F.lit(k)) >= 0, F.get("cells", F.get("slots", F.lit(k)))), F.lit(""))
    kept = parsed.where(after)
    if lead:  # in order by as many tasks as a shuffle has, however short the files are
        order = ("file", "block", "at", "sub")
        kept = kept.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    out = kept.select(*[(js.trim(cell(k)) if lead else cell(k)).alias(n) for k, n in enumerate(names)])
    if profile == "registry":
        return out
    return out.where(F.concat(*[F.col(f"`{n.replace('`', '``')}`") for n in names]) != "")
