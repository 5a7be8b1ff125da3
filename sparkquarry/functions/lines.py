"""Windows over the lines of one text, made inside its row: nothing is shuffled.

A text is split once and zipped with itself shifted, so the work grows with its lines, not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkquarry.functions import js


def lines(value: Column) -> Column:
    """A text's lines; null and empty texts have one empty line."""
    return F.split(F.coalesce(value, F.lit("")), "\n", -1)


def _shifted(values: Column, most: int, *more: Column) -> Column:
    """Every entry with the next ones up to `most` of them, null behind the end: fields `0`, `1`, ..."""
    ahead = [F.slice(values, k + 1, F.greatest(F.size(values) - k, F.lit(0))) for k in range(most)]
    return F.arrays_zip(*ahead, *more)


def line_spans(value: Column, most: int = 3, by: str = " ") -> Column:
    """(start, width, text) of 1 to `most` consecutive lines from every line, by start, then width."""
    return spans(lines(value), most, by)


def spans(rows: Column, most: int = 3, by: str = " ") -> Column:
    def from_here(z: Column, i: Column) -> Column:
        of = lambda w: F.struct(
            (i + 1).alias("start"), F.lit(w).alias("width"), F.concat_ws(by, *[z[str(k)] for k in range(w)]).alias("text")
        )
        return F.array_compact(F.array(*[F.when(z[str(w - 1)].isNotNull(), of(w)) for w in range(1, most + 1)]))

    return js.let(rows, lambda r: F.flatten(F.transform(_shifted(r, most), from_here)))


def lines_after(value: Column, heading, boundary, most: int = 8) -> Column:
    """(line, taken) of every heading line: how many of the next `most` lines precede a boundary."""
    rows = lines(value)
    ends, heads = F.transform(rows, lambda x: F.coalesce(boundary(x), F.lit(False))), F.transform(rows, lambda x: F.coalesce(heading(x), F.lit(False)))

    def after(z: Column, i: Column) -> Column:
        taken = F.lit(most)
        for k in range(most, 0, -1):
            taken = F.when(z[str(k)].isNull() | z[str(k)], k - 1).otherwise(taken)
        return F.when(z[str(most + 1)], F.struct((i + 1).alias("line"), taken.cast("int").alias("taken")))

    return js.let(ends, lambda e: F.array_compact(F.transform(_shifted(e, most + 1, heads), after)))
