"""The split CSV reader against a serial one."""

import random

import pytest

from sparkquarry.sources.lenient_csv import csv_rows, header_name, read_csv


def serial(text, profile):
    """Records of one file, by a plain walk over its characters."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            else:
                quoted = not quoted
        elif quoted or c not in ",\r\n":
            cell += c
        elif c == ",":
            row, cell = [*row, cell], ""
        elif c == "\n" or (profile == "lead" and text[i + 1 : i + 2] != "\n"):
            rows.append([*row, cell])
            row, cell = [], ""
        i += 1
    if row or cell:
        rows.append([*row, cell])
    if profile == "lead":
        rows = [r for r in rows if any(x.strip() for x in r)]
    if not rows:
        return []
    name = header_name if profile == "lead" else lambda h, i: " ".join(h.split())
    names = [name(h, i + 1) for i, h in enumerate(rows[0])]
    out = []
    for r in rows[1:]:
        if profile == "research" and not any(r):
            continue
        record = {}
        for i, h in enumerate(names):
            value = r[i] if i < len(r) else ""
            record[h] = value.strip() if profile == "lead" else value
        out.append(record)
    if profile != "registry":
        out = [x for x in out if any(x.values())]
    return out


@pytest.fixture
def split_at(spark):
    """Splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def at(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 0)

    yield at
    for n, v in before.items():
        spark.conf.set(n, v)


EDGE = (
    'Name,,Name , "Other, one"\r\n'
    'plain,1,2,3\r\n\r\n'
    '"quoted, comma",a"b,c"d,"doubled "" quote"\n'
    '"embedded\r\nnew ""line""\n\n, and on",x\n'
    "short\n  \n,,,\n"
    'mid"cell"quote,"",z\n'
    + "".join(f'row {i},"line one of {i}\nline two, {i}\n",{i}\n' for i in range(30))
    + '"' + "a very long cell, " * 40 + "\n" * 30 + '",end\n'
)


@pytest.mark.parametrize(("profile", "size"), [("lead", 97), ("registry", 400), ("research", 1000), ("lead", 100_000)])
def test_edge_rows_in_splits_of_any_size(spark, tmp_path, split_at, profile, size):
    (tmp_path / "a.csv").write_bytes(EDGE.encode())
    split_at(size)
    rows = read_csv(spark, str(tmp_path / "a.csv"), profile)
    assert size > 1000 or rows.rdd.getNumPartitions() > 2
    expected = serial(EDGE, profile)
    assert set(rows.columns) == set(expected[0])
    assert sorted(map(repr, (r.asDict() for r in rows.select(*[f"`{c}`" for c in expected[0]]).collect()))) == sorted(map(repr, expected))


def test_random_files_with_headers_of_their_own(spark, tmp_path, split_at):
    rng = random.Random(9)
    split_at(61)
    expected = []
    for i in range(5):
        head = ",".join(rng.sample(["a", "b", "c", "d e"], 3))
        body = "".join(rng.choices(["x", "y ", ",", '"', '""', "\n", "\r\n", "ä"], [4, 2, 4, 2, 1, 3, 1, 1], k=rng.randint(0, 300)))
        text = rng.choice(["", "\n", "﻿"]) + f"{head}\n{body}\n"
        (tmp_path / f"{i}.csv").write_bytes(text.encode())
        expected += serial(text.removeprefix("﻿"), "lead")
    rows = read_csv(spark, str(tmp_path))
    names = ["a", "b", "c", "d_e"]
    assert sorted(rows.columns) == names
    assert sorted(map(tuple, rows.select(*names).collect())) == sorted(tuple(r.get(n, "") for n in names) for r in expected)


def test_rows_that_end_in_carriage_returns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'h,i\r1,"2\r3"\r\r4,5\r')
    assert sorted(map(tuple, read_csv(spark, str(tmp_path)).collect())) == [("1", "2\r3"), ("4", "5")]
    assert list(csv_rows("a\rb\r\nc", returns_end_rows=False)) == [["ab"], ["c"]]
    assert [tuple(r) for r in read_csv(spark, str(tmp_path), "registry").collect()] == []


def test_headers_beyond_the_first_split_and_files_without_any(spark, tmp_path, split_at):
    (tmp_path / "a.csv").write_text("\n" * 70 + "h,`i`\n1,2\n")
    (tmp_path / "b.csv").write_text("\n \n,\n")
    (tmp_path / "c.csv").write_text("")
    split_at(20)
    assert [r.asDict() for r in read_csv(spark, str(tmp_path)).collect()] == [{"h": "1", "i": "2"}]
    assert read_csv(spark, str(tmp_path / "b.csv")).columns == ["column_1"]


def test_f20_long_records_are_taken_apart_in_small_pieces():
    import pyarrow as pa

    from sparkquarry.sources.lenient_csv import _pieces

    texts = ["x" * k for k in (0, 40, 60, 250, 1, 99, 0, 1)]
    pieces = [p.column("text").to_pylist() for p in _pieces(pa.RecordBatch.from_pydict({"text": texts}), 100)]
    assert [[len(t) for t in p] for p in pieces] == [[0, 40, 60], [250], [1, 99, 0], [1]]
