"""The Merkle manifest against a plain tree, and its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from sparkquarry.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, digest string, `a.b` int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(digests):
    """The root, and for each leaf the siblings left and right of its branch, from the leaf up."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k - k % 8
            paths[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 8])))
            at[i] = k // 8
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows):
    def leaf(doc_id, source, lang, n_chars, text):
        told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        return h(*map(told, (doc_id, source, lang, n_chars, text)))

    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(*row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([r[2] for r in sorted(groups[g], key=lambda r: r[:3])]) for g in order}
    if not trees:
        return []
    root, tops = plain_tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        subroot, paths = trees[g]
        for (_, _, own, row), path in zip(sorted(groups[g], key=lambda r: r[:3]), paths):
            whole = path + top
            found = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                found = leaf(*row[:4], row[4] and row[4].translate(lower))
            for left, right in whole:
                found = h(left, found, right)
            out.append((row[0], own, subroot, root, h(*[a + b for a, b in whole]), found, found == root))
    return out


def some_rows():
    rng = random.Random(8)
    langs = [None, "", "de", "en", "ä", "\U0001f917", *[f"l{i}" for i in range(20)]]
    sizes = {None: 9, "": 1, "de": 700, "en": 65, "ä": 8, "\U0001f917": 2}
    rows = []
    for lang in langs:
        for _ in range(sizes.get(lang, 1)):
            text = rng.choice([None, "", "Ab", "ab", "ÄB ss", "x" * 300, f"T{rng.random()}"])
            rows.append((len(rows) * 3, rng.choice([None, "", "s"]), lang, rng.choice([None, 0, 12]), text))
    rows += [rows[3], rows[200], rows[200], (rows[200][0], "other", "de", 1, "T"), (None, None, None, None, None), (None, "s", "en", 1, "Big")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    def store(rows):
        path = str(tmp_path_factory.mktemp("docs"))
        spark.createDataFrame([(*r, "t", 1, "d", 2) for r in rows], SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
        return path

    return store


@pytest.mark.parametrize("rows", [some_rows(), [(4, "s", "en", 1, "One")], [(4, "s", "en", 1, "One"), (1, None, None, None, None)], []], ids=["many", "one", "two", "none"])
def test_manifest_as_by_plain_trees_and_by_sql(spark, stored, rows):
    path = stored(rows)
    found = merkle.op12_merkle_manifest(spark, path)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found.columns == columns
    expected = sorted(map(repr, plain_manifest(rows)))
    assert sorted(repr(tuple(r)) for r in found.collect()) == expected
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    assert sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({merkle.SQL})").fetchall())) == expected


@pytest.mark.parametrize("depth", [1, 2])
def test_blocks_of_any_size_give_the_same_proofs(spark, depth):
    rows = [(i, "en" if i % 5 else "de", h(str(i))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, lang string, leaf string")
    found = {r["id"]: r for r in merkle.merkle_manifest(df, "lang", "id", "leaf", depth=depth).collect()}
    trees = {g: plain_tree([leaf for _, lang, leaf in rows if lang == g]) for g in ("de", "en")}
    root, tops = plain_tree([trees["de"][0], trees["en"][0]])
    for g, top in zip(("de", "en"), tops):
        for (i, _, _), path in zip([r for r in rows if r[1] == g], trees[g][1]):
            assert [tuple(p) for p in found[i]["path"]] == path + top and found[i]["root"] == found[i]["folded_root"] == root
