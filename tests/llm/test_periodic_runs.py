"""Runs against brute force."""

import hashlib
import random
import zlib

from sparkquarry.llm import periodic_runs as pr


def plain_runs(words, least=12):
    """Every stretch whose words equal those q further on, for each q in turn."""
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            part = words[start : start + length]
            if length >= max(least, 2 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.add((start, length, q))
            i = j
    return sorted(found)


def plain_collapse(words, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def samples():
    rng = random.Random(3)
    yield from ([], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 13 + ["b"] * 12, list("abcabcabcabc"), list("abcabcabcabcab") * 3, list("aabaabaabaab" * 2 + "aab"))
    for _ in range(300):
        yield rng.choices("ab", k=rng.randint(0, 60))
    for _ in range(300):
        part = rng.choices("abcd", k=rng.randint(1, 15))
        words = rng.choices("abcd", k=rng.randint(0, 20))
        for _ in range(rng.randint(1, 4)):
            words += part * rng.randint(1, 5) + part[: rng.randint(0, len(part))] + rng.choices("abcd", k=rng.randint(0, 5))
            part = rng.choice([part, rng.choices("abc", k=rng.randint(1, 12)), part * 2 + ["x"]])
        yield words
    words = ["a", "b"]
    for _ in range(11):
        words += words[-len(words) * 8 // 13 :]
        if len(words) > 400:
            break
    yield words
    a, b = ["b"], ["a"]
    while len(b) < 300:
        a, b = b, b + a
    yield b


def test_runs_as_by_brute_force():
    for words in samples():
        assert pr.document_runs(words) == plain_runs(words), words
        assert pr.collapsed(words, pr.document_runs(words)) == plain_collapse(words, plain_runs(words))


def test_factors_are_longest_earlier_ones():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.randint(0, 2) for _ in range(rng.randint(1, 50))]
        at = 0
        for start, length, earlier in pr.factors(s):
            assert start == at
            fits = [length_ for j in range(start) for length_ in range(1, len(s) - start + 1) if s[j : j + length_] == s[start : start + length_]]
            assert length == max(fits, default=1) and (earlier == -1) == (not fits)
            assert not fits or s[earlier : earlier + length] == s[start : start + length] and earlier < start
            at += length
        assert at == len(s)


def test_long_texts():
    rng = random.Random(5)
    word = [f"w{i}" for i in range(5000)]
    part = rng.choices(word, k=7000)
    words = rng.choices(word, k=3000) + part * 3 + rng.choices(word, k=4000) + part[:50] * 40
    found = pr.document_runs(words)
    assert [r[2] for r in found] == [7000, 50] and found[0][0] <= 3000 and found[0][1] >= 21000
    assert pr.document_runs(["x"] * 60000) == [(0, 60000, 1)]


SCHEMA = "doc_id long, text string, runs int, collapsed string, start string, `a.b` int"


def test_query_columns_of_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "one", "a " * 30, "x y z\n" * 8 + "end"] + [" ".join(rng.choices("ab", k=40)) for _ in range(40)]
    rows = [(i, t, 1, "c", "s", 2) for i, t in enumerate(texts)] + [(None, "a " * 20, 1, "c", "s", 2), (7, "b " * 20, 1, "c", "s", 2), (7, "b " * 20, 1, "c", "s", 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for doc_id, text, *_ in rows:
        words = (text or "").split()
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        told = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
        expected.append((doc_id, len(runs), start, length, period, length and 1000 * length // period, sha(told), sha(" ".join(plain_collapse(words, runs)))))
    found = pr.op13_periodic_runs(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert pr.op13_periodic_runs(spark, str(tmp_path)).count() == 0
