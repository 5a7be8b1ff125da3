"""Runs (maximal periodic stretches) of words within documents, by Kolpakov and Kucherov's algorithm.

A document's words are factorised as Lempel and Ziv do, each factor being the longest prefix of
the rest that also starts earlier; a suffix automaton finds the factors. A run that starts before
a factor, or with it, and ends inside of it reaches back less than the factor's length and twice
that of the factor before, so Main's algorithm finds it from common prefixes and suffixes around
the factor's start. All other runs lie inside a factor and are copied from where it stood before.

The automaton only sees stretches that can hold a run. In a run of 12 words or more with a period
of half its length at most, each word lies in a sequence of six words that stands twice in the
run; so what isn't covered by sequences of six that repeat within their own stretch is left
out, again and again until nothing changes. No run is lost or cut by that, and hashes that are
equal by chance only keep more. Documents go through tasks one by one, whatever their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.shared import table
from sparkquarry.llm.words import ngrams, ranges

LEAST = 12  # words of a run
GRAM = LEAST // 2
SLICE = 4_000_000  # characters whose rows a task sends on at once


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start) of the Lempel-Ziv factors of `s`; a letter's first occurrence
    is a factor of its own with -1. An earlier occurrence may run into the factor itself.

    The suffix automaton keeps the end of each state's first occurrence.
    """
    step: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                clone = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    found, i, n = [], 0, len(s)
    while i < n:
        state, length, at = 0, 0, -1
        while i + length < n:
            state = step[state][s[i + length]]
            if first[state] - length >= i:  # it first stands here
                break
            at = first[state] - length
            length += 1
        found.append((i, max(length, 1), at))
        i += max(length, 1)
    return found


def prefixes(s: list[int]) -> list[int]:
    """For each place of `s`, how many letters from there on are as at its start."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def crossing(t: list[int], u: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, period), the end excluded, of the periodic stretches of t + u that hold the border
    of the two or touch it, as long as they get within t + u; multiples of periods included."""
    k, m = len(t), len(u)
    back = t[::-1]
    own, of_u = prefixes(u), prefixes([*u, -1, *t, *u])
    own_back, of_t = prefixes(back), prefixes([*back, -1, *u[::-1], *back])
    found = []
    for p in range(1, m + 1):  # a whole period stands right of the border
        before, after = of_t[k + 1 + m - p], own[p] if p < m else 0
        if before + after >= p and before + after + p >= LEAST:
            found.append((k - before, k + p + after, p))
    for p in range(1, k + 1):  # a whole period stands left of it
        before, after = own_back[p] if p < k else 0, of_u[m + 1 + k - p]
        if before + after >= p and before + after + p >= LEAST:
            found.append((k - p - before, k + min(after, m), p))
    return found


def runs(s: list[int]) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the runs of `s`, non-negative numbers, that have 12 letters or more."""
    s = [*s, -2]  # ends in a letter of its own, so that no run reaches the last factor's end
    n = len(s)
    cut_up = factors(s)
    found: dict[tuple[int, int], int] = {}
    starting: dict[int, list[int]] = {}

    def add(start: int, end: int, period: int) -> None:
        known = found.get((start, end))
        if known is None:
            starting.setdefault(start, []).append(end)
        if known is None or period < known:
            found[start, end] = period

    before = 0
    for start, length, _ in cut_up:
        reach = min(start, length + 2 * before)
        before = length
        if reach + length < LEAST:
            continue
        base = start - reach
        for a, b, p in crossing(s[base:start], s[start : start + length]):
            a, b = base + a, base + b
            # What goes on beyond these letters is found whole at another factor.
            if (a == 0 or s[a - 1] != s[a - 1 + p]) and (b == n or s[b] != s[b - p]):
                add(a, b, p)
    for start, length, at in cut_up:
        if length <= LEAST:
            continue
        shift, end = start - at, at + length
        for a in range(at + 1, end - LEAST):  # ascending: runs inside an overlap are copies already
            for b in starting.get(a, ()):
                if b < end:
                    add(a + shift, b + shift, found[a, b])
    return found


def stretches(s: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the parts of `s` outside of which no run has a letter."""
    todo, done = [(0, len(s))], []
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        grams = ngrams(s[a:b], GRAM)
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        again = np.zeros(len(grams), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        if not again.any():
            continue
        cover = np.zeros(b - a + 1, np.int64)
        at = np.flatnonzero(again)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + GRAM, -1)
        covered = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        parts = list(zip(edges[::2], edges[1::2]))
        if parts == [(0, b - a)]:
            done.append((a, b))
        else:
            todo += [(a + int(x), a + int(y)) for x, y in parts]
    return done


def document_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words, by start, then period."""
    if len(words) < LEAST:
        return []
    numbers: dict = {}
    s = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.uint64, len(words))
    found = []
    for a, b in stretches(s):
        found += [(a + x, y - x, p) for (x, y), p in runs(s[a:b].tolist()).items()]
    return sorted((x, length, p) for x, length, p in found)


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without what runs repeat: of a run its first period stays, unless another run drops it."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g] if found else words


def repeated(words: list, number: int) -> list:
    """For a tenth of documents, words that repeat from a place on; `number` is the crc32 of the doc_id."""
    n, g = len(words), number // 10
    if number % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *[words[i] for i in (a + ranges(np.zeros(1, np.int64), np.array([n - a])) % p).tolist()]]


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row's text; runs is an array of (start, length, period).

    Words are `[^\\x20\\x09-\\x0D]+`, compared as they are and counted from 0. A run is a stretch of
    at least 12 words, and of twice its smallest period, that no neighbouring word extends; runs
    stand by start, then period. `collapsed` has the words, joined by one space, that no run holds
    after its first period. With `planted`, a tenth of the documents, chosen by the crc32 of their
    id, first repeat their words from some place on.

    Defined cases: a null or empty text has no words, no runs and collapses to ""; a null doc_id
    is never planted; rows that repeat a doc_id are documents of their own; other columns, of
    whatever name, are left out. A text is searched whole, by one task.
    """
    kind = docs.schema["doc_id"].dataType
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("text"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                # On bytes, split() knows ASCII white space only.
                words = (text or "").encode("utf-8", "replace").split()
                if planted and doc_id is not None:
                    words = repeated(words, zlib.crc32(doc_id.encode()))
                found = document_runs(words)
                rows.append((doc_id, len(words), [{"start": a, "length": n, "period": p} for a, n, p in found], b" ".join(collapsed(words, found)).decode()))
                size += len(text or "")
                if size > SLICE or len(rows) >= 1000:
                    yield pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "collapsed"])
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "collapsed"])

    out = texts.mapInPandas(search, "doc_id string, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of every document, the longest of each, and digests of all runs and of the collapsed text."""
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), planted=True)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    told = F.array_join(F.transform("runs", line), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), told.alias("told"), "collapsed").select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), F.sha2("told", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
