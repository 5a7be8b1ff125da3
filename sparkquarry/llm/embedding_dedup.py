"""Embedding near-dedup over an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the pairs of codewords form a grid
of cells. A vector visits the cells nearest to it, in the order of their distance
(multi-sequence traversal), as many as the target recall asks for; then the vectors of the
visited cells are compared exactly. How many these are is found beforehand, with pairs made
for the purpose: vectors of the sample and copies of them turned away as far as the threshold
allows, the hardest links there can be. Cells are cut into chunks of bounded size, and pairs
of chunks are compared as matrices, so that a crowded cell becomes more tasks and no pair of
vectors becomes a row.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.components import components, spanning_edges
from sparkquarry.llm.shared import cut, free, table

#: Codebooks are fitted on so many distinct vectors at most, those with the smallest hashes.
SAMPLE = 8192
CHUNK, VISITORS = 512, 4096  # vectors of a cell, and visitors of these, that are compared at once
PER_CELL = 100  # vectors of a label that a cell should hold


def _unit(raw: bytes) -> np.ndarray:
    v = np.frombuffer(raw, np.float64)
    return v / np.linalg.norm(v)


def _scaled(raws) -> np.ndarray:
    m = np.stack([np.frombuffer(r, np.float64) for r in raws])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        for i in np.unique(nearest):
            centres[i] = x[nearest == i].mean(0)
    return centres


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The squared distance of x from each codeword."""
    return ((centres - x) ** 2).sum(1)


def multi_sequence(first: np.ndarray, second: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The `count` cells (i, j) with the smallest first[i] + second[j], the smallest sum first."""
    a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
    queue, visited, seen = [(float(first[a[0]] + second[b[0]]), 0, 0)], [], {(0, 0)}
    while queue and len(visited) < count:
        _, i, j = heapq.heappop(queue)
        visited.append((int(a[i]), int(b[j])))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(queue, (float(first[a[p]] + second[b[q]]), p, q))
    return visited


def _fit(sample: list[bytes], cells_wanted: float) -> tuple[np.ndarray, np.ndarray]:
    x = _scaled(sample)
    half = max(1, x.shape[1] // 2)
    k = int(min(256, len(x), max(2, math.ceil(math.sqrt(cells_wanted)))))
    return _kmeans(x[:, :half], k), _kmeans(x[:, half:], k) if x.shape[1] > 1 else np.zeros((1, 0))


def _visits(sample: list[bytes], books, threshold: float, target: float, pairs: int = 1000) -> int:
    """How many cells a vector must visit for `target` of the links at the threshold itself to be found.

    A link is found when either vector visits the other's cell; both have the same count.
    """
    one, two = books
    if target >= 1:
        return len(one) * len(two)
    x = _scaled(sample[:pairs])
    make = np.random.default_rng(0)
    turn = make.normal(size=x.shape)
    turn -= (turn * x).sum(1, keepdims=True) * x
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * turn
    half = one.shape[1]

    def grid(v: np.ndarray) -> np.ndarray:
        return (_apart(v[:half], one)[:, None] + _apart(v[half:], two)).ravel()

    ranks = []
    for v, w in zip(x, y):
        a, b = grid(v), grid(w)
        ranks.append(min((a < a[b.argmin()]).sum(), (b < b[a.argmin()]).sum()))
    return int(np.quantile(ranks, target, method="higher")) + 1


def _compare(members: pd.DataFrame, visitors: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """A chunk of a cell and vectors that visit it: the links of each, and edges that join linked classes.

    Of two vectors that visit each other's cell, one counts as the visitor.
    """
    if not len(members) or not len(visitors):
        return pd.DataFrame({"id": [], "n": [], "other": [], "edge": []})
    ids_a, ids_b = visitors["_id"].to_numpy(), members["id"].to_numpy()
    x, y = _scaled(visitors["_v"]), _scaled(members["v"])
    links = x @ y.T >= threshold
    rows, cols = np.nonzero(links)
    home, cell = visitors["_home"].to_numpy()[rows], members["home"].to_numpy()[cols]
    visits = np.stack(members["visits"].to_numpy())[cols]
    mutual = (visits == home[:, None]).any(1)
    count = np.where(home == cell, ids_a[rows] < ids_b[cols], ~mutual | (home < cell))
    rows, cols = rows[count], cols[count]
    if not len(rows):
        return pd.DataFrame({"id": [], "n": [], "other": [], "edge": []})
    of_a = np.bincount(rows, members["size"].to_numpy()[cols], len(ids_a)).astype(np.int64)
    of_b = np.bincount(cols, visitors["_size"].to_numpy()[rows], len(ids_b)).astype(np.int64)
    one, two = spanning_edges(ids_a, ids_b, rows, cols)
    return pd.concat([
        *[pd.DataFrame({"id": ids[n > 0], "n": n[n > 0], "other": -1, "edge": False}) for ids, n in ((ids_a, of_a), (ids_b, of_b))],
        pd.DataFrame({"id": one, "n": 0, "other": two, "edge": True}),
    ])


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, target_recall: float = 0.99, per_cell: int = PER_CELL) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `vectors` (vec_id, embedding, label).

    Two vectors link when their labels are equal and not null and their cosine, in double
    precision, is `threshold` or more. n_links counts the other vectors linked directly,
    component_id is the smallest vec_id that links lead to, kept tells whether that is the
    vector's own. Vectors that are null, empty, zero or hold a null or non-finite component,
    that have no label or no vec_id, or that differ in length link with nothing. Equal vectors
    of one label are one class and link with each other; rows that repeat a vec_id count each.
    Other columns are ignored.

    The codebooks are fitted on `SAMPLE` distinct vectors of the most frequent length; every
    vector is indexed. `target_recall` is the share of links of exactly the threshold that the
    visited cells hold; closer ones are found more often. With 1 all cells are visited and
    every link is found, in quadratic time.
    """
    spark = vectors.sparkSession
    numbers = F.transform("embedding", lambda v: v.cast("double"))
    broken = F.exists(numbers, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~broken & F.exists(numbers, lambda v: v != 0), F.lit(False)
    )
    rows = vectors.select("vec_id", "label", fine.alias("fine"), numbers.alias("v"))
    rows = rows.select("vec_id", "label", "fine", F.when(F.col("fine"), F.col("v")).alias("v"))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))
    key = ["label", "h1", "h2"]

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(v=[np.asarray(v, np.float64).tobytes() for v in batch["v"]])

    classes = rows.where("fine").groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("v").alias("v"))
    classes = classes.mapInPandas(raw, "label long, h1 long, h2 long, id long, size long, v binary")
    classes = cut(classes.withColumn("dims", F.length("v")), "classes")
    usual = classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if usual is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    distinct = classes.agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).first()
    sample = [r["v"] for r in classes.where(F.col("dims") == usual["dims"]).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    books = _fit(sample, distinct["n"] / distinct["labels"] / per_cell)
    count = _visits(sample, books, threshold, target_recall)
    sent = spark.sparkContext.broadcast((books, count))  # at most 2 x 256 codewords

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (one, two), most = sent.value
        half, width = one.shape[1], len(two)
        for batch in batches:
            cells, visits = [], []
            for v in batch["v"]:
                x = _unit(v)
                if len(x) != half + two.shape[1]:
                    cells.append(-len(x))  # all vectors of another length share a cell
                    visits.append([-len(x)])
                    continue
                seen = multi_sequence(_apart(x[:half], one), _apart(x[half:], two), most)
                visits.append([i * width + j for i, j in seen])
                cells.append(visits[-1][0])
            yield pd.DataFrame({"label": batch["label"], "id": batch["id"], "size": batch["size"], "v": batch["v"], "cell": cells, "visits": visits})

    placed = cut(classes.select("label", "id", "size", "v").mapInPandas(place, "label long, id long, size long, v binary, cell int, visits array<int>"), "placed")
    held = placed.groupBy("label", "cell").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("wanted"))
    asked = placed.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("wanted"))
    sizes = held.unionByName(asked).groupBy(F.col("label").alias("_label"), F.col("cell").alias("_cell")).agg(F.sum("n").alias("n"), F.sum("wanted").alias("wanted")).where("n > 0")
    counts = cut(sizes.select("_label", "_cell", F.ceil(F.col("n") / CHUNK).alias("_chunks"), F.ceil(F.col("wanted") / VISITORS).alias("_parts")), "cells")

    def grouped(rows: DataFrame, chunk, part) -> DataFrame:
        """With the group (label, cell, chunk of its members, part of its visitors) that each row goes to."""
        met = rows.join(counts, (F.col("label") == F.col("_label")) & (F.col("cell") == F.col("_cell")))
        met = met.withColumn("chunk", chunk).withColumn("part", part)
        return met.withColumn("name", F.concat_ws("/", *[F.col(c).cast("string") for c in ("label", "cell", "chunk", "part")]))

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n)
    members = grouped(placed, own("_chunks"), every("_parts")).select("name", "id", "size", "v", F.col("cell").alias("home"), "visits")
    visiting = placed.select("label", "id", "size", "v", F.col("cell").alias("home"), F.explode("visits").alias("cell"))
    visitors = grouped(visiting, every("_chunks"), own("_parts")).select(F.col("name").alias("_name"), *[F.col(c).alias(f"_{c}") for c in ("id", "size", "v", "home")])
    compared = members.groupBy("name").cogroup(visitors.groupBy("_name")).applyInPandas(lambda x, y: _compare(x, y, threshold), "id long, n long, other long, edge boolean")
    compared = cut(compared, "compared")
    labels = components(compared.where("edge").select(F.col("id").alias("a"), F.col("other").alias("b")))
    free(placed, counts)
    degree = compared.where("NOT edge").groupBy("id").agg(F.sum("n").alias("n"))
    named = classes.join(degree.withColumnRenamed("id", "_d"), F.col("id") == F.col("_d"), "left").join(labels, F.col("id") == F.col("node"), "left")
    named = cut(named.select(
        *[classes[c].alias(f"_{c}") for c in key], (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("_links"), F.coalesce(labels["label"], classes["id"]).alias("_component")
    ), "named")
    free(classes, compared, labels)
    out = rows.join(named, F.col("fine") & (F.col("label") == F.col("_label")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
