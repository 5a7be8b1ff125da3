"""N-gram Jaccard self-join with adaptive multi-match prefixes.

1. Every document becomes its set of shingle hashes. Blocks of documents send each shingle,
   once a block, to the task that owns its range of hashes; that task counts documents and
   sends back which shingles several documents hold. Shingles that one document holds alone
   can't be shared, so a document of which less than the threshold is shared is done.
2. Shingles are ordered by document count (counts of 64 and more are equal), then by hash. A
   document with n shingles that must share t has a prefix of n - t + l shingles; two similar
   documents share at least l of theirs. Each document takes the l whose prefix it expects to
   be cheapest; a pair needs the smaller l of its two documents (as a longer prefix holds the
   shorter one), and only then is it verified.
3. Equal sets are one class from the start. Members of large groups of near copies are first
   compared with one hub for each prefix shingle; what these links haven't joined is compared
   in chunks, as matrices, so that no group is expanded into its pairs.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquarry.llm.components import components, spanning_edges
from sparkquarry.llm.shared import cut, free, give_back, numbered, table, with_safe_names
from sparkquarry.llm.words import pack, pack_sorted, ranges, shingles, unpack, unpack_sorted, word_hashes

BLOCK = 1_500_000  # shingles in a block of documents, and about as many in a range of hashes
BITS = 48  # of a shingle's hash
COMMON = 64  # documents of one block, or of all, from which on a shingle counts as common
CELL, HEAVY, DOCS = 0, 1, 2
CHUNK = 512  # documents compared at once
MAX_MATCHES = 8
VERIFY_COST = 0.02  # of comparing a shingle in verification, against reading a posting

_SENT = "kind int, key int, block long, tokens binary, counts binary, owners binary, extra binary"
_NAMES = [part.split()[0] for part in _SENT.split(", ")]


def _blocks(batches: Iterator[pd.DataFrame], n: int, buckets: int) -> Iterator[pd.DataFrame]:
    """What a task sends: cells of shingles by range of hashes, common shingles, and its documents."""
    shift = np.uint64(BITS - buckets.bit_length() + 1)
    seq, held = 0, 0
    docs: list[tuple[int, int, int, int]] = []
    sets: dict[tuple[int, int, int], tuple[int, np.ndarray]] = {}

    def flush() -> pd.DataFrame:
        block = (TaskContext.get().partitionId() << 32) | seq
        rows = [(DOCS, block % buckets, block, *(np.array([d[i] for d in docs], np.uint64).tobytes() for i in range(4)))]
        if sets:
            owner_ids = np.array([d for d, _ in sets.values()], np.uint64)
            sizes = [len(s) for _, s in sets.values()]
            tokens = np.concatenate([s for _, s in sets.values()])
            owners = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            first = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
            counts = np.diff(np.append(first, len(tokens)))
            unique, common = tokens[first], counts >= COMMON
            rows.append((HEAVY, block % buckets, block, pack_sorted(unique[common]), pack(counts[common]), pack(owners[ranges(first[common], counts[common])]), owner_ids.tobytes()))
            edges = np.searchsorted(unique >> shift, np.arange(buckets + 1))
            for key in range(buckets):
                part = slice(edges[key], edges[key + 1])
                if part.start == part.stop:
                    continue
                light = ~common[part]
                own = owners[ranges(first[part][light], counts[part][light])]
                rows.append((CELL, key, block, pack_sorted(unique[part]), pack(counts[part]), pack(own), b""))
        return pd.DataFrame(rows, columns=_NAMES)

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            full = np.unique(shingles(word_hashes(text), n))
            size = len(full)
            with np.errstate(over="ignore"):
                one, two = int(full.sum()), int((full * (full >> np.uint64(7) | np.uint64(1))).sum())
            doc_id = int(doc_id)
            docs.append((doc_id, size, one, two))
            if size and (size, one, two) in sets:
                least, tokens = sets[size, one, two]
                sets[size, one, two] = (min(least, doc_id), tokens)
            elif size:
                sets[size, one, two] = (doc_id, np.unique(full >> np.uint64(64 - BITS)))
                held += size
            if held >= BLOCK or len(docs) >= 50_000:
                yield flush()
                seq, held, docs, sets = seq + 1, 0, [], {}
    if docs:
        yield flush()
    sets.clear()
    give_back()


def _shared(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """Of one range of hashes: the shingles of each block that several documents hold, with their counts."""
    if key[0] != CELL:
        return cells
    tokens = [unpack_sorted(t) for t in cells["tokens"]]
    counts = [unpack(c).astype(np.int64) for c in cells["counts"]]
    every = np.concatenate(tokens)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
    sums = np.add.reduceat(np.concatenate(counts)[order], first)
    total = np.empty(len(every), np.int64)
    total[order] = np.repeat(np.minimum(sums, COMMON), np.diff(np.append(first, len(every))))
    rows, at = [], 0
    for i, block in enumerate(cells["block"]):
        dfs, count = total[at : at + len(tokens[i])], counts[i]
        at += len(tokens[i])
        owners = unpack(cells["owners"].iloc[i])
        light = count < COMMON
        begin = np.cumsum(np.where(light, count, 0)) - np.where(light, count, 0)
        keep = light & (dfs > 1)
        if keep.any():
            own = owners[ranges(begin[keep], count[keep])]
            rows.append((CELL, key[1], block, pack_sorted(tokens[i][keep]), pack(count[keep]), pack(own), pack(dfs[keep])))
    return pd.DataFrame(rows, columns=_NAMES)


def _prefix(size: int, dfs: np.ndarray, share: float, spare: int) -> tuple[int, int]:
    """(l, length of the prefix among the shared shingles, in order) that seems cheapest."""
    need = math.ceil(share * size - 1e-9)  # shingles that any similar document must share
    costs, reach = np.cumsum(dfs), []
    for matches in range(1, MAX_MATCHES + 1):
        length = max(0, size - need + matches - spare)
        if length > len(dfs) or matches > need:
            break
        scanned = float(costs[length - 1]) if length else 0.0
        reach.append((scanned + VERIFY_COST * size * scanned / matches, matches, length))
    if not reach:
        return 1, min(len(dfs), max(0, size - need + 1 - spare))
    _, matches, length = min(reach)
    return matches, length


def _profiles(key: tuple, parts: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of one block: every document with its size, its set's two hashes and, if it may have a
    similar one, its prefix and all its shared shingles."""
    docs = parts[parts["kind"] == DOCS].iloc[0]
    doc_ids, sizes = np.frombuffer(docs["tokens"], np.uint64).astype(np.int64), np.frombuffer(docs["counts"], np.uint64).astype(np.int64)
    one, two = (np.frombuffer(docs[c], np.int64) for c in ("owners", "extra"))
    found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    heavy = parts[parts["kind"] == HEAVY]
    if len(heavy):
        owner_ids = np.frombuffer(heavy.iloc[0]["extra"], np.uint64).astype(np.int64)
        tokens, owners, dfs = [], [], []
        for _, row in parts[parts["kind"] != DOCS].iterrows():
            unique, count = unpack_sorted(row["tokens"]) if len(row["tokens"]) > 1 else np.zeros(0, np.uint64), unpack(row["counts"]).astype(np.int64)
            df = np.full(len(unique), COMMON) if row["kind"] == HEAVY else unpack(row["extra"]).astype(np.int64)
            tokens.append(np.repeat(unique, count))
            dfs.append(np.repeat(df, count))
            owners.append(unpack(row["owners"]).astype(np.int64))
        tokens, owners, dfs = map(np.concatenate, (tokens, owners, dfs))
        order = np.lexsort((tokens, dfs, owners))
        tokens, owners, dfs = tokens[order], owners[order], dfs[order]
        edges = np.searchsorted(owners, np.arange(len(owner_ids) + 1))
        size_of = dict(zip(doc_ids.tolist(), sizes.tolist()))
        for i, doc_id in enumerate(owner_ids.tolist()):
            part, size = slice(edges[i], edges[i + 1]), size_of[doc_id]
            held = part.stop - part.start
            # Hashes cut to 48 bits may fall together in very long documents; one is allowed for.
            if held + 1 >= threshold * size:
                found[doc_id] = (*_prefix(size, dfs[part], threshold, size - held), tokens[part])
    rows = []
    for doc_id, size, a, b in zip(doc_ids.tolist(), sizes.tolist(), one.tolist(), two.tolist()):
        matches, length, tokens = found.get(doc_id, (None, 0, None))
        rows.append((doc_id, size, a, b, matches, None if tokens is None else tokens[:length].astype(np.int64), None if tokens is None else np.sort(tokens).tobytes()))
    return pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set1", "set2", "matches", "prefix", "tokens"]).astype({"matches": "Int64"})


def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many hashes the two sorted sets share."""
    count = lambda x, y: len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
    return pd.Series([count(x, y) for x, y in zip(a, b)], dtype="int64")


def _verified(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    side = lambda p: profiles.select(F.col("doc_id").alias(f"_{p}"), F.col("n_shingles").alias(f"_n{p}"), F.col("tokens").alias(f"_t{p}"))
    both = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    both = both.where(F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * percent)
    shared = both.select("a", "b", "_na", "_nb", F.pandas_udf(_overlap, T.LongType())("_ta", "_tb").alias("_both"))
    return shared.where(F.col("_both") * 100 >= (F.col("_na") + F.col("_nb") - F.col("_both")) * percent).select("a", "b")


def _matches(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many numbers each set of `a` shares with each set of `b`."""
    found = np.zeros((len(a), len(b)), np.float32)
    own_a, own_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    all_a, all_b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
    both = np.intersect1d(all_a, all_b)
    if not len(both):
        return found
    at_a, at_b = np.searchsorted(both, all_a), np.searchsorted(both, all_b)
    in_a = both[np.minimum(at_a, len(both) - 1)] == all_a
    in_b = both[np.minimum(at_b, len(both) - 1)] == all_b
    own_a, at_a, own_b, at_b = own_a[in_a], at_a[in_a], own_b[in_b], at_b[in_b]
    for low in range(0, len(both), 4096):
        part_a, part_b = (at_a >= low) & (at_a < low + 4096), (at_b >= low) & (at_b < low + 4096)
        wide = min(4096, len(both) - low)
        x, y = np.zeros((len(a), wide), np.float32), np.zeros((len(b), wide), np.float32)
        x[own_a[part_a], at_a[part_a] - low] = 1
        y[own_b[part_b], at_b[part_b] - low] = 1
        found += x @ y.T
    return found


def _compare(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges that join the linked documents of two chunks which have different labels."""
    a, b = pickle.loads(left.iloc[0]["docs"]), pickle.loads(right.iloc[0]["_docs"])
    columns = lambda docs, name: np.array([d[name] for d in docs], np.int64)
    ids_a, ids_b = columns(a, "doc_id"), columns(b, "doc_id")
    n_a, n_b = columns(a, "n_shingles"), columns(b, "n_shingles")
    near = columns(a, "label")[:, None] != columns(b, "label")
    near &= np.minimum(n_a[:, None], n_b) * 100 >= np.maximum(n_a[:, None], n_b) * percent
    needed = np.minimum(columns(a, "matches")[:, None], columns(b, "matches"))
    near &= _matches([np.sort(d["prefix"]) for d in a], [np.sort(d["prefix"]) for d in b]) >= needed
    rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(rows):
        return pd.DataFrame({"a": [], "b": []})
    tokens = lambda docs, which: [np.frombuffer(docs[i]["tokens"], np.uint64) for i in which]
    shared = _matches(tokens(a, rows), tokens(b, cols)).astype(np.int64)
    enough = shared * 100 >= (n_a[rows][:, None] + n_b[cols] - shared) * percent
    one, two = np.nonzero(enough & near[np.ix_(rows, cols)])
    if not len(one):
        return pd.DataFrame({"a": [], "b": []})
    x, y = spanning_edges(ids_a[rows], ids_b[cols], one, two)
    return pd.DataFrame({"a": x, "b": y})


def _between(live: DataFrame, postings: DataFrame, hubs: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Edges between documents that the hubs haven't joined, but that share prefix shingles.

    Documents stand in chunks of bounded size, with those that share their hub. Chunks that
    share a shingle are compared as matrices (shared prefix shingles first, all shingles
    then), unless both lie in one component; no pair of documents becomes a row.
    """
    made: list[DataFrame] = []

    def part(df: DataFrame, name: str) -> DataFrame:
        made.append(cut(df, name))
        return made[-1]

    known = postings.join(labels, F.col("doc_id") == F.col("node"), "left").select("token", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    known = part(known, "jaccard-postings")
    open_ = known.groupBy("token").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).where("_l < _m").select(F.col("token").alias("_open"))
    hub_of = hubs.join(part(open_, "jaccard-open"), F.col("_token") == F.col("_open"), "left_semi")
    hub_of = hub_of.join(labels, F.col("hub") == F.col("node"), "left").select("_token", F.coalesce("label", "hub").alias("_home"))
    open_postings = part(known.join(part(hub_of, "jaccard-homes"), F.col("token") == F.col("_token")).select("token", "doc_id", "label", "_home"), "jaccard-open")
    homes = open_postings.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("_home").alias("home"))
    homes = part(homes.withColumn("whole", F.col("label") == F.col("home")), "jaccard-homes")
    sizes = homes.groupBy(F.col("home").alias("_home"), F.col("whole").alias("_whole")).agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("_chunks"))
    same = (F.col("home") == F.col("_home")) & (F.col("whole") == F.col("_whole"))
    salt = F.pmod(F.xxhash64("doc_id"), "_chunks").cast("string")
    name = F.concat_ws("/", F.col("home").cast("string"), F.col("whole").cast("string"), salt)
    placed = homes.join(part(sizes, "jaccard-sizes"), same).select(
        F.col("doc_id").alias("_doc"), F.col("label").alias("_label"), name.alias("chunk"), F.when(F.col("whole"), F.col("home")).alias("single")
    )
    placed = part(placed, "jaccard-placed")

    def stack(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], pickle.dumps(docs.drop(columns="chunk").to_dict("records"), protocol=5))], columns=["chunk", "docs"])

    members = live.join(placed, F.col("doc_id") == F.col("_doc")).select("chunk", "doc_id", "n_shingles", "matches", F.col("_label").alias("label"), "prefix", "tokens")
    chunks = part(members.groupBy("chunk").applyInPandas(stack, "chunk string, docs binary"), "jaccard-chunks")
    holds = open_postings.join(placed, F.col("doc_id") == F.col("_doc")).select("token", "chunk", "single").distinct()
    holds = part(holds, "jaccard-holds")
    other = holds.select(*[F.col(c).alias(f"_{c}") for c in holds.columns])
    apart = F.coalesce(F.col("single") != F.col("_single"), F.lit(True))
    pairs = holds.join(other, (F.col("token") == F.col("_token")) & (F.col("chunk") <= F.col("_chunk")) & apart)
    pairs = part(pairs.select(F.col("chunk").alias("a"), F.col("_chunk").alias("b")).distinct(), "jaccard-pairs")
    left = pairs.join(chunks, F.col("a") == F.col("chunk")).select("a", "b", "docs")
    right = pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b")).join(chunks, F.col("_b") == F.col("chunk")).select("_a", "_b", F.col("docs").alias("_docs"))
    edges = left.groupBy("a", "b").cogroup(right.groupBy("_a", "_b")).applyInPandas(lambda x, y: _compare(x, y, percent), "a long, b long")
    edges = cut(edges, "jaccard-edges")
    free(*made)
    return edges


def _components_of_rows(source: DataFrame, shingle: int, percent: int) -> DataFrame:
    """As jaccard_components, of `source` (doc_id, text) without null or repeated doc_id."""
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1 << max(4, math.ceil(math.log2(chars / 6 / BLOCK + 1)))
    sent = source.mapInPandas(lambda batches: _blocks(batches, shingle, buckets), _SENT)
    shared = sent.groupBy("kind", "key").applyInPandas(_shared, _SENT)
    schema = "doc_id long, n_shingles long, set1 long, set2 long, matches int, prefix array<long>, tokens binary"
    share = percent / 100
    profiles = cut(shared.groupBy("block").applyInPandas(lambda key, parts: _profiles(key, parts, share), schema), "jaccard-profiles")

    sets = cut(profiles.where("n_shingles > 0").groupBy("n_shingles", "set1", "set2").agg(F.min("doc_id").alias("class_id")), "jaccard-classes")
    chosen = sets.select(F.col("class_id").alias("_class"))
    live = profiles.where("tokens IS NOT NULL").join(chosen, F.col("doc_id") == F.col("_class"), "left_semi")
    live = cut(live.dropDuplicates(["doc_id"]), "jaccard-live")

    postings = live.select("doc_id", "n_shingles", "matches", F.explode("prefix").alias("token"))
    hubs = cut(postings.groupBy("token").agg(F.min("doc_id").alias("hub"), F.count("*").alias("_n")).where("_n > 1").select(F.col("token").alias("_token"), "hub"), "jaccard-hubs")
    star = postings.join(hubs, F.col("token") == F.col("_token")).where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    star = cut(_verified(star, live, percent), "jaccard-star")
    labels = components(star)

    between = _between(live, postings, hubs, labels, percent)
    free(labels, hubs, live)
    labels = components(star.unionByName(between))
    free(star, between)

    named = sets.join(labels, F.col("class_id") == F.col("node"), "left").select(
        "n_shingles", "set1", "set2", F.coalesce("label", "class_id").alias("component")
    )
    named = cut(named.select(*[F.col(c).alias(f"_{c}") for c in named.columns]), "jaccard-named")
    slim = profiles.select("doc_id", "n_shingles", "set1", "set2")
    joined = slim.join(named, [F.col(c) == F.col(f"_{c}") for c in ("n_shingles", "set1", "set2")], "left")
    found = cut(joined.select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id")), "jaccard-found")
    free(labels, sets, named, profiles)
    return found


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Documents link when 100 * |shared shingles| >= percent * |all their shingles| (sets of
    hashes of `shingle` neighbouring words, A-Z lower-cased, whole texts). component_id is the
    smallest doc_id that links lead to. A document of fewer words is one shingle; null, empty
    and blank texts have none and link with nothing. Rows without doc_id are left out. Rows
    that repeat a doc_id are all returned and link each by its own text, so they share a
    component only if links join them. Other columns are ignored.
    """
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), "text")
    rows = cut(known.withColumn("_row", F.monotonically_increasing_id()), "jaccard-rows")
    parts = _components_of_rows(rows.select(F.col("_row").alias("doc_id"), "text"), shingle, percent)
    found = parts.join(rows.select("_row", "_id"), F.col("doc_id") == F.col("_row"))
    found = cut(found.select("_id", "n_shingles", F.col("component_id").alias("_group")), "jaccard-groups")
    free(parts, rows)
    least = found.groupBy(F.col("_group").alias("_of")).agg(F.min("_id").alias("component_id"))
    joined = found.join(least, F.col("_group") == F.col("_of"))
    return joined.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest doc_id.

    Rows are judged each by its own text. Rows without doc_id come after all others: they stay
    unless their group has a document with an id, and of a group without any id one row stays;
    so does one of rows that are near duplicates under the smallest id.
    """

    def distinct(own: DataFrame) -> DataFrame:
        rows = numbered(own, "row")
        parts = _components_of_rows(rows.select(F.col("row").alias("doc_id"), "text"), 5, 80)
        ids = rows.select(F.col("row").alias("_at"), "doc_id")
        found = parts.select(F.col("doc_id").alias("_row"), "component_id").join(ids, F.col("_row") == F.col("_at"))
        first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))).getField("_row")
        kept = cut(found.groupBy("component_id").agg(first.alias("_kept")).select("_kept"), "jaccard-kept")
        free(parts)
        return rows.join(kept, F.col("row") == F.col("_kept"), "left_semi").drop("row")

    return with_safe_names(distinct, docs, "doc_id", "text")
