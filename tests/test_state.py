"""The search cache over two runs, and the command queue as a stream against a walk."""

import random

from pyspark.sql import functions as F

from sparkquarry.sources import search_cache as cache
from sparkquarry.streaming import commands


def test_second_run_has_no_misses_and_old_entries_are_replaced(spark, tmp_path):
    path, day = str(tmp_path / "cache"), cache.DAY_MS
    queries = spark.createDataFrame([("a",), ("b",), ("b",), ("none",), (None,)], "query string")
    asked = []

    def search(tag):
        def run(missing):
            asked.append(sorted(r["query"] for r in missing.collect()))
            engines = F.explode(F.array(*[F.lit(e) for e in ("duckduckgo", "bing", "other")])).alias("engine")
            hits = missing.where("query <> 'none'").select("query", engines).select("*", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("pos"))
            url = F.when(F.col("pos") == 1, F.concat(F.lit("https://same.example/?"), "engine")).when(F.col("pos") == 2, "").otherwise(F.concat(F.lit("https://x.example/"), "engine", F.lit("/"), F.col("pos").cast("string")))
            return hits.select("query", "engine", "pos", F.lit(tag).alias("title"), url.alias("url"), F.col("engine").alias("snippet"))

        return run

    first = {r["query"]: r for r in cache.searched(queries, path, search("one"), 100 * day).collect()}
    assert asked[-1] == ["a", "b", "none"] and not any(r["cached"] for r in first.values()) and first["none"]["results"] == []
    urls = [(x["url"], x["snippet"]) for x in first["a"]["results"]]
    assert urls == [("https://same.example/?bing", "bing")] + [(f"https://x.example/{e}/{k}", e) for e in ("bing", "duckduckgo", "other") for k in (3, 4, 5, 6)][:11]
    second = cache.searched(queries, path, search("two"), 101 * day).collect()
    assert asked[-1] == [] and all(r["cached"] for r in second) and {r["query"]: r["results"] for r in second} == {q: r["results"] for q, r in first.items()}
    later = cache.searched(queries.union(spark.createDataFrame([("c",)], "query string")), path, search("three"), 107 * day).collect()
    assert asked[-1] == ["a", "b", "c", "none"] and {x["title"] for r in later for x in r["results"]} == {"three"}
    (tmp_path / "cache" / "write-broken").mkdir()
    (tmp_path / "cache" / "write-broken" / "part-0.parquet").write_bytes(b"half")
    before = sorted(map(repr, cache.entries(spark, path).collect()))
    assert len(before) == 4
    cache.compact(spark, path, 107 * day)
    assert sorted(map(repr, cache.entries(spark, path).collect())) == before
    assert cache.live(spark, path, 114 * day).count() == 0
    assert cache.entries(spark, str(tmp_path / "nowhere")).count() == 0


def test_stream_of_commands_equals_a_walk_through_all(spark, tmp_path):
    rng = random.Random(3)
    events = []
    for k in range(60):
        at, id_, target = k * 60 + rng.randint(0, 50), f"c{k}", f"t{k % 2}"
        events += [(target, "command", id_, rng.choice(["start", "stop", None]), at), (target, "command", f"c{max(0, k - 2 * rng.randint(0, 3))}", "again", at + 1)]
        events += [(target, "done", id_, None, at + rng.randint(1, 20 + 400 * j)) for j in range(4)] + [(target, "done", f"c{rng.randint(0, 60)}", None, at + 5)]
    events.sort(key=lambda e: e[4])
    want = []
    for target in ("t0", "t1"):
        state = commands.new_state()
        state["buffer"] = [[at * 1000, kind, id_, what] for t, kind, id_, what, at in events if t == target]
        want += [(target, *x) for x in commands.advance(state, 10**12, 24 * 3_600_000)]
    assert sum(w[3] == "done" for w in want) > 3 and len({(w[0], w[1]) for w in want if w[3] == "running"}) == sum(w[3] == "running" for w in want)
    # Events arrive up to five minutes late, some of them twice; the last ones let the watermark pass all others.
    arriving = sorted(events + rng.sample(events, 20), key=lambda e: e[4] + rng.randint(0, 300))
    schema = "target string, kind string, id string, command string, ts timestamp"

    def feed(rows, name):
        spark.createDataFrame(rows, "target string, kind string, id string, command string, s long").select("target", "kind", "id", "command", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = commands.command_states(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
        query.trigger(availableNow=True).start().awaitTermination(120)

    feed(arriving[:70], "a")
    run()
    feed(arriving[70:], "b")  # the second run starts from the first one's checkpoint
    run()
    feed([("t9", "command", "last", None, 10**6), ("t9", None, "x", None, 10**6)], "c")
    run()
    got = [(r["target"], r["id"], r["command"], r["status"], int(r["ms"])) for r in spark.read.parquet(str(tmp_path / "out")).withColumn("ms", F.unix_millis("at")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
