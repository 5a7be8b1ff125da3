"""Line dedup: every line that several documents hold stays in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.shared import BLANKS, ascii_lower, cut, table, with_safe_names

#: Lines that make up more than one in so many of all are marked without a shuffle; there can't be more of them than that.
HOT_SHARE = 4096


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines that at least `min_docs` documents hold from all but the smallest doc_id.

    Lines are exploded, normalised (blanks stripped at both ends, A-Z lower-cased) and
    hashed to 128 bits; documents are counted per hash, and what stays of a text is put
    together again by position. Keys shorter than `min_chars` code points always stay.
    Very common lines are marked where they are, by a broadcast table of `HOT_SHARE` rows
    at most, so that none of them fills a task of the join.

    Returns the columns of `docs` with `text` rewritten, plus n_lines and n_dropped.
    Defined cases: a null or empty text is one empty line (and becomes ""); rows without
    doc_id neither count nor lose lines; rows that repeat a doc_id count as one document,
    which keeps its own repeated lines. Other columns, of whatever name, pass through
    (n_lines and n_dropped of the input are replaced).
    """
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    own = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in [*others, "text"]])
    safe = [c if c == "doc_id" else f"other_{i}" for i, c in enumerate(others)]
    return _without_lines(own.toDF(*safe, "text"), safe, min_chars, min_docs).toDF(*others, "text", "n_lines", "n_dropped")


def _without_lines(docs: DataFrame, others: list[str], min_chars: int, min_docs: int) -> DataFrame:
    """See `dedup_lines`; the columns of `docs` are `others`, of safe names, and text."""
    # Equal (doc_id, text) rows have equal line positions, so this pair identifies a text.
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    exploded = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_doc"), text_hash.alias("_text"), F.posexplode(_lines(F.col("text"))).alias("_pos", "_line")
    )
    key = ascii_lower(F.btrim("_line", F.lit(BLANKS)))
    hashed = (
        exploded.select("_doc", "_text", "_pos", key.alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_doc", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    )
    if min_docs <= 2:  # two documents hold a key when its smallest and largest doc_id differ
        held = hashed.groupBy("_h1", "_h2").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last"), F.count("*").alias("_lines")).where("_first < _last")
    else:
        held = (
            hashed.groupBy("_h1", "_h2", "_doc").agg(F.count("*").alias("_own"))
            .groupBy("_h1", "_h2").agg(F.min("_doc").alias("_first"), F.count("*").alias("_n"), F.sum("_own").alias("_lines")).where(F.col("_n") >= min_docs)
        )
    shared = cut(held.select("_h1", "_h2", "_first", "_lines"), "shared-lines")
    least = max(1000, (shared.agg(F.sum("_lines")).first()[0] or 0) // HOT_SHARE)
    hot = shared.where(F.col("_lines") > least).select("_h1", "_h2", F.col("_first").alias("_hot"))
    rest = shared.where(F.col("_lines") <= least).select(F.col("_h1").alias("_r1"), F.col("_h2").alias("_r2"), "_first")
    marked = hashed.join(F.broadcast(hot), ["_h1", "_h2"], "left")
    # A line that is marked already goes to any task; it meets nothing there.
    at = F.when(F.col("_hot").isNull(), F.col("_h1")).otherwise(F.xxhash64("_doc", "_text", "_pos"))
    marked = marked.select("_doc", "_text", "_pos", "_hot", at.alias("_at"), "_h2")
    met = marked.join(rest, (F.col("_at") == F.col("_r1")) & (F.col("_h2") == F.col("_r2")) & F.col("_hot").isNull(), "left")
    dropped = (
        met.where(F.col("_doc") > F.coalesce("_hot", "_first"))
        .groupBy("_doc", "_text")
        .agg(F.collect_set("_pos").alias("_dropped"))
    )
    # The text is split below the join: what stands above it reads a finished array, not a split of its own for every line.
    row = docs.select(
        F.struct(*others).alias("_row"), F.col("doc_id").alias("_id"), text_hash.alias("_own_text"), _lines(F.col("text")).alias("_split")
    )
    joined = row.join(dropped, (F.col("_id") == F.col("_doc")) & (F.col("_own_text") == F.col("_text")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.coalesce("_dropped", F.array().cast("array<int>")))
    return joined.select(
        *[F.col("_row")[c].alias(c) for c in others],
        F.array_join(F.transform(stay, lambda i: F.get(F.col("_split"), i)), "\n").alias("text"),
        F.size("_split").cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents d,
       LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos) u),
firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM lines WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.*, f.first_doc IS NOT NULL AND l.doc_id > f.first_doc AS gone
  FROM lines l LEFT JOIN firsts f ON l.k = f.k AND length(l.k) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one holds; n_chars follows the text.

    Null texts become empty; rows without doc_id keep all their lines.
    """

    def deduped(own: DataFrame) -> DataFrame:
        out = dedup_lines(own)
        if "n_chars" in own.columns:
            out = out.withColumn("n_chars", F.length("text").cast("long"))
        return out.select(*own.columns)

    return with_safe_names(deduped, docs, "doc_id", "text", "n_chars")
