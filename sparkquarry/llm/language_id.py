"""Language identification: a family first, then one-versus-one SVMs inside the family."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.llm.shared import fresh_name, give_back, table, with_safe_names

UNDETERMINED = "und"
DIMS = 2048


def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None, letter: np.ndarray, dims: int = DIMS) -> np.ndarray | None:
    """Hashed counts of 1-, 2- and 3-grams of letters over the whole text, square-rooted
    and scaled to length 1; None if there is no letter. Runs of other characters count as
    one blank."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = letter[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, np.uint32(32))
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]
    codes = np.concatenate(([np.uint32(32)], codes[keep], [np.uint32(32)])).astype(np.uint32)
    total = np.zeros(dims)
    mixed = np.zeros(len(codes), dtype=np.uint32)
    for n in (1, 2, 3):
        gram = mixed[: len(codes) - n + 1]
        gram = (gram * np.uint32(0x9E3779B1) + codes[n - 1 :] + np.uint32(n)) * np.uint32(0x85EBCA6B)
        mixed = gram
        total += np.bincount((gram >> np.uint32(7)) % np.uint32(dims), minlength=dims)
    total = np.sqrt(total)
    return (total / np.linalg.norm(total)).astype(np.float32)


def _svm(x: np.ndarray, sign: np.ndarray, steps: int = 200, penalty: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    rate = 1 / (2 * (x**2).sum(1).max() + penalty)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for step in range(steps):
        slack = np.maximum(0, 1 - sign * (x @ ahead))
        grad = -2 * x.T @ (share * sign * slack) + penalty * ahead
        new = ahead - rate * grad
        ahead = new + step / (step + 3) * (new - w)
        w = new
    return w.astype(np.float32)


def families_of(centroids: dict[str, np.ndarray], count: int) -> list[list[str]]:
    """Languages put together by average linkage of their centroids' cosines."""
    groups = [[name] for name in sorted(centroids)]
    unit = {k: v / (np.linalg.norm(v) or 1) for k, v in centroids.items()}
    while len(groups) > count:
        pairs = itertools.combinations(range(len(groups)), 2)
        near = lambda p: np.mean([unit[a] @ unit[b] for a in groups[p[0]] for b in groups[p[1]]])
        i, j = max(pairs, key=near)
        groups[i] += groups.pop(j)
    return [sorted(g) for g in groups]


@dataclass
class LanguageModel:
    families: list[list[str]]
    family_weights: np.ndarray  # a row per family, one against the rest
    pair_weights: dict[tuple[str, str], np.ndarray]  # inside families only

    def predict(self, x: np.ndarray | None) -> tuple[str, float]:
        if x is None or not self.families:
            return UNDETERMINED, 0.0
        x = np.append(x, np.float32(1))
        margins = 4.0 * (self.family_weights @ x)
        odds = np.exp(margins - margins.max())
        best = int(margins.argmax())
        score = float(odds[best] / odds.sum())
        members = self.families[best]
        if len(members) == 1:
            return members[0], score
        votes = {m: 0.0 for m in members}
        for (a, b), w in self.pair_weights.items():
            if a in votes and b in votes:
                p = float(1 / (1 + np.exp(-np.clip(4.0 * (w @ x), -50, 50))))
                votes[a] += p
                votes[b] += 1 - p
        name = max(sorted(votes), key=votes.get)
        return name, score * votes[name] / (len(members) - 1)


def train(labelled: DataFrame, per_language: int = 300, family_count: int | None = None, dims: int = DIMS) -> LanguageModel:
    """Fit on at most `per_language` different texts of each language, chosen by a hash of the text.

    That bound (and so what reaches the driver) holds at every corpus size. `labelled` has
    text and lang; rows without either, or without a letter, teach nothing. Families are the
    nearest groups of language centroids; by default there are as many as the square root
    of the number of languages, rounded up.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("_hash"))
    rates = rows.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("n")).select(
        "lang", F.least(F.lit(1.0), F.lit(1.5 * per_language) / F.col("n")).alias("rate")
    )
    rates = {r["lang"]: r["rate"] for r in rates.collect()}  # one row per language
    if not rates:
        return LanguageModel([], np.zeros((0, dims + 1), np.float32), {})
    place = F.pmod("_hash", F.lit(1 << 20))
    chosen = F.lit(False)
    for name, rate in sorted(rates.items()):
        chosen = chosen | ((F.col("lang") == name) & (place < F.lit(int(rate * (1 << 20)) + 1)))
    # Copies of a text have one hash and are one row before they are shuffled, however many they are.
    distinct = rows.where(chosen).groupBy("lang", "_hash").agg(F.min("text").alias("text"))
    by_hash = Window.partitionBy("lang").orderBy("_hash")
    sample = distinct.withColumn("_at", F.row_number().over(by_hash)).where(F.col("_at") <= per_language)  # of about 1.5 times the bound

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letter = _letters()
        for batch in batches:
            found = [(k, features(t, letter, dims)) for k, t in zip(batch["lang"], batch["text"])]
            found = [(k, v.tobytes()) for k, v in found if v is not None]
            yield pd.DataFrame(found, columns=["lang", "vector"])

    got = sample.select("lang", "text").mapInPandas(vectors, "lang string, vector binary").toPandas()
    if got.empty:
        return LanguageModel([], np.zeros((0, dims + 1), np.float32), {})
    got = got.sort_values(["lang", "vector"])
    x = np.stack([np.frombuffer(v, np.float32) for v in got["vector"]])
    lang = got["lang"].to_numpy()
    names = sorted(set(lang))
    count = family_count or int(np.ceil(np.sqrt(len(names))))
    families = families_of({k: x[lang == k].mean(0) for k in names}, count)
    of = {name: i for i, members in enumerate(families) for name in members}
    family = np.array([of[k] for k in lang])
    one = lambda hit: np.where(hit, 1, -1).astype(np.float32)
    rest = np.stack([_svm(x, one(family == i)) for i in range(len(families))])
    pairs = {}
    for members in families:
        for a, b in itertools.combinations(members, 2):
            rows_of = (lang == a) | (lang == b)
            pairs[a, b] = _svm(x[rows_of], one(lang[rows_of] == a))
    return LanguageModel(families, rest, pairs)


def identify(docs: DataFrame, model: LanguageModel, dims: int = DIMS) -> DataFrame:
    """`docs` plus lang_pred and score, from the whole `text` of each row and nothing else.

    Null, empty and letterless texts get lang_pred "und" and score 0; so does every text
    if the model has learned no language. Other columns pass through; columns of the input
    called lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    out = fresh_name(docs, "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one row of weights per family and pair
    letters: list[np.ndarray] = []

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not letters:
            letters.append(_letters())
        for batch in texts:
            found = [sent.value.predict(features(t, letters[0], dims)) for t in batch]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])
        give_back()

    return docs.withColumn(out, predict("text")).select("*", f"{out}.lang_pred", f"{out}.score").drop(out)


def held_out(fold: int = 2, folds: int = 4):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def train_on_documents(docs: DataFrame, **options) -> LanguageModel:
    return train(docs.where(~held_out()), **options)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train_on_documents(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language: those of which the text has a letter.

    The model learns from the labelled documents of the input table that aren't held out; it
    gives every text with letters some learned language, so what the stage rejects are null,
    empty and letterless texts (and all, if there is nothing to learn from).
    """
    model = train_on_documents(table(spark, sf_dir, "documents"))
    known = lambda own: identify(own, model).where(F.col("lang_pred") != UNDETERMINED).drop("lang_pred", "score")
    return with_safe_names(known, docs, "text")
