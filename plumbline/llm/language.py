"""Language identification in two steps: the family first, then the language within the family.

Both steps are one-versus-one linear support vector machines on hashed counts of character n-grams
(1 to 3 letters inside words, lower case). A family comes from a table of related languages; a
language outside it is a family of its own. The machines are fitted with Spark ML on a bounded sample
of labelled rows; the few thousand weights of each pair go to the tasks, and every text is scored whole.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch

#: Closely related languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "celtic": "br cy ga gd".split(),
    "uralic": "et fi hu".split(),
}
WIDTH = 1 << 12
SAMPLE_PER_LANGUAGE = 1500
ITERATIONS = 40
FIT_PARTITIONS = 8
_NOT_LETTER = re.compile(r"[\W\d_]+")


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.split("-")[0].lower() in members), lang)


def features(text: str | None) -> np.ndarray | None:
    """Root-scaled counts of hashed 1- to 3-grams with unit norm; None without a letter."""
    words = _NOT_LETTER.sub(" ", text or "").strip().lower()
    if not words:
        return None
    codes = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(WIDTH)
    key = np.zeros(len(codes), np.uint64)
    for n in (1, 2, 3):
        key = key[: len(codes) - n + 1] * np.uint64(0x9E3779B1) + codes[n - 1 :] + np.uint64(n)
        mixed = (key ^ (key >> np.uint64(15))) * np.uint64(0x85EBCA77C2B2AE63)
        counts += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % WIDTH, minlength=WIDTH)
    counts = np.sqrt(counts)
    return counts / np.sqrt((counts * counts).sum())


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(t, f) for t, f in zip(batch.column(0).to_pylist(), map(features, batch.column(1).to_pylist())) if f is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in rows], pa.string()), pa.array([f for _, f in rows], pa.list_(pa.float64()))],
            ["lang", "features"],
        )


def labelled_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """About `per_language` rows of each language (all, if it has fewer), drawn by a hash of the key."""
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return docs.join(F.broadcast(counts.where("lang is not null")), "lang").where(
        draw < per_language / F.col("_n")
    )


def _machine(rows: DataFrame, left: list[str]) -> tuple[np.ndarray, float]:
    data = rows.select(F.col("lang").isin(left).cast("double").alias("label"), array_to_vector("features").alias("features"))
    model = LinearSVC(maxIter=ITERATIONS, regParam=1e-4, standardization=False, aggregationDepth=2).fit(data)
    return model.coefficients.toArray(), float(model.intercept)


def fit(docs: DataFrame, scratch: Scratch, per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """Machines from rows (doc_id, text, lang) with known languages; `per_language` bounds the sample."""
    rows = scratch.save(
        labelled_sample(docs.where("lang is not null and text is not null"), per_language)
        .select("lang", "text")
        .mapInArrow(_sample_features, "lang string, features array<double>")
    )
    langs = [r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    groups: dict[str, list[str]] = {}
    for lang in langs:
        groups.setdefault(family_of(lang), []).append(lang)
    # The sample is bounded, so a few partitions hold it; each step of the solver is a job over them.
    rows = rows.coalesce(FIT_PARTITIONS).cache()
    try:
        between = {
            (a, b): _machine(rows.where(F.col("lang").isin(groups[a] + groups[b])), groups[a])
            for a, b in combinations(sorted(groups), 2)
        }
        within = {
            (a, b): _machine(rows.where(F.col("lang").isin(a, b)), [a])
            for members in groups.values()
            for a, b in combinations(members, 2)
        }
    finally:
        rows.unpersist()
    return {"groups": groups, "between": between, "within": within}


def _vote(names: list[str], machines: dict, x: np.ndarray) -> tuple[str, float]:
    """The name with most votes, then the greatest sum of margins, and its mean share of the margins."""
    if len(names) == 1:
        return names[0], 1.0
    votes = dict.fromkeys(names, 0)
    margins = dict.fromkeys(names, 0.0)
    shares = dict.fromkeys(names, 0.0)
    for a, b in combinations(names, 2):
        w, c = machines[a, b]
        m = float(w @ x + c)
        votes[a if m > 0 else b] += 1
        margins[a] += m
        margins[b] -= m
        share = 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
        shares[a] += share
        shares[b] += 1 - share
    best = max(names, key=lambda k: (votes[k], margins[k]))
    return best, shares[best] / (len(names) - 1)


def predict_text(model: dict, text: str | None) -> tuple[str, float]:
    x = features(text)
    if x is None or not model["groups"]:
        return "und", 0.0
    family, sure = _vote(sorted(model["groups"]), model["between"], x)
    lang, also = _vote(model["groups"][family], model["within"], x)
    return lang, sure * also


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Add `lang_pred` and `score` to rows (doc_id, held_out, text). Only the text is looked at.

    A null text, or one without a letter, is `und` with score 0; so is all without learned languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict_text(model, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double"
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    )
    model = fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"), Scratch(spark))
    return predict(docs, model)
