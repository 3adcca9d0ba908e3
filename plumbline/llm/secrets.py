"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of secret-like characters that holds a digit, or a quoted or bare value behind a
word like `token` or `password` and a sign of assignment. The forest looks at its length, transitions
between character classes, how much of it dictionary words cover, the document's path (its source,
or a path that the candidate is part of) and the neighbouring words, hashed into `BUCKETS`. It is trained
from labelled findings; `weak_label` makes such labels from rules where no people have made them. The
tests of those rules (names and signs of assignment, issued beginnings, whole numbers, hexadecimal
values) are no features, so the forest does not learn the rules back: it must find secrets by their
make and company, drops what the rules take for one only because of its name, and judges what they leave open.
`held_out_quality` measures both on findings that it has not seen.

The dictionary holds the words of at least `DICTIONARY_LEAST` documents, counted over all of them; it
is a table, and the words of candidates and of their neighbours are joined to it. Every text is
searched whole and every candidate is judged.

Nulls: a null or empty text has no findings; a null doc_id or path is kept as null and counts as an
empty path. Repeated rows have findings of their own, which count once in training. The forest is
trained on a bounded sample of each label, drawn by a hash of what a finding is, whatever the layout,
both labels with the same total weight; only if the whole table lacks a label, the label rules decide
alone. Texts are searched in time linear in their length.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import field, from_struct, in_struct, struct_schema
from .storage import Scratch
from .words import SLICE_BYTES, text_slices

SAMPLE_FINDINGS = 20_000  # of each label
DICTIONARY_LEAST = 5  # documents that hold a word
TREES, DEPTH, SEED = 30, 8, 11
PARTS = 8  # of the training sample
THRESHOLD = 0.5
NEAR = 48  # characters looked at on each side

_SHAPE = re.compile(r"[A-Za-z0-9+/_\-=.]{12,}")
#: Anchored at a word that names secrets; what follows it in the same name is bounded.
_ASSIGNED = re.compile(
    r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth|credential)"
    r"[\w\-]{0,40}[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}[\"']?([^\s\"',;]{6,})"
)
#: Every name in _ASSIGNED holds one of these; a text without them is not searched for assignments.
_STEMS = ("token", "secret", "passw", "pwd", "key", "auth", "credential")
_KEYED = re.compile(r"(?i)(token|secret|passw(or)?d|pwd|key|auth|credential|bearer)s?\b")
_PLAIN = re.compile(r"(?i)\b(commit|sha\d*|md5|hash|digest|checksum|uuid|guid|version|id|isbn|phone|tel)\b")
_ASSIGN = re.compile(r"(?::=|=>|=|:)\s{0,3}[\"']?$")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_NUMBER = re.compile(r"^[\d.\-+/=_]+$")
_HEX = re.compile(r"^[0-9a-fA-F]+$")
_LETTERS = re.compile(r"[A-Za-z]{4,}")
#: Published beginnings of issued keys.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "AIza", "eyJ")


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans, in order, none inside another."""
    spans = {m.span() for m in _SHAPE.finditer(text) if any(c.isdigit() for c in m.group())}
    lowered = text.lower()
    if any(stem in lowered for stem in _STEMS):
        spans |= {m.span(1) for m in _ASSIGNED.finditer(text)}
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        while b > a and text[b - 1] in ".=-_/+" and text[b - 1] != "=":
            b -= 1
        if out and a < out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        elif b > a:
            out.append((a, b))
    return out


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def weak_label(text: str, a: int, b: int) -> int | None:
    """1: assigned to a secret's name, or an issued key's beginning; 0: a number, a UUID, a value named
    as something else, or words; None: not clear."""
    value, before = text[a:b], text[max(0, a - NEAR) : a]
    if value.startswith(PREFIXES) and len(value) >= 16:
        return 1
    if _NUMBER.match(value) or _UUID.match(value):
        return 0
    if _ASSIGN.search(before) and _KEYED.search(before):
        return 1
    if _PLAIN.search(before):
        return 0
    return None if _HEX.match(value) and len(value) >= 32 else 0


#: Places of the two features that the dictionary gives, and of the length.
COVERED, KNOWN, LENGTH = 24, 52, 0
BUCKETS = 24  # of neighbouring words


def finding_features(text: str, a: int, b: int, path: str) -> tuple[list[float], list[tuple[str, int, int]], int]:
    """The features without what the dictionary gives; the distinct words asked of it, each with the
    characters that it covers of the value and its times around it; and the number of words around."""
    value, before, after = text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR]
    n = len(value)
    kinds = [_class(c) for c in value]
    steps = Counter(zip(kinds, kinds[1:]))
    letters = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in letters.values())
    pairs = Counter(zip(value, value[1:]))
    pair_entropy = -sum(k / max(1, n - 1) * math.log2(k / max(1, n - 1)) for k in pairs.values())
    around = re.findall(r"[^\W\d_]+", before)[-3:] + re.findall(r"[^\W\d_]+", after)[:3]
    covers, times = Counter(), Counter(w.lower() for w in around)
    for w in _LETTERS.findall(value):
        covers[w.lower()] += len(w)
    buckets = [0] * BUCKETS
    for w in around:
        buckets[xxhash.xxh32_intdigest(w.lower()) % BUCKETS] += 1
    joined = f"{path} {value if '/' in value else ''}".lower()
    features = [
        float(n),
        math.log(n),
        *[kinds.count(k) / n for k in range(4)],
        *[steps[i, j] / max(1, n - 1) for i in range(4) for j in range(4)],
        entropy,
        pair_entropy,
        0.0,
        float(joined.count("/")),
        float(any(w in joined for w in ("test", "example", "sample", "doc", "mock", "fixture"))),
        float(any(w in joined for w in (".env", "config", "secret", "credential"))),
        *[float(k) for k in buckets],
        0.0,
    ]
    # The dictionary has words of four letters or more only.
    asked = sorted(w for w in covers.keys() | times.keys() if len(w) >= 4)
    return features, [(w, covers[w], times[w]) for w in asked], len(around)


def dictionary(docs: DataFrame, least: int = DICTIONARY_LEAST) -> DataFrame:
    """(word): words of four letters or more in at least `least` of all documents."""
    return (
        docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{4,}"), F.lit(0)))).alias("word"))
        .groupBy("word")
        .count()
        .where(F.col("count") >= least)
        .select("word")
    )


FOUND_SCHEMA = (
    "id bigint, doc_id bigint, start int, end int, weak_label int, features array<double>, row_hash bigint,"
    " asked array<struct<word:string,chars:int,times:int>>, around int"
)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, path, row_hash) -> all candidates with what the dictionary is asked."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    asks = pa.list_(pa.struct([("word", pa.string()), ("chars", pa.int32()), ("times", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int64(), asks, pa.int32()]
    names = ["id", "doc_id", "start", "end", "weak_label", "features", "row_hash", "asked", "around"]
    for batch in text_slices(batches, 1, SLICE_BYTES):
        out = []
        for doc_id, text, where, row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            for a, b in candidates(text or ""):
                features, asked, around = finding_features(text, a, b, where or "")
                asked = [dict(zip(("word", "chars", "times"), w)) for w in asked]
                out.append((number, doc_id, a, b, weak_label(text, a, b), features, row, asked, around))
                number += 1
        columns = list(zip(*out)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def findings(docs: DataFrame, words: DataFrame, scratch: Scratch, path: str = "source") -> DataFrame:
    """All candidates of (doc_id, text, path) with features and weak labels; spans in code points.

    The join moves the words of candidates, not the dictionary; a frequent word has one row in it, so
    its candidates can be split over tasks."""
    raw = scratch.save(
        docs.select(F.col("doc_id").cast("bigint"), "text", F.col(path).cast("string"), F.xxhash64("text")).mapInArrow(
            _search, FOUND_SCHEMA
        )
    )
    hits = (
        raw.select("id", F.inline("asked"))
        .join(words, "word")
        .groupBy("id")
        .agg(F.sum("chars").alias("_chars"), F.sum("times").alias("_times"))
    )
    shares = {
        COVERED: F.coalesce("_chars", F.lit(0)) / F.col("features")[LENGTH],
        KNOWN: F.coalesce("_times", F.lit(0)) / F.greatest("around", F.lit(1)),
    }
    whole = F.transform("features", lambda x, i: F.when(i == COVERED, shares[COVERED]).when(i == KNOWN, shares[KNOWN]).otherwise(x))
    return raw.join(hits, "id", "left").select(
        "id", "doc_id", "start", "end", "weak_label", whole.alias("features"), "row_hash"
    )


def label_counts(labelled: DataFrame, label: str) -> dict[int, int]:
    counts = labelled.where(F.col(label).isNotNull()).groupBy(label).count().collect()
    return {int(r[label]): r["count"] for r in counts}


def drawn(*more) -> F.Column:
    """A number in [0, 1) that follows from what a finding is, not from where its row lies."""
    return F.pmod(F.xxhash64("doc_id", "start", "row_hash", *more), F.lit(1 << 30)) / float(1 << 30)


def label_sample(labelled: DataFrame, label: str, most: int = SAMPLE_FINDINGS) -> DataFrame:
    """Of each label all findings, or a hash sample of about `most` if there are more; those of
    repeated rows once."""
    share = F.lit(0.0)
    for value, count in label_counts(labelled, label).items():
        share = F.when(F.col(label) == value, F.lit(most / count)).otherwise(share)
    return labelled.where(drawn() < share).dropDuplicates(["doc_id", "row_hash", "start"])


def train_forest(labelled: DataFrame, label: str):
    """A forest from labelled findings (features, label 0 or 1), or None without both labels. Both
    labels have the same total weight."""
    counts = label_counts(labelled, label)
    if len(counts) < 2:
        return None
    weight = F.lit(0.0)
    for value, count in counts.items():
        weight = F.when(F.col(label) == value, F.lit(sum(counts.values()) / (2.0 * count))).otherwise(weight)
    data = labelled.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("label"), array_to_vector("features").alias("features"), weight.alias("weight"),
        drawn().alias("order"), "doc_id", "start",
    )
    # The trees draw rows by their place, so the place is made to follow from the findings.
    data = data.repartition(PARTS, "order").sortWithinPartitions("order", "doc_id", "start")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight").fit(data)


def judge(found: DataFrame, forest, threshold: float = THRESHOLD) -> DataFrame:
    """Add `probability` and `is_secret` to findings."""
    if forest is None:
        scored = found.withColumn("probability", F.coalesce(F.col("weak_label"), F.lit(0)).cast("double"))
    else:
        vectors = found.withColumn("_v", array_to_vector("features"))
        model = forest.copy().setFeaturesCol("_v")
        scored = model.transform(vectors).withColumn("probability", vector_to_array("probability")[1]).drop(
            "_v", "rawPrediction", "prediction"
        )
    return scored.withColumn("is_secret", F.col("probability") >= threshold)


def held_out_quality(found: DataFrame, scratch: Scratch, label: str = "weak_label", share: float = 0.2) -> dict[str, float]:
    """Precision and recall of a forest on the labelled findings that it has not learned from."""
    labelled = found.where(F.col(label).isNotNull())
    held = drawn(F.lit(1)) < share
    forest = train_forest(scratch.save(label_sample(labelled.where(~held), label)), label)
    judged = judge(labelled.where(held), forest)
    true, kept = F.col(label) == 1, F.col("is_secret")
    r = judged.agg(F.count_if(true & kept).alias("hits"), F.count_if(kept).alias("kept"), F.count_if(true).alias("true")).first()
    return {"precision": r.hits / max(1, r.kept), "recall": r.hits / max(1, r.true), "secrets": r.true}


def scan(docs: DataFrame, scratch: Scratch, path: str = "source") -> DataFrame:
    """Findings of all documents, judged by a forest trained on their weakly labelled sample."""
    words = scratch.save(dictionary(docs))
    found = scratch.save(findings(docs, words, scratch, path))
    sample = scratch.save(label_sample(found.where("weak_label is not null"), "weak_label"))
    return judge(found, train_forest(sample, "weak_label"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, Scratch(spark)).select("doc_id", "start", "end", "weak_label", "probability", "is_secret")


def masked_documents(docs: DataFrame, path: str = "source", mask: str = "<secret>") -> DataFrame:
    """The documents with every secret replaced by `mask`; columns of `docs`, all rows kept."""
    judged = scan(docs, Scratch(docs.sparkSession), path).where("is_secret")
    spans = judged.groupBy("doc_id", "row_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")
    )
    keyed = in_struct(docs).select(
        "row", field("doc_id").cast("bigint").alias("id"), F.xxhash64(field("text")).alias("hash")
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("row_hash"))
    joined = keyed.join(spans, same, "left").select("row", field("text").alias("text"), "spans")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, SLICE_BYTES):
            texts = [
                masked(text, [(s["start"], s["end"]) for s in found], mask) if found else text
                for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return from_struct(joined.mapInArrow(cover, struct_schema(docs, "text string")), docs, F.col("text"))


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """The text with each of the sorted, disjoint spans replaced by `mask`."""
    out, at = [], 0
    for a, b in spans:
        out += text[at:a], mask
        at = b
    return "".join([*out, text[at:]])
