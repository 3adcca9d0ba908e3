"""Personal data: fixed rules for four kinds, and bootstrapped contextual extraction of further ones.

1. The rules give the base spans, the seed entities. Every other token that holds a digit or an `@` is
   a candidate, with the kinds that its shape allows (possibly none).
2. Each seed and candidate induces lexical patterns: the word before it, the two words before, the
   word after, and the words on both sides. Patterns and values form a graph, a row for each distinct
   edge; copies of a document add none.
3. Spark scores the graph in rounds. A pattern's confidence for a kind is the score of that kind's
   accepted values in it over all distinct values in it, whatever their kind, plus one; it needs
   `SUPPORT` accepted values. A candidate's score is the chance that not all confident patterns around it
   err. Values above `ACCEPT` count as accepted in the next round.
4. A candidate is added where its value is accepted for a kind that its shape allows. A candidate that repeats
   a seed's value (the same digits or address in another spelling) is a known value and needs no pattern.

Base spans stay; added spans do not overlap them or each other (the longer, then the earlier first).
Counts are those of the base. A phone number without its plus sign, an address without a dot or an
account number that fails its check digit are such additions; all patterns around them must speak for it.

Nulls: a null text is empty; a null doc_id is kept. Repeated rows have results of their own. Long texts
are searched whole, in time linear in their length. An empty table gives no rows. Extra columns are
not read.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch
from .words import SLICE_BYTES, text_slices

KINDS = ("email", "ip", "card", "phone")
NEAR = 80  # characters in which the words of a pattern are looked for
ROUNDS = 3
SUPPORT = 5  # accepted values that a pattern needs
CONFIDENT = 0.8  # of a pattern
ACCEPT = 0.9  # of a value

_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
# Possessive runs are read once: a run that no match follows holds no match that starts inside it.
_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]++({_DOMAIN})?")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]")
_NUMBERS = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9])++")
_WORD = re.compile(r"[^\s.,;:!?()\[\]{}\"'<>]+")
_BLANK = " \t\n\r\x0b\x0c"
_TRIM = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text) if m.group(1)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if m.group(1) and all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def shape(value: str) -> list[int]:
    """The kinds that a candidate may be, beside those of the rules."""
    kinds = []
    name, at, host = value.partition("@")
    if at and name and host and "@" not in host:
        kinds.append(0)
    if re.fullmatch(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}", value):
        kinds.append(1)
    if re.fullmatch(r"[0-9](?:[ -]?[0-9])+", value) and 12 <= len(_digits(value)) <= 19:
        kinds.append(2)
    if re.fullmatch(r"\(?[0-9][ ().0-9-]*[0-9]", value) and 7 <= len(_digits(value)) <= 15:
        kinds.append(3)
    return kinds


def value_of(kind: int, text: str) -> str:
    """One spelling of a value: an address in lower case, the digits of a number."""
    return text.lower() if kind < 2 else _digits(text).lstrip("0") if kind == 3 else _digits(text)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of the other tokens that hold a digit or an @, and of groups of digits, in order."""
    taken = sorted((a, b) for a, _, b in base)
    out, k = [], 0

    def free(a: int, b: int) -> bool:
        nonlocal k
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        return k == len(taken) or b <= taken[k][0]

    groups = [m.span() for m in _NUMBERS.finditer(text) if free(*m.span())]
    taken, k, at = sorted(taken + groups), 0, 0
    while m := _SIGN.search(text, at):
        start = max(text.rfind(c, at, m.start()) for c in _BLANK) + 1
        start = max(start, at)
        end = m.end()
        while end < len(text) and text[end] not in _BLANK:
            end += 1
        at = end
        while start < end and text[start] in _TRIM:
            start += 1
        while end > start and text[end - 1] in _TRIM:
            end -= 1
        if end > start and free(start, end):
            out.append((start, end))
    return sorted(out + groups)


def _norm(word: str) -> str:
    return _DIGIT.sub("0", word.lower())


def patterns(text: str, a: int, b: int) -> list[int]:
    """Hashes of the lexical patterns around a span."""
    before = [_norm(w) for w in _WORD.findall(text[max(0, a - NEAR) : a])[-2:]]
    after = [_norm(w) for w in _WORD.findall(text[b : b + NEAR])[:1]]
    out = []
    if before:
        out.append(f"l|{before[-1]}")
    if len(before) > 1:
        out.append(f"ll|{before[0]}|{before[1]}")
    if after:
        out.append(f"r|{after[0]}")
    if before and after:
        out.append(f"lr|{before[-1]}|{after[0]}")
    return [xxhash.xxh64_intdigest(p) - (1 << 63) for p in out]


def _hash(kind: int, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}|{value}") - (1 << 63)


ENTITY = pa.struct(
    [
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("base", pa.bool_()),
        ("value", pa.int64()),
        ("kinds", pa.list_(pa.struct([("kind", pa.int32()), ("known", pa.int64())]))),
        ("patterns", pa.list_(pa.int64())),
    ]
)
FOUND_ARROW = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("entities", pa.list_(ENTITY))]
)
FOUND_SCHEMA = (
    f"uid bigint, doc_id bigint, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string,"
    " entities array<struct<start:int,end:int,base:boolean,value:bigint,kinds:array<struct<kind:int,known:bigint>>,patterns:array<bigint>>>"
)


def entities(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and candidates: `value` names the value whatever its kind, `known` its spelling of a kind."""
    out = []
    for a, kind, b in base:
        kinds = [{"kind": kind, "known": _hash(kind, value_of(kind, text[a:b]))}]
        out.append((a, b, True, text[a:b], kinds))
    for a, b in candidates(text, base):
        kinds = [{"kind": k, "known": _hash(k, value_of(k, text[a:b]))} for k in shape(text[a:b])]
        out.append((a, b, False, text[a:b], kinds))
    names = ("start", "end", "base", "value", "kinds", "patterns")
    return [dict(zip(names, (a, b, own, _hash(9, v.lower()), kinds, patterns(text, a, b)))) for a, b, own, v, kinds in out]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> base results and entities."""
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 33
    for batch in text_slices(batches, 1, SLICE_BYTES):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            base = base_spans(text)
            spans = joined(base)
            counts = [sum(k == own for _, k, _ in base) for own in range(len(KINDS))]
            found = entities(text, base) if _SIGN.search(text) else []
            rows.append((uid, doc_id, *counts, hashlib.sha256(spans.encode()).hexdigest(), spans, found))
            uid += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FOUND_ARROW.types)], schema=FOUND_ARROW)


def score_graph(
    edges: DataFrame, seeds: DataFrame, allowed: DataFrame, scratch: Scratch,
    rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT, accept: float = ACCEPT,
) -> DataFrame:
    """(value, kind) accepted by patterns. `edges` (pattern, value) and `seeds` (value, kind) are distinct,
    `allowed` (value, kind) are the kinds that the values of candidates may have."""
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    # Only patterns around enough values can ever be confident, and only edges of candidates matter then.
    totals = scratch.save(totals.where(F.col("total") >= support))
    accepted = seeds.withColumn("score", F.lit(1.0))
    found, size = None, 0
    for _ in range(rounds):
        strength = (
            edges.join(accepted, "value")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= support)
            .join(totals, "pattern")
            .select("pattern", "kind", (F.col("score") / (F.col("total") + 1)).alias("confidence"))
            .where(F.col("confidence") >= confident)
        )
        found = scratch.save(
            edges.join(strength, "pattern")
            .join(allowed, ["value", "kind"])
            .groupBy("value", "kind")
            .agg((1.0 - F.exp(F.sum(F.ln(1.0 - F.col("confidence"))))).alias("score"))
            .where(F.col("score") >= accept)
        )
        accepted = seeds.withColumn("score", F.lit(1.0)).unionByName(found.join(seeds, ["value", "kind"], "left_anti"))
        now = found.count()
        if now == size:
            break
        size = now
    return found.select("value", "kind")


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, spans, added) -> (uid, spans) with the added spans that overlap no other."""
    for batch in batches:
        out = []
        for spans, added in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kept = [(int(a), KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
            mine: list[tuple[int, int, int]] = []
            for x in sorted(added, key=lambda x: (x["start"] - x["end"], x["start"], x["kind"])):
                if all(x["end"] <= a or x["start"] >= b for a, _, b in mine):
                    mine.append((x["start"], x["kind"], x["end"]))
            out.append(joined(sorted(kept + mine)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["uid", "spans"])


def personal_data(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of (doc_id, text)."""
    found = scratch.save(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_find, FOUND_SCHEMA))
    every = found.select("uid", F.inline("entities"))
    edges = scratch.save(every.select("value", F.explode("patterns").alias("pattern")).distinct())
    named = every.select("value", "base", F.inline("kinds"))
    seeds = scratch.save(named.where("base").select("value", "kind", "known").distinct())
    allowed = scratch.save(named.where("not base").select("value", "kind").distinct())
    by_pattern = score_graph(edges, seeds.select("value", "kind"), allowed, scratch, **options)
    # Candidates that spell a seed's value in another way, and those that patterns have accepted.
    spelled = every.where("not base").select("uid", "start", "end", "value", F.inline("kinds"))
    known = spelled.join(seeds.select("known", "kind").distinct(), ["known", "kind"], "left_semi")
    trusted = spelled.join(by_pattern, ["value", "kind"], "left_semi")
    added = (
        known.unionByName(trusted)
        .groupBy("uid")
        .agg(F.collect_set(F.struct("start", "end", "kind")).alias("added"))
    )
    changed = scratch.save(
        found.select("uid", "spans").join(added, "uid").mapInArrow(_resolve, "uid bigint, spans string")
    )
    names = [f"n_{k}" for k in KINDS]
    return (
        found.drop("entities")
        .join(changed.withColumnRenamed("spans", "more"), "uid", "left")
        .select("doc_id", *names, "base_sha256", F.coalesce("more", "spans").alias("spans"))
    )


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
