"""Document fingerprints: prefix polynomial hashes.

With powers B**k and prefix sums of c[k] * B**k modulo two primes, the hash of any span is a
difference of two prefixes; spans at different places compare after a shift by powers. Longest
common extensions are found by binary search. A fingerprint is the length and the two hashes of the
whole text; the likeness of two texts is the share of the longer one that common spans in the same
order cover (1 for two empty texts): the longest common prefix and suffix, and between them the
longest common extensions around equal windows of `ANCHOR` characters, those of the one text at
multiples of `STRIDE`. A window is paired with its first place in the other text, with its places on the
displacements that most windows have, with those next to where it would be without edits, and, between windows that occur once in both, with the places
on the displacements of the nearest such windows on both sides; so a span goes on behind each
mismatch. The longest ordered chain of all pairs is kept.

The likeness is that of the texts, whose prefix arrays it needs; the short fingerprint tells equal
texts only. Nulls: a null text is empty, a null doc_id comes last; repeated rows are rows of their own;
an empty table gives no rows; extra columns are not read.
"""
from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch

PRIMES = (2147483647, 2147483629)
BASE = 1_000_003
ANCHOR = 8
STRIDE = 4
SHIFTS = 16
OUT = [
    ("doc_id", pa.int64(), "bigint"),
    ("n_chars", pa.int64(), "bigint"),
    ("edited_sha256", pa.string(), "string"),
    ("fingerprint", pa.string(), "string"),
    ("edited_fingerprint", pa.string(), "string"),
    ("near_edited", pa.float64(), "double"),
    ("near_next", pa.float64(), "double"),
]


class Powers:
    """B**k modulo each prime, grown to the longest text so far by doubling."""

    def __init__(self):
        self.table = [np.ones(1, np.uint64) for _ in PRIMES]

    def to(self, n: int) -> list[np.ndarray]:
        while len(self.table[0]) < n:
            for i, p in enumerate(PRIMES):
                have = self.table[i]
                step = pow(BASE, len(have), p)
                self.table[i] = np.concatenate([have, have * np.uint64(step) % np.uint64(p)])
        return self.table


_POWERS = Powers()


class Hashed:
    """A text's prefix arrays: n + 1 numbers for each prime."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(self.codes)
        self.prefix = []
        for p, power in zip(PRIMES, _POWERS.to(self.n + 1)):
            terms = self.codes * power[: self.n] % np.uint64(p)
            self.prefix.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(p)]))

    def fingerprint(self) -> str:
        return f"{self.n:x}-" + "".join(f"{int(a[-1]):08x}" for a in self.prefix)


def same_span(a: Hashed, i: int, b: Hashed, j: int, n: int) -> bool:
    """Whether a[i:i+n] == b[j:j+n]: both spans are moved to the later place by a power."""
    if i + n > a.n or j + n > b.n:
        return False
    for p, pa_, pb, power in zip(PRIMES, a.prefix, b.prefix, _POWERS.to(abs(i - j) + 1)):
        left = (int(pa_[i + n]) - int(pa_[i])) % p
        right = (int(pb[j + n]) - int(pb[j])) % p
        shift = int(power[abs(i - j)])
        if i < j:
            left = left * shift % p
        else:
            right = right * shift % p
        if left != right:
            return False
    return True


def _reach(same, most: int) -> int:
    """The greatest n up to `most` with same(n): doubled until it fails, then by binary search. Holds
    for n, it holds for all below; same(known, n) compares what lies between only."""
    low, step = 0, ANCHOR
    while low < most and same(low, min(most, low + step)):
        low, step = min(most, low + step), 2 * step
    high = min(most, low + step) - 1
    while low < high:
        mid = (low + high + 1) // 2
        if same(low, mid):
            low = mid
        else:
            high = mid - 1
    return low


def extension(a: Hashed, i: int, b: Hashed, j: int) -> int:
    """Longest common extension to the right of a[i:] and b[j:]."""
    return _reach(lambda low, n: same_span(a, i + low, b, j + low, n - low), min(a.n - i, b.n - j))


def back_extension(a: Hashed, b: Hashed, most: int, i: int | None = None, j: int | None = None) -> int:
    """Longest common extension to the left of a[:i] and b[:j] (the ends, if not given), of at most
    `most` characters."""
    i, j = a.n if i is None else i, b.n if j is None else j
    return _reach(lambda low, n: same_span(a, i - n, b, j - n, n - low), most)


def window_hashes(a: Hashed, starts: np.ndarray, top: int) -> np.ndarray:
    """One number for each window of ANCHOR characters, moved to place `top` by powers."""
    out = np.zeros(len(starts), np.uint64)
    for p, prefix, power in zip(PRIMES, a.prefix, _POWERS.to(top + 1)):
        q = np.uint64(p)
        span = (prefix[starts + ANCHOR] + q - prefix[starts]) % q
        out = (out << np.uint64(32)) | span * power[top - starts] % q
    return out


def _chain(place: np.ndarray, goal: np.ndarray) -> list[int]:
    """The longest chain of pairs that ascends in both, as numbers of pairs. Pairs of one place come in
    falling order of their goals, so a chain holds one of them."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(goal)
    for k, g in enumerate(goal.tolist()):
        size = bisect.bisect_left(ends, g)
        before[k] = last[size - 1] if size else -1
        ends[size : size + 1] = [g]
        last[size : size + 1] = [k]
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(k)
        k = before[k]
    return chain[::-1]


def anchors(a: Hashed, b: Hashed, head: int, tail: int) -> list[tuple[int, int]]:
    """The longest chain, ascending in both texts, of equal windows between head and tail."""
    top = max(a.n, b.n)
    here = np.arange(head, a.n - tail - ANCHOR + 1, STRIDE)
    there = np.arange(head, b.n - tail - ANCHOR + 1)
    if not len(here) or not len(there):
        return []
    asked, held = window_hashes(a, here, top), window_hashes(b, there, top)
    distinct, which, times = np.unique(asked, return_inverse=True, return_counts=True)
    at = np.minimum(np.searchsorted(distinct, held), len(distinct) - 1)
    hits = np.flatnonzero(distinct[at] == held)
    if not len(hits):
        return []
    first = np.full(len(distinct), -1)
    first[at[hits[::-1]]] = there[hits[::-1]]
    once = (np.bincount(at[hits], minlength=len(distinct)) == 1) & (times == 1)
    equal = first[which] >= 0
    place, goal = [here[equal]], [first[which][equal]]

    def on(shift: np.ndarray) -> None:
        """Add the windows that are equal at their own displacement."""
        to = here + shift - head
        inside = np.flatnonzero((to >= 0) & (to < len(there)))
        hit = inside[held[to[inside]] == asked[inside]]
        place.append(here[hit])
        goal.append((here + shift)[hit])

    shifts, votes = np.unique(goal[0] - place[0], return_counts=True)
    for shift in np.union1d(shifts[np.argsort(-votes, kind="stable")[:SHIFTS]], [0, b.n - a.n]):
        on(np.full(len(here), shift))
    # Of a repeated window the places next to where it would be without edits before, or behind, it.
    ids = at[hits]
    order = np.argsort(ids, kind="stable")
    places = ids[order] * (b.n + 1) + there[hits][order]
    for shift in (0, b.n - a.n):
        expected = np.clip(here[equal] + shift, 0, b.n)
        k = np.searchsorted(places, which[equal] * (b.n + 1) + expected)
        for near in (k, k - 1):
            found, to = np.divmod(places[np.clip(near, 0, len(places) - 1)], b.n + 1)
            own = found == which[equal]
            place.append(here[equal][own])
            goal.append(to[own])
    single = np.flatnonzero(once[which])
    single = single[_chain(here[single], first[which[single]])]
    if len(single):
        known = first[which[single]] - here[single]
        k = np.searchsorted(single, np.arange(len(here)), "right")
        on(known[np.maximum(k - 1, 0)])
        on(known[np.minimum(k, len(single) - 1)])
    place, goal = np.concatenate(place), np.concatenate(goal)
    order = np.lexsort((-goal, place))
    place, goal = place[order], goal[order]
    return [(int(place[k]), int(goal[k])) for k in _chain(place, goal)]


def middle(a: Hashed, b: Hashed, head: int, tail: int) -> int:
    """Characters of common spans, in the same order in both texts, between head and tail."""
    i = j = head
    covered = 0
    for place, goal in anchors(a, b, head, tail):
        if place < i or goal < j:
            continue
        back = back_extension(a, b, min(place - i, goal - j), place, goal)
        reach = min(extension(a, place, b, goal), a.n - tail - place, b.n - tail - goal)
        covered += back + reach
        i, j = place + reach, goal + reach
    return covered


def likeness(a: Hashed, b: Hashed) -> float:
    if not a.n and not b.n:
        return 1.0
    head = extension(a, 0, b, 0)
    tail = back_extension(a, b, min(a.n, b.n) - head)
    return (head + middle(a, b, head, tail) + tail) / max(a.n, b.n)


def compare(doc_id, text: str, follower: str, own: Hashed, nxt: Hashed) -> tuple:
    n = own.n
    half = n // 2
    edited = text[: n - half] + follower[:half]
    made = Hashed(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, digest, own.fingerprint(), made.fingerprint(), likeness(own, made), likeness(own, nxt)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order -> a result for each row whose follower is in the partition; the first and the
    last row's texts go out as they are, for the neighbour partitions."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([*[(n, k) for n, k, _ in OUT], ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
    last = None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            own = Hashed(text)
            if last is None:
                out.append((doc_id, *[None] * 6, part, "first", text))
            else:
                out.append((*compare(last[0], last[1], text, last[2], own), None, None, None))
            last = doc_id, text, own
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], schema=schema)
    if last is not None:
        row = (last[0], *[None] * 6, part, "last", last[1])
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, schema.types)], schema=schema)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, k) for n, k, _ in OUT])
    for batch in batches:
        rows = [
            compare(d, t, f, Hashed(t), Hashed(f))
            for d, t, f in zip(*[batch.column(i).to_pylist() for i in range(3)])
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(schema.types)], schema=schema
        )


def neighbour_fingerprints(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Fingerprints of documents (doc_id, text) and their edited texts, against the next document.

    Order: doc_id descending (null last), then text hash; after the last comes the first. The texts
    move once; only the first and last text of each partition go on to its neighbours. A null text
    is empty; a lone document follows itself; an empty table gives no rows."""
    columns = ", ".join(f"{n} {kind}" for n, _, kind in OUT)
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h").desc(), F.col("_tie")]
    placed = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_tie"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    table = scratch.save(placed.mapInArrow(_follow, f"{columns}, part int, edge string, text string"))
    names = [n for n, _, _ in OUT]
    firsts = table.where("edge = 'first'").select("part", F.col("text").alias("follower"))
    # The follower of a partition's last row is the first row of the next one that has rows.
    ring = Window.partitionBy().orderBy("part")
    parts = firsts.select("part", F.coalesce(F.lead("part").over(ring), F.min("part").over(Window.partitionBy())).alias("after"))
    lasts = (
        table.where("edge = 'last'")
        .select("doc_id", "text", "part")
        .join(parts, "part")
        .join(firsts.withColumnRenamed("part", "after"), "after")
        .select("doc_id", "text", "follower")
    )
    return table.where("edge is null").select(*names).unionByName(lasts.mapInArrow(_edges, columns))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return neighbour_fingerprints(docs, Scratch(spark))
