"""Language-model scores from a sharded Elias-Fano trie of words, word pairs and word triples.

Level 1 of a shard holds its contexts (a word, or the start of a text), level 2 the words seen after
each of them. Both are Elias-Fano sequences: contexts by hash, pointers to where each context's
successors begin, and successors as 32-bit hashes relative to their context, made monotone by the
context's rank. Level 3 has the couples (u v) of a context v and the word before it, as 32-bit hashes
relative to v, pointers to where each couple's triples begin, and the third words of the triples. A
third word w is not a hash: it is the place of (v w) among the successors of v in level 2, made monotone
by the couple's rank. So a shard has all levels of its contexts, and a block sends a triple as two
small numbers. A successor search inside a context or couple finds an entry; a batch that asks for more
than a quarter of a sequence reads it in order. The values of pairs and triples are 8-bit codes of log10 of
their shares c(v w) / c(v) and c(u v w) / c(u v); a context keeps c(v) and T(v), the number of distinct
words after it, and a couple c(u v) and T(u v). A shard's levels lie in one file that is memory-mapped
while the shard answers.

    p(w | u v) = (c(u v) share(u v w) + T(u v) p(w | v)) / (c(u v) + T(u v))
    p(w | v) = (c(v) share(v w) + T(v) p(w)) / (c(v) + T(v))
    p(w) = (c(w) - D1) / N, and D1 V / N for the class of all unknown words

D1 = n1 / (n1 + 2 n2) from the counts of words that occur once and twice in all training texts. The first
token of a text has the start as its only context; unknown contexts and couples leave all to the lower order.
`score_documents` has the order as a parameter, and the query takes 3.

The corpus is tokenised once into blocks of documents. A block sends its distinct pairs and triples, with
their counts in training documents, to the shards of their contexts v, and a shard sends back the codes of
the same entries in the same order. So counts are combined before they move, a frequent word costs a
block one entry, no machine holds the whole model, and model and traffic grow with the corpus. A context
with more entries than `PIECE_ENTRIES` has shards of its own, cut by ranges of successors. Its c(v) is
summed over all blocks before, so shares are those of the whole context, and the parts of T(v) add
up. A context with more triples than that has its level 3 in other shards of its own, cut by ranges of
predecessors, and a couple with so many is cut by ranges of successors in the same way as a context. Scores
do not depend on the number of shards, on cuts or on blocks.

Nulls: a null text is empty and has the end as its only token; a null doc_id is not held out and
trains. Repeated rows count again. Without training documents all words are unknown.
"""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch
from .words import mixed, text_slices, word_hashes

END = np.uint64(0x1D)
START = np.uint64(0x2E)
SHARD_TOKENS = 1_500_000
PIECE_ENTRIES = 1_500_000  # of one context in all blocks, before it is cut
ORDER = 3  # words of the longest entry, in the query
BLOCK_BYTES = 6 << 20  # of text in a block
LOWEST = -9.0  # log10 of the least value a code stands for
_ONE = np.uint64(1)


class EliasFano:
    """A non-decreasing sequence of numbers below 2**63."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        self.n, self.low_bits = n, max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << self.low_bits) - 1)
        width = -(-self.low_bits // 8)
        self.low = np.ascontiguousarray(low.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :width].copy()
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(n)
        size = (int(high[-1]) if n else 0) + 1 + 64
        self.bits = np.zeros(-(-size // 64), np.uint64)
        np.bitwise_or.at(self.bits, high >> 6, _ONE << (high & 63).astype(np.uint64))
        counts = np.bitwise_count(self.bits).astype(np.int64)
        self.ones = np.cumsum(counts) - counts

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "bits": self.bits, "ones": self.ones}

    def _select(self, rank: np.ndarray, zeros: bool) -> np.ndarray:
        """The place of the given one (or zero) bit."""
        before = np.arange(len(self.bits)) * 64 - self.ones if zeros else self.ones
        word = np.searchsorted(before, rank, "right") - 1
        rest = rank - before[word]
        bits = ~self.bits[word] if zeros else self.bits[word]
        place = np.zeros(len(rank), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            part = (bits >> place.astype(np.uint64)) & np.uint64((1 << half) - 1)
            inside = np.bitwise_count(part).astype(np.int64)
            beyond = rest >= inside
            rest = np.where(beyond, rest - inside, rest)
            place += half * beyond
        return word * 64 + place

    def _in_order(self) -> np.ndarray:
        """All elements, read one after the other."""
        ones = np.flatnonzero(np.unpackbits(self.bits.astype("<u8").view(np.uint8), bitorder="little"))
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(slice(None))

    def access(self, i: np.ndarray) -> np.ndarray:
        if len(i) > self.n // 4:
            return self._in_order()[i]
        high = (self._select(i, False) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(i)

    def _low(self, i: np.ndarray | slice) -> np.ndarray:
        out = np.zeros(self.n if isinstance(i, slice) else len(i), np.uint64)
        for k in range(self.low.shape[1]):
            out |= self.low[i, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The index of the first element that is not below x (n, if all are)."""
        if len(x) > self.n // 4:
            return np.searchsorted(self._in_order(), x)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        zeros = len(self.bits) * 64 - self.n
        known = high < zeros
        h = np.minimum(high, zeros - 1)
        # Elements before bucket h end where its zero-bit number h - 1 stands.
        first = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) - np.maximum(h - 1, 0), 0)
        end = self._select(h, True) - h
        first, end = np.where(known, first, self.n), np.where(known, end, self.n)
        low = x & np.uint64((1 << self.low_bits) - 1)
        while (open_ := first < end).any():
            at = np.flatnonzero(open_)
            mid = (first[at] + end[at]) // 2
            below = self._low(mid) < low[at]
            first[at] = np.where(below, mid + 1, first[at])
            end[at] = np.where(below, end[at], mid)
        return first


def code(x: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 of probabilities, even in log10; 0 is kept for absent ones."""
    y = np.log10(np.maximum(x, 10**LOWEST))
    return (1 + np.rint((y - LOWEST) / -LOWEST * 254)).astype(np.uint8)


_VALUES = np.append(0.0, 10 ** (LOWEST + np.arange(255.0) / 254 * -LOWEST))


def value(codes: np.ndarray) -> np.ndarray:
    return _VALUES[codes]


class Trie:
    """One shard, built from what was seen in training: distinct pairs (context, successor) sorted by both,
    and their counts; with a third level, distinct couples (context, predecessor) sorted by both, and distinct
    triples (number of the couple, number of the pair) sorted by both, and their counts. Of a context that
    is cut, `whole` gives the count in all pieces, and `whole_couple` that of a couple."""

    def __init__(
        self, context: np.ndarray, successor: np.ndarray, count: np.ndarray, folder: str, whole: int | None = None,
        couples: tuple = (), triples: tuple = (), whole_couple: int | None = None,
    ):
        keys, first = np.unique(context, return_index=True)
        ends = np.append(first[1:], len(context)).astype(np.int64)
        total = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        if whole is not None:
            total = np.full(len(keys), whole, np.int64)
        rank = np.repeat(np.arange(len(keys)), ends - first)
        self.contexts = EliasFano(keys)
        self.pointers = EliasFano(np.append(first, len(context)))
        self.successors = EliasFano((rank.astype(np.uint64) << np.uint64(32)) | successor)
        shares = code(count / total[rank]) if len(rank) else np.zeros(0, np.uint8)
        plain = {"shares": shares, "total": total, "distinct": ends - first}
        levels = ["contexts", "pointers", "successors"]
        if len(couples):
            owner, predecessor = couples
            couple, pair, times = triples
            owner = np.searchsorted(keys, owner)
            heads = np.searchsorted(couple, np.arange(len(owner) + 1)).astype(np.int64)
            sums = np.add.reduceat(times, heads[:-1]) if len(owner) else np.zeros(0, np.int64)
            if whole_couple is not None:
                sums = np.full(len(owner), whole_couple, np.int64)
            self.predecessors = EliasFano((owner.astype(np.uint64) << np.uint64(32)) | predecessor)
            self.spans = EliasFano(heads)
            # A third word is its number among the successors of the second.
            number = (pair - first[owner[couple]]).astype(np.uint64)
            self.thirds = EliasFano((couple.astype(np.uint64) << np.uint64(32)) | number)
            third_shares = code(times / sums[couple]) if len(couple) else np.zeros(0, np.uint8)
            plain |= {"third_shares": third_shares, "sums": sums}
            levels += ["predecessors", "spans", "thirds"]
        for name in levels:
            plain |= {f"{name}.{k}": v for k, v in getattr(self, name).arrays().items()}
        path = os.path.join(folder, "levels")
        places, at = {}, 0
        with open(path, "wb") as out:
            for name, array in plain.items():
                places[name] = (at, array.dtype, array.shape)
                at += out.write(array.tobytes())
                at += out.write(b"\0" * (-at % 8))
        self.file = np.memmap(path, np.uint8, "r") if at else np.zeros(0, np.uint8)
        for name, (start, dtype, shape) in places.items():
            size = int(np.prod(shape)) * dtype.itemsize
            array = self.file[start : start + size].view(dtype).reshape(shape)
            level, _, part = name.partition(".")
            setattr(getattr(self, level) if part else self, part or level, array)

    @staticmethod
    def _inside(children: EliasFano, pointers: EliasFano, parent: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The places of labels among the children of their parents; -1 where there is none."""
        place = np.full(len(parent), -1, np.int64)
        ask = np.flatnonzero((parent >= 0) & (label >= 0))
        if len(ask) and children.n:
            key = (parent[ask].astype(np.uint64) << np.uint64(32)) | label[ask].astype(np.uint64)
            found = children.successor(key)
            inside = found < pointers.access(parent[ask] + 1).astype(np.int64)
            inside[inside] = children.access(found[inside]) == key[inside]
            place[ask[inside]] = found[inside]
        return place

    def find(self, context: np.ndarray, owner: np.ndarray, successor: np.ndarray):
        """Counts c and T of contexts; shares and places of pairs (number of the asked context, successor)."""
        n = self.contexts.n
        at = self.contexts.successor(context) if n else np.zeros(len(context), np.int64)
        known = at < n
        known[known] = self.contexts.access(at[known]) == context[known]
        at = np.where(known, at, -1)
        counts, distinct = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        counts[known], distinct[known] = self.total[at[known]], self.distinct[at[known]]
        place = self._inside(self.successors, self.pointers, at[owner], successor)
        shares = np.zeros(len(place), np.uint8)
        shares[place >= 0] = self.shares[place[place >= 0]]
        return counts, distinct, shares, at, place

    def find_thirds(self, at: np.ndarray, predecessor: np.ndarray, couple: np.ndarray, pair: np.ndarray):
        """Counts c and T of couples (place of the context, predecessor), and shares of triples (number of
        the asked couple, place of the pair)."""
        counts, distinct = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        shares = np.zeros(len(couple), np.uint8)
        place = np.full(len(at), -1, np.int64)
        ask = np.flatnonzero(at >= 0)
        if not len(ask) or not self.predecessors.n:
            return counts, distinct, shares
        key = (at[ask].astype(np.uint64) << np.uint64(32)) | predecessor[ask].astype(np.uint64)
        found = self.predecessors.successor(key)
        inside = found < self.predecessors.n
        inside[inside] = self.predecessors.access(found[inside]) == key[inside]
        place[ask[inside]] = found[inside]
        own = place[place >= 0]
        counts[place >= 0] = self.sums[own]
        distinct[place >= 0] = (self.spans.access(own + 1) - self.spans.access(own)).astype(np.int64)
        number = np.where(pair >= 0, pair - self.pointers.access(np.maximum(at[couple], 0)).astype(np.int64), -1)
        third = self._inside(self.thirds, self.spans, place[couple], number)
        shares[third >= 0] = self.third_shares[third[third >= 0]]
        return counts, distinct, shares


_ZSTD = pa.Codec("zstd")


def _pack(*groups: list[np.ndarray]) -> bytes:
    """Arrays of numbers from 0 in groups of a like size: each group as planes of bytes, of as few bytes as its
    numbers need, all compressed together."""
    head, planes = [len(groups)], []
    for group in groups:
        all_of = np.concatenate(group)
        top = int(all_of.max()) if len(all_of) else 0
        size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        planes.append(all_of.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes())
        head += [size, len(group), *map(len, group)]
    body = b"".join([np.array(head, "<u4").tobytes(), *planes])
    return len(body).to_bytes(4, "little") + _ZSTD.compress(body, asbytes=True)


def _unpack(packed: bytes) -> list[np.ndarray]:
    """The arrays of all groups."""
    body = memoryview(_ZSTD.decompress(packed[4:], int.from_bytes(packed[:4], "little"), asbytes=True))
    number = int.from_bytes(body[:4], "little")
    head, at, groups, out = body[: len(body) // 4 * 4].cast("I"), 1, [], []
    for _ in range(number):
        groups.append((head[at], head[at + 2 : at + 2 + head[at + 1]].tolist()))
        at += 2 + head[at + 1]
    at *= 4
    for size, lengths in groups:
        n = sum(lengths)
        planes = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n)
        all_of = planes.T.copy().view(f"<u{size}").reshape(n)
        at += n * size
        first = 0
        for length in lengths:
            out.append(all_of[first : first + length])
            first += length
    return out


BLOCK_SCHEMA = "block bigint, doc_ids array<bigint>, train array<boolean>, tokens bigint, chains binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, train, text) -> one row for each batch: distinct words, the texts' lengths, and the words'
    numbers in order."""
    from pyspark import TaskContext

    for number, batch in enumerate(text_slices(batches, 2, BLOCK_BYTES)):
        hashes, before = word_hashes(batch.column(2))
        words, codes, times = np.unique(hashes, return_inverse=True, return_counts=True)
        # Frequent words get small numbers, which take less room.
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        yield pa.RecordBatch.from_pydict(
            {
                "block": [(TaskContext.get().partitionId() << 33) + number],
                "doc_ids": [batch.column(0).to_pylist()],
                "train": [batch.column(1).to_pylist()],
                "tokens": [len(hashes)],
                "chains": [_pack([words[order]], [np.diff(before)], [rank[codes]])],
            },
            schema=pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("tokens", pa.int64()), ("chains", pa.binary())]),
        )


@dataclass
class Chain:
    """A block's words with START and END, numbered in order of their keys, and its tokens."""

    key: np.ndarray  # of each word as a context
    narrow: np.ndarray  # of each word as a successor or predecessor
    start: int
    end: int
    doc: np.ndarray  # of each token, as the next two
    context: np.ndarray
    word: np.ndarray
    lengths: np.ndarray
    train: np.ndarray


def _chain(row: dict) -> Chain:
    words, lengths, codes = _unpack(row["chains"])
    words = np.append(words.astype(np.uint64), [START, END])
    spread = mixed(words)
    order = np.argsort(spread)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    lengths, codes = lengths.astype(np.int64), rank[codes]
    start, end = int(rank[-2]), int(rank[-1])
    ends = np.cumsum(lengths)
    return Chain(
        spread[order] >> _ONE,
        mixed(words[order] + _ONE) >> np.uint64(32),
        start,
        end,
        np.repeat(np.arange(len(lengths)), lengths + 1),
        np.insert(codes, ends - lengths, start),
        np.insert(codes, ends, end),
        lengths,
        np.array(row["train"], bool),
    )


@dataclass
class Levels:
    """What a block has of each level, and where its tokens are. Contexts are in order of their keys; pairs
    (context, successor) by context and successor's hash; couples (predecessor, context) by context and
    predecessor's hash; triples by couple and successor's hash."""

    key: np.ndarray  # of each context
    contexts: np.ndarray  # its word
    sizes: np.ndarray  # its pairs
    successor: np.ndarray
    count: np.ndarray
    pair: np.ndarray  # of each token
    couples: np.ndarray  # of each context
    predecessor: np.ndarray
    triples: np.ndarray  # of each couple
    third: np.ndarray  # the pair of each triple
    times: np.ndarray
    triple: np.ndarray  # of each token that is not the first of its text
    couple: np.ndarray  # of each of these tokens
    later: np.ndarray  # these tokens


def _levels(chain: Chain, weight: np.ndarray | None, order: int) -> Levels:
    """The distinct entries of all levels up to `order`, and the sums of their tokens' weights."""
    n = len(chain.key)
    by_hash = np.argsort(chain.narrow, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_hash] = np.arange(n)
    distinct, pair = np.unique(chain.context * n + rank[chain.word], return_inverse=True)
    first, second = np.divmod(distinct, n)
    second = by_hash[second]
    heads = _context_runs(first)
    contexts, sizes = first[heads], np.diff(np.append(heads, len(first)))
    count = np.bincount(pair, weight, len(distinct)).astype(np.int64)
    none = np.zeros(0, np.int64)
    found = Levels(
        chain.key[contexts], contexts, sizes, chain.narrow[second], count, pair,
        np.zeros(len(contexts), np.int64), none.astype(np.uint64), none, none, none, none, none, none,
    )
    if order < 3:
        return found
    # A pair that does not end a text is the couple before the next token.
    inner = np.flatnonzero(second != chain.end)
    inner = inner[np.argsort(second[inner] * n + rank[first[inner]])]
    couple_of = np.full(len(distinct), -1, np.int64)
    couple_of[inner] = np.arange(len(inner))
    found.couples = np.bincount(np.searchsorted(contexts, second[inner]), minlength=len(contexts))
    found.predecessor = chain.narrow[first[inner]]
    found.later = np.flatnonzero(chain.context != chain.start)
    found.couple = couple_of[pair[found.later - 1]]
    each, found.triple = np.unique(found.couple * len(distinct) + pair[found.later], return_inverse=True)
    owner, found.third = np.divmod(each, max(1, len(distinct)))
    found.triples = np.bincount(owner, minlength=len(inner))
    found.times = np.bincount(found.triple, None if weight is None else weight[found.later], len(each)).astype(np.int64)
    return found


def _context_runs(c: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)


@dataclass
class Cuts:
    """What has shards of its own, with the number of its pieces and, where pieces share a count, that count in
    all training documents: contexts cut by ranges of successors (level 2), contexts whose third level is cut
    by ranges of predecessors, and couples (context, predecessor) cut by ranges of successors."""

    pairs: dict[int, tuple[int, int]] = field(default_factory=dict)
    triples: dict[int, int] = field(default_factory=dict)
    couples: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)

    def firsts(self, shards: int) -> tuple[dict, dict, dict]:
        """The first shard of each, behind those of all others."""
        out, at = [], shards
        for numbers in ({k: n for k, (n, _) in self.pairs.items()}, self.triples, {k: n for k, (n, _) in self.couples.items()}):
            out.append({})
            for key, n in numbers.items():
                out[-1][key] = at
                at += n
        return tuple(out)


def _entries(least: int):
    """The contexts of each block with at least so many distinct successors there, and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chain = _chain(row)
                n, context = len(chain.key), chain.context
                held = (np.bincount(context, minlength=n) >= least)[context]
                pairs = np.unique(context[held] * n + chain.word[held])
                c, sizes = np.unique(pairs // n, return_counts=True)
                much = sizes >= least
                key = chain.key[c[much]].astype(np.int64)
                yield pa.RecordBatch.from_pydict({"context": pa.array(key), "entries": pa.array(sizes[much].astype(np.int64))})

    return run


def _counts_of(keys: np.ndarray):
    """The training counts of the given contexts in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chain = _chain(row)
                own = np.flatnonzero(np.isin(chain.key, keys))
                count = np.bincount(chain.context, chain.train[chain.doc], len(chain.key)).astype(np.int64)[own]
                yield pa.RecordBatch.from_pydict({"context": pa.array(chain.key[own].astype(np.int64)), "count": pa.array(count)})

    return run


def large_contexts(blocks: DataFrame, number: int, most: int) -> dict[int, tuple[int, int]]:
    """Contexts to be cut: the pieces of each, and its count c(v) in all training documents.

    A block leaves out contexts below a share of `most`, such that all it leaves out is half of `most` at
    the utmost. So every context with more than `most` entries shows more than half of them, and is cut;
    one that is cut with fewer does no harm. No more than twice the entries of the corpus by `most` are cut.
    """
    least = max(1, most // (2 * max(1, number)))
    rows = blocks.mapInArrow(_entries(least), "context bigint, entries bigint").groupBy("context").agg(F.sum("entries").alias("n"))
    pieces = {r.context: 2 * r.n // most + 1 for r in rows.where(F.col("n") > most // 2).orderBy("context").collect()}
    if not pieces:
        return {}
    keys = np.array(sorted(pieces), np.uint64)
    counts = blocks.mapInArrow(_counts_of(keys), "context bigint, count bigint").groupBy("context").agg(F.sum("count").alias("n"))
    whole = {r.context: r.n for r in counts.collect()}
    return {k: (n, whole.get(k, 0)) for k, n in pieces.items()}


def _triple_entries(least: int):
    """The contexts and couples of each block with at least so many distinct triples there, and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chain = _chain(row)
                n, context = len(chain.key), chain.context
                much = np.bincount(context, minlength=n) >= least
                much[chain.start] = False
                held = np.flatnonzero(much[context])
                couples, couple = np.unique(context[held] * n + context[held - 1], return_inverse=True)
                triples = np.unique(couple * n + chain.word[held]) // n
                sizes = np.bincount(triples, minlength=len(couples))
                owner, before = np.divmod(couples, n)
                whole = np.bincount(owner, sizes, n).astype(np.int64)
                own, large = np.flatnonzero(whole >= least), sizes >= least
                yield pa.RecordBatch.from_pydict(
                    {
                        "context": pa.array(np.append(chain.key[own], chain.key[owner[large]]).astype(np.int64)),
                        "predecessor": pa.array([None] * len(own) + chain.narrow[before[large]].tolist(), pa.int64()),
                        "entries": pa.array(np.append(whole[own], sizes[large]).astype(np.int64)),
                    }
                )

    return run


def _couple_counts(keys: list[tuple[int, int]]):
    """The training counts of the given couples in each block."""
    wanted: dict[int, set[int]] = {}
    for context, predecessor in keys:
        wanted.setdefault(context, set()).add(predecessor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chain = _chain(row)
                much = np.isin(chain.key, np.array(sorted(wanted), np.uint64))
                much[chain.start] = False
                held = np.flatnonzero(much[chain.context] & chain.train[chain.doc])
                frame = pd.DataFrame({"context": chain.key[chain.context[held]].astype(np.int64), "predecessor": chain.narrow[chain.context[held - 1]].astype(np.int64)})
                frame = frame.groupby(["context", "predecessor"]).size().reset_index(name="count")
                mine = [p in wanted[c] for c, p in zip(frame["context"].tolist(), frame["predecessor"].tolist())]
                yield pa.RecordBatch.from_pandas(frame[np.array(mine, bool)].astype(np.int64), preserve_index=False)

    return run


def large_triples(blocks: DataFrame, number: int, most: int) -> tuple[dict[int, int], dict[tuple[int, int], tuple[int, int]]]:
    """Contexts whose third level is cut, and the pieces of each; couples that are cut, the pieces of each and
    its count in all training documents. What is found, and why, is as for `large_contexts`."""
    least = max(1, most // (2 * max(1, number)))
    rows = blocks.mapInArrow(_triple_entries(least), "context bigint, predecessor bigint, entries bigint").groupBy("context", "predecessor")
    found = rows.agg(F.sum("entries").alias("n")).where(F.col("n") > most // 2).orderBy("context", "predecessor").collect()
    contexts = {r.context: 2 * r.n // most + 1 for r in found if r.predecessor is None}
    couples = {(r.context, r.predecessor): 2 * r.n // most + 1 for r in found if r.predecessor is not None}
    if not couples:
        return contexts, {}
    counts = blocks.mapInArrow(_couple_counts(list(couples)), "context bigint, predecessor bigint, count bigint")
    whole = {(r.context, r.predecessor): r.n for r in counts.groupBy("context", "predecessor").agg(F.sum("count").alias("n")).collect()}
    return contexts, {k: (n, whole.get(k, 0)) for k, n in couples.items()}


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ascending in the mixed hash, so a block's contexts of one shard are one run."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _piece_of(successors: np.ndarray, pieces: int) -> np.ndarray:
    return (successors * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)


@dataclass
class Unit:
    """What a block asks of one shard: numbers of entries in the block's levels, and their sizes there."""

    shard: int
    contexts: np.ndarray
    sizes: np.ndarray
    pairs: np.ndarray
    couples_of: np.ndarray
    couples: np.ndarray
    triples_of: np.ndarray
    triples: np.ndarray
    second: bool = True  # whether the pairs are asked, or are only there for the triples


def _units(found: Levels, shards: int, cuts: Cuts) -> Iterator[Unit]:
    """All requests of a block, in the same order whenever they are made."""
    none = np.zeros(0, np.int64)
    pair_firsts, triple_firsts, couple_firsts = cuts.firsts(shards)
    own = ~np.isin(found.key, np.array(sorted(cuts.pairs), np.uint64))
    whole = ~np.isin(found.key, np.array(sorted(cuts.triples), np.uint64))
    pairs, couples = np.append(0, np.cumsum(found.sizes)), np.append(0, np.cumsum(found.couples))
    triples = np.append(0, np.cumsum(found.triples)).astype(np.int64)
    shard = _shard_of(found.key << _ONE, shards)
    heads = _context_runs(shard)
    for a, b in zip(heads.tolist(), np.append(heads[1:], len(shard)).tolist()):
        if own[a:b].any():
            x, y = couples[a], couples[b]
            thirds = np.repeat(whole[a:b], found.couples[a:b])
            yield Unit(
                int(shard[a]),
                a + np.flatnonzero(own[a:b]),
                found.sizes[a:b][own[a:b]],
                pairs[a] + np.flatnonzero(np.repeat(own[a:b], found.sizes[a:b])),
                np.where(whole[a:b], found.couples[a:b], 0)[own[a:b]],
                x + np.flatnonzero(thirds),
                found.triples[x:y][thirds],
                triples[x] + np.flatnonzero(np.repeat(thirds, found.triples[x:y])),
            )
    # All pieces of a context or couple are asked, also without successors, for their parts of T.
    for h in np.flatnonzero(~own).tolist():
        key = int(found.key[h])
        n = cuts.pairs[key][0]
        borders = pairs[h] + np.searchsorted(_piece_of(found.successor[pairs[h] : pairs[h + 1]], n), np.arange(n + 1))
        for i, (u, v) in enumerate(zip(borders, borders[1:])):
            yield Unit(pair_firsts[key] + i, np.array([h]), np.array([v - u]), np.arange(u, v), np.zeros(1, np.int64), none, none, none)
    large: dict[int, list[int]] = {}
    for key, predecessor in cuts.couples:
        large.setdefault(key, []).append(predecessor)
    for h in np.flatnonzero(~whole & (found.couples > 0)).tolist():
        key, x, y = int(found.key[h]), couples[h], couples[h + 1]
        before = found.predecessor[x:y]
        apart = np.isin(before, np.array(large.get(key, []), np.uint64))
        n = cuts.triples[key]
        borders = np.searchsorted(_piece_of(before, n), np.arange(n + 1))
        parts = []
        for i, (u, v) in enumerate(zip(borders, borders[1:])):
            mine = x + u + np.flatnonzero(~apart[u:v])
            if len(mine):
                inside = np.repeat(~apart[u:v], found.triples[x + u : x + v])
                parts.append((triple_firsts[key] + i, mine, found.triples[mine], triples[x + u] + np.flatnonzero(inside)))
        for j in (x + np.flatnonzero(apart)).tolist():
            couple = (key, int(found.predecessor[j]))
            n = cuts.couples[couple][0]
            after = found.successor[found.third[triples[j] : triples[j + 1]]]
            borders = triples[j] + np.searchsorted(_piece_of(after, n), np.arange(n + 1))
            parts += [(couple_firsts[couple] + i, np.array([j]), np.array([v - u]), np.arange(u, v)) for i, (u, v) in enumerate(zip(borders, borders[1:]))]
        for number, mine, sizes, inside in parts:
            needed = np.unique(found.third[inside])
            yield Unit(number, np.array([h]), np.array([len(needed)]), needed, np.array([len(mine)]), mine, sizes, inside, False)


def _steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ascending numbers as the first of each run and the steps behind it, which are smaller."""
    if len(sizes) == 1:
        return np.diff(values, prepend=np.uint64(0))
    steps = values.copy()
    steps[1:] -= values[:-1]
    heads = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[heads] = values[heads]
    return steps


def _runs(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of such steps; sums wrap around, which takes nothing from their differences."""
    sums = np.cumsum(steps.astype(np.uint64), dtype=np.uint64)
    heads = (np.cumsum(sizes) - sizes)[sizes > 0]
    return sums - np.repeat(sums[heads] - steps[heads].astype(np.uint64), sizes[sizes > 0])


SENT_SCHEMA = "shard int, block bigint, request binary"


def _request(found: Levels, unit: Unit) -> bytes:
    # A triple names its pair by the number among its context's pairs.
    third, starts = found.third[unit.triples], np.cumsum(unit.sizes) - unit.sizes
    place = np.searchsorted(unit.pairs, third)
    number = place - np.repeat(np.repeat(starts, unit.couples_of), unit.triples_of)
    return _pack(
        [_steps(found.key[unit.contexts], np.array([len(unit.contexts)]))],
        [_steps(found.successor[unit.pairs], unit.sizes), _steps(found.predecessor[unit.couples], unit.couples_of)],
        [unit.sizes, found.count[unit.pairs], unit.couples_of, unit.triples_of, number, found.times[unit.triples]],
    )


def _send(shards: int, cuts: Cuts, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chain = _chain(row)
                found = _levels(chain, chain.train[chain.doc], order)
                sent = [(unit.shard, _request(found, unit)) for unit in _units(found, shards, cuts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in sent], pa.int32()), pa.array([row["block"]] * len(sent), pa.int64()), pa.array([r for _, r in sent], pa.binary())],
                    [c.split()[0] for c in SENT_SCHEMA.split(", ")],
                )

    return run


#: A reply has c - T (mostly 0) and T of contexts, the same of couples, shares of pairs, and of triples.
ANSWER_SCHEMA = "block bigint, shard int, reply binary, words bigint, tokens bigint, once bigint, twice bigint"


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of each key among them, and the sums of the counts."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, place.astype(np.int32), np.bincount(place, counts, len(distinct)).astype(np.int64)


def _answer(frame: pd.DataFrame, shards: int, cuts: Cuts, order: int) -> pd.DataFrame:
    """All blocks' entries of one shard -> the shard's trie, asked for the same entries. A shard from number
    `shards` on is a piece of one context or couple."""
    shard = int(frame["shard"].iloc[0])
    parts = list(zip(*[_unpack(r) for r in frame["request"]]))
    lengths = [np.array([len(a) for a in parts[k]]) for k in (0, 1, 2, 7)]
    kinds = (np.uint64, np.uint64, np.uint64, np.int64, np.uint32, np.int64, np.uint32, np.uint32, np.uint32)
    key, successor, predecessor, sizes, count, couples_of, triples_of, number, times = (
        np.concatenate([a.astype(k) for a in p]) for p, k in zip(parts, kinds)
    )
    del parts
    # Entries by the million: what is used up goes at once, and places are narrow.
    keys, context = np.unique(_runs(key, lengths[0]), return_inverse=True)
    owner = np.repeat(context, sizes).astype(np.uint64) << np.uint64(32)
    pairs, pair, count = _summed(owner | _runs(successor, sizes), count)
    del owner, successor
    entry = np.repeat(np.arange(len(key)), couples_of)  # the context's entry of each couple
    owner = context[entry].astype(np.uint64) << np.uint64(32)
    couples, couple = np.unique(owner | _runs(predecessor, couples_of), return_inverse=True)
    couple = couple.astype(np.int32)
    del owner, predecessor
    third = np.repeat((np.cumsum(sizes) - sizes)[entry].astype(np.int32), triples_of)
    third += number.astype(np.int32)
    del entry, number
    third = np.repeat(couple.astype(np.int64), triples_of) * max(1, len(pairs)) + pair[third]
    triples, triple, times = _summed(third, times)
    del third, triples_of
    owner, third = (a.astype(np.int32) for a in np.divmod(triples, max(1, len(pairs))))
    del triples
    pair_owner, couple_owner = (pairs >> np.uint64(32)).astype(np.int32), (couples >> np.uint64(32)).astype(np.int32)
    after, before = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), (couples & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    del pairs, couples
    # The trie holds what training documents have.
    seen, learned = count > 0, times > 0
    held = np.zeros(len(before), bool)
    held[owner[learned]] = True
    new_pair, new_couple = np.cumsum(seen) - 1, np.cumsum(held) - 1
    pair_firsts, triple_firsts, couple_firsts = cuts.firsts(shards)
    whole = whole_couple = None
    if shard >= shards:
        if shard >= min(couple_firsts.values(), default=1 << 62):
            whole_couple = cuts.couples[int(keys[0]), int(before[0])][1]
        elif shard < min(triple_firsts.values(), default=1 << 62):
            whole = cuts.pairs[int(keys[0])][1]
    out = []
    with tempfile.TemporaryDirectory() as folder:
        trie = Trie(
            keys[pair_owner[seen]], after[seen], count[seen], folder, whole,
            (keys[couple_owner[held]], before[held]) if order > 2 else (),
            (new_couple[owner[learned]], new_pair[third[learned]], times[learned]), whole_couple,
        )
        total, distinct, shares, at, place = trie.find(keys, pair_owner, after)
        counts, shares = [((total - distinct)[context], 0), (distinct[context], 0)], [(shares[pair], 1)]
        if order > 2:
            sums, follow, codes = trie.find_thirds(at[couple_owner], before, owner, place[third])
            counts += [((sums - follow)[couple], 2), (follow[couple], 2)]
            shares += [(codes[triple], 3)]
        borders = [np.append(0, np.cumsum(n)).tolist() for n in lengths]
        for i, block in enumerate(frame["block"]):
            reply = _pack(*[[a[borders[k][i] : borders[k][i + 1]] for a, k in group] for group in (counts, shares)])
            out.append((block, shard, reply, *[None] * 4))
        total = np.array(trie.total)
        start = mixed(np.array([START], np.uint64)) >> _ONE
        at = trie.contexts.successor(start)
        if at[0] < trie.contexts.n and trie.contexts.access(at)[0] == start[0]:
            total = np.delete(total, at[0])
        del trie
    # The start of a text is no word, and contexts that are cut are counted from their whole counts.
    stats = (len(total), int(total.sum()), int((total == 1).sum()), int((total == 2).sum()))
    out.append((None, shard, None, *(stats if shard < shards else (0, 0, 0, 0))))
    return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER_SCHEMA.split(", ")]).astype(
        {k: "Int64" for k in ("block", "words", "tokens", "once", "twice")}
    )


SCORE_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _joined(answers, found: Levels, shards: int, cuts: Cuts) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of a block's contexts, and of its couples: counts c and T, and shares of their pairs or triples."""
    replies = {a["shard"]: a["reply"] for a in answers}
    second = [np.zeros(len(found.key), np.int64), np.zeros(len(found.key), np.int64), np.zeros(len(found.successor))]
    third = [np.zeros(len(found.predecessor), np.int64), np.zeros(len(found.predecessor), np.int64), np.zeros(len(found.third))]
    for unit in _units(found, shards, cuts):
        arrays = _unpack(replies.pop(unit.shard))
        half = len(arrays) // 3 * 2
        levels = [(second, unit.contexts, unit.pairs, (*arrays[:2], arrays[half]))] if unit.second else []
        if half > 2:
            levels.append((third, unit.couples, unit.triples, (*arrays[2:4], arrays[5])))
        for level, owners, entries, (rest, distinct, codes) in levels:
            distinct = distinct.astype(np.int64)
            level[0][owners] = np.maximum(level[0][owners], rest + distinct)
            level[1][owners] += distinct
            level[2][entries] = value(codes)
    return second, third


def _weight(count: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """The weight of the lower order; an unknown context leaves all to it."""
    return np.where(count > 0, distinct / np.maximum(1, count + distinct), 1.0)


def _score(texts: int, words: int, tokens: int, lower: float, shards: int, cuts: Cuts, order: int):
    """Blocks with their answers -> scores. texts: training documents, the count of the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = tokens + texts, words + (texts > 0)
        for batch in batches:
            for row in batch.to_pylist():
                chain = _chain(row)
                found = _levels(chain, None, order)
                (total, distinct, shares), (sums, follow, thirds) = _joined(row["answers"], found, shards, cuts)
                count = np.zeros(len(chain.key), np.int64)
                weight = np.ones(len(chain.key))
                count[found.contexts] = total
                weight[found.contexts] = _weight(total, distinct)
                share = (1.0 - weight[chain.context]) * shares[found.pair]
                count[chain.end] = texts
                own = count[chain.word]
                base = np.log10((own + 1) / (n + v + 1))
                unigram = np.where(own > 0, np.maximum(own - lower, 1e-3), max(lower * v, 1e-3)) / n if n else np.ones(len(own))
                p = share + weight[chain.context] * unigram
                if order > 2:
                    back = _weight(sums, follow)[found.couple]
                    p[found.later] = (1.0 - back) * thirds[found.triple] + back * p[found.later]
                score = np.log10(np.minimum(1.0, p))
                size = len(chain.lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(~chain.train),
                        pa.array(chain.lengths + 1),
                        pa.array(np.bincount(chain.doc, own > 0, size).astype(np.int64)),
                        pa.array(np.bincount(chain.doc, base, size)),
                        pa.array(np.bincount(chain.doc, score, size)),
                    ],
                    [k.split()[0] for k in SCORE_SCHEMA.split(", ")],
                )

    return run


def score_documents(docs: DataFrame, train: F.Column, scratch: Scratch, order: int = 2) -> DataFrame:
    """Score all texts by a model of those with `train`, of word pairs or (order 3) of triples too: see the
    columns of SCORE_SCHEMA."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: the trie has two or three levels")
    blocks = scratch.save(
        docs.select(F.col("doc_id").cast("bigint"), train.alias("train"), "text").mapInArrow(_blocks, BLOCK_SCHEMA)
    )
    size = blocks.agg(F.sum("tokens"), F.sum(F.size(F.filter("train", lambda x: x))), F.count(F.lit(1))).first()
    shards = int(size[0] or 0) // SHARD_TOKENS + 1
    texts = int(size[1] or 0)
    pieces = large_contexts(blocks, size[2], PIECE_ENTRIES)
    cuts = Cuts(pieces)
    if order > 2:
        cuts.triples, cuts.couples = large_triples(blocks, size[2], PIECE_ENTRIES)
        cuts.triples = {k: 1 for k in pieces} | cuts.triples
    answers = scratch.save(
        blocks.mapInArrow(_send(shards, cuts, order), SENT_SCHEMA)
        .groupBy("shard")
        .applyInPandas(lambda frame: _answer(frame, shards, cuts, order), ANSWER_SCHEMA)
    )
    words, tokens, once, twice = (
        int(x or 0)
        for x in answers.where("block is null").agg(*[F.sum(k) for k in ("words", "tokens", "once", "twice")]).first()
    )
    start = int(mixed(np.array([START], np.uint64))[0] >> _ONE)
    cut = [c for k, (_, c) in pieces.items() if k != start and c]
    words, tokens = words + len(cut), tokens + sum(cut)
    once, twice = once + cut.count(1), twice + cut.count(2)
    lower = once / (once + 2 * twice) if once and twice else 0.75
    replies = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("shard", "reply")).alias("answers"))
    scored = blocks.join(replies, "block").mapInArrow(_score(texts, words, tokens, lower, shards, cuts, order), SCORE_SCHEMA)
    return scored.withColumn("train_tokens", F.lit(tokens + texts).cast("long"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    return score_documents(docs, train, Scratch(spark), ORDER)
