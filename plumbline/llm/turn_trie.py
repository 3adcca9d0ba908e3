"""Conversation prefix trie: ternary search trees over dictionary-encoded turns, one per range shard.

1. Turns become digests of (role, text), 32 hexadecimal digits; no text moves. A conversation is the
   string of its digests, so strings sort as the sequences do. One of more than `SEGMENT` turns is cut
   into segments; a segment hangs below the node that the turns before it reach, named by a
   polynomial hash of the digests of the earlier segments.
2. Sequences are range-sorted with their conv_ids. Each task reads its part in order, joins equal
   sequences as they come, and cuts the rest into shards of about `SHARD_TURNS` turns. In a shard
   the distinct digests form the dictionary, whose numbers keep their order, and the sequences are
   inserted by medians (the middle one first, then the halves), which balances the tree. An iterative
   traversal gives the nodes; in reverse it accumulates members, leaves and savings.
3. Nodes on the first and last path of a shard may go on in its neighbours. Their parts are added up
   by node. What neighbours count twice is known from their edges alone: for the common prefix of
   one shard's last and the next one's first sequence, each node is one child too many of its
   parent and has its words too few in the savings, and a last sequence that the next shard goes on
   with is no leaf.
4. Segments are treated from the deepest up; the totals below a segment's end node are added to it.

The conv_ids that end at a node are hashed in the task that reads them, or, where they cross an edge
or are many, sent on as joined texts of bounded size and hashed in order.

Rows without conv_id belong to no conversation. A null role or text is empty, a null turn comes
first; turns of one number follow their role, then their digest. Repeated rows are turns of their own. A
conversation whose turns are all replaced by none is a member of the root. An empty table gives no
rows. Extra columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .prefix import prefix_sums
from .storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"
GROUP = 20  # conversations that share their first turns
HEADS = 4  # h is a hash modulo this
SEGMENT = 16_384  # turns of a conversation in one row
SHARD_TURNS = 200_000
CHUNK_IDS = 50_000  # conv_ids in one joined text
DIGEST = 32
ROOT = "0" * DIGEST
PRIME = (1 << 61) - 1
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = [
    ("kind", pa.int8(), "byte"),
    ("key", pa.string(), "string"),
    ("parent", pa.string(), "string"),
    ("depth", pa.int64(), "bigint"),
    ("conv_id", pa.int64(), "bigint"),
    ("n_convs", pa.int64(), "bigint"),
    ("n_children", pa.int64(), "bigint"),
    ("n_leaves", pa.int64(), "bigint"),
    ("saved_tokens", pa.int64(), "bigint"),
    ("ends", pa.string(), "string"),
    ("edge", pa.bool_(), "boolean"),
    ("parent_edge", pa.bool_(), "boolean"),
    ("parent_conv", pa.int64(), "bigint"),
    ("task", pa.int32(), "int"),
    ("next", pa.string(), "string"),
    ("words", pa.list_(pa.int64()), "array<bigint>"),
]
NODE_ARROW = pa.schema([(n, k) for n, k, _ in NODE])
NODE_SCHEMA = ", ".join(f"{n} {k}" for n, _, k in NODE)
#: Kinds of rows: a node or a part of one; joined conv_ids (in `ends`); the first and the last sequence
#: of a task (digests in `ends`); the totals of a subtree that hangs below a segment.
PART, ENDS, FIRST, LAST, TOTAL = range(5)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, code, words) of the rows that have a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint"),
        "turn",
        role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("code"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id), and their turns (conv_id, place, code, words) after rebuilding."""
    placed = scratch.save(
        prefix_sums(turns, ["turn", "role", "code"], "words", scratch, ["conv_id"]).select(
            "conv_id", "position", "code", "words"
        )
    )
    convs = placed.where("position = 0").select("conv_id").withColumns(
        {
            "base": F.expr(f"conv_id - conv_id % {GROUP}"),
            "h": F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS)),
        }
    )
    # At most HEADS - 1 turns of each conversation that heads a group.
    heads = (
        placed.where((F.col("position") < HEADS - 1) & F.expr(f"conv_id % {GROUP} = 0"))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("position", "code", "words"))).alias("heads"))
    )
    convs = scratch.save(
        convs.join(heads, "base", "left").select(
            "conv_id",
            "h",
            F.slice(F.coalesce("heads", F.array().cast("array<struct<position:bigint,code:string,words:bigint>>")), F.lit(1), F.col("h").cast("int")).alias("heads"),
        )
    )
    own = placed.join(convs.select("conv_id", "h", F.size("heads").alias("first")), "conv_id").where("position >= h")
    first = convs.select("conv_id", F.inline("heads"))
    turns = own.select("conv_id", (F.col("position") - F.col("h") + F.col("first")).alias("place"), "code", "words")
    return convs.select("conv_id"), turns.unionByName(first.withColumnRenamed("position", "place"))


def sequences(convs: DataFrame, turns: DataFrame, scratch: Scratch, segment: int) -> DataFrame:
    """(conv_id, level, path, codes, words, next): each conversation's segments. `path` names the node
    above the segment, `next` the one at the end of a full segment."""
    parts = (
        turns.groupBy("conv_id", F.expr(f"place div {segment}").alias("level"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "code", "words"))).alias("t"))
        .select(
            "conv_id",
            "level",
            F.array_join(F.transform("t", lambda x: x["code"]), "").alias("codes"),
            F.transform("t", lambda x: x["words"]).alias("words"),
        )
    )
    parts = scratch.save(parts)
    empty = convs.join(parts.where("level = 0"), "conv_id", "left_anti").select(
        "conv_id",
        F.lit(0).cast("bigint").alias("level"),
        F.lit("").alias("codes"),
        F.array().cast("array<bigint>").alias("words"),
    )
    full = parts.where(F.size("words") == segment)
    if full.isEmpty():
        return parts.unionByName(empty).select(
            "conv_id", "level", F.lit(ROOT).alias("path"), "codes", "words", F.lit(None).cast("string").alias("next")
        )
    # The name of a path: the sum of digest * base ** level over its segments, modulo a prime, twice.
    long = parts.join(full.select("conv_id").distinct(), "conv_id", "left_semi")
    terms = [f"_t{i}" for i in range(2)]
    named = long.select("conv_id", "level", F.md5("codes").alias("d")).mapInArrow(
        _terms, "conv_id bigint, level bigint, _t0 decimal(38,0), _t1 decimal(38,0)"
    )
    for i, term in enumerate(terms):
        named = prefix_sums(named, ["level"], term, scratch, ["conv_id"]).drop("position", "total", "rows").withColumnRenamed(
            "start", f"_s{i}"
        )
    modulo = [F.pmod(F.col(f"_s{i}"), F.lit(PRIME)).cast("bigint") for i in range(2)]
    after = [F.pmod(F.col(f"_s{i}") + F.col(f"_t{i}"), F.lit(PRIME)).cast("bigint") for i in range(2)]

    def name(values, level):
        # The level is part of the name, so a name stands for one depth.
        text = F.concat_ws("|", level.cast("string"), *[v.cast("string") for v in values])
        return F.when(level == 0, F.lit(ROOT)).otherwise(F.md5(text))

    names = named.select(
        "conv_id",
        "level",
        name(modulo, F.col("level")).alias("path"),
        name(after, F.col("level") + 1).alias("next"),
    )
    joined = parts.join(names, ["conv_id", "level"], "left")
    return scratch.save(
        joined.unionByName(empty, allowMissingColumns=True).select(
            "conv_id",
            "level",
            F.coalesce("path", F.lit(ROOT)).alias("path"),
            "codes",
            "words",
            F.when(F.size("words") == segment, F.col("next")).alias("next"),
        )
    )


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from decimal import Decimal

    bases = (1_000_003, 999_983)
    for batch in batches:
        levels, digests = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        sums = [
            [Decimal(int(d, 16) % PRIME * pow(b, k, PRIME) % PRIME) for k, d in zip(levels, digests)] for b in bases
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(s, pa.decimal128(38, 0)) for s in sums]],
            ["conv_id", "level", "_t0", "_t1"],
        )


def split(codes: str) -> list[str]:
    return [codes[i : i + DIGEST] for i in range(0, len(codes), DIGEST)]


def child_key(parent: str, code: str) -> str:
    return hashlib.blake2b((parent + code).encode(), digest_size=16).hexdigest()


def common_turns(a: str, b: str) -> int:
    """Turns of the longest common prefix of two strings of digests, by binary search."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


class Sequence:
    """A distinct sequence below `path` with the conversations that have it. `next` is the name of its
    end, if that is the end of a full segment; `leaves` and `saved` are the totals below it, and
    `leaves` is 0 if no conversation goes on there."""

    __slots__ = ("path", "codes", "words", "next", "leaves", "saved", "least", "count", "ids", "chunks", "open")

    def __init__(self, path, codes, words, following, leaves, saved):
        self.path, self.codes, self.words, self.next = path, codes, words, following
        self.leaves, self.saved = leaves or 0, saved or 0
        self.least, self.count, self.ids, self.chunks, self.open = None, 0, [], [], False

    def add(self, conv_id: int, ends: bool):
        self.least = conv_id if self.least is None else min(self.least, conv_id)
        self.count += 1
        if ends:
            self.ids.append(conv_id)
            if len(self.ids) == CHUNK_IDS:
                self.close()

    def close(self):
        if self.ids:
            self.chunks.append((self.ids[0], ",".join(map(str, self.ids))))
            self.ids = []


class Tree:
    """A ternary search tree of sequences of numbers; node 0 stands for none."""

    def __init__(self):
        self.token, self.low, self.same, self.high, self.end = [-1], [0], [0], [0], [-1]
        self.top = 0

    def _new(self, token: int) -> int:
        for column, value in ((self.token, token), (self.low, 0), (self.same, 0), (self.high, 0), (self.end, -1)):
            column.append(value)
        return len(self.token) - 1

    def insert(self, tokens: list[int], number: int):
        token_of, low, same, high = self.token, self.low, self.same, self.high
        side, at = None, 0  # the link that leads to the node at hand
        node = self.top
        for token in tokens:
            while node and token_of[node] != token:
                side, at = (low, node) if token < token_of[node] else (high, node)
                node = side[at]
            if not node:
                node = self._new(token)
                if side is None:
                    self.top = node
                else:
                    side[at] = node
            side, at = same, node
            last, node = node, same[node]
        self.end[last] = number

    def by_medians(self, sequences: list[list[int]]):
        """Insert sorted sequences, the middle one first, then those of each half."""
        todo = [(0, len(sequences))]
        while todo:
            a, b = todo.pop()
            if a >= b:
                continue
            mid = (a + b) // 2
            if sequences[mid]:
                self.insert(sequences[mid], mid)
            todo += [(a, mid), (mid + 1, b)]

    def nodes(self) -> list[tuple[int, int, int]]:
        """(node, number of the parent in this list or -1, depth), parents before children."""
        out, todo = [], [(self.top, -1, 1)]
        while todo:
            node, parent, depth = todo.pop()
            if not node:
                continue
            todo += [(self.low[node], parent, depth), (self.high[node], parent, depth), (self.same[node], len(out), depth + 1)]
            out.append((node, parent, depth))
        return out


def row(kind: int, key: str, **values) -> tuple:
    values = {"n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "edge": True, **values}
    return kind, key, *[values.get(name) for name, _, _ in NODE[2:]]


def shard_rows(before: int, held: list[Sequence]) -> list[tuple]:
    """Rows of one shard, sorted distinct sequences below one path whose node has the depth `before`:
    its nodes, and the joined conv_ids of ends that are not hashed here."""
    path = held[0].path
    codes = [split(s.codes) for s in held]
    names = sorted({c for own in codes for c in own})
    number = {c: i for i, c in enumerate(names)}
    tree = Tree()
    tree.by_medians([[number[c] for c in own] for own in codes])
    listed = tree.nodes()
    root = len(listed)
    n = root + 1
    key, parent, depth = [path] * n, [root] * n, [before] * n
    least, ends, words = [None] * n, [None] * n, [None] * n
    members, children, leaves, saved, edge = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    at_end = [root] * len(held)
    for i, (node, up, d) in enumerate(listed):
        parent[i], depth[i] = root if up < 0 else up, before + d
        key[i] = child_key(key[parent[i]], names[tree.token[node]])
        if tree.end[node] >= 0:
            at_end[tree.end[node]] = i
    out = []
    edge[root] = True
    for s, at in zip(held, at_end):
        least[at], members[at] = s.least, s.count
        leaves[at], saved[at] = s.leaves, s.saved
        if s.next is not None:
            key[at], edge[at] = s.next, True  # a full segment's end has no children here
        if s.chunks or s.open:
            edge[at] = True
            s.close()
            out += [row(ENDS, key[at], conv_id=first, ends=text) for first, text in s.chunks]
        elif s.ids:
            ends[at] = hashlib.sha256(",".join(map(str, s.ids)).encode()).hexdigest()
        # Each node is on the way to some end: its words come from there.
        for w in reversed(s.words):
            if words[at] is not None:
                break
            words[at], at = w, parent[at]
    for at in (at_end[0], at_end[-1]):
        while at != root:
            edge[at], at = True, parent[at]
    for i in range(root):
        children[parent[i]] += 1
    for i in range(n):
        if not children[i] and not leaves[i]:
            leaves[i] = 1
    for i in range(root - 1, -1, -1):
        up = parent[i]
        saved[i] += (members[i] - 1) * words[i]
        members[up] += members[i]
        leaves[up] += leaves[i]
        saved[up] += saved[i]
        if least[up] is None or least[i] < least[up]:
            least[up] = least[i]
    for i in range(root):
        up = parent[i]
        out.append(
            row(
                PART, key[i], parent=key[up], depth=depth[i], conv_id=least[i], n_convs=members[i], n_children=children[i],
                n_leaves=leaves[i], saved_tokens=saved[i], ends=ends[i], edge=edge[i], parent_edge=edge[up], parent_conv=least[up],
            )
        )
    return [*out, *root_rows(path, before, least[root], members[root], children[root], leaves[root], saved[root])]


def root_rows(path, before, conv_id, members, children, leaves, saved) -> list[tuple]:
    """What a shard adds to the node its sequences hang below. Below a segment that node's members are
    known already, and its totals wait for the segment above."""
    if not before:
        return [row(PART, path, depth=0, conv_id=conv_id, n_convs=members, n_children=children, n_leaves=leaves, saved_tokens=saved)]
    return [row(PART, path, depth=before, n_children=children), row(TOTAL, path, n_leaves=leaves, saved_tokens=saved)]


def boundary_rows(before: int, last: str, first: Sequence) -> list[tuple]:
    """What is counted twice between a shard that ends with the digests `last` and the next one."""
    shared = common_turns(last, first.codes)
    keys = [first.path]
    for code in split(first.codes[: shared * DIGEST]):
        keys.append(child_key(keys[-1], code))
    if first.next is not None and shared == len(first.words):
        keys[-1] = first.next
    leaves = saved = 0
    if shared * DIGEST == len(last):
        # The last sequence goes on in the next shard, or is its first one as well.
        leaves, saved = (-first.leaves, -first.saved) if first.leaves and last == first.codes else (-1, 0)
    out = []
    for d in range(shared, -1, -1):
        if d:
            saved += first.words[d - 1]
            out.append(row(PART, keys[d], depth=before + d, n_children=-(d < shared), n_leaves=leaves, saved_tokens=saved))
        else:
            out += root_rows(first.path, before, None, 0, -(d < shared), leaves, saved)
    return out


def trie_rows(batches: Iterator[pa.RecordBatch], before: int, shard_turns: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (path, codes, conv_id, words, next, ends, leaves, saved) -> rows of all shards."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    held: list[Sequence] = []
    turns, done = 0, None  # done: the last sequence of the shard before

    def edge_row(kind: int, s: Sequence) -> tuple:
        return row(
            kind, s.path, ends=s.codes, words=s.words, next=s.next, n_leaves=s.leaves, saved_tokens=s.saved, task=task, depth=before
        )

    def flush(last: bool) -> list[tuple]:
        nonlocal held, turns, done
        out = []
        if done is None:
            held[0].open = True
            out.append(edge_row(FIRST, held[0]))
        elif done.path == held[0].path:
            out += boundary_rows(before, done.codes, held[0])
        if last:
            held[-1].open = True
            out.append(edge_row(LAST, held[-1]))
        out += shard_rows(before, held)
        done, held, turns = held[-1], [], 0
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), NODE_ARROW.types)], schema=NODE_ARROW)

    for batch in batches:
        out = []
        for path, codes, conv_id, words, following, ends, leaves, saved in zip(*[c.to_pylist() for c in batch.columns]):
            if not held or held[-1].codes != codes or held[-1].path != path:
                if held and (turns >= shard_turns or held[-1].path != path):
                    out += flush(False)
                held.append(Sequence(path, codes, words, following, leaves, saved))
                turns += len(words) + 1
            held[-1].add(conv_id, ends)
        if out:
            yield batch_of(out)
    if held:
        yield batch_of(flush(True))


def _between_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digests of a task's last sequence, FIRST row of the next task) -> what is counted twice."""
    for batch in batches:
        rows = []
        for last, path, codes, words, following, leaves, saved, before in zip(*[c.to_pylist() for c in batch.columns]):
            rows += boundary_rows(before, last, Sequence(path, codes, words, following, leaves, saved))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), NODE_ARROW.types)], schema=NODE_ARROW)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, joined conv_ids) in order -> (key, sha256 of all of a key's conv_ids, joined)."""
    key, digest, done = None, None, []
    for batch in batches:
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["key", "ends"])
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "ends"])


def level_rows(rows: DataFrame, before: int, scratch: Scratch, shard_turns: int) -> DataFrame:
    """All rows of the trees of one level of segments, those between tasks included."""
    order = ["path", "codes", "conv_id"]
    placed = rows.select(*order, "words", "next", "ends", "leaves", "saved").repartitionByRange(*order).sortWithinPartitions(*order)
    table = scratch.save(placed.mapInArrow(lambda it: trie_rows(it, before, shard_turns), NODE_SCHEMA))
    last = table.where(f"kind = {LAST}").select("task", F.col("ends").alias("last"), F.col("key").alias("last_path"))
    ring = Window.partitionBy().orderBy("task")
    following = last.select("task", F.lead("task").over(ring).alias("after"))
    first = table.where(f"kind = {FIRST}").select(
        F.col("task").alias("after"), "key", "ends", "words", "next", "n_leaves", "saved_tokens", "depth"
    )
    between = (
        last.join(following, "task")
        .join(first, "after")
        .where("last_path = key")
        .select("last", "key", "ends", "words", "next", "n_leaves", "saved_tokens", "depth")
    )
    return table.unionByName(between.mapInArrow(_between_tasks, NODE_SCHEMA))


def prefix_trie(
    conversations: DataFrame, scratch: Scratch, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS
) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations (conv_id, turn, role, text)."""
    convs, turns = rebuilt(turn_rows(conversations), scratch)
    found = sequences(convs, turns, scratch, segment)
    deepest = found.agg(F.max("level")).first()[0]
    parts, totals = [], None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        rows = found.where(F.col("level") == level)
        if totals is None:
            rows = rows.withColumns({"leaves": F.lit(None).cast("bigint"), "saved": F.lit(None).cast("bigint")})
        else:
            rows = rows.join(totals, "next", "left")
        goes_on = found.where(F.col("level") == level + 1).select("conv_id").withColumn("on", F.lit(True))
        if level < deepest:
            rows = rows.join(goes_on, "conv_id", "left").withColumn("ends", F.col("on").isNull())
        else:
            rows = rows.withColumn("ends", F.lit(True))
        table = level_rows(rows, level * segment, scratch, shard_turns)
        parts.append(table)
        totals = (
            table.where(f"kind = {TOTAL}")
            .groupBy(F.col("key").alias("next"))
            .agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not parts:
        kinds = {"ends_sha256": "string"}
        return convs.select(*[F.lit(None).cast(kinds.get(c, "bigint")).alias(c) for c in columns])
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    hashed = (
        every.where(f"kind = {ENDS}")
        .repartition("key")
        .sortWithinPartitions("key", "conv_id")
        .select("key", "ends")
        .mapInArrow(_hash_ends, "key string, ends string")
    )
    nodes = every.where(f"kind = {PART}")
    merged = scratch.save(
        nodes.where("edge")
        .unionByName(hashed, allowMissingColumns=True)
        .groupBy("key")
        .agg(
            *[F.max(c).alias(c) for c in ("parent", "depth", "ends", "parent_edge")],
            *[F.min(c).alias(c) for c in ("conv_id", "parent_conv")],
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        )
    )
    names = ["parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "parent_edge", "parent_conv"]
    whole = nodes.where("not edge").select("key", *names).unionByName(merged.select("key", *names))
    # A node at an edge may have most of all nodes as children: both sides are salted.
    salts = 64
    parents = merged.select(
        F.col("key").alias("parent"), F.col("conv_id").alias("above"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    )
    below = whole.where("parent_edge").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    known = whole.where("parent_edge is null or not parent_edge").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv")))
    joined = below.join(parents, ["parent", "salt"]).withColumn("parent_conv_id", F.col("above"))
    both = known.select(*names, "parent_conv_id").unionByName(joined.select(*names, "parent_conv_id"))
    return both.withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))).select(*columns)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), Scratch(spark))
