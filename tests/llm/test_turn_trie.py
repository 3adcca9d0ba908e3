"""The conversation trie against a plain one, with shards and segments of all sizes."""
import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import turn_trie
from plumbline.llm.storage import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, n=140):
    r = random.Random(4)
    says = ["hello there", "", None, "what is it", "a b c d", "x  y", "long " * 30, "Ünï code"]
    rows = []
    for c in range(n):
        if c % 23 == 5:
            continue
        same = r.random() < 0.35
        for t in range(r.choice([1, 2, 3, 3, 4, 6])):
            role = None if r.random() < 0.05 else ("user", "assistant")[t % 2]
            rows.append((c, None if t == 0 and r.random() < 0.1 else t, role, says[t] if same else r.choice(says)))
    rows += [(200, t, "user", f"turn {t} of many") for t in range(60)] + [(201, t, "user", f"turn {t} of many") for t in range(60)]
    rows += [(202, t, "user", f"turn {t} of many" if t != 45 else "other") for t in range(60)] + [(203, t, "user", f"turn {t} of many") for t in range(16)]
    rows += [(7, 1, "user", "same turn"), (7, 1, "user", "same turn"), (7, 1, "system", "same turn"), (None, 0, "user", "lost"), (-45, 0, "user", "below")]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("words", F.lit("clash")).withColumn("code", F.lit(0))


def plain(rows):
    own = collections.defaultdict(list)
    for x in rows:
        if x.conv_id is not None:
            role, text = x.role or "", x.text or ""
            code = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[x.conv_id].append((x.turn is not None, x.turn or 0, role, code, text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        convs[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, own_members in members.items():
        gain = (len(own_members) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += not children[p]
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return collections.Counter(out)


def found(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("segment, shard_turns, chunk", [(16_384, 200_000, 50_000), (16_384, 7, 3), (4, 30, 2), (15, 1, 1)])
def test_equals_a_plain_trie(spark, monkeypatch, segment, shard_turns, chunk):
    monkeypatch.setattr(turn_trie, "CHUNK_IDS", chunk)
    df = table(spark)
    want = plain(df.collect())
    got = turn_trie.prefix_trie(df, Scratch(spark), segment, shard_turns)
    assert got.columns[0] == "conv_id" and found(got) == want


def test_copies_and_nothing(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 600) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert found(turn_trie.prefix_trie(df, Scratch(spark), shard_turns=2)) == plain(df.collect())
    assert turn_trie.prefix_trie(df.limit(0), Scratch(spark)).count() == 0
    lone = spark.createDataFrame([(1, 0, "user", "x")], df.schema)
    assert found(turn_trie.prefix_trie(lone, Scratch(spark))) == plain(lone.collect())
    none = spark.createDataFrame([(None, 0, "user", "x")], df.schema)
    assert turn_trie.prefix_trie(none, Scratch(spark)).count() == 0


def test_tree_is_balanced():
    tree = turn_trie.Tree()
    tree.by_medians([[i] for i in range(1023)])
    depth = {tree.top: 1}
    todo = [tree.top]
    while todo:
        node = todo.pop()
        for child in (tree.low[node], tree.high[node]):
            if child:
                depth[child] = depth[node] + 1
                todo.append(child)
    assert len(depth) == 1023 and max(depth.values()) == 10
