"""The language model of word triples, against plain counts and over shards and cuts."""
import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ngram_trie
from plumbline.llm.storage import Scratch


def documents(spark):
    r = np.random.default_rng(7)
    rows = [(i, " ".join(f"the w{k}" if k % 3 else f"w{k}" for k in r.zipf(1.3, 30) if k < 80)) for i in range(300)]
    rows += [(900, None), (901, "unseen words only"), (902, "w1"), (903, " ".join(["the"] * 50)), (904, " ".join(["the"] * 40))]
    rows += [rows[4], (None, rows[5][1])]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).checkpoint()


def train():
    return F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))


def test_triples_equal_counts(spark):
    rows, docs = documents(spark)
    got = collections.defaultdict(list)
    for x in ngram_trie.score_documents(docs, train(), Scratch(spark), 3).collect():
        got[x.doc_id].append(x)
    chains = [(k, [None, *(t or "").split(), 0]) for k, t in rows]
    learned = [c for k, c in chains if k is None or k % 3]
    one = collections.Counter(w for c in learned for w in c[1:])
    two = collections.Counter(p for c in learned for p in zip(c, c[1:]))
    three = collections.Counter(p for c in learned for p in zip(c, c[1:], c[2:]))
    context, couple = collections.Counter(), collections.Counter()
    for (a, _), k in two.items():
        context[a] += k
    for (a, b, _), k in three.items():
        couple[a, b] += k
    after, follow = collections.Counter(p[0] for p in two), collections.Counter(p[:2] for p in three)
    n, v = sum(one.values()), len(one)
    u1, u2 = (sum(c == k for w, c in one.items() if w != 0) for k in (1, 2))
    d1 = u1 / (u1 + 2 * u2) if u1 and u2 else 0.75
    apart = 0
    for key, chain in chains:
        score = two_only = 0.0
        for i, (a, b) in enumerate(zip(chain, chain[1:])):
            p = (one[b] - d1 if one[b] else d1 * v) / n
            if context[a]:
                p = (two[a, b] + after[a] * p) / (context[a] + after[a])
            two_only += math.log10(p)
            if i and couple[chain[i - 1], a]:
                c = (chain[i - 1], a)
                p = (three[*c, b] + follow[c] * p) / (couple[c] + follow[c])
            score += math.log10(p)
        apart += abs(score - two_only) > 0.5
        assert len(got[key]) == sum(k == key for k, _ in rows)
        for x in got[key]:
            assert x.score == pytest.approx(score, abs=0.02 * len(chain))
            assert x.n_known == sum(w in one for w in chain[1:]) and x.train_tokens == n
    assert apart > 200


def test_triples_do_not_depend_on_shards(spark, monkeypatch):
    _, docs = documents(spark)

    def scores():
        return sorted((tuple(x) for x in ngram_trie.score_documents(docs, train(), Scratch(spark), 3).collect()), key=str)

    one = scores()
    cuts = []
    found = ngram_trie.large_triples
    monkeypatch.setattr(ngram_trie, "large_triples", lambda *a: cuts.append(found(*a)) or cuts[-1])
    for tokens, entries, block in ((600, 1 << 40, 6 << 20), (2_000, 200, 4_000), (1 << 40, 30, 6 << 20), (900, 400, 2_000)):
        for name, value in (("SHARD_TOKENS", tokens), ("PIECE_ENTRIES", entries), ("BLOCK_BYTES", block)):
            monkeypatch.setattr(ngram_trie, name, value)
        assert scores() == one
    assert not any(cuts[0]) and all(cuts[1]) and all(cuts[2])


def test_query_has_three_levels(spark, tmp_path):
    _, docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    own = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    two, three = ({tuple(x) for x in ngram_trie.score_documents(docs, own, Scratch(spark), k).collect()} for k in (2, 3))
    got = {tuple(x) for x in ngram_trie.op2_language_model(spark, str(tmp_path)).collect()}
    assert got == three and got != two


def test_packed_arrays_and_single_asks():
    r = np.random.default_rng(3)
    arrays = [r.integers(0, top, n).astype(np.uint64) for top, n in ((1, 0), (200, 9), (1 << 20, 100), (1 << 63, 7))]
    assert all((a == b).all() for a, b in zip(arrays, ngram_trie._unpack(ngram_trie._pack(arrays[:2], [arrays[2]], [arrays[3]])), strict=True))
    values = np.sort(r.integers(0, 1 << 40, 5000).astype(np.uint64))
    coded = ngram_trie.EliasFano(values)
    for asked in (values[::10], values):  # by selection, and in order
        assert (coded.successor(asked + np.uint64(1)) == np.searchsorted(values, asked + np.uint64(1))).all()
        assert (coded.access(np.arange(len(asked))) == values[: len(asked)]).all()


def test_triples_of_few_texts(spark):
    def scores(rows, learned):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        return {x.doc_id: x for x in ngram_trie.score_documents(docs, F.lit(learned), Scratch(spark), 3).collect()}

    assert not scores([], True)
    nulls = scores([(1, None), (2, ""), (3, " \n")], True)
    assert len(nulls) == 3 and all(x.n_tokens == x.n_known == 1 and x.train_tokens == 3 for x in nulls.values())
    unlearned = scores([(1, "a b c"), (2, None)], False)
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.held_out) for x in (unlearned[1], unlearned[2])] == [(4, 0, 0, True), (1, 0, 0, True)]
    with pytest.raises(ValueError):
        ngram_trie.score_documents(spark.createDataFrame([], "doc_id bigint, text string"), F.lit(True), Scratch(spark), 4)
