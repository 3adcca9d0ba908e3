"""Scores of the language model do not depend on shards, cuts of contexts or blocks."""
import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import ngram_trie
from plumbline.llm.storage import Scratch


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"the w{k}" for k in r.zipf(1.3, 40) if k < 3000)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).checkpoint()
    train = F.col("doc_id") % 3 != 0

    def scores():
        return {x.doc_id: tuple(x) for x in ngram_trie.score_documents(docs, train, Scratch(spark)).collect()}

    one = scores()
    cuts = []
    found = ngram_trie.large_contexts
    monkeypatch.setattr(ngram_trie, "large_contexts", lambda *a: cuts.append(found(*a)) or cuts[-1])
    for tokens, entries, block in ((600, 1 << 40, 6 << 20), (2_000, 500, 20_000), (1 << 40, 60, 6 << 20)):
        for name, value in (("SHARD_TOKENS", tokens), ("PIECE_ENTRIES", entries), ("BLOCK_BYTES", block)):
            monkeypatch.setattr(ngram_trie, name, value)
        assert scores() == one
    assert not cuts[0] and cuts[1] and cuts[2]


def test_every_large_context_is_cut(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"the w{k} of x{k % 50}" for k in r.integers(0, 900, 30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).checkpoint()
    blocks = Scratch(spark).save(docs.select("doc_id", F.lit(True).alias("train"), "text").mapInArrow(ngram_trie._blocks, ngram_trie.BLOCK_SCHEMA))
    all_of = blocks.mapInArrow(ngram_trie._entries(1), "context bigint, entries bigint").groupBy("context").agg(F.sum("entries").alias("n")).collect()
    for most in (40, 300, 2000):
        pieces = ngram_trie.large_contexts(blocks, blocks.count(), most)
        assert {x.context for x in all_of if x.n > most} <= pieces.keys() <= {x.context for x in all_of if x.n > most // 2}
