"""Token ids, token files, packing and the language model against plain versions."""
import bisect
import collections
import gc
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import ngram_trie, packing, rans, tokens
from plumbline.llm.storage import Scratch
from plumbline.llm.words import text_slices, word_hashes

ODD = ["", None, " a", "a ", "a  b", "\n", "\n\na", "a\nb", "a\n b", "x\ty", "it's 'll don't", "a b", "é\né",
       "a\x1cb", "  ", "word" * 50, "A B\nC D\nE", "1 2\n3", "ÀÉ. ß, ﬁ İx", "a² b", "日本 語", "a…b – c", "x" * 100 + " y",
       "long " * 3000, "The end.\nNew line, and. more\nx", "a<|endoftext|>b", "a <|startoftext|> b\nc", "ΑΣ ΣΑΣ ªΑΣ. Σ"]
#: Pieces whose ids depend on their neighbours, on case rules or on special tokens.
PIECES = ["a", "b", "A", "É", "é", "Σ", "σ", "ς", "ΑΣ", "ª", " ", "  ", "\n", "\t", "\u2003", "\xa0", "\u3000", ".", ",", "'s", "'S",
          "1", "²", "½", "ß", "İ", "ı", "ﬁ", "日", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "-", "…", "\u200d", "👍",
          "\x1c", "\x85", "ǅ", "Å", "ϴ", "\u0345", "ά", "it's", "don't", "\u0301", "ᾼ", "ẞ", "가"]


def plain_ids(name, texts):
    """The ids as the library gives them, each text by itself."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name, lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_equal_the_tokenizer(name, lower, monkeypatch):
    coder = tokens.Encoder(public_tokenizers.path(name), lower)
    r = random.Random(8)
    texts = ODD + ["".join(r.choices(PIECES, k=r.randrange(9))) for _ in range(20_000)]
    want = plain_ids(name, texts)
    for limit in (tokens.MEMORY_BYTES, 50_000, 0):  # a full memory changes no id
        monkeypatch.setattr(tokens, "MEMORY_BYTES", limit)
        flat, sizes = coder.ids(pa.array(texts))
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == want
    assert plain_ids(name, ["a<|endoftext|>b"]) == [[320, 49407, 321] if lower else [64, 50256, 65]]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_BYTES", 10_000)
    coder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), True)
    for k in range(5):
        coder.ids(pa.array([" ".join(f"word{i}" for i in range(k * 500, k * 500 + 700))]))
        assert coder.held <= 10_000 + tokens.WORD_BYTES + tokens.LONGEST


def test_kept_words_need_no_python_objects():
    coder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    text = pa.array([" ".join(f"w{i}" for i in range(40_000))])
    coder.ids(text.slice(0, 0))
    tracemalloc.start()
    first = coder.ids(text)[0]
    gc.collect()
    grown = tracemalloc.get_traced_memory()[0] - first.nbytes
    tracemalloc.stop()
    assert grown < 60 * 40_000
    assert (coder.ids(text)[0] == first).all() and len(coder.words) == 40_000


@pytest.mark.parametrize("n", [0, 1, 5, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK + 17])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 50256).astype(np.uint32)
    data = rans.encode(ids, np.array([n]))
    assert (rans.decode(data)[0] == ids).all()
    if n > 2 * rans.BLOCK:
        assert (rans.decode(data, 1, 3)[0] == ids[rans.BLOCK : 3 * rans.BLOCK]).all()


def test_rans_detects_damage():
    whole = rans.encode(np.arange(70_000, dtype=np.uint32) % 999, np.array([70_000]))
    size = rans.HEAD.unpack_from(whole)[-1]
    for at in (rans.HEAD.size + 10, rans.HEAD.size + 4 + size + 3):
        data = bytearray(whole)
        data[at] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(data))


def documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a twin id"), (3, " a"), (None, "no id"), (5, ODD[5])]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))


def test_token_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark)
    got = rans.read_token_files(rans.write_token_files(docs, Scratch(spark), path)).collect()
    want = collections.Counter()
    rows = docs.collect()
    for r, ids in zip(rows, plain_ids("byte_bpe_50k.json", [r.text for r in rows])):
        ids = ids + [0]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id or -1 for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_packing_small_documents(spark):
    sizes = [1] * 700 + [3] * 200 + [900] * 5 + [1025] * 3 + [2047] * 4 + [1000, 24, 512, 512, 511]
    items = spark.createDataFrame(list(enumerate(sizes)), "bin bigint, size bigint")
    got = packing.best_fit(items, Scratch(spark)).collect()
    assert sorted(b for r in got for b in r.bins) == list(range(len(sizes)))
    assert all(sum(r.sizes) <= 2048 and [sizes[b] for b in r.bins] == r.sizes for r in got)
    assert len(got) <= -(-sum(sizes) // 2048) + 4


def plain_best_fit(sizes, capacity):
    """Sequences that best fit in falling order of size takes."""
    gaps, used = [], 0
    for size in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, size)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        used += gap == capacity
        if gap > size:
            bisect.insort(gaps, gap - size)
    return used


def test_pieces_and_sequences_equal_plain_versions(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(["word", "Other", "ΑΣ", "1", "<|endoftext|>", "x.y"], k=int(r.paretovariate(0.7)) % 300))) for i in range(400)]
    rows += [(i, t) for i, t in enumerate(ODD, 1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = packing.pack_documents(docs, Scratch(spark), public_tokenizers.path("word_bpe_49k.json"), 128).collect()
    want = set()
    for (key, _), ids in zip(rows, plain_ids("word_bpe_49k.json", [t for _, t in rows])):
        ids = np.array([*ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 128)):
            own = ids[start : start + 128]
            want.add((key, piece, start, len(own), zlib.crc32(own.tobytes())))
    assert {(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got} == want
    best = plain_best_fit([n for _, _, _, n, _ in want], 128)
    assert len({x.sequence_id for x in got}) <= best + max(2, best // 50)


def test_packing_of_documents(spark):
    docs = documents(spark)
    got = packing.pack_documents(docs, Scratch(spark), public_tokenizers.path("word_bpe_49k.json"), 64).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    pieces = collections.Counter(r.doc_id for r in got if r.piece == 0)
    assert sum(pieces.values()) == docs.count()
    assert max(r.piece for r in got if r.doc_id == 23) > 10


def test_empty(spark):
    docs = documents(spark).limit(0)
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack_documents(docs, Scratch(spark), path).count() == 0
    assert rans.read_token_files(rans.write_token_files(docs, Scratch(spark), path)).count() == 0
    assert ngram_trie.score_documents(docs, F.lit(True), Scratch(spark)).count() == 0


def test_word_hashes():
    texts = ["A b\tc", None, "", "  ", "a B\nc ", "ab c"]
    hashes, before = word_hashes(pa.array(texts).slice(0))
    own = [hashes[a:b].tolist() for a, b in zip(before, before[1:])]
    assert own[0] == own[4] and not own[1] and not own[2] and not own[3] and own[5][1] == own[0][2]
    batch = pa.record_batch([pa.array(["x" * 50, None, "y" * 10, "z"] * 5)], ["t"])
    assert sum(len(s) for s in text_slices(iter([batch]), 0, 64)) == 20


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((1, 5), (10, 100), (1000, 1 << 40), (5000, 3000)):
        values = np.sort(r.integers(0, top, n).astype(np.uint64))
        coded = ngram_trie.EliasFano(values)
        assert (coded.access(np.arange(n)) == values).all()
        asked = np.append(r.integers(0, top + 5, 500).astype(np.uint64), values)
        assert (coded.successor(asked) == np.searchsorted(values, asked)).all()


def test_language_model_equals_counts(spark):
    r = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{k}" for k in r.zipf(1.4, 30) if k < 60)) for i in range(300)] + [(900, None), (901, "unseen words only")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = F.col("doc_id") % 3 != 0
    got = {x.doc_id: x for x in ngram_trie.score_documents(docs, train, Scratch(spark)).collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    chains = {k: [None, *word.findall(t or ""), 0] for k, t in rows}
    learned = [c for k, c in chains.items() if k % 3]
    one = collections.Counter(w for c in learned for w in c[1:])
    two = collections.Counter(p for c in learned for p in zip(c, c[1:]))
    context = collections.Counter(p[0] for c in learned for p in zip(c, c[1:]))
    after = collections.Counter(p[0] for p in two)
    n, v = sum(one.values()), len(one)
    u1, u2 = (sum(c == k for w, c in one.items() if w != 0) for k in (1, 2))
    d1 = u1 / (u1 + 2 * u2) if u1 and u2 else 0.75
    for key, chain in chains.items():
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in chain[1:])
        score = 0.0
        for a, b in zip(chain, chain[1:]):
            p = (one[b] - d1 if one[b] else d1 * v) / n
            if context[a]:
                p = (two[a, b] + after[a] * p) / (context[a] + after[a])
            score += math.log10(p)
        assert got[key].base_score == pytest.approx(base)
        assert got[key].score == pytest.approx(score, abs=0.02 * len(chain))
        assert got[key].n_known == sum(w in one for w in chain[1:])
        assert got[key].train_tokens == n


def test_marks_behind_letters_are_parts_of_their_own():
    from plumbline.llm.tokens import parts

    texts = pa.array(["ab, cd. x1, e.f", "g,", None, ",h\u00e9, i"])
    found, owner = parts(texts)
    assert found.to_pylist() == ["ab", ",", " cd", ".", " x1,", " e.f", "g", ",", ",h\u00e9,", " i"]
    assert owner.tolist() == [0] * 6 + [1] * 2 + [3] * 2


def test_ranks_of_small_and_large_ids():
    for top in (5, 50_000, 1 << 30):
        ids = np.random.default_rng(1).integers(0, top, 3000).astype(np.uint32)
        symbols, rank = rans._ranked(ids)
        want, place = np.unique(ids, return_inverse=True)
        assert (symbols == want).all() and (rank == place).all() and symbols.dtype == want.dtype
