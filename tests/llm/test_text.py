"""Similarity join, quality rules, fingerprints, language, secrets and pipeline against plain versions."""
import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import fingerprint, jaccard, language, mixing, quality, secrets
from plumbline.llm.storage import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def corpus(spark):
    """Copies, near copies, shared passages, short, empty and null texts, repeated rows, clashing columns."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(words, k=60))
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(" ".join(r.choices(words, k=30)) for _ in range(4))))
    base = rows[0][1].split(" ")
    for i in range(100, 140):
        edited = list(base)
        for _ in range(1 + i % 3):
            edited[r.randrange(len(edited))] = f"e{i}"
        rows.append((i, " ".join(edited)))
    rows += [(200 + i, rows[1][1].upper() if i % 2 else rows[1][1]) for i in range(15)]
    rows += [(300 + i, passage + "\n" + " ".join(r.choices(words, k=20 + 9 * i))) for i in range(20)]
    rows += [(400, None), (401, ""), (402, "  \n"), (403, "one two"), (404, "One two"), (405, "x"), (None, rows[2][1]), (7, rows[7][1]), (7, "other text")]
    out = [(k, t, "en", f"s{(k or 0) % 3}" if k != 5 else None, 0, "c") for k, t in rows]
    return spark.createDataFrame(out, "doc_id bigint, text string, lang string, source string, n_chars int, class string")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("cluster_elements", [1_000_000, 200])
def test_components_equal_all_pairs(spark, cluster_elements):
    docs = corpus(spark)
    rows = [(r.doc_id, shingle_set(r.text)) for r in docs.collect()]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, s) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    want = collections.Counter((k, len(s), None if k is None else k if not s else least[find(i)]) for i, (k, s) in enumerate(rows))
    got = jaccard.link_documents(docs, Scratch(spark), cluster_elements).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_one_of_each_group(spark):
    docs = corpus(spark)
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 1 in ids and 200 not in ids and 403 in ids and 404 not in ids and 400 in ids and None in ids


def test_one_row_of_each_class(spark):
    base = [f"w{i}" for i in range(40)]
    near, other = " ".join([*base, "more"]), " ".join(f"o{i}" for i in range(40))
    rows = [(3, " ".join(base), 1), (5, near, 2), (5, other, 3), (5, other, 4), (6, " ".join(base), 5), (5, None, 6), (5, None, 6), (None, other, 7)]
    rows += [(3, "quite another text of more than five words", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _first int")
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = sorted((r["_first"] for r in kept.collect()))
    assert got in ([1, 3, 6, 6, 7, 8], [1, 4, 6, 6, 7, 8])


def test_lines_are_counted_by_document(spark):
    rows = [(i, f"a shared line of the site\nown words {i % 5} " + " ".join(f"t{i % 5}x{k}" for k in range(60)), "s") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    judged, frequent = quality.verdicts(docs, "source", Scratch(spark))
    counts = sorted(r.documents for r in frequent.collect())
    assert counts == [100] * 5 + [500]
    # Each text is the first to hold its own line, so only the shared one goes, and not from the first text.
    assert {(r.doc_id % 5 > 0, r.removed_words) for r in judged.collect()} == {(False, 0), (True, 6)}


def test_clashing_names_pass_through(spark):
    names = ["_text", "_removed", "_host", "_spans", "_hash", "_whole", "_id", "_key", "_copy", "_all", "_first", "row", "host", "text_hash",
             "removed", "spans", "number", "hash", "key", "size", "start", "class", "one", "n"]
    docs = corpus(spark).drop("class")
    extra = docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    for stage in (quality.clean_documents, secrets.masked_documents, mixing.mixed_documents, jaccard.one_of_each_group):
        plain, out = stage(docs), stage(extra)
        assert out.columns == extra.columns
        bad = " or ".join(f"`{n}` <> concat('{n}', coalesce(cast(doc_id as string), '-'))" for n in names)
        assert out.where(bad).count() == 0
        assert sorted(map(repr, out.select(*docs.columns).collect())) == sorted(map(repr, plain.collect()))


def test_quality_measures(spark):
    def plain(text):
        w, lines, seen, dup = WORD.findall(text or ""), (text or "").split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        at = collections.defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        inside = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)

    r = random.Random(1)
    texts = [None, "", "a", "a b c", "a a a a", "x\nx\n \nx", "#* a|b"] + [" ".join(r.choices("abcd\n", k=40)) for _ in range(40)]
    assert [quality.measure(t)[:5] for t in texts] == [plain(t) for t in texts]


def test_quality_verdicts(spark):
    docs = corpus(spark)
    rows = docs.collect()
    judged, _ = quality.verdicts(docs, "source", Scratch(spark), 4)
    texts = collections.defaultdict(lambda: collections.defaultdict(list))
    assert judged.count() == len(rows)
    norm = lambda x: " ".join(WORD.findall(x)).translate(LOWER)
    for r in rows:
        for line in {norm(x) for x in (r.text or "").split("\n")} - {""}:
            texts[r.source, line][r.text].append(1 << 62 if r.doc_id is None else r.doc_id)
    gone = collections.Counter()
    for (source, line), holders in texts.items():
        if sum(map(len, holders.values())) > 4:
            first = min(holders, key=lambda t: min(holders[t]))
            for t in holders:
                if t != first:
                    gone[source, t] += sum(len(WORD.findall(x)) for x in t.split("\n") if norm(x) == line)
    got = collections.Counter((r.doc_id, r.removed_words, r.kept) for r in judged.collect())
    want = collections.Counter()
    for r in rows:
        n, _, _, _, again = quality.measure(r.text)[:5]
        lost = gone[r.source, r.text]
        want[r.doc_id, lost, not (n < 50 or 100 * again > 50 * n) and 2 * lost <= n] += 1
    assert got == want and any(gone.values())
    docs = docs.withColumn("removed", F.lit(1)).withColumn("host", F.lit(2))
    clean = quality.clean_documents(docs)
    assert clean.columns == docs.columns and clean.count() == sum(r.kept for r in quality.verdicts(docs, "source", Scratch(spark))[0].collect())


def test_fingerprint_extensions():
    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choices("ab", k=r.randrange(30))) for _ in range(2))
        x, y = fingerprint.Hashed(a), fingerprint.Hashed(b)
        i, j = r.randrange(len(a) + 1), r.randrange(len(b) + 1)
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert fingerprint.extension(x, i, y, j) == n
    assert fingerprint.likeness(fingerprint.Hashed(""), fingerprint.Hashed("")) == 1


def test_fingerprints_of_neighbours(spark):
    docs = corpus(spark).where("doc_id is not null and doc_id <> 7")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.neighbour_fingerprints(docs, Scratch(spark)).collect()}
    assert len(got) == len(rows)
    for (k, t), (_, f) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + f[:half]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k].n_chars == len(t) and 0 <= got[k].near_next <= 1
        assert got[k].near_edited >= (0.5 if t else 1)
    prints = collections.defaultdict(set)
    for k, t in rows:
        prints[t].add(got[k].fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({p for s in prints.values() for p in s}) == len(prints)
    assert fingerprint.neighbour_fingerprints(docs.limit(0), Scratch(spark)).count() == 0
    lone = fingerprint.neighbour_fingerprints(docs.where("doc_id = 1"), Scratch(spark)).collect()
    assert len(lone) == 1 and lone[0].near_next == 1


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.001"
    got = language.op9_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    hits = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert hits > 0.95
    docs = spark.createDataFrame([(1, False, None), (2, True, "12 !"), (3, True, "Hallo")], "doc_id bigint, held_out boolean, text string")
    one = {"groups": {"germanic": ["de"]}, "between": {}, "within": {}}
    assert [(r.lang_pred, r.score) for r in language.predict(docs, one).collect()] == [("und", 0.0), ("und", 0.0), ("de", 1.0)]
    none = language.fit(docs.withColumn("lang", F.lit(None).cast("string")), Scratch(spark))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}


def test_secrets(spark):
    key = "9f" * 10 + "c3" * 10
    rows = [(i, f'Some words here token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and more', "a/b") for i in range(40)]
    rows += [(100 + i, f"commit {hashlib.sha1(str(-i).encode()).hexdigest()} fixed version 123456789012{i}", "docs") for i in range(40)]
    rows += [(None, f"password: {key}x", None), (500, None, "x"), (501, "", "x"), (100, rows[0][1], "a/b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("start", F.lit(0))
    found = secrets.scan(docs, Scratch(spark)).collect()
    hit = [r for r in found if r.is_secret]
    assert {r.doc_id for r in hit} == {*range(40), 100, None}
    masked = secrets.masked_documents(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    texts = {r.doc_id: r.text for r in masked.collect() if r.doc_id != 100}
    assert texts[0] == 'Some words here token = "<secret>" and more' and texts[120] == rows[60][1]
    assert texts[None] == "password: <secret>" and texts[500] is None
    assert secrets.scan(docs.limit(0), Scratch(spark)).count() == 0


def test_pipeline(spark, tmp_path):
    docs = corpus(spark).drop("class")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    scratch, now = Scratch(spark), docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.save(stage(spark, now, str(tmp_path)))
        seen.append((name, now.count()))
        if name != "packing":
            assert now.columns == docs.columns
    assert [n for n, _ in seen] == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "packing"]
    counts = dict(seen)
    assert counts["secret_scan"] == counts["near_duplicates"] < counts["quality_rules"] < docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts["packing"]
    assert now.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    corpus(spark).drop("class").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
