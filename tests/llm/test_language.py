"""The language query against a plain version: counts of n-grams in dictionaries, votes by loops."""
import math
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import language

WORDS = {
    "de": "der die und nicht ich wir straße haus gestern morgen für über schön".split(),
    "en": "the and not i we street house yesterday morning for over nice with".split(),
    "fr": "le la et pas je nous rue maison hier matin pour sur très beau".split(),
    "es": "el los y no yo nosotros calle casa ayer mañana para sobre hermoso".split(),
    "zz": "qua zor plim nakto vesh urru tikka zamm oppo".split(),
}


def texts():
    rng = random.Random(5)
    rows = [
        (i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([3, 8, 30]))), lang, "a")
        for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(160))
    ]
    rows += [(500, None, "de", "a"), (501, "", "en", "a"), (502, "12 34 !", "fr", None), (503, "Der Straße", None, "b")]
    rows += [(504, "the house and " * 1_000, "en", "b"), (505, "und nicht", "de", "b"), (505, "und nicht", "de", "b")]
    return rows


def plain_features(text):
    """Counts of hashed 1- to 3-grams by whole-number arithmetic, one n-gram at a time."""
    words = " ".join(re.findall(r"[^\W\d_]+", text or "")).lower()
    if not words:
        return None
    codes, mask, counts = [ord(c) for c in f" {words} "], (1 << 64) - 1, {}
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            key = 0
            for m, code in enumerate(codes[i : i + n], 1):
                key = (key * 0x9E3779B1 + code + m) & mask
            place = ((((key ^ (key >> 15)) * 0x85EBCA77C2B2AE63) & mask) >> 40) % language.WIDTH
            counts[place] = counts.get(place, 0) + 1
    length = math.sqrt(sum(counts.values()))
    return {place: math.sqrt(c) / length for place, c in counts.items()}


def plain_vote(names, machines, x):
    votes, margins, shares = {}, {}, {}
    for one in names:
        for other in names:
            if one == other:
                continue
            (w, c), sign = (machines[one, other], 1) if (one, other) in machines else (machines[other, one], -1)
            m = sign * (sum(w[i] * v for i, v in x.items()) + c)
            votes[one] = votes.get(one, 0) + (m > 0)
            margins[one] = margins.get(one, 0.0) + m
            shares[one] = shares.get(one, 0.0) + 1 / (1 + math.exp(-2 * max(-30, min(30, m))))
    if len(names) == 1:
        return names[0], 1.0
    best = max(names, key=lambda k: (votes[k], margins[k]))
    return best, shares[best] / (len(names) - 1)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id bigint, text string, lang string, source string")


@pytest.fixture(scope="module")
def learned(spark, docs, tmp_path_factory):
    """The rows that the query may learn from, the model that it learned and its result."""
    folder, fit, models = str(tmp_path_factory.mktemp("tables")), language.fit, []
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")

    def spy(*args):
        models.append(fit(*args))
        return models[-1]

    partitions = language.FIT_PARTITIONS
    language.fit, language.FIT_PARTITIONS = spy, 1  # a hundred rows: a job for each step, not eight tasks
    try:
        got = language.op9_language(spark, folder).collect()
    finally:
        language.fit, language.FIT_PARTITIONS = fit, partitions
    return [r for r in texts() if zlib.crc32(str(r[0]).encode()) % 4 != 2], models[0], got


def test_query_equals_the_plain_version(learned):
    _, model, got = learned
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in texts())
    assert {f: sorted(m) for f, m in model["groups"].items()} == {
        "germanic": ["de", "en"], "romance": ["es", "fr"], "zz": ["zz"]
    }
    by_id = {r[0]: r for r in texts()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        x = plain_features(by_id[r.doc_id][1])
        if x is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        family, sure = plain_vote(sorted(model["groups"]), model["between"], x)
        lang, also = plain_vote(model["groups"][family], model["within"], x)
        assert r.lang_pred == lang and r.score == pytest.approx(sure * also, abs=1e-6)
    right = [r.lang_pred == by_id[r.doc_id][2] for r in got if r.held_out and by_id[r.doc_id][2] and plain_features(by_id[r.doc_id][1])]
    assert sum(right) >= 0.9 * len(right)


def test_machines_are_near_the_least_objective(learned):
    """Mean hinge loss with the squared norm, against plain subgradient steps from zero."""
    known, model, _ = learned
    rows = [(plain_features(t), lang) for _, t, lang, _ in known if lang and plain_features(t)]
    for (a, b), (w, c) in model["within"].items():
        mine = [(x, 1.0 if lang == a else -1.0) for x, lang in rows if lang in (a, b)]
        matrix, y = np.zeros((len(mine), language.WIDTH)), np.array([s for _, s in mine])
        for i, (x, _) in enumerate(mine):
            matrix[i, list(x)] = list(x.values())

        def objective(v, d):
            return np.maximum(0, 1 - y * (matrix @ v + d)).mean() + 1e-4 / 2 * (v @ v)

        v, d, least = np.zeros(language.WIDTH), 0.0, 1.0
        for step in range(1, 300):
            inside = y * (matrix @ v + d) < 1
            rate = 8 / math.sqrt(step)
            v = v - rate * (1e-4 * v - (y * inside) @ matrix / len(y))
            d = d + rate * float((y * inside).mean())
            least = min(least, objective(v, d))
        assert objective(w, c) <= least + 0.01


def test_neither_order_nor_other_columns_matter(docs, learned, spark):
    _, model, _ = learned
    rows = docs.selectExpr("doc_id", "false held_out", "text", "'x' lang", "'y' features", "0 lang_pred")
    one = language.predict(rows, model).collect()
    two = language.predict(rows.repartition(5, "text").drop("lang"), model).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    assert language.predict(rows.limit(0), model).count() == 0
