"""Personal data against plain regular expressions and a plain scoring of the pattern graph."""
import collections
import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from plumbline.llm import personal
from plumbline.llm.storage import Scratch

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain_base(text):
    spans = [
        (m.start(), k, m.end()) for k, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text) if fits(kind, m.group())
    ]
    return sorted(spans)


def test_base_equals_plain_rules():
    r = random.Random(7)
    bits = ["a", "b.c", "@", "@x.y", ".", "-", "+", "+1", " ", "  ", "(", ")", "12", "255", "256", "007", "4111111111111111", "4111 1111-1111 1111",
            "+1 (269) 555-3296", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "\n", "é", "٣", "٤٥", "joe@mail.example.com", "%", "_", ",", "5"]
    for _ in range(20_000):
        text = "".join(r.choices(bits, k=r.randrange(12)))
        assert personal.base_spans(text) == plain_base(text), text


def test_long_texts_are_linear():
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "a@" * 400_000, "a@b." * 200_000, "+1" + " " * 1_000_000, "+1 (" * 250_000, "1 - " * 250_000, "x1" * 400_000, "1\xa0" * 300_000):
        start = time.time()
        base = personal.base_spans(text)
        personal.entities(text, base)
        assert time.time() - start < 12


def documents(spark, n=400):
    r = random.Random(2)
    number = lambda k: "".join(r.choices("123456789", k=k))
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = []
    for i in range(n):
        filler = " ".join(r.choices(words, k=12))
        kind = i % 5
        if kind == 0:
            text = f"{filler} call me on +1 {number(3)} {number(3)} {number(4)} today {filler}"
        elif kind == 1:
            text = f"{filler} write to {r.choice('abc')}{number(4)}@mail.example.com please {filler}"
        elif kind == 2:
            text = f"{filler} invoice {number(r.randrange(3, 9))} paid {filler}"
        elif kind == 3:
            text = f"{filler} reading was {number(8)} units near {number(2)}.{number(2)}.{number(2)}.{number(2)} end {filler}"
        else:
            text = f"{filler} of {r.choice(['+1 ' + number(10), number(7), 'x@y.example', number(12)])} and {filler}"
        rows.append((i, text))
    rows += [(1000, "wa wb call me on 4445556666 today wc"), (1001, "write to joe@localhost please"), (1002, "write to him please"), (1003, "reading was 77788899 units")]
    rows += [(1004, f"id {rows[0][1].split('+')[1][:14].replace(' ', '-')} there"), (1005, None), (1006, ""), (None, "call me on 7778889999 today"), (1000, "wa wb call me on 4445556666 today wc")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit("clash")).withColumn("value", F.lit(1))


def plain_scores(rows, support, confident, accept, rounds):
    """Accepted (value, kind) by loops over the same entities."""
    edges, seeds, allowed = collections.defaultdict(set), set(), set()
    for text in rows:
        text = text or ""
        for e in personal.entities(text, personal.base_spans(text)):
            for p in e["patterns"]:
                edges[p].add(e["value"])
            (seeds if e["base"] else allowed).update((e["value"], k["kind"]) for k in e["kinds"])
    found = {}
    for _ in range(rounds):
        known = {**found, **{s: 1.0 for s in seeds}}
        strong = {}
        for p, values in edges.items():
            for kind in range(4):
                own = [known[v, kind] for v in values if (v, kind) in known]
                if len(own) >= support and sum(own) / (len(values) + 1) >= confident:
                    strong[p, kind] = sum(own) / (len(values) + 1)
        miss = collections.defaultdict(lambda: 1.0)
        for (p, kind), c in strong.items():
            for v in edges[p]:
                if (v, kind) in allowed:
                    miss[v, kind] *= 1 - c
        found = {s: 1 - m for s, m in miss.items() if 1 - m >= accept}
    return set(found)


def test_patterns_find_unseen_identifiers(spark):
    docs = documents(spark)
    rows = docs.collect()
    got = personal.personal_data(docs, Scratch(spark)).collect()
    assert len(got) == len(rows)
    accepted = plain_scores([r.text for r in rows], personal.SUPPORT, personal.CONFIDENT, personal.ACCEPT, personal.ROUNDS)
    known = set()
    for r in rows:
        for e in personal.entities(r.text or "", personal.base_spans(r.text or "")):
            known |= {(k["known"], k["kind"]) for k in e["kinds"] if e["base"]}
    want = collections.Counter()
    for r in rows:
        text = r.text or ""
        base = plain_base(text)
        added = {
            (e["start"], k["kind"], e["end"]) for e in personal.entities(text, personal.base_spans(text)) if not e["base"]
            for k in e["kinds"] if (e["value"], k["kind"]) in accepted or (k["known"], k["kind"]) in known
        }
        assert len({(a, b) for a, _, b in added}) == len(added)
        digest = hashlib.sha256(personal.joined(base).encode()).hexdigest()
        counts = [sum(k == own for _, k, _ in base) for own in range(4)]
        want[(r.doc_id, *counts, digest, personal.joined(sorted([*base, *added])))] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    spans = {r.doc_id: r.spans for r in got}
    assert spans[1000] == "phone:17:27" and spans[None] == "phone:11:21" and spans[1001] == "email:9:22"
    assert spans[1004].startswith("phone:3:") and spans[1003] == spans[1002] == spans[1005] == spans[1006] == ""
    assert personal.personal_data(docs.limit(0), Scratch(spark)).count() == 0
