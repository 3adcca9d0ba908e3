"""Near copies with edits at both ends and in between are alike, unrelated texts are not."""
import difflib
import random
import time

import pytest

from plumbline.llm.fingerprint import Hashed, likeness


def test_scattered_edits():
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 9))) for _ in range(2000)]
    text = r.choices(words, k=400)
    for edits in ([0, 399], [0, 80, 160, 240, 320, 399], [*range(0, 400, 12), 399]):
        other = list(text)
        for k in edits:
            other[k] = "changed" * (1 + k % 3)
        a, b = Hashed(" ".join(text)), Hashed(" ".join(other))
        assert 0.7 < likeness(a, b) <= 1 and 0.7 < likeness(b, a) <= 1
    assert likeness(a, Hashed(" ".join(r.choices(words, k=400)))) < 0.1
    assert likeness(a, a) == 1 and likeness(a, Hashed("")) == 0
    gone = text[1:100] + text[140:399]
    assert likeness(a, Hashed(" ".join(gone))) > 0.85


def test_likeness_is_a_share():
    r = random.Random(6)
    for _ in range(100):
        a, b = ("".join(r.choices("ab", k=r.randrange(200))) for _ in range(2))
        assert 0 <= likeness(Hashed(a), Hashed(b)) <= 1
        assert likeness(Hashed(a * 2), Hashed(a * 2)) == 1


@pytest.mark.parametrize("every", [3, 4, 5, 7, 10, 20])
def test_equals_a_plain_cover(every):
    """The share of words in a plain matcher's blocks, which lie in the same order in both."""
    r = random.Random(every)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 9))) for _ in range(3000)]
    for kind in ("replaced", "removed", "added", "mixed"):
        text = r.choices(words, k=2000)
        other = []
        for k, w in enumerate(text):
            how = kind if kind != "mixed" else r.choice(("replaced", "removed", "added"))
            if k % every:
                other.append(w)
            elif how == "replaced":
                other.append("changed" * (1 + k % 3))
            elif how == "added":
                other += [w, "more" * (1 + k % 2)]
        blocks = difflib.SequenceMatcher(None, text, other, autojunk=False).get_matching_blocks()
        covered = sum(len(" ".join(text[m.a : m.a + m.size])) + 1 for m in blocks if m.size)
        a, b = " ".join(text), " ".join(other)
        want = min(1.0, covered / max(len(a), len(b)))
        assert likeness(Hashed(a), Hashed(b)) == pytest.approx(want, abs=0.1), kind


def test_repetitive_and_long_texts():
    start = time.time()
    for text in ("ab" * 100_000, "the cat sat on the mat. " * 8_000, "x" * 300_000):
        other = text[:1000] + "!" + text[1000:-500]
        assert likeness(Hashed(text), Hashed(other)) > 0.95
    assert time.time() - start < 60
