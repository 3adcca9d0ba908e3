"""Token ids of whole texts as the tokenizer gives them, with a bounded memory of the words already encoded.

Both vocabularies merge inside words only, so a text's ids are those of its words, each taken with
the blank or line feed before it, and of a full stop or comma behind them; no merge joins a letter and
a mark after it. Texts with other white space, with two blanks in a row, or with the
string of a special token are given to the tokenizer whole. A worker keeps its tokenizer and its
memory between batches.
"""
from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMORY_BYTES = 96 << 20  # of words kept, as estimated by WORD_BYTES
WORD_BYTES = 180  # of a kept word beside its letters: its place and ids, and its share of a search table
TEXT_BYTES = 4 << 20  # of text encoded at a time
LONGEST = 64  # characters; longer parts are encoded but not kept
_CONTROLS = np.zeros(256, bool)
_CONTROLS[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_LATIN = np.zeros(256, bool)
_LATIN[65:91] = _LATIN[97:123] = True


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stay, others follow 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()


def parts(texts: pa.Array, specials: tuple[str, ...] = ()) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts one after another, and the text that each part belongs to."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, ends, raw = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if at[-1] == at[0]:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    blank = (data == 32) | (data == 10)
    # White space beyond ASCII starts with these bytes.
    after = np.append(data[1:], 0)
    rare = _CONTROLS[data] | (data == 194) & ((after == 133) | (after == 160))
    rare |= (data == 225) & (after == 154) | (data == 226) & (after <= 129) & (after >= 128)
    rare |= (data == 227) & (after == 128)
    first = at[:-1][at[1:] > at[:-1]]
    rare |= blank & np.append(blank[1:], False)
    rare[first] |= blank[first]
    last = at[1:][at[1:] > at[:-1]] - 1
    rare[last] |= blank[last]
    whole = np.zeros(len(texts), bool)
    for special in specials:
        whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
    whole[np.searchsorted(at, np.flatnonzero(rare), "right") - 1] = True
    # A mark between a letter and a blank or the text's end stands by itself: words repeat more without it.
    alone = np.append(blank[1:], False)
    alone[last] = True
    alone &= ((data == 46) | (data == 44)) & np.append(False, _LATIN[data[:-1]])
    cuts = np.flatnonzero(blank | alone)
    cuts = cuts[~whole[np.searchsorted(at, cuts, "right") - 1]]
    begins = np.zeros(len(data), bool)
    begins[first] = begins[cuts] = True
    starts = np.flatnonzero(begins)
    offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, offsets, pa.py_buffer(data)])
    return found, np.searchsorted(at, starts, "right") - 1


class Encoder:
    def __init__(self, path: str, lower: bool):
        """lower: the vocabulary drops white space and case (its words end with a mark)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.lower = self.tokenizer.model, lower
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.feed = [] if lower else self.whole(["\n"])[0]
        self.clear()

    def clear(self):
        self.held = 0
        self.words = pa.array([], pa.large_string())  # kept, in the order of their ids
        self.start = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, text: str) -> list[int]:
        """The ids of one pre-token."""
        if not text.isascii():
            text = "".join([_LETTERS[b] for b in text.encode()])
        return [t.id for t in self.model.tokenize(text)]

    def _encode(self, new: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        late = []
        tokenize = self.model.tokenize
        space = "" if self.lower else _LETTERS[32]
        marks = {"": []} | {mark: self._piece(mark) for mark in ".,"}
        for word in new:
            blank = word[0] if word[0] in " \n" else ""
            letters = word[1:] if blank else word
            mark = letters[-1:] if letters[-1:] in marks else ""
            if mark:
                letters = letters[:-1]
            if letters.isalpha():
                if self.lower:
                    # The library lower-cases a sigma without regard to its place in the word.
                    final = "\u03a3" in letters
                    letters = unicodedata.normalize("NFC", letters).lower()
                    if final or not letters.isalpha():
                        late.append(len(out))
                        out.append([])
                        continue
                if not letters.isascii():
                    letters = "".join([_LETTERS[b] for b in letters.encode()])
                ids = [t.id for t in tokenize(space + letters if blank == " " else letters)]
                if blank == "\n":
                    ids = self.feed + ids
                out.append(ids + marks[mark])
            else:
                late.append(len(out))
                out.append([])
        for k, ids in zip(late, self.whole([new[k] for k in late])):
            out[k] = ids
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's number of ids. A null text is empty."""
        if self.held > MEMORY_BYTES:
            self.clear()
        found, owner = parts(texts, self.specials)
        coded = found.dictionary_encode()
        words, known = coded.dictionary, len(self.words)
        rows = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        unseen = np.flatnonzero(rows < 0)
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)[unseen]
        short = sizes <= LONGEST
        weights = (WORD_BYTES + sizes) * short
        # A word is kept as long as those before it have left room.
        short &= self.held + np.cumsum(weights) - weights <= MEMORY_BYTES
        keep, long = unseen[short], unseen[~short]
        if len(keep):
            self.held += int(weights[short].sum())
            new = words.take(pa.array(keep))
            rows[keep] = np.arange(known, known + len(new))
            self.words = pa.concat_arrays([self.words, new])
            self._add(self._encode(new.to_pylist()))
        kept = len(self.start), len(self.flat)
        if len(long):
            rows[long] = np.arange(len(long)) + kept[0] - 1
            self._add(self.whole(words.take(pa.array(long)).to_pylist()))
        at = rows[coded.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0, np.int64)
        lengths = self.start[at + 1] - self.start[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(self.start[at] - ends + lengths, lengths)
        ids = self.flat[where]
        self.start, self.flat = self.start[: kept[0]], self.flat[: kept[1]]
        return ids, np.bincount(owner, lengths, len(texts)).astype(np.int64)

    def _add(self, found: list[list[int]]):
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, flat])


@lru_cache(maxsize=2)
def encoder(path: str, lower: bool) -> Encoder:
    return Encoder(path, lower)
