"""Evaluation texts leaking into training text.

Method: q-gram lemma filtering. Texts become normal form: lower-case letters and digits without accents, words between
single spaces. A window of L characters that occurs with at most e edits shares at least L + 1 - q * (e + 1) q-grams with
the place where it occurs, and these lie on diagonals (text position - item position) at most e apart. Shared q-grams are
counted in overlapping bands of diagonals, bands that reach the bound are kept, and each is verified by banded alignment.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE, WALL = 32, 1
#: A hyphen (or soft hyphen) at a line break joins the parts of a word.
BROKEN = re.compile(r"(?<=\w)[-‐­][^\S\n]*\r?\n\s*(?=\w)")


def _fold(c: str) -> str:
    kept = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M")]
    return "".join(y for x in kept for y in unicodedata.normalize("NFKD", x.casefold()) if y.isalnum())


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, dict[int, str], re.Pattern]:
    """Code point → folded code point, 0 (dropped) or SPACE; and the characters that fold to several."""
    table = np.full(0x10000, SPACE, np.uint32)
    several: dict[int, str] = {}
    for cp in range(0x10000):
        c = chr(cp)
        folded = _fold(c)
        if len(folded) == 1:
            table[cp] = min(ord(folded), 0xFFFF) if ord(folded) != WALL else SPACE
        elif len(folded) > 1:
            several[cp] = folded
        elif unicodedata.category(c).startswith("M") or unicodedata.category(c) == "Cf":
            table[cp] = 0
    inside = "".join(re.escape(chr(cp)) for cp in several)
    return table, several, re.compile(f"[{inside}\U00010000-\U0010ffff]")


def normal_form(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of codes, each as ' word word ' before a WALL; and where each begins (one more at the end)."""
    table, several, odd = _tables()

    def plain(t: str | None) -> str:
        t = t or ""
        if "\n" in t:
            t = BROKEN.sub("", t)
        return odd.sub(lambda m: several.get(ord(m[0])) or _fold(m[0])[:1] or " ", t) if odd.search(t) else t

    if not texts:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    joined = [f" {plain(t)} \x01" for t in texts]
    raw = np.frombuffer("".join(joined).encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t) for t in joined], np.int64)
    ends = np.cumsum(size)
    codes = table[np.minimum(raw, 0xFFFF)]
    codes[ends - 1] = WALL
    keep = codes != 0
    # one space between words
    at = np.flatnonzero(keep)
    codes = codes[at]
    twice = np.r_[False, (codes[1:] == SPACE) & (codes[:-1] == SPACE)]
    codes, at = codes[~twice], at[~twice]
    begins = np.searchsorted(at, np.r_[0, ends])
    return codes, begins


def q_grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q codes from each position on (q a power of two); the last q - 1 positions have none."""
    h, width = codes.astype(np.uint64) + np.uint64(1), 1
    factor = BASE
    with np.errstate(over="ignore"):
        while width < q:
            h = h[:-width] * factor + h[width:] if len(h) > width else h[:0]
            factor, width = factor * factor, width * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class PassageIndex:
    """q-grams of the held-out passages with their positions. ``items``: (item_id, passage) pairs."""

    def __init__(self, items: list[tuple[int, str | None]], words: int, edits: int, q: int = Q):
        self.words, self.edits, self.q = words, edits, q
        self.ids = np.array([i for i, _ in items], np.int64)
        self.codes, self.begins = normal_form([t for _, t in items])
        bound, grams, owner, place = [], [], [], []
        self.windows: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(len(items)):
            own = self.passage(k)
            spaces = np.flatnonzero(own == SPACE)
            first, last = spaces[: max(0, len(spaces) - words)], spaces[words:]
            self.windows.append((first, last))
            length = int((last - first).min()) + 1 if len(first) else 0
            least = length + 1 - q * (edits + 1)
            if len(first) and least < 1:
                raise ValueError(f"windows of {length} characters allow no filter with q = {q} and {edits} edits")
            bound.append(least)
            if len(first):
                h = q_grams(own, q)
                grams.append(h), owner.append(np.full(len(h), k)), place.append(np.arange(len(h)))
        self.bound = np.array(bound, np.int64)
        h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.empty(0, np.int64))[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.h >> np.uint64(42)).astype(np.int64)] = True

    def passage(self, k: int) -> np.ndarray:
        return self.codes[self.begins[k] : self.begins[k + 1] - 1]  # without the wall

    def _words_in_run(self, own: np.ndarray, text: np.ndarray, shift: int) -> tuple[int, int]:
        """Most whole words in a stretch that agrees on the diagonal ``shift``, and where in ``text`` it begins."""
        a, b = max(0, -shift), min(len(own), len(text) - shift)
        same = own[a:b] == text[a + shift : b + shift]
        stop = np.flatnonzero(~np.r_[same, False])
        start = np.r_[0, stop[:-1] + 1]
        spaces = np.r_[0, np.cumsum(own[a:b] == SPACE)]
        words = spaces[stop] - spaces[start] - 1
        best = int(words.argmax())
        return int(words[best]), a + int(start[best]) + shift

    def _shared(self, k: int, places: np.ndarray) -> np.ndarray:
        """The windows of the passage in which the shared q-grams, by their places, reach the window's own bound."""
        first, last = self.windows[k]
        places = np.unique(places)
        shared = np.searchsorted(places, last - self.q + 1, "right") - np.searchsorted(places, first, "left")
        return np.flatnonzero(shared >= np.maximum(last - first + 2 - self.q * (self.edits + 1), 1))

    def _least_edits(self, k: int, text: np.ndarray, low: int, high: int, windows: np.ndarray) -> int:
        """Fewest edits at which one of the windows of the passage aligns with the text within the diagonals low..high."""
        own, e = self.passage(k), self.edits
        if not len(windows):
            return 1 << 30
        first, last = (side[windows] for side in self.windows[k])
        low, high = low - e, high + e
        width = high - low + 1
        length = last - first + 1
        cost = np.zeros((len(first), width), np.int64)
        offset = np.arange(width) + low
        best = np.full(len(first), 1 << 30)
        for i in range(int(length.max())):
            at = first + i
            c = own[np.minimum(at, len(own) - 1)]
            spot = at[:, None] + offset
            there = text[np.clip(spot, 0, len(text) - 1)]
            wrong = (there != c[:, None]) | (spot < 0) | (spot >= len(text))
            step = cost + wrong
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            for j in range(1, width):
                step[:, j] = np.minimum(step[:, j], step[:, j - 1] + 1)
            cost = step
            done = length == i + 1
            best[done] = cost[done].min(axis=1)
        return int(best.min())

    def search(self, texts: list[str], most: int = 500_000) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item id, edits, words, position in normal form) of every verified band."""
        if not len(self.h):
            return
        codes, begins = normal_form(texts)
        grams = q_grams(codes, self.q)
        at = np.flatnonzero(self.seen[(grams >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.h, grams[at], "left"), np.searchsorted(self.h, grams[at], "right")
        found = hi > lo
        at, lo, count = at[found], lo[found], (hi - lo)[found]
        if not len(at):
            return
        doc = np.searchsorted(begins, at, "right") - 1
        # as many texts at once as have some million shared q-grams; one text's are never more than its length times the
        # places of its commonest q-gram
        upto = np.cumsum(count)
        start = 0
        while start < len(at):
            stop = max(int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")), start + 1)
            if stop < len(at):  # whole texts
                back = int(np.searchsorted(doc, doc[stop], "left"))
                stop = back if back > start else int(np.searchsorted(doc, doc[start], "right"))
            yield from self._bands(codes, begins, at[start:stop], lo[start:stop], count[start:stop], doc[start:stop])
            start = stop

    def _bands(self, codes: np.ndarray, begins: np.ndarray, at: np.ndarray, lo: np.ndarray, count: np.ndarray, doc_at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        spot, doc = np.repeat(at, count), np.repeat(doc_at, count)
        entry = np.repeat(lo, count) + np.arange(len(spot)) - np.repeat(np.cumsum(count) - count, count)
        owner, place = self.owner[entry], self.place[entry]
        diagonal = spot - begins[doc] - place
        # overlapping bands: 2e + 1 diagonals wide, one starting at every e + 1, so any e + 1 neighbours lie in one band
        e = self.edits
        step, parts = e + 1, []
        for back in range(2 if e else 1):
            band = diagonal // step - back
            parts.append(np.stack([doc, owner, band, place]))
        keys = np.concatenate(parts, axis=1)
        keys = keys[:, np.lexsort(keys[2::-1])]
        first = np.flatnonzero(np.r_[True, (keys[:3, 1:] != keys[:3, :-1]).any(axis=0)])
        size = np.diff(np.r_[first, keys.shape[1]])
        for f, n in zip(first[enough := size >= self.bound[keys[1, first]]].tolist(), size[enough].tolist()):
            d, k, band = keys[:3, f].tolist()
            windows = self._shared(k, keys[3, f : f + n])
            if not len(windows):
                continue
            text = codes[begins[d] : begins[d + 1] - 1]
            low, high = band * step, band * step + (2 * step - 1 if e else 0)
            words, position = max(self._words_in_run(self.passage(k), text, s) for s in range(low, high + 1))
            edits = 0 if words >= self.words else self._least_edits(k, text, low, high, windows) if e else 1 << 30
            if edits <= e:
                yield int(d), int(self.ids[k]), edits, words, position


#: An index takes some 30 bytes a character of its passages.
BLOCK_CHARS = 20_000_000


def _blocks(items: list[tuple[int, str | None]], most: int) -> Iterator[list[tuple[int, str | None]]]:
    held, size = [], 0
    for item in items:
        n = len(item[1] or "")
        if held and (len(held) == most or size + n > BLOCK_CHARS):
            yield held
            held, size = [], 0
        held.append(item)
        size += n
    yield held


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: list[tuple[int, str | None]], words: int = 13, edits: int = 0, q: int | None = None, block: int = 20_000) -> DataFrame:
    """doc_id, item_id, edits, words: every item of which a window of ``words`` words stands in the text with at most
    ``edits`` edits of characters. ``words``: the longest run of unaltered words in the region.

    Whole texts are searched; documents with null or empty text have no rows, nor have items of fewer than ``words`` words.
    Case, accents, punctuation, spacing, soft hyphens and hyphens at a line break do not matter. The passages are a stated
    query set: they go to the tasks in blocks of at most ``block`` passages and BLOCK_CHARS characters (one longer passage is
    a block by itself), so what is sent is bounded whatever their number; documents
    are not shuffled. One row per document and item, repeated document rows give repeated rows.
    """
    q = q or (Q if edits == 0 else 8)
    out = None
    kind = dict(docs.dtypes)[doc_id]
    for some in _blocks(items, block):
        index = docs.sparkSession.sparkContext.broadcast(PassageIndex(some, words, edits, q))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for df in batches:
                texts, ids = df["_text"].tolist(), df["_id"].to_numpy()
                best: dict[tuple[int, int], tuple[int, int]] = {}
                size = [len(t or "") for t in texts]
                start = 0
                while start < len(texts):  # at most some million characters at once, and always one whole text
                    stop, total = start + 1, size[start]
                    while stop < len(texts) and total + size[stop] <= 2_000_000:
                        total += size[stop]
                        stop += 1
                    for d, item, e, w, _ in index.value.search(texts[start:stop]):
                        key = (start + d, item)
                        best[key] = min(best.get(key, (1 << 30, 0)), (e, -w))
                    start = stop
                if best:
                    rows = [(ids[d], item, e, -w) for (d, item), (e, w) in best.items()]
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "words"])

        part = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL AND _text <> ''")
        part = part.mapInPandas(run, f"doc_id {kind}, item_id long, edits int, words int")
        out = part if out is None else out.unionByName(part)
    return out
