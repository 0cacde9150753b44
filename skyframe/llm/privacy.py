"""Personal information inside free text, replaced by typed placeholders.

Method: information-theoretic sanitisation. Corpus co-occurrence says how strongly a term reveals a protected entity: its
disclosure is the pointwise mutual information, in bits, between the term and the entity's slot, log2(P(slot | term) /
P(slot)), counted over the whole corpus. What stands for itself by form (a mail address, a telephone number, a street with a
house number, a listed given name before a family word) is a seed of its slot; the terms around the seeds, and the parts of
names, get their disclosure from them; and what no form tells is found by the terms that disclose it:

* a run of digits is an identity number if the word before it, or its own shape (digits and letters as they are grouped),
  stands in sentences about persons; else a telephone number if the word before it stands before telephone numbers;
* capitalised words beside a number are an address if the word before stands before addresses;
* two capitalised words are a name if two of three disclose it: the family word, the given word (listed, an initial, or
  itself standing mostly before disclosed families), and the words around.

Nothing here depends on where in a text, how long or how frequent a term is; only rates count.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.session import cut

# ------------------------------------------------------------------ fixed values
TITLES = set(
    "mr mrs ms miss mx dr prof professor sir dame lord lady hon rev m mm mme mmes mlle me maitre monsieur madame mademoiselle docteur "
    "herr herrn frau fraulein doktor abg abgeordnete abgeordneter abgeordneten kollege kollegin kollegen minister ministerin prasident "
    "prasidentin member members speaker president chair mp mdb md senator colleague".split()
)
PARTICLES = set("van von de di da du del della der den la le zu zum zur ten ter dos al el".split())
PARTICLE_STARTS = {c for w in PARTICLES for c in (w[0], w[0].upper())}
#: Shapes that identity, insurance and card numbers are known to have; other shapes are found by their disclosure.
ID_SHAPES = [
    r"\b\p{Lu}{2} ?\d{2} ?\d{2} ?\d{2} ?\p{Lu}\b",
    r"\b\p{Lu}{2}\d{8}\b",
    r"\b\d{6}\p{Lu}\d{3}\b",
    r"(?<![\d-])\d{2}-\d{4}-\d{4}(?![\d-])",
    r"(?<![\d-])\d{7}-\d{4}(?![\d-])",
    r"(?<![\d])(?<!\d )[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?!\d)",
    r"(?<![\p{Lu}\d])(?<![\p{Lu}\d] )(?:\d{4}[ -]){3}\d{4}(?! ?\d)",
]
PHONE_SHAPES = [
    r"(?:\+|(?<![\d\p{L}])(?<!\d[ ./-])00)\d{1,3}[ ./-]?(?:\(0\)[ ./-]?)?\d(?:[ ./-]?\d){5,11}(?![\d])",
    r"\(\d{2,5}\)[ ./-]?\d(?:[ ./-]?\d){4,9}(?!\d)",
    r"(?<![\d\p{L}])(?<!\d[ ./-])0\d{1,4}[ ./-]\d(?:[ ./-]?\d){4,9}(?!\d)",
    r"(?<![\d\p{L}])(?<!\d[ ./-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])",
    r"(?<![\d\p{L}])(?<!\d[ ./-])\d{3}-\d{4}(?![\d-])",
]
#: Any other number: groups of digits, with capital letters before the first or within a group.
NUMBER = r"(?:(?<![\p{L}\p{N}])\p{Lu}{1,3}[ -]?)?(?<!\p{N}[./-]?)\d[\d\p{Lu}]*(?:[ ./-]\d[\d\p{Lu}]*)*(?![\p{L}\p{N}])"
AMOUNT = re.compile(r"\d{1,3}(?: \d{3})+|(?:1[89]|20)\d\d[-/](?:1[89]|20)\d\d")
LABEL = r"[\p{L}\p{N}][\p{L}\p{N}-]*"
DOT = r"(?:\.|\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\})\s*|\s+(?:dot|punkt|point)\s+)"
#: The sign of a mail address, and what follows it.
DOMAIN = rf"(?i:\s*(?:@|\[\s*at\s*\]|\(\s*at\s*\)|\{{\s*at\s*\}}|<\s*at\s*>)\s*{LABEL}(?:{DOT}{LABEL})+|\s+(?:at|arobase|klammeraffe|ät)\s+{LABEL}(?:\s+(?:dot|punkt|point)\s+{LABEL})+)"
#: A word or a sign around a candidate.
ONE = r"[^\W\d_][^\W\d_\u0300-\u036f]*(?:[’'][^\W\d_]+)*|[^\s]"
TOKEN, TWO_TOKENS = re.compile(ONE), re.compile(rf"\s*({ONE})?\s*({ONE})?")
BRACKETED, SPELT_DOT, SPELT_AT = re.compile(r"@|[\[({<]\s*at\s*[\])}>]"), re.compile(r"\s(?:dot|punkt|point)\s"), ("at", "arobase", "klammeraffe", "ät")
#: An address is looked for at its house number: what follows it (English, French), or stands before it (German).
AFTER_NUMBER = [
    r"\d+\p{Ll}?\s+(?:\p{Lu}[\p{L}\p{M}’'-]*\s+)+?(?i:street|st|road|rd|lane|ln|avenue|ave|drive|close|terrace|square|crescent|row|court|grove|way|gardens|place|walk)\b",
    r"\d+\p{Ll}?(?:\s+(?i:bis|ter|quater))?\s*,?\s+(?i:rue|avenue|av\.|quai|impasse|bd\.?|boulevard|place|chemin|allée|ruelle|cours|square|route|passage|sentier)\s+"
    r"(?:(?i:de\s+la|de\s+l[’']|des|du|de|d[’'])\s*)?\p{Lu}[\p{L}\p{M}’'-]*",
]
FLAT = r"(?i:\b(?:flat|apt\.?|apartment|unit|suite|appartement|appt?\.?|logement)\s+\w+\s*,?\s+)$"
STREET_ENDS = ("straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ufer", "steig", "graben", "hafen", "markt", "brücke", "bahnhof", "tor", "kirche", "park", "anger", "mühle")
BEFORE_NUMBER = (
    r"(?<![\p{L}\p{M}-])(?:(?:(?:Alte|Neue|Große|Kleine|Obere|Untere|Lange|Kurze|Hohe|Hintere|Vordere)[rsnm]?\s+)?\p{Lu}[\p{L}\p{M}-]*-?(?i:straße|strasse|str\.|gasse|weg|platz|allee|ufer|steig|graben)|"
    r"(?:Am|An\s+der|Im|Zum|Zur|Alte[rn]?|Neue[rn]?|Obere|Untere)\s+(?:Hafen|Markt|Brücke|Bahnhof|Tor|Ufer|Kirche|Park|Anger|Mühle))\s+$"
)
HOUSE_NUMBER = r"(?!(?:1[89]|20)\d\d)\d+\s?\p{Ll}?(?![\p{L}\d.])"
#: A place beside a number whose kind no word tells.
LOOSE_AFTER = r"\d+\p{Ll}?,?(?:\s+\p{Lu}[\p{L}\p{M}’'-]*)+"
LOOSE_BEFORE = r"(?:(?:Am|An\s+der|An\s+den|Auf\s+der|Auf\s+dem|Im|In\s+der|Zum|Zur|Unter\s+den)\s+)?\p{Lu}[\p{L}\p{M}’'-]+\s+$"
WORD = r"\p{Lu}[\p{L}\p{M}’']+(?:-\p{Lu}[\p{L}\p{M}’']*)*"
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Bits that a term must disclose. number: the word before a number, or its shape; place: the word before a place and number;
#: family: a family word; given: a given word; context: the words around a name (log-odds).
THRESHOLDS = {"number": 1.0, "place": 1.0, "family": 1.0, "given": 2.0, "context": 0.0}
KINDS = ["email", "phone", "id_number", "address", "name"]
SPAN_SCHEMA = "doc_id {id}, kind string, start_pos long, end_pos long, term string, other string, before string, after string, near int, n long, alt_start long"
COLUMNS = ["doc_id", "kind", "start_pos", "end_pos", "term", "other", "before", "after", "near", "n", "alt_start"]


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not unicodedata.category(c).startswith("M")).replace("’", "'")


@lru_cache(maxsize=1)
def _clusters_of_marks():
    import regex

    return regex.compile(r"\P{M}\p{M}+")


def composed(text: str) -> tuple[str, np.ndarray | None]:
    """NFC text, and for each of its code points (and the end) the offset in ``text``; None if they agree."""
    if text.isascii() or unicodedata.is_normalized("NFC", text):
        return text, None
    out, at, last = [], [], 0

    def copy(a: int, b: int) -> None:
        """A stretch without clusters; where it is no NFC by itself, character by character."""
        piece = text[a:b]
        if unicodedata.is_normalized("NFC", piece):
            out.append(piece)
            at.append(np.arange(a, b))
            return
        for i in range(a, b):
            single = unicodedata.normalize("NFC", text[i])
            out.append(single)
            at.append(np.full(len(single), i))

    for m in _clusters_of_marks().finditer(text):
        a, b = m.span()
        copy(last, a)
        whole = unicodedata.normalize("NFC", m[0])
        out.append(whole)
        at.append(np.minimum(a + np.arange(len(whole)), b - 1))
        last = b
    copy(last, len(text))
    return "".join(out), np.concatenate([*at, [len(text)]])


def family_term(family: str) -> str:
    """The term a family name counts under: the first part of a double one."""
    return family.split("-")[0]


def shape(number: str) -> str:
    """How a number is grouped: 9 for a digit, A for a letter."""
    return "".join("9" if c.isdigit() else "A" if c.isalpha() else c for c in number)


class Finder:
    """Candidates of all kinds in one text. ``members``: (given, family, party) of public persons; ``given``: listed names."""

    def __init__(self, members: list[tuple], given: list[str]):
        self.full = {(fold(g), fold(f)) for g, f, _ in members if g and f}
        self.initial = {(fold(g)[0], fold(f)) for g, f, _ in members if g and f}
        self.parties = {fold(p) for _, _, p in members if p}
        self.given = {fold(g) for g in given if g} | {fold(g) for g, _, _ in members if g}
        self.compiled = None

    def __getstate__(self):
        return {**self.__dict__, "compiled": None}

    def _patterns(self):
        import regex

        if self.compiled is None:
            self.compiled = {
                "id": regex.compile("|".join(ID_SHAPES)),
                "phone": regex.compile("|".join(PHONE_SHAPES)),
                "number": regex.compile(NUMBER),
                "domain": regex.compile(DOMAIN),
                "after_number": regex.compile("|".join(AFTER_NUMBER)),
                "flat": regex.compile(FLAT),
                "before_number": regex.compile(BEFORE_NUMBER),
                "house": regex.compile(HOUSE_NUMBER),
                "loose_after": regex.compile(LOOSE_AFTER),
                "loose_before": regex.compile(LOOSE_BEFORE),
                "heads": regex.compile(rf"(?<![\p{{L}}\p{{M}}’'-])(?:\p{{Lu}}\.|{WORD})"),
                "before": regex.compile(r"([\p{L}\p{M}’']+)[^\p{L}]{0,3}$"),
                "party": regex.compile(r"\s*,\s*([\p{L}.]+)\s*:"),
                "sentence": regex.compile(r"(?<=\p{Ll}\p{Ll}|\d)[.!?](?=\s|$)|\n"),
            }
        return self.compiled

    def member(self, given: str, family: str) -> bool:
        """Whether the name, as written, can be that of a public person."""
        return (given[0], family) in self.initial if len(given.rstrip(".")) == 1 else (given, family) in self.full

    def search(self, text: str, words: Counter | None = None) -> Iterator[tuple]:
        """(kind, start, end, term, other, before, after, near, alt_start); offsets from 0 in ``text``.

        kind: email, phone, address (by form), number, place (undecided), name (a seed), maybe, public. near, of numbers: a
        protected entity stands in the sentence, plus 2 if the shape is known; of names: the given word is listed or an
        initial. ``words`` gets the count of every capitalised word that is in no other span.
        """
        p = self._patterns()
        spans: list[tuple] = []
        held = bytearray(len(text) + 1)  # 1 where a span is; all look-ups are local, so a long text costs its length

        def hold(a: int, b: int) -> bool:
            """Take a stretch that is free."""
            if held.find(1, a, b) >= 0:
                return False
            held[a:b] = b"\1" * (b - a)
            return True

        for a, b in self._mails(text, p):
            hold(a, b)
            spans.append(("email", a, b, None, None, self._label(text, a), None, 1, -1))
        runs = [m.span() for m in re.finditer(r"\d+", text)]
        numbers = []
        for lo, hi in self._clusters(text, runs):
            for kind in ("id", "phone", "number"):
                for m in p[kind].finditer(text, lo, hi):
                    a, b = m.span()
                    if kind == "number" and (sum(c.isdigit() for c in m[0]) < 7 or AMOUNT.fullmatch(m[0])) or not hold(a, b):
                        continue
                    if kind == "phone":
                        spans.append(("phone", a, b, None, None, self._label(text, a), None, 1, -1))
                    else:
                        numbers.append((a, b, kind == "id"))
        places, ends = [], set()
        for kind, a, b in self._addresses(text, runs, held, p) if runs else ():
            row = (kind, a, b, None, None, self._context(text, a).rpartition(" ")[2], None, 1, -1)
            ends.add(b)
            if kind == "address":
                hold(a, b)
                spans.append(row)
            else:
                places.append(row)
        # a number and town right after an address are its postcode; a street may have begun before what stood beside a number
        before = lambda a: a - len(text[max(0, a - 4) : a]) + len(text[max(0, a - 4) : a].rstrip(" ,"))
        places = [r for r in places if before(r[1]) not in ends and hold(r[1], r[2])]
        masked = text
        if spans or numbers or places:
            pieces, at = [], 0
            for a, b in sorted(r[1:3] for r in [*spans, *places, *((None, *n) for n in numbers)]):
                if b > at:
                    pieces += [text[at : max(a, at)], "_" * (b - max(a, at))]
                    at = b
            masked = "".join(pieces) + text[at:]
        names = list(self._names(masked, p, words))
        if numbers:
            protected = sorted([s[1] for s in spans] + [s[1] for s in names if s[7]])
            cuts = [m.start() for m in p["sentence"].finditer(masked)]
            for a, b, known in numbers:
                i = bisect_left(cuts, a)
                low, high = (cuts[i - 1] if i else 0), (cuts[i] if i < len(cuts) else len(text))
                near = bisect_left(protected, low) < bisect_left(protected, high)
                spans.append(("number", a, b, None, shape(text[a:b]), self._label(text, a), None, int(near) + 2 * known, -1))
        yield from spans
        yield from places
        yield from names

    @staticmethod
    def _clusters(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Stretches with digits close together, with room for letters and signs around, that hold at least six digits."""
        i = 0
        while i < len(runs):
            j, digits = i, runs[i][1] - runs[i][0]
            while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] <= 4:
                j += 1
                digits += runs[j][1] - runs[j][0]
            if digits >= 6:
                yield max(0, runs[i][0] - 5), min(len(text), runs[j][1] + 4)
            i = j + 1

    def _label(self, text: str, at: int) -> str:
        """The last word before a position on its line."""
        i = at
        while i > 0 and not text[i - 1].isalpha() and text[i - 1] != "\n" and at - i < 8:
            i -= 1
        j = i
        while j > 0 and (text[j - 1].isalpha() or text[j - 1] in "’'" or unicodedata.combining(text[j - 1])):
            j -= 1
        return fold(text[j:i])

    def _signs(self, text: str) -> list[int]:
        """Where the sign of a mail address may begin: @, a bracketed at, or an at before a word and a dot."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        signs = [m.start() for m in BRACKETED.finditer(low)]
        if "dot" in low or "punkt" in low or "point" in low:
            for m in SPELT_DOT.finditer(low):
                label = self._back(text, m.start() + 1, 1)
                at = self._back(text, label, 1)
                if low[at:label].strip() in SPELT_AT:
                    signs.append(at)
        return sorted(signs)

    def _mails(self, text: str, p: dict) -> Iterator[tuple[int, int]]:
        done = 0
        for end in self._signs(text):
            while end > done and text[end - 1].isspace():
                end -= 1
            start = end
            while start > done and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
                start -= 1
            while start < end and not (text[start].isalnum() or text[start] in "_%"):
                start += 1
            if start < end and (m := p["domain"].match(text, end)):
                yield start, m.end()
                done = m.end()

    def _addresses(self, text: str, runs: list, held: bytearray, p: dict) -> Iterator[tuple[str, int, int]]:
        done = line = seen = 0
        for a, b in runs:
            while (k := text.find("\n\n", seen, a)) >= 0:  # the paragraph's beginning
                line = seen = k + 1
            seen = max(seen, a - 1)
            if a < done or (a and text[a - 1] in "/-") or held.find(1, a, b) >= 0:
                continue
            kind = "address"
            m = p["after_number"].match(text, a)
            back = max(done, line, self._back(text, a, 3))
            if m:
                flat = p["flat"].search(text, back, a)
                start, end = flat.start() if flat else a, m.end()
            else:
                house = p["house"].match(text, a) if a and text[a - 1].isspace() else None
                word = text[back:a].split()[-1:]
                street = None
                if house and word:
                    street = p["before_number"].search(text, back, a) if word[0].lower().endswith(STREET_ENDS) else None
                    if not street:
                        kind, street = "place", p["loose_before"].search(text, back, a)
                if street:
                    start, end = street.start(), house.end()
                elif m := p["loose_after"].match(text, a):
                    kind, start, end = "place", a, m.end()
                else:
                    continue
            if "\n\n" in text[start:end] or held.find(1, start, end) >= 0:
                continue
            yield kind, start, end
            if kind == "address":
                done = end

    @staticmethod
    def _back(text: str, at: int, words: int) -> int:
        """Where the ``words`` words before a position begin."""
        for _ in range(words):
            while at > 0 and text[at - 1].isspace():
                at -= 1
            while at > 0 and not text[at - 1].isspace():
                at -= 1
        return at

    @staticmethod
    def _context(text: str, at: int) -> str:
        """The last two words or signs before a position, titles left out."""
        floor = at - 120 if at > 120 else 0
        low = at
        for _ in range(5):
            low = text.rfind(" ", floor, low)
            if low < 0:
                break
        tokens = [fold(t) for t in TOKEN.findall(text, low if low > floor else floor, at)]
        while tokens and (tokens[-1] in TITLES or tokens[-1] == "." and len(tokens) > 1 and tokens[-2] in TITLES):
            tokens.pop()
        return " ".join(tokens[-2:])

    def _names(self, text: str, p: dict, words: Counter | None) -> Iterator[tuple]:
        """Name candidates: seeds ('name', 'public'), then 'maybe' where no seed stands."""
        heads = [(m.start(), m.end(), m[0]) for m in p["heads"].finditer(text)]
        if words is not None:
            words.update([w for _, _, w in heads])
        turned: list[tuple] = []  # start, end, given, family, a title's initial may stand between
        plain: list[tuple] = []
        last = len(heads) - 1
        for i in range(last):
            a, b, g = heads[i]
            c, d, f = heads[i + 1]
            if c == b:
                continue
            sign = text[b]
            if sign == ",":
                if text[b + 1 : c].isspace() and "\n\n" not in text[b:c] and g[-1] != ".":
                    end = d
                    if f[-1] != "." and i + 1 < last and heads[i + 2][2][-1] == "." and text[d : heads[i + 2][0]].isspace():
                        end = heads[i + 2][1]
                    turned.append((self._particles_before(text, a), end, fold(f), fold(g), False))
                continue
            if not sign.isspace() or c - b > 1 and not ((text[b + 1] in PARTICLE_STARTS or text[b + 1].isspace()) and self._joins(text[b:c])) or a and text[a - 1] == ".":
                continue
            k, given, middle, bare = i + 1, fold(g), False, c - b == 1 or text[b:c].isspace()
            if f[-1] == ".":
                if not bare or k == last or not self._joins(text[d : heads[k + 1][0]]):
                    continue
                k, middle = k + 1, True
            elif bare and given in self.given and k < last and fold(f) in self.given and heads[k + 1][2][-1] != "." and text[d : heads[k + 1][0]].isspace():
                k += 1  # two given words
            while k < last and fold(heads[k][2]) in PARTICLES and self._joins(text[heads[k][1] : heads[k + 1][0]]):
                k, bare = k + 1, False
            if heads[k][2][-1] == "." or "\n\n" in text[a : heads[k][1]]:
                continue
            if middle and not text[heads[i + 1][1] : heads[i + 2][0]].isspace():
                bare = False
            plain.append((a, heads[k][1], given, fold(heads[k][2]), middle and bare))
        found = turned + plain
        taken = bytearray(len(text) + 1) if found else b""
        rest = []
        for start, end, g, f, initial in found:
            if g in TITLES or f in TITLES or g == "m." and initial:  # M. X. Family: a title and an initial
                continue
            if not (len(g.rstrip(".")) == 1 or g in self.given) or f in self.given:
                rest.append((start, end, g, f))
                continue
            if taken.find(1, start, end) >= 0:
                continue
            taken[start:end] = b"\1" * (end - start)
            yield self._row(text, start, end, g, f, p, seed=True)
        for start, end, g, f in rest:
            if taken.find(1, start, end) < 0 and (g, f) not in self.full:
                yield self._row(text, start, end, g, f, p, seed=False)

    @staticmethod
    def _joins(gap: str) -> bool:
        """Whether a gap between words holds nothing, or particles."""
        if not gap or not gap[0].isspace() or not gap[-1].isspace():
            return False
        return all(w in PARTICLES or fold(w) in PARTICLES for w in gap.split())

    def _particles_before(self, text: str, at: int) -> int:
        while True:
            back = self._back(text, at, 1)
            if back == at or fold(text[back:at].strip()) not in PARTICLES:
                return at
            at = back

    def _row(self, text: str, start: int, end: int, g: str, f: str, p: dict, seed: bool) -> tuple:
        before, (one, two) = self._context(text, start), TWO_TOKENS.match(text, end).groups("")
        after = f"{fold(one)} {fold(two)}".rstrip()
        term, short = family_term(f), len(g.rstrip(".")) == 1
        if self.member(g, f) or (m := p["party"].match(text, end)) and fold(m[1]) in self.parties:
            return ("public", start, end, term, None, before, after, 0, -1)
        if not seed:
            return ("maybe", start, end, term, None if g in self.given else g, before, after, 0, -1)
        if short:  # Unlisted X. Family
            back = self._back(text, start, 1)
            word = text[back:start].strip()
            if len(word) > 1 and word[0].isupper() and fold(word) not in TITLES and all(c.isalpha() or c in "’'-" for c in word) and text[start - 1].isspace():
                return ("name", start, end, term, fold(word), before, after, 1, back)
        return ("name", start, end, term, None, before, after, 1, -1)


def candidates(docs: DataFrame, doc_id: str, text: str, finder: Finder) -> DataFrame:
    """One pass over the whole texts: candidate spans, and (kind 'count') how often each capitalised word stands, per batch."""
    schema = SPAN_SCHEMA.format(id=dict(docs.dtypes)[doc_id])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for df in batches:
            rows = []
            for i, t in zip(df["_id"], df["_text"]):
                if not t:
                    continue
                flat, at = composed(t)
                for kind, a, b, term, other, before, after, near, alt in finder.search(flat, counts):
                    if at is not None:
                        a, b, alt = int(at[a]), int(at[b]), int(at[alt]) if alt >= 0 else -1
                    rows.append((i, kind, a + 1, b + 1, term, other, before, after, near, 1, alt + 1))
            if len(counts) > 200_000:
                rows += _count_rows(counts)
            if rows:
                yield pd.DataFrame(rows, columns=COLUMNS)
        if counts:
            yield pd.DataFrame(_count_rows(counts), columns=COLUMNS)

    def _count_rows(counts: Counter) -> list[tuple]:
        folded: Counter = Counter()
        for w, n in counts.items():
            if not w.endswith("."):
                folded[family_term(fold(w))] += n
        counts.clear()
        return [(None, "count", None, None, w, None, None, None, None, n, None) for w, n in folded.items()]

    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInPandas(run, schema)


def disclosure(found: DataFrame) -> DataFrame:
    """feature, term, n, hit, bits: over the corpus, how often each term stands, how often in its slot, and what that discloses.

    bits = log2(P(slot | term) / P(slot)) with one occurrence's weight of the feature's average added, so that a term seen
    seldom discloses little. For the words around a name, where the slot is rare, log2(P(slot | term) / P(not slot | term));
    around numbers and places one bit more than that, if it is more: a term that mostly stands in the slot discloses it,
    however common the slot is. One row per term; the totals of the features are as many rows as there are features.
    """

    def feature(name: str, term: Column, kinds: str, hit: Column, n: Column | None = None) -> Column:
        counts = F.struct(F.lit(name).alias("feature"), term.alias("term"), (F.lit(1) if n is None else n).cast("long").alias("n"), hit.cast("long").alias("hit"))
        return F.when(F.expr(f"kind IN ({kinds})") & term.isNotNull() & (term != ""), counts)

    is_ = lambda k: F.col("kind") == k
    near = F.col("near") % 2
    parts = F.array(
        feature("label", F.col("before"), "'number'", near), feature("shape", F.col("other"), "'number'", near), feature("dial", F.col("before"), "'number', 'phone'", is_("phone")),
        feature("spot", F.col("before"), "'address', 'place'", is_("address")), feature("word", F.col("term"), "'name', 'public'", F.lit(1), F.lit(0)), feature("word", F.col("term"), "'count'", F.lit(0), F.col("n")),
        feature("before", F.col("before"), "'name', 'public', 'maybe'", is_("name")), feature("after", F.col("after"), "'name', 'public', 'maybe'", is_("name")),
    )
    rows = found.select(F.explode(F.array_compact(parts)).alias("f")).select("f.*")
    stats = cut(rows.groupBy("feature", "term").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")))
    totals = stats.groupBy("feature").agg(((F.sum("hit") + 0.5) / (F.greatest(F.sum("n"), F.sum("hit")) + 1)).alias("rate")).collect()
    rate, feature_ = F.lit(None).cast("double"), F.col("feature")
    for r in totals:  # a row per feature
        rate = F.when(feature_ == r["feature"], F.lit(r["rate"])).otherwise(rate)
    p = (F.col("hit") + F.col("rate")) / (F.greatest("n", "hit") + 1)
    odds, gain = F.log2(p / (1 - p)), F.log2(p / F.col("rate"))
    bits = F.when(feature_.isin("before", "after"), odds).when(feature_ == "word", gain).otherwise(F.greatest(gain, 1 + odds))
    return stats.withColumn("rate", rate).withColumn("bits", bits)


def _with_bits(rows: DataFrame, stats: DataFrame, feature: str, column: str, out: str) -> DataFrame:
    """Add the bits of ``column`` as a term of ``feature``; -99 where it is none."""
    own = stats.where(F.col("feature") == feature).select(F.col("term").alias(f"_{out}"), F.col("bits").alias(out))
    return rows.join(own, F.col(column) == F.col(f"_{out}"), "left").drop(f"_{out}").withColumn(out, F.coalesce(out, F.lit(-99.0)))


def personal_spans(docs: DataFrame, doc_id: str, text: str, members: list[tuple], given: list[str], thresholds: dict = THRESHOLDS) -> DataFrame:
    """doc_id, kind, start_pos, end_pos (1-based code points, end exclusive), bits (null for direct identifiers).

    ``members`` (given, family, party) and ``given`` are small fixed lists. Null and empty texts have no rows; repeated
    documents have repeated rows and count repeatedly. Term statistics cover all documents: they are aggregated per
    batch in Python, then by term in the cluster, and joined back to the candidates by term.
    """
    found = cut(candidates(docs, doc_id, text, Finder(members, given)))
    stats = disclosure(found)
    out = ["doc_id", "kind", "start_pos", "end_pos", "bits"]
    direct = found.where(F.col("kind").isin("email", "phone", "address")).withColumn("bits", F.lit(None).cast("double")).select(*out)

    numbers = _with_bits(_with_bits(_with_bits(found.where("kind = 'number'"), stats, "label", "before", "by_label"), stats, "shape", "other", "by_shape"), stats, "dial", "before", "by_dial")
    best = F.greatest("by_label", "by_shape")
    digits = F.length(F.regexp_replace("other", "[^9A]", ""))
    known = F.col("near") >= 2
    person = (best > thresholds["number"]) & (known | (digits >= 9) & (F.col("by_label") > thresholds["number"]) & (F.col("by_dial") <= F.col("by_label")))
    dialled = ~known & (F.col("by_dial") > thresholds["number"]) & (F.col("by_dial") > F.col("by_label")) & ~F.col("other").contains("A")
    kind = F.when(person, "id_number").when(dialled, "phone")
    ids = numbers.withColumn("kind", kind).withColumn("bits", F.when(person, best).otherwise(F.col("by_dial"))).where("kind IS NOT NULL").select(*out)

    places = _with_bits(found.where("kind = 'place'"), stats, "spot", "before", "bits").where(F.col("bits") > thresholds["place"]).withColumn("kind", F.lit("address")).select(*out)

    names = _with_bits(found.where("kind IN ('name', 'maybe')"), stats, "word", "term", "by_family")
    names = _with_bits(_with_bits(names, stats, "before", "before", "by_before"), stats, "after", "after", "by_after")
    family, context = F.col("by_family") > thresholds["family"], F.greatest("by_before", "by_after") > thresholds["context"]
    names = cut(names.withColumn("family", family).withColumn("context", context).where("family OR context"))  # one of two is needed
    total = stats.where("feature = 'word'").agg((F.sum("hit") + 0.5) / (F.greatest(F.sum("n"), F.sum("hit")) + 1)).scalar()
    firsts = names.where("other IS NOT NULL").groupBy(F.col("other").alias("_word")).agg(F.count(F.lit(1)).alias("hit"))
    words = stats.where("feature = 'word'").select("term", "n")
    firsts = firsts.join(words, F.col("_word") == F.col("term")).withColumn("given_bits", F.log2(F.col("hit") / F.greatest("n", "hit") / total))
    firsts = firsts.where((F.col("given_bits") > thresholds["given"]) & (2 * F.col("hit") >= F.col("n"))).select("_word", "given_bits")
    judged = names.join(firsts, F.col("other") == F.col("_word"), "left")
    listed, learned = (F.col("kind") == "name") | F.col("other").isNull(), F.col("_word").isNotNull()
    votes = (listed | learned).cast("int") + F.col("family").cast("int") + F.col("context").cast("int")
    start = F.when(learned & (F.col("alt_start") > 0), F.col("alt_start")).otherwise(F.col("start_pos"))
    persons = judged.where(votes >= 2).select("doc_id", F.lit("name").alias("kind"), start.alias("start_pos"), "end_pos", F.greatest("by_family", "by_before", "by_after", "given_bits").alias("bits"))
    return direct.unionByName(ids).unionByName(places).unionByName(persons)


def redact(docs: DataFrame, doc_id: str, text: str, spans: DataFrame, remove: float | None = None) -> DataFrame:
    """doc_id, text with each span replaced by its placeholder, n_replaced; the rest is unchanged.

    ``remove``: spans that disclose fewer bits than this are generalised instead: a name to its initials, a number to its
    shape (# for a digit), an address to its street. Direct identifiers have no bits and are always removed.
    ``doc_id`` must be unique. Of overlapping spans the first (then the longest) counts. Texts without spans, null ones
    too, come out as they are. A document's spans are gathered in one row, so they are bounded by its text.
    """
    weak = F.coalesce(F.col("bits") < remove, F.lit(False)) if remove is not None else F.lit(False)
    per = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_pos", (-F.col("end_pos")).alias("e"), "kind", weak.alias("weak")))).alias("spans"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(per, "doc_id", "left")
    start = F.struct(F.lit(1).cast("long").alias("at"), F.lit("").alias("out"), F.lit(0).alias("n"))
    place = F.create_map(*[F.lit(x) for pair in PLACEHOLDER.items() for x in pair])

    def instead(s: Column) -> Column:
        if remove is None:
            return place[s["kind"]]
        was = F.substring(F.col("text"), s["start_pos"].cast("int"), (-s["e"] - s["start_pos"]).cast("int"))
        initials = F.regexp_replace(was, r"(\p{Lu})[\p{L}\p{M}’']+", "$1.")
        general = F.when(s["kind"] == "name", initials).when(s["kind"] == "id_number", F.regexp_replace(was, r"\d", "#")).when(s["kind"] == "address", F.trim(F.regexp_replace(was, r"\d+\p{Ll}?\b", "")))
        return F.when(s["weak"], F.coalesce(general, place[s["kind"]])).otherwise(place[s["kind"]])

    def step(acc, s):
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int"), (s["start_pos"] - acc["at"]).cast("int")), instead(s))
        return F.when(s["start_pos"] >= acc["at"], F.struct((-s["e"]).alias("at"), piece.alias("out"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    done = F.aggregate("spans", start, step, lambda acc: F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int"), F.lit(2147483647))).alias("out"), acc["n"].alias("n")))
    rows = rows.withColumn("_d", F.when(F.col("spans").isNotNull(), done))
    return rows.select("doc_id", F.coalesce("_d.out", "text").alias("text"), F.coalesce("_d.n", F.lit(0)).alias("n_replaced"))
