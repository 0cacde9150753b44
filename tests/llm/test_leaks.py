"""Leak search against a word-by-word comparison."""

import random
import re
import unicodedata

import pytest

from skyframe.llm import leaks

WORDS = "canal prism glass über naïve Straße twelve 42 l'eau tide œuvre copper beads valley and of the".split()


def words(t):
    t = leaks.BROKEN.sub("", t or "").replace("­", "")
    t = "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.category(c).startswith("M"))
    return re.findall(r"[^\W_]+", t)


def dress(rng, text):
    """Change what does not matter."""
    out = text
    if rng.random() < 0.5:
        out = out.upper() if "ß" not in out else out
    if rng.random() < 0.5:
        out = unicodedata.normalize("NFD", out)
    if rng.random() < 0.5:
        out = out.replace(" ", rng.choice(["  ", ", ", "\n", " — "]))
    if rng.random() < 0.5:
        out = out.replace("opper", "op­per").replace("alley", "al-\nley")
    return out


def case(seed, n=120):
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice(WORDS) + (str(rng.randrange(30)) if rng.random() < 0.5 else "") for _ in range(k))
    items = [(i, line(rng.choice([5, 13, 20, 60]))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(n):
        text = line(rng.randrange(40))
        for _ in range(rng.choice([0, 1, 2])):
            own = rng.choice(items[:12])[1].split(" ")
            a = rng.randrange(len(own))
            part = own[a : a + rng.choice([8, 12, 13, 14, 30])]
            if rng.random() < 0.3 and len(part) > 6:
                part[5] = "(Applause)"
            text += rng.choice([" ", ". "]) + dress(rng, " ".join(part)) + " " + line(rng.randrange(10))
        docs.append((d, text, "x"))
    return items, docs


@pytest.mark.parametrize("seed", range(4))
def test_exact_runs(spark, seed):
    items, docs = case(seed)
    docs += [(500, None, "x"), (501, "", "x"), (502, items[3][1] + " end", "x"), (502, items[3][1] + " end", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_passages(df, "doc_id", "text", items, q=8).collect()}
    want = set()
    for i, p in items:
        w = words(p)
        grams = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        for d, t, _ in docs:
            u = words(t)
            if any(tuple(u[k : k + 13]) in grams for k in range(len(u) - 12)):
                want.add((d, i))
    assert want and got == want


def test_edits_are_found(spark):
    passage = "the canal surveyor repaired a cracked prism along the twin aqueduct before the abandoned comet crossed two constellations"
    changed = passage.replace("surveyor", "surveior").replace("aqueduct", "aqeduct")
    far = passage.replace("surveyor", "surxxxor").replace("prism", "pxxsm")
    df = spark.createDataFrame([(1, f"before {changed} after"), (2, f"so {far} on"), (3, passage), (4, "nothing here")], "doc_id long, text string")
    got = {r["doc_id"]: r["edits"] for r in leaks.leaked_passages(df, "doc_id", "text", [(7, passage)], edits=2, q=8).collect()}
    assert got[3] == 0 and 1 <= got[1] <= 2 and 4 not in got
    assert {r["doc_id"] for r in leaks.leaked_passages(df, "doc_id", "text", [(7, passage)]).collect()} == {3}


def test_empty_inputs_and_blocks(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    assert leaks.leaked_passages(df.limit(0), "doc_id", "text", [(1, "x")]).count() == 0
    assert leaks.leaked_passages(df, "doc_id", "text", []).count() == 0
    items = [(i, " ".join(f"word{i}x{k}" for k in range(15))) for i in range(5)]
    both = spark.createDataFrame([(1, items[4][1] + " " + items[0][1])], "doc_id long, text string")
    assert {r["item_id"] for r in leaks.leaked_passages(both, "doc_id", "text", items, block=2).collect()} == {0, 4}
    with pytest.raises(ValueError):
        leaks.PassageIndex([(1, "a b c d e f g h i j k l m n")], 13, 0, 64)


def test_every_altered_window_is_found(spark):
    """Windows of 13 words with one or two altered, lost or added letters stand in longer texts: all are found."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randint(16, 40)))) for i in range(20)]
    docs, done = [], {}
    for d in range(120):
        item, passage = rng.choice(items)
        w = passage.split(" ")
        a = rng.randrange(len(w) - 13)
        part = list(" ".join(w[a : a + 14]))
        edits = rng.choice([0, 1, 2])
        for _ in range(edits):
            at = rng.randrange(1, len(part) - 1)
            while part[at] == " " or part[at] == "":
                at = rng.randrange(1, len(part) - 1)
            part[at] = rng.choice(["", part[at] + "q", "q"])
        docs.append((d, " ".join(word() for _ in range(30)) + " " + "".join(part) + " " + " ".join(word() for _ in range(30))))
        done[d] = (item, edits)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in leaks.leaked_passages(df, "doc_id", "text", items, edits=2, q=8).collect()}
    assert all((d, item) in got and got[d, item] <= edits for d, (item, edits) in done.items())
