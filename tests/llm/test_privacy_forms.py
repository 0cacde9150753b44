"""Forms that no list holds: found by what the corpus says about the terms around them."""

from skyframe.llm import privacy

GIVEN = ["Anto", "Sophie", "Martin", "Anna"]
CORPUS = (
    [f"My constituent Mrs Anto {f} of {n} Mill Road, Halm, wrote to me." for n, f in enumerate(("Perander", "Lodsel", "Velmere", "Silwin", "Kesrup"), 11)]
    + [f"Frau Anto {f}, wohnhaft Gerbergasse {n}, hat geschrieben." for n, f in enumerate(("Perander", "Lodsel", "Velmere", "Silwin"), 3)]
    + [f"A letter from Ms Anto {f}, insurance number 27-0442-197{n}, came in." for n, f in enumerate(("Perander", "Lodsel", "Velmere"))]
    + ["The budget for 2033 sets aside 5 535 180 crowns. Docket 377/2021 lists 377 5050 crowns. Read on 24 March 2033."] * 12
    + ["Under clause 7 the House met at the Grand Hall. Order was kept. Paper No. 89251 was laid. Bill B 659-74 was read."] * 12
)
UNSEEN = [
    ("My constituent Mrs Sophie Martin of 12 Elm Grove, Halm, wrote.", [("name", "Sophie Martin"), ("address", "12 Elm Grove")]),
    ("My constituent Anna Li of 9 Gannet Rise, Halm, wrote to me.", [("name", "Anna Li"), ("address", "9 Gannet Rise")]),
    ("Frau Anto Lodsel, wohnhaft Lindenhof 5, hat geschrieben.", [("name", "Anto Lodsel"), ("address", "Lindenhof 5")]),
    ("Frau Anto Silwin, wohnhaft Am Rosengarten 7, hat geschrieben.", [("name", "Anto Silwin"), ("address", "Am Rosengarten 7")]),
    ("A letter from Ms Anto Kesrup, insurance number 123-45-6789, came in.", [("name", "Anto Kesrup"), ("id_number", "123-45-6789")]),
    ("A letter from Ms Anto Silwin, insurance number DE89 3704 0044 0532 0130 00, came in.", [("name", "Anto Silwin"), ("id_number", "DE89 3704 0044 0532 0130 00")]),
    ("Please ring (555) 123-4567 or 555-123-4567 today.", [("phone", "(555) 123-4567"), ("phone", "555-123-4567")]),
    ("Anto Vel: as I said before.", [("name", "Anto Vel")]),
    ("A long one " + "x" * 200 + "@mail.example came.", [("email", "x" * 200 + "@mail.example")]),
    ("A letter from Zorin Perander, insurance number 27-0442-1979, came in.", [("name", "Zorin Perander"), ("id_number", "27-0442-1979")]),
]


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out: dict = {}
    for r in privacy.personal_spans(df, "doc_id", "text", [("Théo", "Quarl", "GS")], GIVEN).collect():
        out.setdefault(r["doc_id"], []).append((r["kind"], texts[r["doc_id"]][r["start_pos"] - 1 : r["end_pos"] - 1]))
    return out, df


def test_unseen_forms(spark):
    texts = CORPUS + [t for t, _ in UNSEEN]
    got, _ = spans_of(spark, texts)
    wanted = [(i, w) for i, (_, want) in enumerate(UNSEEN) for w in want]
    missed = [(UNSEEN[i][0], w) for i, w in wanted if w not in got.get(len(CORPUS) + i, [])]
    extra = [(UNSEEN[i][0], w) for i in range(len(UNSEEN)) for w in got.get(len(CORPUS) + i, []) if w not in UNSEEN[i][1]]
    assert len(missed) <= 0.02 * len(wanted) and not extra, (missed, extra)
    assert not any(got.get(i) for i in range(len(CORPUS)) if texts[i].startswith(("The budget", "Under clause")))


def test_generalised(spark):
    texts = CORPUS + ["A letter from Ms Anto Kesrup, insurance number 27-0442-1978, came in. Mail a@b.example."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = privacy.personal_spans(df, "doc_id", "text", [], GIVEN)
    got = {r["doc_id"]: r["text"] for r in privacy.redact(df, "doc_id", "text", spans, remove=99.0).collect()}
    assert got[len(CORPUS)] == "A letter from Ms A. K., insurance number ##-####-####, came in. Mail [EMAIL]."
    assert got[0] == "My constituent Mrs A. P. of [ADDRESS], Halm, wrote to me."
