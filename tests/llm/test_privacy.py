"""Personal information: positions, what is no personal information, and unchanged remainders."""

import unicodedata

import pytest

from skyframe.llm import privacy

MEMBERS = [("Bexley", "Hulander", "PLU"), ("Théo", "Silwick", "GS"), ("Margaux", "Kesdow", "Ind.")]
GIVEN = ["Anto", "Hélène", "Käthe", "Wendel"]

CASES = [
    ("Write to a.b+c@post.co.example, or ring +999 72 440 31 35.", [("email", "a.b+c@post.co.example"), ("phone", "+999 72 440 31 35")]),
    ("Mail x_y [at] quay[dot]invalid or jo at quay dot co dot example or A-B @ HALM.TEST.", [("email", "x_y [at] quay[dot]invalid"), ("email", "jo at quay dot co dot example"), ("email", "A-B @ HALM.TEST")]),
    ("Tel. (0555) 148 920, 0555/409079, 05.55.50.55.95, 00999 577-1552, 0555 0173 480, +999(0)55528845, 555-0115.", [("phone", p) for p in ("(0555) 148 920", "0555/409079", "05.55.50.55.95", "00999 577-1552", "0555 0173 480", "+999(0)55528845", "555-0115")]),
    ("The vote stood at 192-115; docket 377/2021 lists 377 5050 crowns of 2 250 510, paper 91/46491, in 2032-2034.", []),
    ("A letter from Mrs Wynnless, Anto, insurance number 27-0442-1978, and Dr Wendel A. Perander.", [("name", "Wynnless, Anto"), ("id_number", "27-0442-1978"), ("name", "Wendel A. Perander")]),
    ("Das Schreiben an Frau Käthe van Dalrup, Versicherungsnummer QX 43 18 58 B, Am Hafen 73b in Halm.", [("name", "Käthe van Dalrup"), ("id_number", "QX 43 18 58 B"), ("address", "Am Hafen 73b")]),
    ("La lettre de M. Anto Lodsel, numéro d’assuré 1 31 08 12 345 678, au 151 bis, chemin de Halage.", [("name", "Anto Lodsel"), ("id_number", "1 31 08 12 345 678"), ("address", "151 bis, chemin de Halage")]),
    ("She lives at Flat 27, 169 Tanner Road, Halm QV4.", [("address", "Flat 27, 169 Tanner Road")]),
    ("The works on Tanner Road ran. Travaux de la rue des Cordiers. Die Gerbergasse dauerten von 2031-2033.", []),
    ("Reference 27-0442-1978 was printed on the envelope.", []),
    ("(Théo SILWICK, GS : Ce n’est pas vrai !) Mr B. Hulander asked. Kesdow, Margaux spoke.", []),
    ("THE PEOPLE I REPRESENT BEFORE A PRICE WE CAN AFFORD", []),
]


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    out = {}
    for r in privacy.personal_spans(df, "doc_id", "text", MEMBERS, GIVEN).collect():
        out.setdefault(r["doc_id"], []).append((r["kind"], texts[r["doc_id"]][r["start_pos"] - 1 : r["end_pos"] - 1]))
    return out, df


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_spans(spark, form):
    texts = [unicodedata.normalize(form, t) for t, _ in CASES]
    # the label's disclosure is an average over the corpus: it must hold more references than coincidences
    texts += ["Reference 27-0442-1978 was printed."] * 3 + [None, "", "Order. " * 20_000 + "Ring 555-0115."]
    got, _ = found(spark, texts)
    for i, (_, want) in enumerate(CASES):
        assert sorted(got.get(i, [])) == sorted((k, unicodedata.normalize(form, s)) for k, s in want), CASES[i][0]
    assert got[len(texts) - 1] == [("phone", "555-0115")]


def test_unlisted_given_names_are_learned(spark):
    texts = [f"A letter from Mrs Anto {f} and Wendel {f}." for f in ("Perander", "Lodsel", "Velmere")] * 3
    texts += ["Frau Henning Perander sagte. Henning B. Lodsel schrieb.", "Velmere, Henning kam.", "Grand Perander is a place with Grand views and Grand halls, Grand parks."]
    texts += ["The House met. Order was kept. Members spoke. Then The Table was laid. Nothing else."] * 30
    got, _ = found(spark, texts)
    assert sorted(got[9]) == [("name", "Henning B. Lodsel"), ("name", "Henning Perander")] and got[10] == [("name", "Velmere, Henning")]
    assert 11 not in got


def test_redaction_keeps_the_rest(spark):
    texts = [CASES[0][0], CASES[5][0], "nothing", None, ""]
    _, df = found(spark, texts)
    spans = privacy.personal_spans(df, "doc_id", "text", MEMBERS, GIVEN)
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in privacy.redact(df, "doc_id", "text", spans).collect()}
    assert got[0] == ("Write to [EMAIL], or ring [PHONE].", 2)
    assert got[1] == ("Das Schreiben an Frau [NAME], Versicherungsnummer [ID_NUMBER], [ADDRESS] in Halm.", 3)
    assert got[2] == ("nothing", 0) and got[3] == (None, 0) and got[4] == ("", 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert privacy.personal_spans(df, "doc_id", "text", MEMBERS, GIVEN).count() == 0
    assert privacy.personal_spans(df, "doc_id", "text", [], []).count() == 0
