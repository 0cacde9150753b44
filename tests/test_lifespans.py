"""Schema drift against a plain comparison of neighbouring files."""

import random

from skyframe.operators import lifespans

SCHEMA = "stream string, file_no long, hdu string, smf_fn string, loaded_at timestamp, body string, pos string"


def body(fields):
    return "\n".join(f"{k:<8}= {v} / {d}" for k, (v, d) in fields.items())


def kind(v):
    if v.startswith("'"):
        return "string"
    return "" if v == "" else "boolean" if v in "TF" else "integer" if v.lstrip("+-").isdigit() else "real"


def expected(files):
    """files: {(stream, hdu): [(file_no, fields)] in order}"""
    out = set()
    for (s, h), seq in files.items():
        for (_, a), (n, b) in zip(seq, seq[1:]):
            gone, new = sorted(set(a) - set(b)), sorted(set(b) - set(a))
            for f in set(a) & set(b):
                if kind(a[f][0]) != kind(b[f][0]):
                    out.add((s, n, h, f, "retyped"))
            for f in list(gone):
                twin = next((g for g in new if g and a[f][1] and a[f][1].replace(" ", "").lower() == b[g][1].replace(" ", "").lower()), None)
                if twin:
                    out.add((s, n, h, f, "renamed"))
                    gone.remove(f)
                    new.remove(twin)
            out |= {(s, n, h, f, "removed") for f in gone} | {(s, n, h, f, "added") for f in new}
    return out


def run(spark, rows, block=4096):
    df = spark.createDataFrame(rows, SCHEMA)
    got = lifespans.changes(lifespans.ranked_files(df.drop("pos")), block).collect()
    return {(r["stream"], r["file_no"], r["hdu"], r["field"], r["change"]) for r in got}


def test_changes_match_brute_force_at_any_block_size(spark):
    rng = random.Random(5)
    files, rows = {}, []
    for stream in ("a", "b"):
        fields = {f"K{i}": ("1", f"note {i}") for i in range(6)}
        seq = []
        for n in range(40):
            if rng.random() < 0.4:
                k = rng.choice(sorted(fields))
                v, d = fields.pop(k)
                if rng.random() < 0.5:
                    fields[k.lower() if k[0].isupper() else k.upper()] = (v, d.upper())
                elif rng.random() < 0.5:
                    fields[k] = (rng.choice(["1", "2.5", "'x'", "T", ""]), d)
            if rng.random() < 0.2:
                fields[f"N{n}"] = ("3", f"new {n}")
            seq.append((n * 3, dict(fields)))
            rows.append((stream, n * 3, "primary", "f", None, body(fields), "clash"))
            if rng.random() < 0.2:
                rows.append(rows[-1])  # redelivered
        files[(stream, "primary")] = seq
    rng.shuffle(rows)
    want = expected(files)
    assert {c[4] for c in want} == {"renamed", "removed", "added", "retyped"}
    for block in (2, 3, 7, 4096):
        assert run(spark, rows, block) == want


def test_nulls_empty_and_odd_bodies(spark):
    long = "\n".join(f"F{i} = {i} / d{i}" for i in range(500))
    rows = [
        ("s", 1, "primary", None, None, "A = 1 / x\nA = 'twice' / y\nno card\n= 3\nURL = 'a/b''c' / p", None),
        ("s", 2, "primary", None, None, "", None), ("s", 3, "primary", None, None, long, None),
        (None, 4, "primary", None, None, "A = 1", None), ("s", None, "primary", None, None, "A = 1", None), ("s", 5, None, None, None, "A = 1", None), ("s", 6, "primary", None, None, None, None),
        ("s", 1, "XY33.psf", None, None, "TTYPE1 = 'ra' / a\nTFORM1 = 'D'\nTTYPE2 = 'x' / b", None), ("s", 2, "XY33.psf", None, None, "TTYPE1 = 'ra' / a\nTFORM1 = 'E'\nTTYPE2 = 'x' / b\nTFORM2 = 'J'", None),
    ]
    got = run(spark, rows)
    assert {(2, "A", "removed"), (2, "URL", "removed")} == {(n, f, c) for _, n, h, f, c in got if n == 2 and h == "primary"}
    assert len([1 for _, n, h, _, _ in got if n == 3]) == 500
    assert {(f, c) for _, _, h, f, c in got if h == "XY33.psf"} == {("ra", "retyped"), ("x", "retyped")}


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_lifespans_and_table(spark):
    rows = [("s", n, "primary", "f", None, b, None) for n, b in enumerate(["A = 1 / one", "A = 2 / one", "B = 2.5 / ONE", "A = 3 / one\nC = T / flag"])]
    files = lifespans.ranked_files(spark.createDataFrame(rows, SCHEMA).drop("pos"))
    for block in (2, 3, 100):
        spans = {(r["field"], r["first_file"], r["last_file"], r["n_files"]) for r in lifespans.lifespans(files, block).collect()}
        assert spans == {("A", 0, 1, 2), ("B", 2, 2, 1), ("A", 3, 3, 1), ("C", 3, 3, 1)}
    table = {r["file_no"]: (r["A"], r["C"]) for r in lifespans.consistent_table(files).collect()}
    assert table == {0: (1.0, None), 1: (2.0, None), 2: (2.5, None), 3: (3.0, True)}


def test_no_value_is_lost_where_types_differ(spark):
    bodies = ["A = T / a\nB = F / b\nC = 1 / c\nD = 1 / d\nE = T / e\nF = 1.5D3 / f", "A = 7 / a\nB = 2.5 / b\nC = 99999999999999999999 / c\nD = 2.5 / d\nE = F / e\nF = 2 / f"]
    rows = [("s", n, "primary", "f", None, b, None) for n, b in enumerate(bodies)]
    files = lifespans.ranked_files(spark.createDataFrame(rows, SCHEMA).drop("pos"))
    table = [tuple(r[c] for c in "ABCDEF") for r in sorted(lifespans.consistent_table(files).collect(), key=lambda r: r["file_no"])]
    assert table == [("T", "F", "1", 1.0, True, "1.5D3"), ("7", "2.5", "99999999999999999999", 2.5, False, "2")]


def test_table_units_come_with_the_type_of_all_files(spark):
    codes = [("J", "J", "J"), ("I", "J", "J"), ("B", "E", "E"), ("J", "E", "D"), ("K", "D", "string"), ("L", "J", "string"), ("1J", "J", "J"), ("8A", "16A", "16A"), ("3E", "D", "3D"), ("PE(9)", "PE(9)", "PE(9)"), ("PE(9)", "PE(8)", "string"), ("C", "M", "M")]
    unit = lambda k: "\n".join(f"TTYPE{i} = 'c{i}{'x' * k}' / note {i}\nTFORM{i} = '{c[k]}'" for i, c in enumerate(codes, 1))
    bodies = [("primary", 0, "A = 1 / one\nHDU = 5 / key"), ("primary", 1, "A = 2 / one"), ("XY33.psf", 0, unit(0)), ("XY33.psf", 1, unit(1)), ("XY33.psf", 2, "TFIELDS = 0")]
    rows = [("s", n, h, "f", None, b, None) for h, n, b in bodies]
    files = lifespans.ranked_files(spark.createDataFrame(rows, SCHEMA).drop("pos"))
    got = {(r["hdu"], r["file_no"]): r for r in lifespans.all_units(files).collect()}
    assert set(got) == {(h, n) for h, n, _ in bodies}
    assert (got["primary", 0]["A"], got["primary", 1]["A"], got["primary", 0]["HDU_"], got["primary", 0]["columns"]) == (1, 2, 5, None)
    for k in (0, 1):
        assert [tuple(c) for c in got["XY33.psf", k]["columns"]] == [(f"c{i}", c[2], f"c{i}{'x' * k}", c[k], i) for i, c in enumerate(codes, 1)]
    assert got["XY33.psf", 2]["columns"] == [] and got["XY33.psf", 1]["A"] is None
