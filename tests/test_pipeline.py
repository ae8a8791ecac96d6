"""Overlaps, NER validation, mapping, surrogates, splice and invariants."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pseudoveil.functions import vocab as V
from pseudoveil.functions.text import normalize_key
from pseudoveil.operators import ner as N
from pseudoveil.operators.findings import resolve_overlaps, suppressed_values
from pseudoveil.operators.mapping import assign_surrogates, empty_mapping
from pseudoveil.operators.redact import Config, redact_documents, redact_table, redact_units, splice_text
from pseudoveil.operators.surrogates import surrogate, surrogate_id
from pseudoveil.sources.mapping_io import load_mapping, mapping_from_json_text, save_mapping

FT = ("array<struct<pii_type:string,value:string,start:int,end:int,confidence:string,"
      "source:string,score:int,seq:int>>")


def _resolve(spark, rows):
    df = spark.createDataFrame([(rows,)], f"f {FT}")
    out = df.select(resolve_overlaps(F.col("f")).alias("k")).first()["k"]
    return [(r["start"], r["end"], r["confidence"]) for r in out]


def test_overlap_earlier_start_wins(spark):
    rows = [("A", "x", 0, 10, "MEDIUM", "s", None, 0), ("A", "x", 5, 20, "HIGH", "s", None, 1),
            ("A", "x", 10, 12, "HIGH", "s", None, 2), ("A", "x", 11, 30, "HIGH", "s", None, 3),
            ("A", "x", 12, 13, "HIGH", "s", None, 4)]
    assert _resolve(spark, rows) == [(0, 10, "MEDIUM"), (10, 12, "HIGH"), (12, 13, "HIGH")]


def test_overlap_longer_then_order(spark):
    rows = [("A", "x", 0, 5, "HIGH", "s", None, 1), ("A", "x", 0, 9, "HIGH", "s", None, 2),
            ("P", "y", 3, 9, "HIGH", "ner", 7, 7), ("P", "y", 3, 9, "HIGH", "context", 7, 8)]
    assert _resolve(spark, rows) == [(0, 9, "HIGH")]


def test_normalize_key(spark):
    df = spark.createDataFrame([("the BSE Limited",), ("BSE   Limited",), ("bse limited",), ("Straße",)], "v string")
    got = [r[0] for r in df.select(normalize_key(F.col("v"))).collect()]
    assert got == ["bse limited"] * 3 + ["strasse"]


def _gate(spark, values, propn=None):
    df = spark.createDataFrame([(v, propn) for v in values], "v string, p int")
    return [r[0] for r in df.select(N.looks_like_person_name(F.col("v"), F.col("p"))).collect()]


def test_person_gate(spark):
    assert _gate(spark, ["R. K. Sharma"]) == [False]
    assert _gate(spark, ["Devendra P. Salunkhe"], propn=2) == [True]
    assert _gate(spark, ["Nikhil Menon", "Garden Colony", "Zenith Electricals", "Bank Road"]) == [True, False, False, False]


def test_person_scores(spark):
    df = spark.createDataFrame([
        ("Nikhil Menon went home", 0, 12, "Nikhil Menon"),
        ("Nikhil Menon sold shares", 0, 12, "Nikhil Menon"),
        ("Mr. Nikhil Menon sold shares", 4, 16, "Nikhil Menon"),
    ], "t string, s int, e int, v string")
    got = [r[0] for r in df.select(N.person_confidence(F.col("t"), F.col("s"), F.col("e"), F.col("v"))["score"]).collect()]
    assert got == [7, 4, 7]


def test_org_gate(spark):
    df = spark.createDataFrame([(v,) for v in ["BSE Limited", "Bank of Baroda", "Pure Zinc", "the Offer Limited",
                                                "Bank Limited", "Bank of", "Bank"]], "v string")
    got = [r[0] for r in df.select(N.looks_like_organization(F.col("v"))).collect()]
    assert got == [True, True, True, False, False, False, False]


def test_first_mention(spark):
    text = "Nikhil Menon met Nikhil  Menon"
    df = spark.createDataFrame([(text,)], "text string")
    cands = N.capitalised_run_candidates(F.col("text"))
    out = df.select(N.score_candidates(F.col("text"), cands).alias("s")).first()["s"]
    assert [(s["value"], s["start"]) for s in out] == [("Nikhil Menon", 0)]


def test_splice_emoji(spark):
    df = spark.createDataFrame([("😀 a@b.co and c@d.org!", [(2, 8, "X"), (13, 20, "LONGER")])],
                               "t string, e array<struct<start:int,end:int,replacement:string>>")
    assert df.select(splice_text(F.col("t"), F.col("e"))).first()[0] == "😀 X and LONGER!"


def test_surrogates_unique(spark):
    keys = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "PERSON").when(F.col("id") % 3 == 1, "EMAIL").otherwise("PHONE").alias("pii_type"),
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("norm_key"),
        F.concat(F.lit("K"), F.col("id").cast("string")).alias("surface"))
    new = assign_surrogates(keys, empty_mapping(spark), buckets=64)
    assert new.count() == 20000
    assert new.select("replacement").distinct().count() == 20000


def test_suppression_exact_both_ways(spark):
    vals = spark.createDataFrame([("ram kumar",), ("ram kumar das ji",), ("xyz",), ("am",), ("",)], "norm string")
    fakes = spark.createDataFrame([("ram kumar das",), ("q",)], "fake string")
    got = sorted(r[0] for r in suppressed_values(vals, fakes).collect())
    assert got == ["am", "ram kumar", "ram kumar das ji"]
    assert suppressed_values(vals, fakes.where("false")).count() == 0


def test_mapping_json_two_step_parse(spark):
    doc = spark.createDataFrame([('{"PERSON":{"A":"B","the  C":"D"},"X":5,"EMAIL":{"e@x.io":" "}}',)], "value string")
    rows = sorted((r["pii_type"], r["surface"], r["replacement"]) for r in mapping_from_json_text(doc).collect())
    assert rows == [("PERSON", "A", "B"), ("PERSON", "the  C", "D")]


def test_mapping_missing_and_invalid(spark, tmp_path):
    assert load_mapping(spark, str(tmp_path / "missing.json")).count() == 0
    bad = tmp_path / "bad.json"
    bad.write_text("{oops")
    assert load_mapping(spark, str(bad)).count() == 0
    arr = tmp_path / "arr.json"
    arr.write_text("[]")
    assert load_mapping(spark, str(arr)).count() == 0


def _docs(spark):
    rows = [(1, "Contact a@b.co or +91 98765 43210.\nmanaging director: Nikhil Menon"),
            (2, "Mail a@b.co again; SSN 123-45-6789"),
            (3, "nothing here"),
            (4, "   ")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_redact_invariants(spark, tmp_path):
    docs = _docs(spark)
    res = redact_documents(docs, config=Config(ner="off"))
    out = {r["doc_id"]: r["text"] for r in res.output.collect()}
    m = res.mapping.collect()
    fake = {(r["pii_type"], r["norm_key"]): r["replacement"] for r in m}
    assert out[3] == "nothing here" and out[4] == "   "
    email = fake[("EMAIL", "a@b.co")]
    assert out[1].count(email) == 1 and out[2].count(email) == 1
    assert "a@b.co" not in out[1] + out[2] and "Nikhil Menon" not in out[1]
    assert len({r["replacement"] for r in m}) == len(m)
    # rerun with the saved mapping: same output, no new rows
    res2 = redact_documents(docs, mapping=res.mapping, config=Config(ner="off"))
    assert {r["doc_id"]: r["text"] for r in res2.output.collect()} == out
    assert res2.new_mapping.count() == 0
    # repartitioning the input does not change anything
    res3 = redact_documents(docs.repartition(3), config=Config(ner="off"))
    assert {r["doc_id"]: r["text"] for r in res3.output.collect()} == out
    # JSON edge round trip
    save_mapping(res.mapping, str(tmp_path / "run.json"), "json")
    assert whole_json(tmp_path / "run.json")["EMAIL"]["a@b.co"] == email


def test_redact_table_cells(spark):
    df = spark.createDataFrame([(1, "a@b.co", "keep", "SSN 123-45-6789")], "id long, c1 string, c2 string, c3 string")
    res = redact_table(df, "id", ["c1", "c3"], config=Config(ner="off"))
    row = res.output.first()
    assert row["c2"] == "keep" and "@example.net" in row["c1"] and "123-45-6789" not in row["c3"]


def test_category_counts_all_zero(spark):
    from pseudoveil.operators.audit import category_counts
    empty = spark.createDataFrame([], "pii_type string, value string")
    rows = category_counts(empty).collect()
    assert [r["category"] for r in rows][:3] == ["PERSON", "ORGANIZATION", "EMAIL"]
    assert all(r["distinct_values"] == 0 for r in rows) and len(rows) == 9


def test_hot_value_on_a_third_of_rows(spark):
    """One value on ~1/3 of all documents: one key, one fake, every copy replaced."""
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("write to hot@x.org today"))
        .otherwise(F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@y.org"))).alias("text"))
    res = redact_documents(docs, config=Config(ner="off"))
    m = res.new_mapping
    assert m.count() == 1 + 2000
    hot = m.where("norm_key = 'hot@x.org'").first()["replacement"]
    out = res.output
    assert out.where(F.col("text") == f"write to {hot} today").count() == 1000
    assert out.where(F.col("text").contains("@y.org") | F.col("text").contains("hot@x.org")).count() == 0


# --- reruns, uncapped surrogates, row identity

def many_keys(spark, pii_type, n):
    return spark.range(n).select(F.lit(pii_type).alias("pii_type"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("norm_key"),
                                 F.concat(F.lit("K"), F.col("id").cast("string")).alias("surface"))


def test_surrogates_have_no_capacity(spark):
    from pseudoveil.operators.surrogates import surrogate
    for t in V.CATEGORIES:
        ids = spark.createDataFrame([(x + k,) for x in (0, 33_000, 10 ** 6, 4 * 10 ** 6, 2 ** 28 - 3, 10 ** 9 - 3, 4 * 10 ** 12, 10 ** 15)
                                     for k in range(7)], "id long")
        rows = [r[0] for r in ids.select(surrogate(F.lit(t), F.col("id"))).collect()]
        assert len(set(rows)) == len(rows) and None not in rows and "" not in rows


def test_many_dates_and_organisations(spark):
    new = assign_surrogates(many_keys(spark, "DATE", 60_000).union(many_keys(spark, "ORGANIZATION", 60_000)), empty_mapping(spark))
    assert new.select("replacement").distinct().count() == 120_000


def test_append_to_a_json_mapping_and_other_bucket_counts(spark):
    first = assign_surrogates(many_keys(spark, "EMAIL", 3000), empty_mapping(spark), buckets=1024)
    from_json = first.withColumn("id", F.lit(None).cast("bigint"))
    more = many_keys(spark, "EMAIL", 3200).where(F.substring("norm_key", 2, 9).cast("int") >= 3000)
    for old in (from_json, first):
        new = assign_surrogates(more, old, buckets=64)
        assert new.count() == 200
        assert old.select("replacement").union(new.select("replacement")).distinct().count() == 3200


def test_fakes_avoid_observed_values(spark):
    from pseudoveil.operators.surrogates import surrogate
    taken = spark.range(20).select(surrogate(F.lit("PHONE"), F.col("id")).alias("v"))
    keys = taken.select(F.lit("PHONE").alias("pii_type"), normalize_key(F.col("v")).alias("norm_key"), F.col("v").alias("surface"))
    new = assign_surrogates(keys, empty_mapping(spark))
    assert new.count() == 20
    assert new.join(taken, new.replacement == taken.v).count() == 0


def test_second_run_leaves_nothing_in_clear(spark):
    docs = spark.range(1024).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("host 10.0."), F.expr("id div 256").cast("string"), F.lit("."), (F.col("id") % 256).cast("string"), F.lit(" up")).alias("text"))
    res = redact_documents(docs, config=Config(ner="off"))
    once = {r.doc_id: r.text for r in res.output.collect()}
    again = redact_documents(docs, mapping=res.mapping, config=Config(ner="off"))
    assert {r.doc_id: r.text for r in again.output.collect()} == once
    assert not any("host 10.0." in t for t in once.values()) and again.new_mapping.count() == 0


def test_rows_sharing_an_id_keep_their_own_edits(spark):
    rows = [(1, "mail a@b.co please"), (1, "call +91 98765 43210"), (1, "mail a@b.co please"), (None, "mail c@d.org")]
    out = [r.text for r in redact_documents(spark.createDataFrame(rows, "doc_id long, text string"), config=Config(ner="off")).output.collect()]
    assert len(out) == 4 and sorted(t.split()[0] for t in out) == ["call", "mail", "mail", "mail"]
    assert sum(t.endswith("@example.net please") for t in out) == 2 and not any("98765" in t or "a@b" in t or "c@d" in t for t in out)
    table = spark.createDataFrame([(7, "a@b.co"), (7, "x c@d.org y")], "k long, c string")
    cells = sorted(r.c for r in redact_table(table, "k", ["c"], config=Config(ner="off")).output.collect())
    assert cells[0].endswith("@example.net") and cells[1].startswith("x ") and cells[1].endswith("@example.net y")


def test_callers_column_names_stay(spark):
    df = spark.createDataFrame([(5, "mail a@b.co", 1, "t")], "id long, body string, doc_id int, text string")
    out = redact_documents(df, config=Config(ner="off"), id_col="id", text_col="body").output
    assert out.columns == ["id", "body", "doc_id", "text"] and "@example.net" in out.first().body


def test_invalid_mapping_warns(spark, tmp_path):
    bad = tmp_path / "m.json"
    bad.write_text("{oops")
    with pytest.warns(UserWarning, match="not a JSON object"):
        assert load_mapping(spark, str(bad)).count() == 0


def test_tagger_callable(spark):
    import pandas as pd

    def tagger(frames):
        for f in frames:
            yield pd.DataFrame([(r.doc_id, "Nikhil Menon", "PERSON", 0, 12, 2, 0) for r in f.itertuples() if "Nikhil" in r.text],
                               columns=["doc_id", "value", "label", "start", "end", "propn_count", "initial_count"])

    units = spark.createDataFrame([(1, "Nikhil Menon went home"), (2, "nobody")], "doc_id long, text string")
    rows = N.tagged_candidates(units, ["doc_id"], tagger).collect()
    assert [(r.doc_id, r.value, r.propn_count) for r in rows] == [(1, "Nikhil Menon", 2)]


# --- null ids, JSON in parts, ids read back from fakes

def test_rows_without_an_id_are_redacted(spark):
    rows = [(None, "mail anna.b@corp.co now"), (None, "call +91 98765 43210"), (1, "mail anna.b@corp.co now"), (None, None), (2, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(Row(t="Nikhil Menon went home"),)], "r struct<t:string>").select(F.lit(None).cast("long").alias("doc_id"), "r.t")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for d in (docs, docs.repartition(3)):
            out = sorted((str(r.doc_id), str(r.text)) for r in redact_documents(d, config=Config(ner="off")).output.collect())
            assert len(out) == 5 and not any("anna.b" in t or "98765" in t for _, t in out)
            assert sum(t.endswith("@example.net now") for _, t in out) == 2
        units = table.select("doc_id", F.lit("paragraph").alias("unit_kind"), F.lit(0).alias("unit_no"), F.col("t").alias("text"))
        cands = spark.createDataFrame([(None, "paragraph", 0, "Nikhil Menon", "PERSON", 0, 12, 2, 0)],
                                      "doc_id long, unit_kind string, unit_no long, value string, label string, start int, end int, "
                                      "propn_count int, initial_count int")
        found = redact_units(units, config=Config(ner="table"), candidates=cands).output.collect()
        assert "Nikhil" not in found[0]["text"]
        cells = spark.createDataFrame([(None, "a@b.co"), (None, "c")], "k long, c string")
        assert sorted(r.c for r in redact_table(cells, "k", ["c"], config=Config(ner="off")).output.collect())[0] == "c"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_surrogate_ids_are_read_back(spark):
    for t in V.CATEGORIES:
        ids = spark.createDataFrame([(x + k,) for x in (0, 395, 10 ** 6, 2 ** 28 - 3, 10 ** 9 - 3, 10 ** 15) for k in range(6)], "id long")
        back = ids.withColumn("v", surrogate(F.lit(t), F.col("id"))).select("id", surrogate_id(F.lit(t), F.col("v")).alias("b"))
        assert all(r.id == r.b for r in back.collect())
    other = ["", "x", "Asha Rao", "A b. C", "12, x y, z - 400001", "10.0.0.1", "foo.bar1@example.net", "99 January 2020", "9" * 400, None,
             "+91 9000", "901-00-0001", "2001:db8:0:0:zz:1:1:1"]
    rows = spark.createDataFrame([(t, v) for t in [*V.CATEGORIES, "X"] for v in other], "t string, v string")
    assert rows.select(surrogate_id(F.col("t"), F.col("v")).alias("b")).where("b is not null").count() == 0


def test_a_large_json_mapping_is_extended_in_one_round(spark, tmp_path):
    import time
    first = assign_surrogates(many_keys(spark, "EMAIL", 20_000), empty_mapping(spark))
    path = str(tmp_path / "m.json")
    save_mapping(first, path, "json")
    loaded = load_mapping(spark, path)
    assert loaded.where("id is null").count() == 0
    t0 = time.time()
    new = assign_surrogates(many_keys(spark, "EMAIL", 20_200).where(F.substring("norm_key", 2, 9).cast("int") >= 20_000), loaded)
    ids = sorted(r.id for r in new.collect())
    assert ids == list(range(20_000, 20_200)) and time.time() - t0 < 60


def whole_json(path):
    parts = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
    return json.loads("".join(p.read_text() for p in parts))


def test_json_object_in_parts(spark, tmp_path):
    odd = [("PERSON", f"k{i}", f"Key {i}", f"Fake {i}") for i in range(500)]
    odd += [("X Y", 'q"', 'quote " back\\ new\nline', "naïve 😀"), ("A", "one", "one", "only, comma,"), ("Z", "t", "tab\t", "{}")]
    m = spark.createDataFrame([(*r, None) for r in odd], "pii_type string, norm_key string, surface string, replacement string, id long")
    want = {}
    for t, _, s, r in odd:
        want.setdefault(t, {})[s] = r
    save_mapping(m.repartition(4), str(tmp_path / "m.json"), "json")
    assert whole_json(tmp_path / "m.json") == want
    got = {(r.pii_type, r.surface, r.replacement) for r in load_mapping(spark, str(tmp_path / "m.json")).collect()}
    assert got == {(t, s, r) for t, _, s, r in odd}
    save_mapping(m.limit(0), str(tmp_path / "none.json"), "json")
    assert whole_json(tmp_path / "none.json") == {} and load_mapping(spark, str(tmp_path / "none.json")).count() == 0


def test_indented_json_is_read_by_lines(spark, tmp_path):
    from pseudoveil.sources.mapping_io import _mapping_from_lines
    data = {"PERSON": {f"Ann {i}": f"Bea {i}" for i in range(300)}, "EMAIL": {"e@x.io": "f@y.io", "": "z"}, "SSN": {"blank": " "}}
    f = tmp_path / "m.json"

    def loaded(text, by_lines=None):
        f.write_text(text, encoding="utf-8")
        assert by_lines is None or (_mapping_from_lines(spark, str(f)) is not None) == by_lines
        return {(r.pii_type, r.surface, r.replacement) for r in load_mapping(spark, str(f)).collect()}

    want = {(t, s, r) for t, e in data.items() for s, r in e.items() if r.strip()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")               # many blocks of one file
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert loaded(json.dumps(data, indent=4), True) == want
        assert loaded(json.dumps(data), False) == want                        # one line: parsed as a document
        assert loaded(json.dumps({**data, "N": 5, "M": {}}, indent=4), False) == want
        twice = json.dumps(data, indent=4)[:-2] + ',\n    "EMAIL": {\n        "last@x.io": "wins@y.io"\n    }\n}'
        assert {r for r in loaded(twice, True) if r[0] == "EMAIL"} == {("EMAIL", "last@x.io", "wins@y.io")}
        text = json.dumps(data, indent=4)
        for broken in (text[:-1], text.replace('Bea 7",', 'Bea 7"'), text.replace("    },", "    }", 1)):
            with pytest.warns(UserWarning, match="not a JSON object"):
                assert loaded(broken) == set()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_key_filter_keeps_every_key(spark):
    from pseudoveil.operators.key_filter import bits_for, key_filter, may_hold
    for n in (0, 1, 3000, 50_000):
        bits = bits_for(n)
        held = key_filter(spark.range(n).select(F.xxhash64("id")), bits)
        tested = spark.range(100_000).select("id", may_hold(held, F.xxhash64("id"), bits).alias("in"))
        inside = tested.where("in").agg(F.count_if(F.col("id") < n).alias("kept"), F.count_if(F.col("id") >= n).alias("more")).first()
        assert inside.kept == n and inside.more < 0.1 * 100_000


def test_first_mentions_in_a_unit_of_many_names(spark):
    """40 000 names in one unit: near-linear, in the order of the unit, organisations untouched."""
    import time
    n = 40_000
    cand = "struct<value:string,label:string,start:int,end:int,propn_count:int,initial_count:int>"
    units = spark.range(1).selectExpr("'x' as text", f"""transform(sequence(0, {n - 1}), i -> named_struct('value', concat('Name ', i % 30000),
        'label', if(i % 10 = 9, 'ORG', 'PERSON'), 'start', i * 2, 'end', i * 2 + 1, 'propn_count', cast(null as int), 'initial_count', cast(null as int))) as cands""")
    named = units.select(N.first_mentions(N._named(F.col("cands").cast(f"array<{cand}>"))).alias("f"))
    t0 = time.time()
    got = [r.start // 2 for r in named.first().f]
    seen, want = set(), []
    for i in range(n):
        if i % 10 == 9 or i % 30000 not in seen:
            want.append(i)
            if i % 10 != 9:
                seen.add(i % 30000)
    assert got == want and time.time() - t0 < 60


def test_a_block_of_refused_fakes_is_passed_over(spark, monkeypatch):
    """Part of an e-mail fake is an original, so hundreds of neighbouring ids are refused: few judgements and rounds,
    and the same ids as key after key in a queue gets."""
    from pyspark.sql import functions as F

    from pseudoveil.operators import mapping as M
    from pseudoveil.operators.surrogates import surrogate
    names = [f"u{i}@x.org" for i in range(30)] + ["tt0@example.net", "hul.kulsh0@example.net"]
    keys = spark.createDataFrame([("EMAIL", n, n) for n in names], "pii_type string, norm_key string, surface string")
    given = [("EMAIL", f"old{i}@y.org", f"old{i}@y.org", f, n) for i, (n, f) in enumerate([(7995, "kept@example.net"), (9, "zz@example.net")])]
    loaded = spark.createDataFrame(given, M.MAPPING_SCHEMA)
    seen = []
    monkeypatch.setattr(M, "written", lambda df, name, real=M.written: seen.append(name) or real(df, name))
    rows = M.assign_surrogates(keys, loaded, 16).collect()
    got = {r["norm_key"]: r["id"] for r in rows}
    fakes = [r[0] for r in spark.range(40_000).select(surrogate(F.lit("EMAIL"), F.col("id"))).collect()]
    queue = [r["norm_key"] for r in M.dense_ids(keys, 16).orderBy("rank").collect()]
    observed, want, at = [*names, "old0@y.org", "old1@y.org"], {}, 7996
    while queue:
        key = queue.pop(0)
        if any(o in fakes[at] or fakes[at] in o for o in observed):
            queue.append(key)
        else:
            want[key] = at
        at += 1
    assert at > 8000 + 2000 and got == want and len(rows) == len(want)
    assert seen.count("judged") <= 4 and seen.count("placed") <= 12


def test_containment_finds_strings_of_every_length(spark):
    import random

    from pseudoveil.operators.findings import suppressed_values
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ab😀é") for _ in range(rng.choice([1, 5, 7, 8, 9, 12, 30])))
    values, fakes = sorted({word() for _ in range(300)}), sorted({"".join(w) for w in ([word(), word()] for _ in range(200))})
    values, fakes = [v for v in values if len(v) > 4], [f for f in fakes if len(f) > 4]
    got = {r[0] for r in suppressed_values(spark.createDataFrame([(v,) for v in [*values, "", None]], "norm string"),
                                           spark.createDataFrame([(f,) for f in [*fakes, "", None]], "fake string")).collect()}
    assert got == {v for v in values if any(v in f or f in v for f in fakes)} and 0 < len(got) < len(values)


def test_values_that_no_fake_avoids_do_not_stop_the_job(spark, monkeypatch):
    """``le`` is part of every e-mail fake, and ``it`` and ``llp`` together of every organisation: such values refuse
    nothing, others still do, and keys placed round by round get the same ids."""
    from pseudoveil.operators import mapping as M
    from pseudoveil.operators.surrogates import surrogate
    names = [("EMAIL", f"u{i}@x.org") for i in range(40)] + [("ORGANIZATION", f"o{i}") for i in range(20)] + [("PERSON", "le"), ("PERSON", "it")]
    names += [("PERSON", "hul"), ("ORGANIZATION", "llp"), ("PERSON", "l. a"), ("PERSON", "ule")]
    keys = spark.createDataFrame([(t, n, n) for t, n in names], "pii_type string, norm_key string, surface string")
    passed = {"EMAIL": {"le"}, "ORGANIZATION": {"it", "llp"}, "PERSON": set()}
    want = {}
    for t, over in passed.items():
        fakes = [r[0].lower() for r in spark.range(40_000).select(surrogate(F.lit(t), F.col("id"))).collect()]
        queue = [r["norm_key"] for r in M.dense_ids(keys.where(F.col("pii_type") == t), 16).orderBy("rank").collect()]
        for i, f in enumerate(fakes):
            if queue:
                key = queue.pop(0)
                if any((o in f and o not in over) or f in o for _, o in names):
                    queue.append(key)
                else:
                    want[t, key] = i
        assert not queue
    for most in (M.LOCAL, 0):
        monkeypatch.setattr(M, "LOCAL", most)
        rows = M.assign_surrogates(keys, empty_mapping(spark), 16).collect()
        assert {(r["pii_type"], r["norm_key"]): r["id"] for r in rows} == want and len(rows) == len(names)
        assert len({r["replacement"] for r in rows}) == len(rows)


def test_a_type_without_a_free_fake_gets_fakes_that_hold_observed_values(spark):
    """All first names but one and all surnames but one are originals: 26 fakes hold none of them, for 798 persons."""
    from pseudoveil.operators.free_ids import PARTS
    first, _, last = PARTS["PERSON"][0]
    observed = [x.lower() for x in [*first[1:], *last[1:]]]
    keys = spark.createDataFrame([("PERSON", v, v) for v in observed], "pii_type string, norm_key string, surface string")
    rows = assign_surrogates(keys, empty_mapping(spark), 16).collect()
    fakes = {r["replacement"].lower() for r in rows}
    assert len(rows) == len(fakes) == 798 and {r["norm_key"] for r in rows} == set(observed)
    assert not any(f in o for f in fakes for o in observed)


def test_candidates_count_and_list_the_ids_of_clean_parts(spark):
    from pseudoveil.operators.free_ids import PARTS, Candidates, part_strings
    from pseudoveil.operators.surrogates import surrogate_of
    for t in PARTS:
        unclean = set(sorted(part_strings(t))[::3]) if len(part_strings(t)) > 2 else set()
        c = Candidates(t, unclean)
        ids = [k + j for k in (0, 4 * 10 ** 6, 10 ** 9) for j in range(500)]
        fakes = spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.lower(surrogate_of(t, F.col("id"))).alias("f")).collect()
        assert all(any(p in f for p in unclean) for i, f in fakes if c.below(i) == c.below(i + 1))
        assert all(c.id_of(c.below(i)) == i for i in ids if c.below(i) < c.below(i + 1))
        lo = c.below(4 * 10 ** 6)
        listed = [r[0] for a, b, i in c.ids(lo, lo + 300) for r in spark.range(a, b).select(i.alias("i")).orderBy("i").collect()]
        assert listed == [c.id_of(n) for n in range(lo, min(lo + 300, c.count))] and listed


def test_a_loaded_json_mapping_is_parsed_once(spark, tmp_path):
    m = spark.createDataFrame([("PERSON", "a b", "A B", "Rahul A. Kulkarni", None)], "pii_type string, norm_key string, surface string, replacement string, id long")
    save_mapping(m, str(tmp_path / "m.json"), "json")
    loaded = load_mapping(spark, str(tmp_path / "m.json"))
    plan = loaded._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and [r["id"] for r in loaded.collect()] == [0]


def test_queue_places_are_those_of_a_queue():
    import numpy as np

    from pseudoveil.operators.mapping import queue_places
    free = np.array([i for i in range(100, 4000) if i * 7919 % 11 == 3 and not 300 < i < 900])
    queue, want, at = list(range(150)), {}, 97
    while queue:
        key = queue.pop(0)
        if at in free:
            want[key] = at
        else:
            queue.append(key)
        at += 1
    assert list(queue_places(150, 97, free)) == [want[k] for k in range(150)]
