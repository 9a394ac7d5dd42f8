"""Transformations and their inverse."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pairlake.functions import lexer
from pairlake.operators import perturb

TEXT = "var x = 'one two three four';\nif (x) { y(x, \"zwei\") }\nx = 'one two three four' + 12;"


def row(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


@pytest.mark.parametrize("at,want", [(0, "S\na\nb\nc"), (1, "a\nS\nb\nc"), (3, "a\nb\nc\nS"), (4, "S\na\nb\nc")])
def test_inject_positions(spark, at, want):
    assert row(spark, s="S", b="a\nb\nc").select(perturb.inject(F.col("s"), F.col("b"), F.lit(at)).alias("t")).first().t == want


def test_interleave_keeps_both_orders(spark):
    r = row(spark, k=1, s="s0\ns1\ns2", b="b0\nb1\nb2\nb3").select(perturb.interleave(F.col("s"), F.col("b"), 4, "k").alias("t")).first().t.split("\n")
    assert [x for x in r if x[0] == "s"] == ["s0", "s1", "s2"] and [x for x in r if x[0] == "b"] == ["b0", "b1", "b2", "b3"]


def test_append(spark):
    assert row(spark, a="A", b="B").select(perturb.append_wrapped(F.col("a"), F.col("b")).alias("t")).first().t == "A\n(function () {\nB\n})();\n"


def test_rename_is_consistent_and_honours_reserved(spark):
    t = row(spark, k=1, t=TEXT).select(perturb.rename(F.col("t"), 1, "k", reserved=["^var$", "^if$"]).alias("t")).first().t
    assert t.startswith("var _0x") and "\nif (" in t and "'one two three four'" in t
    names = perturb.rename_map(row(spark, k=1, t=TEXT), "k", "t", 1, ["^var$", "^if$"]).collect()
    assert {r.name for r in names} == {"x", "y"} and len({r.new for r in names}) == 2
    new = {r.name: r.new for r in names}
    assert t.count(new["x"]) == 4 and t.count(new["y"]) == 1


def test_rename_keys_keeps_values(spark):
    t = row(spark, k=1, t='{"a": 1, "b": {"a": "a:\\"b\\"", "c": [null, {"a": 2.50}]}}').select(perturb.rename_keys(F.col("t"), 1, "k").alias("t")).first().t
    import json
    out = json.loads(t)
    ka, kb = list(out)
    assert ka.startswith("_0x") and out[ka] == 1 and out[kb][ka] == 'a:"b"' and out[kb][list(out[kb])[1]] == [None, {ka: 2.5}]


def test_string_array_round_trip(spark):
    w = perturb.string_dictionary(F.col("t"), 1.0, 1, "k", rotate=True, shuffle=True)
    df = row(spark, k=1, t=TEXT).select("t", w.alias("w")).select("t", "w", perturb.reference_literals(F.col("t"), F.col("w"), 3).alias("c"))
    r = df.select("*", perturb.inline_literals(F.col("c"), F.col("w"), 3).alias("b"), perturb.encode_dictionary(F.col("w"), "base64").alias("e")).first()
    assert sorted(r.w) == ["\"zwei\"", "'one two three four'"] and r.c.count("_s(0x") == 3 and r.b == TEXT and len(r.e) == 2
    with pytest.raises(ValueError):
        perturb.encode_dictionary(F.col("w"), "rc4")


def test_split_and_fold(spark):
    r = row(spark, t=TEXT).select(perturb.split_literals(F.col("t"), 9).alias("s")).select("s", perturb.fold_literals(F.col("s")).alias("f")).first()
    assert "'one two t'+'hree four'" in r.s and r.f == TEXT
    r = row(spark, t=TEXT).select(perturb.split_literals(F.col("t"), 9, [".*"]).alias("s")).first()
    assert r.s == TEXT


def test_permutation_round_trip(spark):
    df = row(spark, k=1, t="\n".join(map(str, range(30)))).select("t", perturb.permute_lines(F.col("t"), 1.0, 1, "k").alias("p"))
    r = df.select("t", "p", perturb.unpermute(F.col("p.text"), F.col("p.line_order")).alias("b")).first()
    assert r.p.text != r.t and r.b == r.t and sorted(r.p.line_order.split(","), key=int) == [str(i) for i in range(30)]


def test_numbers(spark):
    r = row(spark, k=1, t="a 12 b 0 1.5 123456789012345678").select(perturb.number_expressions(F.col("t"), 1, "k").alias("t")).first().t
    parts = r.split(" ")
    assert eval(parts[1]) == 12 and eval(parts[3]) == 0 and "+" in parts[1] and parts[4] == "1.5" and eval(parts[5]) == 123456789012345678 and "+" in parts[5]


def test_dead_lines_come_from_other_documents(spark):
    df = spark.createDataFrame([(i, "\n".join(f"d{i}l{j}" for j in range(20))) for i in range(6)], "k long, t string")
    rows = perturb.inject_dead(df, "k", "t", 0.4, 1).collect()
    assert len(rows) == 6
    for r in rows:
        lines, own = r.t.split("\n"), f"d{r.k}l"
        assert [x for x in lines if x.startswith(own)] == [f"d{r.k}l{j}" for j in range(20)]
        places = [int(x) for x in r.dead_after.split(",") if x]
        assert len(lines) == 20 + len(places)
        for n, p in enumerate(places):
            assert not lines[p + n + 1].startswith(own)


def test_restore_statuses(spark):
    df = spark.createDataFrame([(1, "a 'bcdefghijklm'", "a 'bcdefghijklm'"), (2, "a 'bcdefghi'+'jklm'", "a 'bcdefghijklm'"), (3, "x", "y")], "k long, c string, o string")
    back = perturb.restore(df.withColumn("d", F.md5("o")), "k", "c", "d").collect()
    assert {r.k: (r.c, r.status) for r in back} == {1: ("a 'bcdefghijklm'", "strict"), 2: ("a 'bcdefghijklm'", "loose"), 3: ("x", "failed")}


def test_restore_inverts_everything(spark):
    df = spark.createDataFrame([(1, TEXT), (2, ""), (3, "é = 'ü' ;\n\n 7"), (4, "5abc 1.5x don't can't 7é_")], "k long, t string")
    coded = df.withColumn("c", perturb.rename(F.col("t"), 1, "k"))
    coded = coded.withColumn("w", perturb.string_dictionary(F.col("c"), 0.5, 1, "k"))
    coded = coded.withColumn("c", perturb.split_literals(perturb.reference_literals(F.col("c"), F.col("w")), 5))
    coded = coded.withColumn("p", perturb.permute_lines(F.col("c"), 1.0, 1, "k")).select("k", "w", F.md5("t").alias("d"), F.col("p.text").alias("c"), F.col("p.line_order").alias("o"))
    back = perturb.restore(coded, "k", "c", "d", "w", "o", perturb.rename_map(df, "k", "t", 1))
    assert {r.k: r.c for r in back.collect()} == {r.k: r.t for r in df.collect()}
    assert back.where("status = 'failed'").count() == 0


def test_profiles_and_partial(spark):
    df = spark.createDataFrame([("p", "v = 'abcdefghijkl'", "b0\nb1")], "pair_id string, alt_text string, base_text string")
    cells = {(r.exp, r.mix): r.target_text for r in perturb.apply_profiles(df, 1).collect()}
    assert len(cells) == 12
    assert cells[("Exp_val", "M1")] == "v = 'abcdefghi'+'jkl'" and cells[("Exp_var", "M1")].startswith("_0x")
    assert "b0" in cells[("Exp_val", "M2")] and "b0" not in cells[("Exp_var", "M2")]
    part = {(r.exp, r.mix): r.target_text for r in perturb.apply_profiles(df, 1, partial=True).collect()}
    assert part[("Exp_var", "M1")] == cells[("Exp_var", "M1")] and "b0" in part[("Exp_var", "M2")]


def test_modes_by_name(spark):
    df = spark.createDataFrame([("p", "v = 'abcdefghijkl'  + 5;\n// note\nw", "b0\nb1\nb2")], "pair_id string, alt_text string, base_text string")
    names = ["hi", "low", "minify", "w_string", "EXP_val_m1", "p_control", "B"]
    out = {r["mode"]: r.target_text for r in perturb.apply_modes(df, 1, names).collect()}
    assert set(out) == set(names)
    assert "// note" not in out["minify"] and "v = 'abcdefghijkl' + 5;" in out["minify"] and "b1" in out["minify"]
    assert out["w_string"] == out["EXP_val_m1"] and "'abcdefghi'+'jkl'" in out["w_string"] and "b0" not in out["w_string"]
    assert [x for x in out["p_control"].split("\n") if x[0] == "b"] == ["b0", "b1", "b2"]
    assert "_s(0x0)" in out["B"] and "_0x" in out["hi"] and "(" in out["hi"] and " 5" not in out["hi"]


def test_names_and_keys_are_those_of_the_full_grammar(spark):
    rows = [(k, text) for k, text in enumerate((
        "ab12.5e3 'x y' : \"k\":1, 7z \"open x 'q r' b\n:c", "\u00b2x \u0663y é:1 中文\t: \"\" :a::b $ :", "x\u0085:y\u00a0:z '' \"a\nb\"", ""))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = lambda t: F.when(lexer.is_name(t), perturb.new_name(42, t, "doc_id")).otherwise(t)
    plain = F.array_join(F.transform(lexer.raw_tokens(F.col("text"), blanks=True), one), "")
    got = df.select(plain.alias("want"), perturb.rename(F.col("text"), 42, "doc_id").alias("got"), F.size(lexer.name_parts(F.col("text"))).alias("n"),
                    F.size(lexer.raw_tokens(F.col("text"), blanks=True)).alias("m")).collect()
    assert all(r.want == r.got for r in got) and sum(r.n for r in got) < sum(r.m for r in got)
    keys = [r[0] for r in df.select(perturb.rename_text_keys(F.col("text"), 42, "doc_id")).collect()]
    new = lambda k, name: "_0x" + hashlib.md5(f"42|{k}|{name}".encode()).hexdigest()[:16]
    assert keys[0] == f"ab12.5e3 {new(0, 'x y').join(chr(39) * 2)} : {new(0, 'k').join(chr(34) * 2)}:1, 7z \"open x 'q r' {new(0, 'b')}\n:c"
    assert keys[1] == f"\u00b2x \u0663y {new(1, 'é')}:1 {new(1, '中文')}\t: \"\" :{new(1, 'a')}::b {new(1, '$')} :"
    assert keys[2].startswith("x\u0085:y\u00a0:z") and keys[3] == ""


def test_names_of_a_document_are_gathered_without_a_shuffle(spark):
    df = spark.createDataFrame([(k, TEXT) for k in range(9)] + [(3, "x new"), (None, "x")], "doc_id long, text string")
    names = perturb.rename_map(df, "doc_id", "text", 42).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("new").alias("d"))
    plan = names._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert {r.doc_id: (r.n, r.d) for r in names.collect()} == {**{k: (4, 4) for k in range(9)}, 3: (6, 5), None: (1, 1)}
