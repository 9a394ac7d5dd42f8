"""Lexing and text functions."""

import pytest
from pyspark.sql import functions as F

from pairlake.functions import lexer, text


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("given,want", [
    ("a b", "a%20b"), ("é", "%E9"), ("€", "%u20AC"), ("a@*_+-./Z9", "a@*_+-./Z9"), ("\n", "%0A"), ("😀", "%uD83D%uDE00"), ("", ""),
])
def test_escape(spark, given, want):
    assert one(spark, lexer.js_escape, given) == want


@pytest.mark.parametrize("given,want", [
    ("abc", "abc"), ("---", "___"), ("...", "___"), ("pos_1_Obfuscator.HIGH_obf_hi", "pos_1_Obfuscator_HIGH_obf_hi"),
])
def test_flatten_key(spark, given, want):
    assert one(spark, text.flatten_key, given) == want


@pytest.mark.parametrize("given,want", [("\\$$", ""), (" (1, 'é b') ", "1_é_b"), ("a-b.c_d", "a-b.c_d")])
def test_sanitise_key(spark, given, want):
    assert one(spark, text.sanitise_key, given) == want


def test_token_classes_and_values(spark):
    source = "var aé_1 = 'x y' + 3.14 >= b++ !== ~c; \"open"
    classes = one(spark, lambda c: lexer.tokens(c, "class"), source)
    assert classes == ["name", "name", "=", "string", "+/-", "num", "</>/<=/>=", "name", "++/--", "==/!=/===/!==", "!/~", "name", ";", '"', "name"]
    values = one(spark, lambda c: lexer.tokens(c, "value"), source)
    assert values == ["var", "aé_1", "=", "x%20y", "+", "num", ">=", "b", "++", "!==", "~", "c", ";", '"', "open"]
    assert one(spark, lexer.class_string, source) == 'nn=sadcniebn;"n'
    with pytest.raises(ValueError):
        lexer.tokens(F.lit(""), "other")


def test_tokens_with_blanks_give_the_text_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same = docs.select((F.array_join(lexer.raw_tokens(F.col("text"), True), "") == F.col("text")).alias("s"))
    assert same.where("not s").count() == 0


def test_lexing_by_line_is_lexing_the_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    both = docs.select(F.replace(lexer.class_lines(F.col("text")), F.lit("\n"), F.lit("")).alias("a"), lexer.class_string(F.col("text")).alias("b"))
    assert both.where("a <> b").count() == 0


def test_lex_table(spark):
    df = spark.createDataFrame([(1, "a 'b'")], "k long, text string")
    assert [tuple(r) for r in lexer.lex(df, ["k"], mode="value").orderBy("pos").collect()] == [(1, 0, "name", "a"), (1, 1, "string", "b")]


def test_line_count(spark):
    assert one(spark, text.line_count, "a\r\nb\rc\nd\u2028e\u2029f") == 6
    assert one(spark, text.line_count, "") == 1


def test_compact_and_canonical(spark):
    assert one(spark, text.compact, "a /* x\ny */  b // tail\n\n  c  http://h \n") == "a b\nc http://h"
    assert one(spark, text.canonical_lines, "  a \n\n\tb\r\n ") == "a\nb"


def test_names(spark):
    df = spark.createDataFrame([(12, 7, 1)], "s long, b long, l int")
    r = df.select(text.target_name(F.col("s"), F.col("b"), F.col("l")).alias("n")).select("n", text.parse_target(F.col("n")).alias("p")).first()
    assert r.n == "12.7.1.js" and tuple(r.p) == ("12", "7", "1")


def test_record_json(spark):
    df = spark.createDataFrame([(2**60, "x", [1, 2])], "big long, s string, a array<int>")
    out = text.to_record_json(df, big=("big",))
    assert out.first().record == '{"big":"1152921504606846976","s":"x","a":[1,2]}'
    back = text.from_record_json(text.to_record_json(df), df.schema)
    assert back.collect() == df.collect()


def test_bins_and_truncation(spark):
    df = spark.createDataFrame([(0,), (1,), (1000,), (1001,)], "n int")
    assert [r.b for r in df.select(text.length_bin(F.col("n"), 1000).alias("b")).collect()] == [0, 1, 1, 2]
    assert one(spark, lambda c: text.truncate(c, 3), "abcdef") == "abc"
