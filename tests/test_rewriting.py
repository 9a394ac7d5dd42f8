"""Steps in Arrow batches against the same steps as columns, row by row."""

import random

import pytest
from pyspark.sql import functions as F

from pairlake.operators import grid, perturb

# what the rules part texts by, with characters that only the JVM may judge (Arabic and Deseret letters, Arabic and Roman numbers) and odd blanks
PIECES = [
    "a", "b1", "x_y", "$", "é", "中文", "اب", "\U00010400", "٣", "Ⅷ", "7", "0042", "1.50", "_s(0x0)", "_s_(0x1", "'", '"', "'lit one'", '"lit two"', "''",
    "'abcdefghijklmnop'", '"tab\there"', "+", "+ ", " +", " ", "  ", "\t", "\n", "\n\n", "\r", "\r\n", "\x85", " ", " ", "\x0b", "\x1f", "\\", ":", " :", "\n:", "/", "//", "/*", "*/", "://", "=", "===", "!=", ">>>", "--", "\U0001f600", ";",
]


def texts(seed, n):
    draw = random.Random(seed)
    odd = ["", " ", "\n", "+", "+\n", "+ \r\n", "'", "\"a\n\"", " a \r", " a \r\n", " ", "x\n \n y", "'+'+'b'", "/* a */ b // c\nd", "name\n: 'k' : \"kk\"\n:", "\x01\x1b\"\x1f\""]
    return odd + ["".join(draw.choices(PIECES, k=draw.randint(1, 60))) for _ in range(n)]


def made(df):
    names = [c for c in df.columns if c in ("exp", "mix", "mode", "pair_id", "target_text")]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("kind", ("grid", "late", "modes"))
def test_batches_make_the_cells_of_the_columns(spark, kind):
    alts, bases = texts(kind, 60), texts(kind + "b", 60)
    rows = [(f"p{i}", a, b) for i, (a, b) in enumerate(zip(alts, bases[5:] + bases[:5]))] + [("n0", None, "a\nb"), ("n1", "a\nb 'c'", None), ("n2", None, None), (None, "x 1\n'y'", "z")]
    df = spark.createDataFrame(rows, "pair_id string, alt_text string, base_text string").repartition(3)
    run = {"grid": lambda out: perturb.apply_profiles(df, 7, outputs=out), "late": lambda out: perturb.apply_profiles(df, 7, partial=True, outputs=out),
           "modes": lambda out: perturb.apply_modes(df, 7, [r["name"] for r in grid.profile_rows()], out)}[kind]
    batches, columns = run(perturb.WHOLE), run({"target_text": lambda text: text})
    assert "MapInArrow" in batches._jdf.queryExecution().toString() and "MapInArrow" not in columns._jdf.queryExecution().toString()
    got, want = made(batches), made(columns)
    assert len(got) == len(rows) * (12 if kind != "modes" else 21)
    assert got == want


def test_reserved_patterns_and_all_switches(spark):
    rows = [(f"p{i}", a, b) for i, (a, b) in enumerate(zip(texts(5, 40), texts(6, 40)))]
    df = spark.createDataFrame(rows, "pair_id string, alt_text string, base_text string")
    every = {**grid.DEFAULT_FLAGS, **{f: "true" for f, v in grid.DEFAULT_FLAGS.items() if v == "false"}, "string_array_threshold": "0.6", "split_length": "3", "dead_threshold": "0.5"}
    cells = [({"mode": f"{r}{e}{m}{a}"}, {**every, "reserved_strings": r, "encoding": e}, False, m, a)
             for r in ("", ".*") for e in ("none", "base64") for m in (True, False) for a in (True, False)]
    got = made(perturb.run_cells(df, 3, cells))
    assert got == made(perturb.run_cells(df, 3, cells, {"target_text": lambda text: text})) and len(got) == 16 * len(rows)
    # a pattern is the JVM's
    some = perturb.run_cells(df, 3, [({"mode": "x"}, {**every, "reserved_strings": "lit"}, False, True, False)])
    assert "MapInArrow" not in some._jdf.queryExecution().toString() and some.count() == len(rows)


def test_columns_kept_beside_the_cells_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(perturb, "HANDED_ON", 50)
    rows = [(f"p{i}", i, [i], {"k": i}, "a b\nc", "d") for i in range(9)]
    df = spark.createDataFrame(rows, "pair_id string, n int, many array<int>, s struct<k: int>, alt_text string, base_text string").coalesce(1)
    out = perturb.apply_profiles(df, 1, outputs={"digest": perturb.DIGEST, "chars": perturb.CHARS}, keep=["n", "many", "s"])
    assert out.columns == ["n", "many", "s", "exp", "mix", "digest", "chars"]
    found = out.collect()
    assert sorted((r.n, r.many, r.s.k) for r in found) == sorted((i, [i], i) for i in range(9) for _ in range(12))
    texts_ = perturb.apply_profiles(df, 1, outputs={"digest": F.md5, "chars": lambda t: F.length(t).cast("bigint")}, keep=["n", "many", "s"])
    assert sorted(map(tuple, found)) == sorted(map(tuple, texts_.collect()))
