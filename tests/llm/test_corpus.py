"""Alignment of two tokenizers, near-duplicates and the divergence of sources, against brute force and on odd rows."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from pairlake.llm import alignment, divergence, neardup, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, aligned string, n_shingles string, Component_ID string, kept string, _digest string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, names that clash."""
    long = "A word " + " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (None, "one two", "en", None), (None, None, None, "a"), (None, "one two", "en", "b"),
        (3, long, "en", "a"), (4, "same text here, five words more", "de", "b"), (5, "Same TEXT here, five words more", "de", "b"),
        (5, "Same TEXT here, five words more", "de", "b"), (6, " \n\t ", "en", "c"), (7, "x", "en", "a"), (8, "x y", "en", "a"), (9, "x y z", "en", "a"),
        (10, "mail 🎉 a.b@c.de ÀÉ now\x01 <s> <|endoftext|> <0x41> end\r\n  two", "en", "b"), (11, "a▁sign", "en", "b"), (12, "É é", "", ""),
    ]
    return spark.createDataFrame([(*r, *"vwxyz") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# Alignment


@pytest.fixture(scope="module")
def sides():
    made = []
    for kind, path in ((alignment.ByteSide, alignment.BYTE_MODEL), (alignment.PieceSide, alignment.PIECE_MODEL)):
        with open(path, "rb") as file:
            made.append(kind(file.read()))
    return made


def slow_alignment(rows, sides):
    """The contract's columns by comparing all ends, from whole texts."""
    per, links = [], Counter()
    for key, text in rows:
        whole = f" {text}".encode()
        a = sides[0].model.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = sides[1].model.encode(text) if text else []
        if b"".join(sides[0].bytes[i] for i in a) != whole or b"".join(sides[1].bytes[i] for i in b) != whole:
            a = b = []
        ends = [list(accumulate([len(s.bytes[x]) for x in ids])) for s, ids in zip(sides, (a, b))]
        at = {e: n for n, e in enumerate(ends[1])}
        own = [(a[n], b[at[e]]) for n, e in enumerate(ends[0]) if e in at]
        links.update(own)
        parts, i0, j0 = [], 0, 0
        for n, e in enumerate(ends[0]):
            if e in at:
                parts.append(",".join(map(str, a[i0 : n + 1])) + "|" + ",".join(map(str, b[j0 : at[e] + 1])))
                i0, j0 = n + 1, at[e] + 1
        per.append((key, len(a), len(b), len(parts), own, hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""))
    most = {}
    for (_, y), n in links.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(
        (key, a, b, g, len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own), sha) for key, a, b, g, own, sha in per)


def test_alignment_against_brute_force(spark, docs, sides, odd, tmp_path):
    both = docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").select("doc_id", "text"))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op11_token_alignment(spark, str(tmp_path))
    want = slow_alignment([(r["doc_id"], r["text"]) for r in both.collect()], sides)
    assert sorted(map(tuple, found.collect())) == want


def test_aligned_groups_cover_the_texts(odd, sides):
    rows = alignment.align(odd).collect()
    name = [c for c in rows[0].asDict() if c.endswith("aligned")][-1]
    assert name == "_aligned" and len(rows) == odd.count()
    for row in rows:
        found = row[name]
        assert len(found["a_sizes"]) == len(found["b_sizes"]) == found["n_groups"]
        assert sum(found["a_sizes"]) == found["n_a"] == len(found["a_ids"]) and sum(found["b_sizes"]) == found["n_b"] == len(found["b_ids"])
        assert sum(x["n"] for x in found["links"]) == found["n_links"]
        if not row["text"] or "▁" in row["text"]:
            assert found["n_a"] == found["n_b"] == 0 and found["groups_sha256"] == ""
            continue
        assert b"".join(sides[0].bytes[i] for i in found["a_ids"]).decode() == " " + row["text"]
        i = j = 0
        for n, m in zip(found["a_sizes"], found["b_sizes"]):
            assert b"".join(sides[0].bytes[x] for x in found["a_ids"][i : i + n]) == b"".join(sides[1].bytes[x] for x in found["b_ids"][j : j + m])
            i, j = i + n, j + m
    assert alignment.align(odd.limit(0)).count() == 0
    assert alignment.pair_counts(F.col("_aligned.links"), alignment.align(odd.limit(0))).count() == 0
    none = alignment.align(odd.limit(0))
    held = alignment.strength(F.col("_aligned.links"), alignment.pair_counts(F.col("_aligned.links"), none))
    assert alignment.align(odd).select(held.alias("h")).where("h.n_best > 0 or h.count_sum > 0").count() == 0


def test_groups_with_tokens_without_bytes():
    assert alignment.groups([], []) == []
    assert alignment.groups([2, 1, 3], [3, 1, 2]) == [(2, 1), (3, 3)]
    assert alignment.groups([2, 0, 1], [2, 1, 0]) == [(2, 1), (3, 3)]

    sides = alignment.Side([b" x", b"", b"y"]), alignment.Side([b" x", b"y", b""])
    cuts = alignment.groups([2, 0, 1], [2, 1, 0])
    links, stops = alignment.linked([0, 1, 2], [0, 1, 2], [2, 0, 1], [2, 1, 0], cuts)
    assert [(k >> 32, k & 0xFFFFFFFF) for k in links.tolist()] == [(0, 0), (1, 0), (2, 1), (2, 2)] and stops.tolist() == [2, 4]
    links, stops = alignment.linked([5, 6], [7], [2, 1], [3], alignment.groups([2, 1], [3]))
    assert links.tolist() == [6 << 32 | 7] and stops.tolist() == [1]
    assert alignment.written([0, 1, 2], [0, 1, 2], cuts, sides) == ["0,1|0", "2|1,2"]


def test_parts_of_texts_are_encoded_as_the_whole(docs, odd, sides):
    odd_blanks = ["  two  blanks \n and\t tabs  ", " ", "   ", "a ", " a", "a\u00a0 b \u3000c", "x\n y", "'s 's  's", "12 34  5 ￿ 😀 é"]
    for text in [r["text"] for r in docs.collect()] + [r["text"] or "" for r in odd.collect()] + odd_blanks:
        if text and "▁" not in text:
            found = alignment.parts(f" {text}")
            assert " " + " ".join(found) == f" {text}"
            known = alignment.Parts(tuple(sides), 50, True)
            known.learn([found])
            a, b = ([x for p in found for x in known[p][6][k]] for k in (0, 1))
            assert a == sides[0].model.encode(f" {text}", add_special_tokens=False).ids and b == sides[1].model.encode(text)


def test_few_remembered_parts_give_the_same(docs):
    wanted = ("n_a", "n_links", "groups_sha256")
    rows = [sorted(map(str, alignment.align(docs, wanted=wanted, remembered=n).collect())) for n in (150_000, 10)]
    assert rows[0] == rows[1]


def test_linked_pairs_are_bounded_by_the_vocabularies(docs, sides):
    assert alignment.most_pairs([b"ab", b"b"], [b"b", b"ab", b"xab"]) == 4 + 2  # ab-b, ab-ab, b-b, b-ab, b-xab, ab-xab
    rows = alignment.align(docs, wanted=("links",))
    pairs = {(r["a"], r["b"]) for r in alignment.pair_counts(F.col("aligned.links"), rows).collect()}
    for x, y in pairs:
        p, q = sides[0].bytes[x], sides[1].bytes[y]
        assert p.endswith(q) or q.endswith(p)
    assert len(pairs) <= alignment.most_pairs(*(s.bytes for s in sides))


# Near-duplicates


def shingles(text, words=3):
    found = neardup.words_of((text or "").encode())
    return {tuple(found[k : k + words]) for k in range(max(len(found) - words + 1, 1))} if found else set()


def slow_components(rows, percent=85):
    """component_id of each row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if both := len(sets[i] & sets[j]):
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
                    links += 1
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[find(k)] = min(least.get(find(k), key), key)
    return [(key, len(sets[k]), least.get(find(k)), key == least.get(find(k))) for k, (key, _) in enumerate(rows)], links


def family(size, seed, words=120, changed=4):
    """Near copies of one text, some further apart than the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for at in rng.sample(range(words), rng.randrange(changed + 1)):
            own[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", (512, 7))
def test_near_duplicates_against_brute_force(spark, docs, odd, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10_000 + k, t) for k, t in enumerate(family(60, 1) + family(60, 2, 30, 2) + family(40, 3, 9, 1))]
    rows += [(20_000 + k, r["text"]) for k, r in enumerate(odd.collect())]
    random.Random(5).shuffle(rows)
    found = neardup.assign(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(found.select(F.col("doc"), "n_shingles", "component_id", "kept").toPandas().itertuples(index=False, name=None))
    want, links = slow_components(rows)
    assert links > 1000 and got == sorted(want)


def test_members_that_stars_leave_apart_are_compared(spark):
    """A hub that nothing is linked with, and links of its bucket's other members only."""
    texts = family(40, 7, 100, 9)
    rows = list(enumerate(texts))
    want, _ = slow_components(rows)
    found = neardup.assign(spark.createDataFrame(rows, "doc_id long, text string"), bands=6, rows=1)  # all share buckets
    assert sorted((r["doc"], r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()) == sorted(want)
    assert len({w[2] for w in want}) > 3


def test_signatures_agree_as_often_as_sets_do():
    ranks = neardup.orders(144, 1)
    for size in (5, 40, 2000):
        rng = random.Random(size)
        agree = []
        for _ in range(60):
            both = [rng.getrandbits(64) for _ in range(size)]
            one, two = both + [rng.getrandbits(64) for _ in range(size // 5)], both + [rng.getrandbits(64) for _ in range(size // 5)]
            signs = [neardup.signature(neardup.np.unique(neardup.np.array(s, neardup.np.uint64)), ranks) for s in (one, two)]
            agree.append((signs[0] == signs[1]).mean())
        assert abs(sum(agree) / len(agree) - size / (size + 2 * (size // 5))) < 0.06


def test_exact_sets_of_any_size():
    texts = [b"a b c a b c d", b"", b"a", b"a b", b"A B c", "é\x0bb c".encode()]
    for words in (1, 3, 5, 12):
        sets = neardup.exact_sets(texts, words)
        for x, t in zip(sets, texts):
            assert len(x) == len(shingles(t.decode(), words))
            for y, u in zip(sets, texts):
                pad = lambda s: {tuple(w) + (None,) * (words - len(w)) for w in s}
                assert len(set(x.tolist()) & set(y.tolist())) == len(pad(shingles(t.decode(), words)) & pad(shingles(u.decode(), words)))


def test_odd_rows_of_near_duplicates(odd):
    out = neardup.mark(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert len(rows) == odd.count()
    named = [(r["doc_id"], r["text"], *r[-3:]) for r in rows]
    assert [x[2:] for x in named if x[1] is None or not x[1].strip()] == [(0, x[0], True) for x in named if x[1] is None or not x[1].strip()]
    assert {x[3] for x in named if x[0] in (4, 5)} == {4} and [x[4] for x in named if x[0] == 5] == [False, False]
    assert all(x[2:] == (1, None, True) for x in named if x[0] is None and x[1])
    assert neardup.mark(odd.limit(0)).count() == 0 and neardup.assign(odd.where("text is null")).count() == 2


# Divergence of sources


def slow_audit(rows, least, top):
    groups, docs, often = {}, {}, {}
    for text, lang, source in rows:
        found = Counter("".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "").split(" "))
        del found[""]
        groups.setdefault((lang or "", source or ""), Counter()).update(found)
        often.setdefault(lang or "", Counter()).update(found)
        docs.setdefault(lang or "", Counter()).update(found.keys())
    out = []
    kept = {lang: [t for t, n in d.items() if n >= least] for lang, d in docs.items()}

    def share(lang, c):
        whole = sum(c[t] for t in kept[lang]) + 5 * len(kept[lang])
        return {t: 1 + 10**9 * (c[t] + 5) // whole for t in kept[lang]}

    shares, all_of = {g: share(g[0], c) for g, c in groups.items()}, {lang: share(lang, c) for lang, c in often.items()}
    for (lang, source), p in shares.items():
        pairs = [(-sum(abs(p[t] - o[t]) for t in p), s.encode()) for (g, s), o in shares.items() if g == lang and s != source]
        terms = [(all_of[lang][t] - p[t], t.encode()) for t in p if groups[lang, source][t] and p[t] > all_of[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, item.decode(), -value, n + 1) for n, (value, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize("sizes", ({}, {"bucket_terms": 400, "block_sources": 8, "step": 30}))
def test_audit_against_brute_force(docs, odd, sizes):
    both = docs.select("text", "lang", "source").unionByName(odd.select("text", "lang", "source"))
    rows = list(map(tuple, both.collect()))
    found = sorted(map(tuple, divergence.audit(both, least_docs=3, top=9, **sizes).collect()))
    assert found == slow_audit(rows, 3, 9)
    assert any(r[0] == "" for r in found)


def test_bounded_tables_give_the_same_counts(docs):
    shown = lambda h: sorted((r["lang"], r["term"], r["n"], sorted(map(tuple, r["by"]))) for r in divergence.vocabulary(docs, least_docs=2, held=h).collect())
    assert shown(10**6) == shown(50)


def test_audit_of_odd_tables(spark, odd):
    assert divergence.audit(odd.limit(0)).count() == 0
    rows = divergence.audit(odd.where("text is null or trim(text) = ''")).collect()
    assert all(r["part"] == "pair" and r["value"] == 0 for r in rows)
    same = divergence.audit(odd.withColumn("p", F.lit(1)).withColumn("block", F.lit(1)), least_docs=1)
    assert sorted(map(tuple, same.collect())) == slow_audit([(r["text"], r["lang"], r["source"]) for r in odd.collect()], 1, 50)


def test_shares_are_exact_beyond_64_bits(spark):
    n = 9 * 10**18
    row = spark.range(1).select(divergence.share(F.lit(n - 7), F.lit(n), F.lit(10**6)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n - 2) // (n + 5 * 10**6)
