"""Metrics, losses, vocabulary, sequences, search, models."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlake.functions import vectors
from pairlake.operators import embedding, metrics, models, search, sequences, vocab


def scores(spark, n=300):
    rng = np.random.default_rng(3)
    return [(int(i % 2), float(s), int(l)) for i, (s, l) in enumerate(zip(np.round(rng.random(n), 1), rng.integers(0, 2, n)))]


def brute_auc(rows):
    pos, neg = [s for s, l in rows if l], [s for s, l in rows if not l]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)


def test_auc_with_ties(spark):
    rows = scores(spark)
    df = spark.createDataFrame(rows, "g int, s double, l int")
    got = {r.g: r.auc for r in metrics.roc_auc(df, "s", "l", ["g"]).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(brute_auc([(s, l) for x, s, l in rows if x == g]))
    assert metrics.roc_auc(df, "s", "l").first().auc == pytest.approx(brute_auc([(s, l) for _, s, l in rows]))
    assert metrics.roc_auc(df.where("l = 1"), "s", "l").first().auc is None


def test_confusion_metrics(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(0, 1)] * 2 + [(1, 0)] + [(0, 0)] * 4, "l int, p int")
    r = metrics.classification_metrics(metrics.confusion(df, "l", "p")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.accuracy) == (3, 2, 1, 4, 70.0)
    p, q = 3 / (5 + 1e-5), 3 / (4 + 1e-5)
    assert (r.precision, r.recall, r.f1) == (pytest.approx(p), pytest.approx(q), pytest.approx(2 * p * q / (p + q + 1e-5)))


def test_threshold_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.6, 0), (0.1, 0)], "s double, l int")
    r = metrics.threshold_metrics(df, "s", "l").first()
    assert (r.accuracy, r.precision, r.recall, r.auc) == (0.5, 0.5, 0.5, 0.75)
    assert r.loss == pytest.approx(-np.mean(np.log([0.9, 0.5, 0.4, 0.9])))


def test_likelihood_loss(spark):
    probs = [0.1, 0.2, 0.3, 0.4, 0.5]
    df = spark.createDataFrame([(1.0, 1, [p] * 3) for p in probs], "s double, l int, p array<double>")
    loss = lambda d: d.agg(metrics.likelihood_loss(F.col("s"), F.col("l"), F.col("p")).alias("x")).first().x
    rows = [-3 * math.log(p + 1e-10) for p in probs]
    assert loss(df) == pytest.approx(np.mean(rows))
    flipped = df.withColumn("l", F.when(F.get("p", F.lit(0)) == 0.1, 0).otherwise(1))
    assert loss(flipped) == pytest.approx(np.mean([-rows[0], *rows[1:]]))
    both = df.agg(metrics.weighted_loss(F.col("s"), F.col("l"), F.col("p"), F.lit(2.0)).alias("x")).first().x
    assert both == pytest.approx(0.8 * np.mean(rows) + 0.4 * 4, abs=1e-6)


def test_cross_entropy_extremes(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    r = df.agg(metrics.bce(F.col("a"), F.lit(1)).alias("x"), metrics.bce(F.col("b"), F.lit(1)).alias("y")).first()
    assert r.x < 1e-5 and r.y > 10


def test_vocab_and_encode(spark):
    df = spark.createDataFrame([(1, "b a a", "A"), (2, "c  b", ""), (3, "", "")], "k long, x string, y string")
    v = vocab.fit_vocab(df, ["x", "y"], max_tokens=5)
    assert [(r.token, r.id, r.freq) for r in v.orderBy("id").collect()] == [("a", 2, 2), ("b", 3, 2), ("A", 4, 1)]
    weighted = vocab.fit_vocab(df.withColumn("w", F.col("k") * 10), ["x"], weight="w").orderBy("id").first()
    assert (weighted.token, weighted.freq) == ("b", 30)
    e = {r.k: (r.ids, r.length) for r in vocab.encode(df, "k", "x", v, 2).collect()}
    assert e == {1: ([3, 2], 2), 2: ([1, 3], 2), 3: ([0, 0], 0)}
    long = vocab.encode(df, "k", "x", v, 4).select("k", vocab.padding_mask(F.col("ids")).alias("m")).collect()
    assert {r.k: r.m for r in long}[1] == [True, True, True, False]


def test_batch(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.array_repeat(F.lit(7), F.col("id").cast("int")).alias("ids"))
    rows = vocab.batch(df, "k", "ids", 4, 1, pad=True).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.batch_id, []).append(r)
    assert sorted(map(len, groups.values())) == [2, 4, 4]
    for g in groups.values():
        assert {len(r.ids) for r in g} == {max(r.k for r in g)}
        assert all(r.ids[: r.k] == [7] * r.k and set(r.ids[r.k :]) <= {0} for r in g)
    with pytest.raises(ValueError):
        vocab.batch(df, "k", "ids", 1, 1)


def test_embed(spark):
    toks = spark.createDataFrame([(1, "a"), (1, "b"), (1, "?"), (2, "a")], "k long, token string")
    table = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 0.0])], "token string, vec array<double>")
    assert {r.k: r.vector for r in vocab.embed(toks, "k", table, 2).collect()} == {1: [2.0, 1.0], 2: [1.0, 2.0]}


@pytest.mark.parametrize("kernel", [[1], [1, 2], [1, 2, 3], [1, 0, 2, 5], [1, 2, 3, 4, 5]])
def test_window_score(spark, kernel):
    seq = [3, 1, 4, 1, 5]
    got = spark.createDataFrame([(seq,)], "s array<int>").select(sequences.window_score(F.col("s"), kernel).alias("w")).first().w
    left = (len(kernel) - 1) // 2
    padded = [0] * left + seq + [0] * (len(kernel) - 1 - left)
    assert got == [sum(w * padded[i + j] for j, w in enumerate(kernel)) for i in range(len(seq))]


def test_segments(spark):
    df = spark.createDataFrame([(1, [1, 9, 1, 1, 9]), (2, [5])], "k long, s array<int>")
    rows = {r.k: r for r in sequences.select_segments(df, "k", "s", [[1.0], [0, 0, 1.0]], 3).collect()}
    assert rows[1].peaks == [1, 0] and rows[1].selected == [9, 1, 1, 1, 9, 1]
    assert rows[2].selected == [5] * 6 and rows[2].probs == [1.0, 1.0]


def test_early_stop(spark):
    df = spark.createDataFrame(list(enumerate([5.0, 3.0, 4.0, 3.0, 2.0, 6.0, 7.0, 8.0, 1.0])), "e int, v double")
    r = sequences.early_stop(df, "e", "v", 3).first()
    assert tuple(r) == (1, 3.0, 4) or tuple(r) == (4, 2.0, 7)
    assert tuple(r) == (4, 2.0, 7)
    assert sequences.early_stop(df, "e", "v", 30).first().stop_epoch is None


def test_gumbel_sample_follows_weights(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1000, 9).otherwise(1).alias("w"))
    rows = sequences.gumbel_sample(df, "id", "w", 300, 1).collect()
    heavy = sum(r.id < 1000 for r in rows)
    assert len(rows) == 300 and 240 < heavy < 290


@pytest.mark.parametrize("pivots,block,skip", [(1, 1000, False), (8, 16, True), (40, 7, False)])
def test_search_equals_brute_force(spark, pivots, block, skip):
    rng = np.random.default_rng(5)
    # a third of the seeds are copies of one vector
    seeds = [rng.normal(size=6) for _ in range(80)] + [np.ones(6)] * 40
    targets = [(i, v) for i, v in enumerate(seeds)][60:110]
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(seeds)], "seed_id long, vector array<double>")
    t = spark.createDataFrame([(i, v.tolist()) for i, v in targets], "target_id long, vector array<double>")
    got = {}
    for r in search.search(t, s, 4, skip_same=skip, pivots=pivots, block=block).collect():
        got.setdefault(r.target_id, []).append((r.place, r.seed_id))
    unit = lambda v: v / np.linalg.norm(v)
    for i, v in targets:
        order = sorted((-round(float(np.clip((unit(v) @ unit(w) + 1) / 2, 0, 1)), 9), j) for j, w in enumerate(seeds) if not (skip and i == j))
        assert [j for _, j in sorted(got[i])] == [j for _, j in order[:4]]


def test_search_with_few_seeds(spark):
    s = spark.createDataFrame([(1, [1.0, 0.0])], "seed_id long, vector array<double>")
    t = spark.createDataFrame([(5, [0.0, 2.0])], "target_id long, vector array<double>")
    assert [(r.seed_id, r.score) for r in search.search(t, s, 3).collect()] == [(1, 0.5)]
    assert search.search(t, s.where("seed_id > 1"), 3).count() == 0


def test_models(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    text = lambda i: "\n".join(" ".join(words[(i * 3 + j * k) % 10] + str((i * j) % 17) for j in range(1, 8)) for k in range(1, 5))
    rows = [(f"{i}.{l}", "train" if i < 40 else "test", l, text(i), text(i + 50) + "\n" + text(i if l else i + 90)) for i in range(60) for l in (0, 1)]
    df = spark.createDataFrame(rows, "pair_id string, stage string, label int, seed_text string, target_text string")
    features = models.pair_features(df).cache()
    model = models.train(features.where("stage = 'train'"), "logistic", '{"maxIter": 10}')
    held = models.score(model, features.where("stage = 'test'"))
    r = models.evaluate(held).first()
    assert r.stage == "test" and r.auc > 0.8 and r.tp + r.fp + r.fn + r.tn == 40
    models.save(model, str(tmp_path / "m"))
    again = models.score(models.load(str(tmp_path / "m")), features.where("stage = 'test'"))
    assert {x.pair_id: x.score for x in again.collect()} == {x.pair_id: x.score for x in held.collect()}
    assert models.parse_arguments("{bad") == {} == models.parse_arguments("[1]") == models.parse_arguments(None)
    assert models.train(features, "forest", '{"numTrees": 3}').stages[-1].getNumTrees == 3


def test_encoder_scores(spark):
    df = spark.createDataFrame([(1, "a b c", "a b c"), (0, "a b", "x y z"), (0, "", "q")], "label int, seed_text string, target_text string")
    rows = models.score_pairs(df).collect()
    assert rows[0].score == pytest.approx(1) and rows[1].score < 1 and rows[2].cosine == 0.0 and rows[2].pred == 1
    made = models.score_pairs(df, lambda: (lambda texts: np.array([[len(t) + 1.0, 1.0] for t in texts])))
    assert made.first().score == pytest.approx(1)
    cut = spark.createDataFrame([(1, "a" * 1024 + "b", "a" * 1024 + "c")], "label int, seed_text string, target_text string")
    assert models.score_pairs(cut, max_length=1024).first().cosine == pytest.approx(1) and models.score_pairs(cut).first().cosine < 0.999


def test_equal_texts_are_encoded_once_and_words_remembered_up_to_a_bound(spark):
    def make():
        def encode(texts):
            assert len(texts) == len(set(texts))
            return np.array([[len(t) + 1.0, 1.0] for t in texts])

        return encode

    df = spark.createDataFrame([(k, "seed", f"target {k % 3}") for k in range(12)], "k int, seed_text string, target_text string").coalesce(1)
    assert models.score_pairs(df, make).count() == 12 and models.score_pairs(df, make).agg({"score": "min"}).first()[0] > 0.5
    codes = models._Codes(256, 2)
    for word in ("a", "b", "c", "a"):
        code = hashlib.md5(word.encode()).hexdigest()
        assert codes[word] == int(code[:15], 16) % 256 + (0 if code[15] < "8" else 256) and len(codes) <= 2


def test_texts_are_encoded_by_lines_remembered_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(models, "LINES_REMEMBERED", 8 * 16)
    monkeypatch.setattr(models, "LINE", 5)
    texts = ["a b\na b\nc", "", "\n", "a long line\r\nb\x0bc\u00a0d", "c\na b\ne\tf a", "a long line"]
    want = np.zeros((len(texts), 16))
    for row, text in zip(want, texts):
        for word in re.findall("[^ \t\n\x0b\f\r]+", text):
            code = hashlib.md5(word.encode()).hexdigest()
            row[int(code[:15], 16) % 16] += 1 if code[15] < "8" else -1
    lines = models._Lines(16)
    monkeypatch.setattr(models, "_Lines", lambda dim: lines)
    encode = models.hashing_encoder(16)
    assert (encode(texts) == want).all() and (encode(texts) == want).all() and 0 < len(lines) <= 2 and all(len(x) <= 5 for x in lines)


def test_tokens_are_looked_up_in_arrow(spark):
    known = spark.createDataFrame([("a", 2), ("é", 3)], "token string, id int")
    df = spark.createDataFrame([(["a", None, "é", "zz", "a"],), (None,), ([],), (["é", "a"],)], "t array<string>")
    counts = embedding.cooccurrence(df, "t", known, 2)
    assert {(r.a, r.b): r.n for r in counts.collect()} == {(2, 3): 3, (3, 2): 3}
    assert embedding.cooccurrence(df, "t", known.limit(0), 2).count() == 0
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [ids(" in plan and "], 200" not in plan.split("ArrowEvalPython", 1)[1].split("\n")[0]  # 200: lists of Python strings


def test_factorisation_agrees_with_numpy(spark):
    rng = np.random.default_rng(2)
    n, dim, extra = 30, 3, 4
    m = np.where(rng.random((n, n)) < 0.2, rng.random((n, n)), 0.0)
    m = m + m.T
    rows = [(int(a), int(b), float(m[a, b])) for a, b in zip(*np.nonzero(m))]
    matrix = spark.createDataFrame(rows, "a int, b int, v double")
    got = {r.id: np.array(r.vec) for r in embedding.factorise(matrix, dim, extra, 8, seed=5).collect()}
    weight, turn = np.linalg.eigh(m)
    order = np.argsort(-np.abs(weight))[:dim]
    found = np.stack([got[k] for k in sorted(got)])
    used = sorted(got)
    want = turn[used][:, order] * np.sqrt(np.abs(weight[order]))
    # up to the sign of a direction
    assert np.allclose(np.abs((found * want).sum(0)), (want * want).sum(0), rtol=2e-2)
    # the same steps in numpy, exactly
    start = {r.id: r.vec for r in embedding.random_columns(spark.createDataFrame([(k,) for k in used], "id int"), dim + extra, 5).collect()}
    small = m[np.ix_(used, used)]

    def basis(y):
        w, t = np.linalg.eigh(y.T @ y)
        return y @ (t / np.sqrt(w))

    q = basis(small @ np.array([start[k] for k in used]))
    for _ in range(8):
        q = basis(small @ q)
    w, t = np.linalg.eigh(q.T @ small @ q)
    order = np.argsort(-np.abs(w), kind="stable")[:dim]
    exact = q @ t[:, order] * np.sqrt(np.abs(w[order]))
    assert np.allclose(np.abs(found), np.abs(exact), atol=1e-6)
    assert embedding.factorise(matrix.limit(0), 2, 2).count() == 0


def test_trained_table_brings_like_tokens_together(spark):
    rng = np.random.default_rng(4)
    groups = [[f"{g}{i}" for i in range(6)] for g in "xyz"]
    texts = [[str(w) for w in rng.choice(groups[k % 3], 30)] for k in range(90)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ([],), (["x0"],)], "toks array<string>")
    known = spark.createDataFrame([(w, i) for i, w in enumerate(sum(groups, []))], "token string, id int")
    vec = {r.token: np.array(r.vec) for r in embedding.train_table(df, "toks", known, 3, 3, 3).collect()}
    cos = lambda a, b: vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])
    assert len(vec) == 18 and min(cos("x0", f"x{i}") for i in range(6)) > 0.9 and max(abs(cos("x0", f"{g}{i}")) for g in "yz" for i in range(6)) < 0.2
    counts = {(r.a, r.b): r.n for r in embedding.cooccurrence(spark.createDataFrame([(["x0", "?", "x1", "x0"],)], "t array<string>"), "t", known, 2).collect()}
    assert counts == {(0, 1): 2, (1, 0): 2}
    with pytest.raises(ValueError):
        embedding.cooccurrence(df, "toks", known, 2, max_tokens=5)


def test_training_stops_and_gives_the_best_weights(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 2)) * [2.0, 0.5] + [1.0, -3.0]
    y = (x[:, 0] + rng.standard_normal(200) > 1).astype(int)
    rows = [(float(a), float(b), 5.0, int(k), "train" if i < 140 else "validation") for i, ((a, b), k) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, label int, stage string").repartition(3)
    path = str(tmp_path / "h")
    model = models.train_until(df, ["a", "b", "c"], path, F.col("stage") == "train", 15, 3, 9.0)
    full = np.column_stack([x, np.full(200, 5.0)])
    mean, scale = full[:140].mean(0), full[:140].std(0)
    z = np.column_stack([(full - mean) / np.where(scale > 0, scale, 1), np.ones(200)])
    p = lambda w: 1 / (1 + np.exp(-(z @ w)))
    loss = lambda w, s: -np.mean(y[s] * np.log(np.clip(p(w)[s], 1e-7, 1 - 1e-7)) + (1 - y[s]) * np.log(np.clip(1 - p(w)[s], 1e-7, 1 - 1e-7)))
    w, seen, train, held = np.zeros(4), [], slice(0, 140), slice(140, 200)
    for _ in range(15):
        w = w - 9.0 * ((p(w) - y)[train] @ z[train]) / 140
        seen.append((w, loss(w, train), loss(w, held)))
        best = int(np.argmin([s[2] for s in seen]))
        if len(seen) - 1 - best >= 3:
            break
    history = sorted(spark.read.json(path).collect(), key=lambda r: r.epoch)
    assert [r.epoch for r in history] == list(range(1, len(seen) + 1)) and model.epochs == len(seen) < 15
    assert np.allclose([(r.train_loss, r.validation_loss) for r in history], [s[1:] for s in seen], atol=1e-9)
    assert model.best_epoch == best + 1 and np.allclose(model.weights, seen[best][0], atol=1e-9)
    scores = [r.s for r in df.select("a", model.score().alias("s")).orderBy("a").collect()]
    assert np.allclose(scores, p(seen[best][0])[np.argsort(x[:, 0])])


def test_sparse_counts_and_cosines(spark):
    known = spark.createDataFrame([("a", 2), ("b", 3), ("c", 9)], "token string, id int")
    df = spark.createDataFrame([(["a", "b", "a", "?"], ["c", "a"]), ([], ["a"]), (None, None), (["c"], ["c", "c"])], "x array<string>, y array<string>")
    got = df.select(vocab.term_frequencies(F.col("x"), known).alias("x"), vocab.term_frequencies(F.col("y"), known).alias("y"))
    rows = got.select("x", vectors.sparse_cosine(F.col("x"), F.col("y")).alias("c")).collect()
    assert [[tuple(e) for e in r.x] if r.x is not None else None for r in rows] == [[(2, 2), (3, 1)], [], None, [(9, 1)]]
    assert np.allclose([r.c for r in rows], [2 / 10**0.5, 0, 0, 1])
    with pytest.raises(ValueError):
        vocab.term_frequencies(F.col("x"), known, 2)


def test_lexed_texts_have_the_tokens_of_the_lexer_and_the_features_of_the_texts(spark):
    from pairlake.functions import lexer, lexing
    from pairlake.operators import vocab as I

    odd = "ab \u0531\u0562 '\u0905 x' \U0001f600 1.5\n== n%41;"
    texts = ["", "\n", "a b\n c1 'x y' \"p\u00a0q\" 12.50 ++ --x !== % %20; \u00e9t\u00e9 \u4e00\u3042", "x\u00a0\u2028y\u0085 #\x00 'open\n>>>= <<", odd, None]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexed = docs.withColumn("lexed", lexing.lexed_lines(F.col("text")))
    both = lexed.select(
        F.replace(lexer.class_lines(F.col("text")), F.lit("\n"), F.lit("")).alias("a"), F.size(F.split("text", "\n")).alias("n"), F.size(F.split("lexed", "\n")).alias("m"),
        lexing.compared(F.col("lexed"), F.col("lexed"), models.LETTERS)["a"].alias("b"), F.size(F.array_distinct(lexer.raw_tokens(F.col("text")))).alias("k"),
        lexing.compared(F.col("lexed"), F.col("lexed"), models.LETTERS)["own"].alias("own"),
        *[lexer.join_tokens(lexer.tokens(F.col("text"), m)).alias(m) for m in ("class", "value")],
        *[lexing.token_text(F.col("text"), m)["tokens"].alias(f"{m}2") for m in ("class", "value")],
    ).collect()
    for r in both:
        assert (r.a, r["class"], r.value, r.n) == (r.b, r.class2, r.value2, r.m) and (r.a is None or r.k == r.own)
    vocab = I.fit_vocab(lexed.select(lexing.token_text(F.col("text"), "value")["tokens"].alias("t")), ["t"])
    pairs = docs.alias("x").crossJoin(docs.alias("y")).selectExpr("x.doc_id as seed_id", "y.doc_id as other", "x.text as seed_text", "concat(y.text, '\n', x.text, '\n', y.text) as target_text")
    at = lambda df, **kw: {(r.seed_id, r.other): r for r in models.pair_features(df, vocab=vocab, **kw).collect()}
    ready = lexed.select("doc_id", F.col("lexed").alias("text"))
    mixed = ready.alias("x").crossJoin(ready.alias("y")).selectExpr("x.doc_id as seed_id", "y.doc_id as other", "x.text as seed_text", "concat(y.text, '\n', x.text, '\n', y.text) as target_text")
    whole = at(pairs, corpus=docs)
    assert whole == at(mixed, corpus=ready, lexed=True) == at(mixed, lexed=True) and len(whole) == 36
    assert whole[2, 2].overlap == 1.0 and whole[2, 2].size_delta == 2.0 and whole[5, 2].overlap == 0.0


def test_texts_of_pairs_are_not_shuffled_for_the_counts_of_the_seeds(spark):
    known = spark.createDataFrame([("a", 2), ("b", 3), ("num", 4)], "token string, id int")
    corpus = spark.createDataFrame([(1, "a a b 7"), (2, None), (3, "b"), (3, "a b c")], "doc_id long, text string")
    rows = [(k, seed, text, target) for k, (seed, text) in enumerate([(1, "a a b 7"), (2, None), (3, "b"), (4, "a"), (None, "a")]) for target in ("b 1 2\na", "", None, "zz")]
    pairs = spark.createDataFrame(rows, "k int, seed_id long, seed_text string, target_text string")
    features = models.pair_features(pairs, vocab=known, corpus=corpus)
    assert features.columns == ["k", "seed_id", "tf_cosine", *models.FEATURES]
    counts = {1: [[2, 1, 1]], 2: [[0, 0, 0]], 3: [[0, 1, 0], [1, 1, 0]], 4: [[0, 0, 0]], None: [[0, 0, 0]]}
    targets = {"b 1 2\na": [1, 1, 2]}
    cosine = lambda x, y: round(float(np.dot(x, y)) / (np.linalg.norm(x) * np.linalg.norm(y)), 9) if any(x) and any(y) else 0.0
    want = sorted((k, cosine(x, targets.get(t, [0, 0, 0]))) for k, seed, _, t in rows for x in counts[seed])
    assert sorted((r.k, round(r.tf_cosine, 9)) for r in features.collect()) == want
    plain = models.pair_features(pairs, vocab=known).drop("tf_cosine")
    assert {tuple(r) for r in features.drop("tf_cosine").collect()} == {tuple(r) for r in plain.collect()}
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = models.pair_features(pairs, vocab=known, corpus=corpus)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    todo, sent = [plan.executedPlan() if "Adaptive" in plan.nodeName() else plan], []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            sent.append(node.output().toString())
    assert len(sent) == 2 and not any("text" in columns for columns in sent)


def test_odd_characters_are_those_outside_the_known_ranges(spark):
    from pairlake.functions import lexing

    inside = [chr(c) for a, _, b in lexing.SAME for c in (ord(a), (ord(a) + ord(b)) // 2, ord(b))]
    outside = ["\u0250", "\u03ff", "\u0500", "\u200f", "\u2028", "\u205f", "\u302a", "\u3040", "\u9fa6", "\ud7a4", "\uff61", "\uffff", "\U0001f600", "\U0010ffff"]
    rows = spark.createDataFrame([("a" + c + "b", c in outside) for c in inside + outside], "text string, odd boolean")
    assert rows.where(lexing.odd(F.col("text")) != F.col("odd")).count() == 0


def test_distances_of_many_pairs_are_those_of_each(spark):
    import random

    from pairlake.functions import edit

    draw = random.Random(5)
    text = lambda n, kinds: "".join(draw.choices(kinds, k=n))
    for kinds in ("ab", "nnnn.,", "a\u00e9\u4e00\U0001f600"):
        pairs = [(text(draw.randrange(300), kinds), text(draw.randrange(300), kinds)) for _ in range(150)]
        pairs += [("", "a"), ("a", ""), ("", ""), ("a" * 64, "b" * 64), ("ab" * 64, "ba" * 64)]
        want = [edit.edit_distance(a, b) for a, b in pairs]
        assert edit.edit_distances(pairs) == want == edit.edit_distances([(list(a), list(b)) for a, b in pairs])
        group = [(-(-max(len(a), len(b)) // 64), max(len(a), len(b)), k, *sorted((a, b), key=len, reverse=True)) for k, (a, b) in enumerate(pairs) if a and b]
        assert edit._together(group) == [want[g[2]] for g in group]


def test_clone_search_sends_a_vector_to_few_blocks_and_keeps_all_ties():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(700, 8))
    counts = draw.integers(1, 1000, 700)
    counts[5] = 200_000
    first, many = search._blocks(np.arange(700), counts, centres, 10**6)
    used = np.concatenate([np.arange(f, f + m) for f, m in zip(first, many)])
    assert set(used) == set(range(used.max() + 1)) and used.max() < 2 * search.BLOCKS + 2
    size = search._block_rows(int(counts.sum()), 10**6)
    held = np.bincount(first[many == 1], counts[many == 1])
    assert held.max() <= size and many[5] == -(-200_000 // size)
    assert search._block_rows(10**9, 5000) == 5000 and search._block_rows(3, 5000) == search.LEAST_ROWS
    # copies of vectors tie; ids repeat
    vectors = draw.normal(size=(40, 4))
    vectors /= np.sqrt((vectors**2).sum(1))[:, None]
    vectors = vectors[draw.integers(0, 40, 900)]
    ids = draw.permutation(900)
    ids[:20] = ids[20:40]
    for k, skip_same, rows in ((3, True, 900), (5, False, 900), (50, True, 40)):
        keys, found, scores = search._best(ids[:rows], vectors[:rows], ids, vectors, k, skip_same)
        wanted = []
        for key, v in zip(ids[:rows], vectors[:rows]):
            line = np.round(np.clip((vectors @ v + 1) / 2, 0, 1), 9)
            wanted += sorted([(-s, i) for i, s in zip(ids, line) if not (skip_same and i == key)])[:k]
        assert [(-s, i) for s, i in zip(scores.tolist(), found.tolist())] == [(s, int(i)) for s, i in wanted]
        assert keys.tolist() == np.repeat(ids[:rows], k).tolist()
