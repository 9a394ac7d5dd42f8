"""Labelled pairs: partners by rank equi-join, replication, two-sided labels.

A partner is the holder of a drawn rank, so pairing is an equi-join on
(group, rank) of id-only rows. Ranks are unique, so no join key is hot, even
if most texts are copies of one another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairlake.functions.draws import draw, step_past
from pairlake.functions.packing import greatest_unpacked, packed
from pairlake.operators.ranks import shuffled_rank
from pairlake.session import by_key, cut, fan_out


def partner(
    df: DataFrame, ranks: DataFrame, drawn: Column, avoid: Sequence[str], out: str, by: Sequence[str] = ()
) -> DataFrame:
    """Adds ``out``: a uniform key among ``ranks`` whose rank is not in the ``avoid`` columns.

    ``df`` carries ``n`` (targets in its group) and the avoided ranks; the
    chosen rank is kept as ``<out>_rank``.
    """
    by = list(by)
    chosen = step_past(drawn, F.col("n"), *[F.col(a) for a in avoid])
    key = [c for c in ranks.columns if c not in (*by, "rank", "n")][0]
    holders = ranks.select(*by, F.col("rank").alias(f"{out}_rank"), F.col(key).alias(out))
    return df.withColumn(f"{out}_rank", chosen).join(holders, [*by, f"{out}_rank"])


def random_partner(df: DataFrame, key: str, seed: int, salt: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., key, partner): one uniform other key of the same group for each key."""
    ranks = shuffled_rank(df, key, seed, by=by)
    picked = partner(ranks, ranks.drop("n"), draw(seed, salt, key), ["rank"], "partner", by)
    return picked.select(*by, key, "partner")


def make_pairs(
    keys: DataFrame, key: str, seed: int, pos: int = 1, neg: int = 1, by: Sequence[str] = ("stage",)
) -> DataFrame:
    """pos positive then neg negative pairs per seed, inside each group of ``by``.

    positive: alt = seed, base another target, label 1;
    negative: alt another target, base neither of the two, label 0.
    """
    by = list(by)
    # id-only and read by up to four joins: written once
    ranks = cut(shuffled_rank(keys, key, seed, by=by))
    holders = ranks.drop("n")
    reps = ranks.withColumnRenamed(key, "seed_id").select("*", F.explode(F.sequence(F.lit(1), F.lit(pos + neg))).alias("rep"))
    reps = reps.withColumn("label", (F.col("rep") <= pos).cast("int"))
    positive = (
        reps.where("label = 1").withColumn("alt_id", F.col("seed_id"))
        .transform(lambda d: partner(d, holders, draw(seed, "base", "seed_id", "rep"), ["rank"], "base_id", by))
    )
    negative = (
        reps.where("label = 0")
        .transform(lambda d: partner(d, holders, draw(seed, "alt", "seed_id", "rep"), ["rank"], "alt_id", by))
        .transform(
            lambda d: partner(d, holders, draw(seed, "base", "seed_id", "rep"), ["rank", "alt_id_rank"], "base_id", by)
        )
    )
    return union_pairs(*[d.select(*_pair_columns(by)) for d in (positive, negative)])


def _pair_columns(by: Sequence[str]) -> list:
    pair_id = F.concat_ws(".", "seed_id", "base_id", "label", "rep").alias("pair_id")
    return [pair_id, "seed_id", "alt_id", "base_id", "rep", "label", *by]


def union_pairs(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Positives, then negatives; nothing is removed."""
    return positive.unionByName(negative)


def union_records(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of both sides; an attribute missing on one side becomes null."""
    return left.unionByName(right, allowMissingColumns=True)


def first_success(
    keys: DataFrame, ok: DataFrame, key: str, seed: int, attempts: int = 10, by: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """(by.., key, attempt, partner, status): the first of ``attempts`` drawn partners that is ok.

    ``ok`` is (key, ok BOOLEAN), evaluated once per document, not per attempt.
    Keys without a usable partner stay, with status 'failed' and null partner,
    or stop the job if ``strict``.
    """
    by = list(by)
    ranks = cut(shuffled_rank(keys, key, seed, by=by))  # id-only, read three times
    holders = ranks.drop("n").join(ok.select(key, "ok"), key).withColumnRenamed(key, "partner")
    tries = ranks.select("*", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    tries = tries.withColumn(
        "partner_rank", step_past(draw(seed, "try", key, "attempt"), F.col("n"), F.col("rank"))
    ).drop("rank")
    # only usable holders take part, so the join already keeps successes only
    good = tries.join(holders.where("ok").select(*by, F.col("rank").alias("partner_rank"), "partner"), [*by, "partner_rank"])
    best = good.groupBy(*by, key).agg(F.min(F.struct("attempt", "partner")).alias("best"))
    every = ranks.select(*by, key).join(best, [*by, key], "left")
    failed = F.col("best").isNull()
    status = F.when(failed, F.lit("failed")).otherwise(F.lit("ok"))
    if strict:
        status = F.when(failed, F.raise_error(F.lit("no usable partner in all attempts"))).otherwise(status)
    return every.select(*by, key, F.col("best.attempt").alias("attempt"), F.col("best.partner").alias("partner"), status.alias("status"))


def pair_targets(targets: DataFrame, seed: int, by: Sequence[str] = ("stage", "exp", "mix")) -> DataFrame:
    """Two rows per target: label 1 with its true source, label 0 with a counter source.

    ``targets`` is (by.., source, base), one per source in a cell; the counter
    is drawn among the sources of the cell, avoiding source and base.
    """
    by = list(by)
    ranks = cut(shuffled_rank(targets, "source", seed, "counter", by=by))  # id-only, read three times
    holders = ranks.drop("n")
    known = targets.join(ranks, [*by, "source"])
    base_rank = holders.select(*by, F.col("source").alias("base"), F.col("rank").alias("base_rank"))
    known = known.join(base_rank, [*by, "base"], "left")
    drawn = draw(seed, "counter_pick", *by, "source")
    chosen = F.when(
        F.col("base_rank").isNull(), step_past(drawn, F.col("n"), F.col("rank"))
    ).otherwise(step_past(drawn, F.col("n"), F.col("rank"), F.col("base_rank")))
    counter = holders.select(*by, F.col("rank").alias("counter_rank"), F.col("source").alias("counter"))
    known = known.withColumn("counter_rank", chosen).join(counter, [*by, "counter_rank"])
    sides = F.explode(
        F.array(
            F.struct(F.lit(0).alias("label"), F.col("counter").alias("seed")),
            F.struct(F.lit(1).alias("label"), F.col("source").alias("seed")),
        )
    )
    return known.select(*by, "source", "base", sides.alias("side")).select(
        *by, F.col("side.seed").alias("seed"), "source", "base", F.col("side.label").alias("label")
    )


def attach(pairs: DataFrame, corpus: DataFrame, key: str = "doc_id", text: str = "text", pack: bool = False) -> DataFrame:
    """Adds seed_text, alt_text, base_text.

    The corpus is shuffled once for all roles: the pairs are turned to
    (pair, role, id) rows, joined, and put together again per pair. A positive
    pair does not carry its seed twice. ``pack``: texts are packed on their way, and where each
    pair_id has one seed the pairs of a seed meet where its text is, which then travels to no pair.
    """
    pairs = cut(pairs)  # id-only, needed on both sides of the text join
    docs = corpus.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    if pack:
        docs = docs.withColumn("text", packed(F.col("text")))
        if _one_seed_each(pairs):
            return _attach_by_seed(pairs, docs)
    role = lambda name: F.struct(F.lit(name).alias("role"), F.col(f"{name}_id").alias("doc"))
    needed = F.when(F.col("label") == 1, F.array(role("seed"), role("base"))).otherwise(
        F.array(role("seed"), role("alt"), role("base"))
    )
    roles = pairs.select("pair_id", F.explode(needed).alias("r")).select("pair_id", "r.role", "r.doc")
    # by pair first: else the texts would be sorted before the shuffle too, for a partial
    # aggregate that cannot shrink them; work on pairs is heavy, so no partitions are merged by size
    texts = fan_out(roles.join(docs, "doc"), "pair_id")
    # packed texts cannot be ordered, so all that a repeated key has come along
    best, shown = (F.collect_set, greatest_unpacked) if pack else (F.max, lambda c: c)
    at = lambda name: best(F.when(F.col("role") == name, F.col("text")))
    sides = texts.groupBy("pair_id").agg(at("seed").alias("_seed"), at("alt").alias("_alt"), at("base").alias("_base"))
    return _with_texts(pairs, pairs.join(sides, "pair_id"), shown(F.col("_seed")), shown(F.col("_alt")), shown(F.col("_base")))


def _with_texts(pairs: DataFrame, found: DataFrame, seed: Column, alt: Column, base: Column) -> DataFrame:
    found = found.select(*pairs.columns, seed.alias("seed_text"), alt.alias("_alt"), base.alias("base_text"))
    shown = F.when(F.col("label") == 1, F.col("seed_text")).otherwise(F.col("_alt"))
    return found.select(*pairs.columns, "seed_text", "base_text", shown.alias("alt_text"))


def _one_seed_each(pairs: DataFrame) -> bool:
    """Whether equal pair_ids have equal seeds: ids that hold the sign between them, or null ids, may make equal names."""
    seed = F.struct("seed_id")
    return not pairs.groupBy("pair_id").agg((F.min(seed) != F.max(seed)).alias("differ")).where("differ").take(1)


def _attach_by_seed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``attach`` of packed texts (doc, text) where each pair_id has one seed."""
    kind = docs.schema["doc"].dataType
    key = lambda c: F.struct(F.col(c).cast(kind).alias("k"))  # so that pairs without a seed meet what they have
    docs = by_key(docs.where("doc IS NOT NULL").select(key("doc").alias("_k"), "text"), "_k").groupBy("_k").agg(F.collect_set("text").alias("packs"))
    role = lambda name: F.struct(F.lit(name).alias("role"), key(f"{name}_id").alias("_k"))
    needed = F.when(F.col("label") == 1, F.array(role("base"))).otherwise(F.array(role("alt"), role("base")))
    roles = pairs.select(key("seed_id").alias("_seed"), "pair_id", F.explode(needed).alias("r")).select("_seed", "pair_id", "r.role", "r._k")
    sent = roles.join(docs, "_k").select("_seed", F.struct("pair_id", "role", "packs").alias("o"))
    sides = fan_out(sent, "_seed").groupBy("_seed").agg(F.collect_list("o").alias("_others"))
    own = docs.select(F.col("_k").alias("_seed"), F.col("packs").alias("_own"))
    # dealt out in any case: few files of ids would otherwise meet small broadcast texts in as few tasks
    found = fan_out(pairs.withColumn("_seed", key("seed_id")), "_seed").join(sides, "_seed", "left").join(own, "_seed", "left")
    found = found.withColumn("_others", F.filter("_others", lambda o: o["pair_id"] == F.col("pair_id")))
    # as by a join on the pair: it has a document at least
    found = found.where(F.col("pair_id").isNotNull() & (F.col("_own").isNotNull() | F.coalesce(F.size("_others") > 0, F.lit(False))))
    packs = lambda name: F.flatten(F.transform(F.filter("_others", lambda o: o["role"] == name), lambda o: o["packs"]))
    return _with_texts(pairs, found, greatest_unpacked(F.col("_own")), greatest_unpacked(packs("alt")), greatest_unpacked(packs("base")))


def missing(source: DataFrame, destination: DataFrame, key: str) -> DataFrame:
    """Keys of the source that the destination lacks."""
    return source.select(key).join(destination.select(key), key, "left_anti")


def completeness(source: DataFrame, destination: DataFrame, key: str) -> DataFrame:
    """One row: how many keys the source has and how many of them are missing."""
    seen = destination.select(key).distinct().withColumn("_there", F.lit(1))
    return source.select(key).join(seen, key, "left").agg(
        F.count("*").alias("size"), F.count_if(F.col("_there").isNull()).alias("missing")
    )


def two_folder_pairs(keys: DataFrame, key: str, seed: int) -> DataFrame:
    """The older two-folder form, per name: a "1" target (own text, another text) and
    a "0" target (two other texts, different from each other): (key, first, second, label)."""
    ranks = cut(shuffled_rank(keys, key, seed))  # id-only, read by five joins
    holders = ranks.drop("n")
    one = partner(ranks, holders, draw(seed, "one", key), ["rank"], "second").select(
        key, F.col(key).alias("first"), "second", F.lit(1).alias("label")
    )
    zero = partner(ranks, holders, draw(seed, "zero_first", key), ["rank"], "first")
    zero = partner(zero, holders, draw(seed, "zero_second", key), ["rank", "first_rank"], "second").select(
        key, "first", "second", F.lit(0).alias("label")
    )
    return one.unionByName(zero)


def one_pair(corpus: DataFrame, key: str, text: str, first, second) -> DataFrame:
    """One row with the two texts of a named pair; a pushed-down filter, no join."""
    side = lambda k: F.max(F.when(F.col(key) == F.lit(k), F.col(text)))
    return corpus.where(F.col(key).isin(first, second)).agg(
        F.lit(first).alias("seed_id"), F.lit(second).alias("target_id"),
        side(first).alias("seed_text"), side(second).alias("target_text"),
    )
