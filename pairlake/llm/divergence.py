"""Audit of how far the sources of a language differ in their terms.

A term is a run of letters: one translate table over the bytes of a text lowers A to
Z and blanks all other ASCII characters, so that a split gives the terms and a
counter per document their frequencies; its keys count the document. A task adds these up
per language and source in tables of bounded size, and what it hands on are
sparse counts (language, source, term), so a term in all texts is a few rows per
task and source. They are dealt by language and term once; there the sources of a
term are added up, its documents counted, and only terms that are kept go on.

Smoothed shares are whole numbers, p = 1 + floor(SCALE (count + ALPHA) / (N + ALPHA V)) over the V
kept terms of the language, so all sums and differences are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairlake.session import cut

#: Documents of a language that a kept term is in; what is added to each count; the scale of shares; terms listed per group.
LEAST_DOCS, ALPHA, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Entries that a task adds up before it hands them on.
HELD = 400_000
#: Terms of a bucket, sources of a block, and terms compared at a time.
BUCKET_TERMS, BLOCK_SOURCES, STEP_TERMS = 2048, 128, 1024
#: A to Z in lower case, a blank for every other ASCII character but letters.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def counted(text: bytes | None) -> Counter:
    """How often each term occurs in a UTF-8 text."""
    return Counter((text or b"").translate(_TABLE).split())


def _sums(held: int) -> Callable:
    """Rows (lang, source, text) to (lang, source, term, n, docs), added up for some texts."""
    kinds = [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())]

    def rows(often: dict[tuple, Counter], docs: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in docs.items():
            total, size = often[lang, source], len(found)
            yield pa.RecordBatch.from_arrays([
                pa.repeat(lang, size), pa.repeat(source, size), pa.array(list(found), pa.binary()),
                pa.array([total[t] for t in found], pa.int64()), pa.array(list(found.values()), pa.int64()),
            ], [k for k, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}
        size = 0
        for batch in batches:
            for lang, source, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                each = counted(value.as_py())
                total, seen = often.setdefault((lang, source), Counter()), docs.setdefault((lang, source), Counter())
                size -= len(seen)
                total.update(each)
                seen.update(each.keys())
                size += len(seen)
                if size >= held:
                    yield from rows(often, docs)
                    often, docs, size = {}, {}, 0
        yield from rows(often, docs)

    return run


def _read(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, text): nulls are '', texts are bytes."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(plain(lang).alias("lang"), plain(source).alias("source"), F.col(text).cast("binary").alias("text"))


def vocabulary(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, held: int = HELD
) -> DataFrame:
    """(lang, term, n, by): the terms in ``least_docs`` documents of a language or more, how often they occur there, and
    array<struct<source, n>> how often in each source that has them.

    Null text, lang and source are ''. Terms are bytes of UTF-8. A text is read once; an empty table gives no rows.
    """
    each = _read(docs, text, lang, source).mapInArrow(_sums(held), "lang string, source string, term binary, n long, docs long")
    per = each.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = per.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))  # as many as there are sources
    return whole.where(F.col("docs") >= least_docs).select("lang", "term", "n", "by")


def share(count: Column, whole: Column, kept: Column, alpha: int = ALPHA, scale: int = SCALE) -> Column:
    """1 + floor(scale (count + alpha) / (whole + alpha kept)), exact: in whole numbers of up to 38 digits."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    above = wide(F.lit(scale), 12) * (wide(count, 19) + wide(F.lit(alpha), 6))
    below = wide(whole, 19) + wide(F.lit(alpha), 6) * wide(kept, 12)
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def shares(kept: DataFrame, groups: DataFrame, alpha: int = ALPHA, scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """(cells, groups) of a vocabulary and the (lang, source) that occur.

    Cells: (lang, source, term, p, q) of the kept terms that occur in a group, with its share p and the language's q.
    Groups: (lang, source, kept, whole, zero) of each group: kept terms of the language, the group's occurrences
    of them, and the share of a kept term that it does not have (null where the language has none).
    """
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("all"))
    cells = kept.select("lang", "term", F.col("n").alias("every"), F.explode("by").alias("b")).select("lang", "b.source", "term", "b.n", "every")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept", "all", "whole")])
    zero = F.when(F.col("kept") > 0, share(F.lit(0), F.col("whole"), F.col("kept"), alpha, scale))
    groups = groups.withColumn("zero", zero)
    p, q = share(F.col("n"), F.col("whole"), F.col("kept"), alpha, scale), share(F.col("every"), F.col("all"), F.col("kept"), alpha, scale)
    cells = cells.join(groups.drop("zero"), ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"))
    return cells, groups.drop("all")


def _differences(step: int) -> Callable:
    """Rows (lang, i, j, bucket, term, block, source, p), sorted so, to (lang, a, b, value): sums over the terms of a bucket of
    |p - q|, less what two sources without the term differ by.

    The rows without a term come first and name all sources of both blocks with their shares of absent terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, None
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns])
            for lang, i, j, bucket, term, block, source, p in rows:
                if (lang, i, j, bucket) != now:
                    if open_:
                        yield open_.ended()
                    now, open_ = (lang, i, j, bucket), _Block(lang, i, j, step)
                if term is None:
                    open_.name(block, source, p)
                else:
                    open_.add(term, block, source, p)
        if open_:
            yield open_.ended()

    return run


class _Block:
    """Sums of absolute differences between the sources of two blocks, some terms at a time."""

    def __init__(self, lang: str, i: int, j: int, step: int):
        self.lang, self.i, self.j, self.step = lang, i, j, step
        self.places: dict[str, int] = {}
        self.sides: list[int] = []
        self.zeros: list[int] = []
        self.cells: list[tuple[int, int, int]] = []
        self.term, self.terms, self.sums = None, 0, None

    def name(self, block: int, source: str, zero: int) -> None:
        self.places[source] = len(self.places)
        self.sides.append(block)
        self.zeros.append(zero)

    def add(self, term: bytes, block: int, source: str, p: int) -> None:
        if term != self.term:
            if self.terms == self.step:
                self.flush()
            self.term, self.terms = term, self.terms + 1
        self.cells.append((self.places[source], self.terms - 1, p))

    def flush(self) -> None:
        if self.sums is None:
            sides = np.array(self.sides)
            self.left, self.right = np.flatnonzero(sides == self.i), np.flatnonzero(sides == self.j)
            self.sums = np.zeros((len(self.left), len(self.right)), np.int64)
        if not self.terms:
            return
        p = np.repeat(np.array(self.zeros, np.int64)[:, None], self.terms, 1)
        source, term, value = np.array(self.cells, np.int64).T
        p[source, term] = value
        other, zeros = p[self.right], np.array(self.zeros, np.int64)
        for k, at in enumerate(self.left):
            self.sums[k] += np.abs(p[at] - other).sum(1) - self.terms * np.abs(zeros[at] - zeros[self.right])
        self.cells, self.terms = [], 0

    def ended(self) -> pa.RecordBatch:
        self.flush()
        names = list(self.places)
        a, b = np.repeat(self.left, len(self.right)), np.tile(self.right, len(self.left))
        some = a != b if self.i != self.j else a < b
        return pa.RecordBatch.from_arrays([
            pa.array([self.lang] * int(some.sum()), pa.string()), pa.array([names[x] for x in a[some]], pa.string()),
            pa.array([names[x] for x in b[some]], pa.string()), pa.array(self.sums.ravel()[some])], ["lang", "a", "b", "value"])


def source_pairs(
    cells: DataFrame, groups: DataFrame, bucket_terms: int = BUCKET_TERMS, block_sources: int = BLOCK_SOURCES, step: int = STEP_TERMS
) -> DataFrame:
    """(lang, source, item, value): for each source of a language and each other one, the sum of |p - q| over all kept terms.

    Two sources without a term differ by their ``zero`` shares; that much is taken for
    all kept terms, and corrected for those that a source of the two blocks has. A language's terms are dealt into buckets and its sources into
    blocks, so a task holds two blocks of sources and ``step`` terms at a time.
    """
    blocks = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / block_sources).cast("int").alias("blocks"), F.ceil(F.max("kept") / bucket_terms).cast("int").alias("buckets"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    named = groups.join(blocks, "lang").withColumn("block", block)
    marks = named.where("kept > 0").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit(None).cast("binary").alias("term"),
        "block", "blocks", "source", F.col("zero").alias("p"))
    filled = cells.join(named.select("lang", "source", "block", "blocks", "buckets"), ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "term", "block", "blocks", "source", "p")
    met = marks.unionByName(filled).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("lang", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "bucket", "term", "block", "source", "p")
    dealt = met.repartition("lang", "i", "j", "bucket").sortWithinPartitions("lang", "i", "j", "bucket", F.col("term").asc_nulls_first(), "source")
    sums = dealt.mapInArrow(_differences(step), "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = [groups.select("lang", F.col("source").alias(c), F.col("zero").alias(f"z{c}"), F.col("kept").alias(f"k{c}")) for c in "ab"]
    sums = sums.join(ends[0], ["lang", "a"]).join(ends[1], ["lang", "b"]).select(
        "lang", "a", "b", (F.col("value") + F.col("ka") * F.abs(F.col("za") - F.col("zb"))).alias("value"))
    # a language without kept terms: all differences are 0
    bare = groups.where("kept = 0").select("lang", F.col("source").alias("a"))
    bare = bare.join(bare.withColumnRenamed("a", "b"), "lang").where("a < b").withColumn("value", F.lit(0).cast("long"))
    half = sums.unionByName(bare)
    both = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    return both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")


def over_represented(cells: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms whose share in a group is above the language's, and by how much."""
    return cells.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP,
    alpha: int = ALPHA, scale: int = SCALE, **sizes: int,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs.

    Part ``pair``: the other sources of the language by the sum of the differences of
    shares over all kept terms, the farthest first, all of them; 0 where the
    language keeps no term. Part ``term``: the ``top`` terms that the group has more
    of than the language. Ties go by the item's bytes. Null text, lang and source are
    ''; a group of texts without terms has no ``term`` rows; repeated rows count
    each; other columns do not matter; an empty table gives no rows.
    """
    kept = cut(vocabulary(docs, text, lang, source, least_docs))
    cells, groups = shares(kept, cut(_read(docs, text, lang, source).select("lang", "source").distinct()), alpha, scale)
    cells, groups = cut(cells), cut(groups)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(cells, groups, **sizes).withColumn("rank", F.row_number().over(by))
    terms = over_represented(cells).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(pairs, "pair").unionByName(shown(terms, "term"))
