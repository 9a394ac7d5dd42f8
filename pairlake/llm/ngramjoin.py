"""N-gram Jaccard join by an LSH forest of MinHash signatures.

A text is the set of its five-word shingles. Texts with equal sets are one
class. Each class gets a signature of ``TREES`` keys of ``LONGEST`` minima; a tree
is a prefix trie of one key. Two classes are candidates if they share a prefix in
some tree. The prefix is as long as the chance of meeting at the similarity threshold
allows (``sure``), and is shortened further only if what the links found so far say
about those not found asks for it (``recall``); with the default parameters it does
not. Candidates are verified on their whole shingle sets.

A trie node is compared in blocks of bounded size, inside tasks: what leaves a
task are one row per class and block with the number of its links, and one row
per class to tie it to its group, never the pairs. A pair that meets in several
trees counts in the first of them only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pairlake.llm.common import WORD, fresh
from pairlake.llm.components import components
from pairlake.session import cut

WORDS, SIMILARITY, TREES, LONGEST, SURE, RECALL, SEED = 5, 0.8, 24, 6, 0.9999, 0.9999, 42
#: Classes and shingles of a block; what bounds the memory of a task that compares two blocks.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
#: Estimates this far (in standard deviations) below the threshold are still verified.
DEVIATIONS = 6
#: Bounds of a task's word cache and of the shingles hashed at a time.
CACHE, STEP = 300_000, 4096


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _hashed(text: str, words: int, cache: _Words, find=re.compile(WORD).findall) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of a shorter text, all its words are the one n-gram; none without words."""
    found = find(text)
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    size = min(words, len(each))
    rolled = np.full(len(each) - size + 1, size, np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + each[k : len(each) - size + 1 + k]
    rolled = (rolled ^ (rolled >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(rolled ^ (rolled >> np.uint64(29)))


def signature(hashed: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """One minimum per hash function, as 16 bits."""
    short = (hashed >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), STEP):
        np.minimum(least, (short[at : at + STEP, None] * factors + shifts).min(0), out=least)
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(">u2")


def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def _sketch(words: int, trees: int, longest: int, seed: int) -> Callable:
    """Rows (doc, digest, text) to (doc, digest, class, shingles, signature); the signature of no shingles is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _functions(trees * longest, seed)
        cache = _Words()
        for batch in batches:
            names, sizes, signs = [], [], []
            for value in batch.column(2):
                hashed = _hashed(value.as_py() or "", words, cache)
                names.append(xxhash.xxh3_128_digest(hashed.tobytes()))
                sizes.append(len(hashed))
                signs.append(signature(hashed, factors, shifts).tobytes() if len(hashed) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary())],
                ["doc", "digest", "class", "size", "sign"],
            )

    return run


def meeting(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that two sets share a prefix of ``depth`` in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the first ``keys`` columns; rows come sorted by these and the class, a run is bounded by two blocks."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            if not held or held[-1][5] != row[5]:  # a class comes once, however often its row is repeated
                held.append(row)
    if held:
        yield held


class _Group:
    """The classes of one block pair. Rows: (node, i, j, tree, block, class, size, sign, ..)."""

    def __init__(self, rows: list[tuple], depth: int, trees: int, longest: int, threshold: float):
        self.rows, self.depth, self.threshold = rows, depth, threshold
        _, i, j, self.tree = rows[0][:4]
        self.signs = np.frombuffer(b"".join(r[7] for r in rows), ">u2").astype(np.uint16).reshape(len(rows), trees, longest)
        self.sizes = np.array([r[6] for r in rows], np.int64)
        self.sides = np.array([r[4] for r in rows]) if i != j else None
        self.least = threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / (trees * longest))

    def candidates(self, step: int = 16) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, mask of some rows x all rows): pairs that meet first in this tree, whose sizes and signatures allow a link."""
        n = len(self.rows)
        for at in range(0, n, step):
            some = slice(at, min(at + step, n))
            same = self.signs[some, None] == self.signs[None]
            mask = same.reshape(same.shape[0], n, -1).mean(2) >= self.least
            if self.tree:
                mask &= ~same[:, :, : self.tree, : self.depth].all(3).any(2)
            small, large = np.minimum(self.sizes[some, None], self.sizes[None]), np.maximum(self.sizes[some, None], self.sizes[None])
            mask &= small >= self.threshold * large
            if self.sides is not None:  # only between the two blocks
                mask &= self.sides[some, None] != self.sides[None]
            mask[np.arange(same.shape[0]), np.arange(at, some.stop)] = False
            yield at, mask


def _wanted(depth: int, trees: int, longest: int, threshold: float) -> Callable:
    """Rows of block pairs to those that any candidate pair needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            used = np.concatenate([mask.any(1) for _, mask in _Group(rows, depth, trees, longest, threshold).candidates()])
            if used.any():
                chosen = [r for r, u in zip(rows, used) if u]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in chosen], t) for k, t in
                     ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()), (5, pa.binary()))],
                    ["node", "i", "j", "tree", "block", "class"],
                )

    return run


def _shared(sets: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """Exact sizes of all intersections: products of incidence matrices in blocks of columns; shingles of one set alone share nothing."""
    whole = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, often = np.unique(whole, return_inverse=True, return_counts=True)
    kept = often[column] > 1
    number = np.cumsum(often > 1) - 1
    owner, column = owner[kept], number[column[kept]]
    total = np.zeros((len(sets), len(sets)), np.float32)  # below 2**24: exact
    for at in range(0, int((often > 1).sum()), step):
        part = np.zeros((len(sets), step), np.float32)
        here = (column >= at) & (column < at + step)
        part[owner[here], column[here] - at] = 1
        total += part @ part.T
    return total


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least row of each row's component in a symmetric matrix of links."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None], len(linked)).min(1)
        new = np.minimum(root, near)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _verified(words: int, depth: int, trees: int, longest: int, threshold: float) -> Callable:
    """Rows of block pairs with texts to (class, links, copies, root, found, expected)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for rows in _groups(batches, 3):
            group = _Group(rows, depth, trees, longest, threshold)
            both = _shared([_hashed(r[9] or "", words, cache) for r in rows])
            linked = np.concatenate([mask for _, mask in group.candidates()])
            alike = both / (group.sizes[:, None] + group.sizes[None] - both)
            linked &= both >= threshold * (group.sizes[:, None] + group.sizes[None] - both)
            links = linked.sum(1)
            some = np.flatnonzero(links)
            if not len(some):
                continue
            copies = linked.astype(np.float64) @ np.array([r[8] for r in rows], np.float64)
            root = _roots(linked)
            expected = (1 / (1 - (1 - alike[linked] ** depth) ** trees)).sum() / 2
            rest = [0] * (len(some) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[k][5] for k in some], pa.binary()), pa.array(links[some], pa.int64()),
                 pa.array(copies[some].astype(np.int64)), pa.array([rows[root[k]][5] for k in some], pa.binary()),
                 pa.array([int(links.sum()) // 2, *rest], pa.int64()), pa.array([float(expected), *rest], pa.float64())],
                ["class", "links", "copies", "root", "found", "expected"],
            )

    return run


def _nodes(classes: DataFrame, depth: int, trees: int, longest: int, block: int) -> DataFrame:
    """(node, i, j, tree, block, class, size, sign): the trie nodes of two or more classes at this depth, in pairs of blocks.

    Nodes of different trees with the same classes are kept in the first of
    them only. Node sizes come from partial aggregation.
    """
    width = 2 * longest
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.substring("sign", t * width + 1, F.lit(2 * depth))).alias("node")),
    )
    placed = classes.where("sign is not null").select("class", "size", F.explode(keys).alias("k")).select("class", "size", "k.tree", "k.node")
    first, second = F.xxhash64("class"), F.xxhash64(F.lit(1), "class")
    nodes = placed.groupBy("node", "tree").agg(
        F.count("*").alias("n"), F.sum("size").alias("shingles"), F.bit_xor(first).alias("x"), F.bit_xor(second).alias("y")
    ).where("n > 1")
    nodes = nodes.groupBy("x", "y", "n", "shingles").agg(F.min(F.struct("tree", "node")).alias("k"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    nodes = nodes.select("k.tree", "k.node", blocks.alias("blocks"))
    rows = placed.join(nodes, ["node", "tree"]).withColumn("block", F.pmod(F.xxhash64(F.lit(2), "class"), "blocks").cast("int"))
    # block b meets each block once, itself too
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rows.select("node", "tree", "block", "blocks", "class").join(classes.select("class", "size", "sign"), "class")
    rows = rows.select("node", "tree", "block", "class", "size", "sign", F.explode(others).alias("o"))
    return rows.select("node", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "tree", "block", "class", "size", "sign")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "class")


def links_at(docs: DataFrame, classes: DataFrame, depth: int, words: int, threshold: float, trees: int, longest: int, block: int) -> DataFrame:
    """(class, links, copies, root, found, expected) per class and block pair: verified links at this depth."""
    blocks = _dealt(_nodes(classes, depth, trees, longest, block))
    wanted = cut(blocks.mapInArrow(
        _wanted(depth, trees, longest, threshold), "node long, i int, j int, tree int, block int, class binary"
    ))
    # each class's text comes from one of its documents, read again; texts without candidates are not joined
    chosen = classes.join(wanted.select("class").distinct(), "class", "left_semi").select("class", "doc", "digest", "size", "sign", "copies")
    texts = docs.join(
        chosen.withColumnsRenamed({"doc": "d2", "digest": "g2"}), F.col("doc").eqNullSafe(F.col("d2")) & (F.col("digest") == F.col("g2"))
    ).select("class", "size", "sign", "copies", "text")
    rows = wanted.join(texts, "class").select("node", "i", "j", "tree", "block", "class", "size", "sign", "copies", "text")
    return _dealt(rows).mapInArrow(
        _verified(words, depth, trees, longest, threshold), "class binary, links long, copies long, root binary, found long, expected double"
    )


def _ids(
    docs: DataFrame, names: list[str], key: str, text: str, words: int, threshold: float, trees: int, longest: int, sure: float,
    recall: float, block: int, seed: int,
) -> DataFrame:
    """One row per distinct (key, digest of the text), under ``names``: both, rep, class, number of links, first, rows alike."""
    read = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias("text"))
    met = cut(read.mapInArrow(_sketch(words, trees, longest, seed), "doc long, digest long, class binary, size int, sign binary"))
    who = F.struct(F.col("doc").isNull().alias("absent"), "doc", "digest")
    classes = met.groupBy("class").agg(F.min(who).alias("w"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sign").alias("sign"))
    classes = cut(classes.select("class", "w.absent", "w.doc", "w.digest", "copies", "size", "sign"))
    depth = max((d for d in range(1, longest + 1) if meeting(threshold, d, trees) >= sure), default=1)
    while True:
        links = cut(links_at(read, classes, depth, words, threshold, trees, longest, block))
        seen = links.agg(F.sum("found").alias("n"), F.sum("expected").alias("e")).first()
        if depth == 1 or not seen["n"] or seen["n"] / seen["e"] >= recall:
            break
        depth -= 1
    each = links.groupBy("class").agg(F.sum("copies").alias("linked"))
    tied = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    known = classes.join(each, "class", "left").join(tied.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "absent", "doc", "digest", F.coalesce("root", "class").alias("root"),
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n"),
    )
    tops = known.groupBy("root").agg(F.min(F.struct("absent", "doc", "digest")).alias("top"))
    known = known.join(tops, "root").select("class", F.col("doc").alias("rep"), "top", "n")
    alike = met.groupBy("class", "doc", "digest").agg(F.count("*").alias("alike"))
    first = F.col("doc").eqNullSafe(F.col("top.doc")) & (F.col("digest") == F.col("top.digest"))
    return alike.join(known, "class").select(
        *[c.alias(n) for c, n in zip((F.col("doc"), F.col("digest"), F.col("rep"), F.col("top.doc"), F.col("n"), first, F.col("alike")), names)]
    )


def join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = SIMILARITY, trees: int = TREES,
    longest: int = LONGEST, sure: float = SURE, recall: float = RECALL, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``rep_id``, ``class_id``, ``n_links``, ``first`` and ``alike`` (underscores put before names it has).

    ``n_links``: other rows whose Jaccard similarity with this one is at least
    ``threshold``, copies included. ``class_id``: the least key of all rows tied to
    this one by links; ``rep_id``: the least key of the rows with an equal shingle
    set. ``first``: this row is the first of its class by key (null last) and
    digest of the text. ``alike``: rows equal to this one in key and text, itself
    included; they are first together.

    Texts without words (null, empty, blank) have the empty set and are one class.
    Repeated rows count as copies of one another; null keys are allowed (the
    class of null keys only has the id null); an empty table stays empty.

    Recall: a pair at the threshold meets with a chance of ``sure`` at least, and
    all pairs together, weighted by their chances, of ``recall``. ``key`` has to be an
    integer.
    """
    names = fresh(docs, "_d2", "_g2", "rep_id", "class_id", "n_links", "first", "alike", "_digest")
    ids = _ids(docs, names[:7], key, text, words, threshold, trees, longest, sure, recall, block, seed)
    at = F.col(key).cast("long").eqNullSafe(F.col(names[0])) & (F.col(names[7]) == F.col(names[1]))
    out = docs.withColumn(names[7], F.xxhash64(F.col(text))).join(ids, at)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *names[2:7])


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class of ``join``; the columns stay. Of rows that repeat in key and text one stays."""
    joined = join(docs, key, text, **options)
    first, alike = joined.columns[-2:]
    kept = joined.where(F.col(first))
    (digest,) = fresh(joined, "_digest")
    # rare; texts that are not repeated are not shuffled once more
    again = kept.where(F.col(alike) > 1).withColumn(digest, F.xxhash64(F.col(text))).dropDuplicates([key, digest])
    out = kept.where(F.col(alike) == 1).unionByName(again.drop(digest))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
