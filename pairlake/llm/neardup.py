"""Near-duplicates by one-permutation MinHash, banded buckets and star-shaped candidates.

A text is the set of its three-word shingles, A to Z in lower case. Texts with
equal sets are one class. One hash per shingle serves a whole signature: it chooses
a bin, and the least hash of a bin is its value. An empty bin takes the value of
the first filled bin in an order of its own (optimal densification), so bins agree
as often as the sets do, for short texts too. ``ROWS`` bins make a band; classes
that agree in a band share a bucket.

First, each bucket is a star: its hub, the least member by a seeded hash, against all
others, so candidates grow with the members and not with their square. Pairs are
confirmed on their whole shingle sets, compared word by word. Members that the stars
leave apart may still be linked with each other; so, second, in each bucket whose
members are not of one component yet, all that do not belong to its largest one are
compared with all members of other components, in blocks inside tasks. What leaves
a task are ties of a class to its group, never all pairs; nothing that shares a
bucket is left out, unless its signature is six standard deviations off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pairlake.llm.common import fresh
from pairlake.llm.components import components
from pairlake.llm.ngramjoin import _roots, _shared
from pairlake.session import cut

#: Words of a shingle; the similarity in hundredths. A pair at 0.85 shares one of 24 bands of 6 with a chance of 0.99999.
WORDS, PERCENT, BANDS, ROWS, SEED = 3, 85, 24, 6, 42
#: Different hubs that a set of members may get in its buckets; rows and shingles of a block.
STARS, BLOCK, BLOCK_SHINGLES, DEVIATIONS = 3, 512, 500_000, 6
#: Bound of a task's word cache.
CACHE = 300_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, parted at space and bytes 9 to 13, A to Z in lower case."""
    return (text or b"").translate(_LOWER).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def hashed(found: list[bytes], words: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of a shorter text all its words are the one shingle."""
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    size = min(words, len(each))
    rolled = np.full(len(each) - size + 1, size, np.uint64)
    for k in range(size):
        rolled = (rolled ^ each[k : len(each) - size + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        rolled ^= rolled >> np.uint64(32)
    rolled *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(rolled ^ (rolled >> np.uint64(29)))


def orders(bins: int, seed: int) -> np.ndarray:
    """Row i: the rank of each bin in the order in which an empty bin i looks for a filled one."""
    rng = np.random.default_rng(seed)
    return np.argsort(np.array([rng.permutation(bins) for _ in range(bins)]), 1)


def signature(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """One 16-bit value per bin, from sorted hashes: the least hash of the bin, mixed, or that of the bin it borrows from."""
    bins = len(ranks)
    where = ((shingles >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)  # ascends with the hash
    first = np.flatnonzero(np.diff(where, prepend=-1))
    filled = where[first]
    mixed = shingles[first] * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(bins, ">u2")
    out[filled] = (mixed >> np.uint64(48)).astype(">u2")
    empty = np.setdiff1d(np.arange(bins), filled)
    if len(empty):
        out[empty] = out[filled[np.argmin(ranks[np.ix_(empty, filled)], 1)]]
    return out


def _sketch(words: int, bins: int, seed: int) -> Callable:
    """Rows (doc, digest, text) to (doc, digest, class, size, sign); the signature of no shingles is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = orders(bins, seed), _Hashes()
        for batch in batches:
            names, sizes, signs = [], [], []
            for value in batch.column(2):
                found = hashed(words_of(value.as_py()), words, known)
                names.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                signs.append(signature(found, ranks).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())],
                ["doc", "digest", "class", "size", "sign"],
            )

    return run


def exact_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct numbers of the shingles, alike in all these texts just where the words are; no hashes."""
    number: dict[bytes, int] = {}
    rows = []
    for text in texts:
        ids = np.array([number.setdefault(w, len(number) + 1) for w in words_of(text)], np.int64)
        ids = np.concatenate([ids, np.zeros(max(words - len(ids), 0), np.int64)]) if len(ids) else ids  # 0: no word
        rows.append(np.lib.stride_tricks.sliding_window_view(ids, words) if len(ids) else np.zeros((0, words), np.int64))
    flat, base = np.concatenate(rows), len(number) + 1
    code, top = flat[:, 0].copy(), base
    for k in range(1, words):
        if top * base >= 1 << 62:  # ranks instead, so that it always fits
            code = np.unique(code, return_inverse=True)[1]
            top = len(code) + 1
        code, top = code * base + flat[:, k], top * base
    return [np.unique(c) for c in np.split(code, np.cumsum([len(r) for r in rows])[:-1])]


#: Columns of a row in a block: the block (node, i, j); 0 for those compared with all others, 1 for the others; component; class.
_BLOCK = "node binary, i int, j int, role int, comp binary, class binary"
_KINDS = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
_NAMES = ["node", "i", "j", "role", "comp", "class"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows of one block; rows come sorted by block and role."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[0][:3] != row[:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _apart(rows: list[tuple]) -> np.ndarray:
    """Which of the first rows (role 0) are to be compared with which others (role 1): those of other components, each pair once."""
    first = sum(r[3] == 0 for r in rows)
    mine, other = rows[:first], rows[first:]
    numbers = {c: k for k, c in enumerate(dict.fromkeys(r[4] for r in rows))}
    mask = np.array([numbers[r[4]] for r in mine])[:, None] != np.array([numbers[r[4]] for r in other])[None]
    place = {r[5]: k for k, r in enumerate(mine)}
    for k, r in enumerate(other):
        if r[5] in place:  # both are first rows somewhere: once, from the lesser
            mask[[p for c, p in place.items() if c >= r[5]], k] = False
    return mask


def _likely(percent: int) -> Callable:
    """Rows of blocks with (size, sign) to those that any pair needs whose sizes and signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            first = sum(r[3] == 0 for r in rows)
            if first in (0, len(rows)):
                continue
            mask = _apart(rows)
            sizes = np.array([r[6] for r in rows], np.float64)
            signs = np.frombuffer(b"".join(r[7] for r in rows), ">u2").astype(np.uint16).reshape(len(rows), -1)
            small, large = np.minimum(sizes[:first, None], sizes[None, first:]), np.maximum(sizes[:first, None], sizes[None, first:])
            mask &= 100 * small >= percent * large
            share = percent / 100
            least = share - DEVIATIONS * np.sqrt(share * (1 - share) / np.minimum(small, signs.shape[1]))
            for k in np.flatnonzero(mask.any(1)):
                mask[k] &= (signs[first:] == signs[k]).mean(1) >= least[k]
            if not mask.any():
                continue
            used = [r for r, u in zip(rows, np.concatenate([mask.any(1), mask.any(0)])) if u]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in used], t) for k, t in enumerate(_KINDS)], _NAMES)

    return run


def _confirmed(words: int, percent: int) -> Callable:
    """Rows of blocks with texts to ties (a, b): of each linked row to the least one of its group here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            first = sum(r[3] == 0 for r in rows)
            sets = exact_sets([r[6] for r in rows], words)
            mask = _apart(rows)
            if first == 1:
                both = np.array([[len(np.intersect1d(sets[0], s, True)) for s in sets[1:]]], np.float64)
            else:
                both = _shared(sets)[:first, first:]
            sizes = np.array([len(s) for s in sets], np.float64)
            mask &= 100 * both >= percent * (sizes[:first, None] + sizes[None, first:] - both)
            if not mask.any():
                continue
            linked = np.zeros((len(rows), len(rows)), bool)
            linked[:first, first:] = mask
            names = [r[5] for r in rows]
            for k, name in enumerate(names[first:], first):  # a class that is here twice is one
                if name in names[:first]:
                    linked[names.index(name), k] = True
            linked |= linked.T
            some = np.flatnonzero(linked.any(1))
            root = _roots(linked)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in some], pa.binary()), pa.array([names[root[k]] for k in some], pa.binary())], ["a", "b"]
            )

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "role", "class")


def _ties(blocks: DataFrame, read: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): the confirmed ties of blocks (node, i, j, role, comp, class)."""
    signed = blocks.join(classes.select("class", "size", "sign"), "class").select(*_NAMES, "size", "sign")
    likely = cut(_dealt(signed).mapInArrow(_likely(percent), _BLOCK))
    # each class's text comes from one of its documents, read again; texts without candidates are not joined
    chosen = classes.join(likely.select("class").distinct(), "class", "left_semi").select(
        "class", F.col("doc").alias("d2"), F.col("digest").alias("g2"))
    texts = read.join(chosen, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("digest") == F.col("g2"))).select("class", "text")
    # rows with one key and text are one document
    texts = texts.groupBy("class").agg(F.first("text").alias("text"))
    rows = likely.join(texts, "class").select(*_NAMES, "text")
    return cut(_dealt(rows).mapInArrow(_confirmed(words, percent), "a binary, b binary"))


def _pieces(n, shingles):
    """Blocks that so many rows with so many shingles need."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _members(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, hub, class, size) of the buckets with two classes or more."""
    width = 2 * rows
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.struct((b % STARS).alias("star"), F.xxhash64(b, F.substring("sign", b * width + 1, F.lit(width))).alias("key")),
    )
    placed = classes.where("sign is not null").select("class", "size", F.explode(keys).alias("k")).select("class", "size", "k.star", "k.key")
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = cut(placed.join(shared, "key"))
    hubs = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("star", "class").alias("o"), F.col("class").alias("hub"))).alias("h"))
    return members.join(hubs.select("key", "h.hub"), "key").select("key", "hub", "class", "size")


def _stars(members: DataFrame) -> DataFrame:
    """Blocks of a hub and some of those that share a bucket with it; each pair once for each hub."""
    edges = members.where("hub != class").groupBy("hub", "class").agg(F.first("size").alias("size"))
    hubs = edges.groupBy("hub").agg(F.count("*").alias("n"), F.sum("size").alias("s")).select("hub", _pieces(F.col("n"), F.col("s")).alias("p"))
    block = F.pmod(F.xxhash64("class"), F.col("p")).cast("int")
    spokes = edges.join(hubs, "hub").select("hub", block.alias("i"), F.lit(1).alias("role"), "class")
    centres = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), F.lit(0).alias("role"), F.col("hub").alias("class"))
    both = spokes.unionByName(centres)
    return both.select(F.col("hub").alias("node"), "i", F.lit(0).alias("j"), "role", F.col("class").alias("comp"), "class")


def _mixed(members: DataFrame, tied: DataFrame) -> DataFrame:
    """Blocks of buckets whose members are of several components: those outside its largest one (0) by all members (1).

    Buckets with the same members are compared once.
    """
    known = members.join(tied.withColumnsRenamed({"node": "class", "root": "comp"}), "class", "left").select(
        "key", "class", "size", F.coalesce("comp", "class").alias("comp"))
    counted = known.groupBy("key", "comp").agg(
        F.count("*").alias("n"), F.sum("size").alias("s"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("y"))
    buckets = counted.groupBy("key").agg(
        F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"),
        F.bit_xor("y").alias("y"), F.count("*").alias("comps"),
    ).where("comps > 1")
    buckets = buckets.groupBy("x", "y", "n", "s").agg(F.min(F.struct("key", "top")).alias("k")).select(
        "k.key", F.col("k.top.comp").alias("most"), F.col("n").alias("all"), "s", (F.col("n") - F.col("k.top.n")).alias("rest"))
    buckets = buckets.select(
        "key", "most", _pieces(F.col("all"), F.col("s")).alias("pj"),
        _pieces(F.col("rest"), F.lit(1.0) * F.col("s") / F.col("all") * F.col("rest")).alias("pi"))
    rows = known.join(buckets, "key")
    upto = lambda p: F.sequence(F.lit(0), F.col(p) - 1)
    at = lambda p: F.pmod(F.xxhash64("class"), F.col(p)).cast("int")
    node = F.encode(F.col("key").cast("string"), "utf-8").alias("node")
    rest = rows.where("comp != most").select(node, at("pi").alias("i"), F.explode(upto("pj")).alias("j"), F.lit(0).alias("role"), "comp", "class")
    others = rows.select(node, F.explode(upto("pi")).alias("i"), at("pj").alias("j"), F.lit(1).alias("role"), "comp", "class")
    return rest.unionByName(others)


def assign(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS,
    rows: int = ROWS, seed: int = SEED,
) -> DataFrame:
    """(doc, digest, n_shingles, component_id, kept) for each row of ``docs``: its key, the hash of its text, and what it is.

    Texts are linked if 100 * shared shingles >= ``percent`` * all shingles of both.
    ``component_id``: the least key reachable by links, the row's own included;
    ``kept``: the row has this key. A text without words (null, empty, blank) has no
    shingles and no links. A null key is never the least one; rows of a component
    without any key have no ``component_id`` and are all kept. Repeated rows are
    alike. An empty table stays empty. ``key`` has to be an integer.
    """
    read = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).cast("binary").alias("text"))
    met = cut(read.mapInArrow(_sketch(words, bands * rows, seed), "doc long, digest long, class binary, size long, sign binary"))
    # all rows of a class have one size and signature
    who = F.struct(F.col("doc").isNull().alias("absent"), "doc", "digest")
    classes = met.where("size > 0").groupBy("class").agg(F.min(who).alias("w"), F.max("size").alias("size"), F.first("sign").alias("sign"))
    classes = cut(classes.select("class", "w.doc", "w.digest", "size", "sign"))
    members = cut(_members(classes, bands, rows))
    ties = _ties(_stars(members), read, classes, words, percent)
    tied = cut(components(ties))
    more = _ties(_mixed(members, tied), read, classes, words, percent)
    if not more.isEmpty():
        whole = tied.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
        tied = cut(components(whole))
    named = classes.join(tied.withColumnRenamed("node", "class"), "class", "left").select("class", "doc", F.coalesce("root", "class").alias("root"))
    tops = named.groupBy("root").agg(F.min("doc").alias("top"))
    out = met.join(named.join(tops, "root").select("class", "top"), "class", "left")
    least = F.when(F.col("size") > 0, F.col("top")).otherwise(F.col("doc"))
    return out.select("doc", "digest", F.col("size").alias("n_shingles"), least.alias("component_id"), F.col("doc").eqNullSafe(least).alias("kept"))


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id`` and ``kept`` of ``assign`` (underscores put before names it has)."""
    names = fresh(docs, "_doc", "_digest", "n_shingles", "component_id", "kept", "_own")
    found = assign(docs, key, text, **options).distinct().toDF(*names[:5])
    at = F.col(key).cast("long").eqNullSafe(F.col(names[0])) & (F.col(names[5]) == F.col(names[1]))
    out = docs.withColumn(names[5], F.xxhash64(F.col(text))).join(found, at)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *names[2:5])
