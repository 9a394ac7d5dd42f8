"""Removal of repeated passages by content-defined chunks of lines.

A text is read as lines; a long line (a paragraph in one line) is folded at
sentence ends. A rolling hash over the hashes of the last two lines decides where
a chunk ends, so inserted or missing lines shift no boundary but those next to
them; both ends of a long line are boundaries too. Chunks of several lines that
occur more than once in the whole corpus are removed but for their first
occurrence, after their bytes have been compared.

A chunk boundary can fall anywhere in a repeated passage, so a partition into chunks
misses short passages and leaves the ends of long ones. Whole passages (``words``)
are runs of units, which end at line ends and sentence ends, and are found by
content-defined chunks as well: a chunk of some units begins at every unit, and of all
chunks inside the shortest run of so many words from a unit on, the one whose rolling
hash is least is that run's anchor. A run that occurs twice has the same anchor
twice, wherever it stands, so only runs of anchors that occur more than once are
looked at. Of every unit the shortest run that begins with it, and the shortest
that ends with it, are compared; any unit of a repeated run is in a repeated
shortest one: if it is not in the one that begins the run, the one that ends with the
unit lies inside the run. So their union is all repeated passages, to their last
unit. Repeated anchors of several units go too, as chunks do. Before anything goes, its
bytes are compared with those of its first occurrence, which are cut from that text and sent along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from pairlake.llm.common import WORD, fresh
from pairlake.session import cut, cuts, drop_cuts

#: A line with so many blanks is folded; a chunk has at least so many lines and so many blanks or line ends.
FOLD_BLANKS, MIN_LINES, MIN_BLANKS, ONE_IN = 40, 2, 9, 2
#: Words of a passage; words and units that an anchor has at least; the bases of the rolling hashes of anchors and of runs.
PASSAGE_WORDS, ANCHOR_WORDS, ANCHOR_UNITS, BASES = 50, 10, 2, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Rows handed to Spark at a time, and code points of the texts that are cut in units together.
BATCH_ROWS, GROUP_CHARS = 4096, 1 << 17
_SENTENCE = re.compile(r"[.!?]+\x20+")
_UNIT = re.compile(r"[.!?]+[\x20\x09-\x0D]+|[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*")
_WORD = re.compile(WORD)
_MASK = (1 << 64) - 1
_hash = xxhash.xxh3_64_intdigest


def _ends(before: int, now: int) -> bool:
    """The rolling hash of two line hashes, mixed, is one of ``ONE_IN`` that end a chunk."""
    rolled = (before * 0x9E3779B97F4A7C15 + now) & _MASK
    return ((rolled ^ (rolled >> 29)) * 0xBF58476D1CE4E5B9 & _MASK) >> 40 & (ONE_IN - 1) == 0


def _cut(text: str, units: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, lines) of the chunks of consecutive lines; a rest too short for a chunk joins the one before."""
    out, first, count, before = [], units[0][0], 0, 0
    for start, end in units:
        now = _hash(text[start:end].rstrip())
        count += 1
        if count >= MIN_LINES and _ends(before, now):
            out.append((first, end, count))
            first, count = end, 0
        before = now
    if count:
        if out and count < MIN_LINES:
            a, _, n = out.pop()
            out.append((a, units[-1][1], n + count))
        else:
            out.append((first, units[-1][1], count))
    return out


def chunks(text: str) -> list[tuple[int, int]]:
    """(start, end) of all chunks of several lines, in code points; what lies between them is never removed."""
    out: list[tuple[int, int]] = []
    short: list[tuple[int, int]] = []

    def flush() -> None:
        if short:
            for a, b, n in _cut(text, short):
                if n >= MIN_LINES and text.count(" ", a, b) + text.count("\n", a, b - 1) >= MIN_BLANKS:
                    out.append((a, b))
            short.clear()

    at, size = 0, len(text)
    while at < size:
        end = text.find("\n", at) + 1 or size
        if end - at <= FOLD_BLANKS or text.count(" ", at, end) < FOLD_BLANKS:
            short.append((at, end))
        else:
            flush()
            cuts = [m.end() for m in _SENTENCE.finditer(text, at, end)]
            if not cuts or cuts[-1] != end:
                cuts.append(end)
            if len(cuts) == 1:
                out.append((at, end))
            else:
                for a, b, n in _cut(text, list(zip([at, *cuts], cuts))):
                    if n >= MIN_LINES and text.count(" ", a, b) >= MIN_BLANKS:
                        out.append((a, b))
        at = end
    flush()
    return out


def units(text: str) -> list[int]:
    """Ends of all units, in code points; blanks behind a unit belong to it."""
    cuts = [m.end() for m in _UNIT.finditer(text)]
    return cuts if cuts and cuts[-1] == len(text) else [*cuts, len(text)]


class _Powers:
    """Powers of a base and of its inverse, as many as were needed so far."""

    def __init__(self, base: int):
        self.bases = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.known = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.known[0]) <= size:
            for k, base in enumerate(self.bases):
                old = self.known[k]
                self.known[k] = np.concatenate([old, old * (old[-1:] * base)])
        return self.known[0][: size + 1], self.known[1][: size + 1]


_POWERS = [_Powers(base) for base in BASES]


class _Units:
    """Texts as units, with rolling hashes of all runs: sums of hash x base ** place, times base ** -start, so that they do not hang on the place.

    The units of all texts are numbered together, with a number more at the end of each text, so a run is told by the
    numbers of its first unit and of what comes behind its last one. Places are those in a unit's own text.
    """

    def __init__(self, *texts: str):
        whole = " ".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts])
        behind = np.cumsum(sizes + 1) - 1
        front = behind - sizes
        # a blank before and behind the texts, so that runs of blanks begin and end inside
        blank = np.ones(len(codes) + 2, bool)
        blank[1:-1] = (codes == 32) | ((codes >= 9) & (codes <= 13))
        edges = np.flatnonzero(blank[1:] != blank[:-1])  # a word begins, ends, ..
        begin, end = edges[::2], edges[1::2]
        # runs of blanks, from the end of a word (or the start of a text) to the next one (or the end)
        start = np.sort(np.concatenate([front, end]), kind="stable")
        stop = np.sort(np.concatenate([begin, behind]), kind="stable")
        lines = np.flatnonzero(codes == 10)
        sign = codes[np.maximum(start, 1) - 1] if len(codes) else start
        # as ``units``: after a line end, and after a sign that ends a sentence
        cuts = np.searchsorted(lines, stop) > np.searchsorted(lines, start)
        cuts |= (start > 0) & ((sign == 33) | (sign == 46) | (sign == 63))
        cuts &= start < stop
        cuts[np.searchsorted(stop, behind)] = True
        ends = stop[cuts]
        upto = np.searchsorted(ends, behind, "right")  # units up to the end of each text
        heads = np.concatenate([[0], upto[:-1]])
        starts = np.concatenate([[0], ends[:-1]])
        starts[heads] = front
        self.size = len(ends)
        self.doc = np.repeat(np.arange(len(texts)), upto - heads)
        own = np.array([_hash(whole[a:b].rstrip()) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
        self.starts, self.ends = starts - front[self.doc], ends - front[self.doc]
        # by number: first and last of each text, words before each unit, text of each unit
        self.first, self.last = heads + np.arange(len(texts)), upto + np.arange(len(texts))
        self.number = np.arange(self.size) + self.doc
        self.text = np.repeat(np.arange(len(texts)), upto - heads + 1)
        self.words = np.empty(len(self.text), np.int64)
        self.words[self.first], self.words[self.number + 1] = np.searchsorted(begin, front), np.searchsorted(begin, ends)
        self.sums, self.inverse = [], []
        held = np.zeros(len(self.text), np.uint64)
        held[self.number] = own
        for k, base in enumerate(BASES):
            powers, inverse = _POWERS[k].upto(len(held))
            mixed = (held ^ (held >> np.uint64(31))) * np.uint64(base) if k else held
            self.inverse.append(inverse)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers[:-1], dtype=np.uint64)]))

    def hashes(self, k: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Mixed hashes of the runs of units first <= unit < last."""
        u = np.uint64
        h = (self.sums[k][last] - self.sums[k][first]) * self.inverse[k][first] + (last - first).astype(np.uint64)
        h = (h ^ (h >> u(30))) * u(0xBF58476D1CE4E5B9)
        return h ^ (h >> u(31))


class _Anchors:
    """Of the texts in ``found``: (first, last, anchor) of the shortest runs of units with ``words`` words, from and up to each
    unit, with the unit where each run's anchor begins; and the chunks that fit into their texts: (begin, stop, hash, how often its text has it).

    A text with fewer words has one anchor: a run without an own hash, from its first to its last unit (``short``).
    """

    def __init__(self, found: _Units, words: int):
        number, limit = found.number, found.last[found.doc]
        # lifted, so that no run reaches into the next text
        upto = found.words + found.text * max(words, ANCHOR_WORDS)
        own, after = upto[number], upto[number + 1]
        last = np.searchsorted(upto, own + words)  # units first <= k < last
        begin = np.searchsorted(upto, after - words, "right") - 1
        # an anchor is never longer than the run that begins with it
        stop = np.minimum(np.maximum(np.searchsorted(upto, own + ANCHOR_WORDS), number + ANCHOR_UNITS), last)
        few = found.words[found.last] - found.words[found.first] < words
        upper = np.zeros(len(upto), np.int64)
        upper[number] = last
        upper[found.first[few]] = found.last[few]
        wide, whole, back = len(upto) + 1, last <= limit, begin >= found.first[found.doc]
        pairs = np.unique(np.concatenate([
            number[whole] * wide + last[whole], begin[back] * wide + number[back] + 1, found.first[few] * wide + found.last[few]]))
        first, end = pairs // wide, pairs % wide
        fits = stop <= limit  # chunks that end inside the text; in a text they are the first ones, and ``stop`` ascends
        self.begin, self.stop = number[fits], stop[fits]
        self.hash = found.hashes(0, self.begin, self.stop)
        order = np.argsort(self.hash, kind="stable")
        rank = np.empty(len(order) + 1, np.int64)
        rank[order], rank[-1] = np.arange(len(order)), len(order)
        low, high = np.searchsorted(self.begin, first), np.searchsorted(self.stop, upper[first], "right")
        some = low < high
        least = np.minimum.reduceat(rank, np.stack([low[some], high[some]], 1).ravel())[::2]
        self.first, self.last, self.anchor = first[some], end[some], self.begin[order[least]]
        self.short = few[found.text[self.first]]
        text = found.text[self.begin]
        order = order[np.argsort(text[order], kind="stable")]
        cuts = np.flatnonzero(_changes([text[order], self.hash[order]]))
        counts = np.diff(np.append(cuts, len(order)))
        self.often = np.empty(len(order), np.int64)
        self.often[order] = np.repeat(counts, counts)


def _blobs(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """One binary per size, cut from ``data``."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def _anchor_rows(words: int, chunks_too: bool):
    """Rows (doc, digest, text) to one row per anchor of a text: how often the text has such a chunk, where it begins, the hashes of its runs, and their places (start, end).

    With ``chunks_too`` the anchor itself is the first of its runs, if it has several units. Texts are taken together,
    some ``GROUP_CHARS`` code points at a time.
    """

    def made(texts: list, docs: list, digests: list) -> pa.RecordBatch:
        found = _Units(*texts)
        met = _Anchors(found, words)
        at = np.unique(met.anchor)
        chunk = np.searchsorted(met.begin, at)
        stop = met.stop[chunk]
        # a text with fewer words has no run of so many
        first, last, anchor = met.first[~met.short], met.last[~met.short], met.anchor[~met.short]
        several = stop - at >= ANCHOR_UNITS if chunks_too else np.zeros(len(at), bool)
        first, last, owner = np.concatenate([at[several], first]), np.concatenate([stop[several], last]), np.concatenate([at[several], anchor])
        order = np.argsort(owner, kind="stable")
        first, last = first[order], last[order]
        unit = lambda number: number - found.text[number]
        places = np.stack([found.starts[unit(first)], found.ends[unit(last - 1)]], 1).astype(np.int32)
        counts = np.bincount(np.searchsorted(at, owner), minlength=len(at))
        back = pa.array(found.text[at])
        return pa.RecordBatch.from_arrays(
            [pa.array(met.hash[chunk].view(np.int64)), pa.array(met.often[chunk]), _blobs(counts * 8, found.hashes(1, first, last)),
             _blobs(counts * 8, places), pa.array(found.starts[unit(at)].astype(np.int32)),
             pa.array(docs, pa.int64()).take(back), pa.array(digests, pa.int64()).take(back)],
            ["anchor", "n", "runs", "places", "pos", "doc", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs, digests, size = [], [], [], 0
            for doc, digest, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                texts.append(value.as_py())
                docs.append(doc)
                digests.append(digest)
                size += len(texts[-1])
                if size >= GROUP_CHARS:
                    yield made(texts, docs, digests)
                    texts, docs, digests, size = [], [], [], 0
            if texts:
                yield made(texts, docs, digests)

    return run


def _each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, kind, runs, n, absent, doc, digest, places) to one row per run: (anchor, kind, nth, run, n, absent, doc, digest, at, end)."""
    for batch in batches:
        sizes = np.array([len(r) // 8 for r in batch.column(2).to_pylist()], np.int64)
        back = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        run = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
        places = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.int32).reshape(-1, 2)
        taken = [batch.column(c).take(back) for c in (0, 1, 3, 4, 5, 6)]
        yield pa.RecordBatch.from_arrays(
            [taken[0], taken[1], pa.array(nth.astype(np.int32)), pa.array(run), *taken[2:], pa.array(places[:, 0].copy()), pa.array(places[:, 1].copy())],
            ["anchor", "kind", "nth", "run", "n", "absent", "doc", "digest", "at", "end"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, digest, places, firsts) to the runs that are not the first of their kind, with the place of the first.

    (doc, digest, at, end) goes; it is from ``own`` on what stands in the text (fdoc, fdigest) from ``fat`` to ``fend``.
    All runs of a row hold its anchor, so those whose first ones stand in another text side by
    side are one place together. A first run in the same text stays whole where a later one overlaps it.
    """
    for batch in batches:
        ends, places = (np.frombuffer(b, np.int32) for b in batch.column(2).buffers()[1:3])
        skip = batch.column(2).offset
        ends, places = ends[skip : skip + batch.num_rows + 1], places.reshape(-1, 2)
        firsts = batch.column(3)
        upto = firsts.offsets.to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(upto))
        flat = firsts.flatten()
        nth, doc, digest, fat, fend = (flat.field(k) for k in range(5))
        at, end = places[ends[row] // 8 + nth.to_numpy()].T
        fat, fend = fat.to_numpy(), fend.to_numpy()
        plain = lambda c: (c.fill_null(0).to_numpy(), c.is_null().to_numpy(zero_copy_only=False))
        (d1, n1), (d2, n2) = plain(batch.column(0)), plain(doc)
        same = (d1[row] == d2) & (n1[row] == n2) & (batch.column(1).to_numpy()[row] == digest.to_numpy())
        # elsewhere: from the least to the greatest place of each row and text, if they lie alike there
        shift = at - fat
        alone = np.where(end - fend == shift, 0, np.arange(1, len(row) + 1))
        keys = [row, d2, n2, digest.to_numpy(), shift, alone]
        other = np.flatnonzero(~same)
        other = other[np.lexsort([k[other] for k in reversed(keys)])]
        cuts = np.flatnonzero(_changes([k[other] for k in keys]))
        ranges = [f.reduceat(x[other], cuts) if len(cuts) else x[:0] for f, x in ((np.minimum, at), (np.maximum, end), (np.minimum, fat), (np.maximum, fend))]
        # in the same text: behind the first
        mine = np.flatnonzero(same & (at != fat))
        begin = np.maximum(at, fend)[mine]
        left = begin < end[mine]
        mine, begin = mine[left], begin[left]
        from_ = pa.array(np.concatenate([other[cuts], mine]))
        back = pa.array(row).take(from_)
        joined = lambda x, y: pa.array(np.concatenate([x, y]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(back), batch.column(1).take(back), joined(ranges[0], begin), joined(ranges[1], end[mine]), joined(ranges[0], at[mine]),
             doc.take(from_), digest.take(from_), joined(ranges[2], fat[mine]), joined(ranges[3], fend[mine])], [n for n, _ in _CLAIM])


#: What ``_later`` says of a place.
_CLAIM = [("doc", "long"), ("digest", "long"), ("at", "int"), ("end", "int"), ("own", "int"), ("fdoc", "long"), ("fdigest", "long"), ("fat", "int"), ("fend", "int")]


def _changes(keys: list[np.ndarray]) -> np.ndarray:
    """Where in sorted rows one of the keys differs from that of the row before; the first row differs."""
    changed = np.zeros(len(keys[0]), bool)
    changed[:1] = True
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    return changed


def _repeated_runs(read: DataFrame, words: int, chunks_too: bool = False) -> DataFrame:
    """``_CLAIM`` of what goes: all runs of ``words`` words but the first of their kind, and with ``chunks_too`` all such anchors.

    A run is known by the hash of its anchor and its own, 128 bits together.
    Occurrences of an anchor with the same runs around it are one kind: their
    first one is found by partial aggregation, and runs are compared by kinds, so a
    passage in very many texts meets no task whole.
    """
    # written once: read for the counts, and for the rows of repeated anchors
    found = cut(read.mapInArrow(
        _anchor_rows(words, chunks_too), "anchor long, n long, runs binary, places binary, pos int, doc long, digest long"))
    used = cuts(read.sparkSession)[-1:]
    often = found.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    rows = cut(found.drop("n").where("length(runs) > 0").join(often, "anchor", "left_semi").withColumn("kind", F.xxhash64("runs")))
    drop_cuts(read.sparkSession, used)  # all that is needed of it is in ``rows``
    place = F.struct(F.col("doc").isNull().alias("absent"), "doc", "digest", "pos", "places")
    kinds = rows.groupBy("anchor", "kind", "runs").agg(F.count("*").alias("n"), F.min(place).alias("p"))
    each = kinds.select("anchor", "kind", "runs", "n", "p.absent", "p.doc", "p.digest", "p.places").mapInArrow(
        _each_run, "anchor long, kind long, nth int, run long, n long, absent boolean, doc long, digest long, at int, end int")
    each = cut(each)
    firsts = each.groupBy("anchor", "run").agg(F.sum("n").alias("n"), F.min(F.struct("absent", "doc", "digest", "at", "end")).alias("f"))
    known = each.select("anchor", "run", "kind", "nth").join(firsts.where("n > 1"), ["anchor", "run"])
    # as many as an anchor has runs
    known = known.groupBy("anchor", "kind").agg(F.collect_list(F.struct("nth", "f.doc", "f.digest", "f.at", "f.end")).alias("firsts"))
    met = rows.join(known, ["anchor", "kind"]).select("doc", "digest", "places", "firsts")
    return met.mapInArrow(_later, ", ".join(f"{n} {kind}" for n, kind in _CLAIM))


def _listed(with_text: bool):
    """Rows (doc, digest, text) to one row per chunk."""
    kinds = [("hash", pa.int64()), ("size", pa.int32()), ("doc", pa.int64()), ("digest", pa.int64()), ("at", pa.int32())]
    kinds.append(("part", pa.string()) if with_text else ("end", pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in kinds]

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])
            for c in columns:
                c.clear()
            return made

        for batch in batches:
            for doc, digest, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = value.as_py()
                for a, b in chunks(text):
                    part = text[a:b].rstrip()
                    key = _hash(part)
                    row = (key - (1 << 64) if key >> 63 else key, len(part), doc, digest, a, part if with_text else b)
                    for c, v in zip(columns, row):
                        c.append(v)
                    if len(columns[0]) >= BATCH_ROWS:
                        yield batch_of()
        if columns[0]:
            yield batch_of()

    return run


_TYPES = "hash long, size int, doc long, digest long, at int, "


_PLACES = "array<struct<at: int, end: int, own: int, fat: int, fend: int>>"


def _chained(claims: Column) -> Column:
    """Places of a text (at, end, own, fat, fend) that overlap or touch, and lie alike in the text of the first ones, as one."""

    @F.arrow_udf(_PLACES)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in parts:
            row = np.repeat(np.arange(len(batch)), batch.value_lengths().fill_null(0).to_numpy())
            at, end, own, fat, fend = (batch.flatten().field(k).to_numpy().astype(np.int64) for k in range(5))
            alone = np.where((at == own) & (end - fend == own - fat), 0, np.arange(1, len(row) + 1))
            order = np.lexsort((own, own - fat, alone, row))
            row, at, end, own, fat, fend, alone = (x[order] for x in (row, at, end, own, fat, fend, alone))
            changed = _changes([row, alone, own - fat])
            lift = np.cumsum(changed) << 32  # each group's places lie behind those of the one before it
            reach = np.maximum.accumulate(end + lift)
            changed[1:] |= (own + lift)[1:] > reach[:-1]
            first = np.flatnonzero(changed)
            last = np.append(first[1:], len(at))[: len(first)] - 1
            stop = (reach - lift)[last]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(batch)))]).astype(np.int32)
            columns = [at[first], stop, own[first], fat[first], np.where(alone[first] > 0, fend[first], fat[first] + stop - own[first])]
            inner = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], ["at", "end", "own", "fat", "fend"])
            yield pa.ListArray.from_arrays(pa.array(ends), inner)

    return run(claims)


def _without(text: Column, gaps: Column) -> Column:
    """The text without the places (at, end) in ``gaps``."""

    @F.arrow_udf("string")
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, removed in pairs:
            out = []
            for value, places in zip(texts, removed):
                whole = value.as_py()
                if whole is None or not places.is_valid:
                    out.append(None)
                    continue
                kept, upto = [], 0
                for place in sorted((p["at"], p["end"]) for p in places.as_py()):
                    kept.append(whole[upto : place[0]])
                    upto = place[1]
                out.append("".join(kept) + whole[upto:])
            yield pa.array(out, pa.string())

    return run(text, gaps)


def _packed(text: Column) -> Column:
    """Texts compressed, as they travel to their gaps."""

    @F.arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(1)
        for batch in parts:
            yield pa.array([None if v is None else press.compress(v) for v in batch.cast(pa.binary()).to_pylist()], pa.binary())

    return run(text)


def _cited(packed: Column, claims: Column) -> Column:
    """What stands at the first places (fat, fend) of a packed text, one behind the other, packed."""

    @F.arrow_udf("binary")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        press, back = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
        for texts, places in parts:
            out = []
            for value, found in zip(texts, places):
                whole = back.decompress(value.as_py()).decode()
                out.append(press.compress("".join(whole[p["fat"] : p["fend"]] for p in found.as_py()).encode()))
            yield pa.array(out, pa.binary())

    return run(packed, claims)


def alike(a: str, b: str) -> bool:
    """Whether two runs have the same bytes, blanks behind units left aside."""
    parts = lambda text, ends: [text[x:y].rstrip() for x, y in zip([0, *ends], ends)]
    return a == b or parts(a, units(a)) == parts(b, units(b))


def _verified(whole: str, cited: list[dict], unpack) -> list[tuple[int, int]]:
    """The places (at, end) whose bytes are those of their first ones, in order; what overlaps or touches is one."""
    kept = []
    for one in cited:
        theirs, upto = unpack(one["blob"]).decode(), 0
        for p in one["claims"]:
            size = p["fend"] - p["fat"]
            if alike(whole[p["own"] : p["end"]], theirs[upto : upto + size]):
                kept.append((p["at"], p["end"]))
            upto += size
    out: list[tuple[int, int]] = []
    for at, end in sorted(kept):
        if out and at <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((at, end))
    return out


def _unpacked_less(packed: Column, cited: Column) -> Column:
    """struct(text, removed): the texts without the verified places of ``cited``; whole where it is null."""

    @F.arrow_udf("text string, removed array<struct<at: int, end: int>>")
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        unpack = zstandard.ZstdDecompressor().decompress
        place = pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32())]))
        for texts, found in pairs:
            out, removed = [], []
            for value, here in zip(texts, found):
                whole = unpack(value.as_py()).decode() if value.is_valid else None
                places = _verified(whole, here.as_py(), unpack) if whole is not None and here.is_valid else []
                if places:
                    edges = [0, *(x for p in places for x in p), len(whole)]
                    whole = "".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append(whole)
                removed.append([{"at": a, "end": b} for a, b in places])
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(removed, place)], ["text", "removed"])

    return run(packed, cited)


def cited_places(read: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, digest, cited): the places that are to go from each text, by the text of their first ones, with what stands there."""
    claims = found.groupBy("doc", "digest", "fdoc", "fdigest").agg(_chained(F.collect_set(F.struct("at", "end", "own", "fat", "fend"))).alias("claims"))
    texts = read.select(F.col("doc").alias("_k"), F.col("digest").alias("_d"), _packed(F.col("text")).alias("_packed"))
    met = claims.join(texts, F.col("fdoc").eqNullSafe(F.col("_k")) & (F.col("fdigest") == F.col("_d")))
    met = met.select("doc", "digest", F.struct("claims", _cited(F.col("_packed"), F.col("claims")).alias("blob")).alias("c"))
    # a set, as rows that repeat in key and text cite alike
    return met.groupBy("doc", "digest").agg(F.collect_set("c").alias("cited"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and ``removed``: array<struct<at, end>> of their places before.

    The first occurrence of a chunk, by key (null last), digest of the text and
    place, stays; all later ones go, in other texts and in the same one. Chunks
    equal in hash and length whose bytes differ stay. One row for each row given:
    a text may become empty, no row goes. Rows that repeat in key and text are one
    document and are changed alike (so they do not take each other's chunks).
    Null and empty texts stay as they are; other columns pass through; an empty
    table stays empty. ``key`` has to be an integer.

    ``words``: if given, all repeated passages of so many words go, whole, and all repeated
    anchors of several units, by the same order; ``removed`` then has merged places.
    Runs are found by 128 bits of hash; each is then compared with its first occurrence by its
    bytes, blanks behind units left aside, and stays if they differ. So what goes always has such a copy at an earlier place.

    Chunks are counted by partial aggregation, so a passage in a third of all texts
    meets no task whole, and the repeated ones are joined by a shuffle that can
    split large partitions.
    """
    digest, gaps, d2, k2, removed = fresh(docs, "_digest", "_gaps", "_digest2", "_key2", "removed")
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(digest, F.xxhash64(F.col(text)))
    read = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias("text"))
    read = read.where("text is not null and text != ''")
    place = F.struct(F.col("doc").isNull().alias("absent"), "doc", "digest", "at")
    nothing = F.array().cast("array<struct<at: int, end: int>>")
    if words is not None:
        found = _repeated_runs(read, words, chunks_too=True)
        taken = cited_places(read, found).select(F.col("doc").alias(k2), F.col("digest").alias(d2), F.col("cited").alias(gaps))
        held = keyed.withColumn(text, _packed(F.col(text)))
        out = held.join(taken, F.col(key).cast("long").eqNullSafe(F.col(k2)) & (F.col(digest) == F.col(d2)), "left")
        out = out.withColumn(gaps, _unpacked_less(F.col(text), F.col(gaps)))
        return out.select(*[F.col(gaps)["text"].alias(text) if c == text else o for c, o in zip(docs.columns, own)], F.col(gaps)["removed"].alias(removed))
    # least and largest bytes of all chunks of one hash: equal only if all are
    known = read.mapInArrow(_listed(True), _TYPES + "part string").groupBy("hash", "size").agg(
        F.count("*").alias("n"), F.min(place).alias("first"), F.min("part").alias("least"), F.max("part").alias("most")
    )
    known = known.where("n > 1 and least = most").select("hash", "size", "first")
    found = read.mapInArrow(_listed(False), _TYPES + "end int").join(known, ["hash", "size"]).where(place != F.col("first"))
    taken = found.groupBy(F.col("doc").alias(k2), F.col("digest").alias(d2)).agg(F.collect_set(F.struct("at", "end")).alias(gaps))
    out = keyed.join(taken, F.col(key).cast("long").eqNullSafe(F.col(k2)) & (F.col(digest) == F.col(d2)), "left")
    less = _without(F.when(F.col(gaps).isNotNull(), F.col(text)), F.col(gaps))
    shown = [F.coalesce(less, F.col(text)).alias(text) if c == text else o for c, o in zip(docs.columns, own)]
    return out.select(*shown, F.coalesce(F.col(gaps), nothing).alias(removed))
