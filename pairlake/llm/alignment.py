"""Alignment of the tokens of two tokenizers by byte offsets.

Every text is encoded by both. The byte lengths of the tokens, summed up, give
where each token ends; a dictionary from end to index is made for each side. The
keys that both dictionaries have are the ends that both agree on: sorted, they
cut both lists of ids into groups that cover the same bytes. Inside each group
the tokens that end with it are linked, every one of A with every one of B.

No token of either side crosses the blank before a word, so both sides end where a
word does. A text is taken apart there; parts that are new are joined by their blanks,
encoded and aligned together, and what each of them has is remembered. The groups of
a text are those of its parts. The memory of a task is bounded.

Over the corpus the links of two ids are counted. A link says that one token's
bytes are the tail of the other's, so there are at most as many different pairs
as the two vocabularies have tails of each other (``most_pairs``, 0.2 million for
the two used here), whatever the corpus: the counts can be broadcast.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairlake.llm.common import fresh
from pairlake.llm.pieces import BLANK, read_model

#: Files of the two public tokenizers.
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Parts of texts that a task remembers; characters whose new parts are aligned at a time.
REMEMBERED, STEP_CHARS = 400_000, 1 << 20
#: A part that joins others by a blank without changing how they are encoded; characters of one such text.
_SAFE = re.compile(r"(?![\s▁]).*[^\s]", re.DOTALL)
JOINED_CHARS = 1 << 16
#: A place that no token of either side crosses: before a blank between two other characters. Whether a text has other blanks.
_CUT = re.compile(r"(?<=[^\s])\x20(?=[^\s▁])")
_PLAIN = re.compile(r"\x20")
_ODD = re.compile(r"\s\x20|\x20(?:[\s▁]|\Z)")
FIELDS = {
    "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "links": pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])),
    "a_ids": pa.list_(pa.int32()), "b_ids": pa.list_(pa.int32()), "a_sizes": pa.list_(pa.int32()), "b_sizes": pa.list_(pa.int32()),
}
DETAILS = ("a_ids", "b_ids", "a_sizes", "b_sizes")
_SQL = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string",
        "links": "array<struct<a: int, b: int, n: int>>", "a_ids": "array<int>", "b_ids": "array<int>", "a_sizes": "array<int>",
        "b_sizes": "array<int>"}


def parts(text: str) -> list[str]:
    """``text``, which begins with a blank, in parts that can be encoded apart, each without the blank that it begins with."""
    return (_CUT if _ODD.search(text) else _PLAIN).split(text[1:])


class ByteSide:
    """A byte-level BPE file of the tokenizers library; a text is encoded with a space before it."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(data.decode())
        self.model.encode_special_tokens = True
        # the byte-level rule: printable characters of Latin-1 stand for themselves, the other bytes follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(c in back for c in token)
            self.bytes[i] = bytes(back[c] for c in token) if known else token.encode()

    def encode(self, some: list[str]) -> list[list[int]]:
        """Ids of each blank+part."""
        return [e.ids for e in self.model.encode_batch_fast([f" {p}" for p in some], add_special_tokens=False)]


class PieceSide:
    """A SentencePiece file; the model puts the space before a text."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = known = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = []
        for i in range(known.get_piece_size()):
            piece = known.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if known.is_byte(i) else piece.replace(BLANK, " ").encode())
            if BLANK in piece.lstrip(BLANK):
                raise ValueError("the model has pieces across words")

    def encode(self, some: list[str]) -> list[list[int]]:
        """Ids of each blank+part; the model puts the blank there itself."""
        return self.model.encode(some, num_threads=1)


def groups(a_sizes: list[int], b_sizes: list[int]) -> list[tuple[int, int]]:
    """(tokens of A, tokens of B) up to each end that both sides have, from the byte lengths of their tokens.

    Of tokens without bytes at an end, the last one counts as the end.
    """
    a_ends = dict(zip(accumulate(a_sizes), range(1, len(a_sizes) + 1)))
    b_ends = dict(zip(accumulate(b_sizes), range(1, len(b_sizes) + 1)))
    common = sorted(a_ends.keys() & b_ends.keys())
    return list(zip(map(a_ends.__getitem__, common), map(b_ends.__getitem__, common)))


def tails(sizes: list[int], first: int, stop: int) -> int:
    """How many tokens end where the slice ends: the last one, and those before it that only tokens without bytes follow."""
    at = stop - 1
    while at > first and sizes[at] == 0:
        at -= 1
    return stop - at


class Side:
    """What alignment needs of a vocabulary, per id."""

    def __init__(self, data: list[bytes]):
        self.bytes, self.sizes, self.shown = data, list(map(len, data)), list(map(str, range(len(data))))
        self.lengths = np.array(self.sizes)


def linked(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int], cuts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The links of the tokens that end with each group, as a << 32 | b, and where each group's links stop."""
    i, j = np.array(cuts, np.int64).reshape(-1, 2).T
    if 0 not in a_sizes and 0 not in b_sizes:
        return (np.array(a, np.int64)[i - 1] << 32) | np.array(b, np.int64)[j - 1], np.arange(1, len(cuts) + 1)
    out, stops, i0, j0 = [], [], 0, 0
    for i, j in cuts:
        ends = a[i - tails(a_sizes, i0, i) : i], b[j - tails(b_sizes, j0, j) : j]
        out += [x << 32 | y for x in ends[0] for y in ends[1]]
        stops.append(len(out))
        i0, j0 = i, j
    return np.array(out, np.int64), np.array(stops, np.int64)


def written(a: list[int], b: list[int], cuts: list[tuple[int, int]], sides: tuple[Side, Side]) -> list[str]:
    """Each group as a1,a2|b1."""
    x, y = (list(map(s.shown.__getitem__, ids)) for s, ids in zip(sides, (a, b)))
    out, i0, j0 = [], 0, 0
    for i, j in cuts:
        out.append(f"{x[i0] if i == i0 + 1 else ','.join(x[i0:i])}|{y[j0] if j == j0 + 1 else ','.join(y[j0:j])}")
        i0, j0 = i, j
    return out


#: What is known of a part: whether its bytes are those of the tokens on both sides, tokens, tokens, groups, the groups written out, the
#: links as bytes of 64-bit numbers, and, if asked for, ids and sizes of the groups on both sides.
Known = tuple[bool, int, int, int, str, bytes, tuple]
UNFIT: Known = (False, 0, 0, 0, "", b"", ((), (), (), ()))


def align_parts(found: list[str], sides: tuple, known: tuple[Side, Side], details: bool) -> list[Known]:
    """What is known of each of some parts, joined to one text by the blanks that they begin with."""
    whole = " ".join(found)
    a, b = (s.encode([whole])[0] for s in sides)
    data = f" {whole}".encode("utf-8", "surrogatepass")
    sizes = [list(map(k.sizes.__getitem__, ids)) for k, ids in zip(known, (a, b))]
    if all([b"".join(map(k.bytes.__getitem__, ids)) == data for k, ids in zip(known, (a, b))]):
        cuts = groups(*sizes)
        ends = np.cumsum(sizes[0])[[i - 1 for i, _ in cuts]]
        goals = np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in found])
        stops = np.searchsorted(ends, goals)
        if stops[-1] < len(ends) and (ends[stops] == goals).all():
            (links, upto), shown = linked(a, b, *sizes, cuts), written(a, b, cuts, known)
            data, upto = links.tobytes(), (upto * 8).tolist()
            out, last, i0, j0, p0 = [], 0, 0, 0, 0
            for stop in (stops + 1).tolist():
                i, j = cuts[stop - 1]
                p = upto[stop - 1]
                detail = ()
                if details:
                    some = cuts[last:stop]
                    detail = (a[i0:i], b[j0:j], np.diff([i0, *[x for x, _ in some]]).tolist(), np.diff([j0, *[y for _, y in some]]).tolist())
                out.append((True, i - i0, j - j0, stop - last, ";".join(shown[last:stop]), data[p0:p], detail))
                last, i0, j0, p0 = stop, i, j, p
            return out
    # some part's bytes are not those of its tokens
    return [UNFIT] if len(found) == 1 else [known_of for p in found for known_of in align_parts([p], sides, known, details)]


class Parts(dict):
    """What is known of parts, as many as there is room for; the usual ones come before it is full."""

    def __init__(self, sides: tuple, most: int = REMEMBERED, details: bool = False):
        super().__init__()
        self.sides, self.most, self.details = sides, most, details
        self.known = tuple(Side(s.bytes) for s in sides)
        self.once: dict[str, Known] = {}  # those of the texts at hand that are not remembered

    def learn(self, texts: list[list[str]]) -> None:
        """Aligns the new parts of some texts together."""
        seen: set[str] = set()
        for found in texts:
            seen.update(found)
        new = [p for p in seen if p not in self]
        tables, size = [], JOINED_CHARS
        for part in new:
            if not _SAFE.fullmatch(part):
                tables.insert(0, [part])
                continue
            if size >= JOINED_CHARS:
                tables.append([])
                size = 0
            tables[-1].append(part)
            size += len(part) + 1
        made = [(p, k) for table in tables for p, k in zip(table, align_parts(table, self.sides, self.known, self.details))]
        room = max(self.most - len(self), 0)
        self.update(made[:room])
        self.once = dict(made[room:])

    def __missing__(self, part: str) -> Known:
        return self.once[part]


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can ever be linked: one's bytes are a tail of the other's."""
    often = Counter(b)
    found = sum(often[x[k:]] for x in a for k in range(len(x) + 1))
    often = Counter(a)
    return found + sum(often[y[k:]] for y in b for k in range(1, len(y) + 1))  # equal ones counted above


def _column(wanted: tuple[str, ...], texts: list[list[Known]]) -> pa.StructArray:
    """The fields of texts from what is known of their parts; none of a text with a part that is unfit."""
    texts = [each if all([k[0] for k in each]) else [] for each in texts]
    columns = []
    for name in wanted:
        if name == "links":
            flat = [np.unique(np.frombuffer(b"".join([k[5] for k in each]), np.int64), return_counts=True) for each in texts]
            pairs, often = (np.concatenate([np.zeros(0, np.int64), *[f[n] for f in flat]]) for n in (0, 1))
            ends = np.cumsum([0, *[len(f[0]) for f in flat]]).astype(np.int32)
            inner = [pa.array(x.astype(np.int32)) for x in (pairs >> 32, pairs & 0xFFFFFFFF, often)]
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(inner, ["a", "b", "n"])))
            continue
        if name in DETAILS:
            at = DETAILS.index(name)
            values = [[x for k in each for x in k[6][at]] for each in texts]
        elif name == "groups_sha256":
            values = [hashlib.sha256(";".join([k[4] for k in each]).encode()).hexdigest() if each else "" for each in texts]
        elif name == "n_links":
            values = [sum([len(k[5]) for k in each]) // 8 for each in texts]
        else:
            at = ("n_a", "n_b", "n_groups").index(name) + 1
            values = [sum([k[at] for k in each]) for each in texts]
        columns.append(pa.array(values, FIELDS[name]))
    return pa.StructArray.from_arrays(columns, list(wanted))


def align(
    docs: DataFrame, text: str = "text", a: str = BYTE_MODEL, b: str = PIECE_MODEL, wanted: tuple[str, ...] = tuple(FIELDS),
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``docs`` with the struct ``aligned`` of the fields ``wanted``.

    ``a_ids``, ``b_ids``: the tokens of space+text; ``a_sizes``, ``b_sizes``: how many
    of them each group holds; ``links``: how often each pair of ids is linked here;
    ``n_a``, ``n_b``, ``n_groups``, ``n_links``; ``groups_sha256`` of the groups written out.

    Null and empty texts have no tokens, nor has a text that the bytes of either
    side's tokens do not give (a blank sign in the text becomes a space in B): counts
    of 0, empty lists, and '' as the digest. Special tokens' strings are plain text.
    ``remembered``: parts of texts that a task keeps. One row for each row given, repeated ones alike; other columns and an empty table pass through;
    where ``aligned`` is taken, underscores are put before. No shuffle.
    """
    spark = docs.sparkSession
    name = fresh(docs, "aligned")[0]
    data = [spark.sparkContext.broadcast(read_model(spark, p)) for p in (a, b)]

    @F.arrow_udf(", ".join(f"{f}: {_SQL[f]}" for f in wanted))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Parts((ByteSide(data[0].value), PieceSide(data[1].value)), remembered, bool(set(DETAILS) & set(wanted)))
        for batch in batches:
            made, held, size = [], [], 0
            for k, value in enumerate(batch):
                whole = value.as_py() or ""
                held.append(parts(f" {whole}") if whole else [])
                size += len(whole)
                if size >= STEP_CHARS or k == len(batch) - 1:
                    known.learn(held)
                    made.append(_column(wanted, [list(map(known.__getitem__, found)) for found in held]))
                    held, size = [], 0
            yield pa.concat_arrays(made) if made else _column(wanted, [])

    # so called to keep the optimiser from computing it once per field
    return docs.withColumn(name, run.asNondeterministic()(F.col(text)))


def pair_counts(links: Column, rows: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold each pair over all rows, and whether no other pair of b has more.

    At most ``most_pairs`` rows; counted by partial aggregation.
    """
    each = rows.select(F.explode(links).alias("l")).groupBy("l.a", "l.b").agg(F.sum("l.n").cast("long").alias("count"))
    top = each.groupBy("b").agg(F.max("count").alias("most"))
    return each.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def strength(links: Column, counts: DataFrame) -> Column:
    """struct<n_best, count_sum> of the links of a row: those whose count is their B id's highest, and the sum of all counts.

    The counts go to all tasks; there are at most ``most_pairs`` of them. Links that ``counts`` does not have count 0.
    """
    table = counts.select("a", "b", "count", "best").toArrow()
    keys = (table["a"].to_numpy().astype(np.int64) << 32) | table["b"].to_numpy()
    order = np.argsort(keys)
    sent = counts.sparkSession.sparkContext.broadcast(
        (keys[order], table["count"].to_numpy()[order], table["best"].to_numpy(zero_copy_only=False)[order]))

    @F.arrow_udf("n_best: bigint, count_sum: bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys, each, best = sent.value
        for batch in batches:
            ends = batch.offsets.to_numpy()
            flat = batch.values
            a, b, n = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            wanted = (a << 32) | b
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            known = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
            counted = np.where(known, each[at] if len(keys) else 0, 0)
            first = np.where(known & (best[at] if len(keys) else False), n, 0)
            total = lambda v: np.concatenate([[0], np.cumsum(v)])
            sums = [pa.array((total(v)[ends[1:]] - total(v)[ends[:-1]]).astype(np.int64)) for v in (first, n * counted)]
            yield pa.StructArray.from_arrays(sums, ["n_best", "count_sum"])

    return run(links)
