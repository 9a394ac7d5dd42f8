"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merge-type (BPE) models: a text's characters are merged, the best-scored pair
first (from an agenda), and each candidate merge is skipped if a keyed hash of
the seed, the document, the word, the place and the merged piece says so. So one
seed always gives one segmentation of a document, other seeds and documents give
others, and all of them decode to the text, character by character. Without
dropout the segmentation is the model's own.

Pieces never cross a blank before a word, so words are encoded apart. A word's merges
without dropout are remembered. In a document they are tested, in their order, by
the keyed hash: if it skips none of them, the agenda would take just these, and the
remembered pieces are the word's; only words with a skipped merge go through the
agenda. The memory of a task is bounded.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairlake.llm.common import fresh

#: The file of the public merge-type model, and the sign that stands for a blank in pieces.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
DROPOUT, SEED, REMEMBERED = 0.1, 42, 200_000
#: Behind all merges; the longest word that is merged in a table; words and characters handled at a time.
NEVER, SHORT, TABLE_WORDS, STEP_CHARS = (1 << 31) - 1, 40, 4_000, 500_000
MASK = (1 << 64) - 1
#: A word with the blanks before it, blanks alone, a line end, or the blank sign itself.
_WORDS = re.compile(f" *[^ \n{BLANK}]+| +|\n|{BLANK}")


def skips(own, place, piece, limit):
    """Whether the candidate merge to ``piece`` at ``place`` of a word is skipped: a mixed hash below ``limit``.

    ``_skips_all`` is the same for arrays.
    """
    mixed = (own ^ ((place + 1) * 0x9E3779B97F4A7C15 & MASK) ^ (piece * 0xC2B2AE3D27D4EB4F & MASK)) & MASK
    mixed = ((mixed ^ (mixed >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    mixed = ((mixed ^ (mixed >> 27)) * 0x94D049BB133111EB) & MASK
    return (mixed ^ (mixed >> 31)) < limit


def _salts(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """What a candidate merge adds to the hash of its word."""
    u = np.uint64
    return ((place.astype(u) + u(1)) * u(0x9E3779B97F4A7C15)) ^ (piece.astype(u) * u(0xC2B2AE3D27D4EB4F))


def _skips_all(own: np.ndarray, salts: np.ndarray, limit: int) -> np.ndarray:
    u = np.uint64
    mixed = own ^ salts
    mixed = (mixed ^ (mixed >> u(30))) * u(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> u(27))) * u(0x94D049BB133111EB)
    return (mixed ^ (mixed >> u(31))) < u(limit)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of starts[k], starts[k] + 1, .. (counts[k] of them) for each k, in one array."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Model:
    """Pieces and scores of a merge-type model with byte fallback."""

    def __init__(self, data: bytes):
        import sentencepiece

        known = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.ids, self.shown = {}, []
        scores = {}
        self.bytes = [-1] * 256
        for i in range(known.get_piece_size()):
            piece = known.id_to_piece(i)
            if known.is_byte(i):
                byte = int(piece[3:5], 16)
                self.bytes[byte] = i
                # a byte below 128 is a character by itself
                self.shown.append(chr(byte) if byte < 128 else byte)
            elif known.is_control(i) or known.is_unknown(i) or known.is_unused(i):
                self.shown.append("")
            else:
                self.ids[piece] = i
                scores[piece] = known.get_score(i)
                self.shown.append(piece.replace(BLANK, " "))
        # the place of each merge, best first; equal scores share one
        places = {s: n for n, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: places[s] for piece, s in scores.items()}
        if min(self.bytes) < 0:
            raise ValueError("the model has no piece for every byte, so not every text can be decoded")
        if any("\n" in p or " " in p or BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("the model has pieces across words")
        self._pairs()

    def _pairs(self) -> None:
        """All ways to merge two symbols, as a sorted table. Symbols are piece ids, or numbers behind them for other characters."""
        self.symbols = dict(self.ids)
        for piece in self.ids:
            for char in piece:
                self.symbols.setdefault(char, len(self.shown) + len(self.symbols))
        self.width = max(self.symbols.values()) + 1
        found = {}
        for piece, made in self.ids.items():
            for at in range(1, len(piece)):
                left, right = self.symbols.get(piece[:at]), self.symbols.get(piece[at:])
                if left is not None and right is not None:
                    found[left * self.width + right] = made
        self.pairs = np.array(sorted(found), np.int64)
        self.made = np.array([found[k] for k in self.pairs.tolist()], np.int32)
        self.places = np.full(len(self.shown), NEVER, np.int32)
        for piece, i in self.ids.items():
            self.places[i] = self.ranks[piece]

    def _join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, place) of each pair of symbols; (0, NEVER) where they make none."""
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        known = (self.pairs[at] == keys) & (left >= 0) & (right >= 0)
        made = np.where(known, self.made[at], 0)
        return made, np.where(known, self.places[made], NEVER)

    def words(self, words: list[str], dropout: float, key: int | list[int]) -> list[bytes]:
        """Ids of many short words, as bytes of 32-bit numbers. ``key``: of all words, or of each."""
        keys = [key] * len(words) if isinstance(key, int) else key
        own = np.array(list(map(xxhash.xxh3_64_intdigest, words, keys)), np.uint64)
        ids, counts = self.agendas(words, own, min(int(dropout * (1 << 64)), MASK))
        ends = np.cumsum(counts).tolist()
        return [ids[b - c : b].tobytes() for b, c in zip(ends, counts.tolist())]

    def merges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many of each word, salts of the merges in their order, how many of each word) of short words without dropout."""
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        ids, counts = self.agendas(words, np.zeros(len(words), np.uint64), 0, taken)
        rows = np.concatenate([np.zeros(0, np.int64), *[r for r, _ in taken]])
        salts = np.concatenate([np.zeros(0, np.uint64), *[s for _, s in taken]])
        return ids, counts, salts[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(words))

    def agendas(self, words: list[str], own: np.ndarray, limit: int, taken: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word) of words by their hashes; the agendas of all words advance together.

        A word's agenda is a row of places; each round takes the first best of every row, and merges or skips it.
        The merges are listed in ``taken``, as (row, salt).
        """
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, where = np.unique(codes, return_inverse=True)
        chars = [chr(c) for c in kinds]
        # characters that no piece has get numbers below 0
        numbers = np.array([self.symbols.get(c, -1 - k) for k, c in enumerate(chars)], np.int64)
        n, wide = len(words), int(sizes.max())
        row = np.repeat(np.arange(n), sizes)
        column = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbol = np.full((n, wide + 1), -(1 << 30), np.int32)
        symbol[row, column] = numbers[where]
        alive = np.zeros((n, wide + 1), bool)
        alive[row, column] = True
        after = np.broadcast_to(np.arange(1, wide + 2, dtype=np.int16), (n, wide + 1)).copy()
        before = after - 2
        made, agenda = self._join(symbol[:, :-1], symbol[:, 1:])
        rows = np.arange(n)
        while len(rows):
            at = agenda[rows].argmin(1)
            open_ = agenda[rows, at] < NEVER
            rows, at = rows[open_], at[open_]
            piece = made[rows, at]
            agenda[rows, at] = NEVER
            salts = _salts(at, piece)
            kept = ~_skips_all(own[rows], salts, limit)
            r, left = rows[kept], at[kept]
            if taken is not None:
                taken.append((r, salts[kept]))
            right = after[r, left]
            symbol[r, left] = piece[kept]
            alive[r, right] = False
            inside = right < wide
            agenda[r[inside], right[inside]] = NEVER
            follow = after[r, right]
            after[r, left] = follow
            before[r, np.minimum(follow, wide)] = left
            more = follow < wide
            x, a, b = r[more], left[more], follow[more]
            made[x, a], agenda[x, a] = self._join(symbol[x, a], symbol[x, b])
            prior = before[r, left]
            more = prior >= 0
            x, a, b = r[more], prior[more], left[more]
            made[x, a], agenda[x, a] = self._join(symbol[x, a], symbol[x, b])
        flat, counts = symbol[alive], alive.sum(1)
        odd = np.flatnonzero((flat < 0) | (flat >= len(self.shown)))
        if not len(odd):
            return flat, counts
        # characters without a piece are spelt as bytes
        spelt = dict(zip(numbers.tolist(), chars))
        singles = [self._single(spelt[v]) for v in flat[odd].tolist()]
        width = np.ones(len(flat), np.int64)
        width[odd] = [len(x) for x in singles]
        ends = np.cumsum(width)
        ids = np.repeat(flat, width)
        ids[_ranges((ends - width)[odd], width[odd])] = [i for x in singles for i in x]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])

    def word(self, word: str, dropout: float, key: int) -> list[int]:
        """Ids of one word of any length with the blanks before it; the agenda is a heap."""
        if word == BLANK or word == "\n":  # the sign itself is no blank: its bytes
            return [self.bytes[b] for b in word.encode()]
        symbols: list[str | None] = list(word.replace(" ", BLANK))
        rank, size = self.ranks.get, len(symbols)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        limit, own = min(int(dropout * (1 << 64)), MASK), xxhash.xxh3_64_intdigest(word, key)
        agenda: list[tuple[int, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            merged = symbols[left] + symbols[right]
            if (place := rank(merged)) is not None:
                heapq.heappush(agenda, (place, left, right, merged))

        for left in range(size - 1):
            offer(left, left + 1)
        while agenda:
            _, left, right, merged = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or after[left] != right or len(a) + len(b) != len(merged):
                continue  # one side was merged meanwhile
            if skips(own, left, self.ids[merged], limit):
                continue  # until a neighbour changes
            symbols[left], symbols[right] = merged, None
            follow = after[right]
            after[left] = follow
            if follow < size:
                before[follow] = left
                offer(left, follow)
            if before[left] >= 0:
                offer(before[left], left)
        return [i for s in symbols if s is not None for i in self._single(s)]

    def _single(self, symbol: str) -> list[int]:
        known = self.ids.get(symbol)
        return [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")] if known is None else [known]

    def decode(self, ids: list[int]) -> str:
        """The text of ids from ``word`` on ' ' + text; the blank put before is taken off again."""
        shown_all = list(map(self.shown.__getitem__, ids))
        try:
            return "".join(shown_all)[1:]
        except TypeError:  # some are bytes of longer characters
            pass
        parts: list[str] = []
        pending = bytearray()
        for shown in shown_all:
            if shown.__class__ is int:
                pending.append(shown)
                continue
            if pending:
                parts.append(pending.decode("utf-8", "surrogatepass"))
                pending.clear()
            parts.append(shown)
        if pending:
            parts.append(pending.decode("utf-8", "surrogatepass"))
        return "".join(parts)[1:]


class Words(dict):
    """Encoded words of one key, remembered up to a bound, as bytes of 32-bit ids."""

    def __init__(self, model: Model, dropout: float, key: int, most: int):
        super().__init__()
        self.model, self.dropout, self.key, self.most = model, dropout, key, most

    def __missing__(self, word: str) -> bytes:
        return array("i", self.model.word(word, self.dropout, self.key)).tobytes()

    def learn(self, parts: list[list[str]]) -> None:
        """Encodes the new short words of some parted texts together. Long words come once, and are not remembered."""
        seen: set[str] = set()
        for words in parts:
            seen.update(words)
        new = [w for w in seen if len(w) <= SHORT and w not in self and w != BLANK and w != "\n"]
        if len(self) + len(new) > self.most:
            self.clear()
            new = [w for w in seen if len(w) <= SHORT and w != BLANK and w != "\n"]
        new.sort(key=len)  # words of like length fill a table
        for at in range(0, len(new), TABLE_WORDS):
            some = new[at : at + TABLE_WORDS]
            self.update(zip(some, self.model.words(some, self.dropout, self.key)))


def encode_all(texts: list[str], words: Words) -> list[bytes]:
    """Ids of whole texts as bytes; of the empty text none. A blank is put before, as the model's own way is.

    New words are learnt for so many texts at a time as memory allows.
    """
    out: list[bytes] = []
    some: list[list[str]] = []
    size = 0
    for k, text in enumerate(texts):
        some.append(_WORDS.findall(" " + text) if text else [])
        size += len(text)
        if size >= STEP_CHARS or k == len(texts) - 1:
            words.learn(some)
            out += [b"".join(map(words.__getitem__, part)) for part in some]
            some, size = [], 0
    return out


class Merges:
    """Ids and salts of the merges of short words without dropout, in two long arrays; so many words as there is room for.

    When there is none, further words are not remembered: the usual ones came before.
    """

    def __init__(self, model: Model, most: int = REMEMBERED):
        self.model, self.most = model, most
        self.index: dict[str, int] = {}
        self.ids, self.salts = np.zeros(0, np.int32), np.zeros(0, np.uint64)
        self.id_ends, self.salt_ends = np.zeros(1, np.int64), np.zeros(1, np.int64)
        # the signs that never merge
        signs = [np.array(model.word(sign, 0, 0), np.int32) for sign in (BLANK, "\n")]
        self._add([BLANK, "\n"], np.concatenate(signs), np.array([len(x) for x in signs]), self.salts, np.zeros(2, np.int64))

    def _add(self, words: list[str], ids: np.ndarray, id_counts: np.ndarray, salts: np.ndarray, salt_counts: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.ids, self.salts = np.concatenate([self.ids, ids]), np.concatenate([self.salts, salts])
        self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(id_counts)])
        self.salt_ends = np.concatenate([self.salt_ends, self.salt_ends[-1] + np.cumsum(salt_counts)])

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if len(w) <= SHORT and w not in self.index][: max(self.most - len(self.index), 0)]
        new.sort(key=len)  # words of like length fill a table
        tables = [new[at : at + TABLE_WORDS] for at in range(0, len(new), TABLE_WORDS)]
        if tables:
            self._add(new, *map(np.concatenate, zip(*map(self.model.merges, tables))))


def encode_each(texts: list[str], keys: list[int], model: Model, dropout: float, known: Merges | None = None) -> list[bytes]:
    """As ``encode_all``, but the dropout of each text has a key of its own."""
    known = Merges(model) if known is None else known
    out: list[bytes] = []
    some: list[list[str]] = []
    size = 0
    for k, text in enumerate(texts):
        some.append(_WORDS.findall(" " + text) if text else [])
        size += len(text)
        if size >= STEP_CHARS or k == len(texts) - 1:
            out += _encode_some(some, keys[len(out) : k + 1], model, dropout, known)
            some, size = [], 0
    return out


def _encode_some(texts: list[list[str]], keys: list[int], model: Model, dropout: float, known: Merges) -> list[bytes]:
    limit = min(int(dropout * (1 << 64)), MASK)
    flat = [w for words in texts for w in words]
    kinds = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    names = list(kinds)
    known.learn(names)
    sizes = np.array([len(words) for words in texts], np.int64)
    # each word of each text once; ``inverse`` is the place of an occurrence among them
    occurs = np.repeat(np.arange(len(texts)), sizes) * max(len(names), 1) + np.fromiter(map(kinds.__getitem__, flat), np.int64, len(flat))
    pairs, inverse = np.unique(occurs, return_inverse=True)
    owner, kind = pairs // max(len(names), 1), pairs % max(len(names), 1)
    words, own_keys = [names[k] for k in kind.tolist()], [keys[n] for n in owner.tolist()]
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words, own_keys)), np.uint64)
    place = np.fromiter(map(known.index.get, names, repeat(-1)), np.int64, len(names))[kind]
    stored = place >= 0
    # the merges of the remembered words, tested in their order
    starts, counts = known.salt_ends[place], np.where(stored, known.salt_ends[np.minimum(place + 1, len(known.salt_ends) - 1)] - known.salt_ends[place], 0)
    skipped = np.concatenate([[0], np.cumsum(_skips_all(np.repeat(hashes, counts), known.salts[_ranges(starts, counts)], limit))])
    ends = np.cumsum(counts)
    again = np.flatnonzero(~stored | (skipped[ends] > skipped[ends - counts]))
    lengths = np.fromiter(map(len, names), np.int64, len(names))[kind[again]]
    again = again[np.argsort(lengths, kind="stable")].tolist()  # words of like length fill a table
    short = int((lengths <= SHORT).sum())
    tables = [again[at : min(at + TABLE_WORDS, short)] for at in range(0, short, TABLE_WORDS)]
    made = [model.agendas([words[x] for x in table], hashes[table], limit) for table in tables]
    made += [(np.array(ids, np.int32), [len(ids)]) for ids in (model.word(words[x], dropout, own_keys[x]) for x in again[short:])]
    starts, counts = known.id_ends[place], known.id_ends[np.minimum(place + 1, len(known.id_ends) - 1)] - known.id_ends[place]
    if made:
        counts[again] = np.concatenate([c for _, c in made])
        starts[again] = len(known.ids) + np.cumsum(counts[again]) - counts[again]
    ids = np.concatenate([known.ids, *[i for i, _ in made]])
    each = counts[inverse]
    whole = ids[_ranges(starts[inverse], each)]
    stops = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [whole[a:b].tobytes() for a, b in zip(stops, stops[1:])]


def read_model(spark: SparkSession, path: str) -> bytes:
    """The bytes of a model file, by Spark's reader, so that any store will do."""
    url = path if "://" in path else f"file://{path}"
    return bytes(spark.read.format("binaryFile").load(url).select("content").first()[0])


def _ids(data, dropout: float, remembered: int):
    @F.arrow_udf("array<int>")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = Model(data.value)
        words, known = Words(model, dropout, 0, remembered), Merges(model, remembered)
        for texts, keys in parts:
            plain = [t or "" for t in texts.to_pylist()]
            if dropout > 0:
                found = encode_each(plain, [k & MASK for k in keys.to_pylist()], model, dropout, known)
            else:
                found = encode_all(plain, words)
            ends = np.cumsum([0] + [len(f) // 4 for f in found]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))

    # so called only to keep the optimiser from writing it twice where the ids are used twice, as by ``decode``
    return run.asNondeterministic()


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``docs`` with ``ids`` (underscores put before if there is such a column).

    The dropout of a row hangs on its key and the seed, so a word is cut differently
    from document to document, alike inside of one, and rows with equal keys and texts
    have equal ids. A row without key takes its text as the key. Null and empty texts
    have no ids. ``remembered``: words whose merges a task keeps.
    Other columns and an empty table pass through. One row for each row given, no
    shuffle; the model is read once and broadcast.
    """
    name, own = fresh(docs, "ids", "_own")
    data = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, model))
    keyed = docs.withColumn(own, F.xxhash64(F.lit(seed), F.col(key), F.when(F.col(key).isNull(), F.col(text))))
    return keyed.withColumn(name, _ids(data, dropout, remembered)(F.col(text), F.col(own))).drop(own)


def decode(docs: DataFrame, ids: str = "ids", model: str = MODEL) -> Column:
    """The texts of ids; null for null."""
    data = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, model))

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Model(data.value)
        for batch in parts:
            ends, valid = batch.offsets.to_numpy(), batch.is_valid().to_pylist()
            ids = batch.values.to_numpy(zero_copy_only=False)
            yield pa.array([known.decode(ids[a:b].tolist()) if v else None for a, b, v in zip(ends, ends[1:], valid)], pa.string())

    return run(F.col(ids))
