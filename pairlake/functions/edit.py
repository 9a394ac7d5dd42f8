"""Edit distances between two columns, over whole texts.

With a limit, or where two long inputs differ little, the furthest points that so
many edits reach on each diagonal are enough (Ukkonen, 1985): the work grows with
the square of the distance, and with the length only to compare equal runs.

Long inputs use the bit-parallel row update of Myers (1999) in Hyyro's form,
inside Arrow batches: about 20 times faster than a cell-by-cell table and with
no limit on length or on the number of distinct symbols. Short texts stay in
the JVM, where the batch overhead would dominate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from pairlake.functions.costs import Costs, Table

SHORT_CELLS = 64 * 64
#: Symbols compared at first when a run of equal ones is looked for; doubled while they are equal.
RUN = 32


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Unit-cost distance of two sequences of hashable symbols."""
    if len(a) < len(b):
        a, b = b, a
    a, b = _without_ends(a, b)
    size = len(a)
    if not b:
        return size
    # bit 0 stands for the empty beginning of ``a``, whose distance always grows by one
    where: dict = {}
    bit = 2
    for symbol in a:
        where[symbol] = where.get(symbol, 0) | bit
        bit <<= 1
    full, inner = bit - 1, bit - 2
    up, down, get = inner, 0, where.get
    for at in range(0, len(b), RUN):
        for symbol in b[at : at + RUN]:
            match = get(symbol, 0) | down
            diagonal = (((match & up) + up) ^ up) | match
            grow = (down | (full ^ (up | diagonal))) << 1
            down = grow & diagonal
            up = ((up & diagonal) << 1) | (inner ^ (grow | diagonal))
        # bits behind the last symbol reach no others; they go before they are many
        up &= inner
        down &= inner
    return len(b) + up.bit_count() - down.bit_count()


def _without_ends(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """Both without their common beginning and end, found by halving (slices compare fast)."""
    for flip in (False, True):
        low, high = 0, len(b)
        while low < high:
            mid = (low + high + 1) // 2
            same = a[len(a) - mid :] == b[len(b) - mid :] if flip else a[:mid] == b[:mid]
            low, high = (mid, high) if same else (low, mid - 1)
        a, b = (a[: len(a) - low], b[: len(b) - low]) if flip else (a[low:], b[low:])
    return a, b


def coded(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers, equal just where the symbols are."""
    if isinstance(a, str) and isinstance(b, str):
        return tuple(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in (a, b))
    known: dict = {}
    return tuple(np.array([known.setdefault(s, len(known)) for s in x], np.int64) for x in (a, b))


def _run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many symbols from a[i] and b[j] on are equal."""
    most, at, wide = min(len(a) - i, len(b) - j), 0, RUN
    while at < most:
        differ = a[i + at : i + min(at + wide, most)] != b[j + at : j + min(at + wide, most)]
        stop = int(differ.argmax())
        if differ[stop]:
            return at + stop
        at += len(differ)
        wide *= 2
    return most


def within(a: Sequence, b: Sequence, limit: int) -> int | None:
    """Unit-cost distance of two sequences if it is at most ``limit``, else None."""
    if limit < 0 or abs(len(a) - len(b)) > limit:
        return None
    x, y = coded(*_without_ends(a, b))
    return _reach(x, y, limit)


def _reach(x: np.ndarray, y: np.ndarray, limit: int) -> int | None:
    n, m = len(x), len(y)
    goal = m - n
    far = {0: _run(x, y, 0, 0)}  # diagonal j - i -> furthest i
    for edits in range(limit + 1):
        if far.get(goal, -1) >= n:
            return edits
        if edits == limit:
            return None
        rest, after = limit - edits - 1, {}
        for k in range(max(-edits - 1, goal - rest), min(edits + 1, goal + rest) + 1):
            i = max(far.get(k, -2) + 1, far.get(k - 1, -2), far.get(k + 1, -2) + 1)
            i = min(i, n, m - k)
            if i >= 0 and i + k >= 0:
                after[k] = i + _run(x, y, i, i + k)
        far = after
    return None


def contained(short: Sequence, long: Sequence) -> bool:
    """Whether ``short`` arises from ``long`` by leaving symbols out: then only their number counts."""
    rest = iter(long)
    return all(symbol in rest for symbol in short)


def distance(a: Sequence, b: Sequence) -> int:
    """``edit_distance`` with the quick cases first (a text mixed whole into another)."""
    found = _quick(a, b)
    return edit_distance(a, b) if found is None else found


def _quick(a: Sequence, b: Sequence) -> int | None:
    """The distance where a quick case gives it."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if contained(short, long):
        return len(long) - len(short)
    # few edits in long inputs: cheaper than a row of bits per symbol, with a limit that doubles as long as that holds
    limit, most = 8, len(long) // 256
    if limit <= most and len(long) - len(short) <= most:
        x, y = coded(*_without_ends(a, b))
        while limit <= most:
            if abs(len(x) - len(y)) <= limit and (found := _reach(x, y, limit)) is not None:
                return found
            limit *= 2
    return None


#: Words of 64 symbols and table entries of the pairs that go together, and table entries of one pair.
LANES, ENTRIES, OWN_ENTRIES = 4096, 1 << 20, 1 << 18


def edit_distances(pairs: Sequence[tuple[Sequence, Sequence]]) -> list[int]:
    """``edit_distance`` of many pairs; those of similar length go together, a word of 64 symbols to a lane of numpy arrays.

    A word needs what the word before it hands on at the same symbol, so lane w is w symbols behind
    the first one of its pair.
    """
    out, open_ = [0] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        a, b = _without_ends(a, b)
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if b:
            open_.append((len(b), len(a), k, a, b))
        else:
            out[k] = len(a)
    open_.sort(key=lambda x: x[:2])
    at = 0
    while at < len(open_):
        group, lanes, entries, steps, single = [], 0, 0, 0, 0.0
        while at < len(open_) and lanes < LANES and entries < ENTRIES:
            m, n, k, a, b = open_[at]
            if group and m > 64 + 1.2 * len(group[0][4]):
                break
            words, kinds = -(-n // 64), len(set(a)) + 1
            at += 1
            if words * kinds > OWN_ENTRIES:
                out[k] = edit_distance(a, b)
                continue
            group.append((words, n, k, a, b))
            lanes, entries, steps = lanes + words, entries + words * kinds, max(steps, m + words)
            single += m * (1.0 + 0.0003 * n)
        # what either way takes, in about microseconds
        if steps * (25 + 0.02 * lanes) < single:
            for (_, _, k, _, _), found in zip(group, _together(group)):
                out[k] = found
        else:
            for _, _, k, a, b in group:
                out[k] = edit_distance(a, b)
    return out


def _together(group: list[tuple]) -> list[int]:
    """Distances of (words, length, .., longer, shorter): ``edit_distance``, 64 symbols of the longer one in each lane."""
    order = sorted(range(len(group)), key=lambda k: -group[k][0])
    words = np.array([group[k][0] for k in order])
    sizes, lengths = np.array([group[k][1] for k in order]), np.array([len(group[k][4]) for k in order])
    tables, texts = [], []
    for k in order:
        wide, n, _, a, b = group[k]
        x, y = coded(a, b)
        kinds = np.unique(x)
        number = np.zeros(int(max(kinds[-1], y.max())) + 1, np.int64)
        number[kinds] = np.arange(1, len(kinds) + 1)
        bits = np.zeros((len(kinds) + 1, wide * 64), np.uint8)
        bits[number[x], np.arange(n)] = 1
        tables.append(np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64).ravel())
        texts.append(number[y] * wide)
    first = lambda parts: np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]])
    table0, text0, table, text = first(tables), first(texts), np.concatenate(tables), np.concatenate(texts)
    # lanes by word, then pair: those of word w are the pairs that have so many
    have = [int((words > w).sum()) for w in range(int(words[0]))]
    starts = np.concatenate([[0], np.cumsum(have)])
    level = np.repeat(np.arange(len(have)), have)
    pair = np.concatenate([np.arange(c) for c in have])
    before = np.where(level > 0, starts[np.maximum(level - 1, 0)] + pair, 0)
    base, spot = table0[pair] + level, text0[pair] - level
    last = starts[words - 1] + np.arange(len(order))
    top = np.full(len(pair), 63, np.uint64)
    top[last] = (sizes - 1) % 64
    one = np.uint64(1)
    up, down = np.full(len(pair), ~np.uint64(0)), np.zeros(len(pair), np.uint64)
    grown, shrunk = np.zeros(len(pair), np.uint64), np.zeros(len(pair), np.uint64)
    score = sizes.copy()
    for step in range(int((lengths + words - 1).max())):
        n = int(starts[min(step + 1, len(have))])
        more, less = grown.take(before[:n]), shrunk.take(before[:n])
        more[: have[0]], less[: have[0]] = 1, 0
        u, d = up[:n], down[:n]
        match = table.take(base[:n] + text.take(spot[:n] + step, mode="clip"), mode="clip")
        cross = match | d
        match |= less
        diagonal = match & u
        diagonal += u
        diagonal ^= u
        diagonal |= match
        grow = ~(diagonal | u)
        grow |= d
        shrink = u & diagonal
        grown[:n], shrunk[:n] = (grow >> top[:n]) & one, (shrink >> top[:n]) & one
        grow <<= one
        grow |= more
        shrink <<= one
        shrink |= less
        np.bitwise_and(grow, cross, out=d)
        np.bitwise_or(shrink, ~(cross | grow), out=u)
        # rows beyond the end of a shorter text do not count, nor those of lanes that have not begun
        count = np.flatnonzero((step >= words - 1) & (step < lengths + words - 1))
        score[count] += grown[last[count]].astype(np.int64) - shrunk[last[count]].astype(np.int64)
    found = [0] * len(group)
    for k, value in zip(order, score.tolist()):
        found[k] = value
    return found


def _pairwise(a: pd.Series, b: pd.Series, split) -> pd.Series:
    out, places, rest = [], [], []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
        elif x == y:
            out.append(0)
        else:
            x, y = split(x), split(y)
            out.append(_quick(x, y))
            if out[-1] is None:
                places.append(len(out) - 1)
                rest.append((x, y))
    for place, found in zip(places, edit_distances(rest)):
        out[place] = found
    return pd.Series(out, dtype="Int64")


@F.pandas_udf(T.LongType())
def _long_chars(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(a, b, lambda x: x)


@F.pandas_udf(T.LongType())
def _joined_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(a, b, lambda x: x.split(" ") if x else [])


def string_distance(a: Column, b: Column) -> Column:
    """Characters inserted, removed or replaced; whole texts, exact."""
    short = F.length(a).cast("bigint") * F.length(b) <= SHORT_CELLS
    quick = F.when(short, F.levenshtein(a, b)).cast("bigint")
    # short rows reach the Python side as nulls, at no cost
    slow = _long_chars(F.when(~short, a), F.when(~short, b))
    return F.coalesce(quick, slow)


def string_distance_within(a: Column, b: Column, limit: int) -> Column:
    """The distance where it is at most ``limit``, else -1; stops early in the JVM."""
    far = F.abs(F.length(a) - F.length(b)) > limit
    return F.when(far, F.lit(-1)).otherwise(F.levenshtein(a, b, limit)).cast("bigint")


def token_distance(a: Column, b: Column) -> Column:
    """Distance of two token sequences given as blank-joined texts."""
    return _joined_tokens(a, b)


def token_distance_within(a: Column, b: Column, limit: int) -> Column:
    """Distance of two token sequences (blank-joined texts) where it is at most ``limit``, else -1; null for null."""

    @F.pandas_udf(T.LongType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            found = None if p is None or q is None else within(p.split(" ") if p else [], q.split(" ") if q else [], limit)
            out.append(None if p is None or q is None else -1 if found is None else found)
        return pd.Series(out, dtype="Int64")

    return run(a, b)


def weighted(
    a: Sequence, b: Sequence, insert: float = 1.0, remove: float = 1.0, update: float = 1.0, costs: Costs | None = None
) -> float:
    """Distance with own costs (``costs``, or three numbers); one numpy row per symbol of ``a``.

    The dependence on the left neighbour is a running minimum after taking the
    cost of the insertions out.
    """
    costs = costs or Costs(insert, remove, update)
    kinds = {s: k for k, s in enumerate(dict.fromkeys(b))}
    right = np.array([kinds[s] for s in b], np.int64)
    slope = np.concatenate([[0.0], np.cumsum(costs.inserted(b))])
    row, change = slope.copy(), {}
    for symbol, gone in zip(a, costs.removed(a).tolist()):
        if symbol not in change:
            change[symbol] = costs.changed(symbol, kinds)
        best = row + gone
        best[1:] = np.minimum(best[1:], row[:-1] + change[symbol][right])
        row = np.minimum.accumulate(best - slope) + slope
    return float(row[-1]) / costs.scale


def weighted_distance(
    a: Column, b: Column, insert: float = 1.0, remove: float = 1.0, update: float = 1.0, table: Table | None = None
) -> Column:
    """Token distance (blank-joined texts) with caller-given costs, from ``a`` to ``b``.

    ``table``: costs of single tokens, as ``Costs`` takes them.
    """
    costs = Costs(insert, remove, update, dict(table or {}))

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        cut = lambda t: t.split(" ") if t else []
        return pd.Series(
            [None if p is None or q is None else weighted(cut(p), cut(q), costs=costs) for p, q in zip(x, y)], dtype="float64"
        )

    return run(a, b)
