"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are put in blocks. With integer weights w and their sum P,
block i (from 0) of a source has the release time floor(i P / w) and the
deadline ceil((i + 1) P / w); each slot of the sequence goes to the released
block with the earliest deadline. In every prefix of the sequence a source has
less than one block more or less than its weight asks for.

Weights are the targets themselves as whole numbers, not rounded, so the bound
holds against the targets. The windows repeat every P slots, so the schedule of
one period places all blocks of all cycles by arithmetic. Where a source runs out,
a new period over the remaining sources begins (a phase); a period longer than its
phase is made as far as the phase goes. So the schedule has a row per block at most,
however many sources and phases there are. Only the number of rows per source comes
to the driver; the driver's time grows with the blocks and with phases times sources.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, lcm

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairlake.functions.draws import DRAW_BITS, draw
from pairlake.llm.common import fresh, row_text

BLOCK_ROWS, SEED, BUCKET_BITS = 16, 42, 10


def slots(weights: dict[str, int]) -> Iterator[str]:
    """The source of each slot of one period, by earliest deadline among the released blocks; ties by name."""
    total = sum(weights.values())
    waiting: list[tuple[int, str, int]] = []  # (release, source, block)
    ready = [(-(-total // w), s, 0) for s, w in weights.items()]  # (deadline, source, block)
    heapq.heapify(ready)
    slot = 0
    while ready or waiting:
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s
        slot += 1
        if i + 1 < weights[s]:
            heapq.heappush(waiting, ((i + 1) * total // weights[s], s, i + 1))


def period(weights: dict[str, int]) -> list[str]:
    return list(slots(weights))


def exact_weights(targets: dict[str, float]) -> dict[str, int]:
    """Targets as the smallest whole numbers in just their proportions; targets not above 0 are left out."""
    above = {s: Fraction(w) for s, w in targets.items() if w is not None and w > 0}
    scale = lcm(*(w.denominator for w in above.values()))
    whole = {s: int(w * scale) for s, w in above.items()}
    common = gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def whole_weights(targets: dict[str, float], size: int) -> dict[str, int]:
    """Targets as integers with the sum ``size``, by largest remainder, at least 1 each; targets not above 0 are left out.

    Grows the sum instead where there are more sources than ``size``.
    """
    above = {s: float(w) for s, w in targets.items() if w is not None and w > 0}
    total = sum(above.values())
    exact = {s: w / total * size for s, w in above.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    left = size - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(left, 0)]:
        out[s] += 1
    while left < 0 and max(out.values()) > 1:
        top = max(out, key=lambda s: (out[s], s))
        out[top] -= 1
        left += 1
    return out


@dataclass
class Phase:
    start: int  # first slot
    order: list[str]  # one period, or all slots if the phase is shorter
    first: dict[str, int]  # a source's first block here
    stop: dict[str, int]  # its first block after
    weights: dict[str, int]


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[Phase]:
    """The phases until all blocks of the weighted sources are placed."""
    done, out, start = dict.fromkeys(blocks, 0), [], 0
    while active := {s: w for s, w in weights.items() if blocks.get(s, 0) > done[s]}:
        left = {s: blocks[s] - done[s] for s in active}
        order, upto = [], dict.fromkeys(active, 0)
        for s in slots(active):
            order.append(s)
            upto[s] += 1
            if upto[s] == left[s]:  # before the first period ends, or at its end
                break
        length = len(order)
        if upto == active:
            cycles = min(left[s] // w for s, w in active.items())
            upto = {s: cycles * w for s, w in active.items()}
            length *= cycles
            # all blocks of one source are placed now, or before this period ends
            for s in order if all(upto[s] < left[s] for s in active) else ():
                upto[s] += 1
                length += 1
                if upto[s] == left[s]:
                    break
        out.append(Phase(start, order, {s: done[s] for s in active}, {s: done[s] + n for s, n in upto.items()}, active))
        done |= out[-1].stop
        start += length
    return out


def name_of(source: str) -> Column:
    """Source names as keys: null is a source of its own, apart from the text 'null'."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def mix(
    df: DataFrame,
    targets: dict[str | None, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_rows: int = BLOCK_ROWS,
    size: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``df`` with ``block`` (in its source), ``slot`` and ``position`` (both from 0, over all sources).

    ``targets``: weight per source, taken as they are; by default the square root
    of a source's rows. ``size``: if given, the targets are first rounded to whole
    numbers with this sum, at least 1 each. Inside a source the rows are in a seeded shuffle. No row is dropped
    or repeated: when a source is used up, the others go on by their weights.
    Sources without a weight above 0 follow at the end, one after another by
    name. Null sources are one source; rows equal in key and text are placed
    next to each other; an empty table stays empty. Positions are unique and
    ascend in the mixed order, with a gap after each source's last, short block.

    Rows are ranked in hash buckets, so a source with most of the rows is split
    over ``2**BUCKET_BITS`` window partitions.
    """
    spark = df.sparkSession
    s, h, b, r, s2, b2, off, block, slot, position = fresh(
        df, "_s", "_h", "_b", "_r", "_s2", "_b2", "_off", "block", "slot", "position"
    )
    own = [F.col(f"`{c}`") for c in df.columns]
    # the digest of the whole text only parts rows with equal keys
    keyed = df.select("*", name_of(source).alias(s), draw(seed, "mix", row_text(key, text)).alias(h))
    keyed = keyed.withColumn(b, F.shiftright(h, DRAW_BITS - BUCKET_BITS).cast("int"))
    sizes = keyed.groupBy(s, b).agg(F.count("*").alias("c"))
    per = {x[s]: x["n"] for x in sizes.groupBy(s).agg(F.sum("c").alias("n")).collect()}
    wanted = {k: n**0.5 for k, n in per.items()} if targets is None else {
        "null" if k is None else f"={k}": w for k, w in targets.items()}
    blocks = {k: -(-n // block_rows) for k, n in per.items()}
    wanted = {k: w for k, w in wanted.items() if k in blocks}
    plan = phases(blocks, exact_weights(wanted) if size is None else whole_weights(wanted, size))
    # (source, first, stop, start, period, weight, inside, at): a block first <= i < stop with (i - first) % weight = inside
    columns: list[list] = [[] for _ in range(8)]
    for p in plan:
        seen, turns = dict.fromkeys(p.order, 0), Counter(p.order)
        for at, k in enumerate(p.order):
            for c, v in zip(columns, (k, p.first[k], p.stop[k], p.start, len(p.order), turns[k], seen[k], at)):
                c.append(v)
            seen[k] += 1
    end = sum(p.stop[k] - p.first[k] for p in plan for k in p.weights)
    for k in sorted(set(blocks) - {k for p in plan for k in p.weights}):
        for c, v in zip(columns, (k, 0, blocks[k], end, 1, 1, 0, 0)):
            c.append(v)
        end += blocks[k]
    names = [s, "first", "stop", "start", "period", "weight", "inside", "at"]
    kinds = [pa.string(), *[pa.int64()] * 7]
    schedule = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names))
    before = Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(s).alias(s2), F.col(b).alias(b2), F.coalesce(F.sum("c").over(before), F.lit(0)).alias(off)
    )
    inside = Window.partitionBy(s, b).orderBy(h)
    ranked = keyed.withColumn(r, F.row_number().over(inside) - 1)
    ranked = ranked.join(offsets, (F.col(s) == F.col(s2)) & (F.col(b) == F.col(b2)))
    ranked = ranked.select(*own, F.col(s), (F.col(r) + F.col(off)).alias(r))
    ranked = ranked.withColumn(block, F.floor(F.col(r) / block_rows))
    # one row per block, placed by the schedule
    cells = schedule.withColumn("i", F.explode(F.expr("sequence(first + inside, stop - 1, weight)"))).select(
        F.col(s).alias(s2), F.col("i").alias(b2), F.expr("start + (i - first) div weight * period + at").alias(slot)
    )
    placed = ranked.join(cells, (F.col(s) == F.col(s2)) & (F.col(block) == F.col(b2)))
    return placed.select(*own, block, slot, (F.col(slot) * block_rows + F.col(r) % block_rows).alias(position))


def ordered(df: DataFrame, **options) -> DataFrame:
    """``df`` in mixed order, with its own columns only: files and partitions follow the sequence."""
    placed = mix(df, **options)
    return placed.orderBy(placed.columns[-1]).select(*[F.col(f"`{c}`") for c in df.columns])


def read_position(df: DataFrame, **options) -> tuple[DataFrame, str]:
    """``df`` with the name of a new column that ascends (with gaps) in the mixed order, for what ``ordered`` gave.

    Rows read again from files have it from the numbers in the file's name and the
    row's place in the file, as Spark reads files in any order. Rows that come from
    no file, or from files that Spark did not write, are placed anew by ``mix`` with the same options.
    """
    name, file, row = fresh(df, "position", "_file", "_row")
    try:
        if not all(re.search(r"/part-\d+[^/]*$", f) for f in df.inputFiles()):
            raise AnalysisException("not written by Spark")
        held = df.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
        held.schema  # noqa: B018
    except AnalysisException:
        placed = mix(df, **options)
        extra = placed.columns[len(df.columns) :]
        return placed.withColumnRenamed(extra[-1], name).drop(*extra[:-1]), name
    # part-<task>-<id>-c<file of the task>: 20 bits, 10 bits, and 33 bits for rows
    part = F.regexp_extract(F.col(file), r"^part-(\d+)", 1).cast("long")
    own = F.coalesce(F.regexp_extract(F.col(file), r"[-.]c(\d+)\.", 1).try_cast("long"), F.lit(0).cast("long"))
    return held.withColumn(name, F.shiftleft(part, 43) + F.shiftleft(own, 33) + F.col(row)).drop(file, row), name
