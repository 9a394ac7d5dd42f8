"""Clone search: the k most similar seeds of each target, exact.

A k-nearest-neighbour join over pivots (Lu et al., PVLDB 2012). Seeds belong to
the cell of their nearest pivot, and in a large cell to one of some rings of about equal
count, by their distance to the pivot.
The triangle inequality gives each target a distance within which its k
neighbours must lie, hence the rings it has to visit. Rings lie together in blocks, and a target meets the blocks
that hold one of its rings; the others are skipped without losing a result. A vector is sent once to a block, however many rings it
visits there, and there are few blocks, so what is shuffled grows with the rows and not with rows times rings. A ring with most of all seeds
(many copies of one text) is spread over several blocks, and each task keeps only its k best per target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pairlake.functions.draws import draw
from pairlake.functions.vectors import l2_normalise
from pairlake.session import cut

MAX_PIVOTS = 4096
MAX_K = 1000
#: Rings that a cell may have, and seeds that a ring has at least (but for ties and estimates).
RINGS, RING_ROWS = 64, 1024
#: Blocks of either side, as long as they have between so many rows and so many; scores held at a time.
BLOCKS, LEAST_ROWS, BLOCK_ROWS, SCORES = 16, 1024, 131_072, 1 << 22


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def _in_rings(placed: DataFrame) -> DataFrame:
    """``placed`` with its ring; the ring's number tells the cell. At most ``MAX_PIVOTS`` rows of quantiles come to the driver."""
    counts = {r["cell"]: r["c"] for r in placed.groupBy("cell").agg(F.count("*").alias("c")).collect()}
    many = {c: min(RINGS, -(-n // RING_ROWS)) for c, n in counts.items()}
    if max(many.values(), default=1) == 1:
        return placed.withColumn("ring", F.col("cell") * RINGS)
    shares = F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])
    large = placed.where(F.col("cell").isin([c for c, n in many.items() if n > 1]))
    spots = {r["cell"]: r["q"] for r in large.groupBy("cell").agg(F.percentile_approx("far", shares, F.lit(10_000)).alias("q")).collect()}
    cuts = {c: np.unique([q[-(-RINGS * i // many[c]) - 1] for i in range(1, many[c])]) for c, q in spots.items()}

    @F.pandas_udf(T.IntegerType())
    def ring(cell: pd.Series, far: pd.Series) -> pd.Series:
        out = cell.to_numpy().astype(np.int32) * RINGS
        for c in set(cell).intersection(cuts):
            here = (cell == c).to_numpy()
            out[here] += np.searchsorted(cuts[c], far.to_numpy()[here]).astype(np.int32)
        return pd.Series(out)

    return placed.withColumn("ring", ring("cell", "far"))


def _block_rows(rows: int, most: int) -> int:
    """Rows of a block: a vector is sent to ``BLOCKS`` blocks at most, unless blocks would be larger than memory allows."""
    return min(most, max(LEAST_ROWS, -(-rows // BLOCKS)))


def _blocks(cells: np.ndarray, counts: np.ndarray, centres: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, many): the blocks of each ring. Rings are taken along the axis on which the pivots differ most, so that a block holds
    neighbours; a ring larger than a block is spread over several of its own."""
    size = _block_rows(int(counts.sum()), most)
    axis = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    first, many = np.zeros(len(cells), np.int32), np.ones(len(cells), np.int32)
    at, held = 0, 0
    for k in np.lexsort((np.arange(len(cells)), cells, (centres @ axis)[cells])).tolist():
        if held and held + counts[k] > size:
            at, held = at + 1, 0
        first[k], many[k] = at, max(1, -(-int(counts[k]) // size))
        if many[k] > 1:
            at, held = at + many[k], 0
        else:
            held += counts[k]
    return first, many


def _best(keys: np.ndarray, asking: np.ndarray, ids: np.ndarray, offered: np.ndarray, k: int, skip_same: bool) -> tuple[np.ndarray, ...]:
    """(key, id, score) of the ``k`` best of ``offered`` for each row of ``asking``, ties by id."""
    order = np.argsort(ids, kind="stable")
    parts, step, n = [], max(1, SCORES // len(ids)), len(ids)
    wide = max(1, n // (4 * k))
    for start in range(0, len(keys), step):
        some = keys[start : start + step]
        raw = asking[start : start + step] @ offered.T
        if skip_same:
            at, stop = np.searchsorted(ids, some, sorter=order), np.searchsorted(ids, some, "right", sorter=order)
            for more in range(int((stop - at).max())):
                row = np.flatnonzero((at + more < stop) & (some == some))
                raw[row, order[at[row] + more]] = -np.inf
        if n > k:
            # the k-th of the best of so many groups is no better than the k-th of all; all that may tie with it stay
            tops = raw[:, : n // wide * wide].reshape(len(some), -1, wide).max(2)
            least = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
            row, column = np.nonzero(raw >= (least - 4e-9)[:, None])
        else:
            row, column = np.nonzero(raw == raw)
        raw = raw[row, column]
        left = raw > -np.inf
        row, column, scores = row[left], column[left], np.round(np.clip((raw[left] + 1) / 2, 0, 1), 9)
        sort = np.lexsort((ids[column], -scores, row))
        row, column, scores = row[sort], column[sort], scores[sort]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < k
        parts.append((some[row[kept]], ids[column[kept]], scores[kept]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def search(
    targets: DataFrame, seeds: DataFrame, k: int, target: str = "target_id", seed: str = "seed_id",
    vector: str = "vector", skip_same: bool = False, pivots: int | None = None, block: int = BLOCK_ROWS, seed_no: int = 0,
) -> DataFrame:
    """(target, seed, score, place): the k best seeds by (cosine + 1) / 2, ties by seed id.

    ``skip_same`` leaves out the pair of equal ids. Only ``pivots`` vectors,
    ``pivots * k`` distances and the sizes of ``pivots * RINGS`` rings come to the
    driver, all limited by checks. By default there are as many pivots as the
    square root of the number of seeds says, within the limit.
    """
    if pivots is None:
        pivots = min(MAX_PIVOTS, max(16, int(seeds.count() ** 0.5)))
    if not (1 <= pivots <= MAX_PIVOTS and 1 <= k <= MAX_K):
        raise ValueError(f"pivots must be in 1..{MAX_PIVOTS} and k in 1..{MAX_K}")
    wanted = k + (1 if skip_same else 0)
    unit = lambda df, key: df.select(F.col(key).alias("id"), l2_normalise(F.col(vector)).alias("v"))
    s, t = unit(seeds, seed), unit(targets, target)

    picked = s.orderBy(draw(seed_no, "pivot", "id"), "id").limit(pivots).select("v").collect()
    centres = np.array([r["v"] for r in picked], dtype=float)
    out = T.StructType([T.StructField(target, T.LongType()), T.StructField(seed, T.LongType()), T.StructField("score", T.DoubleType())])
    if not len(centres):
        return targets.sparkSession.createDataFrame([], out).withColumn("place", F.lit(1))

    @F.pandas_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())]))
    def nearest(v: pd.Series) -> pd.DataFrame:
        d = _distances(_matrix(v), centres)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "far": d[np.arange(len(cell)), cell]})

    placed = cut(s.select("id", "v", nearest("v").alias("n")).select("id", "v", "n.cell", "n.far"))
    placed = _in_rings(placed)
    stats = placed.groupBy("ring").agg(F.count("*").alias("c"), F.min("far").alias("lo"), F.max("far").alias("hi")).collect()
    order = Window.partitionBy("cell").orderBy("far", "id")
    close = placed.select("cell", "far", "id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= wanted)
    near = np.full((len(centres), wanted), np.inf)
    for r in close.select("cell", "r", "far").collect():
        near[r["cell"], r["r"] - 1] = r["far"]
    rings = np.array([r["ring"] for r in stats], dtype=np.int32)
    lows, highs = np.array([r["lo"] for r in stats]), np.array([r["hi"] for r in stats])
    first, many = _blocks(rings // RINGS, np.array([r["c"] for r in stats], np.int64), centres, block)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def visits(v: pd.Series) -> pd.Series:
        found = []
        for row in _distances(_matrix(v), centres):
            bounds = (row[:, None] + near).ravel()
            limit = np.partition(bounds, wanted - 1)[wanted - 1] if np.isfinite(bounds).sum() >= wanted else np.inf
            # scores are compared to 9 decimals: (distance)^2 = 4 - 4 * score
            reach = np.sqrt(limit * limit + 8e-9) + 1e-6
            far = row[rings // RINGS]
            here = (far - highs <= reach) & (lows - far <= reach)
            # the blocks that hold a ring within reach
            found.append(np.unique(np.repeat(first[here] + many[here] - np.cumsum(many[here]), many[here]) + np.arange(many[here].sum())).astype(np.int32))
        return pd.Series(found)

    own = lambda n: F.pmod(draw(seed_no, "block", "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    places = F.broadcast(targets.sparkSession.createDataFrame(list(zip(rings.tolist(), first.tolist(), many.tolist())), "ring int, first int, many int"))
    placed = placed.drop("cell").join(places, "ring").select("id", "v", (F.col("first") + own("many")).alias("cell"))
    # a vector once, with the blocks it asks: it is multiplied in the shuffle only
    asked = cut(t.select("id", "v", visits("v").alias("cells")))
    asks = asked.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("c")).collect()
    # one row per seed block: how many target blocks meet it; a pair of blocks is one task group
    size = _block_rows(max((r["c"] for r in asks), default=0), block)
    sizes = [(r["cell"], -(-r["c"] // size)) for r in asks]
    table = F.broadcast(targets.sparkSession.createDataFrame(sizes, "cell int, target_blocks int"))
    left = asked.select("id", "v", F.explode("cells").alias("cell")).join(table, "cell").select("cell", own("target_blocks").alias("tb"), "id", "v")
    right = placed.join(table, "cell").select("cell", every("target_blocks").alias("tb"), "id", "v")

    def best(asking: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(offered):
            return pd.DataFrame({target: [], seed: [], "score": []}).astype({target: "int64", seed: "int64", "score": "float64"})
        found = _best(asking["id"].to_numpy(), _matrix(asking["v"]), offered["id"].to_numpy(), _matrix(offered["v"]), k, skip_same)
        return pd.DataFrame(dict(zip((target, seed, "score"), found)))

    keys = ["cell", "tb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, out)
    rank = F.row_number().over(Window.partitionBy(target).orderBy(F.desc("score"), seed))
    return found.withColumn("place", rank).where(F.col("place") <= k)
