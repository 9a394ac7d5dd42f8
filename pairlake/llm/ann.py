"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, scaled to length one and rotated by a seeded random
orthogonal matrix; of each rotated component only the sign is kept, packed in
64-bit words, with two correction scalars: the length of the centred vector,
and the inner product of the vector with its own code. From these an unbiased
estimate of any inner product follows, with an error bound. A search takes the
best estimates, scores them exactly, and then scores every other candidate whose
upper bound reaches the worst of the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairlake.session import cut

TOP, SEED, BOUND, BLOCK, QUERY_BLOCK, QUERY_STEP = 20, 42, 4.0, 8192, 1024, 64
MOST_TASKS = 20_000  # a task then takes several pairs, one after another


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix; every task gets the same one."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed from the first component to the last."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d].astype(np.float64) * b[:, d].astype(np.float64)
    return out


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes: rows x words of 64 bits, length, own): packed signs and the two scalars."""
    centred = vectors - centre
    length = np.linalg.norm(centred, axis=1)
    unit = np.divide(centred, length[:, None], out=np.zeros_like(centred), where=length[:, None] > 0) @ turn.T
    size = unit.shape[1]
    bits = np.zeros((len(unit), -(-size // 64) * 64), np.uint8)
    bits[:, :size] = unit >= 0
    own = np.abs(unit).sum(1) / np.sqrt(size)
    return np.packbits(bits, axis=1).view(np.uint64), length, own


def signs(codes: np.ndarray, size: int) -> np.ndarray:
    """The packed signs as a matrix of -1 and 1."""
    bits = np.unpackbits(codes.view(np.uint8).reshape(len(codes), -1), axis=1, count=size)
    return bits.astype(np.float32) * np.float32(2) - np.float32(1)


def estimates(
    flips: np.ndarray, length: np.ndarray, own: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, bound: float = BOUND
) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries (rows) with all coded vectors (columns), and their error bounds.

    ``flips`` are the ``signs`` of the codes. The bound is ``bound`` standard
    deviations of the code's error, and the rounding of single precision.
    """
    size = queries.shape[1]
    safe = np.where(own > 0, own, 1)
    product = (queries @ turn.T).astype(np.float32) @ flips.T
    scale = np.where(own > 0, length / safe, 0) / np.sqrt(size)
    near = product * scale + (queries @ centre)[:, None]
    norm = np.linalg.norm(queries, axis=1)
    spread = bound * np.sqrt(np.maximum(1 - own**2, 0)) / safe / np.sqrt(max(size - 1, 1)) * length
    rounding = 1e-6 * np.sqrt(size) * length / safe + 1e-9 * (1 + np.linalg.norm(centre) + length)
    return near, norm[:, None] * (spread + rounding)


def best_of(
    ids: np.ndarray, queries: np.ndarray, keys: np.ndarray, vectors: np.ndarray, near: np.ndarray, error: np.ndarray, top: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the ``top`` best vectors of each query, exact, best first. ``keys`` have to ascend.

    The best estimates are scored; their worst score is a floor that the true
    neighbours reach. So all vectors whose upper bound reaches it are scored too.
    """
    n = len(keys)
    low, high = np.searchsorted(keys, ids, "left"), np.searchsorted(keys, ids, "right")
    for q in np.flatnonzero(low < high):
        near[q, low[q] : high[q]] = -np.inf  # not the query itself
    k = min(top, n)
    first = np.argpartition(-near, k - 1, axis=1)[:, :k]
    known = np.isfinite(np.take_along_axis(near, first, 1))
    scores = np.einsum("qkd,qd->qk", vectors[first], queries)
    floor = np.where(known, scores, np.inf).min(1)
    slack = 1e-12 * (1 + np.abs(floor))
    mask = near + error >= (floor - slack)[:, None]
    np.put_along_axis(mask, first, known, 1)
    # single precision leaves those that may still be among the best, which are then summed exactly
    small, asked = vectors.astype(np.float32), queries.astype(np.float32)
    far = 1e-6 * np.sqrt(queries.shape[1]) * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max()
    columns = []
    for q in range(len(ids)):
        chosen = np.flatnonzero(mask[q])
        if len(chosen) > top:
            rough = small[chosen] @ asked[q]
            chosen = chosen[rough >= np.partition(rough, -top)[-top] - 2 * far[q]]
        columns.append(chosen)
    row, column = np.repeat(np.arange(len(ids)), [len(c) for c in columns]), np.concatenate(columns)
    score = exact(queries[row], vectors[column])
    order = np.lexsort((keys[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < top
    return row[kept], column[kept], score[kept]


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(name, name_rows): vectors in blocks of about ``size`` rows, dealt out by hash."""
    parts = max(1, -(-rows.count() // size))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int"))
    return dealt.groupBy(name).agg(F.collect_list(F.struct("id", "v")).alias(f"{name}_rows"))


def _arrays(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A packed block as ids and a matrix."""
    flat = rows.values if isinstance(rows, pa.ListScalar) else rows.flatten()
    ids = flat.field("id").to_numpy(zero_copy_only=False)
    v = flat.field("v")
    return ids, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows that take part: key not null, vector of finite numbers, neither null, empty nor zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))
    )


def search(
    queries: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP,
    bound: float = BOUND, block: int = BLOCK, query_block: int = QUERY_BLOCK, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` candidates of largest inner product of each query.

    Every query row against every vector but those with its own key, nearest
    first, ties to the smaller key; all candidates where there are fewer.
    Vectors that are null, empty, zero or hold null or non-finite components take
    no part, neither do null keys. All vectors must have one length (else the
    job stops). Rows that repeat in key and vector count once; a key with several
    different vectors takes part with each of them, and its list as a query is
    the nearest over all of them. Empty tables give no rows.

    Work: query blocks x vector blocks, each pair in a task of its own with
    bounded memory; a task returns ``top`` rows per query. Scores are exact and
    in double precision. A neighbour can be lost only if its estimate is off by
    more than the bound (``bound`` standard deviations).
    """
    spark = vectors.sparkSession
    base = cut(usable(vectors, key, vector).distinct())
    asked = usable(queries, key, vector).distinct()
    size = base.select(F.size("v").alias("n")).agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("c")).first()
    if not size["c"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size["a"] != size["b"]:
        raise ValueError(f"vectors of different length: {size['a']} to {size['b']}")
    width = size["a"]
    # the centre: one number per component
    mean = base.select([F.avg(F.element_at("v", d + 1)).alias(f"c{d}") for d in range(width)]).first()
    centre = np.array(mean, np.float64)
    held, wanted = _blocks(base, block, "b"), _blocks(asked, query_block, "q")
    parts = max(1, -(-size["c"] // block))
    # every query block meets every vector block: the searched table is read in blocks, never joined row by row
    pairs = wanted.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(held, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(width, seed)
        for batch in batches:
            for n in range(batch.num_rows):
                qid, qv = _arrays(batch.column(0)[n])
                vid, vv = _arrays(batch.column(1)[n])
                order = np.argsort(vid, kind="stable")
                vid, vv = vid[order], vv[order]
                codes, length, own = encode(vv, centre, turn)
                flips = signs(codes, width)
                for at in range(0, len(qid), QUERY_STEP):
                    ids, some = qid[at : at + QUERY_STEP], qv[at : at + QUERY_STEP]
                    near, error = estimates(flips, length, own, some, centre, turn, bound)
                    row, column, score = best_of(ids, some, vid, vv, near, error, top)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row]), pa.array(vid[column]), pa.array(score)], ["query_id", "vec_id", "score"]
                    )

    # the work of a pair of blocks does not show in its bytes, so pairs are dealt out by number
    tasks = min(parts * wanted.count(), MOST_TASKS)
    spread = pairs.repartition(max(1, tasks), "q", "b").select("q_rows", "b_rows")
    found = spread.mapInArrow(run, "query_id long, vec_id long, score double")
    # a filter on the rank lets each task pass on ``top`` rows per query at most
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
