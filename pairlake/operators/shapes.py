"""Shape and type of each attribute of a record table, per nesting level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def _levels(kind: T.DataType) -> tuple[int, T.DataType]:
    depth = 0
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    return depth, kind


def _word(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "float"
    return "str" if isinstance(kind, T.StringType) else kind.simpleString()


def infer_shapes(df: DataFrame, sample: int | None = None) -> DataFrame:
    """(key, level, size, type): the common length at a level, null if lengths differ,
    -1 if only empty lists were seen. A scalar is a list of one.

    One aggregation over all rows (or the first ``sample``): lengths are reduced
    to their extremes in each task.
    """
    source = df if sample is None else df.limit(sample)
    aggs, rows = [], []
    for field in source.schema.fields:
        depth, kind = _levels(field.dataType)
        for level in range(max(depth, 1)):
            if depth == 0:
                low = high = F.lit(1)
            else:
                lists = F.col(field.name)
                for _ in range(level - 1):
                    lists = F.flatten(lists)
                # sizes of the lists at this level; empty ones do not count
                sizes = F.array(F.size(lists)) if level == 0 else F.transform(lists, lambda x: F.size(x))
                sizes = F.filter(sizes, lambda n: n > 0)
                low, high = F.array_min(sizes), F.array_max(sizes)
            name = f"{len(rows)}"
            aggs += [F.min(low).alias(f"l{name}"), F.max(high).alias(f"h{name}")]
            rows.append((field.name, level, _word(kind), name))
    size = lambda n: (
        F.when(F.col(f"l{n}").isNull(), F.lit(-1)).when(F.col(f"l{n}") == F.col(f"h{n}"), F.col(f"l{n}"))
    )
    entries = [
        F.struct(F.lit(k).alias("key"), F.lit(level).alias("level"), size(n).cast("int").alias("size"), F.lit(word).alias("type"))
        for k, level, word, n in rows
    ]
    return source.agg(*aggs).select(F.explode(F.array(*entries)).alias("r")).select("r.*")
