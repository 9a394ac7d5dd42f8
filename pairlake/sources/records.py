"""Record tables: JSON scan, chunked record files with shape metadata, memoised results."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pairlake.operators.shapes import infer_shapes


def scan_json(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """JSON objects from plain or gzip files, one (or one array) per file; lines if not ``multi_line``."""
    reader = spark.read.option("multiLine", str(multi_line).lower())
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_records(df: DataFrame, path: str, chunk: int = 1_000_000) -> None:
    """Record files of at most ``chunk`` rows, plus their shapes in ``_shapes``.

    50 gives the small training chunks of older pipelines; the default suits
    large tables.
    """
    df.write.mode("overwrite").option("maxRecordsPerFile", chunk).parquet(path)
    stored = df.sparkSession.read.parquet(path)  # shapes from the stored rows, not a second run of df
    infer_shapes(stored).coalesce(1).write.mode("overwrite").json(path + "/_shapes")


def read_records(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> DataFrame:
    """The records without the excluded attributes, which the scan does not even read."""
    return spark.read.parquet(path).drop(*exclude)


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, level int, size int, type string").json(path + "/_shapes")


# ---- runs of differing schemas under one root -------------------------------


def add_run(df: DataFrame, root: str, run: str | None = None, chunk: int = 1_000_000) -> str:
    """One more run of records below ``root``, with its own schema beside it; the name of the run.

    The schema is written last, so a run that was lost half-way is not read. A run
    written again under its name takes the place of the earlier one.
    """
    run = run or uuid.uuid4().hex
    df.write.mode("overwrite").option("maxRecordsPerFile", chunk).parquet(f"{root}/rows/{run}")
    schema = df.sparkSession.createDataFrame([(run, df.schema.json())], "run string, schema string")
    schema.coalesce(1).write.mode("overwrite").json(f"{root}/schemas/{run}")
    return run


#: Whole and broken numbers, from narrow to wide.
_WHOLE, _BROKEN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)


def widened(a: T.DataType, b: T.DataType, where: str = "") -> T.DataType:
    """The narrowest type that holds the values of both; an error where there is none.

    Whole numbers widen to longer ones, and with broken ones to double; dates to
    timestamps; arrays, maps and structs by their parts. A type that is void (only nulls) gives way.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max((a, b), key=lambda t: _WHOLE.index(type(t)))
    if isinstance(a, _WHOLE + _BROKEN) and isinstance(b, _WHOLE + _BROKEN):
        return T.DoubleType()
    if {type(a), type(b)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widened(a.elementType, b.elementType, f"{where}[]"), a.containsNull or b.containsNull)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(
            widened(a.keyType, b.keyType, f"{where} keys"), widened(a.valueType, b.valueType, f"{where} values"),
            a.valueContainsNull or b.valueContainsNull)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged(a, b, f"{where}.")
    raise ValueError(f"{where} is {a.simpleString()} in one run and {b.simpleString()} in another")


def merged(a: T.StructType, b: T.StructType, where: str = "") -> T.StructType:
    """All fields of both, the first one's in front; a field that one lacks may be null."""
    known = {f.name: f for f in b.fields}
    out = [
        T.StructField(f.name, widened(f.dataType, known[f.name].dataType, where + f.name), f.nullable or known[f.name].nullable)
        if f.name in known else T.StructField(f.name, f.dataType, True)
        for f in a.fields
    ]
    names = {f.name for f in a.fields}
    return T.StructType(out + [T.StructField(f.name, f.dataType, True) for f in b.fields if f.name not in names])


def read_runs(spark: SparkSession, root: str, exclude: Sequence[str] = ()) -> DataFrame:
    """The records of all runs below ``root`` as one table: fields by ``merged``, null where a run lacks them.

    Runs of one schema are one scan; the scan of a run reads only what it has and
    is asked for. Null types of whole columns need a type from some run.
    """
    listed = spark.read.schema("run string, schema string").json(f"{root}/schemas/*").orderBy("run").collect()  # a row a run
    runs: dict[str, list[str]] = {}
    for row in listed:
        runs.setdefault(row["schema"], []).append(f"{root}/rows/{row['run']}")
    kinds = {text: T.StructType.fromJson(json.loads(text)) for text in runs}
    whole = reduce(merged, kinds.values())
    whole = T.StructType([f for f in whole.fields if f.name not in exclude])
    parts = []
    for text, paths in runs.items():
        own = {f.name: f.dataType for f in kinds[text].fields}
        rows = spark.read.schema(kinds[text]).parquet(*paths)
        parts.append(rows.select(*[
            _fitted(F.col(f"`{f.name}`"), own[f.name], f.dataType).alias(f.name) if f.name in own else F.lit(None).cast(f.dataType).alias(f.name)
            for f in whole.fields
        ]))
    return reduce(DataFrame.unionByName, parts)


def _fitted(value, own: T.DataType, wide: T.DataType):
    """``value`` of the type ``own`` as ``wide``; structs by name, as casts go by place."""
    if own == wide:
        return value
    if isinstance(own, T.StructType):
        has = {f.name: f.dataType for f in own.fields}
        fields = [
            _fitted(value[f.name], has[f.name], f.dataType).alias(f.name) if f.name in has else F.lit(None).cast(f.dataType).alias(f.name)
            for f in wide.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(own, T.ArrayType):
        return F.transform(value, lambda x: _fitted(x, own.elementType, wide.elementType))
    return value.cast(wide)


# ---- results stored by their arguments --------------------------------------


def _plan_of(df: DataFrame) -> str | None:
    """What a DataFrame computes as text, or None where the plan does not tell: rows from memory, and caller's functions."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    leaves, files = plan.collectLeaves(), []
    for k in range(leaves.size()):
        name = leaves.apply(k).getClass().getSimpleName()
        if name == "LogicalRelation":
            relation = leaves.apply(k).relation()
            if relation.getClass().getSimpleName() != "HadoopFsRelation":
                return None
            roots = relation.location().rootPaths()
            files.append([roots.apply(i).toString() for i in range(roots.size())])
        elif name not in ("Range", "OneRowRelation", "OneRowRelation$"):
            return None
    known = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")  # whole lists of fields
    try:
        names, shown = plan.toJSON(), plan.canonicalized().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", known)
    # two functions of the caller may look alike
    if re.search(r'"class":"[^"]*(Python|Pandas|Arrow|UDF|Deserialize|MapElements|MapPartitions|Rand)', names):
        return None
    return json.dumps([shown, df.schema.json(), files])


def _rows_of(df: DataFrame) -> str:
    """A digest of the rows, however they are ordered; one pass."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    sums = [F.sum(F.xxhash64(F.lit(k), row).cast("decimal(38,0)")) for k in range(2)]
    n, *hashes = df.agg(F.count("*"), *sums).first()
    return json.dumps([df.schema.json(), n, [str(h) for h in hashes]])


def _shown(value) -> list:
    """``value`` with its type, so that different arguments never look alike."""
    if isinstance(value, DataFrame):
        plan = _plan_of(value)
        return ["rows", _rows_of(value)] if plan is None else ["plan", plan]
    if value is None or isinstance(value, (bool, int, str)):
        return [type(value).__name__, value]
    if isinstance(value, float):
        return ["float", value.hex()]
    if isinstance(value, (bytes, bytearray)):
        return ["bytes", bytes(value).hex()]
    if isinstance(value, Mapping):
        return ["map", sorted(([_shown(k), _shown(v)] for k, v in value.items()), key=json.dumps)]
    if isinstance(value, (set, frozenset)):
        return ["set", sorted(map(_shown, value), key=json.dumps)]
    if isinstance(value, (list, tuple)):
        return [type(value).__name__, [_shown(v) for v in value]]
    if callable(value):
        return ["function", value.__module__, value.__qualname__]
    return [f"{type(value).__module__}.{type(value).__qualname__}", repr(value)]


def argument_key(*args, **kwargs) -> str:
    """Folder name for an argument list: a digest of its values with their types.

    A DataFrame stands for what it computes from which files, or, where the plan
    does not tell that, for its rows.
    """
    told = json.dumps([[_shown(a) for a in args], sorted([k, _shown(v)] for k, v in kwargs.items())])
    return hashlib.sha256(told.encode("utf-8", "surrogatepass")).hexdigest()


def _commit(spark: SparkSession, base: str, run: str, total: int) -> None:
    """Makes ``run`` the one that is read from ``base``, unless another one is already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    note, goal = path(f"{run}/note"), path(f"{base}/committed")
    out = note.getFileSystem(conf).create(note)
    out.write(bytearray(json.dumps([run, total]).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(note.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(note, goal, options)  # fails where the goal is there: one of two writers wins
    except Exception as error:  # the Java error comes wrapped
        if "FileAlreadyExistsException" not in str(error):
            raise


def _committed(spark: SparkSession, base: str) -> tuple[str, int] | None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/committed")
    if not path.getFileSystem(conf).exists(path):
        return None
    return tuple(json.loads("".join(r[0] for r in spark.read.text(f"{base}/committed").collect())))


def materialise(spark: SparkSession, root: str, fn: Callable[..., Sequence[DataFrame]], *args, version: str = "", **kwargs) -> list[DataFrame]:
    """The results of ``fn(*args)``, computed and stored at the first call, read at later ones.

    The key is the function's name, ``version`` (change it with the function or
    its data) and the arguments. Each run writes numbered folders below a name of
    its own and is known only once its list is complete; where two writers finish,
    the first is the one that both read from then on.
    """
    base = f"{root.rstrip('/')}/{argument_key(fn.__module__, fn.__qualname__, version)}/{argument_key(*args, **kwargs)}"
    if _committed(spark, base) is None:
        run = f"{base}/{uuid.uuid4().hex}"
        results = list(fn(*args, **kwargs))
        for i, df in enumerate(results):
            df.write.parquet(f"{run}/{i}")
        _commit(spark, base, run, len(results))
    run, total = _committed(spark, base)
    return [spark.read.parquet(f"{run}/{i}") for i in range(total)]
