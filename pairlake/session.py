"""Session helpers: builder defaults and lineage cuts on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of a batch after ``small_batches``.
SMALL_ROWS, SMALL_BYTES = 1000, 4 << 20

#: Tables that ``cut`` wrote and ``drop_cuts`` has not deleted yet, and the session of each.
CUTS: list[str] = []
OWNERS: dict[str, str] = {}


def build(master: str = "local[8]", app: str = "pairlake", **conf: str) -> SparkSession:
    """A session with AQE on; shuffle partitions are left to AQE coalescing."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables.

    Comes from ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder is taken, in local mode only: on a cluster the executors would not
    see it.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pairlake-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, survives the loss of executors, gives every reader the
    same rows, and unlike an RDD checkpoint keeps column pruning and sizes.
    ``codec``: for whole texts, how the files are packed, if not as the session has it.
    """
    path = scratch(df.sparkSession, "cut")
    CUTS.append(path)
    OWNERS[path] = _session(df.sparkSession)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def cuts(spark: SparkSession) -> list[str]:
    """The tables that ``cut`` wrote in this session and that are still there."""
    return [path for path in CUTS if OWNERS[path] == _session(spark)]


def drop_cuts(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Deletes tables that ``cut`` wrote in this session, all or the given ones; call it when no query needs them any more."""
    conf, done = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for path in cuts(spark) if paths is None else [p for p in paths if p in cuts(spark)]:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        done += bool(target.getFileSystem(conf).delete(target, True))
        CUTS.remove(path)
        del OWNERS[path]
    return done


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in smaller Arrow batches from now on, in this session.

    A worker holds a batch several times over (as it came, as Python objects, as results), keeps
    what memory it once took, and lives on beside those of other steps. Whole texts in the usual
    batches of 10,000 rows take some hundred MB a worker, whatever the step does with them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SMALL_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SMALL_BYTES))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` for heavy work per row: unchanged if it has a partition per core, else hashed by key.

    A corpus of few files would run in a few tasks; a
    large one is left where it is and pays no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Small rows with costly work each, over all shuffle partitions.

    The explicit number keeps AQE from merging them by size, which says
    nothing about the work.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def by_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by key, over as many partitions as ``fan_out`` takes.

    For rows that are turned into many: what is then grouped, windowed or joined by the key
    stays where it is, so the few rows are shuffled and not the many, and a task holds its
    share of them however well they compress. Null keys are dealt like one key.
    """
    return fan_out(df, key)
