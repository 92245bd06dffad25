"""Session settings and the two ways the library materialises a DataFrame."""

from __future__ import annotations

import gc
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings a fresh session gets. All of them can be overridden by the caller.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "variantloom", **conf: str) -> SparkSession:
    """A session with the library's defaults; an active session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession | None = None) -> None:
    """Let executors import this package, once per session (the active one by default).

    On a cluster whose workers do not share the driver's path, the package is sent as a zip; where the
    workers can see the source folder (or in local mode) this only adds one small file. Every operator whose
    plan runs this package's Python on executors calls it.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    context = spark.sparkContext
    if getattr(context, "_variantloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    import zipfile

    out = os.path.join(tempfile.mkdtemp(prefix="variantloom"), "variantloom_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(Path("variantloom") / path.relative_to(root)))
    context.addPyFile(out)
    context._variantloom_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and cut its lineage through the folder all executors share.

    The folder is ``spark.checkpoint.dir`` of the session. Where that is unset, a local session (tests, a
    laptop) uses a folder of this machine; on a cluster it is an error. A checkpoint is deleted once nothing
    refers to it any more.
    """
    context = df.sparkSession.sparkContext
    context._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="variantloom-checkpoint"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Delete the shuffle files behind what was cut; Spark does so once garbage is collected, which a driver with room does late. What the last job used stays until the next one."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows up to which a side of a join may be broadcast.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written once, and marked for broadcast only if it was counted to have at most ``rows`` rows.

    For narrow rows (keys and numbers). Larger ones are left to a shuffled join, which adaptive execution
    splits where a key is hot.
    """
    done = cut(df)
    return F.broadcast(done) if done.limit(rows + 1).count() <= rows else done


#: Bytes of source files a task of costly work gets, and the most tasks that are asked for.
SPREAD_BYTES, SPREAD_TASKS = 64 << 20, 100_000


def spread(df: DataFrame, *columns: str, times: int = 1) -> DataFrame:
    """``df`` over enough tasks for work whose cost is not its bytes, by columns if given.

    Adaptive execution joins small partitions by size, which would leave alignments of many short texts to
    one task; a given number of partitions is kept. The number follows the bytes of the tables and the
    partitions of the checkpoints ``df`` is read from, so that a task's share stays the same at any size, and
    is at least twice the session's cores; ``times`` as many where tasks are very unequal. Rows that were spread
    already and only had columns added stay where they are.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    while not columns and node.nodeName() in ("Project", "ArrowEvalPython", "Filter"):
        node = node.child()
    spread_to = node.numPartitions() if not columns and node.nodeName() == "Repartition" and node.shuffle() else 0
    leaves, read, held = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0, 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.nodeName() == "LogicalRDD":  # a checkpoint, whose bytes Spark does not know
            held = max(held, leaf.rdd().getNumPartitions())
        else:
            read += int(str(leaf.stats().sizeInBytes()))
    tasks = times * max(2 * df.sparkSession.sparkContext.defaultParallelism, held, read // SPREAD_BYTES)
    tasks = int(min(SPREAD_TASKS, tasks))
    return df if spread_to >= tasks else df.repartition(tasks, *columns)
