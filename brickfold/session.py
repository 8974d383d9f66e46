"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_own_roots: dict[str, str] = {}


def build_session(app: str = "brickfold", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew-join splitting)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", "12g")
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; only a local session may pick its own."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str = "state") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts lineage, survives executor loss, and gives the optimizer the true file size, so that a
    following join is broadcast only when the table really is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows a task of an iterative fit holds at most when there are more of them than cores can share.
ROWS_PER_TASK = 250_000


def spread(df: DataFrame, name: str = "spread") -> DataFrame:
    """:func:`written`, with the rows dealt evenly to at least as many files as there are cores, the same way each time.

    A small table is otherwise written as few files of one row group each, and whatever passes over it again and again runs on as many cores.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return written(df.repartition(tasks, digest).sortWithinPartitions(digest), name)


def share_checkpoints(spark: SparkSession) -> None:
    """Let Spark ML cut the lineage of long fits in the shared scratch folder, unless a folder is set already."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(spark))


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    root = scratch_root(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = to_path(spark._jvm.java.net.URI(folder))
        if to_path(root).toUri().getPath() != path.getParent().toUri().getPath():
            raise ValueError(f"{folder} is no table of the scratch folder {root}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


SMALL_BYTES = 16 << 20


def settled(df: DataFrame, name: str = "state", limit_bytes: int = SMALL_BYTES) -> DataFrame:
    """``df`` itself when its inputs are small enough to recompute, else a written table.

    A plan that multiplies rows or draws values is written at any size: the first escapes the estimate, the second
    would show every reader other values.
    """
    stable = df._jdf.queryExecution().optimizedPlan().deterministic() and "Generate" not in plan_nodes(df)
    return df if stable and plan_bytes(df) <= limit_bytes else written(df, name)


#: Plan nodes that cost no shuffle, join, Python or row multiplication when run again.
ROW_WISE = {"Project", "Filter", "LogicalRelation", "DataSourceV2ScanRelation", "LocalRelation", "LogicalRDD", "Range", "Union"}


def plan_nodes(df: DataFrame) -> set[str]:
    """Class names of the nodes of the optimized plan."""
    todo, names = [df._jdf.queryExecution().optimizedPlan()], set()
    while todo:
        node = todo.pop()
        names.add(node.getClass().getSimpleName())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return names


def is_narrow(df: DataFrame) -> bool:
    """True when re-reading ``df`` repeats no shuffle or join (a scan with row-wise work on top)."""
    return plan_nodes(df) <= ROW_WISE


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: exact file sizes for a written table, an upper bound otherwise."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
