"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(
    app: str = "answerloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``master`` and ``shuffle_partitions`` are left alone unless given, so a
    cluster's own configuration wins.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_answerloom_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="answerloom-code-")) / "answerloom.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for module in sorted(root.rglob("*.py")):
            packed.write(module, module.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._answerloom_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="answerloom-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def new_folder(spark: SparkSession, label: str = "rows") -> str:
    """The name of a folder of its own below the checkpoint folder, removed when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/answerloom-{label}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{path}/{label}"


def _files(spark: SparkSession, path: str):
    """The Hadoop path of ``path``, and the file context that has it."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    absolute = folder.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(folder)
    return absolute, context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        absolute.toUri(), context._jsc.hadoopConfiguration()
    )


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, wherever Spark stores it."""
    folder, files = _files(spark, path)
    return files.util().exists(folder)


def rename_folder(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False if the target is there already. Missing parents are made."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    old, files = _files(spark, source)
    new, _ = _files(spark, target)
    if files.util().exists(new):
        return False
    parent = new.getParent()
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(parent)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.valueOf("NONE")  # does not replace, nor move into, what is there
    try:
        files.rename(old, new, options)
    except Py4JJavaError as refused:
        if "AlreadyExists" in str(refused.java_exception):
            return False
        raise
    return True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    Parquet rather than a serialised checkpoint: what is read later can skip
    columns, and its size is known to the planner. Lost executors cost nothing,
    the files are not theirs.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_and_measure(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`cut_lineage`, and aggregates over the rows that are taken while they are written."""
    seen = Observation()
    return cut_lineage(df.observe(seen, *(value.alias(name) for name, value in metrics.items()))), seen.get
