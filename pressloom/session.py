"""Session helpers: shared scratch space, lineage cuts, table loading."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pressloom", master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent, in local mode, a temporary folder is made and registered: on a
    cluster executors would write to disks of their own and reads would miss rows, so that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return str(known.get()).rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="pressloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where they would not find it by themselves.

    Local workers get its parent folder on their path; on a cluster a zip of the package is sent along.
    Nothing is done if ``PYTHONPATH`` names the folder already, or twice for one context.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in (sc.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root in known:
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    if not sc.master.startswith("local"):
        base = os.path.join(tempfile.mkdtemp(prefix="pressloom-"), "pressloom")
        sc.addPyFile(shutil.make_archive(base, "zip", root, "pressloom"))


#: Folders this process has made, for :func:`clear_scratch`.
_made: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    _made.append(f"{shared_dir(spark)}/pressloom/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> int:
    """Removes all tables cut by this process; call it when no result that reads them is needed."""
    n = len(_made)
    while _made:
        _delete(spark, _made.pop())
    return n


def cut(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    The result no longer depends on executors that may be lost, and its plan starts at a scan with
    known size, so later joins are planned from real statistics.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pressloom_path = path  # type: ignore[attr-defined]
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove the files behind a frame made by :func:`cut` (no later action may read it)."""
    path = getattr(df, "_pressloom_path", None)
    if path is None:
        return
    _delete(df.sparkSession, path)
    if path in _made:
        _made.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fresh(taken: list[str], stem: str) -> str:
    """A column name that does not clash with ``taken`` (case-insensitive, as Spark resolves)."""
    low = {c.lower() for c in taken}
    name = stem
    while name.lower() in low:
        name = "_" + name
    return name
