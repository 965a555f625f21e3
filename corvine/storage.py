"""Tables kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where the setting is absent a
    local session takes a temporary folder; a cluster refuses."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="corvine-")
    return _OWN[app]


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, in one folder for each
    value of ``by`` if given.

    Cuts the lineage so that later stages never repeat the work and survive the
    loss of an executor. Each call writes a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table ``materialize`` wrote that nothing reads any more."""
    spark = df.sparkSession
    own = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if p.getParent().toUri().getPath() == own:
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bounded(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted and weighed first, stay
    within ``most_bytes``; else as it is, for a join by shuffle. Give it tables
    that are cheap to read twice."""
    fixed = sum(8 if t in ("bigint", "int", "double", "date", "timestamp") else 24 for _, t in df.dtypes) + 16
    parts = [F.coalesce(F.length(c) if t == "string" else F.size(c) * 8, F.lit(0)) for c, t in df.dtypes if t == "string" or t.startswith("array<")]
    n, extra = df.agg(F.count("*"), F.coalesce(F.sum(sum(parts, F.lit(0)).cast("bigint")), F.lit(0))).first()
    return F.broadcast(df) if n * fixed + extra <= most_bytes else df


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """``name``.parquet below ``base``, a file or a folder of files."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core work: shuffle ``df`` round-robin if its scan has fewer
    partitions than there are cores, else leave it alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
