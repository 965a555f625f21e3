"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: A union whose parts are partitioned alike is taken for partitioned as well, even where
#: adaptive execution has joined partitions of the parts in different ways: a grouping
#: after it then gives several rows a key. Off, such groupings shuffle.
SAFE = {"spark.sql.unionOutputPartitioning": "false"}


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.master(master)
    for k, v in {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **SAFE,
        **conf,
    }.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession, root: Path) -> None:
    """Send the package below ``root`` to the executors, once per application,
    so that Python workers find it wherever they were started, and set what the
    operators rely on."""
    for k, v in SAFE.items():
        spark.conf.set(k, v)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    to = Path(tempfile.mkdtemp(prefix="corvine-code-")) / "corvine.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((root / "corvine").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)
