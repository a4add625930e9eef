"""Session helpers: a tuned local session, and shipping the package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "haplomesh") -> SparkSession:
    """A session for one machine; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors reach; on one machine a temporary one stands in."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="haplomesh-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python this package, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_haplomesh_shipped", False):
        return spark
    path = Path(tempfile.mkdtemp(prefix="haplomesh-")) / "haplomesh.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f"{ROOT.name}/{f.relative_to(ROOT)}")
    sc.addPyFile(str(path))
    sc._haplomesh_shipped = True
    return spark
