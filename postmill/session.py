"""Session helpers: a local session for tests and benchmarks, and a way to give workers this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from postmill.sources.scratch import SCRATCH

_shipped: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship_package(spark)
    local_scratch(spark)
    return spark


def local_scratch(spark: SparkSession) -> None:
    """A temporary scratch folder for a session on one machine that names none."""
    named = spark.conf.get(SCRATCH, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] == "local":
        spark.conf.set(SCRATCH, tempfile.mkdtemp(prefix="postmill-"))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers; not needed when it is installed or passed by ``--py-files``."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="postmill-")) / "postmill.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for module in sorted(package.rglob("*.py")):
            bundle.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
