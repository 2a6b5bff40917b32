"""The session that tests, benchmarks and the command line use; clusters bring their own."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, so that a session that was begun in any folder, on any machine, finds it there."""
    home = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spindle-package-"), "spindle.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*")):
            if f.suffix in (".py", ".toml"):
                z.write(f, str(Path("spindle", f.relative_to(home))))
    spark.sparkContext.addPyFile(path)


def session(cores: str | int = "*", name: str = "spindle", **conf: str) -> SparkSession:
    n = os.cpu_count() if cores == "*" else int(cores)
    base = {
        "spark.master": f"local[{cores}]", "spark.app.name": name, "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(n), "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("SPINDLE_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
