"""Sessions, and making this package importable on every executor."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("loreweave")
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers of this application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="loreweave-")) / "loreweave.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped[app] = str(path)


def shipped(query):
    """``query`` with the package shipped before it plans."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
