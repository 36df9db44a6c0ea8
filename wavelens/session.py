"""Sessions, and the package on the executors."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def session(name: str = "wavelens", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Hand this package to Python workers, once for each application, unless their path has it."""
    here = Path(__file__).resolve().parent
    if str(here.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _sent:
        return
    place = shutil.make_archive(tempfile.mkdtemp(prefix="wavelens-") + "/wavelens", "zip", here.parent, here.name)
    spark.sparkContext.addPyFile(place)
    _sent.add(spark.sparkContext.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, after ship."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
