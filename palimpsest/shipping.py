"""The package on the executors' path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))

_shipped: set[str] = set()
_folder: list[tempfile.TemporaryDirectory] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, once.

    Functions of the package run in workers that need not see the driver's files; Spark copies the archive to them, also
    to executors that join later, so the archive stays until the driver ends.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    if not _folder:
        _folder.append(tempfile.TemporaryDirectory(prefix="palimpsest-"))
        with zipfile.ZipFile(os.path.join(_folder[0].name, "palimpsest.zip"), "w") as archive:
            for at, _, names in os.walk(PACKAGE):
                for name in names:
                    if name.endswith(".py"):
                        whole = os.path.join(at, name)
                        archive.write(whole, os.path.join("palimpsest", os.path.relpath(whole, PACKAGE)))
    context.addPyFile(os.path.join(_folder[0].name, "palimpsest.zip"))
    _shipped.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after the package was sent."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
