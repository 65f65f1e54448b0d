"""Makes this package importable on the executors."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors as a zip file, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    top = pathlib.Path(__file__).parent
    made = pathlib.Path(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(made, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, pathlib.Path(top.name) / file.relative_to(top))
    spark.sparkContext.addPyFile(str(made))
    _shipped.add(application)
