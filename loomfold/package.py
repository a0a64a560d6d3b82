"""Sends this package to the Python workers, so that functions defined in it can be loaded there
wherever the driver was started."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package's sources, served to executors by the driver."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    at = os.path.join(tempfile.mkdtemp(prefix="package-"), "loomfold.zip")
    with open(at, "wb") as file:
        file.write(raw.getvalue())
    context.addPyFile(at)
    _sent.add(context.applicationId)
