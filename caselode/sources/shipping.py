"""Sending the library to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    to = os.path.join(tempfile.mkdtemp(prefix="caselode-"), "caselode.zip")
    with open(to, "wb") as f:
        f.write(packed.getvalue())
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)
