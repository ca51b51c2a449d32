"""Sends the package to the executors, for sessions whose workers can't import it from a path of their own."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once an application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    folder = tempfile.mkdtemp(prefix="phrasewright-")
    path = os.path.join(folder, "phrasewright.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(os.path.join(_ROOT, "phrasewright")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
