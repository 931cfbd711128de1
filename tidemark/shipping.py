"""Make this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, unless their path holds it already (PYTHONPATH or the working folder)."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    context = spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if context.applicationId in _shipped or root in map(os.path.abspath, filter(None, known)):
        return
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
