"""Make this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ensure_on_workers(spark: SparkSession) -> None:
    """Send the package to the executors once per Spark context, through Spark's own file distribution."""
    sc = spark.sparkContext
    if getattr(sc, "_mosaica_sent", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="mosaica-"), "mosaica.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("mosaica", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._mosaica_sent = True
