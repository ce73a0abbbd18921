"""This package on the executors, for functions that run in their Python."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless PYTHONPATH already leads their Python to it."""
    root = Path(__file__).resolve().parents[1]
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    context = spark.sparkContext
    if root in on_path or getattr(context, "_tessella_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tessella-")  # Spark's file server on the driver reads it as long as executors may ask
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "tessella.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.joinpath("tessella").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))
    context._tessella_shipped = True
