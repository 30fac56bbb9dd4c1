"""Makes this package importable in Python workers wherever the driver runs from."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ensure_importable(spark: SparkSession) -> None:
    """Ships the package to the workers, unless PYTHONPATH already has it (once an application)."""
    sc = spark.sparkContext
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_helixframe_shipped", False):
        return
    d = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, d, True)
    path = os.path.join(d, "helixframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, f"helixframe/{p.relative_to(ROOT)}")
    sc.addPyFile(path)
    sc._helixframe_shipped = True
