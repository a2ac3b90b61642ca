"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ZIP = "cairn_package.zip"


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files once.  Workers fetch it from the driver, so executors need no copy of their own."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    if not root.is_dir() or any(str(f).endswith(_ZIP) for f in context.listFiles):
        return
    folder = tempfile.mkdtemp(prefix="cairn-")  # the driver's own; workers get the file from its server
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/{_ZIP}"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(path)


def ship_active() -> None:
    """:func:`ship` for the session in use, where a column is made that starts Python and no frame is at hand."""
    if spark := SparkSession.getActiveSession():
        ship(spark)
