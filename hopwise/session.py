"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files unless workers find it on their PYTHONPATH or in their folder."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(":") or Path.cwd() == root:
        return spark
    path = Path(tempfile.mkdtemp(prefix="hopwise-")) / "hopwise.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted((root / "hopwise").rglob("*.py")):
            out.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
    return spark
