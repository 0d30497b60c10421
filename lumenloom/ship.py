"""Make the package importable in the executors' Python workers, wherever they run."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once a session."""
    mark = spark.sparkContext.applicationId
    if mark in _shipped:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    # only the driver reads this file: it serves it to the executors
    target = Path(tempfile.mkdtemp(prefix="lumenloom-code-")) / "lumenloom_code.zip"
    target.write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(mark)
