"""Sends this package to the executors, for sessions whose workers can't import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package and the modules beside it to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="terrane-")) / "terrane_modules.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for p in [*sorted((root / "terrane").rglob("*.py")), *root.glob("corpus_*.py")]:
            out.write(p, p.relative_to(root))
    context.addPyFile(str(target))
    _SENT.add(context.applicationId)
