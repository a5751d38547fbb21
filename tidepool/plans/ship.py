"""Ships this package to the executors, for sessions whose workers can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: add the package as a zip, unless PYTHONPATH has it."""
    sc = spark.sparkContext
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in on_path or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    at = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "tidepool.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted((ROOT / "tidepool").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(at))
