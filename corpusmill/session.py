"""What a session needs to run the library's Python functions on its executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; a temporary one only in local mode without that."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once for each application, wherever it was imported from."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="corpusmill-")) / "corpusmill.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, Path(package.name) / path.relative_to(package))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
