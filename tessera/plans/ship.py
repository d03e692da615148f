"""Sending this package to the executors' Python workers."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.plans.scratch import shared_folder

_sent: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Once per application, hands the package to Spark for distribution from the shared folder, so that
    workers need no installation. Sessions that run with it on PYTHONPATH everywhere are unaffected."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        _sent.add(context.applicationId)
        package = Path(__file__).resolve().parent.parent
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        at = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}.zip"
        path = context._jvm.org.apache.hadoop.fs.Path(at)
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(held.getvalue()))
        out.close()
        context.addPyFile(at)
    return spark
