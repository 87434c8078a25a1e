"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession | None = None) -> None:
    """Sends the package's sources to the workers of a session, once.

    Functions that run in workers are pickled by reference to their module, which
    a worker can import only if it has the package. An installed package is the same code.
    """
    spark = spark or SparkSession.active()
    context = spark.sparkContext
    if getattr(context, "_tidebook_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="tidebook-src-"))
    archive = folder / "tidebook_src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    # state processors start in a worker beside the driver, which added files do not reach
    held = context.environment.get("PYTHONPATH")
    context.environment["PYTHONPATH"] = os.pathsep.join([str(archive), *([held] if held else [])])
    context._tidebook_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`).

    Only a local master without the setting gets a temporary folder; on a cluster a
    missing setting is an error, as a local folder would lose rows.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
            folder = tempfile.mkdtemp(prefix="tidebook-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
