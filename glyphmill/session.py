"""Session helpers: the shared checkpoint folder and the size of a shuffle."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent on a single machine is a local folder taken; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="glyphmill-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there, so that branches do not recompute it.

    Reliable checkpoint: it survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session; explicit repartitions scale with it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers that would not find it: once per context, as with ``--py-files``.

    Workers see PYTHONPATH and, on the same machine, the working directory; only where neither leads to the package is
    it sent, as a zip of its source files through Spark's own file server.
    """
    root = Path(__file__).resolve().parent
    seen = [Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    context = spark.sparkContext
    if root.parent in seen or getattr(context, "_glyphmill_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="glyphmill-package-"))
    with zipfile.ZipFile(folder / "glyphmill.zip", "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(folder / "glyphmill.zip"))
    context._glyphmill_shipped = True
