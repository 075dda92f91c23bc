"""Making the package importable on executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes in an Arrow batch, unless the application sets them: a task holds a batch several times (in the JVM, in
#: Python, as Python objects, and its results), so the default of 64 MB takes a few hundred MB for each core.
ARROW_BYTES = "2m"
#: What the session says where nobody has set it.
UNSET_ARROW_BYTES = "67108864b"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each application; like ``--py-files``."""
    context = spark.sparkContext
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not context.getConf().contains(key) and spark.conf.get(key) == UNSET_ARROW_BYTES:
        spark.conf.set(key, ARROW_BYTES)
    if getattr(context, "_tidemark_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():
        to = os.path.join(tempfile.mkdtemp(prefix="tidemark-py-"), "tidemark.zip")
        with zipfile.ZipFile(to, "w") as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        context.addPyFile(to)
    context._tidemark_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir.

    Where none is set, a temporary one serves a local master; on a cluster executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/tidemark/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
