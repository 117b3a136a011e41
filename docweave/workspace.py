"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from docweave.sources.files import remove

#: The setting under which Spark removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below ``spark.checkpoint.dir``.

    Without that setting a folder of this machine is used, but only when the whole
    session runs on this machine: on a cluster its executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="docweave-")
    return f"{root.rstrip('/')}/docweave/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession, purpose: str) -> Iterator[str]:
    """:func:`shared_folder` for what is not read after this block: it goes with the block, whether that fails or not."""
    folder = shared_folder(spark, purpose)
    try:
        yield folder
    finally:
        remove(spark, folder)
