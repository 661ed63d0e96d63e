"""Where a job may write tables of its own, and settings while it writes them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new, empty folder path for one run, inside the shared folder the cluster names.

    The folder comes from ``spark.checkpoint.dir``. Only a local-mode session without that
    setting gets a temporary folder, since there all executors share the machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="clipatlas-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for what is written meanwhile."""
    names = {n: f"spark.sql.{n.replace('__', '.')}" for n in values}
    before = {n: spark.conf.get(names[n]) for n in values}
    try:
        for n, value in values.items():
            spark.conf.set(names[n], value)
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(names[n], value)
