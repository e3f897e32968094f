"""Where intermediate tables go, and how tasks open files that Spark has listed."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is not set and the master is local, as in tests, a temporary folder
    of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="marginalia-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name in Spark's file systems."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of Spark's file systems, if it is there."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers behind ``prefix`` in the names of what is in a folder; none if there is no folder."""
    if not exists(spark, folder):
        return []
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    names = [status.getPath().getName() for status in listed]
    return [int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit()]


# Names by which Spark knows stores that Arrow opens under another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


@functools.lru_cache(64)
def _store(scheme: str, authority: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{authority}/")


def file_system(uri: str):
    """(file system, path) of a file by the name that Spark gives it: a URI whose path is not encoded, or an
    absolute path. A store is opened once per worker process."""
    from pyarrow import fs

    found = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)", uri, re.S)
    if found is None or found[1].lower() == "file":
        path = uri if found is None else found[3]
        if not path.startswith("/"):
            raise ValueError(f"no absolute path: {uri!r}")
        return fs.LocalFileSystem(), path
    system, base = _store(found[1].lower(), found[2] or "")
    return system, base.rstrip("/") + found[3]
