"""The registry of passes as a versioned table: readers see a whole version, writers don't lose each other's rows."""

from __future__ import annotations

import os
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from verdictlab.sources.corpus import latest_per_label

SCHEMA = "label string, git_sha string, comment_count int, created_at timestamp_ntz"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """``(version, folder)`` of all versions, the newest last. A pointer's name has both."""
    p, fs = _fs(spark, f"{path}/versions")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((int(n), _read(spark, f"{path}/versions/{n}")) for n in names if n.isdigit())


def _read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).first()[0]


def _claim(spark: SparkSession, path: str, version: int, folder: str) -> bool:
    """Make the pointer of a version with its content, unless somebody else has made it. The content is written beside it
    first; then one step gives it its name: a hard link on a local disk, elsewhere a rename that never replaces."""
    p, fs = _fs(spark, f"{path}/versions")
    fs.mkdirs(p)
    name, new = f"{path}/versions/{version:012d}", f"{path}/versions/new-{uuid.uuid4().hex}"
    source, target = _fs(spark, new)[0], _fs(spark, name)[0]
    out = fs.create(source, False)
    out.write(bytearray(folder.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(urlparse(new).path, urlparse(name).path)
            return True
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(source, target, none)
        return True
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(source, False)


def read_passes(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or an older one; no rows where there is none yet."""
    found = [f for v, f in _pointers(spark, path) if version in (None, v)]
    return spark.read.schema(SCHEMA).parquet(f"{path}/data/{found[-1]}") if found else spark.createDataFrame([], SCHEMA)


def upsert_passes(spark: SparkSession, path: str, new: DataFrame, tries: int = 50) -> int:
    """Put passes in by label (the last of a label stays, whichever writer comes first), and tell the version.

    The next version is written to a folder of its own and becomes the registry when its pointer is made, which happens for
    one writer only; another one begins anew from that version. A writer that dies before leaves a folder that nobody
    reads. Labels are few rows; each version has all of them.
    """
    new = new.select("label", "git_sha", "comment_count", "created_at")
    for n in range(tries):
        known = _pointers(spark, path)
        now = spark.read.schema(SCHEMA).parquet(f"{path}/data/{known[-1][1]}") if known else spark.createDataFrame([], SCHEMA)
        folder = uuid.uuid4().hex
        latest_per_label(now.unionByName(new)).write.parquet(f"{path}/data/{folder}")
        version = known[-1][0] + 1 if known else 1
        if _claim(spark, path, version, folder):
            return version
        time.sleep(min(1.0, 0.02 * 2**n) * (0.5 + uuid.uuid4().int % 1000 / 1000))
    raise RuntimeError(f"{path}: {tries} other writers came first")
