"""A table whose appends are numbered entries: what an entry doesn't name can't be seen, and two writers can't take one number.

Layout under a root in shared storage: `data/<random>` holds an attempt's rows; `log/<number>` is a small file with the names of the
folders that a version adds. An entry is put only if its number is free, by the file system's create without
overwrite; a writer that loses the race reads what the winner added and tries again. A lost attempt leaves rows that no entry
names, which vacuum() removes.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteledger.operators.history import new_rows


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def entry_path(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/log/{number:020d}"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the entries there are, rising."""
    fs, at = _fs(spark, f"{root.rstrip('/')}/log/*")
    return sorted(int(s.getPath().getName()) for s in fs.globStatus(at) or [] if s.getPath().getName().isdigit())


def put_if_absent(spark: SparkSession, root: str, number: int, value: dict) -> bool:
    """Write entry number unless another writer has; whether it was written.

    A create without overwrite is atomic on HDFS and on object stores with conditional puts. Spark's file system for local and
    mounted folders only looks before it creates, so there a whole file is linked to its name, which fails if that is taken.
    """
    fs, at = _fs(spark, entry_path(root, number))
    if fs.getScheme() == "file":
        name = at.toUri().getPath()
        os.makedirs(os.path.dirname(name), exist_ok=True)
        whole = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        with open(whole, "w", encoding="utf-8") as f:
            json.dump(value, f)
        try:
            os.link(whole, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(whole)
        return True
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "already exists" in str(e) or "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    return True


def entry(spark: SparkSession, root: str, number: int) -> dict:
    """An entry's content; an entry whose writer hasn't closed it yet is waited for by reading again."""
    for wait in range(200):
        fs, at = _fs(spark, entry_path(root, number))
        stream = fs.open(at)
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if text:
            return json.loads(text)
        time.sleep(min(0.05 * (wait + 1), 1))
    raise ValueError(f"entry {number} was never completed")


def folders(spark: SparkSession, root: str, version: int | None = None) -> list[str]:
    """Folders of rows that can be seen at a version, the newest by default."""
    return [f for n in numbers(spark, root) if version is None or n <= version for f in entry(spark, root, n)["folders"]]


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    found = folders(spark, root, version)
    return spark.read.option("mergeSchema", "true").parquet(*[f"{root.rstrip('/')}/data/{f}" for f in found]) if found else None


def append(spark: SparkSession, root: str, missing: Callable[[DataFrame | None], DataFrame], between: Callable[[], None] = lambda: None) -> tuple[int, int]:
    """Append what missing makes of the table as it is (None if there is none yet); how many rows, and the version that holds them.

    Whoever loses the race for a number works out anew what is missing, so nothing is doubled and nothing is lost. between is called
    before an entry is put, for tests.
    """
    root = root.rstrip("/")
    while True:
        seen = numbers(spark, root)
        last = seen[-1] if seen else 0
        folder = uuid.uuid4().hex
        missing(read(spark, root, last)).write.parquet(f"{root}/data/{folder}")
        n = spark.read.parquet(f"{root}/data/{folder}").count()
        if not n:
            return 0, last
        between()
        if put_if_absent(spark, root, last + 1, {"folders": [folder], "rows": n}):
            return n, last + 1


def append_once(incoming: DataFrame, root: str, key: str, order: str, between: Callable[[], None] = lambda: None) -> tuple[int, int]:
    """append() of the rows whose key the table lacks; of equal keys the first by order."""
    return append(incoming.sparkSession, root, lambda now: new_rows(now if now is not None else incoming.limit(0), incoming, key, order), between)


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove folders that no entry names; how many. Only while no writer is at work."""
    fs, at = _fs(spark, f"{root.rstrip('/')}/data/*")
    known, gone = set(folders(spark, root)), 0
    for s in fs.globStatus(at) or []:
        if s.getPath().getName() not in known:
            fs.delete(s.getPath(), True)
            gone += 1
    return gone
