"""Text files, one for each key."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def _named(key: str, value: str | None) -> str:
    """``key=value`` as Spark names a partition folder."""
    if value is None or value == "":
        return f"{key}=__HIVE_DEFAULT_PARTITION__"
    return f"{key}=" + _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", value)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system knows it, if it is one of a mounted file system; else null."""
    if path.startswith("/"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        return path if default.startswith("file:") else None
    found = re.match(r"file:(?://)?(/[^/].*)$", path)
    return found[1] if found else None


def _write_sorted(rows: Iterable[Row], root: str, folders: list[str], name: str | None) -> None:
    """Rows sorted by their file to files. A file gets its name once it is whole, so a task that runs again replaces it."""

    def place(row: Row) -> tuple[str, str]:
        return (
            "/".join([root, *[_named(f, row[f]) for f in folders]]),
            f"{_named(name, row[name]) if name else 'part-00000'}.txt",
        )

    def lines() -> Iterator[tuple[tuple[str, str], str]]:
        for row in rows:
            yield place(row), row["value"] or ""

    at, out, hidden = None, None, ""
    try:
        for where, value in lines():
            if where != at:
                if out:
                    out.close()
                    os.replace(hidden, "/".join(at))
                at, hidden = where, f"{where[0]}/.{where[1]}.{uuid.uuid4().hex}"
                os.makedirs(where[0], exist_ok=True)
                out = open(hidden, "w", encoding="utf-8", newline="\n")
            out.write(value)
            out.write("\n")
        if out:
            out.close()
            os.replace(hidden, "/".join(at))
    except BaseException:
        if out:
            out.close()
            if os.path.exists(hidden):
                os.unlink(hidden)
        raise


def write_texts(rows: DataFrame, path: str, folders: list[str], name: str | None = None, order: tuple[str, ...] = ()) -> None:
    """One text file for each key: the ``value`` of its rows along ``order``, a line each.

    Files lie in ``folder=value`` folders like those of ``partitionBy``; with ``name`` a file is called after that column,
    without it each has a folder of its own. On a mounted file system the tasks write the files themselves, as Hadoop's local
    file system starts processes for every file; other stores are left to Spark's writer, which gives ``name`` a folder too.
    """
    keys = [*folders, *([name] if name else [])]
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "value")
    root = mounted(rows.sparkSession, path)
    if root is None:
        sorted_rows.write.partitionBy(*keys).option("maxRecordsPerFile", 0).text(path)
        return
    os.makedirs(root)
    sorted_rows.select(*[F.col(k).cast("string").alias(k) for k in keys], "value").foreachPartition(
        lambda part: _write_sorted(part, root, folders, name))
    open(f"{root}/_SUCCESS", "w").close()
