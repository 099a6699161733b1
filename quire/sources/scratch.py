"""Folders for tables a job writes on the way."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder. A session on this machine alone may do without that
    setting and gets a local one; a cluster may not."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"{name}-")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop_path)


STORE = re.compile(r"(?:[^:/]+:)?(?://[^/]*)?")  # scheme and authority of a path


def paths_exist(spark: SparkSession, paths: Iterable[str]) -> list[bool]:
    """``path_exists`` of many paths, by one configuration and one client for each store."""
    jvm, conf, stores, found = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), {}, []
    for path in paths:
        hadoop_path, store = jvm.org.apache.hadoop.fs.Path(path), STORE.match(path)[0]
        if store not in stores:
            stores[store] = hadoop_path.getFileSystem(conf)
        found.append(stores[store].exists(hadoop_path))
    return found


def put_files(rows: DataFrame, folder: str, folders: Sequence[str] = ("",)) -> int:
    """Write (name, content) rows as files of a shared folder, each task its own; names may begin with one of ``folders``.

    Hadoop's local file system starts a program for the permissions of every file it makes, so small files are
    written by Arrow's. Returns their number.
    """
    store, root = fs.FileSystem.from_uri(folder)
    for name in folders:
        store.create_dir(f"{root}/{name}".rstrip("/"), recursive=True)

    def put(batches):
        target, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(*batch.columns):
                with target.open_output_stream(f"{root}/{name}") as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_pydict({"files": [len(batch)]})

    return rows.mapInArrow(put, "files bigint").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def numbered_files(text, suffix: str = ".txt"):
    """Columns (name, content) of one file for each row, as the text writer would make it: a line, null an empty one.

    A row's number in its partition names its file, so a repeated task writes the same files again.
    """
    name = F.concat(F.lit("part-"), F.monotonically_increasing_id().cast("string"), F.lit(suffix))
    return name.alias("name"), F.concat(F.coalesce(text, F.lit("")), F.lit("\n")).cast("binary").alias("content")
