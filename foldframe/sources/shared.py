"""The folder that all executors share, and writing of many small files there."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session names it.

    Where the setting is absent, a local session (as in tests) gets a temporary
    folder; on a cluster that is an error, since other machines could not read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def write_files(contents: DataFrame, folder: str) -> int:
    """A file for each row of (name, content) in folder, gzipped if the name ends so; returns how many. A row that is written again gives the same file."""
    from pyarrow import fs

    uri = folder if ":" in folder.partition("/")[0] else f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/{name}", compression="gzip" if name.endswith(".gz") else None) as f:
                    f.write(content.encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    store, base = fs.FileSystem.from_uri(uri)
    store.create_dir(base, recursive=True)
    return sum(r["n"] for r in contents.select("name", "content").mapInArrow(run, "n bigint").groupBy().sum("n").withColumnRenamed("sum(n)", "n").collect() if r["n"])


def delete(folder: str) -> None:
    """Takes a folder of write_files or of a table away again; nothing happens if it's gone."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder if ":" in folder.partition("/")[0] else f"file://{folder}")
    if store.get_file_info(base).type != fs.FileType.NotFound:
        store.delete_dir(base)
