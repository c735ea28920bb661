"""What the corpus operators share: shared folders, cut lineage, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Unicode white space beyond the ASCII one: what str.split and Unicode-aware patterns cut at and WORD does not.
ODD_SPACE = re.compile("[%s]" % "".join(map(chr, (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where that is unset on one machine, as in tests, is a new temporary folder taken; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty() and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path for one run's files under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: later steps do not recompute them, and lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, kind: str) -> DataFrame:
    """The same rows as Parquet in the shared folder, for rows that several steps read: compressed, read by column."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A beginning of column names that no column of df has."""
    while any(c.lower().startswith(stem) for c in df.columns):
        stem = f"_{stem}"
    return stem


def named(column: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def filesystem(uri: str):
    """The file system and plain path of a URI, as Arrow opens them in a task."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        scheme = uri.split(":", 1)[0]
        if scheme == "file":
            return fs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/")
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class Rows:
    """Gathers rows and hands them on as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 2000):
        self.schema, self.most, self.rows = schema, rows, []

    def add(self, *row):
        self.rows.append(row)

    def full(self) -> bool:
        return len(self.rows) >= self.most

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(self.schema)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows = []
        return batch
