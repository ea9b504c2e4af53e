"""What the operators of this subpackage share: staged tables, row numbers, words and Arrow helpers.

Words of a text are taken from its UTF-8 bytes: ``bytes.split()`` cuts exactly at x20 and x09-x0D, and
``bytes.lower()`` lower-cases exactly A-Z.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
_folders: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _local[0]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder given as URI or plain path."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Scratch:
    """Tables written once to the shared folder, so that a lost executor costs no recomputation and lineage stays short.

    ``drop`` removes tables that no result reads any more; what a lazy result still reads stays in the shared folder,
    which its owner clears: within ``owned(folders)`` every folder that is written and not dropped is listed there."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, name)
        df.write.parquet(path)
        if (folders := _folders.get()) is not None:
            folders.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    @staticmethod
    def drop(*tables: DataFrame) -> None:
        for t in tables:
            remove_folder(t._staged_at)


def remove_folder(uri: str) -> None:
    fs, path = file_system(uri)
    fs.delete_dir_contents(path, missing_dir_ok=True)
    if (folders := _folders.get()) is not None:
        folders[:] = [x for x in folders if x != uri]


@contextmanager
def owned(folders: list[str]) -> Iterator[None]:
    """Lists what is staged inside, also of this thread only, in the given list."""
    before = _folders.set(folders)
    try:
        yield
    finally:
        _folders.reset(before)


class RowNumbers:
    """Numbers for the rows of one task: its partition in the high bits, the position in the low 40.

    They tell rows with equal values apart. They hold within one job; stage the table to keep them across jobs."""

    def __init__(self):
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 40

    def take(self, n: int) -> range:
        first, self.next = self.next, self.next + n
        return range(first, first + n)


def set_aside(docs: DataFrame, reserved: set[str]) -> DataFrame:
    """The table with columns of reserved names out of the way; put_back undoes it."""
    return docs.withColumnsRenamed({c: f"in:{c}" for c in docs.columns if c in reserved})


def put_back(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of the table as it was before set_aside."""
    return df.select(*[F.col(f"`in:{c}`").alias(c) if f"in:{c}" in df.columns else F.col(f"`{c}`") for c in columns])


def map_texts(docs: DataFrame, columns: list[str], work: Callable[[Iterator[dict]], Iterator[dict]], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over the named columns: work sees Arrow batches as dicts of columns and yields dicts of columns.

    Batches are cut so that one holds at most about 8 MB of text, whatever the row sizes."""
    out_schema = docs.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[dict]:
            for batch in batches:
                for part in cut_batch(batch, text):
                    yield {name: part.column(i) for i, name in enumerate(part.schema.names)}

        for columns_out in work(parts()):
            yield pa.RecordBatch.from_arrays([as_array(columns_out[f.name], f.type) for f in arrow_schema], schema=arrow_schema)

    return docs.select(*columns).mapInArrow(run, schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def cut_batch(batch: pa.RecordBatch, text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    at = batch.schema.get_field_index(text)
    if at < 0 or batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
        return
    import pyarrow.compute as pc

    first, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
        if held and held + size > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    yield batch.slice(first)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; null stays None."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
