"""Helpers shared by the text operators."""
from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder

ARROW_ROWS = 1000  # rows in one Arrow batch
ARROW_BYTES = 4 << 20  # bytes after which an Arrow batch ends, so that long texts do not fill a worker; one row may be longer


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row, null text as empty; other columns, whatever their names, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(modulus: int, remainder: int) -> Column:
    """Rows never learned from: crc32 of doc_id as text leaves ``remainder``. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def stash(df: DataFrame, *by: str) -> DataFrame:
    """Writes the rows once to the shared checkpoint folder and reads them back, so that later passes agree after a
    lost executor. Parquet keeps column pruning, which a checkpoint of rows does not."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a stashed frame that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("llm-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over Arrow batches bounded in rows and bytes. A task gives its free memory back at its end, as workers outlive it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives free memory of Arrow and, where the C library can, of Python back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def squeezed(rows: DataFrame) -> DataFrame:
    """The column ``text``, not null, as zstandard frames, before texts are shuffled; ``unsqueezed`` gives a text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            frames = pa.array([squeeze(t.encode("utf-8", "replace")) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) if c != "text" else frames for c in batch.schema.names], batch.schema.names)

    return in_batches(rows, run, ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema))


def unsqueezed(frames: list[bytes]) -> Iterator[bytes]:
    return map(zstandard.ZstdDecompressor().decompress, frames)


class Recent:
    """What was made of the keys that were needed lately, so that a worker makes it once for all its batches: at least the last ``most`` / 2
    keys, never more than ``most`` and those of one call. Long keys are forgotten at once."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], most: int):
        self.make, self.half, self.newer, self.older = make, most // 2, {}, {}

    def joined(self, rows: list[list[str]]) -> list[bytes]:
        """Of each row what is made of its keys, joined."""
        keys = set().union(*rows)
        if len(self.newer) + len(keys) > self.half:
            self.older, self.newer = self.newer, {}
        newer, missing = self.newer, []
        for key in keys:
            if key not in newer:
                known = self.older.get(key)
                if known is None:
                    missing.append(key)
                else:
                    newer[key] = known
        newer.update(zip(missing, self.make(missing)))
        out = [b"".join(map(newer.__getitem__, row)) for row in rows]
        for key in missing:
            if len(key) > 64:
                del newer[key]
        return out


def portions(rows: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """The rows in order, in lists of at most ``most`` characters, or of one row."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row)
    if held:
        yield held
