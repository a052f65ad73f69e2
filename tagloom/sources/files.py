"""File and image sources. Listing, archives and pixels are read by tasks, never by the driver."""
from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import paths as P
from ..functions.pixels import grey, resample
from ..functions.vectors import dct_matrix
from ..session import cut_lineage

# ---- fixed values for region detection ----
GRID_W, GRID_H, CELL = 96, 54, 4
WHITE_MIN, CELL_WHITE, MIN_AREA, MIN_W, MIN_H = 248, 0.97, 0.04, 0.08, 0.15
MAX_RECTS, MAX_TRIES = 4, 16
# ---- end of fixed values ----


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Wanted files below a folder: path relative to it, length, modification time. Contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = "file:" + root if root.startswith("/") else root
    rel = F.regexp_replace(F.col("path"), "^" + _literal(base.rstrip("/") + "/"), "")
    return raw.select(rel.alias("path"), "length", "modificationTime").where(P.is_wanted(F.col("path")))


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


RANGE = 64 << 20  # stored bytes of the members that a task reads from one archive
CELL_MAX = 1 << 30  # bytes of a member that fit a cell


class _Seekable(io.RawIOBase):
    """A file of any store as zipfile expects it: a place in front of the file is an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            self.file.seek(offset, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def _opened(path: str) -> zipfile.ZipFile:
    """An archive read by seeking, so that only what is asked for is fetched. Any store that Arrow knows by its address."""
    store, inner = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
    return zipfile.ZipFile(io.BufferedReader(_Seekable(store.open_input_file(inner)), 1 << 16))


def _ranges(most: int):
    """Stretches of members of an archive, from its directory alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path in b.column("path").to_pylist():
                try:
                    with _opened(path) as z:
                        start, held = 0, 0
                        members = z.infolist()
                    for k, info in enumerate(members):
                        if held and held + info.compress_size > most:
                            out.append((path, start, k, None))
                            start, held = k, 0
                        held += info.compress_size
                    out.append((path, start, len(members), None))
                except (zipfile.BadZipFile, NotImplementedError, ValueError):
                    out.append((path, 0, 0, "corrupt archive"))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["archive", "first", "past", "error"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(archive: str, path: str | None, content: bytes | None, error: str | None) -> pa.RecordBatch:
        values = zip((archive, path, content, error), (pa.string(), pa.string(), pa.binary(), pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["archive", "path", "content", "error"])

    for b in batches:
        for r in b.to_pylist():
            if r["error"]:
                yield row(r["archive"], None, None, r["error"])
                continue
            with _opened(r["archive"]) as z:
                for info in z.infolist()[r["first"] : r["past"]]:  # one member at a time
                    if info.is_dir():
                        continue
                    try:
                        if info.file_size > CELL_MAX:
                            raise ValueError("member too large")
                        yield row(r["archive"], info.filename, z.read(info), None)
                    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                        yield row(r["archive"], info.filename, None, "corrupt member")
                    except ValueError as e:
                        yield row(r["archive"], info.filename, None, str(e))


def read_archives(spark: SparkSession, pattern: str, stretch: int = RANGE) -> DataFrame:
    """Members of zip files as rows. An archive of any size is split by its directory into stretches of about ``stretch`` stored bytes, which tasks
    read side by side, each by seeking to its own members. A broken archive, and a member that is broken or over 1 GB, becomes an error row."""
    found = spark.read.format("binaryFile").load(pattern).select("path")  # no contents
    ranges = found.mapInArrow(_ranges(stretch), "archive string, first long, past long, error string")
    spread = cut_lineage(ranges).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive", "first")
    rows = spread.mapInArrow(_members, "archive string, path string, content binary, error string")
    return rows.where(F.col("error").isNotNull() | P.is_wanted(F.col("path")))


@F.pandas_udf(BooleanType())
def _lossy_webp(content: pd.Series) -> pd.Series:
    def walk(data: bytes) -> bool:
        at = 12
        while at + 8 <= len(data):
            tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if tag in (b"VP8 ", b"VP8L"):
                return tag == b"VP8 "
            at += 8 + size + (size & 1)
        return True

    return content.map(walk)


def is_lossy(content: Column) -> Column:
    """JPEG, or a WebP whose picture chunk is the lossy kind."""
    magic = F.hex(F.substring(content, 1, 12))
    webp = F.startswith(magic, F.lit("52494646")) & F.endswith(magic, F.lit("57454250"))
    return F.startswith(magic, F.lit("FFD8FF")) | (webp & _lossy_webp(content))


def read_images(spark: SparkSession, pattern: str) -> DataFrame:
    """Decoded pictures; a file that can't be decoded keeps its row, without pixels and with an error."""
    ok = F.col("image.height") > 0
    return spark.read.format("image").load(pattern).select(
        F.col("image.origin").alias("path"), *[F.when(ok, F.col(f"image.{a}")).alias(b) for a, b in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))],
        F.when(~ok, "cannot be decoded").alias("error"))


def _rgb(row) -> np.ndarray:
    """Pixels as height x width x 3 bytes on white (the source stores blue first)."""
    a = np.frombuffer(row.data, np.uint8).reshape(int(row.height), int(row.width), int(row.channels))
    if a.shape[2] == 1:
        return np.repeat(a, 3, 2)
    rgb = a[:, :, 2::-1]
    if a.shape[2] == 3:
        return rgb
    cover = a[:, :, 3:].astype(np.uint32)
    return np.rint((rgb * cover + 255 * (255 - cover)) / 255).astype(np.uint8)


def _shrink(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Box averaging to h x w, exact for any size."""
    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        lo, hi = np.arange(n)[None, :], np.arange(1, n + 1)[None, :]
        part = np.clip(np.minimum(hi, edges[1:, None]) - np.maximum(lo, edges[:-1, None]), 0, None)
        return part / part.sum(1, keepdims=True)

    return np.einsum("ij,jkc,lk->ilc", weights(a.shape[0], h), a, weights(a.shape[1], w))


def fingerprint(images: DataFrame) -> DataFrame:
    """path, lo, hi, sig: low-frequency cosine bits of the Lanczos-resampled brightness against their median, and a 32 x 32 colour thumbnail of box means."""
    dct = dct_matrix(32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.data is None:
                    out.append((r.path, None, None, None))
                    continue
                rgb = _rgb(r)
                low = (dct @ resample(grey(rgb), 32, 32, "lanczos").astype(np.float64) @ dct.T)[:8, :8].ravel()
                bits = (low > np.median(low)).astype(np.int64)[::-1]
                power = 1 << np.arange(32, dtype=np.int64)
                out.append((r.path, int(bits[:32] @ power), int(bits[32:] @ power), resample(rgb, 32, 32, "box").astype(np.int32).ravel()))
            yield pd.DataFrame(out, columns=["path", "lo", "hi", "sig"])

    return images.mapInPandas(run, "path string, lo long, hi long, sig array<int>")


def largest_rect(grid: np.ndarray) -> tuple[int, int, int, int, int]:
    """(area, x, y, width, height) of the largest all-true rectangle; the first found in reading order on a tie."""
    best, height = (0, 0, 0, 0, 0), np.zeros(grid.shape[1], int)
    for y, line in enumerate(grid):
        height = np.where(line, height + 1, 0)
        for x in np.nonzero(height)[0]:
            # widest span starting at x: the lowest column so far bounds the height
            low = np.minimum.accumulate(height[x:])
            low = low[: int(np.argmax(low == 0))] if (low == 0).any() else low
            area = low * np.arange(1, len(low) + 1)
            k = int(area.argmax())
            if area[k] > best[0]:
                best = (int(area[k]), int(x), int(y - low[k] + 1), k + 1, int(low[k]))
    return best


def white_regions(grid: np.ndarray) -> tuple[list[list[float]], float]:
    grid, rects, total = grid.copy(), [], 0
    for _ in range(MAX_TRIES):
        area, x, y, w, h = largest_rect(grid)
        if area / grid.size < MIN_AREA or len(rects) == MAX_RECTS:
            break
        grid[y : y + h, x : x + w] = False
        if w >= GRID_W * MIN_W and h >= GRID_H * MIN_H:
            rects.append([round(x / GRID_W, 3), round(y / GRID_H, 3), round(w / GRID_W, 3), round(h / GRID_H, 3)])
            total += area
    return rects, round(total / grid.size, 3)


def detect_regions(images: DataFrame) -> DataFrame:
    """path, rects (0..1), area: large plain white rectangles in each picture."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.data is None:
                    out.append((r.path, None, None))
                    continue
                small = np.rint(_shrink(_rgb(r), GRID_H * CELL, GRID_W * CELL))
                white = (small.min(2) >= WHITE_MIN).reshape(GRID_H, CELL, GRID_W, CELL).mean((1, 3)) >= CELL_WHITE
                out.append((r.path, *white_regions(white)))
            yield pd.DataFrame(out, columns=["path", "rects", "area"])

    return images.mapInPandas(run, "path string, rects array<array<double>>, area double")


def tag_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Tagger vocabulary: category code 9 rating, 4 character, else general."""
    raw = spark.read.csv(path, header=True, schema="tag_id long, name string, category int, count long")
    return raw.select("tag_id", "name", F.when(F.col("category") == 9, "rating").when(F.col("category") == 4, "character").otherwise("general").alias("category"))
