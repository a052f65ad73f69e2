"""A sink of one text file for each record."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    files: int


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


class CaptionFiles(DataSource):
    """Columns caption_path and caption. A file is written beside the others in the attempt's own staging folder and then moved to its name, so a
    reader sees all of it or nothing, and an attempt that runs twice, or again after a lost executor, leaves the same files. The driver hears
    the number of files of each task; when all are there it writes _SUCCESS with their sum, and a job that fails leaves none."""

    @classmethod
    def name(cls) -> str:
        return "caption_files"

    def writer(self, schema: StructType, overwrite: bool) -> CaptionWriter:
        return CaptionWriter(self.options["path"].rstrip("/"))


class CaptionWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.path)
        task = TaskContext.get()
        staging = f"{root}/_staging-{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(staging, recursive=True)
        made, known = 0, set()
        try:
            for batch in iterator:
                for place, text in zip(batch.column("caption_path").to_pylist(), batch.column("caption").to_pylist()):
                    folder = f"{root}/{place}".rpartition("/")[0]
                    if folder not in known:
                        store.create_dir(folder, recursive=True)
                        known.add(folder)
                    with store.open_output_stream(f"{staging}/file") as out:
                        out.write(((text or "") + "\n").encode())
                    store.move(f"{staging}/file", f"{root}/{place}")
                    made += 1
        finally:
            store.delete_dir(staging)
        return Written(made)

    def _end(self) -> tuple[pafs.FileSystem, str]:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/_staging-{self.job}").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/_staging-{self.job}")
        return store, f"{root}/_SUCCESS"

    def commit(self, messages: list) -> None:
        store, mark = self._end()
        with store.open_output_stream(mark) as out:
            out.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list) -> None:
        store, mark = self._end()
        if store.get_file_info(mark).type == pafs.FileType.File:
            store.delete_file(mark)
