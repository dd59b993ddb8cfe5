"""A sink that writes one text file per row."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


class _FileWriter(DataSourceArrowWriter):
    """Every row (filename, note) as a file of that name. A file is written under a hidden name and then renamed by its own task.

    The name depends on the row alone, so a task that runs again, or twice at a time, puts the same content in the same place, and the driver
    hears of no file.
    """

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = FileSystem.from_uri(self.path)
        fs.create_dir(root)
        for batch in iterator:
            for name, note in zip(batch.column("filename").to_pylist(), batch.column("note").to_pylist()):
                if "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"not a file name: {name}")
                hidden = f"{root}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(hidden, compression=None) as f:
                    f.write((note or "").encode())
                fs.move(hidden, f"{root}/{name}{self.suffix}")
        return WriterCommitMessage()


class TextFiles(DataSource):
    """Sink ``text_files`` (options path, suffix) for a DataFrame (filename, note)."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FileWriter(self.options["path"], self.options.get("suffix", ".md"))


def write_notes(notes: DataFrame, path: str, suffix: str = ".md") -> None:
    """Write notes (filename, note) as files under a path; of two notes with one name the later written stays."""
    notes.sparkSession.dataSource.register(TextFiles)
    notes.select("filename", "note").write.format("text_files").option("suffix", suffix).mode("append").save(path)
