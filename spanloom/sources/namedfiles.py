"""A sink of files under names of their own.

spark.dataSource.register(NamedFiles), then rows.write.format("namedfiles").mode("append").save(folder).
Rows have name (a relative path) and content. A file is written aside and moved to its name, so it is
there as a whole or not at all, and a task that runs again writes the same file again. Folders
are reached by pyarrow's file systems; driver and executors must share them.
"""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def located(path: str):
    """The file system of a folder's address, and the folder there."""
    from pyarrow import fs

    path = path.rstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def checked(name: str) -> str:
    """A relative name that stays in its folder."""
    parts = PurePosixPath(name).parts
    if not name or name.startswith("/") or not parts or ".." in parts or parts[-1].startswith("."):
        raise ValueError(f"no name for a file: {name!r}")
    return str(PurePosixPath(*parts))


class NamedFiles(DataSource):
    """The sink; options: path."""

    @classmethod
    def name(cls) -> str:
        return "namedfiles"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are added to a folder: use mode append")
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, where = located(self.path)
        context, made = TaskContext.get(), set()
        aside = f"{where}/.writing-{self.run}-{context.partitionId()}-{context.taskAttemptId()}"
        try:
            for row in iterator:
                if row["name"] is None or row["content"] is None:
                    continue
                to = f"{where}/{checked(row['name'])}"
                folder = to.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(aside) as out:
                    out.write(row["content"].encode())
                store.move(aside, to)
        except Exception:
            from pyarrow import fs

            if store.get_file_info(aside).type == fs.FileType.File:
                store.delete_file(aside)
            raise
        return WriterCommitMessage()


def write(rows: DataFrame, name: Column | str, content: Column | str, path: str) -> None:
    """A file for each row; a row without a name or content has none. Of equal names one file stays."""
    rows.sparkSession.dataSource.register(NamedFiles)
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows.select(column(name).alias("name"), column(content).alias("content")).write.format("namedfiles").mode("append").save(path)
