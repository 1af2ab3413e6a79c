"""A sink that writes text files by name: one file per source file, at its relative path."""

from __future__ import annotations

import posixpath
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Written(WriterCommitMessage):
    """Files that one task has written, by their number in its own folder."""
    folder: str
    names: list[str] = field(default_factory=list)


class LabelFiles(DataSource):
    """``format("label_files")`` for rows (file, line), lines of a file one after the other in one task.

    Tasks write below a hidden folder of the job. Files come to their places when all tasks are through, and
    the hidden folder goes, also when the job fails. A null line only makes the file.
    """

    @classmethod
    def name(cls) -> str:
        return "label_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LabelFileWriter(self.options["path"], overwrite)


class LabelFileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f".writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        store, root = self._store()
        done = Written(posixpath.join(root, self.job, uuid.uuid4().hex))
        store.create_dir(done.folder, recursive=True)
        out, current = None, None
        try:
            for file, line in iterator:
                if file != current or out is None:
                    if out is not None:
                        out.close()
                    current, out = file, store.open_output_stream(f"{done.folder}/{len(done.names)}")
                    done.names.append(_inside(file))
                if line is not None:
                    out.write(f"{line}\n".encode())
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        files = [(f"{m.folder}/{n}", name) for m in messages if m is not None for n, name in enumerate(m.names)]
        if len({name for _f, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("a file's lines came to several tasks; partition the rows by file")
        if self.overwrite:
            self._clear(store, root)
        for folder in sorted({posixpath.dirname(f"{root}/{name}") for _f, name in files}):
            store.create_dir(folder, recursive=True)
        for made, name in files:
            store.move(made, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        store.delete_dir(posixpath.join(root, self.job)) if self._exists(store, posixpath.join(root, self.job)) else None

    def _store(self):
        from pyarrow import fs
        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), self.path.rstrip("/")
        uri = self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}"
        store, root = fs.FileSystem.from_uri(uri)
        return store, root.rstrip("/")

    def _exists(self, store, path: str) -> bool:
        from pyarrow import fs
        return store.get_file_info(path).type != fs.FileType.NotFound

    def _clear(self, store, root: str) -> None:
        """Take away text files of an earlier run; other files stay."""
        from pyarrow import fs
        hidden = posixpath.join(root, ".writing-")
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File and info.path.endswith(".txt") and not info.path.startswith(hidden):
                store.delete_file(info.path)


def _inside(file: str) -> str:
    name = posixpath.normpath(file)
    if name.startswith(("/", "..")) or name in ("", "."):
        raise ValueError(f"not a path below the folder: {file!r}")
    return name


def write_label_files(labels: DataFrame, path: str, file: str, order: list[str], line: str = "line",
                      mode: str = "overwrite") -> None:
    """Label files at their relative paths (column ``file``), lines in ``order``, each file written by one task.

    With ``overwrite``, text files of an earlier run go when all new ones are written; with ``append`` only files
    of the same name are replaced.
    """
    labels.sparkSession.dataSource.register(LabelFiles)
    rows = labels.repartition(file).sortWithinPartitions(file, *order).select(labels[file].alias("file"), labels[line].alias("line"))
    rows.write.format("label_files").mode(mode).save(path)
