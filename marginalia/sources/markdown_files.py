"""Digests and exports as Markdown files, one for each document, written by the tasks that have its pieces."""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def write_markdown_files(pieces: DataFrame, path: str) -> None:
    """Write rows (doc_id, file_name, piece_no, markdown) as files below a path that all executors reach.

    A task has the whole of a document and streams its pieces into one file, in order. Files are moved to their places
    when all tasks are done; if one fails, none is left behind. A file that was there before is replaced.
    """
    pieces.sparkSession.dataSource.register(MarkdownFiles)
    rows = pieces.repartition("doc_id", "file_name").sortWithinPartitions("doc_id", "file_name", "piece_no")
    rows.select("doc_id", "file_name", "markdown").write.format("marginalia_markdown").mode("append").save(path)


class MarkdownFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "marginalia_markdown"

    def schema(self) -> str:
        return "doc_id long, file_name string, markdown string"

    def writer(self, schema, overwrite: bool) -> "MarkdownWriter":
        return MarkdownWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, below a folder of its own."""
    folder: str
    names: list[str]


class MarkdownWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def _root(self) -> tuple[fs.FileSystem, str, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, root, f"{root}/_temporary-{self.run}"

    def write(self, iterator: Iterator) -> Written:
        files, _, temporary = self._root()
        done = Written(f"{temporary}/{uuid.uuid4().hex}", [])
        last, out = None, None
        try:
            for row in iterator:
                if (row.doc_id, row.file_name) != last:
                    if out:
                        out.close()
                    last = row.doc_id, row.file_name
                    place = f"{done.folder}/{row.file_name}"
                    files.create_dir(place.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(place)
                    done.names.append(row.file_name)
                out.write((row.markdown or "").encode())
        finally:
            if out:
                out.close()
        return done

    def commit(self, messages: list) -> None:
        files, root, temporary = self._root()
        for task in filter(None, messages):
            for name in task.names:
                place = f"{root}/{name}"
                files.create_dir(place.rpartition("/")[0], recursive=True)
                files.move(f"{task.folder}/{name}", place)
        self._clear(files, temporary)

    def abort(self, messages: list) -> None:
        files, _, temporary = self._root()
        self._clear(files, temporary)

    def _clear(self, files: fs.FileSystem, temporary: str) -> None:
        if files.get_file_info(temporary).type == fs.FileType.Directory:
            files.delete_dir(temporary)
