"""The notation as a Spark data source: one document a row.

``spark.dataSource.register(TreeTextSource)``, then ``spark.read.format("treetext")``. Options:
path, a local one or a URI that pyarrow can reach from every executor; separator (a line between
documents; default ---); as (text or json); column to write (default text). Every file is a
partition, read document by document. A write task prints a file under a name that readers skip;
the commit moves all into place, after it has removed what an overwrite replaces.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SEPARATOR = "---"
#: Bytes read at a time.
CHUNK = 1 << 20


def documents(lines, separator: str = SEPARATOR) -> Iterator[str]:
    """Documents of a stream of lines without their ends; what follows the last separator only if it says something."""
    part: list[str] = []
    for line in lines:
        if line.rstrip("\r") == separator:
            yield "\n".join(part)
            part = []
        else:
            part.append(line)
    if any(line.strip() for line in part):
        yield "\n".join(part)


def split_documents(text: str, separator: str = SEPARATOR) -> list[str]:
    return list(documents(text.split("\n"), separator))


def _lines(stream) -> Iterator[str]:
    held = b""
    while chunk := stream.read(CHUNK):
        *whole, held = (held + chunk).split(b"\n")
        for line in whole:
            yield line.decode("utf-8")
    yield held.decode("utf-8")


def _store(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


@dataclass
class FilePart(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class TreeTextSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treetext"

    def schema(self) -> str:
        kind = self.options.get("as", "text")
        if kind not in ("text", "json"):
            raise ValueError("as is text or json")
        return f"path string, seq int, {kind} string"

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.options["path"])
        if store.get_file_info(root).type == fs.FileType.File:
            return [FilePart(root)]
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [FilePart(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not _name(f.path).startswith(("_", "."))]

    def read(self, partition):
        from treeloom.functions import trees
        from treeloom.functions.reader import read

        store, _ = _store(self.options["path"])
        plain = self.options.get("as", "text") == "text"
        with store.open_input_stream(partition.path) as stream:
            for seq, text in enumerate(documents(_lines(stream), self.options.get("separator", SEPARATOR))):
                yield partition.path, seq, text if plain else trees.to_json(read(text))


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.separator, self.overwrite = options["path"], options.get("separator", SEPARATOR), overwrite
        self.column = options.get("column", "text")

    def write(self, rows):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.txt"
        temporary = f"{root}/_{name}"
        with store.open_output_stream(temporary) as out:
            for row in rows:
                out.write(((row[self.column] or "") + f"\n{self.separator}\n").encode())
        return Written(temporary, f"{root}/{name}")

    def commit(self, messages):
        from pyarrow import fs

        store, root = _store(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if _name(f.path).startswith("part-"):
                    store.delete_file(f.path)
        for m in filter(None, messages):
            store.move(m.temporary, m.final)

    def abort(self, messages):
        from pyarrow import fs

        store, _ = _store(self.path)
        for m in filter(None, messages):
            if store.get_file_info(m.temporary).type == fs.FileType.File:
                store.delete_file(m.temporary)
