"""A folder tree as a table of source files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from intentlake.sources import gitignore
from intentlake.sources.paths import IGNORED, extension_of, extensions, language_for_path, minified_name

#: Bytes and files of one partition.
SPLIT_BYTES, SPLIT_FILES = 32 << 20, 2000


def check_root(root: str) -> str:
    """The canonical path of a folder; an error if it is missing or no folder."""
    if not os.path.exists(root):
        raise ValueError(f"Path does not exist: {root}")
    if not os.path.isdir(root):
        raise ValueError(f"Path is not a directory: {root}")
    return os.path.realpath(root)


def walk(root: str, wanted: set[str], ignore: set[str], use_gitignore: bool = True) -> Iterator[tuple[str, int]]:
    """(relative path, bytes) of admitted files, depth first, names sorted as bytes.

    Hidden files are walked, links and special files are not. Ignored names
    prune folders and files alike. Unreadable entries are passed over.
    """

    def visit(folder: str, levels: list) -> Iterator[tuple[str, int]]:
        here = os.path.join(root, folder) if folder else root
        try:
            entries = sorted(os.scandir(here), key=lambda e: os.fsencode(e.name))
        except OSError:
            return
        if use_gitignore:
            try:
                with open(os.path.join(here, ".gitignore"), encoding="utf-8", errors="replace") as f:
                    levels = [*levels, (folder, gitignore.parse(f.read()))]
            except OSError:
                pass
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                is_folder, is_file = e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)
                if e.name in ignore or gitignore.ignored(path, is_folder, levels):
                    continue
                if is_folder:
                    yield from visit(path, levels)
                elif is_file and extension_of(path) in wanted and not minified_name(path):
                    yield path, e.stat(follow_symlinks=False).st_size
            except OSError:
                continue

    yield from visit("", [])


class Split(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


SCHEMA = pa.schema([("file_path", pa.string()), ("language", pa.string()), ("n_bytes", pa.int64()), ("source", pa.string())])
DDL = "file_path string, language string, n_bytes bigint, source string"


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = check_root(options["path"])
        given = options.get("extensions")
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.wanted = set(extensions(given.split(",") if given is not None else None, flag("textFiles", "false")))
        self.ignore = set(IGNORED) | set(filter(None, options.get("ignore", "").split(",")))
        self.max_bytes = int(options.get("maxBytes", 1_000_000))
        self.use_gitignore = flag("gitignore", "true") and (not flag("requireGit", "true") or os.path.exists(os.path.join(self.root, ".git")))

    def partitions(self) -> list[Split]:
        """Names and sizes only; contents are read in the tasks."""
        splits: list[Split] = []
        held: list[str] = []
        size = 0
        for path, n in walk(self.root, self.wanted, self.ignore, self.use_gitignore):
            if n > self.max_bytes:
                continue
            if held and (size + n > SPLIT_BYTES or len(held) >= SPLIT_FILES):
                splits.append(Split(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*splits, Split(held)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        """Arrow batches of the split's files; unreadable ones and those that aren't UTF-8 are left out."""
        rows: list[tuple] = []
        held = 0
        for path in split.paths:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    text = f.read().decode("utf-8")
            except (OSError, UnicodeDecodeError):
                continue
            rows.append((path, language_for_path(path), len(text.encode()), text))
            held += len(text)
            if held > 4 << 20:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


class FileTreeSource(DataSource):
    """spark.read.format("filetree").load(folder); the folder must be one that all executors see.

    Options: extensions (comma-separated, with dots), textFiles, ignore
    (comma-separated names), maxBytes, gitignore, requireGit (ignore files
    count only where there is a .git, the default).
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(self.options)


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """Table (file_path, language, n_bytes, source) of the admitted files below `root`."""
    spark.dataSource.register(FileTreeSource)
    reader = spark.read.format("filetree")
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, ",".join(v) if isinstance(v, (list, tuple, set)) else str(v))
    return reader.load(check_root(root))
