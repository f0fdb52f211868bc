"""Files of any store for Spark's Python data sources: listing and random access by URI."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyarrow import NativeFile, fs
from pyspark import TaskContext
from pyspark.sql.datasource import WriterCommitMessage


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI (a plain path is a local one) and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def prefix_of(uri: str, path: str) -> str:
    """What stands before a path of the store in its URI."""
    return uri[: len(uri) - len(path)] if uri.endswith(path) else uri[: uri.index(path)]


def list_files(uris: list[str], suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(URI, size) of files, and of the files with one of the suffixes directly in folders, in order of their names."""
    found = []
    for uri in uris:
        store, path = file_system(uri.rstrip("/"))
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(uri)
        if info.type == fs.FileType.File:
            found.append((uri, info.size))
            continue
        before = prefix_of(uri.rstrip("/"), path)
        inside = [x for x in store.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.path.lower().endswith(suffixes)]
        found += [(before + x.path, x.size) for x in sorted(inside, key=lambda x: x.path)]
    return found


def open_file(uri: str) -> NativeFile:
    store, path = file_system(uri)
    return store.open_input_file(path)


def exists(uri: str) -> bool:
    store, path = file_system(uri)
    return store.get_file_info(path).type == fs.FileType.File


class Shard(WriterCommitMessage):
    """Files that a task wrote, each with the name that it gets when the job commits."""

    def __init__(self, number: int, moves: list[tuple[str, str]]):
        self.number, self.moves = number, moves


class ShardFiles:
    """A task's files under names of the attempt, so that retried and doubled attempts can't meet."""

    def __init__(self, folder: str, number: int | None = None):
        self.number = TaskContext.get().partitionId() if number is None else number
        self.store, self.folder = file_system(folder)
        self.attempt = uuid.uuid4().hex
        self.moves: list[tuple[str, str]] = []

    def create(self, name: str) -> NativeFile:
        hidden = f"{self.folder}/_{name}.{self.attempt}"
        self.moves.append((hidden, f"{self.folder}/{name}"))
        return self.store.open_output_stream(hidden)

    def done(self) -> Shard:
        return Shard(self.number, self.moves)


def commit_shards(folder: str, shards: list[Shard | None], n: int, empty: Callable[[ShardFiles], Shard]) -> None:
    """The committed tasks' files get their names; shards that no task was run for (of an empty table) are written as empty ones."""
    store, _ = file_system(folder)
    done = [s for s in shards if s]
    missing = sorted(set(range(n)) - {s.number for s in done})
    for shard in [*done, *(empty(ShardFiles(folder, number)) for number in missing)]:
        for hidden, name in shard.moves:
            store.move(hidden, name)


def abort_shards(folder: str, shards: list[Shard | None]) -> None:
    store, _ = file_system(folder)
    for shard in shards:
        for hidden, _ in shard.moves if shard else ():
            if store.get_file_info(hidden).type == fs.FileType.File:
                store.delete_file(hidden)


def make_folder(folder: str) -> None:
    store, path = file_system(folder)
    store.create_dir(path, recursive=True)
