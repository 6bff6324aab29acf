"""Files that tasks write themselves, in any store that Arrow reaches (local and mounted folders, HDFS, S3, GCS, Azure).

Each attempt of a task gives its files names of their own; the list of the files of the attempts that count is written when
the job commits.  So a lost executor or a task that ran twice leaves at most files that no list names, and nothing is renamed.
Where a format wants files of given names (``NamedWriter``), the job's commit moves those of the attempts that count to their names.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

LIST = "_files.json"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it, of a path as Spark names it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of a folder's files: those of its list, or where there is none all with the ending; or the one file."""
    fs, at = store(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(at, info.size)]
    if fs.get_file_info(f"{at}/{LIST}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{at}/{LIST}") as f:
            return [(f"{at}/{name}", size) for name, size in json.loads(f.read())]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((i.path, i.size) for i in found if i.type == pafs.FileType.File and i.path.endswith(ending))


def matching(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, of a folder's files, or of those whose names match the last part of the path."""
    if not set(path.rsplit("/", 1)[-1]) & set("*?["):
        return listed(path, "")
    fs, at = store(path)
    folder, pattern = at.rsplit("/", 1)
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted((i.path, i.size) for i in found if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, pattern))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]] = field(default_factory=list)


class FilesWriter(DataSourceArrowWriter):
    """``blobs`` makes the contents of a task's files from its rows: pieces of bytes, None where the next file begins."""

    ending = ""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def blobs(self, batches: Iterator) -> Iterator[bytes | None]:
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Written:
        fs, at = store(self.path)
        fs.create_dir(at, recursive=True)
        attempt, out, done = uuid.uuid4().hex, None, Written()
        for piece in self.blobs(iterator):
            if piece is None:
                if out is not None:
                    out.close()
                out = None
                continue
            if out is None:
                done.files.append((f"part-{attempt}-{len(done.files):05d}{self.ending}", 0))
                out = fs.open_output_stream(f"{at}/{done.files[-1][0]}", compression=None)
            out.write(piece)
            done.files[-1] = (done.files[-1][0], done.files[-1][1] + len(piece))
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = store(self.path)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{LIST}", compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m is not None for x in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = store(self.path)
        for name, _ in (x for m in messages if m is not None for x in m.files):
            fs.delete_file(f"{at}/{name}")


class NamedWriter(DataSourceArrowWriter):
    """``pieces`` makes (name, bytes) from a task's rows, the pieces of several files in any order; no two tasks make the same name."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def pieces(self, batches: Iterator) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Written:
        fs, at = store(self.path)
        fs.create_dir(at, recursive=True)
        attempt, out, sizes = uuid.uuid4().hex, {}, {}
        for name, piece in self.pieces(iterator):
            if name not in out:
                out[name], sizes[name] = fs.open_output_stream(f"{at}/.{name}-{attempt}", compression=None), 0
            out[name].write(piece)
            sizes[name] += len(piece)
        for f in out.values():
            f.close()
        return Written([(f".{name}-{attempt}", size) for name, size in sizes.items()])

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = store(self.path)
        for name, _ in (x for m in messages if m is not None for x in m.files):
            fs.move(f"{at}/{name}", f"{at}/{name[1:].rsplit('-', 1)[0]}")

    abort = FilesWriter.abort
