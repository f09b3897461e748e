"""Object stores as the executors reach them: folders, listings and bytes, without the driver's JVM."""

from __future__ import annotations

from pyarrow import fs

#: Names that Spark has for stores, and their own.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


class UnknownStore(ValueError):
    """A scheme that no executor can open by itself."""


def store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a local path or a URI: file, hdfs, s3, gs, abfs and Spark's names for them."""
    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    try:
        return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")
    except (ValueError, OSError, NotImplementedError) as e:
        raise UnknownStore(f"{scheme}: {e}") from e


def entries(files: fs.FileSystem, folder: str, *kinds: fs.FileType) -> list[fs.FileInfo]:
    """What one folder holds, by name; nothing if there is no such folder."""
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((x for x in found if not kinds or x.type in kinds), key=lambda x: x.base_name)


def file_names(files: fs.FileSystem, folder: str) -> list[str]:
    return [x.base_name for x in entries(files, folder, fs.FileType.File)]


def folder_names(files: fs.FileSystem, folder: str) -> list[str]:
    return [x.base_name for x in entries(files, folder, fs.FileType.Directory)]


def read(files: fs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as stream:
        return stream.read()


def modified_ms(info: fs.FileInfo) -> int | None:
    return info.mtime_ns // 1_000_000 if info.mtime_ns is not None else None
