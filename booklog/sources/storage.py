"""File operations on whatever file system a path belongs to, and versioned outputs.

An output that is replaced as a whole is a folder of versions and markers. A version is
written to a folder of its own that never changes; creating a marker makes it the current
one. Readers only list markers, so they see an old or a new version and disturb no writer.
"""

import os
from uuid import uuid4

from pyspark.sql import SparkSession

MARKERS = "_current"
# Versions that stay, so that a reader which began with one can finish.
KEPT_VERSIONS = 3


class VersionConflict(RuntimeError):
    """Another writer made a version current in the meantime."""


def _resolve(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    file_system, target = _resolve(spark, path)
    return file_system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    file_system, target = _resolve(spark, path)
    if file_system.exists(target):
        file_system.delete(target, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file or folder to a name that must be free."""
    file_system, from_path = _resolve(spark, source)
    _, to_path = _resolve(spark, target)
    if file_system.exists(to_path):
        raise FileExistsError(target)
    file_system.mkdirs(to_path.getParent())
    if not file_system.rename(from_path, to_path):
        raise OSError(f"cannot rename {source} to {target}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a directory."""
    file_system, target = _resolve(spark, path)
    return sorted(status.getPath().getName() for status in file_system.listStatus(target))


def new_version(target: str) -> str:
    """A folder for the next version of an output; not current before ``switch``."""
    return f"{target.rstrip('/')}/{uuid4().hex}"


def make_folder(spark: SparkSession, path: str) -> None:
    file_system, target = _resolve(spark, path)
    file_system.mkdirs(target)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file whole."""
    file_system, target = _resolve(spark, path)
    stream = file_system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    file_system, target = _resolve(spark, path)
    stream = file_system.create(target, False)
    stream.write(bytearray(text.encode()))
    stream.close()


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file whole unless it exists; of several callers exactly one succeeds.

    The text is written under another name first. Giving it its name is one step that fails
    where the name is taken: a link on a local disk, a rename on HDFS. Stores whose rename
    replaces files need a table format of their own for this.
    """
    file_system, target = _resolve(spark, path)
    file_system.mkdirs(target.getParent())
    draft = f"{path.rpartition('/')[0]}/.{uuid4().hex}"
    write_text(spark, draft, text)
    try:
        if file_system.getScheme() == "file":
            os.link(_resolve(spark, draft)[1].toUri().getPath(), target.toUri().getPath())
            return True
        return not file_system.exists(target) and file_system.rename(_resolve(spark, draft)[1], target)
    except FileExistsError:
        return False
    finally:
        delete(spark, draft)


def _marker(target: str, number: int) -> str:
    return f"{target.rstrip('/')}/{MARKERS}/{number:012d}"


def _numbers(spark: SparkSession, target: str) -> list[int]:
    folder = f"{target.rstrip('/')}/{MARKERS}"
    names = children(spark, folder) if exists(spark, folder) else []
    return sorted(int(name) for name in names if name.isdigit())


def version_number(spark: SparkSession, target: str) -> int:
    """The number of the current version, -1 before the first."""
    return max(_numbers(spark, target), default=-1)


def current(spark: SparkSession, target: str) -> str | None:
    """The folder of the current version, if there is one."""
    number = version_number(spark, target)
    return None if number < 0 else f"{target.rstrip('/')}/{read_text(spark, _marker(target, number))}"


def switch(spark: SparkSession, target: str, folder: str, expected: int | None = None) -> None:
    """Makes a written version the current one; versions long replaced are deleted.

    A number belongs to one writer. With ``expected``, the number that was current when the
    writer began to read, the switch fails if another version came between; without it, the
    version takes the next free number.
    """
    version = folder.rpartition("/")[2]
    while True:
        numbers = _numbers(spark, target)
        last = numbers[-1] if numbers else -1
        if expected is None or last == expected:
            if claim(spark, _marker(target, last + 1), version):
                break
        if expected is not None:
            raise VersionConflict(f"version {expected} of {target} is no longer the current one")
    for old in numbers[: max(0, len(numbers) + 1 - KEPT_VERSIONS)]:
        name = read_text(spark, _marker(target, old))
        delete(spark, _marker(target, old))
        delete(spark, f"{target.rstrip('/')}/{name}")
