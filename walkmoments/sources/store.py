"""Whole files on any file system that Hadoop reaches, by URI: staged beside the target and committed by rename.

A reader sees a file as it was or as it will be, never a part. Appending holds a lock, an exclusively created
file beside the target, so that of two writers neither loses rows. Both need a file system that renames and
creates in one act (HDFS, local files).
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _java(path: str):
    """Hadoop's Path, FileSystem and FileContext for ``path``."""
    spark = SparkSession.active()
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    return fs.makeQualified(at), fs, jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)


def exists(path: str) -> bool:
    at, fs, _ = _java(path)
    return fs.exists(at)


def staging(path: str) -> str:
    """A new name in the target's folder, hidden from Spark's readers."""
    at, _, _ = _java(path)
    return f"{at.getParent().toString()}/.{at.getName()}-{uuid.uuid4().hex}"


def commit(staged: str, path: str) -> None:
    """``staged`` takes the place of ``path`` in one rename."""
    jvm, gateway = SparkSession.active()._jvm, SparkSession.active().sparkContext._gateway
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    _, _, context = _java(path)
    context.rename(_java(staged)[0], _java(path)[0], options)


def read_text(path: str) -> str:
    at, fs, _ = _java(path)
    stream = fs.open(at)
    try:
        return bytes(SparkSession.active()._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(text: str, path: str) -> None:
    """Replaces ``path``; its folder is made where it is missing."""
    staged = staging(path)
    at, fs, _ = _java(staged)
    fs.mkdirs(at.getParent())
    try:
        stream = fs.create(at, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        commit(staged, path)
    except BaseException:
        fs.delete(at, False)
        raise


def only_part(folder: str, suffix: str) -> str:
    """The one file with ``suffix`` that a single task wrote to ``folder``."""
    at, fs, _ = _java(folder)
    found = [s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().endswith(suffix)]
    if len(found) != 1:
        raise ValueError(f"{folder} holds {len(found)} files, not one")
    return found[0]


def remove(path: str) -> None:
    at, fs, _ = _java(path)
    fs.delete(at, True)


def _create_alone(at, fs) -> bool:
    """Makes a file that is not there, in one act; False where it is. Hadoop's local file systems look first and create then."""
    if fs.getUri().getScheme() != "file":
        return fs.createNewFile(at)
    jvm = SparkSession.active()._jvm
    try:
        jvm.java.nio.file.Files.createFile(jvm.java.io.File(at.toUri().getPath()).toPath(), SparkSession.active().sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


@contextlib.contextmanager
def locked(path: str, wait: float = 60.0) -> Iterator[None]:
    """One writer at a time; raises after ``wait`` seconds, naming the lock that a killed writer may have left."""
    at, fs, _ = _java(path)
    fs.mkdirs(at.getParent())
    lock = SparkSession.active()._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.lock")
    until = time.monotonic() + wait
    while not _create_alone(lock, fs):
        if time.monotonic() > until:
            raise TimeoutError(f"{lock.toString()} is held")
        time.sleep(0.05)
    try:
        yield
    finally:
        fs.delete(lock, False)
