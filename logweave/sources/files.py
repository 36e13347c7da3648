"""Single files on any file system that Spark reaches, through the driver's JVM."""

from __future__ import annotations

import contextlib
import os
import re
import uuid

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


@contextlib.contextmanager
def _as_oserror(path: str):
    try:
        yield
    except Py4JJavaError as e:
        raise OSError(f"{path}: {str(e.java_exception.getMessage() or e.java_exception).splitlines()[0]}") from e
    except (Py4JError, PySparkException) as e:
        raise OSError(f"{path}: {e}") from e


def _is_local(fs) -> bool:
    return fs.getUri().getScheme() == "file"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return (fs.getRaw() if _is_local(fs) else fs), p


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file that can be opened; an OSError if there is none."""
    with _as_oserror(path):
        fs, p = _at(spark, path)
        status = fs.getFileStatus(p)
        if status.isDirectory():
            raise IsADirectoryError(f"{path}: Is a directory")
        fs.open(p).close()
        return status.getLen()


def last_byte(spark: SparkSession, path: str) -> int:
    """The last byte of a file, -1 if it is empty."""
    with _as_oserror(path):
        fs, p = _at(spark, path)
        if not (size := fs.getFileStatus(p).getLen()):
            return -1
        stream = fs.open(p)
        try:
            stream.seek(size - 1)
            return stream.read()
        finally:
            stream.close()


def canonical(spark: SparkSession, path: str) -> str:
    """One name for every spelling of a path; links are followed where the file system is the machine's own."""
    with _as_oserror(path):
        fs, p = _at(spark, path)
        if _is_local(fs):
            return "file:" + os.path.realpath(fs.makeQualified(p).toUri().getPath())
        return fs.makeQualified(p).toString()


def uri(spark: SparkSession, path: str) -> str:
    """The path as Spark names it in ``_metadata.file_path``."""
    with _as_oserror(path):
        fs, p = _at(spark, path)
        return re.sub(r"^file:/+", "file:/", fs.makeQualified(p).toUri().toString())


def concatenate(spark: SparkSession, folder: str, output: str) -> None:
    """The part files of ``folder``, in their order, as one file: written beside ``output`` under a hidden name, then renamed over it."""
    with _as_oserror(output):
        jvm = spark._jvm
        source, p = _at(spark, folder)
        parts = [s.getPath() for s in source.listStatus(p) if s.getPath().getName().startswith("part-")]
        parts.sort(key=lambda x: int(re.match(r"part-(\d+)", x.getName())[1]))
        fs, out = _at(spark, output)
        if fs.exists(out) and fs.getFileStatus(out).isDirectory():
            raise IsADirectoryError(f"{output}: Is a directory")
        temp = jvm.org.apache.hadoop.fs.Path(out.getParent() or jvm.org.apache.hadoop.fs.Path("."), f".{out.getName()}.{uuid.uuid4().hex}.tmp")
        try:
            stream = fs.create(temp, False)
            try:
                for part in parts:
                    data = source.open(part)
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, stream, 1 << 20, False)
                    finally:
                        data.close()
            finally:
                stream.close()
            if _is_local(fs):
                if not fs.rename(temp, out):
                    raise OSError(f"{output}: cannot be replaced")
            else:
                over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(temp, out, over)
        except BaseException:
            with contextlib.suppress(Exception):
                fs.delete(temp, False)
            raise
