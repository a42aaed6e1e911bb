"""Small metadata files through Hadoop's file system, so any store that Spark reads works."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def read(spark: SparkSession, path: str) -> bytes:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _rename(spark: SparkSession, source: str, path: str, overwrite: bool) -> None:
    """One step for other readers; without ``overwrite`` it fails where the target exists."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, target = _fs(spark, path)
    target = fs.makeQualified(target)
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(options, 1)
    how[0] = options.OVERWRITE if overwrite else options.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(_fs(spark, source)[1]), target, how)


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes beside the target and renames over it: readers see the old file or the new one."""
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    beside = f"{target.getParent().toString()}/.{target.getName()}.{uuid.uuid4().hex}"
    stream = fs.create(_fs(spark, beside)[1], False)
    stream.write(bytearray(data))
    stream.close()
    _rename(spark, beside, path, True)


def publish(spark: SparkSession, source: str, path: str) -> bool:
    """Renames a folder to a name that nobody has taken; False if somebody has."""
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        return False
    try:
        _rename(spark, source, path, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or fs.exists(target):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)
