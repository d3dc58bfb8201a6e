"""One file at one path, in any file system that Spark knows; whoever reads it sees the old text or the new one, never half of it."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text beside its place and moves it there; folders are made, and a file of that name is replaced."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    aside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    store = at.getFileSystem(conf)
    store.mkdirs(at.getParent())
    out = store.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf).rename(aside, at, replace)
    except Exception:
        store.delete(aside, False)
        raise


def read_file(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value
