"""What the operators of this folder share: tables, the shared folder, packed arrays."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words; with it go all other characters of a word.
SPACE = "\x20\x09-\x0d"
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by a path that only Spark needs to understand."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives this package to all Python workers, as an archive that Spark fetches for them; once for a session's context."""
    sc = spark.sparkContext
    if getattr(sc, "_claimveil_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(package)))
    at = fresh_dir(spark, "code") + "/claimveil.zip"
    store, path = fs.FileSystem.from_uri(at)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data.getvalue())
    sc.addPyFile(at)
    sc._claimveil_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Without one only a local session has such a folder, the warehouse's."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
        spark.conf.set("spark.checkpoint.dir", at)
    return at if "://" in at or at.startswith("file:") else "file://" + os.path.abspath(at)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; nothing is there yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes the rows once and keeps them in the shared folder, so lost executors don't bring them again."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % n, F.lit(0))


def word_count(text: str) -> Column:
    """Number of words in a text, null counting as empty; a word starts at a non-space with a space or nothing before it."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def texts_of(batch: pa.RecordBatch, at: int) -> list[bytes]:
    """UTF-8 bytes of a string column; null: empty."""
    column = batch.column(at)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def packed(arrays: list[np.ndarray]) -> pa.Array:
    """One binary value for each array."""
    return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of at most so many bytes together; one that is longer alone."""
    begin = size = 0
    for i, n in enumerate(lengths):
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield begin, len(lengths)


class Forest:
    """Disjoint sets over 0..n-1, joined by whole arrays of links; a set's name is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            up = self.parent[root]
            if np.array_equal(up, root):
                return root
            root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        self.parent = self.find(np.arange(len(self.parent)))
        return self.parent
