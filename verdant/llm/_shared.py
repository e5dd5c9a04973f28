"""Written intermediate tables in the folder that the cluster shares, and the keys of document rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_BITS = 25
#: Names of the key columns of a document row. No table of a user should have them.
ID, TH = "__id", "__th"
KEY = [ID, TH]


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset: a new local folder in local mode, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="verdant-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables that cut lineage: a lost executor re-reads them instead of repeating what came before.

    Results read them lazily, so they stay until drop(), or until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        files, path = self._place("")
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing needs any more."""
        for name in names:
            files, path = self._place(name)
            files.delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and KEY: the doc_id (where it is null a hash of the text) and a second hash of the text.

    Rows share a key only if they have the same doc_id and text, or no doc_id and the same text; so one
    doc_id may stand for several texts.
    """
    return docs.select(
        *columns, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias(ID), F.hash(F.col("text"), F.col("doc_id").isNull()).alias(TH)
    )


def _places(keys: np.ndarray) -> list[np.ndarray]:
    h = keys.astype(np.int64).view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return [(h >> np.uint64(s)).astype(np.int64) & ((1 << FILTER_BITS) - 1) for s in (0, 19, 38)]


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits, any_key = np.zeros((1 << FILTER_BITS) // 8, np.uint8), False
    for batch in batches:
        for at in _places(batch["key"].to_numpy()):
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
            any_key = True
    if any_key:
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(bits.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["bits"])


def key_filter(keys: DataFrame, tasks: int) -> bytes:
    """A Bloom filter of 4 MB, whatever the size, over a column of longs named key; many keys only make it let more through."""
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in keys.select("key").coalesce(tasks).mapInArrow(_filter, "bits binary").toLocalIterator():  # one after the other
        bits |= np.frombuffer(pa.decompress(bytes(r["bits"]), len(bits), codec="zstd", asbytes=True), np.uint8)
    return bits.tobytes()


def let_through(bits: bytes, keys: np.ndarray) -> np.ndarray:
    known, keep = np.frombuffer(bits, np.uint8), np.ones(len(keys), bool)
    for at in _places(keys):
        keep &= known[at >> 3] >> (7 - (at & 7)) & 1 == 1
    return keep
