"""Shared parts of the text operators: Arrow slicing, word splitting, working tables.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` throughout. Texts travel as Arrow
string arrays; the helpers look at their UTF-8 bytes with numpy, so a word becomes a
Python object once per distinct word of a slice and not once per occurrence.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many UTF-8 bytes (a longer text is a slice of its own).
SLICE_BYTES = 8 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Rows of a file of a table whose rows hold whole blocks (some megabytes each): writers and readers hold a file's rows at once.
BLOCKS_OF_A_FILE = 4

#: Multipliers of the 64-bit mixers (odd constants of splitmix64 and xxHash).
MIX_A, MIX_B, MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, by Spark's reader (any store that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Who keeps count of the working tables made just now: of this thread and call alone.
_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())
#: What marks the name of a catalog table among recorded paths.
_TABLE = "table "


@contextmanager
def recorded(paths: list[str]) -> Iterator[list[str]]:
    """Inside, ``paths`` lists the working tables that are made, so that their owner can delete them."""
    token = _recorders.set((*_recorders.get(), paths))
    try:
        yield paths
    finally:
        _recorders.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Working tables made inside are deleted at its end, also when it fails, but for those that are ``lasting``."""
    paths: list[str] = []
    try:
        with recorded(paths):
            yield
    finally:
        delete(spark, paths)


def _folder(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes working tables; what has been read from them must be stored by then."""
    while paths:
        name = paths.pop()
        if name.startswith(_TABLE):
            spark.sql(f"drop table if exists {name.removeprefix(_TABLE)}")
            continue
        files, path = _folder(spark, name)
        files.delete(path, True)
        files.cancelDeleteOnExit(path)


def work_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new path in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only where that is unset, which is the case in local tests. A
    ``lasting`` table is one that a lazy result reads: the innermost ``scratch`` leaves it alone,
    and whoever calls inside a ``scratch`` or ``recorded`` of their own decides when it goes.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tilefold-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _record(path, lasting)
    return path


def _record(path: str, lasting: bool) -> None:
    owners = _recorders.get()
    for paths in owners[: len(owners) - lasting] if owners else ():
        paths.append(path)


def _until_exit(spark: SparkSession, name: str) -> None:
    """A working table that nobody deletes goes when the application ends."""
    files, path = _folder(spark, name)
    files.deleteOnExit(path)


def written(df: DataFrame, name: str, lasting: bool = False, rows_of_a_file: int = 0) -> DataFrame:
    """``df`` written to a working table and read again: cuts the lineage, survives lost executors.

    What was shuffled to write it is of no use later, so it is removed at once. ``rows_of_a_file``: at most so many rows
    in a file (0: any number).
    """
    spark, path, setting = df.sparkSession, work_path(df.sparkSession, name, lasting), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        df.write.option("maxRecordsPerFile", rows_of_a_file).parquet(path)
    finally:
        spark.conf.set(setting, before)
        _until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df``, whose rows hold whole blocks, written to a lasting working table in buckets of ``column``, so that joins on it do not move the table."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets = max(df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    path = work_path(spark, name, lasting=True)
    _record(_TABLE + table, True)
    try:
        df.write.option("path", path).option("maxRecordsPerFile", BLOCKS_OF_A_FILE).bucketBy(min(buckets, 100_000), column).saveAsTable(table)
    finally:
        _until_exit(spark, path)
    return spark.table(table)


def held_out(doc_id: Column) -> Column:
    """True for the documents whose labels may never be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def as_text(column: pa.Array) -> pa.StringArray:
    """Null texts become empty, and the array owns offsets that start at its first byte."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.string())


def raw_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one more offset than texts)."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw_bytes(as_text(batch.column(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


@dataclass
class Words:
    """Words of a slice: ``codes`` index ``distinct``; text i has the words first[i]:first[i + 1]."""

    codes: np.ndarray
    distinct: pa.StringArray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))


def chunk_array(data: np.ndarray, starts: np.ndarray) -> pa.StringArray:
    """The strings that begin at ``starts`` in ``data``, each up to the next one."""
    offsets = np.empty(len(starts) + 1, np.int32)
    offsets[:-1] = starts
    offsets[-1] = len(data)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def string_list(strings: pa.StringArray) -> list[str]:
    """The strings as a list, by one pass of Arrow (``to_pylist`` makes an object of each first)."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.StringArray, lower: bool = False) -> Words:
    """All words of the texts; ``lower`` turns A-Z into a-z first."""
    raw, offsets = raw_bytes(texts)
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    place = np.cumsum(inside, dtype=np.int32)
    coded = chunk_array(raw[inside], place[starts] - 1).dictionary_encode()
    return Words(np.asarray(coded.indices), coded.dictionary, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_C
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc_text(value: int) -> int:
    return zlib.crc32(str(value).encode())


@dataclass
class Cut:
    """Words of a slice as bytes: ``data`` without white space, where each word begins in it, and
    the first word of each text (each with one more entry for the end)."""

    data: np.ndarray
    starts: np.ndarray
    first: np.ndarray

    def place(self) -> np.ndarray:
        """Position of each byte in its word."""
        return np.arange(len(self.data)) - np.repeat(self.starts[:-1], np.diff(self.starts))

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte over each word (words are never empty)."""
        return np.add.reduceat(per_byte, self.starts[:-1]) if len(self.starts) > 1 else per_byte[:0]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word by its bytes and their positions."""
        return mix(self.sums(mix(((self.place().astype(np.uint64) << np.uint64(8)) | self.data) * MIX_A + MIX_B)))


def cut_words(texts: pa.StringArray, lower: bool = False) -> Cut:
    """All words of the texts, as bytes; ``lower`` turns A-Z into a-z first."""
    raw, offsets = raw_bytes(texts)
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    begins = np.flatnonzero(inside & ~before)
    data = raw[inside]
    starts = np.append((np.cumsum(inside, dtype=np.int64) - 1)[begins], len(data)) if len(begins) else np.zeros(1, np.int64)
    return Cut(data, starts, np.searchsorted(begins, offsets))


def segment_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows first[i]:first[i + 1]; empty stretches give zeros."""
    out = np.zeros((len(first) - 1, *rows.shape[1:]), rows.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(rows, first[full], axis=0)
    return out
