"""Shared helpers: scratch tables on shared storage, files that tasks write, bounded Arrow chunks, label folds."""
from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHUNK_BYTES = 512 << 10
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see.  A local session may go without the setting: there one machine is the cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "panelspark-local")
    return base.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches between the JVM and Python hold so many bytes at most, besides the row count: long texts come in small
    batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """One run folder below the shared one.  Intermediate tables are dropped when done with, the rest when the session ends."""

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
        self._path(self.root)[0].deleteOnExit(self._path(self.root)[1])

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def stage(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write once, read back: later readers see a scan, and a lost executor costs a re-read."""
        path = self.folder(name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._staged_at = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            fs, p = self._path(t._staged_at)
            fs.delete(p, True)


    def last(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Stage a small result and drop all other tables of the run; `df` must not be used again."""
        out = self.stage(df, name)
        fs, root = self._path(self.root)
        for s in fs.listStatus(root):
            if s.getPath().getName() != out._staged_at.rsplit("/", 1)[1]:
                fs.delete(s.getPath(), True)
        return out


class Store:
    """Files that tasks write and read below a shared folder; usable inside tasks."""

    def __init__(self, root: str):
        self.root = root

    def _at(self, name: str = ""):
        fs, base = pafs.FileSystem.from_uri(self.root)
        return fs, f"{base}/{name}" if name else base

    def create(self, name: str):
        fs, path = self._at(name)
        fs.create_dir(os.path.dirname(path), recursive=True)
        return fs.open_output_stream(path, compression=None)

    def put(self, name: str, data: bytes) -> None:
        """Whole small file under a final name: a repeated attempt writes the same bytes and replaces it in one step."""
        tmp = f"{name}.{uuid.uuid4().hex}"
        with self.create(tmp) as f:
            f.write(data)
        fs, path = self._at(name)
        fs.move(f"{os.path.dirname(path)}/{os.path.basename(tmp)}", path)

    def open(self, name: str):
        fs, path = self._at(name)
        return fs.open_input_stream(path, compression=None)

    def get(self, name: str) -> bytes | None:
        fs, path = self._at(name)
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with fs.open_input_stream(path, compression=None) as f:
            return f.read()

    def array(self, name: str, dtype: str) -> np.ndarray:
        """Memory map where the storage is mounted, otherwise a buffered read."""
        fs, path = self._at(name)
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read_buffer(), dtype)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, and its neighbours need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to ask for


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices whose column holds about `limit` bytes at most; a longer single value comes alone."""
    give_back()
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < b.num_rows:
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right"))
            hi = max(hi, lo + 1)
            yield b.slice(lo, hi - lo)
            lo = hi
    give_back()


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, mod 3; null ids go to fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3, F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """(text, y) of at most `most` labelled rows outside fold 1, in hash order.

    The sample is a bounded table of ids, so it may be broadcast; a document labelled twice keeps its larger label.
    """
    pick = (labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 1)).groupBy("doc_id")
            .agg(F.max(target).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(pick), "doc_id").select("text", "y")


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser on unsigned integers."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after the other and the n+1 places where they begin; null counts as empty."""
    arr = column.cast(pa.large_string()).fill_null("")
    arr = pa.concat_arrays([arr])
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8)[offs[0]:offs[-1]] if offs[-1] > offs[0] else np.empty(0, np.uint8)
    return data, offs - offs[0]


_STEP = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, CHUNK_BYTES + (1 << 16)), base, np.uint64)
        p[0] = 1
        have = _powers[name] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans at once: a polynomial of the bytes, taken from its prefix sums."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _STEP, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", pow(_STEP, -1, 1 << 64), n + 1)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def is_blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(gap: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no gap and within one text, and the text of each."""
    n = len(gap)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before, after = np.concatenate([[True], gap[:-1]]) | edge[:-1], np.concatenate([gap[1:], [True]]) | edge[1:]
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on; the last n - 1 places have none."""
    m = max(0, len(words) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h += words[k:k + m] * np.uint64(pow(_STEP, 2 * k + 3, 1 << 64))
    return mix(h, n)


def hash_filter(keys: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """Bit array of fixed size of the 64-bit keys, put together from bitmaps of 4 KB; member() may err towards True."""
    place = F.pmod(column, F.lit(bits))
    rows = (keys.groupBy(F.floor(place / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg((place % 32768).cast("long")).alias("map")).collect())
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["part"] * 4096:(r["part"] + 1) * 4096] = np.frombuffer(bytes(r["map"]), np.uint8)
    return out


def member(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.mod(hashes.view(np.int64), len(bitmap) * 8)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def in_blocks(rows: DataFrame, keys: list[str], row_id: str, block: int) -> DataFrame:
    """Split large groups for pairwise work: add block (the row's own) and left_block <= right_block (the cell).

    A group of m rows gets ceil(m / block) blocks; a row goes to every cell of its block, so any two rows of a group meet
    in exactly one cell, and a cell holds about 2 * block rows.
    """
    size = rows.groupBy(*keys).agg(F.count("*").alias("_m")).where(F.col("_m") > block)
    g = F.coalesce(F.ceil(F.col("_m") / block), F.lit(1)).cast("int")
    out = rows.join(size, keys, "left").withColumn("_g", g).drop("_m").withColumn("block", F.pmod(F.xxhash64(row_id), F.col("_g")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return out.withColumns({"left_block": F.least("block", "_o"), "right_block": F.greatest("block", "_o")}).drop("_g", "_o")
