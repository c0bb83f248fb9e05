"""What the text operators share: input shaping, vectorised word hashing, shared-folder files.

Every operator reads only the columns it names, so extra columns (also with
clashing names) pass by untouched.  A null text counts as the empty text unless
an operator says otherwise; a null ``doc_id`` is kept as null.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that vectorised code handles at once.
CHUNK_BYTES = 1 << 20
#: ASCII white space: \x20 and \x09-\x0D, what ``bytes.split()`` splits on.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; null texts become empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which every executor and the driver see.

    Where that setting is absent a folder in the warehouse takes its place, in
    local mode a temporary one.  What is left of the folders goes when the
    driver ends.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _local_shared() if spark.sparkContext.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/strandex-shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append(folder)
    return folder


_made: list[str] = []


def drop(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _made:
        _made.remove(folder)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for folder in list(_made):
        drop(spark, folder)


@lru_cache(1)
def _local_shared() -> str:
    folder = tempfile.mkdtemp(prefix="strandex-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The frame written to a new shared folder and read again, and the folder."""
    folder = shared_dir(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def release(spark: SparkSession) -> None:
    """Give back shuffle files of jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the cluster sizes them to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shards(spark: SparkSession) -> int:
    """The power of two at or above the session's shuffle partitions."""
    return 1 << (parts(spark) - 1).bit_length()


def _filesystem(uri: str):
    """File system and path of a URI as Spark writes it: file:/x, s3a://bucket/x, hdfs://host/x or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri)))


def put_file(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays to one file of a shared folder: whole or not at all, so a retried task may write again."""
    filesystem, path = _filesystem(folder)
    filesystem.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}-{uuid.uuid4().hex}"
    head = repr([(k, v.dtype.str, len(v)) for k, v in arrays.items()]).encode()
    with filesystem.open_output_stream(temporary) as out:
        out.write(len(head).to_bytes(8, "little") + head + b"\0" * (-len(head) % 8))
        for v in arrays.values():
            out.write(np.ascontiguousarray(v).tobytes())
            out.write(b"\0" * (-v.nbytes % 8))
    filesystem.move(temporary, f"{path}/{name}")


def list_files(folder: str) -> list[str]:
    from pyarrow import fs

    filesystem, path = _filesystem(folder)
    found = filesystem.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(x.base_name for x in found if not x.base_name.startswith("."))


def map_file(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a shared file, memory-mapped.

    A file of a mounted folder is mapped in place; one of an object store is
    copied to a temporary file that is unlinked as soon as it is mapped.
    """
    import ast

    from pyarrow import fs

    filesystem, path = _filesystem(folder)
    if isinstance(filesystem, fs.LocalFileSystem):
        whole = np.memmap(f"{path}/{name}", np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile() as copy:
            with filesystem.open_input_stream(f"{path}/{name}") as src:
                shutil.copyfileobj(src, copy, 1 << 24)
            copy.flush()
            whole = np.memmap(copy.name, np.uint8, "r")
    size = int(whole[:8].view("<u8")[0])
    at, out = 8 + size + -size % 8, {}
    for key, kind, count in ast.literal_eval(bytes(whole[8 : 8 + size]).decode()):
        n = np.dtype(kind).itemsize * count
        out[key] = whole[at : at + n].view(kind)
        at += n + -n % 8
    return out


_held: dict = {}


def kept(owner: str) -> dict:
    """What a worker keeps between tasks, of one operator at a time.

    Workers outlive queries; when another operator begins, what the last one
    kept (vocabularies, memos, mapped tables) is given back to the system.
    """
    if _held.get("owner") != owner:
        _held.clear()
        _held.update(owner=owner, things={})
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        give_back()
    return _held["things"]


def held(owner: str, key, make):
    """The thing under this key, made if it isn't kept yet."""
    things = kept(owner)
    if key not in things:
        things[key] = make()
    return things[key]


def give_back() -> None:
    """Free memory that the allocator holds on to."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: it decides itself


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        for i, base in enumerate((_ODD, _INVERSE)):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def running_hash(data: np.ndarray) -> np.ndarray:
    """The running polynomial sum of the bytes, from which every span's hash follows."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power(len(data))[0][: len(data)], out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans start:end of what was summed."""
    return mix((total[end] - total[start]) * _power(len(total) - 1)[1][start] + (end - start).astype(np.uint64))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(running_hash(data), start, end)


def word_hashes(data: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word: the maximal runs of bytes outside ``breaks``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~breaks[data]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    return start, end, hash_spans(data, start, end)


def chunked(values: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of the list whose bytes sum to about ``most``; a longer value is alone."""
    begin = size = 0
    for i, x in enumerate(values):
        if size and size + len(x) > most:
            yield begin, i
            begin, size = i, 0
        size += len(x) + 1
    if begin < len(values):
        yield begin, len(values)


def slices(batches, column: int, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with the values of a text column, of about ``most`` bytes of text; a longer value is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends, lo = np.cumsum(sizes), 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            part = batch.slice(lo, hi - lo)
            yield part, part.column(column).to_pylist()
            lo = hi


def run_starts(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(key):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))


def sha_hex(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()
