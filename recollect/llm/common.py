"""Shared parts of the training-data operators: tables, lineage cuts, Arrow text access, hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised kernels take at a time; a longer single text is one piece of its own.
PIECE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []
_kept: list[list[DataFrame]] = []


@contextmanager
def cleared() -> Iterator[None]:
    """Removes, at its end, the tables that were saved inside; what is read after it must be written elsewhere by then."""
    _kept.append([])
    try:
        yield
    finally:
        forget(*_kept.pop())


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="recollect-"))
    return _own[0]


def saved(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: its lineage ends there, so a lost executor costs no rerun."""
    at = f"{scratch(df.sparkSession)}/recollect-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.saved_at = at
    if _kept:
        _kept[-1].append(out)
    return out


def forget(*dfs: DataFrame) -> None:
    """Removes the files of saved tables that nothing reads any more."""
    for df in dfs:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(df.saved_at)
        at.getFileSystem(conf).delete(at, True)


def free_prefix(docs: DataFrame, prefix: str) -> str:
    """The prefix, lengthened until no column of docs begins with it, so that an operator's own columns meet no others."""
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs less the columns (in any case) that an operator is about to add."""
    return docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in names])


def whole_id(docs: DataFrame) -> Column:
    """doc_id as a whole number; null where it is none."""
    return docs["doc_id"].cast("string").try_cast("long") if dict(docs.dtypes)["doc_id"] == "string" else docs["doc_id"].cast("long")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the rows' offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def release() -> None:
    """Gives back what a worker holds and doesn't use: Spark keeps workers for later tasks and stages, which would add to it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, sliced so that the texts of a slice hold about limit bytes (one row at least)."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start, total = [], 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                ends.append((start, i))
                start, total = i, 0
            total += int(size)
        ends.append((start, batch.num_rows))
        for a, b in ends:
            yield batch.slice(a, b - a)
    release()


# --- 64-bit hashing of substrings of a buffer, all positions at once -------------------------------------------------

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n + 1:
        size = max(n + 1, PIECE_BYTES + 65536)
        for key, base in (("p", _R), ("q", _RINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"], _powers["q"]


class Rolling:
    """Polynomial prefix hashes of a byte buffer; of(start, end) hashes substrings, vectorised and by content alone."""

    def __init__(self, data: np.ndarray):
        p, self.inverse = _powers_to(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * p[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all k-byte substrings, by start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


# --- words and shingles ----------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_COEF = np.random.default_rng(77).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, unit, start) of each word, lower-cased A-Z, split at [\\x20\\x09-\\x0D]; units are the ranges between offsets."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    if n > 2 * PIECE_BYTES:  # hashes depend on a word's bytes alone, so a long text is taken piece by piece, cut at spaces
        parts, a = [], 0
        while a < n:
            b = min(a + PIECE_BYTES, n)
            while b < n and not len(gap := np.flatnonzero(_SPACE[data[b : b + 4096]])):
                b += 4096
            b = b + int(gap[0]) + 1 if b < n else n
            inner = off[(off > a) & (off < b)]
            h, unit, start = words(data[a:b], np.concatenate(([0], inner - a, [b - a])))
            parts.append((h, np.searchsorted(off, start + a, "right") - 1, start + a))
            a = b
        return tuple(np.concatenate([x[c] for x in parts]) for c in range(3))
    space = _SPACE[data]
    solid = ~space
    begin = solid.copy()
    begin[1:] &= space[:-1]
    edge = off[(off > 0) & (off < n)]
    begin[edge] = solid[edge]
    start = np.flatnonzero(begin)
    finish = solid.copy()
    finish[:-1] &= space[1:]
    finish[edge - 1] = solid[edge - 1]
    end = np.flatnonzero(finish) + 1
    h = Rolling(_LOWER[data]).of(start, end)
    return h, np.searchsorted(off, start, "right") - 1, start


def shingle_sets(h: np.ndarray, unit: np.ndarray, n_units: int, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(unit, sorted distinct shingle hashes) of each unit with words; fewer than width words make one shingle."""
    bounds = np.searchsorted(unit, np.arange(n_units + 1))
    m = len(h) - width + 1
    if m > 0:
        rolled = h[:m] * _COEF[0]
        for j in range(1, width):
            rolled += h[j : j + m] * _COEF[j]
        rolled = mix(rolled)
    for i in range(n_units):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            yield i, s
        elif b > a:
            yield i, mix(np.array([(h[a:b] * _COEF[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))


def set_id(s: np.ndarray) -> int:
    """64-bit identity of a set of hashes."""
    total = mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def set_ids(sets: list[np.ndarray]) -> list[int]:
    """set_id of each of many sets that have members, all at once."""
    if not sets:
        return []
    sizes = np.array([len(s) for s in sets])
    totals = np.add.reduceat(mix(np.concatenate(sets) + np.uint64(0x632BE59BD9B4E019)), np.cumsum(sizes) - sizes)
    return mix(totals + sizes.astype(np.uint64)).view(np.int64).tolist()


def signature(s: np.ndarray, least: int, most: int = 1024) -> np.ndarray:
    """Parity bits of a set: differing bits of two signatures never outnumber the sets' symmetric difference.

    A power of two of 64-bit words, least to most, about two bits a member; one of half the length is the exclusive or of its halves."""
    n_words = least
    while n_words < most and n_words * 32 < len(s):
        n_words *= 2
    bits = np.bincount((s >> np.uint64(7)).astype(np.int64) % (64 * n_words), minlength=64 * n_words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def signatures(sets: list[np.ndarray], least: int) -> list[np.ndarray]:
    """signature of each of many sets, those of the least length all at once."""
    short = [i for i, s in enumerate(sets) if len(s) <= 32 * least]
    out = [s if len(s) <= 32 * least else signature(s, least) for s in sets]
    if short:
        row = np.repeat(np.arange(len(short)), [len(sets[i]) for i in short])
        bit = (np.concatenate([sets[i] for i in short]) >> np.uint64(7)).astype(np.int64) % (64 * least)
        bits = np.bincount(row * 64 * least + bit, minlength=len(short) * 64 * least) & 1
        for i, x in zip(short, np.packbits(bits.astype(np.uint8)).view(np.int64).reshape(-1, least), strict=True):
            out[i] = x
    return out


#: Bytes up to which a counted side of a join is broadcast.
SMALL_BYTES = 32_000_000


def small(df: DataFrame, row_bytes: Column | int = 48) -> DataFrame:
    """df, to be broadcast if its rows (of row_bytes each, summed over all of them) hold at most SMALL_BYTES; else Spark joins by shuffling."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= SMALL_BYTES else df


def unpack_rows(df: DataFrame, **kinds: type) -> DataFrame:
    """Rows of packed integer columns (binary) to plain rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cols = [np.frombuffer(batch.column(c)[i].as_py() or b"", kind) for c, kind in enumerate(kinds.values())]
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list(kinds))

    return df.select(*kinds).mapInArrow(run, ", ".join(f"{n} {'int' if kind is np.int32 else 'long'}" for n, kind in kinds.items()))


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Packed columns of each bucket that has rows."""
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    columns = [c[order] for c in columns]
    for b, i, j in zip(values, first, [*first[1:], len(order)], strict=True):
        yield int(b), [c[i:j].tobytes() for c in columns]


def unpacked(batch: pa.Table | pa.RecordBatch, column: str, dtype: type = np.int64) -> np.ndarray:
    """The packed values of a binary column, all rows in a row."""
    parts = [np.frombuffer(x, dtype) for x in batch.column(column).to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
