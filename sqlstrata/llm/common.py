"""Helpers shared by the operators of this subpackage.

Text kernels work on the raw UTF-8 buffer of an Arrow string column: one
numpy pass over the bytes of a slice of rows, no loop over words. Slices are
bounded in bytes, so memory does not follow the batch size Spark chose.
"""

from __future__ import annotations

import ctypes
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlstrata.session import checkpoint_dir

SLICE_BYTES = 1 << 20

# ---------------------------------------------------------------- tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and continue from the
    files: computed once, readable by several consumers, and a lost executor
    re-reads files instead of recomputing the chain."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- Arrow rows


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null counts as empty."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.zeros(0, np.uint8) if buf is None else np.frombuffer(buf, np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages, and
    what their allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # glibc only
except (OSError, AttributeError):
    _TRIM = None


def apart(ids: DataFrame) -> DataFrame:
    """``ids`` for a join between two Python steps: the rows it meets are
    shuffled, as they are where the ids are many. A broadcast would put both
    steps into one task, which then holds two Python workers, and workers live
    on beyond their stage."""
    return ids.hint("merge")


def slices(batch: pa.RecordBatch, col: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes each (one
    row at least, however long)."""
    _, off = text_buffer(batch.column(batch.schema.get_field_index(col)))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def gathered(batches: Iterator[pa.RecordBatch], limit: int, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches in a row as one of about ``limit`` text bytes (or the last of a
    single batch more)."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(b.schema.get_field_index(col)).nbytes
        if size >= limit:
            whole, held, size = pa.Table.from_batches(held).combine_chunks(), [], 0
            yield from whole.to_batches()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


# ---------------------------------------------------------------- words

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of non-blank bytes within a
    row, and the row of each word. Blanks are 0x20 and 0x09-0x0D."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_WS[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = off[:-1][off[:-1] < off[1:]]
    first[begin] = word[begin]
    last = word.copy()
    last[:-1] &= ~word[1:]
    finish = off[1:][off[:-1] < off[1:]] - 1
    last[finish] = word[finish]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_FOLD = _BYTE.copy()
_FOLD[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z hash as a-z


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POW or len(_POW[0]) < n:
        n = 1 << max(18, n.bit_length())  # as wide as the texts at hand need, and no wider
        inv = pow(_BASE, -1, 1 << 64)
        _POW[:] = []
        for b in (_BASE, inv):
            p = np.ones(1, np.uint64)
            m = 1
            with np.errstate(over="ignore"):
                while len(p) < n:  # doubling
                    p = np.concatenate([p, p * _U(pow(b, m, 1 << 64))])
                    m *= 2
            _POW.append(p[:n])
    return _POW[0], _POW[1]


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans: differences of one running sum, shifted
    back to the span's start, then finalised with the span's length."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    p, q = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_FOLD if fold else _BYTE)[data] * p[:len(data)], out=run[1:])
        return mix64((run[e] - run[s]) * q[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def ngram_hashes(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` consecutive word hashes within one row, and
    the index of its first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:m] == row[n - 1:])
    acc = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            acc = (acc + h[at + k]) * _U(0xC2B2AE3D27D4EB4F) + _U(k + 1)
            acc ^= acc >> _U(29)
    return mix64(acc), at


def n_words_expr(col: str = "text"):
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs of a text column, on the JVM (null: 0)."""
    t = F.translate(F.coalesce(F.col(col), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(t, " "), lambda x: x != "")).cast("long")


# ---------------------------------------------------------------- partitions


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- packed columns

_COLUMN = struct.Struct("<BQQ")  # bytes of a number, numbers, bytes that follow


def pack_columns(*cols: np.ndarray) -> bytes:
    """Columns of numbers from 0 up as one binary: planes of their bytes, in the
    width of the largest one, compressed."""
    codec, out = pa.Codec("zstd", compression_level=1), []
    for x in cols:
        x = np.ascontiguousarray(x, "<u8")
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        raw = codec.compress(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), asbytes=True) if len(x) else b""
        out += [_COLUMN.pack(width, len(x), len(raw)), raw]
    return b"".join(out)


def unpack_columns(blob: bytes) -> list[np.ndarray]:
    """The columns of ``pack_columns``, as uint64."""
    codec, out, at = pa.Codec("zstd"), [], 0
    while at < len(blob):
        width, n, size = _COLUMN.unpack_from(blob, at)
        at += _COLUMN.size
        x = np.zeros((n, 8), np.uint8)
        if n:
            raw = codec.decompress(blob[at:at + size], decompressed_size=n * width, asbytes=True)
            x[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
        at += size
        out.append(x.reshape(-1).view("<u8"))
    return out


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(number, binaries) from rows (number, binary) sorted by number; one
    number's binaries are held at a time."""
    now, held = None, []
    for b in batches:
        for key, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(blob)
    if held:
        yield now, held


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of
    ``edges`` (undirected, nulls and loops are ignored).

    Alternating large-star and small-star rounds. Each round hangs neighbours
    on the smallest node seen, so every shuffle carries (node, node) pairs and
    each node's minimum is a partial aggregate. Rounds are written to the
    shared folder, which cuts the lineage. Nothing is collected but one row of
    counters per round.
    """
    spark = edges.sparkSession
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .filter("u is not null and v is not null and u <> v").distinct())
    e = written(e, "cc")
    mark = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        # an edge to a node's own minimum stays as it is
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.explode(F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
                 .select("s.u", "s.v").filter("u <> v").distinct())
        e = written(small, "cc")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now["n"], now["h"]):
            break
        mark = (now["n"], now["h"])
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


# ---------------------------------------------------------------- runs of a key


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``keys`` (not null, fixed width): tables of whole
    groups and the row at which each group starts (with the end). Groups are
    never cut, small ones come many at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cut = _starts(t, keys)
        if len(cut) > 1:
            yield t.slice(0, int(cut[-1])), cut
            rest = t.slice(int(cut[-1]))
            held, n = rest.combine_chunks().to_batches(), 0  # the last group may go on
        else:
            held = t.to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.append(_starts(t, keys), t.num_rows)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0)
    v = col.flatten().to_numpy(zero_copy_only=False)
    return v.reshape(len(col), -1) if len(col) else v.reshape(0, 0)


# ---------------------------------------------------------------- counts in tables of fixed size


def summed_table(rows: DataFrame, size: int, count: Callable[[pa.RecordBatch, np.ndarray], None], kind: str = "<u4") -> np.ndarray:
    """Add up a table of ``size`` numbers over all rows. ``count`` adds a
    batch to a task's own table; tasks hand on their tables in pieces, which
    are summed apart, one at a time. ``size`` does not follow the data, so the
    result is fit for a broadcast. A task's numbers stop at the largest of ``kind``."""
    piece, most = min(size, 1 << 10), np.iinfo(kind).max

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for b in batches:
            count(b, total)
        if total.any():
            rows = total.reshape(-1, piece)
            for at in range(0, len(rows), 256):
                part = rows[at:at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(
                    [np.minimum(x, most).astype(kind).tobytes() for x in part], pa.binary())], names=["piece", "counts"])
        del total
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(piece, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())],
                                              names=["piece", "counts"])

        for b in batches:  # sorted by piece, so one piece is held
            for key, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if key != at and at is not None:
                    yield done()
                    total = np.zeros(piece, np.int64)
                at = key
                total += np.frombuffer(raw.as_py(), kind)
        if at is not None:
            yield done()

    ddl = "piece long, counts binary"
    parts = rows.mapInArrow(own, ddl).repartition(shuffle_parts(rows.sparkSession), "piece").sortWithinPartitions("piece")
    out = np.zeros(size, np.int64)
    got = parts.mapInArrow(add, ddl).toArrow()
    for i, x in zip(got.column("piece").to_pylist(), got.column("counts").to_pylist()):
        out[i * piece:(i + 1) * piece] = np.frombuffer(x, "<i8")
    return out


class Frequent:
    """Hash ranges that hold a frequent hash. A hash outside of them occurs at
    most ``bound`` times."""

    def __init__(self, counts: np.ndarray):
        mean = counts.mean()
        self.total = int(counts.sum())
        self.bound = int(mean + 6 * np.sqrt(mean) + 8)
        self.bits = np.packbits(counts > self.bound)
        self.shift = np.uint64(64 - (len(counts).bit_length() - 1))

    def marks(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def frequent_ranges(docs: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], log2: int = 22) -> Frequent:
    """Counts of the hashes of all texts, by range of the hash."""
    shift = np.uint64(64 - log2)

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for b in slices(batch, "text", SLICE_BYTES >> 2):
            at, n = np.unique(hashes(*text_buffer(b.column(0))) >> shift, return_counts=True)
            total[at.astype(np.int64)] += n.astype(np.uint32)

    return Frequent(summed_table(docs.select("text"), 1 << log2, count, "<u2"))


# ---------------------------------------------------------------- rows of a few ids


class IdFilter:
    """A bit table of fixed size over hashed ids: never misses one of them.

    Where the ids are few next to the documents, it keeps the others' texts out
    of a shuffle; the join that follows decides. With ever more ids it lets
    ever more through, and results stay the same."""

    LOG2 = 20

    def __init__(self, ids: DataFrame, col: str = "doc_id"):
        def count(b: pa.RecordBatch, total: np.ndarray) -> None:
            total[self.places(b.column(0))] = 1

        table = summed_table(ids.select(F.col(col).cast("long").alias("id")).filter("id is not null"), 1 << self.LOG2, count, "<u2")
        self.bits = np.packbits(table > 0)

    def places(self, col: pa.Array) -> np.ndarray:
        ids = col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return (mix64(ids + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.LOG2)).astype(np.int64)

    def split(self, docs: DataFrame, col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
        """(rows that may have one of the ids, rows that surely have none)."""
        at, bits, places = docs.columns.index(col), self.bits, self.places

        def part(inside: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    p = places(b.column(at))
                    hit = (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool) & b.column(at).is_valid().to_numpy(zero_copy_only=False)
                    yield b.filter(pa.array(hit if inside else ~hit))
            return run

        return docs.mapInArrow(part(True), docs.schema), docs.mapInArrow(part(False), docs.schema)
