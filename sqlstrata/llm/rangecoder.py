"""Token-id files: an adaptive context-mixing range coder.

A stream of ids is cut into blocks. Every block starts from a fresh adaptive
state, carries its own length and CRC-32, and decodes on its own (with the
head of its segment). Three models predict the next id of a block:

* order 2: the id last seen after the same two ids (hashed table),
* order 1: the id last seen after the same id (hashed table),
* order 0: the frequencies of the segment's ids, stored once in its head.

An order-2 or order-1 prediction has a confidence, and every (order,
confidence) has an adaptive hit rate ``p``; what a model leaves open goes to
order 0. The two are mixed with an adaptive weight that follows their
likelihoods, so that the next id ``x`` has probability
``v * P2(x) + (1 - v) * P1(x)`` with ``Pk(x) = pk * [x = ak] + (1 - pk) * P0(x)``.
The mixture splits the coder's range into the two predicted ids (one, when
they agree) and "order 0", which a second step resolves.

The blocks of a segment run in lock-step: one numpy operation does one step of
all blocks, although each block is strictly sequential. The arithmetic uses
integers and IEEE sums, products and quotients only, so any machine decodes
what another one wrote.

A file is a Parquet folder (any store that Spark writes): one row per segment
with its place (part, segment), the documents' ids and lengths, and the blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlstrata.llm.common import gathered, scratch, slices, text_buffer
from sqlstrata.llm.tokens import encoder, public_path

MAGIC = b"MXR1"
#: Ids of a block.
BLOCK = 1024
#: Ids gathered before a segment is written; bounds a task's memory.
SEGMENT_IDS = 6 << 20
#: Text bytes that are encoded at once: of these a distinct chunk is looked up once.
TEXT_BYTES = 12 << 20
_HEAD = struct.Struct("<4sIII")  # magic, ids, 24-bit words, crc of the ids and then the words
_SEG = struct.Struct("<4sIBII")  # magic, ids per block, bits of the order-0 total, distinct ids, bytes of the table
_BITS = 10                       # entries of a block's order-1 and order-2 tables
_MASK = (1 << _BITS) - 1
_TOTAL = 65536
_LOW = (1 << 24) - 1  # the range is kept above this; words of 24 bits leave the coder


class _Model:
    """Adaptive state of ``lanes`` blocks that advance together. Row 0 of the
    two-row arrays is order 2, row 1 is order 1."""

    def __init__(self, lanes: int):
        f = np.float32
        lane = np.arange(lanes, dtype=np.int64)
        self.table = np.zeros(2 * lanes << _BITS, np.int32)  # id * 8 + confidence
        self.base = np.stack([lane << _BITS, (lane + lanes) << _BITS])
        self.rate = np.tile(np.linspace(0.05, 0.85, 8, dtype=f), 2 * lanes)
        self.rate_base = np.stack([lane * 8, (lane + lanes) * 8])
        self.v = np.full(lanes, 0.5, f)
        self.z = np.zeros(lanes, np.uint32)   # hash of the last id
        self.z2 = np.zeros(lanes, np.uint32)  # hash of the one before
        self.at = np.zeros((2, lanes), np.int64)

    def keep(self, m: int) -> None:
        """Only the first ``m`` lanes go on."""
        self.base, self.rate_base, self.at = self.base[:, :m], self.rate_base[:, :m], self.at[:, :m].copy()
        self.v, self.z, self.z2 = self.v[:m], self.z[:m], self.z2[:m]

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predicted ids (two rows) and the sizes of their parts of the range."""
        at, z = self.at, self.z
        place = self.z2 >> 5
        place += z
        place >>= 13
        place &= _MASK
        np.add(place, self.base[0], out=at[0])
        np.right_shift(z, 13, out=place)
        place &= _MASK
        np.add(place, self.base[1], out=at[1])
        e = self.table.take(at)
        self.k = k = e & 7
        self.a = a = e >> 3
        self.r = self.rate_base + k
        self.p = p = self.rate.take(self.r)
        m2 = self.v * p[0]
        m1 = p[1] - self.v * p[1]
        same = a[0] == a[1]
        m2 += m1 * same
        m2 *= np.float32(_TOTAL - 128)
        m1 *= np.float32(_TOTAL - 128)
        f2, f1 = m2.astype(np.int32), m1.astype(np.int32)
        f2 += 1
        f1 += 1
        f1 *= ~same
        return a, f2, f1

    def update(self, x: np.ndarray, h: np.ndarray) -> None:
        """Learn the ids ``x``; ``h`` tells which predictions were right."""
        f = np.float32
        p = self.p
        hit = h.astype(f)  # by products of 0 and 1, which are exact, not by masks, which cost more
        like = f(1) - p
        like *= f(1 / 32)
        like *= f(1) - hit
        like += p * hit
        b2 = self.v * like[0]
        b1 = like[1] - self.v * like[1]
        b1 += b2
        b2 /= b1
        b2 *= f(0.96)
        b2 += f(0.02)
        self.v = b2
        hit *= f(0.99)
        hit += f(0.004)
        hit -= p
        hit *= f(1 / 20)
        hit += p
        self.rate[self.r.reshape(-1)] = hit.reshape(-1)
        # the next confidence: one more after a hit (7 at most), after a miss (k - 1) // 2, not below 0
        k = self.k
        e = k - (k > 0)
        e >>= 1
        k += 1
        np.minimum(k, 7, out=k)
        k -= e
        k *= h
        e += k
        e += x << 3
        self.table[self.at.reshape(-1)] = e.reshape(-1)
        self.z2 = self.z
        z = x.astype(np.uint32)
        z += 1
        z *= 0x9E3779B1
        self.z = z


def _order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct ids, their shares of a total of 2^bits, bits."""
    seen, count = np.unique(ids, return_counts=True)
    bits = max(18, len(seen).bit_length() + 2)
    share = np.maximum(1, count * ((1 << bits) - len(seen)) // len(ids))
    share[np.argmax(share)] += (1 << bits) - int(share.sum())
    return seen.astype(np.int64), share.astype(np.int64), bits


def encode_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The head and all blocks of ``ids`` (below 2^24)."""
    n = len(ids)
    if n == 0:
        return b""
    if int(ids.max()) >= 1 << 24:
        raise ValueError("ids of 2^24 and more are not supported")
    seen, share, bits = _order0(ids)
    upto = np.cumsum(share) - share
    lanes = -(-n // block)
    flat = np.zeros(lanes * block, np.int32)
    flat[:n] = ids
    grid = np.ascontiguousarray(flat.reshape(lanes, block).T)
    last = n - (lanes - 1) * block
    rank = np.zeros(int(seen[-1]) + 1, np.int32)
    rank[seen] = np.arange(len(seen))
    m = _Model(lanes)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    width = block + 8  # an id takes two words at most, half of one on average
    out = np.zeros(lanes * width, np.uint32)
    first = np.arange(lanes, dtype=np.int64) * width
    ptr = first.copy()

    def emit(at: np.ndarray) -> None:
        o, lo = ptr.take(at), low.take(at)
        out[o] = lo >> 24
        ptr[at] = o + 1
        low[at] = (lo & _LOW) << 24
        rng[at] <<= 24

    live = lanes
    for t in range(block):
        if t == last and live == lanes and last < block:
            live -= 1
            if live == 0:
                break
            m.keep(live)
        if t % 64 == 0 and int((ptr - first).max()) + 64 * 2 + 8 > width:
            wide = np.zeros((lanes, 2 * width), np.uint32)
            wide[:, :width] = out.reshape(lanes, width)
            ptr += first
            first, width, out = first * 2, 2 * width, wide.reshape(-1)
        x = grid[t, :live]
        a, f2, f1 = m.predict()
        h = a == x
        h2 = h[0]
        fe = f2 + f1
        none = ~(h2 | h[1])
        h1 = h[1] > h2
        cum = f2 * h1 + fe * none
        size = f2 * h2 + f1 * h1
        size += (_TOTAL - fe) * none
        lo, rg = low[:live], rng[:live]
        r = rg >> 16
        lo += cum * r
        np.multiply(size, r, out=rg)
        at = np.flatnonzero(rg <= _LOW)
        if len(at):
            emit(at)
        miss = np.flatnonzero(none)
        if len(miss):
            s = rank.take(x.take(miss))
            r = rng.take(miss) >> bits
            low[miss] += upto.take(s) * r
            r *= share.take(s)
            rng[miss] = r
            at = miss.take(np.flatnonzero(r <= _LOW))
            if len(at):
                emit(at)
        m.update(x, h)
    every = np.arange(lanes)
    for _ in range(2):
        emit(every)
    used = ptr - first
    rows = out.reshape(lanes, width)
    carry = np.zeros(lanes, np.uint32)
    words = rows[:, :int(used.max())].T.copy()
    for c in range(len(words) - 1, -1, -1):  # carries run towards the front
        v = words[c] + carry
        words[c] = v & 0xFFFFFF
        carry = v >> 24
    words = np.ascontiguousarray(np.ascontiguousarray(words.T.astype("<u4")).view(np.uint8).reshape(lanes, -1, 4)[:, :, :3])
    table = zlib.compress(np.diff(seen, prepend=0).astype("<u4").tobytes() + share.astype("<u4").tobytes(), 6)
    parts = [_SEG.pack(MAGIC, block, bits, len(seen), len(table)), table]
    raw = memoryview(flat[:n].astype("<u4")).cast("B")
    for i, k in enumerate(used.tolist()):
        own, coded = raw[4 * i * block:4 * (i + 1) * block], words[i, :k].tobytes()
        parts += [_HEAD.pack(MAGIC, len(own) // 4, k, zlib.crc32(coded, zlib.crc32(own))), coded]
    return b"".join(parts)


def decode_segment(blob: bytes) -> np.ndarray:
    """The ids of a segment; raises ``ValueError`` on a damaged block."""
    if not blob:
        return np.zeros(0, np.uint32)
    magic, block, bits, distinct, size = _SEG.unpack_from(blob)
    at = _SEG.size + size
    if magic != MAGIC or at > len(blob):
        raise ValueError("damaged segment head")
    try:
        table = np.frombuffer(zlib.decompress(blob[_SEG.size:at]), "<u4").astype(np.int64)
    except zlib.error as e:
        raise ValueError("damaged order-0 table") from e
    seen, share = np.cumsum(table[:distinct]), table[distinct:]
    if len(table) != 2 * distinct or int(share.sum()) != 1 << bits:
        raise ValueError("damaged order-0 table")
    upto = np.cumsum(share) - share
    symbol = np.repeat(np.arange(distinct, dtype=np.int32), share)
    sizes, words, sums, begin = [], [], [], []
    while at < len(blob):
        if at + _HEAD.size > len(blob):
            raise ValueError(f"damaged block header at byte {at}")
        magic, n, w, crc = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        if magic != MAGIC or at + 3 * w > len(blob) or n > block:
            raise ValueError(f"damaged block header at byte {at - _HEAD.size}")
        sizes.append(n), words.append(w), sums.append(crc), begin.append(at)
        at += 3 * w
    lanes = len(sizes)
    if any(n != block for n in sizes[:-1]):
        raise ValueError("only the last block of a segment may be short")
    parts = [np.frombuffer(blob, np.uint8, 3 * w, a) for w, a in zip(words, begin)]
    three = np.concatenate([*parts, np.zeros(24, np.uint8)]).reshape(-1, 3).astype(np.int32)
    code_words = three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16
    top = len(code_words) - 1
    ptr = np.cumsum([0, *words[:-1]]).astype(np.int64)
    code = np.zeros(lanes, np.int64)
    for _ in range(2):
        code = (code << 24) | code_words.take(np.minimum(ptr, top))
        ptr += 1
    rng = np.full(lanes, 1 << 48, np.int64)
    grid = np.zeros((block, lanes), np.int32)
    m = _Model(lanes)

    def refill(at: np.ndarray) -> None:
        o = ptr.take(at)
        code[at] = (code.take(at) << 24) | code_words.take(o, mode="clip")
        ptr[at] = o + 1
        rng[at] <<= 24

    live, last = lanes, sizes[-1]
    for t in range(block):
        if t == last and live == lanes and last < block:
            live -= 1
            if live == 0:
                break
            m.keep(live)
        a, f2, f1 = m.predict()
        fe = f2 + f1
        co, rg = code[:live], rng[:live]
        r = rg >> 16
        not2, none = co >= f2 * r, co >= fe * r
        one = not2 & ~none
        x = a[0] + (a[1] - a[0]) * one
        cum = f2 * one + fe * none
        part = f2 * ~not2 + f1 * one
        part += (_TOTAL - fe) * none
        co -= cum * r
        np.multiply(part, r, out=rg)
        at = np.flatnonzero(rg <= _LOW)
        if len(at):
            refill(at)
        miss = np.flatnonzero(none)
        if len(miss):
            r = rng.take(miss) >> bits
            co = code.take(miss)
            # exact as whole numbers: r * 2^bits is 2^48 at most, so no quotient rounds up to the next one
            s = symbol.take((co / np.maximum(r, 1)).astype(np.int64), mode="clip")
            code[miss] = co - upto.take(s) * r
            r *= share.take(s)
            rng[miss] = r
            x[miss] = seen.take(s)
            at = miss.take(np.flatnonzero(r <= _LOW))
            if len(at):
                refill(at)
        grid[t, :live] = x
        m.update(x, a == x)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:(lanes - 1) * block + last].astype("<u4")
    raw = memoryview(ids).cast("B")
    for i in range(lanes):
        if zlib.crc32(parts[i], zlib.crc32(raw[4 * i * block:4 * (i + 1) * block])) != sums[i]:
            raise ValueError(f"checksum of block {i} does not match")
    return ids


# ---------------------------------------------------------------- Spark

_FILE = "part int, segment int, doc_ids array<long>, lengths array<long>, n_ids long, blocks binary"


def _segments(path: str, end_id: int, block: int):
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                        ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("blocks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        ids, docs, lens, held, seg = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs, lens, held, seg
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seg], pa.int32()),
                pa.array([[d for x in docs for d in x]], pa.list_(pa.int64())),
                pa.array([[int(n) for x in lens for n in x]], pa.list_(pa.int64())),
                pa.array([held], pa.int64()), pa.array([encode_segment(flat, block)], pa.binary())], schema=schema)
            ids, docs, lens, held = [], [], [], 0
            seg += 1
            return row

        for batch in gathered(batches, TEXT_BYTES):
            for b in slices(batch, "text", TEXT_BYTES):
                data, off = text_buffer(b.column(1))
                flat, n = enc.encode(data, off)
                ends = np.cumsum(n)
                ids.append(np.insert(flat, ends, end_id).astype(np.uint32))
                docs.append(b.column(0).to_pylist())
                lens.append(n + 1)
                held += int(ends[-1]) + len(n)
                if held >= SEGMENT_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", block: int = BLOCK) -> None:
    """Encode every whole text and write the ids to ``out`` in ascending order
    of ``id_col``.

    A null text is empty (its ids are ``end_id`` alone); a null id sorts first;
    rows that repeat an id are kept, next to each other. Other columns are
    ignored. An empty table writes no segment.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(tokenizer, end_id, block), _FILE).write.parquet(out)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode a token folder: one row per document with ``doc_id``, ``start``
    (ids of all documents before it), ``n_tokens`` and ``ids_crc32``, and the
    ids themselves if ``with_ids``."""
    files = spark.read.schema(_FILE).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per part, so this window stays small
    by_part = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    in_part = files.select("part", "segment", "n_ids").select(
        "part", "segment", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("before"))
    places = in_part.join(by_part, "part").select("part", "segment", (F.col("part_start") + F.col("before")).alias("base"))
    fields = [("part", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()),
              ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.uint32())))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode_segment(batch.column(4)[i].as_py()).astype("<u4")
                n = np.array(batch.column(3)[i].as_py(), np.int64)
                if int(n.sum()) != len(ids):
                    raise ValueError("lengths of the documents do not add up to the ids of the segment")
                at = np.cumsum(n) - n
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist())]
                cols = [pa.array(np.full(len(n), batch.column(0)[i].as_py(), np.int32)),
                        pa.array(np.full(len(n), batch.column(1)[i].as_py(), np.int32)),
                        batch.column(2)[i].values, pa.array(at), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(np.append(at, len(ids)).astype(np.int32), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = "part int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    if with_ids:
        schema = pa.schema([*fields[:-1], ("ids", pa.list_(pa.int32()))])
    rows = files.select("part", "segment", "doc_ids", "lengths", "blocks").mapInArrow(run, ddl)
    out = rows.join(places, ["part", "segment"]).withColumn("start", F.col("base") + F.col("local"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scratch(spark, "tokens")
    write_tokens(docs, out, public_path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, out)
