"""Cost-balanced packing of token ids into sequences of a fixed capacity.

A piece of ``l`` ids is estimated to cost ``l + QUADRATIC * l * l`` (linear
layers plus attention within the piece). Documents are cut at multiples of the
capacity; full pieces are sequences of their own. The remaining pieces go, in
descending order, each to the sequence of lowest cost among those whose free
capacity holds it. A piece that fits nowhere is cut to the largest free
capacity and its rest waits its turn by size. The capacities of a group add up
to its ids: all are full sequences but the last ones, which are powers of two,
so no sequence needs padding.

Groups are runs of whole documents of one input partition, about
``GROUP_IDS`` ids each. A group is packed inside one task, next to the ids it
was made of: nothing is shuffled, and memory is bounded by the group (or by a
single longer document).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlstrata.llm.common import slices, text_buffer
from sqlstrata.llm.tokens import encoder, public_path, release

CAPACITY = 2048
QUADRATIC = 1 / 2048
GROUP_IDS = 1 << 20
#: Chunks of a generation that a worker remembers; more of them save no time here.
MEMORY = 50_000

Piece = tuple[int, int, int, int, int]  # document, start, length, sequence, offset


def assign(lengths: np.ndarray, capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> list[Piece]:
    """Pack documents of these lengths; sequences are numbered from 0."""
    out: list[Piece] = []
    seq = 0
    waiting: list[tuple[int, int, int]] = []  # (-length, document, start)
    for d, n in enumerate(np.asarray(lengths).tolist()):
        full = n // capacity
        for k in range(full):
            out.append((d, k * capacity, capacity, seq, 0))
            seq += 1
        if n % capacity:
            waiting.append((-(n % capacity), d, full * capacity))
    total = -sum(w[0] for w in waiting)
    room = [capacity] * (total // capacity)
    rest = total % capacity
    room += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    size = list(room)
    heapq.heapify(waiting)
    open_: list[tuple[float, int]] = []                     # by cost: may hold the piece at hand
    parked = [(-r, s) for s, r in enumerate(room)]          # by free capacity
    heapq.heapify(parked)
    cost = [0.0] * len(room)
    while waiting:
        n, d, start = waiting[0]
        n = -n
        while parked and -parked[0][0] >= n:
            s = heapq.heappop(parked)[1]
            heapq.heappush(open_, (cost[s], s))
        while open_ and room[open_[0][1]] < n:  # filled since: wait for smaller pieces
            s = heapq.heappop(open_)[1]
            if room[s]:
                heapq.heappush(parked, (-room[s], s))
        if open_:
            s, take = heapq.heappop(open_)[1], n
            heapq.heappop(waiting)
        else:
            free, s = heapq.heappop(parked)
            take = -free
            heapq.heapreplace(waiting, (take - n, d, start + take))
        out.append((d, start, take, seq + s, size[s] - room[s]))
        room[s] -= take
        cost[s] += take + quadratic * take * take
        if room[s]:
            if room[s] >= n:
                heapq.heappush(open_, (cost[s], s))
            else:
                heapq.heappush(parked, (-room[s], s))
    return out


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
           ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64())]
_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "cost double")


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, place in the document, length, CRC-32
    of its ids, ids of the document (with ``end_id``), sequence, offset there
    and estimated cost; the ids too if ``with_ids``.

    A null or empty text is the end id alone. A null document id is kept, rows
    that repeat an id are packed once each, an empty table gives no rows, and
    other columns are ignored.
    """
    schema = pa.schema(_FIELDS + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, MEMORY)
        base = TaskContext.get().partitionId() << 40
        ids, docs_, lens, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs_, lens, held, base
            flat, n = np.concatenate(ids).astype("<u4"), np.concatenate(lens)
            who = np.concatenate(docs_)
            at = np.cumsum(n) - n
            p = np.array(assign(n, capacity, quadratic), np.int64).reshape(-1, 5)
            p = p[np.lexsort((p[:, 4], p[:, 3]))]
            a = at[p[:, 0]] + p[:, 1]
            raw = memoryview(np.ascontiguousarray(flat)).cast("B")
            crc = [zlib.crc32(raw[4 * i:4 * (i + k)]) for i, k in zip(a.tolist(), p[:, 2].tolist())]
            cols = [pa.array(who).take(pa.array(p[:, 0])), pa.array(p[:, 1]), pa.array(p[:, 2]), pa.array(crc, pa.int64()),
                    pa.array(n[p[:, 0]]), pa.array(base + p[:, 3]), pa.array(p[:, 4]),
                    pa.array(p[:, 2] + quadratic * p[:, 2].astype(float) ** 2)]
            if with_ids:
                pick = np.repeat(a - (np.cumsum(p[:, 2]) - p[:, 2]), p[:, 2]) + np.arange(int(p[:, 2].sum()))
                cols.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(p[:, 2])).astype(np.int32),
                                                     pa.array(flat[pick].astype(np.int32))))
            base += int(p[:, 3].max()) + 1
            ids, docs_, lens, held = [], [], [], 0
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            for b in slices(batch, "text", 4 << 20):
                flat, n = enc.encode(*text_buffer(b.column(1)))
                ends = np.cumsum(n)
                ids.append(np.insert(flat, ends, end_id))
                docs_.append(b.column(0).to_numpy(zero_copy_only=False) if not b.column(0).null_count
                             else np.array(b.column(0).to_pylist(), object))
                lens.append(n + 1)
                held += int(ends[-1]) + len(n)
                if held >= GROUP_IDS:
                    yield flush()
        if held:
            yield flush()
        del enc
        release(tokenizer)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _DDL + (", ids array<int>" if with_ids else ""))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_path("byte_bpe_50k.json"), end_id=1)
