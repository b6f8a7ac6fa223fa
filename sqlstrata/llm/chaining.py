"""Repeated passages by collinear chaining of shared k-mer seeds.

Seeds are all runs of ``K`` words (shuffled as packed columns, about seven bytes
a seed), so ``K`` equal words in a row are a match
wherever they stand. A seed's first occurrence in the corpus (smallest document
id, then position) owns it. All other occurrences, the owner's later ones too,
are matched with it, so the matches grow with the text and not with the square
of the copies.

The matches of a (document, owner) pair are chained: both positions rise along
a chain, each step pays for the words it skips on either side, and the best
chain that ends in a match is a prefix maximum over the owner's positions,
kept in a Fenwick tree. Chains are aligned word by word between and beyond
their anchors, so a passage may differ in some words, lack some or have some
more. Overlapping passages of a document are united; those of ``MIN_WORDS``
words or more are returned.

Texts that repeat whole are found by a 128-bit name of their words and need no
chaining; a task seeds each name once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlstrata.llm.common import (Frequent, IdFilter, apart, frequent_ranges, give_back, groups_of, mix64, ngram_hashes, pack_columns,
                                  shuffle_parts, slices, span_hashes, text_buffer, unpack_columns, whole_runs, word_spans, written)

K = 4
MIN_WORDS = 50
#: Matched words a chain must have to be aligned: two seeds side by side.
MIN_CHAIN = 2 * K
#: Cost of a word skipped on either side, in matched words.
GAP = 0.05
#: Words that a chain may skip at once, and words aligned beyond its ends.
MAX_GAP, MARGIN = 40, 48
#: Share of a passage's words that must match.
MIN_SHARE = 0.6
#: Cuttings of a text that are made at once.
REQUESTS = 256
#: Parts of seeds and matches per shuffle partition: a task holds one at a time.
PARTS = 8
#: Seeds that a part holds at least: with fewer parts than that a task would
#: pack a few numbers for each of them.
PART_SEEDS = 1 << 17
#: Seeds or matches that a task packs at once (at least 64 per part).
HELD = 1 << 20
#: Bits of a seed's hash that are sent, beyond those that name its part. A part
#: fits into a task, so chance equals stay below one seed in 10,000 however large
#: the corpus; words are compared when chains are aligned.
CODE_BITS = 40
#: Text bytes that are hashed at once.
TEXT_BYTES = 1 << 18
_U = np.uint64


# ---------------------------------------------------------------- seeds


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word; A-Z count as a-z."""
    s, e, row = word_spans(data, off)
    return span_hashes(data, s, e), row


def seeds(h: np.ndarray, row: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of the rows' seeds."""
    return ngram_hashes(h, row, k)


def names(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit names of each row's word sequence, and its length."""
    n = np.bincount(row, minlength=rows)
    end = np.cumsum(n)
    place = (np.arange(len(h)) - (end - n)[row]).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x51ED27, 0xA24BAE):
            v = mix64(h + (place * _U(2) + _U(1)) * mix64(np.array([salt], np.uint64)))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)])
            out.append((total[end] - total[end - n]).view(np.int64))
    return out[0], out[1], n


# ---------------------------------------------------------------- chains


class Fenwick:
    """Prefix maxima over ranks 1..n, with the entry that holds them."""

    def __init__(self, n: int):
        self.n = n
        self.best = [0.0] * (n + 1)
        self.who = [-1] * (n + 1)

    def put(self, rank: int, value: float, who: int) -> None:
        best, n = self.best, self.n
        while rank <= n:
            if value > best[rank] or self.who[rank] < 0:
                best[rank], self.who[rank] = value, who
            rank += rank & -rank

    def top(self, rank: int) -> tuple[float, int]:
        """Largest value among the ranks up to ``rank``."""
        value, who = float("-inf"), -1
        while rank > 0:
            if self.who[rank] >= 0 and self.best[rank] > value:
                value, who = self.best[rank], self.who[rank]
            rank &= rank - 1
        return value, who


def chains(x: np.ndarray, y: np.ndarray, k: int = K, gap: float = GAP, max_gap: int = MAX_GAP) -> list[np.ndarray]:
    """Collinear chains of matches (distinct ``x``, rising): index arrays. A
    match belongs to one chain at most; chains are cut where they skip more
    than ``max_gap`` words beyond a seed."""
    n = len(x)
    diagonal = x - y
    if n and (diagonal == diagonal[0]).all():  # one copy: the chain is the matches
        whole = [np.arange(n)]
    else:
        rank = np.searchsorted(np.unique(y), y) + 1
        tree = Fenwick(int(rank.max()) if n else 0)
        xs, ys, ranks = x.tolist(), y.tolist(), rank.tolist()
        score, before = [0.0] * n, [-1] * n
        for i in range(n):
            value, j = tree.top(ranks[i] - 1)
            here = gap * (xs[i] + ys[i])
            gain = value - here if j >= 0 else -1.0
            if gain > 0:
                # the words of a seed count once
                score[i] = gain + min(k, xs[i] - xs[j], ys[i] - ys[j])
                before[i] = j
            else:
                score[i] = float(k)
            tree.put(ranks[i], score[i] + here, i)
        used, whole = [False] * n, []
        for i in sorted(range(n), key=lambda i: -score[i]):
            path = []
            while i >= 0 and not used[i]:
                used[i] = True
                path.append(i)
                i = before[i]
            if path:
                whole.append(np.array(path[::-1]))
    out = []
    for c in whole:
        if len(c) == 1:  # texts that repeat few words give many of these
            out.append(c)
            continue
        wide = np.flatnonzero((np.diff(x[c]) > max_gap + k) | (np.diff(y[c]) > max_gap + k)) + 1
        out += np.split(c, wide)
    return out


def matched_words(x: np.ndarray, k: int = K) -> int:
    """Words that seeds at rising positions cover."""
    return int(np.minimum(np.diff(x, append=x[-1] + k), k).sum())


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int = K) -> tuple[int, int, int, int, int]:
    """Word alignment of ``a`` and ``b`` along anchors at ``xs``/``ys``:
    (start, end in a; start, end in b; equal words). Between anchors the
    longest common subsequence counts; at the ends the alignment goes on, over
    words that only one side has too, while equal words pay for the others."""
    return align_many([(a, b, xs, ys)], k)[0]


def align_many(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int = K) -> list[tuple[int, int, int, int, int]]:
    """``align`` of many (a, b, xs, ys); their ends are aligned together."""
    ends = []
    for a, b, xs, ys in pairs:
        x0, x1, y0, y1 = int(xs[0]), int(xs[-1]) + k, int(ys[0]), int(ys[-1]) + k
        ends += [(a[max(0, x0 - MARGIN):x0][::-1], b[max(0, y0 - MARGIN):y0][::-1]), (a[x1:x1 + MARGIN], b[y1:y1 + MARGIN])]
    went = _extend(ends)
    out = []
    for (a, b, xs, ys), (i, j, n), (p, q, m) in zip(pairs, went[::2].tolist(), went[1::2].tolist()):
        out.append((int(xs[0]) - i, int(xs[-1]) + k + p, int(ys[0]) - j, int(ys[-1]) + k + q, _inside(a, b, xs, ys, k) + n + m))
    return out


def _inside(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int) -> int:
    """Equal words from the first anchor to the end of the last."""
    steps, steps_b = np.diff(xs), np.diff(ys)
    near = (steps == steps_b) & (steps <= k)
    equal = k + int(steps[near].sum())
    for i in np.flatnonzero(~near).tolist():
        x0, y0, dx, dy = int(xs[i]), int(ys[i]), int(steps[i]), int(steps_b[i])
        p, q = a[x0 + k:x0 + dx], b[y0 + k:y0 + dy]
        same = int((p == q).sum()) if dx == dy else 0
        equal += min(dx, dy, k) + (same if dx == dy and same >= dx - k - 1 else _common(p, q))
    return equal


def _extend(ends: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(words of a, words of b, equal words) to go on from the start of each
    (a, b): where the longest common subsequence is furthest above
    ``MIN_SHARE`` of the words on both sides."""
    n, lengths = len(ends), np.array([(len(a), len(b)) for a, b in ends]).reshape(-1, 2)
    high, wide = lengths.max(axis=0) if n else (0, 0)
    a, b = np.zeros((n, high), np.uint64), np.zeros((n, wide), np.uint64)
    for i, (x, y) in enumerate(ends):
        a[i, :len(x)], b[i, :len(y)] = x, y
    beyond = np.arange(wide) >= lengths[:, 1:]
    out, best = np.zeros((n, 3), np.int64), np.zeros(n)
    row, every = np.zeros((n, wide + 1), np.int32), np.arange(n)
    for i in range(high):
        hit = (b == a[:, i:i + 1]) & ~beyond & (i < lengths[:, :1])
        row[:, 1:] = np.maximum(row[:, 1:], row[:, :-1] + hit)
        row = np.maximum.accumulate(row, axis=1)
        score = row - MIN_SHARE / 2 * (i + 1 + np.arange(wide + 1))
        at = score.argmax(axis=1)
        top = score[every, at]
        more = np.flatnonzero(top > best + 1e-9)
        best[more] = top[more]
        out[more] = np.stack([np.full(len(more), i + 1), at[more], row[more, at[more]]], axis=1)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence (short gaps)."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for v in a:
        hit = np.zeros(len(b) + 1, np.int64)
        hit[1:] = np.where(b == v, row[:-1] + 1, 0)
        row = np.maximum.accumulate(np.maximum(row, hit))
    return int(row[-1])


# ---------------------------------------------------------------- Spark


def _named(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                k1, k2, n = names(*word_hashes(*text_buffer(b.column(1))), b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k1), pa.array(k2), pa.array(n)], names=["doc_id", "k1", "k2", "n"])

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, n long")


def _fresh_seeds(b: pa.RecordBatch, seen: set[int]) -> tuple[np.ndarray, ...]:
    """Of the texts of (doc_id, text) whose name is not in ``seen``: (names,
    document ids) and (seed, text's number, position)."""
    h, row = word_hashes(*text_buffer(b.column(1)))
    k1, _, n = names(h, row, b.num_rows)
    fresh = np.zeros(b.num_rows, bool)
    for i in np.flatnonzero(n >= K).tolist():
        if int(k1[i]) not in seen:
            seen.add(int(k1[i]))
            fresh[i] = True
    g, at = seeds(h, row)
    keep = fresh[row[at]]
    g, at = g[keep], at[keep]
    r = row[at]
    return k1[fresh], b.column(0).to_numpy()[fresh], g, (np.cumsum(fresh) - 1)[r], at - (np.cumsum(n) - n)[r]


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    new = np.ones(len(cols[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _rises(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Differences within runs that rise; the first value of a run stays."""
    d = np.diff(x, prepend=0)
    d[start] = x[start]
    return d


def _sums(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``_rises`` undone, for runs of ``n`` rows."""
    total = np.cumsum(d)
    start = np.cumsum(n) - n
    return total - np.repeat(total[start] - d[start], n) if len(d) else total


def _blobs(part: np.ndarray, rows: int, pack) -> Iterator[pa.RecordBatch]:
    """(part, blob) rows: ``pack`` of the row numbers of each part in turn."""
    by = np.argsort(part, kind="stable")
    cut = np.append(_starts(part[by]), rows)
    at, out = part[by], []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        out.append((int(at[a]), pack(by[a:b])))
    for i in range(0, len(out), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i:i + 256]), (pa.int32(), pa.binary()))], names=["part", "blob"])


def _seed_blobs(docs: DataFrame, often: Frequent, parts: int) -> DataFrame:
    """(part, blob): seeds outside the frequent ranges, packed per part of the
    hashes. A task gives the seeds of each name once, with its smallest id."""
    hold = max(HELD, 64 * parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        n = texts = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, doc, g, text, pos = (np.concatenate(c) for c in zip(*held))
            part = ((g >> _U(CODE_BITS)) % _U(parts)).astype(np.int32)
            code, sign = g & _U((1 << CODE_BITS) - 1), (doc < 0).astype(np.int64)

            def pack(i: np.ndarray) -> bytes:
                t, p = text[i], pos[i]
                first = _starts(t)
                k = t[first]
                return pack_columns(key[k].view(np.uint64), np.abs(doc[k]), sign[k], np.diff(np.append(first, len(i))), code[i], _rises(p, first))

            yield from _blobs(part, len(g), pack)

        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                key, doc, g, text, pos = _fresh_seeds(b, seen)
                rare = ~often.marks(g)
                held.append((key, doc, g[rare], text[rare] + texts, pos[rare]))
                n, texts = n + int(rare.sum()), texts + len(key)
                if n >= hold:
                    yield from flush()
                    held, n, texts = [], 0, 0
        if n:
            yield from flush()

    return docs.sortWithinPartitions("doc_id").select("doc_id", "text").mapInArrow(run, "part int, blob binary")


def _frequent_seeds(docs: DataFrame, often: Frequent) -> DataFrame:
    """(h, doc, k1, pos) of the seeds of frequent ranges; a task gives those of
    each name once, with its smallest id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                key, doc, g, text, pos = _fresh_seeds(b, seen)
                late = often.marks(g)
                g, text, pos = g[late], text[late], pos[late]
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(doc[text]), pa.array(key[text]),
                                                  pa.array(pos.astype(np.int32))], names=["h", "doc", "k1", "pos"])

    return docs.sortWithinPartitions("doc_id").select("doc_id", "text").mapInArrow(run, "h long, doc long, k1 long, pos int")


def _match_blobs(k: np.ndarray, o: np.ndarray, x: np.ndarray, y: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, blob): matches (name, owner's name, position, owner's position),
    packed per part of the names."""
    by = np.lexsort((x, o, k))
    k, o, x, y = k[by], o[by], x[by], y[by]

    def pack(i: np.ndarray) -> bytes:
        first = _starts(k[i], o[i])
        own = _starts(k[i][first])
        return pack_columns(k[i][first][own].view(np.uint64), np.diff(np.append(own, len(first))), o[i][first].view(np.uint64),
                            np.diff(np.append(first, len(i))), _rises(x[i], first), y[i])

    return _blobs((k.view(np.uint64) % _U(parts)).astype(np.int32), len(k), pack)


def _rare_matches(blobs: DataFrame, parts: int) -> DataFrame:
    """Packed matches of the seeds outside the frequent ranges. The rows of such
    a seed are bounded and meet in one task, one part after the other."""
    dealt = blobs.repartition(shuffle_parts(blobs.sparkSession), "part").sortWithinPartitions("part")

    def match(held: list[bytes]) -> tuple[np.ndarray, ...]:
        cols = [unpack_columns(x) for x in held]
        key, size, sign, n, code, pos = (np.concatenate([c[i] for c in cols]) for i in range(6))
        pos = np.concatenate([_sums(c[5].astype(np.int64), c[3].astype(np.int64)) for c in cols])
        doc = np.where(sign > 0, -size.astype(np.int64), size.astype(np.int64))
        # of the ids that tasks met with a name, the smallest stands for it
        by = np.lexsort((doc, key))
        first = _starts(key[by])
        name, least = key[by][first], doc[by][first]
        place = np.empty(len(key), np.int64)
        place[by] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        rank = np.empty(len(name), np.int64)
        order = np.lexsort((name, least))
        rank[order] = np.arange(len(name))
        name = name[order].view(np.int64)
        at = np.repeat(rank[place], n.astype(np.int64)) << 32 | pos
        by = np.lexsort((at, code))
        code, at = code[by], at[by]
        once = _starts(code, at)  # other tasks give the same rows of a copy
        code, at = code[once], at[once]
        first = _starts(code)
        n = np.diff(np.append(first, len(code)))
        owner = np.repeat(at[first], n)
        later = np.ones(len(code), bool)
        later[first] = False
        at, owner = at[later], owner[later]
        low = (1 << 32) - 1
        return name[at >> 32], name[owner >> 32], at & low, owner & low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for _, held in groups_of(batches):
            found.append(match(held))
            n += len(found[-1][0])
            if n >= max(HELD, 64 * parts):
                yield from _match_blobs(*(np.concatenate(c) for c in zip(*found)), parts)
                found, n = [], 0
        if n:
            yield from _match_blobs(*(np.concatenate(c) for c in zip(*found)), parts)
        give_back()

    return dealt.mapInArrow(run, "part int, blob binary")


def _frequent_matches(rows: DataFrame, parts: int) -> DataFrame:
    """Packed matches of frequent seeds, whose groups Spark splits: the owner is
    a partial aggregate, joined back."""
    owner = rows.groupBy("h").agg(F.min(F.struct("doc", "k1", "pos")).alias("o")).select(
        "h", F.col("o.k1").alias("ok1"), F.col("o.pos").alias("opos"))
    met = rows.join(owner, "h").filter("k1 <> ok1 or pos <> opos").select("k1", "ok1", "pos", "opos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append([c.to_numpy().astype(np.int64) for c in b.columns])
            n += b.num_rows
            if n >= max(HELD, 64 * parts):
                yield from _match_blobs(*(np.concatenate(c) for c in zip(*held)), parts)
                held, n = [], 0
        if n:
            yield from _match_blobs(*(np.concatenate(c) for c in zip(*held)), parts)

    return met.mapInArrow(run, "part int, blob binary")


def _hopeful(key: np.ndarray, okey: np.ndarray, x: np.ndarray, y: np.ndarray, k: int = K) -> np.ndarray:
    """(from, to) of the pairs' matches, without pairs that cannot have a chain:
    it is cut where ``x`` goes on by more than ``MAX_GAP`` words beyond a seed,
    and needs ``MIN_CHAIN`` matched words."""
    first = _starts(key, okey, np.cumsum(np.diff(x, prepend=x[:1]) > MAX_GAP + k))
    end = np.append(first[1:], len(x))
    words = np.minimum(np.diff(x, append=x[-1:] + k), k)
    words[end - 1] = k
    enough = np.add.reduceat(words, first) >= MIN_CHAIN
    # most chance meetings have two matches, which must rise together
    step = y[end - 1] - y[first]
    enough &= (end - first != 2) | ((step > 0) & (step <= MAX_GAP + k))
    pair = _starts(key[first], okey[first])
    some = np.logical_or.reduceat(enough, pair)
    cuts = np.append(first[pair], len(x))
    return np.stack([cuts[:-1][some], cuts[1:][some]], axis=1)


def _chained(matches: DataFrame) -> DataFrame:
    """(chain, k1, ok1, xs, ys) from packed matches. A text has a match per
    place at most, so its matches follow its length; a task holds one part."""
    cols = ["chain", "k1", "ok1", "xs", "ys"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def columns(blob: bytes) -> tuple[np.ndarray, ...]:
        key, pairs, okey, n, x, y = unpack_columns(blob)
        n = n.astype(np.int64)
        return (np.repeat(np.repeat(key.view(np.int64), pairs.astype(np.int64)), n), np.repeat(okey.view(np.int64), n),
                _sums(x.astype(np.int64), n), y.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 40
        for _, held in groups_of(batches):
            key, okey, x, y = (np.concatenate(c) for c in zip(*map(columns, held)))
            by = np.lexsort((y, x, okey, key))
            key, okey, x, y = key[by], okey[by], x[by], y[by]
            once = _starts(key, okey, x)  # tasks that met copies give a frequent match twice
            key, okey, x, y = key[once], okey[once], x[once], y[once]
            cuts = _hopeful(key, okey, x, y)
            rows = []
            for a, b in cuts.tolist():
                for c in chains(x[a:b], y[a:b]):
                    if len(c) * K < MIN_CHAIN:
                        continue
                    xs, ys = x[a + c], y[a + c]
                    if matched_words(xs) >= MIN_CHAIN:
                        rows.append((n, int(key[a]), int(okey[a]), xs.astype(np.int32), ys.astype(np.int32)))
                        n += 1
                if len(rows) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=cols)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=cols)
        give_back()

    dealt = matches.repartition(shuffle_parts(matches.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "chain long, k1 long, ok1 long, xs array<int>, ys array<int>")


def _cuttings(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(chain, side, first, words): the words around a chain on both sides."""
    ask = found.select("chain", F.explode(F.array(
        F.struct(F.col("doc").alias("doc_id"), F.col("k1").alias("key"), F.lit(0).alias("side"), F.array_min("xs").alias("a"), F.array_max("xs").alias("b")),
        F.struct(F.col("owner").alias("doc_id"), F.col("ok1").alias("key"), F.lit(1).alias("side"), F.array_min("ys").alias("a"), F.array_max("ys").alias("b")),
    )).alias("s")).select("chain", "s.*")
    many = ask.groupBy("doc_id").agg(F.ceil(F.count("*") / REQUESTS).cast("int").alias("lists"))
    # an owner of many chains has its requests in several lists of bounded size
    lists = (ask.join(many, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("chain"), F.col("lists")).alias("part"))
             .agg(F.collect_list(F.struct("chain", "key", "side", F.greatest(F.lit(0), F.col("a") - MARGIN).alias("a"),
                                          (F.col("b") + K + MARGIN).alias("b"))).alias("asked")))
    lists = written(lists.drop("part"), "requests")
    rows = IdFilter(lists).split(docs)[0].join(apart(lists), "doc_id").select("text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                h, row = word_hashes(*text_buffer(b.column(0)))
                cut = np.searchsorted(row, np.arange(b.num_rows + 1))
                k1 = names(h, row, b.num_rows)[0].tolist()
                out = []
                for i, asked in enumerate(b.column(1).to_pylist()):
                    words = h[cut[i]:cut[i + 1]]
                    out += [(q["chain"], q["side"], q["a"], words[q["a"]:q["b"]].astype(np.uint32).tobytes()) for q in asked if q["key"] == k1[i]]
                if out:
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                     names=["chain", "side", "first", "words"])

    return rows.mapInArrow(run, "chain long, side int, first int, words binary")


def _aligned(found: DataFrame, cuttings: DataFrame) -> DataFrame:
    """(doc, k1, owner, start, end, owner_start, owner_end, equal) in words."""
    both = found.select("chain", F.lit(2).alias("side"), F.lit(0).alias("first"), F.lit(None).cast("binary").alias("words"),
                        "doc", "k1", "owner", "xs", "ys")
    none = F.lit(None)
    rows = cuttings.select("*", none.cast("long").alias("doc"), none.cast("long").alias("k1"), none.cast("long").alias("owner"),
                           none.cast("array<int>").alias("xs"), none.cast("array<int>").alias("ys")).unionByName(both)
    rows = rows.repartition(shuffle_parts(found.sparkSession), "chain").sortWithinPartitions("chain", "side")
    cols = ["doc", "k1", "owner", "start", "end", "owner_start", "owner_end", "equal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_runs(batches, ["chain"], 4096):
            side = t.column("side").to_pylist()
            first, words = t.column("first").to_pylist(), t.column("words")
            doc, key, owner, xs, ys = (t.column(c) for c in ("doc", "k1", "owner", "xs", "ys"))
            keys, pairs = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                sides = side[a:b]
                if 0 not in sides or 1 not in sides or sides[-1] != 2:
                    continue
                i, j = a + sides.index(0), a + sides.index(1)
                p, q = np.frombuffer(words[i].as_py(), np.uint32), np.frombuffer(words[j].as_py(), np.uint32)
                x = np.array(xs[b - 1].as_py(), np.int64) - first[i]
                y = np.array(ys[b - 1].as_py(), np.int64) - first[j]
                keys.append((doc[b - 1].as_py(), key[b - 1].as_py(), owner[b - 1].as_py(), first[i], first[j]))
                pairs.append((p, q, x, y))
            out = []
            for (d, k1, o, at, oat), (s, e, os_, oe, same) in zip(keys, align_many(pairs)):
                if same >= MIN_SHARE * (e - s):
                    out.append((d, k1, o, s + at, e + at, os_ + oat, oe + oat, same))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=cols)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in cols))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage of a document: ``doc_id, start, end`` (in
    words, end exclusive), ``owner_id, owner_start`` (the earlier place of its
    longest chain), ``equal`` (words of that chain that match), ``n_words`` of
    the document's text and ``text_key``, which names that text.

    The document with the smallest id keeps a passage, where it first stands
    there, and has no row for that place.
    Null, empty and short texts and rows with a null id have no passages. Rows
    that repeat an id and a text are one document; different texts of an id are
    apart, and the one of smallest ``text_key`` comes first. Other columns are ignored, an empty
    table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    named = written(_named(docs), "names")
    first = written(named.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc")), "first")
    copies = named.join(first, ["k1", "k2", "n"]).filter("doc_id <> doc").filter(F.col("n") >= min_words).select(
        F.col("doc_id").alias("doc"), "k1", F.col("doc").alias("owner"), F.lit(0).cast("long").alias("start"), F.col("n").alias("end"),
        F.lit(0).cast("long").alias("owner_start"), F.col("n").alias("equal")).distinct()

    often = frequent_ranges(docs, lambda data, off: seeds(*word_hashes(data, off))[0])
    place = first.groupBy("k1").agg(F.min("doc").alias("doc"))
    parts = max(1, min(PARTS * shuffle_parts(docs.sparkSession), often.total // PART_SEEDS))
    late = written(_frequent_seeds(docs, often), "frequent")
    matches = _rare_matches(_seed_blobs(docs, often, parts), parts).unionByName(_frequent_matches(late, parts))
    found = _chained(matches).join(place, "k1").join(place.select(F.col("k1").alias("ok1"), F.col("doc").alias("owner")), "ok1")
    found = written(found.select("chain", "doc", "k1", "owner", "ok1", "xs", "ys"), "chains")
    spans = written(_aligned(found, _cuttings(docs, found)), "passages")
    spans = spans.select("doc", "k1", "owner", "start", "end", "owner_start", "equal").unionByName(copies)
    return _united(spans, min_words).join(named.groupBy("doc_id", F.col("k1").alias("text_key")).agg(F.max("n").alias("n_words")),
                                          ["doc_id", "text_key"])


def _united(spans: DataFrame, min_words: int) -> DataFrame:
    """Overlapping and touching spans of a text as one."""
    w = Window.partitionBy("doc", "k1").orderBy("start", "end", "owner", "owner_start")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = spans.withColumn("fresh", (before.isNull() | (F.col("start") > before + 1)).cast("int"))
    part = part.withColumn("part", F.sum("fresh").over(w))
    best = F.max_by(F.struct("owner", "owner_start", "equal"), F.struct("equal", -F.col("owner"), -F.col("owner_start"))).alias("best")
    out = part.groupBy("doc", "k1", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), best)
    return out.filter(F.col("end") - F.col("start") >= min_words).select(
        F.col("doc").alias("doc_id"), F.col("k1").alias("text_key"), "start", "end", F.col("best.owner").alias("owner_id"),
        F.col("best.owner_start"), F.col("best.equal"))


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the passages cut out of the texts they name (whole words,
    with the blanks before them). A document that held nothing else goes; all other
    rows and columns stay."""
    per = passages.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "text_key"))).alias("_cuts"))
    per = written(per, "cuts")  # passages of one text do not overlap: bounded by its text
    names_ = docs.columns
    touched, rest = IdFilter(per, "_id").split(docs, id_col)
    rows = touched.join(apart(per), F.col(id_col) == F.col("_id"), "left").select(*names_, "_cuts")
    at = names_.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text_col, TEXT_BYTES):
                cuts = b.column(len(names_)).to_pylist()
                if not any(cuts):
                    yield pa.RecordBatch.from_arrays(b.columns[:-1], names=names_)
                    continue
                data, off = text_buffer(b.column(at))
                s, e, row = word_spans(data, off)
                cut = np.searchsorted(row, np.arange(b.num_rows + 1))
                k1 = names(span_hashes(data, s, e), row, b.num_rows)[0].tolist()
                texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
                for i, c in enumerate(cuts):
                    c = [q for q in c or () if q["text_key"] == k1[i]]
                    if not c:
                        continue
                    raw, parts, pos = bytes(data[off[i]:off[i + 1]]), [], 0
                    ws, we = s[cut[i]:cut[i + 1]] - off[i], e[cut[i]:cut[i + 1]] - off[i]
                    for q in c:
                        begin = int(we[q["start"] - 1]) if q["start"] else 0
                        if q["start"] < len(ws):
                            parts.append(raw[pos:begin])
                            pos = int(we[min(q["end"], len(we)) - 1])
                    parts.append(raw[pos:])
                    texts[i] = b"".join(parts).decode("utf-8")
                    keep[i] = bool(texts[i].strip())
                cols = list(b.columns[:-1])
                cols[at] = pa.array(texts, cols[at].type)
                yield pa.RecordBatch.from_arrays(cols, names=names_).filter(pa.array(keep))

    return rest.unionByName(rows.mapInArrow(run, docs.schema))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
