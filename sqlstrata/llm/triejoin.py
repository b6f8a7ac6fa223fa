"""Jaccard join of word 5-gram sets over prefix trees.

Every text is the set of its distinct shingles, as 64-bit hashes in one global
order: shingles of rare hash ranges first, frequent ones last (counts over all
texts in a table of fixed size), ties by hash. Texts with equal sets are one
class, and one representative of each goes on.

Candidates. Two sets of similarity ``t`` share a shingle among the first
``n - ceil(t n) + 1`` of each, so only those are shuffled. A shingle outside
the frequent ranges occurs in no more texts than its range has counts, so its
group is bounded; groups of frequent shingles go through a join that Spark
can split. A pair needs a number of common prefix shingles, which drops
nearly all chance meetings.

Verification. The candidates of a probe set meet it in blocks of bounded size.
A block's sets, frequent shingles first, form a prefix tree (sorted sets and
the length each shares with the one before). The probe walks it once: the
overlap of a shared path is counted once for all sets below it, and a subtree
is left as soon as overlap plus what can remain on either side is too small.

Components. Large families are linked star by star first: every member of a
group meets the group's smallest. Then only pairs whose components differ are
left. The groups of one component meet together, block against block: the
prefixes of a block are a tree in the global order, and all prefixes of the other
block go down it at once. A shared path is counted once, and a subtree is left
when the lengths below it do not allow for the strangers met so far. Each
pair leaves a tile once, with its number of common shingles, and all pairs that are
left are verified, so no link between different texts that could join two
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlstrata.llm.common import (Frequent, IdFilter, apart, connected_components, frequent_ranges, mix64, ngram_hashes, shuffle_parts, slices, span_hashes,
                                  text_buffer, whole_runs, word_spans, written)

WORDS = 5
PERCENT = 80
#: Sets that meet their probe at once.
BLOCK = 256
#: Parts that the rows of a frequent shingle are dealt out to.
SALTS = 64
#: Rows (shingle, set) of a block of the tree join, and pairs of a probe and a
#: set that go down a tree at once.
TILE_ROWS, WALK_PAIRS = 1 << 17, 1 << 19
#: Text bytes that are hashed at once.
TEXT_BYTES = 1 << 18
_U = np.uint64


# ---------------------------------------------------------------- sets


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, row) of all rows, distinct, sorted by row and hash. A row of
    fewer words is one shingle, a row without words has none."""
    s, e, row = word_spans(data, off)
    h = span_hashes(data, s, e)
    g, at = ngram_hashes(h, row, words)
    rows = row[at]
    count = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        whole = np.array([mix64(np.array([_chain(h[first[r]:first[r] + count[r]])], np.uint64))[0] for r in few], np.uint64)
        g, rows = np.concatenate([g, whole]), np.concatenate([rows, few])
    order = np.lexsort((g, rows))
    g, rows = g[order], rows[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    return g[new], rows[new]


def _chain(h: np.ndarray) -> int:
    x = len(h)
    for v in h.tolist():
        x = (x * 0x9E3779B97F4A7C15 + v) & (1 << 64) - 1
    return x


def set_names(g: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit names of each row's set: sums of remixed hashes."""
    end, out = np.cumsum(n), []
    with np.errstate(over="ignore"):
        for salt in (0x1234567, 0x89ABCDEF):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(g ^ _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))])
            out.append((total[end] - total[end - n]).view(np.int64))
    return out


def prefix_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


# ---------------------------------------------------------------- the tree


class PrefixTree:
    """Sets as a prefix tree: rows sorted by their shingles, each with the
    length of the path it shares with the row before."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [x.astype(">u8").tobytes() for x in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:]):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared.append(int(differ[0]) if len(differ) else m)

    def links(self, probe: np.ndarray, percent: int = PERCENT) -> list[int]:
        """Numbers of the sets that link with ``probe``. ``probe`` and the
        tree's sets hold order keys (see ``tree_keys``)."""
        found, n = [], len(probe)
        # for each depth of the path at hand: shingles it has in common with
        # the probe, and shingles of the probe that it has passed
        hits, passed = np.zeros(1, np.int64), np.zeros(1, np.int64)
        dead = -1  # rows that share this depth with a pruned path are pruned
        for row, (s, lcp) in enumerate(zip(self.sets, self.shared)):
            if dead >= 0 and lcp >= dead:
                continue
            dead = -1
            lcp = min(lcp, len(hits) - 1)
            new = s[lcp:]
            at = np.searchsorted(probe, new, side="right")
            hit = probe[at - 1] == new
            hit[at == 0] = False
            hits = np.concatenate([hits[:lcp + 1], hits[lcp] + np.cumsum(hit)])
            passed = np.concatenate([passed[:lcp + 1], at])
            # below depth d a set shares at most what the path shares and what
            # is left of the probe, and its union has the path's strangers
            most = hits[lcp:] + n - passed[lcp:]
            strangers = np.arange(lcp, len(s) + 1) - hits[lcp:]
            short = np.flatnonzero(100 * most < percent * (n + strangers))
            if len(short):
                dead = lcp + int(short[0])
                hits, passed = hits[:dead + 1], passed[:dead + 1]
            elif 100 * hits[-1] >= percent * (n + len(s) - hits[-1]):
                found.append(self.order[row])
        return found


def tree_keys(g: np.ndarray, order: Frequent) -> np.ndarray:
    """Keys that sort frequent shingles first, so that paths are shared."""
    late = order.marks(g)
    return np.sort((g >> _U(1)) | np.where(late, _U(0), _U(1 << 63)))


# ---------------------------------------------------------------- blocks against blocks


class Sets:
    """Sets as rows (set, shingle), sorted: of each its tile, document, size,
    component, first row, number of rows, and of rows that lie in other tiles only."""

    def __init__(self, tile: np.ndarray, doc: np.ndarray, name: np.ndarray, n: np.ndarray, comp: np.ndarray, rows: np.ndarray, key: np.ndarray):
        by = np.lexsort((key, name, doc, tile))
        new = np.ones(len(by), bool)
        for i, c in enumerate((tile, doc, name)):
            c = c[by]
            new[1:] = (new[1:] if i else False) | (c[1:] != c[:-1])
        self.start = np.flatnonzero(new)
        self.len = np.diff(np.append(self.start, len(by)))
        self.key = key[by]
        at = by[self.start]
        self.tile, self.doc, self.n, self.comp = tile[at], doc[at], n[at], comp[at]
        self.away = rows[at] - self.len

    def __len__(self) -> int:
        return len(self.start)


class Forest:
    """A prefix tree per tile. Nodes 0 to ``tiles - 1`` are the roots; a node
    covers the sets from ``lo`` to ``hi`` in the order of their paths."""

    def __init__(self, sets: Sets, tiles: int):
        raw, k = sets.key.astype(">u4").tobytes(), sets.start.tolist()
        size = sets.len.tolist()
        tile = sets.tile.tolist()
        order = sorted(range(len(sets)), key=lambda i: (tile[i], raw[4 * k[i]:4 * (k[i] + size[i])]))
        self.order = np.array(order, np.int64)
        total = tiles + len(sets.key)
        self.key, self.parent = np.zeros(total, np.int64), np.full(total, -1, np.int64)
        self.lo, self.hi = np.zeros(total, np.int64), np.zeros(total, np.int64)
        depth, last = np.zeros(total, np.int64), np.zeros(len(order), np.int64)
        path, nodes, before = np.zeros(int(sets.len.max()) + 1, np.int64), tiles, None
        for j, i in enumerate(order):
            s = sets.key[k[i]:k[i] + size[i]]
            if before is not None and tile[before] == tile[i]:
                m = min(size[before], size[i])
                differ = np.flatnonzero(sets.key[k[before]:k[before] + m] != s[:m])
                shared = int(differ[0]) if len(differ) else m
                self.hi[path[shared + 1:size[before] + 1]] = j
            else:
                if before is not None:
                    self.hi[path[:size[before] + 1]] = j
                shared, path[0] = 0, tile[i]
                self.lo[tile[i]] = j
            fresh = np.arange(nodes, nodes + size[i] - shared)
            path[shared + 1:size[i] + 1] = fresh
            self.key[fresh], self.parent[fresh] = s[shared:], path[shared:size[i]]
            self.lo[fresh], depth[fresh] = j, np.arange(shared + 1, size[i] + 1)
            nodes += len(fresh)
            last[j] = path[size[i]]
            before = i
        self.hi[path[:size[before] + 1]] = len(order)
        self.key, self.parent, self.lo, self.hi = (x[:nodes] for x in (self.key, self.parent, self.lo, self.hi))
        self.depth = depth[:nodes]
        kids = np.argsort(self.parent, kind="stable")
        self.kids = kids[np.searchsorted(self.parent[kids], 0):]
        self.first = np.searchsorted(self.parent[self.kids], np.arange(nodes + 1))
        self.ends = np.argsort(last, kind="stable")  # sets that end at a node
        self.first_end = np.searchsorted(last[self.ends], np.arange(nodes + 1))
        # sizes of the sets below a node
        n = sets.n[self.order]
        self.least, self.most = np.full(nodes, np.iinfo(np.int64).max), np.zeros(nodes, np.int64)
        np.minimum.at(self.least, last, n)
        np.maximum.at(self.most, last, n)
        by = np.argsort(self.depth, kind="stable")
        level = np.searchsorted(self.depth[by], np.arange(int(self.depth.max()) + 2))
        for d in range(len(level) - 2, 0, -1):
            at = by[level[d]:level[d + 1]]
            np.minimum.at(self.least, self.parent[at], self.least[at])
            np.maximum.at(self.most, self.parent[at], self.most[at])


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): the places ``first .. first + count`` of every row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


def tree_pairs(probes: Sets, sets: Sets, tiles: int, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(probe, set, common shingles) of all pairs of a tile that share one and
    may link: at most ``n`` less the strangers met can be common. A row of one
    that the other side has passed is a stranger, as rows are whole prefixes
    in the global order, as far as they lie in the tile; in other tiles the pair
    can share no more than the shorter rest of the two prefixes."""
    if not len(probes) or not len(sets):
        return
    tree = Forest(sets, tiles)
    wide = int(max(probes.key.max(), sets.key.max())) + 1
    code = np.repeat(np.arange(len(probes)), probes.len) * wide + probes.key
    final = probes.key[probes.start + probes.len - 1]

    def meet(p: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(common, rows of the probe up to ``key``, a stranger to the probe)"""
        want = p * wide + key
        at = np.searchsorted(code, want, side="right")
        hit = code[np.maximum(at, 1) - 1] == want
        return hit, at - probes.start[p], ~hit & (key <= final[p])

    def able(p: np.ndarray, j: np.ndarray, hits: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> tuple[np.ndarray, ...]:
        y = tree.order[j]
        a, b = probes.n[p], sets.n[y]
        ok = (hits > 0) & ((100 + percent) * np.minimum(a - sx, b - sy) >= percent * (a + b))
        ok &= hits + np.minimum(probes.away[p], sets.away[y]) >= least_common(a, b, percent)
        return p[ok], y[ok], hits[ok]

    def tails(p: np.ndarray, j: np.ndarray, depth: np.ndarray, hits: np.ndarray, sy: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Below a node with one set its rest is met at once."""
        y = tree.order[j]
        left = sets.len[y] - depth
        cut = np.flatnonzero(np.diff(np.cumsum(left) // (4 * WALK_PAIRS), prepend=0)) if len(p) else []
        for q in np.split(np.arange(len(p)), cut):
            if not len(q):
                continue
            row, at = _spread(sets.start[y[q]] + depth[q], left[q])
            hit, _, strange = meet(p[q][row], sets.key[at])
            h = hits[q] + np.bincount(row[hit], minlength=len(q))
            s = sy[q] + np.bincount(row[strange], minlength=len(q))
            passed = meet(p[q], sets.key[sets.start[y[q]] + sets.len[y[q]] - 1])[1]
            yield able(p[q], j[q], h, passed - h, s)

    pairs = np.cumsum((tree.hi - tree.lo)[probes.tile])
    for p in np.split(np.arange(len(probes)), np.flatnonzero(np.diff(pairs // WALK_PAIRS, prepend=0))):
        node = probes.tile[p]
        hits, sy = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        while len(p):
            row, at = _spread(tree.first[node], tree.first[node + 1] - tree.first[node])
            p, node = p[row], tree.kids[at]
            hit, passed, strange = meet(p, tree.key[node])
            hits, sy = hits[row] + hit, sy[row] + strange
            sx = passed - hits
            # sizes that a set must have to link, given the strangers so far
            n = probes.n[p]
            low, high = percent * n + (100 + percent) * sy, (100 + percent) * (n - sx) - percent * n
            on = (100 * tree.most[node] >= low) & (percent * tree.least[node] <= high)
            p, node, hits, sy, sx, passed = (c[on] for c in (p, node, hits, sy, sx, passed))
            through = passed == probes.len[p]
            one = ~through & (tree.hi[node] - tree.lo[node] == 1)
            row, j = _spread(tree.lo[node[through]], (tree.hi - tree.lo)[node[through]])
            yield able(p[through][row], j, hits[through][row], sx[through][row], sy[through][row])
            yield from tails(p[one], tree.lo[node[one]], tree.depth[node[one]], hits[one], sy[one])
            go = ~through & ~one
            p, node, hits, sy, sx = (c[go] for c in (p, node, hits, sy, sx))
            row, at = _spread(tree.first_end[node], tree.first_end[node + 1] - tree.first_end[node])
            yield able(p[row], tree.ends[at], hits[row], sx[row], sy[row])


def _tree_join(rows: DataFrame, order: Frequent, percent: int) -> DataFrame:
    """(a, b, n, m, c): pairs of sets of different components with their common
    prefix shingles, from rows (h, doc, k1, n, comp, main), where ``main`` is the
    largest component of a shingle's group. The groups of one ``main`` meet
    together: sets outside of it (probes) in blocks, with all sets in blocks."""
    minor = F.col("comp") != F.col("main")
    sizes = rows.groupBy("main").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("every"),
                                     F.ceil(F.count(F.when(minor, 1)) / TILE_ROWS).cast("int").alias("minors"))
    # a set has its rows in the groups of several components
    sized = rows.join(sizes, "main").join(rows.groupBy("doc", "k1").agg(F.count("*").alias("rows")), ["doc", "k1"])
    own = F.xxhash64("doc")
    cols = ["main", "h", "doc", "k1", "n", "comp", "rows"]
    dealt = sized.select(*cols, F.lit(False).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("minors") - 1)).alias("x"),
                         F.pmod(own, F.col("every")).cast("int").alias("y"))
    dealt = dealt.unionByName(sized.filter(minor).select(*cols, F.lit(True).alias("probe"), F.pmod(own, F.col("minors")).cast("int").alias("x"),
                                                         F.explode(F.sequence(F.lit(0), F.col("every") - 1)).alias("y")))
    dealt = dealt.repartition(shuffle_parts(rows.sparkSession), "main", "x", "y").sortWithinPartitions("main", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_runs(batches, ["main", "x", "y"], 1 << 15):
            main, h, doc, k1, n, comp, rows_, probe = (t.column(c).to_numpy(zero_copy_only=False) for c in [*cols, "probe"])
            h = h.view(np.uint64)
            tile = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            late = order.marks(h)
            by = np.lexsort((h, late))
            key = np.empty(len(by), np.int64)
            key[by] = np.cumsum(np.concatenate([np.zeros(1, bool), h[by][1:] != h[by][:-1]]))
            probes, sets = (Sets(*(c[side] for c in (tile, doc, k1, n.astype(np.int64), comp, rows_, key))) for side in (probe, ~probe))
            main = main[cuts[:-1]]
            for p, y, c in tree_pairs(probes, sets, len(cuts) - 1, percent):
                a, b = probes.doc[p], sets.doc[y]
                # two sets outside the main component meet twice
                ok = (probes.comp[p] != sets.comp[y]) & ((sets.comp[y] == main[sets.tile[y]]) | (a < b))
                a, b, c, n_, m = a[ok], b[ok], c[ok], probes.n[p[ok]], sets.n[y[ok]]
                first = a < b
                for i in range(0, len(a), 1 << 14):
                    s = slice(i, i + (1 << 14))
                    f = first[s]
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(f, u[s], v[s])) for u, v in ((a, b), (b, a), (n_, m), (m, n_))] + [pa.array(c[s])],
                                                     names=["a", "b", "n", "m", "c"])

    return dealt.mapInArrow(run, "a long, b long, n long, m long, c long")


# ---------------------------------------------------------------- the join


def _describe(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2): size and a 128-bit name of each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                g, row = shingle_sets(*text_buffer(b.column(1)), words)
                n = np.bincount(row, minlength=b.num_rows)
                names = set_names(g, n)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(names[0]), pa.array(names[1])],
                                                 names=["doc_id", "n_shingles", "k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long")


def _prefixes(docs: DataFrame, order: Frequent, words: int, percent: int) -> DataFrame:
    """(h, k1, n, late): the first shingles of each set in the global order.
    A task gives each set once, so copies meet as a few rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                g, row = shingle_sets(*text_buffer(b.column(0)), words)
                n = np.bincount(row, minlength=b.num_rows)
                name = set_names(g, n)[0]
                fresh = np.zeros(b.num_rows, bool)
                for i in np.flatnonzero(n).tolist():
                    k = int(name[i])
                    if k not in seen:
                        seen.add(k)
                        fresh[i] = True
                late = order.marks(g)
                by = np.lexsort((g, late, row))
                g, row, late = g[by], row[by], late[by]
                place = np.arange(len(g)) - (np.cumsum(n) - n)[row]
                keep = (place < prefix_size(n, percent)[row]) & fresh[row]
                g, row, late = g[keep], row[keep], late[keep]
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(name[row]),
                                                  pa.array(n[row].astype(np.int32)), pa.array(late)], names=["h", "k1", "n", "late"])

    return docs.select("text").mapInArrow(run, "h long, k1 long, n int, late boolean")


def _shared_only(rows: DataFrame) -> DataFrame:
    """Distinct rows of shingles that occur in several sets, or may: outside the
    frequent ranges a shingle's group is bounded and meets in one task, which
    drops those of a single set. Frequent ones are dealt out by their set too,
    and stay."""
    salt = F.when(F.col("late"), F.pmod(F.xxhash64("k1"), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = rows.repartition(shuffle_parts(rows.sparkSession), "h", salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        h, k = t.column("h").to_numpy(), t.column("k1").to_numpy()
        by = np.lexsort((k, h))
        h, k = h[by], k[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        by, h = by[new], h[new]
        same = h[1:] == h[:-1]
        keep = t.column("late").to_numpy()[by]
        keep[1:] |= same
        keep[:-1] |= same
        yield from t.select(["h", "k1", "n"]).take(pa.array(by[keep])).combine_chunks().to_batches()

    return dealt.mapInArrow(run, "h long, k1 long, n int")


def least_common(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """``_enough`` in numbers: common prefix shingles that linked sets have."""
    return -(-percent * (n + m) // (100 + percent)) - (-(-percent * np.maximum(n, m) // 100) - 1)


def _enough(percent: int):
    """Common prefix shingles that a pair (n, m, c) must have: what the set
    whose prefix ends first can still share beyond it is ``n - prefix``."""
    a, b = F.col("n"), F.col("m")
    least = F.ceil(percent * (a + b) / (100.0 + percent) - 1e-9)
    rest = F.greatest(F.ceil(percent * a / 100.0 - 1e-9), F.ceil(percent * b / 100.0 - 1e-9)) - 1
    fits = (100 * F.least(a, b) >= percent * F.greatest(a, b))
    return fits & (F.col("c") >= least - rest)


def _verify(pairs: DataFrame, docs: DataFrame, order: Frequent, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link. Every probe ``a`` meets its candidates in blocks
    of about ``BLOCK``; texts are read once more and only those of candidates
    go on as sets."""
    spark = pairs.sparkSession
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.select("a", "b").join(blocks, "a")
    dealt = dealt.select("a", "b", "blocks", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    roles = dealt.select(F.col("b").alias("doc_id"), "a", "block", F.lit(False).alias("probe")).unionByName(
        blocks.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                      F.lit(True).alias("probe")))
    roles = written(roles, "roles")
    ids = written(roles.select("doc_id").distinct(), "ids")
    wanted = IdFilter(ids).split(docs)[0].join(apart(ids), "doc_id", "left_semi")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                g, row = shingle_sets(*text_buffer(b.column(1)), words)
                cut = np.searchsorted(row, np.arange(b.num_rows + 1))
                sets = [tree_keys(g[x:y], order).tobytes() for x, y in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["doc_id", "keys"])

    sets = wanted.select("doc_id", "text").mapInArrow(keys, "doc_id long, keys binary")
    meet = roles.join(sets, "doc_id").select("a", "block", "probe", F.col("doc_id").alias("b"), "keys")
    meet = meet.repartition(shuffle_parts(spark), "a", "block").sortWithinPartitions("a", "block", "probe", "b")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_runs(batches, ["a", "block"], 1024):
            a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
            probe = t.column("probe").to_numpy()
            raw = t.column("keys")
            out_a, out_b = [], []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                sets = [np.frombuffer(raw[i].as_py(), np.uint64) for i in range(x, y)]
                split = int(np.searchsorted(probe[x:y], True))
                tree = PrefixTree(sets[:split])
                for p in sets[split:]:
                    for i in tree.links(p, percent):
                        out_a.append(a[x])
                        out_b.append(b[x + i])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return written(meet.mapInArrow(walk, "a long, b long").distinct(), "verified")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                          percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, class_id``
    (the smallest id with the same set).

    A null, empty or blank text has no shingles and links with nothing: its row
    is its own component. A null id keeps its size and belongs to no component.
    Rows that repeat an id are one document: their sets count as linked. Other
    columns are ignored, an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = written(_describe(docs, words), "named")
    classes = (named.filter("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles")
               .agg(F.min("doc_id").alias("class_id")))
    classes = written(classes, "classes")
    order = frequent_ranges(docs, lambda data, off: shingle_sets(data, off, words)[0])
    rows = _prefixes(docs.filter("doc_id is not null"), order, words, percent)
    # a name that two sets should share only adds candidates
    met = written(_shared_only(rows).join(classes.select("k1", F.col("class_id").alias("doc")), "k1").select("h", "doc", "n", "k1"), "met")

    # stars: every member of a group with the group's smallest
    low = met.groupBy("h").agg(F.min("doc").alias("a"))
    low = low.join(met.select("h", F.col("doc").alias("a"), F.col("n").alias("m")), ["h", "a"])
    stars = met.join(low, "h").filter("doc <> a").groupBy("a", F.col("doc").alias("b"), "n", "m").agg(F.count("*").alias("c"))
    stars = written(stars.filter(_enough(percent)).select("a", "b").distinct(), "stars")
    linked = _verify(stars, docs, order, words, percent)
    comp = written(connected_components(linked), "stars-cc")

    # what is left: pairs of a group whose components differ
    tagged = met.join(comp, F.col("doc") == F.col("node"), "left").select(
        "h", "doc", "n", "k1", F.coalesce("component", "doc").alias("comp"))
    per = tagged.groupBy("h", "comp").agg(F.count("*").alias("k"))
    span = per.groupBy("h").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps"))
    open_ = written(tagged.join(span.filter("comps > 1"), "h"), "open")
    # one side outside the group's largest component: its members are as good
    # as linked and must not meet each other; counts of a pair add up
    rest = _tree_join(open_, order, percent).groupBy("a", "b", "n", "m").agg(F.sum("c").alias("c"))
    rest = rest.filter(_enough(percent)).select("a", "b").distinct()
    rest = written(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    # sets under one id are one document
    member = named.join(classes, ["k1", "k2", "n_shingles"]).filter("doc_id is not null").select("doc_id", F.col("class_id").alias("b"))
    several = member.groupBy("doc_id").agg(F.min("b").alias("a"), F.max("b").alias("z")).filter("a < z").drop("z")
    same = member.join(several, "doc_id").select("a", "b")
    extra = written(same if rest.isEmpty() else same.unionByName(_verify(rest, docs, order, words, percent)), "extra")
    if not extra.isEmpty():
        comp = written(connected_components(linked.unionByName(extra)), "cc")

    joined = classes.join(comp, F.col("class_id") == F.col("node"), "left").select(
        "k1", "k2", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = named.join(joined, ["k1", "k2", "n_shingles"], "left")
    own = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(own, F.coalesce("component_id", "doc_id")).alias("component_id"),
                      F.when(own, F.coalesce("class_id", "doc_id")).alias("class_id"))


def op6_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id")
