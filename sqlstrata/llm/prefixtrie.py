"""Prefix trie of rebuilt conversations by composable fingerprints.

A rebuilt conversation is the head of a base conversation followed by its own
turns after as many. Neither texts nor rebuilt turn lists are made: a turn is
known by its reference (conversation, position) and content digest, and a
sequence of turns by an element of a monoid,

    (g, n) = (sum of t_i r^i over its n turns, n)   modulo 2^61 - 1, for two bases r,

in which  (g, n) (g', n') = (g + r^n g', n + n')  joins two sequences. Prefixes
of all stored conversations are one scan (cumulative sums in each part of a
range-sorted table, then what the parts before contribute). A rebuilt prefix is
the product of a head's prefix and an own prefix divided by the own head, both
looked up: three numbers, whatever the lengths.

A node is a group of equal (depth, fingerprint). That its members really are one
sequence is verified by the stored references: all must have the same digest
of the last turn and the same parent fingerprint, which by induction over depth
makes all turns equal. A collision is found by this and ends the attempt; the
next one has other bases.

Sums over subtrees need no walk over levels: each node is charged to its smallest
member, at the node's depth, and a subtree's sum is the sum over the members
of the node of what is charged to them from that depth on (one more scan).
No operator gathers a conversation or a group of members in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlstrata.llm.common import n_words_expr, shuffle_parts, table, written

#: Conversations of a family share the head of the one whose id this divides.
FAMILY = 20
#: Heads have 0 to HEADS - 1 turns.
HEADS = 4
#: Pairs of bases, tried in turn (any numbers far from 0 and the modulus do).
BASES = ((0x1B873593_9E3779B9 % ((1 << 61) - 1), 0x165667B1_85EBCA77), (0x0F0E1D2C_27220A95, 0x1C64E6D5_A0761D65))
#: Bytes of a piece of a node's list of ids.
PIECE = 1 << 20

_P = (1 << 61) - 1
_U = np.uint64
_PU = _U(_P)

# ---------------------------------------------------------------- numbers modulo 2^61 - 1


def mod_p(x: np.ndarray) -> np.ndarray:
    x = (x & _PU) + (x >> _U(61))
    return np.where(x >= _PU, x - _PU, x)


def mul_p(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo p of numbers below p, by halves of 31 and 30 bits."""
    lo31, lo30 = _U((1 << 31) - 1), _U((1 << 30) - 1)
    ah, al, bh, bl = a >> _U(31), a & lo31, b >> _U(31), b & lo31
    mid = al * bh + ah * bl
    return mod_p(mod_p(ah * bh * _U(2) + (mid >> _U(30))) + mod_p(((mid & lo30) << _U(31)) + al * bl))


def add_p(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mod_p(a + b)


def sub_p(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mod_p(a + (_PU - b))


def pow_p(base: int, n: np.ndarray) -> np.ndarray:
    """``base ** n`` modulo p, by squaring."""
    out, n, b = np.ones(len(n), np.uint64), n.astype(np.uint64), base
    while len(n) and n.any():
        out = np.where(n & _U(1), mul_p(out, np.full(len(n), b, np.uint64)), out)
        b, n = b * b % _P, n >> _U(1)
    return out


def run_sums(t: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums modulo p of ``t`` up to each row, from the row ``start`` of its group on.
    Halves are summed apart, which has room for 2^32 rows."""
    def up(x: np.ndarray) -> np.ndarray:
        c = np.cumsum(x, dtype=np.uint64)
        return c - np.where(start > 0, c[start - 1], _U(0))
    low = up(t & _U(0xFFFFFFFF))
    return add_p(mod_p(low), mul_p(mod_p(up(t >> _U(32))), np.full(len(t), 1 << 32, np.uint64)))


# ---------------------------------------------------------------- scans over range-sorted parts


def _starts(key: np.ndarray) -> np.ndarray:
    """For each row, the first row of its group (equal neighbours)."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return np.repeat(at, np.diff(np.append(at, len(key))))


def _sorted_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.repartitionByRange(shuffle_parts(df.sparkSession), *order).sortWithinPartitions(*order)


def scan(df: DataFrame, key: str, order: list[Column], ddl: str, local: Callable, carry: Callable, state: tuple[str, ...], zero: tuple, name: str) -> DataFrame:
    """A scan along each ``key``, over a table in parts that may cut a key anywhere.

    ``local(batch, first state)`` scans one batch of a part; ``state`` names the
    columns that hold what has gone into a row. The state after a part's last row
    is all that the next part needs: one row per part is sent to the driver, as
    many as there are shuffle partitions. ``carry(batch, state)`` adds what came
    before a part to the rows of its first key."""
    at = df.columns.index(key)
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, now = TaskContext.get().partitionId(), None, zero
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(at).to_numpy(zero_copy_only=False)
            cols, now = local(b, k, now if last == k[0] else zero)
            last = k[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32))] + cols, names=["part"] + names)

    done = written(_sorted_parts(df, order).mapInArrow(run, "part int, " + ddl), name)
    # the last row of a part has the largest state, and so does the last of its last key
    ends = done.groupBy("part").agg(F.min(key).alias("first"), F.max_by(F.struct(F.col(key).alias("key"), *state), F.struct(key, state[-1])).alias("end")).collect()
    carried: dict[int, tuple] = {}
    last, now = None, zero
    for x in sorted(ends, key=lambda x: x["part"]):
        if last is not None and x["first"] == last:
            carried[x["part"]] = (last, now)
        end = tuple(x["end"][s] for s in state)
        now = carry_state(end, now, carry) if x["end"]["key"] == last else end
        last = x["end"]["key"]
    if not carried:
        return done.drop("part")
    k_at = 1 + names.index(key)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, k = b.column(0).to_numpy(zero_copy_only=False), b.column(k_at).to_numpy(zero_copy_only=False)
            cols = {n: b.column(i + 1) for i, n in enumerate(names)}
            for p in np.unique(part):
                if int(p) in carried:
                    who, before = carried[int(p)]
                    rows = np.flatnonzero((part == p) & (k == who))
                    if len(rows):
                        vals = [cols[s].to_numpy(zero_copy_only=False).copy() for s in state]
                        for v, x in zip(vals, carry([v[rows] for v in vals], before)):
                            v[rows] = x
                        cols.update({s: pa.array(v) for s, v in zip(state, vals)})
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return done.mapInArrow(add, ddl)


def carry_state(end: tuple, before: tuple, carry: Callable) -> tuple:
    return tuple(int(x[0]) for x in carry([np.array([v]) for v in end], before))


# ---------------------------------------------------------------- stored conversations


def _digest() -> Column:
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words): a row per stored turn; the digest is that of
    the role and text (null: empty). Turns without a conversation are left out."""
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _digest().alias("digest"), n_words_expr("text").alias("words"))


def _elements(digest: pa.Array) -> list[np.ndarray]:
    raw = np.frombuffer(b"".join(digest.to_pylist()), "<u8").reshape(-1, 4)
    return [mod_p(raw[:, 0] & _U((1 << 63) - 1)), mod_p(raw[:, 1] & _U((1 << 63) - 1))]


def prefixes(stored: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """(conv_id, k, g1, g2, digest, words): the fingerprint of the first k turns of
    each stored conversation, and the k-th turn."""

    def local(b: pa.RecordBatch, conv: np.ndarray, before: tuple) -> tuple[list, tuple]:
        start = _starts(conv)
        k = np.arange(len(conv)) - start + 1
        first = start == 0
        k[first] += before[2]
        sums = []
        for t, r, was in zip(_elements(b.column(2)), bases, before):
            g = run_sums(mul_p(t, pow_p(r, k)), start)
            g[first] = add_p(g[first], np.full(int(first.sum()), was, np.uint64))
            sums.append(g)
        cols = [b.column(0), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(k.astype(np.int64)), b.column(2), b.column(3)]
        return cols, (int(sums[0][-1]), int(sums[1][-1]), int(k[-1]))

    def carry(vals: list[np.ndarray], before: tuple) -> list[np.ndarray]:
        g = [add_p(mul_p(v.astype(np.uint64), np.full(len(v), pow(r, before[2], _P), np.uint64)), np.full(len(v), was, np.uint64)).astype(np.int64)
             for v, r, was in zip(vals, bases, before)]
        return [*g, vals[2] + before[2]]

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    return scan(stored, "conv_id", order, "conv_id long, g1 long, g2 long, k long, digest binary, words long",
                local, carry, ("g1", "g2", "k"), (0, 0, 0), "prefixes")


# ---------------------------------------------------------------- rebuilt conversations


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def members(stored: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """(conv_id, depth, f1, f2, p1, p2, digest, words, ends, ref_conv, ref_k): each
    prefix of each rebuilt conversation, with its own and its parent's
    fingerprint and a reference to its last turn; ``ends`` at its whole length."""
    done = prefixes(stored, bases)
    c, k = F.col("conv_id"), F.col("k")
    fp = F.struct("g1", "g2")
    none = F.struct(F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"))
    convs = done.groupBy("conv_id").agg(F.max("k").alias("n"), F.max(F.when(k == head_length(c), fp)).alias("own"))
    convs = convs.withColumn("h", head_length(c).cast("int")).withColumn("base", c - c % FAMILY)
    heads = done.filter((c % FAMILY == 0) & (k < HEADS)).groupBy("conv_id").agg(  # at most three turns each
        F.sort_array(F.collect_list(F.struct("k", "g1", "g2", "digest", "words"))).alias("head")).withColumnRenamed("conv_id", "base")
    convs = convs.join(heads, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.greatest(F.col("h"), F.lit(1))))
    convs = convs.withColumn("head", F.when(F.col("h") > 0, F.col("head")).otherwise(F.array().cast(heads.schema["head"].dataType)))
    convs = written(convs.select("conv_id", "base", "h", "n", "own", "head", F.size("head").cast("long").alias("hb"),
                                 F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest")), "rebuilt")
    length = F.col("hb") + F.col("rest")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(x) for x in ("f1", "f2", "p1", "p2")],
                        F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"), (length == 0).alias("ends"),
                        F.lit(None).cast("long").alias("ref_conv"), F.lit(None).cast("long").alias("ref_k"))
    before = lambda x, i: F.when(i > 0, F.element_at(F.col("head"), F.greatest(i, F.lit(1)))[x]).otherwise(0)
    spread = convs.select("conv_id", "base", "head", length.alias("length"), F.posexplode("head").alias("i", "x"))
    head = spread.select(
        "conv_id", F.col("x.k").alias("depth"), F.col("x.g1").alias("f1"), F.col("x.g2").alias("f2"), before("g1", F.col("i")).alias("p1"),
        before("g2", F.col("i")).alias("p2"), F.col("x.digest").alias("digest"), F.col("x.words").alias("words"),
        (F.col("length") == F.col("x.k")).alias("ends"), F.col("base").alias("ref_conv"), F.col("x.k").alias("ref_k"))
    top = F.when(F.col("hb") > 0, F.element_at("head", -1))
    seed = convs.filter("rest > 0").select(
        "conv_id", "h", "hb", "rest", F.coalesce(F.col("own"), none).alias("own"),
        F.when(F.col("hb") > 0, F.struct(top["g1"].alias("g1"), top["g2"].alias("g2"))).otherwise(none).alias("top"))
    # a long conversation is split by the join where it is skewed: its other side is one row
    own = done.join(seed, "conv_id").filter("k > h").select(
        "conv_id", "k", "g1", "g2", "digest", "words", "h", "hb", "rest", F.col("own.g1").alias("o1"), F.col("own.g2").alias("o2"),
        F.col("top.g1").alias("t1"), F.col("top.g2").alias("t2"))
    shift = [[pow(r, -d, _P) for d in range(HEADS)] for r in bases]

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names) if n != "digest"}
            depth = v["hb"] + v["k"] - v["h"]
            out = []
            for j, r in (("1", 0), ("2", 1)):
                u = lambda n: v[n].astype(np.uint64)  # noqa: B023, E731
                by = np.array(shift[r], np.uint64)[v["h"] - v["hb"]]
                f = add_p(u("t" + j), mul_p(sub_p(u("g" + j), u("o" + j)), by))
                # the parent lacks the last turn
                t = _elements(b.column(b.schema.get_field_index("digest")))[r]
                p = sub_p(f, mul_p(t, pow_p(bases[r], depth)))
                out += [pa.array(f.astype(np.int64)), pa.array(p.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(depth), out[0], out[2], out[1], out[3], b.column(4), b.column(5),
                 pa.array(v["k"] - v["h"] == v["rest"]), b.column(0), b.column(1)],
                names=["conv_id", "depth", "f1", "f2", "p1", "p2", "digest", "words", "ends", "ref_conv", "ref_k"])

    tail = own.mapInArrow(suffix, "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, digest binary, words long, ends boolean, "
                                  "ref_conv long, ref_k long")
    return written(root.unionByName(head).unionByName(tail), "members")


# ---------------------------------------------------------------- nodes

NODE = ["depth", "f1", "f2"]


def _charged(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, f1, f2, n_leaves, saved_tokens). Charged to a conversation at a
    depth: the words of its turn, less the turn's words if the node is its own (the
    smallest member's), and a leaf if such a node has no children."""
    zero = F.lit(0).cast("long")
    own = nodes.select("conv_id", (-F.col("depth")).alias("up"), zero.alias("f1"), zero.alias("f2"), F.lit(0).alias("kind"),
                       F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0).cast("long").alias("leaves"), (-F.col("words")).alias("saved"))
    path = rows.select("conv_id", (-F.col("depth")).alias("up"), "f1", "f2", F.lit(1).alias("kind"), zero.alias("leaves"), F.col("words").alias("saved"))

    def local(b: pa.RecordBatch, conv: np.ndarray, before: tuple) -> tuple[list, tuple]:
        start = _starts(conv)
        sums = []
        for i, was in ((5, before[0]), (6, before[1])):
            c = np.cumsum(b.column(i).to_numpy(zero_copy_only=False))
            c = c - np.where(start > 0, c[start - 1], 0)
            c[start == 0] += was
            sums.append(c)
        n = np.arange(len(conv)) - start + 1
        n[start == 0] += before[2]
        return [b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(sums[0]), pa.array(sums[1]), pa.array(n)], (
            int(sums[0][-1]), int(sums[1][-1]), int(n[-1]))

    done = scan(own.unionByName(path), "conv_id", [F.col("conv_id"), F.col("up"), F.col("kind")],
                "conv_id long, up long, f1 long, f2 long, kind int, leaves long, saved long, n long", local,
                lambda vals, before: [v + x for v, x in zip(vals, before)], ("leaves", "saved", "n"), (0, 0, 0), "charged")
    return done.filter("kind = 1").groupBy((-F.col("up")).alias("depth"), "f1", "f2").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _end_digests(rows: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of the nodes at which conversations end.

    The decimal ids are sorted and joined in pieces wherever they lie; the digest
    of a node streams over its pieces in order and holds one at a time."""
    order = [*NODE, "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*node, first)] + [pa.array([",".join(ids)])],
                                              names=[*NODE, "first", "ids"])

        for b in batches:
            for d, f1, f2, c in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if node != (d, f1, f2) or size > PIECE:
                    if ids:
                        yield piece()
                    node, first, ids, size = (d, f1, f2), c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in node] + [pa.array([sha.hexdigest()])], names=[*NODE, "ends_sha256"])

        for b in batches:
            for d, f1, f2, ids in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                if node != (d, f1, f2):
                    if node:
                        yield out()
                    node, sha = (d, f1, f2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if node:
            yield out()

    ends = _sorted_parts(rows.filter("ends").select(*order), [F.col(x) for x in order])
    cut = ends.mapInArrow(pieces, "depth long, f1 long, f2 long, first long, ids string")
    cut = cut.repartition(shuffle_parts(rows.sparkSession), *NODE).sortWithinPartitions(*NODE, "first")
    return cut.mapInArrow(digests, "depth long, f1 long, f2 long, ends_sha256 string")


class Collision(Exception):
    """Two sequences of turns have one fingerprint."""


def _nodes(stored: DataFrame, bases: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    rows = members(stored, bases)
    nodes = written(rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"),
        F.max("words").alias("words"), F.min(F.struct("ref_conv", "ref_k")).alias("ref"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        # what the references say of all members must be one thing
        (F.min("digest").eqNullSafe(F.max("digest")) & (F.min("p1") == F.max("p1")) & (F.min("p2") == F.max("p2"))).alias("one")), "nodes")
    if not nodes.filter("not one").isEmpty():
        raise Collision
    return rows, nodes


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and ref_conv, ref_k: where the node's last
    turn is stored (the k-th of a conversation; null for the root).

    Turns are ordered by ``turn``, null first, and those of one number by the digest
    of their content. Null roles and texts are empty; rows without ``conv_id`` take
    no part; an empty table has no nodes, not even a root. Rows that repeat are
    turns of their own. Long conversations and texts are taken whole. Columns
    other than conv_id, turn, role and text are not read, whatever their names.
    """
    stored = written(turns(conversations), "turns")
    for bases in BASES:
        try:
            rows, nodes = _nodes(stored, bases)
            break
        except Collision:
            continue
    else:
        raise Collision("fingerprints collide under all pairs of bases")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    out = (nodes.join(_charged(rows, nodes), NODE).join(children, NODE, "left").join(_end_digests(rows), NODE, "left")
           .join(parents, ["depth", "p1", "p2"], "left"))
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
                      F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), F.col("ref.ref_conv").alias("ref_conv"), F.col("ref.ref_k").alias("ref_k"))


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes with ``role`` and ``text`` of their last turn, looked up by reference
    (null for the root; a null stored role or text is empty)."""
    place = prefixes(written(turns(conversations), "turns"), BASES[0]).select(F.col("conv_id").alias("ref_conv"), F.col("k").alias("ref_k"), "digest")
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    said = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("ref_conv"), _digest().alias("digest"), role.alias("role"), text.alias("text")).dropDuplicates(["ref_conv", "digest"])
    return nodes.join(place, ["ref_conv", "ref_k"], "left").join(said, ["ref_conv", "digest"], "left").drop("digest")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("ref_conv", "ref_k")
