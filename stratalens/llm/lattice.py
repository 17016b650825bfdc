"""Near-duplicate vectors by hashing to cells of the E8 lattice.

Each table projects vectors at random into blocks of eight dimensions and takes the nearest E8
lattice point of every block as the cell. A vector also probes the neighbouring cells that
are nearest to it. Vectors that share a cell are compared by cosine in double precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import components, stored

#: Members of a cell that one group of work holds; larger cells are divided into pairs of such blocks.
BLOCK = 2000


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


_ROOTS = roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where the sum is odd, the least certain coordinate is rounded the other way."""
    r = np.rint(x)
    off = x - r
    odd = r.sum(1) % 2 != 0
    k = np.abs(off).argmax(1)
    rows = np.flatnonzero(odd)
    r[rows, k[rows]] += np.where(off[rows, k[rows]] >= 0, 1, -1)
    return r


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: E8 is the even integer points and the same moved by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


def _mixed(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit value of each row of lattice points (twice the coordinates are integers)."""
    h = np.full(len(points), 0x9E3779B97F4A7C15 ^ (salt * 0x51ED2701), np.uint64)
    for c in np.rint(points * 2).astype(np.int64).T.view(np.uint64):
        h = (h ^ c) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def cells(unit: np.ndarray, tables: int, blocks: int, scale: float, probes: int, seed: int = 5) -> np.ndarray:
    """Keys of the own cell and of the ``probes`` next cells in every table: vectors x keys."""
    n, d = unit.shape
    dice, out = np.random.default_rng(seed), []
    choices = np.array(list(itertools.product((0, 1), repeat=blocks)), bool)
    for t in range(tables):
        axes = np.linalg.qr(dice.standard_normal((max(d, 8 * blocks), 8 * blocks)))[0][:d]
        x = (unit @ axes * (scale * np.sqrt(d / 8))).reshape(n, blocks, 8)
        first, second, margin = np.empty_like(x), np.empty_like(x), np.empty((n, blocks))
        for b in range(blocks):
            first[:, b] = nearest(x[:, b])
            toward = (x[:, b] - first[:, b]) @ _ROOTS.T
            best = toward.argmax(1)
            second[:, b] = first[:, b] + _ROOTS[best]
            margin[:, b] = 2 - 2 * toward[np.arange(n), best]  # how much farther the second point is, squared
        extra = margin @ choices.T
        order = np.argsort(extra, axis=1, kind="stable")[:, :probes + 1]
        for k in range(order.shape[1]):
            use = choices[order[:, k]]
            out.append(_mixed(np.where(use[:, :, None], second, first).reshape(n, -1), t))
    return np.stack(out, 1) if out else np.zeros((n, 0), np.uint64)


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(wide, lambda x: x != 0), F.lit(False))


def vectors(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _compared(least: float):
    """Rows ordered by group of work to link counts and spanning links of each group."""
    def work(bucket: int, same: bool, block, node, size, x, keys) -> list[tuple]:
        near = unit_vectors(x)
        near = near @ near.T >= least
        np.fill_diagonal(near, False)
        if not same:
            near &= block[:, None] != block[None, :]
        if not near.any():
            return []
        # A pair counts in its smallest common cell only.
        row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        key = np.concatenate(keys)
        row, key = row[key < bucket], key[key < bucket]
        if len(key):
            names, at = np.unique(key, return_inverse=True)
            before = np.zeros(near.shape, np.float32)
            for start in range(0, len(names), 4096):
                inside = (at >= start) & (at < start + 4096)
                have = np.zeros((len(keys), min(4096, len(names) - start)), np.float32)
                have[row[inside], at[inside] - start] = 1
                have = have[:, have.sum(0) > 1]
                before += have @ have.T
            first = near & (before == 0)
        else:
            first = near
        links = first @ size
        label, old = np.arange(len(node)), None
        while old is None or (label != old).any():
            old = label
            label = np.minimum(label, np.where(near, label[None, :], len(node)).min(1))
            label = label[label]
        return [(n, int(c), m) for n, c, m in zip(node.tolist(), links.tolist(), node[label].tolist()) if c or m != n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def close() -> list[tuple]:
            if len(held) < 2:
                return []
            block, node, size, vector, keys = zip(*held)
            return work(key[0], key[1] == key[2], np.array(block), np.array(node), np.array(size, float), np.array(vector, float), [np.array(k) for k in keys])

        for batch in batches:
            out = []
            flat = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "block", "node", "size")]
            x = vectors(batch.column("vector"))
            keys = [np.asarray(k.values) for k in batch.column("keys")]
            for *group, block, node, size, vector, own in zip(*flat, x, keys):
                if key != tuple(group):
                    out += close() if key is not None else []
                    held, key = [], tuple(group)
                held.append((block, node, size, vector, own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["node", "links", "low"])
        out = close() if key is not None else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["node", "links", "low"])

    return run


def near_vectors(
    table: DataFrame, least: float = 0.95, tables: int = 12, blocks: int = 4, scale: float = 1.0, probes: int = 3,
    block: int = BLOCK,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``(vec_id, embedding)``.

    Vectors that are null, zero, or hold null or non-finite components link with nothing and stand
    alone. Equal vectors are one class; its copies link with each other and share all
    else. A pair that meets in a cell is linked exactly if its cosine reaches ``least``; with the defaults a pair at 0.95 meets with
    probability 0.999 in 64 dimensions (see the tests). Cells of any size are compared whole: over ``block`` members in
    pairs of blocks, each a task's work of bounded size. All vectors must have one length. Rows
    with a null ``vec_id`` take part only if their vector has another row; repeated ids are kept.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("usable", usable(F.col("vector")))
    classes = rows.where("usable").groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"))
    classes = stored(classes.where("node is not null"), "classes")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = np.sort(cells(unit_vectors(vectors(part.column("vector"))), tables, blocks, scale, probes), 1)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.reshape(-1).view(np.int64))
                )
                yield pa.RecordBatch.from_arrays([part.column("node"), lists], ["node", "keys"])

    own = classes.select("node", "vector").mapInArrow(keyed, "node long, keys array<long>")
    own = stored(own.select("node", F.explode(F.array_distinct("keys")).alias("bucket")), "cells")
    shared = own.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    used = own.join(shared, "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "members")).alias("uses"))
    members = used.join(classes, "node").select(
        "node", "size", "vector", F.col("uses.bucket").alias("keys"), F.explode("uses").alias("use")
    )
    parts = F.ceil(F.col("use.members") / block).cast("int")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    work = members.select(
        F.col("use.bucket").alias("bucket"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "size", "vector", "keys",
    )
    dealt = work.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = stored(dealt.mapInArrow(_compared(least), "node long, links long, low long"), "compared")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    classes = classes.join(links, "node", "left").join(whole, "node", "left").select(
        F.col("vector").alias("class_vector"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"),
        F.coalesce("component", "node").alias("component"),
    )
    out = rows.join(classes, rows["usable"] & (F.col("vector") == F.col("class_vector")), "left")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
