"""A hash tree over a dataset, with one proof per row, built without sorting the rows.

Every group (a language) has a compressed bitmap of its ids in chunks of 65,536, merged from the tasks' parts.
Popcounts, summed over three levels of chunks, make a directory; a rank query on a row's chunk gives its
place among the group's leaves. Leaves then fall into slot arrays keyed by place: one task folds 32,768 slots
over five levels at a time, so that a few rounds reach the root. Proofs go the same way down.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm import bitmaps
from stratalens.llm.common import rows_of, stored

#: Children of a node, and levels that one task folds: 32,768 leaves at once.
FAN, LEVELS = 8, 5
#: Ids that a task holds before it passes on their bitmaps.
HELD = 2_000_000
#: The chunk of null ids, below that of any number.
NO_ID = -(1 << 47) - 1
HEX = 64


def leaf_of(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of fields, each ``-`` if null, else its length in bytes, a colon and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(c), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _bitmaps(rows: DataFrame) -> DataFrame:
    """``(g, chunk, n, repeated, packed)``: the bitmap of every group's chunk, merged from the parts that tasks build."""
    schema = pa.schema([("g", pa.string()), ("chunk", pa.int64()), ("packed", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[str, int], list[bytes]] = {}
        held = 0

        def taken() -> Iterator[pa.RecordBatch]:
            keys = list(parts)
            yield from rows_of(schema, [[g for g, _ in keys], [c for _, c in keys], [bitmaps.merged(parts[k]) for k in keys]])
            parts.clear()

        for batch in batches:
            code = batch.column("g").dictionary_encode()
            names, g = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False)
            chunk, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "low"))
            order = np.lexsort((low, chunk, g))
            g, chunk, low = g[order], chunk[order], low[order]
            changed = np.r_[True, (np.diff(g) != 0) | (np.diff(chunk) != 0)]
            own = np.flatnonzero(changed | np.r_[True, np.diff(low) != 0])
            times = np.diff(np.r_[own, len(g)])
            cuts = np.flatnonzero(changed[own]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(own)]):
                key = (names[g[own[a]]], int(chunk[own[a]]))
                parts.setdefault(key, []).append(bitmaps.packed(low[own[a:b]], times[a:b]))
            held += len(own)
            if held > HELD:
                yield from taken()
                held = 0
        if parts:
            yield from taken()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [bitmaps.merged(p) for p in part.column("parts").to_pylist()]
                ranks = [bitmaps.Ranks(p) for p in found]
                columns = [pa.array([len(r) for r in ranks], pa.int64()), pa.array([len(r.repeated) for r in ranks], pa.int64()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("g"), part.column("chunk"), *columns], ["g", "chunk", "n", "repeated", "packed"])

    parts = rows.select("g", "chunk", "low").mapInArrow(build, "g string, chunk long, packed binary")
    # The parts of a chunk hold two bytes an id at most, and one task's part for an id that is repeated.
    return parts.groupBy("g", "chunk").agg(F.collect_list("packed").alias("parts")).mapInArrow(
        merge, "g string, chunk long, n long, repeated long, packed binary"
    )


def _placed_before(counts: DataFrame, path: list[str], n: str = "n") -> DataFrame:
    """``counts`` by the keys of ``path`` with ``before``: the sum of ``n`` over all earlier keys of the same first key.

    Each level adds up its siblings only, so a window holds the children of one parent.
    """
    out = counts
    for depth in range(len(path) - 1, 0, -1):
        parents = path[:depth]
        level = counts.groupBy(*path[:depth + 1]).agg(F.sum(n).alias("_n"))
        along = Window.partitionBy(*parents).orderBy(path[depth]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn(f"_before{depth}", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
        out = out.join(level, path[:depth + 1])
    sums = [f"_before{d}" for d in range(1, len(path))]
    return out.withColumn("before", functools.reduce(lambda a, b: a + b, map(F.col, sums))).drop(*sums)


def _directory(found: DataFrame) -> DataFrame:
    """Bitmaps with ``base`` (leaves of the group in earlier chunks) and ``total`` (leaves of the group)."""
    keyed = found.withColumns({"_high": F.shiftright("chunk", 32), "_middle": F.shiftright("chunk", 16)})
    counts = keyed.select("g", "_high", "_middle", "chunk", "n")
    base = _placed_before(counts, ["g", "_high", "_middle", "chunk"]).select("g", "chunk", F.col("before").alias("base"))
    total = found.groupBy("g").agg(F.sum("n").alias("total"))
    return found.join(base, ["g", "chunk"]).join(total, "g")


def _ranked(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """Rows with ``at``, their place among the group's leaves, ``total`` and ``tied``: whether other rows have their id.

    Rows meet the bitmap of their chunk in one task, the bitmap first. A chunk holds up to 65,536 ids; one that has more rows
    through repeated ids is dealt over several tasks, each with the bitmap.
    """
    hot = directory.where(F.col("n") > 2 * bitmaps.WIDTH).select("g", "chunk", F.ceil(F.col("n") / bitmaps.WIDTH).alias("shares"))
    shares = F.coalesce("shares", F.lit(1))
    own = rows.join(hot, ["g", "chunk"], "left").withColumn("share", F.pmod("row", shares)).drop("shares")
    maps = directory.join(hot, ["g", "chunk"], "left").select(
        "g", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"), "base", "total", "packed"
    )
    kept = ["g", "id", "leaf", "claimed", "row"]
    both = own.select(*kept, "chunk", "low", "share").unionByName(maps, allowMissingColumns=True)
    both = both.repartition("g", "chunk", "share").sortWithinPartitions("g", "chunk", "share", F.col("packed").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, base, total = None, 0, 0
        for batch in batches:
            heads = np.flatnonzero(batch.column("packed").is_valid().to_numpy(zero_copy_only=False)).tolist()
            low = batch.column("low").fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in zip([-1, *heads], [*heads, batch.num_rows]):
                if a >= 0:
                    ranks, base, total = bitmaps.Ranks(batch.column("packed")[a].as_py()), batch.column("base")[a].as_py(), batch.column("total")[a].as_py()
                if b - a > 1:
                    part, values = batch.slice(a + 1, b - a - 1), low[a + 1:b]
                    at = pa.array(base + ranks.rank(values), pa.int64())
                    columns = [*(part.column(c) for c in kept), at, pa.array(np.full(len(values), total)), pa.array(ranks.repeats(values))]
                    yield pa.RecordBatch.from_arrays(columns, [*kept, "at", "total", "tied"])

    schema = "g string, id long, leaf binary, claimed binary, row long, at long, total long, tied boolean"
    return both.mapInArrow(run, schema)


def _untied(ranked: DataFrame) -> DataFrame:
    """Rows of one group and id take the places from the first on, by their leaf; equal rows by number.

    Leaves of an id are counted by their first two bytes, by leaf, and by the task that wrote the row, so a window
    holds no more than a shelf of leaves or one task's equal rows, however often an id is repeated.
    """
    tied = ranked.where("tied").withColumns({"_shelf": F.substring("leaf", 1, 2), "_task": F.shiftright("row", 33)})
    path = ["g", "at", "_shelf", "leaf", "_task"]
    inside = tied.withColumn("_nth", F.row_number().over(Window.partitionBy(*path).orderBy("row")) - 1)
    counts = tied.groupBy(*path).agg(F.count("*").alias("n")).withColumn("_key", F.struct("g", "at"))
    before = _placed_before(counts, ["_key", "_shelf", "leaf", "_task"]).select(*path, "before")
    moved = inside.join(before, path).withColumn("at", F.col("at") + F.col("before") + F.col("_nth"))
    return ranked.where("not tied").unionByName(moved.select(ranked.columns))


def _levels(digests: list[bytes], total: int, levels: int) -> list[bytes]:
    """The levels of a block from its slots up, each as one string of hex digests.

    The only block of ``total`` nodes is folded to one, a block among others so many times.
    """
    out, lone = [b"".join(digests)], total <= FAN ** levels
    while len(out[-1]) > HEX if lone else len(out) <= levels:
        below, step = out[-1], FAN * HEX
        out.append(b"".join(hashlib.sha256(below[k:k + step]).hexdigest().encode() for k in range(0, len(below), step)))
    return out


def _slots(table: pa.Table, block: int, column: str = "digest") -> list[bytes]:
    """Hex digests of a block by slot."""
    slot = table.column("at").to_numpy() % block
    out = [b""] * len(slot)
    for k, raw in zip(slot.tolist(), table.column(column).to_pylist()):
        out[k] = raw.hex().encode()
    return out


def _folded(nodes: DataFrame, levels: int) -> DataFrame:
    """One node for each block of ``(g, at, total, digest)``, in the same columns."""
    names, block = ["g", "at", "total", "digest"], FAN ** levels

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = table.column("total")[0].as_py()
        top = _levels(_slots(table, block), total, levels)[-1]
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([-(-total // block)]), pa.array([bytes.fromhex(top.decode())])], names)

    keyed = nodes.select(*names, _block_of("at", levels).alias("block"))
    return keyed.groupBy("g", "block").applyInArrow(run, "g string, at long, total long, digest binary")


def _block_of(at: str, levels: int) -> Column:
    return F.shiftright(at, 3 * levels)  # 8 children, three bits a level


def _climbed(nodes: DataFrame, most: int, levels: int) -> list[DataFrame]:
    """The nodes and what remains of them after each round, to one node a group."""
    rounds = [nodes]
    while most > 1:
        rounds.append(stored(_folded(rounds[-1], levels), "merkle-nodes"))
        most = -(-most // FAN ** levels)
    return rounds


def _steps(levels: list[bytes], slot: int) -> Iterator[tuple[int, bytes]]:
    """Level by level where a node's digest begins in its run, and the run."""
    for level in levels[:-1]:
        start = (slot & -FAN) * HEX
        yield (slot % FAN) * HEX, level[start:start + FAN * HEX]
        slot //= FAN


_PATH = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.binary())]))
_PATH_SQL = "array<struct<place:int,run:binary>>"


def _descended(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """``(g, block, path, subroot)`` for the nodes of a round, each a block of the round below; ``paths`` are those of the round above."""
    names, block = ["g", "block", "path", "subroot"], FAN ** levels

    def run(above: pa.Table, table: pa.Table) -> pa.Table:
        rest, subroot = above.column("path")[0].as_py(), above.column("subroot")[0].as_py()
        own = _levels(_slots(table, block), table.column("total")[0].as_py(), levels)
        at = table.column("at").to_numpy()
        found = [[{"place": p, "run": r} for p, r in _steps(own, int(k) % block)] + rest for k in at]
        n = len(at)
        return pa.table([table.column("g"), pa.array(at), pa.array(found, _PATH), pa.array([subroot] * n, pa.binary())], names)

    keyed = nodes.withColumn("block", _block_of("at", levels))
    pairs = paths.groupBy("g", "block").cogroup(keyed.groupBy("g", "block"))
    return pairs.applyInArrow(run, f"g string, block long, path {_PATH_SQL}, subroot binary")


@dataclass
class Tree:
    """The leaves with their places, and for each block of leaves the way up to the root."""

    leaves: DataFrame  # g, id, leaf, claimed, at, total
    paths: DataFrame  # g, block, path, subroot
    root: str | None  # none without rows
    levels: int


def grown(
    docs: DataFrame, leaf: Column, claimed: Column | None = None, group: str = "lang", id_col: str = "doc_id", levels: int = LEVELS
) -> Tree:
    """The tree over all rows of ``docs``, one leaf a row.

    ``leaf`` is the digest of a row as 64 hex digits, ``claimed`` the one that is presented when the row is
    checked. Groups are ordered by their text in bytes, null first; in a group rows ascend by the integer id, null
    first, then by leaf. Equal rows have neighbouring places. A task folds ``8 ** levels`` nodes at once; the tree is the same for any.
    """
    number = F.col(id_col).cast("long")
    rows = stored(docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("g"), number.alias("id"),
        F.coalesce(F.shiftright(number, 16), F.lit(NO_ID)).alias("chunk"), F.coalesce(number.bitwiseAND(0xFFFF), F.lit(0).cast("long")).alias("low"),
        F.unhex(leaf).alias("leaf"), F.unhex(leaf if claimed is None else claimed).alias("claimed"), F.monotonically_increasing_id().alias("row"),
    ), "merkle-rows")
    found = stored(_bitmaps(rows), "merkle-bitmaps")
    directory = stored(_directory(found), "merkle-directory")
    size = directory.agg(F.max("total").alias("most"), F.sum("repeated").alias("repeated")).first()
    ranked = _ranked(rows, directory)
    if size.repeated:
        ranked = _untied(stored(ranked, "merkle-ranked"))
    leaves = stored(ranked.select("g", "id", "leaf", "claimed", "at", "total"), "merkle-leaves")
    below = _climbed(leaves.select("g", "at", "total", F.col("leaf").alias("digest")), size.most or 0, levels)

    # Groups are numbered by a range sort: partitions in order, rows in order inside them.
    tops = stored(below[-1].select(F.col("g").alias("of"), "digest").orderBy("of").withColumn("row", F.monotonically_increasing_id()), "merkle-groups")
    tops = tops.withColumn("part", F.shiftright("row", 33))
    parts = tops.groupBy("part").agg(F.count("*").alias("n"))
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.withColumn("first", F.coalesce(F.sum("n").over(along), F.lit(0)))
    many = tops.count()
    numbered = tops.join(parts, "part").select(
        F.lit("").alias("g"), "of", (F.col("first") + F.col("row").bitwiseAND((1 << 33) - 1)).alias("at"), F.lit(many).cast("long").alias("total"), "digest"
    )
    above = _climbed(stored(numbered, "merkle-top"), many, levels)

    spark = docs.sparkSession
    paths = spark.createDataFrame([("", 0, [], None)], f"g string, block long, path {_PATH_SQL}, subroot binary")
    for nodes in reversed(above):
        paths = _descended(nodes, paths, levels)
    names = above[0].select("of", F.col("at").alias("block"), F.col("digest").alias("_digest"))
    paths = paths.join(names, "block").select(F.col("of").alias("g"), F.lit(0).cast("long").alias("block"), "path", F.col("_digest").alias("subroot"))
    for nodes in reversed(below[1:]):
        paths = _descended(nodes, paths, levels)
    last = above[-1].first()
    return Tree(leaves, stored(paths, "merkle-paths"), last and bytes(last.digest).hex(), levels)


def proofs(tree: Tree, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every leaf.

    The proof is the digest of all siblings on the way up; the folded root is computed again from the claimed
    leaf and those siblings, for every row.
    """
    root, depth, block = tree.root, tree.levels, FAN ** tree.levels
    names = [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]

    def run(above: pa.Table, table: pa.Table) -> pa.Table:
        rest = [(s["place"], s["run"]) for s in above.column("path")[0].as_py()]
        tail = b"".join(r[:p] + r[p + HEX:] for p, r in rest)
        subroot = above.column("subroot")[0].as_py().hex()
        levels = _levels(_slots(table, block, "leaf"), table.column("total")[0].as_py(), depth)
        out = []
        for doc, leaf, own, at in zip(*(table.column(c).to_pylist() for c in ("id", "leaf", "claimed", "at"))):
            proof, own = hashlib.sha256(), own.hex().encode()
            for place, run in _steps(levels, at % block):
                before, after = run[:place], run[place + HEX:]
                proof.update(before + after)
                own = hashlib.sha256(before + own + after).hexdigest().encode()
            proof.update(tail)
            for place, run in rest:
                own = hashlib.sha256(run[:place] + own + run[place + HEX:]).hexdigest().encode()
            own = own.decode()
            out.append((doc, leaf.hex(), subroot, root, proof.hexdigest(), own, own == root))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    keyed = tree.leaves.withColumn("block", _block_of("at", depth))
    pairs = tree.paths.groupBy("g", "block").cogroup(keyed.groupBy("g", "block"))
    return pairs.applyInArrow(run, f"`{id_col}` long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), claimed: Column | None = None,
    group: str = "lang", id_col: str = "doc_id",
) -> DataFrame:
    """The rows of :func:`proofs` for documents whose leaves are digests of the ``fields`` as they are.

    ``claimed`` is the leaf to check instead of a row's own. Nulls in any column, empty and very long texts
    are values like others; repeated rows are leaves of their own. An empty table gives no rows; further columns are ignored.
    """
    return proofs(grown(docs, leaf_of(*(F.col(f) for f in fields)), claimed, group, id_col), id_col)
