"""Nearest neighbours by a hierarchical navigable small-world graph in each shard.

Rows are dealt to shards of bounded size. A shard's graph is flat arrays of neighbour numbers,
one for each layer, stored as a table; queries stream through every shard in blocks and the
shards' results are merged. Points are inserted in growing batches, so that building and
searching are array operations over many points at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.common import stored
from stratalens.llm.lattice import usable, vectors

#: Distinct vectors that a shard holds on average, and links of a point (twice as many in the lowest layer).
SHARD = 8192
LINKS = 16
BUILD_WIDTH, SEARCH_WIDTH = 64, 96
#: Points or queries in a row of a stored block.
ROW = 256


@dataclass
class Graph:
    """``layers[l]`` holds for every point its neighbours in layer ``l``, -1 where there are fewer."""

    x: np.ndarray
    level: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    entry: int = 0


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to its own list of rows ``y``."""
    gap = y - x[:, None, :]
    return np.einsum("qnd,qnd->qn", gap, gap)


def descend(graph: Graph, layer: int, queries: np.ndarray, start: np.ndarray, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest points found in a layer for each query, and their squared distances.

    ``start`` lists entry points, -1 for none. All queries move together: each step expands every
    query's nearest points that are not yet expanded.
    """
    links, x, n = graph.layers[layer], graph.x, len(queries)
    seen = np.zeros((n, len(x) + 1), bool)  # the last column takes the -1
    rows = np.arange(n)[:, None]
    near = np.full((n, width), -1)
    far = np.full((n, width), np.inf, np.float32)
    done = np.ones((n, width), bool)

    def add(who: np.ndarray, points: np.ndarray) -> None:
        points = np.where(seen[who[:, None], points], -1, points)
        ordered = np.sort(points, 1)  # a point named twice counts once
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        seen[who[:, None], ordered] = True
        seen[who, -1] = False
        gaps = np.where(ordered >= 0, _apart(queries[who], x[ordered]), np.inf).astype(np.float32)
        all_far = np.concatenate([far[who], gaps], 1)
        best = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        pick = np.arange(len(who))[:, None]
        near[who] = np.concatenate([near[who], ordered], 1)[pick, best]
        done[who] = np.concatenate([done[who], ordered < 0], 1)[pick, best]
        far[who] = all_far[pick, best]

    add(np.arange(n), start)
    while True:
        open_far = np.where(done, np.inf, far)
        who = np.flatnonzero(np.isfinite(open_far.min(1)))
        if not who.size:
            break
        next_ = np.argpartition(open_far[who], min(at_once, width - 1), axis=1)[:, :at_once]
        live = np.isfinite(open_far[who[:, None], next_])
        points = np.where(live, near[who[:, None], next_], -1)
        done[who[:, None], next_] = True
        add(who, np.where(points[:, :, None] >= 0, links[points], -1).reshape(len(who), -1))
    order = np.argsort(far, axis=1, kind="stable")
    return near[rows, order], far[rows, order]


def varied(x: np.ndarray, base: np.ndarray, points: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's points (nearest first, -1 for none): first those that are
    nearer to the row's vector than to any chosen before, then the nearest of the rest."""
    n, c = points.shape
    have = x[points]
    far = np.where(points >= 0, _apart(base, have), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    pick = np.arange(n)[:, None]
    points, far, have = points[pick, order], far[pick, order], have[pick, order]
    square = np.einsum("ncd,ncd->nc", have, have)
    between = square[:, :, None] + square[:, None, :] - 2 * have @ have.transpose(0, 2, 1)
    nearest_chosen = np.full((n, c), np.inf)
    chosen = np.zeros((n, c), bool)
    for k in range(c):
        take = (far[:, k] < nearest_chosen[:, k]) & (chosen.sum(1) < most) & (points[:, k] >= 0)
        chosen[:, k] = take
        nearest_chosen[take] = np.minimum(nearest_chosen[take], between[take, k])
    rank = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
    out = points[pick, rank]
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((n, most - out.shape[1]), -1)], 1)
    return out


def build(x: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 3) -> Graph:
    """A graph of the rows of ``x``, which should be distinct."""
    n = len(x)
    x = x.astype(np.float32)
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
    graph = Graph(x, level)
    if not n:
        return graph
    most = [2 * links] + [links] * level.max()
    graph.layers = [np.full((n, m), -1, np.int32) for m in most]
    graph.entry, at = 0, 1
    while at < n:
        batch = np.arange(at, min(n, at + min(at, ROW)))
        near = np.full((len(batch), 1), graph.entry)
        found = {}
        for layer in range(level[graph.entry], -1, -1):
            inside = level[batch] >= layer
            near_here, _ = descend(graph, layer, x[batch], near, width if inside.any() else 4)
            found[layer] = near_here
            near = near_here[:, :width]
        for layer in range(level[batch].max() + 1):
            new = batch[level[batch] >= layer]
            before = found[layer][level[batch] >= layer] if layer in found else np.zeros((len(new), 0), int)
            # Points of the same batch do not find each other by search: the nearest are added.
            square = (x[new] ** 2).sum(1)
            mutual = square[:, None] + square[None] - 2 * x[new] @ x[new].T
            np.fill_diagonal(mutual, np.inf)
            few = min(links, len(new) - 1)
            mates = new[np.argpartition(mutual, few - 1, axis=1)[:, :few]] if few > 0 else np.zeros((len(new), 0), int)
            points = np.concatenate([before, mates], 1)
            if not points.shape[1]:
                continue
            chosen = varied(x, x[new], points, links)
            graph.layers[layer][new, :links] = chosen
            _link_back(graph, layer, np.repeat(new, links), chosen.reshape(-1), most[layer])
        if level[batch].max() > level[graph.entry]:
            graph.entry = int(batch[level[batch].argmax()])
        at = batch[-1] + 1
    return graph


def _link_back(graph: Graph, layer: int, source: np.ndarray, target: np.ndarray, most: int) -> None:
    """Adds ``source`` to the lists of ``target``; lists that overflow are chosen anew."""
    ok = target >= 0
    source, target = source[ok], target[ok]
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    names, first, count = np.unique(target, return_index=True, return_counts=True)
    table = graph.layers[layer]
    for at in range(0, len(names), ROW):
        some, n, f = names[at:at + ROW], count[at:at + ROW], first[at:at + ROW]
        extra = np.full((len(some), n.max()), -1)
        row = np.repeat(np.arange(len(some)), n)
        extra[row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = source[np.repeat(f, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        old = table[some]
        extra = np.where((extra[:, :, None] == old[:, None, :]).any(2), -1, extra)
        both = np.concatenate([old, extra], 1)
        used = (both >= 0).sum(1)
        roomy = used <= most
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        table[some[roomy]] = packed[roomy][:, :most]
        full = ~roomy
        if full.any():
            points, base = packed[full], graph.x[some[full]]
            if points.shape[1] > 3 * most:
                far = np.where(points >= 0, _apart(base, graph.x[points]), np.inf)
                points = np.take_along_axis(points, np.argsort(far, axis=1, kind="stable")[:, :3 * most], 1)
            table[some[full]] = varied(graph.x, base, points, most)


def search(graph: Graph, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
    """Numbers of the points found nearest to each query, -1 where there are fewer."""
    if not len(graph.x):
        return np.zeros((len(queries), 0), int)
    queries = queries.astype(np.float32)
    near = np.full((len(queries), 1), graph.entry)
    for layer in range(graph.level[graph.entry], 0, -1):
        near, _ = descend(graph, layer, queries, near, 8)
    return descend(graph, 0, queries, near, width)[0]


def build_index(table: DataFrame, keep: int, shard_rows: int = SHARD) -> DataFrame:
    """Graphs of all usable vectors of ``(vec_id, embedding)``, one per shard, in rows of points.

    Equal vectors are one point with its ``keep`` smallest ids, which is all that a search for that many
    neighbours can return of them. Each row: ``shard, chunk, n, ids, vectors, level, entry, links``.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    first = Window.partitionBy("vector").orderBy("vec_id")
    points = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= keep).groupBy("vector").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")
    )
    points = stored(points, "points")
    shards = max(1, -(-points.count() // shard_rows))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(max(shards, 1), "shard").sortWithinPartitions("shard", F.col("ids")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, parts = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(parts)
            order = np.random.default_rng(1).permutation(len(x))
            x, own = x[order], [ids[k] for k in order]
            graph = build(x)
            flat = np.concatenate(graph.layers, 1)
            for chunk, at in enumerate(range(0, len(x), ROW)):
                here = slice(at, at + ROW)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int32()), pa.array([chunk], pa.int64()), pa.array([len(x)], pa.int32()),
                        pa.array([own[here]], pa.list_(pa.list_(pa.int64()))), pa.array([x[here].tobytes()]),
                        pa.array([graph.level[here].astype(np.int32).tobytes()]), pa.array([graph.entry], pa.int32()),
                        pa.array([flat[here].tobytes()]),
                    ],
                    ["shard", "chunk", "n", "ids", "vectors", "level", "entry", "links"],
                )

        for batch in batches:
            number, x, own = np.asarray(batch.column("shard")), vectors(batch.column("vector")), batch.column("ids").to_pylist()
            for s in np.unique(number):  # rows are ordered by shard
                if shard is not None and s != shard:
                    yield from close()
                    ids, parts = [], []
                shard = int(s)
                parts.append(x[number == s])
                ids += [own[k] for k in np.flatnonzero(number == s)]
        if shard is not None:
            yield from close()

    return dealt.mapInArrow(
        run, "shard int, chunk long, n int, ids array<array<long>>, vectors binary, level binary, entry int, links binary"
    )


def _loaded(rows: list[dict]) -> tuple[Graph, list[list[int]], np.ndarray]:
    """A shard's graph, ids and exact vectors from its rows."""
    n = rows[0]["n"]
    x = np.concatenate([np.frombuffer(r["vectors"]) for r in rows]).reshape(n, -1)
    level = np.concatenate([np.frombuffer(r["level"], np.int32) for r in rows])
    flat = np.concatenate([np.frombuffer(r["links"], np.int32) for r in rows]).reshape(n, -1)
    cuts = [0, 2 * LINKS] + [2 * LINKS + LINKS * k for k in range(1, level.max() + 1)]
    layers = [flat[:, a:b] for a, b in zip(cuts, cuts[1:] + [None]) if b is None or b > a]
    return Graph(x.astype(np.float32), level, layers, rows[0]["entry"]), [i for r in rows for i in r["ids"]], x


def nearest_neighbours(
    table: DataFrame, query: Column, k: int = 10, shard_rows: int = SHARD, width: int = SEARCH_WIDTH
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``table`` that ``query`` selects its ``k`` nearest other rows found.

    The score is the Euclidean distance of the original vectors in double precision; ties go to
    the smaller ``vec_id``. Vectors that are null, zero or hold null or non-finite components, and
    rows without id, take no part. Fewer than ``k`` candidates give fewer rows; an empty table none. A
    repeated id is one candidate for each row. All vectors must have one length. The recall against
    brute force is measured in the tests.
    """
    index = stored(build_index(table, k + 1, shard_rows), "index")
    shards = [r.shard for r in index.select("shard").distinct().collect()]
    asked = table.where(query & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    ).where(usable(F.col("vector")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = np.asarray(batch.column("vec_id")), vectors(batch.column("vector"))
            for at in range(0, len(ids), ROW):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(ids[at])]), pa.array([ids[at:at + ROW].tobytes()]), pa.array([x[at:at + ROW].tobytes()])], ["chunk", "asked", "vectors"]
                )

    blocks = asked.mapInArrow(packed, "chunk long, asked binary, vectors binary")
    # The stated query set meets every shard: blocks of queries are sent to each.
    blocks = blocks.select(
        F.explode(F.array(*[F.lit(s) for s in shards]).cast("array<int>")).alias("shard"), F.lit(1).alias("kind"), "chunk", "asked", "vectors",
    )
    both = index.withColumn("kind", F.lit(0)).unionByName(blocks, allowMissingColumns=True)
    dealt = both.repartition(max(len(shards), 1), "shard").sortWithinPartitions("shard", "kind", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, loaded = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, rows, loaded = r["shard"], [], None
                if r["kind"] == 0:
                    rows.append(r)
                    continue
                if loaded is None:
                    loaded, rows = _loaded(rows), []
                graph, ids, x = loaded
                names = np.frombuffer(r["asked"], np.int64)
                queries = np.frombuffer(r["vectors"]).reshape(len(names), -1)
                out = []
                for q, v, near in zip(names.tolist(), queries, search(graph, queries, width)):
                    near = near[near >= 0]
                    gap = x[near] - v
                    score = np.sqrt((gap * gap).sum(1))
                    some = [(s, i) for s, p in zip(score.tolist(), near.tolist()) for i in ids[p] if i != q]
                    out += [(q, i, s) for s, i in sorted(some)[:k]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
