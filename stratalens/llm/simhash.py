"""Near-duplicate documents by SimHash and a generalised pigeonhole search.

Correlated bits are grouped into partitions; dynamic programming on estimated candidate counts
gives each partition its own threshold, such that two fingerprints within the distance
meet in at least one partition (Qin et al., 2018: thresholds sum to distance - partitions + 1,
-1 leaves a partition out). What meets is compared bit by bit. Texts that share most of their shingles but differ in
more bits are found by minima of the shingle hashes and an exact comparison.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import components, stored, texts_of

SEED = 42
#: Fingerprints in a bucket that are compared all with all; larger buckets are divided first.
BLOCK = 4096
#: Fingerprints from which correlations and candidate counts are estimated.
SAMPLE = 2000
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of every run of ``words`` words; of all words where there are fewer."""
    parts = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return []
    whole, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(whole, SEED)]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    end = (start + size)[words - 1:]
    return [digest(whole[s:e], SEED) for s, e in zip(start.tolist(), end.tolist())]


def majority(lists: list[list[int]]) -> np.ndarray:
    """For each list the bits that are set in over half of its hashes; zero for an empty list."""
    n = np.array([len(x) for x in lists], np.int64)
    return _majority(np.fromiter(itertools.chain.from_iterable(lists), np.uint64, int(n.sum())), n)


def _majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The same for lists of ``n`` hashes that stand one behind the other."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not some.size:
        return out
    # Byte lanes hold counts up to 255, so each list is added up in blocks of that length.
    blocks = (n[some] + 254) // 255
    first_block = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    first = np.concatenate([[0], np.cumsum(n[some])[:-1]])
    inside = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
    cuts = np.repeat(first, blocks) + inside * 255
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, cuts)
        count = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_block, axis=0)
        over = count * 2 > n[some][:, None]
        for byte in range(8):
            out[some] |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` of every row, whole texts; null and blank texts have fingerprint zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = majority([shingle_hashes(t, words) for t in texts_of(part)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int


def _mask(bits: tuple[int, ...]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def grouped_bits(x: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Columns of a table of bits dealt to partitions of about equal size, the most correlated ones together."""
    bits = x.shape[1]
    x = x - x.mean(0)
    spread = np.sqrt((x ** 2).sum(0)) + 1e-9
    like = np.abs(x.T @ x) / spread[:, None] / spread[None]
    np.fill_diagonal(like, 0)
    free, out = np.ones(bits, bool), []
    for k in range(parts):
        total, group = like @ free, []
        for _ in range(bits // parts + (k < bits % parts)):
            best = int(np.where(free, total, -1).argmax())
            total = like[best] if not group else total + like[best]
            group.append(best)
            free[best] = False
        out.append(tuple(sorted(group)))
    return out


def _bits(fp: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words as rows of bits, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(fp, "<u8").view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one for each partition, of the given sum and the lowest cost.

    ``costs[i][t + 1]`` is the cost of threshold ``t`` in partition ``i``.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for so_far, (cost, chosen) in best.items():
            for t, more in enumerate(row, -1):
                here = (cost + more, [*chosen, t])
                if so_far + t not in after or here < after[so_far + t]:
                    after[so_far + t] = here
        best = after
    return best[total]


def plan(sample: np.ndarray, rows: int, distance: int) -> list[Part]:
    """Partitions and thresholds of the lowest estimated number of probes and comparisons."""
    if not len(sample):
        return [Part(tuple(range(64)), distance)]
    x = _bits(sample).astype(float)
    best, chosen = float("inf"), []
    for parts in range(1, distance + 4):
        bits = grouped_bits(x, parts)
        costs = []
        for group in bits:
            some = x[:, group]
            apart = some @ (1 - some).T
            apart = apart + apart.T
            off = ~np.eye(len(some), dtype=bool)
            row = [0.0]
            for t in range(min(distance, 2) + 1 if parts > 1 else distance + 1):
                probes = sum(math.comb(len(group), k) for k in range(t + 1))
                close = ((apart <= t + 0.5) & off).sum() / max(1, off.sum())
                # Below what the sample can see, bits are taken as independent.
                close = max(close, probes * 2.0 ** -len(group))
                row.append(20.0 * rows * probes + rows * rows * close)
            costs.append(row)
        if not -parts <= distance - parts + 1 <= sum(len(r) - 2 for r in costs):
            continue
        cost, thresholds = allocate(costs, distance - parts + 1)
        if cost < best:
            best, chosen = cost, [Part(b, t) for b, t in zip(bits, thresholds) if t >= 0]
    return chosen


def _masked(fp: Column, mask: np.uint64) -> Column:
    return fp.bitwiseAND(F.lit(int(mask.astype(np.int64))))


def _keys(parts: list[Part], used: list[int] | None = None) -> Column:
    """All ``(part, value)`` of the fingerprint in column ``fp``: its own and those within the thresholds."""
    out = []
    for number, part in enumerate(parts):
        own = _masked(F.col("fp"), _mask(part.bits))
        for k in range(part.threshold + 1):
            for flips in itertools.combinations(part.bits, k):
                flipped = own.bitwiseXOR(F.lit(int(_mask(flips).astype(np.int64))))
                out.append(F.struct(F.lit(number).alias("part"), flipped.alias("value")))
    return F.array(*out)


def _links(distance: int):
    """Rows ordered by bucket to spanning links of the fingerprints in each bucket."""
    def spanned(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp, at = np.unique(fp, return_index=True)
        node = node[at]
        label = np.arange(len(fp))
        near_of = [np.flatnonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= distance) + i + 1 for i in range(len(fp))]
        a, b = [], []

        def root(i: int) -> int:
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        for i, near in enumerate(near_of):
            for j in near.tolist():
                x, y = root(i), root(j)
                if x != y:
                    label[max(x, y)] = min(x, y)
                    a.append(node[i])
                    b.append(node[j])
        return np.array(a, np.int64), np.array(b, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if rest is None:
                    return
                columns, last = rest, True
            else:
                columns = [np.asarray(batch.column(c)) for c in ("bucket", "fp", "node")]
                if rest is not None:
                    columns = [np.concatenate(x) for x in zip(rest, columns)]
                last = False
            bucket, fp, node = columns
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            edge = np.append(edge, len(bucket)) if last else edge
            rest = [x[edge[-1]:] for x in columns] if not last else None
            size = np.diff(edge)
            found = [spanned(fp[s:s + n].view(np.uint64), node[s:s + n]) for s, n in zip(edge, size) if n > 1]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def near_links(classes: DataFrame, distance: int = 2, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within ``distance`` bits.

    ``classes`` holds distinct fingerprints: ``(fp long, node long)``. A bucket yields a
    spanning forest of its pairs, at most one link for each member, never all pairs. Buckets over
    ``block`` members are divided by the same argument on the bits they do not share: of any
    ``distance + 1`` groups of these, a pair within the distance agrees on one. Nothing is left out.
    """
    classes = stored(classes, "fingerprints")
    rows = classes.count()
    sample = np.array([r.fp for r in classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    parts = plan(sample, rows, distance)
    keyed = classes.select("fp", "node", F.explode(_keys(parts)).alias("k"))
    level = keyed.select(F.xxhash64("k.part", "k.value").alias("bucket"), "fp", "node", F.col("k.part").alias("part"))
    level = stored(level, "buckets")
    left = [{k: [b for b in range(64) if b not in p.bits] for k, p in enumerate(parts)}]
    out = None
    for _ in range(4):
        sizes = level.groupBy("bucket").count().where(F.col("count") > block)
        small = level.join(sizes, "bucket", "left_anti")
        some = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links(distance), "a long, b long")
        out = some if out is None else out.union(some)
        large = stored(level.join(sizes, "bucket", "left_semi"), "large-buckets")
        if large.isEmpty():
            return out
        # The bits left over are told apart by the part, from the second level on by part and group.
        options, following, number = [], {}, 0
        for part, bits in left[-1].items():
            groups = [tuple(bits[g::distance + 1]) for g in range(distance + 1)]
            keys = []
            for g in groups:
                keys.append(F.struct(F.lit(number).alias("part"), _masked(F.col("fp"), _mask(g)).alias("value")))
                following[number] = [b for b in bits if b not in g]
                number += 1
            options.append((part, F.array(*keys)))
        choice = F.lit(None)
        for part, keys in options:
            choice = F.when(F.col("part") == part, keys).otherwise(choice)
        left.append(following)
        level = stored(large.select("bucket", "fp", "node", F.explode(choice).alias("k")).select(
            F.xxhash64("bucket", "k.part", "k.value").alias("bucket"), "fp", "node", F.col("k.part").alias("part")
        ), "buckets")
    return out.union(level.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links(distance), "a long, b long"))


def near_duplicates(docs: DataFrame, distance: int = 2, words: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row.

    Fingerprints link at ``distance`` or fewer differing bits; a component's id is its smallest
    ``doc_id``. Null and blank texts share fingerprint zero and link like any other. Equal
    fingerprints are one class, so copies cost one row each. Rows with a null ``doc_id`` get
    the component of their class; a class of such rows alone has a null one. Repeated rows stay. An empty table gives no rows.
    """
    marked = stored(fingerprints(docs, words), "marked")
    return _grouped(marked, distance).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(marked: DataFrame, distance: int) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``(doc_id, fp)``."""
    classes = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = components(near_links(classes, distance))
    classes = classes.join(found, "node", "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("component", "node").alias("component_id")
    )
    return marked.join(classes, F.col("fp") == F.col("class_fp"), "left").select("doc_id", "fp", "component_id")


# Near copies by the share of common shingles: met by minima of the shingle hashes, confirmed on the whole shingle sets.

#: Bands and minima in a band. A pair that shares a part J of its shingles has a band in common but for a chance of
#: (1 - J ** DEEP) ** BANDS: 2e-10 at 0.8, wherever the texts differ. At 0.1 it meets with a chance of 6e-4.
BANDS, DEEP = 56, 5
#: Texts of a block; a bucket of more is divided into pairs of blocks.
PAIRED = 1000
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (BANDS, DEEP), np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def band_keys(lists: list[list[int]]) -> np.ndarray:
    """Lists x ``BANDS``: each key stands for ``DEEP`` minima of a list's hashes, each minimum under its own order. No list may be empty."""
    n = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint64, int(n.sum()))
    start = np.cumsum(n) - n
    out = np.empty((len(lists), BANDS), np.uint64)
    for band, factors in enumerate(_FACTORS):
        key = np.full(len(lists), band, np.uint64)
        for factor in factors:
            key = _mixed(key ^ np.minimum.reduceat(flat * factor, start))
        out[:, band] = key
    return out


def _words_digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8", "replace").lower().split()))


def _sharing(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose shingle sets share ``least`` of all shingles in either."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y") - common).alias("either"))
    return both.where(F.col("common") >= F.lit(least) * F.col("either")).select("a", "b")


def _confirmed(least: float):
    """Rows ordered by ``work`` to spanning links of the texts of each work that share ``least`` of their shingles, across components."""
    def spanned(node: list[int], c: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        label = np.unique(np.array(c), return_inverse=True)[1]
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        code = np.unique(np.concatenate(sets), return_inverse=True)[1]
        holders = owner[np.argsort(code, kind="stable")]  # of each shingle, one shingle behind the other
        ends = np.cumsum(np.bincount(code))
        starts, code = ends - np.bincount(code), np.split(code, np.cumsum(size)[:-1])
        out = []
        # Pairs inside the largest component need no comparison.
        for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
            met = np.concatenate([holders[x:y] for x, y in zip(starts[code[i]].tolist(), ends[code[i]].tolist())])
            common = np.bincount(met, minlength=len(sets))
            near = (common >= least * (size + size[i] - common)) & (label != label[i])
            for j in np.flatnonzero(near).tolist():
                if label[j] != label[i]:
                    out.append((node[i], node[j]))
                    label[label == label[j]] = label[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in itertools.chain(batches, [None]):
            some = zip(*(batch.column(x).to_pylist() for x in ("work", "node", "c")), _lists(batch.column("shingles"))) if batch is not None else [(None,)]
            out = []
            for row in some:
                if held and held[0][0] != row[0]:
                    out += spanned(*map(list, list(zip(*held))[1:]))
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return run


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Copies, as a batch's memory is used again."""
    ends, values = np.asarray(column.offsets), np.asarray(column.values)
    return [values[x:y].copy() for x, y in zip(ends[:-1], ends[1:])]


def _sharing_links(sets: DataFrame, shared: DataFrame, least: float, paired: int) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs in a common bucket that share ``least`` of their shingles.

    Every bucket first compares the one of its texts that has most bucket mates, as an original has, with all others: work linear in the
    members. Buckets that still hold several components then compare across these, large ones divided into pairs of blocks.
    """
    mates = shared.groupBy("node").agg(F.sum("n").alias("mates"))
    rows = shared.join(mates, "node")
    hubs = rows.groupBy("bucket").agg(F.max(F.struct("mates", "node"))["node"].alias("hub"))
    rows = shared.join(hubs, "bucket")
    pairs = stored(rows.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "met")
    links = stored(_sharing(pairs, sets, least), "sharing")

    rows = shared.where("n > 2").join(components(links), "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("c"))
    several = rows.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    parts = F.ceil(F.col("n") / paired).cast("int")
    rows = rows.join(several, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("work"), "node", "c"
    )
    works = rows.join(sets, "node").repartition("work").sortWithinPartitions("work")
    return links.union(works.select("work", "node", "c", "shingles").mapInArrow(_confirmed(least), "a long, b long"))


def near_copies(docs: DataFrame, distance: int = 2, words: int = 3, run_words: int = 5, least: float = 0.8, paired: int = PAIRED) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row, as :func:`near_duplicates`, where two more kinds of texts are linked.

    Linked are also texts that share ``least`` of all different runs of ``run_words`` words in either, wherever they differ; a text of fewer
    words is one run. Two bits miss most of these, above all where a passage was added or removed. Texts without words take no part in this.
    Candidates have a band of shingle minima in common, each link is confirmed on the whole sets of both texts.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = texts_of(part)
                fp = majority([shingle_hashes(t, words) for t in texts])
                lists = [shingle_hashes(t, run_words) for t in texts]
                keys = iter(band_keys(some)) if (some := [x for x in lists if x]) else None
                bands = pa.array([next(keys).tobytes() if x else None for x in lists], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(fp.view(np.int64)), pa.array([_words_digest(t) for t in texts]), bands], ["doc_id", "fp", "same", "bands"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = stored(docs.select("doc_id", "text").mapInArrow(mark, f"doc_id {kind}, fp long, same binary, bands binary"), "marked")
    found = stored(_grouped(marked.select("doc_id", "fp"), distance), "grouped")

    # Texts of equal words are one class.
    classes = marked.where("doc_id is not null and bands is not null").groupBy("same").agg(
        F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.min("bands").alias("bands")
    ).withColumn("node", F.monotonically_increasing_id())
    classes = stored(classes, "classes")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                node = np.repeat(np.asarray(part.column("node")), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(part.column("bands").to_pylist()), np.int64)), pa.array(node)], ["bucket", "node"])

    buckets = classes.select("node", "bands").mapInArrow(keyed, "bucket long, node long")
    shared = stored(buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"), "shared-buckets")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                # Of rows with one id only that of the class counts.
                own = [(k, t) for k, t, s in zip(part.column("node").to_pylist(), texts_of(part), part.column("same").to_pylist()) if _words_digest(t) == s]
                sets = [np.unique(np.array(shingle_hashes(t, run_words), np.uint64)).view(np.int64) for _, t in own]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    asked = classes.join(shared.select("node").distinct(), "node").select("node", "same", F.col("doc_id").alias("class_id"))
    texts = docs.select("doc_id", "text").join(asked, F.col("doc_id") == F.col("class_id")).select("node", "same", "text")
    sets = texts.mapInArrow(shingled, "node long, shingles array<long>")
    sets = stored(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")

    links = _sharing_links(sets, shared, least, paired)
    group = found.where("doc_id is not null").groupBy("fp").agg(F.min("component_id").cast("long").alias("group"))
    group = classes.select("node", "fp").join(group, "fp").select("node", "group")
    across = links.join(group.select(F.col("node").alias("a"), F.col("group").alias("x")), "a").join(group.select(F.col("node").alias("b"), F.col("group").alias("y")), "b")
    joined = components(across.select(F.col("x").alias("a"), F.col("y").alias("b")))
    rows = found.join(joined, found["component_id"] == joined["node"], "left")
    return rows.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component", "component_id").alias("component_id")
    )
