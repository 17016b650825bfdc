"""Documents packed into sequences of fixed length by linear grouping.

Only counts of lengths reach the driver, at most one for each length up to the capacity. Large
lengths are rounded up inside groups of equal cardinality; configurations of these few sizes are
chosen for the best fill; actual documents take their places; small documents go where they fit best. The plan is
a list of bin kinds with multiplicities, so its size does not follow the number of documents.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.common import rows_of, stored, texts_of

#: Chunks of text whose ids a worker keeps, in each of two generations.
KEPT = 250_000
_UNEVEN = re.compile(r"\s[ ]|[ ]\s|^[ ]|[ ]$")
#: Fixed value: how byte-level BPE of this kind divides a text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Kind = tuple[int, list[tuple[int, int]]]  # bins, and in each of them (length, how many)


def configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size fill one bin best, within what is left; larger sizes first among equals."""
    reach = np.zeros(capacity + 1, np.int64)  # the last size (from 1) used to reach a fill, 0 unreached
    reach[0] = -1
    used: list[np.ndarray] = []
    for k, size in enumerate(sizes):
        copies = np.full(capacity + 1, -1, np.int64)
        copies[reach != 0] = 0
        most = min(left[k], capacity // size)
        for _ in range(most):
            fill = np.flatnonzero((copies[:-size] >= 0) & (copies[:-size] < most))
            fill = fill[reach[fill + size] == 0]
            if not fill.size:
                break
            reach[fill + size] = k + 1
            copies[fill + size] = copies[fill] + 1
        used.append(copies)
    fill = int(np.flatnonzero(reach)[-1])
    out = [0] * len(sizes)
    while fill:
        k = int(reach[fill]) - 1
        n = int(used[k][fill])
        out[k] += n
        fill -= n * sizes[k]
    return out


def pack(counts: dict[int, int], capacity: int, small: int, groups: int = 200) -> list[Kind]:
    """Bin kinds for so many documents of each length.

    Lengths over ``small`` are grouped and configured, the others are put where they fit best.
    """
    out: list[Kind] = [(n, [(capacity, 1)]) for s, n in counts.items() if s == capacity and n]
    large = sorted(((s, n) for s, n in counts.items() if small < s < capacity and n), reverse=True)
    each = max(1, -(-sum(n for _, n in large) // groups))
    runs: list[list[list[int]]] = [[]]
    room = each
    for size, n in large:
        while n:
            take = min(n, room)
            runs[-1].append([size, take])
            n, room = n - take, room - take
            if not room:
                runs.append([])
                room = each
    runs = [r for r in runs if r]
    merged: list[list[list[int]]] = []
    for r in runs:  # groups that are rounded to the same length are one
        if merged and merged[-1][0][0] == r[0][0]:
            merged[-1] += r
        else:
            merged.append(r)
    sizes, left = [r[0][0] for r in merged], [sum(n for _, n in r) for r in merged]

    bins: list[Kind] = []
    while any(left):
        live = [k for k in range(len(sizes)) if left[k]]
        chosen = configuration([sizes[k] for k in live], [left[k] for k in live], capacity)
        slots = [(k, c) for k, c in zip(live, chosen) if c]
        times = min(left[k] // c for k, c in slots)
        for k, c in slots:
            left[k] -= c * times
        places = [k for k, c in slots for _ in range(c)]
        while times:  # as long as no place changes to another actual length
            width = times
            for k in set(places):
                width = min(width, max(1, merged[k][0][1] // places.count(k)))
            inside: dict[int, int] = {}
            for k in places:
                need = width
                if merged[k][0][1] < need:  # a bin on the border between two lengths
                    width = need = 1
                    break
            for k in places:
                size = merged[k][0][0]
                merged[k][0][1] -= width
                if not merged[k][0][1]:
                    merged[k].pop(0)
                inside[size] = inside.get(size, 0) + 1
            bins.append((width, sorted(inside.items(), reverse=True)))
            times -= width

    gaps: dict[int, list[Kind]] = {}
    for n, inside in bins:
        gaps.setdefault(capacity - sum(s * c for s, c in inside), []).append((n, inside))
    for size, n in sorted(((s, n) for s, n in counts.items() if s <= small and s < capacity), reverse=True):
        while n:
            gap = min((g for g in gaps if g >= size), default=None)
            if gap is None:
                fit = capacity // size
                if n >= fit:
                    gaps.setdefault(capacity - fit * size, []).append((n // fit, [(size, fit)]))
                if n % fit:
                    gaps.setdefault(capacity - n % fit * size, []).append((1, [(size, n % fit)]))
                break
            have, inside = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            fit = min(gap // size, n)
            take = min(have, n // fit)
            if take < have:
                gaps.setdefault(gap, []).append((have - take, inside))
            more = dict(inside)
            more[size] = more.get(size, 0) + fit
            gaps.setdefault(gap - fit * size, []).append((take, sorted(more.items(), reverse=True)))
            n -= take * fit
    return out + [kind for kinds in gaps.values() for kind in kinds]


class Places:
    """Where the r-th document of a length goes, from bin kinds."""

    def __init__(self, kinds: list[Kind]):
        rows, taken, sequence = [], {}, 0
        for n, inside in kinds:
            at = 0
            for length, copies in inside:
                first = taken.get(length, 0)
                rows.append((length << 40 | first, first, sequence, copies, at))
                taken[length] = first + n * copies
                at += length * copies
            sequence += n
        self.sequences, self.taken = sequence, taken
        self.table = np.array(sorted(rows), np.int64).reshape(-1, 5)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.table[np.searchsorted(self.table[:, 0], length << 40 | rank, "right") - 1]
        inside = rank - row[:, 1]
        return row[:, 2] + inside // row[:, 3], row[:, 4] + inside % row[:, 3] * length


class ChunkIds:
    """Ids of whole texts, as bytes, of a byte-level BPE in a file of the tokenizers library.

    A lone blank between two visible characters always begins a token here, so texts are encoded
    by the chunks between them, and those seen before are looked up. New chunks go through the
    same vocabulary in the tiktoken library, whose calls on short texts cost a tenth; texts with
    a string of a special token go through the tokenizers library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())
        split = model["pre_tokenizer"] or {}
        if model["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
            raise ValueError("a byte-level BPE without normaliser and prefix blank is needed")
        self.special = {x["content"] for x in model["added_tokens"]}
        byte = _bytes_of_letters()
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        ids = [model["model"]["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["model"]["merges"]]
        if ids != sorted(ids):
            raise ValueError("ids must rise with the order of merges")
        self.plain = tiktoken.Encoding("chunks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out, plain = [], self.plain
        for text in texts:
            if any(x in text for x in self.special):
                out.append(self.by_library(text))
                continue
            if "\0" in text or _UNEVEN.search(text):
                out.append(array("I", plain(text)).tobytes())
                continue
            known, older, parts = self.known, self.older, []
            for chunk in text.replace(" ", "\0 ").split("\0"):
                ids = known.get(chunk)
                if ids is None:
                    ids = older.get(chunk)
                    if ids is None:
                        ids = array("I", plain(chunk)).tobytes()
                    if len(chunk) <= 64:
                        if len(known) >= KEPT:
                            self.older, self.known = known, {}
                            known, older = self.known, self.older
                        known[chunk] = ids
                parts.append(ids)
            out.append(b"".join(parts))
        return out


def _bytes_of_letters() -> dict[str, int]:
    """The letters by which byte-level BPE files write bytes: printable Latin-1 as it is, the others from code point 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def _ids_of(path: str) -> ChunkIds:
    return ChunkIds(path)


_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()),
])


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of the documents' ids, each with its number among the task's pieces of its length.

    A document is its ids and ``end_id``; one that is longer than the capacity is cut so
    that only its first piece is shorter. A null text is empty: one piece of one id.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, encoder = TaskContext.get().partitionId(), {}, _ids_of(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part, rows = batch.slice(at, 400), []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts_of(part))):
                    ids += end
                    total, start, number = len(ids) // 4, 0, 0
                    while start < total:
                        length = (total - start) % capacity or capacity
                        crc = zlib.crc32(ids[4 * start:4 * (start + length)])
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        rows.append((doc, number, start, length, crc, task, nth))
                        start, number = start + length, number + 1
                yield from rows_of(_PIECES, list(zip(*rows)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    )


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, small: int | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Every row of ``docs`` is packed, repeated and null ids too. Pieces of equal length are
    told apart by their number within a task plus what earlier tasks have of that length, so
    no length is ranked in one task. An empty table gives no rows; further columns are ignored.
    """
    rows = stored(pieces(docs, tokenizer, capacity), "pieces")
    held = rows.groupBy("task", "length").agg(F.max("nth").alias("last"))
    # One row a task and length: tasks of one length are ordered, never its pieces.
    along = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum(F.col("last") + 1).over(along), F.lit(0)))
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(pack(counts, capacity, small or capacity * 5 // 16))
    told = docs.sparkSession.sparkContext.broadcast(places)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = told.value.find(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:5]), pa.array(sequence), pa.array(offset)], names)

    ranked = rows.join(held.drop("last"), ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.select(*names[:5], "rank").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
