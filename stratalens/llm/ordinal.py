"""Quality grades by ordinal regression on hashed text.

One weight per hashed feature gives a score; ordered thresholds cut it into grades:
``P(grade <= k) = sigmoid(threshold_k - score)`` (McCullagh's cumulative link). Features are
prefixes of the words, whether a text has them, and how large a share of it certain runs of
letters, marks and repeated words take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import texts_of

BITS = 18
PREFIXES = (3, 4, 5, 6, 8)
#: Shares of a text from which on a run counts; the same for words that repeat the one before.
SHARES = (0.002, 0.01, 0.03, 0.1, 0.3)
#: Documents of each grade that the fit may use, at most.
SAMPLE = 3000
#: Tail probability from which on a document is selected.
LEAST = 0.4


def _classes() -> tuple[np.ndarray, np.ndarray]:
    letter = np.zeros(256, bool)
    letter[0x80:] = True
    kind = np.full(256, ord("a"), np.uint64)
    for b in range(128):
        c = chr(b)
        letter[b] = c.isalnum()
        kind[b] = ord("A") if c.isupper() else ord("a") if c.islower() else ord("0") if c.isdigit() else b if b > 32 else 32
    return letter, kind


_LETTER, _KIND = _classes()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * _MIX
    x ^= x >> np.uint64(29)
    return ((x * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and feature numbers, each pair once, ordered."""
    pad = b" " * 10
    raw = [t.encode("utf-8", "replace") for t in texts]
    low = [t.lower().encode("utf-8", "replace") for t in texts]
    pairs = []

    a = np.frombuffer(pad + b"".join(x + pad for x in low), np.uint8)
    owner = np.repeat(np.arange(len(low)), [len(x) + 10 for x in low])
    word = _LETTER[a]
    start = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    if start.size:
        doc = owner[start - 10]
        gone = np.zeros(start.size, bool)
        value = np.zeros(start.size, np.uint64)
        for k in range(max(PREFIXES)):
            gone |= ~word[start + k]
            value = value * np.uint64(257) + np.where(gone, 1, a[start + k].astype(np.uint64) + np.uint64(2))
            if k + 1 in PREFIXES:
                pairs.append(doc << BITS | _bucket(value, k))
        same = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])
        words = np.bincount(doc, minlength=len(low))
        share = np.bincount(doc[1:][same], minlength=len(low)) / np.maximum(words, 1)
        for k, least in enumerate(SHARES):
            d = np.flatnonzero(share >= least)
            pairs.append(d << BITS | _bucket(np.full(d.size, k, np.uint64), 101))

    b = _KIND[np.frombuffer(pad + b"".join(x + pad for x in raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw)), [len(x) + 10 for x in raw])
    run = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
    told = np.flatnonzero((run != 0x616161) & (run != 0x202020))
    # A run belongs to the text it touches: those of a text begin up to two bytes before it.
    told = told[(told >= 8) & (told < 8 + owner.size)]
    if told.size:
        key, count = np.unique(owner[told - 8] << 24 | run[told].astype(np.int64), return_counts=True)
        doc = key >> 24
        share = count / np.array([max(len(x), 1) for x in raw])[doc]
        shape = (key & 0xFFFFFF).astype(np.uint64)
        for k, least in enumerate(SHARES):
            more = share >= least
            pairs.append(doc[more] << BITS | _bucket(shape[more], 201 + k))
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    lists: list[np.ndarray], grade: np.ndarray, grades: int, epochs: int = 15, rate: float = 0.08, batch: int = 64,
    sparse: float = 0.003,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adagrad on the likelihood, grades weighted alike.

    ``sparse`` draws weights to zero, so that long texts do not add up the noise of common features.
    """
    w, cut = np.zeros(1 << BITS, np.float32), np.linspace(-1, 1, grades - 1)
    seen_w, seen_cut = np.full(1 << BITS, 1e-2, np.float32), np.full(grades - 1, 1e-2)
    weight = 1 / np.maximum(np.bincount(grade, minlength=grades), 1)[grade]
    weight *= len(grade) / weight.sum()
    dice = np.random.default_rng(7)
    for _ in range(epochs):
        order = dice.permutation(len(lists))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            size = [lists[i].size for i in some]
            ids, row = np.concatenate([lists[i] for i in some]), np.repeat(np.arange(len(some)), size)
            score = np.bincount(row, w[ids], minlength=len(some))
            edge = np.concatenate([[-np.inf], cut, [np.inf]])
            up, down = _sigmoid(edge[grade[some] + 1] - score), _sigmoid(edge[grade[some]] - score)
            p = np.maximum(up - down, 1e-9)
            d_up, d_down = up * (1 - up) / p * weight[some], down * (1 - down) / p * weight[some]
            slope = np.zeros(grades + 1)
            np.add.at(slope, grade[some] + 1, -d_up)
            np.add.at(slope, grade[some], d_down)
            g = np.bincount(ids, (d_up - d_down)[row] / len(some), minlength=1 << BITS).astype(np.float32)
            touched = np.flatnonzero(g)
            seen_w[touched] += g[touched] ** 2
            pace = rate / np.sqrt(seen_w[touched])
            moved = w[touched] - pace * g[touched]
            w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - pace * sparse, 0)
            slope = slope[1:-1] / len(some)
            seen_cut += slope ** 2
            cut = np.sort(cut - rate * slope / np.sqrt(seen_cut))
    return w, cut


def train(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and thresholds from at most ``sample`` rated documents of each grade.

    ``ratings`` has ``doc_id, grade`` (0 worst); rows with a null or a grade outside the range
    are no ratings. The sample is the same in every run: lowest hashes of the id. The fit is one task over this bounded
    sample. None without any rated document.
    """
    rated = ratings.select(F.col("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null")
    chosen = [
        rated.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for g in range(grades)
    ]
    some = chosen[0]
    for more in chosen[1:]:
        some = some.union(more)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 300):
                part = batch.slice(start, 300)
                row, ids = features(texts_of(part))
                lists = np.split(ids.astype(np.int32), np.searchsorted(row, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array([x.tobytes() for x in lists])], ["grade", "ids"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, grade = [], []
        for batch in batches:
            lists += [np.frombuffer(x, np.int32) for x in batch.column("ids").to_pylist()]
            grade += batch.column("grade").to_pylist()
        if lists:
            w, cut = fit_ordinal(lists, np.array(grade), grades)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([cut.tobytes()])], ["w", "cut"])

    # At most grades * sample ids: a bounded side for the broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("grade", "text")
    rows = texts.mapInArrow(known, "grade int, ids binary").repartition(1).mapInArrow(fitted, "w binary, cut binary").collect()
    return (np.frombuffer(rows[0].w, np.float32), np.frombuffer(rows[0].cut)) if rows else None


def _above(model: tuple[np.ndarray, np.ndarray], texts: list[str]) -> np.ndarray:
    """Probability of a grade above each threshold: texts x thresholds."""
    w, cut = model
    row, ids = features(texts)
    score = np.bincount(row, w[ids].astype(float), minlength=len(texts))
    return 1 - _sigmoid(cut[None, :] - score[:, None])


def grade_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, least_grade: int) -> DataFrame:
    """``(doc_id, expected_grade, tail_probability)`` of every row; the tail begins at ``least_grade``.

    The whole text counts, whatever its length. A null or empty text has no features and the
    score zero. Equal rows get equal results. Without a model both figures are null. Further columns are ignored.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 300):
                part = batch.slice(start, 300)
                if told.value is None:
                    none = pa.nulls(part.num_rows, pa.float64())
                    out = [none, none]
                else:
                    above = _above(told.value, texts_of(part))
                    out = [pa.array(above.sum(1)), pa.array(above[:, least_grade - 1])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *out], ["doc_id", "expected_grade", "tail_probability"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double")


def select_documents(
    docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, least_grade: int, least: float = LEAST
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose tail probability reaches ``least``.

    Rows pass through as they are, without a shuffle; without a model all stay.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 300):
                part = batch.slice(start, 300)
                if told.value is not None:
                    part = part.filter(pa.array(_above(told.value, texts_of(part))[:, least_grade - 1] >= least))
                yield part

    return docs.mapInArrow(run, docs.schema)


def graded(labels: DataFrame) -> DataFrame:
    """Grade 2 for good and clean text, 1 for good but toxic text, 0 for poor text."""
    return labels.select(
        "doc_id",
        F.when(F.col("quality") == 1, F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).otherwise(2))
        .when(F.col("quality") == 0, 0).alias("grade"),
    )


def selected(least: float = LEAST) -> Column:
    """A document stays if its tail probability reaches ``least``; unscored ones stay too."""
    return F.coalesce(F.col("tail_probability") >= least, F.lit(True))
