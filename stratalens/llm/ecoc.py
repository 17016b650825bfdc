"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit one binary classifier on hashed byte n-grams tells
the languages with a one from those with a zero. A text gets the language whose codeword
loses least against the bits' margins, each bit weighted by its accuracy in training; a small
lead over the second language marks it as ambiguous.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import texts_of

BITS = 16
UNKNOWN = "und"
#: Most languages that a model may tell apart; their counts are gathered by the driver.
MOST_LANGUAGES = 200
_OTHER = re.compile(r"[\W\d_]+")
_PAD = b"  "


def codewords(languages: int, columns: int | None = None, seed: int = 11) -> np.ndarray:
    """A code matrix of -1 and 1: all splits up to five languages, above the best of random codes."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5 and columns is None:
        splits = [(1, *bits) for bits in itertools.product((1, -1), repeat=languages - 1)]
        return np.array([s for s in splits if -1 in s], float).T
    columns = columns or int(np.ceil(15 * np.log2(languages)))
    dice, best, best_far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = dice.choice((-1.0, 1.0), (languages, columns))
        if (np.abs(code.sum(0)) == languages).any():
            continue
        apart = (columns - code @ code.T) / 2 + np.eye(languages) * columns
        if apart.min() > best_far:
            best, best_far = code, apart.min()
    return best


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """Where each text's n-grams begin, the hashed n-grams, and whether the text has a letter.

    Lower-cased letters count, everything else is one blank; each text is padded alone, so a
    result depends on the text only.
    """
    clean = [_OTHER.sub(" ", t.lower()) for t in texts]
    letters = [any(map(str.isalpha, set(c))) for c in clean]
    raw = [_PAD + c.encode("utf-8", "replace") for c in clean]
    start = np.cumsum([0] + [len(r) for r in raw])[:-1]
    a = np.frombuffer(b"".join(raw) + _PAD, np.uint8).astype(np.uint32)
    three = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return start, ((three * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64), letters


@dataclass
class Code:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # n-gram x bit, log odds
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def margins(model: Code, texts: list[str]) -> tuple[np.ndarray, list[bool]]:
    """Mean log odds of the bits for each text."""
    start, ids, letters = grams(texts)
    total = np.add.reduceat(model.weights[ids], start, axis=0)
    length = np.diff(np.append(start, len(ids)))[:, None]
    return total / length - model.bias, letters


def decode(model: Code, margin: np.ndarray, sharpness: float = 8.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score and lead by loss-weighted decoding (logistic loss)."""
    loss = np.logaddexp(0, -sharpness * margin[:, None, :] * model.code[None]) @ model.trust
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    ranked = np.sort(p, 1)
    lead = ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)
    return p.argmax(1), ranked[:, -1], lead


def train(docs: DataFrame, parts: int = 64) -> Code | None:
    """A model from all rows with text and language.

    Tasks add up n-gram counts for each language; sums of the tasks' tables meet by language and stretch
    of n-grams, so what reaches the driver is a table of fixed size for each language. Bits
    are trusted by how well they tell the training rows. None if there is nothing to learn from.
    """
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    step = (1 << BITS) // parts

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                langs = np.array(part.column("lang").to_pylist(), object)
                start, ids, _ = grams(texts_of(part))
                owner = np.repeat(np.arange(len(langs)), np.diff(np.append(start, len(ids))))
                for lang in set(langs):
                    have = np.bincount(ids[(langs == lang)[owner]], minlength=1 << BITS)
                    sums[lang] = sums.get(lang, 0) + have
        out = [(lang, k, have[k * step:(k + 1) * step].astype(np.int64).tolist()) for lang, have in sums.items() for k in range(parts)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["lang", "stretch", "counts"])

    tables = rows.mapInArrow(counted, "lang string, stretch long, counts array<bigint>")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for lang, stretch, counts in zip(*(c.to_pylist() for c in batch.columns)):
                key = (lang, stretch)
                sums[key] = sums.get(key, 0) + np.array(counts)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int64()), pa.array([v.tolist() for v in sums.values()])],
                ["lang", "stretch", "counts"],
            )

    summed = tables.repartition("lang", "stretch").mapInArrow(added, "lang string, stretch long, counts array<bigint>").collect()
    languages = sorted({r.lang for r in summed})
    if not languages:
        return None
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MOST_LANGUAGES} are supported")
    counts = np.zeros((len(languages), 1 << BITS))
    for r in summed:
        counts[languages.index(r.lang), r.stretch * step:(r.stretch + 1) * step] = r.counts
    # Languages weigh alike inside a bit, however many rows they have.
    share = (counts + 0.01) / (counts + 0.01).sum(1, keepdims=True)
    code = codewords(len(languages))
    weights, bias = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    trust = np.ones(code.shape[1])
    if len(languages) > 1:
        for k in range(code.shape[1]):
            weights[:, k] = np.log(share[code[:, k] > 0].mean(0) / share[code[:, k] < 0].mean(0))
            centre = share @ weights[:, k]
            high, low = centre[code[:, k] > 0].min(), centre[code[:, k] < 0].max()
            bias[k] = (high + low) / 2
            trust[k] = max(high - low, 0.01)  # how far apart the nearest languages of both sides are
        trust /= trust.mean()
    return Code(languages, code, weights, bias, trust)


def _told(model: Code | None, texts: list[str], least_lead: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    lang, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    if model is not None and texts:
        margin, letters = margins(model, texts)
        best, p, lead = decode(model, margin)
        some = np.array(letters)
        lang = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        score[some] = np.clip(p, 0, 1)[some]
        unsure[some] = lead[some] < least_lead
    return lang, score, unsure


def select_documents(docs: DataFrame, model: Code | None, least_lead: float = 0.2) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is told clearly.

    Texts without a letter and ambiguous ones go; without a model all rows with a letter stay. Nothing is shuffled.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part = batch.slice(at, 300)
                if told.value is None:
                    keep = [any(map(str.isalpha, set(t))) for t in texts_of(part)]
                else:
                    keep = ~_told(told.value, texts_of(part), least_lead)[2]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model: Code | None, least_lead: float = 0.2) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` of every row, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0 and ambiguous, so is every
    text without a model. Of equal losses the language first in the alphabet wins. Repeated rows
    get equal results; other columns are never read.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)  # n-grams x bits, of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part = batch.slice(at, 300)
                lang, score, unsure = _told(told.value, texts_of(part), least_lead)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lang), pa.array(score), pa.array(unsure)],
                    ["doc_id", "lang_pred", "score", "ambiguous"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
