"""Fill-in-the-middle: a text's middle is moved to its end, in the buffer that holds the text.

The cuts are found by one scan over the bytes that begin a character. Sentinels go into the buffer in
reading order; two neighbouring blocks then change places by three reversals. The way back is the
same rotation the other way round, after which the sentinels are taken out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many are left plain, and of 100 others so many begin with the suffix.
PLAIN, SUFFIX_FIRST = 10, 20


def checked(sentinels: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """The sentinels as bytes. None may begin inside itself or another, so none can arise where a text meets one."""
    heads = {s[:1] for s in sentinels}
    if len(set(sentinels)) < 3 or not all(sentinels) or any(c in heads for s in sentinels for c in s[1:]):
        raise ValueError("three sentinels are needed whose first character occurs nowhere else in them")
    if any(a != b and a.startswith(b) for a in sentinels for b in sentinels):
        raise ValueError("no sentinel may begin with another")
    return tuple(s.encode() for s in sentinels)


def exchange(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Let ``buffer[start:middle]`` and ``buffer[middle:end]`` change places by three reversals."""
    for a, b in ((start, middle), (middle, end), (start, end)):
        buffer[a:b] = buffer[a:b][::-1]


def offsets_of(text: bytes, places: list[int]) -> tuple[int, list[int]]:
    """Code points of a text in UTF-8, and the byte at which the given ones begin; the one after the last is the end."""
    if text.isascii():
        return len(text), places
    leads = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return len(leads), [int(leads[p]) if p < len(leads) else len(text) for p in places]


def length_of(text: bytes) -> int:
    """Code points of a text in UTF-8."""
    return len(text) if text.isascii() else int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def rearranged(text: bytes, first: int, second: int, form: str, sentinels: tuple[bytes, bytes, bytes]) -> bytes:
    """A text cut at two bytes, as ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle)."""
    p, s, m = sentinels
    buffer = bytearray(text)
    for at, sentinel in ((second, s), (first, m), (0, p)):
        buffer[at:at] = sentinel
    middle = len(p) + first
    suffix = middle + len(m) + second - first
    exchange(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return bytes(buffer)


def rebuilt(output: bytes, form: str, sentinels: tuple[bytes, bytes, bytes]) -> bytes:
    """The text of an output of :func:`rearranged`, or the output itself if it is plain."""
    if form == "plain":
        return output
    p, s, m = sentinels
    buffer = bytearray(output)
    start = buffer.index(s) if form == "psm" else 0
    border = buffer.index(m if form == "psm" else p)
    exchange(buffer, start, border, len(buffer))
    for sentinel, after in ((s, len(buffer) - (border - start)), (m, None), (p, 0)):
        at = buffer.index(sentinel) if after is None else after
        del buffer[at:at + len(sentinel)]
    return bytes(buffer)


def draws(key: str, seed: str) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 of a document: the same in every run and on every executor."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digits[k:k + 8], 16) for k in range(0, 32, 8))


def transform(
    docs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST,
    seed: str = "1", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(id_col, n, form, prefix_chars, middle_chars, output)`` of every row; ``output`` is what a model learns from.

    A null text counts as empty. Empty texts, texts that hold a sentinel and the ``plain`` share stay as they are: their form
    is ``plain`` and both lengths are null. Cuts are drawn from the id, so repeated rows have equal results; a null
    id counts as an empty word. Texts are cut between code points and handled whole whatever their length. Other columns are
    left out, so none can clash; an empty table gives an empty one.
    """
    strings = checked(sentinels)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, rows = batch.slice(at, 200), []
                for key, text in zip(part.column("_key").to_pylist(), part.column("_text").to_pylist()):
                    h1, h2, h3, h4 = draws(key or "", seed)
                    n = length_of(text)
                    if not n or h3 % 100 >= 100 - plain or any(s in text for s in strings):
                        rows.append((n, "plain", None, None, text))
                        continue
                    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
                    form = "spm" if h4 % 100 < suffix_first else "psm"
                    first, second = offsets_of(text, cuts)[1]
                    rows.append((n, form, cuts[0], cuts[1] - cuts[0], rearranged(text, first, second, form, strings)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns], [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
                )

    rows = docs.select(
        F.col(id_col), F.col(id_col).cast("string").alias("_key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text")
    )
    moved = rows.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return moved.withColumn("output", F.col("output").cast("string"))


def restore(moved: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, name: str = "restored") -> DataFrame:
    """The rows with the text that :func:`transform` was given in one more column, from ``output`` and ``form`` alone.

    Rows whose output or form is null have a null text. A form other than the three, or an output without its
    sentinels, fails. A column called ``name`` already there is replaced.
    """
    strings = checked(sentinels)
    kept = [c for c in moved.columns if c != name]
    schema = moved.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, texts = batch.slice(at, 200), []
                for output, form in zip(part.column("_output").to_pylist(), part.column("_form").to_pylist()):
                    if form not in (None, "plain", "psm", "spm"):
                        raise ValueError(f"unknown form {form}")
                    texts.append(None if output is None or form is None else rebuilt(output, form, strings))
                columns = [part.column(k) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], [*kept, name])

    rows = moved.select(*kept, F.col("output").cast("binary").alias("_output"), F.col("form").alias("_form"))
    back = rows.mapInArrow(run, schema.add(name, "binary"))
    return back.withColumn(name, F.col(name).cast("string"))
