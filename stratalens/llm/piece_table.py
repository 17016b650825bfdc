"""SentencePiece encoding by a table of prefixes.

Every prefix of a text has one encoding, so it has one last piece. An Aho-Corasick automaton
names the pieces that end at a place; the one that is compatible with the last piece of the
prefix before it goes into the table, and the ids are read from the table's end backwards.
A text costs time in proportion to its length, also where it has no blanks.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import rows_of, texts_of

MARK = "▁"
#: Words whose ids a worker keeps in each of two generations, and pairs tested; the older words go when the newer are full.
KEPT_WORDS = 250_000
KEPT_PAIRS = 600_000
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceTable:
    """Encoder of a BPE model with byte fallback, identity normalisation and a blank put in front."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)):
                self.score[piece], self.ids[piece] = lib.get_score(i), i
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that reach over a blank are not supported")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best-scored pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether the encoding of both texts together is these two pieces (``left`` may be empty)."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def word(self, text: str) -> list[int]:
        """Ids of a stretch that no merge leaves."""
        last, at, compatible = [""] * (len(text) + 1), 0, self.compatible
        for end, piece in self.automaton.iter(text):
            end += 1
            if not last[end]:
                while at < end - 1:  # characters that no piece ends at
                    at += 1
                    last[at] = last[at] or text[at - 1]
                if compatible(last[end - len(piece)], piece):
                    last[end] = piece
        out: list[int] = []
        end = len(text)
        while end:
            piece = last[end] or text[end - 1]
            i = self.ids.get(piece)
            if i is None:
                out.extend(self.byte[b] for b in reversed(piece.encode("utf-8", "replace")))
            else:
                out.append(i)
            end -= len(piece)
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; none for an empty one."""
        if not text:
            return []
        words, out = self.words, []
        for w in _WORD.findall(MARK + text.replace(" ", MARK)):
            ids = words.get(w)
            if ids is None:
                ids = self.older.get(w) or self.word(w)
                if len(w) <= 64:
                    if len(words) >= KEPT_WORDS:
                        self.older, self.words = words, {}
                        words = self.words
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@functools.cache
def table_of(path: str) -> PieceTable:
    """One table for each worker and model."""
    return PieceTable(path)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` of every row.

    A null text counts as empty and has no ids; an empty table gives an empty one. Every row
    comes out once, repeated ids too; further columns are left out, so none can clash. Invalid
    surrogates cannot occur in Spark strings. ``model`` must be readable on every executor.
    """
    return _mapped(docs, model, id_col, text_col, f"`{id_col}` {_kind(docs, id_col)}, ids array<int>", _ids)


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like :func:`encode_documents`, with the digests of ids and decoded text instead of the ids."""
    schema = f"`{id_col}` {_kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, model, id_col, text_col, schema, _digests)


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)`` of id lists; a null list gives an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [table_of(model).decode(x or []) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    rows = encoded.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("_ids"))
    return rows.mapInArrow(run, f"`{id_col}` {_kind(encoded, id_col)}, text string")


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _ids(encoder: PieceTable, texts: list[str]) -> list[pa.Array]:
    return [pa.array([encoder.encode(t) for t in texts], pa.list_(pa.int32()))]


def _digests(encoder: PieceTable, texts: list[str]) -> list[pa.Array]:
    n, ids_hex, text_hex = [], [], []
    for t in texts:
        ids = encoder.encode(t)
        n.append(len(ids))
        ids_hex.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        text_hex.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
    return [pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]


def _mapped(
    docs: DataFrame, model: str, id_col: str, text_col: str, schema: str,
    finish: Callable[[PieceTable, list[str]], list[pa.Array]],
) -> DataFrame:
    names = [x.strip().split()[0].strip("`") for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = table_of(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), *finish(encoder, texts_of(part, "_text"))], names)

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)
