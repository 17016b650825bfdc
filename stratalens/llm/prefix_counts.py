"""Token counts at every prefix of a text, by dynamic programming over prefixes.

In byte-pair encoding every prefix of a word has one encoding, so it has one last token: the one that ends there
and is compatible with the last token of what stands before it. Its count is one more than that prefix's.
A text keeps the change of the count at each code point; their running sum answers how many tokens any prefix has and
where a budget ends, without encoding again.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections import ChainMap
from collections.abc import Callable, Iterator
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, MapType

from stratalens.llm.common import slices_of, texts_of

#: Chunks and words that a worker keeps, in each of two generations, and pairs of tokens tested.
KEPT_CHUNKS, KEPT_WORDS, KEPT_PAIRS = 200_000, 400_000, 1_000_000
#: Longest chunk or word that is kept and shares its beginning with others.
SHORT = 64
#: White space of byte-level pre-tokenisers, and contractions that are cut from a word.
_BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTRACTIONS = ("'re", "'ve", "'ll")
_BLANK_RUN = re.compile(f"[{_BLANKS}]+")
# A lone blank between visible characters begins a word of its own; Python's white space holds all of the pre-tokeniser's.
_UNEVEN = re.compile(r"\s[ ]|[ ]\s|^[ ]|[ ]$")
_LONE = re.compile(r"(?<=\S)(?= \S)")
# Latin letters, digits, marks that no contraction begins with and single line ends: words of the pre-tokeniser as they are found.
_SIMPLE = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[.,;:!?]+|\n(?=[A-Za-z0-9À-ÖØ-öø-ɏ.,;:!?])")


class PrefixCounter:
    """Counts for a byte-level BPE in a file of the tokenizers library, special strings counted as it does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        file = json.loads(self.library.to_str())
        split, model = file["pre_tokenizer"] or {}, file["model"]
        if file["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("a byte-level BPE without normaliser and prefix blank is needed")
        if model.get("ignore_merges") or model.get("dropout") or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in file["added_tokens"]):
            raise ValueError("only plain merges and plain special strings are supported")
        special = sorted((x["content"] for x in file["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.strings = special
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # Numbers in the order in which tokens come to be: bytes, then merges. A byte's halves are itself.
        letters = _letters()
        self.number = {c: k for k, c in enumerate(letters)}
        self.left, self.right, self.joined = list(range(256)), list(range(256)), {}
        for a, b in merges:
            number = self.number.setdefault(a + b, len(self.left))
            if number < len(self.left):
                raise ValueError("two merges give one token")
            self.left.append(self.number[a])
            self.right.append(self.number[b])
            self.joined[self.number[a] << 32 | self.number[b]] = number
        self.letters = str.maketrans({b: c for b, c in enumerate(letters)})
        self.automaton = ahocorasick.Automaton()
        for token, number in self.number.items():
            self.automaton.add_word(token, (len(token), number))
        self.automaton.make_automaton()
        # A trie of the tokens' bytes: edges by 256 times their upper node plus the byte, and the token that ends at a node.
        nodes: dict[bytes, int] = {b"": 0}
        edges: list[tuple[int, int]] = []
        ends = []
        byte = {c: k for k, c in enumerate(letters)}
        for token, number in self.number.items():
            raw = bytes(byte[c] for c in token)
            for k in range(len(raw)):
                if raw[:k + 1] not in nodes:
                    nodes[raw[:k + 1]] = len(nodes)
                    edges.append((nodes[raw[:k]] << 8 | raw[k], nodes[raw[:k + 1]]))
            ends.append((nodes[raw], number))
        keys = np.array(edges, np.int64)
        self.edges, self.lower = keys[keys[:, 0].argsort()].T.copy()
        self.ending = np.full(len(nodes), -1, np.int64)
        self.ending[[n for n, _ in ends]] = [k for _, k in ends]
        self.pairs: list[dict[int, bool]] = [{} for _ in self.left]
        self.pairs_held = 0
        self.chunks: list[dict[str, bytes]] = [{}, {}]
        self.words: list[dict[str, bytes]] = [{}, {}]

    def compatible(self, a: int, b: int) -> bool:
        """Whether both tokens, each the encoding of its own text, are the encoding of the two texts together.

        Their merges are undone from the last back. They are incompatible if at some time the tokens on both sides of the
        border would have merged before the merge just undone; of equal merges the left one comes first.
        """
        left, right, joined = self.left, self.right, self.joined
        before = len(left)
        while True:
            if joined.get(a << 32 | b, before) < before:
                return False
            inner, outer = right[a], left[b]
            if a > b and a > 255:
                before, a = a, inner
            elif b > 255:
                before, b = b + 1, outer
            elif a > 255:
                before, a = a, inner
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """:meth:`compatible`, remembered."""
        found = self.pairs[a].get(b)
        if found is None:
            if self.pairs_held >= KEPT_PAIRS:
                self.pairs, self.pairs_held = [{} for _ in self.left], 0
            found = self.pairs[a][b] = self.compatible(a, b)
            self.pairs_held += 1
        return found

    def table(self, letters: str) -> list[int]:
        """The token count of every prefix of one word in byte letters, the empty one first, from the automaton's matches."""
        last, count = [-1] * (len(letters) + 1), [0] * (len(letters) + 1)
        for end, (size, number) in self.automaton.iter(letters):
            end += 1
            if last[end] < 0:
                start = end - size
                if not start or self.fits(last[start], number):
                    last[end], count[end] = number, count[start] + 1
        return count

    def tables(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The order of distinct short words and, in that order, the counts of each one's prefixes as of :meth:`table`.

        All words advance by a byte at a time. A beginning that several share is one node; from each place where a token may begin
        a walk through the trie goes on, and where a token ends it is set against the last one before it.
        """
        n, width = len(words), max(map(len, words))
        letters = np.zeros((n, width), np.uint8)
        size = np.array([len(w) for w in words])
        letters[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        order = np.lexsort([size, *letters.T[::-1]])
        letters, size = letters[order], size[order]
        same = (letters[1:] == letters[:-1]) & (np.arange(width) < np.minimum(size[1:], size[:-1])[:, None])
        shared = np.r_[0, np.where(same.all(1), width, same.argmin(1))]
        node = np.zeros((n, width + 1), np.int64)  # of each word's prefixes; numbers go on from level to level
        last, count = np.full(1 + int((size - shared).sum()), -1), np.zeros(1 + int((size - shared).sum()), np.int64)
        held = 1
        walks = np.zeros((2, 0), np.int64)  # where each began and its place in the trie, node by node
        first, many = np.zeros(1, np.int64), np.zeros(1, np.int64)  # walks of the nodes of a level
        below = 0
        for end in range(1, width + 1):
            alive = np.flatnonzero(size >= end)
            new = shared[alive] < end
            node[alive, end] = held - 1 + np.cumsum(new)
            own = alive[new]
            above = node[own, end - 1] - below
            length = many[above] + 1
            start = np.cumsum(length) - length
            pick = np.arange(int(length.sum())) - np.repeat(start, length)
            of = np.repeat(np.arange(len(own)), length)
            fresh = pick == length[of] - 1  # the walk that begins with this byte
            at = np.where(fresh, 0, first[above][of] + pick)
            began = np.where(fresh, end - 1, walks[0][at] if walks.size else 0)
            place = np.where(fresh, 0, walks[1][at] if walks.size else 0)
            key = place << 8 | letters[own[of], end - 1]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            goes = np.flatnonzero(self.edges[edge] == key)
            of, began, place = of[goes], began[goes], self.lower[edge[goes]]
            token = self.ending[place]
            ends = np.flatnonzero(token >= 0)
            before = node[own[of[ends]], began[ends]]
            pair, back = np.unique((last[before] + 1) << 32 | token[ends], return_inverse=True)
            fit = np.array([p < 1 << 32 or self.fits((p >> 32) - 1, p & 0xFFFFFFFF) for p in pair.tolist()], bool)[back]
            ends, before = ends[fit], before[fit]
            last[held + of[ends]], count[held + of[ends]] = token[ends], count[before] + 1
            walks = np.stack([began, place])
            many = np.bincount(of, minlength=len(own))
            first = np.cumsum(many) - many
            below, held = held, held + len(own)
        return order, count[node]

    def learn(self, words: set[str]) -> None:
        """Work out words that are not kept yet: the changes of the count at each code point, as 16-bit integers."""
        newer, older = self.words
        short = []
        for word in words:
            if word not in newer:
                found = older.get(word)
                if found is not None:
                    newer[word] = found
                elif len(word) <= SHORT:
                    short.append(word)
        if not short:
            return
        raw = [w.encode() for w in short]
        order, counts = self.tables(raw)
        changes, step = np.diff(counts).astype("<i2").tobytes(), 2 * (counts.shape[1] - 1)
        for row, at in enumerate(order.tolist()):
            word = short[at]
            if word.isascii():
                newer[word] = changes[row * step:row * step + 2 * len(word)]
            else:
                newer[word] = self.by_character(word, counts[row, :len(raw[at]) + 1].tolist())

    @staticmethod
    def by_character(word: str, count: list[int]) -> bytes:
        if len(word) + 1 != len(count):
            count = [count[k] for k, b in enumerate(word.encode()) if b & 0xC0 != 0x80] + [count[-1]]
        return array("h", map(sub, count[1:], count)).tobytes()

    def word(self, word: str) -> bytes:
        """Changes of the count in one word; learnt words are looked up."""
        found = self.words[0].get(word)
        if found is None:
            found = self.by_character(word, self.table(word.encode().decode("latin-1").translate(self.letters)))
            if len(word) <= SHORT:
                self.words[0][word] = found
        return found

    def stretch(self, text: str, words: list[str]) -> bytes:
        """Changes of the count over a text that begins as a text or with a lone blank, from its words as the library cuts it.

        A prefix may end where it would not have cut: inside white space, whose prefixes are one word each, and inside a
        contraction, of which a mark and a letter are left.
        """
        changes = b"".join(map(self.word, words))
        runs = [m.span() for m in _BLANK_RUN.finditer(text) if m.end() - m.start() > 1]
        count = np.r_[0, np.cumsum(np.frombuffer(changes, "<i2"), dtype=np.int64)]
        total, at = count.copy(), 0
        for word in words:
            at += len(word)
            if word in _CONTRACTIONS:
                total[at - 1] = count[at - 3] + 2
        for a, b in runs:
            total[a + 1:b + 1] = count[a] + np.cumsum(np.frombuffer(self.word(text[a:b]), "<i2"))
        return np.diff(total).astype("<i2").tobytes()

    def parts(self, text: str) -> list[str]:
        """A text without special strings, cut before every lone blank between visible characters."""
        if "\0" not in text and not _UNEVEN.search(text):
            return text.replace(" ", "\0 ").split("\0")
        return _LONE.split(text)

    def ordinary(self, texts: list[str]) -> list[bytes]:
        """Changes of the count over texts without special strings; what is new in any of them is learnt first."""
        parts = [self.parts(t) if t else [] for t in texts]
        chunks, older = self.chunks
        if len(chunks) >= KEPT_CHUNKS:
            self.chunks = [{}, chunks]
            chunks, older = self.chunks
        if len(self.words[0]) >= KEPT_WORDS:
            self.words = [{}, self.words[0]]
        plain: dict[str, list[str]] = {}
        other: dict[str, list[str]] = {}
        for part in set().union(*parts):
            if part not in chunks:
                found = older.get(part)
                if found is not None:
                    chunks[part] = found
                    continue
                words = _SIMPLE.findall(part)
                if len("".join(words)) == len(part):
                    plain[part] = words
                else:
                    other[part] = [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        self.learn(set().union(*plain.values(), *other.values()))
        long, word, known = {}, self.word, self.words[0].get
        for part, words in plain.items():
            (chunks if len(part) <= SHORT else long)[part] = b"".join([known(w) or word(w) for w in words])
        for part, words in other.items():
            (chunks if len(part) <= SHORT else long)[part] = self.stretch(part, words)
        found = chunks if not long else ChainMap(chunks, long)
        return [b"".join([found[p] for p in own]) for own in parts]

    def changes(self, texts: list[str]) -> list[np.ndarray]:
        """Changes of the count at each code point of whole texts."""
        if not any(s in t for t in texts for s in self.strings):
            return [np.frombuffer(c, "<i2") for c in self.ordinary(texts)]
        # Up to its last character a special string is ordinary text that goes on with what stands before it.
        cuts = [[(m.start(), m.end()) for m in self.special.finditer(t)] for t in texts]
        starts = [[0, *(b for _, b in own)] for own in cuts]
        pieces = [t[a:b] for t, own, first in zip(texts, cuts, starts) for a, b in zip(first, [*(b - 1 for _, b in own), len(t)])]
        found = iter(self.ordinary(pieces))
        out = []
        for own, first in zip(cuts, starts):
            whole = []
            for begin, (a, _) in zip(first, own):
                inside = np.frombuffer(next(found), "<i2").astype(np.int64)
                whole.append(np.r_[inside, int(inside[:a - begin].sum()) + 1 - int(inside.sum())])
            out.append(np.concatenate([*whole, np.frombuffer(next(found), "<i2")]).astype("<i2"))
        return out

    def counts(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text, in code points from none to all: exactly those of encoding that prefix."""
        return np.r_[0, np.cumsum(self.changes([text])[0], dtype=np.int64)]


class Prefixes:
    """A text's stored counts, for questions about its prefixes."""

    def __init__(self, changes: bytes | np.ndarray):
        changes = np.frombuffer(changes, "<i2") if isinstance(changes, bytes) else changes
        self.count = np.r_[0, np.cumsum(changes, dtype=np.int64)]

    def __len__(self) -> int:
        return int(self.count[-1])

    def tokens(self, chars: int) -> int:
        """Tokens of the first ``chars`` code points; beyond the text those of all."""
        return int(self.count[min(max(chars, 0), len(self.count) - 1)])

    def within(self, budget: int) -> int:
        """Code points of the longest prefix that has at most ``budget`` tokens. Counts may fall as a prefix grows; so the last place counts."""
        return int(np.flatnonzero(self.count <= max(budget, 0))[-1])


@functools.cache
def counter_of(path: str) -> PrefixCounter:
    """One counter for each worker and file."""
    return PrefixCounter(path)


def _letters() -> list[str]:
    """The letter by which byte-level BPE files write each byte: printable Latin-1 as it is, the others from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _mapped(
    docs: DataFrame, id_col: str, text_col: str, schema: str, finish: Callable[[list[str]], list[pa.Array]]
) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column(0), *finish(texts_of(part, "_text"))], names)

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` of every row: the last entry of the counts of its prefixes.

    A null text counts as empty and has no tokens. Every row comes out once, repeated and null ids too; texts are
    counted whole whatever their length; other columns are left out, so none can clash; an empty table gives an empty one.
    ``tokenizer`` must be readable on every executor.
    """
    def finish(texts: list[str]) -> list[pa.Array]:
        n = np.array([len(Prefixes(c)) for c in counter_of(tokenizer).changes(texts)], np.int64)
        return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)]

    return _mapped(docs, id_col, text_col, "n_bytes long, n_tokens long, over_limit boolean", finish)


def prefix_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, changes)`` of every row, nulls and repeats as in :func:`token_counts`.

    ``changes`` holds a 16-bit integer for each code point; a table of them answers later questions by :func:`answered`.
    """
    def finish(texts: list[str]) -> list[pa.Array]:
        found = counter_of(tokenizer).changes(texts)
        n = [int(c.sum(dtype=np.int64)) for c in found]
        return [pa.array(n, pa.int64()), pa.array([c.astype("<i2").tobytes() for c in found], pa.binary())]

    return _mapped(docs, id_col, text_col, "n_tokens long, changes binary", finish)


def answered(prefixes: DataFrame, budgets: list[int] = (), places: list[int] = ()) -> DataFrame:
    """The rows of a prefix table with ``chars_within`` and ``tokens_at`` in place of ``changes``.

    ``chars_within`` maps each budget of tokens to the longest prefix, in code points, that keeps it; ``tokens_at`` maps
    a number of code points to the tokens of that prefix. A text shorter than that counts whole, a null table entry as empty.
    """
    kept = [c for c in prefixes.columns if c not in ("changes", "chars_within", "tokens_at")]
    counts = MapType(IntegerType(), LongType())
    schema = prefixes.select(*kept).schema.add("chars_within", counts).add("tokens_at", counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.int32(), pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [Prefixes(c or b"") for c in part.column("changes").to_pylist()]
                columns = [pa.array([[(b, p.within(b)) for b in budgets] for p in found], kind), pa.array([[(c, p.tokens(c)) for c in places] for p in found], kind)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], [*kept, "chars_within", "tokens_at"])

    return prefixes.mapInArrow(run, schema)


def truncated(docs: DataFrame, tokenizer: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, chars, text)``: the longest prefix of every text that has at most ``budget`` tokens, whole texts counted.

    A null text gives an empty one.
    """
    def finish(texts: list[str]) -> list[pa.Array]:
        found = [Prefixes(c) for c in counter_of(tokenizer).changes(texts)]
        cut = [p.within(budget) for p in found]
        return [pa.array([len(p) for p in found], pa.int64()), pa.array(cut, pa.int64()), pa.array([t[:c] for t, c in zip(texts, cut)], pa.string())]

    return _mapped(docs, id_col, text_col, "n_tokens long, chars long, text string", finish)
