"""Log-likelihood of documents under a gated recurrent language model with class-factored output.

The most frequent words have embeddings and a softmax inside their class; all other words share
classes by their last two bytes and follow their counts inside a class. A gate tells the two kinds apart. So a word's
probability is that of its kind given the state, times that of its class among those of the kind, times that of the word in
the class, and all words together with one unseen word for each class of rare words sum to one. Counts cover the whole training text. The
network starts at the counts' distribution and is trained by truncated backpropagation in the tasks, which
learn from their documents side by side and are averaged after each round.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import rows_of, slices_of, stored

#: Words whose counts every task holds; the first ``NEURAL`` of them have weights of their own.
HEAD, NEURAL, CLASS = 131_072, 4096, 64
#: Classes of the other words by ending; the last takes all endings without one.
ENDINGS = 64
EMBED, HIDDEN = 16, 24
#: Steps of backpropagation, texts side by side, tokens that lanes are filled to before they are learnt, and rounds.
WINDOW, LANES, FILLED, ROUNDS = 24, 128, 288, 3


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case. One over 64 bytes is named by its digest, a blank in front, and its ending."""
    return named(text.encode("utf-8", "replace").lower().split())


def named(words: list[bytes]) -> list[bytes]:
    if max(map(len, words), default=0) > 64:
        words = [w if len(w) <= 64 else b" " + hashlib.sha256(w).hexdigest().encode() + w[-2:] for w in words]
    return words


def coded(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of ``words_of`` in all texts, the place of each word there, text after text, and the words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    found = lists.flatten().dictionary_encode()
    names, codes = found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
    if b"" in names:  # before or after white space at the ends, or a text without words
        there = codes != names.index(b"")
        size = np.bincount(np.repeat(np.arange(len(size)), size)[there], minlength=len(size))
        codes = codes[there]
    return named(names), codes, size


@dataclass
class Vocabulary:
    """Numbers: 0 the end, then head words by count, then the classes of endings for all others."""

    words: dict[bytes, int]
    endings: dict[bytes, int]
    counts: np.ndarray  # of head numbers
    tokens: int
    distinct: int
    ending_tokens: np.ndarray
    ending_distinct: np.ndarray

    def __post_init__(self):
        head, n = len(self.counts), len(self.ending_tokens)
        neural = min(head, NEURAL)
        self.classes = -(-neural // CLASS)
        self.head = head
        ending = np.full(head, n - 1)
        for w, i in self.words.items():
            if i >= neural:
                ending[i] = self.endings.get(w[-2:], n - 1)
        every = np.concatenate([ending, np.arange(n)])
        number = np.arange(head + n)
        plain = number >= neural
        self.plain = plain
        self.enter = np.where(plain, neural + every, number)  # 0 also begins a text
        self.group = np.where(plain, self.classes + every, number // CLASS)
        self.inside = np.where(plain, -1, number % CLASS)
        self.log_count = np.concatenate([np.log10(self.counts + 0.5), np.zeros(n)])
        self.log_mass = np.log10(self.ending_tokens + 0.5 * (self.ending_distinct + 1))
        self.known = np.concatenate([self.counts > 0, np.zeros(n, bool)])

    def numbers(self, words: list[bytes]) -> list[int]:
        """Numbers of words and of the end."""
        get, ending, head, other = self.words.get, self.endings.get, self.head, len(self.ending_tokens) - 1
        return [get(w) or head + ending(w[-2:], other) for w in words] + [0]

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Numbers of all texts end to end, their sizes, each with its end, the different words and the place of each among them, -1 for an end."""
        names, codes, size = coded(texts)
        spot = np.arange(len(codes)) + np.repeat(np.arange(len(size)), size)
        place = np.full(len(codes) + len(size), -1, np.int32)
        place[spot] = codes
        return np.array(self.numbers(names), np.int32)[place], size + 1, names, place


@dataclass
class Network:
    """``group_w`` and ``group_b`` hold the neural classes, the endings and, last, the gate: the log odds of a neural word."""

    e: np.ndarray
    w: np.ndarray
    u: np.ndarray
    b: np.ndarray
    group_w: np.ndarray
    group_b: np.ndarray
    word_w: np.ndarray
    word_b: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.e, self.w, self.u, self.b, self.group_w, self.group_b, self.word_w, self.word_b]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Network:
        cuts = np.cumsum([a.size for a in self.arrays()])[:-1]
        return Network(*(x.reshape(a.shape).astype(np.float32) for a, x in zip(self.arrays(), np.split(flat, cuts))))


def fresh(vocabulary: Vocabulary, seed: int = 17) -> Network:
    """Small weights and biases that give every word its share of the counts."""
    v, dice = vocabulary, np.random.default_rng(seed)
    endings, neural = len(v.ending_tokens), min(v.head, NEURAL)
    small = lambda *shape: (dice.standard_normal(shape) * 0.08).astype(np.float32)
    groups = v.classes + endings
    mass = np.zeros(v.classes * CLASS)
    mass[:neural] = v.counts[:neural] + 0.5
    word_b = np.full(v.classes * CLASS, -30.0)
    word_b[:neural] = np.log(mass[:neural])
    group_mass = np.concatenate([mass.reshape(v.classes, CLASS).sum(1), v.ending_tokens + 0.5 * (v.ending_distinct + 1)])
    own, others = group_mass[:v.classes].sum(), group_mass[v.classes:].sum()
    share = np.log(group_mass / np.repeat([own, others], [v.classes, endings]))
    e = small(neural + endings, EMBED)
    return Network(
        e * 4, small(EMBED, 3 * HIDDEN) * 2, small(HIDDEN, 3 * HIDDEN) * 2, np.zeros(3 * HIDDEN, np.float32),
        small(HIDDEN, groups + 1), np.append(share, np.log(own / others)).astype(np.float32),
        small(v.classes, HIDDEN, CLASS), word_b.reshape(v.classes, CLASS).astype(np.float32),
    )


def _step(a: np.ndarray, h: np.ndarray, u: np.ndarray, g: np.ndarray, zr: np.ndarray, n: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The next states into ``out``; what the cell computes on the way stays in ``g``, ``zr`` and ``n``."""
    np.matmul(h, u, out=g)
    np.add(a[:, :2 * HIDDEN], g[:, :2 * HIDDEN], out=zr)
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    np.multiply(zr[:, HIDDEN:], g[:, 2 * HIDDEN:], out=n)
    n += a[:, 2 * HIDDEN:]
    np.tanh(n, out=n)
    np.subtract(h, n, out=out)
    out *= zr[:, :HIDDEN]
    out += n
    return out


def _exp(x: np.ndarray) -> np.ndarray:
    """exp of logits, in place. Trained ones stay far from the limits of exp, so no row's largest is taken off."""
    if x.size and x.max() > 80:
        np.minimum(x, 80, out=x)
    return np.exp(x, out=x)


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def _log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One logarithm of each row's softmax; ``x`` is overwritten."""
    chosen = x[np.arange(len(x)), at]
    return chosen - np.log(_row_sums(_exp(x)))


def _miss(x: np.ndarray, at: np.ndarray, scale: float) -> np.ndarray:
    """Softmax of each row less the chosen one, times ``scale``, in place: the gradient of the logits."""
    _exp(x)
    x *= (scale / _row_sums(x))[:, None]
    x[np.arange(len(x)), at] -= scale
    return x


def _by_class(group: np.ndarray, classes: int) -> tuple[np.ndarray, int, list[tuple[int, int, int]]]:
    """An order by class, the number of neural words, which come first, and the neural classes with their ranges."""
    order = np.argsort(group.astype(np.int16), kind="stable")  # a radix sort
    ends = np.cumsum(np.bincount(group, minlength=classes)[:classes]).tolist()
    return order, ends[-1], [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]


def in_lanes(texts: Iterable[list[int]]) -> Iterator[tuple[list[int], list[list[int]]]]:
    """All texts side by side: again and again the numbers of the lanes that go on and their next ``FILLED`` tokens.

    Each text stands whole in one lane, which begins again with the token where it was cut.
    """
    lanes: list[list[int]] = [[] for _ in range(LANES)]

    def taken() -> tuple[list[int], list[list[int]]]:
        live = [k for k, x in enumerate(lanes) if len(x) > 1]
        some = [lanes[k][:FILLED + 1] for k in live]
        for k in live:
            lanes[k] = lanes[k][FILLED:] if len(lanes[k]) > FILLED + 1 else []
        return live, some

    for text in texts:
        lane = min(lanes, key=len)
        while len(lane) > FILLED:
            yield taken()
            lane = min(lanes, key=len)
        lane += text
    while any(len(x) > 1 for x in lanes):
        yield taken()


def train_windows(
    net: Network, v: Vocabulary, lanes: list[list[int]], memory: dict, rate: float, h: np.ndarray | None = None
) -> np.ndarray:
    """Truncated backpropagation over the lanes, whose state is carried from window to window; gives the last states.

    A lane is numbers in a row; every text in it begins with -1. ``memory`` holds Adam's moments, ``h`` the states
    that the lanes go on from.
    """
    longest = max(map(len, lanes))
    table = np.full((longest, len(lanes)), -2)
    for k, lane in enumerate(lanes):
        table[:len(lane), k] = lane
    h = np.zeros((len(lanes), HIDDEN), net.u.dtype) if h is None else h
    for start in range(0, longest - 1, WINDOW):
        x, y = table[start:min(start + WINDOW, longest - 1)], table[start + 1:start + 1 + WINDOW]
        begins, learns = x == -1, y >= 0
        if not learns.any():
            continue
        steps, width, kind = len(x), len(lanes), net.u.dtype
        keep = (~begins).astype(kind)[:, :, None]
        enter = v.enter[np.maximum(x, 0)]
        emb = net.e[enter]
        a = emb @ net.w + net.b
        before, states, n, zr, g = (np.empty((steps, width, k * HIDDEN), kind) for k in (1, 1, 1, 2, 3))
        begin = begins.any(1).tolist()
        for t in range(steps):
            if begin[t]:
                np.multiply(h, keep[t], out=before[t])
            else:
                before[t] = h
            h = _step(a[t], before[t], net.u, g[t], zr[t], n[t], states[t])
        z, r, g = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:], g[:, :, 2 * HIDDEN:]
        number = y[learns]
        order, own, ranges = _by_class(v.group[number], v.classes)
        number = number[order]
        spot = np.flatnonzero(learns)[order]
        s = states.reshape(-1, HIDDEN)[spot]
        group, inside = v.group[number], v.inside[number[:own]]
        scale = 1 / len(number)
        grad = {k: np.zeros_like(getattr(net, k)) for k in ("group_w", "group_b", "word_w", "word_b", "e")}
        d = np.empty_like(s)
        for first, last, lowest, highest in ((0, own, 0, v.classes), (own, len(s), v.classes, len(net.group_b) - 1)):
            for k in range(first, last, 2048):  # parts that stay in the cache
                rows, part = slice(k, min(k + 2048, last)), slice(lowest, highest)
                p = s[rows] @ net.group_w[:, part]
                p += net.group_b[part]
                _miss(p, group[rows] - lowest, scale)
                np.matmul(p, net.group_w[:, part].T, out=d[rows])
                grad["group_w"][:, part] += s[rows].T @ p
                grad["group_b"][part] += np.ones(len(p), kind) @ p
        gate = 1 / (1 + np.exp(-(s @ net.group_w[:, -1] + net.group_b[-1])))
        gate[:own] -= 1
        gate *= scale
        d += gate[:, None] * net.group_w[:, -1]
        grad["group_w"][:, -1], grad["group_b"][-1] = gate @ s, gate.sum()
        q, back = np.empty((own, CLASS), kind), np.empty((own, HIDDEN), kind)
        for k, first, last in ranges:
            np.matmul(s[first:last], net.word_w[k], out=q[first:last])
            q[first:last] += net.word_b[k]
        _miss(q, inside, scale)
        for k, first, last in ranges:
            np.matmul(q[first:last], net.word_w[k].T, out=back[first:last])
            np.matmul(s[first:last].T, q[first:last], out=grad["word_w"][k])
        if ranges:
            grad["word_b"][[k for k, _, _ in ranges]] = np.add.reduceat(q, [first for _, first, _ in ranges])
        d[:own] += back
        d_states = np.zeros_like(states)
        d_states.reshape(-1, HIDDEN)[spot] = d
        # What a state's gradient is multiplied by on its way to each gate; the steps then only pass it back.
        to_n = (1 - z) * (1 - n * n)
        to_r = to_n * g * r * (1 - r)
        to = np.stack([(before - n) * z * (1 - z), to_r, to_n * r], 2)
        d_g, back = np.empty_like(to), np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            d_states[t] += back
            np.multiply(to[t], d_states[t][:, None], out=d_g[t])
            back = d_g[t].reshape(width, -1) @ net.u.T
            back += d_states[t] * z[t]
            if begin[t]:
                back *= keep[t]
        to_n *= d_states
        flat = np.concatenate([d_g[:, :, 0], d_g[:, :, 1], to_n], 2).reshape(-1, 3 * HIDDEN)
        grad["u"], grad["b"] = before.reshape(-1, HIDDEN).T @ d_g.reshape(-1, 3 * HIDDEN), flat.sum(0)
        grad["w"] = emb.reshape(-1, EMBED).T @ flat
        order = np.argsort(enter.ravel().astype(np.int16), kind="stable")
        entered, first = np.unique(enter.ravel()[order], return_index=True)
        grad["e"][entered] = np.add.reduceat((flat @ net.w.T)[order], first)
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in grad.values()))
        memory["t"] = memory.get("t", 0) + 1
        fix = np.sqrt(1 - 0.99 ** memory["t"]) / (1 - 0.9 ** memory["t"])
        for name, x in grad.items():
            x *= 0.1 * min(1.0, 1.0 / max(norm, 1e-9))
            m, q = memory.setdefault(name, (np.zeros_like(x), np.zeros_like(x)))
            m *= 0.9
            m += x
            x *= x  # a hundredth of the gradient's square
            q *= 0.99
            q += x
            np.sqrt(q, out=x)
            x += 1e-6
            np.divide(m, x, out=x)
            x *= rate * fix
            getattr(net, name)[...] -= x
    return h


def score_texts(net: Network, v: Vocabulary, texts: list[list[int]], lanes: int = 512) -> np.ndarray:
    """Natural log probability of each text's classes and neural words, the state carried from its first to its last token."""
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    a_of = net.e @ net.w + net.b
    # Texts are dealt to the shortest lane in turn; at every step the lanes still running stand first. Lanes lie one
    # after another, so a very long text takes no more room than its tokens.
    rows: list[list[int]] = [[] for _ in range(min(lanes, len(texts)))]
    free = [(0, j) for j in range(len(rows))]
    for k in order:
        filled, j = heapq.heappop(free)
        rows[j].append(k)
        heapq.heappush(free, (filled + len(texts[k]), j))
    free.sort(key=lambda x: -x[0])
    dealt = [k for _, j in free for k in rows[j]]
    length = np.array([len(texts[k]) for k in dealt], int)
    size = np.array([filled for filled, _ in free], int)
    start = np.cumsum(size) - size
    target = np.concatenate([np.asarray(texts[k], np.int32) for k in dealt]) if dealt else np.zeros(0, np.int32)
    owner = np.repeat(np.array(dealt, np.int32), length)
    enter = np.empty(len(target), np.int32)
    enter[1:] = v.enter[target[:-1]]
    begins = np.cumsum(length) - length
    enter[begins] = v.enter[0]
    first = np.zeros(len(target), bool)
    first[begins] = True
    longest = int(size[0]) if len(size) else 0
    running = np.searchsorted(-size, -np.arange(longest), "left")
    # All in the order of the steps, within a step by lane.
    step = np.cumsum(running) - running
    place = step[np.arange(len(target)) - np.repeat(start, size)] + np.repeat(np.arange(len(size)), size)
    at = np.empty(len(target), np.int64)
    at[place] = np.arange(len(target))
    target, owner, enter, first = target[at], owner[at], enter[at], first[at]
    fresh_lanes = np.add.reduceat(first, step) if longest else []
    del at, place
    most = 32_768 + len(rows)
    states, into, g, zr, n = (np.empty((k, w * HIDDEN), np.float32) for k, w in ((most, 1), (len(rows), 3), (len(rows), 3), (len(rows), 2), (len(rows), 1)))
    h = np.zeros((len(rows), HIDDEN), np.float32)
    held = 0  # steps are gathered, so that the outputs are computed for many tokens at once
    for t, (live, here, new) in enumerate(zip(running.tolist(), step.tolist(), fresh_lanes)):
        h, end = h[:live], here + live
        if new:
            h = np.where(first[here:end, None], np.float32(0), h)
        np.take(a_of, enter[here:end], axis=0, out=into[:live], mode="clip")
        h = _step(into[:live], h, net.u, g[:live], zr[:live], n[:live], states[held:held + live])
        held += live
        if held < 32_768 and t < longest - 1:
            continue
        s, y, own = states[:held], target[end - held:end], owner[end - held:end]
        h, held = h.copy(), 0
        order, neural, ranges = _by_class(v.group[y], v.classes)
        s, y, own = s[order], y[order], own[order]
        group, inside = v.group[y], v.inside[y]
        log_p = np.empty(len(y))
        for a, b, lowest, highest in ((0, neural, 0, v.classes), (neural, len(y), v.classes, len(net.group_b) - 1)):
            for k in range(a, b, 2048):
                rows, part = slice(k, min(k + 2048, b)), slice(lowest, highest)
                x = s[rows] @ net.group_w[:, part]
                x += net.group_b[part]
                log_p[rows] = _log_share(x, group[rows] - lowest)
        gate = s @ net.group_w[:, -1] + net.group_b[-1]
        gate[:neural] *= -1
        log_p -= np.logaddexp(0, gate)
        for k, a, b in ranges:
            for j in range(a, b, 2048):
                rows = slice(j, min(j + 2048, b))
                x = s[rows] @ net.word_w[k]
                x += net.word_b[k]
                log_p[rows] += _log_share(x, inside[rows])
        out += np.bincount(own, log_p, minlength=len(out))
    return out


def word_counts(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """``(word binary, c)`` over all texts; tasks add up to ``most`` words before they pass them on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])
        have: Counter = Counter()
        for batch in batches:
            for part in slices_of(batch, "text"):
                names, codes, _ = coded(part.column("text"))
                for word, c in zip(names, np.bincount(codes, minlength=len(names)).tolist()):
                    if c:
                        have[word] += c
                if len(have) > most:
                    yield from rows_of(schema, [list(have.keys()), list(have.values())])
                    have.clear()
        if have:
            yield from rows_of(schema, [list(have.keys()), list(have.values())])

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary_of(counts: DataFrame, texts: int) -> Vocabulary:
    """The parts of the counts that every task needs; their size is fixed.

    The head takes whole bands of counts, the highest first, as long as they fit: a
    histogram of bands decides, so no task sends its own top words to the driver.
    """
    band = F.floor(F.log2("c") * 64)
    bands = counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()
    least, held = float("inf"), 0
    for r in sorted(bands, key=lambda r: -r.band):
        held += r.n
        if held > HEAD - 1:
            break
        least = r.band
    head = counts.where(band >= F.lit(least)).collect() if bands else []
    head = sorted(head, key=lambda r: (-r.c, bytes(r.word)))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    neural = counts.sparkSession.createDataFrame([(bytes(r.word),) for r in head[:NEURAL - 1]], "word binary")
    # Two bytes: at most 65,792 endings. The words with weights of their own are a few thousand.
    rest = counts.join(F.broadcast(neural), "word", "left_anti").groupBy(F.substring("word", -2, 2).alias("ending")).agg(
        F.sum("c").alias("n"), F.count("*").alias("v")
    ).orderBy(F.desc("n"), "ending").collect()
    own = rest[:ENDINGS - 1]
    tokens, distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for k, r in enumerate(rest):
        tokens[min(k, ENDINGS - 1)] += r.n
        distinct[min(k, ENDINGS - 1)] += r.v
    return Vocabulary(
        {bytes(r.word): i + 1 for i, r in enumerate(head)}, {bytes(r.ending): k for k, r in enumerate(own)},
        np.array([texts, *(r.c for r in head)], float), int(total.n) + texts, int(total.v) + (texts > 0), tokens, distinct,
    )


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, rate: float = 0.01) -> Network:
    """A network from all rows of ``docs``.

    Each text belongs to one round and is trained on from its first to its last token. Where only few lanes are left
    at the end of a task, its steps are shorter by that share. Every task trains a copy; copies are averaged by the tokens they saw, piece by piece on the executors. One network reaches the driver.
    """
    spark = docs.sparkSession
    net = fresh(vocabulary)
    size, piece = net.flat().size, 4096
    known = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select("text", F.xxhash64("doc_id", "text").alias("hash"))
    for number in range(rounds):
        here = spark.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, own = known.value, here.value.filled(here.value.flat())
            state, memory = np.zeros((LANES, HIDDEN), np.float32), {}
            seen = most = 0

            def texts() -> Iterator[list[int]]:
                for batch in batches:
                    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
                    # The longest first, so that few lanes are left alone at the end.
                    for part in slices_of(batch.take(pa.array(np.argsort(-size, kind="stable"))), "text"):
                        flat, size, *_ = v.of_texts(part.column("text"))
                        for text in np.split(flat, np.cumsum(size)[:-1]):
                            yield [-1, *text.tolist()]

            for live, some in in_lanes(texts()):
                seen += sum(map(len, some))
                most = max(most, len(live))
                state[live] = train_windows(own, v, some, memory, rate * len(live) / most, state[live])
            if seen:
                flat = own.flat() * seen
                for k in range(0, size, piece):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int64()), pa.array([float(seen)]), pa.array([flat[k:k + piece].astype(float).tobytes()])], ["piece", "seen", "sums"]
                    )

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for k, seen, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    old = sums.get(k, [0.0, 0.0])
                    sums[k] = [old[0] + seen, old[1] + np.frombuffer(raw)]
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(sums)), pa.array([x[0] for x in sums.values()]), pa.array([x[1].tobytes() for x in sums.values()])], ["piece", "seen", "sums"]
                )

        mine = rows.where(F.pmod("hash", F.lit(rounds)) == number)
        schema = "piece long, seen double, sums binary"
        parts = mine.mapInArrow(run, schema).repartition("piece").mapInArrow(added, schema).collect()
        if parts:
            flat = net.flat()
            for r in parts:
                flat[r.piece:r.piece + piece] = np.frombuffer(r.sums) / r.seen
            net = net.filled(flat)
    return net


def likelihoods(docs: DataFrame, held_out: Column) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    The model learns from the rows that are not held out and scores all whole texts, with the state carried to the end; a null or
    blank text is its end alone. Equal rows get equal results. Without training texts every word is unseen and the
    scores are those of the start. Further columns are ignored.
    """
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learnt = rows.where("not held_out")
    counts = stored(word_counts(learnt), "word-counts")
    v = vocabulary_of(counts, learnt.count())
    known = docs.sparkSession.sparkContext.broadcast(v)
    net = docs.sparkSession.sparkContext.broadcast(train(learnt, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, numbered within the task, and one for each word in it that is not in the head."""
        v, after = known.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices_of(batch, "text", 16_000_000):
                flat, size, words, place = v.of_texts(part.column("text"))
                start = np.cumsum(size) - size
                texts = np.split(flat, start[1:])
                log_count = np.add.reduceat(v.log_count[flat], start)
                plain = v.plain[flat]
                mass = np.where(plain, v.log_mass[np.where(plain, v.group[flat] - v.classes, 0)], 0.0)
                rest = np.add.reduceat(np.where(plain, v.log_count[flat], 0.0) - mass, start)
                known_head = np.add.reduceat(v.known[flat].astype(np.int64), start)
                score = score_texts(net.value, v, texts) / np.log(10) + rest
                row = np.arange(after, after + len(texts))
                after += len(texts)
                none = pa.nulls(len(texts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row), part.column("doc_id"), part.column("held_out"), pa.array(size), pa.array(known_head), pa.array(log_count), pa.array(score),
                    none.cast(pa.binary()), none.cast(pa.int64()),
                ], names)
                met = np.flatnonzero(flat >= v.head)
                if len(met):
                    of = np.repeat(np.arange(len(texts)), size)[met]
                    found = pa.table([pa.array(row[of]), pa.array(place[met])], ["row", "word"]).group_by(["row", "word"]).aggregate([([], "count_all")])
                    met_words = pa.array(words, pa.binary()).take(found["word"].combine_chunks())
                    blank = [pa.nulls(found.num_rows).cast(t) for t in (part.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield from rows_of(
                        pa.schema(list(zip(names, [pa.int64(), *(b.type for b in blank), pa.binary(), pa.int64()]))),
                        [found["row"].combine_chunks(), *blank, met_words, found["count_all"].combine_chunks()],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "head_score", "word", "times"]
    every = stored(rows.mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, head_known long, head_log double, head_score double, word binary, times long"
    ), "scored")
    # Words outside the head meet their counts by a join.
    met = every.where("word IS NOT NULL").select(F.col("row").alias("rare_row"), "word", "times").join(
        counts.withColumnRenamed("word", "counted"), F.col("word") == F.col("counted"), "left"
    )
    c = F.coalesce("c", F.lit(0))
    sums = met.groupBy("rare_row").agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("rare_log"), F.sum(F.when(c > 0, F.col("times"))).alias("rare_known")
    )
    both = every.where("word IS NULL").join(sums, F.col("row") == F.col("rare_row"), "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    mass = float(np.log10(v.tokens + 0.5 * (v.distinct + 1)))
    return both.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare_log - F.col("n_tokens") * F.lit(mass)).alias("base_score"),
        (F.col("head_score") + rare_log).alias("score"),
    )
