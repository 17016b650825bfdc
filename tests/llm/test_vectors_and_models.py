"""Lattice hashing, packing, small-world graphs, the recurrent model and the pipeline on small tables."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratalens.llm import common, grouping_pack, gru_lm, hnsw, lattice, ordinal, queries

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def close_families(dice, groups, each, size=64):
    centres = dice.standard_normal((groups, size))
    noise = dice.standard_normal((groups * each, size)) * 0.15 * np.repeat(dice.random(groups), each)[:, None]
    return np.repeat(centres, each, 0) + noise


# Components

def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7), (None, 3), (70, 71), (71, 70)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{k: 1 for k in range(1, 40)}, 70: 70, 71: 70}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Lattice

def test_nearest_lattice_points():
    dice = np.random.default_rng(0)
    x = dice.standard_normal((200, 8)) * 2
    points = lattice.nearest(x)
    doubled = np.rint(points * 2)
    assert np.allclose(doubled, points * 2) and (points.sum(1) % 2 == 0).all()
    assert ((doubled % 2 == 0).all(1) | (doubled % 2 == 1).all(1)).all()
    own = ((x - points) ** 2).sum(1)
    for root in lattice.roots():  # no neighbour is nearer
        assert (own <= ((x - points - root) ** 2).sum(1) + 1e-9).all()
    assert len(lattice.roots()) == 240


def test_pairs_at_the_threshold_meet():
    dice = np.random.default_rng(1)
    x = lattice.unit_vectors(dice.standard_normal((2000, 64)))
    z = dice.standard_normal(x.shape)
    z = lattice.unit_vectors(z - (z * x).sum(1, keepdims=True) * x)
    mates = 0.95 * x + math.sqrt(1 - 0.95**2) * z
    a, b = (lattice.cells(v, 12, 4, 1.0, 3) for v in (x, mates))
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) > 0.995


@pytest.mark.parametrize("block", [2000, 7])
def test_near_vectors_equal_brute_force(spark, block):
    dice = np.random.default_rng(2)
    x = close_families(dice, 12, 10)
    rows = [(int(k), [float(v) for v in row], 0) for k, row in enumerate(x)]
    rows += [(500 + k, rows[3][1], 0) for k in range(5)]
    odd = [(600, None, 0), (601, [0.0] * 64, 0), (602, [float("nan")] + [1.0] * 63, 0), (603, [None] + [1.0] * 63, 0), (604, [float("inf")] * 64, 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links int")
    found = {r.vec_id: r for r in lattice.near_vectors(table, block=block).collect()}
    ids = np.array([r[0] for r in rows])
    u = lattice.unit_vectors(np.array([r[1] for r in rows]))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label, old = ids.copy(), None
    while old is None or (label != old).any():
        old = label
        label = np.minimum(label, np.where(near, label[None], 10**9).min(1))
    for i, links, comp in zip(ids.tolist(), near.sum(1), label):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (links, comp, i == comp)
    assert near.sum() > 100
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i in range(600, 605))
    assert lattice.near_vectors(table.limit(0)).count() == 0


# Packing

def test_configuration_fills_as_brute_force():
    dice = random.Random(6)
    for _ in range(60):
        sizes = sorted(dice.sample(range(5, 60), 4), reverse=True)
        left = [dice.randint(0, 3) for _ in sizes]
        chosen = grouping_pack.configuration(sizes, left, 100)
        every = [sum(c * s for c, s in zip(t, sizes)) for t in np.ndindex(*(n + 1 for n in left))]
        assert all(c <= n for c, n in zip(chosen, left))
        assert sum(c * s for c, s in zip(chosen, sizes)) == max(f for f in every if f <= 100)


@pytest.mark.parametrize("seed", range(6))
def test_packs_everything_near_the_bound(seed):
    dice = np.random.default_rng(seed)
    lengths = np.minimum(np.rint(np.exp(dice.normal(6, 1, 4000))).astype(int) + 1, 2048)
    counts = dict(Counter(lengths.tolist()))
    kinds = grouping_pack.pack(counts, 2048, 640)
    assert all(sum(s * c for s, c in inside) <= 2048 for _, inside in kinds)
    places = grouping_pack.Places(kinds)
    assert places.taken == counts and places.sequences <= 1.01 * math.ceil(lengths.sum() / 2048) + 1
    # The plan for many times the documents is hardly longer.
    assert len(grouping_pack.pack({s: 1000 * n for s, n in counts.items()}, 2048, 640)) < 2 * len(kinds) + 2000
    assert grouping_pack.pack({}, 2048, 640) == [] and grouping_pack.Places([]).sequences == 0


def test_chunk_ids_equal_the_library():
    chunks, library, dice = grouping_pack.ChunkIds(BYTES), Tokenizer.from_file(BYTES), random.Random(4)
    texts = ["", " a", "a ", "a  b", "a \n b", "a\n b", "<|endoftext|> x <|endoftext|>y", "don't we'll  ", "\n", "x\0 y", "é è\tç d", "x" * 3000, " "]
    texts += ["".join(dice.choices("ab '.,\n\t 1é漢!", k=dice.randint(0, 50))) for _ in range(2000)]
    for t, raw in zip(texts, chunks.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packed_documents(spark):
    dice, library = random.Random(1), Tokenizer.from_file(BYTES)
    texts = [" ".join(dice.choices(["alpha", "beta", "gamma,"], k=dice.randint(0, 300))) for _ in range(200)] + [None, "", "long " * 3000, "same", "same"]
    docs = spark.createDataFrame([(min(k, 203), t, "x") for k, t in enumerate(texts)], "doc_id long, text string, length string").repartition(3)
    rows = grouping_pack.packed(docs, BYTES, capacity=256).collect()
    want = Counter()
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        at, n = 0, 0
        while at < len(ids):
            size = (len(ids) - at) % 256 or 256
            want[min(k, 203), n, at, size, zlib.crc32(np.array(ids[at:at + size], "<u4").tobytes())] += 1
            at, n = at + size, n + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1.03 * math.ceil(sum(r.length for r in rows) / 256) + 1
    assert grouping_pack.packed(docs.limit(0), BYTES).count() == 0


# Neighbours

def test_neighbours_against_brute_force(spark):
    dice = np.random.default_rng(3)
    x = np.concatenate([close_families(dice, 20, 20, 16), dice.standard_normal((600, 16))])
    rows = [(int(k), [float(v) for v in row]) for k, row in enumerate(x)] + [(2000 + k, [float(v) for v in x[50]]) for k in range(40)]
    odd = [(5000, None), (5001, [0.0] * 16), (5100, [float("nan")] * 16), (None, rows[0][1])]
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, rank int")
    from pyspark.sql import functions as F

    found = hnsw.nearest_neighbours(table, F.col("vec_id") % 50 == 0, shard_rows=300).collect()
    ids, all_x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hit = total = 0
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {i for i in ids.tolist() if i % 50 == 0}
    for q, got in by.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 14))
        far = np.sqrt(((all_x - all_x[ids == q][0]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, far)) if ids[k] != q][:10]
        hit += len({g[1] for g in got} & set(ids[order].tolist()))
        total += 10
        for _, i, score in got:
            assert score == pytest.approx(far[ids == i][0], abs=1e-12)
    assert hit / total >= 0.97
    assert [g[1] for g in sorted(by[50])] == list(range(2000, 2010))  # equal vectors: the smallest ids first
    few = hnsw.nearest_neighbours(table.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3
    assert hnsw.nearest_neighbours(table.limit(0), F.lit(True)).count() == 0


# Language model

def small_vocabulary():
    words = [f"w{k}".encode() for k in range(40)]
    counts = np.array([30.0, *range(100, 60, -1)])
    return gru_lm.Vocabulary({w: i + 1 for i, w in enumerate(words)}, {b"ab": 0, b"cd": 1}, counts, 5000, 90, np.array([50.0, 20.0, 10.0]), np.array([9.0, 5.0, 3.0]))


def test_gradients_by_differences(monkeypatch):
    monkeypatch.setattr(gru_lm, "HIDDEN", 5)
    monkeypatch.setattr(gru_lm, "EMBED", 4)
    v = small_vocabulary()
    net = gru_lm.fresh(v)
    net = gru_lm.Network(*(a.astype(float) for a in net.arrays()))
    dice = random.Random(0)
    text = [dice.randrange(len(v.group)) for _ in range(12)] + [0]
    before = [a.copy() for a in net.arrays()]

    def loss(arrays):
        return -gru_lm.score_texts(gru_lm.Network(*arrays), v, [text])[0] / len(text)

    memory = {}
    gru_lm.train_windows(net, v, [[-1, *text]], memory, rate=0.0)
    for name, at in (("e", 0), ("w", 1), ("u", 2), ("b", 3), ("group_w", 4), ("group_b", 5), ("word_w", 6), ("word_b", 7)):
        grad = memory[name][0] * 10  # the first moment holds a tenth of the gradient
        for spot in np.argsort(-np.abs(grad).ravel())[:3]:
            up, down = [[a.copy() for a in before] for _ in range(2)]
            up[at].ravel()[spot] += 1e-3
            down[at].ravel()[spot] -= 1e-3
            assert grad.ravel()[spot] == pytest.approx((loss(up) - loss(down)) / 2e-3, rel=0.05, abs=2e-4), name


def test_probabilities_sum_to_one():
    v = small_vocabulary()
    net = gru_lm.fresh(v)
    total = 0.0
    for number in range(len(v.group)):
        p = gru_lm.score_texts(net, v, [[3, number]])[0] - gru_lm.score_texts(net, v, [[3]])[0]
        total += math.exp(p)  # every class of endings once, whatever its words
    assert total == pytest.approx(1, abs=1e-3)


def test_state_reaches_over_windows_and_lanes():
    v = small_vocabulary()
    net = gru_lm.fresh(v)
    dice = random.Random(3)
    texts = [[dice.randrange(len(v.group)) for _ in range(n)] + [0] for n in (0, 1, 70, 300, 5, 64)]
    alone = [gru_lm.score_texts(net, v, [t])[0] for t in texts]
    assert np.allclose(gru_lm.score_texts(net, v, texts, lanes=2), alone, rtol=1e-4)


def test_a_very_long_text_takes_no_more_room_than_its_tokens():
    v = small_vocabulary()
    net = gru_lm.fresh(v)
    texts = [[1, 2, 0]] * 600 + [[3] * 60_000 + [0]]
    tracemalloc.start()
    found = gru_lm.score_texts(net, v, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and found[0] == pytest.approx(gru_lm.score_texts(net, v, texts[:1])[0], rel=1e-4)


def test_long_words_are_named_by_a_digest():
    words = gru_lm.words_of("A " + "b" * 65 + " " + "c" * 64 + " " + "b" * 64 + "d")
    assert words[0] == b"a" and words[2] == b"c" * 64 and all(len(w) == 67 for w in (words[1], words[3]))
    assert words[1] != words[3] and words[3].endswith(b"bd") and gru_lm.words_of("B" * 65)[0] == words[1]


def test_words_of_many_texts_at_once():
    texts = [None, "", " ", "a", " a B  ", "x\x0by\x0cZ\x1cd\x85e\u3000f", "z" * 70 + " Z" + "z" * 69, "\n\n", *(f"a{chr(k)}B" for k in range(300))]
    names, codes, size = gru_lm.coded(pa.array(texts, pa.string()))
    assert size.tolist() == [len(gru_lm.words_of(t or "")) for t in texts]
    assert [names[k] for k in codes] == [w for t in texts for w in gru_lm.words_of(t or "")]
    v = small_vocabulary()
    flat, size, names, place = v.of_texts(pa.array(texts, pa.string()))
    assert flat.tolist() == [k for t in texts for k in v.numbers(gru_lm.words_of(t or ""))] and size.sum() == len(flat)
    assert [names[k] if k >= 0 else None for k in place] == [w for t in texts for w in [*gru_lm.words_of(t or ""), None]]


def test_every_token_is_learnt_once_in_its_text(monkeypatch):
    monkeypatch.setattr(gru_lm, "LANES", 4)
    dice, number = random.Random(5), iter(range(1, 10**6))
    texts = [[-1, *(next(number) for _ in range(n))] for n in [0, 1, 95, 96, 287, 288, 289, 5000, *(dice.randint(0, 400) for _ in range(60))]]
    found, last = [], {}
    for live, some in gru_lm.in_lanes(texts):
        for k, lane in zip(live, some):
            assert lane[0] in (-1, last.get(k))
            found += [pair for pair in zip(lane, lane[1:]) if pair[1] != -1]
            last[k] = lane[-1]
    assert sorted(found) == sorted(pair for t in texts for pair in zip(t, t[1:]))


def test_state_goes_on_where_a_text_is_cut():
    v = small_vocabulary()
    net = gru_lm.fresh(v)
    dice = random.Random(4)
    lanes = [[-1, *(dice.randrange(len(v.group)) for _ in range(99))] for _ in range(3)]
    whole = gru_lm.train_windows(net, v, lanes, {}, 0.0)
    half = gru_lm.train_windows(net, v, [x[:49] for x in lanes], {}, 0.0)
    assert np.allclose(gru_lm.train_windows(net, v, [x[48:] for x in lanes], {}, 0.0, half), whole, atol=1e-6)


def test_likelihoods(spark):
    dice = random.Random(7)
    lang = {"x": [f"ka{k}" for k in range(30)], "y": [f"blu{k}" for k in range(30)]}
    rows = [(k, " ".join(dice.choices(lang["xy"[k % 2]], k=dice.randint(5, 60)))) for k in range(400)]
    rows += [(901, None), (902, ""), (903, "UNSEEN Ka1 \t nowhere"), (903, "UNSEEN Ka1 \t nowhere"), (904, "ka1 " * 3000), (905, "z" * 200 + " " + "Z" * 200)]
    docs = spark.createDataFrame([(*r, 2.0) for r in rows], "doc_id long, text string, score double")
    from pyspark.sql import functions as F

    found = {r.doc_id: r for r in gru_lm.likelihoods(docs, F.col("doc_id") % 5 == 1).collect()}
    learnt = [gru_lm.words_of(t or "") for k, t in rows if k % 5 != 1]
    counts = Counter(w for t in learnt for w in t)
    tokens, distinct = sum(counts.values()) + len(learnt), len(counts) + 1
    mass = math.log10(tokens + 0.5 * (distinct + 1))
    for k, t in rows:
        words = gru_lm.words_of(t or "")
        base = sum(math.log10(counts[w] + 0.5) - mass for w in words) + math.log10(len(learnt) + 0.5) - mass
        r = found[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words) + 1, 1 + sum(w in counts for w in words), tokens, k % 5 == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in found.values() if r.held_out and r.doc_id < 900]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert gru_lm.likelihoods(docs.limit(0), F.lit(False)).count() == 0


# Pipeline

def test_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline
    from .test_text_operators import brute_components, brute_fingerprint, prose

    dice, docs, labels = random.Random(12), [], []
    for k in range(240):
        text, bad = prose(dice, "xyz"[k % 3], dice.randint(30, 120)), k % 4 == 0
        docs.append((k, text.replace(" ", "!! ").upper() if bad else text, "xyz"[k % 3], "s", len(text)))
        if k % 3 == 0 or k % 8 == 0:
            labels.append((k, int(not bad), 0))
    docs += [(300 + k, docs[k][1], "x", "s", 1) for k in range(40)]
    docs += [(400, "1234 5678", "x", "s", 9), (401, None, None, None, None), (402, "", "y", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = common.table(spark, str(tmp_path), "documents")
    good = common.stored(corpus_pipeline.quality(spark, table, str(tmp_path)), "q")
    model = ordinal.train(table, ordinal.graded(common.table(spark, str(tmp_path), "labels")), 3)
    tail = {r.doc_id: r.tail_probability for r in ordinal.grade_documents(table, model, 2).collect()}
    assert good.columns == table.columns and {r.doc_id for r in good.collect()} == {k for k, p in tail.items() if p >= ordinal.LEAST}
    clean = [k for k in range(240) if k % 4]
    assert np.mean([tail[k] >= ordinal.LEAST for k in clean]) > 0.95 and max(tail[k] for k in range(0, 240, 4)) < ordinal.LEAST
    told = common.stored(corpus_pipeline.language(spark, table, str(tmp_path)), "l")
    gone = {r.doc_id for r in table.collect()} - {r.doc_id for r in told.collect()}
    assert {400, 401, 402} <= gone and len(gone) < 8
    single = common.stored(corpus_pipeline.near_duplicates(spark, told, str(tmp_path)), "s")
    comp = brute_components({r.doc_id: brute_fingerprint(r.text) for r in told.collect()})
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(comp.values()))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 2048
    assert {r.doc_id for r in rows} <= {r.doc_id for r in single.collect()}


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline

    rows = [(1, "a b c d", "m"), (1, "a b c d", "k"), (1, "a b c d", "k"), (2, "A b c d", "m"), (3, "other words here", None),
            (None, "a b c d", "m"), (None, "no id", "m"), (4, None, None), (5, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").withColumns({"row": F.lit(0), "fp": F.lit("c"), "component_id": F.lit(9)})
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n) for r in kept.collect()), key=str) == sorted(
        [(1, "a b c d", "k"), (3, "other words here", None), (None, "a b c d", "m"), (None, "no id", "m"), (4, None, None)], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_queries_are_named_after_their_operators():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
