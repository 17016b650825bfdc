"""Hash tree and its bitmaps, and the rotation of middles, against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalens.llm import bitmaps, fill_middle, merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Bitmaps

DENSE = st.tuples(st.integers(0, 60_000), st.integers(1, 5_000)).map(lambda x: list(range(x[0], x[0] + x[1])))
SOME = st.lists(st.one_of(st.integers(0, 65_535), st.sampled_from([0, 1, 63, 64, 65, 65_535])), min_size=1, max_size=300)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(DENSE, SOME), min_size=1, max_size=3), st.booleans())
def test_rank_counts_all_smaller_members(parts, scattered):
    if scattered:
        parts = [*parts, np.random.default_rng(len(parts)).integers(0, 65_536, 30_000).tolist()]
    pack = lambda values: bitmaps.packed(*np.unique(values, return_counts=True))
    found = bitmaps.Ranks(bitmaps.merged([pack(p) for p in parts]))
    every = np.sort(np.concatenate(parts))
    asked = np.r_[every[:: max(1, len(every) // 500)], 0, 65_535, 777, 64]
    assert len(found) == len(every)
    assert found.rank(asked).tolist() == np.searchsorted(every, asked).tolist()
    names, times = np.unique(every, return_counts=True)
    assert [x.tolist() for x in found.members()] == [names.tolist(), times.tolist()]
    assert found.repeats(asked).tolist() == np.isin(asked, names[times > 1]).tolist()


def test_each_form_is_used_where_it_is_smallest():
    dice = np.random.default_rng(1)
    forms = [bitmaps.packed(np.unique(x), np.ones(len(np.unique(x)), int))[0] for x in (
        np.arange(9, 60_000), dice.integers(0, 65_536, 500), dice.integers(0, 65_536, 40_000))]
    assert forms == [1, 0, 2]


# Hash tree

def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[k:k + 8])) for k in range(0, len(below), 8)])
    return levels


def path(levels, at):
    for level in levels[:-1]:
        run = level[at & -8:(at & -8) + 8]
        yield at % 8, run[:at % 8] + run[at % 8 + 1:]
        at //= 8


def plain_manifest(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for row in rows:
        other = row
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
            other = (*row[:4], row[4].translate(small))
        leaf, claimed = (sha("".join(map(field, r))) for r in (row, other))
        groups.setdefault(row[2], []).append(((row[0] is not None, row[0] or 0), leaf, claimed))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf for _, leaf, _ in sorted(groups[g])]) for g in names}
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, ((there, number), leaf, own) in enumerate(sorted(groups[g])):
            steps = [*path(trees[g], at), *path(top, k)]
            for place, others in steps:
                own = sha("".join([*others[:place], own, *others[place:]]))
            proof = sha("".join("".join(others) for _, others in steps))
            out.append((number if there else None, leaf, trees[g][-1][0], top[-1][0], proof, own, own == top[-1][0]))
    return out


def shown_manifest(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars int, text string, leaf string, at int")
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, small).otherwise(F.col("text"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tree = merkle.grown(docs.repartition(3), merkle.leaf_of(*fields, F.col("text")), merkle.leaf_of(*fields, shown), **options)
    found = merkle.proofs(tree)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in found.collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def rows_for(dice, n):
    rows = []
    for _ in range(n):
        doc = dice.choice([dice.randint(-200, 200), dice.randint(-2**63, 2**63 - 1), dice.randint(60_000, 70_000), None])
        text = dice.choice([None, "", "Upper Case", "é€ lower", "ÀB" * dice.randint(1, 50)])
        rows.append((doc, dice.choice([None, "", "web"]), dice.choice([None, "", "en", "de", "é", "zz"]), dice.choice([None, 0, 7]), text))
    return rows


@pytest.mark.parametrize("levels", [2, 5])
def test_manifest_equals_the_plain_tree(spark, levels):
    rows = rows_for(random.Random(levels), 200)
    rows += rows[:40] + [(5, "s", "en", 1, f"V{k}") for k in range(90)] + [(5, "s", "en", 1, "V1")] * 70 + [(None, None, None, None, None)] * 30
    rows += [(1, "w", "only", 3, "Lone"), (10**6, "w", "de", 3, "Long " * 200_000)]
    same(shown_manifest(spark, rows, levels=levels), plain_manifest(rows))


def test_group_of_several_blocks(spark):
    rows = [(k * 3 % 40_000, "s", "en", k, f"T{k}") for k in range(40_000)] + [(k, "s", f"l{k}", 1, "") for k in range(70)]
    same(shown_manifest(spark, rows), plain_manifest(rows))


def test_one_id_in_most_rows(spark):
    rows = [(70_000, "s", "en", k % 9_000, "Text") for k in range(150_000)] + [(k, "s", "en", 1, "x") for k in range(69_990, 70_010)]
    same(shown_manifest(spark, rows), plain_manifest(rows))


def test_manifest_of_one_row_and_none(spark):
    one = [(3, None, None, None, "A")]
    same(shown_manifest(spark, one), plain_manifest(one))
    assert shown_manifest(spark, one)[0][4] == sha("")
    empty = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars int, text string")
    assert merkle.manifest(empty).collect() == []


# Fill in the middle

def plain_output(text, key):
    digits = sha(f"1:{'' if key is None else key}")
    h = [int(digits[k:k + 8], 16) for k in range(0, 32, 8)]
    if not text or h[2] % 100 >= 90 or any(s in text for s in ("<P>", "<S>", "<M>")):
        return text, "plain", None, None
    a, b = sorted(x % (len(text) + 1) for x in h[:2])
    p, s, m = "<P>" + text[:a], "<S>" + text[b:], "<M>" + text[a:b]
    return (s + p + m, "spm", a, b - a) if h[3] % 100 < 20 else (p + s + m, "psm", a, b - a)


@settings(max_examples=300, deadline=None)
@given(st.text("ab<>PSM é€😀", max_size=30), st.integers(0, 99), st.integers(0, 99), st.sampled_from(["psm", "spm"]))
def test_rotation_and_its_way_back(text, x, y, form):
    if any(s in text for s in fill_middle.SENTINELS):
        return
    a, b = sorted((x % (len(text) + 1), y % (len(text) + 1)))
    raw, strings = text.encode(), fill_middle.checked(fill_middle.SENTINELS)
    n, (first, second) = fill_middle.offsets_of(raw, [a, b])
    assert n == len(text) == fill_middle.length_of(raw)
    out = fill_middle.rearranged(raw, first, second, form, strings)
    p, s, m = "<P>" + text[:a], "<S>" + text[b:], "<M>" + text[a:b]
    assert out.decode() == (p + s + m if form == "psm" else s + p + m)
    assert fill_middle.rebuilt(out, form, strings) == raw


@pytest.mark.parametrize("bad", [("a", "a", "b"), ("", "x", "y"), ("<aa", "<ab<", "x"), ("xy", "yx", "z"), ("<P", "<P>", "<M>")])
def test_sentinels_that_could_arise_by_chance_are_refused(bad):
    with pytest.raises(ValueError):
        fill_middle.checked(bad)


def test_documents_there_and_back(spark):
    dice = random.Random(4)
    texts = ["".join(dice.choices("ab <>PSMéñ漢😀\n", k=dice.randint(0, 60))) for _ in range(500)]
    texts += [None, "", "x", "has <M> inside", "é" * 1_500_000, "a" * 3_000_000]
    rows = [(k, t) for k, t in enumerate(texts)] * 2 + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, output string, n int")
    moved = fill_middle.transform(docs)
    assert moved.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = fill_middle.restore(moved).collect()
    want = [(key, len(t or ""), form, a, m, out, t or "") for key, t in rows for out, form, a, m in [plain_output(t or "", key)]]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.transform(docs.limit(0))).collect() == []
    none = spark.createDataFrame([(1, None, "psm"), (2, "x", None), (3, "x", "plain")], "doc_id long, output string, form string")
    assert {r.doc_id: r.restored for r in fill_middle.restore(none).collect()} == {1: None, 2: None, 3: "x"}


def test_other_sentinels_and_shares(spark):
    marks = ("⟦prefix⟧", "⟦suffix⟧", "⟦middle⟧")
    docs = spark.createDataFrame([(k, f"text <P> number {k}") for k in range(200)], "key long, body string")
    with pytest.raises(ValueError):
        fill_middle.transform(docs, ("[a", "[b", "c["), id_col="key", text_col="body")
    moved = fill_middle.transform(docs, marks, plain=0, suffix_first=100, seed="other", id_col="key", text_col="body")
    rows = fill_middle.restore(moved, marks).collect()
    assert all(r.form == "spm" and r.output.startswith("⟦suffix⟧") and r.restored == f"text <P> number {r.key}" for r in rows)
