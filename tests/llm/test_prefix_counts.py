"""Token counts at every prefix against the library, which encodes each prefix anew."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratalens.llm import prefix_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", " ", "  ", "\n", "\t", "　", "\xa0", "\x1c", "a", "the", "ing", "'re", "'s", "'ll", "'ve", "'", "l", "r", "1", "23", "!", "..", "é", "漢",
         "😀", "<|endoftext|>", "<|endof", "|>", "Tion", " don't", "ʼ", "́", "²", "\0", "Ⅷ", "ǅ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def counter():
    return prefix_counts.PrefixCounter(FILE)


def size(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_has_the_count_of_its_encoding(library, counter):
    dice = random.Random(8)
    texts = ["".join(dice.choices(PARTS, k=dice.randint(0, 9))) for _ in range(2500)]
    for text in texts:
        assert counter.counts(text).tolist() == [size(library, text[:k]) for k in range(len(text) + 1)], text


def test_texts_together_and_alone_agree(library, counter):
    dice = random.Random(9)
    syllables = "th er on an re in ou he at es ti tion ing é ß ñ , . \n 7".split(" ")
    texts = [" ".join("".join(dice.choices(syllables, k=dice.randint(1, 9))) for _ in range(dice.randint(0, 200))) for _ in range(150)]
    texts += ["a" * 3000, "漢" * 500, "=" * 700 + "x", "x" * 65, "", "the " * 2000, "a\n\n\nb  c\t\td ", "<|endoftext|>" * 3 + " <|endoftext|"]
    fresh = prefix_counts.PrefixCounter(FILE)
    for text, together in zip(texts, fresh.changes(texts)):
        assert int(together.sum()) == size(library, text)
        assert together.tolist() == counter.changes([text])[0].tolist()


def test_compatible_tokens_are_those_that_encode_as_themselves(library, counter):
    dice, tokens = random.Random(10), [t for t in counter.number if len(t) < 12]
    for _ in range(4000):
        a, b = dice.choice(tokens), dice.choice(tokens)
        if dice.random() < 0.5:  # many borders that lie inside a longer token
            c = dice.choice([t for t in dice.sample(tokens, 50) if len(t) > 2])
            k = dice.randint(1, len(c) - 1)
            a, b = c[:k], c[k:]
            if a not in counter.number or b not in counter.number:
                continue
        parts = [t.value for t in library.model.tokenize(a + b)]
        assert counter.compatible(counter.number[a], counter.number[b]) == (parts == [a, b]), (a, b)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(prefix_counts, "KEPT_CHUNKS", 20)
    monkeypatch.setattr(prefix_counts, "KEPT_WORDS", 20)
    monkeypatch.setattr(prefix_counts, "KEPT_PAIRS", 20)
    small, dice = prefix_counts.PrefixCounter(FILE), random.Random(11)
    for _ in range(100):
        text = " ".join("".join(dice.choices("abthein", k=dice.randint(1, 9))) for _ in range(30))
        assert int(small.changes([text])[0].sum()) == size(library, text)


def test_questions_about_prefixes(library, counter):
    text = "Internationalization of words, don't   stop.\n" * 5
    found = prefix_counts.Prefixes(counter.changes([text])[0].tobytes())
    every = [size(library, text[:k]) for k in range(len(text) + 1)]
    assert len(found) == every[-1] and [found.tokens(k) for k in (-3, 0, 7, 10**9)] == [0, 0, every[7], every[-1]]
    for budget in (-1, 0, 1, 5, 17, 10**6):
        assert found.within(budget) == max(k for k, n in enumerate(every) if n <= max(budget, 0))


def test_columns(spark, library):
    texts = ["Hello there", None, "", "<|endoftext|> x", "word " * 1025, "é" * 300_000]
    rows = [(k, t, True, 5) for k, t in enumerate(texts)] + [(0, texts[0], True, 5), (None, "x y", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, over_limit boolean, n_tokens int")
    found = prefix_counts.token_counts(docs, FILE, limit=1024)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r[0], len((r[1] or "").encode()), n := size(library, r[1] or ""), n > 1024) for r in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    cut = {(r.doc_id, r.text) for r in prefix_counts.truncated(docs, FILE, 2).collect()}
    assert cut == {(0, "Hello there"), (1, ""), (2, ""), (3, "<|endoftext|> x"), (4, "word word"), (5, "éé"), (None, "x y")}
    asked = prefix_counts.answered(prefix_counts.prefix_table(docs, FILE), budgets=[0, 3], places=[5, 10**8]).collect()
    by = {r.doc_id: r for r in asked}
    assert by[4].tokens_at == {5: size(library, "word "), 10**8: size(library, texts[4])} and by[1].chars_within == {0: 0, 3: 0}
    assert by[5].chars_within[3] == 3 and len(asked) == len(rows)
    for empty in (prefix_counts.token_counts(docs.limit(0), FILE, 9), prefix_counts.truncated(docs.limit(0), FILE, 9)):
        assert empty.collect() == []


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        prefix_counts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
    assert np.array(prefix_counts.Prefixes(b"").count).tolist() == [0]
