"""HTML extraction, chat windows, quality grades, language codes, piece table and SimHash on small tables."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from stratalens.llm import chat_windows, ecoc, ordinal, path_ratios, piece_table, simhash

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SYLLABLES = {"x": "ka to mi ren sul vor".split(), "y": "ble fro gni sch tzu wei".split(), "z": "qua ossa lente rio zza pie".split()}


def prose(dice, language, words):
    return " ".join("".join(dice.choices(SYLLABLES[language], k=dice.randint(1, 3))) for _ in range(words)).capitalize() + "."


# Pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class=home><div id="header"><a href=/>Site</a></div>
<ul class="menu"><li><a>Home<li><a>News</ul><div class="cookie-notice">We use cookies. Accept, please.</div>
<div id=content><h1>Title &amp; more</h1><p>First paragraph of the text, with <a href=x>a link</a> and   space.<p>Second one: short.
<blockquote><p>Quoted words here, yes.</p></blockquote><div class="advert"><p>Buy this now, it is great. Really great, buy it now.</p></div></div>
<section id="comments"><p>Nice article, I like it a lot, thanks. More words here.</p></section><footer>(c) me. All rights, reserved.</footer>
<script>if (a<b) {"</p>"}</script></body></html>"""


ARTICLE = "Title & more\nFirst paragraph of the text, with a link and space.\nSecond one: short.\nQuoted words here, yes."


def test_main_text_without_what_surrounds_it():
    assert path_ratios.main_text(PAGE) == ARTICLE


@pytest.mark.parametrize("source, text", [
    ("plain &lt;b&gt; text", "plain <b> text"), ("<p>", ""), ("   ", ""), ("<article><p>a<br>b</p><p>c</article>", "a b\nc"),
    ("<p>open <b>bold<p>next</b> one", "open bold\nnext one"), ("<div>a < b & c</div>", "a < b & c"), ("<!-- never closed <p>x</p>", ""),
])
def test_odd_pages(source, text):
    assert path_ratios.main_text(source) == text


PROSE = "<p>A long paragraph of the article, with words, marks and more words.</p><p>Another one follows it, as long as the first one was, or so.</p>"


@pytest.mark.parametrize("inside", ["<h2><a href=x>Title</a></h2>", "<p><a href=x>One link only</a></p>", "<ol><li><a href=x>First source</a><li><a href=y>Second source</a></ol>"])
def test_linked_blocks_of_the_article_stay(inside):
    lines = path_ratios.main_text(f"<body><nav><a href=/>Home</a></nav><article>{PROSE}{inside}{PROSE}</article></body>").split("\n")
    assert len(lines) == 4 + inside.count("<a ") and "Home" not in lines


def test_linked_heading_and_paragraph_without_article():
    lines = path_ratios.main_text(f"<body><div class=c><h2><a href=x>Title</a></h2>{PROSE}<p><a href=y>One link only</a></p>{PROSE}</div></body>").split("\n")
    assert lines[0] == "Title" and "One link only" in lines and len(lines) == 6


@pytest.mark.parametrize("name", ["layout with-sidebar", "has-sidebar", "page-header-layout"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrapper_with_the_name_of_an_aside_holds_the_article(name, tag):
    aside = "<div class=sidebar><p>Some other words, short.</p></div>"
    page = f"<body><p>Top.</p><div class='{name}'><{tag}>{PROSE}{PROSE}</{tag}>{aside}</div><p>End.</p></body>"
    lines = path_ratios.main_text(page).split("\n")
    assert sum("paragraph of the article" in x for x in lines) == 2 and not any("other words" in x for x in lines)


def test_long_comments_do_not_become_the_article():
    page = f"<body><div id=content>{PROSE}</div><div id=comments>{'<p>I like it, yes, I do like it a lot, really.</p>' * 30}</div></body>"
    assert "like it" not in path_ratios.main_text(page) and "long paragraph" in path_ratios.main_text(page)


@pytest.mark.parametrize("opens, closes", [("<div>" * 320, "</div>" * 320), ("<font>" * 320, ""), ("<div><b>" * 200, "</div>" * 200)])
def test_deep_elements_are_told_like_others(opens, closes):
    page = f"<body><article><p>Before, the start.</p>{opens}<section><p>Deep text, still here.</p><nav>Menu</nav><section><p>Inner.</p></section>"
    page += f"<div class=advert><div>Buy now.</div></div>Tail.</section>{closes}<p>After, the end.</p></article><p>Outside.</p></body>"
    assert path_ratios.main_text(page) == "Before, the start.\nDeep text, still here.\nInner.\nTail.\nAfter, the end."


def test_long_and_hostile_pages_end():
    assert path_ratios.main_text("<div>" * 50_000 + "x") == "x"
    assert path_ratios.main_text("<a b='" * 20_000) != "x"
    assert len(path_ratios.main_text("<p>" + "long words. " * 100_000)) > 1_000_000


def test_extract_keeps_every_row(spark):
    rows = [(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, 9), (None, "v", "", 9), (3, "w", "<p>x", 9)]
    found = path_ratios.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in found) == sorted([(0, 0), (1, len(ARTICLE)), (1, len(ARTICLE)), (2, 0), (3, 1)])
    assert all(r.n_chars == len(r.text) for r in found)


# Conversations

@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", r"<\s> <\\/s> [\INST]", "<s", "", "a<s><s>b", "[[INST]]"])
def test_escape_is_reversible_and_leaves_no_control_string(text):
    assert chat_windows.unescape(chat_windows.escape(text)) == text
    assert not re.search(r"</?s>|\[/?INST\]", chat_windows.escape(text))


def brute_digests(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_windows_read_back(spark):
    dice, rows = random.Random(5), []
    for conv in [None, -1, 1, 2, 3, 4]:
        if conv != 1:
            rows.append((conv, 0, "system", "Be brief </s>."))
        for turn in range(1, 700 if conv == 4 else 25):
            rows.append((conv, turn, dice.choice(["user", "assistant"]), prose(dice, "x", dice.randint(0, 60))))
    rows += [(2, 7, "assistant", None), (2, 7, None, "[INST]"), (2, None, "user", ""), (3, 9, "assistant", "ok"), (3, 9, "assistant", "ok")]
    rows.append((3, 99, "assistant", "long " * 4000))
    turns = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat_windows.chat_windows(turns, budget=256, history=64).collect()
    assert all(w.n_tokens <= 256 or w.over_budget for w in windows)
    assert sum(w.over_budget for w in windows) < 20
    assert any(w.n_repeated > 1 for w in windows)
    for w in windows:
        roles = [r for r, _ in chat_windows.parse(w.formatted)]
        assert len(roles) == w.n_turns
        if w.conv_id in (-1, 4) or w.conv_id is None:
            assert roles[0] == "system"
    found = chat_windows.conversation_digests(chat_windows.chat_windows(turns, budget=256, history=64)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == brute_digests(rows)
    assert chat_windows.chat_windows(turns.limit(0)).count() == 0


def test_repeated_turns_directly_precede_the_new_ones(spark):
    dice, rows = random.Random(6), []
    for conv in range(6):
        if conv % 2:
            rows.append((conv, 0, "system", "S" * 40 * conv))
        rows += [(conv, k, dice.choice(["user", "assistant"]), f"{conv}-{k} " + "w" * dice.choice([0, 30, 120, 300, 2000])) for k in range(1, 120)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cost = lambda text: -(-len(text) // 4) + 5
    told = {conv: [r for r in rows if r[0] == conv] for conv in range(6)}
    repeated = 0
    for w in chat_windows.chat_windows(turns, budget=512, history=100).collect():
        shown = [t for _, t in chat_windows.parse(w.formatted)]
        mine = [r[3] for r in told[w.conv_id]]
        system = told[w.conv_id][0][2] == "system"
        if w.window and system:
            assert shown[0] == mine[0]
            shown = shown[1:]
        at = mine.index(shown[0])
        assert shown == mine[at:at + len(shown)]  # no hole
        if w.window:
            repeats = w.n_repeated - system  # the system turn is told apart
            first = at + repeats
            size = lambda k: sum(map(cost, mine[k:first]))
            assert size(at) <= 100 and (at == int(system) or size(at - 1) > 100)
            repeated += repeats
    assert repeated > 50


def test_a_system_turn_over_the_budget_is_not_multiplied(spark):
    rows = [(1, 0, "system", "s" * 20_000)] + [(1, k, "user", "u" * 50) for k in range(1, 201)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_windows.chat_windows(turns).collect()
    assert all(w.over_budget for w in windows) and sum(len(w.formatted) for w in windows) < 6 * sum(len(r[3]) for r in rows)


# Quality

def test_ordinal_grades(spark):
    dice = random.Random(3)
    docs, grades = [], []
    for k in range(300):
        text, grade = prose(dice, dice.choice("xyz"), dice.randint(20, 200)), k % 3
        if grade == 0:
            text = re.sub(" ", "!! ", text.upper())
        if grade == 1:
            words = text.split()
            words.insert(dice.randrange(len(words)), dice.choice(["scoundrel", "nitwit"]))
            text = " ".join(words)
        docs.append((k, text, "clash"))
        grades.append((k, grade))
    docs += [(1000, None, "clash"), (1001, "", "clash"), (1002, "word " * 50_000, "clash"), (1002, "word " * 50_000, "clash")]
    d = spark.createDataFrame(docs, "doc_id long, text string, expected_grade string")
    r = spark.createDataFrame(grades + [(5000, None), (None, 1), (7, 9)], "doc_id long, grade int")
    model = ordinal.train(d, r.where("doc_id % 5 <> 0 or doc_id is null"), 3)
    assert (np.diff(model[1]) >= 0).all()
    found = {x.doc_id: x for x in ordinal.grade_documents(d, model, 2).collect()}
    held = [(found[k], g) for k, g in grades if k % 5 == 0]
    assert np.mean([round(x.expected_grade) == g for x, g in held]) > 0.9
    assert found[1000].tail_probability == found[1001].tail_probability
    kept = ordinal.select_documents(d, model, 2)
    assert kept.columns == d.columns and kept.where("doc_id = 1002").count() in (0, 2)
    assert {x.doc_id for x in kept.collect()} == {k for k, x in found.items() if x.tail_probability >= ordinal.LEAST}
    none = ordinal.train(d, r.limit(0), 3)
    assert none is None and ordinal.select_documents(d, none, 2).count() == d.count()
    assert ordinal.grade_documents(d.limit(0), model, 2).count() == 0


# Language

def test_codewords_stay_apart():
    for n in (2, 3, 4, 5, 12):
        code = ecoc.codewords(n)
        far = (code[:, None] != code[None]).sum(2) + np.eye(n) * 99
        assert far.min() >= (1 if n == 2 else 2) and (np.abs(code.sum(0)) < n).all()


def test_languages_of_held_out_texts(spark):
    dice = random.Random(9)
    rows = [(k, prose(dice, lang, dice.randint(5, 80)), lang) for k, lang in enumerate("xyzxyyxz" * 40)]
    extra = [(900, None, "x"), (901, "12 !!", "x"), (902, "", None), (903, prose(dice, "y", 30_000), None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + extra], "doc_id long, text string, lang string, score double")
    model = ecoc.train(docs.where("doc_id % 4 <> 2"))
    found = {r.doc_id: r for r in ecoc.identify(docs, model).collect()}
    assert np.mean([found[k].lang_pred == lang for k, _, lang in rows if k % 4 == 2]) > 0.97
    assert [found[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "y"]
    assert all(0 <= r.score <= 1 for r in found.values()) and found[900].ambiguous
    kept = ecoc.select_documents(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (900, 901, 902)").count() == 0
    assert ecoc.train(docs.limit(0)) is None
    assert {r.lang_pred for r in ecoc.identify(docs, None).collect()} == {"und"}
    one = ecoc.train(docs.where("lang = 'x'"))
    assert {r.lang_pred for r in ecoc.identify(docs.where("doc_id < 9"), one).collect()} == {"x"}


# Pieces

def test_piece_table_equals_the_library():
    table, library = piece_table.PieceTable(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    dice = random.Random(1)
    letters = " ▁▁  \n\tabcdeéñ漢字😀\x00thheintioner"
    texts = ["".join(dice.choices(letters, k=dice.randint(0, 40))) for _ in range(3000)]
    texts += ["<s>", "</s> <0x41>", "<unk>", "a" * 5000, "漢" * 300, "", " ", "  x  ", "the " * 3000]
    for t in texts:
        assert table.encode(t) == library.encode(t), t


def test_piece_columns(spark):
    docs = spark.createDataFrame([(1, "Hello there", 5), (1, "Hello there", 5), (2, None, 5), (3, "", 5), (None, "x", 5)], "doc_id long, text string, ids int")
    ids = piece_table.encode_documents(docs, PIECES)
    assert ids.columns == ["doc_id", "ids"] and ids.count() == 5
    back = piece_table.decode_documents(ids, PIECES).collect()
    assert sorted(r.text for r in back) == ["", "", "Hello there", "Hello there", "x"]
    digests = {r.doc_id: r for r in piece_table.encode_digests(docs, PIECES).collect()}
    assert digests[2].n_tokens == 0 and digests[2].ids_sha256 == digests[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()


# SimHash

def brute_fingerprint(text):
    upper = {c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans(upper)))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = dict(fps)
    ids = sorted(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min(comp[j] for j in ids if bin(label[i] ^ label[j]).count("1") <= 2)
            changed |= low != comp[i]
            comp[i] = low
    return comp


def test_allocation_is_the_cheapest_of_its_sum():
    dice = random.Random(2)
    costs = [[0.0, *sorted(dice.random() for _ in range(3))] for _ in range(4)]
    cost, chosen = simhash.allocate(costs, -1)
    every = [t for t in np.ndindex(4, 4, 4, 4) if sum(t) - 4 == -1]
    assert sum(chosen) == -1 and cost == pytest.approx(min(sum(costs[i][k] for i, k in enumerate(t)) for t in every))


def test_plan_misses_no_pair():
    dice = np.random.default_rng(4)
    sample = dice.integers(0, 2**63, 300).astype(np.uint64)
    for distance in (1, 2, 3):
        parts = simhash.plan(sample, 10**7, distance)
        for _ in range(300):
            flips = dice.choice(64, distance, replace=False).tolist()
            assert any(len(set(flips) & set(p.bits)) <= p.threshold for p in parts)


@pytest.mark.parametrize("block", [4096, 6])
def test_near_duplicates_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (2, block))
    dice, texts = random.Random(8), {}
    for k in range(60):
        texts[k] = prose(dice, "xyz"[k % 3], dice.randint(1, 400))
    for k in range(60, 140):
        words = texts[k % 7].split()
        for _ in range(dice.randint(0, 2)):
            words[dice.randrange(len(words))] = "other"
        texts[k] = " ".join(words)
    texts |= {200: None, 201: "", 202: " \t ", 203: "One", 204: "one", 205: "A b"}
    docs = spark.createDataFrame([(k, t, "c") for k, t in texts.items()] + [(205, "A b", "c"), (None, "One", "c")], "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs).collect()
    fps = {k: brute_fingerprint(t) for k, t in texts.items()}
    comp = brute_components(fps)
    assert len(found) == len(texts) + 2
    for r in found:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], comp[r.doc_id])
    assert next(r for r in found if r.doc_id is None).component_id == comp[203]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def brute_copies(texts, least=0.8):
    """Components of fingerprints two bits or fewer apart and of texts that share 0.8 of their five-word shingles."""
    ids, comp = sorted(texts), {i: i for i in texts}
    fps, sets = {i: brute_fingerprint(t) for i, t in texts.items()}, {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = {i: [j for j in ids if (fps[i] ^ fps[j]).bit_count() <= 2 or sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])] for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min(comp[j] for j in near[i])
            changed |= low != comp[i]
            comp[i] = low
    return comp


@pytest.mark.parametrize("paired", [1000, 4])
def test_near_copies_equal_brute_force(spark, paired):
    dice, texts = random.Random(21), {}
    for k in range(40):
        texts[k] = prose(dice, "xyz"[k % 3], dice.randint(40, 300))
    for k in range(40, 160):  # copies with more and more changes, on both sides of the threshold
        words = texts[k % 5].split()
        for _ in range(dice.randint(0, max(1, len(words) // 25))):
            words[dice.randrange(len(words))] = dice.choice(["other", "word", "here"])
        texts[k] = " ".join(words)
    texts |= {200: None, 201: "", 202: " \n", 203: "One two", 204: "one  TWO", 205: "one three"}
    docs = spark.createDataFrame([(k, t, "c") for k, t in texts.items()] + [(205, "one three", "c"), (None, "One two", "c")], "doc_id long, text string, same string")
    found = simhash.near_copies(docs, paired=paired).collect()
    comp = brute_copies(texts)
    assert len(set(comp.values())) < 120 and len(found) == len(texts) + 2
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == comp
    assert next(r for r in found if r.doc_id is None).component_id == 203
    assert simhash.near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["appended", "prepended", "removed"])
def test_stage_finds_copies_with_a_passage_more_or_less(spark, kind):
    import corpus_pipeline

    dice, texts = random.Random(31), {}
    for k in range(40):
        a = prose(dice, "xyz"[k % 3], dice.randint(150, 500)).split()
        more = prose(dice, "xyz"[(k + 1) % 3], int(len(a) * dice.uniform(0.16, 0.23))).split()
        b = {"appended": a + more, "prepended": more + a, "removed": a[:100] + a[100 + len(more) * 4 // 5:]}[kind]
        texts[2 * k], texts[2 * k + 1] = " ".join(a), " ".join(b)
    comp = brute_copies(texts)
    assert sum(comp[2 * k + 1] == 2 * k for k in range(40)) > 30
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(comp.values()))


def test_texts_far_from_the_middle_of_a_family_are_linked_to_each_other(spark):
    dice = random.Random(5)
    text, texts = prose(dice, "x", 300).split(), {}
    for k in range(60):  # most are near the original, some near one another only
        own = prose(random.Random(k % 10), "y", 60).split() if k < 20 else []
        texts[k] = " ".join([*text[:250 + k // 10], *own, *prose(random.Random(100 + k), "z", 6).split()])
    comp = brute_copies(texts)
    assert 3 < len(set(comp.values())) < 30
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs, paired=25).collect()} == comp
