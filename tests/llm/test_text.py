"""Text operators against brute force, exact round trips, held-out accuracy, and odd inputs."""

import hashlib
import html
import itertools
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidescore.llm import chat, html_extract, language_id, license_scan, mixing, quality_classifier, quality_rules, sentencepiece_bpe
from tidescore.llm.queries import model_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, None, None, 0), (None, "", "en", "a", 0), (2, " \t\n", "de", "b", 3), (2, " \t\n", "de", "b", 3), (3, "1234 !!", None, "a", 7), (4, "x" * 200_000, "en", None, 9), (5, "\x00\u2581 \u2581\u2581 a\U0001f600\n\n", "en", "", 1)]


def odd_documents(spark):
    """Nulls, empty, blank, repeated and long rows, and columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "clash", 1) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, score string, size int")


def odd_labels(spark):
    return spark.createDataFrame([(2, 1, 0), (2, 0, 0), (None, 1, None), (5, None, 1)], "doc_id long, quality int, toxic int")


# chat


@given(st.lists(st.tuples(st.text(), st.text(alphabet=st.sampled_from("\\<>/turn :image0\n")) | st.text())))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(turns):
    made = chat.Formatter()
    for role, text in turns:
        made.add(role, [{"type": "text", "text": text}])
    out = made.result()
    assert chat.read_back(out["formatted"]) == turns
    assert [chat.unescape(out["formatted"][a:b]) for a, b in out["spans"]] == [t for r, t in turns if r == "assistant"]


def test_chat_parts_and_edges(spark):
    parts = '[{"type":"text","text":"see <image:0>"},{"type":"image","ref":"a.png","width":28,"height":29},{"type":"audio","ref":"b.wav","seconds":1.5},{"type":"document","ref":"c.pdf","pages":2},{"type":"text","text":"ok"}]'
    rows = [(1, 0, "user", None, parts), (1, 1, "assistant", None, None), (1, 1, None, "b", None), (None, None, "user", "n", None), (None, None, "user", "n", None), (2, 0, "assistant", "y" * 100_000, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")
    got = {r.conv_id: r for r in chat.format_conversations(frame, "parts").collect()}
    assert [(a.type, a.ref, a.tokens) for a in got[1].attachments] == [("image", "a.png", 2), ("audio", "b.wav", 38), ("document", "c.pdf", 512)]
    assert got[1].n_tokens == 2 + 2 + 38 + 512 + 1 + 1
    assert chat.read_back(got[1].formatted) == [("user", "see <image:0><image:0><audio:1><document:2>ok"), ("", "b"), ("assistant", "")]
    assert chat.read_back(got[None].formatted) == [("user", "n"), ("user", "n")]
    assert chat.format_conversations(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="unknown type"):
        chat.Formatter().add("user", [{"type": "video"}])


def test_chat_query(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    said = {r.conv_id: r for r in chat.op1_chat(turns).collect()}
    byid = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        byid.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    byid[-7] = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]
    assert said.keys() == byid.keys()
    for k, v in byid.items():
        loss = "".join(t for r, t in v if r == "assistant")
        assert said[k].n_turns == len(v) and said[k].loss_chars == len(loss)
        assert said[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in v).encode()).hexdigest()
        assert said[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# SentencePiece


@pytest.fixture(scope="module")
def own():
    return sentencepiece_bpe.Coder(open(model_path(), "rb").read(), cache=50)


@given(st.lists(st.text(alphabet=st.sampled_from("abcthe ing,.\u2581\n\t  \u00e9\u4e2d\U0001f600<s>0x1")) | st.text(), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_sentencepiece_equals_library(own, texts):
    for t in texts:
        assert own.encode(t) == own.library.encode(t)
        assert np.frombuffer(own.agenda("\u2581" + t.replace(" ", "\u2581")), np.int32).tolist() == own.library.encode(t) or not t


def test_sentencepiece_table_and_edges(spark, sf, own):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_documents(spark)):
        want = []
        for r in docs.collect():
            ids = own.library.encode(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.library.decode(ids).encode()).hexdigest()))
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in sentencepiece_bpe.op2_sentencepiece(docs, model_path()).collect())
    assert sentencepiece_bpe.op2_sentencepiece(docs.limit(0), model_path()).count() == 0


def test_sentencepiece_cache_is_bounded_in_bytes():
    import gc

    own = sentencepiece_bpe.Coder(open(model_path(), "rb").read(), cache_bytes=400_000)
    rng = np.random.default_rng(0)
    lines = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, n))) for n in rng.integers(1, 3000, 300)]  # long, without spaces
    words = [" ".join(f"{chr(0x3B1 + int(k) % 24)}w{k}" for k in rng.integers(0, 100_000, 5000)) for _ in range(3)]
    texts = [*lines, "\n".join(lines), *words]
    assert own.encode_all(texts) == own.library.encode(texts)
    for cache in (own.parts, own.cuts):
        assert sum(len(c) + len(i) + sentencepiece_bpe.CUT_BYTES for c, i in cache.items()) <= 2 * 400_000 and all(len(c) <= sentencepiece_bpe.LONG_CUT for c in cache)
    assert gc.isenabled()


# mixing


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("which", ["table", "odd"])
def test_mix(spark, sf, which):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if which == "table" else odd_documents(spark)
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    target = slow_targets(sizes)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    taken = {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.op4_mix(docs.limit(0)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text))
    assert words == {s: n for s, n in taken.items() if n}


def test_mix_by_row(spark):
    rows = [(None, f"w{i} " * (1 + i % 5), "a") for i in range(40)] + [(7, "x " * 9, "a"), (7, "y " * 2, "a"), (8, "z z z", "b"), (8, "z z z", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, words = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        taken[r.source, r.doc_id] += r.taken
    mixed = mixing.mixed_documents(docs).collect()
    for r in mixed:
        words[r.source, r.doc_id] += len(WORD.findall(r.text))
    assert words == +taken
    cut = [r for r in mixed if tuple(r) not in rows]
    assert len(cut) <= 2 and len({r.text for r in mixed if r.doc_id is None and r not in cut}) > 20


# HTML


def test_html_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html_extract.op5_html(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<nav>menu</nav>", ""), ("plain  text", "plain text"), ("a < b &lt; c &amp;amp; d", "a < b < c &amp; d"), ("<p>unclosed <b>x<p>y", "unclosed x\n\ny"),
        ("<body><div class='cookie-notice'>c</div><header>h</header><div><h1>T</h1><p>one<br>two</p></div><aside>s</aside><form>f</form><footer>z</footer>", "T\n\none two"),
        ("<article><h1>T</h1><p>a</p><div class=\"ad\">buy</div><script>if (a < b) '</p>'</script><p>b</p></article><section class=comments><article><p>me</p></article></section>", "T\n\na\n\nb"),
        ("<article><!-- <p>no</p> --><p>yes</p><style>p{}</style>", "yes"), ("<title>t</title><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul><p>The text of the page.</p>", "The text of the page."),
    ],
)
def test_html_cases(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>a</p><section id="related-work"><h2 id="market-share">b</h2><p>c</p></section><div id="search-algorithms">d</div></article>', "a\n\nb\n\nc\n\nd"),
        ('<article><section id="search"><h2 id="comments">a</h2><p id="share">b</p></section></article>', "a\n\nb"), ('<div class="layout has-sidebar"><article>a</article></div>', "a"),
        ('<div id="no-sidebar"><main>a</main></div>', "a"), ('<div class="page search"><div class="sidebar">s</div><article>a</article></div>', "a"), ('<div class="related"><main>a</main></div>', "a"),
        ('<body class="single comments-open"><article>a</article></body>', "a"), ('<main data-comment-count="3">a</main>', "a"), ("<form id=f><input><main>a</main></form>", "a"),
        ('<p>a</p><div data-class="ad" title="a class=ad b" data-hidden>b</div>', "a\n\nb"), ("<head><title>t</title><body><p>a</p>", "a"),
        ('<main><p>a</p><div class="x Sidebar">s</div><div id=comments><article>c</article></div><article class="comment">c</article><div aria-hidden=true>h</div><aside><article>n</article></aside></main>', "a"),
        ('<article>a</article><div class="related-posts"><article>r</article></div><div class="ad-slot"><article>s</article></div>', "a"), ('<div style="display: none"><main>a</main></div>b', "b"),
    ],
)
def test_html_marks(page, text):
    assert html_extract.main_text(page) == text


LONG, END = "long text " * 100 + "end", "The closing paragraph. " * 6 + "end"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div id=content><p>{LONG}</p><div class=ad>x</div><div class=ad>y</div><div class=ad>z</div><p>{END}</p></div>", f"{LONG}\n\n{END}"),
        ("<p>a <a href=x>a long link</a></p><p><a href=x>all of it</a></p><ul><li><a href=x>one</a></li></ul>", "a a long link\n\nall of it\n\none"),
        (f"<div id=content><p>{LONG}</p></div><article class=card>teaser</article>", f"{LONG}\n\nteaser"), (f"<div>about</div><article><p>{LONG}</p></article>", LONG),
        (f"<main><p>a</p></main><div>{END}</div>", "a"), ("<ul><li><a href=x>one</a></li></ul>", "one"), ("<ul><li><a href=x>one</a></li><li>two <a href=x>b</a></li></ul>", "two b"),
    ],
)
def test_html_keeps_all_unmarked_text(page, text):
    assert html_extract.main_text(page) == text


def without_names(page):
    """The page with none of the elements and class names that tell what holds the article."""
    for old, new in ("nav", "div class=n1"), ("article", "div class=k2"), ("footer", "div class=z3"):
        page = page.replace(f"<{old}>", f"<{new}>").replace(f"</{old}>", "</div>")
    return page.replace('<div class="ad">', "<div class=q7>")


def test_html_windows_decide(spark, sf, monkeypatch):
    """Pages that tell nothing by elements or names: whole articles stay, next to nothing else does, and only by the windows."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    want = [html_extract.main_text(p).split("\n\n") for p in pages]

    def figures():
        got = [html_extract.main_text(without_names(p)).split("\n\n") for p in pages]
        size = sum(len(x) for w in want for x in w)
        over = lambda a, b: sum(len(x) for u, v in zip(a, b, strict=True) for x in u if x not in v) / size
        return sum(g == w for g, w in zip(got, want, strict=True)) / len(pages), over(want, got), over(got, want)

    equal, lost, more = figures()
    assert equal > 0.95 and lost < 0.001 and more < 0.005
    monkeypatch.setattr(html_extract, "SURGE", 0)
    equal, lost, more = figures()
    assert equal == 0 and more > 0.05


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article><p>{LONG}</p><div class="box-x7">Buy now 50% off</div><p>z</p></article>', f"{LONG}\n\nz"),
        (f"<div><p>{LONG}</p></div><div class=u8><h3>2 x</h3><div><p>Bob</p><p>nice, thanks</p></div><div><p>Eve</p><p>no</p></div></div>", LONG),
        (f'<section id="search"><h1>T</h1><p>{LONG}</p></section>', f"T\n\n{LONG}"),
        (f"<div class=a><a href=x>Home</a> <a href=y>About</a></div><div class=b><h1>T</h1></div><div class=c><p>{LONG}</p><p>s</p><p>{END}</p></div><div class=d>(c) me</div>", f"T\n\n{LONG}\n\ns\n\n{END}"),
        (f"<div><p>{LONG}</p>" + "<ul>" + "<li><a href=x>link</a></li>" * 9 + "</ul></div>", LONG),
        (f"<div>{LONG}</div><div>{LONG}</div>", f"{LONG}\n\n{LONG}"),
    ],
)
def test_html_without_names(page, text):
    assert html_extract.main_text(page) == text


def test_html_windows():
    assert html_extract.between([0, 5, 5, 0, 0, 0, 3, 0, 9, 0, 0], 9) == [1, 2, 6, 7, 8, 9, 10]
    assert html_extract.between([4, 0, 0, 0, 0, 4, 5], 9) == [5, 6] and html_extract.between([0, 0], 0) == [] == html_extract.between([], 0)


def test_html_edges(spark):
    rows = [(None, None, None, "c"), (1, "u", "<p>" + "a " * 300_000, "c"), (1, "u", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html_extract.op5_html(pages).collect()) == [0, 0, 599_999]
    assert html_extract.op5_html(pages.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["<div>x ", "<p>x<span> ", "<ul><li>x ", "<b>x</i><p>", "<p><b>x</td>"])
def test_html_many_unclosed_elements(unit):
    assert html_extract.main_text(unit * 100_000).count("x") == 100_000  # hours if each element looked through all open ones


# quality rules


def slow_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeat = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


@given(st.text(alphabet=st.sampled_from("ab \n\t#|\u00e9\u2003\x1c")) | st.text())
@settings(max_examples=300, deadline=None)
def test_base_counts(text):
    assert quality_rules.base_counts(text) == slow_counts(text)


def test_repeat_words_of_many_kinds():
    words = [str(i).encode() for i in range(9000)]
    assert quality_rules.n_repeat_words(words + words[10:20]) == 20


def slow_verdicts(docs, labels):
    """The same model by dictionaries of n-grams' buckets."""
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    raw, target = Counter(), Counter()
    grams = {}
    for k, r in enumerate(docs):
        b = (r.text or "").encode()
        grams[k] = [(int.from_bytes(b[i : i + 3], "big") * 2654435761 % 2**32) >> 16 for i in range(len(b) - 2)]
        raw.update(grams[k])
        if r.doc_id in good:
            target.update(grams[k])
    if not target:
        return [0.0] * len(docs)
    n, m = raw.total(), target.total()
    ratio = lambda g: np.log((target[g] + m / n) / (m * (1 + 65536 / n))) - np.log((raw[g] + 1) / (n * (1 + 65536 / n)))
    return [float(np.mean([ratio(g) for g in grams[k]])) if grams[k] else 0.0 for k in range(len(docs))]


@pytest.mark.parametrize("which", ["table", "odd"])
def test_quality_rules(spark, sf, which):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet") if which == "table" else odd_documents(spark)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet") if which == "table" else odd_labels(spark)
    rows = docs.collect()
    want = []
    for r, ratio in zip(rows, slow_verdicts(rows, labels.collect()), strict=True):
        n = slow_counts(r.text or "")
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        want.append((r.doc_id, *n, failed, not failed and ratio >= quality_rules.THRESHOLD, ratio))
    got = quality_rules.op6_quality_rules(docs, labels).collect()
    key = lambda r: (str(r[:8]), r[8])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:8] == b[:8] and a[8] == pytest.approx(b[8], abs=1e-9)
    assert sum(r.kept for r in got) == quality_rules.kept_documents(docs, labels).count()
    assert quality_rules.kept_documents(docs, labels).columns == docs.columns
    assert quality_rules.op6_quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_rules_keep_the_good(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_rules.op6_quality_rules(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1 and not r.base_failed]) > 0.99
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


# licences


def slow_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = lambda p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base = {p: places(p) for p in license_scan.BASE}
    starts = sorted(itertools.chain(*base.values()))
    labels = {license_scan.BASE[p] for p, s in base.items() if s}
    more = {k for k, (must, _) in license_scan.TEMPLATES.items() if all(places(p) for p in must)}
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more))


def slow_weights(texts):
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    met = Counter(w for s in split for w in set(s))
    words = {w for must, some in license_scan.TEMPLATES.values() for t in (*must, *some) for w in t.split()} | {w for p in license_scan.BASE for w in p.split()}
    return {w: int(np.floor(1000 * (np.log((1 + len(texts)) / (1 + met[w])) + 1))) for w in words}


def slow_score(text, labels, weight):
    """Every licence text of a label laid at every place of the file where one of the label's key phrases comes to lie on its like."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    best = max((float(x in license_scan.BASE.values()) for x in labels), default=0.0)
    for label in set(labels) & license_scan.TEMPLATES.keys():
        must, some = license_scan.TEMPLATES[label]
        for whole in (t.split() for t in some):
            for start in range(-len(whole), len(words)):
                on = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(whole)]
                keys = [p.split() for p in must]
                if any(whole[i : i + len(k)] == k and all(on[i : i + len(k)]) for k in keys for i in range(len(whole) - len(k) + 1)):
                    best = max(best, sum(weight[w] for w, x in zip(whole, on, strict=True) if x) / sum(map(weight.get, whole)))
    return best


def test_license_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(300)
    said = [
        "Released under the MIT License.", "MIT license", "x Permission is hereby granted, free of charge, to any person obtaining a copy of THAT software", "charge, to any person",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License as published, either version 3 of the License",
        "CC BY-SA 4.0 or licensed under CC BY-NC 4.0", "Apache License, Version 2.0 and again: Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file", "all rights reserved", "cc0", None, "",
    ]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(said)], "doc_id long, text string"))
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    weight = slow_weights(list(rows.values()))
    got = license_scan.op7_license_scan(docs).collect()
    assert len(got) == len(rows) and sum(0 < r.score < 1 for r in got) >= 3
    for r in got:
        assert r.score == pytest.approx(slow_score(rows[r.doc_id], [x for x in r.labels.split(",") if x], weight), abs=1e-12)


def test_license_index_touches_only_phrases_whose_rarest_word_is_there(monkeypatch):
    idf = dict.fromkeys(license_scan.POSTINGS, 1) | {b"general": 9, b"by": 9}
    orders = license_scan.phrase_order(idf)
    read = []

    class Seen(list):
        def __getitem__(self, i):
            read.append(license_scan.PHRASES[i]) if isinstance(i, int) else None
            return super().__getitem__(i)

    found = license_scan.phrase_starts([b"x", b"general", b"public", b"license", b"cc"], Seen(orders), idf)
    assert {license_scan.PHRASES[i]: s for i, s in found.items()} == {(b"general", b"public", b"license"): [1]}
    assert (b"cc", b"by") not in {license_scan.PHRASES[i] for i in found}


def test_license_scan(spark, sf):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_documents(spark)):
        want = sorted(str((r.doc_id, *slow_scan(r.text or ""))) for r in docs.collect())
        got = license_scan.op7_license_scan(docs).collect()
        assert sorted(str(tuple(r)[:7]) for r in got) == want
        assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert license_scan.op7_license_scan(docs.limit(0)).count() == 0


@given(st.lists(st.sampled_from(["cc", "by", "BY-", "cc_by", "general", "public", "license", "all", "rights", "reserved", "Reserved.", "gnu", "version", "3", "mit", "x", "\u00e9"]), max_size=30))
@settings(max_examples=300, deadline=None)
def test_license_phrases(words):
    text = " ".join(words)
    idf = dict.fromkeys(license_scan.POSTINGS, 1.0)
    got = license_scan.words_of(text)
    assert (len(got), *license_scan.scan(got, license_scan.phrase_order(idf), idf)[:5]) == slow_scan(text)


# language ID


def test_language_tables_equal_the_network():
    rng = np.random.default_rng(0)
    net = language_id.Network(["a", "b", "c"])
    x = rng.integers(0, 256, (700, language_id.LENGTH)).astype(np.uint8)
    assert np.allclose(net.logits(x), net.forward(x)[0], atol=1e-4)


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = language_id.Network(["a", "b"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y = rng.integers(0, 256, (3, language_id.LENGTH)).astype(np.uint8), np.array([0, 1, 1])

    def loss():
        z = net.forward(x)[0]
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(3), y]))

    grads = net.gradients(x, y)
    for name, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.weights[name][i] += 1e-6
        up = loss()
        net.weights[name][i] -= 2e-6
        down = loss()
        net.weights[name][i] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[i], rel=1e-3)


def test_language_held_out(spark, sf):
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language_id.op8_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_language_learns_every_language(spark, monkeypatch):
    rows = [(9 * i + k, f"{chr(0x4E00 + i)}{chr(97 + i % 26)} " * 50, f"l{i}") for i in range(70) for k in range(8 if i < 64 else 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    x, y, languages = language_id.training_rows(docs)
    assert languages == sorted({r[2] for r in rows}) and set(y.tolist()) == set(range(70))
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 40, raising=False)
    x, y, languages = language_id.training_rows(docs)
    assert len(languages) == 70 and len(x) <= 70 * language_id.TRAIN_WINDOWS and set(y.tolist()) == set(range(70))


def slow_language(network, text):
    """Filters slid over every window one place at a time, whole texts, in plain floats."""
    if not any(unicodedata.category(c).startswith("L") for c in text) or not network.languages:
        return "und", 0.0
    raw = text.encode()
    p = {k: v.astype(np.float64) for k, v in network.weights.items()}
    logits = []
    for s in range(0, len(raw), language_id.LENGTH):
        window = list(raw[s : s + language_id.LENGTH].ljust(language_id.LENGTH, b"\0"))
        tops = []
        for w in language_id.WIDTHS:
            maps = [np.concatenate([p["embedding"][b] for b in window[i : i + w]]) @ p[f"f{w}"] for i in range(language_id.LENGTH - w + 1)]
            tops += [max(0.0, max(m[f] for m in maps) + p[f"b{w}"][f]) for f in range(language_id.FILTERS)]
        logits.append(np.array(tops) @ p["out"] + p["out_b"])
    mean = np.mean(logits, axis=0)
    chance = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
    return network.languages[int(chance.argmax())], float(chance.max())


def test_language_equals_slow_prediction_of_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    network = language_id.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    for frame in (docs, odd_documents(spark).where("length(text) < 1000 OR text IS NULL")):
        texts = Counter((r.doc_id, r.text) for r in frame.collect())
        got = {}
        for r in language_id.predict(frame, network).collect():
            got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
        for (i, text), n in texts.items():
            lang, score = slow_language(network, text or "")
            assert sum(a == lang and b == pytest.approx(score, abs=1e-4) for a, b in got[i]) >= n


@pytest.mark.parametrize(("text", "spoken"), [("\u00bd \u00b2 \u2167 \u2460 12!", False), ("\u00aa", True), ("1\u01c5", True), ("\u4e2d", True), ("_", False), ("\U0001f600", False), ("\u02b0", True)])
def test_language_letters(text, spoken):
    assert language_id.has_letter(text) == spoken == any(unicodedata.category(c).startswith("L") for c in text)


def test_language_edges(spark):
    docs = odd_documents(spark)
    rows = language_id.op8_language_id(docs).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows} <= {"en", "de", "und"}
    assert sum(r.lang_pred == "und" for r in rows) == 5
    assert language_id.spoken_documents(docs).columns == docs.columns
    assert language_id.op8_language_id(docs.limit(0)).count() == 0


# quality classifier


def test_isotonic():
    x, y = np.arange(6.0), np.array([0.0, 0.5, 0.2, 0.3, 1.0, 0.9])
    at, value = quality_classifier.isotonic(x, y, np.ones(6))
    assert np.all(np.diff(value) > 0) and np.allclose(value, [0, 1 / 3, 0.95]) and np.allclose(at, [0, 2, 4.5])


def test_quality_held_out(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality_classifier.op9_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_equals_one_fit(spark):
    """Partition sums against the normal equations of all rows at once."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    stats = quality_classifier.document_statistics(docs).checkpoint()
    model = quality_classifier.fit(stats, labels)
    x = {r.id: r.x for r in stats.collect()}
    import zlib

    train = [(x[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    z, y = model.features(np.array([a for a, _ in train])), np.array([b for _, b in train], float)
    penalty = np.eye(z.shape[1]) * quality_classifier.RIDGE * len(y)
    penalty[-1, -1] = 0
    want = z @ np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.allclose(z @ model.weights, want, atol=1e-6)


def slow_statistics(text):
    words = WORD.findall(text)
    raw = text.encode()
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, size = max(1, len(words)), max(1, len(raw))
    count = lambda chars: sum(raw.count(c.encode()) for c in chars) / size
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    met = Counter(words)
    return [
        np.log(1 + len(words)), np.log(1 + len(raw)), sum(len(w.encode()) for w in words) / n, count("#*$%&|<>"), count("!"), count(upper), count(digits), count(".,;:?\"'()-"), sum(b >= 128 for b in raw) / size,
        count(" \t\n\r\x0b\x0c"), len(met) / n, max(met.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n, np.log(1 + len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
    ]


def test_quality_statistics_and_scores_are_those_of_whole_texts(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_classifier.fit(quality_classifier.document_statistics(docs).checkpoint(), labels)
    got = {r.doc_id: r for r in quality_classifier.op9_quality(docs, labels).collect()}
    at, value = model.knots
    for r in docs.collect():
        x = np.array(slow_statistics(r.text or ""))
        assert np.allclose(x, quality_classifier.statistics(r.text or ""), atol=1e-12)
        scaled = np.clip((x - model.mean) / model.deviation, -quality_classifier.CUT, quality_classifier.CUT)
        raw = sum(w * np.sqrt(2 / quality_classifier.FEATURES) * np.cos(scaled @ d + f) for w, d, f in zip(model.weights, model.directions.T, model.phases)) + model.weights[-1]
        want = value[0] if raw <= at[0] else value[-1] if raw >= at[-1] else next(a + (b - a) * (raw - p) / (q - p) for p, q, a, b in zip(at, at[1:], value, value[1:]) if p <= raw <= q)
        assert got[r.doc_id].score == pytest.approx(min(1, max(0, want)), abs=1e-6) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)


def test_quality_edges(spark):
    docs, labels = odd_documents(spark), odd_labels(spark)
    for some in (labels, labels.limit(0)):
        rows = quality_classifier.op9_quality(docs, some).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality_classifier.op9_quality(docs.limit(0), labels).count() == 0
