"""The text operators against brute force, round trips and held-out labels."""

import hashlib
import random
import re
import sys
import tracemalloc
import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest import AWKWARD, prose  # noqa: E402

from panelloom.llm import (  # noqa: E402
    bpe, cover_tree, decontaminate, html_text, jaccard, langid, suffix, toxicity, url_tree, windows,
)
from panelloom.llm.common import components, read  # noqa: E402

VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# ---- 1: byte-pair encoding --------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_padding()
    t.no_truncation()
    return t


def test_encoding_equals_the_library(tokenizer):
    encoder = bpe.Encoder(bpe.load_spec(VOCABULARY))
    rng = random.Random(5)
    texts = ["", "I'm WE'VE don't 'S 's", "<|startoftext|> a <|endoftext|><|endoftext|>", "ΑΣ ΟΔΟΣ İ ß é", "a" * 99,
             "tab\tand\x85odd\x1cspace\u3000!", "１２３ 日本語 👩‍👩‍👧"]
    texts += ["".join(rng.choice("aabcdeeinorst' .théñ1") for _ in range(rng.randint(1, 50))) for _ in range(400)]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids, text
        assert encoder.automaton.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_words_run_together_equal_words_run_alone(tokenizer):
    """Short and long words, repeats and an empty one; the memory turns over between calls."""
    encoder = bpe.Encoder(bpe.load_spec(VOCABULARY))
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinsé日") for _ in range(rng.choice([1, 2, 5, 9, 30, 47, 48, 49, 200]))) for _ in range(500)]
    words += ["", *words[:50]]
    assert encoder.automaton.encode_words(words) == [encoder.automaton.encode_word(w) for w in words]
    encoder.automaton.arc_keys[:] = -1
    for turn in range(3):
        encoder.held = bpe.CACHE_BYTES
        found = list(encoder.parts([" ".join(words[turn * 100 :]), "", words[3]]))
        want = tokenizer.encode(" ".join(words[turn * 100 :]), add_special_tokens=False).ids
        assert [int(i) for p in found[0] for i in p[1].split(" ")] == want and found[1] == []


def test_automaton_agrees_with_merging():
    """Small merge lists, all strings: the path equals merging by rank."""
    merges = ["a a", "b a", "a b", "aa b", "ba ab", "aa aa"]
    vocab = {s: i for i, s in enumerate(["a", "b", *(m.replace(" ", "") for m in merges)])}
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "added_tokens": []}
    automaton = bpe.TokenAutomaton(spec)
    for n in range(1, 9):
        for code in range(2**n):
            word = "".join("ab"[code >> i & 1] for i in range(n))
            parts = list(word)
            while True:
                ranked = [(merges.index(f"{x} {y}"), i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if f"{x} {y}" in merges]
                if not ranked:
                    break
                best = min(ranked)[0]
                x, y = merges[best].split()
                out, i = [], 0
                while i < len(parts):
                    if parts[i : i + 2] == [x, y]:
                        out.append(x + y)
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            assert automaton.encode_word(word) == [vocab[p] for p in parts], word
            assert automaton.encode_words([word]) == [[vocab[p] for p in parts]], word


def test_encoding_of_awkward_rows(documents, tokenizer):
    found = {r["doc_id"]: r for r in bpe.bpe_encode(documents(*AWKWARD), VOCABULARY).collect()}
    assert len(found) == len(AWKWARD)
    for doc_id, text in AWKWARD:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        r = found[doc_id]
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r["decoded"] == decoded and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.bpe_encode(documents(), VOCABULARY).count() == 0


# ---- 2: urls --------------------------------------------------------------------------

RULES = [url_tree.Rule.of("org/", False), url_tree.Rule.of("example.org/es/", True), url_tree.Rule.of("com/de/", True)]


def pages(spark, *urls):
    return spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, purity string, n int")


def test_url_parts_and_rules(spark):
    table = pages(spark, "HTTP://A.Example.ORG/es/1?x#y", "http://b.org", "https://x.com/de/9#z", "nothing", None, "", "http://example.org/es/", "http://u@x.net:80/p?q://r")
    got = rows(url_tree.judge_urls(table, RULES), "page_id", "host", "path", "rule", "verdict")
    assert [g[:3] for g in got] == [
        (0, "a.example.org", "/es/1"), (1, "b.org", ""), (2, "x.com", "/de/9"), (3, "", ""), (4, "", ""), (5, "", ""),
        (6, "example.org", "/es/"), (7, "u@x.net:80", "/p")]
    assert [g[3] for g in got] == ["example.org/es/", None, "com/de/", None, None, None, "example.org/es/", None]
    assert [g[4] for g in got][0] == "block" and [g[4] for g in got][2] == "block"
    assert url_tree.judge_urls(pages(spark).where("page_id < 0"), RULES).count() == 0


def test_url_templates(spark):
    """Numbers become a wildcard, a branch with other labels stays apart, purity decides."""
    urls = [f"http://h.com/de/{i}" for i in range(200)] + [f"http://h.com/fr/{i}" for i in range(200)]
    urls += [f"http://h.com/de2/{i}" for i in range(20)]
    rules = [url_tree.Rule.of("com/de/", True), url_tree.Rule.of("com/fr/", False)]
    got = url_tree.judge_urls(pages(spark, *urls), rules)
    templates = {r["template"] for r in got.collect()}
    assert templates == {"/de/*", "/fr/*", "/~/*"} or templates == {"/de/*", "/fr/*", "/de2/*"}
    purity = {r["template"]: r["purity"] for r in got.collect()}
    assert purity["/de/*"] > 0.9 and purity["/fr/*"] < 0.1


# ---- 3: n-gram join ---------------------------------------------------------------------


def brute_groups(docs):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), find(i)) for i in ids]


def test_ngram_groups(documents):
    rng = random.Random(3)
    docs = list(AWKWARD)
    for base in range(4):
        words = prose(20 + base, 120).split()
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            docs.append((100 + len(docs), " ".join(copy[: rng.randint(90, 120)])))
    common = prose(77, 30)
    docs += [(500 + i, common + " " + prose(200 + i, rng.randint(2, 60))) for i in range(30)]
    got = rows(jaccard.ngram_groups(documents(*docs), fragments=5), "doc_id", "n_shingles", "component_id")
    assert got == brute_groups(docs)
    assert jaccard.ngram_groups(documents()).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges.append((7, 7))
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "root")
    assert got == sorted((x, find(x)) for x in root)


# ---- 4: html ----------------------------------------------------------------------------


def test_main_text():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header>
    <nav><ul><li>Menu</ul></nav><div class="cookie-notice">Cookies</div><article><h1>Head &amp; line</h1>
    <p>One <b>bold</b>word<br>two<p>three &eacute; <!-- no --><script>x='</p>'</script>
    <div id=comments>Reader says</div><ul><li>a<li>b</ul></article><aside>Side</aside><form>F</form><footer>Foot</footer></body>"""
    assert html_text.main_text(page) == "Head & line One boldword two three é a b"
    assert html_text.main_text("") == "" and html_text.main_text("plain &lt;b&gt; text") == "plain <b> text"
    assert html_text.main_text("<p>unclosed <b>x<p>y<article><p>in") == "in"


def test_class_names_inside_the_article():
    """A word in a class name does not delete article text; a name that says nothing else does."""
    kept = """<p class="notice">one</p><section class="menu-history"><h2 id="share-prices">two</h2></section>
        <div class="comment-count"><p>three</p></div><ul class="ad-hoc"><li>four</li></ul>"""
    gone = """<div class="cookie-notice">a</div><div class="ad">b</div><section id="comments"><p>c</p></section>
        <div class="x ad-slot">d</div><p class="advert">e</p><ul class="share-links"><li>f</li></ul>"""
    for tag in ("article", "main"):
        assert html_text.main_text(f"<div class=menu>m</div><{tag}>{kept}{gone}</{tag}><p class=footer>z</p>") == "one two three four"
    assert html_text.main_text("<div class='site-menu'>m</div><div>text</div>") == "text"


def test_site_templates_go(spark):
    frame = "<html><body><div><p>Welcome to this site, dear guest</p><span>Version 7</span></div>{}</body></html>"
    table = [(i, f"http://h.org/{i}", frame.format(f"<div><p>Story number {i} of many</p></div>")) for i in range(20)]
    table += [(90, None, None), (91, "http://one.org/", frame.format("<p>alone</p>")), (91, "http://one.org/", "")]
    df = spark.createDataFrame(table, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("templates", F.lit(2))
    got = rows(html_text.extract_text(df), "page_id", "text", "n_chars")
    assert got[3] == (3, "Story number 3 of many", 22)
    assert got[-3:] == [(90, "", 0), (91, "", 0), (91, "Welcome to this site, dear guest Version 7 alone", 48)]
    assert html_text.extract_text(df.where("page_id < 0")).count() == 0


# ---- 5: suffix arrays ---------------------------------------------------------------------


def test_suffix_array_equals_sorting(monkeypatch):
    rng = np.random.default_rng(0)
    for turn in range(120):
        monkeypatch.setattr(suffix, "SMALL", 2 if turn % 2 else 64)
        x = rng.integers(1, int(rng.integers(2, 7)), int(rng.integers(1, 300)))
        x = np.tile(x[: max(1, len(x) // 5)], 5) if turn % 3 == 0 else x
        s = np.r_[x, 0].astype(np.int64)
        assert suffix.suffix_array(s, int(s.max()) + 1).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute_removed(docs, length=50):
    first, out = {}, []
    for i, text in sorted(docs):
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    for i, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_remove_repeats(documents, monkeypatch):
    rng = random.Random(9)
    passages = [prose(50 + i, 12) for i in range(6)]
    docs = list(AWKWARD)
    for i in range(60):
        parts = [prose(300 + i, 15)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 20)
            parts += [p[a : a + rng.randint(30, 90)], prose(900 + rng.randrange(10), 4)]
        docs.append((1000 - i, " ".join(parts)))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(suffix.remove_repeats(documents(*docs)), *columns) == brute_removed(docs)
    assert suffix.remove_repeats(documents()).count() == 0


def test_long_texts_are_cut_into_pieces():
    make = suffix.Anchors()
    data = np.frombuffer(prose(4, 3000).encode(), np.uint8)
    whole = {w: k for _, a, b, k in [(d, a, b, k) for d, a, b, k, *_ in zip(*make.runs(data, np.array([0, len(data)])))] for w in range(a, b + 1)}
    pieced = {}
    for ids, shift, raw, cut in suffix.pieces(np.array([5]), data, np.array([0, len(data)]), 50, size=1000):
        for d, a, b, k, *_ in zip(*make.runs(raw, cut)):
            pieced |= {int(w + shift[d]): k for w in range(a, b + 1)}
    assert {int(w): k for w, k in whole.items()} == pieced and len(pieced) == len(data) - 49


# ---- 6: benchmark passages -----------------------------------------------------------------


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_passages_within_the_edit_budget(spark, documents):
    rng = random.Random(2)
    items = [(i, prose(600 + i, 14)) for i in range(5)] + [(80, None), (81, ""), (82, "short")]
    docs = list(AWKWARD)
    for i in range(40):
        text = list(items[i % 5][1])
        for _ in range(rng.randint(0, 12)):
            kind, at = rng.randrange(3), rng.randrange(len(text))
            text[at : at + 1] = [["#"], [], [text[at], "#"]][kind]
        docs.append((200 + i, prose(700 + i, 10) + " " + "".join(text).upper() + "\n" + prose(800 + i, 10)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_passages(documents(*docs), benchmark)
    want = set()
    for doc_id, text in docs:
        for item_id, item in items[:5]:
            if text and len(text) < 2000:
                budget = decontaminate.edit_budget(len(item), decontaminate.Q, decontaminate.EDIT_SHARE)
                edits = edit_distance_inside(item, re.sub(r"\s", " ", text.lower()))
                if edits <= budget:
                    want.add((doc_id, item_id, edits))
    best = got.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
    assert set(rows(best, "doc_id", "item_id", "edits")) == want and len(want) > 5
    small = decontaminate.find_passages(documents(*docs), benchmark, block_bytes=150)
    assert rows(small, *small.columns) == rows(got, *got.columns)
    assert decontaminate.find_passages(documents(), benchmark).count() == 0
    assert decontaminate.find_passages(documents(*docs), benchmark.where("item_id < 0")).count() == 0


# ---- 7: compact windows ------------------------------------------------------------------


def test_compact_windows_cover_every_wide_sequence_once():
    rng = np.random.default_rng(3)
    for turn in range(60):
        n, width = int(rng.integers(1, 60)), int(rng.integers(1, 9))
        values = rng.integers(0, 8 if turn % 2 else 1000, n).astype(np.uint64)
        low, mid, high = windows.compact_windows(values, width)
        for i in range(n):
            for j in range(i + width - 1, n):
                inside = [c for a, c, b in zip(low, mid, high) if a <= i <= c <= j <= b]
                assert inside == [i + int(np.argmin(values[i : j + 1]))]


def test_repeated_passages(documents):
    passage = prose(40, 70).split()
    changed = list(passage)
    changed[35] = "other"
    docs = [*AWKWARD[:6], (20, prose(41, 100) + " " + " ".join(passage) + " " + prose(42, 50)),
            (21, prose(43, 30) + " " + " ".join(changed)), (22, prose(44, 200)), (23, " ".join(passage[:40]))]
    got = windows.repeated_passages(documents(*docs)).collect()
    assert {(r["doc_id"], r["partner_id"]) for r in got} == {(21, 20)}
    assert all(r["start_word"] <= 45 and r["end_word"] >= 85 and r["similarity"] >= 0.75 for r in got)
    assert windows.repeated_passages(documents()).count() == 0


def test_passages_between_documents_that_are_not_the_smallest(documents):
    # Thirty smaller documents hold every shingle of the passage, far apart, and repeat it nowhere.
    passage = prose(50, 90).split()
    changed = list(passage)
    changed[40] = "other"
    apart = [(i, " ".join(" ".join(passage[j : j + 9]) + " " + prose(1000 * i + j, 60) for j in range(0, 90, 5)))
             for i in range(1, 31)]
    docs = [*apart, (40, prose(51, 30) + " " + " ".join(passage)), (41, prose(52, 40) + " " + " ".join(changed)),
            (42, " ".join(passage[5:]) + " " + prose(53, 20)), (43, prose(54, 80))]
    got = windows.repeated_passages(documents(*docs)).collect()
    pairs = {(r["doc_id"], r["partner_id"]) for r in got}
    assert {(41, 40), (42, 40)} <= pairs <= {(41, 40), (42, 40), (42, 41)}
    assert all(r["end_word"] - r["start_word"] >= 50 and r["similarity"] >= 0.75 for r in got)


# ---- 8: embeddings ------------------------------------------------------------------------


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    table, n = [], 0
    for label in (1, 2, None):
        base = rng.normal(size=(25, 8))
        near = base[rng.integers(0, 25, 60)] + rng.normal(size=(60, 8)) * rng.choice([0.0, 0.02, 0.08], 60)[:, None]
        for v in [*base, *near, *base[:5]]:
            table.append((n, [float(x) for x in v], label))
            n += 1
    odd = [None, [], [0.0] * 8, [1.0, None], [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], [1e-30] * 8, [3e-30] * 8]
    table += [(n + i, v, 1) for i, v in enumerate(odd)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").withColumn("block", F.lit("x")).withColumn("cls", F.lit(1))
    got = rows(cover_tree.near_vectors(df, block_rows=30), "vec_id", "n_links", "component_id", "kept")
    usable = {i: np.array(v, float) for i, v, label in table if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    labels = {i: label for i, _, label in table}
    links, root = {i: 0 for i, *_ in table}, {i: i for i, *_ in table}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in usable:
        for b in usable:
            x, y = usable[a], usable[b]
            if a < b and labels[a] == labels[b] and len(x) == len(y):
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    assert got == [(i, links[i], find(i), find(i) == i) for i in sorted(links)]
    assert cover_tree.near_vectors(df.where("vec_id < 0")).count() == 0


# ---- 9, 10: learned scores ---------------------------------------------------------------


def test_languages_on_held_out_text(spark, documents):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit_languages(docs.where(~held))
    found = langid.predict_languages(docs.where(held), model).join(docs, "doc_id")
    assert found.where("lang_pred = lang").count() >= 0.98 * found.count()
    odd = rows(langid.predict_languages(documents((1, None), (2, ""), (3, "123 --"), (3, "123 --"), (4, "the and of that")), model), "doc_id", "lang_pred", "score")
    assert [o[:2] for o in odd] == [(1, "und"), (2, "und"), (3, "und"), (3, "und"), (4, "en")] and odd[0][2] == 0.0
    assert langid.predict_languages(documents(), model).count() == 0
    nothing = langid.fit_languages(documents((1, "text")))
    assert rows(langid.predict_languages(documents((1, "text")), nothing), "doc_id", "lang_pred") == [(1, "und")]


def test_mixture_finds_both_languages():
    rng = np.random.default_rng(0)
    words = np.zeros((60, 3))
    words[:40, 0] = words[40:, 1] = 5
    words += rng.normal(size=words.shape) * 0.1
    share, chosen = langid.language_set(words)
    assert chosen == [0, 1] and abs(share[0] - 2 / 3) < 0.05


def test_toxicity_on_held_out_labels(spark, documents):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit_toxicity(docs.where(~held), labels.where(~held))
    got = toxicity.score_toxicity(docs.where(held), model).join(labels, "doc_id").toPandas()
    y, s = got["toxic"].to_numpy() == 1, got["score"].to_numpy()
    rank = s.argsort().argsort() + 1
    area = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert area > 0.9 and (s >= 0).all() and (s <= 1).all()
    odd = toxicity.score_toxicity(documents((1, None), (2, ""), (2, "")), model).collect()
    assert len(odd) == 3 and all(r["predicted"] == 0 for r in odd)
    assert toxicity.score_toxicity(documents(), model).count() == 0


def test_negative_part_of_the_risk_is_held_at_zero():
    """Positives that fill the unlabelled sample would make the plain estimate negative."""
    document = np.arange(40)
    cell = np.where(document < 20, 1, 2)
    positive = toxicity.Rows(np.arange(20), np.ones(20, np.int64), np.ones(20, np.float32), 20)
    unlabelled = toxicity.Rows(document, cell, np.ones(40, np.float32), 40)
    w, bias = toxicity.train_pu(positive, unlabelled, 0.5, toxicity.PuSettings(epochs=20, batches=2))
    assert np.isfinite(w).all() and w[1] + bias > w[2] + bias


def test_toxicity_keeps_the_unpacked_sample_small(spark):
    rng = np.random.default_rng(9)
    texts = [(i, " ".join(f"w{w}" for w in rng.integers(0, 10000, 6000))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int")
    tracemalloc.start()
    toxicity.fit_toxicity(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 56 << 20  # 37 MB; 78 MB when the whole sample was unpacked at once


def test_staged_windows_go_before_the_next_table_is_made(documents, monkeypatch):
    """No step of the passages holds the tables of the steps before the last one."""
    held, beside = {}, {}
    stage, discard = windows.stage, windows.discard

    def staged(df, name):
        beside[name] = set(held.values())
        out, path = stage(df, name)
        held[path] = name
        return out, path

    def dropped(spark, *paths):
        for path in paths:
            held.pop(path, None)
        discard(spark, *paths)

    monkeypatch.setattr(windows, "stage", staged)
    monkeypatch.setattr(windows, "discard", dropped)
    line = " ".join(f"w{i}" for i in range(80))
    windows.repeated_passages(documents((1, line), (2, line + " end"), (3, "start " + line))).count()
    assert "digests" not in beside["runs"]
    assert not {"runs", "windows"} & beside["promising"]
    assert not {"labels", "windows"} & beside["pairs"]
    assert set(held.values()) == {"passages"}
