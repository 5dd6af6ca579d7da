"""Operators that judge texts one by one, against brute force and their awkward inputs."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowgrid.llm import bpe, html_blocks, html_extract, html_pages, packing, quality_rules, secrets

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n", "word", "a  b\n\n c \t", "don't! it's a!!'s b", "<|endoftext|>hi<|endoftext|> <|startoftext|>", "漢字 と かな", "é É İ Σ ΟΔΟΣ", "a\x1cb \x1d c", "voilà mot à   la", "x\x85 y\xa0 z", "😀😀 👍🏽 x", "ﬁ ǅ ß ſ K", "to be or " * 4000, "xyz " * 60 + "end.", "same line here\nsame line here\nother line here"]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward texts, two rows of one document, clashing columns."""
    rows = [(k, t, "en" if k % 3 else None, "s", 1, True, "x") for k, t in enumerate(ODD)]
    rows.append(rows[7])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept boolean, `_row` string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base_measures(t):
    w = words(t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if often[g] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (t or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, odd):
        texts = {r["doc_id"]: r["text"] for r in table.collect()}
        for r in quality_rules.quality_rules(table).collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_measures(texts[r["doc_id"]])
            assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_keeps_good_and_rejects_poor(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules.quality_rules(docs).join(labels, "doc_id").toPandas()
    good = got[(got.quality == 1) & ~got.base_failed]
    assert good.kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.01


def test_quality_stage_keeps_columns(odd):
    kept = quality_rules.apply_quality_rules(odd)
    assert kept.columns == odd.columns
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_byte_encoding(spark, odd, none):
    library = Tokenizer.from_file(BYTE)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, odd):
        texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        for r in bpe.encode_digests(table, BYTE).collect():
            ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    got = {r["doc_id"]: r for r in bpe.encode_texts(odd, BYTE).collect()}
    assert got[5]["ids"] == library.encode(ODD[5], add_special_tokens=False).ids and got[5]["decoded"] == ODD[5] and got[0]["ids"] == []
    assert bpe.encode_digests(none, BYTE).count() == 0


@pytest.fixture(scope="module")
def encoders():
    return [(bpe.Encoder(p, lambda ids, _: ids, memo_entries=50), Tokenizer.from_file(p)) for p in (BYTE, WORD)]


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(list(" \n'abTHEs.,!%é1|<>")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoders_equal_the_library(encoders, text):
    for ours, library in encoders:
        assert [i for f in ours.fragments(text) for i in f] == library.encode(text, add_special_tokens=False).ids


def test_forced_boundaries_are_in_no_token():
    v = bpe.Vocabulary(BYTE)
    pieces = v.forced(b"thequickzqxjword")
    assert b"".join(pieces) == b"thequickzqxjword" and len(pieces) > 1
    assert not any(a[-1:] + b[:1] in token for a, b in zip(pieces, pieces[1:], strict=False) for token in v.ranks)


def test_packing(spark, odd, none):
    library = Tokenizer.from_file(WORD)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    table = docs.union(odd.filter("doc_id <> 7").selectExpr("doc_id + 100000", "text"))
    got = packing.pack_documents(table.repartition(3), WORD).toPandas()
    for r in table.collect():
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        at = 0
        for p in got[got.doc_id == r["doc_id"]].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) // 4
            assert p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert 4 * at == len(ids)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.max() <= 2048 and all(n & (n - 1) == 0 for n in sizes)
    assert packing.pack_documents(none, WORD).count() == 0


def test_words_of_any_case_and_punctuation_are_encoded_once():
    library = Tokenizer.from_file(WORD)
    e = bpe.Encoder(WORD, bpe._pack_binary, memo_entries=50)
    for t in ("Word word WORD", "word. Word, (word) it's IT'S", "x" * 300 + " aB1c2", "A <|endoftext|> B <|Endoftext|>", "ÄRGER İx Straße words", "\x1cA b", "zzqx" * 15 + "A " * 200):
        ids = np.frombuffer(b"".join(e.fragments(t)), "<u4").tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids, t
    e = bpe.Encoder(WORD, bpe._pack_binary)
    e.fragments("Word word WORD word. (Word)")
    assert set(e.memo[""]) == {"word", "word.", "(word)"} and "word" in e.words


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(0, window=10)
    p.count[[3, 6]] = [2, 1]
    # New at 4: +1. Onto 3, making 7: +1 - 3 = -2. Onto 6, which it fills: -1.
    assert p.level_for(4) == 3
    p.count[3] = 1
    assert p.level_for(4) == 6  # -1 against 0
    r = np.random.default_rng(0)
    p = packing.SumOfSquares(0, window=64, most_open=8)
    for k in range(500):
        p.add(k, bytes(4 * int(r.integers(1, 150))))
    p.drain()
    sizes = Counter()
    for _, _, n, _, _, s, _ in p.take():
        sizes[s] += n
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes.values()) and sum(n < 64 for n in sizes.values()) <= 6


def test_blocks():
    page = "<title>T &amp; U</title><nav><a href=x>Go</a></nav><div class='main Text'><p>One<b>two<br>three<p>four &lt;&copy<script>var t='</p>'</script> five</div><!-- no --><ul><li>a<li>b</ul><noscript>x</noscript>tail<"
    title, blocks = html_blocks.leaf_blocks(page)
    assert title == "T & U"
    assert [b.text for b in blocks] == ["Go", "Onetwo three", "four <© five", "a", "b", "tail<"]
    assert blocks[1].path == ("div main text", "p") and blocks[0].link_chars == 2
    for broken in ("", "<", "<p", "<p title='x", "</p></div>", "<script>", "a<!--b", "<p>" * 3000 + "x"):
        html_blocks.leaf_blocks(broken)


def test_extraction(spark):
    crf = html_extract.trained()
    held_out = html_pages.labelled_pages(150, seed=31)
    assert np.mean([crf.main_text(p) == main for p, main in held_out]) > 0.93
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A title here</h1><p>Some  text &amp; more.</p><p>It ends.</p></article><footer>&copy; us</footer>")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_text(pages).collect()}
    text = "A title here\nSome text & more.\nIt ends."
    assert got == {1: ("", 0), 2: ("", 0), 3: (text, len(text))}
    assert html_extract.extract_text(pages.filter("false")).count() == 0


NOTICE = "This website uses cookies and similar technologies to improve your visit, to measure how the site is used and to show personalised content. By continuing you consent to our use of cookies. You can read more about cookies and withdraw your consent at any time in our privacy policy. "
STORY = ["The bridge opens again", "After two years of work the old bridge over the river opens again on Sunday, the town council said.", "Some residents had asked for privacy screens, and the baker hands out a cookie to every child who crosses first.", "The cost rose from three to five million, of which the state pays half."]


@pytest.mark.parametrize("size", [96, 250, 399, 401, 581, 900, 2000])
@pytest.mark.parametrize("wrap", ["<div><p>{}</p></div>", "<div>{}</div>", "<p>{}</p>"])
def test_notices_of_any_length_go(size, wrap):
    crf = html_extract.trained()
    notice = wrap.format((NOTICE * 8)[:size])
    article = f"<article><h1>{STORY[0]}</h1>" + "".join(f"<p>{x}</p>" for x in STORY[1:]) + "</article>"
    for body in (notice + article, article + notice, f"<div>{notice}</div><div>{article}</div>"):
        assert crf.main_text(f"<html><head><title>{STORY[0]}</title></head><body>{body}</body></html>").split("\n") == STORY


# Pages laid out by hand, each with the lines that a reader would call its article.
_P = "".join(f"<p>{x}</p>" for x in STORY[1:])
HAND = [
    (f"<body><header><a href=/>Town News</a></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>Sport</a></ul></nav><main><h1>{STORY[0]}</h1>{_P}</main><footer>&copy; 2024 Town News. All rights reserved.</footer></body>", STORY),
    (f"<table><tr><td class=menu><a href=/x>Home</a><br><a href=/y>News</a></td><td class=content><h2>{STORY[0]}</h2>{_P}</td></tr></table><div id=footer><a href=/i>Imprint</a> | <a href=/p>Privacy policy</a></div>", STORY),
    (f"<div id=wrapper><div class='post entry'><h1>{STORY[0]}</h1>{_P}<div class='share-buttons'><a href=#>Share</a> <a href=#>Tweet</a></div></div><div id=comments><h3>2 comments</h3><div class=comment><b>Ann</b> says: <p>I walked over it this morning and it is beautiful.</p></div><div class=comment><b>Bo</b><p>At last, it took long enough.</p></div></div></div>", STORY),
    (f"<article><h1>{STORY[0]}</h1><p>{STORY[1]}</p><aside class=related><h4>Related</h4><ul><li><a href=/1>Road works end</a><li><a href=/2>Ferry stops</a></ul></aside><p>{STORY[2]}</p><div class=advertisement>Buy now and save</div><p>{STORY[3]}</p></article><form class=newsletter><label>Subscribe to our newsletter</label><input><button>Go</button></form>", STORY),
    (f"<div class=cookie-banner><p>{NOTICE}</p><button>Accept</button></div><section class=story><h1>{STORY[0]}</h1>{_P}</section><script>var x = '<p>not text</p>';</script><style>p{{}}</style>", STORY),
    ("<body><nav><a href=/>Home</a></nav><footer>&copy; us</footer></body>", []),
]


@pytest.mark.parametrize("number", range(len(HAND)))
def test_hand_laid_pages(number):
    page, lines = HAND[number]
    assert html_extract.trained().main_text(page).split("\n") == (lines or [""])


def test_deep_pages_are_read_in_one_pass():
    def seconds(n):
        at = time.perf_counter()
        html_blocks.leaf_blocks("<div>" * n + "<td></b></p>" * n + "x" + "</div>" * n)
        return time.perf_counter() - at

    seconds(100)
    assert min(seconds(16_000) for _ in range(3)) < 12 * max(1e-3, min(seconds(2_000) for _ in range(3)))  # quadratic: 64


def test_viterbi_is_the_best_labelling():
    crf = html_extract.trained()
    title, blocks = html_blocks.leaf_blocks(html_pages.labelled_pages(1, seed=5)[0][0])
    blocks = blocks[:9]
    scores = crf._scores(title, blocks)

    def total(labels):
        return sum(s * y for s, y in zip(scores, labels, strict=True)) + sum(crf.step[a][b] for a, b in zip(labels, labels[1:], strict=False))

    every = [[m >> k & 1 for k in range(len(blocks))] for m in range(1 << len(blocks))]
    assert total(crf.decode(title, blocks)) == pytest.approx(max(map(total, every)))


SECRET = "tok_" + "q7Zr2LxP9vKd3MwB8nTy"
TEXTS = [f'password = "{SECRET}" here', f"x api-key and API_KEY:{SECRET}", "token = example_example_1 0123456789abcdef0123", "AKIA" + "Z9" * 8 + " and AKIAshort", "token: secret: abcdefghijklmnopqrs", "é" * 5 + " deadbeefdeadbeef00", None, "", "ghp_" + "aB3" * 13]


def brute_spans(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets(spark):
    # The third text is copied by many owners.
    rows = [(k, t, f"own{k}") for k, t in enumerate(TEXTS)] + [(100 + k, TEXTS[2], f"o{k}") for k in range(5)] + [(200, TEXTS[5], None), (3, TEXTS[3], "own3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.secret_scan(docs).collect()}
    for k, t, _ in rows:
        spans = brute_spans(t or "")
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in spans).encode()).hexdigest()
        assert (got[k]["n_assign"], got[k]["n_access"], got[k]["n_hex"]) == tuple(sum(s[2] == n for s in spans) for n in ("assign", "access", "hex"))
    assert got[0]["n_live"] == 1 and got[2]["n_examples"] == 2 and got[2]["n_live"] == 0 and got[4]["n_assign"] == 0
    assert got[8]["spans"] == "hosted:0:43"
    assert secrets.secret_scan(docs.filter("false")).count() == 0
    clean = secrets.redact_secrets(docs).toPandas()
    assert list(clean.columns) == docs.columns and len(clean) == len(rows)
    of = dict(zip(clean.doc_id, clean.text, strict=True))
    assert SECRET not in of[0] and of[0].startswith("[SECRET]") and of[2] == TEXTS[2] and of[6] is None


@pytest.mark.parametrize("copies", [1, 19, 20, 200, 2000])
def test_copies_of_one_owner_are_no_example(spark, copies):
    rows = [(k, f"password = {SECRET}", "one") for k in range(copies)] + [(90_000 + k, "token: kX9vQ2mT7rL4wZ8p", f"owner{k}") for k in range(3)] + [(99_000, None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = secrets.secret_scan(docs).collect()
    assert {(r["most_owners"], r["most_repos"], r["n_examples"], r["n_live"]) for r in got if r["doc_id"] < 90_000} == {(1, copies, 0, 1)}
    assert {(r["most_owners"], r["most_repos"], r["n_examples"], r["n_live"]) for r in got if 90_000 <= r["doc_id"] < 99_000} == {(3, 3, 1, 0)}
    assert [(r["most_owners"], r["most_repos"]) for r in got if r["doc_id"] == 99_000] == [(0, 0)]
    texts = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs).collect()}
    assert all(("[SECRET]" in t) == (k < 90_000) for k, t in texts.items() if t)


def test_verdicts_by_brute_force(spark):
    r = random.Random(3)
    values = ["".join(r.choices("abcdefghkmnpqrstuvwxyzABCDEFGH23456789", k=24)) for _ in range(12)] + ["example_value_1", "000000000000", "aaaaaaaaaaaaaaaa"]
    rows = []
    for k in range(400):
        held = [values[min(int(r.expovariate(0.2)), 14)] for _ in range(r.randint(0, 3))]
        rows.append((k % 350, "\n".join(f"secret: {v}" for v in held), r.choice([None, "a", "b", "b", "b"] if "".join(held[:1]) in values[:6] else [*"abcdef", None])))
    owners = {}
    for _, t, o in rows:
        for v in re.findall(r"secret: (\S+)", t):
            owners.setdefault(v, set()).update([o] if o else [])
    live = lambda v: secrets.looks_live(v) and len(owners[v]) < 3
    want = sorted((k, sum(live(v) for v in re.findall(r"secret: (\S+)", t)), max([len(owners[v]) for v in re.findall(r"secret: (\S+)", t)], default=0)) for k, t, _ in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert sorted((x["doc_id"], x["n_live"], x["most_owners"]) for x in secrets.secret_scan(docs).collect()) == want
    clean = sorted((x["doc_id"], x["text"]) for x in secrets.redact_secrets(docs).collect())
    # The mark takes the place of the whole assignment.
    assert clean == sorted((k, "\n".join("[SECRET]" if live(v) else f"secret: {v}" for v in re.findall(r"secret: (\S+)", t))) for k, t, _ in rows)


def test_fragments_are_joined_from_words():
    library = Tokenizer.from_file(WORD)
    for pack, plain in ((bpe._pack_binary, lambda f: np.frombuffer(b"".join(f), "<u4").tolist()), (bpe._pack_decimal, lambda f: [int(i) for x in f if x[0] for i in x[0].split(",")])):
        encoder = bpe.Encoder(WORD, pack)
        for text in ("Tree, (tree) tree. TREE's 'tree", "Été, (été) été. Étés' IT'S 19 ª", "été Жд, (été) 中 tree. Жд's a\xa0b", "don't've 'Tis 'D \x00 \x7f a_b", "tree <|x été"):
            assert plain(encoder.fragments(text)) == library.encode(text, add_special_tokens=False).ids, text
        # Neither the Unicode pattern nor ids of whole fragments are needed for ASCII words.
        encoder.split = encoder.ids = None
        assert plain(encoder.fragments("new, (new) words. It's 'new' 42!")) == library.encode("new, (new) words. It's 'new' 42!", add_special_tokens=False).ids
