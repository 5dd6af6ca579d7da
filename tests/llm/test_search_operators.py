"""Lexical search, resampling and language identification, against brute force and awkward inputs."""

import hashlib
import math
import random
import re
import timeit
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from oracle import duck, same

from flowgrid.llm import importance, language_id, lexical, registry

FOLD = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", ["op12_treap_search", "op13_importance"])
def test_query_equals_oracle(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], duck(SF))


def prose(r, n, alphabet="abcdefgh"):
    return " ".join("".join(r.choices(alphabet, k=r.randint(1, 3))) for _ in range(n))


AWKWARD = [
    (900, None), (901, ""), (902, "...---..."), (903, "Été ÉTÉ été2\x00x"), (904, "a"), (905, "A a\nA"), (906, "ab cd"), (907, "语言 模型 语言"), (908, "x" * 3000),
]


def brute_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counts = [(i, Counter(term.findall((t or "").translate(FOLD)))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(term.findall((text or "").translate(FOLD)))
    for item, terms in asked.items():
        scored = []
        for (i, c), size in zip(counts, lengths, strict=True):
            m = 50 + 50 * size * n // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0 and i is not None:
                scored.append((-score, i))
        out[item] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def test_ranked_search(spark, monkeypatch):
    r = random.Random(3)
    docs = [(k, prose(r, r.choice([1, 5, 40, 200]))) for k in range(400)]
    copy = prose(r, 30)
    docs += [(1000 + k, copy) for k in range(150)]  # ties, more than are asked for
    docs += [*AWKWARD, (7, "twice the same id ab"), (None, "ab ab ab")]
    items = [(k, prose(r, 12)) for k in range(12)] + [(50, copy), (51, None), (52, "!!"), (53, "unheardof"), (50, "语言 x2"), (None, "ab"), (54, " ".join(t or "" for _, t in docs[:200]))]
    d = spark.createDataFrame([(i, t, 1, "s", 2.0) for i, t in docs], "doc_id long, text string, score int, term string, rank double").repartition(3)
    q = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, w string").repartition(2)
    want = {i: rows for i, rows in brute_search(docs, [x for x in items if x[0] is not None], 20).items() if rows}

    def got(**given):
        found = {}
        for x in lexical.ranked_search(d, q, k=20, **given).collect():
            found.setdefault(x["item_id"], []).append((x["rank"], x["doc_id"], x["score"]))
        return {i: sorted(rows) for i, rows in found.items()}

    assert got() == want
    assert got(block_terms=20) == want  # several passes over the postings
    assert lexical.ranked_search(d.filter("false"), q).count() == 0
    assert lexical.ranked_search(d, q.filter("false")).count() == 0


def treaps_of(r, n_terms, n_docs):
    held = sorted({(r.randrange(n_terms), r.randrange(n_docs)) for _ in range(n_terms * n_docs // 2)})
    terms, docs = (np.array(x) for x in zip(*held, strict=True))
    impacts = np.array([r.choice([1, 5, 5, 5, r.randrange(1, 1000)]) for _ in held])
    return terms, docs, impacts, lexical.Treaps(terms, docs, impacts, n_terms, n_docs)


def test_treaps_are_search_trees_and_heaps():
    r = random.Random(8)
    terms, docs, impacts, treaps = treaps_of(r, 6, 90)

    def walk(node):
        if node == treaps.none:
            return []
        for below in (treaps.left[node], treaps.right[node]):
            assert below == treaps.none or impacts[below] <= impacts[node]
        return [*walk(treaps.left[node]), node, *walk(treaps.right[node])]

    for t in range(6):
        assert walk(treaps.roots[t]) == np.flatnonzero(terms == t).tolist()
    # Equal impacts make no chain.
    flat = lexical.Treaps(np.zeros(5000, np.int64), np.arange(5000), np.ones(5000, np.int64), 1, 5000)

    def depth(node):
        level, n = [node], 0
        while level:
            level, n = [b for x in level for b in (flat.left[x], flat.right[x]) if b != flat.none], n + 1
        return n

    assert depth(flat.roots[0]) < 60


@pytest.mark.parametrize("frontier", [1 << 21, 8])
def test_traversal_finds_the_best_and_leaves_the_rest(monkeypatch, frontier):
    monkeypatch.setattr(lexical, "FRONTIER", frontier)
    r = random.Random(9)
    for _ in range(20):
        terms, docs, impacts, treaps = treaps_of(r, 8, 300)
        asked = np.array(sorted(r.sample(range(8), r.randint(1, 8))))
        score = np.zeros(300, np.int64)
        for t, d, w in zip(terms, docs, impacts, strict=True):
            score[d] += w * (t in asked)
        best = lexical.Best(10, np.zeros(0, np.int64), np.zeros(0, np.int64), ids=np.arange(300) * 3)
        seen = []
        offer = best.offer
        best.offer = lambda s, d: (seen.extend(d), offer(s, d))
        treaps.search(asked, best)
        order = np.lexsort((np.arange(300), -score))[:10]
        order = order[score[order] > 0]
        assert best.docs.tolist() == (order * 3).tolist() and best.scores.tolist() == score[order].tolist()
        assert len(seen) == len(set(seen))  # every document at most once
    # A threshold that nothing reaches is seen at the roots.
    best.least, seen[:] = 10**9, []
    treaps.search(asked, best)
    assert not seen


def brute_features(text, buckets):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1))


def brute_resample(docs, target, buckets=10_000, least=20, percent=5):
    each = [(i, *brute_features(t, buckets)) for i, t in docs]
    s, t = sum((c for *_, c in each), Counter()), sum((brute_features(x, buckets)[1] for x in target), Counter())
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, c in each:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = able[: percent * len(able) // 100]
    return sorted(((*r[:1], *r[2:], drawn.index(r) + 1 if r in drawn else None) for r in rows), key=repr)


def test_importance_resample(spark):
    r = random.Random(4)
    docs = [(k, prose(r, r.choice([3, 19, 20, 80]))) for k in range(300)] + AWKWARD + [(None, prose(r, 25))]
    target = [prose(r, 30, "abc") for _ in range(20)] + [None, ""]
    d = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, weight int, buckets string").repartition(3)
    aimed = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    want = brute_resample(docs, target)
    for piece in (1 << 20, 40):  # texts in pieces of 40 characters, of which runs of words cross the ends
        got = importance.importance_resample(d, aimed, piece=piece)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert importance.importance_resample(d.filter("false"), aimed).count() == 0
    none = importance.importance_resample(d, aimed.filter("false"))
    assert sorted(map(tuple, none.collect()), key=repr) == brute_resample(docs, [])
    # The draw prefers what looks like the target.
    liked = [x for x in importance.importance_resample(d.union(spark.createDataFrame([(5000 + k, prose(r, 60, "abc"), 1, "") for k in range(30)], d.schema)), aimed, percent=10).filter("rank is not null").collect()]
    assert len(liked) > 10 and sum(x["doc_id"] >= 5000 for x in liked) > 0.8 * len(liked)


def test_crc_of_grams():
    def sliced(grams):
        at = np.frombuffer(grams.buffers()[1], np.int32).tolist()
        text = grams.buffers()[2].to_pybytes()
        return np.fromiter(map(zlib.crc32, map(text.__getitem__, map(slice, at, at[1:]))), np.uint32, len(grams))

    r = random.Random(2)
    grams = pa.array([prose(r, 1 + k % 3) + "é" * (k % 2) for k in range(2048)] + [""])
    want = [zlib.crc32(x.encode()) for x in grams.to_pylist()]
    assert importance._crc(grams).to_pylist() == want == sliced(grams).tolist()
    assert importance._crc(pa.chunked_array([grams[5:9], grams[:3]])).to_pylist() == want[5:9] + want[:3]
    assert importance._crc(pa.array(["a", None])).to_pylist() == [zlib.crc32(b"a"), 0] and not len(importance._crc(pa.array([], pa.string())))

    def least(f):  # seconds for the same grams
        return min(timeit.repeat(lambda: f(grams), number=20, repeat=7))

    assert least(importance._crc) < 0.8 * least(sliced)


def test_pieces_keep_all_runs_of_words():
    r = random.Random(6)
    for size in (1, 7, 30, 10_000):
        text = " ".join(prose(r, 3) + r.choice(["", "!", "  ", "É" * 40]) for _ in range(30))
        parts = list(importance._pieces(text, size))
        whole = importance._merged(importance._count(parts, 997), 997).to_pylist()[0]
        n, c = brute_features(text, 997)
        assert (whole["n_words"], whole["n_features"], dict(zip(whole["buckets"], whole["counts"], strict=True))) == (n, sum(c.values()), dict(c))


def brute_grams(text, size=4):
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not letters.strip():
        return []
    t = (" " + " ".join(letters.split()) + " ").ljust(size)
    return [t[i : i + size] for i in range(len(t) - size + 1)]


def hashed(grams):
    return language_id._hashed(np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32), len(grams[0]))[:: len(grams[0])] if grams else np.zeros(0, np.uint64)


def test_grams_of_whole_texts():
    r = random.Random(2)
    texts = ["", "...", "a", "Ab", "ab, cd--É", " x ", "语言模型", "a\x00b", *["".join(r.choices("abÉ .,\n7", k=r.randint(1, 60))) for _ in range(300)]]
    for t in texts:
        want = hashed(brute_grams(t))
        for chunk in (1 << 20, 1, 5):
            parts = list(language_id.gram_hashes(t, chunk=chunk))
            assert np.array_equal(np.concatenate(parts) if parts else np.zeros(0, np.uint64), want), (t, chunk)


def syllables(r, known, n):
    return " ".join("".join(r.choices(known, k=r.randint(1, 4))) for _ in range(n))


LANGUAGES = {"aa": ["th", "er", "on", "an", "in", "ou"], "bb": ["sch", "ung", "en", "er", "ie"], "cc": ["ción", "os", "que", "ar", "en"], "dd": ["eau", "oi", "é", "le", "on"]}


def test_filter_holds_what_is_frequent(spark):
    r = random.Random(7)
    rows = [(k, syllables(r, LANGUAGES[lang], 60), lang) for k, lang in enumerate([*LANGUAGES] * 40)]
    rows += [(5000 + k, syllables(r, LANGUAGES["aa"], 60), "bb") for k in range(2)]  # under a wrong label
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counts = {x: Counter(g for _, t, lang in rows if lang == x for g in brute_grams(t)) for x in LANGUAGES}
    rate = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    want = {x: {g for g, v in c.items() if v >= 1e-3 and v >= 0.1 * max(o.get(g, 0) for o in rate.values())} for x, c in rate.items()}
    every = sorted(set().union(*counts.values()))
    for bits in (16, 9):
        learned = language_id.fit_languages(docs, slot_bits=bits, least_rate=1e-3)
        assert learned.languages == sorted(LANGUAGES, key=lambda x: (-sum(counts[x].values()), x))
        table = learned.dense()
        found = learned.containing(table, hashed(every))
        wrong = learned.false_positives(table)
        for k, x in enumerate(learned.languages):
            has = {g for g, b in zip(every, language_id._bit(found, k), strict=True) if b}
            assert want[x] <= has  # none is lost
            lacks = len(set(every) - want[x])
            assert abs(len(has - want[x]) - lacks * wrong[k]) <= 6 * (lacks * wrong[k]) ** 0.5 + 3  # as many too much as the fill says
    # A crowded filter's counts are set right.
    n = np.array([1000])
    true, wrong = np.array([[600, 500]]), np.array([0.1, 0.6])
    seen = true + (n - true) * wrong
    assert seen[0].argmax() == 1 and language_id.decide(seen, n, wrong)[0][0] == 0


def test_languages_of_documents(spark):
    r = random.Random(8)
    rows = [(k, syllables(r, LANGUAGES[lang], r.choice([4, 30, 200])), lang) for k, lang in enumerate(["aa"] * 300 + ["bb", "cc", "dd"] * 60)]
    odd = [(9000, None, "aa"), (9001, "", "bb"), (9002, "12 -- 3", "cc"), (9003, "语言", "dd"), (None, syllables(r, LANGUAGES["cc"], 30), None), (9004, syllables(r, LANGUAGES["dd"], 30), None), (9004, "z" * 5000, "aa")]
    docs = spark.createDataFrame([(*x, "bb", 3, 0.5) for x in rows + odd], "doc_id long, text string, lang string, lang_pred string, n int, score double").repartition(4)
    got = [tuple(x) for x in language_id.language_id(docs).collect()]
    assert len(got) == len(rows) + len(odd)
    of = {x[0]: x for x in got if x[0] != 9004}
    for k, _, lang in rows:
        held = zlib.crc32(str(k).encode()) % 4 == 2
        assert of[k][1:3] == (held, lang) and 0 < of[k][3] <= 1
    assert all(of[k][2:] == ("und", 0.0) for k in (9000, 9001, 9002))
    assert of[9003][2:] == ("aa", 0.0) or of[9003][3] > 0  # known from its one document, if that isn't held out
    assert of[None][1:3] == (False, "cc") and "dd" in [x[2] for x in got if x[0] == 9004]
    assert language_id.language_id(docs.filter("false")).count() == 0
    untaught = language_id.language_id(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("lang = 'x' or doc_id = 5"))
    assert {x["lang_pred"] for x in untaught.collect()} <= {"und", ""}


def test_held_out_accuracy(spark):
    found = registry.queries()["op11_language_id"](spark, SF).collect()
    table = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(found) == len(table)
    tested = [(r["lang_pred"], table[r["doc_id"]]["lang"]) for r in found if r["held_out"] and re.search(r"[^\W\d_]", table[r["doc_id"]]["text"] or "")]
    assert len(tested) > 20 and sum(a == b for a, b in tested) >= 0.99 * len(tested)
