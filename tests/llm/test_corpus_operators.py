"""Operators over the whole corpus, against brute force and their awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from oracle import duck, rows
from pyspark.sql import functions as F

from flowgrid.llm import components, kneser_ney, line_dedup, near_dedup, registry, secrets, shingles, substring_dedup, topk


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_lines(table):
    first = {}
    split = {k: (t or "").split("\n") for k, t in table}
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    for k, parts in split.items():
        for p in parts:
            if len(key(p)) >= 10:
                first[key(p)] = min(k, first.get(key(p), k))
    return {k: [p for p in parts if first.get(key(p), k) == k] for k, parts in split.items()}, split


def test_line_dedup(spark, documents):
    table = [(r["doc_id"], r["text"]) for r in documents.collect()]
    table += [(9001, None), (9002, ""), (9003, "A Common  LINE here\n\n a common  line here \nÉcole Été Où\tx"), (9004, "a common  line here\nÉCOLE ÉTÉ OÙ\tx\nshort"), (9005, "short\nA common  line here\nA common  line here")]
    docs = spark.createDataFrame([(k, t, 7, "b") for k, t in table], "doc_id long, text string, n_lines int, `h` string")
    want, split = brute_lines(table)
    for batches in (1, 5):
        got = line_dedup.line_dedup(docs, batches=batches)
        assert got.columns == ["doc_id", "text", "h", "n_lines", "n_dropped"]
        for r in got.collect():
            k = r["doc_id"]
            assert (r["text"] or "") == "\n".join(want[k])
            assert (r["n_lines"], r["n_dropped"]) == (len(split[k]), len(split[k]) - len(want[k]))
    assert line_dedup.line_dedup(docs.filter("false")).count() == 0
    # Repeated rows of a document keep its lines; a row without an id gives way to all others.
    again = spark.createDataFrame([(1, "some long line"), (1, "some long line"), (None, "some long line\nmine alone, too")], "doc_id long, text string")
    assert sorted(r["n_dropped"] for r in line_dedup.line_dedup(again).collect()) == [0, 0, 1]


def test_runs_are_levelled(spark):
    store = line_dedup.LineRuns(spark, 2, fan_out=2)
    for k in range(5):
        store.add(spark.createDataFrame([(bytes([k]), k)], "h binary, first_doc long"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert sorted(r["first_doc"] for run in store.runs() for r in run.collect()) == [0, 1, 2, 3, 4]
    store.clear()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("flowgrid_run")]


def test_run_has_one_file_a_bucket(spark, monkeypatch):
    # However many partitions a session deals rows out to by a key: else a run has tasks x buckets files.
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols, f=frame.repartition: f(self, max(13, n) if isinstance(n, int) and cols else n, *cols))
    conf = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        store = line_dedup.LineRuns(spark, 3)
        for b in (0, 1):
            store.add(spark.range(400 * b, 400 * b + 400).selectExpr("unhex(md5(cast(id as string))) as h", "id as first_doc"))
        (run,) = store.runs()
        files = [re.search(r"_(\d+)\.", f.rsplit("/", 1)[-1])[1] for f in run.inputFiles()]
        assert sorted(map(int, files)) == [0, 1, 2]
        assert sorted(r["first_doc"] for r in run.collect()) == list(range(800))
        store.clear()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def brute_classes(table, threshold=0.8):
    sets = {}
    for k, t in table.items():
        w = words(t)
        n = min(5, len(w))
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()
    holders, common = defaultdict(list), Counter()
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    for ks in holders.values():
        common.update((a, b) for i, a in enumerate(ks) for b in ks[:i])
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= threshold:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_near_duplicates(spark, documents):
    r = random.Random(5)
    table = {k: t for k, t in ((x["doc_id"], x["text"]) for x in documents.collect())}
    base = prose(r, 150).split()
    for k in range(60):  # a large group of near copies, many of which differ from each other by more
        w = base[:]
        for _ in range(3):
            w[r.randrange(len(w))] = "changed%d" % r.randrange(1000)
        table[5000 + k] = " ".join(w)
    passage = prose(r, 40)
    for k in range(40):  # one passage in different texts
        table[6000 + k] = passage + " " + prose(r, 40)
    table |= {7000: "two words", 7001: "two words", 7002: "two  Words", 7003: "", 7004: None, 7005: " \n"}
    docs = spark.createDataFrame([(k, t, "x") for k, t in table.items()], "doc_id long, text string, node string").repartition(3)
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes(table)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {k for k, c in got.items() if k == c}
    assert near_dedup.near_duplicates(docs.filter("false")).count() == 0
    clash = spark.createDataFrame([(k, table[5000], 1, 2, "x") for k in (3, 1)], "doc_id long, text string, _gone int, class_id int, row string")
    assert [tuple(x)[0] for x in near_dedup.drop_near_duplicates(clash).collect()] == [1]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    h = shingles.mix(np.arange(1, 400, dtype=np.uint64))
    wa, wb = r.integers(1, 4, 300), r.integers(1, 4, 300)
    a, b = (h[:300], wa), (h[60:360], wb)
    _, want = shingles.similarity(a, b)
    got = np.mean(near_dedup.prob_min_hash(*a, 4096) == near_dedup.prob_min_hash(*b, 4096))
    assert abs(got - want) < 4 * math.sqrt(want * (1 - want) / 4096)


def test_probability_jaccard():
    x, y = np.array([1.0, 2, 0, 3]), np.array([2.0, 1, 5, 0])
    h = np.arange(4, dtype=np.uint64)
    p, q = x / x.sum(), y / y.sum()
    want = sum(1 / sum(max(p[e] / p[d], q[e] / q[d]) for e in range(4)) for d in range(2))
    assert shingles.similarity((h[x > 0], x[x > 0]), (h[y > 0], y[y > 0]))[1] == pytest.approx(want)


def test_long_texts_hash_alike(monkeypatch):
    text = prose(random.Random(2), 500) + " " + "z" * 300 + " é\x0b end"
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "_CHUNK", 64)
    assert (shingles.word_hashes(text) == whole).all() and len(whole) == len(words(text))
    assert shingles.word_hashes("a b")[1] == shingles.word_hashes("xyz\tb")[1]


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 105), (101, 105), (200, 200)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 105: 100, 200: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_windows(values, bounds, least):
    out = set()
    for a, b in bounds:
        key = [(int(v) >> 24, i) for i, v in enumerate(values)]
        for i in range(a, b):
            lo = hi = i
            while lo > a and key[lo - 1] > key[i]:
                lo -= 1
            while hi + 1 < b and key[hi + 1] > key[i]:
                hi += 1
            if hi - lo + 1 >= least:
                out.add((lo, i, hi))
    return out


def test_compact_windows():
    r = np.random.default_rng(1)
    for trial in range(40):
        lengths = r.integers(1, 40, 4)
        values = r.integers(0, 2**63, lengths.sum()).astype(np.uint64)
        if trial % 3 == 0:
            values = values % np.uint64(5) << np.uint64(40)
        ends = np.cumsum(lengths)
        got = substring_dedup.compact_windows(values, np.repeat(np.arange(4), lengths), ends, 7)
        assert set(zip(*[x.tolist() for x in got], strict=True)) == brute_windows(values, list(zip(ends - lengths, ends, strict=True)), 7)


def test_repeated_passages(spark, documents):
    r = random.Random(9)
    passage, short = prose(r, 70), prose(r, 40)
    edited = passage.split()
    edited[35] = "another"
    table = {x["doc_id"]: x["text"] for x in documents.limit(60).collect()}
    table |= {900 + k: f"{prose(r, 60 + k)} {passage} {prose(r, 30)}" for k in range(12)}
    table |= {950: f"{prose(r, 80)} {' '.join(edited)}", 960: f"{prose(r, 80)} {short} {prose(r, 20)}", 961: f"{short} {prose(r, 90)}", 970: None, 971: "", 972: prose(r, 300)}
    docs = spark.createDataFrame([(k, t, 1) for k, t in table.items()] + [(None, passage, 1)], "doc_id long, text string, key int")
    got = substring_dedup.repeated_passages(docs).toPandas()
    named = set(got.doc_id)
    holders = defaultdict(set)
    for k, t in table.items():
        w = words(t)
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].add(k)
    exact = set().union(*[s for s in holders.values() if len(s) > 1])
    assert exact <= named and 950 in named and not named & {960, 961, 972}
    for x in got.itertuples():
        a, b = words(table[x.doc_id])[x.start_word :][: x.n_words], words(table[x.other_doc_id])[x.other_start_word :][: x.other_n_words]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(a & b) / len(a | b) == pytest.approx(x.similarity) and x.similarity >= 0.8
    assert substring_dedup.repeated_passages(docs.filter("false")).count() == 0


def test_passages_of_middle_documents(spark):
    # Two documents share 60 words, 40 of which stand in many others with smaller and greater ids.
    r = random.Random(11)
    table, pairs = {}, []
    for n in range(12):
        line = prose(r, 40 if n % 2 else 45)
        own = prose(r, 60 - len(line.split()))
        table |= {1000 * k + n: f"{prose(r, 60)} {line} {prose(r, 60)}" for k in (*range(10), *range(20, 30))}
        table |= {1000 * k + n: f"{prose(r, 60)} {line} {own} {prose(r, 60)}" for k in (12, 15)}
        pairs.append((12000 + n, 15000 + n))
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    got = substring_dedup.repeated_passages(docs).collect()
    of = {x["doc_id"]: x["class_id"] for x in got}
    assert all(of[a] == of[b] for a, b in pairs)
    assert not {k for k in table if k // 1000 not in (12, 15)} & set(of)


def test_recall_of_edited_passages(spark):
    r = random.Random(21)
    table, planted = {}, []
    for k in range(200):
        words_, edits = (60, 1) if k % 2 else (100, 2)
        p = prose(r, words_).split()
        q = p[:]
        for e in range(edits):
            q[(e + 1) * words_ // (edits + 1)] = "edited%d" % e
        table |= {2 * k: f"{prose(r, 40)} {' '.join(p)} {prose(r, 40)}", 2 * k + 1: f"{prose(r, 70)} {' '.join(q)} {prose(r, 20)}"}
        planted.append((2 * k, 2 * k + 1))
    twice = prose(r, 60)
    table |= {1000: f"{prose(r, 30)} {twice} {prose(r, 200)} {twice} {prose(r, 20)}", 1001: f"{twice} {prose(r, 50)}", 1002: f"{prose(r, 90)} {twice}"}
    table |= {2000 + k: prose(r, 150) for k in range(50)}
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string").repartition(4)
    got = substring_dedup.repeated_passages(docs).collect()
    of = {x["doc_id"]: x["class_id"] for x in got}
    caught = sum(a in of and of.get(a) == of.get(b) for a, b in planted) / len(planted)
    assert caught >= 0.9, caught
    assert not [k for k in of if k >= 2000] and len({of[k] for k in (1000, 1001, 1002)}) == 1
    assert {x["start_word"] for x in got if x["doc_id"] == 1000} == {30, 290}
    print("recall", caught)


def brute_passage(a, b, least, threshold=0.8):
    """Whether runs from shared to shared shingle of at least ``least`` are that similar."""
    ends = lambda x, y: [(i, j) for i in range(len(x)) for j in range(i + least, len(x) + 1) if x[i] in y and x[j - 1] in y]
    for i, j in ends(a, set(b)):
        for u, v in ends(b, set(a)):
            x, y = set(a[i:j]), set(b[u:v])
            if {a[i], a[j - 1]} <= y and {b[u], b[v - 1]} <= x and len(x & y) >= threshold * len(x | y):
                return True
    return False


def test_verified_passages_equal_brute_force():
    r = random.Random(4)
    new = lambda n: [r.getrandbits(60) for _ in range(n)]
    stream = lambda w: shingles.shingle_stream(np.array(w, np.uint64))

    def edited(p, edits, most):
        q = list(p)
        for _ in range(edits):
            i, kind = r.randrange(5, len(q) - 5), r.randrange(3)
            q[i : i + (kind > 0) * r.randint(1, most)] = new((kind < 2) * r.randint(1, most))
        return q

    # Words put into the middle, or cut from it, leave two runs that are too short by themselves.
    for n, k in ((50, 2), (60, 3), (70, 4), (80, 6), (98, 8)):
        p = new(n)
        q = p[: n // 2] + new(k) + p[n // 2 :]
        for x, y in ((p, q), (q, p)):
            found = substring_dedup.verify(stream(new(30) + x + new(30)), stream(new(20) + y + new(20)), 46)
            assert [f[:4] for f in found] == [(30, 26 + len(x), 20, 16 + len(y))]
            assert found[0][4] == pytest.approx((n - 8) / (n + k))
    seen = 0
    for _ in range(300):
        p = new(r.randint(60, 200))
        a, b = stream(p), stream(edited(p, r.randint(1, 4), 6))
        if min(len(a), len(b)) >= 46 and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            seen += 1
            assert substring_dedup.verify(stream(new(20) + p)[20:], b, 46)
            assert substring_dedup.verify(b, a, 46)
    assert seen > 50
    for _ in range(60):
        p = new(r.randint(14, 20))
        a, b = stream(new(r.randint(0, 3)) + p), stream(edited(p, r.randint(0, 2), 2) + new(r.randint(0, 3)))
        assert bool(substring_dedup.verify(a, b, 8)) == brute_passage(a.tolist(), b.tolist(), 8)


def test_top_k(spark):
    c = duck(SF)
    ours, theirs = registry.op8_top_k(spark, SF).toPandas(), c.sql(registry.OP8_SQL).df()
    assert rows(ours) == rows(theirs)
    bad = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [0.5, -0.25]), (7, [1.0, 2.0]), (8, [3.0]), (None, [1.0, 1.0])]
    v = topk.integer_vectors(spark.createDataFrame(bad, "vec_id long, embedding array<float>"))
    got = topk.exact_top_k(v, v.filter("vec_id = 1"), k=2, shard_rows=2).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(7, 5 * 2**20), (8, 3 * 2**20)]
    assert topk.exact_top_k(v.filter("false"), v.filter("false")).count() == 0


def test_max_score_equals_brute_force():
    r = np.random.default_rng(3)
    for sparse in (False, True):
        w = r.integers(-300, 300, (500, 32)).astype(float)
        if sparse:
            w *= r.random(w.shape) < 0.1
        w[100:120] = w[0]
        shard = topk.Shard(np.arange(500), w)
        for q in range(0, 500, 25):
            scores = w @ w[q]
            want = sorted((k for k in range(500) if k != q), key=lambda k: (-scores[k], k))[:10]
            got, found = shard.search(q, w[q], 10)
            assert got.tolist() == want and found.tolist() == scores[want].tolist()


def brute_kneser_ney(texts, order):
    counts = {order: Counter()}
    for t in texts:
        t = "\x02" * (order - 1) + t + "\x03"
        counts[order].update(t[k : k + order] for k in range(len(t) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in range(5)]
        out = []
        for k in (1, 2, 3):
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
            d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] and y is not None else 0.5 * k
            out.append(min(0.95 * k, max(0.05 * k, d)))
        return out

    d = {n: discounts(c) for n, c in counts.items()}
    cut = lambda n, c: d[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        mine = {h: c for h, c in counts[n].items() if h[:-1] == g[:-1]}
        below = p(g[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        if not mine:
            return below
        total = sum(mine.values())
        return (mine[g] - cut(n, mine[g]) if g in mine else 0) / total + sum(cut(n, c) for c in mine.values()) / total * below

    return p


def test_kneser_ney(spark):
    r = random.Random(1)
    make = lambda: " ".join(r.choice(["the", "cat", "sat", "on", "mats", "and", "hats"]) for _ in range(r.randint(5, 30)))
    texts = {k: make() for k in range(60)} | {70: "zqx vbw kkj qqq zzx", 71: None, 72: "", 73: "The  CAT\nsat 42"}
    docs = spark.createDataFrame([(k, t, "en", 1) for k, t in texts.items()] + [(80, "ohne Modell", "de", 1), (81, "sans langue", None, 1), (5, texts[5], "en", 1)], "doc_id long, text string, lang string, trusted int")
    trusted = spark.createDataFrame([(k,) for k in [*range(60), None]], "doc_id long")
    got = {x["doc_id"]: x for x in kneser_ney.quality_classifier(docs, trusted, order=3).collect()}
    held = {x["id"] for x in spark.range(60).filter(F.pmod(F.xxhash64("id"), F.lit(kneser_ney.HOLD_OUT)) == 0).collect()}
    # Row 5 is there twice, and so counts twice.
    p = brute_kneser_ney([t for k, t in texts.items() if k < 60 and k not in held] + ([texts[5]] if 5 not in held else []), 3)
    for k in (1, 40, 70, 73):
        t = "\x02\x02" + re.sub(r"\d", "0", " ".join(texts[k].lower().split())) + "\x03"
        want = math.exp(-np.mean([math.log(p(t[i : i + 3])) for i in range(len(t) - 2)]))
        assert got[k]["perplexity"] == pytest.approx(want, rel=1e-5)
    assert not got[70]["kept"] and not got[71]["kept"] and not got[72]["kept"] and got[71]["perplexity"] is None
    assert got[80]["kept"] and got[80]["perplexity"] is None and got[81]["kept"]
    assert sum(got[k]["kept"] for k in range(60)) >= 58
    joined = {x["doc_id"]: x for x in kneser_ney.quality_classifier(docs, trusted, order=3, broadcast_rows=0).collect()}
    assert all((a["perplexity"] is None) == (joined[k]["perplexity"] is None) and a["kept"] == joined[k]["kept"] for k, a in got.items())
    assert kneser_ney.quality_classifier(docs.filter("false"), trusted).count() == 0


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("en", True, "abab abba"), ("en", True, "baab bbb")], "lang string, trusted boolean, text string")
    grams = kneser_ney.count_grams(docs, 2)
    every = spark.createDataFrame([("en", f"a{c}", 0) for c in "ab \x03\x02?"], "lang string, g string, c long")
    table = kneser_ney.score_table(grams.unionByName(every).groupBy("lang", "g").agg(F.max("c").alias("c")), 2)
    total = sum(math.exp(r["logp"]) for r in table.filter(F.col("g").startswith("a") & ~F.col("g").contains("\x02")).collect())
    assert total == pytest.approx(1.0)


@pytest.mark.parametrize(("common", "own"), [(49, 4), (45, 8), (40, 20)])
@pytest.mark.parametrize("linked", [True, False])
def test_exact_passages_behind_a_common_line(spark, common, own, linked):
    """Groups of six documents that all begin with one line; two of them share more words after it.
    ``linked``: all are one class already, by another passage."""
    r = random.Random(common)
    rows, planted = [], []
    for g in range(60):
        line, after, link = prose(r, common), prose(r, own), prose(r, 70)
        two = sorted(r.sample(range(1, 6), 2))
        for k in range(6):
            body = [line, after if k in two else prose(r, own), prose(r, 30 + r.randrange(60))]
            rows.append((10 * g + k, " ".join([prose(r, 20), *body, *([link] if linked else []), prose(r, 20)])))
        planted.append((g, two, (line + " " + after).split()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = defaultdict(list)
    for x in substring_dedup.repeated_passages(docs).collect():
        got[x["doc_id"]].append((x["start_word"], x["start_word"] + x["n_words"]))
    texts = dict(rows)
    whole = 0
    for g, two, passage in planted:
        here = True
        for k in two:
            w = words(texts[10 * g + k])
            at = next(i for i in range(len(w)) if w[i : i + len(passage)] == passage)
            here = here and all(any(a <= i < b for a, b in got[10 * g + k]) for i in range(at, at + len(passage)))
        whole += here
    assert whole == 60


def test_passages_of_one_pair_are_not_parts_of_each_other(spark):
    """Exact repeats that are part of a passage of the same two documents have no rows of their own."""
    r = random.Random(5)
    line, half, other = prose(r, 48), prose(r, 60), prose(r, 60)
    rows = [(k, " ".join([prose(r, 20), line, prose(r, 20), half, prose(r, 1), other, prose(r, 20)])) for k in range(30)]
    got = defaultdict(list)
    for x in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got[x["doc_id"], x["other_doc_id"]].append((x["start_word"], x["start_word"] + x["n_words"]))
    assert {k for k, _ in got} == set(range(30))
    for spans in got.values():
        assert not [1 for p in spans for q in spans if p != q and q[0] <= p[0] and p[1] <= q[1]], spans


def test_exact_passages_by_brute_force(spark):
    """Licence lines of all lengths, passages and families mixed: every word of every run of 50 words
    that two documents share is in some passage, and passages are no more alike than they say."""
    r = random.Random(21)
    lines, passages = [prose(r, n) for n in (14, 30, 48, 49, 60)], [prose(r, n) for n in (50, 53, 80)]
    rows = []
    for k in range(160):
        parts = [prose(r, r.randint(0, 40)) for _ in range(4)]
        for x in r.sample(lines, r.randint(0, 3)) + r.sample(passages, int(r.random() < 0.3)):
            parts.insert(r.randint(0, len(parts)), x)
        rows.append((k, " ".join(parts)))
    rows += [(500 + k, rows[k % 4][1] + " " + prose(r, 3)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    covered = defaultdict(set)
    for x in substring_dedup.repeated_passages(docs).collect():
        covered[x["doc_id"]].update(range(x["start_word"], x["start_word"] + x["n_words"]))
    holders = defaultdict(list)
    for k, t in rows:
        w = words(t)
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].append((k, i))
    n = 0
    for places in holders.values():
        if len({k for k, _ in places}) > 1:
            for k, i in places:
                n += 1
                assert set(range(i, i + 50)) <= covered[k], (k, i)
    assert n > 1000


def test_registry_oracles(spark):
    c = duck(SF)
    for name, sql in registry.oracle_sql().items():
        ours, theirs = registry.queries()[name](spark, SF).toPandas(), c.sql(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs), name


class Encoded:
    """A text's ids by the library, then id 1."""

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def __call__(self, text):
        return [*self.library.encode(text, add_special_tokens=False).ids, 1]


def test_pipeline(spark, documents, tmp_path):
    import corpus_pipeline

    # Columns that the operators' own results are named by.
    docs = documents.limit(120).withColumns({"extra": F.lit("kept"), "n_lines": F.concat(F.lit("of "), "doc_id"), "n_dropped": F.lit(None).cast("double"), "class_id": -F.col("doc_id"), "_spans": F.lit("s")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == docs.columns
            assert out.filter(F.length("text") != F.col("n_chars")).isEmpty()
            assert out.filter("n_lines != concat('of ', doc_id) or n_dropped is not null or class_id != -doc_id or _spans != 's'").isEmpty()
            given = docs
        if name == "quality_rules":
            assert 0 < out.count() < docs.count()
        elif name == "line_dedup":
            want, _ = brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
            assert {r["doc_id"]: r["text"] for r in out.collect()} == {k: "\n".join(v) for k, v in want.items()}
        elif name == "near_dedup":
            classes = brute_classes({r["doc_id"]: r["text"] for r in docs.collect()})
            assert {r["doc_id"] for r in out.collect()} == {k for k, c in classes.items() if k == c}
        elif name == "secret_scan":
            owners = {}
            for x in given.collect():
                for *_, v in secrets.find(x["text"] or ""):
                    owners.setdefault(v, set()).add(x["source"])
            for x, y in zip(given.orderBy("doc_id").collect(), out.orderBy("doc_id").collect(), strict=True):
                live = [(a, b) for a, b, _, v in secrets.find(x["text"] or "") if secrets.looks_live(v) and len(owners[v]) < secrets.MANY_OWNERS]
                text, end = x["text"], len(x["text"] or "")
                for a, b in sorted(live, reverse=True):
                    if b <= end:
                        text, end = text[:a] + "[SECRET]" + text[b:], a
                assert y["text"] == text or len(live) > 1
        else:
            ids = Encoded(corpus_pipeline.TOKENIZER)
            pieces = {}
            for x in out.collect():
                pieces.setdefault(x["doc_id"], []).append((x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]))
            for x in given.collect():
                want, at = ids(x["text"] or ""), 0
                for start, length, crc, tokens in sorted(pieces[x["doc_id"]]):
                    assert (start, tokens, crc) == (at, len(want), zlib.crc32(np.array(want[at : at + length], "<u4").tobytes()))
                    at += length
                assert at == len(want)
            full = {}
            for x in out.collect():
                full.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
            for parts in full.values():
                assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()] and sum(n for _, n in parts) <= 2048
        docs = out
    assert docs.agg(F.count_distinct("doc_id")).first()[0] == spark.read.parquet(f"{tmp_path}/secret_scan").count()
    empty = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_digest_of_kept_lines(spark):
    got = {r["doc_id"]: r for r in registry.op6_line_dedup(spark, SF).collect()}
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, _ = brute_lines(table)
    assert all(got[k]["kept_sha256"] == hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in want.items())


def test_only_with(spark):
    from flowgrid.llm.common import only_with

    df = spark.range(5000).selectExpr("if(id = 7, null, id) as doc_id", "id as _slot_of")
    kept = only_with(df, "doc_id", df.filter("doc_id % 11 = 0 and doc_id > 0"))
    assert kept.columns == df.columns and kept.filter("doc_id % 11 = 0 and doc_id > 0").count() == 454
    assert kept.count() < 600 and only_with(df, "doc_id", df.filter("false")).count() == 0


def test_sketches_estimate_similarity():
    r = np.random.default_rng(3)
    h = shingles.mix(np.arange(1, 2000, dtype=np.uint64))
    differ = []
    for _ in range(40):
        x = r.permutation(h)[:400]
        a, b = np.sort(x[:360]), np.sort(np.concatenate((x[:320], x[360:])))  # 320 of 400 in common
        one = np.ones(360, np.int64)
        differ.append(int(np.bitwise_count((near_dedup.sketch(a, one) ^ near_dedup.sketch(b, one)).view(np.uint64)).sum()))
    assert max(differ) <= near_dedup.most_differing(0.8) and abs(np.mean(differ) - 0.1 * near_dedup.SKETCH) < 10


def test_passages_under_a_common_line(spark):
    """Unlike documents that begin with one line don't meet in pairs, and those that go on alike are all found."""
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    line, rows = new(23), []
    for k in range(160):
        rows.append((k, line + new(30)))
    for k in range(20):
        own = rows[k][1][23:]
        rows.append((1000 + k, [*line, *own[:12], *new(1), *own[13:]]))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string").repartition(4)
    shared = substring_dedup.materialise(substring_dedup._shared(substring_dedup.windows_of(docs, "doc_id", "text")), "shared")
    apart = spark.createDataFrame([], "node long, was long, component long")
    met = substring_dedup._between_classes(shared, apart, docs, "doc_id", "text", 50, 0.8)
    pairs = {(x.a, x.b) for x in met.select("a", "b").distinct().collect()}
    largest = max(x["count"] for x in shared.select("key", "doc").distinct().groupBy("key").count().collect())
    assert largest > substring_dedup.LARGE and len(pairs) < largest * (largest - 1) / 8
    # The pairs that had met without lists of shingles, and shared a passage, are still among them.
    one, two = (shared.groupBy("key", F.col("doc").alias(k)).agg(F.min("place").alias(f"p{k}")) for k in "ab")
    every = substring_dedup.materialise(one.join(two, "key").filter("a < b"), "every")
    assert every.select("a", "b").distinct().count() > 8 * len(pairs)
    results = [{tuple(x) for x in substring_dedup._compared(m, docs, "doc_id", "text", 50, 0.8, 2).collect()} for m in (met, every)]
    assert results[0] == results[1] and len(results[0]) >= 12


def test_verification_moves_only_the_texts_of_pairs(spark, monkeypatch):
    moved, real = [], near_dedup.only_with

    def counted(df, key, wanted):
        out = real(df, key, wanted)
        moved.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "only_with", counted)
    text = lambda k: bytearray(zlib.compress(" ".join(f"w{k % 7}x{i}" for i in range(30)).encode()))
    texts = spark.createDataFrame([(bytearray([k]), text(k)) for k in range(100)], "node binary, text binary")
    pairs = spark.createDataFrame([(bytearray([1]), bytearray([8])), (bytearray([1]), bytearray([3]))], "a binary, b binary")
    got = near_dedup._verified(pairs, texts, 0.8).collect()
    assert [(bytes(x.a), bytes(x.b)) for x in got] == [(b"\x01", b"\x08")]
    assert moved == [1, 2]


def test_short_texts_are_hashed_together(monkeypatch):
    rng, calls, real = random.Random(4), [], shingles._hash_words
    texts = [" ".join(rng.choice(["a", "bb", "\u00e9", "x\t", "\n", " "]) for _ in range(rng.randrange(30))) for _ in range(200)]
    expected = [shingles.shingle_stream(shingles.word_hashes(t)).tolist() for t in (*texts, "word " * 300_000, *texts[:3])]
    monkeypatch.setattr(shingles, "_hash_words", lambda *a: calls.append(1) or real(*a))
    got = shingles.shingle_streams([t.encode() for t in texts])
    assert [x.tolist() for x in got] == expected[:200] and len(calls) == 1
    assert [x.tolist() for x in shingles.shingle_streams([t.encode() for t in (*texts, "word " * 300_000, *texts[:3])])] == expected
    assert shingles.shingle_streams([]) == [] and [len(x) for x in shingles.shingle_streams([b"", b" \n"])] == [0, 0]


def test_pairs_without_a_dense_run_are_not_aligned(monkeypatch):
    r = np.random.default_rng(8)
    new = lambda n: r.integers(0, 2**63, n).astype(np.uint64)
    line, passage = new(10), new(60)
    often = np.concatenate([line, line, line, line, line, new(40)])
    # All five copies of the line are dense in one text; the other one has the line once.
    once = np.concatenate([new(60), line, new(60)])
    scattered = np.concatenate([x for k in range(0, 60, 4) for x in (passage[k : k + 4], new(4))])
    alike = substring_dedup.verify(np.concatenate([new(30), passage]), np.concatenate([passage, new(30)]), 46)
    assert [x[:4] for x in alike] == [(30, 90, 0, 60)]
    assert substring_dedup.verify(passage, passage.copy(), 46) == [(0, 60, 0, 60, 1.0)]

    def aligned(*given):
        raise AssertionError("aligned")

    monkeypatch.setattr(substring_dedup, "_aligned", aligned)
    for a, b in ((often, once), (once, often), (passage, scattered), (scattered, passage)):
        assert substring_dedup.verify(a, b, 46) == []


def test_filters_of_exact_runs_stand_before_the_shuffle(spark, monkeypatch):
    """No join pushes itself below the filter that keeps rows without a partner from being shuffled."""
    rng = random.Random(12)
    twice = prose(rng, 80)
    docs = spark.createDataFrame([(k, f"{prose(rng, 70)} {twice if k < 2 else ''} {prose(rng, 60)}") for k in range(40)], "doc_id long, text string")
    plans, real = {}, substring_dedup.materialise

    def written(df, label, reduced=False):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, label, reduced)

    monkeypatch.setattr(substring_dedup, "materialise", written)
    found = spark.createDataFrame([], "a long, a_start long, a_words long, b long, b_start long, b_words long, similarity double")
    got = substring_dedup._exact_passages(docs, "doc_id", "text", found, 50).collect()
    # What overlaps along one shift is one passage, its first run too.
    assert [(x.a, x.b, x.a_start, x.a_words, x.b_start) for x in got] == [(0, 1, 70, 80, 70)]
    for label in ("partly", "wanted", "exact"):
        assert "_words" in plans[label], label
    assert "LeftSemi" not in plans["partly"]
