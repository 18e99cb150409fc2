"""Periodic runs, ranked search and secret scans against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploframe.llm import periods, search, secrets

SCHEMA = "doc_id long, text string, runs string, score long, rank string, item string, n_words string, `odd name` string, base string"
SEPARATORS = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ("r", 1, "k", "i", "w", "o", "b")


def table(spark, texts, ids=None, parts=3):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in zip(ids, texts)], SCHEMA).repartition(parts)


def texts(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 2)))
    say = lambda n: " ".join(word() for _ in range(n))
    out = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "a b " * 3, "a b " * 4, "x\ty\nz " * 5 + "x", "a " * 300 + "b " * 300]
    out += [say(r.randint(1, 60)) for _ in range(60)]
    out += [say(9) + " " + (say(p) + " ") * r.randint(3, 6) + say(7) for p in (1, 2, 3, 5, 8, 13) for _ in range(3)]
    out += [("a b a b c " * 4 + "d ") * 6, say(3000) + " " + "q w e " * 500 + say(2000), out[7], out[7]]
    return out


def runs_by_comparison(w, least=6, exponent=4):
    """All maximal stretches by their smallest period, each pair of places compared."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        s = None
        for i in range(len(w) - q + 1):
            if i < len(w) - q and w[i] == w[i + q]:
                s = i if s is None else s
            elif s is not None:
                if i + q - s >= max(least, exponent * q):
                    found.setdefault((s, i + q - s), q)
                s = None
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_are_those_of_all_comparisons(spark):
    docs = table(spark, texts())
    got = periods.collapse_runs(docs)
    assert got.columns == [*(c for c in docs.columns if c not in ("runs", "n_words")), "n_words", "runs", "collapsed"]
    for r in got.collect():
        w = SEPARATORS.findall(r.text or "")
        want = runs_by_comparison(w)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(w) and r.collapsed == collapsed(w, want)
        assert (r.score, r["odd name"]) == (1, "o")


def test_runs_of_other_lengths():
    r = random.Random(5)
    for _ in range(300):
        w = np.array([r.randrange(3) for _ in range(r.randint(0, 70))])
        cut = sorted(r.randrange(len(w) + 1) for _ in range(2))
        bounds = np.array([0, *cut, len(w)])
        for least, exponent in ((1, 2), (6, 4), (10, 3)):
            want = [(s + int(x), n, q) for x, y in zip(bounds[:-1], bounds[1:]) for s, n, q in runs_by_comparison(w[x:y].tolist(), least, exponent)]
            assert [tuple(x) for x in periods.find(w, bounds, least, exponent).tolist()] == want


def test_equal_hashes_of_different_words_are_found_out():
    """Thue-Morse words and their complements have equal polynomial hashes modulo powers of two."""
    t = np.array([bin(i).count("1") & 1 for i in range(4096)])
    w = np.concatenate((t, 1 - t, t, 1 - t, t))
    bounds = np.array([0, len(w)])
    want = sorted((int(b), int(e - b + q), q) for q in range(1, len(w) // 4 + 1) for b, e in zip(*periods.stretches(w, q)) if e - b + q >= max(6, 4 * q))
    best = {}
    for s, n, q in want:
        best[s, n] = min(q, best.get((s, n), q))
    assert [tuple(x) for x in periods.find(w, bounds).tolist()] == sorted((s, n, q) for (s, n), q in best.items())


def test_grid_in_pieces(monkeypatch):
    w = np.array([int(c) for c in "0120120120123401234012340123401230000000"] * 5)
    whole = periods.find(w, np.array([0, len(w)])).tolist()
    monkeypatch.setattr(periods, "POINTS", 3)
    assert periods.find(w, np.array([0, len(w)])).tolist() == whole == [list(x) for x in runs_by_comparison(w.tolist())]


def test_periodic_query(spark, tmp_path):
    t = texts(8)
    ids = [*range(len(t) - 2), None, 0]
    table(spark, t, ids).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in periods.op13_periodic_runs(spark, str(tmp_path)).collect())
    want = Counter()
    for i, x in zip(ids, t):
        w = planted(i, SEPARATORS.findall(x or ""))
        runs = runs_by_comparison(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed(w, runs))] += 1
    assert got == want
    assert periods.collapse_runs(table(spark, [])).count() == 0


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranking(rows, items, k):
    """(item_id, rank, doc_id, score) from whole texts."""
    held = [(i, Counter(terms(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(x for _, c in held for x in c)
    out = []
    for item, text in set(items):
        q = terms(text)
        scored = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * c[x] // (1000 * c[x] + 8 * m)) for x in q if c[x])
            scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return Counter(out)


def search_texts(seed=4):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcÄé7") for _ in range(r.randint(1, 4))) for _ in range(60)]
    say = lambda n: "".join(r.choice(vocab) + r.choice(" .,-_\n|\x7f") for _ in range(n))
    docs = [None, "", "...", "A", "a", *["b " * n for n in (1, 2, 2, 2, 3)], *[say(r.randint(1, 80)) for _ in range(120)], say(5000)]
    docs += [docs[20]] * 25
    items = [(i, say(r.randint(1, 12))) for i in range(15)] + [(3, "another text b"), (50, None), (51, "zzzz"), (52, "b b b"), (52, "b b b"), (None, "a b"), (53, "A ... a")]
    return docs, items


@pytest.mark.parametrize("shard", [{}, {"max_docs": 7}, {"max_bytes": 60}])
@pytest.mark.parametrize("block", [4096, 4])
def test_ranking_is_that_of_whole_texts(spark, tmp_path, shard, block):
    t, items = search_texts()
    ids = [*range(0, 3 * (len(t) - 4), 3), None, None, 0, 0]
    search.build_index(table(spark, t, ids, 4), f"{tmp_path}/index", **shard)
    queries = spark.createDataFrame([(i, x, "c") for i, x in items], "item_id long, text string, score string")
    got = search.search(search.load_index(spark, f"{tmp_path}/index"), queries, 10, block)
    assert Counter(tuple(r) for r in got.collect()) == ranking(list(zip(ids, t)), items, 10)


def test_ties_at_the_cut_go_by_id(spark, tmp_path):
    t = ["same words here"] * 40
    ids = random.Random(1).sample(range(100), 40)
    search.build_index(table(spark, t, ids, 5), f"{tmp_path}/index", max_docs=6)
    got = search.search(search.load_index(spark, f"{tmp_path}/index"), spark.createDataFrame([(1, "words")], "item_id long, text string"))
    assert [r.doc_id for r in got.orderBy("rank").collect()] == sorted(ids)[:10]


def test_search_of_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "item_id string, text string")
    search.build_index(table(spark, []), f"{tmp_path}/empty")
    index = search.load_index(spark, f"{tmp_path}/empty")
    assert search.search(index, none).count() == 0
    assert search.search(index, spark.createDataFrame([("x", "a")], none.schema)).count() == 0
    search.build_index(table(spark, ["a b", "..."]), f"{tmp_path}/full")
    assert search.search(search.load_index(spark, f"{tmp_path}/full"), none).count() == 0
    with pytest.raises(ValueError):
        search.build_index(table(spark, []), f"{tmp_path}/wrong", max_docs=1 << 17)


PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, pattern, ok) in enumerate(PATTERNS) for m in pattern.finditer(text or "") if ok(m))


def secret_texts(seed=6):
    r = random.Random(seed)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    capitals = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefgéhilmnorstu") for _ in range(r.randint(2, 18)))
    say = lambda n: " ".join(word() for _ in range(n))
    out = [None, "", "é" * 50, "token", "token=", "token=short", 'TOKEN = "abcdef"', "pass", "word: abcdefgh", "Paſſword=abcdefgh", "api_key:'xyz.123' apikey=xyz-123", "token=password=abcdefgh", "secret : : abcdefgh", "xAKIA" + capitals(16), "AKIA" + capitals(15), "AKIA", "AKIAAKIA" + capitals(16), hexes(23), hexes(24), hexes(40) + "g" + hexes(30), "token=" + hexes(40), "token=zzAKIA" + capitals(20)]
    out += [f'{say(r.randint(0, 30))} token = "{hexes(40)}" {say(r.randint(0, 30))}' for _ in range(150)]
    out += [f"{say(9)} AKIA{capitals(16)} {say(9)}" for _ in range(30)]
    out += [f"{say(20)} {r.randrange(10**15)} {r.randrange(256)}.{r.randrange(256)}.17.45 mail{r.randrange(9)}.example.com {say(20)}" for _ in range(80)]
    out += [say(4000) + f" é secret={hexes(8)} " + say(4000), "é" * 9 + "passwd: " + "k" * 5000]
    return out, hexes, say


def test_base_findings_are_those_of_the_patterns(spark, tmp_path):
    t, _, _ = secret_texts()
    ids = [*range(len(t) - 2), None, 0]
    table(spark, t, ids).write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op11_secrets(spark, str(tmp_path)).collect()
    assert len(got) == len(t)
    want = Counter()
    for i, x in zip(ids, t):
        spans = base_spans(x)
        text = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)
        want[i, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(text.encode()).hexdigest(), text] += 1
    parts = lambda s: ",".join(x for x in s.split(",") if not x.startswith("model:"))
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, parts(r.spans)) for r in got) == want
    assert all((x := [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s]) == sorted(x, key=lambda p: p[0]) for r in got)


def test_findings_without_a_name_are_added(spark):
    """Values of other alphabets without any name are found; words, numbers, addresses and hosts are left alone."""
    t, _, say = secret_texts()
    r = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    bare = ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(10)]
    first = len(t)
    t += [f"{say(12)} {x} {say(12)}" for x in bare]
    got = {x.doc_id: x for x in secrets.scan(table(spark, t)).collect()}
    hit = sum(any(t[first + i][a.start : a.end] == x for a in got[first + i].added) for i, x in enumerate(bare))
    clean = [i for i in range(first) if not base_spans(t[i]) and t[i] and len(t[i]) > 60]
    wrong = sum(bool(got[i].added) for i in clean)
    assert hit >= 0.9 * len(bare) and wrong <= 0.05 * len(clean)
    assert all(0 <= a.probability <= 1 for x in got.values() for a in x.added)
    # Base findings and added ones never overlap.
    assert not any(a.start < b.end and b.start < a.end for x in got.values() for a in x.added for b in x.base)


def test_scan_without_findings_or_rows(spark):
    got = secrets.scan(table(spark, ["plain words only thirteencharacters", None])).collect()
    assert [(x.base, x.added) for x in got] == [([], [])] * 2
    assert secrets.scan(table(spark, [])).count() == 0


def test_network_gradients():
    """The written gradients against differences of the loss."""
    found = [(b"left ", b"abc9f", b" right"), (b"", b"zzzzzzzzzzzz", b""), ("é".encode(), b"Q+/9", b"\"")]
    y, weight = np.array([1.0, 0.0, 1.0], np.float32), np.array([1.0, 2.0, 0.5], np.float32)
    net = secrets.Network(3)
    net.weights = [w.astype(np.float64) for w in net.weights]

    def loss():
        p = 1 / (1 + np.exp(-net.logits(found).astype(np.float64)))
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * weight).sum() / weight.sum())

    for w, g in zip(net.weights, net.gradients(found, y, weight)):
        at = np.unravel_index(np.argsort(-np.abs(g), axis=None)[:6], g.shape)
        for place in zip(*at):
            old, step = w[place], 1e-3
            w[place] = old + step
            up = loss()
            w[place] = old - step
            down = loss()
            w[place] = old
            assert abs((up - down) / (2 * step) - g[place]) < 2e-3 + 0.05 * abs(g[place])


def test_thresholds_keep_the_recall():
    r = np.random.default_rng(2)
    counts = r.integers(0, 50, (secrets.SHAPES, secrets.BINS, 2))
    counts[1, :, 1] = 0
    least = secrets.thresholds(counts, 0.9, 20)
    for k in (0, 2):
        found = counts[k, :, 1]
        assert found[least[k] :].sum() >= 0.9 * found.sum() > found[least[k] + 1 :].sum()
    assert secrets.thresholds(counts * 0, 0.9).tolist() == [secrets.BINS] * secrets.SHAPES
    p = secrets.isotonic(counts[0, :, 1], counts[0].sum(1))
    assert (np.diff(p) >= 0).all() and abs((p * counts[0].sum(1)).sum() - counts[0, :, 1].sum()) < 1e-6
