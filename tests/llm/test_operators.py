"""Each text operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploframe.llm import decontamination, fingerprints, jaccard, language, lines, mixing, substrings, suffixes, toxicity, warc, windows
from haploframe.llm.tokens import text_chunks, word_bounds, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, part string, a string, rank string, size string"


def words(t):
    return WORD.findall(t or "")


def corpus(seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = say(90)
    texts = [None, "", " \t\n", "One", "one", "two words", say(3)]
    base = say(150)
    for _ in range(12):
        w = base.split()
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [base, base, base.upper()]
    texts += [f"{say(r.randint(0, 40))}\n{passage}\n{say(r.randint(0, 40))}" for _ in range(10)]
    texts += ["ab cd " * 300, "x" * 3000, say(4000), "line one\nline two\nline three\n" * 5]
    texts += [say(r.randint(1, 120)) for _ in range(20)]
    rows = [(i * 3, t, "en", "s" + str(i % 4), 0) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8]]  # repeated rows
    rows += [(21, "another text under a known id " + passage, None, None, None)]
    r.shuffle(rows)
    return [(*x, "u", "p", "a", "r", "z") for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    """(doc_id, text) of all rows, in the order in which repeated ids are told apart."""
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0], x[1] is not None, (x[1] or "").encode()))


def covered(n, begins, width):
    gone = [False] * n
    for j in begins:
        gone[j : j + width] = [True] * width
    return gone


def test_words_and_hashes():
    import pyarrow as pa

    column = pa.array(["a  bé\tc", None, "", " x", "bé"])
    (row, end, data, offsets), = text_chunks(column)
    b, e, first = word_bounds(data, offsets)
    assert [data[i:j].tobytes().decode() for i, j in zip(b, e)] == ["a", "bé", "c", "x", "bé"] and list(first) == [0, 3, 3, 3, 4, 5]
    h = word_hashes(data, b, e)
    assert h[1] == h[4] and len(set(h.tolist())) == 4


@pytest.mark.parametrize("hot", [100_000, 3])
def test_substrings(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(windows, "HOT_ROWS", hot)
    rows, seen = rows_of(docs), {}
    for k, (i, t) in enumerate(rows):
        w = words(t)
        for j in range(len(w) - 19):
            seen.setdefault(tuple(w[j : j + 20]), (k, j))
    want = []
    for k, (i, t) in enumerate(rows):
        w = words(t)
        gone = covered(len(w), [j for j in range(len(w) - 19) if seen[tuple(w[j : j + 20])] != (k, j)], 20)
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    assert sorted(map(tuple, substrings.dedup_words(docs).collect())) == sorted(want)
    assert substrings.dedup_words(empty).count() == 0


@pytest.mark.parametrize("hot", [100_000, 3])
def test_suffixes(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(windows, "HOT_ROWS", hot)
    rows = rows_of(docs)
    count = Counter(b[j : j + 400] for _, t in rows for b in [(t or "").encode()] for j in range(len(b) - 399))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = covered(len(b), [j for j in range(len(b) - 399) if count[b[j : j + 400]] > 1], 400)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert sorted(map(tuple, suffixes.dedup_bytes(docs).collect())) == sorted(want)
    assert suffixes.dedup_bytes(empty).count() == 0


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_groups_of_one_anchor_are_split(spark, monkeypatch, kind):
    """A k-gram that many different stretches share: no group in a task holds more than HOT_ROWS of them, and no match is lost."""
    monkeypatch.setattr(windows, "HOT_ROWS", 20)
    r = random.Random(5)
    if kind == "bytes":
        width, k, sep, solve = 400, suffixes.GRAM, "", suffixes.solve
        own = lambda n: "".join(r.choices("abcdefghij", k=n))
        pool = own(300_000)
        at = int(windows.byte_grams(np.frombuffer(pool.encode(), np.uint8), k).argmin())
        gram, near, far = pool[at : at + k], 190, 210
    else:
        width, k, sep, solve = substrings.WIDTH, substrings.GRAM, " ", substrings.solve
        own = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
        pool = own(20_000)
        data = np.frombuffer(" ".join(pool).encode(), np.uint8)
        at = int(windows.items_of("words", data, np.array([0, len(data)]), k)[0].argmin())
        gram, near, far = pool[at : at + k], 9, 12
    lefts, rights = [own(near) for _ in range(12)], [own(near) for _ in range(10)]
    items = [own(far) + lefts[i % 12] + gram + rights[i % 10] + own(far) for i in range(150)]
    items += [own(far)[:3] + lefts[i] + gram + rights[0] + own(i) for i in range(4)] + items[:2]
    d = windows.numbered(spark.createDataFrame([(i, sep.join(x)) for i, x in enumerate(items)], "doc_id long, text string"))

    def bounded(group, *rest):
        if np.bincount(group).max() > 20:
            raise ValueError("too many stretches in one group")
        return solve(group, *rest)

    seen, want = {}, {}
    for i, x in enumerate(items):
        for j in range(len(x) - width + 1):
            seen.setdefault(tuple(x[j : j + width]), []).append((i, j))
    for places in seen.values():
        for i, j in places[kind == "words" :] if len(places) > 1 else ():
            want.setdefault(i, []).append(j)
    found = windows.repeated(d, kind, width, k, bounded, 1, earlier=kind == "words").collect()
    got = {row.doc_id: windows.merged([c.asDict() for c in row.cuts]) for row in found}
    assert got == {i: windows.merged([{"begin": j, "end": j + width} for j in js]) for i, js in want.items()} and len(got) > 90


def test_column_flags_by_brute_force():
    r = random.Random(3)
    for _ in range(20):
        contents = [bytes(r.choice(b"ab") for _ in range(r.randint(6, 14))) for _ in range(12)]
        offset = np.array([r.randint(0, 2) for _ in contents])
        windows = np.array([len(c) - 4 for c in contents])
        group = np.array([r.randint(0, 2) for _ in contents])
        flags = suffixes.column_flags(group, offset, windows, contents, 5)
        for i, c in enumerate(contents):
            for j in range(windows[i]):
                same = any(k != i and group[k] == group[i] and 0 <= (x := j - offset[i] + offset[k]) < windows[k] and contents[k][x : x + 5] == c[j : j + 5] for k in range(len(contents)))
                assert flags[i, j] == same


def substrings_order(text):
    """Places by their suffixes, ends by their place."""
    return np.array(sorted(range(len(text)), key=lambda i: (tuple(text[i : i + 32]) + (-1,) * (32 - len(text[i : i + 32])), i)))


def test_wavelet_and_search():
    r = np.random.default_rng(1)
    seqs = [r.integers(1, 6, r.integers(3, 40)) for _ in range(20)]
    text = np.concatenate([np.append(s, 0) for s in seqs]).astype(np.int64)
    index = substrings.FMIndex(text, 4)
    for x in range(6):
        places = np.arange(len(text) + 1)
        assert np.array_equal(index.tree.rank(np.full(len(places), x), np.zeros_like(places), places)[1], np.concatenate(([0], np.cumsum(text[substrings_order(text) - 1] == x))))
    # Intervals of the first four symbols: equal ones for equal symbols only.
    size = np.array([len(s) for s in seqs])
    starts = np.cumsum(size + 1) - size - 1
    found = substrings.matches(index, text, starts, size, 4)
    grams = {}
    for s, n in zip(starts, size):
        for j in range(n):
            assert (found[s + j] >= 0) == (j + 4 <= n)
            if j + 4 <= n:
                assert grams.setdefault(tuple(text[s + j : s + j + 4]), found[s + j]) == found[s + j]
    assert len(set(grams.values())) == len(grams)
    for _ in range(200):
        s = seqs[r.integers(20)]
        k = int(r.integers(1, len(s) + 1))
        at = int(r.integers(0, len(s) - k + 1))
        p, (lo, hi) = s[at : at + k], (np.array([0]), np.array([len(text)]))
        for c in p[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        assert hi[0] - lo[0] == sum((text[i : i + k] == p).all() for i in range(len(text) - k + 1))


def test_lines(docs, empty):
    texts = {}
    for i, t in rows_of(docs):
        texts.setdefault((i, t), None)
    got = {(r.doc_id, r.before): r for r in lines.dedup_lines(docs.withColumn("before", F.col("text"))).collect()}
    assert len(got) == len(texts) and lines.dedup_lines(empty).count() == 0
    for (i, t), r in got.items():
        if t is None:
            assert r.text is None and r.n_lines == 0
    # The document of five times three lines keeps its first three and what the last break leaves.
    r = next(r for r in got.values() if r.n_lines == 16)
    assert r.text.startswith("line one\nline two\nline three") and r.n_removed in (12, 13)
    assert docs.columns == [c for c in lines.dedup_lines(docs).columns if c not in ("n_lines", "n_removed")]


@pytest.mark.parametrize("min_lines, min_words", [(3, 4), (1, None), (5, 9)])
def test_lines_of_many_words(spark, min_lines, min_words):
    """Runs of one or two lines go by their words: brute force over all runs."""
    r = random.Random(9)
    pool = ["one two three four five", "a b", "c d", "single", "", "e f g", "six seven  eight\tnine "]
    again = [r.choice(pool) for _ in range(9)]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.7 else f"own {i} {k}" for k in range(r.randint(1, 7)))) for i in range(25)]
    rows += [(30, pool[0]), (31, pool[0]), (32, "long ones\nin two lines"), (33, "long ones\nin two lines"), (34, None), (35, ""), *((40 + i, "\n".join(again[i : 9 - i] + ["x"] * 5)) for i in range(3))]
    seen, want = {}, {}
    for i, t in rows:
        x = t.split("\n") if t is not None else []
        gone = [False] * len(x)
        for n in range(1, min_lines + 1):
            for j in range(len(x) - n + 1):
                if seen.setdefault(tuple(x[j : j + n]), (i, j)) != (i, j) and (n == min_lines or min_words is not None and len(words("\n".join(x[j : j + n]))) >= min_words):
                    gone[j : j + n] = [True] * n
        want[i] = (None if t is None else "\n".join(y for y, g in zip(x, gone) if not g), sum(gone))
    got = {x.doc_id: (x.text, x.n_removed) for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_lines, min_words).collect()}
    assert got == want and (min_words is None or min_words > 5 or got[31] == ("", 1))


def test_pipeline_deletes_long_lines(spark):
    import corpus_pipeline

    line = "a line of more than eight words that stands alone here"
    d = spark.createDataFrame([(1, line), (2, f"before\n{line}\nafter"), (3, "before\nafter"), (4, line), (5, ""), (6, None)], "doc_id long, text string")
    assert [r.text for r in corpus_pipeline.dedup_lines(spark, d, "").orderBy("doc_id").collect()] == [line, "before\nafter", "before\nafter", "", None]


def test_jaccard(docs, empty):
    rows = [(i, t) for i, t in rows_of(docs)]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = words((t or "").translate(lower))
        sets.append(frozenset(tuple(w[j : j + 3]) for j in range(len(w) - 2)) or (frozenset([tuple(w)]) if w else frozenset()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    low = {}
    for x in range(len(rows)):
        low[find(x)] = min(low.get(find(x), rows[x][0]), rows[x][0])
    want = sorted((rows[x][0], len(sets[x]), low[find(x)] if sets[x] else rows[x][0]) for x in range(len(rows)))
    assert sorted(map(tuple, jaccard.jaccard_components(docs).drop("uid").collect())) == want
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.keep_one(docs).collect()
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept) and jaccard.jaccard_components(jaccard.keep_one(docs)).filter("component_id != doc_id").count() == 0


def test_components_with_null_ids(spark):
    """A null id takes no id away from its component."""
    text = " ".join(f"w{j}" for j in range(60))
    d = spark.createDataFrame([(None, text), (9, text + " end"), (5, text), (None, "alone in the end"), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(d).collect()), key=str)
    assert got == sorted([(None, 5), (9, 5), (5, 5), (None, None), (7, 7)], key=str)


def test_large_groups_are_split(docs, monkeypatch):
    """Parts of groups find the same components."""
    want = sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=str)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=str) == want


def test_keep_one_tells_components_apart(spark):
    """Unrelated texts without an id, or under one id, all stay."""
    say = lambda k: " ".join(f"{k}{j}" for j in range(30))
    rows = [(None, say("a")), (None, say("b")), (None, say("c")), (None, say("c")), (5, say("d")), (5, say("e")), (6, say("e")), (7, say("a"))]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text[0]) for r in kept} == {(None, "a"), (None, "b"), (None, "c"), (5, "d"), (5, "e")} and len(kept) == 5


def test_pipeline_joins_five_words_at_four_fifths(spark):
    """One changed word in 50: 41/51 of the five-word shingles are shared, but only 45/51 of those of three words."""
    import corpus_pipeline

    w = [f"w{j}" for j in range(50)]
    near, far = w[:25] + ["other"] + w[26:], w[:15] + ["other"] + w[16:25] + ["more"] + w[26:]
    d = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far[::-1])), (4, " ".join(w[::-1])), (5, "one two"), (6, "one two three")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, d, "").collect()) == [1, 3, 4, 5, 6]
    assert sorted(r.doc_id for r in jaccard.keep_one(d).collect()) == [1, 2, 3, 4, 5, 6]


def led(texts, rule):
    """The leading hashes of each text, with counts of these texts alone."""
    import pyarrow as pa

    counts = np.zeros(jaccard.BUCKETS, np.int64)
    for b in jaccard.bucket_counts(rule)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])):
        counts[b.column(0).to_numpy()] += b.column(1).to_numpy()
    order = type("Order", (), {"value": counts})
    ids = pa.array(range(len(texts)), pa.int64())
    return [x.as_py() for b in jaccard.points(order, rule)(iter([pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["doc_id", "uid", "text"])])) for x in b.column(5)]


def test_unrelated_texts_share_no_group():
    """With few words in use each shingle is in several texts; it alone brings none of them together."""
    r = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 25, int(r.integers(150, 400)))) for _ in range(400)]
    groups = Counter(t for lead in led(texts, jaccard.CONTRACT) for t in set(lead))
    assert sum(n for n in groups.values() if n > 1) < 0.01 * sum(groups.values())


@pytest.mark.parametrize("rule", [jaccard.CONTRACT, jaccard.STAGE])
def test_linked_texts_share_a_group(rule):
    """Copies with as many changes as the threshold allows, at all sizes, some of them mostly a frequent passage."""
    r = np.random.default_rng(5)
    passage, texts = " ".join(f"p{j}" for j in range(60)), []
    for k in range(150):
        w = [f"{k}x{j}" for j in range(int(r.integers(2, 40 if k % 2 else 700)))] + passage.split() * (k % 3 == 0)
        texts.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            for at in r.integers(0, len(v), int(r.integers(1, 2 + len(v) // 45))):
                v[at] = f"new{r.integers(1 << 40)}"
            texts.append(" ".join(v + ["more"] * int(r.integers(0, 1 + len(v) // 30))))
    sets = [frozenset(tuple(w[j : j + rule.shingle]) for j in range(max(1, len(w) - rule.shingle + 1))) for w in map(words, texts)]
    lead, linked = [set(x) for x in led(texts, rule)], 0
    for x in range(len(texts)):
        for y in range(x - x % 4, x):
            if sets[x] != sets[y] and rule.denominator * len(sets[x] & sets[y]) >= rule.numerator * len(sets[x] | sets[y]):
                linked += 1
                assert lead[x] & lead[y]
    assert linked > 100


def test_count_tree():
    r = np.random.default_rng(2)
    vec = np.sort(r.integers(0, 5, (3000, jaccard.DIMS)), axis=0).astype(np.int32)
    n = vec.sum(1).astype(np.int64)
    vec, n = vec[np.argsort(n)], np.sort(n)
    tree = jaccard.CountTree(vec, n)
    for i in range(1, 3000, 97):
        bound = np.minimum(vec[i], vec).sum(1)
        want = np.flatnonzero((19 * bound >= 9 * (n[i] + n)) & (10 * n >= 9 * n[i]) & (9 * n <= 10 * n[i]))
        assert np.array_equal(np.sort(tree.search(vec[i], int(n[i]))[0]), want)


def test_fingerprints(docs, empty):
    got = fingerprints.fingerprint_edits(docs).collect()
    assert len(got) == docs.count() and fingerprints.fingerprint_edits(empty).count() == 0
    single = docs.groupBy("doc_id").count().filter("count = 1").count()
    texts = {}
    for i, t in rows_of(docs):
        texts.setdefault(i, []).append(t or "")
    order = sorted(texts, reverse=True)
    prints = {}
    for r in got:
        prints.setdefault((r.n_chars, r.fingerprint), set())
    for k, i in enumerate(order):
        after = order[(k + 1) % len(order)]
        if len(texts[i]) == len(texts[after]) == 1:
            t, n = texts[i][0], texts[after][0]
            r = next(r for r in got if r.doc_id == i)
            cut = len(t) // 3
            edited = t[: len(t) - cut] + n[:cut]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            sh = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
            x, y = sh(words(t)), sh(words(edited))
            assert abs(r.near_edited - len(x & y) / len(x | y)) < 0.15
    assert single
    by_text = {}
    for r in got:
        for t in texts[r.doc_id]:
            if len(texts[r.doc_id]) == 1:
                by_text.setdefault(t, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


@pytest.mark.parametrize("rows", [65_536, 4])
def test_next_documents(spark, monkeypatch, rows):
    """near_next, packed digits and densification against an independent form; ids far apart, below zero and null."""
    monkeypatch.setattr(fingerprints, "ORDER_ROWS", rows)
    r = random.Random(8)
    vocab = [f"w{k}" for k in range(60)]
    ids = [None, -9, -8, 0, 1, 2, 3, 50, 51, 1 << 20, (1 << 20) + 5, 1 << 40, (1 << 40) + 1, 1 << 41, 1 << 62]
    texts = {i: " ".join(r.choice(vocab) for _ in range(r.choice([0, 3, 40, 300, 900]))) for i in ids}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x for x in fingerprints.fingerprint_edits(d).collect()}
    order = sorted(ids, key=lambda i: -(1 << 63) if i is None else i, reverse=True)
    runs = [(i, j, w[j : j + 5]) for i, t in texts.items() for w in [words(t)] for j in range(len(w) - 4)]
    hashes = {(i, j): h for i, j, h in spark.createDataFrame(runs, "i long, j long, w array<string>").select("i", "j", F.xxhash64(*(F.col("w")[k] for k in range(5)))).collect()}
    small = dict(spark.range(256).select("id", F.xxhash64(F.col("id").cast("int"))).collect())

    def digits(i):
        w = words(texts[i])
        if len(w) < 5:
            return None
        least = {}
        for (k, _), h in hashes.items():
            if k == i:
                b = ((h >> 56) + 128) & 255
                least[b] = min(least.get(b, 1 << 63), h)
        out = []
        for b in range(256):
            o, step, c = small[b] & 255, (small[b] >> 8) & 255 | 1, b
            if b not in least:
                c = min(least, key=lambda x: (x - o) * step & 255)
            out.append(f"{least[c] & 255:02x}")
        return "".join(out)

    pairs = lambda x: [x[k : k + 2] for k in range(0, len(x), 2)]
    for k, i in enumerate(order):
        after = order[(k + 1) % len(order)]
        t, n = texts[i], texts[after]
        cut = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest()
        assert got[i].fingerprint == (digits(i) or got[i].fingerprint) and (got[i].fingerprint == "empty") == (not words(t))
        a, b = got[i].fingerprint, got[after].fingerprint
        share = sum(x == y for x, y in zip(pairs(a), pairs(b))) / 256
        want = 1.0 if a == b else 0.0 if "empty" in (a, b) else max(0.0, (share - 1 / 256) / (1 - 1 / 256))
        assert abs(got[i].near_next - want) < 1e-9


def test_leaks(spark, docs, empty):
    item = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old oak"
    bench = spark.createDataFrame([(1, item), (2, "too short item"), (3, None), (4, ""), (5, item)], "item_id long, text string")
    hit = spark.createDataFrame([(9001, f"before it {item} after it"), (9002, item.upper()), (9003, item.replace("lazy", "sleepy")), (9004, "a " + " ".join(item.split()[:9])), (9004, None)], "doc_id long, text string")
    d = docs.select("doc_id", "text").union(hit)
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(d, bench).collect()}
    sh = lambda w: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    want = set()
    n = len(item.split())
    for i, t in d.collect():
        w = words((t or "").lower())
        for s in range(max(1, len(w) - n + 1)):
            a, b = sh(w[s : s + n]), sh(item.split())
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                want |= {(i, 1), (i, 5)}
    assert set(got) == want and (9001, 1) in want and got[9001, 1].similarity == 1.0
    clean = decontamination.decontaminate(d, bench)
    assert clean.filter("doc_id in (9001, 9002)").count() == 0 and clean.filter("doc_id = 9004").count() == 2
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count() and mixing.mix_sources(empty).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(3)).collect()))
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by.items():
        assert abs(sum(taken) - target) <= 2 * mixing.BLOCK and target <= 2 * size + 1e-9
    assert abs(sum(t for _, t in by) - 1.5 * sum(s for s, _ in by)) < 1e-6


def test_quotas_equal_highest_quotients(spark):
    r = random.Random(5)
    for _ in range(5):
        sized = spark.createDataFrame([(f"s{i}", r.randint(0, 3000)) for i in range(9)], "source string, size long")
        rows = mixing.quotas(mixing.targets(sized)).collect()
        seats = (3 * sum(x.source_size for x in rows) + mixing.BLOCK) // (2 * mixing.BLOCK)
        have = {x.rank: 0 for x in rows}
        for _ in range(seats):
            best = max((x for x in rows if x.source_size), key=lambda x: (x.target / (2 * have[x.rank] + 1) if have[x.rank] < 2 * x.blocks else -1, -x.rank))
            have[best.rank] += 1
        assert {x.rank: x.quota for x in rows} == have


def test_shards_get_whole_quotas(spark):
    """Inside a shard so many distinct blocks are taken as its quota says, and blocks are spread over the shard."""
    rows = [(i, " ".join(["w"] * 32), "s" if i < 3000 else "t") for i in range(4000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for size in (96_000, 32_000):
        taken = [r.taken for r in got if r.source_size == size]
        target = next(r.target for r in got if r.source_size == size)
        # A document is one block here or touches two.
        assert sum(taken) == 32 * round(target / 32) and max(taken) - min(taken) <= 32
    other = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed="other").collect()
    assert {(r.doc_id, r.taken) for r in got} != {(r.doc_id, r.taken) for r in other} and sum(r.taken for r in got) == sum(r.taken for r in other)


@pytest.mark.parametrize("few", [500_000, 0])
def test_warc(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    long = "<p>é</p>" * 40
    rows = [(5, "http://a", long), (3, "http://b\nx", long), (9, None, long), (4, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (3, "http://b", long), (None, "n", "y" * 200), (None, "m", "y" * 200), (None, "k", long), (11, "w", "WARC/1.1\r\n\r\n" + "z" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.resolve(warc.headers(pages)), path, 3, 10_000 if few else 1 << 30)
    assert few == 0 or len(list((tmp_path / "w").glob("*.gz"))) >= 6
    got = sorted(warc.read_archives(spark, path).drop("target_uri").collect(), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and h == long and i != 3
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    warc.write_archives(warc.resolve(warc.headers(pages.limit(0))), path + "0")
    assert warc.read_archives(spark, path + "0").count() == 0


def test_likelihoods_in_pieces(monkeypatch):
    data = np.frombuffer("ab cde  é f\nghij klm n ".encode() * 9, np.uint8)
    b, e, _ = word_bounds(data, np.array([0, len(data)]))
    logs = np.log(np.random.default_rng(3).random((1 << language.BUCKET_BITS, 3)))
    whole = language.word_likelihoods(data, b, e, logs)
    monkeypatch.setattr(language, "PIECE", 2)
    assert np.allclose(language.word_likelihoods(data, b, e, logs), whole)
    h = language.trigrams(data)
    assert np.allclose(whole, [logs[h[i : min(j + 1, len(data))]].sum(0) for i, j in zip(b, e)])


def test_language(spark, empty):
    r = random.Random(4)
    letters = {"xx": "abcde", "yy": "klmno", "zz": "tuvwü"}
    say = lambda k, n: " ".join("".join(r.choice(letters[k]) for _ in range(4)) for _ in range(n))
    rows = [(i, say(k, 30), k) for i, k in enumerate(list(letters) * 30)] + [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 34 !", "yy"), (1003, say("xx", 40) + " " + say("yy", 60), None), (None, say("zz", 9), "zz")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.identify(d).collect()}
    for i, t, k in rows:
        if i is None or i < 1000:
            assert got[i].lang_pred == k and got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "yy"] and 0.5 < got[1003].score < 0.7
    assert language.identify(empty).count() == 0
    assert {x.lang_pred for x in language.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark, empty):
    r = random.Random(6)
    vocab = ["".join(r.choice("abdeghilmnoprstu") for _ in range(r.randint(3, 7))) for _ in range(300)] + ["villain"]
    say = lambda n: [r.choice(vocab[:-1]) for _ in range(n)]
    rows, labels = [], []
    for i in range(600):
        w = say(40)
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[r.randrange(40)] = "villain"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    for k, odd in enumerate(["v1ll4in", "v!llain", "villlllain", "v i l l a i n"]):
        w = say(40)
        w[5] = w[20] = w[31] = odd
        rows.append((5000 + k, " ".join(w)))
    rows += [(6000, None), (6001, ""), (None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(d, lab).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert [got[5000 + k].predicted for k in range(4)] == [1, 1, 1, 1]
    assert got[6000].predicted == got[6001].predicted == 0 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    clean = toxicity.keep_clean(d.withColumn("score", F.lit("kept")), lab)
    assert clean.columns == ["doc_id", "text", "score"] and {x.doc_id for x in clean.collect()} == {i for i, x in got.items() if not x.predicted}
    assert toxicity.score_toxicity(empty, lab).count() == 0
    assert {x.score for x in toxicity.score_toxicity(d, lab.filter("toxic = 0")).collect()} == {0.0}


def speller():
    text = "worthless pathetic trash and other worthless words of a pathetic kind from an idiot or a wicked spammer " * 20
    c = toxicity.CLASS[np.frombuffer(text.encode(), np.uint8)]
    counts = np.full((toxicity.CLASSES,) * 3, 0.05)
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    restore = toxicity.Restorer(np.log(counts / counts.sum(2, keepdims=True)).astype(np.float32))

    def read(t):
        raw = t.encode()
        return restore.chunk(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes().decode()

    return restore, read


def test_long_tokens_are_decoded():
    restore, read = speller()
    assert read("so " + " ".join("worthlesspathetictrash") + " it is") == "so worthlesspathetictrash it is"
    assert read("  ".join(" ".join(w) for w in ["worthless", "pathetic", "trash"] * 30)) == "worthlesspathetictrash" * 30
    assert read("so it is worth" + "l" * 60 + "ess") == "so it is worthless"
    assert len(toxicity.decode("a1" * 20_000, restore.model)) >= 20_000


def test_signs_at_the_ends_are_letters():
    _, read = speller()
    for odd, plain in (("!diot", "idiot"), ("id!0t", "idiot"), ("1d10t", "idiot"), ("$pammer", "spammer"), ("tra$h", "trash"), ("@nd", "and"), ("p@7h371c", "pathetic")):
        assert read(f"an {odd} here") == f"an {plain} here"
    assert words(read("(other) \"trash\", words! kind?").translate(str.maketrans("()\",!?", "      "))) == ["other", "trash", "words", "kind"]


def test_signs_numbers_and_doubles():
    """A sign that resembles a letter is one before it is nothing, doubles stay, numbers behind words too."""
    _, read = speller()
    for odd, plain in (("worth1ess", "worthless"), ("tr4sh", "trash"), ("1diot", "idiot"), ("stupi|)", "stupid"), ("idiiiiot", "idiot"), ("sp@mmer", "spammer"), ("*trash*", "trash"), ("tr**ash", "trash"), ("nicht###", "nicht"), ("ench***", "ench"), ("word!!", "word"), ("(see", "see")):
        assert read(f"an {odd} here") == f"an {plain} here"
    for odd in ("*diot", "#ate", "idio*", "!diot", "$pammer"):
        assert len(words(read(f"an {odd} here"))[1]) == len(odd)
    for kept in ("covid19", "mp3", "b2b", "1st", "22nd", "x2"):
        assert read(f"an {kept} here") == f"an {kept} here"


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.01"), reason="no tables")
def test_signs_under_the_model_of_a_corpus(spark):
    restore = toxicity.Restorer(toxicity.language_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    read = lambda t: restore.chunk(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0].tobytes().decode()
    for odd, plain in (("!diot", "idiot"), ("1diot", "idiot"), ("$pammer", "spammer"), ("#ate", "hate"), ("4sshole", "asshole"), ("covid19", "covid19"), ("mp3", "mp3"), ("b2b", "b2b"), ("stupi|)", "stupid")):
        assert read(f"an {odd} here") == f"an {plain} here"
    for odd in ("*diot", "idio*"):
        assert len(words(read(f"an {odd} here"))[1]) == len(odd)
    assert words(read("an worth1ess here"))[1] in ("worthless", "worthiess")


def test_spelled_words_with_any_gap():
    restore, read = speller()
    for gap in (".", "-", "_", "~", "&", "%", "*", " ", ". ", "- "):
        assert read(f"it is {gap.join('trash')}, all") == "it is trash, all"
        assert read(gap.join("trash")) == "trash"
        assert read(f"such an {gap.join('été')} here") == "such an été here"
    assert read("an e.g. or x-ray in 1.2.3 or a.b") == "an e.g. or x-ray in 1.2.3 or a.b"
    assert read("tr4sh-t.r.a.s.h and so on") == "trashtrash and so on"
    texts = ["a.b.c", "é-a_b", "ab c d", "a b", "c d e", "x  y..z", "", "a b cd", "—a b c—", "no", "q&w&e&r", "t", "u", "v", "— é - è"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    found = set(toxicity.may_spell(np.frombuffer(b"".join(raw), np.uint8), offsets).tolist())
    assert {i for i, t in enumerate(texts) if toxicity.SPELLED.search(t)} <= found and {2, 3, 6, 7, 9}.isdisjoint(found)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    pytest.importorskip("pathlib")
    if not __import__("os").path.exists(sf):
        pytest.skip("no tables")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    n = d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        assert 0 < d.count() <= n
        n = d.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, d, sf).collect()
    assert mixed and all(0 < r.taken <= 2 * r.size for r in mixed)
