"""Each stage of the corpus pipeline against an independent form on one small table, and operators on long texts and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from haploframe.llm import decontamination, fingerprints, jaccard, language, lines, mixing, substrings, suffixes, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, part string, cid string, root string, score string, size string"
ITEM = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old oak"


def words(t):
    return WORD.findall(t or "")


def shingles(t, k):
    w = words(t)
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with nulls, repeats and copies, labels and benchmark in a folder."""
    r = random.Random(11)
    vocab = ["".join(r.choice("abdeghilmnoprstu") for _ in range(r.randint(3, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, footer = say(120), say(12)
    texts = [None, "", " \n", "one word", say(30)]
    for k in range(6):
        w = base.split()
        for at in r.sample(range(120), k):
            w[at] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [f"{say(40)}\n{footer}\n{say(20)}" for _ in range(8)]
    texts += [f"{say(10)} {ITEM} {say(10)}", f"{say(5)}\n{ITEM.replace('lazy', 'sleepy')}", ITEM.upper()]
    texts += [say(r.randint(20, 80)) for _ in range(150)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "u", "p", "c", "r", "s", "z") for i, t in enumerate(texts)]
    for i in range(200, 260):
        w = say(40).split()
        for _ in range(3):
            w[r.randrange(40)] = "villain"
        rows.append((i, " ".join(w), "en", "s0", 0, "u", "p", "c", "r", "s", "z"))
    rows += [rows[5], (None, say(40), None, None, None, None, None, None, None, None, None)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i in range(20, 260)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "short"), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def kept(spark, tables, tmp_path_factory):
    """What goes into each stage, and the last one's result."""
    d = spark.read.parquet(f"{tables}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = d
        path = str(tmp_path_factory.mktemp("kept") / "t")
        stage(spark, d, tables).write.parquet(path)
        d = spark.read.parquet(path)
    return out | {"end": d}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_toxic_documents_go(kept):
    before, after = kept["toxicity"], kept["line dedup"]
    assert after.columns == before.columns
    stay = [r for r in before.collect() if "villain" not in (r.text or "")]
    assert rows(after) == sorted(map(tuple, stay), key=repr)


def test_later_lines_go(kept):
    before, after = kept["line dedup"], kept["n-gram join"]
    texts = sorted({(r.doc_id, r.text) for r in before.collect() if r.text is not None and r.doc_id is not None}, key=lambda x: x[0])
    seen, cut = {}, {}
    for i, t in texts:
        x = t.split("\n")
        gone = [False] * len(x)
        for n in (1, 2, 3):
            for j in range(len(x) - n + 1):
                if seen.setdefault(tuple(x[j : j + n]), (i, j)) != (i, j) and (n == 3 or len(words("\n".join(x[j : j + n]))) >= lines.MIN_WORDS):
                    gone[j : j + n] = [True] * n
        cut[i, t] = ("\n".join(y for y, g in zip(x, gone) if not g), any(gone))
    want = []
    for r in before.collect():
        new, gone = cut.get((r.doc_id, r.text), (r.text, False))
        if new or not gone:
            want.append(tuple(new if c == "text" else (None if new is None else len(new)) if c == "n_chars" else r[c] for c in before.columns))
    assert rows(after) == sorted(want, key=repr) and any(g for _, g in cut.values())


def test_one_of_each_component_stays(kept):
    before, after = kept["n-gram join"].collect(), kept["decontamination"].collect()
    nodes = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in before if words(r.text)})
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(n[2].lower(), 5) for n in nodes]
    for x in range(len(nodes)):
        for y in range(x):
            if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                root[max(find(x), find(y))] = min(find(x), find(y))
    want = Counter([nodes[x][1:] for x in range(len(nodes)) if find(x) == x] + [(r.doc_id or 0, r.text or "") for r in {(r.doc_id, r.text): r for r in before}.values() if not words(r.text)])
    assert Counter((r.doc_id or 0, r.text or "") for r in after) == want and len(after) < len(before) - 3


def test_documents_with_items_go(kept):
    before, after = kept["decontamination"], kept["mixing"]
    grams = lambda w: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    item, n = grams(ITEM.split()), len(ITEM.split())

    def clean(r):
        w = words((r.text or "").lower())
        for s in range(max(1, len(w) - n + 1)):
            a = grams(w[s : s + n])
            if sum((a & item).values()) >= 0.8 * sum((a | item).values()):
                return False
        return True

    stay = [r for r in before.collect() if clean(r)]
    assert rows(after) == sorted(map(tuple, stay), key=repr) and before.count() - len(stay) >= 2


def test_mixing_equals_its_sql(kept, tmp_path):
    import duckdb

    before, end = kept["mixing"], kept["end"]
    before.select("doc_id", "text", "source").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    want = con.sql(f"select doc_id, size, source_size, target, taken from ({mixing.oracle()}) where taken > 0").fetchall()
    flat = lambda rows: sorted(((i, s, z, round(t, 6), k) for i, s, z, t, k in rows), key=repr)
    assert flat(end.select("doc_id", "size", "source_size", "target", "taken").collect()) == flat(want) and want


def test_run_equals_its_stages(spark, tables, kept):
    assert rows(corpus_pipeline.run(spark, tables)) == rows(kept["end"])


def test_toxicity_by_an_independent_decoder():
    """Viterbi against all readings of short tokens, under a model of two letters."""
    r = np.random.default_rng(5)
    counts = np.full((toxicity.CLASSES,) * 3, 0.01)
    counts[:28, :28, :28] += r.random((28, 28, 28)) ** 6
    model = np.log(counts / counts.sum(2, keepdims=True)).astype(np.float32)

    def cost(text):
        x = y = 0
        total = 0.0
        for byte in text.encode():
            z = int(toxicity.CLASS[byte])
            total -= float(model[x, y, z])
            x, y = y, z
        return total - float(model[x, y, 0])

    def readings(token, i=0):
        """What a token may say from a place on: doubles are letters, of three or more equal ones any but the first may go; signs that resemble letters are dear to lose, fillers inside cheap; others stay."""
        if i >= len(token):
            yield "", 0.0
            return
        ch, like = token[i], toxicity.LOOKALIKES.get(token[i], "")
        if ch.isalpha():
            run = len(token[i:]) - len(token[i:].lstrip(ch)) + len(token[:i]) - len(token[:i].rstrip(ch))
            puts = [(1, ch, 0.0)] + ([(1, "", toxicity.COST_REPEAT)] if run >= 3 and token[i - 1 : i] == ch else [])
        elif not like and ch not in toxicity.FILLERS:
            puts = [(1, ch, 0.0)]
        else:
            cheap = ch in toxicity.FILLERS and (like == "" or i not in (0, len(token) - 1))
            puts = [(1, x, toxicity.COST_SWAP) for x in like] + [(1, "", toxicity.COST_FILLER if cheap else toxicity.COST_SKIP), (1, ch, toxicity.COST_KEEP)]
        if token[i : i + 2] in toxicity.TWO_SIGNS:
            puts.append((2, toxicity.TWO_SIGNS[token[i : i + 2]], toxicity.COST_SWAP))
        for n, put, price in puts:
            for rest, more in readings(token, i + n):
                yield put + rest, price + more

    for token in ("t3st", "b00k", "a.b.c", "sooo", "1d10t", "f*ck", "h@!r", "x", "l1ll1", "$0$", "*dio*", "ba|)", "b2b", "wo()l", "aabaaa4"):
        best = min(cost(t) + c for t, c in readings(token))
        got = toxicity.decode(token, model)
        assert abs(min(cost(t) + c for t, c in readings(token) if t == got) - best) < 1e-6


def test_mixtures_by_plain_maximisation():
    """The chosen set and shares against all sets of languages, each fitted by EM alone."""
    from itertools import combinations

    r = np.random.default_rng(7)
    texts, wide = [], 0
    for shares in ([1, 0, 0], [0.5, 0.5, 0], [0, 0.2, 0.8], [0.4, 0.3, 0.3]):
        n = 200
        z = r.choice(3, n, p=shares)
        ll = r.normal(-20, 2, (n, 3))
        ll[np.arange(n), z] += 9
        texts.append(ll)
        wide += n
    best, share = language.mixture(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    for k, ll in enumerate(texts):
        found = []
        for m in (1, 2, 3):
            for some in combinations(range(3), m):
                lik, w = np.exp(ll[:, some] - ll.max(1, keepdims=True)), np.full(m, 1 / m)
                for _ in range(200):
                    p = lik * w
                    w = (p / np.maximum(p.sum(1, keepdims=True), 1e-300)).mean(0)
                found.append((np.log(np.maximum((lik * w).sum(1), 1e-300)).sum() - 0.5 * np.log(len(ll)) * (m - 1), some, w))
        _, some, w = max(found, key=lambda x: x[0])
        assert best[k] == some[int(w.argmax())] and abs(share[k] - w.max()) < 0.02


def test_long_texts(spark):
    """Texts beyond all chunk sizes: what lies at their far ends is found."""
    own = lambda name, n: " ".join(f"{name}{k:06d}" for k in range(n))
    passage = own("p", 90)
    texts = {1: own("a", 70_000) + " " + passage, 2: own("b", 40) + "\n" + passage + " " + own("c", 30), 3: own("d", 68_000) + "\n" + ITEM, 4: own("d", 68_000) + " end", 5: "x" * 550_000}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen, want = {}, {}
    for i, t in texts.items():
        w = words(t)
        gone = np.zeros(len(w) + 1, int)
        for j in range(len(w) - 19):
            if seen.setdefault(hash(tuple(w[j : j + 20])), (i, j)) != (i, j):
                gone[j : j + 20] = 1
        want[i] = int(gone.sum())
    assert {r.doc_id: r.n_removed for r in substrings.dedup_words(d).collect()} == want and want[2] == 90 and want[4] == 68_000
    count = Counter(hash(b[j : j + 400]) for t in texts.values() for b in [t.encode()] for j in range(len(b) - 399))
    for r in suffixes.dedup_bytes(d).collect():
        b = texts[r.doc_id].encode()
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - 399):
            if count[hash(b[j : j + 400])] > 1:
                gone[j] += 1
                gone[j + 400] -= 1
        assert r.n_removed == int((np.cumsum(gone) > 0).sum())
    got = {r.doc_id: r for r in jaccard.jaccard_components(d).collect()}
    assert got[4].component_id == 3 and got[1].component_id == 1 and got[1].n_shingles == 70_088
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert [(r.doc_id, r.similarity) for r in decontamination.leaks(d, bench).collect()] == [(3, 1.0)]
    assert {r.doc_id: r.n_chars for r in fingerprints.fingerprint_edits(d).collect()} == {i: len(t) for i, t in texts.items()}
    assert {r.doc_id: r.size for r in mixing.mix_sources(d.selectExpr("*", "'s' as source")).collect()} == {i: len(words(t)) for i, t in texts.items()}
    lang = spark.createDataFrame([(i, t, "aa" if i != 5 else "xx") for i, t in texts.items()], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(lang).collect()} <= {"aa", "xx"}
    lab = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    assert toxicity.score_toxicity(d, lab).count() == 5


def test_clashing_columns(spark, tables, tmp_path):
    """Columns with the operators' own names change nothing."""
    d = spark.read.parquet(f"{tables}/documents.parquet")
    plain = d.select("doc_id", "text", "lang", "source")
    more = plain.selectExpr("*", *(f"'x' as {c}" for c in ("uid", "words", "hashes", "at", "block", "width", "start", "item_id", "toxic", "score", "held_out", "predicted", "a", "n", "size", "run", "key", "print", "part", "content", "text_hash", "similarity")))
    lab, bench = spark.read.parquet(f"{tables}/labels.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    for f in (lambda x: decontamination.leaks(x, bench.selectExpr("*", "1 as doc_id", "'y' as words", "2 as width")), lambda x: toxicity.score_toxicity(x, lab.selectExpr("*", "'y' as text")), language.identify, fingerprints.fingerprint_edits, mixing.mix_sources):
        assert rows(f(more)) == rows(f(plain))
    pages = spark.createDataFrame([(2, "u", "y" * 120), (1, "u", "y" * 120), (3, None, None)], "page_id long, url string, html string")
    odd = pages.selectExpr("*", *(f"'x' as {c}" for c in ("payload", "payload_digest", "payload_bytes", "first", "n", "refers_to", "block", "value")))
    for k, p in enumerate((pages, odd)):
        warc.write_archives(warc.resolve(warc.headers(p)), str(tmp_path / f"w{k}"))
    a, b = (rows(warc.read_archives(spark, str(tmp_path / f"w{k}"))) for k in (0, 1))
    assert a == b and [(r[0], r[3], r[4]) for r in a] == [(1, "response", None), (2, "revisit", 1), (3, "response", None)]
    assert [r[2] for r in a][0] == hashlib.sha256(b"y" * 120).hexdigest()
