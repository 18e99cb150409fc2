"""Toxicity: noisy-channel deobfuscation and a score of the restored text.

A character language model (trigrams of 64 character classes) is counted over all documents. Tokens that look
obfuscated (digits or signs for letters, letters repeated three times or more, three or more single letters in a row
with one or two blanks, dots, dashes or the like between them, also inside a token) become
lattices: a sign may stand for the letters it resembles, and at a higher price for nothing or itself; a letter repeated
three times or more for itself or for nothing, while doubles stay; gaps between single letters for nothing. Words with
a plain number behind them, signs that resemble no letter and marks at a token's ends are left as they are. Viterbi decoding finds the most likely letters under the model
and the costs of the channel, and the restored token takes the place of the written one.

The classifier counts in how many toxic and other training documents each word and each run of five bytes of a word
occurs, hashed. A document's evidence is the log-odds of what it holds, summed up by its highest values; a logistic
regression turns that into a score. It is fitted on a sample of at most ``SAMPLE`` labelled training documents (those
with the smallest hashed ids), with each document's own counts left out of its evidence.

Null and empty texts have no evidence and get the score of that. A null doc_id is neither held out nor learned from;
of several labels of an id the largest counts, null ones don't; without labels of both kinds all scores are 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .language import IS_LETTER, held_out
from .tokens import IS_SPACE, LOWER, mix, text_chunks, word_bounds, word_hashes
from .windows import byte_grams

SAMPLE = 20_000
FEATURE_BITS = 20
GRAM = 5
PRIOR = 4.0
#: Letters that signs and digits may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "%": "", "&": "", ".": "", "-": "", "_": "", "~": "", "^": "a"}
#: Two signs that stand for one letter.
TWO_SIGNS = {"|)": "d", "|<": "k", "|3": "b", "|2": "r", "()": "o"}
#: Prices in the channel, as negative log-probabilities: a sign stands for a letter it resembles, for nothing, for itself; a filler or a letter repeated three times or more stands for nothing. A sign that resembles no letter is itself.
COST_SWAP, COST_SKIP, COST_KEEP, COST_FILLER, COST_REPEAT = 1.0, 20.0, 22.0, 0.7, 0.7
FILLERS = frozenset(".-_~%&*#")
#: What may stand between the letters of a spelled-out word of three letters or more, once or twice.
GAPS = " .-_*~%&"
SPELLED = re.compile(rf"(?<![^\W_])(?:[^\W_][{re.escape(GAPS)}]{{1,2}}){{2,}}[^\W_](?![^\W_])")
TO_BLANKS = str.maketrans(dict.fromkeys(GAPS, " "))
CACHE = 100_000
#: Longer tokens, in characters, are decoded anew each time.
LONG = 40
CLASSES = 64


def classes_of() -> np.ndarray:
    """A class for each byte: 0 for marks, 1-26 for letters, the rest shared by the bytes of longer characters."""
    c = np.zeros(256, np.int64)
    c[97:123] = c[65:91] = np.arange(1, 27)
    c[128:] = 27 + np.arange(128) % (CLASSES - 27)
    return c


CLASS = classes_of()


def count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for _, _, data, _ in text_chunks(batch.column(0)):
            c = CLASS[data]
            if len(c) > 2:
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    b = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(total[b])], ["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(third class | first two), smoothed."""
    t = docs.filter(F.col("text").isNotNull()).select("text").mapInArrow(count_characters, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(CLASSES**3, 0.05)
    counts[t["gram"].to_numpy()] += t["n"].to_numpy()
    counts = counts.reshape(CLASSES, CLASSES, CLASSES)
    return np.log(counts / counts.sum(2, keepdims=True)).astype(np.float32)


def edges_of(token: str) -> list[list[tuple[int, str, float]]]:
    """For each place of a token what may stand there: signs taken, letters put, price."""
    out = []
    for i, ch in enumerate(token):
        if ch.isalpha():
            edges = [(1, ch, 0.0)]
            # Doubles are letters; of three or more any but the first may go.
            if i and token[i - 1] == ch and (token[i - 2 : i - 1] == ch or token[i + 1 : i + 2] == ch):
                edges.append((1, "", COST_REPEAT))
        elif ch == " ":
            edges = [(1, "", 0.2)]
        else:
            letters = LOOKALIKES.get(ch, "")
            edges = [(1, x, COST_SWAP) for x in letters]
            edges.append((1, ch, COST_KEEP if letters or ch in FILLERS else 0.0))
            if letters or ch in FILLERS:
                # At an end a sign that resembles a letter is one; inside it may as well fill a gap.
                edges.append((1, "", COST_FILLER if ch in FILLERS and (not letters or 0 < i < len(token) - 1) else COST_SKIP))
            if put := TWO_SIGNS.get(token[i : i + 2]):
                edges.append((2, put, COST_SWAP))
        out.append(edges)
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The most likely letters behind an obfuscated token: Viterbi over (last two classes) states, each with its cost and a chain of what was put."""
    ahead: list[dict[tuple[int, int], tuple[float, tuple | None]]] = [{(0, 0): (0.0, None)}, {}, {}]
    for edges in edges_of(token):
        states = ahead[0]
        for (a, b), (cost, out) in states.items():
            for taken, put, price in edges:
                x, y, c = a, b, cost + price
                for byte in put.encode():
                    z = int(CLASS[byte])
                    c -= float(model[x, y, z])
                    x, y = y, z
                after = ahead[taken]
                if (x, y) not in after or c < after[x, y][0]:
                    after[x, y] = (c, (out, put) if put else out)
        ahead = [ahead[1], ahead[2], {}]
    chain, parts = min(((c - float(model[x, y, 0]), out) for (x, y), (c, out) in ahead[0].items()), key=lambda end: end[0])[1], []
    while chain:
        parts.append(chain[1])
        chain = chain[0]
    return "".join(reversed(parts))


#: Marks at a token's ends that are punctuation: quotes, brackets, sentence marks, and signs two or more of which stand together.
EDGES = re.compile(r"""^(?:["'(\[{.,;:?]|([*#%&$!])\1+)+|(?:["'\]}.,;:!?]|(?<!\|)\)|([*#%&$!])\2+)+$""")
#: Emphasis round a word.
EMPHASIS = re.compile(r"([*_#~])(.+)\1")
#: A word with a plain number behind it, an ordinal.
NUMBERED = re.compile(r"[^\W\d_]+[0-9]+|[0-9]+(?:st|nd|rd|th)")


SUSPECT = np.zeros(256, bool)
SUSPECT[[ord(c) for c in LOOKALIKES if ord(c) < 128 and c not in ".-_~&%"]] = True


IS_GAP, IS_NAME, MAY_NAME = (np.zeros(256, bool) for _ in range(3))
IS_GAP[list(GAPS.encode())] = True
IS_NAME[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Characters of several bytes may be letters too.
MAY_NAME[IS_NAME] = MAY_NAME[192:] = True


def may_spell(low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts that may hold three single letters with gaps between them: all that SPELLED finds, and some more."""
    start = np.flatnonzero((low & 0xC0) != 0x80)
    ch = np.concatenate((low[start], np.zeros(6, np.uint8)))
    n = len(start)
    one, gap, sure = MAY_NAME[ch], IS_GAP[ch], IS_NAME[ch]
    # Letters that continue a word are not single; texts touch each other here.
    mark = np.zeros(len(low) + 1, bool)
    mark[offsets] = True
    first = mark[start]
    single = one.copy()
    single[1:n] &= ~(sure[: n - 1] & ~first[1:])
    single[: n - 1] &= ~(sure[1:n] & ~first[1:])
    at = np.flatnonzero(single[:n] & gap[1 : n + 1])
    step = lambda i: np.where(single[i + 2], i + 2, np.where(gap[i + 2] & single[i + 3], i + 3, -1))
    to = step(at)
    at, to = at[to >= 0], to[to >= 0]
    on = gap[to + 1]
    at, to = at[on], to[on]
    return np.unique(np.searchsorted(offsets, start[at[step(to) >= 0]], "right") - 1)


class Restorer:
    """Restores the texts of a chunk; remembers what tokens mean."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def token(self, raw: str) -> str:
        # A sign that touches the letters may stand for one.
        core = EDGES.sub("", raw)
        if m := EMPHASIS.fullmatch(core):
            core = m[2]
        if len(core) < 2 or not any(map(str.isalpha, core)) or NUMBERED.fullmatch(core):
            return raw
        if len(core) > LONG:
            return decode(core, self.model)
        if core not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[core] = decode(core, self.model)
        return self.known[core]

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lower-cased bytes and offsets with suspicious tokens replaced."""
        low = LOWER[data]
        b, e, first = word_bounds(low, offsets)
        if not len(b):
            return low, offsets
        sign = np.concatenate(([0], np.cumsum(SUSPECT[low])))
        letter = np.concatenate(([0], np.cumsum(IS_LETTER[low])))
        triple = np.zeros(len(low) + 1, np.int64)
        if len(low) > 2:
            triple[1 : len(low) - 1] = np.cumsum((low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & IS_LETTER[low[2:]] & (low[2:] < 128))
            triple[len(low) - 1 :] = triple[len(low) - 2]
        odd = (letter[e] > letter[b]) & ((sign[e] > sign[b]) | (triple[np.maximum(e - 2, b)] > triple[b]))
        odd &= ~((letter[e] - letter[b] == 1) & (e - b <= 2))
        parts, at, sizes = [], 0, np.diff(offsets).copy()
        # Words spelled out letter by letter, across tokens or inside one.
        spans: list[tuple[int, int, bytes]] = []
        for doc in may_spell(low, offsets):
            x, y = int(offsets[doc]), int(offsets[doc + 1])
            text, k = low[x:y].tobytes().decode("utf-8", "replace"), 0
            for m in SPELLED.finditer(text):
                p = x + len(text[k : m.start()].encode())
                x, k = p + len(m.group().encode()), m.end()
                if any(map(str.isalpha, m.group())):
                    spans.append((p, x, self.token(m.group().translate(TO_BLANKS)).encode()))
        begins, ends = [p for p, _, _ in spans], [q for _, q, _ in spans]
        changes = list(spans)
        for i in np.flatnonzero(odd):
            # What of a token lies outside spelled words.
            x, k = int(b[i]), bisect_right(ends, int(b[i]))
            while x < e[i]:
                y = min(int(e[i]), begins[k]) if k < len(spans) else int(e[i])
                if x < y and (new := self.token(old := low[x:y].tobytes().decode("utf-8", "replace")).encode()) != old.encode():
                    changes.append((x, y, new))
                x, k = max(x, ends[k]) if k < len(spans) else y, k + 1
        if not changes:
            return low, offsets
        whole = low.tobytes()
        for p, q, new in sorted(changes):
            parts += [whole[at:p], new]
            sizes[np.searchsorted(offsets, p, "right") - 1] += len(new) - (q - p)
            at = q
        parts.append(whole[at:])
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature at each byte place (a run of five bytes), then of each word, and the text each belongs to."""
    x = np.where(IS_LETTER[data], data, np.uint8(32))
    grams = byte_grams(x, GRAM)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = text[: len(grams)] == text[GRAM - 1 :] if len(grams) else np.zeros(0, bool)
    # A run holds no mark after its first byte, which may be the one before the word.
    gaps = np.concatenate(([0], np.cumsum(x == 32)))
    whole &= gaps[GRAM : GRAM + len(grams)] == gaps[1 : 1 + len(grams)]
    at = np.flatnonzero(whole)
    b, e, first = word_bounds(x, offsets)
    words = word_hashes(x, b, e)
    values = np.concatenate((grams[at], mix(words ^ np.uint64(0xABCD)))) >> np.uint64(64 - FEATURE_BITS)
    return values.astype(np.int64), np.concatenate((text[at], text[b]))


def distinct_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs without repeats, sorted."""
    f, t = features(data, offsets)
    both = np.unique(t << FEATURE_BITS | f)
    return both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1)


def count_features(model) -> Callable:
    """(toxic, text) batches to (feature, toxic, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, restore = np.zeros((2, 1 << FEATURE_BITS), np.int64), Restorer(model.value)
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            for row, end, data, offsets in text_chunks(batch.column(1)):
                t, f = distinct_features(*restore.chunk(data, offsets))
                for y in (0, 1):
                    total[y] += np.bincount(f[toxic[row + t] == y], minlength=1 << FEATURE_BITS)
        for y in (0, 1):
            f = np.flatnonzero(total[y])
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.full(len(f), y)), pa.array(total[y][f])], ["feature", "toxic", "n"])

    return run


def log_odds(t: np.ndarray, n: np.ndarray, all_t: float, all_n: float) -> np.ndarray:
    share = all_t / (all_t + all_n)
    return np.log((t + PRIOR * share) / all_t) - np.log((n + PRIOR * (1 - share)) / all_n)


def summary(odds: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """For each text: constant, highest odds, means of the highest 3 and 10, and the mean of all."""
    by = np.lexsort((-odds, text))
    odds, text = odds[by], text[by]
    first = np.searchsorted(text, np.arange(texts + 1))
    sums = np.concatenate(([0.0], np.cumsum(odds)))
    n = np.diff(first)
    mean = lambda k: (sums[np.minimum(first[:-1] + k, first[1:])] - sums[first[:-1]]) / k
    all_ = np.where(n > 0, (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1), 0)
    return np.stack((np.ones(texts), mean(1), mean(3), mean(10), all_), 1)


def evidence(model, counts, own: bool) -> Callable:
    """(toxic, text) batches to the summary of each row; own: the row's own counts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (t_count, n_count, all_t, all_n), restore = counts.value, Restorer(model.value)
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            for row, end, data, offsets in text_chunks(batch.column(1)):
                text, f = distinct_features(*restore.chunk(data, offsets))
                y = toxic[row + text] == 1
                s = summary(log_odds(t_count[f] - y, n_count[f] - ~y, all_t, all_n), text, end - row)
                yield pa.RecordBatch.from_arrays([pa.array(toxic[row:end].astype(np.int64)), *(pa.array(c) for c in s.T)], ["toxic", "x0", "x1", "x2", "x3", "x4"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def sifter(model, fitted) -> Callable:
    """Batches with a text column to their rows scored under 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model, fitted)
        for batch in batches:
            ids = pa.array(np.zeros(len(batch), np.int64))
            scored = score(iter([pa.RecordBatch.from_arrays([ids, ids, batch.column(batch.schema.get_field_index("text"))], ["doc_id", "held_out", "text"])]))
            low = np.concatenate([r.column(2).to_numpy() for r in scored]) < 0.5
            yield batch.filter(pa.array(low))

    return run


def scorer(model, fitted) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model.value)
        odds, w = fitted.value
        for batch in batches:
            scores = []
            for row, end, data, offsets in text_chunks(batch.column(2)):
                if odds is None:
                    scores.append(np.zeros(end - row))
                    continue
                text, f = distinct_features(*restore.chunk(data, offsets))
                scores.append(1 / (1 + np.exp(-np.clip(summary(odds[f], text, end - row) @ w, -30, 30))))
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def train(docs: DataFrame, labels: DataFrame, model, sample: int = SAMPLE):
    """(log-odds of the features, weights), or (None, None) without labels of both kinds."""
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select((F.col("toxic") > 0).cast("int").alias("toxic"), "text")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None, None
    counts = np.zeros((2, 1 << FEATURE_BITS), np.int32)
    table = rows.mapInArrow(count_features(model), "feature long, toxic long, n long").groupBy("feature", "toxic").agg(F.sum("n").alias("n")).toArrow()
    counts[table["toxic"].to_numpy(), table["feature"].to_numpy()] = table["n"].to_numpy()
    totals = counts[1], counts[0], float(sizes[1]), float(sizes[0])
    x = rows.mapInArrow(evidence(model, spark.sparkContext.broadcast(totals), True), "toxic long, x0 double, x1 double, x2 double, x3 double, x4 double").toArrow()
    w = logistic(np.stack([x[f"x{i}"].to_numpy() for i in range(5)], 1), x["toxic"].to_numpy().astype(float))
    return log_odds(*totals).astype(np.float32), w


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text)."""
    context = docs.sparkSession.sparkContext
    model = context.broadcast(language_model(docs))
    fitted = context.broadcast(train(docs, labels, model, sample))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(scorer(model, fitted), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under 0.5."""
    context = docs.sparkSession.sparkContext
    model = context.broadcast(language_model(docs))
    fitted = context.broadcast(train(docs, labels, model, sample))
    return docs.mapInArrow(sifter(model, fitted), docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
