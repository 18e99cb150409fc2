"""Language identification by multilingual mixture inference.

Every language has a distribution of byte trigrams (hashed, smoothed), counted over all labelled training documents.
A document is a mixture of languages whose words each come from one of them: expectation-maximisation estimates the
proportions from the words' trigram likelihoods. The set of languages is the one with the greatest log-likelihood less
half a log of the number of words for each language beyond the first: languages leave one by one, smallest share
first, while that gains. The prediction is the language with the largest share, its score that share.

Null texts and texts without a letter are ``und`` with score 0; if no document teaches a language, all are ``und``.
A null doc_id is neither held out nor learned from. Repeated rows get equal results; an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents
from .tokens import LOWER, text_chunks, word_bounds

FOLDS = 5
BUCKET_BITS = 15
SMOOTHING = 0.5
ROUNDS = 12
UNKNOWN = "und"
#: Words whose likelihoods are summed at once.
PIECE = 1 << 14
#: Letters in a byte view: ASCII letters and the bytes of longer characters.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes that end at each place; spaces and other marks all count as one mark."""
    x = np.where(IS_LETTER[data], LOWER[data], np.uint8(32)).astype(np.uint32)
    h = np.empty(len(x), np.uint32)
    one, two = np.append(np.uint32(32), x)[:-1], np.append(np.array([32, 32], np.uint32), x)[:-2]
    h = (x << np.uint32(16) | one << np.uint32(8) | two) * np.uint32(2654435761)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) batches to (lang, bucket, n), summed over a partition."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for row, end, data, offsets in text_chunks(batch.column(1)):
            h = trigrams(data)
            names = sorted(set(langs[row:end]))
            code = np.repeat(np.array([names.index(x) for x in langs[row:end]]), np.diff(offsets))
            for i, name in enumerate(names):
                total.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))
                total[name] += np.bincount(h[code == i], minlength=1 << BUCKET_BITS)
    for name, counts in total.items():
        b = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array(b), pa.array(counts[b])], ["lang", "bucket", "n"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and their log-probabilities, a row for each bucket."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    table = rows.mapInArrow(count_trigrams, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    counts = np.full((1 << BUCKET_BITS, len(langs)), SMOOTHING)
    if langs:
        code = {x: i for i, x in enumerate(langs)}
        np.add.at(counts, (table["bucket"].to_numpy(), np.array([code[x] for x in table["lang"].to_pylist()])), table["n"].to_numpy())
    return langs, np.log(counts / counts.sum(0))


def mixture(word_ll: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the best language of its chosen set and that one's share. word_ll: a row for each word; first: the first word of each text, and the end."""
    texts, langs = len(first) - 1, word_ll.shape[1]
    n = np.diff(first)
    best, share = np.full(texts, -1), np.zeros(texts)
    some = np.flatnonzero(n)
    if not len(some):
        return best, share
    of = np.repeat(np.arange(len(some)), n[some])
    begin = first[:-1][some]
    top = word_ll.max(1)
    lik = np.exp(word_ll - top[:, None])

    def fit(allowed: np.ndarray, rows: np.ndarray, lik: np.ndarray, of: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ROUNDS):
            r = lik * w[of]
            r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
            w = np.add.reduceat(r, begin, axis=0) / np.diff(np.append(begin, len(lik)))[:, None]
        total = np.log(np.maximum((lik * w[of]).sum(1), 1e-300))
        return w, np.add.reduceat(total, begin)

    price = 0.5 * np.log(np.maximum(n[some], 2))
    allowed = np.ones((len(some), langs))
    w, ll = fit(allowed, some, lik, of, begin)
    value = ll - price * (langs - 1)
    live = np.arange(len(some))
    while langs > 1 and len(live):
        # The texts that may still gain by losing their smallest language.
        sizes = allowed[live].sum(1)
        live = live[sizes > 1]
        if not len(live):
            break
        least = np.where(allowed[live] > 0, w[live], np.inf).argmin(1)
        trial = allowed[live].copy()
        trial[np.arange(len(live)), least] = 0
        pick = np.isin(of, live)
        sub_of = np.searchsorted(live, of[pick])
        sub_begin = np.searchsorted(sub_of, np.arange(len(live)))
        w2, ll2 = fit(trial, live, lik[pick], sub_of, sub_begin)
        value2 = ll2 - price[live] * (trial.sum(1) - 1)
        better = value2 >= value[live]
        live_kept = live[better]
        allowed[live_kept], w[live_kept], value[live_kept] = trial[better], w2[better], value2[better]
        live = live_kept
    best[some] = w.argmax(1)
    share[some] = w.max(1)
    return best, share


def word_likelihoods(data: np.ndarray, b: np.ndarray, e: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """A row for each word, the sum of its trigrams' log-probabilities and that of the mark after it. Running sums go over PIECE words at a time, so memory beyond the result doesn't grow with a text."""
    out = np.empty((len(b), logs.shape[1]))
    for lo in range(0, len(b), PIECE):
        begin, end = b[lo : lo + PIECE], np.minimum(e[lo : lo + PIECE] + 1, len(data))
        x = max(0, int(begin[0]) - 2)
        sums = np.zeros((int(end[-1]) - x + 1, logs.shape[1]))
        np.cumsum(logs[trigrams(data[x : end[-1]])], axis=0, out=sums[1:])
        out[lo : lo + PIECE] = sums[end - x] - sums[begin - x]
    return out


def predictor(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = model.value
        for batch in batches:
            names, scores = [], []
            for row, end, data, offsets in text_chunks(batch.column(2)):
                letter = np.concatenate(([0], np.cumsum((IS_LETTER & (np.arange(256) < 128))[data])))
                plain = letter[offsets[1:]] > letter[offsets[:-1]]
                b, e, first = word_bounds(data, offsets)
                if langs and len(b):
                    best, share = mixture(word_likelihoods(data, b, e, logs), first)
                else:
                    best, share = np.full(end - row, -1), np.zeros(end - row)
                for i in range(end - row):
                    known = best[i] >= 0 and (plain[i] or any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode())))
                    names.append(langs[best[i]] if known else UNKNOWN)
                    scores.append(min(1.0, float(share[i])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs (doc_id, text, lang)."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predictor(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op10_language(spark, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
