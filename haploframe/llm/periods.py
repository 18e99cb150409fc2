"""Periodic runs of words: maximal stretches that repeat a short piece, found on a harmonic grid, and their collapse.

A run of period q and length r is a stretch of r - q places whose word equals the one q places on. With r at least
``least`` and ``exponent`` times q such a stretch is never shorter than step(q), the greater of the two less q, so one
of the places 0, step(q), 2 step(q), … lies in it. The grid holds these places for all periods at once, n ln n / 3 of
them for n words. Where the two words of a grid point are equal, the common extensions to both sides are found by binary
search on prefix hashes, for all points simultaneously. Runs found from several points or under multiples of their
period are told apart by their bounds (the smallest period stays; it divides the others), and each is verified word by
word: words are numbered exactly, and a stretch that the hashes have overrated is compared in full.

A text's words are worked on in one task; the grid is gone through in pieces of ``POINTS``, so memory grows with the
text alone. Documents are never compared with each other, so copies, ties and skewed sources need no care.

A null or blank text has no words, no runs and collapses to an empty text. Repeated rows give equal rows. Other columns
pass through; existing columns named runs, n_words and collapsed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, words_of
from .tokens import BASE, mix, powers, text_chunks, word_bounds

LEAST = 6
EXPONENT = 4
#: Grid points looked at together.
POINTS = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_numbers(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only. data holds nothing but these words and separators."""
    sizes = ends - begins
    where = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(sizes, out=where[1:])
    letters = data[np.arange(where[-1]) + np.repeat(begins - where[:-1], sizes)]
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(where), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy()


def same(sums: np.ndarray, power: np.ndarray, at: np.ndarray, lag: np.ndarray, size) -> np.ndarray:
    """Whether the size places from each place on have the hash of those lag on."""
    return (sums[at + size] - sums[at]) * power[lag] == sums[at + lag + size] - sums[at + lag]


def extend(sums: np.ndarray, power: np.ndarray, at: np.ndarray, lag: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many places in a row from each place on (before it, if back) equal those lag on, at most room; all by one binary search."""
    found = np.zeros(len(at), np.int64)
    for bit in range(int(room.max(initial=0)).bit_length() - 1, -1, -1):
        size = 1 << bit
        some = np.flatnonzero(found + size <= room)
        x = at[some] - found[some] - size if back else at[some] + found[some]
        found[some[same(sums, power, x, lag[some], size)]] += size
    return found


def half_way(sums: np.ndarray, power: np.ndarray, at: np.ndarray, lag: np.ndarray, step: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places that may lie in a stretch of step: half of it lies on one side. low, high: the bounds of their texts."""
    half = (step + 1) // 2
    ahead, back = at + half + lag <= high, at - half >= low
    ahead[ahead] = same(sums, power, at[ahead], lag[ahead], half[ahead])
    back &= ~ahead
    back[back] = same(sums, power, at[back] - half[back], lag[back], half[back])
    return np.flatnonzero(ahead | back)


def stretches(ids: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal stretches of places that equal the one lag on, by comparing all of them."""
    edge = np.diff(np.concatenate(([0], (ids[:-lag] == ids[lag:]).astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def smallest_periods(runs: np.ndarray) -> np.ndarray:
    """Of rows (start, length, period) with equal bounds the one with the smallest period, which is the run's own."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[first]


def find(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """(start, length, period) of all runs of some texts laid end to end, by start, then period. bounds: the first word of each text, and the end."""
    sizes = np.diff(bounds)
    texts = np.flatnonzero(sizes >= max(least, exponent))
    each = sizes[texts] // exponent
    # A row for each text and period, and how many grid points it has.
    text = np.repeat(texts, each)
    period = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each) + 1
    steps = np.maximum(least, exponent * period) - period
    counts = -(-(sizes[text] - period) // steps)
    total = np.concatenate(([0], np.cumsum(counts)))
    power = powers(BASE, len(ids) + 1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * power[: len(ids)], out=sums[1:])
    found, lo = [np.zeros((0, 3), np.int64)], 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + POINTS, "right")) - 1)
        row = np.repeat(np.arange(lo, hi), counts[lo:hi])
        at = bounds[text[row]] + (np.arange(total[lo], total[hi]) - total[row]) * steps[row]
        equal = np.flatnonzero(ids[at] == ids[at + period[row]])
        row, at = row[equal], at[equal]
        low, high = bounds[text[row]], bounds[text[row] + 1]
        some = half_way(sums, power, at, period[row], steps[row], low, high)
        row, at, low, high = row[some], at[some], low[some], high[some]
        lag = period[row]
        start = at - extend(sums, power, at, lag, at - low, True)
        length = at + extend(sums, power, at, lag, high - lag - at, False) - start + lag
        long = length >= steps[row] + lag
        found.append(smallest_periods(np.stack((start[long], length[long], lag[long]), 1)))
        lo = hi
    runs = smallest_periods(np.concatenate(found))
    right = np.array([np.array_equal(ids[s : s + r - q], ids[s + q : s + r]) for s, r, q in runs.tolist()], bool)
    for s, r, q in runs[~right].tolist():
        # What the hashes have overrated is searched for by comparing all of it.
        b, e = stretches(ids[s : s + r], q)
        long = e - b + q >= max(least, exponent * q)
        exact = np.stack((s + b[long], (e - b)[long] + q, np.full(int(long.sum()), q)), 1)
        runs, right = np.concatenate((runs, exact)), np.concatenate((right, np.ones(len(exact), bool)))
    runs = smallest_periods(runs[right])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """The words that no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


def collapse(column: pa.Array, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """For each text its number of words and of runs; the runs, starts counted in their texts; and what is left of each text, words joined by one blank."""
    sizes, counts, found, left = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)], []
    for _, _, data, offsets in text_chunks(column):
        b, e, first = word_bounds(data, offsets)
        runs = find(word_numbers(data, b, e), first, least, exponent)
        kept = kept_words(len(b), runs)
        # All kept words, a blank after each.
        b, size = b[kept], (e - b)[kept] + 1
        ends = np.concatenate(([0], np.cumsum(size)))
        out = np.full(ends[-1], 32, np.uint8)
        letter = np.ones(ends[-1], bool)
        letter[ends[1:] - 1] = False
        place = np.flatnonzero(letter)
        out[place] = data[place + np.repeat(b - ends[:-1], size - 1)]
        bound, whole = ends[np.concatenate(([0], np.cumsum(kept)))[first]].tolist(), out.tobytes()
        of = np.searchsorted(first, runs[:, 0], "right") - 1
        sizes.append(np.diff(first))
        counts.append(np.bincount(of, minlength=len(first) - 1))
        found.append(runs - np.stack((first[of], 0 * of, 0 * of), 1))
        left += [whole[x : max(x, y - 1)] for x, y in zip(bound[:-1], bound[1:])]
    return np.concatenate(sizes), np.concatenate(counts), np.concatenate(found), left


def collapser(at: int, least: int, exponent: int):
    """Batches to the same with n_words, runs and collapsed; at: the text's column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, found, left = collapse(batch.column(at), least, exponent)
            structs = pa.StructArray.from_arrays([pa.array(c) for c in found.T], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), runs, pa.array(left, pa.binary()).cast(pa.string())], [*batch.schema.names, "n_words", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """docs with n_words, runs (start, length, period of each, by start, then period) and collapsed, the text without what its runs repeat."""
    if least < 1 or exponent < 2:
        raise ValueError("a run has a word at least and holds its period twice")
    base = docs.drop("n_words", "runs", "collapsed")
    schema = StructType([*base.schema.fields, *StructType.fromDDL(f"n_words bigint, runs {RUNS}, collapsed string").fields])
    return base.mapInArrow(collapser(base.columns.index("text"), least, exponent), schema)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; the first of equal ones, null of none."""
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    return F.aggregate(runs, F.lit(None).cast(kind), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs, where a tenth of the ids, by their hash, get a text that repeats a piece of itself from some word on (see op13_periodic_runs); null ids don't."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def changed(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p)))

    # The words are made once for each text: inside the lambda they are a value.
    texts = F.transform(F.array(words_of(F.col("text"))), lambda w: F.when(F.size(w) > 0, F.array_join(changed(w), " ")))
    return docs.withColumn("text", F.when(h % 10 == 0, F.get(texts, 0)).otherwise(F.col("text")))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of the documents' words, where each document with h = crc32(decimal doc_id), h % 10 = 0 and g = floor(h / 10) repeats a + (i - a) % p at word i >= a = g % n, p = 1 + floor((n - a) / (3 + g % 8))."""
    d = collapse_runs(with_planted_periods(documents(spark, sf_dir).select("doc_id", "text"))).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    milli = F.expr("best.length * 1000 div best.period")
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def crc32_sql(text: str) -> str:
    """The CRC-32 of a short text of digits and signs, in DuckDB."""
    bits = "list_reduce(range(8), lambda v, k: case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda s: ascii(s)::bigint), lambda c, b: {bits}, 4294967295::bigint), 4294967295::bigint)"


#: Every pair of equal words up to a quarter of the text apart, joined to islands of neighbouring pairs.
ORACLE = f"""
with w0 as (select row_number() over () as id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w, {crc32_sql("doc_id::varchar")} as h from documents),
w1 as (select *, len(w) as n, h // 10 as g from w0),
w2 as (select *, case when n > 0 then g % n end as a from w1),
w3 as (select *, 1 + (n - a) // (3 + g % 8) as p from w2),
t as (select id, doc_id, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) else w end as w, n from w3),
o as (select id, n, unnest(range(n)) as i, unnest(w) as word from t),
eq as (select x.id, x.i, y.i - x.i as q from o x join o y on x.id = y.id and x.word = y.word and y.i > x.i and y.i - x.i <= x.n // {EXPONENT}),
il as (select id, q, i, i - row_number() over (partition by id, q order by i) as island from eq),
st as (select id, q, min(i) as s, count(*) + q as r from il group by id, q, island having count(*) + q >= greatest({LEAST}, {EXPONENT} * q)),
rn as (select id, s, r, min(q) as q from st group by id, s, r),
gone as (select distinct id, unnest(range(s + q, s + r)) as i from rn),
left_ as (select o.id, string_agg(word, ' ' order by o.i) as kept from o anti join gone using (id, i) group by o.id),
be as (select * from (select *, row_number() over (partition by id order by r / q::double desc, s, q) as k from rn) where k = 1),
rs as (select id, count(*) as n_runs, string_agg(s || ',' || r || ',' || q || chr(10), '' order by s, q) as lines from rn group by id)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, r::bigint as length, q::bigint as period, (1000 * r // q)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from t left join rs using (id) left join be using (id) left join left_ using (id)
"""
