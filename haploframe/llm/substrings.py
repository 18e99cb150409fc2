"""Substring dedup: a compressed FM-index per shard and backward search over its wavelet tree.

Stretches of words whose anchors occur again (see windows) meet in the shard of their anchor, where equal ones are
merged. A shard's index is the transform of its word sequence as a wavelet tree shaped by the words' frequencies (its
bits are near the sequence's entropy) and one bit a row that tells where the first ``WIDTH`` words change; the suffix
array serves to build them and is dropped. All stretches are streamed through the index at once from their right ends:
each step extends the matches by one word to the left through two rank queries, and a match longer than ``WIDTH`` words
falls back to the interval of its first ``WIDTH`` words. So the search gives each window that reaches the threshold an
interval, equal for equal windows, and the least (doc_id, part, place) of what came to an interval tells whether a
window also starts earlier. Suffixes are ordered by their first 32 words, enough for searches of up to 32 words.

Words are compared unchanged. A null text has no words; texts of fewer than 20 words stay whole; rows that share a
doc_id are documents of their own, in the order of their texts. Kept words are joined by one space. A text of 2 ** 28
words or more raises an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import documents
from .tokens import content_keys, word_bounds, word_hashes
from .windows import merged, numbered, repeated, with_cuts

WIDTH = 20
GRAM = 4
GROUPED_ROWS = 20000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Bits:
    """A bit vector packed in 64-bit words with running counts."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.append(bits, np.zeros(64 + -len(bits) % 64, bool)), bitorder="little").view(np.uint64)
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32))).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        return self.counts[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletTree:
    """Rank over a sequence of small integers. A symbol of share p has a prefix code of ceil(-log2 p) bits; a level holds the next bits of all symbols whose codes go on, node by node."""

    def __init__(self, values: np.ndarray):
        counts = np.bincount(values)
        used = np.flatnonzero(counts)
        self.length = np.zeros(len(counts), np.int64)
        self.length[used] = np.maximum(1, np.ceil(np.log2(len(values) / counts[used]))).astype(np.int64)
        self.depth = int(self.length.max())
        by = used[np.argsort(self.length[used], kind="stable")]
        room = 1 << (self.depth - self.length[by])
        self.code = np.zeros(len(counts), np.int64)
        self.code[by] = np.cumsum(room) - room
        self.levels = []
        for level in range(self.depth):
            values = values[self.length[values] > level]
            node = self.code[values] >> (self.depth - level)
            order = np.argsort(node, kind="stable")
            values, node = values[order], node[order]
            bits = Bits((self.code[values] >> (self.depth - level - 1) & 1).astype(bool))
            start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            self.levels.append((bits, node[start], start, bits.rank(start)))

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often symbol occurs before lo and before hi."""
        lo, hi, live = lo.copy(), hi.copy(), np.arange(len(symbol))
        for level, (bits, nodes, start, ones) in enumerate(self.levels):
            live = live[self.length[symbol[live]] > level]
            code = self.code[symbol[live]]
            i = np.searchsorted(nodes, code >> (self.depth - level))
            one = (code >> (self.depth - level - 1) & 1).astype(bool)
            for at in (lo, hi):
                passed = bits.rank(start[i] + at[live]) - ones[i]
                at[live] = np.where(one, passed, at[live] - passed)
        return lo, hi


class FMIndex:
    """An index over sequences of symbols 1.. with 0 after each of them; rows are suffixes in the order of their first depth symbols."""

    def __init__(self, text: np.ndarray, width: int, depth: int = 32):
        n, rank, h = len(text), text.astype(np.int64), 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - h] = rank[h:] + 1
            key = rank * (int(ahead.max()) + 1) + ahead
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank[order], h = new, h * 2
            if h >= depth:
                break
        self.size = n
        self.tree = WaveletTree(text[order - 1])
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))
        # Where the first width symbols differ from those of the row before.
        first = np.zeros(n, bool)
        first[0] = True
        for k in range(width):
            x = text[np.minimum(order + k, n - 1)]
            first[1:] |= x[1:] != x[:-1]
        self.first = Bits(first)
        self.starts = np.append(np.flatnonzero(first), n).astype(np.int32)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with one more symbol to the left."""
        a, b = self.tree.rank(symbol, lo, hi)
        return self.before[symbol] + a, self.before[symbol] + b

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of the first width symbols of each match of that length or more, and its number."""
        number = self.first.rank(lo + 1) - 1
        return number, self.starts[number].astype(np.int64), self.starts[number + 1].astype(np.int64)


def matches(index: FMIndex, text: np.ndarray, starts: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """Streams sequences from their right ends: at each place of text the number of the interval of its first width symbols, -1 where the match is shorter."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), index.size)
    found = np.full(len(text), -1)
    length = np.zeros(len(starts), np.int64)
    last, live = starts + words - 1, np.arange(len(starts))
    for step in range(int(words.max())):
        live = live[words[live] > step]
        at = last[live] - step
        lo[live], hi[live] = index.extend(text[at], lo[live], hi[live])
        length[live] += 1
        long = live[length[live] >= width]
        if len(long):
            found[last[long] - step], lo[long], hi[long] = index.shorten(lo[long])
            length[long] = width
    return found


def solve(group: np.ndarray, begin: np.ndarray, offset: np.ndarray, windows: np.ndarray, contents: list[bytes], owners: pa.Table) -> np.ndarray:
    n = len(contents)
    table = owners.append_column("begin", pa.array(begin)).append_column("row", pa.array(np.arange(n)))
    in_order = pc.sort_indices(table, [("doc_id", "ascending"), ("part", "ascending"), ("begin", "ascending")], null_placement="at_start").to_numpy()
    # Equal stretches are one; the earliest stands for them.
    key = np.stack((group.astype(np.uint64), content_keys(contents)), 1)[in_order]
    _, first, of = np.unique(key, axis=0, return_index=True, return_inverse=True)
    of = of.ravel()
    heads = in_order[first]
    data = np.frombuffer(b" ".join(contents[i] for i in heads), np.uint8)
    size = np.array([len(contents[i]) for i in heads])
    bounds = np.concatenate((np.cumsum(size + 1) - size - 1, [len(data)]))
    b, e, first_word = word_bounds(data, bounds)
    words = np.diff(first_word)
    names = np.unique(word_hashes(data, b, e), return_inverse=True)[1] + 1
    starts = first_word[:-1] + np.arange(len(heads))
    text = np.zeros(len(names) + len(heads), np.int64)
    text[np.arange(len(names)) + np.repeat(np.arange(len(heads)), words)] = names
    number = matches(FMIndex(text, WIDTH), text, starts, words, WIDTH)
    # The order of all places in the corpus: documents by id, then words.
    doc_rank = np.empty(n, np.int64)
    ids = table.take(pa.array(in_order))
    prev, cur = ids.slice(0, n - 1).select([0, 1]), ids.slice(1).select([0, 1])
    differs = np.zeros(n, np.int64)
    for c in ("doc_id", "part"):
        x, y = prev[c].combine_chunks(), cur[c].combine_chunks()
        equal = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
        differs[1:] |= ~equal.to_numpy(zero_copy_only=False)
    doc_rank[in_order] = np.cumsum(differs)
    owner = np.repeat(np.arange(len(heads)), words + 1)
    inside = np.arange(len(text)) - starts[owner]
    place = doc_rank[heads][owner] << 36 | begin[heads][owner] + inside
    earliest = np.full(int(number.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    some = np.flatnonzero(number >= 0)
    np.minimum.at(earliest, number[some], place[some])
    # A row's window goes if the earliest place of its interval is not its own.
    rows = np.repeat(np.arange(n), windows)
    j = np.arange(len(rows)) - np.repeat(np.cumsum(windows) - windows, windows)
    head = np.empty(n, np.int64)
    head[in_order] = of
    own = doc_rank[rows] << 36 | begin[rows] + j
    return earliest[number[starts[head[rows]] + j]] != own


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, text, cuts) to the counts and hash of the kept words."""
    for batch in batches:
        ids, _, texts, cuts = batch.columns
        n_words, gone, left = [], [], []
        for text, runs in zip(texts, cuts):
            words, runs, at, kept = WORD.findall((text.as_py() or "").encode()), merged(runs.as_py()), 0, []
            for b, e in runs:
                kept += words[at:b]
                at = e
            kept += words[at:]
            n_words.append(len(words))
            gone.append(len(words) - len(kept))
            left.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of docs."""
    d = numbered(docs)
    id_type = d.schema["doc_id"].dataType.simpleString()
    return with_cuts(d, repeated(d, "words", WIDTH, GRAM, solve, GROUPED_ROWS, earlier=True)).mapInArrow(cut_texts, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_words(documents(spark, sf_dir))


ORACLE = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
v as (select doc_id, j, array_to_string(w[j:j + {WIDTH - 1}], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) as j from d where len(w) >= {WIDTH})),
f as (select doc_id, j from (select *, row_number() over (partition by run order by doc_id, j) as n from v) where n > 1),
p as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from d),
g as (select p.*, coalesce(j - max(f.j) over (partition by p.doc_id order by p.j) < {WIDTH}, false) as gone from p left join f using (doc_id, j)),
k as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by j) filter (not gone) as kept from g group by doc_id)
select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join k using (doc_id)
"""
