"""Ranked lexical search: an index of document shards with integer impacts, and exact top-k retrieval.

Terms are runs of letters, digits and all characters beyond ASCII, with A-Z lower-cased. An index is a Parquet table of
shards, each a bounded number of documents and bytes of text: its terms (64-bit hashes, sorted), where each term's
postings begin, and the postings, documents of the shard with an impact each (compressed sparse rows, as binary
columns). The impact of a term in a document is a whole number that holds all but the term's weight: it is computed
when the shard is written, from the term's frequency, the document's length and the collection's average length, which
one pass of counting gives before.

A search takes its queries in blocks of ``QUERIES`` items, the only thing that goes to all tasks. Document frequencies
of a block's terms are summed over the shards. Then each shard scores term at a time: a term's impacts times its weight
are added to a dense array of the shard's documents; ``argpartition`` finds the k-th score, and of all documents that
reach it the k best by (score, doc_id) stay, so ties are cut as the full sort would. A task merges its shards, and a
window over the tasks' results ranks the k best of all. No row depends on how documents are dealt to shards.

A document without terms (null, blank, or marks only) counts for nothing. Rows that repeat a doc_id are documents of
their own; a null doc_id comes after all others among equal scores. An item without terms, or whose terms occur
nowhere, has no rows. Equal items (item_id and text) are one; items that share only an id are ranked apart. An empty
table gives an empty index and result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, kept_path
from .tokens import CHUNK, LOWER, text_chunks, word_bounds, word_hashes

#: Bounds of a shard: documents (a document's number in it has 16 bits) and bytes of text; a longer text is a shard of its own.
SHARD_DOCS, SHARD_BYTES = 1 << 16, 8 << 20
#: Items of a block of queries.
QUERIES = 4096
TOP = 10
#: Bytes that no term holds.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
SHARD = "doc_ids binary, known binary, terms binary, begins binary, docs binary, impacts binary, all_docs long, all_terms long"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term and the text it belongs to."""
    low = LOWER[data]
    b, e, first = word_bounds(low, offsets, MARKS)
    return word_hashes(low, b, e), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column(0)):
            n = np.diff(word_bounds(data, offsets, MARKS)[2])
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])


def impact(tf: np.ndarray, length: np.ndarray, all_docs: int, all_terms: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * length * all_docs // all_terms))


def weight(df: int, all_docs: int) -> int:
    return math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df + 1)))


def shard_of(ids: pa.Array, terms: list[np.ndarray], texts: list[np.ndarray], all_docs: int, all_terms: int) -> pa.RecordBatch:
    """One shard's row. ids: of its documents; terms and texts: each occurrence's term and document."""
    term, doc = np.concatenate(terms), np.concatenate(texts)
    length = np.bincount(doc, minlength=len(ids))
    by = np.lexsort((doc, term))
    term, doc = term[by], doc[by]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(term)))
    term, doc = term[first], doc[first]
    head = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else first
    columns = [ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), term[head], np.append(head, len(term)).astype(np.int32), doc.astype(np.uint16), impact(tf, length[doc], all_docs, all_terms).astype(np.int32)]
    return pa.RecordBatch.from_arrays([*(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([all_docs]), pa.array([all_terms])], [x.split()[0] for x in SHARD.split(", ")])


def sharded(all_docs: int, all_terms: int, max_docs: int, max_bytes: int):
    """(doc_id, text) batches to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, texts, docs, size = [], [], [], 0, 0
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(1), min(CHUNK, max_bytes)):
                for lo in range(row, end, max_docs):
                    hi = min(end, lo + max_docs)
                    x, y = offsets[lo - row], offsets[hi - row]
                    if docs and (docs + hi - lo > max_docs or size + y - x > max_bytes):
                        yield shard_of(pa.concat_arrays(ids), terms, texts, all_docs, all_terms)
                        ids, terms, texts, docs, size = [], [], [], 0, 0
                    t, of = terms_of(data[x:y], offsets[lo - row : hi - row + 1] - x)
                    # Documents without terms are no documents of the index.
                    here, of = np.unique(of, return_inverse=True)
                    ids.append(batch.column(0).take(pa.array(here + lo)))
                    terms.append(t), texts.append(of + docs)
                    docs, size = docs + len(here), size + int(y - x)
        if docs:
            yield shard_of(pa.concat_arrays(ids), terms, texts, all_docs, all_terms)

    return run


def build_index(docs: DataFrame, path: str, max_docs: int = SHARD_DOCS, max_bytes: int = SHARD_BYTES) -> None:
    """Writes the index of docs (doc_id, text) to path."""
    if not 0 < max_docs <= SHARD_DOCS:
        raise ValueError(f"a shard has 1 to {SHARD_DOCS} documents")
    found = docs.select("text").mapInArrow(count_terms, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Small row groups, so that a task reads few shards at once.
    rows.mapInArrow(sharded(found[0] or 0, found[1] or 0, max_docs, max_bytes), SHARD).write.option("parquet.block.size", 4 * max_bytes).option("compression", "zstd").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def array(value: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def postings(vocabulary: np.ndarray, terms: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the postings of each word of a sorted vocabulary begin and end in a shard."""
    if not len(terms):
        return np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    here = terms[at] == vocabulary
    return np.where(here, begins[at], 0), np.where(here, begins[at + 1], 0)


def frequencies(vocabulary: np.ndarray):
    """(terms, begins) batches to how many documents hold each word of the vocabulary, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, begins in zip(*batch.columns):
                lo, hi = postings(vocabulary, array(terms, np.uint64), array(begins, np.int32))
                total += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["word", "df"])

    return run


def best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores above 0; of equal scores the smallest ids, unknown ones last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        found = scores[at]
        least = found[np.argpartition(found, len(found) - k)[len(found) - k]]
        # All that reach the k-th score, ties included, then the order among them.
        at = at[found >= least]
    return at[np.lexsort((ids[at], ~known[at], -scores[at]))[:k]]


def scored(items: list[tuple[np.ndarray, np.ndarray]], vocabulary: np.ndarray, k: int):
    """Shards to the task's k best documents of each item. items: words of the vocabulary with weights, times their number in the item."""
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(none, none, none.astype(bool))] * len(items)
        for batch in batches:
            for ids, known, terms, begins, docs, impacts in zip(*batch.columns):
                ids, known, docs, impacts = array(ids, np.int64), array(known, bool), array(docs, np.uint16), array(impacts, np.int32)
                lo, hi = (x.tolist() for x in postings(vocabulary, array(terms, np.uint64), array(begins, np.int32)))
                for i, (words, weights) in enumerate(items):
                    scores = np.zeros(len(ids), np.int64)
                    for w, by in zip(words.tolist(), weights.tolist()):
                        if lo[w] < hi[w]:
                            # A document is once among a term's postings.
                            scores[docs[lo[w] : hi[w]]] += impacts[lo[w] : hi[w]] * np.int64(by)
                    at = best(scores, ids, known, k)
                    if len(at):
                        s, d, n = (np.concatenate(x) for x in zip(held[i], (scores[at], ids[at], known[at])))
                        at = best(s, d, n, k)
                        held[i] = s[at], d[at], n[at]
        n = [len(x[0]) for x in held]
        s, d, valid = (np.concatenate([none, *x]) for x in zip(*held)) if held else (none, none, none)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n)), pa.array(d, mask=~valid.astype(bool)), pa.array(s)], ["item", "doc_id", "score"])

    return run


def query_terms(text: str | None) -> Counter:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Counter(terms_of(data, np.array([0, len(data)]))[0].tolist())


def search_block(index: DataFrame, items: list, k: int, id_type: str) -> DataFrame:
    """item_id, rank, doc_id, score for a bounded list of items (item_id, text)."""
    spark = index.sparkSession
    words = [query_terms(x.text) for x in items]
    vocabulary = np.unique(np.array([w for c in words for w in c], np.uint64))
    df = np.zeros(len(vocabulary), np.int64)
    found = index.select("terms", "begins").mapInArrow(frequencies(vocabulary), "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    df[found["word"].to_numpy()] = found["df"].to_numpy()
    size = index.select("all_docs").first()
    weights = np.array([weight(x, size[0]) if x else 0 for x in df.tolist()], np.int64)
    place = [(np.searchsorted(vocabulary, np.array(list(c), np.uint64)), np.array(list(c.values()), np.int64)) for c in words]
    rows = index.drop("all_docs", "all_terms").mapInArrow(scored([(at, n * weights[at]) for at, n in place], vocabulary, k), "item int, doc_id long, score long")
    names = spark.createDataFrame([(i, x.item_id) for i, x in enumerate(items)], f"item int, item_id {id_type}")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # A row for each item of the block.
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, queries: DataFrame, k: int = TOP, block: int = QUERIES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents for each of queries (item_id, text), equal scores by doc_id; only scores above 0."""
    id_type = queries.schema["item_id"].dataType.simpleString()
    items = queries.select("item_id", "text").distinct()
    n = items.count()
    out = index.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    if not n or index.isEmpty():
        return out
    # Blocks by hash: each comes to the driver alone and is bounded.
    blocks = -(-n // block)
    part = F.pmod(F.xxhash64(F.struct("item_id", "text")), F.lit(blocks))
    for b in range(blocks):
        some = items.filter(part == b) if blocks > 1 else items
        out = out.union(search_block(index, some.collect(), k, id_type))
    return out


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    path = kept_path(spark, "search-index")
    build_index(documents(spark, sf_dir), path)
    return search(load_index(spark, path), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
with d as (select row_number() over () as id, doc_id, {WORDS} as w from documents),
s as (select count(*) filter (len(w) > 0) as docs, sum(len(w))::bigint as terms from d),
o as (select id, doc_id, len(w) as n, unnest(w) as term from d),
t as (select id, any_value(doc_id) as doc_id, term, any_value(n) as n, count(*) as tf from o group by id, term),
f as (select term, count(*) as df from t group by term),
q as (select item_id, term, count(*) as times from (select item_id, unnest({WORDS}) as term from (select distinct item_id, text from benchmark)) group by item_id, term),
p as (select id, any_value(doc_id) as doc_id, item_id, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
  from q join f using (term) join t using (term) cross join s group by id, item_id),
r as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from p where score > 0)
select * from r where rank <= {TOP}
"""
