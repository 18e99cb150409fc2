"""Suffix-array dedup: the collection's transform and common prefixes built column by column.

Stretches of one anchor (see windows) are aligned at it, so equal windows begin in one column. Columns are taken from
right to left. Each round inserts one symbol per stretch: the order of all suffixes that begin in the column follows
from the order of the column after it by a stable partition on the new symbols (the collection's Burrows-Wheeler
step), and the common prefix with the predecessor is one more than the least one between two neighbours that got the
same symbol, else zero. Windows whose common prefix with either neighbour reaches ``width`` bytes are repeated.
Equal stretches of a group enter once, with their count. Shards read their stretches as one sorted sequential stream
and hold a bounded number of them plus the current anchor's group.

A null text is empty; texts shorter than the width keep all bytes; rows that share a doc_id are documents of their
own, told apart by their text's order; cuts count bytes and may split a character. A text of 2 ** 28 bytes or more
raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents
from .tokens import content_keys
from .windows import merged, numbered, repeated, with_cuts

WIDTH = 400
GRAM = 32
GROUPED_ROWS = 4000


def column_flags(group: np.ndarray, offset: np.ndarray, windows: np.ndarray, contents: list[bytes], width: int = WIDTH) -> np.ndarray:
    """For distinct contents aligned at their anchors: a row of window flags each, True where the window is also in another one."""
    n, right = len(contents), int(offset.max())
    shift = right - offset
    size = np.array([len(c) for c in contents])
    grid = np.zeros((int((shift + size).max()), n), np.uint16)
    # Some rows at a time, as the places of all bytes take many times their memory.
    for lo in range(0, n, GROUPED_ROWS):
        part, length = contents[lo : lo + GROUPED_ROWS], size[lo : lo + GROUPED_ROWS]
        data = np.frombuffer(b"".join(part), np.uint8).astype(np.uint16) + 1
        row = np.repeat(np.arange(len(part)), length)
        grid[np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length) + shift[lo + row], lo + row] = data
    order = np.argsort(group, kind="stable")
    common = np.zeros(n, np.int64)
    flags = np.zeros((n, int(windows.max())), bool)
    base = group.astype(np.int64) * 512
    for column in range(len(grid) - 1, -1, -1):
        symbol = grid[column][order]
        key = base[order] + symbol
        if (key[1:] >= key[:-1]).all():
            was = np.arange(n)
        else:
            was = np.argsort(key, kind="stable")
            order, key, symbol = order[was], key[was], symbol[was]
        same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] > 0)) + 1
        new = np.zeros(n, np.int64)
        lo, hi = was[same - 1] + 1, was[same]
        least = common[hi]
        if len(far := np.flatnonzero(lo < hi)):
            pairs = np.stack((lo[far], hi[far]), 1).ravel()
            least[far] = np.minimum(least[far], np.minimum.reduceat(common, pairs)[::2])
        new[same] = least + 1
        common = new
        if (long := common >= width).any():
            long[:-1] |= long[1:]
            who = order[long]
            begin = column - shift[who]
            inside = (begin >= 0) & (begin < windows[who])
            flags[who[inside], begin[inside]] = True
    return flags


def solve(group: np.ndarray, begin: np.ndarray, offset: np.ndarray, windows: np.ndarray, contents: list[bytes], owners: pa.Table) -> np.ndarray:
    key = np.stack((group.astype(np.uint64), content_keys(contents), offset.astype(np.uint64)), 1)
    _, first, of, count = np.unique(key, axis=0, return_index=True, return_inverse=True, return_counts=True)
    of = of.ravel()
    flags = np.zeros((len(first), int(windows.max())), bool)
    flags[count > 1] = True
    # Groups with one distinct content have nothing to compare.
    many = np.flatnonzero(np.bincount(group[first], minlength=int(group.max()) + 1)[group[first]] > 1)
    if len(many):
        rows = first[many]
        found = column_flags(group[rows], offset[rows], windows[rows], [contents[i] for i in rows])
        flags[many, : found.shape[1]] |= found
    return flags[of][np.arange(flags.shape[1]) < windows[:, None]]


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, text, cuts) to the counts and hash of what is left."""
    for batch in batches:
        ids, _, texts, cuts = batch.columns
        out = []
        for text, runs in zip(texts, cuts):
            data, runs, at, left = (text.as_py() or "").encode(), merged(runs.as_py()), 0, hashlib.sha256()
            for b, e in runs:
                left.update(data[at:b])
                at = e
            left.update(data[at:])
            out.append((len(data), sum(e - b for b, e in runs), len(runs), left.hexdigest()))
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs."""
    d = numbered(docs)
    id_type = d.schema["doc_id"].dataType.simpleString()
    return with_cuts(d, repeated(d, "bytes", WIDTH, GRAM, solve, GROUPED_ROWS, earlier=False)).mapInArrow(cut_texts, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir))


ORACLE = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
q as (select doc_id, p, length(h) // 2 - p - {WIDTH - 1} as more, substring(h, 2 * p + 1, 2 * {2048 + WIDTH}) as h from (select doc_id, h, unnest(range(0, length(h) // 2 - {WIDTH - 1}, 2048)) as p from d where length(h) // 2 >= {WIDTH})),
v as (select doc_id, p + j as j, md5(substring(h, 2 * j - 1, {2 * WIDTH})) as string from (select doc_id, p, h, unnest(range(1, least(more, 2048) + 1)) as j from q)),
f as (select doc_id, j from (select *, count(*) over (partition by string) as n from v) where n > 1),
s as (select *, case when j - lag(j) over (partition by doc_id order by j) <= {WIDTH} then 0 else 1 end as new from f),
r as (select doc_id, min(j) as b, max(j) + {WIDTH} as e from (select *, sum(new) over (partition by doc_id order by j) as run from s) group by doc_id, run),
c as (select doc_id, count(*) as n_spans, sum(e - b)::bigint as n_removed, list(b order by b) as bs, list(e order by b) as es from r group by doc_id),
k as (select d.doc_id, length(h) // 2 as n_bytes, n_removed, n_spans,
  case when n_spans is null then h else array_to_string(list_transform(list_zip(list_prepend(1, es), list_append(bs, length(h) // 2 + 1)), lambda x: substring(h, 2 * x[1] - 1, 2 * (x[2] - x[1]))), '') end as kept from d left join c using (doc_id))
select doc_id, n_bytes::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(kept)) as kept_sha256 from k
"""
