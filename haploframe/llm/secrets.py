"""Secret scans: patterns, and a character network that adds what looks like their findings.

Base findings are three patterns: assignments to a telling name, access keys, and long runs of hexadecimal digits; the
texts are searched for them as bytes in each task. Every other run of ``MIN_RUN`` characters or more of the value
alphabet is a candidate. A convolutional network over the characters of a candidate and of ``CONTEXT`` characters on
both sides scores each of them: one layer of filters over five characters, pooled over the left context, the value
(highest and mean) and the right context, then a dense layer. A value is read in full, however long.

The network is trained on labelled findings: base findings are positive, other candidates negative. It must know
secrets without their telling name, so each positive is also shown with name and quotes hidden, and with a value of as
many random characters of another alphabet. Windows are halved by their hashes, and each half is scored by a network
that was fitted on the other one: a secret that no pattern finds counts as negative there and would be learnt by heart.
A network sees at most ``SAMPLE`` distinct windows of findings and twice as many others (with digits or capitals, and
without), those with the smallest hashes.

Thresholds come from the scores of all candidates of all documents, counted by bins. A finding's scores there are those
of its window with name and quotes hidden, as it is and with values of each alphabet. For each shape of value
(hexadecimal, capitals and digits, mixed) the threshold is the highest bin at which at least ``RECALL`` of the findings
are kept, with fewer than ``ENOUGH`` findings that of all shapes together. Isotonic regression of the counts turns scores
into probabilities. A candidate at or above its threshold is added, unless it overlaps a base finding; base findings
always stay. Without findings or other candidates in both halves nothing is added.

A null or empty text has no findings; a null doc_id stays null; repeated rows give equal rows; an empty table gives an
empty result. Only doc_id and text are read, so other columns and their names play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, keep
from .tokens import LOWER, content_keys, mix, text_chunks, word_bounds

# The base patterns, in their order.
KINDS = ("assign", "access", "hex")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The kind of added findings.
MODEL = "model"
MIN_RUN = 12
CONTEXT = 16
SAMPLE = 2000
RECALL = 0.98
ENOUGH = 20
#: Of filters, their width, units of the dense layer, score bins.
FILTERS, WIDTH, UNITS, BINS = 24, 5, 24, 256
CODES = 130  # 0 between sequences, 1 to 128 for ASCII, 129 for other bytes
SHAPES = STRATA = 3
QUOTES = b"\"'"


def only(characters: str) -> np.ndarray:
    """The bytes that are none of some characters, as separators."""
    other = np.ones(256, bool)
    other[list(characters.encode())] = False
    return other


DIGITS, CAPITALS, SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_HEX, NOT_ACCESS, NOT_VALUE, PLAIN = only(DIGITS + "abcdef"), only(DIGITS + CAPITALS), only(DIGITS + CAPITALS + SMALL + "+/_.=-"), only(DIGITS + CAPITALS + "+/_=")
#: Alphabets that augmented values are drawn from.
ALPHABETS = [np.frombuffer(x.encode(), np.uint8) for x in (DIGITS + CAPITALS + SMALL + "+/", DIGITS + CAPITALS, DIGITS + CAPITALS + SMALL, DIGITS + "abcdef")]


def runs(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, begin and end of the runs of least bytes or more without separators."""
    b, e, first = word_bounds(data, offsets, separators)
    long = np.flatnonzero(e - b >= least)
    return np.searchsorted(first, long, "right") - 1, b[long], e[long]


def base_findings(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(text, begin, kind, end, value's begin) of the base findings of a chunk, by text, begin and kind; places are bytes of the chunk."""
    found = []
    low = LOWER[data].tobytes()
    held = set()
    for name in NAMES:
        at = low.find(name)
        while at >= 0:
            text = int(np.searchsorted(offsets, at, "right")) - 1
            held.add(text)
            # On to the next text: this one is searched as a whole.
            at = low.find(name, int(offsets[text + 1]))
    for text in held:
        x = int(offsets[text])
        found += [(text, x + m.start(), 0, x + m.end(), x + m.start(1)) for m in ASSIGN.finditer(data[x : int(offsets[text + 1])].tobytes()) if m.end() - m.start(1) >= LEAST["assign"]]
    for text, b, e in zip(*(x.tolist() for x in runs(data, offsets, NOT_ACCESS, LEAST["access"]))):
        at = data[b:e].tobytes().find(b"AKIA")
        if at >= 0 and e - b - at >= LEAST["access"]:
            found.append((text, b + at, 1, e, b + at))
    found += [(text, b, 2, e, b) for text, b, e in zip(*(x.tolist() for x in runs(data, offsets, NOT_HEX, LEAST["hex"])))]
    return np.array(sorted(found), np.int64).reshape(-1, 5)


def candidates(data: np.ndarray, offsets: np.ndarray, base: np.ndarray) -> np.ndarray:
    """(text, value's begin, end, begin with the name, 1 for a finding or 0): one for each value of a base finding, and the runs that overlap none."""
    text, b, e = runs(data, offsets, NOT_VALUE, MIN_RUN)
    free = np.ones(len(b), bool)
    for lo, hi in zip(base[:, 1].tolist(), base[:, 3].tolist()):
        free[np.searchsorted(e, lo, "right") : np.searchsorted(b, hi, "left")] = False
    own = base[:, [0, 4, 3, 1]]
    own = own[np.unique(own[:, 1], return_index=True)[1]] if len(own) else own
    rest = np.stack((text[free], b[free], e[free], b[free]), 1)
    return np.concatenate((np.pad(own, ((0, 0), (0, 1)), constant_values=1), np.pad(rest, ((0, 0), (0, 1)))))


def windows(data: bytes, offsets: np.ndarray, found: np.ndarray, hidden: bool) -> list[tuple[bytes, bytes, bytes]]:
    """(left context, value, right context) of candidates. hidden: contexts begin beyond a finding's name and quotes."""
    out = []
    for text, b, e, begin, _ in found.tolist():
        lo, hi = int(offsets[text]), int(offsets[text + 1])
        left, right = data[max(lo, (begin if hidden else b) - CONTEXT) : begin if hidden else b], data[e : min(hi, e + CONTEXT + 1)]
        if hidden:
            left, right = left.rstrip(QUOTES), right.lstrip(QUOTES)
        out.append((left[-CONTEXT:], data[b:e], right[:CONTEXT]))
    return out


def keys_of(found: list[tuple[bytes, bytes, bytes]]) -> np.ndarray:
    return content_keys([b"\0".join(w) for w in found])


def half_of(keys: np.ndarray) -> np.ndarray:
    """0 or 1 for each window."""
    return (mix(keys) & np.uint64(1)).astype(np.int64)


def shapes(values: list[bytes]) -> np.ndarray:
    """0 for hexadecimal values, 1 for capitals and digits, 2 for others."""
    data, size = np.frombuffer(b"".join(values), np.uint8), np.array([len(v) for v in values])
    if not len(values):
        return np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    other = lambda table: np.add.reduceat(table[data].astype(np.int64), first) > 0
    return np.where(~other(NOT_HEX), 0, np.where(~other(NOT_ACCESS), 1, 2))


def sequences(found: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of windows laid end to end with zeros between, and where each one's left context, value and right context begin."""
    sizes = np.array([[len(a) + 2, len(v), len(b) + 2] for a, v, b in found], np.int64)
    code = np.frombuffer(b"".join(b"\0\0" + a + v + b + b"\0\0" for a, v, b in found), np.uint8).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.ones(len(code), bool)
    for edge, step in ((ends - sizes.ravel())[0::3], 1), (ends[2::3] - 2, 1):
        text[edge] = text[edge + step] = False
    return np.where(text, np.where(code < 128, code + 1, 129), 0), ends - sizes.ravel()


def pooled(code: np.ndarray, first: np.ndarray, filters: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The layer's values, the highest of each part, and the mean of each value; filters: width x codes x filters."""
    half = WIDTH // 2
    wide = np.pad(code, half)
    h = np.broadcast_to(bias, (len(code), len(bias))).copy()
    for o in range(WIDTH):
        h += filters[o][wide[o : o + len(code)]]
    np.maximum(h, 0, out=h)
    sizes = np.diff(np.append(first, len(code)))[1::3]
    high = np.maximum.reduceat(h, first)
    mean = np.add.reduceat(h, first)[1::3] / sizes[:, None]
    return h, high, mean


class Network:
    """Filters over characters, pooling, a dense layer, a score; float32 numpy, trained by Adam on cross-entropy."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        wide = 4 * FILTERS + 1
        self.weights = [normal(WIDTH, CODES, FILTERS, scale=0.3), np.zeros(FILTERS, np.float32), normal(wide, UNITS, scale=wide**-0.5), np.zeros(UNITS, np.float32), normal(UNITS, scale=UNITS**-0.5), np.zeros(1, np.float32)]

    def features(self, code: np.ndarray, first: np.ndarray) -> tuple:
        h, high, mean = pooled(code, first, self.weights[0], self.weights[1])
        n = len(first) // 3
        length = np.log(np.diff(np.append(first, len(code)))[1::3])[:, None] / 4
        return h, high, np.concatenate((high.reshape(n, -1), mean, length), 1).astype(np.float32)

    def logits(self, found: list[tuple[bytes, bytes, bytes]], at_once: int = 2048) -> np.ndarray:
        """A score for each window; some at a time, or one long value."""
        out, lo = [np.zeros(0, np.float32)], 0
        ends = np.cumsum([len(v) + 40 for _, v, _ in found])
        while lo < len(found):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 64 * at_once, "right")))
            x = self.features(*sequences(found[lo:hi]))[2]
            _, _, w, b, v, c = self.weights
            out.append(np.maximum(x @ w + b, 0) @ v + c)
            lo = hi
        return np.concatenate(out)

    def gradients(self, found: list, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        code, first = sequences(found)
        h, high, x = self.features(code, first)
        _, _, w, b, v, c = self.weights
        z = np.maximum(x @ w + b, 0)
        d = ((1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y) * weight / weight.sum()).astype(np.float32)
        dz = d[:, None] * v * (z > 0)
        dx = dz @ w.T
        sizes = np.diff(np.append(first, len(code)))
        up = dx[:, : 3 * FILTERS].reshape(-1, FILTERS)
        hit = h == np.repeat(high, sizes, 0)
        share = np.add.reduceat(hit.astype(np.float32), first)
        dh = hit * np.repeat(up / share, sizes, 0)
        mean = np.zeros_like(up)
        mean[1::3] = dx[:, 3 * FILTERS : 4 * FILTERS] / sizes[1::3, None]
        dh = (dh + np.repeat(mean, sizes, 0)) * (h > 0)
        wide, columns = np.pad(code, WIDTH // 2), np.ascontiguousarray(dh.T)
        df = np.stack([np.stack([np.bincount(wide[o : o + len(code)], c, CODES) for c in columns], 1) for o in range(WIDTH)])
        return [df.astype(np.float32), dh.sum(0), x.T @ dz, dz.sum(0), z.T @ d, d.sum(keepdims=True)]

    def fit(self, found: list, y: np.ndarray, weight: np.ndarray, epochs: int = 12, size: int = 256, rate: float = 0.01, seed: int = 7) -> Network:
        r, step = np.random.default_rng(seed), 0
        m, s = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(found))
            for at in range(0, len(order), size):
                some, step = order[at : at + size], step + 1
                for i, g in enumerate(self.gradients([found[j] for j in some], y[some], weight[some])):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    self.weights[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        return self


def sampled(sample: int):
    """(text) batches to the task's windows with the smallest hashes. Strata of each half: findings, other candidates with digits or capitals, the rest; at most sample distinct ones each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[int, tuple]] = [{} for _ in range(2 * STRATA)]
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                found = candidates(data, offsets, base_findings(data, offsets))
                if not len(found):
                    continue
                whole = data.tobytes()
                bare, shown = windows(whole, offsets, found, True), windows(whole, offsets, found, False)
                keys = keys_of(bare)
                odd = np.array([len(v.translate(None, bytes(np.flatnonzero(~PLAIN)))) < len(v) for _, v, _ in bare])
                stratum = STRATA * half_of(keys) + np.where(found[:, 4] == 1, 0, np.where(odd, 1, 2))
                for i, (k, h) in enumerate(zip(stratum.tolist(), keys.tolist())):
                    held[k][h] = (*shown[i], *bare[i])
                for k in range(2 * STRATA):
                    if len(held[k]) > 4 * sample:
                        held[k] = {h: held[k][h] for h in sorted(held[k])[:sample]}
        rows = [(k, h - (1 << 63), *held[k][h]) for k in range(2 * STRATA) for h in sorted(held[k])[:sample]]
        names = ["stratum", "h", "left", "value", "right", "bare_left", "bare_value", "bare_right"]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names)

    return run


def other_value(value: bytes, key: int, alphabet: int) -> bytes:
    """As many characters, 20 at least, of an alphabet, drawn by a key."""
    return np.random.default_rng(key & ((1 << 63) - 1)).choice(ALPHABETS[alphabet], max(len(value), 20)).tobytes()


def fitted(positive: list[dict], negative: list[dict]) -> Network:
    found, y, weight = [], [], []

    def add(w: tuple[bytes, bytes, bytes], label: int, share: float) -> None:
        found.append(w), y.append(label), weight.append(share)

    for r in positive:
        bare = r["bare_left"], r["bare_value"], r["bare_right"]
        values = [bare[1], *(other_value(bare[1], r["h"] + salt, (r["h"] + 2 * salt) % len(ALPHABETS)) for salt in (0, 1))]
        for w in ((r["left"], r["value"], r["right"]), *((bare[0], v, bare[2]) for v in values)):
            add(w, 1, 1 / (4 * len(positive)))
    for r in negative:
        add((r["left"], r["value"], r["right"]), 0, 1 / len(negative))
    return Network().fit(found, np.array(y, np.float32), np.array(weight, np.float32))


def train(docs: DataFrame, sample: int = SAMPLE) -> list[Network] | None:
    """For each half of the windows a network fitted on a bounded sample of the other one; None if a half lacks findings or others."""
    schema = "stratum int, h long, left binary, value binary, right binary, bare_left binary, bare_value binary, bare_right binary"
    rows = keep(docs.select("text").mapInArrow(sampled(sample), schema), "windows")
    rows = rows.groupBy("stratum", "h").agg(*(F.min(c).alias(c) for c in schema.replace(",", "").split()[4::2]))
    parts = [rows.filter(F.col("stratum") == k).orderBy("h").limit(sample).toArrow().to_pylist() for k in range(2 * STRATA)]
    halves = [(parts[k], parts[k + 1] + parts[k + 2]) for k in (STRATA, 0)]
    return [fitted(*x) for x in halves] if all(p and n for p, n in halves) else None


FOUND = "array<struct<start:bigint,kind:int,end:bigint>>"
SCORED = "array<struct<start:bigint,end:bigint,shape:int,bin:int,finding:boolean>>"


def lists(counts: np.ndarray, columns: list, names: list[str]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.StructArray.from_arrays(columns, names))


def scores(data: np.ndarray, offsets: np.ndarray, base: np.ndarray, networks: list[Network]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of a chunk by text and begin, a finding once more for each alphabet, with shapes and bins."""
    found = candidates(data, offsets, base)
    bare = windows(data.tobytes(), offsets, found, True)
    keys = keys_of(bare)
    again = np.repeat(np.flatnonzero(found[:, 4] == 1), len(ALPHABETS))
    bare += [(bare[i][0], other_value(bare[i][1], int(keys[i]), k % len(ALPHABETS)), bare[i][2]) for k, i in enumerate(again.tolist())]
    half, found = np.concatenate((half_of(keys), half_of(keys)[again])), np.concatenate((found, found[again]))
    score = np.zeros(len(found), np.float32)
    for k, network in enumerate(networks):
        own = np.flatnonzero(half == k)
        score[own] = network.logits([bare[i] for i in own.tolist()])
    bins = np.clip(np.floor(score * 8) + BINS // 2, 0, BINS - 1).astype(np.int32)
    by = np.lexsort((found[:, 1], found[:, 0]))
    return found[by], shapes([v for _, v, _ in bare])[by].astype(np.int32), bins[by]


def scanned(networks):
    """(doc_id, text) batches to base findings and scored candidates of each row, places in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(1)):
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                start, n = points[offsets], end - row
                spot = lambda text, at: pa.array(points[at] - start[text])  # noqa: B023, E731
                base = base_findings(data, offsets)
                found, shape, bins = scores(data, offsets, base, networks.value) if networks.value else (np.zeros((0, 5), np.int64), *[np.zeros(0, np.int32)] * 2)
                a = lists(np.bincount(base[:, 0], minlength=n), [spot(base[:, 0], base[:, 1]), pa.array(base[:, 2].astype(np.int32)), spot(base[:, 0], base[:, 3])], ["start", "kind", "end"])
                b = lists(np.bincount(found[:, 0], minlength=n), [spot(found[:, 0], found[:, 1]), spot(found[:, 0], found[:, 2]), pa.array(shape), pa.array(bins), pa.array(found[:, 4] == 1)], ["start", "end", "shape", "bin", "finding"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), a, b], ["doc_id", "base", "candidates"])

    return run


def isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The nondecreasing shares closest to positive / total, bins without any taking their lower neighbour's."""
    blocks: list[list[float]] = []
    for p, n in zip(positive.tolist(), total.tolist()):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and (blocks[-1][1] == 0 or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    return np.repeat([p / n if n else 0.0 for p, n, _ in blocks], [k for _, _, k in blocks])


def thresholds(counts: np.ndarray, recall: float = RECALL, enough: int = ENOUGH) -> np.ndarray:
    """For each shape the lowest bin that is added. counts: shapes x bins x (others, findings); BINS adds nothing."""

    def of(found: np.ndarray) -> int:
        at_least = np.cumsum(found[::-1])[::-1]
        kept = np.flatnonzero(at_least >= recall * found.sum())
        return int(kept[-1]) if found.sum() else BINS

    everything = of(counts[:, :, 1].sum(0))
    return np.array([of(c[:, 1]) if c[:, 1].sum() >= enough else everything for c in counts])


def scan(docs: DataFrame, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """doc_id, base (start, kind's number, end, by start, then kind) and added (start, end, probability) of every row of docs."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    networks = docs.sparkSession.sparkContext.broadcast(train(rows, sample))
    scored = keep(rows.mapInArrow(scanned(networks), f"doc_id {id_type}, base {FOUND}, candidates {SCORED}"), "secrets")
    counts = np.zeros((SHAPES, BINS, 2), np.int64)
    # At most shapes x bins x 2 rows come to the driver.
    for r in scored.select(F.explode("candidates").alias("c")).groupBy("c.shape", "c.bin", "c.finding").count().collect():
        counts[r["shape"], r["bin"], int(r["finding"])] = r["count"]
    least = F.array(*(F.lit(int(x)) for x in thresholds(counts, recall)))
    chance = F.array(*(F.array(*(F.lit(float(p)) for p in isotonic(c[:, 1], c.sum(1)))) for c in counts))
    added = F.filter("candidates", lambda c: ~c["finding"] & (c["bin"] >= F.get(least, c["shape"])))
    return scored.select("doc_id", "base", F.transform(added, lambda c: F.struct(c["start"], c["end"], F.get(F.get(chance, c["shape"]), c["bin"]).alias("probability"))).alias("added"))


def op11_secrets(spark, sf_dir: str) -> DataFrame:
    d = scan(documents(spark, sf_dir))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*(F.lit(k) for k in (*KINDS, MODEL))), s["kind"]), s["start"], s["end"])), ",")
    added = F.transform("added", lambda a: F.struct(a["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), a["end"].alias("end")))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return d.select("doc_id", *(n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.array_sort(F.concat("base", added))).alias("spans"))
