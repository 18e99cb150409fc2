"""The hidden Markov model: emissions, transitions, forward, backward and posteriors.

Emissions and transitions are column expressions. A sample's markers are gathered into one row for each sequence (a
chromosome, or the whole panel) and window of it; targets as records (wide: a byte for each sample's genotype) are cut
into blocks of samples instead, so that a shuffled row holds a marker's model once for its block. An Arrow function runs
the recursion over markers for many samples at a time, vectorised over samples and states. A step costs the number of
states, not its square: all states but one are left by the same probability. Where only posteriors are asked for,
forward values are kept each square root of the markers and made again from there.

With windows of the model as implemented two passes go through each sample's windows, forwards and then backwards, and
carry the values of one marker from window to window. With windows of the documented model, whose steps are products of
matrices, windows are independent: each is first reduced to the product of its steps, a scan over a sample's windows
gives the values at their edges, and then all windows are worked on at the same time. No row or task holds a whole
sequence; results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, AccumulatorParam, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import AS_IMPLEMENTED, LOG_ZERO, MISSING, HMMParameters

LN10 = float(np.log(10.0))
#: Cells (markers x states) of all samples that are worked on at once.
CELLS = 1 << 19
#: Samples of a block of wide targets.
BLOCK = 32
ALL = ("alpha", "scale", "beta", "log_post")


def state_alleles(states: DataFrame, alleles: DataFrame) -> DataFrame:
    """marker_idx, state, hap0, hap1, a0, a1: the panel's alleles of each state, a missing one as 255."""
    one = lambda n: alleles.select("marker_idx", F.col("hap_idx").alias(f"hap{n}"), F.coalesce("allele", F.lit(MISSING)).alias(f"a{n}"))
    s = states.join(one(0), ["marker_idx", "hap0"], "left").join(one(1), ["marker_idx", "hap1"], "left")
    return s.select("marker_idx", "state", "hap0", "hap1", F.coalesce("a0", F.lit(MISSING)).alias("a0"), F.coalesce("a1", F.lit(MISSING)).alias("a1"))


def emissions(gl: DataFrame, states: DataFrame) -> DataFrame:
    """sample_idx, marker_idx, state, log_e: the likelihood of the state's genotype; anything beyond 0 or 1 ALT counts as 2."""
    g = F.col("a0") + F.col("a1")
    return gl.join(states, "marker_idx").select("sample_idx", "marker_idx", "state", F.when(g == 0, F.col("ll_00")).when(g == 1, F.col("ll_01")).otherwise(F.col("ll_11")).alias("log_e"))


def transitions(marks: DataFrame, p: HMMParameters) -> DataFrame:
    """marker_idx, rho, log_stay, log_switch (log10) from each marker to the next. marks: marker_idx, chrom, morgans."""
    ahead = marks.withColumn("next", F.lead("morgans").over(Window.partitionBy("chrom").orderBy("marker_idx"))).filter(F.col("next").isNotNull())
    gap = F.greatest(F.lit(0.0), F.col("next") - F.col("morgans"))
    rho = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.exp(gap * (-4.0 * p.ne * p.rho_rate))))
    share = F.col("rho") / (2.0 * p.ne)
    log = lambda x: F.when(x < 1e-300, F.lit(LOG_ZERO)).otherwise(F.log10(x))
    return ahead.withColumn("rho", rho).select("marker_idx", "rho", log(1 - F.col("rho") + share).alias("log_stay"), log(share).alias("log_switch"))


def log_sum(x: np.ndarray, axis: int, seed: float | None) -> np.ndarray:
    """ln of the sum of exponentials along an axis, over an extra term of value seed if there is one."""
    top = x.max(axis=axis, keepdims=True)
    if seed is not None:
        top = np.maximum(top, seed)
    total = np.exp(x - top).sum(axis=axis, keepdims=True) + (0.0 if seed is None else np.exp(seed - top))
    return (top + np.log(total)).squeeze(axis)


def gain(stay: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """ln of what staying has beyond a switch to the same state."""
    with np.errstate(divide="ignore"):
        return stay + np.log(-np.expm1(np.minimum(switch - stay, 0.0)))


def spread(x: np.ndarray, more: np.ndarray, switch: np.ndarray, seed: float | None) -> np.ndarray:
    """ln of the sum over states before, by exponentials of x and the step to each state. more: see gain. The step is the same in both directions."""
    out = np.logaddexp(log_sum(x, -1, None)[..., None] + switch[..., None], x + more[..., None])
    return out if seed is None else np.logaddexp(out, seed)


def forward(e: np.ndarray, stay: np.ndarray, switch: np.ndarray, seed: float | None, before: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward values and scales of emissions (rows x markers x states) in natural logs. stay, switch: rows x markers, the step after each marker. before: forward values, stay and switch of the marker before the first one."""
    alpha, scale, more = np.empty(e.shape), np.empty(e.shape[:-1]), gain(stay, switch)
    for i in range(e.shape[1]):
        if i:
            row = spread(alpha[:, i - 1], more[:, i - 1], switch[:, i - 1], seed) + e[:, i]
        else:
            row = e[:, 0] if before is None else spread(before[0], gain(before[1], before[2]), before[2], seed) + e[:, 0]
        scale[:, i] = row.max(-1)
        alpha[:, i] = row - scale[:, i, None]
    return alpha, scale


def backward(e: np.ndarray, stay: np.ndarray, switch: np.ndarray, seed: float | None, after: np.ndarray | None = None) -> np.ndarray:
    """Backward values; after: emission plus backward value of the marker after the last one."""
    beta, more = np.zeros(e.shape), gain(stay, switch)
    m = e.shape[1]
    for i in range(m - 1, -1, -1):
        ahead = e[:, i + 1] + beta[:, i + 1] if i < m - 1 else after
        if ahead is not None:
            beta[:, i] = spread(ahead, more[:, i], switch[:, i], seed)
    return beta


def forward_backward(e: np.ndarray, stay: np.ndarray, switch: np.ndarray, seed: float | None, before: tuple | None = None, after: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Scaled forward values, scales, backward values and log posteriors."""
    alpha, scale = forward(e, stay, switch, seed, before)
    beta = backward(e, stay, switch, seed, after)
    return {"alpha": alpha, "scale": scale, "beta": beta, "log_post": normalized(alpha + beta, seed)}


def checkpointed(e: np.ndarray, stay: np.ndarray, switch: np.ndarray, seed: float | None, before: tuple | None = None, after: np.ndarray | None = None, interval: int = 0) -> np.ndarray:
    """Log posteriors alone. Forward values are kept before every interval-th marker (0: the square root of their number) and made again block by block from the end."""
    m = e.shape[1]
    interval = interval or max(1, int(np.ceil(np.sqrt(m))))
    starts, known = list(range(0, m, interval)), [before]
    for at in starts[:-1]:
        some = slice(at, at + interval)
        alpha, _ = forward(e[:, some], stay[:, some], switch[:, some], seed, known[-1])
        last = at + interval - 1
        known.append((alpha[:, -1], stay[:, last], switch[:, last]))
    post = np.empty(e.shape)
    for at, begin in zip(reversed(starts), reversed(known)):
        some = slice(at, at + interval)
        alpha, _ = forward(e[:, some], stay[:, some], switch[:, some], seed, begin)
        beta = backward(e[:, some], stay[:, some], switch[:, some], seed, after)
        post[:, some] = normalized(alpha + beta, seed)
        after = e[:, at] + beta[:, 0]
    return post


def normalized(post: np.ndarray, seed: float | None) -> np.ndarray:
    return post - log_sum(post, -1, seed)[..., None]


def transfer(e: np.ndarray, stay: np.ndarray, switch: np.ndarray, first: bool) -> np.ndarray:
    """rows x states x states: the log product of a window's steps, from the forward values of the marker before it to those of its last one. first: no marker is before, and all rows of a matrix are the forward values. The step to a window's first marker is the caller's."""
    n, m, k = e.shape
    x = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None] + np.zeros((n, 1, 1)) if not first else np.zeros((n, k, k))
    more = gain(stay, switch)
    x = x + e[:, 0, None, :]
    for i in range(1, m):
        x = spread(x, more[:, i - 1, None], switch[:, i - 1, None], None) + e[:, i, None, :]
    return x


CELL = ("m", "ll_00", "ll_01", "ll_11", "g", "log_stay", "log_switch")
TYPES = {"m": "int", "ll_00": "double", "ll_01": "double", "ll_11": "double", "g": "string", "log_stay": "double", "log_switch": "double", "calls": "binary"}
COLUMNS = {"alpha": "array<double>", "scale": "double", "beta": "array<double>", "log_post": "array<double>"}
#: log10 likelihoods of 0, 1 and 2 for each byte of wide targets, whose halves are a call's two alleles.
CALLS = np.zeros((256, 3))
CALLS[[0x00, 0x01, 0x10, 0x11]] = np.where(np.eye(3, dtype=bool), 0.0, LOG_ZERO)[[0, 1, 1, 2]]


@dataclass
class Run:
    """Some samples' emissions (samples x markers x states) and steps (samples x markers), in natural logs. rows: the batch's row of each sample, place: its place in that row."""

    rows: np.ndarray
    place: np.ndarray
    samples: np.ndarray
    markers: np.ndarray
    e: np.ndarray
    stay: np.ndarray
    switch: np.ndarray


def characters(text: pa.Array, n: int) -> np.ndarray:
    """The bytes of texts of one length, as rows."""
    raw = text.cast(pa.large_binary())
    begin = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset]
    k = len(text[0].as_py()) if n else 0
    return np.frombuffer(raw.buffers()[2], np.uint8)[begin : begin + n * k].reshape(n, k) if n else np.zeros((0, 0), np.uint8)


def runs_of(samples: np.ndarray, cells: pa.ListArray, mode: str) -> Iterator[Run]:
    """Runs of rows (first sample, cells), a bounded number of cells at once. Cells are those of one sample, or with calls those of a block of samples. As implemented, logs of both bases are summed as they are."""
    unit = 1.0 if mode == AS_IMPLEMENTED else LN10
    flat, ends = cells.flatten(), cells.offsets.to_numpy().astype(np.int64)
    if not len(flat):
        return
    ends = ends - ends[0]
    field = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
    g = characters(field["g"], len(flat)) - 48
    number = lambda c: field[c].to_numpy(zero_copy_only=False)
    m, stay, switch = number("m"), number("log_stay") * unit, number("log_switch") * unit
    k = g.shape[1]
    if "calls" in field:
        for r, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            calls = characters(field["calls"].slice(x, y - x), y - x)
            for at in range(0, calls.shape[1], step := max(1, CELLS // max(1, (y - x) * k))):
                some = calls[:, at : at + step].T
                n = len(some)
                wide = lambda v: np.broadcast_to(v[x:y], (n, y - x))  # noqa: B023, E731
                # Of the 3 kinds of genotypes each state shows one.
                e = (CALLS * unit)[some[:, :, None], g[None, x:y]]
                yield Run(np.full(n, r), np.arange(at, at + n), samples[r] + np.arange(at, at + n), wide(m), e, wide(stay), wide(switch))
        return
    likely = np.stack([number(c) for c in CELL[1:4]], -1) * unit
    size = np.diff(ends)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for at in range(0, len(rows), step := max(1, CELLS // max(1, int(n) * k))):
            some = rows[at : at + step]
            take = ends[some][:, None] + np.arange(n)
            yield Run(some, np.zeros(len(some), np.int64), samples[some], m[take], np.take_along_axis(likely[take], g[take].astype(np.int64), -1), stay[take], switch[take])


def packed(run: Run, wanted: tuple[str, ...], seed: float | None, before: tuple | None = None, after: np.ndarray | None = None) -> pa.RecordBatch:
    n, k = run.markers.size, run.e.shape[-1]
    args = run.e, run.stay, run.switch, seed, before, after
    found = {"log_post": checkpointed(*args)} if wanted == ("log_post",) else forward_backward(*args)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(x.ravel()))
    columns = [pa.array(found[c].ravel()) if c == "scale" else lists(found[c]) for c in wanted]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(run.samples, run.markers.shape[1]), pa.int32()), pa.array(run.markers.ravel(), pa.int32()), *columns], ["sample_idx", "marker_idx", *wanted])


def at_once(mode: str, wanted: tuple[str, ...]) -> Callable:
    """(sample_idx, cells) rows to posteriors."""
    seed = LOG_ZERO if mode == AS_IMPLEMENTED else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in runs_of(batch.column(0).to_numpy(), batch.column(1), mode):
                yield packed(r, wanted, seed)

    return run


class Finished(AccumulatorParam):
    """Cells by partition; a partition that runs again counts once."""

    def zero(self, value: dict[int, int]) -> dict[int, int]:
        return {}

    def addInPlace(self, value1: dict[int, int], value2: dict[int, int]) -> dict[int, int]:
        return value1 | value2


def watched(run: Callable, done: Accumulator | None) -> Callable:
    """run, which tells done the cells of each partition that it has finished."""
    if done is None:
        return run

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = 0
        for batch in run(batches):
            cells += len(batch)
            yield batch
        done.add({TaskContext.get().partitionId(): cells})

    return counted


def windows_of(batch: pa.RecordBatch, mode: str) -> Iterator[tuple[str, int, list[Run]]]:
    """(sequence, first row, runs) for each window of a batch of (seq, window, sample_idx, cells, …) rows, windows in a row."""
    seqs, windows, samples = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
    cuts = [0, *(i for i in range(1, len(batch)) if (seqs[i], windows[i]) != (seqs[i - 1], windows[i - 1])), len(batch)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if lo < hi:
            yield seqs[lo], lo, runs_of(samples[lo:hi], batch.column(3).slice(lo, hi - lo), mode)


def forward_pass(mode: str) -> Callable:
    """(seq, window, sample_idx, cells) rows in that order to the same with before, the forward values, stay and switch of the marker before the window for each sample of the row, null in a first window."""
    seed = LOG_ZERO if mode == AS_IMPLEMENTED else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            before: list[list[np.ndarray]] = [[] for _ in range(len(batch))]
            for seq, lo, runs in windows_of(batch, mode):
                # Only the last window of a sequence is held.
                for x in [x for x in held if x[0] != seq]:
                    del held[x]
                for r in runs:
                    last = [held.get((seq, s)) for s in r.samples.tolist()]
                    known = None
                    if last[0] is not None:
                        x = np.stack(last)
                        known = x[:, :-2], x[:, -2], x[:, -1]
                        for row, v in zip(r.rows.tolist(), last):
                            before[lo + row].append(v)
                    alpha, _ = forward(r.e, r.stay, r.switch, seed, known)
                    for j, s in enumerate(r.samples.tolist()):
                        held[seq, s] = np.concatenate((alpha[j, -1], r.stay[j, -1:], r.switch[j, -1:]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([np.concatenate(x) if x else None for x in before], pa.list_(pa.float64()))], [*batch.schema.names, "before"])

    return run


def of_rows(values: pa.Array, run: Run, lo: int, width: int) -> np.ndarray | None:
    """Each sample's numbers from its row's list; None if its rows have none."""
    if not values[lo + int(run.rows[0])].is_valid:
        return None
    rows = {r: np.array(values[lo + r].as_py()).reshape(-1, width) for r in set(run.rows.tolist())}
    return np.stack([rows[r][p] for r, p in zip(run.rows.tolist(), run.place.tolist())])


def backward_pass(mode: str, wanted: tuple[str, ...]) -> Callable:
    """What forward_pass gave, by seq and falling window, to posteriors."""
    seed = LOG_ZERO if mode == AS_IMPLEMENTED else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for seq, lo, runs in windows_of(batch, mode):
                for x in [x for x in held if x[0] != seq]:
                    del held[x]
                for r in runs:
                    after = [held.get((seq, s)) for s in r.samples.tolist()]
                    x = of_rows(batch.column(4), r, lo, r.e.shape[-1] + 2)
                    known = None if x is None else (x[:, :-2], x[:, -2], x[:, -1])
                    after = None if after[0] is None else np.stack(after)
                    beta = backward(r.e, r.stay, r.switch, seed, after)
                    for j, s in enumerate(r.samples.tolist()):
                        held[seq, s] = r.e[j, 0] + beta[j, 0]
                    yield packed(r, wanted, seed, known, after)

    return run


def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, window, sample_idx, cells) rows to (seq, window, sample_idx, product), the window's log product of steps for each sample of the row, with the step that follows it."""
    for batch in batches:
        found: list[list[np.ndarray]] = [[] for _ in range(len(batch))]
        windows = batch.column(1).to_pylist()
        for _, lo, runs in windows_of(batch, "documented"):
            for r in runs:
                x = transfer(r.e, r.stay, r.switch, windows[lo] == 0)
                for j, row in enumerate(r.rows.tolist()):
                    found[lo + row].append(np.concatenate((x[j].ravel(), r.stay[j, -1:], r.switch[j, -1:])))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([np.concatenate(x) for x in found], pa.list_(pa.float64()))], ["seq", "window", "sample_idx", "product"])


def edges(k: int) -> Callable:
    """(seq, sample_idx, windows: list of window and product) rows to (seq, window, sample_idx, before, after): each window's forward values, stay and switch before it and the emission plus backward value after it."""

    def of(products: list[np.ndarray]) -> tuple[list, list]:
        before, after = [None], [None]
        alpha = products[0][:, 0, :k]
        # Forwards: through the step between windows, then through the window.
        for x, y in zip(products[:-1], products[1:]):
            alpha = alpha - alpha.max(-1, keepdims=True)
            stay, switch = x[:, k, 0], x[:, k, 1]
            before.append(np.concatenate((alpha, stay[:, None], switch[:, None]), 1))
            alpha = log_sum(spread(alpha, gain(stay, switch), switch, None)[:, :, None] + y[:, :k, :k], 1, None)
        beta = np.zeros_like(alpha)
        for x, y in zip(products[-2::-1], products[:0:-1]):
            ahead = log_sum(y[:, :k, :k] + beta[:, None, :], 2, None)
            after.append(ahead)
            beta = spread(ahead, gain(x[:, k, 0], x[:, k, 1]), x[:, k, 1], None)
        return before, after[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, sample, windows in zip(*(c.to_pylist() for c in batch.columns)):
                products = []
                for w in windows:
                    x = np.array(w["product"]).reshape(-1, k * k + 2)
                    wide = np.zeros((len(x), k + 1, max(k, 2)))
                    wide[:, :k, :k], wide[:, k, :2] = x[:, : k * k].reshape(-1, k, k), x[:, k * k :]
                    products.append(wide)
                before, after = of(products)
                flat = lambda xs: pa.array([None if x is None else x.ravel() for x in xs], pa.list_(pa.float64()))
                n = len(windows)
                yield pa.RecordBatch.from_arrays([pa.array([seq] * n), pa.array([w["window"] for w in windows], pa.int32()), pa.array([sample] * n, pa.int32()), flat(before), flat(after)], ["seq", "window", "sample_idx", "before", "after"])

    return run


def inside(wanted: tuple[str, ...]) -> Callable:
    """(seq, window, sample_idx, cells, before, after) rows to posteriors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lo, runs in windows_of(batch, "documented"):
                for r in runs:
                    k = r.e.shape[-1]
                    x = of_rows(batch.column(4), r, lo, k + 2)
                    yield packed(r, wanted, None, None if x is None else (x[:, :-2], x[:, -2], x[:, -1]), of_rows(batch.column(5), r, lo, k))

    return run


def steps(marks: DataFrame, p: HMMParameters, mode: str = AS_IMPLEMENTED) -> DataFrame:
    """marker_idx, seq, log_stay, log_switch: the step from each marker to the next of its sequence. As implemented, all markers are one sequence, whatever their chromosome, and its first step serves for all; documented, each chromosome is one and has its own steps. marks: marker_idx, chrom, morgans."""
    m = marks if mode != AS_IMPLEMENTED else marks.withColumn("chrom", F.lit(""))
    t = transitions(m, p)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    if mode != AS_IMPLEMENTED:
        return m.join(t, "marker_idx", "left").select("marker_idx", F.col("chrom").alias("seq"), *(zero(c) for c in ("log_stay", "log_switch")))
    first = t.agg(F.min_by(F.struct("log_stay", "log_switch"), "marker_idx").alias("t")).select(F.lit("").alias("chrom"), "t.*")
    return m.join(first, "chrom").select("marker_idx", F.col("chrom").alias("seq"), *(zero(c) for c in ("log_stay", "log_switch")))


def complete(gl: DataFrame, marks: DataFrame) -> DataFrame:
    """Likelihoods of every sample at every marker; where there were none all genotypes are equally likely."""
    grid = gl.select("sample_idx").distinct().join(marks.select("marker_idx"), F.lit(True))
    return grid.join(gl, ["sample_idx", "marker_idx"], "left").select("sample_idx", "marker_idx", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ll_00", "ll_01", "ll_11")))


def posteriors(gl: DataFrame, states: DataFrame, marks: DataFrame, p: HMMParameters, mode: str = AS_IMPLEMENTED, window: int = 0, wanted: tuple[str, ...] = ALL, block: int = BLOCK, done: Accumulator | None = None) -> DataFrame:
    """sample_idx, marker_idx and what is wanted of: by state, alpha, beta and log_post (natural logs), and the marker's scale.

    gl has a row for each sample and marker (see complete), or is wide: marker_idx and calls, a byte for each sample (see
    vcf.wide_targets), which are cut into blocks of samples. window: markers handled at once, 0 for whole sequences.
    done: an accumulator of Finished that hears of each finished partition.
    """
    kind = F.least(F.col("a0") + F.col("a1"), F.lit(2)).cast("string")
    g = states.groupBy("marker_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("state", kind.alias("g")))), lambda x: x["g"]), "").alias("g"))
    part = F.lit(0) if not window else F.floor(F.col("marker_idx") / window).cast("int")
    model = steps(marks, p, mode).join(g, "marker_idx").withColumn("window", part)
    if window and mode != AS_IMPLEMENTED:
        # Windows are counted within their sequence, so that each one's first is 0.
        first = model.groupBy("seq").agg(F.min("window").alias("first"))
        model = model.join(F.broadcast(first), "seq").withColumn("window", F.col("window") - F.col("first")).drop("first")
    if "calls" in gl.columns:
        starts = F.sequence(F.lit(0), F.greatest(F.octet_length("calls") - 1, F.lit(0)), F.lit(block))
        cut = gl.join(model, "marker_idx").select("seq", "window", "marker_idx", "g", "log_stay", "log_switch", "calls", F.explode(starts).alias("sample_idx")).filter(F.octet_length("calls") > 0)
        fields = ["m", "calls", "g", "log_stay", "log_switch"]
        cell = F.struct(F.col("marker_idx").cast("int").alias("m"), F.expr(f"substring(calls, sample_idx + 1, {block})").alias("calls"), "g", "log_stay", "log_switch")
    else:
        cut = gl.join(model, "marker_idx").withColumn("sample_idx", F.col("sample_idx").cast("int"))
        fields = list(CELL)
        cell = F.struct(F.col("marker_idx").cast("int").alias("m"), *(F.col(c).cast("double").alias(c) for c in CELL[1:4]), "g", "log_stay", "log_switch")
    # A stated number of partitions: the rows are small, but each is much work, so adaptive execution must not join them.
    n = int(gl.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Keys that are one value for all rows would be taken out of the grouping, and the rows dealt again.
    cut = cut.repartition(n, *(["seq"] if mode != AS_IMPLEMENTED else []), *(["window"] if window else []), "sample_idx")
    rows = cut.groupBy("seq", "window", "sample_idx").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    out = "sample_idx int, marker_idx int" + "".join(f", {c} {COLUMNS[c]}" for c in wanted)
    if not window:
        return rows.select("sample_idx", "cells").mapInArrow(watched(at_once(mode, wanted), done), out)
    cells = "array<struct<" + ",".join(f"{c}:{TYPES[c]}" for c in fields) + ">>"
    if mode == AS_IMPLEMENTED:
        gone = rows.repartition(n, "sample_idx").sortWithinPartitions("seq", "window", "sample_idx").mapInArrow(forward_pass(mode), f"seq string, window int, sample_idx int, cells {cells}, before array<double>")
        return gone.repartition(n, "sample_idx").sortWithinPartitions("seq", F.desc("window"), "sample_idx").mapInArrow(watched(backward_pass(mode, wanted), done), out)
    products = rows.mapInArrow(reduced, "seq string, window int, sample_idx int, product array<double>")
    each = products.groupBy("seq", "sample_idx").agg(F.array_sort(F.collect_list(F.struct("window", "product"))).alias("windows"))
    known = each.mapInArrow(edges(p.num_states), "seq string, window int, sample_idx int, before array<double>, after array<double>")
    both = rows.join(known, ["seq", "window", "sample_idx"]).select("seq", "window", "sample_idx", "cells", "before", "after")
    return both.mapInArrow(watched(inside(wanted), done), out)


def unrolled(post: DataFrame) -> DataFrame:
    """sample_idx, marker_idx, state, alpha, scale, beta, log_post."""
    each = F.posexplode(F.arrays_zip("alpha", "beta", "log_post")).alias("state", "x")
    return post.select("sample_idx", "marker_idx", "scale", each).select("sample_idx", "marker_idx", "state", F.col("x.alpha").alias("alpha"), "scale", F.col("x.beta").alias("beta"), F.col("x.log_post").alias("log_post"))


def forward_fold(em: DataFrame, stay: float, switch: float) -> DataFrame:
    """sample_idx and alphas, the scaled forward rows, by a fold inside the JVM with one transition for all steps: for short marker lists."""
    rows = em.groupBy("sample_idx", "marker_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "log_e"))), lambda x: x["log_e"].cast("double")).alias("e"))
    rows = rows.groupBy("sample_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("marker_idx", "e"))), lambda x: x["e"]).alias("es"))
    less = lambda x: F.transform(x, lambda v: v - F.array_max(x))
    lse = lambda xs: F.log(F.aggregate(xs, F.exp(F.lit(LOG_ZERO) - F.greatest(F.lit(LOG_ZERO), F.array_max(xs))), lambda a, v: a + F.exp(v - F.greatest(F.lit(LOG_ZERO), F.array_max(xs))))) + F.greatest(F.lit(LOG_ZERO), F.array_max(xs))
    step = lambda last, e: F.transform(e, lambda v, j: lse(F.transform(last, lambda a, i: a + F.when(i == j, stay).otherwise(switch))) + v)
    first = F.array(less(F.get("es", F.lit(0))))
    fold = F.aggregate(F.slice("es", 2, F.greatest(F.size("es") - 1, F.lit(0))), first, lambda acc, e: F.concat(acc, F.transform(F.array(step(F.element_at(acc, -1), e)), less)))
    return rows.select("sample_idx", fold.alias("alphas"))
