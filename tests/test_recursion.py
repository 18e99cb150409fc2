"""The recursion's linear steps, checkpoints, blocks of samples and independent windows against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploframe.config import AS_IMPLEMENTED, DOCUMENTED, HMMParameters, ImputationConfig
from haploframe.operators import hmm, pbwt
from haploframe.plans.impute import Imputer
from haploframe.sources import vcf


def values(seed, n=3, m=37, k=5, far=False):
    r = np.random.default_rng(seed)
    e = np.log(r.random((n, m, k))) * (300 if far else 1)
    rho = r.random((n, m)) * (1e-3 if far else 1)
    return e, np.log(1 - rho + rho / 50), np.log(rho / 50)


def plain(e, stay, switch, seed):
    """Whole matrices, one sample at a time."""
    n, m, k = e.shape
    add = lambda x: np.logaddexp.reduce(x) if seed is None else np.logaddexp(seed, np.logaddexp.reduce(x))
    out = []
    for s in range(n):
        t = [np.where(np.eye(k, dtype=bool), stay[s, i], switch[s, i]) for i in range(m)]
        alpha, beta = np.zeros((m, k)), np.zeros((m, k))
        for i in range(m):
            row = e[s, i] + ([add(alpha[i - 1] + t[i - 1][:, j]) for j in range(k)] if i else 0)
            alpha[i] = row - row.max()
        for i in range(m - 2, -1, -1):
            beta[i] = [add(t[i][j] + e[s, i + 1] + beta[i + 1]) for j in range(k)]
        out.append((alpha, beta, np.array([x - add(x) for x in alpha + beta])))
    return [np.stack(x) for x in zip(*out)]


@pytest.mark.parametrize("seed", [None, -999.0])
@pytest.mark.parametrize("far", [False, True])
def test_steps_are_those_of_whole_matrices(seed, far):
    e, stay, switch = values(1, far=far)
    stay[0, 3] = switch[0, 3] = -1.0
    switch[1, 5], stay[1, 5] = -999.0, 0.0
    alpha, beta, post = plain(e, stay, switch, seed)
    got = hmm.forward_backward(e, stay, switch, seed)
    assert np.allclose(got["alpha"], alpha, atol=1e-8) and np.allclose(got["beta"], beta, atol=1e-7) and np.allclose(got["log_post"], post, atol=1e-7)
    for interval in (0, 1, 4, 37, 100):
        assert np.allclose(hmm.checkpointed(e, stay, switch, seed, interval=interval), post, atol=1e-7)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_products_of_windows(k):
    e, stay, switch = values(2, k=k)
    cuts = [0, 1, 9, 30, 37]
    products = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        x = hmm.transfer(e[:, lo:hi], stay[:, lo:hi], switch[:, lo:hi], lo == 0)
        products.append(np.concatenate((x.reshape(len(x), -1), stay[:, hi - 1 : hi], switch[:, hi - 1 : hi]), 1))
    import pyarrow as pa

    windows = [{"window": i, "product": p.ravel().tolist()} for i, p in enumerate(products)]
    batch = pa.RecordBatch.from_arrays([pa.array(["c"]), pa.array([0], pa.int32()), pa.array([windows])], ["seq", "sample_idx", "windows"])
    rows = next(hmm.edges(k)(iter([batch]))).to_pylist()
    alpha, beta, _ = plain(e, stay, switch, None)
    for r, lo, hi in zip(rows, cuts[:-1], cuts[1:]):
        assert (r["before"] is None) == (lo == 0) and (r["after"] is None) == (hi == 37)
        if lo:
            assert np.allclose(np.array(r["before"]).reshape(3, k + 2)[:, :k], alpha[:, lo - 1], atol=1e-8)
        if hi < 37:
            assert np.allclose(np.array(r["after"]).reshape(3, k), e[:, hi] + beta[:, hi], atol=1e-7)


@pytest.fixture(scope="module")
def panel(spark):
    """Two chromosomes, 12 haplotypes, 41 markers, 7 targets."""
    r = np.random.default_rng(5)
    marks = spark.createDataFrame([(m, "a" if m < 23 else "b", 5000 * (m % 23 + 1) + m, 0.0) for m in range(41)], "marker_idx int, chrom string, pos long, cm double")
    alleles = spark.createDataFrame([(m, h, int(r.integers(2))) for m in range(41) for h in range(12)], "marker_idx int, hap_idx int, allele int")
    calls = [[r.choice(["0/0", "0|1", "1/0", "1/1", "./.", "0/2", "1", "./1"]) for _ in range(7)] for _ in range(41)]
    rows = spark.createDataFrame([(m, c) for m, c in enumerate(calls)], "marker_idx int, fields array<string>")
    return alleles, marks, rows


@pytest.mark.parametrize("mode", [AS_IMPLEMENTED, DOCUMENTED])
@pytest.mark.parametrize("window", [0, 6])
def test_blocks_of_samples_and_windows_change_nothing(spark, panel, mode, window):
    alleles, marks, rows = panel
    p = HMMParameters(num_states=4)
    im = Imputer(alleles, marks, ImputationConfig(p, mode=mode, selector="first")).build_index()
    states = im.states().cache()
    get = lambda df: {(r.sample_idx, r.marker_idx): r for r in df.collect()}
    want = get(hmm.posteriors(vcf.target_likelihoods(rows), states, im.marks(), p, mode))
    for targets in (vcf.target_likelihoods(rows), vcf.wide_targets(rows)):
        got = get(hmm.posteriors(targets, states, im.marks(), p, mode, window, block=3))
        assert got.keys() == want.keys() and len(got) == 41 * 7
        for k, r in got.items():
            assert np.allclose(r.log_post, want[k].log_post, atol=1e-7) and np.allclose(r.alpha, want[k].alpha, atol=1e-7) and np.allclose(r.beta, want[k].beta, atol=1e-6)
        alone = hmm.posteriors(targets, states, im.marks(), p, mode, window, ("log_post",))
        assert alone.columns == ["sample_idx", "marker_idx", "log_post"]
        assert all(np.allclose(r.log_post, want[k].log_post, atol=1e-7) for k, r in get(alone).items())


def test_windows_of_a_sample_are_in_different_tasks(spark, panel):
    alleles, marks, rows = panel
    p = HMMParameters(num_states=4)
    im = Imputer(alleles, marks, ImputationConfig(p, mode=DOCUMENTED, selector="first")).build_index()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = hmm.posteriors(vcf.wide_targets(rows), im.states(), im.marks(), p, DOCUMENTED, 6).withColumn("task", F.spark_partition_id())
        assert df.filter("sample_idx = 0").select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_wide_targets(spark):
    rows = spark.createDataFrame([(0, ["0/0", "0|1", "1/1"]), (1, ["./.", "1/.", "2|1"]), (2, ["0/1:7", "1", "10/1"]), (3, [])], "marker_idx int, fields array<string>")
    got = {r.marker_idx: r.calls.hex().upper() for r in vcf.wide_targets(rows).collect()}
    assert got == {0: "000111", 1: "FF1F21", 2: "01FFF1", 3: ""}
