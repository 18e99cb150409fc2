"""Unit tests on a ten-marker panel whose values were derived by hand from the formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploframe.config import AS_IMPLEMENTED, DOCUMENTED, HMMParameters, ImputationConfig, ImputationError
from haploframe.functions import logspace
from haploframe.functions.genotypes import call_genotype, pack_alleles, parse_gt, unpack_alleles
from haploframe.functions.logspace import logsumexp
from haploframe.operators import calls, hmm, pbwt
from haploframe.plans.impute import Imputer, impute
from haploframe.sources import vcf

PANEL = ["00 01 10 11", "00 00 11 11", "11 10 01 00", "01 10 01 10", "11 11 00 00", "00 10 01 11", "01 00 11 10", "10 01 10 01", "11 00 11 00", "00 11 00 11"]
TARGETS = ["0/1 1/1", "./. 1/1", "0/1 0/0", "0/1 ./.", "1/1 0/0", "./. 1/1", "0/0 1/0", "0/1 0/1", "./. 0/0", "1/1 1/1"]
ORDERS = ["01253467", "01235467", "34670125", "34706125", "47653012", "43017652", "30724165", "21653074", "26371504", "15042637"]
STARTS = [[1, 0, 0, 0, 1, 0, 0, 0], [2, 0, 0, 1, 2, 1, 0, 0], [3, 2, 0, 0, 3, 0, 0, 2]]


def text(rows, names, sep):
    head = ["##fileformat=VCFv4.2", "##contig=<ID=chr1,length=100000>", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    body = ["\t".join(["chr1", str(1000 * (i + 1)), f"rs{i + 1}", "A", "G", "100", "PASS", ".", "GT", *(x if "/" in x else f"{x[0]}{sep}{x[1]}" for x in r.split())]) for i, r in enumerate(rows)]
    return "\n".join(head + body) + "\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("vcf")
    (d / "panel.vcf").write_text(text(PANEL, ["R1", "R2", "R3", "R4"], "|"))
    (d / "target.vcf").write_text(text(TARGETS, ["T1", "T2"], "/"))
    return str(d / "panel.vcf"), str(d / "target.vcf")


@pytest.fixture(scope="module")
def panel(spark, files):
    r = vcf.records(spark, files[0])
    return vcf.panel_alleles(r).cache(), vcf.markers(r).cache()


def test_reading(spark, files, panel):
    h = vcf.read_header(spark, files[0])
    assert h.sample_names == ["R1", "R2", "R3", "R4"] and h.contigs == ["chr1"]
    r = vcf.records(spark, files[0])
    assert r.count() == 10 and vcf.region(r, "chr1:3000-7000").count() == 5 and vcf.region(r, "chr2").count() == 0
    assert panel[0].count() == 80 and panel[0].agg(F.max("hap_idx")).first()[0] == 7
    with pytest.raises(ImputationError):
        vcf.region(r, "a:b")


def test_short_records(spark, tmp_path):
    p = tmp_path / "x.vcf"
    p.write_text("#CHROM\nchr1\t1\n" + "\t".join(["chr1", "5", ".", "A", "C,T", ".", ".", ".", "GT", "1", "0|2|1:9"]) + "\r\n")
    r = vcf.records(spark, str(p), strict=False).first()
    assert r.qual == 0.0 and r.alt == ["C", "T"] and r.fields == ["1", "0|2|1:9"]
    with pytest.raises(Exception):
        vcf.records(spark, str(p)).collect()
    a = {(x.hap_idx): x.allele for x in vcf.panel_alleles(vcf.records(spark, str(p), strict=False)).collect()}
    assert a == {0: 1, 1: 1, 2: 0, 3: 2}


def test_genotypes(spark):
    d = spark.createDataFrame([("0|1:3",), ("./.",), ("1",), (".",), ("1/1",), ("2|0",)], "x string")
    assert [r.g for r in d.select(call_genotype(parse_gt(F.col("x"))).alias("g")).collect()] == [1, None, None, None, 2, None]


def test_orders(spark, panel):
    o = {(r.marker_idx, r["rank"]): r.hap_idx for r in pbwt.prefix_order(panel[0]).collect()}
    assert ["".join(str(o[m, k]) for k in range(8)) for m in range(10)] == ORDERS
    d = {(r.marker_idx, r["rank"]): r.divergence for r in pbwt.divergence(panel[0], DOCUMENTED).collect()}
    assert [[d[m, k] for k in range(8)] for m in range(3)] == STARTS
    wide = spark.createDataFrame([("chr1", m, bytearray(int(x) for x in r.replace(" ", ""))) for m, r in enumerate(PANEL)], "chrom string, marker_idx int, alleles binary")
    for block in (512, 4, 1):
        rows = pbwt.fold_order(wide, block).collect()
        assert len(rows) == 10
        for r in rows:
            assert "".join(map(str, r.order)) == ORDERS[r.marker_idx] and r.divergence == [d[r.marker_idx, k] for k in range(8)]
    assert all(r.is_permutation for r in pbwt.validate(pbwt.prefix_order(panel[0])).collect())


# Posterior argmax states and probabilities at markers 0 and 9 of both targets; transitions are equal at all markers.
GOLDEN = {("simple", AS_IMPLEMENTED): ([1] * 10, [3] * 10, [0, 0.9067, 0.0933, 0]), ("first", AS_IMPLEMENTED): ([3] * 7 + [2] * 3, [0] * 10, [0, 0, 0.3493, 0.4288]), ("first", DOCUMENTED): ([3] * 6 + [2] * 4, [0] * 10, [0, 0, 0.0006, 0.9994])}


@pytest.mark.parametrize(("rule", "mode"), list(GOLDEN))
def test_posteriors(spark, files, panel, rule, mode):
    config = ImputationConfig(HMMParameters(num_states=4, use_pbwt_selection=rule == "first"), mode=mode, selector="first", deterministic=True)
    im = Imputer(*panel, config).build_index()
    gl = vcf.target_likelihoods(vcf.records(spark, files[1]))
    states = im.states()
    post = hmm.posteriors(gl, states, im.marks(), config.hmm, mode).cache()
    best = {(r.sample_idx, r.marker_idx): r.state for r in calls.argmax_calls(post, states).collect()}
    rows = hmm.unrolled(post)
    assert [best[0, m] for m in range(10)] == GOLDEN[rule, mode][0] and [best[1, m] for m in range(10)] == GOLDEN[rule, mode][1]
    p = [np.exp(r.log_post) for r in rows.filter("sample_idx = 0 and marker_idx = 0").orderBy("state").collect()]
    assert np.allclose(p, GOLDEN[rule, mode][2], atol=6e-5)
    t = im.transitions().first()
    assert abs(t.log_stay + 0.694785) < 1e-6 and abs(t.log_switch + 4.398971) < 1e-6
    if mode == AS_IMPLEMENTED:
        fold = hmm.forward_fold(hmm.emissions(gl, states), t.log_stay, t.log_switch)
        a = {(r.sample_idx, r.marker_idx, r.state): r.alpha for r in rows.collect()}
        for r in fold.collect():
            assert all(abs(x - a[r.sample_idx, m, k]) < 1e-9 for m, row in enumerate(r.alphas) for k, x in enumerate(row))


def test_uniform_forward_backward():
    e, t = np.full((1, 5, 2), np.log(0.5)), np.full((1, 5), np.log(0.5))
    out = hmm.forward_backward(e, t, t, None)["log_post"]
    assert np.allclose(np.exp(out), 0.5)


def test_documented_posteriors_sum_to_one(spark, files, panel):
    im = Imputer(*panel, ImputationConfig(HMMParameters(num_states=4), mode=DOCUMENTED, selector="first")).build_index()
    post = hmm.posteriors(vcf.target_likelihoods(vcf.records(spark, files[1])), im.states(), im.marks(), im.config.hmm, DOCUMENTED)
    assert "alpha" not in im.posteriors(vcf.target_likelihoods(vcf.records(spark, files[1])), im.states()).columns
    post = hmm.unrolled(post)
    assert all(abs(r.s - 1) < 1e-9 for r in post.groupBy("sample_idx", "marker_idx").agg(F.sum(F.exp("log_post")).alias("s")).collect())


def test_likelihood_slice(spark, files, panel, tmp_path):
    """Calls by likelihood, their INFO scores and the written file."""
    c = calls.likelihood_calls(vcf.target_likelihoods(vcf.records(spark, files[1])))
    rows = {r.marker_idx: r.line for r in vcf.phased_rows(c, panel[1]).collect()}
    want = ["0|1 1|1", "1|1 1|1", "0|1 0|0", "0|1 1|1", "1|1 0|0", "1|1 1|1", "0|0 0|1", "0|1 0|1", "1|1 0|0", "1|1 1|1"]
    assert [rows[m].split("\t")[9:] for m in range(10)] == [w.split() for w in want]
    assert rows[0].split("\t")[:9] == ["chr1", "1000", "rs1", "A", "G", ".", "PASS", "IMP", "GT"]
    info = {r.marker_idx: r.info for r in calls.info_scores(calls.dosages(c)).collect()}
    assert np.allclose([info[m] for m in range(10)], [1 / 3, 1, 1 / 3, 1 / 3, 0, 1, 1 / 3, 1, 0, 1])


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_end_to_end(spark, files, tmp_path, compression):
    out = str(tmp_path / "out")
    r = impute(spark, *files, out, ImputationConfig(HMMParameters(num_states=4), deterministic=True), compression)
    lines = [x.value for x in spark.read.text(out).collect()]
    assert lines[0] == "##fileformat=VCFv4.2" and len(lines) == 9 + 10
    back = vcf.records(spark, out)
    assert back.count() == 10 and r.imputed.count() == 20 and r.info.count() == 10


def test_sampling_does_not_depend_on_batches(spark, files, panel, tmp_path):
    im = Imputer(*panel, ImputationConfig(HMMParameters(num_states=4))).build_index()
    gl = vcf.target_likelihoods(vcf.records(spark, files[1]))
    seen = []
    parts = im.impute_with_progress(gl, lambda a, b: seen.append((a, b)), str(tmp_path / "p"), 1)
    assert seen == [(1, 2), (2, 2)] and sorted(parts.collect()) == sorted(im.impute(gl).imputed.collect())


def test_progress_of_one_query(spark, files, panel, tmp_path, monkeypatch):
    """Counts grow while the query runs; samples are rows or bytes of wide targets; rates come with the result."""
    from haploframe.plans import impute as plan

    im = Imputer(*panel, ImputationConfig(HMMParameters(num_states=4), deterministic=True)).build_index()
    rows = vcf.target_likelihoods(vcf.records(spark, files[1]))
    many = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("sample_idx", (F.col("sample_idx") + 2 * F.col("k")).cast("int")).drop("k")
    seen, counts = [], []
    accumulators = []
    monkeypatch.setattr(plan, "POLL", 0.01)
    monkeypatch.setattr(plan.hmm, "watched", lambda run, done, real=plan.hmm.watched: (accumulators.append(done), real(run, done))[1])

    def told(a, b):
        seen.append((a, b))
        counts.append(sum(accumulators[0].value.values()))

    r = im.run(many, str(tmp_path / "many"), told, 7)
    assert seen == [(min(7 * i, 60), 60) for i in range(1, 10)]
    # No call came before its samples' cells were counted, and each partition counted once.
    assert all(c >= 10 * a for c, (a, _) in zip(counts, seen)) and counts[-1] == 600
    assert set(r.rates) == {"samples", "markers", "cells"} and all(v > 0 for v in r.rates.values())
    assert r.imputed.count() == 600 and r.info.count() == 10
    want = im.impute(rows).imputed.drop("state").collect()
    assert sorted((x.sample_idx % 2, *x[1:]) for x in r.imputed.filter("sample_idx >= 58").drop("state").collect()) == sorted(tuple(x) for x in want)
    wide = im.run(vcf.target_rows(spark, files[1]).select("marker_idx", "calls"), str(tmp_path / "wide"), step=1)
    assert sorted(wide.imputed.drop("state").collect()) == sorted(want)


def test_progress_that_fails_stops_the_query(spark, files, panel, tmp_path):
    im = Imputer(*panel, ImputationConfig(HMMParameters(num_states=4))).build_index()
    gl = vcf.target_likelihoods(vcf.records(spark, files[1]))

    def refuse(a, b):
        raise KeyError(a)

    with pytest.raises(KeyError):
        im.run(gl, str(tmp_path / "p"), refuse, 1)
    (tmp_path / "taken").mkdir()
    with pytest.raises(Exception, match="(?i)already exists"):
        im.run(gl, str(tmp_path / "taken"))


def test_finished_partitions_count_once():
    f = hmm.Finished()
    assert f.zero({1: 2}) == {} and f.addInPlace(f.addInPlace({0: 5}, {1: 7}), {0: 5}) == {0: 5, 1: 7}


def test_command_line_tells_progress(spark, files, tmp_path, capsys):
    from haploframe.__main__ import main

    out = str(tmp_path / "out.vcf.gz")
    assert main(["-r", files[0], "-t", files[1], "-o", out, "-s", "4", "--deterministic", "--progress", "--batch-size", "1", "--benchmark"]) == 0
    said = capsys.readouterr().out
    assert "1/2 samples, 50.0 %" in said and "2/2 samples, 100.0 %" in said and "samples/s" in said and "markers/s" in said
    assert vcf.records(spark, out).count() == 10


def test_checks(spark, files, panel):
    im = Imputer(*panel)
    gl = vcf.target_likelihoods(vcf.records(spark, files[1]))
    with pytest.raises(ImputationError):
        im.check(gl, panel[1].filter("marker_idx < 5"))
    with pytest.raises(ImputationError):
        ImputationConfig(mode="x")
    strict = Imputer(*panel, ImputationConfig(strict_markers=True))
    rows = strict.check(gl, panel[1].filter("marker_idx < 5")).collect()
    assert len(rows) == 20 and all(r.ll_00 == r.ll_01 == r.ll_11 == 0 for r in rows if r.marker_idx >= 5)


def test_log_sums_and_packing(spark, panel):
    d = spark.createDataFrame([(0.5, 0.5), (0.3, 0.7), (0.1, 0.9)], "a double, b double")
    assert all(abs(r.x) < 1e-12 for r in d.select(logsumexp(F.log("a"), F.log("b")).alias("x")).collect())
    back = unpack_alleles(pack_alleles(panel[0], ["marker_idx"]), ["marker_idx"])
    assert back.join(panel[0], ["marker_idx", "hap_idx", "allele"]).count() == 80


def test_log_sums_of_far_values(spark):
    """Values of many sizes, one row, missing values; the rows are read once."""
    r = np.random.default_rng(3)
    rows = [(int(k), float(x)) for k, x in zip(r.integers(0, 7, 300), r.normal(0, 900, 300))] + [(8, -5000.0), (9, None), (10, 3.0), (10, None), (11, -256.0), (11, 0.0), (11, 256.0)]
    df = spark.createDataFrame(rows, "k int, x double")
    got = {x.k: x.lse for x in logspace.logsumexp_by(df, ["k"], "x", "lse").collect()}
    for k in {k for k, _ in rows}:
        own = [x for j, x in rows if j == k and x is not None]
        assert got[k] is None if not own else abs(got[k] - np.logaddexp.reduce(own)) < 1e-9
    assert logspace.logsumexp_by(df, ["k"], "x", "lse")._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_samples_are_placed(spark):
    df = spark.range(50).select((F.col("id") % 23).cast("int").alias("sample_idx"))
    got = calls.placed(df, 4, 23).withColumn("at", F.spark_partition_id()).collect()
    assert len(got) == 50 and all(r.part == r.at == r.sample_idx // 6 for r in got)


def test_stream(spark, files, panel, tmp_path):
    from haploframe.streaming.folder import impute_stream

    im = Imputer(*panel, ImputationConfig(HMMParameters(num_states=4), deterministic=True)).build_index()
    gl = vcf.target_likelihoods(vcf.records(spark, files[1])).select("sample_idx", F.col("marker_idx"), "ll_00", "ll_01", "ll_11")
    gl.write.parquet(str(tmp_path / "in"))
    impute_stream(spark, im, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def lines_of(chrom, first, rows, names, sep):
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])
    body = ["\t".join([chrom[i] if isinstance(chrom, list) else chrom, str(1000 * (first + i)), f"rs{first + i}", "A", "G", ".", "PASS", ".", "GT", *(x if "/" in x else f"{x[0]}{sep}{x[1]}" for x in r.split())]) for i, r in enumerate(rows)]
    return "\n".join([head, *body]) + "\n"


def test_region_of_unequal_files(spark, tmp_path):
    """The panel has two markers before the targets' first one; inside the region both have the same five."""
    (tmp_path / "p.vcf").write_text(lines_of("chr1", 1, PANEL, ["R1", "R2", "R3", "R4"], "|"))
    (tmp_path / "t.vcf").write_text(lines_of("chr1", 3, TARGETS[2:], ["T1", "T2"], "/"))
    (tmp_path / "p5.vcf").write_text(lines_of("chr1", 3, PANEL[2:7], ["R1", "R2", "R3", "R4"], "|"))
    (tmp_path / "t5.vcf").write_text(lines_of("chr1", 3, TARGETS[2:7], ["T1", "T2"], "/"))
    config = dict(hmm=HMMParameters(num_states=4), deterministic=True)
    some = impute(spark, str(tmp_path / "p.vcf"), str(tmp_path / "t.vcf"), config=ImputationConfig(**config, region="chr1:3000-7000"))
    want = impute(spark, str(tmp_path / "p5.vcf"), str(tmp_path / "t5.vcf"), config=ImputationConfig(**config))
    assert some.imputed.count() == 10 and sorted(some.imputed.collect()) == sorted(want.imputed.collect())
    assert [r.pos for r in some.markers.orderBy("marker_idx").collect()] == [3000, 4000, 5000, 6000, 7000]
    with pytest.raises(ImputationError):
        impute(spark, str(tmp_path / "p.vcf"), str(tmp_path / "t.vcf"))


@pytest.mark.parametrize("mode", [AS_IMPLEMENTED, DOCUMENTED])
def test_two_chromosomes(spark, tmp_path, mode):
    """Documented, each chromosome is as if it were alone; as implemented, both are one sequence."""
    names = ["chr1"] * 6 + ["chr2"] * 4
    (tmp_path / "p.vcf").write_text(lines_of(names, 1, PANEL, ["R1", "R2", "R3", "R4"], "|"))
    (tmp_path / "t.vcf").write_text(lines_of(names, 1, TARGETS, ["T1", "T2"], "/"))
    config = ImputationConfig(HMMParameters(num_states=4), mode=mode, selector="first", deterministic=True)
    both = {(r.sample_idx, r.marker_idx): r.state for r in impute(spark, str(tmp_path / "p.vcf"), str(tmp_path / "t.vcf"), config=config).imputed.collect()}
    assert len(both) == 20
    if mode == AS_IMPLEMENTED:
        assert [both[0, m] for m in range(10)] == GOLDEN["first", AS_IMPLEMENTED][0]
        return
    for chrom, first, n in (("chr1", 0, 6), ("chr2", 6, 4)):
        one = impute(spark, str(tmp_path / "p.vcf"), str(tmp_path / "t.vcf"), config=ImputationConfig(HMMParameters(num_states=4), mode=mode, selector="first", deterministic=True, region=chrom)).imputed.collect()
        assert {(r.sample_idx, r.marker_idx + first): r.state for r in one} == {k: v for k, v in both.items() if first <= k[1] < first + n}


@pytest.mark.parametrize("mode", [AS_IMPLEMENTED, DOCUMENTED])
@pytest.mark.parametrize("window", [1, 4])
def test_windows_change_nothing(spark, files, panel, mode, window):
    gl = vcf.target_likelihoods(vcf.records(spark, files[1]))
    p = HMMParameters(num_states=4)
    im = Imputer(*panel, ImputationConfig(p, mode=mode, selector="first")).build_index()
    states, get = im.states(), lambda w: {(r.sample_idx, r.marker_idx): r for r in hmm.posteriors(gl, states, im.marks(), p, mode, w).collect()}
    whole, parts = get(0), get(window)
    assert whole.keys() == parts.keys() and len(whole) == 20
    for k, r in whole.items():
        assert np.allclose(r.alpha, parts[k].alpha) and np.allclose(r.beta, parts[k].beta) and np.allclose(r.log_post, parts[k].log_post) and abs(r.scale - parts[k].scale) < 1e-9


def test_one_sample_and_one_haplotype(spark, files, panel, tmp_path):
    gl = vcf.target_likelihoods(vcf.records(spark, files[1])).filter("sample_idx = 0")
    im = Imputer(*panel, ImputationConfig(HMMParameters(num_states=4))).build_index()
    seen = []
    assert im.impute_with_progress(gl, lambda a, b: seen.append((a, b)), str(tmp_path / "p")).count() == 10 and seen == [(1, 1)]
    assert im.impute_with_progress(gl.limit(0), lambda a, b: seen.append((a, b)), str(tmp_path / "e")).count() == 0 and len(seen) == 1
    alone = Imputer(panel[0].filter("hap_idx = 0"), panel[1], ImputationConfig(HMMParameters(num_states=2))).build_index()
    assert alone.haplotypes == 1 and alone.impute(gl).imputed.count() == 10
    with pytest.raises(ImputationError):
        Imputer(panel[0].limit(0), panel[1]).haplotypes


def test_index_is_kept(spark, panel, tmp_path):
    im = Imputer(*panel, ImputationConfig(HMMParameters(num_states=4), selector="first")).build_index()
    im.save_index(str(tmp_path / "i"))
    back = Imputer(*panel, im.config).load_index(str(tmp_path / "i"))
    assert back.has_index and sorted(back.states().collect()) == sorted(im.states().collect())


def test_many_splits_are_numbered_in_order(spark, tmp_path):
    """Records of a folder of files and of many splits keep their order."""
    rows = [PANEL[i % 10] for i in range(3000)]
    d = tmp_path / "d"
    d.mkdir()
    for k in range(3):
        (d / f"part-{k}.vcf").write_text(lines_of("chr1", 1 + 1000 * k, rows[1000 * k : 1000 * (k + 1)], ["R1", "R2", "R3", "R4"], "|"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = vcf.records(spark, str(d)).select("marker_idx", "pos").orderBy("marker_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.marker_idx, r.pos) for r in got] == [(i, 1000 * (i + 1)) for i in range(3000)]


def test_wide_panel_holds_all_alleles(spark, tmp_path):
    p = tmp_path / "x.vcf"
    p.write_text("#CHROM\n" + "\t".join(["chr1", "5", ".", "A", "C,T", ".", ".", ".", "GT", "1", "0|2|1:9", ".|1", "12/3:7", "."]) + "\n")
    assert list(vcf.wide_panel(vcf.records(spark, str(p))).first().alleles) == [1, 1, 0, 2, 255, 1, 12, 3, 255, 255]


def bcf_bytes(rows, names):
    """A BCF2 file of diploid calls, with an integer field before GT and names and counts in their long forms."""
    import gzip
    import struct

    word = lambda t: (bytes([len(t) << 4 | 7]) if len(t) < 15 else bytes([0xF7, 0x11, len(t)])) + t.encode()
    head = "\n".join(["##fileformat=VCFv4.2", "##FILTER=<ID=q10,Description=\"x\">", "##contig=<ID=chr9>", "##contig=<ID=chr1,length=100000>", "##FORMAT=<ID=DP,Number=1,Type=Integer,Description=\"d\">", "##FORMAT=<ID=GT,Number=1,Type=String,Description=\"g\">", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]) + "\n\0"
    out = b"BCF\2\2" + struct.pack("<I", len(head)) + head.encode()
    for i, r in enumerate(rows):
        cells = r.split()
        own = b"\x11\x02" + b"\x12" + b"".join(struct.pack("<h", 300 + k) for k in range(len(cells)))
        own += b"\x11\x03" + b"\x21"
        for x in cells:
            sep, vals = (1, x.split("|")) if "|" in x else (0, x.split("/"))
            codes = [0 if v == "." else (int(v) + 1) << 1 | (sep if k else 0) for k, v in enumerate(vals)]
            own += struct.pack("<bb", *(codes + [-127])[:2])
        shared = struct.pack("<iiiIII", 1, 1000 * (i + 1) - 1, 1, 0x7F800001 if i else 0x42C80000, 3 << 16, 2 << 24 | len(cells))
        shared += word(f"rs{i + 1}" if i else "a name of more than fifteen") + word("A") + word("G") + word("T") + b"\x11\x00"
        out += struct.pack("<II", len(shared), len(own)) + shared + own
    half = len(out) // 2
    return gzip.compress(out[:half]) + gzip.compress(out[half:])


def test_bcf(spark, tmp_path):
    """The same records as from text; haploid and missing calls; a region; imputation from BCF files."""
    rows = [r if "/" in r else " ".join(f"{x[0]}|{x[1]}" for x in r.split()) for r in PANEL]
    (tmp_path / "p.bcf").write_bytes(bcf_bytes(rows, ["R1", "R2", "R3", "R4"]))
    (tmp_path / "t.bcf").write_bytes(bcf_bytes(TARGETS, ["T1", "T2"]))
    (tmp_path / "x.bcf").write_bytes(bcf_bytes(["1 ./1"], ["A", "B"]))
    h = vcf.read_header(spark, str(tmp_path / "p.bcf"))
    assert h.sample_names == ["R1", "R2", "R3", "R4"] and h.contigs == ["chr9", "chr1"]
    got = vcf.records(spark, str(tmp_path / "p.bcf")).orderBy("marker_idx").collect()
    assert [(r.marker_idx, r.chrom, r.pos, r.ref, r.alt, r.fields) for r in got] == [(i, "chr1", 1000 * (i + 1), "A", ["G", "T"], x.split()) for i, x in enumerate(rows)]
    assert got[0].qual == 100.0 and got[1].qual == 0.0 and got[0].id == "a name of more than fifteen" and got[1].id == "rs2"
    assert [r.pos for r in vcf.records(spark, str(tmp_path / "p.bcf"), where="chr1:3000-5000").orderBy("marker_idx").collect()] == [3000, 4000, 5000]
    assert vcf.records(spark, str(tmp_path / "x.bcf")).first().fields == ["1", "./1"]
    config = ImputationConfig(HMMParameters(num_states=4), selector="first", deterministic=True)
    r = impute(spark, str(tmp_path / "p.bcf"), str(tmp_path / "t.bcf"), config=config)
    assert [x.state for x in r.imputed.filter("sample_idx = 0").orderBy("marker_idx").collect()] == GOLDEN["first", AS_IMPLEMENTED][0]


def test_concordance_of_constant_markers(spark):
    """r2 is 0 where dosages, genotypes or both are constant, or one pair is known; it doesn't end the query."""
    rows = [(0, 0, 1, 0), (1, 0, 1, 2), (0, 1, 0, 1), (1, 1, 2, 1), (0, 2, 2, 2), (1, 2, 2, 2), (0, 3, 1, 1), (0, 4, 0, 0), (1, 4, 1, 2), (2, 4, 2, 2), (0, 5, 1, None)]
    d = spark.createDataFrame(rows, "sample_idx int, marker_idx int, dosage int, genotype int")
    got = sorted(map(tuple, calls.concordance(d.drop("genotype"), d.drop("dosage")).collect()))
    assert [r[:3] for r in got] == [(0, 2, 0.0), (1, 2, 0.0), (2, 2, 1.0), (3, 1, 1.0), (4, 3, 2 / 3)]
    assert [r[3] for r in got[:4]] == [0.0] * 4 and abs(got[4][3] - 0.75) < 1e-12
