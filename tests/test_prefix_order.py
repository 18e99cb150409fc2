"""The tree of block summaries against one fold over all markers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploframe.operators import pbwt


def folded(alleles):
    """Orders and divergences of one sequence, marker by marker."""
    order, start, out = np.arange(alleles.shape[1]), np.zeros(alleles.shape[1], np.int32), []
    for m, a in enumerate(alleles):
        order, start = pbwt.add_column(order, start, a, m)
        out.append((order.tolist(), start.tolist()))
    return out


def table(spark, panels):
    rows, m = [], 0
    for chrom, a in panels:
        for x in a:
            rows.append((chrom, m, bytearray(x.tobytes())))
            m += 1
    return spark.createDataFrame(rows, "chrom string, marker_idx int, alleles binary").repartition(3)


@pytest.mark.parametrize("block, fan", [(1, 2), (2, 3), (7, 2), (5, 16), (None, 16)])
def test_tree_is_the_fold(spark, block, fan):
    r = np.random.default_rng(1)
    founders = r.integers(0, 2, (61, 5)).astype(np.uint8)
    panels = [("a", founders[:40, r.integers(0, 5, 23)]), ("b", r.choice([0, 0, 1, 255, 2], (21, 23)).astype(np.uint8))]
    got = {x.marker_idx: (list(x.order), list(x.divergence)) for x in pbwt.fold_order(table(spark, panels), block, fan).collect()}
    want = [x for _, a in panels for x in folded(a)]
    assert [got[m] for m in range(61)] == want


def test_summaries_combine_in_any_grouping():
    r = np.random.default_rng(3)
    for _ in range(50):
        blocks = [r.integers(0, 2, (r.integers(1, 5), 9)).astype(np.uint8) for _ in range(4)]
        parts = [(np.array(o), np.array(s, np.int32), len(b)) for b in blocks for o, s in folded(b)[-1:]]
        join = lambda x, y: (*pbwt.compose(x[0], x[1], x[2], y[0], y[1], y[2]), x[2] + y[2])
        left = join(join(join(parts[0], parts[1]), parts[2]), parts[3])
        right = join(parts[0], join(parts[1], join(parts[2], parts[3])))
        want = folded(np.concatenate(blocks))[-1]
        assert left[0].tolist() == right[0].tolist() == want[0] and left[1].tolist() == right[1].tolist() == want[1]


def test_empty_panel(spark):
    assert pbwt.fold_order(table(spark, [])).count() == 0


def test_many_haplotypes(spark):
    """250,000 haplotypes, 64 markers: blocks are cut by their cells, lists of orders stay apart."""
    haps, marks = 250_000, 64
    panel = spark.range(marks).select(F.lit("c").alias("chrom"), F.col("id").cast("int").alias("marker_idx"), F.unhex(F.repeat(F.when(F.col("id") % 3 == 0, "0001").otherwise("0100"), haps // 2)).alias("alleles"))
    last = pbwt.fold_order(panel, 32).filter(f"marker_idx = {marks - 1}").select("order", F.size("divergence").alias("n")).first()
    # The last marker, 63, has ALT at odd haplotypes, which were all alike so far.
    assert last.n == haps and list(last.order[:3]) == [0, 2, 4] and list(last.order[-2:]) == [haps - 3, haps - 1]


def test_runs_of_bits():
    r = np.random.default_rng(5)
    for bits in (np.zeros(0, np.uint8), np.ones(1, np.uint8), np.zeros(300, np.uint8), np.ones(70_000, np.uint8), *(np.repeat(r.integers(0, 2, 40), r.integers(1, k, 40)).astype(np.uint8) for k in (2, 130, 20_000))):
        assert np.array_equal(pbwt.bits_of(pbwt.runs_of(bits)) if len(bits) else bits, bits)
    assert len(pbwt.runs_of(np.zeros(127, np.uint8))) == 1 and len(pbwt.runs_of(np.ones(128, np.uint8))) == 3


@pytest.mark.parametrize("block, fan", [(1, 2), (7, 3), (64, 16)])
def test_compact_index_is_the_fold(spark, tmp_path, block, fan):
    r = np.random.default_rng(2)
    panels = [("a", r.integers(0, 2, (40, 23)).astype(np.uint8)), ("b", r.choice([0, 0, 1, 255, 2], (21, 23)).astype(np.uint8))]
    pbwt.save_index(pbwt.compact_index(table(spark, panels), block, fan), str(tmp_path / "i"))
    got = {x.marker_idx: (list(x.order), list(x.divergence)) for x in pbwt.load_index(spark, str(tmp_path / "i")).collect()}
    assert [got[m] for m in range(61)] == [x for _, a in panels for x in folded(a)]


def test_size_of_a_compact_index(spark, tmp_path):
    """1,644 markers of 4,432 haplotypes take less than the published 55 MB, by far."""
    from haploframe.plans import scale
    from haploframe.sources import vcf

    rows = scale.lines(spark, scale.HAPLOTYPES // 2, 1, 0.0, "|").select(F.split("line", "\t").alias("f"), "marker_idx")
    pbwt.save_index(pbwt.compact_index(vcf.wide_panel(vcf.parse_fields(rows))), str(tmp_path / "i"))
    assert sum(p.stat().st_size for p in (tmp_path / "i").glob("*.parquet")) < 5_500_000
