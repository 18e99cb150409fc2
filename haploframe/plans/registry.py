"""Registered queries over the driver's tables and the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..__main__ import main as command
from ..config import ImputationConfig, ImputationError
from ..functions import genotypes as gt
from ..functions.logspace import log10_add, logsumexp, logsumexp_by
from ..operators import calls, hmm, lookups, pbwt
from ..sources import vcf
from ..storage import shared_path
from ..streaming.folder import impute_stream
from . import panel
from .impute import Imputer, impute
from .panel import HAPLOTYPES, MARKERS, PANEL_SAMPLES, PARAMETERS, STATES, TARGETS


def rounded(df, *columns, places: int = 4):
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def flagship(spark, sf_dir):
    """Panel, index, states, forward-backward, calls, dosage and INFO in one result."""
    config = ImputationConfig(PARAMETERS, selector="first", deterministic=True)
    r = Imputer(panel.alleles(spark, sf_dir), panel.markers(spark), config).build_index().impute(panel.likelihoods(spark, sf_dir))
    return r.dosages().join(r.info, "marker_idx").select("sample_idx", "marker_idx", "dosage", F.round("info", 6).alias("info"))


def parsed_records(spark, sf_dir):
    """Record lines made of orders, parsed again."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    line = F.concat_ws("\t", F.lit("chr1"), k.cast("string"), F.concat(F.lit("rs"), k.cast("string")), F.lit("A"), F.when(k % 5 == 0, "C,G").otherwise("C"), F.when(k % 3 == 0, ".").otherwise((k % 100).cast("string")), F.lit("PASS"), F.lit("."), F.lit("GT:DP"), F.concat((k % 2).cast("string"), F.lit("|"), (k % 3).cast("string"), F.lit(":7")), F.when(k % 4 == 0, "./.").otherwise(F.concat(F.lit("0/"), (k % 2).cast("string"))))
    r = vcf.parse_fields(o.select(F.split(line, "\t").alias("f"), k.alias("marker_idx")))
    g = lambda s, i: F.coalesce(F.get(gt.parse_gt(F.get("fields", F.lit(s))), F.lit(i)).cast("int"), F.lit(-1)).alias(f"s{s}_a{i}")
    return r.select("marker_idx", "pos", "id", F.get("alt", F.lit(0)).alias("alt"), F.size("alt").alias("n_alt"), "qual", g(0, 0), g(0, 1), g(1, 0), g(1, 1))


def argmax(spark, sf_dir):
    return calls.argmax_calls(panel.posteriors(spark, sf_dir), panel.states(spark, sf_dir))


def phased(spark, sf_dir):
    return vcf.phased_rows(argmax(spark, sf_dir), panel.markers(spark))


def allelic(spark, sf_dir):
    return calls.allelic_posteriors(panel.posteriors(spark, sf_dir), panel.states(spark, sf_dir))


def probabilities(spark, sf_dir):
    return rounded(allelic(spark, sf_dir).select("sample_idx", "marker_idx", *gt.genotype_probabilities(F.col("p"), F.col("q"))), "p0", "p1", "p2")


def probability_rows(spark, sf_dir):
    g = panel.genotypes(spark, sf_dir)
    p = [F.when(F.col("genotype").isNull(), (3 - i) / 6).when(F.col("genotype") == i, 0.75).otherwise(0.125).alias(f"p{i}") for i in range(3)]
    return vcf.probability_rows(g.select("sample_idx", "marker_idx", *p).withColumn("ds", F.col("p1") + 2 * F.col("p2")), panel.markers(spark))


def order(spark, sf_dir, samples=PANEL_SAMPLES):
    return pbwt.prefix_order(panel.alleles(spark, sf_dir, samples))


def wide(spark, sf_dir):
    return pbwt.wide(panel.alleles(spark, sf_dir), panel.markers(spark))


def unfolded(index):
    r = index.select("marker_idx", F.posexplode(F.arrays_zip("order", "divergence")).alias("rank", "x"))
    return r.select("marker_idx", "rank", F.col("x.order").alias("hap_idx"), F.col("x.divergence").alias("divergence"))


def folded(spark, sf_dir):
    """In blocks of seven markers, so that orders are carried."""
    return unfolded(pbwt.fold_order(wide(spark, sf_dir), 7))


def stored_index(spark, sf_dir):
    path = shared_path(spark, "index")
    pbwt.save_index(pbwt.fold_order(wide(spark, sf_dir)), path)
    return unfolded(pbwt.load_index(spark, path))


def compact_index(spark, sf_dir):
    """The orders from a stored compact index, five markers a block."""
    path = shared_path(spark, "compact-index")
    pbwt.save_index(pbwt.compact_index(wide(spark, sf_dir), 5, 3), path)
    return unfolded(pbwt.load_index(spark, path))


def chosen(states, selector="auto", samples=PANEL_SAMPLES):
    """States from the lists of an index, as Imputer takes them."""
    return lambda s, d: pbwt.choose(pbwt.fold_order(pbwt.wide(panel.alleles(s, d, samples), panel.markers(s))), states, 2 * samples, selector)


def panel_file(spark, sf_dir) -> str:
    """The panel as a VCF folder; a missing allele is a dot."""
    a = panel.alleles(spark, sf_dir).withColumn("x", F.coalesce(F.col("allele").cast("string"), F.lit(".")))
    cells = a.groupBy("marker_idx", F.expr("hap_idx div 2").alias("sample_idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hap_idx", "x"))), lambda c: c["x"]), "|").alias("text"))
    path = shared_path(spark, "panel-vcf")
    vcf.write_vcf(vcf.cell_rows(cells, panel.markers(spark), F.col("text"), "GT"), path, [f"P{i}" for i in range(PANEL_SAMPLES)], ["chr1"])
    return path


def target_file(spark, sf_dir, compression="none") -> str:
    g = panel.genotypes(spark, sf_dir)
    text = F.when(F.col("genotype") == 0, "0/0").when(F.col("genotype") == 1, "0/1").when(F.col("genotype") == 2, "1/1").otherwise("./.")
    path = shared_path(spark, "target-vcf")
    vcf.write_vcf(vcf.cell_rows(g, panel.markers(spark), text, "GT"), path, [f"T{i}" for i in range(TARGETS)], ["chr1"], compression)
    return path


def header_of_file(spark, sf_dir):
    h = vcf.read_header(spark, panel_file(spark, sf_dir))
    return spark.createDataFrame([(i, n, h.contigs[0], h.num_samples) for i, n in enumerate(h.sample_names)], "sample_idx long, sample_id string, contig string, samples long")


def panel_of_file(spark, sf_dir):
    return vcf.panel_alleles(vcf.records(spark, panel_file(spark, sf_dir)))


def wide_panel_of_file(spark, sf_dir):
    return vcf.wide_panel(vcf.records(spark, panel_file(spark, sf_dir))).select("marker_idx", "chrom", "pos", F.hex("alleles").alias("alleles"))


def targets_of_file(spark, sf_dir):
    return vcf.target_likelihoods(vcf.records(spark, target_file(spark, sf_dir, "gzip")))


def panel_in(form: str):
    """The panel through one indexed file of a form, read by runs of some kilobytes."""

    def read(spark, sf_dir):
        rows = vcf.text_records(spark, panel_file(spark, sf_dir)).select("marker_idx", F.concat_ws("\t", "chrom", "pos", "id", "ref", F.array_join("alt", ","), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.array_join("fields", "\t")).alias("line"))
        path = f"{shared_path(spark, 'panel')}.{form}"
        vcf.save_vcf(rows, path, [f"P{i}" for i in range(PANEL_SAMPLES)], ["chr1"])
        return path

    return read


def panel_of(form: str):
    return lambda s, d: vcf.panel_alleles(vcf.records(s, panel_in(form)(s, d), split=701))


def region_of_index(form: str):
    """A region of one indexed file: its chunks alone are read."""
    return lambda s, d: vcf.panel_alleles(vcf.records(s, panel_in(form)(s, d), where="chr1:5000-20000"))


def short_targets(spark, sf_dir):
    """Records that end before the header's last samples: what is missing counts as not genotyped."""
    g = panel.genotypes(spark, sf_dir).filter(F.col("sample_idx") < TARGETS - F.col("marker_idx") % 4)
    text = F.when(F.col("genotype") == 0, "0/0").when(F.col("genotype") == 1, "0/1").when(F.col("genotype") == 2, "1/1").otherwise("./.")
    path = shared_path(spark, "short-vcf")
    vcf.write_vcf(vcf.cell_rows(g, panel.markers(spark), text, "GT"), path, [f"T{i}" for i in range(TARGETS)], ["chr1"])
    return vcf.target_likelihoods(vcf.records(spark, path))


def region_of_file(spark, sf_dir):
    r = vcf.records(spark, target_file(spark, sf_dir), where="chr1:5000-20000")
    return r.select("marker_idx", "chrom", "pos", "id", "ref", F.get("alt", F.lit(0)).alias("alt"), F.size("fields").alias("samples"))


def stored_panel(spark, sf_dir):
    path = shared_path(spark, "panel")
    vcf.save_panel(spark, panel.alleles(spark, sf_dir), panel.markers(spark), path)
    alleles, marks = vcf.load_panel(spark, path)
    return alleles.join(marks.select("marker_idx", "pos"), "marker_idx")


def imputed_files(spark, sf_dir):
    """Panel and targets from files, calls to a gzip file, and its lines read back."""
    out = shared_path(spark, "imputed-vcf")
    config = ImputationConfig(PARAMETERS, selector="first", deterministic=True)
    impute(spark, panel_file(spark, sf_dir), target_file(spark, sf_dir), out, config, "gzip")
    return lines_of(spark, out)


def lines_of(spark, path):
    """The cells of a written file with their samples' names."""
    r = vcf.records(spark, path)
    names = F.lit(vcf.read_header(spark, path).sample_names)
    return r.select("marker_idx", "chrom", "pos", F.posexplode("fields").alias("sample_idx", "gt")).withColumn("sample_id", F.get(names, "sample_idx"))


def imputed_by_command(spark, sf_dir):
    """The command line from files to one BCF file, its exit code, and the one it gives without a panel."""
    out = f"{shared_path(spark, 'commanded')}.bcf"
    args = ["-t", target_file(spark, sf_dir), "-o", out, "-s", str(STATES), "--selector", "first", "--deterministic", "--batch-size", "10", "--progress", "--benchmark"]
    code, none = command(["-r", panel_file(spark, sf_dir), *args]), command(["-r", shared_path(spark, "none"), *args])
    return lines_of(spark, out).withColumns({"code": F.lit(code), "code_without_panel": F.lit(none)})


def imputed_with_progress(spark, sf_dir):
    """Calls of one query whose progress is told for each five samples: how often, up to which sample, and whether it has rates."""
    told = []
    imputer = Imputer(panel.alleles(spark, sf_dir), panel.markers(spark), ImputationConfig(PARAMETERS, selector="first", deterministic=True)).build_index()
    found = imputer.run(panel.likelihoods(spark, sf_dir), shared_path(spark, "told"), lambda *x: told.append(x), 5)
    found.release()
    rising = all(a < b for (a, _), (b, _) in zip(told, told[1:]))
    return found.imputed.withColumns({"calls": F.lit(len(told)), "last": F.lit(told[-1][0]), "total": F.lit(told[-1][1]), "rising": F.lit(rising), "rates": F.lit(sum(v > 0 for v in found.rates.values()))})


def imputed_stream(spark, sf_dir):
    """Likelihoods that arrive as files of whole samples, imputed by the stream."""
    path, out = shared_path(spark, "arriving"), shared_path(spark, "streamed")
    panel.likelihoods(spark, sf_dir).repartition(4, "sample_idx").select("sample_idx", "marker_idx", "ll_00", "ll_01", "ll_11").write.parquet(path)
    imputer = Imputer(panel.alleles(spark, sf_dir), panel.markers(spark), ImputationConfig(PARAMETERS, selector="first", deterministic=True)).build_index()
    impute_stream(spark, imputer, path, out, shared_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def mismatch(spark, sf_dir):
    """What the check says of targets with a marker for each part."""
    try:
        Imputer(panel.alleles(spark, sf_dir), panel.markers(spark)).check(panel.likelihoods(spark, sf_dir), panel.sites(spark, sf_dir))
        said = None
    except ImputationError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "said string")


def looked_up(spark, sf_dir):
    """Places inside and beyond the panel and the targets."""
    m = F.col("id")
    places = spark.range(40 * 36).select((m % 40).cast("int").alias("marker_idx"), (m / 40).cast("int").alias("hap_idx"), (m / 40).cast("int").alias("sample_idx"))
    calls_ = argmax(spark, sf_dir)
    info = calls.info_scores(calls.dosages(calls.likelihood_calls(panel.likelihoods(spark, sf_dir))))
    r = lookups.allele_at(places, panel.alleles(spark, sf_dir))
    r = lookups.likelihood_at(r, panel.likelihoods(spark, sf_dir))
    r = lookups.haplotypes_at(r, calls_)
    r = lookups.dosage_at(r, calls.dosages(calls_))
    return rounded(lookups.info_at(r, info), "info", places=6)


def dynamic(spark, sf_dir):
    wanted = panel.markers(spark).select("marker_idx", (F.col("marker_idx") % 5 + 1).alias("states"))
    return pbwt.select_dynamic(order(spark, sf_dir), wanted, HAPLOTYPES)


def logs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return e.select((F.col("l_orderkey") % 50).cast("int").alias("row"), F.col("l_linenumber").alias("col"), (-F.col("l_quantity") / 10).alias("x"))


def pairwise(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a, b = -F.col("l_quantity") / 10, -F.col("l_discount") * 100
    r = e.select("l_orderkey", "l_linenumber", logsumexp(a, b).alias("lse2"), logsumexp(a, b, a - b).alias("lse3"), log10_add(a, b).alias("log10_sum"))
    return rounded(r.groupBy("l_orderkey").agg(F.sum("lse2").alias("lse2"), F.sum("lse3").alias("lse3"), F.sum("log10_sum").alias("log10_sum")), "lse2", "lse3", "log10_sum")


def theta_emission(spark, sf_dir):
    j = panel.likelihoods(spark, sf_dir).join(panel.alleles(spark, sf_dir), "marker_idx")
    e = gt.haploid_emission(F.col("ll_00"), F.col("ll_01"), F.col("ll_11"), F.coalesce("allele", F.lit(255)), PARAMETERS.theta)
    return rounded(j.select("sample_idx", "marker_idx", "hap_idx", e.alias("emission")), "emission", places=6)


def placed(spark, sf_dir):
    """The orders' customers as samples in five equal runs: each run's rows are in the partition of its number."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("int").alias("sample_idx"), "o_orderkey")
    samples = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.max("c_custkey")).first()[0] + 1
    return calls.placed(o, 5, samples).groupBy("sample_idx", "part", F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))


def concordance(spark, sf_dir):
    return rounded(calls.concordance(calls.dosages(argmax(spark, sf_dir)), panel.genotypes(spark, sf_dir)), "concordance", "r2")


def queries() -> dict:
    p = panel
    post = lambda mode, window=0: lambda s, d: rounded(hmm.unrolled(p.posteriors(s, d, mode, window)).select("sample_idx", "marker_idx", "state", "log_post"), "log_post")
    values = lambda c: lambda s, d: rounded(hmm.unrolled(p.posteriors(s, d)).select("sample_idx", "marker_idx", "state", c), c)
    return {
        "panel_alleles": p.alleles,
        "target_genotypes": p.genotypes,
        "genotype_likelihoods": p.likelihoods,
        "region_scan": lambda s, d: vcf.region(p.sites(s, d), "chr1:5000-200000").select("marker_idx", "chrom", "pos", "id"),
        "marker_projection": lambda s, d: rounded(p.mapped_sites(s, d), "morgans", places=9),
        "vcf_record_parse": parsed_records,
        "vcf_phased_rows": phased,
        "vcf_prob_rows": probability_rows,
        "pbwt_prefix_order": order,
        "pbwt_fold_order": folded,
        "pbwt_divergence_as_implemented": lambda s, d: pbwt.divergence(p.alleles(s, d)),
        "pbwt_divergence_documented": lambda s, d: pbwt.divergence(p.alleles(s, d), "documented"),
        "pbwt_stats": lambda s, d: rounded(pbwt.stats(pbwt.divergence(p.alleles(s, d), "documented"), order(s, d), p.alleles(s, d)), "avg_divergence", "median_divergence", "run_ratio"),
        "pbwt_validate": lambda s, d: pbwt.validate(order(s, d)),
        "select_states_first_l": lambda s, d: pbwt.select_first(order(s, d), STATES, HAPLOTYPES),
        "select_states_warp": lambda s, d: pbwt.select_warp(order(s, d, 64), STATES, 128),
        "select_states_longest": lambda s, d: pbwt.select_longest(pbwt.divergence(p.alleles(s, d), "documented"), STATES, HAPLOTYPES),
        "select_states_simple": lambda s, d: pbwt.select_simple(p.sites(s, d), STATES, HAPLOTYPES),
        "select_states_padded": lambda s, d: pbwt.select_first(order(s, d), 40, HAPLOTYPES),
        "select_dynamic": dynamic,
        "state_alleles": p.states,
        "emission_probs": p.emissions,
        "haploid_emission_theta": theta_emission,
        "haploid_emission_theta_panel": theta_emission,
        "transition_probs": lambda s, d: rounded(hmm.transitions(p.mapped_sites(s, d), PARAMETERS), "rho", "log_stay", "log_switch", places=6),
        "linear_switch_prob": lambda s, d: rounded(p.sites(s, d).select("marker_idx", gt.linear_switch(F.col("pos") / 1e6, 10000, 4e-4).alias("rho")).withColumn("stay", 1 - F.col("rho")), "rho", "stay", places=6),
        "logsumexp_rows": lambda s, d: rounded(logsumexp_by(logs(s, d), ["row"], "x", "lse"), "lse"),
        "logsumexp_cols": lambda s, d: rounded(logsumexp_by(logs(s, d), ["col"], "x", "lse"), "lse"),
        "logsumexp_pairwise": pairwise,
        "forward_alpha": values("alpha"),
        "forward_scaling": lambda s, d: rounded(p.posteriors(s, d).select("sample_idx", "marker_idx", "scale"), "scale"),
        "backward_beta": values("beta"),
        "posteriors": post("as_implemented"),
        "posteriors_documented": post("documented"),
        "posteriors_windowed": post("as_implemented", 5),
        "posteriors_windowed_documented": post("documented", 12),
        "haplotype_call_argmax": argmax,
        "haplotype_call_sampled": lambda s, d: calls.sampled_calls(p.posteriors(s, d), p.states(s, d)),
        "dosage": lambda s, d: calls.dosages(argmax(s, d)),
        "genotype_probs": probabilities,
        "info_score": lambda s, d: rounded(calls.info_scores(calls.dosages(calls.likelihood_calls(p.likelihoods(s, d)))), "p", "info", places=6),
        "impute_flagship": flagship,
        "memory_estimate": lambda s, d: calls.size_report(p.alleles(s, d), p.likelihoods(s, d), STATES),
        "pack_2bit": lambda s, d: gt.pack_alleles(p.alleles(s, d).fillna(3, ["allele"]), ["marker_idx"]),
        "unpack_2bit": lambda s, d: gt.unpack_alleles(gt.pack_alleles(p.alleles(s, d).fillna(3, ["allele"]), ["marker_idx"]), ["marker_idx"]),
        "sample_partitions": placed,
        "concordance_r2": concordance,
        "vcf_header_scan": header_of_file,
        "vcf_panel_scan": panel_of_file,
        "vcf_wide_panel": wide_panel_of_file,
        "vcf_target_scan": targets_of_file,
        "vcf_region_records": region_of_file,
        "vcf_blocked_scan": panel_of("vcf.gz"),
        "bcf_scan": panel_of("bcf"),
        "vcf_indexed_region": region_of_index("vcf.gz"),
        "bcf_indexed_region": region_of_index("bcf"),
        "vcf_short_records": short_targets,
        "panel_store": stored_panel,
        "pbwt_index_store": stored_index,
        "pbwt_compact_index": compact_index,
        "pbwt_validate_sorted": lambda s, d: pbwt.validate_sorted(order(s, d), p.alleles(s, d)),
        "index_states_first": chosen(STATES, "first"),
        "index_states_warp": chosen(STATES, "auto", 64),
        "index_states_longest": chosen(STATES, "longest"),
        "index_states_padded": chosen(40),
        "impute_files": imputed_files,
        "impute_command": imputed_by_command,
        "impute_progress": imputed_with_progress,
        "impute_stream": imputed_stream,
        "impute_mismatch": mismatch,
        "lookup_defaults": looked_up,
    }



def base(samples: int = PANEL_SAMPLES) -> str:
    """Common tables of the oracles, for a panel of so many samples."""
    haps = 2 * samples
    return f"""
with recursive m as (select range::int as marker_idx from range({MARKERS})),
known as (select (l_partkey % {MARKERS})::int as marker_idx, ((l_suppkey % {samples}) * 2 + l_linenumber % 2)::int as hap_idx, (sum(l_quantity)::bigint % 2)::int as allele from lineitem group by 1, 2),
al as (select m.marker_idx, h.range::int as hap_idx, allele from m cross join range({haps}) h left join known k on k.marker_idx = m.marker_idx and k.hap_idx = h.range),
gen as (select (l_orderkey % {TARGETS})::int as sample_idx, (l_partkey % {MARKERS})::int as marker_idx, case when count(*) % 7 <> 0 then (sum(l_quantity)::bigint % 3)::int end as genotype from lineitem group by 1, 2),
gl as (select sample_idx, marker_idx, case when genotype is null or genotype = 0 then 0.0 else -999.0 end::double as ll_00, case when genotype is null or genotype = 1 then 0.0 else -999.0 end::double as ll_01, case when genotype is null or genotype = 2 then 0.0 else -999.0 end::double as ll_11 from gen),
mk as (select marker_idx, 'chr1' as chrom, ((marker_idx + 1) * 1000 + marker_idx * marker_idx * 10)::bigint as pos, 'rs' || (marker_idx + 1) as id, 'A' as ref, 'G' as alt from m),
ky as (select marker_idx, hap_idx, allele, reverse(string_agg(case when coalesce(allele, 255) = 0 then '0' else '1' end, '') over (partition by hap_idx order by marker_idx)) as revkey from al),
pf as (select *, (row_number() over (partition by marker_idx order by revkey, hap_idx) - 1)::int as rank, lag(revkey) over (partition by marker_idx order by revkey, hap_idx) as prev from ky),
dv as (select marker_idx, rank, hap_idx, (marker_idx + 1 - coalesce((select max(k) from range(0, marker_idx + 2) t(k) where prev is not null and substr(revkey, 1, k) = substr(prev, 1, k)), 0))::int as divergence from pf),
st0 as (select marker_idx, rank as state, hap_idx as hap0, ((hap_idx + 1) % {haps})::int as hap1 from pf where rank < {STATES}),
sa as (select s.marker_idx, state, hap0, hap1, coalesce(a.allele, 255)::int as a0, coalesce(b.allele, 255)::int as a1 from st0 s join al a on a.marker_idx = s.marker_idx and a.hap_idx = hap0 join al b on b.marker_idx = s.marker_idx and b.hap_idx = hap1),
em as (select sample_idx, gl.marker_idx, state, case a0 + a1 when 0 then ll_00 when 1 then ll_01 else ll_11 end as log_e from gl join sa using (marker_idx)),
gap as (select marker_idx, case when lead(pos) over (order by marker_idx) is not null then greatest(0.0, (lead(pos) over (order by marker_idx)) / 1e8 - pos / 1e8) end as d from mk),
rh as (select marker_idx, least(1.0, greatest(0.0, 1 - exp(d * (-4.0 * 10000 * 4.0)))) as rho from gap where d is not null),
tr as (select marker_idx, rho, case when 1 - rho + rho / 20000.0 < 1e-300 then -999.0 else log10(1 - rho + rho / 20000.0) end as log_stay, case when rho / 20000.0 < 1e-300 then -999.0 else log10(rho / 20000.0) end as log_switch from rh)
"""


BASE = base()
SITES = """
with sites as (select *, case when cm > 0 then cm / 100.0 else pos / 1e8 end::double as morgans from (
  select p_partkey::int as marker_idx, 'chr' || (p_partkey // 500 + 1) as chrom, ((p_partkey % 500 + 1) * 1000 + p_size)::bigint as pos, 'rs' || p_partkey as id, case when p_partkey % 3 = 0 then p_retailprice / 1000 else 0.0 end::double as cm from part))
"""
LSE = "list_transform({xs}, lambda xs: ln(list_sum(list_transform(xs, lambda x: exp(x - list_max(xs))))) + list_max(xs))"


def recursion_sql(documented: bool = False) -> str:
    """The common tables with el (emission lists), fw (forward), bw (backward) and po (posteriors)."""
    k = f"range({STATES})"
    unit = "ln(10.0)" if documented else "1.0"
    seed = "[]::double[]" if documented else "[-999.0]::double[]"
    which = "t.marker_idx = f.m" if documented else "t.marker_idx = 0"
    back = "t.marker_idx = b.m - 1" if documented else "t.marker_idx = 0"
    fwd = LSE.format(xs=f"list_transform({k}, lambda j: list_concat({seed}, list_transform({k}, lambda i: f.a[i + 1] + {unit} * case when i = j then t.log_stay else t.log_switch end)))")
    bwd = LSE.format(xs=f"list_transform({k}, lambda i: list_concat({seed}, list_transform({k}, lambda j: {unit} * case when i = j then t.log_stay else t.log_switch end + e.e[j + 1] + b.b[j + 1])))")
    return BASE + f""",
el as (select sample_idx, marker_idx, list(log_e * {unit} order by state) as e from em group by 1, 2),
fw(sample_idx, m, a, scale) as (
  select sample_idx, 0, list_transform(e, lambda x: x - list_max(e)), list_max(e) from el where marker_idx = 0
  union all
  select sample_idx, m, list_transform(v, lambda x: x - list_max(v)), list_max(v) from (
    select f.sample_idx, f.m + 1 as m, list_transform({k}, lambda j: l[j + 1] + e.e[j + 1]) as v from (select f.*, {fwd} as l from fw f, tr t where {which}) f join el e on e.sample_idx = f.sample_idx and e.marker_idx = f.m + 1)),
bw(sample_idx, m, b) as (
  select sample_idx, {MARKERS - 1}, list_transform(e, lambda x: 0.0::double) from el where marker_idx = {MARKERS - 1}
  union all
  select b.sample_idx, b.m - 1, {bwd} from bw b join el e on e.sample_idx = b.sample_idx and e.marker_idx = b.m join tr t on {back} where b.m > 0),
ps as (select f.sample_idx, f.m, list_transform({k}, lambda j: f.a[j + 1] + b.b[j + 1]) as v from fw f join bw b on f.sample_idx = b.sample_idx and f.m = b.m),
pn as (select sample_idx, m, v, {LSE.format(xs=f"[list_concat({seed}, v)]")}[1] as z from ps),
po as (select sample_idx, m::int as marker_idx, s.range::int as state, v[s.range + 1] - z as log_post from pn, range({STATES}) s)
"""


def oracle_sql() -> dict:
    rec, doc = recursion_sql(), recursion_sql(True)
    best = rec + ", ca as (select sample_idx, marker_idx, state from (select *, row_number() over (partition by sample_idx, marker_idx order by round(log_post, 6) desc, state) as n from po) where n = 1), cl as (select sample_idx, ca.marker_idx, ca.state, a0 as hap0, a1 as hap1 from ca join sa using (marker_idx, state)), ds as (select sample_idx, marker_idx, (hap0 + hap1)::int as dosage from cl)"
    probs = rec + ", ap as (select sample_idx, marker_idx, sum(case when a0 <> 0 then exp(log_post) else 0.0 end) / sum(exp(log_post)) as p, sum(case when a1 <> 0 then exp(log_post) else 0.0 end) / sum(exp(log_post)) as q from po join sa using (marker_idx, state) group by 1, 2)"
    info = "case when p <= 0 or p >= 1 then 1.0 else greatest(0.0, least(1.0, 1 - (sq - mu * mu) / (2 * p * (1 - p)))) end::double"
    unroll = lambda col: f"select sample_idx, m::int as marker_idx, s.range::int as state, round({col}[s.range + 1], 4) + 0.0 as "
    padded = lambda n, haps, rule: f"select marker_idx, k.range::int as state, hap0, ((hap0 + 1) % {haps})::int as hap1 from (select m.marker_idx, k.range, coalesce({rule}, k.range % {haps})::int as hap0 from m cross join range({n}) k) k"
    region = ", rg as (select marker_idx as m, (row_number() over (order by marker_idx) - 1)::int as marker_idx from mk where pos between 5000 and 20000) select rg.marker_idx, hap_idx, allele from rg join al on al.marker_idx = rg.m"
    logs = "with l as (select (l_orderkey % 50)::int as row, l_linenumber as col, -l_quantity / 10 as x from lineitem), t as (select {k}, max(x) as top from l group by 1) select {k}, round(max(top) + ln(sum(exp(x - top))), 4) + 0.0 as lse from l join t using ({k}) group by 1"
    lse = lambda *v: f"greatest({', '.join(v)}) + ln({' + '.join(f'exp({x} - greatest({chr(44).join(v)}))' for x in v)})"
    return {
        "panel_alleles": BASE + "select * from al",
        "target_genotypes": BASE + "select * from gen",
        "genotype_likelihoods": BASE + "select * from gl",
        "region_scan": SITES + "select marker_idx, chrom, pos, id from sites where chrom = 'chr1' and pos between 5000 and 200000",
        "marker_projection": SITES + "select marker_idx, chrom, pos, round(morgans, 9) + 0.0 as morgans from sites",
        "vcf_record_parse": """select o_orderkey::int as marker_idx, o_orderkey as pos, 'rs' || o_orderkey as id, 'C' as alt, case when o_orderkey % 5 = 0 then 2 else 1 end::int as n_alt, case when o_orderkey % 3 = 0 then 0.0 else (o_orderkey % 100)::double end::double as qual,
  (o_orderkey % 2)::int as s0_a0, (o_orderkey % 3)::int as s0_a1, case when o_orderkey % 4 = 0 then -1 else 0 end::int as s1_a0, case when o_orderkey % 4 = 0 then -1 else o_orderkey % 2 end::int as s1_a1 from orders""",
        "vcf_phased_rows": best + "select marker_idx, chrom || chr(9) || pos || chr(9) || id || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'IMP' || chr(9) || 'GT' || chr(9) || g as line from mk join (select marker_idx, string_agg(hap0 || '|' || hap1, chr(9) order by sample_idx) as g from cl group by 1) using (marker_idx)",
        "vcf_prob_rows": BASE + """, pr as (select sample_idx, marker_idx, case when genotype is null then 0.5 when genotype = 0 then 0.75 else 0.125 end::double as p0, case when genotype is null then 2 / 6.0 when genotype = 1 then 0.75 else 0.125 end::double as p1, case when genotype is null then 1 / 6.0 when genotype = 2 then 0.75 else 0.125 end::double as p2 from gen)
select marker_idx, concat_ws(chr(9), chrom, pos, id, ref, alt, '.', 'PASS', 'IMP', 'GT:DS:GP', g) as line from mk join (select marker_idx, string_agg(case when p0 >= p1 and p0 >= p2 then '0|0' when p1 >= p2 then '0|1' else '1|1' end || ':' || printf('%.4f', p1 + 2 * p2) || ':' || printf('%.4f,%.4f,%.4f', p0, p1, p2), chr(9) order by sample_idx) as g from pr group by 1) using (marker_idx)""",
        "pbwt_prefix_order": BASE + "select marker_idx, rank, hap_idx from pf",
        "pbwt_fold_order": BASE + "select * from dv",
        "pbwt_divergence_as_implemented": BASE + "select marker_idx, rank, hap_idx, marker_idx as divergence from pf",
        "pbwt_divergence_documented": BASE + "select * from dv",
        "pbwt_stats": BASE + f", rn as (select marker_idx, (case when lag(coalesce(allele, 255)) over (partition by marker_idx order by rank) is distinct from coalesce(allele, 255) then 1 else 0 end) as new from pf), rr as (select marker_idx, sum(new) / count(*)::double as r from rn group by 1) select marker_idx, round(avg(divergence), 4) + 0.0 as avg_divergence, round(quantile_cont(divergence, 0.5)::double, 4) + 0.0 as median_divergence, max(divergence) as max_divergence, round(any_value(r), 4) + 0.0 as run_ratio from dv join rr using (marker_idx) group by 1",
        "pbwt_validate": BASE + "select marker_idx, count(*) as haplotypes, count(distinct hap_idx) = count(*) and count(distinct rank) = count(*) and min(hap_idx) = 0 and max(hap_idx) = count(*) - 1 as is_permutation from pf group by 1",
        "select_states_first_l": BASE + "select * from st0",
        "select_states_warp": base(64) + padded(STATES, 128, "(select hap_idx from pf where pf.marker_idx = m.marker_idx and k.range < 4 and pf.rank = 32 * k.range)"),
        "select_states_longest": BASE + f"select marker_idx, state, hap_idx as hap0, ((hap_idx + 1) % {HAPLOTYPES})::int as hap1 from (select *, (row_number() over (partition by marker_idx order by divergence, rank) - 1)::int as state from dv) where state < {STATES}",
        "select_states_simple": SITES + f"select marker_idx, k.range::int as state, ((2 * k.range) % {HAPLOTYPES})::int as hap0, ((2 * k.range + 1) % {HAPLOTYPES})::int as hap1 from sites, range({STATES}) k",
        "select_states_padded": BASE + padded(40, HAPLOTYPES, "(select hap_idx from pf where pf.marker_idx = m.marker_idx and pf.rank = k.range)"),
        "select_dynamic": BASE + f"select marker_idx, rank as state, hap_idx as hap0, ((hap_idx + 1) % {HAPLOTYPES})::int as hap1 from pf where rank < marker_idx % 5 + 1",
        "state_alleles": BASE + "select * from sa",
        "emission_probs": BASE + "select * from em",
        "haploid_emission_theta": BASE + ", pw as (select sample_idx, gl.marker_idx, hap_idx, coalesce(allele, 255) as a, pow(10.0, ll_00) as x, pow(10.0, ll_01) as y, pow(10.0, ll_11) as z from gl join al on gl.marker_idx = al.marker_idx) select sample_idx, marker_idx, hap_idx, round(((case when a = 0 then x else z end) * 0.999::double + y * 0.5::double + (case when a = 0 then z else x end) * 0.001::double) / (x + y + z), 6) + 0.0 as emission from pw",
        "haploid_emission_theta_panel": BASE + ", pw as (select sample_idx, gl.marker_idx, hap_idx, coalesce(allele, 255) as a, pow(10.0, ll_00) as x, pow(10.0, ll_01) as y, pow(10.0, ll_11) as z from gl join al on gl.marker_idx = al.marker_idx) select sample_idx, marker_idx, hap_idx, round(((case when a = 0 then x else z end) * 0.999::double + y * 0.5::double + (case when a = 0 then z else x end) * 0.001::double) / (x + y + z), 6) + 0.0 as emission from pw",
        "transition_probs": SITES + ", gp as (select marker_idx, lead(morgans) over by_chrom - morgans as d from sites window by_chrom as (partition by chrom order by marker_idx)), rr as (select marker_idx, least(1.0, greatest(0.0, 1 - exp(greatest(0.0, d) * (-4.0 * 10000 * 4.0)))) as rho from gp where d is not null) select marker_idx, round(rho::double, 6) + 0.0 as rho, round((case when 1 - rho + rho / 20000.0 < 1e-300 then -999.0 else log10(1 - rho + rho / 20000.0) end)::double, 6) + 0.0 as log_stay, round((case when rho / 20000.0 < 1e-300 then -999.0 else log10(rho / 20000.0) end)::double, 6) + 0.0 as log_switch from rr",
        "linear_switch_prob": SITES + "select marker_idx, round(pos / 1e6 / 100.0 * 4.0::double, 6) + 0.0 as rho, round(1 - pos / 1e6 / 100.0 * 4.0::double, 6) + 0.0 as stay from sites",
        "logsumexp_rows": logs.format(k="row"),
        "logsumexp_cols": logs.format(k="col"),
        "logsumexp_pairwise": f"with l as (select l_orderkey, -l_quantity / 10 as a, -l_discount * 100 as b from lineitem) select l_orderkey, round(sum({lse('a', 'b')}), 4) + 0.0 as lse2, round(sum({lse('a', 'b', '(a - b)')}), 4) + 0.0 as lse3, round(sum(greatest(a, b) + log10(1 + pow(10.0, least(a, b) - greatest(a, b)))), 4) + 0.0 as log10_sum from l group by 1",
        "forward_alpha": rec + unroll("a") + f"alpha from fw, range({STATES}) s",
        "forward_scaling": rec + "select sample_idx, m::int as marker_idx, round(scale, 4) + 0.0 as scale from fw",
        "backward_beta": rec + unroll("b") + f"beta from bw, range({STATES}) s",
        "posteriors": rec + "select sample_idx, marker_idx, state, round(log_post, 4) + 0.0 as log_post from po",
        "posteriors_windowed": rec + "select sample_idx, marker_idx, state, round(log_post, 4) + 0.0 as log_post from po",
        "posteriors_windowed_documented": doc + "select sample_idx, marker_idx, state, round(log_post, 4) + 0.0 as log_post from po",
        "posteriors_documented": doc + "select sample_idx, marker_idx, state, round(log_post, 4) + 0.0 as log_post from po",
        "haplotype_call_argmax": best + "select * from cl",
        "haplotype_call_sampled": rec + ", pp as (select *, exp(log_post - max(log_post) over (partition by sample_idx, marker_idx)) as p from po), pc as (select *, sum(p) over (partition by sample_idx, marker_idx order by state) / sum(p) over (partition by sample_idx, marker_idx) as cum, ('0x' || substr(md5('12345|' || sample_idx || '|' || marker_idx), 1, 8))::bigint / 4294967296.0::double as u from pp), sd as (select sample_idx, marker_idx, coalesce(min(state) filter (u < cum), 0)::int as state from pc group by 1, 2) select sample_idx, sd.marker_idx, sd.state, a0 as hap0, a1 as hap1 from sd join sa using (marker_idx, state)",
        "dosage": best + "select * from ds",
        "genotype_probs": probs + "select sample_idx, marker_idx, round((1 - p) * (1 - q), 4) + 0.0 as p0, round((1 - p) * q + p * (1 - q), 4) + 0.0 as p1, round(p * q, 4) + 0.0 as p2 from ap",
        "info_score": BASE + f", d0 as (select marker_idx, (case when ll_00 > ll_01 and ll_00 > ll_11 then 0 when ll_01 > ll_11 then 1 else 2 end) as g from gl), d1 as (select marker_idx, avg(g) as mu, avg(g * g) as sq, avg(g) / 2 as p from d0 group by 1) select marker_idx, round(p, 6) + 0.0 as p, round({info}, 6) + 0.0 as info from d1",
        "impute_flagship": best + f", g1 as (select marker_idx, avg(dosage) as mu, avg(dosage * dosage) as sq, avg(dosage) / 2 as p from ds group by 1) select sample_idx, ds.marker_idx, dosage, round({info}, 6) as info from ds join g1 using (marker_idx)",
        "memory_estimate": BASE + f"select markers, haplotypes, samples, (markers * haplotypes * 5 + markers * samples * {STATES} * 8)::bigint as bytes from (select count(distinct marker_idx) as markers, count(distinct hap_idx) as haplotypes from al), (select count(distinct sample_idx) as samples from gl)",
        "pack_2bit": BASE + "select marker_idx, (hap_idx // 4)::int as byte_idx, sum((coalesce(allele, 3) & 3) << (2 * (hap_idx % 4)))::int as packed from al group by 1, 2",
        "unpack_2bit": BASE + "select marker_idx, hap_idx, coalesce(allele, 3)::int as allele from al",
        "sample_partitions": "with c as (select max(c_custkey) + 1 as samples from customer), w as (select ceil(samples / 5.0)::int as width from c) select o_custkey::int as sample_idx, (o_custkey // width)::int as part, (o_custkey // width)::int as partition, count(*) as n from orders, w group by 1, 2",
        "vcf_header_scan": f"select range as sample_idx, 'P' || range as sample_id, 'chr1' as contig, {PANEL_SAMPLES}::bigint as samples from range({PANEL_SAMPLES})",
        "vcf_panel_scan": BASE + "select * from al",
        "vcf_wide_panel": BASE + "select marker_idx, chrom, pos, alleles from mk join (select marker_idx, string_agg(case when allele is null then 'FF' else '0' || allele end, '' order by hap_idx) as alleles from al group by 1) using (marker_idx)",
        "vcf_target_scan": BASE + "select * from gl",
        "vcf_region_records": BASE + f"select (row_number() over (order by marker_idx) - 1)::int as marker_idx, chrom, pos, id, ref, alt, {TARGETS} as samples from mk where pos between 5000 and 20000",
        "vcf_blocked_scan": BASE + "select * from al",
        "bcf_scan": BASE + "select * from al",
        "vcf_indexed_region": BASE + region,
        "bcf_indexed_region": BASE + region,
        "vcf_short_records": BASE + f"select sample_idx, marker_idx, case when cut then 0.0 else ll_00 end::double as ll_00, case when cut then 0.0 else ll_01 end::double as ll_01, case when cut then 0.0 else ll_11 end::double as ll_11 from (select *, sample_idx >= {TARGETS} - marker_idx % 4 as cut from gl)",
        "panel_store": BASE + "select al.*, pos from al join mk using (marker_idx)",
        "pbwt_index_store": BASE + "select * from dv",
        "pbwt_compact_index": BASE + "select * from dv",
        "pbwt_validate_sorted": BASE + "select marker_idx, count(*) as haplotypes, count(distinct hap_idx) = count(*) and count(distinct rank) = count(*) and min(hap_idx) = 0 and max(hap_idx) = count(*) - 1 as is_permutation, bool_and(prev is null or prev <= revkey) as is_sorted from pf group by 1",
        "index_states_first": BASE + "select * from st0",
        "index_states_warp": base(64) + padded(STATES, 128, "(select hap_idx from pf where pf.marker_idx = m.marker_idx and k.range < 4 and pf.rank = 32 * k.range)"),
        "index_states_longest": BASE + f"select marker_idx, state, hap_idx as hap0, ((hap_idx + 1) % {HAPLOTYPES})::int as hap1 from (select *, (row_number() over (partition by marker_idx order by divergence, rank) - 1)::int as state from dv) where state < {STATES}",
        "index_states_padded": BASE + padded(40, HAPLOTYPES, "(select hap_idx from pf where pf.marker_idx = m.marker_idx and pf.rank = k.range)"),
        "impute_files": best + "select marker_idx, chrom, pos, sample_idx, 'T' || sample_idx as sample_id, hap0 || '|' || hap1 as gt from cl join mk using (marker_idx)",
        "impute_command": best + "select marker_idx, chrom, pos, sample_idx, 'T' || sample_idx as sample_id, hap0 || '|' || hap1 as gt, 0 as code, 1 as code_without_panel from cl join mk using (marker_idx)",
        "impute_progress": best + "select cl.*, ceil(total / 5.0)::int as calls, total as last, total, true as rising, 3 as rates from cl, (select (max(sample_idx) + 1)::int as total from gl)",
        "impute_stream": best + "select * from cl",
        "impute_mismatch": f"select count(*) || ' target markers for a panel of {MARKERS}' as said from part",
        "lookup_defaults": best + f", g1 as (select marker_idx, avg(g) as mu, avg(g * g) as sq, avg(g) / 2 as p from (select marker_idx, (case when ll_00 > ll_01 and ll_00 > ll_11 then 0 when ll_01 > ll_11 then 1 else 2 end) as g from gl) group by 1), inf as (select marker_idx, round({info}, 6) + 0.0 as info from g1), pl as (select a.range::int as marker_idx, b.range::int as hap_idx, b.range::int as sample_idx from range(40) a, range(36) b) select pl.*, coalesce(allele, 255) as allele, coalesce(ll_00, 0.0) as ll_00, coalesce(ll_01, 0.0) as ll_01, coalesce(ll_11, 0.0) as ll_11, hap0, hap1, coalesce(hap0 + hap1, 0)::int as dosage, coalesce(info, 0.0) as info from pl left join al using (marker_idx, hap_idx) left join gl using (sample_idx, marker_idx) left join cl using (sample_idx, marker_idx) left join inf using (marker_idx)",
        "concordance_r2": best + ", cc as (select ds.marker_idx, count(*) as compared, avg((dosage = genotype)::int::double) as concordance, corr(dosage::double, genotype::double) as r from ds join gen using (sample_idx, marker_idx) where genotype is not null group by 1) select marker_idx, compared, round(concordance, 4) + 0.0 as concordance, round(case when r is null or isnan(r) then 0.0 else r * r end, 4) + 0.0 as r2 from cc",
    }
