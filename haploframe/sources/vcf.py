"""VCF and BCF files as DataFrames: headers, records, panels and targets; and the writers.

A marker's index is its place among the records that are read, in the order of files and lines; a region is cut out
before they are numbered. Files are read by the data sources of ``variants``: partitions count their records once, and
the counts (a row for each partition) are broadcast, so no record is shuffled. Files in stores that only Spark's readers
reach are read as text (or BCF as whole files); there each split counts its records in the same way. A record with fewer
sample fields than the header names is padded with missing calls; fields beyond them are left out (a header without names
bounds nothing).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MISSING, ImputationError
from ..functions.genotypes import call_genotype, likelihood_columns, parse_gt
from . import bcf, bgzf, variants

FIXED = 9
BCF = ".bcf"
SOURCE = "haploframe"


@dataclass(frozen=True)
class VcfHeader:
    sample_names: list[str]
    contigs: list[str]

    @property
    def num_samples(self) -> int:
        return len(self.sample_names)


def form_of(path: str) -> str:
    return "bcf" if path.endswith(BCF) else "vcf"


def read_header(spark: SparkSession, path: str) -> VcfHeader:
    """Contigs and sample names; the header of one file is what comes to the driver."""
    if bgzf.reachable(path):
        system, _ = bgzf.file_system(path)
        h = variants.header_of(system, [p for p, _ in bgzf.files_of(path)], form_of(path))
    elif path.endswith(BCF):
        h = bcf.parse_header(spark.read.format("binaryFile").load(path).mapInArrow(bcf_headers, "path string, text string").orderBy("path").first().text)
    else:
        h = bcf.parse_header("\n".join(r.value.rstrip("\r") for r in spark.read.text(path).filter(F.col("value").startswith("#")).collect()))
    if not h.samples and "#CHROM" not in h.text:
        raise ImputationError(f"{path} has no #CHROM line")
    return VcfHeader(h.samples, h.contigs)


def bcf_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch["path"].to_pylist(), batch["content"]):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([bcf.read_header(plain(data.as_py())).text])], ["path", "text"])


def plain(data: bytes) -> Iterator[bytes]:
    return bcf.inflated(iter([data])) if data[:2] == bgzf.MAGIC[:2] else iter([data])


def bcf_fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole BCF files to split records."""
    for batch in batches:
        for path, data in zip(batch["path"].to_pylist(), batch["content"]):
            data = data.as_py()
            header = bcf.read_header(plain(data))
            for fixed, cells in bcf.records(plain(data), header, header.size):
                f = [*fixed, ".", ".", "GT", *cells.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.list_(pa.string())), pa.array([path]), pa.array([0], pa.int64())], ["f", "file", "block"])


def numbered(rows: DataFrame) -> DataFrame:
    """Replaces file and block, the split a row was read from, by marker_idx, its place among all rows."""
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    # One small row for each split of the files.
    splits = rows.groupBy("file", "block").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    splits = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(splits), ["file", "block"]).withColumn("marker_idx", F.col("_at") + F.col("shift")).drop("file", "block", "_at", "shift")


def in_region(rows: DataFrame, where: str) -> DataFrame:
    """Split records (f) of a region."""
    place = rows.withColumns({"chrom": F.get("f", F.lit(0)), "pos": F.get("f", F.lit(1)).try_cast("long")})
    return region(place, where).drop("chrom", "pos")


def text_records(spark: SparkSession, path: str, strict: bool = True, where: str = "") -> DataFrame:
    """What records gives, by Spark's own readers."""
    samples = read_header(spark, path).num_samples
    if path.endswith(BCF):
        rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(bcf_fields, "f array<string>, file string, block long")
        return parse_fields(numbered(in_region(rows, where)), samples)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    f = F.split(F.rtrim(F.regexp_replace("value", "\r$", "")), "\t")
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(f.alias("f"), "file", "block")
    if not strict:
        rows = rows.filter(F.size("f") >= FIXED)
    return parse_fields(numbered(in_region(rows, where)), samples)


def panel_rows(spark: SparkSession, path: str, where: str = "", split: int = variants.SPLIT) -> DataFrame:
    """The wide panel (see wide_panel) of a file."""
    if not bgzf.reachable(path):
        return wide_panel(text_records(spark, path, where=where))
    return markers(records(spark, path, where=where, split=split, wide="panel").withColumnRenamed("cells", "alleles"), "alleles")


def target_rows(spark: SparkSession, path: str, where: str = "", split: int = variants.SPLIT) -> DataFrame:
    """The columns of markers and calls (see wide_targets) of a file."""
    if not bgzf.reachable(path):
        rows = text_records(spark, path, where=where)
        return markers(rows.withColumn("calls", call_bytes("fields")), "calls")
    return markers(records(spark, path, where=where, split=split, wide="targets").withColumnRenamed("cells", "calls"), "calls")


def records(spark: SparkSession, path: str, strict: bool = True, where: str = "", split: int = variants.SPLIT, wide: str = "") -> DataFrame:
    """marker_idx, chrom, pos, id, ref, alt (array), qual and fields, the samples' texts, of the records in a region (see region), all without one. strict: a line with fewer than nine fields is an error, else it is left out. split: bytes of a file that a task reads. wide: cells as bytes in place of fields, see variants.WIDE."""
    if not bgzf.reachable(path):
        return text_records(spark, path, strict, where)
    variants.register(spark)
    options = {"path": path, "strict": str(strict).lower(), "region": where, "split": str(split), "wide": wide}
    parts = len(variants.VariantReader(options, form_of(path)).partitions())
    source = spark.read.format(form_of(path)).options(**options)
    rows = source.load()
    if parts == 1:
        numbers = F.col("row")
    else:
        counts = dict(spark.read.format(form_of(path)).options(**options, counts="true").load().collect())
        before = [0]
        for k in range(parts - 1):
            before.append(before[-1] + counts.get(k, 0))
        first = spark.createDataFrame(list(enumerate(before)), "part int, before long")
        rows, numbers = rows.join(F.broadcast(first), "part"), F.col("before") + F.col("row")
    return rows.select(numbers.cast("int").alias("marker_idx"), "chrom", "pos", "id", "ref", "alt", "qual", "cells" if wide else "fields")


def parse_fields(rows: DataFrame, samples: int | None = None) -> DataFrame:
    """Typed columns of split records (f, marker_idx), with so many sample fields if their number is given and not 0."""
    ok = F.size("f") >= FIXED
    get = lambda i: F.get("f", F.lit(i))
    fields = F.slice("f", FIXED + 1, F.greatest(F.size("f") - FIXED, F.lit(0)))
    if samples:
        missing = F.greatest(F.lit(samples + FIXED) - F.size("f"), F.lit(0))
        fields = F.when(F.size("f") == samples + FIXED, fields).otherwise(F.slice(F.concat(fields, F.array_repeat(F.lit("."), missing)), 1, samples))
    return rows.select(
        F.when(ok, F.col("marker_idx")).otherwise(F.raise_error(F.lit("a record has fewer than nine fields"))).cast("int").alias("marker_idx"),
        get(0).alias("chrom"), get(1).cast("long").alias("pos"), get(2).alias("id"), get(3).alias("ref"), F.split(get(4), ",").alias("alt"),
        F.when(get(5) == ".", 0.0).otherwise(get(5).try_cast("double")).alias("qual"), fields.alias("fields"),
    )


def region(df: DataFrame, text: str) -> DataFrame:
    """Rows of chrom or chrom:start or chrom:start-end, both ends included; all for an empty text. On Parquet the filter reaches the scan."""
    found = variants.region_of(text)
    if found is None:
        return df
    chrom, low, high = found
    df = df.filter(F.col("chrom") == chrom)
    if low > 0:
        df = df.filter(F.col("pos") >= low)
    return df.filter(F.col("pos") <= high) if high < variants.LAST else df


def markers(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("marker_idx", "chrom", "pos", "id", "ref", F.get("alt", F.lit(0)).alias("alt"), F.lit(0.0).alias("cm"), *more)


def panel_alleles(rows: DataFrame) -> DataFrame:
    """marker_idx, hap_idx, allele: a one-allele call stands for both haplotypes."""
    s = rows.select("marker_idx", F.posexplode("fields").alias("s", "x")).withColumn("gt", parse_gt(F.col("x")))
    pair = F.array(F.get("gt", F.lit(0)), F.when(F.size("gt") > 1, F.get("gt", F.lit(1))).otherwise(F.get("gt", F.lit(0))))
    return s.select("marker_idx", "s", F.posexplode(pair).alias("phase", "allele")).select("marker_idx", (2 * F.col("s") + F.col("phase")).alias("hap_idx"), F.col("allele").cast("int").alias("allele"))


def wide_panel(rows: DataFrame) -> DataFrame:
    """The columns of markers and alleles, a byte for each haplotype, 255 for a missing one."""
    x2 = lambda a: F.lpad(F.hex(F.coalesce(a.cast("int"), F.lit(MISSING))), 2, "0")
    digit = lambda x, i: F.when(F.substring(x, i, 1) == ".", "FF").otherwise(F.concat(F.lit("0"), F.substring(x, i, 1)))

    def pair(x: Column) -> Column:
        gt = parse_gt(x)
        second = F.when(F.size(gt) > 1, F.get(gt, F.lit(1))).otherwise(F.get(gt, F.lit(0)))
        return F.when(x.rlike(r"^[0-9.][|/][0-9.](:|$)"), F.concat(digit(x, 1), digit(x, 3))).otherwise(F.concat(x2(F.get(gt, F.lit(0))), x2(second)))

    # Records of plain calls only, one digit or dot each, are turned into hexadecimal digits as a whole.
    joined = F.array_join("fields", "")
    plain = (F.length(joined) == 3 * F.size("fields")) & (F.regexp_replace(joined, r"[0-9.][|/][0-9.]", "") == "")
    whole = F.replace(F.regexp_replace(F.translate(joined, "|/", ""), r"([0-9])", "0$1"), F.lit("."), F.lit("FF"))
    return markers(rows.withColumn("alleles", F.unhex(F.when(plain, whole).otherwise(F.array_join(F.transform("fields", pair), "")))), "alleles")


def target_likelihoods(rows: DataFrame) -> DataFrame:
    """sample_idx, marker_idx, ll_00, ll_01, ll_11 of hard calls."""
    s = rows.select("marker_idx", F.posexplode("fields").alias("sample_idx", "x")).withColumn("g", call_genotype(parse_gt(F.col("x"))))
    return s.select("sample_idx", "marker_idx", *likelihood_columns(F.col("g")))


def call_bytes(fields: str) -> Column:
    """A byte for each sample: its call's two alleles as halves, 15 for one that is missing or not below 10; a call of one allele is missing."""
    half = lambda a: F.when(a < 10, a.cast("string")).otherwise("F")

    def pair(x: Column) -> Column:
        gt = parse_gt(x)
        return F.when(F.size(gt) > 1, F.concat(half(F.get(gt, F.lit(0))), half(F.get(gt, F.lit(1))))).otherwise("FF")

    # Records of plain calls only are turned into hexadecimal digits as a whole, as in wide_panel.
    joined = F.array_join(fields, "")
    plain = (F.length(joined) == 3 * F.size(fields)) & (F.regexp_replace(joined, r"[0-9.][|/][0-9.]", "") == "")
    return F.unhex(F.when(plain, F.translate(joined, ".|/", "F")).otherwise(F.array_join(F.transform(fields, pair), "")))


def wide_targets(rows: DataFrame) -> DataFrame:
    """marker_idx and calls, see call_bytes."""
    return rows.select("marker_idx", call_bytes("fields").alias("calls"))


def save_panel(spark: SparkSession, alleles: DataFrame, marks: DataFrame, path: str) -> None:
    """A panel as Parquet, by marker."""
    alleles.repartitionByRange("marker_idx").sortWithinPartitions("marker_idx", "hap_idx").write.parquet(f"{path}/alleles")
    marks.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.parquet(f"{path}/markers")


def load_panel(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/alleles"), spark.read.parquet(f"{path}/markers")


def header_lines(samples: list[str], contigs: list[str]) -> list[str]:
    # Fixed values of the format.
    return [
        "##fileformat=VCFv4.2",
        f"##source={SOURCE}",
        *(f"##contig=<ID={c}>" for c in contigs),
        '##INFO=<ID=IMP,Number=0,Type=Flag,Description="Imputed variant">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        '##FORMAT=<ID=DS,Number=1,Type=Float,Description="Dosage (expected ALT allele count)">',
        '##FORMAT=<ID=GP,Number=G,Type=Float,Description="Genotype posterior probabilities">',
        '##FORMAT=<ID=AP,Number=2,Type=Float,Description="Allelic probabilities">',
        "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]),
    ]


def cell_rows(calls: DataFrame, marks: DataFrame, text: Column, form: str) -> DataFrame:
    """marker_idx, line: a record of each marker with the text of each cell (sample_idx, marker_idx) in the order of samples."""
    cells = calls.groupBy("marker_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", text.alias("x")))), lambda c: c["x"]).alias("cells"))
    m = marks.select("marker_idx", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.when(F.coalesce("id", F.lit("")) == "", ".").otherwise(F.col("id")), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("IMP"), F.lit(form)).alias("head"))
    return m.join(cells, "marker_idx").select("marker_idx", F.concat_ws("\t", "head", F.array_join("cells", "\t")).alias("line"))


def phased_rows(calls: DataFrame, marks: DataFrame) -> DataFrame:
    """marker_idx, line: one GT row per marker of calls (sample_idx, marker_idx, hap0, hap1)."""
    gt = F.when(F.col("hap0").isNull() | F.col("hap1").isNull(), "./.").otherwise(F.concat_ws("|", F.col("hap0").cast("string"), F.col("hap1").cast("string")))
    return cell_rows(calls, marks, gt, "GT")


def probability_rows(calls: DataFrame, marks: DataFrame, dosage: bool = True) -> DataFrame:
    """marker_idx, line: rows of GT, DS if asked for, and GP from p0, p1, p2 (and ds); the first greatest probability calls."""
    gp = F.array("p0", "p1", "p2")
    best = F.array_position(gp, F.array_max(gp)) - 1
    gt = F.get(F.array(F.lit("0|0"), F.lit("0|1"), F.lit("1|1")), best.cast("int"))
    fixed = lambda c: F.format_string("%.4f", c)
    parts = [gt, *([fixed(F.col("ds"))] if dosage else []), F.concat_ws(",", *(fixed(F.col(c)) for c in ("p0", "p1", "p2")))]
    return cell_rows(calls, marks, F.concat_ws(":", *parts), "GT:DS:GP" if dosage else "GT:GP")


def write_vcf(rows: DataFrame, path: str, samples: list[str], contigs: list[str], compression: str = "none") -> None:
    """A folder of text parts in marker order, the header in the first of them. Compressed with compression="gzip"."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(-len(x) + i, s) for x in [header_lines(samples, contigs)] for i, s in enumerate(x)], "marker_idx long, line string")
    both = head.unionByName(rows.select(F.col("marker_idx").cast("long").alias("marker_idx"), "line"))
    both.repartitionByRange("marker_idx").sortWithinPartitions("marker_idx").select(F.col("line").alias("value")).write.option("compression", compression).text(path)


def save_vcf(rows: DataFrame, path: str, samples: list[str], contigs: list[str]) -> None:
    """One blocked file in marker order with an index beside it: a BCF if the name says so, else a VCF. rows: marker_idx, line."""
    variants.register(rows.sparkSession)
    lines = rows.repartitionByRange("marker_idx").sortWithinPartitions("marker_idx").select("line")
    lines.write.format(form_of(path)).option("header", "\n".join(header_lines(samples, contigs)) + "\n").mode("append").save(path)
