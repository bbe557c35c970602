"""Readers and writers of the input and result formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.genome import chromosome_number

VCF_SCHEMA = "chr string, pos long, x string, ref string, alt string, y string, z string, a string, b string, hap string"
COVERAGE_SCHEMA = "chr string, start long, end long, covcorr double, mean_frag_len double, std_frag_len double, num_frags long, tot_reads long, fail_reads long"
#: Places of the call-statistics columns that are used, and their names.
CALLSTATS = {0: "chr", 1: "pos", 3: "ref", 4: "alt", 15: "total_reads", 16: "mapq0_reads", 25: "t_refcount", 26: "t_altcount", 37: "n_refcount", 38: "n_altcount"}
SEGMENT_COLUMNS = {
    "chr": "Chromosome", "start_bp": "Start.bp", "end_bp": "End.bp", "num_bins": "num_bins",
    "mu_major": "mu.major", "sigma_major": "sigma.major", "mu_minor": "mu.minor", "sigma_minor": "sigma.minor",
}
ABSOLUTE_COLUMNS = {
    "chr": "Chromosome", "start_bp": "Start.bp", "end_bp": "End.bp", "n_probes": "n_probes", "length": "length", "n_hets": "n_hets", "f": "f", "tau": "tau",
    "sigma_tau": "sigma.tau", "mu_minor": "mu.minor", "sigma_minor": "sigma.minor", "mu_major": "mu.major", "sigma_major": "sigma.major", "seg_label_cnloh": "SegLabelCNLOH",
}


def tsv(spark: SparkSession, path: str | list[str], schema: str, comment: str | None = None, header: bool = False) -> DataFrame:
    reader = spark.read.schema(schema).option("sep", "\t").option("header", header).option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def phased_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Headerless phased calls; columns of one letter are dropped."""
    rows = tsv(spark, path, VCF_SCHEMA, comment="#")
    return rows.select([c for c in rows.columns if len(c) > 1]).withColumn("chr", chromosome_number(F.col("chr")))


def readbacked_vcf(spark: SparkSession, path: str) -> DataFrame:
    """As phased calls, with the phase set ``ps`` that ends the haplotype."""
    rows = phased_vcf(spark, path)
    return rows.withColumn("ps", F.expr("try_cast(regexp_extract(hap, ':([0-9]+)', 1) as bigint)"))


def allele_counts(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(chr, pos, ref_count, alt_count), counts named with ``suffix``."""
    rows = tsv(spark, path, "CONTIG string, POSITION long, REF_COUNT double, ALT_COUNT double", header=True)
    return rows.select(chromosome_number(F.col("CONTIG")).alias("chr"), F.col("POSITION").alias("pos"), F.col("REF_COUNT").alias(f"ref_count{suffix}"), F.col("ALT_COUNT").alias(f"alt_count{suffix}"))


def cytoband(spark: SparkSession, path: str) -> DataFrame:
    """Bands with or without a header line."""
    rows = tsv(spark, path, "chr string, start long, end long, band string, stain string")
    return rows.filter("start is not null").withColumn("chr", chromosome_number(F.col("chr"))).filter("chr > 0")


def coverage_bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Coverage bins of one file or of many shards; every row has nine fields."""
    lines = spark.read.text(paths)
    parts = F.split("value", "\t")
    checked = lines.select(F.when(F.size(parts) == 9, parts).otherwise(F.raise_error(F.concat(F.lit("a coverage row has not nine fields: "), F.col("value")))).alias("p"))
    kinds = [f.split(" ") for f in COVERAGE_SCHEMA.split(", ")]
    return checked.select([F.col("p")[k].cast(kind).alias(name) for k, (name, kind) in enumerate(kinds)])


def covariate_bed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(chr, start, end, C_name): a track of a signal by interval."""
    rows = tsv(spark, path, f"chr string, start long, end long, C_{name} double")
    return rows.withColumn("chr", chromosome_number(F.col("chr"))).filter("chr > 0")


def callstats(spark: SparkSession, path: str) -> DataFrame:
    """Call statistics: comment and header lines left out, used columns typed."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & ~F.col("value").startswith("contig"))
    parts = F.split("value", "\t")
    return lines.select([(parts[k].cast("long") if k not in (0, 3, 4) else parts[k]).alias(n) for k, n in CALLSTATS.items()])


def gatk_allelic_counts(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, "CONTIG string, POSITION long, REF_COUNT long, ALT_COUNT long, REF_NUCLEOTIDE string, ALT_NUCLEOTIDE string", comment="@", header=True)


def header_lines(spark: SparkSession, path: str, mark: str = "@") -> DataFrame:
    """The comment lines that precede a table, to be put before a new one."""
    return spark.read.text(path).filter(F.col("value").startswith(mark))


def fragment_counts(spark: SparkSession, path: str) -> DataFrame:
    """Read counts by interval, staged as Parquet."""
    return spark.read.schema("contig string, start long, end long, count double").parquet(path)


def per_chromosome(spark: SparkSession, pattern: str, schema: str, chromosome: str = r"chr([0-9XY]+)") -> DataFrame:
    """Files of one table each, their chromosome taken from the file's name."""
    return tsv(spark, pattern, schema).withColumn("chr", chromosome_number(F.regexp_extract(F.input_file_name(), chromosome, 1)))


def natural_key(path: str) -> list:
    """Sorts names by the numbers in them."""
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", path)]


def listed_results(spark: SparkSession, listing: str) -> DataFrame:
    """Parquet results named in a file, a path a line; ``nan`` lines skipped."""
    paths = [r.value.strip() for r in spark.read.text(listing).collect()]
    return spark.read.parquet(*sorted((p for p in paths if p and p != "nan"), key=natural_key))


def gc_content(bins: DataFrame, sequence: DataFrame) -> DataFrame:
    """``bins`` with ``C_GC``: share of G and C in [start, end] of each bin.

    ``sequence``: (chr, at, bases), pieces of equal width that begin at
    multiples of it. Bins meet the pieces they touch; counts add up.
    """
    width = sequence.agg(F.max(F.length("bases"))).first()[0] or 1
    touched = bins.select("chr", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("__piece"))
    pieces = sequence.select("chr", F.floor(F.col("at") / width).alias("__piece"), "at", "bases")
    cut = F.substring(F.col("bases"), F.greatest(F.col("start") - F.col("at"), F.lit(0)).cast("int") + 1, (F.least(F.col("end") - F.col("at") + 1, F.lit(width)) - F.greatest(F.col("start") - F.col("at"), F.lit(0))).cast("int"))
    counted = touched.join(pieces, ["chr", "__piece"]).select("chr", "start", "end", F.length(cut).alias("n"), F.length(F.regexp_replace(cut, "[^GCgc]", "")).alias("gc"))
    share = counted.groupBy("chr", "start", "end").agg((F.sum("gc") / F.sum("n")).alias("C_GC"))
    return bins.join(share, ["chr", "start", "end"], "left")


def fasta_pieces(spark: SparkSession, path: str, width: int = 1 << 16) -> DataFrame:
    """(chr, at, bases) from FASTA, in pieces of ``width``.

    Lines are numbered by file order within each sequence, which takes files
    of one sequence each, as assemblies are laid out.
    """
    lines = spark.read.option("wholetext", False).text(path).withColumn("__line", F.monotonically_increasing_id()).withColumn("__file", F.input_file_name())
    names = lines.filter(F.col("value").startswith(">")).select("__file", chromosome_number(F.regexp_extract("value", r"^>(?:chr)?(\S+)", 1)).alias("chr"))
    w = Window.partitionBy("__file").orderBy("__line").rowsBetween(Window.unboundedPreceding, -1)
    bases = lines.filter(~F.col("value").startswith(">")).withColumn("__at", F.coalesce(F.sum(F.length("value")).over(w), F.lit(0)))
    placed = bases.withColumn("__piece", F.floor(F.col("__at") / width))
    # a line that crosses a boundary is cut in two
    left = placed.select("__file", "__piece", "__at", F.expr(f"substring(value, 1, cast((__piece + 1) * {width} - __at as int))").alias("v"))
    right = placed.filter(F.col("__at") + F.length("value") > (F.col("__piece") + 1) * width)
    right = right.select("__file", (F.col("__piece") + 1).alias("__piece"), ((F.col("__piece") + 1) * width).alias("__at"), F.expr(f"substring(value, cast((__piece + 1) * {width} - __at as int) + 1)").alias("v"))
    pieces = left.union(right).groupBy("__file", "__piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "v"))), lambda x: x["v"]), "").alias("bases"))
    return pieces.join(names, "__file").select("chr", (F.col("__piece") * width).alias("at"), "bases")


def write_segments(segments: DataFrame, path: str, columns: dict[str, str] = SEGMENT_COLUMNS) -> None:
    """Tab-separated with a header, in genome order, under the format's names."""
    ordered = segments.orderBy("chr", "start_bp").select([F.col(c).alias(n) for c, n in columns.items()])
    ordered.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_segments(spark: SparkSession, path: str, columns: dict[str, str] = SEGMENT_COLUMNS) -> DataFrame:
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    kind = lambda c: "long" if c in ("chr", "start_bp", "end_bp", "num_bins", "n_probes", "length", "n_hets", "seg_label_cnloh") else "double"
    return rows.select([F.col(f"`{n}`").cast(kind(c)).alias(c) for c, n in columns.items()])


def none_if_nan(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c)).alias(c)
