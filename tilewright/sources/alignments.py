"""Reading SAM, PAF and BLAST files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.rejects import parse_hit_lines, rejects, valid_records


def _number(c: Column, kind: str = "bigint") -> Column:
    """A bad number counts as 0."""
    return F.coalesce(F.expr("null").cast(kind), c.try_cast(kind), F.lit(0).cast(kind))


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(aln_id, qname, flag, rname, pos, cigar, seq, md) of the alignment lines; lines of fewer than 11 fields are skipped.

    aln_id rises in file order.
    """
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("@")))
    f = lines.select(F.monotonically_increasing_id().alias("aln_id"), F.split("value", "\t").alias("f"), "value").where(F.size("f") >= 11)
    md = F.nullif(F.regexp_extract("value", r"\tMD:Z:([^\t]*)", 1), F.lit(""))
    return f.select("aln_id", F.col("f")[0].alias("qname"), _number(F.col("f")[1], "int").alias("flag"), F.col("f")[2].alias("rname"), _number(F.col("f")[3]).alias("pos"), F.col("f")[5].alias("cigar"), F.col("f")[9].alias("seq"), md.alias("md"))


def read_sam_references(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(reference_id, ref_length) of the @SQ lines."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("@SQ\t")))
    return lines.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("reference_id"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("long").alias("ref_length")).distinct()


def _hits(spark: SparkSession, path: str | list[str], line_format: str) -> DataFrame:
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("raw_line"), F.lit(line_format).alias("line_format"))
    return parse_hit_lines(lines)


def read_paf(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of PAF files."""
    parsed = _hits(spark, path, "paf")
    return valid_records(parsed, "paf"), rejects(parsed)


def read_blast(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of tabular BLAST files."""
    parsed = _hits(spark, path, "blast")
    return valid_records(parsed, "blast"), rejects(parsed)


def unify_hits(paf: DataFrame | None, blast: DataFrame | None) -> DataFrame:
    """PAF and BLAST records in one shape, query_start from 0: (query_name, target_name, query_length, query_start, query_end, matching_bases, block_length)."""
    names = ["query_name", "target_name", "query_length", "query_start", "query_end", "matching_bases", "block_length"]
    parts = []
    if paf is not None:
        parts.append(paf.select(names))
    if blast is not None:
        parts.append(blast.withColumn("query_start", F.greatest(F.col("query_start") - 1, F.lit(0))).withColumnRenamed("alignment_length", "block_length").select(names))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
