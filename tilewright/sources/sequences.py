"""Reading FASTA and FASTQ files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str | list[str], unique: bool = True) -> DataFrame:
    """(seq_id, header, seq, file, ord): records of FASTA files, sequences joined over their lines and in upper case.

    The id is the header's first token. With unique, of records with one id the last in file
    order stays. ord rises within a file. Files are cut into records by the reader, so a
    large file is read by many tasks; a record must fit a row.
    """
    text = spark.read.option("lineSep", "\n>").text(path)
    rows = text.select(F.col("value"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ord"))
    lines = F.split(F.regexp_replace(F.col("value"), r"^[\r\n]*>", ""), r"\r?\n", 2)
    header = F.trim(F.element_at(lines, 1))
    seq = F.upper(F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s+", ""))
    records = rows.where(F.length(F.trim("value")) > 0).select(F.split(header, r"\s+", 2)[0].alias("seq_id"), header.alias("header"), seq.alias("seq"), "file", "ord")
    if not unique:
        return records
    last = records.groupBy("seq_id").agg(F.max(F.struct("file", "ord", "header", "seq")).alias("r"))
    return last.select("seq_id", "r.header", "r.seq", "r.file", "r.ord")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): the lines of text files, counted from 0 in each file.

    Lines of a split are numbered where they are read; the splits' line counts, one row
    each, are summed up in the order of their places in the file. Nothing is sorted.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as splits
    splits = read.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return read.join(splits, ["file", "block"]).select("file", (F.col("offset") + F.col("mid") - F.col("first")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(read_id, seq, qual, file, ord): four-line records of FASTQ files; ord counts a file's reads from 0.

    A quality line may begin like a header, so only the count of lines tells them apart:
    lines are numbered over the splits of each file, and every four make a record, on all
    tasks. A record that is cut off, has no + line, or a quality of another length is an
    error. Empty lines at the end of a file don't count.
    """
    lines = numbered_lines(spark, path)
    last = lines.where(F.length("value") > 0).groupBy("file").agg(F.max("line").alias("last"))
    kept = lines.join(last, "file").where(F.col("line") <= F.col("last"))
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    records = kept.groupBy("file", F.floor(F.col("line") / 4).alias("ord")).agg(F.count(F.lit(1)).alias("n"), *[part(k).alias(c) for k, c in enumerate(("head", "seq", "plus", "qual"))])
    sound = F.startswith("head", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.length("seq") == F.length("qual"))
    fault = F.when(F.col("n") < 4, F.concat(F.lit("truncated FASTQ record at the end of "), F.col("file"))).when(~sound, F.concat(F.lit("broken FASTQ record "), F.col("ord").cast("string"), F.lit(" in "), F.col("file")))
    checked = records.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))
    return checked.select(F.regexp_extract("head", r"^@\s*(\S*)", 1).alias("read_id"), F.upper("seq").alias("seq"), "qual", "file", "ord")


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """FASTQ where the first byte is @, FASTA otherwise, with null quality: (read_id, seq, qual, file, ord)."""
    first = spark.read.text(path).where(F.length("value") > 0).limit(1).collect()
    if first and first[0]["value"].startswith("@"):
        return read_fastq(spark, path)
    return read_fasta(spark, path, unique=False).select(F.col("seq_id").alias("read_id"), "seq", F.lit(None).cast("string").alias("qual"), "file", "ord")


def demand_reads(reads: DataFrame, fragments: DataFrame, made_by: str) -> DataFrame:
    """reads, or an error if there are none: that nothing came out is never a result."""
    if reads.isEmpty():
        what = "no fragments went in" if fragments.isEmpty() else "fragments went in, but the coverage asked for is too thin for any read"
        raise ValueError(f"{made_by} gave no reads: {what}")
    return reads
