"""Writing sequences, lists and tables as text. Numbers are formatted here and nowhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_fasta(df: DataFrame, path: str, seq_id: str = "seq_id", seq: str = "seq") -> None:
    """A record a row, in as many files as df has partitions."""
    df.select(F.concat(F.lit(">"), F.col(seq_id), F.lit("\n"), F.col(seq))).write.text(path)


def write_fastq(df: DataFrame, path: str, read_id: str = "read_id", seq: str = "seq", qual: str | None = None) -> None:
    """Four lines a row; where there is no quality, I for each base."""
    dummy = F.repeat(F.lit("I"), F.length(seq))
    quality = F.coalesce(F.col(qual), dummy) if qual else dummy
    df.select(F.concat(F.lit("@"), F.col(read_id), F.lit("\n"), F.col(seq), F.lit("\n+\n"), quality)).write.text(path)


def write_tsv(df: DataFrame, path: str, decimals: int = 4) -> None:
    """Tab-separated with a header; doubles with the given decimals, nulls empty, booleans true or false."""
    shown = [F.format_string(f"%.{decimals}f", F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    df.select(*[F.when(F.col(c).isNotNull(), s).alias(c) for c, s in zip(df.columns, shown)]).write.csv(path, sep="\t", header=True, quote="", escape="", nullValue="", emptyValue="")


def write_coverage(segments: DataFrame, path: str) -> None:
    """Depth intervals, 1-based with both ends, sorted over all files by reference and start."""
    segments.select("reference_id", (F.col("seg_start") + 1).alias("start"), F.col("seg_end").alias("end"), "depth").orderBy("reference_id", "start").write.csv(path, sep="\t", header=True)


def extract_by_ids(records: DataFrame, ids: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Records whose key is (or, without keep, is not) in ids."""
    return records.join(ids.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def write_sorted(df: DataFrame, path: str, by: list[str]) -> None:
    """Tab-separated without a header, in the order of by over all files: id lists, groups and maps."""
    df.orderBy(*by).write.csv(path, sep="\t", header=False, quote="", escape="", nullValue="", emptyValue="")


def concatenate(*records: DataFrame) -> DataFrame:
    """The records of several readers under each other; of columns that only some have, the others have nulls."""
    whole = records[0]
    for more in records[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    return whole


def write_params(spark: SparkSession, path: str, params: list[tuple[str, str, object]]) -> None:
    """(parameter, flag, value) of a run, in the order given; none for what wasn't given, and true or false for switches."""
    shown = [(name, flag, "none" if v is None else str(v).lower() if isinstance(v, bool) else str(v)) for name, flag, v in params]
    write_tsv(spark.createDataFrame(shown, "parameter string, flag string, value string").coalesce(1), path)
