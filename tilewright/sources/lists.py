"""Reading id lists, maps, groups, weights and result tables."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("ord")).where((F.length("value") > 0) & ~F.startswith("value", F.lit("#")))


def _demand(cond: Column, what: str) -> Column:
    return F.when(cond, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.col("value"))).cast("boolean"))


def read_id_set(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id): first tokens, each once; # begins a comment."""
    return _lines(spark, path).select(F.split("value", r"\s+")[0].alias("seq_id")).distinct()


def read_pairs(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """(left, right): the first two tab-separated columns, a leading > taken off; a line with fewer is an error. Order and repeats stay."""
    f = _lines(spark, path).withColumn("f", F.split("value", "\t"))
    bare = lambda c: F.trim(F.regexp_replace(c, "^>", ""))
    return f.where(_demand(F.size("f") >= 2, "two columns are needed")).select(bare(F.col("f")[0]).alias(left), bare(F.col("f")[1]).alias(right), "ord")


def read_sample_target_map(spark: SparkSession, path: str) -> DataFrame:
    return read_pairs(spark, path, "genome_id", "target_id")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, group_name): a later line overrides an earlier one."""
    rows = read_pairs(spark, path, "seq_id", "group_name")
    return rows.groupBy("seq_id").agg(F.max_by("group_name", "ord").alias("group_name"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, weight): at least two tokens a line; a weight that is no number is an error."""
    f = _lines(spark, path).withColumn("f", F.split("value", r"\s+")).where(F.size("f") >= 2)
    return f.where(_demand(F.col("f")[1].try_cast("double").isNotNull(), "not a weight")).select(F.col("f")[0].alias("seq_id"), F.col("f")[1].cast("double").alias("weight"))


def read_detected(spark: SparkSession, path: str) -> DataFrame:
    """(reference_id, reads): a bad count is 0."""
    f = _lines(spark, path).withColumn("f", F.split("value", "\t"))
    return f.select(F.col("f")[0].alias("reference_id"), F.coalesce(F.get("f", F.lit(1)).try_cast("bigint"), F.lit(0)).cast("long").alias("reads"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header, columns found by name; rows with too few columns are left out."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="DROPMALFORMED", enforceSchema=False)


def parse_sample_tokens(tokens: Iterable[str]) -> list[tuple[str, float]]:
    """[(seq_id, weight)] of an inline sample such as `t1 2.5 t2`: a number weighs the id before it, 1 otherwise."""
    out: list[tuple[str, float]] = []
    fresh = False
    for token in tokens:
        try:
            weight = float(token)
        except ValueError:
            out.append((token, 1.0))
            fresh = True
            continue
        if not fresh:
            raise ValueError(f"a weight needs an id before it: {token}")
        out[-1] = (out[-1][0], weight)
        fresh = False
    if not out:
        raise ValueError("the sample is empty")
    return out


def link_by_prefix(genomes: DataFrame, targets: DataFrame, explicit: DataFrame) -> DataFrame:
    """(genome_id, target_id): the explicit links, and for genomes without any those to targets named like the genome or beginning with it and a bar.

    Each target is joined by its prefixes up to each bar, so the match is by equality.
    """
    open_genomes = genomes.select("genome_id").distinct().join(explicit.select("genome_id"), "genome_id", "left_anti")
    parts = F.split("target_id", r"\|")
    prefixes = targets.select("target_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "|"))).alias("genome_id"))
    return explicit.select("genome_id", "target_id").unionByName(prefixes.join(open_genomes, "genome_id").select("genome_id", "target_id").distinct())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, weight) of tab-separated lines, 1 where there is no weight; a later line overrides; a weight that is no number is an error."""
    f = _lines(spark, path).withColumn("f", F.split("value", "\t"))
    given = F.trim(F.get("f", F.lit(1)))
    rows = f.where(_demand(given.isNull() | given.try_cast("double").isNotNull(), "not a weight")).select(F.trim(F.col("f")[0]).alias("seq_id"), F.coalesce(given.try_cast("double"), F.lit(1.0)).alias("weight"), "ord")
    return rows.groupBy("seq_id").agg(F.max_by("weight", "ord").alias("weight"))


def resolve_sample(spark: SparkSession, tokens: list[str]) -> DataFrame:
    """(seq_id, weight): of a manifest if the only token names a file, else of the tokens themselves, where a later one overrides."""
    if len(tokens) == 1 and (os.path.isfile(tokens[0]) or "://" in tokens[0]):
        return read_manifest(spark, tokens[0])
    return spark.createDataFrame(list(dict(parse_sample_tokens(tokens)).items()), "seq_id string, weight double")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(probe_id, size) of cluster files: the representative, whose line ends in *, and the number of lines; clusters without one are left out.

    Files are cut into clusters by the reader; a cluster must fit a row.
    """
    text = spark.read.option("lineSep", "\n>Cluster").text(path).select("value", F.monotonically_increasing_id().alias("ord"))
    members = F.filter(F.split(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    chosen = F.get(F.filter(members, lambda x: F.rtrim(x).endswith(" *")), F.lit(0))
    named = F.regexp_extract(chosen, r", >(.*?)(?:\.\.\.|\s)", 1)
    found = text.select(F.nullif(named, F.lit("")).alias("probe_id"), F.size(members).cast("long").alias("size"), "ord").where(F.col("probe_id").isNotNull())
    return found.groupBy("probe_id").agg(F.max_by("size", "ord").alias("size"))
