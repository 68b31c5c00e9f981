"""Queries of the numbered problems tagged llm."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.llm.bpe import count_tokens, encode_texts
from tilewright.llm.components import connected_groups
from tilewright.llm.mojibake import find_garbled
from tilewright.llm.packing import pack_items
from tilewright.llm.sql import ORACLE
from tilewright.llm.topn import top_items
from tilewright.tables import table

__all__ = ["ORACLE", "QUERIES"]



def tokenizer_file(spark, name: str = "byte_bpe_50k.json") -> str:
    """A file of the public tokenizers, in the folder that spark.tilewright.tokenizers names."""
    return f"{spark.conf.get('spark.tilewright.tokenizers', '/opt/tokenizers')}/{name}"


def target_id(c):
    """The id in a FASTA header or what remains of one; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.col(c), r"^[ \t]+", ""), "^>", "")
    return F.nullif(F.regexp_extract(bare, r"^[^ \t]*", 0), F.lit(""))


def p2_found(spark, d):
    matches = table(spark, d, "target_similarity").where((F.col("identity_pct") >= 90.0) & ~F.isnan("identity_pct"))
    groups = connected_groups(matches.select(target_id("target_a").alias("a"), target_id("target_b").alias("b")), "a", "b")
    return groups.select("group_id", F.col("member").alias("target_id"))


def p5_found(spark, d):
    best = top_items(table(spark, d, "xreact_hits"), ["probe_id", "hit_mode"], "homology_pct", "target_id", "hit_id", 5)
    return best.select("probe_id", "hit_mode", F.col("item_rank").alias("hit_rank"), "hit_id")


def p5_best_hit(spark, d):
    best = top_items(table(spark, d, "xreact_hits"), ["probe_id", "hit_mode"], "homology_pct", "target_id", "hit_id", 1)
    return best.select("probe_id", "hit_mode", F.col("homology_pct").alias("max_homology_pct"), F.col("target_id").alias("best_hit"))


def p6_ids(spark, d):
    return encode_texts(table(spark, d, "documents"), tokenizer_file(spark))


def p7_containers(spark, d):
    packed = pack_items(count_tokens(table(spark, d, "documents"), tokenizer_file(spark)), capacity=2048)
    return packed.select("container_id", "doc_id", "piece_no", F.col("piece_start").alias("token_start"), F.col("piece_size").alias("n_tokens"))


def p8_found(spark, d):
    return find_garbled(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark, d):
    return find_garbled(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p5_found, p5_best_hit, p6_ids, p7_containers, p8_found, p8_restored)}
