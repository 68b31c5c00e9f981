"""From mapped reads to detection: counts, groups, confusion metrics, detail tables.

References come as (reference_id, group_name, category) with categories sample,
nonsample_target, distractor, untargeted; a reference without a group is its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.alignment import SECONDARY, SUPPLEMENTARY
from tilewright.functions.sequence import source_id
from tilewright.operators.skew import range_split_aggregate


def read_mappings(alns: DataFrame) -> DataFrame:
    """(qname, reference_id): each read's first primary alignment on a reference, by aln_id.

    The first row of a read is an aggregate, so a name that occurs on very many rows is
    reduced before it is shuffled.
    """
    flag = F.coalesce("flag", F.lit(0)).bitwiseAND(F.lit(SECONDARY | SUPPLEMENTARY))
    rows = alns.where((F.col("rname") != "*") & (flag == 0) & F.col("qname").isNotNull())
    return rows.groupBy("qname").agg(F.min(F.struct("aln_id", "rname")).alias("first")).select("qname", F.col("first.rname").alias("reference_id"))


def reads_per_reference(alns: DataFrame) -> DataFrame:
    """(reference_id, reads), by the range-split aggregation."""
    return reads_of_mappings(read_mappings(alns))


def reads_of_mappings(mappings: DataFrame) -> DataFrame:
    """(reference_id, reads) of read_mappings."""
    return range_split_aggregate(mappings, ["reference_id"], ["qname"], {"reads": F.count(F.lit(1))})


def fragments_per_source(mappings: DataFrame) -> DataFrame:
    """(source_id, fragments) of read_mappings; reads without a source in their name don't count."""
    return mappings.select(source_id("qname").alias("source_id")).where("source_id IS NOT NULL").groupBy("source_id").agg(F.count(F.lit(1)).alias("fragments"))


def renamed_reads(names: DataFrame, alns: DataFrame) -> DataFrame:
    """(qname, source_id): what each read is to be called after: the reference of its first primary alignment, else the source in its name, else its bare name.

    names (qname); a mate's /1 or /2 is taken off before the lookup.
    """
    bare = lambda c: F.regexp_replace(c, "/[12]$", "")
    flag = F.coalesce("flag", F.lit(0)).bitwiseAND(F.lit(SECONDARY | SUPPLEMENTARY))
    first = alns.where((F.col("rname") != "*") & (flag == 0) & F.col("qname").isNotNull()).groupBy(bare("qname").alias("bare")).agg(F.min(F.struct("aln_id", "rname")).alias("f")).select("bare", F.col("f.rname").alias("mapped"))
    own = names.select("qname").dropna().distinct().withColumn("bare", bare("qname"))
    return own.join(first, "bare", "left").select("qname", F.coalesce("mapped", source_id("qname"), "bare").alias("source_id"))


def mapped_read_ids(alns: DataFrame) -> DataFrame:
    """(qname): reads with any alignment on a reference, secondary ones too."""
    return alns.where(F.col("rname") != "*").select("qname").dropna().distinct()


def with_groups(refs: DataFrame) -> DataFrame:
    return refs.select("reference_id", F.coalesce("group_name", "reference_id").alias("group_name"), "category")


def category_counts(names: DataFrame, refs: DataFrame) -> DataFrame:
    """(category, n): fragments by what their source is; names (qname)."""
    sources = names.select(source_id("qname").alias("reference_id")).where(F.col("reference_id").isNotNull()).groupBy("reference_id").agg(F.count(F.lit(1)).alias("n"))
    known = sources.join(refs.select("reference_id", "category"), "reference_id", "left")
    return known.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.sum("n").alias("n"))


def mapping_accuracy(mappings: DataFrame, refs: DataFrame) -> DataFrame:
    """One row (reads_correctly_mapped, reads_incorrectly_mapped): whether a read maps to the group that it stems from.

    Targets map to their groups; any other id is a group of its own. Reads are first counted
    per source and reference, so that the joins see each such pair once.
    """
    target = with_groups(refs).where(F.col("category").isin("sample", "nonsample_target"))
    side = lambda name: target.select(F.col("reference_id").alias(name), F.col("group_name").alias(f"{name}_group"))
    pairs = mappings.select(source_id("qname").alias("source"), F.col("reference_id").alias("mapped")).where(F.col("source").isNotNull()).groupBy("source", "mapped").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.join(side("source"), "source", "left").join(side("mapped"), "mapped", "left")
    same = F.coalesce("source_group", "source") == F.coalesce("mapped_group", "mapped")
    add = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return both.agg(add(same).alias("reads_correctly_mapped"), add(~same).alias("reads_incorrectly_mapped"))


def group_detail(detected: DataFrame, refs: DataFrame) -> DataFrame:
    """One row for each target group and each distractor group; a group with a sample member is expected."""
    known = with_groups(refs).where(F.col("category").isin("sample", "nonsample_target", "distractor")).withColumn("side", F.when(F.col("category") == "distractor", "distractor").otherwise("target"))
    members = known.join(detected.select("reference_id", "reads"), "reference_id", "left")
    groups = members.groupBy("side", "group_name").agg(F.max((F.col("category") == "sample").cast("int")).alias("is_sample"), F.count(F.lit(1)).alias("member_count"), F.count("reads").alias("detected_member_count"), F.coalesce(F.sum("reads"), F.lit(0)).cast("long").alias("total_reads"))
    hit, sample = F.col("detected_member_count") > 0, F.col("is_sample") == 1
    classification = F.when(F.col("side") == "distractor", F.when(hit, "FP_distractor").otherwise("TN_distractor")).when(sample, F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit, "FP_target").otherwise("TN_target"))
    category = F.when(sample, "sample").otherwise(F.col("side"))
    return groups.select("group_name", category.alias("category"), sample.alias("expected"), hit.alias("detected"), classification.alias("classification"), "member_count", "detected_member_count", "total_reads")


def confusion_metrics(groups: DataFrame) -> DataFrame:
    """One row of counts and rates from group_detail; a rate over nothing is 0."""
    n = lambda c: F.count(F.when(F.col("classification") == c, 1))
    counts = groups.agg(n("TP").alias("tp_count"), n("FN").alias("fn_count"), n("FP_target").alias("fp_target_count"), n("FP_distractor").alias("fp_distractor_count"), n("TN_target").alias("tn_target_count"), n("TN_distractor").alias("tn_distractor_count"))
    counts = counts.withColumn("fp_total", F.col("fp_target_count") + F.col("fp_distractor_count")).withColumn("tn_total", F.col("tn_target_count") + F.col("tn_distractor_count"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fn, fp, tn = (F.col(c) for c in ("tp_count", "fn_count", "fp_total", "tn_total"))
    rates = counts.withColumn("sensitivity", rate(tp, tp + fn)).withColumn("specificity", rate(tn, tn + fp)).withColumn("precision", rate(tp, tp + fp))
    s, p = F.col("sensitivity"), F.col("precision")
    return rates.withColumn("f1_score", rate(2.0 * p * s, p + s))


#: Order of classes in detail tables.
CLASS_ORDER = ("TP", "FP_target", "FP_distractor", "UNKNOWN", "FN", "untargeted")


def detail_rows(detected: DataFrame, refs: DataFrame, generated: DataFrame, coverage: DataFrame) -> DataFrame:
    """Detected references, undetected members of missed sample groups, and untargeted references, each with its reads and coverage.

    detected (reference_id, reads); generated (reference_id, fragments); coverage as coverage_stats gives it.
    """
    known = with_groups(refs)
    hits = detected.join(known, "reference_id", "left").select("reference_id", F.coalesce("group_name", "reference_id").alias("group_name"), "category", F.lit(True).alias("detected"), F.col("reads").alias("reads_assigned"))
    hits = hits.withColumn("classification", F.when(F.col("category") == "sample", "TP").when(F.col("category") == "nonsample_target", "FP_target").when(F.col("category") == "distractor", "FP_distractor").otherwise("UNKNOWN")).where(~F.col("category").eqNullSafe("untargeted"))
    missed = group_detail(detected, refs).where("classification = 'FN'").select("group_name")
    absent = known.where("category = 'sample'").join(missed, "group_name", "left_semi").withColumn("classification", F.lit("FN")).unionByName(known.where("category = 'untargeted'").withColumn("classification", F.lit("untargeted")))
    reads = detected.select("reference_id", "reads")
    absent = absent.join(reads, "reference_id", "left").select("reference_id", "group_name", "category", F.col("reads").isNotNull().alias("detected"), F.coalesce("reads", F.lit(0)).cast("long").alias("reads_assigned"), "classification")
    rows = hits.unionByName(absent).join(generated, "reference_id", "left").join(coverage, "reference_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rows.select("reference_id", "group_name", F.coalesce("category", F.lit("unknown")).alias("category"), "detected", F.coalesce("fragments", F.lit(0)).cast("long").alias("fragments_generated"), "reads_assigned", "classification", F.coalesce("ref_length", F.lit(0)).cast("long").alias("ref_length"), zero("avg_coverage"), zero("pct_covered_5x"), zero("pct_covered_20x"))


def ordered_detail(rows: DataFrame) -> DataFrame:
    """detail_rows in their order for people: by class, then most reads first."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CLASS_ORDER]), F.col("classification"))
    return rows.orderBy(F.when(rank > 0, rank).otherwise(len(CLASS_ORDER) + 1), F.desc("reads_assigned"), "reference_id")


def classify_by_genome(names: DataFrame, genomes: DataFrame, links: DataFrame) -> DataFrame:
    """(qname, fragment_class): what the genome that a fragment stems from is.

    genomes (genome_id, category); links (genome_id, target_id), any number for either. A
    sample genome without a target is untargeted; an unlisted genome is unknown.
    """
    known = genomes.select("genome_id", "category").join(links.select("genome_id").distinct().withColumn("linked", F.lit(1)), "genome_id", "left")
    kind = F.when((F.col("category") == "sample") & F.col("linked").isNull(), "untargeted").otherwise(F.coalesce("category", F.lit("unknown")))
    sources = names.select("qname", source_id("qname").alias("genome_id")).where(F.col("genome_id").isNotNull())
    return sources.join(known, "genome_id", "left").select("qname", kind.alias("fragment_class"))


def accuracy_by_genome(mappings: DataFrame, links: DataFrame) -> DataFrame:
    """One row as mapping_accuracy gives it: a read is right if its genome is linked to the target that it maps to, and wrong if not, also where its genome has no target."""
    pairs = mappings.select(source_id("qname").alias("genome_id"), F.col("reference_id").alias("target_id")).where(F.col("genome_id").isNotNull()).groupBy("genome_id", "target_id").agg(F.count(F.lit(1)).alias("n"))
    seen = pairs.join(links.select("genome_id", "target_id").distinct().withColumn("linked", F.lit(1)), ["genome_id", "target_id"], "left")
    add = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return seen.agg(add(F.col("linked").isNotNull()).alias("reads_correctly_mapped"), add(F.col("linked").isNull()).alias("reads_incorrectly_mapped"))


def fragments_by_genome(per_source: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """(reference_id, fragments): of each target the sum over its genomes, once per link; without a link its own count.

    per_source (reference_id, fragments); targets (reference_id).
    """
    counted = per_source.select(F.col("reference_id").alias("genome_id"), "fragments")
    linked = links.select("genome_id", F.col("target_id").alias("reference_id")).join(counted, "genome_id", "left").groupBy("reference_id").agg(F.coalesce(F.sum("fragments"), F.lit(0)).alias("linked"))
    own = per_source.select("reference_id", F.col("fragments").alias("own"))
    return targets.select("reference_id").join(linked, "reference_id", "left").join(own, "reference_id", "left").select("reference_id", F.coalesce("linked", "own", F.lit(0)).cast("long").alias("fragments"))


def sample_targets(genomes: DataFrame, links: DataFrame) -> DataFrame:
    """(reference_id): targets of any sample genome."""
    return links.join(genomes.where("category = 'sample'"), "genome_id", "left_semi").select(F.col("target_id").alias("reference_id")).distinct()


#: The columns of the results table, in order.
RESULTS = (
    "run_name", "timestamp", "num_fragments", "seed", "fragments_generated", "fragments_captured", "capture_rate",
    "sample_generated", "nonsample_target_generated", "distractor_generated", "untargeted_generated",
    "sample_captured", "nonsample_target_captured", "distractor_captured", "untargeted_captured",
    "reads_correctly_mapped", "reads_incorrectly_mapped", "sample_total", "nonsample_target_total", "distractors_total",
    "tp_count", "fn_count", "fp_target_count", "fp_distractor_count", "fp_total", "tn_target_count", "tn_distractor_count", "tn_total",
    "sensitivity", "specificity", "precision", "f1_score", "reads_sequenced", "reads_after_filter", "reads_mapped", "reads_unmapped",
)


def _class_counts(names: DataFrame, classes: DataFrame, suffix: str) -> DataFrame:
    """One row: fragments in all, and of each class; names (qname), classes (qname, fragment_class)."""
    n = lambda c: F.count(F.when(F.col("fragment_class") == c, 1)).alias(f"{c}_{suffix}")
    return names.join(classes, "qname", "left").agg(F.count(F.lit(1)).alias(f"fragments_{suffix}"), *[n(c) for c in ("sample", "nonsample_target", "distractor", "untargeted")])


def results_row(generated: DataFrame, captured: DataFrame, classes: DataFrame, accuracy: DataFrame, groups: DataFrame, run_name: str, timestamp: str, seed: str, reads_sequenced: DataFrame | None = None, reads_after_filter: DataFrame | None = None) -> DataFrame:
    """The one row of the results table, RESULTS.

    generated, captured (qname), one row for each fragment; classes (qname, fragment_class);
    accuracy as mapping_accuracy gives it; groups as group_detail does. Reads go into the
    mapping after the filter if there was one, else as sequenced, else as captured; what
    isn't mapped of them is unmapped. The one-row parts meet on a constant.
    """
    parts = [_class_counts(generated, classes, "generated"), _class_counts(captured, classes, "captured"), accuracy, confusion_metrics(groups)]
    for name, df in (("reads_sequenced", reads_sequenced), ("reads_after_filter", reads_after_filter)):
        if df is not None:
            parts.append(df.agg(F.count(F.lit(1)).alias(name)))
    row = parts[0].withColumn("_k", F.lit(1))
    for part in parts[1:]:
        row = row.join(F.broadcast(part.withColumn("_k", F.lit(1))), "_k")  # one row
    none = F.lit(None).cast("long")
    given = {name: F.col(name) if df is not None else none for name, df in (("reads_sequenced", reads_sequenced), ("reads_after_filter", reads_after_filter))}
    into = F.coalesce(given["reads_after_filter"], given["reads_sequenced"], F.col("fragments_captured"))
    mapped = F.col("reads_correctly_mapped") + F.col("reads_incorrectly_mapped")
    made = {
        "run_name": F.lit(run_name),
        "timestamp": F.lit(timestamp),
        "num_fragments": F.col("fragments_generated"),
        "seed": F.lit(seed),
        "capture_rate": F.when(F.col("fragments_generated") > 0, F.col("fragments_captured") / F.col("fragments_generated")).otherwise(F.lit(0.0)),
        "sample_total": F.col("tp_count") + F.col("fn_count"),
        "nonsample_target_total": F.col("fp_target_count") + F.col("tn_target_count"),
        "distractors_total": F.col("fp_distractor_count") + F.col("tn_distractor_count"),
        "reads_sequenced": F.coalesce(given["reads_sequenced"], F.lit(0).cast("long")),
        "reads_after_filter": F.coalesce(given["reads_after_filter"], F.lit(0).cast("long")),
        "reads_mapped": mapped,
        "reads_unmapped": F.greatest(into - mapped, F.lit(0).cast("long")),
    }
    return row.select(*[made.get(c, F.col(c)).alias(c) for c in RESULTS])


def results_document(row: DataFrame) -> DataFrame:
    """(document): the results as one JSON object with a section each for the run, the capture, the reads and the metrics, from the results row."""
    sections = {"run_info": RESULTS[:4], "capture_stats": RESULTS[4:15], "read_level": (*RESULTS[15:17], *RESULTS[34:36], *RESULTS[32:34]), "metrics": RESULTS[20:32]}
    return row.select(F.to_json(F.struct(*[F.struct(*columns).alias(name) for name, columns in sections.items()])).alias("document"))


def detail_documents(groups: DataFrame, rows: DataFrame, unknown: DataFrame, untargeted: DataFrame) -> DataFrame:
    """(section, name, document): the details of the results, one line each, so that they may be of any number: group names by class, unknown and untargeted ids, and the detail rows as JSON."""
    named = {"TP": "true_positives", "FN": "false_negatives", "FP_target": "fp_targets", "FP_distractor": "fp_distractors", "TN_target": "tn_targets", "TN_distractor": "tn_distractors"}
    section = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])[F.col("classification")]
    line = lambda df, part, name, doc: df.select(part.alias("section"), F.col(name).alias("name"), doc.alias("document"))
    none = F.lit(None).cast("string")
    return (
        line(groups, section, "group_name", none)
        .unionByName(line(unknown, F.lit("unknown_detected"), "reference_id", none))
        .unionByName(line(untargeted, F.lit("untargeted_genomes"), "reference_id", none))
        .unionByName(line(rows, F.lit("detail_rows"), "reference_id", F.to_json(F.struct(*rows.columns))))
    )
