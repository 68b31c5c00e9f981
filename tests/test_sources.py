import pytest

from tilewright.sources import alignments as A
from tilewright.sources import lists as L
from tilewright.sources import sequences as S
from tilewright.sources import sinks as K
from tilewright.streaming.depth_feed import windowed_read_counts


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nacg\nTT\n>s2\n>s1 again\nGGG\n")
    got = {r.seq_id: (r.header, r.seq) for r in S.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"s1": ("s1 again", "GGG"), "s2": ("s2", "")}
    assert S.read_fasta(spark, str(tmp_path / "a.fa"), unique=False).count() == 3
    (tmp_path / "a.fq").write_text("@r1 x\nacg\n+\n@@@\n@r2\nA\n+\nI\n")
    got = [(r.read_id, r.seq, r.qual, r.ord) for r in S.read_reads(spark, str(tmp_path / "a.fq")).orderBy("ord").collect()]
    assert got == [("r1", "ACG", "@@@", 0), ("r2", "A", "I", 1)]
    (tmp_path / "b.fq").write_text("@r1\nACG\n+\n")
    with pytest.raises(Exception, match="truncated"):
        S.read_fastq(spark, str(tmp_path / "b.fq")).collect()


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT", None), ("b", "G", "#")], "seq_id string, seq string, qual string")
    K.write_fasta(df, str(tmp_path / "fa"))
    assert sorted((r.seq_id, r.seq) for r in S.read_fasta(spark, str(tmp_path / "fa")).collect()) == [("a", "ACGT"), ("b", "G")]
    K.write_fastq(df, str(tmp_path / "fq"), read_id="seq_id", qual="qual")
    assert sorted((r.read_id, r.qual) for r in S.read_fastq(spark, str(tmp_path / "fq") + "/part*").collect()) == [("a", "IIII"), ("b", "#")]
    kept = K.extract_by_ids(df, df.where("seq_id = 'a'"), "seq_id")
    assert [r.seq_id for r in kept.collect()] == ["a"]


def test_fastq_records_cross_splits(spark, tmp_path):
    records = [(f"r{i}", "ACGT" * (i % 7 + 1), "@+I#" * (i % 7 + 1)) for i in range(3000)]
    for name, part in (("a.fq", records[:2000]), ("b.fq", records[2000:])):
        (tmp_path / name).write_text("".join(f"@{r} x\x0c y\n{s}\n+\n{q}\n" for r, s, q in part) + "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = S.read_fastq(spark, str(tmp_path / "*.fq"))
        assert S.numbered_lines(spark, str(tmp_path / "*.fq")).rdd.getNumPartitions() > 1
        got = [tuple(r) for r in df.orderBy("file", "ord").select("read_id", "seq", "qual").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == records
    (tmp_path / "c.fq").write_text("@r1\nACG\n+\nII\n")
    with pytest.raises(Exception, match="broken FASTQ record 0"):
        S.read_fastq(spark, str(tmp_path / "c.fq")).collect()
    none = df.where("false")
    with pytest.raises(ValueError, match="too thin"):
        S.demand_reads(none, df, "x")
    assert S.demand_reads(df, none, "x") is df


def test_manifest_and_clusters(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# c\nt1\t2.5\nt2\nt1\t3\n")
    as_map = lambda df: {r.seq_id: r.weight for r in df.collect()}
    assert as_map(L.resolve_sample(spark, [str(tmp_path / "m.tsv")])) == {"t1": 3.0, "t2": 1.0}
    assert as_map(L.resolve_sample(spark, ["t1", "2.5", "t2"])) == {"t1": 2.5, "t2": 1.0}
    (tmp_path / "bad.tsv").write_text("t1\tx\n")
    with pytest.raises(Exception, match="not a weight"):
        L.read_manifest(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "c.clstr").write_text(">Cluster 0\n0\t120nt, >p1... *\n1\t120nt, >p2... at +/95.00%\n>Cluster 1\n0\t90nt, >p3... *\n>Cluster 2\n0\t90nt, >p4... at +/95.00%\n")
    assert {r.probe_id: r["size"] for r in L.read_clusters(spark, str(tmp_path / "c.clstr")).collect()} == {"p1": 2, "p3": 1}


def test_sorted_lists_and_params(spark, tmp_path):
    df = spark.createDataFrame([("b", "y"), ("a", "z"), ("b", "x")], "genome_id string, target_id string")
    K.write_sorted(df, str(tmp_path / "map"), ["genome_id", "target_id"])
    assert [r.value for r in spark.read.text(str(tmp_path / "map")).collect()] == ["a\tz", "b\tx", "b\ty"]
    assert K.concatenate(df, df.select("genome_id")).count() == 6
    K.write_params(spark, str(tmp_path / "p"), [("seed", "--seed", 42), ("threads", "--threads", None), ("fast", "--fast", True)])
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ["parameter\tflag\tvalue", "seed\t--seed\t42", "threads\t--threads\tnone", "fast\t--fast\ttrue"]


def test_sam_paf_blast(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:t1\tLN:500\nr1\t16\tt1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\tMD:Z:4\nshort\t0\nr2\tx\t*\ty\t0\t*\t*\t0\t0\tA\tI\n")
    got = [tuple(r)[1:] for r in A.read_sam(spark, str(tmp_path / "a.sam")).orderBy("aln_id").collect()]
    assert got == [("r1", 16, "t1", 5, "4M", "ACGT", "4"), ("r2", 0, "*", 0, "*", "A", None)]
    assert [tuple(r) for r in A.read_sam_references(spark, str(tmp_path / "a.sam")).collect()] == [("t1", 500)]
    (tmp_path / "a.paf").write_text("q\t120\t0\t120\t+\tt\t1000\t5\t125\t118\t120\t60\nbad\n")
    (tmp_path / "a.b6").write_text("q\tt\t120\t1\t100\t90\t100\n")
    records, faulty = A.read_paf(spark, str(tmp_path / "a.paf"))
    assert records.count() == 1 and [r.reason for r in faulty.collect()] == ["column_count"]
    both = A.unify_hits(records, A.read_blast(spark, str(tmp_path / "a.b6"))[0])
    assert sorted((r.query_start, r.block_length) for r in both.collect()) == [(0, 100), (0, 120)]


def test_lists(spark, tmp_path):
    (tmp_path / "g").write_text("# c\n>a\tg1\nb\tg2\na\tg3\n")
    assert {r.seq_id: r.group_name for r in L.read_groups(spark, str(tmp_path / "g")).collect()} == {"a": "g3", "b": "g2"}
    (tmp_path / "w").write_text("a 1.5\nb x\n")
    with pytest.raises(Exception, match="not a weight"):
        L.read_weights(spark, str(tmp_path / "w")).collect()
    (tmp_path / "m").write_text("only\n")
    with pytest.raises(Exception, match="two columns"):
        L.read_sample_target_map(spark, str(tmp_path / "m")).collect()
    (tmp_path / "d").write_text("r1\t5\nr2\tx\nr3\n")
    assert {r.reference_id: r.reads for r in L.read_detected(spark, str(tmp_path / "d")).collect()} == {"r1": 5, "r2": 0, "r3": 0}
    (tmp_path / "i").write_text("a x\na\n#b\n\nc\n")
    assert sorted(r.seq_id for r in L.read_id_set(spark, str(tmp_path / "i")).collect()) == ["a", "c"]


def test_stream_matches_batch(spark, small, tmp_path):
    source = f"{small}/sam_alignments.parquet"
    batch = spark.read.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source + "*")
    query = windowed_read_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got, want = (sorted(map(tuple, df.collect())) for df in (spark.table("counts"), windowed_read_counts(batch)))
    assert got == want and got
