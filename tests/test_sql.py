import pytest

from sql_check import differs


@pytest.mark.parametrize("name", ["p1_found", "p1_reads_per_ref", "p1_sweep_per_ref", "p3_found", "p4_found", "p4_paf_records", "p4_blast_records", "d1_read_depth", "a14_probe_coverage_stats", "a10_detail_rows", "a18_probe_summary", "a19_discriminability", "g7_species_calls", "f18_delta_g", "j12_seed_matches", "j16_gap_types", "v6_pangenome_offsets"])
def test_query_equals_its_sql(spark, small, name):
    assert differs(spark, name, small) is None
