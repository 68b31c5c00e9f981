import re
from pathlib import Path

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["reference_id", "n_reads", "first_pos", "last_pos"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_every_query_has_a_stable_shape(spark, small):
    for name in ("p1_found", "p3_found", "p4_found", "a14_probe_coverage_stats", "g7_species_calls", "g2_greedy_cover", "r3_capture_fragments"):
        one, two = (entry.queries()[name](spark, small) for _ in range(2))
        assert one.schema == two.schema and one.count() == two.count(), name


def test_core_does_not_import_the_subpackage():
    root = Path(__file__).resolve().parent.parent / "tilewright"
    core = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert len(core) > 20 and not [p for p in core if re.search(r"^\s*(from|import) tilewright\.llm", p.read_text(), re.M)]
