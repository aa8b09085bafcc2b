import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import same

from lodestrata.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert same(spark, registry.queries()[name], registry.oracle_sql()[name], SMALL) == ""


@pytest.mark.parametrize("name", ["w5_retain_within", "r32_rerank", "j6_resolve", "r1_line_chunks"])
def test_partitions_change_nothing(spark, name):
    """Neither the number of shuffle partitions nor how the rows are dealt matters."""
    found = []
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            found.append(sorted(map(repr, registry.queries()[name](spark, SMALL).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1] == found[2] and found[0]


def test_impact_counts_all_dependents(spark, tmp_path):
    """73 files import the target: more than the number past which a package lists direct dependents alone."""
    pq.write_table(pa.table({"doc_id": [*range(200), *range(398, 14000, 199)]}), tmp_path / "documents.parquet")
    query, sql = registry.queries()["a15_impact_stats"], registry.oracle_sql()["a15_impact_stats"]
    found = query(spark, str(tmp_path)).first()
    assert found["direct"] > 50 and found["transitive"] > 0 and same(spark, query, sql, str(tmp_path)) == ""
