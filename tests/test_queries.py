import pytest

from loomrank.plans import registry

from .oracle import same

ORACLE, QUERIES = registry.oracle_sql(), registry.queries()
#: A spread of families; the driver compares all of them.
CHECKED = [n for n in ORACLE if n.split("_")[0] in {
    "src1", "src11", "j5", "j8", "j9", "j22", "a12", "a13", "a25", "w3", "w5", "w12", "w13", "s3", "d3", "d7", "q2", "q16", "x4", "x6", "x7", "u1", "m3", "m6", "n4", "f12", "f17",
    "r6", "r31", "j13", "k2", "st1", "st3", "t7", "x1", "x15", "f1", "r1", "r3", "r5", "r11", "r14", "r14b", "m7", "src10", "w7", "s8", "d9", "d4", "k7", "k8", "st6", "r29", "r45", "r27", "src5", "src6", "src7", "src15", "src18", "n8", "r43", "r46", "k4", "m11"}]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, QUERIES[name], ORACLE[name], sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
