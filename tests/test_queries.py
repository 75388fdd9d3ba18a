"""Every registered query that has SQL gives its rows; the others give rows."""

import pytest

from folio.plans import registry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    if name in registry.oracle_sql():
        assert compare(df, con, registry.oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 4


def test_recall(spark):
    rows = registry.ivf_recall(spark, SF).collect()
    assert sum(r.recall for r in rows) / len(rows) >= 0.9


def test_grade_of_rounded_average(spark, con, tmp_path):
    """An average that is 0.8 when rounded and a little less before."""
    text = (
        "anortion | inerershon, | edlysh | thortionnd | tition | eresingnd | onntst | whinwh | erreou | ononrehe | enwhor | onanhe. | Ofbleenhe | anhalyea | tiatnd | thatti | thonhesh | ananing | "
        "attionheedthth | thinha | heorsh | theringble | edeshe | thenan | ofinthin | tionon | thndha | lyatth | thersh | edouea |"
    )
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = con.cursor()
    own.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(registry.structure_rollup(spark, str(tmp_path)), own, registry.oracle_sql()["structure_rollup"]) is None
