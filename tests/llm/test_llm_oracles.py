import pytest
from test_oracles import same

from foliomill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.001").count()
    table = spark.read.parquet(f"/root/testdata/sf0.001/{'pages' if name == 'op8_warc' else 'documents'}.parquet").count()
    assert rows == table or name in ORACLES
