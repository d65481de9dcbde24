import pytest

from qatlam.llm import queries as Q
from tests.conftest import same

COLUMNS = {
    "p1_found": ["field", "term", "mark"], "p2_found": ["tbl", "row_id"], "p4_found": ["field", "item"], "p5_found": ["tbl", "row_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "start_char", "end_char"],
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, data, duck, name):
    df = Q.QUERIES[name](spark, data)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    if name in Q.SQL:
        same(df, duck.sql(Q.SQL[name]))
    else:
        assert df.count() == df.distinct().count() > 0
