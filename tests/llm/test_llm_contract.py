"""Every query of the package runs over the smallest tables, and gives the rows of its SQL where it has one."""

import pytest

from pagewright.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in ORACLE_SQL:
        cursor = duck.execute(ORACLE_SQL[name])
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        assert sorted(rows, key=str) == sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=str)


def test_columns_of_the_listed_cases(spark, small):
    want = {"p1": "page_id defect", "p2": "doc_id_a doc_id_b", "p3": "run_id page_id", "p4": "doc_id language", "p5": "page_id_a page_id_b", "p6": "page_id_a page_id_b", "p9": "doc_id"}
    for p, columns in want.items():
        assert QUERIES[f"{p}_found"](spark, small).columns == columns.split()
