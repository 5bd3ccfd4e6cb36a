"""The queries of the llm problems on the smallest tables, beside SQL or the library itself."""

import os

import duckdb
import pytest

from chronoloom.llm import queries as own
from chronoloom.llm.tokens import encoder

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def sql(text):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return con.execute(text)


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query_equals_its_sql(spark, name):
    df = own.QUERIES[name](spark, FOLDER)
    result = sql(own.ORACLES[name])
    assert df.columns == [d[0] for d in result.description]
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())


def test_ids_and_containers_of_all_documents(spark):
    texts = dict(sql("SELECT doc_id, text FROM documents").fetchall())
    ids = {r.doc_id: list(r.ids) for r in own.p7_ids(spark, FOLDER).collect()}
    assert ids == {d: encoder()._encode(t or "") for d, t in texts.items()}
    parts = own.p8_containers(spark, FOLDER).collect()
    total, fill = {}, {}
    for r in parts:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.size
        fill[r.container] = fill.get(r.container, 0) + r.size
    assert total == {d: len(i) for d, i in ids.items()} and max(fill.values()) <= own.CAPACITY


def test_percentiles_bracket_the_exact_ones(spark):
    exact = {(a, t): v for a, t, v in sql("SELECT app, frame_type, list_sort(list(milliseconds) FILTER (milliseconds IS NOT NULL)) FROM (SELECT DISTINCT ON (frame_id) * FROM frames) JOIN (SELECT capture_id, any_value(app) AS app FROM captures GROUP BY 1) USING (capture_id) GROUP BY ALL").fetchall()}
    rows = own.p5_percentiles(spark, FOLDER).where("grouping = 'app' and measure = 'milliseconds'").collect()
    assert len(rows) == len(exact)
    for r in rows:
        values = exact[r.app, r.frame_type]
        assert r.n == len(values)
        for q, p in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            below, upto = sum(v < p - 1e-5 * abs(p) for v in values), sum(v <= p + 1e-5 * abs(p) for v in values)
            assert below - r.rank_error * r.n - 1 <= q * r.n <= upto + r.rank_error * r.n + 1


def test_sentences_end_inside_their_text(spark):
    texts = dict(sql("SELECT doc_id, text FROM documents").fetchall())
    rows = own.p9_found(spark, FOLDER).collect()
    assert len(rows) == len({(r.doc_id, r.end_char) for r in rows}) > len(texts)
    assert all(0 < r.end_char <= len(texts[r.doc_id]) and not texts[r.doc_id][r.end_char - 1].isspace() for r in rows)
