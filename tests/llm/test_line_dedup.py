from fathom.llm.line_dedup import drop_site_lines
from tests.llm.helpers import DOCS, edge_docs


def test_ratio_is_relative_to_the_host(spark):
    rows = [(i, f"menu\nbody {i}\n\n menu ", None, "a", 0) for i in range(4)]
    rows += [(10 + i, "menu\n" * (i == 0) + f"text {i}", None, "b", 0) for i in range(40)]
    rows += [(90 + i, "menu\nlone", None, None, 0) for i in range(3)]
    got = {r.doc_id: r for r in drop_site_lines(spark.createDataFrame(rows, DOCS), ratio=0.5, min_pages=3).collect()}
    assert got[0].text == "body 0\n" and (got[0].n_lines, got[0].n_dropped) == (4, 2)
    assert got[10].text == "menu\ntext 0" and got[10].n_dropped == 0
    assert got[90].text == "" and got[90].n_dropped == 2  # null is a host of its own; its row stays


def test_edge_rows_stay(spark):
    docs = edge_docs(spark).selectExpr("*", "1 as n_lines", "2 as `count`", "3 as l")
    got = drop_site_lines(docs).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.text, r.n_lines) for r in got if r.doc_id in (2, 3, 4)} == {(2, None, 0), (3, "", 1), (4, " \t\n ", 2)}
    assert drop_site_lines(docs.limit(0)).count() == 0


def test_large_lists_take_the_shuffled_way(spark, monkeypatch):
    import fathom.llm.line_dedup as m
    rows = [(i, f"x\ny\nown {i}", None, "ab"[i % 2], 0) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    small = sorted(drop_site_lines(df).collect())
    monkeypatch.setattr(m, "BROADCAST_LINES", -1)
    assert sorted(drop_site_lines(df).collect()) == small and small[0].text == "own 0"
