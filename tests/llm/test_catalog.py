from zonelex.llm import catalog


def test_every_query_runs(spark, data):
    for name, query in catalog.queries().items():
        assert query(spark, data).columns, name


def test_found_columns(spark, data):
    columns = {
        "p1_found": ["page_row", "field"], "p2_found": ["page_row", "subject"], "p4_found": ["doc_id", "term"], "p5_found": ["origin", "term", "mark"],
        "p6_found": ["page_row", "field", "markup"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "reading_level"],
    }
    for name, expected in columns.items():
        df = catalog.queries()[name](spark, data)
        assert df.columns == expected and df.count() == df.distinct().count() > 0, name
