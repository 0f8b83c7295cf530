from blkscope.llm import quality as Q


def test_toxic_documents_are_not_trusted(spark):
    rows = [(1, 1, 0), (2, 1, 1), (3, 1, 0), (3, 1, 1), (4, 1, None), (5, 0, 1), (None, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {r.key for r in Q.trusted_keys(labels).collect()} == {1, 4}
