from quarrylight.plans import evaluate


def test_delivery_reads_the_chunks_once(spark):
    """What is delivered comes from stored rows of the ranked chunks: chunks are not cut again for each reader."""
    same = lambda df: df.mapInArrow(lambda batches: batches, df.schema)
    chunks = same(spark.createDataFrame([(k, f"p{k // 2}", "s", f"text {k}", f"text {k}") for k in range(6)], "chunk_id long, parent_id string, source_id string, display_text string, embed_text string"))
    parents = same(spark.createDataFrame([("p0", "text 0 text 1"), ("p1", "text 2 text 3")], "parent_id string, parent_text string"))
    ranked = spark.createDataFrame([(1, 3, 2.0, 0), (1, 2, 1.0, 1), (1, 5, 0.5, 2)], "query_id long, chunk_id long, score double, rank int")
    found = evaluate.delivered(ranked, chunks, parents, 100)
    assert sorted((r.unit, r["rank"], r.text) for r in found.collect()) == [("child", 0, "text 3"), ("child", 1, "text 2"), ("child", 2, "text 5"), ("parent", 0, "text 2 text 3"), ("parent", 2, "text 5")]
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
