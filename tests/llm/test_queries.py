import os

import oracle
import pytest

from quarrylight.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.TABLES), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    oracle.same(spark, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_one_row_for_each_document_or_page(spark, name):
    frame = queries.queries()[name](spark, oracle.TABLES)
    docs = spark.read.parquet(f"{oracle.TABLES}/documents.parquet")
    if name == "op6_html_extraction":
        assert frame.count() == spark.read.parquet(f"{oracle.TABLES}/pages.parquet").count()
    elif name == "op2_best_fit_packing":
        assert frame.select("doc_id").distinct().count() == docs.count()
    elif name not in ("op7_exact_top_k", "op11_prefix_trie", "quality_ablations"):
        assert sorted(r.doc_id for r in frame.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


ODD = [None, "", " ", "a", "a b c", "aa\rbb\fcc\x0bdd\tee\nff", "ä\x1cö ü", "# $ \r\n|", "Straße İ K " * 9, "x\ry " * 60, "x\ry " * 60, "one two three four five", "ONE two Three four five", "released under the MIT License, cc by nc", "under the mit licensex", "a_b under_the_mit_license"]


@pytest.mark.parametrize("name", ["op1_quality_rules", "quality_ablations", "op5_license_scans", "op8_suffix_array_dedup", "op10_minhash_near_dedup"])
def test_odd_texts_equal_the_sql(spark, name, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    oracle.same(spark, queries.queries()[name], queries.oracle_sql()[name], str(tmp_path))
