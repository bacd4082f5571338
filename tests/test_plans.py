"""What the optimizer makes of queries."""

from clausewright.plans import catalog


def test_shingles_cut_words_once(spark, sf_dir):
    """No filter on the number of shingles goes below the words, where each shingle would cut the whole text anew."""
    plan = catalog.queries()["q_shingle_jaccard"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" in plan and "slice(regexp_extract_all" not in plan
