"""Shape of physical plans: what reaches the scan, and what never appears."""

import re

import pytest

from originlens.operators.sampling import per_class_sample
from originlens.plans import registry, views

registry.load_all()

LAZY = [
    n for n in registry.QUERIES
    if re.match(r"(a6|b\d+|c\d|d\d|e\d+|f\d+|g1|g2|h[1-7]|k13)_", n) and n != "e13_draw_prompts"
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins_and_no_hints(spark, sf, name):
    p = plan(registry.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p
    assert "NestedLoopJoin" not in p


def test_label_queries_do_not_read_texts(spark, sf):
    for name in ("e4_stratified_kfold", "e8_balanced_prompt_batches", "k13_class_distribution"):
        schemas = re.findall(r"ReadSchema: (struct<[^\n]*)", plan(registry.QUERIES[name](spark, sf)))
        assert schemas and not any("text:" in s for s in schemas), name


def test_filters_reach_the_scan(spark, sf):
    pushed = re.findall(r"PushedFilters: (\[[^\n]*?\]),", plan(views.pairs(spark, sf)))
    assert any("EqualTo(role,user)" in f for f in pushed) and any("EqualTo(role,assistant)" in f for f in pushed)


def test_samples_are_cut_before_the_shuffle(spark, sf):
    df = per_class_sample(views.doc_labels(spark, sf), 5, 1, "y", "doc_id")
    assert "WindowGroupLimit" in plan(df)


def test_row_expressions_do_not_shuffle(spark, sf):
    for name in ("b6_prompt_name_from_url", "e1_bernoulli_split", "f3_word_prefix", "f8_pack_sentences"):
        assert "Exchange" not in plan(registry.QUERIES[name](spark, sf)), name
