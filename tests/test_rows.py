"""Detection rows, joins, splits and samples."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from originlens.operators import cleaning, joins, sampling, shaping


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [
        ("essay_0_var0", 0, 0, " o0\n", "g00"),
        ("essay_0_var1", 0, 1, " o0\n", "g01"),
        ("essay_12_var4", 12, 4, "\t ", "g"),
        ("essay_3_var0", 3, 0, None, ""),
    ]
    return spark.createDataFrame(rows, "id string, essay_idx int, variation_idx int, original_en string, generated_en string")


def test_detection_rows(spark, pairs):
    rows = shaping.build_detection_rows(pairs).collect()
    assert Counter((r.text, r.is_generated, r.variation_idx) for r in rows) == Counter(
        {("o0", 0, -1): 2, ("g00", 1, 0): 1, ("g01", 1, 1): 1, ("g", 1, 4): 1}
    )
    assert {r.source for r in rows} == {"unknown"} and {r.year for r in rows} == {2020}
    once = shaping.build_detection_rows(pairs, dedupe=True).filter("is_generated = 0").collect()
    assert [(r.text, r.essay_idx) for r in once] == [("o0", 0)]


def test_ids_and_urls(spark):
    ids = spark.createDataFrame([("essay_12_var4",), ("other",)], "id string")
    assert [tuple(r)[1:] for r in cleaning.parse_variation_id(ids).collect()] == [(12, 4), (None, None)]
    urls = spark.createDataFrame([("http://x/a/b.html#respond",), ("",), (None,), ("http://x/",)], "u string")
    assert [r[0] for r in urls.select(cleaning.prompt_name_from_url("u")).collect()] == ["b", "Essay", "Essay", ""]


def test_valid_translation(spark):
    df = spark.createDataFrame([("s", "ok"), ("s", "[Translation error: x]"), ("s", None), (" ", ""), ("s", "a Request exception")], "src string, en string")
    assert cleaning.translation_counts(df, "src", "en").first().asDict() == {"n_valid": 1, "n_error": 3, "n_blank": 1, "n_rows": 5}


def test_first_n_and_fan_out(spark):
    df = spark.range(5)
    assert [r.id for r in cleaning.first_n(df, 2, [F.col("id").desc()]).collect()] == [4, 3]
    assert cleaning.first_n(df, -1, [F.col("id")]).count() == 5
    with pytest.raises(ValueError):
        shaping.fan_out_variations(df, 0, "id")


def test_overlap_keeps_equal_texts_only(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "text string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "text string")
    assert [r.text for r in shaping.text_overlap(a, b).collect()] == ["x"]


def test_attach_predictions_fails_on_mismatch(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "id int, y int")
    good = spark.createDataFrame([(1, 0.1), (2, 0.9)], "id int, score double")
    assert joins.attach_predictions(labels, good).count() == 2
    for bad in ([(1, 0.1)], [(1, 0.1), (3, 0.9)]):
        with pytest.raises(Exception, match="labels, predictions, matches"):
            joins.attach_predictions(labels, spark.createDataFrame(bad, "id int, score double")).collect()


def test_resume_counts_per_essay(spark):
    todo = shaping.fan_out_variations(spark.range(3).withColumnRenamed("id", "essay_idx"), 2)
    done = todo.filter("essay_idx = 0 OR (essay_idx = 1 AND variation_idx = 0)")
    assert sorted(r.id for r in joins.resume_missing(todo, done, 2).collect()) == ["essay_1_var1", "essay_2_var0", "essay_2_var1"]


def test_pairs_use_every_row_of_the_larger_class(spark, monkeypatch):
    rows = [(i, "p", 1 if i < 3 else 0, f" t{i} ") for i in range(200)] + [(500, "q", 1, "only")]
    df = spark.createDataFrame(rows, "id int, prompt string, y int, text string")
    monkeypatch.setattr(shaping, "PAIRS_PER_SALT", 10)
    p = shaping.opposite_label_pairs(df, "prompt", "y", "id", "text", 1).collect()
    assert sorted(r.human_id for r in p) == list(range(3, 200))
    assert set(Counter(r.ai_id for r in p).values()) == {65, 66}
    assert all(r.human == f"t{r.human_id}" and r.ai == f"t{r.ai_id}" for r in p)


@pytest.fixture(scope="module")
def skewed(spark):
    """Prompt ``big`` and label 0 hold most rows."""
    return spark.range(900).select(
        "id",
        F.when(F.col("id") % 5 == 0, "small").otherwise("big").alias("prompt"),
        (F.col("id") % 4 == 0).cast("int").alias("y"),
    )


def test_group_split_keeps_groups_together(spark):
    df = spark.range(1000).select("id", (F.col("id") % 50).alias("essay_idx"))
    out = sampling.group_split(df, "essay_idx", 7)
    per = {r.essay_idx: r.n for r in out.groupBy("essay_idx").agg(F.countDistinct("split").alias("n")).collect()}
    assert set(per.values()) == {1} and out.count() == 1000
    groups = {r.split: r.n for r in out.groupBy("split").agg(F.countDistinct("essay_idx").alias("n")).collect()}
    assert groups == {"train": 30, "val": 10, "test": 10}
    assert sorted(out.collect()) == sorted(sampling.group_split(df.repartition(9), "essay_idx", 7).collect())


def test_folds_are_even_per_class(skewed):
    f = sampling.stratified_kfold(skewed, 1, 5)
    sizes = f.groupBy("y", "fold").count().collect()
    assert {(r.y, r["count"]) for r in sizes} == {(1, 45), (0, 135)}


def test_permuted_labels_keep_counts(skewed):
    p = sampling.permute_labels(skewed, 3)
    assert p.count() == 900
    assert p.filter("y_shuffled = 1").count() == skewed.filter("y = 1").count()
    assert p.filter("y_shuffled <> y").count() > 0


def test_balanced_batches(skewed):
    b = sampling.balanced_prompt_batches(skewed, 8, 1)
    shape = b.groupBy("prompt", "batch").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.countDistinct("id").alias("d")).collect()
    assert {(r.n, r.pos, r.d) for r in shape} == {(8, 4, 8)}
    assert Counter(r.prompt for r in shape) == {"big": 180 // 4, "small": 45 // 4}


def test_prompt_batches_keep_every_row(skewed):
    b = sampling.prompt_batches(skewed, 16, 1)
    assert b.count() == 900 and b.select("id").distinct().count() == 900
    sizes = b.groupBy("kind", "batch").agg(F.count("*").alias("n"), F.countDistinct("prompt").alias("p")).collect()
    assert all(r.n == 16 and r.p == 1 for r in sizes if r.kind == "same")
    assert sum(r.n != 16 for r in sizes if r.kind == "mixed") <= 1
    same = sum(r.n for r in sizes if r.kind == "same") / 900
    assert 0.6 < same < 0.95


def test_id_lists_are_whole_and_bounded(skewed):
    lists = sampling.group_id_lists(skewed, ["prompt", "y"], "id", chunk=50).collect()
    assert max(len(r.ids) for r in lists) <= 50
    assert sorted(i for r in lists for i in r.ids) == list(range(900))


def test_length_batches(spark):
    df = spark.range(500).select("id", (F.when(F.col("id") < 300, 7).otherwise(F.col("id"))).alias("n_tokens"))
    b = sampling.length_batches(df, 32, 1).collect()
    by_batch = {}
    for r in b:
        by_batch.setdefault(r.batch, []).append(r.n_tokens)
    assert [len(by_batch[k]) for k in sorted(by_batch)] == [32] * 15 + [20]
    assert all(max(by_batch[k]) <= min(by_batch[k + 1]) for k in range(15))
    pad = {r.batch: r for r in sampling.batch_padding(sampling.length_batches(df, 32, 1)).collect()}
    assert all(pad[k].padded_len == -(-max(v) // 64) * 64 and pad[k].padding == pad[k].padded_len * len(v) - sum(v) for k, v in by_batch.items())


def test_draws_and_samples(spark, skewed):
    d = sampling.draw_prompts(skewed, 3000, 1)
    assert d.count() == 3000 and 800 < d.select("id").distinct().count() <= 900
    s = Counter(r.y for r in sampling.per_class_sample(skewed, 100, 1).collect())
    assert s == {0: 100, 1: 100}
    parts = Counter(r.part for r in sampling.holdout_permutation(skewed, 1).collect())
    assert parts == {"train": 720, "test": 180}
