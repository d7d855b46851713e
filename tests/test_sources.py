"""Readers, writers and the score store."""

import random

import pytest
from pyspark.sql import functions as F

from originlens import session
from originlens.sources import readers, writers
from originlens.sources.store import PredictionStore

ROWS = [("a", 1, 'say "hi",\nnew line; x', 0), ("b", 2, None, 1)]


def test_read_any_takes_the_first_that_exists(spark, tmp_path):
    df = spark.createDataFrame(ROWS, readers.ESSAYS)
    writers.write_csv(df, str(tmp_path / "train.csv"))
    df.filter("id = 'a'").write.parquet(str(tmp_path / "train.parquet"))
    names = [str(tmp_path / n) for n in readers.TRAIN_NAMES]
    assert sorted(readers.read_any(spark, names, readers.ESSAYS).collect()) == sorted(df.collect())
    assert readers.read_any(spark, names[::-1], readers.ESSAYS).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_any(spark, [str(tmp_path / "none.csv")], readers.ESSAYS)


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text('text,generated,extra,id,prompt_id\n"a, b",1,z,a7,3\n')
    row = readers.read_csv(spark, str(tmp_path / "t.csv"), readers.ESSAYS).first()
    assert tuple(row) == ("a7", 3, "a, b", 1)
    (tmp_path / "u.csv").write_text("text,id\nx,1\n")
    with pytest.raises(ValueError, match="prompt_id"):
        readers.read_csv(spark, str(tmp_path / "u.csv"), readers.ESSAYS)


def test_ids_of_files_with_blanks_and_signs(spark, tmp_path):
    for name in ("my essay", "a+b", "50% é"):
        (tmp_path / f"{name}.txt").write_text("x")
    assert sorted(r.id for r in readers.read_text_dir(spark, str(tmp_path)).collect()) == sorted(["my essay", "a+b", "50% é"])


def test_all_probabilities_are_kept(spark):
    df = spark.createDataFrame([("\n".join("w -0.5" for _ in range(2500)),)], "c string")
    p = df.select(readers.parse_token_logprobs("c").alias("p")).first().p
    assert len(p.tokens) == len(p.probs) == 2500


@pytest.mark.parametrize("sep", [";", ","])
def test_separator_is_found(spark, tmp_path, sep):
    df = spark.createDataFrame([("текст; один, два", 2001)], "`Текст` string, `Год` int")
    writers.write_csv(df, str(tmp_path / "t"), sep)
    out = readers.rename_foreign(readers.read_delimited_auto(spark, str(tmp_path / "t"), df.schema))
    assert out.columns == ["text_src", "year"] and [tuple(r) for r in out.collect()] == [("текст; один, два", 2001)]


def test_text_and_logprob_files(spark, tmp_path):
    (tmp_path / "logprobs").mkdir()
    (tmp_path / "x1.txt").write_text("line one\nline two")
    (tmp_path / "logprobs" / "x1-m.txt").write_text("the -0.5\n  -1.0\n cat -2.0\n    -3.0\n")
    (tmp_path / "logprobs" / "x1-other.txt").write_text("the -9\n")
    assert [tuple(r) for r in readers.read_text_dir(spark, str(tmp_path / "x1.txt")).collect()] == [("x1", "line one\nline two")]
    r = readers.read_token_logprobs(spark, str(tmp_path / "logprobs"), "m", 3).collect()
    assert len(r) == 1 and r[0].id == "x1"
    assert r[0].tokens == ["the", "ĠĠĠ", "cat", "ĠĠĠĠĠ"]
    import math

    assert r[0].probs == pytest.approx([math.exp(-0.5), math.exp(-1), math.exp(-2)])


def test_resolve_columns_by_existence(spark):
    df = spark.createDataFrame([(None, "x")], "text string, full_text string")
    out = readers.resolve_columns(df, {"text": (["text", "full_text"], ""), "task": (["task"], "Writing")})
    assert tuple(out.first()) == (None, "Writing")


def test_store_computes_missing_rows_once(spark, tmp_path):
    store = PredictionStore(spark, str(tmp_path / "store"))
    seen = []

    def compute(df):
        seen.append(sorted(r.id for r in df.collect()))
        return df.select("id", F.lit(0.5).alias("score"))

    def rows(n):
        return spark.range(n).select(F.col("id").cast("string").alias("id"))

    assert store.get(rows(3), "m", "test", compute).count() == 3
    assert store.get(rows(5), "m", "test", compute).count() == 5
    assert store.get(rows(5), "m", "test", compute).count() == 5
    assert seen == [["0", "1", "2"], ["3", "4"], []]
    assert store.stored("m", "test").count() == 5 and store.stored("m", "val").count() == 0


def _store_rows(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_null_and_repeated_ids_are_stored_once(spark, tmp_path):
    store = PredictionStore(spark, str(tmp_path / "store"))
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.select("id", F.lit(0.25).alias("score"))

    for _ in range(2):
        got = store.get(_store_rows(spark, ["a", None, "a", None, "b"]), "m", "s", compute)
        assert sorted(map(str, [r.id for r in got.collect()])) == ["None", "a", "b"]
    assert calls == [3, 0] and store.stored("m", "s").count() == 3 and len(store.folders("m", "s")) == 1


def test_a_failed_write_is_never_seen(spark, tmp_path, monkeypatch):
    store = PredictionStore(spark, str(tmp_path / "store"))
    half = lambda df: df.select("id", F.lit(0.5).alias("score"))
    store.get(_store_rows(spark, ["a"]), "m", "s", half)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.get(_store_rows(spark, ["a", "b"]), "m", "s", half)
    assert [r.id for r in store.stored("m", "s").collect()] == ["a"]
    assert store.get(_store_rows(spark, ["a", "b"]), "m", "s", half).count() == 2
    assert store.stored("m", "s").count() == 2


def test_two_writers_keep_each_id_once(spark, tmp_path):
    one, two = (PredictionStore(spark, str(tmp_path / "store")) for _ in range(2))

    def slow(df):
        # the other writer commits while this one computes
        two.get(_store_rows(spark, ["b", "c"]), "m", "s", lambda d: d.select("id", F.lit(2.0).alias("score")))
        return df.select("id", F.lit(1.0).alias("score"))

    got = one.get(_store_rows(spark, ["a", "b"]), "m", "s", slow)
    assert sorted(map(tuple, got.collect())) == [("a", 1.0), ("b", 2.0)]
    assert sorted(map(tuple, two.stored("m", "s").collect())) == [("a", 1.0), ("b", 2.0), ("c", 2.0)]
    assert len(one.folders("m", "s")) == 2


def test_splits_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 4, 1, "train" if i % 4 < 2 else "test") for i in range(8)], "row_id int, essay_idx int, is_generated int, split string")
    writers.write_splits(df, str(tmp_path / "s"), 42)
    assert spark.read.parquet(str(tmp_path / "s/detection")).filter("split = 'train'").count() == 4
    m = {r.split: (r.n_groups, r.n_rows, r.seed) for r in spark.read.json(str(tmp_path / "s/manifest")).collect()}
    assert m == {"train": (2, 4, 42), "test": (2, 4, 42)}


def test_shared_dir_follows_the_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = session.shared_dir(spark, "x")
    assert path.startswith(base) and path != session.shared_dir(spark, "x")


@pytest.fixture
def small_ranges(spark):
    """Scans cut files into ranges of the given number of bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}

    def cut(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield cut
    for n, v in old.items():
        spark.conf.set(n, v)


def _csv(rows, end="\n", sep=","):
    def field(v):
        s = "" if v is None else str(v)
        return '"' + s.replace('"', '""') + '"' if any(c in s for c in f'"{sep}\n\r') else s

    return "id,prompt_id,text,generated".replace(",", sep) + end + "".join(sep.join(map(field, r)) + end for r in rows)


def _random_rows(seed, n):
    rng = random.Random(seed)
    bits = ["a", "word", " ", ",", ";", '"', '""', "\n", "\n\n", "\r\n", "é", "本", "end."]
    return [(f"i{i}", i, "".join(rng.choices(bits, k=rng.choice([0, 3, 10, 60, 400]))).strip() or None, i % 2) for i in range(n)]


@pytest.mark.parametrize("size, end, sep", [(40, "\n", ","), (300, "\r\n", ","), (1000, "\n", ";"), (10_000_000, "\n", ",")])
def test_csv_in_ranges_equals_one_task(spark, tmp_path, small_ranges, size, end, sep):
    rows = _random_rows(size, 120)
    for name, part in (("a", rows[:100]), ("b", rows[100:])):
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / f"{name}.csv").write_text(_csv(part, end, sep), newline="")
    path = str(tmp_path / "t")
    small_ranges(size)
    if size <= 300:
        assert spark.read.text(path).rdd.getNumPartitions() >= 8
    got = readers.read_csv(spark, path, readers.ESSAYS, sep).collect()
    if end == "\n":  # the one-task reader turns all line ends of the other files into line feeds
        assert sorted(map(tuple, got)) == sorted(map(tuple, readers.read_csv(spark, path, readers.ESSAYS, sep, split=False).collect()))
    assert {r.id: r.text for r in got} == {r[0]: r[2] for r in rows}


def test_csv_record_longer_than_many_ranges(spark, tmp_path, small_ranges):
    long = "line with, commas and \"quotes\"\n" * 300
    rows = [("a", 1, "x", 0), ("b", 2, long, 1), ("c", 3, "y\nz", 0), ("d", 4, None, 1)]
    (tmp_path / "t.csv").write_text("\n" + _csv(rows).replace("c,3", "\n\nc,3"))
    small_ranges(100)
    got = readers.read_csv(spark, str(tmp_path / "t.csv"), readers.ESSAYS).collect()
    assert sorted(map(tuple, got)) == rows


def test_csv_without_rows_and_with_open_quotes(spark, tmp_path, small_ranges):
    (tmp_path / "t.csv").write_text("id,prompt_id,text,generated\n")
    assert readers.read_csv(spark, str(tmp_path / "t.csv"), readers.ESSAYS).collect() == []
    (tmp_path / "u.csv").write_text('id,prompt_id,text,generated\na,1,"open,0\n')
    small_ranges(16)
    with pytest.raises(ValueError, match="pair up"):
        readers.read_csv(spark, str(tmp_path / "u.csv"), readers.ESSAYS)
