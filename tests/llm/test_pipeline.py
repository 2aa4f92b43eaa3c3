"""The pipeline's stages on a small table: clean documents stay, decisions take effect, columns are kept."""

import random

import pytest

import corpus_pipeline
from terrane.llm.common import written


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    stops = "the of and to in a is that for it".split()
    say = lambda n: " ".join(rng.choice(stops) if rng.random() < 0.3 else f"w{rng.randint(0, 4000)}" for _ in range(n))
    rows = [(i, say(rng.randint(80, 300)), "en", f"s{i % 3}") for i in range(60)]
    near = rows[1][1].split()
    near[10] = "other"
    rows += [(100, rows[0][1], "en", "s0"), (101, " ".join(near), "en", "s1"), (102, "spam $$$ " * 40, "en", "s2"), (103, None, None, None), (104, "", "de", "s1"), (105, say(100) + " mail 10.1.2.3 and jo@mail.example.com", "en", "s1"), (106, "long " + say(9000), "en", None)]
    path = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies int")
    df.write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert ids["quality"] == {*range(60), 100, 101, 105, 106}
    assert ids["near_duplicates"] == {*range(60), 105, 106}
    text = seen["pii"].where("doc_id = 105").first().text
    assert "10.1.2.3" not in text and "jo@" not in text and "@" in text
    assert ids["packing"] == ids["mixing"] <= ids["pii"]
    words = seen["packing"].groupBy("sequence_id").sum("length").toPandas()
    assert words["sum(length)"].max() <= 4096


def test_run_is_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 60


def test_empty_table_passes(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
