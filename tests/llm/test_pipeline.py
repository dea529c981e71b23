"""Stages on their own input: decisions take effect, columns stay, clean documents stay.

The classifier of the first stage is tested in test_ops, its decisions here at the end.
"""

import random

import corpus_pipeline
from clipwright.llm import toxicity


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    common = "This line is repeated in a good many documents of the corpus"
    item = " ".join(f"item{i}" for i in range(30))

    def prose(n):
        return " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))

    texts = {i: f"{prose(60)}\n{common}\n{prose(60)}" for i in range(12)}
    texts |= {20: prose(80), 21: None, 22: "", 30: f"{prose(40)} {item} {prose(40)}"}
    texts[40] = texts[20] + " more"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, left = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        left[name] = {r["doc_id"]: r for r in docs.collect()}
        if i < len(corpus_pipeline.STAGES) - 2:
            assert docs.columns == columns
    clean = set(texts)
    assert set(left["line dedup"]) == clean
    assert [i for i in range(12) if common in left["line dedup"][i]["text"]] == [11]
    assert all(r["n_chars"] == len(r["text"] or "") for r in left["line dedup"].values())
    assert set(left["n-gram jaccard"]) == clean - {40}
    assert set(left["decontamination"]) == clean - {40, 30}
    assert set(left["sentencepiece"]) == clean - {40, 30}
    assert left["sentencepiece"][22]["n_tokens"] == 0


def test_toxic_documents_go(spark, tmp_path):
    """The first stage on its own input: what the classifier predicts toxic goes, all else stays whole."""
    rng = random.Random(12)
    texts = {}
    for i in range(300):
        body = ["".join(rng.choices(["ta", "ri", "mo", "le"], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 60))]
        for _ in range(4 if i % 4 == 0 else 0):
            body.insert(rng.randrange(len(body)), rng.choice(["horrible", "dreadful"]))
        texts[i] = " ".join(body)
    rows = [(i, t, "en", "s", len(t), "x") for i, t in texts.items()] + [(1000, None, None, None, None, None), (1001, "", "en", "s", 0, "x"), (None, texts[1], "en", "s", 1, "x"), (2, texts[2], "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(200)] + [(None, 1, None), (3, None, 1)], "doc_id long, toxic int, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    said = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert sorted(map(str, got)) == sorted(str((i, t)) for i, t, *_ in rows if not said[i])
    ids = [i for i, _ in got]
    assert {1000, 1001, None} <= set(ids) and ids.count(2) == 2
    assert sum(i % 4 == 0 for i in ids if i is not None and i < 300) <= 4 and sum(i % 4 > 0 for i in ids if i is not None and i < 300) >= 220
    assert corpus_pipeline.drop_toxic(spark, docs.limit(0), str(tmp_path)).collect() == []
