import random

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from pulso.llm import phrases, secrets_cnn, toxicity

from .helpers import documents, prose
from .test_minhash import brute as classes_of
from .test_minhash import classes, near, shingle_set, small_pairs
from .test_phrases import brute as phrases_of
from .test_toxicity import label_rows, texts_of


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables of all the pipeline's cases, nulls and an extra column included."""
    rnd = random.Random(20)
    path = str(tmp_path_factory.mktemp("tables"))
    texts, labels = texts_of(rnd, 260)
    bench = [(k, prose(rnd, 25, 300)) for k in range(5)] + [(9, None)]
    for i in range(60):
        base = prose(rnd, 150, 4000)
        texts += [base, near(rnd, base, 2)] if i % 3 == 0 else [base]
    texts += [f"{prose(rnd, 20)} {rnd.choice(bench[:5])[1]} {prose(rnd, 20)}" for _ in range(10)]
    texts += [f'{prose(rnd, 20)} token = "{rnd.randrange(16**40):040x}" {prose(rnd, 9)}' for _ in range(20)]
    texts += [None, "", "  ", "w1", prose(rnd, 5000, 8000)]
    documents(spark, texts).write.parquet(f"{path}/documents.parquet")
    label_rows(spark, labels).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, bench


def test_pipeline_equals_brute_force(spark, tables):
    path, texts, bench = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    ids = [i for i in range(len(texts)) if i not in rejected]
    assert 20 < len(rejected) < 150
    ids = [ids[i] for i, _, c in classes_of([texts[i] for i in ids]) if i == c]
    hits = phrases_of([texts[i] for i in ids], bench)
    ids = [i for i, (_, n_hit, _) in zip(ids, hits) if not n_hit]
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in rows} == set(ids)
    kept = {i: texts[i] for i in ids}
    stage = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in secrets_cnn.redact(stage, secrets_cnn.train(docs.where(
        docs.doc_id.isin(ids)))).collect()}
    assert sum("[SECRET]" in (t or "") for t in clean.values()) >= 15
    for i, t in clean.items():
        assert sum(r.n_words for r in rows if r.doc_id == i) == len((t or "").split())
    fill = {}
    for r in rows:
        if r.bin_id is not None:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_words
    assert max(fill.values()) <= 2048


def test_near_duplicate_stage_equals_brute_force_at_080(spark, tables):
    """Copies at and around 0.8: short, and as long as sketches are compared."""
    rnd = random.Random(21)
    texts = small_pairs(rnd, 80, 100, 150)
    for _ in range(60):
        base = prose(rnd, 200, 9000)
        texts += [base, near(rnd, base, rnd.randrange(3, 6))]
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert sum(100 * len(sets[i] & sets[j]) < 85 * len(sets[i] | sets[j]) for i, j in links) >= 20
    kept = sorted(i for i, c in classes(range(len(sets)), links).items() if i == c)
    out = corpus_pipeline.drop_near_duplicates(spark, documents(spark, texts), tables[0])
    assert sorted(r.doc_id for r in out.collect()) == kept


def test_stages_keep_the_columns_and_stand_empty_tables(spark, tables):
    path, *_ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.collect() == []
        if name != "packing":
            assert out.columns == docs.columns


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert phrases.ORACLE in entry.oracle_sql().values()


def test_secrets_stage_trains_for_every_round_at_every_size(spark, tables, monkeypatch):
    """Before, the stage trained for one round instead of all on more than 24,576 findings."""
    rnd = random.Random(22)
    texts = [" ".join(f"{rnd.getrandbits(128):032x} Site{rnd.getrandbits(40):013d}" for _ in range(500)) for _ in range(36)]
    rounds = []
    monkeypatch.setattr(secrets_cnn, "_round", lambda rows, model, weights, number: (rounds.append(rows.count()), model.flat())[1])
    out = corpus_pipeline.redact_secrets(spark, documents(spark, texts), tables[0])
    assert len(rounds) == secrets_cnn.EPOCHS == 6 and min(rounds) > 24576
    assert out.where("text LIKE '%[SECRET]%'").count() == 36
