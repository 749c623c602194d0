import random

import numpy as np

from pathlore.llm import toxicity as tx

from .conftest import SF


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = tx.train(docs, labels.where("doc_id % 4 != 2"))
    held = docs.join(labels.where("doc_id % 4 = 2").withColumnRenamed("toxic", "label"), "doc_id")
    got = tx.score(held, model, columns=["label"]).collect()
    caught = sum(r.toxic for r in got if r.label)
    assert caught >= 0.9 * sum(r.label for r in got)
    assert sum(r.toxic for r in got if not r.label) <= 0.005 * len(got)


def test_op4_scores_every_document(spark):
    rows = tx.op4_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(r.kept != r.toxic and 0 <= r.p_toxic <= 1 and 0 <= r.severity <= 3 for r in rows)


def test_ordinal_fit_shares_weights_and_orders_grades():
    rng = random.Random(4)
    rows, grade = [], []
    for _ in range(3000):
        bad = rng.choice([0, 0, 1, 3, 9])
        rows.append(tx.features(" ".join(["vile"] * bad + ["w%d" % rng.randrange(300) for _ in range(40)])))
        grade.append({0: 0, 1: 1, 3: 2, 9: 3}[bad])
    model = tx.fit(rows, np.array(grade))
    assert (np.diff(model.cuts) > 0).all()
    expected = model.grades(np.array([model.logit(r) for r in rows])) @ np.arange(4)
    assert np.abs(expected - grade).mean() < 0.2


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tx, "MEMO_WORDS", 50)
    memory = tx.Words()
    before = [tx.features("alpha beta %d" % i, memory) for i in range(3)]
    for i in range(300):
        tx.features("x%d" % i, memory)
        assert len(memory) < 60
    for i, (slots, values) in enumerate(before):
        again = tx.features("alpha beta %d" % i, memory)
        assert (again[0] == slots).all() and (again[1] == values).all()


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (2, None), (5, 0)], "doc_id long, toxic int")
    model = tx.train(odd, labels)
    out = tx.score(odd.withColumnRenamed("score", "toxic"), model)
    assert out.columns == ["doc_id", "text", "kept", "severity", "p_toxic", "toxic"]
    assert out.count() == odd.count()
    assert not any(r.toxic for r in out.collect() if not (r.text or "").strip())
    assert tx.score(empty, tx.train(empty, labels)).count() == 0
    assert tx.score(odd, tx.train(odd, labels.limit(0))).where("toxic").count() == 0


def test_several_labels_of_an_id(spark):
    """The largest counts, in whatever order they come: the model is one and the same."""
    docs = spark.createDataFrame([(i, ("bad word " if i % 3 == 0 else "fine text ") * (1 + i % 4)) for i in range(90)], "doc_id long, text string")
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(i, 0) for i in range(0, 90, 2)] + [(None, 1), (1, None)]
    once = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    want = tx.train(docs, once)
    for rows in (labels, labels[::-1]):
        model = tx.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int").repartition(5))
        assert model.slots.tolist() == want.slots.tolist() and abs(model.weights - want.weights).max() < 1e-9
