import zlib

import numpy as np

from pathlore.llm import quality as ql

from .conftest import SF


def test_op2_held_out_documents(spark):
    rows = {r.doc_id: r for r in ql.op2_quality(spark, SF).collect()}
    assert len(rows) == 1000
    for key, r in rows.items():
        assert r.held_out == (zlib.crc32(str(key).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(rows[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_contexts_equal_brute_force(spark):
    texts = ["a b c a", "the cat, sat sat on", "", "b a"]
    codes = spark.createDataFrame([(ql.terms(t)[0].tobytes(),) for t in texts], "codes binary").repartition(3)
    want = np.zeros((ql.TERMS, ql.DIM))
    for t in texts:
        own = ql.terms(t)[0].tolist()
        for i, a in enumerate(own):
            for j in range(max(0, i - ql.REACH), min(len(own), i + ql.REACH + 1)):
                if j != i:
                    want[a] += ql.INDEX[own[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(ql.word_vectors(codes)[:, ql.DIM :], want, atol=1e-5)


def test_network_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-2 * x[:, 0] * np.sign(x[:, 1])))
    net = ql.train(x, (rng.random(4000) < p).astype(int))
    got = net.probabilities(x)
    for low in np.arange(0, 1, 0.2):
        inside = (got >= low) & (got < low + 0.2)
        assert abs(got[inside].mean() - p[inside].mean()) < 0.08
    assert 0.25 <= net.temperature <= 8


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (2, None), (5, 0), (5, 1), (99, 1)], "doc_id long, quality int")
    out = ql.score_quality(odd, labels)
    assert out.columns == ["doc_id", "score", "predicted"] and out.count() == odd.count()
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert {r.score for r in ql.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert ql.score_quality(empty, labels).count() == 0
