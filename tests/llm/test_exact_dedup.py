import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from pathlore.llm import exact_dedup
from pathlore.llm.exact_dedup import op3_exact_dedup

from .conftest import SF


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[norm(r.text)]
        keep = min((i for i in ids if i is not None), default=None) if len(ids) > 1 else r.doc_id
        out.append((r.doc_id, keep, len(ids), r.doc_id == keep))
    return out


def key(x):
    return tuple((v is not None, v) for v in x)


def test_op3_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = op3_exact_dedup(spark, SF).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == sorted(brute(docs))
    digests = {r.doc_id: hashlib.sha256(norm(r.text).encode()).hexdigest() for r in docs}
    assert {r.doc_id: r.text_sha256 for r in got} == digests


def test_odd_rows_with_and_without_broadcast(spark, odd, empty, monkeypatch):
    docs = odd.withColumnRenamed("score", "_len").collect()
    for limit in (exact_dedup.BROADCAST_ROWS, -1):
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", limit)
        named = odd.withColumnRenamed("score", "_len").withColumnRenamed("kept", "n").withColumns({c: F.lit(7) for c in ("least", "_again", "full_hash", "_prefix")})
        got = exact_dedup.exact_dedup(named).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=key) == sorted(brute(docs), key=key)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_full_hash_only_for_surviving_groups(spark):
    docs = spark.createDataFrame([(1, "a" * 80), (2, "a" * 79 + "b"), (3, "a" * 80), (4, "unique"), (5, "same length different".ljust(80, "!"))], "doc_id long, text string")
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert {i for i, r in got.items() if r.full_hash} == {1, 2, 3}
    assert [got[i].keep_id for i in range(1, 6)] == [1, 2, 1, 4, 5]
