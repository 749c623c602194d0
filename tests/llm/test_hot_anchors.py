"""A phrase that very many rows have among different text: right results, and no shard with all of its contexts."""

import random

import pytest
from pyspark.sql import functions as F

from pathlore.llm import substring_dedup as sd
from pathlore.llm.substring_dedup import remove_repeats

from .test_substring_dedup import brute, digest


@pytest.mark.parametrize("phrase", ["The terms of this licence hold for all", "The terms of this licence hold for all of these documents.", "=" * 70])
def test_a_common_phrase_is_split_over_shards(spark, monkeypatch, phrase):
    found = sd._shared_anchors
    monkeypatch.setattr(sd, "_shared_anchors", lambda homes, *most: found(homes, *(100 for _ in most)))
    rng = random.Random(4)
    own = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    ends = [own(40) for _ in range(30)]
    rows = [(rng.randrange(1000), own(rng.randrange(60)) + phrase + (own(40) if rng.random() < 0.7 else rng.choice(ends))) for _ in range(1200)]
    rows += [(2000, phrase * 40), (None, phrase + ends[0]), (2001, "x" * 900), (2002, "x" * 70), (2003, own(90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    frame, sizes = type(docs), []
    group, calls = frame.groupBy, []

    def once(self, *cols):
        if cols == ("part",) and "low" in self.columns and not calls:
            calls.append(1)
            sizes.extend(r.n for r in group(self, "part").agg(F.sum(F.octet_length("data")).alias("n")).collect() if r.n)
        return group(self, *cols)

    monkeypatch.setattr(frame, "groupBy", once)
    out = digest(remove_repeats(docs))
    monkeypatch.undo()
    assert out == brute(rows)
    assert max(sizes) < 0.4 * sum(sizes)


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(sd, "SHARD_BYTES", 8000)
    rng = random.Random(4)
    own = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    ends = [own(40) for _ in range(30)]
    rows = [(rng.randrange(1000), own(rng.randrange(60)) + "=" * rng.randrange(49, 121) + (own(40) if rng.random() < 0.7 else rng.choice(ends))) for _ in range(1200)]
    rows += [(2000, "=" * 2800), (None, "=" * 70 + ends[0]), (2001, "x" * 900), (2002, "x" * 70), (2003, own(90))]
    assert digest(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == brute(rows)
