"""score.fuzzy() against a plain loop over characters, and its query in even tasks."""

import random
import re

from pyspark.sql import functions as F

from pathlore.functions import score
from pathlore.plans import queries
from pathlore.sources import catalog as ct


def greedy(q: str, c: str) -> int | None:
    i, s, last, first = 0, 0, -2, -1
    for at, ch in enumerate(c):
        if i < len(q) and q[i] == ch:
            s += 100 + (80 if at == last + 1 else 0) + (60 if at == 0 or not c[at - 1].isalnum() else 0)
            i, last, first = i + 1, at, at if first < 0 else first
    return max(s - min(8 * first, 500) - min(len(c) - len(q), 500), 1) if i == len(q) else None


def test_greedy_places_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices("abж .-1", k=rng.randrange(2, 5))), "".join(rng.choices("abcж .-1", k=rng.randrange(2, 30)))) for _ in range(400)]
    rows = [(q, c) for q, c in rows if q not in c and not re.search(r"\s\Z", q)]
    got = spark.createDataFrame(rows, "q string, c string").select("q", "c", score.fuzzy(F.col("q"), F.col("c")).alias("s")).collect()
    assert sum(r.s is not None for r in got) > 50 and [r.s for r in got] == [greedy(r.q, r.c) for r in got]


def test_score_fuzzy_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ct, "TASK_RECORDS", 50)
    rows = queries.QUERIES["score_fuzzy"](spark, "/root/testdata/sf0.01")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 8
