"""Tokens of plain names by their characters, and a score that is made once for each pair."""

import random

from pyspark.sql import functions as F

from pathlore.functions import query as qy
from pathlore.functions import score
from pathlore.operators import search
from pathlore.plans import queries


def worth(text: str, words: list[str]) -> int | None:
    best = []
    for t in filter(None, text.split(" ")):
        hits = []
        for w in words:
            it = iter(w)
            if all(c in it for c in t):
                hits.append(max(1, 500 - 4 * (len(w) - len(t))))
        if not hits:
            return None
        best.append(max(hits))
    return 7200 + sum(best)


def test_tokens_equal_a_loop(spark):
    rng = random.Random(7)
    word = lambda letters, a, b: "".join(rng.choices(letters, k=rng.randrange(a, b)))
    rows = [(" ".join(word(letters, 1, 4) for _ in range(rng.randrange(1, 4))), [word(letters, 1, 9) for _ in range(rng.randrange(4))]) for letters in ("abc1", "abж1") for _ in range(300)]
    rows += [("aa", ["a"]), ("a", ["x" * 200 + "a"]), ("  a  ", ["ba"]), ("ab", ["ba", "acb"])]
    got = spark.createDataFrame(rows, "t string, w array<string>").select("t", "w", score.tokens(F.col("t"), F.col("w")).alias("s")).collect()
    assert sum(r.s is not None for r in got) > 100 and [r.s for r in got] == [worth(r.t, r.w) for r in got]


def test_a_score_is_made_once(spark):
    q = qy.parse(spark.createDataFrame([(1, "ring"), (2, "rd wdgt")], "query_id int, raw string"), queries.now())
    rows = search.scored(queries.catalog(spark, "/root/testdata/sf0.001").join(F.broadcast(q)))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("(9000 - ") == 1
    assert rows.count() > 0
