import random

import pytest
import xxhash

from pathlore.llm.line_dedup import line_dedup

from .conftest import SF


def long_hash(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def line_hash(line):
    h = xxhash.xxh64_intdigest(line.rstrip(" ").encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def brute(rows, gram=2, window=2, least=50, long_lines=False):
    """(id, text) with distinct ids -> {id: (text, lines, removed)}."""
    docs = {k: (t or "").split("\n") for k, t in rows}
    places = []
    for k, v in docs.items():
        h = [line_hash(x) for x in v]
        grams = [(long_hash(h[i : i + gram]), i) for i in range(len(h) - gram + 1)]
        for p in {min(grams[w : w + window])[1] for w in range(max(1, len(grams) - window + 1)) if grams}:
            places += [(tuple(h[a:b]), k, a, b) for a, b in ((p, p + gram), (p - 1, p + gram), (p, p + gram + 1)) if a >= 0 and b <= len(h)]
        if long_lines:
            places += [((h[i],), k, i, i + 1) for i, x in enumerate(v) if len(x.rstrip(" ")) >= least]
    first = {}
    for fp, k, a, _ in places:
        first[fp] = min(first.get(fp, (k, a)), (k, a))
    covered = {k: set() for k in docs}
    for fp, k, a, b in places:
        if first[fp] < (k, a):
            covered[k] |= set(range(a, b))
    texts, out = dict(rows), {}
    for k, v in docs.items():
        gone, run = set(), []
        for i in range(len(v) + 1):
            if i in covered[k]:
                run.append(i)
            else:
                if sum(len(v[j]) for j in run) >= least:
                    gone |= set(run)
                run = []
        out[k] = ("\n".join(x for i, x in enumerate(v) if i not in gone) if gone else texts[k], len(v), len(gone))
    return out


def got(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in df.collect()}


@pytest.mark.parametrize("long_lines", [False, True])
def test_documents_equal_brute_force(spark, long_lines):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()], long_lines=long_lines)
    assert got(line_dedup(docs, long_lines=long_lines)) == want
    assert sum(n for *_, n in want.values()) > 50


@pytest.mark.parametrize(("gram", "window"), [(2, 2), (1, 1), (1, 3), (3, 4)])
def test_random_lines_equal_brute_force(spark, gram, window):
    rng = random.Random(gram * 10 + window)
    pool = ["line number %d of the pool, of some length" % i for i in range(12)] + ["", "short"]
    rows = [(i, "\n".join(rng.choice(pool) + " " * rng.randrange(2) for _ in range(rng.randrange(14)))) for i in range(60)]
    rows.append((99, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(line_dedup(docs, gram=gram, window=window)) == brute(rows, gram, window)


def test_long_repeated_runs_are_found(spark):
    rng = random.Random(2)
    own = lambda: "%030x of this text alone" % rng.getrandbits(120)
    run = [own() for _ in range(3)]
    rows = [(i, "\n".join([own(), *run, own()])) for i in range(30)]
    out = got(line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out[0][2] == 0 and all(out[i][2] == 3 for i in range(1, 30))


def test_runs_are_found_whole_wherever_their_parts_occur_first(spark):
    """Every line of three or more repeated in a row goes, also where single pairs of them occur in other texts before."""
    rng = random.Random(8)
    own = lambda: "%030x alone" % rng.getrandbits(120)
    rows, n = [], 0
    for _ in range(40):
        run = [own() for _ in range(rng.randrange(3, 9))]
        for i in range(len(run) - 1):  # pairs come first, each in a text of its own
            if rng.random() < 0.5:
                rows.append((n := n + 1, "\n".join([own(), *run[i : i + 2], own()])))
        rows += [(n := n + 1, "\n".join([own(), *run, own()])), (n := n + 1, "\n".join([own(), own(), *run]))]
        rows.append((n := n + 1, "\n".join([*run, own()])))
    out = got(line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)))
    assert out == brute(rows)
    seen = set()
    for k, text in rows:
        lines = text.split("\n")
        threes = [tuple(lines[i : i + 3]) for i in range(len(lines) - 2)]
        again = {i + j for i, t in enumerate(threes) if t in seen for j in range(3)}
        assert not {lines[i] for i in again} & set(out[k][0].split("\n"))
        seen |= set(threes)


def test_a_text_of_very_many_lines(spark):
    """The work grows with the lines, not with their square."""
    lines = ["line %d of a very long text, of some length of its own" % i for i in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["own", *lines[::-1], *lines[10_000:50_000]]))]
    out = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), long_lines=True).collect()}
    assert out == {1: (60_000, 0), 2: (100_001, 100_000)}


def test_odd_rows(spark, odd, empty):
    out = line_dedup(odd.withColumnRenamed("score", "n_lines").withColumnRenamed("kept", "runs"))
    assert out.columns == ["doc_id", "runs", "text", "n_lines", "n_removed"]
    assert out.count() == odd.count() and out.where("n_removed > 0").count() == 0
    assert line_dedup(empty).count() == 0
