import random
import re

import numpy as np
import pytest

from pathlore.llm import near_dedup as nd
from pathlore.llm import shingles
from pathlore.llm._common import stored
from pathlore.llm.components import components
from pathlore.llm.near_dedup import likely_jaccard, near_decisions, op9_near_dedup, registers

from .conftest import SF


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """(id, text) -> sorted (id, n_shingles, component_id, kept)."""
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in index[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, both in common.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), key) if x is not None), default=None)
    return sorted(((k, len(s), least[find(i)], k == least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_op9_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(op9_near_dedup(spark, SF)) == brute(docs)


def copies(seed, n, base_words=60, groups=3):
    """Groups of near copies, whose edits make similarities about the limit, and one passage that all texts share."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    passage = [word() for _ in range(25)]
    bases = [[word() for _ in range(base_words)] for _ in range(groups)]
    out = []
    for i in range(n):
        text = list(bases[i % groups])
        for _ in range(rng.randrange(5)):
            text[rng.randrange(len(text))] = word()
        if i % 4 == 0:
            text = [word() for _ in range(30)]
        out.append((i, " ".join(text[:30] + passage + text[30:])))
    return out


@pytest.mark.parametrize(("small", "rounds"), [(32, 2), (3, 1), (0, 0)])
def test_groups_of_copies_lose_no_link(spark, monkeypatch, small, rounds):
    monkeypatch.setattr(nd, "SMALL_GROUP", small)
    monkeypatch.setattr(nd, "ROUNDS", max(1, rounds))
    if not rounds:  # no pair that a leader makes is thought likely, so that groups are compared as they are
        monkeypatch.setattr(nd._Links, "verified", lambda self, pairs, texts: self.keep(pairs.limit(0), "none"))
    rows = copies(small, 240)
    rows += rows[::7]  # repeated rows lose none either
    assert got(near_decisions(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


@pytest.mark.parametrize("with_base", [True, False])
def test_a_star_of_copies(spark, with_base):
    """Copies that are near one text, but not near each other; and the same without that text."""
    rng = random.Random(11)
    base = ["b%d" % i for i in range(100)]
    rows = [(5, " ".join(base)), (5, " ".join(base))] if with_base else []
    for i in range(10, 610):
        text = list(base)
        for at in rng.sample(range(100), 2 if i % 3 else 4):
            text[at] = "x%d-%d" % (i, at)
        rows.append((i, " ".join(text)))
    assert got(near_decisions(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


def test_groups_find_every_similar_pair(spark):
    """One group, no buckets, no leaders: what in_groups() links connects what links of any pair connect."""
    rows = copies(5, 90)
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string")
    keyed = docs.selectExpr("doc_id AS node", "doc_id AS k1", "xxhash64(text) AS k2")
    finder = nd._Links(docs.selectExpr("doc_id AS k1", "xxhash64(text) AS k2", "text"), keyed.distinct())
    nodes = stored(keyed.selectExpr("node", "node AS label", "0L AS grp", "90L AS members").distinct(), "nodes")
    found = finder.in_groups(nodes, finder.texts_of(nodes.select("node").transform(lambda t: stored(t, "nodes"))))
    links = found[0].unionByName(found[1])
    sets = [sets_of(t) for _, t in rows]
    similar = lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    pairs = {tuple(sorted(r)) for r in links.collect()}
    assert pairs and all(similar(*p) for p in pairs)
    label = {r.node: r.label for r in components(links).collect()}
    want = [(i, j) for i in range(90) for j in range(i + 1, 90) if similar(i, j)]
    assert want and all(label[i] == label[j] for i, j in want)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(near_decisions(odd)) == brute(rows)
    full = nd.near_dedup(odd)
    assert full.columns == ["doc_id", "text", "score", "n_shingles", "component_id", "kept"]
    assert full.count() == len(rows)
    assert nd.near_dedup(empty).count() == 0


def test_likelihood_estimates_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.75, 0.9):
        pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        both = int(share * 2000)
        a, b = pool[:2000], pool[2000 - both : 4000 - both]
        r = registers(shingles.minima([a, b], 1024)).astype(int)
        est = likely_jaccard(np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()]), np.array([2000.0]), np.array([2000.0]), 1024)[0]
        assert abs(est - both / (4000 - both)) < 0.06


def test_registers_of_a_union_are_the_larger():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**63, (2, 300), dtype=np.uint64)
    r = registers(shingles.minima([a, b, np.concatenate([a, b])], 64))
    assert (np.maximum(r[0], r[1]) == r[2]).all()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
