"""Posting lists in blocks, where a block holds more ids than a stored row."""

from pathlore.operators import postings


def test_a_block_is_one_row_if_so_asked(spark):
    rows = spark.range(2 * postings.BLOCK_MOST + 5).selectExpr("'gram2' AS kind", "'ab' AS key", "id")
    whole = postings.blocked(rows, 4, most=None).collect()
    assert [(r.block, r.n, r.ids == list(range(r.n))) for r in whole] == [(0, 2 * postings.BLOCK_MOST + 5, True)]
    assert sorted(r.n for r in postings.blocked(rows, 4).collect()) == [5, postings.BLOCK_MOST, postings.BLOCK_MOST]


def test_agg_postings_has_a_row_for_each_block(spark, monkeypatch):
    from pathlore.plans.queries import QUERIES

    monkeypatch.setattr(postings, "BLOCK_MOST", 4)
    out = QUERIES["agg_postings"](spark, "/root/testdata/sf0.001")
    assert out.groupBy("kind", "key", "block").count().where("count > 1").isEmpty()
    assert not out.where("n > 4").isEmpty()


def test_saved_postings_are_made_in_tasks_of_bounded_records(spark, tmp_path, monkeypatch):
    from pathlore.sources import catalog as ct

    monkeypatch.setattr(postings, "TASK_RECORDS", 50)
    listing = spark.range(220).coalesce(1).selectExpr("concat('/v/', id, '.txt') AS path", "id AS size", "false AS is_directory", "timestamp'2024-01-01' AS created_at", "timestamp'2024-01-01' AS modified_at")
    cat = ct.records(listing)
    got = postings.load_or_build(spark, f"file://{tmp_path}", cat)
    assert len(list((tmp_path / "postings" / "kind=exact").glob("part-*.parquet"))) == 5
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, postings.build(cat).collect()))
