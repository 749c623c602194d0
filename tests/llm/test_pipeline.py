import corpus_pipeline
from pathlore.llm import tokens

from .conftest import SF
from .test_decontaminate import brute as contained
from .test_line_dedup import brute as lines
from .test_near_dedup import brute as near


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF).persist()
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in rows}
            assert len(after) == len(rows)
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
            gone = before.keys() - after.keys()
            assert len(gone & toxic) > 0.8 * len(toxic) and after.items() <= before.items()
            clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
            assert len(gone & clean) <= 0.01 * len(clean)
        if name == "line_dedup":
            assert after == {k: v[0] for k, v in lines(list(before.items()), long_lines=True).items()}
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "near_dedup":
            assert after.keys() == {k for k, _, _, kept in near(list(before.items())) if kept}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert after.keys() == {k for k, found in contained(list(before.items()), items).items() if not found}
        if name == "packing":
            encode = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"), 1, True)
            assert sum(r.length for r in rows) == len(encode(before.values())[0])


def test_odd_rows_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).persist()
            assert docs.count() >= (5 if n else 0) and (n or not docs.count())
            assert docs.columns[:4] == odd.columns or "sequence_id" in docs.columns
