"""Repeated runs of lines, found by winnowing over line hashes.

The fingerprint of a place is the hash of GRAM lines in a row. Of each WINDOW fingerprints in a row the least is
selected, so that every run of GRAM + WINDOW - 1 repeated lines shares selected fingerprints with its earlier copy. A
selected place is extended both ways: with the line before and with the line after it, it is a fingerprint too, and as
every line of such a run is in a selected place or beside one, all of them are found, wherever each has its first copy.
With long_lines each line of LEAST_CHARS characters or more is a fingerprint as well, alone or in a run. Places whose
fingerprint occurs earlier (by id, then line) cover lines; covered lines in a row are a run, which is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathlore.llm._common import bounded, packed, read, stored, text_or_empty, unpacked

GRAM, WINDOW = 2, 2
#: Runs of fewer characters stay, and shorter lines are no fingerprints of their own.
LEAST_CHARS = 50

#: The least of every window of places, each once: they ascend, so equal ones are neighbours.
_SELECTED = """
CASE WHEN size(hashes) < {gram} THEN cast(array() as array<struct<fp:bigint,pos:int>>)
ELSE transform(sequence(0, greatest(size(hashes) - {gram} + 1 - {window}, 0)),
       w -> array_min(transform(sequence(w, least(w + {window} - 1, size(hashes) - {gram})), p -> struct(xxhash64(slice(hashes, p + 1, {gram})) AS fp, p AS pos)))) END
"""
_ONCE = "filter(selected, (x, i) -> i = 0 OR x.pos != selected[i - 1].pos)"
#: Fingerprints (fp, low, high): selected places, the same with a line before or after, and long lines.
_PLACES = """
concat(
  transform(places, x -> struct(x.fp AS fp, x.pos AS low, x.pos + {gram} AS high)),
  transform(filter(places, x -> x.pos > 0), x -> struct(xxhash64(slice(hashes, x.pos, {gram} + 1)) AS fp, x.pos - 1 AS low, x.pos + {gram} AS high)),
  transform(filter(places, x -> x.pos + {gram} < size(hashes)), x -> struct(xxhash64(slice(hashes, x.pos + 1, {gram} + 1)) AS fp, x.pos AS low, x.pos + {gram} + 1 AS high)),
  transform(longs, i -> struct(xxhash64(slice(hashes, i + 1, 1)) AS fp, i AS low, i + 1 AS high)))
"""


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """_id, _lines and a key (k1, k2) that rows share only with repeats of themselves."""
    rows = docs.withColumns({"k1": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))), "_text": text_or_empty(F.col(f"`{text}`"))})
    return rows.withColumn("k2", F.xxhash64("_text")).withColumn("_lines", F.split("_text", "\n"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW, least_chars: int = LEAST_CHARS, long_lines: bool = False) -> DataFrame:
    """k1, k2 (a row's key) and runs (low, high: a line and the one after the last), ascending and apart."""
    # equal lines are equally long: spaces at the end don't count
    longs = f"filter(transform(_lines, (x, i) -> if(length(rtrim(x)) >= {least_chars}, i, -1)), i -> i >= 0)" if long_lines else "cast(array() as array<int>)"
    lines = _keyed(docs, id_col, text).select(
        "k1", "k2", F.transform("_lines", lambda x: F.xxhash64(F.rtrim(x))).alias("hashes"), F.transform("_lines", lambda x: F.length(x)).alias("chars"), F.expr(longs).alias("longs")
    )
    lines = stored(lines, "line-hashes")
    selected = lines.withColumn("selected", F.expr(_SELECTED.format(gram=gram, window=window))).withColumn("places", F.expr(_ONCE))
    found = selected.select("k1", "k2", "chars", F.explode(F.expr(_PLACES.format(gram=gram))).alias("s"))
    places = stored(found.select("k1", "k2", "s.fp", "s.low", F.expr("slice(chars, s.low + 1, s.high - s.low)").alias("chars")), "line-places")
    first = places.groupBy("fp").agg(F.min(F.struct("k1", "k2", "low")).alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
    sources = stored(first.select("fp", "src"), "line-sources")
    # of either size alike: a shuffled join whose hot fingerprints the adaptive planner splits
    later = places.join(sources, "fp").where(F.struct("k1", "k2", "low") > F.col("src"))
    covered = later.select("k1", "k2", "low", F.posexplode("chars").alias("i", "n")).select("k1", "k2", (F.col("low") + F.col("i")).alias("line"), "n").distinct()
    run = F.col("line") - F.row_number().over(Window.partitionBy("k1", "k2").orderBy("line"))
    runs = covered.withColumn("run", run).groupBy("k1", "k2", "run").agg(F.min("line").alias("low"), (F.max("line") + 1).alias("high"), F.sum("n").alias("chars"))
    return runs.where(F.col("chars") >= least_chars).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """docs with text lacking its repeated runs, and n_lines, n_removed; own columns of these names give way to them.

    Lines end at a line break and are equal when they are but for spaces at their ends. A run is deleted if it has at
    least LEAST_CHARS characters and each of its lines is in a selected place, alone or with a line beside it, that
    occurs earlier (also in the row itself), or is a long one that does (with long_lines). So all lines go of every run
    of GRAM + WINDOW - 1 lines with an earlier copy. What is left is joined by line breaks, and a row whose lines all go
    stays with an empty text. Earlier means a smaller id (null first), for rows of one id a smaller hash of the text,
    then an earlier line; rows that repeat id and text share their fate. Null texts are empty, and have no run. An empty
    table gives no rows.
    """
    runs = stored(repeated_runs(docs, id_col, text, **limits), "line-runs")
    keys = _keyed(docs.select(packed(docs), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text")
    rows = keys.join(bounded(runs), ["k1", "k2"], "left")
    kept = F.expr("array_except(sequence(0, size(_lines) - 1), flatten(transform(runs, r -> sequence(r.low, r.high - 1))))")
    rows = rows.withColumn("stay", F.when(F.col("runs").isNotNull(), kept))
    out = rows.withColumn("left", F.expr("transform(stay, i -> _lines[i])")).select(
        "_row",
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join("left", "\n")).alias(text),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_lines") - F.size("left"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return unpacked(out, docs.columns, [text, "n_lines", "n_removed"])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of lines in all documents."""
    out = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), long_lines=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), (F.col("n_removed") < F.col("n_lines")).alias("kept"))
