"""Batch search: a table of queries against a catalog, the best rows of each.

Two plans give the same rows. The posting plan turns each query into a few posting keys and joins them; the scan plan
scores every record against every query, which is best for few queries. A query whose text is some record's whole
alias sees those records alone (mode ``reference``); ``exhaustive`` skips that and lets queries of filters alone answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.functions import score
from pathlore.functions import text as tx
from pathlore.functions.query import passes
from pathlore.operators.postings import KINDS, aliases, build, frequencies, intersect, of_keys
from pathlore.sources.work import written

CAP, LIMIT = 20_000, 100
#: Queries that may be broadcast, and characters of queries whose keys may be; counted first.
BROADCAST_QUERIES, BROADCAST_CHARACTERS = 20_000, 400_000


def small(table: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """table, marked for broadcast if it, or the queries that it has at most so many rows for each of, are counted to be few."""
    if queries is None:
        return F.broadcast(table) if table.count() <= BROADCAST_QUERIES else table
    if getattr(queries, "characters", None) is None:  # counted once for a table of queries
        queries.characters = queries.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    return F.broadcast(table) if queries.characters <= BROADCAST_CHARACTERS else table


def asked(queries: DataFrame) -> DataFrame:
    """kind, key: all posting keys that lookups() and routes() can ask for, whatever the corpus holds."""
    firsts = F.transform(F.filter(F.split("text", " "), lambda t: t != ""), lambda t: F.get(tx.graphemes(t), F.lit(0)))
    whole = F.array("text")
    keys = {"exact": whole, "prefix1": whole, "gram2": whole, "gram3": tx.grams(F.col("text"), 3), "char": firsts, "extension": F.array("ext")}
    of = lambda kind: F.transform(keys[kind], lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    told = F.concat(*map(of, keys))
    return queries.select(F.explode(told).alias("k")).select("k.*").where("key != ''").distinct()


def only(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """Postings of those keys (kind, key), of a batch that makes them for itself: the others would be dealt and written
    for nobody."""
    return postings.join(small(keys), ["kind", "key"], "left_semi")


def asked_postings(catalog: DataFrame, keys: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """only() of a catalog's postings of those kinds. If keys are counted to be few, no other postings are made."""
    n, characters = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    if n <= BROADCAST_QUERIES and characters <= BROADCAST_CHARACTERS:
        return of_keys(catalog, [(r["kind"], r["key"]) for r in keys.where(F.col("kind").isin(*kinds)).collect()])
    return only(build(catalog, kinds), keys)


def lookups(queries: DataFrame, postings: DataFrame, rarest: bool = True) -> DataFrame:
    """query_id, route, kind, key, need: the posting keys of each query and how many of them a record must have.

    rarest: of a text of three or more characters only the gram with the shortest list is looked up, scoring does the
    rest; without it all of its grams are, and a record needs them all.
    """
    q = queries.withColumn("n", tx.n_graphemes(F.col("text")))
    by_text = q.where(F.col("ext").isNull() & (F.col("text") != ""))
    known = postings.where("kind = 'exact'").select("key").join(small(by_text.select(F.col("text").alias("key")).distinct(), queries), "key", "left_semi").distinct()
    exact = by_text.join(known.select(F.col("key").alias("text"), F.lit(True).alias("is_exact")), "text", "left")
    rest = exact.where("is_exact is null")
    one = lambda df, route, kind, key: df.select("query_id", F.lit(route).alias("route"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(1).cast("long").alias("need"))
    single = rest.where(~F.col("text").contains(" "))
    firsts = rest.where(F.col("text").contains(" ")).select(
        "query_id", F.explode(F.array_distinct(F.transform(F.filter(F.split("text", " "), lambda t: t != ""), lambda t: F.get(tx.graphemes(t), F.lit(0))))).alias("key")
    )
    # characters and grams that the corpus knows, with the lengths of their lists; few keys, pre-aggregated
    wanted = firsts.select(F.lit("char").alias("kind"), "key").unionByName(
        single.where("n >= 3").select(F.lit("gram3").alias("kind"), F.explode(tx.grams(F.col("text"), 3)).alias("key"))
    ).distinct()
    df = frequencies(postings.join(small(wanted, queries), ["kind", "key"], "left_semi"))
    chars = firsts.join(df.where("kind = 'char'").select("key"), "key")
    per_query = chars.withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    tokens = per_query.select("query_id", F.lit("tokens").alias("route"), F.lit("char").alias("kind"), "key", "need")
    gram = single.where("n >= 3").select("query_id", F.explode(tx.grams(F.col("text"), 3)).alias("key"))
    gram = gram.join(df.where("kind = 'gram3'").select("key", "df"), "key", "left")
    whole = Window.partitionBy("query_id")
    gram = gram.withColumns({"absent": F.sum(F.when(F.col("df").isNull(), 1).otherwise(0)).over(whole), "need": F.count(F.lit(1)).over(whole), "place": F.row_number().over(whole.orderBy("df", "key"))})
    grams = gram.where("absent = 0").select("query_id", F.lit("trigram").alias("route"), F.lit("gram3").alias("kind"), "key", (F.lit(1).cast("long") if rarest else F.col("need")).alias("need"), "place")
    if rarest:
        grams = grams.where("place = 1")
    return (
        one(q.where(F.col("ext").isNotNull()), "extension", "extension", F.col("ext"))
        .unionByName(one(exact.where("is_exact"), "exact", "exact", F.col("text")))
        .unionByName(one(single.where("n = 1"), "prefix-1", "prefix1", F.col("text")))
        .unionByName(one(single.where("n = 2"), "bigram", "gram2", F.col("text")))
        .unionByName(tokens).unionByName(grams.drop("place"))
    )


def routes(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, route: how each query is looked up; a two-character text that no alias contains goes by prefix-2."""
    found = lookups(queries, postings).select("query_id", "route").distinct()
    known = postings.where("kind = 'gram2'").select("key").join(small(queries.select(F.col("text").alias("key")).distinct(), queries), "key", "left_semi").distinct()
    labelled = queries.join(found, "query_id", "left").join(known.select(F.col("key").alias("text"), F.lit(True).alias("has_bigram")), "text", "left")
    text = F.col("text")
    route = (
        F.when(F.col("ext").isNotNull(), "extension").when(text == "", "empty").when((F.col("route") == "bigram") & F.col("has_bigram").isNull(), "prefix-2")
        .when(F.col("route").isNotNull(), F.col("route")).when(F.trim(text) == "", "tokens-empty").when(text.contains(" "), "tokens-none").otherwise("no-gram")
    )
    return labelled.select("query_id", route.alias("route"))


def candidates(queries: DataFrame, postings: DataFrame, rarest: bool = True) -> DataFrame:
    """query_id, id: records that a query's posting keys lead to, of postings in long form or in blocks. Few queries of
    one key need no shuffle."""
    keys = small(lookups(queries, postings, rarest), queries)
    if "ids" in postings.columns:
        single = postings.join(keys.where("need = 1"), ["kind", "key"]).select("query_id", F.explode("ids").alias("id"))
        return single.unionByName(intersect(keys.where("need > 1"), postings))
    hits = postings.join(keys, ["kind", "key"])
    single = hits.where("need = 1").select("query_id", "id")
    several = hits.where("need > 1").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n = need").select("query_id", "id")
    return single.unionByName(several)


def capped(found: DataFrame, catalog: DataFrame, cap: int = CAP) -> DataFrame:
    """The first ``cap`` candidates of each query in path order, and whether there were more. Off in search().

    Candidates are dealt by ranges of (query, path), so that a query which meets all records is in many tasks. The
    counts of ranges tell where each begins within its query: ranges past the cap are left out unsorted, and only the
    others are ranked, each by itself.
    """
    ranges = written(found.join(catalog.select("id", "path"), "id").repartitionByRange("query_id", "path", "id").withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("query_id", "range").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("query_id")
    # a query has a row for each of its ranges, of which there are as many as tasks
    begins = counts.withColumns({"before": F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), "truncated": F.sum("n").over(own) > cap})
    begins = begins.withColumn("before", F.coalesce("before", F.lit(0).cast("long"))).where(F.col("before") < cap).drop("n")
    within = Window.partitionBy("query_id", "range").orderBy("path", "id")
    return ranges.join(begins, ["query_id", "range"]).withColumn("rn", F.row_number().over(within) + F.col("before")).where(F.col("rn") <= cap).select("query_id", "id", "truncated")


def scored(rows: DataFrame) -> DataFrame:
    """Rows that pass their query's filters, with their score; those without one drop. Rows may bring their name's words."""
    words = F.col("words") if "words" in rows.columns else tx.words(F.col("normalized_name"))
    # exploded, so that a score is made once: a test of a column is also made below it, with the score anew
    known = F.filter(F.array(score.name_score(F.col("text"), words)), lambda s: s.isNotNull())
    return rows.where(passes()).select("*", F.explode(known).alias("score"))


def ranked(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best ``limit`` of each query: score, shorter name, directories first, path in natural order.

    First by score and name length alone, within shares of a query, so that a hot query meets in one task only with
    the rows that can still be among the best.
    """
    rows = rows.withColumn("name_len", tx.n_graphemes(F.col("name")))
    cheap = [F.desc("score"), "name_len", F.desc("is_directory")]
    share = Window.partitionBy("query_id", "share").orderBy(*cheap)
    kept = rows.withColumn("share", F.pmod(F.xxhash64("path"), F.lit(64))).withColumn("r", F.rank().over(share)).where(F.col("r") <= limit).drop("r", "share")
    final = Window.partitionBy("query_id").orderBy(*cheap, tx.natural_key(F.col("normalized_path")), "path")
    return kept.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit)


def extension_early(queries: DataFrame, catalog: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Queries of an extension alone: the first ``limit`` records in path order, then ranked."""
    pure = queries.where("ext is not null and text = '' and path_contains is null and kind is null and min_size is null and max_size is null and modified_after is null")
    hits = catalog.where("not is_directory").join(small(pure), catalog["file_extension"] == pure["ext"])
    first = hits.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("path"))).where(F.col("rn") <= limit).drop("rn")
    return ranked(scored(first), limit)


def search(queries: DataFrame, catalog: DataFrame, postings: DataFrame, limit: int = LIMIT) -> DataFrame:
    """query_id, rank, score and the catalog's columns, by the posting plan. A catalog that is bucketed by id stays where
    it is: candidates alone are dealt."""
    hits = candidates(queries, postings).join(catalog, "id").join(small(queries), "query_id")
    return ranked(scored(hits), limit).select("query_id", "rank", "score", *catalog.columns)


def allowed(q_text: Column) -> Column:
    """The route of the posting plan as a predicate on a record's aliases (column ``a``); a query brings its grams, and
    of its tokens' first graphemes those that the corpus knows (``known``)."""
    has = lambda test: F.exists("a", test)
    return (
        F.when(F.col("ext").isNotNull(), (F.col("file_extension") == F.col("ext")) & ~F.col("is_directory"))
        .when(q_text == "", F.lit(False)).when(F.col("is_exact"), F.array_contains("a", q_text))
        .when(q_text.contains(" "), (F.size("known") > 0) & F.forall("known", lambda k: has(lambda x: x.startswith(k))))
        .when(F.col("n") == 1, has(lambda x: x.startswith(q_text))).when(F.col("n") == 2, has(lambda x: x.contains(q_text)))
        .otherwise(F.forall("grams", lambda g: has(lambda x: x.contains(g))))
    )


def search_scan(queries: DataFrame, catalog: DataFrame, limit: int = LIMIT, mode: str = "reference") -> DataFrame:
    """The same by one scan: every record meets every query, which are a stated set of BROADCAST_QUERIES at most, else
    an error says so. exhaustive: every record may match, whatever the route."""
    if queries.count() > BROADCAST_QUERIES:
        raise ValueError(f"search_scan() is for {BROADCAST_QUERIES} queries at most; search() takes any number")
    rows = catalog.withColumns({"a": aliases(), "words": tx.words(F.col("normalized_name"))})
    q = queries.withColumns({"n": tx.n_graphemes(F.col("text")), "grams": tx.grams(F.col("text"), 3)})
    if mode == "exhaustive":
        pairs = rows.join(small(q.where("ext is not null or text != '' or kind is not null or path_contains is not null or min_size is not null or max_size is not null or modified_after is not null")))
        return ranked(scored(pairs), limit).select("query_id", "rank", "score", *catalog.columns)
    keys = rows.select(F.explode("a").alias("alias"))
    exact = keys.join(small(q.select(F.col("text").alias("alias")).distinct(), queries), "alias", "left_semi").distinct().select(F.col("alias").alias("text"), F.lit(True).alias("is_exact"))
    firsts = q.select("query_id", F.explode(F.array_distinct(F.transform(F.filter(F.split("text", " "), lambda t: t != ""), lambda t: F.get(tx.graphemes(t), F.lit(0))))).alias("ch"))
    first_of = keys.select(tx.head(F.col("alias"), 1).alias("ch")).distinct()
    known = firsts.join(first_of, "ch").groupBy("query_id").agg(F.collect_set("ch").alias("known"))
    told = q.join(exact, "text", "left").join(known, "query_id", "left").withColumns({"is_exact": F.coalesce("is_exact", F.lit(False)), "known": F.coalesce("known", F.array().cast("array<string>"))})
    pairs = rows.join(small(told)).where(allowed(F.col("text")))
    return ranked(scored(pairs), limit).select("query_id", "rank", "score", *catalog.columns)


def diagnostics(queries: DataFrame, catalog: DataFrame, postings: DataFrame) -> DataFrame:
    """Counts, route and flags of each query."""
    total = catalog.agg(F.count(F.lit(1)).alias("total_entries"))
    found = candidates(queries, postings, rarest=False).groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    told = routes(queries, postings).join(found, "query_id", "left").crossJoin(F.broadcast(total)).withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    examined = F.least("candidates", F.lit(CAP))
    return told.select(
        "query_id", "route", "total_entries", "candidates", examined.alias("examined"), (F.col("candidates") > CAP).alias("truncated"),
        ((examined >= F.col("total_entries")) & (F.col("total_entries") > 10_000)).alias("full_scan"),
    )
