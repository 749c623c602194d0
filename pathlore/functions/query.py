"""Search strings to query columns, by built-in functions over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.functions.text import byte_size, normalize

#: The kinds a query can ask for, with the extensions that belong to them.
KINDS = {
    "image": ["png", "jpg", "jpeg", "gif", "webp", "heic", "tiff", "svg"],
    "video": ["mp4", "mov", "m4v", "avi", "mkv", "webm"],
    "audio": ["mp3", "m4a", "wav", "aac", "flac", "aiff"],
    "document": ["pdf", "doc", "docx", "txt", "md", "rtf", "pages", "xls", "xlsx", "ppt", "pptx"],
}


def quote_split(raw: Column) -> Column:
    """Tokens between white space outside double quotes; quotes drop, an open one runs to the end."""
    tokens = F.regexp_extract_all(raw, F.lit(r'(?:"[^"]*(?:"|$)|[^\s"])+'), F.lit(0))
    return F.filter(F.transform(tokens, lambda t: F.replace(t, F.lit('"'), F.lit(""))), lambda t: t != "")


def parse(queries: DataFrame, now: Column) -> DataFrame:
    """queries (query_id, raw) with text, ext, path_contains, kind, min_size, max_size, modified_after.

    The last token of a kind wins; a size that can't be read resets its bound, an unknown kind is free text, and a bad
    ``modified:`` is swallowed. A text that begins with a dot and has no space is an extension.
    """
    q = queries.withColumn("tokens", quote_split(F.coalesce("raw", F.lit(""))))
    low = F.lower

    def last(prefix: str, keep=None) -> Column:  # the last token's value, null without one
        chosen = F.filter("tokens", lambda t: low(t).startswith(prefix) & (keep(F.substring(t, len(prefix) + 1, 10**6)) if keep else F.lit(True)))
        return F.substring(F.try_element_at(chosen, F.lit(-1)), len(prefix) + 1, 10**6)

    kinds = [*KINDS, "file", "folder"]
    bare = lambda v: F.regexp_replace(v, r"^\.+|\.+$", "")
    free = F.filter(
        "tokens",
        lambda t: ~(
            low(t).startswith("ext:") | low(t).startswith("path:") | low(t).startswith("size:>") | low(t).startswith("size:<")
            | (low(t) == "modified:today") | low(t).rlike("^modified:<.*d$") | low(t).isin([f"kind:{k}" for k in kinds])
        ),
    )
    dated = F.filter("tokens", lambda t: (low(t) == "modified:today") | (low(t).rlike(r"^modified:<\+?[0-9]{1,9}d$") & (F.regexp_extract(t, "([0-9]+)", 1).cast("int") > 0)))
    when = low(F.try_element_at(dated, F.lit(-1)))
    days = F.regexp_extract(when, "([0-9]+)d$", 1).try_cast("int")
    parsed = q.select(
        "*",
        F.coalesce(normalize(F.array_join(free, " ")), F.lit("")).alias("_text"),
        low(bare(last("ext:", lambda v: bare(v) != ""))).alias("_ext"),
        normalize(last("path:", lambda v: v != "")).alias("path_contains"),
        low(last("kind:", lambda v: low(v).isin(kinds))).alias("kind"),
        byte_size(low(last("size:>"))).alias("min_size"),
        byte_size(low(last("size:<"))).alias("max_size"),
        F.when(when == "modified:today", F.date_trunc("day", now)).otherwise(now - F.make_dt_interval(days)).alias("modified_after"),
    )
    implicit = F.col("_ext").isNull() & F.col("_text").rlike("^[.][^ ]+$")
    return parsed.select(
        "query_id", "raw", F.when(implicit, "").otherwise(F.col("_text")).alias("text"),
        F.when(implicit, F.lower(F.substring("_text", 2, 10**6))).otherwise(F.col("_ext")).alias("ext"),
        "path_contains", "kind", "min_size", "max_size", "modified_after",
    ).where(F.coalesce("raw", F.lit("")).rlike(r"\S"))


def passes() -> Column:
    """Whether a catalog row passes its query's filters; a null bound passes, a null modified time fails one."""
    ext, kind = F.col("file_extension"), F.col("kind")
    of_kind = F.when(kind == "folder", F.col("is_directory")).when(kind == "file", ~F.col("is_directory"))
    for name, extensions in KINDS.items():
        of_kind = of_kind.when(kind == name, ext.isin(extensions))
    ok = lambda bound, test: F.col(bound).isNull() | F.coalesce(test, F.lit(False))
    return (
        ok("ext", ext == F.col("ext")) & ok("path_contains", F.contains("normalized_path", "path_contains")) & ok("min_size", F.col("size") > F.col("min_size"))
        & ok("max_size", F.col("size") < F.col("max_size")) & ok("modified_after", F.col("modified_at") >= F.col("modified_after"))
        & F.coalesce(of_kind, F.lit(True))
    )
