"""File tables derived by SQL from the given tables; the same text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "files_part": """
SELECT '/vol' || cast(p_partkey % 3 AS varchar(10)) || '/' || p_type || '/' || replace(p_brand, '#', '') || '/'
       || p_name || '-' || cast(p_partkey AS varchar(20)) || '.'
       || split_part('glb,pdf,png,mp4,mp3,txt,doc,JPG', ',', cast(p_partkey % 8 + 1 AS int)) AS path,
       cast(p_size AS bigint) * 1000000 AS size, false AS is_directory, false AS is_symlink,
       cast(NULL AS timestamp) AS created_at,
       CASE WHEN p_partkey % 11 = 0 THEN NULL
            ELSE timestamp '2024-01-01 00:00:00' + interval '1' day * cast(p_partkey % 365 AS int) END AS modified_at, p_partkey AS k
FROM part""",
    "files_doc": """
SELECT '/vol3/' || lang || '/' || source || '/' || trim(translate(substr(text, 1, 24), '/' || chr(10), '  '))
       || '-' || cast(doc_id AS varchar(20)) || '.txt' AS path,
       n_chars AS size, false AS is_directory, false AS is_symlink,
       cast(NULL AS timestamp) AS created_at, cast(NULL AS timestamp) AS modified_at, doc_id AS k
FROM documents""",
    "files_page": """
SELECT '/web/' || split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS path,
       cast(length(html) AS bigint) AS size, false AS is_directory, false AS is_symlink,
       cast(NULL AS timestamp) AS created_at, cast(NULL AS timestamp) AS modified_at, page_id AS k
FROM pages""",
    "files_line": """
SELECT '/vol4/' || l_linestatus || '/' || l_returnflag || '/order-' || cast(l_orderkey AS varchar(20)) || '-'
       || cast(l_linenumber AS varchar(10)) || '-' || cast(l_partkey AS varchar(20)) || '-'
       || cast(l_suppkey AS varchar(20)) || '.'
       || split_part('pdf,txt,png,doc', ',', cast(l_partkey % 4 + 1 AS int)) AS path,
       cast(l_quantity AS bigint) * 1000 AS size, false AS is_directory, false AS is_symlink,
       cast(NULL AS timestamp) AS created_at, l_shipdate AS modified_at, l_orderkey AS k
FROM lineitem""",
}
_TABLE = {"files_part": "part", "files_doc": "documents", "files_page": "pages", "files_line": "lineitem"}

#: The standard queries, and what each parses to with now = 2024-12-31 (as a table of SQL values).
RAW = [
    (1, "ring"), (2, "red widget"), (3, "rd wdgt"), (4, ".glb"), (5, "ext:pdf plate"), (6, "kind:image ring"), (7, "size:>10mb size:<30mb bolt"),
    (8, "path:economy gear"), (9, "modified:<30d rod"), (10, "re"), (11, "r"), (12, "zzzq"), (13, "kind:image"), (14, "   "),
    (15, '"red widget" path:"vol1/promo"'), (16, "hot rng"), (17, "rr"),
]
PARSED = """(VALUES
 (1, 'ring', NULL, NULL, NULL, NULL, NULL, NULL), (2, 'red widget', NULL, NULL, NULL, NULL, NULL, NULL), (3, 'rd wdgt', NULL, NULL, NULL, NULL, NULL, NULL),
 (4, '', 'glb', NULL, NULL, NULL, NULL, NULL), (5, 'plate', 'pdf', NULL, NULL, NULL, NULL, NULL), (6, 'ring', NULL, NULL, 'image', NULL, NULL, NULL),
 (7, 'bolt', NULL, NULL, NULL, 10000000, 30000000, NULL), (8, 'gear', NULL, 'economy', NULL, NULL, NULL, NULL),
 (9, 'rod', NULL, NULL, NULL, NULL, NULL, timestamp '2024-12-01 00:00:00'), (10, 're', NULL, NULL, NULL, NULL, NULL, NULL), (11, 'r', NULL, NULL, NULL, NULL, NULL, NULL),
 (12, 'zzzq', NULL, NULL, NULL, NULL, NULL, NULL), (13, '', NULL, NULL, 'image', NULL, NULL, NULL), (15, 'red widget', NULL, 'vol1/promo', NULL, NULL, NULL, NULL),
 (16, 'hot rng', NULL, NULL, NULL, NULL, NULL, NULL), (17, 'rr', NULL, NULL, NULL, NULL, NULL, NULL)
) AS q(query_id, text, ext, path_contains, kind, min_size, max_size, modified_after)"""


def files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A listing; its last column k is the row it comes from."""
    table = spark.read.parquet(f"{sf_dir}/{_TABLE[name]}.parquet")
    return spark.sql(FILES[name].replace(f"FROM {_TABLE[name]}", "FROM {t}"), t=table)


def raw_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RAW, "query_id int, raw string")
