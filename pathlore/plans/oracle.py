"""DuckDB SQL for the queries of this package: the same rows, written out another way."""

from __future__ import annotations

from pathlore.functions.query import KINDS
from pathlore.plans.fixtures import FILES, PARSED


def _in(kind: str) -> str:
    return "(" + ", ".join(f"'{e}'" for e in KINDS[kind]) + ")"


#: A catalog of each file table, its names in Latin script alone.
_BASE = "\n, ".join(f"{name} AS ({sql})" for name, sql in FILES.items())
_CATALOG = """, {c} AS (
  SELECT *, lower(strip_accents(nfc_normalize(path))) AS normalized_path, lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) AS file_extension,
         replace(latin, ' ', '') AS compact,
         array_to_string(list_filter(list_transform(string_split(latin, ' '), lambda t: substr(t, 1, 1)), lambda ch: regexp_matches(ch, '^[a-z]$')), '') AS initials
  FROM (SELECT *, trim(regexp_replace(replace(normalized_name, '''', ' '), '\\s+', ' ', 'g')) AS latin
        FROM (SELECT *, lower(strip_accents(nfc_normalize(name))) AS normalized_name FROM (SELECT *, string_split(path, '/')[-1] AS name FROM {f}))))"""
_WITH = "WITH " + _BASE + _CATALOG.format(c="cat", f="files_part") + _CATALOG.format(c="cat_doc", f="files_doc") + _CATALOG.format(c="cat_line", f="files_line") + _CATALOG.format(c="cat_page", f="files_page")
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(octet_length(encode({p}))), lambda i: ('0x' || substr(hex(encode({p})), 2 * i + 1, 2))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_SIGNED = "CASE WHEN {h} >= 9223372036854775808::HUGEINT THEN ({h} - 18446744073709551616::HUGEINT)::BIGINT ELSE ({h})::BIGINT END"
_ALIAS = """, al AS (SELECT DISTINCT k, path, alias FROM (SELECT k, path, unnest([normalized_name, compact, initials]) AS alias FROM cat) WHERE alias != '')"""
_POSTINGS = """
  SELECT DISTINCT 'exact' AS kind, alias AS key, k FROM {al}
  UNION SELECT 'prefix1', substr(alias, 1, 1), k FROM {al}
  UNION SELECT 'char', substr(alias, 1, 1), k FROM {al}
  UNION SELECT 'prefix2', substr(alias, 1, 2), k FROM {al} WHERE length(alias) >= 2
  UNION SELECT 'gram3', substr(alias, i::int, 3), k FROM (SELECT k, alias, unnest(range(1, length(alias) - 1)) AS i FROM {al})
  UNION SELECT 'gram2', substr(alias, i::int, 2), k FROM (SELECT k, alias, unnest(range(1, length(alias))) AS i FROM {al})
  UNION SELECT 'extension', file_extension, k FROM {cat} WHERE file_extension != ''"""
_NATURAL = "array_to_string(list_transform(regexp_extract_all({p}, '([0-9]+|[^0-9]+)'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN length(length(ltrim(r, '0'))::varchar)::varchar || length(ltrim(r, '0'))::varchar || ltrim(r, '0') ELSE r END), '')"

#: Every alias list, query text and route of the standard queries over cat.
_ROUTED = _ALIAS + f""", q AS (SELECT *, length(text) AS n, list_filter(string_split(text, ' '), lambda t: t != '') AS parts FROM {PARSED}),
 lists AS (SELECT k, list(alias) AS a FROM al GROUP BY k), firsts AS (SELECT list(DISTINCT substr(alias, 1, 1)) AS known FROM al),
 told AS (SELECT q.*, text IN (SELECT alias FROM al) AS is_exact, list_filter(parts, lambda t: list_contains(known, substr(t, 1, 1))) AS known_parts,
   CASE WHEN n >= 3 THEN list_distinct(list_transform(range(1, n - 1), lambda i: substr(text, i::int, 3))) ELSE [] END AS grams FROM q, firsts),
 cand AS (SELECT told.*, cat.* FROM told, cat JOIN lists USING (k) WHERE CASE
   WHEN ext IS NOT NULL THEN file_extension = ext
   WHEN text = '' THEN false
   WHEN is_exact THEN list_contains(a, text)
   WHEN contains(text, ' ') THEN len(known_parts) > 0 AND len(list_filter(known_parts, lambda t: len(list_filter(a, lambda x: starts_with(x, substr(t, 1, 1)))) > 0)) = len(known_parts)
   WHEN n = 1 THEN len(list_filter(a, lambda x: starts_with(x, text))) > 0
   WHEN n = 2 THEN len(list_filter(a, lambda x: contains(x, text))) > 0
   ELSE len(list_filter(grams, lambda g: len(list_filter(a, lambda x: contains(x, g))) > 0)) = len(grams) END)"""
_PASSES = f"""(ext IS NULL OR file_extension = ext) AND (path_contains IS NULL OR contains(normalized_path, path_contains))
   AND (min_size IS NULL OR size > min_size) AND (max_size IS NULL OR size < max_size)
   AND (modified_after IS NULL OR coalesce(modified_at >= modified_after, false))
   AND (kind IS NULL OR CASE kind WHEN 'image' THEN file_extension IN {_in('image')} WHEN 'video' THEN file_extension IN {_in('video')} WHEN 'audio' THEN file_extension IN {_in('audio')}
        WHEN 'document' THEN file_extension IN {_in('document')} WHEN 'folder' THEN is_directory ELSE NOT is_directory END)"""
_SUBSEQUENCE = "list_reduce(list_prepend(0, list_transform(string_split(w, ''), lambda ch: unicode(ch))), lambda i, ch: CASE WHEN i < length(t) AND unicode(substr(t, (i + 1)::int, 1)) = ch THEN i + 1 ELSE i END) = length(t)"
_TOKENS = f"""list_transform(list_filter(string_split(text, ' '), lambda t: t != ''), lambda t: list_max(list_transform(
   list_filter(list_filter(string_split_regex(normalized_name, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w != ''), lambda w: {_SUBSEQUENCE}), lambda w: greatest(1, 500 - 4 * (length(w) - length(t))))))"""
_SCORE = """CASE WHEN text = '' THEN 8000
   WHEN contains(text, ' ') THEN CASE WHEN len(list_filter(best, lambda b: b IS NULL)) = 0 THEN 7200 + list_sum(best) END
   WHEN normalized_name = text THEN 10000 WHEN starts_with(normalized_name, text) THEN 9000 - least(length(normalized_name) - length(text), 700)
   WHEN contains(normalized_name, text) THEN 7000 - least(8 * (strpos(normalized_name, text) - 1), 700)
   WHEN compact != '' AND compact = text THEN 6800 WHEN compact != '' AND starts_with(compact, text) THEN 6500
   WHEN compact != '' AND length(text) >= 3 AND contains(compact, text) THEN 6100
   WHEN initials != '' AND initials = text THEN 6200 WHEN initials != '' AND starts_with(initials, text) THEN 6000 END"""

#: The greedy subsequence of q in name: how many characters it has, its worth, and the places of its last and first ones.
_FOLD = """list_reduce(list_prepend({'qi': 0, 's': 0, 'last': -2, 'first': -1, 'ci': 0, 'ch': ''}, list_transform(string_split(name, ''), lambda ch: {'qi': 0, 's': 0, 'last': 0, 'first': 0, 'ci': 0, 'ch': ch})),
   lambda a, x: {'qi': a.qi + CASE WHEN a.qi < length(q) AND substr(q, (a.qi + 1)::int, 1) = x.ch THEN 1 ELSE 0 END,
     's': a.s + CASE WHEN a.qi < length(q) AND substr(q, (a.qi + 1)::int, 1) = x.ch THEN 100 + CASE WHEN a.ci = a.last + 1 THEN 80 ELSE 0 END + CASE WHEN a.ci = 0 OR NOT regexp_matches(a.ch, '[\\p{L}\\p{N}]') THEN 60 ELSE 0 END ELSE 0 END,
     'last': CASE WHEN a.qi < length(q) AND substr(q, (a.qi + 1)::int, 1) = x.ch THEN a.ci ELSE a.last END,
     'first': CASE WHEN a.first < 0 AND a.qi < length(q) AND substr(q, (a.qi + 1)::int, 1) = x.ch THEN a.ci ELSE a.first END, 'ci': a.ci + 1, 'ch': x.ch})"""


def _search(rows: str, limit: int = 100) -> str:
    return f""", scored AS (SELECT *, ({_SCORE})::INT AS score FROM (SELECT *, {_TOKENS} AS best FROM {rows} WHERE {_PASSES})),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(name), is_directory DESC, {_NATURAL.format(p='normalized_path')}, path) AS rank FROM scored WHERE score IS NOT NULL)
 SELECT query_id, rank::INT AS rank, score, path FROM ranked WHERE rank <= {limit}"""


_DIRS = "SELECT DISTINCT array_to_string(string_split(path, '/')[1:n::int], '/') AS path FROM (SELECT path, unnest(range(2, len(string_split(path, '/')))) AS n FROM {f})"
_CHANGES = """, changes AS (
  SELECT event_id, ts, 'monitor' || cast(user_id % 4 AS varchar) AS monitor, event_id // 100 AS batch_id, f.path AS path,
         CASE WHEN cast(regexp_extract(props, '[0-9]+', 0) AS int) = 13 THEN 1 ELSE 0 END AS flags, event_type
  FROM events JOIN files_part f ON events.event_id % (SELECT max(k) FROM files_part) + 1 = f.k)"""

_STALE = """, restarted AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN 8 ELSE flags END AS flags) FROM changes),
  state AS (SELECT *, coalesce(last_value(CASE WHEN rescan THEN true WHEN again THEN false END IGNORE NULLS) OVER (PARTITION BY monitor ORDER BY batch_id ROWS UNBOUNDED PRECEDING), false) AS stale
    FROM (SELECT monitor, batch_id, bool_or(flags % 8 != 0) AS rescan, bool_or(flags = 8) AS again, max(event_id) AS e, max(ts) AS t, sum(CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 ELSE 0 END) AS delta
      FROM restarted GROUP BY monitor, batch_id))"""

SQL: dict[str, str] = {
    "fn_normalize": _WITH + " SELECT path, lower(strip_accents(nfc_normalize(path))) AS normalized FROM files_doc",
    "fn_path_parts": _WITH + " SELECT path, name, file_extension AS ext FROM cat",
    "fn_stable_id": _WITH + " SELECT path, " + _SIGNED.format(h="h") + " AS id FROM (SELECT path, " + _FNV.format(p="lower(path)") + " AS h FROM files_part)",
    "fn_record_project": _WITH + " SELECT (SELECT " + _SIGNED.format(h=_FNV.format(p="normalized_path")) + ") AS id, created_at, modified_at, name, normalized_name, latin AS pinyin_name, compact AS pinyin_compact, initials AS pinyin_initials, path, normalized_path, file_extension, is_directory, size FROM cat",
    "agg_storage_bytes": "SELECT sum(octet_length(encode(p_name)) + 1)::BIGINT AS bytes FROM part",
    "fn_pinyin_aliases": _WITH + " SELECT path, latin AS pinyin_name, compact AS pinyin_compact, initials AS pinyin_initials FROM cat_doc",
    "fn_aliases": _WITH + _ALIAS + " SELECT path, alias FROM al",
    "fn_ngrams": _WITH + " SELECT DISTINCT path, substr(normalized_name, i::int, 3) AS gram FROM (SELECT path, normalized_name, unnest(range(1, length(normalized_name) - 1)) AS i FROM cat)",
    "fn_words": _WITH + " SELECT path, word FROM (SELECT path, unnest(string_split_regex(normalized_name, '[^\\p{L}\\p{N}]+')) AS word FROM cat_doc) WHERE word != ''",
    "fn_natural_key": _WITH + " SELECT path, " + _NATURAL.format(p="lower(path) || '/v' || rpad(k::varchar, 30, '7') || '-00' || k::varchar") + " AS natural_key FROM files_line",
    "fn_query_parse": """SELECT p_partkey AS query_id, lower(p_name) AS text, 'pdf' AS ext, lower(p_brand) AS path_contains, 'image' AS kind,
        p_size::BIGINT * 1000000 AS min_size, CASE WHEN p_size > 0 THEN p_size::INT END AS days FROM part""",
    "fn_byte_size": """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN floor((p_size + 0.5) * 1e12) WHEN 1 THEN floor((p_size + 0.5) * 1e9) WHEN 2 THEN floor((p_size + 0.5) * 1e6)
        WHEN 3 THEN floor((p_size + 0.5) * 1e3) WHEN 4 THEN p_size WHEN 5 THEN p_size END::BIGINT AS bytes FROM part""",
    "src_listing": """WITH t AS (SELECT 'names/all/brand=' || replace(p_brand, '#', '') AS brand, '/size=' || (p_size % 5) AS size, p_name FROM part)
       SELECT 'names' AS dir, true AS is_directory, 0::BIGINT AS size UNION ALL SELECT 'names/all', true, 0 UNION ALL SELECT DISTINCT brand, true, 0 FROM t UNION ALL SELECT DISTINCT brand || size, true, 0 FROM t
       UNION ALL SELECT brand || size, false, sum(octet_length(encode(p_name)) + 1)::BIGINT FROM t GROUP BY brand, size""",
    "src_dirs_from_paths": _WITH + " SELECT path, true AS is_directory FROM (" + _DIRS.format(f="files_part") + ")",
    "src_multi_root": _WITH + " SELECT path, min(size) AS size, 0 AS root_ord FROM files_page GROUP BY path UNION ALL SELECT path, size, 1 FROM files_part",
    "src_limit": _WITH + " SELECT path, root_ord FROM (SELECT path, 0 AS root_ord FROM files_part UNION ALL SELECT DISTINCT path, 1 FROM files_page) ORDER BY root_ord, path LIMIT 500",
    "src_skip_packages": _WITH + " SELECT path FROM files_part WHERE k % 3 != 0",
    "sink_catalog": _WITH + " SELECT path, size, normalized_name, (SELECT count(*) FROM cat) AS item_count, 3 AS roots FROM cat",
    "sink_postings": _WITH + _ALIAS + ", p AS (" + _POSTINGS.format(al="al", cat="cat") + ") SELECT kind, key, count(*) AS df FROM p GROUP BY kind, key",
    "flt_all": _WITH + f" SELECT query_id, path FROM cat, {PARSED} WHERE coalesce(ext, kind, path_contains, min_size::varchar, modified_after::varchar) IS NOT NULL AND {_PASSES}",
    "flt_under_roots": _WITH + " SELECT path FROM files_line WHERE starts_with(path, '/vol4/O/') OR starts_with(path, '/vol4/F/A/')",
    "flt_rescan_flag": _WITH + _CHANGES + " SELECT event_id, flags % 8 != 0 AS rescan FROM changes",
    "agg_postings": _WITH + _ALIAS + ", ids AS (SELECT k, " + _SIGNED.format(h="h") + " AS id FROM (SELECT k, " + _FNV.format(p="normalized_path") + " AS h FROM cat)), p AS (" + _POSTINGS.format(al="al", cat="cat")
    + ") SELECT kind, key, floor(id / 1152921504606846976.0)::BIGINT AS block, count(*) AS n, string_agg(id::varchar, ',' ORDER BY id) AS ids FROM p JOIN ids USING (k) GROUP BY ALL",
    "set_intersect_postings": _WITH + """, q AS (SELECT p_brand AS query_id, lower(min(p_name)) AS text FROM part GROUP BY p_brand), g AS (SELECT DISTINCT query_id, substr(text, i::int, 3) AS gram FROM (SELECT *, unnest(range(1, length(text) - 1)) AS i FROM q)),
       need AS (SELECT query_id, count(*) AS need FROM g GROUP BY query_id), hits AS (SELECT query_id, path, gram FROM g JOIN cat ON contains(normalized_name, gram) OR contains(compact, gram) OR contains(initials, gram))
       SELECT query_id, path FROM hits JOIN need USING (query_id) GROUP BY query_id, path, need HAVING count(*) = need""",
    "agg_posting_df": _WITH + ", al AS (SELECT DISTINCT k, alias FROM (SELECT path AS k, unnest([normalized_name, compact, initials]) AS alias FROM cat_line) WHERE alias != ''), p AS ("
    + _POSTINGS.format(al="al", cat="(SELECT path AS k, file_extension FROM cat_line)") + ") SELECT kind, key, count(*) AS df FROM p GROUP BY kind, key",
    "join_candidates": _WITH + _ROUTED + " SELECT query_id, path FROM cand",
    "agg_diagnostics": _WITH + _ROUTED + """, known3 AS (SELECT list(DISTINCT substr(alias, i::int, 3)) AS all3 FROM (SELECT alias, unnest(range(1, length(alias) - 1)) AS i FROM al)), r AS (SELECT told.query_id, CASE WHEN ext IS NOT NULL THEN 'extension' WHEN text = '' THEN 'empty' WHEN is_exact THEN 'exact'
       WHEN contains(text, ' ') THEN CASE WHEN len(known_parts) > 0 THEN 'tokens' ELSE 'tokens-none' END WHEN n = 1 THEN 'prefix-1'
       WHEN n = 2 THEN CASE WHEN EXISTS (SELECT 1 FROM al WHERE contains(alias, text)) THEN 'bigram' ELSE 'prefix-2' END
       WHEN len(list_filter(grams, lambda g: list_contains(all3, g))) = len(grams) THEN 'trigram' ELSE 'no-gram' END AS route FROM told, known3),
       c AS (SELECT query_id, count(*) AS n FROM cand GROUP BY query_id), t AS (SELECT count(*) AS total FROM cat)
       SELECT r.query_id, route, total AS total_entries, coalesce(n, 0) AS candidates, least(coalesce(n, 0), 20000) AS examined, coalesce(n, 0) > 20000 AS truncated,
              least(coalesce(n, 0), 20000) >= total AND total > 10000 AS full_scan FROM r LEFT JOIN c USING (query_id), t""",
    "score_fuzzy": f"""WITH c AS (SELECT p_partkey, q, lower(p_name) AS name FROM part, (VALUES ('rd wdgt'), ('ring'), ('b r'), ('rg'), ('zzzz'), ('')) AS t(q)),
       f AS (SELECT *, length(name) - length(q) AS extra, strpos(name, q) - 1 AS pos, {_FOLD} AS e FROM c)
       SELECT p_partkey, q, CASE WHEN q = '' THEN 1 WHEN name = q THEN 10000 WHEN starts_with(name, q) THEN 9000 - least(extra, 1000)
         WHEN contains(name, q) THEN 7500 + CASE WHEN pos = 0 OR NOT regexp_matches(substr(name, pos::int, 1), '[\\p{{L}}\\p{{N}}]') THEN 500 ELSE 0 END - least(pos, 1000)
         WHEN e.qi = length(q) THEN greatest(e.s - least(8 * e.first, 500) - least(extra, 500), 1) END::INT AS score FROM f""",
    "search_batch": _WITH + _ROUTED + _search("cand"),
    "search_scan": _WITH + _ROUTED + _search("cand"),
    "search_exhaustive": _WITH + f", rows AS (SELECT * FROM cat, {PARSED})" + _search("rows"),
    "topk_extension_early": _WITH + f""", first AS (SELECT *, CASE file_extension WHEN 'glb' THEN 1 ELSE 2 END AS query_id, row_number() OVER (PARTITION BY file_extension ORDER BY path) AS rn FROM cat WHERE file_extension IN ('glb', 'pdf'))
       SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY length(name), {_NATURAL.format(p='normalized_path')}, path)::INT AS rank, 8000 AS score, path FROM first WHERE rn <= 50""",
    "lim_candidates": _WITH + _ROUTED + ", n AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY path) AS rn, count(*) OVER (PARTITION BY query_id) > 40 AS truncated FROM cand) SELECT query_id, path, truncated FROM n WHERE rn <= 40",
    "agg_unique_ids": _WITH + ", p AS (SELECT path FROM files_page UNION ALL SELECT path FROM files_page UNION ALL SELECT upper(path) FROM files_page), h AS (SELECT " + _FNV.format(p="lower(strip_accents(nfc_normalize(path)))")
    + " AS h FROM p) SELECT path AS value, count(*) AS n, 'path' AS \"column\" FROM p GROUP BY path HAVING count(*) > 1 UNION ALL SELECT (" + _SIGNED.format(h="h") + ")::VARCHAR, count(*), 'id' FROM h GROUP BY h HAVING count(*) > 1",
    "set_cover_prefixes": _WITH + ", d AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM files_part UNION SELECT path FROM (" + _DIRS.format(f="files_part") + ") WHERE regexp_matches(path, '^/vol1/[^/]*$')) SELECT path FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE starts_with(d.path, o.path || '/'))",
    "merge_apply_changes": _WITH + _CHANGES + """, gone AS (SELECT DISTINCT path FROM changes WHERE event_type = 'error'), up AS (SELECT DISTINCT path FROM changes WHERE event_type != 'error' AND path NOT IN (SELECT path FROM gone))
       SELECT path, size + 1 AS size FROM cat WHERE path IN (SELECT path FROM up) UNION ALL
       SELECT path, size FROM cat WHERE path NOT IN (SELECT path FROM up) AND path NOT IN (SELECT path FROM gone) AND NOT starts_with(path, '/vol2/STANDARD TIN/') AND NOT starts_with(path, '/vol0/')""",
    "delta_postings": _WITH + ", al AS (SELECT DISTINCT k, alias FROM (SELECT k, unnest([normalized_name, compact, initials]) AS alias FROM cat WHERE size % 2000000 != 0) WHERE alias != ''), p AS ("
    + _POSTINGS.format(al="al", cat="(SELECT k, file_extension FROM cat WHERE size % 2000000 != 0)") + ") SELECT kind, key, count(*) AS df FROM p GROUP BY kind, key",
    "agg_delta_stats": _WITH + _CHANGES + " SELECT (SELECT count(DISTINCT path) FROM changes) AS anchors, count(*) AS before_count, count(*) FILTER (size % 2000000 != 0) AS after_count, count(*) FILTER (size % 2000000 != 0) - count(*) AS delta FROM cat",
    "st_debounce": _WITH + _CHANGES + """, m AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY monitor ORDER BY ts) >= INTERVAL 90 MINUTE, true) AS fresh FROM changes),
       g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY monitor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM m)
       SELECT monitor, count(DISTINCT path) AS n_paths, max(event_id) AS last_event_id FROM g GROUP BY monitor, run""",
    "fn_latinize": """SELECT n_nationkey, word, l || ' ' || lower(n_name) AS latin, c || lower(n_name) AS compact, i || substr(lower(n_name), 1, 1) AS initials
       FROM nation, (VALUES ('Привет Йод', 'privet jod', 'privetjod', 'pj'), ('Ελλάδα', 'ellada', 'ellada', 'e'), ('ευρώ αυτό', 'euro auto', 'euroauto', 'ea'), ('こんにちは', 'kon nichiha', 'konnichiha', 'kn'), ('きゃく', 'kyaku', 'kyaku', 'k'), ('がっこう', 'gakkou', 'gakkou', 'g'), ('コーヒー', 'kohi', 'kohi', 'k'), ('产品 报告', 'chan pin bao gao', 'chanpinbaogao', 'cpbg'), ('서울', 'seoul', 'seoul', 's'), ('맑음', 'malg-eum', 'malg-eum', 'm'), ('Æsir Ünal', 'æsir unal', 'æsirunal', 'u'), ('हिन्दी', 'hindi', 'hindi', 'h'), ('तस्वीरें', 'tasvirem', 'tasvirem', 't'), ('ไทย', 'thiy', 'thiy', 't'), ('বাংলা', 'banla', 'banla', 'b'), ('தமிழ்', 'tamil', 'tamil', 't')) AS t(word, l, c, i)""",
    "st_apply": _WITH + _CHANGES + """, up AS (SELECT path, max(event_id) AS e FROM changes WHERE event_type != 'error' GROUP BY path), gone AS (SELECT path, max(event_id) AS e FROM changes WHERE event_type = 'error' GROUP BY path),
       away AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, max(event_id) AS e FROM changes WHERE event_id % 50 = 7 GROUP BY 1),
       inside AS (SELECT *, starts_with(path, '/vol0/') OR starts_with(path, '/vol1/') AS told FROM cat),
       live AS (SELECT k, path, false AS is_directory, size + CASE WHEN told AND up.e IS NOT NULL THEN 1 ELSE 0 END AS size FROM inside LEFT JOIN up USING (path) LEFT JOIN gone USING (path)
         LEFT JOIN away ON away.dir = regexp_replace(path, '/[^/]*$', '') WHERE NOT told OR greatest(coalesce(gone.e, -2), coalesce(away.e, -2)) <= coalesce(up.e, -1)),
       dirs AS (SELECT -row_number() OVER () AS k, path, string_split(path, '/')[-1] AS name FROM (""" + _DIRS.format(f="files_part") + """) WHERE starts_with(path, '/vol2') OR path NOT IN (SELECT dir FROM away)),
       low AS (SELECT k, path, lower(name) AS name, trim(regexp_replace(replace(lower(name), '\'\'', ' '), '\\s+', ' ', 'g')) AS latin FROM dirs),
       al AS (SELECT DISTINCT k, path, alias FROM (SELECT k, path, unnest([normalized_name, compact, initials]) AS alias FROM cat SEMI JOIN live USING (k)
         UNION ALL SELECT k, path, unnest([name, replace(latin, ' ', ''), array_to_string(list_filter(list_transform(string_split(latin, ' '), lambda t: substr(t, 1, 1)), lambda ch: regexp_matches(ch, '^[a-z]$')), '')]) FROM low) WHERE alias != ''),
       p AS (""" + _POSTINGS.format(al="al", cat="(SELECT k, file_extension FROM cat SEMI JOIN live USING (k))") + """), n AS (SELECT k, count(*) AS n_postings FROM p GROUP BY k)
       SELECT path, is_directory, size, n_postings FROM live JOIN n USING (k) UNION ALL SELECT path, true, 0, n_postings FROM dirs JOIN n USING (k)""",
    "st_rescan_latch": _WITH + _CHANGES + _STALE + " SELECT event_id, monitor FROM restarted JOIN state USING (monitor, batch_id) WHERE NOT stale",
    "st_monitor": _WITH + _CHANGES + _STALE + """ SELECT monitor, batch_id, stale, max(e) OVER w AS last_event_id, max(t) OVER w AS last_ts, CAST(sum(greatest(delta, 0)) OVER w AS BIGINT) AS added, CAST(sum(greatest(-delta, 0)) OVER w AS BIGINT) AS removed,
       CAST(sum((delta = 0)::INT) OVER w AS BIGINT) AS changed, count(*) OVER w AS batches FROM state WINDOW w AS (PARTITION BY monitor ORDER BY batch_id ROWS UNBOUNDED PRECEDING)""",
    "st_last_event": _WITH + _CHANGES + " SELECT monitor, max(event_id) AS last_event_id, max(ts) AS last_ts FROM changes GROUP BY monitor",
    "st_counters": _WITH + _CHANGES + """, s AS (SELECT turn, cat.path, max(CASE WHEN event_type != 'error' THEN event_id END) AS up, max(CASE WHEN event_type = 'error' THEN event_id END) AS gone
         FROM cat CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS turn) LEFT JOIN changes ON changes.path = cat.path AND event_id % 4 <= turn GROUP BY turn, cat.path),
       n AS (SELECT turn, count(*) FILTER (coalesce(gone, -2) <= coalesce(up, -1)) AS n FROM s GROUP BY turn),
       d AS (SELECT turn, n, n - lag(n, 1, (SELECT count(*) FROM cat)) OVER (ORDER BY turn) AS delta FROM n)
       SELECT arg_max(n, turn) AS item_count, sum(greatest(delta, 0))::BIGINT AS added, sum(greatest(-delta, 0))::BIGINT AS removed, count(*) FILTER (delta = 0) AS changed, count(*) AS batches FROM d""",
}
