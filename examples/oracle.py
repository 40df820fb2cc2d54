"""The same results in DuckDB SQL, from the columns the sources were rendered from."""

from __future__ import annotations

BACKSLASH = chr(92)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def pick(number: str, *values: str) -> str:
    cases = " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(values))
    return f"CASE ({number}) % {len(values)} {cases} END"


def quoted(*values: str) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


PARTS = f"""
p0 AS (
  SELECT p_partkey AS k, p_size AS sz, p_type, replace(p_name, ' ', '_') AS nm,
    'src/' || replace(p_brand, '#', '') || '/' || p_partkey || {pick('p_size', *quoted('.c', '.cpp', '.h'))} AS path,
    {pick('p_size', *quoted('int ', 'static void ', 'const char *', 'size_t ', 'struct P *'))} AS ret,
    {pick('p_size', *quoted('int', 'void', 'const char *', 'size_t', 'struct P *'))} AS ret_type,
    {pick('p_partkey', *quoted('void', 'int a', 'char const* s, size_t n', 'int (*cb)(int x, int), ...'))} AS par,
    {pick('p_partkey', *quoted('( )', '( int )', '( const char * , size_t )', '( int ( * ) ( int , int ) , ... )'))} AS par_sig,
    {pick('p_partkey', *quoted('[]', '[["int","a"]]', '[["const char *","s"],["size_t","n"]]', '[["int (*)(int, int)","cb"]]'))} AS par_json,
    {pick('p_partkey', *quoted('', 'int a', 'const char * s, size_t n', 'int (*)(int, int) cb'))} AS par_text,
    {pick('p_partkey', '0', '1', '2', '1')} AS n_par,
    {pick('p_partkey', *quoted(';', " {#  if (a > '}') { call(\"{\", 1); }#}"))} AS fin
  FROM part
),
p AS (
  SELECT *, '/* ' || p_type || '; int not_here(int x); */#define P_' || k || '(x) \\  int macro_fn(int x) {{ }}/* é */ '
    || ret || nm || '(' || par || ')' || replace(fin, '#', '') || ' unsigned long int get_' || k
    || '(struct P * p, char *v[]);' AS squeezed,
    CASE WHEN k % 2 = 0 THEN 5 ELSE 7 END AS breaks
  FROM p0
),
f AS (
  SELECT k, path, nm AS name, ret_type AS return_type, par_json AS params_json, par_text AS params_text, n_par,
    k % 4 = 3 AS is_variadic, ret_type || ' ' || par_sig AS signature_norm, 4 AS line, 10 + length(ret) AS col
  FROM p
  UNION ALL
  SELECT k, path, 'get_' || k, 'unsigned long', '[["struct P *","p"],["char *[]","v"]]', 'struct P * p, char *[] v', 2,
    false, 'unsigned long ( struct P * , char * [ ] )', CASE WHEN k % 2 = 0 THEN 4 ELSE 6 END,
    CASE WHEN k % 2 = 0 THEN 9 + length(ret) + length(nm) + 1 + length(par) + 1 + 1 + 19 + 1 ELSE 1 + 19 + 1 END
  FROM p
)"""

HIT = "path, name, return_type, signature_norm, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col"
ORDER = f"{fold('name')}, {fold('path')}, line, col, path, name, signature_norm"
HIT_ORDER = f"score, lower(name), lower(path), line, col, {ORDER}"

PART_QUERIES = f"""
ids AS (
  SELECT p_partkey AS query_id,
    CASE p_partkey % 6 WHEN 0 THEN nm WHEN 2 THEN upper(nm) WHEN 3 THEN 'q' || nm || 'zz'
      WHEN 4 THEN substr(nm, 1, 2) || '%' || substr(nm, -3, 3) END AS qn,
    CASE WHEN p_partkey % 6 IN (0, 1) THEN {pick('p_size', *quoted('int ( int )', 'void ( const char * , size_t )', 'const char * ( int ( * ) ( int , int ) , ... )', 'size_t ( )'))} END AS qs
  FROM (SELECT p_partkey, p_size, replace(p_name, ' ', '_') AS nm FROM part)
),
q AS (SELECT row_number() OVER () AS query_id, qn, qs FROM (SELECT DISTINCT qn, qs FROM ids))"""
SUPPLIER_QUERIES = f"""
q AS (
  SELECT s_suppkey AS query_id, 'Get' || (s_suppkey * 7) || {pick('s_suppkey', *quoted('', '_widget', '_bolt'))} AS qn,
    {pick('s_suppkey', "'unsigned long ( struct P * , char * [ ] )'", "'int ( int )'", 'NULL', "'size_t ( char )'")} AS qs
  FROM supplier
)"""


def one_query(name: str | None, signature: str | None) -> str:
    n, s = (f"'{v}'" if v is not None else "CAST(NULL AS VARCHAR)" for v in (name, signature))
    return f"q AS (SELECT 0 AS query_id, {n} AS qn, {s} AS qs)"


def candidates(queries: str, limit: int | None) -> str:
    """CTEs up to ``a``: the candidates of every query."""
    cut = f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) <= {limit}" if limit is not None else ""
    first = f"ORDER BY {ORDER} LIMIT {limit}" if limit is not None else ""
    return f"""WITH {PARTS},
{queries},
m AS (
  SELECT q.query_id, q.qn, q.qs, f.* FROM q JOIN f
  ON (q.qn IS NULL AND q.qs IS NULL)
    OR {fold('f.name')} LIKE {fold("'%' || q.qn || '%'")}
    OR {fold('f.signature_norm')} LIKE {fold("'%' || q.qs || '%'")}
),
c AS (SELECT * FROM m {cut}),
fb AS (SELECT * FROM f {first}),
a AS (
  SELECT * FROM c
  UNION ALL
  SELECT q.query_id, q.qn, q.qs, fb.* FROM q, fb WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = q.query_id)
)"""


SCORE = (
    "CAST((CASE WHEN qn IS NULL THEN 0 ELSE levenshtein(lower(name), lower(qn)) END)"
    " + (CASE WHEN qs IS NULL THEN 0 ELSE levenshtein(lower(signature_norm), lower(qs)) END) AS INTEGER) AS score"
)


def ranked(ctes: str, source: str, top: int, single: bool = False, where: str = "") -> str:
    columns = f"score, {HIT}" if single else f"query_id, rank, score, {HIT}"
    return f"""{ctes},
s AS (SELECT *, {SCORE} FROM {source}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {HIT_ORDER}) AS INTEGER) AS rank FROM s {where})
SELECT {columns} FROM r WHERE rank <= {top}"""


def for_ids(sql: str) -> str:
    """Give every id the rows of its distinct query."""
    ctes, last = sql.rsplit("SELECT query_id, rank", 1)
    last = last.replace("FROM r WHERE", "FROM (SELECT ids.query_id, r.* EXCLUDE (query_id, qn, qs) FROM ids JOIN r "
                        "ON ids.qn IS NOT DISTINCT FROM r.qn AND ids.qs IS NOT DISTINCT FROM r.qs) WHERE")
    return f"{ctes}SELECT query_id, rank{last}"


def every_pair(queries: str) -> str:
    return f"WITH {PARTS}, {queries}, a AS (SELECT q.*, f.* FROM q, f)"


LIVE = f"""WITH {PARTS},
live AS (
  SELECT path, name, return_type, signature_norm, line + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS line, col
  FROM f WHERE k % 7 <> 2
  UNION ALL
  SELECT path, 'edited_' || k, 'int', 'int ( int )', 1, 5 FROM p WHERE k % 7 = 0
)"""

LANGUAGES = "CASE WHEN path LIKE '%.c' THEN 'c' WHEN path LIKE '%.cpp' THEN 'c++' ELSE 'c,c++' END"


def error(message: str) -> str:
    return (
        f"CASE WHEN path LIKE '%.c' THEN 'c: {message}' WHEN path LIKE '%.cpp' THEN 'c++: {message}' "
        f"ELSE 'c: {message}' || chr(10) || 'c++: {message}' END"
    )


TOKEN = r'''"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|[A-Za-z_$][A-Za-z0-9_$]*|\.?[0-9][A-Za-z0-9_.]*|\.\.\.|::|->\*?|<<=|>>=|<=>|\.\*|\+\+|--|&&|\|\||[-+*/%&|^!=<>]=|<<|>>|##|[^ \t\n\x0B\f\r]'''
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def token_list(text: str) -> str:
    return f"regexp_extract_all({text}, {quoted(TOKEN)[0]})"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def normalised(text: str) -> str:
    return stripped(f"array_to_string({token_list(text)}, ' ')")


def tokenised(table: str, key: str, text: str) -> str:
    return f"SELECT {key}, CAST(len({token_list(text)}) AS INTEGER) AS n_tokens, md5({normalised(text)}) AS digest FROM {table}"


GRAMMAR = """
  (0, nm, 'int ( int , int )', 'int __q__ (int, int);'),
  (1, nm, NULL, NULL),
  (2, NULL, 'int ' || nm || ' ( int )', 'int ' || nm || '(int);'),
  (3, NULL, 'int ' || nm || ' ( int )', 'int ' || nm || ' __q__ (int);'),
  (4, NULL, 'int ( int )', 'int(int);'),
  (5, NULL, 'void * ( int )', 'void * __q__ (int);'),
  (6, NULL, 'const ' || nm || ' *', 'const ' || nm || ' *;'),
  (7, NULL, 'int ( * ) ( int )', 'int __q__ (*)(int);'),
  (8, 'ns', nm || ' :: int ( int )', nm || ' :: int __q__ (int);'),
  (9, NULL, 'int ( int )', 'int __q__ (int);;'),
  (10, NULL, 'int ( ' || nm || ' * )', 'int __q__ (' || nm || ' *);'),
  (11, NULL, NULL, NULL),
  (12, nm, 'int ( void )', 'int __q__ (void);')
"""

DOC_TEXT = "replace(text, '*/', '* /')"
DOC_LITERAL = (
    "replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(13), '\\r'), chr(10), '\\n')"
)
DOCS = f"""WITH d AS (
  SELECT doc_id, 'docs/' || source || '/' || doc_id || '.h' AS path,
    2 + length(text) - length(replace(text, chr(10), '')) AS line, strlen({DOC_LITERAL}) AS lit FROM documents
)"""

COUNTS = "count(*) AS n, count(*) FILTER (k % 7 <= 2) AS c, count(*) FILTER (k % 7 = 0) AS e, count(*) FILTER (k % 7 = 1) AS x"

ORACLE = {
    "scan_language": f"""WITH {PARTS} SELECT path, {LANGUAGES} AS languages, path LIKE '%.cpp' AS cpp_first,
        CAST(strlen(squeezed) + breaks AS BIGINT) AS size FROM p""",
    "extract_functions": f"WITH {PARTS} SELECT path, name, return_type, params_json, is_variadic, signature_norm FROM f",
    "extract_positions": f"WITH {PARTS} SELECT path, name, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col FROM f",
    "extract_documents": f"""{DOCS}
        SELECT path, 'doc_' || doc_id AS name, 'int ( const char * )' AS signature_norm, CAST(line AS INTEGER) AS line,
          5 AS col FROM d
        UNION ALL
        SELECT path, 'len_' || doc_id, 'size_t ( )', CAST(line + 1 AS INTEGER),
          CAST(strlen('const char *t = "') + lit + strlen('"; size_t ') + 1 AS INTEGER) FROM d""",
    "extract_errors": f"""WITH {PARTS} SELECT path,
        CASE k % 6 WHEN 1 THEN {error('unterminated comment')} WHEN 2 THEN {error('unterminated literal')}
          WHEN 3 THEN {error('unbalanced braces')} WHEN 4 THEN {error('unbalanced parentheses')}
          WHEN 5 THEN CASE WHEN path LIKE '%.c' THEN 'c: C++ construct in C source' END END AS last_error,
        CASE WHEN k % 6 = 0 OR (k % 6 = 5 AND path NOT LIKE '%.c') THEN 2 END AS functions FROM p""",
    "extract_nested": f"""WITH {PARTS} SELECT path, 'deep_' || k AS name,
          '[["int[' || repeat('(', CAST(k % 300 + 1 AS INTEGER)) || '1' || repeat(')', CAST(k % 300 + 1 AS INTEGER)) || ']","a"]]' AS params_json FROM p
        UNION ALL SELECT path, 'next_' || k,
          '[["' || repeat('A<', CAST(k % 300 + 1 AS INTEGER)) || 'int, char' || repeat('>', CAST(k % 300 + 1 AS INTEGER)) || '","x"],["short","y"]]' FROM p""",
    "extract_conditional": f"""WITH {PARTS}, s AS (
          SELECT path, CAST(k AS VARCHAR) AS k, CASE k % 2 WHEN 0 THEN 0 ELSE 2 END AS skip FROM p)
        SELECT path, 'f_' || k AS name, 'int' AS return_type, '[["int","a"]]' AS params_json, CAST(skip + 6 AS INTEGER) AS line, 5 AS "column" FROM s
        UNION ALL SELECT path, 'g_' || k, 'void', '[["char","c"],["short","b"]]', CAST(skip + 11 AS INTEGER), 6 FROM s
        UNION ALL SELECT path, 'a_' || k, 'int', '[["int","x"]]', CAST(skip + 20 AS INTEGER), 5 FROM s
        UNION ALL SELECT path, 'b_' || k, 'int *', '[["char","y"]]', CAST(skip + 20 AS INTEGER), CAST(17 + length(k) AS INTEGER) FROM s""",
    "extract_directives": f"""WITH {PARTS} SELECT path, 'f_' || k AS name,
          CAST(1 + 3 * CASE WHEN k % 500 = 0 THEN 10000 ELSE k % 41 END AS INTEGER) AS line, 5 AS "column" FROM p""",
    "extract_declarators": f"""WITH {PARTS}, s AS (
          SELECT path, CAST(k AS VARCHAR) AS k, length(CAST(k AS VARCHAR)) AS n, sz % 3 AS kind, CASE sz % 3 WHEN 1 THEN 2 ELSE 1 END AS unparsed FROM p),
        r AS (
          SELECT *, 'init_' || k AS name, 'int *' AS return_type, '[["char","c"]]' AS params_json, 1 AS line, 13 AS col FROM s
          UNION ALL SELECT *, 'make_' || k, 'struct P_' || k, '[["struct P_' || k || ' *","p"],["int","a"]]', 3, length('struct P_ {{ int x; struct {{ int y; }} q; }} ') + n + 1 FROM s
          UNION ALL SELECT *, 'old_' || k, 'long', '[["int","a"],["char *","s"],["int (*)()","cb"]]', 4, 6 FROM s WHERE kind = 0
          UNION ALL SELECT *, 'in_' || k, 'int', '[["int","a"]]', 4, 20 FROM s WHERE kind = 1
          UNION ALL SELECT *, 'out_' || k, 'long', '[["short","b"]]', 5, 10 FROM s WHERE kind = 1
          UNION ALL SELECT *, 'fun_' || k, 'std::string', '[["size_t",null]]', 7, length('std::string var_(n); std::string ') + n + 1 FROM s WHERE kind = 1)
        SELECT path, name, return_type, params_json, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS "column", unparsed FROM r""",
    "params_json_unicode": r"""SELECT doc_id, '[["struct P *","' || array_to_string([
          CASE WHEN ord(c) > 127 THEN printf('\u%04x', ord(c)) WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN ord(c) = 10 THEN '\n'
            WHEN ord(c) = 9 THEN '\t' WHEN ord(c) = 13 THEN '\r' ELSE c END FOR c IN string_split(text, '')], '') || '"]]' AS params_json FROM documents""".replace("\\\\", "\\"),
    "signature_norm": f"""SELECT p_partkey,
        {pick('p_size', *quoted('int ( ', 'std :: vector < int > ( ', 'void * ( '))}
          || {pick('p_partkey', "CASE WHEN p_partkey % 2 = 1 THEN '... ' ELSE '' END", "'int ' || CASE WHEN p_partkey % 2 = 1 THEN ', ... ' ELSE '' END", "'int , const char * ' || CASE WHEN p_partkey % 2 = 1 THEN ', ... ' ELSE '' END")}
          || ')' AS signature_norm,
        {pick('p_size', *quoted('int ( ', 'std::vector<int> ( ', 'void  * ( '))}
          || {pick('p_partkey', "CASE WHEN p_partkey % 2 = 1 THEN '...' ELSE '' END", "'int' || CASE WHEN p_partkey % 2 = 1 THEN ', ...' ELSE '' END", "'int, const char *' || CASE WHEN p_partkey % 2 = 1 THEN ', ...' ELSE '' END")}
          || ' )' AS plain FROM part""",
    "tokenise_documents": tokenised("documents", "doc_id", "text"),
    "tokenise_pages": tokenised("pages", "page_id", "html"),
    "query_grammar": f"""SELECT query_id, g.name, g.signature_norm, g.declaration
        FROM (SELECT p_partkey AS query_id, replace(p_name, ' ', '_') AS nm FROM part) t,
        LATERAL (SELECT * FROM (VALUES {GRAMMAR}) v(kind, name, signature_norm, declaration)) g
        WHERE g.kind = t.query_id % 13""",
    "edit_distance_parts": """SELECT p_partkey, CAST(levenshtein(lower(p_name), lower(p_type)) AS INTEGER) AS to_type,
        CAST(levenshtein(lower(p_name), lower(p_brand)) AS INTEGER) AS to_brand,
        CAST(strlen(lower(p_brand)) AS INTEGER) AS to_empty FROM part""",
    "edit_distance_documents": """WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[ \\n]') AS w FROM documents)
        SELECT doc_id, CAST(coalesce(list_sum(list_transform(range(1, len(w)), lambda i: levenshtein(w[i], w[i + 1]))), 0) AS BIGINT)
          AS distance FROM w""",
    "candidates_name": f"{candidates(one_query('RED_w', None), 300)} SELECT {HIT} FROM a",
    "candidates_signature": f"{candidates(one_query(None, 'size_t ( const char *'), 100)} SELECT {HIT} FROM a",
    "candidates_both": f"{candidates(one_query('blue_b', 'int ( int'), 500)} SELECT {HIT} FROM a",
    "candidates_none": f"{candidates(one_query(None, None), 250)} SELECT {HIT} FROM a",
    "candidates_unlimited": f"{candidates(one_query('get' + BACKSLASH + '_', '( struct P *'), None)} SELECT {HIT} FROM a",
    "search_top": ranked(candidates(one_query("red_widget", "size_t ( const char * , size_t )"), 400), "a", 20, True),
    "search_fallback": ranked(candidates(one_query("qqq_widget", None), 300), "a", 15, True),
    "search_interactive": ranked(candidates(one_query("bolt", "void ( int )"), 300), "a", 50, True),
    "search_exhaustive": ranked(every_pair(one_query("gt_12", "int ( int , char )")), "a", 40, True),
    "search_batch": for_ids(ranked(candidates(PART_QUERIES, 40), "a", 5)),
    "search_batch_unlimited": ranked(candidates(SUPPLIER_QUERIES, None), "a", 4),
    "search_batch_documents": f"""WITH t AS (
          SELECT source || '/' || doc_id AS path, lang AS name, {normalised('text')} AS signature_norm, 1 AS line, 1 AS col FROM documents
        ), q AS (
          SELECT item_id AS query_id, {stripped(f"regexp_replace(replace({normalised(stripped('text') + " || ';'")}, ' ;', ''), '[{SPACE}]+', ' ', 'g')")} AS qs
          FROM benchmark
        ), m AS (
          SELECT q.query_id, t.* FROM q JOIN t ON {fold('t.signature_norm')} LIKE {fold("'%' || q.qs || '%'")}
          QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY {ORDER}) <= 50
        ), fb AS (SELECT * FROM t ORDER BY {ORDER} LIMIT 50)
        SELECT query_id, path, name, CAST(length(signature_norm) AS INTEGER) AS n_chars FROM (
          SELECT * FROM m UNION ALL
          SELECT q.query_id, fb.* FROM q, fb WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = q.query_id))""",
    "search_exact": ranked(every_pair(SUPPLIER_QUERIES), "a", 5),
    "search_within": for_ids(ranked(every_pair(PART_QUERIES), "a", 5, where="WHERE score <= 6")),
    "change_detection": """WITH e AS (
          SELECT 'u' || user_id || '.c' AS path, ts, CAST(round(value * 100) AS BIGINT) AS size, ts < TIMESTAMP '2024-01-20' AS early
          FROM events
        ), o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, size DESC) = 1),
        n AS (SELECT * FROM e WHERE early QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, size DESC) = 1)
        SELECT o.path, o.size, CASE WHEN n.path IS NULL THEN 'new' WHEN n.ts = o.ts AND n.size = o.size THEN 'skipped'
          ELSE 'changed' END AS status FROM o LEFT JOIN n ON n.path = o.path""",
    "index_upsert": f"""WITH {PARTS} SELECT path, CAST(CASE WHEN k % 7 <= 2 THEN 2 ELSE 1 END AS DOUBLE) AS mtime,
        CAST(CASE k % 7 WHEN 0 THEN strlen(squeezed) + breaks + strlen('int edited_' || k || '(int a);') + 1
          WHEN 1 THEN strlen(squeezed) + breaks + strlen('int broken(int a) {{') + 1
          WHEN 2 THEN strlen('/* nothing left */') + 1 ELSE strlen(squeezed) + breaks END AS BIGINT) AS size,
        CASE WHEN k % 7 = 1 THEN {error('unbalanced braces')} END AS last_error,
        CASE WHEN k % 7 IN (0, 2) THEN 2 ELSE 1 END AS functions_gen FROM p""",
    "live_functions": f"{LIVE} SELECT {HIT} FROM live",
    "compacted_functions": f"{LIVE} SELECT {HIT} FROM live",
    "index_summary": f"""WITH t AS (SELECT {COUNTS} FROM (SELECT p_partkey AS k FROM part))
        SELECT 0 AS run, n AS files_total, n AS files_queued, n AS files_done, CAST(0 AS BIGINT) AS files_skipped, n AS files_indexed,
          CAST(0 AS BIGINT) AS files_failed, CAST(2 * n AS BIGINT) AS functions_total FROM t
        UNION ALL SELECT 1, n, c, n, n - c, c - x, x, 3 * e FROM t
        UNION ALL SELECT 2, n, 0, n, n, 0, 0, 0 FROM t""",
    "error_files": "SELECT count(*) FILTER (p_partkey % 7 = 1) AS error_files FROM part",
    "functions_per_file": f"{LIVE} SELECT path, count(*) AS functions FROM live GROUP BY path",
    "query_status": "SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN 'query text is null' END AS error FROM part",
    "index_prune": f"WITH {PARTS} SELECT path, name FROM f WHERE length(path) % 3 <> 0",
    "index_duplicates": f"WITH {PARTS} SELECT path, name FROM f",
    "refresh_and_search": ranked(candidates(one_query("red_widget", "size_t ( const char * , size_t )"), 400), "a", 20, True),
    "params_json": f"""WITH {PARTS} SELECT path, name, params_json,
        CAST(CASE WHEN length(name) % 5 = 0 THEN 0 ELSE n_par END AS INTEGER) AS n_params FROM f""",
    "format_hits": f"""WITH {PARTS} SELECT path || ':' || line || ':' || col AS location, params_text AS params,
        path || ':' || line || ':' || col || ': ' || name || ' :: ' || return_type || '(' || params_text || ')' AS hit FROM f""",
    "stream_index": f"{LIVE} SELECT {HIT} FROM live",
    "stream_watch": f"{LIVE} SELECT {HIT} FROM live",
    "stream_progress": f"""WITH {PARTS}, t AS (SELECT {COUNTS} FROM (SELECT p_partkey AS k FROM part)),
        b AS (SELECT CAST(sum(strlen(squeezed) + breaks) AS BIGINT) AS first, CAST(sum(CASE k % 7
          WHEN 0 THEN strlen(squeezed) + breaks + strlen('int edited_' || k || '(int a);') + 1
          WHEN 1 THEN strlen(squeezed) + breaks + strlen('int broken(int a) {{') + 1
          WHEN 2 THEN strlen('/* nothing left */') + 1 ELSE strlen(squeezed) + breaks END) AS BIGINT) AS later FROM p)
        SELECT 0 AS run, n AS files_read, first AS bytes_read, n AS files_indexed, CAST(0 AS BIGINT) AS files_failed, CAST(2 * n AS BIGINT) AS functions_total FROM t, b
        UNION ALL SELECT 1, n, later, c - x, x, 3 * e FROM t, b""",
    "stream_search": for_ids(ranked(candidates(PART_QUERIES, 40), "a", 5)),
}
