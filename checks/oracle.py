"""The expected results in SQL, worked out from the given tables by counting words.

Nothing here scans source text for structure: every derived definition has a size
that follows from the number of words in one line of a document.
"""

from __future__ import annotations

from checks.corpora import ENDINGS, EXTENSIONS, FIRST_PARTS

NON_BLANK = (
    r"[^\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# --- document corpus ------------------------------------------------------------


def _case(expr: str, values: list[str], other: str | None = None) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {whens} ELSE '{other if other is not None else values[-1]}' END"


_PATH = f"concat({_case('doc_id % 7', FIRST_PARTS, 'src.old')}, '/Unit', CAST(doc_id AS VARCHAR), {_case('doc_id % 11', EXTENSIONS)})"

C1 = f"""c1 AS (SELECT source AS root, doc_id AS file_id, {_PATH} AS path, text AS content,
  parts[len(parts)] AS base FROM (SELECT *, string_split({_PATH}, '/') AS parts FROM documents))"""

SPACED = f"""sp AS (SELECT root, file_id, path,
  concat(replace(content, '. ', concat('.', chr(13), chr(10), chr(160), chr(10))), chr(10)) AS content FROM c1),
ln AS (SELECT root, file_id, path, string_split(content, chr(10)) AS parts FROM sp),
li AS (SELECT root, file_id, path, unnest(parts[1:len(parts)-1]) AS raw,
  unnest(range(1, len(parts))) AS line_no FROM ln)"""

LANG = "CASE WHEN lower(base) LIKE '_%.rs' THEN 'rust' WHEN lower(base) LIKE '_%.cs' THEN 'csharp' END"

_GEN_DIR = "len([c for c in string_split(lower(path), '/') if c IN ('obj', 'bin')]) > 0"
_GEN_NAME = (
    "(regexp_matches(lower(base), '\\.(designer|generated|g|g\\.i|assemblyinfo|assemblyattributes|razor\\.g)\\.cs$')"
    " OR lower(base) IN ('assemblyinfo.cs', 'solutioninfo.cs') OR starts_with(lower(base), 'temporarygeneratedfile_'))"
)
LANGUAGE = f"""lg AS (SELECT *, {LANG} AS language, {_GEN_DIR} AS gen_dir, {_GEN_NAME} AS gen_name FROM c1)"""

MARKED = """mk AS (SELECT root, file_id, path, base FROM c1
  UNION ALL SELECT DISTINCT source, -1, 'Cargo.toml', 'Cargo.toml' FROM documents WHERE CAST(substr(source, 4) AS INT) % 3 = 0
  UNION ALL SELECT DISTINCT source, -2, 'App.csproj', 'App.csproj' FROM documents WHERE CAST(substr(source, 4) AS INT) % 4 = 0)"""

SEEN = f"""{C1}, {MARKED}, ml AS (SELECT *, {LANG} AS language, {_GEN_DIR} AS gen_dir, {_GEN_NAME} AS gen_name FROM mk),
seen AS (SELECT root, bool_or(path = 'Cargo.toml') AS has_cargo_toml, bool_or(path = 'App.csproj') AS has_dotnet_marker,
  CAST(count(*) FILTER (WHERE language = 'rust') AS BIGINT) AS rust_files,
  CAST(count(*) FILTER (WHERE language = 'csharp' AND NOT gen_dir AND NOT gen_name) AS BIGINT) AS csharp_files
  FROM ml GROUP BY root),
det AS (SELECT root, CASE WHEN has_cargo_toml AND NOT has_dotnet_marker THEN 'rust'
  WHEN has_dotnet_marker AND NOT has_cargo_toml THEN 'csharp'
  WHEN rust_files > csharp_files THEN 'rust' WHEN csharp_files > rust_files THEN 'csharp' END AS language FROM seen)"""

# --- generated corpora ----------------------------------------------------------


def _path_of(suffix: str) -> str:
    return f"concat(CASE doc_id % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'src/core' ELSE 'src.old' END, '/d', CAST(doc_id AS VARCHAR), '{suffix}')"


def _statuses(language: str) -> str:
    status = _case(f"doc_id % {len(ENDINGS[language])}", [status for _, status in ENDINGS[language]])
    path = _path_of({"rust": ".rs", "csharp": ".cs"}[language])
    return f"SELECT source AS root, doc_id AS file_id, {path} AS path, {status} AS status FROM documents"


def _lines_of(suffix: str) -> str:
    path = _path_of(suffix)
    return f"""x AS (SELECT root, file_id, path, i, CAST(i AS VARCHAR) AS s, i % 10 AS k,
  len(regexp_extract_all(l, '[A-Za-z]+')) AS n FROM (
  SELECT source AS root, doc_id AS file_id, {path} AS path, unnest(string_split(text, chr(10))) AS l,
  unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents))"""


FUNCTIONS = ("file_scope_function", "impl_method", "trait_method", "test_function")

# (line number modulo 10, order in the block, category, name, owner, owner trait, display name, lines)
_RUST = [
    (0, 0, "file_scope_function", "'f'||s", None, None, "'f'||s", "n+3"),
    (0, 1, "file_scope_function", "'inner'||s", None, None, "'inner'||s", "1"),
    (1, 0, "test_function", "'t'||s", None, None, "'t'||s", "n+4"),
    (2, 0, "struct", "'S'||s", None, None, "'S'||s", "n+3"),
    (3, 0, "enum", "'E'||s", None, None, "'E'||s", "n+2"),
    (4, 0, "trait", "'T'||s", None, None, "'T'||s", "n+6"),
    (4, 1, "trait_method", "'dflt'", "'T'||s", None, "'trait T'||s||'::dflt'", "n+2"),
    (5, 0, "impl_block", "'W'||s||' < ''a >'", None, "'fmt :: Display'", "'W'||s||' < ''a >'", "n+5"),
    (5, 1, "impl_method", "'show'", "'W'||s||' < ''a >'", "'fmt :: Display'", "'fmt :: Display for W'||s||' < ''a >::show'", "n+2"),
    (6, 0, "impl_block", "'W'||s", None, None, "'W'||s", "n+6"),
    (6, 1, "impl_method", "'a'", "'W'||s", None, "'W'||s||'::a'", "n+2"),
    (6, 2, "impl_method", "'b'", "'W'||s", None, "'W'||s||'::b'", "2"),
    (7, 0, "const", "'C'||s", None, None, "'C'||s", "n+2"),
    (7, 1, "static", "'G'||s", None, None, "'G'||s", "1"),
    (8, 0, "file_scope_function", "'g'||s", None, None, "'g'||s", "n+5"),
    (9, 0, "file_scope_function", "'raw'||s", None, None, "'raw'||s", "n+4"),
]
_CSHARP = [
    (0, 0, "struct", "'C'||s", None, None, "'C'||s", "n+16"),
    (0, 1, "impl_block", "'C'||s", None, None, "'C'||s", "n+16"),
    (0, 2, "impl_method", "'Run'", "'C'||s", None, "'Run'", "n+7"),
    (0, 3, "file_scope_function", "'local Local'||s", None, None, "'local Local'||s", "4"),
    (1, 0, "trait", "'I'||s", None, None, "'I'||s", "n+8"),
    (1, 1, "impl_block", "'I'||s", None, "'interface'", "'I'||s", "n+8"),
    (1, 2, "trait_method", "'Need'", "'I'||s", None, "'Need'", "1"),
    (1, 3, "trait_method", "'Dflt'", "'I'||s", None, "'Dflt'", "n+3"),
    (1, 4, "trait_method", "'P.get'", "'I'||s", None, "'P.get'", "1"),
    (2, 0, "enum", "'E'||s", None, None, "'E'||s", "n+3"),
    (3, 0, "delegate", "'D'||s", None, None, "'D'||s", "n+2"),
    (4, 0, "struct", "'Ev'||s", None, None, "'Ev'||s", "n+11"),
    (4, 1, "impl_block", "'Ev'||s", None, None, "'Ev'||s", "n+11"),
    (4, 2, "event", "'Changed'||s", None, None, "'Changed'||s", "1"),
    (4, 3, "event", "'Upd'||s", None, None, "'Upd'||s", "n+7"),
    (4, 4, "impl_method", "'Upd'||s||'.add'", "'Ev'||s", None, "'Upd'||s||'.add'", "n+3"),
    (4, 5, "impl_method", "'Upd'||s||'.remove'", "'Ev'||s", None, "'Upd'||s||'.remove'", "1"),
    (5, 0, "struct", "'R'||s", None, None, "'R'||s", "n+8"),
    (5, 1, "impl_block", "'R'||s", None, None, "'R'||s", "n+8"),
    (5, 2, "const", "'Max'||s", None, None, "'Max'||s", "1"),
    (5, 3, "static", "'Map'||s", None, None, "'Map'||s", "n+3"),
    (6, 0, "struct", "'K'||s", None, None, "'K'||s", "n+14"),
    (6, 1, "impl_block", "'K'||s", None, None, "'K'||s", "n+14"),
    (6, 2, "impl_method", "'K'||s", "'K'||s", None, "'K'||s", "n+3"),
    (6, 3, "impl_method", "'~K'||s", "'K'||s", None, "'~K'||s", "1"),
    (6, 4, "impl_method", "'operator +'", "'K'||s", None, "'operator +'", "1"),
    (6, 5, "impl_method", "'explicit operator int'", "'K'||s", None, "'explicit operator int'", "4"),
    (6, 6, "impl_method", "'this[]'", "'K'||s", None, "'this[]'", "1"),
    (6, 7, "impl_method", "'Desc'", "'K'||s", None, "'Desc'", "1"),
    (7, 0, "struct", "'A'||s", None, None, "'A'||s", "n+19"),
    (7, 1, "impl_block", "'A'||s", None, None, "'A'||s", "n+19"),
    (7, 2, "impl_method", "'P'||s||'.get'", "'A'||s", None, "'P'||s||'.get'", "n+3"),
    (7, 3, "impl_method", "'P'||s||'.set'", "'A'||s", None, "'P'||s||'.set'", "1"),
    (7, 4, "impl_method", "'this[].get'", "'A'||s", None, "'this[].get'", "1"),
    (7, 5, "impl_method", "'Auto.get'", "'A'||s", None, "'Auto.get'", "1"),
    (7, 6, "impl_method", "'Auto.set'", "'A'||s", None, "'Auto.set'", "1"),
    (7, 7, "impl_method", "'Sw'", "'A'||s", None, "'Sw'", "4"),
    (8, 0, "struct", "'S'||s", None, None, "'S'||s", "n+9"),
    (8, 1, "impl_block", "'S'||s", None, None, "'S'||s", "n+9"),
    (8, 2, "impl_method", "'M'||s", "'S'||s", None, "'M'||s", "n+6"),
    (9, 0, "struct", "'L'||s", None, None, "'L'||s", "n+15"),
    (9, 1, "impl_block", "'L'||s", None, None, "'L'||s", "n+15"),
    (9, 2, "impl_method", "'Ex'||s", "'L'||s", None, "'Ex'||s", "n+3"),
    (9, 3, "impl_method", "'Gen'||s", "'L'||s", None, "'Gen'||s", "9"),
]
# Non-blank lines of each whole block, and of the text around the blocks.
_RUST_BLOCK = ["n+3", "n+5", "n+3", "n+2", "n+6", "n+5", "n+6", "n+3", "n+13", "n+7"]
_RUST_AROUND = 3


def _items(rows: list[tuple], language: str, extra: str = "") -> str:
    def q(v: str | None) -> str:
        return v if v is not None else "CAST(NULL AS VARCHAR)"

    parts = [
        f"SELECT root, file_id, path, i, {sub} AS sub, '{cat}' AS category, {name} AS name, {q(owner)} AS owner, "
        f"{q(trait)} AS owner_trait, {display} AS display_name, CAST({loc} AS BIGINT) AS loc FROM x WHERE k = {k}"
        for k, sub, cat, name, owner, trait, display, loc in rows
    ]
    union = " UNION ALL ".join(parts)
    functions = ", ".join(f"'{c}'" for c in FUNCTIONS)
    return (
        f"it AS (SELECT *, '{language}' AS language, category IN ({functions}) AS is_function FROM ({union}{extra}))"
    )


RUST_TAIL = (
    " UNION ALL SELECT DISTINCT root, file_id, path, 1000000000, 0, 'file_scope_function', 'tail', "
    "CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'tail', CAST(1 AS BIGINT) FROM x"
)
RUST_ITEMS = f"WITH {_lines_of('.rs')}, {_items(_RUST, 'rust', RUST_TAIL)}"
CSHARP_ITEMS = f"WITH {_lines_of('.cs')}, {_items(_CSHARP, 'csharp')}"

_BLOCK_CASE = "CASE k " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(_RUST_BLOCK)) + " END"
RUST_LOC = (
    f"fl AS (SELECT root, file_id, path, CAST(sum({_BLOCK_CASE}) + {_RUST_AROUND} AS BIGINT) AS total_loc "
    "FROM x GROUP BY root, file_id, path)"
)
RUST_TOP = (
    "tp AS (SELECT * FROM (SELECT root, file_id, path, display_name, loc, CAST(row_number() OVER "
    "(PARTITION BY root, file_id ORDER BY loc DESC, display_name, i, sub) AS INT) AS rank FROM it WHERE is_function) WHERE rank <= 3)"
)

ITEM = "root, file_id, path, language, category, name, owner, owner_trait, display_name, loc, is_function"


def items_of(base: str, where: str) -> str:
    return f"{base} SELECT {ITEM} FROM it WHERE {where}"


# Line numbers of the nested corpus follow from the sizes of the blocks before.
NESTED = """x AS (SELECT root, file_id, path, i, i % 4 AS k, len(regexp_extract_all(l, '[A-Za-z]+')) AS n FROM (
  SELECT source AS root, doc_id AS file_id, concat('d', CAST(doc_id AS VARCHAR), '.rs') AS path,
  unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)),
y AS (SELECT *, CASE k WHEN 3 THEN 3 ELSE 0 END AS pre, CASE k WHEN 2 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS post,
  CASE WHEN n = 0 THEN 1 WHEN k = 1 THEN 2 * n - 1 ELSE n END AS body FROM x),
z AS (SELECT *, 2 + pre + coalesce(sum(pre + post + body + 3) OVER (PARTITION BY file_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ln FROM y),
e AS (SELECT root, file_id, path, CAST(2 + sum(pre + post + body + 3) AS INT) AS ln FROM y GROUP BY ALL)"""

BRACKET_DEPTH = f"""WITH {NESTED}
SELECT root, file_id, path, CAST(ln AS INT) AS line_no, event, CAST(depth AS INT) AS depth, CAST(level AS INT) AS level FROM (
  SELECT root, file_id, path, 1 AS ln, '{{' AS event, 1 AS depth, 0 AS level FROM e
  UNION ALL SELECT root, file_id, path, ln, '}}', 0, 0 FROM e
  UNION ALL SELECT root, file_id, path, ln + 1, ';', 0, 0 FROM e
  UNION ALL SELECT root, file_id, path, ln, '{{', 2, 1 FROM z
  UNION ALL SELECT root, file_id, path, ln + body + post + 1, '}}', 1, 1 FROM z
  UNION ALL SELECT root, file_id, path, ln + body + 1, ';', 2, 2 FROM z WHERE k = 2
  UNION ALL SELECT root, file_id, path, ln + body, ';', 2, 2 FROM z WHERE k = 0
  UNION ALL SELECT root, file_id, path, ln + body + 1, '{{', 3, 2 FROM z WHERE k = 0
  UNION ALL SELECT root, file_id, path, ln + body + 1, '}}', 2, 2 FROM z WHERE k = 0)"""

BRACKET_PAIRS = f"""WITH {NESTED}
SELECT root, file_id, path, CAST(ln AS INT) AS line_no, '{{' AS event, CAST(level AS INT) AS level, CAST(close_ln AS INT) AS close_line FROM (
  SELECT root, file_id, path, 1 AS ln, 0 AS level, ln AS close_ln FROM e
  UNION ALL SELECT root, file_id, path, ln, 1, ln + body + post + 1 FROM z
  UNION ALL SELECT root, file_id, path, ln + body + 1, 2, ln + body + 1 FROM z WHERE k = 0)"""

BLOCK_PARENT = f"""WITH {NESTED}
SELECT root, file_id, path, 'impl' AS kind, 'Doc' AS name, 'file' AS parent_kind, CAST(NULL AS VARCHAR) AS parent_name FROM e
UNION ALL SELECT root, file_id, path, 'fn', 'tail', 'file', NULL FROM e
UNION ALL SELECT root, file_id, path, 'fn', concat('f', CAST(i AS VARCHAR)), 'impl', 'Doc' FROM z
UNION ALL SELECT root, file_id, path, 'fn', 'inner', 'fn', concat('f', CAST(i AS VARCHAR)) FROM z WHERE k = 0"""

_JSON_NAMED = "to_json(list({'loc': loc, 'name': name} ORDER BY %s) FILTER (WHERE category = '%s'))"
_JSON_LISTS = {
    "impl_methods": "to_json(list({'impl_target': owner, 'loc': loc, 'method_name': name, 'trait_name': owner_trait} ORDER BY %s) FILTER (WHERE category = 'impl_method'))",
    "trait_methods": "to_json(list({'loc': loc, 'method_name': name, 'trait_name': owner} ORDER BY %s) FILTER (WHERE category = 'trait_method'))",
    "impl_blocks": "to_json(list({'impl_target': name, 'loc': loc, 'trait_name': owner_trait} ORDER BY %s) FILTER (WHERE category = 'impl_block'))",
}
_NAMED_FIELDS = {
    "consts": "const",
    "delegates": "delegate",
    "enums": "enum",
    "events": "event",
    "file_scope_functions": "file_scope_function",
    "statics": "static",
    "structs": "struct",
    "test_functions": "test_function",
    "traits": "trait",
}
_REPORT_ORDER = {
    "impl_methods": "loc DESC, owner_trait NULLS FIRST, owner, name",
    "trait_methods": "loc DESC, owner, name",
    "impl_blocks": "loc DESC, owner_trait NULLS FIRST, name",
}
SUMMARY_FIELDS = sorted([*_NAMED_FIELDS, *_JSON_LISTS, "top_functions", "total_loc"])


def _nested(in_source_order: bool) -> str:
    lists = []
    for field, category in _NAMED_FIELDS.items():
        order = "i, sub" if in_source_order else "loc DESC, name"
        lists.append(f"coalesce(CAST({_JSON_NAMED % (order, category)} AS VARCHAR), '[]') AS {field}")
    for field, template in _JSON_LISTS.items():
        order = "i, sub" if in_source_order else _REPORT_ORDER[field]
        lists.append(f"coalesce(CAST({template % order} AS VARCHAR), '[]') AS {field}")
    return f"""{RUST_ITEMS}, {RUST_LOC}, {RUST_TOP},
 ls AS (SELECT root, file_id, {', '.join(lists)} FROM it GROUP BY root, file_id),
 tl AS (SELECT root, file_id, CAST(to_json(list({{'loc': loc, 'name': display_name}} ORDER BY rank)) AS VARCHAR) AS top_functions FROM tp GROUP BY root, file_id),
 su AS (SELECT fl.*, ls.* EXCLUDE (root, file_id), tl.top_functions FROM fl JOIN ls USING (root, file_id) JOIN tl USING (root, file_id))"""


FILE_SUMMARY = f"{_nested(True)} SELECT root, file_id, path, {', '.join(SUMMARY_FIELDS)} FROM su"

_FIELDS_TEXT = " || ',' || ".join(f"'\"{f}\":' || {f}" for f in SUMMARY_FIELDS)
_FILE_JSON = f"""jf AS (SELECT root, file_id, path, '{{"path":"' || path || '","summary":{{' || {_FIELDS_TEXT} || '}}}}' AS json FROM su)"""
JSON_FILES = f"{_nested(False)}, {_FILE_JSON} SELECT root, file_id, path, json FROM jf"
JSON_REPORT = f"""{_nested(False)}, {_FILE_JSON},
 rt AS (SELECT root, CAST(count(*) AS BIGINT) AS files, CAST(sum(total_loc) AS BIGINT) AS total_loc FROM fl GROUP BY root),
 nf AS (SELECT root, json, row_number() OVER (PARTITION BY root ORDER BY string_split(path, '/'), file_id) AS line_no FROM jf)
SELECT root, CAST(0 AS BIGINT) AS line_no, '{{"exclude_path_regexes":["zzz"],"excludes":["target","obj"],"files":[' AS text FROM rt
UNION ALL SELECT root, line_no, CASE WHEN line_no > 1 THEN ',' ELSE '' END || json FROM nf
UNION ALL SELECT root, files + 1, '],"git_ignore":false,"include_path_regexes":[],"language":"rust","root":{{"kind":"directory","label":"' || root ||
 '","path":"/repos/' || root || '"}},"totals":{{"files":' || CAST(files AS VARCHAR) || ',"total_loc":' || CAST(total_loc AS VARCHAR) || '}}}}' FROM rt"""

SUMMARY_TEXT_CTE = f"""{RUST_ITEMS}, {RUST_LOC}, {RUST_TOP},
 tx AS (SELECT fl.root, fl.file_id, fl.path, CAST(total_loc AS VARCHAR) || ' loc; max fns loc: ' || t AS text FROM fl JOIN (
  SELECT root, file_id, string_agg(display_name || ' (' || CAST(loc AS VARCHAR) || ')', ', ' ORDER BY rank) AS t FROM tp GROUP BY root, file_id) USING (root, file_id))"""

TREE = f"""{SUMMARY_TEXT_CTE},
 fp AS (SELECT *, string_split(path, '/') AS parts FROM tx),
 nodes AS (
  SELECT root, parts, 1 AS is_file, file_id, text FROM fp
  UNION ALL SELECT DISTINCT root, parts[1:d], 0, 0, NULL FROM (SELECT root, parts, unnest(range(1, len(parts))) AS d FROM fp)),
 flagged AS (SELECT *, array_to_string(parts[1:len(parts)-1], '/') AS parent, array_to_string(parts, '/') AS full_path,
  lead(1) OVER (PARTITION BY root, parts[1:len(parts)-1] ORDER BY is_file, parts[len(parts)], file_id) IS NULL AS is_last FROM nodes),
 dirs AS (SELECT root, full_path, is_last FROM flagged WHERE is_file = 0),
 anc AS (SELECT root, file_id, full_path, is_file, unnest(range(1, len(parts))) AS d, parts FROM flagged),
 ind AS (SELECT a.root, a.file_id, a.full_path, a.is_file, string_agg(CASE WHEN dirs.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY d) AS indent
  FROM anc a JOIN dirs ON dirs.root = a.root AND dirs.full_path = array_to_string(a.parts[1:a.d], '/') GROUP BY ALL),
 keyed AS (SELECT f.*, coalesce(indent, '') AS indent,
  [{{'f': CASE WHEN j = len(f.parts) THEN f.is_file ELSE 0 END, 'n': f.parts[j],
    'i': CASE WHEN j = len(f.parts) THEN f.file_id ELSE 0 END}} for j in range(1, len(f.parts) + 1)] AS key
  FROM flagged f LEFT JOIN ind ON ind.root = f.root AND ind.file_id = f.file_id AND ind.full_path = f.full_path AND ind.is_file = f.is_file)
SELECT DISTINCT root, CAST(0 AS BIGINT) AS line_no, '. ' || root || '/' AS text FROM fp
UNION ALL
SELECT root, row_number() OVER (PARTITION BY root ORDER BY key), indent || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || parts[len(parts)] ||
  CASE WHEN is_file = 1 THEN ' (' || text || ')' ELSE '/' END FROM keyed"""

_NAMED = "('file_scope_function','test_function','struct','enum','trait','delegate','event','const','static')"


def _ranked(base: str, where: str, order: str) -> str:
    return f"""{base} SELECT {ITEM}, CAST(row_number() OVER (PARTITION BY root, file_id, category ORDER BY loc DESC, {order}, i, sub) AS INT) AS position
 FROM it WHERE {where}"""


FILE_LIMIT, FN_LIMIT = 500, 80


def oracle_sql() -> dict[str, str]:
    c1, lg = f"WITH {C1}", f"WITH {C1}, {LANGUAGE}"
    selected = (
        "language IS NOT NULL AND NOT (language = 'csharp' AND (gen_dir OR gen_name)) "
        "AND NOT (string_split(path, '/')[1] = 'tests' OR string_split(path, '/')[1:2] = ['src', 'core']) "
        "AND NOT regexp_matches(path, '[13]\\.') AND regexp_matches(path, '^src')"
    )
    functions = "is_function"
    offending = f"""{RUST_ITEMS}, {RUST_LOC},
 kept AS (SELECT * FROM fl WHERE total_loc > {FILE_LIMIT} OR file_id IN (SELECT file_id FROM it WHERE is_function AND loc > {FN_LIMIT}))"""
    word_text = "array_to_string(regexp_extract_all(l, '[A-Za-z]+'), ' ')"
    return {
        "decode_text": "SELECT doc_id, concat(substr(text, 1, 5), chr(65533), substr(text, 6)) AS content FROM documents",
        "read_corpus": f"""SELECT concat({_case('doc_id % 4', ['a', '.hidden/_b', 'c/d/.e', '_f'])}, '/', {_case('doc_id % 3', ['u', '.u', '_u'])},
            CAST(doc_id AS VARCHAR), '.txt') AS path, text AS content FROM documents""",
        "page_corpus": """WITH p AS (SELECT split_part(url, '/', 3) AS root, page_id AS file_id,
              array_to_string(string_split(split_part(split_part(url, '?', 1), '#', 1), '/')[4:], '/') AS path FROM pages)
            SELECT root, file_id, path, CAST(row_number() OVER (PARTITION BY root ORDER BY string_split(path, '/'), file_id) AS BIGINT) AS position
            FROM p WHERE NOT regexp_matches(path, '[02468]$')""",
        "file_root": f"{c1} SELECT root, file_id, base AS path, base AS label, 'file' AS root_kind FROM c1",
        "root_label": "SELECT page_id, regexp_extract(url, '([^/]+)/*$', 1) AS label FROM pages",
        "normalise_path": f"{c1} SELECT root, file_id, path FROM c1",
        "language_match": f"{lg} SELECT root, file_id, path, language FROM lg",
        "generated_dir": f"{lg} SELECT root, file_id, path, gen_dir AS generated FROM lg",
        "generated_name": f"{lg} SELECT root, file_id, path, gen_name AS generated FROM lg",
        "generated_filter": f"{lg} SELECT root, file_id, path FROM lg WHERE NOT (coalesce(language, '') = 'csharp' AND (gen_dir OR gen_name))",
        "exclude_prefix": f"{c1} SELECT root, file_id, path FROM c1 WHERE NOT (string_split(path, '/')[1] = 'src' OR string_split(path, '/')[1:2] = ['lib', 'Bin'])",
        "exclude_regex": f"{c1} SELECT root, file_id, path FROM c1 WHERE NOT (regexp_matches(path, '[13]\\.') OR regexp_matches(path, 'Debug'))",
        "include_regex": f"{c1} SELECT root, file_id, path FROM c1 WHERE regexp_matches(path, '^src') OR regexp_matches(path, '\\.md$')",
        "select_files": f"{lg} SELECT root, file_id, path, language FROM lg WHERE {selected}",
        "ignore_rules": f"""{c1} SELECT root, file_id, path FROM c1 WHERE NOT (
            (path LIKE '%.txt' AND NOT (path LIKE 'src.old/%' AND base LIKE 'Unit_.rs'))
            OR starts_with(path, 'src/core/') OR starts_with(path, 'obj/')
            OR regexp_matches(base, '^Unit[0-9][^0-4]\\.razor$')
            OR (path LIKE '%.md' AND base NOT LIKE 'Unit%1.md')
            OR (path LIKE 'tests/%' AND path LIKE '%.rs' AND path NOT LIKE '%8.rs')
            OR (path LIKE 'src.old/%' AND base NOT LIKE 'Unit_.rs' AND NOT (path LIKE '%.md')
                AND (path NOT LIKE '%.cs' OR base LIKE 'Unit%0.cs' OR base LIKE 'Unit%2.cs')))
            UNION ALL SELECT DISTINCT source, r.i, r.p FROM documents,
              (VALUES (-10, '.ignore'), (-11, 'tests/.gitignore')) AS r(i, p)""",
        "detect_file": f"{lg} SELECT root, file_id, path, language, CASE WHEN language IS NULL THEN 'unknown' ELSE 'ok' END AS status FROM lg",
        "root_markers": f"WITH {SEEN} SELECT root, has_cargo_toml, has_dotnet_marker FROM seen",
        "language_counts": f"WITH {SEEN} SELECT root, rust_files, csharp_files FROM seen",
        "detect_language": f"WITH {SEEN} SELECT root, language, CASE WHEN language IS NULL THEN 'ambiguous' ELSE 'ok' END AS status FROM det",
        "scan_detected": f"WITH {SEEN} SELECT ml.root, file_id, path, ml.language FROM ml JOIN det ON ml.root = det.root AND ml.language = det.language",
        "file_loc": f"""WITH {C1}, {SPACED} SELECT root, file_id, path,
            CAST(len([l for l in string_split(content, chr(10)) if regexp_matches(l, '{NON_BLANK}')]) AS BIGINT) AS total_loc FROM sp""",
        "lines": f"""WITH {C1}, {SPACED} SELECT root, file_id, path, CAST(line_no AS INT) AS line_no, regexp_replace(raw, '\\r$', '') AS line,
            regexp_matches(raw, '{NON_BLANK}') AS nonblank FROM li""",
        "span_loc": f"""WITH {C1}, {SPACED}, nb AS (SELECT root, file_id, path,
              [CASE WHEN regexp_matches(l, '{NON_BLANK}') THEN 1 ELSE 0 END for l in parts[1:len(parts)-1]] AS f FROM ln),
            s AS (SELECT root, file_id, f, unnest(range(1, len(f) + 1)) AS a FROM nb)
            SELECT root, file_id, CAST(a AS INT) AS start_line, CAST(a + file_id % 5 AS INT) AS end_line,
              CAST(list_sum(f[a:a + file_id % 5]) AS BIGINT) AS loc FROM s WHERE list_sum(f[a:a + file_id % 5]) > 0""",
        "mask_source": f"""SELECT source AS root, file_id, array_to_string([concat('let s = ',
              repeat(' ', 3 + length({word_text})), '; ', repeat(' ', 3 + length({word_text}))) for l in ls], chr(10)) AS masked
            FROM (SELECT source, doc_id AS file_id, string_split(text, chr(10)) AS ls FROM documents)""",
        "bracket_depth": BRACKET_DEPTH,
        "bracket_pairs": BRACKET_PAIRS,
        "block_parent": BLOCK_PARENT,
        "rust_functions": items_of(RUST_ITEMS, "category IN ('file_scope_function', 'test_function')"),
        "rust_type_defs": items_of(RUST_ITEMS, "category IN ('struct', 'enum')"),
        "rust_consts": items_of(RUST_ITEMS, "category IN ('const', 'static')"),
        "rust_trait_methods": items_of(RUST_ITEMS, "category IN ('trait', 'trait_method')"),
        "rust_impl_blocks": items_of(RUST_ITEMS, "category = 'impl_block'"),
        "rust_impl_methods": items_of(RUST_ITEMS, "category = 'impl_method'"),
        "csharp_types": items_of(CSHARP_ITEMS, "category = 'struct' OR (category = 'impl_block' AND owner_trait IS NULL)"),
        "csharp_interfaces": items_of(CSHARP_ITEMS, "category = 'trait' OR owner_trait = 'interface'"),
        "csharp_enums": items_of(CSHARP_ITEMS, "category = 'enum'"),
        "csharp_delegates": items_of(CSHARP_ITEMS, "category = 'delegate'"),
        "csharp_events": items_of(CSHARP_ITEMS, "category = 'event'"),
        "csharp_fields": items_of(CSHARP_ITEMS, "category IN ('const', 'static')"),
        "csharp_callables": items_of(CSHARP_ITEMS, "category IN ('impl_method', 'trait_method') AND NOT regexp_matches(name, '\\.')"),
        "csharp_accessors": items_of(CSHARP_ITEMS, "category IN ('impl_method', 'trait_method') AND regexp_matches(name, '\\.')"),
        "csharp_local_functions": items_of(CSHARP_ITEMS, "category = 'file_scope_function'"),
        "csharp_top_level": f"""WITH {_lines_of('.cs')} SELECT root, file_id, path, 'top-level statements' AS name,
            CAST(2 + sum(CASE i % 3 WHEN 1 THEN n + 7 ELSE n + 3 END) AS BIGINT) AS loc FROM x GROUP BY root, file_id, path""",
        "scan_status": " UNION ALL ".join(_statuses(language) for language in ENDINGS),
        "top_functions": f"{RUST_ITEMS}, {RUST_TOP} SELECT root, file_id, path, rank, display_name, loc FROM tp",
        "function_pool": items_of(RUST_ITEMS, functions),
        "offending_functions": items_of(RUST_ITEMS, f"{functions} AND loc > {FN_LIMIT}"),
        "offending_files": f"{offending} SELECT root, file_id, path, total_loc FROM kept",
        # one row per file tells both limits; items meet it by their file
        "offender_items": f"""{RUST_ITEMS}, {RUST_LOC},
            worst AS (SELECT root, file_id, max(CASE WHEN is_function THEN loc ELSE 0 END) AS longest FROM it GROUP BY root, file_id),
            kept AS (SELECT fl.root, fl.file_id FROM fl LEFT JOIN worst USING (root, file_id)
              WHERE total_loc > {FILE_LIMIT} OR longest > {FN_LIMIT})
            SELECT {ITEM} FROM it JOIN kept USING (root, file_id) WHERE NOT is_function OR loc > {FN_LIMIT}""",
        "totals": f"""{offending} SELECT r.root, CAST(count(kept.file_id) AS BIGINT) AS files, CAST(coalesce(sum(total_loc), 0) AS BIGINT) AS total_loc
            FROM (SELECT DISTINCT source AS root FROM documents UNION SELECT 'empty/' || n_name FROM nation) r LEFT JOIN kept ON kept.root = r.root GROUP BY r.root""",
        "file_summary": FILE_SUMMARY,
        "ordered_files": f"""{c1} SELECT root, file_id, path, CAST(row_number() OVER (PARTITION BY root ORDER BY string_split(path, '/'), file_id) AS BIGINT) AS position FROM c1""",
        "ordered_named": _ranked(RUST_ITEMS, f"category IN {_NAMED}", "name"),
        "ordered_impl_methods": _ranked(RUST_ITEMS, "category = 'impl_method'", "owner_trait NULLS FIRST, owner, name"),
        "ordered_trait_methods": _ranked(RUST_ITEMS, "category = 'trait_method'", "owner, name"),
        "ordered_impl_blocks": _ranked(RUST_ITEMS, "category = 'impl_block'", "owner_trait NULLS FIRST, name"),
        "json_files": JSON_FILES,
        "json_report": JSON_REPORT,
        "summary_text": f"{SUMMARY_TEXT_CTE} SELECT root, file_id, path, text FROM tx",
        "tree_report": TREE,
        "tree_file_root": f"{SUMMARY_TEXT_CTE} SELECT root, file_id, CAST(0 AS BIGINT) AS line_no, '. ' || string_split(path, '/')[-1] || ' (' || text || ')' AS text FROM tx",
        "tree_empty": f"""WITH {SEEN}, gone AS (SELECT root FROM det WHERE language IS DISTINCT FROM 'rust')
            SELECT root, CAST(0 AS BIGINT) AS line_no, '. ' || root || '/' AS text FROM gone
            UNION ALL SELECT root, 1, '└── no files matched language rust' FROM gone""",
    }
