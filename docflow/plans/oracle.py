"""DuckDB SQL that gives the same rows as the catalogue's queries.

RE2 has no look-around and an ASCII \\s, so white space is spelt out and patterns differ
from Spark's where they must.
"""

from __future__ import annotations

from .fixtures import SQL as MD

_W = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS, NW = f"[{_W}]", f"[^{_W}]"
LIST = f"^{WS}*(?:[-*+]|[0-9]+[.)]){WS}+"
TOP = f"^(?:[-*+]|[0-9]+[.)]){WS}+"
FENCE = r"^[ \t]{0,3}(?:```|~~~)"
OVER = "OVER (PARTITION BY doc_id ORDER BY line_no)"


def has(c: str, p: str) -> str:
    return f"regexp_matches({c}, '{p}')"


def sub(c: str, p: str, to: str) -> str:
    return f"regexp_replace({c}, '{p}', '{to}', 'g')"


def strip(c: str) -> str:
    return sub(c, f"^{WS}+|{WS}+$", "")


def rstrip(c: str) -> str:
    return sub(c, f"{WS}+$", "")


def blank(c: str) -> str:
    return f"NOT {has(c, NW)}"


def lines(table: str, name: str = "ln", key: str = "doc_id") -> str:
    return f"{name} AS (SELECT {key} AS doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM {table})"


def states(src: str = "ln", name: str = "st") -> str:
    """Lines with b (blank), m (fence mark), f (in fence), fm (front matter's end) and s (skip)."""
    mark = has("line", f"^---{WS}*$")
    return f"""{name}0 AS (SELECT *, {blank('line')} AS b, {has('line', FENCE)} AS m FROM {src}),
{name}1 AS (SELECT *, sum(m::INT) {OVER} AS mc FROM {name}0),
{name}2 AS (SELECT *, m OR mc % 2 = 1 AS f FROM {name}1),
fm_{name} AS (SELECT doc_id, CASE WHEN bool_or(line_no = 0 AND {mark}) THEN coalesce(min(CASE WHEN line_no > 0 AND {mark} THEN line_no END) + 1, 0) ELSE 0 END AS fm FROM {src} GROUP BY doc_id),
{name} AS (SELECT a.*, fm, f OR line_no < fm AS s FROM {name}2 a JOIN fm_{name} USING (doc_id))"""


X = f"WITH {MD}, {lines('md_docs')}, {states()}"
D = f"WITH {lines('documents')}, {states()}"


def rewritten(hit: str, new: str, n: str = "1", head: str = X, src: str = "st", order: str = "line_no") -> str:
    """doc_id, n, text: lines where hit holds become new, and count n."""
    return f"{head} SELECT doc_id, cast(sum(CASE WHEN {hit} THEN {n} ELSE 0 END) AS BIGINT) AS n, string_agg(CASE WHEN {hit} THEN {new} ELSE line END, chr(10) ORDER BY {order}) AS text FROM {src} GROUP BY doc_id"


def dropped(hit: str, head: str = X, src: str = "st") -> str:
    return f"{head} SELECT doc_id, cast(count(*) FILTER (WHERE {hit}) AS BIGINT) AS n, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT ({hit})), '') AS text FROM {src} GROUP BY doc_id"


def inserted(above: str, below: str, head: str, src: str) -> str:
    """Empty lines above and below."""
    up, down = f"CASE WHEN {above} THEN chr(10) ELSE '' END", f"CASE WHEN {below} THEN chr(10) ELSE '' END"
    return f"{head} SELECT doc_id, cast(sum(CASE WHEN {above} THEN 1 ELSE 0 END + CASE WHEN {below} THEN 1 ELSE 0 END) AS BIGINT) AS n, string_agg({up} || line || {down}, chr(10) ORDER BY line_no) AS text FROM {src} GROUP BY doc_id"


PAGE = "(" + " OR ".join(has("line", p) for p in (
    f"^{WS}*[0-9]{{1,4}}{WS}*$", f"^{WS}*[-–—]{WS}*[0-9]{{1,4}}{WS}*[-–—]{WS}*$", f"^{WS}*[0-9]{{1,4}}{WS}*/{WS}*[0-9]{{1,4}}{WS}*$",
    f"(?i)^{WS}*page{WS}+[0-9]{{1,4}}({WS}+of{WS}+[0-9]{{1,4}})?{WS}*$", f"(?i)^{WS}*[0-9]{{1,4}}{WS}+of{WS}+[0-9]{{1,4}}{WS}*$")) + ")"
_NB = f"{X}, nb AS (SELECT *, coalesce(lag(NOT b) {OVER}, false) AS pb, coalesce(lead(NOT b) {OVER}, false) AS nx FROM st)"

# Heading text and what is left of it
_HEAD = f"^({WS}*)(#{{1,6}})[ \\t]*(.*?){WS}*$"
_TITLE = f"regexp_extract(line, '{_HEAD}', 3)"
_BARE = sub(_TITLE, f"(?:{WS}*[.,;:!])+$", "")
# R7, twice: adjacent URLs share a delimiter
_URL = f"(^|{WS}|^\\(|[^\\]]\\()(https?://[^{_W}<>)\\]`]+?)([.,;:!?]?)($|[{_W})])"
_URLS = f"CASE WHEN i % 2 = 1 THEN {sub(sub('x', _URL, chr(92) + '1<' + chr(92) + '2>' + chr(92) + '3' + chr(92) + '4'), _URL, chr(92) + '1<' + chr(92) + '2>' + chr(92) + '3' + chr(92) + '4')} ELSE x END"
_URL_LINE = f"list_aggregate(list_transform(string_split(line, chr(96)), lambda x, i: {_URLS}), 'string_agg', chr(96))"
# R9
_NUM = f"^([0-9]+(?:\\.[0-9]+)+|[0-9]+\\.){WS}+({NW}.*?){WS}*$"
_N1, _N2 = f"regexp_extract(line, '{_NUM}', 1)", f"regexp_extract(line, '{_NUM}', 2)"
_ITEM = f"^{WS}*[0-9]+[.)]{WS}"
_DEPTH = f"(length(rtrim({_N1}, '.')) - length(replace(rtrim({_N1}, '.'), '.', '')) + 1)"
_NEAR = f"""{X}, ni AS (SELECT *, CASE WHEN NOT b THEN {has('line', _ITEM)} END AS it FROM st),
nr AS (SELECT *, coalesce(last_value(it IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
 OR coalesce(first_value(it IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS near FROM ni)"""
_WORDS = f"len(list_filter(regexp_split_to_array({_N2}, '{WS}+'), lambda w: w <> ''))"
# R10
_BLOCK = f"^{WS}*(?:#{{1,6}}{WS}|>|\\||```|~~~|<)"
_ISLES = f"""{X}, ra AS (SELECT *, {has('line', LIST)} AS li, coalesce(right({rstrip('lag(line) ' + OVER)}, 1) IN ('.', '!', '?', ':', ';'), false) AS en FROM st),
rb AS (SELECT *, f OR b OR li OR {has('line', _BLOCK)} OR en AS br FROM ra),
rc AS (SELECT *, sum(br::INT) {OVER} AS g FROM rb),
rd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY line_no) AS r, first_value(li AND NOT f AND br) OVER (PARTITION BY doc_id, g ORDER BY line_no) AS il, count(*) OVER (PARTITION BY doc_id, g) AS k FROM rc),
re AS (SELECT doc_id, g, min(line_no) AS line_no, count(*) - 1 AS folded, {rstrip('first(line ORDER BY line_no)')} || ' ' || string_agg({strip('line')}, ' ' ORDER BY line_no) FILTER (WHERE r > 1) AS line FROM rd WHERE il AND k > 1 GROUP BY doc_id, g),
rf AS (SELECT doc_id, line_no, line, folded FROM re UNION ALL SELECT doc_id, line_no, line, 0 FROM rd WHERE NOT (il AND k > 1))
SELECT doc_id, cast(sum(folded) AS BIGINT) AS n, string_agg(line, chr(10) ORDER BY line_no) AS text FROM rf GROUP BY doc_id"""
# R13-R15
_H = f"{X}, h0 AS (SELECT *, NOT s AND {has('line', f'^{WS}*#')} AS h FROM st), h1 AS (SELECT *, h AND coalesce(lag(NOT b) {OVER}, false) AND NOT coalesce(lag(h) {OVER}, false) AS up, h AND coalesce(lead(NOT b) {OVER}, false) AS dn FROM h0)"
_F = f"{X}, f0 AS (SELECT *, m AND mc % 2 = 1 AS o, m AND mc % 2 = 0 AS c FROM st), f1 AS (SELECT *, o AND coalesce(lag(NOT b) {OVER}, false) AND NOT coalesce(lag(c) {OVER}, false) AS up, c AND coalesce(lead(NOT b) {OVER}, false) AS dn FROM f0)"
_L = f"""{X}, l0 AS (SELECT *, {has('line', TOP)} AS tp FROM st),
l1 AS (SELECT *, NOT s AND ({has('line', LIST)} OR {has('line', '^[ \\t]')} OR (b AND coalesce(lead(tp) {OVER}, false))) AS stay, NOT s AND tp AS st0 FROM l0),
l2 AS (SELECT *, sum((NOT stay)::INT) {OVER} AS sg FROM l1),
l3 AS (SELECT *, stay AND max(st0::INT) OVER (PARTITION BY doc_id, sg ORDER BY line_no) = 1 AS mem FROM l2),
l4 AS (SELECT *, coalesce(lag(mem) {OVER}, false) AS was, coalesce(lag(NOT b) {OVER}, false) AS pb FROM l3)"""
# C1
_BRK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_C1 = f"""WITH {MD}, p0 AS (SELECT doc_id, text, string_split(regexp_replace(text, '{_BRK}', chr(10), 'g'), chr(10)) AS a FROM md_docs),
p1 AS (SELECT doc_id, text, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM p0)
SELECT doc_id, cast(len(list_filter(a, lambda x: {has('x', f'^#{{1,6}}{WS}*$')} OR {has('x', f'^#{{1,6}}{WS}+!\\[[^\\]]*\\]\\([^)]*\\){WS}*$')})) AS INT) AS altered,
 coalesce(list_aggregate(list_transform(list_filter(a, lambda x: NOT {has('x', f'^#{{1,6}}{WS}*$')}), lambda x: {sub('x', f'^#{{1,6}}{WS}+(!\\[[^\\]]*\\]\\([^)]*\\)){WS}*$', chr(92) + '1')}), 'string_agg', chr(10)), '') || CASE WHEN text LIKE '%' || chr(10) THEN chr(10) ELSE '' END AS text FROM p1"""
# Index
VOLUME = "source || '-' || (doc_id // 1000)"
SRC = f"{MD}, by_source AS (SELECT {VOLUME} AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM md_docs GROUP BY 1), {lines('by_source')}"
_CODE = r'[(){}\[\]<>=;*+|/\\"' + "''`]"
_S = "bare"
_LETTERS = sub(_S, r"\P{L}", "")
_SW = f"list_filter(regexp_split_to_array({_S}, '{WS}+'), lambda w: w <> '')"
_TW = f"list_filter({_SW}, lambda w: {has('w', '\\p{L}')})"
_NH = f"^{WS}*([0-9]+(?:\\.[0-9]+){{0,5}})\\.?{WS}+({NW}.{{0,120}})$"
_NHT = "rtrim(" + strip(f"regexp_extract(line, '{_NH}', 2)") + ", '.')"
_NHN = f"regexp_extract(line, '{_NH}', 1)"
_DIG = sub(_NHT, "[., ]", "")
_NM = f"(?i)^{WS}*(Chapter|Section|Part|Appendix|Annex){WS}+([IVXLCDM]+|[0-9]+)\\b[{_W}:.\\-–—]*(.{{0,120}})?$"
_NMT = "rtrim(" + strip(f"regexp_extract(line, '{_NM}', 3)") + ", '.')"


def _title(c: str) -> str:
    return f"list_aggregate(list_transform(regexp_extract_all({c}, '\\p{{L}}+|\\P{{L}}+'), lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(left(w, 1)) END || lower(substr(w, 2))), 'string_agg', '')"


_ATX = f"^(#{{1,6}}){WS}+(.+?){WS}*$"
BOIL = f"bo0 AS (SELECT *, {strip('line')} AS bare FROM ln), bo AS (SELECT *, length(bare) BETWEEN 3 AND 120 AND count(*) OVER (PARTITION BY doc_id, bare) >= 4 AS boiler FROM bo0)"
HEADS = f"""{BOIL}, hc AS (SELECT *, coalesce({blank('lag(line) ' + OVER)}, true) AS pb, {blank('coalesce(lead(line) ' + OVER + ", '')")} AS nb, length({strip('coalesce(lead(line) ' + OVER + ", '')")}) > 60 AS np FROM bo),
hd AS (SELECT doc_id, line_no + 1 AS line_no, CASE
 WHEN {has('line', _ATX)} THEN struct_pack(level := length(regexp_extract(line, '{_ATX}', 1)), title := {strip(f"regexp_extract(line, '{_ATX}', 2)")}, kind := 'atx')
 WHEN {has('line', _NH)} AND length({_NHT}) >= 2 AND NOT {has(_DIG, '^[0-9]+$')} AND NOT {has(_NHT, _CODE)} AND (position('.' IN {_NHN}) > 0 OR pb) THEN struct_pack(level := least(6, length({_NHN}) - length(replace({_NHN}, '.', '')) + 1), title := {_NHN} || ' ' || {_NHT}, kind := 'numbered')
 WHEN {has('line', _NM)} THEN struct_pack(level := 1, title := {_title(f"regexp_extract(line, '{_NM}', 1)")} || ' ' || regexp_extract(line, '{_NM}', 2) || CASE WHEN {_NMT} <> '' THEN ' — ' || {_NMT} ELSE '' END, kind := 'named')
 WHEN length(bare) BETWEEN 5 AND 80 AND NOT {has(_S, _CODE)} AND length({_LETTERS}) >= 4 AND {has(_LETTERS, '^\\p{Lu}+$')} AND NOT {has(_S, '[.:,;]$')} AND len({_SW}) BETWEEN 1 AND 10 AND (pb OR nb OR np) THEN struct_pack(level := 2, title := {_title(_S)}, kind := 'caps')
 WHEN pb AND np AND length(bare) BETWEEN 8 AND 80 AND NOT {has(_S, _CODE)} AND NOT {has(_S, '[.:,;]$')} AND len({_TW}) BETWEEN 2 AND 10 AND 10 * len(list_filter({_TW}, lambda w: {has('w', '^\\p{Lu}')})) >= 7 * len({_TW}) THEN struct_pack(level := 3, title := bare, kind := 'title')
 END AS h FROM hc WHERE bare <> '' AND NOT boiler AND NOT starts_with(bare, '|')),
heads AS (SELECT doc_id, cast(h.level AS INT) AS level, h.title AS title, line_no, h.kind AS kind FROM hd WHERE h IS NOT NULL)"""
DEDUP = f"""{HEADS}, dd AS (SELECT *, count(*) OVER (PARTITION BY doc_id, title) AS c, row_number() OVER (PARTITION BY doc_id, title ORDER BY line_no) AS r FROM heads),
de AS (SELECT *, lag(title) {OVER} AS pv FROM dd WHERE c <= 10 OR r = 1),
dedup AS (SELECT doc_id, level, title, line_no, kind FROM de WHERE title IS DISTINCT FROM pv)"""
_M = f"(?i)^{WS}*(Get|Post|Put|Patch|Delete){WS}+method{WS}*[:\\-]?{WS}*(/[A-Za-z0-9_\\-{{}}/.]+)"
_I = f"(?i)^{WS}*(GET|POST|PUT|PATCH|DELETE){WS}+(/[A-Za-z0-9_\\-{{}}/.]+){WS}*$"
_PP = "list_filter(string_split(path, '/'), lambda x: x <> '')"
ENDS = f"""en0 AS (SELECT doc_id, line_no + 1 AS line_no, CASE WHEN {has('line', _M)} THEN struct_pack(m := upper(regexp_extract(line, '{_M}', 1)), p := rtrim(regexp_extract(line, '{_M}', 2), '.'))
 WHEN {has('line', _I)} THEN struct_pack(m := upper(regexp_extract(line, '{_I}', 1)), p := rtrim(regexp_extract(line, '{_I}', 2), '.')) END AS e FROM bo WHERE NOT boiler),
en1 AS (SELECT doc_id, e.m AS method, e.p AS path, line_no FROM en0 WHERE e IS NOT NULL),
ends AS (SELECT *, coalesce(CASE WHEN len({_PP}) >= 2 AND lower({_PP}[1]) IN ('api', 'v1', 'v2') THEN {_PP}[2] ELSE {_PP}[1] END, path) AS grp FROM en1)"""
GROUPS = f"""{ENDS}, gr0 AS (SELECT doc_id, grp, min(line_no) AS first, count(*) AS k, string_agg(method || ' ' || path || ' ' || line_no, ';' ORDER BY line_no) AS members, string_agg('- `' || method || ' ' || path || '` (line ' || line_no || ')', chr(10) ORDER BY line_no) AS md FROM ends GROUP BY doc_id, grp),
grps AS (SELECT *, cast(row_number() OVER (PARTITION BY doc_id ORDER BY lower(grp), first) - 1 AS INT) AS place FROM gr0)"""
_NN = "chr(10) || chr(10)"
INDEX = f"""WITH {SRC}, {DEDUP}, {GROUPS},
ih AS (SELECT doc_id, count(*) AS n, string_agg(repeat('  ', greatest(level - 1, 0)) || '- ' || title || ' (line ' || line_no || ')', chr(10) ORDER BY line_no) AS md FROM dedup GROUP BY doc_id),
ie AS (SELECT doc_id, sum(k) AS n, string_agg('### ' || grp || {_NN} || md, {_NN} ORDER BY place) AS md FROM grps GROUP BY doc_id)
SELECT b.doc_id, concat_ws({_NN}, '# Index of ' || b.doc_id,
 'Auto-generated navigation index. ' || coalesce(nullif(concat_ws(', ', CASE WHEN ih.n > 0 THEN ih.n || ' sections' END, CASE WHEN ie.n > 0 THEN ie.n || ' endpoints' END), ''), 'no structured sections detected') || '. Line numbers refer to the main file.',
 CASE WHEN ih.n > 0 THEN '## Sections' || {_NN} || ih.md END, CASE WHEN ie.n > 0 THEN '## Endpoints' || {_NN} || ie.md END,
 CASE WHEN ih.n IS NULL AND ie.n IS NULL THEN '_No headings, sections, or endpoint patterns were detected._' END) || chr(10) AS index
FROM by_source b LEFT JOIN ih USING (doc_id) LEFT JOIN ie USING (doc_id) WHERE len(string_split(b.text, chr(10))) >= 500"""

_FIT = f"NOT f AND length({strip('line')}) >= 8 AND NOT starts_with({strip('line')}, '#') AND NOT {has('line', LIST)}"
_RUN = f"{D}, ru0 AS (SELECT *, {strip('line')} AS bare, {_FIT} AS fit FROM st), ru AS (SELECT *, fit AND count(*) FILTER (WHERE fit) OVER (PARTITION BY doc_id, bare) >= 3 AS boiler FROM ru0)"


def oracle_sql() -> dict[str, str]:
    ws5, nonhash = f"^({WS}*)(#{{1,6}})([^# \\t].*)$", "\\1\\2 \\3"
    bullet = f"^({WS}*)[•‣⁃∙●○◦▪▫□◾◼◻]{WS}+({NW}.*)$"
    callout = f"^({WS}*)([0-9]{{1,3}})\\){WS}*$"
    soft = f"length(line) - length({rstrip('line')}) = 2 AND line LIKE '%  ' AND {rstrip('line')} <> ''"
    md009 = f"{rstrip('line')} || CASE WHEN {soft} THEN '  ' ELSE '' END"
    h1 = f"line_no >= fm AND NOT f AND (starts_with({sub('line', f'^{WS}+', '')}, '# ') OR {sub('line', f'^{WS}+', '')} = '#')"
    md025 = f"{X}, ti AS (SELECT doc_id, bool_or(line_no < fm AND {has('line', f'(?i)^{WS}*title{WS}*:{WS}*{NW}')}) AS t, min(CASE WHEN {h1} THEN line_no END) AS a FROM st GROUP BY doc_id), tj AS (SELECT st.*, coalesce(t AND fm > 0 AND line_no = a, false) AS hit FROM st JOIN ti USING (doc_id))"
    heading = f"NOT s AND NOT {has('line', f'^{WS}*#')} AND NOT {has('line', f'^{WS}*[-*+]{WS}')} AND {has('line', _NUM)} AND length({_N2}) <= 50 AND {_WORDS} <= 7 AND right({_N2}, 1) NOT IN ('.', ':', ',', ';', '!') AND ({_DEPTH} > 1 OR NOT near)"
    out = {
        "line_explode": f"WITH {lines('documents')} SELECT doc_id, cast(line_no AS INT) AS line_no, line FROM ln",
        "line_rejoin": "SELECT doc_id, text FROM documents",
        "fence_state": f"{X} SELECT doc_id, cast(line_no AS INT) AS line_no, f AS in_fence FROM st",
        "frontmatter_end": f"{X} SELECT DISTINCT doc_id, cast(fm AS INT) AS fm_end FROM st",
        "skip_lines": f"{X} SELECT doc_id, cast(count(*) FILTER (WHERE s) AS BIGINT) AS n_skipped FROM st GROUP BY doc_id",
        "strip_headers_footers": f"{_RUN} SELECT doc_id, cast(count(*) FILTER (WHERE boiler) AS BIGINT) AS n, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT boiler), '') AS text FROM ru GROUP BY doc_id",
        "boilerplate_lines": f"WITH {lines('documents')}, {BOIL} SELECT doc_id, bare, cast(count(*) AS BIGINT) AS n FROM bo WHERE boiler GROUP BY ALL",
        "strip_empty_headings": _C1,
        "strip_page_numbers": dropped(f"NOT f AND {PAGE} AND NOT pb AND NOT nx", _NB, "nb"),
        "lint_formfeed": rewritten("contains(line, chr(12))", "replace(line, chr(12), '')", "length(line) - length(replace(line, chr(12), ''))"),
        "lint_md010": rewritten("NOT s AND contains(line, chr(9))", "replace(line, chr(9), '    ')"),
        "lint_md025": rewritten("hit", sub("line", f"^({WS}*)#", "\\1##"), "1", md025, "tj"),
        "lint_md009": rewritten(f"NOT s AND {md009} <> line", md009),
        "lint_md018": rewritten(f"NOT s AND {has('line', ws5)}", sub("line", ws5, nonhash)),
        "lint_md026": rewritten(f"NOT s AND {has('line', f'^{WS}*#')} AND {_TITLE} <> '' AND {_BARE} <> {_TITLE}", f"regexp_extract(line, '{_HEAD}', 1) || regexp_extract(line, '{_HEAD}', 2) || ' ' || {_BARE}"),
        "lint_md034": rewritten(f"NOT s AND {_URL_LINE} <> line", _URL_LINE, f"len({_URL_LINE}) - len(replace({_URL_LINE}, '<http', '<htt')) - (len(line) - len(replace(line, '<http', '<htt')))"),
        "lint_bullet": rewritten(f"NOT f AND {has('line', bullet)}", sub("line", bullet, "\\1- \\2")),
        "lint_heading": rewritten(heading, f"repeat('#', least({_DEPTH} + 1, 6)) || ' ' || {_N1} || ' ' || {_N2}", "1", _NEAR, "nr"),
        "lint_rejoin": _ISLES,
        "lint_callout": rewritten(f"NOT f AND {has('line', callout)}", sub("line", callout, "\\1\\2\\\\)")),
        "lint_md022": inserted("up", "dn", _H, "h1"),
        "lint_md031": inserted("up", "dn", _F, "f1"),
        "lint_md032": inserted("(st0 AND NOT was AND pb) OR (was AND NOT mem AND NOT b)", "false", _L, "l4"),
        "lint_md012": dropped(f"q AND p", f"{X}, q0 AS (SELECT *, b AND NOT s AS q FROM st), q1 AS (SELECT *, coalesce(lag(q) {OVER}, false) AS p FROM q0)", "q1"),
        "lint_md047": f"WITH {MD}, nl AS (SELECT doc_id, text AS old, CASE WHEN text = '' THEN '' ELSE regexp_replace(text, '\\n+$', '') || chr(10) END AS text FROM md_docs) SELECT doc_id, cast(text <> old AS BIGINT) AS n, text FROM nl",
        "headings": f"WITH {SRC}, {HEADS} SELECT doc_id, level, title, cast(line_no AS INT) AS line_no, kind FROM heads",
        "headings_dedup": f"WITH {SRC}, {DEDUP} SELECT doc_id, level, title, cast(line_no AS INT) AS line_no, kind FROM dedup",
        "endpoints": f"WITH {SRC}, {BOIL}, {ENDS} SELECT doc_id, method, path, cast(line_no AS INT) AS line_no, grp FROM ends",
        "endpoint_groups": f"WITH {SRC}, {BOIL}, {GROUPS} SELECT doc_id, grp, place, members FROM grps",
        "index_render": INDEX,
        "index_gate": f"WITH {SRC} SELECT doc_id, len(string_split(text, chr(10))) >= 500 AS should_index FROM by_source",
        "line_predicates": f"WITH {lines('documents')} SELECT doc_id, cast(line_no AS INT) AS line_no, {has('line', _CODE)} AS code, length({sub('line', chr(92) + 'P{L}', '')}) >= 3 AND NOT contains(line, '|') AS worthy FROM ln",
    }
    out |= {
        "table_markdown": """WITH r AS (SELECT n_regionkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, cast(n_nationkey AS VARCHAR) AS a, n_name AS b FROM nation UNION ALL SELECT r_regionkey, 0, 'key', r_name FROM region),
w AS (SELECT k, greatest(3, max(length(a))) AS wa, greatest(3, max(length(b))) AS wb FROM r GROUP BY k)
SELECT k AS region, string_agg('| ' || rpad(a, wa::INT, ' ') || ' | ' || rpad(b, wb::INT, ' ') || ' |' || CASE WHEN i = 0 THEN chr(10) || '|' || repeat('-', wa + 2) || '|' || repeat('-', wb + 2) || '|' ELSE '' END, chr(10) ORDER BY i) AS markdown FROM r JOIN w USING (k) GROUP BY k""",
        "body_font_size": """WITH n AS (SELECT l_suppkey, round_even(l_quantity, 1) AS s, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem WHERE l_quantity <> 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f) AS k FROM n) SELECT l_suppkey, s AS body_size FROM r WHERE k = 1""",
        "heading_levels": "SELECT l_orderkey, l_linenumber, cast(CASE WHEN l_quantity / 20.0 >= 1.8 THEN 1 WHEN l_quantity / 20.0 >= 1.45 THEN 2 WHEN l_quantity / 20.0 >= 1.2 THEN 3 END AS INT) AS level FROM lineitem",
        "scanned_ratio": f"SELECT source, count(*) AS n_pages, count(*) FILTER (WHERE length({strip('text')}) < 50 AND doc_id % 7 > 0) AS n_scanned, count(*) FILTER (WHERE length({strip('text')}) < 50 AND doc_id % 7 > 0) >= count(*) * 0.8 AS is_scanned FROM documents GROUP BY source",
        "media_dedupe": f"""WITH a AS (SELECT {VOLUME} AS volume, doc_id, sha256(text) AS digest FROM documents), b AS (SELECT *, min(doc_id) OVER (PARTITION BY volume, digest) AS f FROM a)
SELECT volume, doc_id, digest, cast(dense_rank() OVER (PARTITION BY volume ORDER BY f) AS INT) AS image_no FROM b""",
        "media_order": f"""WITH a AS (SELECT doc_id, 'word/media/' || CASE WHEN doc_id % 3 = 0 THEN 'logo' || doc_id % 11 ELSE 'image' || doc_id % 30 END || '.png' AS entry_name, {VOLUME} AS volume FROM documents),
b AS (SELECT *, regexp_extract(entry_name, 'image([0-9]+)', 1) AS n FROM a) SELECT volume, doc_id, entry_name, cast(row_number() OVER (PARTITION BY volume ORDER BY n = '', coalesce(try_cast(n AS INT), 0), CASE WHEN n = '' THEN regexp_extract(entry_name, '/([^/.]+)[.]', 1) ELSE '' END, doc_id) AS INT) AS nth FROM b""",
        "placeholder_media": f"""WITH {MD}, t AS (SELECT doc_id, {VOLUME} AS volume, unnest(range(1, 1 + (len(string_split(text, 'data:image/png;base64...')) - 1))) AS nth FROM md_docs), t1 AS (SELECT * FROM t),
m AS (SELECT {VOLUME} AS volume, row_number() OVER (PARTITION BY {VOLUME} ORDER BY doc_id) AS nth, doc_id AS media FROM documents), c AS (SELECT volume, max(nth) AS n FROM m GROUP BY volume)
SELECT t1.doc_id, cast(t1.nth AS INT) AS nth, m.media FROM t1 LEFT JOIN c USING (volume) LEFT JOIN m ON m.volume = t1.volume AND m.nth = least(t1.nth, c.n)""",
        "substitute_markers": f"""WITH {MD} SELECT doc_id, regexp_replace(regexp_replace(text, '<!--image:x([0-2]):w[0-9]+:h[0-9]+-->', '![image](images/d' || doc_id || '_x\\1.png)', 'g'), '<!--image:x[0-9]+:w[0-9]+:h[0-9]+-->', '', 'g') AS text,
 cast(len(regexp_extract_all(text, '<!--image:x[0-2]:w[0-9]+:h[0-9]+-->')) AS BIGINT) AS n_placed FROM md_docs""",
        "safe_stems": "SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'image') AS stem FROM pages",
        "queue_destinations": """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '/in/') AS src FROM pages), q AS (SELECT page_id, src, regexp_extract(src, '([^/]*)$', 1) AS name FROM p),
r AS (SELECT page_id, src, CASE WHEN regexp_matches(name, '.[.][^.]*$') THEN regexp_replace(name, '[.][^.]*$', '') ELSE name END AS stem FROM q)
SELECT page_id, '/out/' || stem || '.md' AS flat, CASE WHEN starts_with(src, '/in/') THEN '/out/' || regexp_extract(substr(src, 5), '^(.*/)', 1) || stem || '.md' ELSE '/out/' || stem || '.md' END AS mirrored FROM r""",
        "dest_collisions": """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '/in/') AS src FROM pages), q AS (SELECT page_id, regexp_extract(src, '([^/]*)$', 1) AS name FROM p),
r AS (SELECT page_id, '/out/' || CASE WHEN regexp_matches(name, '.[.][^.]*$') THEN regexp_replace(name, '[.][^.]*$', '') ELSE name END || '.md' AS destination FROM q)
SELECT page_id, destination, cast(row_number() OVER (PARTITION BY destination ORDER BY page_id) - 1 AS INT) AS collision FROM r""",
        "enqueue": "WITH p AS (SELECT source AS batch, lang AS path, min(doc_id) AS a FROM documents GROUP BY ALL) SELECT batch, path AS source, cast(row_number() OVER (PARTITION BY batch ORDER BY a, path) - 1 AS INT) AS queue_pos FROM p",
        "route": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'OCR' ELSE 'text' END AS route, length(text) < 50 AS near_empty FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(text, 49) || chr(10) ELSE text END AS text FROM documents)",
        "vision_models": "SELECT p_partkey, (contains(m, 'gpt-4o') OR contains(m, 'llava') OR contains(m, 'o1') OR contains(m, 'o3') OR contains(m, 'vlm') OR contains(m, 'gemma3') OR contains(m, 'pixtral')) AS vision FROM (SELECT p_partkey, lower(CASE p_partkey % 5 WHEN 0 THEN 'LLaVA:7b-' WHEN 1 THEN 'gpt-4o-' WHEN 2 THEN 'mistral-' WHEN 3 THEN 'Gemma3:' ELSE 'text-' END || p_partkey) AS m FROM part)",
        "endpoint_normalise": "WITH u AS (SELECT page_id, rtrim(CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/' ELSE url END, '/') AS b FROM pages) SELECT page_id, CASE WHEN b = '' OR regexp_extract(b, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) <> '' THEN b ELSE b || '/v1' END AS endpoint FROM u",
        "diagnose": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'memory' WHEN 1 THEN 'connection' WHEN 2 THEN 'auth' WHEN 3 THEN 'not_found' WHEN 4 THEN 'timeout' ELSE 'default' END AS diagnosis FROM events",
        "fix_totals": rewritten("NOT s AND contains(line, chr(9))", "line").replace("SELECT doc_id, cast(sum", "SELECT cast(doc_id % 10 AS BIGINT) AS shard, cast(sum").replace(" AS n, string_agg(CASE WHEN NOT s AND contains(line, chr(9)) THEN line ELSE line END, chr(10) ORDER BY line_no) AS text FROM st GROUP BY doc_id", " AS n FROM st GROUP BY 1"),
    }
    ordered = f"^({WS}*)([0-9]+)([.)])({WS}+)(.*)$"
    part = lambda i: f"regexp_extract(line, '{ordered}', {i})"
    deep = "(r.ind || ' ')"
    going = f"NOT i.gs AND coalesce(starts_with(i.lo, {deep}), true) AND coalesce(starts_with(i.hi, {deep}), true)"
    same = f"({going} AND i.ind = r.ind AND i.del = r.del)"
    inner = f"({going} AND NOT (i.ind = r.ind AND i.del = r.del) AND starts_with(i.line, {deep}))"
    out["lint_md029"] = f"""WITH RECURSIVE {MD}, {lines('md_docs')}, {states()},
a0 AS (SELECT *, NOT s AND {has('line', ordered)} AS it FROM st), a1 AS (SELECT *, sum(it::INT) {OVER} AS gap FROM a0),
ag AS (SELECT doc_id, gap, min(line) FILTER (WHERE NOT it AND NOT b AND NOT s) AS lo, max(line) FILTER (WHERE NOT it AND NOT b AND NOT s) AS hi, bool_or(s AND NOT it) AS gs FROM a1 GROUP BY 1, 2),
it AS (SELECT doc_id, line_no, line, {part(1)} AS ind, {part(2)} AS num, {part(3)} AS del, row_number() {OVER} AS k, lag(lo) {OVER} AS lo, lag(hi) {OVER} AS hi, coalesce(lag(gs) {OVER}, false) AS gs FROM a1 JOIN ag USING (doc_id, gap) WHERE it),
pr AS (SELECT doc_id, line_no, lag(ind) {OVER} = ind AND lag(del) {OVER} = del AS p, num::BIGINT = 1 AND lag(num::BIGINT) {OVER} = 1 AS o FROM it),
sy AS (SELECT doc_id, arg_min(o, line_no) FILTER (WHERE p) AS one FROM pr GROUP BY 1),
r AS (SELECT doc_id, k, line_no, ind, del, 1::BIGINT AS blk, 1::BIGINT AS mine FROM it WHERE k = 1
 UNION ALL SELECT i.doc_id, i.k, i.line_no, CASE WHEN {same} OR {inner} THEN r.ind ELSE i.ind END, CASE WHEN {same} OR {inner} THEN r.del ELSE i.del END,
  CASE WHEN {same} OR {inner} THEN r.blk ELSE r.blk + 1 END, CASE WHEN {inner} THEN 0 WHEN {same} THEN r.blk ELSE r.blk + 1 END FROM r JOIN it i ON i.doc_id = r.doc_id AND i.k = r.k + 1),
wa AS (SELECT r.doc_id, r.line_no, CASE WHEN one THEN 1 ELSE row_number() OVER (PARTITION BY r.doc_id, mine ORDER BY r.line_no) END AS want, count(*) OVER (PARTITION BY r.doc_id, mine) AS c FROM r LEFT JOIN sy ON sy.doc_id = r.doc_id WHERE mine > 0),
du AS (SELECT wa.doc_id, wa.line_no, want FROM wa JOIN it ON it.doc_id = wa.doc_id AND it.line_no = wa.line_no WHERE c > 1 AND num::BIGINT <> want)
SELECT st.doc_id, count(want)::BIGINT AS n, string_agg(CASE WHEN want IS NOT NULL THEN {part(1)} || want || {part(3)} || {part(4)} || {part(5)} ELSE line END, chr(10) ORDER BY st.line_no) AS text FROM st LEFT JOIN du ON du.doc_id = st.doc_id AND du.line_no = st.line_no GROUP BY 1"""
    uri = "'data:image/png;base64,' || to_base64(encode(source || doc_id % 2))"
    token = "data:image/png;base64..."
    out |= {
        "truncated_to_base64": f"WITH {MD} SELECT doc_id, replace(text, '{token}', {uri}) AS text FROM md_docs",
        "inline_to_files": f"WITH {MD} SELECT doc_id, replace(text, '{token}', 'images/doc_' || doc_id || '_image1.png') AS text, contains(text, '{token}')::INT AS n_images FROM md_docs",
        "media_sections": f"SELECT doc_id, '## Embedded images' || {_NN} || '### Page ' || (doc_id % 2 + 1) || {_NN} || '![Page ' || (doc_id % 2 + 1) || ' image 7 (' || doc_id % 9 || 'x' || doc_id % 9 || ')](' || {uri} || ')' AS section, 'pdf' AS kind FROM documents UNION ALL SELECT doc_id, '## Embedded images' || {_NN} || '![image 1](' || {uri} || ')', 'zip' FROM documents",
        "marker_uris": f"WITH {MD} SELECT doc_id, regexp_replace(regexp_replace(text, '<!--image:x[0-3]:w[0-9]+:h[0-9]+-->', '![image](data:image/png;base64,' || to_base64(encode(source)) || ')', 'g'), '<!--image:x[0-9]+:w[0-9]+:h[0-9]+-->', '', 'g') AS text, len(regexp_extract_all(text, '<!--image:x[0-3]:w[0-9]+:h[0-9]+-->'))::BIGINT AS n_placed FROM md_docs",
        "page_images": "SELECT doc_id - doc_id % 3 AS doc_id, (doc_id % 3)::INT AS page_index, 21.0::DOUBLE AS y, '<!--image:x' || doc_id % 9 || ':w' || doc_id % 6 || ':h8-->' AS placeholder FROM documents WHERE doc_id % 2 = 0 AND doc_id % 9 > 0 AND doc_id % 6 >= 4",
        "page_unique_images": "SELECT doc_id - doc_id % 3 AS doc_id, (doc_id % 9)::INT AS xref, min(doc_id % 3)::INT AS page_index FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2",
        "model_ids": "SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE least(p_brand, p_type) || ',' || greatest(p_brand, p_type) END AS ids FROM part",
        "settings": "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events",
        "title_cased": f"SELECT doc_id, {_title('text')} AS title FROM documents",
    }
    return out | grids() | made_files() | choices() | chains(out)


_WORDS_OF = f"list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')"


def padded(cells: str, key: str = "doc_id") -> str:
    """CTE tb (key, md): the padded Markdown table of cells (key, r, k, v), the first row its header."""
    return f"""tx AS (SELECT {key}, k, greatest(3, max(length(v)))::INT AS n FROM {cells} GROUP BY ALL),
tg AS (SELECT r.*, x.k, x.n, coalesce(c.v, '') AS v FROM (SELECT DISTINCT {key}, r FROM {cells}) r JOIN tx x USING ({key}) LEFT JOIN {cells} c USING ({key}, r, k)),
tl AS (SELECT {key}, r, '| ' || string_agg(rpad(v, n, ' '), ' | ' ORDER BY k) || ' |' AS line, '|' || string_agg(repeat('-', n + 2), '|' ORDER BY k) || '|' AS rule FROM tg GROUP BY ALL),
tb AS (SELECT {key}, string_agg(line || CASE WHEN r = 0 THEN chr(10) || rule ELSE '' END, chr(10) ORDER BY r) AS md FROM tl GROUP BY ALL)"""


def grids() -> dict[str, str]:
    def words(width: int, least: int, v: str = "replace(w[i], '|', '\\|')") -> str:
        return f"w0 AS (SELECT doc_id, {_WORDS_OF} AS w FROM documents), c AS (SELECT doc_id, (i - 1) // {width} AS r, (i - 1) % {width} AS k, {v} AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w0) WHERE len(w) >= {least})"

    every = "SELECT d.doc_id, md AS markdown FROM documents d LEFT JOIN tb USING (doc_id)"
    short = "z AS (SELECT * FROM c UNION ALL SELECT doc_id, max(r), k0, '-' FROM c, (SELECT unnest([1, 3]) AS k0) GROUP BY doc_id, k0 HAVING count(*) % 4 BETWEEN 1 AND k0)"
    level = f"CASE WHEN i % 7 = 0 THEN 1 WHEN i % 5 = 0 THEN 2 END"
    head = f"i % 7 = 0 OR i % 5 = 0"
    return {
        "table_clean": f"WITH {words(4, 5, "replace(w[i], '|', '\\|') || ' \\|'")}, {padded('c')} {every}",
        "table_zebra": f"WITH {words(4, 5)}, {short}, {padded('z')} {every}",
        "table_exclusive": f"WITH {words(2, 3)}, {padded('c')} {every}",
        "table_gate": f"""WITH {lines('documents')}, t AS (SELECT doc_id, replace({strip('line')}, '|', '\\|') AS t FROM ln)
SELECT doc_id, count(*) >= 2 AND count(*) FILTER (WHERE length(t) > 120) <= 0.3 * (count(*) + count(*) FILTER (WHERE t <> '')) AS is_table FROM t GROUP BY doc_id""",
        "page_layout": f"""WITH {lines('documents')}, p AS (SELECT doc_id, line_no AS i, {strip('line')} AS t FROM ln),
q AS (SELECT doc_id, i, CASE WHEN ({head}) AND length(t) <= 120 AND length({sub('t', chr(92) + 'P{L}', '')}) >= 3 AND NOT contains(t, '|') THEN chr(10) || repeat('#', {level}) || ' ' || t || chr(10) ELSE t END AS x,
 doc_id % 2 = 0 AND doc_id % 9 > 0 AND doc_id % 6 >= 4 AS img, doc_id % 4 = 0 AS tab FROM p),
b AS (SELECT doc_id, CASE WHEN img AND i = 0 THEN 0 WHEN img AND tab AND i = 1 THEN 2 WHEN tab AND i < 2 THEN 0 WHEN tab AND i = 2 THEN NULL WHEN tab THEN 4 WHEN img THEN 2 ELSE 0 END AS pl, i, x FROM q WHERE x <> ''),
k AS (SELECT doc_id, pl, {strip("string_agg(x, chr(10) ORDER BY i)")} AS md FROM b WHERE pl IS NOT NULL GROUP BY 1, 2
 UNION ALL SELECT doc_id, 1, '<!--image:x' || doc_id % 9 || ':w' || doc_id % 6 || ':h8-->' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 9 > 0 AND doc_id % 6 >= 4
 UNION ALL SELECT doc_id, 3, '| a   | b   |' || chr(10) || '|-----|-----|' || chr(10) || '| 1   | 2   |' FROM documents WHERE doc_id % 4 = 0),
g AS (SELECT doc_id, string_agg(md, {_NN} ORDER BY pl) AS md FROM k WHERE md <> '' GROUP BY 1)
SELECT d.doc_id - d.doc_id % 3 AS doc_id, coalesce(string_agg(md, {_NN} ORDER BY d.doc_id) FILTER (WHERE md <> ''), '') AS markdown FROM documents d LEFT JOIN g USING (doc_id) GROUP BY 1""",
        "zip_file_names": """WITH RECURSIVE m AS (SELECT source || '-' || (doc_id // 400) AS key, doc_id, 'doc_x' || CASE WHEN doc_id % 5 = 0 THEN '_2' ELSE '' END AS base, row_number() OVER (PARTITION BY source, doc_id // 400 ORDER BY doc_id) AS k FROM documents),
r AS (SELECT key, k, doc_id, base || '.png' AS name, [base || '.png'] AS used FROM m WHERE k = 1
 UNION ALL SELECT key, k, doc_id, name, list_append(used, name) FROM (SELECT m.key, m.k, m.doc_id, r.used, list_filter(list_transform(range(1, m.k + 1), lambda i: m.base || CASE WHEN i > 1 THEN '_' || i ELSE '' END || '.png'), lambda x: NOT list_contains(r.used, x))[1] AS name FROM r JOIN m ON m.key = r.key AND m.k = r.k + 1))
SELECT key, doc_id, name FROM r""",
    }


def made_files() -> dict[str, str]:
    """Queries that make files of documents and read them back: what was put in."""
    flat = f"array_to_string({_WORDS_OF.replace('text', 'line')}, ' ')"
    cell = lambda c: f"replace({c}, '|', '\\|')"
    table = lambda c: f"string_agg('| ' || i || ' | ' || {cell(c)} || ' |' || CASE WHEN i = 0 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY i)"
    parts = lambda c, by: f"coalesce(string_agg({c}, {by} ORDER BY i) FILTER (WHERE {c} <> ''), '')"
    formats = [
        "any_value(text)", table(flat), table(flat.replace("line", "replace(line, chr(34), '')")), "'```json' || chr(10) || '{' || chr(10) || '  \"text\": ' || any_value(to_json(text)) || chr(10) || '}' || chr(10) || '```'",
        "'```xml' || chr(10) || '<d>' || any_value(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) || '</d>' || chr(10) || '```'",
        parts("line", _NN), f"'<!-- Slide number: 1 -->' || chr(10) || {parts('line', 'chr(10)')}", f"'## S' || {_NN} || {table('line')}", parts(flat, _NN), parts(flat, _NN),
        parts(strip("line"), _NN), f"'## S' || {_NN} || {table('line')}", f"any_value({strip('text')})", f"'## File: a.txt' || {_NN} || any_value(text)",
    ]
    rows = "ln AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"
    cases = " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(formats))
    scanned = "doc_id % 5 = 0"
    return {
        "html_made": f"""WITH {rows}, t AS (SELECT doc_id, i, {flat} AS t FROM ln)
SELECT t.doc_id, '## ' || arg_min(t, i) FILTER (WHERE t <> '') || {_NN} || string_agg('- [' || t || '](/x)', chr(10) ORDER BY i) FILTER (WHERE t <> '') || {_NN} || '**' || any_value(source) || '** and *x*' || chr(10) || 'next' || {_NN}
 || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | \\| |' || {_NN} || '```' || chr(10) || 'code  x' || chr(10) || '```' || {_NN} || '1. one' || chr(10) || '2. two' AS text FROM t JOIN documents d ON d.doc_id = t.doc_id GROUP BY t.doc_id""",
        "convert_formats": f"WITH {rows} SELECT doc_id, CASE doc_id % 14 {cases} END AS text, NULL::VARCHAR AS error FROM ln GROUP BY doc_id",
        "convert_routes": f"""SELECT doc_id, CASE WHEN {scanned} AND strlen(text) % 2 = 1 THEN '*[OCR failed: no model]*' WHEN {scanned} THEN strlen(text) || ' bytes read' WHEN doc_id % 3 = 0 AND strlen(text) <= 3000 THEN 'own: ' || text WHEN doc_id % 3 = 1 THEN text END AS text,
 CASE WHEN {scanned} AND strlen(text) % 2 = 1 THEN 'RuntimeError: no model' WHEN {scanned} THEN NULL WHEN doc_id % 3 = 0 AND strlen(text) > 3000 THEN 'ValueError: too long' WHEN doc_id % 3 = 2 THEN 'no converter accepts this file' END AS error,
 CASE WHEN {scanned} THEN 'OCR' ELSE 'text' END AS route FROM documents""",
        "pdf_text": f"""WITH {rows}, pg AS (SELECT doc_id, i // 40 AS p, {parts(flat, 'chr(10)')} AS md FROM ln GROUP BY 1, 2)
SELECT doc_id, coalesce(string_agg(md, {_NN} ORDER BY p) FILTER (WHERE md <> ''), '') AS text, NULL::VARCHAR AS error FROM pg GROUP BY 1""",
        "pdf_tables": f"""WITH w0 AS (SELECT doc_id, {_WORDS_OF} AS w FROM documents), w1 AS (SELECT doc_id, w[i] AS v, (i - 1) // 90 AS p, (i - 1) % 90 // 3 AS r, (i - 1) % 3 AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w0)),
n AS (SELECT doc_id, p, count(*) AS n FROM w1 GROUP BY 1, 2), c AS (SELECT doc_id * 100000 + p AS page, r, k, replace(v, '|', '\\|') AS v FROM w1 JOIN n USING (doc_id, p) WHERE n > 3), {padded('c', 'page')},
a AS (SELECT page // 100000 AS doc_id, page % 100000 AS p, md FROM tb UNION ALL SELECT doc_id, p, string_agg(v, ' ' ORDER BY k) FROM w1 JOIN n USING (doc_id, p) WHERE n <= 3 GROUP BY 1, 2)
SELECT d.doc_id, coalesce(string_agg(md, {_NN} ORDER BY p), '') AS text, NULL::VARCHAR AS error FROM documents d LEFT JOIN a USING (doc_id) GROUP BY 1""",
        "pdf_images": "SELECT doc_id, k AS page_index, k AS pos, 10 + k AS xref, 8 AS width, 8 AS height, doc_id || '_p' || (k + 1) || '_' || (10 + k) || '.png' AS name FROM documents, (SELECT unnest([0, 1])::INT AS k)",
        "zip_media": "SELECT doc_id, 1 AS nth, 'word/media/image2.JPG' AS entry_name, '.jpg' AS ext, md5('two') AS digest FROM documents UNION ALL SELECT doc_id, 2, 'word/media/image10.png', '.png', md5(text) FROM documents WHERE text <> ''",
        "write_markdown": """WITH a AS (SELECT doc_id, source, doc_id - doc_id % 2 AS even, text, row_number() OVER (PARTITION BY source, doc_id - doc_id % 2 ORDER BY doc_id) AS r FROM documents),
k AS (SELECT * FROM a WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 10 = 0 AND e.doc_id = a.even AND e.source = a.source))
SELECT even || '.md' AS name, text, strlen(text)::BIGINT AS n_bytes FROM k UNION ALL SELECT even || '.index.md', '# Index' || chr(10), 8 FROM k WHERE doc_id % 4 = 0""",
        "inline_whole": "SELECT doc_id, '![i](images/d_image1.jpg) a ![i](images/d_image2.png) b ![i](images/d_image1.jpg) c ![i](data:image/png;base64,aW1)' AS text, 2 AS n_images, 'd_image1.jpg ' || sha256(text) || ';d_image2.png ' || sha256('img') AS files FROM documents WHERE text <> ''",
        "base64_strict": "SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 2) THEN text END AS decoded FROM documents",
    }


def choices() -> dict[str, str]:
    return {
        "media_routes": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'zip' WHEN 3 THEN 'zip' END AS route, doc_id % 6 < 2 AS running, doc_id % 6 = 0 AS numbers, doc_id % 6 = 0 OR doc_id % 4 = 0 AS is_pdf FROM documents",
        "image_cascade": f"""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'placed' WHEN doc_id % 2 = 1 THEN 'inline' WHEN doc_id % 5 > 0 THEN {rstrip('text')} || {_NN} || 's' || doc_id || chr(10) ELSE text || ' ' || chr(10) END AS text,
 CASE WHEN doc_id % 3 = 1 AND text <> '' THEN text ELSE source END AS fallback, CASE WHEN doc_id % 2 = 0 THEN 'embed' WHEN doc_id % 3 = 0 THEN 'extract' ELSE 'none' END AS mode, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN 'an API key or an endpoint is needed' END AS missing FROM documents""",
        "files_scanned": "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) || '.parquet' AS name, 'scan' AS how UNION ALL SELECT unnest(['region', 'nation']) || '.parquet', 'list'",
        "settings_saved": "SELECT string_agg(r_name, ',' ORDER BY r_regionkey) AS regions, 'embed' AS images, true AS index, 'å' AS mark FROM region",
        "queue_edited": "SELECT '/in/' || source || '/' || doc_id % 50 || '.txt' AS source, min(doc_id) AS queue_pos FROM documents WHERE doc_id % 10 <> 7 GROUP BY 1",
        "totals": "SELECT count(*) FILTER (WHERE doc_id % 7 > 0 AND doc_id % 11 > 0) AS succeeded, count(*) FILTER (WHERE doc_id % 7 = 0 OR doc_id % 11 = 0) AS failed FROM documents",
    }


#: The lint rules in order.
CHAIN = ("formfeed", "md010", "md025", "md009", "md018", "md026", "md034", "bullet", "heading", "rejoin", "callout", "md029", "md022", "md031", "md032", "md012", "md047")


def chains(single: dict[str, str]) -> dict[str, str]:
    """R18 as the single rules' SQL one after the other: each reads the texts that the one before gives."""
    on = lambda name, table: single[name].replace(MD, f"md_docs AS (SELECT doc_id, text FROM {table})").replace("FROM documents", f"FROM {table}")
    step = lambda name, before: f"{name} AS MATERIALIZED ({on(name, before)})"
    rules = [f"lint_{r}" for r in CHAIN]
    lint = lambda first: ", ".join(step(r, b) for r, b in zip(rules, [first, *rules[:-1]], strict=True))
    told = ", ".join(f"CASE WHEN {r}.n > 0 THEN '\"{c}\":' || {r}.n END" for r, c in zip(rules, CHAIN, strict=True))
    joined = " ".join(f"JOIN {r} USING (doc_id)" for r in rules[:-1])
    before = ", ".join([f"raw AS MATERIALIZED (SELECT doc_id, text FROM md_docs)", step("strip_empty_headings", "raw"), step("strip_headers_footers", "strip_empty_headings"), step("strip_page_numbers", "strip_headers_footers")])
    counts = " UNION ALL ".join(f"SELECT '{c}' AS rule, sum(n)::BIGINT AS n FROM {r} HAVING sum(n) > 0" for r, c in zip(rules, CHAIN, strict=True))
    return {
        "lint_all": f"WITH {MD}, {before}, {lint('strip_page_numbers')} SELECT doc_id, lint_md047.text, '{{' || concat_ws(',', {told}) || '}}' AS fixes FROM lint_md047 {joined}",
        "lint_counts": f"WITH {MD}, raw AS MATERIALIZED (SELECT doc_id, text FROM md_docs), {lint('raw')} {counts}",
    }
