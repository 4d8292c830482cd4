"""The queries in DuckDB's SQL. Its patterns know neither lookahead nor back references, so lists stand in for them."""

from __future__ import annotations

import re

from surfaceloom import lists
from surfaceloom.corpus import EDGES, events_sql
from surfaceloom.options import SurfaceOptions
from surfaceloom.queries import OPTIONS, TEMPLATES

Z = r"\z"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lc(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def rx(x: str, pattern: str, options: str = "c") -> str:
    return f"regexp_matches({x}, {q(pattern)}, {q(options)})"


def has(x: str, words: list[str]) -> str:
    """One of the words is in x, whatever its case."""
    return f"len(list_filter([{', '.join(map(q, words))}], lambda w: contains({lc(x)}, w))) > 0"


def among(x: str, words: list[str]) -> str:
    return f"{x} IN ({', '.join(map(q, words))})"


CORPUS = f"""
edges(ord, line) AS (VALUES {', '.join(f'({i}, {q(e)})' for i, e in enumerate(EDGES))}),
corpus AS (
  SELECT ord::BIGINT AS ord, line FROM edges WHERE line <> ''
  UNION ALL SELECT 1000000000000 + page_id, url FROM pages WHERE url <> ''
  UNION ALL SELECT 2000000000000 + event_id, {events_sql('VARCHAR')} FROM events
)"""

_AGAIN = f"""depth >= 0 AND contains(rest, '://') AND (({lc("substr(rest, 1, 5)")} = 'https' AND substr(rest, 6, 1) IN (':', '/')) OR ({lc("substr(rest, 1, 4)")} = 'http' AND substr(rest, 5, 1) IN (':', '/')))"""
_SCHEME = f"substr(rest, 1, CASE WHEN {lc('substr(rest, 1, 5)')} = 'https' AND substr(rest, 6, 1) IN (':', '/') THEN 5 ELSE 4 END)"

PARSED = rf"""
cut AS (
  SELECT ord, line, contains(line, '://') AS found, CASE WHEN contains(line, '://') THEN substr(line, 1, instr(line, '://') - 1) ELSE '' END AS scheme,
    CASE WHEN contains(line, '://') THEN substr(line, instr(line, '://') + 3) ELSE line END AS rest FROM corpus
), repaired AS (
  SELECT ord, line, scheme, rest, CASE WHEN found THEN 0 ELSE -1 END AS depth FROM cut
  UNION ALL SELECT ord, line, {_SCHEME}, substr(rest, instr(rest, '://') + 3), depth + 1 FROM repaired WHERE {_AGAIN}
), repair AS (
  SELECT ord, line, arg_max(scheme, depth) AS scheme, arg_max(rest, depth) AS rest FROM repaired GROUP BY ord, line
), sited AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS auth FROM repair
), ported AS (
  SELECT *, regexp_replace(auth, ':[0-9]*\z', '') AS host, CASE WHEN regexp_matches(auth, ':[0-9]*\z') THEN regexp_extract(auth, ':([0-9]*)\z', 1) END AS port,
    substr(rest, length(auth) + 1) AS tail FROM sited
), cutoff AS (
  SELECT *, split_part(tail, '#', 1) AS whole FROM ported
), parsed AS (
  SELECT *, coalesce(({lc('scheme')} = 'http' AND port = '80') OR ({lc('scheme')} = 'https' AND port = '443'), FALSE) AS default_port,
    split_part(whole, '?', 1) AS path, CASE WHEN contains(whole, '?') THEN substr(whole, instr(whole, '?') + 1) END AS query,
    regexp_extract(split_part(whole, '?', 1), '([^/]+)/*\z', 1) AS last, regexp_extract(split_part(whole, '?', 1), '^/*([^/]+)', 1) AS first,
    list_filter(string_split(split_part(whole, '?', 1), '/'), lambda s: s <> '') AS segs FROM cutoff
)"""


def over(sql: str, *more: str) -> str:
    return f"WITH RECURSIVE {', '.join([CORPUS, PARSED, *more])} {sql}"


# ---- segments
INDEX = rx("segs[-1]", r"^(index\.(html|htm|php)|default\.(html|htm))\z", "i")
KEPT = f"CASE WHEN len(segs) > 0 AND {INDEX} THEN segs[:-2] ELSE segs END"


def section(x: str) -> str:
    return f"coalesce({among(lc(x), lists.SECTIONS)}, FALSE)"


def number(x: str) -> str:
    return rx(x, "^[0-9]+" + Z)


def uuid(x: str) -> str:
    return rx(x, r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\z")


def hexa(x: str) -> str:
    return rx(x, r"^[0-9A-Fa-f]{12,}\z")


def text_slug(x: str) -> str:
    return f"(strlen({x}) >= 12 AND NOT {rx(x, '[.A-Z]')} AND len(string_split({x}, '-')) >= 3)"


def number_slug(x: str) -> str:
    return f"({text_slug(x)} AND {rx(x, '-[0-9]+' + Z)})"


def id_stem(x: str) -> str:
    stem = f"regexp_extract({x}, '^([^.]+)[-_][0-9]+\\z', 1)"
    return f"CASE WHEN {rx(stem, '[A-Za-z]')} THEN {stem} ELSE '' END"


def mixed_stem(x: str) -> str:
    stem, mark = (f"regexp_extract({x}, '^([^.]+)[-_]([A-Za-z0-9]+)\\z', {i})" for i in (1, 2))
    return f"CASE WHEN strlen({x}) >= 7 AND {rx(stem, '[A-Za-z]')} AND {rx(mark, '[A-Za-z]')} AND {rx(mark, '[0-9]{5}')} THEN {stem} ELSE '' END"


_HASH = r"^([A-Z]+[G-Z])([0-9A-Fa-f]{8,})([-_].*)?\z"


def hashed(x: str) -> str:
    return f"({rx(x, _HASH, 's')} AND {rx(part_of_hash(x, 2), '[A-Fa-f]')})"


def part_of_hash(x: str, i: int) -> str:
    return f"regexp_extract({x}, {q(_HASH)}, {i}, 's')"


def template(o: SurfaceOptions) -> str:
    """One kept segment at i of kept, as a token."""
    x, before = "kept[i]", "(CASE WHEN i > 1 THEN kept[i - 1] END)"
    fold = (lambda y: y) if o.case_sensitive else lc
    if o.raw_segments:
        return fold(x)
    when = [(number(x) if o.fold_ids else f"{number(x)} AND {section(before)}", "'N'")]
    if o.fold_ids:
        when += [(uuid(x), "'U'"), (hexa(x), "'H'")]
    when.append((f"i = len(segs) AND ({number_slug(x)} OR ({section(before)} AND {text_slug(x)}))", "'S'"))
    if o.fold_ids:
        when += [(f"{id_stem(x)} <> ''", f"{fold(id_stem(x))} || '-#'"), (f"{mixed_stem(x)} <> ''", f"{fold(mixed_stem(x))} || '-#'")]
    when.append((hashed(x), f"{fold(part_of_hash(x, 1))} || '#' || {fold(part_of_hash(x, 3))}"))
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in when) + f" ELSE {fold(x)} END"


def templates(o: SurfaceOptions) -> str:
    return f"array_to_string(list_transform(range(1, len(kept) + 1), lambda i: {template(o)}), '/')"


# ---- queries
NAME, HAS = "split_part(t, '=', 1)", "contains(t, '=')"
VALUE = "CASE WHEN contains(t, '=') THEN substr(t, instr(t, '=') + 1) ELSE '' END"


def junk(x: str) -> str:
    return rx(x, r"^([0-9]+|[A-Za-z0-9]{5,64})\z")


def holds_url(x: str) -> str:
    return f"(starts_with({x}, '//') OR contains({x}, '://') OR contains({lc(x)}, '%2f%2f'))"


GRAPH = r"(\{|%7[bB])"
IS_GRAPH = f"coalesce({rx('query', '(^|&)query=' + GRAPH)}, FALSE)"


def payload(x: str) -> str:
    blank = f"(contains({x}, '+') OR contains({x}, '%20'))"
    return (
        f"CASE WHEN {x} = '' OR {holds_url(x)} THEN FALSE WHEN strlen({x}) > {lists.VALUE_BYTES} THEN TRUE"
        f" WHEN {rx(x, '''[\\x00-\\x1f\\x7f<>\"'`\\\\]|%[01].|%2[27]|%3[cCeE]''', 's')} THEN TRUE"
        f" WHEN {blank} AND {has(x, lists.BLANK_WORDS)} THEN TRUE ELSE {has(x, lists.PAYLOADS)} END"
    )


def wanted(o: SurfaceOptions) -> str:
    return "TRUE" if o.keep_invalid else f"NOT (NOT {HAS} AND {junk('t')})"


def keys(o: SurfaceOptions) -> str:
    tokens = "string_split(query, '&')"
    stop = f"coalesce(nullif(list_position(list_transform({tokens}, lambda t: {HAS} AND {holds_url(VALUE)}), TRUE), 0), len({tokens}))"
    return f"list_sort(list_transform(list_filter({tokens}[:{stop}], lambda t: {NAME} <> '' AND {wanted(o)}), lambda t: {NAME}))"


def clean(o: SurfaceOptions) -> str:
    graph = f"({NAME} = 'query' AND {rx(VALUE, '^' + GRAPH)})"
    one = f"CASE WHEN {HAS} THEN {NAME} || '=' || CASE WHEN {graph} OR NOT {payload(VALUE)} THEN {VALUE} ELSE '' END ELSE t END"
    return f"array_to_string(list_transform(list_filter(string_split(query, '&'), lambda t: t <> '' AND {wanted(o)}), lambda t: {one}), '&')"


# ---- the gate
_TLD = "|".join(lists.TLDS)
BAD_PATH = rx("path", r"""[\x00-\x20\x7f{}"<>\\^`|\[\]'*()$,&!]|[^\x00-\x7f]|^[^;]*=""")
BAD_QUERY = "coalesce(" + rx("query", r"""[\x00-\x20\x7f"<>\\^`|]""") + f" OR (({rx('query', '[{}]')}) AND NOT {IS_GRAPH}), FALSE)"
COMMA = "coalesce(starts_with(query, ','), FALSE)"


def marked(x: str) -> str:
    return f"coalesce({has(x, lists.MARKS)}, FALSE)"


PATH_MARKED = has("path", lists.PATH_MARKS)


def clock(x: str) -> str:
    return f"coalesce({rx(x, r'\[[0-9]{1,2}:[0-9]{2}:[0-9]{2}')}, FALSE)"


_BAD_TOKEN = (
    f"CASE WHEN t = '' THEN FALSE WHEN {HAS} THEN {rx(NAME, '[%+]')} OR ({NAME} <> '' AND NOT {rx(NAME, '[A-Za-z0-9_]')})"
    f" ELSE strlen(t) <= 8 AND ((contains(t, '%') AND {rx(f't', '^[%0-9A-Fa-f]+' + Z)}) OR NOT {rx('t', '[A-Za-z0-9]')}) END"
)
BAD_NAME = f"coalesce(len(list_filter(string_split(query, '&'), lambda t: {_BAD_TOKEN})) > 0, FALSE)"


def embedded(x: str) -> str:
    return rx(x, rf"^[a-z0-9-][a-z0-9.-]*\.({_TLD})\z", "i")


def glued(x: str) -> str:
    bad = f"NOT {rx('l', f'^({_TLD}){Z}', 'i')} AND {rx('l', f'^({_TLD})[A-Za-z0-9]', 'i')}"
    return f"len(list_filter(regexp_extract_all({x}, '\\.([A-Za-z0-9-]+)', 1), lambda l: {bad})) > 0"


SCHEMA = rx("last", r"\.(dtd|xsd)\z", "i")


def _script(mark: str, good: str) -> str:
    rest = f"substr(last, p + {len(mark)})"
    bad = f"{rest} <> '' AND CASE WHEN starts_with({rest}, '.') THEN {rx(rest, '^[.][0-9.]+' + Z)} ELSE {lc(rest)} NOT IN ({good}) END"
    return f"len(list_filter(range(1, length(last) + 1), lambda p: {lc(f'substr(last, p, {len(mark)})')} = {q(mark)} AND {bad})) > 0"


SCRIPT = "(" + " OR ".join(_script(m, g) for m, g in ((".php", "'s', '5'"), (".asp", "'x', 'net'"), (".jsp", "'x'"), (".htm", "'l'"), (".cgi", "''"), (".pl", "''"))) + ")"
_PARTS, _RUN = "string_split(last, '.')[2:]", "regexp_extract(p, '^[A-Za-z0-9]+')"
_EXACT = among(lc(_RUN), lists.STATIC)
_BEGUN = f"len(list_filter([{', '.join(map(q, lists.STATIC))}], lambda e: starts_with({lc(_RUN)}, e))) > 0"
KIND = (
    f"CASE WHEN contains(last, '.') AND {among(lc('string_split(last, $$.$$)[-1]').replace('$$', chr(39)), lists.STATIC)} THEN 1"
    f" WHEN len(list_filter({_PARTS}, lambda p: CASE WHEN {_RUN} = '' THEN FALSE WHEN {_EXACT} THEN {_RUN} <> p ELSE {_BEGUN} END)) > 0 THEN 2 ELSE 0 END"
)
_ENDING = "string_split(last, '.')[-1]"
_PREFIX = f"len(list_filter([{', '.join(map(q, lists.KNOWN))}], lambda k: starts_with(k, {lc(_ENDING)}) AND length(k) > length({_ENDING}))) > 0"
CUT = f"(contains(last, '.') AND ({_ENDING} = '' OR (strlen({_ENDING}) <= 3 AND NOT {among(lc(_ENDING), lists.KNOWN)} AND {_PREFIX})))"
TAG = rx("last", r"^[^.]*[a-z]Show\z|[Aa]0[0-9]\z|^[0-9]{1,3}[A-Z]\z")
HEADER = "(" + rx("last", ":" + Z) + " OR " + has("last", [f".{e}:" for e in lists.HEADER_ENDINGS]) + ")"
HASH_JUNK = f"({hashed('last')} AND {rx(part_of_hash('last', 3), '[0-9][A-Za-z]')})"
TWICE = "len(list_filter(range(1, len(segs)), lambda i: segs[i] = segs[i + 1] AND strlen(segs[i]) >= 2)) > 0"
CHUNK = (
    "(strlen(path) >= 40 AND len(list_filter(range(2, 25), lambda l: len(list_filter(range(1, length(path) - l * greatest(4, (23 + l) // l) + 2),"
    " lambda i: substr(path, i, l * greatest(4, (23 + l) // l)) = repeat(substr(path, i, l), greatest(4, (23 + l) // l)))) > 0)) > 0)"
)
EMPTY_PORT = "coalesce(port = '', FALSE)"
_LABELS = f"string_split({lc('host')}, '.')"
EMBEDS = (
    f"coalesce(len({_LABELS}) >= 4 AND {among(f'{_LABELS}[-3]', lists.SUFFIXES)} AND {rx(f'{_LABELS}[-4]', '[a-z]')} AND NOT {rx(f'{_LABELS}[-4]', '[0-9]')}"
    f" AND len(list_filter({_LABELS}[:-5], lambda w: w <> 'www')) = 0, FALSE)"
)
SHALLOW = f"(tail = '' OR {rx('tail', '^/+' + Z)} OR (starts_with(tail, '/') AND {among(lc('rtrim(substr(tail, 2), $$/$$)').replace('$$', chr(39)), lists.ROOT_FILES)}))"
REASONS = [
    ("bad_path_bytes", BAD_PATH), ("leading_comma", COMMA), ("bad_query_bytes", BAD_QUERY), ("marked_path", marked("path")), ("path_marked", PATH_MARKED),
    ("marked_query", marked("query")), ("clock", f"({clock('path')} OR {clock('query')})"), ("bad_name", BAD_NAME), ("embedded_domain", f"({embedded('first')} OR {embedded('last')})"),
    ("glued_domain", glued("first")), ("schema_file", SCHEMA), ("mangled_script", SCRIPT), ("mangled_static", f"({KIND}) = 2"), ("cut_ending", CUT), ("scanner_tag", TAG),
    ("header_line", HEADER), ("hash_junk", HASH_JUNK), ("repeated_segment", TWICE), ("repeated_chunk", CHUNK),
]
GARBAGE = "(" + " OR ".join(f"({x})" for _, x in REASONS) + ")"
NOISE = rx("path", rf"\.({'|'.join(lists.NOISE)})\z", "i")
BAD_HOST = f"({EMPTY_PORT} OR {glued('auth')} OR ({EMBEDS} AND {SHALLOW}))"

CLEAN_HOST = f"CASE WHEN {rx('host', '[.][A-Za-z]{2,}' + Z)} THEN regexp_replace({lc('host')}, '^({'|'.join(lists.REMNANTS)})+', '') ELSE {lc('host')} END"


def counts(o: SurfaceOptions) -> str:
    there = "coalesce(query <> '', FALSE)"
    return there if o.keep_invalid else f"({there} AND ({KIND}) <> 1)"


def keyed(o: SurfaceOptions) -> str:
    """CTEs down to keyed: ord, sig, base, grp, keys, out."""
    gate = [] if o.keep_invalid else [f"NOT {BAD_HOST}", f"NOT {GARBAGE}"]
    gate += [] if o.keep_assets else [f"NOT {NOISE}"]
    host = lc("host") if o.raw_hosts else CLEAN_HOST
    whole = "TRUE" if o.whole_query else IS_GRAPH
    return f"""
passed AS (SELECT *, {KEPT} AS kept, {counts(o)} AS asked FROM parsed WHERE {' AND '.join(gate) or 'TRUE'}),
fronted AS (
  SELECT *, {lc('scheme')} || '://' || ({host}) || CASE WHEN port IS NOT NULL AND NOT default_port THEN ':' || port ELSE '' END || '/' AS site,
    {templates(o)} AS tokens, asked AND {whole} AS entire, CASE WHEN asked AND NOT {whole} THEN {keys(o)} ELSE [] END AS names,
    CASE WHEN asked THEN {clean(o)} ELSE '' END AS left_over FROM passed
),
keyed AS (
  SELECT ord, site || tokens || CASE WHEN entire THEN '?' || query WHEN len(names) > 0 THEN '?' || array_to_string(names, '&') ELSE '' END AS sig,
    CASE WHEN len(names) > 0 AND {o.merging} THEN site || tokens || '?' END AS grp, names AS keys,
    {'line' if o.raw_output else "site || array_to_string(kept, '/') || CASE WHEN left_over <> '' THEN '?' || left_over ELSE '' END"} AS out, host FROM fronted
),
based AS (SELECT *, regexp_extract(sig, '^[^;?]*', 0, 's') AS base FROM keyed)"""


FIRST = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY ord) AS n FROM based) WHERE n = 1)"
TAGGED = """tagged AS (
  SELECT *, list_transform(keys, lambda k, i: k || chr(1) || (i - list_position(keys, k) + 1)) AS tags FROM firsts
), covered AS (
  SELECT DISTINCT a.sig FROM tagged AS a JOIN tagged AS b ON a.grp = b.grp AND len(b.keys) > len(a.keys) AND list_has_all(b.tags, a.tags)
)"""
DECORATED = "decorated AS (SELECT *, max(sig <> base) OVER (PARTITION BY base) AS decorated FROM firsts)"
FOLDED = "folded AS (SELECT * FROM decorated WHERE sig <> base OR NOT decorated)"


def stages(o: SurfaceOptions = SurfaceOptions()) -> tuple[str, ...]:
    return (keyed(o), FIRST, DECORATED, FOLDED, TAGGED)


def kept(o: SurfaceOptions) -> str:
    return "SELECT ord, out FROM folded WHERE sig NOT IN (SELECT sig FROM covered)" if o.merging else "SELECT ord, out FROM firsts"


def dedup(o: SurfaceOptions) -> str:
    return over(kept(o), *stages(o))


def only(sql: str, table: str) -> str:
    """The default deduplication of another corpus."""
    return f"WITH RECURSIVE {table}, {PARSED}, {', '.join(stages())} {sql}"


def _earlier(sql: str) -> str:
    """The same tables over the lines of an earlier run, under other names."""
    tables = "edges corpus cut repaired repair sited ported cutoff parsed passed fronted keyed based firsts decorated folded tagged covered"
    renamed = re.sub(rf"\b({'|'.join(tables.split())})\b", r"earlier_\1", sql)
    return renamed.replace("FROM events", "FROM events WHERE FALSE")


FIELDS = {
    "p1_scheme_split": "SELECT ord, scheme, rest FROM cut",
    "p2_scheme_repair": "SELECT ord, scheme, rest FROM parsed",
    "p3_authority": "SELECT ord, auth AS authority, tail FROM parsed",
    "p4_host_port": "SELECT ord, host, port FROM parsed",
    "p5_default_port": "SELECT ord, default_port AS is_default FROM parsed",
    "p6_fragment_cut": "SELECT ord, whole AS unfragmented FROM parsed",
    "p7_path_query": "SELECT ord, path, query FROM parsed",
    "p8_host_lower": f"SELECT ord, {lc('host')} AS host FROM parsed",
    "p9_scheme_lower": f"SELECT ord, {lc('scheme')} AS scheme FROM parsed",
    "p10_clean_host": f"SELECT ord, {CLEAN_HOST} AS host FROM parsed",
    "p11_valid_host": f"SELECT ord, {rx('host', '[.][A-Za-z]{2,}' + Z)} AS valid FROM parsed",
    "g1_segments": "SELECT ord, len(segs)::BIGINT AS n, array_to_string(segs, ' ') AS joined FROM parsed",
    "g2_index_document": f"SELECT ord, (len(segs) - len({KEPT}))::BIGINT AS dropped FROM parsed",
    "q1_query_keys": f"SELECT ord, array_to_string({keys(SurfaceOptions())}, '&') AS keys, array_to_string({keys(SurfaceOptions(keep_invalid=True))}, '&') AS loose FROM parsed",
    "q2_key_count": f"SELECT ord, coalesce(len({keys(SurfaceOptions())}), 0)::BIGINT AS n FROM parsed",
    "q5_graph_query": f"SELECT ord, {IS_GRAPH} AS graph FROM parsed",
    "q7_clean_query": f"SELECT ord, {clean(SurfaceOptions())} AS cleaned, {clean(SurfaceOptions(keep_invalid=True))} AS loose FROM parsed",
    "q8_static_query": f"SELECT ord, {counts(SurfaceOptions())} AS counts FROM parsed",
    "f1_bad_path_bytes": f"SELECT ord, {BAD_PATH} AS bad FROM parsed",
    "f2_bad_query_bytes": f"SELECT ord, {BAD_QUERY} AS bad FROM parsed",
    "f3_leading_comma": f"SELECT ord, {COMMA} AS bad FROM parsed",
    "f4_marks": f"SELECT ord, {marked('path')} AS in_path, {marked('query')} AS in_query FROM parsed",
    "f5_path_marks": f"SELECT ord, {PATH_MARKED} AS bad FROM parsed",
    "f6_any_mark": f"SELECT ord, {marked('path')} OR {PATH_MARKED} OR {marked('query')} AS bad FROM parsed",
    "f7_clock": f"SELECT ord, {clock('path')} OR {clock('query')} AS bad FROM parsed",
    "f8_bad_name": f"SELECT ord, {BAD_NAME} AS bad FROM parsed",
    "f9_embedded_domain": f"SELECT ord, {embedded('first')} AS first, {embedded('last')} AS last FROM parsed",
    "f10_glued_domain": f"SELECT ord, {glued('first')} AS in_segment, {glued('auth')} AS in_host FROM parsed",
    "f11_schema_file": f"SELECT ord, {SCHEMA} AS bad FROM parsed",
    "f12_mangled_script": f"SELECT ord, {SCRIPT} AS bad FROM parsed",
    "f13_static_kind": f"SELECT ord, ({KIND})::INTEGER AS kind FROM parsed",
    "f14_cut_ending": f"SELECT ord, {CUT} AS bad FROM parsed",
    "f15_scanner_tag": f"SELECT ord, {TAG} AS bad FROM parsed",
    "f16_header_line": f"SELECT ord, {HEADER} AS bad FROM parsed",
    "f17_hash_junk": f"SELECT ord, {HASH_JUNK} AS bad FROM parsed",
    "f18_repeated_segment": f"SELECT ord, {TWICE} AS bad FROM parsed",
    "f19_repeated_chunk": f"SELECT ord, {CHUNK} AS bad FROM parsed",
    "f20_empty_port": f"SELECT ord, {EMPTY_PORT} AS bad FROM parsed",
    "f21_embedding_host": f"SELECT ord, {EMBEDS} AS embeds, {SHALLOW} AS shallow FROM parsed",
    "f22_garbage": f"SELECT ord, {GARBAGE} AS garbage, array_to_string(list_filter([{', '.join(f'CASE WHEN {x} THEN {q(n)} END' for n, x in REASONS)}], lambda r: r IS NOT NULL), ',') AS reasons FROM parsed",
    "n1_noise": f"SELECT ord, {NOISE} AS noise FROM parsed",
}
SEGMENTS = {
    "g3_section": f"{section('segment')} AS section",
    "g4_number": f"{number('segment')} AS number",
    "g5_uuid": f"{uuid('segment')} AS uuid",
    "g6_hex": f"{hexa('segment')} AS hex",
    "g7_numbered_slug": f"{number_slug('segment')} AS slug",
    "g8_text_slug": f"{text_slug('segment')} AS slug",
    "g9_id_stem": f"{id_stem('segment')} AS stem",
    "g10_mixed_id_stem": f"{mixed_stem('segment')} AS stem",
    "g11_hashed": f"{hashed('segment')} AS hashed, CASE WHEN {hashed('segment')} THEN {part_of_hash('segment', 1)} ELSE '' END AS label",
}
TOKENS = {"q3_junk_token": f"{junk('t')} AS junk", "q4_value_url": f"{holds_url(VALUE)} AS url", "q6_payload": f"{payload(VALUE)} AS payload"}


def oracles() -> dict[str, str]:
    out = {name: over(sql) for name, sql in FIELDS.items()}
    out |= {name: over(f"SELECT segment, {sql} FROM (SELECT DISTINCT unnest(segs) AS segment FROM parsed)") for name, sql in SEGMENTS.items()}
    out |= {name: over(f"SELECT t AS token, {sql} FROM (SELECT DISTINCT unnest(string_split(query, '&')) AS t FROM parsed WHERE query IS NOT NULL)") for name, sql in TOKENS.items()}
    out |= {name: over(f"SELECT ord, {templates(o)} AS template, array_to_string(kept, '/') AS kept FROM (SELECT *, {KEPT} AS kept FROM parsed)") for name, o in TEMPLATES.items()}
    out |= {name.replace("default", "dedup"): dedup(o) for name, o in OPTIONS.items()}
    plain = stages()
    chain = ", ".join([CORPUS, PARSED, *plain])
    pages = "corpus AS (SELECT page_id AS ord, url AS line FROM pages WHERE url <> '')"
    both = CORPUS.replace("corpus AS", "all_urls AS") + ", corpus AS (SELECT page_id AS ord, url AS line FROM pages WHERE url <> '' UNION ALL SELECT 10000000000000 + ord, line FROM all_urls)"
    html = "(SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages)"
    out |= {
        "s1_lines": "SELECT page_id, unnest(range(0, len(l)))::INTEGER AS n, unnest(l) AS line FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages)",
        "s2_carriage_returns": "SELECT page_id, url AS line FROM pages",
        "s3_records": f"SELECT page_id, count(*) AS n FROM {html} WHERE rtrim(line, chr(13)) <> '' GROUP BY page_id",
        "s4_files": f"SELECT source, line, count(*) AS n FROM (SELECT 0::BIGINT AS source, url AS line FROM pages UNION ALL SELECT 1, rtrim(line, chr(13)) FROM {html}) WHERE line <> '' GROUP BY source, line",
        "s5_union": only(f"SELECT (ord // 10000000000000)::BIGINT AS source, (ord % 10000000000000)::BIGINT AS ord, out FROM ({kept(SurfaceOptions())})", both),
        "s7_stream_first_seen": f"WITH RECURSIVE {pages}, {PARSED}, {keyed(SurfaceOptions(keep_invalid=True))}, {FIRST} SELECT ord, out FROM firsts",
        "s8_ordered_sink": over(f"SELECT row_number() OVER (ORDER BY ord) AS place, out FROM ({kept(SurfaceOptions())})", *plain),
        "s9_stats": over(f"SELECT (SELECT count(*) FROM corpus) AS n_in, count(*) AS n_out FROM ({kept(SurfaceOptions())})", *plain),
        "s10_table_source": only(kept(SurfaceOptions()), pages),
        "q9_signatures": over("SELECT ord, sig, base, grp FROM based", *plain),
        "a1_first_arrivals": over("SELECT ord, sig FROM firsts", *plain),
        "a2_counts": over(f"SELECT {lc('host')} AS host, count(*) AS n, count(DISTINCT sig) AS signatures FROM based GROUP BY 1", *plain),
        "a3_decorated": over("SELECT ord, base, decorated FROM decorated", *plain),
        "j1_fold_bare": over("SELECT ord, sig FROM folded", *plain),
        "j2_merge_covered": over("SELECT ord, sig FROM firsts WHERE sig NOT IN (SELECT sig FROM covered)", *plain),
        "j3_covering_pairs": over("SELECT a.sig AS sub, b.sig AS sup FROM tagged AS a JOIN tagged AS b ON a.grp = b.grp AND len(b.keys) > len(a.keys) AND list_has_all(b.tags, a.tags)", *plain),
        "j4_set_sizes": over("SELECT grp, len(keys)::BIGINT AS size, count(*) AS n FROM firsts WHERE grp IS NOT NULL GROUP BY 1, 2", *plain),
        "j5_no_merge": over("SELECT ord, out FROM folded", *plain),
        "o1_ordered": over(f"{kept(SurfaceOptions())} ORDER BY ord", *plain),
        "u2_fresh": f"WITH RECURSIVE {chain}, {_earlier(chain)} {kept(SurfaceOptions())} AND out NOT IN (SELECT out FROM ({_earlier(kept(SurfaceOptions()))}))",
        "w1_arrival_rank": over("SELECT ord, row_number() OVER (PARTITION BY sig ORDER BY ord) AS place FROM based", *plain),
        "e2_raw_output": over("SELECT ord, sig, out FROM based", *stages(SurfaceOptions(raw_output=True))),
        "e1_output": over("SELECT ord, out FROM based", *plain),
    }
    return out
