"""Pieces of SQL for the comparison queries, in the dialect of the engine they are run on."""

from cairn.functions.digest import ALPHABET, ORDERED
from cairn.functions.snapshot import PARTS

LINE = (
    r'^\{"digest":"([A-Z2-7]{32})","(?:expected_digest":"([^"]{32})",")?(?:timestamp":"([0-9]{14})",")?(?:url":"([^"\\]*)",")?'
    r'(?:format":(\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}),")?content":(.*)\}$'
)


def real(text: str) -> str:
    return f"(coalesce(CASE WHEN regexp_full_match({text}, '[1-9][0-9]{{13}}') THEN try_strptime({text}, '%Y%m%d%H%M%S') END IS NOT NULL, false))"


def b32(text: str) -> str:
    return f"array_to_string(list_transform(range(0, 32), lambda i: substr('{ALPHABET}', ((('0x' || substr(sha1({text}), (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '')"


def clean(text: str) -> str:
    return rf"regexp_replace(upper(regexp_replace(regexp_replace({text}, '^\s+', ''), '\s+$', '')), '^SHA1:', '')"


def is_digest(text: str) -> str:
    return f"coalesce(regexp_full_match({text}, '[A-Z2-7]{{32}}'), false)"


def order_key(text: str) -> str:
    return f"CASE WHEN {is_digest(text)} THEN translate({text}, '{ALPHABET}', '{ORDERED}') END"


CAP = f"cap AS (SELECT capture_id, urlkey, timestamp AS stamp, CASE WHEN {real('timestamp')} THEN timestamp END AS ts, original AS url, mimetype, statuscode, digest, length, seen_at FROM captures)"
SNAP = f"snap AS (SELECT snap_id, digest, expected_digest, CASE WHEN {real('timestamp')} THEN timestamp END AS ts, url, format, content FROM snapshots)"
LOG = "log AS (SELECT result_id, url, timestamp AS archive_ts, expected_digest, actual_digest, epoch(received_at)::BIGINT AS observed FROM download_results WHERE actual_digest IS NOT NULL)"
EARLIEST = "distinct_cap AS (SELECT DISTINCT digest, ts, url FROM cap WHERE digest IS NOT NULL AND ts IS NOT NULL), earliest AS (SELECT digest, min(row(ts, url)) AS f, count(*) - 1 AS others FROM distinct_cap GROUP BY 1), first_cap AS (SELECT digest, f[1] AS ts, f[2] AS url, others FROM earliest)"
_GROUPS = ", ".join(f"regexp_extract(line, '{LINE}', {i}, 's') AS {p}" for i, p in enumerate(PARTS, 1))
LINES = f"lines AS (SELECT line_id, file_name, line_no, regexp_replace(line, '\\r$', '') AS line FROM raw_lines WHERE kind = 'snapshot'), parsed AS (SELECT line_id, file_name, line_no, line, regexp_matches(line, '{LINE}', 's') AS good, {_GROUPS} FROM lines)"
FIRST = f"first AS (SELECT {clean('digest')} AS digest, arg_min(first_value, first_line_number) AS line FROM merge_first WHERE digest IS NOT NULL GROUP BY 1)"
SECOND = f"second AS (SELECT {clean('digest')} AS digest, arg_min(second_value, second_line_number) AS line FROM merge_second WHERE digest IS NOT NULL GROUP BY 1)"


def json_text(column: str, path: str) -> str:
    return f"CASE WHEN json_valid({column}) THEN json_extract_string({column}, '{path}') END"


def verify(name: str, content: str, form: str, default: str) -> str:
    space = f"coalesce({json_text(form, '$.closing_whitespace')}, {default})"
    return (
        f"CASE WHEN coalesce({json_text(form, '$.type')}, 'utf8') <> 'utf8' THEN 'unsupported_format' "
        f"WHEN NOT regexp_full_match({space}, '[\\r\\n \\t]*') THEN 'closing_whitespace' "
        f"WHEN {b32(f'({content} || {space})')} = {name} THEN 'ok' ELSE 'mismatch' END"
    )


def surt(url: str) -> str:
    """For plain hosts, as the tables have them: no dot segments, no escapes in the query."""
    low = f"lower({url})"
    host = rf"regexp_extract({low}, '^https?://([a-z0-9_.-]+)', 1)"
    port = rf"regexp_extract({low}, '^https?://[a-z0-9_.-]+(?::([0-9]*))?', 1)"
    rest = rf"regexp_replace(regexp_replace({low}, '^https?://[a-z0-9_.-]+(:[0-9]*)?', ''), '#.*', '')"
    path = f"regexp_replace(regexp_replace(split_part({rest}, '?', 1), '/+', '/', 'g'), '/$', '')"
    pairs = f"list_filter(string_split(CASE WHEN contains({rest}, '?') THEN regexp_replace({rest}, '^[^?]*[?]', '') ELSE '' END, '&'), lambda p: p <> '')"
    query = f"array_to_string(list_transform(list_sort(list_transform({pairs}, lambda p, i: row(split_part(p, '=', 1), i, CASE WHEN contains(p, '=') THEN regexp_replace(p, '^[^=]*=', '') ELSE '' END))), lambda s: s[1] || '=' || s[3]), '&')"
    labels = f"list_filter(string_split({host}, '.'), lambda x: x <> 'www' AND x <> '')"
    good = f"{host} <> '' AND len({labels}) > 0 AND {port} IN ('', CASE WHEN starts_with({low}, 'https') THEN '443' ELSE '80' END)"
    return f"CASE WHEN {good} THEN array_to_string(list_reverse({labels}), ',') || ')' || {path} || CASE WHEN len({pairs}) > 0 THEN '?' || {query} ELSE '' END END"


IS_KEY = "coalesce(regexp_matches(urlkey, '^[A-Za-z0-9_:-]{1,255}(,[A-Za-z0-9_:-]{1,255})*\\)'), false)"


def canonical_json(value: str, nulls: bool) -> str:
    """One text for all ways to write a JSON value; without nulls, null members count as absent (null items never do)."""
    number = "CASE WHEN regexp_full_match(atom::VARCHAR, '-?[0-9]+') THEN regexp_replace(atom::VARCHAR, '^-0$', '0') ELSE (atom::VARCHAR::DOUBLE)::VARCHAR END"
    shown = f"CASE WHEN type = 'VARCHAR' THEN '\"' || (atom->>'$') WHEN type IN ('OBJECT', 'ARRAY', 'NULL') THEN type WHEN type = 'BOOLEAN' THEN atom::VARCHAR ELSE 'n' || {number} END"
    kept = "" if nulls else " WHERE type <> 'NULL' OR regexp_matches(fullkey, '\\]$')"
    return f"(SELECT string_agg(fullkey || ' ' || {shown}, chr(10) ORDER BY fullkey) FROM json_tree({value}){kept})"
