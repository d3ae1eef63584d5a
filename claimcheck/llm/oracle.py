"""DuckDB SQL of the queries, or parts of queries, that SQL can express."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"


def crc32_table() -> list[int]:
    """The table of the reflected CRC-32 polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


# --- sharding -----------------------------------------------------------------------------------------

_TEXTS = "SELECT *, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents"
_BYTES = "list_transform(range(0, octet_length(encode(t))), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))"
_STEP = f"lambda a, x: xor(a >> 8, {crc32_table()}[(xor(a, x) & 255) + 1])"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}), {_STEP}), 4294967295)"


def sharding(shards: int, seed: int = 17) -> str:
    sized = f"SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum, CAST(octet_length(encode(t)) + 8 AS BIGINT) AS size, {_CRC} AS text_crc32 FROM ({_TEXTS})"
    mixed = f"SELECT *, CAST(('0x' || substr(md5('{seed}:' || concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), text_crc32)), 1, 15)) AS BIGINT) AS mixed FROM ({sized})"
    order = "mixed, doc_id, text_crc32, size"
    fraction = f"SELECT *, CAST(2 * row_number() OVER (PARTITION BY stratum ORDER BY {order}) - 1 AS DOUBLE) / CAST(2 * count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS fraction FROM ({mixed})"
    placed = f"SELECT *, row_number() OVER (ORDER BY fraction, stratum, {order}) - 1 AS position, count(*) OVER () AS total FROM ({fraction})"
    dealt = f"SELECT *, CAST((position * {shards}) // total AS INTEGER) AS shard FROM ({placed})"
    return f"SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(position - (shard * total + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM ({dealt})"


# --- base spans of secrets ----------------------------------------------------------------------------

_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"({_NAMES})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _matches(kind: int, name: str, pattern: str, least: str) -> str:
    parts = f"SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS between, {least} AS sized FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
    size = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    placed = f"SELECT doc_id, CAST({size.format('between[1:i]')} + {size.format('found[1:i - 1]')} AS BIGINT) AS a, length(found[i]) AS n, sized[i] AS sized FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM ({parts}))"
    return f"SELECT doc_id, {kind} AS kind, a, '{name}:' || a || ':' || (a + n) AS span FROM ({placed}) WHERE sized"


def _long(pattern: str) -> str:
    return f"list_transform(regexp_extract_all(t, '{pattern}'), lambda x: true)"


_SPANS = " UNION ALL ".join([
    _matches(0, "assign", _ASSIGN, f"list_transform(regexp_extract_all(t, '{_ASSIGN}', 2), lambda x: length(x) >= 12)"),
    _matches(1, "access", "AKIA[A-Z0-9]{14,}", _long("AKIA[A-Z0-9]{14,}")),
    _matches(2, "hex", "[0-9a-f]{16,}", _long("[0-9a-f]{16,}")),
])
SECRETS_BASE = (
    "SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, "
    f"sha256(coalesce(string_agg(span, ',' ORDER BY a, kind), '')) AS base_sha256 FROM documents d LEFT JOIN ({_SPANS}) s ON d.doc_id = s.doc_id GROUP BY d.doc_id"
)

# --- base rules of quality ----------------------------------------------------------------------------

_SPLIT = f"SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines FROM documents"
_WINDOWS = "SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM split WHERE len(words) >= 5"
_TIMES = "SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS times FROM (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w FROM windows)"
_COVERED = "SELECT doc_id, count(DISTINCT i + k) AS n FROM times, range(0, 5) AS r(k) WHERE times > 1 GROUP BY doc_id"
QUALITY_BASE = (
    f"WITH split AS MATERIALIZED ({_SPLIT}), windows AS ({_WINDOWS}), times AS ({_TIMES}), covered AS ({_COVERED}) "
    "SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM (SELECT s.doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, "
    "length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id)"
)

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

LEXICAL = f"""
WITH docs AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM sizes),
items AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
hits AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM hits, totals GROUP BY term),
scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // length))))::BIGINT AS score
 FROM items JOIN hits USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""
