"""Registered queries: lexing, text and name functions, record JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions import lexer as L
from pairlake.functions import text as T
from pairlake.operators import pairs as P
from pairlake.plans.common import SEED, sql_pairs, table, texts
from pairlake.plans.pairing import STAGED, _staged

QUERIES, ORACLES = {}, {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_raw(text: str, blanks: bool = False) -> str:
    return f"regexp_extract_all({text}, {_q(L.GRAMMAR_WITH_BLANKS if blanks else L.GRAMMAR)}, 0)"


SQL_IS_NAME = "regexp_matches(x, '^[\\p{L}_$]')"
SQL_IS_STRING = "(x[1] IN ('\"', '''') AND length(x) > 1)"


def sql_class(letters: bool = False) -> str:
    put = lambda c: _q(L.CLASS_LETTERS[c]) if letters else _q(c)
    groups = " ".join(
        f"WHEN x IN ({', '.join(_q(m) for m in members)}) THEN {put(label)}" for label, members in L.OPERATOR_GROUPS.items()
    )
    last = "WHEN regexp_matches(x, '^[\\x21-\\x7E]') THEN x ELSE 'u'" if letters else "ELSE x"
    return (
        f"CASE WHEN {SQL_IS_NAME} THEN {put('name')} WHEN regexp_matches(x, '^[0-9]') THEN {put('num')} "
        f"WHEN {SQL_IS_STRING} THEN {put('string')} {groups} {last} END"
    )


def sql_escape(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '(?s).', 0), lambda c: "
        "CASE WHEN regexp_matches(c, '^[A-Za-z0-9@*_+\\-./]') THEN c WHEN unicode(c) < 256 THEN printf('%%%02X', unicode(c)) "
        "ELSE printf('%%u%04X', unicode(c)) END), '')"
    )


SQL_VALUE = (
    f"CASE WHEN {SQL_IS_NAME} OR x IN ({', '.join(_q(m) for g in L.OPERATOR_GROUPS.values() for m in g)}) THEN x "
    f"WHEN regexp_matches(x, '^[0-9]') THEN 'num' WHEN {SQL_IS_STRING} THEN {sql_escape('x[2:length(x)-1]')} ELSE x END"
)


def sql_tokens(text: str, mode: str = "class") -> str:
    return f"list_transform({sql_raw(text)}, lambda x: {sql_class() if mode == 'class' else SQL_VALUE})"


for _mode in ("class", "value"):
    QUERIES[f"lex_{_mode}"] = lambda s, d, m=_mode: texts(s, d).select(
        "doc_id", L.tokens(F.col("text"), m).alias("t")
    ).select("doc_id", F.size("t").alias("n_tokens"), F.md5(L.join_tokens(F.col("t"))).alias("digest"))
    ORACLES[f"lex_{_mode}"] = f"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {sql_tokens('text', _mode)} AS t FROM documents)"""

QUERIES["token_table"] = lambda s, d: L.lex(texts(s, d, "conversations"), ["conv_id", "turn"])
ORACLES["token_table"] = f"""
SELECT conv_id, turn, pos - 1 AS pos, x AS value, {sql_class()} AS class
FROM (SELECT conv_id, turn, unnest({sql_raw('text')}) AS x, generate_subscripts({sql_raw('text')}, 1) AS pos
      FROM conversations)"""

QUERIES["escape_text"] = lambda s, d: texts(s, d).select(
    "doc_id", F.md5(L.js_escape(F.col("text"))).alias("escaped")
)
ORACLES["escape_text"] = f"SELECT doc_id, md5({sql_escape('text')}) AS escaped FROM documents"

QUERIES["sanitise_names"] = lambda s, d: table(s, d, "pages").select(
    "page_id", T.sanitise_key(F.concat(F.lit("  "), F.col("url"), F.lit(" x éß$ "))).alias("cache_key"),
    T.flatten_key(F.col("url")).alias("flat_key"),
)
ORACLES["sanitise_names"] = """
SELECT page_id, regexp_replace(replace(trim('  ' || url || ' x éß$ '), ' ', '_'), '[^-\\p{L}\\p{N}_.]', '', 'g') AS cache_key,
       regexp_replace(url, '[^\\p{L}\\p{N}_]', '_', 'g') AS flat_key FROM pages"""


def _names(s, d):
    made = P.make_pairs(_staged(s, d), "doc_id", SEED)
    named = made.select(T.target_name(F.col("seed_id"), F.col("base_id"), F.col("label")).alias("target"))
    return named.select("target", T.parse_target(F.col("target")).alias("p")).select("target", "p.seed", "p.base", "p.label")


QUERIES["target_names"] = _names
ORACLES["target_names"] = f"""
WITH s AS ({STAGED}), {sql_pairs("s", "doc_id")}
SELECT concat_ws('.', seed_id, base_id, label, 'js') AS target, cast(seed_id AS VARCHAR) AS seed,
       cast(base_id AS VARCHAR) AS base, cast(label AS VARCHAR) AS label FROM pairs"""

QUERIES["line_counts"] = lambda s, d: table(s, d, "documents").select("doc_id", T.line_count(F.col("text")).alias("lines"))
ORACLES["line_counts"] = """
SELECT doc_id, len(regexp_split_to_array(text, chr(13) || chr(10) || '|' || chr(13) || '|' || chr(10) || '|' || chr(8232) || '|' || chr(8233))) AS lines
FROM documents"""

QUERIES["char_lengths"] = lambda s, d: table(s, d, "documents").select(
    "doc_id", F.length("text").alias("chars"), T.length_bin(F.length("text"), 1000).alias("bin")
)
ORACLES["char_lengths"] = """
SELECT doc_id, length(text) AS chars, cast(ceil(length(text) / 1000.0) AS BIGINT) AS bin FROM documents"""

QUERIES["truncate_text"] = lambda s, d: table(s, d, "documents").select("doc_id", T.truncate(F.col("text")).alias("text"))
ORACLES["truncate_text"] = "SELECT doc_id, substr(text, 1, 1024) AS text FROM documents"

QUERIES["compact_text"] = lambda s, d: texts(s, d).select(
    "doc_id", T.compact(F.col("text")).alias("t"), F.octet_length("text").alias("b")
).select("doc_id", F.md5("t").alias("digest"), (F.col("b") - F.octet_length("t")).alias("saved_bytes"))


def sql_compact(text: str) -> str:
    """Comments out, then blanks collapsed between literals, then both ends trimmed."""
    def parts(t: str, pattern: str, one: str) -> str:
        return f"array_to_string(list_transform(regexp_extract_all({t}, {_q(pattern)}, 0), lambda x: {one}), '')"

    out = parts(text, T.COMMENT_PARTS, "CASE WHEN x[1:2] = '/*' THEN ' ' WHEN x[1:2] = '//' THEN '' ELSE x END")
    blanks = "regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' *\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({parts(out, L.LITERAL_PARTS, f'CASE WHEN {SQL_IS_STRING} THEN x ELSE {blanks} END')}, '^[ \\n]+|[ \\n]+$', '', 'g')"


ORACLES["compact_text"] = f"""
SELECT doc_id, md5(t) AS digest, strlen(text) - strlen(t) AS saved_bytes FROM (SELECT doc_id, text, {sql_compact("text")} AS t FROM documents)"""

QUERIES["canonical_text"] = lambda s, d: texts(s, d).select(
    "doc_id", F.md5(T.canonical_lines(F.col("text"))).alias("digest")
)
ORACLES["canonical_text"] = """
SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda x: x <> ''), chr(10))) AS digest FROM documents"""

QUERIES["record_json"] = lambda s, d: T.to_record_json(
    table(s, d, "events").select("event_id", "user_id", "event_type", "value", "props"), big=("event_id",)
)
ORACLES["record_json"] = """
SELECT cast(json_object('event_id', cast(event_id AS VARCHAR), 'user_id', user_id, 'event_type', event_type, 'value', value, 'props', props) AS VARCHAR) AS record
FROM events"""


def _round_trip(s, d):
    made = P.make_pairs(_staged(s, d), "doc_id", SEED)
    schema = made.schema
    return T.from_record_json(T.to_record_json(made), schema)


QUERIES["record_json_back"] = _round_trip
ORACLES["record_json_back"] = f"WITH s AS ({STAGED}), {sql_pairs('s', 'doc_id')} SELECT * FROM pairs"
