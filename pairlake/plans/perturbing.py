"""Registered queries: mixing and transforming texts."""

from __future__ import annotations

import ast
import re

from pyspark.sql import functions as F

from pairlake.functions.draws import draw
from pairlake.functions.lexer import LITERAL_PARTS
from pairlake.operators import pairs as P
from pairlake.operators import perturb as E
from pairlake.operators import extend
from pairlake.operators.grid import DEFAULT_FLAGS, EXPERIMENT_FLAGS, EXPERIMENTS, MIXES, profile_rows
from pairlake.plans.common import SEED, sql_draw, sql_pairs, sql_rank, sql_step, table, texts
from pairlake.plans.pairing import CHANGES, FLAG_DEFAULTS, PROFILE_VALUES, STAGED, _staged
from pairlake.plans.texts import SQL_IS_NAME, SQL_IS_STRING, _q, sql_class, sql_compact, sql_raw

QUERIES, ORACLES = {}, {}
NL = "chr(10)"


def _attached(s, d):
    return P.attach(P.make_pairs(_staged(s, d), "doc_id", SEED), table(s, d, "documents"), pack=True)


ATTACHED = f"""s AS ({STAGED}), {sql_pairs("s", "doc_id")},
att AS (SELECT pairs.*, x.text AS seed_text, y.text AS alt_text, z.text AS base_text FROM pairs
  JOIN documents x ON x.doc_id = seed_id JOIN documents y ON y.doc_id = alt_id JOIN documents z ON z.doc_id = base_id)"""


def sql_lines(text):
    return f"string_split({text}, {NL})"


def sql_inject(seed, base, drawn):
    lines = sql_lines(base)
    at = f"({drawn} % (len({lines}) + 1))"
    return f"array_to_string(list_concat({lines}[1:{at}], [{seed}], {lines}[{at} + 1:]), {NL})"


def sql_share(drawn, fraction):
    return f"({drawn} % 10000 < {int(round(fraction * 10000))})"


def sql_new_name(name, *keys):
    parts = ", ".join([f"'{SEED}'", *[f"cast({k} AS varchar)" for k in keys], name])
    return f"'_0x' || substr(md5(concat_ws('|', {parts})), 1, 16)"


def sql_parts(text):
    return f"regexp_extract_all({text}, {_q(LITERAL_PARTS)}, 0)"


def sql_rename(text, *keys):
    return (
        f"array_to_string(list_transform({sql_raw(text, True)}, lambda x: CASE WHEN {SQL_IS_NAME} "
        f"THEN {sql_new_name('x', *keys)} ELSE x END), '')"
    )


def sql_split(text, n):
    inner = f"regexp_extract_all(x[2:length(x)-1], '(?s).{{1,{n}}}', 0)"
    return (
        f"array_to_string(list_transform({sql_parts(text)}, lambda x: CASE WHEN {SQL_IS_STRING} AND length(x) > 2 "
        f"THEN array_to_string(list_transform({inner}, lambda c: x[1] || c || x[1]), '+') "
        f"WHEN trim(x, ' ') = '+' AND x[1] = '+' THEN '+ ' || x[2:] ELSE x END), '')"
    )


def sql_number(text, *keys):
    """A number's digits parted at a drawn place: zeros behind the first part, leading zeros dropped."""
    at = f"({sql_draw('number', *keys, '(i - 1)')} % (length(x) + 1))"
    plain = lambda c: f"regexp_replace('0' || {c}, '^0+([0-9])', '\\1')"
    first = plain(f"(x[1:{at}] || repeat('0', length(x) - {at}))")
    rest = plain(f"x[{at} + 1:]")
    return (
        f"array_to_string(list_transform({sql_raw(text, True)}, lambda x, i: CASE WHEN regexp_full_match(x, '[0-9]+') "
        f"THEN '(' || {first} || '+' || {rest} || ')' ELSE x END), '')"
    )


def sql_permuted(text, threshold, *keys):
    h = f"CASE WHEN {sql_share(sql_draw('permute', *keys), threshold)} THEN {sql_draw('line', *keys, '(i - 1)')} ELSE i - 1 END"
    return f"list_sort(list_transform({sql_lines(text)}, lambda x, i: {{'h': {h}, 'i': i - 1, 'x': x}}))"


def sql_permute(text, threshold, *keys):
    return f"array_to_string(list_transform({sql_permuted(text, threshold, *keys)}, lambda r: r.x), {NL})"


def sql_dead_from(text, donor, threshold, *keys):
    pool = sql_lines(donor)
    extra = f"{pool}[({sql_draw('dead_line', *keys, '(i - 1)')} % len({pool})) + 1]"
    return (
        f"array_to_string(list_transform({sql_lines(text)}, lambda x, i: CASE WHEN "
        f"{sql_share(sql_draw('dead', *keys, '(i - 1)'), threshold)} THEN x || {NL} || {extra} ELSE x END), {NL})"
    )


QUERIES["inject"] = lambda s, d: _attached(s, d).select(
    "pair_id", "label", F.md5(E.inject(F.col("alt_text"), F.col("base_text"), draw(SEED, "inject", "pair_id"))).alias("digest")
)
ORACLES["inject"] = f"""
WITH {ATTACHED} SELECT pair_id, label, md5({sql_inject("alt_text", "base_text", sql_draw("inject", "pair_id"))}) AS digest FROM att"""

QUERIES["interleave"] = lambda s, d: _attached(s, d).select(
    "pair_id", F.md5(E.interleave(F.col("alt_text"), F.col("base_text"), SEED, "pair_id")).alias("digest")
)
ORACLES["interleave"] = f"""
WITH {ATTACHED},
l AS (SELECT pair_id, {sql_lines("alt_text")} AS a, {sql_lines("base_text")} AS b FROM att),
p AS (SELECT *, list_sort(list_transform(generate_series(1, len(a)), lambda j: {sql_draw("mix", "pair_id", "j")} % (len(b) + 1))) AS pl FROM l),
r AS (SELECT pair_id, unnest(list_transform(a, lambda x, i: {{'at': pl[i], 'side': 0, 'i': i - 1, 'x': x}})) AS r FROM p
  UNION ALL SELECT pair_id, unnest(list_transform(b, lambda x, i: {{'at': i - 1, 'side': 1, 'i': i - 1, 'x': x}})) FROM p)
SELECT pair_id, md5(string_agg(r.x, {NL} ORDER BY r.at, r.side, r.i)) AS digest FROM r GROUP BY pair_id"""

QUERIES["append_wrapped"] = lambda s, d: P.two_folder_pairs(table(s, d, "documents"), "doc_id", SEED).join(
    table(s, d, "documents").select(F.col("doc_id").alias("first"), F.col("text").alias("a")), "first"
).join(
    table(s, d, "documents").select(F.col("doc_id").alias("second"), F.col("text").alias("b")), "second"
).select("doc_id", "label", F.md5(E.append_wrapped(F.col("a"), F.col("b"))).alias("digest"))
ORACLES["append_wrapped"] = f"""
WITH r AS ({sql_rank("documents", "doc_id")}),
z AS (SELECT *, {sql_step(sql_draw("zero_first", "doc_id"), "n", "rank")} AS fr FROM r),
z2 AS (SELECT *, {sql_step(sql_draw("zero_second", "doc_id"), "n", "rank", "fr")} AS sr FROM z),
t AS (SELECT r.doc_id, r.doc_id AS first, b.doc_id AS second, 1 AS label FROM r
  JOIN r b ON b.rank = {sql_step(sql_draw("one", "r.doc_id"), "r.n", "r.rank")}
  UNION ALL SELECT z2.doc_id, f.doc_id, g.doc_id, 0 FROM z2 JOIN r f ON f.rank = fr JOIN r g ON g.rank = sr)
SELECT t.doc_id, label, md5(a.text || {NL} || '(function () {{' || {NL} || b.text || {NL} || '}})();' || {NL}) AS digest
FROM t JOIN documents a ON a.doc_id = first JOIN documents b ON b.doc_id = second"""

QUERIES["rename"] = lambda s, d: texts(s, d).select(
    "doc_id", F.md5(E.rename(F.col("text"), SEED, "doc_id")).alias("digest")
)
ORACLES["rename"] = f"SELECT doc_id, md5({sql_rename('text', 'doc_id')}) AS digest FROM documents"

QUERIES["rename_map"] = lambda s, d: E.rename_map(texts(s, d), "doc_id", "text", SEED, ["^_"]).groupBy("doc_id").agg(
    F.count("*").alias("names"), F.countDistinct("new").alias("new_names"), F.min("new").alias("least"), F.max("name").alias("last")
)
ORACLES["rename_map"] = f"""
WITH m AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest({sql_raw("text")}) AS x FROM documents)
           WHERE {SQL_IS_NAME} AND x NOT LIKE '\\_%' ESCAPE '\\')
SELECT doc_id, count(*) AS names, count(*) AS new_names, min({sql_new_name("x", "doc_id")}) AS least, max(x) AS last FROM m GROUP BY doc_id"""

QUERIES["rename_keys"] = lambda s, d: table(s, d, "events").select(
    "event_id", E.rename_keys(F.col("props"), SEED, "event_id").alias("props")
)
ORACLES["rename_keys"] = f"""
SELECT event_id, '{{"' || {sql_new_name("k", "event_id")} || '":' || (props ->> ('$.' || k)) || '}}' AS props
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"""


def _string_array(s, d):
    words = E.string_dictionary(F.col("html"), 0.75, SEED, "page_id", rotate=True, shuffle=True)
    t = texts(s, d, "pages").select("page_id", "html", words.alias("w"))
    return t.select(
        "page_id", F.size("w").alias("words"), F.md5(E.reference_literals(F.col("html"), F.col("w"), 7)).alias("digest"),
        F.array_join(E.encode_dictionary(F.col("w"), "base64"), ",").alias("dictionary"),
    )


QUERIES["string_array"] = _string_array
ORACLES["string_array"] = f"""
WITH w AS (SELECT page_id, html, list_transform(list_sort(list_transform(list_distinct(list_filter({sql_raw("html")},
    lambda x: {SQL_IS_STRING} AND {sql_share(sql_draw("literal", "page_id", "x"), 0.75)})),
    lambda x: {{'h': {sql_draw("place", "page_id", "x")}, 'x': x}})), lambda r: r.x) AS w0 FROM pages),
v AS (SELECT page_id, html, w0, {sql_draw("rotate", "page_id")} % greatest(len(w0), 1) AS k FROM w),
u AS (SELECT page_id, html, list_concat(w0[k + 1:], w0[1:k]) AS w FROM v)
SELECT page_id, len(w) AS words,
  md5(array_to_string(list_transform({sql_raw("html", True)}, lambda x: CASE WHEN {SQL_IS_STRING} AND list_contains(w, x)
    THEN '_s(0x' || lower(to_hex(list_position(w, x) - 1 + 7)) || ')' ELSE x END), '')) AS digest,
  array_to_string(list_transform(w, lambda x: to_base64(encode(x))), ',') AS dictionary FROM u"""

QUERIES["split_literals"] = lambda s, d: texts(s, d, "pages").select(
    "page_id", *[F.md5(E.split_literals(F.col("html"), n)).alias(f"chunks_{n}") for n in (5, 9, 10)]
)
ORACLES["split_literals"] = "SELECT page_id, " + ", ".join(
    f"md5({sql_split('html', n)}) AS chunks_{n}" for n in (5, 9, 10)
) + " FROM pages"

RESERVED = ["^.(?:https?:)?/", "[0-9]"]
QUERIES["eligible_literals"] = lambda s, d: E.eligible_literals(texts(s, d, "pages"), "page_id", "html", RESERVED)
ORACLES["eligible_literals"] = f"""
SELECT page_id, pos - 1 AS pos, x AS literal FROM (SELECT page_id, unnest({sql_raw("html")}) AS x,
  generate_subscripts({sql_raw("html")}, 1) AS pos FROM pages)
WHERE {SQL_IS_STRING} AND NOT regexp_matches(x, {_q(RESERVED[0])}) AND NOT regexp_matches(x, {_q(RESERVED[1])})"""

QUERIES["permute_lines"] = lambda s, d: texts(s, d).select(
    "doc_id", E.permute_lines(F.col("text"), 0.75, SEED, "doc_id").alias("p")
).select("doc_id", F.md5("p.text").alias("digest"), "p.line_order")
ORACLES["permute_lines"] = f"""
SELECT doc_id, md5(array_to_string(list_transform(p, lambda r: r.x), {NL})) AS digest,
  array_to_string(list_transform(p, lambda r: cast(r.i AS varchar)), ',') AS line_order
FROM (SELECT doc_id, {sql_permuted("text", 0.75, "doc_id")} AS p FROM documents)"""

QUERIES["inject_dead"] = lambda s, d: E.inject_dead(table(s, d, "documents"), "doc_id", "text", 0.4, SEED).select(
    "doc_id", "dead_after", F.md5("text").alias("digest")
)
ORACLES["inject_dead"] = f"""
WITH r AS ({sql_rank("documents", "doc_id")}),
l AS (SELECT doc_id, unnest({sql_lines("text")}) AS x, generate_subscripts({sql_lines("text")}, 1) - 1 AS line,
      len({sql_lines("text")}) AS size FROM documents),
p AS (SELECT l.doc_id, line, {sql_step(sql_draw("donor", "l.doc_id", "line"), "n", "rank")} AS dr FROM l JOIN r USING (doc_id)
      WHERE {sql_share(sql_draw("dead", "l.doc_id", "line"), 0.4)}),
dl AS (SELECT p.doc_id, p.line, f.x FROM p JOIN r ON r.rank = dr JOIN l f ON f.doc_id = r.doc_id
       AND f.line = {sql_draw("dead_line", "p.doc_id", "p.line")} % f.size),
a AS (SELECT doc_id, line, 0 AS side, x FROM l UNION ALL SELECT doc_id, line, 1, x FROM dl)
SELECT doc_id, md5(string_agg(x, {NL} ORDER BY line, side)) AS digest,
  coalesce(string_agg(cast(line AS varchar), ',' ORDER BY line) FILTER (side = 1), '') AS dead_after FROM a GROUP BY doc_id"""


def _restore(s, d):
    # texts that already hold what the coding writes
    odd = F.concat("text", F.lit("\nx = 'a'+'b' + \"c\"+\"d\"; _s(0x1) _s_(0x2)"))
    docs = texts(s, d).select("doc_id", odd.alias("text")).withColumn("was", F.md5("text"))
    renamed = docs.withColumn("coded", E.rename(F.col("text"), SEED, "doc_id"))
    words = renamed.withColumn("w", E.string_dictionary(F.col("coded"), 0.75, SEED, "doc_id"))
    coded = words.withColumn("coded", E.split_literals(E.reference_literals(F.col("coded"), F.col("w")), 9))
    moved = coded.withColumn("p", E.permute_lines(F.col("coded"), 0.75, SEED, "doc_id"))
    moved = moved.select("doc_id", "was", "w", F.col("p.text").alias("coded"), F.col("p.line_order").alias("line_order"))
    names = E.rename_map(docs, "doc_id", "text", SEED)
    back = E.restore(moved, "doc_id", "coded", "was", "w", "line_order", names)
    return back.select("doc_id", F.md5("coded").alias("digest"), (F.col("status") == "failed").cast("int").alias("failed"))


QUERIES["restore"] = _restore
ORACLES["restore"] = """
SELECT doc_id, md5(text || chr(10) || 'x = ''a''+''b'' + "c"+"d"; _s(0x1) _s_(0x2)') AS digest, 0 AS failed FROM documents"""

QUERIES["number_expressions"] = lambda s, d: texts(s, d).select(
    "doc_id", F.md5(E.number_expressions(F.col("text"), SEED, "doc_id")).alias("digest")
)
ORACLES["number_expressions"] = f"SELECT doc_id, md5({sql_number('text', 'doc_id')}) AS digest FROM documents"


def sql_dictionary(parts, key, threshold):
    """CTE-free: the shuffled and rotated dictionary of a list of literal parts, from (k.., parts) to (k.., w)."""
    chosen = f"list_distinct(list_filter({parts}, lambda x: {SQL_IS_STRING} AND {sql_share(sql_draw('literal', key, 'x'), threshold)}))"
    return f"list_transform(list_sort(list_transform({chosen}, lambda x: {{'h': {sql_draw('place', key, 'x')}, 'x': x}})), lambda r: r.x)"


def sql_cell(tags, flags, partial, mixed, to_ast=False, out="md5(hdr || t) AS digest, length(hdr || t) AS chars"):
    """The steps of a profile as nested queries over (pair_id, label, base_text, hdr, t)."""
    own = "pair_id, label, base_text"
    place = lambda t: sql_inject(t, "base_text", sql_draw("inject", "pair_id"))
    sql = f"SELECT {own}, '' AS hdr, {place('alt_text') if mixed and not partial else 'alt_text'} AS t FROM att"
    step = lambda expression: f"SELECT {own}, hdr, {expression} AS t FROM ({sql})"
    on = lambda name: flags[name] == "true"
    if on("rename"):
        sql = step(sql_rename("t", "pair_id"))
    if on("rename_keys"):
        colon = "coalesce(k[i + 1] = ':' OR (regexp_full_match(k[i + 1], '\\s+') AND k[i + 2] = ':'), false)"
        sql = f"SELECT {own}, hdr, {sql_raw('t', True)} AS k FROM ({sql})"
        inner = sql_new_name("x[2:length(x) - 1]", "pair_id")
        sql = step(
            f"array_to_string(list_transform(k, lambda x, i: CASE WHEN {SQL_IS_NAME} AND {colon} THEN {sql_new_name('x', 'pair_id')} "
            f"WHEN {SQL_IS_STRING} AND length(x) > 2 AND {colon} THEN x[1] || {inner} || x[1] ELSE x END), '')"
        )
    if on("numbers"):
        sql = step(sql_number("t", "pair_id"))
    if on("string_array") and float(flags["string_array_threshold"]) > 0:
        words = sql_dictionary("k", "pair_id", float(flags["string_array_threshold"]))
        sql = f"SELECT {own}, k, {words} AS w0 FROM (SELECT {own}, {sql_parts('t')} AS k FROM ({sql}))"
        sql = f"SELECT *, {sql_draw('rotate', 'pair_id')} % greatest(len(w0), 1) AS r FROM ({sql})"
        sql = f"SELECT {own}, k, list_concat(w0[r + 1:], w0[1:r]) AS w FROM ({sql})"
        shown = "list_transform(w, lambda x: to_base64(encode(x)))" if flags["encoding"] == "base64" else "w"
        sql = (
            f"SELECT {own}, '_s=' || cast(to_json({shown}) AS varchar) || {NL} AS hdr, array_to_string(list_transform(k, lambda x: "
            f"CASE WHEN {SQL_IS_STRING} AND list_contains(w, x) THEN '_s(0x' || lower(to_hex(list_position(w, x) - 1)) || ')' "
            f"ELSE regexp_replace(x, '_s(_*)\\(0x', '_s_\\1(0x', 'g') END), '') AS t FROM ({sql})"
        )
    if on("split_strings"):
        sql = step(sql_split("t", int(flags["split_length"])))
    if on("permute"):
        sql = step(sql_permute("t", float(flags["permute_threshold"]), "pair_id"))
    if on("dead"):
        sql = step(sql_dead_from("t", "base_text", float(flags["dead_threshold"]), "pair_id"))
    if on("compact"):
        sql = step(sql_compact("t"))
    if to_ast:
        lexed = f"list_transform({sql_raw('l')}, lambda x: {sql_class()})"
        sql = step(f"cast(to_json(list_transform({sql_lines('t')}, lambda l: {lexed})) AS varchar)")
    if mixed and partial:
        sql = step(place("t"))
    named = ", ".join(f"'{v}' AS {k}" for k, v in tags.items())
    return f"SELECT pair_id, label, {named}, {out} FROM ({sql})"


# digests and lengths, so that no cell's text is held beside the others
DIGESTS = {"digest": E.DIGEST, "chars": E.CHARS}
QUERIES["profile_cells"] = lambda s, d: E.apply_profiles(_attached(s, d), SEED, outputs=DIGESTS, keep=["pair_id", "label"])
ORACLES["profile_cells"] = f"WITH {ATTACHED} " + " UNION ALL ".join(
    sql_cell({"exp": e, "mix": m}, {**DEFAULT_FLAGS, **EXPERIMENT_FLAGS[e], "dead": str(m == "M3").lower()}, False, m != "M1")
    for e in EXPERIMENTS for m in MIXES
)

QUERIES["profile_modes"] = lambda s, d: E.apply_modes(_attached(s, d), SEED, [r["name"] for r in profile_rows()], outputs=DIGESTS, keep=["pair_id", "label"])


def written_profiles() -> list[tuple[str, dict[str, str], bool, bool, bool]]:
    """The profiles as they are written down by hand for the check of ``profile_flags``, not from operators.grid."""
    listed = lambda text: ast.literal_eval(f"[{text}]")
    rows = []
    for _, _, name, _, partial, mixed, to_ast in listed(PROFILE_VALUES):
        own = {flag: value for pattern, flag, value in listed(CHANGES) if re.fullmatch(pattern, name)}
        rows.append((name, {**dict(listed(FLAG_DEFAULTS)), **own}, bool(partial), bool(mixed), bool(to_ast)))
    return rows


ORACLES["profile_modes"] = f"WITH {ATTACHED} " + " UNION ALL ".join(
    sql_cell({"mode": name}, flags, partial, mixed, to_ast) for name, flags, partial, mixed, to_ast in written_profiles()
)

# ---- a caller's own steps ---------------------------------------------------


def _own_steps(s, d):
    extend.register_step("loud", lambda t: F.translate(t, "aeiou", "AEIOU"))
    extend.register_step("numbered", lambda t: F.regexp_replace(t, "[0-9]+", "<$0>"))
    flags = lambda **over: {**DEFAULT_FLAGS, **over}
    cells = [
        ({"mode": "plain"}, flags(permute="true"), False, True, False), ({"mode": "loud"}, flags(permute="true", own_steps="loud"), False, True, False),
        ({"mode": "both"}, flags(permute="true", own_steps="loud,numbered"), False, True, False), ({"mode": "tree"}, flags(own_steps="numbered"), True, False, True),
    ]
    return E.run_cells(_attached(s, d), SEED, cells, DIGESTS).select("pair_id", "label", "mode", "digest", "chars")


QUERIES["own_steps"] = _own_steps
_own_cell = lambda flags, partial, mixed: sql_cell({"mode": "x"}, {**DEFAULT_FLAGS, **flags}, partial, mixed, out="hdr || t AS t")
_own_out = lambda name, sql, text: f"SELECT pair_id, label, '{name}' AS mode, md5({text}) AS digest, length({text}) AS chars FROM ({sql})"
_permuted, _alone = _own_cell({"permute": "true"}, False, True), _own_cell({}, True, False)
_loud = "translate(t, 'aeiou', 'AEIOU')"
_numbered = lambda t: f"regexp_replace({t}, '[0-9]+', '<\\0>', 'g')"
_tree = f"SELECT pair_id, label, cast(to_json(list_transform({sql_lines(_numbered('t'))}, lambda l: list_transform({sql_raw('l')}, lambda x: {sql_class()}))) AS varchar) AS t FROM ({_alone})"
ORACLES["own_steps"] = f"WITH {ATTACHED} " + " UNION ALL ".join([
    _own_out("plain", _permuted, "t"), _own_out("loud", _permuted, _loud), _own_out("both", _permuted, _numbered(_loud)), _own_out("tree", _tree, "t")])
