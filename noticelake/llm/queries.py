"""The corpus operators as registered queries, with production parameters, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import bpe, licenses, lm, manifest, mixing, neighbours, pii, quality, repair, secrets, toxicity
from noticelake.llm import spans as S
from noticelake.llm.common import documents, table
from noticelake.llm.dedup import near_duplicates
from noticelake.llm.overlap import jaccard_join


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(table(spark, sf_dir, "documents")))
    labels = lambda col: F.transform(F.filter(col, lambda x: F.size(x["starts"]) > 0), lambda x: x["label"])
    joined = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    starts = F.flatten(F.transform("base_starts", lambda x: x["starts"]))
    return found.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(labels("base_starts")).alias("base_labels"), joined(F.concat(labels("base_starts"), labels("more_starts"))).alias("labels"), F.col("coverage").alias("score"),
    )


def _duck_same(at: str, phrase: str) -> str:
    return "(" + " AND ".join(f"w[{at} + {j}] = '{x}'" for j, x in enumerate(phrase.split())) + ")"


def _duck_starts(t: licenses.Template) -> str:
    """Places, from 1, of a template's first phrase where the others stand within the slack of their distance to it."""
    out = f"list_filter(range(1, len(w) + 1), lambda i: {_duck_same('i', t.keys[0])})"
    first, *others = licenses.places(t)
    for at, key in zip(others, t.keys[1:]):
        near = f"list_filter(range({at - first - t.slack}, {at - first + t.slack + 1}), lambda d: i + d > 0 AND {_duck_same('i + d', key)})"
        out = f"list_filter({out}, lambda i: len({near}) > 0)"
    return out


def _duck_coverage(k: int, t: licenses.Template) -> str:
    n, at, kinds = len(t.words.split()), licenses.places(t)[0], sorted(set(t.words.split()))
    inside = f"w[greatest(i - {at + t.slack}, 1):greatest(i - {at} + {n + t.slack} - 1, 0)]"
    return f"coalesce(list_max(list_transform(s{k}, lambda i: len(list_intersect({kinds}, {inside})) / {len(kinds)}.0)), 0)"


_ALL = licenses.BASE + licenses.MORE
_N = len(licenses.BASE)
OP1_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT *, {", ".join(f"{_duck_starts(t)} AS s{k}" for k, t in enumerate(_ALL))} FROM d),
g AS (SELECT *, {" || ".join(f"s{k}" for k in range(_N))} AS base FROM f)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base, CAST(list_min(base) - 1 AS BIGINT) AS first_word, CAST(list_max(base) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN len(s{k}) > 0 THEN '{t.label}' END" for k, t in enumerate(licenses.BASE))}], lambda x: x IS NOT NULL)), ',') AS base_labels,
  array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN len(s{k}) > 0 THEN '{t.label}' END" for k, t in enumerate(_ALL))}], lambda x: x IS NOT NULL)), ',') AS labels,
  CAST(greatest({", ".join(_duck_coverage(k, t) for k, t in enumerate(_ALL))}) AS DOUBLE) AS score
FROM g
"""


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, chain).drop("text")


def op3_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(table(spark, sf_dir, "documents")))
    counts = [S.count(F.col("base_spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(S.written(F.col("base_spans")), 256).alias("base_sha256"), S.written(F.col("spans")).alias("spans"))


_DUCK_SPANS = """
  list_transform(range(1, len({m}) + 1), lambda i: {{'kind': '{kind}', 'start': CAST(list_sum(list_transform({g}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({m}[1:i-1], lambda x: length(x))), 0) AS BIGINT), 'value': {m}[i]}})"""


def _duck_spans(kind: str, pattern: str, keep: str = "true") -> str:
    """A list of (kind, start, value) for the matches of an RE2 pattern in column t."""
    quoted = "'" + pattern.replace("'", "''") + "'"
    found, pieces = f"regexp_extract_all(t, {quoted})", f"string_split_regex(t, {quoted})"
    return f"list_filter({_DUCK_SPANS.format(m=found, g=pieces, kind=kind)}, lambda s: {keep})"


OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t,
  {_duck_spans("assign", secrets.RE2_ASSIGN, f"length(regexp_extract(s.value, '{secrets.RE2_ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 12")} AS assign,
  {_duck_spans("access", "AKIA[A-Z0-9]{14,}")} AS access,
  {_duck_spans("hex", "[0-9a-f]{16,}")} AS hex,
  {_duck_spans("entropy", "[A-Za-z0-9+/_=-]{20,}")} AS candidates
FROM d),
c AS (SELECT *, list_transform(list_sort(list_transform(list_concat(list_concat(assign, access), hex), lambda s: {{'a': s.start, 'b': list_position(['assign', 'access', 'hex'], s.kind), 'e': s.start + length(s.value)}})),
    lambda x: x) AS base FROM b),
e AS (SELECT *, list_filter(candidates, lambda s: regexp_matches(s.value, '[0-9]') AND regexp_matches(s.value, '[A-Za-z]') AND NOT regexp_matches(s.value, '{secrets.RE2_ALLOWED}')
    AND len(list_filter(base, lambda o: o.a < s.start + length(s.value) AND s.start < o.e)) = 0
    AND CASE WHEN regexp_matches(s.value, '^[0-9A-Fa-f]+$')
      THEN list_max(list_transform(range(1, length(s.value) - 14), lambda j: list_aggregate(string_split(substr(s.value, j, 16), ''), 'entropy'))) >= 3.01
      ELSE list_max(list_transform(range(1, length(s.value) - 18), lambda j: list_aggregate(string_split(substr(s.value, j, 20), ''), 'entropy'))) >= 3.71 END) AS more FROM c)
SELECT doc_id, len(assign) AS n_assign, len(access) AS n_access, len(hex) AS n_hex,
  sha256(array_to_string(list_transform(base, lambda x: ['assign', 'access', 'hex'][x.b] || ':' || x.a || ':' || x.e), ',')) AS base_sha256,
  array_to_string(list_transform(list_sort(list_concat(base, list_transform(more, lambda s: {{'a': s.start, 'b': 4, 'e': s.start + length(s.value)}}))), lambda x: ['assign', 'access', 'hex', 'entropy'][x.b] || ':' || x.a || ':' || x.e), ',') AS spans
FROM e
"""


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(documents(table(spark, sf_dir, "documents")))
    counts = [S.count(F.col("base_spans"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(S.written(F.col("base_spans")), 256).alias("base_sha256"), S.written(F.col("spans")).alias("spans"), F.array_join(F.transform("scores", lambda x: F.round(100 * x).cast("int").cast("string")), ",").alias("scores"))


_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
_LUHN = """list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN CAST({d}[i] AS INT) ELSE 2 * CAST({d}[i] AS INT) - CASE WHEN CAST({d}[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_DIGITS = "regexp_replace(s.value, '[^0-9]', '', 'g')"
_PLAIN = "replace(s.value, ' ', '')"
_PERCENT = "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {round(100 * pii.BASE_SCORE[k] + (100 * pii.CHECKED if k in ('card', 'iban') else 0))} + CASE WHEN regexp_matches(s.near, '{pii.CONTEXT[k]}') THEN {round(100 * pii.NEARBY)} ELSE 0 END" for k in pii.KINDS) + f" END + CASE WHEN regexp_matches(s.near, '{pii.DOUBT}') THEN {round(100 * pii.DOUBTED)} ELSE 0 END"
_MOD97 = f"list_reduce(list_transform(string_split(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4), ''), lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1), lambda acc, n: (CASE WHEN n > 9 THEN acc * 100 ELSE acc * 10 END + n) % 97, 0) = 1"
_ACCOUNT = "(?:" + "|".join(f"{c}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, cs in pii.IBAN_LENGTHS.items() for c in cs.split()) + ")"
_NEAR = f"(substr(t, greatest(s.start - {pii.WINDOW}, 0) + 1, least(s.start, {pii.WINDOW})) || ' ' || substr(t, s.start + length(s.value) + 1, {pii.WINDOW}))"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id,
  {_duck_spans("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+")} AS email,
  {_duck_spans("ip", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", f"regexp_full_match(s.value, '{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}')")} AS ip,
  {_duck_spans("card", "[0-9](?:[ -]?[0-9]){12,}", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN.format(d=_DIGITS)}")} AS card,
  {_duck_spans("phone", "[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15")} AS phone,
  {_duck_spans("iban", _ACCOUNT, "NOT regexp_matches(substr(t, s.start + length(s.value) + 1, 1), '[A-Z0-9]')")} AS accounts, t
FROM d),
c AS (SELECT *, list_concat(list_concat(email, ip), list_concat(card, phone)) AS base FROM b),
e AS (SELECT *, list_filter(accounts, s -> length(replace(s.value, ' ', '')) BETWEEN 15 AND 34 AND {_MOD97}
    AND len(list_filter(base, o -> o.start < s.start + length(s.value) AND s.start < o.start + length(o.value))) = 0) AS iban FROM c),
n AS (SELECT *, list_transform(list_concat(base, iban), s -> {{'kind': s.kind, 'start': s.start, 'value': s.value, 'near': {_NEAR}}}) AS near FROM e),
p AS (SELECT *, list_filter(list_transform(near, s -> {{'kind': s.kind, 'start': s.start, 'value': s.value, 'percent': greatest(0, least(100, {_PERCENT}))}}), s -> s.kind <> 'iban' OR s.percent >= {round(100 * pii.LEAST)}) AS found FROM n)
SELECT doc_id, len(email) AS n_email, len(ip) AS n_ip, len(card) AS n_card, len(phone) AS n_phone,
  sha256(array_to_string(list_transform(base, s -> s.kind || ':' || s.start || ':' || (s.start + length(s.value))), ',')) AS base_sha256,
  array_to_string(list_transform(found, s -> s.kind || ':' || s.start || ':' || (s.start + length(s.value))), ',') AS spans,
  array_to_string(list_transform(found, s -> CAST(s.percent AS VARCHAR)), ',') AS scores
FROM p
""".replace("s ->", "lambda s:").replace("o ->", "lambda o:")


def op6_posting_list_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


_RUNS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _duck_number(text: str, of: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) % {of}"


def _duck_quota(name: str, rows: str, within: str, key: str, votes: str, seats: str) -> str:
    """Seats by ranking all quotients."""
    return f"""{name}_q AS (SELECT {within}, {key}, seats, row_number() OVER (PARTITION BY {within} ORDER BY CAST({votes} AS DOUBLE) / (2 * k + 1) DESC, {key}) AS turn FROM (SELECT *, {seats} AS seats, unnest(range(CAST(most AS BIGINT))) AS k FROM {rows} WHERE {votes} > 0)),
{name} AS (SELECT r.*, coalesce(q.n, 0) AS quota FROM {rows} r LEFT JOIN (SELECT {within}, {key}, count(*) AS n FROM {name}_q WHERE turn <= seats GROUP BY ALL) q USING ({within}, {key}))"""


OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST({_RUNS} AS BIGINT) AS size, md5(coalesce(text, '')) AS h, count(*) AS copies FROM documents GROUP BY ALL),
z AS (SELECT source, CAST(sum(size * copies) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM z), r AS (SELECT *, CAST({list(mixing.WEIGHTS)}[number % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS weight FROM w),
p AS (SELECT *, {mixing.LIMIT} * source_size / weight AS ratio, {mixing.SHARE} * sum(source_size) OVER () AS total FROM r),
l AS (SELECT *, (total - coalesce(sum({mixing.LIMIT} * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM p WINDOW b AS (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least({mixing.LIMIT} * CAST(source_size AS DOUBLE), coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), max(ratio) OVER ()) * weight) AS target FROM l),
s0 AS (SELECT *, 1 AS whole, CAST(round(sum(target) OVER () / {mixing.BLOCK_WORDS}) AS BIGINT) AS all_seats, {mixing.LIMIT} * ceil(source_size / {mixing.BLOCK_WORDS}) AS most, CAST(greatest(ceil(source_size / {mixing.SHARD_WORDS}), 1) AS BIGINT) AS shards FROM t),
{_duck_quota("s", "s0", "whole", "number", "target", "all_seats")},
n AS (SELECT d.*, s.number, s.source_size, s.target, s.quota AS source_quota, s.shards, coalesce(CAST(doc_id AS VARCHAR), '') || '|' || h || '|{mixing.SEED}' AS key FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT *, {_duck_number("key", "shards")} AS shard, substr(md5(key), 16, 17) AS turn, size * copies AS length FROM n WHERE size > 0),
h0 AS (SELECT number, source, shard, shard // {mixing.FAN} AS g, sum(length) AS shard_size, ceil(sum(length) / {mixing.BLOCK_WORDS}) AS shard_blocks, any_value(source_quota) AS source_quota FROM c GROUP BY ALL),
g0 AS (SELECT number, g, sum(shard_size) AS group_size, {mixing.LIMIT} * sum(shard_blocks) AS most, any_value(source_quota) AS source_quota FROM h0 GROUP BY ALL),
{_duck_quota("g", "g0", "number", "g", "group_size", "source_quota")},
h1 AS (SELECT h0.*, g.quota AS group_quota, {mixing.LIMIT} * shard_blocks AS most, number || '|' || h0.g AS within_group FROM h0 JOIN g USING (number, g)),
{_duck_quota("h2", "h1", "within_group", "shard", "shard_size", "group_quota")},
f AS (SELECT *, floor(quota / shard_blocks) AS rounds, quota % shard_blocks AS run, {_duck_number(f"coalesce(source, '') || '|' || shard || '|{mixing.SEED}'", "CAST(shard_blocks AS BIGINT)")} AS first FROM h2),
o AS (SELECT c.*, f.rounds, f.first * {mixing.BLOCK_WORDS} AS low, (f.first + run) * {mixing.BLOCK_WORDS} AS high, greatest(0, f.first + run - shard_blocks) * {mixing.BLOCK_WORDS} AS again, sum(length) OVER (PARTITION BY c.number, c.shard ORDER BY turn, doc_id NULLS FIRST, h ROWS UNBOUNDED PRECEDING) - length AS begins FROM c JOIN f USING (number, shard)),
e AS (SELECT doc_id, size, source_size, target, rounds, low, high, again, begins + size * unnest(range(copies)) AS a FROM o)
SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(0, least(a + size, high) - greatest(a, low)) + greatest(0, least(a + size, again) - a) AS BIGINT) AS taken FROM e
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM (SELECT *, unnest(range(copies)) AS a FROM n WHERE size = 0)
"""


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(documents(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.check_against_tampered(table(spark, sf_dir, "documents"))


def _duck_crc32(text: str) -> str:
    bits = "lambda x, y: xor(x >> 1, 3988292384 * (x & 1))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], {bits}), CAST(4294967295 AS BIGINT)), 4294967295)"


def _duck_leaf(text: str) -> str:
    part = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    return f"sha256({' || '.join(part(f'CAST({c} AS VARCHAR)') for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: Levels that the SQL's trees have at most: 16**6 leaves.
_DEPTH = 6


def _duck_tree(name: str) -> str:
    """From name_0 (tree, nth, digest, size) the levels above, and for each level what stands left and right of a node."""
    out = []
    for k in range(_DEPTH):
        other = "string_agg(digest, '') OVER (PARTITION BY tree, nth // 16 ORDER BY nth ROWS BETWEEN {})"
        out.append(f"{name}_{k}s AS (SELECT *, coalesce({other.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS lefts, coalesce({other.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS rights FROM {name}_{k})")
        out.append(f"{name}_{k + 1} AS (SELECT tree, nth // 16 AS nth, CASE WHEN any_value(size) > 1 THEN sha256(string_agg(digest, '' ORDER BY nth)) ELSE any_value(digest) END AS digest, (any_value(size) + 15) // 16 AS size FROM {name}_{k} GROUP BY tree, nth // 16)")
    return ",\n".join(out)


def _duck_folds(rows: str, name: str, to: str) -> str:
    """rows (doc_id, leaf, tree, nth, folded, proof, ...) folded up the levels of name."""
    out, last = [], rows
    for k in range(_DEPTH):
        new = f"{to}_{k}"
        out.append(f"{new} AS (SELECT f.* REPLACE (CASE WHEN s.size > 1 THEN sha256(s.lefts || f.folded || s.rights) ELSE f.folded END AS folded, f.proof || s.lefts || s.rights AS proof, f.nth // 16 AS nth) FROM {last} f JOIN {name}_{k}s s ON s.tree IS NOT DISTINCT FROM f.tree AND s.nth = f.nth)")
        last = new
    return ",\n".join(out)


OP12_SQL = f"""
WITH l AS (SELECT doc_id, source, {_duck_leaf("text")} AS leaf, CASE WHEN {_duck_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_duck_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_duck_leaf("text")} END AS changed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth, count(*) OVER (PARTITION BY source) AS size FROM l),
n_0 AS (SELECT source AS tree, nth, leaf AS digest, size FROM p),
{_duck_tree("n")},
r AS (SELECT tree AS source, digest AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM n_{_DEPTH}),
m_0 AS (SELECT 0 AS tree, place AS nth, subroot AS digest, size FROM r),
{_duck_tree("m")},
f AS (SELECT doc_id, leaf, source AS tree, nth, changed AS folded, '' AS proof FROM p),
{_duck_folds("f", "n", "f")},
g AS (SELECT f.doc_id, f.leaf, r.subroot, 0 AS tree, r.place AS nth, f.folded, f.proof FROM f_{_DEPTH - 1} f JOIN r ON r.source IS NOT DISTINCT FROM f.tree),
{_duck_folds("g", "m", "g")}
SELECT g.doc_id, g.leaf, g.subroot, m.digest AS root, sha256(g.proof) AS proof_sha256, g.folded AS folded_root, g.folded = m.digest AS verified FROM g_{_DEPTH - 1} g, m_{_DEPTH} m
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_COST = "CASE WHEN g.fault = 't' THEN 3 ELSE 0 END"
_SAME = "IS NOT DISTINCT FROM"


def _duck_before(state: int) -> str:
    """The least cost of deleting, keeping or re-roling a turn in a state, from the costs after it."""
    put = (2, 2, 3, 2)[state]
    kept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
    keep = "CASE g.x " + " ".join(f"WHEN '{x}' THEN {_COST} + c.c{to}" for x, to in kept.items()) + " END"
    return f"least(4 + c.c{state}, CASE WHEN g.fault NOT IN ('b', 'd') THEN least({keep}, 3 + {_COST} + c.c{put}) END)"


def _duck_state(by: dict[str, str]) -> str:
    return "CASE t.state " + " ".join(f"WHEN {s} THEN {v}" for s, v in by.items()) + " END"


_HERE = _duck_state({s: f"c.c{s}" for s in range(4)})
_AFTER = _duck_state({s: f"n.c{s}" for s in range(4)})
_PUT = _duck_state({0: "2", 1: "2", 2: "3", 3: "2"})
_PUT_HERE = _duck_state({0: "c.c2", 1: "c.c2", 2: "c.c3", 3: "c.c2"})
_PUT_AFTER = _duck_state({0: "n.c2", 1: "n.c2", 2: "n.c3", 3: "n.c2"})
_KEEP = "CASE t.state || g.x WHEN '0s' THEN 1 WHEN '0u' THEN 2 WHEN '1u' THEN 2 WHEN '2a' THEN 3 WHEN '3u' THEN 2 END"
_KEEP_AFTER = "CASE t.state || g.x WHEN '0s' THEN n.c1 WHEN '0u' THEN n.c2 WHEN '1u' THEN n.c2 WHEN '2a' THEN n.c3 WHEN '3u' THEN n.c2 END"
_LETTER = f"""CASE WHEN g.i IS NOT NULL AND {_HERE} = 4 + {_AFTER} THEN 'D' WHEN {_HERE} = 3 + {_PUT_HERE} THEN 'I'
    WHEN g.fault NOT IN ('b', 'd') AND {_HERE} = {_COST} + {_KEEP_AFTER} THEN 'K' WHEN g.fault NOT IN ('b', 'd') AND {_HERE} = 3 + {_COST} + {_PUT_AFTER} THEN 'R' END"""
_PUT_ROLE = f"CASE {_PUT} WHEN 2 THEN 'user' ELSE 'assistant' END"
OP13_SQL = f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_duck_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS roll FROM conversations),
e AS (SELECT conv_id, turn, CASE roll WHEN 4 THEN 'user' ELSE role END AS role, CASE roll WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE roll WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM r WHERE roll <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM e),
q AS (SELECT *, left(role, 1) AS x, right(rtrim(text, {_WS}), 1) AS ending, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
g AS MATERIALIZED (SELECT *, CASE WHEN ending = '' THEN 'b' WHEN again THEN 'd' WHEN ending NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM q),
s AS MATERIALIZED (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1),
c AS MATERIALIZED (SELECT conv_id, n AS i, 0 AS c0, 6 AS c1, 3 AS c2, 0 AS c3 FROM s
  UNION ALL SELECT conv_id, i, least(b0, 3 + c2), least(b1, 3 + c2), c2, c3 FROM (SELECT *, least(b2, 3 + b3) AS c2, least(b3, 3 + b2) AS c3
    FROM (SELECT c.conv_id, c.i - 1 AS i, {", ".join(f"{_duck_before(k)} AS b{k}" for k in range(4))} FROM c JOIN g ON g.conv_id {_SAME} c.conv_id AND g.i = c.i))),
t AS MATERIALIZED (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, '' AS audit, '' AS repaired, false AS done FROM s
  UNION ALL SELECT conv_id, i + CASE WHEN letter IN ('D', 'K', 'R') THEN 1 ELSE 0 END, CASE letter WHEN 'K' THEN keep WHEN 'I' THEN put WHEN 'R' THEN put ELSE state END, audit || coalesce(letter, ''),
      repaired || CASE WHEN letter IN ('I', 'K', 'R') AND repaired <> '' THEN chr(10) ELSE '' END || CASE letter WHEN 'K' THEN role || ':' || text WHEN 'I' THEN put_role || ':' WHEN 'R' THEN put_role || ':' || text ELSE '' END, letter IS NULL
    FROM (SELECT t.*, {_LETTER} AS letter, {_KEEP} AS keep, {_PUT} AS put, {_PUT_ROLE} AS put_role, g.role, g.text FROM t JOIN c ON c.conv_id {_SAME} t.conv_id AND c.i = t.i
      LEFT JOIN g ON g.conv_id {_SAME} t.conv_id AND g.i = t.i + 1 LEFT JOIN c AS n ON n.conv_id {_SAME} t.conv_id AND n.i = t.i + 1 WHERE NOT t.done))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(c.c0, 0) AS BIGINT) AS cost, coalesce(t.audit, '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id {_SAME} a.conv_id LEFT JOIN c ON c.conv_id {_SAME} a.conv_id AND c.i = 0 LEFT JOIN t ON t.conv_id {_SAME} a.conv_id AND t.done
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_line_field_quality": op3_line_field_quality,
    "op4_secret_scan": op4_secret_scan,
    "op5_personal_data": op5_personal_data,
    "op6_posting_list_neighbours": op6_posting_list_neighbours,
    "op7_sainte_lague_mix": op7_sainte_lague_mix,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_cross_entropy_difference": op9_cross_entropy_difference,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": OP1_SQL,
    "op4_secret_scan": OP4_SQL,
    "op5_personal_data": OP5_SQL,
    "op7_sainte_lague_mix": OP7_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
