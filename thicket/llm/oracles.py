"""DuckDB SQL of the training-data queries, written out by brute force, apart from the operators' methods."""

from __future__ import annotations

from thicket.llm.license_scan import PHRASES, TEMPLATES
from thicket.llm.token_count import VOCABULARY

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_TWO64 = "18446744073709551616::UHUGEINT"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _plain_words(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in low).split()


#: Greedy longest pieces of each distinct word with a blank before it, from the file of pieces; words as hex text.
TOKENS = rf"""
WITH RECURSIVE piece AS (SELECT lower(hex(from_base64(b))) AS p FROM read_csv('{VOCABULARY}', delim=' ', header=false, quote='', escape='', columns={{'b': 'VARCHAR', 'rank': 'BIGINT'}}) WHERE b IS NOT NULL),
lengths AS (SELECT DISTINCT length(p) AS l FROM piece),
w AS (SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT DISTINCT unnest(w) AS word FROM w),
walk(word, h, n) AS (
    SELECT word, '20' || lower(hex(encode(word))), 0 FROM u
    UNION ALL
    SELECT k.word, substr(k.h, max(length(piece.p)) + 1), k.n + 1
    FROM walk k JOIN lengths ON lengths.l <= length(k.h) JOIN piece ON piece.p = substr(k.h, 1, lengths.l) WHERE k.h <> '' GROUP BY k.word, k.h, k.n),
size AS (SELECT word, max(n) FILTER (h = '') AS n FROM walk GROUP BY word),
one AS (SELECT rid, unnest(w) AS word FROM w),
total AS (SELECT rid, count(*) AS n_words, sum(n) AS n_tokens, max(n) AS most FROM one JOIN size USING (word) GROUP BY rid)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(most, 0)::BIGINT AS most_in_word
FROM w LEFT JOIN total USING (rid)
"""

#: Every string of 200 bytes by its digest; the strings that start in two places cover the bytes that go.
REPEATS = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT rid, i, md5(b[i + 1:i + 200]) AS m FROM d, unnest(range(0, n - 199)) AS t(i)),
twice AS (SELECT m FROM s GROUP BY m HAVING count(*) > 1),
hit AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM s WHERE m IN (SELECT m FROM twice)),
run AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS r FROM hit),
span AS (SELECT rid, r, min(i) AS a, max(i) + 200 AS z FROM run GROUP BY rid, r),
gap AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS a, a AS z FROM span UNION ALL SELECT rid, max(z), NULL FROM span GROUP BY rid),
kept AS (SELECT rid, string_agg(hex(b[g.a + 1:coalesce(g.z, n)]), '' ORDER BY g.a) AS h FROM gap g JOIN d USING (rid) GROUP BY rid),
gone AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, CASE WHEN h IS NULL THEN sha256(b) ELSE sha256(unhex(h)) END AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
"""


def _jump(shards: int) -> str:
    """The buckets that a key's walk passes; the last one below `shards` is its shard."""
    nxt = f"((key * 2862933555777941757::UHUGEINT + 1) % {_TWO64})"
    return (
        f"walk{shards}(id, key, b, j) AS (SELECT id, h, -1::BIGINT, 0::BIGINT FROM mixed UNION ALL "
        f"SELECT id, {nxt}, j, floor((j + 1) * (CAST(2147483648 AS DOUBLE) / CAST({nxt} // 8589934592::UHUGEINT + 1 AS DOUBLE)))::BIGINT FROM walk{shards} WHERE j < {shards})"
    )


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, x: xor(c // 256, tab[(xor(c, x) & 255) + 1]))"

#: Jump hash by arithmetic modulo 2^64, CRC-32 by its table of 256 entries, slots by rank.
SHARDS = f"""
WITH RECURSIVE bits(k, v, step) AS (SELECT k, k, 0 FROM range(0, 256) AS t(k) UNION ALL SELECT k, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT k, v FROM bits WHERE step = 8),
ids AS (SELECT DISTINCT coalesce(doc_id, 0) AS id FROM documents),
z0 AS (SELECT id, ((CASE WHEN id < 0 THEN {_TWO64} - (-id)::UHUGEINT ELSE id::UHUGEINT END) + 11400714819323198485::UHUGEINT) % {_TWO64} AS z FROM ids),
z1 AS (SELECT id, (xor(z, z // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {_TWO64} AS z FROM z0),
z2 AS (SELECT id, (xor(z, z // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {_TWO64} AS z FROM z1),
mixed AS (SELECT id, xor(z, z // 2147483648::UHUGEINT) AS h FROM z2),
{_jump(8)},
{_jump(9)},
shard AS (SELECT id, max(b) AS s FROM walk8 WHERE b >= 0 GROUP BY id),
grown AS (SELECT id, max(b) AS s FROM walk9 WHERE b >= 0 GROUP BY id),
d AS (SELECT doc_id, coalesce(doc_id, 0) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, id, length(h) // 2 + 1 AS size, CASE WHEN h = '' THEN 0 ELSE xor({_CRC}, 4294967295) END AS crc FROM d, (SELECT list(v ORDER BY k) AS tab FROM crc))
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard.s::INTEGER AS shard, (row_number() OVER (PARTITION BY shard.s ORDER BY doc_id NULLS FIRST, crc, size) - 1)::BIGINT AS slot, grown.s::INTEGER AS grown_shard
FROM c JOIN shard USING (id) JOIN grown USING (id)
"""

#: Digests of the turns themselves, and the length of each turn as the template writes it.
CHATS = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '(\\|</?turn|###)', 'x\1', 'g')) - length(text) AS n_text,
    length(replace(regexp_replace(role, '(\\|</?turn|###)', 'x\1', 'g'), '"', 'x"')) AS n_role FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n_text + n_role + 22)::BIGINT AS formatted_chars, false AS rewrites_history
FROM e GROUP BY conv_id
"""


def licenses() -> str:
    """Every place of a phrase, and every block of every template."""
    phrases = ", ".join(f"({_quoted(label)}, [{', '.join(map(_quoted, phrase.split()))}])" for phrase, label in PHRASES.items())
    rows = ", ".join(f"({_quoted(label)}, [{', '.join(map(_quoted, sorted(set(_plain_words(t)))))}], {len(_plain_words(t))})" for label, t in TEMPLATES.items())
    return f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
phrase(label, p) AS (VALUES {phrases}),
template(label, words, width) AS (VALUES {rows}),
place AS (SELECT rid, label, i FROM w, phrase, unnest(range(0, len(w) - len(p) + 1)) AS t(i) WHERE w[i + 1:i + len(p)] = p),
base AS (SELECT rid, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS labels FROM place GROUP BY rid),
share AS (SELECT rid, label, len(words) AS n, len(list_intersect(words, w[a + 1:a + 2 * width])) AS k FROM w, template, unnest(range(0, greatest(1, len(w) - width), width)) AS t(a)),
met AS (SELECT rid, count(*) AS n, max(k / n) AS score, list(DISTINCT label) AS labels FROM share WHERE k >= ceil(0.8 * n - 1e-9) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a::BIGINT AS first_word, base.z::BIGINT AS last_word,
    array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(met.labels, []))), ',') AS labels,
    coalesce(met.score, CASE WHEN base.n > 0 THEN 1 ELSE 0 END)::DOUBLE AS score, coalesce(met.n, 0)::BIGINT AS n_blocks
FROM w LEFT JOIN base USING (rid) LEFT JOIN met USING (rid)
"""


LICENSES = licenses()

_FEATURES = """list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"""

#: Every feature written out, CRC-32 by its table, gains and scores in doubles, and the draw by a sort of all rows.
RESAMPLES = rf"""
WITH RECURSIVE bits(k, v, step) AS (SELECT k, k, 0 FROM range(0, 256) AS t(k) UNION ALL SELECT k, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, step + 1 FROM bits WHERE step < 8),
crc AS MATERIALIZED (SELECT k, v FROM bits WHERE step = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
f AS MATERIALIZED (SELECT rid, unnest({_FEATURES}) AS g FROM d),
e AS MATERIALIZED (SELECT unnest({_FEATURES}) AS g FROM (SELECT {_WORDS} AS w FROM benchmark)),
walk(g, h, c) AS (
    SELECT g, hex(encode(g)), 4294967295::BIGINT FROM (SELECT g FROM f UNION SELECT g FROM e)
    UNION ALL
    SELECT g, substr(h, 3), xor(c // 256, v) FROM walk JOIN crc ON k = xor(c & 255, ('0x' || substr(h, 1, 2))::BIGINT) WHERE h <> ''),
bucket AS MATERIALIZED (SELECT g, xor(c, 4294967295) % 10000 AS b FROM walk WHERE h = ''),
s AS (SELECT b, count(*) AS n FROM f JOIN bucket USING (g) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM e JOIN bucket USING (g) GROUP BY b),
gain AS (
    SELECT k AS b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM range(0, 10000) AS r(k) LEFT JOIN s ON s.b = k LEFT JOIN t ON t.b = k),
weighed AS (SELECT rid, count(*) AS n_features, sum(gain) AS weight FROM f JOIN bucket USING (g) JOIN gain USING (b) GROUP BY rid),
x AS (
    SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM d LEFT JOIN weighed USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (rid)
"""
