"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tieweave.llm import chat, decontamination, extraction, fuzzy_lines, licences, ngram_join, packing, phrases, quality, sharding, simhash_join, spelling, toxicity

QUERIES = {}
ORACLES = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op2_host_quality(spark, sf):
    return quality.judged(_read(spark, sf, "documents")).select(
        "doc_id", *quality.MEASURES, "base_failed", "kept", "rule_short", "rule_repetitive"
    )


ORACLES["op2_host_quality"] = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, source, coalesce(text, '') t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws FROM d),
m AS (SELECT rid, doc_id, source, t, len(ws) n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols FROM w),
l AS (SELECT rid, sum(c - 1) n_dup_lines FROM (
  SELECT rid, line, count(*) c FROM (SELECT rid, unnest(string_split(t, chr(10))) line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY rid),
g AS (SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) i FROM w WHERE len(ws) > 2)),
r AS (SELECT rid, count(DISTINCT p) n_repeat_words FROM (
  SELECT rid, unnest([i, i + 1, i + 2]) p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) c FROM g) WHERE c > 1) GROUP BY rid),
f AS (SELECT m.rid, doc_id, source, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words,
  n_words < 50 rule_short, 100 * coalesce(n_repeat_words, 0) > 50 * n_words rule_repetitive FROM m LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)),
h AS (SELECT source, count(*)::DOUBLE n, sum((rule_short OR rule_repetitive)::INT)::DOUBLE k FROM f GROUP BY source),
p AS (SELECT avg(k / n) m, var_pop(k / n) v, avg(1 / n) i FROM h),
q AS (SELECT m, greatest(m * (1 - m) / greatest(v - m * (1 - m) * i, 1e-6) - 1, 0) w FROM p),
s AS (SELECT source, (k + m * w) / (n + w) rate FROM h, q)
SELECT doc_id, n_words::BIGINT n_words, word_chars::BIGINT word_chars, n_symbols::BIGINT n_symbols, n_dup_lines::BIGINT n_dup_lines,
  n_repeat_words::BIGINT n_repeat_words, rule_short OR rule_repetitive AS base_failed,
  NOT (rule_short OR rule_repetitive) AND rate <= 0.5 AS kept, rule_short, rule_repetitive
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""


@_query
def op3_sharding(spark, sf):
    return sharding.sharded(_read(spark, sf, "documents"), 16)


_JUMP = """(SELECT min(b) FROM (
  WITH RECURSIVE jump(k, b, j) AS (
    SELECT ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::HUGEINT, -1::BIGINT, 0::BIGINT
    UNION ALL
    SELECT n, j, floor((j + 1) * (2147483648.0::DOUBLE / ((n // 8589934592) + 1)::DOUBLE))::BIGINT
    FROM (SELECT ((k % 4294967296) * 2862933555777941757 + ((((k // 4294967296) * 2862933555777941757) % 4294967296) * 4294967296) + 1) % 18446744073709551616 n, j
          FROM jump WHERE j < {n}))
  SELECT b FROM jump WHERE j >= {n}))"""

#: The usual table of the reflected CRC-32, from its rule: eight shift steps a byte.
_CRC_TABLE = """crc_table AS (SELECT [list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for n in range(256)] tab)"""

ORACLES["op3_sharding"] = f"""
WITH k AS (SELECT DISTINCT doc_id FROM documents),
s AS (SELECT doc_id, {_JUMP.format(n=16)}::INT shard, {_JUMP.format(n=17)}::INT grown_shard FROM k),
b AS (SELECT doc_id, coalesce(text, '') t FROM documents),
{_CRC_TABLE}
SELECT b.doc_id, strlen(t) + 1 AS size, crc AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY b.doc_id NULLS FIRST, crc, strlen(t)) - 1 AS slot, grown_shard
FROM (SELECT doc_id, t, xor(4294967295, list_reduce([('0x' || h)::BIGINT for h in regexp_extract_all(hex(t), '..')],
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) crc FROM b, crc_table) b JOIN s ON b.doc_id IS NOT DISTINCT FROM s.doc_id
"""


@_query
def op7_packing(spark, sf):
    return packing.packed_documents(_read(spark, sf, "documents"), tokenizer_path())


@_query
def op4_decontamination(spark, sf):
    return decontamination.contamination(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op4_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, {_WORDS} ws FROM documents),
b AS (SELECT item_id, {_WORDS} ws FROM benchmark),
s AS (SELECT item_id, ws, least(len(ws), 10) n FROM b WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, n, ws[k:k + n - 1] win FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) k FROM s)),
l AS (SELECT DISTINCT n FROM i),
p AS (SELECT rid, k, n, ws[k:k + n - 1] win FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) k FROM d, l WHERE len(ws) >= n)),
m AS (SELECT rid, k, p.n, item_id FROM p JOIN i USING (n, win)),
h AS (SELECT rid, count(DISTINCT w) n_hit FROM (SELECT rid, unnest(range(k, k + n)) w FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) n_items, string_agg(x, ',' ORDER BY x) names FROM (SELECT DISTINCT rid, item_id::VARCHAR x FROM m) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(names, '')) items_sha256,
  n_hit IS NOT NULL contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""


@_query
def op8_ngram_join(spark, sf):
    return ngram_join.near_copies(_read(spark, sf, "documents"))


ORACLES["op8_ngram_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 4 THEN [ws] ELSE list_distinct([ws[k:k + 3] for k in range(1, len(ws) - 2)]) END grams FROM d WHERE len(ws) > 0),
z AS (SELECT doc_id, len(grams) n, unnest(grams) g FROM s),
p AS (SELECT x.doc_id a, y.doc_id b, x.n na, y.n nb, count(*) c FROM z x JOIN z y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(len(grams), 0) n_shingles, least(d.doc_id, (SELECT min(b) FROM r WHERE r.a = d.doc_id)) component_id
FROM d LEFT JOIN s USING (doc_id)
"""


@_query
def op5_toxicity(spark, sf):
    return toxicity.toxicity(_read(spark, sf, "documents"), _read(spark, sf, "labels"))


@_query
def op6_line_dedup(spark, sf):
    return fuzzy_lines.without_fuzzy_lines(_read(spark, sf, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@_query
def op1_licence_scans(spark, sf):
    return licences.licence_report(_read(spark, sf, "documents"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATE_ROWS = ", ".join(f"({_literal(n)}, {k}, {_literal(t)})" for n in sorted(licences.TEMPLATES) for k, t in enumerate(licences.TEMPLATES[n]))
_NORMALISED = r"regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')"

ORACLES["op1_licence_scans"] = rf"""
WITH t AS (SELECT licence, k, regexp_extract_all({_NORMALISED.format('text')}, '[^ \n]+') ws FROM (VALUES {_TEMPLATE_ROWS}) v(licence, k, text)),
tb AS (SELECT licence, k, list_distinct([[ws[i], ws[i + 1]] for i in range(1, len(ws))]) grams FROM t),
d AS (SELECT row_number() OVER () rid, doc_id, {_NORMALISED.format("coalesce(text, '')")} norm FROM documents),
u AS (SELECT rid, unnest(range(len(string_split(norm, chr(10))))) line, unnest(string_split(norm, chr(10))) txt FROM d
  UNION ALL SELECT rid, NULL, norm FROM d WHERE contains(norm, chr(10))),
w AS (SELECT rid, line, regexp_extract_all(txt, '[^ \n]+') ws FROM u),
ub AS (SELECT rid, line, list_distinct([[ws[i], ws[i + 1]] for i in range(1, len(ws))]) grams FROM w WHERE len(ws) > 1),
m AS (SELECT rid, line, licence, 2.0::DOUBLE * len(list_intersect(ub.grams, tb.grams)) / (len(ub.grams) + len(tb.grams)) dice FROM ub, tb
  WHERE 1.2 * len(ub.grams) >= 0.8 * len(tb.grams) AND 1.2 * len(tb.grams) >= 0.8 * len(ub.grams)),
b AS (SELECT rid, line, licence, dice FROM m WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY rid, line ORDER BY dice DESC, licence) = 1),
p AS (SELECT rid, first(licence ORDER BY dice DESC, licence) licence, max(dice) dice, count(*) n_matches, string_agg(DISTINCT licence, ',' ORDER BY licence) licences FROM b GROUP BY rid)
SELECT doc_id, licence, dice, coalesce(n_matches, 0) n_matches, coalesce(licences, '') licences FROM d LEFT JOIN p USING (rid)
"""


@_query
def op9_preference_format(spark, sf):
    return chat.preference_turns(*chat.cut_short_pairs(_read(spark, sf, "conversations")))


ORACLES["op9_preference_format"] = """
WITH c AS (SELECT conv_id, coalesce(turn, -1) turn, role, text FROM conversations),
l AS (SELECT conv_id, coalesce(max(turn) FILTER (role = 'assistant'), max(turn)) last, max(turn) FILTER (role = 'assistant') reply FROM c GROUP BY conv_id),
h AS (SELECT c.conv_id pair_id, turn, coalesce(role, 'user') role, coalesce(text, '') chosen,
    CASE WHEN turn = reply AND role = 'assistant' THEN left(coalesce(text, ''), length(text) // 2) ELSE coalesce(text, '') END rejected
  FROM c JOIN l ON c.conv_id IS NOT DISTINCT FROM l.conv_id WHERE turn <= last),
b AS (SELECT pair_id, turn, role, text, bool_or(side = 'c') in_c, bool_or(side = 'r') in_r FROM
  (SELECT pair_id, turn, role, chosen AS text, 'c' side FROM h UNION ALL SELECT pair_id, turn, role, rejected, 'r' FROM h) GROUP BY ALL),
f AS (SELECT pair_id, min(turn) FILTER (in_c <> in_r) start FROM b GROUP BY pair_id),
r AS (SELECT b.*, unnest(CASE WHEN start IS NULL OR turn < start THEN ['prompt'] WHEN in_c AND in_r THEN ['chosen', 'rejected'] WHEN in_c THEN ['chosen'] ELSE ['rejected'] END) part
  FROM b JOIN f ON b.pair_id IS NOT DISTINCT FROM f.pair_id),
o AS (SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || chr(10) rendered, part <> 'prompt' AND role = 'assistant' learned FROM r)
SELECT pair_id, part, turn, role, rendered, length(rendered) n_chars, learned, CASE WHEN learned THEN length(role) + 5 ELSE length(rendered) END masked_chars FROM o
"""


@_query
def op10_main_text(spark, sf):
    return extraction.main_texts(_read(spark, sf, "pages"))


@_query
def op11_simhash_join(spark, sf):
    return simhash_join.near_duplicates(_read(spark, sf, "documents"))


@_query
def op12_spelling_variants(spark, sf):
    return spelling.variants(_read(spark, sf, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[A-Za-zÀ-ÿ]+')) run FROM documents),
u AS (SELECT doc_id, run, count(*) c FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, c, xor(4294967295, list_reduce([('0x' || x)::BIGINT for x in regexp_extract_all(hex(coalesce(doc_id::VARCHAR, '') || ':' || run), '..')],
    lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295::BIGINT)) h FROM u, crc_table),
s AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) less FROM (SELECT word, unnest(range(1, length(word) + 1)) i FROM w)),
p AS (SELECT a.word, b.word near FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT x.word, w.word FROM x JOIN w ON x.less = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.less = w.word),
b AS (SELECT p.word, near, w.n form_n, count(*) OVER (PARTITION BY p.word) n_near FROM p JOIN w ON w.word = near
  QUALIFY row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, near) = 1),
f AS (SELECT w.word, n, coalesce(n_near, 0) n_near, CASE WHEN form_n >= 10 * n THEN near END form, CASE WHEN form_n >= 10 * n THEN form_n END form_n FROM w LEFT JOIN b USING (word)),
c(word, last, k) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON f.word = c.last WHERE form IS NOT NULL)
SELECT f.*, root FROM f JOIN (SELECT word, arg_max(last, k) root FROM c GROUP BY word) USING (word)
"""


@_query
def op13_phrase_collocations(spark, sf):
    return phrases.collocations(_read(spark, sf, "documents"))


ORACLES["op13_phrase_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array({_FOLDED}, '[.,;:!?\x0A-\x0D]')) piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT n FROM w GROUP BY lang),
g AS (SELECT lang, ws[i:i + k - 1] g FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) i FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(ws) >= k)),
f AS (SELECT lang, g, count(*) a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, g, a FROM f WHERE len(g) > 1),
u AS (SELECT lang, g, a, k, g[:k] x, g[k + 1:] y FROM (SELECT *, unnest(range(1, len(g))) k FROM c)),
s AS (SELECT u.lang, u.g, u.a, k, x.a l, y.a r, (2000000::HUGEINT * u.a // (x.a::HUGEINT + y.a))::BIGINT score
  FROM u JOIN f x ON x.lang = u.lang AND x.g = u.x JOIN f y ON y.lang = u.lang AND y.g = u.y QUALIFY row_number() OVER (PARTITION BY u.lang, u.g ORDER BY score, k) = 1),
i AS (SELECT lang, g[i:i + m - 1] part, max(a) around FROM (SELECT lang, g, a, m, unnest(range(1, len(g) - m + 2)) i FROM c, (VALUES (2), (3)) v(m) WHERE len(g) > m) GROUP BY ALL),
o AS (SELECT s.lang, array_to_string(s.g, ' ') phrase, a, l, r, score FROM s LEFT JOIN i ON i.lang = s.lang AND i.part = s.g WHERE around IS NULL OR 100 * around::HUGEINT < 80 * a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o JOIN t USING (lang) QUALIFY rank <= 2000
"""
