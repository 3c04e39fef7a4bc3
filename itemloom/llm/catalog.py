"""Registered queries of the pipeline operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm import audit, bpe, chat, exact, jaccard, lines, mixing, passages, quality_rules, resample, shards, spelling, urls
from itemloom.llm.store import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "kept"
    )


@query("op4_byte_level_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, columns=("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op6_exact_dedup", """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


# CRC-32 byte by byte with the usual table of 256 remainders
_CRC = """
WITH RECURSIVE r(n, k, c) AS (SELECT n, 0, n FROM range(256) t(n) UNION ALL
  SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM r WHERE k < 8),
t AS (SELECT list(c ORDER BY n) AS rest FROM r WHERE k = 8)"""


@query("op7_sharding", _CRC + """,
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, length(h) // 2 + 1 AS size, xor(list_reduce(list_transform(range(length(h) // 2),
    lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
  lambda c, x: xor(c >> 8, rest[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM b, t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM s),
k AS (SELECT *, CAST(least(15, (2 * start + size) * 16 // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM k""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.byte_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op10_ngram_jaccard_join", """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS grams FROM w),
e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * common >= 90 * (nx + ny - common)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, c.component_id FROM s
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1) c USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard.near_duplicates(docs, n=3, percent=90).select("doc_id", "n_shingles", "component_id")


# Twenty rounds of raking over the cells, then the scale: the fewest cells taken whole such that no other one passes 1
_MIX = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, chr(1)) AS source, coalesce(lang, chr(1)) AS lang,
  CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN contains(text, 'ights reserved') OR contains(text, 'icense') THEN 'legal'
    WHEN contains(text, '@') OR contains(text, '+1 (') THEN 'contact' WHEN contains(text, ' | ') THEN 'table'
    WHEN contains(text, '?') THEN 'questions' ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
s AS (SELECT source, pow(sum(n), 0.7) AS r FROM c GROUP BY 1), l AS (SELECT lang, pow(sum(n), 0.7) AS r FROM c GROUP BY 1),
t AS (SELECT topic, pow(sum(n), 0.8) AS r FROM c GROUP BY 1), a AS (SELECT sum(n) AS n FROM c),
b AS (SELECT c.*, a.n * s.r / (SELECT sum(r) FROM s) AS ts, a.n * l.r / (SELECT sum(r) FROM l) AS tl,
  a.n * t.r / (SELECT sum(r) FROM t) AS tt FROM c JOIN s USING (source) JOIN l USING (lang) JOIN t USING (topic), a),
i(k, source, lang, topic, n, ts, tl, tt, w) AS (SELECT 0, *, n FROM b UNION ALL
  SELECT k + 1, source, lang, topic, n, ts, tl, tt, w * tt / sum(w) OVER (PARTITION BY topic) FROM (
    SELECT * REPLACE (w * tl / sum(w) OVER (PARTITION BY lang) AS w) FROM (
      SELECT * REPLACE (w * ts / sum(w) OVER (PARTITION BY source) AS w) FROM i WHERE k < 20))),
f AS (SELECT source, lang, topic, n, w, w / n AS f, row_number() OVER (ORDER BY w / n DESC) AS k FROM i WHERE k = 20),
g AS (SELECT *, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS whole,
  sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM f),
z AS (SELECT (0.8 * a.n - whole) / rest AS scale FROM g, a WHERE (0.8 * a.n - whole) / rest * f < 1 ORDER BY k LIMIT 1),
o AS (SELECT source, lang, topic, least(1, f * scale) AS probability FROM f, z)
SELECT doc_id, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(coalesce(probability, 0), 6) AS probability,
CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 < coalesce(probability, 0) AS kept
FROM d LEFT JOIN o USING (source, lang, topic)"""


@query("op1_mixing", _MIX)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_probability", 6).alias("probability"), F.col("mix_taken").alias("kept"),
    )


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _url_sql() -> str:
    """The models level by level: contexts of no, one, two and three symbols."""
    levels = ["l0 AS (SELECT 1 / 33.0::DOUBLE AS py, 1 / 33.0::DOUBLE AS pn)"]
    for k in (1, 2, 3, 4):
        below = "JOIN l0 ON true" if k == 1 else f"JOIN l{k - 1} b ON b.g = substr(o.g, 2)"
        p = ", ".join(
            f"CASE WHEN n{s} = 0 THEN p{s} ELSE (c{s} + t{s} * p{s}) / (n{s} + t{s}) END AS p{s}" for s in "yn"
        )
        levels.append(f"""o{k} AS (SELECT g, cy, cn, sum(cy) OVER c AS ny, sum((cy > 0)::INT) OVER c AS ty, sum(cn) OVER c AS nn,
  sum((cn > 0)::INT) OVER c AS tn FROM (SELECT substr(gram, {5 - k}) AS g, sum(y) AS cy, sum(n) AS cn FROM c4 GROUP BY 1)
  WINDOW c AS (PARTITION BY substr(g, 1, {k - 1}))), l{k} AS (SELECT o.g, {p} FROM o{k} o {below})""")
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
q AS (SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE WHEN ('.' || host).ends_with('.example.net') AND path.starts_with('/en/') THEN 'example.net/en/'
  WHEN ('.' || host).ends_with('.example.com') AND path.starts_with('/de/') THEN 'example.com/de/'
  WHEN ('.' || host).ends_with('.org') AND path.starts_with('/fr/') THEN 'org/fr/'
  WHEN ('.' || host).ends_with('.net') AND path.starts_with('/') THEN 'net/' END AS rule FROM q),
m AS (SELECT row_number() OVER () AS row_no, page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS side,
  substr(md5(host), 1, 1) IN ('0', '1', '2') AS held,
  regexp_replace(regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
    '[=&%_~+:;,#@!]', '?', 'g'), '[^a-z0./?\\-]', '*', 'g') AS marks FROM r),
x AS MATERIALIZED (SELECT row_no, side, held, length(marks) AS len, substr('^^^' || marks, i, 4) AS gram FROM (
  SELECT *, unnest(range(1, length(marks) + 1)) AS i FROM m)),
c4 AS MATERIALIZED (SELECT gram, count(*) FILTER (side = 'allow' AND NOT held) AS y, count(*) FILTER (side = 'block' AND NOT held) AS n FROM x GROUP BY 1),
{", ".join(levels)},
s AS (SELECT row_no, sum(ln(py) - ln(pn)) / max(len) AS score FROM x JOIN l4 ON l4.g = x.gram GROUP BY 1),
j AS MATERIALIZED (SELECT m.*, score FROM m LEFT JOIN s USING (row_no)),
b AS (SELECT least(greatest(floor((score + 5) / 0.02), 0), 500) AS step, count(*) FILTER (side = 'allow') AS y, count(*) FILTER (side = 'block') AS n
  FROM j WHERE held AND side IS NOT NULL AND score IS NOT NULL GROUP BY 1),
e AS (SELECT step, coalesce(lag(step) OVER (ORDER BY step) + 1, step) AS low, round(coalesce(sum(y) OVER w, 0) / sum(y) OVER () + 1 - coalesce(sum(n) OVER w, 0) / sum(n) OVER (), 9) AS error FROM b
  WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT CASE WHEN error IS NULL THEN 0 ELSE (low + step) / 2 * 0.02 - 5 END AS cut FROM e ORDER BY error, low - step, step LIMIT 1)
SELECT page_id, host, path, rule, coalesce(side, CASE WHEN score < (SELECT cut FROM k) THEN 'block' ELSE 'allow' END) AS verdict FROM j"""


@query("op9_url_filters", _url_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    trusted, rejected = labels.filter("quality = 1 AND toxic = 0").select("doc_id"), labels.filter("quality = 0 OR toxic = 1").select("doc_id")
    return resample.resampled(table(spark, sf_dir, "documents"), trusted, rejected=rejected)


def _transcripts(conversations: DataFrame) -> DataFrame:
    """Lines of every conversation. By md5 of conversation and turn, a turn's first line has one of four markers or none."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "conv_id", "turn")), 1, 2), 16, 10).cast("int") % 8
    names = {"system": ["System", "Instructions"], "user": ["User", "Human", "Q", "Customer"], "assistant": ["Assistant", "AI", "Bot", "A"]}
    mark = F.lit("")
    for role, words in names.items():
        chosen = F.element_at(F.array(*[F.lit(f"{words[i % len(words)]}: ") for i in range(8)]), h + 1)
        mark = F.when((F.col("role") == role) & (h < 6), chosen).otherwise(mark)
    lines = conversations.select("conv_id", "turn", F.col("role").alias("true_role"), mark.alias("mark"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("nth", "line"))
    return lines.select("conv_id", "turn", "nth", "true_role", (F.col("nth") == 0).alias("true_opens"), F.when(F.col("nth") == 0, F.concat("mark", "line")).otherwise(F.col("line")).alias("line"))


@query("op8_chat_formatting")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _transcripts(table(spark, sf_dir, "conversations"))
    seen = chat.observed(lines, "conv_id", ["turn", "nth"], "line", "true_role", "true_opens")
    model = chat.fitted(seen, "true_role", "true_opens", 200_000)
    return chat.formatted(seen, model, "true_role").withColumnRenamed("id", "conv_id")


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


_BITS = "ABCDE"
_ORDERED = " AND ".join(f"{a}.letter <> {b}.letter" for i, a in enumerate("pqrst") for b in "pqrst"[:i])
_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN low < doc_id THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
b(letter, bit) AS (VALUES {", ".join(f"('{x}', {1 << i})" for i, x in enumerate(_BITS))}),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order FROM b p, b q, b r, b s, b t WHERE {_ORDERED}),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter FROM o, (VALUES (1), (2), (3), (4), (5)) v(step)),
e AS (SELECT s.filter_order, s.step, s.letter, any_value(own.bit) AS bit, coalesce(sum(b.bit) FILTER (instr(s.filter_order, b.letter) < s.step), 0) AS before
  FROM s JOIN b own ON own.letter = s.letter JOIN b ON true GROUP BY 1, 2, 3),
g AS (SELECT part, filter_order, step, letter,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c CROSS JOIN (SELECT filter_order, step, letter, CAST(bit AS BIGINT) AS bit, CAST(before AS BIGINT) AS before FROM e) e GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g"""


@query("op11_filter_audit", _AUDIT)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Near words share what is left of them without the letter at one place, or one is what is left of the other.
_SPELLING = _CRC + """,
a AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
q AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM a WHERE length(run) >= 7 GROUP BY 1, 2),
c AS (SELECT run, n, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
  lambda c, x: xor(c >> 8, rest[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS crc FROM q, t),
k AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, CAST(crc % length(run) AS INTEGER)) || substr(run, CAST(crc % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM c),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
y AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, x.word, x.n FROM v JOIN x ON v.word = x.less UNION SELECT x.word, v.word, v.n FROM v JOIN x ON v.word = x.less),
z AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM y),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN z ON z.word = v.word AND z.place = 1),
g(word, step, last) AS (SELECT word, 0, word FROM f UNION ALL SELECT g.word, g.step + 1, f.form FROM g JOIN f ON f.word = g.last WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(last, step) AS root FROM g GROUP BY 1)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, f.form_n, e.root FROM f JOIN e ON e.word = f.word"""


@query("op12_spelling_variants", _SPELLING)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.counted_words(table(spark, sf_dir, "documents"), changed=spelling.lost_letter)
    return spelling.grouped(words.filter("n >= 2"), times=10)


@query("op13_line_dedup", """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key AS lost, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
s AS (SELECT k.*, lost IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN g ON key = lost)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM s GROUP BY r, doc_id""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.deduped(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
