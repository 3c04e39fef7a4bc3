"""Queries for quality checks, joins, duplicates, splitting, curation, sources and text boxes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from itemloom import CHOICES
from itemloom.catalog import views
from itemloom.catalog.base import query, table
from itemloom.catalog.profile_queries import NORM, TYPE1, TYPE2, r6, rounded
from itemloom.functions import answers as an, hashing as hs, rules, text as tx
from itemloom.operators import curation as cu, dedup as dd, ocr, ordering, profile as pf, prompts as pm, quality as qc, splitting as sp
from itemloom.session import ensure_checkpoint_dir
from itemloom.sources import readers as rd, schema as sc

SPLITS = ["train", "test", "dev"]


# ---- projections --------------------------------------------------------------------------------------------------

RAW_ANSWER = """CASE doc_id % 7 WHEN 0 THEN upper(substring('abcd',CAST(1+doc_id%4 AS INT),1)) WHEN 1 THEN concat('(',substring('abcd',CAST(1+doc_id%4 AS INT),1),')')
  WHEN 2 THEN CAST(1+doc_id%4 AS STRING) WHEN 3 THEN trim(substring(text,83,6)) WHEN 4 THEN ' ' WHEN 5 THEN 'nan' ELSE 'b ' END"""
WS = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
STD = f"""raw AS (SELECT i.*, {RAW_ANSWER.replace('STRING', 'VARCHAR')} AS raw FROM items i JOIN documents ON doc_id=pos),
o AS (SELECT id, path, question, pos, {', '.join(WS.format(c=c) + f' AS {c}' for c in CHOICES)}, {WS.format(c='raw')} AS s FROM raw),
std AS (SELECT * FROM (SELECT *, CASE WHEN s='' OR lower(s)='nan' THEN NULL WHEN regexp_matches(lower(s),'^\\(?[abcd]\\)?$') THEN regexp_extract(lower(s),'[abcd]')
  WHEN s IN ('1','2','3','4') THEN substring('abcd',CAST(s AS INT),1) WHEN s=a THEN 'a' WHEN s=b THEN 'b' WHEN s=c THEN 'c' WHEN s=d THEN 'd' END AS answer FROM o))"""


def raw_items(spark, sf):
    raw = table(spark, sf, "documents").selectExpr("doc_id AS pos", f"{RAW_ANSWER} AS Answer")
    return views.items(spark, sf).drop("answer").join(raw, "pos").select(
        F.col("id").alias("ID"), F.col("path").alias("image_path"), F.col("question").alias("query"),
        *[F.col(c).alias(f"option_{c}") for c in CHOICES], "Answer", "pos",
    )


@query("prj2_standardize", f"WITH {STD} SELECT id, path, question, a, b, c, d, answer, {TYPE2} AS qtype FROM std WHERE answer IS NOT NULL", ("items",))
def prj2(spark, sf):
    return sc.standardize(raw_items(spark, sf))


@query("prj1_detect_columns", f"WITH {STD} SELECT id, question, a FROM std", ("items",))
def prj1(spark, sf):
    return sc.standardize(raw_items(spark, sf), labelled=False).select("id", "question", "a")


@query("prj3_normalize_answer", f"WITH {STD} SELECT id, answer FROM std", ("items",))
def prj3(spark, sf):
    raw = raw_items(spark, sf)
    return raw.select(F.col("ID").alias("id"), an.normalize_answer(F.col("Answer"), [F.col(f"option_{c}") for c in CHOICES]).alias("answer"))


@query("prj4_label_domain", "SELECT count(*) FILTER (s IS NULL OR s NOT IN ('a','b','c','d')) AS bad_labels FROM (SELECT CASE WHEN pos%9=0 THEN 'e' WHEN pos%11=0 THEN NULL ELSE answer END AS s FROM items)", ("items",))
def prj4(spark, sf):
    it = qc.require_columns(views.items(spark, sf), ["id", "question", *CHOICES, "answer"], "items")
    return qc.label_violations(it.withColumn("answer", F.expr("CASE WHEN pos%9=0 THEN 'e' WHEN pos%11=0 THEN NULL ELSE answer END")))


@query("prj5_stem_key", "SELECT page_id, lower(regexp_replace(regexp_extract(url,'([^/]*)/*$',1), '^(.+)\\.[^.]+$', '\\1')) AS key FROM pages")
def prj5(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.stem_key(F.col("url")).alias("key"))


FILES = """files AS (SELECT concat('root1/train/doc_', doc_id, '.txt') AS path FROM documents WHERE doc_id%3=0
  UNION ALL SELECT concat('root2/docs/doc_', doc_id, '.txt') FROM documents WHERE doc_id%5=0 UNION ALL SELECT concat('root1/docs/doc_', doc_id, '.txt') FROM documents WHERE doc_id%7=0)"""
RESOLVED = f"""{FILES}, r AS (SELECT i.id, i.path, CASE WHEN pos%7=0 THEN concat('root1/docs/doc_',pos,'.txt') WHEN pos%3=0 THEN concat('root1/train/doc_',pos,'.txt')
  WHEN pos%5=0 THEN concat('root2/docs/doc_',pos,'.txt') ELSE '' END AS resolved FROM items i)"""


def _files(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    def under(prefix, k):
        return docs.filter(F.col("doc_id") % k == 0).select(F.concat(F.lit(prefix), name).alias("path"))
    return under("root1/train/", 3).unionByName(under("root2/docs/", 5)).unionByName(under("root1/docs/", 7))


@query("prj6_resolve_paths", f"WITH {RESOLVED} SELECT id, resolved FROM r", ("items",))
def prj6(spark, sf):
    return sc.resolve_paths(views.items(spark, sf), _files(spark, sf), ["root1", "root2"]).select("id", "resolved")


def _prompt_sql():
    hints = "CASE " + TYPE2 + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.PROMPT_HINTS.items()) + " END"
    ocr_text = "CASE WHEN pos%2=0 THEN " + WS.format(c="txt") + " ELSE '' END"
    return f"""SELECT id, concat('{pm.QUESTION_LEAD}', {WS.format(c='question')}, '\n\n{pm.HINT_TITLE}\n- ', {hints},
      CASE WHEN {ocr_text}<>'' THEN concat('\n\n{pm.OCR_TITLE}\n', {ocr_text}) ELSE '' END,
      '\n\n(a) ',a,'\n(b) ',b,'\n(c) ',c,'\n(d) ',d,'\n\n{pm.INSTRUCTION}') AS prompt FROM (SELECT k.*, text AS txt FROM kitems k JOIN documents ON doc_id=pos)"""


@query("prj10_prompt_text", _prompt_sql(), ("kitems",))
def prj10(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text")
    t = views.korean_items(spark, sf).join(docs, "pos")
    ocr_text = F.when(F.col("pos") % 2 == 0, F.col("text")).otherwise("")
    return t.select("id", pm.user_prompt(F.col("question"), [F.col(c) for c in CHOICES], ocr_text).alias("prompt"))


BODY = "concat(question,'\n(a) ',a,'\n(b) ',b,'\n(c) ',c,'\n(d) ',d,'\n\n','Answer with one letter.')"


@query("prj11_repeated_body", f"SELECT id, concat({BODY},'\n---\n',{BODY},'\n---\n',{BODY}) AS body FROM items", ("items",))
def prj11(spark, sf):
    body = pm.plain_body(F.col("question"), [F.col(c) for c in CHOICES], "Answer with one letter.")
    return views.items(spark, sf).select("id", pm.repeat_body(body, 3, "\n---\n").alias("body"))


@query("prj14_chat_records", f"""SELECT id, 0 AS k, 'system' AS role, '{pm.SYSTEM_TEXT}' AS content FROM items UNION ALL
  SELECT id, 1, 'user', concat('{pm.EXTRA_VIEWS.format(n=4)}', {BODY}) FROM items UNION ALL SELECT id, 2, 'assistant', answer FROM items""", ("items",))
def prj14(spark, sf):
    body = pm.plain_body(F.col("question"), [F.col(c) for c in CHOICES], "Answer with one letter.")
    record = pm.chat_record(pm.view_note(body, 5), answer=F.col("answer"))
    return views.items(spark, sf).select("id", F.posexplode(record).alias("k", "m")).select("id", "k", "m.role", "m.content")


# ---- checks -------------------------------------------------------------------------------------------------------

@query("qc1_missing_counts", "SELECT * FROM (VALUES ('item_id'),('annotator'),('vote'),('ts')) c(\"column\") JOIN LATERAL (SELECT count(*) FILTER (CASE c.\"column\" WHEN 'vote' THEN vote IS NULL ELSE FALSE END) AS missing FROM votes) ON TRUE", ("votes",))
def qc1(spark, sf):
    return qc.missing_counts(views.votes(spark, sf))


@query("qc2_blank_counts", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({WS.format(c=f'coalesce({c},chr(32))')}='') AS blank FROM items" for c in ("question", *CHOICES)), ("items",))
def qc2(spark, sf):
    return qc.blank_counts(views.items(spark, sf), ["question", *CHOICES])


@query("qc3_duplicate_ids", "SELECT (count(*) - count(DISTINCT l_orderkey))::BIGINT AS duplicate_ids FROM lineitem")
def qc3(spark, sf):
    return qc.duplicate_ids(table(spark, sf, "lineitem"), "l_orderkey")


@query("qc5_dataset_contract", f"""SELECT count(*) FILTER (answer='d') AS bad_labels, {', '.join(f"count(*) FILTER ({WS.format(c=c)}='') AS blank_{c}" for c in CHOICES)}, (count(*)-count(DISTINCT source))::BIGINT AS duplicate_ids FROM items""", ("items",))
def qc5(spark, sf):
    it = views.items(spark, sf).withColumns({"answer": F.expr("CASE WHEN answer='d' THEN 'x' ELSE answer END"), "id": F.col("source")})
    return qc.contract_counts(it)


@query("qc6_key_sets", """WITH a AS (SELECT DISTINCT doc_id AS k FROM labels), b AS (SELECT DISTINCT doc_id AS k FROM documents), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k=b.k)
SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS common, count(*) FILTER (y IS NULL) AS only_left, count(*) FILTER (x IS NULL) AS only_right,
  count(*) FILTER (x IS NOT NULL AND y IS NOT NULL)=0 AS disjoint, count(*) FILTER (x IS NULL OR y IS NULL)=0 AS equal FROM j""")
def qc6(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return qc.key_set_comparison(table(spark, sf, "labels").select("doc_id"), docs, "doc_id")


EXT = """ext AS (SELECT *, CASE WHEN o_a IS NULL OR o_a IN ('','nan','None') OR o_b IN ('','nan','None') OR o_c IN ('','nan','None') OR o_d IN ('','nan','None') THEN 'missing_option' WHEN ans NOT IN ('A','B','C','D') THEN 'bad_answer'
  WHEN len(list_distinct([o_a,o_b,o_c,o_d]))<4 THEN 'duplicate_option' END AS reason FROM (
  SELECT pos, id, {t}, CASE WHEN pos%13=0 THEN 'E' ELSE upper(answer) END AS ans FROM items))""".format(
    t=", ".join(f"{WS.format(c=c)} AS o_{c}" for c in "bcd") + ", CASE WHEN pos%17=0 THEN NULL WHEN pos%19=0 THEN " + WS.format(c="b") + " ELSE " + WS.format(c="a") + " END AS o_a")


def external_rows(spark, sf):
    return views.items(spark, sf).select(
        "pos", "id", "question", F.expr("CASE WHEN pos%17=0 THEN NULL WHEN pos%19=0 THEN b ELSE a END").alias("A"),
        F.col("b").alias("B"), F.col("c").alias("C"), F.col("d").alias("D"),
        F.expr("CASE WHEN pos%13=0 THEN 'E' ELSE answer END").alias("answer"),
    )


@query("qc7_external_rejections", f"WITH {EXT} SELECT coalesce(reason,'kept') AS reason, count(*) AS n FROM ext GROUP BY 1", ("items",))
def qc7(spark, sf):
    t = qc.external_rejections(external_rows(spark, sf))
    return t.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("src7_external_items", f"WITH {EXT} SELECT concat('ext_', id) AS id, {WS.format(c='question')} AS question, o_a AS a, o_b AS b, o_c AS c, o_d AS d, lower(ans) AS answer, octet_length(encode(question)) AS bytes FROM ext JOIN items USING (pos, id) WHERE reason IS NULL", ("items",))
def src7(spark, sf):
    rows = external_rows(spark, sf).withColumns({
        "rid": tx.safe_name(F.col("id")),
        "image": F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("question", "UTF-8"))),
    })
    kept = rd.external_items(qc.external_rejections(rows).filter("reason IS NULL"), "ext")
    return kept.select("id", "question", *CHOICES, "answer", F.octet_length("content").alias("bytes"))


@query("qc8_unique_ids", """SELECT pos, concat(base, repeat('_', CAST(row_number() OVER (PARTITION BY base ORDER BY pos) - 1 AS INT))) AS rid FROM (
  SELECT doc_id AS pos, concat(source, '-', lang, '-x') AS base FROM (SELECT doc_id, lang, regexp_replace(source,'[^0-9A-Za-z_\\-]','_','g') AS source FROM documents))""")
def qc8(spark, sf):
    named = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"), tx.safe_name(F.concat(F.col("source"), F.lit("-"), F.col("lang"), F.lit("-x"))).alias("base")
    )
    return cu.unique_ids(named, "base").select("pos", "rid")


KEY = "lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
QAF = f"""q AS (SELECT *, {KEY.format(c='answer_text')} AS norm, concat(img_id,'_',k) AS rowkey, regexp_matches(answer_text,'[0-9]') AS digit FROM qa
  WHERE length(question)>0 AND length(answer_text)>0 AND length(answer_text)<=1200 AND length({KEY.format(c='answer_text')})>0)"""


@query("qc9_free_form_filter", f"WITH {QAF} SELECT img_id, k, norm FROM q", ("qa",))
def qc9(spark, sf):
    return qc.free_form_filter(views.qa(spark, sf), 1200).select("img_id", "k", "norm")


@query("qc13_metric_completeness", "SELECT * FROM (VALUES ('quality'),('toxic')) c(\"column\") JOIN LATERAL (SELECT count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id) ON TRUE")
def qc13(spark, sf):
    labels = table(spark, sf, "labels").withColumn("hue", F.lit(None).cast("double"))
    return qc.metric_completeness(table(spark, sf, "documents").select("doc_id"), labels, ["doc_id"], exempt=["hue"])


# ---- joins and sets -----------------------------------------------------------------------------------------------

@query("jn1_left_join_metrics", f"SELECT i.split, i.id, length(question) AS question_chars, quality, toxic FROM items i LEFT JOIN labels l ON l.doc_id=i.pos", ("items",))
def jn1(spark, sf):
    metrics = pf.text_metrics(views.items(spark, sf))
    labels = table(spark, sf, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), "quality", "toxic")
    return metrics.join(labels, "id", "left").select("split", "id", "question_chars", "quality", "toxic")


CROSS = """c AS (SELECT near_key, question, count(*) FILTER (split='train') AS l, count(*) FILTER (split='test') AS r FROM docgroups GROUP BY 1,2)"""


@query("jn2_cross_split_pairs", f"WITH {CROSS} SELECT near_key, sum(l)::BIGINT AS n_train, sum(r)::BIGINT AS n_test, (sum(l)*sum(r))::BIGINT AS pairs, sum(l*r)::BIGINT AS equal_question_pairs FROM c GROUP BY 1 HAVING sum(l)*sum(r)>0", ("docgroups",))
def jn2(spark, sf):
    return dd.cross_split_pairs(views.docgroups(spark, sf), "near_key", "split", "train", "test")


@query("jn2_cross_split_links", """WITH t AS (SELECT sha, arg_min(id,pos) AS fid, count(*) AS n FROM docgroups WHERE split='train' GROUP BY 1), s AS (SELECT sha, arg_min(id,pos) AS fid, count(*) AS n FROM docgroups WHERE split='test' GROUP BY 1)
SELECT g.sha, g.split, g.id, g.path, g.question, CASE g.split WHEN 'train' THEN s.fid ELSE t.fid END AS partner_id, CASE g.split WHEN 'train' THEN s.n ELSE t.n END AS partners
FROM docgroups g JOIN t ON t.sha=g.sha JOIN s ON s.sha=g.sha WHERE g.split IN ('train','test')""", ("docgroups",))
def jn2_links(spark, sf):
    return dd.cross_split_links(views.docgroups(spark, sf), "sha", "split", "train", "test", columns=["path", "question"])


# Equal texts of a split are one entry, standing at their first row.
HAM = """e AS (SELECT split, phash, sha, min(pos) AS pos, arg_min(id, pos) AS id, any_value(brightness) AS brightness, count(*) AS copies FROM hashes GROUP BY 1, 2, 3),
p AS (SELECT concat(l.split,'-',r.split) AS scope, bit_count(xor(l.phash,r.phash))::INT AS hamming_distance, l.id AS left_id, r.id AS right_id, abs(l.brightness-r.brightness) AS brightness_difference,
  l.copies AS left_copies, r.copies AS right_copies, l.pos AS lp, r.pos AS rp
  FROM e l JOIN e r ON l.sha<>r.sha AND ((l.split=r.split AND l.pos<r.pos) OR (l.split='train' AND r.split='test')) WHERE bit_count(xor(l.phash,r.phash))<=6)"""


@query("jn3_hamming_pairs", f"WITH {HAM} SELECT scope, hamming_distance, left_id, right_id, left_copies, right_copies, brightness_difference FROM p ORDER BY hamming_distance, scope, lp, rp LIMIT 1000", ("hashes",))
def jn3(spark, sf):
    near = dd.similar_pairs(views.hashes(spark, sf), "phash", "sha", "split", "train", "test", columns=["id", "brightness"])
    return near.select("scope", "hamming_distance", "left_id", "right_id", "left_copies", "right_copies", F.abs(F.col("left_brightness") - F.col("right_brightness")).alias("brightness_difference"))


@query("so1_multi_key_top", f"WITH {HAM} SELECT scope, hamming_distance, left_id, right_id FROM p ORDER BY hamming_distance, scope, lp, rp LIMIT 40", ("hashes",))
def so1(spark, sf):
    near = dd.similar_pairs(views.hashes(spark, sf), "phash", "sha", "split", "train", "test", keep=40, columns=["id"])
    return near.select("scope", "hamming_distance", "left_id", "right_id")


@query("jn6_audit_merge", "SELECT id, quality FROM items LEFT JOIN labels ON doc_id=pos", ("items",))
def jn6(spark, sf):
    audit = table(spark, sf, "labels").select(F.concat(F.lit("docs/DOC_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("id"), "quality")
    return cu.audit_merge(views.items(spark, sf), audit).select("id", "quality")


def held_out(spark, sf):
    return views.items(spark, sf).filter("split = 'dev'").select("id", F.col("source").alias("img"))


def incoming(spark, sf):
    """Documents with an image column and, for some, a source id pointing at another row."""
    return views.items(spark, sf).select(
        "id", "pos", F.expr("CASE WHEN pos%3=0 THEN concat('docs/DOC_', pos+1, '.txt') END").alias("source_id"),
        F.when(F.col("pos") % 2 == 0, F.col("id")).otherwise(F.col("source")).alias("img"),
    )


LEAK = """h AS (SELECT id, source AS img FROM items WHERE split='dev'),
i AS (SELECT id, pos, CASE WHEN pos%3=0 THEN concat('doc_', pos+1) ELSE id END AS key, CASE WHEN pos%2=0 THEN id ELSE source END AS img FROM items),
f AS (SELECT *, key IN (SELECT id FROM h) AS by_id, img IN (SELECT img FROM h) AS by_img FROM i)"""


@query("jn7_leakage_anti_join", f"WITH {LEAK} SELECT id FROM f WHERE NOT by_id AND NOT by_img", ("items",))
def jn7(spark, sf):
    return cu.drop_leakage(incoming(spark, sf), held_out(spark, sf)).select("id")


@query("jn7_leakage_report", f"WITH {LEAK} SELECT count(*) AS rows, count(*) FILTER (by_id) AS by_id, count(*) FILTER (by_img) AS by_image, count(*) FILTER (by_id OR by_img) AS dropped FROM f", ("items",))
def jn7_report(spark, sf):
    return cu.leakage_report(incoming(spark, sf), held_out(spark, sf))


@query("jn8_listed_rows", "SELECT id FROM items WHERE id IN (SELECT id FROM edits WHERE action='mark_hard')", ("edits",))
def jn8(spark, sf):
    return cu.keep_listed(views.items(spark, sf), cu.listed_keys(views.edits(spark, sf), "mark_hard")).select("id")


@query("jn9_reference_disagreement", "SELECT count(*) FILTER (answer<>n) AS differ, count(*) AS listed FROM (SELECT answer, CASE WHEN toxic=1 THEN 'a' ELSE 'b' END AS n FROM items JOIN labels ON doc_id=pos)", ("items",))
def jn9(spark, sf):
    notes = table(spark, sf, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.expr("CASE WHEN toxic=1 THEN ' A' ELSE 'b' END").alias("answer"))
    return cu.reference_disagreement(views.items(spark, sf), notes)


OV = "WITH k AS (SELECT 'question' AS kind, split, {q} AS key FROM items UNION ALL SELECT 'problem', split, concat_ws(' || ',{p}) FROM items) SELECT kind, count(*) FILTER (l=1 AND r=1) AS shared FROM (SELECT kind, key, max((split='train')::INT) AS l, max((split='test')::INT) AS r FROM k WHERE split<>'dev' GROUP BY 1,2) GROUP BY 1".format(
    q=NORM.format(c="question"), p=",".join(NORM.format(c=c) for c in ("question", *CHOICES)))


@query("jn11_text_overlap", OV, ("items",))
def jn11(spark, sf):
    t = pf.normalize_columns(views.items(spark, sf))
    keys = {"question": F.col("question_norm"), "problem": tx.problem_signature("question_norm", [f"{c}_norm" for c in CHOICES])}
    return qc.text_overlap(t, "split", "train", "test", keys).select("kind", F.col("shared").cast("long").alias("shared"))


@query("jn12_image_hash_overlap", """SELECT (SELECT count(*) FROM (SELECT sha FROM docgroups WHERE split='train' INTERSECT SELECT sha FROM docgroups WHERE split='test')) AS identical_in_both,
  count(DISTINCT sha) FILTER (split='train') AS unique_train, count(DISTINCT sha) FILTER (split='test') AS unique_test,
  round(count(*) FILTER (split='train')/count(DISTINCT sha) FILTER (split='train'),6) AS per_image_train, round(count(*) FILTER (split='test')/count(DISTINCT sha) FILTER (split='test'),6) AS per_image_test FROM docgroups""", ("docgroups",))
def jn12(spark, sf):
    per = views.docgroups(spark, sf).groupBy("sha").agg(F.count_if(F.col("split") == "train").alias("l"), F.count_if(F.col("split") == "test").alias("r"))
    return per.agg(
        F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("identical_in_both"), F.count_if(F.col("l") > 0).alias("unique_train"),
        F.count_if(F.col("r") > 0).alias("unique_test"), F.round(F.sum("l") / F.count_if(F.col("l") > 0), 6).alias("per_image_train"),
        F.round(F.sum("r") / F.count_if(F.col("r") > 0), 6).alias("per_image_test"),
    )


@query("st1_union_parts", "SELECT id, split AS part FROM items UNION ALL SELECT concat(id,'__rev'), 'copy' FROM items WHERE split='dev'", ("items",))
def st1(spark, sf):
    it = views.items(spark, sf).select("id", "split")
    parts = [it.filter(F.col("split") == s) for s in ("train", "test", "dev")]
    copies = parts[2].select(F.concat("id", F.lit("__rev")).alias("id"), F.lit("copy").alias("split"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(copies).select("id", F.col("split").alias("part"))


@query("st2_distinct_first", "SELECT pos, near_key, id FROM (SELECT *, row_number() OVER (PARTITION BY near_key ORDER BY pos) AS rn FROM docgroups) WHERE rn=1", ("docgroups",))
def st2(spark, sf):
    return dd.keep_first(views.docgroups(spark, sf).select("pos", "near_key", "id"), "near_key")


@query("st3_set_operations", "SELECT 'both' AS part, count(*) AS n FROM (SELECT near_key FROM docgroups WHERE split='train' INTERSECT SELECT near_key FROM docgroups WHERE split='test') UNION ALL SELECT 'train_only', count(*) FROM (SELECT near_key FROM docgroups WHERE split='train' EXCEPT SELECT near_key FROM docgroups WHERE split='test')", ("docgroups",))
def st3(spark, sf):
    g = views.docgroups(spark, sf)
    a, b = g.filter("split = 'train'").select("near_key"), g.filter("split = 'test'").select("near_key")
    both = a.intersect(b).agg(F.lit("both").alias("part"), F.count("*").alias("n"))
    return both.unionByName(a.subtract(b).agg(F.lit("train_only").alias("part"), F.count("*").alias("n")))


# ---- duplicates and splitting -------------------------------------------------------------------------------------

GROUPS = """g AS (SELECT near_key, count(*) AS count, min(pos) AS first_pos, count(*) FILTER (split='train') AS n_train, count(*) FILTER (split='test') AS n_test, count(*) FILTER (split='dev') AS n_dev FROM docgroups GROUP BY 1 HAVING count(*)>1),
gg AS (SELECT *, row_number() OVER (ORDER BY first_pos) AS "group", concat_ws(';', CASE WHEN n_dev>0 THEN concat('dev:',n_dev) END, CASE WHEN n_test>0 THEN concat('test:',n_test) END, CASE WHEN n_train>0 THEN concat('train:',n_train) END) AS splits FROM g)"""


def groups(spark, sf):
    return dd.exact_groups(views.docgroups(spark, sf), "near_key", "split", SPLITS)


@query("ag5_exact_duplicate_groups", f"WITH {GROUPS} SELECT \"group\", near_key, count, splits, first_pos FROM gg", ("docgroups",))
def ag5(spark, sf):
    return groups(spark, sf).select("group", "near_key", "count", "splits", "first_pos")


@query("ag5_duplicate_members", f"WITH {GROUPS} SELECT \"group\", near_key, d.pos, d.split, d.id, d.path FROM gg JOIN docgroups d USING (near_key)", ("docgroups",))
def ag5_members(spark, sf):
    return dd.group_members(views.docgroups(spark, sf), groups(spark, sf), "near_key", ["pos", "split", "id", "path"])


@query("ag6_duplicate_group_classes", f"WITH {GROUPS} SELECT CASE WHEN (n_train>0)::INT+(n_test>0)::INT+(n_dev>0)::INT>1 THEN 'cross_split' WHEN n_train>0 THEN 'train_only' WHEN n_test>0 THEN 'test_only' ELSE 'dev_only' END AS kind, count(*) AS groups, sum(count)::BIGINT AS rows FROM gg GROUP BY 1", ("docgroups",))
def ag6(spark, sf):
    return dd.classify_groups(groups(spark, sf), SPLITS)


# keys chosen so that chains across both of them occur
CHAIN = "ck AS (SELECT pos, answer, split, CAST(pos - pos % 7 AS VARCHAR) AS k1, CASE WHEN pos%4=0 THEN near_key END AS k2 FROM docgroups)"
COMPONENTS = """WITH RECURSIVE {chain},
e AS (SELECT DISTINCT x.m AS u, y.m AS v FROM (SELECT k1, min(pos) AS m FROM ck GROUP BY 1) x JOIN ck ON ck.k1=x.k1 JOIN (SELECT c2.k2, min(b.m) AS m FROM ck c2 JOIN (SELECT k1, min(pos) AS m FROM ck GROUP BY 1) b ON b.k1=c2.k1 WHERE c2.k2 IS NOT NULL GROUP BY 1) y ON y.k2=ck.k2),
both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(n, r) AS (SELECT m, m FROM (SELECT k1, min(pos) AS m FROM ck GROUP BY 1) UNION SELECT reach.n, both_ways.v FROM reach JOIN both_ways ON both_ways.u=reach.r),
comp AS (SELECT n, min(r) AS gid FROM reach GROUP BY 1),
grp AS (SELECT ck.*, comp.gid FROM ck JOIN (SELECT k1, min(pos) AS m FROM ck GROUP BY 1) b ON b.k1=ck.k1 JOIN comp ON comp.n=b.m)""".format(chain=CHAIN)


def chained(spark, sf):
    g = views.docgroups(spark, sf).selectExpr("pos", "answer", "split", "CAST(pos - pos % 7 AS STRING) AS k1", "CASE WHEN pos%4=0 THEN near_key END AS k2")
    return dd.duplicate_components(g, ["k1", "k2"])


@query("sp1_duplicate_components", f"{COMPONENTS} SELECT pos, gid FROM grp", ("docgroups",))
def sp1(spark, sf):
    return chained(spark, sf).select("pos", "gid")


FIT = """grps AS (SELECT near_key AS gid, arg_min(answer,pos) AS s, count(*) AS size FROM docgroups GROUP BY 1),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY s ORDER BY md5(concat('42:',gid)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before, round_even(sum(size) OVER (PARTITION BY s)*0.1,0) AS target FROM grps),
sp AS (SELECT d.*, o.before<o.target AS is_validation FROM docgroups d JOIN o ON o.gid=d.near_key)"""


def fitted(spark, sf):
    return sp.stratified_group_split(views.docgroups(spark, sf), 0.1, 42, group="near_key")


@query("sp2_stratified_group_split", f"WITH {FIT} SELECT pos, is_validation FROM sp", ("docgroups",))
def sp2(spark, sf):
    return fitted(spark, sf).select("pos", "is_validation")


@query("wn2_first_fit", f"WITH {FIT} SELECT gid, s, size, before<target AS taken FROM o", ("docgroups",))
def wn2(spark, sf):
    g = views.docgroups(spark, sf).groupBy(F.col("near_key").alias("gid")).agg(F.min_by("answer", "pos").alias("s"), F.count("*").alias("size"))
    return sp.first_fit(g.withColumn("key", hs.seeded_key(42, F.col("gid"))), "s", "size", "key", 0.1).select("gid", "s", "size", "taken")


@query("ud5_first_fit_quarter", f"WITH {FIT.replace('*0.1', '*0.25')} SELECT s, count(*) FILTER (before<target) AS groups_taken, coalesce(sum(size) FILTER (before<target),0)::BIGINT AS rows_taken FROM o GROUP BY 1", ("docgroups",))
def ud5(spark, sf):
    g = views.docgroups(spark, sf).groupBy(F.col("near_key").alias("gid")).agg(F.min_by("answer", "pos").alias("s"), F.count("*").alias("size"))
    t = sp.first_fit(g.withColumn("key", hs.seeded_key(42, F.col("gid"))), "s", "size", "key", 0.25)
    return t.groupBy("s").agg(F.count_if("taken").alias("groups_taken"), F.coalesce(F.sum(F.when(F.col("taken"), F.col("size"))), F.lit(0)).alias("rows_taken"))


def _ratio(flag, c):
    return f"round(count(*) FILTER ({flag} AND answer='{c}')/count(*) FILTER ({flag}),4)"


@query("sp3_split_metadata", f"WITH {FIT} SELECT count(*) AS n_original, count(*) FILTER (NOT is_validation) AS n_train, count(*) FILTER (is_validation) AS n_validation, " + ", ".join(f"{_ratio('NOT is_validation', c)} AS ratio_train_{c}, {_ratio('is_validation', c)} AS ratio_validation_{c}" for c in CHOICES)
    + ", (SELECT count(*) FROM grps) AS n_groups, (SELECT count(*) FROM grps WHERE size>1) AS n_multi_groups FROM sp", ("docgroups",))
def sp3(spark, sf):
    return sp.split_metadata(fitted(spark, sf), group="near_key")


@query("sp4_group_split", "WITH g AS (SELECT near_key, row_number() OVER (ORDER BY md5(concat('7:',near_key))) AS r FROM docgroups GROUP BY 1) SELECT pos, r <= greatest(1, round_even((SELECT count(*) FROM g)*0.2,0)) AS is_validation FROM docgroups JOIN g USING (near_key)", ("docgroups",))
def sp4(spark, sf):
    return sp.group_split(views.docgroups(spark, sf), 0.2, 7, group="near_key").select("pos", "is_validation")


@query("sp5_content_hash", "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, sha1(CASE WHEN doc_id%5=0 THEN concat('docs/',doc_id) ELSE substring(lang,1,1) END) AS head_sha1 FROM documents")
def sp5(spark, sf):
    content, path = F.encode("text", "UTF-8"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    head = F.when(F.col("doc_id") % 5 != 0, F.encode("lang", "UTF-8"))
    return table(spark, sf, "documents").select(
        "doc_id", hs.content_hash(content, path, algorithm="sha256").alias("sha256"), hs.content_hash(content, path).alias("sha1"),
        hs.content_hash(head, path, head_bytes=1).alias("head_sha1"),
    )


@query("sp6_seeded_sample", "SELECT id FROM items ORDER BY md5(concat('42:',id)) LIMIT 100", ("items",))
def sp6(spark, sf):
    return sp.sample_rows(views.items(spark, sf), 100).select("id")


@query("sp6_head", "SELECT id FROM items ORDER BY pos LIMIT 25", ("items",))
def sp6_head(spark, sf):
    return sp.head_rows(views.items(spark, sf), 25).select("id")


@query("sp7_balanced_sample", "SELECT split, id FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(concat('5:',id))) AS r FROM items) WHERE r<=60", ("items",))
def sp7(spark, sf):
    return sp.sample_rows(views.items(spark, sf), 60, 5, by=["split"]).select("split", "id")


@query("sp8_stratified_folds", "SELECT id, ((row_number() OVER (PARTITION BY answer ORDER BY md5(concat('42:',id)))-1)%5)::INT AS fold FROM items", ("items",))
def sp8(spark, sf):
    return sp.assign_folds(views.items(spark, sf), 5, "answer").select("id", "fold")


@query("so4_seeded_shuffle", "SELECT id, row_number() OVER (ORDER BY md5(concat('42:',id))) AS position FROM items", ("items",))
def so4(spark, sf):
    return sp.shuffled(views.items(spark, sf)).select("id", "position")


# ---- curation -----------------------------------------------------------------------------------------------------

@query("cu1_edit_log_problems", """WITH odd AS (SELECT action, field FROM edits UNION ALL SELECT concat(source, '?'), '' FROM items WHERE pos%9=0 UNION ALL SELECT 'edit_option', concat('e', lang) FROM items WHERE pos%11=0),
del AS (SELECT DISTINCT id FROM edits WHERE action='delete'), hard AS (SELECT DISTINCT id FROM edits WHERE action='mark_hard'), dl AS (SELECT DISTINCT concat('doc_', doc_id) AS id FROM labels WHERE quality=0)
SELECT (SELECT count(*) FROM odd WHERE action NOT IN ('delete','mark_hard','edit_option')) AS unknown_actions, (SELECT count(*) FROM odd WHERE action='edit_option' AND field NOT IN ('a','b','c','d')) AS bad_fields, (SELECT count(*) FROM (SELECT id FROM del UNION SELECT id FROM dl) JOIN hard USING (id)) AS delete_and_hard,
(SELECT count(*) FROM del FULL JOIN dl ON dl.id=del.id WHERE del.id IS NULL OR dl.id IS NULL) AS delete_mismatch, 0::BIGINT AS hard_mismatch""", ("edits", "items"))
def cu1(spark, sf):
    it = views.items(spark, sf)
    odd = it.filter("pos % 9 = 0").selectExpr("id", "concat(source, '?') AS action", "'' AS field", "'' AS before", "'' AS after", "1 AS seq").unionByName(
        it.filter("pos % 11 = 0").selectExpr("id", "'edit_option' AS action", "concat('e', lang) AS field", "'' AS before", "'' AS after", "1 AS seq"))
    deletes = table(spark, sf, "labels").filter("quality = 0").select(F.concat(F.lit("doc_"), "doc_id").alias("id"))
    return cu.edit_log_problems(views.edits(spark, sf).unionByName(odd), deletes)


@query("cu2_same_value", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, x, y, (x=y OR coalesce(TRY_CAST(x AS DOUBLE)=TRY_CAST(y AS DOUBLE),FALSE)) AS same FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS x, CASE l_linenumber%3 WHEN 0 THEN concat(CAST(l_quantity AS INT),'.0') WHEN 1 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS y FROM lineitem)")
def cu2(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    li = table(spark, sf, "lineitem").withColumns({
        "x": q, "y": F.when(F.col("l_linenumber") % 3 == 0, F.concat(q, F.lit(".0"))).when(F.col("l_linenumber") % 3 == 1, F.lit("n/a")).otherwise(q),
    })
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "x", "y", an.same_value(F.concat(F.lit(" "), "x"), F.col("y")).alias("same"))


NEW_A = "CASE WHEN pos%14=0 THEN concat(a,'**') WHEN pos%7=0 THEN concat(a,'*') ELSE a END"


@query("cu3_apply_edits", f"SELECT id, {NEW_A} AS a, b, c, d FROM items", ("items",))
def cu3(spark, sf):
    return cu.apply_edits(views.items(spark, sf), cu.option_edits(views.edits(spark, sf))).select("id", *CHOICES)


@query("cu3_edit_audit", "SELECT count(*) FILTER (pos%10<5) AS applied, count(*) FILTER (pos%10>=5) AS missing, 0::BIGINT AS before_mismatches FROM (SELECT pos FROM items WHERE pos%7=0 UNION ALL SELECT pos FROM items WHERE pos%14=0)", ("items",))
def cu3_audit(spark, sf):
    train = views.items(spark, sf).filter("split = 'train'")
    return cu.edit_audit(cu.edit_trail(train, cu.option_edits(views.edits(spark, sf))))


@query("cu4_delete_rows", "SELECT id FROM items WHERE id NOT IN (SELECT id FROM edits WHERE action='delete')", ("edits",))
def cu4(spark, sf):
    return cu.drop_listed(views.items(spark, sf), cu.listed_keys(views.edits(spark, sf), "delete")).select("id")


@query("cu5_mirror_rows", "SELECT concat(id,'__rev') AS id, d AS a, c AS b, b AS c, a AS d, translate(answer,'abcd','dcba') AS answer, 'train_hardrev' AS src, id AS source_id FROM items WHERE id IN (SELECT id FROM edits WHERE action='mark_hard')", ("edits",))
def cu5(spark, sf):
    hard = cu.keep_listed(views.items(spark, sf).withColumn("src", F.lit("train")), cu.listed_keys(views.edits(spark, sf), "mark_hard"))
    return cu.mirror_options(hard).select("id", *CHOICES, "answer", "src", "source_id")


def voted_dev(spark, sf):
    """Every item as an annotated row with vote pattern and human answer."""
    from itemloom.catalog.model_queries import wide_votes
    from itemloom.operators import votes as vt

    v = vt.with_patterns(vt.vote_vector(wide_votes(spark, sf))).select(F.col("item_id").alias("pos"), "vote_pattern", "human_answer")
    return views.items(spark, sf).drop("answer").withColumn("img", F.col("id")).join(v, "pos")


PATTERNS = "('3','3:1','3:1:1','2:1')"
VOTED = """f AS (SELECT item_id, list_aggregate(list_transform(list_reverse_sort(list_filter([n_a,n_b,n_c,n_d], lambda x: x>0)), lambda x: CAST(x AS VARCHAR)), 'string_agg', ':') AS vote_pattern,
  CASE greatest(n_a,n_b,n_c,n_d) WHEN n_a THEN 'a' WHEN n_b THEN 'b' WHEN n_c THEN 'c' ELSE 'd' END AS human FROM vote_counts),
dv AS (SELECT i.* EXCLUDE (answer), vote_pattern, human AS answer, i.id IN (SELECT id FROM edits WHERE action IN ('mark_hard','edit_option')) AS edited FROM items i JOIN f ON item_id=pos),
kept AS (SELECT * FROM dv WHERE vote_pattern IN """ + PATTERNS + """ AND NOT (vote_pattern='2:1' AND NOT edited) AND id NOT IN (SELECT id FROM edits WHERE action='delete') AND pos%9<>0)"""


@query("cu6_drop_unedited_patterns", f"WITH {VOTED} SELECT id FROM dv WHERE NOT (vote_pattern='2:1' AND NOT edited)", ("edits", "vote_counts"))
def cu6(spark, sf):
    e = views.edits(spark, sf)
    edited = cu.option_edits(e).select("key").unionByName(cu.listed_keys(e, "mark_hard"))
    return cu.drop_unedited_patterns(voted_dev(spark, sf), ["2:1"], edited).select("id")


def _mirror_sql(source, src):
    """The kept rows and the mirrored copies of the hard ones."""
    return (f"SELECT id, {NEW_A} AS a, b, c, d, answer, {src} AS src FROM {source} UNION ALL "
            f"SELECT concat(id,'__rev'), d, c, b, {NEW_A}, translate(answer,'abcd','dcba'), concat({src},'_hardrev') FROM {source} WHERE id IN (SELECT id FROM edits WHERE action='mark_hard')")


def train_rows(spark, sf):
    return views.items(spark, sf).filter("split = 'train'")


TRAIN = "tr AS (SELECT * FROM items WHERE split='train' AND id NOT IN (SELECT id FROM edits WHERE action='delete'))"


@query("cu7_curated_train", f"WITH {TRAIN} {_mirror_sql('tr', chr(39) + 'train' + chr(39))}", ("edits",))
def cu7(spark, sf):
    return cu.curated_train(train_rows(spark, sf), views.edits(spark, sf)).select("id", *CHOICES, "answer", "src")


def curated_dev(spark, sf):
    held = views.items(spark, sf).filter("pos % 9 = 0").select("id", F.col("id").alias("img"))
    return cu.curated_dev(voted_dev(spark, sf), views.edits(spark, sf), held, ["3", "3:1", "3:1:1", "2:1"], ["2:1"])


_DEV_SRC = "concat('dev_', vote_pattern)"


@query("cu8_curated_dev", f"WITH {VOTED} {_mirror_sql('kept', _DEV_SRC)}", ("edits", "vote_counts"))
def cu8(spark, sf):
    return curated_dev(spark, sf).select("id", *CHOICES, "answer", "src")


@query("cu17_curation_audit", f"""WITH {TRAIN}, l AS (SELECT DISTINCT id FROM edits), h AS (SELECT * FROM items WHERE split='dev'), m AS (SELECT id FROM tr WHERE id IN (SELECT id FROM edits WHERE action='mark_hard'))
SELECT 'listed_in_held_out' AS measure, count(*) AS value FROM l WHERE id IN (SELECT id FROM h) UNION ALL SELECT 'listed_not_in_rows', count(*) FROM l WHERE id NOT IN (SELECT id FROM items WHERE split='train')
UNION ALL SELECT 'rows_dropped', (SELECT count(*) FROM items WHERE split='train') - (SELECT count(*) FROM tr) UNION ALL SELECT 'copies_added', count(*) FROM m UNION ALL SELECT 'rows_out', (SELECT count(*) FROM tr)+(SELECT count(*) FROM m)""", ("edits",))
def cu17(spark, sf):
    train, e = train_rows(spark, sf), views.edits(spark, sf)
    held = views.items(spark, sf).filter("split = 'dev'")
    return cu.curation_audit(train, e, held, cu.curated_train(train, e))


MC = f"""{QAF},
own AS (SELECT img_id, norm, min(answer_text) AS text FROM q GROUP BY 1,2),
uniq AS (SELECT norm, answer_text AS text, digit, length(answer_text) AS len FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY img_id, k, answer_text) AS rn FROM q) WHERE rn=1),
ring AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY md5(concat_ws(':','42',norm))) - 1 AS pos, count(*) OVER (PARTITION BY img_id) AS n FROM own),
same AS (SELECT rowkey, cn, ct, rn FROM (SELECT q.rowkey, o.norm AS cn, o.text AS ct, row_number() OVER (PARTITION BY q.rowkey
  ORDER BY (o.pos - CAST('0x'||substring(md5(concat_ws(':','42',q.rowkey)),1,12) AS BIGINT) % o.n + o.n) % o.n) AS rn
  FROM q JOIN ring o ON o.img_id=q.img_id AND o.norm<>q.norm AND NOT contains(q.norm,o.norm) AND NOT contains(o.norm,q.norm)) WHERE rn<=3),
have AS (SELECT rowkey, count(*) AS n FROM same GROUP BY 1),
near AS (SELECT rowkey, cn, ct FROM (SELECT q.rowkey, u.norm AS cn, u.text AS ct, row_number() OVER (PARTITION BY q.rowkey ORDER BY abs(u.len-length(q.answer_text)), md5(concat_ws(':','42',u.norm))) AS rn
  FROM q JOIN uniq u ON u.digit=q.digit AND u.norm<>q.norm AND NOT contains(q.norm,u.norm) AND NOT contains(u.norm,q.norm)
  WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.rowkey=q.rowkey AND s.cn=u.norm)) WHERE rn<=50),
other AS (SELECT rowkey, ct, rn FROM (SELECT n.rowkey, n.ct, row_number() OVER (PARTITION BY n.rowkey ORDER BY md5(concat_ws(':','42',n.rowkey,n.cn))) AS rn, coalesce(h.n,0) AS hn FROM near n LEFT JOIN have h USING (rowkey)) WHERE rn<=3-hn),
wrong AS (SELECT rowkey, ct, row_number() OVER (PARTITION BY rowkey ORDER BY tier, rn) AS i, count(*) OVER (PARTITION BY rowkey) AS total FROM (
  SELECT rowkey, ct, 1 AS tier, rn FROM same UNION ALL SELECT rowkey, ct, 2, rn FROM other)),
opts AS (SELECT rowkey, 0 AS i, answer_text AS t FROM q WHERE rowkey IN (SELECT rowkey FROM wrong WHERE total=3) UNION ALL SELECT rowkey, i, ct FROM wrong WHERE total=3),
placed AS (SELECT *, row_number() OVER (PARTITION BY rowkey ORDER BY md5(concat_ws(':','42',rowkey,CAST(i AS VARCHAR)))) AS slot FROM opts),
mc AS (SELECT concat('qa_',rowkey) AS id, max(t) FILTER (slot=1) AS a, max(t) FILTER (slot=2) AS b, max(t) FILTER (slot=3) AS c, max(t) FILTER (slot=4) AS d,
  substring('abcd', CAST(max(slot) FILTER (i=0) AS INT), 1) AS answer, any_value(coalesce(h.n,0))::INT AS same_group FROM placed LEFT JOIN have h USING (rowkey) GROUP BY 1)"""


def converted(spark, sf):
    return cu.free_form_to_choices(qc.free_form_filter(views.qa(spark, sf), 1200))


@query("cu9_free_form_to_choices", f"WITH {MC} SELECT * FROM mc", ("qa",))
def cu9(spark, sf):
    return converted(spark, sf).select("id", *CHOICES, "answer", "same_group")


@query("cu10_same_group_share", f"WITH {MC} SELECT round(sum(same_group)/(3*count(*)),6) AS same_group_share, count(*) AS n FROM mc", ("qa",))
def cu10(spark, sf):
    return rounded(cu.same_group_share(converted(spark, sf)))


@query("wn4_nearest_candidates", f"WITH {MC} SELECT img_id, k, coalesce(h.n,0) AS same_group, (SELECT count(*) FROM near WHERE near.rowkey=q.rowkey) AS nearest FROM q LEFT JOIN have h USING (rowkey)", ("qa",))
def wn4(spark, sf):
    return cu.distractor_pools(qc.free_form_filter(views.qa(spark, sf), 1200))


AUGS = ["compression", "affine"]
FAN = """fan AS (SELECT id, 'none' AS aug, 'docs' AS src, 0 AS block, answer FROM items UNION ALL SELECT concat(id,'__',g), g, concat('docs+',g), 1, answer FROM items, (VALUES ('compression'),('affine')) v(g)),
fo AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY md5(concat('42:',id))) AS position FROM fan)"""


def tagged_items(spark, sf):
    return views.items(spark, sf).withColumn("src", F.lit("docs"))


@query("cu11_expand_augmentations", f"WITH {FAN} SELECT id, aug, src, block, position FROM fo", ("items",))
def cu11(spark, sf):
    return cu.expand_augmentations(tagged_items(spark, sf), AUGS).select("id", "aug", "src", "block", "position")


@query("cu12_augmentation_index", "SELECT id, aug, pos*3+g AS index FROM items, (VALUES (0,'orig'),(1,'compression'),(2,'affine')) v(g,aug)", ("items",))
def cu12(spark, sf):
    return cu.augmentation_index(views.items(spark, sf), ["orig", *AUGS]).select("id", "aug", "index")


@query("cu13_shuffle_options", """WITH o AS (SELECT id, answer, l, t, row_number() OVER (PARTITION BY id ORDER BY md5(concat('42:',id,':',l))) AS slot FROM (
  SELECT id, answer, 'a' AS l, a AS t FROM items UNION ALL SELECT id, answer, 'b', b FROM items UNION ALL SELECT id, answer, 'c', c FROM items UNION ALL SELECT id, answer, 'd', d FROM items))
SELECT id, max(t) FILTER (slot=1) AS a, max(t) FILTER (slot=2) AS b, max(t) FILTER (slot=3) AS c, max(t) FILTER (slot=4) AS d, substring('abcd',CAST(max(slot) FILTER (l=answer) AS INT),1) AS answer FROM o GROUP BY 1""", ("items",))
def cu13(spark, sf):
    return cu.shuffle_options(views.items(spark, sf)).select("id", *CHOICES, "answer")


def stages(spark, sf):
    it = tagged_items(spark, sf)
    return cu.build_stages(it.filter("split = 'train'"), [it.filter("split = 'dev'")], augs=AUGS, augment_external=False)


STAGES = FAN.replace("FROM items", "FROM sel").replace("fan AS", "sel AS (SELECT *, CASE split WHEN 'dev' THEN 'external' ELSE 'target' END AS stage FROM items WHERE split<>'test'), fan AS").replace(
    "0 AS block, answer FROM sel", "0 AS block, answer, stage FROM sel").replace("1, answer FROM sel, (VALUES ('compression'),('affine')) v(g)", "1, answer, stage FROM sel, (VALUES ('compression'),('affine')) v(g) WHERE stage='target'").replace("PARTITION BY block", "PARTITION BY stage, block")


@query("cu14_build_stages", f"WITH {STAGES} SELECT stage, CASE stage WHEN 'external' THEN 0 ELSE 1 END AS stage_no, id, block, position FROM fo", ("items",))
def cu14(spark, sf):
    return stages(spark, sf).select("stage", "stage_no", "id", "block", "position")


@query("ag17_stage_summary", f"WITH {STAGES} SELECT stage, count(*) AS rows, " + ", ".join(f"count(*) FILTER (answer='{c}') AS ans_{c}" for c in CHOICES) + ", count(*) FILTER (aug='none') AS aug_none, count(*) FILTER (aug='affine') AS aug_affine, count(*) FILTER (src='docs') AS src_docs FROM fo GROUP BY 1", ("items",))
def ag17(spark, sf):
    t = cu.stage_summary(stages(spark, sf))
    def entry(m, k):
        return F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    return t.select("stage", "rows", *[f"ans_{c}" for c in CHOICES], entry(F.col("aug_counts"), "none").alias("aug_none"), entry(F.col("aug_counts"), "affine").alias("aug_affine"), entry(F.col("src_counts"), "docs").alias("src_docs"))


@query("cu15_finalize_external", f"WITH {EXT} SELECT id, o_a AS a, o_b AS b, lower(ans) AS answer, 'bench' AS src FROM ext WHERE reason IS NULL AND pos%10<9", ("items",))
def cu15(spark, sf):
    kept = qc.external_rejections(external_rows(spark, sf)).filter("reason IS NULL").withColumn("rid", F.expr("substring(id, 5)"))
    ext = rd.external_items(kept, "doc")
    held = views.items(spark, sf).filter("split = 'dev'")
    return cu.finalize_external(ext, held, "bench", image=None).select("id", "a", "b", "answer", "src")


# ---- sources and sinks --------------------------------------------------------------------------------------------

@query("src1_read_splits", "SELECT 'labels' AS split, count(*) AS n, sum(doc_id)::BIGINT AS s FROM labels UNION ALL SELECT 'documents', count(*), sum(doc_id)::BIGINT FROM documents")
def src1(spark, sf):
    both = rd.read_splits(spark, sf, ["labels", "documents"], "parquet")
    return both.groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("s"))


@query("src1_csv_round_trip", "SELECT split, id, nullif(question,'') AS question, answer, CASE WHEN split='dev' THEN NULL ELSE nullif(a,'') END AS a FROM items", ("items",))
def src1_csv(spark, sf):
    """Splits written and read as CSV: whole texts with line breaks and quotes, and a column that one split lacks."""
    root = f"{ensure_checkpoint_dir(spark)}/splits-{uuid.uuid4().hex[:12]}"
    it = views.items(spark, sf)
    for split in ("train", "test", "dev"):
        columns = ["id", "question", "answer"] + ([] if split == "dev" else ["a"])
        part = it.filter(F.col("split") == split).select(*columns)
        part.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/{split}.csv")
    return rd.read_splits(spark, root).select("split", "id", "question", "answer", "a")


EDIT_CELLS = ("id", "action", "field", "before", "after")


@query("src2_edit_records", """SELECT id, action, field, before, after, FALSE AS bad FROM edits
UNION ALL SELECT concat('doc_', doc_id), 'delete', NULL, NULL, NULL, TRUE FROM labels WHERE quality=0
UNION ALL SELECT concat('doc_', doc_id), 'delete', NULL, NULL, NULL, TRUE FROM labels WHERE toxic=1""", ("edits",))
def src2(spark, sf):
    """An edit log as text, with records of too few and of too many cells among the others."""
    path = f"{ensure_checkpoint_dir(spark)}/edits-{uuid.uuid4().hex[:12]}"
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in EDIT_CELLS]
    labels = table(spark, sf, "labels")
    name = F.concat(F.lit("doc_"), "doc_id")
    lines = views.edits(spark, sf).select(F.concat_ws(",", *quoted).alias("value"))
    lines = lines.unionByName(labels.filter("quality = 0").select(F.concat(name, F.lit(",delete")).alias("value")))
    lines = lines.unionByName(labels.filter("toxic = 1").select(F.concat(name, F.lit(",delete,,,,more")).alias("value")))
    lines.write.text(path)
    return rd.read_records(spark, path, EDIT_CELLS, header=False).select(*EDIT_CELLS, F.col("bad_record").isNotNull().alias("bad"))


@query("src6_flatten_qa", f"SELECT u.conv_id, CAST(floor(u.turn/2) AS INT) AS k, {NORM.format(c='u.text')} AS question, {NORM.format(c='s.text')} AS answer_text FROM conversations u JOIN conversations s ON s.conv_id=u.conv_id AND s.turn=u.turn+1 WHERE u.turn%2=0")
def src6(spark, sf):
    c = table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = c.filter("turn % 2 = 0").join(nxt, ["conv_id", "turn"]).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("question"), "answer"))).alias("p")
    )
    nested = pairs.select("conv_id", F.to_json(F.transform("p", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer")))).alias("qa_pairs"))
    return rd.flatten_qa(nested, "conv_id", "qa_pairs")


@query("src8_keep_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality=0)")
def src8(spark, sf):
    lines = table(spark, sf, "labels").filter("quality = 0").select(F.concat(F.col("doc_id").cast("string"), F.lit("  \t")).alias("value"))
    return rd.keep_ids(table(spark, sf, "documents").select("doc_id", "lang"), lines, "value", "doc_id")


@query("src9_attach_hints", "SELECT d.doc_id, coalesce(b.text,'') AS ocr_text FROM documents d LEFT JOIN benchmark b ON b.item_id=d.doc_id")
def src9(spark, sf):
    hints = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("ocr_text"))
    return rd.attach_hints(table(spark, sf, "documents").select("doc_id"), hints, "doc_id")


@query("snk6_config_differences", "WITH a AS (SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS v FROM nation), b AS (SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey%5=0 THEN lower(n_name) ELSE n_name END AS v FROM nation WHERE n_nationkey<>7) SELECT key, a.v AS stored, b.v AS current FROM a FULL JOIN b USING (key) WHERE a.v IS DISTINCT FROM b.v")
def snk6(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    current = n.filter("key <> '7'").withColumn("value", F.expr("CASE WHEN CAST(key AS INT)%5=0 THEN lower(value) ELSE value END"))
    return qc.config_differences(n, current)


# ---- text boxes ---------------------------------------------------------------------------------------------------

@query("oc1_reading_order", "SELECT image_id, string_agg(txt, ' | ' ORDER BY round_even(top/40,0), lft, top, txt) AS ocr_text FROM boxes WHERE conf>=0.3 GROUP BY 1", ("boxes",))
def oc1(spark, sf):
    return ocr.reading_order_text(views.boxes(spark, sf))


@query("oc2_share_texts", "WITH t AS (SELECT image_id, string_agg(txt, ' | ' ORDER BY round_even(top/40,0), lft, top, txt) AS ocr_text FROM boxes WHERE conf>=0.9 GROUP BY 1) SELECT o_orderkey, coalesce(ocr_text,'') AS ocr_text FROM orders LEFT JOIN t ON image_id=o_orderkey", ("boxes",))
def oc2(spark, sf):
    items = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("image_id"))
    return ocr.share_texts(items, ocr.reading_order_text(views.boxes(spark, sf), min_conf=0.9)).select("o_orderkey", "ocr_text")


@query("oc2_empty_texts", "SELECT count(*) AS images, count(*) FILTER (n=0) AS empty FROM (SELECT o_orderkey, count(image_id) AS n FROM orders LEFT JOIN (SELECT * FROM boxes WHERE conf>=0.9) ON image_id=o_orderkey GROUP BY 1)", ("boxes",))
def oc2_empty(spark, sf):
    items = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("image_id"))
    return ocr.empty_count(ocr.share_texts(items, ocr.reading_order_text(views.boxes(spark, sf), min_conf=0.9)))
