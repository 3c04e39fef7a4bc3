"""Derived views over the given tables, once as Spark frames and once as SQL text.

They give the operators inputs of the right shape: items with splits, annotator votes, model runs, duplicate
keys, edit logs, free-form questions with answers, text boxes and sign hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Korean openings put before the text so that every taxonomy rule is exercised.
OPENINGS = [
    "", "전화번호는 무엇", "가격은 얼마", "사과는 몇 개", "영업시간은 언제", "색깔은 무엇", "가게는 어디", "메뉴 이름은",
    "누구의 가게", "적힌 문구", "2층 간판", "무엇을 하고 있", "종류 무엇인가",
]
_OPENING_CASE = f"CASE doc_id % {len(OPENINGS)} " + " ".join(f"WHEN {i} THEN '{t} '" for i, t in enumerate(OPENINGS) if t) + " ELSE '' END"

# The whole text: the first half or so is the question, the rest falls into four options.
ITEM_COLUMNS = """pos, id, path, split, lang, source, {question} AS question,
  substring(text, size-4*part+1, part) AS a, substring(text, size-3*part+1, part) AS b,
  substring(text, size-2*part+1, part) AS c, substring(text, size-part+1, part) AS d, answer
FROM (SELECT *, CAST(floor(size/8) AS INT) AS part FROM (SELECT doc_id, doc_id AS pos, concat('doc_', doc_id) AS id, concat('docs/doc_', doc_id, '.txt') AS path,
  CASE WHEN doc_id % 10 < 5 THEN 'train' WHEN doc_id % 10 < 9 THEN 'test' ELSE 'dev' END AS split, lang, source, text, CAST(length(text) AS INT) AS size,
  substring('abcd',CAST(1+doc_id%4 AS INT),1) AS answer FROM {documents}))"""

_ITEMS = "SELECT " + ITEM_COLUMNS.replace("{question}", "substring(text,1,size-4*part)")
_KITEMS = "SELECT " + ITEM_COLUMNS.replace("{question}", "concat(" + _OPENING_CASE + ", substring(text,1,size-4*part))")
_VOTES = """SELECT CAST(floor(event_id/5) AS BIGINT) AS item_id, CAST(1+event_id%5 AS INT) AS annotator,
  CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'purchase' THEN 'c' WHEN 'error' THEN 'd' END AS vote, ts
FROM {events}"""
_DOCGROUPS = """SELECT doc_id AS pos, concat('doc_', doc_id) AS id, concat('docs/doc_', doc_id, '.txt') AS path,
  CASE WHEN doc_id % 10 < 5 THEN 'train' WHEN doc_id % 10 < 9 THEN 'test' ELSE 'dev' END AS split,
  {sha} AS sha, md5(lower(regexp_replace(text,'[^a-zA-Z]+','',{all}))) AS near_key, text AS question,
  substring('abcd',CAST(1+doc_id%4 AS INT),1) AS answer FROM {documents}"""
_EDITS = """SELECT concat('doc_',doc_id) AS id, 'delete' AS action, '' AS field, '' AS before, '' AS after, 1 AS seq FROM {labels} WHERE toxic=1
UNION ALL SELECT concat('doc_',doc_id),'mark_hard','','','',1 FROM {labels} WHERE toxic=0 AND quality=0
UNION ALL SELECT id,'edit_option','a',a,concat(a,'*'),1 FROM {items} WHERE pos%7=0
UNION ALL SELECT id,'edit_option','a',concat(a,'*'),concat(a,'**'),2 FROM {items} WHERE pos%14=0"""
_QA = """SELECT concat('img_',u.conv_id) AS img_id, u.turn AS k, u.text AS question, s.text AS answer_text
FROM {conversations} u JOIN {conversations} s ON s.conv_id=u.conv_id AND s.turn=u.turn+1
WHERE u.role='user' AND s.role='assistant'"""
_BOXES = """SELECT DISTINCT l_orderkey AS image_id, CAST(floor(l_extendedprice) AS BIGINT)%800 AS top, CAST(l_quantity AS INT) AS lft,
  concat('w',l_partkey) AS txt, l_discount*10 AS conf FROM {lineitem}"""
_SIZES = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus='F' THEN 'train' ELSE 'test' END AS split,
  CAST(200 + (l_partkey*37) % 3000 AS INT) AS width, CAST(200 + (l_suppkey*91 + l_linenumber*613) % 2500 AS INT) AS height,
  CAST(floor(l_extendedprice) AS BIGINT) AS file_bytes FROM {lineitem}"""

def _hash_text(count: str) -> str:
    """64 bits of a text: the last two bits of how often each letter occurs, and the last bit for digits, blank and full stop.

    Texts that differ in a few letters differ in a few bits; texts without letters crowd on few hashes.
    """
    letters, others = "abcdefghijklmnopqrstuvwxyz", "0123456789 ."
    bits = [f"{count.format(c)} % 2" for c in letters + others] + [f"CAST(floor({count.format(c)} / 2) AS BIGINT) % 2" for c in letters]
    values = [str(2**i) for i in range(63)] + ["(-9223372036854775807 - 1)"]
    return "(" + " + ".join(f"CAST(CASE WHEN {b} = 1 THEN {v} ELSE 0 END AS BIGINT)" for b, v in zip(bits, values, strict=True)) + ")"


# SQL text of every view; later ones read earlier ones.
_SQL = {
    **{
        name: text.format(sha="sha256(text)", all="'g'", **{t: t for t in ("documents", "events", "labels", "items", "conversations", "lineitem")})
        for name, text in (
            ("items", _ITEMS), ("kitems", _KITEMS), ("votes", _VOTES), ("docgroups", _DOCGROUPS), ("edits", _EDITS),
            ("qa", _QA), ("boxes", _BOXES), ("sizes", _SIZES),
        )
    },
    "runs": """SELECT vec_id AS id, r AS run, substring('abcd',CAST(1+label%4 AS INT),1) AS gold, label,
  20*CAST(embedding[1+4*r] AS DOUBLE) AS l_a, 20*CAST(embedding[1+4*r+1] AS DOUBLE) AS l_b,
  20*CAST(embedding[1+4*r+2] AS DOUBLE) AS l_c, 20*CAST(embedding[1+4*r+3] AS DOUBLE) AS l_d
FROM embeddings CROSS JOIN range(16) AS t(r)""",
    "probs": """SELECT id, run, gold, label, exp(l_a-m)/z AS p_a, exp(l_b-m)/z AS p_b, exp(l_c-m)/z AS p_c, exp(l_d-m)/z AS p_d FROM (
  SELECT *, exp(l_a-m)+exp(l_b-m)+exp(l_c-m)+exp(l_d-m) AS z FROM (SELECT *, greatest(l_a,l_b,l_c,l_d) AS m FROM runs))""",
    # averages of the first and the second model (eight runs each), with arg-max letters
    "models": """SELECT *, CASE greatest(p_a,p_b,p_c,p_d) WHEN p_a THEN 'a' WHEN p_b THEN 'b' WHEN p_c THEN 'c' ELSE 'd' END AS pred FROM (
  SELECT id, CASE WHEN run<8 THEN 'A' ELSE 'B' END AS model, any_value(gold) AS gold, any_value(label) AS label,
  avg(p_a) AS p_a, avg(p_b) AS p_b, avg(p_c) AS p_c, avg(p_d) AS p_d FROM probs GROUP BY 1,2)""",
    # four variants of four runs
    "variants": """SELECT *, CASE greatest(p_a,p_b,p_c,p_d) WHEN p_a THEN 'a' WHEN p_b THEN 'b' WHEN p_c THEN 'c' ELSE 'd' END AS pred,
  CASE gold WHEN 'a' THEN p_a WHEN 'b' THEN p_b WHEN 'c' THEN p_c ELSE p_d END AS p_gold FROM (
  SELECT id, concat('v', CAST(floor(run/4) AS BIGINT)) AS variant, any_value(gold) AS gold,
  avg(p_a) AS p_a, avg(p_b) AS p_b, avg(p_c) AS p_c, avg(p_d) AS p_d FROM probs GROUP BY 1,2)""",
    # the eight runs of the first model with per-run arg-max letters
    "runs_a": """SELECT *, CASE greatest(p_a,p_b,p_c,p_d) WHEN p_a THEN 'a' WHEN p_b THEN 'b' WHEN p_c THEN 'c' ELSE 'd' END AS pred
  FROM probs WHERE run < 8""",
    "uncertain": """SELECT *, 0.40*(1-margin)+0.30*entropy+0.15*(1-confidence)+0.15*(1-agreement) AS unc_score FROM (
  SELECT id, gold, label, p_a, p_b, p_c, p_d, answer, agreement, s[4] AS confidence, s[4]-s[3] AS margin,
  -(p_a*ln(greatest(p_a,1e-12))+p_b*ln(greatest(p_b,1e-12))+p_c*ln(greatest(p_c,1e-12))+p_d*ln(greatest(p_d,1e-12)))/ln(4) AS entropy FROM (
  SELECT *, list_sort([p_a,p_b,p_c,p_d]) AS s,
  CASE greatest(p_a,p_b,p_c,p_d) WHEN p_a THEN 'a' WHEN p_b THEN 'b' WHEN p_c THEN 'c' ELSE 'd' END AS answer FROM (
  SELECT id, any_value(gold) AS gold, any_value(label) AS label, avg(p_a) AS p_a, avg(p_b) AS p_b, avg(p_c) AS p_c, avg(p_d) AS p_d,
  greatest(count(*) FILTER (pred='a'), count(*) FILTER (pred='b'), count(*) FILTER (pred='c'), count(*) FILTER (pred='d'))/count(*) AS agreement
  FROM runs_a GROUP BY id)))""",
    "hashes": "SELECT doc_id AS pos, concat('doc_',doc_id) AS id, CASE WHEN doc_id%2=0 THEN 'train' ELSE 'test' END AS split, md5(text) AS sha, length(text) AS brightness, "
    + _hash_text("(length(text)-length(replace(text,'{0}','')))") + " AS phash FROM documents",
    "wide_votes": """SELECT item_id, max(CASE WHEN annotator=1 THEN vote END) AS answer1, max(CASE WHEN annotator=2 THEN vote END) AS answer2,
  max(CASE WHEN annotator=3 THEN vote END) AS answer3, max(CASE WHEN annotator=4 THEN vote END) AS answer4, max(CASE WHEN annotator=5 THEN vote END) AS answer5
  FROM votes GROUP BY item_id""",
    "vote_counts": """SELECT item_id, count(*) FILTER (vote='a') AS n_a, count(*) FILTER (vote='b') AS n_b, count(*) FILTER (vote='c') AS n_c,
  count(*) FILTER (vote='d') AS n_d, count(vote) AS n FROM votes GROUP BY item_id""",
}
_NEEDS = {
    "edits": ("items",), "probs": ("runs",), "models": ("probs",), "variants": ("probs",), "runs_a": ("probs",),
    "uncertain": ("runs_a",), "wide_votes": ("votes",), "vote_counts": ("votes",),
}


def with_views(sql: str, uses: tuple[str, ...]) -> str:
    """Prefix a query with the views it reads, each after the ones it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in order:
            order.append(name)

    for name in uses:
        add(name)
    if not order:
        return sql
    parts = [f"{name} AS ({_SQL[name]})" for name in order]
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join(parts) + ",\n" + body[len("WITH"):]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Items with split, question, four options and answer."""
    return spark.sql(_ITEMS, documents=_read(spark, sf, "documents"))


def korean_items(spark: SparkSession, sf: str) -> DataFrame:
    """The same items with Korean openings in the question."""
    return spark.sql(_KITEMS, documents=_read(spark, sf, "documents"))


def votes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_VOTES, events=_read(spark, sf, "events"))


def docgroups(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_DOCGROUPS.replace("{sha}", "sha2(text,256)").replace("{all}", "1"), documents=_read(spark, sf, "documents"))


def edits(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_EDITS, labels=_read(spark, sf, "labels"), items=items(spark, sf))


def qa(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_QA, conversations=_read(spark, sf, "conversations"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_BOXES, lineitem=_read(spark, sf, "lineitem"))


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_SIZES, lineitem=_read(spark, sf, "lineitem"))


def numeric_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as two splits (F is train, O is test) with four numeric metrics."""
    status = F.when(F.col("l_linestatus") == "F", "train").otherwise("test").alias("split")
    return _read(spark, sf, "lineitem").select(status, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen runs of four logits per vector, fanned out within each row."""
    emb = _read(spark, sf, "embeddings")
    out = emb.select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("run"))
    return out.select(
        F.col("vec_id").alias("id"), "run", F.expr("substring('abcd', CAST(1+label%4 AS INT), 1)").alias("gold"), "label",
        F.expr("transform(slice(embedding, 1+4*run, 4), x -> 20*CAST(x AS DOUBLE))").alias("logits"),
    )


def probs(spark: SparkSession, sf: str) -> DataFrame:
    from itemloom.functions.probs import softmax

    return runs(spark, sf).withColumn("probs", softmax(F.col("logits"))).drop("logits")


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    """64-bit letter hashes of texts with a split, a content hash and a length."""
    return _read(spark, sf, "documents").selectExpr(
        "doc_id AS pos", "concat('doc_', doc_id) AS id", "IF(doc_id % 2 = 0, 'train', 'test') AS split", "md5(text) AS sha",
        "CAST(length(text) AS BIGINT) AS brightness", _hash_text("(length(text)-length(replace(text,'{0}','')))") + " AS phash",
    )
