"""Queries for distribution comparison, text features and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom import CHOICES
from itemloom.catalog import views
from itemloom.catalog.base import query, table
from itemloom.functions import rules, text as tx
from itemloom.operators import distribution as ds, profile as pf, quality as qc

METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SPLITS = ["train", "test", "dev"]


def r6(column):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6) + F.lit(0.0)


def rounded(df, *keys):
    """Round every double column to six places, keep the others."""
    return df.select(*[r6(c).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


LONG = """long AS (
  SELECT CASE WHEN l_linestatus='F' THEN 'train' ELSE 'test' END AS split, metric, value FROM lineitem
  UNPIVOT (value FOR metric IN (l_quantity, l_extendedprice, l_discount, l_tax)))"""
KS = """cum AS (SELECT metric, value, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY metric) AS na, sum(b) OVER (PARTITION BY metric) AS nb
  FROM (SELECT metric, value, count(*) FILTER (split='train') AS a, count(*) FILTER (split='test') AS b FROM long GROUP BY 1,2)
  WINDOW w AS (PARTITION BY metric ORDER BY value)),
ks AS (SELECT metric, max(abs(ca/na - cb/nb)) AS ks FROM cum GROUP BY 1),
mom AS (SELECT metric, count(*) FILTER (split='train') AS n1, count(*) FILTER (split='test') AS n2,
  avg(value) FILTER (split='train') AS m1, avg(value) FILTER (split='test') AS m2,
  stddev_samp(value) FILTER (split='train') AS s1, stddev_samp(value) FILTER (split='test') AS s2 FROM long GROUP BY 1)"""


@query(
    "ds1_numeric_comparison",
    f"""WITH {LONG}, {KS}
SELECT metric, round(m1,6)+0.0 AS base_mean, round(m2,6)+0.0 AS other_mean, round(m2-m1,6)+0.0 AS mean_difference,
  round((m2-m1)/sqrt((s1*s1+s2*s2)/2),6)+0.0 AS standardized_mean_difference, round(ks,6)+0.0 AS ks_statistic
FROM mom JOIN ks USING (metric)""",
)
def ds1(spark, sf):
    return rounded(ds.numeric_comparison(views.numeric_lines(spark, sf), "split", "train", "test", METRICS))


@query(
    "ds1_numeric_summary",
    f"""WITH {LONG}
SELECT metric, split, count(*) AS count, round(avg(value),6)+0.0 AS mean, round(stddev_samp(value),6)+0.0 AS std, min(value) AS min,
  round(quantile_cont(value,0.25),6) AS p25, round(quantile_cont(value,0.5),6) AS median, round(quantile_cont(value,0.75),6) AS p75, max(value) AS max
FROM long GROUP BY 1,2""",
)
def ds1_summary(spark, sf):
    return rounded(ds.describe_splits(views.numeric_lines(spark, sf), "split", ["train", "test"], METRICS), "min", "max")


@query("ds2_ks_statistic", f"WITH {LONG}, {KS} SELECT metric, round(ks,6)+0.0 AS ks FROM ks")
def ds2(spark, sf):
    p = ds.metric_profile(views.numeric_lines(spark, sf), "split", ["train", "test"], METRICS, {}, [("train", "test")])
    return p.select("metric", r6("ks_train_test").alias("ks"))


@query(
    "ds3_smd_base_minus_other",
    f"WITH {LONG}, {KS} SELECT metric, round((m1-m2)/sqrt((s1*s1+s2*s2)/2),6)+0.0 AS smd FROM mom",
)
def ds3(spark, sf):
    p = ds.metric_profile(views.numeric_lines(spark, sf), "split", ["train", "test"], METRICS, {})
    return p.select("metric", r6(-ds.smd("train", "test")).alias("smd"))


SIZE_LONG = """long AS (SELECT split, metric, value FROM (
  SELECT CASE WHEN pos%10<1 THEN 'validation' WHEN split='train' THEN 'train' ELSE 'test' END AS split,
  CAST(length(question) AS DOUBLE) AS q_len, CAST(length(a) AS DOUBLE) AS a_len, CAST(pos AS DOUBLE) AS row_no FROM items)
  UNPIVOT (value FOR metric IN (q_len, a_len, row_no)))"""
KS3 = """cum AS (SELECT metric, value, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(v) OVER w AS cv,
  sum(a) OVER p AS na, sum(b) OVER p AS nb, sum(v) OVER p AS nv
  FROM (SELECT metric, value, count(*) FILTER (split='train') AS a, count(*) FILTER (split='test') AS b, count(*) FILTER (split='validation') AS v FROM long GROUP BY 1,2)
  WINDOW w AS (PARTITION BY metric ORDER BY value), p AS (PARTITION BY metric)),
ks AS (SELECT metric, max(abs(ca/na - cv/nv)) AS ka, max(abs(cb/nb - cv/nv)) AS kb FROM cum GROUP BY 1),
mom AS (SELECT metric, avg(value) FILTER (split='train') AS m1, avg(value) FILTER (split='test') AS m2, avg(value) FILTER (split='validation') AS m3,
  var_samp(value) FILTER (split='train') AS s1, var_samp(value) FILTER (split='test') AS s2, var_samp(value) FILTER (split='validation') AS s3 FROM long GROUP BY 1),
shift AS (SELECT metric, round((m3-m1)/sqrt((s1+s3)/2),4)+0.0 AS smd_validation_train, round(ka,4)+0.0 AS ks_validation_train,
  round((m3-m2)/sqrt((s2+s3)/2),4)+0.0 AS smd_validation_test, round(kb,4)+0.0 AS ks_validation_test FROM mom JOIN ks USING (metric))"""


def _size_splits(spark, sf):
    it = views.items(spark, sf)
    return it.select(
        F.expr("CASE WHEN pos%10<1 THEN 'validation' WHEN split='train' THEN 'train' ELSE 'test' END").alias("split"),
        F.length("question").alias("q_len"), F.length("a").alias("a_len"), F.col("pos").alias("row_no"), "lang",
    )


@query("ds4_shift_table", f"WITH {SIZE_LONG}, {KS3} SELECT * FROM shift", ("items",))
def ds4(spark, sf):
    t = ds.shift_table(_size_splits(spark, sf), "split", "validation", ["train", "test"], ["q_len", "a_len", "row_no"])
    return t.select("metric", *[(F.col(c) + F.lit(0.0)).alias(c) for c in t.columns[1:]])


@query("ds5_ks_p_value", f"""WITH {LONG}, {KS}, t AS (SELECT metric, n1 AS n_base, n2 AS n_other, (m1-m2)/sqrt((s1*s1+s2*s2)/2) AS smd, ks, ks*sqrt(n1*n2/(n1+n2)) AS x FROM mom JOIN ks USING (metric))
SELECT metric, n_base, n_other, round(smd,6)+0.0 AS smd_base_minus_other, round(ks,6)+0.0 AS ks_statistic, round(CASE WHEN x<0.2 THEN 1.0 WHEN x<1.18 THEN
  1-sqrt(2*pi())/x*(SELECT sum(exp(-((2*k-1)*(2*k-1))*pi()*pi()/(8*x*x))) FROM range(1,8) r(k)) ELSE
  2*(SELECT sum(CASE WHEN k%2=1 THEN 1 ELSE -1 END*exp(-2*k*k*x*x)) FROM range(1,101) r(k)) END,6)+0.0 AS ks_p_value FROM t""")
def ds5(spark, sf):
    return rounded(ds.numeric_tests(views.numeric_lines(spark, sf), "split", "train", "test", METRICS))


LANG = """c AS (SELECT lang, count(*) FILTER (split='train') AS a, count(*) FILTER (split='test') AS b FROM items WHERE split IN ('train','test') GROUP BY 1),
s AS (SELECT lang, a/sum(a) OVER () AS p, b/sum(b) OVER () AS q FROM c)"""


@query("ds6_total_variation", f"WITH {LANG} SELECT round(0.5*sum(abs(p-q)),6)+0.0 AS total_variation FROM s", ("items",))
def ds6(spark, sf):
    return rounded(ds.total_variation(views.items(spark, sf), "split", "train", "test", "lang"))


@query(
    "ds7_jensen_shannon",
    f"""WITH {LANG} SELECT round(sqrt(greatest(sum((CASE WHEN p>0 THEN p*log2(p/((p+q)/2)) ELSE 0 END)
  + (CASE WHEN q>0 THEN q*log2(q/((p+q)/2)) ELSE 0 END))/2, 0)),6)+0.0 AS js_distance FROM s""",
    ("items",),
)
def ds7(spark, sf):
    return rounded(ds.jensen_shannon(views.items(spark, sf), "split", "train", "test", "lang"))


def _hist_sql(bins, lo_q, hi_q):
    return f"""WITH {LONG},
e AS (SELECT metric, quantile_cont(value,{lo_q}) AS lo, quantile_cont(value,{hi_q}) AS hi FROM long GROUP BY 1),
k AS (SELECT l.metric, split, lo, hi, least(floor((least(greatest(value,lo),hi)-lo)/(hi-lo)*{bins}),{bins - 1})::INT AS bin FROM long l JOIN e USING (metric)),
c AS (SELECT metric, split, bin, count(*) AS n, any_value(lo) AS lo, any_value((hi-lo)/{bins}) AS w FROM k GROUP BY 1,2,3)
SELECT metric, split, bin, round(lo+bin*w,3)+0.0 AS edge, n, round(n/(sum(n) OVER (PARTITION BY metric, split)*w),8)+0.0 AS density FROM c"""


def _density(df):
    return df.withColumns({"edge": F.round("edge", 3) + F.lit(0.0), "density": F.round("density", 8) + F.lit(0.0)})


@query("ds8_density_histogram", _hist_sql(40, 0.005, 0.995))
def ds8(spark, sf):
    return _density(ds.density_histogram(views.numeric_lines(spark, sf), "split", METRICS, 40))


@query("ds9_three_split_histogram", f"""WITH {SIZE_LONG},
e AS (SELECT metric, quantile_cont(value,0.005) AS lo, quantile_cont(value,0.995) AS hi FROM long GROUP BY 1),
k AS (SELECT l.metric, split, lo, hi, least(floor((least(greatest(value,lo),hi)-lo)/(hi-lo)*50),49)::INT AS bin FROM long l JOIN e USING (metric)),
c AS (SELECT metric, split, bin, count(*) AS n, any_value(lo) AS lo, any_value((hi-lo)/50) AS w FROM k GROUP BY 1,2,3)
SELECT metric, split, bin, round(lo+bin*w,3)+0.0 AS edge, n, round(n/(sum(n) OVER (PARTITION BY metric, split)*w),8)+0.0 AS density FROM c""", ("items",))
def ds9(spark, sf):
    return _density(ds.density_histogram(_size_splits(spark, sf), "split", ["q_len", "a_len", "row_no"], 50))


@query("ds10_filtered_histogram", f"""WITH {LONG},
x AS (SELECT metric, quantile_cont(value,0.995) AS xmax FROM long GROUP BY 1),
f AS (SELECT l.* FROM long l JOIN x USING (metric) WHERE value <= xmax),
e AS (SELECT metric, split, min(value) AS lo, max(value) AS hi FROM f GROUP BY 1,2),
k AS (SELECT f.metric, f.split, lo, hi, least(floor((value-lo)/(hi-lo)*50),49)::INT AS bin FROM f JOIN e ON f.metric=e.metric AND f.split=e.split),
c AS (SELECT metric, split, bin, count(*) AS n, any_value(lo) AS lo, any_value((hi-lo)/50) AS w FROM k GROUP BY 1,2,3)
SELECT metric, split, bin, round(lo+bin*w,3)+0.0 AS edge, n, round(n/(sum(n) OVER (PARTITION BY metric, split)*w),8)+0.0 AS density FROM c""")
def ds10(spark, sf):
    return _density(ds.density_histogram(views.numeric_lines(spark, sf), "split", METRICS, 50, mode="filter"))


@query("ds13_acceptance_verdict", f"""WITH {SIZE_LONG}, {KS3},
c AS (SELECT lang, count(*) FILTER (s='train') AS a, count(*) FILTER (s='validation') AS b FROM (
  SELECT lang, CASE WHEN pos%10<1 THEN 'validation' WHEN split='train' THEN 'train' ELSE 'test' END AS s FROM items) GROUP BY 1),
tv AS (SELECT 0.5*sum(abs(p-q)) AS tv FROM (SELECT a/sum(a) OVER () AS p, b/sum(b) OVER () AS q FROM c))
SELECT round(ws,4) AS worst_smd, round(wk,4) AS worst_ks, round(tv,6)+0.0 AS worst_tv, (ws<0.1 AND wk<0.05 AND tv<=0.03) AS accepted FROM (
  SELECT max(greatest(abs(smd_validation_train),abs(smd_validation_test))) AS ws, max(greatest(ks_validation_train,ks_validation_test)) AS wk FROM shift), tv""", ("items",))
def ds13(spark, sf):
    df = _size_splits(spark, sf)
    shifts = ds.shift_table(df, "split", "validation", ["train", "test"], ["q_len", "a_len", "row_no"])
    out = ds.acceptance_verdict(shifts, ds.total_variation(df, "split", "train", "validation", "lang"))
    return out.select(F.round("worst_smd", 4).alias("worst_smd"), F.round("worst_ks", 4).alias("worst_ks"), r6("worst_tv").alias("worst_tv"), "accepted")


@query("ds14_imbalance_ratio", "SELECT round(max(n)/min(n),6) AS imbalance_ratio FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def ds14(spark, sf):
    return rounded(ds.imbalance_ratio(table(spark, sf, "documents"), "lang"))


# ---- text features -------------------------------------------------------------------------------------------

def _case(text, rule_list, fallback):
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{label}'" for label, p in rule_list) + f" ELSE '{fallback}' END"


def _contains_case(text, rule_list, fallback):
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{label}'" for label, words in rule_list
    ) + f" ELSE '{fallback}' END"


def _words(c):
    return f"len(regexp_extract_all({c}, '\\S+'))"


NORM = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _n(c):
    return NORM.format(c=c)


TYPE1 = _case("question", rules.PROFILE_RULES, rules.PROFILE_FALLBACK)
TYPE2 = _contains_case("question", rules.PROMPT_RULES, rules.PROMPT_FALLBACK)
TYPE3 = _case(_n("question"), rules.TEXT_RULES, rules.TEXT_FALLBACK)


@query("txt1_text_metrics", f"""SELECT split, id, length(question) AS question_chars, {_words('question')} AS question_tokens_ws,
  (length(a)+length(b)+length(c)+length(d))/4 AS choice_chars_mean, greatest(length(a),length(b),length(c),length(d)) AS choice_chars_max,
  length(a)+length(b)+length(c)+length(d) AS choice_chars_total,
  ({_words('a')}+{_words('b')}+{_words('c')}+{_words('d')})/4 AS choice_tokens_ws_mean, {TYPE1} AS question_type,
  length(a) AS choice_a_chars, length(b) AS choice_b_chars, length(c) AS choice_c_chars, length(d) AS choice_d_chars FROM kitems""", ("kitems",))
def txt1(spark, sf):
    return pf.text_metrics(views.korean_items(spark, sf))


def _ratio(p):
    q = _n("question")
    return f"CASE WHEN length({q})=0 THEN 0.0 ELSE len(regexp_extract_all({q}, '{p}'))/length({q}) END"


@query("txt2_script_ratios", f"""SELECT id, round({_ratio('[가-힣]')},6) AS question_korean_ratio, round({_ratio('[A-Za-z]')},6) AS question_english_ratio,
  round({_ratio('[0-9]')},6) AS question_digit_ratio FROM kitems""", ("kitems",))
def txt2(spark, sf):
    t = pf.text_features(views.korean_items(spark, sf))
    return rounded(t.select("id", "question_korean_ratio", "question_english_ratio", "question_digit_ratio"))


@query("txt3_flags", "SELECT id, regexp_matches(question,'[0-9]') AS question_has_digit, contains(question,'?') AS question_has_question_mark FROM kitems", ("kitems",))
def txt3(spark, sf):
    return pf.text_features(views.korean_items(spark, sf)).select("id", "question_has_digit", "question_has_question_mark")


OPT = "SELECT *, " + ", ".join(f"length({_n(c)}) AS n{c}" for c in CHOICES) + " FROM items"


@query("txt4_option_lengths", f"""SELECT id, (na+nb+nc+nd)/4 AS option_char_mean, least(na,nb,nc,nd) AS option_char_min,
  greatest(na,nb,nc,nd) AS option_char_max, greatest(na,nb,nc,nd)-least(na,nb,nc,nd) AS option_char_range FROM ({OPT})""", ("items",))
def txt4(spark, sf):
    t = pf.text_features(views.items(spark, sf))
    return t.select("id", "option_char_mean", "option_char_min", "option_char_max", "option_char_range")


NUMLIKE = "'(?i)^[0-9\\s.,:%+\\-~/₩$€£원개명시분초cmkgmlL]+$'"


@query("txt5_numeric_option_count", "SELECT id, " + "+".join(f"CAST(regexp_matches({_n(c)}, {NUMLIKE}) AS INT)" for c in CHOICES) + " AS numeric_option_count FROM items", ("items",))
def txt5(spark, sf):
    return pf.text_features(views.items(spark, sf)).select("id", "numeric_option_count")


@query("txt6_profile_question_type", f"SELECT id, {TYPE1} AS question_type FROM kitems", ("kitems",))
def txt6(spark, sf):
    return views.korean_items(spark, sf).select("id", rules.profile_type(F.col("question")).alias("question_type"))


@query("txt7_prompt_question_type", f"SELECT id, {TYPE2} AS qtype FROM kitems", ("kitems",))
def txt7(spark, sf):
    return views.korean_items(spark, sf).select("id", rules.prompt_type(F.col("question")).alias("qtype"))


@query("txt8_text_question_type", f"SELECT id, {TYPE3} AS question_type FROM kitems", ("kitems",))
def txt8(spark, sf):
    return pf.text_features(views.korean_items(spark, sf)).select("id", "question_type")


UD4_RULES = [("table", r"\|"), ("short", r"^\S{1,4}\s"), ("has_the", r"[Tt]he"), ("numbers", r"[0-9]")]


@query("ud4_rule_list_column", "SELECT lang, kind, count(*) AS n FROM (SELECT lang, " + _case("text", UD4_RULES, "plain") + " AS kind FROM documents) GROUP BY 1,2")
def ud4(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy("lang", rules.pattern_label(F.col("text"), UD4_RULES, "plain").alias("kind")).agg(F.count("*").alias("n"))


@query("txt9_top_prefixes", f"SELECT substring({_n('question')},1,12) AS prefix, count(*) AS n FROM kitems GROUP BY 1 ORDER BY n DESC, prefix LIMIT 30", ("kitems",))
def txt9(spark, sf):
    return pf.top_prefixes(pf.normalize_columns(views.korean_items(spark, sf), ["question"]), "question_norm")


STOP = ",".join(f"'{w}'" for w in rules.STOP_WORDS)


@query("txt10_top_tokens", f"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(concat(CASE doc_id%13 WHEN 1 THEN '전화번호는 무엇 ' ELSE '' END, text)), '[가-힣A-Za-z0-9]+')) AS token FROM documents)
WHERE length(token)>1 AND token NOT IN ({STOP}) GROUP BY 1 ORDER BY n DESC, token LIMIT 40""")
def txt10(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.concat(F.when(F.col("doc_id") % 13 == 1, "전화번호는 무엇 ").otherwise(""), F.col("text")).alias("text")
    )
    return pf.top_tokens(docs, "text")


@query("txt11_top_words", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[가-힣A-Za-z]+')) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 30")
def txt11(spark, sf):
    return pf.top_words(table(spark, sf, "documents"), "text")


def _grams(c):
    t = f"lower(regexp_replace({c}, '\\s+', '', 'g'))"
    return f"CASE WHEN length({t})=0 THEN [] WHEN length({t})<2 THEN [{t}] ELSE list_distinct(list_transform(range(1, length({t})), lambda i: substring({t}, i, 2))) END"


@query("txt12_ngram_sets", "SELECT id, gram FROM (SELECT id, unnest(" + _grams("a") + ") AS gram FROM items)", ("items",))
def txt12(spark, sf):
    return pf.normalize_columns(views.items(spark, sf), ["a"]).select("id", F.explode(tx.ngram_set(F.col("a_norm"))).alias("gram"))


def _jac(x, y):
    return (f"CASE WHEN len(g{x})=0 AND len(g{y})=0 THEN 1.0 ELSE len(list_intersect(g{x},g{y}))"
            f"/greatest(len(list_distinct(list_concat(g{x},g{y}))),1) END")


GRAMS = "g AS (SELECT id, split, " + ", ".join(f"{_grams(c)} AS g{c}" for c in CHOICES) + " FROM items)"
PAIRS = [(x, y) for i, x in enumerate(CHOICES) for y in CHOICES[i + 1:]]
SIMS = GRAMS + ", sims AS (SELECT id, split, " + ", ".join(f"{_jac(x, y)} AS {x}{y}" for x, y in PAIRS) + " FROM g)"
SIM_COLS = [x + y for x, y in PAIRS]


@query("txt13_ngram_jaccard", f"WITH {SIMS} SELECT id, round(ab,6)+0.0 AS similarity FROM sims", ("items",))
def txt13(spark, sf):
    sim = tx.jaccard(tx.ngram_set(F.col("a_norm")), tx.ngram_set(F.col("b_norm")))
    return pf.normalize_columns(views.items(spark, sf), ["a", "b"]).select("id", r6(sim).alias("similarity"))


@query("txt14_option_similarity", f"WITH {SIMS} SELECT id, round(({'+'.join(SIM_COLS)})/6,6)+0.0 AS option_similarity_mean, round(greatest({','.join(SIM_COLS)}),6)+0.0 AS option_similarity_max FROM sims", ("items",))
def txt14(spark, sf):
    t = pf.option_similarity(views.items(spark, sf))
    return rounded(t.select("id", "option_similarity_mean", "option_similarity_max"))


def _ov(c):
    g = "CASE answer WHEN 'a' THEN a WHEN 'b' THEN b WHEN 'c' THEN c ELSE d END"
    la, lb = (f"list_filter(list_distinct(string_split({v}, '')), lambda ch: ch<>'')" for v in (g, c))
    return f"CASE WHEN answer<>'{c}' THEN len(list_intersect({la},{lb}))/greatest(len(list_distinct(list_concat({la},{lb}))),1) ELSE -1 END"


@query("txt15_gold_distractor_overlap", "SELECT split, round(avg(o),6) AS mean_overlap, count(*) AS n FROM (SELECT split, greatest(" + ",".join(_ov(c) for c in CHOICES) + ") AS o FROM items) GROUP BY 1", ("items",))
def txt15(spark, sf):
    t = pf.gold_overlap(views.items(spark, sf))
    return t.groupBy("split").agg(F.round(F.avg("gold_overlap"), 6).alias("mean_overlap"), F.count("*").alias("n"))


OVERVIEW = """SELECT (sum(length(a)+length(b)+length(c)+length(d))/(4*count(*))) AS choice_len_mean,
  max(greatest(length(a),length(b),length(c),length(d))) AS choice_len_max,
  sum(regexp_matches(a,'[0-9]')::INT+regexp_matches(b,'[0-9]')::INT+regexp_matches(c,'[0-9]')::INT+regexp_matches(d,'[0-9]')::INT)/(4*count(*)) AS digit_share,
  count(*) FILTER (len(list_distinct([a,b,c,d]))<4) AS duplicate_choice_rows,
  count(*) FILTER (contains(question,a) OR contains(question,b) OR contains(question,c) OR contains(question,d)) AS choice_in_question_rows FROM items"""


@query("txt16_duplicate_choice_rows", f"SELECT duplicate_choice_rows FROM ({OVERVIEW})", ("items",))
def txt16(spark, sf):
    return pf.choice_overview(views.items(spark, sf)).select("duplicate_choice_rows")


@query("txt17_choice_in_question_rows", f"SELECT choice_in_question_rows FROM ({OVERVIEW})", ("items",))
def txt17(spark, sf):
    return pf.choice_overview(views.items(spark, sf)).select("choice_in_question_rows")


@query("txt18_choice_digit_share", f"SELECT round(digit_share,6) AS digit_share FROM ({OVERVIEW})", ("items",))
def txt18(spark, sf):
    return rounded(pf.choice_overview(views.items(spark, sf)).select("digit_share"))


@query("txt19_choice_length", f"SELECT round(choice_len_mean,6) AS choice_len_mean, choice_len_max FROM ({OVERVIEW})", ("items",))
def txt19(spark, sf):
    return rounded(pf.choice_overview(views.items(spark, sf)).select("choice_len_mean", "choice_len_max"))


@query("txt20_answer_length_artifact", f"""SELECT id, g AS answer_char_len, round((na+nb+nc+nd-g)/3,6)+0.0 AS wrong_char_mean, round(g-(na+nb+nc+nd-g)/3,6)+0.0 AS answer_minus_wrong_len
FROM (SELECT *, CASE answer WHEN 'a' THEN na WHEN 'b' THEN nb WHEN 'c' THEN nc ELSE nd END AS g FROM ({OPT}))""", ("items",))
def txt20(spark, sf):
    t = pf.answer_length_artifact(pf.normalize_columns(views.items(spark, sf)), "_norm")
    return rounded(t.select("id", "answer_char_len", "wrong_char_mean", "answer_minus_wrong_len"))


@query("txt21_longest_rows", "SELECT id, text_len FROM (SELECT id, length(question)+length(a)+length(b)+length(c)+length(d) AS text_len FROM kitems) ORDER BY text_len DESC, id LIMIT 4", ("kitems",))
def txt21(spark, sf):
    t = pf.total_text_length(views.korean_items(spark, sf))
    return t.select("id", "text_len").orderBy(F.desc("text_len"), "id").limit(4)


@query("txt22_has_digit", "SELECT id, regexp_matches(question,'[0-9]') AS has_digit FROM kitems", ("kitems",))
def txt22(spark, sf):
    return views.korean_items(spark, sf).select("id", tx.has_digit(F.col("question")).alias("has_digit"))


# ---- counts, cross tables, summaries ---------------------------------------------------------------------------

@query("ag1_value_counts", "SELECT l.answer, coalesce(n,0) AS n, round(coalesce(n,0)/(SELECT count(*) FROM items ),6) AS share FROM (VALUES ('a'),('b'),('c'),('d')) l(answer) LEFT JOIN (SELECT answer, count(*) AS n FROM items  GROUP BY 1) USING (answer)", ("items",))
def ag1(spark, sf):
    return rounded(pf.value_counts(views.items(spark, sf), "answer", CHOICES))


@query("ag2_category_by_split", f"""SELECT question_type, n_train, n_test, n_dev, round(n_train/sum(n_train) OVER ()*100,6) AS pct_train, round(n_test/sum(n_test) OVER ()*100,6) AS pct_test, round(n_dev/sum(n_dev) OVER ()*100,6) AS pct_dev FROM (
  SELECT {TYPE1} AS question_type, count(*) FILTER (split='train') AS n_train, count(*) FILTER (split='test') AS n_test, count(*) FILTER (split='dev') AS n_dev FROM kitems GROUP BY 1)""", ("kitems",))
def ag2(spark, sf):
    t = views.korean_items(spark, sf).withColumn("question_type", rules.profile_type(F.col("question")))
    return rounded(pf.cross_table(t, "question_type", "split", SPLITS))


@query("ag3_share_table", """SELECT source, round(a/sum(a) OVER ()*100,2) AS pct_train, round(b/sum(b) OVER ()*100,2) AS pct_test, round(c/sum(c) OVER ()*100,2) AS pct_dev FROM (
  SELECT source, count(*) FILTER (split='train') AS a, count(*) FILTER (split='test') AS b, count(*) FILTER (split='dev') AS c FROM items GROUP BY 1)""", ("items",))
def ag3(spark, sf):
    return ds.share_table(views.items(spark, sf), "split", SPLITS, "source")


@query("ag4_margin_table", """SELECT CASE WHEN grouping(x)=1 THEN 'All' ELSE CAST(x AS VARCHAR) END AS has_the, CASE WHEN grouping(y)=1 THEN 'All' ELSE CAST(y AS VARCHAR) END AS has_digit, count(*) AS n
FROM (SELECT contains(text,'the') AS x, regexp_matches(text,'[0-9]') AS y FROM documents) GROUP BY CUBE (x,y)""")
def ag4(spark, sf):
    t = table(spark, sf, "documents").select(F.col("text").contains("the").alias("has_the"), F.col("text").rlike("[0-9]").alias("has_digit"))
    return pf.margin_table(t, "has_the", "has_digit")


@query("ag7_in_split_duplicates", f"""SELECT split, sum(CASE WHEN q=1 THEN n-1 ELSE 0 END)::BIGINT AS duplicate_questions, sum(CASE WHEN q=0 THEN n-1 ELSE 0 END)::BIGINT AS duplicate_problems FROM (
  SELECT split, 1 AS q, {_n('question')} AS k, count(*) AS n FROM items GROUP BY ALL
  UNION ALL SELECT split, 0, concat_ws(' || ',{','.join(_n(c) for c in ('question',)+tuple(CHOICES))}), count(*) FROM items GROUP BY ALL) GROUP BY 1""", ("items",))
def ag7(spark, sf):
    return qc.in_split_duplicates(pf.normalize_columns(views.items(spark, sf)), "split")


@query("ag8_repeated_questions", "SELECT question, count(*) AS n, (SELECT count(DISTINCT question) FROM items) AS distinct_questions FROM items GROUP BY 1 ORDER BY n DESC, question LIMIT 5", ("items",))
def ag8(spark, sf):
    it = views.items(spark, sf)
    return pf.repeated_values(it, "question").withColumn("distinct_questions", it.agg(F.countDistinct("question")).scalar())


@query("ag12_describe", f"""WITH {SIZE_LONG} SELECT metric, split, count(*) AS count, round(avg(value),6)+0.0 AS mean, round(stddev_samp(value),6)+0.0 AS std, min(value) AS min,
  round(quantile_cont(value,0.25),6) AS p25, round(quantile_cont(value,0.5),6) AS median, round(quantile_cont(value,0.75),6) AS p75, max(value) AS max FROM long GROUP BY 1,2""", ("items",))
def ag12(spark, sf):
    return rounded(ds.describe_splits(_size_splits(spark, sf), "split", ["train", "test", "validation"], ["q_len", "a_len", "row_no"]), "min", "max")


@query("ag13_upper_quantile_summary", f"""WITH {LONG} SELECT split, metric, round(avg(value),6)+0.0 AS mean, round(stddev_samp(value),6)+0.0 AS std, round(quantile_cont(value,0.5),6) AS median,
  round(quantile_cont(value,0.9),6) AS p90, round(quantile_cont(value,0.99),6) AS p99 FROM long GROUP BY 1,2""")
def ag13(spark, sf):
    p = ds.metric_profile(views.numeric_lines(spark, sf), "split", ["train", "test"], METRICS, {"median": 0.5, "p90": 0.9, "p99": 0.99})
    return rounded(ds.numeric_summary(p, ["train", "test"], ["mean", "std", "median", "p90", "p99"]))


@query("ag14_image_size_overview", """SELECT split, """ + ", ".join(f"round(quantile_cont({d},{q}),6) AS {d}_{n}" for d in ("width", "height") for n, q in (("p5", .05), ("p50", .5), ("p95", .95))) + """,
  round(avg((greatest(width,height)>1500)::INT),6) AS share_over_1500, round(avg((greatest(width,height)>2500)::INT),6) AS share_over_2500 FROM sizes GROUP BY 1""", ("sizes",))
def ag14(spark, sf):
    return rounded(pf.image_size_overview(views.sizes(spark, sf), "split", ["train", "test"]))


@query("ag15_top_combinations", """WITH c AS (SELECT concat(l_returnflag,'x',CAST(l_linenumber AS VARCHAR)) AS combination, count(*) FILTER (l_linestatus='F') AS a, count(*) FILTER (l_linestatus<>'F') AS b FROM lineitem GROUP BY 1)
SELECT combination, round(a/(SELECT sum(a) FROM c)*100,2) AS pct_train, round(b/(SELECT sum(b) FROM c)*100,2) AS pct_test FROM c ORDER BY a DESC, combination LIMIT 10""")
def ag15(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("split", F.when(F.col("l_linestatus") == "F", "train").otherwise("test"))
    return pf.top_combinations(li, "l_returnflag", "l_linenumber", "split", ["train", "test"], "train")


@query("ag16_melted_means", f"WITH {LONG} SELECT split, metric AS channel, round(avg(value),6)+0.0 AS mean_value FROM long GROUP BY 1,2")
def ag16(spark, sf):
    return rounded(pf.melted_means(views.numeric_lines(spark, sf), "split", METRICS))


@query("wn1_cumulative_distribution", f"""WITH {LONG} SELECT metric, value, round(sum(n) OVER (PARTITION BY metric ORDER BY value)/sum(n) OVER (PARTITION BY metric),6) AS cdf
FROM (SELECT metric, value, count(*) AS n FROM long GROUP BY 1,2)""")
def wn1(spark, sf):
    from itemloom.operators.ordering import numeric_bucket, running_sums

    long = ds.long_metrics(views.numeric_lines(spark, sf), METRICS, ["split"])
    counts = long.groupBy("metric", "value").agg(F.count("*").alias("n"))
    cum = running_sums(counts, ["metric"], ["value"], {"c": "n"}, numeric_bucket(long, "value", by="metric"), few_groups=True)
    totals = long.groupBy("metric").agg(F.count("*").alias("total"))
    return cum.join(F.broadcast(totals), "metric").select("metric", "value", F.round(F.col("c") / F.col("total"), 6).alias("cdf"))


@query("so2_largest_shift", f"""WITH {LONG}, {KS} SELECT metric, round((m2-m1)/sqrt((s1*s1+s2*s2)/2),6)+0.0 AS smd FROM mom ORDER BY abs((m2-m1)/sqrt((s1*s1+s2*s2)/2)) DESC LIMIT 3""")
def so2(spark, sf):
    p = ds.metric_profile(views.numeric_lines(spark, sf), "split", ["train", "test"], METRICS, {})
    return p.select("metric", ds.smd("train", "test").alias("smd")).orderBy(F.desc(F.abs("smd"))).limit(3).select("metric", r6("smd").alias("smd"))


@query("so5_preview", "SELECT pos, id, question, a, answer FROM items ORDER BY pos LIMIT 5", ("items",))
def so5(spark, sf):
    return views.items(spark, sf).select("pos", "id", "question", "a", "answer").orderBy("pos").limit(5)


# ---- projections ------------------------------------------------------------------------------------------------

@query("prj7_normalize_text", f"SELECT doc_id, {_n('text')} AS text FROM documents")
def prj7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


# the given texts are in compatibility form already, so SQL can state the expected result
@query("ud3_nfkc_normalizer", "SELECT doc_id, text FROM documents")
def ud3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.nfkc(F.col("text")).alias("text"))


@query("prj8_compact_key", "SELECT doc_id, lower(regexp_replace(url, '[^0-9A-Za-z]+', '', 'g')) AS key FROM (SELECT page_id AS doc_id, url FROM pages)")
def prj8(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), tx.compact_key(F.col("url")).alias("key"))


@query("prj9_safe_name", "SELECT page_id, regexp_replace(url, '[^0-9A-Za-z_\\-]', '_', 'g') AS name FROM pages")
def prj9(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query("prj12_problem_text", "SELECT id, concat(question,' [A] ',a,' [B] ',b,' [C] ',c,' [D] ',d) AS full_text FROM items", ("items",))
def prj12(spark, sf):
    return views.items(spark, sf).select("id", tx.problem_text().alias("full_text"))


@query("prj13_problem_signature", f"SELECT id, concat_ws(' || ',{','.join(_n(c) for c in ('question',)+tuple(CHOICES))}) AS problem_signature FROM items", ("items",))
def prj13(spark, sf):
    t = pf.normalize_columns(views.items(spark, sf))
    return t.select("id", tx.problem_signature("question_norm", [f"{c}_norm" for c in CHOICES]).alias("problem_signature"))
