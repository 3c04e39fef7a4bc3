"""Queries for annotator votes, model output and model comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from itemloom import CHOICES
from itemloom.catalog import views
from itemloom.catalog.base import query, table
from itemloom.catalog.profile_queries import TYPE1, r6, rounded
from itemloom.functions import probs as pr, rules
from itemloom.operators import distribution as ds, evaluation as ev, predictions as pd_, profile as pf, quality as qc, votes as vt

ANNOTATORS = range(1, 6)
ANSWERS = [f"answer{k}" for k in ANNOTATORS]


def wide_votes(spark, sf):
    return vt.pivot_votes(views.votes(spark, sf), "item_id", "annotator", "vote", ANNOTATORS)


ENT = "round(CASE WHEN n>0 THEN -(" + "+".join(f"CASE WHEN n_{c}>0 THEN n_{c}/n*log2(n_{c}/n) ELSE 0 END" for c in CHOICES) + ") END,6)+0.0"
TOP = "greatest(n_a,n_b,n_c,n_d)"
TIED = "+".join(f"(n_{c}={TOP})::INT" for c in CHOICES)

VF = f"""f AS (SELECT item_id, n AS vote_count, {TOP} AS top_vote_count, CASE WHEN n>0 THEN ({TIED})>1 ELSE FALSE END AS is_tie,
  round(CASE WHEN n>0 THEN {TOP}/n END,6) AS consensus_ratio, {ENT} AS vote_entropy,
  (n_a>0)::INT+(n_b>0)::INT+(n_c>0)::INT+(n_d>0)::INT AS n_unique_votes,
  CASE WHEN n>0 THEN concat_ws('/', CASE WHEN n_a={TOP} THEN 'a' END, CASE WHEN n_b={TOP} THEN 'b' END, CASE WHEN n_c={TOP} THEN 'c' END, CASE WHEN n_d={TOP} THEN 'd' END) END AS joined,
  concat('', n_a,':',n_b,':',n_c,':',n_d) AS counts,
  CASE WHEN n>0 THEN CASE {TOP} WHEN n_a THEN 'a' WHEN n_b THEN 'b' WHEN n_c THEN 'c' ELSE 'd' END ELSE 'a' END AS lowest,
  list_aggregate(list_transform(list_reverse_sort(list_filter([n_a,n_b,n_c,n_d], lambda x: x>0)), lambda x: CAST(x AS VARCHAR)), 'string_agg', ':') AS pattern,
  n_a, n_b, n_c, n_d FROM vote_counts)"""
FIRST = """first_of AS (SELECT item_id, arg_min(vote, -n*1000 + fst) AS majority FROM (
  SELECT item_id, vote, count(*) AS n, min(annotator) AS fst FROM votes WHERE vote IS NOT NULL GROUP BY 1,2) GROUP BY 1)"""


@query("vt1_vote_features", f"""WITH {VF}, {FIRST} SELECT f.item_id, vote_count, top_vote_count, majority AS majority_answer, is_tie, consensus_ratio, vote_entropy
FROM f LEFT JOIN first_of USING (item_id)""", ("vote_counts",))
def vt1(spark, sf):
    t = vt.vote_features(wide_votes(spark, sf), ANSWERS)
    return rounded(t.select("item_id", "vote_count", "top_vote_count", "majority_answer", "is_tie", "consensus_ratio", "vote_entropy"))


@query("vt2_normalized_vote_features", f"WITH {VF} SELECT item_id, vote_count, top_vote_count, n_unique_votes, is_tie, joined AS majority_answer, consensus_ratio, vote_entropy FROM f", ("vote_counts",))
def vt2(spark, sf):
    t = vt.vote_features(wide_votes(spark, sf), ANSWERS, tie="joined", restrict=True)
    return rounded(t.select("item_id", "vote_count", "top_vote_count", "n_unique_votes", "is_tie", "majority_answer", "consensus_ratio", "vote_entropy"))


@query("vt3_vote_vector", f"WITH {VF} SELECT item_id, n_a, n_b, n_c, n_d, lowest AS human_answer FROM f", ("vote_counts",))
def vt3(spark, sf):
    t = vt.with_patterns(vt.vote_vector(wide_votes(spark, sf)))
    return t.select("item_id", *[F.element_at("votes", i + 1).alias(f"n_{c}") for i, c in enumerate(CHOICES)], "human_answer")


@query("vt5_vote_string", f"WITH {VF} SELECT item_id, n_a, n_b, n_c, n_d FROM f", ("vote_counts",))
def vt5(spark, sf):
    w = wide_votes(spark, sf)
    letters = F.concat_ws("|", *[F.upper(c) for c in ANSWERS])
    # a single letter has no separator, so those items use the mapping form
    text = F.when(letters.contains("|"), letters).when(letters == "", "").otherwise(F.concat(F.lit("{'"), letters, F.lit("': 1}")))
    v = vt.parse_vote_string(text)
    return w.select("item_id", *[F.element_at(v, i + 1).alias(f"n_{c}") for i, c in enumerate(CHOICES)])


@query("vt4_detected_votes", "SELECT layout, item_id, n_a, n_b, n_c, n_d FROM vote_counts, (VALUES ('annotators'), ('counts'), ('string'), ('mapping')) l(layout)", ("vote_counts",))
def vt4(spark, sf):
    """The same votes in four layouts, whose columns are found by name."""
    wide = wide_votes(spark, sf)
    letters = F.filter(F.array(*ANSWERS), lambda v: v.isNotNull())
    each = [F.size(letters) - F.size(F.array_remove(letters, c)) for c in CHOICES]
    mapping = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f"'{c}': "), n.cast("string")) for c, n in zip(CHOICES, each)]), F.lit("}"))
    layouts = {
        "annotators": wide, "counts": wide.select("item_id", *[n.alias(f"{c}_votes") for c, n in zip(CHOICES, each)]),
        "string": wide.select("item_id", F.concat(F.array_join(letters, "|"), F.lit("|")).alias("human_votes")), "mapping": wide.select("item_id", mapping.alias("vote_dist")),
    }
    out = None
    for name, frame in layouts.items():
        counts = vt.vote_vector(frame).select(F.lit(name).alias("layout"), "item_id", *[F.element_at("votes", i + 1).cast("long").alias(f"n_{c}") for i, c in enumerate(CHOICES)])
        out = counts if out is None else out.unionByName(counts)
    return out


@query("vt6_vote_pattern", f"WITH {VF} SELECT item_id, coalesce(pattern,'') AS vote_pattern FROM f", ("vote_counts",))
def vt6(spark, sf):
    return vt.with_patterns(vt.vote_vector(wide_votes(spark, sf))).select("item_id", "vote_pattern")


@query("vt7_keep_patterns", f"WITH {VF} SELECT item_id, pattern AS vote_pattern, lowest AS human_answer, TRUE AS top_unique FROM f WHERE pattern IN ('3','4','3:1','3:1:1')", ("vote_counts",))
def vt7(spark, sf):
    t = vt.keep_patterns(vt.with_patterns(vt.vote_vector(wide_votes(spark, sf))), ["3", "4", "3:1", "3:1:1"])
    return t.select("item_id", "vote_pattern", "human_answer", "top_unique")


@query("vt8_agreement_distribution", f"""WITH {VF} SELECT measure, value, count(*) AS n FROM (
  SELECT 'top_vote_count' AS measure, CAST(top_vote_count AS DOUBLE) AS value FROM f UNION ALL SELECT 'consensus_ratio', consensus_ratio FROM f
  UNION ALL SELECT 'n_unique_votes', CAST(n_unique_votes AS DOUBLE) FROM f) GROUP BY 1,2""", ("vote_counts",))
def vt8(spark, sf):
    return vt.agreement_distribution(vt.vote_features(wide_votes(spark, sf), ANSWERS, tie="joined", restrict=True))


@query("wn3_majority_and_ties", f"WITH {VF} SELECT is_tie, joined AS majority_answer, count(*) AS n FROM f GROUP BY 1,2", ("vote_counts",))
def wn3(spark, sf):
    t = vt.vote_features(wide_votes(spark, sf), ANSWERS, tie="joined", restrict=True)
    return t.groupBy("is_tie", "majority_answer").agg(F.count("*").alias("n"))


AMB = f"""{VF}, k AS (SELECT CAST(doc_id AS BIGINT) AS item_id, {TYPE1.replace('question', 'q')} AS question_type, length(q) AS qlen, length(a) AS alen FROM (
  SELECT pos AS doc_id, question AS q, a FROM kitems)), m AS (SELECT * FROM k JOIN f USING (item_id))"""


def ambiguity(spark, sf):
    votes = vt.vote_features(wide_votes(spark, sf), ANSWERS)
    it = views.korean_items(spark, sf).select(
        F.col("pos").alias("item_id"), rules.profile_type(F.col("question")).alias("question_type"),
        F.length("question").alias("qlen"), F.length("a").alias("alen"),
    )
    return it.join(votes, "item_id")


@query("ag10_ambiguity_by_type", f"""WITH {AMB} SELECT question_type, count(*) AS n, round(avg(vote_entropy),4)+0.0 AS vote_entropy_mean, round(avg(consensus_ratio),4)+0.0 AS consensus_mean, round(avg(qlen),4) AS question_length_mean
FROM m GROUP BY 1 ORDER BY 3 DESC""", ("kitems", "vote_counts"))
def ag10(spark, sf):
    return ambiguity(spark, sf).groupBy("question_type").agg(
        F.count("*").alias("n"), (F.round(F.avg("vote_entropy"), 4) + F.lit(0.0)).alias("vote_entropy_mean"),
        (F.round(F.avg("consensus_ratio"), 4) + F.lit(0.0)).alias("consensus_mean"), F.round(F.avg("qlen"), 4).alias("question_length_mean"),
    ).orderBy(F.desc("vote_entropy_mean"))


def _rank(x, t):
    return f"rank() OVER (PARTITION BY feature ORDER BY {x}) + (count(*) OVER (PARTITION BY feature, {x}) - 1)/2"


@query("ds11_rank_correlation", f"""WITH {AMB}, l AS (SELECT feature, x, vote_entropy, consensus_ratio FROM (SELECT CAST(qlen AS DOUBLE) AS qlen, CAST(alen AS DOUBLE) AS alen, vote_entropy, consensus_ratio FROM m WHERE vote_entropy IS NOT NULL)
  UNPIVOT (x FOR feature IN (qlen, alen))),
r AS (SELECT feature, {_rank('x','')} AS rx, {_rank('vote_entropy','')} AS re, {_rank('consensus_ratio','')} AS rc FROM l)
SELECT feature, round(corr(rx,re),6)+0.0 AS rho_vote_entropy, round(corr(rx,rc),6)+0.0 AS rho_consensus_ratio FROM r GROUP BY 1""", ("kitems", "vote_counts"))
def ds11(spark, sf):
    m = ambiguity(spark, sf).withColumns({"vote_entropy": r6("vote_entropy"), "consensus_ratio": r6("consensus_ratio")})
    return rounded(ds.rank_correlation(m, ["qlen", "alen"], ["vote_entropy", "consensus_ratio"]))


@query("ss2_vote_tally", """SELECT item_id, vote, date_trunc('day', ts) AS day, count(*) AS n FROM votes WHERE vote IS NOT NULL GROUP BY ALL""", ("votes",))
def ss2_batch(spark, sf):
    from itemloom.streaming.incremental import vote_tally

    return vote_tally(views.votes(spark, sf)).select("item_id", "vote", F.col("window.start").alias("day"), "n")


# ---- model output -----------------------------------------------------------------------------------------------

def model_a(spark, sf):
    return pd_.average_runs(views.probs(spark, sf).filter("run < 8"), keep=["gold", "label"])


def model_b(spark, sf):
    return pd_.average_runs(views.probs(spark, sf).filter("run >= 8"), keep=["gold", "label"])


def variants(spark, sf):
    p = views.probs(spark, sf).withColumn("variant", F.concat(F.lit("v"), F.floor(F.col("run") / 4).cast("string")))
    means = F.array(*[F.avg(pr.slot(F.col("probs"), i)) for i in range(4)])
    return p.groupBy("id", "variant").agg(F.first("gold").alias("gold"), means.alias("probs"))


def models(spark, sf):
    p = views.probs(spark, sf).withColumn("model", F.when(F.col("run") < 8, "A").otherwise("B"))
    means = F.array(*[F.avg(pr.slot(F.col("probs"), i)) for i in range(4)])
    out = p.groupBy("id", "model").agg(F.first("gold").alias("gold"), F.first("label").alias("label"), means.alias("probs"))
    return ev.graded(out)


VARIANTS = ["v0", "v1", "v2", "v3"]
P4 = [f"p_{c}" for c in CHOICES]


def _spread(df, *cols):
    return df.select(*cols, *[r6(pr.slot(F.col("probs"), i)).alias(f"p_{c}") for i, c in enumerate(CHOICES)])


def _r4(prefix=""):
    return ", ".join(f"round({prefix}{p},6)+0.0 AS {p}" for p in P4)


@query("mo1_permutation_fan_out", """WITH o(run, o1, o2, o3, o4) AS (VALUES (0,0,1,2,3),(1,1,3,0,2),(2,2,0,3,1),(3,3,2,1,0),(4,0,1,3,2),(5,0,2,1,3))
SELECT id, run, x[o1+1] AS s1, x[o2+1] AS s2, x[o3+1] AS s3, x[o4+1] AS s4 FROM (SELECT id, [a,b,c,d] AS x FROM items), o""", ("items",))
def mo1(spark, sf):
    t = pd_.fan_out_orders(views.items(spark, sf), pr.display_orders(6))
    return t.select("id", "run", *[F.element_at("shown", i).alias(f"s{i}") for i in range(1, 5)])


@query("mo2_cyclic_fan_out", """SELECT id, run, x[(0+s)%4+1] AS s1, x[(1+s)%4+1] AS s2, x[(2+s)%4+1] AS s3, x[(3+s)%4+1] AS s4
FROM (SELECT id, [a,b,c,d] AS x FROM items), (VALUES (0,0),(1,2),(2,1),(3,3)) AS o(run,s)""", ("items",))
def mo2(spark, sf):
    t = pd_.fan_out_orders(views.items(spark, sf), pr.shift_orders())
    return t.select("id", "run", *[F.element_at("shown", i).alias(f"s{i}") for i in range(1, 5)])


@query("mo3_unpermute", f"""SELECT id, run, {', '.join(f'round(CASE run%2 WHEN 0 THEN {x} ELSE {y} END,6)+0.0 AS p_{c}' for c, x, y in zip('abcd', P4, ('p_c','p_a','p_d','p_b')))} FROM probs""", ("probs",))
def mo3(spark, sf):
    bank = F.when(F.col("run") % 2 == 0, F.array(*map(F.lit, (0, 1, 2, 3)))).otherwise(F.array(*map(F.lit, (1, 3, 0, 2))))
    t = views.probs(spark, sf).withColumn("probs", pr.unpermute(F.col("probs"), bank))
    return _spread(t, "id", "run")


@query("mo5_softmax", f"SELECT id, run, {_r4()} FROM probs", ("probs",))
def mo5(spark, sf):
    return _spread(views.probs(spark, sf), "id", "run")


@query("mo6_average_runs", f"SELECT id, {_r4()} FROM models WHERE model='A'", ("models",))
def mo6(spark, sf):
    return _spread(model_a(spark, sf), "id")


@query("src4_probability_runs", f"SELECT id, run, {_r4()} FROM probs WHERE run<8 UNION ALL SELECT id, 0, {_r4()} FROM models WHERE model='B'", ("models",))
def src4(spark, sf):
    from itemloom.sources.readers import as_runs

    many = as_runs(views.probs(spark, sf).filter("run < 8").select("id", "run", "probs"))
    single = as_runs(model_b(spark, sf).select("id", "probs"))
    return _spread(many.unionByName(single), "id", "run")


@query("mo7_uncertainty", "SELECT id, round(confidence,6)+0.0 AS confidence, round(margin,6)+0.0 AS margin, round(entropy,6)+0.0 AS entropy, round(agreement,6)+0.0 AS agreement, round(unc_score,6)+0.0 AS unc_score FROM uncertain", ("uncertain",))
def mo7(spark, sf):
    t = pd_.uncertainty(model_a(spark, sf))
    return rounded(t.select("id", "confidence", "margin", "entropy", "agreement", "unc_score"))


@query("mo17_margin_and_agreement", "SELECT id, round(margin,6)+0.0 AS margin, round(agreement,6)+0.0 AS agreement FROM uncertain", ("uncertain",))
def mo17(spark, sf):
    return rounded(pd_.uncertainty(model_a(spark, sf)).select("id", "margin", "agreement"))


def prediction_rows(spark, sf):
    return pd_.prediction_table(model_a(spark, sf))


@query("mo8_prediction_table", f"SELECT id, answer, {_r4()}, round(unc_score,6)+0.0 AS unc_score, label FROM uncertain", ("uncertain",))
def mo8(spark, sf):
    return rounded(prediction_rows(spark, sf).select("id", "answer", *P4, "unc_score", "label"))


REPORT = """t AS (SELECT *, (answer=gold)::INT AS ok, CASE WHEN unc_score >= (SELECT quantile_cont(unc_score,0.75) FROM uncertain) THEN 'top25_uncertain' ELSE 'rest' END AS part FROM uncertain)"""


@query("mo9_accuracy_report", f"""WITH {REPORT} SELECT section, value, round(avg(ok),6) AS accuracy, count(*) AS n FROM (
 SELECT 'overall' AS section, 'all' AS value, ok FROM t UNION ALL SELECT 'type', CAST(label AS VARCHAR), ok FROM t UNION ALL SELECT 'uncertainty', part, ok FROM t) GROUP BY 1,2""", ("uncertain",))
def mo9(spark, sf):
    return rounded(pd_.accuracy_report(prediction_rows(spark, sf), "gold", "label"))


@query("ag9_group_accuracy", "SELECT label, round(avg((answer=gold)::INT),6) AS accuracy, count(*) AS n FROM uncertain GROUP BY 1", ("uncertain",))
def ag9(spark, sf):
    return rounded(pd_.group_accuracy(prediction_rows(spark, sf), "gold", "label"))


@query("mo10_prediction_overview", "SELECT " + ", ".join(f"round(avg((answer='{c}')::INT),6) AS share_{c}" for c in CHOICES) + ", round(avg(margin),6) AS mean_margin, count(*) FILTER (margin<0.15) AS low_margin FROM uncertain", ("uncertain",))
def mo10(spark, sf):
    return rounded(pd_.prediction_overview(prediction_rows(spark, sf)))


@query("mo11_uncertain_ids", "SELECT id FROM uncertain WHERE margin<0.15 OR unc_score >= (SELECT quantile_cont(unc_score,0.8) FROM uncertain)", ("uncertain",))
def mo11(spark, sf):
    return pd_.uncertain_ids(prediction_rows(spark, sf)).select("id")


def aligned(spark, sf):
    """Second model covers about three quarters of the items."""
    return pd_.align_models(model_a(spark, sf), model_b(spark, sf).filter("id % 4 <> 3"))


def _arg(p):
    return "CASE greatest({0}a,{0}b,{0}c,{0}d) WHEN {0}a THEN 'a' WHEN {0}b THEN 'b' WHEN {0}c THEN 'c' ELSE 'd' END".format(p)


BLEND = f"""runs_b AS (SELECT id, greatest(count(*) FILTER (p='a'),count(*) FILTER (p='b'),count(*) FILTER (p='c'),count(*) FILTER (p='d'))/count(*) AS agree FROM (
  SELECT id, {_arg('p_')} AS p FROM probs WHERE run>=8) GROUP BY 1),
al AS (SELECT x.id, x.gold, x.label, y.id IS NOT NULL AS covered, {', '.join(f'x.p_{c} AS f_{c}, coalesce(y.p_{c},x.p_{c}) AS s_{c}' for c in CHOICES)}, coalesce(agree,1.0) AS agree2
  FROM (SELECT * FROM models WHERE model='A') x LEFT JOIN (SELECT m.*, agree FROM models m JOIN runs_b USING (id) WHERE model='B' AND id%4<>3) y ON x.id=y.id),
al2 AS (SELECT *, list_sort([f_a,f_b,f_c,f_d]) AS q1, list_sort([s_a,s_b,s_c,s_d]) AS q2, {_arg('f_')} AS pred1, {_arg('s_')} AS pred2 FROM al),
al3 AS (SELECT *, q1[4]-q1[3] AS m1, q2[4] AS conf2, q2[4]-q2[3] AS m2,
  (CASE pred1 WHEN 'a' THEN f_a WHEN 'b' THEN f_b WHEN 'c' THEN f_c ELSE f_d END)-(CASE pred2 WHEN 'a' THEN f_a WHEN 'b' THEN f_b WHEN 'c' THEN f_c ELSE f_d END) AS gap FROM al2),
g AS (SELECT *, covered AND m1<0.15 AND conf2>=0.3 AND agree2>=0.5 AND gap<=0.1 AS gated FROM al3)"""


def _mix(cond, w="0.5"):
    return ", ".join(f"CASE WHEN {cond} THEN (1-{w})*f_{c}+{w}*s_{c} ELSE f_{c} END AS r_{c}" for c in CHOICES)


def _blend_sql(cond, replace=False, w="0.5"):
    cols = ", ".join(f"CASE WHEN {cond} THEN s_{c} ELSE f_{c} END AS r_{c}" for c in CHOICES) if replace else _mix(cond, w)
    return (f"WITH {BLEND} SELECT id, applied, pred, {', '.join(f'round(r_{c},6)+0.0 AS p_{c}' for c in CHOICES)} FROM ("
            f"SELECT *, {_arg('r_')} AS pred FROM (SELECT id, {cond} AS applied, {cols} FROM g))")


GATE = dict(gate_margin=0.15, min_conf=0.3, min_agree=0.5, max_gap=0.1)


@query("jn4_align_with_fallback", f"WITH {BLEND} SELECT id, covered, round(agree2,6) AS agree2, {', '.join(f'round(s_{c},6)+0.0 AS p_{c}' for c in CHOICES)} FROM al", ("models",))
def jn4(spark, sf):
    t = aligned(spark, sf).withColumn("probs", F.col("p2"))
    return _spread(t, "id", "covered", F.round("agree2", 6).alias("agree2"))


@query("mo12_weighted_blend", _blend_sql("covered", w="0.3"), ("models",))
def mo12(spark, sf):
    return _spread(pd_.blend_models(aligned(spark, sf), "weighted", 0.3), "id", "applied", "pred")


@query("mo13_gated_blend", _blend_sql("gated"), ("models",))
def mo13(spark, sf):
    return _spread(pd_.blend_models(aligned(spark, sf), "gated", 0.5, **GATE), "id", "applied", "pred")


@query("mo14_replace_blend", _blend_sql("(gated AND m2>=0.2)", replace=True), ("models",))
def mo14(spark, sf):
    return _spread(pd_.blend_models(aligned(spark, sf), "replace", min_margin=0.2, **GATE), "id", "applied", "pred")


@query("mo15_diversity", f"WITH {BLEND} SELECT round(avg((pred1<>pred2)::INT) FILTER (covered),6) AS disagreement, count(*) FILTER (covered) AS covered, avg((pred1<>pred2)::INT) FILTER (covered)>=0.08 AS worth_blending FROM al2", ("models",))
def mo15(spark, sf):
    return rounded(pd_.diversity(aligned(spark, sf)))


@query("mo16_change_report", f"""WITH {BLEND}, r AS (SELECT *, {_arg('r_')} AS pred FROM (SELECT id, covered, gated, pred1, {_mix('gated')} FROM g))
SELECT count(*) AS rows, count(*) FILTER (covered) AS covered, count(*) FILTER (gated) AS applied, count(*) FILTER (pred<>pred1) AS changed, floor(sqrt(count(*) FILTER (pred<>pred1)))::BIGINT AS noise_threshold FROM r""", ("models",))
def mo16(spark, sf):
    return pd_.change_report(pd_.blend_models(aligned(spark, sf), "gated", 0.5, **GATE))


@query("mo32_blend_by_type", f"""WITH {BLEND} SELECT id, label, pred, {', '.join(f'round(r_{c},6)+0.0 AS p_{c}' for c in CHOICES)} FROM (SELECT *, {_arg('r_')} AS pred FROM (
  SELECT id, label, {', '.join(f'CASE WHEN covered THEN (1-w)*f_{c}+w*s_{c} ELSE f_{c} END AS r_{c}' for c in CHOICES)} FROM (SELECT *, label/10.0 AS w FROM al)))""", ("models",))
def mo32(spark, sf):
    weights = table(spark, sf, "embeddings").groupBy("label").agg((F.max("label") / F.lit(10.0)).alias("weight"))
    return _spread(pd_.blend_by_type(aligned(spark, sf), weights, "label"), "id", "label", "pred")


@query("mo28_soft_export", f"SELECT id, {', '.join(f'round(p_{c},6)+0.0 AS {c}' for c in CHOICES)}, pred, gold AS answer FROM models WHERE model='A'", ("models",))
def mo28(spark, sf):
    return rounded(pd_.soft_export(model_a(spark, sf), "gold"))


@query("snk3_hard_and_soft_predictions", f"SELECT id, pred AS answer, {_r4()} FROM models WHERE model='A'", ("models",))
def snk3(spark, sf):
    return rounded(pd_.soft_export(model_a(spark, sf)).select("id", F.col("pred").alias("answer"), *[F.col(c).alias(f"p_{c}") for c in CHOICES]))


SAMPLE = "SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) AS pos, vec_id AS id, CASE WHEN vec_id%3=0 THEN 'a' ELSE 'A' END AS answer FROM embeddings"


@query("jn10_submission", f"SELECT s.pos, s.id, upper(m.pred) AS answer FROM ({SAMPLE}) s JOIN models m ON m.id=s.id AND m.model='A'", ("models",))
def jn10(spark, sf):
    from itemloom.operators.ordering import rank_by_key

    keyed = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.expr("CASE WHEN vec_id%3=0 THEN 'a' ELSE 'A' END").alias("answer"), F.md5(F.col("vec_id").cast("string")).alias("key")
    )
    sample = rank_by_key(keyed, "key", "pos").drop("key")
    return pd_.submission(prediction_rows(spark, sf), sample)


@query("qc10_alignment_report", f"SELECT count(*) AS left_rows, count(*) AS right_rows, count(*) FILTER (id<>pos-1) AS mismatches FROM ({SAMPLE})")
def qc10(spark, sf):
    from itemloom.operators.ordering import rank_by_key

    keyed = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.md5(F.col("vec_id").cast("string")).alias("key"))
    right = keyed.select((F.col("id") + 1).alias("pos"), "id")
    return qc.alignment_report(rank_by_key(keyed, "key", "pos").select("pos", "id"), right)


@query("mo29_any_model_right", "SELECT round(avg(ok),6) AS upper_bound, count(*) AS n FROM (SELECT id, max((pred=gold)::INT) AS ok FROM models GROUP BY 1)", ("models",))
def mo29(spark, sf):
    return rounded(ev.any_model_right(models(spark, sf)))


@query("mo30_rotation_stability", "SELECT round(avg(e),6) AS all_runs_right, round(avg(s),6) AS any_run_right, round(avg(m),6) AS mean_run_accuracy FROM (SELECT id, min((pred=gold)::INT) AS e, max((pred=gold)::INT) AS s, avg((pred=gold)::INT) AS m FROM runs_a GROUP BY 1)", ("runs_a",))
def mo30(spark, sf):
    return rounded(pd_.rotation_stability(views.probs(spark, sf).filter("run < 8")))


@query("cu16_learnable_screen", """SELECT id, gold_rank FROM (SELECT id, 1+(p_a>g)::INT+(p_b>g)::INT+(p_c>g)::INT+(p_d>g)::INT AS gold_rank FROM (
  SELECT *, CASE gold WHEN 'a' THEN p_a WHEN 'b' THEN p_b WHEN 'c' THEN p_c ELSE p_d END AS g FROM models WHERE model='A')) WHERE gold_rank>2""", ("models",))
def cu16(spark, sf):
    return pd_.learnable_screen(model_a(spark, sf), "gold").select("id", "gold_rank")


# ---- scorers --------------------------------------------------------------------------------------------------

CANDIDATES = (0, 3, 5, 7)


class CentroidScorer:
    """Logits of the shown labels: similarity to the labels' mean vectors, which Spark has aggregated from all rows."""

    def __init__(self, centroids: dict):
        self.labels, self.means = list(centroids), np.array(list(centroids.values()))

    def __call__(self, batch):
        own = 8 * np.stack(batch["embedding"].to_numpy()).astype(float) @ self.means.T
        place = {label: i for i, label in enumerate(self.labels)}
        at = np.array([[place[x] for x in shown] for shown in batch["shown"]])
        logits = np.take_along_axis(own, at, axis=1)
        out = pd.DataFrame(logits, columns=["l_a", "l_b", "l_c", "l_d"])
        out["mass"] = np.exp(logits).sum(axis=1) / np.exp(own).sum(axis=1)
        return out


def scored_items(spark, sf):
    """Every vector with its own label and three others as options, in four display orders."""
    emb = table(spark, sf, "embeddings")
    long = emb.select("label", F.posexplode("embedding").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("e")).orderBy("label").collect()  # labels times dimensions
    centroids = {r["label"]: [x["m"] for x in r["e"]] for r in rows}
    options = [(F.pmod(F.col("label") + c, F.lit(10))).alias(n) for n, c in zip(CHOICES, CANDIDATES)]
    shown = pd_.fan_out_orders(emb.select(F.col("vec_id").alias("id"), "embedding", *options), pr.display_orders(4)).select("id", "run", "order", "shown", "embedding")
    return pd_.score(shown, lambda: CentroidScorer(centroids), "id long, run int, order array<int>")


# a display order moves options only, so every order gives the same probabilities in the original slots
SCORED = """ce AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1,65)) AS i FROM embeddings) GROUP BY 1,2) GROUP BY 1),
lg AS (SELECT vec_id AS id, (ce.label - e.label + 10) % 10 AS step, exp(8*list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), m)) AS x FROM embeddings e, ce),
sm AS (SELECT id, max(x) FILTER (step=0) AS e_a, max(x) FILTER (step=3) AS e_b, max(x) FILTER (step=5) AS e_c, max(x) FILTER (step=7) AS e_d,
  sum(x) FILTER (step IN (0,3,5,7))/sum(x) AS mass FROM lg GROUP BY 1)"""
_SCORED_P = ", ".join(f"round(e_{c}/(e_a+e_b+e_c+e_d),6)+0.0 AS p_{c}" for c in CHOICES)


@query("mo4_batch_scorer", f"WITH {SCORED} SELECT id, run, {_SCORED_P} FROM sm, (VALUES (0),(1),(2),(3)) v(run)")
def mo4(spark, sf):
    return _spread(pd_.scored_probs(scored_items(spark, sf), "order"), "id", "run")


@query("ud1_scorer_plug_in", f"WITH {SCORED} SELECT id, {_SCORED_P} FROM sm")
def ud1(spark, sf):
    return _spread(pd_.average_runs(pd_.scored_probs(scored_items(spark, sf), "order")), "id")


@query("mo31_letter_mass_check", f"WITH {SCORED} SELECT round(avg(mass),6) AS mean_mass, round(min(mass),6) AS min_mass, 4*count(*) AS n, avg(mass)<0.3 AS too_low FROM sm")
def mo31(spark, sf):
    return rounded(pd_.mass_check(scored_items(spark, sf)))


# ---- model comparison -------------------------------------------------------------------------------------------

PG = "greatest(p_gold,1e-9)"
BRIER = "+".join(f"(p_{c}-(gold='{c}')::INT)*(p_{c}-(gold='{c}')::INT)" for c in CHOICES)


@query("mo18_variant_summary", f"""SELECT variant, count(*) FILTER (pred=gold) AS correct, round(avg((pred=gold)::INT),4) AS accuracy, round(avg(-ln({PG})),4) AS nll, round(avg({BRIER}),4) AS brier,
  round(avg({PG}),4) AS mean_p_gold, round(avg({PG}) FILTER (pred<>gold),4) AS mean_p_gold_on_wrong FROM variants GROUP BY 1""", ("variants",))
def mo18(spark, sf):
    return ev.variant_summary(ev.graded(variants(spark, sf)))


PAIRWISE = """SELECT x.variant AS A, y.variant AS B, count(*) FILTER (x.pred<>y.pred) AS pred_diff, count(*) FILTER (x.pred=x.gold AND y.pred<>y.gold) AS A_only_correct,
  count(*) FILTER (x.pred<>x.gold AND y.pred=y.gold) AS B_only_correct, count(*) FILTER (x.pred<>x.gold AND y.pred<>y.gold AND x.pred<>y.pred) AS both_wrong_diff_pred
  FROM variants x JOIN variants y ON x.id=y.id AND x.variant<y.variant GROUP BY 1,2"""


@query("mo19_pairwise_comparison", PAIRWISE, ("variants",))
def mo19(spark, sf):
    return ev.pairwise_comparison(ev.graded(variants(spark, sf)), VARIANTS).drop("mcnemar_p")


@query("jn13_variant_pairs", f"SELECT A, B, pred_diff FROM ({PAIRWISE})", ("variants",))
def jn13(spark, sf):
    return ev.pairwise_comparison(ev.graded(variants(spark, sf)), VARIANTS).select("A", "B", "pred_diff")


@query("mo20_mcnemar", f"""WITH p AS ({PAIRWISE}) SELECT A, B, round(least(1.0, 2*(SELECT sum(exp(lgamma(nb+nc+1)-lgamma(i+1)-lgamma(nb+nc-i+1)-(nb+nc)*ln(2))) FROM range(0, least(nb,nc)+1) t(i))),4) AS mcnemar_p
FROM (SELECT A, B, A_only_correct AS nb, B_only_correct AS nc FROM p)""", ("variants",))
def mo20(spark, sf):
    return ev.pairwise_comparison(ev.graded(variants(spark, sf)), VARIANTS).select("A", "B", "mcnemar_p")


@query("mo21_disagreements", """WITH w AS (SELECT id, any_value(gold) AS gold, """ + ", ".join(
    f"max(pred) FILTER (variant='{v}') AS pred_{v}, max(p_gold) FILTER (variant='{v}') AS p_gold_{v}, max(greatest(p_a,p_b,p_c,p_d)) FILTER (variant='{v}') AS p_pred_{v}" for v in VARIANTS)
    + """, count(DISTINCT pred) AS k FROM variants GROUP BY 1)
SELECT w.id, label, coalesce(nullif(concat_ws(',', """ + ", ".join(f"CASE WHEN pred_{v}=gold THEN '{v}' END" for v in VARIANTS) + "), ''), 'none') AS correct_by, "
    + ", ".join(f"pred_{v}, round(p_gold_{v},3) AS p_gold_{v}, round(p_pred_{v},3) AS p_pred_{v}" for v in VARIANTS) + " FROM w JOIN embeddings e ON e.vec_id=w.id WHERE k>1", ("variants",))
def mo21(spark, sf):
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return ev.disagreements(ev.graded(variants(spark, sf)), emb, VARIANTS)


@query("mo33_hedge_choice", f"""WITH p AS ({PAIRWISE}), b AS (SELECT A AS candidate, B AS other, pred_diff AS d FROM p UNION ALL SELECT B, A, pred_diff FROM p)
SELECT candidate, max(d) FILTER (other='v0') AS distance_to_best, round(avg(d),6) AS mean_distance FROM b WHERE candidate<>'v0' GROUP BY 1 HAVING max(d) FILTER (other='v0')>=30 ORDER BY mean_distance, candidate LIMIT 1""", ("variants",))
def mo33(spark, sf):
    return rounded(ev.hedge_choice(ev.pairwise_comparison(ev.graded(variants(spark, sf)), VARIANTS), "v0"))


EBITS = "-(" + "+".join(f"p_{c}*log2(greatest(p_{c},1e-12))" for c in CHOICES) + ")"
PCOR = "CASE gold WHEN 'a' THEN p_a WHEN 'b' THEN p_b WHEN 'c' THEN p_c ELSE p_d END"


@query("mo22_probe_table", f"SELECT id, model, pred, round({EBITS},6)+0.0 AS entropy, round({PCOR},6)+0.0 AS p_correct FROM models", ("models",))
def mo22(spark, sf):
    m = models(spark, sf)
    return m.select("id", "model", "pred", r6(pr.entropy_bits(F.col("probs"))).alias("entropy"), r6("p_gold").alias("p_correct"))


@query("mo23_majority_labels", f"""WITH {FIRST} SELECT item_id, majority AS answer FROM first_of""", ("votes",))
def mo23(spark, sf):
    t = vt.vote_features(wide_votes(spark, sf), ANSWERS).filter("majority_answer IS NOT NULL")
    return t.select("item_id", F.lower(F.trim("majority_answer")).alias("answer"))


# three probes, smallest to largest: runs 0-3, model A, model B
PROBES = ["p1", "p2", "p3"]
D = f"""d0 AS (SELECT id, any_value(gold) AS gold, 'p1' AS model, avg(p_a) AS p_a, avg(p_b) AS p_b, avg(p_c) AS p_c, avg(p_d) AS p_d FROM probs WHERE run<4 GROUP BY id
  UNION ALL SELECT id, gold, CASE model WHEN 'A' THEN 'p2' ELSE 'p3' END, p_a, p_b, p_c, p_d FROM models),
d1 AS (SELECT id, model, gold, {_arg('p_')} AS pred, {PCOR} AS pc, {EBITS} AS h FROM d0),
d2 AS (SELECT id, any_value(gold) AS gold, """ + ", ".join(f"max(pred) FILTER (model='{m}') AS pred_{m}, bool_or(pred=gold) FILTER (model='{m}') AS correct_{m}, max(pc) FILTER (model='{m}') AS p_correct_{m}, max(h) FILTER (model='{m}') AS entropy_{m}" for m in PROBES) + """ FROM d1 GROUP BY 1),
d AS (SELECT *, correct_p1::INT+correct_p2::INT+correct_p3::INT AS n_correct,
  CASE WHEN correct_p1 AND correct_p2 AND correct_p3 THEN 'Easy' WHEN NOT correct_p1 AND NOT correct_p2 AND NOT correct_p3 THEN 'Hard'
    WHEN (correct_p1 AND NOT (correct_p2 AND correct_p3)) OR (NOT correct_p1 AND correct_p2 AND NOT correct_p3) THEN 'Inconsistent'
    WHEN correct_p2 THEN 'Medium' ELSE 'Medium-Hard' END AS tier,
  1-(0.2*p_correct_p1+0.3*p_correct_p2+0.5*p_correct_p3) AS difficulty FROM d2)"""


def difficulty(spark, sf):
    p = views.probs(spark, sf)
    means = F.array(*[F.avg(pr.slot(F.col("probs"), i)) for i in range(4)])
    small = p.filter("run < 4").groupBy("id").agg(F.first("gold").alias("gold"), means.alias("probs")).withColumn("model", F.lit("p1"))
    big = models(spark, sf).select("id", "gold", "probs", F.when(F.col("model") == "A", "p2").otherwise("p3").alias("model"))
    scored = ev.graded(small.unionByName(big))
    return ev.difficulty_table(scored, PROBES, {"p1": 0.2, "p2": 0.3, "p3": 0.5}, keep=["gold"])


@query("jn5_multi_model_join", f"WITH {D} SELECT id, gold, pred_p1, pred_p2, pred_p3 FROM d", ("models",))
def jn5(spark, sf):
    return difficulty(spark, sf).select("id", "gold", *[f"pred_{m}" for m in PROBES])


@query("mo24_difficulty_tier", f"WITH {D} SELECT id, correct_p1, correct_p2, correct_p3, tier FROM d", ("models",))
def mo24(spark, sf):
    return difficulty(spark, sf).select("id", *[f"correct_{m}" for m in PROBES], "tier")


@query("mo25_difficulty_score", f"WITH {D} SELECT id, n_correct, round(difficulty,6)+0.0 AS difficulty FROM d", ("models",))
def mo25(spark, sf):
    return rounded(difficulty(spark, sf).select("id", "n_correct", "difficulty"))


SUMMARY = f"""{D}, s AS (SELECT CASE WHEN id%3=0 THEN 'dev' ELSE 'train' END AS split, * FROM d),
l AS (""" + " UNION ALL ".join(f"SELECT split, '{m}' AS model, correct_{m}::INT AS c, p_correct_{m} AS p, entropy_{m} AS h FROM s" for m in PROBES) + """),
sm AS (SELECT split, model, count(*) AS n, avg(c) AS accuracy, avg(p) AS p_correct_mean, avg(h) AS entropy_mean FROM l GROUP BY 1,2)"""


def _with_split(spark, sf):
    return difficulty(spark, sf).withColumn("split", F.when(F.col("id") % 3 == 0, "dev").otherwise("train"))


@query("mo26_probe_summary", f"WITH {SUMMARY} SELECT split, model, n, round(accuracy,4) AS accuracy, round(p_correct_mean,4) AS p_correct_mean, round(entropy_mean,4) AS entropy_mean FROM sm", ("models",))
def mo26(spark, sf):
    t = ev.probe_summary(_with_split(spark, sf), PROBES, "split")
    return t.select("split", "model", "n", *[F.round(c, 4).alias(c) for c in ("accuracy", "p_correct_mean", "entropy_mean")])


@query("qc12_expectation_check", f"""WITH {SUMMARY} SELECT t.model, (t.accuracy>e.accuracy AND t.p_correct_mean>e.p_correct_mean AND t.entropy_mean<e.entropy_mean) AS as_expected FROM sm t JOIN sm e ON t.model=e.model AND t.split='train' AND e.split='dev'""", ("models",))
def qc12(spark, sf):
    return ev.expectation_check(ev.probe_summary(_with_split(spark, sf), PROBES, "split"), "split", "train", "dev")


@query("mo27_tier_counts", f"WITH {D} SELECT CASE tier WHEN 'Easy' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Medium-Hard' THEN 3 WHEN 'Hard' THEN 4 ELSE 5 END AS position, tier, count(*) AS count, round(count(*)/(SELECT count(*) FROM d)*100,2) AS percent FROM d GROUP BY ALL", ("models",))
def mo27(spark, sf):
    return ev.tier_counts(difficulty(spark, sf))


@query("ag11_difficulty_by_type", f"WITH {D} SELECT label, count(*) AS n, round(avg(difficulty),3) AS difficulty, round(avg((tier='Hard')::INT)*100,3) AS hard_pct, " + ", ".join(f"round(avg(correct_{m}::INT),3) AS acc_{m}" for m in PROBES) + " FROM d JOIN embeddings ON vec_id=id GROUP BY 1", ("models",))
def ag11(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return ev.difficulty_by_type(difficulty(spark, sf).join(labels, "id"), "label", PROBES)


@query("so3_hardest_items", f"WITH {D} SELECT id, gold, pred_p1, pred_p2, pred_p3, round(difficulty,6) AS difficulty FROM d ORDER BY d.difficulty DESC, id LIMIT 20", ("models",))
def so3(spark, sf):
    t = difficulty(spark, sf).orderBy(F.desc("difficulty"), "id").limit(20)
    return rounded(t.select("id", "gold", *[f"pred_{m}" for m in PROBES], "difficulty"))


@query("ds12_consensus_difficulty_correlation", f"WITH {D}, {VF} SELECT round(corr(consensus_ratio, difficulty),6) AS correlation FROM d JOIN f ON f.item_id=d.id WHERE consensus_ratio IS NOT NULL", ("models", "vote_counts"))
def ds12(spark, sf):
    v = vt.vote_features(wide_votes(spark, sf), ANSWERS).select(F.col("item_id").alias("id"), r6("consensus_ratio").alias("consensus_ratio"))
    t = difficulty(spark, sf).join(v, "id").filter("consensus_ratio IS NOT NULL")
    return t.agg(F.round(F.corr("consensus_ratio", "difficulty"), 6).alias("correlation"))


@query("ag18_experiment_comparison", "WITH s AS (SELECT variant, round(avg((pred=gold)::INT),4) AS accuracy FROM variants GROUP BY 1) SELECT variant, accuracy, round((accuracy-(SELECT accuracy FROM s WHERE variant='v0'))*100,2)+0.0 AS delta_pp FROM s", ("variants",))
def ag18(spark, sf):
    t = ev.experiment_comparison(ev.variant_summary(ev.graded(variants(spark, sf))), "v0").select("variant", "accuracy", "delta_pp")
    return t.withColumn("delta_pp", F.col("delta_pp") + F.lit(0.0))


@query("qc11_accuracy_agreement", "WITH s AS (SELECT variant, round(avg((pred=gold)::INT),4) AS accuracy FROM variants GROUP BY 1) SELECT variant, accuracy, round(accuracy + CASE variant WHEN 'v2' THEN 0.01 ELSE 0.0 END,6) AS logged_accuracy, variant<>'v2' AS agrees FROM s", ("variants",))
def qc11(spark, sf):
    s = ev.variant_summary(ev.graded(variants(spark, sf))).select("variant", "accuracy")
    logged = s.select("variant", F.round(F.col("accuracy") + F.when(F.col("variant") == "v2", 0.01).otherwise(0.0), 6).alias("logged_accuracy"))
    return qc.accuracy_agreement(s, logged)


@query("src5_variant_probabilities", f"SELECT variant, id, {_r4()} FROM variants", ("variants",))
def src5(spark, sf):
    from itemloom.sources.readers import check_variant_table

    expected = table(spark, sf, "embeddings").count()
    return _spread(check_variant_table(variants(spark, sf).select("variant", "id", "probs"), expected), "variant", "id")
