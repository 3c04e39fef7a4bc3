"""Whole flows put together from the operators: profile, curate, score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom import CHOICES
from itemloom.functions import rules, text as tx
from itemloom.operators import curation as cu, dedup as dd, distribution as ds, predictions as pd_, profile as pf, quality as qc
from itemloom.operators import splitting as sp


def run_report(
    items: DataFrame, splits: Sequence[str] = ("train", "dev", "test"), votes: DataFrame | None = None, areas: dict[str, DataFrame] | None = None,
    base: str = "train", other: str = "test", voted: str = "dev", position: str = "pos",
) -> DataFrame:
    """Key/value report of a text run.

    Rows, mean question and mean option length of every split; normalized questions and whole problems shared by two splits; the
    distance of their question types; with ``votes`` (item_id, vote_entropy, consensus_ratio), means over the items of one
    split; with ``areas`` (measure name to a table with one ``auc`` per fold), mean areas. Counts and means come from one wide
    aggregate, which is turned into rows.
    """
    features = pf.text_features(items)
    if votes is not None:
        known = votes.select(F.col("item_id").alias("__item"), "vote_entropy", "consensus_ratio")
        features = features.join(known, F.col(position) == F.col("__item"), "left")
    own = {s: F.col("split") == s for s in splits}
    measures = {f"n_{s}": F.count_if(own[s]).cast("double") for s in splits}
    measures |= {f"{s}_question_len_mean": F.avg(F.when(own[s], F.col("question_char_len"))) for s in splits}
    measures |= {f"{s}_option_len_mean": F.avg(F.when(own[s], F.col("option_char_mean"))) for s in splits}
    if votes is not None:
        measures |= {f"{voted}_{c}_mean": F.avg(F.when(F.col("split") == voted, F.col(c))) for c in ("vote_entropy", "consensus_ratio")}
    wide = features.agg(*[m.alias(n) for n, m in measures.items()])
    long = wide.unpivot([], list(measures), "measure", "value")
    keys = {"question": F.col("question_norm"), "full_problem": tx.problem_signature("question_norm", [f"{c}_norm" for c in CHOICES])}
    shared = qc.text_overlap(features, "split", base, other, keys)
    long = long.unionByName(shared.select(F.concat(F.lit(f"{base}_{other}_"), "kind", F.lit("_exact_overlap")).alias("measure"), F.col("shared").cast("double").alias("value")))
    types = ds.jensen_shannon(features, "split", base, other, "question_type")
    long = long.unionByName(types.select(F.lit(f"question_type_js_distance_{base}_{other}").alias("measure"), F.col("js_distance").alias("value")))
    for name, per_fold in (areas or {}).items():
        long = long.unionByName(per_fold.agg(F.avg("auc").alias("value")).select(F.lit(name).alias("measure"), "value"))
    return long


def profile_flow(items: DataFrame, splits: Sequence[str] = ("train", "test", "dev"), hash_col: str | None = None) -> dict[str, DataFrame]:
    """All profile tables of labelled items; ``hash_col`` names a content hash for the duplicate tables."""
    base, other = splits[0], splits[1]
    features = pf.option_similarity(pf.text_features(items), "_norm")
    tables = {
        "numeric_summary": ds.describe_splits(features, "split", list(splits), pf.TEXT_FEATURES),
        "numeric_comparison": ds.numeric_comparison(features, "split", base, other, pf.TEXT_FEATURES),
        "question_types": pf.cross_table(features, "question_type", "split", splits),
        "question_type_variation": ds.total_variation(features, "split", base, other, "question_type"),
        "question_type_js": ds.jensen_shannon(features, "split", base, other, "question_type"),
        "missing": qc.missing_counts(items),
        "blank": qc.blank_counts(items, ["question", *CHOICES]),
        "in_split_duplicates": qc.in_split_duplicates(features, "split"),
        "choice_overview": pf.choice_overview(items),
        "report": run_report(items, splits, base=base, other=other),
    }
    if hash_col:
        groups = dd.exact_groups(items, hash_col, "split", splits)
        tables["duplicate_groups"] = groups
        tables["duplicate_members"] = dd.group_members(items, groups, hash_col, ["split", "id", "path"])
        tables["cross_split_pairs"] = dd.cross_split_pairs(items, hash_col, "split", base, other)
    return tables


def split_flow(train: DataFrame, keys: Sequence[str], fraction: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Group rows by shared keys, split them by group and answer, and describe the split."""
    qc.require_columns(train, ["id", "answer", "pos", *keys], "train")
    labelled = train.withColumn("answer", F.lower(F.trim("answer")))
    bad = qc.label_violations(labelled).first()["bad_labels"]
    if bad:
        raise qc.ContractError(f"train: {bad} answers outside a-d")
    split = sp.stratified_group_split(dd.duplicate_components(labelled, keys), fraction, seed)
    return split, sp.split_metadata(split)


def curate_flow(
    train: DataFrame, train_changes: DataFrame, dev: DataFrame, dev_changes: DataFrame, held_out: DataFrame,
    patterns: Sequence[str], drop_patterns: Sequence[str] = (), external: Sequence[DataFrame] = (),
    mode: str = "sequential", augs: Sequence[str] = (), mirror: bool = True, image: str | None = "img",
) -> tuple[DataFrame, DataFrame]:
    """Curated training stages and their summary; every contract is checked before the stages are built."""
    for name, rows, changes in (("train", train, train_changes), ("dev", dev, dev_changes)):
        cu.check_edit_log(changes)
        audit = cu.edit_audit(cu.edit_trail(rows, cu.option_edits(changes))).first()
        if audit["before_mismatches"]:
            raise qc.ContractError(f"{name}: {audit['before_mismatches']} edits do not meet the value they expect")
    clean = cu.curated_train(train, train_changes, mirror).unionByName(
        cu.curated_dev(dev, dev_changes, held_out, patterns, drop_patterns, mirror, image), allowMissingColumns=True
    )
    kept = ["id", "path", "question", *CHOICES, "answer", "src"]
    target = qc.enforce_contract(clean.select(*kept), "target")
    outside = [qc.enforce_contract(e.select(*kept), "external") for e in external]
    stages = cu.build_stages(target, outside, mode, augs)
    return stages, cu.stage_summary(stages)


def score_flow(runs: DataFrame, items: DataFrame, gold: str | None = None) -> dict[str, DataFrame]:
    """Predictions, uncertainty and, with right answers, the accuracy report from probability runs."""
    typed = items.withColumn("qtype", rules.prompt_type(F.col("question")))
    table = pd_.prediction_table(pd_.average_runs(runs), typed)
    out = {"predictions": table, "overview": pd_.prediction_overview(table)}
    if gold:
        answered = table.join(items.select("id", F.col(gold).alias("gold")), "id")
        out["accuracy"] = pd_.accuracy_report(answered, "gold", "qtype")
    return out


def blend_flow(primary: DataFrame, secondary: DataFrame, sample: DataFrame, **options) -> dict[str, DataFrame]:
    """Blend two run tables and produce the submission with its reports."""
    aligned = pd_.align_models(pd_.average_runs(primary), pd_.average_runs(secondary))
    blended = pd_.blend_models(aligned, **options)
    final = blended.select("id", F.col("pred").alias("answer"))
    return {
        "blended": blended, "diversity": pd_.diversity(aligned), "changes": pd_.change_report(blended),
        "submission": pd_.submission(final, sample),
    }
