"""Column detection by alias, standard item form, and path resolution."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom import CHOICES
from itemloom.functions import rules, text as tx
from itemloom.functions.answers import normalize_answer

# Accepted column names, in search order.
ID_NAMES = ["id", "ID", "Id", "image_id", "sample_id", "qid"]
PATH_NAMES = ["path", "image_path", "img_path", "image", "img", "filename", "file", "file_name", "image_name"]
QUESTION_NAMES = ["question", "query", "Question", "질문", "text"]
ANSWER_NAMES = ["answer", "label", "Answer", "정답", "target"]
CHOICE_NAME_SETS = [
    ["a", "b", "c", "d"],
    ["A", "B", "C", "D"],
    ["choice_a", "choice_b", "choice_c", "choice_d"],
    ["option_a", "option_b", "option_c", "option_d"],
    ["opt_a", "opt_b", "opt_c", "opt_d"],
    ["option1", "option2", "option3", "option4"],
    ["choice1", "choice2", "choice3", "choice4"],
    ["1", "2", "3", "4"],
]


@dataclass(frozen=True)
class ItemColumns:
    id: str
    path: str
    question: str
    choices: tuple[str, ...]
    answer: str | None = None


def _find(columns: Sequence[str], names: Sequence[str]) -> str | None:
    folded = {c.lower(): c for c in columns}
    hits = (n if n in columns else folded.get(n.lower()) for n in names)
    return next((h for h in hits if h), None)


def detect_columns(columns: Sequence[str], **overrides) -> ItemColumns:
    """Resolve item columns by exact name, then ignoring case; overrides win; failure names what is missing."""
    choices = overrides.get("choices") or next((s for s in CHOICE_NAME_SETS if set(s) <= set(columns)), None)
    found = {
        "id": overrides.get("id") or _find(columns, ID_NAMES),
        "path": overrides.get("path") or _find(columns, PATH_NAMES),
        "question": overrides.get("question") or _find(columns, QUESTION_NAMES),
        "choices": tuple(choices) if choices else None,
    }
    absent = [k for k, v in found.items() if not v]
    if absent:
        raise ValueError(f"cannot find columns for {absent} among {list(columns)}; name them explicitly")
    return ItemColumns(answer=overrides.get("answer") or _find(columns, ANSWER_NAMES), **found)


def standardize(df: DataFrame, columns: ItemColumns | None = None, labelled: bool = True, extra: Sequence[str] = ()) -> DataFrame:
    """Items in standard form: text columns, trimmed options, normalized answer, prompt question type.

    Labelled rows whose answer cannot be read are dropped.
    """
    columns = columns or detect_columns(df.columns)
    def cell(name):
        return F.col(f"`{name}`").cast("string")
    out = df.select(
        cell(columns.id).alias("id"), cell(columns.path).alias("path"), cell(columns.question).alias("question"),
        *[tx.strip(cell(n)).alias(c) for c, n in zip(CHOICES, columns.choices)],
        *([cell(columns.answer).alias("__raw")] if labelled and columns.answer else []),
        *[F.col(f"`{e}`") for e in extra],
    )
    if labelled:
        if columns.answer is None:
            raise ValueError("labelled rows need an answer column")
        out = out.withColumn("answer", normalize_answer(F.col("__raw"), [F.col(c) for c in CHOICES])).drop("__raw")
        out = out.filter(F.col("answer").isNotNull())
    return out.withColumn("qtype", rules.prompt_type(F.col("question")))


# Folders tried under every root, in order; None keeps the given relative path.
ROOT_FOLDERS = [None, "", "train/", "test/", "images/"]


def resolve_paths(df: DataFrame, files: DataFrame, roots: Sequence[str], path: str = "path") -> DataFrame:
    """Add ``resolved``: the first existing candidate of a path under ordered roots, or empty.

    ``files`` lists the existing paths; candidates meet it by an equi-join.
    """
    base = F.regexp_extract(path, r"([^/]+)/*$", 1)
    candidates = [F.when(F.col(path).startswith("/"), F.col(path))]
    for root in roots:
        prefix = root.rstrip("/") + "/" if root else ""
        for folder in ROOT_FOLDERS:
            candidates.append(
                F.concat(F.lit(prefix), F.col(path)) if folder is None else F.concat(F.lit(prefix + folder), base)
            )
    distinct = df.select(path).distinct()
    tried = distinct.select(path, F.posexplode(F.array(*candidates)).alias("__rank", "__candidate"))
    existing = files.select(F.col("path").alias("__candidate")).distinct()
    best = tried.join(existing, "__candidate").groupBy(path).agg(F.min_by("__candidate", "__rank").alias("resolved"))
    return df.join(best, path, "left").withColumn("resolved", F.coalesce("resolved", F.lit("")))


def missing_paths(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count("*").alias("rows"), F.count_if(F.col("resolved") == "").alias("missing"))
