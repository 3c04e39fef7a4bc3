"""Prompt texts and chat records for scoring and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom import CHOICES
from itemloom.functions import rules, text as tx

# The lines of the prompt.
QUESTION_LEAD = "질문: "
HINT_TITLE = "판단 기준:"
OCR_TITLE = "[자동 OCR 참고 텍스트 (오류가 있을 수 있음, 이미지가 우선)]"
INSTRUCTION = "이미지의 글자를 정확히 읽고 질문 조건에 맞는 보기를 고르세요. 정답은 a, b, c, d 중 한 글자만 출력하세요."
EXTRA_VIEWS = "첫 번째 이미지는 원본 전체이고, 나머지 {n}개는 같은 이미지의 확대 영역입니다. 확대 영역의 글자를 원본 맥락과 함께 판단하세요.\n\n"
SYSTEM_TEXT = (
    "You are a highly accurate visual multiple-choice question answering model. "
    "Use the image and the answer choices. Return exactly one lowercase letter: a, b, c, or d."
)


def lettered_options(options: list[Column]) -> list[Column]:
    return [F.concat(F.lit(f"({c}) "), o) for c, o in zip(CHOICES, options)]


def user_prompt(question: Column, options: list[Column], ocr: Column | None = None, hints: bool = True, ocr_chars: int | None = None) -> Column:
    """Question, optional typed hint, optional recognized text, lettered options and instruction, line by line.

    ``ocr_chars`` cuts the recognized text, as a model with a short context may need; by default it is whole.
    """
    def lines(*parts):
        return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    parts = [lines(F.concat(F.lit(QUESTION_LEAD), tx.strip(question)))]
    if hints:
        parts.append(lines("", HINT_TITLE, F.concat(F.lit("- "), rules.hint_for(rules.prompt_type(question)))))
    if ocr is not None:
        seen = tx.strip(F.coalesce(ocr, F.lit("")))
        block = lines("", OCR_TITLE, seen if ocr_chars is None else F.substring(seen, 1, ocr_chars))
        usable = (seen != "") & (F.lower(seen) != "nan")
        parts.append(F.when(usable, block).otherwise(F.array().cast("array<string>")))
    parts.append(lines("", *lettered_options(options), "", INSTRUCTION))
    return F.array_join(F.flatten(F.array(*parts)), "\n")


def plain_body(question: Column, options: list[Column], instruction: str) -> Column:
    """Short prompt body: question, options, blank line, instruction."""
    return F.array_join(F.array(question, *lettered_options(options), F.lit(""), F.lit(instruction)), "\n")


def repeat_body(body: Column, times: int, separator: str) -> Column:
    return F.array_join(F.array_repeat(body, times), separator)


def view_note(text: Column, views: int) -> Column:
    """Prefix telling how many zoomed views follow the full image."""
    return text if views < 2 else F.concat(F.lit(EXTRA_VIEWS.format(n=views - 1)), text)


def chat_record(user: Column, system: str = SYSTEM_TEXT, answer: Column | None = None) -> Column:
    """Messages as an array of (role, content)."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = [message("system", F.lit(system)), message("user", user)]
    if answer is not None:
        messages.append(message("assistant", answer))
    return F.array(*messages)


def chat_rows(df: DataFrame, instruction: str, times: int = 1, separator: str = "\n\n", system: str = SYSTEM_TEXT) -> DataFrame:
    body = plain_body(F.col("question"), [F.col(c) for c in CHOICES], instruction)
    return df.withColumn("messages", chat_record(repeat_body(body, times, separator), system, F.col("answer")))
