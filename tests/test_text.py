"""Text normalization, keys, features, taxonomies, answers and prompts on edge cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from itemloom.functions import answers as an, rules, text as tx
from itemloom.operators import profile as pf, prompts as pm

EDGES = ["", " ", "a", "ab", "Ａ１２  ３ x", "사과 는\t몇 개?", "😀b😀", "  two  words ", "12,000원", "A_b-C"]


def column(spark, expr, values=EDGES):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def py_normalize(v):
    return " ".join(unicodedata.normalize("NFKC", v).split())


def test_normalize_text(spark):
    assert column(spark, tx.normalize_text(F.col("t"))) == [py_normalize(v) for v in EDGES]
    assert column(spark, tx.normalize_text(F.col("t")), [None]) == [""]


def test_compact_key_keeps_letters_of_all_scripts(spark):
    import re

    want = [re.sub(r"[\s\W_]+", "", v).lower() for v in EDGES]
    assert column(spark, tx.compact_key(F.col("t"))) == want


def test_stem_key_strips_one_extension(spark):
    got = column(spark, tx.stem_key(F.col("t")), ["dev/Dev_1.jpg", "x.tar.gz", ".hidden", "plain", "a/b/"])
    assert got == ["dev_1", "x.tar", ".hidden", "plain", "b"]


def test_ngram_set_and_jaccard(spark):
    def grams(v):
        t = "".join(py_normalize(v).lower().split())
        return {t} if 0 < len(t) < 2 else {t[i:i + 2] for i in range(len(t) - 1)}

    df = spark.createDataFrame([(i, v) for i, v in enumerate(EDGES)], "i int, t string").withColumn("t", tx.normalize_text(F.col("t")))
    got = [r[0] for r in df.orderBy("i").select(tx.ngram_set(F.col("t"))).collect()]
    assert [set(g) for g in got] == [grams(v) for v in EDGES]
    pairs = [("", ""), ("", "ab"), ("abc", "abd"), ("a", "a")]
    df = spark.createDataFrame(pairs, "x string, y string")
    sims = [r[0] for r in df.select(tx.jaccard(tx.ngram_set(F.col("x")), tx.ngram_set(F.col("y")))).collect()]
    assert sims == [1.0, 0.0, pytest.approx(1 / 3), 1.0]


def test_long_ngrams(spark):
    assert column(spark, tx.char_ngrams(F.col("t"), 3), ["abcd", "ab", "😀bc"]) == [["abc", "bcd"], [], ["😀bc"]]


def test_numeric_like(spark):
    values = ["1,000원", "10:30", "", "abc", "12kg", "3층", "5 CM"]
    assert column(spark, tx.numeric_like(F.col("t")), values) == [True, True, False, False, True, False, True]


def test_pattern_share(spark):
    assert column(spark, tx.pattern_share(F.col("t"), "[가-힣]"), ["", "가a", "가나"]) == [0.0, 0.5, 1.0]


@pytest.mark.parametrize("text,profile,prompt,study", [
    ("전화번호는 무엇인가요?", "전화번호", "phone", "phone"),
    ("몇 층에 있나요", "수량·계수", "floor", "other"),
    ("가격은 얼마인가요", "가격·금액", "price", "price"),
    ("사과는 몇 개인가요", "수량·계수", "count", "counting"),
    ("간판의 색깔은", "색상", "color", "color"),
    ("hello", "기타", "other", "other"),
    ("무엇을 하고 있나요", "인물·대상", "other", "action_state"),
])
def test_taxonomies_follow_rule_order(spark, text, profile, prompt, study):
    for label, want in ((rules.profile_type, profile), (rules.prompt_type, prompt), (rules.text_type, study)):
        assert column(spark, label(F.col("t")), [text]) == [want]


def test_normalize_answer(spark):
    rows = [("A", "a"), ("(b)", "b"), ("3", "c"), (" pear ", "d"), ("apple", "a"), ("5", None), ("", None), ("nan", None), (None, None), ("0", None)]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, r string")
    options = [F.lit(x) for x in ("apple", " apple", "fig", "pear")]
    got = [x[0] for x in df.orderBy("i").select(an.normalize_answer(F.col("r"), options)).collect()]
    assert got == [w for _, w in rows]


def test_same_value(spark):
    rows = [("1", "1.0", True), (" a ", "a", True), ("a", "b", False), ("", "", True), ("1e2", "100", True), ("nan", "NaN", False)]
    df = spark.createDataFrame(rows, "x string, y string, w boolean")
    assert [r[0] == r[1] for r in df.select(an.same_value(F.col("x"), F.col("y")), "w").collect()] == [True] * len(rows)


def test_prompt_with_and_without_recognized_text(spark):
    df = spark.createDataFrame([(" 몇 층? ", "w" * 700), ("색?", " nan "), ("x", None)], "q string, o string")
    out = [r[0] for r in df.select(pm.user_prompt(F.col("q"), [F.lit(c) for c in "wxyz"], F.col("o"))).collect()]
    assert out[0].split("\n")[0] == "질문: 몇 층?"
    assert "w" * 700 in out[0]  # whole, unless a length is asked for
    short = df.select(pm.user_prompt(F.col("q"), [F.lit(c) for c in "wxyz"], F.col("o"), ocr_chars=600)).first()[0]
    assert "w" * 600 in short and "w" * 601 not in short
    assert pm.OCR_TITLE not in out[1] and pm.OCR_TITLE not in out[2]
    assert out[2].endswith("(a) w\n(b) x\n(c) y\n(d) z\n\n" + pm.INSTRUCTION)


def test_option_features(spark):
    row = ("train", "1", "질문 1?", "가나", "", "12", "abc", "A")
    df = spark.createDataFrame([row], "split string, id string, question string, a string, b string, c string, d string, answer string")
    r = pf.answer_length_artifact(pf.option_similarity(pf.text_features(df), "_norm"), "_norm").first()
    assert (r.option_char_mean, r.option_char_min, r.option_char_max, r.option_char_range) == (1.75, 0, 3, 3)
    assert r.numeric_option_count == 1 and r.question_has_digit and r.question_has_question_mark
    assert (r.answer_char_len, r.wrong_char_mean) == (2, pytest.approx(5 / 3))
    assert r.option_similarity_max == 0.0


def test_tokens_and_ngrams_of_compatible_forms(spark):
    df = spark.createDataFrame([("ＡＢＣ　abc ﬁne ①②",), (None,)], "t string")
    assert {r.token: r.n for r in pf.top_tokens(df, "t").collect()} == {"abc": 2, "fine": 1, "12": 1}
    sets = [sorted(r[0]) for r in pf.normalize_columns(df, ["t"]).select(tx.ngram_set(F.col("t_norm"))).collect()]
    assert sets == [sorted({"ab", "bc", "ca", "cf", "fi", "in", "ne", "e1", "12"}), []]
    rows = spark.createDataFrame([("ＡＢ", "ab", "a b", "x", "k")], "a string, b string, c string, d string, id string")
    got = pf.option_similarity(rows)
    assert got.columns == [*rows.columns, "option_similarity_mean", "option_similarity_max"] and got.first().option_similarity_mean == 0.5


def test_only_texts_that_may_change_leave_for_python(spark):
    import re
    import unicodedata

    safe = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]) if re.match(f"[{tx.COMPATIBLE}]", c)]
    assert len(safe) > 30_000 and all(unicodedata.is_normalized("NFKC", x + c) for c in safe for x in ("", "e", "가", "か"))
    texts = ["plain", "Grüße, l’été", "가격은 얼마", "", None, "ﬁ", "e\u0301", "Ａ１", "x\u00a0y", "½", "😀 ㎏", "각\u11a8", "a\nﬁ"]
    assert column(spark, tx.nfkc(F.col("t")), texts) == [t and unicodedata.normalize("NFKC", t) for t in texts]
    sent = spark.createDataFrame([(t,) for t in texts[:4]], "t string").select(tx.nfkc(F.col("t")).alias("t"))
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and column(spark, F.col("t").rlike(f"[^{tx.COMPATIBLE}]"), texts[:4]) == [False] * 4
