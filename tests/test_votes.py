import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from itemloom.operators import votes as vt

COLS = [f"answer{i}" for i in range(1, 6)]
SCHEMA = "id int, " + ", ".join(f"{c} string" for c in COLS)
ROWS = [
    (0, "a", "a", "a", "a", "a"), (1, "b", "a", "b", "a", "b"), (2, "c", "a", "a", "c", "b"), (3, "d", "b", None, None, None),
    (4, None, None, None, None, None), (5, " A", "a", "x", "B", "b"), (6, "d", None, "c", "b", "a"),
]


def test_vote_features_first_tie(spark):
    got = {r.id: r for r in vt.vote_features(spark.createDataFrame(ROWS, SCHEMA), COLS).collect()}
    for row in ROWS:
        counts = Counter(v for v in row[1:] if v is not None)
        r = got[row[0]]
        n = sum(counts.values())
        ranked = counts.most_common()
        assert r.vote_count == n
        assert r.majority_answer == (ranked[0][0] if n else None)
        assert r.is_tie == (len(ranked) > 1 and ranked[1][1] == ranked[0][1])
        if n:
            assert r.vote_entropy == pytest.approx(-sum(c / n * math.log2(c / n) for c in counts.values()), abs=1e-12)
            assert math.copysign(1, r.vote_entropy) == 1
        else:
            assert r.vote_entropy is None and r.consensus_ratio is None and r.top_vote_count == 0


def test_vote_features_joined_tie(spark):
    got = {r.id: r for r in vt.vote_features(spark.createDataFrame(ROWS, SCHEMA), COLS, "joined", True).collect()}
    assert got[2].majority_answer == "a/c" and got[6].majority_answer == "a/b/c/d" and got[5].majority_answer == "a/b"
    assert got[5].vote_count == 4 and got[4].majority_answer is None and not got[4].is_tie


def test_vector_codes_and_unknown(spark):
    df = spark.createDataFrame([("1", "2.0", " C ", "", None), ("5", "a", "4.0", "d", "d")], ", ".join(f"{c} string" for c in COLS))
    got = vt.with_patterns(vt.vote_vector(df)).collect()
    assert got[0].votes == [1, 1, 1, 0] and got[0].unknown_votes == 0 and got[0].human_answer == "a" and not got[0].top_unique
    assert got[1].votes == [1, 0, 0, 3] and got[1].unknown_votes == 1 and got[1].vote_pattern == "3:1" and got[1].top_unique


def test_vote_strings(spark):
    texts = ["A|B|B|a", '{"a": 2, "D": 1}', "{'b': 3}", "[1, 0, 2, 0]", "(0, 0, 0, 4)", "", None, "oops"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(vt.parse_vote_string(F.col("t"))).collect()]
    assert got == [[2, 2, 0, 0], [2, 0, 0, 1], [0, 3, 0, 0], [1, 0, 2, 0], [0, 0, 0, 4], [0] * 4, [0] * 4, None]


def test_spec_detection():
    assert vt.detect_vote_spec(["id", "answer10", "answer2", "votes"]) == ("annotators", ["answer2", "answer10"])
    kind, names = vt.detect_vote_spec(["id", "a_cnt", "b_cnt", "c_cnt", "d_cnt"])
    assert kind == "counts" and names["d"] == "d_cnt"
    assert vt.detect_vote_spec(["vote_dist"]) == ("string", "vote_dist")
    assert vt.detect_vote_spec(["id"]) is None


def test_tied_pattern_is_refused(spark):
    with pytest.raises(ValueError):
        vt.keep_patterns(spark.range(1), ["2:2:1"])
