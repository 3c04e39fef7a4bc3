import pytest
from pyspark.sql import functions as F

from itemloom.operators import ocr, quality as qc
from itemloom.sources import readers as rd, schema as sc, writers as wr


def test_detect_columns():
    got = sc.detect_columns(["Image_ID", "img_path", "Query", "option1", "option2", "option3", "option4"])
    assert (got.id, got.path, got.question, got.answer) == ("Image_ID", "img_path", "Query", None) and got.choices[0] == "option1"
    assert sc.detect_columns(["id", "path", "질문", "A", "B", "C", "D", "정답"]).answer == "정답"
    with pytest.raises(ValueError, match="choices"):
        sc.detect_columns(["id", "path", "question", "a", "b"])
    assert sc.detect_columns(["x", "path", "question", "1", "2", "3", "4"], id="x").id == "x"


def test_read_splits_with_line_breaks(spark, tmp_path):
    (tmp_path / "train.csv").write_text('id,question,answer\n1,"a ""b""\nnext",a\n', encoding="utf-8")
    (tmp_path / "test.csv").write_text("id,question\n2,q\n", encoding="utf-8")
    got = {r.id: r for r in rd.read_splits(spark, str(tmp_path), ["train", "test"]).collect()}
    assert got["1"].question == 'a "b"\nnext' and got["1"].split == "train" and got["2"].answer is None


def test_edit_list_keeps_blanks(spark, tmp_path):
    (tmp_path / "changes.csv").write_text('id,action,field,before,after\nx,edit_option,a,,"NA"\ny,delete,,,\n', encoding="utf-8")
    got = rd.read_edit_list(spark, str(tmp_path / "changes.csv"), ["id", "action", "field", "before", "after"]).collect()
    assert got[0].before == "" and got[0].after == "NA" and got[1].after == ""


def test_records_keep_what_does_not_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,action,note\nx,edit,"two\nlines, ""quoted"""\nshort\ny,delete,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,action,note\nz,delete,too,many\n", encoding="utf-8")
    got = {r.id: r for r in rd.read_records(spark, str(tmp_path), ["id", "action", "note"]).collect()}
    assert set(got) == {"x", "short", "y", "z"}
    assert got["x"].note == 'two\nlines, "quoted"' and got["x"].bad_record is None and got["y"].note == ""
    assert got["short"].bad_record.startswith("short") and got["short"].action is None
    assert got["z"].bad_record.startswith("z,delete,too,many") and (got["x"].source_file, got["z"].source_file) == ("a.csv", "b.csv")


def test_flatten_python_literals(spark):
    text = "[{'question': 'a  b', 'answer': ' x '}, {'question': 'c', 'answer': 'y'}]"
    got = rd.flatten_qa(spark.createDataFrame([("g", text)], "img string, qa string"), "img", "qa").orderBy("k").collect()
    assert [(r.k, r.question, r.answer_text) for r in got] == [(0, "a b", "x"), (1, "c", "y")]


def test_image_bytes(spark):
    df = spark.createDataFrame([("aGk=",), ("data:image/png;base64,aGk=",)], "t string")
    assert [bytes(r[0]) for r in df.select(rd.image_bytes(F.col("t"))).collect()] == [b"hi", b"hi"]


def test_probability_checks(spark):
    bad = spark.createDataFrame([(1, [0.5, 0.5])], "id int, probs array<double>")
    with pytest.raises(Exception, match="four probabilities"):
        rd.as_runs(bad).collect()
    good = spark.createDataFrame([("v", 1, [0.25] * 4)], "variant string, id int, probs array<double>")
    assert rd.check_variant_table(good, 1) is good
    with pytest.raises(qc.ContractError):
        rd.check_variant_table(good, 2)


def test_subset_file_and_hints(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("1 3\n\n 7\t", encoding="utf-8")
    df = spark.createDataFrame([(i,) for i in range(5)], "id int")
    assert sorted(r.id for r in rd.subset_by_id_file(df, spark, str(tmp_path / "ids.txt")).collect()) == [1, 3]
    hints = spark.createDataFrame([("1", "first", 0), ("1", "last", 1)], "id string, ocr_text string, pos int")
    assert {r.id: r.ocr_text for r in rd.attach_hints(df, hints).collect()}[1] == "last"


def test_path_resolution_order(spark):
    files = spark.createDataFrame([("r2/x.jpg",), ("r1/train/x.jpg",), ("/abs/y.jpg",), ("r1/images/y.jpg",)], "path string")
    df = spark.createDataFrame([("x.jpg",), ("/abs/y.jpg",), ("deep/x.jpg",), ("none.jpg",)], "path string")
    got = {r.path: r.resolved for r in sc.resolve_paths(df, files, ["r1", "r2"]).collect()}
    assert got == {"x.jpg": "r1/train/x.jpg", "/abs/y.jpg": "/abs/y.jpg", "deep/x.jpg": "r1/train/x.jpg", "none.jpg": ""}


def test_write_split_and_reuse(spark, tmp_path):
    split = spark.createDataFrame([(1, "q, \"x\"\ny", True), (2, "b", False)], "id int, question string, is_validation boolean")
    meta = spark.createDataFrame([(2,)], "n int")
    calls = []

    def build():
        calls.append(1)
        return split, meta

    paths = wr.ensure_split(spark, str(tmp_path / "s"), build)
    assert wr.ensure_split(spark, str(tmp_path / "s"), build) == paths and len(calls) == 1
    back = {r.id: r for r in rd.read_csv(spark, paths["rows"]).collect()}
    assert back["1"].question == 'q, "x"\ny' and back["1"].split == "validation"
    assert [r.id for r in rd.read_csv(spark, paths["ids"]).collect()] == ["1"]


def test_ensure_table_rebuilds_on_other_count(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for expected in (3, 3, 4):
        wr.ensure_table(spark, str(tmp_path / "t"), build, expected)
    assert len(calls) == 2


def test_cached_runs_compute_only_new(spark, tmp_path):
    seen = []

    def compute(fresh):
        seen.append(fresh.count())
        return fresh.withColumn("p", F.col("id") * 1.0)

    def requests(ids):
        return spark.createDataFrame([("t", 0, "full", i) for i in ids], "tag string, run int, view string, id int")

    for ids in ([1, 2], [1, 2], [2, 3]):
        out = wr.cached_runs(spark, str(tmp_path / "c"), requests(ids), compute)
        assert sorted(r.id for r in out.collect()) == ids
    assert seen == [2, 1]


def test_config_guard(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None)], "key string, value string")
    wr.guard_config(a, a)
    with pytest.raises(qc.ContractError, match="x: 1 -> 2"):
        wr.guard_config(a, spark.createDataFrame([("x", "2"), ("y", None)], "key string, value string"))


def test_reading_order(spark):
    def box(x, y):
        return [(x, y), (x + 9.0, y), (x + 9.0, y + 5.0), (x, y + 5.0)]
    rows = [(1, box(50.0, 3.0), "b", 0.9), (1, box(5.0, 12.0), "a", 0.9), (1, box(0.0, 61.0), "c", 0.4), (1, box(0.0, 0.0), "x", 0.1), (2, box(0.0, 0.0), "z", 0.2)]
    df = ocr.box_corner(spark.createDataFrame(rows, "image_id int, box array<struct<x:double,y:double>>, txt string, conf double"))
    texts = ocr.reading_order_text(df)
    assert [(r.image_id, r.ocr_text) for r in texts.collect()] == [(1, "a | b | c")]
    shared = ocr.share_texts(spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id int, image_id int"), texts)
    assert {r.id: r.ocr_text for r in shared.collect()} == {10: "a | b | c", 11: "a | b | c", 12: ""}
    assert ocr.empty_count(shared).first()["empty"] == 1
