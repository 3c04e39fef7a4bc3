import base64
import hashlib
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from itemloom.llm import bpe, exact, shards


def lower(text):
    return (text or "").translate(str.maketrans(exact.UPPER, exact.LOWER))


def copies_of(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return {t: (max((x for x in ids if x is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("weak", ["none", "key", "digest"])
def test_exact_duplicates_match_brute_force(spark, odd_docs, weak):
    options = {"capacity": 2}
    if weak != "none":  # keys, and then digests, that say little: collisions chain, and bytes decide
        options["key"] = lambda t: F.length(t) % 3 - 1
    if weak == "digest":
        options["digest"] = lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)
    got = exact.exact_duplicates(odd_docs, **options).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = copies_of(rows)
    assert len(got) == len(rows)
    text_of = {}
    for i, t in rows:
        text_of.setdefault(i, set()).add(lower(t))
    for r in got:
        assert any((r["keep_id"], r["group_size"]) == want[t] for t in text_of[r["doc_id"]])
    assert sum(r["kept"] for r in got) == len(want)
    if weak != "digest":
        assert {r["text_sha256"] for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in want}


def test_first_of_copies_keeps_one_row_and_all_columns(odd_docs, no_docs):
    kept = exact.first_of_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [lower(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({lower(r["text"]) for r in odd_docs.collect()})
    assert exact.first_of_copies(no_docs).count() == 0
    assert exact.exact_duplicates(no_docs).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"))
    found = exact.directory(keys, 50).orderBy("bucket_low").collect()
    assert sum(r["n_keys"] for r in found) == 4000 and max(r["n_keys"] for r in found) <= 50
    assert all(a["bucket_high"] < b["bucket_low"] for a, b in zip(found, found[1:]))
    same = spark.range(9).select(F.lit(5).cast("long").alias("key")).distinct()
    assert [r["depth"] for r in exact.directory(same, 1).collect()] == [0]


def test_byte_shards(odd_docs, no_docs):
    got = shards.byte_shards(odd_docs, shards=4).orderBy("shard", "slot").collect()
    rows = odd_docs.collect()
    assert len(got) == len(rows)
    sizes = sorted(len((r["text"] or "").encode()) + 1 for r in rows)
    assert sorted(r["size"] for r in got) == sizes
    assert sorted(r["text_crc32"] for r in got) == sorted(zlib.crc32((r["text"] or "").encode()) for r in rows)
    start = 0
    for r in got:  # contiguous in the order of ids, cut at equal targets
        assert r["offset"] == start
        assert r["shard"] == min(3, (2 * start + r["size"]) * 4 // (2 * sum(sizes)))
        start += r["size"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    for shard in {r["shard"] for r in got}:
        slots = [r["slot"] for r in got if r["shard"] == shard]
        assert slots == list(range(len(slots)))
    assert shards.byte_shards(no_docs).count() == 0


PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_reference_encoder(spark, odd_docs, known):
    texts = [r["text"] for r in odd_docs.collect()] + [
        "a  b   c", " lead", "trail ", "a\n\n  b\t c\r\n", "don't they'll 's", "é" * 50, "\U0010ffff x\U0010ffff", "x y　z", "<|endoftext|>", "\x1c \x85 a",
        "1234567 漢字かな😀😀 ñandú",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in bpe.encode(docs, PATH, P.PATTERN, columns=tuple(bpe.FIELDS)).collect()}
    for i, t in enumerate(texts):
        ids = known.encode_ordinary(t or "")
        r = got[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded"] == (t or "") and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        for k, (a, b) in enumerate(zip(r["starts"], r["ends"])):
            assert known.decode_single_token_bytes(ids[k]) in (t or "")[a:b].encode()


def test_bpe_decodes_split_characters_and_refills_its_table(spark, known, monkeypatch):
    texts = ["😀 漢字 naïve", "words and words", "other words"]
    monkeypatch.setattr(bpe, "CACHE_PARTS", 2)
    monkeypatch.setattr(bpe, "CHUNK", 1)
    own = bpe.Codec(PATH, P.PATTERN)
    assert [r[0] for r in own.rows(texts, ("ids",))] == [known.encode_ordinary(t) for t in texts]
    ids = spark.createDataFrame([(1, known.encode_ordinary(texts[0])), (2, None), (3, known.encode_ordinary("😀")[:1])], "doc_id int, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(ids, PATH, P.PATTERN).collect()}
    assert got[1] == texts[0] and got[2] == "" and got[3] != "😀"
    assert bpe.encode(ids.limit(0).select("doc_id", F.lit("").alias("text")), PATH, P.PATTERN).count() == 0


def test_bpe_hands_rows_on_before_a_batch_ends(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 10)
    own = bpe.Codec(PATH, P.PATTERN)
    texts = ["word and word", "a", "", "more words", "b" * 25, "c"]
    runs = list(bpe.slices(own.rows(texts, ("n_tokens",)), texts))
    assert [len(r) for r in runs] == [1, 3, 1, 1] and [x for r in runs for x in r] == list(own.rows(texts, ("n_tokens",)))
    assert list(bpe.slices(own.rows([], ("n_tokens",)), [])) == []


def test_bpe_leaves_no_table_in_the_worker(spark, odd_docs):
    def held(batches):
        import sys

        import pyarrow as pa

        codecs = getattr(sys.modules.get("_itemloom_worker"), "codecs", {})
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"id": [sum(len(c.first) + len(c.later) for c in codecs.values())]})

    assert bpe.encode(odd_docs, PATH, P.PATTERN).count() == odd_docs.count()
    bpe.encode(odd_docs, PATH, P.PATTERN).collect()
    assert {r["id"] for r in spark.range(0, 64, 1, 8).mapInArrow(held, "id long").collect()} == {0}
