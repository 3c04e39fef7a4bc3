"""Byte-level BPE over Arrow batches with the tokenizers library.

A text is cut by the split pattern; every match is a piece of its own. Pieces are written with the byte-to-character
table (each of the 256 bytes has one printable character) and merged by rank. A table of bounded size inside the worker
keeps the ids of frequent parts, so that repeated words are merged once. Decoding reverses the byte table and
joins bytes before reading them as UTF-8, so a character whose bytes fall into several tokens comes back whole.

Null text counts as empty: no ids, the hash of nothing. Every row gives one row; rows are independent, so repeated rows
and any text length are fine. Input columns other than the id and the text are not carried along.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from array import array
from collections.abc import Iterator
from types import ModuleType

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

#: Parts kept in a worker before the table is emptied and filled anew (about 0.3 KB each).
CACHE_PARTS = 900_000
#: Characters of text cut into parts before new parts are merged together.
CHUNK = 2_000_000
#: Stands between pieces that are merged in one call.
BREAK = "\U0010ffff"

FIELDS = {
    "n_tokens": "long", "ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "ids_sha256": "string",
    "decoded": "string", "decoded_sha256": "string",
}


def byte_characters() -> str:
    """One printable character for every byte: itself where it prints in Latin-1, else the next one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in prints else next(spare)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder of one rank file and split pattern.

    The pattern keeps white space together but for the last space before a word, so a text may be cut before every
    space that is followed by something other than white space without changing any match. The parts between such
    spaces repeat a lot and are what the table of the worker holds, with their ids.
    """

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.split = regex.compile(pattern).finditer
        self.find = regex.compile(pattern).findall
        self.loose = regex.compile(r" (?=\s|$)").search
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        table = dict(enumerate(byte_characters()))

        def spelled(data: bytes) -> str:
            return data.decode("latin-1").translate(table)

        merges = [
            (spelled(token[:i]), spelled(token[i:]))
            for token in sorted(ranks, key=ranks.get)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        vocab = {spelled(token): rank for token, rank in ranks.items()}
        self.merger = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))
        self.merger.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(BREAK, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # parts that begin a text, and parts after a space; each with joined decimal ids and the ids as 32-bit numbers
        self.first: dict[str, tuple[str, bytes]] = {}
        self.later: dict[str, tuple[str, bytes]] = {}

    def merge(self, pieces: list[str]) -> dict[str, list[int]]:
        """Ids of distinct pieces: many in one string, told apart by a character that is in none of them."""
        out: dict[str, list[int]] = {}
        plain = [p for p in pieces if BREAK not in p]
        if len(plain) < len(pieces):
            alone = Tokenizer(self.merger.model)
            alone.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            out |= {p: alone.encode(p, add_special_tokens=False).ids for p in pieces if BREAK in p}
        groups = [plain[i : i + 2000] for i in range(0, len(plain), 2000)]
        joined = [BREAK.join(g) for g in groups]
        for group, got in zip(groups, self.merger.encode_batch(joined, add_special_tokens=False), strict=True):
            for p in group:
                out[p] = []
            for i, word in zip(got.ids, got.word_ids, strict=True):
                out[group[word]].append(i)
        return out

    def forget(self) -> None:
        """Empty the table: a worker lives on and serves other operators, which need its memory."""
        self.first.clear()
        self.later.clear()

    def learn(self, first: set[str], later: set[str]) -> None:
        """Add the parts that the table lacks."""
        new_first, new_later = first - self.first.keys(), later - self.later.keys()
        if not new_first and not new_later:
            return
        if len(self.first) + len(self.later) + len(new_first) + len(new_later) > CACHE_PARTS:
            self.forget()
            new_first, new_later = first, later
        cut = [(self.first, p, self.find(p)) for p in new_first] + [(self.later, p, self.find(" " + p)) for p in new_later]
        ids_of = self.merge(list({piece for _, _, pieces in cut for piece in pieces}))
        for into, part, pieces in cut:
            ids = ids_of[pieces[0]] if len(pieces) == 1 else [i for piece in pieces for i in ids_of[piece]]
            into[part] = ",".join(map(str, ids)), array("I", ids).tobytes()

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """Parts without a leading space, then the parts after one; a text with loose spaces is cut into its matches."""
        if self.loose(text):
            return self.find(text), []
        first, *later = text.split(" ")
        return [first], later

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])

    def offsets(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """First character and end (exclusive) of every token; a token inside a character covers that character."""
        owner = [k for k, ch in enumerate(text) for _ in range(len(ch.encode()))]
        starts, ends, at = [], [], 0
        for i in ids:
            size = len(self.bytes_of[i])
            starts.append(owner[at])
            ends.append(owner[at + size - 1] + 1)
            at += size
        return starts, ends

    def rows(self, texts: list[str], wanted: tuple[str, ...]) -> Iterator[tuple]:
        """A tuple of the wanted fields per text; new parts of about ``CHUNK`` characters are merged together."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < CHUNK):
                size += len(texts[stop])
                stop += 1
            cut = [self.parts(t) for t in texts[start:stop]]
            self.learn(set().union(*(f for f, _ in cut)), set().union(*(r for _, r in cut)))
            for text, (first, later) in zip(texts[start:stop], cut, strict=True):
                own, more = self.first, self.later
                yield self.row(text, [own[p] for p in first] + [more[p] for p in later], wanted)
            start = stop

    def row(self, text: str, got: list[tuple[str, bytes]], wanted: tuple[str, ...]) -> tuple:
        ids = array("I", b"".join([p[1] for p in got])).tolist()
        out = {"n_tokens": len(ids), "ids": ids}
        if "ids_sha256" in wanted:
            out["ids_sha256"] = hashlib.sha256(",".join([p[0] for p in got if p[0]]).encode()).hexdigest()
        if "starts" in wanted or "ends" in wanted:
            out["starts"], out["ends"] = self.offsets(text, ids)
        if "decoded" in wanted or "decoded_sha256" in wanted:
            back = self.decode(ids)
            out["decoded"] = back.decode("utf-8", "replace") if "decoded" in wanted else None
            out["decoded_sha256"] = hashlib.sha256(back).hexdigest()
        return tuple(out[w] for w in wanted)


def slices(rows: Iterator[tuple], texts: list[str]) -> Iterator[list[tuple]]:
    """The rows of ``texts`` in runs of about ``CHUNK`` characters, so that a task never holds the ids of a whole batch."""
    held, size = [], 0
    for text, row in zip(texts, rows, strict=True):
        held.append(row)
        size += len(text)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def codec(path: str, pattern: str) -> Codec:
    """Built once per worker process and vocabulary, so that tasks that follow one another share its table."""
    held = sys.modules.setdefault("_itemloom_worker", ModuleType("_itemloom_worker")).__dict__.setdefault("codecs", {})
    if (path, pattern) not in held:
        held.clear()
        held[path, pattern] = Codec(path, pattern)
    return held[path, pattern]


def encode(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
    columns: tuple[str, ...] = ("n_tokens", "ids", "starts", "ends"),
) -> DataFrame:
    """Ids of every text, without special tokens, and what else ``columns`` names (keys of ``FIELDS``).

    ``path`` names a rank file that every executor can open. ``starts`` and ``ends`` are character offsets; ``decoded``
    is the text read back from the ids; ``ids_sha256`` hashes the decimal ids joined by commas.
    """
    chosen = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        gc.disable()  # the table holds no cycles, and scanning it again and again costs more than the merges
        try:
            for batch in batches:
                texts, start = batch.column(1).to_pylist(), 0
                for rows in slices(own.rows(texts, columns), texts):
                    made = [pa.array(list(c), arrow[FIELDS[n]]) for n, c in zip(columns, zip(*rows, strict=True), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)), *made], ["id", *columns])
                    start += len(rows)
        finally:
            own.forget()
            gc.enable()

    schema = ", ".join([f"id {kind}", *(f"{c} {FIELDS[c]}" for c in columns)])
    return chosen.mapInArrow(work, schema).withColumnRenamed("id", id_column)


def decode(
    tokens: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """Text of every id list as ``decoded``; null ids give empty text, bytes that are no UTF-8 the replacement mark."""
    chosen = tokens.select(F.col(id_column).alias("id"), F.col(ids_column).cast("array<int>").alias("ids"))
    kind = chosen.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode(ids or ()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    return chosen.mapInArrow(work, f"id {kind}, decoded string").withColumnRenamed("id", id_column)
