"""Best-fit packing planned over the histogram of lengths.

Only counts per length reach the driver (at most one row per length up to the
capacity). Best-fit decreasing runs over those counts: each step fills a whole
group of sequences that have the same room with as many pieces of one length as
fit, so a plan of a few thousand runs covers any number of documents. Pieces
then take their slots by joining on their rank within their length; ranks are
counted in hashed blocks and shifted by the blocks before, so no length is
sorted in one task.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.llm._bytes import batch_rows, trimmed
from hopweave.storage import materialize

#: Rows of one length that are ranked together, about.
BLOCK = 5_000
#: Different words whose ids a worker keeps, and the length in characters up to which it does.
KEPT, LONGEST = 400_000, 24
_encoders: dict[str, object] = {}

# White space as the published split pattern of byte-level BPE vocabularies of this kind takes it, a fixed value.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _words(spec: dict):
    """The compiled split pattern of a byte-level BPE without normaliser; None for any other tokenizer.

    Letters and numbers are listed for Latin script only (through U+024F), where no version of Unicode differs; other texts are not split here.
    """
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or model.get("dropout") or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    kind = lambda k: "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == k)
    letter, number = kind("L"), kind("N")
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{_BLANK}{letter}{number}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


class Encoder:
    """texts -> little-endian uint32 ids of each by the tokenizers library, without special tokens added.

    A byte-level BPE never joins what its split pattern cuts, so the library is asked for the ids of a different word only once, many words at a
    time, and a text's ids are those of its words put together. Texts that hold the string of an added token, or a character that the
    pattern here does not know, and all texts of other tokenizers go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern, self.kept = _words(spec), {}
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for piece, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(piece)  # a character of a byte-level piece is a byte
        # Punctuation blocks that are neither letters nor numbers nor blanks in any version are known too.
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", ())]
        self.whole = re.compile("|".join([*added, "[^\\x00-\u024f\u2010-\u2027\u2030-\u205e]"]))

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _ask_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of different words. A blank with letters behind it is a word wherever it stands, so many of these are asked for as one text, and told apart by their bytes."""
        plain = [w for w in words if w[0] == " " and w[1:].isalpha()]
        other = [w for w in words if not (w[0] == " " and w[1:].isalpha())]
        out = dict(zip(other, self._ask(other)))
        runs = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        for run, ids in zip(runs, self._ask(["".join(r) for r in runs])):
            ends = np.cumsum([len(w.encode()) for w in run])
            have = np.cumsum(self.size[np.frombuffer(ids, "<u4")])
            cut = np.searchsorted(have, ends)
            if not np.array_equal(have[np.minimum(cut, len(have) - 1)], ends):
                raise AssertionError("a piece reaches over the end of a word")
            cut = [0, *((cut + 1) * 4).tolist()]
            out.update((w, ids[a:b]) for w, a, b in zip(run, cut, cut[1:]))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        slow = [i for i, t in enumerate(texts) if self.pattern is None or self.whole.search(t)]
        for i, ids in zip(slow, self._ask([texts[i] for i in slow])):
            out[i] = ids
        words = {i: self.pattern.findall(texts[i]) for i, x in enumerate(out) if x is None}
        fresh = list({w for ws in words.values() for w in ws if w not in self.kept})
        self.kept.update(self._ask_words(fresh))
        for i, ws in words.items():
            out[i] = b"".join([self.kept[w] for w in ws])
        if len(self.kept) > KEPT:
            self.kept.clear()
        for w in fresh:
            if len(w) > LONGEST:
                self.kept.pop(w, None)
        return out


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizers file, built once per worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids with end_id after them.

    Documents longer than capacity are cut into pieces of capacity ids of which the first may be shorter. Null text
    counts as empty: one piece with end_id. Every row counts, repeated ids and a null doc_id too.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        encode = encoder(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for a in range(0, batch.num_rows, 500):
                texts = batch["text"][a : a + 500].to_pylist()
                for doc, ids in zip(batch["doc_id"][a : a + 500].to_pylist(), encode([t or "" for t in texts])):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        for x, v in zip(out, (doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e]))):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, pieces per sequence, offset) of best-fit decreasing."""
    room: dict[int, list[tuple[int, int]]] = {}  # room -> groups (first sequence, how many)
    rooms: list[int] = []
    runs, opened = [], 0

    def put(r: int, first: int, k: int) -> None:
        if r and k:
            if r not in room:
                bisect.insort(rooms, r)
            room.setdefault(r, []).append((first, k))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                r = rooms[at]
                first, k = room[r].pop()
                if not room[r]:
                    del room[r], rooms[at]
            else:
                r = capacity
                k = -(-left // (capacity // length))
                first, opened = opened, opened + k
            each = r // length
            full = min(k, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - r))
                put(r - each * length, first, full)
                rank, left, first, k = rank + full * each, left - full * each, first + full, k - full
            if k and left:  # fewer are left than one more sequence takes
                runs.append((length, rank, rank + left, first, left, capacity - r))
                put(r - left * length, first, 1)
                rank, left, first, k = rank + left, 0, first + 1, k - 1
            put(r, first, k)
    return runs


def pack(pieces: DataFrame, capacity: int, key: list[str]) -> DataFrame:
    """pieces with sequence_id and offset. length is 1 to capacity; key orders equal lengths; pieces must be a stored table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    # Each length's own number of blocks: capacity rows at most.
    blocks = spark.createDataFrame([(n, -(-c // BLOCK)) for n, c in counts.items()], "length long, _blocks long")
    runs = spark.createDataFrame(plan(counts, capacity), "length long, r0 long, r1 long, s0 long, per long, base long")
    dealt = pieces.join(F.broadcast(blocks), "length").withColumn("_block", F.pmod(F.xxhash64(*key), F.col("_blocks"))).drop("_blocks")
    each = dealt.groupBy("length", "_block").count()
    before = each.select("length", "_block", (F.sum("count").over(W.partitionBy("length").orderBy("_block")) - F.col("count")).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_block").orderBy(*key)) - 1)
    ranked = ranked.join(before, ["length", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # The plan has a few rows per length, whatever the data.
    slot = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("_rank") >= F.col("r0")) & (F.col("_rank") < F.col("r1"))).drop(runs["length"])
    at = F.col("_rank") - F.col("r0")
    return slot.select(*pieces.columns, (F.col("s0") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"), (F.col("base") + at % F.col("per") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every row of docs(doc_id, text), packed best-fit decreasing.

    Null text counts as empty, a document of end_id alone. Rows that repeat a doc_id and rows without one are documents of their own, each packed whole.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    batch_rows(docs.sparkSession, 1000)
    return pack(materialize(token_pieces(docs, tokenizer_path, end_id, capacity), "pack-pieces"), capacity, ["doc_id", "piece"])


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
