"""SentencePiece models on the tokenizers library.

The model protobuf is parsed here (no sentencepiece library is needed to encode
or decode): pieces with scores and types, the trainer's kind of model and byte
fallback, and the normaliser. A tokenizers pipeline is rebuilt from them:
normaliser, the marker for blanks, scores (unigram) or merges in the order of
scores (BPE), byte fallback, and the matching decoder. Each task holds some of its texts
against the sentencepiece library, unless it is told not to.

Pieces that no text may match (unknown, control, bytes) have names of their own in a unigram
vocabulary, so that a text which spells them is cut like any other; what is unknown is spelled
in byte pieces afterwards.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._bytes import batch_rows, trimmed

SPACE = "▁"
# Piece types of the protobuf, fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads of a task's batches, and the length of the texts that are held against the sentencepiece library.
THREADS, VERIFIED_CHARS = 2, 20_000


def _fields(data: bytes):
    """(field number, value) of a protobuf message; varints as int, the rest as bytes."""
    at, n = 0, len(data)

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


def read_model(data: bytes) -> dict:
    """Pieces [(text, score, type)] and the settings that encoding depends on."""
    out = {"pieces": [], "kind": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True, "suffix": False}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            out["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            t = dict(_fields(value))
            out |= {"kind": t.get(3, UNIGRAM), "byte_fallback": bool(t.get(35, 0)), "suffix": bool(t.get(24, 0))}
        elif number == 3:
            t = dict(_fields(value))
            out |= {"charsmap": t.get(2, b""), "dummy_prefix": bool(t.get(3, 1)), "squeeze": bool(t.get(4, 1)), "escape": bool(t.get(5, 1))}
    return out


#: Before the name of a reserved piece in a unigram vocabulary: noncharacters, which no text of Unicode characters holds.
HIDDEN = "\U0010ffff\U0010fffe"


class ParityError(ValueError):
    """The sentencepiece library gives other ids or another text."""


class Pieces:
    """Encodes and decodes as a sentencepiece model does."""

    def __init__(self, model: dict):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if model["suffix"] or not model["escape"]:
            raise ValueError("models that mark blanks as a suffix, or not at all, are not supported")
        pieces = model["pieces"]
        self.unigram, self.scores = model["kind"] == UNIGRAM, [x for _, x, _ in pieces]
        self.unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), None)
        self.silent = {i for i, p in enumerate(pieces) if p[2] == CONTROL}
        names = {p: i for i, (p, _, _) in enumerate(pieces)}
        self.bytes = [names.get(f"<0x{b:02X}>") for b in range(256)] if model["byte_fallback"] else None
        if self.unigram:
            top = max((s for _, s, k in pieces if k == NORMAL), default=0.0)
            # A user-defined piece always wins, by the library's rule: the best score for each of its bytes, less a tenth.
            score = lambda p, s, k: len(p.encode()) * top - 0.1 if k == USER_DEFINED else s
            core = models.Unigram([(HIDDEN + p if k in (UNKNOWN, CONTROL, BYTE) else p, score(p, s, k)) for p, s, k in pieces], self.unk, False)
        elif model["kind"] == BPE:
            merges = []
            for piece, score, kind in pieces:
                if kind == NORMAL and len(piece) > 1:
                    for k in range(1, len(piece)):
                        left, right = piece[:k], piece[k:]
                        if left in names and right in names:
                            merges.append((-score, names[piece], names[left], names[right], left, right))
            core = models.BPE(names, [(x[4], x[5]) for x in sorted(merges)], unk_token=pieces[self.unk][0] if self.unk is not None else None, fuse_unk=True, byte_fallback=model["byte_fallback"])
        else:
            raise ValueError("word and character models are not supported")
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
        if model["squeeze"]:
            steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if model["dummy_prefix"]:
            steps.append(normalizers.Prepend(SPACE))  # an empty text stays empty
        self.tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
        own = [p for p, _, kind in pieces if kind == USER_DEFINED]
        # No piece has the marker after another character, so cutting before each run of markers changes no result.
        if not any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces):
            self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), "isolated")
        if own and not self.unigram:
            self.tokenizer.add_tokens([AddedToken(p, normalized=True, special=False) for p in own])
        # The decoder's vocabulary has the names as they are; the unknown piece is shown by the library's mark.
        self.decoder = Tokenizer(models.WordLevel({" \u2047 " if i == self.unk else p: i for p, i in names.items()}, " \u2047 "))
        self.decoder.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else [])])

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        spelled = [k for k, ids in enumerate(out) if self.unk in ids] if self.unigram and self.bytes else []
        for k, e in zip(spelled, self.tokenizer.encode_batch([texts[k] for k in spelled], add_special_tokens=False) if spelled else ()):
            out[k] = [x for i, t in zip(e.ids, e.tokens) for x in ([self.bytes[b] for b in t.encode()] if i == self.unk else (i,))]
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode([i for i in ids if i not in self.silent] if self.silent.intersection(ids) else ids, skip_special_tokens=False)

    def tied(self, a: list[int], b: list[int]) -> bool:
        """Whether two segmentations of a text score alike; the library adds scores in single precision, so that rounding decides between them there."""
        if not self.unigram or (self.decode(a) != self.decode(b) and sorted(a) != sorted(b)):
            return False
        x, y = (sum(self.scores[i] for i in ids) for ids in (a, b))
        return abs(x - y) <= 1e-5 * max(1.0, abs(x))


_built: dict[bytes, Pieces] = {}


def tokenizer_of(data: bytes) -> Pieces:
    """The encoder of a model's bytes, built once per worker."""
    key = hashlib.blake2b(data).digest()
    if key not in _built:
        _built[key] = Pieces(read_model(data))
    return _built[key]


def parity(data: bytes, texts: list[str]) -> list[int]:
    """Positions of the texts that the sentencepiece library encodes or decodes otherwise; needs that library. Segmentations of one score are no difference."""
    import sentencepiece

    own = tokenizer_of(data)
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    mine, theirs = own.encode(texts), other.encode(texts)
    return [i for i, (a, b) in enumerate(zip(mine, theirs)) if not (a == b or own.tied(a, b)) or own.decode(b) != other.decode(b)]


def _verify(data: bytes, texts: list[str]) -> None:
    try:
        import sentencepiece  # noqa: F401
    except ImportError as e:
        raise ImportError("the sentencepiece library, which texts are to be held against, cannot be imported; verified=0 encodes unverified") from e
    if bad := parity(data, texts):
        raise ParityError(f"encoded or decoded otherwise: {texts[bad[0]][:200]!r}")


def encode(docs: DataFrame, model_path: str, texts_at_once: int = 256, verified: int = 8) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids, decoded): every whole text's ids, in multithreaded batches, and the ids' text.

    Each task compares its first ``verified`` texts of up to VERIFIED_CHARS characters with the sentencepiece library, and raises ParityError on
    a difference, ImportError without the library; with verified=0 nothing is compared. Null text counts as empty, which has no ids. Each row counts, repeated ones and those without a doc_id too; other columns are ignored;
    an empty table gives no rows.
    """
    batch_rows(docs.sparkSession, 1000)
    shared = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())  # the model, half a megabyte

    def run(batches):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        tokenizer, left = tokenizer_of(shared.value), verified
        for batch in batches:
            for a in range(0, batch.num_rows, texts_at_once):
                texts = [t or "" for t in batch["text"][a : a + texts_at_once].to_pylist()]
                if left:
                    some = [t for t in texts if len(t) <= VERIFIED_CHARS][:left]
                    if some:
                        _verify(shared.value, some)
                    left -= len(some)
                ids = tokenizer.encode(texts)
                back = [tokenizer.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a : a + texts_at_once], pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(trimmed(run), "doc_id long, ids array<int>, decoded string")


def summarise(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_ids, ids_crc32 of the little-endian unsigned 32-bit ids, decoded_sha256)."""

    def run(batches):
        for batch in batches:
            ids = batch["ids"]
            off = ids.offsets.to_numpy()
            flat = ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64()), batch["sha"]], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return encoded.select("doc_id", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("sha")).mapInArrow(trimmed(run), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32 and decoded_sha256, the digest of the text that the ids decode to."""
    import public_tokenizers

    return summarise(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")))
