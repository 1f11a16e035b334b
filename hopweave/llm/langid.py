"""Language identification with segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability per language, learned
by expectation maximisation over all segmentations. A word's likelihood is the
sum over its segmentations, by the forward algorithm; a text's is the product
over its words. Words are letters and the marks that follow them, in lower case, so that case,
numbers of any kind and punctuation count for nothing. The forward algorithm runs over many
distinct words at once and each worker keeps the words it has seen.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._bytes import batch_rows, trimmed

#: At most about this many training documents per language.
SAMPLE_PER_LANGUAGE = 1500
MAX_PIECE, MAX_WORD, ROUNDS = 8, 24, 3
CACHE = 200_000


def _class(*kinds: str, first: int = 0, end: int = sys.maxunicode + 1) -> str:
    """The code points of some general categories as the inside of a character class."""
    out, start = [], None
    for c in range(first, end + 1):
        if c < end and unicodedata.category(chr(c))[0] in kinds:
            start = c if start is None else start
        elif start is not None:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return "".join(out)


@functools.cache
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Whether a text leaves U+02FF; words within it; words of any script."""
    letter = _class("L")
    return re.compile("[\u0300-\U0010ffff]"), re.compile(f"[{_class('L', end=0x300)}]+"), re.compile(f"[{letter}][{letter}{_class('M')}]*")


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    far, near, any_ = _patterns()
    return (any_ if far.search(text) else near).findall(text)


def vocabulary(path: str) -> list[str]:
    """Pieces of letters and marks, in lower case, of a public tokenizer: a tokenizers JSON with byte-level or word-end pieces."""
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    # The byte-level alphabet: printable bytes stand for themselves, others for code points from 256.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out = set()
    for piece in vocab:
        try:
            text = bytes(code[c] for c in piece).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        text = text.strip().lower()
        if 0 < len(text) <= MAX_PIECE and all(unicodedata.category(c)[0] in "LM" for c in text):
            out.add(text)
    return sorted(out)


class Unigrams:
    """Piece log-probabilities of each language; unknown characters get a floor."""

    def __init__(self, pieces: list[str], langs: list[str]):
        self.langs = langs
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.n = len(pieces) + 1  # the last stands for any other character
        self.p = np.full((self.n, max(1, len(langs))), 1.0 / self.n)

    def lattice(self, words: list[str]):
        """For words of one length: arrays (start, end) -> piece ids, -1 where no piece fits."""
        length, get = len(words[0]), self.ids.get
        return {(s, e): np.array([get(w[s:e], self.n - 1 if e == s + 1 else -1) for w in words]) for s in range(length) for e in range(s + 1, min(length, s + MAX_PIECE) + 1)}

    def forward(self, words: list[str], p: np.ndarray | None = None):
        """Log-likelihood of each word (cut into MAX_WORD letters at most), summed over its segmentations, per language."""
        p = self.p if p is None else p
        padded = np.vstack([p, np.zeros((1, p.shape[1]))])
        out = np.zeros((len(words), p.shape[1]))
        by = {}
        for i, w in enumerate(words):
            for k in range(0, len(w), MAX_WORD):  # the parts of a very long run count as words
                by.setdefault(len(w[k : k + MAX_WORD]), []).append((i, w[k : k + MAX_WORD]))
        for length, rows in by.items():
            grid = self.lattice([w for _, w in rows])
            alpha = [np.ones((len(rows), p.shape[1]))]
            for e in range(1, length + 1):
                alpha.append(sum(alpha[s] * padded[grid[s, e]] for s in range(max(0, e - MAX_PIECE), e)))
            np.add.at(out, [i for i, _ in rows], np.log(alpha[-1]))
        return out

    def fit(self, counts: dict[str, Counter]) -> None:
        """Expectation maximisation per language, from counts of words of MAX_WORD letters at most; pieces are smoothed with their share in all languages."""
        for j, lang in enumerate(self.langs):
            by: dict[int, list] = {}
            for w, c in counts[lang].items():
                by.setdefault(len(w), []).append((w, c))
            grids = [(length, self.lattice([w for w, _ in rows]), np.array([c for _, c in rows], float)) for length, rows in by.items()]
            p = self.p[:, j].copy()
            for _ in range(ROUNDS):
                q, got = np.append(p, 0.0), np.zeros(self.n + 1)
                for length, grid, c in grids:
                    a, b = [np.ones(len(c))], {length: np.ones(len(c))}
                    for e in range(1, length + 1):
                        a.append(sum(a[s] * q[grid[s, e]] for s in range(max(0, e - MAX_PIECE), e)))
                    for s in range(length - 1, -1, -1):
                        b[s] = sum(q[grid[s, e]] * b[e] for e in range(s + 1, min(length, s + MAX_PIECE) + 1))
                    for (s, e), k in grid.items():
                        np.add.at(got, k, a[s] * q[k] * b[e] * c / a[-1])
                p = got[:-1] + 1e-9
                p /= p.sum()
            self.p[:, j] = p
        mean = self.p.mean(1, keepdims=True)
        self.p = 0.98 * self.p + 0.015 * mean + 0.005 / self.n


def fit(docs: DataFrame, vocab_path: str, per_language: int = SAMPLE_PER_LANGUAGE) -> Unigrams:
    """Learn from docs(doc_id, text, lang) with a lang whose crc32(doc_id as text) mod 5 is not 0.

    The sample is bounded in documents: each language's are drawn by a hash of doc_id with the probability that gives
    ``per_language`` of them. All their words count, runs of over MAX_WORD letters in parts as in predictions. A language is any
    non-null value. Rows that repeat a doc_id all count or none does; other columns are not looked at.
    """
    batch_rows(docs.sparkSession, 1000)
    own = docs.where("lang is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = own.groupBy("lang").count().collect()  # a row a language
    if not sizes:
        return Unigrams(vocabulary(vocab_path), [])
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in sizes], "lang string, share double")
    picked = own.join(F.broadcast(share), "lang").where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)) < F.col("share")).select("lang", "text")

    def words(batches):
        for batch in batches:
            got: dict[tuple, int] = Counter()
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                for w, c in Counter(words_of(text)).items():
                    for k in range(0, len(w), MAX_WORD):
                        got[lang, w[k : k + MAX_WORD]] += c
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()), pa.array(list(got.values()), pa.int64())], ["lang", "word", "c"])

    top = picked.mapInArrow(trimmed(words), "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    counts = {r["lang"]: Counter() for r in sizes}
    for lang, word, c in zip(*(top[n].to_pylist() for n in ("lang", "word", "c"))):
        counts[lang][word] = c
    model = Unigrams(vocabulary(vocab_path), sorted(r["lang"] for r in sizes))
    model.fit(counts)
    return model


def predict(docs: DataFrame, model: Unigrams) -> DataFrame:
    """docs with lang_pred, the likeliest learned language, and score, its posterior (0 to 1).

    lang_pred is ``und`` and score 0 where the text is null or has no letter, or no language was learned; ties go to
    the first language in order. The posterior is of a text at the mean log-likelihood of its words taken 20 times at most,
    so that long texts don't all saturate.
    Whole texts count. Every row is kept, those that repeat another too. Columns of docs with these names are replaced; all others stay.
    """
    batch_rows(docs.sparkSession, 1000)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        m = shared.value
        seen: dict[str, int] = {}
        table = np.zeros((1 << 12, max(1, len(m.langs))))
        for batch in batches:
            preds, scores = [], []
            texts = batch["text"]
            for i in range(0, len(texts), 256):
                found = [words_of(t) for t in texts[i : i + 256].to_pylist()]
                if len(seen) > CACHE:
                    seen.clear()
                fresh = list({w for ws in found for w in ws if w not in seen})
                if fresh and m.langs:
                    base = len(seen)
                    while base + len(fresh) > len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    for k in range(0, len(fresh), 20_000):
                        table[base + k : base + k + len(fresh[k : k + 20_000])] = m.forward(fresh[k : k + 20_000])
                    seen.update(zip(fresh, range(base, base + len(fresh))))
                for ws in found:
                    if not ws or not m.langs:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    z = table[[seen[w] for w in ws]].mean(0)
                    j = int(z.argmax())
                    preds.append(m.langs[j])
                    scores.append(float(1 / np.exp((z - z[j]) * min(len(ws), 20)).sum()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    own = docs.select(*keep).withColumn("text", F.col("text").cast("string"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(trimmed(run), f"{kinds}, lang_pred string, score double")


def _vocab_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, _vocab_path())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (F.expr("crc32(cast(doc_id as string)) % 5") == 0).alias("held_out"), "lang_pred", "score")
