"""The llm operators against brute force, round trips and held-out accuracy, with odd rows."""

import bisect
import hashlib
import random
import struct
import sys
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from hopweave.llm import ann, chat, langid, minhash, packing, pieces, quality, substrings, vectors, warc

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, id string, h int"


def corpus(spark, seed=1, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choices(words, k=rnd.randrange(1, 120))) for _ in range(12)]
    rows = [(i, (" ".join(w if rnd.random() > 0.02 else "Zz" for w in rnd.choice(base).split())), "en", "s", "x", 1) for i in range(n)]
    rows += [(1000, None, None, None, None, None), (1001, "", "en", "s", "x", 1), (1002, "é" * 300, "fr", "s", "x", 1), (1003, "ab " * 400, "en", "s", "x", 1), (1004, "one", "en", "s", "x", 1), (None, "no id at all", "en", "s", "x", 1), (5, rows[5][1], "en", "s", "x", 1)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("size", [2, 5])
def test_minhash(spark, size):
    rows, docs = corpus(spark)
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets if i is not None}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in up:
        for b in up:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    got = minhash.minhash_components(docs, size, 80).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id)) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert minhash.minhash_components(docs.limit(0)).count() == 0


def test_minhash_tells_words_of_colliding_polynomials_apart(spark, monkeypatch):
    """Thue-Morse strings and their complements have one polynomial hash modulo 2**64 for any base."""
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)  # the texts meet the ids in a shuffle
    tm = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(1, tm), (2, tm.translate(str.maketrans("ab", "ba"))), (3, tm), (4, words), (5, words + " more"), (6, words * 2000 + " x"), (7, words * 2000 + " y")]
    got = {r.doc_id: r.component_id for r in minhash.minhash_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4}


def brute_substrings(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        s = (t or "").encode()
        c = bytearray(len(s))
        for p in range(len(s) - 99):
            w = s[p : p + 100]
            if w in seen:
                c[p : p + 100] = b"\1" * 100
            seen.add(w)
        out.append((i, bytes(b for b, f in zip(s, c) if not f), len(s), sum(c), sum(c[p] and not (p and c[p - 1]) for p in range(len(c)))))
    return out


def _same_as_brute(rows, docs):
    got = [(r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in substrings.dedup_substrings(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute_substrings(rows), key=key)


@pytest.mark.parametrize("unit", [16384, 3])
def test_substrings(spark, unit, monkeypatch):
    monkeypatch.setattr(substrings, "UNIT", unit)
    rows, docs = corpus(spark)
    _same_as_brute([(r[0], r[1]) for r in rows], docs)
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [16384, 500])
def test_substrings_with_a_line_in_very_many_surroundings(spark, unit, monkeypatch):
    monkeypatch.setattr(substrings, "UNIT", unit)
    monkeypatch.setattr(substrings, "JOINED", 10)
    rnd = random.Random(9)
    line = "All rights reserved; this line stands in very many documents, each time between other words, and is long enough to go."
    rows = [(i, f"{rnd.random()} {rnd.random()} {line}{rnd.random()} {rnd.random()}" if i % 7 else f"{i % 70} {line} {line[:90]} {i % 21}") for i in range(4000)]
    _same_as_brute(rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(8))


def test_substrings_whose_hashes_collide(spark, monkeypatch):
    rows, docs = corpus(spark, n=30)
    monkeypatch.setattr(substrings, "mix", lambda x: x)
    monkeypatch.setattr(substrings, "span_hash", lambda h, start, end: (h[end] - h[start]) & np.uint64(7))
    monkeypatch.setattr(substrings, "prefix_hash", lambda data: np.r_[np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64))])
    docs = [(i, r[1]) for i, r in enumerate(rows)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array([d[0] for d in docs]), "text": pa.array([d[1] for d in docs])})
    anchors = pa.Table.from_batches(list(substrings._emit_anchors([batch]))).sort_by([(c, "ascending") for c in ("h", "c1", "c2", "id", "at")])
    met = pa.Table.from_batches(list(substrings._meet(substrings._unpacked(anchors.to_batches()))))
    spans = [r for r in met.to_pylist() if r["kind"] == substrings.SPAN]
    entries = met.filter(pa.compute.not_equal(met["kind"], substrings.SPAN)).to_pylist()
    places = [[(e["kind"], e["x"], e["h"]) for e in entries if e["id"] == d[0]] for d in docs]
    kind = pa.list_(pa.struct([("kind", pa.int64()), ("x", pa.int64()), ("h", pa.int64())]))
    around = substrings._surroundings([pa.RecordBatch.from_arrays([batch["id"], batch["text"], pa.array([[dict(zip(("kind", "x", "h"), p)) for p in q] for q in places], kind)], ["id", "text", "places"])])
    rows = pa.Table.from_batches(list(around)).sort_by([("h", "ascending"), ("id", "ascending"), ("x", "ascending")])
    monkeypatch.setattr(substrings, "powers", lambda n: (np.ones(n, np.uint64),) * 2)  # the sort's own hashes collide too
    spans += substrings._compare(rows).to_pylist()
    for i, kept, *_ in brute_substrings(docs):
        s = (docs[i][1] or "").encode()
        cut = {p for x in spans if x["id"] == i for p in range(x["x"], x["y"])}
        assert bytes(b for p, b in enumerate(s) if p not in cut) == kept


def test_suffix_order():
    rng = np.random.default_rng(1)
    text, length, unit = rng.integers(0, 3, (500, 20)).astype(np.uint8), rng.integers(0, 21, 500), np.sort(rng.integers(0, 20, 500))
    text *= np.arange(20) < length[:, None]
    want = sorted(range(500), key=lambda i: (unit[i], text[i, : length[i]].tobytes(), i))
    assert (substrings.suffix_order(unit, text, length) == want).all()


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, VOCAB)
    got = langid.predict(docs, model).toPandas()
    held = got[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)]
    assert (held.lang == held.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    _, odd = corpus(spark)
    odd = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert odd[1000].lang_pred == odd[1001].lang_pred == "und" and odd[1002].lang_pred != "und"
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0), VOCAB)).count() == 0


def test_letters_by_category(spark):
    assert langid.words_of("½ ² ① Ⅷ 12 _-… 😀") == [] and langid.words_of("नमस्ते x½y") == ["नमस्ते", "x", "y"] and langid.words_of("Été²") == ["été"]
    docs = spark.createDataFrame([(i, t, l) for i in range(60) for t, l in [("the cat and the dog " * 3, "en"), ("नमस्ते दुनिया " * 3, "hi"), ("x" * 500, "long")]], "doc_id long, text string, lang string")
    model = langid.fit(docs, VOCAB)
    odd = spark.createDataFrame([(i, t, 1.0, "q") for i, t in enumerate(["½", "² ① Ⅷ", "नमस्ते", "the dog", "x" * 100, "", None, "the dog"])], "doc_id long, text string, score double, lang_pred string")
    got = langid.predict(odd, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "hi", "en", "long", "und", "und", "en"] and got[3].score == got[7].score
    many = docs.withColumn("lang", F.concat(F.lit("l"), F.pmod("doc_id", F.lit(60)))).union(spark.createDataFrame([(i, f"lang{i} " * 3, f"m{i}") for i in range(300)], "doc_id long, text string, lang string"))
    assert len(langid.fit(many, VOCAB).langs) > 250  # as many as there are


def plain_prediction(model, text):
    """The same model in plain Python: every segmentation's sum letter by letter."""
    ws = langid.words_of(text)
    if not ws or not model.langs:
        return "und"
    total = [0.0] * len(model.langs)
    for w in ws:
        for k in range(0, len(w), langid.MAX_WORD):
            part = w[k : k + langid.MAX_WORD]
            for j in range(len(total)):
                alpha = [1.0]
                for e in range(1, len(part) + 1):
                    alpha.append(sum(alpha[s] * (model.p[model.ids[part[s:e]], j] if part[s:e] in model.ids else model.p[-1, j] if e == s + 1 else 0.0) for s in range(max(0, e - langid.MAX_PIECE), e)))
                total[j] += np.log(alpha[-1])
    return model.langs[int(np.argmax(total))]


def test_language_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, VOCAB)
    short = docs.where("length(text) < 600 or text is null")
    assert {r.doc_id: r.lang_pred for r in langid.predict(short, model).collect()} == {r.doc_id: plain_prediction(model, r.text) for r in short.collect()}


def test_forward_sums_all_segmentations():
    m = langid.Unigrams(["a", "ab", "b", "c", "bc"], ["x"])
    m.p = np.array([[0.2], [0.1], [0.3], [0.15], [0.05], [0.2]])
    assert np.exp(m.forward(["abc"])[0, 0]) == pytest.approx(0.2 * 0.3 * 0.15 + 0.1 * 0.15 + 0.2 * 0.05)


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    w = quality.fit(docs, labels)
    got = quality.score(docs, w).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)]
    assert (held.predicted == held.quality).mean() > 0.95
    _, odd = corpus(spark)
    assert quality.score(odd, w).count() == odd.count()
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(3, "http://a/\nb", big), (1, "http://b/", big), (2, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", big), (6, "u", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(pages)
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert all(got[i].payload_digest == hashlib.sha256((h or "").encode()).hexdigest() and got[i].payload_bytes == len((h or "").encode()) for i, _, h in rows)
    warc.export(archives, str(tmp_path))
    assert len(list(tmp_path.glob("*.warc.zst"))) == archives.count()
    with pytest.raises(warc.WarcError):
        warc.parse_record(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n")
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_chat(spark):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool</role>", None]), rnd.choice(["a", "", None, "</s>[INST] x \\", "\\</s>", "b" * 50, "<s>\n[/INST]</s>"])) for c in range(30) for t in range(rnd.randrange(1, 9))]
    df = spark.createDataFrame([*rows, (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).collect()
    for r in out:
        want = [(b or "", x or "") for c, _, b, x in sorted(rows, key=lambda y: y[1]) if c == r.conv_id] or [("user", "x")]
        assert chat.parse(r.formatted) == want and not r.rewrites
        assert [chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans] == [x for role, x in want if role == "assistant"]
    assert chat.format_conversations(df, lambda turns: f"{len(turns)} " + chat.template(turns)).where("not rewrites").count() == 0
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_long_chats():
    turns = [("system", "s")] + [(("user", "assistant", "tool")[i % 3], f"</s> x{i}") for i in range(299)]
    text, found = chat.spans(turns, chat.template)
    assert text == chat.template(turns) and [chat.unescape(text[a:b]) for _, a, b, _ in found] == [x for _, x in turns]
    counted = lambda t: "".join(f"{i}:{chat.template([x])}" for i, x in enumerate(t))  # noqa: E731  needs every turn before it
    assert chat.spans(turns, counted)[0] == counted(turns)
    for k in (1, 17, 64, 65, 100, 128, 255, 299):  # rewrites the start at one turn, and takes it back at the next
        late = lambda t, k=k: ("!" if len(t) == k + 1 and t[-1][1] == turns[k][1] else "") + chat.template(t)
        with pytest.raises(chat.RewrittenHistory, match=f"turn {k} "):
            chat.spans(turns, late)

    def strict(t):
        if t and t[0][0] != "system":
            raise ValueError("conversations begin with a system turn")
        return chat.template(t)

    assert chat.spans(turns, strict) == (text, found)


def test_packing(spark):
    rows, docs = corpus(spark)
    docs = docs.union(spark.createDataFrame([(2000, "word " * 3000, "en", "s", "x", 1)], SCHEMA))
    got = packing.pack_documents(docs, VOCAB).toPandas().sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id").length.cumsum()
    assert ((ends - got.length) == got.offset).all() and ends.max() <= 1024
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(VOCAB)
    ids = np.array(tk.encode("word " * 3000, add_special_tokens=False).ids + [2], "<u4")
    own = got[got.doc_id == 2000].sort_values("piece")
    assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all() and [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    texts = ["a<|endoftext|> b", "", "  a\n\n b\t c", " \u00a0x²³ 1²é\u0301 ", "日本語 text 😀", "it's 3.5% of_it\r\n"]
    assert packing.encoder(VOCAB)(texts) == [np.array(tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    rnd = random.Random(3)
    pool = [*map(chr, range(0x250)), *map(chr, range(0x2010, 0x205F)), *(" \n\t'stdmlvre 0123" * 12), "語", "😀", "½"]
    texts = ["".join(rnd.choices(pool, k=rnd.randrange(60))) for _ in range(3000)] + ["a" + " " * 2_000_000 + "b" + "\n" * 1_000_000]
    assert packing.encoder(VOCAB)(texts) == [np.array(e.ids, "<u4").tobytes() for e in tk.encode_batch(texts, add_special_tokens=False)]
    assert packing.pack_documents(docs.limit(0), VOCAB).count() == 0
    odd = spark.createDataFrame([(None, "x y", 1), (None, "x y", 2), (7, "x y", 3), (7, "x y", 4), (8, None, 5), (9, "", 6)], "doc_id long, text string, sequence_id long")
    got = packing.pack_documents(odd, VOCAB).collect()
    assert len(got) == 6 and len({r.sequence_id for r in got}) == 1 and sorted(r.offset for r in got) == [0, 3, 6, 9, 12, 13]


def test_packing_against_plain_best_fit(spark):
    """As many sequences as best-fit decreasing over single pieces takes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack_documents(docs, VOCAB).toPandas()
    rooms, opened = [], 0
    for n in sorted(got.length, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else 1024
        opened += at == len(rooms) and room == 1024
        bisect.insort(rooms, room - n)
    assert got.sequence_id.nunique() == opened


def test_plan_fills_every_slot_once():
    rnd = random.Random(4)
    counts = {n: rnd.randrange(1, 40) for n in rnd.sample(range(1, 65), 40)}
    used, slots = {}, {n: set() for n in counts}
    for length, r0, r1, s0, per, base in packing.plan(counts, 64):
        for r in range(r0, r1):
            assert r not in slots[length]
            slots[length].add(r)
            used.setdefault(s0 + (r - r0) // per, []).append((base + (r - r0) % per * length, length))
    assert all(len(slots[n]) == c for n, c in counts.items())
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64


def test_pieces(spark):
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    texts = ["", "  a  b ", "a\n\n b\t c", "é日本😀 \x00 x", "▁ a▁b", "<s> </s> <unk> <0x41>", " lead", "trail ", "   ", "word " * 2000]
    assert pieces.parity(data, texts) == []
    docs = spark.createDataFrame([(i, t, [1], "d") for i, t in enumerate(texts)] + [(None, None, None, None), (0, "again", None, None)], "doc_id long, text string, ids array<int>, decoded string")
    got = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted(r.decoded.replace("▁", " ") for r in got) == sorted([*(t.replace("▁", " ") for t in texts), "", "again"])
    assert [r.ids for r in got if r.doc_id is None] == [[]]
    assert pieces.encode(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def _proto(number, value):
    """A protobuf field: bytes, a float or a varint."""
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


@pytest.mark.parametrize("fallback", [1, 0])
@pytest.mark.parametrize("squeeze", [1, 0])
@pytest.mark.parametrize("own", [[], ["<sep>", "[[x]]"]])
def test_unigram_pieces(fallback, squeeze, own):
    """A unigram model set down by a rule, not trained: the pieces of a public vocabulary with scores that fall with the rank."""
    public = [p for p, _, k in pieces.read_model(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())["pieces"] if k == pieces.NORMAL][:6000]
    rows = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL), *((p, 0.0, pieces.USER_DEFINED) for p in own)]
    rows += [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256 * fallback)]
    letters = [c for c in "▁abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,0123456789é" if c not in public]
    rows += [(p, -float(np.log(k + 2)) * 1.37, pieces.NORMAL) for k, p in enumerate([*public, *letters])]
    body = b"".join(_proto(1, _proto(1, p.encode()) + _proto(2, s) + _proto(3, k)) for p, s, k in rows)
    data = body + _proto(2, _proto(3, 1) + _proto(35, fallback)) + _proto(3, _proto(1, b"identity") + _proto(3, 1) + _proto(4, squeeze) + _proto(5, 1))
    docs = pd.read_parquet(f"{SF}/documents.parquet").text.fillna("").tolist()
    texts = ["", "  a  b ", "a\n\n b\t c", "é日本😀 \x00 x", "<s> </s> <unk> <0x41>", "a<sep>b <sep> c[[x]]", "aaaaaaaaaa bbbb", *docs]
    assert [texts[i][:80] for i in pieces.parity(data, texts)] == []


def test_a_difference_is_an_error(monkeypatch):
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    monkeypatch.setattr(pieces.Pieces, "encode", lambda self, texts: [[5] for _ in texts])
    with pytest.raises(pieces.ParityError):
        pieces._verify(data, ["some text"])


def test_what_cannot_be_verified_is_an_error(monkeypatch):
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    monkeypatch.setitem(sys.modules, "sentencepiece", None)
    with pytest.raises(ImportError, match="verified=0"):
        pieces._verify(data, ["some text"])


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [None] + [1.0] * 15), (None, [1.0] * 16)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(t, t.where("vec_id % 20 = 0")).toPandas()
    s = x.astype(float) @ x.astype(float).T
    hits = 0
    for q, g in got.groupby("query_id"):
        o = np.lexsort((np.arange(600), -s[q]))
        o = o[o != q][:20]
        hits += len(set(o) & set(g.vec_id))
        assert sorted(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, [s[q, v] for v in g.vec_id], atol=1e-12)
    assert set(got.query_id) == set(range(0, 600, 20)) and hits >= 0.95 * 20 * 30
    assert ann.nearest(t.limit(0), t.limit(0)).count() == 0
    assert ann.nearest(t.where("vec_id < 6"), t.where("vec_id = 0")).count() == 5


def test_graph_beside_a_row_of_large_norm(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[0] *= 1e6
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "v long, x array<float>")
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    best = np.argsort(-s, axis=1)[:, : ann.NEIGHBOURS]
    got = {r.v: r.nb for r in ann.build_graph(rows).collect()}
    assert sum(len(set(got[i]) & set(best[i])) for i in range(600)) >= 0.9 * best.size


def test_walk_goes_on_until_nothing_is_unopened(spark):
    n = 12  # a chain: every step meets one better vector
    table = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "v long, x array<float>").withColumn("x", F.when(F.col("v") == 0, F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>")).otherwise(F.col("x")))
    graph = spark.createDataFrame([(i, [i + 1]) for i in range(n - 1)], "v long, nb array<long>")
    got = ann.search(table, graph, table.where("v = 0").select("v"), 3).collect()
    assert [r.nb for r in got] == [[11, 10, 9]] and got[0].sc == [11.0, 10.0, 9.0]


def test_rounds_go_on_until_few_entries_are_new(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP", 16)  # a poor start
    monkeypatch.setattr(ann, "STARTS", 2)
    monkeypatch.setattr(ann, "SAMPLED", 5)
    x = np.random.default_rng(8).standard_normal((3000, 12))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    best = np.argsort(-s, axis=1)[:, : ann.NEIGHBOURS]
    got = {r.v: r.nb for r in ann.build_graph(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "v long, x array<float>")).collect()}
    assert sum(len(set(got[i]) & set(best[i])) for i in range(3000)) >= 0.7 * best.size


def test_cells_leave_few_neighbours_to_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHANGED", 1.0)  # no rounds
    x = np.random.default_rng(9).standard_normal((8000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    best = np.argsort(-s, axis=1)[:, : ann.NEIGHBOURS]
    got = {r.v: r.nb for r in ann.build_graph(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "v long, x array<float>")).collect()}
    assert sum(len(set(got[i]) & set(best[i])) for i in range(8000)) >= 0.8 * best.size


def test_embedding_links(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20, 32))
    x = np.concatenate([x, *[x + 0.14 * rng.standard_normal(x.shape) for _ in range(20)], x[:5]]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))] + [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [float("inf")] * 32, 1), (1003, x[0].tolist(), None), (1004, x[0].tolist()[:8], int(label[0])), (None, x[0].tolist(), int(label[0]))]
    got = vectors.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    assert len(got) == len(rows)
    for r in got:
        i = r.vec_id
        assert (r.n_links, r.component_id, r.kept) == ((int(link[i].sum()), comp[i], comp[i] == i) if i is not None and i < 1000 else (0, i, True)), i


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() <= docs.count(), name
        if name == "suffix_array_dedup":
            want = {i: kept.decode("utf8", "ignore") for i, kept, *_ in brute_substrings([(r.doc_id, r.text) for r in docs.collect()])}
            assert {r.doc_id: r.text for r in after.collect()} == want
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert C.run(spark, SF).agg(F.countDistinct("doc_id")).first()[0] == docs.count()


def test_twins(spark):
    import duckdb

    from hopweave.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    text = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).map(lambda v: str(int(v) if isinstance(v, float) else v)).values.tolist()))
    for name, sql in ORACLES.items():
        a, b = QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
        assert isinstance(a, pd.DataFrame) and text(a) == text(b), name
