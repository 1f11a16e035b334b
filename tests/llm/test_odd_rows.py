"""Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables through every operator and every stage."""

import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from hopweave.llm import ann, chat, langid, minhash, packing, pieces, quality, substrings, vectors, warc

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = ["n_shingles", "component_id", "kept", "id", "h", "extra", "spans", "lang_pred", "score", "predicted", "ids", "decoded", "piece", "sequence_id", "offset", "length", "rep", "set_key"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    words = [w + e for w in ("river", "stone", "green", "house", "under", "light") for e in ("", "s", "ing", "ed", "er")]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    rows = [(i, say(40)) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "  \n "), (103, "½"), (104, rows[0][1]), (3, rows[3][1]), (None, rows[4][1]), (None, None), (105, say(850_000)), (106, "�" + say(60) + "�"), (107, "é" * 130), (108, "é" * 130)]
    assert max(len(t or "") for _, t in rows) > 5_000_000
    data = [(i, t, "en" if i is None or i % 3 else None, "s", len(t or ""), *["x"] * len(CLASHING)) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3).cache()


def keyed(rows):
    return sorted(((r.doc_id is not None, r.doc_id or 0) for r in rows))


def test_text_operators_return_every_row(docs):
    labels = docs.sparkSession.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (4, 1), (4, 0), (999, 1)], "doc_id long, quality int")
    want, none = keyed(docs.select("doc_id").collect()), docs.limit(0)
    model = langid.fit(docs, VOCAB)
    weights = quality.fit(docs, labels)
    model_path = public_tokenizers.path("piece_bpe_32k.model")
    for run in (
        minhash.minhash_components,
        substrings.dedup_substrings,
        lambda d: langid.predict(d, model),
        lambda d: quality.score(d, weights),
        lambda d: packing.pack_documents(d, VOCAB).where("piece = 0"),
        lambda d: pieces.encode(d, model_path),
    ):
        out = run(docs)
        assert keyed(out.select("doc_id").collect()) == want
        assert run(none).count() == 0
    got = {r.doc_id: r for r in minhash.minhash_components(docs).collect()}
    assert got[104].component_id == 0 and not got[104].kept and got[3].kept and got[100].n_shingles == 0 and got[102].component_id == 102
    cut = {r.doc_id: r for r in substrings.dedup_substrings(docs).collect()}
    assert cut[104].n_removed == cut[104].n_bytes and cut[108].n_removed == 260 and cut[107].n_removed == 258 and cut[100].n_bytes == 0
    pred = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [pred[i].lang_pred for i in (100, 101, 102, 103)] == ["und"] * 4 and pred[105].lang_pred == "en"
    assert pred[104].score == pred[0].score
    scores = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    assert all(0 <= x <= 1 for x in scores.values()) and scores[100] == scores[101]


def test_stages_keep_the_columns(docs, spark, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(30)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        assert out.columns == docs.columns and all(getattr(r, c) == "x" for r in rows for c in CLASHING), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        ids = [r.doc_id for r in rows]
        if name == "language_id":
            assert not {100, 101, 102, 103} & set(ids) and ids.count(None) == 1 and ids.count(3) == 2
        if name == "minhash_near_dedup":
            assert 104 not in ids and ids.count(3) == 2 and ids.count(None) == 2 and {100, 101, 102} <= set(ids)
        if name == "suffix_array_dedup":
            text = {r.doc_id: r.text for r in rows}
            assert len(rows) == docs.count() and text[100] == "" and text[104] == "" and text[106].count("�") == 2 and all(r.n_chars == len(r.text) for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("piece = 0").count() == docs.count()


def test_pages(spark):
    rows = [(1, "u", "x" * 200, "a"), (1, "u", "x" * 200, "b"), (2, None, "x" * 200, None), (None, None, None, None), (3, "v", "", "c"), (4, "w", "y" * 5_000_000, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.read_archives(warc.write_archives(pages)).collect())
    assert got == [(0, "response", 0, 0), (1, "response", 0, 200), (1, "response", 0, 200), (2, "revisit", 1, 200), (3, "response", 0, 0), (4, "response", 0, 5_000_000)]


def test_frames_without_a_size(spark):
    import zstandard

    whole = warc.record(7, "u", b"payload" * 50, "0" * 64, None)
    stream = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    list(warc.read_archive(stream.compress(whole) + stream.flush()))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(b"\x28\xb5\x2f\xfd" + b"\x00" * 3))


def test_conversations(spark):
    rows = [(1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, None, None, None, "x"), (2, 0, "assistant", "b" * 5_000_000, "x"), (None, 0, "user", "", "x"), (3, 1, "assistant", "tie 1", "x"), (3, 1, "assistant", "tie 0", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans string")
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_conversations(df).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a")], 2: [("assistant", "b" * 5_000_000)], None: [("user", "")], 3: [("assistant", "tie 0"), ("assistant", "tie 1")]}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8)) * 10.0 ** rng.integers(-3, 4, (60, 1))
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    x[40:45] = x[20]
    rows = [(i, v.tolist(), i % 2 if i < 50 else None, 1.0, i) for i, v in enumerate(x)] + [(5, x[5].tolist(), 1, 1.0, 5), (None, x[0].tolist(), 0, 1.0, None), (80, None, 0, 1.0, 1), (100, [0.0] * 8, 0, 1.0, 1), (120, [float("inf")] * 8, 0, 1.0, 1), (140, [], 0, 1.0, 1)]
    t = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, score double, component_id long")
    s = x @ x.T
    got = ann.nearest(t, t.where("vec_id % 20 = 0")).collect()
    for q in (0, 20, 40):
        order = [v for v in np.lexsort((np.arange(60), -s[q])) if v != q][:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [v for _, v, _ in mine] == order and np.allclose([z for *_, z in mine], s[q][order], rtol=1e-13)
    assert {r.query_id for r in got} == {0, 20, 40}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([i % 2 if i < 50 else -i for i in range(60)])
    link = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    out = vectors.embedding_links(t).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.vec_id is not None and r.vec_id < 60 and r.vec_id != 5:
            assert r.n_links == link[r.vec_id].sum() - 1
        elif r.vec_id in (80, 100, 120, 140, None):
            assert r.n_links == 0 and r.kept
    assert [r.n_links for r in out if r.vec_id == 5] == [link[5].sum()] * 2  # a repeated row links with its twin
    assert vectors.embedding_links(t.limit(0)).count() == 0
