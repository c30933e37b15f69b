import hashlib
import zlib

import numpy as np
from helpers import awkward, empty
from pyspark.sql import functions as F
from test_near_dups import brute

import corpus_pipeline as pipeline
from lodeseam.llm import decontaminate, language, queries
from tests.conftest import SF


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_language(spark, sf).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_training_sees_no_held_out_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = language.train(docs), language.train(other)
    assert a.langs == b.langs and all((a.w[k] == b.w[k]).all() for k in a.w)


def plain_logits(net, window):
    """Of one window, by the convolution itself."""
    pooled = []
    for k in language.WIDTHS:
        h = np.stack([net.w["embed"][window[p : p + k]].ravel() @ net.w[f"conv{k}"] for p in range(language.WINDOW - k + 1)])
        pooled.append(h.max(axis=0) + net.w[f"bias{k}"])
    return np.maximum(np.concatenate(pooled), 0) @ net.w["out"] + net.w["out_bias"]


def test_tables_are_the_convolution():
    net = language.ByteConvNet(["a", "b"])
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.integers(0, 256, 2 * language.WINDOW), np.zeros(4)]).astype(np.uint8)
    got = net.logits(data, net.tables())
    for w in range(2):
        assert np.allclose(got[w], plain_logits(net, data[w * language.WINDOW : (w + 1) * language.WINDOW]), atol=1e-3)


def test_a_row_alone_is_the_row_in_any_batch():
    net = language.ByteConvNet(["a", "b", "c"])
    rng = np.random.default_rng(3)
    texts = ["ab" * 128, "ab" * 127 + "a", "x", "é" * 300, "long text " * 40_000, *("".join(map(chr, rng.integers(32, 1000, int(n)))) for n in rng.integers(1, 2000, 60))]
    alone = [net.predict([t]) for t in texts]
    for order in (np.arange(len(texts)), rng.permutation(len(texts)), rng.permutation(len(texts))[:7]):
        langs, scores = net.predict([texts[k] for k in order])
        assert [(a[0][0], a[1][0]) for a in (alone[k] for k in order)] == list(zip(langs, scores, strict=True))
    assert net.predict(["½", "Ⅷ²", "12 .,", "", None, "_"])[0] == ["und"] * 6 and net.predict(["½ª"])[0] != ["und"]


def test_op4_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net, texts = language.train(docs), {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op4_language(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        data = language.as_bytes([text])[0]
        z = np.zeros(len(net.langs))
        for s in range(0, len(data), language.WINDOW):
            part = data[s : s + language.WINDOW]
            z += plain_logits(net, np.pad(part, (0, language.WINDOW - len(part)))) * (len(part) / len(data))
        p = np.exp(z - z.max())
        if any(map(str.isalpha, text)):
            assert got[i].lang_pred == net.langs[int(p.argmax())] and abs(got[i].score - p.max() / p.sum()) < 1e-3
        else:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)


def test_gradients():
    net = language.ByteConvNet(["a", "b", "c"])
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2])

    def loss():
        n = 0.0
        for row, label in zip(x, y, strict=True):
            pooled = [np.stack([net.w["embed"][row[p : p + k]].ravel() @ net.w[f"conv{k}"] for p in range(language.WINDOW - k + 1)]).max(axis=0) + net.w[f"bias{k}"] for k in language.WIDTHS]
            z = np.maximum(np.concatenate(pooled), 0) @ net.w["out"] + net.w["out_bias"]
            n += np.log(np.exp(z).sum()) - z[label]
        return n / 3

    grads = net._grads(x, y)
    for k in ("conv3", "embed", "out"):
        at = np.unravel_index(np.argmax(np.abs(grads[k])), grads[k].shape)
        old = net.w[k][at]
        net.w[k][at] = old + 1e-5
        up = loss()
        net.w[k][at] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - grads[k][at]) < 1e-3
        net.w[k][at] = old


def test_language_awkward(spark):
    net = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = language.identify(awkward(spark, more=("score", "pos", "lang_pred")), net).collect()
    assert len(rows) == 10 and {r.lang_pred for r in rows if r.doc_id in (1, 2, 5)} == {"und"} and all(r.lang_pred != "und" for r in rows if r.doc_id == 4)
    none = language.train(empty(spark))
    assert language.identify(empty(spark), none).count() == 0 and {r.lang_pred for r in language.identify(awkward(spark), none).collect()} == {"und"}
    kept = language.keep_identified(awkward(spark, more=("score",)), net, min_score=0.0)
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == 7


def plain_lines(rows):
    seen = {}
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 40:
                seen.setdefault(key(x), set()).add(i)
    return [(i, "\n".join(x for x in (text or "").split("\n") if len(seen.get(key(x), ())) < 5 or max(seen[key(x)]) == i)) for i, text in rows]


def test_pipeline_against_plain_stages(spark, tmp_path):
    got = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    rows = sorted((k, r.text) for k, r in named.items() if r.lang_pred != "und" and r.score >= 0.3)
    rows = plain_lines(rows)
    component = {i: c for i, _, c in brute([(i, t, "en") for i, t in rows], 5)}
    rows = [(i, t) for i, t in rows if component[i] == i]
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for _, w in items for k in range(max(1, len(w) - 9)) if w}
    encoder = pipeline.encoders.WordEncoder.opened(queries.tokenizer_path("word_bpe_49k.json"))
    want = {}
    for i, text in rows:
        words, hit = decontaminate.words_of(text), set()
        for m in {len(w) for w in windows}:
            for k in range(len(words) - m + 1):
                if tuple(words[k : k + m]) in windows:
                    hit.update(range(k, k + m))
        if len(hit) > 0.5 * len(words):
            continue
        if hit:
            places, parts, done, k = [m.span() for m in decontaminate.RAW_WORD.finditer(text)], [], 0, 0
            while k < len(words):
                if k in hit:
                    e = k
                    while e + 1 in hit:
                        e += 1
                    parts += [text[done : places[k][0]], " "]
                    done, k = places[e][1], e
                k += 1
            text = "".join([*parts, text[done:]])
        ids = encoder.library.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert {i: (r.n_tokens, r.ids_sha256) for i, r in got.items()} == want


def test_stages_take_awkward_documents(spark):
    docs = awkward(spark, more=("pos", "found", "kept", "component_id"))
    columns = docs.columns
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    e = empty(spark)
    for _, stage in pipeline.STAGES:
        assert stage(spark, e, SF).count() == 0
