import random
import zlib

import numpy as np
import pyarrow as pa
from common import ODD, empty, frame
from pyspark.sql import functions as F

from stayframe.llm import quality, toxicity
from stayframe.llm.labelled import held_out, sample_texts


def test_held_out_rows(spark):
    ids = spark.range(50).select(F.col("id").alias("doc_id")).union(spark.sql("select cast(null as bigint)"))
    found = ids.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("out")).collect()
    assert all(r["out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)


def test_samples_are_bounded_and_the_same(spark):
    docs = frame(spark)
    first = sample_texts(docs, docs, 3, 1000)
    assert first == sample_texts(docs.repartition(3), docs, 3, 1000) and len(first) == 3
    assert max(map(len, sample_texts(docs, docs, 100, 100))) <= 100


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randint(3, 120))) for _ in range(n)]
    marked = []
    for _ in range(n // 2):
        own = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(len(own))] = rng.choice(["grumpus", "zlofix", "zlofar" + word()[:2]])
        marked.append(" ".join(own))
    return marked, clean


def auc(low, high):
    return np.mean([(h > x) + 0.5 * (h == x) for h in high for x in low])


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw = [b"some words", b"and more " * 20, b""]
    words = toxicity.read_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    owner, begin, length = toxicity.windows(words.first)
    places, mask = toxicity._places(words.order, begin, length)
    target, each = (np.arange(len(owner)) % 2).astype(float), np.ones(len(owner))
    _, grads = net.gradient(words, places, mask.astype(np.float64), target, each)
    for name, value in net.p.items():
        flat, grad = value.reshape(-1), grads[name].reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(grad) > 1e-6), 3):
            old, step = flat[i], 1e-4
            flat[i] = old + step
            up = net.gradient(words, places, mask.astype(np.float64), target, each)[0]
            flat[i] = old - step
            down = net.gradient(words, places, mask.astype(np.float64), target, each)[0]
            flat[i] = old
            assert abs((up - down) / (2 * step) - grad[i]) < 1e-3 * max(1, abs(grad[i]))


def test_windows_cover_every_word_and_overlap():
    first = np.cumsum([0, 0, 1, 32, 33, 100])
    owner, begin, length = toxicity.windows(first)
    for t in range(5):
        spans = [(b, b + n) for o, b, n in zip(owner, begin, length) if o == t]
        assert spans[0][0] == first[t] and spans[-1][1] == first[t + 1]
        assert all(b < a_end for (_, a_end), (b, _) in zip(spans, spans[1:]))


def test_toxicity_learns_words_and_beginnings():
    marked, clean = texts(1, 400)
    net = toxicity.fit(marked, clean)
    marked, clean = texts(2, 200)
    high, low = toxicity.score_batch(net, pa.array(marked)), toxicity.score_batch(net, pa.array(clean))
    assert auc(low, high) > 0.95
    # Every window counts, however far on, and a score doesn't depend on the rows beside it.
    long = " ".join([clean[0]] * 300) + " grumpus " + " ".join([clean[1]] * 300)
    both = toxicity.score_batch(net, pa.array([None, clean[0], long, ""]))
    assert both[2] > 0.3 and abs(both[1] - low[0]) < 1e-4 and both[0] == both[3]
    for only in (toxicity.fit([], clean), toxicity.fit(marked, [])):
        assert len(set(toxicity.score_batch(only, pa.array(["", "a"])).round(3))) == 1


def unspaced(seed, n):
    rng = random.Random(seed)
    signs = [chr(0x4E00 + k) for k in range(300)]
    clean = ["".join(rng.choice(signs) for _ in range(rng.randint(20, 400))) for _ in range(n)]
    marked = []
    for t in clean[: n // 2]:
        at = rng.randrange(len(t))
        marked.append(t[:at] + "\u9f8d\u9f9c\u9f8e\u9f9f" + t[at:])
    return marked, clean


def test_toxicity_reads_unspaced_runs_to_their_ends():
    net = toxicity.fit(*unspaced(1, 400))
    marked, clean = unspaced(2, 200)
    assert auc(toxicity.score_batch(net, pa.array(clean)), toxicity.score_batch(net, pa.array(marked))) > 0.95
    run = "".join(clean)
    late = toxicity.score_batch(net, pa.array([run, run + "\u9f8d\u9f9c\u9f8e\u9f9f" + clean[0]]))
    assert late[1] > late[0] + 0.1


def test_pieces_of_long_runs_hold_every_character():
    runs = ["".join(chr(k) for k in range(a, a + 80)) for a in (0x100, 0x4E00, 0x1F600)] + ["".join(f"{k}x" for k in range(30))]
    mixed = "a" + "".join(map("".join, zip(*runs[:3])))
    texts = ["", runs[1], mixed + ", short " + runs[2], "a" * 40, "one two", runs[3], runs[0]]
    raw = [t.encode() for t in ["before", *texts]]
    data, offsets = np.frombuffer(b"".join(raw) + b"after", np.uint8), np.cumsum([0, *map(len, raw)])[1:]
    cut, bounds = toxicity._cut_long_runs(data, offsets)
    for t, a, b in zip(texts, bounds, bounds[1:]):
        words, found = t.split(" "), cut[a:b].tobytes().decode().split(" ")
        for w in words:
            own = [found.pop(0)]
            while own[-1][-1:] != w[-1:]:
                own.append(found.pop(0))
            assert "".join(own) == w if len(w.encode()) <= 40 else all(len(x.encode()) <= 28 and x in w for x in own)
            assert all(any(w[i : i + 2] in x for x in own) for i in range(len(w) - 1))
        assert not found
    words = toxicity.read_words(data, offsets)
    assert words.first[0] == 0 and words.first[1] == 0 and words.first[4] - words.first[3] == 1 and words.first[5] - words.first[4] == 2


def test_stretches_of_a_long_text_have_all_of_its_windows(monkeypatch):
    net = toxicity.fit(*texts(1, 60), epochs=2)
    for long in (" ".join(texts(3, 80)[1]), unspaced(3, 80)[1][0] * 40):
        whole = toxicity.score_batch(net, pa.array([long]))
        monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 64)
        assert abs(whole - toxicity.score_batch(net, pa.array([long]))).max() < 1e-5
        monkeypatch.undo()


def test_quality_estimates_the_prior_and_separates():
    rng = random.Random(4)
    good = texts(3, 1200)[1]
    bad = [" ".join(w + rng.choice(["%%", "##", "$$"]) for w in t.split()) for t in texts(5, 700)[1][:500]]
    model = quality.fit(good[:600], good[600:1100] + bad[:250])
    assert abs(model.prior - 2 / 3) < 0.15
    high, low = (model.score(quality.text_features(pa.array(x))) for x in (good[1100:], bad[250:]))
    assert auc(low, high) > 0.98 and (high >= 0.5).mean() > 0.9 and (low < 0.5).mean() > 0.9
    assert quality.fit(good[:5], []).score(quality.text_features(pa.array(["x"])))[0] > 0.99
    assert quality.fit([], good[:5]).score(quality.text_features(pa.array(["x"])))[0] < 0.01


def test_scores_of_odd_rows(spark):
    marked, clean = texts(6, 60)
    net, model = toxicity.fit(marked, clean, epochs=2), quality.fit(clean, marked, epochs=2)
    for found, name in ((toxicity.score(frame(spark), net), "toxicity"), (quality.score(frame(spark), model), "quality_score")):
        assert sorted(found.columns) == sorted({*frame(spark).columns, name})
        rows = found.collect()
        assert len(rows) == len(ODD) and all(0 <= r[name] <= 1 for r in rows)
        assert sorted(str(r["text"])[:99] for r in rows) == sorted(str(r[1])[:99] for r in ODD)
        by_id = {r["doc_id"]: r[name] for r in rows}
        assert abs(by_id[4] - by_id[5]) < 1e-5 and abs(by_id[1] - by_id[2]) < 1e-5
    assert toxicity.score(empty(spark), net).collect() == [] and quality.score(empty(spark), model).collect() == []


def test_fit_leaves_unusable_labels_out(spark):
    marked, clean = texts(7, 60)
    rows = [(i, t, None, None, None) for i, t in enumerate(marked + clean)]
    labels = spark.createDataFrame([(i, int(i >= len(marked)), int(i < len(marked))) for i in range(len(rows))], "doc_id bigint, quality int, toxic int")
    twisted = labels.select("doc_id", *[F.when(held_out(F.col("doc_id"), 4, 2), 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    for module, column in ((toxicity, "toxicity"), (quality, "quality_score")):
        scores = []
        for marks in (labels, twisted):
            fitted = module.fit_labelled(frame(spark, rows), marks, ~held_out(F.col("doc_id"), 4, 2))
            scores.append([r[column] for r in module.score(frame(spark, rows), fitted).orderBy("doc_id").collect()])
        assert scores[0] == scores[1]
