"""Toxicity on held-out rows, and the pipeline against its steps in plain Python."""
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from lexloom.llm import decontaminate, packing, secret_scan, toxicity
from lexloom.llm.common import stage
from test_near_duplicates import brute_components


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    e, start, move = rng.normal(size=(1, 5)), rng.normal(size=2), rng.normal(size=(2, 2))
    for n in (1, 3, 5):
        weight = {}
        for code in range(2 ** n):
            y = [code >> t & 1 for t in range(n)]
            weight[code] = np.exp(start[y[0]] + sum((y[t] - 0.5) * e[0, t] for t in range(n))
                                  + sum(move[y[t - 1], y[t]] for t in range(1, n)))
        want = [sum(w for c, w in weight.items() if c >> t & 1) / sum(weight.values()) for t in range(n)]
        got = toxicity.marginals(np.where(np.arange(5) < n, e, 0), np.array([n]), start, move)[0]
        assert np.allclose(got[0, :n], want)


def labelled(spark, n=1600):
    rng = random.Random(9)
    syllables = ["ba", "do", "ke", "li", "mu", "na", "po", "ri", "sa", "te", "vu", "zo"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 80))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grump", "snark" + word(), "Grump!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs += [(n, None), (n + 1, ""), (None, "grump"), (n + 2, "ba do " * 20_000 + "grump"), (0, docs[0][1])]
    labels += [(None, 1), (5, None), (7, 9), (10**9, 1), (3, labels[3][1])]
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x"))
            .withColumn("toxic", F.lit(1)), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels[:n]))


def test_toxicity_of_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    for r in got:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 300
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.98
    assert by_id[1600].predicted == by_id[1601].predicted == 0
    assert by_id[1602].predicted == 1 and by_id[None].predicted == 1
    assert by_id[None].spans == "0:5" and by_id[1602].spans == "120000:120005"
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in got if not r.predicted)


def test_toxicity_without_labels(spark):
    docs, labels, _ = labelled(spark, 40)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    one = labels.where("toxic = 0")
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(docs, one).collect())
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_pipeline_steps(spark):
    """Every stage's rows from its own input, and run() against the stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(step(spark, docs, SF), name)
        assert docs.columns == before.columns
        kept[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in docs.collect()})
    names = list(kept)
    scores = toxicity.score_toxicity(spark.read.parquet(f"{SF}/documents.parquet"),
                                     spark.read.parquet(f"{SF}/labels.parquet")).collect()
    before, after = kept[names[0]]
    assert after == {i: before[i] for i in before if i in {r.doc_id for r in scores if not r.predicted}}
    before, after = kept[names[1]]
    assert after == {i: before[i] for i, _, c in brute_components(list(before.items())) if i == c}
    index = decontaminate.Index([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select(
        "item_id", "text").collect()])
    before, after = kept[names[2]]
    assert after == {i: t for i, t in before.items() if not index.matches(t)}
    before, after = kept[names[3]]
    assert set(before) == set(after)
    for i, t in before.items():
        spans = secret_scan.base_spans(t)
        assert (after[i] == t) if not spans else ("<secret>" in after[i] and len(after[i]) != len(t))
    words = packing.WordIds()
    want = sorted((i, len(words.encode(t)) // 4 + 1) for i, t in after.items())
    sizes = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sorted(sizes.items()) == want


def test_fit_holds_each_word_once(monkeypatch):
    import tracemalloc

    from lexloom.llm import toxicity
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "FIELD_SEGMENTS", 50)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    texts = [" ".join(words[(i + j) % 50] if i % 2 else words[10 + (i + j) % 50] for j in range(2000)) for i in range(400)]
    tracemalloc.start()
    toxicity.fit(texts, [i % 2 for i in range(400)], (200, 200))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6, peak                    # about 48 MB; 97 MB with 800,000 words as objects of their own
