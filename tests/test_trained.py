"""The trained encoder on planted paraphrases, against the hashed one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import trained as T
from sheaf.operators import vectors as V

#: Topics whose words come in two forms that never stand together in one text.
TOPICS, WORDS = 40, 6


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of one topic in either wording, between the topic's own context words."""
    rng, rows = random.Random(11), []
    for k in range(4000):
        topic, form = k % TOPICS, rng.choice("ab")
        words = [f"{form}{topic}x{rng.randrange(WORDS)}" if rng.random() < 0.5 else f"ctx{topic}n{rng.randrange(4)}" for _ in range(24)]
        rows.append((k, " ".join(w if rng.random() < 0.8 else f"common{rng.randrange(20)}" for w in words)))
    return spark.createDataFrame(rows, "id long, text string").repartition(8).cache()


def paraphrases(spark):
    """Queries in one wording and their topics' texts in the other, without a word in common."""
    q = [(t, " ".join(f"a{t}x{w}" for w in range(WORDS))) for t in range(TOPICS)]
    d = [(t, " ".join(f"b{t}x{w}" for w in range(WORDS))) for t in range(TOPICS)]
    return (spark.createDataFrame(rows, "id long, text string") for rows in (q, d))


def hits(q, d):
    found = V.top_k(q.select(F.col("id").alias("qid"), F.col("v").alias("qvec")), d.select(F.col("id").alias("cid"), F.col("v").alias("cvec")), 1)
    return found.where("qid = cid and score > 0.1").count() / TOPICS


def test_paraphrases_are_found_that_hashing_misses(spark, corpus, tmp_path):
    encoder = T.train(corpus, dimensions=384)
    q, d = paraphrases(spark)
    encoder.save(spark, str(tmp_path / "encoder"))
    again = T.Encoder.load(spark, str(tmp_path / "encoder"))
    own = [T.encode(x, again, "text", "v") for x in (q, d)]
    assert len(own[0].first().v) == 384
    hashed = [V.add_hashed_embedding(x, "text", "v", dim=384) for x in (q, d)]
    assert hits(*own) >= 0.9 and hits(*hashed) <= 0.3
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in own[0].collect())


def test_products_equal_the_dense_ones(spark, corpus):
    table = T.vocabulary_table(corpus, "text", 100).orderBy("place").toPandas()
    names = T.pa.array(table["token"], T.pa.string())
    counts = T.co_occurrences(corpus.limit(50), "text", names, 3).cache()
    known, want = {w: k for k, w in enumerate(table["token"])}, np.zeros((100, 100))
    for r in corpus.limit(50).collect():
        w = [known.get(x, -1) for x in r.text.split()]
        for a in range(len(w)):
            for b in range(a + 1, min(len(w), a + 4)):
                if w[a] >= 0 and w[b] >= 0:
                    want[w[a], w[b]] += 1
                    want[w[b], w[a]] += 1
    got = np.zeros((100, 100))
    for r in counts.collect():
        got[r.i, r.j] = r.n
    assert (got == want).all()
    thin = np.random.default_rng(1).standard_normal((100, 7))
    assert np.allclose(T._product(counts.select("i", "j", F.col("n").cast("double").alias("w")), thin), want @ thin)


def test_few_tokens_and_no_text(spark):
    few = T.train(spark.createDataFrame([("one two three two",), (None,), ("",)], "text string"), dimensions=8)
    assert few.vectors.shape == (3, 8)
    rows = T.encode(spark.createDataFrame([("one",), ("unknown",), (None,)], "text string"), few, "text", "v").collect()
    assert len(rows[0].v) == 8 and set(rows[1].v) == set(rows[2].v) == {0.0}
    none = T.train(spark.createDataFrame([(None,)], "text string"), dimensions=4)
    assert T.encode(spark.createDataFrame([("x",)], "text string"), none, "text", "v").first().v == [0.0] * 4


def test_pairs_are_counted_across_slices(spark, monkeypatch):
    """Co-occurrence counts against a count by hand, where texts are longer than a slice; null texts and foreign tokens add nothing."""
    import random
    from collections import Counter

    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdex") for _ in range(rng.randint(0, 40))) for _ in range(30)] + [None, ""]
    names, want = pa.array(list("abcde")), Counter()
    for t in texts:
        w = (t or "").split()
        for p, x in enumerate(w):
            for y in w[p + 1 : p + 4]:
                if "x" not in (x, y):
                    want["abcde".index(x), "abcde".index(y)] += 1
                    want["abcde".index(y), "abcde".index(x)] += 1
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(2)
    assert {(r.i, r.j): r.n for r in T.co_occurrences(df, "t", names, 3).collect()} == dict(want)
    monkeypatch.setattr(T, "PAIRS", 7)
    lists = pa.array([(t or "").split() for t in texts])
    got = Counter()
    for b in T._pairs(names, 3)(iter([pa.RecordBatch.from_arrays([lists], names=["tokens"])])):
        for r in b.to_pylist():
            got[r["i"], r["j"]] += r["n"]
            got[r["j"], r["i"]] += r["n"]
    assert got == want
