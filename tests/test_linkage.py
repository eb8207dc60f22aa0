"""Linking questions and scoring answers against brute force."""

import random
import re

from pyspark.sql import functions as F

from sheaf.operators import evaluate, linkage


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_edit_distance_and_subsequence_by_hand():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert linkage.word_edits(a, b) == edits(a, b)
        assert linkage.common_subsequence(a, b) == longest(a, b)


def test_links_equal_all_pairs(spark):
    rng = random.Random(2)
    vocabulary = ["what", "is", "the"] * 4 + [f"w{k}" for k in range(25)]
    known = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14)))) for k in range(120)] + [(500, "Same thing?"), (400, "same THING"), (None, "no id here"), (7000, None)]
    asked = []
    for k in range(200):
        w = words(rng.choice(known)[1])
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
        asked.append((k, "; ".join(w) + "?"))
    asked += [(900, "same  thing"), (901, ""), (902, None)] + [(1000 + k, "hot question the same") for k in range(300)]
    a, g = spark.createDataFrame(asked, "id long, question string"), spark.createDataFrame(known, "id long, question string")
    for share in (0.0, 0.2, 0.45):
        links = {bytes(r.key): (r.known_id, r.distance) for r in linkage.link_questions(a, g, share).collect()}
        keys = {r.id: r.key for r in a.select("id", linkage.question_key("question").alias("key")).collect()}
        for i, q in asked:
            x = words(q)
            best = min(((edits(x, words(t)), k) for k, t in known if k is not None and x and words(t) and edits(x, words(t)) <= int(share * max(len(x), len(words(t))) + 1e-9)), default=None)
            got = links.get(bytes(keys[i])) if keys[i] is not None else None
            assert got == (best and best[::-1]), (share, q)


def test_unmatched_and_repeated_rows_are_reported(spark):
    gold = spark.createDataFrame([("g1", "What is it?", "one two three"), ("g2", "what is IT", "other"), ("g3", "Never asked at all", None), ("g4", "?!", "x")], "id string, question string, answer string")
    asked = spark.createDataFrame([(1, "what is it", "one three"), (1, "What: is it", " one two three "), (2, "nothing like that", "y"), (3, None, None)], "id long, question string, answer string")
    rows = evaluate.evaluate_answers(asked, gold).collect()
    got = sorted((r.status, r.asked_id or 0, r.gold_id or "", r.lcs, r.exact_match, r.rouge_l) for r in rows)
    assert got == [
        ("matched", 1, "g1", 2, False, 0.8), ("matched", 1, "g1", 3, True, 1.0), ("repeated", 0, "g2", None, None, None), ("unanswered", 0, "g3", None, None, None),
        ("unanswered", 0, "g4", None, None, None), ("unknown", 2, "", None, None, None), ("unknown", 3, "", None, None, None)]
    none = evaluate.evaluate_answers(asked.limit(0), gold).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in none} == {"unanswered": 3, "repeated": 1}
    assert {r.status for r in evaluate.evaluate_answers(asked, gold.limit(0)).collect()} == {"unknown"}


def test_json_arrays_are_read_back(spark, tmp_path):
    from sheaf.sources import readers

    df = spark.createDataFrame([(k, f'q"{k}\n', None if k % 3 else "é") for k in range(50)], "id long, q string, a string").repartition(4)
    readers.write_json_arrays(df, str(tmp_path / "arrays"))
    back = readers.read_eval_set(spark, str(tmp_path / "arrays"), "id long, q string, a string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    readers.write_json_arrays(df.limit(0), str(tmp_path / "none"))
    assert readers.read_eval_set(spark, str(tmp_path / "none")).where(F.col("q").isNotNull()).count() == 0


def test_sketches_tell_far_questions_apart():
    """A pair within d edits differs in 2 * d bits at most; questions that share little but a rare word differ in more and are never fetched."""
    import types

    import pyarrow as pa

    rng = random.Random(4)
    close = []
    for _ in range(200):
        a = [rng.getrandbits(62) for _ in range(rng.randint(5, 40))]
        b = list(a)
        for _ in range(rng.randint(0, int(0.2 * len(a)))):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice([*a, rng.getrandbits(62)])] * rng.randint(0, 1)
        close.append((a, b))
    rare = rng.getrandbits(62)
    far = [[rare, *(rng.getrandbits(62) for _ in range(29))] for _ in range(40)]
    lists = [x for pair in close for x in pair] + far
    batch = pa.RecordBatch.from_pydict({"key": [b"%d" % k for k in range(len(lists))], "asked": [True] * len(lists), "known": [False] * len(lists), "hashes": lists})
    got = linkage._prefixes(0.2, types.SimpleNamespace(value=[0] * linkage.COUNTERS))(iter([batch]))
    sketch = {r["key"]: (r["low"] % (1 << 64), r["high"] % (1 << 64)) for b in got for r in b.to_pylist()}
    turned = lambda i, j: sum((x ^ y).bit_count() for x, y in zip(sketch[b"%d" % i], sketch[b"%d" % j]))
    assert all(turned(2 * k, 2 * k + 1) <= 2 * edits(a, b) for k, (a, b) in enumerate(close))
    first = 2 * len(close)
    assert all(turned(first, first + k) > 2 * 6 for k in range(1, len(far)))
