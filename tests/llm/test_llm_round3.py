"""Conversation repair, filter audits and SentencePiece chunks against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheaf.llm import audit, packing, pieces, repair

SPACE = " \t\n\v\f\r"
PIECES = packing.tokenizer_file("piece_bpe_32k.model")


# conversation repair


def conversation_by_hand(rows):
    """Damage, faults and the cheapest repair of one conversation's (conv, turn, role, text), by full enumeration of states."""
    got = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        got += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in got:
        last = text.strip(SPACE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in got if t is not None]
    report = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
    report["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    report["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}  # the last initial -> cost, audit, lines; equal costs never have one audit before the other as a prefix

    def put(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(table):
        for _ in range(4):
            for state, (c, a, lines) in list(table.items()):
                for x, name in (("u", "user:"), ("a", "assistant:")):
                    if (state, x) in step:
                        put(table, x, (c + 3, a + "I", (*lines, name)))
        return table

    best = inserted(best)
    for (_, role, text), fault in zip(got, faults):
        new = {}
        for state, (c, a, lines) in best.items():
            put(new, state, (c + 4, a + "D", lines))
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                if (state, role[:1]) in step:
                    put(new, step[state, role[:1]], (c + more, a + "K", (*lines, f"{role}:{text}")))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (state, x) in step:
                        put(new, x, (c + 3 + more, a + "R", (*lines, f"{name}:{text}")))
        best = inserted(new)
    cost, letters, lines = min(best[s] for s in ("", "a") if s in best)
    return report | {"cost": cost, "audit": letters, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def check_repair(spark, rows, max_rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("other"))
    damaged = repair.damaged(table)
    reports, turns = repair.repair(damaged, max_rows)
    got = {r.conv_id: r.asDict() for r in reports.collect()}
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digests(turns).collect()}
    left = {r.conv_id for r in damaged.collect()}
    assert set(got) == set(hashes) == left
    for conv in left:
        want = conversation_by_hand([r for r in rows if r[0] == conv])
        assert got[conv] | {"repaired_sha256": hashes[conv]} == want | {"conv_id": conv}, conv


@pytest.mark.parametrize("max_rows", [1, 3, 256])
def test_repairs_equal_those_by_hand(spark, max_rows):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "uncle"]
    texts = ["Yes.", "No!", "So so", "", " \t", None, "Why?\n", "."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(40)] for _ in range(rng.randint(1, 9))]
    rows += [(77, t, ("user", "assistant")[t % 2], rng.choice(["A.", "B", f"{t}."])) for t in range(150)]
    check_repair(spark, rows + rows[:20] + rows[-60:], max_rows)


def test_a_conversation_of_equal_rows_is_cut_to_blocks(spark):
    check_repair(spark, [(3, 1, "user", "Same.")] * 700 + [(4, t, "user", "Same.") for t in range(300)], 64)


def test_all_rows_dropped_and_empty_table(spark):
    dropped = next(t for t in range(100) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    table = spark.createDataFrame([(9, dropped, "user", "Hm."), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.asDict() for r in repair.repaired(table, repair.damaged(table)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got[9] == {"conv_id": 9, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": none}
    assert got[None]["audit"] == "D" and got[None]["blank"] == 1
    assert repair.repaired(table.limit(0), repair.damaged(table.limit(0))).collect() == []


def test_agenda_gives_the_lightest_derivation_between_states():
    rng = random.Random(2)
    for _ in range(200):
        rows = [(rng.choice("suat "), rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randint(1, 4))]
        parts = rng.randint(0, len(rows))
        whole = repair.lightest(rows, repair.ACCEPTED, [0])[0]
        blocks = [b for b in (rows[:parts], rows[parts:]) if b]
        spans = [{"spans": [{"enter": q, "leave": r, "cost": c, "audit": a} for r in range(4) for q, (c, a) in repair.lightest(b, [r], range(4)).items()]} for b in blocks]
        steps = repair.compose(spans)
        assert (steps[0][0], "".join(p for _, _, p in steps)) == whole
        assert whole[0] <= 4 * len(rows)


# filter audits


def test_audit_equals_every_order_run_by_hand(spark):
    rng = random.Random(3)
    words = ["a", "bee", "See", "DEE#", "e", "f%", "GG", "h"]
    texts = [" ".join(rng.choice(words[: rng.randint(1, 8)]) for _ in range(rng.choice([0, 3, 60, 80]))) for _ in range(60)] + [None, "", " ".join(map(str, range(70)))]
    docs = [(rng.choice([None, *range(150)]), rng.choice(texts), rng.choice(["x", "y", None, ""])) for _ in range(300)]
    docs += docs[:20] + [(1000 + k, "hot text", "x") for k in range(100)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(100), *range(50), 1003, None]]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit("clash")).withColumn("n", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = audit.failures(table, audit.text_failures(F.coalesce(table["text"], F.lit(""))), repeats="E")
    counts = audit.histogram(rows, marks, {"good": marks["quality"] == 1, "toxic": marks["toxic"] == 1})
    got = {(r.part, r.filter_order, r.step): r for r in audit.audit_orders(counts, "ABCDE", ("good", "toxic")).collect()}

    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    flag = {k: {i for i, *q in labels if i is not None and q[c] == 1} for c, k in enumerate(("good", "toxic"))}
    cases = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        cases.append((s or "", "".join(k for k in fails if fails[k]), i in flag["good"], i in flag["toxic"]))
    parts, want, shapley = {c[0] for c in cases}, {}, {}
    for part in parts:
        for order in map("".join, itertools.permutations("ABCDE")):
            there = [c for c in cases if c[0] == part]
            for step, x in enumerate(order, 1):
                out = [c for c in there if x in c[1]]
                there = [c for c in there if x not in c[1]]
                fails = [c for c in cases if c[0] == part and x in c[1]]
                shapley[part, x] = shapley.get((part, x), 0) + len(out)
                want[part, order, step] = (len(there), len(out), len(fails) - len(out), sum(c[1] == x for c in fails), sum(c[2] for c in out), sum(c[3] for c in out))
    assert set(got) == set(want)
    for key, values in want.items():
        r = got[key]
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == (*values, shapley[key[0], key[1][key[2] - 1]]), key


def test_audit_of_an_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit.failures(table, audit.text_failures(table["text"]), repeats="E")
    counts = audit.histogram(rows, marks, {"good": marks["quality"] == 1})
    assert audit.audit_orders(counts, "ABCDE", ("good",)).count() == 0


def test_paths_through_the_lattice():
    paths = audit.path_counts(5)
    assert len(paths) == 80 and paths[0, 0] == 24 and paths[0b11, 2] == 2 * 2
    assert all(sum(v for (s, _), v in paths.items() if bin(s).count("1") == step) == 120 for step in range(5))


# SentencePiece


def test_chunks_give_the_ids_of_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(4)
    signs = [" ", "  ", "▁", "\n", "\t", "\r", "a", "the", "Ver", "é", "é", "🦄", "12", ".", "​", "﻿", "\x00", "<s>", "</s>", "<0x0A>", "　", "中文"]
    texts = [None, "", " ", "▁", "\n", " \n ", "x" * 3000, " " * 40 + "y", "word " * 20000, *("".join(rng.choice(signs) for _ in range(rng.randint(1, 25))) for _ in range(1500))]
    docs = spark.createDataFrame(list(enumerate([*texts, "tie", "tie"])) + [(None, "tie"), (3, "again")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = pieces.encoded(docs, PIECES).collect()
    assert len(got) == len(texts) + 4
    rows = sorted((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in got if r.doc_id is not None and r.doc_id != 3)
    for k, n, ids, decoded in rows:
        want = model.encode([*texts, "tie", "tie"][k] or "")
        assert (n, ids, decoded) == (len(want), want, model.decode(want))
    assert pieces.chunk_table(PIECES).by_chunk
    assert pieces.encoded(docs.limit(0), PIECES).collect() == []


def test_a_full_table_starts_anew(monkeypatch):
    import numpy as np

    monkeypatch.setattr(pieces, "TABLE", 5)
    table = pieces.ChunkTable(PIECES)
    for text in ("a b c d", "e f g a", "a b c d e f g h i j"):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, decoded = table.columns(*pieces.chunked(np.array([0, len(data)]), data))
        assert ids.to_pylist() == [table.model.encode(text)] and decoded.to_pylist() == [text]


def test_pieces_that_cross_markers_are_not_cut():
    class Crossing:
        is_byte = is_control = is_unknown = lambda self, k: False

    assert not pieces.keeps_to_chunks(Crossing(), ["▁", "a▁b"])
    assert not pieces.keeps_to_chunks(Crossing(), ["▁", "a\nb"])


# language models


def test_kneser_ney_counted_by_hand():
    """Cross-entropies of models of a few sentences against probabilities from plain dictionaries."""
    from collections import Counter, defaultdict
    from math import log

    from sheaf.llm import language

    texts = {"x": ["The cat sat on the mat.", "A cat; a hat! That", "é"], "y": ["der hund und der mond", "Das und dies, und der Rest", "so so"]}
    order, langs = 3, ["x", "y"]
    lead = " " * (order - 1)

    def letters(text):
        return lead + re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text)).lstrip(" ")

    levels = {}
    for lang in langs:
        top = Counter()
        for t in map(letters, texts[lang]):
            top.update(t[i - order + 1 : i + 1] for i in range(order - 1, len(t)))
        by = [top]
        while len(by) < order:
            by.insert(0, Counter(g[1:] for g in by[0]))  # distinct left neighbours
        levels[lang] = by
    alphabet = len({g for lang in langs for g in levels[lang][0]}) + 1

    def probability(lang, gram):
        if not gram:
            return 1 / alphabet
        counts = levels[lang][len(gram) - 1]
        ones, twos = (sum(v == k for v in counts.values()) for k in (1, 2))
        discount = min(max(ones / max(1, ones + 2 * twos), 0.1), 0.95)
        after = [v for g, v in counts.items() if g[:-1] == gram[:-1]]
        lower = probability(lang, gram[1:])
        if not after:
            return lower
        return max(counts.get(gram, 0) - discount, 0) / sum(after) + discount * len(after) / sum(after) * lower

    rows = defaultdict(list)
    for k, lang in enumerate(langs):
        grams, number = language.counted_grams(texts[lang], order)
        rows["owner"].append(np.full(len(number), k))
        rows["grams"].append(grams)
        rows["n"].append(number)
    models = language.estimate(langs, *(np.concatenate(rows[c]) for c in ("owner", "grams", "n")))
    asked = ["The hat sat", "und der hund", "zebra q", "mat", "x" * 30, "a, b... c"]
    got, n = models.cross_entropies(asked)
    for text, entropies, size in zip(asked, got, n):
        t = letters(text)
        places = range(order - 1, len(t))
        assert size == len(places)
        for k, lang in enumerate(langs):
            want = -sum(log(probability(lang, t[i - order + 1 : i + 1])) for i in places) / len(places)
            assert abs(want - entropies[k]) < 1e-4, (text, lang)
    for lang in langs:  # probabilities after any context sum to one over the alphabet (one character stands for all unseen)
        known = {g for other in langs for g in levels[other][0]}
        for context in ("", "t", "th", "de", "qq"):
            assert abs(sum(probability(lang, context + c) for c in known) + probability(lang, context + "\0") - 1) < 1e-9


def _line_stream(lines, rows, step):
    """(b, open, a) of ``_closest`` for rows (word, class, place, words of its line), ``step`` of them in a batch."""
    cells = [(w << 32 | n, u << lines.PLACE_BITS | place, parity, 0) for w, u, place, n, parity in rows]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*cells[k : k + step])], names=["a", "b", "parity", "parity2"]) for k in range(0, len(cells), step)]
    return [r for batch in lines._closest(80)(iter(batches)) for r in zip(*(c.to_pylist() for c in batch.columns))]


@pytest.mark.parametrize("step", [1, 3, 100])
def test_a_class_does_not_meet_itself(step):
    """Two words of a line whose hashes agree in 32 bits give two rows of one class: they are no candidates of each other."""
    from sheaf.llm import lines

    rows = [(5, 3, 0, 20, 77), (5, 3, 1, 20, 77), (5, 8, 0, 20, 77), (5, 8, 1, 20, 77), (6, 3, 2, 20, 77)]
    assert {(b, a) for b, _, a in _line_stream(lines, rows, step)} == {(8, 3)}


def test_all_close_lines_are_candidates():
    """Lines whose nearest candidate is in doubt get every candidate at once, so that few are looked up again."""
    from sheaf.llm import lines

    flip = lambda *bits: sum(1 << k for k in bits)
    rows = [(5, 1, 0, 20, flip(1, 2)), (5, 2, 0, 20, flip(3, 4)), (5, 3, 0, 20, flip(5, 6, 7)), (5, 4, 0, 20, 0)]
    got = _line_stream(lines, rows, 100)
    assert {a for b, _, a in got if b == 4} == {1, 2, 3} and not any(o for _, o, _ in got)


def test_power_tables_of_slices_are_kept_once():
    """A worker holds one table of powers a base, however many lengths the slices have."""
    from sheaf.llm import words

    one = words.powers(words.BYTE_BASE, 1000)
    two = words.powers(words.BYTE_BASE, 200_000)
    assert one.base is two.base and (two[:1001] == one).all()
    long = words.powers(words.BYTE_BASE, 1 << words.KEPT_BITS)
    assert len(long) == (1 << words.KEPT_BITS) + 1 and int(long[-1]) == pow(words.BYTE_BASE, 1 << words.KEPT_BITS, 1 << 64)
