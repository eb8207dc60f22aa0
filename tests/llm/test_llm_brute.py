"""Queries without SQL, and the pipeline, against brute force, round trips and held-out accuracy on the smallest tables."""

import hashlib
import html as markup
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from conftest import SF_SMOKE
from sheaf.llm import minhash, packing
from sheaf.llm.common import _tables, drop_scratch, table, written
from sheaf.llm.queries import REGISTRY

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(table(spark, SF_SMOKE, "documents").collect(), key=lambda r: r.doc_id)


def result(spark, name, key="doc_id"):
    return {r[key]: r for r in REGISTRY[name](spark, SF_SMOKE).collect()}


def test_fingerprints(spark, documents):
    out = result(spark, "op1_merkle_fingerprints")
    by_text = defaultdict(set)
    for r, after in zip(documents, documents[1:] + documents[:1]):
        text, half = r.text or "", len(r.text or "") // 2
        edited = text[: len(text) - half] + (after.text or "")[:half]
        o = out[r.doc_id]
        assert (o.n_chars, o.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= o.near_next <= 1 and 0 <= o.near_edited <= 1 and (edited == text) == (o.fingerprint == o.edited_fingerprint)
        by_text[text].add(o.fingerprint)
    prints = [next(iter(v)) for v in by_text.values() if len(v) == 1]
    assert len(prints) == len(by_text) == len(set(prints))
    assert np.mean([o.near_edited for o in out.values()]) > 0.4 > 0.05 > np.mean([o.near_next for o in out.values()])


def check_packing(texts, out):
    """texts: id -> list of texts (repeated rows); out: packed pieces."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_file("byte_bpe_50k.json"))
    want = Counter()
    for k, several in texts.items():
        for text in several:
            ids = model.encode(text or "", add_special_tokens=False).ids + [2]
            head = (len(ids) - 1) % 1024 + 1
            for piece, a in enumerate([0, *range(head, len(ids), 1024)]):
                part = ids[a : a + 1024 if piece else head]
                want[k, piece, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) <= 1.02 * -(-sum(r.length for r in out) // 1024) + 1


def test_packing(spark, documents):
    check_packing({r.doc_id: [r.text] for r in documents}, REGISTRY["op3_pack_sequences"](spark, SF_SMOKE).collect())


def test_packing_under_every_constraint():
    lengths = np.random.default_rng(1).integers(1, 900, 500)
    for rule in ("norm", "dot"):
        capacity = packing.Capacity(documents=3, attention=500_000, rule=rule)
        lengths = np.minimum(lengths, 700)
        where, offset = packing.best_fit(lengths, capacity)
        for k in set(where.tolist()):
            own = lengths[where == k]
            assert own.sum() <= 1024 and len(own) <= 3 and (own**2).sum() <= 500_000
            assert sorted(offset[where == k].tolist()) == [0, *np.cumsum(own[np.argsort(offset[where == k])])[:-1].tolist()]
    with pytest.raises(ValueError):
        packing.best_fit(np.array([2000]), packing.Capacity())


def test_words_tokenised_like_whole_texts():
    tokens = packing.WordTokens(packing.tokenizer_file("byte_bpe_50k.json"))
    texts = ["a  b", "it's we'll\nok", " lead", "tab\tx", "é à z", "<|endoftext|> a", "don't 123abc !!?? x", "", "a\n\nb", "x\n", "日本 語\nкод", "a b c"]
    assert tokens(texts) == [np.array(tokens.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_language_on_held_out_texts(spark, documents):
    out = result(spark, "op4_language_id")
    held = [(out[r.doc_id].lang_pred, r.lang) for r in documents if out[r.doc_id].held_out and r.lang]
    assert all(o.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, o in out.items())
    assert np.mean([a == b for a, b in held]) > 0.95


def test_secret_spans(spark, documents):
    out = result(spark, "op6_secret_scan")
    kinds = [
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    for r in documents:
        spans = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, ok) in enumerate(kinds) for m in p.finditer(r.text or "") if ok(m))
        o = out[r.doc_id]
        assert o.base_sha256 == hashlib.sha256(",".join(x[2] for x in spans).encode()).hexdigest()
        assert (o.n_assign, o.n_access, o.n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))
        assert not {x[2] for x in spans} - set(o.spans.split(","))


def test_main_text_of_pages(spark):
    out = result(spark, "op9_html_main_text", "page_id")
    for r in table(spark, SF_SMOKE, "pages").collect():
        article = r.html.split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(markup.unescape(re.sub("<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert out[r.page_id].text == "\n\n".join(x for x in blocks if x)


PAGES = {
    "no article element": (
        '<body class="has-sidebar"><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div id="cookie-notice">We use cookies. Accept, please.</div>'
        '<div class="layout"><div class="content"><h1>Title here</h1><p>First paragraph, with some text. It is long; yes.</p><ul><li>Point one</li></ul>'
        '<p>Second &amp; more text, again. And again.</p><div class="share-buttons"><a href=#>Tweet</a></div></div><div class="sidebar"><ul><li><a href=y>Another story.</a></li></ul></div></div>'
        '<section id="comments"><p>Great article, thanks! I liked it, really.</p></section><footer>Copyright</footer></body>',
        "Title here\n\nFirst paragraph, with some text. It is long; yes.\n\nPoint one\n\nSecond & more text, again. And again.",
    ),
    "reader comments as articles": (
        '<main><article><h1>X</h1><p>Long text, really. Yes it is.</p></article><article class="comment"><p>Reader says, hello. Good.</p></article></main>',
        "X\n\nLong text, really. Yes it is.",
    ),
    "aside, form and script inside": (
        '<article><h1>Head</h1><p>Text, <em>here</em>. Now.</p><script>var a="</p>";</script><form>Name <input></form><aside>note</aside><table><tr><td>c1<td>c2</table></article>',
        "Head\n\nText, here. Now.\n\nc1\n\nc2",
    ),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text_of_shapes(name):
    from sheaf.llm.html import main_text

    page, text = PAGES[name]
    assert main_text(page) == text


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def shingles(text, size=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for k in sorted(sets):
        for j in {j for s in sets[k] for j in having[s]}:
            if similar(sets[j], sets[k]):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
        for s in sets[k]:
            having[s].append(k)
    return {k: find(k) for k in sets}


def test_near_duplicates_of_planted_groups(spark):
    """A group whose members are mostly too far apart, chains, and copies: components equal those of all pairs."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for k in range(150):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 8)):
            words[at] = f"x{rng.integers(10**6)}"
        texts[k] = " ".join(words)
    for k in range(150, 170):
        texts[k] = texts[k - 150]
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = components({k: shingles(t) for k, t in texts.items()})
    assert len(set(want.values())) > 3
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(d).collect()} == want


def test_pipeline_stages(spark, documents):
    now = table(spark, SF_SMOKE, "documents")
    columns, states = now.columns, [{r.doc_id: [r] for r in documents}]
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, SF_SMOKE), name)
        rows = defaultdict(list)
        for r in now.collect():
            rows[r.doc_id].append(r)
        states.append(rows)
        assert now.columns == columns or name == "pack_sequences"
    start, language, lines, near, mixed, packed = states
    assert set(language) == {k for k, (r,) in start.items() if re.search(r"[^\W\d_]", r.text or "")}
    # line dedup
    seen, want = [], {}
    for k in sorted(language):
        kept = []
        for line in (language[k][0].text or "").split("\n"):
            words = set(WORD.findall(line))
            if not words or not any(similar(words, s) for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        if len(kept) == len(language[k][0].text.split("\n")) or WORD.search("\n".join(kept)):
            want[k] = "\n".join(kept)
    assert {k: r.text for k, (r,) in lines.items()} == want and all(r.n_chars == len(r.text) for (r,) in lines.values())
    # near-dedup
    root = components({k: shingles(r.text) for k, (r,) in lines.items()})
    assert set(near) == {k for k in root if root[k] == k}
    # mixing: whole documents, at most three times, sources near their targets
    size, taken, largest = Counter(), Counter(), Counter()
    for (r,) in near.values():
        n = len(WORD.findall(r.text))
        size[r.source] += n
        largest[r.source] = max(largest[r.source], n)
        taken[r.source] += n * len(mixed.get(r.doc_id, ()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    free, left, target = dict(weights), sum(size.values()), {}
    while over := [s for s in free if left * free[s] / sum(free.values()) > 3 * size[s]]:
        for s in over:
            target[s] = 3 * size[s]
        for s in over:
            free.pop(s)
        left = sum(size.values()) - sum(target.values())
    target |= {s: left * w / sum(free.values()) for s, w in free.items()}
    assert all(len(v) <= 3 for v in mixed.values()) and all(abs(taken[s] - target[s]) <= largest[s] for s in size)
    # packing
    out = [r for v in packed.values() for r in v]
    check_packing({k: [r.text for r in v] for k, v in mixed.items()}, out)


def test_scratch_tables_can_be_dropped(spark):
    import os

    assert written(spark.range(3), "numbers").count() == 3
    folder = _tables(spark).removeprefix("file://")
    assert os.listdir(folder)
    drop_scratch(spark)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("near", [2, 5, 1024])
def test_lines_of_a_word_meet_across_batches(monkeypatch, near):
    """Every line with a candidate among the earlier lines of its word gets one, or is left open if some were not met."""
    import pyarrow as pa

    from sheaf.llm import lines

    monkeypatch.setattr(lines, "NEAR", near)
    rng = np.random.default_rng(near)
    rows = []
    for word, size in enumerate([1, 2, 30, 3, 9, 60, 1, 8]):
        base = int(rng.integers(-(2**63), 2**63))
        for k in range(size):
            flips = rng.choice(64, rng.integers(0, 12), replace=False)
            rows.append((word, k, 0, int(rng.integers(18, 24)), base ^ (sum(1 << int(f) for f in flips) - (1 << 64 if 63 in flips else 0)), int(rng.integers(0, 4))))
    # packed rows: word and size, class number and place, both halves of the parity
    packed = [(w << 32 | n, k << lines.PLACE_BITS | place, parity, 0) for w, k, _, n, parity, place in rows]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*packed[a : a + 7])], names=["a", "b", "parity", "parity2"]) for a in range(0, len(rows), 7)]
    got = defaultdict(set)
    for batch in lines._closest(80)(iter(batches)):
        for b, _, a in zip(*(c.to_pylist() for c in batch.columns)):
            got[b].add(a)
    arrays = lambda r: [np.array([x]) for x in (r[3], r[4], r[5])]
    want, may = defaultdict(set), defaultdict(set)
    for j, b in enumerate(rows):
        for a in rows[:j]:
            if a[0] == b[0] and lines._passes(80, *arrays(a), *arrays(b))[0][0]:
                want[b[1], b[0]].add(a[1])
                may[b[1]].add(a[1])
    assert want
    for (b, _), _some in want.items():
        assert got[b], "a line with a candidate has neither a match nor is left open"
    for b, found in got.items():
        assert {a for a in found if a is not None} <= may[b] and (None not in found or near < 1024)
