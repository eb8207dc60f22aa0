"""Merkle fingerprints of documents.

A text is cut without loss: sections end after an empty line, paragraphs are lines, and a paragraph's leaves are
its sentences (up to and with a full stop and space), longer ones in cuts of ``CUT`` characters, so that an edit
leaves what stands before it in its sentence and all other sentences alone. A leaf is 11 bytes of BLAKE2b and
its length in 1 byte; a paragraph, a section and the root are each the 16-byte BLAKE2b of what they consist of.

The fingerprint is the root in hexadecimal, a colon, and the tree: leaves in Base64 (16 characters each),
``;`` after each paragraph but the last and ``|`` after each section but the last. So equal texts have equal
fingerprints, the roots alone test equality, and walking down where nodes differ locates edits.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a leaf; characters in a leaf at most.
LEAF, CUT = 12, 48


def _node(parts: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def tree(text: str) -> list[list[bytes]]:
    """Sections, each a list of paragraphs, each the concatenated leaves."""
    sections: list[list[bytes]] = [[]]
    lines = text.split("\n")
    last = len(lines) - 1
    for i, line in enumerate(lines):
        parts = [p + ". " for p in line.split(". ")]
        parts[-1] = parts[-1][:-2] + "\n" * (i < last)
        cuts = [p[k : k + CUT] for p in parts for k in range(0, len(p), CUT)]
        sections[-1].append(b"".join([hashlib.blake2b(p.encode(), digest_size=LEAF - 1).digest() + bytes((len(p),)) for p in cuts]))
        if not line and i < last:
            sections.append([])
    return sections


def root(sections: list[list[bytes]]) -> str:
    return _node([_node([_node([p]) for p in s]) for s in sections]).hex()


def encoded(sections: list[list[bytes]]) -> str:
    return root(sections) + ":" + "|".join([";".join([b64encode(p).decode() for p in s]) for s in sections])


def decoded(fingerprint: str) -> list[list[bytes]]:
    return [[b64decode(p) for p in s.split(";")] for s in fingerprint.partition(":")[2].split("|")]


def leaves(sections: list[list[bytes]]) -> Counter:
    return Counter(p[k : k + LEAF] for s in sections for p in s for k in range(0, len(p), LEAF))


def likeness(a: Counter, b: Counter) -> float:
    """Characters in common leaves, twice, over the characters of both; 1 for two empty texts."""
    length = lambda x: x[-1]
    whole = sum(length(x) * n for x, n in a.items()) + sum(length(x) * n for x, n in b.items())
    few, many = (a, b) if len(a) < len(b) else (b, a)
    return 2 * sum(length(x) * min(n, many[x]) for x, n in few.items() if x in many) / whole if whole else 1.0


def differing(a: str, b: str) -> Iterator[tuple[int, int]]:
    """(section, paragraph) places at which two fingerprints differ; nothing below equal nodes is looked at."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return
    x, y = decoded(a), decoded(b)
    for i in range(max(len(x), len(y))):
        s, t = x[i] if i < len(x) else [], y[i] if i < len(y) else []
        if _node(s) != _node(t):
            for k in range(max(len(s), len(t))):
                if (s[k] if k < len(s) else None) != (t[k] if k < len(t) else None):
                    yield i, k


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (``_id``, ``_text``) plus ``part`` and ``ahead``: rows of one part are neighbours in the order of ids.

    Parts are ranges of ids between quantiles. The first row of each part is also added to the part before it
    (of the first part, to the last) with ``ahead`` true, so every row's successor is in its own part and the texts
    move once.
    """
    ids = docs.withColumn("_order", F.coalesce(F.col("_id"), F.lit(-(1 << 62))).cast("double"))
    found = ids.agg(F.percentile_approx("_order", [k / buckets for k in range(1, buckets)], 50 * buckets)).first()[0] if buckets > 1 else None
    splits = [-float("inf"), *sorted(set(found or (0.0,))), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_order", outputCol="part").transform(ids).withColumn("part", F.col("part").cast("int"))
    firsts = cut.groupBy("part").agg(F.min(F.struct("_order")).alias("least")).select("part", "least._order")
    # one row per part: as many as there are splits
    edges = firsts.collect()
    before = dict(zip((r.part for r in sorted(edges)), [max((r.part for r in edges), default=0), *sorted(r.part for r in edges)]))
    if not edges:
        return cut.select("_id", "_text", "part", F.lit(False).alias("ahead"))
    back = docs.sparkSession.createDataFrame([(r.part, r._order, before[r.part]) for r in edges], "p int, o double, back int")
    copied = cut.join(F.broadcast(back), (F.col("part") == F.col("p")) & (F.col("_order") == F.col("o")))
    return cut.select("_id", "_text", "part", F.lit(False).alias("ahead")).unionByName(copied.select("_id", "_text", F.col("back").alias("part"), F.lit(True).alias("ahead")))


def _edit(rows: pd.DataFrame) -> pd.DataFrame:
    rows["_text"] = rows["_text"].fillna("")
    rows = rows.sort_values(["ahead", "_id", "_text"], na_position="first", kind="stable", ignore_index=True)
    own = int((~rows["ahead"]).sum())
    texts = rows["_text"].tolist()[: own + 1]
    sections = [tree(t) for t in texts]
    bags = [leaves(s) for s in sections]
    out = []
    for k in range(own):
        half = len(texts[k]) // 2
        edited = texts[k][: len(texts[k]) - half] + texts[k + 1][:half]
        changed = tree(edited)
        out.append((rows["_id"].iloc[k], len(texts[k]), hashlib.sha256(edited.encode()).hexdigest(), encoded(sections[k]), encoded(changed), likeness(bags[k], leaves(changed)), likeness(bags[k], bags[k + 1])))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, one row per row of ``docs``.

    Columns: ``doc_id``, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` (likeness to the edited text's and to the next document's fingerprint). The
    edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next
    document, ascending by id (ties: by text); after the last comes the first.

    A null text is an empty one. Rows without id come first. A single row is its own successor. An empty table
    gives an empty one. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    d = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_next(d, parts).groupBy("part")
    return dealt.applyInPandas(_edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
