"""Language identification by interpolated Kneser-Ney character models.

Texts are read as lower-case letters; whatever is no letter is a space, runs of them one. For each language a
model of ``ORDER`` characters is estimated: counts at the highest order, numbers of distinct left neighbours
(continuation counts) below, one absolute discount an order, interpolated down to a uniform distribution.

The models are stored together: for each order a sorted array of 64-bit hashes of all character sequences that
any language has, with the log probability in every language beside it, and a sorted array of contexts with
the log back-off weights. A text is one binary search per character; only sequences that no language has go to
the next lower order.

The language of the lowest cross-entropy per character wins. Two things are calibrated on labelled texts that
took no part in the counts: the temperature that turns cross-entropies into the score (least log loss), and
per language the highest plausible cross-entropy, beyond which a text is rejected. Where a language has too few such
texts, the limit comes from a few of its texts cut in two: each half is scored by a model of the other one. That model
knows less than the final one, so the limit is rather too high, and a text is kept if in doubt. A language of which
too little is known even for that rejects nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import slices

ORDER = 4
#: Labelled texts that are used of each language, as expected from a hash of their ids; one in five calibrates.
SAMPLE_TEXTS = 3000
#: Rejection: so many times the spread of a language's cross-entropies above their mean, and so many nats at least.
SPREADS, LEAST_GAP = 8.0, 1.0
#: A language with fewer correctly classified calibration texts is also calibrated on halves: of so many texts, so many
#: characters of each at most, in pieces of so many.
LEAST_HELD, HALVED_TEXTS, HALVED_CHARACTERS, PIECE = 5, 20, 10_000, 250
_BASE = 0x9E3779B97F4A7C15


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))



@cache
def _letters() -> np.ndarray:
    """For every code point its lower-case letter (the first, if several), or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def characters(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, each after ``order`` - 1 spaces; start of each text and of the end; letters of each."""
    lead = order - 1
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer((" " * lead + (" " * lead).join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[codes]
    starts = np.cumsum(lengths + lead) - lengths
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    pads = (starts[:, None] - np.arange(lead, 0, -1)).ravel()
    keep[pads] = True
    # a space at the start of a text follows its lead: it goes
    place = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(codes != 32)])
    ends = starts + lengths
    return codes[keep], np.stack([place[starts], place[ends]], axis=1), letters[ends] - letters[starts]


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 to ``order`` the hash of the k characters that end at each place (0 before the start)."""
    c = codes.astype(np.uint64) + np.uint64(1)
    out = [c]
    for k in range(1, order):
        h = out[-1].copy()
        h[k:] += c[:-k] * _power(k)
        out.append(h)
    return out


@dataclass
class Models:
    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]  # per order: sorted hashes, log probabilities
    contexts: list[tuple[np.ndarray, np.ndarray]]  # per order: sorted hashes, log back-off weights
    unseen: np.ndarray
    temperature: float = 8.0
    mean: np.ndarray | None = None  # infinite: no text is rejected
    spread: np.ndarray | None = None
    alphabet: int = 0

    def log_probability(self, hashes: list[np.ndarray], at: np.ndarray, order: int) -> np.ndarray:
        if not order:
            return np.broadcast_to(self.unseen, (len(at), len(self.languages)))
        keys, values = self.grams[order - 1]
        wanted = hashes[order - 1][at]
        k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out = values[k]
        missing = np.flatnonzero(keys[k] != wanted)
        if len(missing):
            below = at[missing]
            lower = self.log_probability(hashes, below, order - 1)
            if order > 1:
                keys, values = self.contexts[order - 1]
                wanted = hashes[order - 2][below - 1]
                k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                lower = lower + np.where((keys[k] == wanted)[:, None], values[k], np.float32(0))
            out[missing] = lower
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the nats per character in each language, and the number of characters (0: no letter)."""
        order = len(self.grams)
        codes, spans, letters = characters(texts, order)
        inside = np.concatenate([np.arange(a, b) for a, b in spans]) if len(spans) else np.empty(0, np.int64)
        n = spans[:, 1] - spans[:, 0]
        total = np.zeros((len(texts), len(self.languages)))
        if len(inside):
            log_p = self.log_probability(gram_hashes(codes, order), inside, order)
            full = np.flatnonzero(n)
            total[full] = np.add.reduceat(log_p, (np.cumsum(n) - n)[full], axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], np.where(letters > 0, n, 0)

    def decide(self, entropies: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and acceptance of each text."""
        best = entropies.argmin(axis=1)
        least = entropies[np.arange(len(best)), best]
        score = 1 / np.exp(-self.temperature * (entropies - least[:, None])).sum(axis=1)
        gap = np.maximum(LEAST_GAP, SPREADS * self.spread[best] / np.sqrt(np.maximum(n, 1)))
        return best, np.where(n > 0, score, 0.0), (n > 0) & (least <= self.mean[best] + gap)


def estimate(languages: list[str], owner: np.ndarray, grams: np.ndarray, counts: np.ndarray, alphabet: int = 0) -> Models:
    """Models from the counts of all grams of the highest order: ``owner`` language, ``grams`` [n, order].

    The uniform distribution is over ``alphabet`` characters (0: those that occur, and one more).
    """
    order, n_lang = grams.shape[1], len(languages)
    def hashed(g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g), np.uint64)
        for j in range(g.shape[1]):
            out += (g[:, -1 - j].astype(np.uint64) + np.uint64(1)) * _power(j)
        return out

    levels = [(owner, grams, counts)]
    for _ in range(order - 1):  # distinct left neighbours of each suffix
        who, g, _n = levels[0]
        rows, first, number = np.unique(np.stack([who.astype(np.uint64), hashed(g[:, 1:])], axis=1), axis=0, return_index=True, return_counts=True)
        levels.insert(0, (who[first], g[first, 1:], number))
    alphabet = alphabet or len(np.unique(levels[0][1])) + 1
    below_keys, below = np.zeros(1, np.uint64), np.full((1, n_lang), 1 / alphabet)
    out = Models(languages, [], [], np.zeros(n_lang, np.float32), alphabet=alphabet)
    for k, (who, g, number) in enumerate(levels, 1):
        h = hashed(g)
        keys, first = np.unique(h, return_index=True)
        context = hashed(g[:, :-1])
        context_keys = np.unique(context)
        suffix = np.searchsorted(below_keys, hashed(g[first, 1:])) if k > 1 else np.zeros(len(keys), np.int64)
        of = np.searchsorted(context_keys, context[first])
        p, gamma = np.empty((len(keys), n_lang)), np.ones((len(context_keys), n_lang))
        for lang in range(n_lang):
            own = who == lang
            a = np.zeros(len(keys))
            a[np.searchsorted(keys, h[own])] = number[own]
            ones, twos = (number[own] == 1).sum(), (number[own] == 2).sum()
            discount = float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.95))
            at = np.searchsorted(context_keys, context[own])
            total, types = np.bincount(at, number[own], len(context_keys)), np.bincount(at, minlength=len(context_keys))
            seen = total > 0
            gamma[seen, lang] = discount * types[seen] / total[seen]
            p[:, lang] = np.maximum(a - discount, 0) / np.maximum(total, 1)[of] + gamma[of, lang] * below[suffix, lang]
        if k == 1:
            out.unseen = np.log(gamma[0] / alphabet).astype(np.float32)
        out.grams.append((keys, np.log(p).astype(np.float32)))
        out.contexts.append((context_keys, np.log(gamma).astype(np.float32)))
        below_keys, below = keys, p
    return out


def counted_grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of the highest order in ``texts`` [n, order], and how often each occurs."""
    codes, spans, _ = characters(texts, order)
    ends = np.concatenate([np.arange(a, b) for a, b in spans])
    _, first, number = np.unique(gram_hashes(codes, order)[-1][ends], return_index=True, return_counts=True)
    return codes[ends[first][:, None] - np.arange(order - 1, -1, -1)], number


def _counts(order: int):
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64())] + [(f"c{k}", pa.int32()) for k in range(order)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column("lang").to_pylist(), object)
            for lo, hi, *_ in slices(batch.column("_text")):
                for lang in sorted(set(labels[lo:hi])):
                    mine = pa.array(np.flatnonzero(labels[lo:hi] == lang))
                    grams, number = counted_grams(batch.column("_text").slice(lo, hi - lo).take(mine).to_pylist(), order)
                    if len(number):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(number)), pa.array(number, pa.int64()), *(pa.array(c.astype(np.int32)) for c in grams.T)], schema=schema)

    return run


def _scorer(shared):
    schema = pa.schema([("_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_()), ("entropy", pa.list_(pa.float64())), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        names = np.array([*models.languages, "und"], object)
        for batch in batches:
            for lo, hi, *_ in slices(batch.column("_text")):
                texts = [t or "" for t in batch.column("_text").slice(lo, hi - lo).to_pylist()]
                entropies, n = models.cross_entropies(texts)
                best, score, accepted = models.decide(entropies, n)
                best = np.where(n > 0, best, len(names) - 1)
                columns = [batch.column("_id").slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(score), pa.array(accepted), pa.array(list(entropies), pa.list_(pa.float64())), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


_SCORED = "_id long, lang_pred string, score double, accepted boolean, entropy array<double>, n long"


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_TEXTS, order: int = ORDER) -> Models | None:
    """Models from rows with a text and a language; None if there are none.

    About ``sample`` texts of each language are used (all, if fewer), chosen by a hash of their ids (of the text, if
    there is none); that bounds the counts, the models and what reaches the driver, whatever the size of ``labelled``.
    A language all of whose texts would calibrate, or are not chosen, is learned from ``HALVED_TEXTS`` of them.
    """
    spark = labelled.sparkSession
    rows = labelled.select(labelled[id_col].cast("long").alias("_id"), labelled[text_col].alias("_text"), labelled[lang_col].alias("lang")).where("_text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.element_at(F.create_map(*(F.lit(x) for lang in sorted(sizes) for x in (lang, min(1.0, sample / sizes[lang])))), F.col("lang"))
    key = F.coalesce("_id", F.xxhash64("_text"))
    draw = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 20))
    chosen = rows.where(draw < share * (1 << 20)).withColumn("held", F.pmod(F.xxhash64(key, F.lit(12)), F.lit(5)) == 0)
    keys = [f"c{k}" for k in range(order)]
    kind = "lang string, n long, " + ", ".join(f"{k} int" for k in keys)
    count = lambda texts: texts.select("lang", "_text").mapInArrow(_counts(order), kind).groupBy("lang", *keys).agg(F.sum("n").alias("n")).toPandas()
    counted = count(chosen.where("not held"))
    if missed := sorted(set(sizes) - set(counted["lang"])):
        counted = pd.concat([counted, count(_some(rows, missed, key))], ignore_index=True)
    languages = sorted(set(counted["lang"]))  # without those that have no letter
    if not languages:
        return None
    place = {lang: k for k, lang in enumerate(languages)}
    models = estimate(languages, counted["lang"].map(place).to_numpy(np.int64), counted[keys].to_numpy(np.uint32), counted["n"].to_numpy(np.int64))
    held = chosen.where(F.col("held") & F.col("lang").isin(sorted(set(languages) - set(missed))))
    scored = held.select("lang", "_text").mapInArrow(_calibration(spark.sparkContext.broadcast(models)), "lang string, entropy array<double>, n long").toPandas()
    few = calibrate(models, scored["lang"].map(place).to_numpy(np.int64), np.array(scored["entropy"].tolist()).reshape(len(scored), -1), scored["n"].to_numpy(np.int64))
    if few:
        texts: dict[str, list[str]] = {lang: [] for lang in few}
        for r in _some(rows, few, key).collect():
            texts[r.lang].append(r._text)
        for lang, own in texts.items():
            loosen(models, place[lang], own)
    return models


def _some(rows: DataFrame, languages: list[str], key: Column) -> DataFrame:
    """The start of ``HALVED_TEXTS`` texts with a letter of each language, by a hash; few rows of each reach the shuffle."""
    clipped = rows.where(F.col("lang").isin(languages) & F.col("_text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(key, F.lit(13)), F.xxhash64("_text")))
    return clipped.withColumn("_rank", rank).where(F.col("_rank") <= HALVED_TEXTS).select("lang", F.substring("_text", 1, HALVED_CHARACTERS).alias("_text"))


def _calibration(shared):
    schema = pa.schema([("lang", pa.string()), ("entropy", pa.list_(pa.float64())), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, *_ in slices(batch.column("_text")):
                entropies, n = shared.value.cross_entropies(batch.column("_text").slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), pa.array(list(entropies), pa.list_(pa.float64())), pa.array(n, pa.int64())], schema=schema)

    return run


def calibrate(models: Models, truth: np.ndarray, entropies: np.ndarray, n: np.ndarray) -> list[str]:
    """Set the temperature, and per language the mean cross-entropy and the spread at one character.

    Returns the languages with fewer than ``LEAST_HELD`` texts that are classified correctly; without any, a language
    rejects no text.
    """
    models.mean, models.spread = np.full(len(models.languages), np.inf), np.zeros(len(models.languages))
    usable = n > 0
    truth, entropies, n = truth[usable], entropies[usable], n[usable]
    if not len(truth):
        return list(models.languages)
    every = np.arange(len(truth))
    gap = entropies - entropies.min(axis=1, keepdims=True)
    loss = {t: float(np.mean(t * gap[every, truth] + np.log(np.exp(-t * gap).sum(axis=1)))) for t in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)}
    models.temperature = min(loss, key=loss.get)
    few = []
    for lang, name in enumerate(models.languages):
        own = (truth == lang) & (entropies.argmin(axis=1) == lang)
        if own.any():
            mine = entropies[own, lang]
            models.mean[lang] = np.average(mine, weights=n[own])
            models.spread[lang] = np.sqrt(np.mean((mine - models.mean[lang]) ** 2 * n[own]))
        if own.sum() < LEAST_HELD:
            few.append(name)
    return few


def loosen(models: Models, lang: int, texts: list[str]) -> None:
    """Raise mean and spread of a language to those of its ``texts``, each half scored by a model of the other."""
    order = len(models.grams)
    pieces = [t[a : a + PIECE] for t in texts for a in range(0, len(t), PIECE)]
    if not pieces:
        return
    if len(pieces) == 1:
        pieces = [pieces[0][: len(pieces[0]) // 2], pieces[0][len(pieces[0]) // 2 :]]
    upto = np.cumsum([len(p) for p in pieces])
    first = min(1 + int(np.searchsorted(upto, upto[-1] / 2)), len(pieces) - 1)
    halves = [pieces[:first], pieces[first:]]
    found = [counted_grams(half, order) for half in halves]
    if not all(len(number) for _, number in found):
        models.mean[lang] = np.inf
        return
    owner = np.repeat([0, 1], [len(number) for _, number in found])
    two = estimate(["0", "1"], owner, *(np.concatenate(x) for x in zip(*found)), models.alphabet)
    scored = [two.cross_entropies(half) for half in halves]
    entropies, n = np.concatenate([scored[0][0][:, 1], scored[1][0][:, 0]]), np.concatenate([x[1] for x in scored])
    mean = np.average(entropies, weights=n)
    spread = np.sqrt(np.mean((entropies - mean) ** 2 * n))
    known = np.isfinite(models.mean[lang])
    models.mean[lang] = max(mean, models.mean[lang]) if known else mean
    models.spread[lang] = max(spread, models.spread[lang])


def identify(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``lang_pred``, ``score``, ``accepted``), one row per row of ``docs``.

    ``lang_pred`` is a learned language, or ``und`` with score 0 for a null text or one without a letter (all, if
    there are no models). ``accepted`` is false for those and for texts whose cross-entropy is implausible in the
    best language. Repeated rows, null ids and an empty table are nothing special; other columns are not
    looked at.
    """
    d = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))
    if models is None:
        return d.select(F.col("_id").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    scored = d.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(models)), _SCORED)
    return scored.select(F.col("_id").alias("doc_id"), "lang_pred", "score", "accepted", "entropy", "n")


def accepted_rows(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has a language that ``identify`` accepts."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            for lo, hi, *_ in slices(texts):
                entropies, n = shared.value.cross_entropies([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                yield batch.slice(lo, hi - lo).filter(pa.array(shared.value.decide(entropies, n)[2]))

    return docs.mapInArrow(run, docs.schema)
