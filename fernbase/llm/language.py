"""Language identification by mixture inference.

A language is a distribution over hashed byte trigrams of lower-cased letters and blanks. A document is
a mixture of languages: expectation-maximisation finds the proportions that make its trigrams likeliest.
The language set is chosen by penalised likelihood: starting from the likeliest single language, languages
come in by their proportion in the full mixture while the gain in log likelihood pays for a parameter.
What a parameter costs is measured on the documents that may be learnt from: trigrams overlap and words
repeat, so the half logarithm of their number is too little. Many documents are iterated at once as one
matrix of counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, fold, sub_batches, sum_vectors, text_bytes

#: Hashed trigrams; the model is a matrix of languages by these. Steps of expectation-maximisation.
BUCKETS, STEPS = 4096, 10
MOST_LANGUAGES = 2000
_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_LETTER, _ASCII_LETTER = regex.compile(r"\p{L}"), re.compile(rb"[A-Za-z]")
#: Steps of a factor for the penalty that is looked for, and how many there are.
GRAIN, GRAINS = 0.25, 400


def has_letter(text: bytes) -> bool:
    """Whether the text has a character of Unicode's category L."""
    return _ASCII_LETTER.search(text) is not None or not text.isascii() and _LETTER.search(text.decode()) is not None


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """A row of counts for each text. Trigrams with a blank in the middle are left out."""
    raw = _FOLD[np.frombuffer(b"  ".join(texts) + b"  ", np.uint8)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths + 2)
    middle = np.flatnonzero(raw[1:-1] != 0x20) + 1
    code = (raw[middle - 1] << 16) | (raw[middle] << 8) | raw[middle + 1]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(20)
    return np.bincount(owner[middle] * BUCKETS + bucket, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


def usable(docs: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """(text, lang) of the documents that may be learnt from."""
    known = F.col("lang").isNotNull() & F.col("text").isNotNull()
    return docs.where(known & ~fold("doc_id", modulus, held_out)).select("text", "lang")


def train(docs: DataFrame, modulus: int, held_out: int) -> tuple[list[str], np.ndarray]:
    """The languages and their smoothed distributions, from all documents with a language that may be used. The
    languages go through the driver; over MOST_LANGUAGES different ones are an error, as no corpus has them."""
    rows = usable(docs, modulus, held_out)
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"lang has over {MOST_LANGUAGES} different values: it does not name languages")
    place = {name: k for k, name in enumerate(names)}
    if not names:
        return [], np.empty((0, BUCKETS))

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((len(names), BUCKETS))
        for part in sub_batches(iter([batch]), "text", 1 << 20):
            rows = np.array([place[x] for x in part.column("lang").to_pylist()])
            np.add.at(total, rows, trigram_counts(text_bytes(part.column("text"))))
        return total.ravel()

    begin(docs.sparkSession)
    total = sum_vectors(rows, counts, len(names) * BUCKETS).reshape(len(names), BUCKETS)
    total += 0.5
    return names, total / total.sum(1, keepdims=True)


def train_penalty(docs: DataFrame, model: np.ndarray, modulus: int, held_out: int, share: float = 0.02) -> float:
    """The least penalty by which at most ``share`` of the documents that may be learnt from, each of which is said to
    have one language, would be given a second one; at least 1, the plain criterion. The share leaves room for
    documents that do hold a passage in another language."""

    def needed(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(GRAINS + 1)
        for part in sub_batches(iter([batch]), "text", 1 << 20):
            factor = second_gains(trigram_counts(text_bytes(part.column("text"))), model)
            out += np.bincount(np.clip(np.ceil(factor / GRAIN), 0, GRAINS).astype(np.int64), minlength=GRAINS + 1)
        return out

    if len(model) < 2:
        return 1.0
    begin(docs.sparkSession)
    counts = sum_vectors(usable(docs, modulus, held_out).select("text"), needed, GRAINS + 1)
    above = counts.sum() - np.cumsum(counts)
    return max(1.0, float(np.flatnonzero(above <= share * counts.sum())[0] * GRAIN))


def _mix(counts: np.ndarray, model: np.ndarray, weight: np.ndarray, steps: int) -> np.ndarray:
    n = np.maximum(counts.sum(1, keepdims=True), 1)
    for _ in range(steps):
        weight = weight * ((counts / (weight @ model)) @ model.T) / n
    return weight


def second_gains(counts: np.ndarray, model: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """For each document what its likeliest second language adds to the log likelihood, in units of half the log of
    the number of trigrams."""
    counts, model = counts.astype(np.float32), model.astype(np.float32)
    d, k = len(counts), len(model)
    single = counts @ np.log(model).T
    first = single.argmax(1)
    full = _mix(counts, model, np.full((d, k), 1 / k, np.float32), steps)
    full[np.arange(d), first] = -1
    pair = np.zeros((d, k), np.float32)
    pair[np.arange(d), first] = pair[np.arange(d), full.argmax(1)] = 0.5
    mixed = _mix(counts, model, pair, steps)
    like = (counts * np.log(mixed @ model)).sum(1, dtype=np.float64)
    return (like - single.max(1)) / (0.5 * np.log(np.maximum(counts.sum(1), 2)))


def mixtures(counts: np.ndarray, model: np.ndarray, penalty: float, steps: int = STEPS) -> np.ndarray:
    """Proportions of the languages in each document, zero outside the set that is chosen.

    A further language must raise the log likelihood by ``penalty`` times half the log of the number of
    trigrams.
    """
    counts = counts.astype(np.float32)
    model = model.astype(np.float32)
    d, k = len(counts), len(model)
    n = counts.sum(1)
    full = _mix(counts, model, np.full((d, k), 1 / k, np.float32), steps)
    single = counts @ np.log(model).T
    chosen = np.zeros((d, k), bool)
    chosen[np.arange(d), single.argmax(1)] = True
    best = single.max(1).astype(np.float64)
    weight = chosen.astype(np.float32)
    active = np.arange(d)
    for _ in range(k - 1):
        rest = np.where(chosen[active], -1, full[active])
        active = active[rest.max(1) > 0.01]
        if not len(active):
            break
        rest = np.where(chosen[active], -1, full[active])
        trial = chosen[active]
        trial[np.arange(len(active)), rest.argmax(1)] = True
        some = counts[active]
        start = (trial / trial.sum(1, keepdims=True)).astype(np.float32)
        mixed = _mix(some, model, start, steps)
        like = (some * np.log(mixed @ model)).sum(1, dtype=np.float64)
        better = like - best[active] > penalty * 0.5 * np.log(np.maximum(n[active], 2))
        active = active[better]
        chosen[active], weight[active], best[active] = trial[better], mixed[better], like[better]
    return weight


def predict_languages(docs: DataFrame, modulus: int = 3, held_out: int = 1, share: float = 0.02) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, and the chosen set with its proportions.

    The prediction is the language of the largest proportion (of equal ones the first by name) and the
    score is that proportion. A text that is null or has no letter is ``und`` with score 0, as is every
    text where nothing can be learnt; a letter is a character of Unicode's category L. Learnt are documents
    whose crc32(doc_id as text) mod ``modulus`` is not ``held_out``, by text and non-null lang (null ids
    are); predictions read the whole text, however long, and nothing else. Repeated rows repeat, an empty
    table gives no rows, further columns are not read, whatever their names.
    """
    names, model = train(docs, modulus, held_out)
    penalty = train_penalty(docs, model, modulus, held_out, share)
    schema = "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    begin(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", 1 << 20):
            texts = text_bytes(batch.column("text"))
            known = [k for k, t in enumerate(texts) if names and has_letter(t)]
            langs, scores, sets = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if known:
                shares = mixtures(trigram_counts([texts[k] for k in known]), model, penalty)
                shares = shares / shares.sum(1, keepdims=True)
                for k, row in zip(known, shares.tolist(), strict=True):
                    first = max(range(len(row)), key=row.__getitem__)
                    langs[k], scores[k] = names[first], min(1.0, row[first])
                    sets[k] = [{"lang": names[i], "share": row[i]} for i in sorted(range(len(row)), key=lambda i: -row[i]) if row[i] > 0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs), pa.array(scores, pa.float64()), pa.array(sets, kind)], ["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return rows.select("doc_id", fold("doc_id", modulus, held_out).alias("held_out"), "lang_pred", "score", "languages")
