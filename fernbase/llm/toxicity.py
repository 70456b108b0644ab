"""Toxicity by weak supervision.

1. Lexicons. From a bounded sample of labelled documents (``most_rows`` a class; documents that have the same
   words count once, so that a group of copies is one witness) come all words, and word beginnings shared
   by several words, that toxic documents use many times more often.
2. Voters. Groups of lexicon words, counts and rates of beginnings, disguised spellings, and style
   patterns each vote on every document, or do not.
3. Label model. A generative model of the votes given the hidden label: a tree of voters (each depends on the
   label and on the voter it is most correlated with), fitted by expectation-maximisation over all
   documents, in which known labels that may be learnt from are held fixed. Correlated voters thus don't
   count twice.
4. A logistic regression on a short vector of the document's hits is trained on the model's posterior
   labels, by Newton steps over all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, begin, fold, matrix, sub_batches, sum_vectors, text_bytes

#: Lengths of the word beginnings that are tried.
BEGINNINGS = range(4, 9)
GROUPS = 6
_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\w)")
_MASKS = re.compile(r"[0134578@$]")
_MASKABLE = re.compile(r"[\w@$]+")
_STRETCHED = re.compile(r"(.)\1{2,}")
_UNMASK = str.maketrans("0134578@$", "oieastbas")
#: Voters after the groups of words: types and rates of beginnings, several words, disguises, style.
STYLES = ("one_beginning", "two_beginnings", "four_beginnings", "beginning_rate", "two_words", "word_rate", "masked", "spaced", "stretched", "shouting", "cries")
VOTERS = GROUPS + len(STYLES)
FEATURES = ("one", "words", "beginnings", "word_rate", "beginning_rate", "weight", "heaviest", "disguised", "spread")
WIDTH = len(FEATURES)


def _has_run(text: str) -> bool:
    """Whether a character from the letters on comes three times in a row."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return bool(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] >= 0x61)).any())


class Lexicon:
    """Weights (log odds) of words and of word beginnings; words are dealt to groups by rank."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings
        self.group = {w: k % GROUPS for k, w in enumerate(sorted(words, key=lambda w: (-words[w], w)))}
        self.lengths = sorted({len(b) for b in beginnings})
        self.head = min(self.lengths, default=0)
        self.heads = {b[: self.head] for b in beginnings}

    def beginning(self, word: str) -> float:
        """The largest weight of a beginning of the word, 0 if none is in the lexicon."""
        found = self.beginnings
        return max((found.get(word[:k], 0.0) for k in self.lengths if k < len(word)), default=0.0)

    def read(self, text: str) -> tuple[list[int], list[float]]:
        """The votes and the features of a text."""
        low = text.lower()
        every = _WORD.findall(low)
        n = len(every) + 1
        counts = Counter(every)
        types = counts.keys()
        hits = [w for w in types if w in self.words]
        head, heads = self.head, self.heads
        starts = {w: b for w in types if w[:head] in heads and w not in self.words and (b := self.beginning(w))}
        n_hits = sum(map(counts.__getitem__, hits))
        n_starts = sum(map(counts.__getitem__, starts))
        # a disguised word ends at any other sign, and at an underscore
        near = [m for m in low.replace("_", " ").split() if _MASKS.search(m)] if _MASKS.search(low) else []
        masked = {r.translate(_UNMASK) for m in near for r in _MASKABLE.findall(m) if _MASKS.search(r)} & self.words.keys()
        single = sum(map((1).__eq__, map(len, every))) >= 4
        spaced = {re.sub(r"[ .*_-]", "", m) for m in _SPACED.findall(low)} & self.words.keys() if single else ()
        long = [w for w in types if _STRETCHED.search(w)] if _has_run(low) else []
        stretched = {s for w in long if w not in self.words and (s := _STRETCHED.sub(r"\1", w)) in self.words}
        upper = sum(map(str.isupper, text))
        groups = [0] * GROUPS
        for w in hits:
            groups[self.group[w]] = 1
        k, weight = len(starts), sum(self.words[w] for w in hits) + sum(starts.values())
        hidden = len(masked) + len(spaced) + len(stretched)
        votes = [k >= 1, k >= 2, k >= 4, n_starts > 0.01 * n, len(hits) >= 2, n_hits > 0.005 * n, masked, spaced, stretched, 2 * upper > len(text), 5 * low.count("!!") > n]
        features = [1.0, np.log1p(len(hits)), np.log1p(k), (n_hits / n) ** 0.5, (n_starts / n) ** 0.5, np.log1p(weight), max([*(self.words[w] for w in hits), *starts.values(), 0.0]), np.log1p(hidden), np.log1p(max(0, k - 1) + len(hits) + hidden)]
        return [*groups, *(int(bool(v)) for v in votes)], features


def _word_sets(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """(label, words): the different words of each sampled document; documents of a label with the same words are
    one row."""
    sample = None
    for label in (0, 1):
        some = labels.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
        sample = some if sample is None else sample.unionByName(some)
    begin(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            words = [sorted(set(_WORD.findall(text.decode().lower()))) for text in text_bytes(batch.column("text"))]
            marks = [hashlib.sha256(" ".join(w).encode()).digest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(marks, pa.binary()), pa.array(words, pa.list_(pa.string()))], ["label", "mark", "words"])

    # at most 2 * most_rows ids are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")
    return rows.mapInArrow(run, "label int, mark binary, words array<string>").dropDuplicates(["label", "mark"]).drop("mark")


def learn_lexicon(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, least_odds: float = 2.3) -> Lexicon:
    """``labels``: (doc_id, label). All words and beginnings whose log odds reach ``least_odds``, and whose support
    is five documents or one in 200 of the toxic ones. The sample's bound bounds them too: no more pass than
    200 times the words of a sampled document."""
    sample = Written(_word_sets(docs, labels, most_rows), "toxic-sample")
    once = sample.df
    size = {r["label"]: (r["n"], r["types"]) for r in once.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("types")).collect()}
    if size.get(0, (0, 0))[1] == 0 or size.get(1, (0, 0))[1] == 0:
        return Lexicon({}, {})
    (n0, t0), (n1, t1) = size[0], size[1]
    least = max(min(5, n1), n1 // 200)
    counted = once.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    table = Written(counted, "toxic-words")
    words = table.df
    odds = F.log((F.col("a") + 0.5) / t1) - F.log((F.col("b") + 0.5) / t0)
    good = words.where(F.col("a") >= least).withColumn("odds", odds).where(F.col("odds") >= least_odds)
    found = {r["word"]: r["odds"] for r in good.collect()}
    cut = F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in BEGINNINGS])
    parts = words.where("a + b > 0").select(F.explode(cut).alias("start"), "a", "b").where("start is not null")
    summed = parts.groupBy("start").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("a").alias("top"))
    starts = summed.where((F.col("a") >= 2 * least) & (F.col("top") < 0.5 * F.col("a"))).withColumn("odds", odds).where(F.col("odds") >= least_odds)
    begun = {r["start"]: r["odds"] for r in starts.collect()}
    sample.drop()
    table.drop()
    # a longer beginning adds nothing where a shorter one is as telling
    kept = {b: o for b, o in begun.items() if not any(b[:k] in begun and begun[b[:k]] >= o - 1.0 for k in BEGINNINGS if k < len(b))}
    return Lexicon(found, kept)


def read_votes(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, votes, features) of every whole text; null texts count as empty."""
    begin(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            votes, features = zip(*(lexicon.read(t.decode()) for t in text_bytes(batch.column("text"))), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(votes, pa.list_(pa.int8())), pa.array(features, pa.list_(pa.float64()))], ["doc_id", "votes", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, votes array<byte>, features array<double>")


class LabelModel:
    """P(label) times a tree of P(vote | label, parent's vote). Made from the expected pair counts:
    pairs[y, j, a, k, b] documents of label y with vote a of voter j and vote b of voter k."""

    def __init__(self, pairs: np.ndarray):
        v = pairs.shape[1]
        total = pairs[:, 0, :, 0, :].sum((1, 2)) + 1
        self.prior = np.log(total / total.sum())
        p = (pairs + 0.25) / (total[:, None, None, None, None] + 1)
        alone = np.einsum("yjaja->yja", p)
        alone = alone / alone.sum(2, keepdims=True)
        # the information that two voters share given the label, weighted by the labels
        joint = p / p.sum((2, 4), keepdims=True)
        apart = alone[:, :, :, None, None] * alone[:, None, None, :, :]
        shared = np.einsum("y,yjakb->jk", total / total.sum(), joint * np.log(joint / apart))
        self.parent = np.full(v, -1)
        inside, outside = [0], set(range(1, v))
        while outside:
            j, k = max(((j, k) for j in outside for k in inside), key=lambda x: shared[x])
            self.parent[j] = k
            inside.append(j)
            outside.remove(j)
        #: table[y, j, a, b]: log P(vote j is a | label y, parent's vote is b)
        self.table = np.empty((2, v, 2, 2))
        for j, k in enumerate(self.parent):
            given = p[:, j, :, k, :] / p[:, j, :, k, :].sum(1, keepdims=True) if k >= 0 else np.repeat(alone[:, j, :, None], 2, 2)
            self.table[:, j] = np.log(given)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(label 1) of each row of votes."""
        cols = np.arange(votes.shape[1])
        above = votes[:, np.maximum(self.parent, 0)]
        logs = [self.prior[y] + self.table[y][cols[None, :], votes, above].sum(1) for y in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _pair_counts(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """pairs[y, j, a, k, b] for rows with the probabilities ``weight`` (rows x 2) of the labels."""
    n, v = votes.shape
    hot = np.zeros((n, v, 2))
    hot[np.arange(n)[:, None], np.arange(v)[None, :], votes] = 1
    flat = hot.reshape(n, 2 * v)
    return np.array([(flat * weight[:, y : y + 1]).T @ flat for y in (0, 1)]).reshape(2, v, 2, v, 2)


def fit_label_model(votes: DataFrame, steps: int = 4) -> LabelModel:
    """``votes``: (votes, label or null, n), all documents with the same votes and label as one row."""
    shape = (2, VOTERS, 2, VOTERS, 2)

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        label = batch.column("label").cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
        return matrix(batch.column("votes"), VOTERS).astype(np.int64), label, batch.column("n").to_numpy(zero_copy_only=False)

    def known(batch: pa.RecordBatch) -> np.ndarray:
        v, label, n = columns(batch)
        return _pair_counts(v, np.stack([(label == 0) * n, (label == 1) * n], 1)).ravel()

    model = LabelModel(sum_vectors(votes.where("label is not null"), known, int(np.prod(shape))).reshape(shape))
    for _ in range(steps):

        def expected(batch: pa.RecordBatch, model: LabelModel = model) -> np.ndarray:
            v, label, n = columns(batch)
            p = np.where(label < 0, model.posterior(v), label)
            return _pair_counts(v, np.stack([(1 - p) * n, p * n], 1)).ravel()

        model = LabelModel(sum_vectors(votes, expected, int(np.prod(shape))).reshape(shape))
    return model


def fit_logistic(rows: DataFrame, model: LabelModel, steps: int = 8, ridge: float = 1.0) -> np.ndarray:
    """Weights of the features for the posterior labels; ``rows``: (votes, label or null, features)."""
    w = np.zeros(WIDTH)
    for _ in range(steps):

        def newton(batch: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
            x, v = matrix(batch.column("features"), WIDTH), matrix(batch.column("votes"), VOTERS).astype(np.int64)
            label = batch.column("label").cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
            target = np.where(label < 0, model.posterior(v), label)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            return np.concatenate([x.T @ (target - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

        sums = sum_vectors(rows, newton, WIDTH + WIDTH * WIDTH)
        step = np.linalg.solve(sums[WIDTH:].reshape(WIDTH, WIDTH) + ridge * np.eye(WIDTH), sums[:WIDTH] - ridge * w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, label_posterior.

    Labels are learnt only from rows whose crc32(doc_id as text) mod ``modulus`` is not ``held_out``; labels
    other than 0 and 1 and null ids are ignored, of several labels of one id the larger holds. Without
    labels of both kinds every score is the share of toxic labels, one half if there are none. Known labels
    that may be learnt from also stand for the posterior of their documents. Null and empty texts have a
    score too; texts of any length are read whole, by the same rules; repeated rows repeat; an empty table
    gives no rows; other columns are not read, whatever their names.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~fold("doc_id", modulus, held_out))
    usable = Written(usable.groupBy("doc_id").agg(F.max("label").alias("label")), "toxic-labels", narrow=True).df
    n, toxic = usable.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        score = F.lit((toxic + 0.5) / (n + 1.0))
        same = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"))
        return same.select("doc_id", fold("doc_id", modulus, held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("score").alias("label_posterior"))
    lexicon = learn_lexicon(docs, usable)
    seen = Written(read_votes(docs, lexicon), "toxic-votes")
    begin(docs.sparkSession, 1 << 13)
    rows = Written(seen.df.join(usable, "doc_id", "left"), "toxic-rows").df
    seen.drop()
    patterns = Written(rows.groupBy("votes", "label").agg(F.count("*").alias("n")), "toxic-patterns", narrow=True)
    model = fit_label_model(patterns.df)
    patterns.drop()
    w = fit_logistic(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, v = matrix(batch.column("features"), WIDTH), matrix(batch.column("votes"), VOTERS).astype(np.int64)
            score = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(model.posterior(v))], ["doc_id", "score", "predicted", "label_posterior"])

    scored = rows.select("doc_id", "votes", "features").mapInArrow(run, "doc_id long, score double, predicted int, label_posterior double")
    return scored.select("doc_id", fold("doc_id", modulus, held_out).alias("held_out"), "score", "predicted", "label_posterior")
