"""4. Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is a bias plus the weights of its
distinct features: lower-cased words and the first 4 and 5 bytes of longer words (inflected
forms share them), kept as exact 64-bit hashes. Sentence scores combine by noisy-or,
P(doc) = 1 - prod(1 - p(sentence)), and the weights are trained from document labels alone by
proximal gradient steps on the noisy-or likelihood. The same weights then locate the
offending sentences. Training sees a bounded sample of labelled documents; scoring reads
every whole text in one map over Arrow batches, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navbuckets.llm.common import extended, materialize
from navbuckets.llm.textkernel import ALNUM_WORDS, HashTable, Words, byte_class, pieces, text_buffers

#: fixed value: lengths in bytes of the word prefixes that are features
PREFIXES = (4, 5)
_ENDS = ~byte_class([0x0A, 0x21, 0x2E, 0x3F])  # line feed ! . ?


class Sentences:
    """Sentences of the texts of a piece: spans, owners and distinct features by sentence."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, ALNUM_WORDS, PREFIXES)
        n = len(words.starts)
        self.texts = len(offsets) - 1
        owner = np.repeat(np.arange(self.texts), np.diff(words.first))
        ended = np.cumsum(_ENDS[data], dtype=np.int32)
        fresh = np.ones(n, bool)
        if n:
            fresh[1:] = (owner[1:] != owner[:-1]) | (ended[words.starts[1:]] != ended[words.starts[:-1]])
        self.first = np.flatnonzero(fresh)  # first word of each sentence
        self.text = owner[self.first]
        last = words.ends[np.append(self.first, n)[1:] - 1] if n else words.ends
        self.start, self.end = words.starts[self.first] - offsets[self.text], last - offsets[self.text]
        sentence = np.cumsum(fresh) - 1
        self.raw = [(sentence, words.hashes)] + [(sentence[h != 0], h[h != 0]) for h in words.prefix.values()]

    def features(self, table: HashTable | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, feature) of the distinct features of each sentence, in sentence order: the
        hashes themselves, or the indices of those in ``table``."""
        of, what = [], []
        for sentence, hashes in self.raw:
            if table is not None:
                at = table.find(hashes)
                sentence, hashes = sentence[at >= 0], at[at >= 0].astype(np.uint64)
            of.append(sentence)
            what.append(hashes)
        of, what = np.concatenate(of), np.concatenate(what)
        order = np.lexsort((what, of))
        of, what = of[order], what[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (what[1:] != what[:-1])
        return of[new], what[new]


class Model:
    """Feature hashes with non-zero weights, and the bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.table, self.weights, self.bias = HashTable(hashes), weights[order], float(bias)

    def hazard(self, s: Sentences) -> np.ndarray:
        """-log(1 - p) of every sentence."""
        of, at = s.features(self.table)
        return np.logaddexp(0, self.bias + np.bincount(of, self.weights[at.astype(np.int64)], minlength=len(s.first)))

    def score(self, s: Sentences) -> np.ndarray:
        return -np.expm1(-np.bincount(s.text, self.hazard(s), minlength=s.texts))


def likelihood(w: np.ndarray, bias: float, word: np.ndarray, sentence: np.ndarray, bag: np.ndarray, label: np.ndarray,
               weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The noisy-or loss and its gradient (the bias last). ``word, sentence``: the features of the
    sentences, one entry each; ``bag``: the document of each sentence; ``label, weight``: by document.

    A document's hazard is the sum of log(1 + e^z) over its sentences' logits z, so that
    P(clean) = e^-hazard; the loss is the weighted sum of hazards of clean documents and of
    -log(1 - e^-hazard) of toxic ones."""
    z = bias + np.bincount(sentence, w[word], minlength=len(bag))
    total = np.bincount(bag, np.logaddexp(0, z), minlength=len(label))
    grown = np.maximum(np.expm1(np.minimum(total, 50)), 1e-6)
    loss = float((weight * np.where(label > 0, np.log1p(1 / grown), total)).sum())
    dz = (weight * np.where(label > 0, -1 / grown, 1.0))[bag] / (1 + np.exp(-z))
    return loss, np.append(np.bincount(word, dz[sentence], minlength=len(w)), dz.sum())


def train(bags, hashes: np.ndarray, steps: int = 300, rate: float = 0.1, l1: float = 5e-5) -> Model:
    """``bags``: (label 0/1, weight, features of all sentences as places in ``hashes``, features by
    sentence). Adam on the noisy-or likelihood; after each step a soft threshold holds features
    without evidence at zero."""
    if not bags:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    label = np.array([b[0] for b in bags], np.float64)
    weight = np.array([b[1] for b in bags], np.float64)
    weight /= weight.sum()
    sizes = np.concatenate([b[3] for b in bags])
    bag = np.repeat(np.arange(len(bags)), [len(b[3]) for b in bags])
    word, sentence = np.concatenate([b[2] for b in bags]).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    share = float(np.clip((weight * label).sum(), 1e-4, 0.5))
    bias = float(np.log(share / max(1.0, len(sizes) / len(bags))))
    w = np.zeros(len(hashes))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        grad = likelihood(w, bias, word, sentence, bag, label, weight)[1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        step = rate / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        move = step * first / (1 - 0.9**t)
        w = w - move[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * step[:-1], 0)
        bias -= move[-1]
    kept = np.flatnonzero(w)
    return Model(hashes[kept], w[kept], bias)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, max_bytes: int = 24 << 20, max_features: int = 1 << 18,
        min_docs: int = 4) -> Model:
    """Train from ``labels(doc_id, toxic)`` on a bounded sample: about ``per_class`` labelled ids of
    each class by the hash of the id (at most ``4 * per_class`` ids), weighted back to the classes'
    true shares, so that scores keep the natural rate. Of the drawn documents, in the order of
    that hash, those are used whose texts have ``max_bytes`` together, none of more than an eighth of
    it, so the driver's memory does not follow the texts' lengths. Features are the ``max_features`` most frequent of
    those in at least ``min_docs`` documents, counted by Spark; only their numbers reach the driver.

    An id with several labels takes the largest, one with several texts the smallest text (null:
    empty); null labels and ids are not used. No labels give a model that scores 0."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train([], np.zeros(0, np.uint64))
    spread = 1 << 30
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    share = F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (c, int(min(1.0, per_class / n) * spread))])
    ids = known.where(draw < share[F.col("toxic")]).orderBy(draw, "doc_id").limit(4 * per_class)
    text = F.coalesce("text", F.lit(""))
    sample = (docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")  # at most 4 * per_class ids
              .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).where(F.octet_length("text") <= max_bytes // 8))
    sample = materialize(sample)
    before = Window.orderBy(draw, "doc_id")  # one narrow row an id
    used = sample.select("doc_id", F.sum(F.octet_length("text")).over(before).alias("bytes")).where(F.col("bytes") <= max_bytes)
    sample = materialize(sample.join(F.broadcast(used.select("doc_id")), "doc_id"))

    def distinct(batches):
        for batch in batches:
            for piece in pieces(batch):
                s = Sentences(*text_buffers(piece.column("text")))
                of, what = s.features()
                pair = np.unique(np.stack([s.text[of].astype(np.uint64), what]), axis=1) if len(of) else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[1].view(np.int64))], names=["feature"])

    often = (sample.select("text").mapInArrow(distinct, "feature long").groupBy("feature").agg(F.count("*").alias("n"))
             .where(F.col("n") >= min_docs).orderBy(F.col("n").desc(), "feature").limit(max_features))
    hashes = np.sort(np.array([r["feature"] for r in often.select("feature").collect()], np.int64).view(np.uint64))
    table = docs.sparkSession.sparkContext.broadcast(HashTable(hashes))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                s = Sentences(*text_buffers(piece.column("text")))
                of, what = s.features(table.value)
                size = np.bincount(of, minlength=len(s.first)).astype(np.int32)
                edge = np.searchsorted(s.text, np.arange(s.texts + 1))
                at = np.append(0, np.cumsum(size))[edge]
                numbers = what.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("toxic"),
                     pa.array([numbers[at[i]:at[i + 1]].tobytes() for i in range(s.texts)], pa.binary()),
                     pa.array([size[edge[i]:edge[i + 1]].tobytes() for i in range(s.texts)], pa.binary())],
                    names=["toxic", "words", "counts"])

    rows = sample.select("toxic", "text").mapInArrow(run, "toxic int, words binary, counts binary").collect()
    drawn = [(r["toxic"], np.frombuffer(r["words"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in rows]
    got = {c: sum(1 for b in drawn if b[0] == c) for c in sizes}
    return train([(y, sizes[y] / got[y], w, c) for y, w, c in drawn], hashes)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``score`` (0 to 1) from ``text`` alone beside the columns ``keep`` (all). Null, empty and
    wordless texts have no sentence and score 0."""
    keep = [c for c in keep or docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for piece in pieces(batch):
                value = model.score(Sentences(*text_buffers(piece.column("text"))))
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + [pa.array(value, pa.float64())],
                                                 names=keep + ["score"])

    source = docs.select(*dict.fromkeys([*keep, "text"]))
    return source.mapInArrow(run, extended(docs.select(*keep), score="double"))


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Sentences that score ``least`` or more: (doc_id, sentence, start, end, score); sentences are
    numbered from 0 within their text, spans are UTF-8 byte offsets of first to last word."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for piece in pieces(batch):
                s = Sentences(*text_buffers(piece.column("text")))
                p = -np.expm1(-model.hazard(s))
                hit = np.flatnonzero(p >= least)
                number = hit - np.searchsorted(s.text, s.text[hit])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(s.text[hit], pa.int64())), pa.array(number, pa.int64()),
                     pa.array(s.start[hit], pa.int64()), pa.array(s.end[hit], pa.int64()), pa.array(p[hit], pa.float64())],
                    names=["doc_id", "sentence", "start", "end", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sentence long, start long, end long, score double")
