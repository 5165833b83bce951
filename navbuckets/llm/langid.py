"""2. Language identification with string kernels.

Kernel: the blended spectrum of byte n-grams (n = 1 to 3, A-Z lower-cased) as presence bits
in ``2**BITS`` hashed positions, normalised: k(x, z) = |x and z| / sqrt(|x| |z|). A few
labelled documents of each language are the Nystrom landmarks (the axes of the features; nothing is
counted or estimated from them), and every labelled document trains the one-versus-rest kernel
ridge regression on the Nystrom features: tasks add up products of kernel values, whose sums meet
per row of the matrix in a shuffle, so the driver gets one matrix of the landmarks' number squared. Scoring is
a batched matrix product: presence bits x landmarks, then x class weights.

The best margin says which language is nearest, not whether any is near: one-versus-rest targets
sum to 2 - K, so with K languages the best score of any text whatever is about 1 / K or more. That
is told by *familiarity* instead: the share of a text's longest n-grams that are common in the documents
of some language (a text may mix learned ones), against a bound per language calibrated on rows held out of the count.
Both take every labelled document, too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navbuckets.llm.common import extended
from navbuckets.llm.textkernel import LOWER, pieces, text_buffers

BITS = 15
WIDTH = 1 << BITS
NGRAMS = (1, 2, 3)
ROWS = 64  # texts per presence matrix
SPAN = 1 << 18  # bytes whose n-grams are looked at together, and about the bytes of a matrix's texts
SUMS = 64  # counts of n-grams (256 KiB a language) that a task holds before it hands them on
COMMON = 0.01  # an n-gram is common in a language if this share of its rows (two at least) holds it
LOSS, MARGIN = 0.001, 0.75  # a bound is MARGIN times the familiarity that all but LOSS of the held-out rows reach
LEAST = 10  # a language with fewer held-out rows has no bound: it rejects nothing


def _spots(data: np.ndarray, offsets: np.ndarray):
    """(size, start, index of the text, hashed position) of every n-gram, span by span and size by size; none
    spans two texts."""
    for at in range(0, len(data), SPAN):
        low = LOWER[data[at:at + SPAN + max(NGRAMS) - 1]].astype(np.uint32)
        lengths = np.diff(np.clip(offsets, at, at + len(low)))
        text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        left = np.repeat(offsets[1:] - at, lengths) - np.arange(len(low))
        code = np.zeros(len(low), np.uint32)
        for size in NGRAMS:
            if len(low) < size:
                break
            code = code[:len(low) - size + 1] * np.uint32(256) + low[size - 1:]
            m = min(len(code), SPAN)
            spot = ((code[:m] + np.uint32(size << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            whole = left[:m] >= size
            yield size, at + np.flatnonzero(whole), text[:m][whole], spot[whole]


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0/1 matrix (texts x hashed n-grams) of whole texts; n-grams never span two texts."""
    n = len(offsets) - 1
    flags = np.zeros(n * WIDTH, np.uint8)
    for _, _, text, spot in _spots(data, offsets):
        flags[text.astype(np.int64) * WIDTH + spot] = 1
    return flags.reshape(n, WIDTH)


def familiarity(data: np.ndarray, offsets: np.ndarray, common: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of a text's longest n-grams that are common in row ``which`` of ``common``, their number)
    per text. Every occurrence counts, so the share does not fall with the text's length; shorter
    n-grams are left out because noise in the same letters has them too, and those with a digit because
    numbers and keys belong to no language."""
    n = len(offsets) - 1
    hit, all_ = np.zeros(n), np.zeros(n)
    digit = (data >= 48) & (data <= 57)
    for size, start, text, spot in _spots(data, offsets):
        if size == max(NGRAMS):
            plain = ~np.any([digit[start + k] for k in range(size)], axis=0)
            text, spot = text[plain], spot[plain]
            hit += np.bincount(text, common[which[text], spot], n)
            all_ += np.bincount(text, minlength=n)
    return hit / np.maximum(all_, 1), all_


def common_from(rows):
    """How many of ``rows`` rows of a language must hold an n-gram that is common in it."""
    return max(min(2, rows), COMMON * rows)


def _blocks(batch: pa.RecordBatch):
    for piece in pieces(batch, limit=SPAN):
        for at in range(0, piece.num_rows, ROWS):
            yield piece.slice(at, ROWS)


class Model:
    """Landmark bits, their norms and the class weights of the Nystrom ridge regression.

    ``bits`` and ``labels`` give the landmarks and, unless ``train`` is false, the training rows
    (else ``solve`` takes the sums of all of them)."""

    def __init__(self, bits: np.ndarray, labels: list[str], landmarks: int, ridge: float, train: bool = True):
        self.labels = sorted(set(labels))
        self.bounds = np.zeros(len(self.labels))
        self.common = np.zeros((1, WIDTH), np.uint8)
        self.ridge = ridge
        if not self.labels:
            return
        # landmarks: the same number from each language as far as they go, one at least, in the order given
        turn = {}
        rank = []
        for lab in labels:
            turn[lab] = turn.get(lab, 0) + 1
            rank.append(turn[lab])
        chosen = np.argsort(np.array(rank), kind="stable")[:max(landmarks, len(self.labels))]
        marks = bits[chosen].astype(np.float32)
        scale = 1 / np.sqrt(np.maximum(marks.sum(1), 1))
        self.marks = np.ascontiguousarray((marks * scale[:, None]).T)
        k_mm = self.kernel(bits[chosen]).astype(np.float64)
        value, vector = np.linalg.eigh(k_mm)
        keep = value > 1e-6 * value[-1]
        self.root = vector[:, keep] / np.sqrt(value[keep])
        if train:
            own = np.array([self.labels.index(x) for x in labels])
            weight = 1.0 / np.bincount(own)  # every language counts the same, however many rows it has
            blocks = [self.products(bits[a:a + ROWS], own[a:a + ROWS], weight) for a in range(0, len(bits), ROWS)]
            self.solve(sum(g for g, _ in blocks), sum(m for _, m in blocks))

    def products(self, bits: np.ndarray, own: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted sums over rows of the languages ``own``: products of kernel values (and 1) among
        each other, and the values by language."""
        values = np.hstack([self.kernel(bits).astype(np.float64), np.ones((len(bits), 1))])
        weighted = values * weight[own][:, None]
        by_language = np.zeros((len(weight), values.shape[1]))
        np.add.at(by_language, own, weighted)
        return values.T @ weighted, by_language

    def solve(self, products: np.ndarray, by_language: np.ndarray) -> None:
        """Class weights from the sums of ``products`` over all rows; targets are 1 for a row's own language, else -1."""
        root = np.zeros((len(self.root) + 1, self.root.shape[1] + 1))
        root[:-1, :-1], root[-1, -1] = self.root, 1
        gram = root.T @ products @ root + self.ridge * np.eye(root.shape[1])
        solved = np.linalg.solve(gram, root.T @ (2 * by_language - by_language.sum(0)).T)
        self.weights = (self.root @ solved[:-1]).astype(np.float32)
        self.bias = solved[-1].astype(np.float32)

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        x = bits.astype(np.float32)
        return (x @ self.marks) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def decide(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score 0..1): the largest one-versus-rest margin."""
        margin = self.kernel(bits) @ self.weights + self.bias
        best = margin.argmax(1)
        return best, np.clip((margin[np.arange(len(best)), best] + 1) / 2, 0, 1).astype(np.float64)

    def familiar(self, data: np.ndarray, offsets: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether texts are near the languages told. Three standard deviations of a share of
        so few n-grams are allowed for, so short texts go only if they are far off."""
        share, n = familiarity(data, offsets, self.common, np.zeros(len(best), np.int64))
        bound = self.bounds[best]
        return share >= bound - 3 * np.sqrt(bound * (1 - bound) / np.maximum(n, 1))


def fit(docs: DataFrame, per_language: int = 400, landmarks: int = 96, ridge: float = 1e-3,
        max_rows: int = 8000, bounds: bool = False) -> Model:
    """Train on every row of ``docs(doc_id, text, lang)`` that has a lang and a text with a letter. Every
    lang value is learned, and counts the same however many rows it has. Only the landmarks are chosen: of
    each language the first by the hash of their ids among about ``per_language`` rows, fewer where
    that would be more than ``max_rows`` in all, but one at least. No rows give a model without languages.

    ``bounds`` also counts the n-grams common in each language and calibrates the bounds of familiarity,
    by a second pass over all rows: each half of a language's rows is held against the n-grams common in
    the other half."""
    spread = 1 << 30
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    usable = docs.where(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(
        "lang", "text", draw.alias("draw"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("rows"), F.min("draw").alias("first"), F.sum(F.col("draw") % 2).alias("odd")).collect()
    if not sizes:
        return Model(np.zeros((0, WIDTH), np.uint8), [], landmarks, ridge)
    each = max(1, min(per_language, max_rows // len(sizes)))
    share = [(r["lang"], max(int(min(1.0, each / r["rows"]) * spread), r["first"] + 1)) for r in sizes]
    share = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, share long"))
    drawn = usable.join(share, "lang").where("draw < share").select("lang", "text", "draw")
    sample = drawn.mapInArrow(_packed, "lang string, draw long, bits binary")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "bits"))
    rows = sample.withColumn("rank", rank).where(F.col("rank") <= min(2 * each, landmarks)).collect()
    rows.sort(key=lambda r: (r["draw"], r["lang"], bytes(r["bits"])))
    bits = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in rows], np.uint8)
    model = Model(bits.reshape(len(rows), WIDTH), [r["lang"] for r in rows], landmarks, ridge, train=False)
    del bits, rows
    by_half = {r["lang"]: (r["rows"] - r["odd"], r["odd"]) for r in sizes}
    halves = np.array([by_half[x] for x in model.labels], np.int64)
    common = _train(model, usable, halves, bounds)
    if bounds:
        model.common = common.max(0, keepdims=True)
        _calibrate(model, usable, halves, common[:2])
    return model


def _train(model: Model, usable: DataFrame, halves: np.ndarray, counts: bool) -> np.ndarray:
    """Solve ``model`` over all rows of ``usable(lang, text, draw)``. With ``counts`` the n-grams common in
    some language are returned, 0/1 in three rows: counted without half 0, without half 1, over all."""
    spark = usable.sparkSession
    names = model.labels
    n, m = len(names), model.marks.shape[1] + 1
    shared = spark.sparkContext.broadcast((model, {x: k for k, x in enumerate(names)}, 1.0 / halves.sum(1)))

    def batch_of(rows: list):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["key", "sums"])

    def partial(batches):
        """Sums of a task: row k of the products (key k), values of language k (m + k), counts of language k (-1 - k)."""
        model, place, weight = shared.value
        products, values, held = None, {}, {}
        for batch in batches:
            for block in _blocks(batch):
                flags = presence(*text_buffers(block.column("text")))
                own = np.array([place[x] for x in block.column("lang").to_pylist()])
                seen, local = np.unique(own, return_inverse=True)
                p, v = model.products(flags, local, weight[seen])
                products = p if products is None else products + p
                for k, row in zip(seen.tolist(), v, strict=True):
                    values[k] = values.get(k, 0) + row
                if counts:
                    odd = np.asarray(block.column("draw"), dtype=np.int64) % 2
                    for k in seen.tolist():
                        mine = np.stack([flags[(own == k) & (odd == h)].sum(0, dtype=np.int32) for h in (0, 1)])
                        held[k] = held[k] + mine if k in held else mine
                    if len(held) >= SUMS:
                        yield from (batch_of([(-1 - k, c)]) for k, c in held.items())
                        held = {}
        if products is not None:
            yield batch_of([*enumerate(products), *[(m + k, v) for k, v in values.items()]])
        yield from (batch_of([(-1 - k, c)]) for k, c in held.items())

    def total(batches):
        """One sum per key; counts of n-grams end as bits that say which are common."""
        found = {}
        for batch in batches:
            for key, part in zip(batch.column("key").to_pylist(), batch.column("sums"), strict=True):
                part = np.frombuffer(part.as_buffer(), np.int32 if key < 0 else np.float64)
                if key in found:
                    found[key] += part
                else:
                    found[key] = part.astype(np.int64 if key < 0 else np.float64)
        for key, value in found.items():
            if key < 0:
                even, odd = value.reshape(2, WIDTH)
                rows = halves[-1 - key]
                value = np.packbits(np.stack([(c >= common_from(r)) & (r > 0) for c, r in (
                    (odd, rows[1]), (even, rows[0]), (even + odd, rows.sum()))]), axis=1)
            yield batch_of([(key, value)])

    products, by_language, common = np.zeros((m, m)), np.zeros((n, m)), np.zeros((3, WIDTH // 8), np.uint8)
    kind = "key long, sums binary"
    for r in usable.mapInArrow(partial, kind).repartition("key").mapInArrow(total, kind).collect():
        if r["key"] < 0:
            common |= np.frombuffer(r["sums"], np.uint8).reshape(3, WIDTH // 8)
        elif r["key"] < m:
            products[r["key"]] = np.frombuffer(r["sums"])
        else:
            by_language[r["key"] - m] = np.frombuffer(r["sums"])
    model.solve(products, by_language)
    return np.unpackbits(common, axis=1)


def _calibrate(model: Model, usable: DataFrame, halves: np.ndarray, common: np.ndarray) -> None:
    """Set ``model.bounds`` from all rows of ``usable(lang, text, draw)``: of each language ``MARGIN`` times the
    familiarity that all but ``LOSS`` of its held-out rows reach (texts that repeat a rare word lie lower
    than any count shows); half their median at least, should rows be mislabelled. ``common``: row h was
    counted without half h. Familiarity is rounded to 1/10000, so its exact quantiles need few values."""
    shared = usable.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            for block in _blocks(batch):
                held = np.asarray(block.column("draw"), dtype=np.int64) % 2
                share, _ = familiarity(*text_buffers(block.column("text")), shared.value, held)
                yield pa.RecordBatch.from_arrays([block.column("lang"), pa.array(held), pa.array(np.round(share, 4))], names=["lang", "half", "share"])

    told = usable.mapInArrow(run, "lang string, half long, share double").groupBy("lang", "half", "share").agg(F.count("*").alias("n"))
    found = {}
    # a half is held out only if the language has rows in the other one
    seen = {x: [rows[1 - h] > 0 for h in (0, 1)] for x, rows in zip(model.labels, halves.tolist(), strict=True)}
    pairs = usable.sparkSession.createDataFrame([(x, h) for x, s in seen.items() for h in (0, 1) if s[h]] or [("", 2)], "lang string, half long")
    for r in told.join(F.broadcast(pairs), ["lang", "half"]).groupBy("lang").agg(
            F.sum("n").alias("n"), F.percentile("share", F.array(F.lit(LOSS), F.lit(0.5)), F.col("n")).alias("at")).collect():
        found[r["lang"]] = r
    for k, x in enumerate(model.labels):
        if x in found and found[x]["n"] >= LEAST:
            low, median = found[x]["at"]
            model.bounds[k] = max(MARGIN * low, median / 2)


def _packed(batches):
    for batch in batches:
        for block in _blocks(batch):
            bits = np.packbits(presence(*text_buffers(block.column("text"))), axis=1)
            yield pa.RecordBatch.from_arrays(
                [block.column("lang"), block.column("draw"), pa.array([b.tobytes() for b in bits], pa.binary())],
                names=["lang", "draw", "bits"])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, familiar: bool = False) -> DataFrame:
    """``lang_pred`` and ``score`` from ``text`` alone beside the columns ``keep`` (all).

    A null text or one without a letter is ``und`` with score 0; so is every text if the
    model has no languages. Ties go to the language first in sorted order. ``familiar`` adds a
    column of that name: whether the text is near the language told (``fit`` with ``bounds``);
    false without a letter, true of all other texts if the model has no languages.
    """
    keep = [c for c in keep or docs.columns if c not in ("lang_pred", "score", *["familiar"] * familiar)]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    und = docs.select(*dict.fromkeys([*keep, "text"]), letters.alias("__letters"))
    schema = extended(docs.select(*keep), lang_pred="string", score="double", **({"familiar": "boolean"} if familiar else {}))
    if not model.labels:
        return und.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *[F.col("__letters").alias("familiar")] * familiar)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        names = np.array(model.labels, dtype=object)
        for batch in batches:
            for block in _blocks(batch):
                known = np.asarray(block.column("__letters").to_numpy(zero_copy_only=False), bool)
                buffers = text_buffers(block.column("text"))
                best, score = model.decide(presence(*buffers))
                lang = np.where(known, names[best], "und")
                made = [pa.array(lang.tolist(), pa.string()), pa.array(np.where(known, score, 0.0))]
                if familiar:
                    made.append(pa.array(known & model.familiar(*buffers, best)))
                yield pa.RecordBatch.from_arrays([block.column(c) for c in keep] + made, names=schema.names)

    return und.mapInArrow(run, schema)
