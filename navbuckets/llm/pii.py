"""5. Personal data by candidate boosting, with DataFrame functions only.

High-recall generators (regular expressions, one linear pass each) propose overlapping spans of
four kinds, beside the base rules' own matches. A candidate is described by format and context bits and
its kind; boosted trees over the bits score it, and a threshold per kind, calibrated to a precision on
held-out texts, selects the spans that are added to the base rules' spans.

Labels are distant and come from evidence that no bit tells (``evidence``): the Luhn sum of a card, the
range of an address's parts, a phone's number of digits, a mail domain's last label. Base spans with
it are positive; candidates without it, and those that lie over a base span of another kind, are
negative; the rest is not labelled. The trees are shared by the kinds (a kind with few negatives learns
from the others' contexts). They are trained on the whole corpus without a sample: candidates are counted
by (bits, label, held out), at most ``2 ** BITS`` patterns, which are all that the boosting on the driver
sees. Spans are found, scored and joined inside each row: no shuffle but that of the counts.

Positions and contexts come from cutting the text at a pattern's matches: the pieces and the matches
alternate. Running sums and merges are folds in blocks, overlaps are counted by sorting, patterns use
possessive loops, which Java runs without recursion, and start runs only at their first character, so
that texts of any length and any number of matches cost close to linear time.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navbuckets.functions.dom import fence

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_RUN = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++"
#: the base rules; each finds the same leftmost matches as the contract's pattern
BASE = {
    "email": _RUN + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\x20?@\x20?|\x20?[\[({]at[\])}]\x20?|\x20at\x20)", r"(?:\.|\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)"
_BYTE_SEP = r"(?:\x20?\[\.\]\x20?|\x20?[\[(]dot[\])]\x20?|\x20?[.,]\x20?)"
#: the generators beside them; those of one kind may propose overlapping spans
LOOSE = {
    "email": [_RUN + _AT + r"[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]++)++"],
    "ip": [r"(?<![0-9])[0-9]{1,3}(?:" + _BYTE_SEP + r"[0-9]{1,3}){3}(?![0-9])"],
    "card": [r"(?<![0-9])[0-9]{13,19}(?![0-9])", r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])",
             r"(?<![0-9])[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{4,5}(?![0-9])", r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}[\x20.-][0-9]{1,3}(?![0-9])"],
    "phone": [r"(?<![0-9A-Za-z])\+?(?:[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
              r"(?<![0-9A-Za-z])\(?0[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
              r"(?<![0-9A-Za-z])(?:\+|00)[0-9]{1,3}(?:[\x20.-]\(?[0-9]{1,4}\)?){2,5}(?![0-9])"],
}
#: what a text must hold for the base rule's pattern, and for the generators', to be tried
HINT = {"email": ["@", r"@|(?:[\[({]at[\])}]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9]|\x20?[\[({]dot[\])}]|\x20dot\x20)"],
        "ip": [r"[0-9]\.[0-9]", r"[0-9][\]\)]?\x20?[.,\[(]"], "card": [r"[0-9][\x20-]?[0-9]", r"[0-9]{4}[\x20.-]?[0-9]{4}"],
        "phone": [r"\+[0-9]", r"[0-9][\x20().-]*+[0-9]"]}
CONTEXT = {"email": "mail|contact|write", "ip": r"\bip\b|host|server|address", "card": "card|visa|credit|pay", "phone": "phone|call|tel|mobile|fax"}
SIDE = 24  # characters of context on either side
_SPAN = "array<struct<start:int,end:int,m:string,before:string,after:string>>"


def let(value: Column, fn) -> Column:
    return F.element_at(F.transform(F.array(value), fn), 1)


def fold(items: Column, state: Column, empty: Column, step, block: int = 256) -> Column:
    """STRUCT<state, out> of ``step(state, item) -> STRUCT<state, out>`` over an array column, its ``out`` arrays
    put together. What a block emits is appended once, so appending costs n * n / ``block``."""
    def inner(a, x):
        return let(step(a["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], r["out"]).alias("out")))

    def outer(a, at):
        done = F.aggregate(F.slice(items, at, F.lit(block)), F.struct(a["state"].alias("state"), empty.alias("out")), inner)
        return let(done, lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], r["out"]).alias("out")))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(block)), F.struct(state.alias("state"), empty.alias("out")), outer)


def cut_at(text: str, matches: str, pattern: str) -> Column:
    """ARRAY<STRUCT<m, gap, before, after, step>> of the matches in column ``matches``: the piece of text ahead of
    each, ``SIDE`` characters on either side, and the length of both."""
    gaps = F.split(F.col(text), F.lit(pattern), -1)
    whole = F.arrays_zip(F.col(matches).alias("m"), gaps.alias("g"))  # one gap more than matches
    last = F.concat(F.array(F.lit("")), F.col(matches))

    def context(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.size(matches)), lambda x, i: F.struct(
            x["m"].alias("m"), F.length(x["g"]).alias("gap"),
            F.substring(F.concat(F.element_at(last, i + 1), x["g"]), -SIDE, SIDE).alias("before"),
            F.substring(F.concat(F.element_at(w, i + 2)["g"], F.coalesce(F.element_at(w, i + 2)["m"], F.lit(""))), 1, SIDE).alias("after")))

    return F.when(F.size(matches) > 0, let(whole, context)).otherwise(F.array().cast("array<struct<m:string,gap:int,before:string,after:string>>"))


def find_spans(pieces: str) -> Column:
    """(start, end, m, before, after) of the pieces that ``cut_at`` put into column ``pieces``."""
    def step(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        return F.struct((start + F.length(x["m"])).alias("state"), F.array(F.struct(
            start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), x["before"].alias("before"),
            x["after"].alias("after"))).alias("out"))

    none = F.array().cast(_SPAN)
    return F.when(F.size(pieces) > 0, fold(F.col(pieces), F.lit(0), none, step)["out"]).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def octets(m: Column) -> Column:
    """Are all four parts at most 255."""
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
                    & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255))


def check(kind: str, m: Column) -> Column:
    """The base rule's check of a match of its own pattern."""
    n = F.length(digits(m))
    if kind == "ip":
        return octets(m)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def evidence(kind: str, m: Column) -> Column:
    """What speaks for a candidate from outside its bits."""
    n = F.length(digits(m))
    if kind == "email":
        return m.rlike(r"(?:\.|[\])}]\x20?|\x20)[A-Za-z]{2,24}$")
    if kind == "ip":
        return octets(F.regexp_replace(m, "[^0-9]+", "."))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(m))).otherwise(False)
    return n.between(10, 15)


#: a tenth of all numbers has a right Luhn sum
CHANCE = {"card": 1 / 9}
FEATURES = ("plain", "usual", "parted", "mixed", "named", "glued_left", "glued_right", "chain_left", "chain_right", "assigned", "kind_low", "kind_high")
BITS = len(FEATURES)


def feature_bits(kind: str, s: Column) -> Column:
    """The candidate's bits as one integer, in the order of ``FEATURES``."""
    m, before, after = s["m"], s["before"], s["after"]
    plain = {"email": m.contains("@") & ~m.contains(" "), "ip": ~m.rlike("[^0-9.]"), "card": ~m.rlike("[^0-9]"), "phone": m.startswith("+")}[kind]
    usual = {"email": m.rlike("^[A-Za-z]"), "ip": ~m.rlike(r"(?:^|[^0-9])0[0-9]"), "card": m.rlike("^[3-6]"), "phone": m.rlike(r"^[+(]?[1-9]")}[kind]
    flags = [plain, usual, m.rlike(r"[\x20()\[\]-]"), m.rlike(r"[\x20]") & m.rlike(r"[.-]"), F.lower(before).rlike(CONTEXT[kind]),
             before.rlike(r"[A-Za-z0-9_/#.:+-]$"), after.rlike(r"^(?:[A-Za-z0-9_/@]|[.:][0-9])"), before.rlike(r"[0-9][\x20.,-]{1,2}$"),
             after.rlike(r"^[\x20.,-]{1,2}[0-9]"), before.rlike(r"[=\"'][\x20]?$"), F.lit(bool(KINDS.index(kind) & 1)), F.lit(bool(KINDS.index(kind) & 2))]
    bits = F.lit(0)
    for i, f in enumerate(flags):
        bits = bits + F.when(f, 1 << i).otherwise(0)
    return bits


_CAND = "array<struct<start:int,end:int,bits:int,is_base:boolean,backed:boolean>>"


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with, by kind, the columns ``__base_K`` (the base rules' spans) and ``__cand_K`` (all
    candidates with their bits, whether the base rule made them base spans, and their evidence)."""
    out = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    empty = F.array().cast("array<string>")
    names = {f"{kind}_{i}": (kind, p) for kind in KINDS for i, p in enumerate([BASE[kind], *LOOSE[kind]])}
    out = out.withColumns({f"__m_{n}": F.when(F.col("__text").rlike(HINT[kind][n[-1] != "0"]), F.regexp_extract_all("__text", F.lit(p), F.lit(0))).otherwise(empty)
                           for n, (kind, p) in names.items()})
    out = out.withColumns({f"__p_{n}": cut_at("__text", f"__m_{n}", p) for n, (_, p) in names.items()}).drop(*[f"__m_{n}" for n in names])
    out = out.withColumns({f"__s_{n}": find_spans(f"__p_{n}") for n in names}).drop(*[f"__p_{n}" for n in names])
    out = out.withColumns({f"__base_{k}": F.filter(F.col(f"__s_{k}_0"), _passes(k)) for k in KINDS})
    cands = {}
    for kind in KINDS:
        own = [n for n, (k, _) in names.items() if k == kind]
        every = F.concat(*[F.transform(F.filter(F.col(f"__s_{n}"), _plausible(kind)), _described(kind, n.endswith("_0"))) for n in own])
        cands[f"__cand_{kind}"] = F.when(sum((F.size(f"__s_{n}") for n in own), F.lit(0)) > 0, every).otherwise(F.array().cast(_CAND))
    return out.withColumns(cands).drop(*[f"__s_{n}" for n in names])


def _plausible(kind: str):
    """Numbers of other lengths are no candidates (the base patterns match every short number)."""
    low, high = {"card": (13, 19), "phone": (7, 18)}.get(kind, (0, 1 << 30))
    return lambda s: F.length(digits(s["m"])).between(low, high)


def _passes(kind: str):
    return lambda s: check(kind, s["m"])


def _described(kind: str, base: bool):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), feature_bits(kind, s).alias("bits"),
                              (check(kind, s["m"]) if base else F.lit(False)).alias("is_base"), evidence(kind, s["m"]).alias("backed"))


def overlaps(cands: Column, spans: Column) -> Column:
    """For each candidate (in order) the number of ``spans`` that it overlaps: spans that start before
    its end, less those that end at or before its start, both counted by one sort."""
    def ranks(edge: str, own: str) -> Column:
        mixed = F.array_sort(F.concat(
            F.transform(spans, lambda s: F.struct(s[edge].alias("p"), F.lit(1 if edge == "start" else 0).alias("k"), F.lit(-1).alias("j"))),
            F.transform(cands, lambda c, j: F.struct(c[own].alias("p"), F.lit(0 if edge == "start" else 1).alias("k"), j.alias("j")))))
        mine = F.filter(F.transform(mixed, lambda x, i: F.struct(x["j"].alias("j"), i.alias("i"))), lambda x: x["j"] >= 0)
        return F.array_sort(F.transform(mine, lambda x, r: F.struct(x["j"].alias("j"), (x["i"] - r).alias("n"))))

    return F.zip_with(ranks("start", "end"), ranks("end", "start"), lambda a, b: a["n"] - b["n"])


def with_overlaps(spans: DataFrame) -> DataFrame:
    """``__cand_K`` with ``own`` and ``other``: does a base span of its kind, of another kind, overlap it."""
    edges = lambda k: F.transform(F.col(f"__base_{k}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    out = spans.withColumns({f"__e_{k}": edges(k) for k in KINDS})
    out = out.withColumns({f"__o_{k}": F.concat(*[F.col(f"__e_{x}") for x in KINDS if x != k]) for k in KINDS})
    none = F.array().cast("array<int>")
    counts = {}
    for k in KINDS:
        for name, side in (("own", f"__e_{k}"), ("other", f"__o_{k}")):
            counts[f"__{name}_{k}"] = F.when(F.size(f"__cand_{k}") > 0, overlaps(F.col(f"__cand_{k}"), F.col(side))).otherwise(none)
    out = out.withColumns(counts)
    joined = {f"__cand_{k}": F.transform(F.arrays_zip(F.col(f"__cand_{k}").alias("c"), F.col(f"__own_{k}").alias("own"), F.col(f"__other_{k}").alias("other")), lambda x: F.struct(
        *[x["c"][f].alias(f) for f in ("start", "end", "bits", "is_base", "backed")], (x["own"] > 0).alias("own"), (x["other"] > 0).alias("other"))) for k in KINDS}
    return out.withColumns(joined).drop(*counts, *[f"__{x}_{k}" for x in "eo" for k in KINDS])


class Boosted:
    """Boosted two-level trees over the bits of all kinds, and a calibrated threshold per kind."""

    def __init__(self, counts: list[tuple[int, int, int, bool]], rounds: int = 32, rate: float = 0.3, precision: float = 0.85):
        """``counts``: (bits, positives, negatives, held out)."""
        seen = [c[:3] for c in counts if not c[3]]
        pos, neg = sum(p for _, p, _ in seen), sum(n for _, _, n in seen)
        self.start = math.log((pos + 0.5) / (neg + 0.5))
        self.trees: list[tuple] = []  # (first bit, (second bit, value if unset, value if set) by first bit)
        score = [self.start] * len(seen)
        for _ in range(rounds if pos and neg else 0):
            tree = self._grow(seen, score)
            self.trees.append((tree[0], tuple((b, rate * lo, rate * hi) for b, lo, hi in tree[1])))
            score = [s + self._leaf(self.trees[-1], bits) for s, (bits, _, _) in zip(score, seen, strict=True)]
        held = [(self.value(c[0]), *c[:3]) for c in counts if c[3]]
        pooled = self._lowest(held, precision)
        self.threshold = {}
        for k, kind in enumerate(KINDS):
            mine = [h for h in held if h[1] >> (BITS - 2) == k]
            # a kind without a labelled error on held-out texts takes the bound of all kinds
            self.threshold[kind] = self._lowest(mine, precision, CHANCE.get(kind, 1.0)) if any(h[3] for h in mine) else pooled

    @staticmethod
    def _lowest(held: list[tuple], precision: float, chance: float = 1.0) -> float | None:
        """The lowest score above 0 from which on the held-out candidates are precise enough; None if
        there is none, or no negative to tell. Of those that are selected later only such with
        evidence stay; ``chance`` negatives have it by chance for each one without it."""
        if not any(h[3] for h in held):
            return None
        found, good, bad = None, 0, 0
        ranked = sorted(held, key=lambda x: (-x[0], x[1]))
        for i, (s, _, p, n) in enumerate(ranked):
            good, bad = good + p, bad + n
            if (i + 1 == len(ranked) or ranked[i + 1][0] < s) and s > 0 and good and good - chance * bad >= precision * good:
                found = s
        return found

    @staticmethod
    def _leaf(tree, bits: int) -> float:
        b, lo, hi = tree[1][bits >> tree[0] & 1]
        return hi if bits >> b & 1 else lo

    def value(self, bits: int) -> float:
        return self.start + sum(self._leaf(t, bits) for t in self.trees)

    @staticmethod
    def _grow(counts, score):
        """The tree with the largest Newton gain of the logistic loss."""
        rows = []
        for s, (bits, p, n) in zip(score, counts, strict=True):
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
            rows.append((bits, p - (p + n) * q, (p + n) * q * (1 - q)))
        # sums of gradients and curvatures by every pair of bits and their values
        cells = np.zeros((BITS, 2, BITS, 2, 2))
        which = np.array([[r[0] >> b & 1 for b in range(BITS)] for r in rows])
        sums = np.array([r[1:] for r in rows])
        for a in range(BITS):
            for side in (0, 1):
                part = which[:, a] == side
                for want in (0, 1):
                    cells[a, side, :, want] = (which[part] == want).T.astype(float) @ sums[part]
        value = cells[..., 0] / (cells[..., 1] + 1.0)
        gain = (cells[..., 0] * value).sum(-1)  # first bit, its value, second bit
        second = gain.argmax(-1)
        first = int(gain.max(-1).sum(-1).argmax())
        return first, [(int(second[first, side]), *map(float, value[first, side, second[first, side]])) for side in (0, 1)]

    def score(self, bits: Column) -> Column:
        out = F.lit(self.start)
        for a, sides in self.trees:
            (b0, lo0, hi0), (b1, lo1, hi1) = sides
            out = out + F.when(bits.bitwiseAND(1 << a) != 0, F.when(bits.bitwiseAND(1 << b1) != 0, hi1).otherwise(lo1)).otherwise(
                F.when(bits.bitwiseAND(1 << b0) != 0, hi0).otherwise(lo0))
        return out


def fit(spans: DataFrame) -> Boosted:
    """Boost from the candidates of ``with_overlaps`` over all rows; every fourth text by its hash is
    held out for the thresholds."""
    every = F.concat(*[F.transform(F.col(f"__cand_{k}"), lambda c: F.struct(
        c["bits"].alias("bits"), (c["is_base"] & c["backed"] & ~c["other"]).alias("good"),
        (~c["backed"] | (~c["is_base"] & c["other"])).alias("bad"))) for k in KINDS])
    held = F.pmod(F.xxhash64("__text"), F.lit(4)) == 0
    counts = (spans.select(held.alias("held"), F.explode(every).alias("c")).select("held", "c.*").groupBy("bits", "held").agg(
        F.count(F.when(F.col("good"), 1)).alias("p"), F.count(F.when(F.col("bad"), 1)).alias("n")).collect())  # at most 2 ** (BITS + 1) rows
    return Boosted(sorted((r["bits"], r["p"], r["n"], r["held"]) for r in counts))


def detect(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, kind number, end) by start, then
    kind (``KINDS``); code points of ``text``, end exclusive. ``spans`` holds all base spans and the
    candidates that the boosted trees select, that have their kind's evidence and that overlap no base
    span of their kind. Null and empty texts have none; without labelled candidates of both sorts
    nothing is added; repeated rows are alike.
    """
    found = with_overlaps(with_spans(docs))
    model = model or fit(found)

    def triples(column: str, k: int) -> Column:
        return F.transform(F.col(column), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))

    base, added = [], []
    for k, kind in enumerate(KINDS):
        base.append(triples(f"__base_{kind}", k))
        low = model.threshold[kind]
        if low is not None:
            found = found.withColumn(f"__more_{kind}", F.filter(F.col(f"__cand_{kind}"), _chosen(model, low)))
            added.append(triples(f"__more_{kind}", k))
    found = found.withColumn("base_spans", F.array_sort(F.concat(*base)))
    # chosen candidates overlap no base span of their kind; two generators may have proposed one twice
    found = found.withColumn("spans", F.array_sort(F.concat("base_spans", F.array_distinct(F.concat(*added)))) if added else F.col("base_spans"))
    # fenced: a later filter on a result must not be substituted down through all of the above
    found = found.withColumns({c: fence(F.col(c)) for c in ("base_spans", "spans")})
    return found.drop(*[c for c in found.columns if c.startswith("__")])


def _chosen(model: Boosted, low: float):
    return lambda c: ~c["is_base"] & c["backed"] & ~c["own"] & (model.score(c["bits"]) >= low - 1e-9)


def span_text(spans: Column) -> Column:
    """kind:start:end of (start, kind number, end) spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the detected spans of ``text`` replaced by their kind in brackets (that of the
    first span where spans overlap); all columns kept, null texts stay null."""
    found = detect(docs)
    cluster = "struct<start:int,kind:int,end:int>"

    def step(last: Column, s: Column) -> Column:  # the open cluster, and those that are over
        joins = F.coalesce(last["end"] > s["start"], F.lit(False))
        wider = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.struct(F.when(joins, wider).otherwise(s).alias("state"), F.when(joins | last.isNull(), F.array().cast(f"array<{cluster}>"))
                        .otherwise(F.array(last)).alias("out"))

    folded = fold(F.col("spans"), F.lit(None).cast(cluster), F.array().cast(f"array<{cluster}>"), step)
    merged = let(folded, lambda r: F.concat(r["out"], F.array(r["state"])))
    cut = found.withColumn("__cuts", F.when(F.size("spans") > 0, merged))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # characters as an array: a slice costs its own length, a substring also all that stands ahead of it
    chars = F.when(F.col("__cuts").isNotNull(), F.split("text", ""))
    cut = cut.withColumn("__chars", chars)
    ends = F.concat(F.array(F.lit(0)), F.col("__cuts")["end"])
    kept = F.transform(F.col("__cuts"), lambda s, i: F.concat(
        F.array_join(F.slice("__chars", F.element_at(ends, i + 1) + 1, s["start"] - F.element_at(ends, i + 1)), ""),
        F.element_at(names, s["kind"] + 1)))
    tail = F.array_join(F.slice("__chars", F.element_at(ends, -1) + 1, F.size("__chars")), "")
    text = F.when(F.col("__cuts").isNull() | (F.size("__chars") < 0), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))
    return cut.withColumn("text", fence(text)).select(*docs.columns)
