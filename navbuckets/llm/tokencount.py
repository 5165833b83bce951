"""8. Token counts by overlap resynchronisation.

Texts are encoded by the tokenizer's own library, each distinct pre-split word once while it is
remembered (units.py). A huge text is cut into chunks that overlap;
all chunks are encoded with offsets, and neighbours are spliced inside their overlap at a
*proven stable* common boundary: a place where both encodings have a token boundary and where
white space follows a character that is not white space. No pre-split match (byte-level and
word BPE) and no piece (sentencepiece files are checked for it) runs over such a place, and
nothing behind it depends on what stands before it, so both encodings agree there with that
of the whole text. Where an overlap has no such place it is widened, doubling until one
appears or the two chunks have become one. Counts are exact for every text length; a task
holds one chunk batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navbuckets.llm.common import extended
from navbuckets.llm.textkernel import pieces
from navbuckets.llm.units import library, library_coder

CHUNK = 1 << 15
OVERLAP = 1 << 8
BATCH = 1 << 18


class JsonCoder:
    """A tokenizers file: byte-level BPE, or BPE behind a pre-tokenizer that splits at white space."""

    def __init__(self, path: str):
        self.spaces = " \n\t\r"
        self.library = library(path)
        self.words = library_coder(path, count=True)

    def counts(self, texts: list[str]) -> list[int]:
        return self.words.encode(texts)

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """(start, end) code points of the tokens of each text."""
        return [np.array(e.offsets, np.int64).reshape(-1, 2) for e in self.library.encode_batch(texts, add_special_tokens=False)]


class PieceCoder:
    """A sentencepiece file whose pieces hold the word mark at their start only."""

    def __init__(self, path: str):
        import sentencepiece

        self.spaces = " "
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        inner = [p for p in map(self.library.id_to_piece, range(self.library.get_piece_size())) if mark in p.lstrip(mark)]
        if inner:
            raise ValueError("pieces run over white space: no boundary is proven stable")

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            proto = self.library.encode(text, return_type="proto")
            at = np.array([(p.begin, p.end) for p in proto.pieces], np.int64).reshape(-1, 2)
            lead = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80  # first bytes of code points
            out.append(np.append(0, np.cumsum(lead))[at])
        return out


_CODERS: dict = {}


def coder(path: str):
    if path not in _CODERS:
        _CODERS[path] = (PieceCoder if path.endswith(".model") else JsonCoder)(path)
    return _CODERS[path]


def _splice(text: str, spaces: str, lo: int, hi: int, left: np.ndarray, left_at: int, right: np.ndarray, right_at: int) -> int | None:
    """The last stable common boundary in [lo, hi), as a position of the whole text."""
    for x in range(hi - 1, max(lo, 1) - 1, -1):
        if text[x] in spaces and not text[x - 1].isspace() and text[x - 1].isprintable():
            # a boundary unless a token runs over it; tokens are in order of their ends
            for spans, at in ((left, left_at), (right, right_at)):
                k = int(np.searchsorted(spans[:, 1], x - at, side="right"))
                if k < len(spans) and spans[k, 0] < x - at:
                    break
            else:
                return x
    return None


def count_huge(text: str, code, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one long text from overlapping chunks."""
    n = len(text)
    cuts = list(range(0, n, chunk))
    total = 0
    per = max(1, BATCH // (chunk + overlap))
    at, spans, end = 0, None, 0  # the chunk to the left: start, tokens, end
    for group in range(0, len(cuts), per):
        starts = cuts[group:group + per]
        begins = [max(0, s - overlap) if s else 0 for s in starts]
        encoded = code.spans([text[b:min(n, s + chunk)] for b, s in zip(begins, starts, strict=True)])
        for begin, s, mine in zip(begins, starts, encoded, strict=True):
            stop = min(n, s + chunk)
            if spans is None:
                at, spans, end = begin, mine, stop
                continue
            width = overlap
            x = _splice(text, code.spaces, begin + 1, end, spans, at, mine, begin)
            while x is None:
                width *= 2
                begin = s - width
                if begin <= at:  # the chunks become one
                    break
                mine = code.spans([text[begin:stop]])[0]
                x = _splice(text, code.spaces, begin + 1, end, spans, at, mine, begin)
            if x is None or x <= at:
                back = min(at, 1)  # the character before a splice keeps the word mark off the chunk's start
                spans, end = code.spans([text[at - back:stop]])[0] - back, stop
                spans = spans[spans[:, 0] >= 0]
                continue
            total += int((spans[:, 0] < x - at).sum())
            mine = mine[mine[:, 0] >= x - begin]
            # from here the left chunk is what lies behind the splice
            at, spans, end = x, mine - np.int64(x - begin), stop
    return total + (0 if spans is None else len(spans))


def token_counts(docs: DataFrame, path: str, limit: int = 512, keep: list[str] | None = None,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns ``keep`` (all) with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than
    ``limit`` tokens). A null text counts as empty: 0 bytes, 0 tokens. ``path`` must be readable
    on the executors."""
    made = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in keep or docs.columns if c not in made]

    def run(batches):
        code = coder(path)
        for batch in batches:
            for piece in pieces(batch, limit=BATCH):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                n = np.zeros(len(texts), np.int64)
                n[short] = code.counts([texts[i] for i in short])
                for i, t in enumerate(texts):
                    if len(t) > chunk:
                        n[i] = count_huge(t, code, chunk, overlap)
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + [pa.array(n)], names=keep + ["n_tokens"])

    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    held = [c for c in keep if c != "n_bytes"] + ["__bytes"]
    source = docs.select(*[c for c in dict.fromkeys([*keep, "text"])], size.alias("__bytes"))
    keep_all, keep = keep, held
    schema = extended(source.select(*held), n_tokens="bigint")
    out = source.mapInArrow(run, schema)
    return out.select(*keep_all, F.col("__bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
