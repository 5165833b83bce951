"""10. Byte-level BPE by a tokenization automaton.

The automaton's arcs carry tokens, and it accepts exactly the token sequences that BPE
produces. It is the one that successive merge gadgets would build (none is built): the gadget of merge
k, (a, b) -> c, takes the arc b out of the state behind a, adds the arc c beside a, and lets
c lead where b led. A state is named by the token that leads to it; because a gadget copies a
state minus one arc, a state is kept as its *history* - the tokens on its right edge, each with
the merge that ended it - and a label likewise by its left edge. An arc u -> v is missing
exactly if some gadget k = (a, b) found a still standing at the right edge of u and b at the
left edge of v. ``arc`` decides that once and keeps the answer as a table entry.

Encoding reads pre-split words over the byte trie of the arc labels: every position of a word
has exactly one accepted path from the start (BPE is deterministic), so one forward pass over
table transitions finds the tokens, in time linear in the word's length. The new words of a
piece of text take that pass together, one table lookup for all of them at a time. Decoding emits the
arc labels. Words are split from texts by the tokenizer's own pattern; special tokens inside
a text are split off first, as the library does by default.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from navbuckets.llm.common import extended
from navbuckets.llm.textkernel import pieces
from navbuckets.llm.units import WordCoder, byte_alphabet

#: arcs remembered at most (decided again when asked for later)
ARCS = 450_000
#: words of more bytes are walked by themselves: they would hold up the words beside them
LONG = 256


class Transitions:
    """A map from integers to integers as an open-addressed table with batched lookups."""

    def __init__(self, items: dict[int, int] | None = None):
        self.build(items or {})

    def build(self, items: dict[int, int]) -> None:
        self.bits = max(12, (4 * len(items)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, -1, np.int32)
        self.fill(np.fromiter(items.keys(), np.int64, len(items)), np.fromiter(items.values(), np.int32, len(items)))

    def fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self._home(keys)
        while len(keys):
            free = self.key[at] == -1
            self.key[at[free]] = keys[free]  # of rivals for one place the last one stays
            won = self.key[at] == keys
            self.value[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (len(self.key) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where absent."""
        at = self._home(keys)
        got = self.key[at]
        out = np.where(got == keys, self.value[at], -1)
        open_ = np.flatnonzero((got != keys) & (got != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.key) - 1)
            got = self.key[at[open_]]
            same = got == keys[open_]
            out[open_[same]] = self.value[at[open_[same]]]
            open_ = open_[~same & (got != -1)]
        return out


class Automaton:
    """Compiled merges of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        letters = byte_alphabet()
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = {i: bytes(letters[c] for c in s) for s, i in self.vocab.items()}
        self.label |= {i: s.encode() for s, i in self.special.items()}
        self.top = max(self.label) + 1
        self.never = len(model["merges"])
        self.gadget: dict[int, int] = {}
        self.born = [-1] * self.top
        self.parts: list = [None] * self.top
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self._compile(k, left, right, made)
        self.arcs: dict[int, int] = {}
        # labels that a gadget path really makes: the others never occur as tokens
        self.trie: dict[int, int] = {}
        self.emit: list = [None]
        singles = {bytes([b]) for b in range(256)}
        for i in sorted(self.vocab.values(), key=lambda i: (self.born[i], i)):
            if self.parts[i] or self.label[i] in singles:
                self._add(i)
        self.next = Transitions(self.trie)
        self.token = np.array([-1 if e is None else e for e in self.emit], np.int64)
        self.table = Transitions()  # the arcs decided so far, for batched lookups
        self.presplit = ByteLevel(add_prefix_space=False, use_regex=True)
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.long_arcs: dict[int, bool] = {}
        self.coder = WordCoder(spec, self._words, self._whole, b"".join, len)

    def _compile(self, k: int, left: int, right: int, made: int) -> None:
        """Note the rank of merge k, which stands for its gadget: no states or arcs are built here,
        ``_clash`` compares ranks when an arc is asked for."""
        self.gadget[left * self.top + right] = k
        if self.parts[made] is None:
            self.parts[made] = (left, right)
            self.born[made] = k

    def _add(self, token: int) -> None:
        if self.parts[token] is not None and not self._made(token):
            return
        node = 0
        for byte in self.label[token]:
            at = node << 8 | byte
            if at not in self.trie:
                self.trie[at] = len(self.emit)
                self.emit.append(None)
            node = self.trie[at]
        self.emit[node] = token

    def _made(self, token: int) -> bool:
        left, right = self.parts[token]
        return self._clash(left, right, self.born[token]) is False

    def _edge(self, token: int, side: int):
        """(piece, merge that ended it) along the right (1) or left (0) edge of a token."""
        ended = self.never
        while True:
            yield token, ended
            if self.parts[token] is None:
                return
            ended = self.born[token]
            token = self.parts[token][side]

    def _clash(self, u: int, v: int, before: int) -> bool:
        """Does a gadget earlier than ``before`` act across the seam of u and v."""
        lefts = list(self._edge(v, 0))
        for a, a_ended in self._edge(u, 1):
            row = a * self.top
            for b, b_ended in lefts:
                k = self.gadget.get(row + b, self.never)
                # equal ranks: the pair further left goes first
                if k < before and k < a_ended and k <= b_ended:
                    return True
        return False

    def split(self, text: str) -> list[str]:
        """The words of a text, as the library's pre-splitter cuts them (Unicode versions differ
        between regular expression engines, so its own engine decides)."""
        return [text[a:b] for _, (a, b) in self.presplit.pre_tokenize_str(text)]

    def arc(self, u: int, v: int) -> bool:
        """Is there an arc v out of the state behind u."""
        return not self._clash(u, v, self.never)

    def _allowed(self, keys: np.ndarray) -> np.ndarray:
        """``arc`` for many (u, v) keys: undecided ones are added to the table."""
        out = self.table.find(keys)
        unknown = np.unique(keys[out < 0])
        if len(unknown):
            fresh = {k: int(self.arc(*divmod(k, self.top))) for k in unknown.tolist()}
            self.arcs |= fresh
            if len(self.arcs) > ARCS:
                self.arcs = fresh
            if 2 * len(self.arcs) > len(self.table.key) or self.arcs is fresh:
                self.table.build(self.arcs)
            else:
                self.table.fill(unknown, np.fromiter(fresh.values(), np.int32, len(fresh)))
            out = self.table.find(keys)
            if (out < 0).any():  # the table was just renewed
                out = np.array([int(self.arc(*divmod(k, self.top))) for k in keys.tolist()])
        return out > 0

    def encode_long(self, word: bytes) -> np.ndarray:
        """Tokens of one long word: the same walk, position by position, in time linear in its length."""
        n = len(word)
        last, came = array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)
        trie, emit, known, top = self.trie, self.emit, self.long_arcs, self.top
        for i in range(n):
            u = last[i]
            if i and u < 0:
                continue
            node = 0
            for j in range(i, n):
                node = trie.get(node << 8 | word[j])
                if node is None:
                    break
                v = emit[node]
                if v is None or last[j + 1] >= 0:
                    continue
                if i:
                    ok = known.get(u * top + v)
                    if ok is None:
                        if len(known) > ARCS:
                            known.clear()
                        ok = known[u * top + v] = self.arc(u, v)
                    if not ok:
                        continue
                last[j + 1], came[j + 1] = v, i
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at = came[at]
        return np.array(out[::-1], "<u4")

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Tokens of pre-split words: the accepted paths, found for all words together."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)])
        at = base[:-1] + np.arange(len(words))  # position 0 of each word among all positions
        last = np.full(len(data) + len(words), -1, np.int64)  # token that ends at a position
        came = np.zeros(len(last), np.int64)  # and the position where it starts, in its word
        alive = np.arange(len(words))
        for i in range(int(sizes.max())):
            alive = alive[sizes[alive] > i]
            w = alive if i == 0 else alive[last[at[alive] + i] >= 0]
            node = np.zeros(len(w), np.int64)
            for j in range(i, int(sizes[w].max(initial=0))):
                inside = sizes[w] > j
                w, node = w[inside], node[inside]
                node = self.next.find(node << 8 | data[base[w] + j]).astype(np.int64)
                w, node = w[node >= 0], node[node >= 0]
                if not len(w):
                    break
                token = self.token[node]
                ends = at[w] + j + 1
                some = np.flatnonzero((token >= 0) & (last[ends] < 0))
                if i and len(some):
                    some = some[self._allowed(last[at[w[some]] + i] * self.top + token[some])]
                last[ends[some]] = token[some]
                came[ends[some]] = i
        # follow every path back from its end, all words a token at a time
        tokens, owner, step = [], [], np.arange(len(words))
        where = sizes.copy()
        while len(step):
            tokens.append(last[at[step] + where[step]])
            owner.append(step)
            where[step] = came[at[step] + where[step]]
            step = step[where[step] > 0]
        turn = np.concatenate([np.full(len(o), -k) for k, o in enumerate(owner)])
        owner, tokens = np.concatenate(owner), np.concatenate(tokens).astype("<u4")
        order = np.lexsort((turn, owner))
        return np.split(tokens[order], np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])

    def _words(self, words: list[str]) -> list[bytes]:
        """Encodings of pre-split words, in groups of bounded size."""
        raw = [w.encode() for w in words]
        out = [b""] * len(raw)
        order = sorted(range(len(raw)), key=lambda k: len(raw[k]))
        group, held = [], 0
        for k in [*order, None]:
            long = k is not None and len(raw[k]) > LONG
            if group and (k is None or long or held + len(raw[k]) > 1 << 21):
                for g, e in zip(group, self.encode_words([raw[x] for x in group]), strict=True):
                    out[g] = e.tobytes()
                group, held = [], 0
            if long:
                out[k] = self.encode_long(raw[k]).tobytes()
            elif k is not None:
                group.append(k)
                held += len(raw[k])
        return out

    def _whole(self, units: list[str]) -> list[bytes]:
        """Encodings of units by the library's own pre-splitter; special tokens are split off first."""
        cut: list[list[str]] = []
        for unit in units:
            parts = self.apart.split(unit) if self.apart is not None else [unit]
            cut.append([w for p in parts for w in ([p] if p in self.special else self.split(p))])
        fresh = sorted({w for words in cut for w in words if w not in self.special})
        ids = dict(zip(fresh, self._words(fresh), strict=True)) | {w: i.to_bytes(4, "little") for w, i in self.special.items()}
        return [b"".join([ids[w] for w in words]) for words in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of texts as little-endian unsigned 32-bit integers."""
        return self.coder.encode(texts)

    def decode(self, ids: bytes) -> str:
        """The text of token ids, by emitting the labels of their arcs."""
        label = self.label
        return b"".join([label[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The compiled file, once per worker process."""
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(path)
    return _AUTOMATA[path]


def encode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) with ``ids`` (binary: little-endian unsigned 32-bit token ids) and
    ``n_tokens``. A null or empty text has no tokens; special strings inside a text are their
    special tokens; a text of any length is encoded whole. ``path`` must be readable on executors."""
    keep = [c for c in keep or docs.columns if c not in ("ids", "n_tokens")]

    def run(batches):
        machine = automaton(path)
        for batch in batches:
            for piece in pieces(batch):
                ids = machine.encode([t or "" for t in piece.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in keep] + [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                    names=keep + ["ids", "n_tokens"])

    schema = extended(docs.select(*keep), ids="binary", n_tokens="bigint")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids`` (null ids give a null text)."""
    def run(batches):
        machine = automaton(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if x is None else machine.decode(x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, extended(encoded, decoded="string"))


def round_trip(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one map, so a worker holds one automaton: the columns ``keep`` (all)
    with ``ids``, ``n_tokens`` and ``decoded``. A null text is an empty one."""
    made = ("ids", "n_tokens", "decoded")
    keep = [c for c in keep or docs.columns if c not in made]

    def run(batches):
        machine = automaton(path)
        for batch in batches:
            for piece in pieces(batch):
                ids = machine.encode([t or "" for t in piece.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in keep] + [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                                                       pa.array([machine.decode(x) for x in ids], pa.string())], names=[*keep, *made])

    schema = extended(docs.select(*keep), ids="binary", n_tokens="bigint", decoded="string")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
