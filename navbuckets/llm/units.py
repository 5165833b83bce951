"""Texts as words of the tokenizer, each encoded once while it is remembered.

Tokenizers that pre-split a text encode each of its words alike wherever it stands, so the encoding
of a text is that of its words in a row. Texts of ASCII and Latin letters are split here; the rest
falls into *units* (a run of white space with the non-space run behind it), which these tokenizers
also encode alike whatever stands around them, and odd units are left whole to the tokenizer.
Words are remembered in two generations of bounded size: when the young one is full it becomes the
old one, and what is used again moves back, so frequent words stay and the rest is forgotten.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

#: fixed value: Unicode white space
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: a text falls into such units whatever stands around them: before white space that follows a
#: non-space character every match of byte-level pre-splitting ends, and no match looks further back
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: rough bytes of a remembered unit beside its characters and its value (objects, table slot)
ENTRY = 200


class Memo:
    """Values of strings: ``learn`` gives those of unknown ones; at most about ``limit`` bytes a
    generation are kept (and one call's strings)."""

    def __init__(self, learn: Callable[[list[str]], list], limit: int = 64 << 20, weight: Callable = lambda value: 0):
        self.learn, self.limit, self.weight = learn, limit, weight
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def fill(self, gaps: list[tuple[list, int, str]]) -> None:
        """Put the values of strings that are not in the young generation into (list, place)."""
        if not gaps:
            return
        young, old, weight = self.young, self.old, self.weight
        new = {u for _, _, u in gaps}
        known = {u: old[u] for u in new if u in old}
        unknown = sorted(new.difference(known))
        known.update(zip(unknown, self.learn(unknown), strict=True))
        young.update(known)
        self.held += sum([ENTRY + len(u) + weight(v) for u, v in known.items()])
        for values, i, u in gaps:
            values[i] = known[u]
        if self.held > self.limit:
            self.old, self.young, self.held = young, {}, 0


#: fixed values: letters whose class, lower case and composed form no Unicode version differs in
LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ſ"
#: fixed values: the pre-splitting of the byte-level and of the word BPE files, for plain units
BYTE_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
LOWER_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+"
LOWER_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(rf"[ \n\t\r!-~{LETTERS}]*")
#: begins the key of a unit that is left whole (no word holds it)
WHOLE = "\x00"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands
    for itself, the other bytes take the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordCoder:
    """Encodes texts word by word.

    ``words(list of words) -> values`` and ``whole(list of units) -> values`` encode what is unknown;
    ``join`` puts the values of a text's parts together. A plain text or unit holds only ASCII and Latin
    letters, whose pre-splitting is the same in every regular expression engine; others, and those that
    may hold a special token, go to ``whole``.
    """

    def __init__(self, spec: dict, words: Callable, whole: Callable, join: Callable, weight: Callable):
        pre, special = spec.get("pre_tokenizer") or {}, [t["content"] for t in spec.get("added_tokens", [])]
        self.join = join
        self.lower = False
        self.split = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.split = re.compile(BYTE_WORDS)
        else:
            steps, norm = pre.get("pretokenizers") or [{}], (spec.get("normalizer") or {}).get("normalizers") or []
            known = [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"] and norm[1]["pattern"] == {"Regex": r"\s+"} and norm[1]["content"] == " "
            if known and steps[0].get("pattern") == {"Regex": LOWER_SPLIT} and steps[0]["invert"] and steps[0]["behavior"] == "Removed":
                self.split, self.lower = re.compile(LOWER_WORDS), True
        # what holds the first characters of a special token is left to ``whole``
        self.odd = re.compile("|".join(re.escape(c[:2]) for c in special)) if special else None

        def learn(keys: list[str]) -> list:
            cut = [k[1:] for k in keys if k[0] == WHOLE]
            values = iter(whole(cut) if cut else [])
            plain = iter(words([k for k in keys if k[0] != WHOLE]))
            return [next(values) if k[0] == WHOLE else next(plain) for k in keys]

        self.memo = Memo(learn, weight=weight)

    def plain(self, text: str) -> bool:
        return self.split is not None and PLAIN.fullmatch(text) is not None and not (self.odd and self.odd.search(text))

    def keys(self, text: str) -> list[str]:
        if self.plain(text):
            return self.split.findall(text.lower() if self.lower else text)
        out = []
        for unit in UNIT.findall(text):
            if self.plain(unit):
                out += self.split.findall(unit.lower() if self.lower else unit)
            else:
                out.append(WHOLE + unit)
        return out

    def encode(self, texts: list[str]) -> list:
        """Text by text, so that a text's words are looked up while they are in the processor's cache; those
        not remembered are learned together."""
        get, out, open_, gaps = self.memo.young.get, [], [], []
        for n, text in enumerate(texts):
            keys = self.keys(text)
            values = list(map(get, keys))
            if None in values:
                gaps += [(values, i, keys[i]) for i, v in enumerate(values) if v is None]
                open_.append(n)
                out.append(values)
            else:
                out.append(self.join(values))
        self.memo.fill(gaps)
        for n in open_:
            out[n] = self.join(out[n])
        return out


def library(path: str):
    """A tokenizers file without truncation and padding, single-threaded (Spark runs the tasks)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    if found.pre_tokenizer is None:
        raise ValueError("without a pre-tokenizer no boundary is proven stable")
    return found


def library_coder(path: str, count: bool = False) -> WordCoder:
    """Texts by the file's own library: ids as little-endian unsigned 32-bit integers, or their number."""
    lib = library(path)
    spec = json.loads(lib.to_str())
    model = lib.model
    letter = {b: c for c, b in byte_alphabet().items()}

    def stand_in(word: str) -> str:
        return word if word.isascii() and word.isalpha() else "".join([letter[b] for b in word.encode()])

    if count:
        def words(new: list[str]) -> list:
            return [len(model.tokenize(stand_in(w))) for w in new]

        def whole(units: list[str]) -> list:
            return [len(e) for e in lib.encode_batch_fast(units, add_special_tokens=False)]

        return WordCoder(spec, words, whole, sum, lambda n: 0)

    def words(new: list[str]) -> list:
        return [array("I", [k.id for k in model.tokenize(stand_in(w))]).tobytes() for w in new]

    def whole(units: list[str]) -> list:
        return [array("I", e.ids).tobytes() for e in lib.encode_batch_fast(units, add_special_tokens=False)]

    return WordCoder(spec, words, whole, b"".join, len)
