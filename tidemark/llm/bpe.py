"""Byte-level BPE ids of whole texts, with the merges of the tokenizers library.

A text is first split at the tokenizer's added tokens, which have ids of
their own. What lies between them is split where the tokenizer's own pattern
always splits it (before a blank that precedes a word, and around other white
space), each distinct piece is merged once by the library's BPE model and its
ids are remembered. The memory has a fixed number of short pieces; longer ones
are merged where they stand. So a task's size doesn't depend on its vocabulary
nor on how its texts are written.
"""

from __future__ import annotations

import os
import re
from array import array

import regex

from tidemark.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The white space of the tokenizer's pattern, and that pattern.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A unit is remembered if it has at most four times so many bytes.
REMEMBERED = 16
#: Words that an encoder remembers, in each of two ages: some 250 bytes each.
LIMIT = 500_000
#: Marks that end a word: one of them behind letters is a part of its own.
ENDS = frozenset(".,;:!?)]\"'")
UNITS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next unused one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Memory(dict):
    """Ids of units as little-endian unsigned 32-bit integers; when full it becomes the elder memory, whose units come back when asked for. Long units aren't kept."""

    def __init__(self, ids_of, limit: int) -> None:
        self.ids_of, self.limit, self.elder = ids_of, limit, {}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.limit:
            self.elder = dict(self)
            self.clear()
        if len(unit) > REMEMBERED and len(unit.encode()) > 4 * REMEMBERED:
            return self.ids_of(unit)
        out = self.elder.get(unit)
        if out is None:
            out = self.ids_of(unit)
        self[unit] = out
        return out


class Encoder:
    """encode(text) gives all ids of a text as bytes, `<u4`: those of the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, limit: int = LIMIT) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {t: array("I", [k]).tobytes() for t, k in added.items()}
        # the longest of those that begin at a place is taken
        self.at_added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.merges, self.split = self.tokenizer.model.tokenize, regex.compile(PATTERN).findall
        self.letters = dict(enumerate(byte_letters()))
        self.blank = self.letters[ord(" ")]
        self.units = Memory(self.unit, limit // 5)
        self.words = Memory(self.word, limit)

    def merged(self, part: str) -> bytes:
        """The ids of one part of the tokenizer's pattern."""
        letters = part.replace(" ", self.blank) if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merges(letters)]).tobytes()

    def unit(self, unit: str) -> bytes:
        return b"".join(map(self.merged, self.split(unit)))

    def word(self, word: str) -> bytes:
        """What follows a blank up to the next; a line end stands for itself, without a blank."""
        if word.isalpha():
            letters = self.blank + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
            return array("I", [t.id for t in self.merges(letters)]).tobytes()
        if word[:1] == "\n":
            return self.units["\n"] + self.units[word[1:]]
        if word[-1] in ENDS and word[:-1].isalpha():
            return self.words[word[:-1]] + self.units[word[-1]]
        first, *rest = self.split(" " + word)
        return (self.words[first[1:]] if first[1:].isalpha() else self.units[first]) + b"".join([self.units[p] for p in rest])

    def encode(self, text: str) -> bytes:
        if not self.at_added.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.at_added.finditer(text):
            out += [self.plain(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if not text:
            return b""
        flat = text.replace("\n", " ")
        # what can be printed has no white space but blanks
        single = "  " not in flat and flat[0] != " " != flat[-1] if flat.isprintable() else text.split() == flat.split(" ")
        if not single:  # other white space than single blanks and line ends inside
            return b"".join(map(self.units.__getitem__, UNITS.findall(text)))
        first, *words = text.replace("\n", " \n").split(" ")
        return self.units[first] + b"".join(map(self.words.__getitem__, words))


def encoder(path: str, limit: int = LIMIT) -> Encoder:
    """One encoder for each Python worker; its memory lasts over tasks."""
    return common.lasting(("bpe", path, limit), lambda: Encoder(path, limit))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
