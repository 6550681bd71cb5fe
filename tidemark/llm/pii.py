"""Operator 12: personal data by fixed rules and a semi-Markov conditional random field.

The rules find spans of four kinds (email, ip, card, phone), leftmost and
non-overlapping per kind. The field adds spans that the rules miss, such as
numbers without a plus sign, other separators or "name (at) host (dot) org":

1. Candidates are whole spans: runs of digit groups of bounded number and
   length, and stretches around something that stands for @. Their features
   tell of the whole span: its digits, Luhn's sum, the pattern of its groups,
   the separators, what stands before and behind.
2. Candidates that overlap make a lattice over the places where they begin and
   end. A path goes from place to place by a candidate with a kind or by
   leaving the stretch out; its score is the sum over its spans and over pairs
   of labels that follow each other. The best path chooses borders and kinds
   together. As a candidate is bounded, so is the work a place.
3. Weights maximise the likelihood of whole paths, less a penalty. They learn
   from windows of at most SAMPLE_DOCS documents by a hash of their text, at
   most WINDOWS a kind of window, labelled by the rules; from the same windows
   with the span written in another way; and from rendered ones, so small
   tables have all kinds too.

Spans of the field that overlap one of the rules are left out. Whole texts are
read; rules and candidates take time in proportion to the text. Null texts are
empty; rows are taken one by one, so repeats, ties and null ids stay; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Label of what is no span; it scores 0.
OUT = 4

SAMPLE_DOCS, WINDOWS, AROUND, RENDERED = 4000, 250, 40, 120
#: Digit groups and digits of a candidate, and characters on either side of what stands for @.
MOST_GROUPS, LEAST_DIGITS, MOST_DIGITS, MOST_SIDE = 7, 7, 19, 64
FEATURES, ROUNDS, STEP, PENALTY = 1 << 11, 60, 0.3, 0.02

# --- the rules ---

IP_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD_RUN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE_RUN = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DIGIT = re.compile("[0-9]")


class Span(NamedTuple):
    start: int
    end: int
    kind: int


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_emails(text: str) -> Iterator[Span]:
    """What the pattern `[A-Za-z0-9._%+-]+@host` matches, looked for from each @: its run begins after the match before, or after the last other character."""
    free, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > free and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
            low -= 1
        if low < at and (m := HOST.match(text, at + 1)):
            yield Span(low, m.end(), EMAIL)
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """The rules' spans in order of start, then kind."""
    found = list(base_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        found += [Span(*m.span(), IP) for m in IP_RUN.finditer(text) if all(map(octet, m[0].split(".")))]
        found += [Span(*m.span(), CARD) for m in CARD_RUN.finditer(text) if 12 <= m.end() - m.start() <= 38 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [Span(*m.span(), PHONE) for m in PHONE_RUN.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda s: (s.start, s.kind))


def spelt(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


# --- candidates and their features ---

#: Between two groups of digits of a candidate; a group that a letter touches is none of a candidate's.
SEPARATOR = r"[ \t\xa0  .\-‐-–/()\[\]·]{1,4}"
NUMBERS = re.compile(rf"[0-9]++(?:{SEPARATOR}[0-9]++)*+")
GROUP = re.compile(r"[0-9]+")
AT_MARK = re.compile(r"@|＠|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|(?<=\w) (?:at|@) (?=\w+ ?(?:dot|[\[({]dot[\])}]) ?\w)", re.I)
DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?| dot |[.．])"
LABEL = r"[\w-]{1,63}"
RIGHT = re.compile(rf"{LABEL}(?:{DOT}{LABEL}){{1,5}}", re.I)
NEXT_DOT = re.compile(DOT, re.I)
LEFT_CHAR = frozenset("._%+-'")


class Candidate(NamedTuple):
    """A span, the kinds that it can have, and its features as indices below FEATURES."""

    start: int
    end: int
    kinds: tuple[int, ...]
    features: tuple[int, ...]


def hashed(name: str) -> int:
    """A feature's index; that of a given name is the same in every run."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest()) % FEATURES


_indices: dict[str, int] = {}


def index(name: str) -> int:
    if (k := _indices.get(name)) is None:
        if len(_indices) > 100_000:
            _indices.clear()
        k = _indices[name] = hashed(name)
    return k


def kind_of_char(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "0" if "0" <= c <= "9" else "a" if c.isalpha() else "_" if c.isspace() else "," if c in ",.;:!?)]}\"'»”’" else c if c.isascii() else "other"


def number_features(text: str, start: int, end: int, groups: list[re.Match], low: int, high: int) -> tuple[int, ...]:
    """Of the groups low .. high - 1 of a run; start may take in a plus sign or bracket before them."""
    own = [g[0] for g in groups[low:high]]
    between = [text[a.end() : b.start()] for a, b in zip(groups[low : high - 1], groups[low + 1 : high], strict=True)]
    d, sizes = "".join(own), [len(g) for g in own]
    dotted = len(own) == 4 and all(b.strip(" []()") == "." for b in between)
    shape = "-".join(str(min(s, 9)) for s in sizes[:8])
    seps = "".join(sorted({c if c.isascii() else "u" for b in between for c in b.replace("\xa0", " ")}))
    names = [
        "number", f"n={min(len(d), 20)}", f"luhn={luhn(d)}", f"n={min(len(d), 20)} luhn={luhn(d)}" if len(d) >= 12 else "short", f"groups={min(len(own), 9)}", f"shape={shape}", f"seps={seps}", f"doubled={any(b in ('  ', '--', '..') for b in between)}",
        f"octets={dotted and all(map(octet, own))} {dotted}", f"first={text[start] if text[start] in '+(' else d[:2] if d[:2] == '00' else d[0] if d[0] == '0' else '1'}", f"last={min(sizes[-1], 9)}",
        f"before={kind_of_char(text, start - 1)}", f"behind={kind_of_char(text, end)}", f"more left={low > 0}", f"more right={high < len(groups)}", f"even={len(set(sizes[:-1])) <= 1} {len(own) > 1}",
        f"lead={text[start] in '+('} groups={len(own) > 2} n={9 <= len(d) <= 15}", f"day={len(own) >= 3 and (sizes[0] == 4 and sizes[1:3] == [2, 2] or sizes[:3] == [2, 2, 4])}",
    ]
    return tuple(index(n) for n in names)


def number_candidates(text: str) -> Iterator[Candidate]:
    for run in NUMBERS.finditer(text):
        if run.end() - run.start() < LEAST_DIGITS:
            continue
        groups = list(GROUP.finditer(text, run.start(), run.end()))
        for low, first in enumerate(groups):
            at = first.start()
            if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
                continue
            start = at - 2 if text[max(0, at - 2) : at] in ("+(", "(+") else at - 1 if text[at - 1 : at] in ("+", "(") and at else at
            n = 0
            for high in range(low + 1, min(len(groups), low + MOST_GROUPS) + 1):
                n += len(groups[high - 1][0])
                if n > MOST_DIGITS:
                    break
                end = groups[high - 1].end()
                if n < LEAST_DIGITS and high - low != 4 or n < 4 or text[end : end + 1].isalpha() or text[end : end + 1] == "_":
                    continue
                kinds = ((IP,) if high - low == 4 and n <= 12 else ()) + ((CARD,) if n >= 12 else ()) + ((PHONE,) if 7 <= n <= 15 else ())
                if kinds:
                    yield Candidate(start, end, kinds, number_features(text, start, end, groups, low, high))


def email_candidates(text: str) -> Iterator[Candidate]:
    for mark in AT_MARK.finditer(text):
        low = mark.start()
        while low > max(0, mark.start() - MOST_SIDE) and (text[low - 1].isalnum() or text[low - 1] in LEFT_CHAR):
            low -= 1
        host = RIGHT.match(text, mark.end(), mark.end() + 4 * MOST_SIDE)
        if low == mark.start() or host is None:
            continue
        dots = list(NEXT_DOT.finditer(text, host.start(), host.end()))
        ends = sorted({*(d.start() for d in dots[1:]), host.end()})
        trimmed = low
        while trimmed < mark.start() and text[trimmed] in LEFT_CHAR:
            trimmed += 1
        for start in sorted({low, trimmed} - {mark.start()}):
            for end in ends:
                own = [d for d in dots if d.end() <= end]
                tld = text[own[-1].end() : end]
                names = [
                    "mail", f"mark={mark[0].strip().lower()}", f"dots={len(own)}", f"dot={','.join(sorted({d[0].strip().lower() for d in own}))}", f"tld={min(len(tld), 7)} {tld.isalpha()}", f"plain={text[start:end].isascii()}",
                    f"local={min(mark.start() - start, 9)}", f"named={any(c.isalpha() for c in text[start : mark.start()])}", f"edge={text[start] in LEFT_CHAR}", f"before={kind_of_char(text, start - 1)}", f"behind={kind_of_char(text, end)}", f"more={end < host.end()}",
                    f"lower={tld.islower()} more={end < host.end()}",
                ]
                yield Candidate(start, end, (EMAIL,), tuple(index(f"mail {n}") for n in names))


def candidates(text: str) -> list[Candidate]:
    found = list(number_candidates(text)) if DIGIT.search(text) else []
    if AT_MARK.search(text):
        found += email_candidates(text)
    return sorted(found)


def lattices(found: list[Candidate]) -> Iterator[list[Candidate]]:
    """Candidates in stretches that no candidate crosses."""
    own: list[Candidate] = []
    end = 0
    for c in found:
        if own and c.start >= end:
            yield own
            own = []
        own.append(c)
        end = max(end, c.end) if len(own) > 1 else c.end
    if own:
        yield own


# --- the field ---


class Lattice(NamedTuple):
    """n places; arcs (from, to, kind, row) in order of `to`; features of the rows."""

    n: int
    arcs: list[tuple[int, int, int, int]]
    features: np.ndarray


def lattice(own: list[Candidate]) -> Lattice:
    places = sorted({c.start for c in own} | {c.end for c in own})
    at = {p: k for k, p in enumerate(places)}
    arcs = sorted(((at[c.start], at[c.end], kind, k) for k, c in enumerate(own) for kind in c.kinds), key=lambda a: a[1])
    width = max(len(c.features) for c in own)
    return Lattice(len(places), arcs, np.array([(*c.features, *[FEATURES] * (width - len(c.features))) for c in own]))


class Field(NamedTuple):
    """weights: FEATURES + 1 rows (the last is 0) by kind; follows: label before by label behind."""

    weights: np.ndarray
    follows: np.ndarray

    def scores(self, x: Lattice) -> list[float]:
        """Of each arc."""
        some = max(1, -(-len(x.features) // 4096))
        every = np.concatenate([self.weights[part].sum(axis=1) for part in np.array_split(x.features, some)])
        return every[[a[3] for a in x.arcs], [a[2] for a in x.arcs]].tolist()

    def forward(self, x: Lattice, scores: list[float], best: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """alpha[place, label of what ends there]: the log of the sum over paths, or the score of the best of them with the place and label it came from."""
        alpha, back = np.full((x.n, 5), -np.inf), np.zeros((x.n, 5, 2), np.int32)
        alpha[0, OUT] = 0
        k = 0
        for place in range(1, x.n):
            ways = [(place - 1, OUT, 0.0)]
            while k < len(x.arcs) and x.arcs[k][1] == place:
                ways.append((x.arcs[k][0], x.arcs[k][2], scores[k]))
                k += 1
            for start, label, score in ways:
                into = alpha[start] + self.follows[:, label] + score
                if not best:
                    m = into.max()
                    if m > -np.inf:
                        alpha[place, label] = np.logaddexp(alpha[place, label], m + np.log(np.exp(into - m).sum()))
                elif into.max() > alpha[place, label]:
                    alpha[place, label] = into.max()
                    back[place, label] = start, int(into.argmax())
        return alpha, back

    def best(self, own: list[Candidate]) -> list[Span]:
        """The spans of the best path."""
        x = lattice(own)
        alpha, back = self.forward(x, self.scores(x), best=True)
        places = sorted({c.start for c in own} | {c.end for c in own})
        at, label, found = x.n - 1, int(alpha[-1].argmax()), []
        while at:
            start, before = back[at, label].tolist()
            if label != OUT:
                found.append(Span(places[start], places[at], label))
            at, label = start, before
        return found[::-1]

    def likelihood(self, x: Lattice, gold: list[tuple[int, int, int]], into: Field | None = None, times: float = 1) -> float:
        """Log-likelihood of the path of these arcs (from, to, kind); its gradient times `times` is added to `into`."""
        scores = self.scores(x)
        alpha, _ = self.forward(x, scores)
        beta = np.full((x.n, 5), -np.inf)
        beta[-1] = 0
        by_start: dict[int, list[int]] = {}
        for k, (start, *_) in enumerate(x.arcs):
            by_start.setdefault(start, []).append(k)
        for place in range(x.n - 2, -1, -1):
            out = self.follows[:, OUT] + beta[place + 1, OUT]
            for k in by_start.get(place, ()):
                _, end, kind, _ = x.arcs[k]
                out = np.logaddexp(out, self.follows[:, kind] + scores[k] + beta[end, kind])
            beta[place] = out
        m = alpha[-1].max()
        total = m + np.log(np.exp(alpha[-1] - m).sum())
        wanted = {(s, e): kind for s, e, kind in gold}
        inside = {p for s, e, _ in gold for p in range(s, e)}
        score, label, place = 0.0, OUT, 0
        path: list[tuple[int, int]] = []
        rows = {(s, e, kind): (k, row) for k, (s, e, kind, row) in enumerate(x.arcs)}
        ends = {s: (e, kind) for (s, e), kind in wanted.items()}
        while place < x.n - 1:
            if place in ends:
                end, kind = ends[place]
                k, row = rows[place, end, kind]
                score += scores[k] + self.follows[label, kind]
                if into is not None:
                    np.add.at(into.weights[:, kind], x.features[row], times)
                path.append((label, kind))
                place, label = end, kind
            else:
                assert place not in inside
                score += self.follows[label, OUT]
                path.append((label, OUT))
                place, label = place + 1, OUT
        if into is not None:
            for before, behind in path:
                into.follows[before, behind] += times
            for k, (start, end, kind, row) in enumerate(x.arcs):
                by = np.exp(alpha[start] + self.follows[:, kind] + scores[k] + beta[end, kind] - total)
                into.follows[:, kind] -= times * by
                np.add.at(into.weights[:, kind], x.features[row], -times * by.sum())
            for place in range(x.n - 1):
                into.follows[:, OUT] -= times * np.exp(alpha[place] + self.follows[:, OUT] + beta[place + 1, OUT] - total)
        return score - total


def fit(examples: list[tuple[str, list[Span]]], rounds: int = ROUNDS) -> Field:
    """Weights of greatest likelihood less PENALTY times their squares, by Adam over all examples; the same for the same examples in any order."""
    often: dict[tuple, list] = {}
    for text, spans in examples:
        for own in lattices(candidates(text)):
            x = lattice(own)
            places = sorted({c.start for c in own} | {c.end for c in own})
            at = {p: k for k, p in enumerate(places)}
            arcs = {a[:3] for a in x.arcs}
            gold = sorted((at[s.start], at[s.end], s.kind) for s in spans if s.start in at and s.end in at)
            gold = [g for g in gold if g in arcs]
            if any(a[1] > b[0] for a, b in zip(gold, gold[1:], strict=False)):
                continue
            seen = often.setdefault((x.n, tuple(x.arcs), x.features.tobytes(), tuple(gold)), [x, gold, 0])
            seen[2] += 1
    told = [often[k] for k in sorted(often)]
    field = Field(np.zeros((FEATURES + 1, 4)), np.zeros((5, 5)))
    first, second = ([np.zeros_like(w) for w in field] for _ in range(2))
    whole = sum(np.sqrt(n) for _, _, n in told) or 1
    for k in range(1, rounds + 1):
        slope = Field(np.zeros_like(field.weights), np.zeros_like(field.follows))
        for x, gold, n in told:
            field.likelihood(x, gold, slope, np.sqrt(n))
        for w, g, m, v in zip(field, slope, first, second, strict=True):
            g = g / whole * 30 - PENALTY * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        field.weights[FEATURES] = 0
    return field


# --- what it learns from ---


def digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def card_digits(rng: random.Random, n: int, right: bool = True) -> str:
    body = rng.choice("3456") + digits(rng, n - 2)
    return next(body + d for d in rng.sample("0123456789", 10) if luhn(body + d) == right)


def rendered(kind: int, rng: random.Random) -> str:
    """A span of a kind, as people write it."""
    if kind == EMAIL:
        name = "".join(rng.choices("abcdefghijklmnoprstuvwyéü", weights=[9] * 23 + [1, 1], k=rng.randint(2, 9))) + rng.choice(["", f".{digits(rng, 2)}", f"_{digits(rng, 1)}", ".x"])
        at = rng.choice(["@", "@", " (at) ", "(at)", " [at] ", "[at]", " at ", "＠"])
        dot = rng.choice([".", ".", " (dot) ", "[dot]", " dot "] if at not in ("@", "＠") else [".", ".", "[.]"])
        dot = " dot " if at == " at " else dot
        host = ["".join(rng.choices("abcdefghijklmnoprstuvwy0123", k=rng.randint(2, 8))) for _ in range(rng.choice([1, 1, 2]))]
        return name + at + dot.join([*host, rng.choice(["com", "org", "net", "de", "fr", "es", "info"])])
    if kind == IP:
        dot = rng.choice([".", ".", "[.]", " . ", "(.)"])
        return dot.join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == CARD:
        n = rng.choice([16, 16, 16, 15, 14, 13, 19])
        d, sep = card_digits(rng, n), rng.choice(["", " ", "-", ".", "  ", "/", " - ", "\xa0"])
        sizes = [4, 6, 5] if n == 15 else [4] * 4 + [3] if n == 19 else [4] * 4
        parts, at = [], 0
        for s in sizes:
            parts.append(d[at : at + s])
            at += s
        return sep.join(p for p in parts if p)
    sep, area, last = rng.choice(["-", " ", ".", "/"]), digits(rng, 3), digits(rng, 4)
    local = rng.choice([f"({area}) {digits(rng, 3)}{sep}{last}", f"({area}) {digits(rng, 3)}-{last}", f"{area}{sep}{digits(rng, 3)}{sep}{last}", f"0{digits(rng, 2)}{sep}{digits(rng, 4)}{sep}{last}", f"0{digits(rng, 3)} {digits(rng, 3)} {digits(rng, 3)}"])
    return rng.choice(["", "", "+1 ", "+49 ", "001 ", "0033 ", "(+34) "]) + local


def decoy(rng: random.Random) -> str:
    """Numbers and marks that are no personal data."""
    year, month, day = str(rng.randint(1980, 2030)), f"{rng.randint(1, 12):02}", f"{rng.randint(1, 28):02}"
    return rng.choice(
        [
            card_digits(rng, rng.choice([13, 14, 15, 16, 16, 16, 19]), right=False), rng.choice([" ", "-", "."]).join(re.findall("....", card_digits(rng, 16, right=False))), f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{day}/{month}/{year}",
            digits(rng, rng.randint(7, 12)), f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{digits(rng, 3)}.{digits(rng, 1)}", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}", f"1.{digits(rng, 3)}.{digits(rng, 3)}.{digits(rng, 3)},00",
            f"{rng.randint(1, 999)} {digits(rng, 3)} {digits(rng, 3)}", f"{year} {rng.randint(1980, 2030)} {rng.randint(1980, 2030)} {rng.randint(1980, 2030)}", f"978-{digits(rng, 1)}-{digits(rng, 4)}-{digits(rng, 4)}-{digits(rng, 1)}", f"@{rng.choice(['user', 'all', 'news'])}",
            f"{year}-{month}-{day} {digits(rng, 2)}:{digits(rng, 2)}", f"{digits(rng, 2)} . {digits(rng, 3)} . {digits(rng, 2)}", "we met at noon", f"{rng.randint(1, 99)} {rng.randint(1, 99)} {rng.randint(1, 99)} {rng.randint(1, 99)} {rng.randint(1, 99)}", f"v{rng.randint(1, 9)}.{digits(rng, 1)}.{digits(rng, 1)}.{digits(rng, 1)}",
        ]
    )


AROUND_WORDS = ("the", "call", "of", "mail", "to", "no.", "card:", "from", "und", "la", "order", "ref", "tel.", "(see", "and,", "=", '"', "")


def placed(inner: str, kind: int | None, rng: random.Random) -> tuple[str, list[Span]]:
    """The inner text among words, with its span."""
    left, right = (" ".join(rng.choices(AROUND_WORDS, k=rng.randint(0, 3))) for _ in range(2))
    left, right = left + " " * bool(left), rng.choice(["", "", ".", ",", ")", ";"]) + " " * bool(right) + right
    return left + inner + right, [] if kind is None else [Span(len(left), len(left) + len(inner), kind)]


def rendered_examples(seed: int, n: int) -> list[tuple[str, list[Span]]]:
    """n of each kind and 4 n decoys; a card's digits are right by Luhn, and what the rules hold for a card or address is one."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        out += [placed(rendered(kind, rng), kind, rng) for kind in range(4)]
        for text in (decoy(rng) for _ in range(4)):
            if not base_spans(text):
                out.append(placed(text, None, rng))
    return out


def rewritten(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """The same text with its spans written anew."""
    out, found, at = [], [], 0
    for s in spans:
        if s.start < at:
            continue
        out += [text[at : s.start], rendered(s.kind, rng)]
        end = sum(map(len, out))
        found.append(Span(end - len(out[-1]), end, s.kind))
        at = s.end
    return "".join([*out, text[at:]]), found


def windows(text: str) -> Iterator[tuple[str, int]]:
    """Stretches of a text around candidates, and the kind of the first of the rules' spans there or OUT."""
    spans, k = base_spans(text), 0
    for own in lattices(candidates(text)):
        low, high = own[0].start, max(c.end for c in own)
        while k < len(spans) and spans[k].end <= low:
            k += 1
        kind = spans[k].kind if k < len(spans) and spans[k].start < high else OUT
        yield text[max(0, low - AROUND) : high + AROUND], kind


def learnt(docs: DataFrame) -> Field:
    """The field of a table: see the module's head. At most 5 * WINDOWS short stretches reach the driver."""
    n = docs.count()
    few = docs.select("text").where(F.col("text").isNotNull())
    if n > SAMPLE_DOCS:
        few = few.where(F.pmod(F.xxhash64("text"), F.lit(n)) < SAMPLE_DOCS)
    schema = pa.schema([("window", pa.string()), ("kind", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for text in batch.column("text"):
                yield from (w for w in windows(text.as_py()) if len(w[0]) <= 8 * AROUND)

    found = few.transform(common.map_batches, lambda b: common.rows_to_batches(cut(b), schema), "window string, kind int").distinct()
    order = Window.partitionBy("kind").orderBy(F.xxhash64("window"), "window")
    picked = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= WINDOWS).orderBy("kind", "k").select("window").collect()
    rng, examples = random.Random(12), rendered_examples(1, RENDERED)
    for r in picked:
        spans = base_spans(r.window)
        # two rules for one place, as of a card's digits within a phone's: the first
        apart = [s for k, s in enumerate(spans) if all(s.start >= b.end for b in spans[:k])]  # a window is short
        examples.append((r.window, apart))
        if apart:
            examples.append(rewritten(r.window, apart, rng))
    return fit(examples)


# --- the operator ---


class Taken:
    """What spans cover, as stretches in order."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts, self.ends = [], []
        for s in sorted(spans):
            if self.ends and s.start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], s.end)
            else:
                self.starts.append(s.start)
                self.ends.append(s.end)

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end


def added(text: str, spans: list[Span], field: Field) -> list[Span]:
    """The field's spans that overlap none of the rules'."""
    taken, found = Taken(spans), []
    for own in lattices(candidates(text)):
        if not all(taken.meets(c.start, c.end) for c in own):
            found += [s for s in field.best(own) if not taken.meets(s.start, s.end)]
    return found


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the rules), base_sha256, spans (all) and n_added of every document, in place."""
    field = field or learnt(docs)
    sent = docs.sparkSession.sparkContext.broadcast((field.weights, field.follows))
    counts = [f"n_{k}" for k in KINDS]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in counts), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = Field(*sent.value)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                spans = base_spans(text)
                more = added(text, spans, own)
                kinds = [s.kind for s in spans]
                yield doc_id, *(kinds.count(k) for k in range(4)), hashlib.sha256(spelt(spans).encode()).hexdigest(), spelt(sorted([*spans, *more], key=lambda s: (s.start, s.kind))), len(more)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(common.map_batches, lambda b: common.rows_to_batches(rows(b), schema, 1024), "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string, n_added long")
