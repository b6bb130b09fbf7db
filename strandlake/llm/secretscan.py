"""Secret scanning: fixed patterns, and the cost of guessing for values that stand where credentials do.

The cost of a value is the least, over all segmentations into spans, of the product of the spans' guesses: common words by
rank, dates, repeats, keyboard walks and sequences by their few parameters, anything else by brute force over the
characters in use. A value in a credential context that is dear to guess is a secret; "changeme" and "2024-01-01" are not.

Everything is a map over rows: no shuffle, and memory is that of a slice of texts.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Where credentials stand beyond the fixed patterns: other names, authorisation headers, and URLs with a user.
_CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth|credential|signature)s?["']?\x20*(?:[:=]|=>|\x20is\x20)\x20*["']?"""
    r"""|\bbearer\x20+|\bbasic\x20+|://[^\s:/@]+:)([^\s"'<>,;@]{8,})""",
    re.I | re.A,
)

#: Frequent words in passwords and prose, most frequent first; the rank is the number of guesses.
_WORDS = (
    "password the and admin user test welcome login letmein monkey dragon master qwerty iloveyou sunshine princess football secret shadow "
    "superman batman trustno hello freedom whatever michael jordan hunter killer pepper summer winter spring autumn love money change changeme "
    "example sample dummy placeholder default guest root server system database backup public private temp token access value your "
    "that with this from have they will would there their what about which when make like time just know take people into year good some could "
    "them other than then now look only come over think also back after work first well even want because these give most name none null true false "
    "required optional string number here insert redacted "
    # words and parts of words that stand behind the names of credentials in prose and code; short ones would be met in random values
    "self config settings setting environ getenv request response header headers param params args option options input output client service "
    "session cookie bearer basic auth authentication authorization authorized credential credentials signature signed verify verified verification "
    "encrypted encryption hash hashed management manager process object class method function return result error invalid valid missing incorrect "
    "correct expired never always should must cannot before after every through between without within during another something anything "
    "everything nothing someone people important necessary available possible impossible different difficult responsible "
    "understand understood information government development organization community international national university education "
    "department company business customer product project program problem question answer message email address phone account "
    "protect protected security secure safe stored store storage sent send share shared hidden kept known unknown easy hard strong weak long short "
    "simple complex length character characters letter letters digit digits symbol symbols minimum maximum least most written document file files folder path "
    "link https http index page docs documentation tutorial website online "
    "ation ition ments ment ness able ible ance ence ings ally tive ious ical ities less ship ward tional ative "
    "inter under over trans super counter micro multi semi anti auto hyper extra ultra consider stand represent respons "
    "establish experience knowledge accomplish communicat administrat recogni specific particular general special individual professional "
    "technolog psycholog philosoph biolog environment circumstance neighbor disappoint embarrass straight forward fortunate"
).split()
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {frozenset((a, b)) for row in _ROWS for a, b in zip(row, row[1:], strict=False)} | {frozenset((a, b)) for up, low in zip(_ROWS[1:], _ROWS[2:], strict=False) for a, b in zip(up, low, strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._])(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
#: Walks and sequences, up and down.
_NEAR = (lambda a, b: frozenset((a, b)) in _NEXT, lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(a) - ord(b) == 1)
_LEET = str.maketrans("@40315$7", "aaoeisst")
#: log10 of guesses from which a value is a secret.
DEAR = 12.0
#: The same for values of letters, or letters and symbols: words of prose and names in code cost more than DEAR by brute force.
DEAR_WORDS = 18.0


@dataclass(frozen=True)
class Words:
    """A dictionary by rank: the words above, then any others given, most frequent first."""

    ranks: dict[str, int]
    longest: int

    @classmethod
    def of(cls, others: Iterable[str] = ()) -> Words:
        ranks: dict[str, int] = {}
        for word in itertools.chain(_WORDS, others):
            ranks.setdefault(word, len(ranks) + 1)
        return cls(ranks, max(map(len, ranks)))

    @classmethod
    def of_vocabulary(cls, path: str, least: int = 4) -> Words:
        """With the words of a byte-level vocabulary given as ranks: tokens that are a space and letters, in the order of their ranks."""
        with open(path, "rb") as file:
            tokens = [base64.b64decode(token) for token, _ in sorted(map(bytes.split, file), key=lambda row: int(row[1]))]
        return cls.of(t[1:].decode().lower() for t in tokens if len(t) > least and t[:1] == b" " and t[1:].isalpha())


FEW_WORDS = Words.of()
_QUICK = re.compile(r"[:=]|bearer|basic|\x20is\x20", re.I | re.A)


def guess_cost(value: str, enough: float = math.inf, words: Words = FEW_WORDS) -> float:
    """log10 of the guesses of the cheapest segmentation; or a bound from below on it, once that reaches `enough`.

    The work grows with the length: where repeats, walks and sequences end is found once for all their places.
    """
    low, n = value.lower(), len(value)
    plain = low.translate(_LEET)
    classes = sum(size for has, size in ((r"[a-z]", 26), (r"[A-Z]", 26), (r"\d", 10), (r"[^a-zA-Z\d]", 33)) if re.search(has, value))
    per_char = math.log10(max(classes, 10))
    best = [0.0] + [math.inf] * n
    ends: dict[int, list[tuple[int, float]]] = {}
    for m in _DATE.finditer(value):
        ends.setdefault(m.start(), []).append((m.end(), 2.1 if m.end() - m.start() == 4 else 4.6))
    period_ends, chain_ends, furthest = [0] * 5, [0] * len(_NEAR), 0
    for i in range(n):
        if i % 16 == 15 and furthest - i <= 64:  # every segmentation goes on from one of these places
            if (bound := min(best[i : furthest + 1])) >= enough:
                return bound
        if best[i] == math.inf:
            continue
        best[i + 1] = min(best[i + 1], best[i] + per_char)
        furthest = max(furthest, i + 1)
        jumps = list(ends.get(i, ()))
        for j in range(i + 3, min(n, i + words.longest) + 1):
            if rank := words.ranks.get(plain[i:j]):
                cost = math.log10(rank) + 0.3 * (value[i:j] != low[i:j]) + 0.3 * (plain[i:j] != low[i:j])
                jumps.append((j, max(cost, 0.3)))
        for unit in (1, 2, 3, 4):  # a unit again and again
            j = max(period_ends[unit], i)
            if j == i:
                while j + unit < n and low[j] == low[j + unit]:
                    j += 1
                period_ends[unit] = j
            times = 1 + (j - i) // unit
            if times >= 3:
                jumps.append((i + times * unit, unit * per_char + math.log10(times)))
        for k, near in enumerate(_NEAR):
            j = max(chain_ends[k], i + 1)
            if j == i + 1:
                while j < n and near(low[j - 1], low[j]):
                    j += 1
                chain_ends[k] = j
            if j - i >= 3:
                jumps.append((j, math.log10(47) + 0.35 * (j - i)))
        for j, cost in jumps:
            best[j] = min(best[j], best[i] + cost)
            furthest = max(furthest, j)
    return best[n]


def find_spans(text: str, words: Words = FEW_WORDS) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret of a text, in code points, by start and kind. Texts without any: an empty list."""
    found: list[tuple[int, int, int]] = []
    credential = ":" in text or "=" in text
    if credential:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if credential or _QUICK.search(text):
        found.sort()
        starts, reach = [a for a, _, _ in found], list(accumulate((b for _, _, b in found), max))
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip(".)]}!?")
            # a fixed pattern may end within a value; its span stays, and the value's stands beside it
            before = bisect_right(starts, m.start(1))
            if before and m.start(1) + len(value) <= reach[before - 1]:
                continue
            dear = DEAR if re.search(r"\d", value) else DEAR_WORDS
            # a capital at the start of a word is no second alphabet
            priced = value.lower() if dear == DEAR_WORDS and value[1:].islower() else value
            if len(value) >= 8 and guess_cost(priced, dear, words) >= dear:
                found.append((m.start(1), 3, m.start(1) + len(value)))
    found.sort()
    return [(a, KINDS[k], b) for a, k, b in found]


def redact(text: str, spans: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, _, end in spans:
        if end > at:
            out += [text[at:start], mark] if start >= at else []
            at = max(at, end)
    return "".join([*out, text[at:]])


_COLUMNS = ("n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string", [pa.int64()] * 4 + [pa.string()] * 2)


def scan(docs: DataFrame, words: Words = FEW_WORDS) -> DataFrame:
    """doc_id, counts by kind, digest of the fixed patterns' spans and all spans, of every document.

    Null and empty texts have no spans (the digest is that of an empty string). Repeated rows are scanned one by one. Spans that
    start together are told in the order of KINDS. Empty table: empty result. Other columns, whatever their names, are not read.
    A text's memory is a few times its size, however long it and its values are.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                rows = []
                for value in batch.column(1)[a:b]:
                    spans = find_spans(value.as_py() or "", words)
                    told = [(k, f"{k}:{x}:{y}") for x, k, y in spans]
                    base = ",".join(x for k, x in told if k != "guess")
                    rows.append((*(sum(k == kind for k, _ in told) for kind in KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in told)))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(c, k) for c, k in zip(columns, _COLUMNS[1], strict=True))], names=names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, f"doc_id long, {_COLUMNS[0]}")


def redacted(docs: DataFrame, text: str = "text", words: Words = FEW_WORDS) -> DataFrame:
    """The input's rows and columns, every secret of the text column replaced by a mark. Null stays null; repeated rows stay."""
    at, names = docs.columns.index(text), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                clean = pa.array([None if (t := x.as_py()) is None else redact(t, find_spans(t, words)) for x in part.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([clean if i == at else c for i, c in enumerate(part.columns)], names=names)

    plain = docs.toDF(*names)
    return map_batches(plain, run, plain.schema).toDF(*docs.columns)
