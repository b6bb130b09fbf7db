"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, intent, you, they, this, copula, negation, report, quotation mark, comma, clause end, line end. Five
transducers are composed in series, each rewriting what the one before puts out: reported speech and quotations, scopes of
negations, targets, insults, threats. The first three mark insults and threats; the insult transducer turns a marked insult into
the kind of clause it makes (addressed, predicate, vocative, mere mention, reported, negated), with a weight on the arc; the threat
transducer matches intent, threat and target. Product states are made when first reached. A clause is its best path, so that
clauses are scored and not words: an insult only mentioned does not make a text toxic unless labels say so. The weights of all
kinds are fitted to labels around a stated prior.

Which words insult is learned too: stems far more frequent in texts labelled toxic, as the insults of a corpus need not be those of
a word list.

At scale: stems are counted by a partial aggregation over a bounded sample of labelled rows (`TRAIN_ROWS`); scoring is a map over
whole texts, in which only texts with a stem or a threat are read word by word.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, map_batches, mix64, settle, slices, utf8, word_spans
from .quality import fold, train_rows

#: The labelled rows used for learning, at most (in expectation): a documented bound, sampled by a hash of the id.
TRAIN_ROWS = 16_000
#: A stem is the first letters of a word that goes on; so many.
STEM = range(3, 25)
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]|[,:]|[\"“”„«»]")
_WORD = re.compile(r"[^\W\d_]+")

# closed classes of words, fixed
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes".split())
THEY = frozenset("he she they him them his her their er sie ihn il elle ils lui él ella ellos su sus".split())
THIS = frozenset("this that these those diese dieser dieses ce cet cette ces este esta ese esa".split())
COPULA = frozenset("is are am was were be been being bist ist seid sind war bin es est êtes sont suis était eres son soy era".split())
NEGATION = frozenset("not no never nor neither without isn aren wasn don doesn didn won nicht kein keine keinen keiner nie niemals ohne pas jamais aucun aucune sans nunca jamás ni sin tampoco".split())
REPORT = frozenset("said says say called calls wrote writes quoted quotes reported claimed told shouted sagte sagt nannte nennt schrieb rief behauptete dit disait appelé appela écrit écrivait cria prétend dijo dice llamó escribió gritó afirmó".split())
INTENT = frozenset("will shall gonna going should must let werde werden wird soll sollte vais va allons devrait voy vas va debería".split())
THREAT = frozenset("kill murder shoot stab strangle hang burn destroy beat hurt töten umbringen erschießen verprügeln zerstören tuer frapper brûler détruire poignarder matar golpear quemar destruir apuñalar disparar".split())
#: Insults assumed where labels give no evidence.
SEED_WEIGHT = 5.0
SEED = frozenset("idiot moron imbecile bastard asshole scumbag".split())
SYMBOLS = (
    dict.fromkeys(COPULA, "C") | dict.fromkeys(THIS, "D") | dict.fromkeys(THEY, "P") | dict.fromkeys(YOU, "Y") | dict.fromkeys(REPORT, "R") | dict.fromkeys(INTENT, "W")
    | dict.fromkeys(THREAT, "H") | dict.fromkeys(NEGATION, "N") | dict.fromkeys(".!?;", "E") | {"\n": "B"} | dict.fromkeys('"“”„«»', "Q") | dict.fromkeys(",:", "K")
)

# --- transducers: state, symbol -> next state, symbol put out, weight of the arc -----------------------------------

#: Kinds of clauses by the weight of their arc: of several in one clause the heaviest is the clause's.
KINDS = {"addressed": 6.0, "predicate": 5.0, "vocative": 4.0, "mention": 3.0, "reported": 2.0, "negated": 1.0}
Arc = tuple[object, str, float]


def report(state: int, symbol: str) -> Arc:
    """What stands within twelve symbols after a verb of saying, in one clause, or within quotation marks of one line, is reported: mark r.

    -1 is within quotation marks. The end of a line is put out as that of a clause.
    """
    if symbol == "B":
        return 0, "E", 0.0
    if symbol == "Q":
        return (0 if state < 0 else -1), symbol, 0.0
    if symbol == "E":
        return min(0, state), symbol, 0.0
    if symbol == "R" and state >= 0:
        return 12, symbol, 0.0
    return (state if state < 0 else max(0, state - 1)), symbol + "r" * (symbol[0] in "IH" and state != 0), 0.0


def negation(state: int, symbol: str) -> Arc:
    """What stands within four symbols after a negation, in one clause, is negated: mark n."""
    if symbol in "EN":
        return (4 if symbol == "N" else 0), symbol, 0.0
    return max(0, state - 1), symbol + "n" * (symbol[0] in "IH" and state > 0), 0.0


def target(state: int, symbol: str) -> Arc:
    """An insult within five symbols after you or they, or right after this, has a target: mark t."""
    if symbol in "EYPD":
        return {"E": 0, "D": max(1, state - 1)}.get(symbol, 5), symbol, 0.0
    return max(0, state - 1), symbol + "t" * (symbol[0] == "I" and state > 0), 0.0


def insult(state: tuple[int, bool], symbol: str) -> Arc:
    """The kind of clause that an insult makes: by its marks, then a copula within three symbols before it, then an open place (the
    clause's beginning, or after a comma or colon)."""
    copula, opened = state
    if symbol[0] != "I":
        return (3 if symbol == "C" else 0 if symbol == "E" else max(0, copula - 1), symbol in "EK"), symbol, 0.0
    kind = "negated" if "n" in symbol else "reported" if "r" in symbol else "addressed" if "t" in symbol else "predicate" if copula else "vocative" if opened else "mention"
    return (max(0, copula - 1), False), "+" + kind, KINDS[kind]


def threat(state: tuple[str, int, str], symbol: str) -> Arc:
    """Intent, then within four symbols a threat, then within five you or they; a threat's marks make it reported or negated."""
    kind, left, marks = state
    if symbol in "EQ":
        return ("", 0, ""), symbol, 0.0
    if symbol == "W":
        return ("w", 4, ""), symbol, 0.0
    if symbol[0] == "H" and kind == "w":
        return ("h", 5, symbol[1:]), "O", 0.0
    if symbol in "YP" and kind == "h":
        out = "negated" if "n" in marks else "reported" if "r" in marks else "threat"
        return ("", 0, ""), "+" + out, KINDS.get(out, 7.0)
    return (kind, left - 1, marks) if left > 1 else ("", 0, ""), symbol, 0.0


class Grammar:
    """The composition, in series, of transducers (rule, first state). Product arcs are made when first reached, and kept up to a number."""

    KEPT = 50_000  # some 30 MB

    def __init__(self, *parts: tuple[Callable[[object, str], Arc], object]) -> None:
        self.rules = [rule for rule, _ in parts]
        self.start = tuple(first for _, first in parts)
        self.arcs: dict[tuple, tuple[tuple, str, float]] = {}

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str, float]:
        key = (state, symbol)
        if key not in self.arcs:
            after, weight = [], 0.0
            for rule, own in zip(self.rules, state, strict=True):
                own, symbol, more = rule(own, symbol)
                after.append(own)
                weight += more
            if len(self.arcs) >= self.KEPT:
                self.arcs.clear()
            self.arcs[key] = tuple(after), symbol, weight
        return self.arcs[key]

    def clauses(self, symbols: Iterable[tuple[str, float]]) -> list[tuple[str, float]]:
        """(kind, weight of the insult) of every matched clause: its heaviest path, by its arcs and then by its insult; and of every threat."""
        state, found, best = self.start, [], (0.0, 0.0, "")
        for symbol, given in itertools.chain(symbols, [("E", 0.0)]):
            state, out, weight = self.step(state, symbol)
            if out == "E":
                if best[2]:
                    found.append((best[2], best[1]))
                best = (0.0, 0.0, "")
            elif out == "+threat":
                found.append(("threat", 1.0))
            elif out[0] == "+":
                best = max(best, (weight, given or 1.0, out[1:]))
        return found


GRAMMAR = Grammar((report, 0), (negation, 0), (target, 0), (insult, (0, True)), (threat, ("", 0, "")))
#: Weights before anything is learned: bias, then for each kind of its heaviest clause and of the logarithm of its number of clauses.
PRIOR_OF = {"addressed": (0.6, 1.0), "predicate": (0.5, 0.8), "vocative": (0.45, 0.6), "mention": (0.2, 0.3), "reported": (0.1, 0.1), "negated": (0.05, 0.1), "threat": (2.5, 0.5)}
PRIOR = np.array([-3.0, *(w for pair in PRIOR_OF.values() for w in pair)])


def vector(found: list[tuple[str, float]]) -> list[float]:
    kinds: dict[str, list[float]] = {k: [] for k in PRIOR_OF}
    for kind, weight in found:
        kinds[kind].append(weight)
    return [1.0, *(x for weights in kinds.values() for x in (round(max(weights, default=0.0), 3), round(math.log1p(len(weights)), 3)))]


@dataclass
class Lexicon:
    """Insults with weights: entries `word$` are whole words, entries `stem+` are words that go on after the stem."""

    entries: dict[str, float]
    lengths: list[int] = field(init=False)
    heads: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        self.lengths = sorted({len(e) - 1 for e in self.entries if e[-1] == "+"}, reverse=True)
        self.heads = frozenset(e[:-1][:3] for e in self.entries)

    def insult(self, word: str) -> float:
        if (weight := self.entries.get(word + "$")) is not None:
            return weight
        return next((self.entries[e] for n in self.lengths if n < len(word) and (e := word[:n] + "+") in self.entries), 0.0)

    def symbol(self, word: str) -> tuple[str, float]:
        if word[:3] in self.heads and (weight := self.insult(word)):
            return "I", weight
        return SYMBOLS.get(word, "O"), 0.0

    def read(self, text: str) -> list[tuple[str, float]]:
        """The matched clauses of a text."""
        low = text.lower()
        words = set(_WORD.findall(low))  # a quick look before the grammar reads word by word
        if words.isdisjoint(THREAT) and not any(w[:3] in self.heads and self.insult(w) for w in words):
            return []
        return GRAMMAR.clauses(self.symbol(m[0]) for m in _TOKEN.finditer(low))


# --- learning ------------------------------------------------------------------------------------------------------


_ROLL = Roller(11)
_TRIES = 4


def _sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, most: int) -> DataFrame:
    """(_id, text, y) of the sampled labelled rows, without near copies: a word that only one family of copies uses is no evidence.

    A text goes if one of its `_TRIES` smallest four-word shingles, each by another hash, is also that of a text of smaller id.
    """
    rows = train_rows(labels, target, folds, held, most)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix64(np.arange(1, _TRIES + 1, dtype=np.uint64))
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, found = [], []
                for i, text in zip(batch.column(0)[a:b].to_pylist(), utf8(batch.column(1)[a:b]), strict=True):
                    raw = np.frombuffer(text, np.uint8)
                    s, e = word_spans(raw)
                    words = _ROLL.words(raw, s, e)
                    n = max(1, len(words) - 3)
                    if len(words):
                        shingles = _ROLL.spans(words, np.arange(n), np.minimum(np.arange(n) + 4, len(words)))
                        ids += [i] * _TRIES
                        found += [int(mix64(shingles ^ x).min().view(np.int64)) for x in salts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["_id", "k"])

    at = rows.select(F.col("_id").alias("_of"), "y")
    chosen = texts.join(F.broadcast(at), F.col("doc_id") == F.col("_of")).select("doc_id", "text")
    found = settle(map_batches(chosen, keys, "_id long, k long"))
    first = found.groupBy("k").agg(F.min("_id").alias("first"))
    copies = found.join(first, "k").where(F.col("first") < F.col("_id")).select("_id").distinct()
    rows = settle(rows.join(copies, "_id", "left_anti"))
    return texts.join(F.broadcast(rows), F.col("doc_id") == F.col("_id")).select("text", "y")


def stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, toxic, clean): in how many texts a word goes on after the stem (`stem+`, lengths of STEM), or is it (`stem$`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                counts[y < 0.5].update({w[:k] + "+" for w in words for k in range(STEM.start, min(STEM.stop, len(w)))} | {w + "$" for w in words})
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield _counted(*counts)
                    counts = (Counter(), Counter())
        yield _counted(*counts)

    return map_batches(sample, run, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _counted(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    stems = [*toxic, *(s for s in clean if s not in toxic)]
    return pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([toxic[s] for s in stems], pa.int64()), pa.array([clean[s] for s in stems], pa.int64())], names=["stem", "toxic", "clean"])


def choose_stems(rows: list[tuple[str, float, float]]) -> dict[str, float]:
    """(entry, evidence, weight) -> entries by evidence, the longest first among equals, none nested in one already chosen."""
    chosen: dict[str, float] = {}
    taken: set[str] = set()  # stems chosen, and all their beginnings
    for entry, _, weight in sorted(rows, key=lambda r: (-round(r[1], 6), -len(r[0]), r[0])):
        stem = entry[:-1]
        if stem + "+" in chosen or stem + "$" in chosen or not (stem in taken or any(stem[:k] + e in chosen for k in range(3, len(stem)) for e in "+$")):
            chosen[entry] = weight
            taken.update(stem[:k] for k in range(3, len(stem) + 1))
    return chosen


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Entries whose texts are toxic far beyond chance, by likelihood ratio; their weights are log odds. Bounded by the words of the sample."""
    seeds = {w + "$": SEED_WEIGHT for w in SEED}
    n_toxic, n = sample.agg(F.sum("y"), F.count(F.lit(1))).first()
    n_toxic, n = float(n_toxic or 0), float(n or 0)
    if not n_toxic or n_toxic == n:
        return seeds
    base = n_toxic / n
    counts = stem_counts(sample)
    t, c = F.col("toxic"), F.col("clean")
    ratio = 2 * (t * F.log(t / (t + c) / F.lit(base)) + F.when(c > 0, c * F.log(c / (t + c) / F.lit(1 - base))).otherwise(0.0))
    weight = F.log((t + 0.5) / F.lit(n_toxic + 1)) - F.log((c + 0.5) / F.lit(n - n_toxic + 1))
    # half of an entry's texts are toxic, and so high a ratio is chance for one entry in about a million
    good = counts.where((t >= 4) & (t >= c)).withColumn("g", ratio).where(F.col("g") >= 24.0)
    rows = good.select("stem", "g", weight.alias("w")).collect()
    return seeds | choose_stems([(r["stem"], r["g"], min(r["w"], 8.0)) for r in rows])


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps, ridge around the prior."""
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicModel:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([vector(self.lexicon.read(t)) for t in texts]).reshape(len(texts), len(PRIOR))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = 4, held: int = 2, most: int = TRAIN_ROWS) -> ToxicModel:
    sample = _sample(docs, labels, target, folds, held, most)
    lexicon = Lexicon(learn_stems(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found[(*vector(lexicon.read(text.as_py() or "")), y)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in found], pa.list_(pa.float64())), pa.array(list(found.values()), pa.int64())], names=["x", "n"])

    rows = map_batches(sample, run, "x array<double>, n long").groupBy("x").agg(F.sum("n").alias("n")).orderBy("x").collect()
    if not rows:
        return ToxicModel(lexicon, PRIOR.copy())
    x = np.array([r["x"] for r in rows])
    x = np.repeat(x, [r["n"] for r in rows], axis=0)  # at most the sample's rows
    return ToxicModel(lexicon, fit_weights(x[:, :-1], x[:, -1]))


def score(docs: DataFrame, model: ToxicModel, folds: int = 4, held: int = 2, cut: float = 0.3) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(model.score([t.as_py() or "" for t in batch.column(1)[a:b]]))], names=["doc_id", "score"])

    scored = map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts match no clause: their score is that of any text without one. Repeated rows get equal scores, and so do
    texts with equal clauses. Without labels, or with one class only, the stated seed words and prior weights hold. Empty table:
    empty result. Other columns, whatever their names, are not read. A long text takes a worker about 80 bytes of memory a byte if it
    holds an insult or a threat, and 20 if not.
    """
    return score(docs, train(docs, labels))
