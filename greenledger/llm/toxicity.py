"""Toxicity by a weighted lexicon with exception phrases.

Texts are folded first: compatibility forms and zero-width characters go, letters of other scripts that look Latin become
Latin, digits and signs that stand for letters inside a word become those letters, single letters set apart by dots or dashes
are joined, and everything is lower-cased. What is left are words with one space between them. An Aho-Corasick automaton finds the
lexicon's whole words, stems (beginnings of words) and exception phrases in one pass. A word counts once, by its longest
entry, and not at all inside an exception phrase.

A document's features are the sum of its weights, that sum normalised by its length, and the number of different words
that hit; a logistic function of their logarithms is the score. ``predicted`` is 1 from 0.5 on.

Learning. Labels are reduced to one row per document (toxic if any row says so) and sampled by hash, at most about
``sample`` of each kind; this sample is broadcast, so documents are read where they lie. The
tasks count, by label, the sampled documents that hold each word and each stem; an entry needs ``support`` toxic ones and
the lower bound of its log odds above ``least``. A longer entry stays only if its odds are better than those
of its stem, and a stem only if no single longer entry stands for nine tenths of it. Phrases of an entry and the word before or after it, seen in at least ``support`` clean documents and no oftener toxic
than clean, become exceptions; ``exceptions`` adds given ones. Counts are joined and filtered by Spark; the driver receives the lexicon, which
``support`` bounds, and the three features of the sampled documents, on which the logistic function is fitted.

Nulls: a null text is empty; an empty text scores what no hit means. A null id is the largest and never labelled. Repeated rows of documents are
each scored and each learned from. Without labels of both kinds nothing is learned: every score is 0. Clashing
columns: only ``id_col`` and ``text_col`` of documents and the three label columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from greenledger.llm import common as C
from greenledger.session import written

SAMPLE = 8000
STEM = (4, 12)
FLUSH = 500_000

# Letters of other scripts, and signs, by the Latin letters they are mistaken for.
LOOKALIKES = {
    "a": "аαᴀ", "b": "вьβ", "c": "сϲᴄ", "d": "ԁ", "e": "еєεℯ", "g": "ɡ", "h": "һнη", "i": "іιıɩ", "j": "јϳ", "k": "кκ", "l": "ӏⅼ", "m": "мᴍ", "n": "пɴν",
    "o": "оοσօ", "p": "рρ", "q": "ԛ", "r": "гʀ", "s": "ѕꜱ", "t": "тτ", "u": "υսц", "v": "ѵ", "w": "ѡωԝш", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t"}

TO_LATIN = {ord(c): letter for letter, like in LOOKALIKES.items() for c in like}
INVISIBLE = dict.fromkeys([0x00AD, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x2060, 0x2065)])
SIGN = re.compile(r"[0-9](?=[0-9@$!|€+]*[a-z])|(?<=[a-z])[0-9]|[@$!|€+](?=[0-9@$!|€+]*[a-z])")
BETWEEN = re.compile(r"[.\-_*·]\w[.\-_*·]")
APART = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-_*·][^\W\d_]){2,}(?![^\W_])")
WORD = re.compile(r"[^\W_]+")
HAS_LATIN = re.compile(r"[a-z]")
HIDDEN = re.compile("[" + "".join(map(chr, INVISIBLE)) + "]")
ALIKE = re.compile("[" + "".join(LOOKALIKES.values()) + "]")


def _latin(match: re.Match) -> str:
    """A word with Latin letters in it has its look-alikes folded; a word all in another script stays."""
    word = match.group()
    return word.translate(TO_LATIN) if HAS_LATIN.search(word) else word


def _sign(match: re.Match) -> str:
    return DIGITS.get(match.group()) or SIGNS.get(match.group()) or match.group()


def fold(text: str) -> list[str]:
    """The words of a text with disguises taken off."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if HIDDEN.search(text):
            text = text.translate(INVISIBLE)
    text = text.lower()
    if not text.isascii() and ALIKE.search(text):
        text = WORD.sub(_latin, text)
    text = SIGN.sub(_sign, text)
    if BETWEEN.search(text):
        text = APART.sub(lambda m: re.sub(r"[.\-_*·]", "", m.group()), text)
    return WORD.findall(text)


@dataclass
class Model:
    """Entries ``" word "`` or ``" stem"`` with weights, exception phrases, and the logistic function."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))
    per: int = 100


class Matcher:
    """The automaton over a model's entries and phrases."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, ahocorasick.Automaton()
        for entry, weight in model.weights.items():
            self.automaton.add_word(entry, (entry, weight))
        for phrase in model.exceptions:
            self.automaton.add_word(f" {phrase} ", (f" {phrase} ", None))
        self.automaton.make_automaton()

    def hits(self, words: list[str]) -> dict[int, tuple[str, float]]:
        """Place in the joined text of each word that counts, with its longest entry."""
        if not len(self.automaton):
            return {}
        best: dict[int, tuple[str, float]] = {}
        excused: list[tuple[int, int]] = []
        for end, (entry, weight) in self.automaton.iter(" " + " ".join(words) + " "):
            start = end - len(entry) + 1
            if weight is None:
                excused.append((start, end))
            elif start not in best or len(entry) > len(best[start][0]):
                best[start] = entry, weight
        return {at: hit for at, hit in best.items() if not any(a <= at and at + len(hit[0].rstrip()) <= b for a, b in excused)} if excused else best

    def numbers(self, words: list[str], found: dict[int, tuple[str, float]]) -> list[float]:
        """Weight, weight by length, different words."""
        total = sum(w for _, w in found.values())
        return [total, total * self.model.per / max(len(words), 1), float(len({e for e, _ in found.values()}))]

    def features(self, text: str) -> list[float]:
        words = fold(text)
        return self.numbers(words, self.hits(words))

    def score(self, text: str) -> float:
        if not len(self.model.coefficients):
            return 0.0
        return float(_probability(_design(np.array([self.features(text)])), self.model.coefficients)[0])


def _design(features: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(features)), np.log1p(np.maximum(features, 0))])


def _probability(x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ coefficients, -40, 40)))


def fit_logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton steps with a small ridge."""
    x = _design(features)
    at = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _probability(x, at)
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        at = at + np.clip(np.linalg.solve(bend, x.T @ (weights * (labels - p)) - 0.5 * at), -4, 4)
    return at


# --- learning --------------------------------------------------------------------

def stems(words: set[str]) -> set[str]:
    low, high = STEM
    return {" " + w[:k] for w in words for k in range(low, min(len(w), high) + 1)}


def _counted(make):
    """Documents of the sample by entry and label, summed inside the task."""

    def counted(batches):
        held: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *[pa.array([v[k] for v in held.values()], pa.int64()) for k in (0, 1)]], names=["entry", "clean", "toxic"])
            held.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("_text").to_pylist(), batch.column("_toxic").to_pylist()):
                for entry in make(fold(text)):
                    held[entry][toxic] += 1
                if len(held) > FLUSH:
                    yield rows()
        yield rows()

    return counted


def _entries(words: list[str]):
    each = set(words)
    return {f" {w} " for w in each} | stems(each)


def _phrases(matcher: Matcher):
    def phrases(words: list[str]):
        found = matcher.hits(words)
        if not found:
            return set()
        starts = np.cumsum([0, *[len(w) + 1 for w in words]]).tolist()
        places = {at: i for i, at in enumerate(starts)}
        out = set()
        for at in found:
            i = places[at]
            out |= {" ".join(words[a : a + 2]) for a in (i - 1, i) if a >= 0 and a + 2 <= len(words)}
        return out

    return phrases


def _log_odds(clean_docs: int, toxic_docs: int) -> tuple[Column, Column]:
    """Log odds of the label given an entry against the documents' own, and its lower bound, one standard error and a half down."""
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / F.lit(toxic_docs + 1.0)) - F.log(b / F.lit(clean_docs + 1.0))
    return odds, odds - 1.5 * F.sqrt(1 / a + 1 / b)


def _pruned(rows: list[tuple[str, int, float]]) -> dict[str, float]:
    """Entries (with toxic documents and odds) that say something of their own. A stem that is nearly always the same
    longer entry gives way to it; a longer entry whose stem, the longest that is kept, is about as good goes."""
    longer: dict[str, int] = {}
    for entry, toxic, _ in rows:
        for k in range(STEM[0] + 1, len(entry)):
            longer[entry[:k]] = max(longer.get(entry[:k], 0), toxic)
    kept: dict[str, float] = {}
    for entry, toxic, odds in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        if 10 * longer.get(entry, 0) >= 9 * toxic:
            continue
        parent = next((kept[entry[:k]] for k in range(len(entry) - 1, STEM[0], -1) if entry[:k] in kept), None)
        if parent is None or odds > parent + 0.5:
            kept[entry] = odds
    return kept


def labelled(labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """One row per labelled id, at most about ``sample`` of each kind, chosen by hash of the id."""
    one = labels.select(C.named(id_col).cast("long").alias("_id"), (C.named(label_col) == 1).cast("int").alias("_toxic")).filter("_id IS NOT NULL AND _toxic IS NOT NULL")
    one = one.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in one.groupBy("_toxic").count().collect()}
    share = F.lit(0.0)
    for kind, n in counts.items():
        share = F.when(F.col("_toxic") == kind, F.lit(min(1.0, sample / n))).otherwise(share)
    return one.filter(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic",
    sample: int = SAMPLE, support: int = 5, least: float = 1.5, exceptions: tuple[str, ...] = (),
) -> Model:
    """A model of what ``label_col`` = 1 marks. Pass only the labels to learn from."""
    some = labelled(labels, label_id, label_col, sample)
    rows = written(C.intake(docs, id_col, text_col).join(F.broadcast(some), "_id").select("_text", "_toxic"))
    size = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    if len(size) < 2:
        return Model(exceptions=[" ".join(fold(e)) for e in exceptions])
    odds, low = _log_odds(size[0], size[1])
    counts = lambda make: rows.mapInArrow(_counted(make), "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lexicon = counts(_entries).filter((F.col("toxic") >= support) & (low >= least)).select("entry", "toxic", odds.alias("odds")).collect()
    model = Model(weights=_pruned([(r["entry"], r["toxic"], r["odds"]) for r in lexicon]))
    excused = counts(_phrases(Matcher(model))).filter((F.col("clean") >= support) & (odds <= 0)).select("entry").collect()
    model.exceptions = sorted({r["entry"] for r in excused} | {" ".join(fold(e)) for e in exceptions} - {""})

    def features(batches):
        matcher = Matcher(model)
        for batch in batches:
            found = np.array([matcher.features(t) for t in batch.column("_text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*[pa.array(found[:, k]) for k in range(3)], batch.column("_toxic")], names=["a", "b", "c", "_toxic"])

    seen = rows.mapInArrow(features, "a double, b double, c double, _toxic int").groupBy("a", "b", "c", "_toxic").count().toArrow()
    columns = [seen.column(n).to_numpy() for n in ("a", "b", "c", "_toxic", "count")]
    model.coefficients = fit_logistic(np.column_stack(columns[:3]), columns[3].astype(float), columns[4].astype(float))
    return model


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, score, predicted and the words that counted (folded, in order) of every document."""

    def scored(batches):
        matcher = Matcher(model)
        for batch in C.pieces(batches):
            rows, hits = np.zeros((batch.num_rows, 3)), []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                words = fold(text)
                found = matcher.hits(words)
                rows[i] = matcher.numbers(words, found)
                hits.append([found[at][0].strip() for at in sorted(found)])
            scores = _probability(_design(rows), model.coefficients) if len(model.coefficients) else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), pa.array(hits, pa.list_(pa.string()))], names=["_id", "score", "predicted", "hits"])

    return C.intake(docs, id_col, text_col).mapInArrow(scored, "_id long, score double, predicted int, hits array<string>")
