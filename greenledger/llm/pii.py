"""Personal data by candidates and gradient boosting.

Base spans follow fixed formats (email, ip, card, phone; leftmost, not overlapping within a kind, then
checked: address parts at most 255, 13 to 19 digits that pass the Luhn sum, 9 to 15 digits). They always
stay. Beside them high-recall generators propose overlapping spans: addresses written out, numbers
grouped like telephones or cards, hexadecimal addresses, and what a base format matched but its check
refused. Each proposal has a check of its own (``sound``); one that fails it is never added. Boosted trees see
shape and context of every span, but not the signs that tell a base format from a proposed one. They are trained
in numpy on all labelled spans, which Spark counts by kind, label and bin of every feature (at most 32 bins each, between quantiles over
all of them), so that the driver sees each distinct row once, with its number: positives are base spans rewritten in
place into a proposed format, negatives are proposals whose check fails and that touch no base span and no sound
proposal. Sound proposals have no label. Each kind's threshold is calibrated on a fifth held back by hash: halfway
below the least score at which positives make up at least ``precision`` of all above it. Sound proposals over
the threshold that do not overlap a base span of any kind, nor a better proposal, are added.

Whole texts are read once. Patterns have no nested repetition and start at a digit run, a plus sign
or an at sign, so their time is linear in the text. Spans count code points, ends are exclusive.

Nulls: a null text is empty and has no spans. Repeated rows each get their spans. Without base spans or
without refused proposals there is nothing to learn, and only base spans are returned; a kind without base
spans gets no additions.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from greenledger.llm import common as C
from greenledger.session import cut

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PATTERNS = {
    "tail": r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSALS = (
    ("email", r"(?:\x20?\[at\]|\x20?\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?\[dot\]|\x20?\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4}"),
    ("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])"),
    ("card", r"(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){2,3}(?![0-9])"),
    ("phone", r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+.])00[1-9][0-9]{7,13}(?![0-9])"),
)
CUES = ("mail", "tel", "phone", "call", "card", "pay", "ip", "host", "version", "id", "number")
WRITTEN = ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", "."))
FEATURES = 7 + len(CUES) + len(KINDS) + 2
OPEN, POSITIVE, NEGATIVE, UNUSED = range(4)  # sound proposals; examples to learn from; neither
SPAN = "struct<kind: int, start: int, end: int, base: boolean, label: int, features: array<float>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def holds(kind: str, text: str) -> bool:
    """The check behind a base format."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in text.split("."))
    digits = _digits(text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def emails(text: str, tail: re.Pattern):
    """Leftmost addresses: each at sign takes the name characters before it, back to the last address."""
    done = 0
    for m in tail.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def formats(text: str, found: dict[str, re.Pattern]):
    """(kind, start, end, whether the check holds) of all base formats."""
    if "@" in text:
        for start, end in emails(text, found["tail"]):
            yield 0, start, end, True
    for k, kind in enumerate(KINDS[1:], 1):
        for m in found[kind].finditer(text):
            yield k, m.start(), m.end(), holds(kind, m.group())


def sound(kind: str, text: str, start: int, end: int) -> bool:
    """The check behind a proposed format: what it holds, and that it is no part of a longer word or number."""
    span = text[start:end]
    if kind == "email":
        name, *_, domain = re.split(r"(?:\x20?\[at\]|\x20?\(at\)|\x20at\x20)\x20?", span)
        labels = re.split(r"\x20?\[dot\]\x20?|\x20?\(dot\)\x20?|\x20dot\x20\x20?|\.", domain)
        top = labels[-1]
        return any(c.isalnum() for c in name) and all(v and v[0] != "-" != v[-1] for v in labels) and 2 <= len(top) <= 24 and top.isalpha() and (top.islower() or top.isupper())
    if text[max(0, start - 1) : start].isalnum() or re.match(r"\w|[.:_/-][0-9]", text[end : end + 2]):
        return False
    if kind == "ip":
        return span.count(":") == 7
    digits = _digits(span)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not re.match(r"(?:19|20)[0-9]{2}[\x20.-](?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])", span)


def rewritten(kind: str, span: str) -> str | None:
    """A base span in one of the proposed formats, by its hash; None where they have none for it."""
    pick, digits = zlib.crc32(span.encode("utf-8", "replace")), _digits(span)
    if kind == "email":
        at, dot = WRITTEN[pick % len(WRITTEN)]
        name, domain = span.rsplit("@", 1)
        return name + at + domain.replace(".", dot) if domain.count(".") <= 4 else None
    if kind == "ip":
        octets = [int(v.lstrip("0") or 0) for v in span.split(".")]
        return ":".join(f"{(pick >> k | octets[k % 4]) & 0xFFFF:x}" for k in range(8))
    if kind == "card":
        return "._/"[pick % 3].join(digits[k : k + 4] for k in range(0, 16, 4)) if len(digits) == 16 else None
    area, middle, line = digits[-10:-7], digits[-7:-4], digits[-4:]
    forms = [f"({area}) {middle}-{line}", f"{area}-{middle}-{line}", f"{area}.{middle}.{line}", f"{area} {middle} {line}"]
    return [*forms, f"00{digits}"][pick % (4 + (digits[0] != "0"))]


def describe(text: str, kind: int, start: int, end: int, span: str | None = None) -> list[float]:
    """Shape of a span and of what stands around it; with ``span`` as if that stood there instead."""
    span = text[start:end] if span is None else span
    digits = _digits(span)
    before, after = text[max(0, start - 24) : start], text[end : end + 8]
    groups = [len(g) for g in re.split("[^0-9]+", span) if g]
    words = before.lower()
    shape = [len(span), len(digits), len(digits) / len(span), len(groups), max(groups, default=0), min(groups, default=0), sum(c.isalpha() for c in span) / len(span)]
    around = [float(before[-1:].isalnum()), float(after[:1].isalnum())]
    return [*shape, *(float(c in words) for c in CUES), *(float(kind == k) for k in range(len(KINDS))), *around]


def _merged(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans."""
    starts, ends = [], []
    for start, end in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _meets(start: int, end: int, union: tuple[list[int], list[int]]) -> bool:
    i = bisect_right(union[1], start)
    return i < len(union[0]) and union[0][i] < end


def spans_of(text: str, found: dict[str, re.Pattern], more) -> list[dict]:
    """Base spans, described as rewritten, and proposals, each with its label."""
    out, fits = {}, {}
    for kind, start, end, base in formats(text, found):
        if base or end - start >= 7:
            out[kind, start, end] = base
    for kind, pattern in more:
        for m in pattern.finditer(text):
            start = m.start()
            while kind == 0 and start and text[start - 1] in LOCAL and m.start() - start < 64:
                start -= 1
            if kind or start < m.start():
                key = (kind, start, m.end())
                if key not in out:
                    out[key], fits[key] = False, sound(KINDS[kind], text, start, m.end())
    base = _merged((s, e) for (_, s, e), b in out.items() if b)
    taken = _merged((s, e) for (k, s, e), b in out.items() if b or fits.get((k, s, e)))
    spans = []
    for (k, s, e), b in sorted(out.items()):
        if b:
            other = rewritten(KINDS[k], text[s:e])
            label, features = (POSITIVE, describe(text, k, s, e, other)) if other else (UNUSED, None)
        else:
            label = (UNUSED if _meets(s, e, base) else OPEN) if fits.get((k, s, e)) else UNUSED if _meets(s, e, taken) else NEGATIVE
            features = describe(text, k, s, e) if label != UNUSED else None
        if b or label != UNUSED:
            spans.append({"kind": k, "start": s, "end": e, "base": b, "label": label, "features": features})
    return spans


def _propose(batches):
    found = {k: re.compile(v) for k, v in PATTERNS.items()}
    more = [(KINDS.index(k), re.compile(v)) for k, v in PROPOSALS]
    digit = re.compile("[0-9@]|(?:\\[|\\(|\x20)at(?:\\]|\\)|\x20)")
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("label", pa.int32()), ("features", pa.list_(pa.float32()))]))
    for batch in C.pieces(batches):
        rows = [spans_of(t, found, more) if digit.search(t) else [] for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(rows, kind)], names=["_id", "spans"])


# --- boosted trees ---------------------------------------------------------------

@dataclass(frozen=True)
class Trees:
    """Trees of one depth as arrays: at each inner node a feature and a bound, at each leaf a value."""

    features: np.ndarray
    bounds: np.ndarray
    leaves: np.ndarray
    start: float
    thresholds: tuple[float, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        rows = np.arange(len(x))
        for f, b, v in zip(self.features, self.bounds, self.leaves):
            at = np.zeros(len(x), int)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > b[at])
            out += v[at - (len(f))]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
    """The feature and bound with the largest gain of second order."""
    best = (0.0, 0, np.inf)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        bins = np.searchsorted(edges, x[:, f], "left")
        gl, hl = np.cumsum(np.bincount(bins, g, len(edges) + 1))[:-1], np.cumsum(np.bincount(bins, h, len(edges) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
        i = int(gain.argmax())
        if gain[i] > best[0] + 1e-9:
            best = (float(gain[i]), f, float(edges[i]))
    return best[1], best[2]


QUANTILES = np.linspace(0, 1, 33)[1:-1]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, weight: np.ndarray | None = None, cuts: list[np.ndarray] | None = None):
    """Gradient boosting on the logistic loss with trees of second order. A row counts ``weight`` times."""
    weight = np.ones(len(y)) if weight is None else weight
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], QUANTILES)) for f in range(x.shape[1])] if cuts is None else cuts
    margin, inner = np.full(len(y), start), 2**depth - 1
    features, bounds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        f, b, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for node in range(inner):
            here = at == node
            if here.any():
                f[node], b[node] = _split(x[here], g[here], h[here], cuts)
                at[here] = 2 * node + 1 + (x[here, f[node]] > b[node])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += value[leaf]
        features.append(f)
        bounds.append(b)
        leaves.append(value)
    return np.array(features), np.array(bounds), np.array(leaves), start


def _calibrate(score: np.ndarray, y: np.ndarray, precision: float, weight: np.ndarray) -> float:
    """Halfway below the least score from which on positives have this share; over 1 if there is none."""
    order = np.argsort(-score, kind="stable")
    share = np.cumsum((weight * y)[order]) / np.cumsum(weight[order])
    last = np.flatnonzero((share >= precision) & np.r_[score[order][1:] < score[order][:-1], True])
    return float(score[order][last[-1]] + np.r_[score[order], 0.0][last[-1] + 1]) / 2 if len(last) else 1.1


def fit(x: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float, weight: np.ndarray | None = None, held: np.ndarray | None = None, cuts: list[np.ndarray] | None = None) -> Trees | None:
    if not 0 < y.sum() < len(y):
        return None
    if held is None:
        held = np.arange(len(y)) % 5 == 4
        if len(y) < 50 or not 0 < y[held].sum() < held.sum():
            held[:] = False
    weight = np.ones(len(y)) if weight is None else weight
    model = Trees(*boost(x[~held], y[~held], weight=weight[~held], cuts=cuts), thresholds=())
    check = held if held.any() else ~held
    score = model.score(x[check])
    part = lambda k: _calibrate(*(v[kinds[check] == k] for v in (score, y[check])), precision, weight[check][kinds[check] == k])
    limits = tuple(max(0.5, part(k)) if (kinds[check] == k).any() else 1.1 for k in range(len(KINDS)))
    return Trees(model.features, model.bounds, model.leaves, model.start, limits)


def _bin(cuts: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, FEATURES)
            codes = np.column_stack([np.searchsorted(edges, x[:, f].astype(float), "left").astype(np.uint8) for f, edges in enumerate(cuts)])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("kind", "label", "held")), pa.array([row.tobytes() for row in codes], pa.binary())], names=["kind", "label", "held", "codes"])

    return run


def learn(proposed: DataFrame, precision: float) -> Trees | None:
    """Trees from all rewritten base spans and all refused proposals. Trees part rows between the bins only, so equal rows are counted first."""
    rows = proposed.select("_id", F.explode("spans").alias("s")).filter(F.col("s.label").isin(POSITIVE, NEGATIVE))
    rows = rows.select("s.kind", "s.label", "s.features", (F.pmod(F.xxhash64("_id", "s.kind", "s.start", "s.end"), F.lit(5)) == 4).alias("held"))
    parts = {(r["label"], r["held"]): r["count"] for r in rows.groupBy("label", "held").count().collect()}
    if {label for label, _ in parts} != {POSITIVE, NEGATIVE}:
        return None
    if sum(parts.values()) < 50 or len(parts) < 4:
        rows = rows.withColumn("held", F.lit(False))
    quantiles = rows.filter("NOT held").agg(*[F.percentile(F.col("features")[f].cast("double"), QUANTILES.tolist()).alias(f"q{f}") for f in range(FEATURES)]).first()
    cuts = [np.unique(q) for q in quantiles]
    table = rows.mapInArrow(_bin(cuts), "kind int, label int, held boolean, codes binary").groupBy("kind", "label", "held", "codes").count().toArrow()
    table = table.sort_by([(n, "ascending") for n in ("kind", "label", "held", "codes")])
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(-1, FEATURES)
    x = np.column_stack([np.append(edges, edges[-1] + 1)[codes[:, f]] for f, edges in enumerate(cuts)])  # a value that stands for its bin
    column = lambda n: table.column(n).to_numpy()
    return fit(x, (column("label") == POSITIVE).astype(float), column("kind"), precision, column("count").astype(float), column("held").astype(bool), cuts)


def _choose(model: Trees | None):
    def choose(spans: list[dict]) -> list[dict]:
        out = [{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"], "base": True, "score": 1.0} for s in spans if s["base"]]
        rest = [s for s in spans if s["label"] == OPEN]
        if not rest or model is None:
            return out
        scores = model.score(np.array([s["features"] for s in rest], np.float32))
        for s, p in sorted(zip(rest, scores.tolist()), key=lambda v: (-v[1], v[0]["start"], v[0]["end"], v[0]["kind"])):
            if p >= model.thresholds[s["kind"]] and all(s["end"] <= o["start"] or o["end"] <= s["start"] for o in out):
                out.append({"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"], "base": False, "score": p})
        return sorted(out, key=lambda s: (KINDS.index(s["kind"]), s["start"], s["end"]))

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([choose(s) for s in batch.column("spans").to_pylist()], kind)], names=["_id", "spans"])

    return run


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.99) -> DataFrame:
    """``_id`` and spans (array of kind, start, end, base, score) of every document."""
    proposed = cut(C.intake(docs, id_col, text_col).mapInArrow(_propose, f"_id long, spans array<{SPAN}>"))
    model = learn(proposed, precision)
    return proposed.mapInArrow(_choose(model), "_id long, spans array<struct<kind: string, start: int, end: int, base: boolean, score: double>>")


def redact(text, spans):
    """Column: the text with every span replaced by its kind in brackets; overlapping spans become one."""
    pieces = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).when(
            s["start"] < a["at"], F.struct(a["out"].alias("out"), s["end"].alias("at"))
        ).otherwise(F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))),
    )
    return F.concat(pieces["out"], F.substr(text, pieces["at"] + 1))
