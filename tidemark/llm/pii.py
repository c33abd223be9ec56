"""Personal data: fixed base patterns, and candidates that boosted trees select.

Four kinds of spans are found in whole texts: e-mail addresses, IP addresses,
card numbers and phone numbers. The base patterns below decide by themselves.
Besides, generators with loose patterns propose candidate spans (numbers
written with other separators or without prefix, addresses spelled out) that
may overlap; gradient-boosted trees score them by format and context, without
the checks of the base patterns. The trees learn on all different texts:
base spans rewritten in each of their kind's disguises, in their place, are the
positive examples; candidates that overlap no base span of their kind are
unlabelled. For each kind the threshold is the lowest score at which, in texts
that the fit did not see, nearly all are right; unlabelled candidates count as
right as far as the disguised spans' scores explain their number. Selected
candidates are added, best score first, where they overlap no span of their
kind; base spans always stay.

Defined results: a null or empty text has no spans. Without a base span to
disguise or without an unlabelled candidate there is no model, and the base
spans are the result. Repeated
rows are treated each for itself, other columns are ignored, empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_pieces, freed, pieces, replaced, written

KINDS = ("email", "ip", "card", "phone")
#: Least number of partitions of the examples; larger tables have more.
PARTS = 64
#: Trees of a model.
ROUNDS = 15
#: Steps of the scores that thresholds are chosen from.
LEVELS = 1 << 14
#: Share of unseen candidates above a threshold that must be right.
PRECISION = 0.98
#: Right ones that must be among them.
LEAST_RIGHT = 20
#: Share of the disguised spans from which on the number of unlabelled ones is compared with theirs.
LEAST_SHARE = 0.8
CONTEXT = 24
#: Characters of text kept on both sides of a disguised span.
AROUND = 128

# Base patterns (fixed values). A run of digits is tried from its start only:
# a later start inside it cannot match where the start does not.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Generators of candidates.
_NUMBER = re.compile(r"[+(]?[0-9](?:[\x20()./+-]{0,3}[0-9]){6,24}")
_DOTTED = re.compile(
    r"(?<![0-9])[0-9]{1,3}(?:\x20?(?:\.|\(\.\)|\[\.\]|\(dot\)|\[dot\])\x20?[0-9]{1,3}){3}(?![0-9])")
_AT = re.compile(r"\s?(?:@|\(at\)|\[at\]|\bat\b)\s?")
_SPELLED = re.compile(
    r"[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\bdot\b)\s?[A-Za-z0-9-]{1,63})+")
#: Texts without it have no candidates; Java's syntax.
_MAY_HOLD = r"[0-9@]|[\s(\[]at[\s)\]]\s?[A-Za-z0-9-]+\s?(\.|\(dot|\[dot|dot\b)"
_GAP = re.compile(r"[.]\s|[\r\n]")
_DOT = re.compile(r"[(\[]?\bdot\b[)\]]?")
_HINTS = re.compile(r"mail|contact|phone|tel|call|fax|mobil|card|visa|account|konto|carte|tarjeta|addr|host|server|ip\b",
                    re.IGNORECASE)

Span = tuple[int, int, int]


def _emails(text: str) -> list[tuple[int, int]]:
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append((start, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    return spans


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) of the base patterns, by kind and start; code points, end exclusive."""
    if not text:
        return []
    spans = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            spans.append((2, m.start(), m.end()))
    if "+" in text:
        spans.extend((3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15)
    return spans


def candidate_spans(text: str | None) -> list[Span]:
    """Spans the generators propose; they may overlap each other and the base spans."""
    if not text:
        return []
    spans = set()
    for m in _NUMBER.finditer(text):
        n = len(_digits(m[0]))
        if 13 <= n <= 19:
            spans.add((2, m.start(), m.end()))
        if 9 <= n <= 15:
            spans.add((3, m.start(), m.end()))
    spans.update((1, m.start(), m.end()) for m in _DOTTED.finditer(text))
    for m in _AT.finditer(text):
        start = m.start()
        while start > max(0, m.start() - 64) and text[start - 1] in _LOCAL:
            start -= 1
        found = _SPELLED.match(text, m.end()) if start < m.start() else None
        if found:
            spans.add((0, start, found.end()))
    return sorted(spans)


def disguises(kind: int, inside: str) -> list[str]:
    """A base span in the spellings that its pattern does not take."""
    digits = _digits(inside)
    if kind == 0:
        local, domain = inside.split("@", 1)
        dots = [domain.replace(".", d) for d in ("(dot)", "[dot]", " dot ", " (dot) ")]
        return [f"{local} at {domain}", f"{local}(at){domain}", f"{local} [at] {domain}", f"{local} @ {domain}",
                f"{local}(at){dots[0]}", f"{local} [at] {dots[1]}", f"{local} at {dots[2]}", f"{local} (at) {dots[3]}"]
    if kind == 1:
        return [inside.replace(".", d) for d in ("[.]", "(.)", " . ", ". ", "[dot]")]
    if kind == 2:
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [d.join(fours) for d in (".", "/", " - ", "--", "  ")]
    plain = inside[1:].strip()
    groups = [g for g in re.split(r"[^0-9]+", plain) if g]
    return [plain, digits, f"00{digits}", *(d.join(g) for g in (groups, groups[1:]) for d in (" ", "-", ".", "/"))]


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span; nothing of the base patterns' checks."""
    kind, start, end = span
    inside = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    around = before + after
    groups = re.split(r"[^0-9]+", inside)
    sizes = [len(g) for g in groups if g] or [0]
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        float(len(inside)), float(sum(sizes)), float(sum(c.isalpha() for c in inside)),
        float(len(sizes)), float(max(sizes)), float(min(sizes)),
        *(float(inside.count(c)) for c in " -./()["), float(len(_DOT.findall(inside))),
        float(len(_GAP.findall(inside))), float(sum(c.isupper() for c in inside)),
        float(before[-1:].isalnum() or after[:1].isalnum()),
        float(before[-1:].isalpha()), float(before[-1:].isdigit()), float(before[-1:] in ("+", "#", "$", "=")),
        float(after[:1].isalpha()), float(after[:1].isdigit()), float(after[:1] in ("-", "/", "=", "_")),
        sum(c.isalpha() for c in around) / max(1, len(around)),
        sum(c.isdigit() for c in around) / max(1, len(around)),
        float(bool(_HINTS.search(around))),
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees as nested (feature, threshold, below, above) tuples, and a threshold per kind."""

    trees: tuple = ()
    weights: tuple[float, ...] = ()
    thresholds: tuple[float, ...] = field(default=(2.0,) * len(KINDS))

    def score(self, x: list[float]) -> float:
        margin = 0.0
        for tree, weight in zip(self.trees, self.weights, strict=True):
            while isinstance(tree, tuple):
                tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
            margin += weight * tree
        return float(1 / (1 + np.exp(-2 * margin)))


def _overlaps(span: Span, others) -> bool:
    return any(span[0] == k and span[1] < b and a < span[2] for k, a, b in others)


def all_spans(text: str | None, model: Trees) -> tuple[list[Span], list[Span]]:
    """The base spans, and these with the candidates that the trees select."""
    base = base_spans(text)
    if not model.trees or not text:
        return base, base
    rated = sorted((-model.score(features(text, c)), c) for c in candidate_spans(text) if not _overlaps(c, base))
    chosen: list[Span] = []
    for score, c in rated:
        if -score >= model.thresholds[c[0]] and not _overlaps(c, chosen):
            chosen.append(c)
    return base, sorted(base + chosen)


def _examples(batches):
    """Disguised base spans (label 1), and what no base span of its kind overlaps (label 0: unlabelled)."""
    for batch in pieces(batches):
        every = []
        for text, part, draw in zip(batch["text"], batch["part"], batch["draw"], strict=True):
            base = base_spans(text)
            rows = [(features(text, c), 0.0, c[0], part) for c in candidate_spans(text) if not _overlaps(c, base)]
            for kind, a, b in base:
                before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
                for inside in disguises(kind, text[a:b]):
                    window, start, end = before + inside + after, len(before), len(before) + len(inside)
                    hidden = base_spans(window)
                    for c in candidate_spans(window):
                        if c[1] < end and start < c[2] and not _overlaps(c, hidden):
                            # another kind's candidate at this place is wrong, but it stands in no text
                            if c[0] == kind or part:
                                rows.append((features(window, c), float(c[0] == kind), c[0], part))
            every.extend((*row, draw, i) for i, row in enumerate(rows))
        yield pd.DataFrame(every, columns=["x", "label", "kind", "part", "draw", "place"])


def _tree(node) -> tuple | float:
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def _threshold(scores: np.ndarray, right: np.ndarray, rows: np.ndarray | None = None,
               weight: np.ndarray | None = None) -> float:
    """Lowest score from which on nearly all are right; 2 when there is none.

    An entry stands for ``rows`` candidates of a score, of which ``right`` are right.
    """
    rows = np.ones(len(scores)) if rows is None else rows
    weight = np.ones(len(scores)) if weight is None else weight
    order = np.argsort(-scores, kind="stable")
    hits, of = np.cumsum((right * weight)[order]), np.cumsum((rows * weight)[order])
    good = (hits >= PRECISION * of - 1e-9) & (np.cumsum(right[order]) >= LEAST_RIGHT)
    good &= np.r_[scores[order][1:] != scores[order][:-1], True] if len(order) else good
    return float(scores[order][np.flatnonzero(good)[-1]]) if good.any() else 2.0


def _unlabelled_threshold(known: np.ndarray, unlabelled: np.ndarray, n_known: np.ndarray | None = None,
                          n_unlabelled: np.ndarray | None = None) -> float:
    """Threshold from the scores of spans known to be right, and of candidates of which some may be.

    ``n_known`` and ``n_unlabelled`` count the spans of each score. If a share
    of the unlabelled ones is right, it is spread over the scores
    like the known ones, and is not larger than the smallest ratio of both
    counts above a score: with ``LEAST_SHARE`` of the known ones above it as
    counted, with fewer at two standard deviations. That many count as right;
    the known ones weigh as much as them, or as ``LEAST_RIGHT``.
    """
    if not len(known):
        return 2.0
    levels = np.unique(np.r_[known, unlabelled])[::-1]

    def counted(scores, times):
        return np.bincount(np.searchsorted(-levels, -scores), times, len(levels))

    of_known, of_rest = counted(known, n_known), counted(unlabelled, n_unlabelled)
    total = of_known.sum()
    share, above = np.cumsum(of_known) / total, np.cumsum(of_rest)
    spread = np.where(share >= LEAST_SHARE, 0.0, 2 * np.sqrt(above + 1.0))
    enough = (of_known > 0) & ((share * total >= LEAST_RIGHT) | (share >= LEAST_SHARE))
    right = float(np.min((above + spread)[enough] / share[enough]))
    # as many as there are down to a score, counted where candidates are
    explained = np.maximum.accumulate(np.where(of_rest > 0, np.minimum(above, right * share), 0.0))
    credit = np.diff(explained, prepend=0.0)
    weight = min(1.0, max(right, LEAST_RIGHT) / total)
    one = np.ones(len(levels))
    return _threshold(np.r_[levels, levels], np.r_[of_known, credit], np.r_[of_known, of_rest],
                      np.r_[weight * one, one])


def _all_examples(texts: DataFrame) -> DataFrame:
    """Examples of all different texts; copies of a text are one row before anything is shuffled.

    They are dealt and sorted by a hash of their text, so that fits agree whatever task was first.
    """
    parts = max(PARTS, 4 * texts.rdd.getNumPartitions())
    draw = F.xxhash64("text", F.lit(11)).bitwiseAND(F.lit((1 << 62) - 1))
    part = F.pmod(F.xxhash64("text", F.lit(13)), F.lit(3)).cast("int")
    return written(
        texts.distinct().select("text", part.alias("part"), draw.alias("draw"))
        .mapInPandas(_examples, "x array<double>, label double, kind int, part int, draw long, place int")
        .repartition(parts, "draw").sortWithinPartitions("draw", "place").drop("draw", "place"), "pii-examples")


def fit_trees(df: DataFrame, text_col: str) -> Trees:
    """Fit on the candidates of all different texts; a third of the texts is kept for the thresholds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = _all_examples(df.select(F.col(text_col).alias("text")).filter(F.col("text").rlike(_MAY_HOLD)))
    sides = {r["label"] for r in rows.filter("part > 0").select("label").distinct().collect()}
    if len(sides) < 2:
        return Trees()
    train = rows.filter("part > 0").select(array_to_vector("x").alias("features"), "label")
    fitted = GBTClassifier(maxIter=ROUNDS, maxDepth=4, stepSize=0.3, minInstancesPerNode=5, seed=1,
                           cacheNodeIds=False).fit(train)
    trees = tuple(_tree(t._call_java("rootNode")) for t in fitted.trees)
    model = Trees(trees, tuple(fitted.treeWeights))

    def rated(batches):
        for batch in batches:
            level = [int(model.score(x) * LEVELS) for x in batch["x"]]
            yield pd.DataFrame({"kind": batch["kind"], "label": batch["label"], "level": level})

    counts = rows.filter("part = 0").select("x", "label", "kind").mapInPandas(
        rated, "kind int, label double, level int").groupBy("kind", "label", "level").count()
    unseen = counts.toPandas()  # a row per kind, label and level at most
    thresholds = []
    for kind in range(len(KINDS)):
        known, rest = (unseen[(unseen["kind"] == kind) & (unseen["label"] == label)] for label in (1.0, 0.0))
        thresholds.append(_unlabelled_threshold(
            known["level"].to_numpy() / LEVELS, rest["level"].to_numpy() / LEVELS,
            known["count"].to_numpy(), rest["count"].to_numpy()))
    return Trees(trees, model.weights, tuple(thresholds))


def span_list(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or run of overlapping spans, as the kind of its first."""
    if not spans:
        return text
    out, at, upto = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= upto:
            out.append(text[at:a] if at < a else "")
            out.append(f"[{KINDS[kind].upper()}]")
            at = upto = b
        else:
            at = upto = max(upto, b)
    out.append(text[at:])
    return "".join(out)


def detect_pii(df: DataFrame, id_col: str, text_col: str, model: Trees) -> DataFrame:
    """``id``, base counts per kind, ``base_sha256`` and ``spans`` of every row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = rows.drop("text").schema
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        trees = shared.value
        for batch in arrow_pieces(batches):
            found = [all_spans(t, trees) for t in batch.column("text").to_pylist()]
            counts = {f"n_{kind}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64())
                      for k, kind in enumerate(KINDS)}
            digests = [hashlib.sha256(span_list(base).encode()).hexdigest() for base, _ in found]
            yield replaced(batch, "text", **counts, base_sha256=pa.array(digests, pa.string()),
                           spans=pa.array([span_list(every) for _, every in found], pa.string()))

    return rows.mapInArrow(freed(run), schema)


def redact_pii(df: DataFrame, text_col: str, model: Trees) -> DataFrame:
    """The rows with the spans of their text replaced; other columns stay."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        trees = shared.value
        for batch in arrow_pieces(batches):
            texts = [redact(t, all_spans(t, trees)[1]) for t in batch.column(text_col).to_pylist()]
            yield replaced(batch, None, **{text_col: pa.array(texts, pa.string())})

    return df.mapInArrow(freed(run), df.schema)
