"""Language identification by hierarchical discrimination.

Learned languages are grouped into families by the similarity of their mean
character profiles. A text is first given a family by linear support vector
machines between families, then a language by the machines between the
languages of that family (one against one, all pairs, majority of votes, ties
by the sum of margins and then by name).

A text's features are the shares of its hashed byte n-grams (1 to 3 bytes)
after lower-casing, with everything that is not a letter as a space. Neither
id nor source nor the stored language enters a prediction.

Defined results: a text that is null or has no letter is ``und`` with score 0.
Empty tables give empty results. Without a labelled row every text with a
letter is ``und``. With one language every text with a letter gets it.
Repeated rows are predicted each for itself; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import arrow_pieces, freed, pieces, replaced, written
from tidemark.plans.lookup import lookup_join

#: Rows per language that a fit may use: the bound of the training sample.
MAX_ROWS_PER_LANGUAGE = 400
DIMENSIONS = 8192
UNKNOWN = "und"
_SPACE = 32
_ASCII = np.array([b if (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else _SPACE for b in range(256)],
                  dtype=np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """Families of languages and the weights of each pair's separating line."""

    families: tuple[tuple[str, ...], ...]
    family_lines: dict[tuple[int, int], np.ndarray]
    language_lines: dict[tuple[str, str], np.ndarray]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def profile(text: str) -> np.ndarray:
    """Unit vector of hashed byte n-grams, with a constant as last component."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    codes = _ASCII[raw]
    codes = codes[(codes != _SPACE) | (np.roll(codes, 1) != _SPACE)]  # runs of spaces count once
    codes = np.concatenate([[_SPACE], codes, [_SPACE]]).astype(np.uint32)
    counts = np.bincount(codes & 255, minlength=256).astype(np.float64)
    two = codes[:-1] << 8 | codes[1:]
    three = two[:-1] << 8 | codes[2:]
    rest = DIMENSIONS - 256
    two = ((two * np.uint32(2654435761)) >> np.uint32(8)) % rest
    three = ((three * np.uint32(2246822519)) >> np.uint32(7)) % rest
    counts[_SPACE] = 0
    grams = np.bincount(two, minlength=rest) + np.bincount(three, minlength=rest)
    vector = np.sqrt(np.concatenate([counts, grams]))
    norm = np.linalg.norm(vector)
    return np.append(vector / norm if norm else vector, 0.1).astype(np.float32)


def train_line(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 30) -> np.ndarray:
    """Linear support vector machine by dual coordinate descent (squared hinge loss).

    One row of ``x`` at a time is held in double precision.
    """
    w = np.zeros(x.shape[1])
    alpha = np.zeros(len(y))
    diagonal = np.array([np.square(row, dtype=np.float64).sum() for row in x]) + 0.5 / cost
    order = np.random.default_rng(0)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(y)):
            row = x[i].astype(np.float64)
            gradient = y[i] * (row @ w) - 1 + alpha[i] * 0.5 / cost
            step = max(alpha[i] - gradient / diagonal[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * row
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w.astype(np.float32)


def group_families(languages: list[str], centres: np.ndarray) -> tuple[tuple[str, ...], ...]:
    """Join the most similar groups (average linkage) until about sqrt(n) are left."""
    groups = [[i] for i in range(len(languages))]
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T
    while len(groups) > max(1, round(len(languages) ** 0.5)):
        a, b = max(combinations(range(len(groups)), 2),
                   key=lambda p: (near[np.ix_(groups[p[0]], groups[p[1]])].mean(), -p[0], -p[1]))
        groups[a] += groups.pop(b)
    return tuple(sorted(tuple(sorted(languages[i] for i in g)) for g in groups))


def _profiles(batches):
    for batch in pieces(batches):
        yield pd.DataFrame({"lang": batch["lang"], "place": batch["place"],
                            "vector": [profile(t) for t in batch["text"]]})


def _centre(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("place")
    return pd.DataFrame({"lang": rows["lang"].iloc[:1],
                         "centre": [np.mean(np.stack(rows["vector"]).astype(np.float64), axis=0)]})


def _line(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["positive", "lang", "place"])
    y = np.where(rows["positive"], 1.0, -1.0)
    out = rows[["scope", "a", "b"]].iloc[:1].copy()
    out["line"] = [train_line(np.stack(rows["vector"]), y)]
    return out


def sample_rows(labelled: DataFrame, max_rows: int = MAX_ROWS_PER_LANGUAGE) -> DataFrame:
    """At most ``max_rows`` rows of each language, chosen by a hash of the text.

    ``labelled`` has ``text`` and ``lang``. A first cut by share keeps what is
    shuffled near the bound, however large a language is.
    """
    counts = labelled.groupBy("lang").agg(F.count("*").alias("__n"))
    draw = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = lookup_join(labelled.withColumn("__draw", draw), counts, ["lang"], spread_by=["__draw"]) \
        .filter(F.col("__draw") < 3.0 * max_rows / F.col("__n"))
    first = Window.partitionBy("lang").orderBy("__draw", "text")
    return (near.withColumn("place", F.row_number().over(first))
            .filter(F.col("place") <= max_rows).select("lang", "place", "text"))


def fit_language_model(labelled: DataFrame, max_rows: int = MAX_ROWS_PER_LANGUAGE) -> LanguageModel:
    """Fit on (text, lang) rows; rows without language or letter are left out.

    The sample is bounded by ``max_rows`` for each language. Profiles, means
    and machines are computed in tasks, one task per language or pair; only
    means and weights come to the driver.
    """
    usable = labelled.select("text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = written(
        sample_rows(usable, max_rows).mapInPandas(_profiles, "lang string, place int, vector array<float>"),
        "language-profiles")
    means = sorted((r["lang"], r["centre"]) for r in rows.groupBy("lang").applyInPandas(
        _centre, "lang string, centre array<double>").collect())
    if not means:
        return LanguageModel((), {}, {})
    languages = [name for name, _ in means]
    families = group_families(languages, np.array([c for _, c in means]))
    pairs = [("family", str(a), str(b), name, side)
             for a, b in combinations(range(len(families)), 2)
             for side, f in ((True, a), (False, b)) for name in families[f]]
    pairs += [("language", a, b, name, name == a)
              for family in families for a, b in combinations(family, 2) for name in (a, b)]
    if not pairs:
        return LanguageModel(families, {}, {})
    spark = labelled.sparkSession
    plan = spark.createDataFrame(pairs, "scope string, a string, b string, lang string, positive boolean")
    lines = rows.join(plan, "lang").groupBy("scope", "a", "b").applyInPandas(
        _line, "scope string, a string, b string, line array<float>").collect()
    return LanguageModel(
        families,
        {(int(r["a"]), int(r["b"])): np.array(r["line"], np.float32) for r in lines if r["scope"] == "family"},
        {(r["a"], r["b"]): np.array(r["line"], np.float32) for r in lines if r["scope"] == "language"})


def _vote(vector: np.ndarray, classes: list, lines: dict) -> tuple[object, float]:
    """Winner of all pairs and how sure its closest pair is (0.5 to 1 for a clear winner)."""
    if len(classes) == 1:
        return classes[0], 1.0
    votes = dict.fromkeys(classes, 0)
    margins = dict.fromkeys(classes, 0.0)
    least: dict = dict.fromkeys(classes, np.inf)
    for (a, b) in combinations(classes, 2):
        m = float(vector @ lines[a, b])
        votes[a if m >= 0 else b] += 1
        for name, side in ((a, m), (b, -m)):
            margins[name] += side
            least[name] = min(least[name], side)
    best = min(classes, key=lambda c: (-votes[c], -margins[c], str(c)))
    return best, 1 / (1 + float(np.exp(-np.clip(3 * least[best], -30, 30))))


def predict_text(text: str | None, model: LanguageModel) -> tuple[str, float]:
    if not model.families or not has_letter(text):
        return UNKNOWN, 0.0
    vector = profile(text)
    family, sure = _vote(vector, list(range(len(model.families))), model.family_lines)
    language, within = _vote(vector, list(model.families[family]), model.language_lines)
    return language, sure * within


def predict_language(df: DataFrame, model: LanguageModel, id_col: str, text_col: str,
                     carry: dict[str, Column] | None = None) -> DataFrame:
    """``id, lang_pred, score`` of each row, with the columns of ``carry``."""
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                     *[c.alias(n) for n, c in (carry or {}).items()])
    schema = kept.drop("text").schema.add("lang_pred", "string").add("score", "double")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in arrow_pieces(batches):
            found = [predict_text(t, fitted) for t in batch.column("text").to_pylist()]
            yield replaced(batch, "text", lang_pred=pa.array([f[0] for f in found], pa.string()),
                           score=pa.array([f[1] for f in found], pa.float64()))

    return kept.mapInArrow(freed(run), schema)


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str, least_score: float) -> DataFrame:
    """The rows whose text has a language with at least this score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in arrow_pieces(batches):
            found = [predict_text(t, fitted) for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))

    return df.mapInArrow(freed(run), df.schema)


def held_out(id_column: str | Column) -> Column:
    """Documents that no fit may use: crc32 of the id as text, modulo 4, is 2."""
    key = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
