"""Mixing sources to target weights by iterative proportional fitting.

Token counts by (source, language, topic) are raked: scaled along one dimension after the other until each dimension's
totals stand in the target ratios. A cell's scaled over its natural count is its factor; documents are then kept with a
probability proportional to the factor, so that the kept tokens meet all three targets at once in expectation.

Cells are formed over the categories that the targets name, and one for all others, so their number is bounded by the
targets and not by the data; only they reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideboard.llm.common import staged, table, uniform

OTHER = "other"
WORD = r"[^\x20\x09-\x0D]+"
#: Topics of invented prose: which family of word endings occurs most in the whole text; first named wins ties.
TOPIC_ENDINGS = {"deeds": ("ing ", "ed ", "er "), "states": ("tion ", "ung ", "ment "), "things": ("an ", "on ", "en "), "kinds": ("ly ", "ble ", "es ")}


@dataclass(frozen=True)
class Mix:
    """Target shares by dimension; what a dimension leaves of 1 goes to categories that it doesn't name. ``keep`` is
    the share of all tokens to keep, ``rounds`` the number of fitting rounds."""

    targets: dict[str, dict[str, float]]
    keep: float = 0.4
    rounds: int = 12
    seed: int = 9
    dims: tuple[str, ...] = field(default=("source", "lang", "topic"))


PRODUCTION = Mix(
    {
        "source": {"src0": 0.15} | {f"src{k}": 0.044 for k in range(1, 20)},
        "lang": {"en": 0.52, "de": 0.18, "fr": 0.16, "es": 0.12},
        "topic": {"deeds": 0.3, "states": 0.02, "things": 0.4, "kinds": 0.2},
    }
)


def with_topic(docs: DataFrame, name: str = "topic") -> DataFrame:
    """The rows with the topic of their text. The counts are columns of their own first, so that each is taken once."""
    text = F.col("text")
    counts = {
        f"{name} {t}": sum(((F.length(text) - F.length(F.replace(text, F.lit(e)))) / len(e) for e in endings), F.lit(0.0))
        for t, endings in TOPIC_ENDINGS.items()
    }
    best = F.greatest(*map(F.col, (f"`{c}`" for c in counts)))
    out = F.when(F.coalesce(best, F.lit(0.0)) == 0, F.lit(OTHER))
    for t in TOPIC_ENDINGS:
        out = out.when(F.col(f"`{name} {t}`") == best, F.lit(t))
    return docs.withColumns(counts).withColumn(name, out).drop(*counts)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def rake(counts: np.ndarray, targets: list[np.ndarray], rounds: int) -> np.ndarray:
    """Counts scaled so that the totals along each axis near its target shares. A category without counts can't be
    met; its share is spread over the others of its axis."""
    fitted, whole = counts.astype(float), float(counts.sum())
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            other = tuple(k for k in range(counts.ndim) if k != axis)
            held = fitted.sum(axis=other)
            want = np.where(held > 0, target, 0.0)
            if want.sum() == 0:
                continue
            scale = np.divide(whole * want / want.sum(), held, out=np.zeros_like(held), where=held > 0)
            fitted *= np.expand_dims(scale, other)
    return fitted


def probabilities(counts: np.ndarray, fitted: np.ndarray, keep: float) -> np.ndarray:
    """min(1, r * fitted / counts), with r such that the expected kept tokens are ``keep`` of all, or all there are."""
    factor = np.divide(fitted, counts, out=np.zeros_like(fitted), where=counts > 0)
    order = np.argsort(-factor, axis=None, kind="stable")
    f, n = factor.flat[order], counts.flat[order].astype(float)
    budget, full = keep * n.sum(), 0.0
    rate = 0.0
    for k in range(f.size):
        rest = float((f[k:] * n[k:]).sum())
        if rest <= 0:
            break
        rate = max(0.0, budget - full) / rest
        if rate * f[k] <= 1:
            break
        full += n[k]
    return np.minimum(1.0, rate * factor)


def cells_of(weighed: DataFrame, mix: Mix) -> tuple[np.ndarray, list[list[str]]]:
    """Token totals as an array with one axis per dimension; bounded by the targets."""
    names = [[*mix.targets[d], OTHER] for d in mix.dims]
    counts = np.zeros([len(x) for x in names])
    place = [{c: i for i, c in enumerate(x)} for x in names]
    rows = weighed.groupBy(*(f"{d}_cell" for d in mix.dims)).agg(F.sum("n_tokens").alias("n")).collect()
    for r in rows:
        counts[tuple(place[k][r[f"{d}_cell"]] for k, d in enumerate(mix.dims))] += r["n"]
    return counts, names


def weighed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    narrow = with_topic(docs.select("doc_id", "source", "lang", "text")).select(
        "doc_id", "source", "lang", "topic", n_words(F.col("text")).alias("n_tokens"),
        uniform(mix.seed, F.col("doc_id")).alias("draw"),
    )
    return narrow.withColumns(
        {f"{d}_cell": F.when(F.col(d).isin(list(mix.targets[d])), F.col(d)).otherwise(OTHER) for d in mix.dims}
    )


def mix_documents(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept: one row for each document.

    ``weight`` is the cell's factor, ``probability`` the chance to be kept, ``kept`` the draw, decided by seed and
    doc_id alone. Null or unnamed sources and languages are the category "other"; null, empty and blank texts have no
    tokens, no topic ending and count as "other"; a document in a cell without any tokens has weight and probability 0.
    Rows with equal doc_id (or none) share a draw. An empty table gives no rows. Other columns are not read."""
    spark = docs.sparkSession
    weighed = staged(weighed_documents(docs, mix), "mix-documents")
    counts, names = cells_of(weighed, mix)
    targets = []
    for d in mix.dims:
        named = list(mix.targets[d].values())
        targets.append(np.array([*named, max(0.0, 1 - sum(named))]))
    fitted = rake(counts, targets, mix.rounds)
    chance = probabilities(counts, fitted, mix.keep)
    rows = [
        (*(names[k][i] for k, i in enumerate(at)), float(fitted[at] / counts[at]), float(chance[at]))
        for at in map(tuple, np.argwhere(counts > 0).tolist())
    ]
    schema = ", ".join([*(f"{d}_cell string" for d in mix.dims), "factor double", "chance double"])
    known = F.broadcast(spark.createDataFrame(rows, schema))  # a row per cell, bounded by the targets
    chance_of = F.coalesce("chance", F.lit(0.0))
    return weighed.join(known, [f"{d}_cell" for d in mix.dims], "left").select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round(F.coalesce("factor", F.lit(0.0)), 6).alias("weight"),
        F.round(chance_of, 6).alias("probability"), (F.col("draw") < chance_of).alias("kept"),
    )


def sample_documents(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """The kept documents, all columns. Rows that share a doc_id are kept or dropped by the cell of each, so they are
    matched on id, source, language and topic; a match is null-safe."""
    mixed = staged(mix_documents(docs, mix), "mix-kept")
    named = mixed.filter("kept").select(*(F.col(c).alias(f"kept_{c}") for c in ("doc_id", "source", "lang", "topic"))).distinct()
    own = "topic of the sampled text"
    of = {"doc_id": F.col("doc_id"), "source": F.col("source"), "lang": F.col("lang"), "topic": F.col(f"`{own}`")}
    match = [named[f"kept_{c}"].eqNullSafe(x) for c, x in of.items()]
    return with_topic(docs, own).join(named, match, "left_semi").drop(own)


def mix_sql(mix: Mix = PRODUCTION) -> str:
    """The same rows by DuckDB."""

    def quoted(d):
        return ", ".join(f"'{c}'" for c in mix.targets[d])

    hits = {t: " + ".join(f"(length(text) - length(replace(text, '{e}', ''))) / {len(e)}.0" for e in ends) for t, ends in TOPIC_ENDINGS.items()}
    best = f"greatest({', '.join(f'n_{t}' for t in hits)})"
    labels = " ".join(f"WHEN n_{t} = {best} THEN '{t}'" for t in hits)
    cells = ", ".join(f"CASE WHEN {d} IN ({quoted(d)}) THEN {d} ELSE '{OTHER}' END AS {d}_cell" for d in mix.dims)
    keys = ", ".join(f"{d}_cell" for d in mix.dims)
    steps, last = [], "cells"
    for r in range(mix.rounds):
        for d in mix.dims:
            left = max(0.0, 1 - sum(mix.targets[d].values()))
            share = " ".join(f"WHEN '{c}' THEN {v!r}::DOUBLE" for c, v in mix.targets[d].items())
            want = f"CASE {d}_cell {share} ELSE {left!r}::DOUBLE END"
            name = f"fit_{r}_{d}"
            steps.append(
                f"{name} AS (SELECT {keys}, n, w * whole * want / sum(CASE WHEN first THEN want ELSE 0 END) OVER () / held AS w, whole FROM "
                f"(SELECT *, {want} AS want, sum(w) OVER (PARTITION BY {d}_cell) AS held, "
                f"row_number() OVER (PARTITION BY {d}_cell ORDER BY {keys}) = 1 AS first FROM {last}) x)"
            )
            last = name
    return f"""
WITH counted AS (SELECT *, {', '.join(f'{x} AS n_{t}' for t, x in hits.items())} FROM documents),
named AS (SELECT doc_id, source, lang, CASE WHEN coalesce({best}, 0) = 0 THEN '{OTHER}' {labels} END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
  ('0x' || substr(md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / {float(1 << 48)} AS draw FROM counted),
weighed AS (SELECT *, {cells} FROM named),
cells AS (SELECT {keys}, sum(n_tokens)::DOUBLE AS n, sum(n_tokens)::DOUBLE AS w, sum(sum(n_tokens)) OVER ()::DOUBLE AS whole
  FROM weighed GROUP BY ALL HAVING sum(n_tokens) > 0),
{', '.join(steps)},
factors AS (SELECT {keys}, n, w / n AS f FROM {last}),
ranked AS (SELECT *, row_number() OVER o AS k, sum(n) OVER () AS total, sum(f * n) OVER (ORDER BY f DESC, {keys} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  sum(n) OVER (o ROWS UNBOUNDED PRECEDING) - n AS filled FROM factors WINDOW o AS (ORDER BY f DESC, {keys})),
rate AS (SELECT arg_min(r, k) AS r FROM (SELECT k, f, greatest(0, {mix.keep!r} * total - filled) / rest AS r FROM ranked) x WHERE r * f <= 1),
chances AS (SELECT {keys}, f, least(1, r * f) AS p FROM factors, rate)
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(f, 0), 6) AS weight, round(coalesce(p, 0), 6) AS probability,
  draw < coalesce(p, 0) AS kept FROM weighed LEFT JOIN chances USING ({keys})"""


def op9_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_raking": op9_raking}
TWINS = {"op9_raking": mix_sql()}
