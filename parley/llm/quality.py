"""Document quality: a text classifier combined with host and path rates by empirical Bayes.

1. A logistic model on the shape of a text is fitted on a bounded sample of labelled
   documents. It gives each document its own evidence (log odds of good quality).
2. Grouped aggregation sums the expected good documents per path, per host and overall. The
   spread between groups, beyond what their sizes explain, gives each level's prior strength;
   host rates shrink towards the overall rate, path rates towards their host's.
3. A document's odds are its own evidence, with its path's posterior odds in place of the
   overall ones. A sparse path says little and leaves the document's evidence as it is.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import as_bytes, map_batches, only, written
from parley.llm.toxicity import held_out

#: Labelled documents that the classifier is fitted on, at most.
EXAMPLES = 16_000
#: Documents below this probability of good quality are rejected.
ACCEPT = 0.5
#: Bounds of a prior strength, in documents.
WEAKEST, STRONGEST = 10.0, 1e6

SYMBOLS = b"#*$%&|<>{}[]\\^~_=+@"
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))


def shape(text: bytes | None) -> list[float]:
    """Bounded numbers on a text's form; a text without words gets the same as a null."""
    words = text.split() if text else []
    if not words:
        return [0.0] * 9
    count, size = len(words), sum(map(len, words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    again = sum(map(operator.eq, words, words[1:])) / count
    # A text's distinct words against what a text of its length usually has.
    usual = len(set(words)) / count**0.85
    return [
        np.log1p(count) / 5,
        min(1.0, 5 * share(SYMBOLS)),
        min(1.0, 5 * share(b"!?")),
        min(1.0, 2 * share(CAPITALS)),
        min(1.0, 5 * share(DIGITS)),
        min(2.0, size / count / 6),
        min(1.0, 4 * again),
        1 - len(set(lines)) / len(lines),
        min(2.0, usual),
    ]


FEATURES = len(shape(None))
#: Groups of host and path whose rates are broadcast, about 100 bytes each; more are joined with narrow rows.
MOST_GROUPS = 500_000


def scored(
    documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", examples: int = EXAMPLES
) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, score, kept), one row per row of ``documents``.

    ``documents`` has doc_id, text and the named host and path columns; null hosts and paths
    are groups like others. Null and empty texts are judged by their shape (no words). Of
    contradicting labels of one doc_id the good one counts. Without labels of both kinds the
    evidence is 0 for all, and everything is kept.
    """
    model = _fitted(documents, labels, examples)
    evidence = written(_evidence(documents, model, host, path), "evidence")
    rated = evidence.join(_rates(evidence), _same_group(evidence, "host", "path"), "left")
    return rated.select(
        "doc_id", "evidence", "host_rate", "path_rate", _posterior().alias("score"), (_posterior() >= ACCEPT).alias("kept")
    )


def accepted(
    documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", examples: int = EXAMPLES
) -> DataFrame:
    """The rows of ``documents`` that are kept, all columns kept."""
    model = _fitted(documents, labels, examples)

    @F.pandas_udf("double")
    def judge(texts):
        import pandas as pd

        return pd.Series([_log_odds(text, model) for text in texts], dtype=float)

    names = documents.columns
    numbered = {"__evidence": judge(as_bytes(documents["text"])), "__row": F.monotonically_increasing_id()}
    judged = written(documents.withColumns(numbered), "judged")
    odds = F.greatest(F.least(F.col("__evidence"), F.lit(30.0)), F.lit(-30.0))
    groups = [F.col(f"`{n}`").cast("string").alias(alias) for n, alias in ((host, "host"), (path, "path"))]
    narrow = judged.select("__row", "__evidence", *groups, (1 / (1 + F.exp(-odds))).alias("good"))
    rates = written(_rates(narrow).select(F.struct("*").alias("__rates")), "rates")
    # Null-safe conditions on columns of unknown names: the narrow side is named apart.
    narrow = narrow.select("__row", F.col("__evidence").alias("evidence"), F.col("host").alias("__host"), F.col("path").alias("__path"))
    same = F.col("__host").eqNullSafe(F.col("__rates.group_host")) & F.col("__path").eqNullSafe(F.col("__rates.group_path"))
    if rates.count() <= MOST_GROUPS:
        # As many rows as groups, which has just been checked: texts stay where they are.
        own = judged.withColumns({"__host": F.col(f"`{host}`").cast("string"), "__path": F.col(f"`{path}`").cast("string")})
        kept = own.join(F.broadcast(rates), same, "left").filter(_posterior("__rates.", "__evidence") >= ACCEPT)
    else:
        kept = narrow.join(rates, same, "left").filter(_posterior("__rates.", "evidence") >= ACCEPT)
        kept = judged.join(kept.select("__row"), "__row", "left_semi")
    return kept.select(*[F.col(f"`{n}`") for n in names])


def _same_group(df: DataFrame, host: str, path: str) -> Column:
    return df[host].eqNullSafe(F.col("group_host")) & df[path].eqNullSafe(F.col("group_path"))


def _posterior(prefix: str = "", evidence: str = "evidence") -> Column:
    """The document's odds with its path's rate in place of the overall rate."""
    own, path, all_ = F.col(evidence), F.col(f"{prefix}path_rate"), F.col(f"{prefix}rate")
    odds = own + F.log(path / (1 - path)) - F.log(all_ / (1 - all_))
    return 1 / (1 + F.exp(-odds))


def _log_odds(text: bytes | None, model: np.ndarray | None) -> float:
    return float(np.dot(model[:-1], shape(text)) + model[-1]) if model is not None else 0.0


def _fitted(documents: DataFrame, labels: DataFrame, examples: int) -> np.ndarray | None:
    """Weights and shift of the logistic model, fitted on the sample's shapes."""
    chosen = (
        only(labels, "doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").filter(~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    )
    texts = only(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def shapes(batches):
        for batch in batches:
            yield {
                "doc_id": pa.array(batch["doc_id"], pa.int64()),
                "quality": pa.array(batch["quality"], pa.int32()),
                "shape": pa.array([shape(text) for text in batch["text"]], pa.list_(pa.float64())),
            }

    source = texts.select("doc_id", as_bytes("text").alias("text"), F.col("quality").cast("int").alias("quality"))
    shaped = map_batches(source, shapes, "doc_id bigint, quality int, shape array<double>")
    # One example per doc_id, also where rows repeat one: at most ``examples`` short rows.
    rows = shaped.groupBy("doc_id").agg(F.min("shape").alias("shape"), F.max("quality").alias("quality")).collect()
    if len({row["quality"] for row in rows}) < 2:
        return None
    rows.sort(key=lambda row: row["doc_id"])
    x = np.array([row["shape"] + [1.0] for row in rows])
    return _logistic(x, np.array([row["quality"] for row in rows], float))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a weak ridge."""
    fit = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        gradient = x.T @ (y - p) - 0.1 * fit
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * ridge
        step = np.linalg.solve(curve, gradient)
        fit = fit + step
        if np.abs(step).max() < 1e-8:
            break
    return fit


def _evidence(documents: DataFrame, model: np.ndarray | None, host: str, path: str) -> DataFrame:
    """(doc_id, host, path, evidence, good): log odds and probability by the text alone."""

    def judge(batches):
        for batch in batches:
            found = np.array([_log_odds(text, model) for text in batch["text"]])
            yield {
                "doc_id": pa.array(batch["doc_id"], pa.int64()),
                "host": pa.array(batch["host"], pa.string()),
                "path": pa.array(batch["path"], pa.string()),
                "evidence": found,
                "good": 1 / (1 + np.exp(-np.clip(found, -30, 30))),
            }

    source = documents.select(
        "doc_id",
        F.col(host).cast("string").alias("host"),
        F.col(path).cast("string").alias("path"),
        as_bytes("text").alias("text"),
    )
    return map_batches(source, judge, "doc_id bigint, host string, path string, evidence double, good double")


def _rates(evidence: DataFrame) -> DataFrame:
    """(group_host, group_path, host_rate, path_rate, rate): shrunken rates of each path."""
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    all_ = hosts.agg(F.sum("host_n"), F.sum("host_good")).first()
    total, rate = all_[0] or 0, min(max((all_[1] or 0.0) / (all_[0] or 1), 1e-3), 1 - 1e-3)
    strength = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good"), F.lit(rate).alias("mean")))
    host_rate = (F.col("host_good") + strength * rate) / (F.col("host_n") + strength)
    hosts = hosts.select(F.col("host").alias("group_host"), host_rate.alias("host_rate"))
    within = paths.join(hosts, paths["host"].eqNullSafe(hosts["group_host"]))
    strength = _strength(within.select("n", "good", F.col("host_rate").alias("mean")))
    path_rate = (F.col("good") + strength * F.col("host_rate")) / (F.col("n") + strength)
    return within.select(
        "group_host", F.col("path").alias("group_path"), "host_rate", path_rate.alias("path_rate"), F.lit(rate).alias("rate")
    )


def _strength(groups: DataFrame) -> float:
    """A level's prior strength in documents, by the method of moments.

    The squared deviations of the groups from their prior means are what sampling explains,
    plus a part that a share 1 / (1 + strength) of the variance makes up.
    """
    variance = F.col("mean") * (1 - F.col("mean"))
    deviation = F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("mean"), 2)
    seen = groups.agg(F.sum(deviation / variance), F.count("*"), F.sum("n")).first()
    if not seen[1]:
        return STRONGEST
    excess, more = seen[0] - seen[1], float(seen[2] - seen[1])
    share = excess / more if more > 0 else 0.0
    return STRONGEST if share <= 1 / STRONGEST else min(max(1 / share - 1, WEAKEST), STRONGEST)
