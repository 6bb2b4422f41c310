"""URL filter: rules for hosts and paths first, then a logistic regression on hashed character n-grams.

The model is fitted on a bounded sample of labelled URLs (``MOST_LABELLED`` of each label) and has ``BUCKETS`` weights,
whatever the table's size; every URL is judged inside the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangelake.llm import words

# fixed values: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: Labelled URLs of each label that the model is fitted on, the first by hash.
MOST_LABELLED = 2000
BUCKETS = 1 << 16
SIZES = (3, 4, 5)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, upper.lower()), F.regexp_extract(text, pattern, 2)


def with_rules(urls: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``urls`` (host, path, ...) and the longest fitting rule with its verdict, both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for word, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later, longer ones win
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def _features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """URL, bucket and weight of each n-gram of ``host`` and of ``path``; the squares of a URL's weights sum to 1."""
    rows, buckets = [], []
    for salt, column in enumerate((host, path)):
        data, offsets = words.flat(column)
        owner = np.repeat(np.arange(len(column)), np.diff(offsets))
        values = words._BYTES[data]
        for n in SIZES:
            h = np.zeros(max(len(data) - n + 1, 0), np.uint64) + np.uint64(salt * 16 + n)
            for k in range(n):
                h = (h + values[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            whole = owner[: len(h)] == owner[n - 1 :] if len(h) else np.zeros(0, bool)
            rows.append(owner[: len(h)][whole])
            buckets.append((words.mix(h[whole]) % np.uint64(BUCKETS)).astype(np.int64))
    row, bucket = np.concatenate(rows), np.concatenate(buckets)
    return row, bucket, 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(host)), 1))[row]


def fit(labelled: list[tuple[str, str, bool]], rounds: int = 200, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the constant, from (host, path, blocked). With one label only or none: weights of zero."""
    weights = np.zeros(BUCKETS + 1)
    blocked = np.array([x[2] for x in labelled], float)
    if not 0 < blocked.sum() < len(blocked):
        weights[-1] = 0.0 if not len(blocked) else 4.0 if blocked[0] else -4.0
        return weights
    row, bucket, value = _features(pa.array([x[0] for x in labelled], pa.string()), pa.array([x[1] for x in labelled], pa.string()))
    for _ in range(rounds):
        logit = np.bincount(row, weights[bucket] * value, len(labelled)) + weights[-1]
        error = (1 / (1 + np.exp(-logit)) - blocked) / len(labelled)
        weights[:-1] -= rate * (np.bincount(bucket, error[row] * value, BUCKETS) + decay * weights[:-1])
        weights[-1] -= rate * error.sum()
    return weights


def rule_labels(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """A labelled URL table from the rules themselves: (host, path, blocked) of the distinct URLs that one fits."""
    host, path = host_and_path()
    known = with_rules(pages.select(host.alias("host"), path.alias("path")), rules).where("rule is not null")
    return known.select("host", "path", (F.col("rule_verdict") == "block").alias("blocked")).distinct()


def train(labelled: DataFrame, most: int = MOST_LABELLED) -> np.ndarray:
    """Fit on the first ``most`` labelled URLs of each label by hash: at most 2 * ``most`` rows reach the driver."""
    rows = []
    for label in (True, False):
        some = labelled.where(F.col("blocked") == label).orderBy(F.xxhash64("host", "path"), "host", "path").limit(most)
        rows += [(r["host"] or "", r["path"] or "", r["blocked"]) for r in some.select("host", "path", "blocked").collect()]
    return fit(rows)


def judge(pages: DataFrame, weights: np.ndarray, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's log odds of block) of every page.

    A null url, or one without ``://``, has an empty host and path and gets the model's verdict for these. Repeated rows
    are judged each; null ids stay null; further columns are left out; an empty table gives an empty table.
    """
    host, path = host_and_path()
    ruled = with_rules(pages.select("page_id", host.alias("host"), path.alias("path")), rules)
    page_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path = batch.column("host"), batch.column("path")
            row, bucket, value = _features(host, path)
            logit = np.bincount(row, weights[bucket] * value, batch.num_rows) + weights[-1] if batch.num_rows else np.zeros(0)
            own = ["block" if x > 0 else "allow" for x in logit]
            verdict = [r if r is not None else o for r, o in zip(batch.column("rule_verdict").to_pylist(), own)]
            yield pa.record_batch([batch.column("page_id"), host, path, batch.column("rule"), pa.array(verdict, pa.string()), pa.array(logit, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    return ruled.mapInArrow(run, f"page_id {page_type}, host string, path string, rule string, verdict string, score double")
