"""Language-model scores by deleted interpolation of word bigrams, words and a uniform share.

P(w | h) = l2 c(h w) / c(h) + l1 c(w) / N + l0 / (V + 1), where the weights l depend on how often the context h was seen
(one set for each power of two) and are learned by expectation-maximisation on counts held out from the training part:
a fold is deleted, frequencies come from the rest, and the fold's bigrams are what the mixture should explain.

Counts cover the whole corpus. Documents form blocks by their own hash; each block asks the buckets of a hash range for
its distinct n-grams once (with its own counts, so sums are made before the shuffle) and gets their totals back. A word
that makes up a third of all tokens is one row a block. Only the totals, the weights and a histogram of fixed size ever
reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangelake.llm import packs, words

FOLDS = 5
HELD_OUT, DELETED = 1, 2
#: Block groups: training, scored only, deleted while the weights are learned.
TRAIN, OUT, DROP = 0, 1, 2
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
#: Steps per octave of the histogram of frequencies that the weights are learned on.
STEPS = 4
LEVELS = 41
_U = np.uint64
_END = _U(0x5DEECE66D1234567)


@dataclass(frozen=True)
class Model:
    #: Totals of the n-grams of each block of ``blocks``.
    answers: DataFrame
    blocks: int
    tokens: int
    types: int
    #: Weights (bigram, word, uniform) for each power of two of the context's count.
    weights: np.ndarray


def fold() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _group() -> Column:
    return F.when(fold() == HELD_OUT, OUT).when(fold() == DELETED, DROP).otherwise(TRAIN)


def _tokens(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (odd) of the texts, an end after each, and n+1 bounds."""
    data, offsets = words.flat(texts)
    parts, sizes = [], []
    for low, high in words.slices(offsets):
        part = words.LOWER[data[offsets[low] : offsets[high]]]
        starts, ends, bounds = words.cut(part, offsets[low : high + 1] - offsets[low])
        h = words.hashes(part, starts, ends) | _U(1)
        parts.append(np.insert(h, bounds[1:], _END | _U(1)))
        sizes.append(np.diff(bounds) + 1)
    if not parts:
        return np.zeros(0, _U), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _ngrams(token: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and bigram hash (even) of each token; a text's first token follows an end."""
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[bounds[:-1]] = _END | _U(1)
    return context, words.mix(words.mix(context) + token * _U(0x9E3779B97F4A7C15)) & ~_U(1)


def _squeeze(values: np.ndarray) -> bytes:
    """Sorted hashes or counts: differences for hashes, bytes of equal weight together, zstandard."""
    wide = values.astype(_U) if values.dtype != _U else np.diff(values, prepend=_U(0))
    return zstandard.compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _expand(raw: bytes, sums: bool) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    wide = np.ascontiguousarray(planes.T).view(_U).ravel()
    return np.cumsum(wide, dtype=_U) if sums else wide.astype(np.int64)


def _block_texts(table: pa.Table) -> pa.Table:
    return pa.concat_tables([packs.unpack(p) for p in table.column("pack").combine_chunks()])


def counted(docs: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """Answers (bucket, block, total, deleted) and, with block -1, sums (tokens, types) of each bucket."""

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        token, bounds = _tokens(_block_texts(table).column("text"))
        _, bigram = _ngrams(token, bounds)
        found, n = np.unique(np.concatenate([token, bigram]), return_counts=True)
        cuts = np.searchsorted(found, np.array([(b << 64) // buckets for b in range(buckets)], _U))
        rows = [(b, _squeeze(found[x:y]), _squeeze(n[x:y])) for b, x, y in zip(range(buckets), cuts, [*cuts[1:], len(found)]) if y > x]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "block", "ngrams", "counts"])

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        ngrams = [_expand(x.as_py(), True) for x in table.column("ngrams")]
        counts = np.concatenate([_expand(x.as_py(), False) for x in table.column("counts")])
        sizes = np.array([len(x) for x in ngrams])
        found, which = np.unique(np.concatenate(ngrams), return_inverse=True)
        group = np.repeat(block % 3, sizes)
        total = np.bincount(which, np.where(group == OUT, 0, counts), len(found)).astype(np.int64)
        deleted = np.bincount(which, np.where(group == DROP, counts, 0), len(found)).astype(np.int64)
        word = (found & _U(1)).astype(bool)
        at = np.concatenate([[0], np.cumsum(sizes)])
        rows = [(int(b), _squeeze(total[which[x:y]]), _squeeze(deleted[which[x:y]]) if b % 3 == DROP else None, None, None, None) for b, x, y in zip(block, at[:-1], at[1:])]
        rows.append((-1, None, None, int(total[word].sum()), int((total[word] > 0).sum()), int(deleted[word].sum())))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int32()), *columns], ["bucket", "block", "total", "deleted", "tokens", "types", "dropped"])

    asked = packs.packed(docs, blocks, _group(), 3).groupBy("block").applyInArrow(ask, "bucket int, block int, ngrams binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(answer, "bucket int, block int, total binary, deleted binary, tokens long, types long, dropped long")


def _block_counts(texts: pa.Table, answers: pa.Table, columns: list[str]) -> tuple[np.ndarray, ...]:
    """Bounds, and for each column the counts of each token, its context and its bigram."""
    token, bounds = _tokens(texts.column("text"))
    _, bigram = _ngrams(token, bounds)
    answers = answers.sort_by("bucket")
    place = np.unique(np.concatenate([token, bigram]), return_inverse=True)[1]
    place, pair = place[: len(token)], place[len(token) :]
    context = np.empty_like(place)
    context[1:] = place[:-1]
    context[bounds[:-1]] = place[bounds[1] - 1]  # an end
    places = [place, context, pair]
    out = [bounds]
    for c in columns:
        values = np.concatenate([_expand(x.as_py(), False) for x in answers.column(c)])
        out += [values[p] for p in places]
    return tuple(out)


def _level(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(float))[1], LEVELS - 1)


def _step(f: np.ndarray) -> np.ndarray:
    """Logarithmic step of a frequency; 1 stands for none."""
    return np.where(f > 0, np.round(STEPS * np.log2(np.maximum(f, 1e-18))), 1).astype(np.int32)


def learn(docs: DataFrame, answers: DataFrame, blocks: int, tokens: int, types: int, dropped: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights by expectation-maximisation on the deleted fold's bigrams, grouped by level and frequencies.

    The histogram has at most ``LEVELS`` * (60 * STEPS)^2 cells, however long the corpus; the driver gets only it.
    """
    kept = max(tokens - dropped, 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cells = np.zeros((0, 3), np.int32)
        n = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            _, word, context, bigram, word_d, context_d, bigram_d = _block_counts(_block_texts(left), right, ["total", "deleted"])
            c_w, c_h, c_hw = word - word_d, context - context_d, bigram - bigram_d
            rows = np.stack([_level(c_h), _step(c_hw / np.maximum(c_h, 1)), _step(c_w / kept)], 1).astype(np.int32)
            cells, n = np.unique(rows, axis=0, return_counts=True)
        return pa.table([pa.array(cells[:, k], pa.int32()) for k in range(3)] + [pa.array(n, pa.int64())], ["level", "pair", "word", "n"])

    deleted = packs.packed(docs.where(fold() == DELETED), blocks, _group(), 3)
    got = answers.where((F.col("block") >= 0) & (F.col("block") % 3 == DROP)).select("bucket", "block", "total", "deleted")
    hist = deleted.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(run, "level int, pair int, word int, n long").groupBy("level", "pair", "word").agg(F.sum("n").alias("n"))
    rows = np.array([tuple(r) for r in hist.toLocalIterator()], float).reshape(-1, 4)
    weights = np.tile([0.4, 0.4, 0.2], (LEVELS, 1))
    weights[0] = [0.0, 0.7, 0.3]
    back = lambda s: np.where(s == 1, 0.0, 2.0 ** (s / STEPS))
    for level in range(LEVELS):
        own = rows[rows[:, 0] == level]
        if not len(own):
            continue
        f = np.stack([back(own[:, 1]), back(own[:, 2]), np.full(len(own), 1 / (types + 1))], 1)
        w = weights[level]
        for _ in range(rounds):
            part = w * f
            part = part / part.sum(1, keepdims=True) * own[:, 3:]
            w = part.sum(0) / own[:, 3].sum()
        weights[level] = 0.999 * w + 0.001 * np.array([0.0, 0.0, 1.0])  # no token is ever impossible
    return weights


def train(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> Model:
    """Count the n-grams of the training documents for every block of ``docs`` and learn the weights."""
    size = packs.text_bytes(docs)
    blocks = packs.block_count(size, block_bytes)
    answers = packs.stored(counted(docs, blocks, packs.block_count(size, bucket_bytes)))
    sums = answers.where("block < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "dropped"))).first()
    weights = learn(docs, answers, blocks, sums["tokens"], sums["types"], sums["dropped"])
    return Model(answers, blocks, sums["tokens"], sums["types"], weights)


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Tokens are the lower-cased (A-Z) words and an end. Documents whose crc32 of the id is 1 modulo 5 are scored only; all
    others are learned from. A null text is empty (one token, the end); a null id counts as an empty one; repeated rows
    are learned from and scored each; further columns are left out; an empty table gives an empty table; without any
    training text all scores are uniform. ``model`` is that of the same documents, if it is at hand.
    """
    model = model or train(docs)
    tokens, types, weights = model.tokens, model.types, model.weights
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        texts = _block_texts(left)
        bounds, word, context, bigram = _block_counts(texts, right, ["total"])
        base = np.log10((word + 0.5) / (tokens + 0.5 * (types + 1)))
        w = weights[_level(context)]
        p = w[:, 0] * bigram / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (types + 1)
        sums = lambda x: np.add.reduceat(x, bounds[:-1])
        n = texts.num_rows
        return pa.table([
            texts.column("doc_id"), pa.array([key[0].as_py() % 3 == OUT] * n, pa.bool_()), pa.array(np.diff(bounds), pa.int64()), pa.array(sums((word > 0).astype(np.int64)), pa.int64()),
            pa.array([tokens] * n, pa.int64()), pa.array(sums(base), pa.float64()), pa.array(sums(np.log10(p)), pa.float64()),
        ], names)

    got = model.answers.where("block >= 0").select("bucket", "block", "total")
    return packs.packed(docs, model.blocks, _group(), 3).groupBy("block").cogroup(got.groupBy("block")).applyInArrow(
        run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
