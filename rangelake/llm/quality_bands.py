"""Compression bands: zstandard ratios of whole documents and of fixed chunks, with limits by length.

Text that compresses far better than prose repeats itself; text that hardly compresses is noise. How well prose compresses
depends on its length, so every length class has its own band. Every document is judged alone, inside the task that
reads it: no shuffle, memory bounded by one slice of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from rangelake.llm import packs, words


@dataclass(frozen=True)
class Bands:
    """Limits of compressed over original bytes."""

    #: (bytes from which it holds, lowest ratio, highest ratio); shorter texts than the first have no verdict.
    whole: tuple[tuple[int, float, float], ...] = ((64, 0.40, 9.0), (256, 0.40, 0.90), (1024, 0.35, 0.80), (4096, 0.30, 0.75), (16384, 0.25, 0.75))
    #: Chunks are this long; what is left at the end counts when it is at least half as long.
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.30, 0.80)
    #: A document goes when more than this share of its chunks is outside the band.
    bad_chunks: float = 0.25
    level: int = 3
    min_words: int = 10
    max_repeat_percent: int = 20


#: Texts judged at a time: the arrays beside them take some twenty times as much, and workers keep what their largest arrays took.
SLICE_BYTES = 1 << 20

_SYMBOLS = words._table("#*$%&|<>", True)


def _repeated(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Per document, the words in n-word windows that the document has twice or more."""
    h, first, docs = words.window_hashes(words.hashes(data, starts, ends), bounds, n)
    key = words.mix(h + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, first[twice], 1)
    np.add.at(steps, first[twice] + n, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(steps[:-1]) > 0)])
    return covered[bounds[1:]] - covered[bounds[:-1]]


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _compression(raw: bytes, coder: zstandard.ZstdCompressor, bands: Bands) -> tuple[float, int, int, bool]:
    """Ratio, chunks, chunks outside the band, verdict (kept)."""
    if not raw:
        return 0.0, 0, 0, True
    ratio = len(coder.compress(raw)) / len(raw)
    limits = [b for b in bands.whole if len(raw) >= b[0]]
    kept = not limits or limits[-1][1] <= ratio <= limits[-1][2]
    cuts = [raw[i : i + bands.chunk_bytes] for i in range(0, len(raw), bands.chunk_bytes)] if len(raw) >= bands.chunk_bytes else []
    cuts = [c for c in cuts if 2 * len(c) >= bands.chunk_bytes]
    bad = sum(not bands.chunk[0] <= len(coder.compress(c)) / len(c) <= bands.chunk[1] for c in cuts)
    return ratio, len(cuts), bad, kept and bad <= bands.bad_chunks * len(cuts)


_COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"
)
_TYPES = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]


def judge(docs: DataFrame, bands: Bands = Bands(), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns of every document with its counts, ratios and verdict.

    Words are runs of other characters than white space. A null or empty text has no words and fails the base rule.
    Repeated rows are judged each on its own; nulls in carried columns stay; other columns, also of the names of
    the results, are left out. An empty table gives an empty table.
    """
    # a carried text goes to the tasks once
    source = docs.select(*carry) if "text" in carry else docs.select(*carry, docs["text"].alias("_text"))
    text = "text" if "text" in carry else "_text"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            data, offsets = words.flat(batch.column(text))
            for low, high in words.slices(offsets, SLICE_BYTES):
                at = offsets[low : high + 1] - offsets[low]
                part = data[offsets[low] : offsets[high]]
                starts, ends, bounds = words.cut(part, at)
                n_words = np.diff(bounds)
                sizes = np.concatenate([[0], np.cumsum(words.characters(part, starts, ends))])
                symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[part])])
                repeat = _repeated(part, starts, ends, bounds, 5)
                raw = [part[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                ratios = [_compression(r, coder, bands) for r in raw]
                failed = (n_words < bands.min_words) | (100 * repeat > bands.max_repeat_percent * n_words)
                kept = ~failed & np.array([r[3] for r in ratios], bool)
                out = [
                    n_words, sizes[bounds[1:]] - sizes[bounds[:-1]], symbols[at[1:]] - symbols[at[:-1]],
                    [_duplicate_lines(r.decode()) for r in raw], repeat, *([r[k] for r in ratios] for k in range(3)), failed, kept,
                ]
                carried = [batch.column(c).slice(low, high - low) for c in carry]
                names = [*carry, *(c.split()[0] for c in _COLUMNS.split(", "))]
                yield pa.record_batch([*carried, *(pa.array(v, t) for v, t in zip(out, _TYPES))], names)
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, f"{schema}, {_COLUMNS}")


def keep_documents(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    own = docs.select(docs["text"]).columns[0]  # as the table spells it
    inner, names = packs.renamed(docs, ())
    names[docs.columns.index(own)] = "text"
    return packs.restored(judge(inner.toDF(*names), bands, tuple(names)).where("kept"), docs, names)
