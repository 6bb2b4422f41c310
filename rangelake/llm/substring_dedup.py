"""Removal of repeated passages by super-k-mer partitioning.

A window is ``n`` consecutive words of a document. Its minimiser is the smallest hash of the runs of ``GRAM`` words in it,
so equal windows have equal minimisers. Consecutive windows that share one travel as one string (a super-k-mer) to the
minimiser's bucket, where the windows are sorted and counted exactly. Documents form blocks by their own hash; buckets
answer each block with the ranges of repeated windows, and the block removes the words they cover.

Buckets follow the bytes of text. A first pass sums the bytes that minimisers would send into ``BINS`` fixed bins; those
of bins far above the mean hold a hot minimiser, and their windows go one by one: counted by digest with sums on the
sending side, so one passage in a third of all documents costs a row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm import packs, words

WINDOW = 35
GRAM = 4
#: Windows in one super-k-mer at most; longer runs are cut, so repetitive texts make no huge strings.
MOST_RUN = 512
#: Bytes of super-k-mers that a bucket should hold.
BUCKET_BYTES = 12 << 20
#: Fixed number of bins of the first pass.
BINS = 1 << 14

_REQUEST = pa.schema([("text", pa.binary()), ("doc", pa.int32()), ("first", pa.int32())])
_RANGES = pa.schema([("doc", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])


def _super_kmers(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Of a slice of texts: document, first word in it, windows, minimiser, first and end byte of each super-k-mer; word hashes and document bounds."""
    starts, ends, bounds = words.cut(data, at)
    h = words.hashes(data, starts, ends)
    low = words.rolling_hashes(h, GRAM)
    span, want = 1, n - GRAM + 1
    while span < want and len(low):
        step = min(span, want - span)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        span += step
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    window = np.arange(len(docs)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bounds[:-1], counts)
    value = low[window]
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1] + 1) | (value[1:] != value[:-1])
    index = np.arange(len(window))
    head = np.maximum.accumulate(np.where(new, index, 0)) if len(index) else index
    new |= (index - head) % MOST_RUN == 0
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1 if len(first) else first
    return docs[first], window[first] - bounds[docs[first]], last - first + 1, value[first], starts[window[first]], ends[window[last] + n - 1], h, bounds


def _bins(minimiser: np.ndarray) -> np.ndarray:
    return (words.mix(minimiser ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(BINS)).astype(np.int64)


def hot_bins(docs: DataFrame, n: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, list[int]]:
    """Bytes of all super-k-mers, and the bins that hold four buckets more than the mean bin. ``BINS`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            data, offsets = words.flat(batch.column(0))
            for low, high in words.slices(offsets):
                _, _, _, value, begin, end, _, _ = _super_kmers(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], n)
                total += np.bincount(_bins(value), end - begin, BINS).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bin", "size"])

    rows = docs.select("text").mapInArrow(run, "bin int, size long").groupBy("bin").agg(F.sum("size").alias("size")).collect()
    size = sum(r["size"] for r in rows)
    return size, sorted(r["bin"] for r in rows if r["size"] > size / BINS + 4 * bucket_bytes)


def _block_texts(table: pa.Table) -> pa.Table:
    """The documents of a block in an order that depends on them alone."""
    return pa.concat_tables([packs.unpack(p) for p in table.column("pack").combine_chunks()]).sort_by([("doc_id", "ascending"), ("doc_key", "ascending")])


def _cold_requests(blocks: DataFrame, n: int, buckets: int, hot: list[int]) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        texts = _block_texts(table)
        data, offsets = words.flat(texts.column("text"))
        parts = []
        for low, high in words.slices(offsets):
            part = data[offsets[low] : offsets[high]]
            doc, first, _, value, begin, end, _, _ = _super_kmers(part, offsets[low : high + 1] - offsets[low], n)
            cold = ~np.isin(_bins(value), hot)
            doc, first, value, begin, end = (x[cold] for x in (doc, first, value, begin, end))
            order = np.argsort(value % np.uint64(buckets), kind="stable")
            size = (end - begin)[order]
            at = np.concatenate([[0], np.cumsum(size)])
            raw = part[np.arange(at[-1]) - np.repeat(at[:-1] - begin[order], size)]
            text = pa.Array.from_buffers(pa.binary(), len(order), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
            parts.append(pa.record_batch([(value % np.uint64(buckets))[order].astype(np.int64), text, (doc + low)[order].astype(np.int32), first[order].astype(np.int32)], ["bucket", "text", "doc", "first"]))
        out: list[tuple[int, bytes]] = []
        for part in parts:
            if part.num_rows:
                out += [(b, packs.pack(r)) for b, r in packs.by_key(part, "bucket")]
        return pa.table([pa.array([b for b, _ in out], pa.int32()), pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array([p for _, p in out], pa.binary())], ["bucket", "block", "request"])

    return blocks.groupBy("block").applyInArrow(run, "bucket int, block int, request binary")


def repeated_windows(h: np.ndarray, first: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Which of the windows (the ``n`` word hashes from ``first``) occur, by weight, twice or more. Sorted by hash, then compared word by word."""
    key = words.rolling_hashes(h, n)[first]
    order = np.argsort(key, kind="stable")
    sorted_key, begin = key[order], first[order]
    same = sorted_key[1:] == sorted_key[:-1]
    left, right = begin[:-1][same], begin[1:][same]
    equal = np.ones(len(left), bool)
    for k in range(n):
        equal &= h[left + k] == h[right + k]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    total = np.bincount(group, weight[order]) if len(order) else np.zeros(0)
    out = np.zeros(len(first), bool)
    out[order] = total[group] >= 2
    for g in np.unique(group[1:][same][~equal]):  # different windows of one hash: counted by their words
        members = order[group == g]
        seen: dict[bytes, int] = {}
        for m in members:
            seen[h[first[m] : first[m] + n].tobytes()] = seen.get(h[first[m] : first[m] + n].tobytes(), 0) + int(weight[m])
        for m in members:
            out[m] = seen[h[first[m] : first[m] + n].tobytes()] >= 2
    return out


def _answers(requests: DataFrame, n: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        got = [packs.unpack(r) for r in table.column("request").combine_chunks()]
        block = np.repeat(table.column("block").to_numpy(), [g.num_rows for g in got])
        rows = pa.concat_tables(got)
        encoded = rows.column("text").combine_chunks().dictionary_encode()
        data, offsets = words.flat(encoded.dictionary)
        which = encoded.indices.to_numpy()
        weight = np.bincount(which, minlength=len(offsets) - 1)
        starts, ends, bounds = words.cut(data, offsets)
        h = words.hashes(data, starts, ends)
        counts = np.maximum(np.diff(bounds) - n + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        twice = repeated_windows(h, inside + bounds[text], weight[text], n)
        low, high = words.runs_of(twice, inside == 0)
        # each text's runs, then for every row that has the text
        owner = text[low]
        have = np.bincount(owner, minlength=len(counts))
        begin = np.cumsum(have) - have
        times = have[which]
        row = np.repeat(np.arange(len(which)), times)
        run_index = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + begin[which[row]]
        first = rows.column("first").to_numpy()[row] + inside[low[run_index]]
        last = rows.column("first").to_numpy()[row] + inside[high[run_index] - 1] + n
        out = pa.record_batch([block[row].astype(np.int64), rows.column("doc").to_numpy()[row].astype(np.int32), first.astype(np.int32), last.astype(np.int32)], ["block", *_RANGES.names])
        found = list(packs.by_key(out, "block")) if out.num_rows else []
        return pa.table([pa.array([b for b, _ in found], pa.int32()), pa.array([packs.pack(r) for _, r in found], pa.binary())], ["block", "answer"])

    return requests.groupBy("bucket").applyInArrow(run, "block int, answer binary")


def _hot_answers(blocks: DataFrame, n: int, hot: list[int]) -> DataFrame:
    """The same for the windows of hot bins, by two digests of 64 bits; each block names a window once."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        texts = _block_texts(table)
        data, offsets = words.flat(texts.column("text"))
        found = []
        for low, high in words.slices(offsets):
            doc, first, size, value, _, _, h, bounds = _super_kmers(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], n)
            keep = np.isin(_bins(value), hot)
            doc, first, size = doc[keep], first[keep], size[keep]
            row = np.repeat(np.arange(len(doc)), size)
            place = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            word = place + bounds[doc[row]]
            found.append((words.rolling_hashes(h, n)[word], words.rolling_hashes(h, n, 1)[word], doc[row] + low, place))
        a, b, doc, place = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
        order = np.lexsort((b, a))
        a, b, doc, place = a[order], b[order], doc[order], place[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        cut = np.append(np.flatnonzero(new), len(a))
        ranges = pa.record_batch([doc.astype(np.int32), place.astype(np.int32), (place + n).astype(np.int32)], schema=_RANGES)
        rows = [packs.pack(ranges.slice(x, y - x)) for x, y in zip(cut[:-1], cut[1:])]
        as_long = lambda x: pa.array(x[new].astype(np.uint64).view(np.int64), pa.int64())
        return pa.table([as_long(a), as_long(b), pa.array(np.diff(cut), pa.int64()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(rows, pa.binary())], ["a", "b", "n", "block", "answer"])

    named = blocks.groupBy("block").applyInArrow(run, "a long, b long, n long, block int, answer binary")
    twice = named.groupBy("a", "b").agg(F.sum("n").alias("total")).where("total > 1").select("a", "b")
    return named.join(twice, ["a", "b"]).select("block", "answer")


def dedup(docs: DataFrame, n: int = WINDOW, block_bytes: int = packs.BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by one space) of every document.

    A word goes if a window over it occurs anywhere else; all occurrences go, judged on the input. A null text has no
    words; rows that repeat are occurrences of their own; null ids are kept; documents of fewer words than a window
    stay whole; further columns are left out; an empty table gives an empty table.
    """
    size, hot = hot_bins(docs, n, bucket_bytes)
    blocks = packs.packed(docs, packs.block_count(packs.text_bytes(docs), block_bytes))
    answers = _answers(_cold_requests(blocks, n, packs.block_count(size, bucket_bytes), hot), n)
    if hot:
        answers = answers.unionByName(_hot_answers(blocks, n, hot))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = _block_texts(left) if left.num_rows else None
        if texts is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        got = pa.concat_tables([packs.unpack(a) for a in right.column("answer").combine_chunks()] or [_RANGES.empty_table()])
        doc, first, last = (got.column(c).to_numpy() for c in _RANGES.names)
        order = np.argsort(doc, kind="stable")
        edges = np.searchsorted(doc[order], np.arange(texts.num_rows + 1))
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(texts.column("text")):
            found = text.as_buffer().to_pybytes().split()
            own = order[edges[i] : edges[i + 1]]
            n_words.append(len(found))
            if len(own):
                steps = np.zeros(len(found) + 1, np.int32)
                np.add.at(steps, first[own], 1)
                np.add.at(steps, last[own], -1)
                gone = np.cumsum(steps[:-1]) > 0
                found = [w for w, g in zip(found, gone.tolist()) if not g]
            n_removed.append(n_words[-1] - len(found))
            kept.append(b" ".join(found).decode())
        return pa.table([texts.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept string")
