"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, scanned once over every text.

Texts and items are lower-cased (A-Z) and reduced to words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; the automaton holds
every window of ten consecutive item words. Documents are never shuffled: the items travel to the tasks. Items are only
sent as one list while they fit ``MOST_ITEM_BYTES``; more items are cut into several such lists, one pass each, and every
pass adds to the hits of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm import packs, words

WINDOW = 10
#: Bytes of item texts in one automaton.
MOST_ITEM_BYTES = 4 << 20
MOST_LISTS = 64

_TO_SPACE = bytes(words.LOWER[i] if words.ALNUM[words.LOWER[i]] else 32 for i in range(256))


def normal(raw: bytes) -> bytes:
    """Lower-cased words, one space before and after each; without words a single space."""
    return b" ".join([b"", *raw.translate(_TO_SPACE).split(), b""]) if raw else b" "


def item_windows(text: bytes, n: int = WINDOW) -> list[bytes]:
    """The windows of an item; an item of fewer words, but not none, is one window."""
    found = normal(text).split()
    if not found:
        return []
    return [b" " + b" ".join(found[i : i + n]) + b" " for i in range(max(1, len(found) - n + 1))]


def automaton(items: list[tuple[object, str | None]], n: int = WINDOW) -> ahocorasick.Automaton | None:
    """Each window's value: its number of words and the ids of the items that have it."""
    owners: dict[bytes, set] = {}
    for item, text in items:
        for window in item_windows((text or "").encode(), n):
            owners.setdefault(window, set()).add(item)
    machine = ahocorasick.Automaton()
    for window, ids in owners.items():
        machine.add_word(window.decode("latin-1"), (len(window), window.count(b" ") - 1, tuple(sorted(map(str, ids)))))
    machine.make_automaton()
    return machine if owners else None


def scan(text: bytes, machine: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, the runs of words (first, end) inside window occurrences, and the items found."""
    plain = normal(text)
    n_words = plain.count(b" ") - 1
    if machine is None or n_words < 1:
        return max(n_words, 0), [], set()
    hits = [(end, value) for end, value in machine.iter(plain.decode("latin-1"))]
    if not hits:
        return n_words, [], set()
    spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    first = np.searchsorted(spaces, [end - size + 1 for end, (size, _, _) in hits])
    runs = _union([(int(a), int(a) + value[1]) for a, (_, value) in zip(first, hits)])
    return n_words, runs, {i for _, value in hits for i in value[2]}


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code point offsets (end exclusive) in the original text."""
    if not runs:
        return []
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words.cut(words.LOWER[raw], np.array([0, len(raw)]), words.ALNUM)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(heads[starts[a]]), int(heads[ends[b - 1]])) for a, b in runs]


def item_lists(benchmark: DataFrame, most: int = MOST_ITEM_BYTES) -> list[list[tuple[object, str | None]]]:
    """Distinct items in lists of at most ``most`` bytes of text each (a longer item is a list of its own).

    A benchmark is a curated test set; it is read once on the driver, item by item, and its size is checked here: one of
    more than ``MOST_LISTS`` lists is refused.
    """
    lists: list[list] = [[]]
    size = 0
    for row in benchmark.select("item_id", "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        size += len(row["text"].encode())
        if size > most and lists[-1]:
            if len(lists) == MOST_LISTS:
                raise ValueError(f"the benchmark has more than {MOST_LISTS * most} bytes of text")
            lists.append([])
            size = len(row["text"].encode())
        lists[-1].append((row["item_id"], row["text"]))
    return lists


_RUNS = "runs array<struct<first:long,end:long>>"
_RUN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _pass(docs: DataFrame, items: list[tuple[object, str | None]], n: int, first: bool, last: bool) -> DataFrame:
    """One scan. ``docs`` has ``_text``, the carried columns and, after the first pass, what earlier passes found."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    made = ["n_words", "runs", "spans", "items"]
    carry = [c for c in docs.columns if c not in made and not (last and c == "_text")]
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value, n)
        for batch in batches:
            before = [] if first else batch.select(["runs", "items"]).to_pylist()
            counts, hits, spans, found = [], [], [], []
            for i, text in enumerate(batch.column("_text")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                n_words, runs, ids = scan(raw, machine)
                if before:
                    runs = _union([*runs, *((r["first"], r["end"]) for r in before[i]["runs"])])
                    ids = ids | set(before[i]["items"])
                counts.append(n_words)
                hits.append([{"first": a, "end": b} for a, b in runs])
                spans.append([{"start": a, "end": b} for a, b in original_spans(raw.decode(), runs)] if last else [])
                found.append(sorted(ids))
            values = [pa.array(v, t) for v, t in zip((counts, hits, spans, found), (pa.int64(), _RUN_TYPE, _SPAN_TYPE, pa.list_(pa.string())))]
            yield pa.record_batch([*(batch.column(c) for c in carry), *values], [*carry, *made])

    return docs.mapInArrow(run, ", ".join([*schema, "n_words long", _RUNS, "spans array<struct<start:long,end:long>>", "items array<string>"]))


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most_item_bytes: int = MOST_ITEM_BYTES, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: ``n_words``, the hit runs of words, their spans in the original text, and the items found.

    Null texts have no words; null or wordless items have no windows; repeated items count once by id; an empty
    benchmark hits nothing. Repeated documents are scanned each on its own. Other columns are left out.
    """
    out = docs.select(*carry, docs["text"].alias("_text"))
    lists = item_lists(benchmark, most_item_bytes)
    for i, items in enumerate(lists):
        out = _pass(out, items, n, i == 0, i == len(lists) - 1)
    return out


def digest(found: DataFrame) -> DataFrame:
    """The hit counts and the digest of item ids of each document."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents without any hit, with the columns of ``docs``."""
    inner, names = packs.renamed(docs.select(*docs.columns, docs["text"].alias("_whole")), ())
    whole = names.pop()
    clean = find(inner.withColumnRenamed(whole, "text"), benchmark, n, carry=tuple(names)).where(F.size("runs") == 0)
    return packs.restored(clean, docs, names)
