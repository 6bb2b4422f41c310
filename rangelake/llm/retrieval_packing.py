"""Packing of token sequences by lexical retrieval: a sharded BM25 index gives each seed document unused neighbours.

Documents are cut at every full window; what remains of each is packed. Remainders are dealt over shards of bounded size
by content: each goes down a tree of centres of BM25 vectors, so that most of its best neighbours come to the same shard.
Each shard holds an inverted index of its remainders (terms are token ids; document frequencies
are counted over the whole corpus) and fills windows one by one: the longest unused remainder is the seed, its
highest-ranked unused neighbours that fit follow, and the best of the others is cut to close the window. Only the last
window of a shard can have room left.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm import packs, words

WINDOW = 1024
END_ID = 0
#: Bytes of text whose documents make a shard.
SHARD_BYTES = 4 << 20
K1, B = 1.2, 0.75
#: Numbers of a remainder's vector, branches of a node, remainders that the tree is grown over: of a shard, and of all.
WIDTH, BRANCHES, SAMPLE, MOST_SAMPLE = 256, 64, 32, 1 << 16
#: Bytes of remainders that a task deals at once.
GATHERED = 16 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 13, 32]] = True
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True


def _byte_names() -> dict[str, int]:
    """How byte-level vocabularies write each byte: printable Latin-1 as itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts under a byte-level BPE in the file format of ``tokenizers``.

    With ``added`` the strings of the file's ``added_tokens`` in a text have their own ids, as ``tokenizers`` has it by
    default; without, they are ordinary text.

    Equal stretches between white space are encoded once a slice. No token spans the place where white space follows
    other characters, so the stretches' ids in a row are the ids of the text. For the same reason the different stretches of
    a slice are encoded as one text and told apart by the bytes of their tokens. The merges are run by ``tiktoken`` on the
    file's own vocabulary (ids in the order of the merges): the ids are those of ``tokenizers``, at a fifth of the time.
    """

    _loaded: dict[tuple[str, bool], "Encoder"] = {}

    def __init__(self, path: str, added: bool = False) -> None:
        import tiktoken

        names = _byte_names()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(names[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        # fixed value: the pattern that byte-level vocabularies of this format are split by
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.run = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(t) for t in ranks]
        own = file["added_tokens"] if added else []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] and file["normalizer"] for t in own):
            raise NotImplementedError("added tokens that take white space, whole words or normalised text")
        self.added = {t["content"].encode(): t["id"] for t in own}
        # the first in the text counts; of several at one place the longest
        self.added_pattern = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None

    @classmethod
    def load(cls, path: str, added: bool = False) -> "Encoder":
        if (path, added) not in cls._loaded:
            cls._loaded[path, added] = cls(path, added)
        return cls._loaded[path, added]

    def _stretches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each stretch has, and all ids in a row."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint16)
        last, before = data[ends - 1], data[np.maximum(ends - 2, starts)]
        apart = _WHITE[data[starts]] & (_SOLID[last] | (before == 0xC3) & (last >= 0x80))
        wide = (ends - starts)[apart]
        at = np.cumsum(wide)
        text = data[np.arange(at[-1] if len(at) else 0) + np.repeat(starts[apart] - at + wide, wide)].tobytes().decode()
        ids = np.array(self.run(text), np.uint16)
        stop = np.searchsorted(np.cumsum(self.bytes_of[ids]), at) + 1
        alone = [np.array(self.run(data[x:y].tobytes().decode()), np.uint16) for x, y in zip(starts[~apart].tolist(), ends[~apart].tolist())]
        size = np.empty(len(starts), np.int64)
        size[apart], size[~apart] = np.diff(stop, prepend=0), [len(x) for x in alone]
        begin = np.empty(len(starts), np.int64)
        begin[apart], begin[~apart] = stop - size[apart], len(ids) + np.cumsum(size[~apart]) - size[~apart]
        flat, end = np.concatenate([ids, *alone]), np.cumsum(size)
        return size, flat[np.arange(end[-1]) + np.repeat(begin - end + size, size)]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """16-bit ids of each text, without an end."""
        data, offsets = words.flat(column)
        for low, high in words.slices(offsets):
            part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            edge = np.zeros(len(part) + 1, bool)
            if len(part) > 1:
                solid = _SOLID[part[:-1]]
                solid[1:] |= (part[:-2] == 0xC3) & (part[1:-1] >= 0x80)  # Latin letters of two bytes
                edge[1:-1] = _WHITE[part[1:]] & solid
            edge[at] = True
            special = {}
            if self.added_pattern:
                raw = part.tobytes()
                for low_at, high_at in zip(at[:-1].tolist(), at[1:].tolist()):
                    for m in self.added_pattern.finditer(raw, low_at, high_at):
                        special[m.start()] = self.added[m[0]]
                        edge[m.start() : m.end()] = False
                        edge[[m.start(), m.end()]] = True
            cuts = np.flatnonzero(edge)
            starts, ends = (cuts[:-1], cuts[1:]) if len(part) else (cuts[:0], cuts[:0])
            _, first, which = np.unique(words.hashes(part, starts, ends), return_index=True, return_inverse=True)
            size, flat = self._stretches(part, starts[first], ends[first])
            if special:
                which[np.searchsorted(starts, list(special))] = len(size) + np.arange(len(special))
                size, flat = np.append(size, np.ones(len(special), np.int64)), np.append(flat, np.array(list(special.values()), np.uint16))
            size, begin = size[which], (np.cumsum(size) - size)[which]
            end = np.cumsum(size)
            out = flat[np.arange(end[-1] if len(end) else 0) - np.repeat(end - size - begin, size)]
            bounds = np.concatenate([[0], end])[np.searchsorted(starts, at)]
            for x, y in zip(bounds[:-1], bounds[1:]):
                yield out[x:y]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _packs(rows: pa.RecordBatch) -> pa.RecordBatch:
    """(part, n, tail_tokens, pack) of rows by their integer column ``part``."""
    found = list(packs.by_key(rows, "part")) if rows.num_rows else []
    tail = [sum(len(t.as_buffer()) for t in r.column("tail")) // 2 for _, r in found]
    return pa.record_batch([pa.array([p for p, _ in found], pa.int32()), pa.array([r.num_rows for _, r in found], pa.int64()), pa.array(tail, pa.int64()), pa.array([packs.pack(r) for _, r in found], pa.binary())], ["part", "n", "tail_tokens", "pack"])


_PACKS = "part int, n long, tail_tokens long, pack binary"


def tokenized(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """(part, n, tail_tokens, pack): of each document the number of ids, the crc32 of each full window, and the rest."""
    source = docs.select("doc_id", packs.document_key().alias("doc_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path, added=True)
        for batch in batches:
            counts, full, tails, whole = [], [], [], []
            for ids in encoder.encode(batch.column("text")):
                ids = np.append(ids, np.uint16(END_ID))
                cut = len(ids) // window * window
                counts.append(len(ids))
                full.append(np.array([_crc(ids[i : i + window]) for i in range(0, cut, window)], np.uint32).tobytes())
                tails.append(ids[cut:].tobytes())
                whole.append(ids[:cut].tobytes() if with_ids else None)
            for low in range(0, len(counts), 2000):  # a row stays small
                own = slice(low, low + 2000)
                rows = batch.slice(low, 2000)
                yield _packs(pa.record_batch(
                    [pa.array(np.zeros(rows.num_rows, np.int32)), rows.column("doc_id"), rows.column("doc_key"), pa.array(counts[own], pa.int64()), pa.array(full[own], pa.binary()), pa.array(tails[own], pa.binary()), pa.array(whole[own], pa.binary())],
                    ["part", "doc_id", "doc_key", "tokens", "full", "tail", "body"],
                ))

    return source.mapInArrow(run, _PACKS)


def document_frequencies(tokens: DataFrame, size: int = 1 << 16) -> tuple[np.ndarray, int, float]:
    """Per token id the number of remainders that have it; how many remainders there are; their mean length.

    At most ``size`` rows (the number of 16-bit ids) reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                for tail in packs.unpack(raw).column("tail"):
                    total[np.unique(np.frombuffer(tail.as_buffer(), np.uint16))] += 1
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["term", "n"])

    out = np.zeros(size, np.int64)
    for row in tokens.select("pack").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    sums = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tail_tokens"), F.lit(0)).alias("t")).first()
    return out, sums["n"], sums["t"] / max(sums["n"], 1)


def vectors(tails: list[np.ndarray], idf: np.ndarray, mean: float, width: int = WIDTH) -> np.ndarray:
    """A row of ``width`` numbers a remainder: its BM25 weights, every term added to one place with a fixed sign, at length 1."""
    mixed = words.mix(np.arange(len(idf), dtype=np.uint64))
    place, sign = (mixed % np.uint64(width)).astype(np.int64), np.where(mixed >> np.uint64(63), -1.0, 1.0)
    out = np.zeros((len(tails), width), np.float32)
    for i, tail in enumerate(tails):
        term, n = np.unique(tail, return_counts=True)
        out[i] = np.bincount(place[term], sign[term] * idf[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(tail) / max(mean, 1))), width)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _centres(rows: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    found = rows[rng.permutation(len(rows))[:count]]
    for _ in range(rounds):
        near = (rows @ found.T).argmax(1)
        order = np.argsort(near, kind="stable")
        edges = np.flatnonzero(np.diff(near[order], prepend=-1))
        found = np.add.reduceat(rows[order], edges)
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
    return found


def grow(rows: np.ndarray, tokens: np.ndarray, parts: int) -> tuple[list[tuple[np.ndarray, list[int]]], int]:
    """A tree over like rows whose leaves have at most twice a part's share of the tokens, and the number of leaves.

    A node is its branches' centres, and for each the next node or -1 - leaf.
    """
    rng = np.random.default_rng(0)  # fixed value: the same tree from the same rows
    most, nodes, leaves = 2 * tokens.sum() / parts, [], 0
    todo: list[tuple[np.ndarray, int, list[int] | None, int]] = [(np.arange(len(rows)), parts, None, 0)]
    while todo:
        own, count, above, place = todo.pop()
        found = _centres(rows[own], min(count, BRANCHES), rng)
        if above is not None:
            if len(found) < 2:  # like copies cannot be told apart
                above[place] = -1 - leaves
                leaves += 1
                continue
            above[place] = len(nodes)
        near, next_nodes = (rows[own] @ found.T).argmax(1), [0] * len(found)
        nodes.append((found, next_nodes))
        for j in range(len(found)):
            part = own[near == j]
            total = tokens[part].sum()
            if total > most and 1 < len(part) < len(own):
                todo.append((part, max(2, int(np.ceil(2 * total / most))), next_nodes, j))
            else:
                next_nodes[j] = -1 - leaves
                leaves += 1
    return nodes, leaves


def leaf(rows: np.ndarray, nodes: list[tuple[np.ndarray, list[int]]]) -> np.ndarray:
    """The leaf of each row: at every node on with the nearest centre."""
    out, todo = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
    while todo:
        node, own = todo.pop()
        found, next_nodes = nodes[node]
        near = (rows[own] @ found.T).argmax(1)
        for j in np.unique(near).tolist():
            if next_nodes[j] < 0:
                out[own[near == j]] = -1 - next_nodes[j]
            else:
                todo.append((next_nodes[j], own[near == j]))
    return out


def _unpacked(raw: pa.Scalar) -> tuple[pa.RecordBatch, list[np.ndarray]]:
    rows = packs.unpack(raw).combine_chunks().to_batches()[0]
    return rows, [np.frombuffer(t.as_buffer(), np.uint16) for t in rows.column("tail")]


def dealt(tokens: DataFrame, parts: int, idf, n: int, mean: float) -> DataFrame:
    """(shard, pack): the remainders dealt over some ``parts`` shards, like ones to the same shard.

    A tree of centres is grown over a sample of bounded size; every remainder goes to its leaf. A leaf of more than twice
    a shard's share is split by the documents' hash.
    """
    if parts < 2 or not n:
        return tokens.select(F.lit(0).alias("shard"), "pack")
    share = min(1.0, min(SAMPLE * parts, MOST_SAMPLE) / n)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows, tails = _unpacked(raw)
                key = rows.column("doc_key").to_numpy()
                found, first, copies = np.unique(key, return_index=True, return_counts=True)
                wanted = words.mix(found.view(np.uint64)) < np.uint64(int(share * (2**64 - 2**12)))
                some = [tails[i] for i in first[wanted]]
                yield pa.record_batch([pa.array(found[wanted]), pa.array(copies[wanted] * np.array([len(t) for t in some], np.int64), pa.int64()), pa.array([v.tobytes() for v in vectors(some, idf.value, mean).astype(np.float16)], pa.binary())], ["doc_key", "tokens", "row"])

    sample = tokens.select("pack").mapInArrow(sampled, "doc_key long, tokens long, row binary").groupBy("doc_key").agg(F.sum("tokens").alias("tokens"), F.first("row").alias("row")).toArrow().sort_by("doc_key")
    if not sample.num_rows:
        return tokens.select(F.lit(0).alias("shard"), "pack")
    rows = np.frombuffer(b"".join(sample.column("row").to_pylist()), np.float16).reshape(sample.num_rows, -1).astype(np.float32)
    nodes, leaves = grow(rows, sample.column("tokens").to_numpy(), parts)
    tree = tokens.sparkSession.sparkContext.broadcast(nodes)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for raw in (raw for batch in batches for raw in batch.column(0)):
            rows, tails = _unpacked(raw)
            gathered.append(rows.append_column("part", pa.array(leaf(vectors(tails, idf.value, mean), tree.value), pa.int32())))
            size += rows.nbytes
            if size >= GATHERED:
                yield _packs(pa.Table.from_batches(gathered).combine_chunks().to_batches()[0])
                gathered, size = [], 0
        if gathered:
            yield _packs(pa.Table.from_batches(gathered).combine_chunks().to_batches()[0])

    leafed = packs.stored(tokens.select("pack").mapInArrow(placed, _PACKS))
    sums = np.zeros(leaves, np.int64)
    for r in leafed.groupBy("part").agg(F.sum("tail_tokens").alias("n")).collect():  # a row a leaf
        sums[r["part"]] = r["n"]
    target = max(1, int(n * mean / parts))
    splits = np.where(sums > 2 * target, -(-sums // target), 1)
    first = np.cumsum(splits) - splits

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if splits[part] == 1:
                    yield pa.record_batch([pa.array([first[part]], pa.int32()), pa.array([raw.as_py()], pa.binary())], ["shard", "pack"])
                else:
                    rows = packs.unpack(raw).combine_chunks().to_batches()[0]
                    key = words.mix(rows.column("doc_key").to_numpy().view(np.uint64)) % np.uint64(splits[part])
                    own = _packs(rows.append_column("part", pa.array(first[part] + key.astype(np.int64), pa.int32())))
                    yield pa.record_batch([own.column("part"), own.column("pack")], ["shard", "pack"])

    return leafed.select("part", "pack").mapInArrow(split, "shard int, pack binary")


class Shard:
    """The inverted index of a shard's remainders."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        terms, docs, counts = [], [], []
        self.terms = []
        for i, tail in enumerate(tails):
            term, n = np.unique(tail, return_counts=True)
            terms.append(term)
            docs.append(np.full(len(term), i))
            counts.append(n)
            self.terms.append(term)
        term, doc, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, docs, counts))
        order = np.argsort(term, kind="stable")
        length = np.array([len(t) for t in tails], float)[doc]
        weight = idf[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * length / max(mean, 1)))
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.size = len(tails)

    def forget(self, unused: np.ndarray) -> None:
        """Drop the postings of used remainders."""
        left = unused[self.doc]
        self.doc, self.weight = self.doc[left], self.weight[left]
        self.start = np.concatenate([[0], np.cumsum(left)])[self.start]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents with a score for the seed's terms, best first, ties by place."""
        near, score = self.scored(seed, unused)
        return near[np.argsort(-score, kind="stable")]

    def scored(self, seed: int, unused: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unused documents with a score for the seed's terms, by place, and their scores."""
        term = self.terms[seed].astype(np.int64)
        first, size = self.start[term], self.start[term + 1] - self.start[term]
        at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        score = np.bincount(self.doc[at], self.weight[at], self.size) * unused
        some = np.flatnonzero(score > 0)
        return some, score[some]


def fill(tails: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (remainder, first id, end); every id of every remainder is in exactly one."""
    index = Shard(tails, idf, mean)
    begin, length = np.zeros(len(tails), np.int64), np.array([len(t) for t in tails], np.int64)
    unused = length > 0
    order = np.argsort(-length, kind="stable")
    next_up, known = 0, len(tails)
    while True:
        while next_up < len(order) and not unused[order[next_up]]:
            next_up += 1
        if next_up == len(order):
            return
        seed = int(order[next_up])
        taken, room = [(seed, int(begin[seed]), int(length[seed]))], window - int(length[seed] - begin[seed])
        unused[seed] = False
        if np.count_nonzero(unused) < 0.7 * known:
            index.forget(unused)
            known = np.count_nonzero(unused)
        near, score = index.scored(seed, unused) if room else (np.zeros(0, np.int64), np.zeros(0))
        size = length[near] - begin[near]
        while room:  # the best that fits whole, ties by place; room only shrinks, so this is one walk down the ranking
            fits = np.flatnonzero(size <= room)
            if not len(fits):
                break
            at = fits[score[fits].argmax()]
            d = int(near[at])
            taken.append((d, int(begin[d]), int(length[d])))
            unused[d] = False
            room -= int(size[at])
            size[at], score[at] = window + 1, 0.0
        best = near[[score.argmax()]] if len(score) and score.max() > 0 else near[:0]
        rest = (int(d) for part in (best, order[next_up:]) for d in part) if room else iter(())
        for d in rest:  # cut the best of the others; without any scored one, go on with the longest
            if unused[d]:
                own = min(int(length[d] - begin[d]), room)
                taken.append((d, int(begin[d]), int(begin[d]) + own))
                begin[d] += own
                unused[d] = begin[d] < length[d]
                room -= own
            if not room:
                break
        yield taken


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, 16 bits each) of all documents.

    A document's ids are followed by id 0. A null or empty text is the end alone. Repeated rows are packed each; null
    ids stay null; further columns are left out; an empty table gives an empty table. ``path`` must be readable on every
    executor and name a vocabulary of less than 65,536 ids.
    """
    tokens = packs.stored(tokenized(docs, path, window, with_ids))
    found, n, mean = document_frequencies(tokens)
    idf = docs.sparkSession.sparkContext.broadcast(np.log(1 + (n - found + 0.5) / (found + 0.5)))  # 65,536 numbers
    shards = dealt(tokens, -(-packs.text_bytes(docs) // shard_bytes), idf, n, mean)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([packs.unpack(p) for p in table.column("pack").combine_chunks()]).sort_by([("doc_id", "ascending"), ("doc_key", "ascending")])
        tails = [np.frombuffer(t.as_buffer(), np.uint16) for t in rows.column("tail").combine_chunks()]
        tokens, out, ids = rows.column("tokens").to_numpy(), [], []
        sequence = key[0].as_py() << 32
        for i, (full, body) in enumerate(zip(rows.column("full").combine_chunks(), rows.column("body").combine_chunks())):
            for k, crc in enumerate(np.frombuffer(full.as_buffer(), np.uint32).tolist()):
                out.append((i, k * window, window, crc, sequence, 0))
                ids.append(body.as_py()[2 * k * window : 2 * (k + 1) * window] if with_ids else None)
                sequence += 1
        for taken in fill(tails, idf.value, mean, window):
            offset = 0
            for i, first, end in taken:
                out.append((i, int(tokens[i]) // window * window + first, end - first, _crc(tails[i][first:end]), sequence, offset))
                ids.append(tails[i][first:end].tobytes() if with_ids else None)
                offset += end - first
            sequence += 1
        doc = np.array([o[0] for o in out], np.int64)
        columns = [pa.array([o[k] for o in out], pa.int64()) for k in range(1, 6)]
        made = {"doc_id": rows.column("doc_id").take(pa.array(doc)), **dict(zip(("start", "length", "ids_crc32"), columns)), "doc_tokens": pa.array(tokens[doc], pa.int64()), "sequence_id": columns[3], "offset": columns[4]}
        return pa.table(made | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return shards.groupBy("shard").applyInArrow(run, schema)
