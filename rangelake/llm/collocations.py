"""Collocations by count streams in prefix and suffix order.

The layout is that of external language-model estimation: n-gram counts are streams on disk, each kept in prefix order
(first word first) and in suffix order (last word first), and whatever an n-gram needs from shorter or longer ones is
found by joining two sorted streams in lockstep.

1. Texts are cut into pieces and words; each slice of text is written once as numbers of its own word list.
2. Word counts are added up; words that occur often enough get numbers in word order, and slices learn the numbers of theirs.
3. Each slice writes its sorted word pairs with counts. The sorted stream of all slices is read once: it gives the totals
   of frequent pairs and tells each slice which of its pairs are frequent.
4. Slices write only those triples whose two pairs are both frequent: a rarer pair has no frequent triple, so nothing is lost.
5. Left counts come from a merge join in prefix order, right counts from one in suffix order, extension counts from both.

A frequent n-gram has one row a slice at most, so no key is hot however often it occurs. Streams are read in order with one
open key; while its total is below the limit, fewer rows than the limit are held back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangelake.llm import packs, words

#: Text bytes of a slice; texts are cut at the ends of pieces, which no phrase crosses.
SLICE_BYTES = 16 << 20
LEAST_COUNT = 10
TOP = 2000

_BREAK = words._table(".,;:!?\n\x0b\x0c\r", True)
_WORD = words._table(" \t.,;:!?\n\x0b\x0c\r", False)
_WORDS = pa.schema([("word", pa.large_binary()), ("n", pa.int64())])


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, their counts, and the texts as numbers of those words with -1 before each piece."""
    lower = words.LOWER[data]
    starts, ends, bounds = words.cut(lower, offsets, _WORD)
    inside = lower[_WORD[lower]]
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    spelled = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(inside)]).dictionary_encode()
    code = spelled.indices.to_numpy().astype(np.int64)
    piece = np.cumsum(_BREAK[lower])[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = piece[1:] != piece[:-1]
    new[bounds[:-1][bounds[:-1] < len(starts)]] = True
    return spelled.dictionary, np.bincount(code, minlength=len(spelled.dictionary)), np.insert(code, np.flatnonzero(new), -1)


def _cuts(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Parts of a long text that end where a piece ends."""
    low = 0
    while len(data) - low > most:
        ends = np.flatnonzero(_BREAK[data[low : low + most]])
        if not len(ends):
            ends = np.flatnonzero(_BREAK[data[low:]])[:1]
        high = low + int(ends[-1]) + 1 if len(ends) else len(data)
        yield low, high
        low = high
    if low < len(data):
        yield low, len(data)


def encoded(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(slice, lang, words, text): a slice holds texts of one language, its words with counts, and the texts as numbers."""

    def flush(lang: str, parts: list[np.ndarray], number: int) -> tuple:
        size = np.array([len(p) for p in parts])
        spelled, n, code = _pieces(np.concatenate(parts), np.concatenate([[0], np.cumsum(size)]))
        table = pa.record_batch([spelled, pa.array(n, pa.int64())], schema=_WORDS)
        return number, lang, packs.pack(table), packs.pack(pa.record_batch([pa.array(code.astype(np.int32))], ["code"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def full(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for lang in [k for k, n in size.items() if n >= least and n]:
                row = flush(lang, held.pop(lang), number)
                size.pop(lang)
                number += 1
                yield pa.record_batch([pa.array([v]) for v in row], ["slice", "lang", "words", "text"])

        for batch in batches:
            data, offsets = words.flat(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            for d, k in enumerate(langs.indices.to_numpy()):
                text, lang = data[offsets[d] : offsets[d + 1]], langs.dictionary[int(k)].as_py()
                for low, high in _cuts(text, slice_bytes):
                    held.setdefault(lang, []).append(text[low:high].copy())
                    size[lang] = size.get(lang, 0) + high - low
                    if size[lang] >= slice_bytes:
                        yield from full(slice_bytes)
            while sum(size.values()) > 2 * slice_bytes:  # many languages: the largest go first
                yield from full(max(size.values()))
        yield from full(0)

    spoken = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return spoken.mapInArrow(run, "slice long, lang string, words binary, text binary")


def _word_rows(slices: DataFrame) -> DataFrame:
    """(slice, lang, place, word, n): the words of each slice by their number in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = packs.unpack(batch.column("words")[k])
                for low in range(0, got.num_rows, 1 << 16):
                    part = got.slice(low, 1 << 16).combine_chunks()
                    n = part.num_rows
                    yield pa.record_batch([
                        pa.repeat(batch.column("slice")[k], n), pa.repeat(batch.column("lang")[k], n), pa.array(np.arange(low, low + n, dtype=np.int32)),
                        part.column("word").combine_chunks().cast(pa.large_string()).cast(pa.string()), part.column("n").combine_chunks(),
                    ], ["slice", "lang", "place", "word", "n"])

    return slices.select("slice", "lang", "words").mapInArrow(run, "slice long, lang string, place int, word string, n long")


def _sorted_counts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a (m, k) array in order, and how often each occurs."""
    order = np.lexsort(key.T[::-1])
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return key[first], np.diff(np.append(first, len(key)))


def _numbered_slices(slices: DataFrame, ids: DataFrame) -> DataFrame:
    """(slice, text, places, ids): the slices with the global numbers of their frequent words, as 32- and 64-bit integers in a row."""

    def run(key: tuple, own: pa.Table) -> pa.Table:
        return pa.table([pa.array([key[0].as_py()]), *(pa.array([own.column(c).to_numpy().tobytes()]) for c in ("place", "id"))], ["slice", "places", "ids"])

    packed = ids.groupBy("slice").applyInArrow(run, "slice long, places binary, ids binary")
    return slices.select("slice", "text").join(packed.hint("merge"), "slice")


def _numbers(text: pa.BinaryScalar, places: pa.BinaryScalar, ids: pa.BinaryScalar) -> np.ndarray:
    """The words of a slice by their global numbers; -1 where a piece begins or a word is rare."""
    code = packs.unpack(text).column("code").combine_chunks().to_numpy()
    known = np.full(int(code.max(initial=-1)) + 2, -1, np.int64)
    known[np.frombuffer(places.as_buffer(), np.int32)] = np.frombuffer(ids.as_buffer(), np.int64)
    return known[code]  # code -1 reads the last value, which stays -1


def _pair_rows(slices: DataFrame) -> DataFrame:
    """(a, b, n, slice): the distinct pairs of frequent words of each slice, in prefix order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                word = _numbers(*(batch.column(c)[k] for c in ("text", "places", "ids")))
                good = (word[:-1] >= 0) & (word[1:] >= 0)
                pairs, n = _sorted_counts(np.column_stack([word[:-1][good], word[1:][good]]))
                whole = pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n.astype(np.int64)), pa.repeat(batch.column("slice")[k], len(n))], ["a", "b", "n", "slice"])
                for low in range(0, len(n), 1 << 16):
                    yield whole.slice(low, 1 << 16)

    return slices.mapInArrow(run, "a long, b long, n long, slice long")


def _triple_rows(slices: DataFrame, frequent: DataFrame) -> DataFrame:
    """(a, b, c, n): the distinct triples of each slice whose two pairs are both frequent. ``frequent`` names those by slice."""

    def run(text: pa.Table, told: pa.Table) -> pa.Table:
        if not text.num_rows or not told.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "c", "n")})
        word = _numbers(*(text.column(c).combine_chunks()[0] for c in ("text", "places", "ids")))
        before, after = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in told.column(c).combine_chunks()]) for c in ("firsts", "seconds"))
        # frequent pairs in order; a pair of numbers becomes one number by the places of the words among those of the slice
        names = np.unique(word)
        rank = np.searchsorted(names, word)
        ok = np.sort(np.searchsorted(names, before) * len(names) + np.searchsorted(names, after))
        two = rank[:-1] * len(names) + rank[1:]
        good = ok[np.minimum(np.searchsorted(ok, two), len(ok) - 1)] == two
        good = good[:-1] & good[1:]
        triples, n = _sorted_counts(np.column_stack([word[:-2][good], word[1:-1][good], word[2:][good]]))
        return pa.table([pa.array(triples[:, 0]), pa.array(triples[:, 1]), pa.array(triples[:, 2]), pa.array(n.astype(np.int64))], ["a", "b", "c", "n"])

    return slices.groupBy("slice").cogroup(frequent.groupBy("slice")).applyInArrow(run, "a long, b long, c long, n long")


#: Entries of (pair, slice) that a task holds before it hands them on, sorted by slice.
_TOLD = 1 << 20


def _by_slice(told: list[np.ndarray]) -> pa.RecordBatch:
    """(a, b, slice) entries as one row a slice; its pairs are 64-bit integers in a row."""
    entries = np.concatenate(told)
    entries = entries[np.argsort(entries[:, 2], kind="stable")]
    first = np.flatnonzero(np.diff(entries[:, 2], prepend=-1))
    none = pa.nulls(len(first), pa.int64())
    pairs = [pa.array([entries[x:y, k].tobytes() for x, y in zip(first, [*first[1:], len(entries)])], pa.binary()) for k in (0, 1)]
    return pa.record_batch([none, none, none, pa.array(entries[first, 2]), *pairs], ["a", "b", "n", "slice", "firsts", "seconds"])


def _merged(rows: DataFrame, keys: list[str], least: int, tell: bool) -> DataFrame:
    """Totals of the keys of a stream that reach ``least``: the keys and ``n``.

    With ``tell`` (pairs only) there are further rows that name the frequent pairs of a slice: ``slice`` and ``firsts``, ``seconds``.
    Reads the sorted stream once; the open key goes over from batch to batch.
    """
    columns = [*keys, "n", *(["slice"] if tell else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the open key while it is below the limit
        open_key: tuple | None = None
        above = 0  # its total so far, once it is at or above the limit
        told: list[np.ndarray] = []

        def totals(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            more = [pa.nulls(len(n), pa.int64()), *[pa.nulls(len(n), pa.binary())] * 2] if tell else []
            names = [*columns, *(["firsts", "seconds"] if tell else [])]
            yield pa.record_batch([pa.array(np.ascontiguousarray(key[:, k])) for k in range(len(keys))] + [pa.array(n.astype(np.int64)), *more], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
                held = None
            key = np.column_stack([table.column(k).to_numpy() for k in keys])
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            sums = np.add.reduceat(table.column("n").to_numpy(), first)
            if open_key is not None:
                if tuple(key[0].tolist()) == open_key:
                    sums[0] += above
                else:
                    yield from totals(np.array([open_key]), np.array([above]))
            if tell:
                often = np.repeat(sums >= least, np.diff(np.append(first, len(key))))
                told.append(np.column_stack([key, table.column("slice").to_numpy()])[often])
                if sum(map(len, told)) >= _TOLD:
                    yield _by_slice(told)
                    told = []
            # the last key may go on in the next batch
            open_key, above = None, 0
            if sums[-1] >= least:
                open_key, above = tuple(key[-1].tolist()), int(sums[-1])
            else:
                held = table.slice(first[-1])
            done = np.flatnonzero(sums[:-1] >= least)
            if len(done):
                yield from totals(key[first[done]], sums[done])
        if open_key is not None:
            yield from totals(np.array([open_key]), np.array([above]))
        if sum(map(len, told)):
            yield _by_slice(told)

    names = ", ".join(f"{c} long" for c in columns) + (", firsts binary, seconds binary" if tell else "")
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, names)


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language.

    A phrase is two or three words in a row within a piece, occurring ``least`` times or more. ``a`` is its count, ``l``
    and ``r`` those of the parts of its lowest-scoring cut, ``n`` all words of the language, ``score`` the floor of
    1000000 a a / (l r). Phrases that stand in a longer one of at least half their count are left out. Null texts are
    empty, null languages are ``und``; repeated rows count as often as they occur; ids are not read, further columns are left out;
    an empty table gives an empty table. Ties go by count, then by the phrase in byte order.
    """
    spark = docs.sparkSession
    folder = packs.work_folder(spark)
    slices = packs.stored(encoded(docs, slice_bytes), f"{folder}/slices")
    word_rows = packs.stored(_word_rows(slices), f"{folder}/words")
    totals = word_rows.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    sizes = packs.stored(word_rows.groupBy("lang").agg(F.sum("n").alias("n")), f"{folder}/sizes")
    numbered = totals.where(F.col("f") >= least).repartitionByRange("lang", "word").sortWithinPartitions("lang", "word")
    vocabulary = packs.stored(numbered.withColumn("id", F.monotonically_increasing_id()), f"{folder}/vocabulary")
    ids = word_rows.join(vocabulary.hint("merge"), ["lang", "word"]).select("slice", "place", "id")
    numbered = packs.stored(_numbered_slices(slices, ids), f"{folder}/numbered")
    for done in ("words", "slices"):
        packs.removed(spark, f"{folder}/{done}")
    pairs = packs.stored(_pair_rows(numbered), f"{folder}/pairs")
    two = packs.stored(_merged(pairs, ["a", "b"], least, True), f"{folder}/frequent_pairs")
    packs.removed(spark, f"{folder}/pairs")
    told = two.where("slice IS NOT NULL").select("slice", "firsts", "seconds")
    triples = packs.stored(_triple_rows(numbered, told), f"{folder}/triples")
    packs.removed(spark, f"{folder}/numbered")
    three = packs.stored(_merged(triples, ["a", "b", "c"], least, False), f"{folder}/frequent_triples")
    packs.removed(spark, f"{folder}/triples")
    return _ranked(vocabulary, sizes, two.where("n IS NOT NULL").select("a", "b", "n"), three, top)


def _score(l: str, r: str) -> F.Column:
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    top = (wide("f") * wide("f")).cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(l) * wide(r)).cast("decimal(38,0)"))


def _ranked(vocabulary: DataFrame, sizes: DataFrame, two: DataFrame, three: DataFrame, top: int) -> DataFrame:
    word = lambda own, count, spelled=None: vocabulary.select(F.col("id").alias(own), F.col("f").alias(count), *([F.col("word").alias(spelled)] if spelled else [])).hint("merge")
    # prefix order: left counts; suffix order: right counts
    left = three.withColumnRenamed("n", "f").join(two.select("a", "b", F.col("n").alias("l2")).hint("merge"), ["a", "b"])
    both = left.join(two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("r1")).hint("merge"), ["b", "c"])
    long = both.join(word("a", "l1", "wa"), "a").join(word("b", "fb", "wb"), "b").join(word("c", "r2", "wc"), "c").withColumns({"s1": _score("l1", "r1"), "s2": _score("l2", "r2")})
    early = F.col("s1") <= F.col("s2")
    long = long.select(
        "a", F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), "f", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    # the largest count of a triple that begins, or ends, with a pair
    before = three.groupBy("a", "b").agg(F.max("n").alias("after"))
    after = three.groupBy(F.col("b").alias("a"), F.col("c").alias("b")).agg(F.max("n").alias("before"))
    short = two.withColumnRenamed("n", "f").join(before.hint("merge"), ["a", "b"], "left").join(after.hint("merge"), ["a", "b"], "left")
    longest = F.greatest(F.coalesce("after", F.lit(0)), F.coalesce("before", F.lit(0)))
    short = short.where(F.lit(100) * longest < F.lit(50) * F.col("f")).join(word("a", "l", "wa"), "a").join(word("b", "r", "wb"), "b")
    short = short.select("a", F.concat_ws(" ", "wa", "wb").alias("phrase"), "f", "l", "r", _score("l", "r").alias("score"))
    found = long.unionByName(short).join(vocabulary.select(F.col("id").alias("a"), "lang").hint("merge"), "a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
