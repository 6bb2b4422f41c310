"""Plain single-process versions of the operators, and documents that are hard to handle."""

import collections
import random
import re
import zlib

from pyspark.sql import types as T

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# columns whose names clash with those that operators make
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("n_words", "kept", "block", "_own_0", "_key", "_hits", "runs", "node", "shard", "lang")] + [T.StructField("n_chars", T.LongType())])


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ren", "tu", "és", "ßa", "Do"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def hard_documents(seed: int = 1) -> list[tuple]:
    """(doc_id, text): nulls, empty, white space only, one huge word, long, copies, near copies, repeats, wide characters."""
    rng = random.Random(seed)
    shared = prose(rng, 60)
    base = prose(rng, 200)
    words = base.split(" ")
    docs = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 300_000), (5, prose(rng, 20_000)), (None, prose(rng, 50)), (None, None), (7, "one two three"), (8, "\u00a0 wide\u3000space 😀 end")]
    docs += [(10, base), (11, base), (12, " ".join(words[:5] + ["new"] + words[6:])), (13, " ".join(words[:190])), (14, "\n".join(words))]
    docs += [(20 + i, f"{prose(rng, 40)}\n{shared}\n{prose(rng, 40)}") for i in range(6)]
    docs += [(30, "na " * 400), (31, "na " * 500), (40, "again and again"), (40, "again and again"), (41, "same line\nsame line\n\nother")]
    docs += [(50 + i, prose(rng, rng.randint(5, 120))) for i in range(25)]
    return docs


def frame(spark, docs: list[tuple]):
    """The documents with further columns, partly null, under names that clash."""
    rows = [(i, t, *("x" if k % 3 else None for k in range(len(DOCS) - 3)), None if t is None else len(t)) for i, t in docs]
    return spark.createDataFrame(rows, DOCS)


def key(row) -> tuple:
    return tuple((x is None, str(x)) for x in row)


def plain_words(text) -> list[str]:
    return PLAIN.findall(text or "")


def shingles(text, n: int) -> set:
    w = [x for x in plain_words((text or "").translate(UPPER))]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(docs: list[tuple], n: int, percent: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id, n_links)."""
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(docs)
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)].append(d)
    return [(d, len(sets[i]), min(least[root(i)], default=None) if sets[i] else d, links[i]) for i, (d, _) in enumerate(docs)]


def repeated_passages(docs: list[tuple], n: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept)."""
    texts = [plain_words(t) for _, t in docs]
    seen = collections.Counter(tuple(w[i : i + n]) for w in texts for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(docs, texts):
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def contamination(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    """(doc_id, n_words, hit word positions, item ids)."""
    words = lambda t: ALNUM.findall((t or "").translate(UPPER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (x := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    found |= x
        out.append((d, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return out


def quality(text) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = plain_words(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if plain_words(line):
            dup += line in lines
            lines.add(line)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = len({j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, len(w) < 10 or 100 * rep > 20 * len(w)


def secrets(text) -> list[tuple[int, int, int, str]]:
    """(start, order, end, kind) of the base kinds."""
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1
