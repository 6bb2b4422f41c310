"""Licence scan, conversation repair and collocations against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tests.llm import brute

from rangelake.llm import collocations, conversation_repair, license_scan
from rangelake.llm.license_scan import NOTICES, PHRASES, Automaton, Template

HARD = brute.hard_documents()


def ascii_words(text) -> list[str]:
    return brute.ALNUM.findall((text or "").translate(brute.UPPER))


# --- licences -------------------------------------------------------------------------------------------------------

def license_documents() -> list[tuple]:
    rng = random.Random(9)
    mit, gpl = NOTICES[0].text, next(n.text for n in NOTICES if n.label == "gpl-3.0")
    changed = mit.split(" ")
    changed[10] = "somebody"
    out = [*HARD, (100, f"{brute.prose(rng, 30)} {mit} {brute.prose(rng, 30)}"), (101, " ".join(changed)), (102, " ".join(changed[:8]))]
    out += [(103, "CC  by, cc-BY cc by-nc 4.0; All rights reserved. all RIGHTS\nreserved"), (104, "general public license general public license"), (105, gpl), (106, "by cc rights reserved public license")]
    out += [(107, f"{gpl}\n{brute.prose(rng, 50)}\n{gpl}"), (108, "the software the license the work of any kind"), (109, f"x {mit[: len(mit) // 2]} {brute.prose(rng, 40)} {mit[len(mit) // 2 :]}"), (110, "all rights reserved " * 3000)]
    return out


def phrases_in(text) -> list[tuple[int, str]]:
    w = ascii_words(text)
    return sorted((i, p.label) for p in PHRASES for i in range(len(w)) if w[i : i + len(ascii_words(p.text))] == ascii_words(p.text))


def test_licenses(spark):
    docs = license_documents()
    frame = brute.frame(spark, docs).repartition(3)
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]): r for r in license_scan.digest(license_scan.scan(frame)).collect()}
    want = []
    for d, t in docs:
        p = phrases_in(t)
        want.append((d, len(ascii_words(t)), len(p), p[0][0] if p else None, p[-1][0] if p else None, ",".join(sorted({x for _, x in p}))))
    assert sorted(got, key=brute.key) == sorted(set(want), key=brute.key)
    label = {r["doc_id"]: (r["labels"], r["score"]) for r in got.values()}
    assert label[100] == ("mit", 1.0) and label[101][0] == "mit" and 0.8 < label[101][1] < 1 and label[102] == ("", 0.0)
    assert label[103][0] == "cc-by,cc-by-nc,reserved" and label[105] == ("gpl,gpl-3.0", 1.0) and label[106] == ("", 0.0) and label[108] == ("", 0.0)
    assert all(0 <= s <= 1 for _, s in label.values()) and label[5] == ("", 0.0)
    spans = {r["doc_id"]: [s for s in r["spans"] if not s["phrase"]] for r in license_scan.scan(frame).where("doc_id IN (100, 107, 109)").collect()}
    mit = len(ascii_words(NOTICES[0].text))
    assert [(s["first"], s["end"]) for s in spans[100]] == [(30, 30 + mit)]
    assert [s["share"] for s in spans[107]] == [1.0, 1.0] and all(s["share"] < 0.7 for s in spans[109])


def test_license_edges(spark):
    none = brute.frame(spark, [])
    assert license_scan.digest(license_scan.scan(none)).count() == 0
    docs = brute.frame(spark, HARD)
    assert license_scan.scan(docs, templates=()).where("size(spans) > 0").count() == 0
    with pytest.raises(ValueError):
        Automaton([Template("x", "one")])


def test_matching_statistics():
    """Matched lengths and matches of random word streams against a search of all templates."""
    rng = random.Random(4)
    templates = [Template(str(k), " ".join(rng.choice("abcd") for _ in range(rng.randint(2, 14)))) for k in range(5)]
    automaton = Automaton(templates, least=2)
    factors = {tuple(c[i:j]) for c in automaton.coded for i in range(len(c)) for j in range(i + 1, len(c) + 1)}
    for _ in range(40):
        stream = [rng.randrange(-1, len(automaton.code)) for _ in range(30)]
        lengths = [n for _, n in automaton.statistics(stream)]
        assert lengths == [max((n for n in range(1, i + 2) if tuple(stream[i + 1 - n : i + 1]) in factors), default=0) for i in range(len(stream))]
        want = set()
        for t, c in enumerate(automaton.coded):
            for i, k in itertools.product(range(len(stream)), range(len(c))):
                n = 0
                while i + n < len(stream) and k + n < len(c) and stream[i + n] == c[k + n]:
                    n += 1
                if n >= 2 and (i == 0 or k == 0 or stream[i - 1] != c[k - 1]):
                    want.add((t, i, k, n))
        assert set(automaton.matches(stream, 0)[1]) == want


def test_chains():
    """The best chain covers what an exhaustive search over orders covers."""
    rng = random.Random(6)
    for _ in range(60):
        found = [(0, rng.randrange(20), rng.randrange(12), rng.randint(1, 5)) for _ in range(6)]
        best = 0
        for size in range(1, 7):
            for some in itertools.combinations(sorted(set(found), key=lambda m: (m[1], m[2])), size):
                covered, ok = some[0][3], True
                for (_, a, p, n), (_, b, q, m) in itertools.pairwise(some):
                    over = max(0, a + n - b, p + n - q)
                    ok &= a < b and p < q and over < m and b - a - n <= 3 and q - p - n <= 3
                    covered += m - over
                best = max(best, covered if ok else 0)
        assert license_scan.chains(found, 20, 3)[0][2] == best


# --- conversations --------------------------------------------------------------------------------------------------

def conversation_rows() -> list[tuple]:
    rng = random.Random(11)
    rows = []
    for c in range(60):
        for turn in range(rng.randint(1, 4)):
            rows.append((c, turn + rng.randint(0, 1), rng.choice(["system", "user", "assistant", "tool", "s"]), rng.choice(["Hi.", "So?", "no end", " \t", "Hi.", ""])))
    for turn in range(90):
        rows.append((1000, turn, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Text {turn}.", f"open {turn}", "same.", ""])))
    rows += [(None, 1, "user", "Q?"), (None, 2, "assistant", "A."), (None, None, None, None), (None, None, "user", "null turn."), (2000, None, "user", "One."), (2000, None, "assistant", "Two.")]
    rows += [(2001, 5, "user", "x" * 400_000 + "."), (2001, 6, "assistant", "Yes!"), (2002, 1, None, "No role."), (2003, 1, "user", None), (2004, 3, "user", "Hi."), (2004, 3, "user", "Hi."), (2004, 4, "assistant", "Ho.")]
    return rows


def damaged(rows: list[tuple]) -> dict:
    out = defaultdict(list)
    told = lambda v: " " if v is None else str(v)
    for c, turn, role, text in rows:
        out[c]
        fate = zlib.crc32(f"{told(c)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out[c] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:200], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def faults(own: list[tuple]) -> list[str]:
    seen, out = set(), []
    for _, role, text in own:
        bare = brute.PLAIN.findall(text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_repair(own: list[tuple]) -> tuple[int, str, list[str]]:
    """Every state's cheapest (cost, audit, turns) so far; equally cheap edits of as many rows never begin one another."""
    states = {"": (0, "", [])}
    legal = lambda done, x: x == {"": "u", "s": "u", "u": "a", "a": "u"}[done] or (x == "s" and done == "")

    def inserts(states):
        out = dict(states)
        for _ in range(2):
            for done, (cost, audit, turns) in list(out.items()):
                for role in ("user", "assistant"):
                    if legal(done, role[0]):
                        option = (cost + 5, audit + "I", [*turns, f"{role}:"])
                        out[role[0]] = min(out.get(role[0], option), option)
        return out

    for (_, role, text), fault in zip(own, faults(own)):
        after = {}
        for done, (cost, audit, turns) in inserts(states).items():
            options = [(done, (cost + 2, audit + "D", turns))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if legal(done, role[:1]):
                    options.append((role[:1], (cost + more, audit + "K", [*turns, f"{role}:{text}"])))
                options += [(r[0], (cost + 1 + more, audit + "R", [*turns, f"{r}:{text}"])) for r in ("user", "assistant") if legal(done, r[0])]
            for state, option in options:
                after[state] = min(after.get(state, option), option)
        states = after
    states = inserts(states)
    return min(states[s] for s in ("", "a") if s in states)


def repaired(rows: list[tuple]) -> list[tuple]:
    out = []
    for c, own in damaged(rows).items():
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds = Counter(faults(own))
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        cost, audit, told = best_repair(own) if own else (0, "", [])
        out.append((c, gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest()))
    return sorted(out, key=brute.key)


TURNS = "conv_id long, turn long, role string, text string, key string, pos long, stretch long, _fate string"


@pytest.mark.parametrize("stretch", [4096, 3])
def test_repair(spark, stretch):
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, "x", 1, None, "y") for r in rows], TURNS).repartition(3)
    got = conversation_repair.digest(frame, stretch)
    assert sorted((tuple(r) for r in got.collect()), key=brute.key) == repaired(rows)


def test_repair_is_exhaustive():
    """The search by states finds what a search of all edit strings finds."""
    rng = random.Random(2)
    for _ in range(60):
        own = [(k, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "", "c?"])) for k in range(rng.randint(0, 3))]
        marks, best = faults(own), None
        for plan in itertools.product(*[[i * "I" + x for i in range(3) for x in "DKR"]] * len(own), ["", "I", "II"]):
            audit, cost, told, ok, done = "".join(plan), 0, [], True, ""
            rows = iter(zip(own, marks))
            for x in audit:
                if x == "I":
                    told.append("assistant:" if done == "u" else "user:")
                    cost, done = cost + 5, told[-1][0]
                    continue
                (_, role, text), fault = next(rows)
                cost += {"D": 2, "K": 0, "R": 1}[x]
                if x != "D":
                    ok &= fault not in ("blank", "duplicate")
                    cost += 5 * (fault == "truncated")
                    told.append(f"{role}:{text}" if x == "K" else ("assistant:" if done == "u" else "user:") + text)
                    done = told[-1][0]
            if ok and re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in told)):
                best = min(best or (cost, audit, told), (cost, audit, told))
        assert best_repair(own) == best


def test_repair_of_no_conversations(spark):
    assert conversation_repair.digest(spark.createDataFrame([], TURNS)).count() == 0


# --- collocations ---------------------------------------------------------------------------------------------------

def spoken_documents() -> list[tuple]:
    """(lang, text): the hard documents, some languages, wide and control characters, ties."""
    langs = ["en", None, "de", "en", ""]
    out = [(langs[k % 5], t) for k, (_, t) in enumerate(HARD)]
    rng = random.Random(8)
    out += [("en", " ".join(rng.choice(["new", "york", "city", "of", "the", "a"]) for _ in range(300))) for _ in range(4)]
    out += [("en", "new york, new\tYORK. new york! of;the:new york\x01 new\x01york é" * 6), ("fr", "la maison\nla maison la maison " * 5), ("zz", "one"), ("yy", None), ("xx", "x y x y x y x y")]
    return out


def phrase_table(docs: list[tuple], least: int, top: int) -> list[tuple]:
    counts, sizes = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(brute.UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            counts.update((lang, tuple(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    frequent = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    longer = defaultdict(int)
    for (lang, g), f in frequent.items():
        if len(g) == 3:
            for part in (g[:2], g[1:]):
                longer[lang, part] = max(longer[lang, part], f)
    found = defaultdict(list)
    for (lang, g), a in frequent.items():
        if len(g) == 2 and 100 * longer[lang, g] >= 50 * a:
            continue
        score, _, left, right = min((1_000_000 * a * a // (counts[lang, g[:k]] * counts[lang, g[k:]]), k, counts[lang, g[:k]], counts[lang, g[k:]]) for k in range(1, len(g)))
        found[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, sizes[lang], -s) for lang, own in found.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


@pytest.mark.parametrize("slice_bytes", [1 << 20, 2000])
def test_collocations(spark, slice_bytes):
    docs = spoken_documents()
    frame = spark.createDataFrame([(k, lang, t, "x", 1) for k, (lang, t) in enumerate(docs)], "doc_id long, lang string, text string, phrase string, n long").repartition(3)
    for least, top in ((2, 2000), (10, 7)):
        got = collocations.collocations(frame, least, top, slice_bytes)
        assert sorted(tuple(r) for r in got.collect()) == phrase_table(docs, least, top)


def test_collocations_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.collocations(frame).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "en", "")], frame.schema)).count() == 0


def test_scores_are_exact(spark):
    """Products beyond 64 bits."""
    f, l, r = 3_000_000_007, 4_000_000_019, 5_000_000_029
    got = spark.createDataFrame([(f, l, r)], "f long, l long, r long").select(collocations._score("l", "r")).first()[0]
    assert got == 1_000_000 * f * f // (l * r)
