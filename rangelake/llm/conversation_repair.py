"""Repair of conversation structure by dynamic programming over secondary-sorted streams.

Rows are repartitioned by conversation and stretch (a fixed number of turns in a row), sorted by place, and streamed through
``mapInPandas``: the state of the dynamic program goes over from Arrow batch to Arrow batch, so neither a batch nor a
conversation has to be in memory. A conversation of any length is many stretches:

1. forward: the cheapest cost from each state before a stretch to each state after it (4 x 4 numbers a stretch);
2. backward over stretches: the cost still to come after each stretch;
3. backward over rows: for each row and state the first edit of the cheapest rest, written as two bytes a row (the
   backpointers, spilled to the shared folder), and the state after the stretch for each state before it;
4. forward over stretches: the state in which each stretch is entered;
5. forward over rows: the backpointers followed, which gives the edits and the repaired rows.

Places come from ``ordered.with_position``, which has no hot group either. Only numbers travel through these passes;
texts are joined at the end. A SHA-256 has to read a conversation's repaired text in order: it is streamed, a stretch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangelake.llm import packs
from rangelake.operators.ordered import with_position

#: Rows of a stretch.
STRETCH = 4096

#: Costs of edits.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5

#: States of the role initials written so far: nothing, a system turn, last a user turn, last an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = np.array([USER, USER, ASSISTANT, USER])  # the state after the turn that may follow
_NEVER = 1 << 60
#: Inserts still needed at the end: none, user and assistant, assistant, none.
_TAIL = np.array([0, 2, 1, 0])
_LETTER = {"s": 0, "u": 1, "a": 2}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_DELETE, _KEEP, _REROLE = range(3)


def with_damage(turns: DataFrame) -> DataFrame:
    """The conversations after damage by the checksum of `conv_id:turn`; a null reads as one space, and the turn stays null."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), fate.alias("_fate")).where("_fate <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fate") == 1, F.lit("")).when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(0), F.when(F.col("_fate") == 3, 1).otherwise(0))).alias("_copy"),
    ).drop("_copy")


def _key() -> Column:
    """Tells conversations apart, a null id among them."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def lines(turns: DataFrame, stretch: int = STRETCH, limit: int | None = None) -> DataFrame:
    """key, stretch, pos (place in the conversation), letter (0 s, 1 u, 2 a, 3 other), fault (0 none, 1 blank, 2 duplicate, 3 truncated), turn, role, text."""
    order = turns.select(
        _key().alias("key"), "turn", "role", "text",
        F.col("turn").isNotNull().alias("_set"), F.substring("text", 1, 200).alias("_head"), F.sha2("text", 256).alias("_digest"),
    )
    by = ["_set", "turn", "role", "_head", "_digest"]
    placed = with_position(order, ["key"], by, **({} if limit is None else {"limit": limit})).withColumnRenamed("_pos", "pos")
    bare = F.translate("text", " \t\n\u000b\u000c\r", "")
    named = placed.withColumns({"stretch": F.floor(F.col("pos") / stretch).cast("long"), "_blank": bare == ""}).drop("_n", "_set", "_head")
    first = named.where("NOT _blank").groupBy("key", "role", "_digest").agg(F.min("pos").alias("_first"))
    joined = named.join(first, ["key", "role", "_digest"], "left")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("_blank"), 1).when(F.col("_first") < F.col("pos"), 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    return joined.select("key", "stretch", "pos", letter.cast("int").alias("letter"), fault.cast("int").alias("fault"), "turn", "role", "text")


def _actions(letter: int, fault: int) -> list[tuple[tuple[int, int, int], ...]]:
    """Per state the edits of a row as (action, cost, state after), without inserts before it."""
    out = []
    for state in range(4):
        own = [(_DELETE, DELETE, state)]
        if fault not in (1, 2):
            more = TRUNCATED if fault == 3 else 0
            after = int(_NEXT[state])
            if letter == 0 and state == EMPTY:
                own.append((_KEEP, more, SYSTEM))
            if letter in (1, 2) and after == (USER if letter == 1 else ASSISTANT):
                own.append((_KEEP, more, after))
            own.append((_REROLE, REROLE + more, after))
        out.append(tuple(own))
    return out


_ACTIONS = [[_actions(letter, fault) for fault in range(4)] for letter in range(4)]


def _step(letter: int, fault: int) -> np.ndarray:
    """Cheapest cost from each state before a row to each state after it, inserts before the row included."""
    out = np.full((4, 4), _NEVER, np.int64)
    for state in range(4):
        at, paid = state, 0
        for _ in range(3):
            for _, cost, after in _ACTIONS[letter][fault][at]:
                out[state, after] = min(out[state, after], paid + cost)
            at, paid = int(_NEXT[at]), paid + INSERT
    return out


#: The cost table of no rows.
_IDLE = np.where(np.eye(4, dtype=bool), 0, _NEVER)
_STEPS = np.array([[_step(letter, fault) for fault in range(4)] for letter in range(4)])


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two cost tables in the (min, +) sense."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _NEVER)


def _choose(letter: int, fault: int, rest: list[int]) -> tuple[list[int], int, list[int]]:
    """Cost from each state before a row to the end, its first edits (inserts, then an action) and the state after it.

    Edits rank D, I, K, R: of equally cheap ones the first in this order is taken, which makes the whole audit ASCII-least.
    Two bytes hold the edits of the four states: two bits of inserts, two of the action.
    """
    actions = _ACTIONS[letter][fault]
    plain = [min(cost + rest[after] for _, cost, after in own) for own in actions]
    one = [min(plain[s], INSERT + plain[_NEXT[s]], 2 * INSERT + plain[_NEXT[_NEXT[s]]]) for s in range(4)]
    pointer, after_row = 0, [0] * 4
    for state in range(4):
        at, inserts = state, 0
        while True:
            best = {action: after for action, cost, after in actions[at] if cost + rest[after] == one[at]}
            if _DELETE in best:
                action = _DELETE
            elif inserts < 2 and INSERT + one[_NEXT[at]] == one[at]:
                at, inserts = int(_NEXT[at]), inserts + 1
                continue
            else:
                action = min(best)
            pointer |= (inserts | action << 2) << 4 * state
            after_row[state] = best[action]
            break
    return one, pointer, after_row


def _streamed(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of a key in one task and in order."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def _edges(frame: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """Runs of equal keys."""
    new = np.ones(len(frame), bool)
    for k, name in enumerate(keys):
        v = frame[name].to_numpy()
        new[1:] = (v[1:] != v[:-1]) | (new[1:] if k else False)
    cut = np.append(np.flatnonzero(new), len(frame))
    return list(zip(cut[:-1].tolist(), cut[1:].tolist()))


def stretch_costs(rows: DataFrame) -> DataFrame:
    """Per stretch its cost table ``m``, first and last letter, illegal neighbours inside, and the counts of faults."""

    columns = ["key", "stretch", "m", "first", "last", "illegal", "blank", "duplicate", "truncated"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = m = chain = counts = None
        first = last = -1

        def row() -> tuple:
            return (*key, m.ravel().tolist(), first, last, *counts.tolist())

        for frame in frames:
            done = []
            letters, faults = frame["letter"].to_numpy(), frame["fault"].to_numpy()
            for low, high in _edges(frame, ["key", "stretch"]):
                own = (frame["key"].iloc[low], int(frame["stretch"].iloc[low]))
                chain = letters[low:high]
                if own != key:
                    if key is not None:
                        done.append(row())
                    key, m, counts, first = own, _IDLE, np.zeros(4, np.int64), int(chain[0])
                else:
                    chain = np.append(last, chain)
                last = int(chain[-1])
                for x, f in zip(letters[low:high].tolist(), faults[low:high].tolist()):
                    m = _then(m, _STEPS[x][f])
                counts[0] += int((~np.isin(chain[:-1] * 4 + chain[1:], _LEGAL)).sum())
                counts[1:] += np.bincount(faults[low:high], minlength=4)[1:]
            if done:
                yield pd.DataFrame(done, columns=columns)
        if key is not None:
            yield pd.DataFrame([row()], columns=columns)

    narrow = rows.select("key", "stretch", "pos", "letter", "fault")
    return _streamed(narrow, ["key", "stretch"], [F.asc("pos")]).mapInPandas(run, "key string, stretch long, m array<long>, first int, last int, illegal long, blank long, duplicate long, truncated long")


#: Legal neighbours as 4 * letter + letter: su, ua, au.
_LEGAL = np.array([0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])


def stretch_ends(costs: DataFrame) -> DataFrame:
    """Per stretch ``rest``, the cost from each state after it to the end; on a conversation's first stretch also its whole cost and counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rest, sums, first, seen = None, None, None, None, False
        columns = ["key", "stretch", "rest", "cost", "illegal", "blank", "duplicate", "truncated"]
        for frame in frames:
            done = []
            for r in frame.itertuples(index=False):
                if r.key != key:
                    key, rest, sums, first = r.key, INSERT * _TAIL, np.zeros(4, np.int64), None
                m = np.array(r.m, np.int64).reshape(4, 4)
                before = np.minimum((m + rest[None, :]).min(axis=1), _NEVER)
                sums = sums + np.array([r.illegal, r.blank, r.duplicate, r.truncated])
                if first is not None and r.last * 4 + first not in _LEGAL:
                    sums[0] += 1
                whole = r.stretch == 0
                done.append((key, r.stretch, rest.tolist(), int(before[EMPTY]) if whole else None, *([int(v) for v in sums] if whole else [None] * 4)))
                rest, first = before, r.first
            if done:
                yield pd.DataFrame(done, columns=columns).astype({c: "Int64" for c in columns[3:]})

    return _streamed(costs, ["key"], [F.desc("stretch")]).mapInPandas(run, "key string, stretch long, rest array<long>, cost long, illegal long, blank long, duplicate long, truncated long")


def backpointers(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """key, stretch, pos, pointer; ``after`` on a stretch's first row: the state after the stretch for each state before it, two bits each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rest, through = None, None, None
        for frame in frames:
            pointers, after = np.zeros(len(frame), np.int32), [None] * len(frame)
            letters, faults, places, firsts = (frame[c].to_numpy() for c in ("letter", "fault", "pos", "first_pos"))
            for low, high in _edges(frame, ["key", "stretch"]):
                own = (frame["key"].iloc[low], int(frame["stretch"].iloc[low]))
                if own != key:
                    key, rest, through = own, [int(v) for v in frame["rest"].iloc[low]], [0, 1, 2, 3]
                for i in range(low, high):
                    rest, pointers[i], follow = _choose(int(letters[i]), int(faults[i]), rest)
                    through = [through[s] for s in follow]
                    if places[i] == firsts[i]:
                        after[i] = sum(s << 2 * k for k, s in enumerate(through))
            yield pd.DataFrame({"key": frame["key"], "stretch": frame["stretch"], "pos": frame["pos"], "pointer": pointers, "after": pd.array(after, "Int32")})

    size = rows.groupBy("key", "stretch").agg(F.min("pos").alias("first_pos"))
    told = ends.select("key", "stretch", "rest").join(size, ["key", "stretch"])
    narrow = rows.select("key", "stretch", "pos", "letter", "fault").join(told, ["key", "stretch"])
    return _streamed(narrow, ["key", "stretch"], [F.desc("pos")]).mapInPandas(run, "key string, stretch long, pos long, pointer int, after int")


def entry_states(pointers: DataFrame) -> DataFrame:
    """key, stretch, state: the state in which each stretch is entered."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, EMPTY
        for frame in frames:
            done = []
            for r in frame.itertuples(index=False):
                key, state = r.key, EMPTY if r.key != key else state
                after = int(r.after) >> 2 * state & 3
                done.append((r.key, r.stretch, state))
                state = after
            yield pd.DataFrame(done, columns=["key", "stretch", "state"])

    return _streamed(pointers.where("after IS NOT NULL").select("key", "stretch", "after"), ["key"], [F.asc("stretch")]).mapInPandas(run, "key string, stretch long, state int")


def followed(pointers: DataFrame, entries: DataFrame) -> DataFrame:
    """key, stretch, pos, edits (letters of a row), inserted (roles of the turns put in before it), role (as repaired, null where it stays as it is), gone, after (the state after the row)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, EMPTY
        for frame in frames:
            edits, inserted, roles, gone, states = [], [], [], [], []
            pointers, letters = frame["pointer"].to_numpy(), frame["letter"].to_numpy()
            for low, high in _edges(frame, ["key", "stretch"]):
                own = (frame["key"].iloc[low], int(frame["stretch"].iloc[low]))
                if own != key:
                    key, state = own, int(frame["state"].iloc[low])
                for i in range(low, high):
                    code = int(pointers[i]) >> 4 * state & 15
                    inserts, action = code & 3, code >> 2
                    put = []
                    for _ in range(inserts):
                        state = int(_NEXT[state])
                        put.append(_ROLE[state])
                    edits.append("I" * inserts + "DKR"[action])
                    inserted.append(put)
                    gone.append(action == _DELETE)
                    kept_system = action == _KEEP and state == EMPTY and letters[i] == 0
                    if action != _DELETE:
                        state = SYSTEM if kept_system else int(_NEXT[state])
                    roles.append(_ROLE[state] if action == _REROLE else None)
                    states.append(state)
            yield pd.DataFrame({"key": frame["key"], "stretch": frame["stretch"], "pos": frame["pos"], "edits": edits, "inserted": inserted, "new_role": roles, "gone": gone, "after": states})

    joined = pointers.join(entries, ["key", "stretch"])
    return _streamed(joined.select("key", "stretch", "pos", "pointer", "letter", "state"), ["key", "stretch"], [F.asc("pos")]).mapInPandas(
        run, "key string, stretch long, pos long, edits string, inserted array<string>, new_role string, gone boolean, after int")


def repair(turns: DataFrame, stretch: int = STRETCH, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, costs) of conversations that need no further damage.

    ``rows``: key, stretch, pos, edits and ``turns``, the repaired turns (role, text) that come from a row, those put in
    before it (and after the last row) included. ``costs``: key, cost, illegal, blank, duplicate, truncated.
    """
    placed = packs.stored(lines(turns, stretch, limit))
    ends = packs.stored(stretch_ends(stretch_costs(placed)))
    pointers = packs.stored(backpointers(placed, ends))
    letters = placed.select("key", "stretch", "pos", "letter")
    walked = followed(pointers.join(letters, ["key", "stretch", "pos"]), packs.stored(entry_states(pointers)))
    last = placed.groupBy("key").agg(F.max("pos").alias("pos")).withColumn("_last", F.lit(True))
    joined = walked.join(placed.select("key", "pos", "role", "text"), ["key", "pos"]).join(last, ["key", "pos"], "left")
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    put = F.transform("inserted", lambda r: turn(r, F.lit("")))
    own = F.when(F.col("gone"), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(turn(F.coalesce("new_role", "role"), F.col("text"))))
    need = F.when(F.col("_last"), F.element_at(F.array(*[F.lit(int(v)) for v in _TAIL]), F.col("after") + 1)).otherwise(0)
    tail_roles = F.when(need == 2, F.array(F.lit("user"), F.lit("assistant"))).when(need == 1, F.array(F.lit("assistant"))).otherwise(F.array().cast("array<string>"))
    tail = F.transform(tail_roles, lambda r: turn(r, F.lit("")))
    rows = joined.select("key", "stretch", "pos", F.concat("edits", F.repeat(F.lit("I"), need)).alias("edits"), F.concat(put, own, tail).alias("turns"))
    costs = ends.where("stretch = 0").drop("stretch", "rest")
    return rows, costs


def digest(conversations: DataFrame, stretch: int = STRETCH, limit: int | None = None) -> DataFrame:
    """One row for every conversation of the table: what the damage did, the cheapest repair's cost, audit and digest.

    Columns as the contract names them. A null id is a conversation of its own. Rows of equal turn (repeated rows and null
    turns among them) go by role, then by text (its first 200 characters, then its SHA-256). Conversations that the damage
    empties have zeros, an empty audit and the digest of nothing; so does one whose rows are all deleted, apart from its
    counts. Texts may be empty or very long; further columns are left out; an empty table gives an empty table.
    """
    damaged = packs.stored(with_damage(conversations))
    rows, costs = repair(damaged, stretch, limit)
    spread = damaged.groupBy(_key().alias("key")).agg(F.min("turn").alias("_low"), F.max("turn").alias("_high"))
    distinct = damaged.where("turn IS NOT NULL").select(_key().alias("key"), "turn").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("_turns"))
    gaps = spread.join(distinct, "key", "left").select("key", F.coalesce(F.col("_high") - F.col("_low") + 1 - F.col("_turns"), F.lit(0)).cast("long").alias("gaps"))

    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    pieces = rows.select("key", "stretch", F.struct("pos", "edits", spoken.alias("told")).alias("row")).groupBy("key", "stretch").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    pieces = pieces.select(
        "key", "stretch", F.array_join(F.transform("rows", lambda r: r["edits"]), "").alias("edits"), F.flatten(F.transform("rows", lambda r: r["told"])).alias("told"),
    ).select("key", "stretch", "edits", (F.size("told") > 0).alias("any"), F.array_join("told", "\n").alias("told"))

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha, edits, begun = None, None, [], False
        for frame in frames:
            done = []
            for r in frame.itertuples(index=False):
                if r.key != key:
                    if key is not None:
                        done.append((key, "".join(edits), sha.hexdigest()))
                    key, sha, edits, begun = r.key, hashlib.sha256(), [], False
                edits.append(r.edits)
                if r.any:
                    sha.update((("\n" if begun else "") + r.told).encode())
                    begun = True
            if done:
                yield pd.DataFrame(done, columns=["key", "audit", "sha"])
        if key is not None:
            yield pd.DataFrame([(key, "".join(edits), sha.hexdigest())], columns=["key", "audit", "sha"])

    told = _streamed(pieces, ["key"], [F.asc("stretch")]).mapInPandas(hashed, "key string, audit string, sha string")
    every = conversations.select("conv_id", _key().alias("key")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(costs, "key", "left").join(gaps, "key", "left").join(told, "key", "left").select(
        "conv_id", zero("gaps"), zero("blank"), zero("duplicate"), zero("truncated"), zero("illegal"), zero("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
