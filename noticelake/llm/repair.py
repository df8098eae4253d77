"""Repair of conversations: the cheapest edits that make turns alternate, by dynamic programming over a sorted stream.

Edits are D (delete), I (insert an empty turn), K (keep) and R (give the turn
another role).  What remains reads, by the roles' initials, ``(s?(ua)+)?``: four
states, nothing yet, after s, after u, after a.

Turns are dealt by conversation and sorted by turn; the state goes on from one
Arrow batch to the next, so a conversation of any length needs the memory of a
batch.  The program runs from a conversation's last turn to its first and holds,
for each state, what the rest costs.  For every turn one byte says what the best
edit is in each of the four states: these back-pointers go, packed and in
chunks, to a table in the folder that executors share, where nothing is lost
with an executor.  A second pass, from the first turn to the last, meets each
chunk before its turns and follows the back-pointers.  Of equally cheap edits
each state takes the letter that comes first, which gives the least audit.

Whether a turn was seen earlier is an aggregation by role and digest, so no task
holds the turns of a conversation.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import stored

WHITE = " \t\n\x0b\x0c\r"
#: Turns whose back-pointers are written together.
CHUNK = 1 << 16
#: Results of conversations, or repaired turns, that leave a task together.
TOGETHER = 2_000
EDITS, ROLES = "DIKR", "sua"
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
_NONE = 1 << 20
#: The state after a user's or assistant's turn that is inserted or given its role in a state.
_NEXT = (2, 2, 3, 2)
#: By initial (s, u, a, other) the state after keeping a turn in a state; none where that isn't allowed.
_KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None, None, None, None))
#: What is left to pay at the end: nothing in the states where a conversation may end, else the missing turns.
_END = (0, 2 * INSERT, INSERT, 0)
_SOUND, _GONE, _CUT = 0, 1, 2


def step(after: tuple[int, int, int, int], initial: int, fault: int) -> tuple[tuple[int, int, int, int], int]:
    """Costs of the rest by state before a turn, from those after it, and the best edits of the four states in one byte."""
    before, edits = [], []
    for state in range(4):
        cost, edit = DELETE + after[state], 0
        if fault != _GONE:
            more = CUT if fault == _CUT else 0
            kept = _KEPT[initial][state]
            for at, price, letter in ((kept, 0, 2), (_NEXT[state], REROLE, 3)):
                if at is not None and price + more + after[at] < cost:
                    cost, edit = price + more + after[at], letter
        before.append(cost)
        edits.append(edit)
    # inserted turns lead from state to state before the turn itself; two of them reach every state that they can
    for _ in range(2):
        for state in range(4):
            cost = INSERT + before[_NEXT[state]]
            if cost < before[state] or (cost == before[state] and edits[state] > 1):
                before[state], edits[state] = cost, 1
    return tuple(before), sum(e << (2 * k) for k, e in enumerate(edits))


class Program:
    """The dynamic program over turns from the last to the first; costs are held as differences, of which there are few, so that a turn is a lookup."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}
        self.start()

    def start(self) -> None:
        self.costs, self.paid = _END, 0

    def feed(self, initial: int, fault: int) -> int:
        key = (self.costs, initial, fault)
        found = self.known.get(key)
        if found is None:
            costs, edits = step(self.costs, initial, fault)
            least = min(costs)
            found = self.known[key] = (tuple(c - least for c in costs), least, edits)
        self.costs, least, edits = found
        self.paid += least
        return edits

    def cost(self) -> int:
        return self.paid + self.costs[0]


_KEY = ("gone", "conv")
_PLACE = ("turn", "role", "digest")
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_CHUNKS = "gone int, conv long, turn long, role string, digest string, part long, edits binary, " + ", ".join(f"n_{c} long" for c in _COUNTS)


def _backwards(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Turns in falling order -> chunks of ``size`` back-pointers; a conversation's last one has its counts."""
    program, held, last, out = Program(), None, None, []
    edits, part, counts, edge, turn_before, turns = bytearray(), 0, dict.fromkeys(_COUNTS, 0), None, None, [None, None, 0]

    def chunk(row, final: bool) -> tuple:
        numbers = [counts[c] for c in _COUNTS] if final else [None] * len(_COUNTS)
        return (*[row[c] for c in (*_KEY, *_PLACE)], part, zlib.compress(bytes(reversed(edits)), 1), *numbers)

    def finished() -> None:
        nonlocal edits, part, counts, edge, turn_before, turns
        high, low, distinct = turns
        counts |= {"cost": program.cost(), "gaps": 0 if high is None else high - low + 1 - distinct}
        out.append(chunk(last, True))
        program.start()
        edits, part, counts, edge, turn_before, turns = bytearray(), 0, dict.fromkeys(_COUNTS, 0), None, None, [None, None, 0]

    def done(frame: pd.DataFrame, same: np.ndarray) -> None:
        """Turns, and whether the one before each is the very same."""
        nonlocal last, edits, part, edge, turn_before
        fault = np.select([frame["blank"].to_numpy(), frame["later"].to_numpy() | same, frame["cut"].to_numpy()], [1, 2, 3], 0)
        initials = [ROLES.find(r[:1]) if r else -1 for r in frame["role"]]
        for row, wrong, initial in zip(frame.to_dict("records"), fault, initials):
            if last is not None and (row["gone"], row["conv"]) != (last["gone"], last["conv"]):
                finished()
            if len(edits) >= size:
                out.append(chunk(last, False))
                edits, part = bytearray(), part + 1
            initial = initial if initial >= 0 else 3
            if wrong:
                counts[("blank", "duplicate", "truncated")[wrong - 1]] += 1
            edits.append(program.feed(initial, (_SOUND, _GONE, _GONE, _CUT)[wrong]))
            if edge is not None and (initial, edge) not in ((0, 1), (1, 2), (2, 1)):
                counts["illegal"] += 1
            edge = initial
            t = row["turn"]
            if t is not None and not pd.isna(t) and t != turn_before:
                t = int(t)
                turns[0] = t if turns[0] is None else turns[0]
                turns[1], turns[2], turn_before = t, turns[2] + 1, t
            last = row

    columns = [x.split()[0] for x in _CHUNKS.split(", ")]
    for frame in frames:
        if not len(frame):
            continue
        frame["turn"] = frame["turn"].astype("Int64")
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        same = np.ones(len(frame), bool)
        for c in (*_KEY, "role", "digest"):
            same &= (frame[c] == frame[c].shift(-1)).to_numpy(bool)
        same &= ((frame["turn"] == frame["turn"].shift(-1)) | (frame["turn"].isna() & frame["turn"].shift(-1).isna())).fillna(False).to_numpy(bool)
        done(frame.iloc[:-1], same[:-1])
        held = frame.iloc[-1:]
        if len(out) >= TOGETHER:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if held is not None:
        done(held, np.zeros(1, bool))
        finished()
    yield pd.DataFrame(out, columns=columns)


class Trace:
    """Follows back-pointers from a conversation's first turn on."""

    def __init__(self) -> None:
        self.chunks: deque[bytes] = deque()
        self.here, self.at, self.state = b"", 0, 0

    def _next(self) -> int:
        if self.at == len(self.here):
            self.here, self.at = zlib.decompress(self.chunks.popleft()), 0
        self.at += 1
        return self.here[self.at - 1]

    def _put(self) -> str:
        self.state = _NEXT[self.state]
        return "assistant" if self.state == 3 else "user"

    def turn(self, role: str) -> Iterator[tuple[str, str | None]]:
        """The edits up to and with a turn, each with the role of the turn that stays."""
        edits = self._next()
        while True:
            letter = EDITS[edits >> (2 * self.state) & 3]
            if letter == "K":
                self.state = _KEPT[ROLES.index(role[0])][self.state]
                yield letter, role
            else:
                yield letter, None if letter == "D" else self._put()
            if letter != "I":
                return

    def end(self) -> Iterator[tuple[str, str | None]]:
        while self.state not in (0, 3):
            yield "I", self._put()


Event = tuple[str, "int | None", "str | None", str]


class _Digest:
    """Audit, hash and counts of each conversation."""

    schema = "gone int, conv long, audit string, repaired_sha256 string, " + ", ".join(f"{c} long" for c in _COUNTS)

    def begin(self, row: dict) -> None:
        self.row, self.audit, self.hash, self.empty = row, bytearray(), hashlib.sha256(), True

    def event(self, letter: str, turn, role: str | None, text: str) -> list[tuple]:
        self.audit += letter.encode()
        if role is not None:
            self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
            self.empty = False
        return []

    def end(self) -> list[tuple]:
        return [(self.row["gone"], self.row["conv"], self.audit.decode(), self.hash.hexdigest(), *[int(self.row[f"n_{c}"]) for c in _COUNTS])]


class _Turns:
    """The turns that stay, with their edits."""

    schema = "gone int, conv long, position long, turn long, role string, text string, edit string"

    def begin(self, row: dict) -> None:
        self.row, self.position = row, 0

    def event(self, letter: str, turn, role: str | None, text: str) -> list[tuple]:
        if role is None:
            return []
        self.position += 1
        return [(self.row["gone"], self.row["conv"], self.position, None if letter == "I" or pd.isna(turn) else int(turn), role, text, letter)]

    def end(self) -> list[tuple]:
        return []


def _forwards(kind: Callable) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = [x.split()[0] for x in kind.schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trace, result, key, out = Trace(), kind(), None, []
        for frame in frames:
            for row in frame.to_dict("records"):
                if row["edits"] is not None:
                    if (row["gone"], row["conv"]) != key:
                        if key is not None:
                            out += [x for e in trace.end() for x in result.event(e[0], None, e[1], "")] + result.end()
                        key, trace = (row["gone"], row["conv"]), Trace()
                        result.begin(row)
                    trace.chunks.append(row["edits"])
                    continue
                for letter, role in trace.turn(row["role"]):
                    out += result.event(letter, row["turn"], role, "" if letter == "I" else row["text"])
                if len(out) >= TOGETHER:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if key is not None:
            out += [x for e in trace.end() for x in result.event(e[0], None, e[1], "")] + result.end()
        yield pd.DataFrame(out, columns=columns)

    return run


def _rows(turns: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    conv = F.col("conv_id").cast("long")
    return turns.select(
        conv.isNull().cast("int").alias("gone"), F.coalesce(conv, F.lit(0).cast("long")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), F.md5(F.encode(text, "UTF-8")).alias("digest"),
    )


def _solved(turns: DataFrame, kind: Callable, size: int) -> DataFrame:
    rows = _rows(turns)
    ending = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    short = rows.select(*_KEY, *_PLACE, (ending == "").alias("blank"), (~ending.isin(".", "!", "?")).alias("cut"))
    # of turns with one role and text all but those of the first turn came later; equal ones of one turn are told apart in the stream
    again = short.groupBy(*_KEY, "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = F.coalesce(F.struct(F.col("turn").isNotNull().alias("known"), "turn") > F.col("first"), F.lit(False))
    flagged = short.join(again, [*_KEY, "role", "digest"], "left").select(*_KEY, *_PLACE, "blank", "cut", later.alias("later"))
    falling = [*_KEY, F.desc_nulls_last("turn"), F.desc("role"), F.desc("digest")]
    chunks = stored(flagged.repartition(*_KEY).sortWithinPartitions(*falling).mapInPandas(lambda frames: _backwards(frames, size), _CHUNKS))
    # a chunk lies before the first of its turns; of chunks at one place the later written one holds the earlier turns
    stream = chunks.withColumn("later", -F.col("part") - 1).unionByName(rows.select(*_KEY, *_PLACE, "text").withColumn("later", F.lit(0).cast("long")), allowMissingColumns=True)
    rising = [*_KEY, F.asc_nulls_first("turn"), "role", "digest", "later"]
    sorted_ = stream.repartition(*_KEY).sortWithinPartitions(*rising).select(*_KEY, "turn", "role", "text", "edits", *[f"n_{c}" for c in _COUNTS])
    out = sorted_.mapInPandas(_forwards(kind), kind.schema)
    return out.withColumn("conv_id", F.when(F.col("gone") == 0, F.col("conv"))).drop(*_KEY)


def repair(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conversation.

    Turns are taken in the order of ``turn``, nulls first, those of one number
    by role and the text's digest.  The first fault of a turn counts: blank, its
    role and text seen earlier, not ending in ``.``, ``!`` or ``?``.  Blank and
    repeated turns must go (4), others may (4), get another role (3), or stay;
    an empty user's or assistant's turn can be put anywhere (3); a turn without
    an ending that stays costs 3.  Null roles and texts count as one space,
    null conversations as one; an empty table gives an empty table.
    """
    return _solved(turns, _Digest, size).select("conv_id", *_COUNTS, "audit", "repaired_sha256")


def repaired_turns(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, position, turn, role, text, edit): the turns of the repaired conversations, inserted ones without a ``turn``."""
    return _solved(turns, _Turns, size).select("conv_id", "position", "turn", "role", "text", "edit")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with seeded damage by ``crc32(conv_id:turn) % 20``: 0 drops a turn, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes it the user's; nulls are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    roll = F.crc32(F.encode(F.concat(plain("conv_id"), F.lit(":"), plain("turn")), "UTF-8")) % 20
    rows = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), roll.alias("roll")).where("roll <> 0")
    text = F.when(F.col("roll") == 1, "").when(F.col("roll") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("roll") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("roll") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def repair_damaged(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """``repair`` of the damaged conversations, with a row for each conversation that there was: zeros, an empty audit and the hash of nothing where no turn is left."""
    ids = turns.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = repair(damaged(turns), size)
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
