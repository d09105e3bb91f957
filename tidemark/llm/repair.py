"""Conversation structure repair: the cheapest edits to a legal turn order, by iterative-deepening A*."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: States of a conversation so far: nothing, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NEXT = {START: {SYSTEM, USER}, SYSTEM: {USER}, USER: {ASSISTANT}, ASSISTANT: {USER}}
#: The user or assistant turn that may follow; the only one that an insertion or a new role can make.
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
PIECE = 512


def cheapest_edits(initials: list[str], faults: str, start: int, accept: frozenset[int]) -> tuple[int, str, int] | None:
    """(cost, edits, state reached): the cheapest edits of these rows that lead from `start` to an accepted
    state, of equally cheap ones the ASCII-least; None if there are none.

    faults has a letter a row: `x` must go (blank or duplicate), `t` costs one more unless deleted, `-` none.
    Iterative deepening A*: depth-first in the order Delete, Insert, Keep, Rerole under a bound on cost so
    far + least cost to come, raised to the least sum that passed it. States (row, state) that failed are kept
    with the cost they failed at and not entered again at that cost or more. As edits are tried
    in ASCII order and the bound is the least cost in the last round, its first accepting path is the answer.
    """
    n = len(initials)
    if n == 0 and start in accept:
        return 0, "", start
    state = [STATE_OF.get(c, -1) for c in initials]
    # Of each suffix: what its rows cost in any case, its first row that may stay, whether a system row may stay, and
    # how few edits can mend its illegal neighbours: an edit mends two that share its row at most.
    sure, head, system, mends = [0] * (n + 1), [n] * (n + 1), [False] * (n + 1), [0] * (n + 2)
    for i in range(n - 1, -1, -1):
        sure[i], head[i], system[i], mends[i] = sure[i + 1], head[i + 1], system[i + 1], mends[i + 1]
        if faults[i] == "x":
            sure[i] += DELETE
            continue
        sure[i] += CUT_OFF * (faults[i] == "t")
        system[i] = system[i] or state[i] == SYSTEM
        after = head[i + 1]
        legal = state[i] in accept if after == n else state[i] >= 0 and state[after] in NEXT[state[i]]
        mends[i] = mends[after] if legal else 1 + mends[head[after + 1] if after < n else n]
        head[i] = i

    def to_come(i: int, at: int) -> float:
        """Never more than the true cost: each further edit costs 2 at least."""
        if at in (USER, ASSISTANT) and not accept & {USER, ASSISTANT}:
            return math.inf
        if at == SYSTEM and accept == {START} or at == START and accept == {SYSTEM} and not system[i]:
            return math.inf
        first = head[i]
        legal = at in accept if first == n else state[first] in NEXT[at]
        return sure[i] + 2 * (mends[first] if legal else 1 + mends[head[first + 1] if first < n else n])

    def steps(i: int, at: int) -> list[tuple[str, int, int, int]]:
        """(edit, next row, next state, cost), in ASCII order."""
        then = FOLLOWS[at]
        out = [("D", i + 1, at, DELETE)] if i < n else []
        out.append(("I", i, then, INSERT))
        if i < n and faults[i] != "x":
            extra = CUT_OFF * (faults[i] == "t")
            if state[i] in NEXT[at]:
                out.append(("K", i + 1, state[i], KEEP + extra))
            out.append(("R", i + 1, then, REROLE + extra))
        return out

    bound = to_come(0, start)
    while bound < math.inf:
        failed: dict[tuple[int, int], int] = {}
        beyond = math.inf
        path: list[str] = []
        stack = [(0, start, 0, iter(steps(0, start)))]
        while stack:
            i, at, cost, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                failed[i, at] = min(cost, failed.get((i, at), cost))
                stack.pop()
                if path:
                    path.pop()
                continue
            edit, j, to, more = step
            total = cost + more
            least = total + to_come(j, to)
            if least > bound:
                beyond = min(beyond, least)
                continue
            if failed.get((j, to), math.inf) <= total:
                continue
            path.append(edit)
            if j == n and to in accept:
                return total, "".join(path), to
            stack.append((j, to, total, iter(steps(j, to))))
        bound = beyond
    return None


class _Repair:
    """One conversation, its rows fed in order; long ones piece by piece.

    For each state a piece may end in, the cheapest and ASCII-least way there is kept: its cost, edits
    and the running hash of what it makes. Two equally cheap ways to one state are never a prefix of one another,
    so the lesser stays the lesser whatever follows. No more than a piece's texts are held.
    """

    def __init__(self, key):
        self.key, self.rows, self.before = key, [], None
        self.ways = {START: (0, "", hashlib.sha256())}
        self.turns = [None, None, 0]  # least, greatest, number of distinct ones
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None:
            low, high, distinct = self.turns
            self.turns = [turn if low is None else low, turn, distinct + (turn != high)]
        if fault != "none":
            self.count[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        self.before = role[:1]
        if len(self.rows) == PIECE:
            self.close(final=False)
        self.rows.append((role, text, fault))

    def close(self, final: bool) -> None:
        """Take the rows so far into every way."""
        initials = [r[0][:1] for r in self.rows]
        faults = "".join({"blank": "x", "duplicate": "x", "truncated": "t"}.get(r[2], "-") for r in self.rows)
        goals = [frozenset({START, ASSISTANT})] if final else [frozenset({s}) for s in range(4)]
        ways = {}
        for goal in goals:
            found = None
            for start, (cost, audit, sha) in self.ways.items():
                more = cheapest_edits(initials, faults, start, goal)
                if more and (found is None or (cost + more[0], audit + more[1]) < found[:2]):
                    found = (cost + more[0], audit + more[1], more, start, sha)
            if found:
                cost, audit, (_, edits, end), start, sha = found
                ways[end] = (cost, audit, self._written(sha.copy(), edits, start))
        self.ways, self.rows = ways, []

    def _written(self, sha, edits: str, at: int):
        """The hash with the repaired rows added to it."""
        rows, started = iter(self.rows), at != START
        for edit in edits:
            role, text, _ = next(rows) if edit != "I" else (None, "", None)
            if edit == "D":
                continue
            if edit == "K":
                at = STATE_OF[role[:1]]
            else:
                at = FOLLOWS[at]
                role = ROLE[at]
            sha.update((("\n" if started else "") + f"{role}:{text}").encode())
            started = True
        return sha

    def result(self) -> tuple:
        self.close(final=True)
        (cost, audit, sha), = self.ways.values()
        low, high, distinct = self.turns
        gaps = 0 if low is None else high - low + 1 - distinct
        c = self.count
        return self.key, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit, sha.hexdigest()


COLUMNS = ["gaps bigint", "blank bigint", "duplicate bigint", "truncated bigint", "illegal bigint", "cost bigint",
           "audit string", "repaired_sha256 string"]


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): the rows after damage by crc32(`conv_id:turn`) % 20; nulls are one
    space. Dropped rows stay with present = false, so that a conversation that lost all is still seen."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), word(role_col).alias("role"),
        word(text_col).alias("text"), (F.crc32(F.concat_ws(":", word(conv_col), word(turn_col))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("kind") != 0).alias("present"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
                       ).drop("copy")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row a conversation.

    rows: (conv_id, turn, role, text, present) as `damaged` gives them, or a user's own with present = true.
    Rows are taken by turn, nulls first, then role and text, so ties have one order and equal rows are neighbours;
    a null conv_id is a conversation of its own; null role and text are one space. Roles that begin with none
    of s, u, a are never kept. An empty role has no initial, so no legal neighbour.

    Earlier equal rows are found by a window over the rows' digest; then one shuffle by conversation and a sort, and
    each conversation streams through its task, PIECE rows held at a time: the contract's hash runs over all of
    a conversation in order, so one conversation is one task's stream, however long.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), "present")
    rest = F.rtrim("text", F.lit(BLANKS))
    # A blank row is blank whether or not it repeats: dealt by its turn, so that blanks never gather.
    digest = F.when(F.col("present") & (rest != ""), F.md5(F.concat_ws(":", F.md5("role"), F.md5("text")))).otherwise(
        F.concat(F.lit("blank "), F.coalesce(F.col("turn").cast("string"), F.lit(""))))
    seen = F.row_number().over(W.partitionBy("conv_id", "digest").orderBy("turn")) > 1
    marked = rows.withColumn("digest", digest).withColumn("again", seen).withColumn("last", F.right(rest, F.lit(1)))
    fault = F.when(F.col("last") == "", "blank").when(F.col("again"), "duplicate").when(
        ~F.col("last").isin(".", "!", "?"), "truncated").otherwise("none")
    ordered = marked.select("conv_id", "turn", "role", "text", "present", "again", fault.alias("fault")).repartition(
        "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: _Repair | None = None
        for b in batches:
            done = []
            for key, turn, role, text, present, fault in zip(*(b.column(c).to_pylist() for c in (
                    "conv_id", "turn", "role", "text", "present", "fault"))):
                if one is None or one.key != key:
                    if one is not None:
                        done.append(one.result())
                    one = _Repair(key)
                if present:
                    one.add(turn, role, text, fault)
            if done:
                yield batch(done)
        if one is not None:
            yield batch([one.result()])

    names = ["conv_id", *(c.split()[0] for c in COLUMNS)]
    fields = pa.schema([pa.field("conv_id", _arrow(kind)), *(
        pa.field(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in COLUMNS)])

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))), schema=fields)

    return ordered.mapInArrow(run, ", ".join([f"conv_id {kind}", *COLUMNS]))


def _arrow(kind: str) -> pa.DataType:
    known = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}
    if kind not in known:
        raise TypeError(f"conversation ids of type {kind}: cast them to a whole number or text")
    return known[kind]
