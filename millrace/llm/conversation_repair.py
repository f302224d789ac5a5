"""Conversations put in order by the cheapest edits: a Viterbi search whose survivors' common past is given out at once."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from millrace.llm.common import spread_join, written

#: Rows of a conversation that are searched apart from the others; a conversation of more rows is joined from such parts.
SEGMENT = 2048
SPACE = " \t\n\x0b\x0c\r"
#: What roles so far leave: nothing yet, a system turn, a user turn that waits for its answer, whole pairs.
NONE, SYSTEM, USER, PAIRS = range(4)
KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 2, 3, 2, 1

Edges = dict[tuple[int, int], tuple[int, str]]


def _better(edges: Edges, at: tuple[int, int], cost: int, label: str) -> None:
    if at not in edges or (cost, label) < edges[at]:
        edges[at] = (cost, label)


def _then(first: Edges, second: Edges) -> Edges:
    out: Edges = {}
    for (a, b), (cost, label) in first.items():
        for (c, d), (more, rest) in second.items():
            if b == c:
                _better(out, (a, d), cost + more, label + rest)
    return out


def _inserts() -> Edges:
    one: Edges = {(s, s): (0, "") for s in range(4)}
    for s in (NONE, SYSTEM, PAIRS):
        one[s, USER] = (INSERT, "I")
    one[USER, PAIRS] = (INSERT, "I")
    return _then(one, one)


def _of_row(initial: str, must: bool, cut: bool) -> Edges:
    """The ways through a row, from state to state, with what may be inserted after it."""
    out: Edges = {(s, s): (DELETE, "D") for s in range(4)}
    if not must:
        for s in range(4):
            goal = PAIRS if s == USER else USER
            _better(out, (s, goal), REROLE + OPEN_END * cut, "R")
            if (initial, goal) in (("u", USER), ("a", PAIRS)):
                _better(out, (s, goal), KEEP + OPEN_END * cut, "K")
        if initial == "s":
            out[NONE, SYSTEM] = (KEEP + OPEN_END * cut, "K")
    return _then(out, INSERTS)


INSERTS = _inserts()
OF_ROW = {(i, must, cut): _of_row(i, must, cut) for i in ("s", "u", "a", "") for must in (False, True) for cut in (False, True)}
#: Before the first row something may be inserted as well.
OF_FIRST = {k: _then(INSERTS, v) for k, v in OF_ROW.items()}


class Node:
    """The last step of a way; its refs are the steps after it and the survivors that end here."""

    __slots__ = ("parent", "label", "depth", "refs", "next")

    def __init__(self, parent: Node | None, label: str):
        self.parent, self.label, self.depth = parent, label, parent.depth + 1 if parent else 0
        self.refs, self.next = 0, None


class Survivors:
    """The best way to each state, in a tree of back pointers. Nodes without refs are freed; once all survivors share an
    ancestor, the steps up to it are final and are given out, so what is held is what is not decided yet."""

    def __init__(self, entry: int = NONE):
        self.root = Node(None, "")
        self.at: dict[int, tuple[int, Node]] = {entry: (0, self.root)}
        self.root.refs = 1

    @staticmethod
    def _less(a: tuple[Node, str], b: tuple[Node, str]) -> bool:
        """Whether one way's edits sort before another's: all that follows their last common step is compared."""
        (x, last_x), (y, last_y) = a, b
        left, right = [last_x], [last_y]
        while x is not y:
            if x.depth >= y.depth:
                left.append(x.label)
                x = x.parent
            else:
                right.append(y.label)
                y = y.parent
        return "".join(reversed(left)) < "".join(reversed(right))

    def _free(self, node: Node) -> None:
        while node.refs == 0 and node.parent is not None:
            node.parent.refs -= 1
            node = node.parent

    def advance(self, edges: Edges) -> None:
        best: dict[int, tuple[int, Node, str]] = {}
        for (a, b), (more, label) in edges.items():
            if a in self.at:
                cost, node = self.at[a]
                now = best.get(b)
                if now is None or cost + more < now[0] or cost + more == now[0] and self._less((node, label), now[1:]):
                    best[b] = (cost + more, node, label)
        if PAIRS in best:  # from whole pairs all goes on that does from a system turn, and for a deletion more what does from nothing
            pairs = best[PAIRS][0]
            if SYSTEM in best and pairs < best[SYSTEM][0]:
                del best[SYSTEM]
            if NONE in best and pairs + DELETE < best[NONE][0]:
                del best[NONE]
        after = {}
        for state, (cost, parent, label) in best.items():
            parent.refs += 1
            node = Node(parent, label)
            node.refs = 1
            after[state] = (cost, node)
        before, self.at = self.at, after
        for _, node in before.values():
            node.refs -= 1
            self._free(node)

    def decided(self) -> list[str]:
        """The steps that all survivors share and that were not given out before."""
        if self.root.refs != 1 or not self.at or any(node is self.root for _, node in self.at.values()):
            return []
        ends = [node for _, node in self.at.values()]
        while len({id(n) for n in ends}) > 1:  # to the last common step
            deep = max(n.depth for n in ends)
            ends = [n.parent if n.depth == deep else n for n in ends]
        out, node = [], ends[0]
        new_root = node
        while node is not self.root:
            out.append(node.label)
            node = node.parent
        if new_root is not self.root:
            new_root.parent, self.root = None, new_root
        return out[::-1]

    def path(self, node: Node) -> list[str]:
        out = []
        while node is not self.root:
            out.append(node.label)
            node = node.parent
        return out[::-1]

    def finish(self) -> tuple[int, list[str]]:
        """The cheapest way to a legal end (of equal ones the one whose edits sort first), without what was given out."""
        ends = [self.at[s] for s in (NONE, PAIRS) if s in self.at]
        cost, node = ends[0]
        for more, other in ends[1:]:
            if more < cost or more == cost and self._less((other, ""), (node, "")):
                cost, node = more, other
        return cost, self.path(node)


class Row(NamedTuple):
    role: str
    text: str
    kind: tuple[str, bool, bool]


class Tally:
    """Counts over a run of rows in order, which can be joined with those of the run after it."""

    FIELDS = ("n", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last")

    def __init__(self) -> None:
        self.n = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, fault: str) -> None:
        one = Tally()
        one.n, one.first, one.last = 1, role[:1], role[:1]
        if turn is not None:
            one.low, one.high, one.turns = turn, turn, 1
        if fault:
            setattr(one, fault, 1)
        self.join(one)

    def join(self, after: Tally) -> None:
        if not after.n:
            return
        if self.n:
            self.illegal += self.last + after.first not in ("su", "ua", "au")
        else:
            self.first = after.first
        self.last = after.last
        self.turns += after.turns - (self.high is not None and self.high == after.low)
        self.low = after.low if self.low is None else self.low
        self.high = after.high if after.high is not None else self.high
        for name in ("n", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(after, name))

    def values(self) -> tuple:
        return tuple(getattr(self, f) for f in self.FIELDS)

    @classmethod
    def of(cls, values: dict) -> Tally:
        out = cls()
        for f in cls.FIELDS:
            setattr(out, f, values[f])
        return out


class Writer:
    """Edits applied to rows as they come: the audit and the hash of the repaired lines, none of which is held."""

    def __init__(self) -> None:
        self.state, self.audit, self.hash, self.lines = NONE, [], hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
        self.lines += 1

    def apply(self, edits: str, rows: Iterator[tuple[str, str]]) -> None:
        self.audit.append(edits)
        for edit in edits:
            role, text = next(rows) if edit != "I" else ("", "")
            if edit == "D":
                continue
            if edit == "K" and role[:1] == "s":
                self.state = SYSTEM
            else:
                waits = self.state == USER
                self.state = PAIRS if waits else USER
                role = role if edit == "K" else "assistant" if waits else "user"
            self._line(role, text)


_COUNTS = [(f, pa.string() if f in ("first", "last") else pa.int64()) for f in Tally.FIELDS]
_OUT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_FOUND = pa.schema([*_OUT, ("part", pa.int64()), ("costs", pa.list_(pa.int32())), *((c, pa.list_(pa.string())) for c in ("labels", "roles", "texts")), ("tally", pa.struct(_COUNTS))])


def _result(conv: int | None, tally: Tally, cost: int, out: Writer) -> tuple:
    gaps = tally.high - tally.low + 1 - tally.turns if tally.low is not None else 0
    return conv, gaps, tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, "".join(out.audit), out.hash.hexdigest()


def _whole(conv: int | None, rows: list[Row], tally: Tally) -> tuple:
    """A conversation whose rows are all here."""
    ways, out, held, given = Survivors(), Writer(), iter([(r.role, r.text) for r in rows]), OF_FIRST
    for row in rows:
        ways.advance(given[row.kind])
        given = OF_ROW
        for edits in ways.decided():
            out.apply(edits, held)
    cost, rest = ways.finish()
    for edits in rest:
        out.apply(edits, held)
    return _result(conv, tally, cost, out)


def _part(rows: list[Row]) -> Edges:
    """The best way through rows from each state to each."""
    out: Edges = {}
    for entry in range(4):
        ways, given, done = Survivors(entry), OF_FIRST, []
        for row in rows:
            ways.advance(given[row.kind])
            given = OF_ROW
            done += ways.decided()
        for state, (cost, node) in ways.at.items():
            out[entry, state] = (cost, "".join(done + ways.path(node)))
    return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Row], Tally, bool]]:
    """From sorted events the rows of each conversation, by parts of SEGMENT rows; whether that is all of it for sure. The first and
    the last conversation of a task may have rows in the tasks beside it."""
    conv: Any = ...
    rows: list[Row] = []
    tally, seen, before, whole = Tally(), None, None, False
    for batch in batches:
        for c, turn, role, h, kind, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "h", "kind", "text")), strict=True):
            if c != conv or conv is ...:
                if conv is not ...:
                    yield conv, rows, tally, whole
                whole = conv is not ...
                conv, rows, tally, seen, before = c, [], Tally(), None, None
            if kind == 0:  # dropped: says only that the conversation is there
                continue
            key = (turn, role, h)
            if kind == 1:  # says of the rows after it that they came before
                seen = key
                continue
            plain = text.strip(SPACE)
            fault = "blank" if not plain else "duplicate" if key in (seen, before) else "truncated" if plain[-1] not in ".!?" else ""
            before = key
            if len(rows) == SEGMENT:
                yield conv, rows, tally, False
                rows, tally, whole = [], Tally(), False
            tally.add(turn, role, fault)
            initial = role[:1] if role[:1] in ("s", "u", "a") else ""
            rows.append(Row(role, text, (initial, fault in ("blank", "duplicate"), fault == "truncated")))
    if conv is not ...:
        yield conv, rows, tally, False


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that are whole in this task, and parts of the others."""
    task, n = TaskContext.get().partitionId(), 0
    out: list[dict] = []
    for conv, rows, tally, whole in _conversations(batches):
        if whole:
            out.append(dict(zip(_OUT.names, _whole(conv, rows, tally), strict=True)))
        else:
            ways = _part(rows)
            out.append({"conv_id": conv, "part": (task << 32) + n, "costs": [ways[k][0] if (k := divmod(i, 4)) in ways else -1 for i in range(16)], "labels": [ways[k][1] if (k := divmod(i, 4)) in ways else "" for i in range(16)],
                        "roles": [r.role for r in rows], "texts": [r.text for r in rows], "tally": dict(zip(Tally.FIELDS, tally.values(), strict=True))})
            n += 1
        if len(out) >= (500 if whole else 20):
            yield pa.RecordBatch.from_pylist(out, _FOUND)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _FOUND)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their parts in order. The same search, a part a step; a part's rows are held until its edits are decided."""
    conv: Any = ...
    for batch in batches:
        for row in batch.to_pylist():
            if row["conv_id"] != conv or conv is ...:
                if conv is not ...:
                    yield pa.RecordBatch.from_pylist([_last(conv, *state)], _OUT)
                conv, state = row["conv_id"], (Tally(), Survivors(), Writer(), deque())
            tally, ways, out, held = state
            tally.join(Tally.of(row["tally"]))
            held.append((row["roles"], row["texts"]))
            ways.advance({divmod(i, 4): (cost, label) for i, (cost, label) in enumerate(zip(row["costs"], row["labels"], strict=True)) if cost >= 0})
            for edits in ways.decided():
                out.apply(edits, zip(*held.popleft(), strict=True))
    if conv is not ...:
        yield pa.RecordBatch.from_pylist([_last(conv, *state)], _OUT)


def _last(conv: int | None, tally: Tally, ways: Survivors, out: Writer, held: deque) -> dict:
    cost, rest = ways.finish()
    for edits in rest:
        out.apply(edits, zip(*held.popleft(), strict=True))
    return dict(zip(_OUT.names, _result(conv, tally, cost, out), strict=True))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32(conv_id:turn) % 20: 0 drops (gone), 1 empties, 2 takes the ends of
    sentences, 3 repeats, 4 sets the role to user. Nulls in the hashed text, role and text count as one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), times.alias("_")).drop("_")


def repair(rows: DataFrame) -> DataFrame:
    """What is wrong with each conversation's rows (conv_id, turn, role, text, gone), and the cheapest edits that mend it.

    Rows go by turn, nulls first; rows of one turn by role and by the MD5 of their text. Rows with gone only say that their conversation
    is there. Edits: keep 0, set the role to user or assistant 2, delete 3 (a must for blank rows and those whose role and text came
    before), insert an empty user or assistant row 2; a kept row that ends in the middle of a sentence adds 1. The roles that are left
    begin with at most one system, then pairs of user and assistant; or nothing is left. Of equally cheap ways the one whose
    edits' initials sort first is taken. A role other than the three must go or be set anew.

    The search goes through the rows once with at most four survivors (see Survivors); ties are settled by comparing all edits since their last
    common step. Rows are dealt by ranges of conversation, turn, role and hash, so a conversation of any size is spread over
    tasks. One that lies inside a task is searched there. Of others each task gives, for its parts of SEGMENT rows, the best way from each
    state to each: 16 costs and edits. These parts are joined in order by the same search, whose steps are parts. So rows are searched
    in parallel; only that join, and the hash of a conversation's whole repaired text, which is sequential by nature, is one task for a
    conversation, and it streams: it holds no more than the parts that are not decided, and the audit. Whether a row came before is found by
    an aggregation over (conversation, role, hash), whose hot keys are broadcast in the join back.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; a row for each conv_id, null too. Null roles and
    texts count as one space. An empty table gives an empty result; other columns are not read.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hashed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.md5(text)).alias("h"), text.alias("text"), F.coalesce("gone", F.lit(False)).alias("gone"))
    same = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.hex("h"), "role")))
    there = hashed.filter(~F.col("gone") & F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("conv_id", "turn", "role", "h", same.alias("same"))
    often = there.groupBy("same").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last"), F.count(F.lit(1)).alias("n"))
    often = written(often.filter("first < last").drop("last"), "said-again")
    again = spread_join(there, often, ["same"], "n").filter(F.struct("turn") > F.col("first")).select("conv_id", "turn", "role", "h").distinct()

    kind: Column = F.when(F.col("gone"), 0).otherwise(2)
    events = hashed.select("conv_id", "turn", "role", "h", kind.alias("kind"), "text").unionByName(again.select("*", F.lit(1).alias("kind"), F.lit("").alias("text")))
    sorted_ = events.repartitionByRange(parts, "conv_id", "turn", "role", "h").sortWithinPartitions("conv_id", "turn", "role", "h", "kind")
    found = written(sorted_.mapInArrow(_search, from_arrow_schema(_FOUND)), "searched")
    pieces = found.filter("part IS NOT NULL").select("conv_id", "part", "costs", "labels", "roles", "texts", "tally")
    joined = pieces.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_join, from_arrow_schema(_OUT))
    return found.filter("part IS NULL").select(*_OUT.names).unionByName(joined)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))
