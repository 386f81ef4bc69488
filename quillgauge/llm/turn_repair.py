"""Cheapest repair of conversations whose turns are damaged.

A conversation is repaired to the roles ``(s?(ua)+)?`` (initials of system, user, assistant) by
edits of its rows in order: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user
or assistant turn 2; a truncated row that stays adds 1, blank and duplicate rows must go. Of the
cheapest edit sequences the one whose initials are ASCII-least is taken.

The search is a Viterbi over four states (nothing yet, after system, after user, after assistant)
on a tree of backpointers with reference counts. As soon as all survivors share an ancestor, the
edits up to it are final: they are put out and forgotten, so a task holds only the unresolved
tail of one conversation (and a logarithmic number of empty nodes). Equal costs are decided by the whole unresolved suffixes: where two
paths part is found by jumps up the tree, in a logarithmic number of steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.llm.arrow_types import arrow_type

SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: state after a kept row of that initial; other rows cannot be kept there
KEEP = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
#: role that an inserted or reroled row must have in a state, and the state after it
FORCED = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
#: most that going on from the second state can save against going on from the first one
DETOUR = {
    (ASSISTANT, START): 3, (SYSTEM, START): 4, (USER, START): 5, (ASSISTANT, SYSTEM): 0, (START, SYSTEM): 0,
    (USER, SYSTEM): 2, (ASSISTANT, USER): 2, (USER, ASSISTANT): 2,
}
LEGAL = ("su", "ua", "au")
BATCH = 5_000


class Edit:
    """A node of the backpointer tree: the last edit of a path."""

    __slots__ = ("parent", "jump", "depth", "letter", "row", "role", "kids", "pins")

    def __init__(self, parent: Edit | None, letter: str, row: tuple | None, role: str | None):
        self.parent, self.letter, self.row, self.role = parent, letter, row, role
        self.kids: dict[str, Edit] = {}
        self.pins = 0  # survivors that end here
        if parent is None:
            self.depth, self.jump = 0, None
            return
        self.depth = parent.depth + 1
        up = parent.jump
        # where a jump leads depends on the depth alone, so two nodes of one depth jump equally far
        far = up is not None and up.jump is not None and parent.depth - up.depth == up.depth - up.jump.depth
        self.jump = up.jump if far else parent
        parent.kids[letter] = self


def _climb(node: Edit, depth: int) -> Edit:
    """The ancestor at a depth that is not above the root."""
    while node.depth > depth:
        node = node.jump if node.jump is not None and node.jump.depth >= depth else node.parent
    return node


def _before(a: Edit, a_letter: str, b: Edit, b_letter: str) -> bool:
    """Whether path a with one more letter is less than path b with one more; costs are equal."""
    if a is b:
        return a_letter < b_letter
    depth = min(a.depth, b.depth)
    x, y = _climb(a, depth), _climb(b, depth)
    if x is y:  # one path continues the other
        if a.depth < b.depth:
            return a_letter < _climb(b, depth + 1).letter
        return _climb(a, depth + 1).letter < b_letter
    while x.parent is not y.parent:
        if x.jump is not None and y.jump is not None and x.jump is not y.jump:
            x, y = x.jump, y.jump
        else:
            x, y = x.parent, y.parent
    return x.letter < y.letter


class Repair:
    """One conversation; ``step`` and ``finish`` return the edits that became final."""

    def __init__(self) -> None:
        self.root = Edit(None, "", None, None)
        self.root.pins = 1
        self.alive: dict[int, tuple[int, Edit]] = {START: (0, self.root)}
        self._insert()

    def step(self, row: tuple, initial: str, must_go: bool, extra: int) -> Iterator[Edit]:
        best: dict[int, tuple[int, Edit, str, str | None]] = {}

        def offer(state: int, cost: int, node: Edit, letter: str, role: str | None) -> None:
            held = best.get(state)
            if held is None or cost < held[0] or (cost == held[0] and _before(node, letter, held[1], held[2])):
                best[state] = (cost, node, letter, role)

        for state, (cost, node) in self.alive.items():
            offer(state, cost + 3, node, "D", None)
            if not must_go:
                kept = KEEP.get((state, initial))
                if kept is not None:
                    offer(kept, cost + extra, node, "K", None)
                role, after = FORCED[state]
                offer(after, cost + 2 + extra, node, "R", role)
        grown = {}
        for state, (cost, node, letter, role) in best.items():
            leaf = Edit(node, letter, row, role)
            leaf.pins = 1
            grown[state] = (cost, leaf)
        for _, node in self.alive.values():
            self._unpin(node)
        self.alive = grown
        self._insert()
        self._prune()
        return self._settled()

    def finish(self) -> Iterator[Edit]:
        ends = [(self.alive[s][0], self.alive[s][1]) for s in ACCEPTED if s in self.alive]
        best = ends[0]
        for cost, node in ends[1:]:
            if cost < best[0] or (cost == best[0] and _before(node, "", best[1], "")):
                best = (cost, node)
        for state in list(self.alive):
            if self.alive[state][1] is not best[1]:
                self._unpin(self.alive.pop(state)[1])
        return self._settled()

    def _insert(self) -> None:
        """Empty turns put in after this row: one leads from any state on, a second one back to assistant."""
        for origins in ((START, SYSTEM, ASSISTANT), (USER,)):
            chosen = None
            for state in origins:
                if state in self.alive:
                    cost, node = self.alive[state]
                    role, after = FORCED[state]
                    if chosen is None or cost + 2 < chosen[0] or (cost + 2 == chosen[0] and _before(node, "I", chosen[1], "I")):
                        chosen = (cost + 2, node, role, after)
            if chosen is None:
                continue
            cost, node, role, after = chosen
            held = self.alive.get(after)
            if held is None or cost < held[0] or (cost == held[0] and _before(node, "I", held[1], "")):
                leaf = Edit(node, "I", None, role)
                leaf.pins = 1
                self.alive[after] = (cost, leaf)
                if held is not None:
                    self._unpin(held[1])

    def _prune(self) -> None:
        """Drop survivors that can never catch up with another one."""
        for (other, state), detour in DETOUR.items():
            if other in self.alive and state in self.alive and self.alive[other][0] + detour < self.alive[state][0]:
                self._unpin(self.alive.pop(state)[1])

    def _unpin(self, node: Edit) -> None:
        node.pins -= 1
        while not node.pins and not node.kids and node.parent is not None and node is not self.root:
            parent = node.parent
            del parent.kids[node.letter]
            node.parent = node.jump = None
            node = parent

    def _settled(self) -> Iterator[Edit]:
        """Edits that all survivors share; they leave the tree."""
        while not self.root.pins and len(self.root.kids) == 1:
            (child,) = self.root.kids.values()
            # a few edits that left the tree stay as ends of jumps, without their rows
            self.root.kids, self.root.parent, self.root.row = {}, None, None
            self.root = child
            yield child


def damaged(conversations: DataFrame) -> DataFrame:
    """Damage turns by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes its
    ``[.!?]`` out, 3 repeats it, 4 makes it a user's. Nulls count as one space (turns stay null)."""

    def spelled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn"))) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("_fate")).filter("_fate <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        ).drop("_copy")
    )


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The edits of every conversation (conv_id, turn, role, text), one row each, in order of ``seq``.

    (conv_id, seq, edit, turn, role, text, fault, illegal): ``edit`` is K, R, D or I, ``role`` and
    ``text`` are those after it, ``fault`` is the row's first of blank (no visible character),
    duplicate (role and text stand earlier in the conversation), truncated (does not end in
    ``.!?``) or null, ``illegal`` says that the row's initial may not follow the row before.

    Rows are taken by turn, nulls first, ties by role and text; null roles and texts are one space. A role
    without any character cannot be kept. Null conversation ids are one conversation. Further
    columns are left out. An empty table gives no rows. A conversation is one stream through one
    task, sorted by Spark; its length is not bounded by memory.
    """
    named = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    schema = named.schema
    key, turn = schema["conv_id"].dataType.simpleString(), schema["turn"].dataType.simpleString()
    # both orders lie inside the one distribution by conversation, so there is one shuffle
    dealt = named.repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    marked = dealt.withColumn("again", F.row_number().over(earlier) > 1)
    ordered = marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again")
    types = {"conv_id": arrow_type(schema["conv_id"].dataType), "turn": arrow_type(schema["turn"].dataType)}
    return ordered.mapInArrow(
        partial(_repair, types=types),
        f"conv_id {key}, seq long, edit string, turn {turn}, role string, text string, fault string, illegal boolean",
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _repair(batches: Iterator[pa.RecordBatch], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("conv_id", types["conv_id"]), ("seq", pa.int64()), ("edit", pa.string()), ("turn", types["turn"]), ("role", pa.string()),
        ("text", pa.string()), ("fault", pa.string()), ("illegal", pa.bool_()),
    ])
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(schema)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        out.clear()
        return made

    seq, repair, current, last = 0, None, None, ""

    def put(edits: Iterator[Edit]) -> None:
        nonlocal seq
        for e in edits:
            if e.row is None:
                out.append((current, seq, "I", None, e.role, "", None, None))
            else:
                turn, role, text, fault, illegal = e.row
                out.append((current, seq, e.letter, turn, e.role or role, text, fault, illegal))
            seq += 1

    for conv_id, turn, role, text, again in _runs(batches):
        if repair is None or conv_id != current:
            if repair is not None:
                put(repair.finish())
            repair, current, seq, last = Repair(), conv_id, 0, None
        visible = text.rstrip(SPACES)
        fault = "blank" if not visible else "duplicate" if again else None if visible[-1] in ".!?" else "truncated"
        initial = role[:1]
        illegal = last is not None and last + initial not in LEGAL
        last = initial
        put(repair.step((turn, role, text, fault, illegal), initial, fault in ("blank", "duplicate"), int(fault == "truncated")))
        if len(out) >= BATCH:
            yield batch()
    if repair is not None:
        put(repair.finish())
    if out:
        yield batch()


def repair_digest(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired_turns``' rows, read in the order in which they come.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256); apply it to
    the operator's result directly, there is no shuffle between. Texts are hashed as they pass. Gaps
    beyond a 64-bit integer are its largest value.
    """
    kind = edits.schema["conv_id"].dataType
    return edits.select("conv_id", "seq", "edit", "turn", "role", "text", "fault", "illegal").mapInArrow(
        partial(_digest, key=arrow_type(kind)),
        f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
        " audit string, repaired_sha256 string",
    )


COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}


def _digest(batches: Iterator[pa.RecordBatch], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", key), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    done: list[tuple] = []
    state: dict | None = None

    def close() -> None:
        if state is not None:
            gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
            done.append((
                state["id"], min(gaps, 2**63 - 1), *(state[c] for c in counts[1:]), "".join(state["audit"]), state["sha"].hexdigest()
            ))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [()] * len(schema)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        done.clear()
        return made

    for conv_id, seq, edit, turn, role, text, fault, illegal in _runs(batches):
        if seq == 0:
            close()
            state = {"id": conv_id, "low": None, "high": None, "turns": 0, "audit": [], "sha": hashlib.sha256(), "any": False}
            state |= dict.fromkeys(counts[1:], 0)
            if len(done) >= BATCH:
                yield batch()
        if turn is not None:  # in order
            if state["low"] is None:
                state["low"] = turn
            state["turns"] += turn != state["high"]
            state["high"] = turn
        if fault is not None:
            state[fault] += 1
        state["illegal"] += bool(illegal)
        state["cost"] += COSTS[edit] + (fault == "truncated" and edit != "D")
        state["audit"].append(edit)
        if edit != "D":
            state["sha"].update((("\n" if state["any"] else "") + f"{role}:{text}").encode())
            state["any"] = True
    close()
    if done:
        yield batch()
