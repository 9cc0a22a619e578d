"""Repair of the role structure of conversations by a survivor-coalescence Viterbi search.

A conversation's rows pass one by one. For each state of the output (nothing yet, after a
system, a user or an assistant row) one survivor is kept: the cheapest edits that lead there,
among equal costs those whose initials come first. The survivors' edits form a tree of
backpointers with reference counts; a stretch without a branch is one node, so four survivors
need at most seven nodes. As soon as all survivors share an ancestor its edits are emitted.
What is unresolved takes a byte per edit and branch; texts are not kept, but meet the edits
afterwards.

Ties are decided by the complete edits: survivors are held in the order of their strings.
After a row no survivor's string begins another's (each ends in that row's edit and has as
many row edits), so the order of two longer strings is that of the survivors they come of, or
of what was added if they come of the same one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from srcmetrics.llm.store import bounded, stored

#: What the edits cost, and a row with an unfinished text that stays.
RELABEL, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
#: Faults of a row; the first that holds counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of the output and the initials that lead there.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: A survivor this much dearer than the cheapest is never the best: from each state two
#: inserts and a deletion reach whatever follows another state.
HOPELESS = 2 * INSERT + DELETE
#: Rows handed on at once.
BATCH_ROWS = 1 << 12
_SPACE = r"\x20\x09-\x0D"


class _Node:
    """Edits in a row without a branch, and how many nodes or survivors go on from them."""

    __slots__ = ("edits", "kids", "parent")

    def __init__(self, parent: _Node | None, edits: str):
        self.parent, self.edits, self.kids = parent, bytearray(edits, "ascii"), 0


class Repair:
    """The cheapest edits of one conversation, given row by row."""

    def __init__(self):
        self._root = _Node(None, "")
        self._nodes = [self._root]
        #: (state, cost, node), in the order of the strings of edits.
        self._survivors = [(NOTHING, 0, self._root)]

    def _with_inserts(self) -> list[tuple[int, int, str] | None]:
        """By state: cost, survivor and inserts ahead of the next row."""
        best: list[tuple[int, int, str] | None] = [None] * 4
        for i, (state, cost, _) in enumerate(self._survivors):
            best[state] = cost, i, ""
        for state, sources in ((USER, (NOTHING, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            ways = [(b[0] + INSERT, b[1], b[2] + "I") for s in sources if (b := best[s])]
            best[state] = min([w for w in [best[state], *ways] if w], default=None)
        return best

    def row(self, state: int | None, fault: int) -> bytes:
        """Takes in a row, ``state`` the one its role leads to (None: no output has it);
        returns the edits that are decided by now."""
        new: list[tuple[int, int, str] | None] = [None] * 4
        stays = fault not in (BLANK, DUPLICATE)
        more = UNFINISHED if fault == TRUNCATED else 0
        for p, way in enumerate(self._with_inserts()):
            if way is None:
                continue
            cost, i, edits = way
            after = ASSISTANT if p == USER else USER
            steps = [(p, cost + DELETE, "D")]
            if stays:
                steps.append((after, cost + RELABEL + more, "R"))
                if state == after or (state == SYSTEM and p == NOTHING):
                    steps.append((state, cost + more, "K"))
            for q, total, edit in steps:
                found = total, i, edits + edit
                if new[q] is None or found < new[q]:
                    new[q] = found
        least = min(w[0] for w in new if w)
        kept = [(i, edits, q, cost) for q, w in enumerate(new) if w for cost, i, edits in [w] if cost <= least + HOPELESS]
        return self._grow(sorted(kept))

    def _grow(self, kept: list[tuple[int, str, int, int]]) -> bytes:
        old = [node for _, _, node in self._survivors]
        uses = [0] * len(old)
        for i, *_ in kept:
            uses[i] += 1
        self._survivors = []
        for i, edits, state, cost in kept:
            node = old[i]
            if uses[i] == 1:
                node.edits += edits.encode("ascii")
            else:
                node = _Node(old[i], edits)
                old[i].kids += 1
                self._nodes.append(node)
            self._survivors.append((state, cost, node))
        self._drop([node for node, used in zip(old, uses, strict=True) if not used])
        if self._root.kids or len(self._survivors) == 1:
            done = bytes(self._root.edits)
            self._root.edits.clear()
            return done
        return b""

    def _drop(self, dead: list[_Node]) -> None:
        """Frees nodes that nothing goes on from; a parent left with one child takes it in."""
        while dead:
            node = dead.pop()
            self._nodes.remove(node)
            parent = node.parent
            parent.kids -= 1
            if parent.kids > 1:
                continue
            child = next(n for n in self._nodes if n.parent is parent)
            parent.edits += child.edits
            parent.kids = child.kids
            self._nodes.remove(child)
            for n in self._nodes:
                if n.parent is child:
                    n.parent = parent
            self._survivors = [(s, c, parent if n is child else n) for s, c, n in self._survivors]
            dead = [parent if n is child else n for n in dead]

    def end(self) -> bytes:
        """The edits not returned so far."""
        best = self._with_inserts()
        _, i, inserts = min(w for w in (best[NOTHING], best[ASSISTANT]) if w)
        node, parts = self._survivors[i][2], [inserts.encode("ascii")]
        while node is not None:
            parts.append(bytes(node.edits))
            node = node.parent
        return b"".join(reversed(parts))


class _Out:
    """Rows by column, handed on in batches."""

    def __init__(self, schema: pa.Schema):
        self._schema, self._rows = schema, []

    def add(self, *row) -> bool:
        self._rows.append(row)
        return len(self._rows) >= BATCH_ROWS

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self._rows, strict=True)) or [()] * len(self._schema)
        self._rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self._schema, strict=True)], schema=self._schema)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _decide(id_type: pa.DataType):
    schema = pa.schema([("conv_id", id_type), ("pos", pa.int64()), ("inserts", pa.int64()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        current, repair, at, waiting = object(), None, 0, 0

        def emit(edits: bytes) -> Iterator[pa.RecordBatch]:
            nonlocal at, waiting
            for edit in edits.decode("ascii"):
                if edit == "I":
                    waiting += 1
                    continue
                at += 1
                if out.add(current, at, waiting, edit):
                    yield out.batch()
                waiting = 0

        def close() -> Iterator[pa.RecordBatch]:
            yield from emit(repair.end())
            if waiting:
                out.add(current, at + 1, waiting, None)

        for conv_id, state, fault in _rows(batches, ["conv_id", "state", "fault"]):
            if repair is None or conv_id != current:
                if repair is not None:
                    yield from close()
                current, repair, at, waiting = conv_id, Repair(), 0, 0
            yield from emit(repair.row(state, fault))
        if repair is not None:
            yield from close()
        yield out.batch()

    return run


def _apply(id_type: pa.DataType):
    """Rows and their edits, each row after its edit, to the edits in order."""
    names = ["conv_id", "inserts", "edit", "turn", "role", "text", "fault", "illegal"]
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(REPAIRED, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        current, step, last, edit = object(), 0, "", None
        for conv_id, inserts, decided, turn, role, text, fault, illegal in _rows(batches, names):
            if conv_id != current:
                current, step, last = conv_id, 0, ""
            if inserts is not None:
                for _ in range(inserts):
                    step += 1
                    last = "assistant" if last[:1] == "u" else "user"
                    if out.add(conv_id, step, "I", None, last, "", None, None, INSERT):
                        yield out.batch()
                edit = decided
                continue
            step += 1
            cost = DELETE
            if edit != "D":
                cost = UNFINISHED if fault == TRUNCATED else 0
                if edit == "R":
                    cost += RELABEL
                    role = "assistant" if last[:1] == "u" else "user"
                last = role
            if out.add(conv_id, step, edit, turn, role, text, fault, illegal, cost):
                yield out.batch()
        yield out.batch()

    return run


REPAIRED = ["conv_id", "step", "edit", "turn", "role", "text", "fault", "illegal", "cost"]
SUMMARY = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _summarise(id_type: pa.DataType):
    schema = pa.schema([("conv_id", id_type), *((c, pa.int64()) for c in SUMMARY[1:7]), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        current, audit = object(), None

        def line() -> tuple:
            gaps = high - low + 1 - turns if turns else 0
            return current, gaps, *faults[1:], illegals, total, audit.decode("ascii"), digest.hexdigest()

        for conv_id, _, edit, turn, role, text, fault, illegal, cost in _rows(batches, REPAIRED):
            if audit is None or conv_id != current:
                if audit is not None and out.add(*line()):
                    yield out.batch()
                current, audit, digest, faults = conv_id, bytearray(), hashlib.sha256(), [0] * 4
                low = high = None
                turns = illegals = total = kept = 0
            if turn is not None and turn != high:  # turns ascend
                low, high, turns = turn if low is None else low, turn, turns + 1
            audit += edit.encode("ascii")
            total += cost
            if fault is not None:
                faults[fault] += 1
                illegals += illegal
            if edit != "D":
                digest.update((f"\n{role}:{text}" if kept else f"{role}:{text}").encode())
                kept += 1
        if audit is not None:
            out.add(*line())
        yield out.batch()

    return run


def inspected(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, role, text, state, fault, illegal) of each of ``rows(conv_id, turn,
    role, text)``: its place in the conversation from 1, by turn (null first), role and text;
    the state its role leads to, its first fault, and 1 if its role may not follow the one
    ahead. Null roles and texts are one space."""
    rows = rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    # the first turn of texts that come again, gathered before the shuffle; no text takes part
    again = (
        rows.groupBy("conv_id", "role", "digest")
        .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    )
    same = F.expr("conv_id <=> c AND role = r AND digest = d")
    rows = rows.join(bounded(stored(again), 128), same, "left")
    rows = rows.withColumn("earlier", F.expr("first IS NOT NULL AND struct(turn) > first"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ends = F.regexp_extract(F.col("text"), f"([^{_SPACE}])[{_SPACE}]*\\z", 1)
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).cast("bigint").alias("pos"),
        "turn",
        "role",
        "text",
        "earlier",
        F.lag(F.struct("turn", "role", "digest")).over(order).alias("ahead"),
        F.substring("role", 1, 1).alias("initial"),
        ends.alias("last"),
        "digest",
    )
    fault = (
        F.when(F.col("last") == "", BLANK)
        .when(F.expr("earlier OR (ahead IS NOT NULL AND ahead <=> struct(turn, role, digest))"), DUPLICATE)
        .when(F.col("last").isin(".", "!", "?"), SOUND)
        .otherwise(TRUNCATED)
    )
    pair = F.concat(F.substring("ahead.role", 1, 1), "initial")
    state = F.lit(None).cast("bigint")
    for initial, number in _STATE.items():
        state = F.when(F.col("initial") == initial, F.lit(number).cast("bigint")).otherwise(state)
    return rows.select(
        "conv_id",
        "pos",
        "turn",
        "role",
        "text",
        state.alias("state"),
        fault.cast("bigint").alias("fault"),
        F.coalesce((~pair.isin("su", "ua", "au")).cast("bigint"), F.lit(0).cast("bigint")).alias("illegal"),
    )


def _arrow_id(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv_id"].dataType)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, step, edit, turn, role, text, fault, illegal, cost): the cheapest edits that
    give each conversation of ``rows(conv_id, turn, role, text)`` a legal structure, in order.

    Rows are taken by turn (null first; equal turns by role and text). Texts that come again are
    known by their MD5. Edits are ``K`` (the
    row stays), ``R`` (its role becomes user or assistant), ``D`` (it goes; blank and repeated
    rows must) and ``I`` (a row with an empty text comes in). The roles that are left begin
    with s, u or a as in ``(s?(ua)+)?``. Of equally cheap edits those whose initials come first
    are chosen. A role with another or no initial cannot stay. The repaired conversation is
    the rows other than ``D``; inserted rows have no turn and no fault. Null roles and texts
    are one space, null ids one conversation; an empty table gives no rows.

    Rows of a conversation are in one partition and in order. A conversation is one stream in
    one task, with a byte for each undecided edit in memory; its rows are sorted by Spark."""
    id_type, id_field = _arrow_id(rows), StructField("conv_id", rows.schema["conv_id"].dataType)
    ordered = stored(inspected(rows))
    decided = StructType([id_field, StructField("pos", LongType()), StructField("inserts", LongType()), StructField("edit", StringType())])
    edits = (
        ordered.select("conv_id", "pos", "state", "fault")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "pos")
        .mapInArrow(_decide(id_type), decided)
    )
    both = stored(edits).unionByName(ordered.drop("state"), allowMissingColumns=True)
    strings = {"edit", "role", "text"}
    repaired = [id_field, *(StructField(c, StringType() if c in strings else LongType()) for c in REPAIRED[1:])]
    return (
        both.repartition("conv_id")
        .sortWithinPartitions("conv_id", "pos", F.col("inserts").isNull())
        .mapInArrow(_apply(id_type), StructType(repaired))
    )


def summaries(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair_conversations``, whose partitions and order
    are used as they are: turns missing between the first and the last, rows by fault, illegal
    neighbours before the repair, cost, the initials of the edits, and the SHA-256 of the
    repaired rows ``role:text``, one a line."""
    id_field = StructField("conv_id", repaired.schema["conv_id"].dataType)
    fields = [id_field, *(StructField(c, LongType()) for c in SUMMARY[1:7]), *(StructField(c, StringType()) for c in SUMMARY[7:])]
    return repaired.mapInArrow(_summarise(_arrow_id(repaired)), StructType(fields))
