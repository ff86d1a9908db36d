"""Conversation structure repair: the cheapest edits that make roles read ``(s?(ua)+)?``.

A conversation's rows, by turn (nulls first), then role and text, are kept (0),
given another role (1), deleted (2), or a user or assistant turn without text
is inserted (5). Blank rows and rows that repeat an earlier role and text have
to go; a row that ends without ``.``, ``!`` or ``?`` costs 5 more if it stays.

The grammar has four states: nothing read, system read, user read, assistant
read. Costs to go are worked out backwards over rows and states; then a walk
forwards takes, of the edits that lie on a cheapest path, the one of the least
letter (D, I, K, R). Each letter leads to one state only, so the walk's letters
are the ASCII-least of all cheapest ones.

Both directions are streams over sorted partitions: the backward one hands each
row its four letters and keeps four costs, the forward one keeps a state. So a
conversation of any length passes through a task without being held there; rows
are shuffled once, by conversation, and sorted with spilling. A digest of a
whole conversation is sequential by its nature, so a conversation is not split.

Defined cases: null roles and texts are one space; a role that is empty or
begins with none of s, u and a never fits; rows of a null conversation id are
one conversation; repeated rows are duplicates; a conversation without rows
and an empty table give no rows; columns other than conv_id, turn, role and
text are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = " \t\n\v\f\r"
#: What an edit costs, and what a row adds that stays although it is cut off.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Where a kept row leads from each state (nothing, system, user, assistant read), by its role's initial, and where the role that fits leads.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: Costs to go after the last row.
END = (0, 2 * INSERT, INSERT, 0)
FAULTS = ("", "blank", "duplicate", "truncated")


@functools.cache
def cheapest(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], str]:
    """Costs to go before a row, less those of its first state, and the least letter for each state."""
    cut = CUT_OFF if fault == 3 else 0
    ways: list[dict[str, int]] = []
    for q in range(4):
        way = {"D": DELETE + after[q]}
        if fault not in (1, 2):
            way["R"] = REROLE + cut + after[NEXT[q]]
            if initial in KEPT[q]:
                way["K"] = cut + after[KEPT[q][initial]]
        ways.append(way)
    cost = [min(w.values()) for w in ways]
    for _ in range(3):  # inserts in a row, of which more than two never pay
        cost = [min(c, INSERT + cost[NEXT[q]]) for q, c in enumerate(cost)]
    for q in range(4):
        ways[q]["I"] = INSERT + cost[NEXT[q]]
    letters = "".join(min(k for k, c in w.items() if c == cost[q]) for q, w in enumerate(ways))
    return tuple(c - cost[0] for c in cost), letters


def faulty(conversations: DataFrame) -> DataFrame:
    """The rows with ``fault``, the number of the first that applies, and how often role and text stood before (``seen``)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) - 1
    bare = F.rtrim("text", F.lit(SPACES))
    fault = F.when(bare == "", 1).when(F.col("seen") > 0, 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return rows.repartition("conv_id").withColumn("seen", seen).withColumn("fault", fault)


def order(turn: Column, last: bool) -> list[Column]:
    down = lambda c: F.col(c).desc() if last else F.col(c).asc()
    return [F.col("conv_id").asc(), turn, down("role"), down("text"), down("seen")]


def _with_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from the last to the first with their letters, and whether a row is its conversation's last."""
    after, before, some = END, None, False
    for batch in batches:
        letters, last = [], []
        for conv, role, fault in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("fault").to_pylist()):
            new = not some or conv != before
            if new:
                after, before, some = END, conv, True
            after, of = cheapest(after, role[:1], fault)
            letters.append(of)
            last.append(new)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(letters, pa.string()), pa.array(last, pa.bool_())], names=[*batch.schema.names, "letters", "last"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from the first to the last with their edit, inserted ones between them."""
    state, place, initial = 0, 0, None
    for batch in batches:
        at, places, edits, costs, roles, illegal, closes = [], [], [], [], [], [], []

        def edit(i: int, letter: str, cost: int, role: str, wrong: bool = False) -> None:
            nonlocal place
            at.append(i)
            places.append(place)
            edits.append(letter)
            costs.append(cost)
            roles.append(role)
            illegal.append(wrong)
            closes.append(False)
            place += 1

        def insert(i: int) -> None:
            nonlocal state
            edit(i, "I", INSERT, ROLE[state])
            state = NEXT[state]

        for i, (role, fault, letters, last) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("role", "fault", "letters", "last")])):
            own = role[:1]
            wrong = initial is not None and initial + own not in ("su", "ua", "au")
            while letters[state] == "I":
                insert(i)
            letter = letters[state]
            cost = {"D": DELETE, "K": 0, "R": REROLE}[letter] + (CUT_OFF if fault == 3 and letter != "D" else 0)
            edit(i, letter, cost, ROLE[state] if letter == "R" else role, wrong)
            if letter != "D":
                state = NEXT[state] if letter == "R" else KEPT[state][own]
            initial = own
            if last:
                while END[state]:
                    insert(i)
                closes[-1] = True
                state, place, initial = 0, 0, None
        rows = batch.take(pa.array(at, pa.int64()))
        inserted = pa.array([e == "I" for e in edits], pa.bool_())
        own = lambda name, value: pc.if_else(inserted, value, rows.column(name))
        none = pa.scalar(None, batch.schema.field("turn").type)
        columns = [rows.column("conv_id"), pa.array(places, pa.int64()), pa.array(edits, pa.string()), pa.array(costs, pa.int32()), own("turn", none), own("fault", pa.scalar(0, pa.int32())), pa.array(illegal, pa.bool_()), pa.array(roles, pa.string()), own("text", pa.scalar("")), pa.array(closes, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "edit", "cost", "turn", "fault", "illegal", "role", "text", "closes"])


def edits(conversations: DataFrame) -> DataFrame:
    """One row per edit, in order within its partition, where a conversation lies whole: conv_id, place, edit (D, I, K or R), its cost, the row's
    turn (null for inserted ones), the number of its fault (see ``FAULTS``), whether its role cannot follow the row before it, role and text after the edit,
    and whether it is the conversation's last.
    """
    rows = faulty(conversations)
    kind = {f.name: f.dataType for f in rows.schema.fields}
    backwards = rows.withColumn("fault", F.col("fault").cast("int")).sortWithinPartitions(*order(F.col("turn").desc_nulls_last(), True))
    schema = T.StructType([*backwards.schema.fields, T.StructField("letters", T.StringType()), T.StructField("last", T.BooleanType())])
    forwards = backwards.mapInArrow(_with_letters, schema).sortWithinPartitions(*order(F.col("turn").asc_nulls_first(), False))
    out = T.StructType([T.StructField("conv_id", kind["conv_id"]), *T.StructType.fromDDL("place long, edit string, cost int").fields, T.StructField("turn", kind["turn"]), *T.StructType.fromDDL("fault int, illegal boolean, role string, text string, closes boolean").fields])
    return forwards.mapInArrow(_walked, out)


def repaired(edited: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of the repaired conversations."""
    return edited.where("edit <> 'D'").select("conv_id", "place", "role", "text")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def start() -> tuple[list, dict, list, object, bool]:
        return [], dict.fromkeys(("cost", "illegal", 1, 2, 3, "turns"), 0), [None, None], hashlib.sha256(), False

    letters, sums, span, digest, some = start()
    for batch in batches:
        done = []
        for conv, edit, cost, turn, fault, illegal, role, text, closes in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "edit", "cost", "turn", "fault", "illegal", "role", "text", "closes")]):
            letters.append(edit)
            sums["cost"] += cost
            sums["illegal"] += illegal
            if fault:
                sums[fault] += 1
            if turn is not None and turn != span[1]:  # turns come in ascending order
                span = [turn if span[0] is None else span[0], turn]
                sums["turns"] += 1
            if edit != "D":
                digest.update(("\n" if some else "").encode() + role.encode() + b":" + text.encode())
                some = True
            if closes:
                gaps = span[1] - span[0] + 1 - sums["turns"] if sums["turns"] else 0
                done.append((conv, gaps, sums[1], sums[2], sums[3], sums["illegal"], sums["cost"], "".join(letters), digest.hexdigest()))
                letters, sums, span, digest, some = start()
        columns = list(zip(*done)) or [()] * 9
        kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def summaries(edited: DataFrame) -> DataFrame:
    """Of each conversation: turns that are missing, rows of each fault, roles out of order, the edits' cost and letters, and the digest of its repaired
    ``role:text`` rows, joined by line ends. Takes the rows of ``edits`` as they come.
    """
    out = T.StructType([edited.schema["conv_id"], *T.StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])
    return edited.mapInArrow(_summed, out)
