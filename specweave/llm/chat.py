"""Conversations brought to legal turn order at the least cost, and rendered.

A legal conversation is an optional system message, then user and assistant in turn,
beginning with user and ending with assistant. Each message may keep its role, be given another, or be
merged with the message before it; an empty message may be inserted. Every choice has
a cost, and dynamic programming over the states of the automaton finds the cheapest
sequence. Conversations are dealt to compressed blocks by their id and repaired there, so
texts are shuffled once. Of a long one no single task gets all: a step of the programme is
a matrix over states under (min, +), which is associative, so long conversations are cut
into segments by a range sort, segments are summed up as matrices, and once the states at
which a segment is entered and left are known, each one is repaired on its own. Both ways
give the same rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from specweave.plans.lineage import cut

from .blocks import in_blocks
from .common import small_batches

ROLES = ("system", "user", "assistant")
# Names that other sources give the roles.
ALIASES = {
    "developer": "system", "instruction": "system", "context": "system",
    "human": "user", "prompter": "user", "customer": "user", "question": "user",
    "ai": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant", "chatbot": "assistant", "agent": "assistant", "answer": "assistant",
}
#: States: before anything, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, RELABEL, INSERT, UNKNOWN = 1, 3, 2, 1
#: Costs are whole numbers, so that ties are ties; times this, a cost leaves room to prefer fewer changes.
_NONE = 1 << 40

#: Conversations of more messages or bytes are cut into segments; others are repaired in one piece.
LONG_MESSAGES = 512
LONG_BYTES = 1 << 20
#: So many long conversations at most are broadcast by id, to tell their rows from the others.
FEW = 50_000

TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"


def step_options(role: str | None) -> list[tuple[int, int, int, int, tuple[int, ...]]]:
    """(cost, state before, state after, role given, roles inserted before) of each way to take a message; role None: unknown.

    Given role -1 merges the message with the one before, which keeps its role.
    """
    out = []
    for given, name in enumerate(ROLES):
        change = UNKNOWN if role is None else 0 if role == name else RELABEL
        if given == 0:
            out.append((change, START, SYSTEM, 0, ()))
        elif given == 1:
            out += [(change, s, USER, 1, ()) for s in (START, SYSTEM, ASSISTANT)]
            out.append((change + INSERT, USER, USER, 1, (2,)))
        else:
            out.append((change, USER, ASSISTANT, 2, ()))
            out += [(change + INSERT, s, ASSISTANT, 2, (1,)) for s in (START, SYSTEM, ASSISTANT)]
    for s in (SYSTEM, USER, ASSISTANT):
        out.append((MERGE if role in (None, ROLES[s - 1]) else MERGE + RELABEL, s, s, -1, ()))
    return out


OPTIONS = {role: step_options(role) for role in (*ROLES, None)}
#: Cost to end in each state: an open question is answered by an empty message.
FINAL = (_NONE, INSERT * 2, INSERT, 0)
#: The roles of those empty messages, and what stands between merged texts.
CLOSING = {SYSTEM: (1, 2), USER: (2,)}
SEPARATOR = "\n\n"


def known_role(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in ROLES else ALIASES.get(role)


def summed(roles: list[str | None]) -> list[list[int]]:
    """The (min, +) matrix of some messages: least cost from each state to each."""
    cost = [[0 if a == b else _NONE for b in range(4)] for a in range(4)]
    for role in roles:
        new = [[_NONE] * 4 for _ in range(4)]
        for c, a, b, _, _ in OPTIONS[role]:
            for row, out in zip(cost, new, strict=True):
                if row[a] + c < out[b]:
                    out[b] = row[a] + c
        cost = new
    return cost


def walked(roles: list[str | None], cost: list[int]) -> tuple[list[int], list]:
    """Costs after some messages from those before, and for each message and state how it is reached best.

    Of equal ways the one from the lower state counts, then the first option: so the
    repair doesn't depend on where a conversation is cut.
    """
    back = []
    for role in roles:
        new, how = [_NONE * 2] * 4, [None] * 4
        for i, (c, a, b, given, inserted) in enumerate(OPTIONS[role]):
            if how[b] is None or (cost[a] + c, a, i) < (new[b], *how[b][:2]):
                new[b], how[b] = cost[a] + c, (a, i, given, inserted)
        cost = new
        back.append(how)
    return cost, back


def entries(back: list) -> list[int]:
    """For each state after some messages, the one before them on the best way."""
    out = []
    for s in range(4):
        for how in reversed(back):
            s = how[s][0] if how[s] else 0
        out.append(s)
    return out


def repaired(roles: list[str | None], cost: list[int], leave: int) -> list[tuple[int, tuple[int, ...]]]:
    """(role given or -1, roles inserted before) for each message on the best way to state ``leave``."""
    out, s = [], leave
    for how in reversed(walked(roles, cost)[1]):
        s, _, given, inserted = how[s]
        out.append((given, inserted))
    return out[::-1]


def chain(matrices: list[list[list[int]]]) -> tuple[list[list[int]], int, int]:
    """Costs of the states before each segment, the state to end in, the cost, ending included."""
    cost, before = [0, _NONE, _NONE, _NONE], []
    for m in matrices:
        before.append(cost)
        cost = [min(cost[a] + m[a][b] for a in range(4)) for b in range(4)]
    total, last = min((cost[s] + FINAL[s], s) for s in range(4))
    return before, last, total


def _ranged(turns: DataFrame, parts: int | None) -> DataFrame:
    """Turns in conversation order, cut into parts of about equal size wherever they fall."""
    own = turns.select("conv_id", F.col("turn"), "role", "text", F.xxhash64("role", "text").alias("tie"))
    keys = ["conv_id", "turn", "tie", "role", "text"]
    n = parts or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = own.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return cut(ordered.withColumn("part", F.spark_partition_id()))


def _segments(batches):
    """Runs of rows of one conversation in one part, however Arrow cuts them."""
    name, held = None, []
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text")), strict=True))
        for row in rows:
            if name is not None and (row[0], row[1]) != name:
                yield name, held
                held = []
            name = row[0], row[1]
            held.append(row[2:])
    if name is not None:
        yield name, held


@lru_cache(maxsize=1 << 14)
def whole_plan(roles: tuple[str | None, ...]) -> tuple[list[tuple[int, tuple[int, ...]]], int, int]:
    """What repaired() gives for a whole conversation, the state it ends in, and its cost."""
    costs, back = walked(list(roles), [0, _NONE, _NONE, _NONE])
    total, last = min((costs[s] + FINAL[s], s) for s in range(4))
    plan, s = [], last
    for how in reversed(back):
        s, _, given, inserted = how[s]
        plan.append((given, inserted))
    return plan[::-1], last, total


def _in_one_piece(turns: DataFrame, conv: pa.DataType, turn: pa.DataType, kind: str) -> DataFrame:
    """Repaired conversations that are short enough for one task each, a row for each message."""
    own = turns.select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("tie"))
    blocks, _ = in_blocks(own, deal=lambda _, n: F.pmod(F.xxhash64("conv_id"), F.lit(n)).cast("int"))
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(blobs: pa.Table) -> pa.Table:
        t = pa.concat_tables([pa.ipc.open_stream(data.as_buffer()).read_all() for data in blobs.column("data")])
        order = pc.sort_indices(t, [(c, "ascending") for c in ("conv_id", "turn", "tie", "role", "text")], null_placement="at_start")
        t = t.take(order)
        names, turns, roles, texts = (t.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))
        known = [known_role(r) for r in roles]
        out, a = [], 0
        for b in range(1, len(names) + 1):
            if b < len(names) and names[b] == names[a]:
                continue
            plan, last, total = whole_plan(tuple(known[a:b]))
            made: list[list] = []
            for i, (given, inserted) in enumerate(plan, a):
                made += [[None, ROLES[r], [""], ["insert"]] for r in inserted]
                if given < 0:
                    made[-1][2].append(texts[i] or "")
                    made[-1][3].append("merge")
                else:
                    made.append([turns[i], ROLES[given], [texts[i] or ""], ["keep" if known[i] == ROLES[given] else "relabel"]])
            made += [[None, ROLES[r], [""], ["insert"]] for r in CLOSING.get(last, ())]
            out += [(names[a], m, at, role, SEPARATOR.join(text), ",".join(action), total) for m, (at, role, text, action) in enumerate(made)]
            a = b
        columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return blocks.groupBy("block").applyInArrow(run, kind)


def repair(turns: DataFrame, parts: int | None = None, long_messages: int = LONG_MESSAGES, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(conv_id, message, turn, role, text, action, rendered, cost): the repaired conversations, a row for each message.

    turns (conv_id, turn, role, text). Messages go by turn, nulls first; ties by a hash of
    role and text, then role and text. Roles are read in lower case, common other names
    of the three roles as these; any other, or null, is unknown and cheap to name. message counts from 0; turn is the
    first source turn of the message, null for an inserted one; action lists what was done
    (keep, relabel, merge, insert), comma-joined, merge once for each message joined;
    merged texts are joined by an empty line, null texts are empty. cost is that of the whole conversation.
    A conversation is given the cheapest legal sequence, which always exists. A null conv_id is a
    conversation of its own. Repeated rows are repeated messages. Other columns are not looked at.
    """
    small_batches(turns.sparkSession)
    name, at = (turns.schema[c].dataType for c in ("conv_id", "turn"))
    kind = f"conv_id {name.simpleString()}, message long, turn {at.simpleString()}, role string, text string, action string, cost long"
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    long = cut(sizes.filter((F.col("n") > long_messages) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("long_id")))
    n_long = long.count()
    if not n_long:
        return _rendered(_in_one_piece(turns, to_arrow_type(name), to_arrow_type(at), kind))
    known = F.broadcast(long) if n_long <= FEW else long  # ids only, and counted
    same = turns.conv_id.eqNullSafe(F.col("long_id"))
    short = _in_one_piece(turns.join(known, same, "left_anti"), to_arrow_type(name), to_arrow_type(at), kind)
    return _rendered(short.unionByName(_in_segments(turns.join(known, same, "left_semi"), parts)))


def _rendered(messages: DataFrame) -> DataFrame:
    before, after = TEMPLATE.split("{text}")
    start, role_end = before.split("{role}")
    rendered = F.concat(F.lit(start), F.col("role"), F.lit(role_end), F.col("text"), F.lit(after))
    return messages.select("conv_id", "message", "turn", "role", "text", "action", rendered.alias("rendered"), "cost")


def _in_segments(turns: DataFrame, parts: int | None) -> DataFrame:
    """Repaired conversations of any length, cut wherever a range sort cuts them."""
    ordered = _ranged(turns, parts)
    kind = turns.schema["conv_id"].dataType.simpleString()
    turn_kind = turns.schema["turn"].dataType.simpleString()
    conv = conv_type(ordered)

    def sums(batches):
        for (name, part), rows in _segments(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name], conv), pa.array([part], pa.int32()), pa.array([np.ravel(summed([known_role(r) for _, r, _ in rows])).tolist()], pa.list_(pa.int64()))], ["conv_id", "part", "matrix"])

    def before(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        costs, end, total = chain([np.array(m).reshape(4, 4).tolist() for m in rows.column("matrix").to_pylist()])
        n = rows.num_rows
        return pa.table([rows.column("conv_id"), rows.column("part"), pa.array(costs, pa.list_(pa.int64())), pa.array([end] * n, pa.int32()), pa.array([total] * n, pa.int64())], names=["conv_id", "part", "costs", "ending", "cost"])

    def ways(batches):
        for (name, part, costs, end, total), rows in _known_segments(batches):
            own = entries(walked([known_role(r) for _, r, _ in rows], costs)[1])
            yield pa.RecordBatch.from_arrays([pa.array([name], conv), pa.array([part], pa.int32()), pa.array([costs], pa.list_(pa.int64())), pa.array([end], pa.int32()), pa.array([total], pa.int64()), pa.array([own], pa.list_(pa.int32()))], ["conv_id", "part", "costs", "ending", "cost", "entries"])

    def ends(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "descending")])
        state, leave = rows.column("ending")[0].as_py(), []
        for own in rows.column("entries").to_pylist():
            leave.append(state)
            state = own[state]
        n = rows.num_rows
        return pa.table([*(rows.column(c) for c in ("conv_id", "part", "costs")), pa.array(leave, pa.int32()), rows.column("cost"), pa.array([i == 0 for i in range(n)])], names=["conv_id", "part", "costs", "leave", "cost", "last"])

    # one row for each conversation in each part of the range sort: as many as parts at most for one conversation
    matrices = ordered.select("conv_id", "part", "turn", "role", "text").mapInArrow(sums, f"conv_id {kind}, part int, matrix array<bigint>")
    known = cut(matrices.groupBy("conv_id").applyInArrow(before, f"conv_id {kind}, part int, costs array<bigint>, ending int, cost long"))
    own = _with_known(ordered, known, ["costs", "ending", "cost"]).mapInArrow(ways, f"conv_id {kind}, part int, costs array<bigint>, ending int, cost long, entries array<int>")
    known = own.groupBy("conv_id").applyInArrow(ends, f"conv_id {kind}, part int, costs array<bigint>, leave int, cost long, last boolean")
    return _written(ordered, cut(known), kind, turn_kind)


def _with_known(ordered: DataFrame, known: DataFrame, names: list[str]) -> DataFrame:
    """The messages of each segment together and in order, with what is known of it."""
    k = known.withColumnRenamed("conv_id", "c").withColumnRenamed("part", "p")
    rows = ordered.join(k, ordered.conv_id.eqNullSafe(F.col("c")) & (ordered.part == F.col("p"))).drop("c", "p")
    rows = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "tie", "role", "text")
    return rows.select("conv_id", "part", "turn", "role", "text", *names)


def conv_type(df: DataFrame) -> pa.DataType:
    return to_arrow_type(df.schema["conv_id"].dataType)


def _written(ordered: DataFrame, known: DataFrame, kind: str, turn_kind: str) -> DataFrame:
    """The messages of each segment, numbered; a merge at a segment's start goes to the last message before."""
    conv, turn = conv_type(ordered), to_arrow_type(ordered.schema["turn"].dataType)

    def pieces(batches):
        """A row for each message or part of one: opens tells whether it begins a message."""
        for (name, part, costs, leave, cost, last), rows in _known_segments(batches):
            plan = repaired([known_role(r) for _, r, _ in rows], costs, leave)
            out = []
            for (at, role, text), (given, inserted) in zip(rows, plan, strict=True):
                out += [(True, None, ROLES[r], "", "insert") for r in inserted]
                action = "merge" if given < 0 else "keep" if known_role(role) == ROLES[given] else "relabel"
                out.append((given >= 0, at, ROLES[given] if given >= 0 else None, text or "", action))
            if last:
                out += [(True, None, ROLES[r], "", "insert") for r in CLOSING.get(leave, ())]
            n = len(out)
            columns = list(zip(*out, strict=True))
            arrays = [pa.array([name] * n, conv), pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array([cost] * n, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.bool_(), turn, pa.string(), pa.string(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "nth", "cost", "opens", "turn", "role", "text", "action"])

    rows = _with_known(ordered, known, ["costs", "leave", "cost", "last"])
    made = cut(rows.mapInArrow(pieces, f"conv_id {kind}, part int, nth long, cost long, opens boolean, turn {turn_kind}, role string, text string, action string"))
    # numbers: messages of earlier segments, then those opened so far in this one
    opened = made.groupBy("conv_id", "part").agg(F.count_if("opens").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = opened.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    numbered = made.withColumn("own", F.count_if("opens").over(inside))
    numbered = numbered.join(offsets, numbered.conv_id.eqNullSafe(F.col("c")) & (numbered.part == F.col("p")))
    numbered = numbered.withColumn("message", F.col("before") + F.col("own") - 1)
    piece = F.struct("part", "nth", "turn", "role", "text", "action")
    merged = numbered.groupBy("conv_id", "message").agg(F.first("cost").alias("cost"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    first = F.element_at("pieces", 1)
    text = F.array_join(F.transform("pieces", lambda x: x["text"]), SEPARATOR)
    return merged.select("conv_id", "message", first["turn"].alias("turn"), first["role"].alias("role"), text.alias("text"), F.array_join(F.transform("pieces", lambda x: x["action"]), ",").alias("action"), "cost")


def _known_segments(batches):
    """((conv_id, part, what is known), messages) of each segment in batches from _with_known()."""
    name, held, known = None, [], None
    for batch in batches:
        for conv, part, turn, role, text, *rest in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            if name is not None and (conv, part) != name:
                yield (*name, *known), held
                held = []
            name, known = (conv, part), rest
            held.append((turn, role, text))
    if name is not None:
        yield (*name, *known), held
