"""Chat formatting: role repair at minimum cost, then rendering.

A legal-turn automaton (an optional system turn, then user and assistant by turns) is followed
by dynamic programming: every turn is kept, relabelled, merged into the turn before, or
preceded by an inserted empty turn. Costs of a run of turns form a matrix between states, and
runs combine by min-plus products, so a conversation of any length is cut into pieces: the
pieces' matrices give the cost to go after each piece, with which every piece chooses its own
turns, and a piece's outcome for each state it may start in is looked up once the pieces
before it are settled. Ties go to the next state that is earliest in ``STATES``, so the result
does not depend on where the cuts are.
"""

from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.ordered import place
from docloom.plans.scratch import materialize

STATES = ["start", "system", "user", "assistant"]
ROLES = STATES[1:]
#: What may follow what.
LEGAL = {
    ("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"),
    ("assistant", "user"),
}
MERGE, INSERT, RELABEL, NAME = 2, 3, 5, 1
INF = 1 << 40
BEGIN, STOP = "<|im_start|>", "<|im_end|>\n"


def _step(role: str | None, before: str, after: str) -> tuple[int, str]:
    """Cost and action of a turn with ``role`` that leads from one state to another."""
    if after == "start":
        return INF, ""
    label = 0 if role == after else RELABEL if role in ROLES else NAME
    name = "keep" if not label else "relabel"
    ways = []
    if (before, after) in LEGAL:
        ways.append((label, name))
    if before == after:
        ways.append((label + MERGE, f"{name}+merge"))
    for middle in ROLES:
        if (before, middle) in LEGAL and (middle, after) in LEGAL:
            ways.append((label + INSERT, f"{name}+insert_{middle}"))
    return min(ways, default=(INF, ""))


#: Costs and actions by role (others, and null, are unknown), state before and state after.
STEPS = {
    role: [[_step(role, a, b) for b in STATES] for a in STATES] for role in [*ROLES, None]
}
N = range(len(STATES))


def _known(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in ROLES else None


def run_matrix(roles: list[str | None]) -> list[int]:
    """Costs of a run of turns from every state to every state, flattened."""
    total = [[0 if a == b else INF for b in N] for a in N]
    for role in roles:
        step = STEPS[role]
        total = [
            [min(INF, *(row[m] + step[m][b][0] for m in N)) for b in N] for row in total
        ]
    return [c for row in total for c in row]


def choose(roles: list[str | None], to_go: list[int]) -> tuple[list[list[tuple[int, str, int]]], list[int]]:
    """For every state before a run: the (cost, action, state after) of each turn, and the
    state after the run. ``to_go`` are the costs of what follows it, by state."""
    later = [to_go]
    for role in reversed(roles):
        step = STEPS[role]
        later.append([min(INF, *(step[a][b][0] + later[-1][b] for b in N)) for a in N])
    later.reverse()
    paths, ends = [], []
    for start in N:
        state, path = start, []
        for at, role in enumerate(roles):
            step = STEPS[role][state]
            after = min(N, key=lambda b: (step[b][0] + later[at + 1][b], b))
            path.append((*step[after], after))
            state = after
        paths.append(path)
        ends.append(state)
    return paths, ends


def fragment(action, role, text, first, last):
    """What a turn adds to the rendered conversation, as a column; markers inside the text are
    broken up. A turn closes the one before it, so that merged turns can still join it."""
    text = F.replace(text, F.lit("<|"), F.lit("< |"))
    close = F.when(first, "").otherwise(STOP)
    middle = F.regexp_extract(action, r"insert_(\w+)", 1)
    empty = F.when(middle != "", F.concat(F.lit(BEGIN), middle, F.lit("\n" + STOP))).otherwise("")
    opened = F.concat(close, empty, F.lit(BEGIN), role, F.lit("\n"), text)
    merged = F.concat(F.lit("\n\n"), text)
    return F.concat(
        F.when(action.contains("merge"), merged).otherwise(opened),
        F.when(last, STOP).otherwise(""),
    )


def _pieces(batches, columns: int):
    """(key, rows) of each piece: the rows of one conversation in one range partition."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in range(columns)], strict=True):
            if rows and row[:2] != key:
                yield key, rows
                rows = []
            key = row[:2]
            rows.append(row[2:])
    if rows:
        yield key, rows


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, turn, role, action, cost, fragment, position) of every turn.

    ``role`` is the repaired one; the fragments of a conversation, in order of ``position``
    (from 0 in every conversation), join to the rendered chat. Roles are compared without
    case and outer space; null and other roles are renamed at a lower cost. Turns follow
    each other by turn number, role and a hash of the text, nulls first, so repeated rows
    stay and are merged like any two turns of one role. Null conversation ids make one conversation; null
    texts are empty. Other columns are not read.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    # The keys that place a row are sampled to the driver, so they hold no text.
    rows = rows.withColumn("_text", F.xxhash64("text"))
    placed = place(rows, ["conv_id"], ["turn", "role", "_text"])
    sizes = placed.groupBy("conv_id", "_part").agg(
        F.count("*").alias("_size"), F.min("_row").alias("_low")
    )
    pieces = materialize(sizes, "pieces")
    same = Window.partitionBy(F.col("conv_id")).orderBy("_part")
    pieces = pieces.withColumn(
        "_before",
        F.coalesce(F.sum("_size").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn("_pieces", F.count("*").over(Window.partitionBy("conv_id")))
    # Only a partition's first and last conversation can span several: two pieces each.
    cut = materialize(pieces.where("_pieces > 1"), "cut")

    def ordered(df: DataFrame) -> DataFrame:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(parts, "_part").sortWithinPartitions("_part", "_row")

    def matrices(batches):
        """One matrix for each piece, a turn at a time."""
        key, total = None, None
        for batch in batches:
            done = []
            for part, conv, role in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if total is not None and (part, conv) != key:
                    done.append((*key, total))
                    total = None
                key = (part, conv)
                step = STEPS[_known(role)]
                total = total or [0 if a == b else INF for a, b in product(N, N)]
                total = [
                    min(INF, *(total[a * len(N) + m] + step[m][b][0] for m in N))
                    for a, b in product(N, N)
                ]
            yield _piece_rows(done)
        if total is not None:
            yield _piece_rows([(*key, total)])

    spans = F.broadcast(cut.select("conv_id", "_part"))
    same_piece = placed["conv_id"].eqNullSafe(spans["conv_id"]) & (placed["_part"] == spans["_part"])
    crossing = ordered(placed.join(spans, same_piece, "left_semi").select("_part", "conv_id", "role", "_row"))
    summed = crossing.mapInArrow(matrices, "_part int, conv_id long, matrix array<long>")
    # At most one piece of a conversation in each partition.
    plan = materialize(
        summed.groupBy("conv_id").applyInPandas(
            _costs_to_go, "conv_id long, _part int, to_go array<long>"
        ),
        "to-go",
    )
    info = cut.join(plan, cut["conv_id"].eqNullSafe(plan["conv_id"]) & (cut["_part"] == plan["_part"]))
    info = materialize(
        info.select(
            cut["conv_id"].alias("_conv"), cut["_part"].alias("_piece"), "_before", "to_go",
            (F.col("_before") + F.col("_size")).alias("_until"),
            F.sum("_size").over(Window.partitionBy(cut["conv_id"])).alias("_all"),
        ),
        "cut-info",
    )
    small = F.broadcast(info)
    here = placed["conv_id"].eqNullSafe(small["_conv"]) & (placed["_part"] == small["_piece"])
    work = placed.join(small, here, "left").select(
        "_part", "conv_id", "_row", "turn", "role", "text", "to_go",
        F.coalesce("_before", F.lit(0)).alias("_before"),
        F.coalesce(F.col("_until") < F.col("_all"), F.lit(False)).alias("_open"),
    )
    result = materialize(ordered(work).mapInArrow(_decide, DECIDED), "decided")
    # Which state each piece starts in, by following the pieces of a conversation.
    ends = result.where("_ends is not null").select("conv_id", "_part", "_before", "_ends")
    starts = materialize(
        ends.groupBy("conv_id").applyInPandas(_starts, "conv_id long, _part int, _start int"), "starts"
    )
    small = F.broadcast(
        starts.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_piece"), "_start")
    )
    here = result["conv_id"].eqNullSafe(small["_conv"]) & (result["_part"] == small["_piece"])
    result = result.join(small, here, "left").withColumn(
        "_way", F.col("ways")[F.coalesce("_start", F.lit(0))]
    )
    action, role = F.col("_way.action"), F.col("_way.role")
    return result.select(
        "conv_id", "turn", role.alias("role"), action.alias("action"),
        F.col("_way.cost").alias("cost"),
        fragment(action, role, F.col("text"), F.col("position") == 0, F.col("_last")).alias("fragment"),
        "position",
    )


WAYS = pa.list_(
    pa.struct([("role", pa.string()), ("action", pa.string()), ("cost", pa.int64())])
)
DECIDED = (
    "conv_id long, _part int, turn long, text string, position long, _last boolean, "
    "_before long, ways array<struct<role string, action string, cost bigint>>, _ends array<int>"
)
DECIDED_NAMES = [
    "conv_id", "_part", "turn", "text", "position", "_last", "_before", "ways", "_ends",
]
DECIDED_TYPES = [
    pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), WAYS,
    pa.list_(pa.int32()),
]


def _decide(batches):
    """Rows of each piece with their ways: one, or one for each state it may start in."""
    for (part, conv), rows in _pieces(batches, 9):
        _, _, _, _, to_go, before, is_open = rows[0]
        paths, ends = choose([_known(r[2]) for r in rows], to_go or [0 for _ in N])
        used = paths if to_go else paths[:1]
        out = []
        for at, (_, turn, _, text, *_) in enumerate(rows):
            ways = [
                {"role": STATES[path[at][2]], "action": path[at][1], "cost": path[at][0]}
                for path in used
            ]
            final = at == len(rows) - 1
            out.append(
                (conv, part, turn, text or "", before + at, final and not is_open, before, ways,
                 ends if final and to_go else None)
            )
            if final or len(out) == 5000:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), DECIDED_TYPES, strict=True)],
                    DECIDED_NAMES,
                )
                out = []


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    parts, convs, totals = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array(convs, pa.int64()), pa.array(totals, pa.list_(pa.int64()))],
        ["_part", "conv_id", "matrix"],
    )


def _costs_to_go(pieces):
    """For every piece of a conversation, the costs of all pieces after it, by state."""
    pieces = pieces.sort_values("_part", ascending=False)
    to_go, out = [0 for _ in N], []
    for matrix in pieces["matrix"]:
        out.append(to_go)
        to_go = [min(INF, *(int(matrix[a * len(N) + b]) + to_go[b] for b in N)) for a in N]
    return pieces[["conv_id", "_part"]].assign(to_go=out)


def _starts(pieces):
    """The state that every piece starts in, from the ends of the piece before it."""
    pieces = pieces.sort_values("_before")
    state, out = 0, []
    for ends in pieces["_ends"]:
        out.append(state)
        state = int(ends[state])
    return pieces[["conv_id", "_part"]].assign(_start=out)
