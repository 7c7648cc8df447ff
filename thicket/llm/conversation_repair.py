"""Conversations of a legal turn order, at least cost.

Roles must spell ``(s?(ua)+)?``: four states (at the start, after the system turn, after a user turn, after an assistant
turn). Edits of a row are Keep, Rerole, Delete, before it any number of Inserts. Hirschberg's way: forward costs of the first
half and backward costs of the second meet at the middle; among the states where their sum is least, the one whose first
half has the ASCII-least audit is the crossing, and both halves are solved in the same way, so no table of rows by states is held.

No audit that ends with a row's own edit is the beginning of another one of the same rows, so audits of halves compare by
ranks: a forward vector holds a cost and a rank for each state, and a run of rows is a matrix of costs and ranks. So a
conversation is cut into blocks of rows: each block becomes a matrix, the matrices of a conversation are crossed in the
same way, and then every block is solved by itself, between known states.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm._store import shared_folder, stored, tidy
from thicket.operators.ordering import numbered

BLOCK = 4096  # rows of a conversation that a task holds at once
NO_ID = -(1 << 63)  # stands for a null conversation id
SALTS = 16
WHITE = " \t\n\x0b\x0c\r"
INF = float("inf")
DELETE, INSERT, REROLE, UNFINISHED = 3, 2, 2, 1
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
ENDING = (0, 2 * INSERT, INSERT, 0)  # cost of the inserts that end a conversation in each state

Batches = Iterator[pa.RecordBatch]
Element = tuple[tuple[tuple[float, ...], ...], tuple[tuple[int, ...], ...]]  # costs and ranks, by state before and after


def after(state: int, role: int) -> int | None:
    """The state that a turn leads to; None where it is not legal."""
    if role == SYSTEM:
        return 1 if state == 0 else None
    if role == USER:
        return 2 if state != 2 else None
    return 3 if role == ASSISTANT and state == 2 else None


def wanted(state: int) -> int:
    """The role that an inserted or reroled turn has."""
    return ASSISTANT if state == 2 else USER


def _row_edits(code: int) -> list[list[tuple[float, str]]]:
    """For a row (4 * fault + role): the least cost, and then audit, between any two states."""
    fault, role = divmod(code, 4)
    best = [[(INF, "")] * 4 for _ in range(4)]
    for start in range(4):
        state, cost, audit = start, 0, ""
        for _ in range(4):
            ways = [(DELETE, "D", state)]
            if fault not in (BLANK, DUPLICATE):
                extra = UNFINISHED if fault == TRUNCATED else 0
                ways.append((REROLE + extra, "R", after(state, wanted(state))))
                if (kept := after(state, role)) is not None:
                    ways.append((extra, "K", kept))
            for price, letter, end in ways:
                best[start][end] = min(best[start][end], (cost + price, audit + letter))
            state, cost, audit = after(state, wanted(state)), cost + INSERT, audit + "I"
    return best


def _ranked(rows: Sequence[Sequence[tuple[float, object]]]) -> Element:
    """Costs and ranks of matrices of (cost, something that orders what leaves the same state)."""
    ranks = [{t: k for k, t in enumerate(sorted((t for t in range(4) if row[t][0] < INF), key=lambda t, row=row: row[t][1]))} for row in rows]
    return tuple(tuple(c for c, _ in row) for row in rows), tuple(tuple(r.get(t, 0) for t in range(4)) for r in ranks)


EDITS = [_row_edits(code) for code in range(16)]
ROWS: list[Element] = [_ranked(e) for e in EDITS]


def forward(elements: Sequence[Element], start: int) -> tuple[list[float], list[int]]:
    """Least cost of reaching each state, and the rank of its audit among them."""
    costs, ranks = [INF] * 4, [0] * 4
    costs[start] = 0
    for price, order in elements:
        best = [(INF, 0, 0)] * 4
        for s in range(4):
            if costs[s] < INF:
                for t in range(4):
                    way = (costs[s] + price[s][t], ranks[s], order[s][t])
                    if way < best[t]:
                        best[t] = way
        costs = [b[0] for b in best]
        for rank, t in enumerate(sorted(range(4), key=lambda t: best[t][1:])):  # noqa: B023
            ranks[t] = rank
    return costs, ranks


def backward(elements: Sequence[Element], end: Sequence[float]) -> list[float]:
    """Least cost from each state to the end."""
    costs = list(end)
    for price, _ in reversed(elements):
        costs = [min(p + c for p, c in zip(price[s], costs, strict=True)) for s in range(4)]
    return costs


def summary(elements: Sequence[Element]) -> Element:
    """A run of elements as one."""
    return _ranked([list(zip(*forward(elements, s), strict=True)) for s in range(4)])


def crossings(elements: Sequence[Element], start: int, end: Sequence[float]) -> list[int]:
    """The state after each element on the cheapest way, of several on the one with the ASCII-least audit."""
    states: list[int] = []
    waiting = [(0, len(elements), start, tuple(end))] if elements else []
    while waiting:
        low, high, start, end = waiting.pop()
        middle = (low + high + 1) // 2
        costs, ranks = forward(elements[low:middle], start)
        rest = backward(elements[middle:high], end)
        state = min(range(4), key=lambda t: (costs[t] + rest[t], ranks[t]))  # noqa: B023
        if high - low == 1:
            states.append(state)
            continue
        waiting.append((middle, high, state, end))
        waiting.append((low, middle, start, tuple(0 if t == state else INF for t in range(4))))
    return states


def _fixed(state: int) -> tuple[float, ...]:
    return ENDING if state < 0 else tuple(0 if t == state else INF for t in range(4))


def solve(codes: bytes, start: int, end: int) -> tuple[int, ...]:
    """States after each row; ``end`` is a state, or negative at the end of the conversation."""
    return tuple(crossings([ROWS[c] for c in codes], start, _fixed(end)))


_known = functools.lru_cache(1 << 15)(solve)  # short conversations are much alike


def _pieces(codes: bytes, states: Sequence[int], start: int, last: bool) -> Iterator[tuple[int, int, str, str | None]]:
    """(row, place in it, edit, new role) of every edit in order; inserts at the end belong to the row after the last."""
    names = {USER: "user", ASSISTANT: "assistant"}
    state = start
    for at, (code, goal) in enumerate(zip(codes, states, strict=True)):
        for place, letter in enumerate(EDITS[code][state][goal][1]):
            if letter == "D":
                yield at, place, letter, None
                continue
            role = code % 4 if letter == "K" else wanted(state)
            yield at, place, letter, None if letter == "K" else names[role]
            state = after(state, role)
    if last:
        for place in range(int(ENDING[state]) // INSERT):
            yield len(codes), place, "I", names[wanted(state)]
            state = after(state, wanted(state))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, was) after the damage; ``was`` orders rows of one turn, nulls are one space."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select(
        F.coalesce(conv, F.lit(NO_ID)).alias("conv"), turn.alias("turn"), role.alias("was"), kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    ).where("kind <> 0")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", "was", "role", "text", F.explode(copies).alias("copy")).drop("copy")


def _same() -> Column:
    """128 bits that tell rows of a conversation apart by role and text."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


def judged(rows: DataFrame) -> DataFrame:
    """(conv, pos, turn, same, code) of each of the ``damaged`` rows: its place from 1 in the order of turns (nulls first), fault and role.

    Rows of one turn are in the order of their role before the damage, then of a hash of the row, so equal rows are adjacent.
    """
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    slim = rows.select("conv", "turn", "was", _same().alias("same"), fault.alias("fault"), role.alias("role"))
    placed = numbered(slim, ["conv"], ["turn", "was"], "pos")
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")  # one row may fill a third of the table
    several = placed.groupBy("conv", "same").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select("conv", "same", "first", salts)
    salted = placed.withColumn("salt", (F.col("pos") % SALTS).cast("int"))
    joined = salted.join(several, ["conv", "same", "salt"], "left")
    repeated = F.coalesce(F.col("pos") > F.col("first"), F.lit(False)) & (F.col("fault") != BLANK)
    return joined.select("conv", "pos", "turn", "same", (F.when(repeated, DUPLICATE).otherwise(F.col("fault")) * 4 + F.col("role")).alias("code"))


def _block_codes(batch: pa.RecordBatch) -> list[bytes]:
    return [bytes(r["code"] for r in rows) for rows in batch.column("rows").to_pylist()]


def _summaries(batches: Batches) -> Batches:
    for batch in batches:
        found, ends = [], []
        for codes in _block_codes(batch):
            costs, ranks = summary([ROWS[c] for c in codes])
            found.append(([c if c < INF else -1.0 for c in itertools.chain(*costs)], list(itertools.chain(*ranks))))
            ends.append(codes[-1] % 4)
        yield pa.record_batch(
            [batch.column("conv"), batch.column("block"), pa.array(ends, pa.int32()), pa.array([c for c, _ in found], pa.list_(pa.float64())), pa.array([r for _, r in found], pa.list_(pa.int32()))],
            names=["conv", "block", "last", "costs", "ranks"],
        )


def _chain(batches: Batches) -> Batches:
    """Per conversation, the states between which each of its blocks is to be solved."""
    fours = lambda x: tuple(tuple(x[i : i + 4]) for i in range(0, 16, 4))
    for batch in batches:
        out = []
        for conv, blocks in zip(batch.column("conv").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
            elements = [(fours([INF if c < 0 else c for c in b["costs"]]), fours(b["ranks"])) for b in blocks]
            states = crossings(elements, 0, ENDING)
            for k, b in enumerate(blocks):
                end = states[k] if k + 1 < len(blocks) else -1
                out.append((conv, b["block"], states[k - 1] if k else 0, end, blocks[k - 1]["last"] if k else -1))
        kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["conv", "block", "start", "end", "before"])


PIECE = pa.struct([("pos", pa.int64()), ("place", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("same", pa.binary())])


def _solved(batches: Batches) -> Batches:
    for batch in batches:
        out = []
        columns = (batch.column(n).to_pylist() for n in ("conv", "block", "rows", "start", "end", "before"))
        for conv, block, rows, start, end, before in zip(*columns, strict=True):
            codes = bytes(r["code"] for r in rows)
            states = (_known if len(codes) <= 32 else solve)(codes, start, end)
            roles = [c % 4 for c in codes]
            pairs = itertools.pairwise([before, *roles] if before >= 0 else roles)
            faults = [c // 4 for c in codes]
            pieces = list(_pieces(codes, states, start, end < 0))
            cost = sum({"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[e] for _, _, e, _ in pieces)
            cost += sum(UNFINISHED for at, _, e, _ in pieces if e in "KR" and faults[at] == TRUNCATED)
            lasting = [
                {"pos": block * BLOCK + at + 1, "place": place, "edit": e, "role": role, "same": None if e == "I" else rows[at]["same"]}
                for at, place, e, role in pieces if e != "D"
            ]
            out.append((conv, block, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), sum(p not in LEGAL for p in pairs), cost, "".join(p[2] for p in pieces), lasting))
        kinds = *[pa.int64()] * 7, pa.string(), pa.list_(PIECE)
        names = ["conv", "block", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "pieces"]
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)


def plans(rows: DataFrame, folder: str) -> DataFrame:
    """(conv, block, blank, duplicate, truncated, illegal, cost, audit, pieces) of every block of ``judged`` rows."""
    block = F.expr(f"(pos - 1) DIV {BLOCK}").alias("block")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "code", "same"))), lambda r: F.struct(r["code"].alias("code"), r["same"].alias("same")))
    blocks = stored(rows.groupBy("conv", block).agg(listed.alias("rows")), f"{folder}/blocks")
    short = (F.col("block") == 0) & (F.size("rows") < BLOCK)  # a second block exists only after a full one
    alone = blocks.where(short).select("*", F.lit(0).alias("start"), F.lit(-1).alias("end"), F.lit(-1).alias("before"))
    long = blocks.where(~short)
    matrices = long.mapInArrow(tidy(_summaries), "conv long, block long, last int, costs array<double>, ranks array<int>")
    rows_of = F.sort_array(F.collect_list(F.struct("block", "last", "costs", "ranks"))).alias("blocks")
    ends = matrices.groupBy("conv").agg(rows_of).mapInArrow(tidy(_chain), "conv long, block long, start int, end int, before int")
    both = alone.unionByName(long.join(ends, ["conv", "block"]))
    pieces = "array<struct<pos:long,place:int,edit:string,role:string,same:binary>>"
    return both.mapInArrow(tidy(_solved), f"conv long, block long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces {pieces}")


def _repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv, pos, place, edit, role, text) of the repaired turns. A row that stays is the first of its role and text."""
    pieces = solved.select("conv", F.explode("pieces").alias("p")).select("conv", "p.*")
    texts = rows.select("conv", _same().alias("same"), "role", "text").groupBy("conv", "same").agg(F.first("role").alias("old"), F.first("text").alias("text"))
    kept = pieces.where("same IS NOT NULL").join(texts, ["conv", "same"])
    kept = kept.select("conv", "pos", "place", "edit", F.coalesce("role", "old").alias("role"), "text")
    inserted = pieces.where("same IS NULL").select("conv", "pos", "place", "edit", "role", F.lit("").alias("text"))
    return kept.unionByName(inserted)


def _hashed(batches: Batches) -> Batches:
    """SHA-256 of the turns of each conversation, which come one after the other; only the running hash is held."""
    conv, state = None, None
    for batch in batches:
        done = []
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text")), strict=True):
            if state is None or c != conv:
                if state is not None:
                    done.append((conv, state.hexdigest()))
                conv, state = c, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        yield _digests(done)
    if state is not None:
        yield _digests([(conv, state.hexdigest())])


def _digests(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([c for c, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.string())], names=["conv", "repaired_sha256"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each conversation, repaired turns) of rows (conv, turn, was, role, text), see ``damaged``.

    Conversations: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. Turns: conv, pos, place, edit, role, text,
    in the order of (conv, pos, place). A conversation without rows has none in either. Any role but those that begin with s, u or
    a is legal nowhere. Gaps beyond a long are null. An empty table gives two empty results.
    """
    folder = shared_folder(rows.sparkSession, "conversations")
    marked = stored(judged(rows), f"{folder}/judged")
    solved = stored(plans(marked.select("conv", "pos", "code", "same"), folder), f"{folder}/plans")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    span = marked.groupBy("conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))
    span = span.select("conv", F.coalesce(wide("high") - wide("low") + 1 - wide("turns"), F.lit(0)).alias("gaps"))
    span = span.select("conv", F.expr("try_cast(gaps AS bigint)").alias("gaps"))
    names = ["blank", "duplicate", "truncated", "illegal", "cost"]
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    totals = solved.groupBy("conv").agg(*[F.sum(n).alias(n) for n in names], audit.alias("audit"))
    return span.join(totals, "conv"), _repaired(rows, solved)


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256). A hash runs over a whole conversation, so one task streams it; what it holds is one batch."""
    laid = turns.repartition("conv").sortWithinPartitions("conv", "pos", "place")
    return laid.select("conv", "role", "text").mapInArrow(tidy(_hashed), "conv long, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each original conv_id, a null one included; those that lost all rows have zeros and empty texts."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found, turns = repair(damaged(table))
    all_ids = table.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv")).distinct()
    rows = all_ids.join(found, "conv", "left").join(turn_digests(turns), "conv", "left")
    zero = [F.when(F.col("audit").isNull(), 0).otherwise(F.col(n)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    conv = F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id")
    return rows.select(conv, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
