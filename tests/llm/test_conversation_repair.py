import hashlib
import itertools
import random
import re
import zlib

import pytest

from thicket.llm import conversation_repair as m

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, roles and texts) by a table over (rows left, state), strings compared outright. Rows: (role, text, fault)."""
    table = {}

    def put(i, s, way):
        if (i, s) not in table or way[:2] < table[i, s][:2]:
            table[i, s] = way

    n = len(rows)
    for i in range(n, -1, -1):
        for s in range(4):
            if i == n and s in (0, 3):
                put(i, s, (0, "", ()))
            if i < n:
                role, text, fault = rows[i]
                cost, audit, rest = table[i + 1, s]
                put(i, s, (3 + cost, "D" + audit, rest))
                if fault not in ("blank", "duplicate"):
                    extra = fault == "truncated"
                    for x in {*"ua", role[:1]}:
                        if (s, x) in NEXT:
                            cost, audit, rest = table[i + 1, NEXT[s, x]]
                            if x == role[:1]:
                                put(i, s, (cost + extra, "K" + audit, ((role, text), *rest)))
                            if x in "ua" and x:
                                put(i, s, (cost + extra + 2, "R" + audit, ((NAMES[x], text), *rest)))
        for _ in range(4):  # inserts lead to states of the same row
            for s in range(4):
                for x in "ua":
                    if (s, x) in NEXT and (i, NEXT[s, x]) in table:
                        cost, audit, rest = table[i, NEXT[s, x]]
                        put(i, s, (cost + 2, "I" + audit, ((NAMES[x], ""), *rest)))
    return table[0, 0]


def brute(table):
    """Rows of the query by plain Python."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ")):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        faults, seen = [], set()
        for _, role, text in rows:
            end = text.rstrip(WHITE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, repaired = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def run(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return m.op12_conversation_repair(spark, str(tmp_path))


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = m.op12_conversation_repair(spark, sf_dir)
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert got(found) == brute([tuple(r) for r in table.collect()])


@pytest.mark.parametrize("seed", range(6))
def test_crossings_against_the_whole_table_of_states(seed):
    rng = random.Random(seed)
    faults = ["", "blank", "duplicate", "truncated"]
    for _ in range(300):
        codes = bytes(rng.choice([1, 2, 1, 2, *range(16)]) for _ in range(rng.randrange(14)))
        rows = [("suax"[c % 4], str(i), faults[c // 4]) for i, c in enumerate(codes)]
        cost, audit, _ = cheapest(rows)
        states = m.solve(codes, 0, -1)
        assert "".join(p[2] for p in m._pieces(codes, states, 0, True)) == audit
        assert m.backward([m.ROWS[c] for c in codes], m.ENDING)[0] == cost
        cuts = sorted({0, len(codes), *(rng.randrange(len(codes) + 1) for _ in range(3))})
        blocks = [m.summary([m.ROWS[c] for c in codes[a:b]]) for a, b in itertools.pairwise(cuts)]
        assert m.crossings(blocks, 0, m.ENDING) == [states[b - 1] for b in cuts[1:]]  # blocks of rows cross alike


def random_rows(seed, conversations, turns):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Is it?", "and then", "", " \t", "well. ", "a.b", "Ünïcode…", "so.\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "admin"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, turns)):
            if rng.random() < 0.9:
                rows.append((c, t if rng.random() < 0.95 else t + 100, rng.choice(roles), rng.choice([*texts, None, f"text {t}.", f"text {t}.", f"text {t}"])))
    return list({r[:2]: r for r in rows}.values())  # one row for each turn; ties have a test of their own


@pytest.mark.parametrize("block", [3, 4096])
def test_random_conversations_in_small_and_large_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rows = random_rows(block, 120, 14) + [(c + 1000, t, r, x) for c, t, r, x in random_rows(1, 2, 200)]
    assert got(run(spark, tmp_path, rows)) == brute(rows)


def test_edge_rows(spark, tmp_path):
    rows = [
        (1, None, "user", "first of all."), (1, 1, "user", "then."), (1, 3, "assistant", "last"),
        (None, 0, "system", "a null id."), (None, 1, None, None), (None, None, "user", "x."),
        (2, None, "user", "all turns are null."), (2, None, "user", "all turns are null."),  # equal rows of one turn
        (4, 5, "user", "a long text " * 40_000 + "."), (4, 6, "assistant", "x" * 200_000),
        (5, -3, "user", "negative."), (5, 9, "assistant", "far."),
        (6, 1, "s", "only system."),
    ]
    rows += [(c, 0, "user", "one row, which the damage may drop.") for c in range(100, 160)]
    want = brute(rows)
    assert got(run(spark, tmp_path, rows)) == want
    assert ("", hashlib.sha256(b"").hexdigest()) in {w[6:] for w in want.values()}
    assert run(spark, tmp_path, []).count() == 0
    extreme = got(run(spark, tmp_path, [(1, -(1 << 62) - 5, "user", "a."), (1, (1 << 62) + 5, "assistant", "b."), (3, 7, "user", "c.")]))
    assert extreme[1][0] is None or extreme[1][0] >= 0


def test_ties_are_one_result_however_rows_lie(spark, tmp_path):
    rows = [(1, t // 4, r, x) for t, (r, x) in enumerate(itertools.product(["user", "assistant", "user"], ["a.", "b", "a.", ""]))]
    first = got(run(spark, tmp_path, rows))
    assert got(run(spark, tmp_path, rows[::-1])) == first
    again = got(run(spark, tmp_path, [(*r, 7, "x", 9) for r in rows], SCHEMA + ", conv int, kind string, code long"))
    assert again == first  # other columns, whatever their names, are not read


def test_repaired_turns_are_legal(spark, sf_dir):
    rows = m.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    _, turns = m.repair(rows)
    spelled = {}
    for r in sorted(turns.collect()):
        spelled[r.conv] = spelled.get(r.conv, "") + r.role[:1]
    assert spelled and all(re.fullmatch("s?(ua)+", s) for s in spelled.values())
