"""Conversation repair against a search over all edits and a plain dynamic programme, with blocks of every size."""

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import conversations as C
from millrace.llm import registry

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, block string, at string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def programme(rows):
    """Least (cost, audit, lines) by rounds over rows; inserts are tried twice at each place, as more are never useful."""
    best = {0: (0, "", ())}

    def better(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    def inserted(table):
        for _ in range(4):
            for state, (c, a, lines) in list(table.items()):
                role = "assistant" if state == 2 else "user"
                better(table, 3 if state == 2 else 2, (c + 5, a + "I", (*lines, role + ":")))
        return table

    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        after = {}
        for state, (c, a, lines) in inserted(best).items():
            better(after, state, (c + 2, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            wanted = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
            if role[:1] and role[:1] in wanted:
                better(after, {"s": 1, "u": 2, "a": 3}[role[0]], (c + more, a + "K", (*lines, f"{role}:{text}")))
            better(after, 3 if state == 2 else 2, (c + more + 1, a + "R", (*lines, f"{'assistant' if state == 2 else 'user'}:{text}")))
        best = after
    return min((w for s, w in inserted(best).items() if s in (0, 3)), key=lambda w: w[:2])


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row, row] if kind == 3 else [row]
    return out


def key(conv, role, text):
    owner = "n" if conv is None else f"c{conv}"
    return hashlib.sha256(f"{len(owner)} {len(role)} {owner}{role}{text}".encode()).digest()


def reports(rows):
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows}
    groups = {}
    for c, *rest in harm(rows):
        groups.setdefault(c, []).append(tuple(rest))
    for c, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], key(c, r[1], r[2])))
        turns = [t for t, *_ in own if t is not None]
        f = faults(own)
        first = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
        cost, audit, lines = programme(own)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def all_edits(codes):
    """Every audit with at most two rows put in at a place that gives the grammar: cost, audit."""
    best = None
    for ops in itertools.product("KRD", repeat=len(codes)):
        for puts in itertools.product(range(3), repeat=len(codes) + 1):
            if any(code == "-" and op != "D" for code, op in zip(codes, ops, strict=True)):
                continue
            cost, audit, shown = 0, "", [[]]
            for i in range(len(codes) + 1):
                cost += 5 * puts[i]
                audit += "I" * puts[i]
                shown = [s + list(x) for s in shown for x in itertools.product("ua", repeat=puts[i])]
                if i < len(codes):
                    code, op = codes[i], ops[i]
                    audit += op
                    cost += {"K": 0, "R": 1, "D": 2}[op] + (5 if code.isupper() and op != "D" else 0)
                    shown = [s + ([code.lower()] if op == "K" else []) for s in shown] if op != "R" else [[*s, x] for s in shown for x in "ua"]
            if any(GRAMMAR.fullmatch("".join(s)) for s in shown) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("codes", ["", "s", "u", "a", "x", "-", "A", "sua", "uua", "aus", "sss", "xx", "uUa", "U", "-ua", "a-u", "UAX", "ssu"])
def test_first_accepting_end_is_the_least_of_all_edits(codes):
    (found,) = C.cheapest(codes).values()
    assert found == all_edits(codes)


def test_chained_pieces_give_the_same_as_the_whole():
    import random

    import pyarrow as pa

    draw = random.Random(5)
    for _ in range(150):
        codes = "".join(draw.choice("suaxSUAX--uaua") for _ in range(draw.randrange(1, 12)))
        cuts = sorted({0, *(draw.randrange(len(codes)) for _ in range(3))})
        pieces = [codes[a:b] for a, b in zip(cuts, [*cuts[1:], len(codes)], strict=True)]
        rows = [
            {"conv_id": 7, "block": i, "entry": e, "end": x, "cost": c, "rank": r, "first_turn": i, "last_turn": i, "first_initial": "u", "last_initial": "u", "edits": edits}
            for i, p in enumerate(pieces) for e, x, c, r, edits in C.ways(p)
        ]
        chosen = {(r["block"], r["entry"], r["end"]): r["tail"] for r in C._chain(pa.Table.from_pylist(rows)).to_pylist()}
        taken = sorted((r["block"], r["edits"] + chosen[r["block"], r["entry"], r["end"]]) for r in rows if (r["block"], r["entry"], r["end"]) in chosen)
        whole = C.repaired(codes)[1]
        assert "".join(e for _, e in taken) == whole, codes


ROLES = ["user", "assistant", "system", "tool", None, "User", "unknown"]


def awkward():
    import random

    draw = random.Random(11)
    rows = [(None, None, None, None), (None, 1, "user", "Null id."), (-3, None, "user", "Hi."), (-3, None, "assistant", None), (-4, 0, "user", ""), (-5, 9, "user", "A."), (-5, 9, "user", "A."), (-5, 9, "assistant", "A.")]
    rows += [(-6, i, "user" if i % 2 else "assistant", "long " * 3000 + f"{i}.") for i in range(3)]
    rows += [(-9, 2**62 * (-1) ** i, "user", f"far {i}.") for i in range(2)]
    for conv in range(60):
        for i in range(draw.randrange(1, 9)):
            rows.append((conv, draw.choice([i, i, 3 * i, None]), draw.choice(ROLES[:2] if draw.random() < 0.7 else ROLES), draw.choice(["Yes.", "No!", "cut off", "été ? ", " ", f"t{i}.", "odd  "])))
    rows += [(1000, i, ("user", "assistant")[i % 2] if i % 7 else "tool", f"row {i % 90}" + "."[: i % 5]) for i in range(300)]  # one with a large share of all rows
    return rows


@pytest.mark.parametrize("block_rows", [1, 3, 50, 2048])
def test_awkward_rows(spark, block_rows):
    rows = awkward()
    df = spark.createDataFrame([(*r, "b", "a") for r in rows], SCHEMA).repartition(5)
    assert got(C.repair_reports(df, C.damaged(df), block_rows)) == reports(rows)


def test_repaired_rows_follow_the_grammar(spark):
    rows = awkward()
    df = spark.createDataFrame([(*r, "b", "a") for r in rows], SCHEMA)
    solved, placed = C.solve_conversations(df, 16)
    out = C.repaired_rows(df, solved, placed).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sub", "role"))), lambda x: F.substring(x["role"], 1, 1)), "").alias("s"))
    assert all(GRAMMAR.fullmatch(r.s) for r in out.collect())


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair_reports(none, C.damaged(none)).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got(registry.op12_conversation_repair(spark, SF)) == reports([tuple(r) for r in rows])
