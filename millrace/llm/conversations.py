"""Repair of conversation structure: the cheapest edits that make the roles of a conversation follow system, (user, assistant) repeated.

Dijkstra runs on the edit lattice (turn index, grammar state), whose nodes are made as they are popped, with the key (cost, audit). Rows
are sorted over the whole cluster and cut into blocks, so that a conversation of any length is many tasks' work: whole conversations are
solved where they lie; the pieces of a cut one are solved from each grammar state to each, and the pieces are chained by their costs.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The faults, the costs of edits, and the grammar (s?(ua)+)? as states: 0 nothing yet, 1 after s, 2 after u, 3 after a.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ENDS = (0, 3)
#: What must be inserted at the end, by the state there.
TAIL = {0: "", 1: "UA", 2: "A", 3: ""}
LEGAL = {"su", "ua", "au"}
BLOCK_ROWS = 2048


def steps(code: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, initial of the edit, next state) of what can be done with a row. code: its role's initial (x: none of s, u, a), in upper
    case if it is truncated, or - if it must go."""
    yield DELETE, "D", state
    if code != "-":
        more = LEFT_TRUNCATED if code.isupper() else 0
        kept = KEEPS.get((state, code.lower()))
        if kept is not None:
            yield more, "K", kept
        yield more + REROLE, "R", NEXT[state]


def cheapest(codes: str, entry: int = 0, whole: bool = True) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) at the end of codes, by the state there.

    whole: of the first accepting end node that is popped, alone; rows may be inserted behind the last one. Otherwise of every end node that can
    be reached, without rows behind the last one: then no audit of one piece is a proper prefix of another of it.
    """
    done: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str]] = {}
    heap = [(0, "", 0, entry)]
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(codes):
            if whole and state in ENDS:
                return {state: (cost, audit)}
            if not whole:
                ends[state] = (cost, audit)
                if len(ends) == len(NEXT):
                    return ends
                continue
        heapq.heappush(heap, (cost + INSERT, audit + "I", at, NEXT[state]))
        if at < len(codes):
            for more, edit, after in steps(codes[at], state):
                heapq.heappush(heap, (cost + more, audit + edit, at + 1, after))
    return ends


def edits(codes: str, entry: int, audit: str) -> str:
    """The audit with the roles that it gives: k, d, u or a (role changed to it), U or A (a row put in). The grammar leaves no choice."""
    out, at, state = [], 0, entry
    for edit in audit:
        if edit == "K":
            out.append("k")
            state = KEEPS[state, codes[at].lower()]
        elif edit == "D":
            out.append("d")
        else:
            state = NEXT[state]
            role = "u" if state == 2 else "a"
            out.append(role if edit == "R" else role.upper())
        at += edit != "I"
    return "".join(out)


@lru_cache(maxsize=20_000)
def repaired(codes: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    (cost, audit), = cheapest(codes).values()
    return cost, edits(codes, 0, audit)


def ways(codes: str) -> list[tuple[int, int, int, int, str]]:
    """(entry, exit, cost, rank, edits) of a piece of a conversation; rank: the place of its audit among those of the piece."""
    found = [(entry, end, cost, audit) for entry in NEXT for end, (cost, audit) in cheapest(codes, entry, whole=False).items()]
    rank = {audit: i for i, audit in enumerate(sorted({x[3] for x in found}))}
    return [(entry, end, cost, rank[audit], edits(codes, entry, audit)) for entry, end, cost, audit in found]


WAYS = "block long, first_at long, whole boolean, entry int, end int, cost long, rank int, edits string"
FACTS = "blank long, duplicate long, truncated long, illegal long, turns long, least_turn long, most_turn long, first_turn long, last_turn long, first_initial string, last_initial string"
NAMES = [x.split()[0] for x in f"{WAYS}, {FACTS}".split(", ")]
TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def _solve(block_rows: int):
    def solve(table: pa.Table) -> pa.Table:
        """The rows of one block: the solution of each conversation that it has whole, and all ways through the two at its ends."""
        table = table.sort_by("at")
        ids, at, turn, initial, fault = (table.column(c).to_pylist() for c in ("conv_id", "at", "turn", "initial", "fault"))
        starts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
        out: dict[str, list] = {name: [] for name in ("conv_id", *NAMES)}
        for lo, hi in zip(starts, [*starts[1:], len(ids)], strict=True):
            codes = "".join("-" if f in (BLANK, DUPLICATE) else c.upper() if f == TRUNCATED else c for c, f in zip(initial[lo:hi], fault[lo:hi], strict=True))
            faults, turns = fault[lo:hi], [t for t in turn[lo:hi] if t is not None]
            broken = sum(initial[i] + initial[i + 1] not in LEGAL for i in range(lo, hi - 1))
            facts = (faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), broken, len(set(turns)), min(turns, default=None), max(turns, default=None), turn[lo], turn[hi - 1], initial[lo], initial[hi - 1])
            whole = lo > 0 and hi < len(ids)
            for way in [(0, 0, repaired(codes)[0], 0, repaired(codes)[1])] if whole else ways(codes):
                for name, value in zip(out, (ids[lo], at[lo] // block_rows, at[lo], whole, *way, *facts), strict=True):
                    out[name].append(value)
        kinds = [table.schema.field("conv_id").type, *(TYPES[x.split()[1]] for x in f"{WAYS}, {FACTS}".split(", "))]
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return solve


CHOICE = "block long, entry int, end int, tail string, illegal_more long, turns_less long"


def _chain(table: pa.Table) -> pa.Table:
    """The way through each piece of one cut conversation: costs add up, and audits compare by the ranks of their pieces."""
    pieces: dict[int, list[dict]] = {}
    for row in table.to_pylist():
        pieces.setdefault(row["block"], []).append(row)
    order = sorted(pieces)
    here, came = {0: (0, 0)}, []
    for block in order:
        best: dict[int, tuple] = {}
        for w in pieces[block]:
            if w["entry"] in here:
                cost, rank = here[w["entry"]]
                key = (cost + w["cost"], rank, w["rank"], w["entry"])
                best[w["end"]] = min(best.get(w["end"], key), key)
        rank = {pair: i for i, pair in enumerate(sorted({k[1:3] for k in best.values()}))}
        here = {end: (k[0], rank[k[1:3]]) for end, k in best.items()}
        came.append({end: k[3] for end, k in best.items()})
    end = min(here, key=lambda s: (here[s][0] + INSERT * len(TAIL[s]), here[s][1], len(TAIL[s])))
    tail, rows = TAIL[end], []
    for i in reversed(range(len(order))):
        now, before = pieces[order[i]][0], pieces[order[i - 1]][0] if i else None
        illegal = int(before is not None and before["last_initial"] + now["first_initial"] not in LEGAL)
        same = int(before is not None and now["first_turn"] is not None and before["last_turn"] == now["first_turn"])
        rows.append((order[i], came[i][end], end, tail, illegal, same))
        end, tail = came[i][end], ""
    kinds = [TYPES[x.split()[1]] for x in CHOICE.split(", ")]
    columns = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    owner = table.column("conv_id").combine_chunks()
    return pa.table([pa.concat_arrays([owner.slice(0, 1)] * len(rows)), *columns], names=["conv_id", *(x.split()[0] for x in CHOICE.split(", "))])


def _filled(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, with a blank for a missing role or text, and key, the same for equal texts of one role in one conversation."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    owner = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    own = F.concat(F.length(owner).cast("string"), F.lit(" "), F.length("role").cast("string"), F.lit(" "), owner, F.col("role"), F.col("text"))
    return rows.withColumn("key", F.unhex(F.sha2(own, 256)))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def solve_conversations(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The edits of each conversation, and its rows in their order.

    rows: conv_id, turn, role, text. Rows stand by turn (nulls first), those of one turn by role and the SHA-256 of their text. A row is
    blank without a character other than ASCII white space, else a duplicate if an earlier row of the conversation has its role and text, else truncated
    if its last such character is none of .!? . Blank and duplicate rows must go.

    First result, written: conv_id, block, first_at, edits, cost, blank, duplicate, truncated, illegal, turns, least_turn, most_turn; one
    row for each piece of a conversation, in the order of block. Second result, written: conv_id, at (its place), turn, key.
    Nulls in conv_id are one conversation; a null role or text is a blank. Equal rows are put in different sort ranges, no task or group
    holds more than block_rows rows of a conversation, and what is chained is 16 numbers for each block of a cut one.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    slim = _filled(rows).select(
        "conv_id", "turn", "role", "key", initial.alias("initial"),
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0).alias("fault"), F.monotonically_increasing_id().alias("_equal"),
    )
    order = ["conv_id", "turn", "role", "key", "_equal"]
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.select("conv_id", "turn", "key", "initial", "fault", F.monotonically_increasing_id().alias("at")))
    first = placed.groupBy("key").agg(F.min("at").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    later = F.coalesce(F.col("at") > F.col("_first"), F.lit(False)) & (F.col("fault") != BLANK)
    coded = placed.join(first, "key", "left").select("conv_id", "at", "turn", "initial", F.when(later, DUPLICATE).otherwise(F.col("fault")).alias("fault"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    blocks = coded.groupBy(F.expr(f"at div {int(block_rows)}").alias("_block"))
    found = written(blocks.applyInArrow(_solve(int(block_rows)), f"conv_id {kind}, {WAYS}, {FACTS}"))
    cut = found.filter(~F.col("whole"))
    slim_cut = cut.select("conv_id", "block", "entry", "end", "cost", "rank", "first_turn", "last_turn", "first_initial", "last_initial")
    chosen = slim_cut.groupBy("conv_id").applyInArrow(_chain, f"conv_id {kind}, {CHOICE}")
    chosen = chosen.select(F.col("conv_id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in ("block", "entry", "end")), "tail", "illegal_more", "turns_less")
    kept = same(F.col("conv_id"), F.col("_id"))
    for c in ("block", "entry", "end"):
        kept = kept & (F.col(c) == F.col(f"_{c}"))
    sums = ["blank", "duplicate", "truncated", "least_turn", "most_turn"]
    whole = found.filter("whole").select("conv_id", "block", "first_at", "edits", "cost", "illegal", "turns", *sums)
    parts = cut.join(chosen, kept).select(
        "conv_id", "block", "first_at", F.concat("edits", "tail").alias("edits"), (F.col("cost") + INSERT * F.length("tail")).alias("cost"),
        (F.col("illegal") + F.col("illegal_more")).alias("illegal"), (F.col("turns") - F.col("turns_less")).alias("turns"), *sums,
    )
    return written(whole.unionByName(parts)), placed.select("conv_id", "at", "turn", "key")


def conversation_reports(solved: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows; from the first result of solve_conversations."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns")]
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"])
    out = solved.groupBy("conv_id").agg(*sums, F.min(wide("least_turn")).alias("lo"), F.max(wide("most_turn")).alias("hi"), F.translate(F.array_join(pieces, ""), "kduaUA", "KDRRII").alias("audit"))
    gaps = F.coalesce((F.col("hi") - F.col("lo") + 1 - F.col("turns")).cast("long"), F.lit(0).cast("long"))
    return out.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired_rows(rows: DataFrame, solved: DataFrame, placed: DataFrame) -> DataFrame:
    """conv_id, at, sub (their order), turn (null: put in), edit (keep, rerole, insert), role, text of the repaired conversations.

    Texts are fetched by their key, which no two kept rows share, as duplicates go.
    """
    taken = solved.select("conv_id", "first_at", F.posexplode(F.regexp_extract_all("edits", F.lit("[UA]*[kdua]|[UA]+"), F.lit(0))).alias("_pos", "_edit"))
    taken = taken.select("conv_id", (F.col("first_at") + F.col("_pos")).alias("at"), "_edit")
    added = taken.select("conv_id", "at", F.posexplode(F.split(F.regexp_extract("_edit", "^[UA]+", 0), "")).alias("sub", "_role")).filter("_role != ''")
    role = lambda c: F.when(c == "u", "user").when(c == "a", "assistant")
    added = added.select("conv_id", "at", "sub", F.lit(None).cast("long").alias("turn"), F.lit("insert").alias("edit"), role(F.lower("_role")).alias("role"), F.lit("").alias("text"))
    own = taken.select("at", F.regexp_extract("_edit", "[kua]$", 0).alias("_own"), F.length("_edit").alias("sub")).filter("_own != ''")
    own = placed.join(own, "at")
    texts = _filled(rows).groupBy("key").agg(F.any_value("role").alias("_role"), F.any_value("text").alias("text"))
    own = own.join(texts, "key").select("conv_id", "at", "sub", "turn", F.when(F.col("_own") == "k", "keep").otherwise("rerole").alias("edit"), F.coalesce(role(F.col("_own")), F.col("_role")).alias("role"), "text")
    return own.unionByName(added)


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the SHA-256 of the lines role:text of each conversation. Rows of a conversation are streamed through one task in
    their order, one Arrow batch at a time, as a SHA-256 can't be split; none is gathered."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    nulls_first = repaired.select("conv_id", "at", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = nulls_first.repartition("conv_id").sortWithinPartitions("conv_id", "at", "sub")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, state, open_ = None, hashlib.sha256(), False
        for batch in batches:
            ids, digests = [], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                data = line.as_buffer()
                if open_ and conv == owner:
                    state.update(b"\n")
                else:
                    if open_:
                        ids.append(owner)
                        digests.append(state.hexdigest())
                    owner, state, open_ = conv, hashlib.sha256(), True
                state.update(data)
            kind_of = batch.schema.field(0).type
            yield pa.record_batch({"conv_id": pa.array(ids, kind_of), "repaired_sha256": pa.array(digests, pa.string())})
        if open_:
            yield pa.record_batch({"conv_id": pa.array([owner], kind_of), "repaired_sha256": pa.array([state.hexdigest()])})

    return ordered.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, damaged by crc32(conv_id:turn) % 20: dropped, emptied, without .!?, twice, as the user's; nulls are blanks."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "UTF-8")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_kind")).filter("_kind != 0")
    changed = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def repair_reports(original: DataFrame, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For every conv_id of original, the report and digest of its rows; zeros, an empty audit and the empty text's digest where it has none."""
    solved, placed = solve_conversations(rows, block_rows)
    digests = conversation_digests(repaired_rows(rows, solved, placed)).select(F.col("conv_id").alias("_digest_id"), "repaired_sha256")
    reports = conversation_reports(solved).withColumnRenamed("conv_id", "_report_id")
    all_ids = original.select("conv_id").distinct()
    out = all_ids.join(reports, same(F.col("conv_id"), F.col("_report_id")), "left").join(digests, same(F.col("conv_id"), F.col("_digest_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
