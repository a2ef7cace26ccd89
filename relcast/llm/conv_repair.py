"""Operator 12: conversation structure repair by a run-length dynamic program.

Every row of a conversation is a symbol: the initial of its role and its fault (blank, duplicate, truncated or none).
The repaired conversation is an optional system row and pairs of user and assistant rows, ``(s?(ua)+)?``, or nothing.
The program's states say what has been written: nothing, the system row, a user row, an assistant row.  A symbol's
transition is a 4 x 4 min-plus matrix over these states (insertions before the row included).

* Equal consecutive symbols are one run.  A run of n rows advances the costs by the binary powers of its matrix, which
  are cached, so the costs at the run's other end take log(n) steps.  Going back, a run is halved until the choice of
  every row can be read off; among cheapest edits the least letter is taken at each step.  Cost is a function of the
  edit letters, so the least string of letters is also the one whose beginning is least.
* Rows are sorted by Spark over (conversation, turn, role, hash of the text), in ranges: a conversation may lie in any
  number of tasks.  Each task packs its rows into segments of bounded size.  A conversation that lies in one segment
  is solved there and then.  The others go on as segments: a set of text hashes tells each segment what was said before,
  each segment is reduced to its min-plus matrix, one pass from the last segment to the first carries four costs, each
  segment then finds its end state for every state it may be entered in, one pass forward carries the state, and every
  segment unrolls its own part of the audit.  Only the audit (one letter a row) and the running SHA-256 of one
  conversation, which are single values by definition, meet in one task, segment after segment.

Defined cases: a null conversation id is a conversation of its own; null roles, texts, and null ids or turns in
the damage key are one space; rows of one turn are ordered by role and hash of the text; other columns are ignored; an empty
table gives no rows; text length is not bounded (a text longer than a segment is a segment).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare_packed, shared_table, table

SEGMENT_ROWS, SEGMENT_BYTES = 4096, 1 << 20
BLANK_SPACE = " \t\n\v\f\r"
NEVER = 1 << 60
EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # what has been written last
INSERT = (USER, USER, ASSISTANT, USER)  # state after an inserted row
END = (0, NEVER, NEVER, 0)
KEEP = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
Costs = tuple[int, int, int, int]
Matrix = tuple[Costs, Costs, Costs, Costs]
Symbol = tuple[str, str]  # initial (s, u, a or empty), fault: "x" must go, "t" truncated, "" none
Run = tuple[Symbol, int]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(x + y for x, y in zip(row, col)) for col in zip(*b)) for row in a)


def _apply(a: Matrix, v: Costs) -> Costs:
    return tuple(min(x + y for x, y in zip(row, v)) for row in a)


def _closure() -> Matrix:
    step = tuple(tuple(0 if i == j else 5 if INSERT[i] == j else NEVER for j in range(4)) for i in range(4))
    return _times(_times(step, step), step)


INSERTIONS = _closure()
LAST = _apply(INSERTIONS, END)


def _moves(symbol: Symbol, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row."""
    initial, fault = symbol
    yield "D", 2, state
    if fault != "x":
        extra = 5 if fault == "t" else 0
        if (initial, state) in KEEP:
            yield "K", extra, KEEP[initial, state]
        yield "R", 1 + extra, ASSISTANT if state == USER else USER


POWERS: dict[Symbol, list[Matrix]] = {}  # of at most 9 symbols, some 60 powers of each at most


def power(symbol: Symbol, k: int) -> Matrix:
    """Transition of 2**k rows of one symbol."""
    have = POWERS.setdefault(symbol, [])
    if not have:
        one = [[NEVER] * 4 for _ in range(4)]
        for state in range(4):
            for _, cost, to in _moves(symbol, state):
                one[state][to] = min(one[state][to], cost)
        have.append(_times(INSERTIONS, tuple(map(tuple, one))))
    while len(have) <= k:
        have.append(_times(have[-1], have[-1]))
    return have[k]


def before(run: Run, v: Costs) -> Costs:
    """Costs to the end from before the run, given those from after it."""
    symbol, n = run
    k = 0
    while n >> k:
        if n >> k & 1:
            v = _apply(power(symbol, k), v)
        k += 1
    return v


def run_matrix(run: Run) -> Matrix:
    symbol, n = run
    out, k = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4)), 0
    while n >> k:
        if n >> k & 1:
            out = _times(out, power(symbol, k))
        k += 1
    return out


def _unroll_run(run: Run, state: int, after: Costs, out: list[str]) -> int:
    symbol, n = run
    if symbol[1] == "x":  # deletion is the only edit of such a row, and it leaves the state
        out.append("D" * n)
        return state
    if n > 1:
        half = n // 2
        state = _unroll_run((symbol, n - half), state, before((symbol, half), after), out)
        return _unroll_run((symbol, half), state, after, out)
    left = before(run, after)[state]
    while True:
        options = [(letter, cost, to) for letter, cost, to in _moves(symbol, state)]
        options.append(("I", 5, INSERT[state]))
        value = lambda m: m[1] + (before(run, after)[m[2]] if m[0] == "I" else after[m[2]])
        letter, cost, state = min((m for m in options if value(m) == left), key=lambda m: m[0])
        out.append(letter)
        left -= cost
        if letter != "I":
            return state


def unroll(runs: tuple[Run, ...], state: int, after: Costs, last: bool) -> tuple[str, int]:
    """The least cheapest edits of the runs entered in ``state``, and the state behind them."""
    marks = [after]
    for run in reversed(runs):
        marks.append(before(run, marks[-1]))
    out: list[str] = []
    for run, v in zip(runs, marks[-2::-1]):
        state = _unroll_run(run, state, v, out)
    while last and END[state]:
        out.append("I")
        state = INSERT[state]
    return "".join(out), state


def collapse(symbols: list[Symbol]) -> tuple[Run, ...]:
    runs: list[list] = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    return tuple((s, n) for s, n in runs)


def said(role: str, text: str) -> bytes:
    """Identity of a message: 32 bytes of the role and the whole text."""
    return hashlib.sha256(role.encode() + b"\0" + text.encode()).digest()


class Segment:
    """Consecutive rows of one conversation in order, with what the audit needs of them."""

    def __init__(self, turns: list[int | None], roles: list[str], texts: list[str], earlier: set[bytes]):
        self.roles, self.texts = roles, texts
        self.symbols: list[Symbol] = []
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        seen = set(earlier)
        for role, text in zip(roles, texts):
            body = text.rstrip(BLANK_SPACE)
            mark = said(role, text)
            fault = "blank" if not body else "duplicate" if mark in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add(mark)
            if fault:
                counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else ""
            self.symbols.append(("", "x") if fault in ("blank", "duplicate") else (initial, "t" if fault else ""))
        self.runs = collapse(self.symbols)
        known = [t for t in turns if t is not None]
        heads = [r[:1] for r in roles]
        self.facts = {**counts, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])),
                      "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)),
                      "head": heads[0] if heads else None, "tail": heads[-1] if heads else None}

    def repair(self, audit: str, state: int) -> tuple[int, list[str]]:
        """Cost of the audit and the lines it leaves, entered in ``state``."""
        cost, lines, row = 0, [], 0
        for letter in audit:
            if letter == "I":
                state = INSERT[state]
                lines.append(f"{NAMES[state]}:")
                cost += 5
                continue
            (initial, fault), role, text = self.symbols[row], self.roles[row], self.texts[row]
            row += 1
            if letter == "D":
                cost += 2
                continue
            state = KEEP[initial, state] if letter == "K" else ASSISTANT if state == USER else USER
            lines.append(f"{role if letter == 'K' else NAMES[state]}:{text}")
            cost += (letter == "R") + 5 * (fault == "t")
        return cost, lines


class Total:
    """The result of one conversation, fed with its segments in order."""

    def __init__(self) -> None:
        self.n = {k: 0 for k in ("blank", "duplicate", "truncated", "illegal", "cost")}
        self.low = self.high = self.tail = None
        self.turns, self.audit, self.sha, self.first = 0, [], hashlib.sha256(), True

    def add(self, facts: dict, audit: str, cost: int, text: bytes, lines: int) -> None:
        for k in ("blank", "duplicate", "truncated", "illegal"):
            self.n[k] += facts[k]
        self.n["cost"] += cost
        if facts["head"] is not None:
            self.n["illegal"] += self.tail is not None and self.tail + facts["head"] not in ("su", "ua", "au")
            self.tail = facts["tail"]
        if facts["low"] is not None:
            self.turns += facts["turns"] - (facts["low"] == self.high)
            self.low, self.high = facts["low"] if self.low is None else self.low, facts["high"]
        self.audit.append(audit)
        if lines:
            self.sha.update(text if self.first else b"\n" + text)
            self.first = False

    def row(self, conv) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": conv, "gaps": gaps, **self.n, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT_DDL = ", ".join(f"{c} bigint" for c in RESULT) + ", audit string, repaired_sha256 string"
FACTS_DDL = "struct<blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, low: bigint, high: bigint, turns: bigint, head: string, tail: string>"


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, copies after damage; a dropped row stays with 0 copies, so that its conversation is known."""
    blank = lambda c: F.coalesce(c, F.lit(" "))
    name = F.concat(blank(F.col(f"`{conv_col}`").cast("string")), F.lit(":"), blank(F.col(f"`{turn_col}`").cast("string")))
    kind = F.crc32(name.cast("binary")) % 20
    out = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                      blank(F.col(f"`{role_col}`").cast("string")).alias("role"), blank(F.col(f"`{text_col}`").cast("string")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("kind") == 0, "").otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return out.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def _batch(rows: list[dict], names: list[str], like: Callable[[str], pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], like(n)) for n in names], names)


def _arrow_types(df_schema) -> Callable[[str], pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema
    types = to_arrow_schema(df_schema)
    return lambda n: types.field(n).type


def _map(df: DataFrame, ddl: str, rows_of: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """A task function over dictionaries; batches go out by rows and bytes, so a task holds little at a time."""
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(ddl)
    names, like = schema.names, _arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                for at in range(0, b.num_rows, 64):
                    yield from b.slice(at, 64).to_pylist()

        held: list[dict] = []
        size = 0
        for r in rows_of(rows()):
            held.append(r)
            size += 200 + r.pop("__bytes", 0)
            if size > SEGMENT_BYTES:
                yield _batch(held, names, like)
                held, size = [], 0
        if held:
            yield _batch(held, names, like)

    return df.mapInArrow(run, ddl)


def _pack(rows: Iterator[dict]) -> Iterator[dict]:
    """Sorted rows -> a result for each conversation that is whole here, segments of the others."""
    from pyspark import TaskContext
    part, seq = TaskContext.get().partitionId(), 0
    conv, state, held, size = None, "first", ([], [], []), 0  # state: first, inner or cut

    def close(whole: bool) -> dict:
        if whole:
            s = Segment(*held, set())
            audit, _ = unroll(s.runs, EMPTY, LAST, True)
            cost, lines = s.repair(audit, EMPTY)
            total = Total()
            total.add(s.facts, audit, cost, "\n".join(lines).encode(), len(lines))
            return total.row(conv)
        return {"conv_id": conv, "part": part, "seq": seq, "turns": held[0], "roles": held[1], "texts": held[2],
                "marks": list({said(r, t) for r, t in zip(held[1], held[2])}), "__bytes": size}

    started = False
    for r in rows:
        if started and r["conv"] != conv:
            yield close(state == "inner")
            seq, state, held, size = seq + 1, "inner", ([], [], []), 0
        elif started and (len(held[0]) >= SEGMENT_ROWS or size >= SEGMENT_BYTES):
            yield close(False)
            seq, state, held, size = seq + 1, "cut", ([], [], []), 0
        conv, started = r["conv"], True
        for _ in range(r["copies"]):
            for to, c in zip(held, ("turn", "role", "text")):
                to.append(r[c])
            size += 50 + len(r["text"])
    if started:
        yield close(False)  # the conversation may go on in the next task


def _per_conversation(rows: Iterator[dict], step: Callable[[dict, object], tuple[dict, object]]) -> Iterator[dict]:
    """Carries a state through the rows of each conversation (rows sorted by conversation)."""
    conv, state, started = None, None, False
    for r in rows:
        if not started or r["conv_id"] != conv:
            conv, state, started = r["conv_id"], None, True
        out, state = step(r, state)
        yield out


def _runs(column: list[dict]) -> tuple[Run, ...]:
    return tuple(((r["initial"], r["fault"]), r["n"]) for r in column)


def _reduce(rows: Iterator[dict]) -> Iterator[dict]:
    """Segment with what was said before it -> runs, matrix and facts."""
    for r in rows:
        s = Segment(r["turns"], r["roles"], r["texts"], set(r["earlier"] or ()))
        m = run_matrix((("", ""), 0))
        for run in s.runs:
            m = _times(m, run_matrix(run))
        yield {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "facts": s.facts, "matrix": [x for row in m for x in row],
               "runs": [{"initial": i, "fault": f, "n": n} for (i, f), n in s.runs], "__bytes": 100 * len(s.runs)}


def _back(r: dict, after: Costs | None) -> tuple[dict, Costs]:
    after = after or LAST
    m = r["matrix"]
    return ({"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "after": list(after)},
            _apply(tuple(tuple(m[i:i + 4]) for i in range(0, 16, 4)), after))


def _ends(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        runs = _runs(r["runs"])
        yield {k: r[k] for k in ("conv_id", "part", "seq", "after")} | {"ends": [unroll(runs, q, tuple(r["after"]), False)[1] for q in range(4)]}


def _forward(r: dict, state: int | None) -> tuple[dict, int]:
    state = state or EMPTY
    return {k: r[k] for k in ("conv_id", "part", "seq", "after", "final")} | {"entry": state}, r["ends"][state]


def _solve(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        s = Segment(r["turns"], r["roles"], r["texts"], set(r["earlier"] or ()))
        audit, _ = unroll(s.runs, r["entry"], tuple(r["after"]), r["final"])
        cost, lines = s.repair(audit, r["entry"])
        text = "\n".join(lines).encode()
        yield {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "facts": s.facts, "audit": audit, "cost": cost,
               "text": text, "lines": len(lines), "__bytes": len(text)}


def _finish(rows: Iterator[dict]) -> Iterator[dict]:
    conv, total = None, None
    for r in rows:
        if total is None or r["conv_id"] != conv:
            if total is not None:
                yield total.row(conv)
            conv, total = r["conv_id"], Total()
        total.add(r["facts"], r["audit"], r["cost"], r["text"], r["lines"])
    if total is not None:
        yield total.row(conv)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Results of the conversations in ``rows`` (conv, turn, role, text, copies)."""
    kind = _type(rows, "conv")
    at = f"conv_id {kind}, part int, seq int"
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", F.xxhash64("text")]
    spread = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows, in any number, may lie in several tasks
    placed = spread.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys, "text").drop("salt")
    found = shared_table(_map(placed, f"{at}, {RESULT_DDL}, turns array<bigint>, roles array<string>, texts array<string>, marks array<binary>", _pack), "conversations")
    whole = found.where("part is null").select("conv_id", *RESULT, "audit", "repaired_sha256")
    pieces = found.where("part is not null").select("conv_id", "part", "seq", "turns", "roles", "texts", "marks")
    order = ["conv_id", "part", "seq"]
    place = ["part", "seq"]  # names a segment

    # messages of one conversation that several segments hold: all segments but the first have them from before
    marks = pieces.select("conv_id", *place, F.explode("marks").alias("mark"))
    firsts = (marks.groupBy("conv_id", "mark").agg(F.min(F.struct(*place)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
              .select(F.col("conv_id").alias("c"), F.col("mark").alias("m"), "first"))
    known = (marks.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m"))).where(F.struct(*place) != F.col("first"))
             .groupBy(*place).agg(F.collect_list("mark").alias("earlier")))
    pieces = shared_table(pieces.drop("marks").join(known, place, "left"), "segments")

    reduced = shared_table(_map(pieces, f"{at}, facts {FACTS_DDL}, matrix array<bigint>, runs array<struct<initial: string, fault: string, n: bigint>>", _reduce), "reduced")
    back = reduced.select("conv_id", *place, "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    after = shared_table(_map(back, f"{at}, after array<bigint>", lambda rows: _per_conversation(rows, _back)), "costs-after")
    both = reduced.select("conv_id", *place, "runs").join(after.select(*place, "after"), place)
    ends = _map(both, f"{at}, after array<bigint>, ends array<int>", _ends)
    last = after.groupBy("conv_id").agg(F.max(F.struct(*place)).alias("l")).select("l.part", "l.seq", F.lit(True).alias("final"))
    ends = ends.join(last, place, "left").fillna(False, ["final"]).repartition("conv_id").sortWithinPartitions(*order)
    entries = _map(ends, f"{at}, after array<bigint>, final boolean, entry int", lambda rows: _per_conversation(rows, _forward))
    solved = _map(pieces.join(shared_table(entries, "entries").select(*place, "after", "final", "entry"), place),
                  f"{at}, facts {FACTS_DDL}, audit string, cost bigint, text binary, lines bigint", _solve)
    joined = _map(solved.repartition("conv_id").sortWithinPartitions(*order), f"conv_id {kind}, {RESULT_DDL}", _finish)
    return whole.unionByName(joined)


def op12_conv_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage of every conversation, and its cheapest repair."""
    prepare_packed(spark)
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))
