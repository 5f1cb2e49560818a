"""Conversation structure repair by lightest derivations: an agenda of weighted deductions over edits."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.plans.session import cut_lineage

#: Rows of a conversation that one agenda repairs at once, and nodes of a conversation's tree that are joined at once.
BLOCK = 256
FAN = 256
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

#: fixed values: ASCII white space
_SPACE = " \t\n\x0b\x0c\r"
#: Where the roles so far lead: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: State after a role's initial.
_NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The only role that a new or a changed row can have, and the state after it.
_FILL = (("u", USER), ("u", USER), ("a", ASSISTANT), ("u", USER))
#: What must be inserted behind the last row, and its cost.
_TAIL = ("", "ua", "a", "")
_NONE = np.iinfo(np.int64).max // 4


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): conversations with faults drawn by crc32 of `conv_id:turn`, modulo 20.

    0 drops a row, 1 empties its text, 2 removes its `.!?`, 3 repeats it with the same turn, 4 makes its role user. Null conv_id
    and turn count as one space there and stay null; null role and text become one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    drawn = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("fault"))
    new_text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    new_role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.expr("explode(if(fault = 3, array(0, 1), array(0)))")
    return drawn.where("fault != 0").select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"), times.alias("time")).drop("time")


def _keyed(rows: DataFrame, conv: str) -> F.Column:
    """A conversation's name as text, also for null."""
    return F.coalesce(F.concat(F.lit("="), rows[conv].cast("string")), F.lit(""))


def lightest(codes: str, state: int, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits of rows from a state to a goal state, the ASCII-least of several; None without any.

    codes: for each row its role's initial and its fault, two characters. Without a goal the rows end a conversation: inserts
    behind the last row are allowed and any complete state is the goal.

    Items say "rows before i are repaired and lead to state s". A deduction joins an item with an edit of row i, or inserts a row
    before it; it adds the edit's cost and appends its letter, a function that grows with each argument and is never below them
    in (cost, audit) order: audits of the same rows with equal costs are no prefixes of each other, since letters decide costs.
    So an item is final when it leaves the agenda, and the first goal item that leaves it is the answer.
    """
    n = len(codes) // 2
    agenda, final = [(0, "", 0, state)], set()
    while agenda:
        cost, audit, i, s = heapq.heappop(agenda)
        if (i, s) in final:
            continue
        final.add((i, s))
        if i == n and (s == goal if goal is not None else not _TAIL[s]):
            return cost, audit
        fill = _FILL[s][1]
        if i < n or goal is None:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, fill))
        if i == n:
            continue
        initial, fault = codes[2 * i], int(codes[2 * i + 1])
        heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, s))
        if fault in (BLANK, DUPLICATE):
            continue
        more = CUT_SHORT if fault == TRUNCATED else 0
        heapq.heappush(agenda, (cost + REROLE + more, audit + "R", i + 1, fill))
        if initial in _NEXT[s]:
            heapq.heappush(agenda, (cost + KEEP + more, audit + "K", i + 1, _NEXT[s][initial]))
    return None


def scripts(codes: str, audit: str, state: int) -> list[str]:
    """For each row what is done before and to it, and behind the last row: u, a inserted; K kept, D deleted, U, A new roles."""
    out, part, i = [], "", 0
    for letter in audit:
        if letter == "I":
            role, state = _FILL[state]
            part += role
            continue
        if letter == "R":
            role, state = _FILL[state]
            letter = role.upper()
        elif letter == "K":
            state = _NEXT[state][codes[2 * i]]
        out.append(part + letter)
        part, i = "", i + 1
    if part:
        out[-1] += part
    return out


def _matrix(codes: str) -> bytes:
    """Costs from each state to each state over a block, and the order of the audits from one state: two 4 x 4 tables."""
    out = np.full((2, STATES, STATES), _NONE, dtype=np.int64)
    for p in range(STATES):
        found = {q: lightest(codes, p, q) for q in range(STATES) if not (q == START and p != START)}
        ranks = sorted(x[1] for x in found.values() if x)
        for q, x in found.items():
            if x:
                out[:, p, q] = x[0], ranks.index(x[1])
    return out.tobytes()


def _chain(tables: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Costs and audit order of all states behind consecutive blocks entered in state p, and the state before each block."""
    cost, order, before = np.full(STATES, _NONE), np.zeros(STATES, dtype=np.int64), []
    cost[p] = 0
    for costs, ranks in tables:
        best = [min(((int(cost[r] + costs[r, q]), int(order[r]), int(ranks[r, q]), r) for r in range(STATES) if cost[r] < _NONE and costs[r, q] < _NONE), default=None) for q in range(STATES)]
        # of audits that begin alike, as those of one state before do, the block's own order decides
        places = sorted((x[1], x[2]) for x in best if x)
        cost = np.array([x[0] if x else _NONE for x in best])
        order = np.array([places.index((x[1], x[2])) if x else 0 for x in best])
        before.append([x[3] if x else -1 for x in best])
    return cost, order, before


def _tables(children) -> np.ndarray:
    return np.frombuffer(b"".join(children), dtype=np.int64).reshape(-1, 2, STATES, STATES)


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix of each block."""
    for b in batches:
        yield pa.record_batch({"key": b.column("key"), "node": b.column("node"), "matrix": pa.array([_matrix(x) for x in b.column("codes").to_pylist()], pa.binary())})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix of consecutive nodes from theirs."""
    for b in batches:
        out = []
        for children in b.column("children").to_pylist():
            tables = _tables([x["matrix"] for x in children])
            rows = [_chain(tables, p)[:2] for p in range(STATES)]
            whole = np.stack([np.stack([r[0] for r in rows]), np.stack([r[1] for r in rows])]).astype(np.int64)
            out.append(whole.tobytes())
        yield pa.record_batch({"key": b.column("key"), "node": b.column("node"), "matrix": pa.array(out, pa.binary())})


def _descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at both ends of every child of a node, from those of the node; a root's last state is that of the cheapest end."""
    for b in batches:
        key, node, enter, leave, last = [], [], [], [], []
        for name, children, p, q, end in zip(*(b.column(x).to_pylist() for x in ("key", "children", "p", "q", "last"))):
            cost, order, before = _chain(_tables([x["matrix"] for x in children]), p)
            if q is None:
                q = min((int(cost[s]) + INSERT * len(_TAIL[s]), int(order[s]), s) for s in range(STATES) if cost[s] < _NONE)[2]
            states = [q]
            for back in reversed(before):
                states.append(back[states[-1]])
            states.reverse()
            n = len(children)
            key += [name] * n
            node += [x["node"] for x in children]
            enter += states[:-1]
            leave += states[1:]
            last += [end and k == n - 1 for k in range(n)]
        yield pa.record_batch({"key": pa.array(key, pa.string()), "node": pa.array(node, pa.int64()), "p": pa.array(enter, pa.int32()), "q": pa.array(leave, pa.int32()), "last": pa.array(last, pa.bool_())})


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's script, block by block."""
    for b in batches:
        out = []
        for codes, p, q, last in zip(*(b.column(x).to_pylist() for x in ("codes", "p", "q", "last"))):
            audit = lightest(codes, p, q)[1]
            if last and q is not None:
                audit += "I" * len(_TAIL[q])
            out.append(scripts(codes, audit, p))
        yield pa.record_batch({"key": b.column("key"), "node": b.column("node"), "scripts": pa.array(out, pa.list_(pa.string()))})


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each as often as it is there, with their block (of one conversation) and their place in it."""
    part = TaskContext.get().partitionId() << 24
    block, place, now = -1, BLOCK, None
    for b in batches:
        rows, nodes, places, faults = [], [], [], []
        for k, (key, n, fault) in enumerate(zip(*(b.column(x).to_pylist() for x in ("key", "n", "fault")))):
            for copy in range(n):
                if key != now or place == BLOCK:
                    block, place, now = block + 1, 0, key
                rows.append(k)
                nodes.append(part + block)
                places.append(place)
                faults.append(DUPLICATE if copy and fault != BLANK else fault)
                place += 1
                if len(rows) == 4096:
                    yield _taken(b, rows, nodes, places, faults)
                    rows, nodes, places, faults = [], [], [], []
        if rows:
            yield _taken(b, rows, nodes, places, faults)


def _taken(b: pa.RecordBatch, rows: list, nodes: list, places: list, faults: list) -> pa.RecordBatch:
    part = b.take(pa.array(rows))
    return pa.record_batch({x: part.column(x) for x in ("key", "turn", "role", "text")} | {"node": pa.array(nodes, pa.int64()), "place": pa.array(places, pa.int32()), "fault": pa.array(faults, pa.int32())})


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every row with its fault and what the cheapest edits of its conversation do: key, node, place, turn, role, text, fault, script.

    Rows of a conversation stand by (turn, nulls first, role, text); key names it (also null), and (node, place) is a row's place.
    fault: 1 blank, 2 duplicate (role and text seen earlier), 3 truncated (the last character that is no white space is none of
    `.!?`), the first that holds, else 0. script: letters for rows inserted before it (u, a), what is done to it (K kept, U or A
    kept with a new role, D deleted), and for rows inserted behind the last row.

    Edits cost: new role 1, delete 2 (the only one for blank and duplicate rows), an empty row anywhere 5, an undeleted truncated
    row 5; the role initials of what stays are `(s?(ua)+)?`. Of equal costs the ASCII-least letters (K, R, D, I) win.

    Conversations are cut into blocks of 256 rows of a sorted table, so one conversation may spread over many tasks. A conversation
    of one block is one agenda (`lightest`). Of longer ones each block gives its costs between the four states, blocks are joined
    over a tree of 256 children a node, and the states found at the root go down again to the blocks, whose agendas then give the
    edits. Texts are sorted once and not gathered.

    Null role and text count as one space. Equal rows are counted first, so a row that is there a million times is sorted once.
    Columns other than the four named ones are not looked at. An empty table gives no rows.
    """
    space = F.lit(" ")
    plain = rows.select(_keyed(rows, conv).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"))
    counted = plain.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("print", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    counted = cut_lineage(counted)
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"))
    firsts = counted.groupBy("key", "print").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    end = F.rtrim(F.col("text"), F.lit(_SPACE))
    judged = counted.join(firsts, ["key", "print"], "left").withColumn("end", end)
    fault = (F.when(F.col("end") == "", BLANK).when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place), DUPLICATE)
             .when(~F.substring("end", -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0))
    judged = cut_lineage(judged.select("key", "turn", "role", "text", "n", fault.cast("int").alias("fault")))
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ordered = judged.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = cut_lineage(ordered.mapInArrow(_numbered, "key string, turn long, role string, text string, node long, place int, fault int"))

    # two characters a row; roles without an initial of their own can't be kept
    code = F.concat(F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("-"), F.col("fault").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("place", code.alias("code"))))  # BLOCK rows at most
    blocks = ordered.groupBy("key", "node").agg(F.array_join(listed["code"], "").alias("codes"))
    blocks = cut_lineage(blocks)
    entries = _entries(blocks)
    edits = blocks.join(entries, ["key", "node"]).mapInArrow(_edited, "key string, node long, scripts array<string>")
    edits = edits.select("key", "node", F.posexplode("scripts").alias("place", "script"))
    return ordered.join(edits, ["key", "node", "place"])


def _entries(blocks: DataFrame) -> DataFrame:
    """(key, node, p, q, last): the states at both ends of every block; q is null for a block that is all of its conversation."""
    sizes = blocks.groupBy("key").agg(F.count("*").alias("n"))
    alone = blocks.join(sizes.where("n = 1"), "key").select("key", "node", F.lit(START).alias("p"), F.lit(None).cast("int").alias("q"), F.lit(True).alias("last"))
    nodes = cut_lineage(blocks.join(sizes.where("n > 1"), "key").select("key", "node", "codes").mapInArrow(_summarised, "key string, node long, matrix binary"))
    levels = []
    while not nodes.groupBy("key").count().where("count > 1").isEmpty():
        children = F.sort_array(F.collect_list(F.struct("node", "matrix")))  # FAN at most
        groups = cut_lineage(nodes.groupBy("key", F.expr(f"shiftright(node, {FAN.bit_length() - 1})").alias("parent")).agg(children.alias("children")).withColumnRenamed("parent", "node"))
        levels.append(groups)
        nodes = cut_lineage(groups.mapInArrow(_merged, "key string, node long, matrix binary"))
    entries = nodes.select("key", "node", F.lit(START).alias("p"), F.lit(None).cast("int").alias("q"), F.lit(True).alias("last"))
    for groups in reversed(levels):
        entries = cut_lineage(groups.join(entries, ["key", "node"]).mapInArrow(_descended, "key string, node long, p int, q int, last boolean"))
    return alone.union(entries)


def _line(script: str = "script") -> F.Column:
    """The repaired rows that a script makes of a row, as `role:text`."""
    kinds = {"K": F.concat("role", F.lit(":"), "text"), "U": F.concat(F.lit("user:"), "text"), "A": F.concat(F.lit("assistant:"), "text"), "u": F.lit("user:"), "a": F.lit("assistant:")}

    def one(letter: F.Column) -> F.Column:
        out = None
        for k, v in kinds.items():
            out = F.when(letter == k, v) if out is None else out.when(letter == k, v)
        return out

    return F.transform(F.filter(F.split(script, ""), lambda x: x.isin(*kinds)), one)


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """(key, node, place, step, role, text): the rows of the repaired conversations, in the order of the middle three."""
    steps = repaired.select("*", F.posexplode(F.split("script", "")).alias("step", "letter")).where("letter not in ('', 'D')")
    role = F.when(F.col("letter") == "K", F.col("role")).when(F.lower("letter") == "u", "user").otherwise("assistant")
    return steps.select("key", "node", "place", "step", role.alias("role"), F.when(F.col("letter").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key; rows come in order, and only sums, the letters and the state of the digest are kept."""
    now = None
    for b in batches:
        done = []
        columns = [b.column(x).to_pylist() for x in ("key", "turn", "initial", "fault", "script", "lines")]
        for key, turn, initial, fault, script, lines in zip(*columns):
            if now is None or key != now["key"]:
                if now is not None:
                    done.append(now)
                now = {"key": key, "turns": 0, "low": None, "high": None, "faults": [0, 0, 0, 0], "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "some": False, "last": None}
            if turn is not None and turn != now["high"]:
                now["turns"] += 1
                now["low"] = turn if now["low"] is None else now["low"]
                now["high"] = turn
            now["faults"][fault] += 1
            if now["last"] is not None and now["last"] + initial not in ("su", "ua", "au"):
                now["illegal"] += 1
            now["last"] = initial
            for letter in script:
                now["cost"] += INSERT if letter in "ua" else DELETE if letter == "D" else (REROLE if letter in "UA" else KEEP) + (CUT_SHORT if fault == TRUNCATED else 0)
            now["audit"].append(script.translate(_LETTERS))
            for line in lines:
                now["sha"].update((b"\n" if now["some"] else b"") + line.encode())
                now["some"] = True
        yield _rows(done)
    yield _rows([now] if now is not None else [])


_LETTERS = str.maketrans("uaUA", "IIRR")
_DIGEST = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _rows(done: list[dict]) -> pa.RecordBatch:
    long = [[x["high"] - x["low"] + 1 - x["turns"] if x["turns"] else 0 for x in done], *[[x["faults"][k] for x in done] for k in (BLANK, DUPLICATE, TRUNCATED)],
            [x["illegal"] for x in done], [x["cost"] for x in done]]
    text = [["".join(x["audit"]) for x in done], [x["sha"].hexdigest() for x in done]]
    return pa.record_batch([pa.array([x["key"] for x in done], pa.string()), *[pa.array(x, pa.int64()) for x in long], *[pa.array(x, pa.string()) for x in text]],
                           names=["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def repair_report(names: DataFrame, rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each conv_id of `names`, null included: the faults, costs, audit and digest of its rows' repair.

    gaps: turns missing between the least and the greatest one; blank, duplicate, truncated: rows by their first fault; illegal:
    neighbours whose role initials are none of su, ua, au; cost and audit of the cheapest edits; repaired_sha256 of the repaired
    `role:text`, joined by newlines. Conversations without rows have zeros, an empty audit and the digest of nothing.

    A digest is sequential by nature: rows of a conversation pass one task in order, sorted by Spark, and that task keeps the
    digest's state, its sums and the audit, whose length is part of the result. Everything else is decided before, in blocks.
    """
    repaired = repair(rows, conv)
    lined = repaired.select("key", "node", "place", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "script", _line().alias("lines"))
    digests = lined.repartition("key").sortWithinPartitions("key", "node", "place").mapInArrow(_digests, _DIGEST)
    known = names.select(conv).distinct().withColumn("key", F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")))
    joined = known.join(digests, "key", "left")
    zero = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(conv, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(rows, damaged(rows))


OP11_SQL = r"""
with recursive polynomial as (
  select list(v order by b) as t from (
    select b, list_reduce(list_prepend(b, range(8)), lambda v, i : case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end) as v from (select unnest(range(256)) as b)
  )
), base as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations
), drawn as (
  select b.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c : cast(ascii(c) as bigint))),
    lambda v, c : xor(v >> 8, t[(xor(v, c) & 255) + 1])), 4294967295) % 20 as fault
  from base b, polynomial
), damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then translate(text, '.!?', '') else text end as text,
    unnest(case when fault = 3 then [0, 1] else [0] end) as copy
  from drawn where fault <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
  from damaged
), judged as (
  select *, substr(role, 1, 1) as c, case when body = '' then 1
    when row_number() over (partition by conv_id, role, text order by n) > 1 then 2
    when right(body, 1) not in ('.', '!', '?') then 3 else 0 end as fault
  from placed
), paired as (
  select *, lag(c) over (partition by conv_id order by n) as before from judged
), step as (
  select * from (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(p, c, q)
), inserted as (
  select * from (values (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'),
    (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')) v(p, q, cost, audit)
), moves as (
  select j.conv_id, j.n, i.p, case e.x when 'D' then i.q when 'K' then s.q else case when i.q = 2 then 3 else 2 end end as q,
    i.cost + case e.x when 'D' then 2 when 'R' then 1 else 0 end + case when e.x <> 'D' and j.fault = 3 then 5 else 0 end as cost,
    i.audit || e.x as audit
  from judged j cross join inserted i cross join (values ('K'), ('R'), ('D')) e(x) left join step s on s.p = i.q and s.c = j.c
  where (e.x = 'D' or j.fault not in (1, 2)) and (e.x <> 'K' or s.q is not null)
), walk as (
  select distinct conv_id, cast(0 as bigint) as n, 0 as s, cast(0 as bigint) as cost, '' as audit from judged
  union all
  select conv_id, n, s, best.cost, best.audit from (
    select w.conv_id, m.n, m.q as s, min({'cost': w.cost + m.cost, 'audit': w.audit || m.audit}) as best
    from walk w join moves m on m.conv_id is not distinct from w.conv_id and m.n = w.n + 1 and m.p = w.s group by all
  )
), ended as (
  select w.conv_id, min({'cost': w.cost + i.cost, 'audit': w.audit || i.audit}) as best
  from walk w join inserted i on i.p = w.s and i.q in (0, 3) join (select conv_id, max(n) as n from judged group by conv_id) l on l.conv_id is not distinct from w.conv_id and l.n = w.n
  group by w.conv_id
), replay as (
  select conv_id, best.audit as audit, 1 as pos, 0 as s, cast(1 as bigint) as n, '' as made from ended
  union all
  select r.conv_id, r.audit, r.pos + 1,
    case substr(r.audit, r.pos, 1) when 'D' then r.s when 'K' then case j.c when 's' then 1 when 'u' then 2 else 3 end else case when r.s = 2 then 3 else 2 end end,
    r.n + case substr(r.audit, r.pos, 1) when 'I' then 0 else 1 end,
    case substr(r.audit, r.pos, 1) when 'D' then '' when 'K' then '=' || j.role || ':' || j.text
      when 'R' then case when r.s = 2 then '=assistant:' else '=user:' end || j.text else case when r.s = 2 then '=assistant:' else '=user:' end end
  from replay r left join judged j on j.conv_id is not distinct from r.conv_id and j.n = r.n
  where r.pos <= length(r.audit)
), texts as (
  select conv_id, sha256(coalesce(string_agg(substr(made, 2), chr(10) order by pos) filter (made <> ''), '')) as digest from replay group by conv_id
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
    count(*) filter (fault = 3) as truncated, count(*) filter (before is not null and before || c not in ('su', 'ua', 'au')) as illegal
  from paired group by conv_id
), names as (
  select distinct conv_id from conversations
)
select n.conv_id, cast(coalesce(c.gaps, 0) as bigint) as gaps, cast(coalesce(c.blank, 0) as bigint) as blank, cast(coalesce(c.duplicate, 0) as bigint) as duplicate,
  cast(coalesce(c.truncated, 0) as bigint) as truncated, cast(coalesce(c.illegal, 0) as bigint) as illegal, cast(coalesce(e.best.cost, 0) as bigint) as cost,
  coalesce(e.best.audit, '') as audit, coalesce(t.digest, sha256('')) as repaired_sha256
from names n left join counts c on c.conv_id is not distinct from n.conv_id left join ended e on e.conv_id is not distinct from n.conv_id
  left join texts t on t.conv_id is not distinct from n.conv_id
"""
