"""Repair of conversations by weighted edits: the cheapest way to a legal order of roles.

Kept rows cost 0, a changed role 1, a deleted row 2, an inserted one 5; what is left must read
``(s?(ua)+)?`` in the roles' initials. Blank and repeated rows have to go; a truncated row that stays costs 5.

The edits are a weighted automaton over the kinds of rows. It is determinised lazily: a state is the vector of
what each automaton state has yet to pay to the end, less its least entry, and a table keeps each step from a
vector by a kind of row. One scan from a conversation's last row to its first is then a table look-up a row and
gives all costs. The trace runs back from the first row: of the arcs that are tight (their cost is what the two
vectors differ by) it takes the one whose letter sorts first, so the audit is the least of all cheapest ones; a
second table keeps these steps.

Rows are shuffled once, by conversation, and sorted there: to find repeats, from the end for the scan, from the
beginning for the trace. Each pass streams its rows: a conversation of any length needs memory for its audit
alone, and its hash is fed row by row. One conversation stays in one task, as its hash needs its rows in turn.

Defined results: nulls count as one space, in the key of the damage, too; rows of a null conv_id are one
conversation; rows of an equal turn go in the order of role and text, null turns first; a role's first character
is its initial, and any other than s, u, a (or none) is illegal; a conversation without rows after damage has
zeros, an empty audit and the hash of nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import shards_of, table

RATE = 20
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Kinds of rows: role initial (0 s, 1 u, 2 a, 3 any other) + 4 if truncated; ``GONE``: must be deleted.
GONE = 8
#: Automaton states: nothing yet, after s, after u, after a; where each initial leads (None: nowhere).
STATES = 4
_TO = [[1, 2, None], [None, 2, None], [None, None, 3], [None, 2, None]]
_ROLES = ["system", "user", "assistant"]
_FINAL = (0, 3)
_FAR = 1 << 20


def with_inserts(cost: list[int]) -> list[int]:
    """Costs to the end when rows may be inserted first: user or assistant, whichever may stand next."""
    cost = list(cost)
    for _ in range(STATES):
        for q in range(STATES):
            for initial in (1, 2):
                if (to := _TO[q][initial]) is not None:
                    cost[q] = min(cost[q], INSERT + cost[to])
    return cost


def arcs(q: int, kind: int) -> Iterator[tuple[str, int, int, int | None]]:
    """(letter, cost, next state, initial that is written or None) of the edits of a row."""
    yield "D", DELETE, q, None
    if kind == GONE:
        return
    more = TRUNCATED if kind >= 4 else 0
    own = kind % 4
    if own < 3 and (to := _TO[q][own]) is not None:
        yield "K", KEEP + more, to, None
    for initial in (1, 2):
        if initial != own and (to := _TO[q][initial]) is not None:
            yield "R", REROLE + more, to, initial


def code_of(vector: list[int]) -> int:
    """A normalised vector as one number: no entry is over 15, for two inserts lead to any state that can end."""
    return vector[0] | vector[1] << 4 | vector[2] << 8 | vector[3] << 12


def vector_of(code: int) -> list[int]:
    return [code >> 4 * q & 15 for q in range(STATES)]


def normalised(cost: list[int]) -> tuple[int, int]:
    least = min(cost)
    return code_of([c - least for c in cost]), least


#: The vector behind the last row.
END, END_COST = normalised(with_inserts([0 if q in _FINAL else _FAR for q in range(STATES)]))


class Scan:
    """The lazily determinised automaton: the vector before a row from the one behind it, with what it costs."""

    def __init__(self):
        self.steps: dict[int, tuple[int, int]] = {}

    def step(self, code: int, kind: int) -> tuple[int, int]:
        key = code << 4 | kind
        if (made := self.steps.get(key)) is None:
            behind = vector_of(code)
            made = self.steps[key] = normalised(with_inserts([min(cost + behind[to] for _, cost, to, _ in arcs(q, kind)) for q in range(STATES)]))
        return made


class Trace:
    """The least letters along tight arcs, a step a row: letters, inserted initials, what becomes of the row, next state."""

    def __init__(self):
        self.scan, self.steps = Scan(), {}

    def step(self, code: int, kind: int, q: int) -> tuple[str, list[int], str, int | None, int]:
        key = code << 6 | kind << 2 | q
        if (made := self.steps.get(key)) is None:
            before, least = self.scan.step(code, kind)
            here, behind = [c + least for c in vector_of(before)], vector_of(code)
            letters, inserted = "", []
            while True:
                tight = [(letter, to, initial) for letter, cost, to, initial in arcs(q, kind) if cost + behind[to] == here[q]]
                tight += [("I", to, i) for i in (1, 2) if (to := _TO[q][i]) is not None and INSERT + here[to] == here[q]]
                letter, to, initial = min(tight, key=lambda x: x[0])
                letters, q = letters + letter, to
                if letter != "I":
                    break
                inserted.append(initial)
            made = self.steps[key] = (letters, inserted, letter, initial, q)
        return made

    def end(self, q: int) -> list[int]:
        """Initials to insert behind the last row."""
        here, inserted = [c + END_COST for c in vector_of(END)], []
        while here[q]:
            initial, q = next((i, to) for i in (1, 2) if (to := _TO[q][i]) is not None and INSERT + here[to] == here[q])
            inserted.append(initial)
        return inserted


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live after damage; a dropped row stays as one that is not live."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % RATE
    rows = conversations.select("conv_id", "turn", given("role").alias("role"), given("text").alias("text"), hit.alias("hit"))
    live = F.col("hit") != 0
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    shaped = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(live, role).alias("role"), F.when(live, text).alias("text"), live.alias("live"), F.when(F.col("hit") == 3, 2).otherwise(1).alias("n"))
    return shaped.select("*", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "col")


def with_kinds(rows: DataFrame) -> DataFrame:
    """Adds fault (0 none, 1 blank, 2 duplicate, 3 truncated), initial and kind. Rows are shuffled here, by conversation."""
    rows = rows.repartition(shards_of(rows), "conv_id")
    # Sorted within what the shuffle has dealt out: no further exchange, and no group is held.
    again = F.row_number().over(W.partitionBy("conv_id", "live", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    bare = F.rtrim("text", F.lit(SPACES))
    fault = F.when(bare == "", 1).when(F.col("again"), 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    first = F.substr("role", F.lit(1), F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    marked = rows.withColumn("again", again).withColumn("fault", F.when(F.col("live"), fault)).withColumn("initial", F.when(F.col("live"), initial)).drop("again")
    kind = F.when(F.col("fault").isin(1, 2), GONE).otherwise(F.col("initial") + F.when(F.col("fault") == 3, 4).otherwise(0))
    return marked.withColumn("kind", kind)


def scanned(rows: DataFrame) -> DataFrame:
    """Adds ``behind``, the vector behind each row, ``rest``, the least cost from each row on, and ``back``, its place
    from the end; from the last row to the first."""
    # Of equal rows the one that is no repeat comes first, so it is met last.
    order = [c.desc_nulls_last() for c in (F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"), F.col("fault") == 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own, code, cost, place = Scan(), _NONE, END, END_COST, 0
        for batch in batches:
            behind, rest, back = [], [], []
            for conv, kind in zip(batch.column("conv_id").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                if conv != own:
                    own, code, cost, place = conv, END, END_COST, 0
                behind.append(code)
                if kind is not None:
                    code, more = known.step(code, kind)
                    cost += more
                rest.append(cost + (code & 15))
                back.append(place := place + 1)
            made = [pa.array(behind, pa.int32()), pa.array(rest, pa.int64()), pa.array(back, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "behind", "rest", "back"])

    return rows.sortWithinPartitions(*order).mapInArrow(run, StructType(list(rows.schema.fields)).add("behind", "integer").add("rest", "long").add("back", "long"))


_NONE = object()
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LEGAL = {(0, 1), (1, 2), (2, 1)}


class Conversation:
    """One conversation's result, made row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.count = conv_id, [0, 0, 0, 0]
        self.low = self.high = self.turn = self.before = None
        self.turns = self.illegal = self.state = 0
        self.cost: int | None = None
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.begun = True

    def add(self, trace: Trace, turn, role, text, fault, initial, kind, behind, rest) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.high = self.turn = turn
        self.count[fault] += 1
        self.illegal += self.before is not None and (self.before, initial) not in _LEGAL
        self.before = initial
        if self.cost is None:
            self.cost = rest
        letters, inserted, letter, changed, self.state = trace.step(behind, kind, self.state)
        self.audit.append(letters)
        for i in inserted:
            self.write(_ROLES[i], "")
        if letter != "D":
            self.write(role if letter == "K" else _ROLES[changed], text)

    def row(self, trace: Trace) -> tuple:
        if self.cost is not None:
            for i in trace.end(self.state):
                self.audit.append("I")
                self.write(_ROLES[i], "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.count[1:], self.illegal, self.cost or 0, "".join(self.audit), self.hash.hexdigest()


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after damage."""
    return repaired(damaged(conversations))


def repaired(rows: DataFrame) -> DataFrame:
    """As ``repair``, of rows (conv_id, turn, role, text, live) as they are; those that are not live only name their conversation."""
    id_type = rows.schema["conv_id"].dataType
    made = scanned(with_kinds(rows.select("conv_id", "turn", "role", "text", "live")))
    shape = StructType().add("conv_id", id_type)
    for c in _COUNTS:
        shape = shape.add(c, "long")
    shape = shape.add("audit", "string").add("repaired_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trace, own, done, kind = Trace(), None, [], None

        def out() -> pa.RecordBatch:
            ids, *counts, audits, hashes = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in counts), pa.array(audits, pa.string()), pa.array(hashes, pa.string())], names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.column(0).type
            for conv, live, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or conv != own.conv_id:
                    if own is not None:
                        done.append(own.row(trace))
                    own = Conversation(conv)
                if live:
                    own.add(trace, *row)
            if done:
                yield out()
                done = []
        if own is not None:
            done.append(own.row(trace))
            yield out()

    return made.sortWithinPartitions("conv_id", F.desc("back")).select("conv_id", "live", "turn", "role", "text", "fault", "initial", "kind", "behind", "rest").mapInArrow(run, shape)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, after damage: what was wrong, the cheapest edits and the hash of what they give."""
    return repair(table(spark, sf_dir, "conversations"))


#: The same by the least (cost, audit) of every suffix and automaton state, row by row from the end.
SQL = r"""
with recursive k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
h as (select *, xor(list_reduce(list_transform(string_split(key, ''), lambda ch: ord(ch)::bigint), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), 4294967295::bigint), 4294967295::bigint) % 20 as hit from k),
d as (select conv_id, turn, case when hit = 4 then 'user' else role end as role, case hit when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when hit = 3 then 2 else 1 end)) as cp from h where hit <> 0),
r as (select *, row_number() over (partition by conv_id, role, text order by i) as seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare
 from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, cp) as i from d)),
f as (select conv_id, turn, role, text, i, case when bare = '' then 1 when seen > 1 then 2 when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as fault, case left(role, 1) when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end as ini from r),
n as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) as rows_, count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated, count(*) filter (where before is not null and (before, ini) not in ((0, 1), (1, 2), (2, 1))) as illegal
 from (select *, lag(ini) over (partition by conv_id order by i) as before from f) group by conv_id),
g(conv_id, i, v) as (
 select conv_id, rows_ + 1, [{'c': 0, 'a': ''}, {'c': 10, 'a': 'II'}, {'c': 5, 'a': 'I'}, {'c': 0, 'a': ''}] from n
 union all
 select conv_id, i, [list_min([w[1], {'c': 5 + w2.c, 'a': 'I' || w2.a}]), list_min([w[2], {'c': 5 + w2.c, 'a': 'I' || w2.a}]), w2, list_min([w[4], {'c': 5 + w[3].c, 'a': 'I' || w[3].a}])]
 from (select *, list_min([w[3], {'c': 5 + w[4].c, 'a': 'I' || w[4].a}]) as w2
  from (select conv_id, i, [list_min([d[1], u, s]), list_min([d[2], u]), list_min([d[3], a]), list_min([d[4], u])] as w
   from (select f.conv_id, f.i, list_transform(v, lambda x: {'c': x.c + 2, 'a': 'D' || x.a}) as d,
     {'c': v[3].c + more + case when ini = 1 then 0 else 1 end, 'a': case when ini = 1 then 'K' else 'R' end || v[3].a} as u,
     {'c': v[4].c + more + case when ini = 2 then 0 else 1 end, 'a': case when ini = 2 then 'K' else 'R' end || v[4].a} as a,
     {'c': v[2].c + more + case when ini = 0 then 0 else 1000000 end, 'a': 'K' || v[2].a} as s
    from (select *, case fault when 0 then 0 when 3 then 5 else 1000000 end as more from f) f join g on f.conv_id is not distinct from g.conv_id and f.i = g.i - 1)))),
best as (select conv_id, v[1].c as cost, v[1].a as audit from g where i = 1),
l as (select conv_id, p, audit[p] as letter, length(replace(audit[1:p], 'I', '')) as i from (select *, unnest(range(1, len(audit) + 1)) as p from best)),
o as (select l.conv_id, l.p, l.letter, f.role, f.text, f.ini, row_number() over (partition by l.conv_id order by l.p) as place from l left join f on f.conv_id is not distinct from l.conv_id and f.i = l.i and l.letter <> 'I' where l.letter <> 'D'),
t as (select *, max(case when place = 1 and letter = 'K' and ini = 0 then 1 else 0 end) over (partition by conv_id) as led from o),
m as (select conv_id, string_agg(case when letter = 'K' then role when (place - led) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by p) as made from t group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
 coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(made, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join n on n.conv_id is not distinct from c.conv_id left join best on best.conv_id is not distinct from c.conv_id left join m on m.conv_id is not distinct from c.conv_id
"""
