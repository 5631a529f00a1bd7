"""Conversation structure repair by weighted interval parsing.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``: nothing, or user and assistant in turn after at
most one system row. The repair grammar is in Chomsky normal form over the states of that language: a nonterminal (p, q)
stands for a run of rows that leads from state p to state q, its binary rules are (p, q) -> (p, r) (r, q), and its
terminal rules are the edits of one row: keep 0, rerole to user or assistant 1, delete 2 (required for blank and duplicate
rows), with 5 more where a truncated row stays. Inserting an empty user or assistant row, 5, is the grammar's only rule
over no rows; every cell is closed under it, on both sides.

A cell holds the least (cost, audit) of its span and nonterminal, the audit being the edits' initials. Cells of equal cost
are never prefixes of each other, as they edit the same rows, so the least of a span comes from the least of its parts.
``chart`` fills the cells bottom-up by span length, over all ways to split a span (the algorithm of Cocke, Younger and
Kasami).

Work is shared and bounded. A row enters as one of twelve symbols (what its initial is, and whether it is whole,
truncated or has to go). A conversation is cut into blocks of ``BLOCK`` rows; equal blocks, of any conversations, are
parsed once. As every split of a span gives the same cell for states, the blocks' cells are then joined two by two, again
bottom-up by span length, so a conversation of n rows needs log2(n / BLOCK) joins and no task ever holds its rows. Only
its digest is sequential: sorted rows pass through one task as a stream that holds the audit and one row.

Defined results: null roles and texts are one space, before the damage; a role without an initial can't be kept; rows of
equal turn are in the order of role and text; a null conv_id is a conversation of its own; repeated rows are rows of their
own (and so duplicates); an empty table gives no rows; other columns are ignored, whatever their names.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import table
from turnwise.llm.registry import query
from turnwise.session import materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
BLOCK = 32

# States: START (nothing yet), SYSTEM (a system row read), PAIRED (pairs read), ASKED (a user row waits for its answer).
START, SYSTEM, PAIRED, ASKED = range(4)
ACCEPTED = (START, PAIRED)
#: Where a row of that initial leads from each state.
STEPS = {"s": {START: SYSTEM}, "u": {START: ASKED, SYSTEM: ASKED, PAIRED: ASKED}, "a": {ASKED: PAIRED}}
#: Nonterminals (from state, to state) that some rows can have, and the binary rules over them.
PAIRS = [(p, q) for p in range(4) for q in range(4) if p == q or q in (PAIRED, ASKED) or (p, q) == (START, SYSTEM)]
RULES = [(PAIRS.index((p, q)), PAIRS.index((p, r)), PAIRS.index((r, q)))
         for p, r in PAIRS for s, q in PAIRS if r == s and (p, q) in PAIRS]
#: The least (cost, audit) of each nonterminal over a span; None where no edits lead there.
Cells = list[tuple[int, str] | None]


def joined(left: Cells, right: Cells, into: Cells | None = None) -> Cells:
    """The cells of a span from those of two parts, by the binary rules; ``into`` holds what other splits gave."""
    out: Cells = [None] * len(PAIRS) if into is None else into
    for target, first, second in RULES:
        a, b = left[first], right[second]
        if a is None or b is None:
            continue
        held, cost = out[target], a[0] + b[0]
        if held is None or cost < held[0]:
            out[target] = (cost, a[1] + b[1])
        elif cost == held[0]:
            audit = a[1] + b[1]
            if audit < held[1]:
                out[target] = (cost, audit)
    return out


def _terminals(steps: list[tuple[int, int, int, str]]) -> Cells:
    """Cells of (from, to, cost, audit) alternatives."""
    cells: Cells = [None] * len(PAIRS)
    for p, q, cost, audit in steps:
        at = PAIRS.index((p, q))
        cells[at] = (cost, audit) if cells[at] is None else min(cells[at], (cost, audit))
    return cells


def _inserted() -> Cells:
    """Cells of no rows: nothing, one or two inserted rows (more never pays)."""
    nothing = [(p, p, 0, "") for p in range(4)]
    one = [(p, q, COST[INSERT], INSERT) for i in "ua" for p, q in STEPS[i].items()]
    once = _terminals(nothing + one)
    return joined(once, once)


NO_ROWS = _inserted()


@lru_cache(maxsize=None)
def row_cells(symbol: str) -> Cells:
    """Cells of one row, closed under insertion. Symbols: initial s, u, a or x, a capital if truncated; 0 if it must go."""
    steps = [(p, p, COST[DELETE], DELETE) for p in range(4)]
    if symbol != "0":
        extra = TRUNCATED_COST if symbol.isupper() else 0
        steps += [(p, q, COST[KEEP] + extra, KEEP) for p, q in STEPS.get(symbol.lower(), {}).items()]
        steps += [(p, q, COST[REROLE] + extra, REROLE) for i in "ua" for p, q in STEPS[i].items()]
    return joined(joined(NO_ROWS, _terminals(steps)), NO_ROWS)


def chart(symbols: str) -> Cells:
    """Cells of the whole span of ``symbols``: all spans bottom-up by length, all splits of each."""
    n = len(symbols)
    if n == 0:
        return NO_ROWS
    spans = {(i, i + 1): row_cells(s) for i, s in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cells: Cells = [None] * len(PAIRS)
            for k in range(i + 1, i + length):
                joined(spans[i, k], spans[k, i + length], cells)
            spans[i, i + length] = cells
    return spans[0, n]


def best(cells: Cells) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    found = [cells[PAIRS.index((START, q))] for q in ACCEPTED]
    return min(f for f in found if f is not None)


# Damage and facts of rows

_SPACES = " \t\n\x0b\f\r"
_INITIALS = ("s", "u", "a")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the row's identity decides."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    return (rows.withColumn("fault", F.crc32(name.cast("binary")) % 20).filter("fault <> 0")
            .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
                    .alias("_copy"))
            .drop("_copy"))


def row_facts(rows: DataFrame) -> DataFrame:
    """conv_id, position (from 0), turn, initial, and which fault a row has: blank, duplicate, truncated (one at most)."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    own = Window.partitionBy("conv_id").orderBy(*order)
    same = Window.partitionBy("conv_id", "role", "digest").orderBy("position")
    ending = F.substring(F.rtrim("text", F.lit(_SPACES)), -1, 1)
    return (rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
            .withColumn("position", F.row_number().over(own) - 1)
            .withColumn("ending", ending).drop("text")
            .withColumn("seen", F.row_number().over(same) > 1)
            .select("conv_id", F.col("position").cast("long").alias("position"), "turn",
                    F.substring("role", 1, 1).alias("initial"), (F.col("ending") == "").alias("blank"),
                    ((F.col("ending") != "") & F.col("seen")).alias("duplicate"),
                    ((F.col("ending") != "") & ~F.col("seen") & ~F.col("ending").isin(".", "!", "?")).alias("truncated")))


def symbol_of(initial: Column, blank: Column, duplicate: Column, truncated: Column) -> Column:
    known = F.when(initial.isin(*_INITIALS), initial).otherwise("x")
    return F.when(blank | duplicate, "0").when(truncated, F.upper(known)).otherwise(known)


# Parsing

_CELL = "array<struct<p:int,q:int,cost:long,audit:string>>"


def _chart_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        symbols = batch.column(0)
        cells = [[{"p": p, "q": q, "cost": c[0], "audit": c[1]} for (p, q), c in zip(PAIRS, chart(s)) if c is not None]
                 for s in symbols.to_pylist()]
        yield pa.RecordBatch.from_arrays([symbols, pa.array(cells, kind)], names=["symbols", "cells"])


def _joined_cells(left: Column, right: Column) -> Column:
    """The binary rules on columns: the least (cost, audit) for each pair of states over all states between."""
    def least(p: int, q: int) -> Column:
        ways = F.flatten(F.transform(left, lambda a: F.transform(
            F.filter(right, lambda b: (a["p"] == p) & (b["q"] == q) & (a["q"] == b["p"])),
            lambda b: F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit")))))
        found = F.array_min(ways)
        return F.when(found.isNotNull(), F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), found["cost"].alias("cost"),
                                                  found["audit"].alias("audit")))

    return F.array_compact(F.array(*[least(p, q) for p, q in PAIRS]))


def parsed(facts: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, cost and audit of every conversation with rows, from (conv_id, position, symbol).

    At most ``block`` symbols of one conversation meet in a group. Cells of longer spans are joined two by two; a
    conversation leaves the loop's work when it is down to one span, so rounds shrink by half at least.
    """
    blocks = materialize(
        facts.groupBy("conv_id", F.floor(F.col("position") / block).alias("span"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "symbol"))),
                                      lambda r: r["symbol"]), "").alias("symbols")))
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, each much work: don't gather
    charts = materialize(blocks.select("symbols").distinct().repartition(tasks, F.xxhash64("symbols"))
                         .mapInArrow(_chart_batches, f"symbols string, cells {_CELL}"))
    spans = blocks.join(charts, "symbols").select("conv_id", "span", "cells")
    last = blocks.agg(F.max("span")).first()[0]
    while last:
        pair = F.floor(F.col("span") / 2)
        halves = spans.groupBy("conv_id", pair.alias("span")).agg(
            F.max(F.when(F.col("span") % 2 == 0, F.col("cells"))).alias("left"),
            F.max(F.when(F.col("span") % 2 == 1, F.col("cells"))).alias("right"))
        spans = materialize(halves.select("conv_id", "span", F.when(F.col("right").isNull(), F.col("left")).otherwise(
            _joined_cells(F.col("left"), F.col("right"))).alias("cells")))
        last //= 2
    whole = F.array_min(F.transform(
        F.filter("cells", lambda c: (c["p"] == START) & c["q"].isin(*ACCEPTED)), lambda c: F.struct(c["cost"], c["audit"])))
    return spans.select("conv_id", whole.alias("best")).select("conv_id", "best.cost", "best.audit")


# Digests of the repaired conversations

_DIGEST = "conv_id long, repaired_sha256 string"


class _Repair:
    """Applies an audit to the rows of one conversation as they come."""

    def __init__(self, conv_id: int | None, audit: str):
        self.conv_id, self.audit, self.at, self.state, self.lines = conv_id, audit, 0, START, 0
        self.digest = hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.state, self.lines = STEPS[role[0]][self.state], self.lines + 1

    def _wanted(self) -> str:
        return "assistant" if self.state == ASKED else "user"

    def _insert(self) -> None:
        while self.audit[self.at:self.at + 1] == INSERT:
            self._write(self._wanted(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != DELETE:
            self._write(role if edit == KEEP else self._wanted(), text)

    def end(self) -> tuple[int | None, str]:
        self._insert()
        return self.conv_id, self.digest.hexdigest()


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's first row carries its audit; its turns follow in order."""
    def packed(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
            names=["conv_id", "repaired_sha256"])

    open_one: _Repair | None = None
    for batch in batches:
        done = []
        for conv_id, audit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is None:
                open_one.row(role, text)
                continue
            if open_one is not None:
                done.append(open_one.end())
            open_one = _Repair(conv_id, audit)
        if done:
            yield packed(done)
    if open_one is not None:
        yield packed([open_one.end()])


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id and digest of the repaired ``role:text`` lines; a conversation of any length is streamed in order."""
    marks = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), "audit",
                          F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    turns = rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"),
                        F.lit(None).cast("string").alias("audit"), "role", "text")
    stream = marks.unionByName(turns).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "text")
    return stream.select(F.col("conv_id").cast("long").alias("conv_id"), "audit", "role", "text") \
        .mapInArrow(_digest_batches, _DIGEST)


def repair_report(original: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of ``original``: the faults of its ``rows``, the cheapest repair and the repaired digest."""
    facts = materialize(row_facts(rows))
    before = F.lag("initial").over(Window.partitionBy("conv_id").orderBy("position"))
    pair = F.concat("before", "initial")
    counts = (facts.withColumn("before", before).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.when(F.col("before").isNotNull() & ~pair.isin("su", "ua", "au"), 1).otherwise(0)).alias("illegal")))
    audits = materialize(parsed(facts.select("conv_id", "position", symbol_of(
        F.col("initial"), F.col("blank"), F.col("duplicate"), F.col("truncated")).alias("symbol")), block))
    results = _null_safe(_null_safe(counts, audits), repaired_digests(rows, audits))
    every = original.select("conv_id").distinct()
    empty = hashlib.sha256(b"").hexdigest()
    return _null_safe(every, results, "left").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
          for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _null_safe(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on conv_id where null equals null."""
    other = right.withColumnRenamed("conv_id", "_other_conv")
    return left.join(other, left["conv_id"].eqNullSafe(other["_other_conv"]), how).drop("_other_conv")


def _edit(state: str, cost: str, letters: str) -> str:
    """A state's cost and audit, as one sortable text, after further edits."""
    return f"lpad((substr({state}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letters}'"


def _closed(*states: str) -> str:
    """The four states closed under insertion."""
    start, system, paired, asked = states
    return ", ".join((
        f"{start} AS s0", f"{system} AS s1",
        f"least({paired}, {_edit(asked, '5', 'I')}, {_edit(start, '10', 'II')}, {_edit(system, '10', 'II')}) AS s2",
        f"least({asked}, {_edit(start, '5', 'I')}, {_edit(system, '5', 'I')}, {_edit(paired, '5', 'I')}) AS s3"))


_TO_USER = ", ".join(f"CASE WHEN f.cost IS NOT NULL THEN {_edit(s, '1 + f.cost', 'R')} END, "
                     f"CASE WHEN f.cost IS NOT NULL AND f.initial = 'u' THEN {_edit(s, 'f.cost', 'K')} END"
                     for s in ("r.s0", "r.s1", "r.s2"))

#: States row by row instead of spans: least cost and audit of every prefix, then the audit applied edit by edit.
_SQL = f"""
WITH RECURSIVE remainder AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS ofs
  FROM range(256) AS g(b)),
named AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hit AS (
  SELECT n.*, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(n.name, ''), lambda c: ascii(c)::BIGINT)),
      lambda x, y: xor(x >> 8, m.ofs[xor(x & 255, y) + 1])), 4294967295) % 20 AS fault
  FROM named n, remainder m),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, range(2) AS g(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
faulted AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending
  FROM damaged),
told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen FROM faulted),
f AS (
  SELECT *, ending = '' AS blank, ending <> '' AND seen AS duplicate,
         ending NOT IN ('', '.', '!', '?') AND NOT seen AS truncated,
         CASE WHEN ending = '' OR seen THEN NULL WHEN ending NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS cost,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM told),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
         count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM f GROUP BY conv_id),
r AS (
  SELECT conv_id, 0::BIGINT AS pos, {_closed("'000000000'", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR")} FROM counts
  UNION ALL
  SELECT conv_id, pos, {_closed("n0", "n1", "n2", "n3")} FROM (
    SELECT f.conv_id, f.pos, {_edit('r.s0', '2', 'D')} AS n0,
           least({_edit('r.s1', '2', 'D')},
                 CASE WHEN f.cost IS NOT NULL AND f.initial = 's' THEN {_edit('r.s0', 'f.cost', 'K')} END) AS n1,
           least({_edit('r.s2', '2', 'D')},
                 CASE WHEN f.cost IS NOT NULL THEN {_edit('r.s3', '1 + f.cost', 'R')} END,
                 CASE WHEN f.cost IS NOT NULL AND f.initial = 'a' THEN {_edit('r.s3', 'f.cost', 'K')} END) AS n2,
           least({_edit('r.s3', '2', 'D')}, {_TO_USER}) AS n3
    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos + 1)),
audits AS (
  SELECT r.conv_id, substr(least(s0, s2), 1, 9)::BIGINT AS cost, substr(least(s0, s2), 10) AS audit
  FROM r JOIN counts c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = c.n),
w AS (
  SELECT conv_id, 0 AS edit, 0::BIGINT AS pos, 's0' AS state, NULL::VARCHAR AS role, NULL::VARCHAR AS text FROM audits
  UNION ALL
  SELECT conv_id, edit, pos, CASE left(role, 1) WHEN 's' THEN 's1' WHEN 'u' THEN 's3' WHEN 'a' THEN 's2' ELSE state END,
         role, text FROM (
    SELECT w.conv_id, w.edit + 1 AS edit, w.pos + (letter <> 'I')::BIGINT AS pos, w.state,
           CASE letter WHEN 'D' THEN NULL WHEN 'K' THEN f.role
                ELSE CASE w.state WHEN 's3' THEN 'assistant' ELSE 'user' END END AS role,
           CASE letter WHEN 'I' THEN '' ELSE f.text END AS text
    FROM (SELECT w.*, substr(a.audit, w.edit + 1, 1) AS letter FROM w
          JOIN audits a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND w.edit < length(a.audit)) w
    LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1)),
repaired AS (
  SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY edit)) AS digest
  FROM w WHERE role IS NOT NULL GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank,
       coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
       coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(a.cost, 0)::BIGINT AS cost, coalesce(a.audit, '') AS audit,
       coalesce(d.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM named) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op12_interval_repair", _SQL)
def op12_interval_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(turns, damaged(turns))
