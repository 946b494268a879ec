"""Repair of a conversation's turn structure by lightest derivations.

A repaired conversation has role initials ``(s?(ua)+)?``: nothing, or user and assistant in turn, after one
system row at most.  Four states follow such a row of initials: nothing yet, after ``s``, after ``u``, after
``a``.  Repair is a weighted deduction: an item (rows read, state) is derived from an item and an edit, and its
weight, (cost, audit), is that of its antecedent with the edit's cost added and the edit's letter appended.
These functions are superior (no weight falls) and monotone, so Knuth's agenda takes items by weight, and the
first weight popped for an item is its lightest; goal items finalise the same way.

Long conversations are cut into pieces of ``PIECE`` rows.  A piece is solved from every state to every state;
the solutions are deductions themselves, and neighbours are joined, ``FAN`` at a time, until one item per
conversation is left.  Two derivations over the same rows of equal cost never are a prefix of each other, so
the order of audits survives joining on either side.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from tidemark.llm.common import stored

PIECE = 128
FAN = 32
PART = 256  # turn numbers per part
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
DONE = (START, ASSISTANT)
#: State after one more row of a role, from each state that allows it.
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3


def _deductions(rows: list[tuple[str, int]], at: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """Conclusions (rows read, state, cost, letter) of an item: one edit of the next row, or one row inserted."""
    for role in "ua":
        if state in _NEXT[role]:
            yield at, _NEXT[role][state], INSERT, "I"
    if at == len(rows):
        return
    initial, fault = rows[at]
    yield at + 1, state, DELETE, "D"
    if fault in (_BLANK, _DUPLICATE):
        return
    more = TRUNCATED if fault == _TRUNCATED else 0
    if state in _NEXT.get(initial, ()):
        yield at + 1, _NEXT[initial][state], KEEP + more, "K"
    for role in "ua":
        if state in _NEXT[role]:
            yield at + 1, _NEXT[role][state], REROLE + more, "R"


def lightest(rows: list[tuple[str, int]], state: int = START) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) from a state before the rows (initial, fault) to every state after them."""
    agenda, final, goals = [(0, "", 0, state)], set(), {}
    while agenda:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(rows):
            goals[state] = (cost, audit)
            if len(goals) == 4:
                break
        for after, into, price, letter in _deductions(rows, at, state):
            if (after, into) not in final:
                heapq.heappush(agenda, (cost + price, audit + letter, after, into))
    return goals


def apply_audit(rows: list[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that an audit leaves of (role, text), from a state on."""
    rest = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rest)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == USER else "user"
        state = _NEXT[role[:1]][state]
        yield letter, role, text


_SPACE = r"[\x20\x09-\x0D]"
_LEGAL = ("su", "ua", "au")
_PLACE = ["conv", "dated", "part", "piece"]
_SUMS = ["n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns"]
_LEAF = StructType([StructField("dated", BooleanType()), StructField("part", LongType()), StructField("piece", LongType())])
_ITEM = StructType([StructField("enter", LongType()), StructField("leave", LongType()), StructField("cost", LongType()),
                    StructField("audit", StringType()), StructField("path", StringType())])
_SOLVED = [*_LEAF, *[StructField(c, LongType()) for c in (*_SUMS, "low", "high")], StructField("first", StringType()),
           StructField("last", StringType()), StructField("items", ArrayType(_ITEM)), StructField("leaves", ArrayType(_LEAF))]
_REPAIRED = [*_LEAF.fields[:2], StructField("seq", LongType()), StructField("edit", StringType()), StructField("role", StringType()),
             StructField("text", StringType())]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(records: Iterator[dict], schema: StructType, size: int = 256) -> Iterator[pa.RecordBatch]:
    arrow, ready = to_arrow_schema(schema), []
    for record in records:
        ready.append(record)
        if len(ready) == size:
            yield pa.RecordBatch.from_pylist(ready, schema=arrow)
            ready = []
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=arrow)


def _pieces(rows: Iterator[dict], size: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Cut sorted rows into pieces of ``size``: (conv, dated, part, piece) and the rows, each with its first ``fault``."""
    place, held, piece, before = None, [], 0, None
    for row in rows:
        now, same = (row["conv"], row["dated"], row["part"]), (row["turn"], row["role"], row["text"])
        if now != place or len(held) == size:
            if held:
                yield (*place, piece), held
            piece = piece + 1 if now == place else 0
            before = before if now == place else None
            place, held = now, []
        repeated = row["late"] or same == before
        row["fault"] = _BLANK if row["blank"] else _DUPLICATE if repeated else _TRUNCATED if row["cut"] else 0
        held.append(row)
        before = same
    if held:
        yield (*place, piece), held


def _solutions(rows: Iterator[dict], size: int) -> Iterator[dict]:
    seen = None
    for place, held in _pieces(rows, size):
        initials, faults = [r["role"][:1] for r in held], [r["fault"] for r in held]
        turns = sorted({r["turn"] for r in held} - {None})
        solved = [(p, q, *weight) for p in range(4) for q, weight in lightest(list(zip(initials, faults)), p).items()]
        leaf = dict(zip(_PLACE, place))
        yield leaf | {
            "n_rows": len(held), "blank": faults.count(_BLANK), "duplicate": faults.count(_DUPLICATE), "truncated": faults.count(_TRUNCATED),
            "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
            "n_turns": len(turns) - (bool(turns) and seen == (*place[:2], turns[0])),
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "first": initials[0], "last": initials[-1],
            "items": [{"enter": p, "leave": q, "cost": cost, "audit": audit, "path": ""} for p, q, cost, audit in solved],
            "leaves": [{c: leaf[c] for c in _PLACE[1:]}]}
        seen = (*place[:2], turns[-1]) if turns else None


def join_solutions(left: dict, right: dict) -> dict:
    """The solution of two neighbouring stretches, named by the left one."""
    best: dict[tuple, tuple] = {}
    for a in left["items"]:
        for b in right["items"]:
            if a["leave"] == b["enter"]:
                weight = (a["cost"] + b["cost"], a["audit"] + b["audit"], f"{a['path']}{a['leave']}{b['path']}")
                ends = (a["enter"], b["leave"])
                best[ends] = min(best.get(ends, weight), weight)
    out = left | {c: left[c] + right[c] for c in _SUMS}
    out["illegal"] += left["last"] + right["first"] not in _LEGAL
    out["low"] = right["low"] if left["low"] is None else left["low"]
    out["high"] = left["high"] if right["high"] is None else right["high"]
    out["last"], out["leaves"] = right["last"], left["leaves"] + right["leaves"]
    out["items"] = [{"enter": p, "leave": q, "cost": w[0], "audit": w[1], "path": w[2]} for (p, q), w in best.items()]
    return out


def _fold(solved: DataFrame, part: Column, piece: Column, by: list[str]) -> DataFrame:
    """Join the solutions of equal conv and ``by`` (of the new part and piece), in order."""
    schema = solved.schema
    dealt = solved.withColumn("to_part", part).withColumn("to_piece", piece).repartition("conv", *by).sortWithinPartitions(*_PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded() -> Iterator[dict]:
            now, held = None, None
            for row in _records(batches):
                row["part"], row["piece"] = row.pop("to_part"), row.pop("to_piece")
                group = (row["conv"], *(row[c.removeprefix("to_")] for c in by))
                if held is not None and group == now:
                    held = join_solutions(held, row)
                else:
                    if held is not None:
                        yield held
                    now, held = group, row
            if held is not None:
                yield held

        yield from _batches(folded(), schema, 16)

    return dealt.mapInArrow(run, schema)


def _solved(rows: DataFrame) -> DataFrame:
    """Solutions of all pieces, written to the shared folder."""
    schema, size = StructType([rows.schema["conv"], *_SOLVED]), PIECE
    dealt = rows.repartition("conv", "dated", "part").sortWithinPartitions("conv", "dated", "part", "turn", "role", "text")
    return stored(dealt.mapInArrow(lambda batches: _batches(_solutions(_records(batches), size), schema), schema), "pieces")


def _whole(pieces: DataFrame) -> DataFrame:
    """One solution per conversation: ``FAN`` neighbours are joined at a time, in as many rounds as that takes."""
    solved, number = pieces, F.col("part").cast("long")
    while (most := solved.groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > FAN:
        if solved.where("piece > 0").limit(1).count():
            step = _fold(solved, number, F.floor(F.col("piece") / FAN).cast("long"), ["dated", "to_part", "to_piece"])
        elif solved.where("part < -1 or part > 0").limit(1).count():
            step = _fold(solved, F.floor(number / FAN).cast("long"), F.col("piece"), ["dated", "to_part", "to_piece"])
        else:
            raise RuntimeError(f"{most} solutions of a conversation left")
        solved = stored(step, "solved")
    return stored(_fold(solved, F.lit(0).cast("long"), F.lit(0).cast("long"), []), "whole")


def _applied(rows: DataFrame, pieces: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows that the chosen audits leave, in order of (conv, dated, part, seq)."""
    steps = F.arrays_zip(F.col("leaves").alias("leaf"), F.split(F.concat(F.lit("0"), "path"), "").alias("enter"),
                         F.split(F.concat("path", F.col("leave").cast("string")), "").alias("leave"))
    way = whole.select("conv", F.explode(steps).alias("s")).select(
        F.col("conv").alias("of"), "s.leaf.*", F.col("s.enter").cast("long").alias("enter"), F.col("s.leave").cast("long").alias("leave"))
    same = F.col("of").eqNullSafe(F.col("conv"))
    for c in _PLACE[1:]:
        same = same & (way[c] == pieces[c])
    taken = F.filter("items", lambda x: (x["enter"] == way["enter"]) & (x["leave"] == way["leave"]))[0]["audit"]
    marks = way.join(pieces, same).select(pieces["conv"], pieces["dated"], pieces["part"], pieces["piece"], way["enter"], taken.alias("audit"))
    both = marks.withColumn("kind", F.lit(0)).unionByName(rows.select("conv", "dated", "part", "turn", "role", "text").withColumn("kind", F.lit(1)), True)
    dealt = both.repartition("conv", "dated", "part").sortWithinPartitions("conv", "dated", "part", "kind", "piece", "turn", "role", "text")
    schema, size = StructType([rows.schema["conv"], *_REPAIRED]), PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edited() -> Iterator[dict]:
            place, audits, held, seq = None, [], [], 0

            def close() -> Iterator[dict]:
                nonlocal seq
                enter, audit = audits.pop(0)
                for edit, role, text in apply_audit(held, audit, enter):
                    yield dict(zip(("conv", "dated", "part"), place)) | {"seq": seq, "edit": edit, "role": role, "text": text}
                    seq += 1

            for row in _records(batches):
                now = (row["conv"], row["dated"], row["part"])
                if now != place or len(held) == size:
                    if held:
                        yield from close()
                    held = []
                    if now != place:
                        place, audits, seq = now, [], 0
                if row["kind"] == 0:
                    audits.append((row["enter"], row["audit"]))
                else:
                    held.append((row["role"], row["text"]))
            if held:
                yield from close()

        yield from _batches(edited(), schema)

    return dealt.mapInArrow(run, schema)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Cheapest repair of every conversation: a report per conversation, and the repaired rows.

    The report has (conv, ``n_rows``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit``); the rows have (conv, ``dated``, ``part``, ``seq``, ``edit``, ``role``, ``text``) and are in order
    by the four columns after each other.  Rows go by turn, null turns first, equal turns by role and text;
    repeated rows are rows of their own, all but the first duplicates.  A row's first fault counts: blank (only
    white space), duplicate (role and text seen earlier), truncated (not closed by one of ``.!?``).  Null roles
    and texts are one space: blank, and fit for no place.  Rows of a null conversation make one conversation.
    Equally cheap repairs are settled by the least audit.  An empty table gives two empty tables; other columns
    are not looked at.
    """
    turn = F.col(turn_col).cast("long")
    rows = rows.select(
        F.col(conv_col).alias("conv"), turn.isNotNull().alias("dated"), F.coalesce(F.floor(turn / PART), F.lit(0)).cast("long").alias("part"),
        turn.alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    names = [F.col("conv"), F.col("role"), F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b")]
    often = rows.select(*names, "dated", "turn").groupBy("conv", "role", "text_a", "text_b").agg(
        F.count("*").alias("n"), F.min(F.struct("dated", "turn")).alias("at")).where("n > 1")
    often = often.select(F.col("conv").alias("of"), F.col("role").alias("as"), "text_a", "text_b", "at")
    same = F.col("of").eqNullSafe(F.col("conv")) & (F.col("as") == F.col("role")) & (F.col("text_a") == F.xxhash64("text")) & (
        F.col("text_b") == F.xxhash64(F.lit(1), "text"))
    later = F.coalesce(F.struct("dated", "turn") > F.col("at"), F.lit(False))
    judged = rows.join(often, same, "left").select(
        *rows.columns, later.alias("late"), (~F.col("text").rlike(f"[^{_SPACE[1:]}")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?]{_SPACE}*\z")).alias("cut"))
    pieces = _solved(judged)
    whole = _whole(pieces)
    goals = F.filter("items", lambda x: (x["enter"] == START) & x["leave"].isin(*DONE))
    chosen = stored(whole.withColumn("goal", F.array_min(F.transform(goals, lambda x: F.struct(x["cost"], x["audit"], x["path"], x["leave"])))).select(
        "*", "goal.cost", "goal.audit", "goal.path", "goal.leave").drop("goal", "items"), "chosen")
    report = chosen.select(
        F.col("conv").alias(conv_col), "n_rows", F.coalesce(F.expr("high - low + 1 - n_turns"), F.lit(0)).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, _applied(rows, pieces, chosen).withColumnRenamed("conv", conv_col)


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with one row in twenty each dropped, emptied, cut open, repeated or given to the user, by a hash."""
    blank = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in (conv_col, turn_col)])
    text, role = (F.coalesce(F.col(c).cast("string"), blank) for c in (text_col, role_col))
    code = F.crc32(name.cast("binary")) % 20
    hurt = rows.select(
        F.col(conv_col), F.col(turn_col), F.when(code == 4, "user").otherwise(role).alias(role_col),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
        F.explode(F.array_repeat(F.lit(1), F.when(code == 0, 0).when(code == 3, 2).otherwise(1))).alias("copy"))
    return hurt.drop("copy")


def digests(report: DataFrame, repaired: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The report for every conversation named in a table, with the digest of its repaired ``role:text`` lines.

    The digest runs over a conversation in order; nothing but its state is held.
    """
    schema = StructType([StructField("of", repaired.schema[conv_col].dataType), StructField("repaired_sha256", StringType())])
    rows = repaired.withColumnRenamed(conv_col, "conv")
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "dated", "part", "seq").select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digested() -> Iterator[dict]:
            now, state = None, None
            for row in _records(batches):
                line = f"{row['role']}:{row['text']}".encode()
                if state is not None and row["conv"] == now:
                    state.update(b"\n" + line)
                    continue
                if state is not None:
                    yield {"of": now, "repaired_sha256": state.hexdigest()}
                now, state = row["conv"], hashlib.sha256(line)
            if state is not None:
                yield {"of": now, "repaired_sha256": state.hexdigest()}

        yield from _batches(digested(), schema)

    named = conversations.select(F.col(conv_col).alias("conv")).distinct()
    said = report.withColumnRenamed(conv_col, "told")
    hashed = dealt.mapInArrow(run, schema)
    out = named.join(said, F.col("told").eqNullSafe(F.col("conv")), "left").join(hashed, F.col("of").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias(conv_col), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _step(*choices: str) -> str:
    """Least of some (cost, audit, lines) structs in DuckDB."""
    return f"list_sort([{', '.join(choices)}])[1]"


def _more(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {line}}}"


def _oracle() -> str:
    """Lightest derivations row by row: a struct per state, rows of the state after the next row, then insertions."""
    user, assistant, kept = r"chr(10) || 'user:' || text", r"chr(10) || 'assistant:' || text", "chr(10) || role || ':' || text"
    never = "1000000000"

    def keep(state: str, initial: str) -> str:
        return _more(state, f"CASE WHEN fault < 2 AND initial = '{initial}' THEN late ELSE {never} END", "K", kept)

    def rerole(state: str, line: str) -> str:
        return _more(state, f"CASE WHEN fault < 2 THEN 3 + late ELSE {never} END", "R", line)

    empty_user, empty_assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    gone = {k: _more(f"s{k}", "4", "D") for k in range(4)}
    rows = {0: gone[0], 1: _step(gone[1], keep("s0", "s")),
            2: _step(gone[2], *[f(f"s{k}", x) for k in (0, 1, 3) for f, x in ((keep, "u"), (rerole, user))]),
            3: _step(gone[3], keep("s2", "a"), rerole("s2", assistant))}
    second = _step("t2", *[_more(f"t{k}", "3", "I", empty_user) for k in (0, 1, 3)])
    third = _step("t3", _more("n2", "3", "I", empty_assistant))
    start = "{'c': %s, 'a': '%s', 'r': %s}"
    return rf"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
  ORDER BY i) AS t FROM range(256) AS r(i)),
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: ord(name[i])::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code FROM coded, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM hurt),
judged AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 3
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 1 ELSE 0 END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS met FROM placed),
walk AS (
  SELECT conv_id, 0::BIGINT AS k, {start % ("0::BIGINT", "", "''")} AS s0, {start % (f"{never}::BIGINT", "", "''")} AS s1,
    {start % ("3::BIGINT", "I", empty_user)} AS s2, {start % ("6::BIGINT", "II", f"{empty_user} || {empty_assistant}")} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, k, t0, t1, n2, {third} FROM (SELECT *, {second} AS n2 FROM (
    SELECT w.conv_id, j.k, {rows[0]} AS t0, {rows[1]} AS t1, {rows[2]} AS t2, {rows[3]} AS t3
    FROM walk w JOIN (SELECT *, CASE WHEN fault = 1 THEN 3 ELSE 0 END AS late FROM judged) j
    ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.k = w.k + 1))),
ended AS (SELECT conv_id, {_step("s0", "s3")} AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
  count(*) FILTER (met IS NOT NULL AND met NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
  sha256(CASE WHEN best.r = '' THEN '' ELSE best.r[2:] END) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE = _oracle()
