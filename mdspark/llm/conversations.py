"""Repair of conversations to (system)? (user assistant)+ by a checkpointed dynamic programme.

A conversation's rows are read in order of turn (nulls first; rows of one turn by a digest of role and text). A row's
first fault counts: blank, duplicate (its role and text stood before), truncated (its last character ends no sentence).
Edits: K keeps a row (0), R gives it the role that is due (3), D deletes it (4; blank and duplicate rows must be), I
puts an empty row of the role that is due anywhere (3); a truncated row that stays adds 3. Of the cheapest edits whose
roles read as asked, those with the ASCII-least initials are taken.

The programme runs over four states of the roles so far, from the end of a conversation to its beginning: a row turns
the four costs-to-go behind it into the four before it. Those vectors are stored at checkpoints only. Blocks grow by
one row from one to the next, so that a run of n rows has about the root of 2n checkpoints, and a block no more rows:

1. rows are sorted by ranges of (conversation, turn, digest), so that a long conversation lies in many tasks; each
   task reduces every block to its 4 x 4 matrix of costs;
2. a conversation's matrices, last first, are applied one after the other: the vectors at the checkpoints;
3. rows and vectors are read in order; a block's vectors are computed again from the checkpoint behind it, and the
   walk forward takes the ASCII-least edit among those that lose nothing against the cost-to-go.

Equal rows of a turn are counted before anything is sorted, and flags are computed without texts, which are moved
twice. All three steps are streams: a task holds one block. In step 3 a conversation's rows pass one task in order, as
its text's digest has to; nothing of it is collected.

Defined cases: null roles and texts count as one space; a null conversation id is a conversation; null turns come
first and count for no gap; an empty role, or one that begins neither with s, u nor a, fits nowhere; repeated
rows are duplicates; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Costs; rows of a run's first block.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FIRST_BLOCK = 16
WHITE = " \t\n\x0b\x0c\r"
FAR = 1 << 60
FAULTS = ("", "blank", "duplicate", "truncated")
BLANK, DUPLICATE, CUT = 1, 2, 3
#: States: nothing yet, after system, after user, after assistant. Where a role's initial leads, and what is due.
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
DUE = {0: 2, 1: 2, 2: 3, 3: 2}
NAMES = {2: "user", 3: "assistant"}
#: What is missing at the end of a conversation, by state.
END = (0, 2 * INSERT, INSERT, 0)
ROW = "conv_id, place, edit, fault, turn, role, text"


def damage(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): conversations with faults by the checksum of `conv_id:turn`; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(code == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))


def flags(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, texts) of (conv_id, turn, role, text, copies): distinct rows (conv_id, turn, tie, m, initial, fault), and (conv_id, turn, tie, role, text)."""
    own = df.where("copies > 0").withColumn("tie", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    each = own.groupBy("conv_id", "turn", "tie").agg(F.sum("copies").cast("long").alias("m"), F.first("role").alias("role"), F.first("text").alias("text"))
    each = common.materialize(each, "rows")
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    same = F.concat(F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")), F.lit(":"), "tie")
    light = each.select("conv_id", "turn", "tie", "m", F.substring("role", 1, 1).alias("initial"), (F.length(body) == 0).alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"), same.alias("same"), F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("at"))
    light = common.materialize(light, "flags")
    first = common.materialize(light.groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("n")), "first")
    joined = common.join_hot(light, first, "same", "n", light.count())
    fault = F.when(F.col("blank"), BLANK).when(F.col("at") != F.col("first"), DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    return common.materialize(joined.select("conv_id", "turn", "tie", "m", "initial", fault.cast("int").alias("fault")), "faults"), each.drop("m")


def before(costs: list[int], initial: str, fault: int, m: int) -> list[int]:
    """Costs-to-go before m equal rows from those behind them; all but the first are duplicates."""
    more = DELETE * (m - 1)
    c = [more + x for x in costs]
    out = [DELETE + x for x in c]
    if fault not in (BLANK, DUPLICATE):
        stay = TRUNCATED if fault == CUT else 0
        for s, t in DUE.items():
            out[s] = min(out[s], stay + REROLE + c[t])
        for s, t in KEEPS.get(initial, {}).items():
            out[s] = min(out[s], stay + c[t])
    two, three = min(out[2], INSERT + out[3]), min(out[3], INSERT + out[2])
    return [min(out[0], INSERT + two), min(out[1], INSERT + two), two, three]


def blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, matrix): of each block the first row's place, and costs from each state before it to each behind it."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    arrow = rows.select("conv_id").limit(0).toArrow().schema.field("conv_id").type
    order = ["conv_id", "turn", "tie"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        most, out = FIRST_BLOCK, []

        def close() -> None:
            ends = []
            for j in range(4):
                c = [0 if s == j else FAR for s in range(4)]
                for _, _, _, m, initial, fault in reversed(held):
                    c = before(c, initial, fault, m)
                ends.append([min(x, FAR) for x in c])
            out.append((*held[0][:3], [ends[j][s] for s in range(4) for j in range(4)]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(pa.int64()))], names=[*order, "matrix"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[-1][0] != row[0]:
                    close()
                    held, most = [], FIRST_BLOCK
                elif len(held) == most:
                    close()
                    held, most = [], most + 1
                held.append(row)
            if len(out) > 1000:
                yield flush()
        if held:
            close()
        if out:
            yield flush()

    ranged = rows.select(*order, "m", "initial", "fault").repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, f"conv_id {kind}, turn bigint, tie string, matrix array<bigint>")


def checkpoints(matrices: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, costs): the costs-to-go behind each block."""
    kind = matrices.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, costs, begun = None, list(END), False
        for b in batches:
            found = []
            for conv, matrix in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if not begun or conv != now:
                    now, costs, begun = conv, list(END), True
                found.append(costs)
                costs = [min(matrix[4 * s + j] + costs[j] for j in range(4)) for s in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["conv_id", "turn", "tie", "costs"])

    dealt = matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("tie"))
    return dealt.mapInArrow(run, f"conv_id {kind}, turn bigint, tie string, costs array<bigint>")


class Walk:
    """One conversation, walked forward block by block."""

    def __init__(self):
        self.state = self.cost = self.place = self.illegal = self.distinct = 0
        self.faults = [0, 0, 0, 0]
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0
        self.initial: str | None = None
        self.first: int | None = None
        self.last: int | None = None

    def edit(self, letter: str, fault: int, turn: int | None, role: str | None, text: str | None, out: list | None) -> None:
        self.place += 1
        self.audit.append(letter)
        if letter != "D":
            self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.lines += 1
        if out is not None:
            out.append((self.place, letter, FAULTS[fault], turn, role, text))

    def insert(self, out: list | None) -> None:
        self.state, self.cost = DUE[self.state], self.cost + INSERT
        self.edit("I", 0, None, NAMES[self.state], "", out)

    def block(self, rows: list[list], behind: list[int], out: list | None) -> None:
        """rows: [turn, m, initial, fault, role, text]; behind: the costs-to-go at the checkpoint behind them."""
        vectors = [behind]
        for _, m, initial, fault, _, _ in reversed(rows):
            vectors.append(before(vectors[-1], initial, fault, m))
        vectors.reverse()
        for (turn, m, initial, fault, role, text), here, behind_row in zip(rows, vectors, vectors[1:]):
            self.look(turn, m, initial, fault)
            more, left = DELETE * (m - 1), here[self.state]
            stay = TRUNCATED if fault == CUT else 0
            while True:
                keep = KEEPS.get(initial, {}).get(self.state) if fault not in (BLANK, DUPLICATE) else None
                due = DUE[self.state]
                if left == DELETE + more + behind_row[self.state]:
                    self.cost += DELETE
                    self.edit("D", fault, turn, role, text, out)
                elif left == INSERT + here[due]:
                    self.insert(out)
                    left = here[self.state]
                    continue
                elif keep is not None and left == stay + more + behind_row[keep]:
                    self.state, self.cost = keep, self.cost + stay
                    self.edit("K", fault, turn, role, text, out)
                else:
                    self.state, self.cost = due, self.cost + stay + REROLE
                    self.edit("R", fault, turn, NAMES[due], text, out)
                break
            for _ in range(m - 1):
                self.cost += DELETE
                self.edit("D", BLANK if fault == BLANK else DUPLICATE, turn, role, text, out)
        self.audit = ["".join(self.audit)]

    def look(self, turn: int | None, m: int, initial: str, fault: int) -> None:
        """Count the faults, turns and pairs of m equal rows."""
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        self.faults[fault] += 1
        self.faults[BLANK if fault == BLANK else DUPLICATE] += m - 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += m - 1
        self.initial = initial

    def end(self, out: list | None) -> None:
        while END[self.state]:
            self.insert(out)

    def summary(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


SUMMARY = pa.schema([("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
EDITS = pa.schema([("place", pa.int64()), ("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def walked(df: DataFrame, edits: bool) -> DataFrame:
    """Of (conv_id, turn, role, text, copies), in which rows of no copies only say that there is the conversation: its edits, or its summary."""
    common.small_batches(df.sparkSession)
    rows, texts = flags(df)
    behind = checkpoints(common.materialize(blocks(rows), "blocks"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    arrow = rows.select("conv_id").limit(0).toArrow().schema.field("conv_id").type
    none: dict[str, Column] = {c: F.lit(None).cast(t) for c, t in (("turn", "bigint"), ("tie", "string"), ("costs", "array<bigint>"), ("m", "bigint"), ("initial", "string"), ("fault", "int"), ("role", "string"), ("text", "string"))}
    part = lambda d, step: d.select("conv_id", F.lit(step).alias("step"), *(F.col(c) if c in d.columns else v.alias(c) for c, v in none.items()))
    known = df.select("conv_id").distinct()
    every = part(known, 0).unionByName(part(behind, 1)).unionByName(part(rows, 2)).unionByName(part(texts, 3))
    schema = EDITS if edits else SUMMARY
    # 0: a conversation begins; 1: the costs behind the block that begins here; 2: a row; 3: its text
    order = ["conv_id", F.expr("CASE WHEN step = 0 THEN 0 ELSE 1 END"), "turn", "tie", "step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk: Walk | None = None
        conv, costs, held, found, ids = None, list(END), [], [], []

        def block() -> None:
            if held:
                walk.block(held, costs, found if edits else None)
                held.clear()

        def close() -> None:
            if walk is not None:
                block()
                walk.end(found if edits else None)
                if not edits:
                    found.append(walk.summary())
                named()

        def named() -> None:
            ids.extend([conv] * (len(found) - len(ids)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*found))
            out = [pa.array(ids, arrow), *(pa.array(c, f.type) for c, f in zip(columns, schema))]
            found.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(out, names=["conv_id", *schema.names])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                step = row[1]
                if step == 0:
                    close()
                    walk, conv = Walk(), row[0]
                elif step == 1:
                    block()
                    costs = row[4]
                elif step == 2:
                    held.append([row[2], row[5], row[6], row[7], None, None])
                else:
                    held[-1][4:] = row[8:10]
            if walk is not None and len(found) > 500:
                named()
                yield flush()
        close()
        if found:
            yield flush()

    types = {pa.int64(): "bigint", pa.string(): "string"}
    said = ", ".join(f"{f.name} {types[f.type]}" for f in schema)
    return every.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, f"conv_id {kind}, {said}")


def rows_of(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) of a table of conversations."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), F.lit(1).alias("copies"))


def repair(df: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, place, edit, fault, turn, role, text): every edit in order; the repaired conversation is all rows but those of edit D."""
    return walked(rows_of(df, **columns), True)


def audit(df: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation."""
    return walked(rows_of(df, **columns), False)


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    return walked(damage(common.table(spark, sf_dir, "conversations")), False)


def _sql() -> str:
    """The same forwards: of every state the cheapest edits so far, ties by their initials."""
    insert = lambda x, role: f"{{'c': {x}.c + {INSERT}, 'a': {x}.a || 'I', 'r': {x}.r || chr(10) || '{role}:'}}"
    delete = lambda x: f"{{'c': {x}.c + {DELETE}, 'a': {x}.a || 'D', 'r': {x}.r}}"
    stay = lambda x, s: f"{{'c': {x}.c + CASE WHEN initial = '{s}' THEN 0 ELSE {REROLE} END + CASE fault WHEN 3 THEN {TRUNCATED} WHEN 0 THEN 0 ELSE 1000000000 END, 'a': {x}.a || CASE WHEN initial = '{s}' THEN 'K' ELSE 'R' END, 'r': {x}.r || chr(10) || CASE WHEN initial = '{s}' THEN role ELSE '{dict(u='user', a='assistant')[s]}' END || ':' || text}}"
    system = f"{{'c': w0.c + CASE WHEN initial = 's' AND fault IN (0, 3) THEN fault ELSE 1000000000 END, 'a': w0.a || 'K', 'r': w0.r || chr(10) || role || ':' || text}}"
    closed = lambda src: f"SELECT *, list_min([w3_, {insert('w2', 'assistant')}]) AS w3 FROM (SELECT *, v0 AS w0, v1 AS w1, v3 AS w3_, list_min([v2, {insert('v0', 'user')}, {insert('v1', 'user')}, {insert('v3', 'user')}]) AS w2 FROM {src})"
    far = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'r': ''}"
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE tab(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc(k, c, p) AS (SELECT DISTINCT k, CAST(4294967295 AS BIGINT), 1 FROM src UNION ALL SELECT crc.k, xor(crc.c >> 8, tab.c), p + 1 FROM crc JOIN tab ON tab.k = 8 AND tab.i = xor(crc.c, ascii(crc.k[p])) & 255 WHERE p <= length(crc.k)),
code AS (SELECT k, xor(c, 4294967295) % 20 AS code FROM crc WHERE p = length(k) + 1),
damaged AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src JOIN code USING (k)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i, rtrim(text, {white}) AS body, role[1:1] AS initial FROM damaged),
rows_ AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN body[-1:] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS past FROM placed),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (past IS NOT NULL AND past || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
dp(conv_id, i, v0, v1, v2, v3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}}, {far}, {far}, {far} FROM conversations
  UNION ALL
  SELECT conv_id, i + 1, {delete('w0')}, list_min([{delete('w1')}, {system}]), list_min([{delete('w2')}, {stay('w0', 'u')}, {stay('w1', 'u')}, {stay('w3', 'u')}]), list_min([{delete('w3')}, {stay('w2', 'a')}])
  FROM ({closed("(SELECT dp.*, r.role, r.text, r.initial, r.fault FROM dp JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1)")})),
ends AS (SELECT conv_id, list_min([v0, w3]) AS best FROM ({closed("(SELECT dp.* FROM dp LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.i = coalesce(c.n, 0))")}))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(best.r[2:]) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


OP11_SQL = _sql()
