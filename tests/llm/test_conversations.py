"""Conversation repair against a plain forward programme, and against SQL on damaged rows."""

import hashlib
import random

import pytest

from mdspark.llm import conversations as c

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, conversation string"


def plain(rows):
    """(turn, role, text) of one conversation: the summary, by cheapest edits of every prefix and state."""
    space = lambda x: " " if x is None else x
    tie = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    rows = sorted(((turn, space(r), space(t)) for turn, r, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, tie(x[1], x[2])))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", ())}

    def put(into, s, x):
        into[s] = min(into.get(s, x), x)

    def inserts(now):
        for _ in range(3):
            for s, x in list(now.items()):
                t = {0: 2, 1: 2, 2: 3, 3: 2}[s]
                put(now, t, (x[0] + 3, x[1] + "I", (*x[2], f"{'user' if t == 2 else 'assistant'}:")))

    for (_, role, text), fault in zip(rows, faults):
        inserts(best)
        new = {}
        for s, (cost, letters, lines) in best.items():
            put(new, s, (cost + 4, letters + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            t = {0: 2, 1: 2, 2: 3, 3: 2}[s]
            put(new, t, (cost + 3 + more, letters + "R", (*lines, f"{'user' if t == 2 else 'assistant'}:{text}")))
            keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], s))
            if keep is not None:
                put(new, keep, (cost + more, letters + "K", (*lines, f"{role}:{text}")))
        best = new
    inserts(best)
    cost, letters, lines = min(best[s] for s in (0, 3) if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, lengths):
    r = random.Random(seed)
    texts = ["", " \n", "Yes.", "No!", "half a", "ends. \t", "é?", None, "x" * 50 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "USER"]
    out = []
    for conv, n in enumerate(lengths):
        weights = [6, 6, 1, 1, 1, 1, 1]
        out += [(conv if conv else None, r.choice([None, i, i, i, i // 2]), r.choices(roles, weights)[0], r.choice(texts) if r.random() < 0.6 else f"text {i}.", "other") for i in range(n)]
    return out


@pytest.mark.parametrize("block", [1, 16])
def test_same_as_plain(spark, monkeypatch, block):
    monkeypatch.setattr(c, "FIRST_BLOCK", block)
    rows = made(block, [7, 1, 2, 3, 5, 9, 30, 400])
    got = {r.conv_id: tuple(r)[1:] for r in c.audit(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    own = {}
    for conv, turn, role, text, _ in rows:
        own.setdefault(conv, []).append((turn, role, text))
    assert got == {k: plain(v) for k, v in own.items()}


def test_edits_rebuild_the_conversation(spark):
    rows = made(5, [6, 8, 40])
    df = spark.createDataFrame(rows, SCHEMA)
    text = {r.conv_id: r for r in c.audit(df).collect()}
    edits = c.repair(df).collect()
    for conv, said in text.items():
        own = sorted((e for e in edits if e.conv_id == conv), key=lambda e: e.place)
        assert "".join(e.edit for e in own) == said.audit
        lines = "\n".join(f"{e.role}:{e.text}" for e in own if e.edit != "D")
        assert hashlib.sha256(lines.encode()).hexdigest() == said.repaired_sha256
        roles = "".join(e.role[:1] for e in own if e.edit != "D")
        assert not roles.removeprefix("s").replace("ua", "")


def test_one_conversation_of_equal_rows(spark):
    """A hot conversation whose rows repeat: counted before they are sorted."""
    df = spark.range(5000).selectExpr("7L AS conv_id", "CAST(NULL AS long) AS turn", "'user' AS role", "'Same.' AS text")
    r = c.audit(df).first()
    assert (r.gaps, r.duplicate, r.illegal, r.cost, r.audit) == (0, 4999, 4999, 4 * 4999 + 3, "K" + "D" * 4999 + "I")


def test_query_equals_sql_with_nulls_and_lost_conversations(spark, tmp_path):
    import duckdb

    from ..compare import rows

    table = [r[:4] for r in made(9, [5] * 60 + [1] * 60)]
    spark.createDataFrame(table, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = c.op11_conversations(spark, str(tmp_path)).toPandas()
    assert (got.audit == "").any()
    want = con.execute(c.OP11_SQL).df()
    for df in (got, want):  # a null id makes floats of whole numbers
        df["conv_id"] = df.conv_id.fillna(-1).astype(int)
    assert rows(got) == rows(want)


def test_empty_table(spark):
    assert c.audit(spark.createDataFrame([], SCHEMA)).count() == 0
