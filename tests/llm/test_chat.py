import hashlib

import duckdb
from pyspark.sql import functions as F

from tessera.llm import chat as C

TEXTS = ["plain", "![image](s3/a.png 4) and ![audio](b.wav)![document](c d) ![image](x)", "", None, "\\/ \\( \\) /)(", "\\### Assistant: </turn> ok", "<turn:assistant>x</turn>", "a\\<b\\>c\\\\", "</turn>\n<", "語 🤔\n\nend\\"]


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def rows():
    out = []
    for c in range(12):
        out += [(c, t, ["system", "user", "assistant", "assi<st>ant", None][(c + t) % 5], TEXTS[(3 * c + t) % len(TEXTS)]) for t in range(c % 6)]
    return out + [(None, None, "assistant", "no id"), (None, 1, "user", "nor this"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (20, 0, "r" * 30000, "long role"), (20, 1, "<>\\" * 9000, "x"), (20, 2, "assistant", "<\\ " * 30000)]


def table(spark, data, clash=True):
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    return df.selectExpr("*", "'own' as c", "1 as u", "2 as at", "'p' as parts", "'f' as formatted") if clash else df


def test_reading_back(spark):
    """Rows without an id are conversations of their own."""
    data = rows()
    found = C.query(table(spark, data)).collect()
    got = {r.conv_id: r for r in found if r.conv_id is not None}
    by = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    alone = []
    for c, t, role, text in sorted(data, key=lambda x: (x[0] is None, x[0] or 0, -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        if c is None:
            alone.append([(role or "", text or "")])
        else:
            by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    assert sorted(r.turns_sha256 for r in found if r.conv_id is None) == sorted(map(digest, alone))
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), digest(turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert max(r.n_attachments for r in found) > 2 and max(r.expanded_tokens for r in found) > 1000 and any("s3/a.png b.wav" in r.references for r in found)


def test_sql_agrees(spark):
    data = rows()
    mine = C.query(table(spark, data))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    theirs = con.execute(C.SQL)
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(mine.columns)
    assert sorted(map(repr, theirs.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in mine.collect())


def test_typed_parts(spark):
    data = [
        (1, 0, "user", [("text", "see <image:0> ", None, None), ("image", None, "s3/a.png", 4), ("audio", None, "b.wav", 3)]),
        (1, 1, "assistant", [("text", "a cat", None, None), ("document", None, "c.pdf", None)]),
        (2, 0, "user", None),
    ]
    df = spark.createDataFrame(data, f"conv_id long, turn int, role string, parts array<{C.PART}>")
    got = {r.conv_id: r for r in C.format_chat(df, parts="parts", text="role").collect()}
    assert got[1].formatted == "<turn:user>see \\(image:0\\) <image:0><audio:1></turn><turn:assistant>a cat<document:2></turn>"
    assert [(a.number, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [(0, "image", "s3/a.png", 1024), (1, "audio", "b.wav", 75), (2, "document", "c.pdf", 768)]
    assert got[1].expanded_tokens == 1867 and got[2].formatted == "<turn:user></turn>"
    assert "".join(got[1].formatted[s.start : s.end] for s in got[1].loss_spans) == "a cat<document:2>"


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in C.query(df).collect()] == [-7] and C.format_chat(df).select(F.col("formatted")).count() == 0
