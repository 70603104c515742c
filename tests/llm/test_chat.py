"""Reply trees against brute force, the template's round trip, and hostile conversations."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat

SCHEMA = "conv_id long, msg_id long, parent_id long, role string, text string, score double, formatted string"


def brute_paths(rows: list[tuple], top: int) -> dict:
    """{(conv, rank): [(role, text), ...]}"""
    convs: dict = {}
    for conv, m, p, role, text, score, _ in rows:
        convs.setdefault(conv, {})[m] = (p, role or "", text or "", score or 0.0)
    out = {}
    for conv, nodes in convs.items():
        branches = []
        for leaf in nodes.keys() - {n[0] for n in nodes.values()}:
            path, seen, at = [], set(), leaf
            while at in nodes and at not in seen:
                seen.add(at)
                path.append(at)
                at = nodes[at][0]
            if at not in seen:
                branches.append((-sum(nodes[m][3] for m in path), -len(path), leaf, path[::-1]))
        for rank, (*_, path) in enumerate(sorted(branches)[:top], 1):
            out[conv, rank] = [nodes[m][1:3] for m in path]
    return out


def read_back(found) -> dict:
    rows = found.select("conv_id", "rank", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    return {(r["conv_id"], r["rank"]): ([(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in rows}


@pytest.mark.parametrize("top", [1, 3])
def test_trees_equal_brute_force(spark, top):
    random.seed(top)
    texts = ["", None, "a", "</turn>", "### user: x", "\\", "\\l/turn>", "é😀\n", "a: b", "\\\\h</turn>###"]
    rows = []
    for conv in range(30):
        n = random.randint(1, 14)
        for m in range(n):
            # whole scores tie often; some parents are missing, some reply to themselves or in a circle
            p = random.choice([None, 99, *range(m)] if m else [None, 99]) if conv % 5 else random.randrange(n)
            rows.append((conv, m, p, random.choice(["user", "assistant", "a:b", None]), random.choice(texts), float(random.randint(0, 2)) if random.random() < 0.8 else None, "clash"))
    want = brute_paths(rows, top)
    found = read_back(chat.format_trees(spark.createDataFrame(rows, SCHEMA), score="score", top=top))
    assert {k: v[0] for k, v in found.items()} == want
    for k, turns in want.items():
        assert found[k][1] == "".join(t for r, t in turns if r == "assistant")


def test_edge_rows(spark):
    rows = [
        (None, 1, None, "user", "q", 0.0, ""), (None, 2, 1, "assistant", "r", 0.0, ""),  # a null conversation
        (1, None, None, "user", "without an id", 0.0, ""),
        (2, 1, None, "user", "b", 0.0, ""), (2, 1, None, "user", "b", 0.0, ""), (2, 1, None, "assistant", "a", 0.0, ""),  # a repeated id: the smallest stays, once
        (3, 1, 1, "user", "replies to itself", 0.0, ""),
        (4, 1, None, "assistant", "x" * 1_000_000, 0.0, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = read_back(chat.format_trees(df))
    assert found[None, 1] == ([("user", "q"), ("assistant", "r")], "r")
    assert found[2, 1][0] == [("assistant", "a")]
    assert found[4, 1][1] == "x" * 1_000_000
    assert set(found) == {(None, 1), (2, 1), (4, 1)}
    assert chat.format_trees(df.limit(0)).count() == 0


def test_a_cycle_ends_at_once(spark):
    rows = [(1, 1, 2, "user", "a", 0.0, ""), (1, 2, 1, "user", "b", 0.0, ""), (1, 3, 2, "user", "c", 0.0, ""), (1, 4, None, "user", "d", 0.0, ""), (1, 5, 4, "user", "e", 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    began = time.time()
    assert read_back(chat.format_trees(df))[1, 1][0] == [("user", "d"), ("user", "e")]
    assert time.time() - began < 30


def test_query_equals_its_sql(spark, tmp_path):
    """Ties, repeated rows, nulls, long conversations that several tasks put in order."""
    random.seed(4)
    rows = [(1, i, random.choice(["user", "assistant"]), f"t{i}") for i in range(9_000)]
    rows += [(2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (2, 0, None, None), (2, None, "assistant", "no turn"), (None, 3, "assistant", None), (None, 3, "user", "x"), (5, -9000, "assistant", ""), (5, 9000, "assistant", "### \\")]
    random.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = chat.op2_chat(spark, str(tmp_path))
    columns = sorted(out.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {tuple(r) for r in out.select(*columns).collect()} == set(con.sql(chat.ORACLE).project(", ".join(columns)).fetchall())
