"""Conversation repair: every result by brute force, long conversations in chunks, odd rows, the whole query in plain Python."""
import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from logweir.llm import conversations

from conftest import SF_DIR

ROWS = "conv_id long, turn long, role string, text string, copies long, class string"


def cheapest(messages):
    """(cost, audit, repaired) of (role, text, fault) by trying all edits, for each suffix and kept letter."""
    @functools.cache
    def go(k, state, inserted):
        best = [(0, "", ())] if k == len(messages) and state in ("", "a") else []
        after = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[after]
        if k < len(messages):
            role, text, fault = messages[k]
            cost, audit, kept = go(k + 1, state, 0)
            best.append((cost + 2, "D" + audit, kept))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] == after or (role[:1] == "s" and state == ""):
                    cost, audit, kept = go(k + 1, role[:1], 0)
                    best.append((cost + more, "K" + audit, ((role, text), *kept)))
                cost, audit, kept = go(k + 1, after, 0)
                best.append((cost + more + 1, "R" + audit, ((name, text), *kept)))
        if inserted < 3:
            cost, audit, kept = go(k, after, inserted + 1)
            best.append((cost + 5, "I" + audit, ((name, ""), *kept)))
        return min(best) if best else (10 ** 6, "", ())
    return go(0, "", 0)


def expected(rows, damaged=True):
    """The result rows of (conv_id, turn, role, text[, copies])."""
    by = {}
    for row in rows:
        conv, turn, role, text = row[:4]
        own = by.setdefault(conv, [])
        role, text, n = " " if role is None else role, " " if text is None else text, 1 if damaged else row[4]
        if damaged:
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            n = {0: 0, 3: 2}.get(code, 1)
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            role = "user" if code == 4 else role
        own += [(turn, role, text)] * n
    out = []
    for conv, own in by.items():
        own.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), m[2].encode()))
        known, messages = set(), []
        for _, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in known else "" if words[-1] in ".!?" else "truncated"
            known.add((role, text))
            messages.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") or not a[0] for a, b in zip(messages, messages[1:]))
        cost, audit, kept = cheapest(tuple(messages))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        faults = [f for _, _, f in messages]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    out = []
    for conv in range(conversations):
        for _ in range(rng.randrange(1, most)):
            out.append((conv or None, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]),
                        rng.choice(["Yes.", "No?", "cut off", "", " \t", None, "Well! ", "é…", "Fine."]), rng.choice([0, 1, 1, 1, 2, 5]), "x"))
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_random_conversations(spark):
    rows = random_rows(1, 150, 9)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    assert found(conversations.conversation_audit(df)) == expected(rows, damaged=False)


@pytest.mark.parametrize("most", [0, 4])
def test_long_conversations_in_chunks(spark, monkeypatch, most):
    monkeypatch.setattr(conversations, "CHUNK_BITS", 1)
    monkeypatch.setattr(conversations, "SPAN_BITS", 1)
    rows = random_rows(2, 25, 14) + [(99, k // 3, ("user", "assistant")[k % 2], "Again." if k % 5 else f"Text {k}", 1 + k % 2, "x") for k in range(40)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    assert found(conversations.conversation_audit(df, most)) == expected(rows, damaged=False)


def test_one_message_many_times(spark):
    rows = [(1, 1, "user", "Hello.", 1, "x")] + [(1, 2, "assistant", "Again.", 1, "x")] * 500
    got = conversations.conversation_audit(spark.createDataFrame(rows, ROWS)).first()
    assert (got.cost, got.audit, got.duplicate, got.illegal) == (2 * 499, "KK" + "D" * 499, 499, 499)


def test_messages_left(spark):
    rows = [(1, 0, "assistant", "Hi.", 1, "x"), (1, 1, "user", "Really?", 1, "x"), (1, 2, "user", "And now?", 1, "x"), (1, 3, "assistant", "Yes.", 1, "x")]
    left = conversations.repaired_messages(spark.createDataFrame(rows, ROWS)).orderBy("place").collect()
    assert [(r.edit, r.turn, r.role, r.text) for r in left] == [("R", 0, "user", "Hi."), ("R", 1, "assistant", "Really?"),
                                                                ("K", 2, "user", "And now?"), ("K", 3, "assistant", "Yes.")]


def test_query_and_empty_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert found(conversations.repaired_conversations(table.withColumn("copies", F.lit("x")))) == expected(rows)
    assert found(conversations.repaired_conversations(table.limit(0))) == []
