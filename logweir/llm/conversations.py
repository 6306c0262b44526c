"""Repair of conversations by cheapest edits: auction prices over the lattice of edits, tight arcs traced in ASCII order."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm import lattice
from logweir.llm.scratch import written

# Messages of a conversation up to which one task's row holds it whole; longer ones are cut into chunks of as many.
CHUNK_BITS = 6
CHUNK = 1 << CHUNK_BITS
# Chunks, or blocks of chunks, that are put together at a time.
SPAN_BITS = 8
_FILLED = re.compile(r"[^\x20\x09-\x0D]")
_SEPARATORS = " \t\n\x0b\x0c\r"
# Letters are s, u, a, any other or none at all, and, before the first message, nothing.
_OTHER, _NOTHING = 3, 4
_LEGAL = {(0, 1), (1, 2), (2, 1), *((_NOTHING, k) for k in range(4))}
_BEGIN = (lattice.START, _NOTHING)
_ROLES = {lattice.USER: "user", lattice.ASSISTANT: "assistant"}
_MESSAGE = "array<struct<turn: long, role: string, text: string, times: long, seen: boolean>>"
_PART = ("blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
         "repaired array<struct<edit: string, turn: long, role: string, text: string>>")


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with faults: columns of these names and ``copies``.

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row (copies 0), 1 empties its text, 2 takes .!? out of it,
    3 repeats it (copies 2), 4 makes its role user. Null roles and texts, and nulls in the key, are one space.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"))


def _judged(messages: list[dict], before: int = _NOTHING) -> tuple[list[tuple[int, int, int]], list[dict], dict]:
    """(lattice messages, the message each stands for, counts), after a message with the letter ``before``.

    Copies after the first are one message to delete.
    """
    listed, sources = [], []
    counts = dict(blank=0, duplicate=0, truncated=0, illegal=0)
    known: set[tuple[str, str]] = set()
    for m in messages:
        role, text, times = m["role"], m["text"], m["times"]
        letter = {"s": 0, "u": 1, "a": 2}.get(role[:1], _OTHER)
        counts["illegal"] += ((before, letter) not in _LEGAL) + times - 1
        before = letter
        seen = (role, text) in known if m["seen"] is None else m["seen"]
        known.add((role, text))
        if not _FILLED.search(text):
            counts["blank"] += times
            listed.append((lattice.MUST_GO, letter, times))
        elif seen:
            counts["duplicate"] += times
            listed.append((lattice.MUST_GO, letter, times))
        else:
            cut = text.rstrip(_SEPARATORS)[-1] not in ".!?"
            counts["truncated"] += cut
            listed.append((lattice.TRUNCATED if cut else lattice.FINE, letter, 1))
            if times > 1:
                sources.append(m)
                counts["duplicate"] += times - 1
                listed.append((lattice.MUST_GO, letter, times - 1))
        sources.append(m)
    return listed, sources, counts


def _edited(steps: list[tuple[int, int, int]], listed: list, sources: list[dict]) -> tuple[str, list[dict]]:
    """(audit, messages after the edits; deleted ones are left out)."""
    audit, kept = [], []
    for arc, k, node in steps:
        label = lattice.LABELS[arc]
        audit.append(label * (listed[k][2] if label == "D" else 1))
        if label == "I":
            kept.append({"edit": label, "turn": None, "role": _ROLES[node], "text": ""})
        elif label != "D":
            role = _ROLES[node] if label == "R" else sources[k]["role"]
            kept.append({"edit": label, "turn": sources[k]["turn"], "role": role, "text": sources[k]["text"]})
    return "".join(audit), kept


def _alike(lengths: list[int]) -> Iterator[list[int]]:
    """Positions in blocks of similar length, so that padding stays small."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    for lo in range(0, len(order), 512):
        yield order[lo: lo + 512]


def _repaired(batches: Iterator[pa.RecordBatch], carried: bool) -> Iterator[pa.RecordBatch]:
    """Parts: conversations or chunks with their edits. ``carried`` parts know the costs that follow, their first node and the letter before."""
    kind = pa.list_(pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        count = batch.num_rows
        ends = np.array(batch.column("ends").to_pylist() if carried else [lattice.WHOLE] * count, np.int64).reshape(-1, 4)
        given = batch.column("start").to_pylist() if carried else [_BEGIN] * count
        starts = np.array([node for node, _ in given], np.int64)
        judged = [_judged(x, before) for x, (_, before) in zip(batch.column("messages").to_pylist(), given)]
        out: list[dict] = [{}] * len(judged)
        for own in _alike([len(x[0]) for x in judged]):
            settled = lattice.Lattices([judged[k][0] for k in own], ends[own])
            settled.run(starts[own])
            for k, (cost, _, steps) in zip(own, settled.trace(starts[own])):
                audit, kept = _edited(steps, *judged[k][:2])
                out[k] = {**judged[k][2], "cost": cost, "audit": audit, "repaired": kept}
        names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        types = [pa.int64()] * 5 + [pa.string()]
        keys = [c for c in ("conv_id", "part") if c in batch.schema.names]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keys), *(pa.array([x[n] for x in out], t) for n, t in zip(names, types)),
             pa.array([x["repaired"] for x in out], kind)], names=[*keys, *names, "repaired"])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks as 4 x 4 least costs between the nodes before and after them."""
    for batch in batches:
        lists = [_judged(x)[0] for x in batch.column("messages").to_pylist()]
        found = np.full((len(lists), 16), lattice.CLOSED, np.int64)
        for own in _alike([len(x) for x in lists]):
            found[own] = lattice.distances([lists[k] for k in own]).reshape(-1, 16)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(found.tolist(), pa.list_(pa.int64()))],
                                         names=["conv_id", "part", "element"])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node a chunk may begin in, the node that its first cheapest path ends in; then the letter of its last message."""
    for batch in batches:
        lists = [_judged(x)[0] for x in batch.column("messages").to_pylist()]
        ends = np.array(batch.column("ends").to_pylist(), np.int64).reshape(-1, 4)
        last = np.array([[0] * 4 + [x[-1][1]] for x in lists], np.int64).reshape(-1, 5)
        for own in _alike([len(x) for x in lists]):
            for node in range(4):
                starts = np.full(len(own), node)
                settled = lattice.Lattices([lists[k] for k in own], ends[own])
                settled.run(starts)
                last[own, node] = [end for _, end, _ in settled.trace(starts)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(last.tolist(), pa.list_(pa.int64()))],
                                         names=["conv_id", "part", "element"])


def _costs_joined(a: list[int], b: list[int]) -> list[int]:
    x, y = np.reshape(a, (4, 4)), np.reshape(b, (4, 4))
    return np.minimum((x[:, :, None] + y[None]).min(axis=1), lattice.CLOSED).ravel().tolist()


def _costs_before(element: list[int], after: list[int]) -> list[int]:
    return np.minimum((np.reshape(element, (4, 4)) + np.array(after)).min(axis=1), lattice.CLOSED).tolist()


def _nodes_joined(a: list[int], b: list[int]) -> list[int]:
    return [*(b[k] for k in a[:4]), b[4]]


def _node_after(element: list[int], before: list[int]) -> list[int]:
    return [element[before[0]], element[4]]


def _joined_block(rows: pd.DataFrame, join) -> pd.DataFrame:
    rows = rows.sort_values("part")
    total = list(rows["element"].iloc[0])
    for element in rows["element"].iloc[1:]:
        total = join(total, list(element))
    return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "part": rows["block"].iloc[:1], "element": [total]})


def _spread_block(rows: pd.DataFrame, step, backwards: bool) -> pd.DataFrame:
    rows = rows.sort_values("part", ascending=not backwards)
    value, out = list(rows["given"].iloc[0]), []
    for element in rows["element"]:
        out.append(value)
        value = step(list(element), value)
    return pd.DataFrame({"conv_id": rows["conv_id"], "part": rows["part"], "given": out})


def _carried(elements: DataFrame, first: tuple[int, ...], join, step, backwards: bool) -> DataFrame:
    """(conv_id, part, given): what reaches each part from the parts after it (``backwards``) or before it.

    Blocks of parts next to each other are put together, and blocks of blocks, until a conversation has few; then values go down
    again. No task ever has more than ``1 << SPAN_BITS`` parts of a conversation at a time.
    """
    key = elements.schema["conv_id"].dataType.simpleString()
    levels = [written(elements, "elements")]
    block = F.shiftright("part", SPAN_BITS).alias("block")

    def most() -> int:
        return levels[-1].groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    while most() > 1 << SPAN_BITS:
        up = levels[-1].select("*", block).groupBy("conv_id", "block").applyInPandas(
            lambda rows: _joined_block(rows, join), f"conv_id {key}, part long, element array<long>")
        levels.append(written(up, "elements"))
    schema = f"conv_id {key}, part long, given array<long>"

    def spread(rows):
        return _spread_block(rows, step, backwards)
    top = levels.pop().withColumn("given", F.array(*[F.lit(x).cast("long") for x in first]))
    given = written(top.groupBy("conv_id").applyInPandas(spread, schema), "carried")
    while levels:
        above = given.select(F.col("conv_id").alias("above_id"), F.col("part").alias("above"), "given")
        rows = levels.pop().select("*", block)
        rows = rows.join(above, rows["conv_id"].eqNullSafe(F.col("above_id")) & (F.col("block") == F.col("above")))
        given = written(rows.groupBy("conv_id", "block").applyInPandas(spread, schema), "carried")
    return given


def _with_given(chunks: DataFrame, given: DataFrame, name: str) -> DataFrame:
    own = given.select(F.col("conv_id").alias("own_id"), F.col("part").alias("own_part"), F.col("given").alias(name))
    return chunks.join(own, chunks["conv_id"].eqNullSafe(F.col("own_id")) & (F.col("part") == F.col("own_part"))).drop("own_id", "own_part")


def _long_parts(rows: DataFrame, key: str) -> DataFrame:
    """Parts of conversations of any length: equal messages counted, the rest cut into chunks of the sorted table."""
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("times"))
    alike = written(alike.withColumn("text_key", F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))), "messages")
    turn = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = (alike.groupBy("conv_id", "text_key").agg(F.min(turn).alias("first_turn"), F.count("*").alias("n"))
              .where("n > 1").select(F.col("conv_id").alias("own_id"), F.col("text_key").alias("own_key"), "first_turn"))
    marked = alike.join(firsts, F.col("conv_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")), "left")
    seen = F.coalesce(turn > F.col("first_turn"), F.lit(False))
    order = ["conv_id", "turn", "role", "text"]
    sorted_rows = marked.select(*order, "times", seen.alias("seen")).repartitionByRange(*order).sortWithinPartitions(*order)
    # Ids rise in the order of the table; a chunk is a run of ids.
    numbered = written(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "sorted")
    message = F.struct("at", *order[1:], "times", "seen")
    chunks = (numbered.groupBy("conv_id", F.shiftright("at", CHUNK_BITS).alias("part"))
              .agg(F.transform(F.array_sort(F.collect_list(message)), lambda m: m.dropFields("at")).alias("messages")))
    chunks = written(chunks, "chunks")
    costs = chunks.mapInArrow(_measured, f"conv_id {key}, part long, element array<long>")
    chunks = _with_given(chunks, _carried(costs, lattice.WHOLE, _costs_joined, _costs_before, True), "ends")
    last = chunks.mapInArrow(_ended, f"conv_id {key}, part long, element array<long>")
    chunks = _with_given(chunks, _carried(last, _BEGIN, _nodes_joined, _node_after, False), "start")
    return chunks.mapInArrow(partial(_repaired, carried=True), f"conv_id {key}, part long, {_PART}")


def repair_parts(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """(conv_id, part, counts, cost, audit, repaired): each conversation's cheapest edits, in parts by order of ``part``.

    ``rows`` has conv_id, turn, role, text and ``copies``: how many times the row stands, 0 for a row that only says that
    the conversation exists. Rows are taken by turn, nulls first, then role and text. Messages
    with nothing but separators, or with role and text as before, must go (2 each); the others are kept, given the role
    user or assistant (1), deleted (2), and pay 5 when they stay without an end mark; an empty message of either role costs 5.
    What is left is empty or an optional message of a role with s, then roles with u and a in turn, ending in a; an
    empty role has no letter and cannot stay. Of the cheapest edits those with the ASCII-least ``audit`` are taken.
    ``repaired`` are the messages left: edit, turn, role, text. blank, duplicate, truncated count first faults, illegal
    neighbours whose letters are not su, ua or au.

    A conversation of up to ``most`` rows is one part with part null. Of longer ones equal messages are counted first; the rest is sorted,
    cut into chunks, and each chunk's costs from node to node are put together along the conversation, so that every
    chunk knows the prices behind it and the node it begins in. No task holds a long conversation. Null ids are a
    conversation; nulls in role and text read as one space; other columns are ignored; an empty table gives no rows.
    """
    key = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], "copies")
    many = rows.groupBy("conv_id").agg(F.count_if(F.col("copies") > 0).alias("n")).where(F.col("n") > most)
    many = written(many.select(F.col("conv_id").alias("long_id")), "long")
    short, long_ = rows, None
    if not many.isEmpty():
        short = rows.join(many, rows["conv_id"].eqNullSafe(F.col("long_id")), "left_anti")
        long_ = rows.where("copies > 0").join(many, rows["conv_id"].eqNullSafe(F.col("long_id")), "left_semi")
    message = F.when(F.col("copies") > 0, F.struct("turn", "role", "text", F.col("copies").alias("times"), F.lit(None).cast("boolean").alias("seen")))
    whole = short.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).cast(_MESSAGE).alias("messages"))
    parts = whole.mapInArrow(partial(_repaired, carried=False), f"conv_id {key}, {_PART}").withColumn("part", F.lit(None).cast("long"))
    return parts if long_ is None else parts.unionByName(_long_parts(long_, key))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its parts in order; only the hash state and the audit are held."""
    key, audit, digest, empty, started = None, [], None, True, False

    def row(kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])],
                                          names=["conv_id", "audit", "repaired_sha256"])
    kind = pa.null()
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for own, edits, lines, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "lines", "n"))):
            if not started or own != key:
                if started:
                    yield row(kind)
                key, audit, digest, empty, started = own, [], hashlib.sha256(), True, True
            audit.append(edits)
            if n:
                digest.update(lines.encode() if empty else b"\n" + lines.encode())
                empty = False
    if started:
        yield row(kind)


def repaired_messages(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """(conv_id, part, place, edit, turn, role, text): the messages that ``repair_parts`` leaves, in order of part and place."""
    return repair_parts(rows, most).select("conv_id", "part", F.posexplode("repaired").alias("place", "m")).select("conv_id", "part", "place", "m.*")


def conversation_audit(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """One row per conversation of ``rows``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps are the turns missing between the least and the greatest, nulls left out. repaired_sha256 is of the repaired
    messages as ``role:text``, joined by newlines. A hash reads all text in order: that of a long conversation is made by one task from a stream.
    """
    key = rows.schema["conv_id"].dataType.simpleString()
    parts = written(repair_parts(rows, most), "parts")
    lines = F.array_join(F.transform("repaired", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    whole = parts.where("part IS NULL").select("conv_id", *counts, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    cut = parts.where("part IS NOT NULL")
    sums = cut.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts])
    digests = (cut.select("conv_id", "part", "audit", lines.alias("lines"), F.size("repaired").alias("n"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "part")
               .mapInArrow(_digests, f"conv_id {key}, audit string, repaired_sha256 string")
               .withColumnRenamed("conv_id", "own_id"))
    joined = sums.join(digests, sums["conv_id"].eqNullSafe(F.col("own_id"))).drop("own_id")
    repaired = whole.unionByName(joined)
    turns = (rows.where("copies > 0").select("conv_id", "turn").distinct().groupBy(F.col("conv_id").alias("turn_id"))
             .agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")))
    found = repaired.join(turns, repaired["conv_id"].eqNullSafe(F.col("turn_id")), "left")
    return found.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
                        "audit", "repaired_sha256")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """``conversation_audit`` of ``conversations`` after ``damage``."""
    return conversation_audit(damage(conversations))


# The query in DuckDB: faults by window functions, and for each conversation and message the best edits so far by kept letter.
# crc32 is worked out bit by bit.
REPAIRED_CONVERSATIONS_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
               string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::UBIGINT)),
             lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
               lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT) % 20 AS code
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE code <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final, left(role, 1) AS letter
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
         letter || lead(letter) OVER (PARTITION BY conv_id ORDER BY place) AS pair
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
), moves AS (
  SELECT * FROM (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')) t(state, after, name)
), best AS (
  SELECT conv_id, 0::BIGINT AS place, state, {'cost': cost, 'audit': audit, 'kept': kept} AS found
  FROM (SELECT DISTINCT conv_id FROM conversations),
       (VALUES ('', 0::BIGINT, '', []::VARCHAR[]), ('u', 5, 'I', ['user:']), ('a', 10, 'II', ['user:', 'assistant:'])) t(state, cost, audit, kept)
  UNION ALL
  SELECT conv_id, place, state, min(found) FROM (
    SELECT e.conv_id, e.place, CASE i.n WHEN 0 THEN e.state WHEN 1 THEN m.after ELSE o.after END AS state,
           {'cost': e.cost + 5 * i.n, 'audit': e.audit || repeat('I', i.n),
            'kept': e.kept || CASE i.n WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [m.name || ':'] ELSE [m.name || ':', o.name || ':'] END} AS found
    FROM (
      SELECT b.conv_id, j.place,
             CASE k.edit WHEN 'D' THEN b.state WHEN 'K' THEN j.letter ELSE m.after END AS state,
             b.found.cost + CASE k.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
               + CASE WHEN k.edit <> 'D' AND j.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
             b.found.audit || k.edit AS audit,
             b.found.kept || CASE k.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [m.name || ':' || j.text] END AS kept
      FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.place = b.place + 1
      JOIN moves m ON m.state = b.state, (VALUES ('D'), ('K'), ('R')) k(edit)
      WHERE k.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate') AND (k.edit = 'R' OR j.letter = m.after OR (j.letter = 's' AND b.state = ''))
    ) e JOIN moves m ON m.state = e.state JOIN moves o ON o.state = m.after, (VALUES (0), (1), (2)) i(n)
  ) GROUP BY conv_id, place, state
), ended AS (
  SELECT b.conv_id, min(b.found) AS found FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
  WHERE b.place = coalesce(c.n, 0) AND b.state IN ('', 'a') GROUP BY b.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.found.cost::BIGINT AS cost, e.found.audit AS audit,
       sha256(array_to_string(e.found.kept, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
