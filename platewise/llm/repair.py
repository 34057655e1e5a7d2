"""Conversation structure repair: the cheapest edits that make roles alternate and drop faulty turns.

The edit lattice of a conversation has a node for each (turns read, role structure so far) and an edge for each edit: keep, re-role, delete, insert. The cheapest way
through it is found by a bidirectional Dijkstra search: a forward and a reverse heap settle nodes by cost; where an edge joins a settled node of one to a settled node of the other
the two meet; when no cheaper or equally cheap crossing can be left, the crossing with the least concatenated audit wins.

Turns are dealt by ranges of (conversation, turn), so a conversation may lie in several tasks. Each task cuts it into segments of bounded size. A
conversation of one segment is searched at once; otherwise each segment is searched from every structure that it may begin with to every structure that it may end with, and a second
search of the same kind goes over the segments. Equal audits can't have different ends, and a segment ends with an edit of a turn, so audits of a segment are compared by their rank alone.
Only the digest of the repaired conversation, which is sequential by nature, reads a conversation's segments one after another, without holding them.

Defined results: a null conv_id is a conversation of its own; null turns come first; turns of equal number are ordered by role and the MD5 of role and text; equal rows
are duplicates of the first; empty and very long texts are texts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, source_partitions

#: Turns and bytes of text of a segment.
SEGMENT, SEGMENT_BYTES = 1024, 4 << 20
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Role structures: nothing yet, a system turn, a user turn last, an assistant turn last. What a role's initial leads to, and what a written role leads to.
_KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_WRITES = (2, 2, 3, 2)
_ENDS = (0, 3)
_ROLES = ("user", "user", "assistant", "user")


def damaged(conversations: DataFrame) -> DataFrame:
    """``key, conv_id, turn, role, text, kept`` with the damage done; ``key`` tells conversations apart; rows that are dropped stay as ``kept`` false."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.regexp_replace(known("text"), r"[.!?]", "")).otherwise(known("text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", harm.alias("harm"))
    rows = rows.select(key.alias("key"), "conv_id", "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(known("role")).alias("role"), text.alias("text"), "harm")
    times = F.when(F.col("harm") == 3, 2).otherwise(1)
    return rows.withColumn("time", F.explode(F.array_repeat(F.lit(0), times))).select("key", "conv_id", "turn", "role", "text", (F.col("harm") != 0).alias("kept"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``digest`` of role and text, and ``fault``: blank (b), truncated (t) or none (-), and ``later``: the same stands at an earlier turn."""
    rows = rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "b").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise("-")
    )
    seen = rows.groupBy("key", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return rows.join(seen, ["key", "digest"], "left").select("key", "conv_id", "turn", "role", "text", "digest", fault.alias("fault"), later.alias("later"))


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """``key, part, initials, faults, roles, texts``: turns in order, ``part`` orders the segments of a conversation."""
    order = ["key", "turn", "role", "digest"]
    rows = rows.select(*order, "text", "fault", "later").repartitionByRange(source_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    schema = pa.schema([("key", pa.string()), ("part", pa.int64()), ("initials", pa.string()), ("faults", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        before, key, roles, texts, marks, size, out = None, None, [], [], [], 0, []

        def closed():
            nonlocal part, size
            out.append((key, part, "".join(r[:1] or " " for r in roles), "".join(marks), list(roles), list(texts)))
            part, size = part + 1, 0
            for x in (roles, texts, marks):
                x.clear()

        for b in batches:
            for k, turn, role, digest, text, fault, later in zip(*(b.column(i).to_pylist() for i in range(7))):
                if roles and (k != key or len(roles) >= most or size >= SEGMENT_BYTES):
                    closed()
                    if sum(len(x[4]) for x in out) >= most:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)
                        out.clear()
                now = (k, turn, digest)
                marks.append("d" if fault != "b" and (later or now == before) else fault)
                key, before = k, now
                roles.append(role)
                texts.append(text)
                size += len(text)
        if roles:
            closed()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)

    return rows.mapInArrow(run, "key string, part long, initials string, faults string, roles array<string>, texts array<string>")


def cheapest(source: int, target: int, out, into):
    """``(cost, audit)`` of the cheapest way from ``source`` to ``target``, the least audit of those; None if there is none.

    ``out`` and ``into`` give ``(label, cost, node)`` of the edges that leave or reach a node. Edges without cost lead to larger nodes, and no two
    edges that leave a node have the same label.
    """
    best, heaps, done = ({source: (0, "")}, {target: (0, "")}), ([(0, source)], [(0, -target)]), (set(), set())
    found, turn = None, 0
    far = (float("inf"),)
    while heaps[0] or heaps[1]:
        tops = [(h[0] if h else far)[0] for h in heaps]
        if found and tops[0] + tops[1] > found[0]:
            break
        # each heap settles its own end first; then the cheaper one goes on
        side = turn if turn < 2 else int(tops[1] < tops[0])
        turn += 1
        cost, node = heappop(heaps[side])
        node = -node if side else node
        if node in done[side] or cost > best[side][node][0]:
            continue
        done[side].add(node)
        audit, own, other = best[side][node][1], best[side], best[1 - side]
        for label, price, v in (into if side else out)(node):
            now = (cost + price, label + audit if side else audit + label)
            if v in done[1 - side]:
                rest = other[v]
                way = (now[0] + rest[0], rest[1] + now[1] if side else now[1] + rest[1])
                found = min(found, way) if found else way
            if v not in done[side] and (v not in own or now < own[v]):
                if v not in own or now[0] < own[v][0]:
                    heappush(heaps[side], (now[0], -v if side else v))
                own[v] = now
    return found


class Lattice:
    """The edit lattice of one segment; ``last``: nothing follows, so roles may be inserted at its end."""

    def __init__(self, initials: str, marks: str, last: bool):
        self.initials, self.marks, self.last, self.n = initials, marks, last, len(initials)
        self.end = 4 * (self.n + 1)

    def out(self, node: int):
        i, q = divmod(node, 4)
        if i > self.n:
            return
        if i < self.n:
            yield "D", DELETE, node + 4
            mark = self.marks[i]
            if mark not in "bd":
                more = TRUNCATED if mark == "t" else 0
                kept = _KEEPS[q].get(self.initials[i])
                if kept is not None:
                    yield "K", more, 4 * i + 4 + kept
                yield "R", REROLE + more, 4 * i + 4 + _WRITES[q]
        if i < self.n or self.last:
            yield "I", INSERT, 4 * i + _WRITES[q]
        if i == self.n and self.last and q in _ENDS:
            yield "", 0, self.end

    def into(self, node: int):
        i, q = divmod(node, 4)
        if i > self.n:
            for e in _ENDS:
                yield "", 0, 4 * self.n + e
            return
        if i:
            yield "D", DELETE, node - 4
            mark = self.marks[i - 1]
            if mark not in "bd":
                more = TRUNCATED if mark == "t" else 0
                for p in range(4):
                    if _KEEPS[p].get(self.initials[i - 1]) == q:
                        yield "K", more, 4 * i - 4 + p
                    if _WRITES[p] == q:
                        yield "R", REROLE + more, 4 * i - 4 + p
        if i < self.n or self.last:
            for p in range(4):
                if _WRITES[p] == q:
                    yield "I", INSERT, 4 * i + p

    def way(self, entry: int, leave: int):
        """From structure ``entry`` to structure ``leave`` (4: any that may end a conversation)."""
        return cheapest(entry, self.end if leave == 4 else 4 * self.n + leave, self.out, self.into)


def ways(parts: DataFrame) -> DataFrame:
    """``key, part, whole, entry, leave, cost, audit, place``: the cheapest way of each segment between two structures, and the audit's rank among those of one entry.

    ``parts`` has ``key, part, initials, faults, first, last``, the latter the conversation's first and last ``part``.
    """
    schema = pa.schema([("key", pa.string()), ("part", pa.int64()), ("whole", pa.bool_()), ("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("place", pa.int32())])

    def run(batches):
        for b in batches:
            out = []
            for key, part, initials, marks, first, last in zip(*(b.column(i).to_pylist() for i in range(6))):
                lattice = Lattice(initials, marks, part == last)
                for entry in (0,) if part == first else range(4):
                    found = {leave: way for leave in ((4,) if part == last else range(4)) if (way := lattice.way(entry, leave))}
                    place = {audit: k for k, audit in enumerate(sorted(audit for _, audit in found.values()))}
                    out += [(key, part, first == last, entry, leave, cost, audit, place[audit]) for leave, (cost, audit) in found.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)

    columns = parts.select("key", "part", "initials", "faults", "first", "last")
    return columns.mapInArrow(run, "key string, part long, whole boolean, entry int, leave int, cost long, audit string, place int")


def chosen(found: DataFrame) -> DataFrame:
    """``key, part, entry, leave`` of the segments' ways that make up the cheapest way of each conversation of several segments."""

    def search(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("part", "entry", "leave", "cost", "place"))))
        layer = {part: k for k, part in enumerate(sorted({r[0] for r in rows}))}
        out, into, taken = {}, {}, {}
        for part, entry, leave, cost, place in rows:
            a, z, label = 4 * layer[part] + entry, 4 * (layer[part] + 1) + leave % 4, chr(48 + place)
            out.setdefault(a, []).append((label, cost, z))
            into.setdefault(z, []).append((label, cost, a))
            taken[a, label] = (part, entry, leave, z)
        _, audit = cheapest(0, 4 * len(layer), lambda v: out.get(v, ()), lambda v: into.get(v, ()))
        node, steps = 0, []
        for label in audit:
            part, entry, leave, node = taken[node, label]
            steps.append({"key": t.column("key")[0].as_py(), "part": part, "entry": entry, "leave": leave})
        return pa.Table.from_pylist(steps, pa.schema([("key", pa.string()), ("part", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32())]))

    return found.filter("not whole").select("key", "part", "entry", "leave", "cost", "place").groupBy("key").applyInArrow(search, "key string, part long, entry int, leave int")


def repaired_lines(audit: str, entry: int, roles: list[str], texts: list[str]):
    """``role:text`` of a segment's turns after the edits."""
    q, at = entry, 0
    for step in audit:
        if step == "I":
            yield f"{_ROLES[q]}:"
            q = _WRITES[q]
            continue
        if step == "K":
            yield f"{roles[at]}:{texts[at]}"
            q = _KEEPS[q][roles[at][:1]]
        elif step == "R":
            yield f"{_ROLES[q]}:{texts[at]}"
            q = _WRITES[q]
        at += 1


def rebuilt(parts: DataFrame, steps: DataFrame) -> DataFrame:
    """Per ``key`` the numbers of faults, the cost, the audit and the digest. ``steps``: ``key, part, entry, cost, audit`` of every segment."""
    steps = steps.select("key", "part", F.lit(0).alias("kind"), "entry", "cost", "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("initials", "string"), ("faults", "string"), ("roles", "array<string>"), ("texts", "array<string>"))])
    none = [F.lit(None).cast(t).alias(c) for c, t in (("entry", "int"), ("cost", "long"), ("audit", "string"))]
    both = steps.unionAll(parts.select("key", "part", F.lit(1).alias("kind"), *none, "initials", "faults", "roles", "texts"))
    both = both.repartition("key").sortWithinPartitions("key", "part", "kind")
    schema = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        key, counts, audits, digest, started, before, step, out = None, [0] * 5, [], hashlib.sha256(), False, "", None, []
        for b in batches:
            for k, kind, entry, cost, audit, initials, marks, roles, texts in zip(*(b.column(c).to_pylist() for c in ("key", "kind", "entry", "cost", "audit", "initials", "faults", "roles", "texts"))):
                if k != key:
                    if key is not None:
                        out.append((key, *counts, "".join(audits), digest.hexdigest()))
                    key, counts, audits, digest, started, before = k, [0] * 5, [], hashlib.sha256(), False, ""
                if kind == 0:
                    step = (audit, entry)
                    counts[4] += cost
                    audits.append(audit)
                    continue
                for n, mark in enumerate("bdt"):
                    counts[n] += marks.count(mark)
                near = before + initials
                counts[3] += sum(near[i : i + 2] not in ("su", "ua", "au") for i in range(len(near) - 1))
                before = initials[-1]
                for line in repaired_lines(*step, roles, texts):
                    digest.update((("\n" if started else "") + line).encode())
                    started = True
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)
                out = []
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (key, *counts, "".join(audits), digest.hexdigest())))], schema)

    return both.mapInArrow(run, "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _gaps(rows: DataFrame) -> DataFrame:
    """``key, conv_id, gaps`` of every conversation, over the turns that are kept."""
    turn = F.when(F.col("kept"), F.col("turn"))
    turns = rows.select("key", "conv_id", turn.alias("turn")).distinct()
    missing = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.coalesce(missing, F.lit(0)).alias("gaps"))


def repair(conversations: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Damages ``conversations`` and repairs them: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    rows = damaged(conversations)
    found = repair_turns(rows.filter("kept"), most)
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return _gaps(rows).join(found, "key", "left").select("conv_id", "gaps", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def repair_turns(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Per ``key`` the faults, cost, audit and digest of turns ``key, conv_id, turn, role, text``."""
    made: list[str] = []
    parts = materialise(segments(faults(rows), most), "segments", made)
    ends = parts.groupBy("key").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    found = materialise(ways(parts.select("key", "part", "initials", "faults").join(ends, "key")), "ways", made)
    steps = found.filter("whole").select("key", "part", "entry", "cost", "audit")
    several = found.join(chosen(found), ["key", "part", "entry", "leave"]).select("key", "part", "entry", "cost", "audit")
    done = materialise(rebuilt(parts, steps.unionAll(several)), "repaired")
    discard(rows.sparkSession, made)
    return done


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
