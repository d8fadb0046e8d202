"""Repair of conversation structure by cheapest edits (operator 11).

A conversation is a path of rows; the edits that may happen to them span a lattice
of (rows consumed, state of the role pattern ``(s?(ua)+)?``).  The cheapest path is
found by bidirectional Dijkstra: a forward and a reverse heap meet, all crossings of
least cost are finished, and the least concatenated audit is taken.

Order of rows: turn (nulls first), then role, then text by code point, so that rows
of one turn have one order and equal rows are exchangeable.  Conversations are cut into
segments of ``SEGMENT`` rows; the least paths between all pattern states at a segment's
ends are found for all segments apart and then joined in order, which gives the same
path, since two audits of equal cost between the same two nodes are never prefixes of
each other.  Texts are sorted by Spark and streamed; what a task holds is a segment's
lattice and one letter per row and end state of the conversation it is joining.

Defined results: null conv_ids are one conversation; null roles and texts are one
space (so roles without a legal initial, blank texts); empty roles have no initial;
repeated rows are duplicates; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from inkwell.llm.common import SPACES, stored, table

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a segment.
SEGMENT = 512

#: States of the pattern: nothing yet, after s, after u, after a; the next state by initial.
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role that an inserted or changed row takes in a state, and the state after it.
WANTED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
KEY = "conv_id long"


def _row_moves(code: str) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, letter) of the edits of a row.

    Codes: d must be deleted; s, u, a or x (any other initial), a capital if truncated.
    """
    moves = [(q, q, DELETE, "D") for q in range(4)]
    if code != "d":
        more = TRUNCATED if code.isupper() else 0
        moves += [(q, to, KEEP + more, "K") for q, to in NEXT.get(code.lower(), {}).items()]
        moves += [(q, to, REROLE + more, "R") for q, (_, to) in WANTED.items()]
    return moves


MOVES = {code: _row_moves(code) for code in "dsuaxSUAX"}
INSERTS = [(q, to, INSERT, "I") for q, (_, to) in WANTED.items()]


@lru_cache(maxsize=1 << 16)
def cheapest(codes: str, start: int = START, goals: tuple[int, ...] = GOALS) -> tuple[int, str] | None:
    """Least (cost, audit) from a state before the rows to one of some states after them, or None.

    Nodes are (rows consumed, state).  Both searches settle nodes by cost, then in
    the order in which edits without cost lead on, so a settled node's audit is the
    least of its cost.  The searches go on until no open path can cost as little as
    the best crossing; then all edges between a node settled forward and one settled
    in reverse are candidates.
    """
    n = len(codes)
    ahead = [[[] for _ in range(4)] for _ in range(n + 1)]
    behind = [[[] for _ in range(4)] for _ in range(n + 1)]
    for i in range(n + 1):
        for step, moves in ((0, INSERTS), (1, MOVES[codes[i]] if i < n else ())):
            for q, to, cost, letter in moves:
                ahead[i][q].append((i + step, to, cost, letter))
                behind[i + step][to].append((i, q, cost, letter))

    first = {(0, start): (0, "")}
    last = {(n, q): (0, "") for q in goals}
    open_f = [(0, 0, start)]
    open_r = [(0, 0, q) for q in goals]
    done_f, done_r = {}, {}
    best = None

    while open_f and open_r:
        if best is not None and open_f[0][0] + open_r[0][0] > best:
            break
        if open_f[0][0] <= open_r[0][0]:
            cost, i, q = heapq.heappop(open_f)
            node = (i, q)
            if node in done_f or first[node][0] < cost:
                continue
            audit = first[node][1]
            done_f[node] = cost, audit
            if node in done_r and (best is None or cost + done_r[node][0] < best):
                best = cost + done_r[node][0]
            for j, to, more, letter in ahead[i][q]:
                path, found = (cost + more, audit + letter), first.get((j, to))
                if found is None or path < found:
                    first[j, to] = path
                    heapq.heappush(open_f, (path[0], j, to))
                if (j, to) in done_r and (best is None or path[0] + done_r[j, to][0] < best):
                    best = path[0] + done_r[j, to][0]
        else:
            cost, back, q = heapq.heappop(open_r)
            i = n - back
            node = (i, q)
            if node in done_r or last[node][0] < cost:
                continue
            audit = last[node][1]
            done_r[node] = cost, audit
            if node in done_f and (best is None or cost + done_f[node][0] < best):
                best = cost + done_f[node][0]
            for j, before, more, letter in behind[i][q]:
                path, found = (cost + more, letter + audit), last.get((j, before))
                if found is None or path < found:
                    last[j, before] = path
                    heapq.heappush(open_r, (path[0], n - j, before))
                if (j, before) in done_f and (best is None or path[0] + done_f[j, before][0] < best):
                    best = path[0] + done_f[j, before][0]
    if not open_f:  # the forward search has settled all that it can reach
        return min((done_f[n, q] for q in goals if (n, q) in done_f), default=None)
    if not open_r:
        return done_r.get((0, start))
    crossings = [audit + done_r[node][1] for node, (cost, audit) in done_f.items() if node in done_r and cost + done_r[node][0] == best]
    for (i, q), (cost, audit) in done_f.items():
        for j, to, more, letter in ahead[i][q]:
            if (j, to) in done_r and cost + more + done_r[j, to][0] == best:
                crossings.append(audit + letter + done_r[j, to][1])
    return best, min(crossings)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the contract's faults, chosen by crc32 of ``conv_id:turn`` (null: one space) modulo 20.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role user.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(named) % 20).alias("kind"))
        .where("kind <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )


def _initial() -> Column:
    return F.substring("role", 1, 1)


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row per conversation and segment: its faults counted, its turns, one code letter per row.

    ``rows`` have conv_id, turn, role and text, the last two without nulls.  They are
    dealt by conversation once; both windows and the grouping follow that, sorted with
    spilling, and nothing but the codes of a segment is collected.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("copy")]
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    path = Window.partitionBy("conv_id").orderBy(*order)
    pair = F.concat(F.lag(_initial()).over(path), _initial())
    placed = (
        rows.repartition("conv_id")
        .withColumn("copy", F.row_number().over(same))
        .select(
            "conv_id", "turn", F.row_number().over(path).alias("place"),
            F.when(bare == "", "blank").when(F.col("copy") > 1, "duplicate")
            .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").alias("fault"),
            F.when(_initial().isin("s", "u", "a"), _initial()).otherwise("x").alias("initial"),
            (F.row_number().over(path) > 1).cast("int").alias("second"), pair.isin("su", "ua", "au").alias("legal"),
            (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(path))).cast("long").alias("new_turn"),
        )
    )
    code = (
        F.when(F.col("fault").isin("blank", "duplicate"), "d")
        .when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    )
    count = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("long"))
    return placed.groupBy("conv_id", F.floor((F.col("place") - 1) / size).alias("segment")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", code.alias("code")))), lambda x: x["code"]), "").alias("codes"),
        *(count(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")),
        count((F.col("second") == 1) & ~F.col("legal")).alias("illegal"),
        F.min("turn").alias("least_turn"), F.max("turn").alias("most_turn"), F.sum("new_turn").alias("turns"),
    )


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_SEGMENT_FIELDS = f"{KEY}, segment long, {', '.join(f'{c} long' for c in _COUNTS)}, least_turn long, most_turn long"


def _segment_paths(batches):
    """The cheapest way through each segment for all states at its two ends."""
    for batch in batches:
        ways = []
        for codes, segment in zip(batch["codes"].to_pylist(), batch["segment"].to_pylist()):
            own = []
            for start in range(4) if segment else (START,):
                for goal in range(4):
                    path = cheapest(codes, start, (goal,))
                    if path:
                        own.append({"start": start, "goal": goal, "cost": path[0], "audit": path[1]})
            ways.append(own)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        kept = [name for name in batch.schema.names if name != "codes"]
        yield pa.RecordBatch.from_arrays([batch[name] for name in kept] + [pa.array(ways, kind)], kept + ["ways"])


def _joined(batches):
    """The segments of each conversation, which come in order, joined to one path and one row of counts."""

    def row(conv, paths, counts, least, most):
        cost, audit = min(paths[q] for q in GOALS if q in paths)
        gaps = 0 if least is None else most - least + 1 - counts["turns"]
        return {"conv_id": conv, "gaps": gaps if gaps < 1 << 63 else None, **{c: counts[c] for c in _COUNTS[:4]}, "cost": cost, "audit": audit}

    schema = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *((c, pa.int64()) for c in _COUNTS[:4]), ("cost", pa.int64()), ("audit", pa.string())])
    open_conv, paths = object(), None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if paths is None or r["conv_id"] != open_conv:
                if paths is not None:
                    rows.append(row(open_conv, paths, counts, least, most))
                open_conv, paths, counts, least, most = r["conv_id"], {START: (0, "")}, dict.fromkeys(_COUNTS, 0), None, None
            reached = {}
            for way in r["ways"]:
                if way["start"] in paths:
                    cost, audit = paths[way["start"]]
                    path = cost + way["cost"], audit + way["audit"]
                    if way["goal"] not in reached or path < reached[way["goal"]]:
                        reached[way["goal"]] = path
            paths = reached
            for c in _COUNTS:
                counts[c] += r[c]
            if r["least_turn"] is not None:
                least = r["least_turn"] if least is None else min(least, r["least_turn"])
                most = r["most_turn"] if most is None else max(most, r["most_turn"])
        yield pa.RecordBatch.from_pylist(rows, schema)
    if paths is not None:
        yield pa.RecordBatch.from_pylist([row(open_conv, paths, counts, least, most)], schema)


def plans(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation that has rows.

    ``gaps`` is null where it does not fit a long.
    """
    cut = stored(segments(rows, size).repartition("conv_id", "segment"), "segments")
    kept = [f for f in cut.schema.simpleString()[len("struct<"):-1].split(",") if not f.startswith("codes:")]
    ways = cut.mapInArrow(_segment_paths, ", ".join(kept) + ", ways array<struct<start int, goal int, cost long, audit string>>")
    dealt = ways.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return dealt.mapInArrow(_joined, f"{KEY}, gaps long, {', '.join(f'{c} long' for c in _COUNTS[:4])}, cost long, audit string")


def _applied(batches):
    """Rows of each conversation behind their audit, edited; deleted rows are left out."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def inserted(out):
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            role, state = WANTED[state]
            out.append((conv, place, "I", role, ""))
            at, place = at + 1, place + 1

    conv, audit, at, state, place = None, "", 0, START, 0
    for batch in batches:
        out = []
        columns = [batch[name].to_pylist() for name in ("conv_id", "kind", "role", "text")]
        for key, kind, role, text in zip(*columns):
            if kind == 0:
                conv, audit, at, state, place = key, text, 0, START, 0
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    if edit == "R":
                        role, state = WANTED[state]
                    else:
                        state = NEXT[role[0]][state]
                    out.append((conv, place, edit, role, text))
                    place += 1
            inserted(out)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 5, schema)], schema=schema)


def repaired_turns(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place from 0, edit (K, R or I), role and text.

    Every conversation's rows stream through one task in order, so that their digests can follow.
    """
    none = F.lit(None)
    marked = planned.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), F.col("audit").alias("text"))
    both = marked.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text"))
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(_applied, f"{KEY}, place long, edit string, role string, text string")


def _digested(batches):
    """SHA-256 of the ``role:text`` lines of each conversation, whose rows follow one another."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv, digest = None, None
    for batch in batches:
        out = []
        for key, place, role, text in zip(*(batch[name].to_pylist() for name in ("conv_id", "place", "role", "text"))):
            if place == 0:
                if digest is not None:
                    out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                conv, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema)


def repaired(original: DataFrame, rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row per conv_id of ``original``: faults, cost, audit and digest of the repair of its ``rows``."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    planned = stored(plans(rows, size), "plans")
    digests = repaired_turns(rows, planned).mapInArrow(_digested, f"{KEY}, repaired_sha256 string")
    ids = original.select(F.col("conv_id").alias("own_id")).distinct()
    found = planned.join(digests.withColumnRenamed("conv_id", "digest_id"), F.col("conv_id").eqNullSafe(F.col("digest_id")), "left")
    named = ids.join(found, F.col("own_id").eqNullSafe(F.col("conv_id")), "left")
    has_rows = F.col("audit").isNotNull()
    return named.select(
        F.col("own_id").alias("conv_id"),
        *(F.when(has_rows, F.col(c)).otherwise(0).alias(c) for c in ("gaps", *_COUNTS[:4], "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of the conversations table after the contract's damage."""
    rows = table(spark, sf_dir, "conversations")
    return repaired(rows, damaged(rows))


def _sql_more(label: str, cost: str, letter: str) -> str:
    """A label (nine digits of cost, then the audit) with one more edit."""
    return f"(lpad((left({label}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({label}, 10) || '{letter}')"


def _sql_least(own: str, before: tuple[str, ...], own_cost: str, letters: dict[str, str]) -> str:
    """The least label of a state after a row: deleted, changed, or kept where a test holds."""
    ways = [_sql_more(own, own_cost, "D")]
    ways += [f"CASE WHEN code <> 'd' THEN {_sql_more(x, '3 + more', 'R')} END" for x in before]
    ways += [f"CASE WHEN {test} THEN {_sql_more(x, 'more', 'K')} END" for x, test in letters.items()]
    return f"least({', '.join(ways)})"


OP11_SQL = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
chosen AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda d, i: xor(d >> 1, 3988292384 * (d & 1))))) % 20 AS kind FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM chosen, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS u(copy)),
numbered AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS copy FROM damaged),
placed AS (
  SELECT *, row_number() OVER path AS place, lag(initial) OVER path AS before,
    CASE WHEN bare = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM numbered WINDOW path AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
coded AS (
  SELECT conv_id, place, role, text, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more, initial,
    CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' ELSE initial END AS code FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (place > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM placed GROUP BY conv_id),
paths AS (
  SELECT conv_id, 0::BIGINT AS place, '000000000' AS l0, NULL::VARCHAR AS l1, '000000003I' AS l2, '000000006II' AS l3 FROM counts
  UNION ALL
  SELECT conv_id, place, k0, k1, n2, least(k3, {_sql_more('n2', '3', 'I')}) FROM (
    SELECT *, least(k2, {_sql_more('k0', '3', 'I')}, {_sql_more('k1', '3', 'I')}, {_sql_more('k3', '3', 'I')}) AS n2 FROM (
      SELECT c.conv_id, c.place, {_sql_more('l0', '4', 'D')} AS k0,
        {_sql_least('l1', (), '4', {'l0': "code = 's'"})} AS k1,
        {_sql_least('l2', ('l0', 'l1', 'l3'), '4', dict.fromkeys(('l0', 'l1', 'l3'), "code = 'u'"))} AS k2,
        {_sql_least('l3', ('l2',), '4', {'l2': "code = 'a'"})} AS k3
      FROM paths p JOIN coded c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.place = p.place + 1))),
plans AS (
  SELECT c.*, left(least(l0, l3), 9)::BIGINT AS cost, substr(least(l0, l3), 10) AS audit
  FROM counts c JOIN paths p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.place),
edits AS (
  SELECT conv_id, k, substr(audit, k, 1) AS edit, len(replace(left(audit, k), 'I', '')) AS place, len(replace(left(audit, k), 'D', '')) AS nth
  FROM plans, unnest(range(1, len(audit) + 1)) AS u(k)),
stays AS (
  SELECT e.conv_id, e.nth, e.edit, c.role, CASE WHEN e.edit = 'I' THEN '' ELSE c.text END AS text,
    max(CASE WHEN e.nth = 1 AND e.edit = 'K' AND c.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
  FROM edits e LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.place = e.place WHERE e.edit <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
    chr(10) ORDER BY nth)) AS repaired_sha256 FROM stays GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, '{EMPTY_SHA256}') AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN plans p ON i.conv_id IS NOT DISTINCT FROM p.conv_id
LEFT JOIN repaired r ON i.conv_id IS NOT DISTINCT FROM r.conv_id
"""
