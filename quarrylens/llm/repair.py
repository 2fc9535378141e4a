"""Repair of conversations: the cheapest edits that make their roles alternate, by dynamic programming shared along a trie.

A conversation's cheapest edits depend on its signature alone: one symbol a row, for the row's role and
fault.  Conversations that begin alike share the beginning of the work, and equal ones all of it:

1. Rows are combined to runs of equal rows, and a run learns whether its role and text come earlier: the first turn of
   each role and text is an aggregate, looked up again by turn.
2. Runs sorted in ranges of (conversation, turn) become pieces of signatures, so a conversation of very many rows
   is read by many tasks; the pieces of one are joined, a byte a row, as many as its answer has.
3. The distinct signatures, sorted in ranges, are inserted into a prefix trie.  Sorted insertion only ever needs the path to the
   last signature: the layers of the shared beginning stay, the others are dropped, and new ones are computed
   once for each node.  A terminal node gives its signature's answer.
4. Answers go back to the conversations; a signature that very many have is looked up in a bounded broadcast.
5. A conversation's rows follow its answer through one task in order, and are hashed as they pass.

A layer holds, for each state of the role pattern ``(s?(ua)+)?``, the least cost and the rank of its edits among the
layer's.  Ranks are enough to find the least edits: after a row all edits have equally many letters other than
I and end with one, so none begins another, and what follows can't change their order.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize, parts

#: Roles by initial, and whatever else; faults in the order of their count.
ROLES, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
BLANK = r"\A[\x20\x09-\x0D]*\z"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
NONE = 1 << 40
#: States: nothing yet, after a system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role leads, and what must be inserted before it can.
_NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_FILL = {START: (START, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT, USER), ASSISTANT: (ASSISTANT, USER, ASSISTANT)}


def symbol(role: str, fault: str) -> str:
    """A letter from A for a row: its role's kind times four, and its fault."""
    return chr(65 + 4 * (ROLES.find(role) if role in ROLES and role else 3) + FAULTS.index(fault))


@functools.lru_cache(65536)
def _step(layer: tuple, kind: str) -> tuple[tuple, int, tuple]:
    """The layer after a row of a kind, its least cost above the last one's, and each state's way: (state before, letters).

    A layer is a (cost above its least, rank) for each state; equal layers give equal ones, so few are ever computed.
    """
    role, fault = divmod(ord(kind) - 65, 4)
    edits = [("D", DELETE, None)]
    if fault in (0, 3):
        late = TRUNCATED * (fault == 3)
        edits += [("K", late, ROLES[role : role + 1])] * (role < 3) + [("R", REROLE + late, r) for r in "ua"]
    best: list = [None] * 4
    for state, (cost, rank) in enumerate(layer):
        for k, between in enumerate(_FILL[state] if cost < NONE else ()):
            for letter, price, role_ in edits:
                to = between if role_ is None else _NEXT[between].get(role_)
                if to is not None:
                    found = (cost + k * INSERT + price, rank, "I" * k + letter, state)
                    best[to] = min(best[to] or found, found)
    least = min(b[0] for b in best if b)
    ranks = {b[1:3]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
    return tuple((b[0] - least, ranks[b[1:3]]) if b else (NONE, 4) for b in best), least, tuple((b[3], b[2]) if b else None for b in best)


_FIRST = ((0, 0), (NONE, 4), (NONE, 4), (NONE, 4))
#: What must be inserted at the end.
_LAST = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_ILLEGAL = {(a, b): int((a, b) not in ((0, 1), (1, 2), (2, 1))) for a in range(4) for b in range(4)}


class Trie:
    """The path to the last signature: at each depth the layer, its cost, the ways into it, and the counts so far."""

    def __init__(self) -> None:
        self.last, self.path, self.made = "", [(_FIRST, 0, None, (0, 0, 0, 0))], 0

    def answer(self, signature: str) -> tuple[int, str, tuple[int, int, int, int]]:
        """Cost, edits, and the numbers of blank, duplicate, truncated rows and illegal pairs.  Signatures come in order."""
        depth, most = 0, min(len(self.last), len(signature))
        if self.last[:most] == signature[:most]:
            depth = most
        else:
            lo, hi = 0, most
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if self.last[:mid] == signature[:mid] else (lo, mid)
            depth = lo
        del self.path[depth + 1 :]
        for i in range(depth, len(signature)):
            layer, cost, _, (b, d, t, x) = self.path[-1]
            layer, more, ways = _step(layer, signature[i])
            role, fault = divmod(ord(signature[i]) - 65, 4)
            pair = _ILLEGAL[(ord(signature[i - 1]) - 65) // 4, role] if i else 0
            self.path.append((layer, cost + more, ways, (b + (fault == 1), d + (fault == 2), t + (fault == 3), x + pair)))
            self.made += 1
        self.last = signature
        layer, cost, _, counts = self.path[-1]
        price, _, state = min((c + INSERT * _LAST[s], rank, s) for s, (c, rank) in enumerate(layer))
        out = ["I" * _LAST[state]]
        for _, _, ways, _ in reversed(self.path[1:]):
            state, letters = ways[state]
            out.append(letters)
        return cost + price, "".join(reversed(out)), counts


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        made = [trie.answer(s) for s in batch.column(0).to_pylist()]
        counts = [pa.array([m[2][k] for m in made], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made])], ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def solved(signatures: DataFrame, tasks: int) -> DataFrame:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) for distinct ``signatures(signature)``."""
    ordered = signatures.repartitionByRange(tasks, "signature").sortWithinPartitions("signature")
    return ordered.mapInArrow(_answers, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order become one row a conversation and task: symbols, numbers of turns, first and last turn."""
    now, signs, turns, first, last, none = None, [], 0, None, None, True

    def done():
        return [now, b"".join(signs).decode(), turns, first, last]

    for batch in batches:
        out = []
        for conv, turn, kind, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if conv != now:
                if now is not None:
                    out.append(done())
                now, signs, turns, first, last, none = conv, [], 0, None, None, True
            signs.append((kind[0] + kind[1] * (n - 1)).encode())
            if turn is not None and (none or turn != last):
                turns, last = turns + 1, turn
                first, none = turn if none else first, False
        if out:
            yield _piece(out)
    if now is not None:
        yield _piece([done()])


def _piece(rows: list) -> pa.RecordBatch:
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())], ["conv", "signs", "turns", "first", "last"])


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, n): the rows of ``rows`` with the damage that a checksum of conversation and turn asks for.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes the text's ``.!?`` away, 3 has the row twice, 4 makes
    its role user.  A null counts as one space, but a null turn stays one.  ``conv`` is text that no null shares.
    """
    blank = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    what = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    worn = F.when(what == 1, "").when(what == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text))
    out = rows.select(_name(rows, conv).alias("conv"), rows[turn].cast("long").alias("turn"), F.when(what == 4, "user").otherwise(blank(role)).alias("role"), worn.alias("text"), F.when(what == 3, 2).otherwise(1).cast("long").alias("n"), what.alias("what"))
    return out.where("what <> 0").drop("what")


def undamaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, n): the rows of ``rows`` as they are."""
    blank = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    return rows.select(_name(rows, conv).alias("conv"), rows[turn].cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), F.lit(1).cast("long").alias("n"))


def _name(rows: DataFrame, conv: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), rows[conv].cast("string")), F.lit(""))


def _signed(rows: DataFrame, tasks: int) -> DataFrame:
    """(conv, signature, gaps) of ``rows(conv, turn, role, text, n)``."""
    fault = F.when(F.rlike("text", F.lit(BLANK)), "blank").when(~F.rlike("text", F.lit(ENDED)), "truncated").otherwise("")
    slim = rows.select("conv", "turn", "role", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), fault.alias("fault"), "n")
    at = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("at")).alias("place")
    runs = slim.groupBy("conv", at, "role", "h", "g", "fault").agg(F.sum("n").alias("n"))
    first = runs.groupBy("conv", "role", "h", "g").agg(F.min("place").alias("place")).withColumn("new", F.lit(True))
    told = runs.join(first, ["conv", "role", "h", "g", "place"], "left")
    initial = F.instr(F.lit(ROLES), F.substring("role", 1, 1)) - 1
    group = F.when((F.col("role") == "") | (initial < 0), F.lit(3)).otherwise(initial)
    letter = lambda fault: F.char(65 + 4 * group + fault)
    own = F.when(F.col("fault") == "blank", 1).when(F.col("new").isNull(), 2).when(F.col("fault") == "truncated", 3).otherwise(0)
    kind = F.concat(letter(own), letter(F.when(F.col("fault") == "blank", 1).otherwise(2)))
    told = told.select("conv", F.when(F.col("place.some"), F.col("place.at")).alias("turn"), kind.alias("kind"), "n", "place", "role", "h", "g")
    # rows of one turn come by role and then by text; the text's hash stands for it here as it does where they are hashed
    keys = ["conv", "place", "role", "h", "g"]
    ordered = told.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select("conv", "turn", "kind", "n")
    piece = ordered.mapInArrow(_pieces, "conv string, signs string, turns long, first long, last long").withColumn("part", F.spark_partition_id())
    gather = F.array_sort(F.collect_list(F.struct("part", "signs", "turns", "first", "last")))  # as many as tasks had rows of it
    all_ = piece.groupBy("conv").agg(gather.alias("p"))
    some = F.filter("p", lambda x: x["turns"] > 0)
    met = F.aggregate(F.sequence(F.lit(1), F.size(some)), F.lit(0).cast("long"), lambda n, i: n + F.when((i > 1) & (F.element_at(some, i)["first"] == F.element_at(some, F.greatest(i - 1, F.lit(1)))["last"]), 1).otherwise(0))
    turns = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["turns"]) - met
    gaps = F.when(F.size(some) > 0, F.array_max(F.transform(some, lambda x: x["last"])) - F.array_min(F.transform(some, lambda x: x["first"])) + 1 - turns).otherwise(F.lit(0).cast("long"))
    return all_.select("conv", F.array_join(F.transform("p", lambda x: x["signs"]), "").alias("signature"), gaps.alias("gaps"))


def _hashed(keep: bool):
    """Rows in order behind their conversation's answer: the answer with the repaired text's SHA-256 (or, with ``keep``, the repaired rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, letters, out, at, place, started = None, "", None, 0, 0, False
        done, lines = [], []

        def put(role: str, text: str):
            nonlocal started, place
            if keep:
                lines.append((head, place, role, text))
            else:
                out.update(f"{'' if not started else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            started, place = True, place + 1

        def wanted() -> str:
            return "user" if (place - shift) % 2 == 0 else "assistant"

        def inserts():
            nonlocal at
            while at < len(letters) and letters[at] == "I":
                at += 1
                put(wanted(), "")

        def close():
            if head is not None:
                inserts()
                if not keep:
                    done.append((head, out.hexdigest()))

        shift = 0
        for batch in batches:
            done, lines = [], []
            for conv, audit, role, text, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if audit is not None:
                    close()
                    head, letters, out, at, place, started, shift = conv, audit, hashlib.sha256(), 0, 0, False, 0
                    continue
                for _ in range(n):
                    inserts()
                    edit, at = letters[at], at + 1
                    if edit == "K":
                        shift = 1 if not place and role[:1] == "s" else shift
                        put(role, text)
                    elif edit == "R":
                        put(wanted(), text)
            yield _lines(lines) if keep else _done(done)
        done, lines = [], []
        close()
        yield _lines(lines) if keep else _done(done)

    return run


def _done(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["conv", "repaired_sha256"])


def _lines(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())], ["conv", "place", "role", "text"])


def _told(rows: DataFrame, convs: DataFrame, tasks: int) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation of ``convs(conv)``."""
    signed = materialize(_signed(rows, tasks), "signatures")
    distinct = signed.groupBy("signature").agg(F.count("*").alias("n"))
    table = materialize(solved(distinct.select("signature"), tasks).join(distinct, "signature"), "repairs")
    told = lookup(signed, table, "signature", signed.count()).drop("signature")
    whole = convs.join(told, "conv", "left")
    return materialize(whole.select("conv", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit")), "told")


def _followed(rows: DataFrame, told: DataFrame, tasks: int) -> DataFrame:
    """(conv, audit, role, text, n) in order: a conversation's edits, and its rows after them."""
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("at"))
    body = rows.select("conv", F.lit(None).cast("string").alias("audit"), "role", "text", "n", place.alias("place"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    head = told.select("conv", "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(1).cast("long").alias("n"), F.lit(None).cast(body.schema["place"].dataType).alias("place"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("g"))
    both = body.unionByName(head)
    return both.repartition(tasks, "conv").sortWithinPartitions("conv", F.col("audit").isNull(), "place", "role", "h", "g").select("conv", "audit", "role", "text", "n")


def repairs(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = True) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; rows of one turn by role, then in an order that depends on their texts only.  A null role or text
    counts as one space; a null conversation is one of its own.  A role other than system, user or assistant, told by
    its initial, an empty one included, can't be kept.  ``gaps``: turns missing between the least and the largest; 0 where all are null.
    A conversation without rows after the damage has zeros, no edits and the empty text's hash.  Equal rows are
    duplicates of the first.  Other columns are ignored, whatever their names; an empty table gives an empty result.

    A SHA-256 needs its text from first to last, so a conversation's repaired rows pass through one task, as a
    stream; nothing else of a conversation does.
    """
    spark = rows.sparkSession
    tasks = parts(spark)
    body = (damaged if damage else undamaged)(rows, conv, turn, role, text)
    convs = rows.groupBy(_name(rows, conv).alias("conv")).agg(F.first(rows[conv], True).alias("conv_id"))
    told = _told(body, convs.select("conv"), tasks)
    hashes = _followed(body, told, tasks).mapInArrow(_hashed(False), "conv string, repaired_sha256 string")
    return convs.join(told, "conv").join(hashes, "conv").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations after the cheapest edits: conv_id, place (from 0), role, text.  Nulls, ties and odd rows as in ``repairs``; a conversation without rows has none."""
    tasks = parts(rows.sparkSession)
    body = undamaged(rows, conv, turn, role, text)
    convs = rows.groupBy(_name(rows, conv).alias("conv")).agg(F.first(rows[conv], True).alias("conv_id"))
    told = _told(body, convs.select("conv"), tasks)
    lines = _followed(body, told, tasks).mapInArrow(_hashed(True), "conv string, place long, role string, text string")
    return lines.join(convs, "conv").select("conv_id", "place", "role", "text")


def _sql_step() -> str:
    """One step over the four states, as text that sorts by cost and then by edits."""
    put = lambda state, price, letters: f"printf('%08d', left({state}, 8)::BIGINT + {price}) || substr({state}, 9) || '{letters}'"
    ways: dict[int, list[str]] = {s: [] for s in range(4)}
    for state in range(4):
        for k, between in enumerate(_FILL[state]):
            name, ins = "q" + "0sua"[state], "I" * k
            ways[between].append(put(name, 2 * k + 3, ins + "D"))
            for role, to in _NEXT[between].items():
                ways[to].append(f"CASE WHEN NOT gone AND kind = '{role}' THEN {put(name, f'{2 * k} + late', ins + 'K')} END")
                if role != "s":
                    ways[to].append(f"CASE WHEN NOT gone THEN {put(name, f'{2 * k + 2} + late', ins + 'R')} END")
    return ", ".join(f"least({', '.join(ways[s])}) AS q{'0sua'[s]}" for s in range(4))


SQL = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), checked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS what FROM named
), damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM checked, (VALUES (0), (1)) AS c(copy) WHERE what <> 0 AND (copy = 0 OR what = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, hash(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), faulty AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
    body = '' OR again AS gone, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS kind,
    lag(CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END) OVER (PARTITION BY conv_id ORDER BY i) AS kind_before FROM placed
), rows_ AS (SELECT *, truncated::BIGINT AS late, max(i) OVER (PARTITION BY conv_id) AS n FROM faulty),
walk AS (
  SELECT conv_id AS c, 0::BIGINT AS pos, '00000000' AS q0, '50000000' AS qs, '50000000' AS qu, '50000000' AS qa FROM (SELECT DISTINCT conv_id FROM rows_)
  UNION ALL
  SELECT c, pos + 1, {_sql_step()} FROM walk JOIN rows_ ON conv_id IS NOT DISTINCT FROM c AND i = pos + 1
), ended AS (
  SELECT c, least(q0, qa, printf('%08d', left(qu, 8)::BIGINT + 2) || substr(qu, 9) || 'I', printf('%08d', left(qs, 8)::BIGINT + 4) || substr(qs, 9) || 'II') AS best
  FROM walk JOIN (SELECT conv_id, max(n) AS n FROM rows_ GROUP BY 1) ON conv_id IS NOT DISTINCT FROM c AND n = pos
), answers AS (SELECT c, left(best, 8)::BIGINT AS cost, substr(best, 9) AS audit FROM ended),
letters AS (
  SELECT c, j, substr(audit, j, 1) AS edit, j - len(replace(substr(audit, 1, j), 'I', '')) AS inserted FROM answers, unnest(generate_series(1, len(audit))) AS g(j)
), lines AS (
  SELECT l.*, j - inserted AS i, role, text, kind, row_number() OVER (PARTITION BY c ORDER BY j) - 1 AS place FROM letters l
  LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM c AND edit <> 'I' AND r.i = j - inserted WHERE edit <> 'D'
), shifted AS (SELECT *, bool_or(place = 0 AND edit = 'K' AND kind = 's') OVER (PARTITION BY c) AS led FROM lines),
repaired AS (
  SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body FROM shifted GROUP BY c
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (i > 1 AND kind_before || kind NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN answers a ON a.c IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired p ON p.c IS NOT DISTINCT FROM o.conv_id
"""
