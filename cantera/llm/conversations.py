"""Conversation structure repair: the cheapest edits that give alternating turns, by a trie-shared DP.

The roles of a repaired conversation start with ``(s?(ua)+)?``. Keeping a turn costs 0,
giving it the role user or assistant 1, deleting it 2, inserting an empty user or assistant
turn 5; blank and repeated turns must go, and a truncated turn that stays adds 5. Of the
cheapest scripts that with the least string of initials (D, I, K, R) is taken.

Plan: turns are dealt and sorted by conversation, and one pass turns each conversation into
a signature of one letter a turn: ``x`` for turns that must go, else the role's letter,
upper case if truncated. Equal signatures have equal answers, so only distinct ones are
solved: they are sorted by range and run through a prefix trie. Sorted input only ever
extends or leaves the trie's last branch, so only that path is kept, with the cost of every
state at each of its nodes; a layer is computed once for all signatures that share the
prefix. At a terminal node the states that lie on cheapest paths are found backwards and
the least script is read off forwards. Answers are joined to conversations, and the scripts
run over the sorted turns once more, turn by turn, to give the repaired rows.

A conversation's turns are hashed in order, so they pass through one task, as a stream: the
task holds a digest of 16 bytes for each distinct turn, a letter and a script character a
turn, and no texts but those of its batch.

Defined results: a null role or text reads as one space; turns sort by number, nulls first,
then role and text; roles other than s…, u… and a… (empty ones too) can't be kept and are
illegal neighbours; a null conversation id is a conversation; repeated rows are turns of
their own (the second is a duplicate); an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import table, tidy, written

# Fixed values of the contract: white space, costs of edits.
BLANK = " \t\n\x0b\f\r"
RETAG, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: Bytes of signatures and answers that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows and characters of a batch that a task sends.
ROWS, CHARS = 2048, 8 << 20
#: States of a script: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 50

# ---- the trie


def _turn_to(state: int) -> int:
    """The only state that a turn of role user or assistant can lead to."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, role: str) -> int | None:
    """The state after a kept turn, if it may stand there."""
    if role == "s":
        return SYSTEM if state == START else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


def _edges(letter: str) -> list[tuple[int, str, int, int]]:
    """(from, edit, to, cost) of the edits that use up a turn."""
    out = [(state, "D", state, DELETE) for state in range(4)]
    if letter != "x":
        extra = TRUNCATED if letter.isupper() else 0
        for state in range(4):
            if (to := _kept(state, letter.lower())) is not None:
                out.append((state, "K", to, extra))
            out.append((state, "R", _turn_to(state), RETAG + extra))
    return out


EDGES = {letter: _edges(letter) for letter in "xsuaoSUAO"}


def _inserted(cost: list[int]) -> list[int]:
    cost[USER] = min(cost[USER], INSERT + min(cost[START], cost[SYSTEM], cost[ASSISTANT]))
    cost[ASSISTANT] = min(cost[ASSISTANT], INSERT + cost[USER])
    return cost


def _layer(before: array, letter: str) -> list[int]:
    cost = [NEVER] * 4
    for a, _, b, c in EDGES[letter]:
        if before[a] + c < cost[b]:
            cost[b] = before[a] + c
    return _inserted(cost)


def _script(signature: str, layers: array) -> tuple[int, str]:
    """Cost and least cheapest script of a terminal node whose path has these layers."""
    n = len(signature)
    best = min(layers[4 * n + START], layers[4 * n + ASSISTANT])
    good = bytearray(n + 1)
    good[n] = sum(1 << s for s in (START, ASSISTANT) if layers[4 * n + s] == best)
    for i in range(n, -1, -1):
        here = layers[4 * i : 4 * i + 4]
        for _ in range(3):  # inserted turns lead from state to state within a layer
            for s in range(4):
                if good[i] >> _turn_to(s) & 1 and here[s] + INSERT == here[_turn_to(s)]:
                    good[i] |= 1 << s
        if i:
            before = layers[4 * i - 4 : 4 * i]
            for a, _, b, c in EDGES[signature[i - 1]]:
                if good[i] >> b & 1 and before[a] + c == here[b]:
                    good[i - 1] |= 1 << a
    out, i, state = [], 0, START
    while i < n or layers[4 * i + state] != best or state not in (START, ASSISTANT):
        cost, options = layers[4 * i + state], []
        if i < n:
            options = [(edit, i + 1, b) for a, edit, b, c in EDGES[signature[i]] if a == state and good[i + 1] >> b & 1 and cost + c == layers[4 * i + 4 + b]]
        to = _turn_to(state)
        if good[i] >> to & 1 and cost + INSERT == layers[4 * i + to]:
            options.append(("I", i, to))
        edit, i, state = min(options)
        out.append(edit)
    return best, "".join(out)


def solved(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, script) of sorted signatures; layers of shared prefixes are kept."""
    layers, path = array("q", _inserted([0, NEVER, NEVER, NEVER])), ""
    for signature in signatures:
        shared = len(os.path.commonprefix([path, signature]))
        del layers[4 * (shared + 1) :]
        for letter in signature[shared:]:
            layers.extend(_layer(layers[-4:], letter))
        path = signature
        yield signature, *_script(signature, layers)


# ---- over conversations


def _sorted(rows: DataFrame) -> DataFrame:
    order = [F.col(c) for c in rows.columns if c in ("conv_id", "kind")] + [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def _batches(kind: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= ROWS or size >= CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield from zip(*[c.to_pylist() for c in batch.slice(k, ROWS).columns], strict=True)


FOUND = "signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    kind = pa.schema([pa.field("conv_id", first.schema.field(0).type), pa.field("signature", pa.string()), *[pa.field(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")]])

    def chained() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    def conversations() -> Iterator[tuple]:
        now: tuple | None = None
        for conv, turn, role, digest, last in _rows(chained()):
            if now is None or conv != now[0]:
                if now is not None:
                    yield done()
                now, letters, seen, count, turns, before = (conv,), [], set(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, [None, None, 0], None
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = "blank" if not last else "duplicate" if digest in seen else "truncated" if last not in ".!?" else None
            seen.add(digest)
            if fault:
                count[fault] += 1
            letters.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
            if before is not None and before + initial not in ("su", "ua", "au"):
                count["illegal"] += 1
            before = initial
            if turn is not None and turn != turns[1]:
                turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]

            def done() -> tuple:
                gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
                return now[0], "".join(letters), gaps, *count.values()

        if now is not None:
            yield done()

    yield from _batches(kind, conversations())


def described(conversations: DataFrame) -> DataFrame:
    """One row per conversation with turns: signature, gaps and counts of faults."""
    end = F.rtrim("text", F.lit(BLANK))
    # A role and a text are one value: their lengths keep them apart.
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("text"))))
    rows = _sorted(_turns(conversations)).select("conv_id", "turn", "role", digest.alias("digest"), F.right(end, F.lit(1)).alias("last"))
    schema = StructType([StructField("conv_id", conversations.schema["conv_id"].dataType)] + StructType.fromDDL(FOUND).fields)
    return rows.mapInArrow(tidy(_describe), schema)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    yield from _batches(kind, solved(s for (s,) in _rows(batches)))


def answers(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct signatures, by tries over their sorted ranges."""
    distinct = signatures.select("signature").distinct()
    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(tidy(_solve), "signature string, cost bigint, audit string")


def audited(conversations: DataFrame) -> DataFrame:
    """Written table of one row per conversation with turns: faults, cost and script."""
    found = written(described(conversations), "signatures")
    answer = written(answers(found), "scripts")
    size = answer.agg(F.sum(F.length("signature") + F.length("audit"))).first()[0] or 0
    out = found.join(F.broadcast(answer) if size <= BROADCAST_BYTES else answer, "signature")
    return written(out.drop("signature"), "audits")


REPAIRED = [StructField("role", StringType()), StructField("text", StringType()), StructField("edit", StringType())]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    kind = pa.schema([pa.field("conv_id", first.schema.field(0).type), *[(c, pa.string()) for c in ("role", "text", "edit")]])

    def chained() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    def turns() -> Iterator[tuple]:
        conv, script, at, last = None, "", 0, ""

        def inserts() -> Iterator[tuple]:
            nonlocal at, last
            while at < len(script) and script[at] == "I":
                at, last = at + 1, "assistant" if last[:1] == "u" else "user"
                yield conv, last, "", "I"

        for key, kind_, role, text in _rows(chained()):
            if kind_ == 0:  # the script comes before its turns
                yield from inserts()
                conv, script, at, last = key, text, 0, ""
                continue
            yield from inserts()
            edit, at = script[at], at + 1
            if edit != "D":
                last = role if edit == "K" else "assistant" if last[:1] == "u" else "user"
                yield conv, last, text, edit
        yield from inserts()

    yield from _batches(kind, turns())


def repaired(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, role, text, edit): the turns that stay or are inserted; a conversation's follow each other in order."""
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = _turns(conversations).withColumn("kind", F.lit(1)).select(heads.columns)
    rows = _sorted(heads.unionByName(rows)).select("conv_id", "kind", "role", "text")
    return rows.mapInArrow(tidy(_apply), StructType([StructField("conv_id", conversations.schema["conv_id"].dataType), *REPAIRED]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    kind = pa.schema([pa.field("conv_id", first.schema.field(0).type), ("repaired_sha256", pa.string())])

    def hashes() -> Iterator[tuple]:
        conv, h = None, None
        for batch in (b for some in ([first], batches) for b in some):
            for key, role, text, _ in _rows(iter([batch])):
                if h is None or key != conv:
                    if h is not None:
                        yield conv, h.hexdigest()
                    conv, h = key, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
        if h is not None:
            yield conv, h.hexdigest()

    yield from _batches(kind, hashes())


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the newline-joined ``role:text`` of each conversation of ``repaired``, which has rows in order."""
    return rows.mapInArrow(tidy(_digest), StructType([rows.schema["conv_id"], StructField("repaired_sha256", StringType())]))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's faults, dealt by a checksum of conversation and turn."""
    blank: Callable[[str], Column] = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults, cost, script and digest for every conversation of ``conversations``, repaired from ``rows``."""
    audits = audited(rows)
    hashes = digests(repaired(rows, audits)).withColumnRenamed("conv_id", "of")
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(audits, ids["id"].eqNullSafe(audits["conv_id"]), "left").drop("conv_id")
    out = out.join(hashes, out["id"].eqNullSafe(hashes["of"]), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = hashlib.sha256().hexdigest()
    return out.select(F.col("id").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(conversations, damaged(conversations))


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _add(state: str, cost: str, edit: str, when: str = "true") -> str:
    return f"{{'c': {state}.c + CASE WHEN {when} THEN {cost} ELSE 1000000 END, 'a': {state}.a || '{edit}'}}"


_STAYS = "l <> 'x'"
_STEP = f"""
    SELECT sig, i, z, s, u2 AS u, {_least("a1", _add("u2", "5", "I"))} AS a FROM (
      SELECT *, {_least("u1", _add("z", "5", "I"), _add("s", "5", "I"), _add("a1", "5", "I"))} AS u2 FROM (%s))"""

OP12_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))::BIT::VARCHAR AS bits
  FROM conversations
), coded AS (
  SELECT *, xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(range(length(bits)), lambda k: bits[(k // 8) * 8 + 8 - k % 8]::UBIGINT),
    lambda c, b: xor(c >> 1, 3988292384::UBIGINT * (xor(c, b) & 1::UBIGINT)))) % 20 AS code
  FROM keyed
), d AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends
  FROM d
), f AS (
  SELECT *, CASE WHEN ends = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(ends, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial
  FROM n
), e AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END AS letter,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair
  FROM f
), convs AS (
  SELECT conv_id AS conv, string_agg(letter, '' ORDER BY pos) AS sig, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM e GROUP BY conv_id
), sigs AS (SELECT DISTINCT sig FROM convs),
dp AS (
  {_STEP % "SELECT sig, 0 AS i, {'c': 0, 'a': ''} AS z, {'c': 1000000, 'a': ''} AS s, {'c': 1000000, 'a': ''} AS u1, {'c': 1000000, 'a': ''} AS a1 FROM sigs"}
  UNION ALL
  {_STEP % f'''SELECT sig, i, {_add("z", "2", "D")} AS z, {_least(_add("s", "2", "D"), _add("z", "t", "K", "r = 's'"))} AS s,
    {_least(_add("u", "2", "D"), *[_add(x, "t", "K", "r = 'u'") for x in ("z", "s", "a")], *[_add(x, "t + 1", "R", _STAYS) for x in ("z", "s", "a")])} AS u1,
    {_least(_add("a", "2", "D"), _add("u", "t", "K", "r = 'a'"), _add("u", "t + 1", "R", _STAYS))} AS a1
    FROM (SELECT sig, i + 1 AS i, z, s, u, a, substr(sig, i + 1, 1) AS l, lower(substr(sig, i + 1, 1)) AS r,
      CASE WHEN substr(sig, i + 1, 1) = lower(substr(sig, i + 1, 1)) THEN 0 ELSE 5 END AS t FROM dp WHERE i < length(sig))'''}
), best AS (SELECT sig, {_least("z", "a")} AS b FROM dp WHERE i = length(sig)),
edits AS (
  SELECT conv, k, substr(b.a, k::INT, 1) AS edit, sum((substr(b.a, k::INT, 1) <> 'I')::INT) OVER (PARTITION BY conv ORDER BY k) AS pos,
    sum((substr(b.a, k::INT, 1) <> 'D')::INT) OVER (PARTITION BY conv ORDER BY k) AS place
  FROM (SELECT conv, b, unnest(range(1, length(b.a) + 1)) AS k FROM convs JOIN best USING (sig))
), firsts AS (SELECT conv, (min(role) FILTER (WHERE place = 1 AND edit = 'K'))[1] = 's' AS system FROM edits JOIN e ON e.conv_id IS NOT DISTINCT FROM conv AND e.pos = edits.pos GROUP BY conv),
texts AS (
  SELECT edits.conv, k, CASE WHEN edit = 'K' THEN role WHEN (place + coalesce(system, false)::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END AS line
  FROM edits LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM conv AND e.pos = edits.pos LEFT JOIN firsts ON firsts.conv IS NOT DISTINCT FROM edits.conv WHERE edit <> 'D'
), hashes AS (SELECT conv, sha256(string_agg(line, chr(10) ORDER BY k)) AS h FROM texts GROUP BY conv)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN convs ON convs.conv IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best USING (sig)
LEFT JOIN hashes ON hashes.conv IS NOT DISTINCT FROM ids.conv_id
"""
