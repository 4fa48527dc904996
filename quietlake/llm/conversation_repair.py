"""Operator 12: repair of conversations as weighted CYK parsing over intervals of rows.

A repaired conversation's role initials match (s?(ua)+)?. With the four places of that pattern
(0 nothing yet, 1 after the system row, 2 after a user, 3 after an assistant) the repair grammar
in Chomsky normal form has a nonterminal N(p,q) for every way from place p to place q:

    N(p,q) -> N(p,r) N(r,q)          two neighbouring spans
    N(p,q) -> edit of one row        keep, rerole, delete; closed under insertions on both sides

An interval's cells hold for each N(p,q) the minimum of (cost, audit); equal costs are ordered by
the audit string, which no other one of the same span and cost is a prefix of, so that minima
compose. Cells are combined bottom-up by span length: 1, 2, 4, … rows within a chunk, then
chunks. Every derivation can be bracketed at any split point, as the rules exist for every r, so
one split of a span gives its minimum, and the other intervals of the chart need not be filled.

Conversations of any length are spread: rows are sorted over the cluster by conversation and
turn, chunks of bounded size become cells where they lie, and only cells travel to be combined.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table, written

INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
SPACES = " \t\n\x0b\x0c\r"
#: Rows and characters of text in a chunk (a longer row is a chunk of its own).
CHUNK_ROWS, CHUNK_CHARS = 256, 1_000_000
#: Distinct short spans whose cells a worker keeps.
SPANS = 50_000

#: Place -> place by the initial that leads there.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE_TO = {"u": "user", "a": "assistant"}
PAIRS = [(p, q) for p in range(4) for q in range(4) if q >= min(p, 2)]
TRIPLES = [(4 * p + r, 4 * r + q, 4 * p + q) for p, r in PAIRS for r2, q in PAIRS if r == r2]
Cell = tuple[tuple[int, str] | None, ...]


def compose(left: Cell, right: Cell) -> Cell:
    """N(p,q) -> N(p,r) N(r,q) for all p, r, q."""
    out: list[tuple[int, str] | None] = [None] * 16
    for a, b, c in TRIPLES:
        x, y = left[a], right[b]
        if x is not None and y is not None:
            cost, old = x[0] + y[0], out[c]
            if old is None or cost < old[0] or (cost == old[0] and x[1] + y[1] < old[1]):
                out[c] = (cost, x[1] + y[1])
    return tuple(out)


def _cell(ways: list[tuple[int, int, int, str]]) -> Cell:
    out: list[tuple[int, str] | None] = [None] * 16
    for p, q, cost, audit in ways:
        if out[4 * p + q] is None or (cost, audit) < out[4 * p + q]:
            out[4 * p + q] = (cost, audit)
    return tuple(out)


@functools.cache
def insertions() -> Cell:
    """No, one or two inserted rows; more lead nowhere that fewer do not."""
    one = [(p, q, INSERT, "I") for kind in "ua" for p, q in STEPS[kind].items()]
    two = [(p, t, 2 * INSERT, "II") for p, q, *_ in one for r, t, *_ in one if q == r]
    return _cell([(p, p, 0, "") for p in range(4)] + one + two)


@functools.cache
def leaf(code: str) -> Cell:
    """One row: D must go; u, a, s or x (another role) by its initial, in upper case if truncated."""
    ways = [(p, p, DELETE, "D") for p in range(4)]
    if code != "D":
        more = TRUNCATED if code.isupper() else 0
        ways += [(p, q, more, "K") for p, q in STEPS.get(code.lower(), {}).items()]
        ways += [(p, q, more + REROLE, "R") for kind in "ua" for p, q in STEPS[kind].items()]
    return compose(compose(insertions(), _cell(ways)), insertions())


def combined(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, bottom-up by span length."""
    while len(cells) > 1:
        pairs = [compose(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = pairs + cells[len(pairs) * 2 :]
    return cells[0]


@functools.lru_cache(SPANS)
def _span(codes: str) -> Cell:
    return combined([leaf(c) for c in codes])


def _run(code: str, n: int) -> Cell:
    """n rows of one kind, by doubling."""
    out, power = None, leaf(code)
    while n:
        if n & 1:
            out = power if out is None else compose(out, power)
        n >>= 1
        if n:
            power = compose(power, power)
    return out


def parsed(codes: list[str], copies: list[int]) -> Cell:
    """The cell of rows with these codes; further copies of a row must go."""
    cells, short = [], ""
    for code, n in zip(codes, copies):
        short += code
        if n > 1 or len(short) == 8:
            cells.append(_span(short))
            short = ""
        if n > 1:
            cells.append(_run("D", n - 1))
    if short:
        cells.append(_span(short))
    return combined(cells)


def best(cell: Cell) -> tuple[int, str]:
    """The cheapest way from nothing to nothing or to a finished pair."""
    return min(c for c in (cell[0], cell[3]) if c is not None)


def follow(place: int, edits: str, codes: list[str], copies: list[int]) -> tuple[int, int]:
    """How many edits belong to these rows (insertions go with the row after them), and the place behind them."""
    at = 0
    for code, n in zip(codes, copies):
        for _ in range(n):
            while edits[at] == "I":
                place, at = 3 if place == 2 else 2, at + 1
            if edits[at] == "K":
                place = STEPS[code.lower()][place]
            elif edits[at] == "R":
                place = 3 if place == 2 else 2
            at += 1
    return at, place


def rewritten(place: int, edits: str, roles: list[str], texts: list[str | None], copies: list[int]) -> list[str]:
    """Lines `role:text` of the repaired rows."""
    out, row, left = [], -1, 0
    for e in edits:
        if e == "I":
            out.append(("assistant" if place == 2 else "user") + ":")
            place = 3 if place == 2 else 2
            continue
        if not left:
            row += 1
            left = copies[row]
        left -= 1
        if e == "K":
            out.append(f"{roles[row]}:{texts[row]}")
            place = STEPS[roles[row][0]][place]
        elif e == "R":
            out.append(f"{'assistant' if place == 2 else 'user'}:{texts[row]}")
            place = 3 if place == 2 else 2
    return out


def key() -> Column:
    """A conversation's id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def damaged(conversations: DataFrame) -> DataFrame:
    """(c, turn, role, text, copies): the rows after the damage that crc32(conv_id:turn) decides."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn"))) % 20
    rows = conversations.select(key().alias("c"), "turn", either("role").alias("role"), either("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("c", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """(c, turn, role, text, copies) of the rows as they are; a null role or text is one space."""
    return conversations.select(key().alias("c"), "turn", *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")], F.lit(1).cast("long").alias("copies"))


CHUNK = "c string, part long, seq long, codes array<string>, copies array<long>, roles array<string>, texts array<string>, counts array<long>, initials array<string>, turns array<long>, costs array<long>, audits array<string>"


def _chunks(rows: DataFrame) -> DataFrame:
    """Chunks of neighbouring rows with their cells, numbered by partition and within it."""
    digest = F.sha2("text", 256)
    alike = rows.groupBy("c", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", digest)
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy("c", "role", digest.alias("digest")).agg(F.min(order).alias("first"))
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    finished = F.substring(body, -1, 1).isin(".", "!", "?")
    joined = alike.join(first, ["c", "role", "digest"]).withColumn("repeats", order != F.col("first"))
    joined = joined.withColumn("blank", body == "").withColumn("short", ~finished)
    joined = joined.withColumn("text", F.when(~F.col("blank") & ~F.col("repeats"), F.col("text")))
    at = ["c", "turn", "role", "digest"]
    given = joined.repartitionByRange(*at).sortWithinPartitions(*at).select("c", F.col("turn").cast("long").alias("turn"), "role", "text", "copies", "repeats", "blank", "short")
    schema = _arrow(CHUNK, given.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, chars = TaskContext.get().partitionId(), 0, None, 0
        rows_: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*[col.to_pylist() for col in batch.columns]):
                size = len(row[3] or "")
                if rows_ and (row[0] != now or len(rows_) == CHUNK_ROWS or chars + size > CHUNK_CHARS):
                    out.append((now, part, seq, *_chunk(rows_)))
                    rows_, chars, seq = [], 0, seq + 1
                now = row[0]
                rows_.append(row)
                chars += size
            if out:
                yield _batch(out, schema)
                out = []
        if rows_:
            yield _batch([(now, part, seq, *_chunk(rows_))], schema)
        release()

    return given.mapInArrow(run, CHUNK)


def _chunk(rows: list[tuple]) -> tuple:
    codes, copies, roles, texts = [], [], [], []
    blank = duplicate = truncated = illegal = 0
    turns: list[int] = []
    last = None
    for _, turn, role, text, n, repeats, is_blank, short in rows:
        initial = role[:1]
        illegal += n - 1 + (last is not None and last + initial not in ("su", "ua", "au"))
        last = initial
        if turn is not None and (not turns or turns[-1] != turn):
            turns.append(turn)
        if is_blank:
            blank, code = blank + n, "D"
        elif repeats:
            duplicate, code = duplicate + n, "D"
        else:
            duplicate += n - 1
            code = initial if initial in STEPS else "x"
            if short:
                truncated, code = truncated + 1, code.upper()
        codes.append(code), copies.append(n), roles.append(role), texts.append(text)
    cell = parsed(codes, copies)
    ends = [turns[0], turns[-1], len(turns)] if turns else None
    cells = [x if x is not None else (None, None) for x in cell]
    return codes, copies, roles, texts, [blank, duplicate, truncated, illegal], [rows[0][2][:1], last], ends, [x[0] for x in cells], [x[1] for x in cells]


DECIDED = "c string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<part:long,seq:long,place:int,edits:string>>"


def _decided(chunks: DataFrame) -> DataFrame:
    """One row for each conversation: its counts, cost and audit, and each chunk's share of the audit."""
    given = chunks.select("c", "part", "seq", "codes", "copies", "counts", "initials", "turns", "costs", "audits").repartition("c").sortWithinPartitions("c", "part", "seq")
    schema = _arrow(DECIDED, chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*[col.to_pylist() for col in batch.columns]):
                if some and some[-1][0] != row[0]:
                    out.append(_decide(some))
                    some = []
                some.append(row)
            if out:
                yield _batch(out, schema)
        if some:
            yield _batch([_decide(some)], schema)
        release()

    return given.mapInArrow(run, DECIDED)


def _decide(chunks: list[tuple]) -> tuple:
    counts, last, turns = [0] * 4, None, None
    cells = []
    for *_, more, initials, ends, costs, audits in chunks:
        counts = [x + y for x, y in zip(counts, more)]
        counts[3] += last is not None and last + initials[0] not in ("su", "ua", "au")
        last = initials[1]
        if ends:
            turns = ends if turns is None else [turns[0], ends[1], turns[2] + ends[2] - (turns[1] == ends[0])]
        cells.append(tuple(None if c is None else (c, a) for c, a in zip(costs, audits)))
    cost, audit = best(combined(cells))
    pieces, place, at = [], 0, 0
    for i, (_, part, seq, codes, copies, *_) in enumerate(chunks):
        n, after = follow(place, audit[at:], codes, copies) if len(chunks) > 1 else (len(audit), 0)
        end = len(audit) if i == len(chunks) - 1 else at + n
        pieces.append({"part": part, "seq": seq, "place": place, "edits": audit[at:end]})
        place, at = after, end
    return chunks[0][0], turns[1] - turns[0] + 1 - turns[2] if turns else 0, *counts, cost, audit, pieces


def repaired_texts(chunks: DataFrame, decided: DataFrame) -> DataFrame:
    """(c, part, seq, lines): the repaired rows `role:text`, newline-joined by chunk; chunks without any are left out."""
    pieces = decided.select("c", F.explode("pieces").alias("p")).select("c", "p.*").where("edits rlike '[^D]'")
    given = chunks.select("c", "part", "seq", "roles", "texts", "copies").join(pieces, ["c", "part", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, part, seq, roles, texts, copies, place, edits = batch.columns
            lines = ["\n".join(rewritten(*x)) for x in zip(*[col.to_pylist() for col in (place, edits, roles, texts, copies)])]
            yield pa.RecordBatch.from_arrays([c, part, seq, pa.array(lines, pa.string())], ["c", "part", "seq", "lines"])
        release()

    return given.mapInArrow(run, "c string, part long, seq long, lines string")


def _digests(lines: DataFrame) -> DataFrame:
    """(c, repaired_sha256): a conversation's chunks go through one hash in order, one at a time."""
    given = lines.repartition("c").sortWithinPartitions("c", "part", "seq").select("c", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if c != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(text.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["c", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["c", "repaired_sha256"])

    return given.mapInArrow(run, "c string, repaired_sha256 string")


def _arrow(ddl: str, spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), schema)], schema.names)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, lines) for rows (c, turn, role, text, copies): one row a conversation, and its repaired rows by chunk.

    Rows are taken by turn, nulls first; rows of one turn by role and by their text's hash. The
    first fault counts: blank, duplicate (role and text were there before) or truncated. Rows
    that are equal in all are one row with copies. A role without an initial (empty) or with
    another initial than s, u, a cannot be kept.
    """
    chunks = written(_chunks(rows), "chunks")
    decided = written(_decided(chunks), "decided")
    return decided, repaired_texts(chunks, decided)


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    A null role or text is one space, a null conv_id is a conversation of its own. Conversations
    that lost all rows have zeros, an empty audit and the hash of nothing; an empty table gives
    no rows. Repeated rows are duplicates; other columns are not read. A conversation's audit
    must fit in a row, its texts need not.
    """
    kind = conversations.schema["conv_id"].dataType
    decided, lines = repair(damaged(conversations))
    digests = written(_digests(lines), "digests")
    out = conversations.select(key().alias("c")).distinct().join(decided.drop("pieces"), "c", "left").join(digests, "c", "left")
    numbers = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    given = F.when(F.col("c") != "", F.expr("substr(c, 2)")).cast(kind).alias("conv_id")
    return out.select(given, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op12_interval_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(table(spark, sf_dir, "conversations"))


#: The same by a left-to-right programme over the places, with the checksum bit by bit.
SQL = """
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS kind FROM given),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE kind <> 0),
placed AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM hurt),
marked AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM marked GROUP BY conv_id),
steps(initial, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
inserted(p, q, cost, audit, lines) AS (
  SELECT p, p, 0, '', '' FROM range(4) t(p)
  UNION ALL SELECT p, q, 5, 'I', chr(10) || CASE q WHEN 2 THEN 'user:' ELSE 'assistant:' END FROM steps WHERE initial <> 's'
  UNION ALL SELECT x.p, y.q, 10, 'II', CASE y.q WHEN 3 THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE chr(10) || 'assistant:' || chr(10) || 'user:' END
    FROM steps x JOIN steps y ON y.p = x.q WHERE x.initial <> 's' AND y.initial <> 's'),
edits AS (
  SELECT conv_id, i, p, p AS q, 2 AS cost, 'D' AS audit, '' AS line FROM marked, range(4) t(p)
  UNION ALL
  SELECT conv_id, i, p, q, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', chr(10) || role || ':' || text
    FROM marked JOIN steps USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, i, p, q, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', chr(10) || CASE q WHEN 2 THEN 'user:' ELSE 'assistant:' END || text
    FROM marked, steps WHERE steps.initial <> 's' AND fault NOT IN ('blank', 'duplicate')),
ways AS (
  SELECT e.conv_id, e.i, e.p, n.q, min(struct_pack(cost := e.cost + n.cost, audit := e.audit || n.audit, lines := e.line || n.lines)) AS w
  FROM edits e JOIN inserted n ON n.p = e.q GROUP BY ALL),
best(conv_id, i, p, w) AS (
  SELECT c.conv_id, 0::BIGINT, n.q, struct_pack(cost := n.cost, audit := n.audit, lines := n.lines) FROM counted c, inserted n WHERE n.p = 0
  UNION ALL
  SELECT b.conv_id, b.i + 1, x.q, min(struct_pack(cost := b.w.cost + x.w.cost, audit := b.w.audit || x.w.audit, lines := b.w.lines || x.w.lines))
  FROM best b JOIN ways x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.i = b.i + 1 AND x.p = b.p GROUP BY b.conv_id, b.i, x.q),
final AS (
  SELECT b.conv_id, min(b.w) AS w FROM best b JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.rows = b.i WHERE b.p IN (0, 3) GROUP BY b.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(f.w.cost, 0)::BIGINT AS cost,
       coalesce(f.w.audit, '') AS audit, sha256(coalesce(substr(f.w.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""
QUERIES = {"op12_interval_repair": op12_interval_repair}
ORACLE_SQL = {"op12_interval_repair": SQL}
