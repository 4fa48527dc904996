import hashlib
import itertools
import random
import re
import zlib

import duckdb
from pyspark.sql import types as T

from quietlake.llm import conversation_repair as repair

FINE = re.compile(r"(s?(ua)+)?\Z")
FULL = {"u": "user", "a": "assistant", "s": "system"}
SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost string, c long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0d]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """All edits with at most two insertions at each place, literally."""
    kinds = faults(rows)
    best = None
    gaps = [[""] + ["".join(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)] for _ in range(len(rows) + 1)]
    each = [[("D", "")] + ([] if k in ("blank", "duplicate") else [("K", r[0][:1])] * bool(r[0]) + [("R", "u"), ("R", "a")]) for r, k in zip(rows, kinds)]
    for edits in itertools.product(*each):
        cost = sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (e != "D" and k == "truncated") for (e, _), k in zip(edits, kinds))
        for ins in itertools.product(*gaps):
            initials = ins[0] + "".join(i + g for (_, i), g in zip(edits, ins[1:]))
            total = cost + 5 * sum(map(len, ins))
            if (best is None or total <= best[0]) and FINE.match(initials) and set(initials) <= set("sua"):
                audit = "I" * len(ins[0]) + "".join(e + "I" * len(g) for (e, _), g in zip(edits, ins[1:]))
                lines = [f"{FULL[g]}:" for g in ins[0]]
                for (e, i), (role, text), g in zip(edits, rows, ins[1:]):
                    lines += [f"{role if e == 'K' else FULL.get(i)}:{text}"] * (e != "D") + [f"{FULL[x]}:" for x in g]
                if best is None or (total, audit) < best[:2]:
                    best = (total, audit, lines)
    return best


def stepwise(rows):
    """Left to right over the pattern's places, a plain dynamic programme."""
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def closed(now):
        for _ in range(2):
            for p, (c, a, lines) in list(now.items()):
                for i in "ua":
                    q = step.get((i, p))
                    if q is not None:
                        new = (c + 5, a + "I", [*lines, FULL[i] + ":"])
                        if q not in now or new[:2] < now[q][:2]:
                            now[q] = new
        return now

    now = closed({0: (0, "", [])})
    for (role, text), k in zip(rows, faults(rows)):
        after = {}
        for p, (c, a, lines) in now.items():
            ways = [(2, "D", p, None)]
            if k not in ("blank", "duplicate"):
                more = 5 * (k == "truncated")
                ways += [(more, "K", step.get((role[:1], p)), role)] + [(more + 1, "R", step.get((i, p)), FULL[i]) for i in "ua"]
            for cost, e, q, as_role in ways:
                if q is not None:
                    new = (c + cost, a + e, lines if as_role is None else [*lines, f"{as_role}:{text}"])
                    if q not in after or new[:2] < after[q][:2]:
                        after[q] = new
        now = closed(after)
    return min((now[p] for p in (0, 3) if p in now), key=lambda x: x[:2])


def expected(rows):
    """The whole contract in plain Python, from (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        of = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        of += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, of in groups.items():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        both = [r[1:] for r in of]
        k = faults(both)
        turns = [t for t, *_ in of if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(both, both[1:]))
        cost, audit, lines = stepwise(both) if both else (0, "", [])
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, k.count("blank"), k.count("duplicate"), k.count("truncated"), illegal, cost, audit, sha)
    return out


def got(df):
    rows = repair.damage_and_repair(df).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


ROWS = [(r, t) for r in ("user", "assistant", "system", "tool") for t in ("Yes.", "no", " ")]


def test_stepwise_is_exhaustive():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(12 if n == 3 else 60):
            rows = [rng.choice(ROWS) for _ in range(n)]
            assert stepwise(rows) == exhaustive(rows), rows


def codes_of(rows):
    return ["D" if k in ("blank", "duplicate") else (r[0] if r[0] in "sua" else "x").upper() if k else r[0] if r[0] in "sua" else "x" for (r, _), k in zip(rows, faults(rows))]


def test_cells_against_stepwise():
    rng = random.Random(2)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["A.", "B!", "c", "", f"{rng.random()}."])) for _ in range(rng.randint(1, 40))]
        cost, audit, lines = stepwise(rows)
        assert repair.best(repair.parsed(codes_of(rows), [1] * len(rows))) == (cost, audit)
        assert repair.rewritten(0, audit, *zip(*rows), [1] * len(rows)) == lines


def test_every_split_of_a_span_has_the_same_cell():
    """The full chart over all intervals and splits, against the cells that are combined by doubling."""
    rng = random.Random(3)
    for _ in range(25):
        codes = [rng.choice("uausxDUAu") for _ in range(rng.randint(1, 12))]
        chart = {(i, i + 1): repair.leaf(c) for i, c in enumerate(codes)}
        for size in range(2, len(codes) + 1):
            for i in range(len(codes) - size + 1):
                ways = {repair.compose(chart[i, m], chart[m, i + size]) for m in range(i + 1, i + size)}
                assert len(ways) == 1
                chart[i, i + size] = ways.pop()
        assert repair.parsed(codes, [1] * len(codes)) == chart[0, len(codes)]


def test_copies_are_rows_that_must_go():
    for n in (2, 3, 7, 20):
        assert repair.parsed(["u", "a", "u"], [1, n, 1]) == repair.parsed(["u", "a", *"D" * (n - 1), "u"], [1] * (n + 2))


def conversations(rng, n, longest):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            role = "system" if turn == 0 and rng.random() < 0.3 else rng.choice(["tool", "", None]) if rng.random() < 0.05 else role
            text = rng.choice(["Hi there.", "ok", "", None, " \n", f"Text {rng.random()}!", f"cut {turn}", "So?\n "])
            rows.append((conv if conv else None, None if rng.random() < 0.04 else turn * rng.choice([1, 1, 2]), role, text))
    return rows


def test_against_plain_python(spark):
    rows = conversations(random.Random(4), 150, 12)
    rows += [(900, t, "user", "Same.") for t in range(8)] + [(901, 3, "user", "Same.")] * 9 + [(902, None, "assistant", "x")] * 2
    rows += [(1000 + i, 0, "user", "One.") for i in range(60)]  # some of these lose their only row
    want = expected(rows)
    assert got(table(spark, rows)) == want
    assert any(w[6:] == ("", hashlib.sha256(b"").hexdigest()) and not any(w[:6]) for w in want.values())


def test_long_conversations_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_ROWS", 5)
    rows = conversations(random.Random(5), 4, 120) + [(77, t // 3, "user" if t % 2 else "assistant", "Again." if t % 5 else f"n {t}.") for t in range(300)]
    assert got(table(spark, rows)) == expected(rows)


def test_awkward(spark):
    assert got(table(spark, [])) == {}
    long = "word " * 100_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "Yes."), (None, None, None, None), (2, 5, "user", "Ä日本🙂."), (2, 5, "assistant", "Ja.")]
    assert got(table(spark, rows)) == expected(rows)
    text_ids = spark.createDataFrame([("a=b", 0, "user", "A.")], T.StructType.fromDDL("conv_id string, turn int, role string, text string"))
    assert set(got(text_ids)) == {"a=b"}


def test_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = repair.op12_interval_repair(spark, data)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in df.collect()} == expected(rows)


def test_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    want = con.sql(repair.SQL)
    df = repair.op12_interval_repair(spark, data)
    assert want.columns == df.columns and sorted(want.fetchall()) == sorted(tuple(r) for r in df.collect())
