import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumark.llm import repair as R
from vellumark.llm.queries import op13_repair

STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(codes):
    """Cost, least audit and its roles by Dijkstra over (turns done, state), each label with its audit."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, k, state, roles = heapq.heappop(queue)
        if k == len(codes) and state in ("", "a"):
            return cost, audit, roles
        if (k, state) in done:
            continue
        done.add((k, state))
        for letter in "ua":
            if (state, letter) in STEPS:
                heapq.heappush(queue, (cost + 3, audit + "I", k, letter, (*roles, letter)))
        if k < len(codes):
            heapq.heappush(queue, (cost + 4, audit + "D", k + 1, state, roles))
            code = codes[k]
            if code != "x":
                more = 3 if code.isupper() or code == "_" else 0
                if (state, code.lower()) in STEPS:
                    heapq.heappush(queue, (cost + more, audit + "K", k + 1, STEPS[state, code.lower()], (*roles, code.lower())))
                for letter in "ua":
                    if (state, letter) in STEPS:
                        heapq.heappush(queue, (cost + 3 + more, audit + "R", k + 1, letter, (*roles, letter)))
    raise AssertionError


@settings(max_examples=400, deadline=None)
@given(st.text("suaSUA-_x", max_size=14))
def test_layers_find_the_cheapest_least_audit(codes):
    cost, audit, roles = cheapest(codes)
    got, letters = R.solve(codes)
    assert (got, "".join(letters)) == (cost, audit)
    made, _ = R._apply(letters, [{"s": "s", "u": "u", "a": "a"}.get(c.lower(), "-") for c in codes], [""] * len(codes))
    assert tuple(m[0] for m in made) == roles


def brute(rows):
    """The query's contract, conversation by conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        row = (turn, "user" if fault == 4 else role, text)
        kept += [] if fault == 0 else [row, row] if fault == 3 else [row]
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, codes, n = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in kept:
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
            codes += "x" if fault in ("b", "d") else ("_" if initial == "-" else initial.upper()) if fault else initial
        cost, audit, roles = cheapest(codes)
        it, names = iter(roles), {"u": "user", "a": "assistant"}
        k, parts = 0, []
        for edit in audit:
            if edit == "I":
                parts.append(f"{names[next(it)]}:")
                continue
            if edit != "D":
                to = next(it)
                parts.append(f"{kept[k][1] if edit == 'K' else names[to]}:{kept[k][2]}")
            k += 1
        initials = [r[1][:1] for r in kept]
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["b"], n["d"], n["t"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(parts).encode()).hexdigest())
    return out


def digest(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, gone string, part int").repartition(parts)
    out = R.digest(R.repair(*R.damage(df))).collect()
    assert len(out) == len({r.conv_id for r in out})
    return {r.conv_id: tuple(r)[1:] for r in out}


def test_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/../sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in op13_repair(spark, f"{sf}/../sf0.01").collect()}
    assert got == brute(rows)


def made(n, longest, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " ", "Well, then!", "And now?", "it ends", None]
    return [(conv, rng.choice([turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts) if rng.random() < 0.5 else f"Text {turn}{rng.choice('.!? x')}") for conv in [*range(n), None] for turn in range(rng.randrange(longest))]


def test_any_conversations(spark):
    rows = made(60, 12, 1)
    assert digest(spark, rows) == brute(rows)


@pytest.mark.parametrize("chunk", [3, 64])
def test_long_conversations_are_cut(spark, monkeypatch, chunk):
    """Chunks of few rows and many partitions give what whole conversations do; repeats are found across chunks."""
    rows = made(5, 300, 2) + [(1000 + k, t, r, x) for k, (_, t, r, x) in enumerate(made(1, 40, 3))]
    rows += [(77, k, "user" if k % 2 else "assistant", f"turn {k % 90}.") for k in range(1500)]
    source = (R.CHUNK_ROWS, R.CHUNK_BYTES)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sweep = R._sweep

        def small(batches):
            R.CHUNK_ROWS = chunk
            try:
                yield from sweep(batches)
            finally:
                R.CHUNK_ROWS = source[0]

        monkeypatch.setattr(R, "_sweep", small)
        repaired = R.repair(*R.damage(df))
        pieces = repaired.pieces.groupBy("conv_id").count().where("count > 3").count()
        got = {r.conv_id: tuple(r)[1:] for r in R.digest(repaired).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert pieces >= (5 if chunk == 3 else 1)
    assert got == brute(rows)


def test_turns_and_edges(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (2, 0, "assistant", "Alone."), (3, None, None, None), (4, 0, "user", "A " * 200_000 + "."), (4, 1, "assistant", "Ok.")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    repaired = R.repair(df)
    out = {(r.conv_id, r.part, r.seq, r.pos): (r.role, r.text) for r in repaired.turns().collect()}
    of = lambda c: [out[k] for k in sorted(k for k in out if k[0] == c)]
    assert of(1) == [("user", "Hi."), ("assistant", "Ho.")] and of(2) == [("user", ""), ("assistant", "Alone.")] and of(3) == []
    assert of(4) == [(r[2], r[3]) for r in rows[4:]]
    empty = R.repair(df.limit(0))
    assert R.digest(empty).count() == 0 and empty.turns().count() == 0
    same = [(9, 1, "user", "Same.")] * 50 + [(9, 2, "assistant", "Fine.")] * 50
    assert digest(spark, same) == brute(same)
