import hashlib
import heapq
import re
import zlib

from parley.llm import queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, at long, _rows string"
SPACE = "\x20\x09-\x0d"
FORM = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def cheapest(turns):
    """By search over (cost, edits, roles so far): the first that has the form wins. No dynamic program."""
    start = (0, "", 0, "")
    queue, seen = [start], set()
    while queue:
        cost, edits, i, roles = heapq.heappop(queue)
        if i == len(turns) and FORM.match(roles):
            return cost, edits
        tail = roles if len(roles) < 2 else (roles[:2] if roles[:2] in ("su", "ua") else "") + roles[-1]
        if (i, tail) in seen:
            continue
        seen.add((i, tail))
        for c in "ua":
            if FORM.match(roles + c) or FORM.match(roles + c + "a") or FORM.match(roles + c + "ua"):
                heapq.heappush(queue, (cost + 2, edits + "I", i, roles + c))
        if i < len(turns):
            role, fault = turns[i]
            heapq.heappush(queue, (cost + 3, edits + "D", i + 1, roles))
            if fault not in ("blank", "duplicate"):
                for edit, c, extra in (("K", role[:1], 0), ("R", "u", 2), ("R", "a", 2)):
                    if c and (FORM.match(roles + c) or FORM.match(roles + c + "a") or FORM.match(roles + c + "ua")):
                        heapq.heappush(queue, (cost + extra + (fault == "truncated"), edits + edit, i + 1, roles + c))


def brute(rows):
    """The contract, conversation by conversation."""
    convs = {r[0]: [] for r in rows}
    for r in damaged(rows):
        convs[r[0]].append(r)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in own:
            shown = re.sub(f"[{SPACE}]+\\Z", "", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        roles = [r[2][:1] for r in own]
        cost, edits = cheapest([(r[2], f) for r, f in zip(own, faults, strict=True)])
        lines, i, sofar = [], 0, ""
        for e in edits:
            new = "assistant" if sofar.endswith("u") else "user"
            if e == "I":
                lines.append(f"{new}:")
            if e in "KR":
                lines.append(f"{own[i][2] if e == 'K' else new}:{own[i][3]}")
            sofar += lines[-1][:1] if e != "D" else ""
            i += e != "I"
        turns = {r[1] for r in own} - {None}
        yield conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def run(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(parts)
    got = turn_repair.digests(table, *turn_repair.repair(turn_repair.damage(table)))
    return sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def want(rows):
    return sorted(brute(rows), key=lambda r: (r[0] is not None, r[0] or 0))


def odd_rows():
    from random import Random

    pick = Random(4)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "u", "As"], ["Yes.", "no", None, "", " \t\n", "One! ", "é?", "x\x1c", "Fine.\n\n"]
    return [(conv, turn if pick.random() < 0.9 else None, pick.choice(roles[: pick.choice((3, 8))]), pick.choice(texts)) for conv in range(60) for turn in range(pick.randrange(1, 9)) for _ in range(1 + (pick.random() < 0.1))]


def test_equals_search_on_odd_rows(spark):
    rows = odd_rows() + [(None, 1, "user", "Hi."), (None, None, None, None), (-3, 2**62, "user", "a."), (-3, -(2**61), "assistant", "b.")]
    assert run(spark, rows) == want(rows)


def test_pieces_change_nothing(spark, monkeypatch):
    rows = odd_rows() + [(77, t, ("user", "tool", "assistant", "system")[t * t % 7 % 4], f"Turn {t % 50}." if t % 3 else "cut") for t in range(300)]
    whole = run(spark, rows)
    monkeypatch.setattr(turn_repair, "PIECE_BITS", 1)
    assert run(spark, rows, parts=7) == whole == want(rows)


def test_edges_of_tables(spark):
    assert run(spark, []) == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(dropped, 0, "user", "Hi.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation_of_copies_and_a_long_text(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", "Same. " * (200_000 if t == 5 else 1)) for t in range(9000)] + [(2, 0, "user", "a.")] * 50
    got = run(spark, rows)
    assert [r[0] for r in got] == [1, 2] and got[1] == want(rows[9000:])[0]
    assert got[0][3] > 8000 and len(got[0][7]) >= 8000


def test_query_on_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op11_turn_repair(spark, sf).collect())) == want(rows)
