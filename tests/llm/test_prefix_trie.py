import hashlib
import zlib
from random import Random

import pytest

from parley.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, path string, n long"


def brute(rows):
    """Nodes by a dictionary of prefixes."""
    own = {}
    for conv, turn, role, text in rows:
        own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode() if c is not None else b"") % 9
        path = tuple((own.get(c - c % 5, []) if c is not None else turns)[:h] + turns[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    least = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    kids, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            kids[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    for p, m in members.items():
        said = ",".join("" if c is None else str(c) for c in sorted(ends.get(p, []), key=lambda c: (c is not None, c or 0)))
        yield least[p], len(p), least[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(said.encode()).hexdigest()


def key(row):
    return tuple((x is not None, x) if not isinstance(x, str) else x for x in row)


def run(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(table))).collect()), key=key)


def want(rows):
    return sorted(brute(rows), key=key)


def odd_rows(n=150):
    pick, texts = Random(8), ["", None, "a", "b", "é", "long " * 40]
    rows = [(c, t if pick.random() < 0.95 else None, pick.choice(["user", "assistant", None]) if pick.random() < 0.2 else "user", texts[0] if t < 2 else pick.choice(texts)) for c in range(n) for t in range(pick.randrange(1, 7))]
    return rows + [(None, 1, "user", "a"), (None, None, None, None), (2**60, 5, "user", "b"), (7, 3, "user", "a")] * 2


def test_equals_a_dictionary_of_prefixes(spark):
    assert run(spark, odd_rows()) == want(odd_rows())


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_small_runs_and_any_ranges(spark, monkeypatch, ranges):
    """Every path in a run of few, ranges that cut through shared paths, joins by shuffle, ids in texts of two."""
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", 600)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    monkeypatch.setattr(prefix_trie.R, "SMALL", 0)
    whole, spread = prefix_trie.parts, []
    monkeypatch.setattr(prefix_trie, "parts", lambda runs, _: spread.append(1) or whole(runs, ranges))
    assert run(spark, odd_rows(), parts=7) == want(odd_rows()) and spread


def test_merging_compares_no_shared_symbol_twice(monkeypatch):
    symbol = lambda i: i.to_bytes(16, "big") + (1).to_bytes(8, "big")
    pick = Random(1)
    seqs = sorted({b"".join(symbol(pick.randrange(3)) for _ in range(pick.randrange(0, 30))) for _ in range(400)})
    dealt = [sorted(seqs[i::7]) for i in range(7)]
    streams = [[(0 if not i else prefix_trie.shared(own[i - 1], p, 0), p, 0, 1, "") for i, p in enumerate(own)] for own in dealt]
    asked, plain = [0], prefix_trie.shared
    monkeypatch.setattr(prefix_trie, "shared", lambda a, b, known: asked.__setitem__(0, asked[0] + plain(a, b, known) - known) or plain(a, b, known))
    out = list(prefix_trie.merged(streams))
    assert [r[1] for _, r in out] == seqs
    assert [h for h, _ in out] == [0] + [plain(a, b, 0) for a, b in zip(seqs, seqs[1:], strict=False)]
    assert asked[0] <= sum(len(s) // prefix_trie.SYMBOL for s in seqs)


def test_no_runs_and_one_run():
    assert list(prefix_trie.merged([[]])) == [] and list(prefix_trie.built([], 0)) == []
    assert [h for h, _ in prefix_trie.merged([[(0, b"", 1, 1, ""), (0, b"x" * 24, 1, 1, "")]])] == [0, 0]


def test_copies_a_long_conversation_and_no_rows(spark):
    rows = [(c, t, "user", "same " * 20) for c in range(3000) for t in range(2)] + [(5_000_000, t, "user", f"{t}") for t in range(5000)] + [(5_000_005, 0, "user", "x" * 2_000_000)]
    assert run(spark, rows) == want(rows)
    assert run(spark, []) == []


def test_query_on_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op13_prefix_trie(spark, sf).collect()), key=key) == want(rows)
