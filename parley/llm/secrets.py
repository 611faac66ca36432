"""Secret scans: candidates by pattern, judged by a random forest trained on labelled findings.

Candidates come from patterns over whole texts and reach to the end of their run of token characters,
however long it is; they may overlap, and what is accepted of them is joined. Their features are
length, character transitions, dictionary coverage, the path (source) they come from, and words
before and after. The dictionary is the most frequent words of the documents, counted over all of
them. The forest is grown here from findings with labels that a seeded generator writes down (see
``labelled``), and removes false positives.
"""

from __future__ import annotations

import base64
import random
import re
import string
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import words
from parley.session import cut, ship

#: Trees, their depth, least findings in a leaf, and labelled findings that a forest is grown from.
TREES, DEPTH, LEAF, FINDINGS = 31, 9, 4, 4000
#: Bytes before and after a candidate whose words count as its surroundings.
AROUND = 48
#: Words of the dictionary at most, and letters of each at least and at most.
DICTIONARY, LETTERS = 5000, (3, 24)
#: Bytes of a value that are counted at once.
BLOCK = 1 << 20

#: Prefixes of public token formats, and words that stand before a secret.
_NAME = rb"(?i:(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)"
KINDS = (
    ("cloud key id", rb"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("code host token", rb"\b(?:gh[pousr]_[A-Za-z0-9]{20}[\w-]*+|glpat-[\w-]{20,}+)"),
    ("chat token", rb"\bxox[abprs]-[A-Za-z0-9-]{10}[\w-]*+"),
    ("api key", rb"\b(?:sk|pk|rk)[-_][\w-]{20,}+"),
    ("signed token", rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    ("private key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]*PRIVATE KEY-----"),
    ("assigned", _NAME + rb"(?P<value>[^\s\"'<>,;]{6,}+)"),
    ("long word", rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_=-])"),
)
ASSIGNED, LONG = len(KINDS) - 2, len(KINDS) - 1
HINTS = frozenset(b"password passwd passphrase pwd secret token key apikey auth bearer credential credentials login private".split())
DECOYS = frozenset(b"commit sha sha1 sha256 md5 checksum digest uuid guid example sample placeholder dummy changeme order isbn version hash id".split())
SYLLABLES = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ei ie un au qu la el os ci ue ll ai eu pa ab ad us".split())

FOUND = "array<struct<kind:string,start:int,end:int,score:double>>"
_PREFIXED = re.compile(b"|".join(b"(?P<k%d>%s)" % (i, p) for i, (_, p) in enumerate(KINDS[:ASSIGNED])))
_ASSIGNED, _LONG, _NAMES = re.compile(KINDS[ASSIGNED][1]), re.compile(KINDS[LONG][1]), re.compile(_NAME)
_HINT = re.compile(rb"(?i)pass|pwd|secret|token|key|auth|AKIA|ASIA|gh[pousr]_|glpat|xox|sk[-_]|pk[-_]|rk[-_]|eyJ|-----BEGIN|[A-Za-z0-9+/_-]{24}")
_WORDS = re.compile(rb"[A-Za-z]+")
_RUNS = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+")


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> frozenset[bytes]:
    """The words of A-Z, lower-cased, that most documents have; whole texts of all documents count.

    Words of one document are no words. Null texts have none; ties go by the alphabet.
    """
    own = F.array_distinct(F.split(F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), "[^a-z]+"))
    each = docs.select(F.explode(own).alias("_word")).where(F.char_length("_word").between(*LETTERS))
    often = each.groupBy("_word").agg(F.count("*").alias("_n")).where("_n > 1")
    return frozenset(r[0].encode() for r in cut(often.orderBy(F.desc("_n"), "_word").limit(size)).select("_word").collect())


def coverage(value: bytes, known: frozenset[bytes]) -> float:
    """Share of a value that is words of the dictionary; marks, digits and capitals divide words."""
    return sum(len(w) for w in _RUNS.findall(value) if len(w) >= LETTERS[0] and w.lower() in known) / len(value)


def candidates(text: bytes) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of what may be a secret, in bytes; an assignment counts without its name.

    Kinds are looked for one by one, so what is rejected in the end hides nothing inside it. A value
    with more assignments in it counts as a whole and by its parts.
    """
    if not _HINT.search(text):
        return
    for m in _PREFIXED.finditer(text):
        yield int(m.lastgroup[1:]), *m.span()
    for m in _ASSIGNED.finditer(text):
        start, end = m.span("value")
        yield ASSIGNED, start, end
        at = start
        for name in _NAMES.finditer(text, start, end):
            if name.start() - at >= 6:
                yield ASSIGNED, at, name.start()
            at = name.end()
        if at > start and end - at >= 6:
            yield ASSIGNED, at, end
    for m in _LONG.finditer(text):
        yield LONG, *m.span()


def joined(hits: Iterable[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Accepted (kind, start, end, score) in text order; overlapping ones are one, named as the longest."""
    out: list[list] = []
    for kind, start, end, score in sorted(hits, key=lambda h: (h[1], -h[2], h[0] != ASSIGNED, h[0])):
        if out and start < out[-1][2]:
            last = out[-1]
            if end - start > last[4]:
                last[0], last[3], last[4] = kind, score, end - start
            last[2] = max(last[2], end)
        else:
            out.append([kind, start, end, score, end - start])
    return [tuple(h[:4]) for h in out]


_CLASS = np.full(256, 3, np.uint8)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91] = 0, 1, 2
_KNOWN = np.zeros(1 << 16, bool)
_KNOWN[[ord(p[0]) << 8 | ord(p[1]) for p in SYLLABLES]] = True


def _counts(value: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a value: how often each byte and each step between classes comes, and how many pairs are known."""
    raw, low = np.frombuffer(value, np.uint8), np.frombuffer(value.lower(), np.uint8)
    each, steps, known = np.zeros(256, np.int64), np.zeros(16, np.int64), 0
    for at in range(0, len(raw), BLOCK):
        each += np.bincount(raw[at : at + BLOCK], minlength=256)
        kinds = _CLASS[raw[at : at + BLOCK + 1]]
        steps += np.bincount(kinds[:-1] * 4 + kinds[1:], minlength=16)
        pairs = low[at : at + BLOCK + 1].astype(np.uint16)
        known += int(_KNOWN[pairs[:-1] << 8 | pairs[1:]].sum())
    return each, steps, known


def features(text: bytes, kind: int, start: int, end: int, path: str, words_: frozenset[bytes] = frozenset()) -> list[float]:
    """What the forest sees of one candidate."""
    value = text[start:end]
    n = len(value)
    each, steps, known = _counts(value)
    share = np.bincount(_CLASS, each, minlength=4) / n
    rate = each[each > 0] / n
    lower = value.lower()
    before = {w.lower() for w in _WORDS.findall(text[max(0, start - AROUND) : start])}
    after = {w.lower() for w in _WORDS.findall(text[end : end + AROUND])}
    hexed = float(bool(re.fullmatch(rb"[0-9a-fA-F-]+", value)))
    dashed = float(value.count(b"-") == 4 and n == 36)
    code = float(bool(re.search(r"(?i)conf|env|\.ya?ml|\.json|\.py|\.js|deploy|secret", path)))
    test = float(bool(re.search(r"(?i)test|example|doc|sample", path)))
    near = text[max(0, start - 3) : start]
    return [kind, n, -float((rate * np.log2(rate)).sum()), *steps / max(1, n - 1), *share, known / max(1, n - 1), coverage(value, words_), max(each) / n, hexed, dashed, code, test, len(before & HINTS), len(before & DECOYS), len(after & HINTS), len(after & DECOYS), float(b"=" in near or b":" in near), float(any(d in lower for d in (b"example", b"xxxx", b"changeme", b"placeholder", b"1234567890", b"your")))]


@dataclass
class Forest:
    """Trees as arrays (feature, bound, left and right child, share of secrets in a node), and the
    dictionary they were grown with."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    known: frozenset[bytes] = frozenset()

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, bound, left, right, share in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                down = left[node] >= 0
                go = x[np.arange(len(x)), feature[node]] <= bound[node]
                node = np.where(down, np.where(go, left[node], right[node]), node)
            total += share[node]
        return total / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Forest:
    """Bootstrap samples, a random third of the features at each node, splits by Gini impurity."""
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES):
        rows: list[list[float]] = []

        def node(at: np.ndarray, depth: int, rows: list = rows) -> int:
            own = len(rows)
            rows.append([0, 0.0, -1, -1, float(y[at].mean())])
            if depth == DEPTH or len(at) < 2 * LEAF or rows[own][4] in (0.0, 1.0):
                return own
            best = (np.inf, 0, 0.0)
            for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
                order = np.argsort(x[at, f], kind="stable")
                v, ones = x[at, f][order], np.cumsum(y[at][order])
                k = np.flatnonzero((v[1:] > v[:-1]) & (np.arange(1, len(v)) >= LEAF) & (np.arange(1, len(v)) <= len(v) - LEAF))
                if len(k):
                    a, p = k + 1, ones[k]
                    b, q = len(v) - a, ones[-1] - p
                    cost = p * (a - p) / a + q * (b - q) / b
                    i = int(np.argmin(cost))
                    if cost[i] < best[0]:
                        best = float(cost[i]), int(f), float((v[k[i]] + v[k[i] + 1]) / 2)
            if best[0] < np.inf:
                go = x[at, best[1]] <= best[2]
                rows[own][:2] = best[1], best[2]
                rows[own][2] = node(at[go], depth + 1)
                rows[own][3] = node(at[~go], depth + 1)
            return own

        node(rng.integers(0, len(y), len(y)), 0)
        a = np.array(rows)
        trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return Forest(trees)


def labelled(count: int = FINDINGS, seed: int = 23, known: frozenset[bytes] = frozenset()) -> list[tuple[bytes, int, int, int, str, int]]:
    """Findings (text, kind, start, end, path, secret or not) from written-out patterns of use.

    Their plain words come from the dictionary, if there is one, and from frequent pairs of letters.
    """
    rng = random.Random(seed)
    pool = string.ascii_letters + string.digits
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower = sorted(SYLLABLES)
    common = sorted(w.decode() for w in known)
    made = lambda a, b: "".join(rng.choice(lower) for _ in range(rng.randint(a, b)))
    word = lambda a=2, b=5: rng.choice(common) if common and b < 10 and rng.random() < 0.7 else made(a, b)
    size = lambda: int(10 ** rng.uniform(1.9, 3.6))
    plain = lambda: " ".join(word() for _ in range(rng.randint(2, 7)))
    true = (
        lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
        lambda: rng.choice(("ghp_", "gho_", "ghs_")) + some(pool, 36),
        lambda: "xoxb-" + some(string.digits, 11) + "-" + some(pool, 24),
        lambda: rng.choice(("sk-", "sk_live_", "pk_live_")) + some(pool, rng.randint(24, 48)),
        lambda: "eyJ" + some(pool, 20) + "." + some(pool + "-_", 60) + "." + some(pool + "-_", 43),
        lambda: rng.choice(("password=", "pwd: ", "passwd = ", "secret=", "auth: ")) + rng.choice(("", '"')) + some(rng.choice((pool, pool + "!@#$%", "0123456789abcdef")), rng.randint(8, 40)),
        lambda: rng.choice(("token = ", "api_key: ", "access-key=", "token=")) + rng.choice(("", '"')) + some(rng.choice(("0123456789abcdef", pool)), rng.choice((16, 18, 20, 32, 40, 64))),
        lambda: rng.choice(("bearer ", "private key ", "credential ")) + base64.b64encode(rng.randbytes(rng.randint(24, 60))).decode(),
        lambda: rng.choice(("token=", "aws_session_token=", "secret: ", "auth = ")) + some(rng.choice((pool, pool + "+/", "0123456789abcdef")), size()),
        lambda: rng.choice(("bearer ", "private key ", "credential ", "")) + some(rng.choice((pool, pool + "+/", pool + "-_")), size()),
        lambda: rng.choice(("bearer ", "token ", "credential ", "password=", "token: ")) + some(string.ascii_letters, rng.choice((24, 32, 40, 64, size()))),
        lambda: rng.choice(("sk-proj-", "sk-ant-", "ghp_", "xoxb-", "glpat-")) + some(pool, 20) + some(pool + "-_", rng.choice((4, 40, size()))),
        lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(some(pool + "+/", 64) for _ in range(rng.choice((6, 25, 50, 200)))) + "\n-----END RSA PRIVATE KEY-----",
    )
    false = (
        lambda: rng.choice(("commit ", "sha1 ", "sha256 checksum ", "md5 digest ", "hash ")) + some("0123456789abcdef", rng.choice((32, 40, 64))),
        lambda: rng.choice(("uuid ", "id ", "guid: ")) + str(uuid.UUID(int=rng.getrandbits(128))),
        lambda: "/".join(word() for _ in range(rng.randint(5, 9))) + f"/{rng.randint(1, 99)}",
        lambda: rng.choice(("password=", "token: ", "secret = ", "pwd=")) + rng.choice(("changeme", "example", "xxxxxxxxxxxx", "your_token_here", "placeholder", "<password>", "${SECRET}", "********", "os.environ", "getpass()", "request.token", "required", "undefined")),
        lambda: rng.choice(("token: ", "key: ", "password: ", "secret: ", "auth: ")) + word(3, 6) + rng.choice((".", "")),
        lambda: "_".join(word() for _ in range(rng.randint(5, 8))) + str(rng.randint(0, 9)),
        lambda: "order " + some(string.digits, rng.randint(24, 30)),
        lambda: "AKIA" + rng.choice(("IOSFODNN7EXAMPLE", "EXAMPLEEXAMPLE12", "XXXXXXXXXXXXXXXX")),
        lambda: "sk-" + rng.choice(("your_api_key_here_placeholder", "xxxxxxxxxxxxxxxxxxxxxxxxxxxx")),
        lambda: "-".join(word() for _ in range(rng.randint(5, 9))) + f"-{rng.randint(1, 999)}",
        lambda: (word(12, 14) + str(rng.randint(1, 9)))[:60],
        lambda: word() + "".join(word().capitalize() for _ in range(rng.randint(4, 8))) + rng.choice(("", "", "2", "V3")),
        lambda: rng.choice("/-_").join(word(1, 4) for _ in range(rng.choice((4, 6, 9, 40, size() // 8)))),
        lambda: word(10, 14),
        lambda: rng.choice(("-", "_", "=-", "/", "+-", "a", "ha", "xo", "no", "0")) * rng.choice((30, 60, 100, size())),
        lambda: rng.choice(("token: ", "auth=", "password: ")) + rng.choice("/.&-_").join(word() for _ in range(rng.choice((4, 20, size() // 8)))),
    )
    out = []
    while len(out) < count:
        secret = rng.random() < 0.5
        text = f"{plain()} {rng.choice(true if secret else false)()} {plain()}".encode()
        path = rng.choice(("config/app.env", "deploy.yaml", "src3", "src17", "docs/readme.md", "test/sample.py", "web", "notes.txt"))
        out += [(text, k, a, b, path, int(secret)) for k, a, b in candidates(text)]
    return out[:count]


def train(findings: list[tuple[bytes, int, int, int, str, int]] | None = None, known: frozenset[bytes] = frozenset()) -> Forest:
    """A forest from labelled findings and a dictionary; without findings, from the written-out ones."""
    findings = labelled(known=known) if findings is None else findings
    x = np.array([features(t, k, a, b, p, known) for t, k, a, b, p, _ in findings], float)
    out = grow(x, np.array([f[-1] for f in findings], float))
    out.known = known
    return out


def scan(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str = "source", least: float = 0.5, found: str = "findings") -> DataFrame:
    """``docs`` with an array of findings (kind, start and end in code points, score) per row.

    Whole texts are read; null and empty texts have no findings, a null or missing path is empty, and
    a column named ``found`` is replaced. Candidates below ``least`` are false positives.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(forest)
    rest = docs.drop(found)
    has_path = path_col in rest.columns
    schema = T.StructType([*rest.schema.fields, *T.StructType.fromDDL(f"f {FOUND}").fields])
    schema.fields[-1].name = found
    schema.names[-1] = found
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def judge(rows: pa.RecordBatch, values: list[bytes]) -> Iterator[pa.RecordBatch]:
        paths = rows.column(rows.schema.get_field_index(path_col)).to_pylist() if has_path else [""] * len(values)
        hits = [(i, *c) for i, v in enumerate(values) for c in candidates(v)]
        cells: list[list[dict]] = [[] for _ in values]
        if hits:
            score = held.value.score(np.array([features(values[i], k, a, b, str(paths[i] or ""), held.value.known) for i, k, a, b in hits], float))
            kept: dict[int, list] = {}
            for (i, k, a, b), s in zip(hits, score.tolist(), strict=True):
                if s >= least:
                    kept.setdefault(i, []).append((k, a, b, s))
            for i, own in kept.items():
                at = point = 0
                for k, a, b, s in joined(own):
                    start = point + len(values[i][at:a].decode("utf-8", "replace"))
                    at, point = b, start + len(values[i][a:b].decode("utf-8", "replace"))
                    cells[i].append({"kind": KINDS[k][0], "start": start, "end": point, "score": round(s, 6)})
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells, kind)], schema.names)

    return rest.mapInArrow(lambda batches: words.by_batch(judge, batches, text_col), schema)


def redact(text_col: str = "text", found: str = "findings", mark: str = "[secret]"):
    """The text with every finding replaced by ``mark``; findings are sorted and do not overlap."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, f: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, f["start"] - acc["at"]), F.lit(mark)).alias("out"), f["end"].alias("at"))
    return F.aggregate(F.col(found), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
