"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Reading tokens from every place of a piece at once is a non-deterministic machine. Of a set of open
readings only the longest beginning of a token matters, as the others are its ends; so these
beginnings are the states, made when they are first met. A state knows the tokens that may end
there, longest first, and the compiled merges decide which of them fits the token before it (exactly
one does). Pieces that are new are read together, a byte of all of them at a time, with steps and pairs
of tokens looked up in arrays; a long piece is read alone, and what all its open readings have in common
is settled and emitted after a bounded lookahead.
Decoding joins token bytes block by block; an incremental UTF-8 machine holds back the bytes of a
character that a block's end has cut.
"""

from __future__ import annotations

import base64
import re
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import words
from parley.session import ship

#: Entries at most of the tables of steps, of pairs of tokens, of pieces, and of stretches of text (two of each of the last).
STEPS, PAIRS, PIECES, STRETCHES = 300_000, 500_000, 50_000, 180_000
#: Bytes of a beginning whose readings are kept for other pieces, and how many are kept.
HEAD, HEADS = 5, 25_000
#: Bytes that are read before what is settled is emitted.
LOOKAHEAD = 256
#: Bytes of the longest pieces that are read together, how many pieces these are at most, and how many new texts are made at once.
SHORT, TOGETHER, AT_ONCE = 48, 16_384, 50_000
#: Tokens that are decoded at once.
BLOCK_TOKENS = 8192
#: A pattern no match of which goes on from another sign to a blank, or looks there for more than white space.
BY_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and other signs of which no version of Unicode tells otherwise.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: A word that one match of that pattern takes whole if no letter follows.
WORD = re.compile(f" ?[{LETTERS}]+")
#: Stretches of text: such words, signs before a word, a blank or the end of a line, the end of a line, or else all up to a blank that does not follow white space; matches of that pattern lie within them.
STRETCH = re.compile(rf"{WORD.pattern}(?![^\0-@\[-`{{-\x7f])| ?[{SIGNS}]+(?=[ \n{LETTERS}])|\n(?=[!-~])|.[^ ]*(?:(?<=\s) [^ ]*)*", re.DOTALL)


def read_ranks(text: str) -> dict[bytes, int]:
    """Ranks from the lines of a rank file: base64 of the token, blank, rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line.strip())}


class Numbers:
    """Numbers by key, in arrays that are probed for many keys at once; they grow up to ``most`` keys, then they are emptied."""

    def __init__(self, most: int):
        self.most = most
        self.empty(12)

    def empty(self, bits: int) -> None:
        self.bits, self.held = bits, 0
        self.keys, self.values = np.full(1 << bits, -1), np.zeros(1 << bits, np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray, make: Callable[[int], int]) -> np.ndarray:
        """The number of each key; ``make`` gives those that are not there."""
        at = self.places(keys)
        seen = self.keys[at]
        out, open_ = self.values[at], np.flatnonzero(seen != keys)
        new = []
        while len(open_):
            free = self.keys[at[open_]] < 0
            new.append(open_[free])
            open_ = open_[~free]
            at[open_] = at[open_] + 1 & len(self.keys) - 1
            same = self.keys[at[open_]] == keys[open_]
            out[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same]
        if new:
            rows = np.concatenate(new)
            fresh, back = np.unique(keys[rows], return_inverse=True)
            made = np.array([make(k) for k in fresh.tolist()], np.int32)
            out[rows] = made[back]
            self.put(fresh[: self.most], made[: self.most])
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that are not there, no more than the table takes."""
        if self.held + len(keys) > self.most:
            self.empty(self.bits)
        if 2 * (self.held + len(keys)) > len(self.keys):
            full = self.keys >= 0
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            self.empty((2 * len(keys)).bit_length())
        self.held += len(keys)
        at = self.places(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            put = self.keys[at] == keys
            self.values[at[put]] = values[put]
            at, keys, values = at[~put] + 1 & len(self.keys) - 1, keys[~put], values[~put]


class Transducer:
    """Encodes pieces; ``steps`` has for each state the states after a byte.

    A state stands for the longest end of what was read that a token begins with, so there are no
    more states than beginnings of tokens.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {token[:i] for token in ranks for i in range(1, len(token))}
        self.token = {rank: token for token, rank in ranks.items()}
        # for each token whether it may follow another one, and how many pairs these are
        self.fits: dict[int, dict[int, bool]] = {}
        self.n_fits = self.n_steps = 0
        self.split: dict[int, tuple[int, int] | None] = {}
        self.texts: list[bytes] = [b""]
        self.ending: list[tuple[tuple[int, int, dict[int, bool]], ...]] = [()]
        self.number: dict[bytes, int] = {b"": 0}
        self.steps: list[dict[int, int]] = [{}]
        self.heads: dict[bytes, tuple[int, list[int], list[int]]] = {}
        # for pieces that are read together: the same steps and pairs, the longest token that ends at a state, and for tokens their size and the longest token at their end
        self.after, self.pairs = Numbers(STEPS), Numbers(PAIRS)
        self.longest = np.full(1024, -1, np.int32)
        self.base = max(self.token, default=0) + 2
        self.size, self.shorter = np.zeros(self.base, np.int32), np.full(self.base, -1, np.int32)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
            self.shorter[rank] = next((ranks[token[i:]] for i in range(1, len(token)) if token[i:] in ranks), -1)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte or a token no merge makes."""
        if token not in self.split:
            text = self.token[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(x + y, token), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
                if best >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.split[token]

    def whole(self, token: int) -> bool:
        """Whether merges make this token at all."""
        return len(self.token[token]) == 1 or self.halves(token) is not None

    def fit(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: the start) in an encoding.

        The merges at the seam are undone, latest first; were two parts at the seam ever free at once
        whose own merge comes before they are used up, the pair could not have come about.
        """
        known = self.fits.setdefault(right, {})
        found = known.get(left)
        if found is None:
            if self.n_fits >= PAIRS:
                self.n_fits = 0
                for each in self.fits.values():
                    each.clear()
            self.n_fits += 1
            found = known[left] = self.agree(left, right)
        return found

    def agree(self, left: int, right: int) -> bool:
        return self.whole(right) and (left < 0 or self.whole(left) and self.apart(left, right))

    def apart(self, left: int, right: int) -> bool:
        used_left = used_right = 1 << 60
        while True:
            across = self.ranks.get(self.token[left] + self.token[right])
            if across is not None and across < used_left and across <= used_right:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                used_left, used_right, left = left, 1 << 60, a[1]
            else:
                used_left, used_right, right = 1 << 60, right, b[0]

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte; it is made if it is new."""
        text = self.texts[state] + bytes((byte,))
        while text and text not in self.prefixes and text not in self.ranks:
            text = text[1:]
        found = self.number.get(text)
        if found is None:
            found = self.number[text] = len(self.texts)
            self.texts.append(text)
            self.steps.append({})
            tokens = [self.ranks[text[i:]] for i in range(len(text)) if text[i:] in self.ranks]
            self.ending.append(tuple((t, len(self.token[t]), self.fits.setdefault(t, {})) for t in tokens))
            if found >= len(self.longest):
                self.longest = np.concatenate([self.longest, np.full(len(self.longest), -1, np.int32)])
            self.longest[found] = tokens[0] if tokens else -1
        if self.n_steps >= STEPS:
            self.n_steps = 0
            for each in self.steps:
                each.clear()
        self.n_steps += 1
        self.steps[state][byte] = found
        return found

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece; a piece that is itself a token is that token."""
        found = self.ranks.get(piece)
        if found is not None:
            return [found]
        if len(piece) <= HEAD:
            state, last, sizes = self.read(piece, 0, [-1], [0])
            return self.back(last, sizes, len(last) - 1)
        head = piece[:HEAD]
        begun = self.heads.get(head)
        if begun is None:
            if len(self.heads) >= HEADS:
                self.heads.clear()
            begun = self.heads[head] = self.read(head, 0, [-1], [0])
        state, last, sizes = begun[0], begun[1].copy(), begun[2].copy()
        out: list[int] = []
        for a in range(HEAD, len(piece), LOOKAHEAD):
            state, last, sizes = self.read(piece[a : a + LOOKAHEAD], state, last, sizes)
            if a + LOOKAHEAD < len(piece):
                base = self.settled(state, sizes)
                out += self.back(last, sizes, base)
                last, sizes = last[base:], [0, *sizes[base + 1 :]]
        return out + self.back(last, sizes, len(last) - 1)

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """The packed tokens of each piece."""
        out, open_ = [], []
        for i, piece in enumerate(pieces):
            found = self.ranks.get(piece)
            if found is None and len(piece) <= SHORT:
                open_.append(i)
                out.append(b"")
            else:
                out.append(array("i", self.encode(piece) if found is None else (found,)).tobytes())
        open_.sort(key=lambda i: -len(pieces[i]))
        for a in range(0, len(open_), TOGETHER):
            part = open_[a : a + TOGETHER]
            for i, ids in zip(part, self.read_all([pieces[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def read_all(self, pieces: list[bytes]) -> list[bytes]:
        """The packed tokens of pieces, longest first; they are read side by side."""
        n, sizes = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not n or not sizes[0]:
            return [b""] * n
        text, starts = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes
        # the token that ends at each place, of all pieces at this place together
        last, state = np.full((sizes[0] + 1) * n, -1, np.int32), np.zeros(n, np.int64)
        for i in range(sizes[0]):
            m = int(np.searchsorted(-sizes, -i))
            state = self.after.find(state[:m] << 8 | text[starts[:m] + i], self.step_of).astype(np.int64)
            rows, token = np.arange(m), self.longest[state]
            while len(rows):
                if token.min() < 0:
                    raise ValueError(f"no token ends after {self.texts[state[rows[token.argmin()]]]!r}")
                left = last[(i + 1 - self.size[token]) * n + rows]
                fine = self.pairs.find((left + np.int64(1)) * self.base + token, self.agree_of) > 0
                last[(i + 1) * n + rows[fine]] = token[fine]
                rows, token = rows[~fine], self.shorter[token[~fine]]
        rows, at, ways = np.flatnonzero(sizes), sizes[sizes > 0], []
        while len(rows):
            token = last[at * n + rows]
            ways.append((rows, token))
            at = at - self.size[token]
            rows, at = rows[at > 0], at[at > 0]
        counts = np.zeros(n, np.int64)
        for rows, _ in ways:
            counts[rows] += 1
        ends = np.cumsum(counts)
        ids = np.empty(ends[-1], np.int32)
        for back, (rows, token) in enumerate(ways):
            ids[ends[rows] - 1 - back] = token
        packed, stops = ids.tobytes(), (4 * ends).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def step_of(self, key: int) -> int:
        state, byte = key >> 8, key & 255
        found = self.steps[state].get(byte)
        return self.step(state, byte) if found is None else found

    def agree_of(self, key: int) -> bool:
        left, right = divmod(key, self.base)
        return self.agree(left - 1, right)

    def read(self, text: bytes, state: int, last: list[int], sizes: list[int]) -> tuple[int, list[int], list[int]]:
        """The state after ``text``; the token that ends at each place since the last settled one is
        added to ``last``, and its size to ``sizes``."""
        steps, ending, n = self.steps, self.ending, len(last)
        for byte in text:
            after = steps[state].get(byte)
            state = self.step(state, byte) if after is None else after
            for token, size, known in ending[state]:
                # a longer token would begin before the last settled place
                if size > n:
                    continue
                left = last[n - size]
                fine = known.get(left)
                if fine or fine is None and self.fit(left, token):
                    last.append(token)
                    sizes.append(size)
                    break
            else:
                raise ValueError(f"no token ends after {self.texts[state]!r}")
            n += 1
        return state, last, sizes

    def settled(self, state: int, sizes: list[int]) -> int:
        """The last place that all readings which can still go on share."""
        text, base = self.texts[state], len(sizes) - 1
        for size in range(min(len(text), len(sizes) - 1), 0, -1):
            if text[len(text) - size :] in self.prefixes:
                other = len(sizes) - 1 - size
                while base != other:
                    if base > other:
                        base -= sizes[base]
                    else:
                        other -= sizes[other]
        return base

    @staticmethod
    def back(last: list[int], sizes: list[int], at: int) -> list[int]:
        """The tokens on the way to place ``at``."""
        out = []
        while at:
            out.append(last[at])
            at -= sizes[at]
        return out[::-1]


class Utf8Machine:
    """Turns chunks of bytes into text; an unfinished character waits for the next chunk."""

    def __init__(self):
        self.held = b""

    def feed(self, chunk: bytes, last: bool = False) -> str:
        chunk = self.held + chunk
        cut = len(chunk)
        for back in range(1, min(3, len(chunk)) + 1):
            byte = chunk[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                cut = len(chunk) - back if need > back else cut
                break
            if byte < 0x80:
                break
        cut = len(chunk) if last else cut
        self.held = chunk[cut:]
        return chunk[:cut].decode("utf-8", "replace")


class Known(dict):
    """Packed ids of texts that were met; a full table becomes the older one, so two are held at most."""

    def __init__(self, make: Callable[[list[str]], dict[str, bytes]], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def of(self, many: Iterable[list[str]]) -> Iterator[list[bytes]]:
        """The packed ids of each text, list by list; what was not met before is made together."""
        held, n = [], 0
        for texts in many:
            found = list(map(self.get, texts, texts))
            gaps = [i for i, x in enumerate(found) if x.__class__ is str]
            held.append((found, gaps))
            n += len(gaps)
            if n >= AT_ONCE:
                yield from self.filled(held)
                held, n = [], 0
        yield from self.filled(held)

    def filled(self, held: list[tuple[list[bytes | str], list[int]]]) -> list[list[bytes]]:
        missed = [found[i] for found, gaps in held for i in gaps]
        ids = list(map(self.older.get, missed, missed))
        made = self.make(list({x for x in ids if x.__class__ is str}))
        ids = [made[x] if x.__class__ is str else x for x in ids]
        each = iter(ids)
        for found, gaps in held:
            for i in gaps:
                found[i] = next(each)
        if len(self) + len(missed) > self.most:
            self.older = dict(self)
            self.clear()
        self.update(islice(zip(missed, ids, strict=True), self.most))
        for text in made:
            if len(text) > 64:
                self.pop(text, None)
        return [found for found, _ in held]


class Codec:
    """Encodes and decodes whole texts by the ranks and the splitting pattern.

    Where the pattern allows it, a text is cut into words, signs and other stretches first, and only
    stretches that were not met before are read, all those of some texts together; the pattern splits
    what is not a word.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pieces = Known(self.encode_pieces, PIECES)
        self.stretches = Known(self.by_pieces, STRETCHES)
        self.cut, self.known = (STRETCH.findall, self.stretches) if pattern == BY_WORDS else (self.split, self.pieces)

    def by_pieces(self, stretches: list[str]) -> dict[str, bytes]:
        """The packed ids of stretches; a word is one piece, all others are split by the pattern."""
        made = self.encode_pieces([t for t in stretches if WORD.fullmatch(t)])
        rest = [t for t in stretches if t not in made]
        split = [self.split(t) for t in rest]
        pieces = list(chain.from_iterable(split))
        packed = chain.from_iterable(self.pieces.of(pieces[a : a + AT_ONCE] for a in range(0, len(pieces), AT_ONCE)))
        made.update((t, b"".join(islice(packed, len(x)))) for t, x in zip(rest, split, strict=True))
        return made

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        return dict(zip(pieces, self.machine.encode_all([p.encode() for p in pieces]), strict=True))

    @cached_property
    def machine(self) -> Transducer:
        return Transducer(self.ranks)

    @cached_property
    def table(self) -> np.ndarray:
        """The bytes of each token by its rank; None where there is none."""
        out = np.full(max(self.ranks.values(), default=-1) + 1, None, object)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        counts = []

        def lists() -> Iterator[list[str]]:
            for text in texts:
                parts = self.cut(text)
                counts.append(-(-len(parts) // AT_ONCE))
                for a in range(0, len(parts), AT_ONCE):
                    yield parts[a : a + AT_ONCE]

        packed = map(b"".join, list(self.known.of(lists())))
        return [np.frombuffer(b"".join(islice(packed, n)), np.int32) for n in counts]

    def decode(self, ids: np.ndarray) -> str:
        machine, out = Utf8Machine(), []
        # unsigned, as a negative id is no token
        ids = np.asarray(ids, np.int32).view(np.uint32)
        for a in range(0, len(ids), BLOCK_TOKENS):
            out.append(machine.feed(b"".join(self.table[ids[a : a + BLOCK_TOKENS]].tolist())))
        return "".join(out) + machine.feed(b"", last=True)


_codecs: dict[str, Codec] = {}


def _codec(held, pattern: str) -> Codec:
    """One codec for each worker and broadcast table."""
    if held.id not in _codecs:
        _codecs.clear()
        _codecs[held.id] = Codec(read_ranks(held.value), pattern)
    return _codecs[held.id]


class _Shared:
    """The rank file, sent once to each executor; its size is that of one vocabulary."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="ascii") as lines:
            self.sent = spark.sparkContext.broadcast(lines.read())
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> str:
        return self.sent.value


def _encoded(shared: _Shared, pattern: str, at: int, names: list[str], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with one more column: the ids of the texts in column ``at``."""
    codec = _codec(shared, pattern)
    for batch in batches:
        for rows, values in words.sliced(batch, at):
            ids = codec.encode_all([v.decode("utf-8", "replace") for v in values])
            ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*rows.columns, column], names)


def _decoded(shared: _Shared, pattern: str, at: int, names: list[str], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with one more column: the texts of the ids in column ``at``."""
    codec = _codec(shared, pattern)
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            rows = batch.slice(a, 256)
            out = [codec.decode(x.values.to_numpy() if x.is_valid else np.empty(0, np.int32)) for x in rows.column(at)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.string())], names)


def _ids_field(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType(), False))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text; null and empty texts have none.

    A column named ``ids_col`` is replaced; all other columns, repeated rows and null ids stay, and
    an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    shared, rest = _Shared(docs.sparkSession, ranks_path), docs.drop(ids_col)
    schema = T.StructType([*rest.schema.fields, _ids_field(ids_col)])
    at = rest.columns.index(text_col)
    return rest.mapInArrow(lambda batches: _encoded(shared, pattern, at, schema.names, batches), schema)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of each list of ids; a null list gives an empty text.

    A column named ``text_col`` is replaced; other columns and repeated rows stay.
    """
    ship(tokens.sparkSession)
    shared, rest = _Shared(tokens.sparkSession, ranks_path), tokens.drop(text_col)
    schema = T.StructType([*rest.schema.fields, T.StructField(text_col, T.StringType())])
    at = rest.columns.index(ids_col)
    return rest.mapInArrow(lambda batches: _decoded(shared, pattern, at, schema.names, batches), schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` in one pass, so that a task has one worker and one set of tables.

    Columns named ``ids_col`` and ``decoded_col`` are replaced; edges as in both.
    """
    ship(docs.sparkSession)
    shared, rest = _Shared(docs.sparkSession, ranks_path), docs.drop(ids_col, decoded_col)
    schema = T.StructType([*rest.schema.fields, _ids_field(ids_col), T.StructField(decoded_col, T.StringType())])
    at, names = rest.columns.index(text_col), schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(shared, pattern, len(names) - 2, names, _encoded(shared, pattern, at, names[:-1], batches))

    return rest.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    Null texts count as empty; null and repeated ids stay; other columns are not looked at.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    both = round_trip(slim, ranks_path, pattern, "_text", "_ids", "_back")
    return both.select("_id", F.size("_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("_ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("_back", 256).alias("decoded_sha256"))
