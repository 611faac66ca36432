import random
import sys

import public_tokenizers
import tiktoken

from parley.llm import bpe, queries

PATH = public_tokenizers.path(queries.RANKS)
RANKS = bpe.read_ranks(open(PATH).read())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_transducer_agrees_with_the_library():
    codec, rng = bpe.Codec(RANKS, public_tokenizers.PATTERN), random.Random(2)
    tokens = list(RANKS)
    texts = ["", "a" * 3000, " " * 500 + "x", "ab" * 700]
    texts += ["".join(rng.choice("abcdeéèüñ 中文字🙂́\n\t.'$%1") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    texts += [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 5))).decode("utf-8", "ignore") for _ in range(4000)]
    for text in texts:
        ids = codec.encode(text)
        assert ids.tolist() == LIBRARY.encode_ordinary(text)
        assert codec.decode(ids) == text


def test_full_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "STEPS", 50)
    monkeypatch.setattr(bpe, "PIECES", 5)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in ("unbelievable streaming transducers", "größere Häuser entstehen", "los niños pequeños") * 3:
        assert codec.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_stretches_lose_no_match_of_the_pattern():
    signs = [" ", " ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "a", "Zé", "中", "7", "²", ".", "'s", "'", "🙂", "\u0301", "\0"]
    split, rng = bpe.Codec(RANKS, public_tokenizers.PATTERN).split, random.Random(4)
    assert public_tokenizers.PATTERN == bpe.BY_WORDS
    assert not {c for c in map(chr, range(0x110000)) if bpe.regex.match(r"\s", c)} - {c for c in map(chr, range(0x110000)) if bpe.re.match(r"\s", c)}
    for _ in range(20_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert [m for part in bpe.STRETCH.findall(text) for m in split(part)] == split(text)


def test_the_pattern_sees_only_what_is_new():
    codec, seen = bpe.Codec(RANKS, public_tokenizers.PATTERN), []
    split = codec.split
    codec.split = lambda text: seen.append(len(text)) or split(text)
    text = "The same few words, again and again.\n" * 500
    assert codec.encode(text).tolist() == LIBRARY.encode_ordinary(text) and sum(seen) < 100


def test_new_words_are_read_together_and_not_split():
    codec, seen = bpe.Codec(RANKS, public_tokenizers.PATTERN), []
    split, codec.machine.read = codec.split, None
    codec.split = lambda text: seen.append(text) or split(text)
    rng = random.Random(5)
    words = ["".join(rng.choice("aeéßnrstqzÄ") for _ in range(rng.randint(2, 20))) for _ in range(3000)]
    texts = [" ".join(words[:1000]) + ".\nA" + ", ".join(words[1000:]) + "...", "", " " + words[7]]
    for got, text in zip(codec.encode_all(texts), texts, strict=True):
        assert got.tolist() == LIBRARY.encode_ordinary(text)
    assert sorted(seen) == ["\n", ",", ".", "..."]


def test_words_and_signs_are_cut_where_the_pattern_cuts_them():
    signs = [" ", " ", "\n", "\t", "\x1c", "\xa0", "a", "Zé", "ßÿ", "×", "ª", "µ", "\u0100", "д", "中", "7", "½", ".", "_", "~", "\x7f", "'", "'s", "'ll", "’", "🙂", "e\u0301", "\0"]
    split, rng = bpe.Codec(RANKS, public_tokenizers.PATTERN).split, random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        parts = bpe.STRETCH.findall(text)
        assert "".join(parts) == text and [m for part in parts for m in split(part)] == split(text)
        assert all(split(part) == [part] for part in parts if bpe.WORD.fullmatch(part))


def test_numbers_by_key_survive_growth_and_emptying():
    table, rng = bpe.Numbers(3000), random.Random(7)
    for size in (0, 1, 700, 2900, 5000, 40):
        keys = bpe.np.array([rng.randrange(9000) << rng.choice((0, 30)) for _ in range(size)], bpe.np.int64)
        for _ in range(2):
            assert table.find(keys, lambda k: k % 97).tolist() == [k % 97 for k in keys.tolist()]
        assert table.held == (table.keys >= 0).sum() <= 3000


def test_long_texts_are_looked_up_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 3)
    monkeypatch.setattr(bpe, "TOGETHER", 2)
    monkeypatch.setattr(bpe, "STRETCHES", 4)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    texts = ["", "Ein zzkwqx, zwei zzkwqx; 中文字a1b2c3 don't\n\n ende" * 4, "x", "", "zzkwqx " * 9 + "q" * 300]
    assert [x.tolist() for x in codec.encode_all(texts)] == [LIBRARY.encode_ordinary(x) for x in texts]
    assert max(map(len, (codec.stretches, codec.stretches.older))) <= 4


def test_beginnings_are_read_once(monkeypatch):
    machine, read = bpe.Transducer(RANKS), []
    whole = machine.read
    monkeypatch.setattr(machine, "read", lambda text, *rest: read.append(len(text)) or whole(text, *rest))
    monkeypatch.setattr(bpe, "HEADS", 2)
    pieces = [a + b for a in (" unbrot", " zzkwqx", " äöüß") for b in ("", "erk", "zzq" * 5, "é" * 300)]
    for piece in pieces * 2:
        assert machine.encode(piece.encode()) == LIBRARY._core_bpe.encode_single_piece(piece.encode())
    assert sum(read) < 2 * sum(len(p.encode()) for p in pieces) - 6 * bpe.HEAD


def test_utf8_machine_holds_back_cut_characters():
    text = "aé中🙂z"
    for size in (1, 2, 3):
        machine, raw = bpe.Utf8Machine(), text.encode()
        out = "".join(machine.feed(raw[i : i + size]) for i in range(0, len(raw), size)) + machine.feed(b"", last=True)
        assert out == text


def test_round_trip_in_spark(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Straße 🙂 naïve  text\n", "x"), (None, "a" * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    for r, (_, text, _) in zip(out, rows, strict=True):
        assert list(r.ids) == LIBRARY.encode_ordinary(text or "") and r.decoded == (text or "")
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_tables_of_texts_stay_small():
    codec = bpe.Codec({bytes((i,)): i for i in range(256)}, public_tokenizers.PATTERN)
    letters = str.maketrans("0123456789", "ghijklmnop")
    for n in range(0, 600_000, 1000):
        codec.encode("".join(f" {i:x}.".translate(letters) for i in range(n, n + 1000)))
    held = [x for known in (codec.pieces, codec.stretches) for x in (known, known.older)]
    assert sum(sys.getsizeof(x) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in x.items()) for x in held) < 65e6
