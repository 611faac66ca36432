"""Text expressions: normal forms, word overlap, duplicate tests, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.vector import let

#: Words of three and four letters that say little.
COMMON = ("the", "and", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "day", "get", "has", "him", "how", "may", "new", "now", "old", "see", "two", "way", "who", "boy", "did", "its", "let", "put", "say", "she", "too", "use")


def words(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def normalize(text: Column) -> Column:
    """Lower case, letters and digits only, single blanks."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", "")
    return F.array_join(words(kept), " ")


def tokens(text: Column) -> Column:
    """Lower-cased words without other signs inside; empty ones are dropped."""
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")


def trigrams(ws: Column) -> Column:
    """Three consecutive words joined by blanks, in order."""

    def build(x: Column) -> Column:
        n = F.greatest(F.size(x) - 2, F.lit(0))
        two = F.zip_with(F.slice(x, 1, n), F.slice(x, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.zip_with(two, F.slice(x, 3, n), lambda a, b: F.concat(a, F.lit(" "), b))

    return let(ws, build)


def semantic_key(normal: Column) -> Column:
    """What two texts must share to count as the same: word trigrams, words, bytes in tens."""
    counts = lambda ws: F.concat_ws("|", F.array_join(trigrams(ws), "/"), F.size(ws).cast("string"))
    return F.concat_ws("|", let(words(normal), counts), (F.octet_length(normal) / 10).cast("int").cast("string"))


def rarity(word: Column) -> Column:
    """Weight of a word by its bytes; frequent short words weigh least."""
    size = F.octet_length(word)
    return F.when(size <= 2, 0.1).when(size <= 4, F.when(word.isin(*COMMON), 0.2).otherwise(0.8)).when(size <= 7, 1.0).otherwise(1.2)


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the weight of ``a``'s words that ``b`` has too (not symmetric)."""
    total = F.aggregate(a, F.lit(0.0), lambda s, w: s + rarity(w))
    common = F.aggregate(F.filter(a, lambda w: F.array_contains(b, w)), F.lit(0.0), lambda s, w: s + rarity(w))
    return F.when(total > 0, common / total).otherwise(0.0)


def length_similarity(a: Column, b: Column) -> Column:
    top = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 1.0 - F.abs(F.size(a) - F.size(b)) / top).otherwise(0.0)


def position_similarity(a: Column, b: Column) -> Column:
    """Jaccard share of common words with a bonus for like places; containment counts 0.95."""

    def score(s: Column) -> Column:
        x, y, p, q = s["x"], s["y"], s["p"], s["q"]
        size = F.least(F.octet_length(x), F.octet_length(y))
        inside = (size >= F.greatest(F.lit(8), (size / 3).cast("int"))) & (x.contains(y) | y.contains(x))
        top = F.greatest(F.size(p), F.size(q))
        places = F.filter(F.transform(p, lambda w, i: F.struct(i.alias("i"), F.array_position(q, w).cast("int").alias("j"))), lambda e: e["j"] > 0)
        sums = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("bonus")), lambda t, e: F.struct((t["n"] + 1).alias("n"), (t["bonus"] + 1.0 - F.abs(e["i"] - (e["j"] - 1)) / top).alias("bonus")))
        mixed = let(sums, lambda t: F.least(0.7 * t["n"] / (F.size(p) + F.size(q) - t["n"]) + 0.3 * t["bonus"] / F.greatest(t["n"], F.lit(1)), F.lit(1.0)))
        return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(inside, 0.95).when((F.size(p) == 0) | (F.size(q) == 0), 0.0).otherwise(mixed)

    low = lambda c: F.trim(F.lower(c))
    return let(F.struct(low(a).alias("x"), low(b).alias("y"), words(low(a)).alias("p"), words(low(b)).alias("q")), score)


def repeats(text: Column, before: Column, least: float) -> Column:
    """Whether ``text`` repeats ``before``: equal, contained, sharing a start, or similar."""
    x, y = F.trim(F.lower(text)), F.trim(F.lower(before))
    size = F.least(F.octet_length(x), F.octet_length(y))
    fits = size >= F.greatest(F.lit(8), (size / 4).cast("int"))
    cut = (F.least(F.char_length(x), F.char_length(y)) * 3 / 4).cast("int")
    begun = (size > 15) & (x.substr(F.lit(1), cut) == y.substr(F.lit(1), cut))
    return (F.octet_length(x) >= 5) & ((x == y) | (fits & (x.contains(y) | y.contains(x) | begun)) | (position_similarity(text, before) >= least))


def common_prefix(a: Column, b: Column) -> Column:
    """How many words two lists share from the start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def prefix_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Words beyond the common start, over the reference's words."""
    top = F.greatest(F.size(reference), F.size(hypothesis))
    return F.when(F.size(reference) > 0, (top - common_prefix(reference, hypothesis)) / F.size(reference)).otherwise(F.when(F.size(hypothesis) > 0, 1.0).otherwise(0.0))


def positional_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Difference of lengths plus words that differ at the same place, over the reference's words."""
    both = F.least(F.size(reference), F.size(hypothesis))
    differ = F.size(F.filter(F.zip_with(F.slice(reference, 1, both), F.slice(hypothesis, 1, both), lambda x, y: x != y), lambda d: d))
    return F.when(F.size(reference) > 0, (F.abs(F.size(reference) - F.size(hypothesis)) + differ) / F.size(reference)).otherwise(0.0)


def trim_marks(word: Column) -> Column:
    """Without ASCII punctuation at either end."""
    return F.regexp_replace(word, r"^\p{Punct}+|\p{Punct}+$", "")


def merge_texts(a: Column, b: Column) -> Column:
    """The longer one where it holds the other; else both."""
    return F.when(a.contains(b), a).when(b.contains(a), b).otherwise(F.concat_ws(" ", a, b))


def highlight(text: Column, term: str) -> Column:
    """Marks every occurrence of ``term``, whatever its case."""
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(text, f"(?i)({quoted})", "<mark>$1</mark>") if term else text


def clock(seconds: Column) -> Column:
    """h:mm:ss, without the hours where there are none."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def spoken(seconds: Column) -> Column:
    """Xh Ym, Ym Zs or Zs."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("string"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string"), F.pmod(s, F.lit(60)).cast("string")
    return F.when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).when(s >= 60, F.concat(m, F.lit("m "), r, F.lit("s"))).otherwise(F.concat(r, F.lit("s")))


def relative_day(day: Column, today: Column) -> Column:
    """Today, Yesterday, N days ago (below a week), else month and day, with the year if it differs."""
    n = F.datediff(today, day)
    plain = F.when(F.year(day) == F.year(today), F.date_format(day, "MMM d")).otherwise(F.date_format(day, "MMM d, yyyy"))
    return F.when(n == 0, "Today").when(n == 1, "Yesterday").when((n > 1) & (n < 7), F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(plain)


def is_noise(text: Column) -> Column:
    """Empty, or one of the marks that recognisers write for no speech."""
    return F.coalesce((F.trim(text) == "") | text.contains("[BLANK_AUDIO]") | text.contains("[INAUDIBLE]"), F.lit(True))


def repeats_any(text: Column, recent: Column, least: float) -> Column:
    """Whether ``text`` repeats one of the texts in ``recent``."""
    return F.exists(recent, lambda before: repeats(text, before, least))


def without_overlap(text: Column, buffer: Column, over: float) -> Column:
    """``text`` without its first words, as many as ``buffer`` has, where the common start of both is
    more than ``over`` of the longer one and ``text`` has more words; case does not count."""
    def cut(s: Column) -> Column:
        a, b = s["a"], s["b"]
        # capitals stay what they are in capitals, but "SS" for "ß" in small letters is "ss"
        caps = lambda ws: F.transform(ws, lambda w: F.upper(w))
        alike = common_prefix(caps(F.slice(a, 1, F.least(F.size(a), F.size(b)))), caps(F.slice(b, 1, F.least(F.size(a), F.size(b))))) / F.greatest(F.size(a), F.size(b))
        fits = (F.size(a) > 0) & (F.size(b) > 0) & (alike > over) & (F.size(a) > F.size(b))
        return F.when(fits, F.array_join(F.slice(a, F.size(b) + 1, F.greatest(F.size(a) - F.size(b), F.lit(0))), " ")).otherwise(text)

    return let(F.struct(words(text).alias("a"), words(buffer).alias("b")), cut)


def boosted(ws: Column, vocabulary: tuple[str, ...], least: float = 0.9) -> Column:
    """Words (word, confidence) with at least ``least`` for those of the vocabulary."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    return F.transform(ws, lambda w: F.struct(w["word"].alias("word"), F.when(F.array_contains(known, w["word"]), F.greatest(w["confidence"], F.lit(least))).otherwise(w["confidence"]).alias("confidence")))


def minute_clock(seconds: Column) -> Column:
    """mm:ss, minutes without bound."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat_ws(":", two(F.floor(s / 60).cast("long")), two(F.pmod(s, F.lit(60))))


def speech_time(seconds: Column) -> Column:
    """N.Ns below a minute, else Xm Ys."""
    s = F.floor(seconds).cast("long")
    long = F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.pmod(s, F.lit(60)).cast("string"), F.lit("s"))
    return F.when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit("s"))).otherwise(long)


def error_category(kind: Column) -> Column:
    """The first of the known areas that the name of an error holds."""
    areas = (("model", "model"), ("audio", "audio"), ("permission", "permissions"), ("system", "system"), ("network", "network"))
    out = F.lit("unknown")
    for part, area in reversed(areas):
        out = F.when(kind.contains(part), area).otherwise(out)
    return out


def shifted(time: Column, **by: int) -> Column:
    """A time so many days, hours, mins or secs later (negative: earlier)."""
    return time + F.make_interval(**{k: F.lit(v) for k, v in by.items()})
