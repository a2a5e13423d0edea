"""Text expressions of record matching: normal form, tokens, proper nouns, set similarity, token-set ratio.

All but ``lcs_arrow`` are Catalyst expressions and stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Words that carry no identity, and capitalised words that only open a question.
STOPWORDS = ["the", "a", "an", "will", "by", "in", "on", "of", "be", "is", "to", "for", "and", "or", "vs", "at", "with", "from"]
OPENERS = [
    "Will", "Does", "What", "When", "Where", "Who", "How", "Should", "Are", "Have", "Was", "Were", "Did",
    "Could", "Would", "Might", "Shall", "Has", "The", "Over", "Under", "Yes", "This", "That", "Their", "There",
]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NOUN_PATTERN = r"(?U)\b([A-Z][A-Za-z]{3,})\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parts(text: Column) -> Column:
    """Words before stopwords go; "" where blanks begin or end a text."""
    clean = F.lower(F.translate(F.coalesce(text, F.lit("")), PUNCTUATION, " " * len(PUNCTUATION)))
    return F.split(clean, r"(?U)\s+")


def words(text: Column, stopwords: list[str] | None = None) -> Column:
    """Normalised words in order: ASCII punctuation is blank, lower case, no stopwords; [] for null."""
    drop = STOPWORDS if stopwords is None else stopwords
    return F.filter(_parts(text), lambda w: (w != "") & ~w.isin(drop) if drop else w != "")


def word_set(text: Column, stopwords: list[str] | None = None) -> Column:
    """``words``, sorted and each once; compiled as a whole, where a lambda is interpreted word by word."""
    drop = STOPWORDS if stopwords is None else stopwords
    return F.sort_array(F.array_except(_parts(text), F.array(*map(F.lit, ["", *drop]))))


def normalize(text: Column, stopwords: list[str] | None = None) -> Column:
    """The normalised words joined by one space; "" for null."""
    return F.array_join(words(text, stopwords), " ")


def tokenize(text: Column, min_length: int = 2, stopwords: list[str] | None = None) -> Column:
    """The sorted set of normalised words of at least ``min_length`` characters."""
    return F.array_sort(F.array_distinct(F.filter(words(text, stopwords), lambda w: F.length(w) >= min_length)))


def proper_nouns(text: Column, openers: list[str] | None = None) -> Column:
    """The sorted set of capitalised words of four letters and more that aren't sentence openers."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NOUN_PATTERN), F.lit(1))
    drop = OPENERS if openers is None else openers
    return F.sort_array(F.array_except(found, F.array(*map(F.lit, drop))) if drop else F.array_distinct(found))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def symmetric_difference_size(a: Column, b: Column) -> Column:
    """How many elements are in exactly one of two sets."""
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def _lcs_rows(chars_a: Column, chars_b: Column) -> Column:
    """By dynamic programming: a fold over one array carries a row, an inner fold over the other makes the next."""
    places = F.sequence(F.lit(1), F.size(chars_b))

    def step(row: Column, ca: Column) -> Column:
        def inner(acc: Column, i: Column) -> Column:
            above, left = F.element_at(row, i + 1), F.element_at(acc, -1)
            return F.concat(acc, F.array(F.when(F.element_at(chars_b, i) == ca, F.element_at(row, i) + 1).otherwise(F.greatest(above, left))))

        return F.aggregate(places, F.array(F.lit(0)), inner)

    first = F.array_repeat(F.lit(0), F.size(chars_b) + 1)
    return F.element_at(F.aggregate(chars_a, first, step), -1)


def _lcs_bits(chars_a: Column, chars_b: Column) -> Column:
    """Bit-parallel: one 64-bit word is the row of the dynamic program; the first array has at most 60 characters."""
    one = F.lit(1).cast("long")
    bits = F.transform(chars_a, lambda c, i: F.struct(c.alias("c"), F.call_function("shiftleft", one, i).alias("bit")))
    bound = F.struct(bits.alias("bits"), (F.call_function("shiftleft", one, F.size(chars_a)) - 1).alias("full"))

    def fold(x: Column) -> Column:
        def step(v: Column, c: Column) -> Column:
            mask = F.aggregate(x["bits"], F.lit(0).cast("long"), lambda m, p: F.when(p["c"] == c, m.bitwiseOR(p["bit"])).otherwise(m))
            return let(v.bitwiseAND(mask), lambda u: (v + u).bitwiseOR(v - u).bitwiseAND(x["full"]))

        return F.size(x["bits"]) - F.bit_count(F.aggregate(chars_b, x["full"], step))

    return let(bound, fold)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings."""
    letters = lambda x: F.when(F.length(x) > 0, F.split(x, "")).otherwise(F.array().cast("array<string>"))
    pair = F.struct(letters(a).alias("a"), letters(b).alias("b"))

    def body(x: Column) -> Column:
        swap = F.size(x["a"]) <= F.size(x["b"])
        sides = F.struct(F.when(swap, x["a"]).otherwise(x["b"]).alias("short"), F.when(swap, x["b"]).otherwise(x["a"]).alias("long"))
        return let(
            sides,
            lambda y: F.when(F.size(y["short"]) == 0, F.lit(0))
            .when(F.size(y["short"]) <= 60, _lcs_bits(y["short"], y["long"]))
            .otherwise(_lcs_rows(y["short"], y["long"])),
        )

    return let(pair, body)


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (total length); 100 if both are empty."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, F.lit(200.0) * lcs_length(a, b) / total).otherwise(F.lit(100.0))


def token_set_parts(a: Column, b: Column) -> Column:
    """struct(i, a, b, empty) of two normalised texts as word sets: the sorted common words and rests as strings."""
    split = lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda w: w != ""))
    join = lambda x: F.array_join(F.array_sort(x), " ")

    def parts(x: Column) -> Column:
        wa, wb = x["a"], x["b"]
        return F.struct(
            join(F.array_intersect(wa, wb)).alias("i"),
            join(F.array_except(wa, wb)).alias("a"),
            join(F.array_except(wb, wa)).alias("b"),
            ((F.size(wa) == 0) | (F.size(wb) == 0)).alias("empty"),
        )

    return let(F.struct(split(a).alias("a"), split(b).alias("b")), parts)


def ratio_of_parts(x: Column, lcs: Column) -> Column:
    """The token-set ratio, given the parts and the common subsequence of their rests (or a bound of it, for a bound)."""
    n, la, lb = F.length(x["i"]), F.length(x["a"]), F.length(x["b"])
    head = n + F.when(n > 0, 1).otherwise(0)
    total = 2 * head + la + lb
    crossed = F.when(total > 0, F.lit(200.0) * (head + lcs) / total).otherwise(F.lit(0.0))
    contained = F.when(n > 0, F.greatest(F.lit(200.0) * n / (n + head + la), F.lit(200.0) * n / (n + head + lb))).otherwise(F.lit(0.0))
    return F.when(x["empty"], F.lit(0.0)).when((n > 0) & ((la == 0) | (lb == 0)), F.lit(100.0)).otherwise(F.greatest(crossed, contained))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity 0-100 of two normalised texts as word sets.

    With I the sorted common words and A, B the sorted rests: 100 if I is not empty and A or B
    is; else the best Indel ratio of (I A, I B), (I, I A) and (I, I B). The last two need no
    subsequence: I is a prefix of the longer text. A common prefix is part of some longest
    common subsequence, so the first needs one of A and B only.
    """
    return let(token_set_parts(a, b), lambda x: ratio_of_parts(x, lcs_length(x["a"], x["b"])))


def _code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of an array of strings in a row (null: none), and where each string's begin and end."""
    strings = pa.array(strings.fill_null(""), pa.large_string()) if strings.null_count else strings.cast(pa.large_string())
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends - ends[0]]
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), at


def _padded(chars: np.ndarray, at: np.ndarray, rows: np.ndarray, fill: int) -> np.ndarray:
    """The strings of ``rows`` as a matrix, one row each."""
    size = (at[1:] - at[:-1])[rows]
    places = np.arange(size.max(initial=0))
    out = chars[np.minimum(at[:-1][rows][:, None] + places, len(chars) - 1)] if len(chars) else np.zeros((len(rows), 0), np.uint32)
    return np.where(places < size[:, None], out, np.uint32(fill))


def lcs_lengths(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Longest common subsequences of two arrays of strings, all pairs at once.

    Bit-parallel: one 64-bit word a pair is the row of the dynamic program, and each step takes
    a character of every pair. Pairs whose shorter string has over 63 characters go one by one,
    over Python's long integers.
    """
    (chars_a, at_a), (chars_b, at_b) = _code_points(a), _code_points(b)
    size_a, size_b = np.diff(at_a), np.diff(at_b)
    out = np.zeros(len(size_a), np.int32)
    shorter = np.minimum(size_a, size_b)
    for swap in (False, True):
        sides = ((chars_b, at_b), (chars_a, at_a)) if swap else ((chars_a, at_a), (chars_b, at_b))
        rows = np.flatnonzero((shorter > 0) & (shorter < 64) & ((size_a > size_b) == swap))
        if not len(rows):
            continue
        x, y = _padded(*sides[0], rows, 0xFFFFFFFF), _padded(*sides[1], rows, 0xFFFFFFFE)
        bits = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64)
        full = (np.uint64(1) << shorter[rows].astype(np.uint64)) - np.uint64(1)
        row = full.copy()
        for j in range(y.shape[1]):
            met = row & ((x == y[:, j, None]) @ bits)
            row = ((row + met) | (row - met)) & full
        out[rows] = shorter[rows] - np.bitwise_count(row)
    for i in np.flatnonzero(shorter >= 64):
        out[i] = _lcs_long(chars_a[at_a[i] : at_a[i + 1]].tolist(), chars_b[at_b[i] : at_b[i + 1]].tolist())
    return out


def _lcs_long(x: list[int], y: list[int]) -> int:
    masks: dict[int, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    row = full = (1 << len(x)) - 1
    for c in y:
        met = row & masks.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(x) - row.bit_count()


#: ``lcs_length`` in Arrow batches, for joins that score millions of pairs. Marked as not deterministic so the planner calls it once a pair.
lcs_arrow = F.arrow_udf(lambda a, b: pa.array(lcs_lengths(a, b)), IntegerType()).asNondeterministic()
