"""Composite scores of all pairs of a block at once, in numpy.

Records are brought to distinct texts (word set and nouns). Texts with the same frequent words
and the same lengths form a class: pairs of two classes that share no rare word have one word
similarity, one noun difference and rests of one length, so only the common subsequence is left,
found bit-parallel for a whole matrix of texts. Pairs that share a rare word or noun come from
postings and are scored one by one. Where a confidence is asked for, pairs of classes that can't
reach it need no subsequence. Nothing is left out: texts with too many classes are compared by
postings, row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict
from decimal import ROUND_FLOOR, Decimal
from functools import cache, cached_property
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larkspan.functions.text import lcs_lengths

DAY = 86_400_000_000.0
TILE = 4_000_000  # pairs of texts held at once
LABELS = ("matched", "near_miss", "none")
SCHEMA = pa.schema([("left", pa.string()), ("right", pa.string()), ("confidence", pa.float64()), ("fuzz", pa.float64()), ("jaccard", pa.float64()), ("noun_diff", pa.int64()), ("days", pa.float64())])
BATCH = 65_536  # pairs sent to Spark at once


def columns(scorer) -> str:  # noqa: ANN001
    """The columns of ``scored``. Spark looks for nulls in each value of a column that may have them, which is much of a pair's cost."""
    return f"left string, right string, confidence double NOT NULL, fuzz double NOT NULL, jaccard double NOT NULL, noun_diff bigint NOT NULL, days double{'' if scorer.max_days is None else ' NOT NULL'}"


class Words:
    """Word lists of texts in one array: ``codes`` of ``vocabulary``, those of text i from ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, joined: pa.Array) -> None:
        lists = pc.split_pattern(joined, " ")
        flat = pc.list_flatten(lists)
        size = np.where(pc.equal(joined, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        if len(flat) > size.sum():  # texts without words have one empty word
            flat = flat.filter(pc.not_equal(flat, ""))
        words = flat.dictionary_encode()
        self.vocabulary, self.codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
        self.size = size.astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.length = pc.utf8_length(self.vocabulary).to_numpy().astype(np.int64)
        self.chars = self.sums(self.length[self.codes])
        self.of = np.repeat(np.arange(len(self.size)), self.size)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sum by text of a number a word."""
        total = np.concatenate([[0], np.cumsum(x)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def places(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``places in texts, places in codes`` of the words of ``texts``."""
        size = self.size[texts]
        n = np.repeat(np.arange(len(texts)), size)
        return n, np.arange(len(n)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at[texts], size)

    def joined(self, codes: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Lists of so many words each as strings."""
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
        return pc.binary_join(pa.LargeListArray.from_arrays(at, self.vocabulary.take(pa.array(codes))), " ").cast(pa.string())


class Side:
    """Records of one side: distinct texts, and each record's text, id, position, time and value."""

    def __init__(self, t: pa.Table) -> None:
        t = t.combine_chunks()
        one = lambda name: t[name].combine_chunks() if t[name].num_chunks != 1 else t[name].chunk(0)
        self.n = len(t)
        self.ids = one("id")
        self.idx = t["idx"].to_numpy()
        self._source = t["source"]
        self.apart = one("apart") if "apart" in t.column_names else None
        at = t["at"]
        self.no_time = at.is_null().to_numpy(zero_copy_only=False)
        self.at = at.fill_null(0).to_numpy()
        self.value = t["value"].cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)  # null: NaN, near nothing
        # No word or noun holds a line's end.
        text = pc.binary_join_element_wise(one("words"), one("nouns"), "\n").dictionary_encode()
        order = pc.sort_indices(text.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        self.text, self.texts = place[text.indices.to_numpy()], len(order)
        keys = pc.split_pattern(text.dictionary.take(order), "\n", max_splits=1)
        self.all_words, self.all_nouns = Words(pc.list_element(keys, 0)), Words(pc.list_element(keys, 1))

    @cached_property
    def source(self) -> np.ndarray:
        return np.array(self._source.to_pylist(), object)

    @cached_property
    def words(self) -> list[list[str]]:
        w = self.all_words
        flat = w.vocabulary.take(pa.array(w.codes)).to_pylist()
        return [flat[i:j] for i, j in zip(w.at[:-1].tolist(), w.at[1:].tolist())]


class _Shared:
    """The words of two sides by the codes of the first; -1 for words it hasn't."""

    def __init__(self, a: Words, b: Words) -> None:
        self.a, self.b = a, b
        n = len(a.vocabulary)
        to_a = pc.index_in(b.vocabulary, value_set=a.vocabulary).fill_null(-1).to_numpy().astype(np.int64)
        self.codes_b = to_a[b.codes]
        known = np.flatnonzero(self.codes_b >= 0)
        self.n_a, self.n_b = np.bincount(a.codes, minlength=n), np.bincount(self.codes_b[known], minlength=n)
        self.texts_a = a.of[np.argsort(a.codes, kind="stable")]
        self.texts_b = b.of[known][np.argsort(self.codes_b[known], kind="stable")]
        self.at_a, self.at_b = (np.concatenate([[0], np.cumsum(x)]) for x in (self.n_a, self.n_b))
        self.met = self.n_a * self.n_b
        self.held_b = np.sort(b.of[known] * max(1, n) + self.codes_b[known])
        self.held_a = np.sort(a.of * max(1, n) + a.codes)

    def often(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words of each side are in more than so many pairs."""
        often = self.met > most
        return often[self.a.codes], np.append(often, False)[self.codes_b]

    def pairs(self, words: np.ndarray) -> Iterator[np.ndarray]:
        """The pairs of texts that hold one of ``words``, as numbers; by parts, each pair once a part."""
        ends = np.cumsum(self.met[words])
        yield np.zeros(0, np.int64)
        for part in np.split(words, np.searchsorted(ends, np.arange(TILE, ends[-1], TILE)) if len(words) else []):
            n_b, met = self.n_b[part], self.met[part]
            word = np.repeat(np.arange(len(part)), met)
            i, j = np.divmod(np.arange(len(word)) - np.repeat(np.cumsum(met) - met, met), n_b[word])
            yield np.unique(self.texts_a[self.at_a[part][word] + i] * len(self.b.size) + self.texts_b[self.at_b[part][word] + j])

    def common(self, ta: np.ndarray, tb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words texts share, and their characters."""
        n, at = self.a.places(ta)
        hit = self._held(self.held_b, tb[n], self.a.codes[at])
        n, at = n[hit], at[hit]
        chars = np.bincount(n, self.a.length[self.a.codes[at]], len(ta)).astype(np.int64)
        return np.bincount(n, minlength=len(ta)), chars

    def rests(self, ta: np.ndarray, tb: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """What is left of texts without the words they share."""
        out = []
        for own, held, codes, x, y in ((self.a, self.held_b, self.a.codes, ta, tb), (self.b, self.held_a, self.codes_b, tb, ta)):
            n, at = own.places(x)
            left = ~self._held(held, y[n], codes[at])
            out.append(own.joined(own.codes[at[left]], np.bincount(n[left], minlength=len(x))))
        return tuple(out)

    def _held(self, held: np.ndarray, texts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        key = texts * max(1, len(self.a.vocabulary)) + codes
        if not len(held):
            return np.zeros(len(key), bool)
        return (held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key) & (codes >= 0)


def fuzz_of(common, head, la, lb, lcs):  # noqa: ANN001, ANN201
    """The token-set ratio of lengths; the operations of ``ratio_of_parts`` in its order."""
    if common > 0 and (la == 0 or lb == 0):
        return np.full(np.shape(lcs), 100.0)
    total = 2 * head + la + lb
    crossed = 200.0 * (head + lcs) / total if total > 0 else np.zeros(np.shape(lcs))
    contained = max(200.0 * common / (common + head + la), 200.0 * common / (common + head + lb)) if common > 0 else 0.0
    return np.maximum(crossed, contained)


def fuzz_of_each(common: np.ndarray, head: np.ndarray, la: np.ndarray, lb: np.ndarray, lcs: np.ndarray) -> np.ndarray:
    """``fuzz_of`` of arrays of lengths."""
    total, some = 2 * head + la + lb, common > 0
    crossed = np.where(total > 0, 200.0 * (head + lcs) / np.maximum(total, 1), 0.0)
    part = lambda rest: 200.0 * common / np.maximum(common + head + rest, 1)
    contained = np.where(some, np.maximum(part(la), part(lb)), 0.0)
    return np.where(some & ((la == 0) | (lb == 0)), 100.0, np.maximum(crossed, contained))


def subsequences(short: list[str], long: list[str]) -> np.ndarray:
    """Longest common subsequences of all strings of one length, 64 at most, with all of another length: a matrix, long by short."""
    n, m = len(short[0]), len(long[0])
    if not n or not m:
        return np.zeros((len(long), len(short)), np.uint8)
    points = lambda x, k: np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(x), k)
    x, y = points(short, n), points(long, m)
    kind = np.uint16 if n <= 16 else np.uint32 if n <= 32 else np.uint64
    letters, y_code = np.unique(y, return_inverse=True)
    y_code = y_code.reshape(y.shape)
    out = np.zeros((len(y), len(x)), np.uint8)
    full = kind((1 << n) - 1)
    across = 4096
    for c0 in range(0, len(x), across):
        xs = x[c0 : c0 + across]
        masks = np.zeros((len(letters), len(xs)), kind)
        for p in range(n):
            at = np.searchsorted(letters, xs[:, p])
            cols = np.flatnonzero(letters[np.minimum(at, len(letters) - 1)] == xs[:, p])
            masks[at[cols], cols] |= kind(1 << p)
        down = max(1, 131_072 // len(xs))
        for r0 in range(0, len(y), down):
            ys = y_code[r0 : r0 + down]
            same = (ys == ys[0]).all(axis=0)
            lead = m if same.all() else int(np.argmin(same))
            row = np.full((1, len(xs)), full, kind)
            for j in range(lead):
                met = row & masks[ys[0, j]]
                row = (row + met) | (row - met)
            row = np.repeat(row, len(ys), axis=0)
            met, total = np.empty_like(row), np.empty_like(row)
            for j in range(lead, m):
                if same[j]:
                    np.bitwise_and(row, masks[ys[0, j]], out=met)
                else:
                    np.take(masks, ys[:, j], axis=0, out=met, mode="clip")
                    np.bitwise_and(row, met, out=met)
                np.add(row, met, out=total)
                np.subtract(row, met, out=row)
                np.bitwise_or(row, total, out=row)
            out[r0 : r0 + down, c0 : c0 + across] = n - np.bitwise_count(row & full)
    return out


class Scores:
    """Scores of the texts of two sides: ``tiles`` of classes and ``singles``; each pair of texts is in one of them or fails."""

    def __init__(self, a: Side, b: Side, scorer, floor: float | None) -> None:  # noqa: ANN001
        self.a, self.b, self.s, self.floor = a, b, scorer, floor
        s = scorer
        self.bounded = floor is not None and min(s.fuzz_weight, s.jaccard_weight, s.time_weight) >= 0
        n_a, n_b = a.texts, b.texts
        most = max(64, n_a * n_b // 1024)
        self.shared = [_Shared(a.all_words, b.all_words), _Shared(a.all_nouns, b.all_nouns)]
        often = [x.often(most) for x in self.shared]
        rare = [np.flatnonzero((x.met > 0) & (x.met <= most)) for x in self.shared]
        met = sum(int(x.met[w].sum()) for x, w in zip(self.shared, rare))
        self.class_a, self.class_b = self._classes(a, *(x[0] for x in often)), self._classes(b, *(x[1] for x in often))
        pairs = n_a * n_b
        self.plain = len(self.class_a) * len(self.class_b) > max(16, pairs // 2000) or (pairs > 4096 and met > pairs // 4)
        self.apart = np.zeros(0, np.int64)
        if not self.plain:
            self.apart = np.unique(np.concatenate([p for x, w in zip(self.shared, rare) for p in x.pairs(w)]))

    def _classes(self, side: Side, often: np.ndarray, often_nouns: np.ndarray) -> list[tuple[tuple, np.ndarray]]:
        """Texts by their frequent words, number of words and characters, and nouns: ``key, texts``."""
        w, x = side.all_words, side.all_nouns
        held = w.joined(w.codes[often], w.sums(often)), x.joined(x.codes[often_nouns], x.sums(often_nouns))
        code = np.zeros(side.texts, np.int64)
        for part in (*(h.dictionary_encode().indices.to_numpy() for h in held), w.size, w.chars, x.size):
            values, place = np.unique(part, return_inverse=True)
            code = np.unique(code * len(values) + place, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []
        split = lambda h, i: tuple(v.split(" ")) if (v := h[int(i)].as_py()) else ()
        return [((split(held[0], p[0]), int(w.size[p[0]]), int(w.chars[p[0]]), int(x.size[p[0]]), split(held[1], p[0])), p) for p in parts]

    def raw(self, fuzz, jaccard, noun_diff, days, bonus):  # noqa: ANN001, ANN201
        """The confidence; the operations of ``Scorer.score`` in its order."""
        s = self.s
        time = 1 - days / s.max_days if s.max_days is not None else 0.0
        raw = s.fuzz_weight * fuzz / 100 + s.jaccard_weight * jaccard + s.time_weight * time
        raw = raw - s.noun_penalty * noun_diff + bonus
        return np.maximum(0.0, np.minimum(1.0, raw))

    def hopeless(self, fuzz, jaccard, noun_diff):  # noqa: ANN001, ANN201
        """Whether even the same time and value leave a pair below the floor."""
        if not self.bounded:
            return np.zeros(np.shape(fuzz), bool)
        return self.raw(fuzz, jaccard, noun_diff, 0.0, max(0.0, self.s.value_bonus)) < self.floor

    def tiles(self) -> Iterator[tuple]:
        """``texts a, texts b, codes, fuzz by code, jaccard, noun_diff``; a code is the subsequence's length and one, 0 no pair."""
        if self.plain:
            return
        n_b = self.b.texts
        for key_a, rows in self.class_a:
            for key_b, cols in self.class_b:
                keep = set(key_b[0])
                both = [w for w in key_a[0] if w in keep]
                jaccard = len(both) / (key_a[1] + key_b[1] - len(both))
                if jaccard < self.s.min_jaccard:
                    continue
                drop, chars = set(both), sum(map(len, both))
                rest = lambda key: max(0, key[2] - chars + key[1] - len(both) - 1)  # noqa: B023, E731
                la, lb = rest(key_a), rest(key_b)
                common = chars + max(0, len(both) - 1)
                head = common + (1 if common > 0 else 0)
                noun_diff = key_a[3] + key_b[3] - 2 * len(set(key_a[4]) & set(key_b[4]))
                fuzz = fuzz_of(common, head, la, lb, np.arange(min(la, lb) + 1))
                if fuzz[-1] < self.s.min_fuzz or self.hopeless(fuzz[-1], jaccard, noun_diff):
                    continue
                fuzz = np.concatenate([[np.nan], fuzz])
                text = lambda side, i: " ".join(w for w in side.words[i] if w not in drop)  # noqa: B023, E731
                step = max(1, TILE // len(cols))
                rests_b = [text(self.b, i) for i in cols]
                for r0 in range(0, len(rows), step):
                    part = rows[r0 : r0 + step]
                    rests_a = [text(self.a, i) for i in part]
                    if min(la, lb) > 64:
                        codes = np.array([lcs_lengths(pa.array([x] * len(rests_b)), pa.array(rests_b)) for x in rests_a]) + 1
                    elif la <= lb:
                        codes = np.ascontiguousarray(subsequences(rests_a, rests_b).T) + np.uint8(1)
                    else:
                        codes = subsequences(rests_b, rests_a) + np.uint8(1)
                    lo, hi = np.searchsorted(self.apart, [part[0] * n_b, (part[-1] + 1) * n_b])
                    ta, tb = np.divmod(self.apart[lo:hi], n_b)
                    i, j = np.minimum(np.searchsorted(part, ta), len(part) - 1), np.minimum(np.searchsorted(cols, tb), len(cols) - 1)
                    here = (part[i] == ta) & (cols[j] == tb)
                    codes[i[here], j[here]] = 0
                    codes[codes <= np.argmax((fuzz[1:] >= self.s.min_fuzz) & ~self.hopeless(fuzz[1:], jaccard, noun_diff))] = 0
                    if codes.any():
                        yield part, cols, codes, fuzz, jaccard, noun_diff

    def _near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of texts to be scored one by one."""
        n_b = self.b.texts
        if not self.plain:
            for at in range(0, len(self.apart), 200_000):
                yield np.divmod(self.apart[at : at + 200_000], n_b)
            return
        words, size_b = self.shared[0], self.b.all_words.size
        held, many = [], 0
        for i in range(self.a.texts):
            own = words.a.codes[words.a.at[i] : words.a.at[i + 1]]
            places = np.concatenate([words.texts_b[:0], *[words.texts_b[words.at_b[v] : words.at_b[v + 1]] for v in own.tolist()]])
            common = np.bincount(places, minlength=n_b)
            j = np.flatnonzero(common / (len(own) + size_b - common) >= self.s.min_jaccard)
            held.append((np.full(len(j), i), j))
            many += len(j)
            if many > 200_000:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, many = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held))

    def singles(self) -> Iterator[tuple[np.ndarray, ...]]:
        """``texts a, texts b, fuzz, jaccard, noun_diff`` of pairs that pass."""
        words, nouns = self.shared
        for near_a, near_b in self._near():
            ends = np.cumsum(words.a.size[near_a] + words.b.size[near_b])
            cuts = np.searchsorted(ends, np.arange(TILE // 4, ends[-1], TILE // 4)) if len(ends) else []  # so many words held at once, whatever a text's length
            for ta, tb in zip(np.split(near_a, cuts), np.split(near_b, cuts)):
                n, chars = words.common(ta, tb)
                size_a, size_b = words.a.size[ta], words.b.size[tb]
                jaccard = n / (size_a + size_b - n)
                rest = lambda w, t, size: w.chars[t] - chars + np.maximum(0, size - n - 1)  # noqa: B023, E731
                la, lb = rest(words.a, ta, size_a), rest(words.b, tb, size_b)
                common = chars + np.maximum(0, n - 1)
                head = common + (common > 0)
                noun_diff = nouns.a.size[ta] + nouns.b.size[tb] - 2 * nouns.common(ta, tb)[0]
                bound = fuzz_of_each(common, head, la, lb, np.minimum(la, lb))
                ok = np.flatnonzero((jaccard >= self.s.min_jaccard) & (bound >= self.s.min_fuzz) & ~self.hopeless(bound, jaccard, noun_diff))
                if not len(ok):
                    continue
                ta, tb, jaccard, noun_diff = ta[ok], tb[ok], jaccard[ok], noun_diff[ok]
                lcs = lcs_lengths(*words.rests(ta, tb)).astype(np.int64)
                fuzz = fuzz_of_each(common[ok], head[ok], la[ok], lb[ok], lcs)
                ok = fuzz >= self.s.min_fuzz
                yield ta[ok], tb[ok], fuzz[ok], jaccard[ok], noun_diff[ok]


def _places(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Places of two sides' strings among all of them in order, -1 for null, and these."""
    names = pc.unique(pa.chunked_array([a, b])).drop_null()
    names = names.take(pc.sort_indices(names))
    place = lambda x: pc.index_in(x, value_set=names).fill_null(-1).to_numpy().astype(np.int64)
    return place(a), place(b), names


class _Groups:
    """Records by their text."""

    def __init__(self, text: np.ndarray, n: int) -> None:
        self.order = np.argsort(text, kind="stable")
        self.at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])

    def of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``places in texts, records`` of all records of ``texts``."""
        size = self.at[texts + 1] - self.at[texts]
        places = np.repeat(np.arange(len(texts)), size)
        return places, self.order[np.arange(len(places)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at[texts], size)]


def _record_pairs(a: Side, b: Side, scores: Scores) -> Iterator[tuple[np.ndarray, ...]]:
    """``records a, records b, fuzz, jaccard, noun_diff`` of all record pairs whose texts pass."""
    of_a, of_b = _Groups(a.text, a.texts), _Groups(b.text, b.texts)
    for ta, tb, codes, fuzz, jaccard, noun_diff in scores.tiles():
        pa_, ra = of_a.of(ta)
        pb_, rb = of_b.of(tb)
        step = max(1, 1_000_000 // max(1, len(rb)))
        for at in range(0, len(ra), step):
            some = codes[pa_[at : at + step]][:, pb_]
            i, j = np.nonzero(some)
            if len(i):
                yield ra[at + i], rb[j], fuzz[some[i, j]], np.full(len(i), jaccard), np.full(len(i), noun_diff)
    for ta, tb, *parts in scores.singles():
        n_a, n_b = of_a.at[ta + 1] - of_a.at[ta], of_b.at[tb + 1] - of_b.at[tb]
        ends = np.cumsum(n_a * n_b)
        at = 0
        while at < len(ta):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, "right")))
            if to == at + 1 and n_a[at] * n_b[at] > 1_000_000:  # one pair of texts with very many records
                rb = of_b.of(tb[at:to])[1]
                for r in of_a.of(ta[at:to])[1]:
                    yield np.full(len(rb), r), rb, *(np.full(len(rb), x[at]) for x in parts)
            else:
                k, ra = of_a.of(ta[at:to])
                pair = np.repeat(at + k, n_b[at + k])
                ra = np.repeat(ra, n_b[at + k])
                first = np.concatenate([[0], np.cumsum(n_b[at + k])])[:-1]
                nth = np.arange(len(ra)) - np.repeat(first, n_b[at + k])
                yield ra, of_b.order[of_b.at[tb[pair]] + nth], *(x[pair] for x in parts)
            at = to


def _finished(a: Side, b: Side, scores: Scores, upper: bool, mixed: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """``records a, records b, confidence, fuzz, jaccard, noun_diff, days`` of pairs that count."""
    s = scores.s
    same_idx = upper or bool(len(np.intersect1d(a.idx, b.idx)))
    if a.apart is not None:
        block_a, block_b = _places(a.apart, b.apart)[:2]
    for ra, rb, fuzz, jaccard, noun_diff in _record_pairs(a, b, scores):
        ok = np.ones(len(ra), bool)
        if same_idx:
            ok &= a.idx[ra] < b.idx[rb] if upper else a.idx[ra] != b.idx[rb]
        if mixed:
            ok &= a.source[ra] != b.source[rb]
        if a.apart is not None:  # null is no block
            ok &= (block_a[ra] != block_b[rb]) | (block_a[ra] < 0)
        days = np.abs(a.at[ra] - b.at[rb]) / DAY
        if s.max_days is not None:
            ok &= (days <= s.max_days) & ~a.no_time[ra] & ~b.no_time[rb]
        with np.errstate(invalid="ignore"):
            bonus = np.where(np.abs(a.value[ra] - b.value[rb]) <= s.value_tolerance, s.value_bonus, 0.0)
        confidence = scores.raw(fuzz, jaccard, noun_diff, days, bonus)
        if scores.floor is not None:
            ok &= confidence >= scores.floor
        cols = (ra, rb, confidence, fuzz, jaccard, noun_diff, days)
        yield cols if ok.all() else tuple(x[ok] for x in cols)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``x``, nothing below 0, to so many digits: the doubles of Spark's ``round``, which goes by the shortest decimal and up at a half."""
    y = x * 10.0**digits
    low = np.floor(y)
    over = y - low
    near = np.flatnonzero(np.abs(over - 0.5) <= 1e-6 + y * 1e-15)  # the product's last bits may decide; elsewhere they don't
    up = over > 0.5
    if len(near):
        values, place = np.unique(x[near], return_inverse=True)
        half = Decimal("0.5")
        up[near] = np.array([(d := Decimal(repr(v)).scaleb(digits)) - d.to_integral_value(ROUND_FLOOR) >= half for v in values.tolist()])[place]
    return (low + up) / 10.0**digits


def _label(confidence: np.ndarray, threshold: float, margin: float) -> np.ndarray:
    return np.where(confidence >= threshold, 0, np.where(confidence >= threshold - margin, 1, 2))


def _counts(a: Side, b: Side, scores: Scores, upper: bool, mixed: bool, threshold: float, margin: float) -> np.ndarray:
    """How many pairs have each label, without making the pairs where texts and times say it all."""
    n, s = np.zeros(3, np.int64), scores.s
    slow = upper or mixed or len(np.intersect1d(a.idx, b.idx)) or min(s.fuzz_weight, s.jaccard_weight, s.time_weight) < 0

    def one_by_one(part: Scores) -> None:
        for x in _finished(a, b, part, upper, mixed):
            n[:] += np.bincount(_label(x[2], threshold, margin), minlength=3)

    if slow:
        one_by_one(scores)
        return n
    ends = (a.at[~a.no_time], b.at[~b.no_time])
    spread = max(x.max() - y.min() for x, y in (ends, ends[::-1])) / DAY if all(map(len, ends)) else 0.0
    near = s.max_days is None or (spread <= s.max_days and not a.no_time.any() and not b.no_time.any())
    weight_a, weight_b = np.bincount(a.text, minlength=a.texts).astype(float), np.bincount(b.text, minlength=b.texts).astype(np.float32)

    class Rest(Scores):
        """The tiles whose labels depend on the records."""

        def __init__(self) -> None:
            self.__dict__.update(scores.__dict__)

        def tiles(self) -> Iterator[tuple]:
            for tile in scores.tiles():
                ta, tb, codes, fuzz, jaccard, noun_diff = tile
                best = scores.raw(fuzz[codes.max()], jaccard, noun_diff, 0.0, max(0.0, s.value_bonus))
                if near and best < threshold - margin:
                    n[2] += int(round(weight_a[ta] @ (codes > 0).astype(np.float32).dot(weight_b[tb]).astype(float)))
                else:
                    yield tile

    # float32 holds a text's matches exactly up to 2^24
    one_by_one(Rest() if b.n < 1 << 24 else scores)
    return n


def _sides(t: pa.Table, cross_source: bool) -> Iterator[tuple[Side, Side, bool, bool]]:
    """The pairs of sides of a group: ``a, b``, whether only pairs in order of position count, whether sources have to be compared."""
    t = t.filter(pc.and_(t["idx"].is_valid(), pc.not_equal(t["words"], "")))
    if cross_source:
        t = t.filter(t["source"].is_valid())
    ci, cj, c = t["ci"].to_numpy(), t["cj"].to_numpy(), t["c"].to_numpy()
    if not len(t):
        return
    sources = pc.unique(t["source"]).to_pylist() if cross_source else [None]
    mixed = len(sources) > 8
    if mixed:
        sources = [None]
    part = t["part"].to_numpy()
    source = pc.index_in(t["source"], value_set=pa.array(sources, t["source"].type)).to_numpy() if sources != [None] else None

    @cache  # a side meets several others
    def side(chunk: int, s: int, p: int) -> Side | None:
        rows = np.flatnonzero((c == chunk) & (part == p) & (True if source is None else source == s))
        return Side(t.take(rows)) if len(rows) else None

    one = ci[0] == cj[0]
    kinds = [(s, p) for p in (0, 1) for s in range(len(sources))]
    for k, (s, p) in enumerate(kinds):
        for m, (u, q) in enumerate(kinds):
            if (p and q) or (cross_source and not mixed and s == u) or (one and m < k):
                continue
            upper = one and m == k
            a, b = side(ci[0], s, p), side(cj[0], u, q)
            if a and b:
                yield a, b, upper, mixed


def scored(scorer, cross_source: bool, floor: float | None, digits: int | None = None) -> Callable:  # noqa: ANN001
    """Of a group of records to its scored pairs, for ``applyInArrow``; with their numbers to so many ``digits``."""
    scorer = SimpleNamespace(**asdict(scorer))  # its class would take the session along

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, upper, mixed in _sides(pa.Table.from_batches(list(batches)), cross_source):
            rank_a, rank_b, names = _places(a.ids, b.ids)
            for pairs in _finished(a, b, Scores(a, b, scorer, floor), upper, mixed):
                for at in range(0, len(pairs[0]), BATCH):
                    ra, rb, confidence, fuzz, jaccard, noun_diff, days = (x[at : at + BATCH] for x in pairs)
                    if digits is not None:
                        confidence, fuzz, jaccard, days = (rounded(x, digits) for x in (confidence, fuzz, jaccard, days))
                    lo, hi = np.minimum(rank_a[ra], rank_b[rb]), np.maximum(rank_a[ra], rank_b[rb])
                    lo = np.where(lo < 0, hi, lo)  # the lesser of an id and null is the id
                    when = pa.array(days) if scorer.max_days is not None else pa.nulls(len(ra), pa.float64())
                    cols = [names.take(pa.array(lo, mask=lo < 0)), names.take(pa.array(hi, mask=hi < 0)), pa.array(confidence), pa.array(fuzz), pa.array(jaccard), pa.array(noun_diff.astype(np.int64)), when]
                    yield pa.RecordBatch.from_arrays(cols, schema=SCHEMA)

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def counted(scorer, cross_source: bool, threshold: float, margin: float) -> Callable:  # noqa: ANN001
    """Of a group of records to ``label, n`` of its scored pairs, for ``applyInArrow``."""
    scorer = SimpleNamespace(**asdict(scorer))  # its class would take the session along

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(3, np.int64)
        for a, b, upper, mixed in _sides(pa.Table.from_batches(list(batches)), cross_source):
            n += _counts(a, b, Scores(a, b, scorer, None), upper, mixed, threshold, margin)
        yield pa.RecordBatch.from_arrays([pa.array(LABELS), pa.array(n)], names=["label", "n"])

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run
