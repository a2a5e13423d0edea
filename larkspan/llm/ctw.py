"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is its lower-case words joined by single spaces, and a line feed as its end. Every
byte is eight binary decisions, and each decision node has a context tree of its own whose
depth ``d`` node knows the ``d`` bytes before. A node holds a Krichevsky-Trofimov estimate
of its zeros and ones; the weighted probability of a node is half its own estimate plus
half the product of its children's, so the prediction of a bit mixes the estimates of all
depths 0..``depth`` along its path. The model is trained once on the training texts and
then frozen; ``score`` is its log10 probability of a text, and code length per byte is
``-log2(10) * score / n_bytes``.

What is gathered: counts of all (depth + 1)-byte sequences and of all words of the training
texts, each summed in tasks before the shuffle. Shorter contexts are sums of longer ones.
Nothing is left out for its rarity: the model grows with the input. The trees below
different pairs of previous bytes are independent, so they are dealt by a hash of the pair
to parts of about ``part_grams`` sequences, and each part is solved, frozen and mapped on its
own. The nodes above the pairs, at most 65,536 contexts and bytes, are solved on the driver.

The base model's word counts may be many: the ``top_words`` most frequent words go to every
task, all others meet their counts in a join on the word's hash. Since a word outside the
top list is rarer than 1/top_words of all words, no key of that join is hot.

Defined results: null, empty and blank texts are the end token alone; a null ``doc_id`` is
in training; rows that repeat are scored (and learned) once each; an empty table gives an
empty result; whole texts count; extra columns are ignored. Words are told apart by a
64-bit hash.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import U64, HashCache, ascii_words, kth_largest, mix64
from larkspan.sources import materialize, scratch_path, table

END = b"\n"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def byte_grams(words: list[bytes], depth: int) -> np.ndarray:
    """The (depth + 1)-byte sequences that end at each byte of a text, packed in integers; before it are line feeds."""
    data = np.frombuffer(END * depth + b" ".join(words) + END, dtype=np.uint8).astype(U64)
    n = len(data) - depth
    out = np.zeros(n, U64)
    for i in range(depth + 1):
        out = (out << U64(8)) | data[i : i + n]
    return out


def log_gamma_half(n: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(n + shift) for integers n >= 0 and shift in (0, 1]: the recurrence up to 10, then Stirling's series."""
    x, extra = n.astype(np.float64) + shift, np.zeros(len(n))
    for _ in range(10):
        low = x < 10
        extra[low] -= np.log(x[low])
        x[low] += 1
    return extra + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    half = 2 * 0.5723649429247001  # log Gamma(1/2), twice
    return log_gamma_half(zeros, 0.5) + log_gamma_half(ones, 0.5) - half - log_gamma_half(zeros + ones, 1.0)


def top_bytes(depth: int) -> int:
    """How many bytes of context tell the parts of a model apart."""
    return min(2, depth)


def part_of(grams: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """The part that holds each sequence: by a hash of the last bytes of its context; ``_part_column`` is the same in Spark."""
    ctx = (grams >> U64(8)) & U64((1 << (8 * top_bytes(depth))) - 1)
    return ((((ctx * U64(2654435761)) >> U64(16)) & U64(0xFFFF)) % U64(parts)).astype(np.int64)


def _part_column(key: Column, depth: int, parts: int) -> Column:
    ctx = F.shiftright(key, 8).bitwiseAND(F.lit((1 << (8 * top_bytes(depth))) - 1))
    return (F.shiftright(ctx * F.lit(2654435761), 16).bitwiseAND(F.lit(0xFFFF)) % F.lit(parts)).cast("int")


class _Level:
    """The nodes of one depth for one bit position: sorted ``ctx << 8 | prefix`` keys and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bit: int) -> None:
        byte, ctx = keys & U64(255), keys >> U64(8)
        node = (ctx << U64(8)) | U64(1 << bit) | (byte >> U64(8 - bit))
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        one = (byte >> U64(7 - bit)) & U64(1)
        self.of_gram = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [len(keys)]])))
        self.bit_of_gram = one.astype(bool)
        self.node = node[start]
        self.ones = np.add.reduceat(counts * one.astype(np.int64), start)
        self.zeros = np.add.reduceat(counts, start) - self.ones
        self.own = log_kt(self.zeros, self.ones)
        self.kt = (self.ones + 0.5) / (self.zeros + self.ones + 1.0)


def solve_tree(levels: dict[int, tuple[np.ndarray, np.ndarray]], first: int, depth: int, root: tuple | None = None):
    """Context trees over depths ``first..depth``; ``levels[d]`` has sorted packed sequences of d + 1 bytes and counts.

    Returns, by bit position, the log weighted probabilities of the top nodes; with ``root``
    (sorted node keys with one byte of context less, their A and their B: the final prediction
    is B + A * this tree's) also the nodes' log beta and estimates and the log2 probability of each sequence of the deepest level.
    """
    tops, nodes, logp = [], [], np.zeros(len(levels[depth][0]))
    for bit in range(8):
        at = {d: _Level(*levels[d], bit) for d in range(first, depth + 1)}
        below = np.zeros(len(at[depth].node))
        for d in range(depth, first - 1, -1):
            x = at[d]
            x.below = below
            x.weighted = x.own if d == depth else np.logaddexp(x.own, below) - np.log(2)
            if d > first:
                mask = U64((1 << (8 * d)) - 1)  # of the parent's node key: d - 1 bytes of context and the prefix
                x.parent = np.searchsorted(at[d - 1].node, x.node & mask)
                below = np.bincount(x.parent, weights=x.weighted, minlength=len(at[d - 1].node))
        tops.append((at[first].node, at[first].weighted))
        if root is None:
            continue
        up = np.searchsorted(root[0], at[first].node & U64((1 << (8 * first)) - 1))
        a, b = root[1][up], root[2][up]
        for d in range(first, depth):
            x = at[d]
            log_beta = np.clip(x.own - x.below, -700, 700)
            own_share = 1 / (1 + np.exp(-log_beta))
            nodes.append((np.full(len(x.node), d), x.node, log_beta, x.kt))
            b, a = b + a * own_share * x.kt, a * (1 - own_share)
            down = at[d + 1].parent
            a, b = a[down], b[down]
        one = np.clip(b + a * at[depth].kt, 1e-300, 1 - 1e-16)
        p = np.where(at[depth].bit_of_gram, one[at[depth].of_gram], 1 - one[at[depth].of_gram])
        logp += np.log2(p)
    return tops, nodes, logp


class FrozenTree:
    """A solved model: exact lookups for sequences seen in training, node by node prediction for others."""

    def __init__(self, depth: int, leaves: list[tuple], nodes: dict[int, list[tuple]]) -> None:
        """``leaves``: parts of (keys, counts, logp); ``nodes``: by depth, parts of (node, log beta, estimate)."""
        self.depth = depth

        def joined(parts: list[tuple], kinds: tuple) -> list[np.ndarray]:
            columns = [np.concatenate([np.zeros(0, k), *(x[i] for x in parts)]) for i, k in enumerate(kinds)]
            parts.clear()
            order = np.argsort(columns[0])
            return [x[order] for x in columns]

        self.keys, counts, self.logp = joined(leaves, (U64, np.int64, np.float32))
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.nodes = {d: joined(nodes.get(d, []), (U64, np.float32, np.float32)) for d in range(depth)}
        keys = self.keys
        self.bits = max(4, int(len(keys) * 1.5).bit_length())
        self.slot_key = np.zeros(1 << self.bits, U64)  # key + 1; 0 is a free slot
        self.slot_logp = np.zeros(1 << self.bits, np.float32)
        self.probes = 0
        for i in range(0, len(self.keys), 1 << 18):  # part by part, so little is held beside the table
            left, probe = np.arange(i, min(len(self.keys), i + (1 << 18))), 0
            while len(left):
                slot = self._slot(self.keys[left], probe)
                free = np.flatnonzero(self.slot_key[slot] == 0)
                _, pick = np.unique(slot[free], return_index=True)
                put = free[pick]
                self.slot_key[slot[put]] = self.keys[left[put]] + U64(1)
                self.slot_logp[slot[put]] = self.logp[left[put]]
                left, probe = np.delete(left, put), probe + 1
            self.probes = max(self.probes, probe)

    def arrays(self) -> dict[str, np.ndarray]:
        """All tables by name."""
        out = {"keys": self.keys, "before": self.before, "logp": self.logp, "slot_key": self.slot_key, "slot_logp": self.slot_logp}
        out["sizes"] = np.array([self.bits, self.probes])
        for d, parts in self.nodes.items():
            out |= {f"node{d}_{i}": x for i, x in enumerate(parts)}
        return out

    @classmethod
    def mapped(cls, depth: int, arrays: dict[str, np.ndarray]) -> FrozenTree:
        """The model of tables made by ``arrays``."""
        out = cls.__new__(cls)
        out.depth = depth
        out.keys, out.before, out.logp, out.slot_key, out.slot_logp = (arrays[k] for k in ("keys", "before", "logp", "slot_key", "slot_logp"))
        out.bits, out.probes = (int(x) for x in arrays["sizes"])
        out.nodes = {d: [arrays[f"node{d}_{i}"] for i in range(3)] for d in range(depth)}
        return out

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64) + probe * (probe + 1) // 2) & ((1 << self.bits) - 1)

    def log2(self, grams: np.ndarray) -> np.ndarray:
        """Log2 probability of the last byte of each sequence given the bytes before."""
        slot = self._slot(grams, 0)
        out, want = self.slot_logp[slot].astype(np.float64), grams + U64(1)
        miss = np.flatnonzero(self.slot_key[slot] != want)
        for probe in range(1, self.probes):
            if not len(miss):
                break
            slot = self._slot(grams[miss], probe)
            hit = self.slot_key[slot] == want[miss]
            out[miss[hit]] = self.slot_logp[slot[hit]]
            miss = miss[~hit]
        if len(miss):
            fresh, back = np.unique(grams[miss], return_inverse=True)
            out[miss] = self.predict(fresh)[back]
        return out

    def predict(self, grams: np.ndarray) -> np.ndarray:
        """Log2 probability of sequences, seen or not, by walking each bit's tree from the root down."""
        byte, total = grams & U64(255), np.zeros(len(grams))
        for bit in range(8):
            prefix = U64(1 << bit) | (byte >> U64(8 - bit))
            a, b, x = np.ones(len(grams)), np.zeros(len(grams)), np.full(len(grams), 0.5)
            alive = np.ones(len(grams), bool)
            for d in range(self.depth):
                node, log_beta, kt = self.nodes[d]
                ctx = (grams >> U64(8)) & U64((1 << (8 * d)) - 1)
                key = (ctx << U64(8)) | prefix
                at = np.minimum(np.searchsorted(node, key), max(0, len(node) - 1))
                alive &= (node[at] == key) if len(node) else False
                share = np.where(alive, 1 / (1 + np.exp(-log_beta[at].astype(np.float64))), 0.0) if len(node) else np.zeros(len(grams))
                b = b + a * share * (kt[at] if len(node) else 0.5)
                a = a * (1 - share)
            ctx, width = grams >> U64(8), U64(8 - bit)
            low = (ctx << U64(8)) | ((byte >> width) << width)
            ends = [np.searchsorted(self.keys, low + U64(s)) for s in (0, 1 << (7 - bit), 1 << (8 - bit))]
            zeros, ones = (self.before[ends[i + 1]] - self.before[ends[i]] for i in (0, 1))
            x = np.where(alive, (ones + 0.5) / (zeros + ones + 1.0), 0.5)
            one = np.clip(b + a * x, 1e-300, 1 - 1e-16)
            total += np.log2(np.where((byte >> U64(7 - bit)) & U64(1) == 1, one, 1 - one))
        return total


def count_corpus(docs: DataFrame, depth: int) -> DataFrame:
    """``kind, key, n`` over the training rows of ``docs`` (``text, held``): word hashes (kind 0) and byte sequences (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.modules.pop("_larkspan_kept", None)  # a model that this worker scored with before
        cache, words, grams, size = HashCache(), Counter(), [], 0

        def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(counts[i : i + 100_000].astype(np.int64))], names=["kind", "key", "n"]
                )

        def word_rows() -> Iterator[pa.RecordBatch]:
            yield from rows(0, np.fromiter(words.keys(), U64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
            words.clear()

        def gram_rows() -> Iterator[pa.RecordBatch]:
            if grams:
                yield from rows(1, *np.unique(np.concatenate(grams), return_counts=True))
            grams.clear()

        for batch in batches:
            for text in batch.column(0):
                found = ascii_words(text.as_py())
                words.update(map(cache.__getitem__, found))
                words[cache[END]] += 1
                grams.append(byte_grams(found, depth))
                size += len(grams[-1])
                if size > 3_000_000:
                    yield from gram_rows()
                    size = 0
                if len(words) > 400_000:
                    yield from word_rows()
        yield from word_rows()
        yield from gram_rows()

    counted = docs.filter("NOT held").select("text").mapInArrow(run, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def solve_top(levels: dict[int, tuple[np.ndarray, np.ndarray]], below: dict[int, float]) -> tuple[list[tuple], tuple]:
    """The nodes above the parts: their rows ``(d, node, log_beta, kt)``, and the deepest ones' keys, A and B.

    ``levels`` is as for ``solve_tree``, from depth 0; ``below`` has the log probability of what hangs under each deepest node.
    """
    last, rows, ends = max(levels), [], []
    for bit in range(8 if len(levels[0][0]) else 0):
        at = {d: _Level(*levels[d], bit) for d in levels}
        under = np.array([below.get(int(k), 0.0) for k in at[last].node])
        for d in range(last, -1, -1):
            x = at[d]
            x.below = under
            if d:
                x.parent = np.searchsorted(at[d - 1].node, x.node & U64((1 << (8 * d)) - 1))
                under = np.bincount(x.parent, weights=np.logaddexp(x.own, x.below) - np.log(2), minlength=len(at[d - 1].node))
        a, b = np.ones(len(at[0].node)), np.zeros(len(at[0].node))
        for d in range(last + 1):
            x = at[d]
            if d:
                a, b = a[x.parent], b[x.parent]
            log_beta = np.clip(x.own - x.below, -700, 700)
            share = 1 / (1 + np.exp(-log_beta))
            a, b = a * (1 - share), b + a * share * x.kt
            rows += zip([d] * len(x.node), x.node.tolist(), log_beta.tolist(), x.kt.tolist())
        ends.append((at[last].node, a, b))
    node, a, b = (np.concatenate([np.zeros(0, U64 if i == 0 else float), *(x[i] for x in ends)]) for i in range(3))
    order = np.argsort(node)
    return rows, (node[order], a[order], b[order])


def train_tree(grams: DataFrame, depth: int, part_grams: int) -> str:
    """Solve the tree over ``key, n`` (sequences of depth + 1 bytes); returns the folder of the solved rows, by part; -1 is the top."""
    spark, first = grams.sparkSession, top_bytes(depth)
    masked = lambda d: F.col("key").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1))
    parts = max(16, -(-grams.count() // part_grams))
    levels = None
    for d in range(depth, first - 1, -1):
        part = grams if d == depth else grams.groupBy(masked(d).alias("key")).agg(F.sum("n").alias("n"))
        part = part.select(F.lit(d).alias("d"), "key", "n")
        levels = part if levels is None else levels.unionByName(part)
    levels = materialize(levels.withColumn("part", _part_column(F.col("key"), depth, parts)), "levels")
    top = {}
    pairs = grams.groupBy(masked(first - 1).alias("key")).agg(F.sum("n").alias("n"))  # at most 256 ** first rows
    found = np.array([tuple(r) for r in pairs.collect()], np.int64).reshape(-1, 2)
    for d in range(first - 1, -1, -1):
        keys, back = np.unique(found[:, 0] & ((1 << (8 * (d + 1))) - 1), return_inverse=True)
        top[d] = keys.view(U64), np.bincount(back, weights=found[:, 1], minlength=len(keys)).astype(np.int64)

    def arrays(pdf: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for d in range(first, depth + 1):
            part = pdf[pdf["d"] == d].sort_values("key")
            out[d] = (part["key"].to_numpy(np.int64).view(U64), part["n"].to_numpy(np.int64))
        return out

    def tops(pdf: pd.DataFrame) -> pd.DataFrame:
        found, _, _ = solve_tree(arrays(pdf), first, depth)
        node = np.concatenate([x[0] for x in found]) & U64((1 << (8 * first)) - 1)
        out = pd.DataFrame({"node": node.astype(np.int64), "w": np.concatenate([x[1] for x in found])})
        return out.groupby("node", as_index=False).sum()

    below = dict(tuple(r) for r in levels.groupBy("part").applyInPandas(tops, "node long, w double").groupBy("node").agg(F.sum("w")).collect())
    rows, ends = solve_top(top, below)
    shared = spark.sparkContext.broadcast(ends)  # at most 256 ** (first - 1) contexts

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        at = arrays(pdf)
        _, nodes, logp = solve_tree(at, first, depth, shared.value)
        d, node, log_beta, kt = (np.concatenate([np.zeros(0), *x]) if i != 1 else np.concatenate([np.zeros(0, U64), *x]) for i, x in enumerate(zip(*nodes) if nodes else [()] * 4))
        keys, n = at[depth]
        return pd.DataFrame(
            {
                "part": np.full(len(keys) + len(d), pdf["part"].iloc[0], np.int32),
                "d": np.concatenate([np.full(len(keys), depth), d]).astype(np.int32),
                "key": np.concatenate([keys, node]).view(np.int64),
                "n": np.concatenate([n, np.zeros(len(d), np.int64)]),
                "x": np.concatenate([logp, log_beta]),
                "kt": np.concatenate([np.zeros(len(keys)), kt]),
            }
        )

    kind = "part int, d int, key long, n long, x double, kt double"
    above = spark.createDataFrame([(-1, d, node, 0, log_beta, kt) for d, node, log_beta, kt in rows] + [(-1, -1, parts, 0, 0.0, 0.0)], kind)
    folder = scratch_path(spark, "tree")
    levels.groupBy("part").applyInPandas(solved, kind).unionByName(above).write.partitionBy("part").parquet(folder)
    return folder


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def _solved_rows(folder: str, part: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The solved rows of a part, batch by batch: ``d, key, n, x, kt``."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, path = _file_system(f"{folder}/part={part}")
    if system.get_file_info(path).type != fs.FileType.Directory:  # no sequence falls into this part
        return
    found = ds.dataset(path, filesystem=system, format="parquet")
    for batch in found.to_batches(batch_size=1 << 16, batch_readahead=0, fragment_readahead=0, use_threads=False):
        yield tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "key", "n", "x", "kt"))


def build_tree(folder: str, depth: int, part: int) -> FrozenTree:
    """Read the solved rows of a part, batch by batch, into lookup tables."""
    leaves, nodes = [], {}
    for d, key, n, x, kt in _solved_rows(folder, part):
        leaf = d == depth
        leaves.append((key[leaf].view(U64), n[leaf], x[leaf].astype(np.float32)))
        for k in np.unique(d[~leaf & (d >= 0)]).tolist():
            at = d == k
            nodes.setdefault(k, []).append((key[at].view(U64), x[at].astype(np.float32), kt[at].astype(np.float32)))
    pa.default_memory_pool().release_unused()
    return FrozenTree(depth, leaves, nodes)


def freeze_tree(spark: SparkSession, folder: str, depth: int) -> str:
    """A task for each part builds its lookup tables and writes them as plain arrays; returns their folder.

    Workers map these files, so the workers of a machine share one copy in the page cache
    instead of holding one each, and only what lookups touch is read.
    """
    target = scratch_path(spark, "model")
    parts = spark.read.parquet(folder).filter("part = -1 AND d = -1").first()["key"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                system, path = _file_system(f"{target}/{part}")
                system.create_dir(path, recursive=True)
                arrays = build_tree(folder, depth, part).arrays()
                if part < 0:
                    arrays["parts"] = np.array([parts])
                for name, values in arrays.items():
                    with system.open_output_stream(f"{path}/{name}.npy.part", compression=None) as out:
                        np.save(out, values)
                    system.move(f"{path}/{name}.npy.part", f"{path}/{name}.npy")
            yield pa.RecordBatch.from_pydict({"part": batch.column(0)})

    tasks = min(parts + 1, 4 * spark.sparkContext.defaultParallelism)
    spark.range(-1, parts, 1, tasks).mapInArrow(write, "part long").collect()  # a number for each part
    return target


def _mapped_file(path: str) -> np.ndarray:
    try:
        return np.load(path, mmap_mode="r")
    except ValueError:  # an empty array can't be mapped
        return np.load(path)


def _load_arrays(folder: str) -> dict[str, np.ndarray]:
    import tempfile

    from pyarrow import fs

    system, path = _file_system(folder)
    names = [x.base_name for x in system.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".npy")]
    if isinstance(system, fs.LocalFileSystem):
        return {n[:-4]: _mapped_file(f"{path}/{n}") for n in names}
    with tempfile.TemporaryDirectory() as own:  # copied once a worker; the open mapping outlives the folder's name
        arrays = {}
        for n in names:
            with system.open_input_stream(f"{path}/{n}") as source, open(f"{own}/{n}", "wb") as copy:
                while part := source.read(1 << 20):
                    copy.write(part)
            arrays[n[:-4]] = _mapped_file(f"{own}/{n}")
        return arrays


class PartedTree:
    """A frozen model in parts; a part is mapped when a sequence first falls into it."""

    def __init__(self, target: str, depth: int) -> None:
        self.target, self.depth, self.loaded = target, depth, {}
        arrays = _load_arrays(f"{target}/-1")
        self.parts = int(arrays["parts"][0])
        self.top = FrozenTree.mapped(depth, arrays)

    def _part(self, part: int) -> FrozenTree:
        if part not in self.loaded:
            tree = FrozenTree.mapped(self.depth, _load_arrays(f"{self.target}/{part}"))
            tree.nodes |= {d: self.top.nodes[d] for d in range(top_bytes(self.depth))}
            self.loaded[part] = tree
        return self.loaded[part]

    def _each(self, grams: np.ndarray, look: str) -> np.ndarray:
        part = part_of(grams, self.depth, self.parts).astype(np.uint16)  # below 65,536, and sorted by radix in this type
        order, out = np.argsort(part, kind="stable"), np.empty(len(grams))
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(at):
                out[at] = getattr(self._part(int(part[at[0]])), look)(grams[at])
        return out

    def log2(self, grams: np.ndarray) -> np.ndarray:
        """Log2 probability of the last byte of each sequence given the bytes before."""
        return self._each(grams, "log2")

    def predict(self, grams: np.ndarray) -> np.ndarray:
        """The same by walking the trees; see ``FrozenTree.predict``."""
        return self._each(grams, "predict")


def load_tree(target: str, depth: int) -> PartedTree:
    """A frozen model; a worker process keeps the one it used last."""
    kept = sys.modules.setdefault("_larkspan_kept", type(sys)("_larkspan_kept")).__dict__
    if kept.get("folder") != target:
        kept.clear()
        kept["tree"] = PartedTree(target, depth)
        kept["folder"] = target
    return kept["tree"]


def score_texts(
    docs: DataFrame,
    depth: int = 5,
    part_grams: int = 200_000,
    top_words: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes``."""
    spark = docs.sparkSession
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held")
    )
    counts = materialize(count_corpus(slim, depth), "counts")
    words = counts.filter("kind = 0").select("key", "n")
    total, distinct = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    floor = total + distinct + 1
    folder = freeze_tree(spark, train_tree(counts.filter("kind = 1").select("key", "n"), depth, part_grams), depth)
    bar = kth_largest(words, "n", top_words) or 0
    frequent = words.filter(F.col("n") > F.lit(bar))  # fewer than top_words rows
    listed = np.array([tuple(r) for r in frequent.collect()], np.int64).reshape(-1, 2)
    listed = listed[np.argsort(listed[:, 0].view(U64) if len(listed) else listed[:, 0])]
    shared = spark.sparkContext.broadcast((listed[:, 0].copy().view(U64), listed[:, 1].copy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, cache, (known, times) = load_tree(folder, depth), HashCache(), shared.value
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, len(whole), 500)):
            row, ids = batch.column(0).to_pylist(), batch.column(1)
            heads, rare, grams, scores, size = [], [], [], [], 0

            def score() -> None:
                """The parts are looked up for many texts at once."""
                if grams:
                    starts = np.cumsum([0, *map(len, grams)])[:-1]
                    scores.extend((np.add.reduceat(tree.log2(np.concatenate(grams)), starts) * np.log10(2)).tolist())
                    grams.clear()

            for i, text in enumerate(batch.column(2)):
                found = ascii_words(text.as_py())
                grams.append(byte_grams(found, depth))
                size += len(grams[-1])
                hashed, n = np.unique(cache.array([*found, END]), return_counts=True)
                at = np.minimum(np.searchsorted(known, hashed), max(0, len(known) - 1))
                hit = (known[at] == hashed) if len(known) else np.zeros(len(hashed), bool)
                base = float((n[hit] * np.log10((times[at[hit]] + 1) / floor)).sum())
                heads.append((int(n.sum()), int(n[hit].sum()), base, len(grams[-1])))
                if size > 500_000:
                    score()
                    size = 0
                left = ~hit
                rare.append((np.full(int(left.sum()), row[i]), hashed[left].view(np.int64), n[left]))
            score()
            heads = [(*x[:3], y, x[3]) for x, y in zip(heads, scores)]
            r, h, n = (np.concatenate(x) for x in zip(*rare))
            size, few = len(row), len(r)
            none = lambda k, kind: pa.nulls(k, kind)
            columns = [
                pa.array(np.concatenate([np.array(row, np.int64), r.astype(np.int64)])),
                pa.array(np.concatenate([mix64(np.array(row, np.int64).view(U64)).view(np.int64), h])),
                pa.array(np.concatenate([np.zeros(size, np.int64), n.astype(np.int64)])),
                pa.array(np.concatenate([np.ones(size, bool), np.zeros(few, bool)])),
                pa.concat_arrays([ids, none(few, ids.type)]),
                pa.concat_arrays([batch.column(3), none(few, pa.bool_())]),
            ]
            for values, kind in zip(zip(*heads), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())):
                columns.append(pa.concat_arrays([pa.array(values, kind), none(few, kind)]))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "h", "n", "head", "doc_id", "held", "n_tokens", "top_known", "top_base", "score", "n_bytes"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    parts = slim.mapInArrow(
        run,
        f"row long, h long, n long, head boolean, doc_id {kind}, held boolean, n_tokens long, top_known long, top_base double, score double, n_bytes long",
    )
    times = words.select(F.col("key").alias("w"), F.col("n").alias("c")).filter(F.col("c") <= F.lit(bar))
    met = parts.join(times, F.col("h") == F.col("w"), "left")
    c = F.when(F.col("head"), F.lit(0)).otherwise(F.coalesce("c", F.lit(0)))
    sums = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("top_known") + F.sum(F.when(c > 0, F.col("n")).otherwise(0))).alias("n_known"),
        (F.max("top_base") + F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(floor))))).alias("base_score"),
        F.max("score").alias("score"),
        F.max("n_bytes").alias("n_bytes"),
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents"))
    return out.withColumn("base_score", F.round("base_score", 6)).withColumn("score", F.round("score", 6)).drop("n_bytes")
