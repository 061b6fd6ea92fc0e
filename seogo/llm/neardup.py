"""Near-duplicate chunks (problem 5): every pair at or above a similarity, and their groups.

Similarity is Jaccard over distinct runs of three tokens. A set of runs is a bit vector and two sets
are as similar as ``t`` only if the Hamming distance of the vectors, the size of the symmetric
difference, is at most ``(1 - t) / (1 + t) * (|A| + |B|)``.

1. Copies (equal token sequences) form classes; one member stands for its class.
2. Candidates: the runs of a set are ordered from rare to common by a hashed count table of fixed size.
   With ``m`` shared runs or more, the first shared run lies among the first ``n - m + 1`` of both sets
   (prefix filter, exact for any order): ``m`` is at least ``2 t / (1 + t) n`` for the smaller set and
   ``t n`` for the larger one. Only those prefixes are shuffled, packed by task and partition.
3. Pivot distance tables: reference fingerprints are unions of 64 hash classes of runs. The Hamming
   distance of a set to every union follows from its 64 class counts, and the largest coordinate
   difference over all 2 ** 64 references is the sum of the absolute count differences. By the triangle
   inequality it bounds the distance of two sets from below; pairs above the bound are discarded where
   they arise, so that none of them is shuffled. Survivors pass the same bound with ``FINE`` classes.
4. Survivors are verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from .pairs import FULL_CLASS, copy_links, expand_links

THRESHOLD, RUN, LEAST_TOKENS = 0.6, 3, 40
#: Buckets of the count table, in slices; its size does not grow with the data. It orders runs, and any order is exact.
BUCKETS, SLICES = 1 << 22, 64
#: Runs of a partition, of which it holds the prefixes; more data means more partitions.
PART_RUNS = 8_000_000
#: Pairs compared at once.
BLOCK = 1 << 20
#: Hash classes of runs; every union of them is a reference fingerprint.
CLASSES = 64
#: Classes of the second distance table, kept only for sets that have survivors.
FINE = 1024
_HASH_BITS = 48
_K = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


class _TokenHashes(dict):
    """Token -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], known: _TokenHashes, run: int = RUN, least: int = LEAST_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with enough tokens: (their numbers, 64-bit hashes of their token sequences, offsets,
    sorted distinct run hashes)."""
    numbers, names, flat, sizes = [], [], [], []
    for k, text in enumerate(texts):
        tokens = (text or "").lower().split()
        if len(tokens) < max(least, run):
            continue
        numbers.append(k)
        names.append(xxhash.xxh3_64_intdigest(" ".join(tokens).encode("utf-8", "surrogatepass")))
        flat += map(known.__getitem__, tokens)
        sizes.append(len(tokens))
    if not numbers:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(1, np.int64), np.zeros(0, np.int64))
    t, sizes_ = np.array(flat, np.uint64), np.array(sizes)
    with np.errstate(over="ignore"):
        h = np.zeros(len(t) - run + 1, np.uint64)
        for j in range(run):
            h = _mixed(h * _K[0] + t[j : len(t) - run + 1 + j] * _K[1] + _K[2])
    h >>= np.uint64(64 - _HASH_BITS)
    owner = np.repeat(np.arange(len(sizes)), sizes_)
    inside = owner[: len(h)] == owner[run - 1 :]
    h, owner = h[inside], owner[: len(h)][inside]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
    return np.array(numbers), np.array(names, np.uint64).astype(np.int64), offsets, h.astype(np.int64)


def class_counts(offsets: np.ndarray, runs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Runs of each set by hash class, up to 255 (which keeps differences lower bounds)."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * classes + (runs & (classes - 1)), minlength=n * classes)
    return np.minimum(counts, 255).astype(np.uint8).reshape(n, classes)


_SETS = "doc bigint, chunk_id string, first boolean, slice int, counts binary"
_SETS_ARROW = pa.schema([("doc", pa.int64()), ("chunk_id", pa.string()), ("first", pa.bool_()), ("slice", pa.int32()), ("counts", pa.binary())])


def _bucket(runs: np.ndarray) -> np.ndarray:
    return (runs >> 6) & (BUCKETS - 1)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per set; then, without a set, the task's counts of runs by bucket, a row per slice."""
    known, seen, total = _TokenHashes(), set(), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        numbers, classes, offsets, runs = shingle_sets(batch.column(1).to_pylist(), known)
        # a copy of a set of the same task keeps its class only
        first = np.array([c not in seen and not seen.add(c) for c in classes.tolist()], bool)
        total += np.bincount(_bucket(runs[np.repeat(first, np.diff(offsets))]), minlength=BUCKETS)
        ids, none = batch.column(0).take(pa.array(numbers, pa.int64())), pa.nulls(len(numbers))
        yield pa.RecordBatch.from_arrays([pa.array(classes), ids, pa.array(first), none.cast(pa.int32()), none.cast(pa.binary())], schema=_SETS_ARROW)
    if seen:
        slices = [_compressed(x.astype(np.uint32)) for x in total.reshape(SLICES, -1)]
        none = pa.nulls(SLICES)
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.bool_()), pa.array(range(SLICES), pa.int32()), pa.array(slices, pa.binary())], schema=_SETS_ARROW)


def _compressed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True)


def _restored(x: bytes, dtype: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (slice, counts) of all tasks: (slice, rank of each bucket, a byte that grows with its count, runs)."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[k] = total.get(k, 0) + _restored(x, np.uint32, BUCKETS // SLICES).astype(np.int64)
    ranks = [np.where(x < 128, x, np.minimum(128 + 8 * np.log2(np.maximum(x, 128) / 128), 255)).astype(np.uint8).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary()), pa.array([int(x.sum()) for x in total.values()], pa.int64())], names=["slice", "ranks", "runs"])


def prefix_lengths(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """How many first runs a set of ``n`` needs to meet smaller sets, and larger ones."""
    long, short = (n - np.ceil(f * n - 1e-9).astype(np.int64) + 1 for f in (threshold, 2 * threshold / (1 + threshold)))
    return long, short


_PACKED = "part int, docs int, rows int, doc binary, n binary, counts binary, h binary, owner binary, place binary"
_PACKED_ARROW = pa.schema([("part", pa.int32()), ("docs", pa.int32()), ("rows", pa.int32()), *((c, pa.binary()) for c in ("doc", "n", "counts", "h", "owner", "place"))])


def _prefixes(ranks, threshold: float, parts: int):  # noqa: ANN001, ANN202
    """Prefixes of the sets of a batch, as a row per partition that has each set's class counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, seen = np.frombuffer(ranks.value, np.uint8), _TokenHashes(), set()
        for batch in batches:
            _, classes, offsets, runs = shingle_sets(batch.column(0).to_pylist(), known)
            first = np.array([c not in seen and not seen.add(c) for c in classes.tolist()], bool)
            if not first.any():
                continue
            counts, sizes = class_counts(offsets, runs)[first], np.diff(offsets)
            classes, runs, sizes = classes[first], runs[np.repeat(first, sizes)], sizes[first]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((runs, table[_bucket(runs)], owner))  # owners stay in place
            place = np.arange(len(runs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            take = place < np.repeat(prefix_lengths(sizes, threshold)[0], sizes)
            h, owner, place = runs[order][take], owner[take], place[take]
            part = h % parts
            order = np.lexsort((h, part))
            h, owner, place, at = h[order], owner[order], place[order], np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(at)):
                cut = slice(at[p], at[p + 1])
                docs, local = np.unique(owner[cut], return_inverse=True)
                steps = np.diff(h[cut] // parts, prepend=0)
                arrays = (classes[docs], sizes[docs].astype(np.int32), counts[docs], steps, local.astype(np.int32), place[cut].astype(np.int32))
                rows.append((int(p), len(docs), len(local), *map(_compressed, arrays)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED_ARROW, strict=True)], schema=_PACKED_ARROW)

    return run


def _allowed(x: np.ndarray, y: np.ndarray, both: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pivot distances allow the threshold; ``both`` is the sum of the sizes."""
    return (np.maximum(x, y) - np.minimum(x, y)).sum(1, dtype=np.int64) <= (1 - threshold) / (1 + threshold) * both + 1e-9


def _finer(threshold: float):  # noqa: ANN202
    """Of (a, b, sum of sizes, fine counts of both), the pairs that the second distance table allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                cut = batch.slice(k, 2000)
                x, y = (np.stack([_restored(c, np.uint8, FINE) for c in cut.column(j).to_pylist()]) for j in (3, 4))
                keep = _allowed(x, y, cut.column(2).to_numpy(), threshold)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _near(threshold: float, parts: int):  # noqa: ANN202
    """Of all packed prefixes of a partition, the pairs that share a run of theirs and whose sizes, places
    and pivot distances allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, entries, before = [], [], 0
        for batch in batches:
            for r in batch.to_pylist():
                d, k = r["docs"], r["rows"]
                tables.append((_restored(r["doc"], np.int64, d), _restored(r["n"], np.int32, d), _restored(r["counts"], np.uint8, d * CLASSES).reshape(d, CLASSES)))
                entries.append((np.cumsum(_restored(r["h"], np.int64, k)) * parts + r["part"], _restored(r["owner"], np.int32, k) + np.int32(before), _restored(r["place"], np.int32, k)))
                before += d
        if not tables:
            return
        doc, size, counts = (np.concatenate(c) for c in zip(*tables, strict=True))
        h, owner, place = (np.concatenate(c) for c in zip(*entries, strict=True))
        del tables, entries
        order = np.lexsort((doc[owner], size[owner], h))
        h, owner, place = h[order], owner[order], place[order]
        fresh = np.ones(len(h), bool)  # copies of a class may arrive from several tasks
        fresh[1:] = (h[1:] != h[:-1]) | (doc[owner[1:]] != doc[owner[:-1]])
        h, owner, place = h[fresh], owner[fresh], place[fresh]
        n = size[owner].astype(np.int64)
        group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) << 32
        short = place < prefix_lengths(n, threshold)[1]
        small = np.flatnonzero(short)
        # each row meets the short prefixes of its group that come before it and are not too small
        lo = np.searchsorted((group + n)[small], group + np.ceil(threshold * n - 1e-9).astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(np.maximum(np.cumsum(short) - short - lo, 0))])
        found: list[np.ndarray] = []
        for start in range(0, int(ends[-1]), BLOCK):
            stop = min(start + BLOCK, int(ends[-1]))
            j0, j1 = int(np.searchsorted(ends, start, "right")) - 1, int(np.searchsorted(ends, stop))
            y = np.repeat(np.arange(j0, j1), np.minimum(ends[j0 + 1 : j1 + 1], stop) - np.maximum(ends[j0:j1], start))
            x = small[lo[y] + np.arange(start, stop) - ends[y]]
            both = n[x] + n[y]
            least = np.ceil(threshold / (1 + threshold) * both - 1e-9)
            can = np.flatnonzero((n[x] - place[x] >= least) & (n[y] - place[y] >= least))
            u, v, both = owner[x[can]], owner[y[can]], both[can]
            keep = _allowed(counts[u], counts[v], both, threshold)
            a, b = doc[u[keep]], doc[v[keep]]
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
            if sum(map(len, found)) > 4 * BLOCK:
                yield from _pairs(found)
                found = []
        if found:
            yield from _pairs(found)

    return run


def _pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    pairs = np.unique(np.concatenate(found), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _TokenHashes()
    for batch in batches:
        numbers, classes, offsets, runs = shingle_sets(batch.column(0).to_pylist(), known)
        for k in range(0, len(numbers), 1000):  # fine counts are wide
            at = offsets[k : k + 1001]
            mine = runs[at[0] : at[-1]]
            fine = pa.array([_compressed(x) for x in class_counts(at - at[0], mine, FINE)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes[k : k + 1000]), pa.array(np.diff(at)), fine, pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(mine))],
                names=["doc", "n", "fine", "runs"],
            )


def _verified(threshold: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = []
            av, ao, bv, bo = a.flatten().to_numpy(), a.offsets.to_numpy(), b.flatten().to_numpy(), b.offsets.to_numpy()
            ao, bo = ao - ao[0], bo - bo[0]
            for k in range(batch.num_rows):
                x, y = av[ao[k] : ao[k + 1]], bv[bo[k] : bo[k + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def similar_sets(chunks: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links, members): (class_a, class_b) of similar classes of copies and (cls, id) of all chunks.

    Chunks with fewer than ``LEAST_TOKENS`` tokens, or null texts, belong to no class. A chunk id stored
    twice with one text counts once; with two texts it belongs to two classes. Extra columns are
    ignored. A class is named by a 64-bit hash of its tokens.
    """
    spark = chunks.sparkSession
    texts = chunks.select(F.col("chunk_id").cast("string"), F.col("text").cast("string")).filter("chunk_id is not null and text is not null")
    sets = written(texts.mapInArrow(_sets, _SETS), "p5-sets")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = sets.filter("slice is not null").select("slice", "counts").repartition(min(parts, SLICES), "slice")
    table = np.zeros((SLICES, BUCKETS // SLICES), np.uint8)
    total = 0
    for r in slices.mapInArrow(_summed, "slice int, ranks binary, runs bigint").collect():  # a byte per bucket
        table[r.slice] = np.frombuffer(r.ranks, np.uint8)
        total += r.runs
    parts = max(parts, -(-total // PART_RUNS))  # a task holds the prefixes of a partition
    sets = sets.filter("slice is null")
    ranks = spark.sparkContext.broadcast(table.tobytes())
    packed = texts.select("text").mapInArrow(_prefixes(ranks, threshold, parts), _PACKED).repartitionById(parts, F.col("part"))
    near = written(packed.mapInArrow(_near(threshold, parts), "a bigint, b bigint").distinct(), "p5-near")
    # the sets of survivors are made again from their texts: cheaper than keeping all sets
    named = _those(sets.filter("first").select("doc", "chunk_id"), _ends(near)).dropDuplicates(["doc"]).select("chunk_id")
    full = written(_those(texts, named, "chunk_id").select("text").mapInArrow(_runs_of, "doc bigint, n bigint, fine binary, runs array<bigint>").dropDuplicates(["doc"]), "p5-runs")
    ta, tb = (full.select(F.col("doc").alias(c), F.col("n").alias("n" + c), F.col("fine").alias("f" + c)) for c in "ab")
    met = near.join(ta, "a").join(tb, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "fa", "fb")
    close = written(met.mapInArrow(_finer(threshold), "a bigint, b bigint"), "p5-close")
    fa, fb = (full.select(F.col("doc").alias(c), F.col("runs").alias("r" + c)) for c in "ab")
    sure = close.join(fa, "a").join(fb, "b").select("a", "b", "ra", "rb").mapInArrow(_verified(threshold), "a bigint, b bigint")
    return sure.select(F.col("a").alias("class_a"), F.col("b").alias("class_b")), sets.select(F.col("doc").alias("cls"), F.col("chunk_id").alias("id")).distinct()


#: Ids up to this number (8 bytes each) are broadcast; more are joined by shuffling.
BROADCAST_IDS = 200_000


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()


def _those(rows: DataFrame, ids: DataFrame, key: str = "doc") -> DataFrame:
    """Rows whose ``key`` is among ``ids``; the ids are broadcast only if they were counted to be few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def found_near_duplicates(chunks: DataFrame, threshold: float = THRESHOLD, full_class: int | None = FULL_CLASS) -> DataFrame:
    """(chunk_id_a, chunk_id_b) of chunks with similarity of at least ``threshold``.

    Classes of more than ``full_class`` exact copies are linked through their smallest chunk id
    (see ``pairs``); all smaller ones are expanded into every pair, and with null all are.
    """
    links, members = similar_sets(chunks, threshold)
    links = written(links, "p5-links")
    pairs = expand_links(links, members, full_class).unionByName(copy_links(members, full_class))
    return pairs.filter("id_a <> id_b").select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b")).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (u, v); the component is its smallest node.

    Alternating large-star and small-star steps; each step's edges are written, so the lineage is
    one step long. Stops when a step changes nothing; raises if that takes more than ``rounds``.
    """
    e = written(edges.select("u", "v").filter("u <> v").distinct(), "cc")
    state = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = written(small.filter("u <> v").distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
        state = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def near_duplicate_groups(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(chunk_id, class_id, group_id, links): one row per chunk that has a class; groups are connected by links.

    Classes and groups are named by their smallest chunk id, ``links`` is the number of classes similar to the chunk's
    own. Whatever ``found_near_duplicates`` links through a representative follows from the classes given here.
    """
    links, members = similar_sets(chunks, threshold)
    links = written(links.select(F.col("class_a").alias("u"), F.col("class_b").alias("v")), "p5-links")
    degree = links.select("u").union(links.select("v")).groupBy("u").agg(F.count("*").alias("links")).withColumnRenamed("u", "c")
    named = written(members.groupBy(F.col("cls").alias("c")).agg(F.min("id").alias("class_id")).join(components(links).select(F.col("node").alias("c"), "component"), "c", "left").join(degree, "c", "left"), "p5-classes")
    groups = named.filter("component is not null").groupBy("component").agg(F.min("class_id").alias("group_id"))
    classes = named.join(groups, "component", "left").select("c", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    return members.select(F.col("cls").alias("c"), F.col("id").alias("chunk_id")).join(classes, "c").select("chunk_id", "class_id", "group_id", "links")
