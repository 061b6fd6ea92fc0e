"""Filling containers of fixed capacity with documents (problem 8).

1. Each task counts tokens, cuts documents longer than a container into full containers and a rest, and
   numbers its pieces within their size class.
2. The histogram over size classes (at most ``CLASSES`` rows) goes to the driver. A configuration linear
   program over it, one variable per way to fill a container, is solved by multiplicative weights: each
   class has a weight that shrinks with its covered share, the price of an item is its size times the
   weight, and a knapsack dynamic program finds the configurations of the highest price. Prices over
   the price of the best configuration are feasible for the dual program, so each round also gives a
   lower bound on the number of containers. A configuration is used until one of its classes is used
   up, so the solution covers the whole histogram with at most as many configurations as classes.
3. The solution is rounded to the nearest number of containers while their items last; what is left over
   (less than one container per configuration, so at most ``CLASSES`` containers whatever the data's
   size) is packed by best fit.
4. The plan, a table of rank intervals per class, goes to the tasks: rank within class (counts of earlier
   tasks plus number within the task) gives the container. No group is ever collected.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import written

CAPACITY, CLASSES = 4096, 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How a text is split before merges, as the vocabulary's makers state it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How fast weights fall with the covered share of a class; how much more than their size large items weigh at first.
RATE, LARGE = 0.05, 0.02
#: Configurations tried with one pricing table, and how far below the best one they may be.
BATCH, SLACK = 12, 1e-3
#: Classes below this are priced one by one, larger ones in blocks of this many rooms.
SMALL = 32

_PIECES = "doc_id bigint, piece_no int, size int, cls int, task int, place bigint"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("size", pa.int32()), ("cls", pa.int32()), ("task", pa.int32()), ("place", pa.int64())])


def token_counter(vocabulary: bytes):  # noqa: ANN201
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def _class_of(size: int, capacity: int, classes: int) -> int:
    return -(-size * classes // capacity)


def _counted(vocabulary: Broadcast, capacity: int, classes: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count, task, seen = token_counter(vocabulary.value), TaskContext.get().partitionId(), np.zeros(classes + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, no = count(text or ""), 0
                while n > capacity:
                    rows.append((doc, no, capacity, classes, task, int(seen[classes])))
                    seen[classes] += 1
                    n, no = n - capacity, no + 1
                c = _class_of(n, capacity, classes)
                rows.append((doc, no, n, c, task, int(seen[c])))
                seen[c] += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)

    return run


def price_table(price: np.ndarray) -> np.ndarray:
    """The highest price of what fits into each room 0..classes: unbounded knapsack over items of classes 1..classes."""
    classes = len(price) - 1
    best = np.zeros(classes + 1)
    for c in np.flatnonzero(price[:SMALL] > 0).tolist():
        # any number of items of one class: running maximum along rooms that differ by its size
        steps = -(-(classes + 1) // c)
        grid = np.concatenate([best, np.zeros(steps * c - classes - 1)]).reshape(steps, c)
        gain = np.arange(steps)[:, None] * price[c]
        best = (np.maximum.accumulate(grid - gain) + gain).ravel()[: classes + 1]
    if classes < SMALL:
        return np.maximum.accumulate(best)
    # rooms below 0 are worth nothing: a margin before the table holds them
    table = np.concatenate([np.full(classes, -np.inf), np.maximum.accumulate(best)])
    room = table[classes:]
    worth = np.where(price > 0, price, -np.inf)[SMALL:]
    last = SMALL + int(np.flatnonzero(price[SMALL:] > 0)[-1]) + 1 if (price[SMALL:] > 0).any() else SMALL
    for lo in range(SMALL, classes + 1, SMALL):
        # the rest of a room of this block beside a large item lies before the block
        rows, hi = min(SMALL, classes + 1 - lo), min(lo + SMALL, last)
        if hi > SMALL:
            rest = sliding_window_view(table[classes + lo - hi + 1 : classes + lo - SMALL + rows], hi - SMALL)[:, ::-1]
            room[lo : lo + rows] = np.maximum(room[lo : lo + rows], (rest + worth[: hi - SMALL]).max(1))
    return room


def best_filling(price: np.ndarray, best: np.ndarray, room: int) -> list[int]:
    """Classes of a filling of ``room`` with the price that the table gives it."""
    items = np.flatnonzero(price > 0)
    taken = []
    while best[room] > 1e-12:
        fit = items[: np.searchsorted(items, room, "right")]
        got = best[room - fit] + price[fit]
        k = int(got.argmax()) if len(fit) else -1
        if k < 0 or got[k] < best[room] - 1e-9:
            room -= 1  # a smaller room has the same price
            continue
        taken.append(int(fit[k]))
        room -= int(fit[k])
    return taken


def solve(histogram: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[float], float]:
    """(configurations, their fractional numbers, lower bound): the configurations, as (classes, counts), cover
    ``histogram`` (index: class) exactly; no cover has fewer containers than the bound."""
    classes = len(histogram) - 1
    need = histogram.astype(float)
    need[0] = 0
    left = need.copy()
    size = np.arange(classes + 1) / classes
    weight = np.exp(LARGE * size)
    bound = float(size @ need)  # all weights alike: no configuration is worth more than 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    number: list[float] = []
    while (left > 0).any():
        price = np.where(left > 0, size * weight, 0)
        best = price_table(price)
        bound = max(bound, float(price @ need) / best[classes])
        taken = tried = 0
        open_ = np.flatnonzero(left > 0)
        for c in open_[np.argsort(-weight[open_], kind="stable")].tolist():
            if left[c] <= 0 or (taken and price[c] + best[classes - c] < best[classes] * (1 - SLACK)):
                continue
            if tried == BATCH:
                break
            tried += 1
            k, m = np.unique([c, *best_filling(price, best, classes - c)], return_counts=True)
            if (left[k] <= 0).any():
                continue  # used up since the table was made
            room = left[k] / m
            step = float(room.min())
            found.append((k, m))
            number.append(step)
            left[k] -= step * m
            left[k[room.argmin()]] = 0
            weight[k] *= np.exp(-RATE * step * m / need[k])
            taken += 1
        left[left < 1e-6] = 0
    return found, number, bound


def best_fit(classes_left: list[int], capacity: int) -> list[list[int]]:
    """Containers (lists of classes) for items by falling size, each put where least room stays."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for c in sorted(classes_left, reverse=True):
        k = bisect_left(rooms, (c, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(c)
        insort(rooms, (room - c, b))
    return bins


def plan(histogram: np.ndarray) -> tuple[dict[int, list[tuple[int, int, int]]], int, int]:
    """Per class the intervals (first rank, first container, items per container), the number of
    containers, and how many items best fit had to place."""
    found, number, _ = solve(histogram)
    left = histogram.copy()
    left[0] = 0
    intervals: dict[int, list[tuple[int, int, int]]] = {}
    ranks = np.zeros(len(histogram), np.int64)
    containers = 0

    def place(c: int, per: int, times: int) -> None:
        intervals.setdefault(c, []).append((int(ranks[c]), containers, per))
        ranks[c] += per * times
        left[c] -= per * times

    def use(k: np.ndarray, m: np.ndarray, times: int) -> None:
        nonlocal containers
        for c, per in zip(k.tolist(), m.tolist(), strict=True):
            place(c, per, times)
        containers += times

    whole = [int(x + 1e-9) for x in number]
    for (k, m), times in zip(found, whole, strict=True):
        if times:
            use(k, m, times)
    for i in sorted(range(len(found)), key=lambda i: whole[i] - number[i]):  # largest fractions first
        k, m = found[i]
        if number[i] - whole[i] > 1e-9 and (left[k] >= m).all():
            use(k, m, 1)
    rest = [c for c in range(1, len(left)) for _ in range(int(left[c]))]
    for items in best_fit(rest, len(histogram) - 1):
        for c in dict.fromkeys(items):
            place(c, items.count(c), 1)
        containers += 1
    return intervals, containers, len(rest)


def _placed(intervals: dict[int, list[tuple[int, int, int]]], capacity: int):  # noqa: ANN202
    starts = {c: [x[0] for x in rows] for c, rows in intervals.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, rank in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if c == 0:
                    out.append(0)  # without tokens: takes no room anywhere
                    continue
                first, base, per = intervals[c][bisect_right(starts[c], rank) - 1]
                out.append(base + (rank - first) // per)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.int64())], names=["doc_id", "piece_no", "size", "container_id"])

    return run


def packed(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, classes: int = CLASSES) -> DataFrame:
    """(doc_id, piece_no, size, container_id) of every distinct document.

    Sizes are tokens of the vocabulary at the path ``tokenizer``. A document lies whole in one container
    unless it is longer than ``capacity``; then its first pieces fill containers of their own. Documents
    with one id and different texts are packed each; null and empty texts have size 0 and container 0.
    Sizes are rounded up to ``capacity / classes`` for planning only; no container is overfull.
    """
    if capacity % classes:
        raise ValueError("the capacity must be a multiple of the number of classes")
    with open(tokenizer, "rb") as f:  # read here and shipped: executors need no copy of the file
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())
    docs = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    pieces = written(docs.mapInArrow(_counted(vocabulary, capacity, classes), _PIECES), "p8-pieces")
    per_task = pieces.groupBy("cls", "task").agg(F.count("*").alias("n"))
    # one row per class and task: a window over these small counts gives each task its first rank
    offsets = per_task.withColumn("before", F.sum("n").over(W.partitionBy("cls").orderBy("task").rowsBetween(W.unboundedPreceding, -1)))
    histogram = np.zeros(classes + 1, np.int64)
    for r in per_task.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # at most classes + 1 rows
        histogram[r.cls] = r.n
    intervals, _, _ = plan(histogram)
    ranked = pieces.join(offsets.select("cls", "task", F.coalesce("before", F.lit(0)).alias("before")), ["cls", "task"])
    ranked = ranked.select("doc_id", "piece_no", "size", "cls", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(_placed(intervals, capacity), "doc_id bigint, piece_no int, size int, container_id bigint")


def packing_report(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(pieces, tokens, containers, least_containers, fill): how full the containers are."""
    per = assigned.filter("size > 0").groupBy("container_id").agg(F.count("*").alias("n"), F.sum("size").alias("t"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.count("*").alias("containers"), F.max("t").alias("fullest"))
    least = F.ceil(F.col("tokens") / capacity)
    return out.select("pieces", "tokens", "containers", least.alias("least_containers"), "fullest", (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"))


def packing_check(documents: DataFrame, assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(documents, missing, overfull, split_but_short): one row that counts documents, those in no container,
    containers above the capacity, and documents that were cut although they fit into one."""
    ids = documents.select(F.col("doc_id").cast("bigint")).distinct()
    per_doc = assigned.groupBy("doc_id").agg(F.max("piece_no").alias("cuts"), F.sum("size").alias("t"))
    met = ids.join(per_doc, "doc_id", "left").agg(F.count("*").alias("documents"), F.count_if(F.col("t").isNull()).alias("missing"), F.count_if((F.col("cuts") > 0) & (F.col("t") <= capacity)).alias("split_but_short"))
    over = assigned.groupBy("container_id").agg(F.sum("size").alias("t")).agg(F.count_if(F.col("t") > capacity).alias("overfull"))
    return met.join(F.broadcast(over)).select("documents", "missing", "overfull", "split_but_short")  # one row each
