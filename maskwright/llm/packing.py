"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

The histogram (at most `capacity` lengths, so bounded whatever the corpus) goes to the driver. There a
covering program over size classes - how many sequences of each configuration cover all pieces - is solved
by multiplicative weights: each round a knapsack dynamic program prices the configuration of most weight.
The fractional solution is rounded down and repaired with exact lengths - each class gives its longest piece that fits, the
last two are chosen to close the sequence - and a pattern is taken only if it fills its sequence as well as its configuration
does; residual programs treat what is left. Each step uses a pattern as often as the counts allow, so it finishes a length or a
configuration. Rounding ends with best fit over the pieces that no program places, and with those of the last patterns, of which as many are
taken back as leaves the fewest sequences; of equals the one that keeps most. So the packing never needs more than best fit alone. Pieces then find their
place by their rank among the pieces of their length: no document ever reaches the driver.

Defined results: null and empty texts are one end id; longer documents are cut every `capacity` ids;
repeated rows are packed as often as they occur; an empty table packs into nothing; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import default_tokenizer, encode

#: Size classes of the linear program (capacity / CLASSES lengths share the nearest one), its rounds and rate.
CLASSES, ROUNDS, RATE = 512, 600, 0.25
#: Programs at most, each over what the one before has left.
PROGRAMS = 4


def token_pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with end_id behind, cut every `capacity` ids."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        for ids, texts in common.steps(batches, "doc_id", "text"):
            rows = []
            for doc, found in zip(ids, encode(path, texts, end_id)):
                for k, at in enumerate(range(0, len(found), capacity)):
                    part = found[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return common.doc_columns(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def price(values: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: how many of each size 1..capacity make the most value in `capacity`."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=int)
    for room in range(1, capacity + 1):
        gain = values[1 : room + 1] + best[room - 1 :: -1][:room]
        k = int(gain.argmax())
        if gain[k] > best[room - 1]:
            best[room], last[room] = gain[k], k + 1
        else:
            best[room] = best[room - 1]
    take, room = np.zeros(capacity + 1, dtype=int), capacity
    while room:
        if last[room]:
            take[last[room]] += 1
            room -= last[room]
        else:
            room -= 1
    return take


def solve(demand: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[tuple[tuple[int, int], ...], float]]:
    """Multiplicative weights for min sum(x) with sum(take * x) >= demand over all configurations: (take, x) pairs.

    demand[s] pieces have size s (index 0 unused); take has (size, number). A row's weight falls as its cover grows. x is
    scaled so that configurations hold the volume of all pieces."""
    capacity, rows = len(demand) - 1, np.flatnonzero(demand)
    if not len(rows):
        return []
    cover, amount = np.zeros(len(demand)), {}
    for _ in range(rounds):
        value = np.zeros(len(demand))
        done = cover[rows] / demand[rows]
        value[rows] = np.exp(-(done - done.min()) / rate) / demand[rows]
        take = price(value, capacity)
        used = np.flatnonzero(take)
        step = rate * (demand[used] / take[used]).min()
        cover += step * take
        key = tuple(zip(used.tolist(), take[used].tolist()))
        amount[key] = amount.get(key, 0.0) + step
    scale = float((cover @ np.arange(len(cover))) / (demand @ np.arange(len(demand))))
    return sorted(((c, x / scale) for c, x in amount.items()), key=lambda p: -p[1])


Entry = tuple[int, int, int, int, int]
#: Shares of the programs' sequences that rounding may keep.
SHARES = (1.0, 0.98, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.3, 0.1, 0.0)


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pieces of a sequence, times): each piece, longest first, in the sequence with the least room that it fits; alike sequences go together."""
    rooms: dict[int, list[list]] = {}
    keys: list[int] = []

    def add(room: int, times: int, pattern: tuple[int, ...]) -> None:
        if times:
            if room not in rooms:
                rooms[room] = []
                insort(keys, room)
            rooms[room].append([times, pattern])

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            i = bisect_left(keys, n)
            if i == len(keys):
                most = capacity // n
                add(capacity - most * n, count // most, (n,) * most)
                add(capacity - count % most * n, 1 if count % most else 0, (n,) * (count % most))
                break
            room = keys[i]
            times, pattern = rooms[room][-1]
            some = min(count, times)
            if some == times:
                rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    keys.pop(i)
            else:
                rooms[room][-1][0] -= some
            add(room - n, some, (*pattern, n))
            count -= some
    return [(pattern, times) for groups in rooms.values() for times, pattern in groups]


def plan(histogram: dict[int, int], capacity: int, programs: int = PROGRAMS) -> tuple[list[Entry], int]:
    """Rounded packing: entries (length, first rank, copies, first sequence, offset), and the number of sequences.

    The pieces of a length with ranks from an entry's first rank on go `copies` to a sequence. Entries are those of so many
    programs, each over what the last one left, as far as they are kept, then those of best fit."""
    left = {k: v for k, v in histogram.items() if v}
    lengths = sorted(left)
    width = -(-capacity // CLASSES)
    placed: list[tuple[dict[int, int], int]] = []
    sequences = 0

    def below(room: int, pattern: dict[int, int]) -> int:
        """The longest piece that fits and isn't used up; 0 if none."""
        k = bisect_right(lengths, room)
        while k and left[lengths[k - 1]] <= pattern.get(lengths[k - 1], 0):
            k -= 1
        return lengths[k - 1] if k else 0

    def closing(room: int, size: int, pattern: dict[int, int]) -> tuple[int, ...]:
        """Two pieces that fill the room to the last id, one of them as near to `size` as can be; none if no two do."""
        middle = bisect_right(lengths, size)
        for n in heapq.merge(lengths[middle:], reversed(lengths[:middle]), key=lambda n: abs(n - size)):
            other = room - n
            if left.get(other, 0) > pattern.get(other, 0) + (other == n) and left[n] > pattern.get(n, 0):
                return n, other
        return ()

    def place(wanted: list[int], most: float) -> int:
        """One pattern: a piece of each wanted class, largest first, then the longest that fit what room remains; as often as counts allow. 0 if that leaves more room than the classes would."""
        nonlocal sequences
        pattern: dict[int, int] = {}
        room = capacity

        def take(n: int) -> None:
            nonlocal room
            pattern[n] = pattern.get(n, 0) + 1
            room -= n

        for top in wanted[:-2]:
            n = below(min(room, top * width + width // 2), pattern)
            if n >= (top - 1) * width and n:
                take(n)
        for n in closing(room, wanted[-2] * width, pattern) if wanted[1:] else ():
            take(n)
        while n := below(room, pattern):
            take(n)
        if room > capacity - min(capacity, sum(wanted) * width):
            return 0
        times = int(min(most, min(left[n] // k for n, k in pattern.items())))
        for n, k in pattern.items():
            left[n] -= times * k
            if not left[n]:
                lengths.remove(n)
        placed.append((pattern, times))
        sequences += times
        return times

    for _ in range(programs):
        demand = np.zeros(-(-capacity // width) + 1)
        for n in lengths:
            demand[max(1, min(len(demand) - 1, (n + width // 2) // width))] += left[n]
        before, share = sequences, 0.0
        for take, x in solve(demand):
            wanted = [s for s, k in reversed(take) for _ in range(k)]
            share += x
            most = int(share)
            share -= most
            while most and lengths and (times := place(wanted, most)):
                most -= times
        if sequences == before or not lengths:
            break

    best: tuple[int, list] = (0, [])
    for share in SHARES:
        rest, kept, total = dict(left), list(placed), sequences
        while kept and total > share * sequences:
            pattern, times = kept.pop()
            total -= times
            for n, k in pattern.items():
                rest[n] += times * k
        filled = best_fit({n: c for n, c in rest.items() if c}, capacity)
        total += sum(times for _, times in filled)
        if not best[1] or total < best[0]:
            best = (total, [*((tuple(n for n in sorted(p, reverse=True) for _ in range(p[n])), t) for p, t in kept), *filled])
        if not placed:
            break
    used: dict[int, int] = dict.fromkeys(left, 0)
    entries: list[Entry] = []
    at = 0
    for pattern, times in best[1]:
        offset = 0
        for n in dict.fromkeys(pattern):
            copies = pattern.count(n)
            entries.append((n, used[n], copies, at, offset))
            offset += n * copies
            used[n] += times * copies
        at += times
    return entries, at


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """`rank`: each piece's number among those of its length. Lengths are dealt over buckets, so a common one is no single task's."""
    buckets = max(16, n // 50_000)
    # By the row's number too: rows that share a doc_id, or have none, are no single task's either.
    dealt = pieces.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row"))
    return dealt.join(counts, ["length", "bucket"]).withColumn("rank", F.col("base") + within - 1).drop("base", "bucket", "row")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, start, length, ids_crc32 (lengths from 1 to capacity)."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    entries, _ = plan(histogram, capacity)
    entries.sort()
    table = np.array(entries, dtype=np.int64).reshape(-1, 5)
    key = table[:, 0] << 44 | table[:, 1]

    def run(batches):
        for b in batches:
            n, r = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            e = table[np.searchsorted(key, n << 44 | r, side="right") - 1]
            at = r - e[:, 1]
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(e[:, 3] + at // e[:, 2]), pa.array(e[:, 4] + at % e[:, 2] * n)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    n = sum(histogram.values())
    return common.compact(ranked(pieces, n), n).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    return pack(common.hold(token_pieces(docs, capacity, tokenizer, end_id)), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
