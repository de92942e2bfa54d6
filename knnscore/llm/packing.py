"""Best-fit packing of token documents into sequences, improved by swap-based local search.

Documents longer than a sequence are cut into full pieces and a rest; nothing else is cut. Pieces are
packed in groups of bounded size, each on its own: best-fit decreasing first, then local search over
the underfull bins. The search takes the emptiest bin and moves pieces out of it, exchanges one of its
pieces for a shorter one of another bin, or for two that together are shorter, always raising the sum
of squared fills, until the bin is empty or no step helps. What a group leaves underfull is unpacked and
packed again with other groups' leftovers, in rounds, until these fit one group or hardly shrink.

A null text counts as empty, a single end id. Rows that repeat an identifier are documents of their own.
Empty input gives an empty result. Other columns are not read. Pieces are numbered when they are written,
and dealt to groups by a hash of that number, so groups are even whatever repeats; the packing depends on
how the input is split into files.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table
from .tokenizing import END_ID, tokenizer, vocabulary_path

LIMIT = 4096
#: Pieces that one task packs at a time.
GROUP_PIECES = 16_384
#: Emptiest bins that the search tries to empty in one group before it gives up, and steps for each.
TRIES, STEPS = 40, 60


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece, the end id included."""
    path = vocabulary or vocabulary_path()
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        end = np.array([end_id], dtype=t.dtype).tobytes()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, rows = b.slice(i, 256), []
                coded = t.encode(v or "" for v in part.column(1).to_pylist())
                for doc_id, raw in zip(part.column(0).to_pylist(), coded, strict=True):
                    ids = np.frombuffer(raw + end, dtype=t.dtype)
                    for k, s in enumerate(range(0, len(ids), limit)):
                        piece = ids[s : s + limit]
                        rows.append((doc_id, k, s, len(piece), zlib.crc32(piece.astype("<u4"))))
                cols = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of pieces; lengths[i] is piece i's length. A bin is a list of pieces."""

    def __init__(self, lengths: np.ndarray, limit: int):
        self.lengths, self.limit = lengths.tolist(), limit
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        # a bin's lengths, and those of its pairs, since it changed last
        self._single: dict[int, np.ndarray] = {}
        self._pair: dict[int, np.ndarray] = {}

    def best_fit_decreasing(self) -> None:
        """Pieces, longest first, each into the fullest bin that has room."""
        free: list[tuple[int, int]] = []  # (room, bin), ascending
        for i in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            n = self.lengths[i]
            k = bisect.bisect_left(free, (n, -1))
            if k < len(free):
                room, b = free.pop(k)
                self.bins[b].append(i)
                self.fill[b] += n
            else:
                room, b = self.limit, len(self.bins)
                self.bins.append([i])
                self.fill.append(n)
            if room > n:
                bisect.insort(free, (room - n, b))

    def improve(self, tries: int = TRIES, steps: int = STEPS) -> None:
        """Local search: empty the emptiest bins one by one; a bin that resists is left as it is."""
        stuck: set[int] = set()
        total = sum(self.lengths)
        while len(stuck) < tries:
            used = [b for b in range(len(self.bins)) if self.bins[b]]
            if len(used) <= -(-total // self.limit):
                return
            under = [b for b in used if self.fill[b] < self.limit]
            source = min((b for b in under if b not in stuck), key=lambda b: (self.fill[b], b), default=None)
            if source is None or not self._empty(source, [b for b in under if b != source], steps):
                if source is None:
                    return
                stuck.add(source)

    def _empty(self, source: int, others: list[int], steps: int) -> bool:
        if not others:
            return False
        room = np.array([self.limit - self.fill[b] for b in others])
        for _ in range(steps):
            if not self.bins[source]:
                return True
            if not (self._move(source, others, room) or self._exchange(source, others, room) or self._exchange_two(source, others, room)):
                return False
        return not self.bins[source]

    def _put(self, source: int, others: list[int], room: np.ndarray, k: int, out: int, back: tuple[int, ...]) -> None:
        b = others[k]
        for changed in (source, b):
            self._single.pop(changed, None)
            self._pair.pop(changed, None)
        gain = self.lengths[out] - sum(self.lengths[i] for i in back)
        self.bins[source].remove(out)
        self.bins[b].append(out)
        for i in back:
            self.bins[b].remove(i)
            self.bins[source].append(i)
        self.fill[b] += gain
        self.fill[source] -= gain
        room[k] -= gain

    def _raises(self, source: int, b: int, gain: int) -> bool:
        # (f_b + g)^2 + (f_s - g)^2 > f_b^2 + f_s^2
        return self.fill[b] + gain > self.fill[source]

    def _move(self, source: int, others: list[int], room: np.ndarray) -> bool:
        for out in sorted(self.bins[source], key=lambda i: -self.lengths[i]):
            fits = np.where(room >= self.lengths[out], room, self.limit + 1)
            k = int(fits.argmin())
            if fits[k] <= self.limit:
                self._put(source, others, room, k, out, ())
                return True
        return False

    def _flat(self, others: list[int], room: np.ndarray, cache: dict[int, np.ndarray], made: Callable[[list[int]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(bin's place in others, made(its lengths)) over all bins with room, in order; cache holds what was made for unchanged bins."""
        open_ = np.flatnonzero(room > 0)
        parts = []
        for k in open_.tolist():
            b = others[k]
            if b not in cache:
                cache[b] = made([self.lengths[i] for i in self.bins[b]])
            parts.append(cache[b])
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.repeat(open_, [len(p) for p in parts]), np.concatenate(parts)

    def _exchange(self, source: int, others: list[int], room: np.ndarray) -> bool:
        """The one-for-one exchange that takes most out of the source."""
        at, lens = self._flat(others, room, self._single, _lengths)
        if not len(at):
            return False
        best = (0, None)
        for out in self.bins[source]:
            gain = self.lengths[out] - lens
            gain[gain > room[at]] = 0
            j = int(gain.argmax())
            if gain[j] > best[0] and self._raises(source, others[at[j]], int(gain[j])):
                best = (int(gain[j]), (out, j))
        if not best[1]:
            return False
        out, j = best[1]
        k = int(at[j])
        back = self.bins[others[k]][j - int(np.searchsorted(at, k))]
        self._put(source, others, room, k, out, (back,))
        return True

    def _exchange_two(self, source: int, others: list[int], room: np.ndarray) -> bool:
        """The exchange of one of the source's pieces for two of another bin that takes most out of the source."""
        at, two = self._flat(others, room, self._pair, _pair_sums)
        if not len(at):
            return False
        room_at, fill_at = room[at], self.limit - room[at]
        best = (0, 0, None)  # most gain, then the first two, then the first piece
        for out in self.bins[source]:
            gain = self.lengths[out] - two
            gain[(gain > room_at) | (fill_at + gain <= self.fill[source])] = 0
            j = int(gain.argmax())
            if gain[j] > best[0] or best[2] is not None and gain[j] == best[0] and j < best[1]:
                best = (int(gain[j]), j, out)
        gain, j, out = best
        if out is None:
            return False
        k = int(at[j])
        items = self.bins[others[k]]
        x, y = _pairs(len(items))
        n = j - int(np.searchsorted(at, k))
        self._put(source, others, room, k, out, (items[x[n]], items[y[n]]))
        return True


def _lengths(lengths: list[int]) -> np.ndarray:
    return np.array(lengths, dtype=np.int64)


def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tril_indices(n, -1)


def _pair_sums(lengths: list[int]) -> np.ndarray:
    x, y = _pairs(len(lengths))
    a = _lengths(lengths)
    return a[x] + a[y]


def pack_group(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of the bin) of every piece."""
    bins = Bins(lengths, limit)
    bins.best_fit_decreasing()
    bins.improve()
    of, offset, fill = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
    no = 0
    for b, items in enumerate(bins.bins):
        if not items:
            continue
        at = 0
        for i in items:
            of[i], offset[i], fill[i] = no, at, bins.fill[b]
            at += bins.lengths[i]
        no += 1
    return of, offset, fill


def _packer(kept: list[str], limit: int, last: bool, first: int):
    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "row"], kind="stable")
        of, offset, fill = pack_group(df["length"].to_numpy(), limit)
        df["sequence_id"] = first + (int(df["grp"].iloc[0]) << 24) + of
        df["offset"] = offset
        df["left"] = (fill < limit) & (not last)
        return df[[*kept, "row", "left"]]

    return one


def pack(cut_pieces: DataFrame, limit: int = LIMIT, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32), which are written to a table, with sequence_id and offset."""
    names = cut_pieces.columns
    kept = [*names, "sequence_id", "offset"]
    pieces = table(cut_pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == limit)
    # whole pieces alone fill a sequence; their numbers are negative
    done = full.select(*names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level, before = pieces.where(F.col("length") < limit), 0, None
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema)
    while True:
        n = rest.count()
        groups = max(1, -(-n // group_pieces))
        # a round that hardly settles anything is the last: pieces that leave gaps do so in any group
        last = groups == 1 or before is not None and n > 0.98 * before
        before = n
        # a task a group, so that adaptive execution doesn't run several one after another
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64(F.lit(level), "row"), F.lit(groups))).repartition(groups, "grp")
        work = _packer(kept, limit, last, level << 56)
        packed = table(dealt.groupBy("grp").applyInPandas(work, f"{kinds}, sequence_id long, offset long, row long, left boolean"), "packed")
        done = done.unionByName(packed.where("not left").select(*kept))
        if last:
            return done
        rest, level = packed.where("left").select(*names, "row"), level + 1


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")
