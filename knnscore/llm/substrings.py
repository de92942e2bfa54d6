"""Suffix-array dedup of repeated byte strings, by longest previous factors.

A byte belongs to a repeat if a string of WINDOW bytes that covers it starts at another place too. Repeats
are found in three steps.

1. Anchors. Of every WINDOW bytes the substring of CORE bytes with the least rolling hash is an anchor, so
   equal windows hold an anchor of equal hash, whichever of tied ones is taken. Anchors are about 1 in 137
   bytes. Those whose hash occurs at one place only, and not again within WINDOW bytes, are dropped.
2. Contexts. All windows over an anchor lie in its context, at most WINDOW - CORE bytes to the left and
   WINDOW to the right. Where a context occurs at several places, all its windows repeat. One context of
   each kind goes on, if its anchor has others. Contexts are of one kind if they agree in 128 bits of SHA-256.
3. Suffix arrays. Contexts of an anchor meet in one task. Their suffixes are sorted in full, by prefix doubling;
   the common prefix of neighbours comes from the ranks of all its levels. A suffix's longest previous factor
   is the longer of its common prefixes with the nearest suffixes of a smaller position before and after it in
   suffix order. Where it is WINDOW or longer, the window is a later copy; with keep="first" only these are
   removed. With keep="none", as op7 asks, so are first copies: those with a following factor as long, which
   is the mirror image, from the nearest larger positions.

An anchor with more than MAX_CONTEXTS kinds of context is split: each of its contexts becomes SPLIT ones
whose core is longer and whose windows are a part of the former's. At the end core and window are
one and counting of kinds settles it, so no task ever holds a hot anchor's contexts.

Equal texts are handled once, by digest. Null text counts as empty. Identifiers aren't used, repeated rows
are documents of their own. Very long texts are hashed in blocks. Empty input gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table

WINDOW, CORE = 400, 128
MAX_CONTEXTS, SPLIT = 2500, 4
#: Bytes of contexts that one suffix array covers, about.
ARRAY_BYTES = 1_500_000
_BLOCK, _PLACE_BITS, _ODD = 1 << 17, 18, 0x2545F
_BASE = 0x9E3779B97F4A7C15
ITEM = "h binary, p long, core int, key long, ctx binary, l int, r int, own boolean"


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = _BLOCK + 4 * WINDOW
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    values = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down), values


def _block_anchors(block: np.ndarray, window: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of one block of bytes, and whether an anchor's hash is also another's place within a window."""
    up, down, values = _powers()
    n = len(block)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[block] * up[:n], out=sums[1:])
    z = (sums[core:] - sums[: n - core + 1]) * down[: n - core + 1]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    # ties are broken by a scrambled place, lest a text of one repeated byte is all anchors; the place can be read back
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    least = (z & ~mask) | (np.arange(len(z), dtype=np.uint64) * np.uint64(_ODD) & mask)
    w = window - core + 1
    rows = -(-len(least) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(least)] = least
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(least) - w + 1
    found = np.unique(np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]))
    at = ((found & mask) * np.uint64(pow(_ODD, -1, 1 << _PLACE_BITS)) & mask).astype(np.int64)
    # equal windows that overlap may have one anchor in common: its substring then occurs again close by
    low = np.uint64(0xFFFF)
    seen = np.zeros(1 << 16, dtype=bool)
    seen[(z[at] & low).astype(np.int64)] = True
    near = np.flatnonzero(seen[(z & low).astype(np.int64)])
    near = near[np.isin(z[near], z[at])]
    near = near[np.lexsort((near, z[near]))]
    same = (z[near[1:]] == z[near[:-1]]) & (np.diff(near) < window)
    own = np.zeros(len(z), dtype=bool)
    own[near[1:][same]] = own[near[:-1][same]] = True
    return at, (z[at] >> np.uint64(1)).astype(np.int64), own[at]


def anchors(raw: bytes, window: int = WINDOW, core: int = CORE) -> list[tuple[int, int, bool]]:
    """(place, hash, whether the hash occurs again within a window) of a text's anchors; none if it is shorter than a window."""
    data, got = np.frombuffer(raw, dtype=np.uint8), {}
    for s in range(0, len(raw) - window + 1, _BLOCK):
        at, key, own = _block_anchors(data[s : s + _BLOCK + window - 1], window, core)
        for p, k, o in zip((at + s).tolist(), key.tolist(), own.tolist(), strict=True):
            got[p] = (p, k, o or (p in got and got[p][2]))
    return sorted(got.values())


def _hash(raw: bytes, seed: int) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(raw, seed)
    return h - (1 << 64) if h >> 63 else h


def context(raw: bytes, p: int, core: int, window: int) -> tuple[bytes, int, int]:
    """(digest, bytes to the left, bytes from p on) of what all windows over raw[p : p + core] cover."""
    left, right = min(p, window - core), min(len(raw) - p, window)
    return hashlib.sha256(left.to_bytes(4, "little") + raw[p - left : p + right]).digest()[:16], left, right


def split_context(text: bytes, left: int, core: int, window: int) -> Iterator[tuple[int, int, int, bytes, int, int]]:
    """(shift, core, key, ctx, left, right) of the parts of a context (text, with its core at `left`): longer cores, fewer windows each."""
    spare = window - core
    step = -(-(spare + 1) // SPLIT)
    for j, x in enumerate(range(0, spare + 1, step)):
        y = min(spare, x + step - 1)
        # windows that start x to y bytes before the core
        start, size = left - x, window - y + x
        if start < 0 or start + size > len(text):
            continue
        ctx, near, right = context(text, start, size, window)
        if near + right >= window:
            yield -x, size, _hash(text[start : start + size], 1000 + j), ctx, near, right


#: Symbols of 9 bits (a byte plus 1; 0 ends a context) in a 64-bit number.
_PACK = 7
#: Rounds of pointer jumping before what is left goes through a stack.
JUMPS = 48


def suffix_array(symbols: np.ndarray, length: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """All places in the order of their next `length` symbols, and for each level k the ranks of _PACK * 2 ** k symbols at every place.

    Prefix doubling; a level sorts again only the places that tie so far. A rank is the first place in order of those that tie.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(_PACK, dtype=symbols.dtype)]).astype(np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    for j in range(_PACK):
        value = (value << np.uint64(9)) | padded[j : j + n]
    order = np.argsort(value)
    value = value[order]
    first = np.ones(n, dtype=bool)
    first[1:] = value[1:] != value[:-1]
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), 0))
    levels, size = [rank], _PACK
    while size < length:
        slots = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(slots):
            break
        at = order[slots]
        ahead = np.zeros(len(at), dtype=np.int64)
        inside = at + size < n
        ahead[inside] = rank[at[inside] + size] + 1
        name = (rank[at].astype(np.int64) << 32) | ahead
        by = np.argsort(name)
        at, name = at[by], name[by]
        order[slots] = at
        new = np.ones(len(at), dtype=bool)
        new[1:] = name[1:] != name[:-1]
        first[slots] = new
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        levels.append(rank)
        size *= 2
    return order, levels


def common_prefixes(symbols: np.ndarray, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at places a[i] and b[i] share, below twice the longest level's length."""
    n, out = len(symbols), np.zeros(len(a), dtype=np.int64)
    sizes = [_PACK << k for k in range(len(levels))]
    for size, names in [*zip(sizes[::-1], levels[::-1], strict=True), *[(1, symbols)] * (_PACK - 1)]:
        x, y = a + out, b + out
        inside = np.maximum(x, y) < n
        same = np.zeros(len(a), dtype=bool)
        same[inside] = names[x[inside]] == names[y[inside]]
        out[same] += size
    return out


def _nearest_smaller(lcp: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Common prefix with the nearest entry before, in suffix order, whose place is smaller; 0 where a prefix of 0 comes between.

    lcp[i] is that of entries i - 1 and i. Pointers jump over entries of larger places: between an entry and where its
    pointer shows, all places are larger than its own.
    """
    at = np.where(lcp > 0, np.arange(len(lcp)) - 1, -1)
    least = lcp.copy()
    todo = np.flatnonzero(at >= 0)
    for _ in range(JUMPS):
        to = at[todo]
        todo, to = (x[places[to] > places[todo]] for x in (todo, to))
        if not len(todo):
            break
        at[todo], least[todo] = at[to], np.minimum(least[todo], least[to])
        todo = todo[at[todo] >= 0]
    starts = np.flatnonzero(lcp == 0)
    for run in np.unique(np.searchsorted(starts, todo, side="right")).tolist():
        begin, end = int(starts[run - 1]), int(starts[run]) if run < len(starts) else len(lcp)
        stack: list[tuple[int, int]] = []
        for i in range(begin, end):
            here, seen = int(lcp[i]), int(places[i])
            while stack and stack[-1][0] > seen:
                here = min(here, stack.pop()[1])
            at[i], least[i] = (i, here) if stack else (-1, 0)
            stack.append((seen, here))
    return np.where(at >= 0, least, 0)


def factors(lcp: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Longest previous factor of every entry in suffix order: the longest prefix it shares with an entry of a smaller place."""
    behind = np.zeros_like(lcp)
    behind[1:] = lcp[:0:-1]
    return np.maximum(_nearest_smaller(lcp, places), _nearest_smaller(behind, places[::-1])[::-1])


def repeated_windows(symbols: np.ndarray, starts: np.ndarray, room: np.ndarray, places: np.ndarray, window: int = WINDOW, keep: str = "none") -> np.ndarray:
    """Ascending places among those given whose window occurs at another one too (keep="none") or at a smaller one (keep="first").

    symbols: contexts, each with a 0 behind it; the suffix at starts[i] has room[i] bytes, `window` or more, and lies at places[i]
    of all texts. A place that several contexts hold counts once. Factors shorter than a window are taken for none.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    places, one = np.unique(places, return_index=True)
    starts, room = starts[one], room[one]
    order, levels = suffix_array(symbols, max(window, int(room.max())))
    slot = np.empty(len(symbols), dtype=np.int64)
    slot[order] = np.arange(len(symbols))
    by = np.argsort(slot[starts])
    starts, room, places = starts[by], room[by], places[by]
    lcp = np.zeros(len(starts), dtype=np.int64)
    lcp[1:] = np.minimum(common_prefixes(symbols, levels, starts[:-1], starts[1:]), np.minimum(room[:-1], room[1:]))
    lcp[lcp < window] = 0
    # only suffixes with a neighbour that shares a window have a factor of that length
    near = (lcp > 0) | np.append(lcp[1:] > 0, False)
    lcp, places = lcp[near], places[near]
    found = factors(lcp, places)
    if keep == "none":
        found = np.maximum(found, factors(lcp, -places))
    return np.sort(places[found >= window])


def spans_of(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Merged (start, stop) of windows at ascending starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + window).tolist(), strict=True))


def _solve(rows: list[tuple], window: int, keep: str) -> Iterator[tuple[bytes, int, int]]:
    """Spans (h, start, stop) of repeated windows of contexts (h, place of the context's first byte, bytes)."""
    names = sorted({r[0] for r in rows})
    docs = {h: i for i, h in enumerate(names)}
    symbols, starts, room, places, base = [], [], [], [], 0
    for h, first, text in rows:
        k = np.arange(len(text) - window + 1)
        symbols += [np.frombuffer(text, dtype=np.uint8).astype(np.uint16) + np.uint16(1), np.zeros(1, dtype=np.uint16)]
        starts.append(base + k)
        room.append(len(text) - k)
        places.append((docs[h] << 40) + first + k)
        base += len(text) + 1
    hit = repeated_windows(*map(np.concatenate, (symbols, starts, room, places)), window, keep)
    for s, e in spans_of(hit, window):
        at = s & ((1 << 40) - 1)
        yield names[s >> 40], at, at + e - s


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


_ITEM_NAMES = [x.split()[0] for x in ITEM.split(", ")]
_ITEM_KINDS = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
_SPAN_NAMES, _SPAN_KINDS = ["h", "start", "stop"], [pa.binary(), pa.int64(), pa.int64()]


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def find_anchors(texts: DataFrame, window: int, core: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                h = hashlib.sha256(raw).digest()[:16]
                rows += [(h, p, core, k, *context(raw, p, core, window), own) for p, k, own in anchors(raw, window, core)]
                if len(rows) > 20_000:
                    yield _batch(_ITEM_NAMES, _ITEM_KINDS, rows)
                    rows = []
            yield _batch(_ITEM_NAMES, _ITEM_KINDS, rows)

    return texts.mapInArrow(run, ITEM)


def _repeats(items: DataFrame) -> DataFrame:
    """Distinct items whose key occurs at more than one place, or again close by."""
    at = F.xxhash64("h", "p")
    twice = items.groupBy("key").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.max("own").alias("o")).where("a <> b or o").select(F.col("key").alias("k"))
    return items.join(twice, F.col("key") == F.col("k"), "left_semi").distinct()


def find_spans(docs: DataFrame, window: int = WINDOW, core: int = CORE, keep: str = "none") -> DataFrame:
    """(h, start, stop) of removed bytes by digest of the text; spans of one text may overlap. docs: (text), without nulls."""
    items = table(find_anchors(docs.where(F.octet_length("text") >= window), window, core), "anchors")
    items = table(_repeats(items), "items")
    spans: list[DataFrame] = []
    contexts: DataFrame | None = None
    while True:
        # contexts of one kind; the smallest place stands for them
        kinds = table(items.groupBy("key", "core", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("h", "p", "l", "r")).alias("one"), F.max("own").alias("own")), "kinds")
        many = kinds.where("n > 1").select(F.col("key").alias("k"), F.col("core").alias("c"), F.col("ctx").alias("x"), "one")
        whole = items.join(many, (F.col("key") == F.col("k")) & (F.col("ctx") == F.col("x")) & (F.col("core") == F.col("c"))).where(F.col("l") + F.col("r") >= window)
        if keep == "first":
            whole = whole.where((F.col("h") != F.col("one.h")) | (F.col("p") != F.col("one.p")))
        spans.append(whole.select("h", (F.col("p") - F.col("l")).alias("start"), (F.col("p") + F.col("r")).alias("stop")))
        groups = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max("own").alias("o")).where("kinds > 1 or o").select(F.col("key").alias("k"), "kinds")
        picked = table(kinds.join(groups, F.col("key") == F.col("k")).select("key", "core", "one.*", "own", (F.col("kinds") > MAX_CONTEXTS).alias("hot")), "picked")
        if contexts is None:
            contexts = _cut_contexts(docs, picked, window)
        else:
            here = [F.col(c).alias(f"_{c}") for c in ("key", "h", "p", "core")]
            contexts = contexts.drop("hot").join(picked.select(*here, "hot"), (F.col("key") == F.col("_key")) & (F.col("h") == F.col("_h")) & (F.col("p") == F.col("_p")) & (F.col("core") == F.col("_core"))).select("key", "h", "p", "core", "l", "own", "hot", "bytes")
        contexts = table(contexts, "contexts")
        spans.append(_array_spans(contexts.where("not hot"), window, keep))
        if contexts.where("hot").isEmpty():
            break
        parts = table(_split_hot(contexts.where("hot"), window), "parts")
        items = table(_repeats(parts.select(*_ITEM_NAMES)), "items")
        contexts = parts.select("key", "h", "p", "core", "l", "own", F.lit(False).alias("hot"), "bytes")
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return table(out, "spans")


def _cut_contexts(docs: DataFrame, picked: DataFrame, window: int) -> DataFrame:
    """(key, h, p, core, l, own, hot, bytes): each text is read once and gives all its contexts."""
    wanted = picked.groupBy("h").agg(F.collect_list(F.struct("p", "key", "core", "l", "r", "own", "hot")).alias("w")).withColumnRenamed("h", "h_")
    texts = docs.select(_digest(F.col("text")).alias("h"), "text").dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "h", "p", "core", "l", "own", "hot", "bytes"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
        for b in batches:
            for h, text, w in zip(*(b.column(c) for c in ("h", "text", "w")), strict=True):
                raw, h = text.as_py().encode("utf-8", "surrogatepass"), h.as_py()
                rows = [(x["key"], h, x["p"], x["core"], x["l"], x["own"], x["hot"], raw[x["p"] - x["l"] : x["p"] + x["r"]]) for x in w.as_py()]
                for i in range(0, len(rows), 2000):
                    yield _batch(names, kinds, rows[i : i + 2000])

    joined = texts.join(wanted, F.col("h") == F.col("h_")).select("h", "text", "w")
    return joined.mapInArrow(run, "key long, h binary, p long, core int, l int, own boolean, hot boolean, bytes binary")


def _array_spans(contexts: DataFrame, window: int, keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for b in batches:
            for key, h, first, text in zip(*(b.column(c).to_pylist() for c in ("key", "h", "first", "bytes")), strict=True):
                if size > ARRAY_BYTES and key != last:
                    yield _batch(_SPAN_NAMES, _SPAN_KINDS, list(_solve(rows, window, keep)))
                    rows, size = [], 0
                last = key
                if len(text) >= window:
                    rows.append((h, first, text))
                    size += len(text)
        if rows:
            yield _batch(_SPAN_NAMES, _SPAN_KINDS, list(_solve(rows, window, keep)))

    spark = contexts.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = contexts.select("key", "h", (F.col("p") - F.col("l")).alias("first"), "bytes").repartition(parts, "key").sortWithinPartitions("key", "h", "first")
    return sorted_.mapInArrow(run, "h binary, start long, stop long")


def _split_hot(contexts: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, p, core, left, own, text in zip(*(b.column(c).to_pylist() for c in ("h", "p", "core", "l", "own", "bytes")), strict=True):
                for shift, size, key, ctx, near, right in split_context(text, left, core, window):
                    at = left + shift
                    rows.append((h, p + shift, size, key, ctx, near, right, own, text[at - near : at + right]))
            yield _batch([*_ITEM_NAMES, "bytes"], [*_ITEM_KINDS, pa.binary()], rows)

    return contexts.mapInArrow(run, f"{ITEM}, bytes binary")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover; adjacent ones are one run."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, core: int = CORE, keep: str = "none") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, text) of every row.

    kept may not be valid UTF-8 at its seams; text is kept without the bytes of characters that were cut there.

    keep="first" also keeps every copy of a text that occurs as a whole more than once: exact dedup is another operator's job.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(text.alias("text"))
    spans = find_spans(plain, window, core, keep)
    if keep == "none":
        copies = plain.select(_digest(F.col("text")).alias("h"), F.octet_length("text").cast("long").alias("size")).groupBy("h", "size").count()
        copies = copies.where((F.col("count") > 1) & (F.col("size") >= window))
        spans = spans.unionByName(copies.select("h", F.lit(0).cast("long").alias("start"), F.col("size").alias("stop")))
    by = table(spans.distinct().groupBy("h").agg(F.collect_list(F.struct("start", "stop")).alias("s")), "removed").withColumnRenamed("h", "h_")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", _digest(F.col("text")))
    joined = rows.join(by, F.col("h") == F.col("h_"), "left").select("id", "text", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, out = b.slice(i, 256), []
                for key, text, s in zip(*(part.column(c).to_pylist() for c in ("id", "text", "s")), strict=True):
                    raw, at, left = text.encode("utf-8", "surrogatepass"), 0, []
                    runs = merge_spans([(x["start"], x["stop"]) for x in s or ()])
                    for x, y in runs:
                        left.append(raw[at:x])
                        at = y
                    kept = b"".join([*left, raw[at:]])
                    out.append((key, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore")))
                yield _batch(names, kinds, out)

    return joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")
