"""Best-fit packing by bin completion (operator 1).

Only lengths matter for packing, and there are at most as many lengths as tokens in a sequence. So the corpus is reduced to
a histogram of piece lengths (2,048 numbers for any number of documents), the histogram is packed by a bin-completion
branch and bound on the driver, and its patterns, each a filling and how often it is used, are dealt back to the pieces by
their rank among the pieces of their length. Applying a filling as often as the counts allow empties a length, or leaves it
short for that filling, so that the number of patterns stays near the number of lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

#: Tokens of a sequence; the id that ends a document.
CAPACITY = 2048
END_ID = 0
#: Branch and bound: fillings tried for a largest piece, steps of the search for further ones, and nodes in all. Beyond them
#: the best solution so far counts: no piece is lost, but there may be more sequences than needed.
FILLINGS, STEPS = 12, 64
NODES = 20_000

_PIECES = "doc_id long, row_key long, piece int, start long, length int, ids_crc32 long"


#: Leading bytes of UTF-8 up to here are of characters below U+0500, whose classes all versions of Unicode agree on.
SETTLED = 0xD3


class Ids:
    """Token ids as the tokenizer file at path gives them, without special tokens added.

    The same vocabulary as ranks, where it lies beside the file, is several times as fast and gives the same ids. The file
    itself does the texts that two libraries might split differently: those with later characters, whose classes depend on a
    version of Unicode, or with the text of a special token, which is one id in the file.
    """

    def __init__(self, path: str | None):
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.exact = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.exact.get_added_tokens_decoder().values())
        ranks, self.quick = path.removesuffix(".json") + ".tiktoken", None
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        settled = self.quick is not None and (text.isascii() or max(text.encode("utf-8", "surrogatepass")) <= SETTLED)
        if settled and not any(x in text for x in self.special):
            return self.quick.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


_loaded: dict[str | None, Ids] = {}


def token_ids(path: str | None) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole sequences, but for the first, which may be shorter."""
    pieces = max(1, -(-n // capacity))
    first = n - capacity * (pieces - 1)
    return [(0, first)] + [(first + capacity * k, capacity) for k in range(pieces - 1)]


def _pieces(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(path)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    for col, v in zip(cols, (doc, key, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "row_key", "piece", "start", "length", "ids_crc32"])

    return run


def _replaceable(filling: tuple[int, ...], slack: int, spare: int) -> bool:
    """Whether a piece at hand could take the place of some of a filling's pieces and be no smaller than they are together.

    Sets of numbers are the bits of one integer: spare those of the lengths at hand, sums those of sums of pieces.
    """
    one, more = 0, 0  # sums of one piece, of two and more
    for s in filling:
        more |= (more | one) << s
        one |= 1 << s
    if more & spare:
        return True
    reach, width = one | more, 1
    while width <= slack:  # sums with 0 to slack added
        step = min(width, slack + 1 - width)
        reach |= reach << step
        width += step
    return bool(reach & ~(one | more) & spare)


def fillings(counts: np.ndarray, room: int, most: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill room from the lengths at hand, least waste first, then fewest pieces, then largest first.

    A piece that fills the room alone dominates all else. Otherwise each length that fits begins a filling, which the largest
    lengths that still fit complete; a bounded search goes on to further fillings of the largest. A filling is dominated if a
    piece could be added, or could replace some of its pieces without leaving more room, as those are better kept for later.
    """
    if room <= 0:
        return [()]
    if counts[room]:
        return [(room,)]
    have = counts[: room + 1]
    sizes = np.flatnonzero(have)[::-1]
    if not len(sizes):
        return [()]
    largest = np.maximum.accumulate(np.where(have > 0, np.arange(room + 1), 0))  # that is not over a given room
    chains, left = [sizes], room - sizes
    while True:
        nxt = largest[np.minimum(left, chains[-1])]
        if not nxt.any():
            break
        chains.append(nxt)
        left = left - nxt
    order = np.argsort(left, kind="stable")[: 4 * most]
    found = {tuple(int(c[i]) for c in chains if c[i]): None for i in order}
    stack: list[tuple[int, tuple[int, ...]]] = [(room, ())]
    for _ in range(STEPS):
        if not stack:
            break
        rest, taken = stack.pop()
        options, s = [], int(largest[min(rest, taken[-1] if taken else rest)])
        while s and len(options) < 3:
            if counts[s] > taken.count(s):
                options.append((rest - s, (*taken, s)))
            s = int(largest[s - 1])
        if options:
            stack += options[::-1]
        else:
            found[taken] = None
    spare = int.from_bytes(np.packbits(have > 0, bitorder="little").tobytes(), "little")
    kept = []
    for f in sorted(found, key=lambda f: (room - sum(f), len(f), [-s for s in f])):
        # a filling's own pieces are at hand only as far as there are more of them
        used_up = sum(1 << s for s in set(f) if counts[s] <= f.count(s))
        if all(counts[s] >= f.count(s) for s in set(f)) and not _replaceable(f, room - sum(f), spare & ~used_up):
            kept.append(f)
            if len(kept) == most:
                break
    return kept or [next(iter(f for f in found if all(counts[s] >= f.count(s) for s in set(f))), (int(sizes[0]),))]


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: lengths fall, each goes to the fullest open sequences that have room.

    Sequences with the same filling are handled together; the work is by lengths and gaps, not by pieces.
    """
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # by room left
    rooms: list[int] = []  # those with open sequences, in order

    def put(room: int, filling: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = {}
            insort(rooms, room)
        open_[room][filling] = open_[room].get(filling, 0) + n

    for size in range(len(counts) - 1, 0, -1):
        n = int(counts[size])
        at = bisect_left(rooms, size)
        while n and at < len(rooms):
            room = rooms[at]
            fit = room // size
            here = open_.pop(room)
            rooms.pop(at)
            new: list[tuple[int, tuple[int, ...], int]] = []
            for filling, have in here.items():
                full = min(have, n // fit)
                n -= full * fit
                if full:
                    new.append((room - fit * size, filling + (size,) * fit, full))
                if have > full and n % fit and n < fit:
                    new.append((room - n * size, filling + (size,) * n, 1))
                    n, full = 0, full + 1
                if have > full:
                    new.append((room, filling, have - full))
            for x in new:
                put(*x)
            at = bisect_left(rooms, room + 1)
        per = capacity // size
        if n >= per:
            put(capacity - per * size, (size,) * per, n // per)
        if n % per:
            put(capacity - n % per * size, (size,) * (n % per), 1)
    return [(f, n) for gap in open_.values() for f, n in gap.items()]


def waste_bound(histogram: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing needs fewer sequences than this.

    The greatest of three kinds of bounds: all tokens; for each least length, pieces over half a sequence with what room they
    leave for the middling ones of that length or more; and pieces weighed by how many of their length a sequence holds.
    """
    sizes = np.arange(capacity + 1)
    n, tokens = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (histogram, histogram * sizes))  # of a length or more
    half = capacity // 2
    least = np.arange(half + 1)
    top = capacity - least + 1
    large, large_tokens = n[half + 1] - n[top], tokens[half + 1] - tokens[top]
    over = tokens[least] - tokens[half + 1] - (large * capacity - large_tokens)
    best = max(-(-int(tokens[0]) // capacity), int((n[top] + large + np.maximum(0, -(-over // capacity))).max()))
    for k in range(1, 21):
        parts, exact = sizes * (k + 1) // capacity, sizes * (k + 1) % capacity == 0
        whole = int((histogram * parts * np.where(exact, k, k + 1)).sum())  # in parts of 1 / (k * (k + 1))
        best = max(best, -(-whole // (k * (k + 1))))
    return best


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (filling, uses) that pack counts[length] pieces of each length into as few sequences as are found.

    Bin completion: the largest length left is completed by each undominated filling in turn, applied as often as the
    counts allow; a branch is cut when what is left, by the bound on waste, leaves no hope to beat the best solution. Best-fit
    gives the first one, and others from what is left at some nodes of each dive. The search ends when the bound of all is
    reached, else after NODES nodes, whatever time they take.
    """
    counts = counts.astype(np.int64).copy()
    if not int((counts * np.arange(len(counts))).sum()):
        return []
    bound = waste_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    nodes = 0

    # each frame: counts, sequences used, the largest length, fillings still to be tried, the pattern that led on
    def frame(c: np.ndarray, used: int):
        top = int(np.flatnonzero(c)[-1])
        c2 = c.copy()
        c2[top] -= 1
        return [c, used, top, iter(fillings(c2, capacity - top, FILLINGS)), None]

    stack = [frame(counts, 0)]
    while stack and best_n > bound and nodes < NODES:
        c, used, top, options, _ = stack[-1]
        filling = next(options, None)
        if filling is None:
            stack.pop()
            continue
        nodes += 1
        need: dict[int, int] = {}
        for s in (top, *filling):
            need[s] = need.get(s, 0) + 1
        times = min(int(c[s]) // k for s, k in need.items())
        if times == 0:
            continue
        after = c.copy()
        for s, k in need.items():
            after[s] -= k * times
        used2 = used + times
        stack[-1][4] = ((top, *filling), times)
        if used2 + waste_bound(after, capacity) >= best_n:
            continue
        if not after.any():
            best, best_n = [f[4] for f in stack], used2
            continue
        if len(stack) & (len(stack) - 1) == 0 or len(stack) % 64 == 0:  # best-fit on what is left is an incumbent too
            tail = best_fit(after, capacity)
            n = used2 + sum(k for _, k in tail)
            if n < best_n:
                best, best_n = [f[4] for f in stack] + tail, n
        stack.append(frame(after, used2))
    return best


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: one piece with the end id alone. Repeated rows are packed as often as they occur. An
    empty table gives no rows. Further columns aren't read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), F.col(text_col).alias("text"))
    pieces = scratch.cache(source.mapInArrow(_pieces(tokenizer, capacity), _PIECES))
    # ranks within a length: lengths are dealt out over salts, and each salt's first rank is the sum of those before it
    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_key", "piece"), F.lit(salts)).cast("int"))
    by_salt = scratch.keep(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in by_salt.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        histogram[length] = n
    patterns = pack_histogram(histogram, capacity)
    # slots: for each length, which ranks go to which run of sequences, at which offset
    slots, given, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for filling, times in patterns:
        offset = 0
        for size in filling:
            slots.append((size, int(given[size]), int(given[size]) + times, sequence, offset))
            given[size] += times
            offset += size
        sequence += times
    slot = spark.createDataFrame(slots, "length int, lo long, hi long, sequence long, offset long") if slots else spark.createDataFrame([], "length int, lo long, hi long, sequence long, offset long")
    # slots of a length meet its ranks by blocks of ranks: an equality join, with a range inside the block
    first = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("base"))
    inner = Window.partitionBy("length", "salt").orderBy("doc_id", "row_key", "piece")
    ranked = salted.withColumn("r", F.row_number().over(inner) - 1).join(F.broadcast(base) if salts * capacity <= 200_000 else base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("r"))
    runs = slot.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "sequence", "offset"))).alias("runs"))
    placed = ranked.join(runs if len(slots) > 100_000 else F.broadcast(runs), "length")
    at = F.filter("runs", lambda s: (s["lo"] <= F.col("rank")) & (s["hi"] > F.col("rank")))[0]
    placed = placed.withColumn("at", at)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("at.sequence") + F.col("rank") - F.col("at.lo")).alias("sequence_id"), F.col("at.offset").alias("offset"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the packed pieces of all documents that are left."""
    return pack(docs)
