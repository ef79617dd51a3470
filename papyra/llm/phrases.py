"""Phrase mining by position bitmaps (operator 12).

Texts are read in shards. In a shard each word has a bitmap of the positions where it stands; ends of pieces are positions of
no word, so that nothing reaches over them. The bitmap of a phrase, shifted by one position and ANDed with that of a word,
is the bitmap of the longer phrase, and its popcount says how often that stands in the shard. Popcounts of all shards add up.

Bitmaps are compressed: only the 64-bit words that hold a bit are kept, by their places. Which phrases can be frequent at
all is told to the shards beforehand: words are counted, then hashes of pairs and of three words in a row, whose buckets are
summed over all shards, packed by ranges. Those that reach the threshold go into a filter of bits, whose size is fixed. What
passes by chance is counted by its bitmap too and then falls to the exact threshold, so that filters never change a result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, is_empty, mix64, pack, table, unpack

#: Least occurrences of a phrase, most words in one, rows reported for each language.
LEAST, MOST_WORDS, TOP = 100, 5, 2_000
#: Languages up to which their totals are sent to all executors.
LANGS = 20_000
#: log2 of the bits of a filter (16 MB): all that is ever sent to every executor.
FILTER_LOG2 = 27
#: log2 of the buckets that hashes of pairs and threes are counted in, and positions of the corpus for each range of them.
BUCKETS_LOG2, RANGE = 30, 1_000_000
#: Positions of a shard at most (but a text is never cut), and distinct words that a task counts before it gives them away.
SHARD, COUNTED = 4_000_000, 500_000
#: Words that follow a phrase, up to which it is ANDed with each of them; with more, with all in one pass.
FEW = 4

_ENDS = bytes.maketrans(b",;:!?\x0a\x0b\x0c\x0d", b".........")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, with a b"." between pieces: no word holds one, as it ends a piece."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").lower().translate(_ENDS).replace(b".", b" . ").split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * _ODD + second)


class BitFilter:
    """A set of 64-bit hashes as a fixed number of bits; says yes for all in it, and for some others."""

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    @classmethod
    def of(cls, hashes: DataFrame, column: str, log2: int) -> BitFilter:
        """Bits are set by executors and merged there; the driver gets the filter, 2 ** log2 bits whatever the data."""
        at = F.shiftrightunsigned(F.col(column), 64 - log2) + 1  # both functions count from 1
        parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        bits = np.zeros(1 << (log2 - 3), dtype=np.uint8)
        for row in parts.collect():
            chunk = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
            begin = (row["k"] - 1) * 4096
            bits[begin : begin + len(chunk)] = chunk[: len(bits) - begin]
        return cls(bits, log2)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.log2)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0

    def one(self, h: int) -> bool:
        at = h >> (64 - self.log2)
        return bool(self.bits[at >> 3] >> (at & 7) & 1)


class Bitmap:
    """Positions as bits of 64-bit words, of which only those that hold some are kept: place -> bits. Most phrases stand in few
    places of a shard, where this beats arrays."""

    __slots__ = ("words",)

    def __init__(self, words: dict[int, int]):
        self.words = words

    @classmethod
    def of(cls, positions: np.ndarray) -> Bitmap:
        """positions: in order, each once."""
        if not len(positions):
            return cls({})
        at = positions >> 6
        new = np.flatnonzero(np.diff(at, prepend=-1))
        bits = np.bitwise_or.reduceat(np.uint64(1) << (positions & 63).astype(np.uint64), new)
        return cls(dict(zip(at[new].tolist(), bits.tolist())))

    def shifted(self) -> Bitmap:
        """Each position one further."""
        out: dict[int, int] = {}
        for at, bits in self.words.items():
            if bits >> 63:
                out[at + 1] = out.get(at + 1, 0) | 1
            bits = bits << 1 & 0xFFFFFFFFFFFFFFFF
            if bits:
                out[at] = out.get(at, 0) | bits
        return Bitmap(out)

    def __and__(self, other: Bitmap) -> Bitmap:
        a, b = (self.words, other.words) if len(self.words) <= len(other.words) else (other.words, self.words)
        get = b.get
        return Bitmap({at: both for at, bits in a.items() if (both := bits & get(at, 0))})

    def dealt(self, word: memoryview) -> dict[int, Bitmap]:
        """ANDs with the bitmaps of all words that have a bit in common with this one, in one pass: as each position is in one
        word's bitmap only, its bit goes to that word's AND and to no other's."""
        out: dict[int, dict[int, int]] = {}
        for p in self.positions():
            bits = out.setdefault(word[p], {})
            bits[p >> 6] = bits.get(p >> 6, 0) | 1 << (p & 63)
        return {x: Bitmap(bits) for x, bits in out.items()}

    def positions(self) -> Iterator[int]:
        for at, bits in self.words.items():
            while bits:
                low = bits & -bits
                yield (at << 6) + low.bit_length() - 1
                bits ^= low

    def popcount(self) -> int:
        return sum(map(int.bit_count, self.words.values()))


class Shard:
    """Texts of one language: the word of each position (0: none that counts), and the hash of each word."""

    def __init__(self, words: BitFilter):
        self.ids: dict[bytes, int] = {b".": 0}
        self.hashes, self.parts, self.size, self.words = [0], [], 0, words

    def add(self, text: str | None) -> None:
        found, ids = tokens(text), self.ids
        if found:
            for w in set(found).difference(ids):
                h = word_hash(w)
                ids[w] = len(self.hashes) if self.words.one(h) else 0
                if ids[w]:
                    self.hashes.append(h)
            self.parts += [np.fromiter(map(ids.__getitem__, found), dtype=np.int32, count=len(found)), np.zeros(1, np.int32)]
            self.size += len(found) + 1

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32), np.array(self.hashes, dtype=np.uint64)


def _bitmaps(at: np.ndarray, part: np.ndarray) -> Callable[[int], Bitmap]:
    """The bitmaps of words over the positions in `part`, made when they are first asked for."""
    spots = np.flatnonzero(part)
    spots = spots[np.argsort(at[spots], kind="stable")]
    words, begin = np.unique(at[spots], return_index=True)
    span = dict(zip(words.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(spots)])))

    @lru_cache(None)
    def bitmap(w: int) -> Bitmap:
        a, b = span[w]
        return Bitmap.of(spots[a:b])

    return bitmap


def runs(at: np.ndarray, hashes: np.ndarray, frequent: BitFilter | None) -> tuple[np.ndarray, np.ndarray]:
    """Where two words stand in a row, or three if a filter of pairs is given that both pairs of them pass; and their hashes."""
    starts = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
    found = pair_hashes(hashes[at[starts]], hashes[at[starts + 1]])
    if frequent is None:
        return starts, found
    passed = frequent.has(found)
    starts, found = starts[passed], found[passed]
    both = np.flatnonzero(np.diff(starts) == 1)
    return starts[both], pair_hashes(found[both], hashes[at[starts[both] + 2]])


def extended(at: np.ndarray, hashes: np.ndarray, twos: BitFilter, threes: BitFilter | None, most: int = MOST_WORDS) -> Iterator[tuple[tuple[int, ...], int]]:
    """(words, count) of each phrase of two words or more in a shard whose pairs and threes pass the filters, depth first."""
    on = [np.zeros(len(at), dtype=bool) for _ in range(2)]  # by its start: whether a pair, and three words, pass
    starts, found = runs(at, hashes, None)
    starts = starts[twos.has(found)]
    on[0][starts] = True
    if threes is not None:
        begin, found = runs(at, hashes, twos)
        on[1][begin[threes.has(found)]] = True
    part = on[0].copy()
    part[starts + 1] = True
    bitmap = _bitmaps(at, part)
    word, two, three = memoryview(at), memoryview(on[0]), memoryview(on[1])
    for w in np.unique(at[starts]).tolist():
        stack = [((w,), bitmap(w))]
        while stack:
            words, spots = stack.pop()
            # words that follow in this shard; the others' bitmaps have nothing in common with this one
            following = {word[p + 1] for p in spots.positions() if (two[p] if len(words) == 1 else three[p - 1])}
            if not following:
                continue
            moved = spots.shifted()
            each = {x: moved & bitmap(x) for x in following} if len(following) <= FEW else moved.dealt(word)
            for x in following:
                yield (*words, x), each[x].popcount()
                if len(words) + 1 < most:
                    stack.append(((*words, x), each[x]))


def shards(docs: DataFrame, words: BitFilter) -> DataFrame:
    """(lang, at, hashes) of docs (lang, text): each shard's words by position and their hashes, compressed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Shard] = {}

        def out(lang: str) -> pa.RecordBatch:
            at, hashes = open_.pop(lang).positions()
            packed = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in (at, hashes)]
            return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *[pa.array([x], pa.binary()) for x in packed], pa.array([len(at)], pa.int64()), pa.array([len(hashes)], pa.int64())], names=["lang", "at", "hashes", "size", "words"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = open_.get(lang) or open_.setdefault(lang, Shard(words))
                shard.add(text)
                if sum(s.size for s in open_.values()) > SHARD:  # the largest, so that many languages don't fill memory either
                    yield out(max(open_, key=lambda x: open_[x].size))
        for lang in list(open_):
            yield out(lang)

    return docs.mapInArrow(cut, "lang string, at binary, hashes binary, size long, words long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, word of each position, hashes of words) of shards."""
    for batch in batches:
        for lang, at, hashes, size, words in zip(*(c.to_pylist() for c in batch.columns)):
            yield lang, *(np.frombuffer(pa.decompress(x, decompressed_size=n * kind().itemsize, codec="zstd", asbytes=True), dtype=kind) for x, n, kind in ((at, size, np.int32), (hashes, words, np.uint64)))


def _added(buckets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket once, in order, with the sum of its counts."""
    order = np.argsort(buckets, kind="stable")
    buckets, n = buckets[order], n[order]
    new = np.flatnonzero(np.diff(buckets, prepend=-1))
    return buckets[new], np.add.reduceat(n, new) if len(new) else n


def frequent_runs(parts: DataFrame, frequent: BitFilter | None, least: int, ranges: int, log2: int) -> BitFilter:
    """A filter of pairs, or of threes if a filter of pairs is given, whose bucket has `least` or more over all shards.

    Buckets are of all languages together. A task gives away its sums packed, one row for each range of buckets; there are as
    many ranges as keep what one task unpacks about as large for any corpus.
    """
    bits = max(0, (ranges - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, at, hashes in _read(batches):
            found, often = np.unique(runs(at, hashes, frequent)[1] >> np.uint64(64 - BUCKETS_LOG2), return_counts=True)
            buckets, n = _added(np.concatenate([buckets, found.astype(np.int64)]), np.concatenate([n, often]))
        part = buckets >> (BUCKETS_LOG2 - bits)
        begin = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        rows = [(int(part[a]), b - a, pack([buckets[a:b], n[a:b]])) for a, b in zip(begin, [*begin[1:], len(part)])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["part", "n", "blob"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                more = unpack(blob, n, 2)
                had = sums.get(part)
                sums[part] = _added(*(np.concatenate([had[i], more[i]]) for i in (0, 1))) if had else (more[0], more[1])
        for buckets, n in sums.values():
            yield pa.RecordBatch.from_arrays([pa.array(buckets[n >= least] << (64 - BUCKETS_LOG2))], names=["h"])

    return BitFilter.of(parts.mapInArrow(count, "part int, n int, blob binary").repartition(ranges, "part").mapInArrow(total, "h long"), "h", log2)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, id, n) of docs (lang, text); word null: all words of the language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def batch() -> pa.RecordBatch:
            for words in found.values():
                words.pop(b".", None)
            rows = [(lang, w, word_hash(w), n) for lang, words in found.items() for w, n in words.items()]
            rows += [(lang, None, 0, words.total()) for lang, words in found.items()]
            found.clear()
            ids = _signed(np.array([r[2] for r in rows], dtype=np.uint64))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array(ids), pa.array([r[3] for r in rows], pa.int64())], names=["lang", "word", "id", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(tokens(text))
                if sum(map(len, found.values())) > COUNTED:
                    yield batch()
        yield batch()

    return docs.mapInArrow(count, "lang string, word binary, id long, n long").groupBy("lang", "word").agg(F.max("id").alias("id"), F.sum("n").alias("n"))


def _merged(rows: np.ndarray) -> np.ndarray:
    """Rows (hash, length, ids, count) with each phrase once, in the order of their hashes, and the sum of its counts."""
    rows = rows[:, np.lexsort(rows[-2::-1])]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:-1]) != 0).any(axis=0)])) if rows.shape[1] else np.zeros(0, np.int64)
    out = rows[:, new]
    if len(new):
        out[-1] = np.add.reduceat(rows[-1], new)
    return out


def phrase_counts(parts: DataFrame, twos: BitFilter, threes: BitFilter | None, most: int, least: int, ranges: int) -> DataFrame:
    """(lang, ids, n) of phrases of two to `most` words that stand `least` times or more: popcounts of their bitmaps, summed over
    shards. As with buckets, a task gives away its sums packed, by ranges of the phrases' hashes."""
    bits = max(0, (ranges - 1).bit_length())

    def of_shard(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        words: list[tuple[int, ...]] = []
        counts: list[int] = []
        for phrase, n in extended(at, hashes, twos, threes, most):
            words.append(phrase)
            counts.append(n)
        rows = np.zeros((most + 3, len(words)), dtype=np.int64)
        rows[1] = np.fromiter(map(len, words), np.int64, len(words))
        within = np.arange(most)[None, :] < rows[1][:, None]
        ids = np.zeros((len(words), most), dtype=np.uint64)
        ids[within] = hashes[np.fromiter(chain.from_iterable(words), np.int64, int(rows[1].sum()))]
        h = rows[1].astype(np.uint64)
        for column in ids.T:
            h = pair_hashes(h, column)
        rows[0], rows[2:-1], rows[-1] = (h >> np.uint64(1)).view(np.int64), ids.T.view(np.int64), counts
        return rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for lang, at, hashes in _read(batches):
            rows = of_shard(at, hashes)
            found[lang] = _merged(np.concatenate([found[lang], rows], axis=1) if lang in found else rows)
        packed = []
        for lang, rows in found.items():
            part = rows[0] >> (63 - bits)
            begin = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            packed += [(lang, int(part[a]), b - a, pack([np.ascontiguousarray(c[a:b]) for c in rows])) for a, b in zip(begin, [*begin[1:], len(part)])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in packed], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["lang", "part", "n", "blob"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, part, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                rows = unpack(blob, n, most + 3)
                had = sums.get((lang, part))
                sums[lang, part] = _merged(np.concatenate([had, rows], axis=1)) if had is not None else rows
        schema = pa.schema([("lang", pa.string()), ("ids", pa.list_(pa.int64())), ("n", pa.int64())])
        for (lang, _), rows in sums.items():
            rows = rows[:, rows[-1] >= least]
            ids = [ids[:k] for k, ids in zip(rows[1].tolist(), rows[2:-1].T.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, schema.field("ids").type), pa.array(rows[-1])], schema=schema)

    packed = parts.mapInArrow(count, "lang string, part int, n int, blob binary").repartition(ranges, "lang", "part")
    return packed.mapInArrow(total, "lang string, ids array<bigint>, n long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, filter_log2: int = FILTER_LOG2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, words, phrases): rows (lang, n); (lang, id, word, n) of frequent words; (lang, ids, n) of all frequent phrases,
    single words among them. Null languages are `und`."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = scratch.cache(word_counts(texts).where(F.col("word").isNull() | (F.col("n") >= least)))
    totals = counted.where(F.col("word").isNull()).select("lang", "n")
    words = counted.where(F.col("word").isNotNull())
    words = words.select("lang", "id", F.col("word").cast("string").alias("word"), "n")
    if words.groupBy("lang", "id").count().where("count > 1").take(1):
        raise ValueError("two frequent words share a 64-bit hash")
    keep = BitFilter.of(words, "id", filter_log2)
    single = words.select("lang", F.array("id").alias("ids"), "n")
    if most_words < 2 or is_empty(words):
        return totals, words, single
    parts = scratch.cache(shards(texts, keep))
    ranges = 1 + min(totals.agg(F.sum("n")).first()[0] // RANGE, 1 << 20)
    twos = frequent_runs(parts, None, least, ranges, filter_log2)
    threes = frequent_runs(parts, twos, least, ranges, filter_log2) if most_words > 2 else None
    longer = scratch.cache(phrase_counts(parts, twos, threes, most_words, least, ranges))
    return totals, words, single.unionByName(longer)


def score(totals: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, ids, a, l, r, n, score) of phrases of two words or more: that of the cut with the lowest score, of equal scores
    the first. Numbers are decimals of 38 digits, as 1000 * a * n and l * r may pass 64 bits."""
    whole = phrases.where(F.size("ids") > 1).select("lang", "ids", F.col("n").alias("a"))
    cuts = whole.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(ids, 1, k)").alias("left"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"))
    part = lambda side, n: phrases.select("lang", F.col("ids").alias(side), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= LANGS else totals, "lang")
    exact = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    cuts = cuts.select("lang", "ids", "a", "l", "r", "n", "k", exact.cast("long").alias("score"))
    least = F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("m")
    return cuts.groupBy("lang", "ids").agg(least).select("lang", "ids", "m.a", "m.l", "m.r", "m.n", "m.score")


def contained(phrases: DataFrame) -> DataFrame:
    """(lang, ids, n): phrases that stand inside a longer one as often as by themselves. One word more is enough to look at: a
    phrase between two of equal counts has that count too."""
    longer = phrases.where(F.size("ids") > 2)
    parts = F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)")))
    return longer.select("lang", parts.alias("ids"), "n").distinct()


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, **limits) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, count and text.

    Null and empty texts have no words; repeated rows count each; ids are not used. A language without a frequent phrase has no
    rows, and an empty table gives none. Equal scores and counts are ranked by the phrase's bytes. limits: those of
    frequent_phrases().
    """
    scratch = Scratch(docs.sparkSession)
    totals, words, phrases = frequent_phrases(docs, text_col, lang_col, **limits)
    scored = score(totals, phrases).join(contained(phrases).withColumnRenamed("n", "a"), ["lang", "ids", "a"], "left_anti")
    # texts are needed only for those that can be among the first: a rank by numbers alone, cut in each task before its shuffle
    near = scratch.cache(scored.withColumn("at", F.expr("rank() OVER (PARTITION BY lang ORDER BY score DESC, a DESC)")).where(F.col("at") <= top).drop("at"))
    named = near.select("lang", "ids", F.posexplode("ids").alias("pos", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    named = named.groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = near.join(named, ["lang", "ids"]).withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)").cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, ws[i:i+{k - 1}] AS p FROM pieces, unnest(range(1, len(ws) - {k - 2})) AS u(i)" for k in range(1, MOST_WORDS + 1))
OP12_SQL = f"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(ws)) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, p, count(*) AS a FROM ({_GRAMS}) GROUP BY lang, p HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.p, c.a, x.a AS l, y.a AS r, totals.n, k, CAST((CAST(1000 AS HUGEINT) * c.a * totals.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM f c, unnest(range(1, len(c.p))) AS u(k), f x, f y, totals
  WHERE len(c.p) > 1 AND x.lang = c.lang AND x.p = c.p[1:k] AND y.lang = c.lang AND y.p = c.p[k+1:len(c.p)] AND totals.lang = c.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS rn FROM cuts) WHERE rn = 1),
inside AS (SELECT lang, p[1:len(p)-1] AS p, a FROM f WHERE len(p) > 2 UNION SELECT lang, p[2:len(p)] AS p, a FROM f WHERE len(p) > 2),
left_over AS (SELECT b.* FROM best b ANTI JOIN inside i ON b.lang = i.lang AND b.p = i.p AND b.a = i.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM left_over)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
