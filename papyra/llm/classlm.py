"""LM scoring with Brown class-based n-grams (operator 4).

P(word | word before) = P(class | class before) * P(word | class). Counts come from all training texts. The exchange algorithm
moves each of the CLUSTERED most frequent words to the class that raises the likelihood of the class bigrams most, until a
round moves few. Executors then sum the classes before and after each further known word and give it the class of the same
likelihood's greatest gain. Exchange goes on over all known words in REFINE rounds, in each of which executors move half of
them at once; a round that doesn't raise the likelihood of all training bigrams is taken back. Words beyond the known ones
form one class of their own, and so does the end of a text. Words are 64-bit hashes.

Texts are read twice, for the unigrams and to turn their words into numbers, which the later steps read packed. The driver
holds the KNOWN most frequent words with their classes, a matrix of CLUSTERED by CLUSTERED bigrams at most, and one of the
classes, whatever the corpus. Rarer words are looked up by a join; each is rare, so no key of it is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_words, mix64, pack, table, unpack, word_hashes

#: Words that the exchange algorithm clusters, and its classes.
CLUSTERED, CLASSES = 2046, 64
#: Rounds of exchange at most; it stops earlier when a round moves under one word in a hundred. Rounds over all known words.
ROUNDS, REFINE = 6, 4
#: Words that every executor knows; the others are joined.
KNOWN = 200_000
#: Pseudo-counts: of unigrams (as in the base), of words in clustered classes, of class transitions.
UNIGRAM, EMISSION, TRANSITION = 0.1, 0.05, 8.0
#: Distinct words that a task holds before it passes its counts on, and parts into which contexts of words are dealt.
FLUSH, PARTS = 1_000_000, 256

#: The end of a text: a hash of white space, which no word can be.
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))


def _tokens(text: str | None) -> np.ndarray:
    h = word_hashes(ascii_words(text))
    return np.append(h, END)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def flush():
        keys, n = _merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["h", "n"])

    for batch in batches:
        texts = batch.column(0).to_pylist()
        if not texts:
            continue
        count: Counter[bytes] = Counter()
        for t in texts:
            count.update(ascii_words(t))
        keys = np.append(word_hashes(list(count)), END)
        parts.append((keys, np.append(np.fromiter(count.values(), np.int64, len(count)), len(texts))))
        held += len(keys)
        if held > 2 * FLUSH:
            parts[:] = [_merged(parts)]
            held = len(parts[0][0])
            if held > FLUSH:
                yield flush()
                parts, held = [], 0
    if parts:
        yield flush()


class Vocabulary:
    """Sorted hashes of the known words, with their counts and their numbers among the clustered ones."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, clustered: int):
        order = np.lexsort((hashes, -counts))
        number = np.full(len(hashes), clustered + 1, dtype=np.int32)  # all others
        top = [i for i in order if hashes[i] != END][:clustered]
        number[top] = np.arange(len(top))
        number[hashes == END] = clustered
        by = np.argsort(hashes)
        self.hashes, self.counts, self.number, self.clustered, self.size = hashes[by], counts[by], number[by], clustered, clustered + 2
        # ranks by count, as small numbers pack well; the last is that of unknown words, whose place is -1
        self.rank = np.empty(len(hashes) + 1, dtype=np.uint32)
        self.rank[np.append(np.argsort(by)[order], -1)] = np.arange(len(hashes) + 1)
        self.place = np.append(np.argsort(self.rank[:-1]), -1)

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token among the known words, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, tokens), max(len(self.hashes) - 1, 0))
        return np.where(self.hashes[at] == tokens, at, -1) if len(self.hashes) else np.full(len(tokens), -1)

    def numbers(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.number[at], self.clustered + 1) if len(self.hashes) else np.full(len(at), self.clustered + 1)


def pack_ranks(ranks: np.ndarray) -> bytes:
    """Ranks under 2 ** 24 as three byte planes, compressed."""
    planes = np.ascontiguousarray(ranks.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3])
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_ranks(blob: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(pa.decompress(blob, decompressed_size=3 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(3, n).astype(np.int64)
    return x[0] | x[1] << 8 | x[2] << 16


def _encoded(vocabulary: Vocabulary, base: np.ndarray):
    """Rows (id, key, held_out, text) with their known words packed and the hashes of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, known, score, blobs, tail = [], [], [], [], []
            for text in batch.column(3).to_pylist():
                tokens = _tokens(text)
                at = vocabulary.find(tokens)
                hit = at >= 0
                n.append(len(tokens))
                known.append(int(hit.sum()))
                score.append(float(base[at[hit]].sum()))
                blobs.append(pack_ranks(vocabulary.rank[at]))
                tail.append(tokens[~hit].astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tail])]).astype(np.int32)), pa.array(np.concatenate([*tail, np.empty(0, np.int64)])))
            columns = [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(score, pa.float64()), pa.array(blobs, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "held_out", "n_tokens", "n_known", "base_score", "words", "tail"])

    return run


def _places(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows (n_tokens, words): the places of a batch's tokens, one text after the other, each with its end."""
    for batch in batches:
        if batch.num_rows:
            yield vocabulary.place[np.concatenate([unpack_ranks(b, n) for n, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])]


def _bigrams(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = vocabulary.size
        total = np.zeros(m * m, dtype=np.int32)
        for at in _places(vocabulary, batches):
            # every text follows an end, and the texts of a batch stand one after the other
            w = vocabulary.numbers(at).astype(np.int64)
            before = np.concatenate([[vocabulary.clustered], w[:-1]])
            keys, n = np.unique(before * m + w, return_counts=True)
            total[keys] += n.astype(np.int32)
        keys = np.flatnonzero(total)
        for at in range(0, len(keys), 200_000):
            k = keys[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array((k // m).astype(np.int32)), pa.array((k % m).astype(np.int32)), pa.array(total[k].astype(np.int64))], names=["a", "b", "n"])

    return run


def _rows_packed(m: int):
    """Rows (a, bs, ns) of a matrix of m columns: (a, whole row packed), as the driver collects them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for b, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                row = np.zeros(m, dtype=np.int64)
                row[b] = n
                blobs.append(pa.compress(row.tobytes(), codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["a", "row"])

    return run


def exchange(bigrams: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each word by the exchange algorithm.

    bigrams: (words + 2) squared; the last two rows and columns are the end and all other words, each a class for itself.
    Words start dealt out in turn. A word moves to the class that gains most, of equal gains the first.
    """
    m = len(bigrams)
    words = m - 2
    c = min(classes, max(words, 1))
    of = np.concatenate([np.arange(words) % c, [c, c + 1]]).astype(np.int64)
    k = c + 2
    one = np.zeros((m, k))
    one[np.arange(m), of] = 1
    right, left = bigrams @ one, bigrams.T @ one  # counts of (word, class after), (word, class before)
    cells = one.T @ right
    follows, leads = cells.sum(axis=0), cells.sum(axis=1)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    diag = np.arange(k)
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            a, self_n = of[w], bigrams[w, w]
            r, lf = right[w].copy(), left[w].copy()
            rn, ln = r.sum(), lf.sum()
            if not rn + ln:
                continue
            # take the word out of its class
            cells[a] -= r
            cells[:, a] -= lf
            cells[a, a] += self_n
            r[a] -= self_n
            lf[a] -= self_n
            leads[a] -= rn
            follows[a] -= ln
            base = f(cells)
            gain_r = f(cells + r[None, :]) - base
            gain_l = f(cells + lf[:, None]) - base
            both = f(cells[diag, diag] + r + lf + self_n) - base[diag, diag]
            gain = gain_r.sum(axis=1) - gain_r[diag, diag] + gain_l.sum(axis=0) - gain_l[diag, diag] + both
            gain -= f(leads + rn) - f(leads) + f(follows + ln) - f(follows)
            best = int(np.argmax(gain[:c]))
            if gain[best] <= gain[a] + 1e-9:
                best = a
            else:
                moved += 1
                column, row = bigrams[:, w], bigrams[w]
                right[:, a] -= column
                right[:, best] += column
                left[:, a] -= row
                left[:, best] += row
                r, lf = right[w].copy(), left[w].copy()
                r[best] -= self_n
                lf[best] -= self_n
            cells[best] += r
            cells[:, best] += lf
            cells[best, best] += self_n
            leads[best] += rn
            follows[best] += ln
            of[w] = best
        if moved * 100 < words:
            break
    return of


def _contexts(vocabulary: Vocabulary, cls: np.ndarray, end: int, k: int, moving: np.ndarray):
    """Counts of the classes beside each moving word, packed: (part, n, rows of (word's place and code, count)).

    Places are of sorted hashes, so that ranges of them are parts of like size, and all rows of a word are in one.
    With k classes, codes under k are those of classes after the word, k is the word itself after it, and greater ones are
    k + 1 and the class before.
    """
    cls, moving = np.append(cls, k - 1).astype(np.int64), np.append(moving, False)  # -1, an unknown word, is the last
    bounds = np.arange(PARTS + 1) * (len(cls) - 1) // PARTS * (2 * k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            keys, n = _merged(parts)
            cuts = np.searchsorted(keys, bounds)
            some = np.flatnonzero(np.diff(cuts))
            blobs = [pack([keys[cuts[i] : cuts[i + 1]], n[cuts[i] : cuts[i + 1]]]) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.diff(cuts)[some].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "n", "rows"])

        for at in _places(vocabulary, batches):
            c = cls[at]
            i = np.flatnonzero(moving[at])
            same_after, same_before = at[i + 1] == at[i], (i > 0) & (at[i - 1] == at[i])  # the last token is an end
            after = np.where(same_after, k, c[i + 1])
            before = k + 1 + np.where(i > 0, c[i - 1], end)
            keys, n = np.unique(np.concatenate([at[i] * (2 * k + 1) + after, (at[i] * (2 * k + 1) + before)[~same_before]]), return_counts=True)
            parts.append((keys, n))
            if sum(len(p[0]) for p in parts) > 2 * FLUSH:
                parts[:] = [_merged(parts)]
                if len(parts[0][0]) > FLUSH:
                    yield from flush()
                    parts = []
        if parts:
            yield from flush()

    return run


def likelihood(cells: np.ndarray) -> float:
    """What of the log likelihood depends on the classes."""

    def f(x: np.ndarray) -> float:
        return float((x * np.log(np.maximum(x, 1.0))).sum())

    return f(cells) - f(cells.sum(axis=0)) - f(cells.sum(axis=1))


def best_classes(after: np.ndarray, before: np.ndarray, own: np.ndarray, cells: np.ndarray, a: int | None = None) -> np.ndarray:
    """The class to which each word of class a goes, with the greatest gain in likelihood; of equal gains it stays, else the first.

    after, before: words by classes, without the word itself; own: how often it follows itself. The last two classes, the
    end and all other words, aren't chosen; a is the last one unless told otherwise.
    """
    k = len(cells)
    a, c = k - 1 if a is None else a, max(k - 2, 1)
    follows, leads = cells.sum(axis=0), cells.sum(axis=1)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    def side(counts: np.ndarray, other: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Gain over the cells (class chosen, class beside), but for those on the diagonal."""
        gain = np.zeros((len(counts), c))
        w, d = np.nonzero(np.where(np.arange(k) == a, 0, counts))
        if len(w):
            n = counts[w, d][:, None]
            each = f(table[:c, d].T + n) - f(table[:c, d].T)
            inside = d < c
            each[np.flatnonzero(inside), d[inside]] = 0
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[starts]] = np.add.reduceat(each, starts, axis=0)
        left = np.maximum(table[None, :c, a] - other[:, :c], 0)  # without the word's own share of the class it leaves
        return gain + f(left + counts[:, a : a + 1]) - f(left)

    d = np.arange(c)
    rn, ln = (after.sum(axis=1) + own)[:, None], (before.sum(axis=1) + own)[:, None]
    gain = side(after, before, cells) + side(before, after, cells.T)
    gain += f(cells[d, d] + after[:, :c] + before[:, :c] + own[:, None]) - f(cells[d, d])
    gain -= f(leads[:c] + rn) - f(leads[:c]) + f(follows[:c] + ln) - f(follows[:c])
    if a < c:  # staying brings back what going takes away
        others = np.arange(k) != a
        back = [(f(line[others]) - f(line[others] - n[:, others])).sum(axis=1) for line, n in ((cells[a], after), (cells[:, a], before))]
        inside = f(cells[a, a]) - f(cells[a, a] - after[:, a] - before[:, a] - own)
        margins = f(leads[a]) - f(leads[a] - rn[:, 0]) + f(follows[a]) - f(follows[a] - ln[:, 0])
        gain[:, a] = back[0] + back[1] + inside - margins + 1e-9
    return gain.argmax(axis=1)


def _assigned(cells: np.ndarray, cls: np.ndarray):
    k = len(cells)

    def classed(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, n = _merged(parts)
        words, row = np.unique(keys // (2 * k + 1), return_inverse=True)
        for x in range(0, len(words), 512):
            w = words[x : x + 512]
            some = slice(*np.searchsorted(row, [x, x + len(w)]))
            counts = np.zeros((len(w), 2 * k + 1))
            counts[row[some] - x, keys[some] % (2 * k + 1)] = n[some]
            now = cls[w]
            best = np.empty(len(w), dtype=np.int32)
            for a in np.unique(now).tolist():
                c = counts[now == a]
                best[now == a] = best_classes(c[:, :k], c[:, k + 1 :], c[:, k], cells, a)
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(best)], names=["w", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed contexts sorted by part: each word's best class."""
        part, held, size = None, [], 0
        for batch in batches:
            for p, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if p != part and held:
                    yield from classed(held)
                    held, size = [], 0
                part = p
                keys, counts = unpack(blob, n, 2)
                held.append((keys, counts))
                size += n
                if size > FLUSH:  # all distinct rows of a part are some hundred thousands
                    held = [_merged(held)]
                    size = len(held[0][0])
        if held:
            yield from classed(held)

    return run


def _transitions(vocabulary: Vocabulary, classes: np.ndarray, end: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, dtype=np.int64)
        for at in _places(vocabulary, batches):
            w = np.append(classes, k - 1)[at].astype(np.int64)  # -1, an unknown word, is the last
            total += np.bincount(np.concatenate([[end], w[:-1]]) * k + w, minlength=k * k)
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((keys // k).astype(np.int32)), pa.array((keys % k).astype(np.int32)), pa.array(total[keys])], names=["a", "b", "n"])

    return run


class Model:
    """Log10 probabilities: of classes after classes, and of known words in their classes.

    Known words that aren't clustered are in the class of all others until settle() is told theirs.
    """

    def __init__(self, vocabulary: Vocabulary, bigrams: np.ndarray, tokens: int, distinct: int, classes: int = CLASSES):
        of = exchange(bigrams, classes)
        k = int(of.max()) + 1
        one = np.zeros((len(of), k))
        one[np.arange(len(of)), of] = 1
        self.of, self.vocabulary = of, vocabulary
        self.tokens, self.distinct = tokens, distinct
        self.settle(of[vocabulary.number], one.T @ bigrams @ one)

    def settle(self, cls: np.ndarray, cells: np.ndarray) -> None:
        """Classes of the known words, and bigrams of classes, of which the last one is that of all other words."""
        vocabulary, k = self.vocabulary, len(cells)
        n = cells.sum(axis=0)
        share = (n + 1) / (n.sum() + k)
        self.step = np.log10((cells + TRANSITION * share[None, :]) / (cells.sum(axis=1, keepdims=True) + TRANSITION))
        self.cls, self.cells = cls, cells
        others = cls == k - 1
        self.rare_n = self.tokens - int(vocabulary.counts[~others].sum())
        self.rare_types = self.distinct - int((~others).sum()) + 1  # and one for all words never seen
        total = np.bincount(cls[~others], weights=vocabulary.counts[~others], minlength=k)
        types = np.bincount(cls[~others], minlength=k)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = (vocabulary.counts + EMISSION) / (total[cls] + EMISSION * types[cls])
        self.emit = np.log10(np.where(others, (vocabulary.counts + UNIGRAM) / (self.rare_n + UNIGRAM * self.rare_types), inside))


def _scores(model: Model):
    """Rows (n_tokens, words, others): the others with the score of the words that are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = model.vocabulary
        of, end = np.append(model.cls, len(model.step) - 1), model.of[v.clustered]
        for batch in batches:
            score = []
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = v.place[unpack_ranks(blob, n)]
                cls = of[at]
                score.append(float(model.step[np.concatenate([[end], cls[:-1]]), cls].sum() + model.emit[at[at >= 0]].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(score, pa.float64())], names=["doc_id", "row_key", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, fold: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Held out, and so not learned from, are rows whose crc32(id as text) mod folds is fold; rows with a null id are held out
    too. Null and empty texts have one token, the end. With nothing to learn from, all words are unknown and equally likely.
    Repeated rows count as often as they occur.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    train = rows.where("not held_out").select("text")
    words = scratch.cache(train.mapInArrow(_unigrams, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    distinct, tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # the most frequent words: whole steps of count, so that no word of a step is left out for another
    step = F.floor(F.log2("n") * 32).cast("int")
    steps = sorted(words.groupBy(step.alias("s")).count().collect(), reverse=True)  # some hundreds of rows
    cutoff, have = None, 0
    for s, n in steps:
        if have + n > KNOWN:
            break
        cutoff, have = s, have + n
    is_known = (step >= cutoff if cutoff is not None else F.lit(False)) | (F.col("h") == int(END.astype(np.int64)))
    frequent = words.where(is_known).toPandas()
    vocabulary = Vocabulary(frequent["h"].to_numpy().astype(np.int64).view(np.uint64), frequent["n"].to_numpy().astype(np.int64), CLUSTERED)
    del frequent
    kind = dict(rows.dtypes)["doc_id"]
    about = f"doc_id {kind}, row_key long, held_out boolean, n_tokens long, n_known long, base_score double"
    base = np.log10((vocabulary.counts + UNIGRAM) / (tokens + UNIGRAM * (distinct + 1)))
    keyed = rows.select("doc_id", F.monotonically_increasing_id().alias("row_key"), "held_out", "text")
    coded = scratch.cache(keyed.mapInArrow(_encoded(vocabulary, base), f"{about}, words binary, tail array<long>"))
    learned = coded.where("not held_out").select("n_tokens", "words")

    pairs = learned.mapInArrow(_bigrams(vocabulary), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = pairs.groupBy("a").agg(F.collect_list(F.struct("b", "n")).alias("x")).select("a", "x.b", "x.n")
    bigrams = np.zeros((vocabulary.size, vocabulary.size))
    for a, row in pairs.mapInArrow(_rows_packed(vocabulary.size), "a int, row binary").collect():
        bigrams[a] = np.frombuffer(pa.decompress(row, decompressed_size=8 * vocabulary.size, codec="zstd", asbytes=True), dtype=np.int64)
    model = Model(vocabulary, bigrams, int(tokens), int(distinct))
    del bigrams
    k, end = len(model.cells), int(model.of[vocabulary.clustered])

    def moved(cls: np.ndarray, cells: np.ndarray, moving: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes after the moving words went to their best ones, and the class bigrams of all training texts with them."""
        beside = learned.mapInArrow(_contexts(vocabulary, cls, end, k, moving), "part int, n int, rows binary").repartition("part").sortWithinPartitions("part")
        found = beside.mapInArrow(_assigned(cells, cls), "w int, class int").toPandas()
        cls = cls.copy()
        cls[found["w"].to_numpy()] = found["class"].to_numpy()
        seen = learned.mapInArrow(_transitions(vocabulary, cls, end, k), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()
        cells = np.zeros((k, k))
        cells[seen["a"].to_numpy(), seen["b"].to_numpy()] = seen["n"].to_numpy()
        return cls, cells

    model.settle(*moved(model.cls, model.cells, vocabulary.number == vocabulary.clustered + 1))
    for i in range(REFINE):
        half = (mix64(vocabulary.hashes) + np.uint64(i)) % np.uint64(2) == 0
        cls, cells = moved(model.cls, model.cells, half & (vocabulary.hashes != END))
        if likelihood(cells) <= likelihood(model.cells):
            break
        model.settle(cls, cells)

    scored = coded.select("n_tokens", "words", "doc_id", "row_key", "held_out", F.col("n_tokens").alias("n"), "n_known", "base_score").mapInArrow(_scores(model), f"{about}, score double")
    tail = coded.select("row_key", F.explode("tail").alias("h")).groupBy("row_key", "h").agg(F.count("*").alias("k")).join(words.where(~is_known), "h", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    more = tail.groupBy("row_key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known"),
        F.sum(F.col("k") * F.log10((F.col("c") + UNIGRAM) / (tokens + UNIGRAM * (distinct + 1)))).alias("base"),
        F.sum(F.col("k") * F.log10((F.col("c") + UNIGRAM) / (model.rare_n + UNIGRAM * model.rare_types))).alias("rare"),
    )
    out = scored.join(more, "row_key", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rare", F.lit(0.0))).alias("score"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
