"""Every operator of the list against brute force, and with nulls, empty and repeated rows, empty tables and extra columns."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import classlm, decontam, embeddings, langid, lines, minhash, packing, passages, quality, urls
from papyra.llm.common import Scratch, components

EN = "the and with that from this have were their which about there would could other people after first water"
FR = "les des dans pour que est une sur avec par plus sont cette mais comme tout fait leur même deux"


def prose(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary.split(), n))


@pytest.fixture(scope="module")
def corpus():
    """Rows of documents: prose, exact and near copies, nulls, empty, blank and long texts, repeated rows and ids."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        rows.append((i, prose(rng, EN if lang == "en" else FR, int(rng.integers(30, 120))) + f" own{i} word{i * 7}", lang, f"src{i % 12}"))
    base = rows[3][1]
    for i in range(60, 75):
        words = base.split()
        words[int(rng.integers(0, len(words)))] = f"changed{i}"
        rows.append((i, " ".join(words), "fr", f"src{i % 12}"))
    rows += [(i, rows[4][1], "en", f"src{i % 12}") for i in range(75, 85)]
    rows += [(90, None, "en", "src1"), (91, "", None, None), (92, " \n\t ", "en", "src2"), (93, "Two words", "en", "src3"), (94, "two  WORDS", "en", "src3"), (None, "the and with that from", "en", "src3"), (95, prose(rng, EN, 6000), "en", "src4")]
    rows += [rows[7], rows[7]]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """With further columns whose names operators use themselves."""
    extra = {c: F.lit("x") for c in ("id", "h", "n", "score", "line", "component_id", "n_lines", "__text", "start", "value")}
    return spark.createDataFrame(corpus, SCHEMA).withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


def shingles(text, k=5):
    w = words_of(text)
    return frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize("task_edges", [250_000, 7])
def test_components(spark, task_edges):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 130)] + [(200, 200), (5, 6), (5, 6)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), task_edges).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_minhash_finds_all_links(docs, corpus):
    sets = {r[0]: shingles(r[1]) for r in corpus if r[0] is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), r.doc_id == root(r.doc_id))
    assert len({root(i) for i in range(60, 75)}) == 1


def test_minhash_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 150)
    rng = np.random.default_rng(2)
    base = prose(rng, EN, 60).split()
    rows = []
    for i in range(40):
        w = list(base)
        for p in rng.choice(len(w), 2, replace=False):
            w[p] = f"x{i}y{p}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    seen, todo = {0}, [0]
    while todo:
        a = todo.pop()
        for b in sets:
            if b not in seen and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                seen.add(b)
                todo.append(b)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, c in got.items() if c == 0} == seen


@pytest.mark.parametrize("kind,n", [("uniform", 300), ("small", 2000), ("halves", 150), ("one", 1)])
def test_packing_of_histograms(kind, n):
    rng = np.random.default_rng(3)
    sizes = {"uniform": rng.integers(1, 2049, n), "small": rng.integers(1, 400, n), "halves": rng.integers(600, 1100, n), "one": np.array([2048])}[kind]
    counts = np.bincount(sizes, minlength=2049)
    used, total = np.zeros(2049, dtype=int), 0
    for filling, times in packing.pack_histogram(counts):
        assert sum(filling) <= 2048
        total += times
        for s in filling:
            used[s] += times
    assert (used == counts).all() and packing.waste_bound(counts) <= total <= sum(k for _, k in packing.best_fit(counts, 2048))


def fewest(pieces, capacity):
    """By trying every sequence that is open for each piece."""
    best = len(pieces)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in {*rooms}:
            if room >= pieces[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - pieces[i]])
        go(i + 1, [*rooms, capacity - pieces[i]])

    go(0, [])
    return best


def test_packing_needs_no_more_than_all_ways_tried():
    rng = np.random.default_rng(31)
    for _ in range(120):
        capacity = int(rng.integers(10, 30))
        pieces = sorted((int(x) for x in rng.integers(1, capacity + 1, int(rng.integers(1, 10)))), reverse=True)
        counts = np.bincount(pieces, minlength=capacity + 1)
        want = fewest(pieces, capacity)
        assert sum(n for _, n in packing.pack_histogram(counts, capacity)) == want >= packing.waste_bound(counts, capacity)


def test_bin_completion_beats_best_fit(monkeypatch):
    monkeypatch.setattr(packing, "NODES", 600)
    counts = np.bincount(np.random.default_rng(32).integers(500, 801, 20_000), minlength=2049)
    found = packing.pack_histogram(counts)
    used = np.zeros(2049, dtype=int)
    for filling, n in found:
        assert sum(filling) <= 2048
        np.add.at(used, list(filling), n)
    assert (used == counts).all()
    assert packing.waste_bound(counts) <= sum(n for _, n in found) < sum(n for _, n in packing.best_fit(counts, 2048)) - 100


def test_packing_places_every_token(docs, corpus):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text, *_ in corpus:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for k, (a, n) in enumerate(packing.cut(len(ids), 2048)):
            want[(i, k, a, n, zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes()))] += 1
    got = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 2048


def test_ids_equal_the_tokenizer_on_odd_texts():
    from tokenizers import Tokenizer
    import public_tokenizers

    tok, ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Ids(None)
    for text in ("", " ", "a  b\n\n c\t", "it's we'll DON'T", "émile ça n°5 ½", "数字 １２ ٣", "x <|endoftext|> y", "🙂🙂", "  x", "ß" * 50, "a" * 3000):
        assert ids(text) == tok.encode(text, add_special_tokens=False).ids, text


def test_lines_equal_exact_counts(spark):
    rows = [(i, f"own line {i}\nshared by many\n\n  shared by  many \nby {i % 4} sites", "x", f"s{i % 15}") for i in range(45)] + [(100, None, "x", "s1"), (101, "", "x", None), (102, "shared by many", "x", None)]
    for limit in (3, 10):
        sites, first = defaultdict(set), {}
        for i, text, _, site in rows:
            for p, line in enumerate((text or "").split("\n")):
                key = " ".join(line.split())
                if key:
                    sites[key].add(site or "")
                    first[key] = min(first.get(key, (1 << 60, 0)), (i, p))
        want = {}
        for i, text, *_ in rows:
            kept = [x for p, x in enumerate((text or "").split("\n")) if not " ".join(x.split()) or len(sites[" ".join(x.split())]) < limit or first[" ".join(x.split())] == (i, p)]
            want[i] = None if text is None else "\n".join(kept)
        got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA), sites=limit).collect()}
        assert got == want


def test_leaks_equal_all_windows(spark, docs, corpus):
    rng = np.random.default_rng(9)
    items = [(j, prose(rng, EN, int(rng.integers(3, 40)))) for j in range(12)] + [(50, None), (51, ""), (52, "solo word"), (53, "tiny")]
    rows = list(corpus)
    for k, (j, text) in enumerate(items[:8]):
        w = text.split()
        if k % 2 and len(w) > 24:
            w[2] = "swapped"
        rows.append((200 + k, prose(rng, FR, 15) + " " + " ".join(w) + " " + prose(rng, FR, 15), "en", "src1"))
    items += [(60 + k, prose(rng, EN, 60)) for k in range(6)] + [(66, "go on " * 30), (None, prose(rng, EN, 33))]
    for k, share in enumerate((0.5, 0.25, 0.9, 0.85, 0.8, 0.7)):  # halves change places; parts at a document's beginning and end
        w = items[-8 + k][1].split()
        at = int(len(w) * share)
        rows.append((300 + k, prose(rng, FR, 25) + " " + " ".join(w[at:] + w[:at]) + " " + prose(rng, FR, 25), "en", "src1"))
        rows.append((310 + k, " ".join(w[-at:]) + " " + prose(rng, FR, 25), "en", "src1"))
        rows.append((320 + k, prose(rng, FR, 25) + " " + " ".join(w[:at]), "en", "src1"))
        rows.append((330 + k, prose(rng, FR, 9) + " " + " ".join(w[:40] + w[10:]) + " " + prose(rng, FR, 9), "en", "src1"))
    rows += [(340, "start " + "go on " * 31 + "end", "en", "s"), (341, items[-1][1], "en", "s"), (None, items[-1][1], "en", "s"), (342, "go on " * 20, "en", "s")]

    def counts(words, k):
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else Counter([tuple(words)]) if words else Counter()

    want = set()
    for i, text, *_ in rows:
        w = words_of(text)
        for j, item in items:
            x = words_of(item)
            if not x or not w:
                continue
            k = min(5, len(x))
            own = counts(x, k)
            for s in range(1 - len(x), len(w)):  # at the edges cut off
                win = counts(w[max(s, 0) : s + len(x)], k)
                both = sum((win & own).values())
                if both / (sum(win.values()) + sum(own.values()) - both) >= 0.75:
                    want.add((i, j))
                    break
    got = decontam.leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and {(300, 60), (322, 62), (312, 62), (340, 66), (341, None), (None, None)} <= want
    clean = {r.doc_id for r in decontam.leaks(docs, spark.createDataFrame([], "item_id long, text string")).collect()}
    assert clean == set()


def test_language_id(docs, corpus):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for i, text, lang, _ in corpus[:85]:
        assert got[i].language == lang and not got[i].rejected
    for i in (90, 91, 92):
        assert got[i].rejected and got[i].reason == "no_text" and got[i].language is None


def test_quality_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 != 0
        text = prose(rng, EN, 80) + "." if good else " ".join(w + "###" for w in prose(rng, EN, 80).split())
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s")]
    got = quality.score_quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(5000, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.97 * len(held)


def test_isotonic_is_monotone():
    x = np.array([1.0, 1.0, 2.0, 3.0, 4.0, 4.0])
    knots, values = quality.isotonic(x, np.array([0, 1, 0, 1, 1, 0.0]))
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()


def test_embeddings_find_all_links(spark, monkeypatch):
    for name, value in (("LEAF", 30), ("MOST_LEAF", 60), ("BLOCK", 25), ("FIT", 200)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 16))
    x[200:] = x[rng.integers(0, 40, 100)] + rng.standard_normal((100, 16)) * 0.12
    rows = [(i, [float(np.float32(v)) for v in x[i]], i % 2) for i in range(300)] + [(300 + i, [float(np.float32(v)) for v in x[0]], 0) for i in range(5)]
    bad = [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [float("nan")] * 16, 0), (404, [None] * 16, 0), (405, rows[0][1], None), (406, [float("inf")] * 16, 1)]
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    low = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.array([min([low[i], *low[link[i]]]) for i in range(len(rows))])
        if (new == low).all():
            break
        low = new
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows + bad + [rows[1]], "vec_id long, embedding array<float>, label int")).collect()}
    ids = [r[0] for r in rows]
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.99 * link.sum() > 0
    assert sum(got[i].component_id != ids[low[k]] for k, i in enumerate(ids)) <= 2
    assert all(got[r[0]].n_links == 0 and got[r[0]].kept for r in bad)


def test_lm_base_and_gain(docs, corpus):
    train = [r for r in corpus if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10]
    counts = Counter()
    for r in train:
        counts.update(words_of(r[1]))
        counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    got = classlm.lm_scores(docs).collect()
    assert len(got) == len(corpus) and all(r.train_tokens == n for r in got)
    for r in got:
        if r.doc_id is None:
            assert r.held_out
            continue
        tokens = [*words_of(dict((x[0], x[1]) for x in corpus)[r.doc_id]), "end"]
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(counts[t] > 0 for t in tokens))
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel_tol=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(8)
    hashes = np.sort(rng.choice(np.arange(1, 10**6), 30, replace=False)).astype(np.uint64)
    hashes[0] = classlm.END
    vocabulary = classlm.Vocabulary(np.sort(hashes), rng.integers(1, 50, 30), 12)
    bigrams = rng.integers(0, 9, (14, 14)).astype(float)
    tokens, distinct = int(vocabulary.counts.sum()) + 10, 35
    m = classlm.Model(vocabulary, bigrams, tokens, distinct, classes=4)
    rare = 10 ** np.log10((10 + 0.1 * 5) / (m.rare_n + 0.1 * m.rare_types)) + 0.1 / (m.rare_n + 0.1 * m.rare_types)  # five words beyond the known, and one unseen
    for c in range(m.step.shape[0]):
        known = sum(10 ** (m.step[c, m.of[vocabulary.number[i]]] + m.emit[i]) for i in range(30))
        assert math.isclose(known + 10 ** m.step[c, m.of[13]] * rare, 1.0, rel_tol=1e-9)


def test_fenwick_chains_equal_quadratic():
    rng = np.random.default_rng(10)
    for _ in range(20):
        n = int(rng.integers(1, 60))
        p, o = rng.integers(0, 80, n), rng.integers(0, 80, n)
        order = np.lexsort((o, p))
        best = np.zeros(n)
        for i in order:
            before = [best[j] - passages.GAP * (p[i] - p[j] + o[i] - o[j]) for j in range(n) if p[j] < p[i] and o[j] < o[i]]
            best[i] = passages.GAIN + max([0.0, *before])
        for c in passages.chains(p, o):
            assert (np.diff(p[c]) > 0).all() and (np.diff(o[c]) > 0).all()
            total = passages.GAIN
            for a, b in zip(c[:-1], c[1:]):
                total += passages.GAIN - passages.GAP * (p[b] - p[a] + o[b] - o[a])
            assert math.isclose(total, best[c[-1]])


def test_passages(spark, docs):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    passage = [word() for _ in range(60)]
    fuzzy = list(passage)
    for i in (20, 41):
        fuzzy[i] = "zzz"
    del fuzzy[30]
    rows = [(i, " ".join([word() for _ in range(50)] + body + [word() for _ in range(40)]), "x", "s") for i, body in ((1, passage), (2, passage), (3, fuzzy), (4, []), (5, []))]
    rows += [(6, rows[3][1].upper(), "x", "s"), (7, None, "x", "s"), (8, "", "x", "s"), (None, " ".join(passage), "x", "s"), (9, "one two", "x", "s"), (10, "one two", "x", "s")]
    got = {(r.doc_id, r.other_id): r for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {(2, 1), (3, 1), (6, 4)}
    assert (got[2, 1].start_word, got[2, 1].end_word, got[2, 1].other_start, got[2, 1].identity) == (50, 110, 50, 1.0)
    assert abs(got[3, 1].start_word - 50) <= 1 and abs(got[3, 1].end_word - 109) <= 1 and 0.9 < got[3, 1].identity < 1
    assert got[6, 4].n_seeds == 0
    assert passages.repeated_passages(docs).count() > 0


def test_url_rules(spark):
    cases = [
        ("https://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://x.org/es/1", "x.org", "/es/1", "org/", "allow"),
        ("http://example.org/en/12#a", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://m.x.com/fr/a", "m.x.com", "/fr/a", "com/fr/", "allow"),
        ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("http://x.com?u=/de/", "x.com", "", None, None),
        ("http://notorg/es/", "notorg", "/es/", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("ftp://x.org://y/z", "x.org:", "//y/z", None, None),
        ("", "", "", None, None),
    ]
    pages = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.filter_urls(pages.unionByName(pages)).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_url_templates(spark):
    rows = [(i, f"http://s.com/de/item{i}", "") for i in range(30)] + [(100 + i, f"http://s.com/xx/{i}", "") for i in range(30)] + [(200 + i, f"http://t.com/fr/{i}", "") for i in range(30)] + [(300 + i, f"http://t.com/xx/{i}", "") for i in range(5)]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].template == "/de/*" and got[100].template in ("/xx/*", "/*/*")
    assert got[100].verdict == "block" and got[300].verdict == "allow"


def test_url_templates_equal_a_tree_built_by_hand(spark):
    rng = np.random.default_rng(41)
    pages = []
    for i in range(700):
        host = ("a.com", "b.com", "c.net", "d.org")[int(rng.integers(0, 4))]
        first = ("de", "fr", "xx", f"r{int(rng.integers(0, 60))}")[int(rng.integers(0, 4))]
        deep = "/".join(f"s{int(rng.integers(0, 3))}" for _ in range(int(rng.integers(0, 4))))
        pages.append((i, f"http://{host}/{first}/{deep}", ""))
    pages += [(1000 + i, "http://a.com/" + "/".join(["de" if i % 2 else "xx", *["deep"] * 14, str(i)]), "") for i in range(40)] + [(2000, None, ""), (2001, "no scheme", ""), (2002, "x://a.com", "")]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    at = {i: (r.host, r.path[1:].split("/") if r.path else [], {"block": (1, 0), "allow": (0, 1)}.get(r.verdict if r.rule else None, (0, 0))) for i, r in got.items()}
    template = dict.fromkeys(at, "")
    for level in range(20):
        child, parent = defaultdict(lambda: np.zeros(3)), defaultdict(lambda: np.zeros(3))
        for i, (host, parts, (b, a)) in at.items():
            if len(parts) > level:
                child[host, template[i], parts[level]] += (1, b, a)
                parent[host, template[i]] += (1, b, a)
        stay = set()
        for (host, above, part), (n, b, a) in child.items():
            pn, pb, pa = parent[host, above]
            own, others = a + b, pa + pb - a - b
            if n < 5:
                continue
            if own and others:
                rate = pb / (pa + pb)
                good = abs(b / own - (pb - b) / others) / math.sqrt(max(rate * (1 - rate), 1e-9) * (1 / own + 1 / others)) >= 1.96
            else:
                good = bool(own) != bool(others) and n >= 0.02 * pn
            if good:
                stay.add((host, above, part))
        for i, (host, parts, _) in at.items():
            if len(parts) > level:
                template[i] += "/" + (parts[level] if (host, template[i], parts[level]) in stay else "*")
    of_template, of_host, whole = defaultdict(lambda: np.zeros(2)), defaultdict(lambda: np.zeros(2)), np.zeros(2)
    for i, (host, _, says) in at.items():
        of_template[host, template[i]] += says
        of_host[host] += says
        whole += says
    prior = (whole[0] + 0.5) / (whole.sum() + 1)
    for i, (host, _, _) in at.items():
        above = (of_host[host][0] + 4 * prior) / (of_host[host].sum() + 4)
        b, a = of_template[host, template[i]]
        purity = (b + 4 * above) / (a + b + 4)
        assert got[i].template == template[i] and abs(got[i].purity - purity) < 1e-5
        assert got[i].rule or got[i].verdict == ("block" if purity >= 0.7 else "allow")
    assert any(len(t) > 60 for t in template.values()) and (got[2000].host, got[2001].path, got[2002].host, got[2002].path) == ("", "", "a.com", "")


def test_concentrated_vectors_keep_their_links(spark, monkeypatch):
    for name, value in (("LEAF", 40), ("MOST_LEAF", 80), ("FIT", 300)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(42)
    x = rng.standard_normal((900, 24)) * 0.15 + np.r_[2.0, np.zeros(23)]
    vectors = spark.createDataFrame([(i, [float(v) for v in x[i]], 1) for i in range(900)] + [(900, [1e300, 1e300], 1), (901, [2e-310, 2e-310], 1)], "vec_id long, embedding array<double>, label int")
    vectors = vectors.withColumns({c: F.lit("x") for c in ("id", "label_", "tree", "leaf", "n", "copies", "place", "k1")})
    got = {r.vec_id: r for r in embeddings.near_vectors(vectors).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert all(got[i].n_links <= near[i] for i in range(900)) and sum(got[i].n_links for i in range(900)) >= 0.999 * near.sum() > 1000
    assert got[900].n_links == got[901].n_links == 1 and not got[901].kept


def test_empty_tables(spark, nothing):
    bench = spark.createDataFrame([(1, "some words of an item that is long")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for made in (packing.pack(nothing), quality.score_quality(nothing, labels), embeddings.near_vectors(vectors), classlm.lm_scores(nothing), lines.dedup_lines(nothing), passages.repeated_passages(nothing), decontam.leaks(nothing, bench), urls.filter_urls(pages), langid.identify(nothing), minhash.near_duplicates(nothing)):
        assert made.count() == 0


def test_pipeline_stages(spark, docs, corpus, tmp_path):
    from papyra.llm import pipeline as corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    spark.createDataFrame([(1, corpus[0][1][:120])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = docs.withColumn("n_chars", F.length("text").cast("long"))
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < 4:
            assert out.schema.names == df.schema.names and dict(out.dtypes) == dict(df.dtypes)
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r[0] for r in df.select("doc_id").collect()})
    assert not {90, 91, 92} & left[0] and set(range(60)) <= left[0]
    assert len(set(range(60, 75)) & left[2]) <= 1 and len({4, *range(75, 85)} & left[2]) == 1
    assert 0 not in left[3] and left[3] == left[4]


def test_passages_whose_seeds_have_earlier_holders(spark):
    rng = np.random.default_rng(12)
    words = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    shared, far = words(60), words(60)
    near = [w if i % 9 else f"b{i}" for i, w in enumerate(far)]  # B and C alike; A only in parts
    bodies = {2: shared[:30], 3: shared[30:], 7: shared, 9: shared, 11: far[:25], 12: near, 13: near[:59] + ["last"]}
    rows = [(i, " ".join(words(50) + body + words(40)), "x", "s") for i, body in bodies.items()]
    got = {(r.doc_id, r.other_id): r for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {(9, 7), (13, 12)}
    assert (got[9, 7].start_word, got[9, 7].end_word, got[9, 7].other_start, got[9, 7].identity) == (50, 110, 50, 1.0)


def test_gaps_of_any_length_are_aligned():
    rng = np.random.default_rng(21)
    for size in (0, 1, 5, 40, 90):
        for _ in range(5):
            a, b = rng.integers(0, 6, int(rng.integers(0, size + 1))), rng.integers(0, 6, size)
            table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
            for i in range(len(a)):
                for j in range(len(b)):
                    table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
            assert passages._common(a, b) == passages._common(b, a) == table[-1, -1]
    # two texts alike but for a word in four over 3,000 words, between anchors on two diagonals
    common = rng.integers(10, 10**9, 3000)
    a, b = common.copy(), common.copy()
    b[::4] = 1
    a, b = np.concatenate([[2] * 5, a, [3] * 5]), np.concatenate([[2] * 5, [4], b, [3] * 5])
    got = passages.align(a, b, np.array([0, len(a) - 5]), np.array([0, len(b) - 5]))
    assert got[:4] == (0, len(a), 0, len(b)) and math.isclose(got[4], (len(a) - 750) / len(b)) and not got[5]


def test_passages_go_on_as_far_as_texts_are_alike(spark):
    """Beyond the seeds every fifth word differs, over 1,500 words before and 400 after: no seed, and more than one slice."""
    rng = np.random.default_rng(23)
    words = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    odd = lambda body: [w if i % 5 else "x" + w for i, w in enumerate(body)]
    before, seeds, after = words(1500), words(30), words(400)
    near = odd(before) + seeds + odd(after)
    rows = [(1, words(50) + before + seeds + after + words(40)), (2, words(30) + near + words(60)), (3, near)]  # 3 has nothing around
    got = {(r.doc_id, r.other_id): r for r in passages.repeated_passages(spark.createDataFrame([(i, " ".join(w), "x", "s") for i, w in rows], SCHEMA)).collect()}
    assert {(2, 1), (3, 2)} <= set(got) <= {(2, 1), (3, 1), (3, 2)}
    r = got[2, 1]
    assert (r.start_word, r.end_word, r.other_start, r.other_end) == (31, 1960, 51, 1980)  # the first word of each end differs
    assert math.isclose(r.identity, 1 - (300 - 1 + 80) / 1929)
    assert (got[3, 2].start_word, got[3, 2].end_word, got[3, 2].identity) == (0, 1930, 1.0)


def test_packed_rows_and_partners():
    rng = np.random.default_rng(13)
    h, ids, pos = rng.integers(0, 40, 500), rng.integers(-9, 9, 500), rng.integers(0, 99, 500)
    h.sort()
    assert (passages.unpack(passages.pack([h, ids, pos]), 500, 3) == [h, ids, pos]).all()
    at = defaultdict(lambda: defaultdict(list))
    for x, i, p in zip(h.tolist(), ids.tolist(), pos.tolist()):
        at[x][i].append(p)
    want = Counter()
    for by in at.values():
        order = sorted(by)
        for n, i in enumerate(order):
            for j in {*order[:1], *order[max(n - 2, 0) : n]} if n else ():
                want.update((i, j, p, min(by[j])) for p in by[i])
    assert Counter(zip(*(x.tolist() for x in passages.partners(h, ids, pos, 2)))) == want


def test_passage_recall_by_identity(spark):
    rng = np.random.default_rng(14)
    words = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    rows = []
    for pair in range(120):
        body = words(60)
        other = [w if rng.random() < (0.9, 0.85, 0.8)[pair % 3] else "x" + w for w in body]
        rows += [(2 * pair + k, " ".join(words(30) + b + words(30)), "x", "s") for k, b in enumerate((body, other))]
    got = {(r.doc_id, r.other_id) for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got <= {(2 * p + 1, 2 * p) for p in range(120)}
    for k, least in enumerate((0.97, 0.9, 0.8)):
        assert sum((2 * p + 1, 2 * p) in got for p in range(k, 120, 3)) >= least * 40


def test_lm_further_words_take_the_best_class():
    rng = np.random.default_rng(15)
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    for _ in range(20):
        k = 6
        after, before, own = rng.integers(0, 4, (5, k)).astype(float), rng.integers(0, 4, (5, k)).astype(float), rng.integers(0, 3, 5).astype(float)
        cells = rng.integers(20, 200, (k, k)).astype(float)
        got = classlm.best_classes(after, before, own, cells)
        for w in range(5):
            gone = cells.copy()
            gone[-1] -= after[w]
            gone[:, -1] -= before[w]
            gone[-1, -1] -= own[w]
            likelihoods = []
            for b in range(k - 2):
                x = gone.copy()
                x[b] += after[w]
                x[:, b] += before[w]
                x[b, b] += own[w]
                likelihoods.append(f(x) - f(x.sum(axis=0)) - f(x.sum(axis=1)))
            assert likelihoods[got[w]] >= max(likelihoods) - 1e-6


def test_lm_exchange_moves_words_to_the_best_class_or_leaves_them():
    rng = np.random.default_rng(19)
    for _ in range(20):
        k = 6
        a = int(rng.integers(0, k - 2))
        after, before, own = rng.integers(0, 9, (5, k)).astype(float), rng.integers(0, 9, (5, k)).astype(float), rng.integers(0, 3, 5).astype(float)
        cells = rng.integers(20, 60, (k, k)).astype(float)
        got = classlm.best_classes(after, before, own, cells, a)
        for w in range(5):
            likelihoods = []
            for b in range(k - 2):
                x = cells.copy()
                for c, sign in ((a, -1), (b, 1)):
                    x[c] += sign * after[w]
                    x[:, c] += sign * before[w]
                    x[c, c] += sign * own[w]
                likelihoods.append(classlm.likelihood(x))
            assert likelihoods[got[w]] >= max(likelihoods) - 1e-6


def test_lm_scores_equal_the_model_worked_out_by_hand(spark, monkeypatch):
    rng = np.random.default_rng(20)
    monkeypatch.setattr(classlm, "CLUSTERED", 12)
    made = {}
    settle = classlm.Model.settle

    def spy(self, cls, cells):
        settle(self, cls, cells)
        made.setdefault("all", []).append((self, cls, cells))

    monkeypatch.setattr(classlm.Model, "settle", spy)
    rows = [(i, " ".join(f"{'abc'[j % 3]}{int(rng.zipf(1.7)) % 50}" for j in range(40)) if i % 9 else None, "x", "s") for i in range(120)]
    got = classlm.lm_scores(spark.createDataFrame(rows, SCHEMA)).collect()
    model, cls, cells = made["all"][-1]
    seen = [classlm.likelihood(c) for _, _, c in made["all"][1:]]
    assert seen == sorted(seen)  # no round over all known words lowers it
    train = [[*(words_of(t) or []), "end"] for i, t, _, _ in rows if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in t)
    h = lambda w: classlm.END if w == "end" else classlm.word_hashes([w if isinstance(w, bytes) else w.encode()])[0]
    place = {int(x): i for i, x in enumerate(model.vocabulary.hashes)}
    k = len(cells)
    of = {w: int(cls[place[int(h(w))]]) for w in counts}
    assert all(model.vocabulary.counts[place[int(h(w))]] == n for w, n in counts.items())
    bigrams = np.zeros((k, k))
    for t in train:
        for x, y in zip(["end", *t[:-1]], t):
            bigrams[of[x], of[y]] += 1
    assert (bigrams == cells).all()
    share = (bigrams.sum(axis=0) + 1) / (bigrams.sum() + k)
    size, types = Counter(), Counter()
    for w, n in counts.items():
        size[of[w]] += n
        types[of[w]] += 1
    for r in got:
        text = dict((x[0], x[1]) for x in rows)[r.doc_id]
        score, last = 0.0, of["end"]
        for w in [*(words_of(text) or []), "end"]:
            c = of.get(w, k - 1)
            score += math.log10((bigrams[last, c] + classlm.TRANSITION * share[c]) / (bigrams[last].sum() + classlm.TRANSITION))
            if w in counts:
                score += math.log10((counts[w] + classlm.EMISSION) / (size[c] + classlm.EMISSION * types[c]))
            else:
                score += math.log10(classlm.UNIGRAM / (classlm.UNIGRAM * 1))  # the one word never seen
            last = c
        assert math.isclose(r.score, score, rel_tol=1e-9)


def test_lm_learns_from_words_beyond_the_clustered(spark, monkeypatch):
    monkeypatch.setattr(classlm, "CLUSTERED", 10)
    rng = np.random.default_rng(16)
    rows = [(i, " ".join(f"{'ab'[j % 2]}{int(rng.integers(0, 40))}" for j in range(60)), "x", "s") for i in range(200)]
    got = [r for r in classlm.lm_scores(spark.createDataFrame(rows, SCHEMA)).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in got) > 0.25 * sum(r.n_tokens for r in got)  # of log10(2) that the order tells


def test_rare_languages_are_kept_whatever_the_corpus(spark, monkeypatch):
    rng = np.random.default_rng(17)
    letters = {"el": "αβγδεζηθικλμνοπρστυφ", "ka": "აბგდევზთიკლმნოპჟრსტ", "am": "ሀለሐመሠረሰሸቀበተቸኀነኘአከኸወዐ"}
    vocabulary = {x: " ".join("".join(rng.choice(list(c), 4)) for _ in range(20)) for x, c in letters.items()}
    rare = [(i, prose(rng, vocabulary[x], 60), x, "src") for i, x in enumerate(["el"] * 4 + ["ka"] * 2 + ["am"])]
    for many in (60, 6000):  # the same texts in corpora of any size
        rows = rare + [(100 + i, prose(rng, EN, 30), "en", f"src{i % 5}") for i in range(many)]
        got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert all(got[i].language == x and not got[i].rejected for i, _, x, _ in rare)
        assert all(got[100 + i].language == "en" for i in range(many))
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].language == x and not got[i].rejected for i, _, x, _ in rare)


def test_long_items_at_the_least_similarity_are_leaks(spark):
    rng = np.random.default_rng(18)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    items = [words(200) for _ in range(150)]
    rows = [(i, " ".join(words(30) + item[28:] + words(30)), "x", "s") for i, item in enumerate(items)]  # 168 of 224 shingles
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    assert got == {(i, i) for i in range(150)}


def test_quality_equals_a_direct_fit(spark):
    """Least squares over stacked rows instead of summed equations, and the isotonic fit by its max-min formula."""
    rng = np.random.default_rng(51)
    rows, labels = [], []
    for i in range(500):
        share = rng.random()
        rows.append((i, " ".join(w + ("###" if rng.random() < share else "") for w in prose(rng, EN, int(rng.integers(20, 90))).split()), "en", "s"))
        if i % 7:
            labels.append((i, int(rng.random() > share), 0))
    both = next(i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    labels += [(both, 0, 0), (both, 1, 0), (1, 7, 0), labels[5]]
    rows += [(600, None, "en", "s"), (601, "", "en", "s"), rows[9]]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("y", "stats", "score", "held_out", "calibrates")})
    got = quality.score_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in ("y", "n", "most", "text")})).collect()
    assert len(got) == len(rows)

    learn = {i: y for i, y, _ in labels if y in (0, 1) and i != both and zlib.crc32(str(i).encode()) % 3 != 1}
    calibrates = {r.id for r in spark.range(600).where(f"pmod(xxhash64(id, 3), {quality.HOLD}) = 0").collect()}
    x = {i: np.array(quality.statistics(t)) for i, t, *_ in rows}
    train = [i for i, *_ in rows if i in learn]  # a repeated row counts twice
    of = np.array([x[i] for i in train])
    mean, sd = of.mean(axis=0), of.std(axis=0)
    draw = np.random.default_rng(quality.SEED)
    w, b = draw.normal(0, 1 / quality.WIDTH, (len(mean), quality.FEATURES)), draw.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(i):
        z = np.clip((x[i] - mean) / np.where(sd > 1e-9, sd, 1), -8, 8)
        return np.append(np.sqrt(2 / quality.FEATURES) * np.cos(z @ w + b), 1)

    fit = [i for i in train if i not in calibrates]
    penalty = np.full(quality.FEATURES + 1, quality.RIDGE * len(fit) / quality.FEATURES)
    penalty[-1] = 1e-9
    stacked = np.vstack([*(features(i) for i in fit), np.diag(np.sqrt(penalty))])
    weights = np.linalg.lstsq(stacked, np.array([*(learn[i] for i in fit), *([0.0] * len(penalty))]), rcond=None)[0]
    held = sorted((features(i) @ weights, learn[i]) for i in train if i in calibrates)
    y = np.array([v for _, v in held], dtype=float)
    n = len(y)
    fitted = [round(max(min(y[a:z].mean() for z in range(i + 1, n + 1)) for a in range(i + 1)), 9) for i in range(n)]
    knots, values = [], []
    for level in sorted(set(fitted)):
        at = [i for i in range(n) if fitted[i] == level]
        knots += [held[at[0]][0], held[at[-1]][0]]
        values += [(y[at].sum() + 1) / (len(at) + 2)] * 2
    assert len(set(values)) > 3
    for r in got:
        want = np.interp(features(r.doc_id) @ weights, knots, np.maximum.accumulate(values))
        assert abs(r.score - want) < 1e-3 and r.predicted == int(r.score >= 0.5)


def test_quality_statistics_by_hand():
    got = dict(zip(quality.STATISTICS, quality.statistics("Ab cd cd.\n\nAb 1 cd cd.\nAb cd cd.")))
    assert math.isclose(got["log_words"], math.log1p(10)) and math.isclose(got["distinct_words"], 4 / 10) and math.isclose(got["most_frequent_word"], 3 / 10)
    assert math.isclose(got["word_length"], (6 + 6 + 9 + 1) / 10) and got["repeated_neighbour"] == 0 and math.isclose(got["distinct_pairs"], 5 / 9)
    assert math.isclose(got["distinct_lines"], 2 / 3) and math.isclose(got["capitalised_words"], 3 / 10) and math.isclose(got["upper"], 3 / 32) and math.isclose(got["digit"], 1 / 32)
    assert all(v == 0 for k, v in zip(quality.STATISTICS, quality.statistics(None)) if "word" in k) and quality.statistics(None) == quality.statistics("")


def test_language_posteriors_worked_out_by_hand(spark):
    """Declarations are missing or wrong, and many texts are too short to tell: hosts and suffixes do."""
    rng = np.random.default_rng(52)
    vocabulary = {"en": EN, "fr": FR, "de": "der und über für können dass nicht eine auch noch schon wäre größe à propos"}
    hosts = {"en": ("a.com", "b.com", "x.org"), "fr": ("c.fr", "d.fr", "b.com"), "de": ("e.de", "localhost", None)}
    rows, truth = [], {}
    for i in range(360):
        lang = ("en", "fr", "de")[i % 3]
        declared = None if i % 5 == 0 else ("en", "fr", "de")[(i + 1) % 3] if i % 8 == 0 else ("EN-gb", "fr", " de")[i % 3]
        text = prose(rng, vocabulary[lang], 1 if i % 6 == 0 else int(rng.integers(3, 25)))
        rows.append((i, text if i % 30 else "xq" if i % 60 else f"{text}, 5 À!", declared, hosts[lang][int(rng.integers(0, 3))]))
        truth[i] = lang
    rows += [(400, "a", None, "c.fr"), (401, "12 34", "fr", "c.fr"), (402, "a", None, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}

    def trigrams(text):
        b = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode())
        b = b" " + b" ".join(b.split()) + b" "
        return [((int.from_bytes(b[i : i + 3], "big") * 2654435761) & 0xFFFFFFFF) >> 18 for i in range(len(b) - 2)] if b.strip() else []

    names = ["de", "en", "fr"]
    said = {i: (d or "").strip()[:2].lower() or None for i, _, d, _ in rows}
    counts = {x: Counter(t for i, text, *_ in rows if said[i] == x for t in trigrams(text)) for x in names}
    log = lambda x, t: math.log((counts[x][t] + 0.5) / (sum(counts[x].values()) + 0.5 * langid.FEATURES))
    text_log, first = {}, {}
    for i, text, *_ in rows:
        t = trigrams(text)
        if t:
            mean = [sum(log(x, v) for v in t) / len(t) for x in names]
            text_log[i] = [(m - max(mean)) * math.sqrt(len(t)) for m in mean]
            first[i] = names[int(np.argmax(mean))]
    host = {i: h or "" for i, _, _, h in rows}
    suffix = {i: h.split(".")[-1] if "." in h else "" for i, h in host.items()}
    base = [(sum(v == x for v in first.values()) + 1) / (len(first) + 3) for x in names]

    def smooth(keys, key, above, pull):
        own = [sum(keys[i] == key and first[i] == x for i in first) for x in names]
        return [(c + pull * p) / (sum(own) + pull) for c, p in zip(own, above)]

    of = {x: sum(first[i] == x and said[i] is not None for i in first) for x in names}
    for i, *_ in rows:
        if i not in first:
            assert got[i].reason == "no_text" and got[i].language is None and got[i].posterior is None
            continue
        prior = smooth(host, host[i], smooth(suffix, suffix[i], base, langid.SUFFIX_PULL), langid.HOST_PULL)
        total = [a + math.log(p) for a, p in zip(text_log[i], prior)]
        if said[i]:
            total = [v + math.log((sum(first[j] == x and said[j] == said[i] for j in first) + langid.DECLARED_PULL / 3) / (of[x] + langid.DECLARED_PULL)) for v, x in zip(total, names)]
        mass = [math.exp(v - max(total)) for v in total]
        assert got[i].text_language == first[i] and got[i].n_trigrams == len(trigrams(rows[i][1] if i < 400 else "a"))
        assert got[i].language == names[int(np.argmax(total))] and math.isclose(got[i].posterior, 1 / sum(mass), rel_tol=1e-4)
    right = [got[i].language == x for i, x in truth.items()]
    alone = [first[i] == x for i, x in truth.items()]
    wrongly = [got[i].language == x for i, x in truth.items() if said[i] not in (None, x) and len(rows[i][1].split()) > 8]
    assert sum(right) >= sum(alone) and sum(right) >= 0.95 * len(right) and all(wrongly) and wrongly
    assert got[400].language == "fr" and got[401].rejected


def test_language_of_pages(spark):
    html = '<!-- <html lang="xx"> --><HTML class="a" Lang=\'fr-CA\'><style>p{margin:0}</style><p>les &amp; des<br>dans<script>the and with</script></p></html>'
    pages = [(1, "https://A.example.fr:80/x", html), (2, None, None), (3, "no scheme", "plain <b>text</b> 1 < 2"), (3, "x://h", "")]
    got = [(r.doc_id, None if r.text is None else r.text.split(), r.lang, r.source) for r in langid.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()]
    assert got == [(1, ["les", "des", "dans"], "fr", "a.example.fr"), (2, None, None, ""), (3, ["plain", "text", "1", "<", "2"], "", ""), (3, [], "", "h")]
    rng = np.random.default_rng(53)
    made, truth = [], {}
    for i in range(120):  # one declaration in six is wrong
        truth[i] = lang = ("en", "fr")[i % 2]
        made.append((i, f"http://s{i % 7}.{('com', 'fr')[i % 2]}/{i}", f'<html lang="{lang if i % 6 else "en" if lang == "fr" else "fr"}"><p>{prose(rng, EN if lang == "en" else FR, 30)}</p></html>'))
    found = langid.identify(langid.page_evidence(spark.createDataFrame(made, "page_id long, url string, html string"))).collect()
    assert {r.doc_id: r.language for r in found} == truth and not any(r.rejected for r in found)
