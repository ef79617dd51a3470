"""Quality rules, phrases and conversation repair against brute force; rows that share ids, and results kept apart."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import lines, packing, phrases, pipeline, repair, rules
from papyra.llm.common import collecting

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in BLANKS.split(text or "") if w]


# --- quality rules

TEXTS = [
    None, "", " \n\t", "one", "a # b $ c", "x\nx\n x\nx\n\n\n", "ä ö ü   é #", "a b c d e f g h " * 4, "a b c d e f g h i a b c d e f g h", "a " * 30,
    "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w2 w3 w4 w5 w6 w7 w8 w9", "tab\tvt\x0bff\x0ccr\rend", "| | | | <b> & %", "line\nline \nline\n\n line",
]


def counts_by_hand(text):
    words, text = words_of(text), text or ""
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), len(lines), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("text", TEXTS)
def test_counts_of_texts(text):
    assert rules.counts(text) == counts_by_hand(text)


def test_counts_of_random_texts():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "ß"]) for _ in range(rng.randrange(150)))
        assert rules.counts(text) == counts_by_hand(text)


def bucket(v):
    cut = max(v.bit_length() - rules.SKETCH_BITS, 0)
    return v >> cut << cut


def judged_by_hand(rows, least_docs):
    value = {
        "word_length": lambda c: 1000 * c[1] // c[0],
        "symbols": lambda c: 10000 * c[2] // c[0],
        "dup_lines": lambda c: 10000 * c[4] // c[3],
        "repeated": lambda c: 10000 * c[5] // c[0],
    }
    groups = defaultdict(list)
    counted = [(lang or "und", source or "", counts_by_hand(text)) for _, text, lang, source in rows]
    for lang, source, c in counted:
        if c[0]:
            for m, f in value.items():
                for g in ((lang, source), (lang,), ()):
                    groups[g, m].append(bucket(f(c)))

    def fence(g, m, spreads):
        v = sorted(groups[g, m])
        q = lambda p: v[-(-len(v) * p // 100) - 1]
        s = max(q(75) - q(25), rules.MEASURES[m][1])
        return q(25) - spreads * s, q(75) + spreads * s

    out = []
    for lang, source, c in counted:
        failed = []
        for m, f in value.items():
            if not c[0]:
                continue
            wide = (lang,) if len(groups[(lang,), m]) >= least_docs else ()
            low, high = fence(wide, m, rules.NEAR)
            if len(groups[(lang, source), m]) >= least_docs:
                near, far = fence((lang, source), m, rules.NEAR), fence(wide, m, rules.FAR)
                low, high = max(near[0], far[0]), min(near[1], far[1])
            if f(c) > high or (rules.MEASURES[m][2] and f(c) < low):
                failed.append(m)
        base = c[0] < 20 or 100 * c[5] > 30 * c[0]
        out.append((*c, base, tuple(failed), not base and not failed))
    return out


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(8)
    rows = []
    for i in range(260):
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), ("fr", "a"), (None, None), ("de", "rare")])
        n = rng.randrange(15, 60)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 4 if source == "b" else 12))) for _ in range(n)]
        if rng.random() < 0.1:
            words = [w + "###$" for w in words]
        if rng.random() < 0.05:
            words = words[:9] * 4
        rows.append((i, " ".join(words) if rng.random() < 0.8 else "\n".join(words[:5] * 6), lang, source))
    rows += [(300 + i, t, "en", "a") for i, t in enumerate(TEXTS)] + [rows[0], rows[0], (None, rows[1][1], "en", "b"), (400, "word " * 9000, "en", "b")]
    return rows


@pytest.mark.parametrize("least_docs", [1, 40, 10**6])
def test_rules_equal_fences_by_hand(spark, mixed, least_docs):
    docs = spark.createDataFrame(mixed, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in ("n", "bucket", "id", "failed", "n_words", "fences")}).repartition(5)
    found = rules.judge(docs, least_docs=least_docs).collect()
    got = Counter((r.doc_id, *(r[c] for c in rules.COUNTS), r.base_failed, tuple(r.failed), r.kept) for r in found)
    assert got == Counter((row[0], *x) for row, x in zip(mixed, judged_by_hand(mixed, least_docs)))
    kept = rules.keep_good(docs, least_docs=least_docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(x[0] for x in got.elements() if x[-1])


def test_sketches_merge_in_any_order(spark, mixed):
    docs = spark.createDataFrame(mixed, "doc_id long, text string, lang string, source string")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), rules.counted(F.col("text")).alias("c")).select("lang", "source", "c.*")
    whole = rules.sketches(rows, ["lang"])
    parts = rules.sketches(rows.where("n_words < 30"), ["lang", "source"]).unionByName(rules.sketches(rows.where("n_words >= 30"), ["lang", "source"]))
    assert sorted(map(tuple, rules.merged(parts, ["lang"]).collect())) == sorted(map(tuple, whole.collect()))


# --- phrases


def phrases_by_hand(rows, least, top, most=5):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            for k in range(1, most + 1):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    out = []
    for lang in n:
        found = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            cuts = [(int(Fraction(1000 * a * n[lang], f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p))]
            s, k = min(cuts)
            scored.append((-s, -a, " ".join(p).encode(), lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], s))
        out += [(lang, i + 1, *x[4:]) for i, x in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "shard", "log2"), [(3, 2000, 4_000_000, 27), (2, 7, 50, 27), (4, 2000, 300, 15)])
def test_phrases_equal_counts_by_hand(spark, monkeypatch, least, top, shard, log2):
    rng = random.Random(least)
    rows = []
    for i in range(120):
        text = "".join(rng.choice(["a", "B", "é", "cc", "a a"]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "   "]) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "fr", None])))
    rows += [(None, "en"), ("", "en"), ("...", "xx"), ("a " * 3000, "en"), rows[0], rows[0]]
    monkeypatch.setattr(phrases, "SHARD", shard)
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("n", "ids", "word", "a", "score")}).repartition(3)
    got = sorted(tuple(r) for r in phrases.mine_phrases(docs, top=top, least=least, filter_log2=log2).collect())
    assert got == phrases_by_hand(rows, least, top)


def test_scores_beyond_64_bits(spark):
    a, n, l, r = 9 * 10**12, 8 * 10**15, 10**13, 10**13 + 7
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    found = spark.createDataFrame([("en", [1], l), ("en", [2], r), ("en", [1, 2], a)], "lang string, ids array<long>, n long")
    assert phrases.score(totals, found).first()["score"] == 1000 * a * n // (l * r)


def test_bitmaps_equal_sets():
    rng = np.random.default_rng(2)
    for most in (70, 500, 100_000):
        x, y = (np.unique(rng.integers(0, most, int(rng.integers(0, 300)))) for _ in range(2))
        a, b = phrases.Bitmap.of(x), phrases.Bitmap.of(y)
        both = a.shifted() & b
        want = sorted({int(v) + 1 for v in x} & {int(v) for v in y})
        assert sorted(both.positions()) == want and both.popcount() == len(want) and a.shifted().popcount() == len(x)


def test_filters_hold_all_their_hashes(spark):
    rng = np.random.default_rng(4)
    h = rng.integers(-(2**63), 2**63, 3000, dtype=np.int64)
    for log2 in (15, 20):
        f = phrases.BitFilter.of(spark.createDataFrame([(int(x),) for x in h], "h long"), "h", log2)
        assert f.has(h.view(np.uint64)).all() and all(f.one(int(x)) for x in h.view(np.uint64)[:50])
        others = rng.integers(0, 2**63, 5000, dtype=np.int64).view(np.uint64)
        assert f.has(others).mean() < 3 * 3000 / 2**log2


# --- conversations


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) of one conversation by trying all edits, of at most three insertions in a row."""
    seen, flaws = set(), []
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        flaws.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {}

    def fits(initials):
        return re.fullmatch("(s?(ua)+)?", initials) is not None

    def begins(initials):
        return any(fits(initials + x) for x in ("", "a", "ua"))

    # states: (row, initials so far up to the grammar's memory) with the least (cost, audit)
    states = {"": (0, "", ())}

    def insert(states):
        for _ in range(3):
            for initials, (cost, audit, made) in list(states.items()):
                for role in ("user", "assistant"):
                    new = reduced(initials + role[0])
                    if new is not None:
                        offer(states, new, (cost + 5, audit + "I", (*made, f"{role}:")))
        return states

    def reduced(initials):
        if not begins(initials):
            return None
        return initials if len(initials) < 3 else {"u": "u", "a": "ua"}[initials[-1]]

    def offer(states, key, value):
        if key not in states or value[:2] < states[key][:2]:
            states[key] = value

    insert(states)
    for (_, _, role, text), flaw in zip(rows, flaws):
        new = {}
        for initials, (cost, audit, made) in states.items():
            offer(new, initials, (cost + 2, audit + "D", made))
            if flaw not in ("b", "d"):
                for edit, now, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    to = reduced(initials + now[:1]) if now[:1] in ("s", "u", "a") else None
                    if to is not None:
                        offer(new, to, (cost + price + 5 * (flaw == "t"), audit + edit, (*made, f"{now}:{text}")))
        states = insert(new)
    cost, audit, made = min((v for k, v in states.items() if fits(k)), key=lambda v: v[:2])
    return flaws, cost, audit, made


def report_by_hand(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        flaws, cost, audit, made = cheapest(own)
        turns = {r[1] for r in own} - {None}
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(own)]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, flaws.count("b"), flaws.count("d"), flaws.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(12)
    rows = []
    for conv in [*range(250), None]:
        for turn in range(rng.randrange(1, 8)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "no", "Why?", " \n", "", None, "a b\n", "So!\t ", "c\x0b", "long one. and more", "é."])
            rows.append((conv, rng.choice([turn, turn, turn, 2 * turn, None]), role, text))
    return [*rows, *rows[:3]]


def test_repairs_equal_all_edits_tried(spark):
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "copy", "gone", "seen", "fault")}).repartition(4)
    found = repair.edits(repair.damage(table))
    got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair.report(found).collect()}
    assert got == report_by_hand(rows)
    left = defaultdict(list)
    for r in sorted(repair.repaired(found).collect(), key=lambda r: r.turn):
        assert r.turn == len(left[r.conv])
        left[r.conv].append(f"{r.role}:{r.text}")
    empty = hashlib.sha256(b"").hexdigest()
    for conv, x in got.items():
        assert x[-1] == (hashlib.sha256("\n".join(left[conv]).encode()).hexdigest() if left[conv] else empty)


def test_a_conversation_of_many_batches(spark):
    rows = [(7, i, ("user", "assistant", "assistant")[i % 3], f"t{i}.") for i in range(20_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv: tuple(r[1:]) for r in repair.report(repair.edits(repair.damage(table))).collect()} == report_by_hand(rows)


def test_new_operators_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert rules.judge(docs).count() == 0 and rules.keep_good(docs).count() == 0
    assert phrases.mine_phrases(docs).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = repair.edits(repair.damage(turns))
    assert repair.report(found).count() == 0 and repair.repaired(found).count() == 0


# --- rows that share ids, and results of others


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(i, "boiler line\nown words %d" % i, f"site{i}") for i in range(13)]
    rows += [(500, "boiler line\nz", "a"), (500, "unique first\nz2", "a"), (None, "boiler line\nn", "a"), (None, "another first\nn2", "b"), (None, None, "a")]
    got = {(r.doc_id, r.text): r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()}
    want = {(i, "own words %d" % i): 1 for i in range(13)}
    # the null id sorts first, so that its line is the one that stays
    want |= {(500, "z"): 1, (500, "unique first\nz2"): 0, (None, "boiler line\nn"): 0, (None, "another first\nn2"): 0, (None, None): 0}
    assert got == want


def test_the_pipeline_leaves_results_of_others_alone(spark, tmp_path):
    rng = np.random.default_rng(1)
    en = "the and with that from this have were their which about there would could other people after first water".split()
    docs = [(i, " ".join(rng.choice(en, 60)) + f" own{i} word{i}.", "en", f"src{i % 4}", 0) for i in range(40)] + [(99, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "some item of a benchmark that nobody copied here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    with collecting() as made:
        lazy = lines.dedup_lines(spark.read.parquet(str(tmp_path / "documents.parquet")))
    packed = pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in packed.collect()}
    assert ids and ids <= set(range(40)) and lazy.count() == 41 and any(s.held for s in made)
    for s in made:
        s.free()
    assert not any(s.held or s.tables for s in made) and packed.count()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(str(tmp_path / "empty/documents.parquet"))
    spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(str(tmp_path / "empty/benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_a_filling_is_not_dominated_by_its_own_pieces():
    counts = np.zeros(2049, dtype=np.int64)
    counts[[300, 400, 700]] = 1
    assert packing.fillings(counts, 1400, 12)[0] == (700, 400, 300)
    counts[700] = 2  # a second one is at hand, and does replace the two
    assert (700, 400, 300) not in packing.fillings(counts, 1399, 12) and packing.fillings(counts, 1400, 12) == [(700, 700)]
