"""What makes work grow faster than tables: one task for a whole file, code that doesn't compile, patterns tried many times."""

import pickle
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from papyra.functions import checkdigit as cd
from papyra.llm import decontam, passages
from papyra.operators import automaton
from papyra.operators.classify import Rule, Rules, _points
from papyra.operators.specialised import SCHENGEN, read_schengen
from papyra.plans import queries, tables, zone_queries
from papyra.plans.zone_queries import AS_OF

SF = "/root/testdata/sf0.001"


def test_rows_of_one_file_are_dealt(spark):
    least = tables.PARTS_A_CORE * spark.sparkContext.defaultParallelism
    assert zone_queries.keys(spark, SF).rdd.getNumPartitions() == least
    many = tables.spread(spark.range(0, (least + 3) * tables.PART_ROWS, 1, 1))
    assert many.rdd.getNumPartitions() == least + 3


def test_pages_of_a_case_are_not_shuffled_again(spark):
    plan = queries.verify_cases(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(case_id") == plan.count("REPARTITION_BY_NUM")


def test_check_digits_of_long_fields_are_short_code(spark):
    rows = spark.createDataFrame([("L898902C3<7408122<1204159ZE184226B<<<<<",)], "x string")
    got = rows.select(cd.check_digit(F.col("x"), 39).alias("d"), cd.check_digit(F.col("x")).alias("e"), cd.check_digit(F.lit(""), 9).alias("z"))
    worth = sum(max(cd.ALPHABET.find(ch), 0) * cd.WEIGHTS[i % 3] for i, ch in enumerate("L898902C3<7408122<1204159ZE184226B<<<<<"))
    assert tuple(got.first()) == (worth % 10, worth % 10, 0)
    assert len(got.select("d")._jdf.queryExecution().optimizedPlan().toString()) < 2_000


def test_patterns_are_tried_once(spark):
    rows = spark.createDataFrame([("UNTIL: 01/02/2027\nSURNAME: DOE.",)], "t string")
    found = read_schengen(rows, "t", AS_OF).select("record.*")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(SCHENGEN["validUntil"][0][:40]) <= 3  # found, and its group
    assert found.first()["validUntil"] == "2027-02-01"


def test_windows_find_what_the_automaton_finds(monkeypatch):
    monkeypatch.setattr(automaton, "LONG", 7)
    rng = random.Random(5)
    word = lambda lo, hi: "".join(rng.choices("abé ", k=rng.randint(lo, hi)))
    texts = [word(0, 60) for _ in range(40)] + ["", None, "a"]
    keywords = [word(1, 9) for _ in range(60)] + ["", "a", "a"]
    for own in (keywords, keywords[:3], [""], []):
        a, b = automaton.Automaton(own).found(texts), automaton.Windows(own).found(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_rules_of_any_number_of_bytes():
    words = [f"WORD {i:07d}" for i in range(200_000)]  # 2.4 MB
    rules = Rules(tuple(Rule(str(i), "c", "r", tuple(words[i : i + 10])) for i in range(0, len(words), 10)))
    assert [x[:2] for x in rules.ranked([f"a {words[25]} {words[24]} b"])[0]] == [(20, 2), (0, 0), (0, 1), (0, 3)]


def test_passages_meet_all_earlier_holders(spark):
    """Each stretch of a passage stands in many other texts too, so that its one whole holder is neither first nor among the last."""
    rng = np.random.default_rng(31)
    words = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    pieces = [words(8) for _ in range(8)]
    whole = lambda: [w for piece in pieces for w in piece + words(1)]  # noqa: E731  a word in nine differs
    texts = {50: whole(), 99: whole()}
    for n, piece in enumerate(pieces):
        texts |= {i: words(30) + piece + words(30) for i in (n, 10 + n, 60 + n, 70 + n, 80 + n)}
    rows = [(i, " ".join(words(20) + body + words(20))) for i, body in texts.items()]
    got = {(r.doc_id, r.other_id): r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(99, 50)} and (got[99, 50].start_word, got[99, 50].end_word) == (20, 91)


def test_further_matches_come_in_pieces(monkeypatch):
    """partners() and further() together meet every earlier document once, in pieces; parts of buckets keep two texts together."""
    rng = np.random.default_rng(32)
    h, ids, pos = np.sort(rng.integers(0, 9, 900)), rng.integers(0, 60, 900), rng.integers(0, 99, 900)
    at = defaultdict(lambda: defaultdict(list))
    for x, i, p in zip(h.tolist(), ids.tolist(), pos.tolist()):
        at[x][i].append(p)
    want = Counter((i, j, p, min(by[j])) for by in at.values() for i in by for j in by if j < i for p in by[i])
    monkeypatch.setattr(passages, "AT_ONCE", 100)
    parts = [passages.partners(h, ids, pos, 2), *passages.further(h, ids, pos, 2)]
    assert max(len(part[0]) for part in parts[1:]) == 100
    rows = np.concatenate(parts, axis=1)
    assert Counter(zip(*rows.tolist())) == want
    packer = passages.Packer(lambda x: np.zeros(len(x), dtype=np.int32))
    packed = [*packer.put(*rows[:, ::2]), *packer.flush(), *packer.put(*rows[:, 1::2]), *packer.flush()]
    parts = [part for part in passages._gathered(iter(packed), 4, 2) if part.shape[1]]
    pairs = [set(zip(*part[:2].tolist())) for part in parts]
    assert Counter(zip(*np.concatenate(parts, axis=1).tolist())) == want
    assert len(parts) > 9 and all(max(a) < min(b) for a, b in zip(pairs, pairs[1:]))


def test_readings_stop_at_the_first_that_is_valid(spark):
    rng = random.Random(33)
    rows = [("".join(rng.choice("O0I1B8S5Z2G6A7") for _ in range(9)), str(i % 10)) for i in range(400)] + [(None, "0"), ("", "0"), ("AAAA", "3")]
    text, digit = F.col("text"), F.col("digit")
    first = F.get(F.filter(cd.number_variants(text), lambda v: cd.validate(v["value"], digit)), F.lit(0))
    got = spark.createDataFrame(rows, "text string, digit string").select(first.alias("a"), cd.first_valid_variant(text, digit).alias("b")).collect()
    assert all(r.a == r.b for r in got) and any(r.a and r.a.corrections for r in got) and any(r.a is None for r in got)


def test_parts_stay_small(spark):
    """What a task holds at once stops growing with the table: no more than 10,000 rows of it."""
    dealt = tables.spread(spark.range(0, 400_000, 1, 1))
    assert dealt.rdd.getNumPartitions() == 40 and max(dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 10_100


def test_passages_meet_by_units():
    """What meets by units gives the chains that all matches of all places give, and a line in many documents meets nowhere."""
    rng = np.random.default_rng(33)
    words = lambda n: rng.integers(0, 1 << 40, n).tolist()
    lines, long, copy = [words(12) for _ in range(6)], words(60), words(150)
    texts = [words(40) + lines[0] + words(40) for _ in range(60)]  # a line alone
    texts += [words(30) + lines[k % 6] + words(k) + lines[k % 5] + lines[k % 5] + words(20) for k in range(40)]  # several near each other
    texts += [words(10) + long + words(k % 9 * 5) + (lines[k % 6] if k % 2 else words(9)) for k in range(20)]
    texts += [[w if rng.random() > 0.08 else words(1)[0] for w in copy] for _ in range(15)] + [[7] * (20 + k) + copy[k : k + 30] for k in range(9)]
    texts += [copy[k : k + 50] + lines[2] * (k % 4) + lines[k % 3] + copy[60:90] for k in range(12)]
    rng.shuffle(at := np.arange(len(texts)))
    seeds = [(hash(tuple(texts[t][p : p + 5])) & (1 << 47) - 1, int(i), p) for i, t in enumerate(at) for p in range(len(texts[t]) - 4)]
    h, ids, pos = (np.array(c, dtype=np.int64) for c in zip(*seeds))
    all_of = np.concatenate([passages.partners(h, ids, pos, 2), *passages.further(h, ids, pos, 2)], axis=1)
    places = passages.shared(h, ids, pos)
    met = np.concatenate(list(passages.meet(*passages.units(*places))), axis=1)

    def chained(rows: np.ndarray) -> list:
        packer = passages.Packer(lambda x: np.zeros(len(x), dtype=np.int32))
        return [r for b in passages._chained(iter([*packer.put(*rows), *packer.flush()])) for r in zip(*(c.to_pylist() for c in b.columns))]

    want, got = (chained(x) for x in (np.vstack([all_of, np.ones_like(all_of[:1])]), met))
    span = lambda r: (r[0], r[1], tuple(r[2]), tuple(r[3]))
    assert len(want) > 100 and {span(r) for r in want} <= {span(r) for r in got}
    whole = lambda r: r[2][-1] - r[2][0] + passages.KMER >= passages.LEAST_WORDS and all(q - p == r[3][0] - r[2][0] for p, q in zip(r[2], r[3]))
    assert all(whole(r) for r in got if span(r) not in {span(r) for r in want})  # copies that came with other seeds of the two texts
    assert met.shape[1] * 3 < all_of.shape[1]
    line = [(1, i, 40 + p) for i in range(500) for p in range(1)] + [(2 + p, i, 41 + p) for i in range(500) for p in range(7)]
    alone = passages.units(*passages.shared(*(np.array(c, dtype=np.int64) for c in zip(*line))))
    assert len(alone[0]) == 0


def test_windows_of_documents_are_not_sent_to_executors(spark):
    """A document may have many windows; only its key goes to all executors."""
    bench = spark.createDataFrame([(0, " ".join(f"w{j}" for j in range(20)))], "item_id long, text string")
    rows = [(i, " ".join([*(f"d{i}x{j}" for j in range(9)), *(f"w{j}" for j in range(20))]) if i % 3 else f"text {i} of few words here") for i in range(60)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = decontam.leaks(spark.createDataFrame([*rows, (None, rows[1][1])], "doc_id long, text string"), bench)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "row_key" in line]
    assert sent and all("LeftSemi" in line for line in sent) and "SortMergeJoin" in plan
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id, r.start_word, r.n_words) for r in got) == sorted([(i, 0, 9, 20) for i in range(60) if i % 3] + [(-1, 0, 9, 20)])


def test_many_hits_of_many_keywords_are_held_for_one_text_at_a_time():
    """Texts that have 2,000 keywords each: neither their pairs nor the rules as objects are held together."""
    words = [f"WORD {i:07d}" for i in range(20_000)]
    rules = Rules(tuple(Rule(str(i), "c", "r", tuple(words[i : i + 10])) for i in range(0, len(words), 10)))
    rng = random.Random(4)
    texts = [" ".join(rng.sample(words, 2_000)) for _ in range(300)]
    rules.ranked(texts[:1])
    tracemalloc.start()
    got = rules.ranked(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6 and len(pickle.dumps(rules)) < 150 * len(words) + 4e6
    for text, best in zip(texts[:20], got):
        has = set(text.split(" ")[1::2])
        found = [[k for k in words[i : i + 10] if k[5:] in has] for i in range(0, len(words), 10)]
        scores = sorted((-(sum(map(_points, f)) + 20 * (len(f) >= 3) + 25 * (len(f) >= 5)), i, f) for i, f in enumerate(found))[:4]
        assert best == [(-s, i, f) for s, i, f in scores]


def test_both_ways_rank_alike(monkeypatch):
    rng = random.Random(6)
    word = lambda lo, hi: "".join(rng.choices("ABC ", k=rng.randint(lo, hi))).strip()
    rules = tuple(Rule(str(i), "c", "r", tuple(word(1, 7) for _ in range(rng.randint(0, 6)))) for i in range(70))
    texts = [" ".join(word(0, 9) for _ in range(rng.randint(0, 8))) for _ in range(600)] + [None, ""]
    a = Rules(rules).ranked(texts)
    monkeypatch.setattr("papyra.operators.classify.MOST_BYTES", 0)
    assert a == Rules(rules).ranked(texts) and Rules(rules).rules == rules
    assert len(a) == len(texts) and all(len(r) == 4 for r in a)


def test_matches_come_in_rounds_of_documents(spark, monkeypatch):
    """Rounds are as many as matches need, together they match what one does, and what they shuffle is not left behind."""
    assert passages.rounds(0, 0) == passages.rounds(5, 9) == [(0, passages.SLICES)]
    many = passages.rounds(90, 20)
    assert len(many) == 5 and many[0][0] == 0 and many[-1][1] == passages.SLICES and all(a[1] == b[0] for a, b in zip(many, many[1:]))
    rng = np.random.default_rng(35)
    words = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    lines, long = [words(12) for _ in range(5)], words(70)
    texts = [words(10) + lines[k % 5] + words(3) + lines[k % 3] + [w if rng.random() > 0.05 else "x" for w in long] * (k % 4 > 0) for k in range(60)]
    seeds = [(hash(tuple(t[p : p + 5])) & (1 << 47) - 1, i, p) for i, t in enumerate(texts) for p in range(len(t) - 4)]
    units = passages.units(*passages.shared(*(np.array(c, dtype=np.int64) for c in zip(*seeds))))
    of = lambda x, y: Counter(zip(*np.concatenate(list(passages.meet(*units, some=(x, y))), axis=1).tolist()))
    assert sum((of(x, y) for x, y in many), Counter()) == of(0, passages.SLICES)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    one = {tuple(r) for r in passages.repeated_passages(docs).collect()}
    monkeypatch.setattr(passages, "rounds", lambda matches, seeds: many)
    assert one == {tuple(r) for r in passages.repeated_passages(docs).collect()} and len(one) > 20
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"
