import random
import re
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docindex.llm import decontam, graph, ngram_join, substring
from docindex.llm.graph import components

from .helpers import EDGES, documents, saved


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n=140):
    """Texts with near copies at all distances, a passage that many share, and chains of edits."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(2000)
    passage = [word() for _ in range(40)]
    texts = [[word() for _ in range(rng.choice([1, 2, 3, 5, 6, 8, 17, 20, 60, 200, 300]))] for _ in range(n // 3)]
    while len(texts) < n:
        t = list(rng.choice(texts))
        for _ in range(rng.randrange(0, max(2, len(t) // 12))):
            at = rng.randrange(len(t) + 1)
            if rng.random() < 0.5:
                t[at:at] = [word()]
            elif len(t) > 1:
                del t[at : at + 1]
        if rng.random() < 0.15:
            t = t + passage
        texts.append(t)
    return [(i * 3 + 1, rng.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_brute_force(spark, tmp_path, seed):
    rows = corpus(seed) + EDGES
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.op6_ngram_join(spark, saved(tmp_path, documents(spark, rows))).collect()}
    assert got == brute_components(rows)


def test_join_with_large_groups(spark):
    rng = random.Random(9)
    base = ["b%d" % n for n in range(120)]
    rows = [(1000 + n, " ".join([*base[: n % 4], *base, f"own{n}", f"mine{n}"])) for n in range(80)]
    rows += [(n, " ".join(["c%d" % rng.randrange(900) for _ in range(60)] + base[:60])) for n in range(60)]  # share half a text, but aren't linked
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(documents(spark, rows)).collect()} == brute_components(rows)


def test_join_of_salted_buckets_and_blocks(spark, monkeypatch):
    """Common keys in parts, buckets in several blocks, blocks with more pairs than they may give."""
    rng = random.Random(19)
    base = ["b%d" % n for n in range(150)]
    rows = []
    for n in range(150):  # copies with edits all over: some are linked with a few others only
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = "w%d" % rng.randrange(10**6)
        rows.append((n, " ".join(t)))
    rows += [(500 + n, " ".join("c%d" % rng.randrange(10**6) for _ in range(80))) for n in range(40)]
    for name, value in (("SALTED", 7), ("BLOCK", 32), ("EACH", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_join_of_sets_with_one_digest(spark, monkeypatch):
    """Sets whose first digests agree by chance are told apart by the second ones."""
    real = ngram_join.class_ids
    monkeypatch.setattr(ngram_join, "class_ids", lambda s: (real(s)[0] % 5, real(s)[1]))
    rows = corpus(3, 40)
    docs = documents(spark, rows).select("doc_id", "text")
    survey = docs.sparkSession.createDataFrame([(0, i, *ngram_join.class_ids(s), len(s), b"") for i, t in rows for s in [ngram_join.Shingler()(t)]], "tag int, doc_id long, a long, b long, n long, sketch binary")
    own, classes, doubtful = ngram_join._classes(survey)
    assert doubtful == set(range(5)) and classes.where("lo <> hi").count() == 0
    assert own.select("cls", "n").distinct().count() >= classes.count() == len({frozenset(shingles(t)) for _, t in rows})


def test_join_repeats_nulls_and_nothing(spark):
    rows = [(2, "a b c d e f"), (1, "A B C D E F"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = sorted(ngram_join.link_components(documents(spark, rows)).collect(), key=str)
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got] == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (None, 0, None), (None, 2, 1)]
    assert ngram_join.link_components(documents(spark, [])).count() == 0
    kept = ngram_join.keep_one(documents(spark, rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None", "None"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=60), st.lists(st.integers(0, 40), min_size=1, max_size=60))
def test_linked_sets_share_a_key(a, b):
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**64, 41, np.uint64)
    x, y = (np.unique(pool[np.array(v)]) for v in (a, b))
    both = len(np.intersect1d(x, y))
    if 100 * both >= 75 * (len(x) + len(y) - both):
        none = np.zeros((1 << ngram_join.COMMON_BITS) // 8, np.uint8)
        some = none.copy()
        for own in pool[:20].tolist():
            place = own >> 64 - ngram_join.COMMON_BITS
            some[place >> 3] |= 1 << (place & 7)
        assert ngram_join.is_common(pool, some).tolist() == [1] * 20 + [0] * 21
        for common in (none, some):
            assert {*ngram_join.join_keys(x, common)[0].tolist()} & {*ngram_join.join_keys(y, common)[0].tolist()}
        one, two = (ngram_join.Sketches([ngram_join.dense_sketch(v)]) for v in (x, y))
        zero = np.zeros(1, np.int64)
        assert ngram_join._near(one.apart(two, zero, zero), np.array([len(x)]), np.array([len(y)]))[0][0]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(n, n + 1) for n in range(300, 340)] + [(500, 600 + n) for n in range(30)]
    root = {}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for start in sorted(near):
        todo = [start] if start not in root else []
        while todo:
            x = todo.pop()
            root[x] = start
            todo += [y for y in near[x] if y not in root]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in root.items() if k in got} == got and all(near[k] == {k} for k in root.keys() - got.keys())


def test_stars_need_no_step(spark, monkeypatch):
    made, real = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: made.append(name) or real(df, name))
    got = components(spark.createDataFrame([(1, 5), (1, 3), (9, 1), (20, 21), (7, 7)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (3, 1), (5, 1), (9, 1), (20, 20), (21, 20)]
    assert made == ["edges"]


def test_blocks_are_compared_twice_at_most(spark, monkeypatch):
    """What a tree of the closest pairs has left apart is compared in full, without a second tree."""
    rng, base = random.Random(19), ["b%d" % n for n in range(150)]
    rows = []
    for n in range(150):
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = "w%d" % rng.randrange(10**6)
        rows.append((n, " ".join(t)))
    made, real = [], ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: made.append(name) or real(df, name))
    monkeypatch.setattr(ngram_join, "EACH", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(documents(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert 1 <= made.count("late") <= 2


# Decontamination ----------------------------------------------------------------


def brute_tiles(doc, item, least):
    """Greedy string tiling by its definition: look for the longest unmarked match, mark, repeat."""
    di, ii = [False] * len(doc), [False] * len(item)
    covered = 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not di[i + k] and not ii[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least or not k:
            return covered
        di[i : i + k] = [True] * k
        ii[j : j + k] = [True] * k
        covered += k


def test_tiling_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.choice("abcdefg") for _ in range(rng.randrange(1, 14))]
        doc = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.5:
            cut = rng.randrange(len(item))
            doc[3:3] = item[cut:] + ["h"] + item[:cut]
        words = decontam._Words()
        got = decontam.tile(decontam._ids(" ".join(doc), words), decontam._ids(" ".join(item), words), 3)
        assert sum(t[2] for t in got) == brute_tiles(doc, item, min(3, len(item)))
        assert all(doc[i : i + n] == item[j : j + n] for i, j, n in got)


def test_leaks(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"so {item.upper()}, he said"), (2, "seven eight nine ten eleven twelve; one two three four five six"), (3, "one two three four five and then nothing"), (4, "clean words only")] + EDGES
    saved(tmp_path, documents(spark, rows))
    sf = saved(tmp_path, spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "tiny item"), (11, "日本語")], "item_id long, text string"), "benchmark")
    got = {(r["doc_id"], r["item_id"]): (r["n_tiles"], r["coverage"]) for r in decontam.op5_decontamination(spark, sf).collect()}
    assert got == {(1, 7): (1, 1.0), (2, 7): (2, 1.0), (906, 11): (1, 1.0)}
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert {r["doc_id"] for r in decontam.drop_leaks(docs, items).collect()} == {i for i, _ in rows} - {1, 2, 906}
    assert decontam.find_leaks(docs.limit(0), items).count() == 0 and decontam.find_leaks(docs, items.limit(0)).count() == 0


def test_tiling_of_repetitive_texts():
    words = decontam._Words()
    doc, item = decontam._ids("again " * 20_000, words), decontam._ids("again " * 15_000, words)
    assert decontam.tile(doc, item, 5) == [(0, 0, 15_000)]
    assert decontam.tile(item, doc, 5) == [(0, 0, 15_000)]
    mixed = decontam._ids("again and " * 9_000 + "again " * 2_000, words)
    assert sum(t[2] for t in decontam.tile(mixed, item, 5)) == 2_000


def test_many_items_share_a_seed(spark, monkeypatch):
    items = spark.createDataFrame([(f"i{n}", f"so what is the answer to t{n} u{n} v{n} w{n} x{n} y{n}") for n in range(12)] + [("i1", "so what is the answer to")], "item_id string, text string")
    rows = [(n, f"see what is the answer to t{n} u{n} v{n} w{n} x{n} y{n}") for n in range(12)] * 2 + [(None, "So what is the answer to you"), (None, None)]
    docs = documents(spark, rows)
    want = sorted([(str(n), f"i{n}") for n in range(12)] * 2 + [("None", f"i{n}") for n in [*range(12), 1]] + [(str(n), "i1") for n in range(12) if n != 1] * 2 + [("1", "i1")] * 2)
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.find_leaks(docs, items).collect()) == want
    monkeypatch.setattr(decontam, "MAP_BITS", 1 << 15)  # the map lets almost everything pass
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.find_leaks(docs, items).collect()) == want
    assert [r["text"] for r in decontam.drop_leaks(docs, items).collect()] == [None]


@pytest.mark.parametrize("coverage, part", [(0.5, 1000), (0.8, 2), (0.0, 3)])
def test_leaks_against_brute_force(spark, monkeypatch, coverage, part):
    monkeypatch.setattr(decontam, "PART", part)  # seeds are split
    rng = random.Random(part)
    lines = [" ".join(rng.choices("abcdefghij", k=rng.randint(4, 9))) for _ in range(6)]
    items = [" ".join(rng.choices(lines, k=rng.randint(0, 2)) + rng.choices("abcxyz", k=rng.randint(0, 9))) for _ in range(30)]
    items += [items[3], "a a a a a a a a a a a", None]
    docs = [" ".join(rng.choices([*lines, *filter(None, items), "q r s", "a a a a a"], k=rng.randint(0, 4))) for _ in range(60)]
    docs += [docs[5], None]
    words, want = decontam._Words(), []
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            found, n = decontam.tile(decontam._ids(doc, words), decontam._ids(item, words), 5), len(decontam._TOKENS(item or ""))
            covered = sum(t[2] for t in found)
            if covered and covered >= coverage * n:
                want.append((d, i, n, covered, sorted(found)))
    docs, items = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = decontam.find_leaks(docs, items, min_coverage=coverage).collect()
    assert len(want) > 50
    assert sorted((r["doc_id"], r["item_id"], r["item_tokens"], r["covered_tokens"], sorted(map(tuple, r["tiles"]))) for r in got) == want


def test_a_line_that_all_share_makes_no_pairs(spark, monkeypatch):
    """Rows grow with the leaks, not with documents times items."""
    rng = random.Random(5)
    line = "this text is under the common license"

    def text(k):
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(k))

    items = [(i, f"{text(7)} {line} {text(7)}") for i in range(1000)]
    docs = [(d, f"{text(9)} {line} {text(9)}") for d in range(10_000)] + [(20_000 + i, f"{text(5)} {items[i][1]}") for i in range(20)]
    made = {}

    def counted(df, name):
        out = materialize(df, name)
        made[name] = out.count()
        return out

    materialize = decontam.materialize
    monkeypatch.setattr(decontam, "materialize", counted)
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(20_000 + i, i) for i in range(20)]
    assert made["pairs"] == 20


# Substrings ---------------------------------------------------------------------


def as_bytes(text):
    return np.frombuffer(text.encode(), np.uint8)


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=400), st.text(max_size=200))
def test_borders(head, tail):
    b = as_bytes(head * 3 + tail)
    at = substring.borders(b).tolist()
    assert at == sorted({*at}) and at[0] == 0 and at[-1] == len(b)
    assert all(e - a <= substring.MOST for a, e in zip(at, at[1:], strict=False))


def test_borders_follow_the_text():
    rng = random.Random(1)
    body = " ".join("w%d" % rng.randrange(9999) for _ in range(400))
    cut = lambda t: {t[a:e] for at in [substring.borders(as_bytes(t)).tolist()] for a, e in zip(at, at[1:], strict=False)}
    plain, shifted = cut(body), cut("inserted words " + body)
    assert len(plain) > 40 and len(plain - shifted) <= 4
    assert len(cut("x" * 5000)) <= 4


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n\té—日本ก😀", max_size=40))
def test_words(text):
    raw = text.encode()
    found = [raw[a:e].decode() for a, e in zip(*substring.words(as_bytes(text)), strict=True)]
    assert found == re.findall(r"[日本ก😀]|[^ \n\t日本ก😀]+", text)


def longest_common(a, b):
    """Words of the longest run that two lists share, by the textbook table."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def test_passages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: ["w%d" % rng.randrange(99_999) for _ in range(n)]
    pool = [say(n) for n in (30, 40, *range(44, 56), 60, 75, 120)]
    rows = []
    for n in range(60):
        parts = [say(rng.randrange(1, 40))]
        for passage in rng.sample(pool, rng.randrange(3)):
            parts += [passage, say(rng.randrange(1, 30))]
        rows.append((n, sum(parts, [])))
    got = defaultdict(list)
    for r in substring.op3_substring_dedup(spark, saved(tmp_path, documents(spark, [(i, " ".join(w)) for i, w in rows]))).collect():
        got[r["doc_id"]].append(r)
    for i, own in rows:
        most = max((longest_common(own, other) for j, other in rows if j < i), default=0)
        assert bool(got[i]) == (most >= 51), (i, most)
        for r in got[i]:
            piece, source = own[r["first_word"] : r["first_word"] + r["n_words"]], dict(rows)[r["source_doc_id"]]
            assert r["source_doc_id"] < i and len(piece) == r["n_words"] == longest_common(piece, source)
            whole = " ".join(own)
            assert whole[r["start"] : r["end"]] in whole and r["end"] - r["start"] > 100


def test_repeats(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join("w%d" % rng.randrange(99_999) for _ in range(n))
    shared = say(60)
    rows = [(1, say(50) + " " + shared + " " + say(30)), (2, say(7) + " " + shared), (3, say(200)), (4, shared + " é " + say(10)), (5, say(3)), (6, shared[:60])]
    rows += EDGES[:6] + [(910, EDGES[6][1] + EDGES[5][1])] + [(n, EDGES[7][1]) for n in (930, 920, 940, 920)] + [(None, shared)]
    got = substring.op3_substring_dedup(spark, saved(tmp_path, documents(spark, rows))).collect()
    assert {(r["doc_id"], r["source_doc_id"]) for r in got} == {(2, 1), (4, 1), (920, 920), (930, 920), (940, 920)}  # 920 repeats itself
    assert all(r["n_words"] == 30_000 and r["end"] == 150_000 for r in got if r["doc_id"] > 920)
    docs = documents(spark, rows).withColumn("spans", F.lit(1)).withColumn("able", F.lit(2))
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    texts = dict(rows)
    assert all(kept[i] == texts[i] for i in (1, 3, 5, 6, 901, 902, 903, 904, 905, 906, 910)) and kept[940] == "" and texts[920].startswith(kept[920])
    assert len(kept[2].split()) < 8 and kept[4].endswith(texts[4][-20:])
    assert substring.find_passages(documents(spark, [])).count() == 0


@pytest.mark.parametrize(("letters", "least"), [((1, 2), 59), ((1, 3), 60), ((2, 4), 60), ((3, 8), 60)])
def test_passages_of_51_words(spark, letters, least):
    rng = random.Random(5)
    say = lambda n, a, b: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b))) for _ in range(n))
    rows, planted = [], {}
    for n in range(60):
        passage = say(51, *letters)
        for i in (n, 1000 + n):
            head = rng.randrange(1, 30)
            rows.append((i, f"{say(head, 4, 9)} {passage} {say(20, 4, 9)}"))
            planted[i] = head
    got = {r["doc_id"]: r for r in substring.find_passages(documents(spark, rows)).collect()}
    assert len(got) >= least and {*got} <= {*range(1000, 1060)}
    for i, r in got.items():
        assert r["source_doc_id"] == i - 1000
        own, other = (dict(rows)[k].split() for k in (i, i - 1000))
        a, b = planted[i], planted[i - 1000]
        while a and b and own[a - 1] == other[b - 1]:
            a, b = a - 1, b - 1
        n = 0
        while a + n < len(own) and b + n < len(other) and own[a + n] == other[b + n]:
            n += 1
        assert (r["first_word"], r["n_words"]) == (a, n)


@pytest.mark.parametrize("length", [45, 50, 51, 80, 700])
def test_nothing_unique_is_removed(spark, length):
    """Words of the passage go from the second document if there are 51 or more, no other ones ever."""
    rng = random.Random(length)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n))
    rows, want = [], {}
    for n in range(60):
        passage, head, tail = say(length), say(rng.randrange(1, 30)), say(20)
        rows += [(n, f"{say(9)} {passage} {say(9)}"), (1000 + n, f"{head} {passage} {tail}")]
        want[1000 + n] = f"{head} {tail}" if length > 50 else rows[-1][1]
    docs = documents(spark, rows, extra=False)
    found = substring.find_passages(docs).collect()
    assert len(found) == (60 if length > 50 else 0) and all(r["n_words"] == length for r in found)
    kept = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs).collect()}
    assert kept == {i: t for i, t in rows if i < 1000} | want


def test_long_tails(spark):
    """Far beyond the words that a unit knows bits of, where chunks lie differently in the two texts."""
    rng = random.Random(3)
    say = lambda n: " ".join("w%d" % rng.randrange(99_999) for _ in range(n))
    same, core = "a b " * 400, say(60)
    rows = [(1, f"{say(5)} {same}{core} {same}x"), (2, f"{say(9)} c {same}{core} {same}y")]
    (row,) = [r for r in substring.find_passages(documents(spark, rows)).collect() if r["doc_id"] == 2 and r["source_doc_id"] == 1 and r["n_words"] > 1000][:1] or [None]
    assert row is not None and (row["first_word"], row["n_words"]) == (10, 1660)


def test_units_whatever_the_white_space():
    words = [f"w{k * k % 977}x{k}" for k in range(120)]
    texts = [" ".join(words), "\n ".join(words) + "\n"]
    digests = [substring.Prefixes(0), substring.Prefixes(1)]
    every = np.full(substring.MAP_BITS // 8, 255, np.uint8)
    one, other = (substring._units(digests, t.encode(), every, substring.MIN_WORDS) for t in texts)
    assert one[0].tolist() == other[0].tolist() and one[4].tolist() == other[4].tolist()
    for a, e, b, f in zip(one[2], one[3], other[2], other[3], strict=True):
        assert texts[0][a:e].split() == texts[1][b:f].split()
    few = np.zeros_like(every)
    key = int(one[0][len(one[0]) // 2]) % substring.MAP_BITS
    few[key >> 3] = 1 << (key & 7)
    assert len(substring._units(digests, texts[0].encode(), few, 1)[0]) == 1
    assert substring._units(digests, texts[0].encode(), few, substring.MIN_WORDS) is None


def test_a_unit_with_very_many_repeats(spark):
    """All units go through one join, which makes a row for each repeat; Spark deals out those of one unit."""
    n = 60_000
    unit = lambda k: [f"{k} as key", "7L as check", "id as doc_id", "5L as start", "90L as end", "1L as first", "12L as last", "0L as before", "0L as after"]
    rows = spark.range(n).selectExpr(*unit("if(id % 3 = 0, 2 * id, 1L)")).unionByName(spark.range(n, n + 3000).selectExpr(*unit("3 * (id % 1000) + 10000000L")))
    small = {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "100000", "adaptive.advisoryPartitionSizeInBytes": "100000", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for k, v in small.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        some = substring.materialize(rows.repartition(16), "units")
        firsts = substring.materialize(substring._firsts(some), "firsts")
        got = substring._repeats(some, firsts)
        assert firsts.count() == 1001
        plan = got._jdf.queryExecution().toString()
        assert "Union" not in plan.split("== Physical Plan ==")[1]
        parts = {(r["key"], r["o"]["doc_id"], r["part"]): r["count"] for r in got.groupBy("key", "o", F.spark_partition_id().alias("part")).count().collect()}
    finally:
        for k in small:
            spark.conf.unset(f"spark.sql.{k}")
    hot = [c for (key, first, _), c in parts.items() if key == 1 and first == 1]
    assert sum(hot) == n * 2 // 3 - 1 and len(hot) > 1
    assert sum(parts.values()) == sum(hot) + 2000


def test_repeats_in_a_large_group(spark):
    """In a large group some documents share parts of words on both sides of the passage with others, so that units start and end within words; they repeat it, too."""
    every = iter(random.Random(4).sample(range(99_999), 20_000))  # no word is there twice but those of the passage
    say = lambda n: " ".join("w%d" % next(every) for _ in range(n))
    shared = say(60)
    rows = [(i, f"{say(3)} {shared} {say(4)}") for i in range(1500)] + [(9000 + i, say(70)) for i in range(50)]
    got = substring.find_passages(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(1, 1500)]
    assert all(r["source_doc_id"] < r["doc_id"] and (r["first_word"], r["n_words"]) == (3, 60) for r in got)


def test_shuffle_files_of_steps_go(spark):
    """Disk doesn't hang on when the driver collects its garbage: each step's shuffle files go when its table is there. Those that the caller made stay, and so do those of the result."""
    there = lambda: {p.name for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    rng = random.Random(5)
    text = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    shared = text(80)
    rows = [(i, f"{text(30)} {shared} {text(20)}") for i in range(40)]
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    docs = documents(spark, rows).repartition(3, "doc_id").persist()
    before = there()
    docs.write.format("noop").mode("overwrite").save()
    own = there() - before
    found = substring.find_passages(docs)
    until = time.time() + 20
    while (left := there() - before - own) and time.time() < until:  # Spark deletes them in the background
        time.sleep(0.2)
    assert not left
    assert own and own <= there()
    assert spark.conf.get(setting) == was
    first = sorted(found.collect())
    assert there() - before - own
    assert sorted(found.collect()) == first and [r["doc_id"] for r in first] == [*range(1, 40)]
    docs.unpersist()
    with pytest.raises(ZeroDivisionError), substring.brief_shuffles(spark):
        assert spark.conf.get(setting) == "true"
        _ = 1 / 0
    assert spark.conf.get(setting) == was
