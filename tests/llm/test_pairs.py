import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casewright.llm import jaccard
from casewright.llm.common import ascii_words, shingle_hashes, WordHashes
from casewright.llm.decontaminate import BLOCKS, RADIUS, SIMILAR, Matcher, find_leaks, simhash, window_prints, without_leaks, words_of

WORDS = [f"w{i}" for i in range(400)]


def table(spark, texts, ids=None):
    rows = list(zip(range(len(texts)) if ids is None else ids, texts))
    return spark.createDataFrame(rows, "doc_id long, text string")


def variants(rnd, n, copies, edits):
    """Texts of which some are copies of each other with a few words changed."""
    out = []
    while len(out) < n:
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(1, 120))]
        for _ in range(rnd.randint(1, copies)):
            own = list(words)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(len(own))] = rnd.choice(WORDS)
            out.append(" ".join(own))
    return out


def brute(texts, size, percent, ids=None):
    sets, ids = [], list(range(len(texts))) if ids is None else ids
    for t in texts:
        w = ascii_words(t)
        k = min(size, len(w))
        sets.append(set(zip(*(w[i:] for i in range(k)))) if k else set())
    label = list(ids)
    for _ in texts:
        before = list(label)
        for i in range(len(texts)):
            for j in range(i):
                same = ids[i] == ids[j]
                if same or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    return [(i, len(s), c) for i, s, c in zip(ids, sets, label)]


def groups(df, size, percent):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(df, size=size, percent=percent).collect())


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_groups_equal_brute_force(spark, size, percent):
    texts = variants(random.Random(size), 150, 5, 3) + ["", "  \t", "a", "a", "A b", "a  b", "x" * 50_000, "x" * 50_000]
    assert groups(table(spark, texts), size, percent) == brute(texts, size, percent)


def test_split_blocks_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    base = [rnd.choice(WORDS) for _ in range(100)]
    texts = []
    for i in range(60):
        own = list(base)
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(100)] = f"new{i}{rnd.random()}"
        texts.append(" ".join(own))
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 900)
    assert groups(table(spark, texts), 3, 90) == brute(texts, 3, 90)
    monkeypatch.setattr(jaccard, "LABEL_ROWS", 10)
    assert groups(table(spark, texts), 5, 80) == brute(texts, 5, 80)


def test_groups_edge_cases(spark):
    text = " ".join(WORDS[:30])
    df = spark.createDataFrame([(5, text, 1, "k"), (None, text, 2, "k"), (3, text, 3, "k"), (3, text, 3, "k"), (8, None, 4, "k")], "doc_id long, text string, id int, keys string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(df, size=3, percent=90).collect()), key=str)
    assert got == sorted([(5, 28, 3), (None, 28, 3), (3, 28, 3), (3, 28, 3), (8, 0, 8)], key=str)
    assert jaccard.near_groups(table(spark, []), size=3, percent=90).collect() == []


def test_copies_of_all(spark):
    text = " ".join(WORDS[:50])
    assert {r.component_id for r in jaccard.near_groups(table(spark, [text] * 300)).collect()} == {0}


def test_components(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    rnd.shuffle(chain)
    links = chain + [(100, 103), (103, 101), (200, 200)]
    got = {r.id: r.component for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == 0 for i in range(61)) and all(got.get(i, i) == 100 for i in (100, 101, 103)) and 200 not in got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=12), st.integers(50, 100))
def test_trie_links_what_is_similar(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    forest = jaccard.Forest(len(sets))
    jaccard.trie_join(arrays, percent, forest)
    expected = jaccard.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                expected.join(i, j)
    same = lambda f: [[f.root(i) == f.root(j) for j in range(len(sets))] for i in range(len(sets))]
    assert same(forest) == same(expected)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 5000), min_size=1, max_size=300), min_size=2, max_size=8), st.integers(50, 100))
def test_sketches_lose_no_link(sets, percent):
    sets = sorted(sets + [set(list(s)[: max(1, len(s) - 1)]) for s in sets[:3]], key=len)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    keep = jaccard.may_link(np.array([len(s) for s in sets]), [jaccard.sketch(a) for a in arrays], percent)
    for i, a in enumerate(sets):
        if any(100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets) if j != i):
            assert keep[i]


def test_prefixes_of_linked_sets_meet():
    rnd = random.Random(4)
    for _ in range(300):
        percent = rnd.choice([80, 90])
        a = sorted(rnd.sample(range(200), rnd.randint(1, 60)))
        b = sorted(set(a) - set(rnd.sample(a, min(len(a) - 1, rnd.randint(0, 4)))) | set(rnd.sample(range(200), rnd.randint(0, 3))))
        if 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b)):
            assert set(a[: jaccard.prefix_length(percent, len(a))]) & set(b[: jaccard.prefix_length(percent, len(b))])


def test_shingles_of_short_texts():
    h = WordHashes()
    assert len(shingle_hashes(h.of([]), 3)) == 0 and len(shingle_hashes(h.of([b"a", b"b"]), 3)) == 1
    assert shingle_hashes(h.of([b"a", b"b"]), 3)[0] != shingle_hashes(h.of([b"b", b"a"]), 3)[0]


# --- decontamination


def benchmark(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(9)
    items = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(6, 60))) for _ in range(40)] + ["", "one two", "... !!"]
    texts, planted = [], set()
    for i in range(120):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 300))]
        if i % 3 == 0:
            n = rnd.randrange(40)
            own = items[n].split()
            if i % 2 and len(own) > 45:
                own[rnd.randrange(len(own))] = "changed"
            at = rnd.randint(0, len(words))
            words[at:at] = own
            planted.add((i, n))
        texts.append(" ".join(words).upper() if i % 5 == 0 else ", ".join(words))
    got = {(r.doc_id, r.item_id): r for r in find_leaks(table(spark, texts), benchmark(spark, items)).collect()}
    assert set(got) == planted and all(r.similarity >= SIMILAR for r in got.values())
    for (i, n), r in got.items():
        window = words_of(texts[i])[r.first_word : r.first_word + r.n_words]
        assert r.n_words == len(words_of(items[n])) and len(set(window) & set(words_of(items[n]))) >= 0.9 * len(set(window))
    kept = {r.doc_id for r in without_leaks(table(spark, texts), benchmark(spark, items)).collect()}
    assert kept == set(range(120)) - {i for i, _ in planted}


def test_leaks_edge_cases(spark):
    long_item = " ".join(WORDS[:50])
    df = spark.createDataFrame([(None, f"x {long_item} y", 1), (1, None, 2), (2, "", 3), (3, "one two", 4), (3, "one two", 4), (4, "a " * 30_000 + long_item, 5), (5, " ".join(WORDS[:30]), 6)], "doc_id long, text string, item_id int")
    got = sorted((str(r.doc_id), r.item_id) for r in find_leaks(df, benchmark(spark, [long_item, "one two", None])).collect())
    assert got == [("3", 1), ("3", 1), ("4", 0), ("None", 0)]
    assert find_leaks(df, benchmark(spark, [])).collect() == [] and find_leaks(df.limit(0), benchmark(spark, ["x"])).collect() == []
    assert without_leaks(df, benchmark(spark, [long_item, "one two"])).columns == df.columns


def test_benchmark_in_slices(spark, monkeypatch):
    import casewright.llm.decontaminate as d

    items = [" ".join(WORDS[i : i + 20]) for i in range(0, 200, 20)]
    monkeypatch.setattr(d, "SLICE_ITEMS", 4)
    got = {(r.doc_id, r.item_id) for r in find_leaks(table(spark, items), benchmark(spark, items)).collect()}
    assert got == {(i, i) for i in range(10)}
    texts = [*items, "nothing of it", "", None]
    assert [r.doc_id for r in without_leaks(table(spark, texts), benchmark(spark, items[:9])).orderBy("doc_id").collect()] == [9, 10, 11, 12]


def test_index_finds_all_within_the_radius():
    rnd = np.random.default_rng(3)
    m = Matcher([(i, " ".join(WORDS[i : i + 9])) for i in range(300)])
    for f in m.prints[:40]:
        for flips in (0, 5, RADIUS, RADIUS + 1):
            q = f
            for b in rnd.choice(64, flips, replace=False):
                q = q ^ (np.uint64(1) << np.uint64(b))
            expected = np.flatnonzero(np.bitwise_count(m.prints ^ q) <= RADIUS)
            windows, found = m.within_radius(np.array([q, ~q]), np.arange(300))
            assert found[windows == 0].tolist() == expected.tolist()
    assert 64 % BLOCKS == 0


def test_windows_have_the_fingerprints_of_their_shingles():
    rnd = np.random.default_rng(5)
    h, weight = rnd.integers(0, 1 << 63, 60).astype(np.uint64), rnd.integers(1, 40, 60).astype(np.float32)
    for size in (1, 7, 60):
        assert window_prints(h, weight, size).tolist() == [simhash(h[i : i + size], weight[i : i + size]) for i in range(61 - size)]


def test_leaks_equal_the_similarity_of_all_windows(monkeypatch):
    """Passages with ever more changed words, against the weighted similarity of every window with every item."""
    rnd = random.Random(12)
    items = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(5, 50))) for _ in range(200)]
    m, compared = Matcher(list(enumerate(items))), []
    within = Matcher.within_radius
    monkeypatch.setattr(Matcher, "within_radius", lambda self, f, i: compared.append(len(f) * len(i)) or within(self, f, i))
    weights = lambda w: {tuple(w[i : i + 5]): sum(map(len, w[i : i + 5])) for i in range(max(1, len(w) - 4))}
    sets = [weights(words_of(t)) for t in items]
    expected, got, near, windows = 0, 0, 0, 0
    for n in range(150):
        own = items[n].split()
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(own))
            own[at : at + 1] = rnd.choice([[], ["changed"], [own[at], "more"]])
        words = [rnd.choice(WORDS) for _ in range(30)] + own + [rnd.choice(WORDS) for _ in range(30)]
        words = words_of(" ".join(words))
        best = {}
        for i, x in enumerate(sets):
            size = len(words_of(items[i]))
            windows += len(words) - size + 1
            for at in range(len(words) - size + 1):
                y = weights(words[at : at + size])
                if not x.keys().isdisjoint(y):
                    best[i] = max(best.get(i, 0), 2 * sum(x[s] for s in x if s in y) / (sum(x.values()) + sum(y.values())))
        found = m.leaks(words, WordHashes())
        near += sum(v >= SIMILAR for v in best.values())
        for i, (alike, _, _) in found.items():
            assert alike == pytest.approx(best[i]) and alike >= SIMILAR
        expected += sum(v >= SIMILAR for v in best.values())
        got += len(found)
    assert expected > 60 and got >= 0.99 * expected
    assert sum(compared) < 0.02 * windows  # of all windows with all items
