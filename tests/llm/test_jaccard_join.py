import itertools
import random

import numpy as np
import pytest

from tessella.llm import jaccard_join
from tessella.llm.jaccard_join import Trie, components, links_in_block, ngram_set, op7_ngram_jaccard_join, similar_components
from tests.llm.conftest import edge_rows


def _set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def _brute(rows):
    sets = [(i, _set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((top(i), top(j)))
            parent[y] = x
    return sorted((i, len(s), top(i)) for i, s in sets)


def _families(seed, n_families=6, copies=14):
    """Copies with edits around the threshold, in chains, with a passage that all share."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("xyz") + str(rng.randrange(40))
    passage = [word() for _ in range(60)]
    rows, k = [], 0
    for f in range(n_families):
        text = [word() for _ in range(rng.choice((8, 40, 150, 300)))]
        if f % 2:
            text = text[: len(text) // 2] + passage + text[len(text) // 2 :]
        for _ in range(copies):
            own = list(text)
            for _ in range(rng.choice((0, 0, 1, 2, max(1, len(own) // 45), max(1, len(own) // 30)))):
                own[rng.randrange(len(own))] = word()
            rows.append((k, " ".join(own)))
            k += 1
            if rng.random() < 0.5:
                text = own
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed):
    rows = _families(seed)
    out = similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == _brute(rows)


def test_small_blocks_and_clusters(spark, monkeypatch):
    """The ways for frequent n-grams and large clusters give the same components."""
    for name, value in (("BLOCK", 4), ("CLUSTER", 8), ("FREQUENT", 64), ("PIECE", 5), ("COUNTED", 1000), ("LINKS", 20)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = _families(11, 8, 20)
    out = similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == _brute(rows)


def test_awkward_rows(spark, edge_dir, empty_dir):
    out = op7_ngram_jaccard_join(spark, edge_dir).collect()
    rows = [(i, t) for i, t, *_ in edge_rows() if i is not None]
    once = list(dict.fromkeys(rows))
    assert len(out) == len(edge_rows())
    assert sorted({(r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None}) == _brute(once)
    assert [(r.n_shingles, r.component_id) for r in out if r.doc_id is None] == [(26, None)]
    assert op7_ngram_jaccard_join(spark, empty_dir).collect() == []


def test_stretches_of_long_texts(monkeypatch):
    text = " ".join(f"w{i * i % 997}" for i in range(900))
    whole = ngram_set(text, 5)
    assert len(whole) == len(_set(text))
    monkeypatch.setattr(jaccard_join, "_STRETCH", 100)
    assert np.array_equal(ngram_set(text, 5), whole)
    assert np.array_equal(ngram_set("A  b\tC", 5), ngram_set("a b c", 5)) and len(ngram_set("é É", 5)) == 1


def test_trie_finds_what_comparing_finds():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 400, 120).astype(np.uint64))
    sets = [np.unique(np.where(rng.random(len(base)) < p, rng.integers(0, 400, len(base)), base).astype(np.uint64)) for p in np.linspace(0, 0.4, 60)]
    trie = Trie(np.zeros(0, np.uint64))
    for i, s in enumerate(sets):
        trie.insert(s, i)
    for s in sets:
        want = {i for i, x in enumerate(sets) if 100 * len(np.intersect1d(s, x)) >= 75 * len(np.union1d(s, x))}
        assert set(trie.similar(s, 75)) == want
    assert {tuple(sorted(x)) for x in links_in_block(sets[:2], [0, 0], 75)} == set()


@pytest.mark.parametrize("each", [100_000, 40])
def test_chains_are_one_component(spark, monkeypatch, each):
    monkeypatch.setattr(jaccard_join, "LINKS", each)
    links = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 900), (900, 1000), (7, 7)], "u long, v long")
    assert {r.u: r.v for r in components(links).collect()} == {**{i: 0 for i in range(1, 301)}, 1000: 900}


@pytest.mark.parametrize("cuts", [(64, 256), (2, 5)])
def test_array_tries_join_what_comparing_joins(monkeypatch, cuts):
    monkeypatch.setattr(jaccard_join, "CUTS", cuts)
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 300, size).astype(np.uint64)) for size in (6, 40, 150)]
    sets = []
    for k in range(90):
        own = base[k % 3]
        own = np.unique(np.where(rng.random(len(own)) < rng.random() * 0.3, rng.integers(0, 300, len(own)), own).astype(np.uint64))
        sets.append(own[rng.random(len(own)) > 0.1 * (k % 4)])
    sets += [sets[0], np.zeros(0, np.uint64)]
    roles = [k // 2 * 10**12 for k in range(len(sets))]
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if len(a) and len(b) and 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))}
    found = list(links_in_block(sets, roles, 75))
    assert set(found) <= want and all(roles[i] != roles[j] for i, j in found)

    def joined(links):
        group = list(roles)
        for i, j in links:
            group = [group[i] if g == group[j] else g for g in group]
        return {frozenset(i for i, h in enumerate(group) if h == g) for g in group}

    assert joined(found) == joined(want)
    trie = Trie(sets)
    for i, s in enumerate(sets):
        skip = rng.random(len(sets)) < 0.5
        assert set(trie.similar(s, 75, skip)) == {j for j in range(len(sets)) if (i, j) in want and not skip[j]}


def test_large_groups_of_near_copies_are_copied_as_a_whole(spark, monkeypatch):
    """Of 60 documents that share most of 40 n-grams, no n-gram sends its own copies; of a chain, each n-gram's two documents meet alone."""
    for name, value in (("BLOCK", 4), ("CLUSTER", 8)):
        monkeypatch.setattr(jaccard_join, name, value)
    near = [(g, d) for d in range(60) for g in range(40) if (d * 7 + g) % 11]
    chain = [(1000 + d + o, 1000 + d) for d in range(50) for o in (0, 1)]
    ks = {}
    for g, _ in near + chain:
        ks[g] = ks.get(g, 0) + 1
    own = spark.createDataFrame([(g, d, d, ks[g]) for g, d in near + chain if ks[g] > 1], "gram long, id long, c long, k long")
    rows = jaccard_join._blocks(own).collect()
    assert sum(r.id < 1000 for r in rows) <= 60 * 15
    assert sum(r.id >= 1000 for r in rows) <= 2 * 49
    blocks = {}
    for r in rows:
        blocks.setdefault((r.key, r.part), set()).add(r.id)
    met = {pair for b in blocks.values() for pair in itertools.combinations(sorted(b), 2)}
    assert {(a, b) for a, b in itertools.combinations(range(60), 2)} <= met
    assert {(a, a + 1) for a in range(1000, 1049)} <= met
