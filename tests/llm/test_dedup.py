"""Exact, near and substring duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import exact_dedup, jaccard_join, suffix_repeats
from tessera.llm.components import components

from .cases import empty, frame, odd, some, words_of


# Exact


def exact_truth(rows):
    groups = defaultdict(list)
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for d, t in rows:
        groups[plain(t)].append(d)
    out = []
    for d, t in rows:
        own = groups[plain(t)]
        keep = min((x for x in own if x is not None), default=None)
        out.append((d, keep, len(own), d == keep, hashlib.sha256(plain(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("trie_bytes", [exact_dedup.TRIE_BYTES, 2000])
def test_exact(spark, monkeypatch, trie_bytes):
    whole = exact_dedup.owners
    monkeypatch.setattr(exact_dedup, "owners", lambda docs: whole(docs, trie_bytes))
    copies = [(k, "a  b\n c" if k % 2 else "a b c") for k in range(60)] + [(100, "a b c "), (101, "abc")]
    for docs in (some(spark), odd(spark), frame(spark, copies).repartition(7)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted((tuple(r) for r in exact_dedup.decide(docs).collect()), key=repr) == exact_truth(rows)
        kept = exact_dedup.deduplicate(docs)
        assert kept.columns == docs.columns
        assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows})
    assert exact_dedup.decide(empty(spark)).count() == 0


def test_trie():
    rng, trie, want = random.Random(1), exact_dedup.Trie(), {}
    for k in range(2000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        trie.insert(key, k % 97, 1)
        low, n = want.get(key, (99, 0))
        want[key] = (min(low, k % 97), n + 1)
    part = {k: (o, n) for k, o, n in trie.pop_subtree()}
    rest = {k: (o, n) for k, o, n in trie.drain()}
    assert part and not set(part) & set(rest) and part | rest == want and trie.size == 0


# Near


def near_truth(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = words_of(t)
        sets[d] = ({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)}) if w else set()
    parent, index = {d: d for d in sets}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = Counter(e for g in s for e in index[g])
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for g in s:
            index[g].append(d)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def families(seed):
    """Hubs with spokes, chains, sizes that differ."""
    rng, vocabulary, rows = random.Random(seed), [f"w{i}" for i in range(300)], []
    for family in range(9):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 23, 25, 61, 120]))]
        now = base[:]
        for _ in range(60):
            w = (now if family % 3 == 0 else base)[:]
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
                j, r = rng.randrange(len(w)), rng.random()
                if r < 0.5:
                    w[j] = rng.choice(vocabulary)
                elif r < 0.75 and len(w) > 3:
                    del w[j]
                else:
                    w.insert(j, rng.choice(vocabulary[:5]))
            now = w
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return [*enumerate(rows), (5000, None), (5001, ""), (5002, "One"), (5003, "oNe")]


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 70)])
def test_near(spark, words, percent):
    rows = families(words)
    out, links = jaccard_join.join(frame(spark, rows).repartition(4), words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == near_truth(rows, words, percent)
    assert links.columns == ["a", "b"]


def test_near_with_joins_instead_of_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard_join, "SPOKES", 3)
    rows = families(8)
    out, _ = jaccard_join.join(frame(spark, rows), 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == near_truth(rows, 3, 90)


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_near_in_large_groups(spark, monkeypatch, words, percent):
    """Signatures of many nodes are left out where they can be, and nodes of one
    centre are too many for a task."""
    monkeypatch.setattr(jaccard_join, "GROUP", 3)
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    line = " ".join(f"line{k}" for k in range(25))
    rows = families(5) + [(9000 + k, f"{line} {t}") for k, (_, t) in enumerate(families(7)[:200])]
    out, _ = jaccard_join.join(frame(spark, rows), words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == near_truth(rows, words, percent)


def test_sketches_bound_differences():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64) * np.uint64(2) for _ in range(2))
        b = np.unique(np.concatenate([b, a[: rng.integers(0, len(a) + 1)]]))
        a = np.unique(a)
        x, y = jaccard_join.sketch(a), jaccard_join.sketch(b)
        size = min(len(x), len(y))
        bound = int(np.bitwise_count(jaccard_join.folded(x, size) ^ jaccard_join.folded(y, size)).sum())
        assert bound <= len(np.setxor1d(a, b))


def test_near_on_documents_and_odd_rows(spark):
    docs = some(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    truth = near_truth(rows, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs)[0].collect()} == truth
    stay = jaccard_join.deduplicate(docs)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {d for d, (_, c) in truth.items() if c == d}
    given = [(r.doc_id, r.text) for r in odd(spark).collect()]
    out = jaccard_join.join(odd(spark), 3, 90)[0].collect()
    assert len(out) == len(given)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == near_truth([x for x in given if x[0] is not None], 3, 90)
    assert jaccard_join.join(empty(spark))[0].count() == 0


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_schemes_cover_all_partners(percent):
    for s in [*range(1, 200), 1000, 5001]:
        own = set(jaccard_join.schemes(s, percent))
        for r in range(-(-s * percent // 100), s + 1):
            meet = own & set(jaccard_join.schemes(r, percent))
            differ = (r + s) * (100 - percent) // (100 + percent)
            assert any(2 * m.deleting + m.exact > differ for m in meet), (r, s)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for e in links if e[0] != e[1] for x in e if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Substrings


def substring_truth(rows, least):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + least] for i in range(len(b) - least + 1))
    out = []
    for d, t in rows:
        b, end = (t or "").encode(), 0
        mark = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                mark[max(i, end) : i + least] = b"\1" * (i + least - max(i, end))
                end = i + least
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((d, len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(90) for _ in range(4)]
    rows = []
    for k in range(90):
        t = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randrange(0, 100)
            t += s[a : a + rng.choice([100, 399, 400, 401, 500])] + text(rng.randint(0, 40))
        rows.append((k, t))
    rows += [(200, "ab" * 700), (201, "z" * 399), (202, "y" * 400), (203, "x" * 401), (204, None), (205, ""), (206, rows[3][1]), (207, "é" * 300)]
    return rows


@pytest.mark.parametrize("group", [1000, 2])
def test_repeats(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_repeats.repeats, "__defaults__", (400, 64, group))
    for docs in (frame(spark, passages(1)).repartition(4), some(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted((tuple(r) for r in suffix_repeats.dig(docs).collect()), key=repr) == substring_truth(rows, 400)


def test_repeats_with_joins_instead_of_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(suffix_repeats, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(suffix_repeats, "CHUNK", 500)
    rows = passages(2)
    assert sorted((tuple(r) for r in suffix_repeats.dig(frame(spark, rows)).collect()), key=repr) == substring_truth(rows, 400)


def test_repeats_of_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect() if r.doc_id != 6]
    docs = odd(spark).where("doc_id IS NULL OR doc_id != 6")
    assert sorted((tuple(r) for r in suffix_repeats.dig(docs).collect()), key=repr) == substring_truth(rows, 400)
    assert suffix_repeats.dig(empty(spark)).count() == 0


def test_remaining_text(spark):
    docs = frame(spark, passages(1))
    left = {r.doc_id: r.text for r in suffix_repeats.deduplicate(docs).collect()}
    truth = {r[0]: r for r in substring_truth(passages(1), 400)}
    for d, t in passages(1):
        if truth[d][2] == 0:
            assert left[d] == t
        else:  # what is left may keep parts of characters at the cuts
            assert 0 <= len((left[d] or "").encode()) - (truth[d][1] - truth[d][2]) <= 2 * truth[d][3]


def test_interval_tree():
    rng = random.Random(6)
    for _ in range(200):
        members = list({(bytes(rng.choice(b"ab") for _ in range(rng.randint(4, 14))), 3) for _ in range(rng.randint(2, 9))})
        members = [(m, a) for m, a in members if len(m) > a]
        got = suffix_repeats.group_repeats(members, 5)
        for i, (m, a) in enumerate(members):
            marks = set()
            for j, (o, b) in enumerate(members):
                if i != j:
                    right = next((k for k in range(min(len(m) - a, len(o) - b)) if m[a + k] != o[b + k]), min(len(m) - a, len(o) - b))
                    left = next((k for k in range(min(a, b)) if m[a - 1 - k] != o[b - 1 - k]), min(a, b))
                    if right > 0 and left + right >= 5:
                        marks |= set(range(-left, right))
            assert set().union(*(range(x, y) for x, y in got[i])) == marks if got[i] or marks else True
    assert sorted(suffix_repeats.intervals([2, 3, 0, 1])) == [(0, 0, 4), (1, 3, 4), (2, 0, 2), (3, 1, 2)]


def shared_rims(seed, n=60):
    """A passage that many rows hold whole or in part, in contexts that differ."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage = text(170)[:560]
    rows = []
    for k in range(n):
        a = rng.choice([0, 0, 1, 7, 30, 90, 150])
        b = rng.choice([0, 0, 1, 5, 20, 80, 160])
        rows.append((k, text(rng.randint(1, 30)) + passage[a : len(passage) - b] + text(rng.randint(1, 30))))
    return [*rows, (900, rows[0][1]), (901, rows[0][1] + "!")]


@pytest.mark.parametrize("group", [1000, 4])
def test_repeats_in_groups_split_on_longer_prefixes(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_repeats.repeats, "__defaults__", (400, 64, group))
    rows = shared_rims(3)
    assert sorted((tuple(r) for r in suffix_repeats.dig(frame(spark, rows).repartition(4)).collect()), key=repr) == substring_truth(rows, 400)


@pytest.mark.parametrize("group", [1000, 4])
def test_repeat_groups(spark, group):
    """Every place of a repeat has the same bytes, no place is left out, and the
    places cover what occurs twice."""
    rows = passages(4) + [(1000 + d, t) for d, t in shared_rims(5, 30)]
    texts = {d: (t or "").encode() for d, t in rows}
    groups = defaultdict(set)
    for r in suffix_repeats.repeat_groups(frame(spark, rows).repartition(3), group=group).collect():
        groups[r.repeat].add((r.doc_id, r.start, r.length))
    cover = {d: bytearray(len(t)) for d, t in texts.items()}
    for places in groups.values():
        assert len(places) > 1
        d, start, length = min(places)
        same = texts[d][start : start + length]
        assert length >= 400 and all(texts[x][a : a + n] == same for x, a, n in places)
        everywhere = {(x, m.start(), length) for x, t in texts.items() for m in re.finditer(b"(?=" + re.escape(same) + b")", t)}
        # In a run of one byte pattern windows have another anchor at each place.
        assert places == everywhere or len({x for x, _, _ in everywhere}) < len(everywhere)
        for x, a, n in places:
            cover[x][a : a + n] = b"\1" * n
    assert {d: sum(c) for d, c in cover.items()} == {r[0]: r[2] for r in substring_truth(rows, 400)}


def test_passage_words(spark):
    """Words of runs of 51 that start elsewhere too, beside what goes by bytes."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    run = lambda n: [word() for _ in range(n)]
    shared = [run(n) for n in (50, 51, 60, 75)]
    rows = [(k, " ".join([*run(rng.randint(0, 40)), *shared[k % 4], *run(rng.randint(0, 40))])) for k in range(40)]
    rows += [(100, " ".join(shared[2])), (101, "\n".join(shared[2])), (102, None), (103, ""), (7, "few words"), (7, " ".join(shared[3])), (None, " ".join(shared[3]))]
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    truth = [(d, len({j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)})) for (d, _), w in zip(rows, words, strict=True)]
    out = suffix_repeats.dig(frame(spark, rows).repartition(4), words=51).collect()
    assert sorted(((r.doc_id, r.n_passage_words) for r in out), key=repr) == sorted(truth, key=repr)
    assert sorted((tuple(r)[:5] for r in out), key=repr) == substring_truth(rows, 400)


def test_near_keeps_other_texts_of_an_id(spark):
    """Rows that share a doc_id, or have none, are told apart by their texts."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    near = lambda t: t + " more"
    rows = [(1, a), (7, a), (7, b), (3, near(b)), (8, near(b)), (9, c), (None, near(c)), (None, d), (None, near(d)), (None, d), (5, ""), (5, None), (None, ""), (None, None), (9, "alone")]
    kept = sorted((tuple(r) for r in jaccard_join.deduplicate(frame(spark, rows).repartition(3)).collect()), key=repr)
    have = set(kept)
    assert {(1, a), (3, near(b)), (9, c), (9, "alone"), (5, ""), (5, None), (None, ""), (None, None)} <= have
    assert len(kept) == 9 and len(have & {(None, d), (None, near(d))}) == 1
    out = {(r.doc_id, r.component_id) for r in jaccard_join.join(frame(spark, rows), 5, 80)[0].collect() if r.n_shingles}
    assert out == {(1, 1), (7, 1), (7, 3), (3, 3), (8, 3), (9, 9), (None, 9), (None, None)}


def test_near_where_hashes_clash(spark, monkeypatch):
    """Sets of one 64-bit hash are told by 128 bits."""
    whole = jaccard_join.node_of
    monkeypatch.setattr(jaccard_join, "node_of", lambda h, seed: (whole(h, seed)[0] % 40, whole(h, seed)[1]))
    rows = families(9)[:150]
    docs = jaccard_join.keyed(frame(spark, rows).repartition(3))
    parts = jaccard_join.measured(docs, 3, 90, 0)
    assert parts[1].count() == len({tuple(sorted(set(zip(*(w[i:] for i in range(3)))) if len(w) >= 3 else {tuple(w)})) for _, t in rows if (w := words_of(t))})
    monkeypatch.setattr(jaccard_join, "GROUP", 3)
    out, _ = jaccard_join.join(frame(spark, rows).repartition(3), 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == near_truth(rows, 3, 90)


def test_near_pairs_of_a_large_group(spark):
    """Nodes of one centre give about as many candidates as there are nodes."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 1500):
        w = base[:]
        for _ in range(rng.choice([1, 1, 8, 12])):
            w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    seen = []
    whole = jaccard_join.verified

    def counted(docs, pairs, *args, **more):
        seen.append(pairs.count())
        return whole(docs, pairs, *args, **more)

    jaccard_join.verified, old = counted, jaccard_join.verified
    try:
        out, _ = jaccard_join.join(frame(spark, rows).repartition(4), 3, 90)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == near_truth(rows, 3, 90)
    finally:
        jaccard_join.verified = old
    assert sum(seen) < 40 * len(rows)


def passage_words_truth(rows, least):
    """Words in runs of so many that also start elsewhere, of each row."""
    lists = [t.split() for _, t in rows]
    times = Counter(tuple(w[k : k + least]) for w in lists for k in range(len(w) - least + 1))
    out = []
    for (doc_id, _), w in zip(rows, lists, strict=True):
        covered = set()
        for k in range(len(w) - least + 1):
            if times[tuple(w[k : k + least])] > 1:
                covered |= set(range(k, k + least))
        out.append((doc_id, len(covered)))
    return sorted(out)


@pytest.mark.parametrize("group", [1000, 4])
def test_passage_words_by_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_repeats.repeats, "__defaults__", (400, 64, group))
    rng = random.Random(group)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    own = lambda least, most: [word() for _ in range(rng.randint(least, most))]
    passage, rows = own(90, 90), []
    for k in range(60):
        # Some hold 49, 50, 51 or 52 words of it, some nearly all.
        a, n = rng.choice([(0, 90), (5, 80), (20, 49), (20, 50), (20, 51), (21, 51), (19, 52), (30, 60)])
        rows.append((k, " ".join([*own(0, 70), *passage[a : a + n], *own(0, 70)])))
    rows += [(900, rows[0][1]), (901, rows[3][1].replace(" ", "\n ")), (902, "x " * 200), (903, "")]
    got = suffix_repeats.dig(frame(spark, rows).repartition(4), words=51)
    assert sorted((r.doc_id, r.n_passage_words) for r in got.collect()) == passage_words_truth(rows, 51)
