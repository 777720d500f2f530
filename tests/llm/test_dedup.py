"""Line, substring and document dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
import pytest

from quillspan.llm import linking
from quillspan.llm import substring_dedup as substring
from quillspan.llm import vectext as V
from quillspan.llm.graph import components
from quillspan.llm.keys import _packed, shared_keys
from quillspan.llm.line_dedup import line_dedup, strip_lines
from quillspan.llm.near_dedup import near_dedup
from quillspan.llm.substring_dedup import kept_texts, substring_dedup

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
LAST = (1 << 63) - 1


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def similar_pairs(sets, percent=75):
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    shared = Counter()
    for ids in lists.values():
        shared.update((a, b) for k, b in enumerate(ids) for a in ids[:k])
    return [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]


def test_near_dedup(docs, rows):
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    union = Sets()
    ids = [LAST if d is None else d for d, _ in rows]
    for a, b in similar_pairs(sets):
        if None not in (rows[a][0], rows[b][0]) or sets[a] == sets[b]:
            union.join(ids[a], ids[b])
    expected = Counter((d, len(s), union.find(i), union.find(i) == d) for (d, _), s, i in zip(rows, sets, ids) if d is not None)
    out = near_dedup(docs).collect()
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None)
    assert got == expected
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(10_008, False)]


def test_near_dedup_hot_group(spark):
    """A group of near copies around one text, at all distances: exact components, without leader luck."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(300):
        w = list(base)
        for i in rng.sample(range(120), rng.randint(0, 14)):
            w[i] = f"e{d}_{i}"
        rows.append((d, " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    union = Sets()
    for a, b in similar_pairs(sets):
        union.join(a, b)
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block=4000).collect()}
    assert got == {d: union.find(d) for d, _ in rows}


def test_block_links_only_merge_components():
    """Exact components of random groups, with no more links than merges, whoever asks."""
    rng = np.random.default_rng(7)
    for turn in range(30):
        base = rng.integers(1, 1 << 62, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(60) > rng.random() * 0.4], rng.integers(1, 1 << 62, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(70)]
        sets += [np.unique(rng.choice(base, 9)) for _ in range(20)] + [sets[3], sets[4]]
        sets = [s if len(s) else base[:1] for s in sets]
        start = rng.integers(0, 40, len(sets)) if turn % 2 else np.arange(len(sets))
        asks = rng.random(len(sets)) < (0.3 if turn % 3 else 1.0)
        table = pa.table({"component": start, "shingles": [s.tobytes() for s in sets], "held": np.ones(len(sets), bool), "asks": asks})
        got, union = Sets(), Sets()
        links = linking._against_block(75, linking.stored)(table).to_pylist()
        for x in links:
            got.join(x["ca"], x["cb"])
        for a, b in similar_pairs([set(s.tolist()) for s in sets]):
            if asks[a] or asks[b]:
                union.join(int(start[a]), int(start[b]))
        assert all(got.find(int(c)) == union.find(int(c)) for c in start)
        assert len(links) == len(set(start.tolist())) - len({union.find(int(c)) for c in start})


def test_hashes_of_structured_words():
    """Words and sequences that collide under any polynomial modulo a power of two, at every length class."""
    flip = str.maketrans("ab", "ba")
    long_ = "a"
    while len(long_) < 2048:
        long_ += long_.translate(flip)
    words_ = [long_[:n] for n in (1, 7, 8, 9, 16, 63, 64, 65, 128, 1024, 2048)]
    words_ += [w.translate(flip) for w in words_] + ["a" * n for n in (2, 3, 15, 17)]
    buf, offsets = V.raw(pa.array([" ".join(words_), " ".join(long_), " ".join(long_.translate(flip)), None, " "]))
    starts, ends, first = V.word_bounds(buf, offsets)
    data, hashes = buf.tobytes(), V.span_hashes(buf, starts, ends)
    known = {}
    for a, b, h in zip(starts.tolist(), ends.tolist(), hashes.tolist()):
        assert known.setdefault(data[a:b], h) == h
    assert len(set(known.values())) == len(known)
    whole = V.totals(hashes, first, 1)
    assert len(set(whole.tolist())) == 4 and whole[3] == whole[4]
    wide = np.frombuffer("x".join([*words_, "end"]).encode("utf-16-le"), "<u2")
    at = np.flatnonzero(wide == ord("x"))
    lines = V.span_hashes(wide, np.append(0, at[:-1] + 1), at)
    assert len(set(lines.tolist())) == len(set(words_))


def test_near_dedup_tells_structured_words_apart(spark):
    long_ = "a"
    while len(long_) < 2048:
        long_ += long_.translate(str.maketrans("ab", "ba"))
    other = long_.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(8))
    rows = [(1, long_), (2, other), (3, f"{tail} {long_} {tail}"), (4, f"{tail} {other} {tail}"), (5, f"{long_}\n{other}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.kept for r in near_dedup(df).collect())
    # The two words hold the same runs of eight letters, so as lines they are alike.
    assert {r.doc_id: r.n_removed for r in line_dedup(df).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 2}
    window = " ".join([*["x"] * 19, long_])
    pair = spark.createDataFrame([(1, window), (2, window.replace(long_, other)), (3, window)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(pair).collect()} == {1: 0, 2: 0, 3: 20}


@pytest.mark.parametrize("shard_rows", [10_000, 1])
def test_substring_dedup(docs, rows, shard_rows):
    at = [((LAST if d is None else d), words(t)) for d, t in rows]
    first = {}
    for d, w in at:
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            first[key] = min(first.get(key, (d, i)), (d, i))
    expected = Counter()
    for (d, w), (doc_id, _) in zip(at, rows):
        keep = [True] * len(w)
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (d, i):
                keep[i : i + 20] = [False] * 20
        kept = " ".join(x for x, k in zip(w, keep) if k)
        expected[doc_id, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs, shard_rows=shard_rows).collect())
    assert got == expected
    if shard_rows == 1:
        assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in kept_texts(docs).collect())


def test_the_automaton_locates_what_is_compared(monkeypatch):
    """Windows are compared by what the automaton finds: without its hits, or with other phrases' numbers, nothing is marked."""
    text = " ".join(f"w{i}" for i in range(24))
    table = pa.table({"doc": [1, 2], "version": [1, 2], "start": [0, 5], "inside": pa.array([7, 7], pa.int32()), "salted": [False, False], "words": [text.encode() + b" x", text.encode() + b" y"]})
    whole = substring._shard(20, 10)(table).to_pylist()
    assert [(r["doc"], r["a"], r["b"]) for r in whole] == [(2, 5, 29)]

    real = ahocorasick.Automaton

    class Blind:
        def __init__(self):
            self.real = real()
            self.add_word, self.make_automaton = self.real.add_word, self.real.make_automaton

        def __len__(self):
            return len(self.real)

        def iter(self, line):
            return iter(())

    class Wrong(Blind):
        def iter(self, line):
            return iter([(end, (n, line)) for end, n in self.real.iter(line)])

    for stub in (Blind, Wrong):
        monkeypatch.setattr(substring.ahocorasick, "Automaton", stub)
        assert substring._shard(20, 10)(table).num_rows == 0


def test_line_dedup(docs, rows):
    places = defaultdict(list)
    for d, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            low = line.translate(LOWER)
            if low.strip(" \t\n\x0b\x0c\r"):
                places[low].append((LAST if d is None else d, i))
    lines = list(places)

    def units(s):
        raw = s.encode("utf-16-le")
        return {raw[2 * i : 2 * i + 16] for i in range(len(raw) // 2 - 7)}

    union = Sets()
    for a, b in similar_pairs([units(x) for x in lines]):
        union.join(a, b)
    groups = defaultdict(list)
    for k, line in enumerate(lines):
        groups[union.find(k)] += places[line]
    gone = {p for g in groups.values() for p in g if p > min(g)}
    out = line_dedup(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        here = {i for d, i in gone if d == (LAST if r.doc_id is None else r.doc_id)}
        assert r.n_removed == len(here), r.doc_id
    by_id = {r.doc_id: r for r in out}
    assert by_id[10_001].text is None and by_id[10_001].n_lines == 0
    assert by_id[10_010].text.count("second line") == 1
    kept = strip_lines(docs)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert {10_001, 10_002, 10_003} <= left


def test_line_dedup_one_edit(spark):
    """Lines one edit apart are linked at every length from 16 to 70 and every place; two edits in a short line are not."""
    rng = random.Random(5)
    lines, linked_to = [], {}
    for n in range(16, 71):
        base = "".join(rng.choice("abcdefghij klmnopqrstuvwxyz") for _ in range(n - 2))
        base = f"<{base}>"
        lines.append(base)
        i = rng.randrange(1, n - 1)
        for changed in (base[:i] + "7" + base[i + 1 :], base[:i] + "8" + base[i:], base[:i] + base[i + 1 :]):
            linked_to[len(lines)] = len(changed) >= 16
            lines.append(changed)
    lines += ["Sent on 2024-01-01 to all", "Sent on 2025-01-02 to all", "too short 1 x", "too short 2 x"]
    out = line_dedup(spark.createDataFrame([(d, x) for d, x in enumerate(lines)], "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.n_removed} == {d for d, near in linked_to.items() if near}


def test_empty_tables(docs):
    none = docs.where("doc_id < 0")
    for operator in (near_dedup, substring_dedup, line_dedup):
        assert operator(none).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(99)] + [(1, None), (5, 5)]
    union = Sets()
    for a, b in edges:
        if b is not None:
            union.join(a, b)
    expected = {x: union.find(x) for a, b in edges if b is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == expected


def test_components_in_chunks(spark, monkeypatch):
    """The same components from links contracted seven at a time; links of one chunk take no steps at all."""
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    union = Sets()
    for a, b in edges:
        union.join(a, b)
    expected = {x: union.find(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df, chunk=7).collect()} == expected
    monkeypatch.setattr("quillspan.llm.graph._stars", None)
    assert {r.node: r.component for r in components(df).collect()} == expected


def test_settled_buckets_go(spark):
    placed = spark.createDataFrame([(1, 5, 5), (1, 6, 6), (2, 6, 6), (2, 7, 7)], "key long, doc_id long, component long")
    parts = spark.createDataFrame([(6, 5)], "node long, component long")
    assert {tuple(r) for r in linking._mixed(placed, parts).collect()} == {(2, 6, 5), (2, 7, 7)}


def test_near_dedup_shuffles_no_texts(spark, docs, monkeypatch):
    from quillspan.llm import near_dedup as N

    plans, cut = {}, N.cut
    monkeypatch.setattr(N, "cut", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or cut(df, name))
    near_dedup(docs)
    assert "MapInArrow" in plans["sets"] and "Join" not in plans["sets"]


def test_shared_keys_of_every_frequency(spark):
    """Exactly the pairs of keys with two hashes or more, whatever a task packs at once and however frequent a key is."""
    rng = np.random.default_rng(11)
    keys = np.concatenate([rng.integers(0, 300, 900), np.full(400, 7), np.full(60, 9)]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = np.concatenate([rng.integers(0, 4, 900), np.arange(400), np.full(60, 3)]).astype(np.uint64)
    df = spark.createDataFrame(list(zip(keys.view(np.int64).tolist(), hashes.tolist())), "k long, h long").repartition(3)

    def pairs(batches):
        for batch in batches:
            yield batch.column("k").to_numpy().view(np.uint64), batch.column("h").to_numpy().view(np.uint64)

    by_key = defaultdict(set)
    for k, h in zip(keys.view(np.int64).tolist(), hashes.tolist()):
        by_key[k].add(h)
    expected = {(k, h) for k, hs in by_key.items() if len(hs) > 1 for h in hs}
    for flush, often in ((1 << 20, 32), (100, 8), (100, 1000), (1, 1)):
        got = shared_keys(df, pairs, 5, flush, often).collect()
        assert {tuple(r) for r in got} == expected


def test_no_bucket_grows_with_the_group_of_a_key():
    keys, hashes = np.full(5000, 1 << 40, np.uint64), np.arange(5000, dtype=np.uint64)
    rows = [r for batch in _packed(lambda x: x, 10, 1 << 20, 32)([(keys, hashes)]) for r in batch.to_pylist()]
    assert sorted(r["bucket"] for r in rows) == [*range(-10, 0), 0] and max(len(r["keys"]) for r in rows) == 8 * 500
    assert len(next(r for r in rows if r["bucket"] == 0)["keys"]) == 16


def test_a_large_bucket_keeps_few_of_its_main_component(spark):
    """What a round hands on grows with the texts outside the main component, not with the group; none of these is lost."""
    rows = [(k, d, d) for k in range(20) for d in range(400)]
    placed = spark.createDataFrame(rows, "key long, doc_id long, component long")
    parts = spark.createDataFrame([(d, 0) for d in range(1, 390)], "node long, component long")
    kept = linking._mixed(placed, parts).collect()
    assert {(r.key, r.doc_id) for r in kept if r.component} == {(k, d) for k in range(20) for d in range(390, 400)}
    assert 0 < len(kept) < len(rows) // 5


def test_a_bucket_goes_that_the_last_round_moved_little_in(spark):
    """Rounds do not hand on again and again what no leader links."""
    moved = {1: 3, 2: 10}
    rows = [(k, 1000 * k + d, 1000 * k + d) for k in moved for d in range(100)]
    placed = spark.createDataFrame(rows, "key long, doc_id long, component long")
    parts = spark.createDataFrame([(1000 * k + d, 1000 * k) for k, n in moved.items() for d in range(1, n + 1)], "node long, component long")
    kept = {(r.key, r.doc_id) for r in linking._mixed(placed, parts).collect() if r.component != 2000}
    assert kept == {(2, 2000 + d) for d in range(11, 100)}


def test_near_dedup_links_all_when_every_bucket_goes_at_once(spark, monkeypatch):
    monkeypatch.setattr(linking, "MOVED", 0)
    rng = random.Random(5)
    rows = []
    for d in range(160):
        w = [f"b{d % 4}_{i}" if d % 4 else f"b{i}" for i in range(90)]
        for i in rng.sample(range(90), rng.randint(0, 10)):
            w[i] = f"e{d}_{i}"
        rows.append((d, " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    union = Sets()
    for a, b in similar_pairs(sets):
        union.join(a, b)
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block=4000).collect()}
    assert got == {d: union.find(d) for d, _ in rows}
