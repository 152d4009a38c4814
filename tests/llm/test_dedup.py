"""Exact, near, substring and byte dedup against brute force, on rows with every awkward case."""

import hashlib
import random

import pytest

from skein.llm import exact_dedup, near_dedup, routing, sharding, simhash, substring_dedup, suffix_dedup, windows
from skein.llm.storage import Workspace

SCHEMA = "doc_id long, text string, digest string, mask long, shard int, doc long, size long"


def docs(spark, rows):
    """``rows`` (doc_id, text) with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(d, t, "x", 1, 99, 5, 7) for d, t in rows], SCHEMA)


def sample():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7))) for _ in range(200)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    shared, long = text(60), text(400)
    rows = [(k, text(draw.randint(0, 80))) for k in range(20)]
    rows += [(30 + k, f"{text(9)} {shared} {text(9)}") for k in range(6)]
    rows += [(40 + k, long) for k in range(5)] + [(50, long.replace(" ", "\t\n")), (51, long + " " + long), (52, text(3000))]
    rows += [(60, None), (61, ""), (62, " \n"), (63, "one"), (64, "one two"), (65, "ü" * 300), (66, shared), (67, shared[:200])]
    edited = long.split()
    for k in range(4):
        edited[50 * k + 7] = "changed"
        rows.append((70 + k, " ".join(edited)))
    return rows


ROWS = sample()


def test_exact(spark):
    rows = ROWS + [(45, "a b"), (46, "ab "), (46, "ab "), (None, "ab"), (None, "alone")]
    index = exact_dedup.DigestIndex(spark, Workspace(spark, "digests").path, buckets=4)
    found = exact_dedup.dedup(docs(spark, rows), index).collect()
    assert len(found) == len(rows)
    norm = lambda t: "".join(c for c in t or "" if c not in exact_dedup.BLANKS)
    groups = {}
    for d, t in rows:
        groups.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append((-len(t or ""), d is None, d or 0, d))
    for r in found:
        members = groups[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(members)[3], len(members))
    for digest in groups:
        assert sum(r.kept for r in found if r.text_sha256 == digest) == 1
    # A later call is a batch of its own, without being told so.
    again = exact_dedup.dedup(docs(spark, [(900, "a  b"), (901, "new"), (902, "n ew")]), index).collect()
    assert {r.doc_id: (r.kept, r.known) for r in again} == {900: (False, True), 901: (False, False), 902: (True, False)}
    assert {r.keep_id for r in again if r.doc_id != 900} == {902}
    assert index.rows().count() == len(groups) + 1


def test_exact_keeps_one_row_with_its_columns(spark):
    index = exact_dedup.DigestIndex(spark, Workspace(spark, "digests").path, buckets=4)
    frame = docs(spark, [(1, "a b"), (1, "a b"), (2, "ab"), (None, "c"), (None, "c")])
    kept = exact_dedup.keep_first(frame, index)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "c"), (1, "a b")]
    plain = docs(spark, [(1, "a  b"), (2, "ab"), (3, "a b c"), (None, "a\tbc"), (4, None)])
    index = exact_dedup.DigestIndex(spark, Workspace(spark, "digests").path, buckets=4)
    assert sorted((r.doc_id, r.text or "") for r in exact_dedup.keep_first(plain, index).collect()) == [(1, "a  b"), (3, "a b c"), (4, "")]
    # A repeated call of one name gives what the first attempt gave.
    assert exact_dedup.dedup(plain, index, "retry").where("kept").count() == 0
    other = docs(spark, [(7, "only"), (8, "on ly")])
    first, second = (sorted((r.doc_id, r.kept) for r in exact_dedup.dedup(other, index, "retry").collect()) for _ in range(2))
    assert first == second == [(7, False), (8, True)]


def test_exact_of_nothing(spark):
    index = exact_dedup.DigestIndex(spark, Workspace(spark, "digests").path, buckets=4)
    assert exact_dedup.dedup(docs(spark, []), index).count() == 0


def components_of(marks, radius):
    group = {d: d for d, _ in marks}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, x in marks:
        for b, y in marks:
            if (x ^ y).bit_count() <= radius and root(a) != root(b):
                group[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d, _ in marks}


def test_simhash(spark):
    found = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, ROWS)).collect()}
    marks = [(d, simhash.fingerprint(t)) for d, t in ROWS]
    want = components_of(marks, 3)
    assert {d: (r.fingerprint, r.component_id) for d, r in found.items()} == {d: (f"{m:016x}", want[d]) for d, m in marks}
    assert found[60].fingerprint == "0" * 16
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("shard", [4, 1000])
def test_links_connect_whatever_the_size_of_a_tree(spark, shard):
    draw = random.Random(2)
    values = {0}
    for _ in range(300):
        values.add(draw.choice(sorted(values)) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    from skein.llm.components import components

    work = Workspace(spark, "links")
    roots = {r.u: r.root for r in components(work.put(simhash.links(fps, work, shard=shard), "links"), work).collect()}
    want = components_of([(x, x % (1 << 64)) for x in signed], 3)
    assert {x: roots.get(x, x) for x in signed} == want


def test_near_groups(spark):
    found = {r.doc_id: r.group for r in near_dedup.groups(docs(spark, ROWS)).collect()}
    assert {found[k] for k in (40, 41, 42, 43, 44, 50, 70, 71, 72)} == {40}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(max(1, len(w) - 4))}
    sets = {d: shingles(t) for d, t in ROWS}
    for d, g in found.items():
        assert d == g or any(len(sets[d] & sets[e]) >= 0.7 * len(sets[d] | sets[e]) for e in sets if e != d and found[e] == g)
    kept = near_dedup.keep_one(docs(spark, ROWS))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values()))


def brute_groups(rows):
    """Components of the pairs whose sets of distinct five-word shingles have a Jaccard similarity of 0.8 or more."""

    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets, group = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, x in sets.items():
        for b, y in sets.items():
            shared = len(x & y)
            if a < b and (x == y or shared and 5 * shared >= 4 * len(x | y)) and root(a) != root(b):
                group[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in group}


@pytest.mark.parametrize("tree", [4, 4096])
def test_near_groups_are_those_of_the_true_similarity(spark, monkeypatch, tree):
    monkeypatch.setattr(near_dedup, "TREE", tree)
    draw, rows = random.Random(9), []
    word = lambda: f"w{draw.randrange(10**9)}"
    # Words appended to texts of n shingles: similarities just above, at and just below 0.8.
    for n, more in [(4, 1), (5, 1), (6, 1), (20, 5), (100, 20), (100, 25), (100, 26), (100, 29), (400, 100), (400, 101), (1000, 220), (1000, 260)]:
        for _ in range(8):
            text = [word() for _ in range(n + 4)]
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(text + [word() for _ in range(more)]))]
    rows += [(len(rows), None), (len(rows) + 1, " ")]
    found = {r.doc_id: r.group for r in near_dedup.groups(docs(spark, rows)).collect()}
    assert found == brute_groups(rows)


def test_near_groups_ignore_repeats_within_a_document(spark):
    draw = random.Random(10)
    word = lambda: f"w{draw.randrange(10**9)}"
    block = " ".join(word() for _ in range(45))
    rows = [(k, " ".join([*(word() for _ in range(104)), *[block] * 10])) for k in range(40)]
    body = " ".join(word() for _ in range(104))
    rows += [(40, rows[0][1] + f" {block}"), (41, f"{body} {block}"), (42, " ".join([body] + [block] * 10))]
    found = {r.doc_id: r.group for r in near_dedup.groups(docs(spark, rows)).collect()}
    assert found == brute_groups(rows) == {d: {40: 0, 42: 41}.get(d, d) for d, _ in rows}


def test_passages(spark):
    rows = ROWS + [(80, ROWS[30][1]), (80, ROWS[30][1]), (81, "a\x00b " * 80)]
    found = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in substring_dedup.remove_passages(docs(spark, rows)).collect()), key=str)
    want = substring_dedup.reference([t for _, t in rows])
    assert found == sorted(((d, *x) for (d, _), x in zip(rows, want)), key=str)
    assert substring_dedup.remove_passages(docs(spark, [])).count() == 0


def test_strings(spark):
    rows = ROWS + [(82, "\x00" * 500), (83, "xy" * 400)]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_strings(docs(spark, rows)).collect()}
    assert found == suffix_dedup.reference(rows)
    assert suffix_dedup.remove_strings(docs(spark, [])).count() == 0


def passages(spark, rows):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in substring_dedup.remove_passages(docs(spark, rows)).collect()), key=str)


def strings(spark, rows):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_strings(docs(spark, rows)).collect()), key=str)


def passages_by_hand(rows):
    return sorted(((d, *x) for (d, _), x in zip(rows, substring_dedup.reference([t for _, t in rows]))), key=str)


def strings_by_hand(spark, rows):
    """Rows of one id, or of none, stand in the order of their texts' hashes; rows equal in both are one document."""
    known = {(r.doc_id, r.text): (r.doc, r.mark) for r in routing.plain(docs(spark, rows)).collect()}
    order = sorted(known, key=known.get)
    found = suffix_dedup.reference([(k, t) for k, (_, t) in enumerate(order)])
    return sorted(((d, *found[order.index((d, t or ""))]) for d, t in rows), key=str)


@pytest.mark.parametrize("classes", [2, 16])
def test_substring_parts_of_a_hot_key(spark, monkeypatch, classes):
    monkeypatch.setattr(suffix_dedup, "CLASSES", classes)
    monkeypatch.setattr(substring_dedup, "CLASSES", classes)
    draw = random.Random(12)
    word = lambda: f"w{draw.randrange(10**6)}"
    passage = " ".join(word() for _ in range(40))
    rows = ROWS + [(1000 + k, f"{' '.join(word() for _ in range(12))} {passage} {' '.join(word() for _ in range(12))}") for k in range(400)]
    assert strings(spark, rows) == strings_by_hand(spark, rows)
    assert passages(spark, rows) == passages_by_hand(rows)


def test_substrings_of_very_long_texts(spark):
    draw = random.Random(13)
    word = lambda: f"{draw.randrange(10**5)}"
    long = [word() for _ in range(windows.SLICE + 3000)]
    # A passage of the text's end and one across the border of its slices stand elsewhere too.
    rows = [(1, " ".join(long)), (2, " ".join(long[-50:])), (3, " ".join(["x", *long[windows.SLICE - 30 : windows.SLICE + 30], "y"])), (4, "\t".join(long[500:600]))]
    assert passages(spark, rows) == passages_by_hand(rows)
    assert len(rows[0][1]) > 5 * windows.SLICE
    assert strings(spark, rows) == strings_by_hand(spark, rows)


def test_substrings_of_rows_with_one_id_or_none(spark):
    draw = random.Random(14)
    text = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    shared, other = text(45), text(50)
    rows = [(None, f"{text(5)} {shared} {text(k % 7)}") for k in range(30)] + [(7, f"{other} {text(3)}"), (7, f"{text(3)} {other}"), (7, text(60)), (7, None), (None, None), (None, "")]
    rows += [(8, other), (8, other), (9, f"{text(4)} {shared}")]
    assert passages(spark, rows) == passages_by_hand(rows)
    assert strings(spark, rows) == strings_by_hand(spark, rows)


def key_group(texts, width, separator=b" "):
    """What ``resolve`` gets for one key: its texts in order of place."""
    import pyarrow as pa

    size = lambda t: len(t.split() if separator else t) - width + 1
    rows = [(5, 0, 1, k, 1, k, 0, 0, size(t), t) for k, t in enumerate(texts)]
    names = ["key", "part", "parts", "dig", "copies", "doc", "mark", "start", "n", "content"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


def test_a_parse_looks_up_the_windows_at_the_ends_of_factors():
    draw = random.Random(15)
    texts = [b" ".join(draw.choice([b"a", b"bb", b"c"]) for _ in range(draw.randint(35, 62))) for _ in range(4)]
    # Texts pieced together from others, so that windows across the ends of factors match in third places.
    pool = [b" ".join(b"%d" % draw.randrange(1000) for _ in range(62)) for _ in range(3)]
    for _ in range(60):
        a, b = (draw.choice(texts[4:] or pool).split() for _ in range(2))
        cut = draw.randint(0, 30)
        texts.append(b" ".join((a[cut : cut + draw.randint(20, 45)] + b[draw.randint(0, 20) :])[: draw.randint(40, 62)]))
    texts = [t for t in pool + texts if len(t.split()) >= 35]
    found = {r["dig"]: r["mask"] for b in substring_dedup.resolve(iter([key_group(texts, 35)])) for r in b.to_pylist()}
    seen = {}
    for t in texts:
        for k in range(len(t.split()) - 34):
            seen[tuple(t.split()[k : k + 35])] = seen.get(tuple(t.split()[k : k + 35]), 0) + 1
    want = {d: sum(1 << k for k in range(len(t.split()) - 34) if seen[tuple(t.split()[k : k + 35])] > 1) for d, t in enumerate(texts)}
    assert found == {d: m for d, m in want.items() if m}
    assert substring_dedup.factors([40, 39, 38, 35, 36, 35, 34, *range(33, 0, -1)], 35) == [(0, 40)]


def test_batches_are_scanned_against_the_levels_of_earlier_ones(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 3)
    draw = random.Random(16)
    texts = [bytes(draw.choice(b"ab") for _ in range(draw.randint(100, 163))) for _ in range(5)]
    for _ in range(60):
        a, b = draw.choice(texts), draw.choice(texts)
        texts.append((a[draw.randint(0, 30) :] + b[: draw.randint(10, 120)])[:163].ljust(100, b"\0"))
    found = {r["dig"]: r["mask"] for b in suffix_dedup.resolve(iter([key_group(texts, 100, None)])) for r in b.to_pylist()}
    seen, want = set(), {}
    for d, t in enumerate(texts):
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                want[d] = want.get(d, 0) | 1 << k
            seen.add(t[k : k + 100])
    assert {d: m % (1 << 64) for d, m in found.items()} == want


def test_index_family_merges_levels():
    import numpy as np

    family, seen, draw = suffix_dedup.IndexFamily(3), set(), random.Random(1)
    for _ in range(60):
        text = "".join(draw.choice("abcd") for _ in range(draw.randint(3, 12))).encode()
        starts, want = [k for k in range(len(text) - 2) if draw.random() < 0.8], []
        for k in starts:
            want.append(text[k : k + 3] in seen)
            seen.add(text[k : k + 3])
        assert family.scan_and_add(text, np.array(starts, np.int64)).tolist() == want
    assert sum(map(len, family.levels)) == len(seen)
    assert all(2 * len(b) < len(a) for a, b in zip(family.levels, family.levels[1:]))
    assert all(x.strings().tolist() == sorted(x.strings().tolist()) for x in family.levels)


def test_shards(spark):
    rows = [(k, "same text" if k % 3 == 0 else f"text {k} " * (k % 17)) for k in range(600)] + [(None, None), (7, "again"), (7, "again")]
    frame = docs(spark, rows)
    found = sharding.shard(frame, shards=16).collect()
    assert sorted(found[0].asDict()) == sorted([*frame.columns, "slot"])
    assert len(found) == len(rows)
    size, slots = {}, {}
    for r in found:
        assert r.size == len((r.text or "").encode()) + 1
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    most = max(r.size for r in found)
    assert set(size) == set(range(16)) and max(size.values()) - min(size.values()) <= 2 * most
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs(spark, [])).count() == 0


def test_shards_of_a_frequent_text(spark, monkeypatch):
    """A text of a third of all rows is numbered in pieces; groups that fit the tolerance stay whole."""
    monkeypatch.setattr(sharding, "RANGES", (16, 64))
    rows = [(k, "frequent text" if k % 3 == 0 else f"text {k // 6}" + "x" * (k // 6 % 40)) for k in range(3000)]
    found = sharding.shard(docs(spark, rows), shards=4, tolerance=0.02).collect()
    assert sorted((r.doc_id, r.text) for r in found) == sorted(rows)
    shards, size, slots = {}, {}, {}
    for r in found:
        shards.setdefault(r.text, set()).add(r.shard)
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * 0.02 * sum(size.values()) / 4 + 100
    # At most one group for each boundary is cut, and only one that can't be kept whole.
    assert sum(len(s) > 1 for s in shards.values()) <= 3
    # Rows without an id, all of one text, still get slots of their own.
    lost = sharding.shard(docs(spark, [(None, "same")] * 50 + [(k, f"t{k}") for k in range(50)]), shards=2).collect()
    assert {s: sorted(r.slot for r in lost if r.shard == s) for s in (0, 1)} == {s: list(range(sum(r.shard == s for r in lost))) for s in (0, 1)}


def test_components_of_a_long_path_and_a_star(spark):
    from skein.llm.components import components

    edges = [(k, k + 1) for k in range(0, 200, 1)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    work = Workspace(spark, "parts")
    found = {r.u: r.root for r in components(work.put(spark.createDataFrame(edges, "u long, v long"), "links"), work).collect()}
    want = {k: 0 for k in range(1, 201)} | {1000 + k: 1000 for k in range(1, 300)} | {6001: 6000}
    assert {u: r for u, r in found.items() if u != r} == want


def test_fingerprints_by_hand(spark):
    import xxhash

    for d, t in ROWS[:30] + ROWS[-12:]:
        words = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        runs = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(t) == want


def test_recall_of_near_duplicates(spark):
    """Of pairs at and above the similarity, in a crowd of texts that share much, at least nine in ten are linked; below it none."""
    draw = random.Random(21)
    pool = [f"w{k}" for k in range(400)]
    base = [[draw.choice(pool) for _ in range(120)] for _ in range(12)]
    rows = []
    for text in base:
        for _ in range(12):
            words = list(text)
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = draw.choice(pool)
            rows.append((len(rows), " ".join(words)))
    sets = {d: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for d, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group = {r.doc_id: r.group for r in near_dedup.groups(docs(spark, rows)).collect()}
    assert len(pairs) > 100 and sum(group[a] == group[b] for a, b in pairs) >= 0.9 * len(pairs)
    want = brute_groups(rows)
    assert all(want[a] == want[b] for a in group for b in group if group[a] == group[b])
