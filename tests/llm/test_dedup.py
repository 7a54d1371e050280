"""Exact and near dedup, fuzzy lines: against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import buckets, content_sort, fuzzy_lines, golay_simhash
from lectern.llm.common import smallest_reachable
from lectern.llm.queries import QUERIES

DOC = "doc_id long, text string, norm string, h long, salt int, id string, fp string"


def docs(spark, rows, schema=DOC):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "n", 1, 2, "x", "y") for i, t in rows], schema)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return [find(x) for x in range(n)]


ROWS = [(5, "Same"), (3, "same"), (9, "SAME"), (4, "É"), (6, "é"), (7, None), (8, ""), (None, "same"), (1, "x" * 50_000), (2, "x" * 49_999 + "y"), (5, "Same"), (None, "alone")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_content_sort(spark, keep, hot_rows):
    got = content_sort.content_sort(docs(spark, ROWS), keep=keep, hot_rows=hot_rows, hot_share=1e-9).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(lower(t), []).append(i)
    best = {k: (min if keep == "smallest" else max)([i for i in v if i is not None], default=None) for k, v in groups.items()}
    want = [(i, best[lower(t)], len(groups[lower(t)]), i == best[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in ROWS]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert content_sort.content_sort(docs(spark, [])).count() == 0
    left = content_sort.drop_copies(docs(spark, ROWS), keep=keep, hot_rows=hot_rows, hot_share=1e-9)
    assert left.columns == docs(spark, []).columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(w[0]) for w in want if w[3] or w[0] is None)


def brute_fingerprint(text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lower(text)).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "a B c", "a b c a b c a b c", "é x y z w", "w " * 1000 + "z"])
def test_fingerprint(text):
    assert golay_simhash.fingerprint(text) == brute_fingerprint(text)


def test_hash_is_that_of_spark(spark):
    texts = ["", "a", "abc", "abcdefghijkl", "x" * 33, "é" * 7]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] % (1 << 64) for r in df.select(F.xxhash64("t")).collect()] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_golay_keys():
    r = random.Random(1)
    table = golay_simhash._corrections()
    assert len(set(table.tolist())) == 2048
    words = np.array([r.getrandbits(23) for _ in range(2000)])
    keys = golay_simhash.fuzzy_keys(words)
    assert set((keys >= 0).sum(axis=1).tolist()) == {1, 6}
    for flips in (1, 2):
        near = words.copy()
        for i in range(len(near)):
            for b in r.sample(range(23), flips):
                near[i] ^= 1 << b
        other = golay_simhash.fuzzy_keys(near)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(keys, other))


@pytest.mark.parametrize("bucket_max", [1, 512])
def test_links_connect_like_all_pairs(spark, bucket_max):
    r = random.Random(2)
    prints = set()
    for _ in range(12):
        base = r.getrandbits(64)
        prints.add(base)
        for _ in range(25):
            base ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 2, 3, 4])))
            prints.add(base)
    prints = sorted(prints, key=lambda p: p - (1 << 64) if p >> 63 else p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = components(len(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = golay_simhash.links(df, bucket_max)
    assert all(bin((x.a ^ x.b) % (1 << 64)).count("1") <= 2 for x in found.collect())
    got = {x.node: x.root for x in smallest_reachable(df.withColumnRenamed("fp", "node"), found).collect()}
    assert [got[s] for s in signed] == [signed[w] for w in want]


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_long_chain(spark, one_task):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    nodes = spark.range(302).withColumnRenamed("id", "node")
    got = {r.node: r.root for r in smallest_reachable(nodes, links, one_task=one_task).collect()}
    assert got == {i: 0 for i in range(301)} | {301: 301}


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_components_against_union_find(spark, one_task):
    r = random.Random(8)
    pairs = [(r.randrange(400) - 200, r.randrange(400) - 200) for _ in range(260)]
    linked = {frozenset(p) for p in pairs}
    want = components(400, lambda a, b: frozenset((a - 200, b - 200)) in linked)
    nodes = spark.range(-200, 200).withColumnRenamed("id", "node")
    got = {x.node: x.root for x in smallest_reachable(nodes, spark.createDataFrame(pairs, "a long, b long"), one_task=one_task).collect()}
    assert [got[k - 200] for k in range(400)] == [w - 200 for w in want]


def test_near_groups_cases(spark):
    rows = [(7, "a b c d"), (3, "A  b\nc d"), (9, None), (8, " "), (None, "a b c d"), (None, "only here it is"), (3, "a b c d")]
    got = sorted(str((r.id, r.component_id)) for r in golay_simhash.near_groups(docs(spark, rows)).collect())
    assert got == sorted(str(x) for x in [(7, 3), (3, 3), (9, 8), (8, 8), (None, 3), (None, None), (3, 3)])
    left = golay_simhash.drop_near_copies(docs(spark, rows))
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["3", "3", "8", "None", "None"]) and golay_simhash.near_groups(docs(spark, [])).count() == 0


def test_op7_against_all_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    roots = components(len(rows), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_golay_simhash"](spark, sf_dir).collect()}
    assert got == {r.doc_id: (f"{p:016x}", rows[k].doc_id) for r, p, k in zip(rows, prints, roots)}


def brute_shingles(text, size=5):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lower(text)).split(" ") if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_similar(texts, least=0.8):
    sets = [brute_shingles(t) for t in texts]
    return components(len(texts), lambda a, b: (len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])))


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randint(0, 10**6)}"
    return words


@pytest.mark.parametrize("crowd", [False, True])
def test_similar_groups_against_all_pairs(spark, crowd, monkeypatch):
    """Copies with a few words changed, each like its original and seldom like the other copies; the rest are strangers."""
    if crowd:  # every bucket counts as a crowded one
        monkeypatch.setattr(golay_simhash, "connected", lambda *a: buckets.connected(*a, small=2, rounds=2))
    r = random.Random(4)
    rows = []
    for family in range(8):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(100, 300))]
        rows.append(" ".join(base))
        rows += [" ".join(edited(r, base, r.randint(1, len(base) // 60 + 1))) for _ in range(12)]
        rows += [" ".join(edited(r, base, len(base) // 8)) for _ in range(3)]  # alike, but below 0.8
    rows += ["", None, " \n", "one", "ONE", "one two", *(" ".join(f"w{r.randint(0, 400)}" for _ in range(50)) for _ in range(20))]
    order = list(range(len(rows)))
    r.shuffle(order)
    rows = [rows[k] for k in order]
    want = brute_similar(rows)
    got = {x.id: x.component_id for x in golay_simhash.similar_groups(docs(spark, list(enumerate(rows)))).collect()}
    assert all(want[got[i]] == want[i] for i in got)  # never together without a chain of links
    linked = [i for i in range(len(rows)) if want[i] != i]
    assert len(linked) > 80 and sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked)


def test_similar_groups_cases(spark):
    rows = [(7, "a b c d"), (3, "A  b\nc d"), (9, None), (8, " "), (None, "a b c d"), (None, "only here it is"), (3, "a b c d"), (3, "another text"), (2, "x " * 30_000), (4, "x " * 30_001)]
    got = sorted(str((r.id, r.component_id)) for r in golay_simhash.similar_groups(docs(spark, rows)).collect())
    assert got == sorted(str(x) for x in [(7, 3), (3, 3), (9, 8), (8, 8), (None, 3), (None, None), (3, 3), (3, 3), (2, 2), (4, 2)])
    assert golay_simhash.similar_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("names", [("row", "ID"), ("a.b", "component_id"), ("Key", "node"), ("__gone", "back`tick")])
def test_drops_with_any_names(spark, names):
    df = spark.createDataFrame([(1, "same text", 5, 6), (2, "Same  text", 7, 8), (3, "other", 9, 0)], ["doc_id", "text", *names])
    for left in (golay_simhash.drop_near_copies(df), content_sort.drop_copies(spark.createDataFrame([(1, "t", 5, 6), (2, "T", 7, 8), (3, "other", 9, 0)], df.schema))):
        assert left.columns == df.columns and sorted(tuple(r)[2:] for r in left.collect()) == [(5, 6), (9, 0)]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab c", max_size=14), st.text("ab c", max_size=14), st.integers(0, 15))
def test_edit_distance(a, b, most):
    assert fuzzy_lines.edit_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def brute_lines(rows, least=0.8):
    """Groups of (id, line number) and, for each distinct line, that of all pairs tried by edit similarity alone."""
    at = {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line := fuzzy_lines.normalise(line).decode():
                at.setdefault(line, []).append((i, n))
    lines = sorted(at)

    codes = {c: i for i, c in enumerate(sorted(set("".join(lines))))}
    counts = np.zeros((len(lines), len(codes) + 1), np.int32)
    for k, x in enumerate(lines):
        np.add.at(counts[k], [codes[c] for c in x], 1)
    sizes = counts.sum(axis=1)
    # the distance is what one line has more of each character than the other, at least
    maybe = np.zeros((len(lines), len(lines)), bool)
    for k in range(len(lines)):
        gap = counts[:k] - counts[k]
        maybe[k, :k] = np.maximum(np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1)) <= (1 - least) * np.maximum(sizes[:k], sizes[k]) + 1e-9

    def linked(a, b):
        return bool(maybe[a, b]) and fuzzy_lines.similar(lines[a], lines[b], least)

    return [at[x] for x in lines], components(len(lines), linked)


def check_lines(spark, rows, least_recall, least_links):
    """What is kept is a true group's first; groups are never joined without links; most that should go do."""
    spots, roots = brute_lines(rows)
    group = {spot: root for own, root in zip(spots, roots) for spot in own}
    members = {}
    for spot, root in group.items():
        members.setdefault(root, []).append(spot)
    want = {s for own in members.values() for s in own if s != min(own)}
    found = fuzzy_lines.dropped_lines(docs(spark, rows)).collect()
    gone = {(x.id, n) for x in found for n in x.dropped}
    copies = {s for own in spots for s in own if s != min(own)}
    assert copies <= gone <= want, "equal lines all go, and no line goes that is alone"
    assert len(want - copies) >= least_links and len(gone - copies) >= least_recall * len(want - copies), (len(gone - copies), len(want - copies))
    return found


def test_fuzzy_lines(spark):
    r = random.Random(3)
    base = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randint(0, 30)) for _ in range(14)) for _ in range(6)]
    rows = []
    for i in range(40):
        lines = []
        for line in r.sample(base, 3):
            words = line.split()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = "new" + str(r.randint(0, 99))
            lines.append("  ".join(words).upper() if r.random() < 0.3 else " ".join(words))
        rows.append((i, "\n\n".join(lines)))
    rows += [(90, None), (91, ""), (92, "same line here\nsame line here\n "), (93, "x" * 20_000 + "\n" + "x" * 20_001)]
    found = check_lines(spark, rows, 0.95, 20)
    assert {x.id: x.n_lines for x in found}[90] == 0 and len(found) == len(rows)
    cleaned = {x.doc_id: x.text for x in fuzzy_lines.dedup_lines(docs(spark, rows)).collect()}
    assert cleaned[92] == "same line here\n " and cleaned[90] is None
    assert fuzzy_lines.dropped_lines(docs(spark, [])).count() == 0


def test_fuzzy_lines_recall_on_edits(spark, sf_dir):
    """Lines of the tables, each in a document of its own and beside one edit of it, where the edit similarity holds."""
    r = random.Random(9)
    lines = sorted({" ".join(x.split()) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for x in (d.text or "").split("\n") if 3 <= len(x.split()) <= 200})
    pairs = []
    for kind in ("typo", "two typos", "word", "deleted word"):
        for line in r.sample(lines, 300):
            words = line.split()
            if kind == "word":
                words[r.randrange(len(words))] = f"zuq{r.randint(0, 999)}"
            elif kind == "deleted word":
                del words[r.randrange(len(words))]
            new = " ".join(words)
            for _ in range({"typo": 1, "two typos": 2}.get(kind, 0)):
                k = r.randrange(len(new))
                new = new[:k] + "q" + new[k + 1 :]
            a, b = (fuzzy_lines.normalise(x).decode() for x in (line, new))
            if a != b and fuzzy_lines.edit_distance(a, b, 10**9) <= 0.2 * max(len(a), len(b)):
                pairs.append((kind, line, new))
    rows = [(2 * i + k, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair[1:])]
    gone = {x.id for x in fuzzy_lines.dropped_lines(docs(spark, rows)).collect() if x.dropped}
    for kind in ("typo", "two typos", "word", "deleted word"):
        own = [2 * i + 1 in gone for i, p in enumerate(pairs) if p[0] == kind]
        assert len(own) > 200 and sum(own) >= 0.9 * len(own), (kind, sum(own), len(own))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "cd", "a", "xyz", "longer"]), max_size=12), st.lists(st.sampled_from(["ab", "cd", "a", "xyz", "longer"]), max_size=12))
def test_similar_is_by_the_distance(x, y):
    a, b = " ".join(x), " ".join(y)
    assert fuzzy_lines.similar(a, b, 0.8) == (plain_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "cd", "a", "xyz", "longer"]), max_size=25), st.lists(st.sampled_from(["ab", "cd", "a", "xyz", "longer"]), max_size=25), st.integers(0, 40))
def test_aligned_is_never_below_the_distance(x, y, most):
    assert not fuzzy_lines.aligned(x, y, most) or plain_distance(" ".join(x), " ".join(y)) <= most


def test_similar_lines_need_no_distance(monkeypatch):
    """Words that are new, left out and changed in one line: words side by side tell that it is similar enough."""
    monkeypatch.setattr(fuzzy_lines, "edit_distance", None)
    words = [f"word{i}" for i in range(60)]
    new = ["first", *words[:9], "one", "more", *words[9:20], *words[21:40], "other", *words[41:59], "last"]
    assert fuzzy_lines.similar(" ".join(words), " ".join(new), 0.8)


def test_op5_against_all_pairs(spark, sf_dir):
    """The registered query, on all lines of the smallest tables."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    spots, roots = brute_lines(rows)
    members = {}
    for own, root in zip(spots, roots):
        members.setdefault(root, []).extend(own)
    want = {s for own in members.values() for s in own if s != min(own)}
    gone = {(x.doc_id, n) for x in QUERIES["op5_fuzzy_lines"](spark, sf_dir).collect() for n in x.dropped}
    copies = {s for own in spots for s in own if s != min(own)}
    assert copies <= gone <= want and len(gone - copies) >= 0.9 * len(want - copies) > 0, (len(gone - copies), len(want - copies))


def test_fuzzy_lines_of_one_family(spark, monkeypatch):
    """Hundreds of lines alike in pairs: crowded buckets, few comparisons."""
    tried = []
    plain = buckets.cut

    def counted(df, label):
        out = plain(df, label)
        if label == "pairs":
            tried.append(out.count())
        return out

    monkeypatch.setattr(buckets, "cut", counted)
    rows = [(i, f"chapter number {i:04} of the book that everyone reads\nan own line {i * 7919}x{i * 104729} of {i * 31337}") for i in range(600)]
    found = fuzzy_lines.dropped_lines(docs(spark, rows)).collect()
    assert sum(0 in x.dropped for x in found) == 599 and sum(tried) < 60_000


@pytest.mark.parametrize("block", [1024, 50])
@pytest.mark.parametrize("small", [64, 1000])
def test_connected_leaves_no_pair_out(spark, monkeypatch, small, block):
    """Chains: in one bucket each node is like the one before and the one after it, and like no leader."""
    monkeypatch.setattr(buckets, "BLOCK", block)
    r = random.Random(6)
    place = r.sample(range(10_000), 300)  # node k of chain c stands at 2000 c + k
    at = {node: 2000 * (i % 3) + i // 3 for i, node in enumerate(place)}
    keys = [(key, node, 0, 0) for node, x in at.items() for key in {7, 100 + x // 2000} | ({900 + x // 40} if x % 2 else set())]
    texts = spark.createDataFrame([(node, str(x)) for node, x in at.items()], "node long, text string")
    near = buckets.Test(lambda a, b: F.col(f"{a}f1") == F.col(f"{b}f1"), lambda f1, f2, f1s, f2s: f1s == f1)
    alike = buckets.Test(lambda a, b: F.abs(a.cast("long") - b.cast("long")) <= 1, lambda own: lambda v, js: np.array([abs(int(own[v]) - int(own[j])) <= 1 for j in js], bool))
    got = buckets.connected(spark.createDataFrame(keys, "key long, node long, f1 long, f2 long"), near, lambda w: texts.join(w, "node"), alike, small=small)
    want = {node: min(n for n, y in at.items() if y // 2000 == x // 2000) for node, x in at.items()}
    assert {x.node: x.root for x in got.collect()} == want


@pytest.mark.parametrize("size", [1, 5])
def test_similar_rows_as_columns(size):
    r = random.Random(8)
    base = [f"w{r.randint(0, 50)}" for _ in range(90)]
    texts = ["", "one", "one two", *(" ".join(edited(r, base, r.randint(0, 6))) for _ in range(40)), ""]
    test = golay_simhash.similar_rows(size, 0.8)(texts)
    for v in range(len(texts)):
        js = np.array([j for j in range(len(texts)) if j != v])
        want = [golay_simhash.jaccard(golay_simhash.shingles(texts[v], size), golay_simhash.shingles(texts[j], size)) >= 0.8 for j in js]
        assert test(v, js).tolist() == want


@pytest.mark.parametrize("names", [("__gone", "__id"), ("a.b", "row"), ("Dropped", "gone_id")])
def test_lines_with_any_names(spark, names):
    df = spark.createDataFrame([(1, "same\nown", 5, 6), (2, "same\nother words", 7, 8)], ["doc_id", "text", *names])
    out = fuzzy_lines.dedup_lines(df)
    assert out.columns == df.columns and [tuple(r) for r in sorted(out.collect())] == [(1, "same\nown", 5, 6), (2, "other words", 7, 8)]


def chain_tests():
    near = buckets.Test(lambda a, b: F.col(f"{a}f1") == F.col(f"{b}f1"), lambda f1, f2, f1s, f2s: f1s == f1)
    alike = buckets.Test(lambda a, b: F.abs(a.cast("long") - b.cast("long")) <= 1, lambda own: lambda v, js: np.array([abs(int(own[v]) - int(own[j])) <= 1 for j in js], bool))
    return near, alike


def test_connected_tells_a_nodes_numbers_by_key(spark):
    """Lines have one SimHash for keys by words and another for those by runs: near by one, far by the other."""
    keys = [(key, n, 1000 + n, 0) for n in range(150) for key in (5, 6, 7)] + [(8, n, 0, 0) for n in range(150)]
    texts = spark.createDataFrame([(n, str(n)) for n in range(150)], "node long, text string")
    got = buckets.connected(spark.createDataFrame(keys, "key long, node long, f1 long, f2 long"), chain_tests()[0], lambda w: texts.join(w, "node"), chain_tests()[1])
    assert {x.node: x.root for x in got.collect()} == {n: 0 for n in range(150)}


def test_connected_joins_no_bucket_inside_a_crowd(spark, monkeypatch):
    """The pairs of a crowd's small buckets meet with the crowd; their keys go no further."""
    sides, plain = [], buckets._side
    monkeypatch.setattr(buckets, "_side", lambda rows, prefix: (sides.append(rows), plain(rows, prefix))[1])
    monkeypatch.setattr(buckets, "drop_cut", lambda *a: None)
    keys = [(key, n, 0, 0) for n in range(200) for key in (7, 100 + n // 10)] + [(900, 200, 0, 0), (900, 202, 0, 0)]
    texts = spark.createDataFrame([(n, str(n)) for n in range(203)], "node long, text string")
    near, alike = chain_tests()
    got = buckets.connected(spark.createDataFrame(keys, "key long, node long, f1 long, f2 long"), near, lambda w: texts.join(w, "node"), alike)
    assert {x.node: x.root for x in got.collect()} == {n: 0 for n in range(200)}
    assert sides[-1].select("key").distinct().count() == 1


def test_connected_sends_no_keys_through_the_driver(spark, monkeypatch):
    """A node is one row and its keys are hundreds, of which Spark knows nothing when it plans the join."""
    plans = []

    def seen(df, label):
        if label == "shared":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    real = buckets.cut
    monkeypatch.setattr(buckets, "cut", seen)
    rows = [(i, f"some words of text {i} that are none of another and a few more of {i % 7}") for i in range(40)]
    golay_simhash.similar_groups(docs(spark, rows)).count()
    fuzzy_lines.line_groups(docs(spark, rows)).count()
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_connected_meets_strangers_by_bucket(spark, monkeypatch, tmp_path):
    """A long chain of crowded buckets: its nodes come with their buckets, not with all others of the chain."""
    plain = buckets._links_within

    def counting(near, alike):
        inner = plain(near, alike)

        def of(table):
            with (tmp_path / "met").open("a") as f:
                f.write(f"{table.num_rows}\n")
            return inner(table)

        return of

    monkeypatch.setattr(buckets, "_links_within", counting)
    monkeypatch.setattr(buckets, "BLOCK", 50)
    keys = [(b, 69 * b + k, 0, 0) for b in range(40) for k in range(70)]  # each shares a node with the next
    texts = spark.createDataFrame([(n, str(n if n % 69 > 60 else -10 * n - 10)) for n in range(69 * 40 + 1)], "node long, text string")
    near, alike = chain_tests()
    got = buckets.connected(spark.createDataFrame(keys, "key long, node long, f1 long, f2 long"), near, lambda w: texts.join(w, "node"), alike)
    assert {x.node: x.root for x in got.collect()} == {69 * b + k: 69 * b + 61 for b in range(40) for k in range(61, 69)}
    assert 40 * 70 <= sum(map(int, (tmp_path / "met").read_text().split())) <= 2 * 40 * 70


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab é😀", max_size=16), min_size=2, max_size=8))
def test_lines_similar_rows_as_pairs(texts):
    test = fuzzy_lines.similar_rows(0.8)(texts)
    for v in range(len(texts)):
        js = np.array([j for j in range(len(texts)) if j != v])
        assert test(v, js).tolist() == [fuzzy_lines.similar(texts[v], texts[j], 0.8) for j in js]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc ", max_size=30), st.text("abc ", max_size=30)), max_size=12))
def test_similar_pairs_as_one_by_one(both):
    left, right = [a for a, _ in both], [b for _, b in both]
    assert fuzzy_lines.similar_pairs(left, right, 0.8, at_once=5) == [fuzzy_lines.similar(a, b, 0.8) for a, b in both]


def test_strangers_need_no_distance(monkeypatch):
    """Lines of one length and hardly a pair of characters in common are told apart before their words are."""
    monkeypatch.setattr(fuzzy_lines, "similar", None)
    a, b = " ".join(["kala", "muto", "seri"] * 20), " ".join(["bodu", "gifo", "newy"] * 20)
    assert fuzzy_lines.similar_pairs([a, b], [b, a], 0.8) == [False, False]


def test_keys_counted_in_runs(spark, monkeypatch):
    """Keys of all ranges, the ends of the numbers among them, in runs far smaller than the rows."""
    r = random.Random(4)
    keys = [r.choice([-(1 << 63), (1 << 63) - 1, -1, 0, r.randrange(-(1 << 63), 1 << 63)]) for _ in range(3000)] + [17 << 52] * 40
    rows = spark.createDataFrame([(k,) for k in keys + keys[:500:2]], "key long").repartition(3)
    want = {(x.key, x.n) for x in rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").collect()}
    got = buckets.shared_keys(rows, lambda batches: (b.column(0).to_numpy() for b in batches)).collect()
    assert {(x.key, x.n) for x in got} == want and len(got) == len(want)
    monkeypatch.setattr(buckets, "SORTED", 7)
    dealt = list(buckets._dealt(np.array(keys[i : i + 50]) for i in range(0, len(keys), 50)))
    assert len(dealt) > 50
    by_range = sorted(((at, x) for b in dealt for at, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), key=lambda x: x[0])
    batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in by_range]) for k in (0, 1)], ["range", "keys"])
    found = [x for b in buckets._sizes(iter([batch.slice(0, 9), batch.slice(9)])) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    counts = {k: keys.count(k) for k in set(keys)}
    assert sorted(found) == sorted((k, n) for k, n in counts.items() if n > 1)


@pytest.mark.parametrize("sorted_at_once", [1 << 20, 3])
@pytest.mark.parametrize("features", [40, 3000, 200_000])
def test_simhash_blocks(monkeypatch, features, sorted_at_once):
    """Against the definition, with blocks of a few features, of hundreds and of tens of thousands."""
    monkeypatch.setattr(fuzzy_lines, "_SORTED", sorted_at_once)
    rng = np.random.default_rng(features)
    lines, hashes = np.sort(rng.integers(0, 7, features)), rng.integers(0, 1 << 64, features, dtype=np.uint64)
    hashes[rng.integers(0, features, features // 3)] = hashes[0]  # one word in all lines, again and again
    sizes = (hashes % np.uint64(9)).astype(np.int64) + 1
    blocks, held, whole = fuzzy_lines.simhash_blocks(lines, hashes, sizes, 8)
    bits = lambda own: sum(1 << q for q in range(32) if 2 * (own >> np.uint64(q) & np.uint64(1)).sum() > len(own))
    for line in range(8):
        own = np.unique(hashes[lines == line])
        assert whole[line] == bits(own)
        for block in range(8):
            part = own[own >> np.uint64(61) == block]
            assert blocks[line, block] == bits(part) and held[line, block] == ((part % np.uint64(9)).astype(int) + 1).sum()
