import re

import numpy as np
import pyarrow as pa
import pytest

from condeval.llm import jaccard_join as J

DDL = "doc_id bigint, text string, component_id string"


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [(k, shingles(t)) for k, t, *_ in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                parent[root(i)] = root(j)
    groups = {}
    for i, (k, _) in enumerate(sets):
        groups.setdefault(root(i), []).append(k)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return sorted((str(k), len(s), str(least[root(i)])) for i, (k, s) in enumerate(sets))


def got(spark, rows, **more):
    found = J.near_duplicates(spark.createDataFrame(rows, DDL), **more).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found)


def corpus():
    random = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in random.integers(0, 4000, n)]
    passage = word(60)
    rows = []
    for base in range(6):
        text = word(int(random.integers(20, 150)))
        for copy in range(14):
            edited = list(text)
            for at in random.integers(0, len(text), copy // 3):
                edited[at] = f"e{copy}"
            rows.append(" ".join(edited))
    drifting = word(100)
    for step in range(25):  # a chain: neighbours link, its ends don't
        drifting = [*drifting[4:], *word(4)]
        rows.append(" ".join(drifting))
    rows += [" ".join([*word(80), *passage, *word(20)]) for _ in range(40)]
    rows += ["one two", "ONE  two", "one two three four", "one", "É a b c d e", "é a b c d e", "", None, " \t\n", None]
    rows += [rows[0]] * 5 + ["a b c d e f g " * 3000]
    order = random.permutation(len(rows))
    out = [(int(k), rows[i], "x") for k, i in enumerate(order)]
    return [*out, (None, rows[1], "x"), (3, out[3][1], "x")]


@pytest.mark.parametrize("leaf, block", [(8, 8192), (2, 5)])
def test_against_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(J, "LEAF", leaf)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "FREQUENT", 3)
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_sets_that_share_a_name_are_told_apart(spark):
    """Names of two bits and the size: most sets share one, and results stay right."""
    rows = corpus()
    renamed = J._renamed(J._profiles(spark.createDataFrame(rows, DDL), "doc_id", "text", 2).where("hash IS NULL"))
    assert len(renamed) > 20 and len(set(renamed.values())) == len(renamed) and max(renamed.values()) < 0
    assert got(spark, rows, name_bits=2) == brute(rows)


def crowd(copies, edits, seed=3):
    """Texts that each differ from one base by their own edits: near the bound, few of them linked."""
    random = np.random.default_rng(seed)
    base = [f"w{x}" for x in random.integers(0, 10**6, 600)]
    rows = []
    for copy in range(copies):
        text = list(base)
        for at in random.choice(len(base), edits, replace=False):
            text[at] = f"e{copy}_{at}"
        rows.append((copy, " ".join(text), "x"))
    return rows


def test_a_pair_is_found_in_one_of_its_cells(spark, monkeypatch):
    """200 texts of one origin, unlinked: with cells told, pairs come about once; without, many times."""
    rows = crowd(120, 11)
    calls = []
    whole = J._tree_pairs
    monkeypatch.setattr(J, "_tree_pairs", lambda cells: calls.append(cells) or whole(cells))
    found = got(spark, rows)
    assert found == brute(rows)
    pairs = whole(calls[0])
    told, distinct = pairs.count(), pairs.distinct().count()
    untold = whole(calls[0].withColumn("told", J.F.array().cast("array<bigint>")))
    assert untold.distinct().count() == distinct and told <= 1.5 * distinct < untold.count() / 3


def test_empty_table_and_one_row(spark):
    assert got(spark, []) == []
    assert got(spark, [(4, "a b", "x")]) == [("4", 1, "4")]
    assert got(spark, [(4, None, "x"), (5, None, "x")]) == [("4", 0, "4"), ("5", 0, "5")]


def test_tree_yields_every_pair_the_bound_allows():
    random = np.random.default_rng(1)
    sets = [np.unique(random.integers(0, 2**63, 40 + i % 30).astype(np.uint64)) for i in range(70)]
    sets += [np.unique(np.concatenate([s[3:], random.integers(0, 2**63, 2).astype(np.uint64)])) for s in sets]
    sizes = np.array([len(s) for s in sets])
    counts = np.stack([J.group_counts(s) for s in sets])
    group = np.arange(len(sets)) // 2
    tree = {tuple(sorted(p)) for a, b in J.CountTree(sizes, counts, group).pairs() for p in zip(a.tolist(), b.tolist(), strict=True)}
    i, j = np.triu_indices(len(sets), 1)
    ok = J._may_link(sizes[i], counts[i], sizes[j], counts[j]) & (group[i] != group[j])
    assert tree == set(zip(i[ok].tolist(), j[ok].tolist(), strict=True))
    links = {(x, x + 70) for x in range(70) if len(np.intersect1d(sets[x], sets[x + 70])) * 175 >= 75 * (sizes[x] + sizes[x + 70])}
    assert links and links <= tree


def test_saturated_counts_bound_nothing():
    one = np.full(J.GROUPS, J.SATURATED, np.uint8)
    assert J._may_link(np.array([10**6]), one[None], np.array([10**6]), one[None])[0]


def test_routing_keeps_one_shared_hash():
    random = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(random.integers(0, 2**60, 40).astype(np.uint64))
        drop = int(random.integers(0, 10))
        b = np.unique(np.concatenate([a[drop:], random.integers(0, 2**60, drop // 2).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        frequent = np.sort(random.choice(a, 15, replace=False))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert len(np.intersect1d(J.routing_hashes(a, frequent), J.routing_hashes(b, frequent)))


def test_pieces_do_not_change_sets(monkeypatch):
    texts = pa.array(["a b c d e f", None, "x", "", "é " * 50, "a b c d e f"])
    whole = [s.tolist() for s in J.shingle_sets(texts)]
    monkeypatch.setattr(J, "PIECE_BYTES", 3)
    assert [s.tolist() for s in J.shingle_sets(texts)] == whole
    assert [s.tolist() for s in J.shingle_sets(texts.slice(1, 4))] == whole[1:5]
    assert whole[0] == whole[5] and len(whole[0]) == 2 and whole[1] == whole[3] == []


def test_large_cells_are_cut_with_their_pivot_in_each_part(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(h, c * 256) for h, n in ((1, 1), (2, 2), (3, 11), (4, 1), (5, 9), (6, 3)) for c in range(n)]
        rows += [(3, 0), (3, 10 * 256), (6, 256), (7, 0), (7, 255)]  # repeats; a pair whose sizes are far apart
        found = J._shared(spark.createDataFrame(rows, "hash bigint, class bigint")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cut = lambda h, n: {(h, c // 4, c) for c in range(n)} | {(h, p, 0) for p in range(-(-n // 4))}
    large = sorted((r.hash, r.part, r["class"] // 256) for r in found if r.hash is not None)
    assert large == sorted(cut(3, 11) | cut(5, 9))
    assert {(r["class"] // 256, r.other // 256) for r in found if r.hash is None} == {(0, 1), (0, 2), (1, 2)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.component for r in J.components(edges).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}
    assert J.components(edges.limit(0)).count() == 0


def test_one_of_each(spark):
    rows = corpus()
    table = spark.createDataFrame(rows, DDL)
    kept = J.one_of_each(table)
    assert kept.columns == table.columns
    wanted = {k for k, _, c in brute(rows) if k == c}
    assert {str(r.doc_id) for r in kept.collect() if r.doc_id is not None} == wanted - {"None"}
    assert kept.where("doc_id IS NULL").count() == 1 and kept.where("doc_id = 3").count() <= 1


def test_texts_are_found_again_with_few_others(spark):
    """What the filter lets through beyond its keys is shuffled with the sets."""
    table = spark.range(40_000).selectExpr("id AS doc_id", "concat_ws(' ', id, 'a', 'b', 'c', 'd', 'e') AS text")
    keys = spark.range(0, 40_000, 10).withColumnRenamed("id", "_key")
    found = J._found_again(table, "doc_id", "text", (J.NAME_BITS, {}), keys, lambda hashes: b"").count()
    assert 4000 <= found <= 4040


def test_count_vectors_are_stored_packed():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 500, 100_000)]
    counts = np.stack([J.group_counts(s) for s in sets])
    assert (J._rows_of([J._packed(c) for c in counts]) == counts).all()
    assert len(J._packed(counts[1])) < J.GROUPS / 2
    assert J.fine_may_link(J.fine_counts(sets[1]), J.fine_counts(sets[1]))


def test_hashes_that_repeat_are_counted(spark):
    texts = ["a b c d e f", "x a b c d e", "a b c d e g", "p q r s t"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    seen = [r["sightings"] for r in J._profiles(table, "doc_id", "text").where("hash IS NOT NULL").collect()]
    assert seen == [3]
