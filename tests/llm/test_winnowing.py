import hashlib

import numpy as np
import pytest

from condeval.llm import winnowing as W

DDL = "doc_id bigint, text string, fingerprint string"


def naive(text):
    hashes = W.gram_hashes(W._points(text)).tolist()
    width = min(W.WINDOW, len(hashes))
    places = set()
    for start in range(len(hashes) - width + 1 if hashes else 0):
        part = hashes[start : start + width]
        places.add(start + max(i for i, h in enumerate(part) if h == min(part)))
    return [(hashes[p], p) for p in sorted(places)]


@pytest.mark.parametrize("text", ["", "a", "short text", "ab" * 60, "x" * 500, "the quick é brown 😀 fox " * 30])
def test_rightmost_minimum_of_each_window(text):
    assert [tuple(map(int, x)) for x in zip(*W.winnowed(text), strict=True)] == naive(text)


def test_rolling_hash_equals_the_hash_of_each_gram():
    text = "abcdefghijklmnopqrstuvwxyz0123"
    whole = W.gram_hashes(W._points(text))
    assert whole.tolist() == [int(W.gram_hashes(W._points(text[i : i + W.GRAM]))[0]) for i in range(len(whole))]


def test_shared_passages_are_found_where_they_are():
    random = np.random.default_rng(2)
    word = lambda n: "".join(random.choice(list("abcdefgh "), n))
    shared = word(W.GRAM + W.WINDOW - 1)
    for _ in range(50):
        a, b = word(40) + shared + word(30), word(90) + shared + word(10)
        left, right = (dict(zip(*map(list, W.winnowed(t)), strict=True)) for t in (a, b))
        assert any(a[left[h] : left[h] + W.GRAM] == b[right[h] : right[h] + W.GRAM] for h in set(left) & set(right))


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for i, (key, text, _) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, changed, following = (W.winnowed(t) for t in (text, edited, after))
        out.append(
            (
                str(key), len(text), hashlib.sha256(edited.encode()).hexdigest(), W.digest(own), W.digest(changed),
                W.likeness(np.unique(own[0]), np.unique(changed[0])), W.likeness(np.unique(own[0]), np.unique(following[0])),
            )
        )
    return sorted(out)


@pytest.mark.parametrize("count", [0, 1, 2, 60])
def test_edits_follow_descending_keys(spark, count):
    random = np.random.default_rng(count)
    rows = [(int(k), "".join(random.choice(list("abcé😀 "), random.integers(0, 200))), "x") for k in random.permutation(count) * 7]
    if count == 60:
        rows += [(None, "null key " * 9, "x"), (None, "other", "x"), (7, None, "x"), (21, "", "x"), (14, rows[0][1], "x")]
        rows.append((1000, "long " * 100_000, "x"))
    got = W.edited_fingerprints(spark.createDataFrame(rows, DDL)).drop("n_kept").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == (expected(rows) if rows else [])


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(1, "same text of some length", "x"), (2, "same text of some length", "x"), (3, None, "x")]
    got = {r.doc_id: (r.hashes, r.positions) for r in W.fingerprints(spark.createDataFrame(rows, DDL)).collect()}
    assert got[1] == got[2] and got[3] == ([], [])
