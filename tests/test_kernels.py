import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stringloom.operators import kernels as k

GOLDEN = {
    "banana": ([6, 5, 3, 1, 0, 4, 2], [0, 0, 1, 3, 0, 0, 2]),
    "mississippi": ([11, 10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2], [0, 0, 1, 1, 4, 0, 0, 1, 0, 2, 1, 3]),
    "aaaa": ([4, 3, 2, 1, 0], [0, 0, 1, 2, 3]), "a": ([1, 0], [0, 0]), "": ([0], [0]),
}


def brute(text):
    sa = sorted(range(len(text) + 1), key=lambda i: text[i:])
    common = lambda a, b: next((n for n in range(len(text)) if text[a + n : a + n + 1] != text[b + n : b + n + 1] or a + n >= len(text) or b + n >= len(text)), len(text))
    return sa, [0] + [common(a, b) for a, b in zip(sa, sa[1:])]


@pytest.mark.parametrize("text", GOLDEN)
def test_golden_orders(text):
    order = k.suffix_order([k.codes(text)])
    assert (order.sa.tolist(), order.lcp.tolist()) == GOLDEN[text]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abé漢", max_size=30), min_size=1, max_size=5))
def test_orders_of_many_texts(texts):
    order = k.suffix_order([k.codes(t) for t in texts])
    for text, a, b in zip(texts, order.bounds, order.bounds[1:]):
        assert (order.sa[a:b].tolist(), order.lcp[a:b].tolist()) == brute(text)
        assert order.isa[a:b][order.sa[a:b]].tolist() == list(range(b - a))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=25), min_size=1, max_size=4))
def test_nearest_smaller_and_minima(parts):
    values, bounds = np.array([v for p in parts for v in p], np.int64), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(int)
    for or_equal in (False, True):
        less = (lambda a, b: a <= b) if or_equal else (lambda a, b: a < b)
        before, after = k.previous_smaller(values, bounds, or_equal), k.next_smaller(values, bounds, or_equal)
        for a, b in zip(bounds, bounds[1:]):
            for i in range(a, b):
                assert before[i] == max((j for j in range(a, i) if less(values[j], values[i])), default=-1)
                assert after[i] == min((j for j in range(i + 1, b) if less(values[j], values[i])), default=-1)
    rng, n = random.Random(1), len(values)
    asked = [(rng.randint(-1, n), rng.randint(-1, n)) for _ in range(20)]
    found = k.RangeMinimum(values).places(np.array([x for x, _ in asked]), np.array([y for _, y in asked]))
    assert found.tolist() == [x + int(np.argmin(values[x : y + 1])) if 0 <= x <= y < n else -1 for x, y in asked]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc", max_size=25), st.text(alphabet="abc", max_size=25))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    pairs = k.common_subsequence(a, b)
    assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if a != b and len(a) + len(b) - 2 * len(pairs) > 0:
        assert k.common_subsequence(a, b, 0) is None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-3, 3), max_size=40), st.lists(st.integers(-3, 3), max_size=40), st.integers(2, 9))
def test_copy_parse_decodes(target, source, most):
    made = []
    for start, copied, src, literal in k.copy_parse(np.array(target, np.int64), np.array(source, np.int64), most):
        assert start == len(made) and copied < most
        made += source[src : src + copied] if copied else []
        made += [literal] if literal is not None else []
    assert made == target


def test_small_ones():
    assert k.increasing_length([3, 1, 2, 2, 5, 4]) == [1, 2, 4]
    assert k.increasing_choice([[5, 1], [2], [3, 0], [1]]) == [(0, 1), (1, 2), (2, 3)]
    assert k.commonest_match("abab", "bbca") == [(1, 0), (3, 1)]
    x = np.arange(-5, 6)
    assert k.unzigzag(k.zigzag(x)).tolist() == x.tolist() and k.zigzag(np.array([0, -1, 1, -2])).tolist() == [0, 1, 2, 3]
    h = k.FNV_OFFSET
    for byte in (1, *[0] * 7):
        h = (h ^ byte) * k.FNV_PRIME % 2**64
    assert k.fnv1a([1]) == h


def test_later_rounds_sort_only_open_suffixes(monkeypatch):
    """One long repeat among settled suffixes: the rounds after the first don't sort the whole chunk again."""
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(3000))
    texts = [k.codes(text + "#" + text[:200]), k.codes("banana")]
    sorted_, sort = [], k.sorted_places
    monkeypatch.setattr(k, "sorted_places", lambda *keys: sorted_.append(len(keys[0])) or sort(*keys))
    order = k.suffix_order(texts)
    assert sum(sorted_[1:]) < 2 * sorted_[0] and len(sorted_) > 3
    own = text + "#" + text[:200]
    assert order.sa[: len(own) + 1].tolist() == sorted(range(len(own) + 1), key=lambda i: own[i:])
    assert order.lcp.max() == 200
