import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tallyspark.llm.suffix_array import suffix_array


def brute(symbols):
    return sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_small_alphabets(symbols):
    symbols = [*symbols, 0]
    assert suffix_array(symbols).tolist() == brute(symbols)


def test_runs_periods_and_large_alphabets():
    rnd = random.Random(2)
    cases = [[1] * 300, [1, 2] * 150, [2, 1] * 150, [1, 1, 2] * 90 + [1], list(range(1, 200)), list(range(200, 0, -1)),
             [rnd.randint(1, 10 ** 9) for _ in range(500)], ([rnd.randint(1, 5) for _ in range(70)] + [1]) * 6]
    for symbols in cases:
        assert suffix_array([*symbols, 0]).tolist() == brute([*symbols, 0])


def test_empty():
    assert suffix_array([]).tolist() == [] and suffix_array([0]).tolist() == [0]
