import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.functions.fsm import Machine, code_points, slices


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 5), st.integers(1, 9), st.data())
def test_composed_chunks_equal_the_loop(states, symbols, chunk, data):
    table = np.array(data.draw(st.lists(st.lists(st.integers(0, states - 1), min_size=symbols, max_size=symbols), min_size=states, max_size=states)))
    seq = np.array(data.draw(st.lists(st.integers(0, symbols - 1), max_size=80)), dtype=np.uint8)
    state, expected = 0, []
    for c in seq:
        expected.append(state)
        state = table[state, c]
    assert Machine(table, chunk).before(seq).tolist() == expected


def test_code_points_and_slices():
    codes, begins = code_points(["a", "", "𝒳é"])
    assert begins.tolist() == [0, 2, 3, 6] and chr(codes[3]) == "𝒳"
    assert list(slices(["aa", "bbbb", "c"], 4)) == [(0, 1), (1, 2), (2, 3)]
    assert code_points([])[0].size == 0
