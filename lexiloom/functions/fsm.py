"""Finite-state machines over long symbol sequences, run as composed state-transition functions.

A sequence is cut into chunks. Each chunk is reduced to the function from the state before it to the state behind it, for
every possible state at once; a parallel prefix scan composes these functions, which gives each chunk its true first
state; a second sweep then yields the state before every symbol. All chunks advance together, one numpy step per
position, so the cost doesn't depend on how the symbols are spread over records.
"""

from __future__ import annotations

import numpy as np


class Machine:
    """``table[state, symbol]`` is the next state; state 0 is the first."""

    def __init__(self, table: np.ndarray, chunk: int = 128):
        self.table = np.ascontiguousarray(table, dtype=np.uint8)
        self.states, self.symbols = self.table.shape
        self.flat = self.table.ravel()
        self.chunk = chunk

    def summaries(self, chunks: np.ndarray) -> np.ndarray:
        """For chunks of equal length, one per row: the state behind it for each state before it."""
        fn = np.broadcast_to(np.arange(self.states, dtype=np.uint8), (len(chunks), self.states))
        for k in range(chunks.shape[1]):
            fn = self.flat[fn.astype(np.int32) * self.symbols + chunks[:, k, None]]
        return fn

    @staticmethod
    def scan(fns: np.ndarray) -> np.ndarray:
        """Inclusive prefix composition of transition functions, in log2(n) parallel steps."""
        out, step = np.array(fns), 1
        while step < len(out):
            nxt = out.copy()
            nxt[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
            out, step = nxt, step * 2
        return out

    def before(self, symbols: np.ndarray) -> np.ndarray:
        """The state before each symbol of one sequence."""
        n = len(symbols)
        if n == 0:
            return np.zeros(0, dtype=np.uint8)
        k = min(self.chunk, n)
        m = -(-n // k)
        padded = np.zeros(m * k, dtype=np.uint8)
        padded[:n] = symbols
        rows = padded.reshape(m, k)
        first = np.zeros(m, dtype=np.uint8)
        if m > 1:
            first[1:] = self.scan(self.summaries(rows[:-1]))[:, 0]
        out = np.empty((m, k), dtype=np.uint8)
        state = first
        for i in range(k):
            out[:, i] = state
            state = self.flat[state.astype(np.int32) * self.symbols + rows[:, i]]
        return out.ravel()[:n]


def code_points(texts: list[str], end: str = "\0") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, each followed by ``end``, and where each begins (one more at the end)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.frombuffer((end.join(texts) + end).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if texts else np.zeros(0, np.uint32)
    return codes, begins


def slices(texts: list[str], most: int = 2_000_000):
    """Index ranges whose texts together stay near ``most`` characters, so that long texts don't fill the memory."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
