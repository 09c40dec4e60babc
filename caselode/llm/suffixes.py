"""Column-wise construction of a collection's Burrows-Wheeler transform and longest common prefixes, in arrays.

All strings are read from their ends: each round inserts one symbol of every string that still has one, that is its
next longer suffix, into the sorted order of all suffixes so far.  The symbols before the suffixes in order (the
transform) say where: the new suffix that begins with c goes behind the suffixes of smaller first symbols and those of
its own that a stable sort of the transform puts before it.  Its common prefix with a neighbour is one more than the
least common prefix between the suffixes that both extend.  Old and new entries are merged in one sequential pass.

A round costs a pass over the whole transform, so that few rounds pay: symbols are of several bytes, and a string goes in
once for each phase of them.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a symbol; it divides the window.
SYMBOL = 5


def insert_columns(data: np.ndarray, first: np.ndarray, lengths: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes) of strings of at most 255 symbols, whose symbols are each ``step``-th of data from ``first``.

    Entries 0 to n - 1 are the n empty suffixes; 0 in the transform means that nothing comes before, c + 1 symbol c."""
    n, kind = len(lengths), np.uint16 if data.max(initial=0) < 0xFFFF else np.uint32
    before, common = np.zeros(n, kind), np.zeros(n, np.uint8)
    place, live = np.arange(n), np.arange(n)
    for length in range(int(lengths.max(initial=0))):
        live = live[lengths[live] > length]
        new = place[live]
        before[new] = data[first[live] + step * (lengths[live] - 1 - length)].astype(kind) + kind(1)
        size = len(before)
        order = np.argsort(before, kind="stable")
        ended = size - int(np.count_nonzero(before))
        owner, fresh = np.zeros(size, np.int32), np.zeros(size, bool)
        owner[new], fresh[new] = live, True
        fresh = fresh[order]
        k = np.flatnonzero(fresh)
        at = n + k - ended
        # Entries whose common prefix changes: the new ones and those that follow one, unless they begin their symbol.
        changed = fresh.copy()
        changed[1:] |= fresh[:-1]
        j = np.flatnonzero(changed)
        low, high = order[j - 1], order[j]
        same = (j > ended) & (before[low] == before[high])
        value = np.zeros(len(j), np.uint8)
        value[same] = _range_minima(common, low[same] + 1, high[same]) + 1
        kept = np.ones(size + len(k), bool)
        kept[at] = False
        wider, longer = np.zeros(len(kept), kind), np.zeros(len(kept), np.uint8)
        wider[kept], longer[kept] = before, common
        longer[n + j - ended] = value
        place[owner[order[k]]] = at
        before, common = wider, longer
    return before, common


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high] for each pair, from the minima of all ranges of a power of two."""
    if not len(low):
        return np.zeros(0, values.dtype)
    level = np.frexp((high - low + 1).astype(np.float32))[1] - 1
    minima = np.empty((int(level.max()) + 1, len(values)), values.dtype)
    minima[0] = values
    for i in range(1, len(minima)):
        half = 1 << (i - 1)
        minima[i] = minima[i - 1]
        np.minimum(minima[i - 1, :-half], minima[i - 1, half:], out=minima[i, :-half])
    return np.minimum(minima[level, low], minima[level, high + 1 - (1 << level)])


def window_minima(data: np.ndarray, first: np.ndarray, lengths: np.ndarray, owners: np.ndarray, window: int, symbol: int = SYMBOL) -> np.ndarray:
    """For each window of each string, strings after one another, the least owner of a string that holds the same window."""
    windows = lengths - window + 1
    offsets = np.cumsum(windows) - windows
    # Symbols at every place, by their values' numbers; places at a string's end that reach into the next one are not read.
    values = np.zeros(max(len(data) - symbol + 1, 0), np.uint64)
    for i in range(symbol):
        values <<= np.uint64(8)
        values |= data[i : len(values) + i]
    _, codes = np.unique(values, return_inverse=True)
    # A string's phases with a window or more; its windows at offset o are suffixes of phase o % symbol.
    phases = np.minimum(windows, symbol)
    of = np.repeat(np.arange(len(lengths)), phases)
    phase = np.arange(len(of)) - np.repeat(np.cumsum(phases) - phases, phases)
    begins, counts = first[of] + phase, (lengths[of] - phase) // symbol
    before, common = insert_columns(codes, begins, counts, symbol)
    n = len(of)
    order = np.argsort(before, kind="stable")
    ended = len(before) - int(np.count_nonzero(before))
    longer = np.empty(len(before), np.int64)
    longer[order[ended:]] = n + np.arange(len(before) - ended)
    places = np.empty(int(windows.sum()), np.int64)
    place, live = np.arange(n), np.arange(n)
    least = np.full(len(before), np.iinfo(np.int64).max)
    for length in range(1, int(counts.max(initial=0)) + 1):
        live = live[counts[live] >= length]
        place[live] = longer[place[live]]
        if length * symbol >= window:
            places[offsets[of[live]] + phase[live] + symbol * (counts[live] - length)] = place[live]
            least[place[live]] = owners[of[live]]
    head = common < window // symbol
    groups = np.minimum.reduceat(least, np.flatnonzero(head)) if len(least) else least
    return groups[(np.cumsum(head.astype(np.int32)) - 1)[places]]
