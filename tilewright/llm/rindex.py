"""Run-length index of byte strings, and the matching statistics of other strings against it."""

from __future__ import annotations

import numpy as np

#: Bytes that one step of a comparison takes in.
STRIDE = 16


def dense_ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks in which equal keys are one, and how many there are."""
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    return rank, int(rank[order[-1]]) + 1


def join_strings(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings in one array, each byte raised by one and each string ended by 0, with starts and ends.

    UTF-8 has no bytes 0xF8 to 0xFF, so nothing overflows.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8) + np.uint8(1)
    ends = np.cumsum(sizes + 1) - 1
    return data, ends - sizes, ends


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of strings, with text positions sampled at run ends.

    Strings of one index may belong to different ``parts``: their symbols differ, so a string is
    only matched with those of its own part.  Suffix ranks exist while the index is built;
    what is kept has one entry a run (head, first row, row of the predecessor of the first row,
    positions of the first and last row), besides the bytes that comparisons read.
    """

    def __init__(self, strings: list[bytes], parts: np.ndarray) -> None:
        text, starts, ends = join_strings(strings)
        n = len(text)
        left = np.repeat(ends, ends - starts + 1) - np.arange(n) + 1  # symbols up to and with the end mark
        symbol = text + (np.repeat(parts, ends - starts + 1).astype(np.int64) << 8)
        symbol[ends] = 0
        # prefix doubling from 8-byte words; nothing is read beyond a string's end mark
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        word = np.zeros(n, np.uint64)
        for j in range(8):
            word = (word << np.uint64(8)) | np.where(left > j, padded[j : j + n], 0).astype(np.uint64)
        rank, kinds = dense_ranks(word)
        if len(parts) and parts.max():
            rank, kinds = dense_ranks(((symbol >> 8) << 32) | rank)
        depth, longest = 8, int(left.max(initial=0))
        while depth < longest and kinds < n:
            following = np.zeros(n, np.int64)
            inside = np.flatnonzero(left > depth)
            following[inside] = rank[inside + depth] + 1
            rank, kinds = dense_ranks((rank << 32) | following)
            depth *= 2
        # suffixes that agree to their end marks are in the order of their strings
        order = np.sort((rank << 32) | np.arange(n)) & 0xFFFFFFFF
        row_of = np.empty(n, np.int64)
        row_of[order] = np.arange(n)
        before = symbol[order - 1]
        self.start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        last_row = np.append(self.start[1:], n) - 1
        self.head = before[self.start]
        self.first, self.last = order[self.start], order[last_row]
        self.leads_to = row_of[self.first - 1]
        self.last_row = last_row
        # the runs of each head in row order, to find the nearest run of a symbol
        self.by_head = np.lexsort((self.start, self.head))
        self.sorted_heads = (self.head[self.by_head] << 32) | self.start[self.by_head]
        self.text = np.concatenate([text, np.zeros(STRIDE, np.uint8)])

    def _common(self, data: np.ndarray, at: np.ndarray, here: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols of ``data`` from ``at`` equal those of the text from ``here``, at most ``most``."""
        out = np.zeros(len(at), np.int64)
        live, wide = np.flatnonzero(most > 0), np.arange(STRIDE)
        while len(live):
            done = out[live, None] + wide
            same = (data[at[live, None] + done] == self.text[here[live, None] + done]) & (done < most[live, None])
            whole = same.all(axis=1)
            out[live] += np.where(whole, STRIDE, same.argmin(axis=1))
            live = live[whole]
        return out

    def matching_statistics(self, strings: list[bytes], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lengths, positions, starts, ends): per byte of ``strings``, as ``join_strings`` lays them out, the longest match that starts there.

        All strings stream through the index in step, right to left.  A row stands for a suffix of
        the text with the longest match; if the string's next symbol precedes it, the row moves
        on by the run (LF), else to the nearer end, in length of match, of the run of that symbol
        above or below, whose text position is sampled.
        """
        data, starts, ends = join_strings(strings)
        data = np.concatenate([data, np.full(STRIDE, 255, np.uint8)])
        lengths, positions = np.zeros(len(data) - STRIDE, np.int32), np.zeros(len(data) - STRIDE, np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first, so that those still running are a prefix
        stop, size, shift = ends[order], (ends - starts)[order], parts[order].astype(np.int64) << 8
        runs = len(self.start)
        row, place, matched = np.zeros(len(order), np.int64), np.full(len(order), self.first[0]), np.zeros(len(order), np.int64)
        for step in range(1, int(size.max(initial=0)) + 1):
            k = int(np.searchsorted(-size, -step, side="right"))
            at = stop[:k] - step
            symbol = data[at] + shift[:k]
            run = np.searchsorted(self.start, row[:k], side="right") - 1
            miss = np.flatnonzero(self.head[run] != symbol)
            offset = row[:k] - self.start[run]
            grown = matched[:k] + 1
            place[:k] -= 1
            if len(miss):
                c, most = symbol[miss], matched[miss]
                below = np.searchsorted(self.sorted_heads, (c << 32) | row[miss])
                best = np.full(len(miss), -1, np.int64)
                to_run, to_place, to_offset = run[miss], place[miss] + 2, offset[miss]  # unless found, all stays
                for candidate, end in ((below - 1, True), (below, False)):
                    safe = np.clip(candidate, 0, runs - 1)
                    there = self.by_head[safe]
                    ok = np.flatnonzero((candidate == safe) & (self.head[there] == c))
                    there = there[ok]
                    here = self.last[there] if end else self.first[there]
                    common = self._common(data, at[miss[ok]] + 1, here, most[ok])
                    better = common > best[ok]
                    ok, there, here, common = ok[better], there[better], here[better], common[better]
                    best[ok], to_run[ok], to_place[ok] = common, there, here
                    to_offset[ok] = (self.last_row[there] - self.start[there]) if end else 0
                run[miss], offset[miss], grown[miss], place[miss] = to_run, to_offset, best + 1, to_place - 1
            # a symbol that the text lacks leaves the row where it is, with nothing matched
            row[:k] = np.where(grown > 0, self.leads_to[run] + offset, row[:k])
            matched[:k] = grown
            lengths[at], positions[at] = grown, place[:k]
        return lengths, positions, starts, ends


def late_spans(strings: list[bytes], groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, to): bytes covered by a ``length``-byte string that an earlier string of the same group holds too.

    ``groups`` numbers the groups from 0; the strings of a group stand together, in their order,
    and no string holds the same ``length`` bytes twice.  Everything before a string is a union
    of blocks, one for each bit of its number in the group: a block of 2^b strings whose numbers
    agree with its own above bit b, where its own has that bit set.  So for each bit, from the
    highest, one index holds the earlier half of every pair of blocks, each pair a part of its own, and
    the later half streams through it.  A string that is found whole needs no more search and
    is left out of the indexes, since whatever holds its bytes comes earlier.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    members = np.bincount(groups)
    number = np.arange(len(groups)) - np.repeat(np.cumsum(members) - members, members)
    _, starts, ends = join_strings(strings)
    late = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, bool)
    open_ = sizes >= length
    for bit in reversed(range(int(number.max(initial=0)).bit_length())):
        part = number >> (bit + 1)
        upper = (number >> bit) & 1 == 1
        paired = (part << (bit + 1)) + (1 << bit) < members[groups]
        index_of, query = np.flatnonzero(open_ & ~upper & paired), np.flatnonzero(open_ & upper)
        if not len(index_of) or not len(query):
            continue
        index = RunIndex([strings[i] for i in index_of], part[index_of])
        lengths, _, s, e = index.matching_statistics([strings[i] for i in query], part[query])
        found = np.flatnonzero(lengths >= length)
        owner = np.searchsorted(s, found, side="right") - 1
        late[starts[query[owner]] + found - s[owner]] = True
        marked = np.concatenate([[0], np.cumsum(lengths >= length)])
        open_[query[marked[e] - marked[s] == e - s - length + 1]] = False
    place = np.flatnonzero(late)
    if not len(place):
        return place, place, place
    owner = np.searchsorted(starts, place, side="right") - 1
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + length)])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(place)) - 1
    return owner[head], (place - starts[owner])[head], (place - starts[owner])[tail] + length
