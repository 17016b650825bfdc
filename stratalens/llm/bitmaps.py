"""Compressed sets of 65,536 neighbouring integers that tell how many members are smaller than a value.

Each is stored in the smallest of three forms: a list of members, runs, or bits. A member that occurs several
times is noted once more with its further occurrences, which count in ranks.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTH = 1 << 16
_HEAD = struct.Struct("<BII")
_LIST, _RUNS, _BITS = range(3)


def packed(members: np.ndarray, times: np.ndarray) -> bytes:
    """A set of ascending distinct members, each with the number of its occurrences."""
    border = np.flatnonzero(np.diff(members) != 1)
    first, last = members[np.r_[0, border + 1]], members[np.r_[border, len(members) - 1]]
    size = {_LIST: 2 * len(members), _RUNS: 4 * len(first), _BITS: WIDTH // 8}
    form = min(size, key=size.get)
    if form == _LIST:
        body, entries = members.astype("<u2").tobytes(), len(members)
    elif form == _RUNS:
        body, entries = first.astype("<u2").tobytes() + last.astype("<u2").tobytes(), len(first)
    else:
        bits = np.zeros(WIDTH, bool)
        bits[members] = True
        body, entries = np.packbits(bits, bitorder="little").tobytes(), len(members)
    more = times > 1
    extra = members[more].astype("<u2").tobytes() + (times[more] - 1).astype("<i8").tobytes()
    return _HEAD.pack(form, entries, int(more.sum())) + body + extra


class Ranks:
    """A packed set opened for rank queries: bits are searched through a directory of popcounts."""

    def __init__(self, raw: bytes):
        self.form, entries, extras = _HEAD.unpack_from(raw)
        at = _HEAD.size
        if self.form == _BITS:
            self.words = np.frombuffer(raw, "<u8", WIDTH // 64, at)
            self.directory = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
            at += WIDTH // 8
        elif self.form == _RUNS:
            self.first = np.frombuffer(raw, "<u2", entries, at).astype(np.int64)
            self.last = np.frombuffer(raw, "<u2", entries, at + 2 * entries).astype(np.int64)
            self.directory = np.r_[0, np.cumsum(self.last - self.first + 1)]
            at += 4 * entries
        else:
            self.list = np.frombuffer(raw, "<u2", entries, at).astype(np.int64)
            at += 2 * entries
        self.repeated = np.frombuffer(raw, "<u2", extras, at).astype(np.int64)
        self.further = np.r_[0, np.cumsum(np.frombuffer(raw, "<i8", extras, at + 2 * extras))]

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct members in order, and how often each occurs."""
        if self.form == _BITS:
            members = np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))
        elif self.form == _RUNS:
            length = self.last - self.first + 1
            members = np.repeat(self.first - self.directory[:-1], length) + np.arange(int(length.sum()))
        else:
            members = self.list
        times = np.ones(len(members), np.int64)
        times[np.searchsorted(members, self.repeated)] += np.diff(self.further)
        return members, times

    def __len__(self) -> int:
        """All occurrences."""
        distinct = len(self.list) if self.form == _LIST else int(self.directory[-1])
        return distinct + int(self.further[-1])

    def rank(self, values: np.ndarray) -> np.ndarray:
        """How many occurrences are smaller than each value."""
        if self.form == _BITS:
            word = values >> 6
            below = (np.uint64(1) << (values & 63).astype(np.uint64)) - np.uint64(1)
            found = self.directory[word] + np.bitwise_count(self.words[word] & below)
        elif self.form == _RUNS:
            run = np.searchsorted(self.first, values, "right") - 1
            inside = np.minimum(values - self.first[run], self.last[run] - self.first[run] + 1)
            found = np.where(run < 0, 0, self.directory[run] + inside)
        else:
            found = np.searchsorted(self.list, values)
        return found + self.further[np.searchsorted(self.repeated, values)]

    def repeats(self, values: np.ndarray) -> np.ndarray:
        """Whether each value occurs more than once."""
        return np.isin(values, self.repeated)


def merged(parts: list[bytes]) -> bytes:
    """The union of packed sets, occurrences added up."""
    if len(parts) == 1:
        return parts[0]
    found = [Ranks(p).members() for p in parts]
    members, at = np.unique(np.concatenate([m for m, _ in found]), return_inverse=True)
    times = np.zeros(len(members), np.int64)
    np.add.at(times, at, np.concatenate([t for _, t in found]))
    return packed(members, times)
