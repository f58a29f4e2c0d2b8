"""Two-stage suffix sorting of one group's text, and common prefixes of neighbours.

Only suffixes that are smaller than their successors are compared with one
another; every other suffix is its first byte in front of a suffix whose place
is known already, so one scan over the buckets of first bytes puts it in
order. Order and common prefixes are exact up to a given depth.
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix of ``text`` is smaller than the one behind it; the
    last run of equal bytes, which the end follows, is not."""
    n = len(text)
    if n == 0:
        return np.zeros(0, bool)
    change = np.flatnonzero(text[1:] != text[:-1])  # last byte of each run but the last
    out = np.zeros(n, bool)
    run = np.searchsorted(change, np.arange(n))
    known = run < len(change)
    at = change[run[known]]
    out[known] = text[at] < text[at + 1]
    return out


def ended(text: np.ndarray, depth: int) -> np.ndarray:
    """The text with bytes behind it in which a suffix smaller than its successor starts at once."""
    return np.concatenate([text, np.array([0], np.uint8), np.full(depth + 16, 255, np.uint8)])


def words64(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian number; zeros follow the end."""
    out = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        more = out << np.uint64(8 * k)
        more[:-k] |= out[k:]
        out = more
    return out[:len(text)]


def sort_suffixes(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``starts[k] .. starts[k] + counts[k] - 1`` of all ``k``, in the order of
    the ``depth`` bytes that follow each. ``starts`` ascend, the ranges do not overlap.

    First stage: the suffixes smaller than their successors, by comparison.
    Second stage: buckets of first bytes in ascending order; the suffixes
    found in a bucket put those one byte longer into their own buckets, in the
    order in which they are met.
    """
    n = len(text)
    if n == 0 or not len(starts):
        return np.zeros(0, np.int64)
    padded = ended(text, depth)
    smaller = smaller_than_next(padded)
    wanted = np.zeros(len(padded) + 1, np.int8)
    np.add.at(wanted, starts, 1)
    np.add.at(wanted, starts + counts, -1)
    asked = np.cumsum(wanted)[:-1] > 0
    # a suffix larger than its successor needs that one, up to the next smaller one
    ends = np.flatnonzero(smaller)
    last = starts + counts - 1
    upto = ends[np.searchsorted(ends, last)]
    wanted[:] = 0
    np.add.at(wanted, starts, 1)
    np.add.at(wanted, np.maximum(upto, last) + 1, -1)
    needed = np.cumsum(wanted)[:-1] > 0
    induced = needed & ~smaller

    raw = padded.tobytes()
    direct = np.flatnonzero(needed & smaller)
    keys = [raw[i:i + depth] for i in direct.tolist()]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)] if keys else direct
    del keys
    first = padded[direct]
    cut = np.searchsorted(first, np.arange(257))  # sorted: the first bytes ascend

    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        bucket = list(heads[c])
        part = np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
        while len(part):  # longer runs of this byte, in the order of the shorter ones
            before = part[part > 0] - 1
            part = before[induced[before] & (padded[before] == c)]
            if len(part):
                bucket.append(part)
        bucket.append(direct[cut[c]:cut[c + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[induced[before] & (padded[before] > c)]
        if len(before):
            byte = padded[before]
            order = np.argsort(byte, kind="stable")
            byte, before = byte[order], before[order]
            edge = np.flatnonzero(np.diff(byte)) + 1
            for run in np.split(before, edge):
                heads[padded[run[0]]].append(run)
        heads[c] = []
    order = np.concatenate(out)
    return order[asked[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray,
                    depth: int) -> np.ndarray:
    """Bytes, ``depth`` at most, that each suffix of ``order`` shares with the one
    in front of it; 0 for the first. All ranges step through their
    positions together: where the partner's successor is sorted in front too, a
    position shares at least one byte less than the one before it in the text,
    so few words are compared twice."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    padded = ended(text, depth)
    words = words64(padded)
    n = len(text)
    place = np.full(n, -1, np.int64)
    place[order] = np.arange(len(order))
    front = np.full(n, -1, np.int64)
    front[order[1:]] = order[:-1]
    live = np.argsort(-counts, kind="stable")  # ranges of many positions first: those still at work are a head
    lane_start, lane_count = starts[live], counts[live]
    shared, partner = np.zeros(len(live), np.int64), np.full(len(live), -1, np.int64)
    for t in range(int(lane_count[0]) if len(live) else 0):
        k = int(np.searchsorted(-lane_count, -t, "left"))  # lanes with more than t positions
        at = lane_start[:k] + t
        other = front[at]
        follow = partner[:k] + 1  # the partner of the position before, moved along
        carried = (partner[:k] >= 0) & (follow < n)
        carried[carried] = (place[follow[carried]] >= 0) & (place[follow[carried]] < place[at[carried]])
        now = np.where(carried, np.maximum(shared[:k] - 1, 0), 0)
        open_ = np.flatnonzero(other >= 0)
        while len(open_):
            x = words[at[open_] + now[open_]] ^ words[other[open_] + now[open_]]
            same = x == 0
            differ = open_[~same]
            if len(differ):
                y = x[~same]
                top = np.zeros(len(y), np.int64)  # equal leading bytes
                for b in range(7):
                    top += (y >> np.uint64(8 * (7 - b))) == 0
                now[differ] += top
            open_ = open_[same]
            now[open_] += 8
            open_ = open_[now[open_] < depth]
        now = np.minimum(now, depth)
        shared[:k], partner[:k] = now, other
        out[place[at]] = now
    return out
