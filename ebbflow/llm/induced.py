"""Suffix sorting of one shard by induction, with common-prefix values and queues on disk.

Types and S* suffixes (those that start a rise after a fall) are found first.  The S* substrings are sorted and
named, and the string of names, about a third as long, is sorted in turn: by its substrings, first of as many names
as fit a number, then of twice the length in each round, among those that still agree, until none do or the cap is
reached.  From the sorted S* suffixes the L suffixes are induced in ascending and the S suffixes in descending order:
a suffix taken from the front of the queues sends its predecessor to the end of the queue of that first byte.  Since
a queue only ever receives suffixes in order, one queue a byte is a priority queue.  Every entry carries the length
that it has in common with the entry before it in its queue: one more than the least such length among the entries
taken in between.

Queues lie in unlinked files once a shard exceeds ``in_memory`` bytes, so memory holds what one step takes.
"""

from __future__ import annotations

import tempfile

import numpy as np

CAP = np.uint16(65_535)


def _array(size: int, kind, in_memory: int) -> np.ndarray:
    if size * np.dtype(kind).itemsize <= in_memory:
        return np.zeros(size, kind)
    with tempfile.TemporaryFile() as file:  # the file goes when the array does, also if the task dies
        return np.memmap(file, dtype=kind, mode="w+", shape=(size,))


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``values[first:last + 1]`` for each pair."""
    span = last - first + 1
    level = np.frexp(span.astype(float))[1] - 1
    out, table, width = np.empty(len(first), values.dtype), values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[first[at]], table[last[at] - width + 1])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros past the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:len(text)].copy().view(">u8").reshape(-1)
    return words.byteswap(inplace=True).view("<u8")


def common(words: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, known: np.ndarray | int = 0) -> np.ndarray:
    """Common length of the bytes from ``a`` and from ``b`` on, up to ``cap``; ``known`` bytes are equal for sure."""
    end = len(words)
    # Zeros past the end may agree with zeros of the text: the length to the end limits them afterwards.
    limit = np.minimum(end - np.maximum(a, b), cap)
    out = np.minimum(limit, known)
    alive = np.flatnonzero(out < limit)
    x, y = a[alive] + out[alive], b[alive] + out[alive]
    while alive.size:
        differ = words[x] ^ words[y]
        ends = np.flatnonzero(differ)
        found, at = differ[ends], alive[ends]
        # The bit below the highest is cleared, so that rounding to a float does not reach the next power of two.
        highest = ((found & ~(found >> np.uint64(1))).astype(float).view(np.int64) >> 52) - 1023
        out[at] += (63 - highest) >> 3
        same = differ == 0
        alive, x, y = alive[same], x[same] + 8, y[same] + 8
        out[alive] += 8
        inside = np.maximum(x, y) < end
        inside &= out[alive] < cap
        if not inside.all():
            alive, x, y = alive[inside], x[inside], y[inside]
    return np.minimum(out, limit)


def _sorted_samples(text: np.ndarray, star: np.ndarray, cap: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The S* suffixes in order, as far as ``cap`` bytes decide it, and the length that each has in common with the one before it."""
    n = len(star)
    if not n:
        return star, np.empty(0, np.uint16)
    ends = np.append(star[1:], len(text) - 1)
    length = ends - star + 1  # a substring includes the first byte of the next one
    # Names: the substrings' bytes, eight at a time.  A substring that begins a longer one is the larger of the two:
    # its last byte is of S type, the same byte of the longer one of L type.  So what is past its end counts as high.
    name, done = np.zeros(n, np.int64), 0
    while done < min(int(length.max(initial=0)), cap):
        at = np.flatnonzero(length > done)
        keep = np.minimum(8, length[at] - done)
        past_end = np.where(keep < 8, np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * np.minimum(keep, 7).astype(np.uint64)), np.uint64(0))
        part = words[star[at] + done] | past_end
        if done == 0:
            _, name = np.unique(part, return_inverse=True)
            name = name.astype(np.int64)
        else:
            _, small = np.unique(part, return_inverse=True)
            step = np.full(n, len(at) + 1, np.int64)
            step[at] = small
            _, name = np.unique(name * (int(step.max()) + 1) + step, return_inverse=True)
            name = name.astype(np.int64)
        done += 8
    # Recursion: the string of names, sorted by ever longer parts of itself.  A rank is the place of its group's
    # first member, so only members of groups that are not yet split take part in a round.
    # The first rounds are one: as many names as fit a number of 63 bits, zeros past the last.
    name, width = name + 1, 1
    bits = int(name.max()).bit_length()
    while 2 * width * bits <= 63:
        name = (name << (width * bits)) | np.append(name, np.zeros(width, np.int64))[width:]
        width *= 2
    order = np.argsort(name)
    rank, place, agree = np.empty(n, np.int64), np.arange(n), np.zeros(n, np.int32)

    def settle(slots):
        """Ranks of the members at ``slots``, sorted by ``value``; returns the slots of groups of several."""
        head = np.ones(len(slots), bool)
        head[1:] = (value[1:] != value[:-1]) | (slots[1:] != slots[:-1] + 1)
        first = np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))
        rank[order[slots]] = slots[first]
        agree[slots[~head]] = width  # in names, with the slot before, whoever of the group ends there
        alone = head & np.append(head[1:], True)
        return slots[~alone]

    value = name[order]
    slots = settle(place)
    del name, place, ends, length
    while slots.size:
        member = order[slots]
        # A group whose members have all been seen for ``cap`` bytes stays as it is.
        follow = member + width
        seen = np.where(follow < n, star[np.minimum(follow, n - 1)], len(text) + cap) - star[member]
        short = np.zeros(n, bool)
        short[rank[member[seen < cap]]] = True
        slots = slots[short[rank[member]]]
        if not slots.size:
            break
        member = order[slots]
        after = np.where(member + width < n, rank[np.minimum(member + width, n - 1)] + 1, 0)
        key = rank[member] * (n + 1) + after
        by = np.argsort(key)
        order[slots], value = member[by], key[by]
        width *= 2
        slots = settle(slots)
    stars, sorted_rank = star[order], rank[order]
    shared = np.zeros(n, np.uint16)
    shared[1:] = cap
    open_ = np.flatnonzero(sorted_rank[1:] != sorted_rank[:-1]) + 1
    follow = order[open_] + agree[open_]
    known = np.where(follow < n, star[np.minimum(follow, n - 1)] - stars[open_], 0)
    shared[open_] = common(words, stars[open_ - 1], stars[open_], cap, known)
    return stars, shared


def suffix_order(text: np.ndarray, cap: int, in_memory: int = 1 << 28) -> tuple[np.ndarray, np.ndarray]:
    """All places of ``text`` (bytes, the last one 0) in the order of their suffixes, and the length that each has in common with the one before it.

    Order and lengths count ``cap`` bytes; suffixes that agree so far come in any order.
    """
    n, kind = len(text), np.int32 if len(text) < 1 << 31 else np.int64
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint16)
    cap = min(cap, int(CAP) - 1)
    # Types, from the next place with another byte; ``run`` is how long the byte repeats.
    change = np.append(text[1:] != text[:-1], True)
    at = np.where(change, np.arange(n), n)
    end = np.minimum.accumulate(at[::-1])[::-1]
    run = np.minimum(end - np.arange(n) + 1, cap).astype(np.uint16)
    after = np.append(text, 0)[end + 1].astype(np.int16)
    after[end == n - 1] = -1
    small = text < after  # S type: smaller than its successor
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    words = words_at(text)
    counts = np.bincount(text, minlength=256)
    large_counts = np.bincount(text[~small], minlength=256)
    bucket = np.concatenate([[0], np.cumsum(counts)])
    order, shared = _array(n, kind, in_memory), _array(n, np.uint16, in_memory)

    stars, star_lcp = _sorted_samples(text, star, cap, words)
    star_from = np.searchsorted(text[stars], np.arange(257))

    def send(places, lcp, want_small, fill, since, step):
        """Send the predecessors of ``places``, taken in this order, to the ends of their queues."""
        since[:] = np.minimum(since, lcp.min(initial=CAP))
        before = places - 1
        ok = np.flatnonzero((before >= 0) & (small[before] == want_small))
        if not ok.size:
            return
        before = before[ok]
        char = text[before]
        by = np.argsort(char, kind="stable")
        ok, before, char = ok[by], before[by], char[by]
        head = np.ones(len(char), bool)
        head[1:] = char[1:] != char[:-1]
        first = np.flatnonzero(head)
        chars, sizes = char[first], np.diff(np.append(first, len(char)))
        least = np.empty(len(char), np.uint16)
        least[~head] = _range_min(lcp, ok[:-1][~head[1:]] + 1, ok[1:][~head[1:]])
        upto = np.minimum.accumulate(lcp)
        least[head] = np.minimum(past[chars], upto[ok[first]])
        rest = np.minimum.accumulate(np.append(lcp, CAP)[::-1])[::-1]
        since[chars] = rest[ok[first + sizes - 1] + 1]
        nth = np.arange(len(char)) - np.repeat(first, sizes)
        slot = np.repeat(fill[chars], sizes) + step * nth
        order[slot] = before
        shared[slot] = np.minimum(least.astype(np.int64) + 1, cap)
        fill[chars] += step * sizes

    # L suffixes, ascending.  The end of the text comes before all others: its predecessor starts the first queue.
    fill = bucket[:-1].copy()
    since = np.zeros(256, np.uint16)
    past = since.copy()
    order[fill[text[-1]]] = n - 1
    fill[text[-1]] += 1
    taken = bucket[:-1].copy()
    for c in np.flatnonzero(counts):
        fresh = True
        while taken[c] < fill[c]:
            lo, hi = taken[c], fill[c]
            taken[c] = hi
            lcp = np.array(shared[lo:hi])
            if fresh:
                lcp[0], fresh = 0, False
            past = since.copy()
            send(np.array(order[lo:hi], np.int64), lcp, False, fill, since, 1)
        places = stars[star_from[c]:star_from[c + 1]]
        if len(places):
            lcp = star_lcp[star_from[c]:star_from[c + 1]].copy()
            lcp[0] = 0 if fresh else np.minimum(run[order[taken[c] - 1]], run[places[0]])
            past = since.copy()
            send(places, lcp, False, fill, since, 1)

    # S suffixes, descending; an entry's value is what it has in common with the entry after it in the order.
    fill = bucket[1:] - 1
    since = np.zeros(256, np.uint16)
    for c in np.flatnonzero(counts)[::-1]:
        top = bucket[c + 1] - 1
        next_, fresh = top, True
        while fill[c] < next_:
            hi, lo = next_, fill[c] + 1
            next_ = fill[c]
            places, lcp = np.array(order[lo:hi + 1], np.int64)[::-1], np.array(shared[lo:hi + 1])[::-1].copy()
            if fresh:
                lcp[0], fresh = 0, False
            past = since.copy()
            send(places, lcp, True, fill, since, -1)
        lo, hi = bucket[c], bucket[c] + large_counts[c]
        if hi > lo:
            places, own = np.array(order[lo:hi], np.int64)[::-1], np.array(shared[lo:hi])
            # Going down, each L entry is compared with the one above it.
            lcp = np.concatenate([[0 if fresh else min(run[order[hi - 1]], run[order[hi]])], own[1:][::-1]]).astype(np.uint16)
            past = since.copy()
            send(places, lcp, True, fill, since, -1)
    # S entries hold the value towards their successor: move it to the successor; join the two kinds.
    out = np.array(shared)
    for c in np.flatnonzero(counts):
        lo, mid, hi = bucket[c], bucket[c] + large_counts[c], bucket[c + 1]
        if hi - mid > 1:
            out[mid + 1:hi] = shared[mid:hi - 1]
        if hi > mid:
            out[mid] = min(run[order[mid - 1]], run[order[mid]]) if mid > lo else 0
        out[lo] = 0
    return order, out
