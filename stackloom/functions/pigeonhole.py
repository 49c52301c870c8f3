"""All pairs of strings within an edit distance, by the generalised pigeonhole principle.

A record of
length L may differ from a shorter or equal one by at most
``t = floor((1 - min_identity) * L)`` edits. Its letters (two bits each) are
grouped into contiguous partitions, because an insertion or deletion moves
neighbouring letters together. Partition ``j`` gets a threshold ``t_j`` in
-1..3 with ``sum(t_j + 1) = t + 1``; by the pigeonhole principle some
partition then holds at most ``t_j`` edits, and the edits left and right of it
are bounded by the thresholds on each side, which bounds the shift at which
it can lie. The thresholds are allocated per record by dynamic programming on
candidate counts estimated from the letter-group frequencies of the block, so
a partition that many records share gets a low threshold and a rare one a high
threshold. A partition that may hold one edit is probed through its first 12
letters in four blocks, of which the edit leaves three whole: their nine
letters, with the gap that the edit leaves between them, are looked up among
the sorted nine letters of all texts at the shifts that are allowed. Other
partitions are probed through exact letter groups (so many edits leave one of
their parts whole). The rest of the partition is tested for its threshold, and
survivors are verified by exact edit distance. No step is approximate: every
pair within the bound is found.
"""

from __future__ import annotations

import numpy as np

from stackloom.functions.editdist import EncodedStrings, long_distance, pair_distances, prefix_within

#: complements of the nucleotide letters (fixed values)
COMPLEMENT = str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")
_TWO_BITS = np.array([{65: 0, 67: 1, 71: 2, 84: 3}.get(b, b & 3) for b in range(256)], dtype=np.uint32)
#: patterns longer than this are verified one pair at a time, by integers of arbitrary length
_LONG = 640
#: partitions that one dynamic programme covers; longer records have several, each with the budget of its own letters
_SEGMENT = 32
_CHUNK = 1 << 20
#: times the share of texts that a group of six random letters has, above which thresholds are allocated by cost
_CROWDED = 8
#: letters of a block and of the four blocks of a partition that may hold one edit
_BLOCK, _WINDOW = 3, 12
_WHOLE = _WINDOW - _BLOCK
#: the letters left by an edit in a block: letters before the gap, the gap in the pattern and in the text
_LEFT = [(_WHOLE, 0, 0)] + [(head, _BLOCK, gap) for head in range(_BLOCK, _WHOLE, _BLOCK) for gap in (_BLOCK - 1, _BLOCK, _BLOCK + 1)]
#: sorted letter groups of texts, and seeds that are looked up among them, at once
_SORTED, _LOOKED_UP = 1 << 23, 1 << 18
#: candidates that may be kept more than once
_KEPT = 1 << 21


class _Codes:
    """For each string and position: the 16 letters that follow, nearest
    letter in the lowest bits, two bits a letter."""

    def __init__(self, strings: list[str]):
        raw = [s.encode("latin-1", "replace") for s in strings]
        self.n = len(raw)
        self.length = np.array([len(r) for r in raw], dtype=np.int32)
        self.width = int(self.length.max(initial=0))
        inside = (np.arange(self.width)[None, :] < self.length[:, None])
        flat = np.zeros((self.n, self.width), dtype=np.uint8)
        flat[inside] = _TWO_BITS[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        letters = np.ascontiguousarray(flat.T)
        self.after = np.zeros((self.width + 1, self.n), dtype=np.uint32)
        for y in range(self.width - 1, -1, -1):
            np.left_shift(self.after[y + 1], np.uint32(2), out=self.after[y])
            self.after[y] |= letters[y]

    def before(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The 8 letters that precede, nearest letter in the lowest bits; before the first letter there are zeros."""
        low = np.minimum(at, 8)
        return _REVERSED[self.after[at - low, rows] & np.uint32(0xFFFF)].astype(np.uint32) >> ((8 - low) * 2).astype(np.uint32)


def _first_difference() -> np.ndarray:
    """Number of equal letters at the low end, by the XOR of 8 letters."""
    out = np.full(1 << 16, 8, dtype=np.uint8)
    x = np.arange(1 << 16)
    for k in range(7, -1, -1):
        out[(x >> (2 * k)) & 3 != 0] = k
    return out


_EQUAL_RUN = _first_difference()
_REVERSED = sum((((np.arange(1 << 16) >> (2 * k)) & 3) << (14 - 2 * k) for k in range(8)), np.zeros(1 << 16, dtype=np.int64)).astype(np.uint16)


def _within_one_edit(p: np.ndarray, t: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Whether the first ``r`` (at most 15) letters of ``p`` match a prefix of
    ``t`` with at most one substitution, insertion or deletion."""
    mask = (np.uint32(1) << (r * np.uint32(2))) - np.uint32(1)
    p = p & mask
    x = (p ^ t) & mask
    run = _EQUAL_RUN[x & np.uint32(0xFFFF)].astype(np.uint32)
    further = np.flatnonzero((run == 8) & (r > 8))
    run[further] += _EQUAL_RUN[x[further] >> np.uint32(16)]
    run = np.minimum(run, r)
    done = run * np.uint32(2)
    substituted = (x >> done) >> np.uint32(2) == 0
    inserted = ((p ^ (t >> np.uint32(2))) & mask) >> done == 0
    deleted = (((p >> np.uint32(2)) ^ t) & (mask >> np.uint32(2))) >> done == 0
    return substituted | inserted | deleted


def _frequencies(texts: _Codes, size: int) -> np.ndarray:
    """Share of text positions at which each group of ``size`` letters starts,
    by a fixed stride over positions; it only steers thresholds."""
    mask = np.uint32((1 << 2 * size) - 1)
    count = np.ones(1 << 2 * size)
    for y in range(0, max(1, texts.width - size), 3):
        count += np.bincount(texts.after[y][texts.length >= y + size] & mask, minlength=len(count))
    return count / count.sum()


def allocate(cost: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Thresholds of least total cost. ``cost[n, m, c]`` is the estimated
    candidates of partition m at threshold c - 1 (infinite: not allowed);
    thresholds plus one sum to ``budget[n]``. Returns ``[n, m]``, -1..3."""
    n, m, choices = cost.shape
    top = int(budget.max(initial=0))
    best = np.full((m + 1, top + 1, n), np.inf)
    best[0, 0] = 0
    taken = np.zeros((m, top + 1, n), dtype=np.int8)
    for j in range(m):
        for c in range(choices):
            for b in range(c, top + 1):
                now = best[j, b - c] + cost[:, j, c]
                better = now < best[j + 1, b]
                best[j + 1, b][better] = now[better]
                taken[j, b][better] = c
    out = np.empty((n, m), dtype=np.int64)
    left, rows = budget.copy(), np.arange(n)
    for j in range(m - 1, -1, -1):
        c = taken[j, left, rows].astype(np.int64)
        out[:, j] = c - 1
        left = left - c
    return out


def _in_segments(cost: np.ndarray, units: np.ndarray) -> np.ndarray:
    """``allocate`` for records of any length: each run of ``_SEGMENT`` partitions spends the budget of its own letters, so thresholds
    still add up to the record's."""
    n, m, choices = cost.shape
    if m <= _SEGMENT:
        return allocate(cost, units)
    out = []
    for low in range(0, m, _SEGMENT):
        own = np.clip(units - 2 * low, 0, 2 * _SEGMENT)
        out.append(allocate(cost[:, low : low + _SEGMENT], own))
    return np.concatenate(out, axis=1)


def _allocated(some: np.ndarray, m: int, start: np.ndarray, size: np.ndarray, window: np.ndarray, number: np.ndarray, units: np.ndarray, rate) -> np.ndarray:
    """Thresholds of the first ``m`` partitions of the patterns ``some``, from the letter groups they hold."""
    start, size, window = (x[some, :m] for x in (start, size, window))
    number, units = number[some], units[some]
    cost = np.full((*size.shape, 5), np.inf)
    cost[:, :, 0] = 0
    for c in (1, 2, 3, 4):
        part = size // c
        total = np.zeros(size.shape)
        for k in range(c):
            s0 = start + k * size // c
            total += rate(s0, np.maximum(part, 0), some[:, None])
        # above one edit survivors go straight to verification, which costs far more than a probe
        cost[:, :, c] = np.where((part >= 1) & (size >= c), total * window * (1 if c < 3 else 30), np.inf)
    cost[np.arange(m)[None, :] >= number[:, None], 1:] = np.inf
    return _in_segments(cost, units)


def _seeds(patterns: _Codes, texts: _Codes, bound: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(groups, windows) to probe, for every pattern: exact letter groups, and partitions that may hold one edit and have the letters of a window."""
    n, length, units = patterns.n, patterns.length.astype(np.int64), bound + 1
    m = int(((units + 1) // 2).max())
    number = (units + 1) // 2
    j = np.arange(m)[None, :]
    edge = lambda u: np.minimum(u, units[:, None]) * length[:, None] // units[:, None]
    start, end = edge(2 * j), edge(2 * j + 2)
    size = end - start
    rows = np.arange(n)[:, None]
    shared = {k: _frequencies(texts, k) for k in (2, 3, 4, 5, 6)}

    def rate(at: np.ndarray, want: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Estimated share of texts that hold the group of ``want`` letters at ``at``."""
        code, out = patterns.after[np.minimum(at, patterns.width), rows], np.ones(at.shape)
        for k, f in shared.items():
            hit = np.minimum(want, 6) == k
            out[hit] = f[code[hit] & np.uint32((1 << 2 * k) - 1)]
        return out

    window = np.minimum(2 * j + 1, 2 * (number[:, None] - j) + 1) * 2.0 + 1
    # one edit in each partition, none in the last of an odd number of units; records that share a group with many are allocated
    t = np.clip(units[:, None] - 2 * j, 0, 2) - 1
    shares = np.stack([f[patterns.after[np.minimum(at, patterns.width), rows] & np.uint32(4095)] for f in [shared[6].astype(np.float32)] for at in (start, start + size // 2)])
    crowded = ((shares > _CROWDED / 4096) & (j < number[:, None])).any(axis=(0, 2)) | ((size < _WINDOW) & (j < units[:, None] // 2)).any(axis=1)
    some = np.flatnonzero(crowded)
    if len(some):
        m_some = int(number[some].max())
        t[some] = -1
        t[some, :m_some] = _allocated(some, m_some, start, size, window, number, units, rate)
    cum = np.cumsum(t + 1, axis=1)
    left_bound = cum - (t + 1) + t
    right_bound = units[:, None] - (cum - (t + 1)) - 1
    wide = (t == 1) & (size >= _WINDOW)
    who, which = np.nonzero(wide)
    windows = {"pattern": who, "start": start[who, which], "size": size[who, which], "left": left_bound[who, which], "right": right_bound[who, which]}
    found: list[tuple] = []
    for c in (1, 2, 3, 4):
        who, which = np.nonzero((t == c - 1) & ~wide)
        if not len(who):
            continue
        s, e = start[who, which], end[who, which]
        for k in range(c):
            a, b = s + k * (e - s) // c, s + (k + 1) * (e - s) // c
            span = np.minimum(b - a, 6)
            q = np.where(k == c - 1, b - span, a) if c > 1 else a
            before, after = np.minimum(q - s, 8), np.minimum(e - q - span, 8)
            found.append((who, q, span, before if c < 3 else before * 0, after if c < 3 else after * 0, np.full(len(who), c - 1), left_bound[who, which], right_bound[who, which]))
    names = ("pattern", "start", "span", "before", "after", "edits", "left", "right")
    return {k: np.concatenate(v) for k, v in zip(names, zip(*found))} if found else {k: np.zeros(0, dtype=np.int64) for k in names}, windows


def _nine(code: np.ndarray, head: int, gap: int) -> np.ndarray:
    """The first ``head`` letters and those after ``gap`` more, nine in all, of letter groups."""
    every, low = (1 << 2 * _WHOLE) - 1, (1 << 2 * head) - 1
    if not gap:
        return code & np.uint32(every)
    return (code & np.uint32(low)) | ((code >> np.uint32(2 * gap)) & np.uint32(every - low))


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


def _probe_windows(patterns: _Codes, texts: _Codes, sd: dict[str, np.ndarray], pattern_rank: np.ndarray, text_rank: np.ndarray, pattern_scope: np.ndarray, text_scope: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
    """Candidates, as pattern * number of texts + text, of which a window holds at most one edit.

    Of the four blocks of a window three are whole. If the first is not, they are looked up as nine letters from the second block
    on; if the last is not, as nine letters from the start; else with the gap that a substitution, insertion or deletion leaves."""
    if not len(sd["pattern"]) or not texts.n:
        return []
    kept: list[np.ndarray] = []
    plen, tlen = patterns.length, texts.length
    n_scopes = int(max(pattern_scope.max(), text_scope.max())) + 1
    by_scope = np.argsort(text_scope, kind="stable")
    # texts in blocks that are sorted at once; the texts of a scope are neighbours
    ends = np.cumsum(tlen[by_scope].astype(np.int64))
    text_blocks = np.split(by_scope, np.unique(np.searchsorted(ends, np.arange(_SORTED, int(ends[-1]), _SORTED)))) if int(ends[-1]) > _SORTED else [by_scope]
    for block in text_blocks:
        if not len(block):
            continue
        here = np.zeros(n_scopes, dtype=bool)
        here[text_scope[block]] = True
        seeds = np.flatnonzero(here[pattern_scope[sd["pattern"]]])
        block = block[np.argsort(-tlen[block], kind="stable")]  # those that reach a position are the first
        own_length = tlen[block]
        seeds = seeds[plen[sd["pattern"][seeds]] >= own_length.min()]
        if not len(seeds):
            continue
        id_bits, at_bits = _bits(len(block)), _bits(texts.width + 1)
        seed_bits = _bits(min(len(seeds), _LOOKED_UP))
        exact = _bits(n_scopes) + 2 * _WHOLE + at_bits + max(id_bits, seed_bits) <= 63  # else scopes are only compared afterwards
        scope_of = (lambda x: x.astype(np.uint64)) if exact and n_scopes > 1 else (lambda x: np.zeros(len(x), dtype=np.uint64))
        a_all, s_all = sd["pattern"][seeds], sd["start"][seeds]
        top = scope_of(text_scope[block]) << np.uint64(2 * _WHOLE)
        ids = np.arange(len(block), dtype=np.uint64)
        codes = np.take(texts.after, block, axis=1)
        reach = np.searchsorted(-own_length, -np.arange(texts.width + 1), side="right")  # texts of at least so many letters
        room = np.empty(int(reach[_WHOLE:].sum()), dtype=np.uint64)
        for head, whole, gap in _LEFT:
            keys = room[: int(reach[_WHOLE + gap :].sum())]
            if not len(keys):
                continue
            filled = 0
            for y, n in enumerate(reach[_WHOLE + gap :].tolist()):
                code = keys[filled : filled + n]
                filled += n
                code[:] = _nine(codes[y, :n], head, gap)
                code |= top[:n]
                code <<= np.uint64(at_bits)
                code |= np.uint64(y)
                code <<= np.uint64(id_bits)
                code |= ids[:n]
            keys.sort()
            for lead in (0, _BLOCK) if not gap else (0,):
                for low in range(0, len(seeds), _LOOKED_UP):
                    pick = seeds[low : low + _LOOKED_UP]
                    a, q = a_all[low : low + _LOOKED_UP], s_all[low : low + _LOOKED_UP] + lead
                    # a gap holds one edit, so there are fewer elsewhere; a text is no longer than the pattern
                    spent, moved = (1, gap - whole) if gap else (0, 0)
                    left, right, most = sd["left"][pick] - spent, sd["right"][pick] - spent, bound[a] - spent
                    ok = (left >= 0) & (right >= 0) & (most >= 0)
                    least = np.minimum(np.maximum(q - np.minimum(left, most), 0), (1 << at_bits) - 1)
                    last = np.minimum(q + np.minimum(np.minimum(left, right - moved), (most - moved) // 2 + 1), (1 << at_bits) - 1)
                    ok &= last >= least
                    code = _nine(patterns.after[q, a], head, whole).astype(np.uint64)
                    needle = ((((scope_of(pattern_scope[a]) << np.uint64(2 * _WHOLE)) | code) << np.uint64(at_bits)) | least.astype(np.uint64)) << np.uint64(seed_bits)
                    needle = (needle | np.arange(len(a), dtype=np.uint64))[ok]
                    needle.sort()
                    sid = (needle & np.uint64((1 << seed_bits) - 1)).astype(np.int64)
                    needle >>= np.uint64(seed_bits)
                    beyond = needle + (last - least)[sid].astype(np.uint64)
                    first, until = np.searchsorted(keys, needle << np.uint64(id_bits)), np.searchsorted(keys, (beyond + np.uint64(1)) << np.uint64(id_bits))
                    each = until - first
                    some = np.flatnonzero(each)
                    sid, first, each = sid[some], first[some], each[some]
                    sums = np.cumsum(each)
                    cuts = np.searchsorted(sums, np.arange(_CHUNK, (sums[-1] if len(sums) else 0) + _CHUNK, _CHUNK), side="left") + 1
                    begin = 0
                    for cut in cuts:
                        n = each[begin:cut]
                        if not len(n):
                            continue
                        which = np.repeat(first[begin:cut] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                        seed = sid[begin:cut]
                        begin = cut
                        key = keys[which]
                        length = own_length[key & np.uint64((1 << id_bits) - 1)]
                        longest = plen[a[seed]]
                        near = np.flatnonzero((length <= np.repeat(longest, n)) & (length >= np.repeat(longest - bound[a[seed]].astype(np.int32), n)))
                        rows, key, length = np.repeat(seed, n)[near], key[near], length[near]
                        y = (key >> np.uint64(id_bits)).astype(np.int64) & ((1 << at_bits) - 1)
                        i = a[rows]
                        delta, shift = length - plen[i], y - q[rows]
                        rest = np.abs(delta - shift - moved)
                        near = np.flatnonzero((rest <= right[rows]) & (np.abs(shift) + rest <= most[rows]))
                        b = block[(key[near] & np.uint64((1 << id_bits) - 1)).astype(np.int64)]
                        rows, i, y = rows[near], i[near], y[near]
                        ok = (delta[near] < 0) | (text_rank[b] < pattern_rank[i])
                        if n_scopes > 1:
                            ok &= text_scope[b] == pattern_scope[i]
                        rows, i, b, y = (x[ok] for x in (rows, i, b, y))
                        ok = _window_holds(patterns.after[q[rows], i], texts.after[y, b], sd["size"][pick[rows]] - lead, lead > 0)
                        _keep(kept, i[ok].astype(np.int64) * texts.n + b[ok])
    return kept


def _window_holds(p: np.ndarray, t: np.ndarray, size: np.ndarray, exact: bool) -> np.ndarray:
    """Which hits keep the rest of their partition within one edit, or whole if the edit was in the block before."""
    size = np.minimum(size, 15).astype(np.uint32)
    if exact:
        return (p ^ t) & ((np.uint32(1) << (size * np.uint32(2))) - np.uint32(1)) == 0
    return _within_one_edit(p, t, size)


def _keep(kept: list[np.ndarray], found: np.ndarray) -> None:
    """Add candidates; those found several times are made one before they take much room."""
    kept.append(found)
    if sum(map(len, kept)) > max(_KEPT, 2 * len(kept[0])):
        kept[:] = [np.unique(np.concatenate(kept))]


def _probe(patterns: _Codes, texts: _Codes, pattern_of: np.ndarray, text_of: np.ndarray, rank: np.ndarray, bound: np.ndarray, scope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate (pattern variant, text variant) pairs."""
    seeds, windows = _seeds(patterns, texts, bound)
    plen, tlen = patterns.length, texts.length
    from_left = seeds["left"] <= seeds["right"]
    pattern_rank, text_rank = rank[pattern_of], rank[text_of]
    pattern_scope, text_scope = scope[pattern_of], scope[text_of]
    kept = _probe_windows(patterns, texts, windows, pattern_rank, text_rank, pattern_scope, text_scope, bound)
    several = len(np.unique(scope)) > 1
    for left in (True, False):
        for span in np.unique(seeds["span"]):
            pick = np.flatnonzero((from_left == left) & (seeds["span"] == span))
            if not len(pick):
                continue
            sd = {k: v[pick] for k, v in seeds.items()}
            place = sd["start"] if left else plen[sd["pattern"]] - sd["start"]
            reach = sd["left"] if left else sd["right"]
            order = np.argsort(place, kind="stable")
            sd, place, reach = {k: v[order] for k, v in sd.items()}, place[order], reach[order]
            code = patterns.after[sd["start"], sd["pattern"]] & np.uint32((1 << 2 * span) - 1)
            far = int(reach.max())
            for v in range(max(0, int(place[0]) - far), min(texts.width, int(place[-1]) + far) + 1):
                lo, hi = np.searchsorted(place, [v - far, v + far + 1])
                near = lo + np.flatnonzero(np.abs(place[lo:hi] - v) <= reach[lo:hi])
                if not len(near):
                    continue
                if left:
                    valid = np.flatnonzero(tlen >= v + span)
                    at = np.full(len(valid), v)
                else:
                    valid = np.flatnonzero((tlen >= v) & (v >= span))
                    at = tlen[valid] - v
                if not len(valid):
                    continue
                own = (texts.after[at, valid] & np.uint32((1 << 2 * span) - 1)).astype(np.uint16)
                by = np.argsort(own, kind="stable")
                count = np.bincount(own, minlength=1 << 2 * int(span))
                first = np.cumsum(count) - count
                each = count[code[near]]
                near, each = near[each > 0], each[each > 0]
                ends = np.cumsum(each)
                cuts = np.searchsorted(ends, np.arange(_CHUNK, (ends[-1] if len(ends) else 0) + _CHUNK, _CHUNK), side="left") + 1
                low = 0
                for cut in cuts:
                    seed, some = near[low:cut], each[low:cut]
                    low = cut
                    if not len(seed):
                        continue
                    total = int(some.sum())
                    sid = np.repeat(seed, some)
                    within = np.arange(total) - np.repeat(np.cumsum(some) - some, some)
                    which = by[np.repeat(first[code[seed]], some) + within]
                    b = valid[which]
                    a = sd["pattern"][sid]
                    delta = tlen[b] - plen[a]
                    ok = (delta <= 0) & (-delta <= bound[a])
                    ok &= (delta < 0) | (text_rank[b] < pattern_rank[a])
                    if several:
                        ok &= text_scope[b] == pattern_scope[a]
                    keep = np.flatnonzero(ok)
                    a, b, sid, delta, y = a[keep], b[keep], sid[keep], delta[keep], at[which[keep]]
                    shift = y - sd["start"][sid]
                    rest = np.abs(delta - shift)
                    keep = np.flatnonzero((np.abs(shift) <= sd["left"][sid]) & (rest <= sd["right"][sid]) & (np.abs(shift) + rest <= bound[a]))
                    a, b, sid, y = a[keep], b[keep], sid[keep], y[keep]
                    keep = _partition_holds(patterns, texts, sd, sid, a, b, y, int(span))
                    _keep(kept, a[keep].astype(np.int64) * texts.n + b[keep])
    keys = np.unique(np.concatenate(kept)) if kept else np.zeros(0, dtype=np.int64)
    return keys // max(1, texts.n), keys % max(1, texts.n)


def _partition_holds(patterns: _Codes, texts: _Codes, sd: dict, sid: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray, span: int) -> np.ndarray:
    """Which hits keep their partition within its threshold around the group."""
    q, edits = sd["start"][sid], sd["edits"][sid]
    after, before = sd["after"][sid].astype(np.uint32), sd["before"][sid].astype(np.uint32)
    ok = np.ones(len(a), dtype=bool)
    for need, side in ((after, "after"), (before, "before")):
        rows = np.flatnonzero(ok & (need > 0))
        if not len(rows):
            continue
        r = need[rows]
        if side == "after":
            p, t = patterns.after[q[rows] + span, a[rows]], texts.after[y[rows] + span, b[rows]]
        else:
            p, t = patterns.before(q[rows], a[rows]), texts.before(y[rows], b[rows])
        one = edits[rows] > 0
        same = (p ^ t) & ((np.uint32(1) << (r * np.uint32(2))) - np.uint32(1)) == 0
        good = same.copy()
        loose = np.flatnonzero(one & ~same)
        good[loose] = _within_one_edit(p[loose], t[loose], r[loose])
        ok[rows[~good]] = False
    return np.flatnonzero(ok)


def _orders(record: str) -> list[str]:
    mates = record.split("|")
    if len(mates) == 2 and mates[0] and mates[1] and mates[0] != mates[1]:
        return [mates[0] + mates[1], mates[1] + mates[0]]
    return ["".join(mates)]


def match_cell(records: list[str], is_pattern: np.ndarray, is_text: np.ndarray, rank: np.ndarray, min_identity: float, scope: np.ndarray | None = None, both_strands: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All matches between patterns and texts of one cell as (pattern row,
    text row, distance). Of a pair the longer record is the pattern; of equal
    lengths the one of the higher ``rank``. Mates are joined by ``|``. Where a
    cell holds several samples, ``scope`` numbers them and only records of one match.
    Without ``both_strands`` records are compared as they stand."""
    scope = np.zeros(len(records), dtype=np.int64) if scope is None else scope
    share = 1 - min_identity
    length = np.array([len(r) - (r.count("|") if "|" in r else 0) for r in records], dtype=np.int64)
    bound = np.floor(share * length + 1e-9).astype(np.int64)
    p_text, p_of, t_text, t_of = [], [], [], []
    for i in np.flatnonzero(is_pattern):
        for s in _orders(records[i]):
            for v in dict.fromkeys((s, s.translate(COMPLEMENT)[::-1])) if both_strands else (s,):
                p_text.append(v)
                p_of.append(i)
    for i in np.flatnonzero(is_text):
        for s in _orders(records[i]):
            t_text.append(s)
            t_of.append(i)
    z = np.zeros(0, dtype=np.int64)
    if not p_text or not t_text:
        return z, z, z
    p_of, t_of = np.array(p_of), np.array(t_of)
    a, b = _probe(_Codes(p_text), _Codes(t_text), p_of, t_of, rank, bound[p_of], scope)
    if not len(a):
        return z, z, z
    d = _verified(p_text, t_text, a, b, bound[p_of[a]])
    good = d <= bound[p_of[a]]
    a, b, d = p_of[a[good]], t_of[b[good]], d[good]
    order = np.lexsort((d, b, a))
    a, b, d = a[order], b[order], d[order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first], d[first]


def _verified(p_text: list[str], t_text: list[str], a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Edit distances of candidates; some value above the limit where they exceed it."""
    out = limit + 1
    long = np.array([len(s) > _LONG for s in p_text])[a]
    short = np.flatnonzero(~long)
    if len(short):
        used_a, x = np.unique(a[short], return_inverse=True)
        used_b, y = np.unique(b[short], return_inverse=True)
        enc = EncodedStrings([p_text[k] for k in used_a] + [t_text[k] for k in used_b], len(used_a))
        near = np.flatnonzero(prefix_within(enc, x, y + len(used_a), limit[short]))
        short, x, y = short[near], x[near], y[near]
        out[short] = pair_distances(enc, x, y + len(used_a), limit[short])
    for k in np.flatnonzero(long):
        if _letters_agree(p_text[a[k]], t_text[b[k]], limit[k]):
            out[k] = long_distance(p_text[a[k]], t_text[b[k]])
    return out


def _letters_agree(x: str, y: str, bound: int) -> bool:
    """Letter counts of strings within ``bound`` edits differ by at most that."""
    return sum(abs(x.count(c) - y.count(c)) for c in set(x) | set(y)) <= 2 * bound
