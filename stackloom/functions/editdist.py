"""Edit distance between many pairs of short strings at once.

The column-wise bit-vector recurrence of Myers (1999), in the block form of
Hyyro (2003), run over numpy arrays: one array element is one pair, so every
Python-level step advances the dynamic programme of a whole block of pairs.
Strings of any length are handled: a pattern of length m uses ceil(m / 64)
words.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_TOP = np.uint64(63)


class EncodedStrings:
    """Strings as padded symbol codes plus the match masks Myers needs.

    ``codes[i, j]`` is the alphabet index of letter ``j`` of string ``i`` and
    ``peq[i, s, w]`` has bit ``b`` set where letter ``64 * w + b`` equals
    symbol ``s``; only the first ``patterns`` strings (default: all) have it.
    """

    def __init__(self, strings: list[str], patterns: int | None = None):
        raw = [s.encode("utf-32-le") for s in strings]
        self.lengths = np.array([len(r) // 4 for r in raw], dtype=np.int64)
        n, width = len(strings), max(1, int(self.lengths.max(initial=1)))
        self.words = (width + 63) // 64
        flat = np.frombuffer(b"".join(raw), dtype=np.uint32)
        top = int(flat.max(initial=0))
        if top < 1 << 16:
            alphabet = np.flatnonzero(np.bincount(flat, minlength=1))
            number = np.zeros(top + 1, dtype=np.uint32)
            number[alphabet] = np.arange(len(alphabet))
            inverse = number[flat]
        else:
            alphabet, inverse = np.unique(flat, return_inverse=True)
        self.symbols = max(1, len(alphabet))
        kind = np.uint8 if self.symbols < 255 else np.uint32
        self.codes = np.full((n, self.words * 64), np.iinfo(kind).max, dtype=kind)
        inside = np.arange(self.words * 64)[None, :] < self.lengths[:, None]
        self.codes[inside] = inverse.astype(kind)
        patterns = n if patterns is None else patterns
        self.peq = np.zeros((patterns, self.symbols + 1, self.words), dtype=np.uint64)
        for s in range(self.symbols):
            bits = np.packbits(self.codes[:patterns] == s, axis=1, bitorder="little")
            self.peq[:, s, :] = bits.view(np.uint64)

    def __len__(self) -> int:
        return len(self.lengths)


def _block(enc: EncodedStrings, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None) -> np.ndarray:
    """Distances of pairs (a[k], b[k]); pattern a, text b."""
    la, lb = enc.lengths[a], enc.lengths[b]
    n, words = len(a), int(max(1, (la.max(initial=1) + 63) // 64))
    score = la.copy()
    vp = np.full((words, n), ~np.uint64(0))
    vn = np.zeros((words, n), dtype=np.uint64)
    last_word, last_bit = np.maximum(la - 1, 0) // 64, (np.maximum(la - 1, 0) % 64).astype(np.uint64)
    alive = np.arange(n)
    out = np.where(la == 0, lb, la)
    score[la == 0] = 0
    text = enc.codes
    live = (lb > 0) & (la > 0)
    if not live.all():
        keep = np.flatnonzero(live)
        alive, a, b, la, lb = alive[keep], a[keep], b[keep], la[keep], lb[keep]
        score, vp, vn, last_word, last_bit = score[keep], vp[:, keep], vn[:, keep], last_word[keep], last_bit[keep]
        limit = None if limit is None else limit[keep]
    for j in range(int(lb.max(initial=0))):
        symbol = np.minimum(text[b, j], enc.symbols).astype(np.int64)
        carry_p, carry_n = np.ones(len(a), dtype=np.uint64), np.zeros(len(a), dtype=np.uint64)
        for w in range(words):
            eq = enc.peq[a, symbol, w]
            p, m = vp[w], vn[w]
            xv = eq | m
            eq |= carry_n
            xh = (((eq & p) + p) ^ p) | eq
            hp = m | ~(xh | p)
            hm = p & xh
            at = last_word == w
            step = ((hp >> last_bit) & _ONE).astype(np.int64) - ((hm >> last_bit) & _ONE).astype(np.int64)
            score += np.where(at, step, 0)
            next_p, next_n = hp >> _TOP, hm >> _TOP
            hp = (hp << _ONE) | carry_p
            hm = (hm << _ONE) | carry_n
            vp[w] = hm | ~(xv | hp)
            vn[w] = hp & xv
            carry_p, carry_n = next_p, next_n
        done = lb == j + 1
        # a pair is given up once even a run of matches cannot bring it under its limit
        drop = done if limit is None else done | (score - (lb - j - 1) > limit)
        if drop.any() and (drop.sum() * 4 >= len(a) or done.any()):
            out[alive[drop]] = score[drop]
            keep = np.flatnonzero(~drop)
            if not len(keep):
                break
            alive, a, b, la, lb = alive[keep], a[keep], b[keep], la[keep], lb[keep]
            score, vp, vn, last_word, last_bit = score[keep], vp[:, keep], vn[:, keep], last_word[keep], last_bit[keep]
            limit = None if limit is None else limit[keep]
    return out


def prefix_within(enc: EncodedStrings, a: np.ndarray, b: np.ndarray, limit: np.ndarray, block: int = 8192) -> np.ndarray:
    """Whether the first 64 letters of pattern a[k] are within ``limit`` of some beginning of text b[k], as they are in every pair that is within it."""
    out = np.empty(len(a), dtype=bool)
    order = np.argsort(enc.lengths[b], kind="stable")
    for at in range(0, len(a), block):
        rows = order[at : at + block]
        p, t, most = a[rows], b[rows], limit[rows]
        length = np.minimum(enc.lengths[p], 64)
        last = np.maximum(length - 1, 0).astype(np.uint64)
        score, best = length.copy(), length.copy()
        vp, vn = np.full(len(rows), ~np.uint64(0)), np.zeros(len(rows), dtype=np.uint64)
        for j in range(int(min(enc.lengths[t].max(), (length + most).max()))):
            eq = enc.peq[p, np.minimum(enc.codes[t, j], enc.symbols).astype(np.int64), 0]
            xv = eq | vn
            xh = (((eq & vp) + vp) ^ vp) | eq
            hp = vn | ~(xh | vp)
            hm = vp & xh
            score += ((hp >> last) & _ONE).astype(np.int64)
            score -= ((hm >> last) & _ONE).astype(np.int64)
            np.minimum(best, score, out=best)
            hp = (hp << _ONE) | _ONE
            hm <<= _ONE
            vp = hm | ~(xv | hp)
            vn = hp & xv
        out[rows] = best <= most
    return out


def long_distance(a: str, b: str) -> int:
    """Distance of two long strings: the same recurrence on one integer of
    arbitrary length, which Python advances a word at a time in C."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for i, letter in enumerate(a):
        masks[letter] = masks.get(letter, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    vp, vn = full, 0
    for letter in b:
        eq = masks.get(letter, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp, hm = vn | (~(xh | vp) & full), vp & xh
        score += bool(hp & top) - bool(hm & top)
        hp, hm = (hp << 1 | 1) & full, hm << 1 & full
        vp, vn = hm | (~(xv | hp) & full), hp & xv
    return score


def pair_distances(enc: EncodedStrings, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None, block: int = 8192) -> np.ndarray:
    """Edit distance of each pair of row numbers; exact where it is within
    ``limit``, otherwise some value above the limit."""
    a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
    out = np.empty(len(a), dtype=np.int64)
    order = np.lexsort((enc.lengths[b], (enc.lengths[a] + 63) // 64))
    for at in range(0, len(a), block):
        rows = order[at : at + block]
        out[rows] = _block(enc, a[rows], b[rows], None if limit is None else limit[rows])
    return out
