"""The weighted text ratio of 0 to 100 that name suggestions use, and an upper bound on it."""

from __future__ import annotations

import difflib
import re

import numpy as np

#: Letters and digits that a profile counts apart; others share the rest of its bins.
_BINS = 64
# Scale of ratios over rearranged words, of partial ratios, and of partial ratios of texts of very different length; the
# factors of length from which partial ratios and the last scale apply.
REARRANGED, PARTIAL, FAR_PARTIAL = 0.95, 0.90, 0.60
LONGER, MUCH_LONGER = 1.5, 8.0


def plain(text: str) -> str:
    """Lower-case ASCII letters, digits and blanks of a text."""
    ascii_only = text.encode("ascii", "ignore").decode()
    return re.sub(r"[^A-Za-z0-9]", " ", ascii_only).lower().strip()


def ratio(a: str, b: str) -> int:
    if not a or not b:
        return 0
    return 100 if a == b else round(100 * difflib.SequenceMatcher(None, a, b).ratio())


def partial_ratio(a: str, b: str) -> int:
    """Best ratio of the shorter text with a stretch of the longer one, as long as itself, where matching pieces line up."""
    if not a or not b:
        return 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = 0.0
    for block in difflib.SequenceMatcher(None, short, long).get_matching_blocks():
        start = max(block.b - block.a, 0)
        best = max(best, difflib.SequenceMatcher(None, short, long[start : start + len(short)]).ratio())
        if best > 0.995:
            return 100
    return round(100 * best)


def _word_ratios(a: str, b: str, compare) -> int:
    """The better of comparing sorted words, and common words with the rest of either side."""
    by_order = compare(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    one, two = set(a.split()), set(b.split())
    common = " ".join(sorted(one & two))
    left = f"{common} {' '.join(sorted(one - two))}".strip()
    right = f"{common} {' '.join(sorted(two - one))}".strip()
    return max(by_order, compare(common, left), compare(common, right), compare(left, right))


def weighted_ratio(a: str, b: str) -> int:
    """The largest of the plain ratio and the scaled word and partial ratios; both texts are taken in their plain form."""
    a, b = plain(a), plain(b)
    if not a or not b:
        return 0
    base = ratio(a, b)
    factor = max(len(a), len(b)) / min(len(a), len(b))
    if factor < LONGER:
        return round(max(base, REARRANGED * _word_ratios(a, b, ratio)))
    scale = FAR_PARTIAL if factor > MUCH_LONGER else PARTIAL
    return round(max(base, scale * partial_ratio(a, b), REARRANGED * scale * _word_ratios(a, b, partial_ratio)))


class Names:
    """Known names with profiles, to find the best of them for another name."""

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        self.plain = [plain(n) for n in self.names]
        self.profiles = np.array([_profile(p) for p in self.plain]).reshape(-1, _BINS)
        self.sizes = np.array([_size(p) for p in self.plain])
        self.words: dict[str, list[int]] = {}
        for i, p in enumerate(self.plain):
            for w in set(p.split()):
                self.words.setdefault(w, []).append(i)

    def best(self, name: str, threshold: int) -> tuple[int, str] | None:
        """The highest ratio of at least ``threshold`` and its name, ties to the smaller name.

        With ``m`` signs in both texts, each counted as often as in both, and ``n`` signs in the different words of the shorter one, no
        ratio of texts without a common word exceeds ``2 m / (n + m)``; only names above that bound, or with a common word, are compared.
        """
        text = plain(name)
        if not text or not self.names:
            return None
        shared = np.minimum(self.profiles, _profile(text)).sum(axis=1)
        near = 200 * shared >= (threshold - 1) * (np.minimum(self.sizes, _size(text)) + shared)
        near[[i for w in set(text.split()) for i in self.words.get(w, [])]] = True
        found = None
        for i in np.flatnonzero(near).tolist():
            score = weighted_ratio(text, self.plain[i])
            if score >= threshold and (found is None or score > found[0]):
                found = score, self.names[i]
        return found


def _profile(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode(), np.uint8) % _BINS, minlength=_BINS)


def _size(text: str) -> int:
    """Signs of the different words of a text, which is the least that any of its ratios counts."""
    words = set(text.split())
    return sum(map(len, words)) + max(len(words) - 1, 0)
