"""Vectorised helpers for what columns cannot express: components and labels of small graphs, pair histograms."""

from __future__ import annotations

import numpy as np


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by label spreading with pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    return label


def canonical_order(keys: list, bonds: list[tuple[int, int, int]], elements: list[str]) -> tuple[str, list[int]]:
    """(text, rank of each atom): the same text for equal graphs, however their atoms are numbered. keys order atoms at first.

    Colours are refined by neighbours until stable; ties are broken by trying every atom of the first
    tied colour and keeping the smallest outcome. An atom that some symmetry maps to one tried before is
    skipped: a symmetry is known when two choices, each followed down one path, give the same outcome.
    """
    n = len(keys)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, j, t in bonds:
        near[i].append((j, t))
        near[j].append((i, t))

    def refine(colour: list[int]) -> list[int]:
        while True:
            each = [(colour[i], tuple(sorted((colour[j], t) for j, t in near[i]))) for i in range(n)]
            names = {k: r for r, k in enumerate(sorted(set(each)))}
            new = [names[k] for k in each]
            if len(names) == len(set(colour)):
                return new
            colour = new

    def write(colour: list[int]) -> str:
        edges = sorted((min(colour[i], colour[j]), max(colour[i], colour[j]), t) for i, j, t in bonds)
        order = sorted(range(n), key=lambda i: colour[i])
        return "".join(elements[i] for i in order) + "|" + " ".join(f"{i}-{j}:{t}" for i, j, t in edges)

    def tie(colour: list[int]) -> list[int]:
        """The atoms of the first colour that several have."""
        groups: dict[int, list[int]] = {}
        for i, c in enumerate(colour):
            groups.setdefault(c, []).append(i)
        return next((groups[c] for c in sorted(groups) if len(groups[c]) > 1), [])

    def choose(colour: list[int], own: list[int], k: int) -> list[int]:
        rest = set(own) - {k}
        return refine([2 * c + (i in rest) for i, c in enumerate(colour)])

    def leaf(colour: list[int]) -> list[int]:
        """The end of one path: always the first tied atom."""
        while own := tie(colour):
            colour = choose(colour, own, own[0])
        return colour

    def search(colour: list[int]) -> tuple[str, list[int]]:
        own = tie(colour)
        if not own:
            return write(colour), colour
        like = list(range(n))  # sets of atoms that symmetries join, by their smallest member reached

        def root(i: int) -> int:
            while like[i] != i:
                i = like[i]
            return i

        best, tried = None, []  # tried: (atom, end of its path, what that writes)
        for k in own:
            if any(root(k) == root(t) for t, _, _ in tried):
                continue
            chosen = choose(colour, own, k)
            end = leaf(chosen)
            text = write(end)
            twin = next((e for _, e, x in tried if x == text), None)
            if twin is not None:
                at = {c: i for i, c in enumerate(end)}
                for i in range(n):  # the symmetry takes i to the atom that has i's colour now
                    a, b = root(i), root(at[twin[i]])
                    like[max(a, b)] = min(a, b)
                continue
            tried.append((k, end, text))
            found = search(chosen)
            best = found if best is None or found[0] < best[0] else best
        return best

    names = {e: r for r, e in enumerate(sorted(set(keys)))}
    return search(refine([names[k] for k in keys])) if n else ("", [])


def canonical_label(elements: list[str], bonds: list[tuple[int, int, int]]) -> str:
    """A label that equal molecules share, however their atoms are numbered: 'elements|i-j:type ...'."""
    return canonical_order(elements, bonds, elements)[0]


def pair_histogram(a: np.ndarray, b: np.ndarray, box: np.ndarray, width: float, bins: int, same: bool) -> np.ndarray:
    """Distances between rows of a and b under the nearest image, counted into [i * width, (i + 1) * width), the last bin closed.

    a, b: columns position, x, y, z; same: only pairs with a's position below b's.
    """
    out = np.zeros(bins, np.int64)
    edges = np.arange(bins + 1) * width
    for lo in range(0, len(a), 256):
        part = a[lo : lo + 256]
        d = part[:, None, 1:] - b[None, :, 1:]
        d -= box * np.rint(d / box)
        r = np.sqrt((d * d).sum(2))
        if same:
            r = r[part[:, None, 0] < b[None, :, 0]]
        out += np.histogram(r, edges)[0]
    return out
