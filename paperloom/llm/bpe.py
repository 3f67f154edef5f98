"""Byte-pair merges of many words at once, in numpy.

The symbols of all words lie in one flat array. Each round takes, for every
word, the smallest rank among its adjacent pairs (a segmented minimum), merges
all leftmost non-overlapping occurrences of that pair at once, and compacts the
arrays; words without a pair left are set aside. That equals merging one pair
at a time, leftmost first, as long as no product of a merge can at once take
part in a merge of a smaller rank; products for which the vocabulary allows
that are found in advance, and such a word merges one occurrence in that round.

Long words are first cut where no vocabulary string lies across: no merge can
ever cross such a place. A part that is long all the same (a short string
repeated for pages) takes its merges from a heap, as rounds over it could be as
many as its symbols.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np

NONE = np.int64(1) << 40
#: Symbols from which a word is cut before it is merged, and from which a part is merged by a heap.
CUT, HEAP = 48, 1024


class PairTable:
    """Ranks and products of adjacent pairs, in an open-addressed hash table."""

    def __init__(self, left, right, rank, product, symbols: int):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        rank, product = np.asarray(rank, np.int64), np.asarray(product, np.int64)
        self.symbols = np.int64(symbols)
        keys = left * self.symbols + right
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int64)
        self.product = np.zeros(1 << self.bits, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] < 0
            first = todo[free][np.unique(slot[todo][free], return_index=True)[1]]
            at = slot[first]
            self.keys[at], self.rank[at], self.product[at] = keys[first], rank[first], product[first]
            todo = np.setdiff1d(todo, first, assume_unique=True)
            slot[todo] = np.where(self.keys[slot[todo]] >= 0, (slot[todo] + 1) & ((1 << self.bits) - 1), slot[todo])
        made = np.full(symbols, -1, np.int64)
        np.maximum.at(made, product, rank)
        self.unsafe = np.zeros(symbols, bool)
        self.unsafe[left[rank < made[left]]] = True
        self.unsafe[right[rank < made[right]]] = True
        self.any_unsafe = bool(self.unsafe.any())
        self._pairs, self._trie = (left, right, rank, product), None

    def single(self) -> dict[int, tuple[int, int]]:
        """(rank, product) by left * symbols + right, for one pair at a time."""
        if not hasattr(self, "_single"):
            left, right, rank, product = self._pairs
            self._single = dict(zip((left * self.symbols + right).tolist(), zip(rank.tolist(), product.tolist(), strict=True), strict=True))
        return self._single

    def trie(self) -> tuple[PairTable, np.ndarray]:
        """Prefixes of all products, as (node, symbol) -> node with the nodes' numbers behind the symbols', and whether a node ends a product."""
        if self._trie is None:
            left, right, rank, product = (x.tolist() for x in self._pairs)
            spelled: dict[int, tuple] = {}
            parts = {p: (a, b) for a, b, p in zip(left, right, product, strict=True)}
            for top in parts:  # parts may come in any order, so each is spelled from those it needs
                todo = [top]
                while todo:
                    p = todo[-1]
                    missing = [x for x in parts[p] if x in parts and x not in spelled]
                    if missing:
                        todo += missing
                        continue
                    spelled[p] = sum((spelled.get(x, (x,)) for x in parts[p]), ())
                    todo.pop()
            nodes: dict[tuple, int] = {}
            steps, ends = {}, set()
            for string in spelled.values():
                node = string[0]
                for k in range(1, len(string)):
                    at = nodes.setdefault(string[: k + 1], int(self.symbols) + len(nodes))
                    steps[node, string[k]] = node = at
                ends.add(node)
            size = int(self.symbols) + len(nodes)
            final = np.zeros(size, bool)
            final[list(ends)] = True
            self._trie = PairTable([a for a, _ in steps], [b for _, b in steps], np.zeros(len(steps)), list(steps.values()), size), final
        return self._trie

    def cuts(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where, within words, no product lies across: the places of symbols that may begin a new part."""
        table, final = self.trie()
        reach = np.arange(len(sym)) + 1
        at, node, k = np.arange(len(sym)), np.asarray(sym, np.int64), 1
        while len(at):
            going = (at + k < len(sym)) & (word[np.minimum(at + k, len(sym) - 1)] == word[at])
            at, node = at[going], node[going]
            rank, node = table.find(node, np.asarray(sym, np.int64)[at + k])
            on = rank < NONE
            at, node, k = at[on], node[on], k + 1
            reach[at[final[node]]] = at[final[node]] + k
        if not len(sym):
            return at
        covered = np.maximum.accumulate(reach)
        return np.flatnonzero(np.append(False, (covered[:-1] <= np.arange(1, len(sym))) & (word[1:] == word[:-1])))

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Rank and product of each pair; rank NONE where the pair does not merge. A negative symbol never merges."""
        keys = left * self.symbols + right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        held = self.keys[slot]
        odd = np.flatnonzero((held != keys) & (held >= 0) & (keys >= 0))
        while len(odd):
            slot[odd] = (slot[odd] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[odd]]
            odd = odd[(held != keys[odd]) & (held >= 0)]
        hit = self.keys[slot] == keys
        return np.where(hit, self.rank[slot], NONE), np.where(hit, self.product[slot], -1)


def merge_words(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words after all merges, and the words' new lengths. Words may be empty, and of any length."""
    lengths, symbols = np.asarray(lengths, np.int64), np.asarray(symbols, np.int64)
    if not (lengths > CUT).any():
        return _in_rounds(symbols, lengths, table)
    word = np.repeat(np.arange(len(lengths)), lengths)
    long = lengths[word] > CUT
    at = np.flatnonzero(long)[table.cuts(symbols[long], word[long])]
    begins = np.unique(np.concatenate((at, (np.cumsum(lengths) - lengths)[lengths > 0])))
    sizes = np.diff(np.append(begins, len(symbols)))
    huge = np.flatnonzero(sizes > HEAP)
    if len(huge):
        merged = [_by_heap(symbols[begins[k] : begins[k] + sizes[k]], table) for k in huge.tolist()]
        few = sizes.copy()
        few[huge] = 0
        out, new = _in_rounds(symbols[np.repeat(few > 0, sizes)], few, table)
        before = np.cumsum(new)[huge]
        new[huge] = [len(m) for m in merged]
        out = np.insert(out, np.repeat(before, new[huge]), np.concatenate(merged))
    else:
        out, new = _in_rounds(symbols, sizes, table)
    return out, np.bincount(word[begins], new, len(lengths)).astype(np.int64)


def _by_heap(symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """One word's symbols after all merges, the smallest rank first and of equal ones the leftmost."""
    pairs, width, n = table.single(), int(table.symbols), len(symbols)
    rank, _ = table.find(symbols[:-1], symbols[1:])
    at = np.flatnonzero(rank < NONE)
    heap = np.sort(rank[at] << 32 | at).tolist()
    sym = array("q", symbols.tolist())
    now = array("q", np.append(rank, NONE).tolist())  # rank of the pair that begins at a symbol
    after, ahead = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    none = int(NONE)
    while heap:
        key = heapq.heappop(heap)
        k, r = key & 0xFFFFFFFF, key >> 32
        if now[k] != r:
            continue
        gone = after[k]
        sym[k] = pairs[sym[k] * width + sym[gone]][1]
        now[gone] = none
        after[k] = to = after[gone]
        if to < n:
            ahead[to] = k
        for p, q in ((ahead[k], k), (k, to)):
            if p < 0:
                continue
            found = pairs.get(sym[p] * width + sym[q]) if q < n and sym[p] >= 0 and sym[q] >= 0 else None
            now[p] = found[0] if found else none
            if found:
                heapq.heappush(heap, found[0] << 32 | p)
    kept, k = [], 0
    while k < n:
        kept.append(sym[k])
        k = after[k]
    return np.array(kept, np.int64)


def _in_rounds(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    done: list[tuple[np.ndarray, np.ndarray]] = []
    final = np.zeros(len(lengths), np.int64)
    names = np.flatnonzero(lengths)  # the words that are still merging
    sym, size = np.asarray(symbols, np.int64), lengths[names]
    if not len(names):
        return sym, final
    word = np.repeat(np.arange(len(names)), size)

    def pairs(sym, word):
        rank, product = np.full(len(sym), NONE, np.int64), np.full(len(sym), -1, np.int64)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], product[inside] = table.find(sym[inside], sym[inside + 1])
        return rank, product

    rank, product = pairs(sym, word)
    while True:
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        least = np.minimum.reduceat(rank, start)
        over = least >= NONE
        if over.any():
            keep = ~over[word]
            done.append((np.repeat(names[over], size[over]), sym[~keep]))
            final[names[over]] = size[over]
            sym, rank, product = sym[keep], rank[keep], product[keep]
            names, size, least = names[~over], size[~over], least[~over]
            if not len(names):
                break
            word = np.repeat(np.arange(len(names)), size)
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
        at = np.flatnonzero(rank == least[word])
        # of directly adjacent candidates (a run of one symbol) every second one merges
        fresh = np.concatenate(([True], np.diff(at) != 1))
        head = np.maximum.accumulate(np.where(fresh, at, 0))
        at = at[(at - head) % 2 == 0]
        if table.any_unsafe:
            owner = word[at]
            first = np.concatenate(([True], owner[1:] != owner[:-1]))
            at = at[first | ~table.unsafe[product[at]]]
        sym[at] = product[at]
        gone = np.zeros(len(sym), bool)
        gone[at + 1] = True
        size = size - np.bincount(word[at], minlength=len(size))
        keep = ~gone
        place = np.cumsum(keep) - 1
        rank[at] = product[at] = -1
        sym, word, rank, product = sym[keep], word[keep], rank[keep], product[keep]
        at = place[at]
        again = np.unique(np.concatenate((at, np.maximum(at - 1, 0))))
        rank[again], product[again] = NONE, -1
        again = again[again < len(sym) - 1]
        again = again[word[again] == word[again + 1]]
        rank[again], product[again] = table.find(sym[again], sym[again + 1])
    owners = np.concatenate([o for o, _ in done])
    out = np.concatenate([s for _, s in done])
    return out[np.argsort(owners, kind="stable")], final
