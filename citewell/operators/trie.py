"""A token trie as arrays: phrases of tokens, looked up for all tokens of many texts at once."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Trie:
    """Node 0 is the root; node i + 1 is reached by ``edges[i]``, its parent's number times ``width`` plus a token's number."""

    tokens: pa.Array  # distinct tokens; a token's number is its place
    edges: np.ndarray  # sorted
    ends: np.ndarray  # per node: the phrase that ends there, or -1
    phrases: pa.Array
    canonical: pa.Array  # null: an absorber
    longest: int

    @property
    def width(self) -> int:
        return max(1, len(self.tokens))

    def numbers(self, tokens: pa.Array) -> np.ndarray:
        """The tokens' numbers, -1 for those of no phrase; each distinct token is looked up once."""
        coded = pc.dictionary_encode(tokens)
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return known[coded.indices.to_numpy(zero_copy_only=False)] if len(tokens) else np.zeros(0, np.int64)

    def matches(self, numbers: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, length and phrase of all phrases; ``left`` counts each place's tokens up to the end of its text."""
        at, node = np.flatnonzero(numbers >= 0), None
        node = np.zeros(len(at), np.int64)
        found = []
        for n in range(1, self.longest + 1):
            inside = left[at] >= n
            at, node = at[inside], node[inside]
            token = numbers[at + n - 1]
            known = token >= 0
            at, node, token = at[known], node[known], token[known]
            edge = node * self.width + token
            place = np.minimum(np.searchsorted(self.edges, edge), max(0, len(self.edges) - 1))
            hit = self.edges[place] == edge if len(self.edges) else np.zeros(len(edge), bool)
            at, node = at[hit], place[hit] + 1
            end = self.ends[node]
            full = end >= 0
            found.append((at[full], np.full(int(full.sum()), n), end[full]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def build(phrases: pa.Array, canonical: pa.Array, longest: int) -> Trie:
    """The trie of phrases, tokens parted by single spaces; those of more than ``longest`` tokens are left out."""
    lists = pc.split_pattern(phrases, " ")
    short = pc.less_equal(lists.value_lengths(), longest)
    phrases, canonical, lists = (x.filter(short) for x in (phrases, canonical, lists))
    coded = lists.flatten().dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(coded.dictionary))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    parent = np.zeros(len(sizes), np.int64)
    edges, ends = [], [np.full(1, -1, np.int64)]
    total = 0
    for n in range(int(sizes.max(initial=0))):
        alive = np.flatnonzero(sizes > n)
        level, place = np.unique(parent[alive] * width + number[starts[alive] + n], return_inverse=True)
        end = np.full(len(level), -1, np.int64)
        last = sizes[alive] == n + 1
        end[place[last]] = alive[last]
        parent[alive] = total + 1 + place
        edges.append(level), ends.append(end)
        total += len(level)
    flat = np.concatenate(edges) if edges else np.zeros(0, np.int64)
    return Trie(coded.dictionary, flat, np.concatenate(ends), phrases, canonical, longest)


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    return np.fromiter((int.from_bytes(blake2b(w, digest_size=8).digest()) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def _append(h: np.ndarray, token: np.ndarray) -> np.ndarray:
    """What stands for spans that are one token longer."""
    return h * np.uint64(0x9E3779B97F4A7C15) + token


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def phrase_hashes(phrases: pa.Array, longest: int) -> np.ndarray:
    """A hash of each phrase; of more than ``longest`` tokens only the first count."""
    lists = pc.split_pattern(phrases, " ")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    token = _hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    starts, h = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.uint64)
    for n in range(longest):
        alive = np.flatnonzero(sizes > n)
        h[alive] = _append(h[alive], token[starts[alive] + n])
    return _mix(h)


def hash_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a map of 2^``bits`` bits, at most 2^32."""
    return h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)


def _is_set(filled: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (filled[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def hashes_in_map(tokens: pa.Array, left: np.ndarray, longest: int, filled: np.ndarray, bits: int) -> np.ndarray:
    """The hashes of all spans of ``longest`` tokens at most that a map holds; ``left`` as for ``matches``."""
    coded = tokens.dictionary_encode()
    token = _hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    at, h = np.arange(len(token)), np.zeros(len(token), np.uint64)
    found = []
    for n in range(1, longest + 1):
        inside = left[at] >= n
        at, h = at[inside], h[inside]
        h = _append(h, token[at + n - 1])
        whole = _mix(h)
        one, two = hash_places(whole, bits)
        hit = np.flatnonzero(_is_set(filled, one))
        found.append(whole[hit[_is_set(filled, two[hit])]])
    return np.concatenate(found)


def first_to_last(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of the spans, sorted by place, a scan takes that goes on after each span it took."""
    after = np.searchsorted(at, at + n).tolist()
    taken, i = [], 0
    while i < len(after):
        taken.append(i)
        i = after[i]
    return np.array(taken, np.int64)
