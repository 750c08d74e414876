"""Deep-shallow sorting of byte strings, with the common prefix of neighbours.

Shallow: multikey quicksort, a three-way split on one byte at a time, down to
``shallow`` bytes. Deep: the groups still tied there have long common
prefixes and are put in blind tries, which compare a string with one other
only, and otherwise look at single branching bytes.
"""

from __future__ import annotations

from collections.abc import Sequence


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _byte(s: bytes, at: int) -> int:
    """The byte there, or -1 behind the end, which sorts first."""
    return s[at] if at < len(s) else -1


def shallow_groups(strings: Sequence[bytes], shallow: int) -> list[list[bytes]]:
    """Distinct strings to groups in order; a group's members agree in their first ``shallow`` bytes."""
    out: list[list[bytes]] = []
    waiting = [(list(strings), 0)]
    while waiting:
        group, at = waiting.pop()
        if len(group) < 2 or at >= shallow:
            if group:
                out.append(group)
            continue
        bytes_ = [_byte(s, at) for s in group]
        pivot = sorted((bytes_[0], bytes_[len(group) // 2], bytes_[-1]))[1]
        less = [s for s, c in zip(group, bytes_, strict=True) if c < pivot]
        same = [s for s, c in zip(group, bytes_, strict=True) if c == pivot]
        more = [s for s, c in zip(group, bytes_, strict=True) if c > pivot]
        # the least is taken up next
        waiting += [(more, at), (same, at + 1), (less, at)]
    return out


class BlindTrie:
    """A node is (depth, {byte at that depth: child}); a leaf is a string. Edges don't hold the bytes they skip."""

    def __init__(self, first: bytes) -> None:
        self.root: bytes | tuple = first

    def insert(self, s: bytes) -> None:
        node = self.root
        while not isinstance(node, bytes):  # any leaf will do once the way is lost
            depth, children = node
            child = children.get(_byte(s, depth))
            node = child if child is not None else next(iter(children.values()))
        shared = common_prefix(s, node)
        if shared == len(s) == len(node):
            return
        fork = _byte(node, shared)
        above, node = None, self.root
        while not isinstance(node, bytes) and node[0] < shared:
            above, node = node, node[1][_byte(s, node[0])]
        if not isinstance(node, bytes) and node[0] == shared:
            node[1][_byte(s, shared)] = s
            return
        new = (shared, {fork: node, _byte(s, shared): s})
        if above is None:
            self.root = new
        else:
            above[1][_byte(s, above[0])] = new

    def sorted(self) -> tuple[list[bytes], list[int]]:
        """The strings in order; with each the bytes it shares with the one before it."""
        strings: list[bytes] = []
        shared: list[int] = []
        waiting: list[tuple[bytes | tuple, int]] = [(self.root, 0)]
        while waiting:
            node, before = waiting.pop()
            if isinstance(node, bytes):
                strings.append(node)
                shared.append(before)
                continue
            depth, children = node
            ordered = [children[c] for c in sorted(children)]
            waiting += [(child, depth) for child in ordered[:0:-1]]
            waiting.append((ordered[0], before))
        return strings, shared


def deep_shallow(strings: Sequence[bytes], shallow: int = 8) -> tuple[list[bytes], list[int]]:
    """Distinct strings in order, and with each the bytes it shares with the one before it (0 for the first)."""
    out: list[bytes] = []
    shared: list[int] = []
    for group in shallow_groups(strings, shallow):
        own, within = group, [0]
        if len(group) > 1:
            trie = BlindTrie(group[0])
            for s in group[1:]:
                trie.insert(s)
            own, within = trie.sorted()
        within[0] = common_prefix(out[-1], own[0]) if out else 0
        out += own
        shared += within
    return out, shared
