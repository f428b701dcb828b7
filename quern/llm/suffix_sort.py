"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, then blind tries.

Multikey quicksort splits a set of strings in three by the byte at the current
depth and goes on with the middle part one byte deeper.  Parts that still share
a prefix of ``shallow`` bytes go into a blind trie, which keeps only branching
bytes and depths: a string descends by those bytes to any leaf, is compared once
with that leaf to find the true common prefix, and branches off there.
"""

from __future__ import annotations


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, step = start, 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(low + step, n)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("depth", "children", "items")

    def __init__(self, depth: int, items: list[int] | None = None) -> None:
        self.depth, self.items, self.children = depth, items, {}


def _byte(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie(strings: list[bytes], members: list[int], depth: int) -> list[tuple[int, int]]:
    """(member, common prefix with the one before) in order; the first has ``depth``."""
    root = _Node(len(strings[members[0]]), [members[0]])
    for m in members[1:]:
        s, node = strings[m], root
        while node.items is None:
            node = node.children.get(_byte(s, node.depth)) or next(iter(node.children.values()))
        leaf = strings[node.items[0]]
        shared = common_prefix(s, leaf, depth)
        if shared == len(s) == len(leaf):
            node.items.append(m)
            continue
        parent, node = None, root
        while node.items is None and node.depth < shared:
            parent, node = node, node.children[_byte(s, node.depth)]
        if node.items is None and node.depth == shared:
            node.children[_byte(s, shared)] = _Node(len(s), [m])
            continue
        fork = _Node(shared)
        fork.children = {_byte(leaf, shared): node, _byte(s, shared): _Node(len(s), [m])}
        if parent is None:
            root = fork
        else:
            parent.children[_byte(s, parent.depth)] = fork
    out: list[tuple[int, int]] = []
    stack = [(root, depth)]
    while stack:
        node, shared = stack.pop()
        if node.items is not None:
            out.append((node.items[0], shared))
            out += [(m, node.depth) for m in node.items[1:]]
            continue
        keys = sorted(node.children, reverse=True)
        for i, key in enumerate(keys):
            stack.append((node.children[key], shared if i == len(keys) - 1 else node.depth))
    return out


def deep_shallow_sort(strings: list[bytes], shallow: int = 8) -> tuple[list[int], list[int]]:
    """Order of ``strings`` and each one's common prefix with the one before it (the first: 0)."""
    order: list[int] = []
    shared: list[int] = []
    stack = [(list(range(len(strings))), 0, 0)]
    while stack:
        members, depth, before = stack.pop()
        if not members:
            continue
        if len(members) == 1:
            order.append(members[0])
            shared.append(before)
            continue
        if depth >= shallow:
            found = blind_trie(strings, members, depth)
            order += [m for m, _ in found]
            shared += [before, *(n for _, n in found[1:])]
            continue
        pivot = _byte(strings[members[len(members) // 2]], depth)
        less, same, more = [], [], []
        for m in members:
            b = _byte(strings[m], depth)
            (same if b == pivot else less if b < pivot else more).append(m)
        parts = [(less, depth, False), (same, depth + 1, pivot == -1), (more, depth, False)]
        todo = []
        for part, deeper, ended in parts:
            if part:
                todo.append((part, deeper, ended, before if not todo else depth))
        for part, deeper, ended, first in reversed(todo):
            if ended:  # equal strings that end here
                stack += [(part[i : i + 1], deeper, depth) for i in range(len(part) - 1, 0, -1)] + [(part[:1], deeper, first)]
            else:
                stack.append((part, deeper, first))
    return order, shared
