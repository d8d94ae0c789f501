"""An adaptive radix tree over byte strings."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

#: Slots of a node's layouts: sorted bytes beside the children up to 16, a byte index of 48 places, one place for each byte.
LAYOUTS = (4, 16, 48, 256)
_FREE = 255


class Node:
    """A node with its compressed path, which begins with the byte that leads to it; `end` is the number of the key that ends here, or -1."""

    __slots__ = ("path", "end", "layout", "slots", "kids")

    def __init__(self, path: bytes, end: int = -1):
        self.path, self.end = path, end
        self.layout, self.slots, self.kids = LAYOUTS[0], bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            i = self.slots.find(byte)
            return self.kids[i] if i >= 0 else None
        if self.layout == 48:
            i = self.slots[byte]
            return self.kids[i] if i != _FREE else None
        return self.kids[byte]

    def add(self, byte: int, kid: Node) -> None:
        """Put a child at a byte that has none; a full layout grows into the next."""
        if self.layout <= 48 and len(self.kids) == self.layout:
            self._grow()
        if self.layout <= 16:
            i = bisect_left(self.slots, byte)
            self.slots.insert(i, byte)
            self.kids.insert(i, kid)
        elif self.layout == 48:
            self.slots[byte] = len(self.kids)
            self.kids.append(kid)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        if self.layout == 16:
            index = bytearray([_FREE]) * 256
            for i, byte in enumerate(self.slots):
                index[byte] = i
            self.slots = index
        elif self.layout == 48:
            self.kids = [self.kids[i] if i != _FREE else None for i in self.slots]
            self.slots = bytearray()
        self.layout = LAYOUTS[LAYOUTS.index(self.layout) + 1]

    def children(self) -> Iterator[Node]:
        return (k for k in self.kids if k is not None)

    def split(self, n: int) -> None:
        """Cut the path after n bytes; what the node held goes one node further down."""
        low = Node(self.path[n:], self.end)
        low.layout, low.slots, low.kids = self.layout, self.slots, self.kids
        self.path, self.end = self.path[:n], -1
        self.layout, self.slots, self.kids = LAYOUTS[0], bytearray([low.path[0]]), [low]


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common at their start."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def insert(root: Node, key: bytes, number: int) -> None:
    node, at = root, 0
    while True:
        if not key.startswith(node.path, at):
            node.split(_shared(node.path, key[at : at + len(node.path)]))
        at += len(node.path)
        if at == len(key):
            node.end = number
            return
        kid = node.child(key[at])
        if kid is None:
            node.add(key[at], Node(key[at:], number))
            return
        node = kid


def tree(keys: Iterable[bytes]) -> Node:
    """The tree of different keys, numbered as they come."""
    root = Node(b"")
    for number, key in enumerate(keys):
        insert(root, key, number)
    return root


def find(root: Node, key: bytes) -> int:
    """The number of a key, or -1."""
    node, at = root, 0
    while node is not None and key.startswith(node.path, at):
        at += len(node.path)
        if at == len(key):
            return node.end
        node = node.child(key[at])
    return -1


def nodes(root: Node) -> list[tuple[Node, int, int, int]]:
    """(node, bytes before its path, bytes with it, place of its parent or -1) of all nodes, parents first."""
    out, stack = [], [(root, -1, 0, -1)]
    while stack:
        node, before, at, parent = stack.pop()
        end = at + len(node.path)
        place = len(out)
        out.append((node, before, end, parent))
        stack += [(k, end, end, place) for k in node.children()]
    return out
