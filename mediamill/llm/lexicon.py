"""A minimal acyclic transducer: words to numbers and from numbers to token ids.

The automaton is built from sorted words with a register of finished states, so equal
suffixes are one state, and every transition carries a number; their sum along a word is
the word's place among all words, which indexes its ids.  Stored as flat arrays (dense
next and output rows over the classes of bytes that occur), it is memory-mapped and
followed for many words at once, one byte of each a step.
"""

from __future__ import annotations

import json

import numpy as np

LONGEST = 32


def build(words: dict[bytes, list[int]]) -> bytes:
    """The transducer of ``words`` (each of 1 to :data:`LONGEST` bytes) with their ids, as a file's bytes."""
    register: dict[tuple, int] = {}
    edges: list[dict[int, int]] = [{}, {}]  # 0 is dead, 1 the start
    final = [False, False]
    path: list[tuple[int, int, int]] = []  # from, byte, to: the last word's states that aren't registered

    def close(depth: int) -> None:
        while len(path) > depth:
            source, byte, state = path.pop()
            key = (final[state], tuple(edges[state].items()))
            known = register.setdefault(key, state)
            edges[source][byte] = known

    ordered = sorted(words)
    last = b""
    for word in ordered:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same)
        state = path[-1][2] if path else 1
        for byte in word[same:]:
            edges.append({})
            final.append(False)
            new = len(edges) - 1
            edges[state][byte] = new
            path.append((state, byte, new))
            state = new
        final[state] = True
        last = word
    close(0)

    number, order, stack = {1: 1}, [1], [1]
    while stack:
        for child in edges[stack.pop()].values():
            if child not in number:
                number[child] = len(number) + 1
                order.append(child)
                stack.append(child)
    below: dict[int, int] = {}

    def count(state: int) -> int:
        if state not in below:
            below[state] = final[state] + sum(count(c) for c in edges[state].values())
        return below[state]

    used = sorted({b for s in order for b in edges[s]})
    classes = np.zeros(256, dtype=np.int32)
    classes[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    follow = np.zeros((len(order) + 1, width), dtype=np.int32)
    add = np.zeros((len(order) + 1, width), dtype=np.int32)
    ends = np.zeros(len(order) + 1, dtype=np.uint8)
    for s in order:
        ends[number[s]] = final[s]
        passed = int(final[s])
        for byte in sorted(edges[s]):
            child = edges[s][byte]
            follow[number[s], classes[byte]] = number[child]
            add[number[s], classes[byte]] = passed
            passed += count(child)
    bounds = np.cumsum([0, *(len(words[w]) for w in ordered)]).astype(np.int32)
    ids = np.array([i for w in ordered for i in words[w]], dtype="<u4")
    parts = {"classes": classes, "next": follow.ravel(), "add": add.ravel(), "final": ends, "bounds": bounds, "ids": ids}
    body, index, at = [], {}, 0
    for name, a in parts.items():
        raw = a.tobytes()
        raw += b"\0" * (-len(raw) % 8)
        index[name] = [at, len(a), a.dtype.str]
        body.append(raw)
        at += len(raw)
    head = json.dumps({"width": width, "arrays": index}).encode()
    head += b" " * (-len(head) % 8)
    return b"MADFA001" + len(head).to_bytes(8, "little") + head + b"".join(body)


class Lexicon:
    """A transducer over the bytes of a file, mapped or held."""

    def __init__(self, data: np.ndarray):
        if bytes(data[:8]) != b"MADFA001":
            raise ValueError("not a lexicon file")
        size = int.from_bytes(bytes(data[8:16]), "little")
        head = json.loads(bytes(data[16 : 16 + size]))
        base = 16 + size
        self.width = head["width"]

        def view(name: str) -> np.ndarray:
            at, n, kind = head["arrays"][name]
            return data[base + at : base + at + n * np.dtype(kind).itemsize].view(kind)

        self.classes, self.next, self.add, self.final, self.bounds, self.ids = (view(x) for x in ("classes", "next", "add", "final", "bounds", "ids"))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1 where the automaton doesn't accept it."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not words or len(self.bounds) < 2:
            return out
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        begin = np.cumsum(size) - size
        rows = np.flatnonzero((size > 0) & (size <= LONGEST))
        state = np.ones(len(rows), dtype=np.int64)
        total = np.zeros(len(rows), dtype=np.int64)
        for depth in range(LONGEST + 1):
            over = size[rows] == depth
            if over.any():
                done, at = rows[over], state[over]
                accepted = self.final[at] > 0
                out[done[accepted]] = total[over][accepted]
                rows, state, total = rows[~over], state[~over], total[~over]
            if not len(rows):
                break
            cell = state * self.width + self.classes[raw[begin[rows] + depth]]
            total = total + self.add[cell]
            state = self.next[cell].astype(np.int64)
            alive = state > 0
            if not alive.all():
                rows, state, total = rows[alive], state[alive], total[alive]
        return out

    def ids_of(self, number: int) -> bytes:
        return self.ids[self.bounds[number] : self.bounds[number + 1]].tobytes()
