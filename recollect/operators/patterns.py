"""Many LIKE patterns over texts: which nodes each one holds for, the first by id.

Patterns are whole in a task, texts pass it in batches. Windows of bytes of a text meet the
pieces of the patterns, one piece a pattern; what meets is tested by the pattern itself. A
pattern that has its nodes takes no further part for larger ids.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa

#: Bytes of a piece, at least and at most; bytes of texts, and windows, that are looked at at once.
LEAST, MOST, HELD, LOOKED = 3, 6, 1 << 20, 1 << 20
_ANY = rb"(?:[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*)"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _number(piece: bytes) -> int:
    return int.from_bytes(piece, "little")


class Pattern:
    """A pattern (A-Z lowered, % and _ as wildcards, open at both ends) and its first ``most`` ids so far."""

    def __init__(self, text: str, most: int):
        self.text, self.most, self.ids = text, most, []
        self.parts = [p if b"_" not in p else re.compile(_ANY.join(map(re.escape, p.split(b"_"))), re.S) for p in text.encode("utf-8", "surrogatepass").split(b"%")]
        runs = [r for r in re.split(rb"[%_]+", text.encode("utf-8", "surrogatepass")) if len(r) >= LEAST]
        self.pieces = {r[k : k + MOST] for r in runs for k in range(max(1, len(r) - MOST + 1))}

    def holds(self, text: bytes) -> bool:
        at = 0
        for p in self.parts:  # what a part takes has one length, so the first place is the best
            if isinstance(p, bytes):
                at = text.find(p, at)
                if at < 0:
                    return False
                at += len(p)
            else:
                found = p.search(text, at)
                if not found:
                    return False
                at = found.end()
        return True

    def room(self, ids: list[str]) -> int:
        """How many of the sorted ``ids`` could still be among the first."""
        return len(ids) if len(self.ids) < self.most else bisect_left(ids, self.ids[-1])

    def add(self, one: str) -> None:
        k = bisect_left(self.ids, one)
        if k == len(self.ids) or self.ids[k] != one:
            insort(self.ids, one)
            del self.ids[self.most :]


def _met(folded: np.ndarray, ends: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, piece) of all pieces that texts hold; text k ends at ``ends[k]``."""
    texts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in sorted({len(p) for p in pieces}):
        mine = sorted((_number(p), k) for k, p in enumerate(pieces) if len(p) == n)
        known, index = np.array([c for c, _ in mine], np.uint64), np.array([k for _, k in mine])
        near = np.zeros(1 << 20, bool)
        near[known * _MIX >> np.uint64(44)] = True
        for low in range(0, len(folded) - n + 1, LOOKED):
            high = min(low + LOOKED, len(folded) - n + 1)
            code = folded[low:high].astype(np.uint64)
            for k in range(1, n):
                code |= folded[low + k : high + k].astype(np.uint64) << np.uint64(8 * k)
            at = np.flatnonzero(near[code * _MIX >> np.uint64(44)])
            place = np.minimum(np.searchsorted(known, code[at]), len(known) - 1)
            same = known[place] == code[at]
            at, place = at[same] + low, place[same]
            text = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[text]
            texts.append(text[inside])
            found.append(index[place[inside]])
    pair = np.unique(np.concatenate(texts) * max(len(pieces), 1) + np.concatenate(found))
    return pair // max(len(pieces), 1), pair % max(len(pieces), 1)


class Matcher:
    """The state of a task: patterns, and by which of its pieces each is looked up."""

    def __init__(self, patterns: list[tuple[str, int]]):
        self.patterns = [Pattern(text, most) for text, most in patterns if most > 0]
        self.chosen: list[bytes] | None = None

    def _choose(self, folded: np.ndarray, ends: np.ndarray) -> None:
        """Of each pattern the piece that the fewest of the first texts hold; any one would do."""
        pieces = sorted({x for p in self.patterns for x in p.pieces})
        count = np.bincount(_met(folded, ends, pieces)[1], minlength=len(pieces)) if pieces else []
        often = dict(zip(pieces, count, strict=True))
        self.chosen = [min(p.pieces, key=lambda x: (often[x], -len(x), x), default=b"") for p in self.patterns]

    def take(self, ids: list[str], owner: np.ndarray, data: np.ndarray, ends: np.ndarray) -> None:
        """Texts (``data`` up to each of ``ends``) of the nodes ``ids[owner]``."""
        folded = _FOLD[data]
        if self.chosen is None:
            self._choose(folded, ends)
        order = sorted(set(ids))
        place = {x: k for k, x in enumerate(order)}
        rank = np.array([place[x] for x in ids], np.int64)[owner]
        room = np.array([p.room(order) for p in self.patterns], np.int64)
        open_ = np.flatnonzero(room > 0)
        by: dict[bytes, list[int]] = {}
        for k in open_.tolist():
            by.setdefault(self.chosen[k], []).append(k)
        every = by.pop(b"", [])
        begin = np.append(0, ends[:-1])
        asks = []
        if by:
            pieces = sorted(by)
            text, piece = _met(folded, ends, pieces)
            many = np.array([len(by[x]) for x in pieces])
            first, flat = np.cumsum(many) - many, np.concatenate([by[x] for x in pieces])
            row = np.repeat(np.arange(len(text)), many[piece])
            of = flat[first[piece][row] + np.arange(len(row)) - np.repeat(np.cumsum(many[piece]) - many[piece], many[piece])]
            text = text[row]
            some = rank[text] < room[of]
            text, of = text[some], of[some]
            by_id = np.argsort(rank[text], kind="stable")
            asks.append((text[by_id].tolist(), of[by_id].tolist()))
        for k in every:
            text = np.argsort(rank, kind="stable")
            asks.append((text.tolist(), [k] * len(text)))
        ranks, left = rank.tolist(), room.tolist()
        last, held = -1, b""
        for texts, patterns in asks:
            for t, k in zip(texts, patterns, strict=True):
                if ranks[t] >= left[k]:
                    continue
                if t != last:
                    last, held = t, folded[begin[t] : ends[t]].tobytes()
                p = self.patterns[k]
                if p.holds(held):
                    p.add(order[ranks[t]])
                    if len(p.ids) == p.most:
                        left[k] = bisect_left(order, p.ids[-1])


def matched(patterns: list[tuple[str, int]]):
    """For batches of (id, texts): (folded, id), of each pattern the first ``most`` nodes of the task."""

    def run(batches):
        state = Matcher(patterns)
        for b in batches:
            lists = b.column("texts")
            count = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().cast(pa.large_binary())
            offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
            data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
            ids, last = b.column("id").to_pylist(), np.cumsum(count)
            low = 0
            while low < len(ids):
                begin = int(last[low] - count[low])
                # whole nodes, up to HELD bytes of texts
                high = max(low + 1, int(np.searchsorted(offsets[last], offsets[begin] + HELD, "right")))
                ends = offsets[begin + 1 : last[high - 1] + 1] - offsets[begin]
                if len(ends):
                    state.take(ids[low:high], np.repeat(np.arange(high - low), count[low:high]), data[offsets[begin] : offsets[last[high - 1]]], ends)
                low = high
        rows = [(p.text, i) for p in state.patterns for i in p.ids]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["folded", "id"])

    return run
