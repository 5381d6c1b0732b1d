"""Dictionary segmentation of one text: pure Python, no Spark.

The text is a lattice of dictionary words whose ends fall on cluster ends. Output is committed
whenever all open branches meet in one position, by the path of fewest words there.
"""

from __future__ import annotations

import heapq
import re
from collections import deque
from itertools import accumulate

from segspark import charsets as C

_CLUSTER = re.compile(C.CLUSTER)
_PLAIN = re.compile("|".join(f"(?:{p})" for p in C.NON_THAI))
_SHORT_WORD = re.compile(f"{C.CONSONANT}{{0,2}}")
_HAS_THAI = re.compile(f"[{C.THAI}]")


class Words:
    """A set of words with look-up of all that start at an offset, shortest first.

    Lengths are kept by first character, so a look-up tries only lengths that occur there.
    """

    def __init__(self, words):
        self.words = frozenset(w for w in words if w)
        lengths: dict[str, set[int]] = {}
        for w in self.words:
            lengths.setdefault(w[0], set()).add(len(w))
        self._lengths = {c: sorted(n) for c, n in lengths.items()}

    def starts(self, char: str) -> bool:
        return char in self._lengths

    def ends(self, text: str, at: int):
        for n in self._lengths.get(text[at], ()):
            if at + n <= len(text) and text[at : at + n] in self.words:
                yield at + n


def ends_of_clusters(text: str):
    """Positions where a word may end. Without Thai every position is one."""
    if not _HAS_THAI.search(text):
        return range(1, len(text) + 1)
    return set(accumulate(len(m.group()) for m in _CLUSTER.finditer(text)))


def _shortest(edges: dict[int, list[int]], start: int, goal: int) -> list[int]:
    came, queue = {start: -1}, deque([start])
    while queue and goal not in came:
        at = queue.popleft()
        for end in edges.get(at, ()):
            if end not in came:
                came[end] = at
                queue.append(end)
    path = [goal]
    while path[-1] != start:
        path.append(came[path[-1]])
    return path[::-1]


def _unknown_end(text: str, at: int, allowed, words: Words) -> int:
    for p in range(at + 1, len(text)):
        if p in allowed and (_PLAIN.match(text, p) or any(e in allowed and not _SHORT_WORD.fullmatch(text, p, e) for e in words.ends(text, p))):
            return p
    return len(text)


def cut(text: str, words: Words) -> list[str]:
    """Tokens of a text; they join back to it."""
    allowed, size = ends_of_clusters(text), len(text)
    out: list[str] = []
    edges: dict[int, list[int]] = {}
    open_ends, seen = [0], {0}
    done = spent = 0
    while open_ends and (at := heapq.heappop(open_ends)) < size:
        for end in words.ends(text, at):
            if end not in allowed:
                continue
            edges.setdefault(at, []).append(end)
            spent += 1
            if end not in seen:
                seen.add(end)
                heapq.heappush(open_ends, end)
            if spent > C.EDGE_CAP:
                break
        if len(open_ends) == 1:
            path = _shortest(edges, done, open_ends[0])
            out += [text[a:b] for a, b in zip(path, path[1:])]
            done, spent = open_ends[0], 0
            seen = {done}
            edges.clear()
        elif not open_ends:
            # tokens outside the dictionary, up to where a word may start
            while True:
                m = _PLAIN.match(text, at)
                done = m.end() if m else _unknown_end(text, at, allowed, words)
                out.append(text[at:done])
                spent += 1  # not reset: a long stretch of such tokens uses up the cap
                if done == size or words.starts(text[done]):
                    break
                at = done
            seen, open_ends = {done}, [done]
    return out


def parts_of(text: str, words: Words) -> list[str]:
    """Windows of a long text that are cut one by one in safe mode."""
    parts = []
    rest = text
    while len(rest) >= C.WINDOW_MAX:
        window = rest[C.WINDOW_MIN : C.WINDOW_MAX]
        space = window.rfind(" ")
        if space >= 0:
            n = space + 1
        else:
            tokens = cut(window, words)
            longest = max(range(len(tokens)), key=lambda i: (len(tokens[i]), i))
            n = C.WINDOW_MIN + sum(map(len, tokens[:longest]))
        parts.append(rest[:n])
        rest = rest[n:]
    return [*parts, rest] if rest else parts


def segment_text(text, words: Words, safe: bool = False, compat: str = "corrected") -> list[str]:
    """Tokens of a text. ``reference`` with ``safe`` slices later parts from the start of the text, as the reference does."""
    if not isinstance(text, str) or not text:
        return []
    if not safe or len(text) < C.WINDOW_MAX:
        return cut(text, words)
    out = []
    for part in parts_of(text, words):
        tokens = cut(part, words)
        if compat == "reference":
            ends = [0, *accumulate(map(len, tokens))]
            tokens = [text[a:b] for a, b in zip(ends, ends[1:])]
        out += tokens
    return out
