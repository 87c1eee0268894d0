"""Matching blocks of two long texts by suffix automata: the same blocks as the standard library's matcher, in less time.

The matcher takes the longest common block (of several the first one of the left text, and of these the first of the right one),
then goes on left and right of it. Finding a block by comparing all places takes quadratic time. A suffix automaton of the right
text reads the left one once and knows, after each character, the longest piece that ends there and where it first occurs.
"""

from __future__ import annotations

import difflib

#: Product of two lengths up to which the standard library's matcher is used as it is.
SMALL = 1 << 14


def _automaton(text: str) -> tuple[list[dict[str, int]], list[int], list[int], list[int]]:
    """(transitions, suffix links, lengths, first ends) of the smallest automaton of all pieces of the text."""
    step: list[dict[str, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(text):
        new, at = len(step), last
        step.append({})
        link.append(0)
        length.append(i + 1)
        first.append(i)
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:  # pieces of the shorter length get a state of their own
                own = len(step)
                step.append(step[to].copy())
                link.append(link[to])
                length.append(length[at] + 1)
                first.append(first[to])
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = own
                    at = link[at]
                link[to] = link[new] = own
        last = new
    return step, link, length, first


def longest_block(left: str, right: str) -> tuple[int, int, int]:
    """(start in left, start in right, size) of the longest common block, the first of several; size 0 if there is none."""
    step, link, length, first = _automaton(right)
    state = size = 0
    best = (0, 0, 0)
    for i, c in enumerate(left):
        while state and c not in step[state]:
            state = link[state]
            size = length[state]
        if c in step[state]:
            state, size = step[state][c], size + 1
            if size > best[2]:
                best = (i - size + 1, first[state] - size + 1, size)
    return best


def matched(left: str, right: str) -> int:
    """Characters in matching blocks."""
    total, todo = 0, [(left, right)]
    while todo:
        a, b = todo.pop()
        if not a or not b:
            continue
        if len(a) * len(b) <= SMALL:
            total += sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
            continue
        i, j, size = longest_block(a, b)
        if size:
            total += size
            todo += [(a[:i], b[:j]), (a[i + size :], b[j + size :])]
    return total


def ratio(left: str, right: str) -> float:
    """Twice the matched characters by all characters; 1 for two empty texts."""
    return 2.0 * matched(left, right) / (len(left) + len(right)) if left or right else 1.0
