"""One deterministic automaton of many grammars.

Regular expressions (literals, sets, groups, alternatives, counted repeats) become one
nondeterministic automaton and, by subset construction, one deterministic table over
classes of characters that no grammar tells apart. Each character costs one look into the
table, whatever the number of grammars; nothing is ever read twice.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser

#: Stands for every character from U+0080 on.
FAR = 128
_DIGIT = frozenset(range(48, 58))
_WORD = _DIGIT | frozenset(range(65, 91)) | frozenset(range(97, 123)) | {95, FAR}
_BLANK = frozenset(map(ord, " \t\n\r\v\f"))
_ALL = frozenset(range(129))
_CATEGORIES = {op.CATEGORY_DIGIT: _DIGIT, op.CATEGORY_WORD: _WORD, op.CATEGORY_SPACE: _BLANK, op.CATEGORY_NOT_SPACE: _ALL - _BLANK, op.CATEGORY_NOT_WORD: _ALL - _WORD, op.CATEGORY_NOT_DIGIT: _ALL - _DIGIT}


def _set(items: list) -> frozenset[int]:
    out: set[int] = set()
    negated = False
    for what, v in items:
        if what == op.NEGATE:
            negated = True
        elif what == op.LITERAL:
            out.add(min(v, FAR))
        elif what == op.RANGE:
            out.update(range(v[0], min(v[1], FAR) + 1))
        else:
            out |= _CATEGORIES[v]
    return _ALL - out if negated else frozenset(out)


class Automaton:
    """``grammars``: (label, regular expression); labels may be repeated."""

    def __init__(self, grammars: list[tuple[str, str]]):
        self._free: list[list[int]] = [[]]
        self._on: list[tuple[frozenset[int], int] | None] = [None]
        final: dict[int, str] = {}
        for label, expression in grammars:
            begin = self._state()
            self._free[0].append(begin)
            final[self._grow(parser.parse(expression), begin)] = label
        self._determine(final)
        del self._free, self._on

    # -- the nondeterministic automaton ----------------------------------------------
    def _state(self) -> int:
        self._free.append([])
        self._on.append(None)
        return len(self._free) - 1

    def _step(self, at: int, chars: frozenset[int]) -> int:
        new = self._state()
        self._on[at] = (chars, new)
        after = self._state()
        self._free[new].append(after)
        return after

    def _grow(self, tree, at: int) -> int:
        """Appends a parsed expression to a state without ways out; the state after it."""
        for what, v in tree:
            if what == op.LITERAL:
                at = self._step(at, frozenset([min(v, FAR)]))
            elif what == op.NOT_LITERAL:
                at = self._step(at, _ALL - {v})
            elif what == op.IN:
                at = self._step(at, _set(v))
            elif what == op.SUBPATTERN:
                at = self._grow(v[3], at)
            elif what == op.BRANCH:
                end = self._state()
                for way in v[1]:
                    begin = self._state()
                    self._free[at].append(begin)
                    self._free[self._grow(way, begin)].append(end)
                at = end
            elif what == op.MAX_REPEAT:
                least, most, sub = v
                for _ in range(least):
                    at = self._grow(sub, at)
                end = self._state()
                if most == op.MAXREPEAT:
                    begin = self._state()
                    self._free[at] += [begin, end]
                    self._free[self._grow(sub, begin)] += [at]
                else:
                    for _ in range(most - least):
                        begin = self._state()
                        self._free[at] += [begin, end]
                        at = self._grow(sub, begin)
                    self._free[at].append(end)
                at = end
            else:
                raise ValueError(f"not supported: {what}")
        return at

    # -- the deterministic one -------------------------------------------------------
    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self._free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if self._on[s] or not self._free[s])

    def _determine(self, final: dict[int, str]) -> None:
        sets = {t[0] for t in self._on if t}
        alike: dict[tuple, int] = {}
        #: Class of each character below U+0080, and of all others.
        self.classes = [alike.setdefault(tuple(c in s for s in sets), len(alike)) for c in range(129)]
        member = {s: sorted({self.classes[c] for c in s}) for s in sets}
        start = self._closed({0})
        number, todo = {start: 0}, [start]
        self.table: list[list[int]] = []
        #: Labels of the grammars that end in a state.
        self.ends: list[tuple[str, ...]] = []
        while todo:
            states = todo.pop(0)
            to: dict[int, set[int]] = {}
            for s in states:
                if self._on[s]:
                    chars, target = self._on[s]
                    for k in member[chars]:
                        to.setdefault(k, set()).add(target)
            row = [-1] * len(alike)
            for k, targets in to.items():
                closed = self._closed(targets)
                if closed not in number:
                    number[closed] = len(number)
                    todo.append(closed)
                row[k] = number[closed]
            self.table.append(row)
            self.ends.append(tuple(sorted({final[s] for s in states if s in final})))

    def state_after(self, text: str, state: int = 0) -> int:
        """The state that ``text`` leads to; -1 if no grammar goes on so."""
        for c in text:
            state = self.table[state][self.classes[min(ord(c), FAR)]]
            if state < 0:
                break
        return state

    def run(self, text: str, at: int, state: int = 0, stop: str | None = None) -> dict[str, int]:
        """label -> the last position at which a grammar of that label ended, reading from
        ``at`` until no grammar goes on, or one labelled ``stop`` has ended."""
        table, classes, ends, found = self.table, self.classes, self.ends, {}
        for i in range(at, len(text)):
            c = ord(text[i])
            state = table[state][classes[c if c < FAR else FAR]]
            if state < 0:
                break
            for label in ends[state]:
                found[label] = i + 1
                if label == stop:
                    return found
        return found
