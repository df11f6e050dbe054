"""Secret scans by one deterministic automaton for all rules (operator 7).

Rules are regular expressions over bytes. They are compiled together: one nondeterministic automaton, subset
construction over classes of bytes that no rule tells apart, then minimisation into one array of transitions. A text's
UTF-8 bytes go through it once; a state says which rules have just matched. From such an end a rule's own reversed
automaton finds the leftmost start and its forward one the longest match, as leftmost greedy search would. Spans of
one rule don't overlap. A rule's match must not hold a shorter match of the same rule that starts later, which is so
when, as here, a fixed beginning leads up to a final run of characters.
"""

from __future__ import annotations

import re._constants as op
import re._parser as sre
from array import array
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import held, over_texts, small_batches


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    measure: Callable[[bytes], int] = len
    least: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _value_length(match: bytes) -> int:
    rest = match[min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1 :].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


# fixed values: the base kinds and their least lengths. A least length is measured afterwards, as a short match uses up
# its characters; only that of a plain run of hex digits, which most words hold, is written into the expression.
_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
BASE = (
    Rule("assign", rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", _value_length, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Kinds beyond the base: private-key headers and bearer credentials.
MORE = (
    Rule("key_header", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]+=*", least=30),
)


class _Nfa:
    """Thompson's construction, from the standard library's parse of an expression."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, items, start: int) -> int:
        for kind, arg in items:
            end = self.state()
            if kind is op.LITERAL:
                self.moves[start].append((frozenset([arg]), end))
            elif kind is op.IN:
                self.moves[start].append((self._set(arg), end))
            elif kind is op.SUBPATTERN:
                self.empty[self.build(arg[-1], start)].append(end)
            elif kind is op.BRANCH:
                for way in arg[1]:
                    self.empty[start].append(first := self.state())
                    self.empty[self.build(way, first)].append(end)
            elif kind is op.MAX_REPEAT:
                low, high, body = arg
                at = start
                for _ in range(low):
                    at = self.build(body, at)
                if high is op.MAXREPEAT:
                    self.empty[at].append(loop := self.state())
                    self.empty[self.build(body, loop)].append(loop)
                    self.empty[loop].append(end)
                else:
                    self.empty[at].append(end)
                    for _ in range(high - low):
                        at = self.build(body, at)
                        self.empty[at].append(end)
            else:
                raise ValueError(f"{kind} isn't supported in a rule")
            start = end
        return start

    @staticmethod
    def _set(items) -> frozenset:
        out: set[int] = set()
        for kind, arg in items:
            out |= set(range(arg[0], arg[1] + 1)) if kind is op.RANGE else {arg}
        return frozenset(out)

    def reversed(self, start: int, end: int) -> tuple[_Nfa, int, int]:
        back = _Nfa()
        for _ in self.empty:
            back.state()
        for s, (free, moves) in enumerate(zip(self.empty, self.moves, strict=True)):
            for t in free:
                back.empty[t].append(s)
            for chars, t in moves:
                back.moves[t].append((chars, s))
        return back, end, start

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa:
    """``table[state + class]`` is the next state; states are multiples of the number of classes.

    Accepting states come last, from ``accepting`` on; ``mask`` has the set of rules of each. State ``dead`` stays.
    """

    def __init__(self, nfa: _Nfa, start: int, ends: dict[int, int], again: bool):
        sets = sorted({c for m in nfa.moves for c, _ in m}, key=sorted)
        sign = [tuple(b in s for s in sets) for b in range(256)]
        number = {s: i for i, s in enumerate(dict.fromkeys(sign))}
        self.classes = bytes(number[s] for s in sign)
        width, one = len(number), {c: b for b, c in reversed(list(enumerate(self.classes)))}
        first = nfa.closure([start])
        ids, rows, todo = {first: 0}, [], [first]
        for now in todo:  # subset construction
            row = []
            for c in range(width):
                to = {t for s in now for chars, t in nfa.moves[s] if one[c] in chars}
                nxt = nfa.closure(to | ({start} if again else set()))
                if nxt not in ids:
                    ids[nxt] = len(ids)
                    todo.append(nxt)
                row.append(ids[nxt])
            rows.append(row)
        marks = [frozenset(ends[s] for s in states if s in ends) for states in ids]
        block = [list(dict.fromkeys(marks)).index(m) for m in marks]
        while True:  # minimisation: states stay together that go to the same blocks
            names: dict = {}
            nxt = [names.setdefault((block[s], *(block[t] for t in rows[s])), len(names)) for s in range(len(rows))]
            if len(names) == len(set(block)):
                break
            block = nxt
        sample = {b: s for s, b in reversed(list(enumerate(block)))}
        order = sorted(sample, key=lambda b: bool(marks[sample[b]]))
        place = {b: i * width for i, b in enumerate(order)}
        self.table = array("l", [place[block[t]] for b in order for t in rows[sample[b]]]).tolist()
        self.start = place[block[0]]
        self.accepting = sum(not marks[sample[b]] for b in order) * width
        self.mask = {place[b]: sorted(marks[sample[b]]) for b in order if marks[sample[b]]}
        empty = next((block[s] for states, s in ids.items() if not states), None)
        self.dead = None if empty is None else place[empty]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules, self.single = rules, []
        nfa, ends = _Nfa(), {}
        start = nfa.state()
        for i, r in enumerate(rules):
            nfa.empty[start].append(first := nfa.state())
            ends[nfa.build(sre.parse(r.regex), first)] = i
            own = _Nfa()
            a = own.state()
            z = own.build(sre.parse(r.regex), a)
            back, s, e = own.reversed(a, z)
            self.single.append((Dfa(own, a, {z: 0}, False), Dfa(back, s, {e: 0}, False)))
        self.all = Dfa(nfa, start, ends, True)

    @staticmethod
    def _farthest(dfa: Dfa, data: bytes, at: int, stop: int) -> int:
        """Where the longest match from ``at`` ends, going towards ``stop``; -1 if there is none."""
        state, found, step = dfa.start, -1, 1 if stop >= at else -1
        for i in range(at, stop, step):
            state = dfa.table[state + dfa.classes[data[i if step > 0 else i - 1]]]
            if state == dfa.dead:
                break
            if state >= dfa.accepting:
                found = i + step
        return found

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, by start and then rule."""
        data = text.encode()
        table, accepting, mask, state = self.all.table, self.all.accepting, self.all.mask, self.all.start
        past, found = [0] * len(self.rules), []
        for i, c in enumerate(data.translate(self.all.classes), 1):
            state = table[state + c]
            if state >= accepting:
                for r in mask[state]:
                    if i > past[r]:
                        forward, back = self.single[r]
                        a = self._farthest(back, data, i, past[r])
                        if a >= 0:
                            past[r] = b = self._farthest(forward, data, a, len(data))
                            rule = self.rules[r]
                            if not rule.least or rule.measure(data[a:b]) >= rule.least:
                                found.append((a, r, b))
        found.sort()
        if len(data) != len(text):
            at, points, out = 0, 0, []
            for a, r, b in found:
                points, at = points + len(data[at:a].decode()), a
                out.append((points, r, points + len(data[a:b].decode())))
            return out
        return found


def scanner(kinds: tuple[str, ...]) -> Scanner:
    named = {r.kind: r for r in BASE + MORE}
    return held(("secrets", kinds), lambda: Scanner(tuple(named[k] for k in kinds)))


KINDS = tuple(r.kind for r in BASE + MORE)


def find_secrets(docs: DataFrame, *, kinds: tuple[str, ...] = KINDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans array<struct<kind, start, end>>`` of every whole text, in code points, end exclusive.

    Null and empty texts have no spans. One row for each input row, none for a table without rows; nothing is shuffled.
    Columns but key and text are not read, whatever their names.
    """

    def make():
        s = scanner(kinds)
        return lambda texts: [([{"kind": kinds[r], "start": a, "end": b} for a, r, b in s.spans(x)],) for x in texts]

    return over_texts(docs, make, "spans array<struct<kind:string,start:int,end:int>>", key=key, text=text)


def digest(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a hash of their spans and all spans as text, from ``find_secrets``."""
    joined = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = [r.kind for r in BASE]
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    counts = [of(k).alias(f"n_{k}") for k in base]
    return found.select(key, *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, kinds: tuple[str, ...] = KINDS, text: str = "text") -> DataFrame:
    """The same rows and columns with ``[SECRET:kind]`` for each span; overlapping ones become one, named by the first.

    Null texts stay null.
    """
    import pyarrow as pa

    at = docs.columns.index(text)

    def run(batches):
        s = scanner(kinds)

        def one(x):
            if not x:
                return x
            out, past = [], 0
            for a, r, b in s.spans(x):
                if a >= past:
                    out += [x[past:a], f"[SECRET:{kinds[r]}]"]
                past = max(past, b)
            return "".join(out) + x[past:]

        for batch in batches:
            yield batch.set_column(at, batch.field(at), pa.array([one(x) for x in batch.column(at).to_pylist()], batch.field(at).type))

    return small_batches(docs).mapInArrow(run, docs.schema)
