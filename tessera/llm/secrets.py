"""Secret scans by one combined deterministic automaton.

Rule patterns are parsed, turned into one NFA (Thompson), made deterministic by subset construction with the start state alive at every byte, and minimised by partition
refinement (Moore) with the set of rules that accept as the initial partition. The result is one flat transition array over bytes; a text is scanned once, all rules together.
Only where a state accepts is the match resolved: its start is the leftmost one since the automaton last had no thread alive, its end the longest from there, by the
rule's own small anchored automaton. Matches of a rule don't overlap.

Base rules (assign, access, hex) are fixed by contract; more rules only add spans. Offsets are code points. Cases: null text is empty; a text without findings has zero
counts, the digest of the empty string and empty spans; equal rows give equal rows; no text is cut, memory is that of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import as_batch, map_text, pick

#: Rules in the order that ties of start are listed in. Letters of assign are in either case. The last number is the least length of the value (assign) only.
RULES = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]{8,}"),
    ("github", r"gh[pousr]_[A-Za-z0-9]+"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6
#: Least lengths of whole matches, checked when a match is resolved; counted here and not by states, which overlapping starts would multiply.
LEAST = {"access": 20, "hex": 24, "github": 40, "slack": 15, "jwt": 36}
VALUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


class Nfa:
    """Byte NFA built from patterns of literals, classes, groups, alternation and the quantifiers ? * + {m} {m,} {m,n}."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern, 0
        tree = self._either()
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} in {pattern!r}")
        return self._build(tree)

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _either(self) -> tuple:
        parts = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def _sequence(self) -> tuple:
        parts = []
        while self._peek() not in ("", "|", ")"):
            atom = self._atom()
            while self._peek() in ("?", "*", "+", "{") and self._peek():
                atom = ("rep", atom, *self._times())
            parts.append(atom)
        return ("seq", parts)

    def _times(self) -> tuple[int, int | None]:
        c = self._peek()
        self.at += 1
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        end = self.text.index("}", self.at)
        low, comma, high = self.text[self.at : end].partition(",")
        self.at = end + 1
        return int(low), (int(high) if high else None) if comma else int(low)

    def _char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def _atom(self) -> tuple:
        c = self._peek()
        if c == "(":
            self.at += 1
            tree = self._either()
            self.at += 1
            return tree
        if c != "[":
            return ("set", frozenset([self._char()]))
        self.at += 1
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._char()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._char()
            found |= set(range(low, high + 1))
        self.at += 1
        return ("set", frozenset(found))

    def _build(self, tree: tuple) -> tuple[int, int]:
        kind = tree[0]
        first = self.state()
        if kind == "set":
            last = self.state()
            self.moves[first].append((tree[1], last))
            return first, last
        if kind == "seq":
            last = first
            for part in tree[1]:
                a, b = self._build(part)
                self.empty[last].append(a)
                last = b
            return first, last
        if kind == "or":
            last = self.state()
            for part in tree[1]:
                a, b = self._build(part)
                self.empty[first].append(a)
                self.empty[b].append(last)
            return first, last
        _, inner, low, high = tree
        last = first
        for _ in range(low):
            a, b = self._build(inner)
            self.empty[last].append(a)
            last = b
        if high is None:
            a, b = self._build(inner)
            end = self.state()
            self.empty[last] += [a, end]
            self.empty[b] += [a, end]
            return first, end
        end = self.state()
        self.empty[last].append(end)
        for _ in range(high - low):
            a, b = self._build(inner)
            self.empty[last].append(a)
            self.empty[b].append(end)
            last = b
        return first, end

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa:
    """Minimal automaton of several patterns: table[state * 256 + byte] is the next state times 256; state 0 is where nothing has begun; accepting states come last."""

    def __init__(self, patterns: list[str], search: bool) -> None:
        nfa = Nfa()
        ends = [nfa.add(p) for p in patterns]
        start = nfa.closure(frozenset(a for a, _ in ends))
        again = start if search else frozenset()
        ids, todo, rows = {start: 0}, [start], []
        while todo:
            now = todo.pop(0)
            by: list[set[int]] = [set() for _ in range(256)]
            for s in now:
                for chars, t in nfa.moves[s]:
                    for c in chars:
                        by[c].add(t)
            row = []
            cache: dict[frozenset[int], int] = {}
            for targets in by:
                k = frozenset(targets)
                if k not in cache:
                    to = nfa.closure(k) | again
                    if to not in ids:
                        ids[to] = len(ids)
                        todo.append(to)
                    cache[k] = ids[to]
                row.append(cache[k])
            rows.append(row)
        accepts = [frozenset(k for k, (_, b) in enumerate(ends) if b in s) for s in ids]
        groups = self._minimise(rows, accepts)
        size = max(groups) + 1
        found = [next(s for s, g in enumerate(groups) if g == k) for k in range(size)]
        order = sorted(range(size), key=lambda k: (bool(accepts[found[k]]), k != groups[0], k))
        place = {k: i for i, k in enumerate(order)}
        self.table = [place[groups[rows[found[k]][c]]] * 256 for k in order for c in range(256)]
        self.accepts = [sorted(accepts[found[k]]) for k in order]
        self.first = sum(not a for a in self.accepts) * 256
        dead = [i for i in range(size) if not self.accepts[i] and all(self.table[i * 256 + c] == i * 256 for c in range(256))]
        self.dead = dead[0] * 256 if dead and not search else -1

    @staticmethod
    def _minimise(rows: list[list[int]], accepts: list[frozenset[int]]) -> list[int]:
        kinds: dict = {}
        groups = [kinds.setdefault(a, len(kinds)) for a in accepts]
        while True:
            kinds = {}
            finer = [kinds.setdefault((groups[s], tuple(groups[t] for t in row)), len(kinds)) for s, row in enumerate(rows)]
            if len(kinds) == max(groups) + 1:
                return groups
            groups = finer

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match that begins at start; -1 if there is none."""
        table, first, dead, s, end = self.table, self.first, self.dead, 0, -1
        for i in range(start, len(data)):
            s = table[s + data[i]]
            if s >= first:
                end = i + 1
            elif s == dead:
                break
        return end


class Scanner:
    def __init__(self, rules: tuple[tuple[str, str], ...] = RULES) -> None:
        self.names = [n for n, _ in rules]
        self.all = Dfa([p for _, p in rules], search=True)
        self.own = [Dfa([p], search=False) for _, p in rules]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        table, first, accepts = self.all.table, self.all.first, self.all.accepts
        s = clear = 0
        # Of each rule: where its last match ended, and up to where starts have been tried; a start's outcome never changes, so each is tried once.
        done, tried = [0] * len(self.own), [0] * len(self.own)
        found = []
        for i, b in enumerate(data, 1):
            s = table[s + b]
            if s:
                if s >= first:
                    for k in accepts[s >> 8]:
                        if i > done[k]:
                            begin, tried[k] = max(clear, done[k], tried[k]), i
                            for start in range(begin, i):
                                if (end := self.own[k].longest(data, start)) >= 0:
                                    done[k] = end
                                    found.append((start, k, end))
                                    break
            else:
                clear = i
        return sorted(x for x in found if self._long_enough(data, *x))

    def _long_enough(self, data: bytes, start: int, rule: int, end: int) -> bool:
        name = self.names[rule]
        return self._value(data, start, end) >= LEAST_VALUE if name == "assign" else end - start >= LEAST.get(name, 1)

    @staticmethod
    def _value(data: bytes, start: int, end: int) -> int:
        """Length of the value: what follows the first : or = of the match, without blanks and a quote."""
        at = min(p for p in (data.find(b":", start, end), data.find(b"=", start, end)) if p >= 0) + 1
        while data[at] == 0x20:
            at += 1
        return end - at - (data[at] not in VALUE)

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """(start, rule name, end) in code points."""
        data = text.encode("utf-8", "surrogatepass")
        found = self.scan(data)
        if found and len(data) != len(text):
            # Code points before each byte, counted once for all spans.
            before = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)])
            return [(int(before[a]), self.names[k], int(before[b])) for a, k, b in found]
        return [(a, self.names[k], b) for a, k, b in found]


_scanner: Scanner | None = None


def scanner() -> Scanner:
    """One automaton for each worker process."""
    global _scanner
    if _scanner is None:
        _scanner = Scanner()
    return _scanner


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def _findings(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    scan, rows = scanner(), []
    for text in batch.column(1).to_pylist():
        spans = scan.spans(text or "")
        base = [x for x in spans if x[1] in BASE]
        rows.append((*(sum(k == x[1] for x in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
    columns = list(zip(*rows)) if rows else [[]] * 5
    yield as_batch([batch.column(0), *columns], pa.schema([("doc_id", batch.schema.field(0).type), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]))


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    d = pick(docs, "doc_id", "text")
    return map_text(d, "text", _findings, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = "[secret]"


def masked(text: str) -> str:
    """The text with each maximal stretch of findings put as one MASK."""
    out, at = [], 0
    for a, _, b in scanner().spans(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = b
    return "".join(out) + text[at:] if out else text
