"""Secret scanning with one combined deterministic automaton.

The rules' regular expressions are compiled together: Thompson fragments, one
nondeterministic automaton that may begin a rule at any byte, subset
construction over classes of equivalent bytes, and minimisation.  The result is
a transition array; every byte of every text is read once, for all rules.

Texts are cut for the pass at bytes after which the automaton is in its start
state whatever it was in before (they come from the array itself), so the parts
run side by side as lanes of numpy arrays.  In the parts in which a rule accepts,
which are few, the spans come from a second combined automaton, anchored at each
byte where a rule that is free there may begin: its array has, for every state,
the rules that have matched and those that still can, so that one walk gives the
longest match of each rule at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import pieces


@dataclass(frozen=True)
class SecretRule:
    """kind: the name in results.  pattern: literals, ``\\x`` escapes, classes,
    groups, ``|``, ``?``, ``*``, ``+`` and ``{n}``, over bytes.  fold: letters in
    either case.  least: bytes that the match (or its last group, if tail) must
    have; shorter matches are found, use up their bytes and are dropped."""

    kind: str
    pattern: str
    least: int = 0
    tail: str = ""
    fold: bool = False


VALUE = "[A-Za-z0-9+/_.=-]"
#: The contract's kinds, in its order.
BASE_RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", 12, VALUE, True),
    SecretRule("access", "AKIA", 18 - 4, "[A-Z0-9]"),
    SecretRule("hex", "", 16, "[0-9a-f]"),
)
#: Further kinds of published formats.
MORE_RULES = (
    SecretRule("forge", "gh[pousr]_", 36, "[A-Za-z0-9]"),
    SecretRule("chat", "xox[abprs]-", 10, "[A-Za-z0-9-]"),
    SecretRule("pem", "-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY----", 1, "-"),
    SecretRule("jwt", "eyJ", 20, "[A-Za-z0-9_.-]"),
)

# ---- regular expressions to automata

_EMPTY = np.zeros(256, bool)


class _Nfa:
    def __init__(self) -> None:
        self.skip: list[set[int]] = []
        self.step: list[list[tuple[np.ndarray, int]]] = []

    def node(self) -> int:
        self.skip.append(set())
        self.step.append([])
        return len(self.skip) - 1


def _bytes_of(text: str, fold: bool) -> np.ndarray:
    out = _EMPTY.copy()
    for b in text.encode():
        out[b] = True
    return _folded(out) if fold else out


def _folded(flags: np.ndarray) -> np.ndarray:
    out = flags.copy()
    for lo, up in zip(b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", strict=True):
        out[lo] = out[up] = flags[lo] or flags[up]
    return out


class _Parser:
    """Builds the fragment of one pattern into an automaton, recursively."""

    def __init__(self, nfa: _Nfa, pattern: str, fold: bool):
        self.nfa, self.p, self.i, self.fold = nfa, pattern, 0, fold

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def choice(self, start: int) -> int:
        end = self.nfa.node()
        while True:
            begin = self.nfa.node()
            self.nfa.skip[start].add(begin)
            self.nfa.skip[self.chain(begin)].add(end)
            if self.peek() != "|":
                return end
            self.i += 1

    def chain(self, at: int) -> int:
        while self.peek() not in ("", "|", ")"):
            at = self.repeat(at, self.i)
        return at

    def atom(self, start: int) -> int:
        c = self.peek()
        self.i += 1
        if c == "(":
            end = self.choice(start)
            self.i += 1
            return end
        if c == "[":
            close = self.p.index("]", self.i)
            body, flags = self.p[self.i : close], _EMPTY.copy()
            self.i = close + 1
            k = 0
            while k < len(body):
                if k + 2 < len(body) and body[k + 1] == "-":
                    flags[ord(body[k]) : ord(body[k + 2]) + 1] = True
                    k += 3
                else:
                    flags[ord(body[k])] = True
                    k += 1
            flags = _folded(flags) if self.fold else flags
        elif c == "\\":
            if self.peek() == "x":
                flags = _bytes_of(chr(int(self.p[self.i + 1 : self.i + 3], 16)), False)
                self.i += 3
            else:
                flags = _bytes_of(self.peek(), self.fold)
                self.i += 1
        else:
            flags = _bytes_of(c, self.fold)
        end = self.nfa.node()
        self.nfa.step[start].append((flags, end))
        return end

    def repeat(self, start: int, begin: int) -> int:
        inner = self.nfa.node()
        self.nfa.skip[start].add(inner)
        end = self.atom(inner)
        c = self.peek()
        if c and c in "?*+":
            self.i += 1
            out = self.nfa.node()
            self.nfa.skip[end].add(out)
            if c != "+":
                self.nfa.skip[start].add(out)
            if c != "?":
                self.nfa.skip[end].add(inner)
            return out
        if c == "{":
            n, self.i = int(self.p[self.i + 1 : self.p.index("}", self.i)]), self.p.index("}", self.i) + 1
            after = self.i
            for _ in range(n - 1):
                self.i = begin
                end = self.atom(end)
            self.i = after
        return end


@dataclass(frozen=True)
class Automaton:
    """table: next state by [state * classes + class of the byte]; accepts: a bit
    for each rule by state.  State 0 is the start; ``dead`` has no way out."""

    classes: np.ndarray
    n_classes: int
    table: np.ndarray
    accepts: np.ndarray
    dead: int


def compile_rules(patterns: list[tuple[str, bool]], anchored: bool = False) -> Automaton:
    nfa = _Nfa()
    root = nfa.node()
    ends = {}
    for k, (pattern, fold) in enumerate(patterns):
        begin = nfa.node()
        nfa.skip[root].add(begin)
        ends[_Parser(nfa, pattern, fold).choice(begin)] = k
    flags = np.array([f for steps in nfa.step for f, _ in steps])
    _, classes = np.unique(flags, axis=1, return_inverse=True)
    classes = classes.ravel()
    n = int(classes.max()) + 1
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(n)]

    @lru_cache(maxsize=None)
    def closure(nodes: frozenset[int]) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            new = nfa.skip[todo.pop()] - seen
            seen |= new
            todo += new
        return frozenset(seen)

    start = closure(frozenset([root]))
    states, order, rows = {start: 0}, [start], []
    while len(rows) < len(order):  # subset construction
        here, row = order[len(rows)], []
        for b in sample:
            reach = {t for s in here for f, t in nfa.step[s] if f[b]}
            there = closure(frozenset(reach if anchored else reach | {root}))
            if there not in states:
                states[there] = len(order)
                order.append(there)
            row.append(states[there])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum(1 << k for e, k in ends.items() if e in s) for s in order])
    group = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:  # minimisation: split groups until all of a group's states go to the same groups
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    rename = np.full(group.max() + 1, -1)
    rename[group[0]] = 0
    rest = [g for g in range(group.max() + 1) if g != group[0]]
    rename[rest] = np.arange(1, len(rest) + 1)
    group = rename[group]
    first = np.array([int(np.flatnonzero(group == g)[0]) for g in range(group.max() + 1)])
    small = group[table[first]]
    own = np.arange(len(first))
    dead = np.flatnonzero((small == own[:, None]).all(axis=1) & (accepts[first] == 0)) if anchored else []
    return Automaton(classes.astype(np.uint8), n, small.ravel().astype(np.int32), accepts[first], int(dead[0]) if len(dead) else -1)


# ---- scanning


class _Spans:
    """All rules' whole patterns and heads in one anchored automaton."""

    def __init__(self, rules: tuple[SecretRule, ...]):
        self.rules, n = rules, len(rules)
        headed = [k for k, r in enumerate(rules) if r.pattern]
        a = compile_rules([(f"{r.pattern}{r.tail}+", r.fold) for r in rules] + [(rules[k].pattern, rules[k].fold) for k in headed], anchored=True)
        table = a.table.reshape(-1, a.n_classes)
        alive = a.accepts & ((1 << n) - 1)  # rules that match here or further on
        while True:
            more = alive | np.bitwise_or.reduce(alive[table], axis=1)
            if (more == alive).all():
                break
            alive = more
        self.rows, self.accepts, self.alive = table[:, a.classes].tolist(), a.accepts.tolist(), alive.tolist()
        self.first = [self.alive[s] for s in self.rows[0]]  # rules that may begin with a byte
        self.head_of = {n + i: k for i, k in enumerate(headed)}

    def of(self, part: bytes) -> list[tuple[int, int, int]]:
        """(begin, end, rule) of the leftmost non-overlapping matches of each rule."""
        out, n = [], len(self.rules)
        free, ends = [0] * n, [0] * n  # where each rule may begin again
        for i, byte in enumerate(part):
            wanted = self.first[byte]
            if not wanted:
                continue
            for k in range(n):
                if wanted >> k & 1 and free[k] > i:
                    wanted &= ~(1 << k)
            if not wanted:
                continue
            s, heads, matched = 0, {}, 0
            for j in range(i, len(part)):
                s = self.rows[s][part[j]]
                if not self.alive[s] & wanted:
                    break
                accepted = self.accepts[s]
                if accepted:
                    for k in range(n):
                        if accepted >> k & 1:
                            ends[k] = j + 1
                    matched |= accepted
                    for bit, k in self.head_of.items():
                        if accepted >> bit & 1:
                            heads[k] = j + 1
            for k in range(n):
                if matched & wanted & 1 << k:
                    if ends[k] - heads.get(k, i) >= self.rules[k].least:
                        out.append((i, ends[k], k))
                    free[k] = ends[k]
        return out


class Scanner:
    def __init__(self, rules: tuple[SecretRule, ...]):
        self.rules = rules
        # The combined automaton accepts at the first byte after a rule's head; a rule without a head must have become
        # long enough.  Counting behind several heads at once would multiply the states.
        self.all = compile_rules([(r.pattern + r.tail + ("" if r.pattern else "{%d}" % r.least), r.fold) for r in rules])
        self.whole = _Spans(rules)
        a = self.all
        table = a.table.reshape(-1, a.n_classes)
        resets = (table == 0).all(axis=0)
        self.reset = resets[a.classes]
        self.accepting = a.accepts != 0
        self.steps = a.table * a.n_classes  # states times classes: a step is one addition and one look-up
        self.hot = np.zeros(len(a.accepts) * a.n_classes, bool)
        self.hot[:: a.n_classes] = self.accepting

    def flagged(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the parts in which a rule accepts."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.all.classes[data]
        reset = self.reset[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        inside = ~reset
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        begin = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        order = np.argsort(begin - end, kind="stable")
        at, length = begin[order], (end - begin)[order]
        state = np.zeros(len(at), np.int32)
        found = np.zeros(len(at), bool)
        live, t = len(at), 0
        # Numbers of lanes by step, from the lengths in falling order.
        while live > 64 and t < length[0]:
            live = int(np.searchsorted(-length, -t, "left"))
            if live <= 64:
                break
            state[:live] = self.steps[state[:live] + kind[at[:live] + t]]
            found[:live] |= self.hot[state[:live]]
            t += 1
        steps, hot = self.steps.tolist(), self.hot.tolist()
        for k in range(min(len(at), 64) if t < (length[0] if len(length) else 0) else 0):  # few long lanes are left
            s = int(state[k])
            if found[k] or length[k] <= t:
                continue
            for c in kind[at[k] + t : at[k] + length[k]].tolist():
                s = steps[s + c]
                if hot[s]:
                    found[k] = True
                    break
        return at[found], at[found] + length[found]

    def scan(self, data: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text, (begin, end, rule) in code points, by begin, then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
        begins, ends = self.flagged(data, offs)
        for b, e in sorted(zip(begins.tolist(), ends.tolist(), strict=True)):
            d = int(np.searchsorted(offs, b, "right")) - 1
            out[d] += [(b + i, b + j, k) for i, j, k in self.whole.of(data[b:e].tobytes())]
        for d, found in enumerate(out):
            if found:
                at = int(offs[d])
                points = np.concatenate([[0], np.cumsum((data[at : int(offs[d + 1])] & 0xC0) != 0x80)])
                out[d] = sorted((int(points[i - at]), int(points[j - at]), k) for i, j, k in found)
        return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[SecretRule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, base: tuple[str, ...] = ("assign", "access", "hex"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind> for the base kinds, base_sha256, spans (kind:start:end of
    all rules, by start and then in the rules' order) and n_spans for each row.

    A null or empty text has no spans.  Repeated rows and null ids give a row
    each, an empty table none; other columns aren't read, whatever their names.
    Texts of any length are scanned whole.
    """
    kinds = [r.kind for r in rules]
    base_at = [kinds.index(b) for b in base]
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"n_{b} long" for b in base) + ", base_sha256 string, spans string, n_spans long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        names = ["doc_id", *(f"n_{b}" for b in base), "base_sha256", "spans", "n_spans"]
        for batch, data, offs in pieces(batches, "__text"):
            columns: list[list] = [[] for _ in names[1:]]
            for found in own.scan(data, offs):
                listed = [(k, f"{kinds[k]}:{i}:{j}") for i, j, k in found]
                values = [sum(k == b for k, _ in listed) for b in base_at]
                values += [hashlib.sha256(",".join(x for k, x in listed if k in base_at).encode()).hexdigest(), ",".join(x for _, x in listed), len(listed)]
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            kinds_of = [pa.int64()] * len(base) + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True))], names)

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(scan, schema)
