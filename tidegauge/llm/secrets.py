"""Operator 4: secret scan with one combined deterministic automaton.

All rule patterns become one nondeterministic automaton with an implicit "anything before"; subset construction over
byte classes and minimisation give a single transition array. One pass over the UTF-8 bytes reports, for each rule,
where a match can end. The leftmost start of that end comes from the rule's own reversed automaton, run backwards
and never beyond the rule's previous match, so both passes are linear. Matches are leftmost, longest and do not
overlap within a kind; a match whose measured part is too short is dropped after it has used up its text.

Null and empty texts have no spans. Offsets are code points, end exclusive. Rows are independent: no shuffle; the
broadcast is the automaton, whose size depends on the rules alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import process_store, share


@dataclass(frozen=True)
class Rule:
    """A kind, its pattern, and the least length of a group (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds. Runs of hexadecimal digits are maximal, so part of their least length can stand in the
#: pattern without changing a result: fewer ends to look at, few more states.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{8,}", 0, 32),
)
#: Further kinds that the base ones don't cover.
EXTRA = (
    Rule("hub_token", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class _Nfa:
    """Character steps and empty steps between numbered states."""

    def __init__(self) -> None:
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.empty.append([])
        return len(self.steps) - 1

    def add(self, items, here: int, fold: bool = False) -> int:
        """Append a parsed pattern after state ``here``; the state where it ends."""
        for op, arg in items:
            if op in (sre.LITERAL, sre.IN):
                here = self._step(here, _bytes(op, arg, fold))
            elif op is sre.SUBPATTERN:
                here = self.add(arg[3], here, fold or bool(arg[1] & re.IGNORECASE))
            elif op is sre.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    first = self.state()
                    self.empty[here].append(first)
                    self.empty[self.add(branch, first, fold)].append(end)
                here = end
            elif op is sre.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    here = self.add(body, here, fold)
                end = self.state()
                self.empty[here].append(end)
                if high is sre.MAXREPEAT:
                    loop = self.state()
                    self.empty[here].append(loop)
                    last = self.add(body, loop, fold)
                    self.empty[last] += [loop, end]
                else:
                    for _ in range(high - low):
                        here = self.add(body, here, fold)
                        self.empty[here].append(end)
                here = end
            else:
                raise ValueError(f"unsupported in a rule: {op}")
        return here

    def _step(self, here: int, chars: frozenset[int]) -> int:
        there = self.state()
        self.steps[here].append((chars, there))
        return there

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if self.steps[s] or not self.empty[s])

    def reversed(self) -> _Nfa:
        out = _Nfa()
        for _ in self.steps:
            out.state()
        for s, steps in enumerate(self.steps):
            for chars, t in steps:
                out.steps[t].append((chars, s))
            for t in self.empty[s]:
                out.empty[t].append(s)
        return out


def _bytes(op, arg, fold: bool) -> frozenset[int]:
    chars: set[int] = set()
    for kind, value in [(op, arg)] if op is sre.LITERAL else arg:
        chars |= {value} if kind is sre.LITERAL else set(range(value[0], value[1] + 1))
    if fold:
        chars |= {ord(c) for x in chars for c in (chr(x).upper(), chr(x).lower())}
    if max(chars) > 127:
        raise ValueError("rules match ASCII characters")
    return frozenset(chars)


def _determinise(nfa: _Nfa, start: frozenset[int], final: dict[int, int], restart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction: transitions (states x 256) and the mask of rules accepted in each state."""
    groups: dict[tuple[int, ...], list[int]] = {}
    sets = sorted({chars for steps in nfa.steps for chars, _ in steps}, key=sorted)
    for b in range(256):
        groups.setdefault(tuple(i for i, chars in enumerate(sets) if b in chars), []).append(b)
    number, order, rows = {start: 0}, [start], []
    for subset in order:  # grows while it is read
        row = np.zeros(256, np.int32)
        for members in groups.values():
            moved = {t for s in subset for chars, t in nfa.steps[s] if members[0] in chars}
            to = nfa.closure(moved | (set(start) if restart else set()))
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row[members] = number[to]
        rows.append(row)
    masks = np.array([sum({1 << final[s] for s in subset if s in final}) for subset in order], np.int64)
    return np.array(rows), masks


def _minimise(table: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no text can tell apart; state 0 stays the start and accepting states come last."""
    block = np.unique(masks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    order = sorted(range(len(first)), key=lambda k: (masks[first[k]] != 0, k != block[0], k))
    place = np.argsort(order)
    return place[block[table[first[order]]]].astype(np.int32), masks[first[order]]


class CombinedAutomaton:
    """Transition arrays for a set of rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nfa, starts, final, self.back = _Nfa(), [], {}, []
        for k, rule in enumerate(rules):
            own = _Nfa()
            first = own.state()
            last = own.add(_parser.parse(rule.pattern), first)
            self.back.append(_minimise(*_determinise(r := own.reversed(), r.closure([last]), {first: 0}, False)))
            first = nfa.state()
            starts.append(first)
            end = nfa.state()
            nfa.empty[nfa.add(_parser.parse(rule.pattern), first)].append(end)
            final[end] = k
        self.table, self.masks = _minimise(*_determinise(nfa, nfa.closure(starts), final, True))

    def scanner(self) -> Scanner:
        return Scanner(self)


class Scanner:
    """The automaton as flat lists for scanning; built once for each Python process."""

    def __init__(self, auto: CombinedAutomaton):
        self.rules = auto.rules
        self.first_final = int((auto.masks != 0).argmax()) * 256
        shared = [s * 256 for s in range(len(auto.table))]
        self.table = [shared[s] for s in auto.table.ravel().tolist()]
        self.masks = auto.masks.tolist()
        self.back = [(t.tolist(), (m != 0).tolist()) for t, m in auto.back]
        self.dead = [next((s for s, row in enumerate(t) if not f[s] and set(row) == {s}), -1) for t, f in self.back]
        self.full = [re.compile(r.pattern, re.ASCII) for r in auto.rules]

    def ends(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(rule, end) wherever the longest match of a rule ends, in order of the end."""
        table, first_final, masks = self.table, self.first_final, self.masks
        state = live = 0
        for i, b in enumerate(data):
            state = table[state + b]
            if state >= first_final:
                now = masks[state >> 8]
                if live & ~now:
                    yield from self._rules(live & ~now, i)
                live = now
            elif live:
                yield from self._rules(live, i)
                live = 0
        yield from self._rules(live, len(data))

    @staticmethod
    def _rules(mask: int, end: int) -> Iterator[tuple[int, int]]:
        k = 0
        while mask:
            if mask & 1:
                yield k, end
            mask >>= 1
            k += 1

    def start(self, k: int, data: bytes, end: int, least: int) -> int:
        """The leftmost start, at least ``least``, of a match of rule k that ends at ``end``; -1 if there is none."""
        table, final = self.back[k]
        state, best, dead = 0, -1, self.dead[k]
        for i in range(end - 1, least - 1, -1):
            state = table[state][data[i]]
            if state == dead:
                break
            if final[state]:
                best = i
        return best

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, by start, then rule."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        done, found = [0] * len(self.rules), []
        for k, end in self.ends(data):
            start = self.start(k, data, end, done[k])
            if start < 0:
                continue
            done[k] = end
            rule = self.rules[k]
            if rule.least and len(self.full[k].fullmatch(data[start:end].decode("ascii")).group(rule.group)) < rule.least:
                continue
            found.append((start, k, end))
        found.sort()
        if found and not text.isascii():
            at = {b: 0 for s, _, e in found for b in (s, e)}
            seen = chars = 0
            for b in sorted(at):
                chars += len(data[seen:b].decode("utf-8", "surrogatepass"))
                seen = b
                at[b] = chars
            found = [(at[s], k, at[e]) for s, k, e in found]
        return found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All spans of every whole text: the columns of ``keep`` and found, array<struct<start, end, kind>> in order."""
    key = ("secrets", hashlib.sha256(repr(rules).encode()).hexdigest())
    auto = process_store().setdefault(("automaton", key), None) or CombinedAutomaton(rules)
    process_store()[("automaton", key)] = auto
    shared = share(docs, auto)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = process_store()
        scanner = store.get(key) or store.setdefault(key, shared().scanner())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            rows = [[(s, e, rules[k].kind) for s, k, e in scanner.spans(v.as_py())] for v in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([[dict(zip(("start", "end", "kind"), x)) for x in r] for r in rows], kind)], [*keep, "found"])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, ", ".join([*fields, "found array<struct<start:bigint,end:bigint,kind:string>>"]))
