"""Secret scan by one combined deterministic automaton.

All rules are compiled together: each regex becomes a nondeterministic automaton over bytes, subset construction makes them one
deterministic automaton that looks for every rule at every place, and partition refinement minimises it. It is kept as a transition
array over classes of bytes that no rule tells apart. One pass over the bytes gives the state after each of them; the pass runs in
lanes, thousands of places of the text at a time. A lane starts as if nothing had begun before it, and is run again from the state that
the lane before it ended in, up to where both runs agree, so cutting a text into lanes changes nothing.

A rule is a head and a run of one class (its tail). The combined automaton accepts at the first character of the tail, which decides
that there is a match and leaves nothing to be tracked behind it; a rule without a head takes whole runs of its class, so its least
length is put into the automaton and short runs are never looked at. Where the pass meets an accepting state, the stretch back to the
last place at which no rule had begun holds the start: the rule's own anchored automaton gives the leftmost longest matches, none
over another, and matches whose tail is too short are dropped afterwards, as they use up their place all the same.

Rows: null and empty texts have no spans; a text of any length is scanned whole (three bytes of memory for each of its bytes);
repeated rows give repeated results; spans of different kinds may overlap and are ordered by start, then kind in the order of the rules;
an empty table gives an empty table; columns besides id and text are not read. Places are counted in code points, ends are exclusive.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import text_chunks

#: Lanes of a pass, least bytes of a lane, bytes that are scanned at a time.
LANES, LEAST_LANE, PIECE = 4096, 64, 1 << 22


@dataclass(frozen=True)
class Rule:
    """``head`` (a regex) followed by one or more characters of ``tail`` (a class), or ``head`` alone; ``least`` is the shortest tail kept."""

    kind: str
    head: str
    tail: str = ""
    least: int = 1
    any_case: bool = False

    @property
    def mark(self) -> str:
        """What the combined automaton looks for: the shortest text that shows a match."""
        return f"{self.head}{self.tail}" if self.head else f"{self.tail}{{{self.least}}}"

    @property
    def whole(self) -> str:
        """What the rule's own automaton takes."""
        if not self.tail:
            return self.head
        return f"{self.head}{self.tail}+" if self.head else f"{self.tail}{{{self.least},}}"

    @property
    def regex(self) -> str:
        """The rule in the usual notation, before short tails are dropped: the head, if any, is group 1."""
        body = (f"({self.head})" if self.head else "") + (f"{self.tail}+" if self.tail else "")
        return f"(?i){body}" if self.any_case else body


#: The three kinds that results are counted by, in their order.
BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 12, any_case=True),
    Rule("access", "AKIA", "[A-Z0-9]", 14),
    Rule("hex", "", "[0-9a-f]", 16),
)
#: Formats of published credential kinds.
ADDED = (
    Rule("private_key", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abeoprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 8),
    Rule("login_url", r"(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._%+-]+:[^\x00-\x20@/\"'<>]+@"),
)


# ---- from a regex to a nondeterministic automaton ------------------------------------------------------


class _Nfa:
    """States with byte edges (a set of bytes, a target) and empty edges; one accepting state for each rule."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Adds a parsed regex after ``start``; the state it ends in."""
        kind, *rest = tree
        if kind == "bytes":
            end = self.state()
            self.edges[start].append((rest[0], end))
            return end
        if kind == "row":
            for part in rest[0]:
                start = self.add(part, start)
            return start
        if kind == "either":
            end = self.state()
            for part in rest[0]:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(part, own)].append(end)
            return end
        part, low, high = rest
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[loop].append(end)
            self.empty[self.add(part, loop)].append(loop)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


_TOKEN = re.compile(r"\\x[0-9a-fA-F]{2}|\\.|\[\^?(?:\\.|[^\]\\])+\]|\{\d+(?:,\d*)?\}|.", re.DOTALL)
_ITEM = re.compile(r"(\\x[0-9a-fA-F]{2}|\\.|[^\\])(?:-(\\x[0-9a-fA-F]{2}|\\.|[^\\]))?", re.DOTALL)


def _byte(token: str) -> int:
    return int(token[2:], 16) if token.startswith("\\x") else ord(token[-1])


def parsed(pattern: str, any_case: bool = False) -> tuple:
    """A regex of ASCII literals, classes, groups, ``|`` and the repeats ``? * + {m,n}``, as nested tuples."""
    tokens = _TOKEN.findall(pattern)
    at = 0

    def one(values: set[int]) -> tuple:
        if any_case:
            values |= {v ^ 32 for v in values if chr(v).isascii() and chr(v).isalpha()}
        return "bytes", frozenset(values)

    def either() -> tuple:
        nonlocal at
        ways: list[tuple] = []
        while True:
            row: list[tuple] = []
            while at < len(tokens) and tokens[at] not in ("|", ")"):
                token, at = tokens[at], at + 1
                if token == "(":
                    atom = either()
                    at += 1
                elif token[0] == "[" and len(token) > 2:
                    inner = token[2 if token[1] == "^" else 1 : -1]
                    values = {v for a, b in _ITEM.findall(inner) for v in range(_byte(a), _byte(b or a) + 1)}
                    atom = one(set(range(256)) - values if token[1] == "^" else values)
                else:
                    atom = one({_byte(token)})
                while at < len(tokens) and (tokens[at] in ("?", "*", "+") or tokens[at][0] == "{" and len(tokens[at]) > 1):
                    token, at = tokens[at], at + 1
                    low, _, high = {"?": "0,1", "*": "0,", "+": "1,"}.get(token, token[1:-1]).partition(",")
                    atom = ("repeat", atom, int(low), int(low) if "," not in token and token[0] == "{" else int(high) if high else None)
                row.append(atom)
            ways.append(("row", row))
            if at == len(tokens) or tokens[at] == ")":
                return ways[0] if len(ways) == 1 else ("either", ways)
            at += 1

    tree = either()
    if at != len(tokens):
        raise ValueError(f"unbalanced regex: {pattern}")
    return tree


# ---- to a minimal deterministic automaton -----------------------------------------------------------------


@dataclass
class Automaton:
    """``table[state, class]`` is the next state, ``classes[byte]`` a byte's class (one more class ends a text); state 0 is the start, ``rules`` the rules that a state accepts, as bits."""

    table: np.ndarray
    classes: np.ndarray
    rules: np.ndarray


def compiled(patterns: Sequence[tuple[str, bool]], anchored: bool) -> Automaton:
    """Subset construction and minimisation. Without ``anchored`` a match may begin at any place; anchored, the last state is dead."""
    nfa = _Nfa()
    starts, ends = [], {}
    for k, (pattern, any_case) in enumerate(patterns):
        starts.append(nfa.state())
        ends[nfa.add(parsed(pattern, any_case), starts[-1])] = 1 << k
    # Bytes that every edge treats alike share a class.
    sets = list(dict.fromkeys(s for edges in nfa.edges for s, _ in edges))
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = list(dict.fromkeys(signature))
    number = {kind: i for i, kind in enumerate(kinds)}
    classes = np.array([number[s] for s in signature], np.uint8 if len(kinds) < 255 else np.uint16)
    sample = [signature.index(kind) for kind in kinds]
    first = nfa.closed(set(starts))
    again = set(first) if not anchored else set()
    found, rows, todo = {first: 0}, [], [first]
    for subset in todo:
        row = []
        for byte in sample:
            into = nfa.closed({t for s in subset for values, t in nfa.edges[s] if byte in values} | again)
            if into not in found:
                found[into] = len(found)
                todo.append(into)
            row.append(found[into])
        rows.append([*row, 0])  # the end of a text
    table = np.array(rows, np.int64)
    rules = np.array([sum({bit for s, bit in ends.items() if s in subset}) for subset in found], np.int64)
    # Refinement: the start stays apart, as only there nothing has begun; so does the dead state.
    dead = np.array([not subset for subset in found])
    block = np.unique(np.stack([rules, np.arange(len(rules)) == 0, dead], 1), axis=0, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[table[:, :-1]]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = list(dict.fromkeys(block.tolist()))  # the start comes first
    if anchored and dead.any():
        order.remove(gone := int(block[dead][0]))
        order.append(gone)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    one_of = np.array([int(np.argmax(block == b)) for b in order])
    return Automaton(place[block[table[one_of]]], classes, rules[one_of])


class Scanner:
    """The combined automaton and, for resolving, each rule's own."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = list(rules)
        self.all = compiled([(r.mark, r.any_case) for r in rules], anchored=False)
        self.own = [compiled([(r.whole, r.any_case)], anchored=True) for r in rules]
        self.heads = [compiled([(r.head, r.any_case)], anchored=True) if r.head and r.tail and r.least > 1 else None for r in rules]
        width = self.all.table.shape[1]
        self.width, self.jump = width, (self.all.table * width).astype(np.int32).ravel()
        self.accepts = np.repeat(self.all.rules != 0, width)

    def pass_over(self, kinds: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """States (times the number of classes) after each of the classes of bytes in ``kinds``, beginning in ``state``; the last one."""
        n = len(kinds)
        steps = max(LEAST_LANE, -(-n // LANES))
        lanes = -(-n // steps)
        padded = np.full(lanes * steps, self.width - 1, kinds.dtype)
        padded[:n] = kinds
        by_step = np.ascontiguousarray(padded.reshape(lanes, steps).T)
        states = np.empty((steps, lanes), np.int32)
        now = np.zeros(lanes, np.int32)
        now[0] = state
        for t in range(steps):
            now = self.jump[now + by_step[t]]
            states[t] = now
        began = np.zeros(lanes, np.int32)
        began[0] = state
        while len(wrong := np.flatnonzero(states[-1, :-1] != began[1:]) + 1):
            now = began[wrong] = states[-1, wrong - 1]
            for t in range(steps):
                now = self.jump[now + by_step[t, wrong]]
                differ = now != states[t, wrong]
                if not differ.all():
                    wrong, now = wrong[differ], now[differ]
                    if not len(wrong):
                        break
                states[t, wrong] = now
        flat = states.T.reshape(-1)[:n]
        return flat, int(flat[-1])

    def _longest(self, dfa: Automaton, text: np.ndarray, at: int) -> int:
        """End of the longest match that begins at ``at``; -1 if none."""
        dead, state, end = len(dfa.rules) - 1, 0, -1
        table, kinds = dfa.table, dfa.classes
        while at < len(text):
            into = int(table[state, kinds[text[at]]])
            if into == dead and not dfa.rules[dead]:
                break
            state, at = into, at + 1
            if dfa.rules[state]:
                end = at
                stays, reach = table[state, :-1] == state, 64
                while at < len(text):  # a run that stays in this state, in growing leaps
                    inside = stays[kinds[text[at : at + reach]]]
                    step = len(inside) if inside.all() else int(np.argmin(inside))
                    at, end = at + step, end + step
                    if step < len(inside):
                        break
                    reach *= 16
        return end

    def resolve(self, k: int, text: np.ndarray, at: int, until: int) -> Iterator[tuple[int, int, bool]]:
        """Matches of rule ``k`` that begin from ``at`` to ``until``, leftmost first, none over another; whether each is kept."""
        rule = self.rules[k]
        starts = self.own[k].table[0, :-1] != len(self.own[k].rules) - 1
        may = np.flatnonzero(starts[self.own[k].classes[text[at:until]]]) + at
        i = 0
        while (i := i + int(np.searchsorted(may[i:], at))) < len(may):
            at = int(may[i])
            end = self._longest(self.own[k], text, at)
            if end < 0:
                at += 1
                continue
            head = self._longest(self.heads[k], text[:end], at) if self.heads[k] else at
            yield at, end, not rule.tail or end - head >= rule.least
            at = end

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each row of a run of texts: (start, rule, end) in code points, in order."""
        rows = len(offsets) - 1
        ends = offsets[1:]
        kinds = np.insert(self.all.classes[data], ends, self.width - 1)  # each text is followed by an end
        hit, calm, state = [], np.empty(len(kinds), bool), 0
        seen = []
        for a in range(0, len(kinds), PIECE):
            states, state = self.pass_over(kinds[a : a + PIECE], state)
            calm[a : a + PIECE] = states == 0
            at = np.flatnonzero(self.accepts[states])
            hit.append(at + a)
            seen.append(self.all.rules[states[at] // self.width])
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
        places = np.concatenate(hit) if hit else np.zeros(0, np.int64)
        if not len(places):
            return out
        accepted = np.concatenate(seen)
        quiet = np.flatnonzero(calm)
        nth = np.searchsorted(quiet, places)
        first = np.flatnonzero(np.concatenate([[True], nth[1:] != nth[:-1]]))
        which = np.bitwise_or.reduceat(accepted, first)
        before, taken = -1, [0] * len(self.rules)  # up to where the rules have taken the text
        for z, rules in zip(nth[first].tolist(), which.tolist(), strict=True):
            a = int(quiet[z - 1]) + 1 if z else 0
            row = int(np.searchsorted(ends + np.arange(1, rows + 1), a, side="right"))
            begin = int(offsets[row])
            if row != before:
                before, taken = row, [0] * len(self.rules)
            # The stretch ends at the next quiet place at the latest: the end of a text is one.
            text, shift = data[begin : ends[row]], row + begin
            for k in range(len(self.rules)):
                if rules >> k & 1:
                    for s, e, kept in self.resolve(k, text, max(a - shift, taken[k]), int(quiet[z]) - shift):
                        taken[k] = e
                        if kept:
                            out[row].append((s, k, e))
        for row, spans in enumerate(out):
            if spans:
                points = np.concatenate([[0], np.cumsum((data[offsets[row] : offsets[row + 1]] & 0xC0) != 0x80)])
                out[row] = sorted((int(points[s]), k, int(points[e])) for s, k, e in spans)
        return out


@functools.cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def spans(text: Column, rules: Sequence[Rule] = BASE + ADDED) -> Column:
    """array<struct<kind, start, end>> of a text's secrets; the automata are compiled here and go to the workers as arrays."""
    own = scanner(tuple(rules))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = pa.array([r.kind for r in own.rules])
        for part in parts:
            found = [row for _, _, data, offsets in text_chunks(part) for row in own.spans(data, offsets)]
            flat = np.array([s for row in found for s in row], np.int64).reshape(-1, 3)
            lengths = np.concatenate([[0], np.cumsum([len(row) for row in found])]).astype(np.int32)
            items = pa.StructArray.from_arrays([names.take(pa.array(flat[:, 1])), pa.array(flat[:, 0]), pa.array(flat[:, 2])], ["kind", "start", "end"])
            yield pa.ListArray.from_arrays(pa.array(lengths), items)

    return F.arrow_udf(run, "array<struct<kind:string,start:bigint,end:bigint>>")(text.cast("string"))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = ADDED) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row for each row of ``docs``."""
    def joined(column: Column) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = docs.select(F.col(doc_id).alias("doc_id"), spans(F.col(text), BASE + tuple(rules)).alias("_s"))
    base = F.filter("_s", lambda s: s["kind"].isin([r.kind for r in BASE]))
    counts = [F.expr(f"CAST(size(filter(_s, s -> s.kind = '{r.kind}')) AS BIGINT) AS n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_s")).alias("spans"))


def _sql() -> str:
    """Each rule by regular expressions: a text is split at a rule's matches, so lengths of pieces and matches give the places."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    found = []
    for k, rule in enumerate(BASE + ADDED):
        tail = f"length(m) - length(regexp_extract(m, {quoted(('(?i)' if rule.any_case else '') + '^(' + rule.head + ')')}))" if rule.head else "length(m)"
        kept = f"{tail} >= {rule.least}" if rule.tail else "true"
        found.append(
            f"SELECT r, {k} AS k, {quoted(rule.kind)} AS kind, s, s + length(m) AS e FROM (SELECT r, m, sum(length(p) + coalesce(length(m), 0)) OVER (PARTITION BY r ORDER BY i) - length(m) AS s "
            f"FROM (SELECT r, unnest(ps) AS p, unnest(ms) AS m, unnest(range(len(ps))) AS i FROM (SELECT r, string_split_regex(t, {quoted(rule.regex)}) AS ps, regexp_extract_all(t, {quoted(rule.regex)}) AS ms FROM d WHERE regexp_matches(t, {quoted(rule.regex)})))) WHERE m IS NOT NULL AND {kept}"
        )
    one = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k)"
    base = len(BASE)
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    return (
        "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), "
        f"found AS ({' UNION ALL '.join(found)}), "
        f"by_row AS (SELECT r, {counts}, {one} FILTER (k < {base}) AS base, {one} AS spans FROM found GROUP BY r) "
        f"SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN by_row USING (r)"
    )


SQL = _sql()
