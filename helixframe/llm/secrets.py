"""Secret scanning with one minimised automaton for all rules.

Rules are regular expressions that end in a run: a class of characters, as many as follow.
They are parsed, put together to one NFA, made deterministic by subset construction over
byte classes and minimised by partition refinement.  A state's mask tells for every rule
whether its *trigger* (the head and the first characters of the run) is just complete and
whether the run goes on.  A batch of texts is cut at bytes that lead every state to the
start state (so cutting changes nothing) and all cuts step through the transition array
together: one pass over the bytes, whatever the number of rules, gives all triggers and
the ends of all matches.  Only where a trigger stands is the match's start looked for, by
the automaton of the reversed trigger; matches of one rule are taken from left to right
without overlap.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import pieces

# --------------------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    """A regular expression that ends in a run (a class with +).

    Matches with fewer than ``least`` characters in the run are dropped, but still take their
    place.  The trigger is complete after ``first`` characters of the run; more than one are
    allowed only if the rule is nothing but a run, and ``least`` at most.
    """

    kind: str
    pattern: str
    least: int
    first: int = 1


#: Rules with fixed values: the three base rules, then provider formats.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 24, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]+", 10),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 35),
)
BASE = ("assign", "access", "hex")

# --------------------------------------------------------------------------- regular expressions


@dataclass(frozen=True)
class Part:
    """A set of bytes or alternatives (sequences of parts), ``least`` to ``most`` times; most None is unbounded."""

    body: frozenset | tuple
    least: int = 1
    most: int | None = 1


class Parser:
    """ASCII characters, \\xHH and escaped characters, classes, groups with |, (?i:...) and the quantifiers ? * + {m} {m,} {m,n}."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def parse(self) -> tuple:
        out = self._alternatives(False)
        if self.at < len(self.text):
            raise ValueError(f"{self.text!r}: unexpected {self.text[self.at]!r} at {self.at}")
        return out

    def _take(self, token: str) -> bool:
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def _alternatives(self, fold: bool) -> tuple:
        out = [[]]
        while self.at < len(self.text) and self.text[self.at] != ")":
            if self._take("|"):
                out.append([])
            else:
                out[-1].append(self._quantified(fold))
        return tuple(map(tuple, out))

    def _quantified(self, fold: bool) -> Part:
        if self._take("("):
            body = self._alternatives(self._take("?i:") or fold)
            if not self._take(")"):
                raise ValueError(f"{self.text!r}: a group has no end")
        elif self._take("["):
            body = self._class(fold)
        else:
            body = self._folded({self._char()}, fold)
        for token, least, most in (("?", 0, 1), ("*", 0, None), ("+", 1, None)):
            if self._take(token):
                return Part(body, least, most)
        if self._take("{"):
            low, comma, high = self.text[self.at : (end := self.text.index("}", self.at))].partition(",")
            self.at = end + 1
            return Part(body, int(low), int(high) if high else None if comma else int(low))
        return Part(body)

    def _char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            if c.isalnum():
                raise ValueError(f"{self.text!r}: \\{c} isn't supported")
        elif c in ".^$?*+{":
            raise ValueError(f"{self.text!r}: {c} isn't supported at {self.at - 1}")
        return ord(c)

    def _class(self, fold: bool) -> frozenset:
        out: set[int] = set()
        if self._take("^"):
            raise ValueError(f"{self.text!r}: negated classes aren't supported")
        while not self._take("]"):
            low = high = self._member()
            if self.text.startswith("-", self.at) and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._member()
            out |= set(range(low, high + 1))
        return self._folded(out, fold)

    def _member(self) -> int:
        if self.text[self.at] == "\\":
            return self._char()
        self.at += 1
        return ord(self.text[self.at - 1])

    @staticmethod
    def _folded(chars: set[int], fold: bool) -> frozenset:
        if max(chars) > 127:
            raise ValueError("rules are of ASCII characters")
        return frozenset(ord(f(chr(c))) for c in chars for f in ((str.lower, str.upper) if fold else (str,)))


def head_and_run(rule: Rule) -> tuple[tuple, frozenset]:
    """The parts of a rule before its run, and the characters of the run."""
    every = Parser(rule.pattern).parse()
    *head, run = every[0] if len(every) == 1 and every[0] else [Part(())]
    if not isinstance(run.body, frozenset) or (run.least, run.most) != (1, None) or not 1 <= rule.first <= rule.least or (head and rule.first > 1):
        raise ValueError(f"{rule.kind}: a rule must end in a class with +")
    return tuple(head), run.body


def backwards(parts: tuple) -> tuple:
    return tuple(Part(p.body if isinstance(p.body, frozenset) else tuple(map(backwards, p.body)), p.least, p.most) for p in reversed(parts))


# --------------------------------------------------------------------------- automata


class Nfa:
    def __init__(self) -> None:
        self.move: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.move.append([])
        self.empty.append([])
        return len(self.move) - 1

    def add(self, at: int, parts: tuple) -> int:
        """Append a sequence after state ``at``; gives its last state."""
        for p in parts:
            for _ in range(p.least):
                at = self._once(at, p.body)
            if p.most is None:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self._once(loop, p.body)].append(loop)
                at = loop
            elif p.most > p.least:
                end = self.state()
                for _ in range(p.most - p.least):
                    self.empty[at].append(end)
                    at = self._once(at, p.body)
                self.empty[at].append(end)
                at = end
        return at

    def _once(self, at: int, body: frozenset | tuple) -> int:
        if isinstance(body, frozenset):
            new = self.state()
            self.move[at].append((body, new))
            return new
        ends = [self.add(at, alternative) for alternative in body]
        new = self.state()
        for e in ends:
            self.empty[e].append(new)
        return new

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Dfa:
    table: np.ndarray  # states x classes
    cls: np.ndarray  # class of each byte
    accept: np.ndarray  # bit mask of rules for each state
    start: int
    dead: int  # state without a way to accept, or -1


def determinise(nfa: Nfa, start: int, accepting: dict[int, int], restart: bool) -> Dfa:
    """Subset construction over byte classes, then minimisation; ``restart``: a match may begin anywhere."""
    sets = sorted({s for m in nfa.move for s, _ in m}, key=sorted)
    sign = [tuple(b in s for s in sets) for b in range(256)]
    classes = {x: k for k, x in enumerate(dict.fromkeys(sign))}
    cls = np.array([classes[x] for x in sign], np.int64)
    rep = [sign.index(x) for x in classes]
    first = nfa.closure([start])
    ids, todo, rows, mask = {first: 0}, [first], [], []
    while todo:
        here = todo.pop(0)
        mask.append(sum({accepting[x] for x in here if x in accepting}))
        moves = [m for x in here for m in nfa.move[x]]
        row = []
        for b in rep:
            to = nfa.closure({t for s, t in moves if b in s} | ({start} if restart else set()))
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        rows.append(row)
    return minimise(np.array(rows), cls, np.array(mask), 0)


def minimise(table: np.ndarray, cls: np.ndarray, accept: np.ndarray, start: int) -> Dfa:
    """Moore's partition refinement: split blocks by the blocks their transitions lead to."""
    block = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:
        _, new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == block.max():
            break
        block = new
    _, rep = np.unique(block, return_index=True)
    t, a = block[table[rep]], accept[rep]
    dead = [k for k in range(len(t)) if not a[k] and (t[k] == k).all()]
    return Dfa(t, cls, a, int(block[start]), dead[0] if dead else -1)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        nfa = Nfa()
        start = nfa.state()
        accepting, self.backward = {}, []
        for k, r in enumerate(rules):
            head, run = head_and_run(r)
            trigger = (*head, Part(run, r.first, r.first))
            at = nfa.add(start, trigger)
            going = nfa.add(at, (Part(run, 1, None),))
            accepting[at] = 1 << 2 * k
            accepting[going] = 2 << 2 * k
            one = Nfa()
            s = one.state()
            self.backward.append(determinise(one, s, {one.add(s, backwards(trigger)): 1}, False))
        d = determinise(nfa, start, accepting, True)
        # Accepting states come last, so that a comparison tells them.
        order = np.argsort(d.accept > 0, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.n_cls = d.table.shape[1]
        self.table = (back[d.table[order]] * self.n_cls).astype(np.int32).reshape(-1)
        self.accept, self.start = d.accept[order], int(back[d.start]) * self.n_cls
        self.hot = int((self.accept == 0).sum()) * self.n_cls
        self.cls = d.cls.astype(np.uint8)
        resets = (self.table.reshape(-1, self.n_cls) == self.start).all(axis=0)
        self.reset = resets[self.cls]

    def accepted(self, buf: np.ndarray, offsets: np.ndarray, cut: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Positions after which a trigger is complete or a run goes on, and the masks of rules, by position."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        safe = np.flatnonzero(self.reset[buf]) + 1
        want = np.arange(cut, n, cut)
        at = np.searchsorted(safe, want)
        cuts = safe[at[at < len(safe)]]
        starts = np.unique(np.concatenate([offsets[:-1], cuts, [0]]))
        starts = starts[starts < n]
        length = np.diff(np.append(starts, n))
        order = np.argsort(-length, kind="stable")
        pos, length = starts[order], length[order]
        cls, table = self.cls[buf], self.table
        state = np.full(len(pos), self.start, np.int32)
        alive = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right")
        found, masks = [], []
        for t in range(int(length[0])):
            k = alive[t]
            if k < len(state):
                state, pos = state[:k], pos[:k]
            state = table[state + cls[pos + t]]
            if state.max() >= self.hot:
                i = np.flatnonzero(state >= self.hot)
                found.append(pos[i] + t + 1)
                masks.append(self.accept[state[i] // self.n_cls])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        p, m = np.concatenate(found), np.concatenate(masks)
        o = np.argsort(p, kind="stable")
        return p[o], m[o]

    @staticmethod
    def _longest(d: Dfa, text: bytes, at: int, end: int, step: int) -> int:
        """Where the longest match from ``at`` towards ``end`` ends; -1 without one."""
        s, best = d.start, -1
        table, cls, accept = d.table, d.cls, d.accept
        while at != end:
            s = table[s, cls[text[at] if step > 0 else text[at - 1]]]
            at += step
            if accept[s]:
                best = at
            elif s == d.dead:
                break
        return best

    def spans(self, text: bytes, pos: np.ndarray, mask: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start, then rule."""
        out = []
        for k, r in enumerate(self.rules):
            at = pos[mask >> 2 * k & 1 > 0]
            if not len(at):
                continue
            # a run lasts while every position is accepted by the rule
            inside = pos[mask >> 2 * k & 3 > 0]
            last = inside[np.append(np.flatnonzero(np.diff(inside) > 1), len(inside) - 1)]
            end_of = last[np.searchsorted(last, at)]
            done = 0
            for p, end in zip(at.tolist(), end_of.tolist(), strict=True):
                if p - r.first < done:
                    continue
                start = self._longest(self.backward[k], text, p, done, -1)
                if start < 0:
                    continue
                done = end
                if end - p + r.first >= r.least:
                    out.append((start, end, k))
        return sorted(out, key=lambda x: (x[0], x[2]))


@cache
def scanner() -> Scanner:
    return Scanner()


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, kinds, starts, ends (arrays of all spans, in code points, by start and rule).

    Null and empty texts have no spans.  Repeated rows are scanned each, rows without an id
    too; an empty table gives an empty result.  Other columns are ignored, whatever their names.
    """

    def run(batches):
        scan = scanner()
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in pieces(batch.column(1)):
                pos, mask = scan.accepted(buf, off)
                doc = np.searchsorted(off, pos, "left") - 1
                kinds, starts, ends = ([[] for _ in range(hi - lo)] for _ in range(3))
                cut = [*np.flatnonzero(np.diff(doc, prepend=-1)).tolist(), len(doc)]
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    i = int(doc[a])
                    part = buf[off[i] : off[i + 1]]
                    found = scan.spans(part.tobytes(), pos[a:b] - off[i], mask[a:b])
                    if found:
                        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                        kinds[i] = [scan.rules[k].kind for _, _, k in found]
                        starts[i] = [int(chars[s]) for s, _, _ in found]
                        ends[i] = [int(chars[e]) for _, e, _ in found]
                cols = [pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *cols], names=["doc_id", "kinds", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, kinds array<string>, starts array<long>, ends array<long>")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """The rows of query op4: counts by base kind, the digest of the base spans and all spans."""
    found = scan_secrets(docs)
    every = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string")))
    found = found.withColumn("all", every)
    base = F.filter("all", lambda x: F.substring_index(x, ":", 1).isin(*BASE))
    n = lambda kind: F.size(F.filter("kinds", lambda x: x == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join("all", ",").alias("spans"))


#: The rules once more for SQL: kind, what stands before the run, the run, its least length.
_SQL_RULES = (
    ("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?", "[A-Za-z0-9+/_.=-]+", 6),
    ("access", "AKIA", "[A-Z0-9]+", 16),
    ("hex", "", "[0-9a-f]+", 24),
    ("github", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    ("slack", "xox[baprs]-", "[A-Za-z0-9-]+", 10),
    ("google", "AIza", "[A-Za-z0-9_-]+", 35),
)
_SQL_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS rule, '{kind}' AS kind, unnest(range(len(m))) AS j, unnest(m) AS m, unnest(list_slice(string_split_regex(t, '{head}{run}'), 1, len(m))) AS p, length(regexp_extract(unnest(m), '^{head}({run})$', 1)) >= {least} AS long_enough FROM (SELECT doc_id, t, regexp_extract_all(t, '{head}{run}') AS m FROM d)"
    for k, (kind, head, run, least) in enumerate(_SQL_RULES)
)

#: DuckDB SQL for the query's rows: the pieces between the matches give their places.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_SQL_MATCHES}),
placed AS (SELECT doc_id, rule, kind, m, long_enough, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id, rule ORDER BY j) AS BIGINT) AS e FROM found),
span AS (SELECT doc_id, rule, kind, e - length(m) AS s, kind || ':' || (e - length(m)) || ':' || e AS x FROM placed WHERE long_enough),
agg AS (SELECT doc_id, count(*) FILTER (WHERE rule = 0) AS n_assign, count(*) FILTER (WHERE rule = 1) AS n_access, count(*) FILTER (WHERE rule = 2) AS n_hex,
  coalesce(string_agg(x, ',' ORDER BY s, rule) FILTER (WHERE rule < 3), '') AS base, string_agg(x, ',' ORDER BY s, rule) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN agg USING (doc_id)
"""
