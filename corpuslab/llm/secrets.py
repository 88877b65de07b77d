"""Secret scans by one deterministic automaton of all rules, minimised, in one pass over the bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, slices, table

# The rules, as (kind, pattern, fewest characters of the match, fewest characters of its last part).
# The patterns use sets, groups, alternation, ?, *, + and {n,}. Kinds are listed in the order that breaks ties.
RULES = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 0, 6),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 40, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20, 0),
    ("google", r"AIza[A-Za-z0-9_-]+", 39, 0),
    ("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", 0, 0),
)
# What belongs to a match of these kinds behind it, line breaks included: the first pattern that fits. Of a
# key block: header fields, the body up to its END line; without that line, the lines of 40 or more base64 characters
# that follow.
TAILS = {"pem": (r"(\x0D?\x0A[A-Za-z-]+:\x20[\x20-\x7E]*)*[A-Za-z0-9+/=\x5C\x20\x09\x0D\x0A]*-----END\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", r"(\x0D?\x0A[A-Za-z0-9+/=]{40,})*")}
BASE = ("assign", "access", "hex")
#: Pieces of a text that are no longer scanned side by side.
FEW = 16




def either(kind: str) -> str:
    """The tail's patterns as one regular expression."""
    return f"({'|'.join(TAILS[kind])})" if kind in TAILS else ""


class _Nfa:
    """Thompson's construction for the patterns above; a fragment is (first state, last state)."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def parse(self, pattern: str) -> tuple[int, int]:
        self.p, self.i = pattern, 0
        return self._either()

    def _peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def _either(self) -> tuple[int, int]:
        parts = [self._sequence()]
        while self._peek() == "|":
            self.i += 1
            parts.append(self._sequence())
        if len(parts) == 1:
            return parts[0]
        a, z = self.state(), self.state()
        for x, y in parts:
            self.empty[a].append(x)
            self.empty[y].append(z)
        return a, z

    def _sequence(self) -> tuple[int, int]:
        a = z = self.state()
        while self._peek() not in ("", "|", ")"):
            x, y = self._repeated()
            self.empty[z].append(x)
            z = y
        return a, z

    def _repeated(self) -> tuple[int, int]:
        start = self.i
        x, y = self._atom()
        stop, sign = self.i, self._peek()
        if sign == "{":
            close = self.p.index(",}", self.i)
            n, after = int(self.p[self.i + 1 : close]), close + 2
            for k in range(n):  # the last of the copies repeats
                self.i = start
                u, v = self._atom()
                if k == n - 1:
                    self.empty[v].append(u)
                self.empty[y].append(u) if k else None
                x, y = (x, v) if k else (u, v)
            self.i = after
            return x, y
        if sign and sign in "?*+":
            self.i = stop + 1
            a, z = self.state(), self.state()
            self.empty[a].append(x)
            self.empty[y].append(z)
            if sign != "+":
                self.empty[a].append(z)
            if sign != "?":
                self.empty[y].append(x)
            return a, z
        return x, y

    def _sign(self) -> int:
        """A character, or the escape \\xhh."""
        c = self.p[self.i]
        if c == "\\":
            self.i += 4
            return int(self.p[self.i - 2 : self.i], 16)
        self.i += 1
        return ord(c)

    def _atom(self) -> tuple[int, int]:
        c = self._peek()
        self.i += 1
        if c == "(":
            found = self._either()
            self.i += 1
            return found
        if c == "[":
            members: set[int] = set()
            while self._peek() != "]":
                low = high = self._sign()
                if self._peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    high = self._sign()
                members |= {*range(low, high + 1)}
            self.i += 1
        else:
            self.i -= 1
            members = {self._sign()}
        a, z = self.state(), self.state()
        self.moves[a].append((frozenset(members), z))
        return a, z


class Dfa:
    """``step[state, byte]`` and, for each state, the rules that end there as a bit set. State 0 is the first."""

    def __init__(self, patterns: list[str], anywhere: bool) -> None:
        nfa = _Nfa()
        first, ends = nfa.state(), {}
        for k, pattern in enumerate(patterns):
            a, z = nfa.parse(pattern)
            nfa.empty[first].append(a)
            ends[z] = 1 << k

        def closed(states: set[int]) -> frozenset[int]:
            todo, seen = list(states), set(states)
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(s for s in seen if nfa.moves[s] or s in ends)

        # Bytes that no set tells apart form one class.
        sets = list({m for moves in nfa.moves for m, _ in moves})
        kinds: dict[tuple[bool, ...], int] = {}
        self.of_byte = np.array([kinds.setdefault(tuple(b in m for m in sets), len(kinds)) for b in range(256)])
        sample = [int(np.flatnonzero(self.of_byte == k)[0]) for k in range(len(kinds))]
        start = closed({first})
        number, order, table_, = {start: 0}, [start], []
        for here in order:
            row = []
            for b in sample:
                to = {t for s in here for m, t in nfa.moves[s] if b in m}
                there = closed(to) | start if anywhere else closed(to)
                if there not in number:
                    number[there] = len(order)
                    order.append(there)
                row.append(number[there])
            table_.append(row)
        step = np.array(table_, np.int32)
        accept = np.array([sum({ends[s] for s in here if s in ends}) for here in order], np.int32)
        self.n_built = len(order)
        self._minimise(step, accept)

    def _minimise(self, step: np.ndarray, accept: np.ndarray) -> None:
        """Moore's refinement: states stay together while their outputs and the classes of their successors agree."""
        group = np.unique(accept, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        n, one = group.max() + 1, np.zeros(group.max() + 1, np.int64)
        one[group[::-1]] = np.arange(len(group))[::-1]
        rename = np.arange(n)
        rename[[0, group[0]]] = group[0], 0  # the first state gets number 0
        back = np.argsort(rename)
        self.step = np.ascontiguousarray(rename[group[step[one[back]]]][:, self.of_byte].astype(np.int32))
        self.accept = accept[one[back]]
        self.dead = int(x[0]) if len(x := np.flatnonzero((self.step == np.arange(n)[:, None]).all(axis=1) & (self.accept == 0))) else -1


class Tail:
    """The end of what belongs to a match behind it: by an automaton for each pattern, the first that fits, as long as it fits."""

    def __init__(self, patterns: tuple[str, ...]) -> None:
        self.own = [(d.step.tolist(), d.accept.tolist(), d.dead) for d in (Dfa([p], anywhere=False) for p in patterns)]

    def end(self, text: bytes, at: int, limit: int, known: dict[tuple[int, int, int], int]) -> int:
        """``known`` keeps, for places behind line breaks and states there, the last end from there on (-1: none).

        Scans that meet are the same from there on, so that all of a text's take time in proportion to its length.
        """
        for k, (step, accept, dead) in enumerate(self.own):
            s, i, end, met = 0, at, at if accept[0] else -1, []
            while i < limit and (s := step[s][text[i]]) != dead:
                i += 1
                if accept[s]:
                    end = i
                if text[i - 1] == 10:
                    if (k, i, s) in known:
                        end = max(end, known[k, i, s])
                        break
                    met.append((k, i, s))
            known |= {x: end if end > x[1] else -1 for x in met}
            if end >= 0:
                return end
        return at


class Scanner:
    """All rules in one automaton that may begin anywhere, and each rule's own for the place of its matches."""

    def __init__(self, rules: tuple = RULES) -> None:
        self.rules = rules
        self.all = Dfa([r[1] for r in rules], anywhere=True)
        self.flat = self.all.step.ravel()
        self.rows: tuple[list, list] | None = None
        #: Bytes after which the automaton is in its first state, whatever came before.
        self.resets = (self.all.step == 0).all(axis=0)
        if not self.resets[10]:
            raise ValueError("a rule takes line breaks; texts could not be scanned side by side")
        self.own = [Dfa([r[1]], anywhere=False) for r in rules]
        self.tails = [Tail(TAILS[r[0]]) if r[0] in TAILS else None for r in rules]
        self.first = [bytes(np.flatnonzero(d.step[0] != d.dead).astype(np.uint8)) for d in self.own]

    def ends(self, stream: np.ndarray, about: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the stream at which a rule ends, and which rules (bits).

        The stream is cut behind bytes that reset the automaton, into pieces of ``about`` bytes or more; all pieces
        advance by one byte at a time, side by side, so that each byte is read once.
        """
        cuts = np.flatnonzero(self.resets[stream]) + 1
        cuts = cuts[np.unique(np.searchsorted(cuts, np.arange(about, len(stream), about)).clip(max=max(0, len(cuts) - 1)))] if len(cuts) else cuts
        begin = np.unique(np.concatenate([[0], cuts]))
        begin = begin[begin < len(stream)]
        length = np.diff(np.append(begin, len(stream)))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        state = np.zeros(len(begin), np.int32)
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        where, what = [], []
        for t, n in enumerate(active.tolist()):
            if n <= FEW and t >= about:  # a few very long pieces are left: on with them one by one
                for k in range(n):
                    for at, of in self._rest(stream, int(begin[k]) + t, int(begin[k] + length[k]), int(state[k])):
                        where.append(np.array([at], np.int64))
                        what.append(np.array([of], np.int32))
                break
            state = self.flat[state[:n] * 256 + stream[begin[:n] + t]]
            hit = np.flatnonzero(self.all.accept[state])
            if len(hit):
                where.append(begin[hit] + t)
                what.append(self.all.accept[state[hit]])
        return (np.concatenate(where), np.concatenate(what)) if where else (np.empty(0, np.int64), np.empty(0, np.int32))

    def _rest(self, stream: np.ndarray, at: int, end: int, state: int) -> Iterator[tuple[int, int]]:
        """The same for one piece from some place and state on."""
        if self.rows is None:
            self.rows = self.all.step.tolist(), self.all.accept.tolist()
        step, accept = self.rows
        for i, byte in enumerate(stream[at:end].tobytes(), at):
            state = step[state][byte]
            if accept[state]:
                yield i, accept[state]

    def matches(self, text: bytes, rule: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """Leftmost, longest, non-overlapping matches of one rule in text[lo:hi], those that fail its lengths left out."""
        dfa, (_, _, fewest, value) = self.own[rule], self.rules[rule]
        step, accept, dead, first, at = dfa.step, dfa.accept, dfa.dead, self.first[rule], lo
        while at < hi:
            if text[at] not in first:
                at += 1
                continue
            s, end, i = 0, -1, at
            while i < hi and (s := step[s, text[i]]) != dead:
                i += 1
                if accept[s]:
                    end = i
            if end < 0:
                at += 1
                continue
            if end - at >= fewest and (not value or end - self._value(text, at, end) >= value):
                yield at, end
            at = end

    @staticmethod
    def _value(text: bytes, at: int, end: int) -> int:
        """Where the value begins: behind the first sign, blanks and a quote; it may hold further signs."""
        i = at
        while text[i] not in b":=":
            i += 1
        i += 1
        while text[i] == 32:
            i += 1
        return i + (text[i] in b"\"'" and i + 1 < end)

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its matches (start, kind's number, end), in code points, by start and kind.

        The automaton finds the header of a kind in ``TAILS``; the span goes on to the end of its tail.
        """
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        joined = b"\n".join(texts)
        stream = np.frombuffer(joined, np.uint8)
        where, what = self.ends(stream)
        if not len(where):
            return out
        order = np.argsort(where, kind="stable")
        where, what = where[order], what[order]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        resets = np.flatnonzero(self.resets[stream])
        for k in range(len(self.rules)):
            at = where[what >> k & 1 == 1]
            if not len(at):
                continue
            # Each stretch between two resets that holds an end of this rule.
            left = np.searchsorted(resets, at, side="left")
            lo = np.unique(np.append(-1, resets)[left] + 1)
            hi = np.append(resets, len(stream))[np.searchsorted(resets, lo, side="left")]
            tail, upto, known = self.tails[k], 0, {}
            for a, z in zip(lo.tolist(), hi.tolist(), strict=True):
                if stretch := list(self.matches(joined, k, a, z)):
                    doc = int(np.searchsorted(starts, a, side="right")) - 1
                    base = int(starts[doc])
                    for s, e in stretch:
                        if tail:
                            if s < upto:
                                continue
                            e = upto = tail.end(joined, e, base + len(texts[doc]), known)
                        before = len(joined[base:s].decode())
                        out[doc].append((before, k, before + e - s))  # matches are ASCII
        return [sorted(x) for x in out]


@cache
def scanner(rules: tuple = RULES) -> Scanner:
    return Scanner(rules)


def find_secrets(df: DataFrame, text: str = "text", rules: tuple = RULES) -> DataFrame:
    """``df`` with ``secrets``: array of (kind, start, end) in code points, end exclusive, by start and then kind.

    Null text counts as empty: no secrets. Rows are independent; copies, ties, repeated rows and empty tables need
    nothing special. Texts are scanned whole, in batches of bounded bytes. An input column named secrets is replaced.
    """
    own = [c for c in df.columns if c != "secrets"]
    kept = df.select(*[f"`{c}`" for c in own])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "secrets array<struct<kind:string,start:int,end:int>>"])
    kinds = [r[0] for r in rules]
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules).scan
        for batch in slices(batches, text, 8 << 20):
            found = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in x] for x in scan(as_bytes(batch.column(text)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, spans)], names=[*own, "secrets"])

    return kept.mapInArrow(work, schema)


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]", rules: tuple = RULES) -> DataFrame:
    """``df`` with every secret of ``text`` replaced by ``mask``; overlapping spans become one. Null stays null."""
    own = df.columns
    schema = df.schema

    def masked(t: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for s, _, e in spans:
            if s >= at:
                out += [t[at:s], mask]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules).scan
        for batch in slices(batches, text, 8 << 20):
            column = batch.column(text)
            found = scan(as_bytes(column))
            texts = [t if t is None or not f else masked(t, f) for t, f in zip(column.to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in own], names=own)

    return df.mapInArrow(work, schema)


def _digest(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    def count(kind: str):  # noqa: ANN202
        return F.size(F.filter("secrets", lambda x: x.kind == kind)).cast("long")

    def joined(spans):  # noqa: ANN001, ANN202
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda x: x.kind.isin(*BASE))
    return df.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document: counts and digest of the base kinds, and all spans. Null text: none."""
    return _digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _oracle() -> str:
    """Places are the lengths of what is between the matches and of the matches before."""
    parts = []
    for k, (kind, pattern, fewest, value) in enumerate(RULES):
        quoted = (pattern + either(kind)).replace("'", "''")
        ends = "regexp_extract(m[i], '[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)"
        parts.append(
            f"SELECT doc_id, {k} AS k, '{kind}' AS kind, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n FROM "
            f"(SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS s FROM d)) WHERE length(m[i]) >= {fewest}" + (f" AND length({ends}) >= {value}" if value else "")
        )
    joined = "coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k){0}, '')"
    base = " FILTER (WHERE k < 3)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, kind, k, CAST(a AS BIGINT) AS a, CAST(n AS BIGINT) AS n FROM f)
SELECT doc_id, count(kind) FILTER (WHERE kind = 'assign') AS n_assign, count(kind) FILTER (WHERE kind = 'access') AS n_access, count(kind) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256({joined.format(base)}) AS base_sha256, {joined.format("")} AS spans
FROM d LEFT JOIN g USING (doc_id) GROUP BY doc_id
"""


ORACLE = _oracle()
