"""Secret scans through a trigram inverted index.

Each rule is a regular expression.  From its parse tree comes a Boolean query over trigrams
that every match must contain: a run of literals gives the AND of its trigrams, alternatives
give the OR of theirs.  Each Arrow batch of whole texts is indexed as a shard: one pass over
its bytes finds where the trigrams of any query start and yields, per trigram, the postings
(rows of the shard that hold it).  A rule's candidates are the intersections and unions of
postings that its query asks for; only candidates are verified with the regular expression.
Rules whose query is empty -- no literal run of three is mandatory -- scan every text.

The index folds ASCII letters to lower case, so it serves rules in either case.

Edge cases: null text is empty and gives zero counts and empty spans; texts of any length
are scanned whole; rows with null or repeated doc_id give a row each; an empty table gives an
empty one; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tollgate.llm.common import column, map_batches, texts

with warnings.catch_warnings():
    warnings.simplefilter("ignore", DeprecationWarning)
    from re import _parser as sre


_TAIL = re.compile(r"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", re.ASCII)
_HEAD = re.compile(r"\beyJ", re.ASCII)
_RUN = re.compile(r"[^A-Za-z0-9_-]")


def web_tokens(text: str) -> list[tuple[int, int]]:
    """The matches of the jwt rule, in time linear in the text.

    The expression alone starts at every ``eyJ`` and reads to the end of the run of token
    characters each time.  A match has one ``.eyJ`` after its first segment, so each of these is
    tried once, forwards and then back to the beginning of the run before it.
    """
    out, end, dot, after_run = [], 0, text.find(".eyJ"), 0
    while dot >= 0:
        tail = _TAIL.match(text, dot)
        if tail:
            begin = dot
            while begin > max(end, after_run) and not _RUN.match(text, begin - 1):
                begin -= 1
            head = _HEAD.search(text, begin, dot - 8)
            if head and head.start() + 11 <= dot:
                out.append((head.start(), tail.end()))
                end = tail.end()
        after_run = dot + 1
        dot = text.find(".eyJ", max(dot + 1, end))
    return out


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``group`` with ``least`` characters decides whether a match holds.

    ``find`` gives the expression's matches where it alone would take more than linear time.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    find: Callable[[str], list[tuple[int, int]]] | None = None


# The base rules and well-known credential formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36}\b"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"\b(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", find=web_tokens),
)
BASE_KINDS = ("assign", "access", "hex")

# ---- Boolean trigram queries -------------------------------------------------
# A query is True (nothing mandatory), a trigram, ("and", frozenset) or ("or", frozenset).


def both(*queries):
    parts: set = set()
    for q in queries:
        if q is not True:
            parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def either(queries):
    parts: set = set()
    for q in queries:
        if q is True:
            return True
        parts |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def trigrams(s: str):
    """The AND of all trigrams of a literal (its UTF-8 bytes, ASCII letters folded)."""
    b = s.encode().lower()
    return both(*(b[i : i + 3] for i in range(len(b) - 2)))


#: A part of a regex that stands for at most so many strings is written out, so that trigrams reach over its ends.
STRINGS = 16


def strings_of(tree) -> list[str] | None:
    """All strings a parse tree stands for, if they are few."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            more = [chr(c) for _, c in arg]
        elif name == "SUBPATTERN":
            more = strings_of(arg[3])
        elif name == "BRANCH":
            found = [strings_of(t) for t in arg[1]]
            more = None if any(f is None for f in found) else [s for f in found for s in f]
        elif name == "MAX_REPEAT" and (arg[0], arg[1]) == (0, 1):
            inner = strings_of(arg[2])
            more = None if inner is None else ["", *inner]
        elif name == "MAX_REPEAT" and arg[0] == arg[1] and arg[1] <= 4:
            inner = strings_of(arg[2])
            more = inner if inner is None or len(inner) == 1 else None
            more = None if more is None else [more[0] * arg[1]]
        elif name == "AT":
            more = [""]
        else:
            more = None
        if more is None or len(out) * len(more) > STRINGS:
            return None
        out = [a + b for a in out for b in more]
    return out


def query_of(tree):
    """What every match of a parse tree must contain."""
    parts, run = [], [""]

    def close():
        nonlocal run
        parts.append(either(trigrams(s) for s in run))
        run = [""]

    for item in tree:
        op, arg = str(item[0]), item[1]
        more = strings_of([item])
        if more is not None and len(run) * len(more) <= STRINGS:
            run = [a + b for a in run for b in more]
            continue
        close()
        if more is not None:
            run = more
        elif op == "SUBPATTERN":
            parts.append(query_of(arg[3]))
        elif op == "BRANCH":
            parts.append(either(query_of(t) for t in arg[1]))
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            parts.append(query_of(arg[2]))
    close()
    return both(*parts)


def trigram_query(pattern: str):
    return query_of(sre.parse(pattern, re.ASCII))


def mentioned(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(mentioned(q) for q in query[1]))


# ---- a shard's index ---------------------------------------------------------

PIECE = 1 << 20  # bytes indexed at a time


class Scanner:
    """Rules compiled to regular expressions and trigram queries."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        wanted = sorted(set().union(*(mentioned(q) for _, _, q in self.rules)))
        self.slot = {t: k + 1 for k, t in enumerate(wanted)}
        # a slot for each possible trigram: 0 if no query mentions it
        self.slots = np.zeros(1 << 24, np.uint16)
        for t, k in self.slot.items():
            self.slots[int.from_bytes(t, "big")] = k

    def postings(self, raw: pa.Array) -> dict[int, frozenset[int]]:
        """Slot of a trigram -> rows that hold it, over the UTF-8 bytes of a shard."""
        n = len(raw)
        wide = pa.types.is_large_string(raw.type) or pa.types.is_large_binary(raw.type)
        offsets = np.frombuffer(raw.buffers()[1], np.int64 if wide else np.int32)[raw.offset : raw.offset + n + 1].astype(np.int64)
        if not n or offsets[-1] == offsets[0]:
            return {}
        data = np.frombuffer(raw.buffers()[2], np.uint8)
        rows, slots = [], []
        for a in range(int(offsets[0]), int(offsets[-1]), PIECE):
            b = data[a : min(a + PIECE + 2, int(offsets[-1]))]
            if len(b) < 3:
                break
            b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint32)
            found = self.slots[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            at = np.flatnonzero(found)
            row = np.searchsorted(offsets, at + a, "right") - 1
            inside = at + a + 3 <= offsets[row + 1]
            rows.append(row[inside])
            slots.append(found[at[inside]])
        if not rows:
            return {}
        pair = np.unique(np.concatenate(slots).astype(np.int64) * n + np.concatenate(rows))
        out: dict[int, frozenset[int]] = {}
        cut = np.flatnonzero(np.diff(pair // n)) + 1
        for part in np.split(pair, cut) if len(pair) else []:
            out[int(part[0] // n)] = frozenset((part % n).tolist())
        return out

    def candidates(self, query, index: dict[int, frozenset[int]]) -> frozenset[int]:
        if isinstance(query, bytes):
            return index.get(self.slot[query], frozenset())
        found = [self.candidates(q, index) for q in query[1]]
        return frozenset.intersection(*sorted(found, key=len)) if query[0] == "and" else frozenset().union(*found)

    def verify(self, rule: Rule, regex: re.Pattern, text: str) -> list[tuple[int, int]]:
        """Leftmost matches that don't overlap; failing ones are dropped, not retried."""
        if rule.find is not None:
            return rule.find(text)
        return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]

    def scan(self, raw: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per text of the shard: (start, number of the rule, end), in order."""
        index = self.postings(raw)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(raw))]
        texts_of: dict[int, str] = {}
        for k, (rule, regex, query) in enumerate(self.rules):
            for row in range(len(raw)) if query is True else sorted(self.candidates(query, index)):
                text = texts_of.get(row)
                if text is None:
                    text = texts_of[row] = raw[row].as_py() or ""
                found[row] += [(a, k, b) for a, b in self.verify(rule, regex, text)]
        for spans in found:
            spans.sort()
        return found


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""

    def run(batch: pa.RecordBatch):
        s = scanner(rules)
        out = []
        for spans in s.scan(column(batch, "text")):
            named = [(s.rules[k][0], a, b) for a, k, b in spans]
            base = ",".join(f"{r.kind}:{a}:{b}" for r, a, b in named if r.base)
            out.append(
                [sum(r.kind == kind for r, _, _ in named) for kind in BASE_KINDS]
                + [hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{r.kind}:{a}:{b}" for r, a, b in named)]
            )
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    return map_batches(
        docs.select("doc_id", "text"), run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def redact(text: str, spans: list[tuple[int, int, int]], rules: list) -> str:
    """The text with each span, overlapping ones together, replaced by the kind of the first."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{rules[k][0].kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, length_column: str | None = None) -> DataFrame:
    """All columns of ``docs``, secrets in ``text`` replaced; ``length_column`` gets the new length where a text changed."""

    def run(batch: pa.RecordBatch):
        s = scanner(rules)
        found = s.scan(column(batch, "text"))
        if not any(found):
            yield batch
            return
        old = texts(batch)
        changed = {i: redact(old[i], spans, s.rules) for i, spans in enumerate(found) if spans}
        new = {}
        for name, value in (("text", lambda t: t), (length_column, len)):
            if name:
                was = column(batch, name)
                values = was.to_pylist()
                for i, t in changed.items():
                    values[i] = value(t)
                new[name] = pa.array(values, was.type)
        yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], schema=batch.schema)

    return map_batches(docs, run, docs.schema)
