"""Token counts by prefix dynamic programming.

A byte-level BPE encoding has one *last token* for every prefix of a piece of text.  With
the last token of every shorter prefix known, the last token ``t`` of the prefix ending at
``i`` is the one vocabulary entry that ends there and may follow ``last[i - len(t)]``: the
encoding of both together is the two of them.  So

    count[i] = count[i - len(t)] + 1

gives the exact token count of *every* prefix in one pass.  Truncation and budget questions
("how many tokens has the first half", "where do 1,024 tokens end") then are look-ups; no
text is encoded again.

Text is dealt with in chunks of white space followed by other characters.  A piece of the
vocabulary's pre-tokenizer never reaches from other characters into white space, so chunks
are independent and the count of a text is the sum over its chunks.  Tables of short chunks
are remembered within a bounded dictionary per worker.

Edge cases: null text counts as the empty text (0 tokens), special strings inside a text
are one token each as the library has it by default, texts of any length are counted whole,
repeated rows give repeated results and an empty table gives an empty one.  Only ``doc_id``
and ``text`` are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tollgate.llm.common import column, map_batches, texts

# Unicode White_Space, as the pre-tokenizer's \s has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
BLANK = re.compile(f"[{WHITE}]*")
PARTS = re.compile(r"(?<=[A-Za-z])(?=[!-@\[-`{-~])")
# A chunk that is one piece: letters of the Latin blocks, after a space or not.
WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+\Z")
# The vocabulary's byte alphabet: printable bytes stand for themselves, the others for U+0100 onwards.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
#: Contractions of three characters: cut after two, they are two pieces.
CONTRACTIONS = ("'re", "'ve", "'ll")

MEMO = 1 << 19          # chunks remembered per worker, and as many older ones
GROUP = 1 << 22         # characters whose new chunks are learnt together
MEMO_CHARS = 48         # longer chunks are taken as a whole


class PrefixCounter:
    """Exact token counts of all prefixes for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        import json

        spec = json.load(open(path, encoding="utf-8"))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.vocab = frozenset(spec["model"]["vocab"])
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        special = sorted((re.escape(a["content"]) for a in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(special)) if special else None
        self.special_text = [a["content"] for a in spec["added_tokens"]]
        # the longest entry ending in each character bounds the look back
        self.longest: dict[str, int] = {}
        for t in self.vocab:
            self.longest[t[-1]] = max(self.longest.get(t[-1], 0), len(t))
        self.split = {x + y: (x, y, k) for (x, y), k in reversed(self.rank.items())}
        self.left: dict[str, list] = {}
        self.right: dict[str, list] = {}
        self.prev, self.count_at, self.last_at = "", [0], [""]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.totals: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def spine(self, token: str, right: bool) -> list[tuple[str, int]]:
        """The parts that stand at one end of a token while merges build it, each with the rank
        of the merge that ends it; the token itself comes first and nothing ends it."""
        memo = self.right if right else self.left
        found = memo.get(token)
        if found is None:
            end, found, part = 1 << 60, [], token
            while True:
                found.append((part, end))
                if part not in self.split:
                    break
                x, y, end = self.split[part]
                part = y if right else x
            memo[token] = found
        return found

    def may_follow(self, a: str, b: str) -> bool:
        """Whether ``a + b`` encodes as the two tokens a, b (an empty ``a``: b alone as b).

        It doesn't if some merge across the border comes before the merges that end both of
        its parts; of equal merges the left one comes first.
        """
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= 2 * MEMO:
                self.pairs.clear()
            if not a:
                known = len(b) == 1 or b in self.split and self.may_follow(*self.split[b][:2]) is False
            else:
                rank = self.rank.get
                known = True
                for x, end_x in self.spine(a, True):
                    for y, end_y in self.spine(b, False):
                        r = rank((x, y))
                        if r is not None and r < end_x and r <= end_y:
                            known = False
                            break
                    if not known:
                        break
            self.pairs[a, b] = known
        return known

    def piece(self, s: str) -> list[int]:
        """Token counts of all prefixes of a piece, in the vocabulary's byte alphabet.

        The state at a prefix depends on that prefix alone, so what the piece shares with the
        one before it is not computed again.
        """
        vocab, longest, pairs = self.vocab, self.longest, self.pairs
        prev, count, last = self.prev, self.count_at, self.last_at
        k, most = 0, min(len(prev), len(s))
        while k < most and prev[k] == s[k]:
            k += 1
        del count[k + 1 :], last[k + 1 :]
        self.prev = s[:k]
        for i in range(k + 1, len(s) + 1):
            first = i - 1 - len(last[i - 1])  # most often the last token goes on or a new one starts
            for start in (first, i - 1, *range(max(0, i - longest.get(s[i - 1], 1)), i - 1)):
                t = s[start:i]
                if t in vocab:
                    ok = pairs.get((last[start], t))
                    if self.may_follow(last[start], t) if ok is None else ok:
                        count.append(count[start] + 1)
                        last.append(t)
                        break
            else:
                raise ValueError(f"no token ends at {i} of {s!r}")
        self.prev = s
        return count

    def pieces(self, chunk: str) -> list[tuple[str, int, int]]:
        """(piece in the byte alphabet, start, end) of a chunk, as the library splits it."""
        if WORD.match(chunk):
            if chunk.isascii():
                return [(chunk.replace(" ", "Ġ"), 0, len(chunk))]
            return [(chunk.encode().decode("latin-1").translate(ALPHABET), 0, len(chunk))]
        return [(p, a, b) for p, (a, b) in self.pre.pre_tokenize_str(chunk)]

    def learn(self, chunks: set[str]) -> None:
        """Count the chunks that are not remembered, in the order of their pieces."""
        if len(self.totals) > MEMO:  # what is in use comes back from the older half
            self.older, self.totals = self.totals, {}
        totals, older = self.totals, self.older
        parts: list[tuple[str, list[str]]] = []  # a letter and ASCII punctuation are never in one piece
        wanted: set[str] = set()
        for c in chunks.difference(totals):
            n = older.get(c)
            if n is not None:
                totals[c] = n
                continue
            ps = PARTS.split(c) if len(c) <= MEMO_CHARS else [c]
            if len(ps) > 1:
                parts.append((c, ps))
            wanted.update(ps)
        split: dict[str, list[tuple[str, int, int]]] = {}
        for p in wanted.difference(totals):
            n = older.get(p)
            if n is None:
                split[p] = self.pieces(p)
            else:
                totals[p] = n
        found = {x: self.piece(x)[-1] for x in sorted({x for xs in split.values() for x, _, _ in xs})}
        for p, xs in split.items():
            totals[p] = found[xs[0][0]] if len(xs) == 1 else sum([found[x] for x, _, _ in xs])
        for c, ps in parts:
            totals[c] = sum([totals[p] for p in ps])

    def chunk_total(self, chunk: str) -> int:
        n = self.totals.get(chunk)
        if n is None:
            self.learn({chunk})
            n = self.totals[chunk] if len(chunk) <= MEMO_CHARS else self.totals.pop(chunk)
        return n

    def chunk_table(self, chunk: str) -> list[int]:
        """Token counts of all code-point prefixes of a chunk, each as if the text ended there."""
        blank = BLANK.match(chunk).end()
        out = [0] * (len(chunk) + 1)
        if blank:  # a text that ends in white space has the whole run as one piece
            (run, _, _), = self.pieces(chunk[:blank])
            at, table = 0, self.piece(run)[:]
            for x in range(1, blank + 1):
                at += len(chunk[x - 1].encode())
                out[x] = table[at]
        base = 0
        for p, a, b in self.pieces(chunk):
            table, at = self.piece(p)[:], 0
            for x in range(a + 1, b + 1):
                at += len(chunk[x - 1].encode())
                if x > blank:
                    out[x] = base + table[at]
            if chunk[a:b] in CONTRACTIONS:
                out[a + 2] = base + 2
            base += table[-1]
        return out

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """(segment, is special string); the strings are found before anything else."""
        if not any(s in text for s in self.special_text):
            yield text, False
            return
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def counts(self, batch: list[str]) -> list[int]:
        """Token counts of whole texts; what they have new is learnt for about GROUP characters at a time."""
        out: list[int] = []
        at = 0
        while at < len(batch):
            extra, rows, size = [], [], 0
            while at < len(batch) and (not rows or size + len(batch[at]) <= GROUP):
                chunks, special = [], 0
                for segment, is_special in self.segments(batch[at]):
                    if is_special:
                        special += 1
                    else:
                        chunks += CHUNK.findall(segment)
                rows.append(chunks)
                extra.append(special)
                size += len(batch[at])
                at += 1
            self.learn(set().union(*rows))
            known = self.totals.__getitem__
            out += [sum(map(known, chunks)) + special for chunks, special in zip(rows, extra)]
            for c in {c for chunks in rows for c in chunks if len(c) > MEMO_CHARS}:
                self.totals.pop(c, None)
        return out

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of ``text[:x]`` for every x from 0 to ``len(text)``."""
        out, at, base = np.zeros(len(text) + 1, np.int64), 0, 0
        behind, before = 0, 0  # start of the last chunk, tokens before it
        for segment, special in self.segments(text):
            if special:  # a part of a special string is ordinary text that goes on from the last chunk
                for x in range(1, len(segment)):
                    out[at + x] = before + self.count(text[behind : at + x])
                at, base = at + len(segment), base + 1
                out[at] = base
                behind, before = at, base
                continue
            for chunk in CHUNK.findall(segment):
                out[at : at + len(chunk) + 1] = self.chunk_table(chunk)
                out[at : at + len(chunk) + 1] += base
                behind, before = at, base
                at, base = at + len(chunk), base + self.chunk_total(chunk)
                out[at] = base
        return out

    def cut(self, text: str, budget: int) -> int:
        """The longest prefix, in code points, up to which no prefix has more than ``budget`` tokens.

        A special string is taken or left as a whole.
        """
        at, base = 0, 0
        for segment, special in self.segments(text):
            for chunk in [segment] if special else CHUNK.findall(segment):
                n = 1 if special else self.chunk_total(chunk)
                if special and base + 1 > budget:
                    return at
                if not special and base + 4 * len(chunk) > budget:
                    for k, c in enumerate(self.chunk_table(chunk)[1:]):
                        if base + c > budget:
                            return at + k
                at, base = at + len(chunk), base + n
        return len(text)


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One counter per worker process and vocabulary."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 1024) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit and cut (code points that ``limit`` tokens cover).

    A scan without a shuffle.  ``vocab_path`` must exist on every executor.
    """

    def run(batch: pa.RecordBatch):
        c = counter(vocab_path)
        found = texts(batch)
        n = c.counts(found)
        yield pa.RecordBatch.from_arrays(
            [
                column(batch, "doc_id").cast(pa.int64()),
                pa.array([len(t.encode()) for t in found], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_()),
                pa.array([c.cut(t, limit) if x > limit else len(t) for t, x in zip(found, n)], pa.int64()),
            ],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut"],
        )

    return map_batches(
        docs.select("doc_id", "text"), run,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut long",
    )
