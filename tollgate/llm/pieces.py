"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised from left to right: at each place the longest prefix that the model's
compiled character map holds is replaced, any other character stays.  Every byte written
records the place in the text it was read at, so the *alignment* takes a span of normalised
bytes back to a span of the original ones.  The normalised text is merged into pieces in the
order of their scores (byte pair encoding, bytes for characters outside the vocabulary), and
the alignment projects each piece to its bytes of the original text; the spans of a text's
pieces follow each other and cover it.

The compiled map is a double array of 32-bit units: a unit holds its label, the offset of its
children and whether a key ends there; the key's value is the place of its replacement.

Merging never joins two characters that stand side by side in no piece of the vocabulary, so a
text is cut there (before white space above all), and a cut part's pieces don't depend on what is
around it.  Parts are remembered in a bounded dictionary per worker: ids and lengths.  A part's ids
are decoded when they are learnt; where that gives another text than the part's, it is kept as well.

Edge cases: null counts as the empty text, which has no pieces and decodes to itself; texts of any
length are encoded whole; special strings inside a text are ordinary text; repeated rows and null
ids give rows of their own; an empty table gives an empty one; only doc_id and text are read.
A model that isn't a byte pair encoding, or has user-defined or unused pieces, is refused.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tollgate.llm.common import column, map_batches, texts

SPACE = "▁"             # how the library writes a space
REPLACEMENT = "�"  # for bytes that are no UTF-8
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces
MEMO = 1 << 19          # parts remembered per worker, and as many older ones
MEMO_CHARS = 64         # longer parts aren't remembered
GROUP = 1 << 22         # characters of texts whose new parts are merged together
SHORT = 40              # symbols up to which the best pair is looked for one after the other
NUMBER = re.compile("[0-9]+")
NONE = np.int64(2**62)  # beyond every rank


class CharacterMap:
    """The compiled map: longest-prefix replacement."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.texts = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.texts = blob[4 + size :]

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(bytes, place of the replacement) of the longest key at ``at``; no key: (0, 0)."""
        units = self.units
        if not units:
            return 0, 0
        node = self._children(units[0])
        length = value = 0
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._children(unit)
            if unit & 256:  # a key ends here; its value is the first of its children
                length, value = k + 1 - at, units[node] & 0x7FFFFFFF
        return length, value

    def replacement(self, value: int) -> bytes:
        return self.texts[value : self.texts.index(0, value)]

    @property
    def starts(self) -> frozenset[int]:
        """Bytes that some key starts with."""
        if not self.units:
            return frozenset()
        root = self._children(self.units[0])
        return frozenset(c for c in range(1, 256) if self.units[root ^ c] & 0x800000FF == c)


@dataclass
class Normalised:
    text: str
    places: np.ndarray | None  # by normalised byte, and one for the end; None: the text but for spaces
    prefix: int                # bytes before the text that stand for none of its own

    def origin(self, ends: np.ndarray) -> np.ndarray:
        """Places in the original text's bytes of places between normalised bytes."""
        if self.places is not None:
            return self.places[ends]
        # each space has grown from one byte to three: count those before
        raw = np.frombuffer(self.text.encode(), np.uint8)
        grown = np.flatnonzero(raw == 0xE2)
        grown = grown[(raw[grown + 1] == 0x96) & (raw[grown + 2] == 0x81)] if len(grown) else grown
        ends = np.maximum(ends, self.prefix)
        return ends - self.prefix - 2 * (np.searchsorted(grown, ends) - np.searchsorted(grown, self.prefix))


class Encoder:
    """One model: normalisation, merging, offsets and decoding."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only byte pair encodings of normal, unknown, control and byte pieces")
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.starts = self.map.starts
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.unk = proto.trainer_spec.unk_id
        self.unk_surface = proto.trainer_spec.unk_surface
        self.pieces = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.rank = {p.piece: (-p.score, k) for k, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        for k, p in enumerate(proto.pieces):
            if p.type == BYTE:
                b = int(p.piece[3:5], 16)
                self.byte_ids[b], self.byte_of[k] = k, b
        self.numbers = [str(k) for k in range(len(self.pieces))]
        self.shown = [p.replace(SPACE, " ") for p in self.pieces]
        # by number, for many parts at a time: characters, ranks of pieces, pairs and what they become
        self.char_id = np.full(0x110000, -1, np.int64)
        for p, k in self.ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = k
        self.rank_of = np.unique([-p.score for p in proto.pieces], return_inverse=True)[1].astype(np.int64)
        self.size_of = np.array([len(p.encode()) for p in self.pieces], np.int32)
        self.base = len(self.pieces)
        joined = {self.ids[p[:k]] * self.base + self.ids[p[k:]]: i for p, i in self.ids.items()
                  for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.pair = np.array([*sorted(joined), 2**62], np.int64)
        self.becomes = np.array([joined[k] for k in sorted(joined)] + [0], np.int64)
        # two characters that are neighbours in no piece are never merged
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        spaced = any(p[1] == SPACE != p[0] for p in self.pairs)
        # so is a line feed, where no piece has one
        line = "" if any("\n" in p for p in self.ids) else "\n"
        self.part = re.compile(".+" if spaced else f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+|\n", re.S)
        self.memo: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}
        self.unlike: dict[str, str] = {}  # parts that don't decode to themselves (none, where bytes stand for unknown characters)

    # ---- normalisation ----

    def normalise(self, text: str) -> Normalised:
        if not text:
            return Normalised("", None, 0)
        if not self.map.units and not self.squeeze and self.escape and SPACE not in text:
            out = text.replace(" ", SPACE)  # every character stays, only spaces are written otherwise
            if not self.dummy:
                return Normalised(out, None, 0)
            return Normalised(out + SPACE, None, 0) if self.suffix else Normalised(SPACE + out, None, len(SPACE.encode()))
        return self._normalise(text.encode())

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        """(what the characters at ``at`` become, how many bytes they are)."""
        if data[at] in self.starts:
            n, value = self.map.longest(data, at)
            if n:
                return self.map.replacement(value), n
        n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return data[at : at + n], n

    def _normalise(self, data: bytes) -> Normalised:
        space = SPACE.encode() if self.escape else b" "
        out, places, at = bytearray(), [], 0
        if self.squeeze:  # white space at either end goes, runs become one
            while at < len(data):
                to, n = self._prefix(data, at)
                if to != b" ":
                    break
                at += n
            if at == len(data):
                return Normalised("", None, 0)
        if self.dummy and not self.suffix:
            out += space
            places += [at] * len(space)
        after_space = self.squeeze
        while at < len(data):
            to, n = self._prefix(data, at)
            if after_space:
                to = to.lstrip(b" ")
            if to:
                new = to.replace(b" ", space)
                out += new
                places += [at] * len(new)
                after_space = self.squeeze and to.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(space):
                del out[len(out) - len(space) :]
                at = places[len(out)]
                del places[len(out) :]
        if self.dummy and self.suffix:
            out += space
            places += [at] * len(space)
        return Normalised(out.decode(), np.array([*places, at], np.int64), 0)

    # ---- merging ----

    def merge(self, part: str) -> list[str]:
        """Pieces of a normalised part: the pair with the best score is joined first, then the leftmost."""
        symbols, rank = list(part), self.rank
        if len(symbols) > SHORT:
            return self._merge_long(symbols)
        pairs = [rank.get(a + b) for a, b in zip(symbols, symbols[1:])]
        while True:
            best = at = None
            for k, r in enumerate(pairs):
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], k
            if at is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank.get(symbols[at] + symbols[at + 1])
            if at:
                pairs[at - 1] = rank.get(symbols[at - 1] + symbols[at])

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap, in time n log n."""
        rank, n = self.rank, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(a: int, b: int) -> None:
            r = rank.get(symbols[a] + symbols[b])
            if r is not None:
                heapq.heappush(heap, (r[0], a, b, len(symbols[a]) + len(symbols[b])))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue  # one of them has been merged meanwhile
            symbols[a], symbols[b] = symbols[a] + symbols[b], ""
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        return [s for s in symbols if s]

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank of the piece that a and b become, that piece); no piece: a rank beyond all."""
        key = a * self.base + b
        at = np.searchsorted(self.pair, key)
        to = self.becomes[at]
        return np.where(self.pair[at] == key, self.rank_of[to] << 32, NONE), to

    def merge_many(self, parts: list[str]) -> list[tuple[list[int], bytes]]:
        """(ids, their pieces' bytes as int32) of many short parts without unknown characters, all merged at a time.

        A round joins the best pair of every part; parts that are ready leave when half of them are.
        """
        out: list[tuple[list[int], bytes]] = [([], b"")] * len(parts)
        n = np.array([len(p) for p in parts], np.int64)
        sym = self.char_id[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        who = np.arange(len(parts))  # the parts that are left, in order
        rank, to = self._ranked(sym, np.append(sym[1:], 0))
        rank[np.cumsum(n) - 1] = NONE
        while len(who):
            start = np.cumsum(n) - n
            best = np.minimum.reduceat(np.where(rank < NONE, rank + np.arange(len(sym)), NONE), start)
            live = best < NONE
            if 2 * live.sum() <= len(who):
                done = sym[np.repeat(~live, n)]
                ids, sizes, ends = done.tolist(), self.size_of[done].tobytes(), np.cumsum(n[~live]).tolist()
                for k, a, b in zip(who[~live].tolist(), [0, *ends], ends):
                    out[k] = ids[a:b], sizes[4 * a : 4 * b]
                keep = np.repeat(live, n)
                sym, rank, to = sym[keep], rank[keep], to[keep]
                who, n = who[live], n[live]
                continue
            at = (best[live] & 0xFFFFFFFF).astype(np.int64)
            sym[at] = to[at]
            last = np.zeros(len(sym), bool)
            last[start + n - 1] = True
            ends_part = last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, rank, to, at = sym[keep], rank[keep], to[keep], moved[at]
            n[live] -= 1
            inner = at[~ends_part]
            rank[at] = NONE
            rank[inner], to[inner] = self._ranked(sym[inner], sym[inner + 1])
            start = np.cumsum(n) - n
            before = at[at > start[live]] - 1
            rank[before], to[before] = self._ranked(sym[before], sym[before + 1])
        return out

    def learn(self, new: list[str]) -> None:
        """Remember new short parts."""
        known = np.minimum.reduceat(
            self.char_id[np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)],
            np.cumsum([0] + [len(p) for p in new[:-1]])) >= 0 if new else []
        plain = [p for p, k in zip(new, known) if k]
        number, shown = self.numbers, self.shown
        for part, (ids, sizes) in zip(plain, self.merge_many(plain)):
            self._decoded(part, "".join([shown[k] for k in ids]))
            self._remember(part, (",".join([number[k] for k in ids]), sizes))
        # characters outside the vocabulary: one part after the other, when it is met

    def _decoded(self, part: str, text: str) -> None:
        """A part's ids decode to ``text``: kept where that isn't the part itself."""
        if self.byte_fallback and text != part.replace(SPACE, " "):
            self.unlike[part] = text

    def _remember(self, part: str, found: tuple[str, bytes]) -> None:
        if len(self.memo) >= MEMO:
            self.older, self.memo = self.memo, {}
        self.memo[part] = found

    def cut(self, part: str) -> list[str]:
        """Cut between characters that no piece holds side by side."""
        pairs = self.pairs
        ends = [k for k in range(1, len(part)) if part[k - 1 : k + 1] not in pairs]
        return [part[a:b] for a, b in zip([0, *ends], [*ends, len(part)])] if ends else [part]

    def _tokens(self, part: str) -> tuple[list[int], list[int]]:
        """(ids, bytes of each) of an uncut part; a character of several byte pieces counts with the last."""
        ids, sizes = [], []
        for piece in chain.from_iterable(map(self.merge, self.cut(part))):
            found = self.ids.get(piece)
            raw = piece.encode()
            if found is not None:
                ids.append(found)
                sizes.append(len(raw))
            elif self.byte_fallback:
                ids += [self.byte_ids[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
            else:
                ids.append(self.unk)
                sizes.append(len(raw))
        return ids, sizes

    # ---- parts, remembered ----

    def _part(self, part: str) -> tuple[str, bytes]:
        """What is kept of a part: its ids in decimal and its pieces' bytes."""
        found = self.older.get(part)
        if found is None:
            ids, sizes = self._tokens(part)
            self._decoded(part, self._surface(ids))
            found = ",".join(map(str, ids)), np.array(sizes, np.int32).tobytes()
        if len(part) <= MEMO_CHARS:
            self._remember(part, found)
        return found

    def _found(self, parts: list[str], found: list) -> list[tuple[str, bytes]]:
        """What is kept of each part, ``found`` being that so far."""
        return [f if f is not None else self.memo.get(p) or self._part(p) for p, f in zip(parts, found)] if None in found else found

    def _parts(self, text: str) -> list[tuple[str, bytes]]:
        parts = self.part.findall(text)
        return self._found(parts, list(map(self.memo.get, parts)))

    # ---- whole texts ----

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(ids, starts, ends): every piece and its bytes in the original text."""
        norm = self.normalise(text)
        parts = self._parts(norm.text)
        ids = [int(i) for p in parts for i in p[0].split(",")]
        ends = np.cumsum(np.frombuffer(b"".join(p[1] for p in parts), np.int32), dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        if not self.byte_fallback:
            ids, starts, ends = self._unknown_runs(ids, starts, ends)
        return ids, norm.origin(starts), norm.origin(ends)

    def _unknown_runs(self, ids, starts, ends):
        """Without byte pieces, unknown characters in a row are one piece."""
        a = np.array(ids, np.int64)
        first = np.flatnonzero(~((a == self.unk) & np.concatenate([[False], a[:-1] == self.unk]))) if len(a) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:], [len(a)]])[: len(first)] - 1
        return a[first].tolist(), starts[first], ends[last]

    def _surface(self, ids: list[int]) -> str:
        """Ids as text, with spaces, without regard to the beginning of a text."""
        out, raw = [], bytearray()
        for k in ids:
            b = self.byte_of.get(k)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(decode_bytes(bytes(raw)))
                raw.clear()
            if self.kind[k] == UNKNOWN:
                out.append(self.unk_surface)
            elif self.kind[k] != CONTROL:
                out.append(self.pieces[k].replace(SPACE, " "))
        if raw:
            out.append(decode_bytes(bytes(raw)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self._begin(self._surface(ids), ids)

    def _begin(self, text: str, ids: Iterable[int]) -> str:
        """Without the space that was put before the text (with ``squeeze``, of each piece up to the first that has more)."""
        drop = 0
        if self.dummy or self.squeeze:
            for k in ids:
                if self.kind[k] == CONTROL:
                    continue
                if self.kind[k] != NORMAL or not self.pieces[k].startswith(SPACE):
                    break
                drop += 1
                if not self.squeeze or self.pieces[k] != SPACE:
                    break
        return text[drop:]

    def digests(self, batch: list[str]) -> list[tuple[int, int, str, str, int]]:
        """Per text: bytes, tokens, SHA-256 of the ids and of the decoded text, CRC-32 of the pieces' ends."""
        out, at = [], 0
        while at < len(batch):
            end, size = at, 0
            while end < len(batch) and (end == at or size + len(batch[end]) <= GROUP):
                size += len(batch[end])
                end += 1
            group = [self.normalise(t) for t in batch[at:end]]
            parts = [self.part.findall(n.text) for n in group]
            found = [list(map(self.memo.get, p)) for p in parts]
            if self.byte_fallback:
                new = {p for ps, fs in zip(parts, found) if None in fs for p, f in zip(ps, fs) if f is None}
                self.learn([p for p in new if len(p) <= MEMO_CHARS and p not in self.older])
            out += [self._digest(t, n, p, f) for t, n, p, f in zip(batch[at:end], group, parts, found)]
            at = end
        return out

    def _digest(self, text: str, norm: Normalised, parts: list[str], found: list) -> tuple[int, int, str, str, int]:
        if not self.byte_fallback:
            ids, _, ends = self.encode(text)
            shown, decoded, n = ",".join(map(str, ids)), self.decode(ids), len(ids)
        else:
            found = self._found(parts, found)
            shown = ",".join([f[0] for f in found])
            sizes = np.frombuffer(b"".join([f[1] for f in found]), np.int32)
            ends, n = norm.origin(np.cumsum(sizes, dtype=np.int64)), len(sizes)
            surface = norm.text if not self.unlike else "".join([self.unlike.get(p, p) for p in parts])
            decoded = self._begin(surface.replace(SPACE, " "), (int(m[0]) for m in NUMBER.finditer(shown)))
        return (len(text.encode()), n, sha256(shown.encode()).hexdigest(), sha256(decoded.encode()).hexdigest(),
                zlib.crc32(ends.astype("<i8").tobytes()))


def decode_bytes(raw: bytes) -> str:
    """UTF-8, with a replacement character for every byte that belongs to no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(REPLACEMENT)
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and model file."""
    with open(path, "rb") as f:
        return Encoder(f.read())


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, ids, and of every piece the first byte and the one past the last in the text."""

    def run(batch: pa.RecordBatch):
        of = encoder(path)
        for d, t in zip(column(batch, "doc_id").cast(pa.int64()), texts(batch)):  # a row at a time: long texts have many pieces
            ids, starts, ends = of.encode(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d.as_py()], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([starts], pa.list_(pa.int64())),
                 pa.array([ends], pa.list_(pa.int64()))], names=["doc_id", "ids", "starts", "ends"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode_documents(rows: DataFrame, path: str) -> DataFrame:
    """Per row of ``rows`` (doc_id, ids): doc_id and the decoded text."""

    def run(batch: pa.RecordBatch):
        of = encoder(path)
        decoded = [of.decode(ids or []) for ids in column(batch, "ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(decoded, pa.string())], names=["doc_id", "text"])

    return map_batches(rows.select("doc_id", "ids"), run, "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of ids and of the decoded text, n_bytes, CRC-32 of the pieces' ends."""

    def run(batch: pa.RecordBatch):
        of = encoder(path)
        found = of.digests(texts(batch))
        size, n, ids, decoded, ends = zip(*found)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()),
             pa.array(size, pa.int64()), pa.array(ends, pa.int64())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "ends_crc32"])

    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, ends_crc32 long")
