"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Byte-pair encoding has two properties that make it a left-to-right process. (1) The encoding of a
string without its last token is the encoding of the remaining prefix. (2) A token sequence is an
encoding exactly if every two neighbours, joined and merged on their own, give the same two tokens. So
the last token of each prefix follows from the last tokens of shorter prefixes: it is the one suffix
that is a token and agrees with its left neighbour.

A state of the transducer is the token before a settled boundary and the bytes after it, with the last
token of every prefix. A boundary is settled once the encodings of all prefixes at which a later token
may still start (those whose remainder begins some token) agree on it; the tokens before it are
emitted. That bounds the lookahead by the vocabulary. What is pending when a piece ends is the state's final
output. States, arcs and final outputs are made when first needed and kept in a table of bounded size: every
byte of every piece that is not itself a token is read by an arc.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import begin, free_name, sub_batches, text_bytes
from .pieces import ODD, SPACE, Known, PieceTable, SpanHash, classes

_CODECS: dict[str, "Codec"] = {}
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Compiled merges; ``ranks`` maps token bytes to ids, which are also the merges' priorities.

    ``read`` counts the bytes that arcs have read, ``made`` those for which the arc had to be made first, and
    ``early`` the bytes of the tokens that arcs emitted before their piece had ended.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 150_000):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.prefixes = {t[:k] for t in ranks for k in range(len(t))}
        self.most_states = most_states
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.read = self.made = self.early = 0
        self._restart()

    def _restart(self) -> None:
        # a state: token before, pending bytes, length of the last token of each pending prefix, live starts
        self.states: list[tuple[bytes, bytes, tuple[int, ...], tuple[int, ...]]] = [(b"", b"", (0,), (0,))]
        self.numbers: dict[tuple[bytes, bytes], int] = {(b"", b""): 0}
        self.arcs: dict[int, tuple[int, tuple[bytes, ...]]] = {}
        self.finals: dict[int, list[bytes]] = {}

    def _anew(self, number: int) -> int:
        """Empty the table but for one state; its new number."""
        state = self.states[number]
        self._restart()
        if not number:
            return 0
        self.states.append(state)
        self.numbers[state[:2]] = 1
        return 1

    def merge(self, text: bytes) -> list[bytes]:
        """Merge the pair of least rank until none is left; for tokens and pairs of tokens only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _token(self, t: bytes) -> bool:
        """Whether t is a token that merging reaches."""
        ok = self.whole.get(t)
        if ok is None:
            ok = self.whole[t] = t in self.ranks and self.merge(t) == [t]
        return ok

    def _spine(self, t: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The parts of token t at its left (0) or right (1) edge while it is merged, largest first: the
        part, the rank at which it is made, the rank at which it goes into the next larger one."""
        spine = self.spines[side].get(t)
        if spine is None:
            spine, part, until = [], t, NEVER
            while True:
                made = self.ranks[part] if len(part) > 1 else -1
                spine.append((part, made, until))
                if len(part) == 1:
                    break
                part, until = self._halves(part)[side], made
            self.spines[side][t] = spine
        return spine

    def _halves(self, t: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of token t joins."""
        parts = [t[i : i + 1] for i in range(len(t))]
        ranks = self.ranks
        while len(parts) > 2:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], NEVER)
                if r < best:
                    best, at = r, i
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def _agree(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a and b, side by side, stay as they are: no part at a's right edge merges with the
        part at b's left edge that exists at the same time before either goes into its own larger part."""
        if len(self.pairs) > 200_000:
            self.pairs.clear()
        ok, ranks = True, self.ranks
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while i < len(left) and j < len(right):
            x, x_made, x_until = left[i]
            y, y_made, y_until = right[j]
            r = ranks.get(x + y)
            if r is not None and r < x_until and r <= y_until:
                ok = False
                break
            if x_made > y_made:
                i += 1
            else:
                j += 1
        self.pairs[a, b] = ok
        return ok

    def _last(self, before: bytes, pending: bytes, last: Sequence[int], live: Iterable[int]) -> int:
        """The length of the last token of ``pending``, given those of its prefixes. It starts at one of the
        positions ``live`` whose bytes so far begin a longer token."""
        n = len(pending)
        ranks, whole, pairs = self.ranks, self.whole, self.pairs
        for at in live:
            t = pending[at:]
            if t in ranks and (whole.get(t) or self._token(t)):
                left = pending[at - last[at] : at] if at else before
                if not left or (pairs[left, t] if (left, t) in pairs else self._agree(left, t)):
                    return n - at
        raise ValueError("the vocabulary lacks a single byte")

    def _arc(self, number: int, byte: int) -> tuple[int, tuple[bytes, ...]]:
        before, pending, last, live = self.states[number]
        pending += bytes((byte,))
        n = len(pending)
        last = (*last, self._last(before, pending, last, live))
        prefixes = self.prefixes
        live = (*[q for q in live if pending[q:] in prefixes], n)
        out: tuple[bytes, ...] = ()
        if live[0] > 0:
            # walk the encodings of all live prefixes back to the last boundary they share
            heads = list(live)
            while len(heads) > 1:
                q = heads.pop()
                q -= last[q]
                if q not in heads:
                    heads.append(q)
                    heads.sort()
            if settled := heads[0]:
                out = tuple(self._rest(pending[:settled], last))
                last = (0, *last[settled + 1 :])
                live = tuple(q - settled for q in live)
                before, pending = out[-1], pending[settled:]
        key = (before, pending)
        to = self.numbers.get(key)
        if to is None:
            to = self.numbers[key] = len(self.states)
            self.states.append((before, pending, last, live))
        arc = self.arcs[number << 8 | byte] = (to, out)
        return arc

    def _rest(self, pending: bytes, last: Sequence[int]) -> list[bytes]:
        tokens, q = [], len(pending)
        while q:
            tokens.append(pending[q - last[q] : q])
            q -= last[q]
        return tokens[::-1]

    def tokens(self, piece: bytes) -> list[bytes]:
        """The tokens of one piece, of any length. A piece that is a token is that token."""
        if piece in self.ranks:
            return [piece]
        number, out, arcs = 0, [], self.arcs
        for byte in piece:
            arc = arcs.get(number << 8 | byte)
            if arc is None:
                if len(self.states) > self.most_states:
                    number = self._anew(number)
                    arcs = self.arcs
                arc = self._arc(number, byte)
                self.made += 1
            number, some = arc
            if some:
                out += some
        self.read += len(piece)
        self.early += sum(map(len, out))
        final = self.finals.get(number)
        if final is None:
            _, pending, last, _ = self.states[number]
            final = self.finals[number] = self._rest(pending, last)
        return out + final


#: UTF-8 as a machine. Kinds of bytes: ASCII, three ranges of continuation, never valid, and the leads.
_KINDS = (
    [(0x00, 0x80, 0), (0x80, 0x90, 1), (0x90, 0xA0, 2), (0xA0, 0xC0, 3), (0xC0, 0xC2, 4), (0xC2, 0xE0, 5)]
    + [(0xE0, 0xE1, 6), (0xE1, 0xED, 7), (0xED, 0xEE, 8), (0xEE, 0xF0, 7), (0xF0, 0xF1, 9), (0xF1, 0xF4, 10), (0xF4, 0xF5, 11), (0xF5, 0x100, 4)]
)
_KIND = bytes(k for low, high, k in _KINDS for _ in range(low, high))
START, ONE, TWO, AFTER_E0, AFTER_ED, AFTER_F0, THREE, AFTER_F4, BAD = range(9)
#: From the start by a byte's kind, and from the other states by the kinds of continuation that they take.
_FIRST = (START, BAD, BAD, BAD, BAD, ONE, AFTER_E0, TWO, AFTER_ED, AFTER_F0, THREE, AFTER_F4)
_GO_ON = {ONE: ((1, 2, 3), START), TWO: ((1, 2, 3), ONE), AFTER_E0: ((3,), ONE), AFTER_ED: ((1, 2), ONE), AFTER_F0: ((2, 3), TWO), THREE: ((1, 2, 3), TWO), AFTER_F4: ((1,), TWO)}
_MOVE = [list(_FIRST)] + [[_GO_ON[s][1] if k in _GO_ON[s][0] else BAD for k in range(12)] for s in range(1, 8)]
#: The bits of a lead byte that belong to the character.
_BITS = {ONE: 0x1F, AFTER_E0: 0x0F, TWO: 0x0F, AFTER_ED: 0x0F, AFTER_F0: 0x07, THREE: 0x07, AFTER_F4: 0x07}
_RUNS = re.compile(rb"[\x00-\x7f]+|[\x80-\xff]+")


class Utf8Stream:
    """Incremental UTF-8: bytes in chunks of any length, complete characters out.

    A state machine over kinds of bytes; between chunks it holds its state and the bits of a character that
    has begun. Bytes that cannot be part of one come out as U+FFFD, one for each longest beginning of a
    character, as Python's "replace" does; after ``finish`` an incomplete character does so too.
    """

    def __init__(self) -> None:
        self.state, self.code = START, 0

    def feed(self, data: bytes) -> str:
        if self.state == START and data.isascii():
            return data.decode("ascii")
        out: list[str] = []
        state, code = self.state, self.code
        for run in _RUNS.findall(data):
            if run[0] < 0x80:
                if state != START:
                    out.append("\ufffd")
                    state = START
                out.append(run.decode("ascii"))
                continue
            for byte in run:
                kind = _KIND[byte]
                to = _MOVE[state][kind]
                if to == BAD and state != START:
                    out.append("\ufffd")
                    state, to = START, _FIRST[kind]
                if to == BAD:
                    out.append("\ufffd")
                elif state == START:
                    state, code = to, byte & _BITS[to]
                else:
                    state, code = to, code << 6 | byte & 0x3F
                    if to == START:
                        out.append(chr(code))
        self.state, self.code = state, code
        return "".join(out)

    def finish(self) -> str:
        held, self.state = self.state != START, START
        return "\ufffd" if held else ""


class Codec:
    """Text to ids and back, one piece of the pattern at a time.

    Ids of a text are kept as their decimals, each followed by a space. Each distinct piece goes through the
    transducer once while the table of pieces, which is of bounded size, has room; a piece is found in it by
    a hash and then compared byte for byte. Where a text holds only blanks, digits, signs but the apostrophe, and ASCII or two-byte Latin letters, and the pattern is
    the known one, pieces are cut and looked up all at once; any other text is cut by the pattern itself.
    """

    #: The pattern for which :meth:`_cut` cuts plain texts the same way.
    KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    LONG = 100

    def __init__(self, ranks_path: str, pattern: str, bits: int = 21):
        import regex

        self.ranks = read_ranks(ranks_path)
        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(self.ranks)
        self.bytes_of = {b"%d" % i: t for t, i in self.ranks.items()}
        self.plain = pattern == self.KNOWN
        self.table, self.known, self.hash = PieceTable(bits), Known(), SpanHash()
        self._forget()

    def _forget(self) -> None:
        self.table.clear()
        self.known.clear()
        self.flat, self.ends, self.counts = bytearray(), array("q", [0]), array("i")
        self.seen: dict[str, bytes] = {}

    def _ids(self, piece: bytes) -> bytes:
        ranks = self.ranks
        return b"".join([b"%d " % ranks[t] for t in self.transducer.tokens(piece)])

    def _by_pattern(self, text: str) -> bytes:
        get, out = self.seen.get, []
        for p in self.split(text):
            ids = get(p)
            if ids is None:
                if len(self.seen) > 100_000:
                    self.seen.clear()
                ids = self.seen[p] = self._ids(p.encode())
            out.append(ids)
        return b"".join(out)

    @staticmethod
    def _cut(raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where the pieces of plain texts begin, and the zero bytes that end each text."""
        first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        after = np.append(first[1:], len(kind))
        what = kind[first]
        begins = raw == 0
        words = first[(what != SPACE) & (what != ODD)]
        begins[words - ((raw[words - 1] == 0x20) & (words > 0))] = True
        a, b = first[what == SPACE], after[what == SPACE]
        last = raw[b] == 0
        begins[a[last | (b - a > 1)]] = True
        begins[b[~last & (raw[b - 1] != 0x20)] - 1] = True
        return np.flatnonzero(begins)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        at = len(self.counts)
        self.known.add(pieces)
        for p in pieces:
            ids = self._ids(p)
            self.flat += ids
            self.ends.append(len(self.flat))
            self.counts.append(ids.count(b" "))
        return np.arange(at, len(self.counts), dtype=np.int32)

    def _some(self, texts: list[bytes]) -> Iterator[tuple[bytes, int]]:
        raw = np.frombuffer(b"\0".join(texts) + b"\0" * 8, np.uint8)  # the last seven are to spare
        kind = classes(raw[:-7])
        begin = self._cut(raw[:-7], kind)
        real = raw[begin] != 0
        start, end = begin[real], np.append(begin[1:], len(raw) - 7)[real]
        keys = self.hash(raw, start, end)
        short = end - start < self.LONG
        place = np.full(len(keys), -1, np.int32)
        place[short] = self.table.find(keys[short])
        body = raw.tobytes()

        def learn(which: np.ndarray) -> np.ndarray:
            return self._learn([body[a:b] for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)])

        for again in (False, True):
            new = np.flatnonzero((place < 0) & short)
            first = new[np.unique(keys[new], return_index=True)[1]]
            if len(first) <= self.table.room() and len(self.counts) < 1 << (self.table.bits + 1):
                break
            self._forget()
            place[:] = -1
            while again and len(first) > self.table.room():
                self.table.bits += 1
                self.table.clear()
        if len(first):
            self.table.add(keys[first], learn(first))
            place[new] = self.table.find(keys[new])
        alike = np.zeros(len(keys), bool)
        alike[short] = self.known.same(raw, start[short], end[short], place[short])
        rest = np.flatnonzero(~alike)
        if len(rest):
            place[rest] = learn(rest)
        # views of the tables, not copies; none may be left when the tables grow again
        low, high = np.frombuffer(self.ends, np.int64)[place], np.frombuffer(self.ends, np.int64)[place + 1]
        n = high - low
        before = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(before[-1])
        at += np.repeat(low - before[:-1], n)
        joined = np.frombuffer(self.flat, np.uint8)[at].tobytes() if len(at) else b""
        tokens = np.concatenate(([0], np.cumsum(np.frombuffer(self.counts, np.int32)[place], dtype=np.int64))) if len(place) else np.zeros(1, np.int64)
        del at, low, high, n
        edges = np.searchsorted(start, np.concatenate(([0], np.flatnonzero(raw[:-7] == 0) + 1)))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield joined[before[a] : before[b]], int(tokens[b] - tokens[a])

    def encode_all(self, texts: list[bytes], most_bytes: int = 256 << 10) -> Iterator[tuple[bytes, int]]:
        """The decimal ids of each text, each followed by a space, and their number."""
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at + len(some) < len(texts) and size < most_bytes:
                some.append(texts[at + len(some)])
                size += len(some[-1])
            at += len(some)
            plain = [self.plain and len(t) < 8 * most_bytes and not (t and (classes(np.frombuffer(t, np.uint8)) == ODD).any()) for t in some]
            ready = self._some([t for t, ok in zip(some, plain, strict=True) if ok]) if any(plain) else iter(())
            for t, ok in zip(some, plain, strict=True):
                if ok:
                    yield next(ready)
                else:
                    ids = self._by_pattern(t.decode())
                    yield ids, ids.count(b" ")

    def encode(self, text: str) -> list[int]:
        return list(map(int, next(self.encode_all([text.encode()]))[0].split()))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[b"%d" % i] for i in ids])

    def decode_joined(self, joined: bytes, chunk: int = 1 << 20) -> Iterator[bytes]:
        """The bytes of ids as :meth:`encode_all` gives them, a chunk of ids at a time."""
        of, at = self.bytes_of.__getitem__, 0
        while at < len(joined):
            end = joined.find(b" ", at + chunk)
            end = len(joined) if end < 0 else end
            yield b"".join(map(of, joined[at:end].split()))
            at = end

    def decode(self, ids: Iterable[int]) -> str:
        stream = Utf8Stream()
        out = [stream.feed(self.bytes_of[b"%d" % i]) for i in ids]
        return "".join(out) + stream.finish()


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a worker and vocabulary."""
    key = f"{ranks_path}\n{pattern}"
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks_path, pattern)
    return _CODECS[key]


def _new_column(df: DataFrame, name: str) -> str:
    if free_name(df, name) != name:
        raise ValueError(f"the input has a column {name} already: name another")
    return name


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """The input with the token ids of each whole text, however long, as array<int> in ``out_col``, which must be
    a new column. A null text counts as empty; an empty table gives no rows; repeated rows repeat."""
    begin(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(_new_column(docs, out_col), T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in sub_batches(batches, text_col):
            ids = pa.array([list(map(int, x.split())) for x, _ in c.encode_all(text_bytes(batch.column(text_col)))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """The input with the text that the ids in ``ids_col`` stand for in ``out_col``, which must be a new column;
    null ids give an empty text, an id outside the vocabulary is an error."""
    begin(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField(_new_column(rows, out_col), T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            back = pa.array([c.decode(x or ()) for x in batch.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, back], [*batch.schema.names, out_col])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode the ids, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids, the digest of no bytes. One row per input row, so repeated rows
    repeat; a text of any length is encoded whole and decoded as a stream; an empty table gives no rows; only
    the id and the text are read of the input's columns, whatever the others' names.
    """
    begin(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in sub_batches(batches, "text"):
            counts, ids, decoded = [], [], []
            for joined, n in c.encode_all(text_bytes(batch.column("text"))):
                counts.append(n)
                ids.append(hashlib.sha256(joined[:-1]).hexdigest())
                stream, digest = Utf8Stream(), hashlib.sha256()
                for part in c.decode_joined(joined):
                    digest.update(stream.feed(part).encode())
                digest.update(stream.finish().encode())
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
