"""Byte-level BPE by a lazily determinised transducer, and decoding by an incremental UTF-8 state machine (operator 9)."""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from cryoframe.llm.common import claim, id_type, ids_and_texts, pieces, strings

#: Bounds of what a Python worker keeps: transitions of the transducer, and pieces of text with their ids, in each of two generations.
MOST_TRANSITIONS, MOST_PIECES = 400_000, 250_000
#: How often a worker looks for cycles as a rule.
GC = gc.get_threshold()
#: Bits of a token's number in a pair.
BITS = 24
#: Texts are encoded in stretches of about so many characters, ids are decoded so many at a time.
STRETCH, IDS = 1 << 19, 1 << 15


class Transducer:
    """Maps the bytes of one piece to token ids, in one pass from left to right.

    A sequence of tokens is what the merges give if and only if each neighbouring pair is what the merges give for
    that pair alone. So every prefix of a piece ends in one token only, and the automaton has to remember just the
    places where a longer token may still begin. A state is the tokens that hang in the air for each such place, with
    the bytes read since. What all places agree on is emitted; the lookahead is bounded by the longest token. States
    and transitions are made when first needed and kept up to ``MOST_TRANSITIONS``.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        halves = {b: self.merged(b, 2) for b in ranks if len(b) > 1}  # what the last merge joined
        rank = lambda b: ranks[b] if len(b) > 1 else -1
        self.in_order = all(max(map(rank, h)) < ranks[b] for b, h in halves.items() if len(h) == 2)
        # Everything below is in numbers: a token is its rank, a stretch that a token may begin with is a node of their trie.
        self.left, self.right = ({ranks[b]: ranks[h[side]] for b, h in halves.items() if len(h) == 2} for side in (0, 1))
        self.made = {i: i for i in self.left}  # when a token is joined; single bytes are there from the start
        self.join = {ranks[b[:i]] << BITS | ranks[b[i:]]: r for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks}
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]  # of each node: the token it spells, if merges can reach it
        self.inner: list[bool] = [False]  # whether longer tokens begin so
        for b, i in ranks.items():
            node = 0
            for byte in b:
                self.inner[node] = True
                if (to := self.child.get(node << 8 | byte)) is None:
                    to = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = to
            if len(b) == 1 or i in self.left:
                self.token[node] = i
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.rows: dict[tuple, dict] = {}
        self.n_steps = 0
        self.start = self.row((-1, (((), 0),)))

    def row(self, state: tuple) -> dict:
        """The transitions of a state: for each byte the row of the next state and what is emitted; the state itself stands at -1, what ends a piece there at -2."""
        if (row := self.rows.get(state)) is None:
            row = self.rows[state] = {-1: state, -2: state[1][-1][0]}
        return row

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The definition: join the neighbours of lowest rank, leftmost first, until ``least`` parts or no such pair are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 40:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of these two tokens' bytes give these two tokens."""
        key = left << BITS | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > MOST_TRANSITIONS:
                self.pairs.clear()
            if self.in_order:
                known = self.border_holds(left, right)
            else:
                a, b = self.bytes_of[left], self.bytes_of[right]
                known = self.merged(a + b) == [a, b]
            self.pairs[key] = known
        return known

    def border_holds(self, a: int, b: int) -> bool:
        """Undoes the merges beside the border, latest first: no pair across it may come before the merge that used up one of its sides."""
        never = 1 << 40
        a_until, b_until = never, never  # when a and b are joined to something on their own side
        join, made = self.join.get, self.made.get
        while True:
            across = join(a << BITS | b, never)
            if across < a_until and across <= b_until and across < never:
                return False
            a_made, b_made = made(a, -1), made(b, -1)
            if a_made > b_made:
                a, a_until = self.right[a], a_made
            elif b_made >= 0:
                b, b_until = self.left[b], b_made
            elif a_made < 0:
                return True

    def step(self, row: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        anchor, places = row[-1]
        child, tokens, inner = self.child.get, self.token, self.inner
        there, ended = [], None
        for path, node in places:
            if (node := child(node << 8 | byte)) is None:
                continue
            if ended is None and (token := tokens[node]) >= 0:
                left = path[-1] if path else anchor
                if left < 0 or self.fits(left, token):
                    ended = (*path, token)
            if inner[node]:
                there.append((path, node))
        n = len(ended)
        for path, _ in there:  # what all of them begin with
            m = 0
            for one, other in zip(path[:n], ended, strict=False):
                if one != other:
                    break
                m += 1
            n = m
            if not n:
                break
        there.append((ended, 0))
        emitted = ended[:n]
        if n:
            anchor, there = emitted[-1], [(path[n:], node) for path, node in there]
        if self.n_steps > MOST_TRANSITIONS:
            self.reset()  # rows in use stay alive through those that hold them
            gc.collect()
        self.n_steps += 1
        for path, _ in there:
            if not path:
                break
        else:
            anchor = -1
        to = row[byte] = self.row((anchor, tuple(there))), emitted
        return to

    def piece(self, data: bytes) -> tuple[int, ...]:
        if (one := self.ranks.get(data)) is not None:
            return (one,)
        out, row = [], self.start
        for byte in data:
            row, emitted = row.get(byte) or self.step(row, byte)
            if emitted:
                out += emitted
        return (*out, *row[-2])


class Pieces(dict):
    """Ids of pieces, made when first asked for. What was not asked for since the last ``age`` goes with the next one."""

    def __init__(self, machine: Transducer):
        self.machine, self.before = machine, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.before.get(piece)) is None:
            ids = array("i", self.machine.piece(piece.encode())).tobytes()
        self[piece] = ids
        return ids

    def age(self) -> None:
        self.before = dict(self)
        self.clear()


class Codec:
    """Encoder and decoder for a rank file's content and the pattern that cuts a text into pieces."""

    made: dict[bytes, Codec] = {}

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.machine, self.split = Transducer(ranks), regex.compile(pattern).findall
        self.of = self.machine.bytes_of.__getitem__
        self.name = {i: b"%d" % i for i in self.machine.bytes_of}.__getitem__
        self.known = Pieces(self.machine)

    @classmethod
    def get(cls, rank_file: bytes, pattern: str) -> Codec:
        """One for each vocabulary and Python worker, kept from task to task."""
        claim("bpe", cls.release)
        key = hashlib.sha256(rank_file + pattern.encode()).digest()
        if key not in cls.made:
            # States point at each other for as long as they live; looking for cycles among them again and again costs a fifth.
            gc.set_threshold(1 << 20, *GC[1:])
            cls.made[key] = cls(rank_file, pattern)
        return cls.made[key]

    @classmethod
    def release(cls) -> None:
        cls.made.clear()
        gc.set_threshold(*GC)

    def encode(self, text: str) -> Iterator[array]:
        """Ids, a stretch of the text at a time."""
        for part in pieces(text, STRETCH):
            yield array("i", self.packed(part))

    def packed(self, text: str) -> bytes:
        """Ids as 32-bit numbers; pieces met before are looked up."""
        ids = b"".join(map(self.known.__getitem__, self.split(text)))
        if len(self.known) > MOST_PIECES:
            self.known.age()
        return ids

    def decode(self, parts: Iterable[Sequence[int]]) -> Iterator[tuple[bytes, str]]:
        """Bytes and characters of ids that come in parts; a character may begin in one token, or part, and end in another."""
        characters = codecs.getincrementaldecoder("utf-8")("replace")
        for part in parts:
            for low in range(0, len(part), IDS):
                data = b"".join(map(self.of, part[low : low + IDS]))
                yield data, characters.decode(data)
        yield b"", characters.decode(b"", final=True)


def _vocabulary(docs: DataFrame, path: str):
    """The rank file's content for the tasks: read where the path is known, at the driver; a vocabulary has at most some MB."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def portions(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def id_lists(ids: Sequence[array]) -> pa.Array:
    """A column of id lists from packed numbers, without a Python object for each."""
    ends = pa.array([0, *accumulate(map(len, ids))], pa.int32())
    data = b"".join(a.tobytes() for a in ids)
    return pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), len(data) // 4, [None, pa.py_buffer(data)]))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, token_ids (array<int>) of each row. A null text has no ids, like an empty one; repeated rows stay rows."""
    docs, ranks = ids_and_texts(docs), _vocabulary(docs, ranks_path)

    def run(batches):
        codec = Codec.get(ranks.value, pattern)
        for batch in batches:
            for some in portions(batch):
                ids = [array("i", b"".join(part.tobytes() for part in codec.encode(t or ""))) for t in strings(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0), id_lists(ids)], ["doc_id", "token_ids"])

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, token_ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text of rows (doc_id, token_ids). Null ids give an empty text; bytes that are no UTF-8 give U+FFFD."""
    tokens, ranks = tokens.select("doc_id", "token_ids"), _vocabulary(tokens, ranks_path)

    def run(batches):
        codec = Codec.get(ranks.value, pattern)
        for batch in batches:
            texts = ["".join(s for _, s in codec.decode([ids or []])) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.mapInArrow(run, f"doc_id {id_type(tokens)}, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes each text as a stream: doc_id, n_tokens, ids_sha256, decoded_sha256, same_text; with ``with_ids`` token_ids too.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded bytes. A null text counts as empty
    (no tokens, digests of nothing). Without ``with_ids``, ids and decoded text of a long document are never held whole.
    """
    docs, ranks = ids_and_texts(docs), _vocabulary(docs, ranks_path)

    def one(codec: Codec, text: str) -> tuple:
        n, ids_hash, bytes_hash, at, same, kept = 0, hashlib.sha256(), hashlib.sha256(), 0, True, array("i")

        def stream():
            nonlocal n
            for packed in codec.encode(text):
                ids = packed.tolist()
                if ids:
                    ids_hash.update((b"," if n else b"") + b",".join(map(codec.name, ids)))
                n += len(ids)
                if with_ids:
                    kept.extend(packed)
                yield ids

        for data, characters in codec.decode(stream()):
            bytes_hash.update(data)
            same = same and text.startswith(characters, at)
            at += len(characters)
        return n, ids_hash.hexdigest(), bytes_hash.hexdigest(), same and at == len(text), kept

    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "same_text": pa.bool_(), "token_ids": pa.list_(pa.int32())}
    if not with_ids:
        kinds.pop("token_ids")

    def run(batches):
        codec = Codec.get(ranks.value, pattern)
        for batch in batches:
            for some in portions(batch):
                *numbers, ids = zip(*[one(codec, t or "") for t in strings(some.column(1))], strict=True)
                columns = [some.column(0), *[pa.array(c, k) for c, k in zip(numbers, kinds.values(), strict=False)]]
                yield pa.RecordBatch.from_arrays([*columns, id_lists(ids)] if with_ids else columns, ["doc_id", *kinds])

    schema = f"doc_id {id_type(docs)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, same_text boolean" + ", token_ids array<int>" * with_ids
    return docs.mapInArrow(run, schema)
