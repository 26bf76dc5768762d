"""Token counts by batches balanced by bytes (operator 4)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cryoframe.llm.common import claim, id_type, ids_and_texts, strings

#: A call of the encoder gets about so many bytes.
BATCH = 1 << 18
#: A worker keeps the counts of so many segments of at most so many characters, in each of two generations.
MOST_KEPT, SHORT = 400_000, 48
#: Before a space or line end that follows a visible character: no token spans such a place.
SAFE = re.compile(r"(?<=\S)(?=[ \n])")
#: Characters of a text that are cut into segments at a time.
STRETCH = 1 << 20


def segments(text: str) -> Iterator[list[str]]:
    """The text cut at every safe place, a stretch at a time; a part without such a place stays whole."""
    at = 0
    while len(text) - at > STRETCH:
        # The last segment of a stretch may go on: it is cut again with the next one.
        *whole, last = SAFE.split(text[at : at + STRETCH])
        if not whole:
            end = SAFE.search(text, at + STRETCH)
            whole, last = [text[at : end.start()] if end else text[at:]], ""
            at += len(whole[0])
        else:
            at += STRETCH - len(last)
        yield whole
    if at < len(text):
        yield SAFE.split(text[at:])


def balanced(parts: list[str], most: int = BATCH) -> Iterator[list[str]]:
    """Batches of neighbouring parts of about ``most`` bytes; a longer part is a batch of its own."""
    some, load = [], 0
    for part in parts:
        size = len(part.encode())
        if some and load + size > most:
            yield some
            some, load = [], 0
        some.append(part)
        load += size
    if some:
        yield some


class Counter:
    """Counts of segments, from the tokenizer where a segment was not met lately. One for each vocabulary and worker."""

    made: dict[str, Counter] = {}

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        self.before: dict[str, int] = {}

    @classmethod
    def get(cls, vocabulary: str) -> Counter:
        claim("token_counts", cls.made.clear)
        if vocabulary not in cls.made:
            cls.made[vocabulary] = cls(vocabulary)
        return cls.made[vocabulary]

    def count(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        load = 0
        for k, text in enumerate(texts):
            for some in segments(text):
                held.append((k, some))
                load += len(some)
                if load > MOST_KEPT // 4:
                    self._settle(held, counts)
                    held, load = [], 0
        self._settle(held, counts)
        return counts

    def _settle(self, held: list[tuple[int, list[str]]], counts: np.ndarray) -> None:
        wanted = set().union(*[some for _, some in held])
        new = [w for w in wanted.difference(self.known) if self.before.get(w) is None]
        now = {w: self.before[w] for w in wanted if w not in self.known and w in self.before}
        for some in balanced(new):
            now.update(zip(some, map(len, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        known = self.known
        of = lambda w: known[w] if w in known else now[w]
        for k, some in held:
            counts[k] += sum(map(of, some))
        known.update((w, n) for w, n in now.items() if len(w) <= SHORT)
        if len(known) > MOST_KEPT:
            self.known, self.before = {}, known


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row.

    Counts are the tokenizer's own for the whole text, without added tokens; its special strings inside a text count as
    it takes them by default. A null text counts as empty: no bytes, no tokens. Repeated rows stay rows. A long text is
    cut where no token can span; one without such a place is encoded whole. An empty table gives an empty report; other
    columns, whatever their names, are left behind. Equal segments of a batch are encoded once.
    """
    docs = ids_and_texts(docs)
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # some MB at most

    def run(batches):
        counter = Counter.get(vocabulary.value)
        for batch in batches:
            texts = [t or "" for t in strings(batch.column(1))]
            counts = counter.count(texts)
            n_bytes = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, n_bytes bigint, n_tokens bigint, over_limit boolean")
