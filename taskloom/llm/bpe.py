"""Byte-level BPE: encode whole texts by a rank file, and decode them again.

A text is cut by the vocabulary's pattern; each match is encoded by itself. Within a match, all tokens that
occur are found by one Aho-Corasick pass over the bytes read as Latin-1. From the left, the longest token
is taken that the token before it tolerates: two tokens may stand side by side if merging their joined bytes
gives back just these two: both borders are followed up through the merges that make the tokens, to see which merge over the border comes first. That answer is memoised per pair. Where no token fits, the last one is taken back and
shortened, and the place is marked dead, so a match costs linear time. A row of tokens whose
neighbours all tolerate each other is the one that the merges make, so the ids are those of the merge rule.

Null and empty texts have no tokens. Repeated rows are encoded each by itself. Other columns, of any
name, are left as they are, since the encoder is a column expression. Texts of any length: memory is a few times
one text. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import table

#: Matches and pairs that a worker remembers, and the longest match it remembers; only speed depends on them.
REMEMBERED, LONGEST = 400_000, 48


class Vocabulary:
    """Ranks of byte strings and the pattern that cuts texts; the search structures are made where they are first used."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    @property
    def encoder(self) -> Encoder:
        if "made" not in self.__dict__:
            self.made = Encoder(self.ranks, self.pattern)
        return self.made


class Remembered(dict):
    """The ids of a match of the pattern."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece.encode())
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        # A token that the merges don't make from its own bytes occurs only as a whole match.
        halves = {t: self.merged(t, i) if len(t) > 1 else [] for t, i in ranks.items()}
        made = {t: i for t, i in ranks.items() if len(halves[t]) in (0, 2)}
        self.borders = [{i: self.spine(t, halves, side) for t, i in made.items()} for side in (-1, 0)]
        self.name = {i: str(i) for i in ranks.values()}
        self.size = {i: len(t) for t, i in made.items()}
        self.shorter = {i: next((made[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in made), -1) for t, i in made.items()}
        self.search = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in made.items():
            self.search.add_word(t.decode("latin-1"), i)
        self.search.make_automaton()
        # What is remembered holds these very numbers, not copies of them.
        self.same = {i: i for i in made.values()}
        self.fit: dict[int, bool] = {}
        self.known = Remembered(self.encode_match)

    def merged(self, text: bytes, below: float = float("inf")) -> list[bytes]:
        """The merge rule itself, with the ranks under `below`: join the pair of least rank, the first of equals."""
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < below:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            for k in (i - 1, i):
                if 0 <= k < len(ranks):
                    ranks[k] = self.ranks.get(parts[k] + parts[k + 1], below)
        return parts

    def spine(self, token: bytes, halves: dict[bytes, list[bytes]], side: int) -> list[tuple[bytes, int, float]] | None:
        """What stands at the token's border while it is merged, from the single byte up: bytes, rank, and the rank of the merge that ends it.

        None if some merge in it has a lower rank than one it needs; such tokens are told by the merges themselves."""
        out, end = [], float("inf")
        while True:
            rank = self.ranks[token] if len(token) > 1 else -1
            if rank >= end:
                return None
            out.append((token, rank, end))
            if not halves[token]:
                return out[::-1]
            if any(len(h) > 1 and self.ranks[h] > rank for h in halves[token]):
                return None
            token, end = halves[token][side], rank

    def apart(self, a: int, b: int) -> bool | None:
        """Whether no merge joins the two tokens: both borders are followed up in the order of their merges, the left one first among equals.

        None if a merge over the border would come earlier than one it needs."""
        lefts, rights = self.borders[0][a], self.borders[1][b]
        if lefts is None or rights is None:
            return None
        i = j = 0
        ranks = self.ranks
        while True:
            left, made_left, left_ends = lefts[i]
            right, made_right, right_ends = rights[j]
            over = ranks.get(left + right)
            if over is not None:
                if over < made_left or over < made_right:
                    return None
                if over < left_ends and over <= right_ends:
                    return False
            if left_ends <= right_ends:
                i += 1
                if i == len(lefts):
                    return True
            else:
                j += 1

    def fits(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        if (known := self.fit.get(pair)) is None:
            known = self.apart(a, b)
            if known is None:
                left, right = self.bytes_of[a], self.bytes_of[b]
                known = self.merged(left + right) == [left, right]
            self.fit[pair] = known
        return known

    def encode_match(self, text: bytes) -> tuple[int, ...]:
        if not text:
            return ()
        if (whole := self.ranks.get(text)) is not None:
            return (whole,)
        longest, size, shorter = [-1] * len(text), self.size, self.shorter
        for end, token in self.search.iter(text.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # later ends are longer
        path: list[int] = []
        dead, at, token = bytearray(len(text) + 1), 0, longest[0]
        while at < len(text):
            while token >= 0 and (dead[at + size[token]] or path and not self.fits(path[-1], token)):
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += size[token]
                token = longest[at] if at < len(text) else -1
            elif path:
                dead[at] = 1
                token = path.pop()
                at -= size[token]
                token = shorter[token]
            else:
                raise ValueError("the vocabulary lacks single bytes that the text has")
        return tuple(map(self.same.__getitem__, path))

    def encode(self, text: str | None) -> Iterator[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.fit) > REMEMBERED:
            self.fit.clear()
        known = self.known
        return chain.from_iterable([known[x] for x in self.split(text or "")])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def shared(spark: SparkSession, vocabulary: Vocabulary):
    """On every worker: the size is that of the vocabulary, whatever the input."""
    return spark.sparkContext.broadcast(vocabulary)


def encode(text: Column, vocabulary) -> Column:
    """The ids of each text as an array; `vocabulary` comes from `shared`."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        encoder = vocabulary.value.encoder
        return pd.Series([list(encoder.encode(t)) for t in texts], dtype=object)

    return ids(text)


def decode(ids: Column, vocabulary) -> Column:
    """The bytes of each array of ids; null stays null, an unknown id is an error."""

    @F.pandas_udf("binary")
    def back(rows: pd.Series) -> pd.Series:
        encoder = vocabulary.value.encoder
        return pd.Series([None if x is None else encoder.decode(map(int, x)) for x in rows], dtype=object)

    return back(ids)


def round_trip(text: Column, vocabulary) -> Column:
    """n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded ids), without keeping the ids."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        encoder, out = vocabulary.value.encoder, []
        for t in texts:
            ids = list(encoder.encode(t))
            shown = ",".join(map(encoder.name.__getitem__, ids)).encode()
            out.append((len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)


def production(spark: SparkSession):
    import public_tokenizers

    return shared(spark, Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def digest_documents(docs: DataFrame, vocabulary) -> DataFrame:
    """One row per document: doc_id and the digests of its ids and of the decoded bytes."""
    return docs.select("doc_id", round_trip(F.col("text"), vocabulary).alias("d")).select("doc_id", "d.*")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), production(spark))
