"""Phrases whose words stand together far more often than apart, per language.

Misra-Gries summaries per hash partition: a summary holds counters and an error bound; two are merged by adding their counters, and where more than the capacity are
left, the largest that has no room is taken off all of them and added to the bound. A count is short by the bound at most, and that is at most the partition's mass
(the occurrences of its phrases) divided by the capacity. The capacity is the mass divided by MARGIN, well under the LEAST occurrences that are asked for,
so every frequent phrase survives with a count of LEAST less the bound or more.

1. The texts are dealt into blocks. A block hashes its phrases of one to LONGEST words, counts equal ones and cuts the counts by hash
   partition: a summary without error for each. Phrases are 48 bits here; two that share them only make one more candidate.
2. The summaries of a partition are merged, and each block is told which of its phrases are candidates.
3. Second pass: a block counts its candidates exactly, told apart by 128 bits, and names them by their words. Sums over the blocks are the counts.
4. Cuts, scores and the phrases inside longer ones are joins of the table of frequent phrases with itself.

Both passes read one exchange of the texts. A block is a hash of doc_id, lang and text, so rows that are equal in all three are in one block; every other
group is spread. A common phrase is one counter of each block, however often it stands there.

A null lang is `und`; a null or empty text has no words; texts of any length are read whole, and no phrase crosses two. Ties in the ranking are ordered by
count, then by the phrase's bytes. Repeated rows count each time. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import among, letter_words, mixed, powers, runs_of, table, written

LEAST, LONGEST, TOP, INSIDE, SCALE = 30, 4, 2000, 80, 2_000_000
#: Occurrences per counter; the error bound of a summary stays below it.
MARGIN = 8
#: Bytes of text in a block and for a hash partition, and those that are hashed at a time.
BLOCK, CHUNK = 1 << 23, 1 << 20
#: Bytes of a packed phrase.
PACKED = 6

_CUT = np.isin(np.arange(256), list(b".,;:!?\n\v\f\r"))
_GAP = _CUT | np.isin(np.arange(256), list(b" \t"))
_ONE, _OTHER = letter_words(0x9E3779B97F4A7C15, True), letter_words(0xD1342543DE82EF95, True)


def chunks(texts: list[str]) -> Iterator[bytes]:
    """The texts, a cut between two; a long one is divided at a cut, if it has any."""
    held, size = [], 0
    for text in texts:
        raw = text.encode()
        while len(raw) > CHUNK and (found := re.compile(rb"[.,;:!?\n\v\f\r]").search(raw, CHUNK // 2)):
            yield raw[: found.start()]
            raw = raw[found.end() :]
        if held and size + len(raw) > CHUNK:
            yield b"\n".join(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield b"\n".join(held)


class Words:
    """The words of a chunk: where they start and end, the piece each is in, and their hashes."""

    def __init__(self, raw: bytes, lang: str, tables: list[np.ndarray]):
        letters = np.frombuffer(raw, np.uint8)
        edge = np.concatenate([[True], _GAP[letters], [True]])
        self.raw = raw
        self.start, self.end = np.flatnonzero(edge[:-1] & ~edge[1:]), np.flatnonzero(~edge[:-1] & edge[1:])
        self.piece = np.cumsum(_CUT[letters])[self.start] if len(raw) else self.start
        self.salt = np.uint64(xxhash.xxh3_64_intdigest(lang))
        power, inverse = powers(len(raw) + 1)
        self.hashes = []
        for letter in tables:
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(letter[letters] * power[: len(raw)], out=sums[1:])
            self.hashes.append(mixed((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64)))

    def phrases(self, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each phrase of n words, and its hash."""
        m = max(0, len(self.piece) - n + 1)
        at = np.flatnonzero(self.piece[:m] == self.piece[n - 1 : n - 1 + m])
        return at, mixed(runs_of(self.hashes[which], n)[at] ^ self.salt)

    def texts(self, first: np.ndarray, n: int) -> list[str]:
        """The phrases of n words from these words on, a blank between two words."""
        raw = self.raw.lower().replace(b"\t", b" ")
        # Where the gaps have one byte each, the text is there as it should be.
        size = np.concatenate([[0], np.cumsum(self.end - self.start)])
        start, end = self.start[first], self.end[first + n - 1]
        plain = end - start == size[first + n] - size[first] + n - 1
        return [(raw[a:b] if p else b" ".join(raw[a:b].split())).decode() for a, b, p in zip(start.tolist(), end.tolist(), plain.tolist())]


def by_language(rows: pd.DataFrame, tables: list[np.ndarray]) -> Iterator[tuple[str, Words]]:
    for lang, texts in rows.groupby("lang")["text"]:
        for raw in chunks(list(texts)):
            yield lang, Words(raw, lang, tables)


def packed(phrases: np.ndarray) -> bytes:
    return phrases.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PACKED].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // PACKED, 8), np.uint8)
    out[:, :PACKED] = np.frombuffer(raw, np.uint8).reshape(-1, PACKED)
    return out.view("<u8")[:, 0]


def narrow(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - 8 * PACKED)


class Summary:
    """A Misra-Gries summary: counters, and by how much they may be short."""

    def __init__(self, capacity: int):
        self.capacity, self.short = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, short: int = 0) -> None:
        both = np.concatenate([self.keys, keys])
        self.keys, of = np.unique(both, return_inverse=True)
        self.counts = np.bincount(of, np.concatenate([self.counts, counts]), len(self.keys)).astype(np.int64)
        self.short += short
        if len(self.keys) > self.capacity:
            off = np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1]
            left = self.counts > off
            self.keys, self.counts, self.short = self.keys[left], self.counts[left] - off, self.short + int(off)

    def frequent(self, least: int) -> np.ndarray:
        """Every key with `least` occurrences, and maybe some with fewer."""
        return self.keys[self.counts + self.short >= least]


def summaries(partitions: int):
    """Of a block: (p, block, once, often, counts), the phrases of partition p that it has once, those it has oftener, and how often."""

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        found = [words.phrases(n)[1] for _, words in by_language(rows, [_ONE]) for n in range(1, LONGEST + 1)]
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        p = (keys % np.uint64(partitions)).astype(np.int64)
        order = np.argsort(p, kind="stable")
        keys, counts, p = narrow(keys[order]), counts[order], p[order]
        out = []
        for at in np.split(np.arange(len(p)), np.flatnonzero(p[1:] != p[:-1]) + 1):
            if len(at):
                k, c = keys[at], counts[at]
                out.append((p[at[0]], rows["block"].iloc[0], packed(k[c == 1]), packed(k[c > 1]), c[c > 1].astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["p", "block", "once", "often", "counts"])

    return read


def candidates(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a hash partition: for each block, its phrases that may be frequent."""
    counts = [np.frombuffer(x, "<u4").astype(np.int64) for x in rows["counts"]]
    mass = sum(len(x) // PACKED for x in rows["once"]) + sum(int(x.sum()) for x in counts)
    summary = Summary(mass // MARGIN + 1)
    held, size = [], 0
    for once, often, c in zip(rows["once"], rows["often"], counts):
        once = unpacked(once)
        held.append((np.concatenate([once, unpacked(often)]), np.concatenate([np.ones(len(once), np.int64), c])))
        size += len(held[-1][0])
        # Sorted together, as many as there are counters; one at a time would sort those again for each.
        if size > summary.capacity:
            summary.merge(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        summary.merge(*map(np.concatenate, zip(*held)))
    frequent = summary.frequent(LEAST)
    out = []
    for block, once, often in zip(rows["block"], rows["once"], rows["often"]):
        k = np.concatenate([unpacked(once), unpacked(often)])
        k = k[among(k, frequent)]
        if len(k):
            out.append((block, packed(k)))
    return pd.DataFrame(out, columns=["block", "wanted"])


class Wanted:
    """A set of narrow hashes; a table of their last bits answers for most that are not in it."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.last = np.zeros(1 << 22, bool)
        self.last[(self.keys & np.uint64(len(self.last) - 1)).astype(np.int64)] = True

    def has(self, x: np.ndarray) -> np.ndarray:
        out = self.last[(x & np.uint64(len(self.last) - 1)).astype(np.int64)]
        near = np.flatnonzero(out)
        out[near] = among(x[near], self.keys)
        return out


def counted(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """Of a block: (lang, phrase, words, f), how often it has each candidate; the phrase is null for all words together."""
    wanted = Wanted(np.concatenate([unpacked(x) for x in told["wanted"]] or [np.zeros(0, np.uint64)]))
    out = []
    for lang, words in by_language(rows, [_ONE, _OTHER]):
        out.append((lang, None, 1, len(words.start)))
        for n in range(1, LONGEST + 1):
            at, one = words.phrases(n)
            here = np.flatnonzero(wanted.has(narrow(one)))
            if not len(here):
                continue
            one, other, at = one[here], words.phrases(n, 1)[1][here], at[here]
            order = np.lexsort((other, one))
            one, other, at = one[order], other[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (other[1:] != other[:-1])]))
            size = np.diff(np.append(first, len(one)))
            out += [(lang, phrase, n, f) for phrase, f in zip(words.texts(at[first], n), size.tolist())]
    return pd.DataFrame(out, columns=["lang", "phrase", "words", "f"])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, words, f) of every phrase with LEAST occurrences or more; and for each lang, with a null phrase, of all its words."""
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.col("text").cast("string")
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    parts = size // BLOCK + 1
    block = F.pmod(F.xxhash64(F.col("doc_id"), lang, text), F.lit(parts)).alias("block")
    dealt = docs.where(text != "").select(block, lang.alias("lang"), text.alias("text"))
    parts_of = dealt.groupBy("block").applyInPandas(summaries(parts), "p long, block long, once binary, often binary, counts binary")
    told = parts_of.groupBy("p").applyInPandas(candidates, "block long, wanted binary")
    exact = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(counted, "lang string, phrase string, words int, f long")
    summed = exact.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return summed.where(F.col("phrase").isNull() | (F.col("f") >= LEAST))


def part(first: Column | int, n: Column | int) -> Column:
    """Some of the words `w`."""
    return F.array_join(F.slice("w", first, n), " ")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    every = written(counts(docs), "phrase-counts")
    known = every.where("phrase IS NOT NULL")
    long = known.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # Phrases that lie in a longer one nearly as often as they occur.
    spans = [(n, i) for n in range(2, LONGEST) for i in range(LONGEST - n + 1)]
    inner = F.array_distinct(F.array(*[F.when(F.col("words") >= i + n + (i == 0), part(i + 1, n)) for n, i in spans]))
    longer = long.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").where("phrase IS NOT NULL")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = long.join(longer, ["lang", "phrase"], "left").where(f"most IS NULL OR 100 * CAST(most AS DECIMAL(20)) < {INSIDE} * CAST(a AS DECIMAL(20))")

    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    side = lambda part, f: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    score = F.expr(f"(CAST(a AS DECIMAL(20)) * {SCALE}) div (CAST(l AS DECIMAL(20)) + CAST(r AS DECIMAL(20)))")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.select("lang", "phrase", "a", "x.*").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    n = every.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
    sized AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM words),
    starts AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM sized WHERE len(w) >= k),
    known AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, any_value(k) AS k, count(*)::BIGINT AS f FROM starts GROUP BY 1, 2 HAVING count(*) >= 30),
    long AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM known WHERE k > 1),
    inside AS (SELECT lang, a, w, len(w) AS k, unnest(range(2, len(w))) AS m FROM long WHERE k > 2),
    placed AS (SELECT lang, a, w, m, unnest(generate_series(1, k - m + 1)) AS i FROM inside),
    longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM placed GROUP BY 1, 2),
    kept AS (SELECT long.* FROM long LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT),
    cuts AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS c FROM kept),
    scored AS (SELECT t.lang, t.phrase, t.a, c, x.f AS l, y.f AS r, ((2000000::HUGEINT * t.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
      FROM cuts t JOIN known x ON x.lang = t.lang AND x.phrase = array_to_string(t.w[1:c], ' ') JOIN known y ON y.lang = t.lang AND y.phrase = array_to_string(t.w[c + 1:], ' ')),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
