"""N-gram Jaccard join: groups of documents whose sets of word shingles are linked by a similarity of 0.8 or more.

Sets are hashed; documents with equal sets are one class, and only classes are compared. All n-grams stand in one global
order: those that are common come last, by a count of how often they occur together, the others first, by hash. Two sets that are similar enough
share an n-gram of their first fifth in that order. A list holds the classes that have an n-gram in that prefix.

1. Each class of a list is compared with one leader: the class where the n-gram stands nearest to the front, as a text without edits of its
   own does. So a group of copies needs as many pairs as it has members, not their square.
2. Lists whose classes are all in one component by now are done. In the others, classes outside the leader's component are compared with
   those of other components. Pairs that can't reach the threshold by size, by place in the order or by a short parity that the list's rows carry never become rows.

A pair whose sets are shown to differ too much by their parities is dropped: PARITY bits per set, or as many as a larger set has n-grams, tell for each
range of hashes whether the set has an odd number there, and every bit that differs stands for an n-gram that only one of the two has.

To compare, the order of n-grams (of hashes) is cut into fragments; each fragment's overlap is counted by itself, and the counts
are summed per pair. No link between different components is left out; within one, links that change nothing are not looked for.

The counts that make n-grams common are sums over all documents of what each batch of rows holds several times; they only choose the order, and
any order gives the same result, so the table of at most COMMON n-grams that is sent to workers cuts nothing off.

Texts of any length are read whole, a long one in chunks cut at blanks. Null, empty and blank texts have no shingles, link with nothing and are their own component. Repeated rows are copies like others. A null doc_id counts
in no minimum: a group with only null ids has a null component. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import components, shingle_sets, table, written

WIDTH, FRAGMENTS, PARITY = 5, 8, 1024
#: Words of the short parity.
FOLDED = 4
#: n-grams in the table that orders them: 16 bytes each.
COMMON = 500_000
#: Bits that mark which texts are fetched: two megabytes, at most MARKS / 64 rows. When nearly all are set, they only save nothing.
MARKS = 1 << 24
#: How often a batch of rows must hold an n-gram to count it.
OFTEN = 4


def class_of(shingles: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63 if len(shingles) else None


def parity(shingles: np.ndarray) -> list[int]:
    """Whether the number of hashes is odd, by their last bits, as 64-bit words; a power of two that grows with the set, so that it tells large sets apart too."""
    width = max(PARITY, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def measure(texts: pd.Series) -> pd.DataFrame:
    """Size, class and parity of each text's set; what the batch holds often is put beside its first row."""
    rows, sets = [], {}
    for shingles in shingle_sets(texts, WIDTH):
        rows.append((len(shingles), class_of(shingles), parity(shingles), None))
        sets[rows[-1][1]] = shingles
    if rows:
        found, count = np.unique(np.concatenate(list(sets.values())).view(np.int64), return_counts=True)
        often = count >= OFTEN
        common = [{"s": s, "c": c} for s, c in zip(found[often].tolist(), count[often].tolist())]
        rows[0] = (*rows[0][:3], common)
    out = pd.DataFrame(rows, columns=["n", "cls", "parity", "common"], dtype=object)
    return out.astype({"n": "int64", "cls": "Int64"})


def least_overlap(n: int) -> int:
    """What a set of n must share with any set at a similarity of 0.8."""
    return -(-4 * n // 5)


def prefixes(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(s, p, n, cls): the n-grams that stand first in the global order, with their place."""
    held = common.groupBy("s").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "s").limit(COMMON).orderBy("s").toArrow()
    order = docs.sparkSession.sparkContext.broadcast((held["s"].to_numpy(), held["c"].to_numpy()))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = order.value
        for batch in batches:
            seen, rows = set(), [(np.zeros(0, np.int64),) * 4]
            for shingles in shingle_sets(batch["text"].to_pylist(), WIDTH):
                cls, n = class_of(shingles), len(shingles)
                if cls is None or cls in seen:
                    continue
                seen.add(cls)
                s = shingles.view(np.int64)
                rank = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, count[at], 0)
                s = s[np.lexsort((s, rank))[: n - least_overlap(n) + 1]]
                rows.append((s, np.arange(len(s)), np.full(len(s), n), np.full(len(s), cls)))
            columns = [np.concatenate(x) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["s", "p", "n", "cls"])

    return docs.select("text").mapInArrow(first, "s long, p long, n long, cls long")


def possible(n: str, p: str, m: str, q: str) -> Column:
    """Whether sets of n and m can be similar enough if the first n-gram they share has the places p and q."""
    fits = F.least(n, m) * 5 >= F.greatest(n, m) * 4
    return fits & (F.least(F.col(n) - F.col(p), F.col(m) - F.col(q)) * 9 >= (F.col(n) + F.col(m)) * 4)


def unordered(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose parities leave room for the threshold: at most a ninth of both sizes may differ."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
    # Sizes that can link have parities of the same width, or one of twice the width, whose halves add up to the narrower.
    differ = lambda x, y: x.bitwiseXOR(y)
    halves = lambda x, n: F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), differ)
    narrow = lambda x, y: F.when(F.size(x) > F.size(y), halves(F.col(x), F.size(y))).otherwise(F.col(x))
    both = F.zip_with(narrow("p_a", "p_b"), narrow("p_b", "p_a"), differ)
    odd = F.aggregate(both, F.lit(0), lambda total, x: total + F.bit_count(x))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(odd * 9 <= F.col("n_a") + F.col("n_b")).select("a", "b")


def marked(wanted: DataFrame) -> DataFrame:
    """(word, bits): a bit for each wanted key, in MARKS bits; the number of rows is bounded by that, whatever the input."""
    word, bit = place("key")
    return wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def place(key: str) -> tuple[Column, Column]:
    slot = F.pmod(F.col(key), F.lit(MARKS))
    return F.floor(slot / 64), F.expr(f"shiftleft(1L, int(pmod({key}, 64)))")


def fetched(wanted: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, fragment, grams) of the wanted classes, from the text of their least document.

    Texts whose bit isn't marked stay where they are; of the others, one per key is kept, and the join tells the wanted ones exactly.
    """

    @F.pandas_udf("array<array<long>>")
    def cut(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for s, cls in zip(shingle_sets(texts, WIDTH), wanted):
            borders = np.searchsorted(s, np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(61))
            # Two texts of one key and hash are told apart by their class.
            out.append([x.view(np.int64) for x in np.split(s, borders)] if class_of(s) == cls else [])
        return pd.Series(out, dtype=object)

    key = lambda doc_id, of: F.xxhash64(doc_id, of).alias("key")
    named = wanted.join(classes, "cls").select("cls", key("rep.doc_id", "rep.hash"), F.col("rep.hash").alias("hash"))
    named = written(named, "jaccard-wanted")
    hashed = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("hash"), "text").select(key("doc_id", "hash"), "hash", "text")
    word, bit = place("key")
    held = hashed.join(F.broadcast(marked(named)), (word == F.col("word")) & (F.col("bits").bitwiseAND(bit) != 0), "left_semi")
    texts = held.groupBy("key", "hash").agg(F.first("text").alias("text")).join(named, ["key", "hash"])
    return written(texts.select("cls", F.posexplode(cut("text", "cls")).alias("fragment", "grams")), "jaccard-sets")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link: overlaps by fragment, summed per pair."""
    left = sets.select(F.col("cls").alias("a"), "fragment", F.col("grams").alias("grams_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("fragment").alias("fragment_b"), F.col("grams").alias("grams_b"))
    both = pairs.join(left, "a").join(right.withColumnRenamed("fragment_b", "fragment"), ["b", "fragment"])
    counted = both.select("a", "b", F.size(F.array_intersect("grams_a", "grams_b")).alias("o"), F.size("grams_a").alias("x"), F.size("grams_b").alias("y"))
    summed = counted.groupBy("a", "b").agg(*[F.sum(c).cast("long").alias(c) for c in "oxy"])
    return summed.where("100 * o >= 80 * (x + y - o)").select("a", "b")


def folded(parity: Column) -> Column:
    """FOLDED words of the parity added up, as the parity of a set by that many ranges: where it differs, the whole parity differs, too."""
    word = lambda i: F.aggregate(F.filter(parity, lambda x, at: at % FOLDED == i), F.lit(0).cast("long"), lambda total, x: total.bitwiseXOR(x))
    return F.struct(*[word(i).alias(f"w{i}") for i in range(FOLDED)])


def alike(x: str, y: str, n: str, m: str) -> Column:
    """Whether short parities leave room for the threshold, as in `near`."""
    odd = F.lit(0)
    for i in range(FOLDED):
        odd = odd + F.bit_count(F.col(x)[f"w{i}"].bitwiseXOR(F.col(y)[f"w{i}"]))
    return odd * 9 <= F.col(n) + F.col(m)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each row of doc_id and text: doc_id, hash (of the text), n (of shingles) and cls; and for each class cls, least (doc_id), rep (doc_id and hash of a row) and root, the same for all classes that are linked."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = F.pandas_udf(measure, "n long, cls long, parity array<long>, common array<struct<s:long,c:long>>")
    sizes = written(docs.select("doc_id", F.xxhash64("text").alias("hash"), measured("text").alias("d")).select("doc_id", "hash", "d.*"), "jaccard-sizes")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")).alias("rep")
    grouped = sizes.where("n > 0").groupBy("cls").agg(rep, F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    classes = written(grouped, "jaccard-classes")
    grams = prefixes(docs, sizes.where("common IS NOT NULL").select(F.explode("common").alias("x")).select("x.*"))

    # n-grams of one row are dropped first, by a table of counts that is as narrow as can be.
    again = grams.groupBy("s").agg(F.count("*").alias("times")).where("times > 1").select("s")
    shared = written(grams.join(again, "s"), "jaccard-lists")
    lists = shared.groupBy("s").agg(F.min(F.struct("p", "cls", "n")).alias("lead"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")
    led = shared.join(lists.select("s", "lead.*").toDF("s", "q", "lead", "m"), "s").where(F.col("cls") != F.col("lead"))
    first = written(near(unordered(led.where(possible("n", "p", "m", "q")), "cls", "lead"), classes), "jaccard-pairs")
    sets = fetched(ends(first), docs, classes)
    links = written(similar(first, sets), "jaccard-links")

    roots = components(links)
    named = shared.join(roots, F.col("cls") == F.col("node"), "left").select("s", "p", "n", "cls", F.coalesce("root", "cls").alias("comp"))
    open_lists = named.groupBy("s").agg(F.min_by("comp", F.struct("p", "cls")).alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    short = classes.select(F.col("cls").alias("cls_"), folded(F.col("parity")).alias("short"))
    rest = named.join(open_lists.where("lo <> hi").select("s", "main"), "s").distinct()
    rest = written(rest.join(short, F.col("cls") == F.col("cls_")).drop("cls_"), "jaccard-open")
    other = rest.where("comp <> main").select("s", *[F.col(c).alias(f"other_{c}") for c in ("p", "n", "cls", "comp", "short")])
    apart = F.expr("comp <> other_comp AND (comp = main OR cls < other_cls)")
    cross = rest.join(other, "s").where(apart & possible("n", "p", "other_n", "other_p") & alike("short", "other_short", "n", "other_n"))
    second = unordered(cross, "cls", "other_cls").join(first, ["a", "b"], "left_anti")
    second = written(near(second, classes), "jaccard-pairs")
    missing = written(ends(second).join(sets.select("cls").distinct(), "cls", "left_anti"), "jaccard-missing")
    if not missing.isEmpty():
        sets = sets.unionByName(fetched(missing, docs, classes))
    links = links.unionByName(similar(second, sets.join(ends(second), "cls", "left_semi")))

    roots = components(links)
    told = classes.select("cls", "least", "rep").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", "rep", F.coalesce("root", "cls").alias("root"))
    return sizes.select("doc_id", "hash", "n", "cls"), told


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of doc_id and text."""
    sizes, told = linked(docs)
    told = told.join(told.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "component_id")
    out = sizes.join(told, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def survivors(docs: DataFrame) -> DataFrame:
    """(doc_id, hash): of each group of linked rows, the least doc_id (nulls last), then the least hash of the text. Rows without shingles are in no group."""
    return linked(docs)[1].groupBy("root").agg(F.min("rep").alias("rep")).select("rep.doc_id", "rep.hash")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
