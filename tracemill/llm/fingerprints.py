"""Document fingerprints by SimHash, in DataFrame functions only.

The terms of a text are its adjacent pairs of words (lower case, split at white space; the last word also counts alone).
Each occurrence of a term votes with weight one on every bit of the fingerprint, for it where the term's hash has the bit
and against it elsewhere, so a term's weight is its frequency; the sign of a bit's votes is the bit. Votes are added in
packed counters, four 16-bit fields to a long, over blocks of at most BLOCK terms so that no field overflows; blocks are
then added up field by field, so a text of any length is counted whole. Everything happens inside a row: no shuffle.

`near` finds all fingerprints within a Hamming radius of given ones through permuted block tables: the bits are cut into
blocks, each table has some of them in front, and two fingerprints within the radius have equal front blocks in some table.
How many blocks a table has in front follows from the number of fingerprints.

Nulls are empty texts; a text without words has fingerprint zero. Equal texts have equal fingerprints. Repeated rows each get
their row, a null doc_id stays null, other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = 2  # longs of a fingerprint, 64 bits each
BLOCK = 32_000
FIELDS = 0x0001000100010001


def terms(text: Column) -> Column:
    """Words of a text."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with an array column `name` of WORDS longs for the text column. Works in temporary columns that start with the name."""
    w, n, h, v = (f"{name}_{x}" for x in ("words", "terms", "hashes", "votes"))
    df = df.withColumn(w, terms(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(f"{h}0", F.zip_with(w, F.slice(F.col(w), F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    for k in range(1, WORDS):
        df = df.withColumn(f"{h}{k}", F.transform(f"{h}{k - 1}", lambda x: F.xxhash64(x)))
    df = df.withColumn(n, F.size(w)).drop(w)
    zero = F.struct(*(F.lit(0).cast("long").alias(f"c{i}") for i in range(16)))
    starts = F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)), F.lit(BLOCK))

    def votes(hashes: str) -> Column:
        def add(acc: Column, x: Column) -> Column:
            return F.struct(*((acc[f"c{i}"] + F.shiftrightunsigned(x, i).bitwiseAND(F.lit(FIELDS))).alias(f"c{i}") for i in range(16)))

        return F.transform(starts, lambda s: F.aggregate(F.slice(F.col(hashes), s + 1, F.lit(BLOCK)), zero, add))

    df = df.withColumns({f"{v}{k}": votes(f"{h}{k}") for k in range(WORDS)}).drop(*(f"{h}{k}" for k in range(WORDS)))

    def word(k: int) -> str:
        def bit(i: int) -> str:
            ones = f"aggregate(`{v}{k}`, 0L, (acc, block) -> acc + (shiftrightunsigned(block.c{i % 16}, {i // 16 * 16}) & 65535L))"
            return f"if(2 * {ones} > `{n}`, shiftleft(1L, {i}), 0L)"

        return " | ".join(map(bit, range(64)))

    # slice keeps the optimizer from copying the whole expression to each place that takes an element
    return df.withColumn(name, F.expr(f"slice(array({', '.join(map(word, range(WORDS)))}), 1, {WORDS})")).drop(n, *(f"{v}{k}" for k in range(WORDS)))


def hex_of(fp: str) -> Column:
    return F.concat(*(F.lower(F.lpad(F.hex(F.col(fp)[k]), 16, "0")) for k in reversed(range(WORDS))))


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints."""
    return reduce(Column.__add__, (F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(WORDS)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1; 0.5 is what unrelated texts have."""
    return F.lit(1.0) - distance(a, b).cast("double") / F.lit(64.0 * WORDS)


def block_keys(fp: Column, radius: int, agree: int) -> Column:
    """The key of each block table: the bits of its `agree` chosen blocks, moved to the front, and nothing of the others.

    With radius + agree blocks, two fingerprints within the radius are equal in the chosen blocks of at least one table.
    """
    n = radius + agree
    edges = [64 * WORDS * i // n for i in range(n + 1)]

    def bits(lo: int, hi: int) -> list[Column]:
        found = []
        for k in range(WORDS):
            a, b = max(lo, 64 * k), min(hi, 64 * k + 64)
            if a < b:
                found.append(F.shiftrightunsigned(fp[k], a - 64 * k).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)))
        return found

    blocks = [bits(edges[i], edges[i + 1]) for i in range(n)]
    return F.array(*(F.struct(*(c.alias(f"k{i}") for i, c in enumerate([*(x for b in chosen for x in blocks[b]), *[F.lit(0).cast("long")] * (2 * agree)][: 2 * agree]))) for chosen in combinations(range(n), agree)))


def agreeing(rows: int, radius: int, most: int = 64) -> int:
    """Blocks in front of a table: the fewest for which equal front blocks of random fingerprints are shared by `most` rows or less."""
    for agree in (1, 2, 3):
        if rows >> 64 * WORDS // (radius + agree) * agree <= most:
            break
    return agree


def near(fingerprints: DataFrame, queries: DataFrame, radius: int = 6, agree: int | None = None, salts: int = 16) -> DataFrame:
    """(query, fp, bits): the distinct fingerprints (column fp) within the radius of each distinct query fingerprint.

    A pair is made in the first table in which its keys agree and in no other, so equal keys in many tables cost no more rows.
    Keys that many fingerprints share are dealt over `salts` parts; the queries, a small set, go to each. The join is one of sorted
    sides, as the queries grow with the table and their repeated rows compress too well for Spark's estimate of a broadcast.
    """
    there, asked = (common.keep(df.select("fp").distinct()) for df in (fingerprints, queries))
    agree = agree or agreeing(there.count(), radius)
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))

    def dealt(df: DataFrame, name: str, salt: Column) -> DataFrame:
        return df.select(F.col("fp").alias(name), salt.alias("salt"), F.posexplode(block_keys(F.col("fp"), radius, agree)).alias("table", "key"))

    met = dealt(there, "there", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")).join(dealt(asked.select("fp", every.alias("salt")), "asked", F.col("salt")).hint("merge"), ["table", "key", "salt"])
    differs = F.array(*(F.col("there")[k].bitwiseXOR(F.col("asked")[k]) for k in range(WORDS)))
    bits = distance(F.col("there"), F.col("asked"))
    found = met.where(bits <= radius).withColumn("keys", block_keys(differs, radius, agree))
    first = F.array_position(F.transform("keys", lambda k: F.forall(F.array(*(k[f"k{i}"] for i in range(2 * agree))), lambda x: x == 0)), True) - 1
    return found.where(first == F.col("table")).select(F.col("asked").alias("query"), F.col("there").alias("fp"), bits.cast("int").alias("bits"))


def search(df: DataFrame, keys: Column, ties: Column, count: int, name: str) -> DataFrame:
    """df with `name`: how many of the first sorted bounds (keys, ties) are at most (_key, _tie), less one, by binary search over `count` places."""
    df, step = df.withColumn(name, F.lit(0)), 1 << max(0, (count - 1).bit_length())
    while step > 1:
        step //= 2
        at = F.col(name) + step
        reached = (F.get(keys, at) < F.col("_key")) | (F.get(keys, at) == F.col("_key")) & (F.get(ties, at) <= F.col("_tie"))
        df = df.withColumn(name, F.when(reached, at).otherwise(F.col(name)))  # beyond the end: null, so not reached
    return df


def with_bucket(df: DataFrame, splits: list[tuple[int, int]], name: str, group: int = 256) -> DataFrame:
    """df with `name`, how many of the sorted splits are at most (_key, _tie), less one, and `_bound`, the key of the last of these.

    Splits are searched in groups: the first of each group stands in the plan, the rest in a table of a row a group, which is
    broadcast. The time to plan is that of the groups' firsts; of 65,536 splits the table holds 1 MB.
    """
    groups = [splits[k : k + group] for k in range(0, len(splits), group)]
    firsts = ([g[0][k] for g in groups] for k in (0, 1))
    df = search(df, *(F.lit(f) for f in firsts), len(groups), "_group")
    rows = [(g, [k for k, _ in part], [t for _, t in part]) for g, part in enumerate(groups)]
    bounds = df.sparkSession.createDataFrame(rows, "_group int, _keys array<long>, _ties array<long>")
    df = search(df.join(F.broadcast(bounds), "_group"), F.col("_keys"), F.col("_ties"), len(groups[0]), "_fine")
    return df.withColumns({name: F.col("_group") * group + F.col("_fine"), "_bound": F.get("_keys", F.col("_fine"))}).drop("_group", "_fine", "_keys", "_ties")


def range_splits(cuts: list[int], low: int) -> tuple[list[tuple[int, int]], bool]:
    """Where ranges begin, as (key, tie), and whether some key has several ranges, by its ties, as it holds several quantiles."""
    lowest, splits = -(1 << 63), []
    for key, times in sorted(Counter([low, *cuts]).items()):
        splits += [(key, lowest + (1 << 64) // times * i) for i in range(times if key != low else max(1, times - 1))]
    return splits, len({k for k, _ in splits}) < len(splits)


def with_next_text(docs: DataFrame, rows_per_bucket: int = 256, max_buckets: int = 65_536) -> DataFrame:
    """docs(doc_id, text, ...) with `next_...` columns of the document that follows by ascending doc_id, after the last the first.

    Rows are dealt to ranges of doc_id by quantiles, so that a range is a window of its own whatever the ids are like. The
    quantiles are of a sample of about 64 ids a range, which bounds what they are made from; they only say where ranges
    begin. There are at most max_buckets of them, as their bounds stand in the plan. A doc_id (or null) that many rows share
    has several ranges, by hashes of the texts. The first document of each range is also dealt to the range before, where
    it follows the last one. Repeated ids follow each other in an order fixed by their text; null ids come first.
    """
    columns = docs.columns
    docs = docs.withColumns({"_key": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), "_tie": F.xxhash64("text")})
    n = docs.count()
    buckets = max(1, min(max_buckets, n // rows_per_bucket))
    fractions = [i / buckets for i in range(1, buckets)]
    chosen = docs.where(F.rand(1) < 64.0 * buckets / n) if n > 64 * buckets else docs
    low = docs.agg(F.min("_key")).first()[0]
    cuts = chosen.agg(F.percentile_approx("_key", fractions, max(10_000, 4 * buckets))).first()[0] if fractions else []
    splits, tied = range_splits(cuts or [], low) if n else ([(0, 0)], False)
    last = len(splits) - 1
    docs = with_bucket(docs, splits, "_bucket")
    if tied:  # a range need not begin with a row at its bound, nor hold a row
        firsts = docs.groupBy("_bucket").agg(F.min(F.struct("_key", "_tie")).alias("_first"))  # at most max_buckets rows
        before = F.coalesce(F.lag("_bucket").over(Window.orderBy("_bucket")), F.max("_bucket").over(Window.partitionBy()))
        docs = docs.join(F.broadcast(firsts.withColumn("_before", before)), "_bucket")
        head = (F.col("_first._key") == F.col("_key")) & (F.col("_first._tie") == F.col("_tie"))
        previous = F.col("_before")
    else:
        head = F.col("_bound") == F.col("_key")
        previous = F.when(F.col("_bucket") == 0, last).otherwise(F.col("_bucket") - 1)
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest"))
    before = F.struct(previous.cast("int").alias("bucket"), F.lit(1).alias("guest"))
    dealt = docs.withColumn("_at", F.explode(F.when(head, F.array(own, before)).otherwise(F.array(own))))
    order = Window.partitionBy("_at.bucket").orderBy("_at.guest", "_key", "_tie")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("_at.guest = 0").select(*columns, *(f"next_{c}" for c in columns))


def edited_likeness(docs: DataFrame, radius: int = 6, every: int = 100) -> DataFrame:
    """For each row of docs(doc_id, text), its fingerprint, its edited text's, and how like they and the next document's are.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of the next document, or by
    all it has. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and n_near:
    for doc_ids divisible by `every`, the query set, how many distinct fingerprints of all rows, its own among them, are within
    the radius; null for others.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next_text(with_fingerprint(rows, "text", "fp"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "efp")
    rows = common.keep(rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hex_of("fp").alias("fingerprint"), hex_of("efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "fp",
    ))
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    counts = near(rows, rows.where(asked), radius).groupBy(F.col("query").alias("fp")).agg(F.count("*").alias("n_near"))
    others = rows.where(~asked).withColumn("n_near", F.lit(None).cast("long"))
    return rows.where(asked).join(counts, "fp").select(*others.columns).unionByName(others).drop("fp")
