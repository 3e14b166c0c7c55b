"""SpotSigs fingerprints (operator 10), in DataFrame functions only.

Common words are anchors.  The first of a run of anchors and the chain of two content
words after the run form a signature, so that signatures sit in running prose and not in
lists or navigation.  The start and the end of a text are anchors as well: its first two
and its last two words are a signature (the only ones of a text without common words).  A
fingerprint is the set of a text's signatures, written as their sorted 32-bit hashes in
hexadecimal.

``similar_pairs`` (not part of op10, whose query compares two fixed pairs of each document
by a plain Jaccard) finds near texts without comparing all pairs: sets are partitioned by length (two
sets of Jaccard t or more differ in length by a factor of at most 1/t, so they lie in the
same or neighbouring partitions), a set is indexed by its rarest signatures only, as many
as a similar set can't avoid, and a comparison ends where the lengths rule it out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_or_empty

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the a an is was of and to in that for it are be with as "
    "der die das und ist von zu mit ein eine den im nicht des auf "
    "le la les du et est un une de que en des pour dans il "
    "el los las y es del por con una no se al lo su"
).split()


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, by first letter."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by_first.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in by_first.items()) + ")"


def signatures(text: Column, anchors: list[str] = ANCHORS) -> Column:
    """The text's signatures as an ascending array of distinct 32-bit hashes.

    Words stand between single spaces; a run of anchors becomes a mark on the content word
    after it; each marked word (and the first of the text) with the word that follows it
    is a signature, and so are the last two words where neither is marked.  One expression
    reads the text a fixed number of times."""
    word = _any_of(anchors)
    plain = F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")
    # possessive, so that the matcher loops over long runs and doesn't recurse
    marked = F.regexp_replace(plain, f" ({word})(?: {word}(?= ))*+ (?=[^ ])", " $1^")
    # a text that starts with no anchor starts with an empty one
    marked = F.regexp_replace(marked, r"^ (?=[^ ^]+ )", " ^")
    pairs = F.regexp_extract_all(marked, F.lit(r"(?<= )(?=([^ ^]*+\^[^ ]++(?: [^ ]+)?|[^ ^]++ [^ ^]++(?= $)))"), F.lit(1))
    chain = F.transform(pairs, lambda s: F.hash(F.substring_index(s, " ", 1), F.substring_index(F.substring_index(s, " ", -1), "^", -1)))
    return F.array_sort(F.array_distinct(chain))


def fingerprint(signs: Column) -> Column:
    return F.array_join(F.transform(signs, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature arrays; 1 where neither has any, 0 where one has none."""
    both = F.size(F.array_intersect(a, b))
    jaccard = both / (F.size(a) + F.size(b) - both)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(jaccard)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, signatures, fingerprint) of every row; a null text is empty and has none."""
    return docs.select(F.col(id_col).alias("doc_id"), signatures(text_or_empty(text_col)).alias("signatures")).withColumn("fingerprint", fingerprint(F.col("signatures")))


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of different fingerprints with at least this likeness, each
    named by its hash (``print_hash``); rows of one fingerprint are one member.  Empty sets
    have no partners."""
    sets = prints.where(F.size("signatures") > 0).select(F.xxhash64("fingerprint").alias("h"), "signatures").dropDuplicates(["h"])
    size = F.size("signatures")
    sets = sets.withColumn("part", F.floor(F.log(size.cast("double")) / math.log(1 / threshold)).cast("int"))
    each = sets.select("h", F.explode("signatures").alias("s"))
    rarity = each.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(rarity, "s").groupBy("h").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("r"))
    full = sets.join(ranked, "h").withColumn("prefix", F.expr(f"transform(slice(r, 1, size(r) - cast(ceil({threshold} * size(r) - 1e-9) as int) + 1), x -> x.s)"))
    probe = full.select("h", "signatures", "part", F.explode("prefix").alias("s"))
    left = probe.select(F.col("h").alias("a"), F.col("signatures").alias("x"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("p"))
    right = probe.select(F.col("h").alias("b"), F.col("signatures").alias("y"), "s", F.col("part").alias("p"))
    pairs = left.join(right, ["s", "p"]).where((F.col("a") != F.col("b")) & (F.size("x") >= threshold * F.size("y")) & (F.size("y") >= threshold * F.size("x")))
    pairs = pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).dropDuplicates(["lo", "hi"])
    scored = pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b"), likeness(F.col("x"), F.col("y")).alias("likeness"))
    return scored.where(F.col("likeness") >= threshold)


#: Bytes of text that one range of ids holds, and the most ranges there are.
RANGE_BYTES, MOST_RANGES = 1 << 20, 1 << 14


def _array(values: list[int]) -> Column:
    return F.from_json(F.lit(str([int(v) for v in values])), "array<bigint>")  # one literal once folded


def _smaller(sorted_values: list[int], x: Column) -> Column:
    """How many of the values are smaller, by halving."""
    values, mid = _array(sorted_values), lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(sorted_values)).alias("hi"))

    def step(a: Column, _: Column) -> Column:
        less = F.get(values, mid(a)) < x
        open_ = a["lo"] < a["hi"]
        return F.struct(F.when(open_ & less, mid(a) + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~less, mid(a)).otherwise(a["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(sorted_values).bit_length())), start, step)["lo"]


def _ranges(light: DataFrame) -> tuple[list[int], list[int], int]:
    """(upper ends of ranges of ids, into how many by hash each is split, and the null ids), so
    that a range, or a share of a single frequent id, holds about ``RANGE_BYTES``."""
    total = light.agg(F.sum("bytes")).first()[0] or 0
    share = max(RANGE_BYTES, -(-total // MOST_RANGES))
    fine = max(1, 4 * -(-total // share))
    found = light.agg(F.percentile_approx("id", [k / fine for k in range(1, fine + 1)], max(10_000, 10 * fine))).first()[0] if fine > 1 else None
    found = [int(v) for v in found or []]
    often = [v for v, after in zip(found, found[1:], strict=False) if v == after]
    cuts = sorted({*found, *(v - 1 for v in often)})
    sums = light.groupBy(F.when(F.col("id").isNotNull(), _smaller(cuts, F.col("id"))).alias("k")).agg(F.sum("bytes").alias("bytes"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    ends, splits, held, of_null = [], [], 0, 1
    for r in sorted(sums.collect(), key=lambda r: (r["k"] is None, r["k"])):  # a row for each of the cuts
        many = -(-r["bytes"] // share)
        if r["k"] is None:
            of_null = many
        elif r["lo"] == r["hi"] and many > 2:
            ends += [r["lo"] - 1, r["lo"]]
            splits += [1, many]
            held = 0
        else:
            held += r["bytes"]
            if held >= share:
                ends.append(r["hi"])
                splits.append(1)
                held = 0
    return ends, [*splits, 1], of_null


def with_next(docs: DataFrame, id_col: str, text_col: str, derive: Callable[[DataFrame], DataFrame], columns: list[str], prefix: str) -> DataFrame:
    """``derive(docs)``, and ``columns`` of the next row by descending ``id_col`` (a whole number;
    nulls last, ties by the text's hash and the columns; after the last the first) with
    ``prefix``.

    Rows are dealt by ranges of ids of about equal bytes (a frequent id, or null, by ranges of
    its texts' hashes as well), each range finds its rows' successors in itself, and its last
    row gets the first row of the range below.  Rows alike in id and text are one range."""
    h = F.shiftrightunsigned(F.xxhash64(text_col), 1)
    light = durable(docs.select(F.col(id_col).cast("bigint").alias("id"), h.alias("h"), (F.octet_length(text_col) + 64).cast("bigint").alias("bytes")))
    ends, splits, of_null = _ranges(light)
    first = [0, *accumulate(splits)]

    def bucket(i: Column, h: Column) -> Column:
        part = lambda n: F.least(F.floor(h / F.lit(2.0**63) * n), n - 1)
        k = _smaller(ends, i)
        here = F.get(_array(first), k) + part(F.get(_array(splits), k))
        return F.when(i.isNull(), part(F.lit(of_null)) - of_null).otherwise(here).cast("bigint")

    inside = Window.partitionBy("_bucket").orderBy(F.desc_nulls_last(id_col), F.desc("_h"), *(F.desc(c) for c in columns))
    dealt = docs.withColumn("_h", h).withColumn("_bucket", bucket(F.col(id_col), F.col("_h")))
    rows = derive(dealt).withColumn("_next", F.lead(F.struct(*columns)).over(inside))
    top = light.groupBy(bucket(F.col("id"), F.col("h")).alias("_bucket")).agg(F.max(F.struct("id", "h")).alias("_top"))
    order = sorted((r["_bucket"] for r in top.select("_bucket").collect()), reverse=True)  # a number for each range
    above = docs.sparkSession.createDataFrame(list(zip(order[1:] + order[:1], order, strict=True)), "_bucket bigint, _above bigint")
    # the first row of each range, without gathering rows alike
    mine = dealt.join(F.broadcast(top), "_bucket").where(F.col(id_col).eqNullSafe(F.col("_top.id")) & (F.col("_h") == F.col("_top.h")))
    plain = [c for c in docs.columns if c != id_col]
    firsts = mine.groupBy("_bucket").agg(F.max(F.struct(*plain)).alias("_first")).select("_bucket", F.lit(None).cast(dict(docs.dtypes)[id_col]).alias(id_col), "_first.*")
    below = derive(firsts).select("_bucket", F.struct(*columns).alias("_first")).join(above, "_bucket").select(F.col("_above").alias("_bucket"), F.col("_first").alias("_below"))
    found = rows.join(below, "_bucket").withColumn("_next", F.coalesce("_next", "_below"))
    return found.drop("_bucket", "_h", "_below").select("*", *(F.col(f"_next.{c}").alias(prefix + c) for c in columns)).drop("_next")


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next) of every row: its fingerprint beside that of its edited text, whose last
    half is the beginning of the next document's, and beside the next document's own.

    Null texts are empty; null ids come last; rows alike in id and text may swap places;
    an empty table gives no rows; other columns are ignored."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    both = with_next(own, "doc_id", "text", lambda df: df.withColumn("signs", signatures(F.col("text"))), ["text", "signs"], "next_")
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    both = both.select("doc_id", "n_chars", "signs", "next_signs", edited.alias("edited"))
    both = both.withColumn("edited_signs", signatures(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("signs")).alias("fingerprint"), fingerprint(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )
