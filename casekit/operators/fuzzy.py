"""Fuzzy matching of a column's values against a vocabulary table, by an index instead of all pairs.

Two texts within t edits of each other: of t + 1 parts of one that do not overlap, at least one is untouched, so it
occurs in the other near its own place. A value therefore asks an inverted table of the entries' n-grams for its rarest
n-grams that do not overlap. What many texts share is asked for last. Values too short for that many n-grams are cut
into even pieces: entries are filed under (length, t, piece number, piece), and a value asks for the pieces it could
share at the places where edits before and behind them could have moved them. Texts that contain one another are found
by the rarest n-gram of the contained one. What either index brings up is verified by the score itself.

Few edits are tried before many: a value whose best entries are nearer than anything that more edits could bring up is
settled, so that values with many neighbours never meet the distant ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casekit.operators.profiling import match_text
from casekit.sources.files import settle

GRAM = 3
INSIDE_SCORE = 85.0
#: First number of edits tried, and by what it grows.
FIRST_EDITS, MORE_EDITS = 2, 1.5
#: Longs that hold the hashed letters of a text, and its hashed pairs of letters.
LETTERS, PAIRS = 2, 3
#: Texts up to this length and number of edits are compared by columns of many pairs.
SHORT, FEW_EDITS = 200, 20


def fuzzy_score(mine: Column, other: Column, edits: Column | None = None) -> Column:
    """100 for equal texts, at least 85 if one contains the other, else the share of letters that need no edit."""
    edits = F.levenshtein(mine, other) if edits is None else edits
    base = (1 - edits / F.greatest(F.length(mine), F.length(other))) * 100.0
    inside = F.contains(mine, other) | F.contains(other, mine)
    return F.when(mine == other, 100.0).when(inside, F.greatest(base, F.lit(INSIDE_SCORE))).otherwise(base)


def _edits(longer: Column, min_score: float, most: int | None = None) -> Column:
    """Most edits with which two texts, the longer of this length, still reach the score after rounding to tenths."""
    edits = F.floor(longer * (1 - (min_score - 0.05) / 100.0) + 1e-9).cast("int")
    return edits if most is None else F.least(edits, F.lit(most))


def _furthest(size: Column, min_score: float) -> Column:
    """Length of the longest text that can reach the score with one of this length."""
    return F.floor(size / max(min_score - 0.05, 1.0) * 100).cast("int")


def _reach(size: Column, min_score: float, longest: int) -> Column:
    """Most edits to any partner, the longest of which is known."""
    return _edits(F.greatest(size, F.least(F.lit(longest), _furthest(size, min_score))), min_score)


def _piece(k: Column, length: Column, edits: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of piece k of edits + 1, of even lengths with the longer ones last."""
    n = edits + 1
    short = F.floor(length / n).cast("int")
    shorter = n - length % n  # so many pieces have the short length
    start = k * short + F.greatest(F.lit(0), k - shorter) + 1
    return start.cast("int"), (short + (k >= shorter).cast("int")).cast("int")


def _entry_pieces(entries: DataFrame, min_score: float, longest: int, most: int | None = None) -> DataFrame:
    """(length, edits, k, piece, norm): an entry's pieces for each number of edits that partners can bring about."""
    size = F.length("norm")
    furthest = F.least(F.lit(longest), _furthest(size, min_score))
    edits = F.array_distinct(F.transform(F.sequence(size, F.greatest(size, furthest)), lambda n: _edits(n, min_score, most)))
    each = entries.select("norm", size.alias("length"), F.explode(edits).alias("edits"))
    numbered = each.withColumn("k", F.explode(F.when(F.col("edits") < F.col("length"), F.sequence(F.lit(0), F.col("edits"))).otherwise(F.array(F.lit(-1)))))
    start, n = _piece(F.col("k"), F.col("length"), F.col("edits"))
    piece = F.when(F.col("k") < 0, "").otherwise(F.substring("norm", start, n))
    return numbered.select("length", "edits", "k", piece.alias("piece"), "norm")


def _value_pieces(values: DataFrame, min_score: float, most: int | None = None) -> DataFrame:
    """(length, edits, k, piece, mine): where a value could hold piece k of an entry of some length."""
    size = F.length("mine")
    near = F.sequence(F.ceil(size * max(min_score - 0.05, 0.0) / 100.0).cast("int"), _furthest(size, min_score))
    each = values.select("mine", F.explode(F.filter(near, lambda n: n > 0)).alias("length"))
    each = each.withColumn("edits", _edits(F.greatest(F.col("length"), size), min_score, most)).where(F.abs(size - F.col("length")) <= F.col("edits"))
    each = each.withColumn("k", F.explode(F.when(F.col("edits") < F.col("length"), F.sequence(F.lit(0), F.col("edits"))).otherwise(F.array(F.lit(-1)))))
    start, n = _piece(F.col("k"), F.col("length"), F.col("edits"))
    more = size - F.col("length")
    # Up to k edits lie before piece k and up to edits - k behind it.
    low = F.greatest(-F.col("k"), more - (F.col("edits") - F.col("k")), 1 - start)
    high = F.least(F.col("k"), more + (F.col("edits") - F.col("k")), size - start - n + 1)
    shifts = F.when(F.col("k") < 0, F.array(F.lit(0))).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    moved = each.select("*", start.alias("start"), n.alias("n"), F.explode(shifts).alias("shift"))
    piece = F.when(F.col("k") < 0, "").otherwise(F.substring("mine", F.col("start") + F.col("shift"), F.col("n")))
    return moved.select("length", "edits", "k", piece.alias("piece"), "mine").distinct()


def _windows(c: Column, n: int) -> Column:
    """All n-grams of a text by their places, or all of it if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1))
    return F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))


def _grams(c: Column) -> Column:
    """Distinct n-grams of a text, of `GRAM` letters, or all of it if it is shorter."""
    return F.array_distinct(_windows(c, GRAM))


def _signed(texts: DataFrame, name: str, prefix: str) -> DataFrame:
    """Texts with a hashed set of their letters, the k-th occurrence of each apart, and one of their pairs of letters.

    An edit takes away one letter and two pairs at most, and adds as many.
    """
    signs: Callable = F.pandas_udf(letter_sets, ", ".join(f"{x} long" for x in _signs("s")))
    signed = texts.repartition(_tasks(texts)).withColumn("signs", signs(name))
    return signed.select(*texts.columns, *[F.col("signs")[x].alias(prefix + x[1:]) for x in _signs("s")])


def _tasks(df: DataFrame) -> int:
    """Tasks for rows that are few and take long: not merged by their size."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _signs(prefix: str) -> list[str]:
    return [f"{prefix}{kind}{k}" for kind, n in (("l", LETTERS), ("p", PAIRS)) for k in range(n)]


def _lost(one: str, other: str, kind: str, n: int) -> Column:
    """So many bits of one text's set are not in the other's."""
    return sum((F.bit_count(F.col(f"{one}{kind}{k}").bitwiseAND(F.bitwise_not(F.col(f"{other}{kind}{k}")))) for k in range(n)), F.lit(0))


def _bits(keys: np.ndarray, held: np.ndarray, longs: int) -> list[np.ndarray]:
    """Longs in which each key of a text, by column, has set the bit of its hash."""
    hashes = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(64 * longs)
    bits = np.uint64(1) << hashes % np.uint64(64)
    return [np.bitwise_or.reduce(np.where(held & (hashes // np.uint64(64) == k), bits, np.uint64(0)), axis=0, initial=0).view(np.int64) for k in range(longs)]


def letter_sets(texts: pd.Series) -> pd.DataFrame:
    """The longs of `_signed`, of texts that are not null."""
    out, step = [], max(1, 1_000_000 // max(1, int(texts.str.len().max())))
    for part in (texts.iloc[k : k + step] for k in range(0, len(texts), step)):
        x, size = _letters_by_place(part), part.str.len().to_numpy()
        place = np.arange(len(x))[:, None]
        ordered = np.sort(np.where(place < size, x, np.uint32(0xFFFFFFFF)), axis=0)
        begins = np.vstack([np.zeros((1, len(part)), bool), ordered[1:] != ordered[:-1]])
        nth = place - np.maximum.accumulate(np.where(begins, place, 0), axis=0)
        letters = _bits(ordered.astype(np.uint64) * np.uint64(8) + np.minimum(nth, 7).astype(np.uint64), place < size, LETTERS)
        pairs = _bits((x[:-1].astype(np.uint64) << np.uint64(21)) + x[1:], place[:-1] < size - 1, PAIRS)
        out.append(pd.DataFrame(dict(enumerate(letters + pairs))))
    return pd.concat(out).set_axis(_signs("s"), axis=1)


def _letters_by_place(texts: pd.Series) -> np.ndarray:
    """Code points: a row for each place, a column for each text."""
    flat = np.array(texts.to_numpy(), dtype=f"U{max(1, int(texts.str.len().max()))}")
    return np.ascontiguousarray(flat.view(np.uint32).reshape(len(texts), -1).T)


def edits_by_columns(mine: pd.Series, norm: pd.Series, most: pd.Series) -> pd.Series:
    """Edits between the texts of each pair, null if more than its most: the diagonals next to the main one, all pairs at once."""
    n, size, length = len(mine), mine.str.len().to_numpy(), norm.str.len().to_numpy()
    band, limit = int(most.max()), most.to_numpy()
    x, y = _letters_by_place(mine), _letters_by_place(norm)
    far, last = np.int8(band + 1), np.full(n, band + 1, np.int8)
    row = [np.full(n, min(abs(k), far) if k >= 0 else far, np.int8) for k in range(-band, band + 1)]
    order = np.argsort(size, kind="stable")
    ends = np.searchsorted(size[order], np.arange(len(x) + 2))

    def read(i: int) -> None:
        done = order[ends[i] : ends[i + 1]]
        for k in range(-band, band + 1):
            here = done[length[done] - i == k]
            last[here] = row[k + band][here]

    read(0)
    for i in range(1, len(x) + 1):
        for k in range(-band, band + 1):
            at, j = k + band, i + k
            if j < 0 or j > len(y):
                row[at] = np.full(n, far, np.int8)
                continue
            if j == 0:
                row[at] = np.full(n, min(i, far), np.int8)
                continue
            best = row[at] + (x[i - 1] != y[j - 1])
            if at < 2 * band:
                np.minimum(best, row[at + 1] + np.int8(1), out=best)
            if at:
                np.minimum(best, row[at - 1] + np.int8(1), out=best)
            row[at] = np.minimum(best, far)
        read(i)
    return pd.Series(last.astype("int32")).where(last <= limit).astype("Int32")


def _within(pairs: DataFrame) -> DataFrame:
    """(mine, norm, edits) of the pairs with `most` edits or fewer."""
    count: Callable = F.pandas_udf(edits_by_columns, "int")
    short = (F.greatest("size", "length") <= SHORT) & (F.col("most") <= FEW_EDITS)
    near = pairs.where(short).withColumn("edits", count("mine", "norm", "most")).where("edits IS NOT NULL")
    far = pairs.where(~short).withColumn("edits", F.call_function("levenshtein", "mine", "norm", "most")).where("edits >= 0")
    return near.select("mine", "norm", "edits").union(far.select("mine", "norm", "edits"))


def _rarest_grams(values: DataFrame, filed: DataFrame) -> DataFrame:
    """Values with `asks`, n-grams that do not overlap and their places, those that the fewest entries hold first."""
    common = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    each = values.select("mine", F.posexplode(_windows(F.col("mine"), GRAM)).alias("at", "gram")).join(common, "gram", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "gram")))
    apart = F.aggregate(order, F.array().cast("array<struct<at:int,gram:string>>"), lambda chosen, x: F.when(
        F.exists(chosen, lambda y: F.abs(x["at"] - y["at"]) < GRAM), chosen
    ).otherwise(F.concat(chosen, F.array(F.struct(x["at"].alias("at"), x["gram"].alias("gram"))))))
    return values.join(each.groupBy("mine").agg(apart.alias("asks")), "mine")


def _indexed(values: DataFrame, entries: DataFrame, min_score: float) -> tuple[DataFrame, DataFrame]:
    """Values with what they ask the index for, and entries as they are filed in it."""
    longest = values.agg(F.coalesce(F.max(F.length("mine")), F.lit(0))).first()[0], entries.agg(F.coalesce(F.max(F.length("norm")), F.lit(0))).first()[0]
    signed = settle(_signed(entries, "norm", "n").withColumn("length", F.length("norm")), "fuzzy-index")
    filed = signed.select("*", F.posexplode(_windows(F.col("norm"), GRAM)).alias("there", "gram"))
    asking = _signed(_rarest_grams(values, filed), "mine", "m").withColumn("size", F.length("mine"))
    return settle(asking.withColumn("reach", _reach(F.col("size"), min_score, max(longest))), "fuzzy-asking"), signed


def _near_pairs(asking: DataFrame, signed: DataFrame, min_score: float, most: int) -> DataFrame:
    """(mine, norm, edits): every pair that reaches the score with so many edits at most, some more than once."""
    limit = F.least("reach", F.lit(most))
    enough = F.size("asks") > limit
    edits = F.greatest("own", "theirs")

    # Places go by intervals, so that a value asks for three of them at most.
    width = most + 1
    asked = asking.where(enough).select("mine", "size", _edits(F.col("size"), min_score, most).alias("own"), *_signs("m"), limit.alias("limit"), F.explode(F.slice("asks", 1, limit + 1)).alias("ask"))
    asked = asked.select("mine", "size", "own", *_signs("m"), "ask.at", "ask.gram", F.explode(
        F.sequence(F.floor((F.col("ask.at") - F.col("limit")) / width), F.floor((F.col("ask.at") + F.col("limit")) / width))
    ).alias("place"))
    held = signed.select("*", _edits(F.col("length"), min_score, most).alias("theirs"), F.posexplode(_windows(F.col("norm"), GRAM)).alias("there", "gram"))
    held = held.withColumn("place", F.floor(F.col("there") / width))
    before = F.col("at") - F.col("there")
    can = F.abs(before) + F.abs(F.col("size") - F.col("length") - before) <= edits
    for kind, n, each in (("l", LETTERS, 1), ("p", PAIRS, 2)):
        can &= (_lost("m", "n", kind, n) <= each * edits) & (_lost("n", "m", kind, n) <= each * edits)
    tasks = _tasks(signed)
    met = asked.repartition(tasks, "gram", "place").join(held.repartition(tasks, "gram", "place"), ["gram", "place"]).where(can).select("mine", "norm", "size", "length", edits.alias("most"))

    few = asking.where(~enough).select("mine", "size")
    longest = few.agg(F.max("size")).first()[0]
    if longest is not None:
        pieces = _entry_pieces(signed.select("norm"), min_score, longest, most)
        shared = _value_pieces(few.select("mine"), min_score, most).join(pieces, ["length", "edits", "k", "piece"])
        met = met.union(shared.select("mine", "norm", F.length("mine").alias("size"), "length", F.col("edits").alias("most")))
    return _within(met)


def _containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): texts of `inner` that lie within longer ones of `outer`, by their rarest n-gram there."""
    short = F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda n: F.transform(
        F.sequence(F.lit(1), F.length("outer") - n + 1), lambda i: F.when(F.length("outer") >= n, F.substring("outer", i, n))
    ))
    # Texts shorter than an n-gram are looked up as they are.
    filed = outer.select("outer", F.explode(F.array_distinct(F.concat(_grams(F.col("outer")), F.array_compact(F.flatten(short))))).alias("gram")).distinct()
    filed = settle(filed, "grams")
    common = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = inner.select("inner", F.explode(_grams(F.col("inner"))).alias("gram")).join(common, "gram", "left")
    rarest = asked.groupBy("inner").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    met = rarest.join(filed, "gram")
    return met.where((F.length("outer") > F.length("inner")) & F.contains("outer", F.col("inner"))).select("inner", "outer")


def _inside_pairs(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(mine, norm, edits): every pair of which one text contains the other, longer or shorter one."""
    mine, norms = values.select(F.col("mine").alias("outer")), entries.select(F.col("norm").alias("inner"))
    pairs = _containing(norms, mine).select(F.col("outer").alias("mine"), F.col("inner").alias("norm"))
    mine, norms = values.select(F.col("mine").alias("inner")), entries.select(F.col("norm").alias("outer"))
    pairs = pairs.union(_containing(mine, norms).select("inner", "outer"))
    return pairs.withColumn("edits", F.levenshtein("mine", "norm"))


def fuzzy_candidates(values: DataFrame, entries: DataFrame, min_score: float) -> DataFrame:
    """(mine, norm): every pair of normalised texts that can reach the score, and few that do not."""
    asking, signed = _indexed(values, entries, min_score)
    pairs = _near_pairs(asking, signed, min_score, asking.agg(F.coalesce(F.max("reach"), F.lit(0))).first()[0])
    if min_score <= INSIDE_SCORE:
        pairs = pairs.union(_inside_pairs(values, entries))
    return pairs.select("mine", "norm").distinct()


def fuzzy_join(
    df: DataFrame, column: str, vocabulary: DataFrame, entry: str, min_score: float = 70.0, top: int = 3
) -> DataFrame:
    """Best entries of a vocabulary table for each distinct value of a column, with the number of rows it holds.

    Same scores and order as `fuzzy_matches`, for vocabularies of any size: no value is compared with all entries,
    unless the wanted score is so low that texts of those lengths reach it with every letter changed. Null values and
    those without letters after normalising have no rows; repeated entries count once.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("row_count"))
    values = settle(values.withColumn("mine", match_text(F.col("value"))).where("mine <> ''"), "fuzzy-values")
    entries = vocabulary.select(F.col(entry).cast("string").alias("match")).where("match IS NOT NULL").distinct()
    entries = settle(entries.withColumn("norm", match_text(F.col("match"))).where("norm <> ''"), "fuzzy-entries")
    left, signed = _indexed(values.select("mine").distinct(), entries.select("norm").distinct(), min_score)
    # Of entries with one text, no more than the first can be among the best.
    entries = entries.withColumn("nth", F.row_number().over(Window.partitionBy("norm").orderBy("match"))).where(F.col("nth") <= top).drop("nth")
    rank = F.row_number().over(Window.partitionBy("mine").orderBy(F.desc("score"), "match"))
    best, most, reach = [], FIRST_EDITS, left.agg(F.max("reach")).first()[0]
    while True:
        last = reach is None or reach <= most
        pairs = _near_pairs(left, signed, min_score, most)
        if last and min_score <= INSIDE_SCORE:
            pairs = pairs.union(_inside_pairs(left.select("mine"), signed.select("norm")))
        scored = pairs.distinct().withColumn("score", F.round(fuzzy_score(F.col("mine"), F.col("norm"), F.col("edits")), 1)).where(F.col("score") >= min_score)
        hits = scored.join(entries, "norm").withColumn("rank", rank).where(F.col("rank") <= top).select("mine", "rank", "match", "score")
        if last:
            best.append(hits)
            break
        hits = settle(hits, "fuzzy-hits")
        # What has more edits lacks at least so many letters of the longer text, and that has no more than all in it.
        beyond = F.round((1 - (most + 1) / (F.col("size") + most + 1)) * 100.0, 1)
        worst = hits.where(F.col("rank") == top).select("mine", F.col("score").alias("worst"))
        open_ = F.coalesce(F.col("worst") <= (F.greatest(beyond, F.lit(INSIDE_SCORE)) if min_score <= INSIDE_SCORE else beyond), F.lit(True))
        if min_score > INSIDE_SCORE:
            open_ = open_ & (F.col("reach") > most)
        left = settle(left.join(worst, "mine", "left").where(open_).drop("worst"), "fuzzy-left")
        best.append(hits.join(left.select("mine"), "mine", "left_anti"))
        reach, most = left.agg(F.max("reach")).first()[0], max(most + 1, int(most * MORE_EDITS))
        if reach is None:
            break
    found = best[0]
    for more in best[1:]:
        found = found.union(more)
    return found.join(values, "mine").select("value", "row_count", "rank", "match", "score")
