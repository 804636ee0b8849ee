"""Overlaps of at least ``min_common`` movies by joining rare movies first."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import isqrt
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from coratings.functions.metrics import co_rated_sums, metric_value
from coratings.operators.distances import target_ratings
from coratings.operators.numbering import number_rows
from coratings.plans.staging import BROADCAST_ROWS, among, fits_broadcast, sized, stored

_PAIR = ["target_id", "user_id"]

# So many of the most popular movies are a bit each of one number per user.
HEAD = 63
# Ratings in halves that fit so many binary digits are bits too, a number per digit.
DIGITS = 8
# Pairs of a target and a user that one task compares by these numbers, and as
# many as it takes for a thousand tasks, up to the second number.
TASK_PAIRS = 10_000_000
MOST_TASK_PAIRS = 500_000_000
# From so many pairs on, the k nearest of a target are looked for among few users first.
BOUND_PAIRS = 40_000_000
# Bytes a row of targets may take with its bits, or with its ratings of the head.
_HEAD_ROWS = {True: BROADCAST_ROWS // 2, False: BROADCAST_ROWS // 6}


def prefix_overlaps(
    ratings: DataFrame, targets: DataFrame, min_common: int, nearest: tuple[str, int] | None = None
) -> DataFrame:
    """The rows of ``overlaps`` with ``n_common >= min_common``, for thresholds
    that few pairs reach.

    Only the targets' movies count. In the order from rare to popular, two
    users with ``min_common`` of them in common share one that is not among
    the last ``min_common - 1`` of either. These prefixes are joined, so the
    most popular movies of a user meet nobody there; pairs whose matches and
    what can still follow them stay below the threshold are left out, and of
    the others the last movies are looked up pair by pair. No pair is lost and
    every sum is over all common movies.

    The ``HEAD`` most popular movies are never joined. They are bits of one
    number per user, so a pair that shares nothing else is found by comparing
    two numbers, and its sums are taken from the two users' rows where they
    meet: such pairs are neither written nor shuffled. Ratings in halves are
    bits too, so sums are counts of bits; other ratings are added movie by
    movie, which takes many times as long. Every target meets
    every user with ``min_common`` movies of the head, so time grows with
    their product; memory and disk don't. If a user has rated a movie of the head
    twice, or without a rating, all movies are joined.

    ``nearest``, a measure and a number k, is for callers that keep no more
    than the k nearest users of a target: pairs farther than k others of
    their target may then be missing.

    Pays where ``min_common`` is a good part of what users have rated, or
    popular movies make most of the overlaps; else ``overlaps`` joins fewer
    rows. Runs jobs: each step is written.
    """
    if min_common < 1:
        raise ValueError("min_common must be at least 1")
    mine = stored(target_ratings(ratings, targets), compact=True)
    theirs = stored(among(ratings, mine, "movie_id").select("user_id", "movie_id", "rating"))
    raters = stored(theirs.groupBy("movie_id").agg(F.count("*").alias("raters")))
    placed = stored(theirs.join(sized(raters), "movie_id"))
    # Place from the popular end: the prefix are the places from min_common on.
    placed = stored(number_rows(placed, ["user_id"], [F.desc("raters"), F.desc("movie_id")], "place").drop("raters"))
    head = [r.movie_id for r in raters.orderBy(F.desc("raters"), F.desc("movie_id")).take(HEAD)]
    users = _users(placed, head, min_common)
    digits = [F.bit_or(f"d{i}").alias(f"d{i}") for i in range(DIGITS)]
    twice, other, *used = users.agg(F.count_if(F.expr("bit_count(word) <> n_head")), F.sum("n_other"), *digits).first()
    in_bits = not other
    if twice or other:
        head = [] if twice else head
        users = _users(placed, head, min_common, bits=False)
    kept = [f"d{i}" for i, d in enumerate(used) if d] if in_bits else [f"r{i}" for i in range(len(head))]
    in_head = F.col("movie_id").isin(head) if head else F.lit(False)

    wanted = sized(stored(targets.select(F.col("user_id").alias("target_id")).distinct()))
    of_target = stored(
        placed.withColumnsRenamed({"user_id": "target_id", "rating": "target_rating", "place": "target_place"})
        .join(wanted, "target_id", "left_semi")
    )
    rare = placed.where((F.col("place") >= min_common) & ~in_head)
    of_rare = of_target.where((F.col("target_place") >= min_common) & ~in_head)
    matched = stored(rare.join(sized(of_rare), "movie_id").where("user_id <> target_id"))
    # What can follow: the common movies of the head, and those outside of either prefix.
    narrow = users.select("user_id", "word", "n_last")
    words = narrow.join(wanted, narrow.user_id == F.col("target_id"), "left_semi").withColumnsRenamed(
        {"user_id": "target_id", "word": "target_word", "n_last": "target_last"}
    )
    pairs = stored(
        matched.groupBy(*_PAIR).agg(F.count("*").alias("n"))
        .join(sized(stored(words)), "target_id")
        .join(sized(narrow), "user_id")
        .where(F.col("n") + F.bit_count(F.col("word").bitwiseAND(F.col("target_word"))) + F.col("n_last") + F.col("target_last") >= min_common)
        .select(*_PAIR)
    )

    rated = ["target_rating", "rating"]
    last_of_target = of_target.where((F.col("target_place") < min_common) | in_head).drop("target_place")
    last_of_user = placed.where((F.col("place") < min_common) & ~in_head).drop("place")
    found = (
        matched.join(sized(pairs), _PAIR, "left_semi").select(*_PAIR, *rated)
        .union(
            pairs.join(sized(last_of_target), "target_id")
            .join(placed.drop("place"), ["user_id", "movie_id"]).select(*_PAIR, *rated)
        )
        .union(
            pairs.join(last_of_user, "user_id")
            .join(of_rare.drop("target_place"), ["target_id", "movie_id"]).select(*_PAIR, *rated)
        )
    )
    sums = found.groupBy(*_PAIR).agg(*co_rated_sums(F.col("target_rating"), F.col("rating")))
    if len(head) >= min_common:
        met = _met_in_head(users.select("user_id", "word", *kept), wanted, pairs, min_common, in_bits, nearest)
        sums = sums.union(met.select(*[F.col(f.name).cast(f.dataType) for f in sums.schema]))
    return sums.where(F.col("n_common") >= min_common)


def _users(placed: DataFrame, head: list, min_common: int, bits: bool = True) -> DataFrame:
    """Per user: the head as bits, its rated rows, how many other movies are
    not in the prefix, and the ratings of the head: the binary digits of their
    halves as bits (``n_other`` counts those that have no such digits), or by place."""
    at = F.array_position(F.array(*map(F.lit, head)), F.col("movie_id")).cast("int") if head else F.lit(0)
    rows = placed.withColumn("bit", F.coalesce(at, F.lit(0)) - 1).withColumn("value", F.col("rating").cast("double"))
    in_head, last = F.col("bit") >= 0, F.col("place") < min_common
    none = F.lit(0).cast("bigint")
    bit = F.when(in_head, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).otherwise(none)
    halves = (F.col("value") * 2).try_cast("bigint")
    fits = halves.between(0, 2**DIGITS - 1) & (halves == F.col("value") * 2)
    if bits:
        kept = [
            F.coalesce(F.bit_or(F.when(halves.bitwiseAND(F.lit(1 << i)) != 0, bit)), none).alias(f"d{i}") for i in range(DIGITS)
        ]
        kept.append(F.count_if(in_head & ~F.coalesce(fits, F.lit(False))).alias("n_other"))
    else:
        kept = [F.max(F.when(F.col("bit") == i, F.col("value"))).alias(f"r{i}") for i in range(len(head))]
    # A row in the head without a rating counts twice, so it shows as one too many.
    n_head = F.sum(F.when(in_head, F.when(F.col("rating").isNull(), 2).otherwise(1)).otherwise(0))
    return stored(
        rows.repartition("user_id").groupBy("user_id").agg(
            F.bit_or(bit).alias("word"), n_head.alias("n_head"), F.count_if(~in_head & last).alias("n_last"), *kept
        )
    )


def _met_in_head(
    users: DataFrame, wanted: DataFrame, pairs: DataFrame, min_common: int, in_bits: bool, nearest: tuple[str, int] | None
) -> DataFrame:
    """Sums of the pairs that have ``min_common`` movies of the head in common and are not in ``pairs``.

    Both have so many movies of the head that all others are in their
    prefixes, so a pair that shares any of those is in ``pairs``.
    """
    kept = users.columns[2:]
    enough = users.where(F.col("user_id").isNotNull() & (F.bit_count("word") >= min_common))
    others = enough.join(wanted, enough.user_id == F.col("target_id"), "left_semi").withColumnsRenamed(
        {"user_id": "target_id", **{c: f"target_{c}" for c in ["word", *kept]}}
    )
    others = stored(others)
    seen = stored(pairs.groupBy("user_id").agg(F.collect_set("target_id").alias("seen")))
    n_users, n_targets = enough.count(), others.count()
    sums = _sums_of_bits(kept) if in_bits else _sums_of_ratings(kept)
    enough = _not_null(enough, ["user_id", "word", *(kept if in_bits else [])]).join(seen, "user_id", "left")
    if nearest is None or n_users * n_targets < BOUND_PAIRS:
        return _compared(enough, n_users, others, n_targets, sums, min_common, in_bits)
    # Who is farther than k users of a few can't be among the k nearest of all.
    # With more of these users their own lists get longer, with fewer those of all.
    metric, k = nearest
    every = max(1, n_users // (2 * isqrt(k * n_users) + 1))
    few = enough.where(F.pmod(F.xxhash64("user_id"), F.lit(every)) == 0)
    met = _compared(few, n_users // every, others, n_targets, sums, min_common, in_bits)
    listed = met.select("target_id", _farness(metric, F.col, in_bits).alias("bound"))
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy("bound"))
    bounds = stored(listed.withColumn("rank", rank).where(F.col("rank") <= k).where(F.col("rank") == k).drop("rank"))
    # No bound, if even fewer are found: all may be among the k.
    others = stored(others.join(sized(bounds), "target_id", "left").fillna(float("inf"), "bound"))
    near = _farness(metric, sums.__getitem__, in_bits) <= F.col("bound")
    if in_bits and metric in ("euclidean", "manhattan"):
        # Most are too far by their highest digits alone.
        near = (_farness(metric, _least_sums_of_bits(kept).__getitem__, in_bits) <= F.col("bound")) & near
    return _compared(enough, n_users, others, n_targets, sums, min_common, in_bits, near)


def _not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, whose ``columns`` hold no null, in a plan that knows it, so that
    they aren't tested for it pair by pair."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns})


def _farness(metric: str, of: Callable[[str], Column], in_bits: bool) -> Column:
    """Rises as users get farther apart, and alike for equal measures."""
    if in_bits and metric == "euclidean":
        # Quarters, of which no two have the same root.
        return of("sum_sq")
    value = metric_value(metric, of)
    return F.lit(0.0) - value if metric in ("cosine", "pearson") else value


def _compared(
    users: DataFrame, n_users: int, others: DataFrame, n_targets: int, sums: dict[str, Column],
    min_common: int, in_bits: bool, near: Column | None = None,
) -> DataFrame:
    """Every target with every user, block by block: the pairs with
    ``min_common`` movies of the head in common that are ``near`` and not ``seen``."""
    n_pairs = n_users * n_targets
    tasks = min(-(-n_pairs // TASK_PAIRS), max(1_000, -(-n_pairs // MOST_TASK_PAIRS)))
    tasks = max(1, min(n_users, tasks))
    # Targets that are too many for a broadcast are dealt into blocks, of which
    # a task may hold a few, and each block meets the users slice by slice.
    most = _HEAD_ROWS[in_bits]
    n_blocks = 1 if n_targets <= most else -(-4 * n_targets // most)
    n_slices = 1 if n_blocks == 1 else -(-tasks // n_blocks)

    def dealt(key: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(parts))

    def each(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))

    there = _not_null(others, [c for c in others.columns if in_bits or c in ("target_id", "target_word", "bound")])
    blocks = there.withColumn("slice", each(n_slices)).withColumn(
        "cell", F.col("slice") * n_blocks + dealt("target_id", n_blocks)
    )
    own = users.repartition(tasks, "user_id").withColumn("block", each(n_blocks)).withColumn(
        "own_cell", dealt("user_id", n_slices) * n_blocks + F.col("block")
    )
    met = sums["n_common"] >= min_common
    met &= F.col("user_id") != F.col("target_id")
    met &= F.col("seen").isNull() | ~F.array_contains("seen", F.col("target_id"))
    if near is not None:
        met &= near
    if n_blocks > 1:
        own, blocks = own.repartition(n_slices * n_blocks, "own_cell"), blocks.repartition(n_slices * n_blocks, "cell")
    blocks = F.broadcast(blocks) if n_blocks == 1 else blocks.hint("shuffle_hash")
    found = own.join(blocks, (F.col("own_cell") == F.col("cell")) & met)
    return found.select(*_PAIR, *[s.alias(name) for name, s in sums.items()])


def _sums_of_bits(digits: list[str]) -> dict[str, Column]:
    """``co_rated_sums`` by name: ``a`` and ``b`` are halves in binary, of which every digit is a number with a bit per movie."""
    both = F.col("word").bitwiseAND(F.col("target_word"))
    place = [int(d[1:]) for d in digits]
    a, b = [F.col(f"target_{d}") for d in digits], [F.col(d) for d in digits]
    differ = [x.bitwiseXOR(y).bitwiseAND(both) for x, y in zip(a, b, strict=True)]

    def total(terms, unit: float) -> Column:
        # Pairs of place and number: the bits of the number count 2 ** place each.
        # In doubles, which are exact here: whole numbers are tested for overflow at every step.
        return reduce(add, [F.bit_count(bits).cast("double") * F.lit(unit * (sign << at)) for at, sign, bits in terms], F.lit(0.0))

    def squared(own: list[Column], of: Column) -> Column:
        return total(
            [
                ((at := place[i] + place[j] + (i != j)), 1, own[i].bitwiseAND(own[j]).bitwiseAND(of) if i != j else own[i].bitwiseAND(of))
                for i in range(len(own)) for j in range(i, len(own))
            ],
            0.25,
        )

    # Where the target's rating is the larger one, by the highest digit that differs.
    larger = F.lit(0).cast("bigint")
    for x, d in zip(a, differ, strict=True):
        larger = larger.bitwiseAND(F.bitwise_not(d)).bitwiseOR(x.bitwiseAND(d))
    apart = [(p, s, d if s == 1 else d.bitwiseAND(x.bitwiseXOR(larger))) for p, x, d in zip(place, a, differ, strict=True) for s in (1, -2)]
    # (sum of digits) ** 2, where two digits that differ the same way add up and others cancel.
    crossed = []
    for i in range(len(a)):
        crossed.append((2 * place[i], 1, differ[i]))
        for j in range(i):
            meet, at = differ[i].bitwiseAND(differ[j]), place[i] + place[j] + 1
            crossed += [(at, 1, meet), (at, -2, meet.bitwiseAND(a[i].bitwiseXOR(a[j])))]
    return {
        "n_common": F.bit_count(both),
        "sum_a": total([(p, 1, x.bitwiseAND(F.col("word"))) for p, x in zip(place, a, strict=True)], 0.5),
        "sum_b": total([(p, 1, y.bitwiseAND(F.col("target_word"))) for p, y in zip(place, b, strict=True)], 0.5),
        "sum_ab": total([(p + q, 1, x.bitwiseAND(y)) for p, x in zip(place, a, strict=True) for q, y in zip(place, b, strict=True)], 0.25),
        "sum_aa": squared(a, F.col("word")),
        "sum_bb": squared(b, F.col("target_word")),
        "sum_abs": total(apart, 0.5),
        "sum_sq": total(crossed, 0.25),
    }


def _least_sums_of_bits(digits: list[str]) -> dict[str, Column]:
    """Numbers that ``sum_abs`` and ``sum_sq`` are not below, from the two highest digits of each difference."""
    both, below = F.col("word").bitwiseAND(F.col("target_word")), F.lit(0).cast("bigint")
    apart = []
    for d in digits:
        # Target minus user, digit by digit; ``below`` is borrowed from the next.
        differ = F.col(d).bitwiseXOR(F.col(f"target_{d}"))
        apart.append(differ.bitwiseXOR(below))
        below = differ.bitwiseAND(F.col(d)).bitwiseOR(below.bitwiseAND(F.bitwise_not(differ)))
    # A difference below zero, turned round, is one more than its digits then say.
    top = [(int(d[1:]), x.bitwiseXOR(below)) for d, x in zip(digits, apart, strict=True)][-2:]
    # At least the value of the lower one where there is any of them, and of the higher one where that is.
    values = [(2**p / 2, reduce(Column.bitwiseOR, [x for _, x in top[i:]]).bitwiseAND(both)) for i, (p, _) in enumerate(top)]

    def least(power: int) -> Column:
        steps = zip(values, [0.0] + [v for v, _ in values], strict=False)
        return reduce(add, [F.bit_count(x).cast("double") * F.lit(v**power - w**power) for (v, x), w in steps], F.lit(0.0))

    return {"sum_abs": least(1), "sum_sq": least(2)}


def _sums_of_ratings(kept: list[str]) -> dict[str, Column]:
    """``co_rated_sums`` by name, of ratings by place that are null where not rated."""

    def total(value) -> Column:
        # Columns, as functions over arrays take several times as long.
        return reduce(add, [F.coalesce(value(F.col(f"target_{c}"), F.col(c)), F.lit(0.0)) for c in kept])

    return {
        "n_common": F.bit_count(F.col("word").bitwiseAND(F.col("target_word"))),
        "sum_a": total(lambda a, b: F.when(b.isNotNull(), a)),
        "sum_b": total(lambda a, b: F.when(a.isNotNull(), b)),
        "sum_ab": total(lambda a, b: a * b),
        "sum_aa": total(lambda a, b: F.when(b.isNotNull(), a * a)),
        "sum_bb": total(lambda a, b: F.when(a.isNotNull(), b * b)),
        "sum_abs": total(lambda a, b: F.abs(a - b)),
        "sum_sq": total(lambda a, b: (a - b) * (a - b)),
    }
