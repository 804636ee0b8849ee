"""Movies of users as bitmaps: overlaps counted without a row per common movie."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from coratings.plans.staging import among, sized, stored

# Bitmaps that one task sorts, 32 MB. Sizes of shuffled bitmaps tell little, as
# they are compressed there, so their partitions are counted in rows.
TASK_BITMAPS = 8_192


def movie_bitmaps(ratings: DataFrame) -> DataFrame:
    """``user_id, bucket, movies``: a bitmap of 32,768 movie ids per bucket that
    a user has rated any of. Store it to count many overlaps."""
    # Positions are brought together first: bitmaps made before the shuffle
    # would be 4 kB for each task that a user's movies of a bucket lie in.
    movie = F.col("movie_id")
    positions = ratings.select(
        "user_id", F.bitmap_bucket_number(movie).alias("bucket"), F.bitmap_bit_position(movie).alias("position")
    )
    return positions.repartition("user_id", "bucket").groupBy("user_id", "bucket").agg(
        F.bitmap_construct_agg("position").alias("movies")
    )


def common_counts(bitmaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """``user_a, user_b, n_common, intersects`` of every distinct pair, from
    ``movie_bitmaps``: their bitmaps of a bucket are intersected and counted.

    What is shuffled is each bitmap once and, for a pair and bucket that both
    have rated in, the bitmap (4 kB) of one of them to that of the other, however many
    movies they share. Pays where users have more
    than some hundred movies a bucket; sparse users are cheaper by
    ``pair_report``. A pair of one user counts all its movies, and no bitmap is moved for it; without
    common movies, or with an unknown user, the count is 0. A task sorts about
    ``TASK_BITMAPS`` bitmaps, however many there are. Runs jobs, and reads ``bitmaps`` twice.
    """
    pairs = stored(pairs.select("user_a", "user_b").distinct())
    members = pairs.select(F.explode(F.array("user_a", "user_b")).alias("user_id")).distinct()
    theirs = among(bitmaps, stored(members), "user_id")
    # Buckets first: only those that both members have take a bitmap along.
    sizes = stored(theirs.select("user_id", "bucket", F.bitmap_count("movies").alias("n")))
    of_a, of_b = sizes.withColumnRenamed("user_id", "user_a"), sizes.select(F.col("user_id").alias("user_b"), "bucket")
    shared = stored(pairs.join(sized(of_a), "user_a").join(sized(of_b), ["user_b", "bucket"]))
    alone = shared.where("user_a = user_b").select("user_a", "user_b", "n")
    two = shared.where("user_a <> user_b").select("user_a", "user_b", "bucket")
    # One number of partitions, so that both joins read one shuffle of the bitmaps.
    tasks = _tasks(sizes.count() + two.count())
    dealt = theirs.select("user_id", "bucket", "movies").repartition(tasks, "user_id", "bucket")
    of_a, of_b = (dealt.withColumnsRenamed({"user_id": f"user_{x}", "movies": f"movies_{x}"}).hint("merge") for x in "ab")
    met = (
        two.repartition(tasks, "user_b", "bucket")
        .join(of_b, ["user_b", "bucket"])
        .repartition(tasks, "user_a", "bucket")
        .join(of_a, ["user_a", "bucket"])
        .select("user_a", "user_b", "bucket", F.explode(F.array("movies_a", "movies_b")).alias("movies"))
        .groupBy("user_a", "user_b", "bucket")
        .agg(F.bitmap_count(F.bitmap_and_agg("movies")).alias("n"))
    )
    counts = alone.union(met.select("user_a", "user_b", "n")).groupBy("user_a", "user_b").agg(F.sum("n").alias("n_common"))
    return (
        pairs.join(counts, ["user_a", "user_b"], "left")
        .fillna(0, subset=["n_common"])
        .select("user_a", "user_b", "n_common", (F.col("n_common") > 0).alias("intersects"))
    )


def _tasks(bitmaps: int) -> int:
    return max(1, -(-bitmaps // TASK_BITMAPS))
