"""A Merkle tree over documents: built level by level as parent-linked node rows, climbed by a recursive query."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from coratings.llm.staging import BROADCAST_TEXT_ROWS, cut, sized

STRIDE = 8  # tree levels between two stored levels; a stored node holds its siblings up to the next one
ROWS = 500_000  # leaves that a task numbers
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # the tree over the subroots


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: dict[str, Column]) -> Column:
    """Binary sha256 of the fields of a row."""
    return F.unhex(F.sha2(F.concat(*[field(values[c]) for c in FIELDS]), 256))


def tampered_chars() -> Column:
    """n_chars, plus 1 where 7 divides the crc32 of the decimal doc_id."""
    chosen = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    return F.when(chosen, more).otherwise(F.col("n_chars").cast("string"))


def _numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """A written ``rows`` in ``order``, a total one, numbered from 0 by as many tasks as it takes."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    placed = cut(
        rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        .withColumns({"__place": F.monotonically_increasing_id(), "__part": F.spark_partition_id()})
    )
    # One row per task of the step above.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy("__part").agg(F.min("__place").alias("__low"), F.count("*").alias("n")).select(
        "__part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("__low")).alias("__shift")
    )
    return placed.join(F.broadcast(shift), "__part").withColumn(name, F.col("__place") + F.col("__shift")).drop("__part", "__place", "__shift")


# Parent of two sibling digests (binary); a node without a sibling is hashed alone.
_PAIR = "unhex(sha2(concat(lower(hex({0})), coalesce(lower(hex({1})), '')), 256))"
_LEVELS = f"""aggregate(CASE WHEN height > 0 THEN sequence(1, height) ELSE CAST(array() AS array<int>) END, array(transform(row, x -> x.hash)),
  (levels, k) -> concat(levels, array(transform(sequence(0, size(element_at(levels, -1)) - 1, 2),
    i -> {_PAIR.format('element_at(levels, -1)[i]', 'get(element_at(levels, -1), i + 1)')}))))"""
_NODES = """transform(levels[0], (hash, j) -> named_struct('pos', block * {width} + j, 'hash', hash,
  'up', transform(CASE WHEN height > 0 THEN sequence(0, height - 1) ELSE CAST(array() AS array<int>) END, k -> get(levels[k], shiftright(j, k) ^ 1))))"""


def _one_level(nodes: DataFrame, level: int, stride: int, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """(node rows of a stored level, nodes of the next stored level) from ``tree, pos, hash, n`` with further columns ``more``.

    A block of 2 ** stride nodes is one row while its part of the tree is
    built, so no task holds more than that at once.
    """
    width = 1 << stride
    carried = ", ".join(["pos", "hash", *more])
    height = f"int(least({stride}, CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END))"
    blocks = (
        nodes.groupBy("tree", "n", F.expr(f"shiftright(pos, {stride})").alias("block"))
        .agg(F.sort_array(F.collect_list(F.expr(f"struct({carried})"))).alias("row"))
        .withColumn("height", F.expr(height))
        .withColumn("levels", F.expr(_LEVELS))
    )
    fields = [f"row[j].{c} AS {c}" for c in more]
    extra = _NODES.format(width=width)
    if more:  # what a leaf row carries beside its digest
        extra = f"transform({extra}, (x, j) -> struct(x.pos, x.hash, x.up, {', '.join(fields)}))"
    built = cut(
        blocks.select(
            "tree", "n", "block", F.expr("levels[height][0]").alias("top"), F.expr(extra).alias("nodes")
        )
    )
    is_top = (F.col("n") <= width) & (F.col("tree") == TOP)
    last = F.col("n") <= width
    rows = built.select("tree", "block", "n", F.explode("nodes").alias("x")).select(
        "tree", F.lit(level).alias("level"), "x.*",
        F.when(~is_top, F.when(last, F.lit(TOP).cast("long")).otherwise(F.col("tree"))).alias("parent_tree"),
        F.when(~is_top, F.when(last, F.lit(0)).otherwise(F.lit(level + stride))).alias("parent_level"),
        F.when(~is_top, F.when(last, F.col("tree")).otherwise(F.col("block"))).alias("parent_pos"),
    )
    tops = built.select("tree", F.col("block").alias("pos"), F.col("top").alias("hash"), F.ceil(F.col("n") / width).alias("n"), last.alias("done"))
    return rows, tops


def _grown(leaves: DataFrame, stride: int, more: list[str]) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(rows of level 0, rows of each further stored level, root of each tree) of ``tree, pos, hash, n``."""
    rows, tops = _one_level(leaves, 0, stride, more)
    first, above, roots, level = rows, [], tops.where("done"), stride
    while not (open_ := tops.where("NOT done")).isEmpty():
        rows, tops = _one_level(open_.drop("done"), level, stride, [])
        above.append(rows)
        roots = roots.union(tops.where("done"))
        level += stride
    return first, above, roots.select("tree", "hash")


def merkle_nodes(docs: DataFrame, stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """(leaf rows, node rows above them) of the tree over ``docs``.

    Both have tree, level, pos, hash, up, parent_tree, parent_level and
    parent_pos. ``up`` holds a node's siblings, level by level, up to the
    parent, which lies ``stride`` levels above, or fewer where its tree ends; a
    null there means that the node is alone in its run. Each lang is a tree, numbered in the
    order of langs, whose root's parent is in the tree ``TOP`` over them. The root
    has no parent; its digest is the fold of any row of the last stored level.
    Leaf rows carry doc_id and, as ``tampered``, the digest after tampering.
    """
    values = {c: F.col(c) for c in FIELDS}
    leaves = cut(
        docs.select(
            "doc_id", "lang", leaf_hash(values).alias("hash"), leaf_hash(values | {"n_chars": tampered_chars()}).alias("tampered"),
            F.monotonically_increasing_id().alias("__row"),
        )
    )
    # The row number only tells equal rows apart, so that they need not go to one task.
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), "hash", "__row"]
    leaves = cut(_numbered(leaves, order, "at").drop("__row"))
    langs = cut(leaves.groupBy("lang").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    langs = cut(_numbered(langs, ["first"], "tree"))
    small = sized(langs.select(F.col("lang").alias("__lang"), "first", "n", "tree"), BROADCAST_TEXT_ROWS)
    placed = leaves.join(small, F.col("lang").eqNullSafe(F.col("__lang"))).select(
        "tree", (F.col("at") - F.col("first")).alias("pos"), "hash", "n", "doc_id", "tampered"
    )
    first, above, subroots = _grown(placed, stride, ["doc_id", "tampered"])
    count = langs.count()
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "hash", F.lit(count).cast("long").alias("n"))
    top_first, top_above, _ = _grown(top, stride, [])
    nodes = top_first
    for rows in [*above, *top_above]:
        nodes = nodes.union(rows)
    return first, nodes


@contextmanager
def _no_row_limit(spark: SparkSession) -> Iterator[None]:
    """Recursive queries may return any number of rows while they are written."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


_FOLD = """aggregate(transform({up}, (s, k) -> named_struct('s', lower(hex(s)), 'odd', shiftright({pos}, k) & 1)), {start},
  (h, x) -> unhex(sha2(concat(IF(x.odd = 1, x.s, ''), lower(hex(h)), IF(x.odd = 0, coalesce(x.s, ''), '')), 256)))"""
_CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT doc_id, hash, home, parent_tree, parent_level, parent_pos, folded, path FROM (
    SELECT doc_id, hash, tree AS home, parent_tree, parent_level, parent_pos,
      {_FOLD.format(up='up', pos='pos', start='tampered')} AS folded, up AS path FROM {{leaves}})
  UNION ALL
  SELECT c.doc_id, c.hash, c.home, n.parent_tree, n.parent_level, n.parent_pos,
    {_FOLD.format(up='n.up', pos='n.pos', start='c.folded')}, concat(c.path, n.up)
  FROM climb c JOIN {{nodes}} n ON c.parent_tree = n.tree AND c.parent_level = n.level AND c.parent_pos = n.pos)
SELECT doc_id, hash, home, folded, path FROM climb WHERE parent_tree IS NULL"""


def climbed(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, hash, home, folded and path per leaf row: a recursive query ascends from stored level to stored level,
    appends the siblings to ``path`` and folds the tampered digest with them. Runs the query."""
    spark = leaves.sparkSession
    query = spark.sql(_CLIMB, leaves=leaves, nodes=cut(nodes.select("tree", "level", "pos", "up", "parent_tree", "parent_level", "parent_pos")))
    with _no_row_limit(spark):
        return cut(query)


def merkle_manifest(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified per row of ``docs``.

    Within a lang leaves ascend by doc_id, null first; rows that share a doc_id
    by their digest. Null fields count as ``-``. Repeated rows are leaves of
    their own with equal digests. Text of any length is hashed where it lies and
    goes no further. Other columns of ``docs`` play no part. Empty input: no rows.
    """
    leaves, nodes = merkle_nodes(docs, stride)
    if leaves.isEmpty():
        return docs.sparkSession.createDataFrame([], "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").select(
            F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "*"
        )
    nodes = cut(nodes)
    up = climbed(leaves, nodes)
    text = lambda c: F.lower(F.hex(c))
    last = nodes.where("parent_tree IS NULL").limit(1).select(F.expr(f"lower(hex({_FOLD.format(up='up', pos='pos', start='hash')}))")).first()[0]
    subroots = nodes.where((F.col("tree") == TOP) & (F.col("level") == 0)).select(F.col("pos").alias("home"), text("hash").alias("subroot"))
    proof = F.array_join(F.transform(F.col("path"), lambda s: F.coalesce(text(s), F.lit(""))), "")
    return up.join(sized(cut(subroots), BROADCAST_TEXT_ROWS), "home").select(
        "doc_id", text("hash").alias("leaf"), "subroot", F.lit(last).alias("root"), F.sha2(proof, 256).alias("proof_sha256"),
        text("folded").alias("folded_root"), (text("folded") == F.lit(last)).alias("verified"),
    )


def merkle_sql() -> str:
    """The same rows in DuckDB's SQL, on the documents table: every level of the tree, one level a step."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    row = lambda chars: "sha256(" + " || ".join(part(chars if c == "n_chars" else c) for c in FIELDS) + ")"
    # crc32 bit by bit: the reversed polynomial 0xEDB88320.
    bits = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits}), 4294967295)"

    def tree(name: str, source: str) -> str:
        return f"""
{name} AS (
  SELECT tree, 0 AS level, pos, h, n FROM {source}
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2, n)"""

    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, {row('n_chars')} AS leaf, {row('changed')} AS tampered, lang FROM (
    SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN n_chars::HUGEINT + 1 ELSE n_chars END AS changed FROM documents)),
placed AS (
  SELECT row_number() OVER () AS rid, doc_id, leaf, tampered, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
{tree('under', 'placed')},
subroots AS (SELECT -1 AS tree, tree AS pos, h, (SELECT count(DISTINCT tree) FROM placed) AS n FROM under WHERE n = 1),
{tree('above', 'subroots')},
nodes AS (
  SELECT tree, level, pos, h, n, (n = 1 AND tree >= 0) AS leads FROM under UNION ALL SELECT tree, level, pos, h, n, false FROM above),
steps AS (
  SELECT a.tree, a.level, a.pos, CASE WHEN a.leads THEN NULL ELSE b.h END AS sibling, a.leads, a.n FROM nodes a
  LEFT JOIN nodes b ON b.tree = a.tree AND b.level = a.level AND b.pos = xor(a.pos, 1)),
climb AS (
  SELECT rid, tree, 0 AS level, pos, tampered AS folded, '' AS path, 0 AS stage FROM placed
  UNION ALL
  SELECT c.rid, CASE WHEN s.leads THEN -1 ELSE c.tree END, CASE WHEN s.leads THEN 0 ELSE c.level + 1 END,
    CASE WHEN s.leads THEN c.tree ELSE c.pos // 2 END,
    CASE WHEN s.leads THEN c.folded WHEN c.pos % 2 = 1 THEN sha256(s.sibling || c.folded) ELSE sha256(c.folded || coalesce(s.sibling, '')) END,
    c.path || coalesce(s.sibling, ''), c.stage + s.leads::INTEGER
  FROM climb c JOIN steps s ON s.tree = c.tree AND s.level = c.level AND s.pos = c.pos AND (s.leads OR s.n > 1)),
ends AS (SELECT rid, max_by(folded, stage * 1000 + level) AS folded, max_by(path, stage * 1000 + level) AS path FROM climb GROUP BY rid)
SELECT doc_id, leaf, s.h AS subroot, a.h AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = a.h AS verified
FROM placed p JOIN ends USING (rid) JOIN subroots s ON s.pos = p.tree, (SELECT h FROM above WHERE n = 1) a
"""
