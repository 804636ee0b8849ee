import hashlib
import zlib

import pytest
from coratings.llm import merkle
from coratings.llm.merkle import merkle_manifest, merkle_nodes, merkle_sql
from oracle import assert_same

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, root string, tree int, pos string, hash string, n int"


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def grown(level):
    """(root, per leaf its siblings as (digest, on the left) or None) of a list of digests."""
    paths, places = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for leaf, at in enumerate(places):
            other = at ^ 1
            paths[leaf].append((level[other], other < at) if other < len(level) else None)
        level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
        places = [p // 2 for p in places]
    return level[0], paths


def expected(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda doc, source, lang, n, text: digest(*map(part, (doc, source, lang, n, text)))
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row[:5])
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        members = sorted(((row, leaf(*row)) for row in by_lang[lang]), key=lambda m: (m[0][0] is not None, m[0][0] or 0, m[1]))
        trees.append((members, *grown([h for _, h in members])))
    root, above = grown([subroot for _, subroot, _ in trees])
    out = []
    for (members, subroot, paths), upper in zip(trees, above, strict=True):
        for (row, h), path in zip(members, paths, strict=True):
            doc, source, lang, n, text = row
            moved = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n is not None
            folded = leaf(doc, source, lang, n + moved if n is not None else None, text)
            for step in path + upper:
                folded = digest(folded) if step is None else digest(step[0], folded) if step[1] else digest(folded, step[0])
            proof = digest(*[step[0] for step in path + upper if step])
            out.append((doc, h, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


ROWS = [
    *[(d, f"s{d % 3}", "en", 10 * d, f"text é {d}") for d in range(37)],
    *[(d, None, "fr", None if d % 2 else d, "中文 " * d) for d in range(40, 43)],
    (3, "s", "en", 1, "same id"), (3, "s", "en", 1, "same id"), (None, "s", "en", 1, None), (None, "s", "en", 1, ""),
    (50, "s", None, 5, "no lang"), (7, "s", "-", 5, "long " * 400_000), (51, "s", "zé", 9223372036854775807, " "), (8, "", "", 0, ""),
]


def got(docs, stride):
    return sorted((tuple(r) for r in merkle_manifest(docs, stride).collect()), key=str)


@pytest.mark.parametrize("stride", [1, 2, 8])
def test_rows(spark, stride):
    docs = spark.createDataFrame([(*r, "x", 1, "x", "x", 1) for r in ROWS], COLUMNS).repartition(3)
    want = expected(ROWS)
    assert got(docs, stride) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_one_leaf_and_none(spark):
    one = [(5, None, None, None, None)]
    assert got(spark.createDataFrame([(*r, "x", 1, "x", "x", 1) for r in one], COLUMNS), 2) == expected(one)
    assert got(spark.createDataFrame([], COLUMNS), 2) == []


def test_many_equal_rows_and_langs(spark):
    rows = [(1, "s", "en", 1, "copy")] * 500 + [(d, "s", f"l{d}", d, "") for d in range(70)]
    docs = spark.createDataFrame([(*r, "x", 1, "x", "x", 1) for r in rows], COLUMNS)
    assert got(docs, 3) == expected(rows)


def test_stored_nodes(spark):
    """Every row but the root's has a parent among the stored rows, and no row holds more than its siblings on the way there."""
    docs = spark.createDataFrame([(*r, "x", 1, "x", "x", 1) for r in ROWS], COLUMNS)
    leaves, nodes = merkle_nodes(docs, 2)
    nodes = [r.asDict() for r in nodes.collect()]
    stored = {(r["tree"], r["level"], r["pos"]) for r in nodes}
    rows = nodes + [r.asDict() for r in leaves.collect()]
    assert len(rows) - len(nodes) == len(ROWS)
    assert all(r["parent_tree"] is None or (r["parent_tree"], r["parent_level"], r["parent_pos"]) in stored for r in rows)
    assert all(len(r["up"]) <= 2 for r in rows) and {r["level"] for r in rows if r["tree"] >= 0} == {0, 2, 4}


def test_row_limit_is_put_back(spark, monkeypatch):
    name, docs = "spark.sql.cteRecursionRowLimit", spark.createDataFrame([(*r, "x", 1, "x", "x", 1) for r in ROWS], COLUMNS)
    spark.conf.set(name, "5")
    monkeypatch.setattr(merkle, "ROWS", 10)
    try:
        assert got(docs, 4) == expected(ROWS)
        assert spark.conf.get(name) == "5"
    finally:
        spark.conf.unset(name)


def test_test_tables(spark, sf_small):
    assert assert_same(merkle_manifest(spark.read.parquet(f"{sf_small}/documents.parquet"), 3), merkle_sql(), sf_small) > 0
