"""The hash tree against one built in plain Python, and its edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from chirplake.llm import merkle
from chirplake.llm.merkle import folded, leaf_hash, manifest, proof_nodes


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The root, and each leaf's siblings with the side that they stand on."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for proof, p in zip(proofs, at):
            proof.append((p % 2 == 1, level[p ^ 1] if p ^ 1 < len(level) else ""))
        level = [h("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], proofs


def expected(rows):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, lang, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = []
    for name in names:
        found = sorted(groups[name], key=lambda x: x[:3])
        made.append((found, *tree([x[2] for x in found])))
    root, over = tree([m[1] for m in made])
    return sorted(repr((x[3][0], x[2], m[1], root, p + o)) for m, o in zip(made, over) for x, p in zip(m[0], m[2]))


def found(df):
    out = manifest(df, group="lang", order=["doc_id"], leaf=leaf_hash(*[F.col(c) for c in ("doc_id", "lang", "text")]), carry=["doc_id", "leaf"])
    rows = out.withColumn("again", folded(F.col("leaf"), F.col("proof"))).withColumn("nodes", proof_nodes(F.col("proof"))).collect()
    assert all(r.again == r.root and r.nodes == "".join(s.node for s in r.proof) for r in rows)
    return sorted(repr((r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.node) for s in r.proof])) for r in rows)


@pytest.mark.parametrize("levels", [1, 2, 3, 10])
def test_equals_plain_tree(spark, monkeypatch, levels):
    """Groups of 1 to 40 rows over rounds of 2, 4, 8 and 1,024 leaves."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    sizes = {"a": 1, "b": 2, "cé": 3, None: 7, "": 8, "z": 17, "zz": 40 if levels > 1 else 9}
    rows = [(100 * k + j, g, f"text {j}") for k, (g, n) in enumerate(sizes.items()) for j in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("leaf", F.lit("mine")).repartition(3)
    assert found(df) == expected(rows)


def test_edges(spark):
    """Null ids, fields and groups, repeated ids and rows, a very long text, an empty table."""
    rows = [(None, "en", "x"), (None, None, None), (5, "en", None), (5, "en", "y"), (5, "en", "y"), (5, "en", "y"), (-3, "en", ""), (7, "日本", "naïve 日本 \U0001f600" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    assert found(df) == expected(rows)
    assert found(df.where("doc_id = 99")) == []


def test_tampered_leaf_is_seen(spark):
    rows = [(k, "en", f"t{k}") for k in range(11)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    seen = leaf_hash(F.col("doc_id"), F.col("lang"), F.when(F.col("doc_id") == 4, F.lit("other")).otherwise(F.col("text")))
    out = manifest(df.withColumn("seen", seen), group="lang", order=["doc_id"], leaf=leaf_hash(*[F.col(c) for c in df.columns]), carry=["doc_id", "seen"])
    assert {r.doc_id for r in out.where(folded(F.col("seen"), F.col("proof")) != F.col("root")).collect()} == {4}
