"""The line rule: lines of many documents go, depleted documents are rejected, and the rest of the text stays as it is."""

from pyspark.sql import functions as F

from chirplake.llm.line_rules import line_quality

WORDS = [f"w{k}" for k in range(2000)]


def own(k):
    return " ".join(WORDS[(k * 60 + j) % 2000] + f"x{k}" for j in range(60))


def test_common_lines_are_removed_and_depleted_documents_rejected(spark):
    footer, big = "All  Rights reserved 2024", " ".join(f"menu{k}" for k in range(80))
    rows = [(k, "h", f"{own(k)}\n{footer.upper() if k % 2 else footer}\n\n tail {k}a") for k in range(25)]  # normalised alike: case, digits, blanks
    rows += [(100 + k, "h", f"{big}\n{own(200 + k)}") for k in range(21)]  # over half is common
    rows += [(200 + k, "g", f"{own(300 + k)}\n{footer}") for k in range(20)]  # another host, at the limit
    rows += [(300, "h", f"{footer}\n{footer}\n{own(400)}"), (301, "h", None), (302, None, ""), (303, "h", "  \n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for c in ("content", "kept", "left", "_row", "docs", "h", "n", "nth"):
        df = df.withColumn(c, F.lit("mine"))
    out = {r.doc_id: r for r in line_quality(df.repartition(4), carry=["doc_id", "content", "kept", "_row", "docs", "h"], left="left").collect()}
    assert len(out) == len(rows) and set(next(iter(out.values())).asDict()) >= {"content", "_row", "docs", "h", "kept", "left"}
    for i, _, text in rows:
        r, lines = out[i], (text or "").split("\n")
        gone = [x for x in lines if i < 100 and x.lower() == footer.lower() or 100 <= i < 200 and x == big or i == 300 and x == footer]
        assert r.content == r._row == r.docs == r.h == "mine"
        assert r.removed_words == sum(len(x.split()) for x in gone)
        assert r.left == (None if text is None else "\n".join(x for x in lines if x not in gone))
        assert r.kept == (i < 100 or 200 <= i < 220 or i == 300) and r.base_failed == (i > 300)


def test_copies_are_documents(spark):
    df = spark.createDataFrame([(k, "h", own(1)) for k in range(21)] + [(50 + k, "h", own(2)) for k in range(20)], "doc_id long, source string, text string")
    out = {r.doc_id: r.kept for r in line_quality(df, carry=["doc_id"]).collect()}
    assert not any(out[k] for k in range(21)) and all(out[50 + k] for k in range(20))
