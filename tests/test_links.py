"""Links of texts that many mentions and many entries share."""

from pyspark.sql import functions as F

from marginalia.operators import linking


def test_shared_texts_are_ranked_once_not_in_pairs(spark):
    n = 3000
    kind = lambda c: F.element_at(F.array(F.lit("A"), F.lit(" "), F.lit(None).cast("string"), F.lit("B")), (F.col(c) % 4 + 1).cast("int"))
    entries = spark.range(n).select(F.col("id").alias("entry_id"), F.lit("Same  text").alias("term"), (F.col("id") / 2).cast("int").cast("string").alias("code"), kind("id").alias("label"))
    mentions = spark.range(n).select(F.col("id").alias("mention_id"), F.lit("same text").alias("text"), kind("id").alias("label"))
    # one mention has two rows, of other labels
    mentions = mentions.unionByName(spark.createDataFrame([(0, "same text", "B")], mentions.schema))
    found = linking.exact(mentions, entries, 5)
    got = {}
    for r in found.collect():
        got.setdefault(r.mention_id, []).append((r["rank"], r.code))

    def want(*labels):
        out = {}
        for i in range(n):
            e = ["A", "", "", "B"][i % 4]
            if any(not x or not e or x == e for x in labels):
                out.setdefault(str(i // 2), i)
        return [(k + 1, c) for k, (_, c) in enumerate(sorted((i, c) for c, i in out.items())[:5])]

    assert len(got) == n
    for i in range(n):
        assert sorted(got[i]) == want(["A", "", "", "B"][i % 4], *(["B"] if i == 0 else [])), i
    # no operator made a row for each pair (n * n = 9 million): the joins' rows are counted by the plan
    rows = []

    def visit(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return visit(node.plan())
        m = node.metrics()
        if m.contains("numOutputRows"):
            rows.append(m.apply("numOutputRows").value())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(found._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 10 * n
