"""Plan shape: the scan is pruned and detection itself adds no shuffle."""

from pyspark.sql import functions as F

from pseudoveil.functions import vocab as V
from pseudoveil.functions.spans import spans
from pseudoveil.operators import ner as N
from pseudoveil.operators.audit import ner_samples
from pseudoveil.operators.findings import resolve_overlaps
from pseudoveil.operators.mapping import empty_mapping
from pseudoveil.operators.redact import Config, detect_units, kept_findings, map_findings, redact_documents, split_by_findings
from pseudoveil.plans.fixtures import doc_units, pii_units
from pseudoveil.session import evened, spread
from pseudoveil.sources.units import paragraph_units


def test_detection_is_narrow_and_pruned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    det = detect_units(paragraph_units(docs.select("doc_id", "text")), ["doc_id", "unit_kind", "unit_no"],
                       Config(ner="capitalised"))
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = shown(det.where("size(findings) > 0"))
    assert plan.count("@[A-Za-z0-9.-]") == shown(det).count("@[A-Za-z0-9.-]")       # a filter above does not repeat the detectors
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "Exchange" not in plan


def test_detection_runs_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for config in (Config(), Config(ner="off", labelled_address=True), Config(propagate_names=True)):
        det = detect_units(paragraph_units(docs), ["doc_id", "unit_kind", "unit_no"], config)
        plan = det._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow"))


def test_rows_without_findings_meet_no_shuffle(spark):
    """With broadcasts off, the splice join shuffles only rows that the key filter lets through."""
    docs = spark.range(2000).selectExpr("id as doc_id", "case when id % 100 = 0 then concat('mail u', id, '@x.org') else repeat('plain ', 50) end as text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = redact_documents(docs, config=Config(ner="off")).output
        plan = out._jdf.queryExecution().executedPlan().toString()
        top = plan[plan.index("Union"):]
        parts = top.split("SortMergeJoin")
        assert "Exchange" not in parts[0].split("Subquery")[0] and len(parts) > 1
        rows = out.selectExpr("count(*) n", "count_if(text like '%example.net') edited").first()
        assert rows.n == 2000 and rows.edited == 20
        units = paragraph_units(docs)
        found = units.where("text like '%@%'").select(F.xxhash64("doc_id"))
        plain, edited = split_by_findings(docs, [F.col("doc_id")], found)
        assert plain.count() + edited.count() == 2000 and edited.count() < 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_samples_limit_each_group_before_the_shuffle(spark):
    scored = spark.createDataFrame([(1, "paragraph", 0, "PERSON", True, 5, "A B", 4)],
                                   "doc_id long, unit_kind string, unit_no int, label string, accepted boolean, start int, value string, score int")
    plan = ner_samples(scored)._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("WindowGroupLimit"):]
    assert "Partial" in final[final.index("Exchange"):].split("Scan")[0]           # below the shuffle


def test_hot_value_is_looked_up_in_many_tasks(spark):
    """One value on a third of the findings, broadcast and skew handling off: no task has much more than the others."""
    for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(k, v)
    try:
        kept = spark.range(48_000).selectExpr(
            "id as doc_id", "'paragraph' as unit_kind", "0 as unit_no", "'EMAIL' as pii_type",
            "case when id % 3 = 0 then 'hot@x.org' else concat('u', id % 5000, '@x.org') end as value", "cast(id as int) as start", "cast(id + 9 as int) as end")
        mapped, new = map_findings(kept, ["doc_id", "unit_kind", "unit_no"], empty_mapping(spark))
        sizes = sorted(r["count"] for r in mapped.groupBy(F.spark_partition_id()).count().collect())
        assert mapped.where("replacement is null").count() == 0 and mapped.select("replacement").distinct().count() == new.count()
        assert sum(sizes) == 48_000 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    finally:
        for k, v in (("spark.sql.autoBroadcastJoinThreshold", "10485760"), ("spark.sql.adaptive.enabled", "true"), ("spark.sql.shuffle.partitions", "8")):
            spark.conf.set(k, v)


def test_scores_are_not_repeated_by_what_reads_them(spark):
    """Neither the filter that Spark adds before an explode nor a join condition holds a copy of the scores."""
    shown = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    units = paragraph_units(docs.select("doc_id", "text"))
    key = ["doc_id", "unit_kind", "unit_no"]
    scored = N.score_units(units.select(*key, "text", N.capitalised_run_candidates(F.col("text")).alias("cands")), key, out_col="s")
    once = shown(scored).count(V.SHAPE_REJECT_REASON)
    assert once and shown(scored.select(*key, F.explode("s").alias("x"))).count(V.SHAPE_REJECT_REASON) == once
    det = detect_units(units, key, Config(ner="off"))
    folds = shown(kept_findings(det, key, [], None)).count("occupied")
    assert folds == shown(det.select(resolve_overlaps(F.col("findings")).alias("kept"))).count("occupied")


def test_short_rows_are_spread_over_the_cores(spark, tmp_path):
    """One row group of short rows: the work on them takes all cores."""
    spark.range(40_000).selectExpr("id as c_custkey", "0 as c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "INDIA")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    sizes = [r["count"] for r in pii_units(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and len(sizes) == min(20, max(spark.sparkContext.defaultParallelism, 2)) and max(sizes) < 2 * min(sizes)
    assert spread(spark.range(0)).count() == 0 and spread(spark.range(5)).rdd.getNumPartitions() == 1


def test_documents_in_one_row_group_are_spread(spark, tmp_path):
    """Rows that come as one task are dealt over the cores; rows in small tasks stay where they are."""
    one = spark.range(30_000).coalesce(1)
    sizes = [r["count"] for r in evened(one, 10_000).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) > 1 and max(sizes) <= 20_000
    assert evened(one) is one and evened(spark.range(0)).count() == 0
    rows = [(1, "a\n\nbb"), (1, "a\n\nbb"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(doc_units(spark, str(tmp_path)).collect(), key=str)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert got == sorted(paragraph_units(docs).drop("unit_offset").collect(), key=str) and len(got) == 7


def test_candidates_cost_no_more_than_they_need(spark, tmp_path):
    """Units without offsets fold nothing; a candidate's lower-case form and word lists are evaluated once."""
    shown = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.createDataFrame([(1, "A b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    units = doc_units(spark, str(tmp_path))
    assert "aggregate(" not in shown(units)
    cands = shown(units.select(N.capitalised_run_candidates(F.col("text")).alias("c")))
    assert cands.count("replace(") <= 20                    # the ten full folds, once (19 times before) and the spans
    marks = shown(units.select(spans(F.col("text"), "[A-Z]b").alias("s")))
    assert marks.count("instr(") <= 1
    scored = shown(N.score_units(units.select("doc_id", "text", N.capitalised_run_candidates(F.col("text")).alias("cands")), ["doc_id"]))
    assert "arrays_overlap" not in scored and "array_intersect" not in scored
