"""The registry, and that results don't depend on how rows are dealt out."""

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_registry():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 90 and set(oracles) <= set(queries)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_same_rows_whatever_the_partitions(spark):
    queries = __spark_entry__.queries()
    for name in ("overview", "journal_fold", "capability_jaccard", "memory_hybrid_rrf", "turns_for_files_budget"):
        rows = []
        for n in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows.append(sorted(map(str, queries[name](spark, SF).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert rows[0] == rows[1], name
