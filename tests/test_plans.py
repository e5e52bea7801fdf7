"""Plan checks: native operators stay in the JVM, scans prune and push down."""

import __spark_entry__ as E


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = ["normalize_whitespace", "search_pairs", "delete_pair", "top_terms", "tfidf_weights",
          "html_body_slice", "suffix_lookup", "table_to_graph", "conversation_text", "cosine_pair"]


def test_native_operators_have_no_python(spark, sf):
    qs = E.queries()
    for name in NATIVE:
        plan = _plan(qs[name](spark, sf))
        for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonMapInArrow", "FlatMapGroupsInPandas"):
            assert node not in plan, (name, node)


def test_scan_prunes_columns_and_pushes_filters(spark, sf):
    plan = _plan(E.queries()["user_questions"](spark, sf))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in plan
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan
    plan = _plan(E.queries()["path_keys"](spark, sf))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan  # the html column is never read


def test_knn_limits_before_the_shuffle(spark, sf):
    plan = _plan(E.queries()["knn_l2"](spark, sf))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_conversation_windows_are_bucketed(spark, sf):
    import re
    for name in ("search_pairs", "delete_pair"):
        plan = _plan(E.queries()[name](spark, sf))
        for spec in re.findall(r"windowspecdefinition\(([^)]*)\)", plan):
            # every window over messages is partitioned by (session, bucket)
            if "session_id" in spec and "__b" not in spec and "turn" in spec:
                raise AssertionError((name, spec))


def test_no_cartesian_joins(spark, sf):
    skip = {"kmeans_topics", "knowledge_tree", "lda_topics", "project_2d", "evaluate_answers",
            "stream_retrieve", "stream_append_log", "stream_corpus_refresh"}
    for name, q in E.queries().items():
        if name in skip:
            continue
        plan = _plan(q(spark, sf))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
