"""The physical plans that large data depends on."""

import contextlib
import io

import pytest

from parley.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    """The plan before adaptive changes, with broadcasts off as for large inputs."""
    text = io.StringIO()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with contextlib.redirect_stdout(text):
            QUERIES[name](spark, FOLDER).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return text.getvalue()


def test_stats_combine_before_their_only_shuffle(spark):
    text = plan(spark, "user_stats")
    assert text.count("Exchange ") == 1 and text.count("HashAggregate") == 2
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


@pytest.mark.parametrize(
    "name",
    ["split_texts", "split_once", "route_commands", "removal_reactions", "chunk_texts",
     "last_separators", "parse_param_commands"],
)
def test_row_wise_jobs_do_not_shuffle_their_rows(spark, name):
    """Only the table of command words is grouped, before it is broadcast."""
    text = plan(spark, name)
    shuffled = [line for line in text.splitlines() if "hashpartitioning" in line and "hashpartitioning(cmd#" not in line]
    assert not shuffled and "rangepartitioning" not in text and "SortMergeJoin" not in text


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_type), IsNotNull(value)" in plan(spark, "user_histories")
    assert "event_type,error" in plan(spark, "clear_messages")


def test_searches_do_not_read_texts(spark):
    scans = [line for line in plan(spark, "next_positions").splitlines() if "ReadSchema" in line]
    assert scans and not any("text" in line.split("ReadSchema")[1] for line in scans)


def test_closing_gaps_never_sorts_the_messages_by_user(spark):
    """The join goes by user and block of positions, so a long history is spread."""
    text = plan(spark, "delete_messages")
    with_texts = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "block" in line]
    assert with_texts
    assert not any("Window" in line and "message#" in line for line in text.splitlines())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_products(spark, name):
    if "stream" in name or "snapshot" in name or "store" in name:
        pytest.skip("runs a stream or write to build its plan")
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_routing_moves_no_event_and_its_filter_repeats_nothing(spark):
    from parley.operators.routing import check_permissions, route_commands
    from parley.plans import inputs
    from parley.sources.settings import admins_table, commands_table

    events = inputs.chat_events(inputs.table(spark, "/root/testdata/sf0.001", "events"))
    commands, admins = commands_table(spark), admins_table(spark, inputs.ADMINS)
    allowed = check_permissions(route_commands(events, commands), commands, admins)
    for found in (allowed, allowed.filter("route = 'command'")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("CASE WHEN") < 40
        physical = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in physical and physical.count("BroadcastHashJoin") == 3
