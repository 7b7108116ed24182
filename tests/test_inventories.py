"""Workspace records, hierarchy and profile on hand-written rows."""

import json

import pytest

from lakeops.operators import hierarchy, workspaces
from lakeops.operators.profile import Inventory, is_member, metrics, profile, schema_counts
from lakeops.sources import workspaces as files

RAW = "name STRING, id STRING, workspaceUrl STRING, subscriptionId STRING, resourceGroup STRING"


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(
        [
            ("dev", "/1", "https://adb-12.3.net", "s1", "rg"),
            ("dev-2", "/2", None, "s2", "rg"),
            ("prod", "/3", "https://other.net", "s2", "rg-2"),
            ("blank", "/4", "", "s2", "rg-2"),
        ],
        RAW,
    ).selectExpr("*", "CAST(substring(id, 2) AS BIGINT) AS pos")


def test_url_without_id_drops_the_record_and_no_url_keeps_it(raw):
    rows = workspaces.normalise(raw, "t").collect()
    assert {(r.workspace_name, r.workspace_id, r.workspace_url) for r in rows} == {
        ("dev", "12", "https://adb-12.3.net"),
        ("dev-2", "", ""),
    }
    assert {(r.account_id, r.tenant_id) for r in rows} == {("", "t")}
    assert workspaces.normalise(raw, "t", keep_unmatched=True).count() == 4


def test_search_by_part_then_exactly(raw):
    assert workspaces.search(raw, "t", "dev").count() == 2
    assert workspaces.match_count(raw, "dev").first().match_count == 2
    exact = workspaces.search(raw, "t", "dev", exact="dev").first()
    assert (exact.azure_resource_id, exact.workspace_id) == ("/1", "https://12")
    assert workspaces.search(raw, "t", "prod").first().workspace_id == "https://other.net"
    assert workspaces.search(raw, "t", "none").count() == 0


def test_pages_are_concatenated_with_duplicates(spark, work):
    record = {name: name for name in files.RAW_FIELDS}
    for page in range(2):
        with open(f"{work}/{page}.json", "w") as out:
            json.dump([record, record], out)
    assert files.read_raw_pages(spark, work).count() == 4


def test_array_order_gives_positions(spark, work):
    for page, names in ((1, ["c", "d"]), (0, ["a", "b"])):
        with open(f"{work}/page-{page}.json", "w") as out:
            json.dump([{"subscription_id": n, "resource_group": "rg"} for n in names], out)
    records = files.read_records(spark, work)
    assert [r.subscription_id for r in records.orderBy("pos").collect()] == ["a", "b", "c", "d"]
    assert hierarchy.group_owners(records).first().subscription_id == "a"
    with open(f"{work}/page-2.json", "w") as out:
        out.write("[{")
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_records(spark, work).count()


def test_exports(spark, raw, work):
    records = workspaces.normalise(raw.filter("pos = 2"), "t,x")
    files.write_json(records, f"{work}/j")
    files.write_csv(records, f"{work}/c")
    read = spark.read.csv(f"{work}/c", header=True)
    assert read.columns == files.CSV_FIELDS and read.first().tenant_id == "t,x"
    assert set(files.RECORD_FIELDS) <= set(spark.read.json(f"{work}/j").columns)


@pytest.fixture
def records(spark):
    return spark.createDataFrame(
        [
            (2, "s-1", "rg", "w.b", "2", "t1"),
            (1, "s-2", "rg", "w.a", "1", "t0"),
            (3, "s-1", "other", "w.c", "3", "t1"),
            (4, "s-3", "rg", "w.d", "4", "t2"),
        ],
        "pos BIGINT, subscription_id STRING, resource_group STRING, workspace_name STRING, "
        "workspace_id STRING, tenant_id STRING",
    )


def test_first_subscription_owns_a_group(records):
    owners = {r.resource_group: r.subscription_id for r in hierarchy.group_owners(records).collect()}
    assert owners == {"rg": "s-2", "other": "s-1"}
    edges = {(r.parent_id, r.child_id) for r in hierarchy.edges(records).collect()}
    assert edges == {
        ("Tenant", "Sub_s_1"), ("Tenant", "Sub_s_2"), ("Tenant", "Sub_s_3"),
        ("Sub_s_2", "RG_rg"), ("Sub_s_1", "RG_other"),
        ("RG_rg", "WS_w_a"), ("RG_rg", "WS_w_b"), ("RG_other", "WS_w_c"), ("RG_rg", "WS_w_d"),
    }


def test_groups_may_be_kept_apart_by_subscription(records):
    edges = hierarchy.edges(records, by_subscription=True)
    pairs = {(r.parent_id, r.child_id) for r in edges.collect() if r.level == "resource_group"}
    assert pairs == {
        ("Sub_s_1", "RG_s_1_rg"), ("Sub_s_2", "RG_s_2_rg"), ("Sub_s_3", "RG_s_3_rg"),
        ("Sub_s_1", "RG_s_1_other"),
    }


def test_upper_levels_share_one_aggregate(spark, records, work):
    records.write.parquet(f"{work}/r")
    edges = hierarchy.edges(spark.read.parquet(f"{work}/r"))
    edges.collect()
    plan = edges._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and "SortAggregate" not in plan.split("ReusedExchange")[1]


def test_nodes_and_first_tenant(records):
    labels = [r.label for r in hierarchy.nodes(records).orderBy("pos", "level").collect()]
    assert "Tenant: t0" in labels and "Workspace: w.a (1)" in labels
    assert len(labels) == 1 + 3 + 2 + 4
    assert hierarchy.nodes(records.limit(0)).count() == 0


def test_look_alikes_are_found_and_told_apart(spark):
    rows = [
        (1, "a_b", "c", "w.x", "1", "t"),
        (2, "a", "b_c", "w-x", "2", "t"),
        (3, "a", "b.c", "w-x", "2", "t"),
        (4, "a.b", "c", "w-x", "3", "t"),
        (5, "z", "only", "own", None, "t"),
    ]
    records = spark.createDataFrame(
        rows,
        "pos BIGINT, subscription_id STRING, resource_group STRING, workspace_name STRING, "
        "workspace_id STRING, tenant_id STRING",
    )
    found = {(r.level, r.node_id): r.n_nodes for r in hierarchy.collisions(records).collect()}
    assert found == {
        ("subscription", "Sub_a_b"): 2, ("resource_group", "RG_b_c"): 2, ("workspace", "WS_w_x"): 3
    }
    groups = hierarchy.collisions(records, by_subscription=True).filter("level = 'resource_group'")
    assert [(r.node_id, r.n_nodes) for r in groups.collect()] == [("RG_a_b_c", 4)]
    nodes = hierarchy.nodes(records, by_subscription=True, told_apart=True)
    ids = {r.node_id for r in nodes.collect()}
    assert len(ids) == 1 + 4 + 5 + 4
    ends = hierarchy.edges(records, by_subscription=True, told_apart=True).collect()
    assert {e for r in ends for e in (r.parent_id, r.child_id)} == ids
    assert hierarchy.collisions(records.limit(0)).count() == 0


def test_members_come_in_order(records):
    members = hierarchy.group_workspaces(records).filter("resource_group = 'rg'").orderBy("pos")
    assert [(r.name, r.id) for r in members.collect()] == [("w.a", "1"), ("w.b", "2"), ("w.d", "4")]


def test_positions_follow_page_numbers_and_names(spark, work):
    import json

    pages = {
        "workspaces_20261201192148.json": ["p", "q"],
        "2026-12-01_page2.json": ["c"],
        "2026-12-01_page10.json": ["d", "e"],
        "2026-12-02_page2.json": ["c2"],
        "plain.json": ["a"],
    }
    for name, records in pages.items():
        with open(f"{work}/{name}", "w") as out:
            json.dump([{"name": r} for r in records], out)
    found = files.read_raw_pages(spark, work).orderBy("pos").collect()
    assert [r.name for r in found] == ["a", "c", "c2", "d", "e", "p", "q"]
    assert [r.pos for r in found] == list(range(7))


def inventory(spark, catalogs=(), schemas=(), groups=(), warehouses=(), shares=()):
    names = spark.createDataFrame([(n,) for n in shares], "name STRING")
    people = spark.createDataFrame([], "display_name STRING")
    return Inventory(
        catalogs=spark.createDataFrame(list(catalogs), "full_name STRING, securable_kind STRING"),
        schemas=spark.createDataFrame(list(schemas), "catalog_name STRING, schema_name STRING"),
        users=people,
        groups=spark.createDataFrame(list(groups), "display_name STRING, members ARRAY<STRING>"),
        service_principals=people,
        warehouses=spark.createDataFrame(
            list(warehouses), "name STRING, enable_serverless_compute BOOLEAN"
        ),
        shares=names,
        experiments=spark.createDataFrame([], "name STRING"),
    )


def test_empty_inventory(spark):
    row = profile(spark, inventory(spark)).first()
    flags = ["is_admin", "uses_serverless", "uses_catalogs", "uses_sharing", "uses_experiments"]
    assert not any(row[name] for name in flags) and None not in [row[n] for n in flags]
    assert (row.catalog_count, row.schema_count, row.user_count) == (0, 0, 0)
    assert (row.platform, row.workspace_url) == ("Unknown", "Not Available")


def test_system_catalogs_do_not_count_schemas(spark):
    listed = inventory(
        spark,
        catalogs=[("main", None), ("empty", "X_CATALOG_DELTASHARING_Y"), ("system", None), (None, None)],
        schemas=[("main", "a"), ("main", "b"), ("system", "c"), ("gone", "d")],
        warehouses=[("w", None), ("v", True)],
        groups=[("admins", ["me", None]), ("other", ["you"])],
    )
    counts = {r.full_name: r.schema_count for r in schema_counts(listed.catalogs, listed.schemas).collect()}
    assert counts == {"main": 2, "empty": 0}
    row = profile(spark, listed, user="me", host="adb-1.2.net").first()
    assert (row.catalog_count, row.schema_count, row.uses_sharing) == (4, 2, True)
    assert (row.uses_serverless, row.is_admin, row.platform) == (True, True, "adb-1")
    assert not profile(spark, listed, user="you").first().is_admin
    assert profile(spark, listed, account_id="").first().account_id == "Not Available"
    assert not is_member(listed.groups, None).first().is_member
    assert {r.metric: r.value for r in metrics(profile(spark, listed)).collect()}["group_count"] == "2"


def test_a_share_alone_means_sharing(spark):
    assert profile(spark, inventory(spark, shares=["s"])).first().uses_sharing
