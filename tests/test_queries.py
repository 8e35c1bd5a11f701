"""Registered queries: oracles on the smallest data, and the shape of the physical plans."""

import os

import pytest

from oracle import compare, duck
from plotline.plans import catalogue

SF = "/root/testdata/sf0.001"
QUICK = """
fixture_tx p2_computed_columns p3_display_rows p4_coords_db f2_filter_settings f4_computed_ratio f8_special_notes w1_address_count
o1_order_by_count a1_result_summary a2_community_summaries a3_price_trend_quarterly a3_price_trend_look_back a5_community_catalogue
a6_community_info a9_coverage a11_outcome_counts a14_cache_stats a17_map_groups a19_group_profile a22_address_ranges z1_standardise
n9_parse_address n10_parse_query e1_merge_and_enrich e3_outcomes j2_backfill_community s1_registry_csv s2_generic_csv s3_api_rows
r7_structured_filtered r10_phrase_index j3_w4_point_lookup j5_geocode j7_upgrade_roads j8_address_to_community j11_overlap_names
j12_sibling_numbers j19_best_item_by_address j20_title_items k2_incremental_upsert k4_insert_or_ignore r1_floor_and_sub_number r11_batch_search r12_shortened_search k5_j6_write_back u1_merge_paths t2_stream_unique t4_stream_trend
""".split()
# ORACLE_ALL=1 runs every query that has an oracle.
NAMES = list(catalogue.ORACLES) if os.environ.get("ORACLE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    ok, text = compare(spark, con, name, SF)
    assert ok, text


PLANNED = """
a17_map_groups e1_merge_and_enrich j3_w4_point_lookup j8_address_to_community j10_o4_fuzzy_names j11_overlap_names j12_sibling_numbers
j19_best_item_by_address r7_structured_cascade r8_variant_search r10_phrase_index z1_standardise a3_price_trend_monthly w1_address_count
""".split()


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_product_and_no_python(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, bad


def test_top_n_is_cut_before_the_shuffle(spark):
    plan = catalogue.QUERIES["f6_community_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters_and_columns_reach_the_file(spark, tmp_path):
    from plotline.operators import report
    from plotline.plans.fixture import frame

    path = str(tmp_path / "tx")
    frame(spark, SF, "tx_addr").write.parquet(path)
    tx = spark.read.parquet(path)
    plan = report.community_centroids(tx)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "IsNotNull(community_name)" in plan or "Not(EqualTo" in plan
    assert "transaction_date" not in plan.split("ReadSchema")[1]


def test_variant_search_is_whole(spark):
    from pyspark.sql import functions as F

    from plotline.functions import address as A
    from plotline.plans.fixture import frame

    q = frame(spark, SF, "query_table").select("query_id", "lane", "number").collect()
    texts = [(r.query_id, r.lane + "巷") for r in q if r.lane]
    texts += [(r.query_id + 1000000, (r.lane + "巷" if r.lane else "") + r.number + "號") for r in q]
    asks = spark.createDataFrame([(t,) for t in sorted({t for _, t in texts})], "t string").select("t", A.variants(F.col("t")).alias("v"))
    spelled = {r.t: r.v for r in asks.collect()}
    assert max(map(len, spelled.values())) > 8
    rows = frame(spark, SF, "tx_addr").select("id", "address").collect()
    hits = {t: {r.id for r in rows if any(v in r.address for v in spelled[t])} for t in spelled}
    got = catalogue.QUERIES["r8_variant_search"](spark, SF).collect()
    assert sorted((r.query_id, r.id) for r in got) == sorted((i, k) for i, t in texts for k in hits[t])
    assert len({r.query_id for r in got}) == len({i for i, t in texts if hits[t]}) > 0


@pytest.mark.parametrize("name, part", [("j19_best_item_by_address", "items-"), ("a16_road_groups", "addresses-"), ("a22_range_summary", "house_numbers-")])
def test_addresses_are_taken_apart_once(spark, name, part):
    # What is taken apart was written first, so no condition on the parts is evaluated for every row.
    assert any(part in f for f in catalogue.QUERIES[name](spark, SF).inputFiles())


def test_no_task_writes_a_whole_arrival(spark, monkeypatch):
    from plotline.plans import ingest as plans

    seen = []
    landing = plans.ST.read_landing
    monkeypatch.setattr(plans.ST, "read_landing", lambda s, path, *a: seen.append(path) or landing(s, path, *a))
    got = catalogue.QUERIES["t2_unique_within_watermark"](spark, SF)
    ids = [r.id for r in got.collect()]
    per_file = [r["count"] for r in spark.read.parquet(seen[0]).groupBy("_metadata.file_path").count().collect()]
    assert sorted(ids) == sorted(r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect())
    assert len(per_file) == 48 and max(per_file) * 4 < sum(per_file) / 3


def test_no_micro_batch_is_one_file(spark, monkeypatch):
    from plotline.plans import ingest as plans

    seen = []
    landing = plans.ST.read_landing
    monkeypatch.setattr(plans.ST, "read_landing", lambda s, path, *a: seen.append(path) or landing(s, path, *a))
    batches = []
    upsert = plans.ST.upsert_transactions
    monkeypatch.setattr(plans.ST, "upsert_transactions", lambda s, rows, path: batches.append(path) or upsert(s, rows, path))
    catalogue.QUERIES["t3_stream_upsert"](spark, SF)
    assert len(seen) == 3 and len(batches) == 6
    for path in seen:
        per_file = [r["count"] for r in spark.read.parquet(path).groupBy("_metadata.file_path").count().collect()]
        assert len(per_file) == 32 and max(per_file) * 8 < sum(per_file)
