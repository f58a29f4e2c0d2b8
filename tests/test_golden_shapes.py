"""The reference's committed output shapes (FIXTURES.md §E) are reachable by
operator parameters alone: same columns, built from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.operators import aggs, joins, loads
from chronoframe.plans.common import table, trade_pairs
from tests.conftest import SF_SMALL


def cols(df):
    return df.columns


def test_type_totals(spark):
    o = table(spark, SF_SMALL, "orders").select(F.col("o_orderstatus").alias("event_type"),
                                                F.col("o_orderpriority").alias("sub_event_type"), "o_totalprice")
    r = aggs.group_count_sum(o, ["event_type", "sub_event_type"], "o_totalprice", count="count", total="fatalities")
    assert cols(r) == ["event_type", "sub_event_type", "count", "fatalities"]


def test_weekly_and_monthly_by_source(spark):
    e = table(spark, SF_SMALL, "events")
    assert cols(aggs.bucket_count(e, "ts", "week", count="events")) == ["week", "events"]
    by_src = aggs.bucket_count(e.withColumnRenamed("event_type", "source"), "ts", "month", ["source"], count="events")
    assert cols(by_src) == ["month", "source", "events"]
    assert by_src.filter(F.dayofmonth("month") != 1).count() == 0


def test_exploded_and_flag_counts(spark):
    p = table(spark, SF_SMALL, "part").select(F.split("p_name", " ").alias("impact"))
    assert cols(aggs.explode_count(p, "impact", out="impact_type", count="incidents")) == ["impact_type", "incidents"]
    lb = table(spark, SF_SMALL, "labels")
    assert cols(aggs.flags_to_counts(lb, {"quality": "quality", "toxic": "toxic"}, out="event_type", count="events")) == \
        ["event_type", "events"]


def test_three_way_outer(spark):
    c, s = table(spark, SF_SMALL, "customer"), table(spark, SF_SMALL, "supplier")
    a = c.groupBy(F.col("c_nationkey").alias("admin1")).agg(F.count(F.lit(1)).alias("violence_events"),
                                                            F.sum("c_acctbal").alias("violence_fatalities"))
    b = s.groupBy(F.col("s_nationkey").alias("admin1")).agg(F.count(F.lit(1)).alias("civilian_events"),
                                                            F.sum("s_acctbal").alias("civilian_fatalities"))
    d = c.filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("admin1")).agg(F.count(F.lit(1)).alias("demonstration_events"))
    assert cols(joins.full_outer_3way(a, b, d, "admin1")) == ["admin1", "violence_events", "violence_fatalities",
                                                             "civilian_events", "civilian_fatalities", "demonstration_events"]


def test_pair_asymmetry_and_bidirectional(spark):
    p = trade_pairs(spark, SF_SMALL).withColumnRenamed("src", "country_a").withColumnRenamed("dst", "country_b")
    ps = aggs.pair_stats(p, "country_a", "country_b", "disc", count="events", avg="goldstein")
    j = joins.inverse_pair_join(ps, "country_a", "country_b", ["events", "goldstein"], left_fmt="a_to_b_{m}", right_fmt="b_to_a_{m}")
    r = aggs.pair_asymmetry(j, "a_to_b_goldstein", "b_to_a_goldstein", "a_to_b_events", "b_to_a_events",
                            out_avg="goldstein_asymmetry", out_n="volume_asymmetry")
    assert cols(r.select("country_a", "country_b", "a_to_b_events", "b_to_a_events", "a_to_b_goldstein", "b_to_a_goldstein",
                         "goldstein_asymmetry", "volume_asymmetry")) == [
        "country_a", "country_b", "a_to_b_events", "b_to_a_events", "a_to_b_goldstein", "b_to_a_goldstein",
        "goldstein_asymmetry", "volume_asymmetry"]
    bd = aggs.bidirectional_counts(trade_pairs(spark, SF_SMALL), "src", "dst", "NATION_3", "disc", 25,
                                   names=("rus_to_country", "country_to_rus", "avg_goldstein_out", "avg_goldstein_in"))
    assert cols(bd) == ["country", "rus_to_country", "country_to_rus", "avg_goldstein_out", "avg_goldstein_in"]


def test_histogram_weapons_aid_overview(spark):
    e = table(spark, SF_SMALL, "events")
    assert cols(aggs.rounded_histogram(e, "value", out="goldstein_bin")) == ["goldstein_bin", "count"]
    li = table(spark, SF_SMALL, "lineitem").join(table(spark, SF_SMALL, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    w = li.select(F.col("p_name").alias("model"), F.col("l_quantity").alias("launched"),
                  F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("destroyed"), "l_shipdate")
    assert cols(aggs.by_category_rate(w, "model", "destroyed", "launched", "l_shipdate")) == \
        ["model", "total_launched", "total_destroyed", "attacks", "intercept_rate"]
    c = table(spark, SF_SMALL, "customer").groupBy(F.col("c_name").alias("donor"), F.col("c_mktsegment").alias("aid_type_general")) \
        .agg(F.count(F.lit(1)).alias("commitments"), F.sum("c_acctbal").alias("total_eur"))
    su = aggs.superset_member(c, "donor", ["Customer#000000001", "Customer#000000002"], "Europe (All)", ["aid_type_general"],
                              ["commitments", "total_eur"])
    assert cols(su) == ["donor", "aid_type_general", "commitments", "total_eur"]
    o = table(spark, SF_SMALL, "orders")
    doc = loads.nested_document({"totals": (o, {"orders": F.count(F.lit(1))}),
                                 "date_ranges": (o, {"orders_start": F.min(F.to_date("o_orderdate")),
                                                     "orders_end": F.max(F.to_date("o_orderdate"))})}) \
        .withColumn("export_timestamp", F.current_timestamp())
    assert cols(doc) == ["totals", "date_ranges", "export_timestamp"]
    assert doc.count() == 1
