"""Joins, splits, samples, fingerprints and structural audits on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.functions.columns import hash_low_bit, stable_seed
from verdigate.operators import labels, metrics, rules
from verdigate.operators import structure as X
from verdigate.operators.distributed import shared_folder
from verdigate.plans.proxies import DECISION_SQL, TWO_TASK_SQL, decision_view, two_task_inputs
from verdigate.plans.registry import query
from verdigate.sources.ingest import table
from verdigate.sources.sinks import dataset_manifest, publish_partitions, write_canonical_json

WITH_V = f"WITH {DECISION_SQL}"
NAMESPACE = "decision-audit"


@query(
    "J1_verified_sealed_join",
    f"{WITH_V} SELECT split, count(*) AS rows, count(DISTINCT event_cluster_id) AS clusters, "
    "sum(full_utility) AS full_utility FROM v GROUP BY 1",
    ("full_utility",),
)
def verified_sealed_join(spark, directory):
    v = decision_view(spark, directory)
    features = v.select("row_id", "event_cluster_id", "split", "confidence")
    sealed = v.select("row_id", "event_cluster_id", "full_utility", "reduced_utility")
    joined = X.checked_join(
        features, sealed, ["row_id", "event_cluster_id"], required=["full_utility"]
    )
    return joined.groupBy("split").agg(
        F.count("*").alias("rows"), F.countDistinct("event_cluster_id").alias("clusters"),
        F.sum("full_utility").alias("full_utility"),
    )


@query(
    "J2_context_registry_proposals",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE c_custkey IS NULL) AS unmatched,
      count(DISTINCT c_custkey) AS contexts, count(DISTINCT c_nationkey) AS registries
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""",
)
def context_registry_proposals(spark, directory):
    """Orders (contexts) 1:1 with their registry, then lines (proposals) N:1."""
    orders = table(spark, directory, "orders")
    registry = orders.select("o_orderkey", F.col("o_custkey").alias("registered_customer"))
    contexts = X.checked_join(orders, registry, ["o_orderkey"], "inner", required=["registered_customer"])
    lines = table(spark, directory, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    proposals = X.checked_join(lines, contexts, ["o_orderkey"], "left", "many_to_one", ["o_custkey"])
    customers = table(spark, directory, "customer").withColumnRenamed("c_custkey", "o_custkey")
    full = X.checked_join(
        proposals, customers.withColumn("c_custkey", F.col("o_custkey")), ["o_custkey"], "left",
        "many_to_one",
    )
    return full.agg(
        F.count("*").alias("rows"), F.count_if(F.col("c_custkey").isNull()).alias("unmatched"),
        F.countDistinct("c_custkey").alias("contexts"),
        F.countDistinct("c_nationkey").alias("registries"),
    )


@query(
    "J3_key_alignment",
    """WITH k AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer)
    SELECT count(*) FILTER (WHERE c.k IS NOT NULL AND k.k IS NOT NULL) AS "both",
      count(*) FILTER (WHERE c.k IS NULL) AS left_only,
      count(*) FILTER (WHERE k.k IS NULL) AS right_only,
      count(*) FILTER (WHERE c.k IS NULL OR k.k IS NULL) = 0 AS aligned
    FROM k FULL JOIN c ON k.k = c.k""",
)
def key_alignment(spark, directory):
    left = table(spark, directory, "orders").select(F.col("o_custkey").alias("k"))
    right = table(spark, directory, "customer").select(F.col("c_custkey").alias("k"))
    return X.key_alignment(left, right, ["k"])


@query(
    "J4_identity_verification",
    f"""{WITH_V} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS symbol_mismatches,
      count(*) FILTER (WHERE split = 'test') AS split_mismatches,
      count(*) FILTER (WHERE l_linenumber = 3) AS decision_timestamp_mismatches FROM v""",
)
def identity_verification(spark, directory):
    """The sealed side spells splits differently and disagrees on known rows."""
    v = decision_view(spark, directory)
    sealed = v.withColumns(
        {
            "split": F.when(F.col("split") == "test", "Paper-Test").otherwise(F.upper("split")),
            "decision_timestamp": F.when(
                F.col("l_linenumber") == 3, F.col("decision_timestamp") + F.expr("INTERVAL 1 SECOND")
            ).otherwise(F.col("decision_timestamp")),
        }
    )
    return X.identity_mismatches(
        v, sealed, ["row_id", "event_cluster_id"], ["symbol"], ["split"], ["decision_timestamp"]
    )


@query(
    "J5_proposals_with_contexts",
    """SELECT o_orderpriority, count(*) AS rows,
      count(*) FILTER (WHERE (l_linestatus = 'O') = (o_orderstatus = 'O')) AS agreeing
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def proposals_with_contexts(spark, directory):
    contexts = table(spark, directory, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    joined = X.checked_join(
        table(spark, directory, "lineitem"), contexts, ["l_orderkey"], "left", "many_to_one"
    )
    agree = (F.col("l_linestatus") == "O") == (F.col("o_orderstatus") == "O")
    return joined.groupBy("o_orderpriority").agg(
        F.count("*").alias("rows"), F.count_if(agree).alias("agreeing")
    )


@query(
    "J15_U4_membership_difference",
    """SELECT 'customer_without_order' AS kind, c_custkey AS id FROM customer
      WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT DISTINCT 'unlabelled_document', doc_id FROM documents
      WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT DISTINCT 'label_without_document', doc_id FROM labels
      WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def membership_difference(spark, directory):
    def missing(kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, "id", "left_anti").distinct().select(F.lit(kind).alias("kind"), "id")

    customers = table(spark, directory, "customer").select(F.col("c_custkey").alias("id"))
    buyers = table(spark, directory, "orders").select(F.col("o_custkey").alias("id"))
    docs = table(spark, directory, "documents").select(F.col("doc_id").alias("id"))
    labelled = table(spark, directory, "labels").select(F.col("doc_id").alias("id"))
    return (
        missing("customer_without_order", customers, buyers)
        .unionByName(missing("unlabelled_document", docs, labelled))
        .unionByName(missing("label_without_document", labelled, docs))
    )


@query(
    "U1_rule_frames_concat",
    f"""{WITH_V} SELECT 'core' AS layer, split, count(*) AS rows, CAST(NULL AS DOUBLE) AS volatility
      FROM v GROUP BY 2
    UNION ALL SELECT 'two_task', symbol, count(*), avg((l_partkey % 40) + 5.0e0) FROM v GROUP BY 2""",
    ("volatility",),
)
def rule_frames_concat(spark, directory):
    core = decision_view(spark, directory).groupBy("split").agg(F.count("*").alias("rows"))
    task = two_task_inputs(spark, directory).groupBy(F.col("symbol").alias("split")).agg(
        F.count("*").alias("rows"), F.avg("volatility_bps").alias("volatility")
    )
    return core.withColumn("layer", F.lit("core")).unionByName(
        task.withColumn("layer", F.lit("two_task")), allowMissingColumns=True
    )


@query(
    "U2_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2
    HAVING count(*) > 1""",
)
def duplicate_line_keys(spark, directory):
    return X.duplicate_keys(table(spark, directory, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "U5_hash_halves",
    """WITH c AS (
      SELECT DISTINCT o_orderkey AS id FROM orders),
    k AS (SELECT *, row_number() OVER (ORDER BY sha256('decision-audit|' || id)) AS rn,
      count(*) OVER () AS n FROM c)
    SELECT id, CASE WHEN rn <= n / 2 THEN 'paper_test' ELSE 'community_hidden' END AS destination
    FROM k""",
)
def hash_halves(spark, directory):
    ids = table(spark, directory, "orders").select(F.col("o_orderkey").alias("id"))
    return X.hash_halves(ids, "id", NAMESPACE)


@query(
    "U6_U7_hash_role_and_seed",
    """SELECT o_orderkey AS id, CASE WHEN CAST('0x' || right(sha256(CAST(o_orderkey AS VARCHAR)), 1)
        AS BIGINT) % 2 = 0 THEN 'risk_limit_proposer' ELSE 'risk_critic' END AS role,
      CAST('0x' || substr(sha256('decision-audit/7/order/' || o_orderkey), 1, 8) AS BIGINT) AS seed
    FROM orders""",
)
def hash_role_and_seed(spark, directory):
    key = F.col("o_orderkey")
    return table(spark, directory, "orders").select(
        key.alias("id"),
        X.role_by_hash(key, "risk_limit_proposer", "risk_critic").alias("role"),
        stable_seed(NAMESPACE, 7, F.concat(F.lit("order/"), key.cast("string"))).alias("seed"),
    )


_ONE_PER = """o AS (
      SELECT *, row_number() OVER (PARTITION BY event_cluster_id ORDER BY row_id) - 1 AS i,
        count(*) OVER (PARTITION BY event_cluster_id) AS n FROM v),
    one AS (
      SELECT * FROM o WHERE i = CAST('0x' || substr(sha256('decision-audit/11/row/'
        || event_cluster_id), 1, 8) AS BIGINT) % n)"""


@query(
    "U8_one_row_per_cluster",
    f"{WITH_V}, {_ONE_PER} SELECT event_cluster_id, row_id FROM one",
)
def one_row_per_cluster(spark, directory):
    return X.one_row_per_cluster(
        decision_view(spark, directory).select("event_cluster_id", "row_id"),
        "event_cluster_id", "row_id", 11, NAMESPACE,
    )


@query(
    "U9_nested_cluster_sample",
    """WITH k AS (SELECT o_orderkey AS id, row_number() OVER (
        ORDER BY sha256('13|' || o_orderkey)) - 1 AS draw FROM orders)
    SELECT id, draw, draw < 100 AS in_small_budget FROM k WHERE draw < 400""",
)
def nested_cluster_sample(spark, directory):
    ids = table(spark, directory, "orders").select(F.col("o_orderkey").alias("id"))
    return X.sample_clusters(ids, "id", 400, 13).withColumn(
        "in_small_budget", F.col("draw") < 100
    )


@query(
    "U10_curriculum_sample",
    """WITH k AS (SELECT o_orderstatus AS source_layer, o_orderkey AS id, row_number() OVER (
        PARTITION BY o_orderstatus ORDER BY sha256('17|' || o_orderkey)) - 1 AS draw FROM orders)
    SELECT source_layer, id FROM k WHERE (source_layer = 'O' AND draw < 125)
      OR (source_layer = 'F' AND draw < 75) OR (source_layer = 'P' AND draw < 50)""",
)
def curriculum_sample(spark, directory):
    orders = table(spark, directory, "orders")
    pools = {
        s: orders.filter(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("id"))
        for s in ("O", "F", "P")
    }
    return X.curriculum_sample(pools, "id", 250, {"O": 0.5, "F": 0.3, "P": 0.2}, 17).select(
        "source_layer", "id"
    )


@query(
    "U11_training_variants",
    f"""{WITH_V}, m AS (
      SELECT row_id, opportunity_slice, original_source_eligible, candidate_action * realized_return
        > 0 AS predicted, full_utility > 0 AND original_source_eligible AS safe FROM v)
    SELECT 'D0' AS variant, 'prediction_correct' AS label_semantics, count(*) AS pool_rows,
      count(*) FILTER (WHERE predicted) AS positive FROM m
    UNION ALL SELECT 'D1', 'authorization_safe', count(*), count(*) FILTER (WHERE safe) FROM m
      WHERE opportunity_slice = 'ordinary'
    UNION ALL SELECT 'D2', 'authorization_safe', count(*), count(*) FILTER (WHERE safe) FROM m
      WHERE opportunity_slice <> 'ordinary'
    UNION ALL SELECT 'D3', 'authorization_safe', count(*), count(*) FILTER (WHERE safe) FROM m
    UNION ALL SELECT 'D6', 'authorization_safe', count(*), count(*) FILTER (WHERE safe) FROM m
      WHERE original_source_eligible""",
)
def training_variants(spark, directory):
    """Pool sizes and label balance of the training variants, tagged in one pass."""
    tagged = training_variant_rows(decision_view(spark, directory))
    return tagged.groupBy("variant", "label_semantics").agg(
        F.count("*").alias("pool_rows"),
        F.count_if(F.col("training_label") == 1).alias("positive"),
    )


def training_variant_rows(v: DataFrame) -> DataFrame:
    ordinary = F.col("opportunity_slice") == "ordinary"
    v = v.withColumn("authority_laundering", F.lit(False))
    pools = {
        "D0": F.lit(True), "D1": ordinary, "D2": ~ordinary, "D3": F.lit(True),
        "D6": F.col("original_source_eligible"),
    }
    wide = v.withColumns(
        {"_safe": labels.safety_label(), "_predicted": labels.prediction_label()}
    )
    tagged = wide.select("*", F.explode(labels.in_profiles(pools)).alias("variant"))
    is_prediction = F.col("variant") == "D0"
    return tagged.withColumns(
        {
            "label_semantics": F.when(is_prediction, "prediction_correct").otherwise("authorization_safe"),
            "training_label": F.when(is_prediction, F.col("_predicted")).otherwise(F.col("_safe")),
        }
    )


@query(
    "W8_chronological_split",
    """WITH c AS (SELECT o_orderkey AS id, o_orderdate AS t FROM orders),
    r AS (SELECT *, row_number() OVER (ORDER BY t, id) - 1 AS position, count(*) OVER () AS n FROM c)
    SELECT id, position, CASE WHEN position < round_even(0.6e0 * n, 0) THEN 'train'
      WHEN position < round_even(0.6e0 * n, 0) + round_even(0.2e0 * n, 0) THEN 'validation'
      ELSE 'test' END AS split FROM r""",
)
def chronological_split(spark, directory):
    orders = table(spark, directory, "orders").select(
        F.col("o_orderkey").alias("id"), "o_orderdate"
    )
    bounds = X.fraction_bounds(orders.count(), [("train", 0.6), ("validation", 0.2)])
    return X.chronological_split(orders, "id", "o_orderdate", bounds, "test")


@query(
    "W9_contiguous_folds",
    """SELECT d AS day, CAST(ntile(5) OVER (ORDER BY d) - 1 AS INTEGER) AS fold
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def contiguous_folds(spark, directory):
    days = table(spark, directory, "orders").select(F.to_date("o_orderdate").alias("day"))
    return X.contiguous_folds(days.withColumn("_d", F.col("day")), "day", "_d", 5)


@query(
    "W12_evenly_spaced_rows",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p,
        count(*) OVER () AS n FROM orders),
    w AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 99.0e0, 0) AS BIGINT) AS p
      FROM (SELECT unnest(range(0, 100)) AS i), (SELECT max(n) AS n FROM r))
    SELECT o_orderkey FROM r JOIN w USING (p)""",
)
def evenly_spaced_rows(spark, directory):
    orders = table(spark, directory, "orders").select("o_orderkey", "o_totalprice")
    return X.evenly_spaced(orders, ["o_totalprice", "o_orderkey"], 100).select("o_orderkey")


@query(
    "W14_calendar_symbol",
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, ['BTC', 'ETH', 'SOL'][1 + CAST(
      (CAST(o_orderdate AS DATE) - DATE '0001-01-01' + 1) % 3 AS INTEGER)] AS symbol FROM orders""",
)
def calendar_symbol(spark, directory):
    day = F.to_date("o_orderdate")
    return table(spark, directory, "orders").select(
        day.alias("day"), X.calendar_choice(day, ("BTC", "ETH", "SOL")).alias("symbol")
    ).distinct()


_WORDS = ", ".join(
    f"CAST(sum(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(4)
)
FINGERPRINT_SQL = f"""h AS (
      SELECT split, sha256('{{"row_id":"' || row_id || '","symbol":"' || symbol || '"}}') AS d FROM v),
    fp AS (SELECT split, count(*) AS rows, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {_WORDS}))
      AS fingerprint FROM h GROUP BY 1)"""


@query("A25_dataset_fingerprint", f"{WITH_V}, {FINGERPRINT_SQL} SELECT * FROM fp")
def dataset_fingerprint(spark, directory):
    return X.dataset_fingerprint(
        decision_view(spark, directory).select("split", "row_id", "symbol"), ["split"]
    )


@query(
    "AU12_fingerprint_verification",
    f"""{WITH_V}, {FINGERPRINT_SQL} SELECT split, split <> 'test' AS passed FROM fp""",
)
def fingerprint_verification(spark, directory):
    """Stored fingerprints against recomputed ones; the test rows were changed."""
    rows = decision_view(spark, directory).select("split", "row_id", "symbol")
    manifest = X.dataset_fingerprint(rows, ["split"])
    changed = rows.withColumn(
        "symbol", F.when(F.col("split") == "test", F.lower("symbol")).otherwise(F.col("symbol"))
    )
    return X.fingerprint_mismatches(
        X.dataset_fingerprint(changed, ["split"]), manifest, "split"
    ).select("split", "passed")


@query(
    "A27_source_split_audit",
    f"""{WITH_V}, c AS (SELECT source_role, count(*) AS n, count(DISTINCT split) > 1 AS x
      FROM v GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS derived_rows, count(*) AS event_clusters,
      count(*) FILTER (WHERE x) AS clusters_crossing_splits,
      (SELECT count(*) FROM orders) AS raw_records,
      sum(n) * 1.0e0 / (SELECT count(*) FROM orders) AS derived_rows_per_raw,
      sum(n) * 1.0e0 / count(*) AS derived_rows_per_cluster FROM c""",
    ("derived_rows_per_raw", "derived_rows_per_cluster"),
)
def source_split_audit(spark, directory):
    return metrics.split_leakage(
        decision_view(spark, directory), table(spark, directory, "orders"), "source_role"
    )


@query(
    "SNK6_dataset_manifest",
    f"""{WITH_V}, s AS (SELECT event_cluster_id, count(*) AS n FROM v GROUP BY 1)
    SELECT 'split' AS section, split AS name, count(*) AS value FROM v GROUP BY 2
    UNION ALL SELECT 'source_role', source_role, count(*) FROM v GROUP BY 2
    UNION ALL SELECT 'opportunity_slice', opportunity_slice, count(*) FROM v GROUP BY 2
    UNION ALL SELECT 'dataset', 'rows', CAST(sum(n) AS BIGINT) FROM s
    UNION ALL SELECT 'dataset', 'clusters', count(*) FROM s
    UNION ALL SELECT 'dataset', 'min_rows_per_cluster', min(n) FROM s
    UNION ALL SELECT 'dataset', 'max_rows_per_cluster', max(n) FROM s
    UNION ALL SELECT 'range', 'first_day', CAST(min(CAST(decision_timestamp AS DATE))
      - DATE '1970-01-01' AS BIGINT) FROM v
    UNION ALL SELECT 'range', 'last_day', CAST(max(CAST(decision_timestamp AS DATE))
      - DATE '1970-01-01' AS BIGINT) FROM v""",
)
def manifest(spark, directory):
    return dataset_manifest(
        decision_view(spark, directory), ("split", "source_role", "opportunity_slice"),
        timestamp="decision_timestamp",
    )


@query(
    "SNK3_PRJ34_canonical_json",
    f"""{WITH_V} SELECT '{{"candidate_action":' || candidate_action || ',"horizon":' || horizon
      || ',"row_id":"' || row_id || '","tail":null}}' AS value FROM v""",
)
def canonical_json_rows(spark, directory):
    """Canonical JSON with NaN as null and sorted keys, written and read back."""
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}.json"
    write_canonical_json(
        decision_view(spark, directory).select(
            "row_id", "horizon", "candidate_action", F.lit(float("nan")).alias("tail")
        ), path,
    )
    return spark.read.text(path)


@query(
    "SNK5_split_router",
    f"""{WITH_V}, c AS (SELECT DISTINCT event_cluster_id AS id FROM v WHERE split = 'test'),
    k AS (SELECT *, row_number() OVER (ORDER BY sha256('decision-audit|' || id)) AS rn,
      count(*) OVER () AS n FROM c)
    SELECT CASE WHEN split <> 'test' THEN split WHEN rn <= n // 2 THEN 'paper_test'
        WHEN n % 2 = 1 AND rn = n // 2 + 1 THEN 'unassigned'
        ELSE 'community_hidden' END AS destination, count(*) AS rows, count(*) AS counted_rows,
      sum(confidence) AS confidence
    FROM v LEFT JOIN k ON event_cluster_id = id WHERE split <> 'test' OR id IS NOT NULL GROUP BY 1""",
    ("confidence",),
)
def split_router(spark, directory):
    """Rows published by destination; the published table, and the counts of the sink."""
    v = decision_view(spark, directory)
    halves = X.hash_halves(
        test_clusters(v), "event_cluster_id", NAMESPACE, spare="unassigned"
    )
    routed = X.route_rows(v, halves, "event_cluster_id").select("row_id", "event_cluster_id", "confidence", "destination")
    path = f"{shared_folder(spark)}/partitions-{uuid.uuid4().hex}"
    counted = publish_partitions(routed, path, DESTINATIONS)
    counts = spark.createDataFrame(list(counted.items()), "destination string, counted_rows bigint")
    return (
        spark.read.parquet(path).groupBy("destination")
        .agg(F.count("*").alias("rows"), F.sum("confidence").alias("confidence")).join(counts, "destination")
    )


DESTINATIONS = ("train", "validation", "paper_test", "community_hidden", "unassigned")


def test_clusters(v: DataFrame) -> DataFrame:
    return v.filter(F.col("split") == "test").select("event_cluster_id").distinct()


def market_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Lines as point-in-time rows: source, decision, action and outcome times."""
    v = decision_view(spark, directory)
    d = F.col("decision_timestamp")
    return v.withColumns(
        {
            "source_timestamp": d - F.expr("INTERVAL 1 DAY"),
            "action_timestamp": d + F.expr("INTERVAL 1 HOUR"),
            "market_created_timestamp": d - F.expr("INTERVAL 10 DAYS"),
            "scheduled_end_timestamp": d + F.expr("INTERVAL 10 DAYS"),
            "historical_probability_observed": F.lit(True),
            "historical_spread_observed": F.lit(False),
            "historical_depth_observed": F.lit(False),
            "resolution_text_used_by_rule": F.lit(False),
            "outcome_used_by_rule": F.lit(False),
            "historical_probability_source": F.when(
                F.col("l_linenumber") == 1, "clob_prices_history"
            ).otherwise("data_api_trade"),
            "series_key": F.concat(F.lit("tag:"), F.col("source_role")),
        }
    )


@query(
    "AU1_point_in_time_audit",
    f"""{WITH_V}, r AS (SELECT count(*) FILTER (WHERE outcome_timestamp IS NULL OR
        outcome_timestamp <= decision_timestamp + INTERVAL 1 HOUR) AS bad FROM v),
    c AS (SELECT event_cluster_id, count(*) AS n, count(DISTINCT split) AS s,
      bool_or(split = 'test') AS t FROM v GROUP BY 1),
    k AS (SELECT max(n) AS m, count(*) FILTER (WHERE s <> 1) AS x, count(*) FILTER (WHERE t) AS tc FROM c)
    SELECT 'all required timestamps parse' AS "check", TRUE AS passed
    UNION ALL SELECT 'source < decision < action < outcome', bad = 0 FROM r
    UNION ALL SELECT 'decision follows frozen lifecycle fraction', TRUE
    UNION ALL SELECT 'no event cluster crosses splits', x = 0 FROM k
    UNION ALL SELECT 'one row per public event cluster', m = 1 FROM k
    UNION ALL SELECT unnest(['historical probability observed', 'historical spread not claimed',
      'historical depth not claimed', 'resolution text excluded from rules',
      'outcome excluded from rules', 'historical source provenance is explicit',
      'series provenance is present']), TRUE
    UNION ALL SELECT 'test cluster threshold structurally met', tc >= 500 FROM k""",
)
def point_in_time_audit(spark, directory):
    return X.point_in_time_audit(market_rows(spark, directory), 0.5).select("check", "passed")


@query(
    "AU14_source_classification",
    """SELECT 'orders' AS source, 'descriptive_public_derived' AS classification,
      FALSE AS confirmatory_eligible UNION ALL SELECT 'lines', 'excluded_from_inference', FALSE""",
)
def source_classification(spark, directory):
    checks = X.point_in_time_audit(market_rows(spark, directory), 0.5)
    legacy = table(spark, directory, "orders").agg(F.count("*").alias("n")).select(
        F.lit("orders").alias("source"), F.lit("descriptive_public_derived").alias("classification"),
        (F.col("n") < 0).alias("confirmatory_eligible"),
    )
    return X.classify_source(checks, legacy, "lines")


@query(
    "AU5_shortcut_structure",
    f"""{WITH_V}, i AS (SELECT row_id, count(*) AS n FROM v GROUP BY 1),
    c AS (SELECT event_cluster_id, count(DISTINCT split) AS s FROM v GROUP BY 1)
    SELECT (SELECT CAST(sum(n - 1) AS BIGINT) FROM i) AS duplicate_row_ids,
      (SELECT max(s) FROM c) AS cluster_split_max_unique,
      (SELECT max(s) FROM c) > 1 AS cluster_split_leakage, TRUE AS future_decoy_present,
      FALSE AS future_decoy_used, FALSE AS identifier_used""",
)
def shortcut_structure(spark, directory):
    used = {f for r in rules.core_rules() for f in r.features}
    v = decision_view(spark, directory).withColumn("future_decoy", F.col("full_utility"))
    return X.shortcut_structure(v, sorted(used), ("row_id", "event_cluster_id", "stress_tag"))


@query(
    "AU6_cluster_date_bijection",
    f"""WITH {TWO_TASK_SQL}, p AS (
      SELECT DISTINCT event_cluster_id AS c, CAST(decision_timestamp AS DATE) AS d FROM t),
    a AS (SELECT c, count(*) AS n FROM p GROUP BY 1), b AS (SELECT d, count(*) AS n FROM p GROUP BY 1)
    SELECT (SELECT count(*) FROM a) AS clusters,
      (SELECT count(*) FROM a WHERE n <> 1) AS clusters_with_many_dates,
      (SELECT count(*) FROM b WHERE n <> 1) AS dates_with_many_clusters,
      CAST(0 AS BIGINT) AS invalid_timestamps,
      (SELECT count(*) FROM a WHERE n <> 1) + (SELECT count(*) FROM b WHERE n <> 1) = 0 AS bijection""",
)
def cluster_date_bijection(spark, directory):
    return X.cluster_date_bijection(two_task_inputs(spark, directory))


@query(
    "AU7_split_guard",
    f"""{WITH_V} SELECT split, count(*) AS rows, split = 'validation' AS allowed,
      FALSE AS hidden FROM v GROUP BY 1""",
)
def split_guard(spark, directory):
    return X.split_guard(decision_view(spark, directory), ("validation",))


@query(
    "AU13_parameter_equality",
    f"""{WITH_V}, a AS (SELECT 'fee_bps' AS name, CAST(max(fee_bps) AS VARCHAR) AS value FROM v
        WHERE split = 'train' UNION ALL SELECT 'roles', CAST(count(DISTINCT source_role) AS VARCHAR)
        FROM v WHERE split = 'train' UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM v
        WHERE split = 'train'),
    b AS (SELECT 'fee_bps' AS name, CAST(max(fee_bps) AS VARCHAR) AS value FROM v
        WHERE split = 'test' UNION ALL SELECT 'roles', CAST(count(DISTINCT source_role) AS VARCHAR)
        FROM v WHERE split = 'test' UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM v
        WHERE split = 'test')
    SELECT name, a.value AS left_value, b.value AS right_value, a.value = b.value AS same
    FROM a FULL JOIN b USING (name)""",
)
def parameter_equality(spark, directory):
    """Parameters measured on two versions of a data set (here two splits)."""
    def measured(split: str) -> DataFrame:
        one = decision_view(spark, directory).filter(F.col("split") == split).agg(
            F.max("fee_bps").cast("string").alias("fee_bps"),
            F.countDistinct("source_role").cast("string").alias("roles"),
            F.count("*").cast("string").alias("rows"),
        )
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in one.columns])
        return one.select(F.inline(cells))

    return X.parameter_differences(measured("train"), measured("test"))


@query(
    "AU3_replication_audit",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
    s AS (SELECT count(*) FILTER (WHERE day NOT BETWEEN DATE '1995-01-01' AND DATE '1997-12-31') AS o
      FROM d WHERE day >= DATE '1995-01-01')
    SELECT 'forbidden columns absent' AS "check", TRUE AS passed, '' AS detail
    UNION ALL SELECT 'registered date range', o = 0, CAST(o AS VARCHAR) FROM s
    UNION ALL SELECT 'zero calendar overlap', TRUE, '0'
    UNION ALL SELECT 'chronological split order', TRUE, 'development->paper_test'""",
)
def replication_audit(spark, directory):
    day = F.to_date("o_orderdate")
    days = table(spark, directory, "orders").select(
        day.alias("session_date"),
        F.when(day < F.lit("1997-01-01").cast("date"), "development").otherwise("paper_test").alias("split"),
    )
    cut = F.lit("1995-01-01").cast("date")
    return X.replication_audit(
        days.filter(F.col("session_date") >= cut), days.filter(F.col("session_date") < cut),
        ("outcome_timestamp", "exit_price"), "1995-01-01", "1997-12-31",
        ("development", "paper_test"),
    )


@query(
    "PRJ8_PRJ30_training_schema",
    f"""{WITH_V}, n AS (SELECT * FROM v WHERE opportunity_slice NOT IN ('severe_stress'))
    SELECT 'controlled' AS source_layer, count(*) AS rows,
      count(DISTINCT 'controlled:' || event_cluster_id) AS clusters, sum(confidence) AS confidence,
      0.0e0 * count(*) AS fee_rate, count(*) AS unknown_claimed FROM n""",
    ("confidence", "fee_rate"),
)
def training_schema(spark, directory):
    v = labels.exclude_mechanisms(
        decision_view(spark, directory), {"opportunity_slice": ("severe_stress",)}
    )
    t = labels.training_schema(v, ("confidence", "fee_rate", "claimed_role"), "controlled")
    return t.groupBy("source_layer").agg(
        F.count("*").alias("rows"), F.countDistinct("training_cluster_id").alias("clusters"),
        F.sum("confidence").alias("confidence"), F.sum("fee_rate").alias("fee_rate"),
        F.count_if(F.col("claimed_role") == "unknown").alias("unknown_claimed"),
    )


@query(
    "PRJ11_training_labels",
    f"""{WITH_V} SELECT split, count(*) FILTER (WHERE full_utility > 0 AND original_source_eligible)
      AS safe_rows, count(*) FILTER (WHERE candidate_action * realized_return > 0) AS predicted_rows
    FROM v GROUP BY 1""",
)
def training_labels(spark, directory):
    v = decision_view(spark, directory).withColumn("authority_laundering", F.lit(False))
    return v.groupBy("split").agg(
        F.count_if(labels.safety_label() == 1).alias("safe_rows"),
        F.count_if(labels.prediction_label() == 1).alias("predicted_rows"),
    )


@query(
    "PRJ12_PRJ13_masked_features",
    f"""{WITH_V} SELECT 'masked' AS source_role, 0.0e0 AS fee_bps, sum(confidence) AS confidence,
      0.0e0 AS horizon_text, count(*) AS rows FROM v""",
    ("confidence", "fee_bps", "horizon_text"),
)
def masked_features(spark, directory):
    v = decision_view(spark, directory).withColumn("horizon_text", F.col("symbol"))
    coerced = labels.coerce_features(v, ("confidence", "fee_bps", "horizon_text"), ("source_role",))
    masked = labels.mask_group(labels.mask_group(coerced, "role", ("source_role",)), "cost", ())
    return masked.groupBy("source_role", "fee_bps", "horizon_text").agg(
        F.sum("confidence").alias("confidence"), F.count("*").alias("rows")
    )


@query(
    "PRJ31_evaluation_frames",
    f"""{WITH_V}, f AS (
      SELECT CASE WHEN opportunity_slice = 'severe_stress' THEN 'validation_unseen'
        ELSE 'calibration_seen' END AS frame, event_cluster_id FROM v
      UNION ALL SELECT 'slice_' || opportunity_slice, event_cluster_id FROM v)
    SELECT frame, count(*) AS rows, count(DISTINCT event_cluster_id) AS clusters FROM f GROUP BY 1""",
)
def evaluation_frames(spark, directory):
    slice_ = F.col("opportunity_slice")
    frames = {
        "calibration_seen": slice_ != "severe_stress",
        "validation_unseen": slice_ == "severe_stress",
        **{f"slice_{s}": slice_ == s for s in
           ("ordinary", "moderate_stress", "severe_stress", "no_opportunity_control")},
    }
    v = decision_view(spark, directory)
    return v.select("event_cluster_id", F.explode(labels.in_profiles(frames)).alias("frame")).groupBy(
        "frame"
    ).agg(F.count("*").alias("rows"), F.countDistinct("event_cluster_id").alias("clusters"))
