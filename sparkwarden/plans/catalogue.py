"""The queries on the test tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.scalar import SLOTS
from ..operators import decide, evaluate, features, index, knn, parse
from ..sources import readers
from ..sources import transactions as tx
from ..streaming import scoring
from . import index_store, score
from .storage import kept, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

#: Lists, probes and block size for test tables of at most some 100,000 references.
NLIST, NPROBE, BLOCK = 64, 4, 64
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # payload times are UTC
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Inputs ---------------------------------------------------------------------


def _features(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    return features.features(tx.transactions(spark, sf_dir, hot), "tx_id", "label")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (every 20th transaction: qid, slots, borderline, label) and quantized references (all)."""
    f = kept(_features(spark, sf_dir), "features")
    queries = f.filter(tx.is_query()).withColumnRenamed("tx_id", "qid")
    refs = f.select(F.col("tx_id").alias("ref_id"), "label", *[scalar.quantize(F.col(s)).alias(s) for s in SLOTS])
    return queries, refs


def _index(refs: DataFrame) -> index_store.Index:
    """With evenly spaced references as centroids, which SQL can name too."""
    refs = kept(refs, "references")
    return index_store.build(refs, NLIST, BLOCK, centroids=kept(index.spaced_centroids(index.decoded(refs), NLIST), "centroids"))


def _centroids_alone(refs: DataFrame) -> index_store.Index:
    """What planning a search needs: no lists are built."""
    centres = kept(index.spaced_centroids(index.decoded(kept(refs, "references")), NLIST), "centroids")
    return index_store.Index(centres, None, None, None, None)


def _doubles(names: list[str]) -> list:
    return [F.col(n).cast("double").alias(n) for n in names]


def _clamped(x: str) -> str:
    return f"CAST(least(greatest({x}, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS FLOAT)"


_MCC = "[" + ", ".join(f"'{m}'" for m in tx.MCC_OF_REMAINDER) + "]"
_RISK = "CAST(CASE mcc " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scalar.MCC_RISK.items()) + f" ELSE {scalar.DEFAULT_RISK} END AS FLOAT)"
_MINUTES = "greatest(CAST(floor(epoch_us(requested_at) / 60000000.0) AS BIGINT) - CAST(floor(epoch_us(last_timestamp) / 60000000.0) AS BIGINT), 0)"


def _tx_sql(hot: bool = False) -> str:
    return f"""
ev AS (SELECT event_id AS tx_id, user_id AS customer_id, ts AS requested_at, event_type,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) * 20 AS amount_cents FROM events),
tx0 AS (SELECT tx_id, customer_id, requested_at, amount_cents, CAST(amount_cents AS DOUBLE) / 100 AS amount,
  CAST(sum(amount_cents) OVER (PARTITION BY customer_id) AS DOUBLE) / count(*) OVER (PARTITION BY customer_id) / 100{" / 10" if hot else ""} AS customer_avg_amount,
  CAST(1 + tx_id % 12 AS INTEGER) AS installments,
  CAST(count(*) OVER (PARTITION BY customer_id ORDER BY requested_at RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS INTEGER) AS tx_count_24h,
  'MERC-' || lpad(CAST(k AS VARCHAR), 3, '0') AS merchant_id,
  row_number() OVER (PARTITION BY customer_id, k ORDER BY requested_at, tx_id) > 1 AS merchant_known,
  list_extract({_MCC}, k % 11 + 1) AS mcc, CAST(100 + 37 * k AS DOUBLE) AS merchant_avg_amount,
  event_type IN ('click', 'view', 'signup') AS is_online, event_type = 'purchase' AS card_present,
  CAST(tx_id * 7919 % 15000 AS DOUBLE) / 10 AS km_from_home,
  lag(requested_at) OVER (PARTITION BY customer_id ORDER BY requested_at, tx_id) AS last_timestamp FROM ev),
tx AS (SELECT *, CASE WHEN last_timestamp IS NOT NULL THEN CAST(tx_id * 104729 % 12000 AS DOUBLE) / 10 END AS km_from_current,
  CAST((amount >= 1500 OR km_from_home > 1000) AND is_online AS INTEGER) AS label FROM tx0)"""


_FEATURES = f"""
f AS (SELECT tx_id, label,
  CASE WHEN customer_avg_amount <= 0 THEN CAST(1 AS FLOAT) ELSE {_clamped("amount / customer_avg_amount / 10")} END AS s0,
  CASE WHEN last_timestamp IS NULL THEN CAST(-1 AS FLOAT) ELSE {_clamped("km_from_current / 1000")} END AS s1,
  {_RISK} AS s2,
  CASE WHEN last_timestamp IS NULL THEN CAST(-1 AS FLOAT) ELSE {_clamped(f"CAST({_MINUTES} AS DOUBLE) / 1440")} END AS s3,
  CAST(CASE WHEN merchant_known THEN 0 ELSE 1 END AS FLOAT) AS s4,
  {_clamped("CAST(tx_count_24h AS DOUBLE) / 20")} AS s5, {_clamped("km_from_home / 1000")} AS s6, {_clamped("amount / 10000")} AS s7, {_clamped("merchant_avg_amount / 10000")} AS s8,
  CAST(CASE WHEN is_online THEN 1 ELSE 0 END AS FLOAT) AS s9, CAST(CASE WHEN card_present THEN 1 ELSE 0 END AS FLOAT) AS s10,
  CAST(CAST(hour(requested_at) AS DOUBLE) / 23 AS FLOAT) AS s11, CAST(CAST(isodow(requested_at) - 1 AS DOUBLE) / 6 AS FLOAT) AS s12,
  {_clamped("CAST(installments AS DOUBLE) / 12")} AS s13,
  (NOT merchant_known AND is_online AND NOT card_present AND tx_count_24h <= 4 AND hour(requested_at) <= 6 AND customer_avg_amount > 0 AND amount / customer_avg_amount >= 9) AS borderline
  FROM tx)"""
_QUANTIZED = ", ".join(f"CASE WHEN {s} < 0 THEN 65535 ELSE CAST(round(CAST({s} * CAST(65534 AS FLOAT) AS DOUBLE)) AS INTEGER) END AS {s}" for s in SLOTS)
_DEQUANTIZED = ", ".join(f"CASE WHEN {s} = 65535 THEN CAST(-1 AS FLOAT) ELSE CAST({s} AS FLOAT) * CAST(CAST(1 AS DOUBLE) / 65534 AS FLOAT) END AS {s}" for s in SLOTS)


def _gap(a: str, b: Callable[[int], str]) -> str:
    return " + ".join(f"({a}.s{i} - {b(i)}) * ({a}.s{i} - {b(i)})" for i in range(scalar.DIM))


_REFS = f"""
q AS (SELECT tx_id AS qid, * EXCLUDE (tx_id) FROM f WHERE tx_id % 20 = 0),
u AS (SELECT tx_id AS ref_id, label, {_QUANTIZED} FROM f),
r AS (SELECT ref_id, label, {_DEQUANTIZED} FROM u)"""
_NEAREST = f"""
pairs AS (SELECT q.qid, r.ref_id, r.label, {_gap("q", lambda i: f"r.s{i}")} AS d FROM q CROSS JOIN r),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id) AS rank FROM pairs) WHERE rank <= 5),
counted AS (SELECT q.qid, q.borderline, q.label, CAST(coalesce(n.fc, 0) AS INTEGER) AS fraud_count FROM q LEFT JOIN (SELECT qid, sum(label) AS fc FROM nn GROUP BY qid) n USING (qid))"""
_CENTRES = f"""
ranked AS (SELECT *, row_number() OVER (ORDER BY ref_id) - 1 AS nth_ref, count(*) OVER () AS n FROM r),
c AS (SELECT CAST(i AS INTEGER) AS list_id, {", ".join(f"s{i} AS c{i}" for i in range(scalar.DIM))} FROM range({NLIST}) t(i) JOIN ranked ON nth_ref = i * n // {NLIST})"""
_LISTS = f"""{_CENTRES},
spread AS (SELECT r.*, c.list_id, {_gap("r", lambda i: f"c.c{i}")} AS d FROM r CROSS JOIN c),
a AS (SELECT * EXCLUDE (nth), CAST(sqrt(CAST(d AS DOUBLE)) AS FLOAT) AS radius FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY d, list_id) AS nth FROM spread) WHERE nth = 1),
placed AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY list_id ORDER BY radius, ref_id) - 1) / {BLOCK}.0) AS INTEGER) AS block_id FROM a),
lists AS (SELECT list_id, count(*) AS n, max(radius) AS radius, CAST(ceil(count(*) / {BLOCK}.0) AS BIGINT) AS blocks FROM a GROUP BY list_id),
blocks AS (SELECT list_id, block_id, min(radius) AS min_radius, max(radius) AS max_radius, count(*) AS n FROM placed GROUP BY ALL)"""
_PLANNED = f"""
cd AS (SELECT q.qid, c.list_id, CAST(sqrt(CAST({_gap("q", lambda i: f"c.c{i}")} AS DOUBLE)) AS FLOAT) AS cd FROM q CROSS JOIN c),
probes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cd, list_id) AS rank FROM cd) WHERE rank <= {NPROBE}),
rest AS (SELECT * FROM cd ANTI JOIN probes USING (qid, list_id))"""
_PROBES = f"""{_PLANNED},
seen AS (SELECT p.qid, a.ref_id, {_gap("q", lambda i: f"a.s{i}")} AS d FROM probes p JOIN q USING (qid) JOIN a USING (list_id)),
tau AS (SELECT q.qid, coalesce(t.d, CAST('inf' AS DOUBLE)) AS tau FROM q LEFT JOIN (SELECT qid, CAST(d AS DOUBLE) AS d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id) AS rank FROM seen) WHERE rank = 5) t USING (qid)),
candidate AS (SELECT rest.qid, rest.list_id, rest.cd, tau.tau FROM rest JOIN lists USING (list_id) JOIN tau USING (qid) WHERE rest.cd - lists.radius <= sqrt(tau) + 0.00001),
window_blocks AS (SELECT k.qid, k.list_id, b.block_id, b.n FROM candidate k JOIN blocks b USING (list_id) WHERE b.max_radius >= k.cd - (sqrt(tau) + 0.00001) AND b.min_radius <= k.cd + sqrt(tau) + 0.00001)"""


def _with(select: str, *parts: str, hot: bool = False) -> str:
    return "WITH " + ",".join([_tx_sql(hot), *parts]) + "\n" + select


_SLOT_DOUBLES = ", ".join(f"CAST({s} AS DOUBLE) AS {s}" for s in SLOTS)

# Features and scalar functions ----------------------------------------------


@query(_with("SELECT * EXCLUDE (requested_at, last_timestamp), epoch_us(requested_at) AS requested_us, epoch_us(last_timestamp) AS last_us FROM tx"))
def transaction_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.transactions(spark, sf_dir)
    return t.withColumns({"requested_us": F.unix_micros("requested_at"), "last_us": F.unix_micros("last_timestamp")}).drop("requested_at", "last_timestamp")


@query(_with(f"SELECT tx_id, label, {_SLOT_DOUBLES}, borderline FROM f", _FEATURES))
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("tx_id", "label", *_doubles(SLOTS), "borderline")


@query(f"SELECT event_id, CAST({_clamped('value / 100')} AS DOUBLE) AS clamped, CAST({_clamped('(value - 250) / 100')} AS DOUBLE) AS shifted FROM events")
def clamp_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select("event_id", scalar.clamp01(F.col("value") / 100).cast("double").alias("clamped"), scalar.clamp01((F.col("value") - 250) / 100).cast("double").alias("shifted"))


@query(_with(f"SELECT tx_id, mcc, CAST({_RISK} AS DOUBLE) AS risk FROM tx"))
def mcc_risk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.transactions(spark, sf_dir).select("tx_id", "mcc", scalar.mcc_risk(F.col("mcc")).cast("double").alias("risk"))


@query(_with(f"SELECT tx_id, mcc, CAST({_RISK} AS DOUBLE) AS risk FROM tx"))
def mcc_risk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar.join_mcc_risk(tx.transactions(spark, sf_dir)).select("tx_id", "mcc", F.col("mcc_risk").cast("double").alias("risk"))


@query(_with("SELECT tx_id, CAST(s0 AS DOUBLE) AS ratio FROM f", _FEATURES, hot=True))
def amount_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, hot=True).select("tx_id", F.col("s0").cast("double").alias("ratio"))


@query(_with("SELECT tx_id, hour(requested_at) AS hour, isodow(requested_at) - 1 AS weekday, date_diff('day', DATE '1970-01-01', CAST(requested_at AS DATE)) AS epoch_day FROM tx"))
def hour_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("requested_at")
    return tx.transactions(spark, sf_dir).select("tx_id", F.hour(t).cast("long").alias("hour"), scalar.weekday_monday0(t).cast("long").alias("weekday"), scalar.epoch_days(t).cast("long").alias("epoch_day"))


@query(_with(f"SELECT tx_id, CASE WHEN last_timestamp IS NOT NULL THEN {_MINUTES} END AS minutes FROM tx"))
def minutes_since_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.transactions(spark, sf_dir).select("tx_id", F.when(F.col("last_timestamp").isNotNull(), features.minutes_since_last()).alias("minutes"))


@query(_with("SELECT tx_id, merchant_known FROM tx"))
def known_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership as a semi-join with the customer's earlier merchants."""
    t = kept(tx.transactions(spark, sf_dir), "transactions")
    first = t.groupBy("customer_id", "merchant_id").agg(F.min(F.struct("requested_at", "tx_id")).alias("first"))
    return t.join(first, ["customer_id", "merchant_id"]).select("tx_id", (F.col("first.tx_id") != F.col("tx_id")).alias("merchant_known"))


@query("SELECT event_id, event_type = 'purchase' AS is_purchase FROM events")
def names_ignoring_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in another case than the one that is looked for."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", scalar.equal_ignoring_case(F.initcap("event_type"), F.lit("PURCHASE")).alias("is_purchase"))


@query(_with(f"SELECT tx_id, {', '.join(SLOTS)} FROM (SELECT tx_id, {_QUANTIZED} FROM f)", _FEATURES))
def quantize_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("tx_id", *[scalar.quantize(F.col(s)).alias(s) for s in SLOTS])


@query(_with(f"SELECT ref_id, {_SLOT_DOUBLES} FROM r", _FEATURES, _REFS))
def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.decoded(_inputs(spark, sf_dir)[1]).select("ref_id", *_doubles(SLOTS))


@query(_with(f"SELECT slot, round(max(abs(CAST(a AS DOUBLE) - CAST(b AS DOUBLE))), 9) AS worst, count(*) AS n FROM ({' UNION ALL '.join(f'''SELECT 's{i}' AS slot, f.s{i} AS a, r.s{i} AS b FROM f JOIN r ON f.tx_id = r.ref_id''' for i in range(scalar.DIM))}) GROUP BY slot", _FEATURES, _REFS))
def quant_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    gaps = f.select(F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.abs(F.col(s).cast("double") - scalar.dequantize(scalar.quantize(F.col(s))).cast("double")).alias("gap")) for s in SLOTS])).alias("x"))
    return gaps.groupBy("x.slot").agg(F.round(F.max("x.gap"), 9).alias("worst"), F.count("*").alias("n"))


@query(_with("SELECT tx_id, borderline, CASE WHEN tx_id % 6 = 2 AND borderline THEN 3 ELSE CAST(tx_id % 6 AS INTEGER) END AS final_count FROM f", _FEATURES, hot=True))
def borderline_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir, hot=True).select("tx_id", "borderline", (F.col("tx_id") % 6).cast("int").alias("fraud_count"))
    return f.select("tx_id", "borderline", decide.overridden(F.col("fraud_count"), F.col("borderline")).alias("final_count"))


# Payloads -------------------------------------------------------------------

_PARSED = "tx_id, amount, installments, customer_avg_amount, tx_count_24h, merchant_id, merchant_known, mcc, merchant_avg_amount, is_online, card_present, km_from_home, km_from_current"


@query(_with(f"SELECT {_PARSED}, epoch(date_trunc('second', requested_at)) AS requested_s FROM tx"))
def payload_parse_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse.parse(tx.payload_json(tx.transactions(spark, sf_dir)))
    return parsed.filter("valid").select(*_PARSED.split(", "), F.unix_seconds("requested_at").cast("double").alias("requested_s"))


_BREAKS = [
    ("no_section", lambda p: F.regexp_replace(p, '"terminal"', '"terminals"')),
    ("short_mcc", lambda p: F.regexp_replace(p, '"mcc":"....', '"mcc":"541')),
    ("real_count", lambda p: F.regexp_replace(p, '"installments":([0-9]+)', '"installments":$1.0')),
    ("no_zone", lambda p: F.regexp_replace(p, 'Z"', '"')),
    ("long_merchant", lambda p: F.regexp_replace(p, '"id":"MERC-', '"id":"MERC-0123456789012345678901234567-')),
    ("comma", lambda p: F.concat(F.expr("left(payload, length(payload) - 1)"), F.lit(",}"))),
    ("whole", lambda p: p),
]


@query(_with(f"SELECT tx_id, list_extract([{', '.join(repr(n) for n, _ in _BREAKS)}], CAST(tx_id % {len(_BREAKS)} AS INTEGER) + 1) AS broken, 400 AS status, 'invalid payload' AS error FROM tx WHERE tx_id % {len(_BREAKS)} <> {len(_BREAKS) - 1}"))
def payload_parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads damaged in six ways, and whole ones, which aren't among the rejects."""
    p = tx.payload_json(tx.transactions(spark, sf_dir))
    kind = F.col("tx_id") % len(_BREAKS)
    payload, broken = F.col("payload"), F.lit("whole")
    for i, (name, damage) in enumerate(_BREAKS):
        payload, broken = F.when(kind == i, damage(F.col("payload"))).otherwise(payload), F.when(kind == i, F.lit(name)).otherwise(broken)
    parsed = parse.parse(p.select("tx_id", broken.alias("broken"), payload.alias("payload")))
    return parse.rejects(parsed).select("tx_id", "broken", "status", "error")


@query(
    "SELECT event_id, CASE WHEN event_type = 'view' THEN 'ready' WHEN event_type = 'purchase' THEN 'score' ELSE 'unknown' END AS route,"
    " CASE WHEN event_type = 'view' THEN 204 WHEN event_type <> 'purchase' THEN 404 WHEN strlen(props) * 2000 > 16384 THEN 413 END AS status FROM events"
)
def request_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and early outcomes of requests whose bodies are events' properties, repeated until some are too large."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "props")
    method = F.when(F.col("event_type") == "view", "GET").otherwise("POST")
    path = F.when(F.col("event_type") == "view", "/ready").when(F.col("event_type") == "purchase", "/fraud-score").otherwise("/else")
    route = parse.route(method, path)
    return ev.select("event_id", route.alias("route"), parse.request_status(route, F.repeat("props", 2000)).alias("status"))


# Neighbours and decisions ---------------------------------------------------

_NN = "SELECT qid, rank, ref_id, label, CAST(d AS DOUBLE) AS d FROM nn"


def _nn(found: DataFrame) -> DataFrame:
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "ref_id", "label", F.col("d").cast("double").alias("d"))


@query(_with(_NN, _FEATURES, _REFS, _NEAREST))
def knn_top5_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nn(knn.kernel(*_inputs(spark, sf_dir)))


@query(_with(_NN, _FEATURES, _REFS, _NEAREST))
def knn_exact_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nn(knn.joined(*_inputs(spark, sf_dir)))


@query(_with(_NN, _FEATURES, _REFS, _NEAREST))
def knn_ivf_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = _inputs(spark, sf_dir)
    return _nn(knn.ivf(queries, _index(refs), nprobe=NPROBE))


_COUNTS = "SELECT qid, fraud_count FROM counted"


@query(_with(_COUNTS, _FEATURES, _REFS, _NEAREST))
def knn_fraud_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = _inputs(spark, sf_dir)
    return knn.fraud_counts(knn.kernel(queries, refs), queries)


@query(_with(_COUNTS, _FEATURES, _REFS, _NEAREST))
def knn_ivf_fraud_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = _inputs(spark, sf_dir)
    return knn.fraud_counts(knn.ivf(queries, _index(refs), nprobe=NPROBE), queries)


_DECIDED = """
decided AS (SELECT qid, label, fraud_count, CASE WHEN fraud_count = 2 AND borderline THEN 3 ELSE fraud_count END AS final_count FROM counted)"""


@query(_with("SELECT qid, fraud_count, final_count, final_count / CAST(5 AS DOUBLE) AS fraud_score, final_count < 3 AS approved FROM decided", _FEATURES, _REFS, _NEAREST, _DECIDED))
def fraud_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = _inputs(spark, sf_dir)
    counted = knn.fraud_counts(knn.kernel(queries, refs), queries).join(queries.select("qid", "borderline"), "qid")
    return decide.decide(counted).select("qid", "fraud_count", "final_count", "fraud_score", "approved")


@query(
    _with(
        """SELECT qid, 200 AS status, final_count < 3 AS approved, '{"approved":' || (final_count < 3) || ',"fraud_score":' || (final_count / CAST(5 AS DOUBLE)) || '}' AS response FROM decided""",
        _FEATURES,
        _REFS,
        _NEAREST,
        _DECIDED,
    )
)
def score_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: JSON in, response out. Test payloads have whole seconds, and so have the events."""
    t = tx.transactions(spark, sf_dir)
    _, refs = _inputs(spark, sf_dir)
    payloads = tx.payload_json(t.filter(tx.is_query())).withColumnRenamed("tx_id", "qid")
    return score.score_payloads(payloads, "qid", refs).select("qid", "status", "approved", "response")


@query(
    "WITH p AS (SELECT q.vec_id AS q_id, r.vec_id AS r_id, list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d"
    " FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)"
    " SELECT q_id, rank, r_id, round(d, 9) AS d FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, r_id) AS rank FROM p) WHERE rank <= 5"
)
def knn_embeddings_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = knn.array_neighbours(e.filter("vec_id % 20 = 0"), e)
    return found.select("q_id", F.col("rank").cast("long").alias("rank"), "r_id", F.round("d", 9).alias("d"))


# Index ----------------------------------------------------------------------


@query(_with("SELECT ref_id, list_id, round(CAST(radius AS DOUBLE), 6) AS radius FROM a", _FEATURES, _REFS, _LISTS))
def centroid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = kept(index.decoded(_inputs(spark, sf_dir)[1]), "points")
    found = index.assign(points, index.spaced_centroids(points, NLIST))
    return found.select("ref_id", "list_id", F.round(F.col("radius").cast("double"), 6).alias("radius"))


@query(_with("SELECT list_id, " + ", ".join(f"round(avg(CAST(s{i} AS DOUBLE)), 4) AS c{i}" for i in range(scalar.DIM)) + ", count(*) AS n FROM a GROUP BY list_id", _FEATURES, _REFS, _LISTS))
def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = kept(index.decoded(_inputs(spark, sf_dir)[1]), "points")
    step = index.lloyd_step(points, kept(index.spaced_centroids(points, NLIST), "centroids")).filter("n > 0")
    return step.select("list_id", *[F.round(F.col(f"c{i}").cast("double"), 4).alias(f"c{i}") for i in range(scalar.DIM)], "n")


@query(_with("SELECT list_id, n, round(CAST(radius AS DOUBLE), 6) AS radius, blocks FROM lists", _FEATURES, _REFS, _LISTS))
def list_sizes_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(_inputs(spark, sf_dir)[1]).lists.select("list_id", "n", F.round(F.col("radius").cast("double"), 6).alias("radius"), "blocks")


@query(
    _with(
        "SELECT list_id, n, blocks, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS first, CAST(coalesce(sum(blocks) OVER w, 0) AS BIGINT) AS first_block FROM lists WINDOW w AS (ORDER BY list_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        _FEATURES,
        _REFS,
        _LISTS,
    )
)
def list_offsets_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.list_offsets(_index(_inputs(spark, sf_dir)[1]).lists)


@query(_with("SELECT CAST(max(n) AS BIGINT) AS largest_list, CAST(sum(n) AS BIGINT) AS vectors, count(*) AS lists FROM lists", _FEATURES, _REFS, _LISTS))
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.totals(_index(_inputs(spark, sf_dir)[1]).lists)


@query(_with("SELECT list_id, block_id, round(CAST(min_radius AS DOUBLE), 6) AS min_radius, round(CAST(max_radius AS DOUBLE), 6) AS max_radius, n FROM blocks", _FEATURES, _REFS, _LISTS))
def block_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _index(_inputs(spark, sf_dir)[1]).blocks
    return b.select("list_id", "block_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("min_radius", "max_radius")], "n")


@query(_with("SELECT list_id, blocks FROM lists", _FEATURES, _REFS, _LISTS))
def blocks_per_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(_inputs(spark, sf_dir)[1]).blocks.groupBy("list_id").agg(F.count("*").alias("blocks"))


@query(_with("SELECT qid, list_id, rank FROM probes", _FEATURES, _REFS, _CENTRES, _PLANNED))
def probe_lists_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = _inputs(spark, sf_dir)
    return knn.probe_lists(queries, _centroids_alone(refs), NPROBE).select("qid", "list_id", F.col("rank").cast("long").alias("rank"))


@query(_with("SELECT ref_id, list_id, block_id, CAST(row_number() OVER (PARTITION BY list_id ORDER BY radius, ref_id) - 1 AS INTEGER) AS place FROM placed", _FEATURES, _REFS, _LISTS))
def list_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each reference lies: its list, and its block and place there by distance to the centroid."""
    return _index(_inputs(spark, sf_dir)[1]).vectors.select("ref_id", "list_id", "block_id", "place")


@query(_with("SELECT qid, list_id FROM rest", _FEATURES, _REFS, _CENTRES, _PLANNED))
def unprobed_lists_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = _inputs(spark, sf_dir)
    built = _centroids_alone(refs)
    return knn.unprobed(queries, built, kept(knn.probe_lists(queries, built, NPROBE), "probes")).select("qid", "list_id")


@query(_with("SELECT qid, list_id, round(pow(greatest(CAST(cd - radius AS DOUBLE), 0), 2), 6) AS bound_sq FROM rest JOIN lists USING (list_id)", _FEATURES, _REFS, _LISTS, _PLANNED))
def list_lower_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least squared distance from each query to a member of each list that it hasn't probed."""
    queries, refs = _inputs(spark, sf_dir)
    built = _index(refs)
    rest = knn.unprobed(queries, built, kept(knn.probe_lists(queries, built, NPROBE), "probes"))
    bounded = rest.join(F.broadcast(built.lists.select("list_id", "radius")), "list_id")  # a row a list
    return bounded.select("qid", "list_id", F.round(scalar.lower_bound_sq(F.col("cd"), F.col("radius")), 6).alias("bound_sq"))


@query(_with("SELECT qid, list_id FROM candidate", _FEATURES, _REFS, _LISTS, _PROBES))
def candidate_lists_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = _inputs(spark, sf_dir)
    return knn.ivf_steps(queries, _index(refs), nprobe=NPROBE)["lists"].select("qid", "list_id")


@query(_with("SELECT qid, list_id, block_id FROM window_blocks", _FEATURES, _REFS, _LISTS, _PROBES))
def block_window_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = _inputs(spark, sf_dir)
    return knn.ivf_steps(queries, _index(refs), nprobe=NPROBE)["blocks"].select("qid", "list_id", "block_id")


@query(
    _with(
        f"""SELECT q.qid, CAST(coalesce(p.l, 0) AS BIGINT) AS lists_probed, CAST(coalesce(p.v, 0) AS BIGINT) AS vectors_probed, {NLIST} - coalesce(p.l, 0) AS lists_considered, {NLIST} - coalesce(p.l, 0) - coalesce(k.l, 0) AS lists_pruned, coalesce(k.l, 0) AS lists_candidate, coalesce(w.b, 0) AS blocks_candidate, CAST(coalesce(w.v, 0) AS BIGINT) AS vectors_candidate
FROM q LEFT JOIN (SELECT qid, count(*) AS l, sum(n) AS v FROM probes JOIN lists USING (list_id) GROUP BY qid) p USING (qid)
LEFT JOIN (SELECT qid, count(*) AS l FROM candidate GROUP BY qid) k USING (qid)
LEFT JOIN (SELECT qid, count(*) AS b, sum(n) AS v FROM window_blocks GROUP BY qid) w USING (qid)""",
        _FEATURES,
        _REFS,
        _LISTS,
        _PROBES,
    )
)
def prune_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = _inputs(spark, sf_dir)
    return knn.prune_profile(queries, _index(refs), nprobe=NPROBE)


@query(
    _with(
        """SELECT count(*) AS queries, round(avg(coalesce(p.l, 0)), 4) AS lists_probed, round(avg(coalesce(p.v, 0)), 4) AS vectors_probed, round(avg(coalesce(k.l, 0)), 4) AS lists_candidate,
round(avg(coalesce(w.b, 0)), 4) AS blocks_candidate, round(avg(coalesce(w.v, 0)), 4) AS vectors_candidate
FROM q LEFT JOIN (SELECT qid, count(*) AS l, sum(n) AS v FROM probes JOIN lists USING (list_id) GROUP BY qid) p USING (qid)
LEFT JOIN (SELECT qid, count(*) AS l FROM candidate GROUP BY qid) k USING (qid)
LEFT JOIN (SELECT qid, count(*) AS b, sum(n) AS v FROM window_blocks GROUP BY qid) w USING (qid)""",
        _FEATURES,
        _REFS,
        _LISTS,
        _PROBES,
    )
)
def prune_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = _inputs(spark, sf_dir)
    averages = knn.profile_report(knn.prune_profile(queries, _index(refs), nprobe=NPROBE))
    return averages.select("queries", *[F.round(c, 4).alias(c) for c in ("lists_probed", "vectors_probed", "lists_candidate", "blocks_candidate", "vectors_candidate")])


@query(_with(_NN, _FEATURES, _REFS, _NEAREST))
def knn_ivf_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = _inputs(spark, sf_dir)
    return _nn(knn.ivf(queries, _index(refs), nprobe=NPROBE, adaptive=True))


@query(_with(_NN, _FEATURES, _REFS, _NEAREST))
def knn_trained_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained index, written, opened again and searched: the result doesn't depend on its centroids."""
    queries, refs = _inputs(spark, sf_dir)
    built = index_store.build(kept(refs, "references"), NLIST, BLOCK, iterations=4)
    path = f"{shared_dir(spark)}/written-index-{uuid.uuid4().hex}"
    index_store.write(built, path)
    built.close()
    if not index_store.ready(spark, path):
        raise ValueError(f"no index at {path}")
    return _nn(knn.ivf(queries, index_store.open_index(spark, path), nprobe=NPROBE))


@query(_with(f"SELECT label, {', '.join(SLOTS)} FROM u", _FEATURES, _REFS))
def gzip_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions as one gzipped JSON array of labelled vectors, read back and packed."""
    vector = F.array(*[F.col(f"s{scalar.SPEC_OF_SLOT.index(i)}").cast("double") for i in range(scalar.DIM)])
    rows = _features(spark, sf_dir).select(F.struct(vector.alias("vector"), F.when(F.col("label") == 1, readers.FRAUD).otherwise("legit").alias("label")).alias("r"))
    path = f"{shared_dir(spark)}/references-{uuid.uuid4().hex}"
    readers.write_array(rows.select(F.to_json("r").alias("value")), path)
    return readers.read_references(spark, path).select("label", *SLOTS)


@query(_with("SELECT tx_id, 200 AS status, final_count < 3 AS approved FROM (SELECT qid AS tx_id, final_count FROM decided)", _FEATURES, _REFS, _NEAREST, _DECIDED))
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set's payloads as a stream of files, each request answered."""
    _, refs = _inputs(spark, sf_dir)
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    tx.payload_json(tx.transactions(spark, sf_dir).filter(tx.is_query())).select("payload").repartition(3).write.text(f"{root}/in")
    scoring.score_stream(readers.read_payload_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint", kept(refs, "references")).awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.substring("tx", 4, 20).cast("long").alias("tx_id"), "status", "approved")


SAMPLE_ROWS = 500


@query(_with(f"SELECT ref_id FROM r ORDER BY md5('1:' || ref_id), ref_id LIMIT {SAMPLE_ROWS}", _FEATURES, _REFS))
def reservoir_sample_exact_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.sample_exact(_inputs(spark, sf_dir)[1], SAMPLE_ROWS).select("ref_id")


_SLOT_AVERAGES = ", ".join(f"CAST(avg(CAST(s{i} AS DOUBLE)) AS FLOAT) AS c{i}" for i in range(scalar.DIM))


def _trained(iterations: int) -> str:
    """Lloyd's iterations, one after the other; a list that nothing is nearest to would be missing from the result."""
    steps = []
    for n in range(iterations):
        old = "c" if n == 0 else f"k{n}"
        near = f"SELECT r.*, t.list_id, row_number() OVER (PARTITION BY r.ref_id ORDER BY {_gap('r', lambda i: f't.c{i}')}, t.list_id) AS nth FROM r CROSS JOIN {old} t"
        steps.append(f"k{n + 1} AS MATERIALIZED (SELECT list_id, {_SLOT_AVERAGES} FROM ({near}) WHERE nth = 1 GROUP BY list_id)")
    return ",\n".join(steps)


@query(_with("SELECT list_id, " + ", ".join(f"round(CAST(c{i} AS DOUBLE), 3) AS c{i}" for i in range(scalar.DIM)) + f" FROM k{index.ITERATIONS}", _FEATURES, _REFS, _CENTRES, _trained(index.ITERATIONS)))
def kmeans_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained centroids, to three places, as sums of floats depend on their order."""
    points = kept(index.decoded(_inputs(spark, sf_dir)[1]), "points")
    trained = index.kmeans(points, NLIST)
    return trained.select("list_id", *[F.round(F.col(f"c{i}").cast("double"), 3).alias(f"c{i}") for i in range(scalar.DIM)])


# Evaluation -----------------------------------------------------------------


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, refs = _inputs(spark, sf_dir)
    counted = knn.fraud_counts(knn.kernel(queries, refs), queries).join(queries.select("qid", "borderline", "label"), "qid")
    return decide.decide(counted).withColumn("expected_approved", F.col("label") == 0)


_CONFUSION = """
counts AS (SELECT count(*) FILTER (final_count >= 3 AND label = 1) AS tp, count(*) FILTER (final_count < 3 AND label = 0) AS tn, count(*) FILTER (final_count >= 3 AND label = 0) AS fp,
  count(*) FILTER (final_count < 3 AND label = 1) AS fn, CAST(0 AS BIGINT) AS errors FROM decided)"""


@query(_with("SELECT * FROM counts", _FEATURES, _REFS, _NEAREST, _DECIDED, _CONFUSION))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_outcomes(spark, sf_dir))


_DETECTION = """
weighed AS (SELECT *, tp + tn + fp + fn + errors AS n, fp + 3 * fn + 5 * errors AS weighted_errors FROM counts),
rated AS (SELECT *, (fp + fn + errors) / CAST(n AS DOUBLE) AS failure_rate, weighted_errors / CAST(n AS DOUBLE) AS epsilon FROM weighed)"""


@query(
    _with(
        "SELECT tp, tn, fp, fn, errors, n, weighted_errors, round(failure_rate, 6) AS failure_rate, round(epsilon, 6) AS epsilon, failure_rate > 0.15 AS detection_cut,"
        " round(CASE WHEN failure_rate > 0.15 THEN -3000 ELSE 1000 * log10(1 / greatest(epsilon, 0.001)) - 300 * log10(1 + weighted_errors) END, 4) AS detection_score FROM rated",
        _FEATURES,
        _REFS,
        _NEAREST,
        _DECIDED,
        _CONFUSION,
        _DETECTION,
    )
)
def detection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.detection(evaluate.confusion(_outcomes(spark, sf_dir)))
    return out.withColumns({"failure_rate": F.round("failure_rate", 6), "epsilon": F.round("epsilon", 6), "detection_score": F.round("detection_score", 4)})


@query(
    _with(
        "SELECT tp, fp, fn, round(p99, 6) AS p99, round(s, 4) AS p99_score, round(g, 4) AS detection_score, round(s + g, 2) AS final_score FROM (SELECT *, CASE WHEN failure_rate > 0.15 THEN -3000 ELSE 1000 * log10(1 / greatest(epsilon, 0.001)) - 300 * log10(1 + weighted_errors) END AS g,"
        " CASE WHEN p99 <= 0 THEN 0 WHEN p99 > 2000 THEN -3000 ELSE 1000 * log10(1000 / greatest(p99, 1)) END AS s FROM rated, (SELECT quantile_cont(value, 0.99) AS p99 FROM events))",
        _FEATURES,
        _REFS,
        _NEAREST,
        _DECIDED,
        _CONFUSION,
        _DETECTION,
    )
)
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores and their sum; events' values stand for latencies."""
    out = evaluate.summary(evaluate.confusion(_outcomes(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("value").alias("latency_ms")))
    return out.select("tp", "fp", "fn", F.round("p99", 6).alias("p99"), F.round("p99_score", 4).alias("p99_score"), F.round("detection_score", 4).alias("detection_score"), "final_score")


@query("SELECT round(p99, 6) AS p99, round(CASE WHEN p99 <= 0 THEN 0 WHEN p99 > 2000 THEN -3000 ELSE 1000 * log10(1000 / greatest(p99, 1)) END, 4) AS p99_score FROM (SELECT quantile_cont(value, 0.99) AS p99 FROM events)")
def latency_p99_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return evaluate.latency(ev, "value").select(F.round("p99", 6).alias("p99"), F.round("p99_score", 4).alias("p99_score"))


@query(_with("SELECT count(*) AS total, count(*) FILTER (label = 1) AS fraud_count, count(*) FILTER (label = 0) AS legit_count, count(*) FILTER (borderline) AS edge_case_count, round(count(*) FILTER (label = 1) / CAST(count(*) AS DOUBLE), 6) AS fraud_rate, round(count(*) FILTER (label = 0) / CAST(count(*) AS DOUBLE), 6) AS legit_rate, round(count(*) FILTER (borderline) / CAST(count(*) AS DOUBLE), 6) AS edge_case_rate FROM f", _FEATURES, hot=True))
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.dataset_stats(_features(spark, sf_dir, hot=True), F.col("label") == 1, F.col("borderline"))
