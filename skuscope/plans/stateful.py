"""Registered queries of streams that keep state by key, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skuscope.operators import fitment as fi
from skuscope.plans import tables as d
from skuscope.plans.catalogue import CA, FY, registered
from skuscope.sources.scratch import shared_path, stored
from skuscope.streaming import state


def in_turns(spark: SparkSession, parts: list[DataFrame], job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a streaming job appends when `parts` come in one after the other; it is started anew from its checkpoint for each."""
    source, out, check = (shared_path(spark, f"{name}{x}") for x in ("-source", "", "-checkpoint"))
    for part in parts:
        part.write.mode("append").parquet(source)
        with state.rocksdb(spark):
            stream = job(spark.readStream.schema(part.schema).parquet(source))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@registered(
    """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id % 20 = 0 AS late FROM events), w AS (SELECT max(ms) - 3600000 AS w FROM e WHERE NOT late),
x AS (SELECT user_id, ms, CASE WHEN lag(ms) OVER o IS NULL OR ms >= lag(ms) OVER o + 21600000 THEN 1 ELSE 0 END AS f FROM e WHERE NOT late WINDOW o AS (PARTITION BY user_id ORDER BY ms)),
y AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM x),
z AS (SELECT user_id, min(ms) AS a, max(ms) + 21600000 AS b, count(*) AS n FROM y GROUP BY user_id, s HAVING max(ms) + 21600000 <= (SELECT w FROM w)),
l AS (SELECT e.user_id, e.ms, CASE WHEN ms + 21600000 <= w THEN 'its time has passed' WHEN EXISTS (SELECT 1 FROM z WHERE z.user_id = e.user_id AND e.ms > z.a - 21600000 AND e.ms < z.b) THEN 'its session is closed' END AS reason FROM e, w WHERE late)
SELECT user_id, 'session' AS kind, make_timestamp(a * 1000) AS start, make_timestamp(b * 1000) AS "end", n AS n_turns, NULL AS reason FROM z
UNION ALL SELECT user_id, 'late', make_timestamp(ms * 1000), make_timestamp(ms * 1000), 1, reason FROM l WHERE reason IS NOT NULL"""
)
def kept_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions out of a stream whose second part is late: one event in twenty comes when the watermark has passed most of them."""
    turns = d.read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = in_turns(spark, [turns.filter("event_id % 20 <> 0"), turns.filter("event_id % 20 = 0")], state.kept_sessions, "kept-sessions")
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return found.select("user_id", "kind", plain("start"), plain("end"), "n_turns", "reason")


def _round(k: int) -> str:
    """The tables of round k, after the tables of the round before: options, the open question, the pick and what it leaves."""
    return f"""yy{k} AS (SELECT session_id, y AS year, list_sort(list(DISTINCT sku)) AS skus FROM (SELECT session_id, sku, unnest(range(year_start, year_end + 1)) AS y FROM rows{k}) GROUP BY session_id, y),
yf{k} AS (SELECT *, CASE WHEN coalesce(lag(year) OVER w, -1) <> year - 1 OR lag(skus) OVER w <> skus THEN 1 ELSE 0 END AS fresh FROM yy{k} WINDOW w AS (PARTITION BY session_id ORDER BY year)),
yr{k} AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY year) AS run FROM yf{k}),
yo{k} AS (SELECT session_id, min(year) AS a, max(year) AS b, any_value(skus) AS skus FROM yr{k} GROUP BY session_id, run),
opt{k} AS (SELECT session_id, 'make' AS facet, make AS label, list_sort(list(DISTINCT sku)) AS skus, NULL AS a, NULL AS b FROM rows{k} GROUP BY session_id, make
 UNION ALL SELECT session_id, 'model', model, list_sort(list(DISTINCT sku)), NULL, NULL FROM rows{k} GROUP BY session_id, model
 UNION ALL SELECT session_id, 'mpn', mpn, list_sort(list(DISTINCT sku)), NULL, NULL FROM rem{k} WHERE mpn IS NOT NULL GROUP BY session_id, mpn
 UNION ALL SELECT session_id, 'brand', brand, list_sort(list(DISTINCT sku)), NULL, NULL FROM rem{k} GROUP BY session_id, brand
 UNION ALL SELECT session_id, 'year', CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, skus, a, b FROM yo{k}),
siz{k} AS (SELECT session_id, count(*) AS n, bool_and(sku IN (SELECT sku FROM fr)) AS all_fit FROM rem{k} GROUP BY session_id),
fac{k} AS (SELECT session_id, facet, count(*) AS n_options, max(len(skus)) AS worst, min(len(skus)) AS least FROM opt{k} GROUP BY session_id, facet),
use{k} AS (SELECT f.*, CASE f.facet WHEN 'make' THEN 1 WHEN 'model' THEN 2 WHEN 'year' THEN 3 WHEN 'mpn' THEN 4 ELSE 5 END AS ease FROM fac{k} f JOIN siz{k} s USING (session_id) ANTI JOIN asked{k} g ON f.session_id = g.session_id AND f.facet = g.facet WHERE s.n >= 2 AND n_options > 1 AND least < s.n AND (all_fit OR f.facet NOT IN ('make', 'model', 'year'))),
nxt{k} AS (SELECT session_id, arg_min(facet, ease) AS facet FROM use{k} GROUP BY session_id),
pick{k} AS (SELECT nxt{k}.session_id, nxt{k}.facet, (hash_ + {k}) % 4 AS kind FROM nxt{k} JOIN seed USING (session_id)),
num{k} AS (SELECT *, row_number() OVER (PARTITION BY session_id, facet ORDER BY a, label) - 1 AS i FROM opt{k}),
ch{k} AS (SELECT p.session_id, p.facet, n.label, n.skus, n.a, n.b FROM pick{k} p JOIN num{k} n ON n.session_id = p.session_id AND n.facet = p.facet AND n.i = CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 END),
asked{k + 1} AS (SELECT * FROM asked{k} UNION ALL SELECT session_id, facet FROM ch{k} UNION ALL SELECT session_id, facet FROM pick{k} WHERE kind = 2),
rem{k + 1} AS (SELECT r.* FROM rem{k} r LEFT JOIN ch{k} c USING (session_id) WHERE c.skus IS NULL OR list_contains(c.skus, r.sku)),
rows{k + 1} AS (SELECT r.* FROM rows{k} r SEMI JOIN rem{k + 1} m ON r.session_id = m.session_id AND r.sku = m.sku LEFT JOIN ch{k} c ON c.session_id = r.session_id WHERE c.facet IS NULL OR CASE c.facet WHEN 'make' THEN r.make = c.label WHEN 'model' THEN r.model = c.label WHEN 'year' THEN r.year_start <= c.b AND r.year_end >= c.a ELSE true END)"""


_PICKS = 4


@registered(
    f"""WITH {FY}, {CA}, seed AS (SELECT session_id, CAST(string_split(session_id, '-')[1] AS INT) AS hash_ FROM cand GROUP BY session_id), rem0 AS (SELECT session_id, sku, brand, similarity, mpn FROM cand), rows0 AS (SELECT c.session_id, f.* FROM cand c JOIN fr f USING (sku)), asked0 AS (SELECT session_id, '' AS facet FROM seed WHERE false),
{", ".join(_round(k) for k in range(_PICKS + 1))}, left_ AS (SELECT session_id, array_to_string(list(sku ORDER BY similarity DESC, sku), ',') AS remaining, count(*) AS n FROM rem{_PICKS} GROUP BY session_id), made AS (SELECT session_id, count(*) AS n_turns FROM asked{_PICKS} GROUP BY session_id)
SELECT seed.session_id, CASE WHEN n = 1 THEN 'resolved' WHEN q.facet IS NOT NULL THEN 'asking' ELSE 'exhausted' END AS status, CAST(coalesce(n, 0) AS INT) AS n_remaining, coalesce(remaining, '') AS remaining, q.facet, coalesce(n_turns, 0) AS n_turns FROM seed LEFT JOIN left_ USING (session_id) LEFT JOIN nxt{_PICKS} q USING (session_id) LEFT JOIN made USING (session_id)"""
)
def question_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where sessions stand after four picks, two of them before the stream is started anew: first or second option, skip, or an option that isn't there."""
    candidates = d.candidates(spark, sf_dir)
    ranges = fi.collapse_fitment_years(d.fitment_years(spark, sf_dir))
    seeds = stored(state.session_seeds(candidates, candidates.select("session_id", "sku").join(ranges, "sku")), "seeds")
    kind = (F.split("session_id", "-")[0].cast("int") + F.col("seq")) % 4
    numbered = seeds.select("session_id", F.explode(F.sequence(F.lit(0), F.lit(_PICKS - 1))).alias("seq"))
    option = F.when(kind == 3, 999).when(kind != 2, kind).cast("int")
    picks = numbered.select("session_id", "seq", (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60)).alias("ts"), option.alias("option"), (kind == 2).alias("skip"))
    made = in_turns(spark, [picks.filter("seq < 2"), picks.filter("seq >= 2")], lambda x: state.question_rounds(x, seeds), "rounds")
    last = made.withColumn("r", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seq")))).filter("r = 1").select("session_id", "status", "n_remaining", "remaining", "facet")
    return last.join(made.groupBy("session_id").agg(F.count("turn_no").alias("n_turns")), "session_id")
