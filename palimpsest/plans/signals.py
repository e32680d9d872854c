"""Signal channels, power intervals and near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import PruneConfig
from palimpsest.functions import text as T
from palimpsest.operators import neardup, power, scans
from palimpsest.operators import signals as G
from palimpsest.plans import sqltext as S
from palimpsest.plans.pruning import rounded
from palimpsest.plans.registry import query
from palimpsest.plans.scans import FLOOD, documents
from palimpsest.sources import tables


def signal_events(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "events").select(
        "event_id",
        (F.col("user_id") % 4).alias("bus"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") * 7919 % 1048576).cast("int").alias("flags"),
        (F.col("value") / 100.0).alias("intensity"),
    )


EVENTS = """WITH e AS (SELECT event_id, user_id % 4 AS bus, ts, (event_id * 7919 % 1048576)::INT AS flags, value / 100.0 AS intensity FROM events),
b AS (SELECT e.*, c::INT AS channel FROM e, range(0, 16) r(c) WHERE (flags >> c::INT) & 1 = 1)"""


@query("channel_concentrations", f"{EVENTS} SELECT bus, channel, round(sum(intensity), 6) AS concentration FROM b GROUP BY ALL")
def channel_concentrations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.concentrations(signal_events(spark, sf), ["bus"], 16), "concentration")


@query("channel_stats", f"""{EVENTS}, s AS (SELECT bus, count(*) AS secretions FROM e GROUP BY bus),
t AS (SELECT bus, round(sum(intensity), 6) AS total_concentration FROM b GROUP BY bus) SELECT * FROM s JOIN t USING (bus)""")
def channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.bus_stats(signal_events(spark, sf), ["bus"], 16), "total_concentration")


@query("channel_snapshot", f"""{EVENTS}, l AS (SELECT bus, channel, sum(intensity) AS c FROM b GROUP BY ALL)
SELECT bus, array_to_string(list(round(c, 2) ORDER BY channel), '|') AS levels FROM l GROUP BY bus""")
def channel_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.snapshot(G.concentrations(signal_events(spark, sf), ["bus"], 16), ["bus"], 16)
    shown = F.transform("levels", lambda v: F.round(v, 2).cast("string"))
    return rows.select("bus", F.array_join(shown, "|").alias("levels"))


@query("channel_sense", f"""{EVENTS}, l AS (SELECT bus, channel, sum(intensity) AS c FROM b GROUP BY ALL), m(mask_id, mask) AS (VALUES ('alert', 15), ('high', 65280), ('none', 1048576))
SELECT bus, mask_id, round(sum(CASE WHEN (mask >> channel) & 1 = 1 THEN c ELSE 0 END), 6) AS level FROM l, m GROUP BY ALL""")
def channel_sense(spark: SparkSession, sf: str) -> DataFrame:
    masks = {"alert": 15, "high": 65280, "none": 1048576}
    levels = G.concentrations(signal_events(spark, sf), ["bus"], 16)
    return rounded(G.sense(levels, masks, ["bus"]), "level")


@query("channel_dissipation", f"""{EVENTS}, m AS (SELECT max(floor(epoch(ts))::BIGINT // 86400) AS last FROM e)
SELECT bus, channel, round(sum(intensity * pow(0.9, last + 1 - floor(epoch(ts))::BIGINT // 86400)), 5) AS concentration FROM b, m GROUP BY ALL""")
def channel_dissipation(spark: SparkSession, sf: str) -> DataFrame:
    """Daily ticks up to the end of the last day with an event."""
    events = signal_events(spark, sf)
    day = F.floor(F.unix_seconds("ts") / 86400)
    last = F.broadcast(events.agg(F.max(day).alias("last")))  # one row
    out = G.dissipated(events.join(last), day, F.col("last") + 1, 0.9, ["bus"], 16)
    return rounded(out, "concentration", places=5)


@query("retained_events", f"""{EVENTS}, d AS (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY bus, ts::DATE ORDER BY ts, event_id) AS rn FROM e)
SELECT bus, event_id, flags FROM d WHERE rn <= 20""")
def retained_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal_events(spark, sf).withColumn("day", F.to_date("ts"))
    return G.retained(rows, ["bus", "day"], ["ts", "event_id"], 20).select("bus", "event_id", "flags")


@query("alert_levels", f"""{FLOOD}, a AS (SELECT least(score, 1.0) AS intensity FROM scored WHERE score >= 0.5)
SELECT c::INT AS channel, round(sum(intensity), 6) AS concentration FROM a, range(0, 4) r(c) GROUP BY ALL""")
def alert_levels(spark: SparkSession, sf: str) -> DataFrame:
    scores = scans.flood_scores(documents(spark, sf), "doc_id", threshold=0.5)
    return rounded(G.concentrations(scans.alert_events(scores)), "concentration")


def power_frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Event values as power samples per user, and four-day intervals with an idle draw, from the first sample to the last."""
    events = tables.table(spark, sf, "events")
    samples = events.select(
        F.col("user_id").alias("device"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.col("value").alias("watts"),
    )
    span = 4 * 86_400_000_000
    ends = samples.agg(F.floor(F.min("t") / span).alias("first"), F.floor(F.max("t") / span).alias("last")).filter("first IS NOT NULL")
    devices = samples.select("device").distinct().join(F.broadcast(ends))  # one row
    intervals = devices.withColumn("interval_id", F.explode(F.sequence("first", "last"))).select(
        "device",
        "interval_id",
        (F.col("interval_id") * span).alias("t0"),
        (F.col("interval_id") * span + span // 4 * 3).alias("t1"),
        (F.lit(2.0) + F.col("device") % 5).alias("idle_w"),
    )
    return samples, intervals


POWER = """WITH s AS (SELECT user_id AS device, epoch_us(ts) AS t, value AS watts, event_id FROM events),
h AS (SELECT min(t) // 345600000000 AS first, max(t) // 345600000000 AS last FROM s),
i AS (SELECT DISTINCT device, k AS interval_id, k * 345600000000 AS t0, k * 345600000000 + 259200000000 AS t1, 2.0::DOUBLE + device % 5 AS idle_w
      FROM s, (SELECT unnest(range(first, last + 1)) AS k FROM h)),
j AS (SELECT i.*, s.t, s.watts FROM i JOIN s ON s.device = i.device AND s.t BETWEEN i.t0 AND i.t1)"""


@query("samples_in_intervals", f"{POWER} SELECT device, interval_id, t, watts FROM j")
def samples_in_intervals(spark: SparkSession, sf: str) -> DataFrame:
    samples, intervals = power_frames(spark, sf)
    return power.samples_in_intervals(samples, intervals).select("device", "interval_id", "t", "watts")


@query("interval_energy", f"""{POWER}, n AS (SELECT *, lead(t) OVER w AS t2, lead(watts) OVER w AS w2 FROM j WINDOW w AS (PARTITION BY device, interval_id ORDER BY t)),
g AS (SELECT device, interval_id, coalesce(sum((watts + w2) / 2.0 * ((t2 - t) / 1e6)), 0) AS joule, (max(t) - min(t)) / 1e6 AS dur, max(idle_w) AS idle, count(*) AS samples
      FROM n GROUP BY ALL)
SELECT i.device, i.interval_id, CASE WHEN samples >= 2 THEN round(joule, 3) ELSE 0 END::DOUBLE AS joule,
  CASE WHEN samples >= 2 THEN round(greatest(joule - idle * dur, 0), 3) ELSE 0 END::DOUBLE AS marginal_joule,
  CASE WHEN samples >= 2 AND dur > 0 THEN round(joule / dur, 6) ELSE 0 END::DOUBLE AS avg_watts, coalesce(samples, 0) AS samples
FROM i LEFT JOIN g USING (device, interval_id)""")
def interval_energy(spark: SparkSession, sf: str) -> DataFrame:
    samples, intervals = power_frames(spark, sf)
    out = power.interval_energy(samples, intervals)
    return rounded(rounded(out, "joule", "marginal_joule", places=3), "avg_watts")


def text_signatures(docs: DataFrame) -> DataFrame:
    """64-bit SimHash of the words of each text: the sign of the summed word-hash bits."""
    words = docs.select(F.col("doc_id").alias("item_id"), F.explode(T.words(F.lower("text"))).alias("w"))
    # First 64 bits of the digest as a signed number; its 16-bit groups fill the signature in order.
    number = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 16), 16, -10).cast("bigint")
    hashed = words.select("item_id", number.alias("h"))
    places = [48 - 16 * (i // 16) + i % 16 for i in range(64)]
    sums = [F.sum(F.getbit("h", F.lit(p)) * 2 - 1).alias(f"s{i}") for i, p in enumerate(places)]
    summed = hashed.groupBy("item_id").agg(*sums)
    sig = F.lit(0).cast("bigint")
    for i in range(64):
        sig = sig.bitwiseOR(F.shiftleft(F.when(F.col(f"s{i}") > 0, 1).otherwise(0).cast("bigint"), i))
    return summed.select("item_id", sig.alias("sig"))


SIGNATURES = f"""WITH RECURSIVE w AS (SELECT doc_id AS item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents),
h AS (SELECT item_id, md5(w) AS d FROM w),
p AS (SELECT item_id, {', '.join(f"('0x' || substr(d, {1 + 4 * i}, 4))::INT AS h{i}" for i in range(4))} FROM h),
z AS (SELECT item_id, ({' + '.join(f"CASE WHEN sum(((h{i // 16} >> {i % 16}) & 1) * 2 - 1) > 0 THEN {('-' if i == 63 else '') + str(1 << i)}::HUGEINT ELSE 0 END" for i in range(64))})::BIGINT AS sig
      FROM p GROUP BY item_id)"""


@query("text_signatures", f"{SIGNATURES} SELECT item_id, sig FROM z")
def text_signature_rows(spark: SparkSession, sf: str) -> DataFrame:
    return text_signatures(documents(spark, sf))


@query("near_duplicate_pairs", f"""{SIGNATURES}, d AS (SELECT sig, min(item_id) AS id FROM z GROUP BY sig)
SELECT a.id AS a_id, b.id AS b_id, bit_count(xor(a.sig, b.sig))::INT AS distance FROM d a JOIN d b ON a.id < b.id AND bit_count(xor(a.sig, b.sig)) BETWEEN 1 AND 5""")
def near_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    signatures = neardup.distinct_signatures(text_signatures(documents(spark, sf)))
    return neardup.near_pairs(signatures).select("a_id", "b_id", "distance")


CLASSES = """nb AS MATERIALIZED (SELECT a.item_id AS p, b.item_id AS q FROM z a JOIN z b ON bit_count(xor(a.sig, b.sig)) <= 5),
reach AS (SELECT p, q FROM nb UNION SELECT reach.p, nb.q FROM reach JOIN nb ON reach.q = nb.p)
SELECT p AS item_id, min(reach.q) AS class_id, (SELECT count(*) - 1 FROM nb WHERE nb.p = reach.p) AS links FROM reach GROUP BY p"""


@query("near_duplicate_classes", f"{SIGNATURES}, {CLASSES}")
def near_duplicate_classes(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_classes(text_signatures(documents(spark, sf)))


#: Components beyond this, of either sign, set a bit of an embedding's signature.
LARGE = 0.15

EMBEDDED = f"""WITH RECURSIVE z AS (SELECT vec_id AS item_id, ({' + '.join(f"CASE WHEN embedding[{i // 2 + 1}] {'<' if i % 2 else '>'} {'-' * (i % 2)}{LARGE} THEN {('-' if i == 63 else '') + str(1 << i)}::HUGEINT ELSE 0 END" for i in range(64))})::BIGINT AS sig FROM embeddings),
d AS (SELECT sig, min(item_id) AS id FROM z GROUP BY sig)"""


def embedding_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Two bits for each of the first 32 components: large and positive, large and negative."""
    sig = F.lit(0).cast("bigint")
    for i in range(64):
        x = F.get("embedding", F.lit(i // 2)).cast("double")
        bit = F.when((x < -LARGE) if i % 2 else (x > LARGE), 1).otherwise(0).cast("bigint")
        sig = sig.bitwiseOR(F.shiftleft(bit, i))
    return tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), sig.alias("sig"))


SIGNED = f"""WITH z AS (SELECT vec_id AS item_id, ({' + '.join(f"CASE WHEN embedding[{i + 1}] > 0 THEN {('-' if i == 63 else '') + str(1 << i)}::HUGEINT ELSE 0 END" for i in range(64))})::BIGINT AS sig FROM embeddings),
d AS (SELECT sig, min(item_id) AS id FROM z GROUP BY sig)"""


@query("near_embedding_pairs", f"""{SIGNED} SELECT a.id AS a_id, b.id AS b_id, bit_count(xor(a.sig, b.sig))::INT AS distance FROM d a JOIN d b ON a.id < b.id
  AND bit_count(xor(a.sig, b.sig)) BETWEEN 1 AND 16""")
def near_embedding_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of vectors whose first 64 components differ in sign at 16 places at most."""
    sig = F.lit(0).cast("bigint")
    for i in range(64):
        bit = F.when(F.get("embedding", F.lit(i)) > 0, 1).otherwise(0).cast("bigint")
        sig = sig.bitwiseOR(F.shiftleft(bit, i))
    items = tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), sig.alias("sig"))
    return neardup.near_pairs(neardup.distinct_signatures(items), 16).select("a_id", "b_id", "distance")


@query("near_embedding_classes", f"{EMBEDDED}, {CLASSES}")
def near_embedding_classes(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_classes(embedding_signatures(spark, sf))


LEADERS = f"""{SIGNATURES}, o AS (SELECT item_id, sig, row_number() OVER (ORDER BY item_id) AS i FROM z),
walk(i, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT o.i, CASE WHEN len(list_filter(w.leaders, lambda l: bit_count(xor(l, o.sig)) <= 5)) = 0 THEN list_append(w.leaders, o.sig) ELSE w.leaders END
  FROM walk w JOIN o ON o.i = w.i + 1),
led AS (SELECT leaders FROM walk ORDER BY i DESC LIMIT 1)"""


@query("keep_first", f"""{LEADERS}, u AS (SELECT unnest(leaders) AS sig FROM led) SELECT min(o.item_id) AS item_id FROM u JOIN o USING (sig) GROUP BY sig""")
def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.keep_first(text_signatures(documents(spark, sf)))


@query("keep_latest", f"""{LEADERS}, c AS (SELECT o.item_id, list_position(list_transform(leaders, lambda l: bit_count(xor(l, o.sig)) <= 5), TRUE) AS k FROM o, led)
SELECT max(item_id) AS item_id FROM c GROUP BY k""")
def keep_latest(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.keep_latest(text_signatures(documents(spark, sf)))


@query("media_substitution", f"""{SIGNATURES}, m AS (SELECT doc_id % 20 AS session_id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) - 1 AS pos,
    count(*) OVER (PARTITION BY doc_id % 20) AS n, CASE WHEN doc_id % 3 = 0 THEN 'text' ELSE 'media' END AS kind, sig, text, lang,
    CASE WHEN doc_id % 3 = 0 THEN {S.TOKENS} ELSE 1600 END AS tokens FROM documents JOIN z ON z.item_id = doc_id),
o AS (SELECT session_id, pos, sig, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS i FROM m WHERE kind = 'media'),
walk(session_id, i, leaders) AS (SELECT DISTINCT session_id, 0::BIGINT, []::BIGINT[] FROM o UNION ALL
  SELECT o.session_id, o.i, CASE WHEN len(list_filter(w.leaders, lambda l: bit_count(xor(l, o.sig)) <= 5)) = 0 THEN list_append(w.leaders, o.sig) ELSE w.leaders END
  FROM walk w JOIN o ON o.session_id = w.session_id AND o.i = w.i + 1),
led AS (SELECT session_id, max_by(leaders, i) AS leaders FROM walk GROUP BY session_id),
c AS (SELECT o.session_id, o.pos, list_position(list_transform(leaders, lambda l: bit_count(xor(l, o.sig)) <= 5), TRUE) AS c FROM o JOIN led USING (session_id)),
latest AS (SELECT session_id, max(pos) AS pos, TRUE AS newest FROM c GROUP BY session_id, c),
k AS (SELECT *, {S.alive('2', 'n - 1 - pos')} AS keep FROM m LEFT JOIN latest USING (session_id, pos))
SELECT session_id, pos, CASE WHEN kind = 'media' AND NOT keep THEN 'extract' ELSE kind END AS kind,
  (CASE WHEN kind = 'media' AND NOT keep THEN length('screen in ' || lang) // 4 + 1 ELSE tokens END)::BIGINT AS tokens
FROM k WHERE (kind = 'text' AND keep) OR (kind = 'media' AND newest)""")
def media_substitution(spark: SparkSession, sf: str) -> DataFrame:
    from palimpsest.operators import prune
    from palimpsest.operators.sequence import dense_positions, fitting_block_rows

    docs = documents(spark, sf).join(
        text_signatures(documents(spark, sf)).withColumnRenamed("item_id", "doc_id"), "doc_id"
    ).withColumn("session_id", F.col("doc_id") % 20)
    whole = fitting_block_rows(tables.table(spark, sf, "documents"), F.col("doc_id") % 20) == 0
    placed = dense_positions(
        docs, ["session_id"], ["doc_id"], fine={"ids": F.floor(F.col("doc_id") / 65536)},
        coarse=F.floor(F.col("doc_id") / (65536 * 1024)), whole=whole,
    )
    text = F.col("doc_id") % 3 == 0
    rows = placed.withColumns(
        {
            "signal": F.lit(2),
            "kind": F.when(text, "text").otherwise("media"),
            "tokens": F.when(text, T.token_size(F.col("text"))).otherwise(1600).cast("bigint"),
        }
    )
    decided = prune.decide(rows, PruneConfig())
    extracts = rows.select("session_id", "pos", F.concat(F.lit("screen in "), "lang").alias("extract"))
    return neardup.substitute_media(decided, extracts).select("session_id", "pos", "kind", "tokens")
