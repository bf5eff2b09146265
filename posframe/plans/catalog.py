"""Named queries over the reference tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posframe.functions import codecs as C
from posframe.functions import features as X
from posframe.functions import schedules
from posframe.operators import access, blocks, ingest, metrics, profile, sampling, scoring, validate
from posframe.sources import positions as P

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_MOD = "CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END"
RAW = f"""raw0 AS (
  SELECT event_id AS idx, user_id AS u, (2 + (event_id * 7 + user_id) % 31)::INT AS piece_count, (user_id % 2)::INT AS stm,
    (CASE WHEN event_type = 'error' THEN ({_MOD}) * (25001 + event_id % 7000) ELSE floor((value - 50) * 12) END)::INT AS score_cp,
    (CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'signup' THEN -1 ELSE event_id % 3 - 1 END)::INT AS wdl,
    event_id % 7 = 0 AS is_capture, user_id % 5 = 0 AS in_check
  FROM events
), raw AS (
  SELECT *, list_transform(range(0, piece_count), lambda k: (((k // 2 + idx % 2) % 2) * 384 + ((k + u % 6) % 6) * 64 + (idx % 64 + 29 * k) % 64)::INT) AS features FROM raw0
)"""


def _norm(cp: str) -> str:
    size = f"abs({cp}::BIGINT)"
    mate = f"CAST(10::FLOAT - CAST(least(greatest(CAST((32000 - {size})::FLOAT / 100::FLOAT AS FLOAT), 1::FLOAT), 30::FLOAT) * 0.1::FLOAT AS FLOAT) AS FLOAT)"
    return f"((CASE WHEN {cp} < 0 THEN -1::FLOAT ELSE 1::FLOAT END) * (CASE WHEN {size} > 25000 THEN {mate} ELSE least(CAST({size}::FLOAT / 400::FLOAT AS FLOAT), 6.5::FLOAT) END))"


def _enc(cp: str) -> str:
    return f"round(CAST(least(greatest({_norm(cp)}, -10::FLOAT), 10::FLOAT) * 3000::FLOAT AS FLOAT))::INT"


POS = RAW + f""", pos AS (
  SELECT idx, (((piece_count - 2) << 1) | stm)::INT AS flags, {_enc('score_cp')} AS eval_raw, wdl, stm, piece_count, features, u FROM raw
)"""
BATCHED = "batched AS (SELECT *, idx // 256 AS batch_id FROM pos)"
#: Predictions: a shrunk evaluation with a deterministic error.
PRED = POS + """, pred AS (
  SELECT idx, idx // 512 AS batch_id, (eval_raw::DOUBLE / 3000) * 0.9 + ((idx * 37 % 101) - 50) / 100.0 AS pred, eval_raw::DOUBLE / 3000 AS eval_stm,
    idx % 11 <> 0 AS has_eval, (CASE WHEN stm = 1 THEN -wdl ELSE wdl END)::DOUBLE AS wdl_stm, idx % 13 <> 0 AS has_wdl, piece_count FROM pos
)"""


def pred(spark, d) -> DataFrame:
    e = F.col("eval_raw").cast("double") / 3000
    return P.positions(spark, d).select(
        "idx", F.floor(F.col("idx") / 512).alias("batch_id"), (e * 0.9 + (F.col("idx") * 37 % 101 - 50) / 100.0).alias("pred"), e.alias("eval_stm"), (F.col("idx") % 11 != 0).alias("has_eval"),
        C.wdl_stm_pov(F.col("wdl"), F.col("stm")).cast("double").alias("wdl_stm"), (F.col("idx") % 13 != 0).alias("has_wdl"), F.col("piece_count").cast("int").alias("piece_count"),
    )


def query(name: str, sql: str | None = None, base: str | None = POS):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (f"WITH {base} " if base else "") + sql
        return f

    return add


def _ints(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("int") for n in names})


# -- codecs ---------------------------------------------------------------


@query("encode_flags", "SELECT idx, flags FROM pos")
def encode_flags(spark, d):
    return _ints(P.positions(spark, d).select("idx", "flags"), "flags")


@query("decode_flags", "SELECT idx, (flags & 1)::INT AS stm, (((flags >> 1) & 31) + 2)::INT AS piece_count, (flags & 192 = 0 AND (flags >> 1) & 31 <> 31) AS valid FROM pos")
def decode_flags(spark, d):
    f = F.col("flags")
    return P.positions(spark, d).select("idx", C.decode_stm(f).cast("int").alias("stm"), C.decode_count(f).cast("int").alias("piece_count"), C.flags_valid(f).alias("valid"))


@query("normalize_eval", f"SELECT idx, score_cp, {_enc('score_cp')} AS eval_raw, round({_norm('score_cp')}::DOUBLE, 5) AS target FROM raw", RAW)
def normalize_eval(spark, d):
    cp = F.col("score_cp")
    return P.events_raw(spark, d).select("idx", "score_cp", C.encode_eval_from_cp(cp).cast("int").alias("eval_raw"), F.round(C.normalize_target(cp).cast("double"), 5).alias("target"))


@query("encode_eval_domain", f"SELECT cp, {_enc('cp')} AS eval_raw FROM (SELECT (range - 33000)::INT AS cp FROM range(66001))", None)
def encode_eval_domain(spark, d):
    return spark.range(66001).select((F.col("id") - 33000).cast("int").alias("cp")).select("cp", C.encode_eval_from_cp(F.col("cp")).cast("int").alias("eval_raw"))


@query("decode_eval", "SELECT idx, round(CAST(eval_raw::FLOAT / 3000::FLOAT AS FLOAT)::DOUBLE, 6) AS eval_norm FROM pos")
def decode_eval(spark, d):
    return P.positions(spark, d).select("idx", F.round(F.col("eval_norm").cast("double"), 6).alias("eval_norm"))


@query("eval_white_pov", "SELECT idx, (CASE WHEN stm = 1 THEN -eval_raw ELSE eval_raw END)::INT AS eval_white FROM pos")
def eval_white_pov(spark, d):
    return P.positions(spark, d).select("idx", C.eval_white_pov(F.col("eval_raw").cast("int"), F.col("stm")).alias("eval_white"))


@query("wdl_stm_pov", "SELECT idx, (CASE WHEN stm = 1 THEN -wdl ELSE wdl END)::INT AS wdl_stm, 1::INT AS has_eval, 1::INT AS has_wdl FROM pos")
def wdl_stm_pov(spark, d):
    return P.positions(spark, d).select("idx", C.wdl_stm_pov(F.col("wdl").cast("int"), F.col("stm")).alias("wdl_stm"), F.lit(1).alias("has_eval"), F.lit(1).alias("has_wdl"))


@query("output_bucket_phase", "SELECT idx, least(greatest((piece_count - 2) // 4, 0), 7)::INT AS bucket, CASE WHEN piece_count > 20 THEN 'opening' WHEN piece_count > 10 THEN 'middle' ELSE 'endgame' END AS phase, abs(eval_raw::DOUBLE / 3000) > 6.5 AS mate FROM pos")
def output_bucket_phase(spark, d):
    n = F.col("piece_count").cast("int")
    return P.positions(spark, d).select("idx", C.output_bucket(n).alias("bucket"), C.phase(n).alias("phase"), C.is_mate(F.col("eval_raw").cast("double") / 3000).alias("mate"))


@query("feature_set_names", "SELECT n, CASE n WHEN 1 THEN 'HalfP' WHEN 2 THEN 'HalfKAv2_hm' WHEN 3 THEN 'HalfKA' ELSE '?' END AS name FROM (SELECT range::BIGINT AS n FROM range(5))", None)
def feature_set_names(spark, d):
    return spark.range(5).select(F.col("id").alias("n"), C.feature_set_name(F.col("id")).alias("name"))


@query("synthetic_wdl", "SELECT idx, round(2 / (1 + exp(-(CASE WHEN abs(e) > 6.5 THEN sign(e) * 32000.0 ELSE e * 400 END) / 350)) - 1, 6) AS synth FROM (SELECT idx, eval_raw::DOUBLE / 3000 AS e FROM pos)")
def synthetic_wdl(spark, d):
    return P.positions(spark, d).select("idx", F.round(C.synthetic_wdl(F.col("eval_raw").cast("double") / 3000), 6).alias("synth"))


_BW = "[1.0, 1.0, 1.2, 1.5, 2.0, 2.0, 1.5, 1.0]::DOUBLE[]"
_WEIGHT = f"(CASE WHEN abs(eval_stm) > 4.5 THEN 0.5 ELSE 1.0 END) * (CASE WHEN abs(eval_stm) <= 100 THEN 1.0 ELSE 0.0 END) * ({_BW})[least(greatest((piece_count - 2) // 4, 0), 7)::INT + 1]"


@query("bucket_weights", f"SELECT idx, round(({_WEIGHT})::DOUBLE, 6) AS weight FROM pred", PRED)
def bucket_weights(spark, d):
    return pred(spark, d).select("idx", F.round(C.loss_weight(F.col("eval_stm"), F.col("piece_count")), 6).alias("weight"))


@query("squashed_cp", "SELECT idx, round(CASE WHEN stm = 1 THEN -c ELSE c END, 4) AS cp FROM (SELECT idx, stm, 0.5 * ln((1 + t) / (1 - t)) * 400 AS c FROM (SELECT idx, stm, least(greatest(tanh(eval_raw::DOUBLE / 3000), -0.9999), 0.9999) AS t FROM pos))")
def squashed_cp(spark, d):
    return P.positions(spark, d).select("idx", F.round(C.squashed_cp(F.col("eval_raw").cast("double") / 3000, F.col("stm")), 4).alias("cp"))


@query("quantise_weights", "SELECT vec_id, pos, greatest(-127, least(127, round_even(x * 100, 0)))::INT AS q, round(greatest(-0.2, least(0.2, x)), 6) AS clamped FROM (SELECT vec_id, generate_subscripts(embedding, 1)::INT - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)", None)
def quantise_weights(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    x = F.col("v").cast("double")
    return e.select("vec_id", F.col("pos").cast("int").alias("pos"), C.quantise(x, 100.0, 127).alias("q"), F.round(C.clamp_weight(x, 0.2), 6).alias("clamped"))


# -- features -------------------------------------------------------------

_JOIN = "array_to_string(list_transform({}, lambda x: x::VARCHAR), ',')"
_FLIP = "((1 - f // 384) * 384 + (f % 384) // 64 * 64 + xor((f % 64)::INT, 56))::INT"


@query("feature_ids", "SELECT idx, slot::INT AS slot, features[slot + 1] AS feature FROM (SELECT idx, features, unnest(range(0, len(features))) AS slot FROM pos)")
def feature_ids(spark, d):
    return P.positions(spark, d).select("idx", F.posexplode("features").alias("slot", "feature"))


@query("feature_parts", "SELECT f AS feature, (f // 384)::INT AS color, ((f % 384) // 64)::INT AS piece, (f % 64)::INT AS square, count(*) AS n FROM (SELECT unnest(features) AS f FROM pos) GROUP BY f")
def feature_parts(spark, d):
    f = F.col("feature")
    return P.positions(spark, d).select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n")).select("feature", X.feature_color(f).alias("color"), X.feature_piece(f).alias("piece"), X.feature_square(f).alias("square"), "n")


@query("flip_pov", f"SELECT idx, {_JOIN.format(f'list_transform(features, lambda f: {_FLIP})')} AS black FROM pos")
def flip_pov(spark, d):
    return P.positions(spark, d).select("idx", X.as_text(X.flip_all("features")).alias("black"))


@query("mirror", f"SELECT idx, {_JOIN.format('list_transform(features, lambda f: xor(f, 7))')} AS mirrored FROM pos")
def mirror(spark, d):
    return P.positions(spark, d).select("idx", X.as_text(X.mirror_all("features")).alias("mirrored"))


@query("stm_streams", f"SELECT idx, {_JOIN.format('CASE WHEN stm = 1 THEN o ELSE features END')} AS own, {_JOIN.format('CASE WHEN stm = 1 THEN features ELSE o END')} AS other FROM (SELECT *, list_transform(features, lambda f: {_FLIP}) AS o FROM pos)")
def stm_streams(spark, d):
    own, other = X.streams(F.col("features"), F.col("stm"))
    return P.positions(spark, d).select("idx", X.as_text(own).alias("own"), X.as_text(other).alias("other"))


@query("gather_features_text", "SELECT idx, string_agg(f::VARCHAR, ',' ORDER BY f % 64, f) AS by_square FROM (SELECT idx, unnest(features) AS f FROM pos) GROUP BY idx")
def gather_features_text(spark, d):
    return P.positions(spark, d).select("idx", X.as_text(X.by_square(F.col("features"))).alias("by_square"))



@query("pad_features", f"SELECT idx, {_JOIN.format('list_resize(features, 32, 65535)')} AS padded, {_JOIN.format('features')} AS unpadded FROM pos")
def pad_features(spark, d):
    row = X.padded(F.col("features"))
    return P.positions(spark, d).select("idx", X.as_text(row).alias("padded"), X.as_text(X.unpadded(row, F.col("piece_count"))).alias("unpadded"))


# -- ingest ---------------------------------------------------------------

_REASON = "CASE WHEN is_capture THEN 'capture' WHEN in_check THEN 'in_check' END"


@query("ingest_filter", f"SELECT idx, flags, eval_raw FROM pos WHERE idx IN (SELECT idx FROM raw WHERE {_REASON} IS NULL)")
def ingest_filter(spark, d):
    return _ints(P.encoded(ingest.kept(P.events_raw(spark, d))).select("idx", "flags", "eval_raw"), "flags", "eval_raw")


@query("ingest_counters", f"SELECT count(*) AS read, count(*) FILTER (r IS NULL) AS kept, count(*) FILTER (r = 'capture') AS captures, count(*) FILTER (r = 'in_check') AS in_check, 0::BIGINT AS rejected, round(100.0 * count(*) FILTER (r IS NULL) / count(*), 4)::DOUBLE AS kept_pct FROM (SELECT {_REASON} AS r FROM raw)", RAW)
def ingest_counters(spark, d):
    return ingest.counters(P.events_raw(spark, d))


@query("kept_cap", f"SELECT idx, score_cp FROM raw WHERE {_REASON} IS NULL ORDER BY idx LIMIT 500", RAW)
def kept_cap(spark, d):
    return ingest.capped(P.events_raw(spark, d), 500).select("idx", "score_cp")


@query("unfiltered_counters", "SELECT count(*) AS read, count(*) AS kept, 0::BIGINT AS captures, 0::BIGINT AS in_check, 0::BIGINT AS rejected, 100.0::DOUBLE AS kept_pct FROM raw", RAW)
def unfiltered_counters(spark, d):
    return ingest.counters(P.events_raw(spark, d), filters=False)


@query("dense_index", f"SELECT idx AS source, row_number() OVER (ORDER BY idx) - 1 AS idx FROM raw WHERE {_REASON} IS NULL", RAW)
def dense_index(spark, d):
    return ingest.dense_index(ingest.kept(P.events_raw(spark, d)).select(F.col("idx").alias("source")), "source")


# -- profiles and access --------------------------------------------------


@query("wdl_distribution", "SELECT wdl, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM pos GROUP BY wdl")
def wdl_distribution(spark, d):
    return profile.wdl_distribution(P.positions(spark, d))


@query("feature_density", "SELECT count(*) AS positions, sum(len(features))::BIGINT AS features, round(sum(len(features)) / count(*), 6)::DOUBLE AS density FROM pos")
def feature_density(spark, d):
    return profile.feature_density(P.positions(spark, d))


@query("dataset_summary", "SELECT count(*) AS positions, ceil(count(*) / 1024)::BIGINT AS blocks, sum(piece_count)::BIGINT AS features, 50::BIGINT AS metadata_bytes FROM pos")
def dataset_summary(spark, d):
    return profile.summary(P.positions(spark, d))


@query("dataset_stats", "SELECT count(*) AS n, sum(piece_count)::BIGINT AS features, round(avg(piece_count), 6) AS avg_features, min(eval_raw)::INT AS eval_min, max(eval_raw)::INT AS eval_max, count(*) FILTER (wdl = 1) AS wdl_plus, count(*) FILTER (wdl = 0) AS wdl_zero, count(*) FILTER (wdl = -1) AS wdl_minus, count(DISTINCT piece_count) AS distinct_counts FROM pos")
def dataset_stats(spark, d):
    return profile.dataset_stats(P.positions(spark, d))


@query("piece_count_hist", "SELECT piece_count, count(*) AS n FROM pos GROUP BY piece_count")
def piece_count_hist(spark, d):
    return P.positions(spark, d).groupBy(F.col("piece_count").cast("int").alias("piece_count")).agg(F.count("*").alias("n"))


@query("eval_hist", "SELECT (floor(eval_raw / 500) * 500)::INT AS bucket, count(*) AS n FROM pos GROUP BY 1")
def eval_hist(spark, d):
    return profile.histogram(P.positions(spark, d), "eval_raw", 500)


@query("phase_wdl", "SELECT CASE WHEN piece_count > 20 THEN 'opening' WHEN piece_count > 10 THEN 'middle' ELSE 'endgame' END AS phase, wdl, count(*) AS n FROM pos GROUP BY 1, 2")
def phase_wdl(spark, d):
    return P.positions(spark, d).groupBy(C.phase(F.col("piece_count")).alias("phase"), F.col("wdl").cast("int").alias("wdl")).agg(F.count("*").alias("n"))


_LINE = f"printf('[%d] stm=%d pc=%d wdl=%d eval=%s features=[%s]', idx, stm, piece_count, wdl, printf('%g', (eval_raw::FLOAT / 3000::FLOAT)::DOUBLE), {_JOIN.format('features')})"


@query("range_dump", f"SELECT idx, {_LINE} AS line FROM pos WHERE idx BETWEEN 100 AND 299 ORDER BY idx")
def range_dump(spark, d):
    return access.dump(P.positions(spark, d), 100, 300)


@query("point_lookup", f"SELECT idx, eval_raw, {_JOIN.format('features')} AS features FROM pos WHERE idx = 777")
def point_lookup(spark, d):
    return _ints(access.at(P.positions(spark, d), 777).select("idx", "eval_raw", X.as_text(F.col("features")).alias("features")), "eval_raw")


@query("batch_gather", f"SELECT slot, idx, flags, {_JOIN.format('list_resize(features, 32, 65535)')} AS features FROM (SELECT range::BIGINT AS slot, (range * 7919 + 13) % 997 AS idx FROM range(2000)) JOIN pos USING (idx)")
def batch_gather(spark, d):
    request = spark.range(2000).select(F.col("id").alias("slot"), ((F.col("id") * 7919 + 13) % 997).alias("idx"))
    return _ints(access.gather_matrix(P.positions(spark, d), request).select("slot", "idx", "flags", X.as_text(F.col("features")).alias("features")), "flags")


# -- blocks ---------------------------------------------------------------

_BLOCKS = POS + ", b AS (SELECT idx // 1024 AS block_id, count(*) AS n, sum(piece_count)::BIGINT AS total FROM pos GROUP BY 1)"


@query("block_totals", "SELECT block_id, n, total FROM b", _BLOCKS)
def block_totals(spark, d):
    return blocks.totals(P.positions(spark, d))


@query("block_anchors", "SELECT block_id, (sum(total) OVER (ORDER BY block_id) - total)::BIGINT AS anchor FROM b", _BLOCKS)
def block_anchors(spark, d):
    return blocks.anchors(P.positions(spark, d))


@query("block_prefix", "SELECT block_id, (sum(total) OVER (ORDER BY block_id) - total)::BIGINT AS anchor, 1025::INT AS entries, total::INT AS last, s::BIGINT AS prefix_sum FROM b JOIN (SELECT block_id, sum(e) + (1024 - count(*)) * max(e) AS s FROM (SELECT idx // 1024 AS block_id, sum(piece_count) OVER (PARTITION BY idx // 1024 ORDER BY idx) AS e FROM pos) GROUP BY 1) USING (block_id)", _BLOCKS)
def block_prefix(spark, d):
    t = blocks.block_table(P.positions(spark, d))
    return t.select("block_id", "anchor", F.size("prefix").alias("entries"), F.element_at("prefix", -1).cast("int").alias("last"), F.aggregate("prefix", F.lit(0).cast("long"), lambda a, x: a + x).alias("prefix_sum"))


@query("csr_offsets", "SELECT idx, (sum(piece_count) OVER (ORDER BY idx) - piece_count)::BIGINT AS start, (sum(piece_count) OVER (ORDER BY idx))::BIGINT AS \"end\" FROM pos")
def csr_offsets(spark, d):
    return blocks.csr_offsets(P.positions(spark, d))


# -- splits, shuffles, batches --------------------------------------------

_VAL = sampling.floyd(1000, 100, 7)
_VALUES = ", ".join(f"({x})" for x in _VAL)


@query("floyd_sample", f"SELECT idx::BIGINT AS idx FROM (VALUES {_VALUES}) t(idx)", None)
def floyd_sample(spark, d):
    return sampling.val_index(spark, 1000, 100, 7)


@query("val_exclusion", f"SELECT idx, eval_raw FROM pos WHERE idx NOT IN (SELECT idx FROM (VALUES {_VALUES}) t(idx))")
def val_exclusion(spark, d):
    return _ints(sampling.excluded(P.positions(spark, d), sampling.val_index(spark, 1000, 100, 7)).select("idx", "eval_raw"), "eval_raw")


@query("val_prefix", "SELECT idx, eval_raw FROM pos WHERE idx < 250")
def val_prefix(spark, d):
    return _ints(P.positions(spark, d).filter("idx < 250").select("idx", "eval_raw"), "eval_raw")


@query("val_index_checks", 'SELECT count(*) AS "rows", count(*) FILTER (i < 0) AS below, count(*) FILTER (i >= 500) AS above, count(*) - count(DISTINCT i) AS duplicates, false AS ok FROM (SELECT user_id - 3 AS i FROM events)', None)
def val_index_checks(spark, d):
    return sampling.index_checks(spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") - 3).alias("idx")), 500)


_HASH = "((idx * 2654435761 + {}) % 4294967296)"


@query("chunk_shuffle", f"SELECT idx, idx // 2048 AS chunk_id, (row_number() OVER (PARTITION BY idx // 2048 ORDER BY {_HASH.format(5)}, idx) - 1)::INT AS slot FROM pos")
def chunk_shuffle(spark, d):
    return _ints(sampling.chunk_shuffled(P.positions(spark, d).select("idx"), 2048, 5).select("idx", "chunk_id", "slot"), "slot")


_EPOCH = POS + f""", sh AS (SELECT idx, idx // 512 AS chunk_id, row_number() OVER (PARTITION BY idx // 512 ORDER BY {_HASH.format(9 + 1_000_003)}, idx) - 1 AS slot FROM pos),
co AS (SELECT chunk_id, n, row_number() OVER (ORDER BY (chunk_id * 2654435761 + {9 + 1_000_003}) % 4294967296, chunk_id) - 1 AS place FROM (SELECT chunk_id, count(*) AS n FROM sh GROUP BY 1)),
cw AS (SELECT chunk_id, place % 3 AS worker, sum(n) OVER (PARTITION BY place % 3 ORDER BY place) - n AS base, sum(n) OVER (PARTITION BY place % 3) AS whole FROM co),
bt AS (SELECT idx, worker::INT AS worker, ((base + slot) // 96)::BIGINT AS batch_id, ((base + slot) % 96)::INT AS pos FROM sh JOIN cw USING (chunk_id) WHERE base + slot < whole // 96 * 96)"""


def _epoch(spark, d):
    return sampling.epoch_batches(P.positions(spark, d), 512, 96, 9, 1, 3)


@query("batch_assign", "SELECT idx, worker, batch_id, pos FROM bt", _EPOCH)
def batch_assign(spark, d):
    return _epoch(spark, d)


@query("batch_offsets", "SELECT worker, batch_id, bt.pos, idx, (sum(piece_count) OVER (PARTITION BY worker, batch_id ORDER BY bt.pos) - piece_count)::BIGINT AS start FROM bt JOIN pos USING (idx)", _EPOCH)
def batch_offsets(spark, d):
    return sampling.batch_offsets(_epoch(spark, d), P.positions(spark, d))


@query("worker_stride", "SELECT idx, batch_id FROM batched WHERE batch_id % 4 = 1", POS + ", " + BATCHED)
def worker_stride(spark, d):
    own = P.positions(spark, d).select("idx", F.floor(F.col("idx") / 256).cast("long").alias("batch_id"))
    return sampling.worker_stride(own, 1, 4)


@query("val_worker_split", f"SELECT idx::BIGINT AS idx, least((row_number() OVER (ORDER BY idx) - 1) // 14, 6)::INT AS worker FROM (VALUES {_VALUES}) t(idx)", None)
def val_worker_split(spark, d):
    return sampling.contiguous_split(sampling.val_index(spark, 1000, 100, 7), 100, 7).select("idx", "worker")


@query("mirror_augment", f"SELECT idx, mirror, {_JOIN.format('CASE WHEN mirror THEN list_transform(features, lambda f: xor(f, 7)) ELSE features END')} AS features FROM pos CROSS JOIN (VALUES (false), (true)) t(mirror)")
def mirror_augment(spark, d):
    out = sampling.mirror_doubled(P.positions(spark, d))
    return out.select("idx", "mirror", X.as_text(X.mirror_all("features", F.col("mirror"))).alias("features"))


@query("concat_files", "SELECT k::INT AS file, (idx + k * (SELECT count(*) FROM pos))::BIGINT AS idx, eval_raw FROM pos CROSS JOIN (VALUES (0), (1)) t(k)")
def concat_files(spark, d):
    p = P.positions(spark, d).select("idx", "eval_raw")
    return _ints(sampling.concatenated([p, p]).select("file", "idx", "eval_raw"), "file", "eval_raw")


# -- validation -----------------------------------------------------------

#: Deliberately broken rows: each rule is broken by some residue of idx.
_BROKEN = POS + """, broken AS (
  SELECT idx, (CASE WHEN idx % 50 = 1 THEN flags | 64 WHEN idx % 50 = 2 THEN 62 ELSE flags END)::INT AS flags, (CASE WHEN idx % 50 = 3 THEN 30001 ELSE eval_raw END)::INT AS eval_raw,
    (CASE WHEN idx % 50 = 4 THEN 2 ELSE wdl END)::INT AS wdl, CASE WHEN idx % 50 = 5 THEN list_append(features, 768) WHEN idx % 50 = 6 THEN features[1:1] ELSE features END AS features FROM pos
)"""


def broken(spark, d) -> DataFrame:
    r = F.col("idx") % 50
    p = P.positions(spark, d)
    return p.select(
        "idx", F.when(r == 1, F.col("flags").bitwiseOR(F.lit(64))).when(r == 2, 62).otherwise(F.col("flags")).cast("int").alias("flags"), F.when(r == 3, 30001).otherwise(F.col("eval_raw")).cast("int").alias("eval_raw"),
        F.when(r == 4, 2).otherwise(F.col("wdl")).cast("int").alias("wdl"), F.when(r == 5, F.concat("features", F.array(F.lit(768)))).when(r == 6, F.slice("features", 1, 1)).otherwise(F.col("features")).alias("features"),
    )


for _scope, _parts in {
    "flags": [("flags_reserved_bits", "flags & 192 <> 0", "flags"), ("flags_count_sentinel", "(flags >> 1) & 31 = 31", "flags")],
    "eval": [("eval_bound", "abs(eval_raw) > 30000", "eval_raw")],
    "wdl": [("wdl_domain", "wdl NOT IN (-1, 0, 1)", "wdl")],
    "features": [("feature_bound", "list_max(features) >= 768", "list_max(features)"), ("count_is_nnz", "((flags >> 1) & 31) + 2 <> len(features)", "len(features)")],
}.items():

    @query(f"violations_{_scope}", " UNION ALL ".join(f"SELECT '{r}' AS rule, '{_scope}' AS scope, idx, ({o})::BIGINT AS observed FROM broken WHERE {c}" for r, c, o in _parts), _BROKEN)
    def violations(spark, d, scope=_scope):
        return validate.violations(broken(spark, d), [r for r in validate.row_rules() if r[1] == scope])


@query("violations_input", "SELECT 'stm_domain' AS rule, 'input' AS scope, idx, 2::BIGINT AS observed FROM raw WHERE idx % 40 = 1 UNION ALL SELECT 'size_is_count', 'input', idx, (len(features) - 1)::BIGINT FROM raw WHERE idx % 40 = 2 UNION ALL SELECT 'wdl_domain', 'input', idx, 5 FROM raw WHERE idx % 40 = 3", RAW)
def violations_input(spark, d):
    r = F.col("idx") % 40
    df = P.events_raw(spark, d).withColumn("stm", F.when(r == 1, 2).otherwise(F.col("stm"))).withColumn("wdl", F.when(r == 3, 5).otherwise(F.col("wdl")))
    return validate.violations(df.withColumn("features", F.when(r == 2, F.slice("features", F.lit(1), F.size("features") - 1)).otherwise(F.col("features"))), validate.input_rules())


@query("violations_prefix", "SELECT 'anchor_recurrence' AS rule, 'blocks' AS scope, block_id AS idx, (anchor + total + 1)::BIGINT AS observed FROM (SELECT block_id, total, sum(total) OVER (ORDER BY block_id) - total AS anchor, max(block_id) OVER () AS m FROM b) WHERE block_id % 2 = 0 AND block_id < m UNION ALL SELECT 'anchor_recurrence', 'blocks', block_id, (anchor + total)::BIGINT FROM (SELECT block_id, total, sum(total) OVER (ORDER BY block_id) - total AS anchor, max(block_id) OVER () AS m FROM b) WHERE block_id % 2 = 1 AND block_id < m UNION ALL SELECT 'feature_total', 'blocks', m, (t + m % 2)::BIGINT FROM (SELECT max(block_id) AS m, sum(total) AS t FROM b) WHERE m % 2 = 1", _BLOCKS)
def violations_prefix(spark, d):
    p = P.positions(spark, d)
    t = blocks.block_table(p)
    total = p.agg(F.sum("piece_count")).first()[0]
    return validate.block_violations(t.withColumn("anchor", F.col("anchor") + F.col("block_id") % 2), total)



@query("metadata_check", "SELECT event_id, CASE WHEN props IS NULL OR props = '' THEN 'empty' WHEN NOT json_valid(props) THEN 'not JSON' WHEN NOT starts_with(trim(props), '{') THEN 'not an object' WHEN json_extract_string(props, '$.format') IS DISTINCT FROM 'cnnp_sparse_v2' THEN 'format' WHEN json_extract_string(props, '$.layout') IS DISTINCT FROM 'single_file' THEN 'layout' END AS problem FROM events", None)
def metadata_check(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", validate.metadata_problem(F.col("props")).alias("problem"))


# -- metrics --------------------------------------------------------------

_SQ = "power(tanh(pred) - tanh(eval_stm), 2)"
_L = f"sum(({_WEIGHT}) * {_SQ}) FILTER (has_eval) / greatest(coalesce(sum({_WEIGHT}) FILTER (has_eval), 0), 1e-8)"
_PHASE = "CASE WHEN piece_count > 20 THEN 'opening' WHEN piece_count > 10 THEN 'middle' ELSE 'endgame' END"
_LOSSES = PRED + f""", per AS (
  SELECT batch_id, {_PHASE} AS phase, count(*) AS n, coalesce({_L}, 0) AS l FROM pred GROUP BY 1, 2
  UNION ALL SELECT batch_id, 'all', count(*), coalesce({_L}, 0) FROM pred GROUP BY 1
), ph AS (SELECT phase, sum(n)::BIGINT AS samples, sum(l * n) / sum(n) AS loss FROM per GROUP BY phase)"""
_CAL = "SELECT sqrt(greatest(0, avg(p * p) - avg(p) * avg(p))) / greatest(sqrt(greatest(0, avg(v * v) - avg(v) * avg(v))), 1e-6) AS scale_ratio, avg(abs(p - v)) AS mae_cp, 100.0 * count(*) FILTER (abs(v) > 20 AND (p > 0) = (v > 0)) / greatest(count(*) FILTER (abs(v) > 20), 1) AS sign_acc, count(*) AS n FROM (SELECT tanh(pred) * 400 AS p, tanh(eval_stm) * 400 AS v FROM pred WHERE has_eval)"


@query("loss_by_phase", "SELECT phase, samples, round(loss, 6) AS loss FROM ph", _LOSSES)
def loss_by_phase(spark, d):
    return metrics.loss_by_phase(pred(spark, d)).withColumn("loss", F.round("loss", 6))


@query("blended_loss", f"SELECT round(0.5 * ({_L}) + 0.5 * sum(({_WEIGHT}) * power(tanh(pred) - wdl_stm, 2)) FILTER (has_eval AND has_wdl) / sum({_WEIGHT}) FILTER (has_eval AND has_wdl), 6) AS loss, round(0.7 * ({_L}) + 0.3 * sum(({_WEIGHT}) * power(tanh(pred) - (2 / (1 + exp(-(CASE WHEN abs(eval_stm) > 6.5 THEN sign(eval_stm) * 32000.0 ELSE eval_stm * 400 END) / 350)) - 1), 2)) FILTER (has_eval) / sum({_WEIGHT}) FILTER (has_eval), 6) AS synthetic FROM pred", PRED)
def blended_loss(spark, d):
    return pred(spark, d).agg(F.round(metrics.loss(0.5), 6).alias("loss"), F.round(metrics.loss(0.3, real_wdl=False), 6).alias("synthetic"))


@query("calibration", f"SELECT round(scale_ratio, 6) AS scale_ratio, round(mae_cp, 6) AS mae_cp, round(sign_acc, 6)::DOUBLE AS sign_acc, n FROM ({_CAL})", PRED)
def calibration(spark, d):
    return metrics.calibration(pred(spark, d)).select(*[F.round(c, 6).cast("double").alias(c) for c in ("scale_ratio", "mae_cp", "sign_acc")], "n")


@query("composite_quality", f"SELECT round(score, 6) AS score, round(0.01 * greatest(0, 1 - scale_ratio), 6) AS penalty, round(score + 0.01 * greatest(0, 1 - scale_ratio), 6) AS quality FROM (SELECT sum(loss * CASE phase WHEN 'opening' THEN 0.05::DOUBLE WHEN 'middle' THEN 0.9::DOUBLE WHEN 'endgame' THEN 0.05::DOUBLE ELSE 0 END) AS score FROM ph), ({_CAL})", _LOSSES)
def composite_quality(spark, d):
    return metrics.composite(pred(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("score", "penalty", "quality")])


_RUNS = "runs AS (SELECT range::INT AS epoch, ((range * 7 + 3) % 11 + 5)::DOUBLE / 10 AS quality FROM range(12))"


def _runs(spark):
    e = F.col("id")
    return spark.range(12).select(e.cast("int").alias("epoch"), (((e * 7 + 3) % 11 + 5).cast("double") / 10).alias("quality"))


@query("best_so_far", "SELECT epoch, quality, min(quality) OVER (ORDER BY epoch) AS best, coalesce(quality < min(quality) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM runs", _RUNS)
def best_so_far(spark, d):
    return metrics.best_so_far(_runs(spark))


@query("best_epoch", "SELECT arg_min(epoch, quality) AS epoch, min(quality) AS quality FROM (SELECT * FROM runs WHERE epoch < 11)", _RUNS)
def best_epoch(spark, d):
    return metrics.best_epoch(_runs(spark).filter("epoch < 11"))


_FLOOR = 2e-5 / 0.6e-3


@query("lr_schedule", f"SELECT range::INT AS epoch, round(CASE WHEN range < 2 THEN (range + 1) / 2.0 ELSE {_FLOOR!r} + 0.5 * (1 - {_FLOOR!r}) * (1 + cos(pi() * least(1.0, (range - 2) / 9.0))) END, 6)::DOUBLE AS factor FROM range(12)", None)
def lr_schedule(spark, d):
    return spark.range(12).select(F.col("id").cast("int").alias("epoch"), F.round(schedules.lr_factor(F.col("id")), 6).alias("factor"))


@query("wdl_schedule", "SELECT range::INT AS epoch, round(CASE WHEN range < 2 THEN 0 WHEN range >= 4 THEN 0.5 ELSE 0.5 * (range - 2) / 2 END, 6)::DOUBLE AS weight FROM range(12)", None)
def wdl_schedule(spark, d):
    return spark.range(12).select(F.col("id").cast("int").alias("epoch"), F.round(schedules.wdl_weight(F.col("id"), 0.5), 6).alias("weight"))


@query("ema", "SELECT vec_id, round(list_reduce(embedding::DOUBLE[], lambda p, x: p * 0.9 + x * 0.1), 6) AS ema FROM embeddings", None)
def ema(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(schedules.ema(F.col("embedding").cast("array<double>"), 0.9), 6).alias("ema"))


@query("scr_layer", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: power(least(greatest(x::DOUBLE * 8, 0), 1), 2))), 6) AS activation FROM embeddings", None)
def scr_layer(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", F.round(F.aggregate(F.transform("embedding", lambda x: C.screlu(x.cast("double") * 8)), F.lit(0.0), lambda a, x: a + x), 6).alias("activation"))


@query("saturation", "SELECT round(100.0 * avg((abs(greatest(-127, least(127, round_even(x * 500, 0)))) = 127)::INT), 6) AS saturated_pct FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)", None)
def saturation(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.explode("embedding").alias("x"))
    return metrics.saturation(e.select(C.quantise(F.col("x").cast("double"), 500.0, 127).alias("q")), "q").select(F.round("saturated_pct", 6).alias("saturated_pct"))


_SUMS = """w AS (SELECT vec_id AS f, embedding::DOUBLE[] AS w FROM embeddings),
sums AS (SELECT idx, side, j, sum(w[j]) AS s FROM (SELECT idx, side, unnest(fs) AS f FROM ({})) JOIN w USING (f) CROSS JOIN (SELECT range AS j FROM range(1, 65)) GROUP BY ALL)"""
_BAG = POS + ", " + _SUMS.format("SELECT idx, 0 AS side, features AS fs FROM pos")


def _vectors(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("f"), F.col("embedding").cast("array<double>").alias("w"))


@query("feature_bag_sum", "SELECT idx, array_to_string(list(printf('%.4f', round(coalesce(s, 0), 4) + 0.0) ORDER BY j), ' ') AS bag FROM (SELECT idx, j, s FROM pos CROSS JOIN (SELECT range AS j FROM range(1, 65)) LEFT JOIN sums USING (idx, j)) GROUP BY idx", _BAG)
def feature_bag_sum(spark, d):
    sums = scoring.bag_sums(P.positions(spark, d), _vectors(spark, d), 64)
    return sums.select("idx", F.array_join(F.transform("acc", lambda x: F.format_string("%.4f", F.round(x, 4) + 0.0)), " ").alias("bag"))


def _head(spark, d) -> scoring.Head:
    rows = {r.vec_id: list(map(float, r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id < 32").collect()}
    return scoring.Head([rows[r] + rows[r + 8] for r in range(8)], [rows[16 + b][:8] for b in range(8)], rows[24][:8], rows[25][:8], rows[26])


_FORWARD = POS + ", " + _SUMS.format(f"SELECT idx, 0 AS side, CASE WHEN stm = 1 THEN list_transform(features, lambda f: {_FLIP}) ELSE features END AS fs FROM pos UNION ALL SELECT idx, 1, CASE WHEN stm = 1 THEN features ELSE list_transform(features, lambda f: {_FLIP}) END FROM pos") + """,
unit AS (SELECT idx, side, j, power(least(greatest(coalesce(s, 0) + b.w[j], 0), 1), 2) AS x FROM pos CROSS JOIN (VALUES (0), (1)) v(side) CROSS JOIN (SELECT range AS j FROM range(1, 65)) LEFT JOIN sums USING (idx, side, j) CROSS JOIN (SELECT w FROM w WHERE f = 26) b),
hid AS (SELECT idx, r, power(least(greatest(sum(x * h.w[j]) + any_value(b.w[r + 1]), 0), 1), 2) AS x FROM unit JOIN (SELECT f % 8 AS r, f // 8 AS side, w FROM w WHERE f < 16) h USING (side) CROSS JOIN (SELECT w FROM w WHERE f = 24) b GROUP BY idx, r),
fwd AS (SELECT idx, any_value(bucket) AS bucket, sum(x * o.w[r + 1]) + any_value(b.w[bucket + 1]) AS out FROM hid JOIN (SELECT idx, least(greatest((piece_count - 2) // 4, 0), 7)::INT AS bucket FROM pos) USING (idx) JOIN (SELECT f - 16 AS bucket, w FROM w WHERE f BETWEEN 16 AND 23) o USING (bucket) CROSS JOIN (SELECT w FROM w WHERE f = 25) b GROUP BY idx)"""


@query("forward_pass", "SELECT idx, bucket, round(out, 6) AS out FROM fwd", _FORWARD)
def forward_pass(spark, d):
    """The vectors of embeddings serve as weights; those of features beyond its rows are zero."""
    return scoring.forward(P.positions(spark, d), _vectors(spark, d), _head(spark, d)).withColumn("out", F.round("out", 6))


@query("fen_scores")
def fen_scores(spark, d):
    df = spark.createDataFrame([(k, f) for k, f in enumerate(FENS)], "idx long, fen string")
    return scoring.sanity(P.from_fen(df), _vectors(spark, d), _head(spark, d)).withColumn("out", F.round("out", 6))


@query("anomalies", "SELECT idx, CASE WHEN wdl = 0 AND abs(e) > 4.5 THEN 'decided draw' WHEN wdl <> 0 AND abs(e) < 0.5 THEN 'even win' WHEN wdl * (CASE WHEN stm = 1 THEN -e ELSE e END) < 0 THEN 'sign' END AS kind FROM (SELECT *, eval_raw::DOUBLE / 3000 AS e FROM pos) WHERE kind IS NOT NULL")
def anomalies(spark, d):
    e, w = F.col("eval_raw").cast("double") / 3000, F.col("wdl").cast("int")
    kind = F.when((w == 0) & (F.abs(e) > 4.5), "decided draw").when((w != 0) & (F.abs(e) < 0.5), "even win").when(w * C.eval_white_pov(e, F.col("stm")) < 0, "sign")
    return P.positions(spark, d).select("idx", kind.alias("kind")).filter("kind is not null")


# -- container, FEN -------------------------------------------------------

FENS = [
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq - 2 3", "8/8/8/4k3/8/8/4P3/4K3 w - - 0 1",
    "4k3/8/8/8/8/8/8/4KQ2 w - - 0 1", "4kq2/8/8/8/8/8/8/4K3 b - - 0 1",
]


@query("fen_features")
def fen_features(spark, d):
    df = spark.createDataFrame([(k, f) for k, f in enumerate(FENS)], "k int, fen string")
    out = P.from_fen(df)
    return out.select("k", "stm", "piece_count", X.as_text(F.col("features")).alias("white"), X.as_text(F.col("features_black")).alias("black"))


def _folder(spark) -> str:
    """A new folder that all executors have mounted: files are written there by path."""
    import os
    import uuid

    from posframe.sources.folders import shared_dir

    named = shared_dir(spark)
    if "://" in named and not named.startswith("file://"):
        raise ValueError(f"{named} is no folder of a mounted file system")
    path = f"{named.removeprefix('file://').removeprefix('file:')}/files-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


@query("container_roundtrip", "SELECT idx, flags, eval_raw, wdl, stm, piece_count, " + _JOIN.format("features") + " AS features FROM pos")
def container_roundtrip(spark, d):
    from posframe.sources import container

    path = f"{_folder(spark)}/container.bin"
    container.write(P.positions(spark, d), path, overwrite=True)
    return _ints(container.read(spark, path).select("idx", "flags", "eval_raw", "wdl", "stm", "piece_count", X.as_text(F.col("features")).alias("features")), "flags", "eval_raw", "wdl", "stm", "piece_count")


@query("index_file_roundtrip", "SELECT idx FROM pos WHERE idx % 7 = 3", POS)
def index_file_roundtrip(spark, d):
    from posframe.sources import index_files

    n = P.positions(spark, d).count()
    path = index_files.write(list(range(3, n, 7)), n, _folder(spark), seed=1)
    return index_files.read(spark, path, n)


_SIZES = (7, 999, 1000, 12345, 500_000, 1_000_000, 1_500_000, 2_000_000, 1_234_567)


@query("size_labels", f"SELECT n::BIGINT AS n, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n >= 1000000 AND n % 1000000 = 0 THEN (n // 1000000)::VARCHAR || 'M' ELSE (n // 1000)::VARCHAR || 'k' END AS label FROM (VALUES {', '.join(f'({n})' for n in _SIZES)}) t(n)", None)
def size_labels(spark, d):
    from posframe.sources import index_files

    return spark.createDataFrame([(n, index_files.size_label(n)) for n in _SIZES], "n long, label string")


@query("index_not_increasing", "SELECT place, idx, before FROM (SELECT idx AS place, idx * 37 % 101 AS idx, lag(idx * 37 % 101) OVER (ORDER BY pos.idx) AS before FROM pos) WHERE idx <= before", POS)
def index_not_increasing(spark, d):
    i = F.col("idx")
    return sampling.not_increasing(P.positions(spark, d).select(i.alias("place"), (i * 37 % 101).alias("idx")))


@query("global_permutation", "SELECT idx, (row_number() OVER (ORDER BY (idx * 2654435761 + 5) % 4294967296) - 1)::BIGINT AS place FROM pos")
def global_permutation(spark, d):
    return sampling.permuted(P.positions(spark, d).select("idx"), 5)


@query("max_batches", "SELECT idx, worker, batch_id, pos FROM bt WHERE batch_id < 2", _EPOCH)
def max_batches(spark, d):
    return sampling.epoch_batches(P.positions(spark, d), 512, 96, 9, 1, 3, max_batches=2)


@query("multi_file_cap", "SELECT k::INT AS file, (idx + k * n)::BIGINT AS idx, eval_raw FROM pos CROSS JOIN (SELECT count(*) AS n FROM pos) CROSS JOIN (VALUES (0), (1), (2)) t(k) WHERE idx + k * n < 3 * n // 2")
def multi_file_cap(spark, d):
    p = P.positions(spark, d).select("idx", "eval_raw")
    return _ints(sampling.concatenated([p, p, p], 3 * p.count() // 2).select("file", "idx", "eval_raw"), "file", "eval_raw")


@query("decode_evals", "SELECT idx, round((eval_raw::FLOAT * (1::FLOAT / 3000::FLOAT)::FLOAT)::DOUBLE, 9) AS eval_norm FROM pos")
def decode_evals(spark, d):
    return P.positions(spark, d).select("idx", F.round(C.decode_evals(F.col("eval_raw")).cast("double"), 9).alias("eval_norm"))


@query("rejected_rows", "SELECT idx, CASE WHEN idx % 40 = 1 THEN 'stm' WHEN idx % 40 = 2 THEN 'features.size' ELSE 'wdl' END AS why FROM raw WHERE idx % 40 IN (1, 2, 3) AND NOT is_capture AND NOT in_check ORDER BY idx LIMIT 5", RAW)
def rejected_rows(spark, d):
    r = F.col("idx") % 40
    df = P.events_raw(spark, d).withColumn("stm", F.when(r == 1, 2).otherwise(F.col("stm"))).withColumn("wdl", F.when(r == 3, 5).otherwise(F.col("wdl")))
    return ingest.first_rejected(df.withColumn("features", F.when(r == 2, F.slice("features", F.lit(1), F.size("features") - 1)).otherwise(F.col("features"))))


#: Block indexes of blocks of four rows, each with one broken rule, and the violations.
_BROKEN_BLOCKS = {
    "prefix_length": ([(0, 0, [0, 2, 4, 6])], 6, [(0, 4)]), "first_anchor": ([(0, 3, [0, 2, 4, 6, 8])], 11, [(0, 3)]), "anchor_recurrence": ([(0, 0, [0, 2, 4, 6, 8]), (1, 9, [0, 2, 2, 2, 2])], 11, [(0, 9)]),
    "prefix_first": ([(0, 0, [1, 2, 4, 6, 8])], 8, [(0, 1)]), "prefix_monotone": ([(0, 0, [0, 2, 6, 4, 8])], 8, [(0, 8)]), "prefix_end": ([(0, 0, [0, 2, 4, 6, 200])], 200, [(0, 200)]),
    "last_block_padding": ([(0, 0, [0, 2, 4, 6, 8]), (1, 8, [0, 2, 4, 4, 5])], 13, [(1, 5)]), "feature_total": ([(0, 0, [0, 2, 4, 6, 8])], 9, [(0, 8)]),
}


@query("violations_blocks", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', 'blocks', {i}::BIGINT, {seen}::BIGINT)" for r, (_, _, found) in _BROKEN_BLOCKS.items() for i, seen in found) + ") t(rule, scope, idx, observed)", None)
def violations_blocks(spark, d):
    out = None
    for rule, (rows, total, _) in _BROKEN_BLOCKS.items():
        t = spark.createDataFrame(rows, "block_id long, anchor long, prefix array<int>")
        found = validate.block_violations(t, total, size=4, max_count=32, last_rows=2 if rule == "last_block_padding" else None)
        out = found if out is None else out.unionByName(found)
    return out


#: A header's field, a value that it may not have, and the rule that tells.
_BROKEN_HEADERS = [
    ("version", 1, "version"), ("header_size", 128, "header_size"), ("endian", 1, "endian"), ("layout_kind", 1, "layout_kind"), ("feature_set", 9, "feature_set"), ("count_semantics", 1, "count_semantics"),
    ("eval_encoding", 0, "eval_encoding"), ("mate_encoding", 2, "mate_encoding"), ("flags_encoding", 1, "flags_encoding"), ("reserved15", 1, "reserved15"), ("shard_id", 1, "shard_id"), ("num_shards", 2, "num_shards"),
    ("global_position_start", 1, "global_position_start"), ("block_size", 512, "block_size"), ("max_count", 31, "max_count"), ("count_base", 1, "count_base"), ("has_eval_global", 0, "has_eval_global"),
    ("has_wdl_global", 0, "has_wdl_global"), ("header_flags", 1, "header_flags"), ("reserved76", 1, "reserved76"), ("fixed_scale", 0.0, "fixed_scale"), ("normal_eval_clip", -1.0, "normal_eval_clip"),
    ("storage_target_clip", 0.0, "storage_target_clip"), ("num_positions", 0, "num_positions"), ("num_blocks", 0, "num_blocks"), ("num_blocks", 5, "block_count"), ("fixed_scale", 4000.0, "eval_range"),
    ("eval_offset", 10257, "eval_alignment"), ("flags_offset", 8, "flags_offset"), ("metadata_offset", 1 << 40, "metadata_range"), ("metadata_length", 1 << 40, "metadata_range"), ("num_features_total", 1 << 40, "w_flat_overlap"),
]


@query("violations_header", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {float(v)!r}::DOUBLE, '{r}')" for f, v, r in _BROKEN_HEADERS) + ") t(field, value, rule)", None)
def violations_header(spark, d):
    from posframe.sources import container

    n, features = 10_000, 169_212
    good = container.WriteOptions().header(n, features)
    size = good["metadata_offset"] + good["metadata_length"]
    rows = [(f, float(v), container.header_violations(good | {f: v}, size)[0]) for f, v, _ in _BROKEN_HEADERS]
    return spark.createDataFrame(rows, "field string, value double, rule string")
