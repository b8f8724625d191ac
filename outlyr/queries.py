"""One query for each operator, with equivalent SQL where there is one.

Every query takes a session and the folder of the tables, and covers its whole table. Floats are rounded to six places on
both sides, with 0.0 added to lose the sign of zero.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlyr import config
from outlyr.config import Field
from outlyr.functions import extract, labels, paths
from outlyr.operators import autoencoder, composite, drain, encoders, projection, trees, windows
from outlyr.plans import detect
from outlyr.plans.engine import Engine
from outlyr.plans.service import Service
from outlyr.session import scratch, table
from outlyr.sources import files, state

QUERIES: dict = {}
ORACLES: dict = {}
ORDER = ["ts", "event_id"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def events(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def r6(c: Column) -> Column:
    return F.round(c, 6) + 0.0


def _extracted(df: DataFrame, payload: Column, fields: dict[str, Field]) -> DataFrame:
    out = extract.extracted(df.select("event_id", payload.alias("payload")), fields)
    return out.select("event_id", "features.*", "accepted", "error")


# Extraction


@query("""SELECT event_id, hour(ts)::DOUBLE AS hour, (isodow(ts) - 1)::DOUBLE AS dayofweek, (isodow(ts) >= 6)::INT::DOUBLE AS is_weekend FROM events""")
def extract_timestamp_parts(spark, sf_dir):
    offset = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+05:00").otherwise("")
    payload = F.parse_json(F.concat(F.lit('{"t": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset, F.lit('"}')))
    out = _extracted(events(spark, sf_dir), payload, {"t": Field("timestamp")})
    return out.select("event_id", F.col("`t.hour`").alias("hour"), F.col("`t.dayofweek`").alias("dayofweek"), F.col("`t.is_weekend`").alias("is_weekend"))


@query("""SELECT event_id, regexp_extract(props, '"k": ?(\\d+)', 1)::DOUBLE AS k, true AS accepted FROM events""")
def extract_json_expand(spark, sf_dir):
    payload = F.to_variant_object(F.struct(F.col("props").alias("raw")))
    return _extracted(events(spark, sf_dir), payload, {"raw": Field("json_expand"), "k": Field("numeric", source="raw.k")}).select("event_id", "k", "accepted")


@query("""SELECT event_id, (user_id % 3)::DOUBLE AS major, (event_id % 10)::DOUBLE AS minor, CASE WHEN event_id % 2 = 0 THEN (event_id % 7)::DOUBLE END AS patch FROM events""")
def extract_semver(spark, sf_dir):
    text = F.concat(F.lit(" "), F.col("user_id") % 3, F.lit("."), F.col("event_id") % 10, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("."), F.col("event_id") % 7, F.lit("-rc1"))).otherwise(""))
    out = _extracted(events(spark, sf_dir), F.to_variant_object(F.struct(text.alias("v"))), {"v": Field("semver")})
    return out.select("event_id", F.col("`v.major`").alias("major"), F.col("`v.minor`").alias("minor"), F.col("`v.patch`").alias("patch"))


@query("""
WITH o AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 ELSE 8 END AS a, event_id % 256 AS b, user_id % 256 AS c, event_id % 251 AS d FROM events)
SELECT event_id, a::DOUBLE AS o1, b::DOUBLE AS o2, c::DOUBLE AS o3, d::DOUBLE AS o4,
       (a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c = 0 AND (d <= 7 OR d IN (170, 171))) OR (a = 192 AND b = 0 AND c = 2))::INT::DOUBLE AS is_private FROM o""")
def extract_ipv4(spark, sf_dir):
    first = F.when(F.col("event_id") % 4 == 0, 10).when(F.col("event_id") % 4 == 1, 172).when(F.col("event_id") % 4 == 2, 192).otherwise(8)
    text = F.concat_ws(".", first, F.col("event_id") % 256, F.col("user_id") % 256, F.col("event_id") % 251)
    out = _extracted(events(spark, sf_dir), F.to_variant_object(F.struct(text.alias("ip"))), {"ip": Field("ip_address")})
    return out.select("event_id", *[F.col(f"`ip.{n}`").alias(n) for n in ("o1", "o2", "o3", "o4", "is_private")])


@query("""
WITH n AS (SELECT event_id, CASE WHEN user_id = 0 THEN '2001:db8::/48' ELSE '2001:db8:' || format('{:x}', user_id) || '::/48' END AS network FROM events)
SELECT event_id, 1.0::DOUBLE AS is_private, round(('0x' || substr(sha256(network), 1, 8))::BIGINT / 4294967295.0::DOUBLE, 6) + 0.0 AS subnet_hash FROM n""")
def extract_ipv6(spark, sf_dir):
    text = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("user_id"))), F.lit("::"), F.lower(F.hex(F.col("event_id") % 65536)))
    out = _extracted(events(spark, sf_dir), F.to_variant_object(F.struct(text.alias("ip"))), {"ip": Field("ip_address")})
    return out.select("event_id", F.col("`ip.is_private`").alias("is_private"), r6(F.col("`ip.subnet_hash`")).alias("subnet_hash"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN value WHEN event_id % 5 = 1 THEN user_id::DOUBLE END AS n, CASE WHEN event_id % 2 = 0 THEN (event_id % 4 = 0)::INT::DOUBLE END AS b,
       event_id % 5 IN (0, 1) AND event_id % 2 = 0 AS accepted,
       CASE event_id % 5 WHEN 2 THEN 'n: expected int or float, got str' WHEN 3 THEN 'n: expected int or float, got bool' WHEN 4 THEN 'n: expected int or float, got NoneType'
                         ELSE CASE WHEN event_id % 2 = 1 THEN 'b: expected bool, got list' END END AS error FROM events""")
def extract_type_errors(spark, sf_dir):
    kind = F.col("event_id") % 5
    n = F.when(kind == 0, F.col("value").cast("string")).when(kind == 1, F.col("user_id").cast("string")).when(kind == 2, '"7"').when(kind == 3, "true").otherwise("null")
    b = F.when(F.col("event_id") % 2 == 1, "[1]").when(F.col("event_id") % 4 == 0, "true").otherwise("false")
    payload = F.parse_json(F.concat(F.lit('{"n": '), n, F.lit(', "b": '), b, F.lit("}")))
    return _extracted(events(spark, sf_dir), payload, {"n": Field("numeric"), "b": Field("boolean")})


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'True' WHEN 2 THEN user_id::VARCHAR WHEN 3 THEN 'None' END AS s FROM events""")
def extract_strings(spark, sf_dir):
    kind = F.col("event_id") % 5
    s = F.when(kind == 0, F.concat(F.lit('{"s": "'), "event_type", F.lit('"}'))).when(kind == 1, '{"s": true}').when(kind == 2, F.concat(F.lit('{"s": '), "user_id", F.lit("}"))).when(kind == 3, '{"s": null}').otherwise("{}")
    return _extracted(events(spark, sf_dir), F.parse_json(s), {"s": Field("str_categorical")}).select("event_id", "s")


@query("""SELECT event_id, value AS amount, value AS again, (isodow(ts) - 1)::DOUBLE AS dayofweek, (isodow(ts) >= 6)::INT::DOUBLE AS is_weekend FROM events""")
def extract_aliases_and_overrides(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.to_variant_object(F.struct(F.struct(F.col("value").alias("v")).alias("x"), day.alias("t"), F.lit(1).alias("unlisted")))
    fields = {"amount": Field("numeric", source="x.v"), "again": Field("numeric", source="x.v"), "t": Field("timestamp"), "t.hour": Field("ignore")}
    out = _extracted(events(spark, sf_dir), payload, fields)
    return out.select("event_id", "amount", "again", F.col("`t.dayofweek`").alias("dayofweek"), F.col("`t.is_weekend`").alias("is_weekend"))


@query("""SELECT event_id, (event_id % 97)::DOUBLE AS depth, (user_id % 3)::DOUBLE AS major, true AS accepted FROM events""")
def extract_json_in_json(spark, sf_dir):
    """An object in a text in an object in a text; what lies in it is handled as its own field says."""
    inner = F.to_json(F.struct((F.col("event_id") % 97).alias("depth"), F.concat_ws(".", F.col("user_id") % 3, F.lit("0"), F.lit("1")).alias("version")))
    outer = F.to_json(F.struct(F.struct(inner.alias("body")).alias("request")))
    fields = {"raw": Field("json_expand"), "again": Field("json_expand", source="raw.request.body"), "depth": Field("numeric", source="again.depth"), "v": Field("semver", source="again.version")}
    out = _extracted(events(spark, sf_dir), F.to_variant_object(F.struct(outer.alias("raw"))), fields)
    return out.select("event_id", "depth", F.col("`v.major`").alias("major"), "accepted")


@query("""
SELECT event_id, value AS one, (event_id % 97)::DOUBLE AS two, CASE WHEN event_id % 11 > 0 THEN (event_id % 7)::DOUBLE END AS three, CASE WHEN event_id % 11 > 0 THEN (event_id % 5)::DOUBLE END AS minor,
       CASE WHEN event_id % 11 > 0 THEN (event_id % 5)::DOUBLE END AS again, CASE WHEN event_id % 11 = 0 THEN 'raw.inner.inner: expected JSON object, got list' END AS error FROM events""")
def extract_json_depth(spark, sf_dir):
    """Texts in texts, three levels deep, and aliases of what the deepest level's expansion made."""
    n = lambda k: (F.col("event_id") % k).alias("n")
    deepest = F.when(F.col("event_id") % 11 == 0, "[1]").otherwise(F.to_json(F.struct(n(7), F.concat(F.lit("1."), F.col("event_id") % 5).alias("version"))))
    middle = F.to_json(F.struct(n(97), deepest.alias("inner")))
    outer = F.to_json(F.struct(F.col("value").alias("n"), middle.alias("inner")))
    fields = {"raw": Field("json_expand"), "raw.n": Field("numeric"), "raw.inner": Field("json_expand"), "raw.inner.n": Field("numeric"), "raw.inner.inner": Field("json_expand")}
    fields |= {"raw.inner.inner.n": Field("numeric"), "raw.inner.inner.version": Field("semver"), "again": Field("numeric", source="raw.inner.inner.version.minor")}
    out = _extracted(events(spark, sf_dir), F.to_variant_object(F.struct(outer.alias("raw"))), fields)
    named = {"one": "raw.n", "two": "raw.inner.n", "three": "raw.inner.inner.n", "minor": "raw.inner.inner.version.minor", "again": "again"}
    return out.select("event_id", *[F.col(f"`{c}`").alias(name) for name, c in named.items()], "error")


@query("""
SELECT event_id, event_id % 6 = 5 AS accepted, CASE event_id % 6
  WHEN 0 THEN 't: cannot parse ''' || event_type || ''' as datetime' WHEN 1 THEN 'ip: cannot parse ''' || event_type || ''' as IP address' WHEN 2 THEN 'v: cannot parse ''' || event_type || ''' as semver'
  WHEN 3 THEN 'j: cannot parse ''' || event_type || ''' as JSON' WHEN 4 THEN 'j: expected JSON object, got list' END AS error FROM events""")
def extract_text_errors(spark, sf_dir):
    """What texts that are no moments, addresses, versions or objects are refused with."""
    kind, word = F.col("event_id") % 6, F.col("event_type")
    given = lambda k, name, good: F.when(kind == k, word).otherwise(F.lit(good)).alias(name)
    j = F.when(kind == 3, word).when(kind == 4, "[1]").otherwise("{}").alias("j")
    payload = F.to_variant_object(F.struct(given(0, "t", "2024-01-01T00:00:00Z"), given(1, "ip", "10.0.0.1"), given(2, "v", "1.2.3"), j))
    fields = {"t": Field("timestamp"), "ip": Field("ip_address"), "v": Field("semver"), "j": Field("json_expand")}
    return _extracted(events(spark, sf_dir), payload, fields).select("event_id", "accepted", "error")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE user_id::VARCHAR END AS path, user_id::VARCHAR AS identifier, NULL::VARCHAR AS missing FROM events""")
def path_and_identifiers(spark, sf_dir):
    literal = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "a.b": "'), "event_type", F.lit('"'))).otherwise("")
    payload = F.parse_json(F.concat(F.lit('{"a": {"b": '), "user_id", F.lit("}"), literal, F.lit("}")))
    df = events(spark, sf_dir).select("event_id", payload.alias("p"))
    found = df.select("event_id", paths.at(F.col("p"), "a.b").cast("string").alias("path"), paths.identifiers(F.col("p"), ["a.b", "a.c"]).alias("ids"))
    return found.select("event_id", "path", F.col("ids")["a.b"].alias("identifier"), F.col("ids")["a.c"].alias("missing"))


# Encoders


def _z_sql(keys: str) -> str:
    w = f"({keys} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
SELECT event_id, round(CASE WHEN n < 2 OR lo = hi THEN 0 ELSE greatest(-5, least(5, (value - m) / s)) END, 6) + 0.0 AS z
FROM (SELECT event_id, value, count(value) OVER {w} AS n, avg(value) OVER {w} AS m, stddev_pop(value) OVER {w} AS s, min(value) OVER {w} AS lo, max(value) OVER {w} AS hi FROM events)"""


@query(_z_sql("PARTITION BY user_id"))
def enc_standard_scaler_user(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r6(encoders.standard_scaler(F.col("value"), ["user_id"], ORDER)).alias("z"))


@query(_z_sql(""))
def enc_standard_scaler_global(spark, sf_dir):
    rows = encoders.blocks(events(spark, sf_dir), "value", [], ORDER, F.date_trunc("DAY", "ts"))
    return rows.select("event_id", r6(encoders.z_score(F.col("value"), *[F.col(c) for c in ("n", "mean", "std", "low", "high")])).alias("z"))


@query("""
SELECT event_id, round(CASE WHEN lo = hi THEN 0 ELSE (value - lo) / (hi - lo) END, 6) + 0.0 AS x
FROM (SELECT event_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def enc_minmax(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r6(encoders.min_max_scaler(F.col("value"), ["user_id"], ORDER)).alias("x"))


@query("""
SELECT event_id, round(CASE WHEN n = 0 THEN 0 ELSE seen / n END, 6) + 0.0 AS x
FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
             count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM events)""")
def enc_frequency(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r6(encoders.frequency_encoder(F.col("event_type"), "event_type", ["user_id"], ORDER)).alias("x"))


_INDEX = """WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min((ts, event_id))) AS idx FROM (SELECT user_id, event_type, {'t': ts, 'e': event_id} AS o, ts, event_id FROM events) GROUP BY user_id, event_type)"""
_INDEX = _INDEX.replace("min((ts, event_id))", "min(o)")


@query(_INDEX + " SELECT event_id, idx::INT AS idx FROM events JOIN f USING (user_id, event_type)")
def enc_label_index(spark, sf_dir):
    return encoders.label_index(events(spark, sf_dir), "event_type", ["user_id"], ORDER, "idx").select("event_id", "idx")


@query("""
WITH f AS (SELECT user_id, row_number() OVER (ORDER BY min({'t': ts, 'e': event_id})) AS idx FROM events GROUP BY user_id)
SELECT event_id, idx::INT AS idx FROM events JOIN f USING (user_id)""")
def enc_label_index_global(spark, sf_dir):
    """Ids of users by first appearance among all events: one key with all rows, ranked by days."""
    return encoders.label_index(events(spark, sf_dir), "user_id", [], ORDER, "idx", block=F.to_date("ts")).select("event_id", "idx")


@query(_INDEX + " SELECT event_id, (idx = 1)::INT::DOUBLE AS f1, (idx = 2)::INT::DOUBLE AS f2, (idx = 3)::INT::DOUBLE AS f3, CASE WHEN idx > 3 THEN 'For ''event_type'' are only 3 categories available' END AS error FROM events JOIN f USING (user_id, event_type)".replace("(idx = ", "CASE WHEN idx <= 3 THEN (idx = ").replace("::DOUBLE AS", "::DOUBLE END AS"))
def enc_one_hot(spark, sf_dir):
    df = encoders.label_index(events(spark, sf_dir), "event_type", ["user_id"], ORDER, "idx")
    hot = encoders.one_hot(F.col("idx"), 3)
    return df.select("event_id", *[F.get(hot, F.lit(i)).alias(f"f{i + 1}") for i in range(3)], encoders.one_hot_error(F.col("idx"), "event_type", 3).alias("error"))


def _bucket_sql(text: str, n: int) -> str:
    """The MD5's bytes from the last to the first, one step each."""
    digest = f"md5({text})"
    return f"list_reduce(list_transform(range(15, -1, -1), lambda i: ('0x' || substr({digest}, 2 * i::INT + 1, 2))::BIGINT), lambda r, b: (r * 256 + b) % {n}, 0::BIGINT)"


@query(f"SELECT event_id, {_bucket_sql(chr(39) + '0:event_type=' + chr(39) + ' || event_type', 2000)} AS bucket FROM events")
def enc_hash_index(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", encoders.hash_index("event_type", F.col("event_type")).alias("bucket"))


@query(f"SELECT event_id, 'user__' || {_bucket_sql(chr(39) + '0:user=' + chr(39) + ' || user_id', 1_048_576)} AS feature, 1.0::DOUBLE AS x FROM events")
def enc_one_hot_hash(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.explode(encoders.one_hot_hash("user", F.col("user_id").cast("string"))).alias("feature", "x"))


@query("SELECT event_id, value AS passed, 0.0::DOUBLE AS nothing FROM events")
def enc_pass_through_and_no_op(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", encoders.pass_through(F.col("value")).alias("passed"), encoders.no_op(F.col("value")).alias("nothing"))


@query("""
WITH s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, min(value) OVER w AS lo, max(value) OVER w AS hi
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
     h AS (SELECT user_id, n, m, s, lo, hi FROM s WHERE pos = 20),
     p AS (SELECT a.event_id, a.value, CASE WHEN a.pos <= 20 THEN h.n ELSE a.n END AS n, CASE WHEN a.pos <= 20 THEN h.m ELSE a.m END AS m, CASE WHEN a.pos <= 20 THEN h.s ELSE a.s END AS s,
                  CASE WHEN a.pos <= 20 THEN h.lo ELSE a.lo END AS lo, CASE WHEN a.pos <= 20 THEN h.hi ELSE a.hi END AS hi FROM s a LEFT JOIN h USING (user_id))
SELECT event_id, round(CASE WHEN n IS NULL THEN NULL WHEN n < 2 OR lo = hi THEN 0 ELSE greatest(-5, least(5, (value - m) / s)) END, 6) + 0.0 AS z FROM p""")
def enc_warmup_flush(spark, sf_dir):
    return encoders.warmed_up(events(spark, sf_dir), "value", ["user_id"], ORDER, 20, "z").select("event_id", r6(F.col("z")).alias("z"))


_SPLIT = "e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) > count(*) OVER () - floor(count(*) OVER () * 0.2) AS is_score FROM events)"


@query(f"""
WITH {_SPLIT}, s AS (SELECT user_id, count(value) AS n, avg(value) AS m, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM e WHERE NOT is_score GROUP BY user_id)
SELECT event_id, round(CASE WHEN n IS NULL THEN NULL WHEN n < 2 OR lo = hi THEN 0 ELSE greatest(-5, least(5, (value - m) / sd)) END, 6) + 0.0 AS z FROM e LEFT JOIN s USING (user_id) WHERE is_score""")
def enc_frozen_score(spark, sf_dir):
    rows = windows.head_tail(events(spark, sf_dir), ORDER, 0.2)
    state = encoders.fitted(rows.filter("not is_score"), "value", ["user_id"])
    return encoders.frozen(rows.filter("is_score"), state, "value", ["user_id"], "z").select("event_id", r6(F.col("z")).alias("z"))


# Count windows


@query("""
WITH n AS (SELECT user_id, value, floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 10)::BIGINT AS w FROM events)
SELECT user_id, w AS "window", count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END, 6) + 0.0 AS std FROM n GROUP BY ALL HAVING count(*) = 10""")
def stats_window_tumbling(spark, sf_dir):
    out = windows.window_statistics(events(spark, sf_dir), ["user_id"], ORDER, "value", 10)
    return out.select("user_id", "window", "n", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("""
WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
     s AS (SELECT event_id, pos, k, pos - 4 * k AS m FROM n, (SELECT unnest([0, 1]) AS k)),
     r AS (SELECT event_id, arg_min(k, (m % 8) * 10 + k) AS slice, min(m % 8) AS age FROM s WHERE pos >= 8 AND m >= 8 GROUP BY event_id)
SELECT event_id, coalesce(slice, -1)::BIGINT AS slice, coalesce(age, -1)::BIGINT AS reference_age FROM n LEFT JOIN r USING (event_id)""")
def hst_reference_age(spark, sf_dir):
    rows = windows.numbered(events(spark, sf_dir), ["user_id"], ORDER).withColumn("a", windows.active_slice(F.col("at"), 8, 2))
    return rows.select("event_id", F.coalesce("a.slice", F.lit(-1)).alias("slice"), F.coalesce("a.age", F.lit(-1)).alias("reference_age"))


@query("""SELECT event_id, round(avg(value) OVER w, 6) + 0.0 AS mean, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)""")
def rolling_buffer(spark, sf_dir):
    w = windows.rolling(["user_id"], ORDER, 25)
    return events(spark, sf_dir).select("event_id", r6(F.avg("value").over(w)).alias("mean"), F.count("*").over(w).alias("n"))


@query("""
WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
SELECT event_id, pos >= 20 AND (pos - 20) % 5 = 0 AS retrains, CASE WHEN pos >= 20 THEN (pos - 20) % 5 ELSE -1 END AS since FROM n""")
def retrain_schedule(spark, sf_dir):
    rows = windows.numbered(events(spark, sf_dir), ["user_id"], ORDER)
    return rows.select("event_id", windows.retrains(F.col("at"), 20, 5).alias("retrains"), F.coalesce(windows.events_since(F.col("at"), 20, 5), F.lit(-1)).alias("since"))


# Half-space trees

PLAN = detect.Plan(event=("event_id",), order=("ts", "event_id"), numbers=(("value", -5.0, 5.0), ("hour", 0.0, 23.0)), scaled=("value",), cohorts=(("all", (), 0.25), ("type", ("event_type",), 0.75)), window=250, trees=25)


def _split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = windows.head_tail(events(spark, sf_dir).withColumn("hour", F.hour("ts").cast("double")), ORDER, 0.2)
    return rows.filter("not is_score").drop("is_score"), rows.filter("is_score").drop("is_score")


def _paths_sql(rows: str, p: detect.Plan, name: str) -> str:
    """CTEs that walk rows(rid, f0, f1, ...) down all trees: name(rid, tree, depth, node)."""
    forest = p.forests()[0]
    cells = ", ".join(f"({t}, {n}, {f}, {forest.threshold[t][n]!r})" for t in range(forest.trees) for n, f in enumerate(forest.feature[t]) if n)
    pick = "CASE feature " + " ".join(f"WHEN {i} THEN f{i}" for i in range(len(p.numbers))) + " END"
    ctes = [f"{name}_t(tree, node, feature, threshold) AS (VALUES {cells})", f"{name}_0 AS (SELECT r.*, tree, 1 AS node FROM {rows} r, (SELECT DISTINCT tree FROM {name}_t))"]
    fs = ", ".join(f"p.f{i}" for i in range(len(p.numbers)))
    for d in range(1, forest.height + 1):
        ctes.append(f"{name}_{d} AS (SELECT p.rid, {fs}, p.tree, 2 * p.node + CASE WHEN round({pick}, 9) >= threshold THEN 1 ELSE 0 END AS node FROM {name}_{d - 1} p JOIN {name}_t t ON p.tree = t.tree AND p.node = t.node)")
    union = " UNION ALL ".join(f"SELECT rid, tree, {d} AS depth, node FROM {name}_{d}" for d in range(forest.height + 1))
    return ", ".join([*ctes, f"{name} AS ({union})"])


def _hst_sql(p: detect.Plan, digits: int = 6) -> str:
    """CTEs: split, cohorts, vectors of training (trained) and scored rows (frozen), the reference windows' masses and means."""
    w = "(PARTITION BY cohort_key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    z = lambda n, m, s, lo, hi: f"round(CASE WHEN {n} < 2 OR {lo} = {hi} THEN 0 ELSE greatest(-5, least(5, (value - {m}) / {s})) END, {digits})"
    return f"""
{_SPLIT}, c AS (SELECT e.*, hour(ts)::DOUBLE AS hour, 'all' AS cohort, 'all' AS cohort_key, 0.25 AS weight FROM e UNION ALL SELECT e.*, hour(ts)::DOUBLE, 'type', 'type::' || event_type, 0.75 FROM e),
tr AS (SELECT *, row_number() OVER (PARTITION BY cohort_key ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY cohort_key) AS trained, count(value) OVER {w} AS n, avg(value) OVER {w} AS m, stddev_pop(value) OVER {w} AS s, min(value) OVER {w} AS lo, max(value) OVER {w} AS hi FROM c WHERE NOT is_score),
ref AS (SELECT cohort_key, {z("n", "m", "s", "lo", "hi")}::DOUBLE AS f0, hour AS f1, row_number() OVER () AS rid FROM tr WHERE trained >= {p.window} AND floor((pos - 1) / {p.window}) = floor(trained / {p.window}) - 1),
{_paths_sql("(SELECT rid, f0, f1 FROM ref)", p, "pt")},
mass AS (SELECT cohort_key, tree, node, count(*) AS mass FROM pt JOIN ref USING (rid) GROUP BY ALL),
mean AS (SELECT cohort_key, avg(f0) AS m0, avg(f1) AS m1 FROM ref GROUP BY cohort_key),
age AS (SELECT cohort_key, count(*) AS trained FROM tr GROUP BY cohort_key),
st AS (SELECT cohort_key, count(value) AS n, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM tr GROUP BY cohort_key),
sc AS (SELECT event_id, cohort, cohort_key, weight, CASE WHEN n IS NULL THEN 0 ELSE {z("n", "m", "s", "lo", "hi")} END::DOUBLE AS f0, hour AS f1, row_number() OVER () AS rid FROM (SELECT * FROM c WHERE is_score) LEFT JOIN st USING (cohort_key))"""


def _score_sql(rows: str, walked: str, p: detect.Plan, name: str) -> str:
    """CTE name(rid, score) of rows(rid, cohort_key) that walked(rid, tree, depth, node) has walked."""
    h = p.forests()[0].height
    scale = float(p.trees * p.window * ((2 << h) - 1))
    return f"""
{name}_m AS (SELECT w.rid, w.tree, depth, coalesce(mass, 0) AS mass FROM {walked} w JOIN {rows} r USING (rid) LEFT JOIN mass k ON k.cohort_key = r.cohort_key AND k.tree = w.tree AND k.node = w.node),
{name}_o AS (SELECT *, coalesce(min(mass) OVER (PARTITION BY rid, tree ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e18) >= 0.1 * {p.window} AS open FROM {name}_m),
{name} AS (SELECT rid, greatest(0, least(100, 100 * (1 - sum(CASE WHEN open THEN mass * 2 ** depth ELSE 0 END) / {scale}))) AS score FROM {name}_o GROUP BY rid)"""


_HAS = "sc s JOIN age a USING (cohort_key)"
_LABEL = "CASE WHEN x IS NULL THEN 'INSUFFICIENT_DATA' WHEN x < 30 THEN 'NORMAL' WHEN x < 50 THEN 'SLIGHTLY_ELEVATED' WHEN x < 70 THEN 'ELEVATED' WHEN x < 85 THEN 'ANOMALOUS' ELSE 'HIGHLY_ANOMALOUS' END"
_SCORED = f"""
WITH {_hst_sql(PLAN)}, {_paths_sql("(SELECT rid, f0, f1 FROM sc)", PLAN, "ps")}, {_score_sql("sc", "ps", PLAN, "got")},
fin AS (SELECT event_id, cohort, s.cohort_key, weight, CASE WHEN trained >= {PLAN.window} THEN score END AS score, CASE WHEN trained >= {PLAN.window} THEN trained % {PLAN.window} END AS reference_age FROM sc s JOIN got USING (rid) LEFT JOIN age a ON a.cohort_key = s.cohort_key)"""


@query(f"WITH {_hst_sql(PLAN)} SELECT cohort_key, tree, node, mass FROM mass")
def hst_mass(spark, sf_dir):
    _, model = detect.fit(_split(spark, sf_dir)[0], PLAN)
    trees_ = model.select("cohort_key", F.posexplode("mass").alias("tree", "held"))
    return trees_.select("cohort_key", "tree", F.posexplode("held").alias("node", "mass")).filter("mass > 0").withColumn("mass", F.col("mass").cast("long"))


@query(f"{_SCORED} SELECT event_id, cohort, cohort_key, round(score, 6) + 0.0 AS score, {_LABEL.replace('x ', 'round(score, 9) ')} AS label, reference_age FROM fin")
def hst_score(spark, sf_dir):
    train, rest = _split(spark, sf_dir)
    out = detect.score(rest, *detect.fit(train, PLAN), PLAN)
    return out.select("event_id", "cohort", "cohort_key", r6(F.col("score")).alias("score"), "label", F.col("reference_age").cast("long").alias("reference_age"))


@query(f"{_SCORED}, o AS (SELECT event_id, sum(weight * score) / sum(CASE WHEN score IS NOT NULL THEN weight END) AS x FROM fin GROUP BY event_id) SELECT event_id, round(x, 6) + 0.0 AS composite_score, CASE WHEN x IS NULL THEN 'insufficient_data' ELSE {_LABEL.replace('x ', 'round(x, 9) ')} END AS status FROM o")
def hst_cohort_composite(spark, sf_dir):
    train, rest = _split(spark, sf_dir)
    return detect.detect(train, rest, PLAN, digits=6)[1]


@query(f"""
WITH {_hst_sql(PLAN)}, va AS (SELECT rid * 3 + v AS rid, rid AS base, cohort, cohort_key, v, CASE WHEN v = 1 THEN f0 ELSE m0 END AS f0, CASE WHEN v = 2 THEN f1 ELSE m1 END AS f1, event_id FROM sc JOIN mean USING (cohort_key), (SELECT unnest([0, 1, 2]) AS v)),
{_paths_sql("(SELECT rid, f0, f1 FROM va)", PLAN, "pv")}, {_score_sql("va", "pv", PLAN, "got")},
b AS (SELECT event_id, cohort, max(CASE WHEN v = 0 THEN score END) AS s0, max(CASE WHEN v = 1 THEN score END) AS s1, max(CASE WHEN v = 2 THEN score END) AS s2 FROM va JOIN got USING (rid) GROUP BY event_id, cohort),
sw AS (SELECT *, abs(s2 - s0) > abs(s1 - s0) AS swapped FROM b)
SELECT event_id, cohort, round(s0, 4) AS baseline, 'value' AS field, CASE WHEN swapped THEN 1 ELSE 0 END AS place, round(s1 - s0, 4) + 0.0 AS delta FROM sw
UNION ALL SELECT event_id, cohort, round(s0, 4), 'hour', CASE WHEN swapped THEN 0 ELSE 1 END, round(s2 - s0, 4) + 0.0 FROM sw""")
def hst_explain(spark, sf_dir):
    train, rest = _split(spark, sf_dir)
    out = detect.score(rest, *detect.fit(train, PLAN), PLAN, explain=True).filter("explanation is not null")
    each = out.select("event_id", "cohort", F.col("explanation.baseline").alias("baseline"), F.posexplode("explanation.features").alias("place", "f"))
    return each.select("event_id", "cohort", "baseline", "f.field", "place", (F.col("f.delta") + 0.0).alias("delta"))


# A configuration, learned and scored

ENGINE = config.parse({
    "features": {"f": {"value": "numeric"}},
    "identifiers": ["id"],
    "cohorts": [{"name": "all", "features_config": "f", "weight": 0.25}, {"name": "type", "features_config": "f", "fields": ["event_type"], "weight": 0.75}],
})
_ENGINE_PLAN = detect.Plan(event=("event_id",), order=("event_id",), numbers=(("value", -5.0, 5.0),), scaled=("value",), cohorts=PLAN.cohorts, window=250, trees=25)
_ENGINE = f"""
WITH {_hst_sql(_ENGINE_PLAN, 9)}, {_paths_sql("(SELECT rid, f0 FROM sc)", _ENGINE_PLAN, "ps")}, {_score_sql("sc", "ps", _ENGINE_PLAN, "got")},
fin AS (SELECT event_id, cohort, s.cohort_key, weight, CASE WHEN trained >= 250 THEN score END AS score, CASE WHEN trained >= 250 THEN trained % 250 END AS reference_age FROM sc s JOIN got USING (rid) LEFT JOIN age a ON a.cohort_key = s.cohort_key)""".replace("ts, event_id", "event_id")


def _payloads(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The events as a service gets them, the earlier ones to learn from and the last fifth to score."""
    rows = windows.head_tail(events(spark, sf_dir), ["event_id"], 0.2)
    payload = F.to_variant_object(F.struct("value", "event_type", F.col("user_id").cast("string").alias("id")))
    rows = rows.select(F.col("event_id").alias("seq"), payload.alias("payload"), "is_score")
    return rows.filter("not is_score").drop("is_score"), rows.filter("is_score").drop("is_score")


@query(f"{_ENGINE} SELECT event_id, cohort AS name, cohort_key AS key, weight::DOUBLE AS weight, round(score, 6) + 0.0 AS score, {_LABEL.replace('x ', 'round(score, 9) ')} AS score_label, reference_age FROM fin")
def engine_cohort_scores(spark, sf_dir):
    """What a configuration's cohorts say of each event to score, after they learned all earlier events."""
    out = Engine(ENGINE).run(*_payloads(spark, sf_dir)).select(F.col("seq").alias("event_id"), F.inline("scores"))
    return out.select("event_id", "name", "key", "weight", r6(F.col("anomaly_score")).alias("score"), "score_label", F.col("properties")["reference_age"].alias("reference_age"))


@query(f"{_ENGINE}, o AS (SELECT event_id, sum(weight * score) / sum(CASE WHEN score IS NOT NULL THEN weight END) AS x FROM fin GROUP BY event_id) SELECT event_id, true AS accepted, user_id::VARCHAR AS identifier, round(x, 2) + 0.0 AS composite_score, CASE WHEN x IS NULL THEN 'insufficient_data' ELSE {_LABEL.replace('x ', 'round(x, 9) ')} END AS status FROM o JOIN events USING (event_id)")
def engine_scores(spark, sf_dir):
    """The response to each event to score."""
    out = Engine(ENGINE).run(*_payloads(spark, sf_dir))
    return out.select(F.col("seq").alias("event_id"), "accepted", F.col("identifiers")["id"].alias("identifier"), (F.col("composite_score") + 0.0).alias("composite_score"), "status")


@query(f"{_ENGINE} SELECT event_id, cohort AS name, cohort_key AS key, weight::DOUBLE AS weight, round(score, 6) + 0.0 AS score, {_LABEL.replace('x ', 'round(score, 9) ')} AS score_label, reference_age FROM fin")
def engine_state_scores(spark, sf_dir):
    """The same from stored models, which learned the earlier events in three parts and then were joined with those to score."""
    earlier, later = _payloads(spark, sf_dir)
    service = Service(spark, ENGINE, scratch(spark, "models"))
    low, high = earlier.agg(F.min("seq"), F.max("seq")).first()
    cuts = [low + (high + 1 - low) * k // 3 for k in range(4)] if low is not None else [0, 0, 0, 0]
    for a, b in zip(cuts, cuts[1:]):
        service.learn(earlier.filter((F.col("seq") >= a) & (F.col("seq") < b)))
    out = service.score(later).select(F.col("seq").alias("event_id"), F.inline("scores"))
    return out.select("event_id", "name", "key", "weight", r6(F.col("anomaly_score")).alias("score"), "score_label", F.col("properties")["reference_age"].alias("reference_age"))


@query("""
WITH e AS (SELECT *, event_id // 500 AS b FROM events)
SELECT event_id, round(coalesce((count(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / nullif(count(*) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), 6) + 0.0 AS share FROM e""")
def enc_frequency_global(spark, sf_dir):
    """Shares of values among all earlier rows, from counts of blocks: no task holds the rows of the one key that there is."""
    rows = encoders.frequency_blocks(events(spark, sf_dir).select("event_id", "event_type"), "event_type", [], ["event_id"], F.expr("event_id div 500"))
    return rows.select("event_id", r6(F.coalesce(F.try_divide("seen", "before"), F.lit(0.0))).alias("share"))


@query("""
WITH k AS (SELECT event_id, value, 'user::' || user_id AS key, row_number() OVER w AS pos, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, min(value) OVER w AS lo, max(value) OVER w AS hi
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, 'value' AS field, value, CASE WHEN pos >= 10 THEN round(CASE WHEN n < 2 OR lo = hi THEN 0 ELSE greatest(-5, least(5, (value - m) / s)) END, 6) + 0.0 END AS preprocessed FROM k""")
def engine_learned(spark, sf_dir):
    """The response to each learned event of a cohort that warms up: its fields, with nothing preprocessed before the tenth of a key."""
    cohort = {"name": "user", "features_config": "f", "fields": ["id"], "warmup_count": 10}
    rows = events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.to_variant_object(F.struct("value", F.col("user_id").cast("string").alias("id"))).alias("payload"))
    out = Engine(config.parse({"features": {"f": {"value": "numeric"}}, "cohorts": [cohort]})).learned(rows)
    each = out.filter("accepted").select(F.col("seq").alias("event_id"), F.inline(F.get("cohorts", F.lit(0))["features"]))
    return each.select("event_id", "field", F.col("value").cast("double").alias("value"), r6(F.get(F.try_element_at("preprocessed", F.lit("value")), F.lit(0))).alias("preprocessed"))


@query("""
WITH t AS (SELECT event_type, dense_rank() OVER (ORDER BY first) AS id FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type)),
     n AS (SELECT count(*) AS n, count(*) FILTER (id <= 3) AS fits FROM events JOIN t USING (event_type))
SELECT cohort, cohort AS key, CASE WHEN cohort = 'after' THEN fits ELSE n END AS events, CASE WHEN cohort = 'before' THEN n ELSE fits END AS trained FROM n, (SELECT unnest(['before', 'narrow', 'after']) AS cohort)""")
def engine_refusals(spark, sf_dir):
    """What each cohort's stored models hold where the second refuses events: those before it learned them, those after it did not."""
    narrow = {"type": "str_categorical", "preprocessor": {"name": "OneHotEncoder", "params": {"n_categories": 3}}}
    cohorts = [{"name": n, "features_config": "g" if n == "narrow" else "f"} for n in ("before", "narrow", "after")]
    service = Service(spark, config.parse({"features": {"f": {"value": "numeric"}, "g": {"event_type": narrow}}, "cohorts": cohorts}), scratch(spark, "models"))
    rows = events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.to_variant_object(F.struct("value", "event_type")).alias("payload"))
    service.learn(rows.filter("seq % 2 = 0 or seq < 1000"))
    service.learn(rows.filter("seq % 2 = 1 and seq >= 1000"))
    return service.store.statistics().select("cohort", "key", "events", "trained")


# Scores, labels, metrics


@query("""
WITH b AS (SELECT l_extendedprice AS x FROM lineitem), r AS (SELECT x, rank() OVER (ORDER BY x) - 1 AS below, count(*) OVER () AS n FROM b)
SELECT DISTINCT x::DOUBLE AS x, round(100.0 * below / n, 6) AS percentile FROM r""")
def percentile_score(spark, sf_dir):
    """The share of baseline errors below each, as a rank: sums of value ranges instead of an array of all values."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("x"))
    per = b.groupBy("x").agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("x") / 1000))
    from pyspark.sql import Window

    heads = per.groupBy("bin").agg(F.sum("n").alias("n"))
    heads = heads.select("bin", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("bin").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("inside", inside).join(heads.select("bin", "ahead", "total"), "bin").select("x", F.round(100.0 * (F.col("ahead") + F.col("inside")) / F.col("total"), 6).alias("percentile"))


_CORNERS = "CASE WHEN p <= 80 THEN p * 0.375 WHEN p <= 90 THEN 30 + (p - 80) * 2 WHEN p <= 95 THEN 50 + (p - 90) * 4 WHEN p <= 99 THEN 70 + (p - 95) * 3.75 ELSE 85 + (p - 99) * 15 END"


@query(f"SELECT event_id, round({_CORNERS}, 6)::DOUBLE AS score FROM (SELECT event_id, (event_id % 1001 / 10.0)::DOUBLE AS p FROM events)")
def percentile_piecewise(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(labels.scaled_percentile((F.col("event_id") % 1001) / 10.0), 6).alias("score"))


@query(f"SELECT event_id, {_LABEL} AS label FROM (SELECT event_id, CASE WHEN event_id % 102 < 101 THEN (event_id % 102)::DOUBLE END AS x FROM events)")
def score_label(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", labels.label(F.when(F.col("event_id") % 102 < 101, (F.col("event_id") % 102).cast("double"))).alias("label"))


@query("""
WITH s AS (SELECT lang, CASE WHEN n_chars % 100 >= 70 THEN 1 ELSE 0 END AS said, toxic FROM documents JOIN labels USING (doc_id)),
     c AS (SELECT lang, sum(said * toxic)::BIGINT AS tp, sum(said * (1 - toxic))::BIGINT AS fp, sum((1 - said) * (1 - toxic))::BIGINT AS tn, sum((1 - said) * toxic)::BIGINT AS fn FROM s GROUP BY lang),
     p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
SELECT lang, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM p""")
def confusion_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", labels.label((F.col("n_chars") % 100).cast("double")).alias("status"), F.when(F.col("toxic") == 1, "anomaly:toxic").otherwise("NORMAL").alias("truth"))
    out = composite.confusion(rows, F.col("status"), F.col("truth"), ["lang"])
    return out.select("lang", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""
SELECT event_id, cohort, field, delta, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id, cohort ORDER BY abs(delta) DESC, field) AS rank FROM (
  SELECT l_orderkey AS event_id, l_returnflag AS cohort, 'part' || l_partkey AS field, l_quantity::DOUBLE - 25 AS delta FROM lineitem)) WHERE rank <= 2""")
def topk_contributions(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("cohort"), F.concat(F.lit("part"), "l_partkey").alias("field"), (F.col("l_quantity").cast("double") - 25).alias("delta"))
    return composite.top_contributions(parts, ["event_id"], 2).withColumn("rank", F.col("rank").cast("long"))


@query(f"""
WITH s AS (SELECT doc_id, n_chars % 100 AS x, toxic FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN toxic = 1 THEN 'FN' ELSE 'FP' END AS kind, x::DOUBLE AS score, {_LABEL} AS status FROM s WHERE (x >= 70) <> (toxic = 1)""")
def misjudged_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("score", (F.col("n_chars") % 100).cast("double"))
    rows = rows.withColumns({"status": labels.label(F.col("score")), "truth": F.when(F.col("toxic") == 1, "anomaly:toxic").otherwise("NORMAL")})
    return composite.misjudged(rows, F.col("status"), F.col("truth")).select("doc_id", "kind", "score", "status")


@query("SELECT event_type, count(*) FILTER (event_id % 5 > 0) AS accepted, count(*) FILTER (event_id % 5 = 0) AS unaccepted FROM events GROUP BY event_type")
def accepted_counts(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, '{"n": "x"}').otherwise('{"n": 1}')
    out = extract.extracted(events(spark, sf_dir).select("event_type", F.parse_json(text).alias("payload")), {"n": Field("numeric")})
    return composite.acceptance(out, ["event_type"])


@query(f"SELECT event_id, score, {_LABEL.replace('x ', 'score ')} AS status FROM (SELECT event_id, (event_id % 101)::DOUBLE AS score FROM events) WHERE score >= 70")
def anomalous_only(spark, sf_dir):
    score = (F.col("event_id") % 101).cast("double")
    return state.anomalous(events(spark, sf_dir).select("event_id", score.alias("score"), labels.label(score).alias("status")))


@query("SELECT c_custkey, round(100.0 * (SELECT count(*) FROM nation WHERE n_nationkey < c_nationkey) / (SELECT count(*) FROM nation), 6)::DOUBLE AS percentile FROM customer")
def percentile_of_baseline(spark, sf_dir):
    """The share of a model's sorted baseline that lies below each value; a baseline is a part of the model, and as small."""
    baseline = table(spark, sf_dir, "nation").agg(F.sort_array(F.collect_list("n_nationkey")).alias("baseline"))
    return table(spark, sf_dir, "customer").join(F.broadcast(baseline)).select("c_custkey", F.round(labels.share_below(F.col("baseline"), F.col("c_nationkey")), 6).alias("percentile"))


# Scans, filters, sorts, state


@query("SELECT count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
def range_scan_count(spark, sf_dir):
    import datetime as d

    return files.between(events(spark, sf_dir), "ts", d.datetime(2024, 1, 8), d.datetime(2024, 1, 15)).agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("SELECT count(*) AS n FROM events WHERE ts >= date_trunc('day', TIMESTAMP '2024-02-01 10:00:00' - INTERVAL 1 WEEK) AND ts < TIMESTAMP '2024-02-01 10:00:00'")
def date_math_window(spark, sf_dir):
    now = F.lit("2024-02-01 10:00:00").cast("timestamp")
    return files.between(events(spark, sf_dir), "ts", files.date_math("now-1w/d", now), files.date_math("now", now)).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'error' AND NOT (value < 50)")
def predicate_filter(spark, sf_dir):
    return events(spark, sf_dir).filter(files.predicate(".event_type == 'error' and not (.value < 50)")).select("event_id", "event_type", "value")


@query(f"WITH {_SPLIT} SELECT event_id, is_score FROM e")
def train_detect_split(spark, sf_dir):
    return windows.head_tail(events(spark, sf_dir), ORDER, 0.2).select("event_id", "is_score")


@query("SELECT event_id, ts FROM events WHERE event_type <> 'view' ORDER BY ts, event_id LIMIT 100")
def chronological_limit(spark, sf_dir):
    return events(spark, sf_dir).filter("event_type <> 'view'").orderBy(*ORDER).limit(100).select("event_id", "ts")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS version FROM events GROUP BY user_id")
def state_latest(spark, sf_dir):
    versions = events(spark, sf_dir).select("user_id", "event_type", "value", F.col("event_id").alias("version"))
    return composite.latest_state(versions, ["user_id"], "version")


@query("SELECT user_id::VARCHAR AS model_key, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std, min(value) AS low, max(value) AS high FROM events WHERE user_id % 7 > 0 GROUP BY user_id")
def state_incremental(spark, sf_dir):
    """What a state table holds after three parts of the events were learned one after the other, and some keys deleted."""
    kept = state.StateTable(spark, scratch(spark, "state"))
    rows = events(spark, sf_dir)
    for part in ("ts < '2024-01-10'", "ts >= '2024-01-10' and ts < '2024-01-20'", "ts >= '2024-01-20'"):
        kept.learn_moments("scaler", rows.filter(part), "user_id", "value")
    gone = kept.keys().filter(F.col("model_key").cast("long") % 7 == 0)
    kept.delete(gone, kept.latest_version() + 1)
    return kept.load("scaler").select("model_key", "n", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "low", "high")


@query("SELECT 'scaler' AS model_type, event_type AS model_key, count(value)::BIGINT AS sample_count FROM events GROUP BY event_type")
def state_statistics(spark, sf_dir):
    kept = state.StateTable(spark, scratch(spark, "state"))
    for part in ("ts < '2024-01-15'", "ts >= '2024-01-15'"):
        kept.learn_moments("scaler", events(spark, sf_dir).filter(part), "event_type", "value")
    return kept.statistics().select("model_type", "model_key", F.col("sample_count").cast("long").alias("sample_count"))


@query("SELECT event_type, row_number() OVER (ORDER BY min(event_id))::INT AS at FROM events GROUP BY event_type")
def first_seen_values(spark, sf_dir):
    return composite.first_seen(events(spark, sf_dir), "event_type", ["event_id"])


@query("SELECT event_id, 'user' AS cohort, 'user::' || coalesce(CASE WHEN user_id % 10 > 0 THEN user_id::VARCHAR END, '__missing__') || '::' || event_type AS cohort_key, 0.5::DOUBLE AS weight FROM events UNION ALL SELECT event_id, 'all', 'all', 2.0 FROM events")
def cohort_keys(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("u", F.when(F.col("user_id") % 10 > 0, F.col("user_id")))
    return composite.by_cohort(df, [("user", ["u", "event_type"], 0.5), ("all", [], 2.0)]).select("event_id", "cohort", "cohort_key", "weight")


@query("SELECT user_id, row_number() OVER (ORDER BY min({'t': ts, 'e': event_id}))::INT AS at FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def first_seen_users(spark, sf_dir):
    """Many distinct values: they are ranked by days, none of which needs the others' rows."""
    return composite.first_seen(events(spark, sf_dir), "user_id", ORDER, F.to_date("ts"))


@query("SELECT event_id, CAST(NULL AS DOUBLE) AS score, 'INSUFFICIENT_DATA' AS label FROM events")
def no_op_model(spark, sf_dir):
    score = F.lit(None).cast("double")
    return events(spark, sf_dir).select("event_id", score.alias("score"), labels.label(score).alias("label"))


# Beyond SQL


@query()
def text_templates(spark, sf_dir):
    """Templates of each language's lines, in the order of the documents and of the lines in them; a NULL text is a row of NULLs."""
    lines = table(spark, sf_dir, "documents").select("lang", "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    return drain.templates(lines, ["lang"], ["doc_id", "line_no"], "line", "doc_id", keep=["line_no"], in_blocks=True)


@query()
def text_templates_by_lead(spark, sf_dir):
    """Templates of all lines at once, dealt by length and first token, each of which keeps at most 200; numbered by blocks of documents."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    return drain.templates_by_lead(lines, [], ["doc_id", "line_no"], "line", "doc_id", keep=["line_no"], block=F.expr("doc_id div 1000"), bound_leads=True)


#: Numbers of a vector of the embeddings table, and those that it is projected on.
WIDE, NARROW = 64, 8
_DOTS = ", ".join(f"round(list_dot_product(embedding::DOUBLE[], {[float(x) for x in projection.matrix(WIDE, NARROW)[:, k]]}::DOUBLE[]), 6) + 0.0 AS p{k}" for k in range(NARROW))


@query(f"SELECT vec_id, {_DOTS} FROM embeddings")
def vector_random_projection(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    out = projection.projected(F.col("embedding"), projection.matrix(WIDE, NARROW))
    return rows.select("vec_id", *[r6(F.get(out, F.lit(k))).alias(f"p{k}") for k in range(NARROW)])


@query()
def vector_pca(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    m = projection.axes(rows, "embedding", ["vec_id"], 200, 4)
    return rows.select("vec_id", F.transform(projection.projected(F.col("embedding"), m), lambda x: F.round(x, 6)).alias("projected"))


@query()
def autoencoder_score(spark, sf_dir):
    rows = windows.head_tail(events(spark, sf_dir).withColumn("hour", F.hour("ts") / 23.0), ORDER, 0.2)
    rows = rows.withColumns({"learns": ~F.col("is_score"), "u": encoders.hash_index("user_id", F.col("user_id").cast("string")), "z": encoders.clipped((F.col("value") - 50) / 30, -5.0, 5.0)})
    return autoencoder.scored(rows, ["event_type"], ORDER, ["u"], ["z", "hour"], "learns", "event_id", slots={"u": 2000})


@query()
def signin_generator(spark, sf_dir):
    """A sign-in event for each order."""
    return files.signins(spark, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))
