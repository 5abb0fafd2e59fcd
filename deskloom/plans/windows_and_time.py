"""Queries of windows, dates and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deskloom.functions import times
from deskloom.functions.text import by_locale, sorted_latin
from deskloom.operators import evidence, ranking
from deskloom.plans.registry import query, table

START, END = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


def _events(spark, d):
    return table(spark, d, "events")


def _window(spark, d):
    return ranking.in_window(_events(spark, d), "ts", F.lit(START).cast("timestamp"), F.lit(END).cast("timestamp"))


@query("""WITH e AS (SELECT user_id, min(ts) AS first_ts, count(DISTINCT event_type) AS publishers, count(DISTINCT event_id) AS item_sources,
  arg_min(event_type, ts) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY user_id),
t AS (SELECT user_id, item_sources, publishers, CASE WHEN item_sources >= 2 AND publishers >= 2 THEN 'corroborated' WHEN item_sources = 1 AND publishers = 1 THEN 'authoritative-single' ELSE 'insufficient' END AS tier,
  epoch_us(TIMESTAMP '2024-01-20') - epoch_us(first_ts) AS age FROM e),
f AS (SELECT *, CAST(CASE WHEN age <= 6 * 3600000000 THEN 15 WHEN age <= 24 * 3600000000 THEN 13 WHEN age <= 48 * 3600000000 THEN 10 WHEN age <= 72 * 3600000000 THEN 8 WHEN age <= 168 * 3600000000 THEN 5 ELSE 2 END AS INTEGER) AS freshness FROM t),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY tier ORDER BY freshness DESC, item_sources DESC, user_id) AS INTEGER) AS rank FROM f)
SELECT user_id, item_sources, publishers, tier, freshness, rank FROM r WHERE rank <= 3""")
def flagship_ranked_groups(spark, d):
    """The window, evidence, freshness and top groups of each tier, as one plan: a scan, an aggregate, a window."""
    groups = _window(spark, d).groupBy("user_id").agg(
        F.min("ts").alias("first_ts"), F.count_distinct("event_type").alias("publishers"), F.count_distinct("event_id").alias("item_sources")
    )
    groups = groups.withColumn("tier", evidence.tier(F.col("item_sources"), F.col("publishers")))
    groups = groups.withColumn("freshness", times.freshness(F.col("first_ts"), F.lit(END).cast("timestamp")))
    top = ranking.top_k(groups, "tier", [F.desc("freshness"), F.desc("item_sources"), F.asc("user_id")], 3)
    return top.select("user_id", "item_sources", "publishers", "tier", "freshness", "rank")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def p01_half_open_window(spark, d):
    return _window(spark, d).select("event_id", "user_id", "event_type")


@query("""SELECT o_orderkey, CAST(epoch_us(e - CASE WHEN hours = 24 THEN INTERVAL 0 HOUR ELSE INTERVAL 72 HOUR END) // 1000000 AS BIGINT) AS start_s, CAST(epoch_us(e) // 1000000 AS BIGINT) AS end_s
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE)::TIMESTAMP + INTERVAL 5 HOUR AS e, 72 AS hours FROM orders)""")
def p02_window_construction(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.to_date("o_orderdate").cast("timestamp") + F.expr("INTERVAL 5 HOURS")).alias("e"))
    return rows.select("o_orderkey", F.unix_seconds(times.window_start(F.col("e"), 72)).alias("start_s"), F.unix_seconds("e").alias("end_s"))


@query()
def p02_local_day_window(spark, d):
    """Windows that end at 05:00 New York time on each order date, from 05:00 the day before."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    end = times.local_instant(F.col("day"), "05:00")
    rows = days.select("day", F.unix_seconds(times.window_start(end)).alias("start_s"), F.unix_seconds(end).alias("end_s"))
    return rows.withColumn("hours", (F.col("end_s") - F.col("start_s")) / 3600)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text, CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) AS micros FROM events")
def d02_strict_instant(spark, d):
    rows = _events(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("text"))
    return rows.select("event_id", "text", F.unix_micros(times.strict_instant(F.col("text"))).alias("micros"))


@query("SELECT o_orderkey, CAST(TRY_CAST(s AS DATE) AS VARCHAR) AS day FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-') || lpad(CAST(o_orderkey % 32 AS VARCHAR), 2, '0') AS s FROM orders)")
def d03_real_date(spark, d):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad((F.col("o_orderkey") % 32).cast("string"), 2, "0"))
    return table(spark, d, "orders").select("o_orderkey", times.real_date(text).cast("string").alias("day"))


@query("SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS local_clock FROM events")
def d04_local_clock(spark, d):
    """All events lie in January, when New York is five hours behind."""
    return _events(spark, d).select("event_id", times.local_clock(F.col("ts")).alias("local_clock"))


@query("""SELECT event_id, CASE WHEN c = '05:05' THEN 'personal' WHEN c = '06:00' AND dayofweek(l) BETWEEN 1 AND 5 THEN 'delivery' END AS route FROM (SELECT event_id, l, strftime(l, '%H:%M') AS c FROM (SELECT event_id, ts - INTERVAL 5 HOUR AS l FROM events))""")
def d05_schedule_route(spark, d):
    return _events(spark, d).select("event_id", times.route(F.col("ts")).alias("route"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) >= m - 30 AS retained FROM orders, (SELECT max(CAST(o_orderdate AS DATE)) AS m FROM orders)")
def d06_retention_cutoff(spark, d):
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    latest = orders.agg(F.max("day").alias("m"))
    return orders.crossJoin(F.broadcast(latest)).select("o_orderkey", times.retained(F.col("day"), F.col("m")).alias("retained"))  # one row


@query("""SELECT event_id, CAST(CASE WHEN h <= 6 THEN 15 WHEN h <= 24 THEN 13 WHEN h <= 48 THEN 10 WHEN h <= 72 THEN 8 WHEN h <= 168 THEN 5 ELSE 2 END AS INTEGER) AS points
FROM (SELECT event_id, greatest(0, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 3600000000.0) AS h FROM events)""")
def d07_freshness(spark, d):
    return _events(spark, d).select("event_id", times.freshness(F.col("ts"), F.lit(END).cast("timestamp")).alias("points"))


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY value DESC, ts DESC, event_id) AS BIGINT) AS rank FROM events QUALIFY rank <= 100")
def w01_candidate_ranking(spark, d):
    top = _events(spark, d).orderBy(F.desc("value"), F.desc("ts"), "event_id").limit(100)
    order = Window.orderBy(F.desc("value"), F.desc("ts"), "event_id")  # the hundred rows that are left
    return top.select("event_id", F.row_number().over(order).cast("long").alias("rank"))


@query("SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events QUALIFY rank <= 3")
def w02_top_k_per_desk(spark, d):
    return ranking.top_k(_events(spark, d), "event_type", [F.desc("value"), F.asc("event_id")], 3).select("event_type", "event_id", "rank")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS turn FROM events)
SELECT event_id, event_type, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (ORDER BY turn, ts DESC, event_id) AS n FROM t) WHERE n <= 32""")
def w03_source_fair_sample(spark, d):
    return ranking.fair_sample(_events(spark, d), "event_type", [F.desc("ts"), F.asc("event_id")], 32).select("event_id", "event_type", "turn")


_SUPPLY = """s AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_suppkey, n_name AS publisher, r_name AS desk FROM lineitem
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def supply(spark, d):
    """Line items with their supplier's nation as publisher and region as desk; the three dimensions are joined as they are sized."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("publisher"), F.col("r_name").alias("desk"))
    return table(spark, d, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).withColumnRenamed("l_extendedprice", "price")


_ORDER = [F.desc, F.asc, F.asc]


def _by_price():
    return [F.desc("price"), F.asc("l_orderkey"), F.asc("l_linenumber")]


@query(f"""WITH {_SUPPLY}, a AS (SELECT *, row_number() OVER (PARTITION BY desk, publisher ORDER BY price DESC, l_orderkey, l_linenumber) AS p FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY desk ORDER BY price DESC, l_orderkey, l_linenumber) AS turn FROM a WHERE p <= 2),
c AS (SELECT *, row_number() OVER (ORDER BY turn, desk, price DESC, l_orderkey, l_linenumber) AS n FROM b WHERE turn <= 24)
SELECT desk, publisher, l_orderkey, l_linenumber FROM c WHERE n <= 24""")
def w04_desk_fair_allocation(spark, d):
    return ranking.fair_allocation(supply(spark, d), "desk", "publisher", _by_price(), 2, 24).select("desk", "publisher", "l_orderkey", "l_linenumber")


@query(f"""WITH {_SUPPLY}, u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY desk, price DESC, l_orderkey, l_linenumber) = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY desk, publisher ORDER BY price DESC, l_orderkey, l_linenumber) AS p FROM u),
b AS (SELECT *, row_number() OVER (PARTITION BY desk ORDER BY price DESC, l_orderkey, l_linenumber) AS turn FROM a WHERE p <= 2),
c AS (SELECT *, row_number() OVER (ORDER BY turn, desk, price DESC, l_orderkey, l_linenumber) AS n FROM b WHERE turn <= 6)
SELECT desk, publisher, l_orderkey, l_linenumber FROM c WHERE n <= 24""")
def w05_shortlist(spark, d):
    return ranking.shortlist(supply(spark, d), "desk", "publisher", "l_orderkey", _by_price(), 6, 2, 24).select("desk", "publisher", "l_orderkey", "l_linenumber")


@query("""SELECT user_id, event_id, CASE WHEN p IS NULL THEN NULL ELSE p = a END AS contiguous FROM (SELECT user_id, event_id, date_trunc('day', ts) AS a,
lag(date_trunc('day', ts) + INTERVAL 1 DAY) OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts), event_id) AS p FROM events)""")
def w06_contiguity(spark, d):
    order = Window.partitionBy("user_id").orderBy("a", "event_id")
    days = _events(spark, d).select("user_id", "event_id", F.date_trunc("day", "ts").alias("a"))
    return days.withColumn("p", F.lag(F.col("a") + F.expr("INTERVAL 1 DAY")).over(order)).select("user_id", "event_id", (F.col("p") == F.col("a")).alias("contiguous"))


@query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_type COLLATE en, ts DESC, event_id) AS ordered FROM events GROUP BY user_id")
def w07_order_within_group(spark, d):
    item = F.struct(by_locale(F.col("event_type")).alias("event_type"), (-F.unix_micros("ts")).alias("t"), "event_id")
    return _events(spark, d).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["event_id"].cast("string")), ",").alias("ordered"))


@query("""WITH f AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)
SELECT user_id, event_type, event_id FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2""")
def w08_first_per_publisher(spark, d):
    first = ranking.top_k(_events(spark, d), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")], 1)
    return ranking.top_k(first, "user_id", [F.asc("ts"), F.asc("event_id")], 2).select("user_id", "event_type", "event_id")


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, value DESC, event_id) = 1""")
def w09_follow_up_choice(spark, d):
    priority = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return ranking.top_k(_events(spark, d), "user_id", [priority, F.desc("value"), F.asc("event_id")], 1).select("user_id", "event_id")


_LANGS = ["de", "en", "es", "fr"]


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, lang, strlen(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 100 DESC, doc_id) AS rank FROM documents WHERE lang IN {tuple(_LANGS)}),
o AS (SELECT *, row_number() OVER (ORDER BY rank, lang) AS i FROM d WHERE rank <= 2),
g(i, used, took) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT), FALSE UNION ALL SELECT o.i, CASE WHEN used + size + 1 <= 4000 THEN used + size + 1 ELSE used END, used + size + 1 <= 4000 FROM g JOIN o ON o.i = g.i + 1)
SELECT doc_id, lang, rank, used AS running FROM g JOIN o USING (i) WHERE took""")
def w10_slate_under_a_byte_cap(spark, d):
    """Two documents a language, in two rounds over the languages, skipping what exceeds the bytes."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.octet_length(F.coalesce("text", F.lit(""))).alias("octets"), (F.col("n_chars") % 100).alias("score"))
    chosen = ranking.slate(docs, "lang", [F.desc("score"), F.asc("doc_id")], "doc_id", "octets", _LANGS, budget=4_000)
    return chosen.select("doc_id", "lang", F.col("rank").cast("long").alias("rank"), "running")


@query("""WITH RECURSIVE o AS (SELECT c_nationkey, c_custkey, c_acctbal AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM (SELECT c_nationkey, c_custkey, abs(c_acctbal) AS c_acctbal FROM customer)),
g(c_nationkey, n, used, took, c_custkey) AS (SELECT c_nationkey, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), FALSE, CAST(0 AS BIGINT) FROM (SELECT DISTINCT c_nationkey FROM o)
UNION ALL SELECT g.c_nationkey, o.n, CASE WHEN g.used + o.s <= 12000 THEN g.used + o.s ELSE g.used END, g.used + o.s <= 12000, o.c_custkey FROM g JOIN o ON o.c_nationkey = g.c_nationkey AND o.n = g.n + 1)
SELECT c_nationkey, c_custkey, round(used, 2) AS running FROM g WHERE took""")
def w11_skip_fit_selection(spark, d):
    rows = table(spark, d, "customer").withColumn("size", F.abs("c_acctbal"))
    kept = ranking.skip_fit(rows, "c_nationkey", ["c_custkey"], "size", 12000, "c_custkey")
    return kept.select("c_nationkey", "c_custkey", F.round("running", 2).alias("running"))


@query("SELECT event_id, event_type FROM events ORDER BY event_type COLLATE en, ts DESC, event_id")
def o01_stable_sort(spark, d):
    return _events(spark, d).orderBy(by_locale(F.col("event_type")), F.desc("ts"), "event_id").select("event_id", "event_type")


@query(r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) SELECT doc_id, string_agg(w, ' ' ORDER BY w COLLATE en, w) AS words FROM w GROUP BY doc_id""")
def o01_locale_words(spark, d):
    """The distinct words of each text in the order of a dictionary, accents and capitals included; a row holds one text's words."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0)))
    docs = table(spark, d, "documents").where(F.col("text").rlike("[A-Za-zÀ-ÿ]"))  # a filter on the words would make them twice
    return docs.select("doc_id", F.array_join(sorted_latin(words), " ").alias("words"))


@query("SELECT user_id, array_to_string(list_slice(list(DISTINCT event_type ORDER BY event_type), 1, 3), ',') AS first_three FROM events GROUP BY user_id")
def o02_slice_caps(spark, d):
    return _events(spark, d).groupBy("user_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("event_type")), 1, 3), ",").alias("first_three"))


@query("SELECT DISTINCT url FROM (SELECT regexp_replace(url, '[?#].*$', '') AS url FROM pages UNION ALL SELECT url FROM pages)")
def o05_concat_dedupe(spark, d):
    urls = table(spark, d, "pages").select("url")
    return urls.select(F.regexp_replace("url", r"[?#].*$", "").alias("url")).union(urls).distinct()


@query("""WITH a AS (SELECT user_id, CAST(date_part('day', ts) AS INTEGER) % 2 + 1 AS attempt, count(*) AS selected FROM events GROUP BY ALL),
c AS (SELECT user_id, count(*) AS n, max(selected) AS selected, arg_min(selected, attempt) AS f FROM a GROUP BY user_id)
SELECT c.user_id, min(attempt) AS chosen, any_value(c.selected) AS selected, CASE WHEN any_value(n) = 1 THEN 'not-needed' WHEN any_value(c.selected) > any_value(f) THEN 'improved' ELSE 'no-improvement' END AS retry
FROM c JOIN a ON a.user_id = c.user_id AND a.selected = c.selected GROUP BY c.user_id""")
def o06_retry_choose_best(spark, d):
    attempts = _events(spark, d).groupBy("user_id", (F.dayofmonth("ts") % 2 + 1).alias("attempt")).agg(F.count("*").alias("selected"))
    return ranking.choose_best(attempts, "user_id", "attempt", "selected")


@query("""WITH e AS (SELECT event_id, ts, length(props) * 50 + event_id % 1300 AS bytes, user_id % 7 = 0 AS failed FROM events),
s AS (SELECT *, coalesce(sum(CASE WHEN failed OR bytes > 1500 THEN 1500 ELSE bytes END) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM e)
SELECT event_id, CASE WHEN used > 800000 - 1024 THEN 'TOTAL_BODY_LIMIT' WHEN failed THEN 'FAILED' WHEN bytes > least(1500, 800000 - used) THEN 'BODY_TOO_LARGE' ELSE 'ok' END AS outcome,
CAST(CASE WHEN used > 800000 - 1024 THEN 0 ELSE least(CASE WHEN failed OR bytes > 1500 THEN 1500 ELSE bytes END, 800000 - used) END AS BIGINT) AS charge FROM s""")
def s07_byte_budget(spark, d):
    """Events as sources that share 800,000 bytes in the order of their times; a seventh of the users' fail."""
    rows = _events(spark, d).select("event_id", "ts", (F.length("props") * 50 + F.col("event_id") % 1_300).alias("bytes"), (F.col("user_id") % 7 == 0).alias("failed"))
    return ranking.reserved_bytes(rows, ["ts", "event_id"], "bytes", "failed", 800_000, 1_500).select("event_id", "outcome", "charge")


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY ALL")
def x07_out_of_window(spark, d):
    one = ranking.in_window(_events(spark, d), "ts", F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-11").cast("timestamp"))
    return one.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type").agg(F.count("*").alias("n"))
