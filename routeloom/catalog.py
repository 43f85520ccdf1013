"""Every registered query of the library and the SQL that checks it.

Each query applies one kernel to whole driver tables; its name says which.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import scalars as s
from .operators import budget, closure, dedupe, joins, merge, state, votes
from .plans import incremental
from .plans.code_lane import framework
from .sources.repo_tree import sniff

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    """Distinct, non-blank documents per source with their token cost."""
    d = table(spark, sf_dir, "documents").where(~s.blank(F.col("text")))
    rows = d.groupBy("source", F.sha2("text", 256).alias("h")).agg(F.min(F.struct("doc_id", "n_chars")).alias("m"))
    return rows.select("source", F.col("m.doc_id").alias("doc_id"), F.ceil(F.col("m.n_chars") / 4).cast("long").alias("cost"))


_DOCS = r"docs AS (SELECT source, min(doc_id) AS doc_id, CAST(ceil(arg_min(n_chars, doc_id) / 4) AS BIGINT) AS cost FROM documents WHERE regexp_matches(text, '[^ \t\n\r\f\x0B]') GROUP BY source, sha256(text))"


@query(f"""WITH RECURSIVE {_DOCS},
r AS (SELECT source, doc_id, cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM docs),
p AS (SELECT source, i, cost, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n, cost AS used FROM r WHERE i = 1
 UNION ALL SELECT r.source, r.i, r.cost, p.batch + CASE WHEN p.n >= 10 OR p.used + r.cost > 5936 THEN 1 ELSE 0 END, CASE WHEN p.n >= 10 OR p.used + r.cost > 5936 THEN 1 ELSE p.n + 1 END, CASE WHEN p.n >= 10 OR p.used + r.cost > 5936 THEN r.cost ELSE p.used + r.cost END FROM p JOIN r ON r.source = p.source AND r.i = p.i + 1)
SELECT source, batch, count(*) AS n_docs, CAST(sum(cost) AS BIGINT) AS tokens FROM p GROUP BY ALL""")
def pack_batches(spark, sf_dir):
    return budget.pack_batches(_documents(spark, sf_dir), "source", "doc_id", "cost").drop("first")


@query(f"""WITH {_DOCS}, u AS (SELECT *, sum(cost + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM docs)
SELECT source, count(*) FILTER (used <= 5936) AS kept, CAST(coalesce(max(used) FILTER (used <= 5936), 0) AS BIGINT) AS used_tokens, count(*) FILTER (used > 5936) AS dropped FROM u GROUP BY source""")
def fit_context(spark, sf_dir):
    return budget.fit_context(_documents(spark, sf_dir), "source", "doc_id", "cost")


@query("SELECT sha256(text) AS text_hash, min(doc_id) AS keeper, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def exact_dedupe(spark, sf_dir):
    return dedupe.exact_dedupe(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT doc_id, left(sha256(source || chr(0) || text), 16) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", s.content_hash(F.col("source"), F.col("text")).alias("content_hash"))


@query(r"""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
d AS (SELECT doc_id, x, min(i) AS i FROM b WHERE regexp_matches(x, '[^ \t\n\r\f\x0B]') GROUP BY doc_id, x),
j AS (SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY i) AS t FROM d GROUP BY doc_id)
SELECT doc_id, sha256(source || coalesce(chr(10) || chr(10) || t, '')) AS context_hash FROM documents LEFT JOIN j USING (doc_id)""")
def context_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", s.context_hash(F.col("source"), F.split("text", "\n")).alias("context_hash"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(u, '^(https?)://(?:[^/]*@)?([^/?#]+)(/[^?#]*)?') AND p <> '' THEN regexp_extract(u, '^(https?)://', 1) || '://' || regexp_extract(u, '^(https?)://(?:[^/]*@)?([^/?#]+)', 2) || p ELSE '' END AS public_url
FROM (SELECT page_id, trim(url) AS u, regexp_replace(regexp_replace(regexp_extract(trim(url), '^(https?)://(?:[^/]*@)?([^/?#]+)(/[^?#]*)?', 3), '/+$', ''), '\.git$', '') AS p FROM pages)""")
def sanitize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", s.sanitize_url(F.col("url")).alias("public_url"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(CASE WHEN p LIKE '/%' THEN p ELSE '/' || p END, '/{2,}', '/', 'g'), '[0-9]+', '{id}', 'g') AS route, upper('get') AS verb, regexp_replace(regexp_replace(regexp_replace(CASE WHEN p LIKE '/%' THEN p ELSE '/' || p END, '/{2,}', '/', 'g'), '[0-9]+', '{id}', 'g'), '\{[^}]*\}', '{}', 'g') AS shape
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM pages)""")
def url_route_shape(spark, sf_dir):
    path = s.normalize_java(F.concat(F.lit("/"), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)))
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(path, "[0-9]+", "{id}").alias("route"))
    k = s.route_shape(F.lit("get"), F.col("route"))
    return rows.select("page_id", "route", k["method"].alias("verb"), k["shape"].alias("shape"))


@query(r"""WITH r AS (SELECT event_id, event_type, '/users/<int:' || event_type || '>//' || user_id AS py, '/users/:' || event_type || '/' || user_id AS ru, ' users//' || user_id AS ja FROM events)
SELECT event_id, '/users/{' || event_type || '}/' || regexp_extract(py, '([0-9]+)$', 1) AS python_route, regexp_replace(ru, ':([A-Za-z_][A-Za-z0-9_]*)', '{\1}', 'g') AS colon_route, '/' || regexp_replace(trim(ja), '/{2,}', '/', 'g') AS java_route FROM r""")
def normalize_routes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    py = F.concat(F.lit("/users/<int:"), "event_type", F.lit(">//"), "user_id")
    ru = F.concat(F.lit("/users/:"), "event_type", F.lit("/"), "user_id")
    ja = F.concat(F.lit(" users//"), "user_id")
    return e.select("event_id", s.normalize_python(py).alias("python_route"), s.normalize_colon(ru).alias("colon_route"), s.normalize_java(ja).alias("java_route"))


@query(r"""SELECT event_id, '/u/{' || event_type || '}/{n}' AS route FROM events""")
def normalize_express(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", s.normalize_express(F.concat(F.lit("/u/:"), "event_type", F.lit(r"(\d+(?:-\d{2})?)?/:n"))).alias("route"))


@query(r"""SELECT n_nationkey, '/' || lower(r_name) || '/' || lower(n_name) AS joined, '/' || lower(r_name) || '/' || lower(n_name) AS segments FROM nation JOIN region ON n_regionkey = r_regionkey""")
def join_routes(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # regions: five rows
    a, b = F.lower("r_name"), F.lower("n_name")
    return n.select("n_nationkey", s.join_route(F.concat(a, F.lit("/")), F.concat(F.lit("/"), b)).alias("joined"), s.join_segments(F.concat(F.lit("/"), a, F.lit("/")), b).alias("segments"))


@query("""SELECT k AS endpoint, split_part(k, ' ', 1) AS verb, split_part(k, ' ', 2) AS route, count(*) AS n FROM (SELECT upper(event_type) || ' /users/' || user_id AS k FROM events) GROUP BY ALL""")
def endpoint_key_split(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(s.endpoint_key(F.col("event_type"), F.concat(F.lit("/users/"), "user_id")).alias("endpoint"))
    k = s.split_key(F.col("endpoint"))
    return e.groupBy("endpoint").agg(F.count("*").alias("n")).select("endpoint", k["method"].alias("verb"), k["route"].alias("route"), "n")


@query("""SELECT c_custkey, CASE WHEN length(trim(c_name)) = 0 THEN 'not set' WHEN length(trim(c_name)) <= 10 THEN repeat('*', length(trim(c_name))) ELSE left(trim(c_name), 6) || '...' || right(trim(c_name), 4) END AS masked, c_mktsegment AS chosen FROM customer""")
def mask_secret(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", s.mask_secret(F.col("c_name")).alias("masked"), s.first_set(F.lit(" null "), F.lit(""), F.col("c_mktsegment")).alias("chosen"))


@query(r"""WITH w AS (SELECT p_partkey, p_name, list_filter(regexp_split_to_array(p_name, '[^A-Za-z0-9]+'), lambda x: x <> '') AS w FROM part)
SELECT p_partkey, lower(left(c, 1)) || substr(c, 2) AS camel, CASE WHEN p_name LIKE '%ies' THEN left(p_name, length(p_name) - 3) || 'y' ELSE regexp_replace(p_name, 's$', '') END AS singular FROM (SELECT *, array_to_string(list_transform(w, lambda x: upper(left(x, 1)) || substr(x, 2)), '') AS c FROM w)""")
def name_forms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", s.camelize(F.col("p_name")).alias("camel"), s.singular(F.col("p_name")).alias("singular"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)licen[sc]ed?') AS license, regexp_matches(text, '(?i)(password|token)\s*[:=]') AS secret FROM documents""")
def sniff_filter(spark, sf_dir):
    content = F.encode(F.col("text"), "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", sniff(content, "(?i)licen[sc]ed?").alias("license"), sniff(content, r"(?i)(password|token)\s*[:=]").alias("secret"))


_PATTERNS = [("django", "(?i)(path|url)\\("), ("express", "(?i)<nav"), ("rails", "(?i)<p>"), ("spring", "(?i)<(h1|h2)")]


@query(f"""WITH p(framework, pattern, pos) AS (VALUES {", ".join(f"('{a}', '{b}', {k})" for k, (a, b) in enumerate(_PATTERNS))}),
h AS (SELECT page_id % 7 AS repo, framework, pos, count(*) AS hits FROM pages JOIN p ON regexp_matches(html, pattern) GROUP BY 1, 2, 3)
SELECT CAST(repo AS VARCHAR) AS repo, framework FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY hits DESC, pos) AS k FROM h) WHERE k = 1""")
def framework_argmax(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 7).cast("string").alias("repo"), F.col("html").alias("text"))
    return framework(pages, _PATTERNS)


@query("""SELECT user_id, event_type, min(event_id) AS won_by, arg_min(extract('day' FROM ts), event_id) AS winner, count(DISTINCT extract('day' FROM ts)) - 1 AS losers FROM events GROUP BY 1, 2""")
def conflict_winner(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts").cast("long"))
    return dedupe.conflict_winner(e, ["user_id", "event_type"], "event_id", "day").withColumn("losers", F.col("losers").cast("long"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def first_wins_merge(spark, sf_dir):
    return dedupe.first_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", ["value"])


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_wins_merge(spark, sf_dir):
    return dedupe.last_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", ["value"])


@query("""WITH d AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS p FROM orders GROUP BY 1, 2)
SELECT o_custkey, arg_min(o_orderpriority, p) AS signature, count(*) - 1 AS n_variants, string_agg(o_orderpriority, ',' ORDER BY p) AS in_order FROM d GROUP BY 1""")
def variant_merge(spark, sf_dir):
    v = dedupe.merge_variants(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")
    return v.select("o_custkey", "signature", F.size("variants").cast("long").alias("n_variants"), F.concat_ws(",", "signature", "variants").alias("in_order"))


@query("""SELECT coalesce(c_custkey, o_custkey) AS custkey, CASE WHEN c_custkey IS NULL THEN 'added' WHEN o_custkey IS NULL THEN 'removed' ELSE 'kept' END AS status FROM (SELECT c_custkey FROM customer) FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey""")
def key_diff(spark, sf_dir):
    return merge.key_diff(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


@query(r"""WITH r AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS k FROM pages)
SELECT k AS canonical, 'get' AS verb, arg_min(page_id, CAST(url <> k AS BIGINT) * 1000000000 + page_id) AS page, CAST(min(CAST(url <> k AS INTEGER)) AS INTEGER) AS legacy, count(*) AS spellings FROM r GROUP BY k""")
def canonical_union(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("get").alias("verb"), F.col("page_id").alias("page"))
    return dedupe.canonical_union(p, "url", F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", ""), "verb", "page_id", "page")


@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'), n AS (SELECT o_orderkey AS k, o_totalprice * 2 AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01'), f AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F')
SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM f) AND k NOT IN (SELECT k FROM n) UNION ALL SELECT k, v FROM n WHERE k NOT IN (SELECT k FROM f)""")
def index_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderdate < timestamp '1995-01-01'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.where("o_orderdate >= timestamp '1994-01-01'").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 2).alias("v"))
    return merge.upsert(old, new, "k", o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)")
def supersede_semi(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return joins.supersede(table(spark, sf_dir, "lineitem"), parts, ["l_partkey"])[0].select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)")
def supersede_anti(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return joins.supersede(table(spark, sf_dir, "lineitem"), parts, ["l_partkey"])[1].select("l_orderkey", "l_linenumber")


def _dirty(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("c"), "o_custkey").alias("file"))
    deps = line.select(F.col("l_orderkey").alias("key"), F.concat(F.lit("p"), "l_partkey").alias("file"))
    changed = table(spark, sf_dir, "part").where("p_size = 7").select(F.concat(F.lit("p"), "p_partkey").alias("file")).unionByName(table(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.concat(F.lit("c"), "c_custkey").alias("file")))
    return own, state.dirty_one_hop(own, deps, changed, "key", "file")


_DIRTY = "(SELECT o_orderkey AS key FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < -900) UNION SELECT l_orderkey FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size = 7))"


@query(f"SELECT key FROM {_DIRTY}")
def dirty_one_hop(spark, sf_dir):
    return _dirty(spark, sf_dir)[1]


@query(f"SELECT (SELECT count(*) FROM {_DIRTY}) AS dirty, (SELECT count(*) FROM orders) AS total, 2 * (SELECT count(*) FROM {_DIRTY}) > (SELECT count(*) FROM orders) AS full_run")
def escalation_gate(spark, sf_dir):
    own, dirty = _dirty(spark, sf_dir)
    return state.must_regenerate(dirty, own).withColumnRenamed("full", "full_run")


@query("""WITH d AS (SELECT l_orderkey AS key, l_returnflag AS h, first_value(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS stored FROM lineitem)
SELECT key, 'any' AS rule FROM d GROUP BY key HAVING bool_and(h = stored) UNION ALL SELECT key, 'single' FROM d GROUP BY key HAVING bool_and(h = stored) AND count(*) = 1""")
def hash_skip(spark, sf_dir):
    jobs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", F.col("l_returnflag").alias("h"))
    stored = dedupe.first_wins(jobs, ["key"], "l_linenumber", ["h"]).select("key", "h")
    same = state.same_hashes(jobs.select("key", "h"), stored, "key", "h")
    rules = F.when(F.col("jobs") == 1, F.array(F.lit("any"), F.lit("single"))).otherwise(F.array(F.lit("any")))
    return same.select("key", F.explode(rules).alias("rule"))


def _user_days(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("user_day", F.col("user_id") * 100 + F.dayofmonth("ts"))


@query("""WITH c AS (SELECT user_id * 100 + extract('day' FROM ts) AS user_day, event_type, count(*) AS votes FROM events GROUP BY 1, 2), t AS (SELECT user_day, sum(votes) AS total FROM c GROUP BY 1)
SELECT user_day, event_type AS winner, votes, CAST(total AS BIGINT) AS total FROM c JOIN t USING (user_day) WHERE 2 * votes > total""")
def strict_majority(spark, sf_dir):
    return votes.strict_majority(_user_days(spark, sf_dir), "user_day", "event_type")


@query("""WITH c AS (SELECT user_id * 100 + extract('day' FROM ts) AS user_day, event_type, count(*) AS votes FROM events GROUP BY 1, 2), t AS (SELECT *, max(votes) OVER (PARTITION BY user_day) AS m FROM c)
SELECT user_day, CASE WHEN count(*) = 1 THEN min(event_type) END AS winner FROM t WHERE votes = m GROUP BY user_day""")
def plurality_or_none(spark, sf_dir):
    return votes.plurality(_user_days(spark, sf_dir), "user_day", "event_type")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.005 AND l_linenumber = 1 THEN NULL ELSE l_returnflag END AS f FROM lineitem),
p AS (SELECT l_orderkey, f, count(DISTINCT l_linenumber) AS m FROM r GROUP BY 1, 2), t AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, bool_or(f IS NULL) AS bad FROM r GROUP BY 1)
SELECT l_orderkey, CASE WHEN any_value(bad) THEN NULL ELSE coalesce(string_agg(f, ',' ORDER BY f) FILTER (m = n), '') END AS common FROM p JOIN t USING (l_orderkey) GROUP BY 1""")
def set_intersection_poison(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when((F.col("l_discount") < 0.005) & (F.col("l_linenumber") == 1), None).otherwise(F.col("l_returnflag")).alias("f"))
    return votes.poisoned_intersection(rows, "l_orderkey", "l_linenumber", "f")


def _spans(spark, sf_dir):
    """Purchases as spans of the day's seconds around them, lengths by event id."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.dayofmonth("ts").alias("day"), (F.unix_seconds(F.col("ts").cast("timestamp")) % 86400).alias("sec"))
    return e, e.where("event_type = 'purchase'").select("day", F.col("event_id").alias("span_id"), (F.col("sec") - F.col("event_id") % 120).alias("a"), (F.col("sec") + F.col("event_id") % 600).alias("b"))


_SPANS = "e AS (SELECT event_id, event_type, extract('day' FROM ts) AS day, CAST(epoch(date_trunc('second', ts)) AS BIGINT) % 86400 AS sec FROM events), s AS (SELECT day, event_id AS span_id, sec - event_id % 120 AS a, sec + event_id % 600 AS b FROM e WHERE event_type = 'purchase')"


@query(f"""WITH {_SPANS}, h AS (SELECT e.event_id, s.a, s.b, row_number() OVER (PARTITION BY e.event_id ORDER BY s.a DESC, s.b) AS k FROM e JOIN s ON e.day = s.day AND s.a <= e.sec AND e.sec <= s.b)
SELECT e.event_id, h.a AS span_start, h.b AS span_end FROM e LEFT JOIN h ON e.event_id = h.event_id AND h.k = 1""")
def stab_innermost(spark, sf_dir):
    e, spans = _spans(spark, sf_dir)
    return joins.innermost(e, spans, ["day"], "sec", "a", "b", 900).select("event_id", F.col("a").alias("span_start"), F.col("b").alias("span_end"))


@query(f"""WITH {_SPANS}, c AS (SELECT day, event_id, sec AS a, sec + 30 AS b FROM e WHERE event_type = 'click')
SELECT c.event_id, s.span_id FROM c JOIN s ON c.day = s.day AND s.a <= c.a AND c.b <= s.b""")
def interval_containment(spark, sf_dir):
    e, spans = _spans(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select("day", "event_id", F.col("sec").alias("a"), (F.col("sec") + 30).alias("b"))
    return joins.contained(clicks, spans, ["day"], "a", "b", 900).select("i.event_id", "o.span_id")


@query("""SELECT event_id, user_id, nearest FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest FROM events) WHERE event_type = 'purchase'""")
def nearest_before(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return joins.nearest_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "view", "event_id", F.to_date("ts")).select("event_id", "user_id", "nearest")


@query(r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{7,}')) AS word FROM benchmark)
SELECT word, count(*) AS docs FROM t JOIN b USING (word) GROUP BY word""")
def bare_word_join(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]{7,})"), 1)).alias("word"))
    return joins.bare_words(table(spark, sf_dir, "documents"), "doc_id", "text", names, "word").groupBy("word").agg(F.count("*").alias("docs"))


@query(r"""SELECT event_id, CAST(regexp_extract(b, '"k":\s*([0-9]+)', 1) AS BIGINT) AS k FROM (SELECT event_id, regexp_extract('reply: ' || props || ' end', '\{.*\}') AS b FROM events)""")
def json_block(spark, sf_dir):
    block = s.json_block(F.concat(F.lit("reply: "), "props", F.lit(" end")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(block, "$.k").cast("long").alias("k"))


@query("""SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS extracted, (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 1) AS generated, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unchanged, (SELECT count(DISTINCT doc_id) FROM labels WHERE toxic = 1) AS failed""")
def coverage_summary(spark, sf_dir):
    keys = lambda df: df.select(F.col("doc_id").alias("key"))
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return incremental.coverage(keys(docs), keys(labels.where("quality = 1")), keys(docs.join(labels, "doc_id", "left_anti")), keys(labels.where("toxic = 1")))


@query("SELECT lang, doc_id, n_chars, rank FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3")
def top_n_per_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return joins.top_n(d, ["lang"], [F.desc("n_chars"), F.col("doc_id")], 3, "rank").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT (SELECT string_agg(page_id, ',' ORDER BY page_id) FROM (SELECT page_id FROM pages ORDER BY page_id LIMIT 20)) AS listed, greatest((SELECT count(*) FROM pages) - 20, 0) AS more")
def limit_with_remainder(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    top = p.orderBy("page_id").limit(20).agg(F.array_join(F.array_sort(F.collect_list("page_id")), ",").alias("listed"))
    return top.join(F.broadcast(p.agg(F.greatest(F.count("*") - 20, F.lit(0)).alias("more"))))  # one row by one row


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem),
c AS (SELECT CAST(p_size AS BIGINT) AS root, p_partkey AS node FROM part UNION SELECT c.root, e.dst FROM c JOIN e ON e.src = c.node) SELECT root, node FROM c""")
def reference_closure(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    roots = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("root"), F.col("p_partkey").alias("node"))
    return closure.transitive(roots, e).select("root", "node")


@query()
def reference_closure_whole(spark, sf_dir):
    """Every order as a root, all lineitem edges on real keys; a result of roots times reachable nodes is too large for recursive SQL."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return closure.reachable(e.select(F.col("src").alias("root"), F.col("src").alias("node")), e)


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS src, (c_custkey * 7) // 11 AS dst FROM customer WHERE (c_custkey * 7) // 11 <> c_custkey),
c AS (SELECT c_custkey AS key, c_custkey AS node FROM customer UNION ALL SELECT c.key, e.dst FROM c JOIN e ON e.src = c.node)
SELECT key, min(node) AS node FROM c GROUP BY key""")
def alias_chase(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    e = c.select(F.col("c_custkey").alias("src"), F.expr("(c_custkey * 7) div 11").alias("dst")).where("dst <> src")
    return closure.chase(c.select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("node")), e).select("key", "node")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS src, (c_custkey * 7) // 11 AS dst FROM customer WHERE (c_custkey * 7) // 11 <> c_custkey),
c AS (SELECT c_custkey AS key, c_custkey AS node FROM customer UNION ALL SELECT c.key, e.dst FROM c JOIN e ON e.src = c.node)
SELECT key, min(node) AS node FROM c GROUP BY key""")
def alias_chase_whole(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    e = c.select(F.col("c_custkey").alias("src"), F.expr("(c_custkey * 7) div 11").alias("dst")).where("dst <> src")
    return closure.chase(c.select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("node")), e).select("key", "node")


@query("""SELECT o_orderkey, coalesce(n, '-') AS prefix FROM orders LEFT JOIN (SELECT DISTINCT c_custkey, n_name AS n FROM customer JOIN nation ON c_nationkey % 5 = n_regionkey) ON o_custkey = c_custkey""")
def mount_fan_out(spark, sf_dir):
    mounts = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey % 5 = n_regionkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("prefix"))
    return joins.fan_out(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), mounts, "o_custkey", "prefix").select("o_orderkey", F.coalesce("prefix", F.lit("-")).alias("prefix"))


@query("""SELECT o_orderkey, coalesce(n, '-') AS prefix FROM orders LEFT JOIN (SELECT DISTINCT c_custkey, n_name AS n FROM customer JOIN nation ON c_nationkey % 5 = n_regionkey) ON o_custkey = c_custkey""")
def mount_fan_out_whole(spark, sf_dir):
    mounts = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey % 5 = n_regionkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("prefix"))
    return joins.fan_out(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), mounts, "o_custkey", "prefix").select("o_orderkey", F.coalesce("prefix", F.lit("-")).alias("prefix"))


@query("""SELECT l_orderkey, l_linenumber, o_orderkey AS hit FROM lineitem LEFT JOIN (SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = l_suppkey""")
def ranked_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("l_suppkey"), "o_orderpriority", F.col("o_orderkey").alias("hit"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return joins.ranked_lookup(rows, "l_orderkey", o, ["l_suppkey"], [F.col("o_orderpriority"), F.col("hit")], ["hit"]).drop("l_suppkey")


@query("""SELECT s_suppkey, CASE WHEN e.v IS NOT NULL THEN e.v ELSE a.v END AS v FROM (SELECT s_suppkey, s_nationkey AS k, CAST(s_suppkey % 7 AS INTEGER) AS j FROM supplier) s
LEFT JOIN (SELECT n_nationkey AS k, n_regionkey AS j, min(n_name) AS v FROM nation GROUP BY 1, 2) e ON s.k = e.k AND s.j = e.j LEFT JOIN (SELECT n_nationkey AS k, min(n_name) AS v FROM nation GROUP BY 1 HAVING count(*) = 1) a ON s.k = a.k""")
def unique_lookup(spark, sf_dir):
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 7).cast("int").alias("j"))
    nat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("j"), F.col("n_name").alias("v"))
    return joins.unique_lookup(sup, nat, ["k", "j"], "k", "v").select("s_suppkey", "v")


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey OR c_custkey = s_suppkey * 2 OR (c_nationkey = s_nationkey AND c_custkey % 50 = s_suppkey % 50)""")
def implementers_theta(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("a"), F.col("c_custkey").alias("b"), F.concat_ws("/", "c_nationkey", F.col("c_custkey") % 50).alias("d"))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("x"), (F.col("s_suppkey") * 2).alias("y"), F.concat_ws("/", "s_nationkey", F.col("s_suppkey") % 50).alias("z"))
    return joins.any_of(c, sup, [[("a", "x")], [("b", "y")], [("d", "z")]]).select("c_custkey", "s_suppkey")


@query("""WITH e AS (SELECT event_id, user_id * 100 + extract('day' FROM ts) AS p, event_type AS v FROM events)
SELECT event_id, upper(v) AS verb FROM e WHERE p NOT IN (SELECT p FROM e WHERE v = 'error') AND NOT (v = 'view' AND p IN (SELECT p FROM e WHERE v = 'signup'))""")
def remove_keys(spark, sf_dir):
    e = _user_days(spark, sf_dir).select("event_id", F.col("user_day").alias("path"), F.col("event_type").alias("verb"))
    gone = e.where("verb = 'error'").select("path", F.lit("UNKNOWN").alias("verb")).unionByName(e.where("verb = 'signup'").select("path", F.lit("VIEW").alias("verb")))
    return merge.remove_keys(e, gone, "path", "verb").select("event_id", F.upper("verb").alias("verb"))


@query("""SELECT o_orderkey AS k, 'old' AS origin FROM orders WHERE o_orderpriority NOT LIKE '1%' UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 1000""")
def replace_sourced(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority", "o_totalprice", F.lit("old").alias("origin"))
    new = o.where("o_orderpriority like '1%' and o_totalprice > 1000").withColumn("origin", F.lit("new"))
    return merge.replace_sourced(o, new, F.col("o_orderpriority").like("1%")).select("k", "origin")
