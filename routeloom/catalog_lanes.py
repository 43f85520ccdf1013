"""Registered queries of the lanes' own kernels, each on whole driver tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, table
from .functions import contract_facts as cf
from .functions import js_facts
from .functions import scalars as s
from .operators import budget, closure, context, dedupe, joins, merge, specs, state
from .plans import state_tables

# --- names, routes and keys ------------------------------------------------------------------


@query(r"""SELECT p_partkey, list_aggregate(list_transform(string_split(regexp_replace(regexp_replace(p_name || '_' || p_brand, '[_-]', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' ') AS title FROM part""")
def display_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", s.display_name(F.concat_ws("_", "p_name", "p_brand")).alias("title"))


_REGEX_ROUTES = [r"^users/(?P<pk>[0-9]+)/$", r"^users/([0-9]+)/$", r"^^list/$", r"a+b/(?P<slug>[\w-]+)", "plain/path/"]


@query(f"""WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{_REGEX_ROUTES[0]}' WHEN 1 THEN '{_REGEX_ROUTES[1]}' WHEN 2 THEN '{_REGEX_ROUTES[2]}' WHEN 3 THEN '{_REGEX_ROUTES[3]}' ELSE '{_REGEX_ROUTES[4]}' END || event_type AS pattern FROM events),
q AS (SELECT event_id, regexp_replace(regexp_replace(regexp_replace(trim(pattern), '\\(\\?P<(\\w+)>[^()]*\\)', '<\\1>', 'g'), '^\\^+', ''), '\\$+$', '') AS r FROM p)
SELECT event_id, CASE WHEN NOT regexp_matches(r, '[()\\[\\]\\\\*+?|{{}}^$]') THEN r END AS route FROM q""")
def regex_routes(spark, sf_dir):
    pattern = F.concat(F.get(F.array(*map(F.lit, _REGEX_ROUTES)), (F.col("event_id") % 5).cast("int")), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", s.regex_route(pattern).alias("route"))


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' Express' WHEN 1 THEN 'NestJS ' WHEN 2 THEN 'DJANGO' WHEN 3 THEN 'Cobol' WHEN 4 THEN 'spring_boot' ELSE 'gin' END AS raw FROM orders),
a(alias, framework) AS (VALUES ('express', 'nodejs'), ('nestjs', 'nodejs'), ('django', 'python'), ('spring_boot', 'java'), ('gin', 'golang'))
SELECT o_orderkey, coalesce(framework, lower(trim(raw))) AS framework FROM x LEFT JOIN a ON alias = lower(trim(raw))""")
def framework_alias(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, (" Express", "NestJS ", "DJANGO", "Cobol", "spring_boot", "gin"))), (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.canonical_framework(raw).alias("framework"))


@query("""WITH x AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN event_type WHEN user_id % 3 = 1 THEN event_type || '#' || user_id ELSE event_type || '#' || user_id || '#x' END AS target FROM events)
SELECT event_id, CASE WHEN len(string_split(target, '#')) = 2 THEN string_split(target, '#')[1] END AS controller, CASE WHEN len(string_split(target, '#')) = 2 THEN string_split(target, '#')[2] END AS action, 'admin/' || replace(target, '#', '') AS joined FROM x""")
def controller_actions(spark, sf_dir):
    third = F.col("user_id") % 3
    target = F.when(third == 0, F.col("event_type")).when(third == 1, F.concat_ws("#", "event_type", F.col("user_id").cast("string"))).otherwise(F.concat_ws("#", "event_type", F.col("user_id").cast("string"), F.lit("x")))
    e = table(spark, sf_dir, "events").select("event_id", s.split_action(target).alias("a"), s.join_controllers(F.lit("/admin/"), F.concat(F.lit("/"), F.replace(target, F.lit("#"), F.lit("")))).alias("joined"))
    return e.select("event_id", "a.controller", "a.action", "joined")


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN NULL ELSE 'POST' END, ''), nullif(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, '')) AS method FROM events")
def effective_methods(spark, sf_dir):
    own = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 2, "POST")
    return table(spark, sf_dir, "events").select("event_id", s.effective_method(own, F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))).alias("method"))


@query(r"""WITH v AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, name || CASE length(name) % 4 WHEN 0 THEN 'Router' WHEN 1 THEN 'Client' WHEN 2 THEN 'Api' ELSE '' END AS name FROM v)
SELECT lower(name) AS name, count(*) AS uses FROM w WHERE NOT regexp_matches(lower(name), '(client|service)$') AND (lower(name) IN ('app', 'router', 'route', 'api', 'controller', 'server') OR regexp_matches(lower(name), '(router|routes|route|app|server|controller|api)$') OR regexp_matches(lower(name), '^(app|api)')) GROUP BY 1""")
def route_object_names(spark, sf_dir):
    """Words of documents as programmers would extend them: some name a router, some a client, some neither."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1))).alias("word"))
    words = words.withColumn("name", F.concat("word", F.get(F.array(*map(F.lit, ("Router", "Client", "Api", ""))), F.length("word") % 4)))
    low = F.lower("name")
    ends = lambda c, some: c.rlike(f"({'|'.join(some)})$")
    looks = ~ends(low, js_facts.NO_ROUTE_ENDS) & (low.isin(*sorted(js_facts.ROUTE_NAMES)) | ends(low, js_facts.ROUTE_ENDS) | low.rlike(f"^({'|'.join(js_facts.ROUTE_STARTS)})"))
    return words.where(looks).groupBy(low.alias("name")).agg(F.count("*").alias("uses"))


@query(r"""SELECT page_id, regexp_matches(html, '(?i)<h1') OR regexp_matches(html, '(?i)<nav') AS defines, CASE WHEN regexp_matches(url, '(?i)(route|api|p)') THEN 0 ELSE 1 END AS rank, row_number() OVER (ORDER BY CASE WHEN regexp_matches(url, '(?i)(route|api|p)') THEN 0 ELSE 1 END, url, page_id) AS place FROM pages""")
def routes_first(spark, sf_dir):
    """Files that may define routes, those that look like routing first, then by path: numbered over range partitions."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("html").rlike("(?i)<h1") | F.col("html").rlike("(?i)<nav")).alias("defines"), F.when(F.col("url").rlike("(?i)(route|api|p)"), 0).otherwise(1).alias("rank"))
    return joins.numbered(p, ["rank", "url", "page_id"], "place").select("page_id", "defines", "rank", "place")


@query(r"""WITH r AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages), raw AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '../..' || path WHEN 1 THEN './x/../' || substr(path, 2) WHEN 2 THEN path ELSE 'http:' || path END AS ref FROM r)
SELECT page_id, CASE WHEN page_id % 4 = 1 THEN rtrim('specs/v1/' || regexp_replace(regexp_replace(substr(ref, 8), '/+', '/', 'g'), '^/', ''), '/') WHEN page_id % 4 = 0 THEN nullif(trim(regexp_replace(substr(ref, 6), '/+', '/', 'g'), '/'), '') END AS inside FROM raw""")
def contained_paths(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    which = F.col("page_id") % 4
    ref = F.when(which == 0, F.concat(F.lit("../.."), path)).when(which == 1, F.concat(F.lit("./x/../"), F.substring(path, 2, 1 << 20))).when(which == 2, path).otherwise(F.concat(F.lit("http:"), path))
    return table(spark, sf_dir, "pages").select("page_id", s.contained(F.lit("specs/v1"), ref).alias("inside"))


@query(r"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(x))) AS line, unnest(x) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, line, CASE doc_id % 3 WHEN 0 THEN body || ' # note' WHEN 1 THEN body || ' "a # b" # c' ELSE '"' || replace(replace(body, '"', ''), chr(39), '') || ' # kept' END AS body FROM l WHERE NOT regexp_matches(body, '[#"'']'))
SELECT doc_id, line, CASE doc_id % 3 WHEN 0 THEN body[: len(body) - 6] WHEN 1 THEN body[: len(body) - 3] ELSE body END AS bare FROM t""")
def comment_stripping(spark, sf_dir):
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "body")).where(~F.col("body").rlike("[#\"']"))
    third = F.col("doc_id") % 3
    body = F.when(third == 0, F.concat("body", F.lit(" # note"))).when(third == 1, F.concat("body", F.lit(' "a # b" # c'))).otherwise(F.concat(F.lit('"'), "body", F.lit(" # kept")))
    return l.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), s.uncommented(body).alias("bare"))


@query(r"""SELECT event_id, CASE WHEN value > 100 THEN 'true' WHEN value > 50 THEN 'false' END AS interface_only, event_type AS use_tags FROM events""")
def option_extraction(spark, sf_dir):
    """First match of each option in a build text."""
    first = F.when(F.col("value") > 100, "interfaceOnly = 'true'\n").when(F.col("value") > 50, "interfaceOnly: false\n").otherwise("")
    text = F.concat(F.lit("generate(\n"), first, F.lit('useTags => "'), F.col("event_type"), F.lit('"\n useTags = later)'))
    o = table(spark, sf_dir, "events").select("event_id", s.options(text, cf.OPTIONS).alias("o"))
    return o.select("event_id", F.col("o")["interfaceOnly"].alias("interface_only"), F.col("o")["useTags"].alias("use_tags"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"#?]*)', 1))), ',') AS hints FROM pages""")
def hint_extraction(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(s.hints(F.col("html"), 'href="([^"#?]*)'), ",").alias("hints"))


# --- operations of specifications --------------------------------------------------------------


@query("""SELECT user_id, arg_min(CASE event_type WHEN 'click' THEN 'get' WHEN 'view' THEN 'post' ELSE 'put' END, event_id) AS verb, arg_min(value, event_id) AS body FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value > 20 GROUP BY user_id""")
def first_operation(spark, sf_dir):
    verb = F.when(F.col("event_type") == "click", "GET").when(F.col("event_type") == "view", "Post").when(F.col("event_type") == "purchase", "put").otherwise("x-note")
    e = table(spark, sf_dir, "events").withColumn("verb", verb).withColumn("body", F.when(F.col("value") > 20, F.col("value")))
    return specs.first_operation(e, ["user_id"], "event_id", "verb", "body")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS description, o_orderstatus AS auth_tag, 2 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS fields FROM orders""")
def legacy_fields(spark, sf_dir):
    m = F.create_map(F.lit("api_description"), "o_orderstatus", F.lit("auth_tag"), "o_orderstatus")
    m = F.map_concat(m, F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("description"), "o_orderpriority")).otherwise(F.expr("map()").cast("map<string,string>")))
    m = F.map_concat(m, F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("summary"), "o_orderstatus")).otherwise(F.expr("map()").cast("map<string,string>")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", specs.rename_fields(m, specs.LEGACY_FIELDS).alias("m"))
    return o.select("o_orderkey", F.col("m")["description"].alias("description"), F.col("m")["x-auth-tag"].alias("auth_tag"), F.size("m").alias("fields"))


@query("""WITH t AS (SELECT user_id, list_filter(list_transform(list(CASE WHEN value > 60 THEN ' ' || event_type || ' ' WHEN value > 30 THEN '  ' END ORDER BY event_id), lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS tags FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ',') END AS tags FROM t""")
def blank_tags(spark, sf_dir):
    tag = F.when(F.col("value") > 60, F.concat(F.lit(" "), "event_type", F.lit(" "))).when(F.col("value") > 30, "  ")
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", tag.alias("tag")))), lambda x: x["tag"]).alias("tags"))
    return g.select("user_id", F.array_join(specs.without_blanks(F.col("tags")), ",").alias("tags"))


@query(r"""WITH r AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '/*' ELSE regexp_replace(url, '[?#].*$', '') END AS route FROM pages)
SELECT regexp_replace(route, '/+$', '') AS route, 'get' AS verb, max(page_id) AS payload FROM r WHERE route NOT IN ('/*', '*') GROUP BY 1""")
def rekey_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 9 == 0, "/*").otherwise(F.regexp_replace("url", "[?#].*$", "")).alias("route"), F.lit("get").alias("verb"), F.col("page_id").alias("payload"))
    return specs.rekey(p, "route", "verb", F.regexp_replace("route", "/+$", ""), "page_id", "payload")


@query("""SELECT DISTINCT e.event_id FROM events e WHERE e.event_type = 'purchase' AND EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'view' AND p.user_id = e.user_id AND extract('day' FROM p.ts) = extract('day' FROM e.ts))""")
def put_mirrors_patch(spark, sf_dir):
    verb = F.when(F.col("event_type") == "view", "patch").when(F.col("event_type") == "purchase", "put").otherwise("get")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.dayofmonth("ts").alias("route"), verb.alias("verb"))
    return specs.mirrored(e, ["user_id", "route"], "verb", "PATCH", "PUT").select("event_id")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, '/orders/{' || o_orderkey % 4 || '}/' || o_orderpriority AS route FROM orders), r AS (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS reply FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT a.o_orderkey, reply FROM a LEFT JOIN r ON r.o_custkey = a.o_custkey AND a.route LIKE '%/' || p""")
def request_reply(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    route = F.concat(F.lit("/orders/{"), (F.col("o_orderkey") % 4).cast("string"), F.lit("}/"), F.col("o_orderpriority"))
    asked = o.select("o_orderkey", "o_custkey", route.alias("route"), F.lit("get").alias("method"))
    replies = o.where("o_orderstatus = 'F'").select("o_custkey", F.concat(F.lit("/orders/{any}/"), F.col("o_orderpriority")).alias("route"), F.lit("GET").alias("method"), F.col("o_orderkey").alias("reply"))
    return specs.answered(asked, replies, ["o_custkey"], "route", "method", "reply").select("o_orderkey", "reply")


def _specs(spark, sf_dir):
    """A document for each customer: its orders refer to components of their priorities."""
    ref = F.concat(F.lit('{"$ref": "#/components/schemas/'), F.col("o_orderpriority"), F.lit('"}'))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", ref.alias("r")))), lambda x: x["r"]), ", "), F.lit("]")).alias("doc"))


@query("""SELECT o_custkey, '[' || string_agg('{"$ref": "#/components/schemas/' || CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN o_custkey || '_' ELSE '' END || o_orderpriority || '"}', ', ' ORDER BY o_orderkey) || ']' AS doc FROM orders GROUP BY o_custkey""")
def reference_rewrite(spark, sf_dir):
    """References onto components that carry their specification's name."""
    docs = _specs(spark, sf_dir)
    mine = docs.select("o_custkey", F.explode(specs.references(F.col("doc"))).alias("pointer")).where(F.col("pointer").rlike("/[12][^/]*$"))
    return specs.rewrite_references(docs, "o_custkey", "doc", specs.namespaced(mine, "o_custkey", "pointer"))


@query("""WITH RECURSIVE c AS (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders), n AS (SELECT o_custkey, min(p) AS p FROM c GROUP BY 1),
r AS (SELECT o_custkey, p FROM n UNION SELECT r.o_custkey, (SELECT min(p) FROM c WHERE c.o_custkey = r.o_custkey AND c.p > r.p) AS p FROM r WHERE r.p IS NOT NULL)
SELECT o_custkey, '#/components/schemas/' || p AS pointer FROM r WHERE p IS NOT NULL AND p NOT LIKE '5%' UNION ALL SELECT o_custkey, '#/components/schemas/' || p FROM r WHERE p LIKE '5%'""")
def closure_components(spark, sf_dir):
    """Each customer's first component refers to the next, and so on: what its operation needs."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    from pyspark.sql import Window

    after = F.lead("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderpriority"))  # five at most
    ref = lambda p: F.concat(F.lit('{"$ref": "#/components/schemas/'), p, F.lit('"}'))
    comps = o.select("o_custkey", F.concat(F.lit("#/components/schemas/"), "o_orderpriority").alias("pointer"), F.coalesce(ref(after), F.lit("{}")).alias("doc"))
    ops = o.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p")).select("o_custkey", ref(F.col("p")).alias("doc"))
    return specs.closure_components(ops, comps, "o_custkey", "doc", "pointer")


# --- context of endpoints ----------------------------------------------------------------------


@query("""WITH s AS (SELECT doc_id, doc_id % 3 + 1 AS a, doc_id % 3 + 3 AS b, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(x[a : b], chr(10)) AS block FROM s""")
def source_lines(spark, sf_dir):
    first = (F.col("doc_id") % 3 + 1).cast("int")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", context.lines(F.col("text"), first, first + 2).alias("block"))


@query("""SELECT doc_id, CASE WHEN ceil(length(text) / 4) <= 100 THEN text ELSE substr(text, 1, 400) || chr(10) || '... truncated' END AS text FROM documents""")
def truncate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", context.truncate(F.col("text"), 100, lambda c: F.ceil(F.length(c) / 4)).alias("text"))


@query("""WITH d AS (SELECT l_partkey, l_suppkey, arg_min(l_linenumber, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) * 100000000 + l_orderkey) AS l, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS k, min(CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) * 100000000 + l_orderkey) % 100000000 AS start_line FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, CASE k WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'variable' END AS kind, start_line FROM orders JOIN d ON l_partkey = o_orderkey % 200 + 1 AND l_suppkey = o_custkey % 10 + 1""")
def imported_definitions(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("rel_path"), F.col("l_suppkey").alias("name"), F.when(F.col("l_returnflag") == "A", "class").when(F.col("l_returnflag") == "N", "function").otherwise("variable").alias("kind"), F.col("l_orderkey").alias("start_line"), F.col("l_linenumber").alias("end_line"))
    i = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 200 + 1).alias("rel_path"), (F.col("o_custkey") % 10 + 1).alias("name"))
    return context.imported_definitions(i, d).select("o_orderkey", "kind", "start_line")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), sp AS (SELECT doc_id, doc_id % 7 AS key, unnest([1, 2, 3, 4]) AS i FROM l),
b AS (SELECT key, doc_id * 10 + i AS pos, array_to_string(x[i % 3 + 1 : i % 3 + 2], chr(10)) AS block FROM sp JOIN l USING (doc_id)), k AS (SELECT key, block, min(pos) AS pos FROM b WHERE regexp_matches(block, '[^ \t\n\r\f\x0B]') GROUP BY 1, 2)
SELECT key, count(*) AS n_blocks, sha256(string_agg(block, chr(10) ORDER BY pos)) AS blocks FROM k GROUP BY key""")
def context_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    start = (F.col("i") % 3 + 1).cast("int")
    spans = d.select("doc_id", (F.col("doc_id") % 7).alias("key"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("i"))
    spans = spans.select("key", (F.col("doc_id") * 10 + F.col("i")).alias("pos"), F.col("doc_id").alias("rel_path"), start.alias("start_line"), (start + 1).alias("end_line"))
    got = context.blocks(spans, d.select(F.col("doc_id").alias("rel_path"), "text"))
    return got.select("key", F.size("blocks").cast("long").alias("n_blocks"), F.sha2(F.array_join("blocks", "\n"), 256).alias("blocks"))


@query("""WITH d AS (SELECT l_suppkey, l_partkey, max(struct_pack(a := l_orderkey, b := l_linenumber)) AS d FROM lineitem GROUP BY 1, 2), h AS (SELECT s_suppkey, s_suppkey * 10 AS a, s_suppkey * 10 + 400 AS b FROM supplier)
SELECT DISTINCT h.s_suppkey AS key, c.l_partkey AS name, d.d.a AS start_line FROM h JOIN lineitem c ON c.l_suppkey = h.s_suppkey AND c.l_orderkey >= h.a AND c.l_orderkey + 1 <= h.b JOIN d ON d.l_suppkey = c.l_suppkey AND d.l_partkey = c.l_partkey WHERE d.d.a <> h.a""")
def called_definitions(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    calls = l.select(F.col("l_suppkey").alias("rel_path"), F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + 1).alias("end"))
    defs = l.select(F.col("l_suppkey").alias("rel_path"), F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("start_line"), F.col("l_linenumber").alias("end_line"))
    h = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_suppkey").alias("rel_path"), (F.col("s_suppkey") * 10).alias("start"), (F.col("s_suppkey") * 10 + 400).alias("end"))
    return context.called_definitions(h, calls, defs).select("key", "name", "start_line")


@query("""WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_linenumber) AS k FROM lineitem) SELECT l_orderkey, l_partkey, CAST(k AS INTEGER) AS place FROM r WHERE k <= 3""")
def type_context(spark, sf_dir):
    """Up to three types of each import alias."""
    return joins.top_n(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_extendedprice", "l_partkey", "l_linenumber"], 3, "place").select("l_orderkey", "l_partkey", "place")


@query("""WITH c AS (SELECT o_orderkey, unnest([o_custkey * 3, o_custkey * 2, o_custkey]) AS path, unnest([0, 1, 2]) AS pos FROM orders) SELECT o_orderkey, arg_min(path, pos) AS origin FROM c JOIN customer ON path = c_custkey GROUP BY 1""")
def import_origin(spark, sf_dir):
    """The first of several places, in their order, that holds a file."""
    probes = F.array(F.col("o_custkey") * 3, F.col("o_custkey") * 2, F.col("o_custkey"))
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    return joins.first_existing(table(spark, sf_dir, "orders"), "o_orderkey", probes, files, "path", "origin")


@query("""WITH c AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/') AS x FROM pages), p AS (SELECT page_id, unnest(generate_series(1, len(x))) AS n, x FROM c), q AS (SELECT page_id, n, array_to_string(x[1 : n], '/') AS prefix FROM p), k AS (SELECT DISTINCT array_to_string(x[1 : 2], '/') AS prefix FROM c)
SELECT page_id, max(n) AS parts, arg_max(prefix, n) AS origin FROM q JOIN k USING (prefix) GROUP BY 1""")
def longest_prefix_origin(spark, sf_dir):
    """The longest known prefix of a dotted or slashed name."""
    parts = F.split(F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""), "/")
    p = table(spark, sf_dir, "pages").select("page_id", parts.alias("parts"))
    known = p.select(F.array_join(F.slice("parts", 1, 2), "/").alias("origin")).distinct()
    got = joins.longest_prefix(p, "page_id", "parts", "/", known, "origin")
    return got.select("page_id", F.col("length").cast("long").alias("parts"), "origin")


# --- state between runs ------------------------------------------------------------------------


@query("""WITH h AS (SELECT l_suppkey AS key, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS context_hash FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), f AS (SELECT DISTINCT l_suppkey AS key, CAST(l_linenumber AS VARCHAR) AS rel_path FROM lineitem),
i AS (SELECT l_suppkey AS key, CAST(l_linenumber AS VARCHAR) AS rel_path, count(DISTINCT l_partkey) AS n, sum(DISTINCT l_partkey) AS total FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2)
SELECT CAST(f.key AS VARCHAR) AS key, f.rel_path, coalesce(n, 0) AS n_imports, CAST(coalesce(total, 0) AS BIGINT) AS imported, context_hash FROM f LEFT JOIN i USING (key, rel_path) LEFT JOIN h USING (key)""")
def index_build(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_linenumber").cast("string").alias("rel_path"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("context_hash"), "l_partkey", "l_quantity")
    imports = l.where("l_quantity > 25").select("key", "rel_path", F.col("l_partkey").cast("string").alias("import_path"), F.lit("f").alias("name"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    got = state_tables.build_index(l.select("key", "pos", "rel_path", "context_hash"), imports)
    return got.select("key", "rel_path", F.size("imports").cast("long").alias("n_imports"), F.aggregate("imports", F.lit(0).cast("long"), lambda a, x: a + x["rel_path"].cast("long")).alias("imported"), "context_hash")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS h FROM orders), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderpriority END AS h FROM orders WHERE o_orderstatus <> 'P')
SELECT n.k AS k, n.h AS h, EXISTS (SELECT 1 FROM o WHERE o.k = n.k AND o.h = n.h) AS hit FROM n""")
def cache_lookup(spark, sf_dir):
    """Current files against cached ones: what is known, what must be parsed; the cache keeps only what is alive."""
    o = table(spark, sf_dir, "orders")
    cache = o.select(F.col("o_orderkey").alias("rel_path"), F.col("o_orderpriority").alias("hash"), F.lit("cached").alias("facts"))
    files = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("rel_path"), F.when(F.col("o_orderkey") % 5 == 0, "new").otherwise(F.col("o_orderpriority")).alias("text"))
    facts, _ = state_tables.cached_facts(files, cache, lambda missing: missing.select("rel_path", "hash", F.lit("parsed").alias("facts")), F.col("text"))
    return facts.select(F.col("rel_path").alias("k"), F.col("hash").alias("h"), (F.col("facts") == "cached").alias("hit"))


@query("SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def missing_index_paths(spark, sf_dir):
    indexed = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"))
    return state.missing_paths(indexed, table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("path")), "path")


@query("""SELECT o_custkey AS path FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT l_suppkey FROM lineitem WHERE l_quantity > 49""")
def changed_union(spark, sf_dir):
    """Paths changed by any of four accounts."""
    c = table(spark, sf_dir, "customer")
    parts = [table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey"), c.where("c_acctbal < 0").select("c_custkey"), c.where("c_mktsegment = 'BUILDING'").select("c_custkey"), table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_suppkey")]
    return merge.union_paths([p.toDF("path") for p in parts])


@query("""SELECT o_custkey, sha256(string_agg(o_orderpriority || ':' || o_orderkey, '' ORDER BY o_orderpriority || ':' || o_orderkey)) AS hash FROM orders GROUP BY 1""")
def eligibility_hash(spark, sf_dir):
    return state.ordered_hash(table(spark, sf_dir, "orders"), ["o_custkey"], F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string")), "hash")


@query("""WITH w AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents)
SELECT source, doc_id FROM w WHERE n < 20 AND b < 30000""")
def discovery_budget(spark, sf_dir):
    return budget.within(table(spark, sf_dir, "documents"), ["source"], "doc_id", "n_chars", 20, 30000).select("source", "doc_id")


@query("""SELECT l_orderkey, l_suppkey, m.a AS l_linenumber, m.b AS l_partkey FROM (SELECT l_orderkey, l_suppkey, min(struct_pack(a := l_linenumber, b := l_partkey)) AS m FROM lineitem GROUP BY 1, 2)""")
def first_declaration(spark, sf_dir):
    """Of the declarations of a name in a scope, the first in the source."""
    return dedupe.first_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"], "l_linenumber", ["l_partkey"])


@query("""SELECT l_orderkey, l_linenumber, count(*) FILTER (l_returnflag = 'N') OVER (PARTITION BY l_orderkey) AS siblings FROM lineitem""")
def sibling_count(spark, sf_dir):
    """Documents of a file with how many of its documents are contracts."""
    return joins.with_count(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "N", "siblings").select("l_orderkey", "l_linenumber", "siblings")


@query("""SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1""")
def group_in_order(spark, sf_dir):
    g = dedupe.grouped(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_orderkey"])
    return g.select("o_custkey", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("keys"))


@query("""WITH b AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS base, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus <> 'P')) AS kept, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS gone FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_filter(base, lambda x: (o_custkey % 2 = 0 OR list_contains(coalesce(kept, []), x)) AND NOT list_contains(coalesce(gone, []), x)), ',') AS actions FROM b""")
def action_sets(spark, sf_dir):
    p = F.col("o_orderpriority")
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(p)).alias("base"), F.collect_set(F.when(F.col("o_orderstatus") != "P", p)).alias("kept"), F.collect_set(F.when(F.col("o_orderstatus") == "F", p)).alias("gone"))
    return g.select("o_custkey", F.array_join(merge.action_algebra(F.col("base"), F.when(F.col("o_custkey") % 2 == 1, F.col("kept")), F.col("gone")), ",").alias("actions"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_linenumber = 1), r AS (SELECT DISTINCT b AS n FROM e WHERE a IN (SELECT p_partkey FROM part WHERE p_size = 1) UNION SELECT e.b FROM r JOIN e ON e.a = r.n)
SELECT p_partkey, CAST(p_size AS BIGINT) AS methods FROM part WHERE p_partkey NOT IN (SELECT n FROM r)""")
def unreachable_mappings(spark, sf_dir):
    """Interfaces that no class reaches, with the mappings they declare."""
    edges = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    roots = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("src")).join(edges, "src").select(F.lit(0).alias("root"), F.col("dst").alias("node")).distinct()
    reached = closure.transitive(roots, edges).select(F.col("node").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(reached, "p_partkey", "left_anti").select("p_partkey", F.col("p_size").cast("long").alias("methods"))
