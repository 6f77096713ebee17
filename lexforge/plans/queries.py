"""Queries over the star-schema tables, each with the SQL that gives the same rows where SQL can.

Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import queries as codecs
from ..functions import text as T
from ..markup import queries as markup
from ..operators import relational as R
from ..operators import variants

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def register(f):
        _found[f.__name__] = (lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"), spark), sql)
        return f

    return register


_CODE = "CASE lang WHEN 'de' THEN 1031 WHEN 'en' THEN 1033 WHEN 'fr' THEN 1036 WHEN 'es' THEN 1034 ELSE 0 END"


@query(f"SELECT doc_id, {_CODE} AS source_lang, 1031 AS target_lang FROM documents WHERE {_CODE} = 1033")
def lang_filter(table, spark):
    d = table("documents").select("doc_id", _lang_code().alias("source_lang"), F.lit(1031).alias("target_lang"))
    return R.by_language(d, 1033, -1)


def _lang_code():
    out = F.lit(0)
    for lang, name in (("de", "deu"), ("en", "enu"), ("fr", "fra"), ("es", "esn")):
        out = F.when(F.col("lang") == lang, T.DESCRIPTOR_LANGUAGES[name]).otherwise(out)
    return out


@query(f"SELECT doc_id, code, CASE code WHEN 1031 THEN 'German' WHEN 1033 THEN 'English' WHEN 1036 THEN 'French' WHEN 1034 THEN 'Spanish' ELSE 'unknown' END AS language FROM (SELECT doc_id, {_CODE} AS code FROM documents)")
def lang_code_lookup(table, spark):
    return R.language_names(table("documents").select("doc_id", _lang_code().alias("code")), "code")


_VERSIONS = (0x110001, 0x120001, 0x131001, 0x132001, 0x141004, 0x142001, 0x145001, 0x151005, 0x152001, 0x155001, 0x160000, 0x100000)


@query(
    "SELECT version, CASE version "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in T.DECODERS.items())
    + " ELSE 'unsupported' END AS decoder, version >> 16 AS major, (version >> 12) & 15 AS minor, version & 4095 AS revision, lower(format('{:x}', version)) AS hex FROM (VALUES "
    + ", ".join(f"({v})" for v in _VERSIONS)
    + ") AS t(version)"
)
def decoder_dispatch(table, spark):
    v = spark.createDataFrame([(x,) for x in _VERSIONS], "version int")
    c = F.col("version")
    return R.supported(v, "version").select("version", "decoder", *(T.version_part(c, p).alias(p) for p in ("major", "minor", "revision")), T.hex_version(c).alias("hex"))


@query("SELECT conv_id, min(turn) AS first_ord, string_agg(role, '|' ORDER BY turn, role) AS headings FROM conversations GROUP BY conv_id")
def group_headings(table, spark):
    return R.grouped_headings(table("conversations"), "conv_id", "turn", "role").withColumn("headings", F.array_join("headings", "|"))


@query(
    "SELECT l_orderkey, headings, coalesce(lead(l_orderkey) OVER (ORDER BY l_orderkey) - l_orderkey, -1) AS article_size FROM (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS headings FROM lineitem GROUP BY l_orderkey)"
)
def group_entries_sorted(table, spark):
    l = table("lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("name"))
    return R.grouped_entries(l, "l_orderkey", "name").withColumn("headings", F.array_join("headings", ","))


@query(
    "SELECT conv_id, headings, md5(text) AS article FROM (SELECT conv_id, string_agg(role, '|' ORDER BY turn, role) AS headings FROM conversations GROUP BY conv_id) JOIN documents ON doc_id = conv_id"
)
def join_heading_article(table, spark):
    heads = R.grouped_headings(table("conversations"), "conv_id", "turn", "role")
    articles = table("documents").select(F.col("doc_id").alias("conv_id"), F.md5("text").alias("article"))
    return heads.join(articles, "conv_id").select("conv_id", F.array_join("headings", "|").alias("headings"), "article")


@query(
    "WITH hit AS (SELECT k, min(p_partkey) AS first FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) JOIN part ON p_partkey <= k AND k < p_partkey + p_size GROUP BY k) "
    "SELECT l_orderkey, l_linenumber, l_partkey, p_name AS file, l_partkey - first AS within FROM lineitem LEFT JOIN hit ON l_partkey = k LEFT JOIN part ON p_partkey = first"
)
def range_reference(table, spark):
    ranges = table("part").select(F.col("p_name").alias("file"), F.col("p_partkey").alias("first"), (F.col("p_partkey") + F.col("p_size")).alias("last"), F.col("p_partkey").alias("ord"))
    rows = table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return R.range_lookup(rows, ranges, "l_partkey", "first", "last", "ord").select("l_orderkey", "l_linenumber", "l_partkey", "range.file", "within")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def code_lookup(table, spark):
    return table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


_TRIM = "trim({}, ' ,;!?-.' || chr(9))"


@query(
    "WITH g AS (SELECT s_nationkey, list_sort(list(s_name)) AS headings FROM supplier GROUP BY s_nationkey), "
    f"r AS (SELECT c_custkey, c_nationkey, {_TRIM.format('hint')} AS hint FROM (SELECT *, ' ,' || replace(c_name, 'Customer', 'Supplier') || '; .' AS hint FROM customer)) "
    "SELECT c_custkey, CASE WHEN headings IS NULL THEN 'unknown' WHEN list_contains(headings, hint) THEN hint ELSE headings[1] END AS resolved FROM r LEFT JOIN g ON s_nationkey = c_nationkey"
)
def resolve_with_hint(table, spark):
    groups = table("supplier").groupBy(F.col("s_nationkey").alias("target")).agg(F.sort_array(F.collect_list("s_name")).alias("headings"))
    refs = table("customer").select("c_custkey", F.col("c_nationkey").alias("target"), F.concat(F.lit(" ,"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")), F.lit("; .")).alias("hint"))
    return R.resolved(refs, groups, "target", "hint").select("c_custkey", "resolved")


@query(
    "SELECT c_custkey, coalesce(f, w) AS file FROM (SELECT c_custkey, lower(replace(c_name, 'Customer', 'Supplier')) || '.BOF' AS w FROM customer) LEFT JOIN (SELECT upper(s_name) || '.bof' AS f FROM supplier) ON lower(f) = lower(w)"
)
def case_insensitive_pairing(table, spark):
    wanted = table("customer").select("c_custkey", F.concat(F.lower(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))), F.lit(".BOF")).alias("name"))
    files = table("supplier").select(F.concat(F.upper("s_name"), F.lit(".bof")).alias("found"))
    return R.case_repaired(wanted, files, "name", "found").select("c_custkey", "file")


@query("SELECT c_name AS name FROM customer WHERE lower(replace(c_name, 'Customer', 'Supplier')) NOT IN (SELECT lower(s_name) FROM supplier)")
def unclaimed_files(table, spark):
    c = table("customer").select(F.col("c_name").alias("own"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name"))
    return R.without_used(c, table("supplier").select(F.upper("s_name").alias("name")), "name").select(F.col("own").alias("name"))


@query("""
WITH RECURSIVE edges AS (
  SELECT NULL AS p, 'r' || r_regionkey AS c, r_regionkey AS o FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_nationkey FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer),
walk AS (
  SELECT c AS node, 0 AS depth, printf('%010d', o) AS path FROM edges WHERE p IS NULL
  UNION ALL SELECT c, depth + 1, path || '/' || printf('%010d', o) FROM walk JOIN edges ON p = node)
SELECT node, depth, path FROM walk""")
def recursive_tree(table, spark):
    edge = lambda df, p, c, at: df.select(p.alias("p"), c.alias("c"), F.col(at).cast("long").alias("at"))
    key = lambda kind, name: F.concat(F.lit(kind), F.col(name).cast("string"))
    edges = edge(table("region"), F.lit(None).cast("string"), key("r", "r_regionkey"), "r_regionkey").unionByName(edge(table("nation"), key("r", "n_regionkey"), key("n", "n_nationkey"), "n_nationkey"))
    edges = edges.unionByName(edge(table("customer"), key("n", "c_nationkey"), key("c", "c_custkey"), "c_custkey"))
    return R.tree_paths(edges, "p", "c", "at")


@query("SELECT user_id, value, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, value ORDER BY event_id) AS r FROM events) WHERE r = 1")
def ordered_set_dedup(table, spark):
    return R.first_of(table("events").select("user_id", "value", "event_id", "event_type"), ["user_id", "value"], ["event_id"])


@query("SELECT doc_id, printf('rendered_table_%04d.png', dense_rank() OVER (ORDER BY f)) AS name FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)")
def dedup_content_names(table, spark):
    return R.content_names(table("documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "name")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins_map(table, spark):
    return R.last_of(table("events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"])


@query(
    "SELECT doc_id, o AS \"offset\", o // 8192 AS first_block, (o + greatest(n_chars - 1, 0)) // 8192 AS last_block, o % 8192 AS skip FROM (SELECT doc_id, n_chars, CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM documents)"
)
def block_locate(table, spark):
    return R.located(table("documents").select("doc_id", "n_chars"), ["doc_id"], "n_chars").drop("n_chars")


@query("SELECT doc_id, md5(substr(text, CAST(length(text) // 3 + 1 AS BIGINT), 10000)) AS content FROM documents WHERE length(text) > 0")
def range_read(table, spark):
    docs = table("documents").select("doc_id", "text").where(F.length("text") > 0)
    asked = docs.select("doc_id", F.floor(F.length("text") / 3).cast("int").alias("off"), F.lit(10000).alias("size"))
    return R.read_ranges(asked, R.blocks_of(docs, "doc_id", "text"), "doc_id", "off", "size").select("doc_id", F.md5("content").alias("content"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '([\[\]#~^@])', '\\\1', 'g')) AS body FROM documents")
def dsl_escape(table, spark):
    return table("documents").select("doc_id", F.md5(T.dsl_escape(F.col("text"))).alias("body"))


@query(r"SELECT page_id, md5(regexp_replace(html, '([()])', '\\\1', 'g')) AS body FROM pages")
def heading_escape(table, spark):
    return table("pages").select("page_id", F.md5(T.heading_escape(F.col("html"))).alias("body"))


@query("SELECT conv_id, turn, chr(9) || replace(text, chr(10), chr(10) || chr(9)) || chr(10) AS body FROM conversations")
def article_indent(table, spark):
    return table("conversations").select("conv_id", "turn", T.indented(F.col("text")).alias("body"))


@query(f"SELECT conv_id, turn, {_TRIM.format('text')} AS name FROM conversations")
def trim_display_name(table, spark):
    return table("conversations").select("conv_id", "turn", T.display_name(F.col("text")).alias("name"))


@query(r"SELECT page_id, url || '.wav' AS audio, regexp_replace(url, '\.[^./]*$', '') AS stem, lower(regexp_extract(url, '\.([^./]*)$', 1)) AS ext FROM pages")
def ext_rewrite(table, spark):
    return table("pages").select("page_id", T.audio_name(F.concat("url", F.lit(".ADP"))).alias("audio"), T.stem(F.col("url")).alias("stem"), T.extension(F.col("url")).alias("ext"))


@query("SELECT p_partkey, p_name AS name, p_size - 1 AS \"offset\" FROM part WHERE p_size % 7 <> 0")
def regex_heading_parse(table, spark):
    raw = F.concat("p_name", F.lit(" $$$$ -1 "), F.col("p_size").cast("string"), F.lit(" 0"), F.when(F.col("p_size") % 7 == 0, " 5").otherwise(""))
    return R.parsed_headings(table("part").select("p_partkey", raw.alias("h"), F.lit(-1).alias("o")), "h", "o").select("p_partkey", "name", "offset")


@query("""
WITH cell AS (SELECT l_orderkey, l_linenumber, max(l_quantity) % 2 = 0 AS merged FROM lineitem GROUP BY ALL),
owned AS (SELECT *, coalesce(last_value(CASE WHEN NOT merged THEN l_linenumber END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  min(l_linenumber) OVER (PARTITION BY l_orderkey)) AS o FROM cell)
SELECT l_orderkey, l_linenumber, merged, CAST(CASE WHEN l_linenumber = o THEN 1 + sum(merged::INT) OVER (PARTITION BY l_orderkey, o) ELSE 1 END AS INT) AS span FROM owned""")
def table_spans(table, spark):
    cells = table("lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_quantity") % 2 == 0).alias("merged"))
    return R.table_spans(cells, "l_orderkey", "l_linenumber", "merged")


@query("""
WITH b AS (SELECT p_partkey, p_name, coalesce(lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey), '') AS v FROM part),
n AS (SELECT p_partkey, p_name, len(list_filter(range(1, least(length(p_name), length(v)) + 1), lambda i: p_name[1:i] = v[1:i])) AS k FROM b)
SELECT p_partkey, k::INT AS prefix_len, p_name[k + 1:] AS suffix FROM n""")
def front_coding(table, spark):
    return R.front_coded(table("part").select("p_partkey", "p_name", "p_brand"), "p_brand", ["p_name", "p_partkey"], "p_name").select("p_partkey", "prefix_len", "suffix")


@query("SELECT p_partkey, p_name AS text FROM part")
def front_decoding(table, spark):
    part = table("part").select("p_partkey", "p_name", "p_brand")
    coded = R.front_coded(part.withColumn("ord", F.struct("p_name", "p_partkey")), "p_brand", ["ord"], "p_name")
    return R.front_decoded(coded, "p_brand", ["ord"], ["p_partkey"]).select("p_partkey", "text")


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '^[\n|]+', ''), '\n*\|\n*', '|', 'g'), '\n{2,}', chr(10), 'g')) AS body FROM documents")
def newline_collapse(table, spark):
    return table("documents").select("doc_id", F.md5(T.collapse_breaks(F.col("text"))).alias("body"))


@query(r"SELECT c_custkey, regexp_replace(c_name, '([0-9]+)', '{\1}', 'g') AS dsl, regexp_replace(c_name, '[0-9]', '', 'g') AS sort_key FROM customer")
def dsl_text(table, spark):
    h = T.chars(F.col("c_name"), "[0-9]")
    return table("customer").select("c_custkey", T.dsl_text(h).alias("dsl"), T.sort_key(h).alias("sort_key"))


@query("SELECT lang, source, count(*) AS articles, sum(n_chars)::BIGINT AS chars, count(*) FILTER (text = '') AS failures FROM documents GROUP BY lang, source")
def heading_stats(table, spark):
    return table("documents").groupBy("lang", "source").agg(F.count("*").alias("articles"), F.sum("n_chars").alias("chars"), F.count_if(F.col("text") == "").alias("failures"))


@query()
def batch_tables(table, spark):
    pages = table("pages").select("page_id", F.regexp_extract("url", "//([^/?#]*)", 1).alias("host"), (F.size(F.split("html", "<tr")) - 1).alias("rows"))
    return variants.greedy_batches(pages, "host", "page_id", "rows", 20)


@query(
    "WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS i, count(*) OVER () AS n FROM events) SELECT event_id, (100 * i // n)::INT AS percent FROM e WHERE 100 * i // n > 100 * (i - 1) // n OR i = 1"
)
def progress(table, spark):
    return R.progress(table("events").select("event_id"), ["event_id"]).select("event_id", "percent")


@query("SELECT doc_id, md5(text) AS digest, length(text)::BIGINT AS size, CASE WHEN n_chars = 0 OR n_chars > 5000 THEN 1 WHEN n_chars > 1000 THEN 2 ELSE 0 END AS status FROM documents")
def report_digest(table, spark):
    errors = F.when(F.col("n_chars") > 5000, 21).when(F.col("n_chars") > 1000, 1).otherwise(0)
    return table("documents").select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("size"), R.report_status(errors, F.col("n_chars") == 0).alias("status"))


@query("SELECT page_id, md5('data:image/png;base64,' || base64(encode(html))) AS uri FROM pages")
def base64_data_uri(table, spark):
    return table("pages").select("page_id", F.md5(T.data_uri(F.col("html").cast("binary"), "PNG")).alias("uri"))


@query(r"SELECT doc_id, (2 * length(text) + 2 * length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))::BIGINT AS n FROM documents")
def utf16_size(table, spark):
    return table("documents").select("doc_id", T.utf16_bytes(F.col("text")).cast("long").alias("n"))


@query("SELECT n_nationkey, (100 // (n_regionkey + 1)) * 2 AS width, length(bin(n_nationkey)) AS bits FROM nation")
def cell_widths(table, spark):
    return table("nation").select("n_nationkey", T.cell_width(F.col("n_regionkey") + 1, F.lit(2)).alias("width"), T.bit_length(F.col("n_nationkey").cast("long")).cast("long").alias("bits"))


@query("SELECT s_suppkey, s_name AS name, s_nationkey::BIGINT AS size, (s_suppkey % 256)::INT * 65793 AS rgb FROM supplier")
def entry_fields(table, spark):
    entry = T.resource_entry(F.concat("s_name", F.lit(";"), F.col("s_nationkey").cast("string")))
    two = F.lpad(F.hex(F.col("s_suppkey") % 256), 2, "0")
    return table("supplier").select("s_suppkey", entry["name"].alias("name"), entry["size"].alias("size"), T.rgb(F.concat_ws(" ", two, two, two)).alias("rgb"))


@query()
def collapse_variants(table, spark):
    p = table("part").select("p_partkey", F.col("p_size").alias("reference"), "p_name")
    heads = p.select("reference", F.explode(F.array(*(F.struct((F.col("p_partkey") * 2 + k).alias("ord"), variants.marked(F.concat("p_name", F.lit(tail))).alias("chars")) for k, tail in enumerate(("{(}{s}{)}", "{(}s{)}"))))).alias("x")).select("reference", "x.ord", "x.chars")
    return variants.collapsed(heads, "reference", "ord", "chars").select("reference", "ord", T.dsl_text(F.col("chars")).alias("dsl"))


def _all() -> dict[str, tuple[Query, str | None]]:
    return _found | codecs.QUERIES | markup.QUERIES


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
