"""Markup of the tables' texts, put into tags first."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import operators, tree


def _marked(spark, d):
    """Every sentence bold, its signs escaped."""
    safe = F.regexp_replace("text", r"([@\\~;}])", "")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("\\b{"), F.regexp_replace(safe, r"\. ", "}. \\\\\\\\b{"), F.lit("}")).alias("markup"))


def parse(spark, d):
    return operators.parsed(_marked(spark, d), "markup", "doc_id").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


KNOWN = tree.Known((("WEB", "Web", "W"), ("MEDIA", "Tabellen", "T"), ("MEDIA", "Bilder", "BB")), (("tab", 0, 1 << 62),), {"euro.bmp": "Euro.BMP"})


def resolve(spark, d):
    """A reference of each kind around every turn: its signs are escaped, not taken out."""
    x = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.regexp_replace(F.regexp_replace("text", r"[}\r\n]", ""), r"([@~;\\])", "@$1").alias("t"))
    turn = (F.col("turn") + 1).cast("string")
    marks = F.concat(
        F.lit("\\S{"), "t", F.lit(";:"), turn, F.lit("}\\S{;.IEURO.bmp;T}\\S{;.Ispeaker.bmp;T;"), "conv_id", F.lit(".Adp}\\S{"), "t", F.lit(";.MT:"), turn, F.lit(";Tabelle}\\S{;.MX:1;gone}\\w{"), "conv_id", F.lit('.adp "a";b.adp}'),
    )
    form = lambda n: tree.dsl(tree.resolve_articles(tree.resolve(n, KNOWN), lambda offset, _: f"head {offset}"))
    return x.select("conv_id", "turn", operators.printed(marks, form)["out"].alias("dsl"))


def print_dsl(spark, d):
    x = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.regexp_replace("text", r"[@\\~;}\r\n]", "").alias("t"))
    return x.select("conv_id", "turn", operators.printed(F.concat(F.lit("\\b{"), "t", F.lit("}\\i{"), "t", F.lit("}")), tree.dsl)["out"].alias("dsl"))


def print_html(spark, d):
    return _marked(spark, d).select("doc_id", F.md5(operators.printed(F.col("markup"), tree.html)["out"]).alias("digest"))


_CLEAN = r"regexp_replace(text, '[@\\~;}\r\n]', '', 'g')"
_SAFE = rf"regexp_replace({_CLEAN}, '([\[\]#^])', '\\\1', 'g')"
_BOLD = "CASE WHEN {0} = '' THEN '[{1}][/{1}]' ELSE '[{1}]' || {0} || '[/{1}]' END"
_TURN = r"regexp_replace(regexp_replace(text, '[}\r\n]', '', 'g'), '([\[\]#~^@])', '\\\1', 'g')"
_RESOLVED = f"""
WITH turn AS (SELECT conv_id, turn, {_TURN} AS t FROM conversations),
parts AS (SELECT *, trim(t, ' 	,;!?-.') AS body FROM turn)
SELECT conv_id, turn, CASE WHEN t = '' THEN '' ELSE t[1:strpos(t, body) - 1] || '[ref]head ' || turn || '[/ref]' || CASE WHEN body = 'head ' || turn THEN '' ELSE ' (' || body || ')' END || t[strpos(t, body) + len(body):] END
  || '[s]Euro.BMP[/s][s]' || conv_id || '.wav[/s]' || t || '[s]' || conv_id || '.wav[/s] "a", [s]b.wav[/s] ' AS dsl FROM parts"""
QUERIES = {
    "markup_resolve": (resolve, _RESOLVED),
    "markup_parse": (parse, None),
    "markup_print": (print_dsl, f"SELECT conv_id, turn, {_BOLD.format(_SAFE, 'b')} || {_BOLD.format(_SAFE, 'i')} AS dsl FROM conversations"),
    "markup_html": (print_html, None),
}
