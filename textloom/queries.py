"""The operators over a folder of tables, each with its SQL. Relations that the tables lack are derived from them
in the same way on both sides (``views`` and ``WITH``)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import extract, json_keys, scalar, slices
from textloom.operators import graph, ledger, snapshot, symbols
from textloom.sources import jsonl
from textloom import schemas
from textloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    """Epoch milliseconds of a time that is UTC without saying so, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


# Derived relations

V_LEDGER = """v_ledger AS (SELECT event_id, epoch_us(ts) // 1000 AS ts, 'root' || (user_id % 7) AS root, event_type AS tool,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE md5(event_type || coalesce(props, '')) END AS args_hash,
  CAST(floor(value * 10) AS BIGINT) AS chars, CAST(floor(value * 100) AS BIGINT) AS naive_bytes, event_type = 'error' AS failed FROM events),
ledger AS (SELECT *, greatest(0, greatest(1, (naive_bytes + 3) // 4) - greatest(1, (chars + 3) // 4)) AS saved_tokens FROM v_ledger)"""


def v_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hashed = F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(F.md5(F.concat("event_type", F.coalesce("props", F.lit("")))))
    rows = e.select("event_id", millis("ts").alias("ts"), F.concat(F.lit("root"), (F.col("user_id") % 7).cast("string")).alias("root"), F.col("event_type").alias("tool"), hashed.alias("args_hash"), F.floor(F.col("value") * 10).alias("chars"), F.floor(F.col("value") * 100).alias("naive_bytes"), (F.col("event_type") == "error").alias("failed"))
    return rows.withColumn("saved_tokens", scalar.saved_tokens(F.col("naive_bytes"), F.col("chars")))


V_FILES = """v_files AS (SELECT lang || '/' || source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' ELSE '.py' END AS path,
  CAST(strlen(text) AS BIGINT) AS size FROM documents)"""


def v_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".TXT").otherwise(".py")
    return table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("path"), F.octet_length("text").cast("long").alias("size"))


V_SYMBOLS = """v_symbols AS (SELECT p_name AS name, p_brand AS file, CAST(p_partkey AS INT) AS line, p_type AS kind, p_name || ' ' || p_type AS context, CAST(p_size AS INT) AS seq FROM part),
v_sizes AS (SELECT p_brand AS path, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY p_brand),
v_ranks AS (SELECT p_brand AS file, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lineitem) AS rank FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)"""


def v_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_partkey").cast("int").alias("line"), F.col("p_type").alias("kind"), F.concat("p_name", F.lit(" "), "p_type").alias("context"), F.col("p_size").cast("int").alias("seq"))


def v_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("path")).agg(F.sum("p_size").cast("long").alias("size"))


def v_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem").select("l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    counts = line.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("file")).agg(F.sum("n").alias("n"))
    total = line.agg(F.count(F.lit(1)).alias("t"))
    return counts.join(F.broadcast(total)).select("file", (F.col("n").cast("double") / F.col("t")).alias("rank"))  # one row


FK = """fk AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda name, a, x, b, y: table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    return edge("customer", "c", "c_custkey", "n", "c_nationkey").unionAll(edge("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionAll(edge("nation", "n", "n_nationkey", "r", "n_regionkey"))


MULTI = "multi AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


DEGREES = """degrees AS (SELECT file, CAST(sum(i) AS BIGINT) AS indegree, CAST(sum(o) AS BIGINT) AS outdegree FROM
  (SELECT dst AS file, 1 AS i, 0 AS o FROM multi UNION ALL SELECT src, 0, 1 FROM multi) GROUP BY file)"""

# Ledger


@query(f"""WITH {V_LEDGER} SELECT count(*) AS calls, count(*) FILTER (failed) AS failures, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(naive_bytes) AS BIGINT) AS naive_bytes,
CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens, count(*) - count(DISTINCT nullif(args_hash, '')) AS dup_calls,
floor(1000.0 * sum(saved_tokens) / greatest(1, (sum(naive_bytes) + 3) // 4) + 0.5) / 10 AS saved_percent FROM ledger""")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.totals(v_ledger(spark, sf_dir))


@query(f"WITH {V_LEDGER} SELECT count(*) AS calls, count(*) FILTER (failed) AS failures, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(naive_bytes) AS BIGINT) AS naive_bytes, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens, count(*) - count(DISTINCT nullif(args_hash, '')) AS dup_calls, floor(1000.0 * sum(saved_tokens) / greatest(1, (sum(naive_bytes) + 3) // 4) + 0.5) / 10 AS saved_percent FROM ledger WHERE root = 'root3' AND tool = 'click'")
def ledger_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.totals(ledger.filtered(v_ledger(spark, sf_dir), "root3/", "click"))


@query(f"WITH {V_LEDGER} SELECT tool AS key, count(*) AS calls, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens FROM ledger GROUP BY tool")
def ledger_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.grouped(v_ledger(spark, sf_dir), "tool")


@query(f"WITH {V_LEDGER} SELECT root AS key, count(*) AS calls, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens FROM ledger GROUP BY root")
def ledger_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.grouped(v_ledger(spark, sf_dir), "root")


LEDGER_COLUMNS = "event_id, ts, root, tool, args_hash, chars, naive_bytes, saved_tokens, failed"
_LEDGER = LEDGER_COLUMNS.split(", ")


@query(f"WITH {V_LEDGER} SELECT {LEDGER_COLUMNS} FROM ledger ORDER BY ts DESC, event_id DESC LIMIT 50")
def ledger_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest(v_ledger(spark, sf_dir), 50, "ts", "event_id").select(*_LEDGER)


@query(f"WITH {V_LEDGER} SELECT {LEDGER_COLUMNS} FROM ledger ORDER BY ts DESC, event_id DESC OFFSET 50")
def ledger_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.older(v_ledger(spark, sf_dir), 50, "ts", "event_id").select(*_LEDGER)


@query(f"WITH {V_LEDGER}, c AS (SELECT count(*) AS n FROM ledger), r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM ledger) SELECT {LEDGER_COLUMNS} FROM r, c WHERE n < 1000 OR k <= 500")
def ledger_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.retained(v_ledger(spark, sf_dir), 500, "ts", "event_id").select(*_LEDGER)


# Symbols, files, pages


@query(f"WITH {V_SYMBOLS} SELECT * FROM v_symbols WHERE contains(lower(name), 'a red bolt') OR contains('a red bolt', lower(name))")
def symbols_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.matching(v_symbols(spark, sf_dir), "A Red Bolt")


@query(f"WITH {V_SYMBOLS}, k AS (SELECT min(kind) AS kind FROM v_symbols) SELECT v_symbols.* FROM v_symbols JOIN k USING (kind)")
def symbols_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v_symbols(spark, sf_dir)
    kind = rows.agg(F.min("kind")).first()[0]
    return symbols.matching(rows, "", kind)


RANKED = """SELECT s.*, CASE WHEN lower(name) = 'red' THEN 0 WHEN starts_with(lower(name), 'red') THEN 1 ELSE 2 END AS tier, {boost} AS boost, coalesce(rank, 0.0) AS rank
FROM v_symbols s LEFT JOIN v_ranks r ON s.file = r.file WHERE contains(lower(name), 'red') OR contains('red', lower(name))"""
RANK_ORDER = "tier, boost DESC, rank DESC, file, line, seq"
PLACE = f"CAST(row_number() OVER (ORDER BY {RANK_ORDER}) AS BIGINT) AS place"


def _ranked(spark: SparkSession, sf_dir: str, boost: list[str] | None) -> DataFrame:
    """All hits with their place in the order."""
    hits = symbols.matching(v_symbols(spark, sf_dir), "Red")
    rows, order = symbols.with_order(hits, "Red", v_ranks(spark, sf_dir), boost)
    return symbols.numbered(rows, order)


@query(f"WITH {V_SYMBOLS}, r AS ({RANKED.format(boost='false')}) SELECT name, file, line, kind, context, seq, tier, boost, rank, {PLACE} FROM r")
def symbols_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, None)


@query(f"WITH {V_SYMBOLS}, r AS ({RANKED.format(boost="lower(s.file) IN ('brand#2', 'brand#17')")}) SELECT name, file, line, kind, context, seq, tier, boost, rank, {PLACE} FROM r")
def symbols_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, ["brand#2", "brand#17"])


@query(f"WITH {V_SYMBOLS} SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(*) AS files FROM v_sizes WHERE path IN (SELECT file FROM v_symbols WHERE contains(lower(name), 'bolt'))")
def symbols_matched_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.matched_bytes(symbols.matching(v_symbols(spark, sf_dir), "Bolt"), v_sizes(spark, sf_dir))


@query(f"WITH {V_SYMBOLS} SELECT * FROM v_symbols ORDER BY file, line, seq LIMIT 120")
def topk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.page(v_symbols(spark, sf_dir), symbols.with_order(v_symbols(spark, sf_dir), "")[1], 120)[0]


@query(f"WITH {V_SYMBOLS} SELECT * FROM v_symbols ORDER BY file, line, seq OFFSET 120")
def topk_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.page(v_symbols(spark, sf_dir), symbols.with_order(v_symbols(spark, sf_dir), "")[1], 120)[1]


@query(f"WITH {V_SYMBOLS} SELECT file, arg_min(file || ':' || line || ' (' || kind || ') ' || name || ' — ' || context, line) AS context FROM v_symbols GROUP BY file")
def first_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v_symbols(spark, sf_dir).withColumn("seq", F.col("line"))
    return symbols.first_context(rows, scalar.symbol_text(F.col("file"), F.col("line"), F.col("kind"), F.col("name"), F.col("context")))


@query("WITH d AS (SELECT p_brand AS name, p_type AS kind, CAST(p_size AS INT) AS line, CAST(p_partkey AS INT) AS seq FROM part) SELECT name, kind, line, min(seq) AS seq FROM d GROUP BY name, kind, line")
def symbols_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").cast("int").alias("line"), F.col("p_partkey").cast("int").alias("seq"))
    return symbols.deduplicated(rows, ["name", "kind", "line"])


@query(f"WITH {V_FILES} SELECT path, CAST(0 AS BIGINT) AS lines, size FROM v_files WHERE contains(lower(path), 'en/src1')")
def files_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.list_files(v_files(spark, sf_dir), "EN/src1")


@query(f"WITH {V_FILES} SELECT path, size, size <= 2000 AS extract FROM v_files WHERE lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) IN ('.md', '.txt') AND NOT list_has_any(string_split(path, '/')[:-2], ['fr', 'src3'])")
def files_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.admitted(v_files(spark, sf_dir), [".md", ".txt"], ["fr", "src3"], 2000)


@query(f"""WITH {V_FILES}, p AS (SELECT CASE size % 5 WHEN 0 THEN path WHEN 1 THEN '/' || path WHEN 2 THEN replace(path, '/', '//') WHEN 3 THEN '../' || path ELSE replace(path, '/', chr(92)) END AS path FROM v_files)
SELECT path, path <> '' AND NOT contains(path, chr(92)) AND NOT regexp_matches(path, '(^|/)(\\.{{0,2}})(/|$)') AS valid, lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) AS ext, replace(path, chr(92), '/') AS posix, substr(sha1(path), 1, 12) AS hash FROM p""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("size") % 5
    path = F.when(k == 0, F.col("path")).when(k == 1, F.concat(F.lit("/"), "path")).when(k == 2, F.replace("path", F.lit("/"), F.lit("//"))).when(k == 3, F.concat(F.lit("../"), "path")).otherwise(F.translate("path", "/", "\\"))
    rows = v_files(spark, sf_dir).select(path.alias("path"))
    p = F.col("path")
    return rows.select("path", scalar.valid_relative(p).alias("valid"), scalar.extension(p).alias("ext"), scalar.posix(p).alias("posix"), scalar.sha1_prefix(p, 12).alias("hash"))


@query("""SELECT doc_id, greatest(1, (CAST(length(text) AS BIGINT) + 3) // 4) AS tokens, CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS utf16,
CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS last_line FROM documents""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", scalar.tokens(F.length(text)).alias("tokens"), scalar.utf16_length(text).alias("utf16"), scalar.line_of(text, F.length(text)).alias("last_line"))


@query(f"""WITH {V_FILES}, s AS (SELECT path, size FROM v_files WHERE contains(path, 'src7/')), t AS (SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS naive_bytes FROM s),
u AS (SELECT *, greatest(1, (naive_bytes + 3) // 4) AS naive_tokens, CAST(2500 AS BIGINT) AS out_tokens FROM t), w AS (SELECT *, greatest(0, naive_tokens - out_tokens) AS saved_tokens FROM u)
SELECT files, naive_bytes, naive_tokens, out_tokens, saved_tokens, floor(1000.0 * saved_tokens / naive_tokens + 0.5) / 10 AS saved_percent FROM w""")
def token_cost_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = v_files(spark, sf_dir)
    return symbols.cost(files, files.where(F.contains("path", F.lit("src7/"))).select(F.col("path").alias("file")), 10_000)


# Graph


@query(f"WITH {MULTI}, {DEGREES} SELECT * FROM degrees")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = multi(spark, sf_dir)
    return graph.degrees(graph.endpoints(edges), edges)


@query(f"WITH {FK} SELECT * FROM fk WHERE src = 'n3'")
def edges_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, "n3", "out")


@query(f"WITH {FK} SELECT * FROM fk WHERE dst = 'n3'")
def edges_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, "n3", "in")


def _edges(spark: SparkSession, sf_dir: str, file: str, direction: str) -> DataFrame:
    rows = fk(spark, sf_dir).select(F.col("src").alias("from"), F.col("dst").alias("target"), F.lit("resolved").alias("status"), F.lit(1).alias("line"), F.lit(0).alias("seq"))
    return graph.neighbours(rows, file, direction).select(F.col("from").alias("src"), F.col("target").alias("dst"))


@query(f"WITH {MULTI}, {DEGREES} SELECT file, indegree, 0.0::DOUBLE AS rank, '{graph.NO_CONTEXT}' AS context FROM degrees WHERE indegree > 0")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = multi(spark, sf_dir)
    table_ = graph.degrees(graph.endpoints(edges), edges).withColumn("rank", F.lit(0.0))
    return graph.hotspots(table_, spark.createDataFrame([], "file string, context string"))


@query("""SELECT 'c' || c_custkey AS file FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus <> 'F')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file"))
    o = table(spark, sf_dir, "orders").withColumn("src", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    edges = o.where("o_orderdate < '1996-01-01' and o_orderstatus <> 'F'").select("src", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"))
    return graph.orphans(nodes, edges, o.where("o_orderstatus = 'F'").select(F.col("src").alias("file")))


@query(f"""WITH RECURSIVE {FK}, nodes AS (SELECT src AS file FROM fk UNION SELECT dst FROM fk), n AS (SELECT count(*) AS n FROM nodes),
deg AS (SELECT src, count(*) AS d FROM fk GROUP BY src), sh AS (SELECT fk.src, fk.dst, 1.0 / d AS share FROM fk JOIN deg USING (src)),
r1 AS MATERIALIZED (SELECT file, 1.0 / n AS rank FROM nodes, n), dang AS (SELECT file FROM nodes WHERE file NOT IN (SELECT src FROM fk)),
""" + ",\n".join(f"""r{i + 1} AS MATERIALIZED (SELECT nodes.file, 0.85 * (coalesce(f.flow, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE file IN (SELECT file FROM dang)) / n) + 0.15 / n AS rank
FROM nodes CROSS JOIN n LEFT JOIN (SELECT dst, sum(rank * share) AS flow FROM r{i} JOIN sh ON r{i}.file = sh.src GROUP BY dst) f ON nodes.file = f.dst)""" for i in range(1, 9)) + " SELECT file, round(rank, 9) AS rank FROM r9")
def pagerank_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rounds, as SQL needs a fixed number."""
    edges = fk(spark, sf_dir)
    ranks, _, _ = graph.pagerank(graph.endpoints(edges), edges, tol=0.0, most=8)
    return ranks.select("file", F.round("rank", 9).alias("rank"))


@query(None)
def pagerank_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To convergence; tests hold it against a loop in Python."""
    edges = multi(spark, sf_dir)
    ranks, _, _ = graph.pagerank(graph.endpoints(edges), edges)
    return ranks.select("file", F.round("rank", 12).alias("rank"))


# Extraction and resolution

V_SOURCE = """src AS (SELECT s_suppkey AS k, 'lib' || (s_suppkey % 7) || '/f' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.go' END AS path FROM supplier)"""


def v_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s, n = k.cast("string"), (k % 5).cast("string")
    path = F.concat(F.lit("lib"), (k % 7).cast("string"), F.lit("/f"), s, F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".py").otherwise(".go"))
    ts = F.concat(F.lit("import { a }\n  from './f"), (k + 21).cast("string"), F.lit(".js'\nimport x from 'pkg"), n, F.lit("'\n\nexport\n  async function run"), s, F.lit("() {}\nexport class Box"), n, F.lit(" {}\nconst v = require('../../../up')\n"))
    py = F.concat(F.lit("from ..lib"), (k % 7).cast("string"), F.lit(".f"), (k + 21).cast("string"), F.lit(" import a\nimport os\n\nclass Box"), n, F.lit(":\n    async def run"), s, F.lit("(self): pass\n"))
    go = F.concat(F.lit("package a\n\nfunc (b *Box) run"), s, F.lit("() {}\ntype Box"), n, F.lit(" struct {}\n"))
    return table(spark, sf_dir, "supplier").select(path.alias("path"), F.when(k % 3 == 0, ts).when(k % 3 == 1, py).otherwise(go).alias("text"))


@query(f"""WITH {V_SOURCE}, t AS (SELECT k, path, unnest(CASE k % 3
WHEN 0 THEN [{{'name': 'run' || k, 'line': 6, 'kind': 'function', 'seq': 0, 'context': 'export' || chr(10) || '  async function run' || k}}, {{'name': 'Box' || (k % 5), 'line': 7, 'kind': 'class', 'seq': 1, 'context': 'export class Box' || (k % 5)}}, {{'name': 'v', 'line': 8, 'kind': 'const', 'seq': 2, 'context': 'const v ='}}]
WHEN 1 THEN [{{'name': 'run' || k, 'line': 5, 'kind': 'function', 'seq': 0, 'context': 'async def run' || k}}, {{'name': 'Box' || (k % 5), 'line': 4, 'kind': 'class', 'seq': 1, 'context': 'class Box' || (k % 5)}}]
ELSE [{{'name': 'run' || k, 'line': 3, 'kind': 'func', 'seq': 0, 'context': 'func (b *Box) run' || k}}, {{'name': 'Box' || (k % 5), 'line': 4, 'kind': 'type', 'seq': 1, 'context': 'type Box' || (k % 5) || ' struct'}}] END) AS x FROM src)
SELECT x.name AS name, path AS file, CAST(x.line AS INT) AS line, x.kind AS kind, x.context AS context, CAST(x.seq AS INT) AS seq FROM t""")
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.symbols_of(v_source(spark, sf_dir))


@query(f"""WITH {V_SOURCE}, t AS (SELECT k, path, unnest(CASE k % 3
WHEN 0 THEN [{{'s': './f' || (k + 21) || '.js', 'line': 1, 'seq': 0, 'c': 'import {{ a }}', 'st': 'r', 'g': 'lib' || (k % 7) || '/f' || (k + 21) || '.ts'}}, {{'s': 'pkg' || (k % 5), 'line': 3, 'seq': 1, 'c': 'import x from ''pkg' || (k % 5) || '''', 'st': 'external', 'g': ''}}, {{'s': '../../../up', 'line': 8, 'seq': 2, 'c': 'const v = require(''../../../up'')', 'st': 'outside', 'g': ''}}]
WHEN 1 THEN [{{'s': '..lib' || (k % 7) || '.f' || (k + 21), 'line': 1, 'seq': 0, 'c': 'from ..lib' || (k % 7) || '.f' || (k + 21) || ' import a', 'st': 'r', 'g': 'lib' || (k % 7) || '/f' || (k + 21) || '.py'}}, {{'s': 'os', 'line': 2, 'seq': 1, 'c': 'import os', 'st': 'r', 'g': 'os.py'}}] ELSE [] END) AS x FROM src)
SELECT t.path AS "from", x.s AS specifier, CASE WHEN x.st <> 'r' THEN x.st WHEN f.path IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, f.path AS target, coalesce(f.path, x.s) AS "to", CAST(x.line AS INT) AS line, x.c AS context, CAST(x.seq AS INT) AS seq
FROM t LEFT JOIN src f ON x.st = 'r' AND x.g = f.path""")
def extract_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = v_source(spark, sf_dir)
    return extract.resolve(extract.imports_of(files), files)


LINKS = """l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link, unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS seq FROM pages),
paths AS (SELECT DISTINCT substr(regexp_replace(url, '^[a-z]+://[^/]+', ''), 2) AS path FROM pages)"""


@query(f"""WITH {LINKS} SELECT 'p' || page_id || '.ts' AS "from", '.' || link AS specifier, CASE WHEN path IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, path AS target, coalesce(path, '.' || link) AS "to", CAST(seq + 1 AS INT) AS line, link AS context, CAST(seq AS INT) AS seq
FROM l LEFT JOIN paths ON substr(link, 2) = path""")
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as imports of the paths that pages have, all relative to the root."""
    pages = table(spark, sf_dir, "pages")
    found = pages.select(F.col("page_id"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("seq", "link"))
    rows = found.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".ts")).alias("from"), F.concat(F.lit("."), "link").alias("specifier"), (F.col("seq") + 1).alias("line"), F.col("link").alias("context"), "seq")
    files = pages.select(F.substring(F.regexp_replace("url", r"^[a-z]+://[^/]+", ""), 2, 1 << 30).alias("path"))
    return extract.resolve(extract.with_candidates(rows), files)


SHAPES = ["./u" , "../q/k.js", "@/x", "pkg", "/up", "..", "./dir", "./w.mjs", "../../../far", "#a"]


@query("""WITH e AS (SELECT r_regionkey AS k, 'a/b' || r_regionkey || '/f.ts' AS f FROM region), t AS (SELECT f, unnest([
{'s': './u', 'st': 'resolved', 'g': 'a/b' || k || '/u.ts'}, {'s': '../q/k.js', 'st': 'resolved', 'g': 'a/q/k.ts'}, {'s': '@/x', 'st': 'unresolved', 'g': NULL}, {'s': 'pkg', 'st': 'external', 'g': NULL},
{'s': '/up', 'st': 'outside', 'g': NULL}, {'s': '..', 'st': 'resolved', 'g': 'a/index.ts'}, {'s': './dir', 'st': 'resolved', 'g': 'a/b' || k || '/dir/index.js'}, {'s': './w.mjs', 'st': 'resolved', 'g': 'a/b' || k || '/w.mts'},
{'s': '../../../far', 'st': 'outside', 'g': NULL}, {'s': '#a', 'st': 'unresolved', 'g': NULL}]) AS x FROM e) SELECT f AS "from", x.s AS specifier, x.st AS status, x.g AS target FROM t""")
def resolve_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of a specifier: relative, by counterpart, aliased, external, absolute, folders, beyond the root."""
    k = F.col("r_regionkey").cast("string")
    regions = table(spark, sf_dir, "region")
    rows = regions.select(F.concat(F.lit("a/b"), k, F.lit("/f.ts")).alias("from"), F.posexplode(F.array(*map(F.lit, SHAPES))).alias("seq", "specifier")).withColumns({"line": F.lit(1), "context": F.lit("")})
    here = [F.concat(F.lit("a/b"), k, F.lit(x)) for x in ("/u.ts", "/u.js", "/dir/index.js", "/w.mts", "/w.cts")]
    files = regions.select(F.explode(F.array(*here, F.lit("a/q/k.ts"), F.lit("a/q/k.jsx"), F.lit("a/index.ts"))).alias("path"))
    return extract.resolve(extract.with_candidates(rows), files).select("from", "specifier", "status", "target")


@query("""SELECT name, file, CAST(line AS INT) AS line, kind, context, CAST(seq AS INT) AS seq FROM (SELECT unnest([
{'name': 'run' || r_regionkey, 'file': 'r' || r_regionkey || '.rs', 'line': 1, 'kind': 'fn', 'context': 'pub(crate) async fn run' || r_regionkey, 'seq': 0}, {'name': 'Box' || r_regionkey, 'file': 'r' || r_regionkey || '.rs', 'line': 2, 'kind': 'type', 'context': 'pub struct Box' || r_regionkey, 'seq': 1},
{'name': 'K', 'file': 'r' || r_regionkey || '.rs', 'line': 3, 'kind': 'type', 'context': 'enum K', 'seq': 2}, {'name': 'go' || r_regionkey, 'file': 'r' || r_regionkey || '.kt', 'line': 1, 'kind': 'function', 'context': 'private static function go' || r_regionkey, 'seq': 0},
{'name': 'C', 'file': 'r' || r_regionkey || '.kt', 'line': 2, 'kind': 'class', 'context': 'abstract class C', 'seq': 1}, {'name': 'T' || r_regionkey, 'file': 'r' || r_regionkey || '.tsx', 'line': 1, 'kind': 'type', 'context': 'export type T' || r_regionkey || ' =', 'seq': 0},
{'name': 'I', 'file': 'r' || r_regionkey || '.tsx', 'line': 2, 'kind': 'interface', 'context': 'interface I', 'seq': 1}]) AS x FROM region) t(x), LATERAL (SELECT x.name AS name, x.file AS file, x.line AS line, x.kind AS kind, x.context AS context, x.seq AS seq)""")
def extract_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rust, families without patterns of their own, and the type forms of the script family."""
    k = F.col("r_regionkey").cast("string")
    file = lambda end, *text: F.struct(F.concat(F.lit("r"), k, F.lit(end)).alias("path"), F.concat(*text).alias("text"))
    files = F.array(
        file(".rs", F.lit("pub(crate) async fn run"), k, F.lit("() {}\npub struct Box"), k, F.lit(";\n  enum K { }\n")),
        file(".kt", F.lit("private static function go"), k, F.lit("() {}\n\tabstract class C {}\n")),
        file(".tsx", F.lit("export type T"), k, F.lit(" = string\ninterface I { }\n")),
    )
    return extract.symbols_of(table(spark, sf_dir, "region").select(F.explode(files).alias("x")).select("x.*"))


# Snapshots and history

SNAPSHOT = """prev AS (SELECT o_orderkey AS path, CAST(o_totalprice AS DOUBLE) AS mtime_ms, o_custkey AS size, o_orderkey % 50 = 0 AS pending FROM orders WHERE o_orderkey % 10 <> 1),
cur AS (SELECT o_orderkey AS path, CAST(o_totalprice AS DOUBLE) AS mtime_ms, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size FROM orders WHERE o_orderkey % 10 <> 2),
d AS (SELECT CAST(coalesce(cur.path, prev.path) AS VARCHAR) AS path, CASE WHEN prev.path IS NULL THEN 'added' WHEN cur.path IS NULL THEN 'dropped' WHEN pending OR prev.size <> cur.size OR prev.mtime_ms <> cur.mtime_ms THEN 'changed' ELSE 'unchanged' END AS state,
coalesce(cur.mtime_ms, prev.mtime_ms) AS mtime_ms, coalesce(cur.size, prev.size) AS size FROM prev FULL JOIN cur ON prev.path = cur.path)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").cast("double").alias("mtime_ms"), F.col("o_custkey").alias("size"))
    previous = o.where("k % 10 <> 1").select("path", "mtime_ms", "size", (F.col("k") % 50 == 0).alias("pending"))
    current = o.where("k % 10 <> 2").select("path", "mtime_ms", (F.col("size") + F.when(F.col("k") % 7 == 0, 1).otherwise(0)).alias("size"))
    return snapshot.diff(previous, current)


@query(f"WITH {SNAPSHOT} SELECT * FROM d")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir)


@query(f"WITH {SNAPSHOT} SELECT CAST(coalesce(sum(size) FILTER (state IN ('added', 'changed')), 0) AS BIGINT) AS scanned_bytes, count(*) FILTER (state IN ('added', 'changed')) AS rescanned, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'dropped') AS dropped, count(*) FILTER (state <> 'dropped') AS total_files FROM d")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.report(_snapshots(spark, sf_dir))


@query(f"""WITH {SNAPSHOT} SELECT CAST(l_orderkey AS VARCHAR) AS file, CAST(l_linenumber AS INT) AS line, CASE WHEN state = 'unchanged' THEN 'old' ELSE 'new' END AS origin
FROM lineitem JOIN d ON CAST(l_orderkey AS VARCHAR) = d.path WHERE state <> 'dropped'""")
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _snapshots(spark, sf_dir)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").cast("int").alias("line"))
    read = states.where("state in ('added', 'changed')").select(F.col("path").alias("file"))
    return snapshot.merged(rows.withColumn("origin", F.lit("old")), rows.join(read, "file", "left_semi").withColumn("origin", F.lit("new")), states, "file")


V_HISTORY = """h AS (SELECT epoch_ms(date_trunc('day', ts)) AS ts, event_type AS root, CAST(sum(floor(value * 100)) AS BIGINT) AS scanned_bytes, count(*) AS rescanned, count(DISTINCT user_id) AS symbols, count(DISTINCT props) AS imports FROM events GROUP BY 1, 2)"""
HISTORY_COUNTERS = ["scanned_bytes", "rescanned", "symbols", "imports"]


def v_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", millis("ts") - F.pmod(millis("ts"), F.lit(86_400_000)))
    return e.groupBy(F.col("day").alias("ts"), F.col("event_type").alias("root")).agg(F.sum(F.floor(F.col("value") * 100)).alias("scanned_bytes"), F.count(F.lit(1)).alias("rescanned"), F.countDistinct("user_id").alias("symbols"), F.countDistinct("props").alias("imports"))


@query(f"WITH {V_HISTORY} SELECT * FROM h WHERE root = 'click' ORDER BY ts DESC LIMIT 10")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest(ledger.of_root(v_history(spark, sf_dir), "click"), 10, "ts")


@query(f"""WITH {V_HISTORY}, l AS (SELECT * FROM h WHERE root = 'click' ORDER BY ts DESC LIMIT 10), r AS (SELECT *, row_number() OVER (ORDER BY ts DESC) AS k, count(*) OVER () AS n FROM l)
SELECT {", ".join(f"CAST(coalesce(max({c}) FILTER (k = 1) - max({c}) FILTER (k = 2), 0) AS BIGINT) AS {c}_delta" for c in HISTORY_COUNTERS)}, max(n) AS window_count FROM r""")
def history_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.trend(ledger.of_root(v_history(spark, sf_dir), "click"), HISTORY_COUNTERS, 10, "ts")


@query(f"""WITH {V_HISTORY}, l AS (SELECT * FROM h ORDER BY ts DESC, root DESC LIMIT 200), r AS (SELECT *, sum(scanned_bytes) OVER (ORDER BY ts DESC, root DESC) AS s, row_number() OVER (ORDER BY ts DESC, root DESC) AS k FROM l)
SELECT ts, root, scanned_bytes, rescanned, symbols, imports FROM r WHERE k = 1 OR s <= 1048576""")
def history_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.retained_bytes(v_history(spark, sf_dir), 200, 1 << 20, "scanned_bytes", "ts", "root")


@query("""WITH l AS (SELECT event_id % 9 AS k FROM events), n AS (SELECT count(*) FILTER (k NOT IN (1, 2, 3, 4)) AS rows, count(*) FILTER (k IN (1, 2, 3)) AS corrupt FROM l) SELECT rows, corrupt FROM n""")
def jsonl_corrupt_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made from events: whole, cut short, without a field, of a wrong type, and blank."""
    k = F.col("event_id") % 9
    good = F.to_json(F.struct(millis("ts").alias("ts"), F.col("event_type").alias("tool"), F.floor("value").alias("chars"), F.floor("value").alias("naive_bytes"), F.floor("value").alias("saved_tokens")))
    line = F.when(k == 1, F.substring(good, 1, 20)).when(k == 2, F.regexp_replace(good, '"ts":[0-9]+,', "")).when(k == 3, F.regexp_replace(good, '"chars":[0-9]+', '"chars":"x"')).when(k == 4, F.lit("  ")).otherwise(good)
    rows, corrupt = jsonl.parsed(table(spark, sf_dir, "events").select(line.alias("value")), schemas.LEDGER, ["ts", "tool", "chars", "naive_bytes", "saved_tokens"])
    one = rows.agg(F.count(F.lit(1)).alias("rows"))
    return one.crossJoin(corrupt.agg(F.count(F.lit(1)).alias("corrupt")))  # a row each


# Bytes and JSON

#: Limits that end no scan of a whole table's texts, whatever the machine does beside it.
NO_LIMIT = {"budget_ms": 1 << 31}
WHOLE = {"max_scan_bytes": 1 << 40, "max_time_ms": 60_000}

BYTES = """b AS (SELECT doc_id, text, encode(text) AS d, strlen(text) AS total FROM documents)"""


def _forward(at: str) -> str:
    inside = lambda k: f"hex(d[({at}) + 1 + {k}:({at}) + 1 + {k}]) BETWEEN '80' AND 'BF'"
    return f"least(total, ({at}) + CASE WHEN NOT {inside(0)} THEN 0 WHEN NOT {inside(1)} THEN 1 WHEN NOT {inside(2)} THEN 2 ELSE 3 END)"


def _window_sql(asked: str, length: int) -> str:
    return f"""WITH {BYTES}, s AS (SELECT *, {asked} AS asked FROM b), t AS (SELECT *, {_forward('asked')} AS byte_offset FROM s), u AS (SELECT *, {_forward(f'least(total, byte_offset + {length})')} AS next_offset FROM t)
SELECT doc_id, CAST(byte_offset AS BIGINT) AS byte_offset, CAST(next_offset - byte_offset AS BIGINT) AS length_bytes, CAST(total AS BIGINT) AS total_bytes, CASE WHEN next_offset = byte_offset THEN '' ELSE decode(d[byte_offset + 1:next_offset]) END AS snippet, CAST(next_offset AS BIGINT) AS next_offset, next_offset < total AS may_truncate, byte_offset <> asked OR next_offset - byte_offset > {length} AS range_adjusted FROM u"""


def _window(spark: SparkSession, sf_dir: str, start: int, length: int, tail: bool) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return docs.select("doc_id", slices.window_columns(F.col("data"), F.lit(start).cast("long"), F.lit(length).cast("long"), tail).alias("w")).select("doc_id", "w.*")


@query(_window_sql("least(101, total)", 257))
def slice_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window(spark, sf_dir, 101, 257, False)


@query(_window_sql("greatest(0, total - 333)", 333))
def slice_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window(spark, sf_dir, 0, 333, True)


@query("SELECT doc_id, text AS joined, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def slice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that begin at every 1000th byte moved forward join up to the whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    pieces = slices.paged(docs, 1000).groupBy(F.col("id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("page", "piece"))).alias("p"))  # of one text
    joined = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return pieces.select("doc_id", joined.alias("joined"), F.octet_length(joined).cast("long").alias("bytes"))


@query(_window_sql("least(1000000000, total)", 100))
def slice_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start beyond the end is the end."""
    return _window(spark, sf_dir, 1_000_000_000, 100, False)


@query(f"""WITH {BYTES}, h AS (SELECT *, CASE WHEN strpos(lower(text), 'the') > 0 THEN strlen(left(text, strpos(lower(text), 'the') - 1)) END AS hit FROM b), s AS (SELECT *, CASE WHEN hit IS NULL THEN 0 ELSE greatest(0, hit - 16) END AS asked FROM h),
t AS (SELECT *, {_forward('asked')} AS byte_offset FROM s), u AS (SELECT *, {_forward('least(total, byte_offset + 64)')} AS stop FROM t)
SELECT doc_id AS id, CAST(byte_offset AS BIGINT) AS byte_offset, CAST(stop - byte_offset AS BIGINT) AS length_bytes, CASE WHEN stop = byte_offset THEN '' ELSE decode(d[byte_offset + 1:stop]) END AS snippet, CASE WHEN hit IS NULL THEN 'not_found' ELSE 'matched' END AS status FROM u""")
def slice_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window around a hit, with 16 bytes before it."""
    return slices.slices_around(table(spark, sf_dir, "documents"), "THE", 16, 64, budget_ms=slices.MOST_BUDGET_MS)


@query("""SELECT doc_id AS id, CASE WHEN strlen(text) > 700 THEN 'byte_budget' ELSE 'not_found' END AS status, strlen(text) <= 700 AS complete FROM documents""")
def literal_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that its bytes end."""
    return slices.search_texts(table(spark, sf_dir, "documents"), "no such words", most=700, **NO_LIMIT).select("id", "status", "complete")


@query("""WITH f AS (SELECT doc_id, text, strpos(lower(text), 'the') AS pos FROM documents)
SELECT doc_id AS id, CASE WHEN pos > 0 THEN CAST(strlen(left(text, pos - 1)) AS BIGINT) END AS hit_byte, CASE WHEN pos > 0 THEN 'matched' ELSE 'not_found' END AS status, pos = 0 AS complete FROM f""")
def literal_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.search_texts(table(spark, sf_dir, "documents"), "ThE", most=1 << 40, **NO_LIMIT).select("id", "hit_byte", "status", "complete")


@query("""WITH f AS (SELECT doc_id, text, regexp_extract(text, '(?s)^(.*?)[0-9]{2,}', 1) AS before, regexp_matches(text, '[0-9]{2,}') AS hit FROM documents)
SELECT doc_id AS id, CASE WHEN hit THEN CAST(strlen(before) AS BIGINT) END AS hit_byte, CASE WHEN hit THEN 'matched' ELSE 'not_found' END AS status, NOT hit AS complete FROM f""")
def regex_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.search_texts(table(spark, sf_dir, "documents"), "[0-9]{2,}", regex=True, most=1 << 40, **NO_LIMIT).select("id", "hit_byte", "status", "complete")


@query("""WITH k AS (SELECT event_id AS id, props, unnest(json_keys(props)) AS key, unnest(range(len(json_keys(props)))) AS ordinal FROM events)
SELECT id, CAST(ordinal AS INT) AS ordinal, key, 'complete' AS validation, CAST(len(json_keys(props)) AS BIGINT) AS total_keys FROM k""")
def json_key_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_keys.json_keys(table(spark, sf_dir, "events"), "event_id", "props", **WHOLE).select("id", "ordinal", "key", "validation", "total_keys")


@query("""WITH v AS (SELECT event_id AS id, props, regexp_extract(props, '^(\\{"[a-z]+": *)', 1) AS head, regexp_extract(props, '^\\{"[a-z]+": *([^,}]*)', 1) AS val FROM events)
SELECT id, CAST(strlen(head) AS BIGINT) AS byte_start, CAST(strlen(head) + strlen(val) AS BIGINT) AS byte_end, val AS preview FROM v""")
def json_value_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_keys.json_keys(table(spark, sf_dir, "events"), "event_id", "props", **WHOLE).where("ordinal = 0").select("id", "byte_start", "byte_end", "preview")


# Hashes and rules


def per_row(rows: DataFrame, schema: str, work: Callable[[dict], tuple]) -> DataFrame:
    """The library's plain functions over rows, a batch at a time."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            got = [work(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], kinds[i]) for i in range(len(names))], names)

    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]
    prepare(rows.sparkSession)
    return rows.mapInArrow(run, schema)


@query("""SELECT event_id, substr(sha1('find|root' || (user_id % 7) || '|{"kind":"' || event_type || '","limit":120,"name":"u' || user_id || '"}'), 1, 16) AS hash FROM events""")
def args_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of effective arguments: defaults filled in, irrelevant ones gone, keys sorted."""

    def hashed(r: dict) -> tuple:
        given = {"name": f"u{r['user_id']}", "limit": None, "trace": r["event_id"], "kind": r["event_type"]}
        return r["event_id"], scalar.args_hash("find", f"root{r['user_id'] % 7}", scalar.effective_args(given, {"limit": 120}, {"kind", "limit", "name"}))

    return per_row(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id long, hash string", hashed)


@query("""SELECT n_nationkey, sha256('{"context":240,"exts":[".' || lower(n_name) || '",".ts"],"parser":"p","scan":' || (1024 * (n_nationkey + 1)) || ',"skip":["dist"]}') AS fingerprint FROM nation""")
def config_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of options that are given in any order and case, with blanks and repeats."""
    work = lambda r: (r["n_nationkey"], scalar.fingerprint("p", [".ts", f" {r['n_name'].upper()} ", "ts", ""], ["dist ", "", "dist"], 1024 * (r["n_nationkey"] + 1), 240))
    return per_row(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey int, fingerprint string", work)


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang || '/' || doc_id WHEN 1 THEN source WHEN 2 THEN NULL WHEN 3 THEN 'Up/' || lang ELSE lang END AS inside, CASE doc_id % 5 WHEN 0 THEN lower(lang) || '/' || doc_id WHEN 1 THEN lower(source) WHEN 2 THEN NULL WHEN 3 THEN 'up/' || lower(lang) ELSE lower(lang) END AS boosted FROM documents""")
def inside_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute and relative paths, of either slash, with dots, relative to the root; none outside it."""

    def told(r: dict) -> tuple:
        given = [f"{r['lang']}\\{r['doc_id']}", f"/r/a/./{r['source']}", "../a2/x", f"/r/b/../a/Up/{r['lang']}", f"x/../{r['lang']}/"][r["doc_id"] % 5]
        return r["doc_id"], scalar.inside_root("/r/a", given), next(iter(scalar.boost_paths("/r/a", [given])), None)

    return per_row(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id long, inside string, boosted string", told)


@query("""SELECT n_nationkey, substr(sha1('/r/' || n_name), 1, 12) AS hash FROM nation""")
def root_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of an absolute root, however it is spelt."""
    return per_row(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey int, hash string", lambda r: (r["n_nationkey"], scalar.root_hash(f"/r/x/../{r['n_name']}/")))


def _padded(secret: bytes, byte: int) -> str:
    return "unhex('" + bytes(x ^ byte for x in secret.ljust(64, b"\0")).hex() + "')"


@query(f"""SELECT event_id, sha256({_padded(b'secret', 0x5C)} || unhex(sha256({_padded(b'secret', 0x36)} || encode(props)))) AS signature FROM events""")
def cursor_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_row(table(spark, sf_dir, "events").select("event_id", "props"), "event_id long, signature string", lambda r: (r["event_id"], scalar.signature(b"secret", r["props"].encode()).hex()))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 3) THEN 'refused' ELSE CAST(CASE doc_id % 4 WHEN 1 THEN 40 ELSE doc_id % 1000 + 1 END AS VARCHAR) END AS "limit" FROM documents""")
def limits_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits: the default, a whole number, one beyond the most, and none at all."""

    def told(r: dict) -> tuple:
        k = r["doc_id"]
        try:
            return k, str(scalar.positive([0, None, k % 1000 + 1, 1001 + k][k % 4], 40, "limit", 1000))
        except ValueError:
            return k, "refused"

    return per_row(table(spark, sf_dir, "documents").select("doc_id"), "doc_id long, limit string", told)


JSON_TEXTS = """j AS (SELECT event_id AS id, '{"a": ' || event_id || ', "who":"u' || user_id || '" ,' || chr(10) || ' "b": [1,{"x":2}], "type":"' || event_type || '"}' AS t, '{"a": ' || event_id || ', "who":"u' || user_id || '" ,' || chr(10) || ' "b": ' AS h FROM events)"""


def _json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit('{"a": '), s("event_id"), F.lit(', "who":"u'), s("user_id"), F.lit('" ,\n "b": [1,{"x":2}], "type":"'), "event_type", F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query(f"""WITH {JSON_TEXTS} SELECT id, CAST(x AS INT) AS ordinal, CASE x WHEN 0 THEN 'b' ELSE 'type' END AS key, CAST(CASE x WHEN 0 THEN strlen(h) ELSE strlen(h) + 20 END AS BIGINT) AS byte_start, CAST(CASE x WHEN 0 THEN strlen(h) + 11 ELSE strlen(t) - 1 END AS BIGINT) AS byte_end,
CASE x WHEN 0 THEN '[1,{{"x…' ELSE left(substr(t, length(h) + 21, length(t) - length(h) - 21), 6) || CASE WHEN length(t) - length(h) - 21 > 6 THEN '…' ELSE '' END END AS preview, 'complete' AS validation, CAST(4 AS BIGINT) AS total_keys FROM j, (SELECT unnest([0, 1]) AS x)""")
def json_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that a cursor leads to, with previews cut short."""
    return json_keys.json_keys(_json_texts(spark, sf_dir), "event_id", "text", page_number=1, limit=2, max_preview=6, max_time_ms=60_000)


@query(f"""WITH {JSON_TEXTS} SELECT id, CAST(x AS INT) AS ordinal, CASE x WHEN 0 THEN 'a' ELSE 'who' END AS key, 'incomplete' AS validation, CAST(NULL AS BIGINT) AS total_keys FROM j, (SELECT unnest([0, 1]) AS x)""")
def json_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page that ends before the text does tells nothing of the rest."""
    return json_keys.json_keys(_json_texts(spark, sf_dir), "event_id", "text", page_number=0, limit=2, max_time_ms=60_000).select("id", "ordinal", "key", "validation", "total_keys")


@query("""SELECT event_id AS id, CAST(CASE WHEN event_id % 7 IN (3, 4, 5) THEN 0 END AS INT) AS ordinal, CASE WHEN event_id % 7 IN (3, 4, 5) THEN 'a' END AS key, CASE WHEN event_id % 7 < 3 THEN 'complete' WHEN event_id % 7 = 5 THEN 'budget_exhausted' ELSE 'invalid' END AS validation FROM events""")
def json_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots that are no object, broken texts, and one deeper than its budget."""
    texts = ["[1, {}]", "17", '"s"', '{"a":1}x', '{"a":1, "b":01}', '{"a":1, "b":[[[[1]]]]}', '{"a" 1}']
    k = F.col("event_id") % 7
    text = F.element_at(F.array(*map(F.lit, texts)), (k + 1).cast("int"))
    return json_keys.json_keys(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "event_id", "text", max_depth=4, max_time_ms=60_000).select("id", "ordinal", "key", "validation")


EDGES_SQL = """edge_rows AS (SELECT src AS "from", CASE WHEN hash_kind = 0 THEN NULL ELSE dst END AS target, CASE WHEN hash_kind = 0 THEN 'external' ELSE 'resolved' END AS status, dst FROM (SELECT *, length(src) % 4 AS hash_kind FROM fk))"""


def _edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = F.length("src") % 4 == 0
    return fk(spark, sf_dir).select(F.col("src").alias("from"), F.col("dst").alias("specifier"), F.when(outer, "external").otherwise("resolved").alias("status"), F.when(~outer, F.col("dst")).alias("target"), F.col("dst").alias("to"), F.lit(7).alias("line"), F.lit("ctx").alias("context"), F.lit(0).alias("seq"))


@query(f"""WITH {FK}, {EDGES_SQL}, nodes AS (SELECT src AS file FROM fk UNION SELECT dst FROM fk UNION SELECT 'p' || p_partkey FROM part), r AS (SELECT * FROM edge_rows WHERE status = 'resolved'),
i AS (SELECT target AS file, count(*) AS n FROM r GROUP BY 1), o AS (SELECT "from" AS file, count(*) AS n FROM r GROUP BY 1), u AS (SELECT DISTINCT "from" AS file FROM edge_rows WHERE status <> 'resolved')
SELECT file, coalesce(i.n, 0) AS indegree, coalesce(o.n, 0) AS outdegree, u.file IS NOT NULL AS uncertain, i.n IS NULL AND o.n IS NULL AND u.file IS NULL AS is_orphan FROM (SELECT nodes.file FROM nodes) n LEFT JOIN i USING (file) LEFT JOIN o USING (file) LEFT JOIN u USING (file)""".replace("u.file IS NOT NULL", "u.k").replace("u.file IS NULL", "NOT coalesce(u.k, false)").replace("u.k AS uncertain", "coalesce(u.k, false) AS uncertain").replace('u AS (SELECT DISTINCT "from" AS file FROM', 'u AS (SELECT DISTINCT "from" AS file, true AS k FROM'))
def graph_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of an index: degrees, uncertain files and orphans (ranks are in pagerank_fk)."""
    edges = _edge_rows(spark, sf_dir)
    files = edges.select(F.col("from").alias("path")).union(edges.select("to")).union(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))))
    return graph.build_graph(files, edges)[0].drop("rank")


@query(f"""WITH {FK} SELECT src AS file, min(src || ':7 → ' || dst || ' — ctx') AS context FROM fk GROUP BY src""")
def edge_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context that a file without symbols has: that of its first import."""
    rows = _edge_rows(spark, sf_dir).withColumn("file", F.col("from"))
    return symbols.first_context(rows, scalar.edge_text(F.col("from"), F.col("line"), F.col("to"), F.col("context")))


@query(f"""WITH {V_SYMBOLS}, known AS (SELECT path FROM v_sizes WHERE path NOT LIKE '%1') SELECT v_symbols.* FROM v_symbols WHERE file IN (SELECT path FROM known)""")
def symbols_of_known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.of_known_files(v_symbols(spark, sf_dir), v_sizes(spark, sf_dir).where("path not like '%1'"))


@query(f"""WITH {V_FILES} SELECT path, size FROM v_files WHERE size % 13 = 0""")
def files_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.pending(v_files(spark, sf_dir).withColumn("pending", F.when(F.col("size") % 13 == 0, True).when(F.col("size") % 13 == 1, False)))


@query(f"""WITH {V_HISTORY} SELECT ts, root, CASE WHEN rescanned % 5 = 0 THEN 0 ELSE CAST(greatest(0, 1000000000000 - ts) AS BIGINT) END AS stale_ms FROM h""")
def index_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.when(F.col("rescanned") % 5 != 0, F.col("ts"))
    return v_history(spark, sf_dir).select("ts", "root", snapshot.staleness(seen, F.lit(1_000_000_000_000).cast("long")).alias("stale_ms"))


@query("""WITH bad AS (SELECT 'file' AS rule, count(*) FILTER (p_partkey % 40 = 0) AS rows FROM part UNION ALL SELECT 'symbol', count(*) FILTER (p_partkey % 50 = 0) FROM part
UNION ALL SELECT 'edge_target', count(*) FILTER (p_partkey % 60 = 0) FROM part) SELECT rule, rows FROM bad WHERE rows > 0""")
def row_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey").cast("string"))
    path = F.concat(F.lit("d/"), "k")
    files = p.select(F.when(F.col("p_partkey") % 40 == 0, F.concat(F.lit("d/../"), "k")).otherwise(path).alias("path"), F.lit(1.0).alias("mtime_ms"), F.lit(1).cast("long").alias("size"))
    found = p.select(F.when(F.col("p_partkey") % 50 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 40 == 0, F.concat(F.lit("d/../"), "k")).otherwise(path).alias("file"), F.lit(1).alias("line"))
    edges = p.select(F.lit("external").alias("status"), F.lit(None).cast("string").alias("target"), F.when(F.col("p_partkey") % 60 == 0, "other").otherwise(F.lit("pkg")).alias("to"), F.lit("pkg").alias("specifier"))
    return snapshot.violations(files, found, edges)


@query(f"""WITH {V_FILES}, {V_SYMBOLS}, {FK} SELECT (SELECT count(*) FROM v_files) AS files, (SELECT count(*) FROM v_files WHERE size % 13 = 0) AS pending_files, (SELECT count(*) FROM v_symbols) AS symbols, (SELECT count(*) FROM fk) AS imports, false AS consistent""")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of an index; its symbols and edges are not of its files, so it is not consistent."""
    files = v_files(spark, sf_dir).withColumns({"pending": F.col("size") % 13 == 0, "mtime_ms": F.lit(1.0)})
    return snapshot.status(files, v_symbols(spark, sf_dir), _edge_rows(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked symbol search whose ranks are PageRank over the line items' suppliers and brands."""
    line, part = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    edges = line.join(part, "l_partkey").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.col("p_brand").alias("dst"))
    ranks, _, _ = graph.pagerank(graph.endpoints(edges), edges)
    rows, order = symbols.with_order(symbols.matching(v_symbols(spark, sf_dir), "red"), "red", ranks)
    return symbols.page(rows, order, 120)[0]
