"""Queries that check texts against their sources, calculations against their inputs, and chunks against sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalog import query
from foliant.operators import calc, chunk, verify
from foliant.plans import star

# every text, with figures that are cut off, scaled, added up, rejected, calculated and made up, against itself with the sources of these
_TOLD = " Revenue was 1,364 and cost 877.4; total 67,566 (1,271 and 66,295); margin 18.1 or 2.54, and 345,678.9 more."
_SOURCE = " 1,364.1 877,433 1,271 66,295"


def _answers(spark, d):
    docs = star.read(spark, d, "documents")
    chunk_ = F.array(F.struct(F.lit(1).alias("id"), F.concat(F.col("text"), F.lit(_SOURCE)).alias("text")))
    return docs.select(F.col("doc_id").alias("id"), F.concat("text", F.lit(_TOLD)).alias("answer"), chunk_.alias("chunks"), F.array(F.lit(2.541)).alias("computed"), F.array(F.struct(F.lit(18.15).alias("value"), F.lit("unit").alias("reason"))).alias("rejected"))


def _plain(c: str) -> str:
    return rf"""lower(trim(regexp_replace(translate({c}, '“”‘’—–', '""''''--'), '\s+', ' ', 'g')))"""


_FINDINGS = rf"""a AS (SELECT doc_id AS id, text || '{_TOLD}' AS answer, text || '{_SOURCE}' AS chunk FROM documents),
z AS (SELECT id, regexp_extract_all(answer, '{verify.NUMBER}') AS m, regexp_split_to_array(answer, '{verify.NUMBER}') AS g FROM a),
y AS (SELECT id, unnest(m) AS found, unnest(g[:len(m)]) AS gap, unnest(range(len(m))) AS nth FROM z),
x AS (SELECT id, found, regexp_replace(found, '\.+$', '') AS raw, CAST(sum(length(gap) + length(found)) OVER (PARTITION BY id ORDER BY nth) - length(found) AS INTEGER) AS start FROM y),
w AS (SELECT *, replace(raw, ',', '') AS plain FROM x),
v AS (SELECT *, TRY_CAST(plain AS DOUBLE) AS v, least(length(regexp_extract(plain, '\.([0-9]*)$', 1)), 15) AS shown FROM w),
f AS (SELECT id, raw, plain, v, 0.5 * pow(10.0, -shown) AS half, v = floor(v) AS whole, min(start) AS start FROM v GROUP BY ALL),
c AS (SELECT f.*, replace(substr(answer, greatest(start - 45, 0) + 1, start + length(raw) + 45 - greatest(start - 45, 0)), chr(10), ' ') AS context FROM f JOIN a USING (id)),
k AS (SELECT *, CASE WHEN regexp_matches(plain, '^(19|20)[0-9]{{2}}$') OR v IS NULL OR (whole AND v < 100) OR regexp_matches(context, 'Item\s+' || replace(raw, '.', '\.') || '\b') THEN 'skipped'
  WHEN abs(18.15 - v) <= 0.1815 THEN 'flagged' WHEN round_even(v, 1) = 2.5 OR round_even(v, 2) = 2.54 THEN 'computed' END AS told FROM c),
t AS (SELECT DISTINCT id, TRY_CAST(t AS DOUBLE) AS s, least(length(regexp_extract(t, '\.([0-9]*)$', 1)), 15) AS shown, contains(t, '.') AS dotted
  FROM (SELECT id, replace(regexp_replace(unnest(regexp_extract_all(chunk, '{verify.NUMBER}')), '\.+$', ''), ',', '') AS t FROM a) WHERE TRY_CAST(t AS DOUBLE) > 0),
e AS (SELECT k.id, raw, bool_or(abs(s - v) <= half OR (whole AND dotted AND floor(s) = v) OR (NOT whole AND shown IN (1, 2) AND abs(s - v) <= 0.5 * pow(10.0, -shown))) AS one,
  bool_or(abs(s / 1e3 - v) <= half OR abs(s / 1e6 - v) <= half OR abs(v * 0.001 - s) <= s * 0.0005 OR abs(v * 0.000001 - s) <= s * 0.0005) AS other FROM k JOIN t ON t.id = k.id AND told IS NULL GROUP BY ALL),
h AS (SELECT k.*, CASE WHEN told = 'computed' OR (told IS NULL AND (one OR other)) THEN 'verified' WHEN told IS NOT NULL THEN told ELSE 'unverified' END AS class,
  CASE WHEN told = 'computed' THEN -1 WHEN told IS NULL AND one THEN 1 WHEN told IS NULL AND other THEN -2 END AS chunk FROM k LEFT JOIN e USING (id, raw)),
p AS (SELECT u.id, u.raw, u.v AS goal, greatest(0.1, abs(u.v) * 0.001) AS reach, n.v AS part, row_number() OVER (PARTITION BY u.id, u.raw ORDER BY v.start) AS i
  FROM h u JOIN v ON v.id = u.id AND v.start >= u.start - 200 AND v.start + length(v.plain) <= u.start + 200 AND v.plain <> u.plain JOIN h n ON n.id = v.id AND n.raw = v.raw AND n.class = 'verified' AND n.told IS NULL WHERE u.class = 'unverified'),
s AS (SELECT *, unnest([part, -part]) AS signed FROM p),
s2 AS (SELECT a.id, a.raw, a.goal, a.reach, a.i AS i, b.i AS j, a.signed + b.signed AS total FROM s a JOIN s b ON a.id = b.id AND a.raw = b.raw AND a.i < b.i),
d AS (SELECT DISTINCT id, raw FROM (SELECT id, raw FROM s2 WHERE abs(total - goal) <= reach UNION ALL SELECT q.id, q.raw FROM s2 q JOIN s ON s.id = q.id AND s.raw = q.raw AND s.i > q.j AND abs(total + signed - q.goal) <= q.reach
  UNION ALL SELECT q.id, q.raw FROM s2 q JOIN s2 r ON r.id = q.id AND r.raw = q.raw AND r.i > q.j AND abs(q.total + r.total - q.goal) <= q.reach)),
number_rows AS (SELECT h.id, 0 AS turn, start, CASE told WHEN 'flagged' THEN 'derivation' WHEN 'computed' THEN 'computed' ELSE 'number' END AS kind, h.raw AS value, CASE WHEN d.raw IS NOT NULL THEN 'underived' ELSE class END AS class, chunk,
  context || CASE WHEN told = 'flagged' THEN ' [a calculation with this result was rejected: unit]' ELSE '' END AS context FROM h LEFT JOIN d ON d.id = h.id AND d.raw = h.raw),
q0 AS (SELECT id, answer, chunk, string_split(replace(replace(answer, '“', '"'), '”', '"'), '"') AS p FROM a),
q1 AS (SELECT id, answer, chunk, unnest(range(1, len(p))) AS i, p FROM q0),
q2 AS (SELECT id, answer, chunk, p[i + 1] AS quote, CAST(list_sum(list_transform(p[:i], lambda y: length(y) + 1)) AS INTEGER) AS start FROM q1 WHERE i % 2 = 1 AND i < len(p) - 1 AND length(p[i + 1]) >= 15 AND len(list_filter(regexp_split_to_array(p[i + 1], '\s+'), lambda y: y <> '')) >= 4),
q3 AS (SELECT id, 1 AS turn, start, 'quote' AS kind, substr(quote, 1, 70) AS value, CASE WHEN contains({_plain('chunk')}, {_plain('quote')}) THEN 'verified' ELSE 'unverified' END AS class, CASE WHEN contains({_plain('chunk')}, {_plain('quote')}) THEN 1 END AS chunk,
  replace(substr(answer, greatest(start - 31, 0) + 1, start + length(quote) + 31 - greatest(start - 31, 0)), chr(10), ' ') AS context FROM q2),
findings AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY turn, start) - 1 AS INTEGER) AS position, kind, value, class, CAST(chunk AS INTEGER) AS chunk, context FROM (SELECT * FROM number_rows UNION ALL SELECT * FROM q3))"""
_CLASSES = ("verified", "unverified", "skipped", "flagged", "underived")


@query(f"WITH {_FINDINGS} SELECT * FROM findings")
def K11_verify(spark, d):
    return verify.verify(_answers(spark, d))


@query(f"WITH {_FINDINGS} SELECT id, value FROM findings WHERE class = 'underived'")
def K8_derived_totals(spark, d):
    return K11_verify(spark, d).where("class = 'underived'").select("id", "value")


@query(f"WITH {_FINDINGS} SELECT id, " + ", ".join(f"count(*) FILTER (WHERE class = '{c}') AS {c}" for c in _CLASSES) + " FROM findings GROUP BY id")
def K13_verdict_counts(spark, d):
    return verify.counts(K11_verify(spark, d))


def _section(title: str, c: str) -> str:
    return f"""CASE WHEN bool_or(class = '{c}') THEN chr(10) || chr(10) || '## {title}' || chr(10) || chr(10) || string_agg('- ' || value || ': ' || context, chr(10) ORDER BY position) FILTER (WHERE class = '{c}') ELSE '' END"""


@query(f"WITH {_FINDINGS}, sections AS (SELECT id, {' || '.join(_section(t, c) for t, c in verify.SECTIONS)} AS said FROM findings GROUP BY id) SELECT doc_id AS id, md5(text || '{_TOLD}' || coalesce(said, '')) AS memo_md5 FROM documents LEFT JOIN sections ON id = doc_id")
def K12_memos(spark, d):
    a = _answers(spark, d)
    return verify.memos(a.select("id", F.col("answer").alias("text"), F.col("chunks")[0]["text"].alias("corpus"), "computed", "rejected")).select("id", F.md5("text").alias("memo_md5"))


# indicator values of a customer, and a sentence that gets some of them wrong; SQL takes its four numbers as they were made
@query("""WITH t AS (SELECT c_custkey AS id, CAST(c_acctbal AS DECIMAL(18,2)) AS b, c_nationkey AS n FROM customer), k AS (SELECT id, [0.5 + n / 100.0, 1.25, CAST(b AS DOUBLE)] AS known, b, n FROM t),
f AS (SELECT id, known, unnest([{'o': 1, 'x': CAST(25 + n % 4 AS DOUBLE), 's': CAST(25 + n % 4 AS VARCHAR) || '% above/below'}, {'o': 2, 'x': CAST(50 + n % 3 AS DOUBLE), 's': CAST(50 + n % 3 AS VARCHAR) || '%'}, {'o': 3, 'x': CAST(b AS DOUBLE), 's': CAST(b AS VARCHAR)}, {'o': 4, 'x': CAST(1000 + n AS DOUBLE), 's': CAST(1000 + n AS VARCHAR)}]) AS f FROM k),
u AS (SELECT id, f.o, f.s FROM f WHERE NOT CASE f.o WHEN 1 THEN len(list_filter(known, lambda v: abs(f.x - (v - 1) * 100) <= greatest(1.0, abs(v) * 2.0))) > 0 WHEN 2 THEN len(list_filter(known, lambda v: abs(f.x / 100 - v) <= greatest(0.01, abs(v) * 0.02))) > 0
  ELSE len(list_filter(known, lambda v: abs(f.x - v) <= greatest(0.5, abs(v) * 0.02))) > 0 END)
SELECT t.id, coalesce(string_agg(u.s, ' ' ORDER BY u.o), '') AS unmatched FROM t LEFT JOIN u USING (id) GROUP BY t.id""")
def K14_indicator_guard(spark, d):
    c = star.read(spark, d, "customer")
    b, n = F.col("c_acctbal").cast("decimal(18,2)"), F.col("c_nationkey")
    text = F.concat(F.lit("over its 50-day average, "), (25 + n % 4).cast("string"), F.lit("% above, "), (50 + n % 3).cast("string"), F.lit("% of the range, at "), b.cast("string"), F.lit(" of "), (1000 + n).cast("string"))
    rows = c.select(F.col("c_custkey").alias("id"), text.alias("text"), F.array(F.lit(0.5) + n / 100.0, F.lit(1.25), b.cast("double")).alias("known"))
    return rows.select("id", F.array_join(verify.unmatched("text", "known"), " ").alias("unmatched"))


# --- calculations -----------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN (o_totalprice + 100) / 2 WHEN 1 THEN -(o_totalprice - 2) * 3 WHEN 2 THEN 2 ** 3 / o_totalprice WHEN 3 THEN o_totalprice * 1000 / 4 END AS result,
CASE WHEN o_orderkey % 6 >= 4 THEN 0 END AS failed_check FROM orders""")
def L1_calculate(spark, d):
    o = star.read(spark, d, "orders")
    v, turn = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_orderkey") % 6
    shapes = {0: ("(", " + 100) / 2"), 1: ("-(", " - 2) * 3"), 2: ("2 ** 3 / ", ""), 3: ("", " / 4"), 4: ("", " / (1 - 1)"), 5: ("max(1, ", ")")}
    text = F.coalesce(*[F.when(turn == k, F.concat(F.lit(a), v, F.lit(b))) for k, (a, b) in shapes.items()])
    unit = F.when(turn == 3, "thousands").otherwise("ones")
    inputs = F.array(F.struct(F.col("o_totalprice").alias("value"), F.lit("x").alias("label"), F.lit("FY").alias("fiscal_period"), F.lit("s").alias("source"), unit.alias("unit")))
    calls = o.select(F.col("o_orderkey").alias("id"), text.alias("expression"), inputs.alias("inputs"), F.array(F.concat(F.lit("price "), v)).alias("outputs"))
    return calc.run_calculations(calls).select("id", "result", "failed_check")


# six ways to go wrong, by order: a multiplier, something undeclared, no unit, not retrieved, another year, too far from its year
@query("""SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN CASE WHEN y <> '1996' AND NOT contains(v, y) THEN 5 END WHEN 5 THEN CASE WHEN NOT contains(v, y) THEN 5 END END AS failed_check
FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS v FROM orders)""")
def L2_objections(spark, d):
    o = star.read(spark, d, "orders")
    v, turn = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey") % 8
    unit = F.when(turn == 2, "dozens").otherwise("ones")
    period = F.when(turn == 6, "last year").otherwise(F.concat(F.lit("FY"), F.year("o_orderdate").cast("string")))
    inputs = F.array(F.struct(F.col("o_totalprice").alias("value"), F.lit("x").alias("label"), period.alias("fiscal_period"), F.lit("s").alias("source"), unit.alias("unit")))
    said = v.cast("string")
    expression = F.when(turn == 0, F.concat(said, F.lit(" * 1000"))).when(turn == 1, F.concat(said, F.lit(" + 17"))).otherwise(F.concat(said, F.lit(" / 12")))
    year = F.when(turn == 4, "1996").otherwise(F.year("o_orderdate").cast("string"))
    told = F.when(turn == 3, "no price").otherwise(F.concat(F.lit("In "), year, F.when(turn == 5, F.repeat(F.lit(" x"), 250)).otherwise(" the price was "), F.when(turn == 7, F.format_number(v, 2)).otherwise(said)))
    return calc.run_calculations(o.select(F.col("o_orderkey").alias("id"), expression.alias("expression"), inputs.alias("inputs"), F.array(F.lit("first"), told).alias("outputs"))).select("id", "failed_check")


# --- chunks -----------------------------------------------------------------------------------------


def _chunked(target: int, overlap: int, least: int, separator: str) -> str:
    """Chunks of documents as sections, whose paragraphs are parted by `separator`: one recursion over the paragraphs, which carries where a chunk began."""
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS total, list_filter(list_transform(string_split(text, {separator}), lambda p: len(list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> ''))), lambda n: n > 0) AS n FROM documents),
p AS (SELECT doc_id, unnest(n) AS n, unnest(range(1, len(n) + 1)) AS i FROM d WHERE total > {target}),
c AS (SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM p),
r(doc_id, i, n, upto, s, k) AS (SELECT doc_id, i, n, upto, CAST(0 AS HUGEINT), 0 FROM c WHERE i = 1
UNION ALL SELECT c.doc_id, c.i, c.n, c.upto, CASE WHEN c.n > {target} OR r.n > {target} THEN r.upto WHEN c.upto - r.s > {target} THEN greatest(r.s, r.upto - {overlap}) ELSE r.s END, CASE WHEN c.n > {target} OR r.n > {target} OR c.upto - r.s > {target} THEN r.k + 1 ELSE r.k END FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i + 1),
g AS (SELECT doc_id, k, max(n) > {target} AS long, max(upto) - min(s) AS t, max(i) AS i FROM r GROUP BY doc_id, k),
w AS (SELECT doc_id, k, long, unnest(CASE WHEN long THEN list_filter(range(0, CAST(t AS BIGINT), {target - overlap}), lambda a: a = 0 OR a + {overlap} < t) ELSE [0] END) AS a, t, i, max(i) OVER (PARTITION BY doc_id) AS last FROM g),
o AS (SELECT doc_id, k, a, CASE WHEN long THEN least({target}, t - a) ELSE t END AS t FROM w WHERE long OR i < last OR t >= {least} UNION ALL SELECT doc_id, 0, 0, total FROM d WHERE total <= {target} AND total >= {least})
SELECT doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, a) - 1 AS INTEGER) AS chunk_index, CAST(t AS INTEGER) AS token_count FROM o"""


@query(_chunked(600, 80, 50, "chr(10)"))
def J3_section_chunks(spark, d):
    docs = star.read(spark, d, "documents")
    s = docs.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("order"), F.array("source").alias("section_path"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))
    return chunk.chunk_sections(s).select("document_id", "chunk_index", "token_count")


@query(_chunked(200, 20, 10, "chr(10) || chr(10)"))
def J4_long_sections(spark, d):
    docs = star.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("order"), F.array("lang").alias("section_path"), F.col("text").alias("content"))
    return chunk.chunk_sections(docs, target=200, overlap=20, least=10).select("document_id", "chunk_index", "token_count")
