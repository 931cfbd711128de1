"""Queries of the text operators, over filings made from orders, conversations, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import text as T
from .registry import Registry

R = Registry()
#: Excerpts of the report scan: places from the lengths of what stands between matches and of the matches.
EXCERPTS = """WITH p(family, k, pat, before, after, most) AS (VALUES {}), x AS (SELECT doc_id, text, lower(text) AS low FROM filings),
m AS (SELECT doc_id, text, p.*, regexp_split_to_array(low, pat) AS pieces, regexp_extract_all(low, pat) AS found FROM x CROSS JOIN p WHERE regexp_matches(low, pat)),
e AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (SELECT *, CAST(list_sum(list_transform(pieces[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda z: length(z))), 0) AS INTEGER) AS spot FROM e),
o AS (SELECT doc_id, family, most, row_number() OVER (PARTITION BY doc_id, family ORDER BY k, i) - 1 AS place,
  regexp_replace(substr(text, greatest(spot - before, 0) + 1, CAST(spot + length(found[i]) + after - greatest(spot - before, 0) AS INTEGER)), '^\\s+|\\s+$', '', 'g') AS excerpt FROM s)
SELECT doc_id, family, place, excerpt FROM o WHERE place < most""".replace("{}", ", ".join(f"('{n}', {k}, '{p}', {T.WINDOWS[n][0]}, {T.WINDOWS[n][1]}, {T.WINDOWS[n][2]})" for n, ps in T.FAMILIES.items() for k, p in enumerate(ps)))


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def count_sql(words, text="text"):
    low = f"lower(coalesce({text}, ''))"
    return " + ".join(f"(length({low}) - length(replace({low}, '{w}', ''))) // {len(w)}" for w in words)


TONE = f"""SELECT *, coalesce((pos - neg)/nullif(pos + neg, 0)::DOUBLE, 0) AS score, coalesce(confident/nullif(confident + hedging, 0)::DOUBLE, 0.5) AS confidence
FROM (SELECT *, {count_sql(T.POSITIVE)} AS pos, {count_sql(T.NEGATIVE)} AS neg, {count_sql(T.CONFIDENT)} AS confident, {count_sql(T.HEDGING)} AS hedging FROM {{}})"""
R.add(
    "tx_01_transcript_tone",
    "conv_id turn pos# neg# score~ confidence~",
    lambda t: T.tone(t.table("conversations")),
    TONE.format("conversations"),
)
R.add(
    "tx_01_filing_tone_trend",
    "symbol newest~ mean~ trend",
    lambda t: T.tone_trend(T.tone(t.filings).withColumn("o", F.col("doc_id")), "symbol", "o"),
    f"""SELECT *, CASE WHEN n > 1 AND newest - oldest > 0.15 THEN 'improving' WHEN n > 1 AND newest - oldest < -0.15 THEN 'deteriorating' ELSE 'stable' END AS trend
    FROM (SELECT symbol, arg_max(score, doc_id) AS newest, arg_min(score, doc_id) AS oldest, avg(score) AS mean, count(*) AS n FROM ({TONE.format('filings')}) GROUP BY 1)""",
)


def sentences_sql(words, most="[1:5]"):
    has = " OR ".join(f"contains(lower(s), '{w.lower()}')" for w in words)
    parts = f"list_filter(string_split(replace(coalesce(text, ''), '.', '.' || chr(10)), chr(10)), lambda s: {has})"
    return f"list_filter(list_transform({parts}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 20 AND length(s) < 300){most}"


for name, lexicon in (("guidance", T.GUIDANCE), ("risk", T.RISK)):
    R.add(
        f"tx_02_{name}_sentences",
        "doc_id place# sentence",
        lambda t, lexicon=lexicon: t.filings.select("doc_id", F.posexplode(T.sentences("text", lexicon)).alias("place", "sentence")),
        f"WITH x AS (SELECT doc_id, {sentences_sql(lexicon)} AS l FROM filings) SELECT doc_id, unnest(range(len(l))) AS place, unnest(l) AS sentence FROM x",
    )
R.add(
    "tx_02_document_sentences",
    "doc_id n#",
    lambda t: t.table("documents").select("doc_id", F.size(T.sentences("text", ("the", "und", "que"), None)).alias("n")),
    f"SELECT doc_id, len({sentences_sql(('the', 'und', 'que'), '')}) AS n FROM documents",
)
R.add(
    "tx_03_report_scan",
    "doc_id related_party# contingent# auditor# policy# auditor_concern high_related_party policy_change amounts",
    lambda t: T.report_counts(t.filings).withColumn("amounts", F.array_join(T.contingent_amounts(F.col("text")), " ")),
    """WITH around AS ({EXCERPTS}), a AS (SELECT doc_id, array_to_string(flatten(list(regexp_extract_all(excerpt, {AMOUNT}, 1) ORDER BY place))[1:5], ' ') AS amounts FROM around WHERE family = 'contingent' GROUP BY 1)
    SELECT c.*, coalesce(amounts, '') AS amounts, auditor > 0 AS auditor_concern, related_party > 10 AS high_related_party, policy > 2 AS policy_change
    FROM (SELECT doc_id, {COUNTS} FROM filings) c LEFT JOIN a ON c.doc_id = a.doc_id""".replace("{AMOUNT}", q(T.AMOUNT))
    .replace("{COUNTS}", ", ".join(" + ".join(f"len(regexp_extract_all(lower(text), {q(p)}))" for p in ps) + f" AS {n}" for n, ps in T.FAMILIES.items()))
    .replace("{EXCERPTS}", EXCERPTS.replace("< most", "< 1000000")),
)
R.add("tx_03_excerpts", "doc_id family place# excerpt", lambda t: T.report_excerpts(t.filings, "doc_id"), EXCERPTS)


def value_sql(t: str) -> str:
    """The value rules; DuckDB's patterns can't look ahead, so `lakh crore` is taken out where only a plain lakh may be found."""
    text = f"regexp_replace({t}, '\\s+', ' ', 'g')"
    tries = []
    for pattern, factor, low, high in T.VALUE_RULES:
        source = f"regexp_replace({text}, '(?i)lakhs?\\s*crore', '#', 'g')" if "(?!" in pattern else text
        v = f"TRY_CAST(regexp_replace(regexp_extract({source}, {q(pattern.replace(chr(92) + 'b(?!' + chr(92) + 's*crore)', chr(92) + 'b'))}, 1), '[\\s,]', '', 'g') AS DOUBLE)"
        tries.append(f"CASE WHEN {v} > {low}" + (f" AND {v} < {high}" if high else "") + f" THEN {v} * {factor} END")
    return f"coalesce({', '.join(tries)})"


R.add("tx_04_order_book_value", "doc_id value~", lambda t: t.filings.select("doc_id", T.order_value("text").alias("value")), f"SELECT doc_id, {value_sql('text')} AS value FROM filings")
R.add(
    "tx_05_order_mentions",
    "doc_id kind value~",
    lambda t: T.order_mentions(t.filings, "doc_id"),
    f"""WITH x AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, {q(T.BOOK)}, 1), lambda c: {value_sql('c')}), lambda v: v IS NOT NULL)) AS book,
      list_distinct(list_filter(list_transform(regexp_extract_all(text, {q(T.INFLOW)}, 1), lambda c: {value_sql('c')}), lambda v: v IS NOT NULL)) AS inflow FROM filings)
    SELECT doc_id, 'book' AS kind, unnest(book) AS value FROM x UNION ALL SELECT doc_id, 'inflow', unnest(list_filter(inflow, lambda v: NOT list_contains(book, v))) FROM x""",
)
R.add("tx_06_value_dedupe", "symbol doc_id kind value~", lambda t: T.dedupe_values(t.filings.select("symbol", "doc_id", "date", X.amount("raw").alias("value"), (F.col("doc_id") % 2).alias("kind"))), "SELECT symbol, doc_id, doc_id % 2 AS kind, CAST(replace(raw, ',', '') AS DOUBLE) AS value FROM filings QUALIFY row_number() OVER (PARTITION BY symbol, round_even(CAST(replace(raw, ',', '') AS DOUBLE)/10, 0), doc_id % 2 ORDER BY date DESC, doc_id DESC) = 1")
HEADLINE_SQL = r"TRY_CAST(replace(replace(replace(regexp_extract(text, '(?i){0}\s*(\(?[\d,]+\.\d+\)?)', 1), ',', ''), '(', '-'), ')', '') AS DOUBLE) * unit"
R.add(
    "tx_07_headline_numbers",
    "doc_id revenue_cr~ profit_cr~ ebitda_cr~",
    lambda t: T.headline_numbers(t.filings).select("doc_id", *[(F.col(c) / 1e7).alias(f"{c}_cr") for c in ("revenue", "profit", "ebitda")]),
    f"""WITH u AS (SELECT *, CASE WHEN contains(lower(text), 'in crore') THEN 1 WHEN contains(lower(text), 'in million') THEN 0.1 ELSE 0.01 END AS unit FROM filings),
    v AS (SELECT doc_id, {HEADLINE_SQL.format('revenue from operations')} AS revenue_cr, {HEADLINE_SQL.format('profit for the period')} AS profit_cr, {HEADLINE_SQL.format('ebitda')} AS ebitda_cr FROM u)
    SELECT * FROM v WHERE revenue_cr IS NOT NULL OR profit_cr IS NOT NULL""",
)
RATING_SQL = "list_transform(flatten([" + ", ".join(f"regexp_extract_all(text, {q(p)}, 1)" for p in T.RATINGS) + "]), lambda r: upper(r))"
AGENCY_SQL = "CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN {q(a)}" for k, a in T.AGENCIES.items()) + " ELSE 'Unknown' END"
OUTLOOK_SQL = f"nullif(regexp_extract_all(text, {q(T.OUTLOOK)}, 1)[-1], '')"
R.add("tx_08_tx_09_ratings", "doc_id agency outlook rating", lambda t: t.filings.select("doc_id", T.agency("text").alias("agency"), T.outlook("text").alias("outlook"), F.array_join(F.array_sort(T.ratings("text")), ",").alias("rating")), f"SELECT doc_id, {AGENCY_SQL} AS agency, upper({OUTLOOK_SQL}[1]) || lower({OUTLOOK_SQL}[2:]) AS outlook, array_to_string(list_sort(list_distinct({RATING_SQL})), ',') AS rating FROM filings")
RANK_SQL = "CASE rating " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.RATING_RANK.items()) + " ELSE 0 END"
R.add("agg_25_best_ratings", "symbol agency best rank# negative", lambda t: T.best_ratings(t.filings), f"WITH x AS (SELECT symbol, {AGENCY_SQL} AS agency, lower({OUTLOOK_SQL}) AS outlook, unnest({RATING_SQL}) AS rating FROM filings), y AS (SELECT *, {RANK_SQL} AS rank FROM x) SELECT symbol, agency, arg_max(rating, lpad(CAST(rank AS VARCHAR), 2, '0') || rating) AS best, max(rank) AS rank, bool_or(outlook IN ('negative', 'watch')) AS negative FROM y WHERE agency <> 'Unknown' GROUP BY 1, 2")
SCALE_SQL = "CASE {} WHEN 'AAA' THEN 10 WHEN 'AA+' THEN 9 WHEN 'AA' THEN 8 WHEN 'AA-' THEN 7 WHEN 'A+' THEN 6 WHEN 'A' THEN 5 WHEN 'A-' THEN 4 WHEN 'A1+' THEN 6 WHEN 'A1' THEN 5 WHEN 'BBB+' THEN 3 WHEN 'BBB' THEN 2 WHEN 'BBB-' THEN 1 WHEN 'BB+' THEN 0 WHEN 'BB' THEN -1 WHEN 'B+' THEN -2 WHEN 'B' THEN -3 ELSE -5 END"
R.add(
    "agg_26_rating_trajectory",
    "symbol newest# oldest# trajectory investment_grade",
    lambda t: T.rating_trajectory(t.filings),
    f"""WITH x AS (SELECT symbol, epoch(date)*10000000 + doc_id AS stamp, {RATING_SQL} AS r FROM filings), y AS (SELECT symbol, arg_max(r[1], stamp) AS a, arg_min(r[len(r)], stamp) AS b FROM x WHERE len(r) > 0 GROUP BY 1),
    z AS (SELECT symbol, {SCALE_SQL.format('a')} AS newest, {SCALE_SQL.format('b')} AS oldest FROM y)
    SELECT *, CASE WHEN newest > oldest THEN 'UPGRADED' WHEN newest < oldest THEN 'DOWNGRADED' ELSE 'STABLE' END AS trajectory, newest >= 2 AS investment_grade FROM z""",
)
R.add(
    "agg_22_insider_sentiment",
    "symbol n# buys# sells# buy_shares~ sell_shares~ sentiment",
    lambda t: T.insider_sentiment(T.insider_action(t.filings)),
    r"""WITH x AS (SELECT symbol, CASE WHEN regexp_matches(lower(text), 'acquisition|purchase|bought') THEN 'BUY' WHEN regexp_matches(lower(text), 'disposal|sold|sale') THEN 'SELL' END AS action,
      TRY_CAST(replace(regexp_extract(text, '(?i)(\d[\d,]+)\s*(?:equity\s+)?shares?', 1), ',', '') AS DOUBLE) AS shares FROM filings),
    c AS (SELECT symbol, count(*) AS n, count(*) FILTER (action = 'BUY') AS buys, count(*) FILTER (action = 'SELL') AS sells, coalesce(sum(shares) FILTER (action = 'BUY'), 0) AS buy_shares, coalesce(sum(shares) FILTER (action = 'SELL'), 0) AS sell_shares FROM x WHERE action IS NOT NULL GROUP BY 1)
    SELECT *, CASE WHEN buys > sells + 1 THEN 'BULLISH' WHEN sells > buys + 1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment FROM c""".replace("\\\\", "\\"),
)
ACTION_SQL = "CASE WHEN regexp_matches(lower(text), 'acquisition|purchase|bought') THEN 'BUY' WHEN regexp_matches(lower(text), 'disposal|sold|sale') THEN 'SELL' END"
R.add(
    "tx_10_insider_filings",
    "doc_id action shares~ pct~",
    lambda t: T.insider_action(t.filings),
    rf"""SELECT * FROM (SELECT doc_id, {ACTION_SQL} AS action, TRY_CAST(replace(regexp_extract(text, '(?i)(\d[\d,]+)\s*(?:equity\s+)?shares?', 1), ',', '') AS DOUBLE) AS shares, TRY_CAST(regexp_extract(text, '(\d+\.?\d*)\s*%\s*(?:of|after)', 1) AS DOUBLE) AS pct FROM filings) WHERE action IS NOT NULL""",
)
R.add(
    "tx_12_related_party",
    "doc_id largest~ nature",
    lambda t: T.related_party(t.filings),
    r"""SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '(?i)rs\.?\s*([\d,]+(?:\.\d+)?)\s*crore', 1), lambda s: TRY_CAST(replace(s, ',', '') AS DOUBLE))) AS largest,
      CASE WHEN contains(lower(text), 'loan') THEN 'Loan' WHEN regexp_matches(lower(text), 'sale|purchase') THEN 'Sale/Purchase' WHEN regexp_matches(lower(text), 'service|contract') THEN 'Services/Contract' WHEN contains(lower(text), 'guarantee') THEN 'Guarantee' ELSE '' END AS nature
    FROM filings WHERE contains(lower(text), 'related party')""",
)
R.add(
    "tx_11_sc_15_fiscal_tags",
    "doc_id fiscal_quarter# fiscal_year# label",
    lambda t: t.filings.select("doc_id", X.fiscal_quarter("date").alias("fiscal_quarter"), X.fiscal_year("date").alias("fiscal_year"), X.fy_label("date").alias("label")),
    "SELECT doc_id, quarter(date - INTERVAL 3 MONTH) AS fiscal_quarter, year(date + INTERVAL 9 MONTH) AS fiscal_year, 'FY' || year(date) AS label FROM filings",
)
R.add("sc_01_name_normalise", "p_partkey name", lambda t: t.table("part").select("p_partkey", X.normal_name(F.concat("p_name", F.lit(" - É/co."))).alias("name")), "SELECT p_partkey, trim(regexp_replace(upper(p_name) || ' - E/CO.', '[^A-Z0-9]+', ' ', 'g')) AS name FROM part")
RAW = lambda t: t.filings.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("("), F.col("raw"), F.lit(")"))).when(F.col("doc_id") % 4 == 1, F.concat(F.col("raw"), F.lit("%"))).when(F.col("doc_id") % 4 == 2, F.lit("-")).otherwise(F.col("raw")).alias("raw"))
RAW_SQL = "CAST(replace(raw, ',', '') AS DOUBLE)"
R.add("sc_02_sc_04_amounts", "doc_id value~", lambda t: RAW(t).select("doc_id", X.amount("raw").alias("value")), f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN -{RAW_SQL} WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE {RAW_SQL} END AS value FROM filings")
R.add("sc_03_percents", "doc_id value~", lambda t: RAW(t).select("doc_id", X.percent("raw").alias("value")), f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 2 THEN NULL ELSE {RAW_SQL} END AS value FROM filings")


def written(t, forms):
    """Each filing's date in one of the forms, or junk."""
    how = F.lit("junk")
    for i, form in enumerate(forms):
        how = F.when(F.col("doc_id") % (len(forms) + 1) == i, F.date_format("date", form)).otherwise(how)
    return t.filings.select("doc_id", how.alias("raw"))


DATE_FORMS = ("dd-MMM-yyyy", "dd-MMMM-yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy")
PERIOD_FORMS = ("yyyy-MM-dd", "yyyy-MM", "dd/MM/yyyy", "dd-MM-yyyy", "MMM-yy", "MMMM-yyyy", "MMM yyyy", "MMMM yyyy", "yyyyMM")
R.add("sc_05_dates", "doc_id day", lambda t: written(t, DATE_FORMS).select("doc_id", X.any_date("raw").alias("day")), "SELECT doc_id, CASE WHEN doc_id % 6 < 5 THEN date END AS day FROM filings")
R.add("sc_06_periods", "doc_id month", lambda t: written(t, PERIOD_FORMS).select("doc_id", X.period("raw").alias("month")), "SELECT doc_id, CASE WHEN doc_id % 10 < 9 THEN strftime(date, '%Y-%m') END AS month FROM filings")
R.add("sc_07_quarter_labels", "doc_id quarter_end", lambda t: t.filings.select("doc_id", X.quarter_label_end(F.date_format("date", "MMM yyyy")).alias("quarter_end")), "SELECT doc_id, CAST(last_day(date) AS date) AS quarter_end FROM filings")
R.add("sc_08_issue_price", "doc_id price~", lambda t: t.filings.select("doc_id", X.issue_price(F.when(F.col("doc_id") % 2 == 0, F.col("raw")), F.concat(F.lit("Rs 95 to Rs "), F.col("raw"))).alias("price")), f"SELECT doc_id, {RAW_SQL} AS price FROM filings")
ENDINGS = (" Pvt. Ltd.", " Limited", " India Ltd", " & Company", " Corporation India")
ENDING = lambda: F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % 5 + 1).cast("int"))
R.add(
    "sc_09_sc_10_slugs",
    "p_partkey slug candidates#",
    lambda t: t.table("part").withColumn("n", F.concat("p_name", ENDING())).select("p_partkey", X.slug("n").alias("slug"), F.size(X.slug_candidates("n")).alias("candidates")),
    """SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || ['-pvt', '', '', '-and', '-corporation'][p_partkey % 5 + 1] AS slug,
    [4, 5, 4, 3, 3][p_partkey % 5 + 1] AS candidates FROM part""",
)
R.add("sc_11_page_links", "page_id place# href name", lambda t: T.link_pairs(t.table("pages"), "page_id"), "WITH x AS (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2) AS n FROM pages) SELECT page_id, unnest(range(len(h))) AS place, unnest(h) AS href, unnest(n) AS name FROM x")
R.add("sc_14_exchange_suffix", "symbol ticker", lambda t: t.membership.select("symbol", X.exchange_ticker("symbol", F.when(F.col("symbol") % 3 == 0, "SM").when(F.col("symbol") % 3 == 1, "BE").otherwise("EQ")).alias("ticker")), "SELECT symbol, symbol || CASE symbol % 3 WHEN 0 THEN '-SM' WHEN 1 THEN '-BE' ELSE '' END || '.NS' AS ticker FROM membership")
# Pages of the given tables hold no tables: each order becomes a page with one.
PAGE = lambda t: t.table("orders").select(F.col("o_orderkey").alias("page_id"), F.format_string('<html><section id="deals"><table><tr><th>Date</th><th>Client</th><th></th><th>Price</th></tr><tr><td>%s</td><td><b>%s</b></td><td></td><td>%s</td></tr></table></section><script>{\\"entries\\":[\\"a\\",\\"[b\\"],"exits":[%s]}</script></html>', F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, '"x"').otherwise("")).alias("html"))
CELLS = "SELECT o_orderkey AS page_id, 1 AS row, 0 AS \"column\", 'Date' AS header, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders UNION ALL SELECT o_orderkey, 1, 1, 'Client', CAST(o_custkey AS VARCHAR) FROM orders UNION ALL SELECT o_orderkey, 1, 3, 'Price', o_orderpriority FROM orders"
R.add("src_16_html_table", "page_id row# column# header value", lambda t: T.html_table(PAGE(t), "page_id"), CELLS)
R.add("src_19_section_table", "page_id row# column# header value", lambda t: T.html_table(PAGE(t), "page_id", section="deals"), CELLS)
R.add("sc_12_ud_04_embedded_array", "page_id n# first", lambda t: PAGE(t).withColumn("a", T.embedded_array("html", "entries")).select("page_id", F.size("a").alias("n"), F.get("a", F.lit(1)).alias("first")), "SELECT o_orderkey AS page_id, 2 AS n, '[b' AS first FROM orders")
R.add("sc_13_movement_counts", "page_id entries# exits#", lambda t: T.movement_counts(PAGE(t).withColumn("html", F.replace("html", F.lit('\\"'), F.lit('"'))), "page_id"), "SELECT o_orderkey AS page_id, 2 AS entries, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS exits FROM orders")
QUERIES, ORACLE = R.queries, R.oracle
