"""All queries of the engine over the shared test tables, and their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainlake.functions import dna, text
from strainlake.operators import backtest, dedup, forecast, growth, labels, scope, signal
from strainlake.plans import adapters as a
from strainlake.plans.adapters import SURVEILLANCE

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Labels and frequencies

OUTBREAK = f"""{SURVEILLANCE}, counted AS (
  SELECT Country, YearMonth, Master, count(*) AS Count FROM surveillance GROUP BY ALL
), freq AS (
  SELECT *, CAST(sum(Count) OVER (PARTITION BY Country, YearMonth) AS BIGINT) AS Total FROM counted
), labelled AS (
  SELECT *, CAST(Count AS DOUBLE) / CAST(Total AS DOUBLE) AS Freq FROM freq
), outbreak AS (
  SELECT *, lead(Freq) OVER (PARTITION BY Country, Master ORDER BY YearMonth) AS Next_Month_Freq FROM labelled
), outbreak_label AS (
  SELECT *, CAST(CASE WHEN Next_Month_Freq >= 0.05 THEN 1 ELSE 0 END AS INT) AS Outbreak FROM outbreak
)"""


@query(f"WITH {OUTBREAK} SELECT * FROM outbreak_label")
def outbreak_label(spark, sf_dir):
    return labels.outbreak(a.surveillance(spark, sf_dir))


@query(f"""WITH {OUTBREAK}, stepped AS (SELECT *, lead(YearMonth) OVER (PARTITION BY Country, Master ORDER BY YearMonth) AS next_month FROM outbreak)
SELECT Country, YearMonth, Master, Count, Total, Freq, Next_Month_Freq, CAST(CASE WHEN Next_Month_Freq >= 0.05 THEN 1 ELSE 0 END AS INT) AS Outbreak
FROM stepped WHERE next_month = CAST(YearMonth + INTERVAL 1 MONTH AS DATE) AND Next_Month_Freq IS NOT NULL""")
def outbreak_adjacent(spark, sf_dir):
    return labels.outbreak(a.surveillance(spark, sf_dir), calendar_adjacent=True, drop_unlabeled=True)


@query(f"""WITH {OUTBREAK} SELECT s.Accession, s.Country, s.YearMonth, s.Master, o.Outbreak FROM surveillance s JOIN outbreak_label o USING (Country, YearMonth, Master)""")
def labelled_rows(spark, sf_dir):
    rows = a.surveillance(spark, sf_dir)
    return labels.labelled(rows, labels.outbreak(rows)).select("Accession", "Country", "YearMonth", "Master", "Outbreak")


@query(f"""WITH {SURVEILLANCE}, seen AS (SELECT Country, YearMonth, Master AS Variant, count(*) AS n FROM surveillance GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT Country, YearMonth FROM seen) CROSS JOIN (SELECT DISTINCT Variant FROM seen)),
share AS (SELECT g.*, CAST(coalesce(n, 0) AS DOUBLE) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.Country, g.YearMonth) AS DOUBLE) AS f FROM grid g LEFT JOIN seen s USING (Country, YearMonth, Variant))
SELECT Country, YearMonth, Variant, round(coalesce(lead(f) OVER (PARTITION BY Country, Variant ORDER BY YearMonth) - f, 0.0), 9) AS labels FROM share""")
def dpgr(spark, sf_dir):
    rows = a.surveillance(spark, sf_dir).withColumnRenamed("Master", "Variant")
    return labels.dpgr(rows).withColumn("labels", F.round("labels", 9))


@query("SELECT n_name AS Country, CAST(row_number() OVER (ORDER BY n_name) - 1 AS INT) AS Country_ID FROM (SELECT DISTINCT n_name FROM nation)")
def label_encode(spark, sf_dir):
    return labels.encode(a.table(spark, sf_dir, "nation"), "n_name", "Country_ID").withColumnRenamed("n_name", "Country")


@query(f"""WITH {SURVEILLANCE} SELECT CASE WHEN Year < 1998 THEN 'learn' ELSE 'test' END AS part, Country, count(*) AS n, count(DISTINCT Master) AS strains
FROM surveillance WHERE Year <= 1998 GROUP BY ALL""")
def time_split(spark, sf_dir):
    learn, test = labels.split_by_time(a.surveillance(spark, sf_dir), 1998)
    both = learn.withColumn("part", F.lit("learn")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "Country").agg(F.count("*").alias("n"), F.countDistinct("Master").alias("strains"))


# Duplicate sequences

CLEANED = "cleaned AS (SELECT doc_id AS id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
GROUPS = f"""{CLEANED}, groups AS (
  SELECT sha256(seq) AS seq_hash, CAST(length(seq) AS BIGINT) AS seq_length, count(*) AS count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS identifiers, min(id) AS first_ord
  FROM cleaned WHERE seq <> '' GROUP BY seq
)"""
joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"WITH {GROUPS} SELECT * FROM groups")
def dup_groups(spark, sf_dir):
    return dedup.ranked(dedup.group_sequences(a.records(spark, sf_dir))).withColumn("identifiers", joined("identifiers"))


@query(f"WITH {CLEANED} SELECT count(*) AS total, count(DISTINCT seq) AS unique_n, count(*) - count(DISTINCT seq) AS duplicates, coalesce(100.0::DOUBLE * (count(*) - count(DISTINCT seq)) / nullif(count(*), 0), 0.0) AS duplicate_percent FROM cleaned WHERE seq <> ''")
def dup_summary(spark, sf_dir):
    return dedup.summary(a.records(spark, sf_dir))


@query(f"WITH {GROUPS} SELECT seq_hash, count, first_ord FROM groups WHERE count > 1 ORDER BY count DESC, first_ord LIMIT 10")
def uniqueness_top(spark, sf_dir):
    return dedup.uniqueness(a.records(spark, sf_dir)).select("seq_hash", "count", "first_ord")


@query(f"""WITH {CLEANED}, j AS (SELECT sha256(seq) AS h, id, doc_id IS NOT NULL AS known FROM cleaned LEFT JOIN labels ON id = doc_id WHERE seq <> ''),
g AS (SELECT h, bool_or(known) AS known FROM j GROUP BY h), i AS (SELECT id, bool_or(known) AS known FROM j GROUP BY id)
SELECT (SELECT count(*) FROM g) AS entries, (SELECT count(*) FROM g WHERE known) AS enriched, (SELECT count(*) FROM i WHERE known) AS matched, (SELECT count(*) FROM i WHERE NOT known) AS missing""")
def enrichment_summary(spark, sf_dir):
    return dedup.enrichment_summary(dedup.group_sequences(a.records(spark, sf_dir)), a.table(spark, sf_dir, "labels"), "doc_id")


@query(f"""WITH {CLEANED} SELECT sha256(seq) AS seq_hash, string_agg(id || '=' || quality || '/' || toxic, ',' ORDER BY id) AS metadata
FROM cleaned JOIN labels ON id = doc_id WHERE seq <> '' GROUP BY seq""")
def enriched_groups(spark, sf_dir):
    meta = a.table(spark, sf_dir, "labels").withColumn("ord", F.col("doc_id"))
    groups = dedup.enrich(dedup.group_sequences(a.records(spark, sf_dir)), meta, "doc_id")
    entries = F.array_sort(F.transform(F.map_entries("metadata_by_accession"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    line = F.transform(entries, lambda e: F.concat(e["k"].cast("string"), F.lit("="), e["v"]["quality"].cast("string"), F.lit("/"), e["v"]["toxic"].cast("string")))
    return groups.where("metadata_by_accession is not null").select("seq_hash", F.array_join(line, ",").alias("metadata"))


@query(f"""WITH {CLEANED} SELECT id AS Accession, first_value(id) OVER (PARTITION BY seq ORDER BY id) AS Master FROM cleaned WHERE seq <> ''""")
def accession_masters(spark, sf_dir):
    return labels.masters(dedup.group_sequences(a.records(spark, sf_dir)))


# Forecast and backtest

SCORE = "CAST((user_id * 7919 + Month * 104729 + length(Accession) * 1299709) % 100003 AS DOUBLE) / 100003.0::DOUBLE"
SCORED = f"""scored AS (
  SELECT CAST(user_id AS VARCHAR) AS Country, Month, Accession, {SCORE} AS Probability
  FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INT) AS Month) CROSS JOIN (SELECT DISTINCT event_type AS Accession FROM events)
)"""
TOP3 = f"""{SCORED}, top3 AS (
  SELECT CAST(Year AS INT) AS Year, Month, Country, Accession, Probability
  FROM (SELECT *, row_number() OVER (PARTITION BY Country, Month ORDER BY Probability DESC, Accession) AS n FROM scored) CROSS JOIN (SELECT unnest([2024, 2025]) AS Year) WHERE n <= 3
)"""


def _scorer(rows: DataFrame) -> DataFrame:
    return rows.withColumn("Probability", forecast.hashed_score(F.col("Country").cast("long"), F.col("Month"), F.length("Accession")))


def _top3(spark, sf_dir):
    rows = a.forecast_rows(spark, sf_dir)
    return forecast.scan(rows, rows, [2024, 2025], _scorer, 3)


@query(f"WITH {TOP3} SELECT * FROM top3")
def forecast_topn(spark, sf_dir):
    return _top3(spark, sf_dir)


@query(f"""WITH {TOP3}, top1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Country, Year, Month ORDER BY Probability DESC, Accession) AS n FROM top3) WHERE n = 1),
notes AS (SELECT Country, Year, Month, Accession AS Dominant_Accession, lag(Accession) OVER (PARTITION BY Country ORDER BY Year, Month) AS Previous_Dominant_Accession FROM top1)
SELECT t.*, Dominant_Accession, Previous_Dominant_Accession, Accession = Dominant_Accession AS Is_Dominant_Prediction,
  coalesce(Accession = Dominant_Accession AND Previous_Dominant_Accession IS NOT NULL AND Dominant_Accession <> Previous_Dominant_Accession, false) AS New_DNA_From_Previous_Dominant
FROM top3 t LEFT JOIN notes USING (Country, Year, Month)""")
def dominant_shift(spark, sf_dir):
    return forecast.annotate_dominant(_top3(spark, sf_dir))


@query(f"""WITH {TOP3}, titles AS (SELECT event_type AS Accession, props AS GenBank_Title FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n = 1)
SELECT t.*, GenBank_Title FROM top3 t LEFT JOIN titles USING (Accession)""")
def forecast_titles(spark, sf_dir):
    e = a.table(spark, sf_dir, "events").select(F.col("event_type").alias("Accession"), F.col("props").alias("GenBank_Title"), F.col("event_id").alias("Title_Order"))
    return forecast.with_titles(_top3(spark, sf_dir), e)


BACKTEST = f"""{SURVEILLANCE}, scored AS (
  SELECT Country, Month, Accession, CAST((ascii(Country) * 7919 + Month * 104729 + CAST(substr(Accession, 7) AS INT) * 1299709) % 100003 AS DOUBLE) / 100003.0::DOUBLE AS Probability
  FROM (SELECT DISTINCT Country FROM surveillance) CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INT) AS Month) CROSS JOIN (SELECT DISTINCT Master AS Accession FROM surveillance)
), actual AS (
  SELECT Country, Month, Master AS Actual_Accession, n AS Actual_Count, lag(Master) OVER (PARTITION BY Country ORDER BY Month) AS Previous_Actual_Dominant_Accession
  FROM (SELECT Country, Month, Master, count(*) AS n, row_number() OVER (PARTITION BY Country, Month ORDER BY count(*) DESC, Master) AS k FROM surveillance WHERE Year = 1997 GROUP BY Country, Month, Master) WHERE k = 1
), best AS (
  SELECT Country, Month, Accession AS Predicted_Accession, Probability AS Predicted_Probability
  FROM (SELECT *, row_number() OVER (PARTITION BY Country, Month ORDER BY Probability DESC, Accession) AS k FROM scored) WHERE k = 1
), j AS (
  SELECT *, CAST(1997 AS INT) AS Year, lag(Predicted_Accession) OVER (PARTITION BY Country ORDER BY Month) AS Previous_Predicted_Dominant_Accession FROM actual JOIN best USING (Country, Month)
), backtest AS (
  SELECT *, Predicted_Accession = Actual_Accession AS Match,
    coalesce(Previous_Actual_Dominant_Accession IS NOT NULL AND Actual_Accession <> Previous_Actual_Dominant_Accession, false) AS Actual_New_DNA_From_Previous_Dominant,
    coalesce(Previous_Predicted_Dominant_Accession IS NOT NULL AND Predicted_Accession <> Previous_Predicted_Dominant_Accession, false) AS Predicted_New_DNA_From_Previous_Dominant
  FROM j
)"""


def _backtest(spark, sf_dir):
    rows = a.surveillance(spark, sf_dir)
    scorer = lambda r: r.withColumn("Probability", forecast.hashed_score(F.ascii("Country"), F.col("Month"), F.substring("Accession", 7, 9).cast("int")))
    pairs = forecast.scan(rows.select(F.col("Master").alias("Accession")), rows, [1997], scorer, 1)
    return backtest.dominant(rows, pairs.drop("Year"), 1997)


@query(f"WITH {BACKTEST} SELECT * FROM backtest")
def dominant_backtest(spark, sf_dir):
    return _backtest(spark, sf_dir)


@query(f"""WITH {BACKTEST}, titles AS (SELECT p_brand AS Accession, min(p_type) AS GenBank_Title FROM part GROUP BY p_brand)
SELECT Country, Month, Predicted_Accession, Actual_Accession, p.GenBank_Title AS Predicted_Title, t.GenBank_Title AS Actual_Title
FROM backtest LEFT JOIN titles p ON Predicted_Accession = p.Accession LEFT JOIN titles t ON Actual_Accession = t.Accession""")
def backtest_titles(spark, sf_dir):
    titles = a.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("Accession")).agg(F.min("p_type").alias("GenBank_Title"))
    return backtest.with_both_titles(_backtest(spark, sf_dir), titles).select("Country", "Month", "Predicted_Accession", "Actual_Accession", "Predicted_Title", "Actual_Title")


@query(f"WITH {BACKTEST} SELECT count(*) AS compared, count(*) FILTER (Match) AS matches, coalesce(avg(CAST(Match AS INT)), 0.0) AS accuracy FROM backtest")
def backtest_accuracy(spark, sf_dir):
    return backtest.accuracy(_backtest(spark, sf_dir))


CONFUSION = """s AS (SELECT quality AS y, CAST((doc_id * 7919) % 1009 AS DOUBLE) / 1009.0::DOUBLE AS q FROM labels),
k AS (SELECT y, CAST(q > 0.5 AS INT) AS p, q FROM s), c AS (
  SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (y = 0 AND p = 0) AS DOUBLE) AS n00, CAST(count(*) FILTER (y = 0 AND p = 1) AS DOUBLE) AS n01,
    CAST(count(*) FILTER (y = 1 AND p = 0) AS DOUBLE) AS n10, CAST(count(*) FILTER (y = 1 AND p = 1) AS DOUBLE) AS n11,
    1 - sum((y - q) * (y - q)) / (sum(y * y) - CAST(sum(y) * sum(y) AS DOUBLE) / count(*)) AS r2 FROM k
), each AS (
  SELECT '0' AS class, coalesce(n00 / nullif(n00 + n10, 0), 0) AS precision, coalesce(n00 / nullif(n00 + n01, 0), 0) AS recall, CAST(n00 + n01 AS BIGINT) AS support FROM c
  UNION ALL SELECT '1', coalesce(n11 / nullif(n11 + n01, 0), 0), coalesce(n11 / nullif(n11 + n10, 0), 0), CAST(n11 + n10 AS BIGINT) FROM c
), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM each), every AS (
  SELECT class, precision, recall, f1, support FROM f
  UNION ALL SELECT 'accuracy', (n00 + n11) / n, (n00 + n11) / n, (n00 + n11) / n, CAST(n AS BIGINT) FROM c
  UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
  UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f
  UNION ALL SELECT 'r2', r2, r2, r2, CAST(n AS BIGINT) FROM c
)"""


@query(f"WITH {CONFUSION} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM every")
def classification_report(spark, sf_dir):
    rows = a.table(spark, sf_dir, "labels").withColumn("q", ((F.col("doc_id") * 7919) % 1009).cast("double") / 1009.0)
    return backtest.classification(rows, "quality", "q").select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("""WITH s AS (SELECT quality AS y, least(greatest(CAST((doc_id * 7919) % 1009 AS DOUBLE) / 1009.0::DOUBLE, 1e-7), 1 - 1e-7) AS q FROM labels)
SELECT round(avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 9) AS log_loss FROM s""")
def log_loss(spark, sf_dir):
    rows = a.table(spark, sf_dir, "labels").withColumn("q", ((F.col("doc_id") * 7919) % 1009).cast("double") / 1009.0)
    return backtest.log_loss(rows, "quality", "q").select(F.round("log_loss", 9).alias("log_loss"))


# Growth

TRENDS = """e AS (
  SELECT CAST(user_id AS VARCHAR) AS Country, event_type AS Accession, CAST(year(ts) AS INT) AS Year, CAST(day(ts) AS INT) AS Month, value AS Probability, CAST(year(ts) * 12 + day(ts) AS INT) AS t FROM events WHERE value IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY Country, Accession ORDER BY t, Probability) AS a, row_number() OVER (PARTITION BY Country, Accession ORDER BY t DESC, Probability DESC) AS z,
    row_number() OVER (PARTITION BY Country, Accession ORDER BY Probability DESC, t) AS p FROM e
), trends AS (
  SELECT Country, Accession, max(CASE WHEN a = 1 THEN Probability END) AS Start_Prob, max(CASE WHEN z = 1 THEN Probability END) AS End_Prob, max(CASE WHEN p = 1 THEN Probability END) AS Peak_Prob,
    max(CASE WHEN p = 1 THEN Year || '-' || lpad(CAST(Month AS VARCHAR), 2, '0') END) AS Peak_Label FROM ranked GROUP BY Country, Accession HAVING count(*) >= 2
), growth AS (SELECT *, End_Prob - Start_Prob AS Delta FROM trends)"""


def _events(spark, sf_dir):
    # a month is too short a time to move in these tables; days stand for months
    return growth.prepared(a.forecast_rows(spark, sf_dir).withColumn("Month", F.col("Day")))


@query(f"WITH {TRENDS} SELECT * FROM growth")
def growth_trends(spark, sf_dir):
    return growth.trends(_events(spark, sf_dir))


@query(f"""WITH {TRENDS} SELECT 'rising' AS side, * FROM (SELECT Country, Accession, Delta FROM growth ORDER BY Delta DESC, Country, Accession LIMIT 10)
UNION ALL SELECT 'falling', * FROM (SELECT Country, Accession, Delta FROM growth ORDER BY Delta, Country, Accession LIMIT 10)""")
def growth_top(spark, sf_dir):
    t = growth.trends(_events(spark, sf_dir))
    side = lambda df, name: df.select(F.lit(name).alias("side"), "Country", "Accession", "Delta")
    return side(growth.rising(t), "rising").unionByName(side(growth.falling(t), "falling"))


@query(f"""WITH {TRENDS} SELECT Country, Year, Month, Accession, Probability FROM (SELECT *, row_number() OVER (PARTITION BY Country, Year, Month ORDER BY Probability DESC, Accession) AS n FROM e) WHERE n = 1""")
def growth_dominant(spark, sf_dir):
    return growth.dominant_by_month(_events(spark, sf_dir))


@query(f"WITH {TRENDS} SELECT count(DISTINCT Country) AS countries, count(DISTINCT Accession) AS accessions, count(*) AS n, min(t) AS first_month, max(t) AS last_month FROM e")
def growth_summary(spark, sf_dir):
    return growth.summary(_events(spark, sf_dir))


@query(f"""WITH {TRENDS}, top AS (SELECT row_number() OVER (ORDER BY Delta DESC, Country, Accession) AS k, * FROM growth)
SELECT CAST(k AS INT) AS line_no, printf('%-20s %-20s %8.4f %8.4f %+8.4f', substr(Country, 1, 20), substr(Accession, 1, 20), Start_Prob, End_Prob, Delta) AS line FROM top WHERE k <= 250
UNION ALL SELECT 251, '... ' || (count(*) - 250) || ' more' FROM growth HAVING count(*) > 250""")
def growth_report(spark, sf_dir):
    return growth.report(growth.trends(_events(spark, sf_dir)))


# Scalars

@query("""WITH s AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents), r AS (SELECT *, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM s)
SELECT doc_id, sha256(seq) AS seq_hash, sha256(rc) AS rc_hash, sha256(least(seq, rc)) AS canonical_hash, rc < seq AS reversed, CAST((length(seq) + 3) // 4 AS BIGINT) AS two_bit_bytes FROM r""")
def dna_scalars(spark, sf_dir):
    seq = dna.clean(F.col("text"))
    d = a.table(spark, sf_dir, "documents").select("doc_id", seq.alias("seq"))
    least, reversed_ = dna.canonical(F.col("seq"))
    sha = lambda c: F.sha2(c, 256)
    return d.select("doc_id", sha(F.col("seq")).alias("seq_hash"), sha(dna.reverse_complement(F.col("seq"))).alias("rc_hash"), sha(least).alias("canonical_hash"), reversed_.alias("reversed"), F.floor((F.length("seq") + 3) / 4).cast("long").alias("two_bit_bytes"))


RLE = """WITH r AS (SELECT doc_id, unnest(regexp_extract_all(upper(text), '(A+|C+|G+|T+|N+)')) AS run, generate_subscripts(regexp_extract_all(upper(text), '(A+|C+|G+|T+|N+)'), 1) AS k FROM documents),
c AS (SELECT doc_id, k, length(run) AS n, CASE run[1] WHEN 'A' THEN 97 WHEN 'C' THEN 65 WHEN 'T' THEN 78 WHEN 'G' THEN 110 ELSE 33 END AS off FROM r),
t AS (SELECT doc_id, k, n, repeat(chr(off + 12), n // 13) || CASE WHEN n % 13 > 0 THEN chr(CAST(off + n % 13 - 1 AS INT)) ELSE '' END AS code FROM c)"""


@query(RLE + " SELECT d.doc_id, sha256(coalesce(string_agg(code, '' ORDER BY k), '')) AS code_hash, CAST(coalesce(sum(n), 0) AS BIGINT) AS bases, CAST(coalesce(sum(length(code)), 0) AS BIGINT) AS code_length FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id")
def rle_codec(spark, sf_dir):
    d = a.table(spark, sf_dir, "documents").select("doc_id", dna.run_length(F.col("text")).alias("code"))
    return d.select("doc_id", F.sha2("code", 256).alias("code_hash"), F.length(dna.run_length_decoded(F.col("code"))).cast("long").alias("bases"), F.length("code").cast("long").alias("code_length"))


@query("""SELECT item_id, CAST(len(b) AS BIGINT) AS n_bytes, array_to_string(list_transform(b, lambda x: (x // 64) || '' || ((x // 16) % 4) || '' || ((x // 4) % 4) || '' || (x % 4)), '') AS symbols
FROM (SELECT item_id, list_transform(range(0, octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS INT), 2) AS INT)) AS b FROM benchmark)""")
def byte_symbols(spark, sf_dir):
    b = a.table(spark, sf_dir, "benchmark").select("item_id", F.hex(F.col("text").cast("binary")).alias("h"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("h") - 1, F.lit(2)), lambda i: F.conv(F.substr("h", i, F.lit(2)), 16, 10).cast("int"))
    b = b.select("item_id", F.when(F.length("h") > 0, pairs).otherwise(F.array().cast("array<int>")).alias("b"))
    return b.select("item_id", F.size(dna.ids_to_bytes(dna.byte_ids(F.col("b")))).cast("long").alias("n_bytes"), joined(dna.byte_ids(F.col("b"))).alias("symbols")).withColumn("symbols", F.replace("symbols", F.lit(","), F.lit("")))


@query(r"""SELECT page_id, try_cast(nullif(regexp_extract(url || ' ' || html, '\b(19\d{2}|20\d{2}|2100)\b', 1), '') AS INT) AS year, try_cast(nullif(regexp_extract(html, '(\d{1,3})%', 1), '') AS INT) AS raw_percent, substr(url, 1, 72) AS title,
  trim(split_part(url, ':', 1)) AS country FROM pages""")
def page_scalars(spark, sf_dir):
    p = a.table(spark, sf_dir, "pages")
    return p.select("page_id", text.year_of(F.concat_ws(" ", "url", "html")).alias("year"), F.nullif(F.regexp_extract("html", r"(\d{1,3})%", 1), F.lit("")).try_cast("int").alias("raw_percent"), F.substring("url", 1, 72).alias("title"), text.country(F.col("url")).alias("country"))


@query("""SELECT event_id, CAST(ts AS DATE) AS full_date, CAST(date_trunc('month', ts) AS DATE) AS from_month, CAST(date_trunc('year', ts) AS DATE) AS from_year, CAST(NULL AS DATE) AS from_text,
  CAST(year(ts) * 12 + month(ts) AS INT) AS time_index, strftime(ts, '%Y-%m') AS label FROM events""")
def date_policy(spark, sf_dir):
    e = a.table(spark, sf_dir, "events").select("event_id", "ts")
    f = lambda pattern: text.date(F.date_format("ts", pattern))
    return e.select(
        "event_id", f("yyyy-MM-dd").alias("full_date"), f("yyyy-MM").alias("from_month"), f("yyyy").alias("from_year"), f("dd/MM/yyyy").alias("from_text"),
        (F.year("ts") * 12 + F.month("ts")).alias("time_index"), F.format_string("%d-%02d", F.year("ts"), F.month("ts")).alias("label"),
    )


@query("""WITH p AS (SELECT p_partkey, p_type, p_brand, p_name FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN coalesce(nullif(regexp_extract(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' Victoria' ELSE '' END, '(Victoria|Yamagata)', 1), ''), 'B/Other')
  WHEN p_partkey % 3 = 1 THEN coalesce(nullif(regexp_extract('(H' || (p_partkey % 14) || 'N2)', '\\((H\\dN\\d)\\)', 1), ''), 'A/Other') ELSE 'Unknown' END AS variant FROM p""".replace("\\\\", "\\"))
def lineage_extract(spark, sf_dir):
    k = F.col("p_partkey")
    p = a.table(spark, sf_dir, "part")
    virus = F.when(k % 3 == 0, "B").when(k % 3 == 1, "A").otherwise("C")
    title = F.concat("p_name", F.when(k % 2 == 0, " Victoria").otherwise(""))
    organism = F.concat(F.lit("(H"), (k % 14).cast("string"), F.lit("N2)"))
    return p.select("p_partkey", text.lineage(virus, organism, title).alias("variant"))


@query("""SELECT doc_id, '[' || coalesce(CASE WHEN doc_id % 5 > 0 THEN lang END, 'nan') || '][' || source || '][' || 'X' || '] ' || regexp_replace(upper(text), '[^ACGT]', '', 'g') AS text FROM documents""")
def training_text(spark, sf_dir):
    d = a.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.training_text(F.when(F.col("doc_id") % 5 > 0, F.col("lang")), F.col("source"), F.lit("X"), dna.clean(F.col("text"))).alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN array_to_string(list_sort(list_distinct(list_concat(range(2000, 2000 + p_size % 7 + 1), [2005]))), ',') ELSE '2001,2005' END AS years FROM part""")
def year_ranges(spark, sf_dir):
    size = F.col("p_size")
    value = F.when(size % 2 == 0, F.concat(F.lit("2000-"), (2000 + size % 7).cast("string"), F.lit(", 2005 ,"))).otherwise(F.lit("2005,2009-2003,2001,2001"))
    return a.table(spark, sf_dir, "part").select("p_partkey", joined(text.years(value)).alias("years"))


@query(r"""WITH y AS (SELECT list_sort(list_distinct(list(CAST(year(o_orderdate) AS INT)))) AS y FROM orders), c AS (SELECT list_sort(list(DISTINCT n_name)) AS c FROM nation)
SELECT y[1] || '-' || y[len(y)] AS forecast_years, y[1] || '-' || y[len(y) - 1] AS training_years, CAST(y[len(y)] AS VARCHAR) AS backtest_year, array_to_string(c, ',') AS countries FROM y, c""")
def inferred_scope(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders").join(a.table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).join(a.table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    rows = o.select(F.col("o_orderdate").cast("date").cast("string").alias("date"), F.concat("n_name", F.lit(": x")).alias("place"))
    return scope.parameters(scope.infer(rows, "date", "place"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS released FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01' AND lower(n_name) = 'nation_6' AND o_orderstatus = 'F'""")
def released_after(spark, sf_dir):
    from strainlake.sources.remote import Selection

    o = a.table(spark, sf_dir, "orders").join(a.table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).join(a.table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    rows = o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("Release_Date"), F.col("n_name").alias("Country"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("partial").alias("Completeness"))
    return Selection(location="NATION_6", released_after="1997-01-01", complete_only=True).apply(rows).select("o_orderkey", F.col("Release_Date").alias("released"))


# Signals

SYMBOLS = "s AS (SELECT doc, unnest(range(0, length(seq))) AS i, seq FROM (SELECT item_id AS doc, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark)), sym AS (SELECT doc, CAST(i AS INT) AS i, CAST(instr('ACGT', seq[i + 1]) - 1 AS INT) AS sym FROM s)"


def _symbols(spark, sf_dir):
    return signal.symbols(a.table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"""WITH {SYMBOLS}, m AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS off, unnest([0, 3, 0, 3, 0, 1, 0, 1]) AS msym),
x AS (SELECT doc, i - off AS w, CAST(1 + (i * 7) % 94 AS DOUBLE) / 94.0::DOUBLE * CASE abs(sym - msym) WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS x FROM sym CROSS JOIN m WHERE i >= off)
SELECT doc, CAST(w AS INT) AS w, round(sum(x) / 8, 9) AS score FROM x GROUP BY doc, w HAVING count(*) = 8 AND sum(x) / 8 > 0.25""")
def motif_search(spark, sf_dir):
    signs = signal.signatures(a.table(spark, sf_dir, "benchmark"), "item_id", "text", lambda i: (1 + (i * 7) % 94).cast("double") / 94.0)
    return signal.matches(signs, "ATATACAC", 0.25).withColumn("score", F.round("score", 9))


def _code_sql(order: int, by: str = "") -> str:
    along, context, p, columns = "OVER (PARTITION BY doc ORDER BY i)", f"doc{by}", "0.25::DOUBLE", []
    for o in range(order + 1):
        if o:
            context += f", c{o}"
        columns += [f"row_number() OVER (PARTITION BY {context}, sym ORDER BY i) - 1 AS n{o}", f"row_number() OVER (PARTITION BY {context} ORDER BY i) - 1 AS t{o}"]
        p = f"((n{o} + 1.0::DOUBLE * {p}) / (t{o} + 1.0::DOUBLE))"
    lags = ", ".join(f"coalesce(lag(sym, {k}) {along}, 0) AS c{k}" for k in range(1, order + 1))
    return f"l AS (SELECT *, {lags} FROM sym_), k AS (SELECT *, {', '.join(columns)} FROM l) SELECT doc, count(*) AS n, round(sum(-log2({p})), 6) AS bits FROM k GROUP BY doc"


@query(f"WITH {SYMBOLS}, sym_ AS (SELECT * FROM sym), {_code_sql(4)}")
def code_length(spark, sf_dir):
    return signal.code_length(_symbols(spark, sf_dir)).withColumn("bits", F.round("bits", 6))


BUCKETS = f"""{SYMBOLS}, b AS (SELECT *, sum(CASE sym WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END) OVER w AS re, sum(CASE sym WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END) OVER w AS im
  FROM sym WINDOW w AS (PARTITION BY doc ORDER BY i ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING)),
sym_ AS (SELECT doc, i, sym, CASE WHEN re IS NULL OR (re = 0 AND im = 0) THEN 0 ELSE CAST(floor(fmod(atan2(im, re) + 2 * pi(), 2 * pi()) * 8 / (2 * pi())) AS INT) % 8 END AS bucket FROM b)"""


@query(f"WITH {BUCKETS} SELECT doc, i, bucket FROM sym_")
def causal_buckets(spark, sf_dir):
    return signal.buckets(_symbols(spark, sf_dir)).select("doc", "i", "bucket")


@query(f"WITH {BUCKETS}, {_code_sql(2, ', bucket')}")
def polar_code_length(spark, sf_dir):
    return signal.code_length(signal.buckets(_symbols(spark, sf_dir)), 2, by=("bucket",)).withColumn("bits", F.round("bits", 6))


@query("""WITH v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS j FROM embeddings), h AS (SELECT CAST(unnest(range(0, 64)) AS INT) AS i),
p AS (SELECT vec_id, i, sum(CAST(x AS DOUBLE) * CASE WHEN bit_count(CAST(i & j AS INT)) % 2 = 0 THEN 1 ELSE -1 END) AS y FROM v CROSS JOIN h GROUP BY vec_id, i)
SELECT vec_id, round(max(abs(y)), 6) AS peak, round(sum(y), 6) AS total FROM p GROUP BY vec_id""")
def walsh_transform(spark, sf_dir):
    e = a.table(spark, sf_dir, "embeddings").select("vec_id", dna.walsh_hadamard(F.col("embedding"), 64).alias("y"))
    return e.select("vec_id", F.round(F.array_max(F.transform("y", lambda x: F.abs(x))), 6).alias("peak"), F.round(F.aggregate("y", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""SELECT item_id, CAST(length(regexp_replace(upper(substr(text, 1, 128)), '[^A]', '', 'g')) AS DOUBLE) AS a, CAST(length(regexp_replace(upper(substr(text, 1, 128)), '[^ACGT]', '', 'g')) AS DOUBLE) AS known FROM benchmark""")
def one_hot_sums(spark, sf_dir):
    b = a.table(spark, sf_dir, "benchmark").select("item_id", dna.one_hot(F.col("text"), 128).alias("x"))
    total = lambda f: F.aggregate(F.transform("x", f), F.lit(0.0), lambda s, v: s + v)
    return b.select("item_id", total(lambda r: r[0].cast("double")).alias("a"), total(lambda r: (r[0] + r[1] + r[2] + r[3]).cast("double")).alias("known"))


@query("""SELECT item_id, CAST(length(regexp_replace(upper(substr(text, 1, 2500)), '[^A]', '', 'g')) AS DOUBLE) AS a, CAST(length(regexp_replace(upper(substr(text, 1, 2500)), '[^ACGT]', '', 'g')) AS DOUBLE) AS known FROM benchmark""")
def one_hot_sums_whole(spark, sf_dir):
    """As one_hot_sums, over the reference's length instead of the first 128 characters."""
    b = a.table(spark, sf_dir, "benchmark").select("item_id", dna.one_hot(F.col("text")).alias("x"))
    total = lambda f: F.aggregate(F.transform("x", f), F.lit(0.0), lambda s, v: s + v)
    return b.select("item_id", total(lambda r: r[0].cast("double")).alias("a"), total(lambda r: (r[0] + r[1] + r[2] + r[3]).cast("double")).alias("known"))


@query("""SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type AS Master, count(*) AS n FROM events GROUP BY ALL""")
def monthly_counts(spark, sf_dir):
    from strainlake.streaming.monthly import monthly_counts as counts

    return counts(a.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")


@query()
def codec_round_trip(spark, sf_dir):
    from strainlake.operators.codec import round_trip

    return round_trip(a.table(spark, sf_dir, "benchmark"), "item_id", "text")


@query()
def model_scores(spark, sf_dir):
    from strainlake.operators.model import fit, outbreak_features

    rows = a.surveillance(spark, sf_dir)
    features = outbreak_features(labels.outbreak(rows))
    learn, test = labels.split_by_time(features, 1998)
    return fit(learn).transform(test).select("Country", "YearMonth", "Master", "Outbreak", "Probability")


@query()
def codec_sizes(spark, sf_dir):
    from strainlake.operators.codec import sizes

    return sizes(a.table(spark, sf_dir, "benchmark"), "item_id", "text")


@query()
def learned_forecast(spark, sf_dir):
    """The three best strains of each country and month under a model learned from the years before 1998."""
    from strainlake.operators import model
    from strainlake.plans.forecast_run import learned

    rows = a.surveillance(spark, sf_dir)
    learn, _ = labels.split_by_time(labels.labelled(rows, labels.outbreak(rows)), 1998)
    best = forecast.scan(rows.select(F.col("Master").alias("Accession")), rows.select("Country"), [1998], model.scorer(learned(learn)))
    return forecast.annotate_dominant(best.select("Country", "Year", "Month", "Accession", "Probability"))


@query("""SELECT user_id, substr(repeat(event_type, CAST(ceil(100.0 / length(event_type)) AS INT)), 1, 100) AS seq FROM events""")
def tiled_fragments(spark, sf_dir):
    from strainlake.sources.generators import tiled

    return a.table(spark, sf_dir, "events").select("user_id", tiled(F.col("event_type"), 100).alias("seq"))


# Training set, masters, reads, scope, reports

OBSERVED = f"""{SURVEILLANCE}, cells AS (
  SELECT Country, YearMonth, Master AS Variant, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY Country, YearMonth) AS DOUBLE) AS f FROM surveillance GROUP BY Country, YearMonth, Master
), months AS (SELECT Country, YearMonth, lead(YearMonth) OVER (PARTITION BY Country ORDER BY YearMonth) AS following FROM (SELECT DISTINCT Country, YearMonth FROM cells))"""


@query(f"""WITH {OBSERVED} SELECT c.Country, c.YearMonth, c.Variant, round(c.f, 9) AS f, round(CASE WHEN m.following IS NULL THEN 0 ELSE coalesce(n.f, 0) - c.f END, 9) AS labels
FROM cells c JOIN months m ON c.Country = m.Country AND c.YearMonth = m.YearMonth LEFT JOIN cells n ON n.Country = c.Country AND n.Variant = c.Variant AND n.YearMonth = m.following""")
def dpgr_observed(spark, sf_dir):
    rows = a.surveillance(spark, sf_dir).withColumnRenamed("Master", "Variant")
    return labels.dpgr_observed(rows).withColumns({"f": F.round("f", 9), "labels": F.round("labels", 9)})


TRAINED = """t AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Influenza A' WHEN 1 THEN 'Influenza B' WHEN 2 THEN 'Other' END AS kind, lang AS Country,
    CASE WHEN doc_id % 11 > 0 THEN make_date(CAST(2020 + doc_id % 3 AS INT), CAST(1 + doc_id % 7 AS INT), 1) END AS ym,
    CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'H3N2' ELSE 'A/Other' END WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'Victoria' WHEN doc_id % 3 = 1 THEN 'Yamagata' ELSE 'B/Other' END ELSE 'Unknown' END AS variant,
    regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents
), kept AS (SELECT * FROM t WHERE ym IS NOT NULL AND Country IS NOT NULL AND seq IS NOT NULL), cells AS (
  SELECT Country, ym, variant, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY Country, ym) AS DOUBLE) AS f FROM kept GROUP BY Country, ym, variant
), months AS (SELECT Country, ym, lead(ym) OVER (PARTITION BY Country ORDER BY ym) AS following FROM (SELECT DISTINCT Country, ym FROM cells)),
dpgr AS (SELECT c.Country, c.ym, c.variant, CASE WHEN m.following IS NULL THEN 0 ELSE coalesce(n.f, 0) - c.f END AS labels
  FROM cells c JOIN months m ON c.Country = m.Country AND c.ym = m.ym LEFT JOIN cells n ON n.Country = c.Country AND n.variant = c.variant AND n.ym = m.following)"""


@query(f"""WITH {TRAINED} SELECT sha256('[' || coalesce(kind, 'nan') || '][' || k.Country || '][' || k.variant || '] ' || seq) AS text_hash, round(d.labels, 9) AS labels
FROM kept k JOIN dpgr d ON k.Country = d.Country AND k.ym = d.ym AND k.variant = d.variant""")
def dpgr_training_set(spark, sf_dir):
    k = F.col("doc_id")
    d = a.table(spark, sf_dir, "documents")
    month = F.format_string("%d-%02d", 2020 + k % 3, 1 + k % 7)
    rows = d.select(
        F.when(k % 4 == 0, "Influenza A").when(k % 4 == 1, "Influenza B").when(k % 4 == 2, "Other").alias("Virus_Type"),
        F.when(k % 8 == 0, "virus (H3N2)").otherwise("virus (H10N8)").alias("Organism_Name"), F.when(k % 3 == 0, "B/Victoria/1").when(k % 3 == 1, "B/Yamagata/2").otherwise("none").alias("GenBank_Title"),
        F.col("lang").alias("Country"), F.when(k % 11 > 0, month).alias("Collection_Date"), dna.clean(F.col("text")).alias("sequence"),
    )
    return labels.training_set(rows).select(F.sha2("text", 256).alias("text_hash"), F.round("labels", 9).alias("labels"))


SEVERAL = f"""{CLEANED}, members AS (
  SELECT seq, id, id AS place FROM cleaned WHERE seq <> '' UNION ALL SELECT seq, id // 3, id + 0.5 FROM cleaned WHERE seq <> ''
), grouped AS (
  SELECT list(id ORDER BY place, id) AS ids, row_number() OVER (ORDER BY count(*) DESC, length(seq) DESC, min(place)) AS k FROM members GROUP BY seq
)"""


@query(f"""WITH {SEVERAL} SELECT Accession, Master FROM (SELECT unnest(ids) AS Accession, ids[1] AS Master, k FROM grouped) QUALIFY row_number() OVER (PARTITION BY Accession ORDER BY k DESC) = 1""")
def masters_of_several_groups(spark, sf_dir):
    r = a.records(spark, sf_dir)
    twice = r.withColumn("ord", 2 * F.col("ord")).unionByName(r.select((2 * F.col("ord") + 1).alias("ord"), F.floor(F.col("id") / 3).alias("id"), "seq"))
    return labels.masters(dedup.group_sequences(twice)).dropDuplicates(["Accession", "Master"])


@query("""WITH c AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS k FROM documents), b AS (SELECT doc_id, k, upper(text[k]) AS b, (ascii(text[k]) - 32) / 94.0::DOUBLE AS r FROM c WHERE text[k] IN ('A', 'C', 'G', 'T', 'a', 'c', 'g', 't')),
p AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS i, instr('ACGT', b) - 1 AS sym, r FROM b), m AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS off, unnest([3, 0, 1, 0, 3, 3, 0, 2]) AS msym),
x AS (SELECT doc_id, i - off AS w, r * CASE abs(sym - msym) WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS x FROM p CROSS JOIN m WHERE i >= off)
SELECT doc_id AS doc, CAST(w AS INT) AS w, round(sum(x) / 8, 6) AS score FROM x GROUP BY doc_id, w HAVING count(*) = 8 AND sum(x) / 8 > 0.5""")
def read_hits(spark, sf_dir):
    d = a.table(spark, sf_dir, "documents")
    reads = d.select(F.col("doc_id").alias("ord"), F.translate("text", "acgt", "ACGT").alias("seq"), F.col("text").alias("quality"))
    return signal.search_reads(reads, "TACATTAG", 0.5).withColumn("score", F.round("score", 6))


@query(f"""WITH {BUCKETS.replace("BETWEEN 64 PRECEDING AND 1 PRECEDING", "BETWEEN 63 PRECEDING AND CURRENT ROW")} SELECT doc, i, bucket FROM sym_""")
def centroid_buckets(spark, sf_dir):
    return signal.buckets(_symbols(spark, sf_dir), current=True).select("doc", "i", "bucket")


@query("""WITH s AS (SELECT quality AS y, CAST((doc_id * 7919) % 101 AS DOUBLE) / 101.0::DOUBLE AS q FROM labels), r AS (SELECT y, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0::DOUBLE AS rank FROM s),
c AS (SELECT CAST(count(*) FILTER (y = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (y <> 1) AS DOUBLE) AS n, sum(rank) FILTER (y = 1) AS ranks FROM r)
SELECT round((ranks - p * (p + 1) / 2) / nullif(p * n, 0), 9) AS auc FROM c""")
def auc(spark, sf_dir):
    rows = a.table(spark, sf_dir, "labels").withColumn("q", ((F.col("doc_id") * 7919) % 101).cast("double") / 101.0)
    return backtest.auc(rows, "quality", "q").select(F.round("auc", 9).alias("auc"))


@query(f"""WITH {SURVEILLANCE} SELECT CASE WHEN YearMonth < DATE '1996-07-01' THEN 'learn' ELSE 'test' END AS part, count(*) AS n, min(YearMonth) AS first_month, max(YearMonth) AS last_month FROM surveillance GROUP BY ALL""")
def month_split(spark, sf_dir):
    learn, test = labels.split_by_month(a.surveillance(spark, sf_dir), "1996-07")
    both = learn.withColumn("part", F.lit("learn")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.min("YearMonth").alias("first_month"), F.max("YearMonth").alias("last_month"))


@query(r"""WITH y AS (SELECT list_sort(list_distinct(list_concat(list(DISTINCT CAST(year(o_orderdate) AS INT)), [2031]))) AS y FROM orders), c AS (SELECT list(n ORDER BY lower(n), n) AS c FROM (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n FROM nation))
SELECT array_to_string(y, ',') AS years, array_to_string(c, ',') AS countries FROM y, c""")
def scope_with_groups(spark, sf_dir):
    n = a.table(spark, sf_dir, "nation")
    metadata = a.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("string").alias("Isolate Collection date"), F.lit(" ").alias("Geographic Location"))
    place = F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    one = F.create_map(F.lit("geo-location"), F.lit(""), F.lit("geo_location"), F.concat(place, F.lit(": north")), F.lit("year"), F.lit("2031"))
    groups = n.select(F.create_map("n_name", one).alias("metadata_by_accession"))
    found = scope.infer_all(metadata, groups)
    return found.select(joined("years").alias("years"), joined("countries").alias("countries"))


TREND_FORMAT = "'%-20s  %-18s  %7.4f  %7.4f  %+8.4f  %.4f@%s  %s', substr(Country, 1, 20), substr(Accession, 1, 18), Start_Prob, End_Prob, Delta, Peak_Prob, Peak_Label, ''"


@query(f"""WITH {TRENDS}, up AS (SELECT row_number() OVER (ORDER BY Delta DESC, Country, Accession) - 1 AS k, * FROM growth), down AS (SELECT row_number() OVER (ORDER BY Delta, Country, Accession) - 1 AS k, * FROM growth),
dom AS (SELECT row_number() OVER (ORDER BY Country, Year, Month) - 1 AS k, * FROM (SELECT *, row_number() OVER (PARTITION BY Country, Year, Month ORDER BY Probability DESC, Accession) AS n FROM e) WHERE n = 1),
lines AS (
  SELECT 0 AS part, unnest(range(0, 6)) AS line_no, unnest(['Rows analyzed: ' || format('{{:,}}', (SELECT count(*) FROM e)), 'Country filter: All Countries', '', 'FASTEST RISING STRAINS', 'Country              Accession           Start    End      Delta    Peak', repeat('-', 82)]) AS line
  UNION ALL SELECT 1, k, printf({TREND_FORMAT}) FROM up WHERE k < 10
  UNION ALL SELECT 2, unnest(range(0, 4)), unnest(['', 'FASTEST FALLING STRAINS', 'Country              Accession           Start    End      Delta    Peak', repeat('-', 82)])
  UNION ALL SELECT 3, k, printf({TREND_FORMAT}) FROM down WHERE k < 10
  UNION ALL SELECT 4, unnest(range(0, 2)), unnest(['Country              Date      Accession           Probability  Title', repeat('-', 100)])
  UNION ALL SELECT 5, k, printf('%-20s  %d-%02d  %-18s  %10.4f  ', substr(Country, 1, 20), Year, Month, substr(Accession, 1, 18), Probability) FROM dom WHERE k < 250
  UNION ALL SELECT 6, 0, '... ' || format('{{:,}}', count(*) - 250) || ' more rows not shown' FROM dom HAVING count(*) > 250
  UNION ALL SELECT 7, 0, 'Analyzed ' || format('{{:,}}', count(*)) || ' forecast rows across ' || format('{{:,}}', count(DISTINCT Country)) || ' countries and ' || format('{{:,}}', count(DISTINCT Accession)) || ' strains.' FROM e
) SELECT CAST(part AS INT) AS part, CAST(line_no AS INT) AS line_no, line FROM lines""")
def growth_full_report(spark, sf_dir):
    return growth.full_report(a.forecast_rows(spark, sf_dir).withColumn("Month", F.col("Day")))


@query("""SELECT item_id, CAST(length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) AS BIGINT) AS n, CAST((length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) + 3) // 4 AS BIGINT) AS bytes FROM benchmark""")
def two_bit_sizes(spark, sf_dir):
    """The two-bit rows of codec_sizes."""
    from strainlake.operators.codec import sizes

    return sizes(a.table(spark, sf_dir, "benchmark"), "item_id", "text").where("method = 'two_bit'").select("item_id", "n", "bytes")


@query(f"""WITH {CLEANED} SELECT sha256(seq) AS seq_hash, id AS ord, id, first_value(id) OVER (PARTITION BY seq ORDER BY id) AS Master FROM cleaned WHERE seq <> ''""")
def group_members(spark, sf_dir):
    return dedup.members(a.records(spark, sf_dir))


@query("""WITH d AS (SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) - 1 AS INT) AS Country_ID FROM (SELECT DISTINCT n_name FROM nation WHERE n_nationkey > 3))
SELECT s_suppkey, Country_ID FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN d USING (n_name)""")
def encoded_countries(spark, sf_dir):
    n = a.table(spark, sf_dir, "nation")
    rows = a.table(spark, sf_dir, "supplier").join(n, F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "n_name")
    return labels.with_codes(rows, "n_name", "Country_ID", labels.encode(n.where("n_nationkey > 3"), "n_name", "Country_ID")).select("s_suppkey", "Country_ID")


@query(r"""SELECT event_id, regexp_replace(regexp_replace(regexp_replace(t, '\x1b\[[0-?]*[ -/]*[@-~]', '', 'g'), '[\x00-\x08\x0A-\x1F]', '', 'g'), '^\s+|\s+$', '', 'g') AS line,
  least(try_cast(nullif(regexp_extract(t, '(\d{1,3})%', 1), '') AS INT), 100) AS percent
FROM (SELECT event_id, chr(27) || '[2K' || chr(13) || '  ' || event_type || chr(27) || '[1;32m ' || (event_id % 250) || CASE WHEN event_id % 2 = 0 THEN '%' ELSE '' END || chr(9) || 'x' || chr(10) || ' ' AS t FROM events)""")
def console_lines(spark, sf_dir):
    e = a.table(spark, sf_dir, "events")
    mark = F.when(F.col("event_id") % 2 == 0, "%").otherwise("")
    t = F.concat(F.lit("\x1b[2K\r  "), F.col("event_type"), F.lit("\x1b[1;32m "), (F.col("event_id") % 250).cast("string"), mark, F.lit("\tx\n "))
    return e.select("event_id", text.plain_console(t).alias("line"), text.percent(t).alias("percent"))
