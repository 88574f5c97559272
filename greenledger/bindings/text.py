"""Text, URL, date and curation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenledger import rules
from greenledger.bindings.registry import any_of, in_list, q, query, re_all, table
from greenledger.functions import scoring as S, text as T
from greenledger.operators import digest

AS_OF = "2024-06-30"


def sql_space(x: str) -> str:
    return "trim(" + re_all(f"coalesce({x}, '')", T.BLANK + "+", " ") + ")"


def sql_clean(x: str) -> str:
    return sql_space(re_all(re_all(f"coalesce({x}, '')", T.CITATION), T.INVISIBLE))


def sql_title(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({sql_clean(x)}, {q(T.DATE_PREFIX)}, ''), {q(T.DECORATION)}, '')"
    return sql_space(f"trim({bare}, {q(rules.TITLE_EDGE_CHARS)})")


def sql_norm(x: str) -> str:
    out = f"lower({sql_title(x)})"
    for token in rules.TITLE_TOKENS:
        out = f"replace({out}, {q(token)}, '')"
    return re_all(out, T.PUNCTUATION)


def sql_number(x: str) -> str:
    return re_all(f"regexp_extract({sql_clean(x)}, {q(T.DOCUMENT_NUMBER)})", T.PUNCTUATION)


# A subject for the driver's documents: word tables like the default ones, in the tables' languages.
CORPUS = rules.RelevanceRules(
    positive={"tion the": 6, "erhe": 4, "ouerre": 3, "queque": 5, "schein": 4, "ción": 3, "the": 2, "der": 2, "les": 1},
    negative={"token": 10, "!!": 6, "%%%": 5, "@": 4, "free": 3},
    implementation=["project", "on the", "une", "ein"],
    national_terms=["and the", "que la"],
    on_topic=["th", "que", "ich", "os"],
    categories=[
        ("技术与设施", ["erthe", "schheit", "auxle"]),
        ("数据与评估", ["ndthe", "enaux", "ichver"]),
        ("项目与投融资", ["tionthe", "queleau"]),
        ("园区建设", ["of the", "de la", "von der"]),
        ("政策与标准", ["the", "les", "die", "los"]),
    ],
    guards={"项目与投融资": ["tion", "eau"]},
    minimum_score=6,
)
THEMES = {"计量与能碳管理": ["erthe", "auxle"], "设备与系统节能": ["ndthe", "schheit"], "清洁供能": ["tionthe"], "资源循环": ["queque", "ción"], "交通与物流": ["!!"], "项目与资金": ["@", "token"]}


def doc_records(spark, d):
    """Documents as collected records: a label as title, the whole text as summary."""
    c = F.col
    return table(spark, d, "documents").select(
        "doc_id", F.concat_ws(" ", "source", "lang").alias("title"), c("text").alias("summary"), c("source").alias("publisher"),
        F.when(c("lang") == "en", "国家").when(c("lang") == "fr", "园区").otherwise("").alias("source_scope"),
        F.when(c("lang") == "es", "数据与评估").otherwise("").alias("default_category"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(c("n_chars"), F.lit(60)).cast("int")).cast("string").alias("published_date"),
        F.concat(F.lit("https://docs.example.org/"), c("source"), F.lit("/"), c("doc_id").cast("string")).alias("url"), c("lang").alias("region"),
    )


SQL_DOCS = """docs AS (SELECT doc_id, source || ' ' || lang AS title, text AS summary, source AS publisher,
  CASE lang WHEN 'en' THEN '国家' WHEN 'fr' THEN '园区' ELSE '' END AS scope, CASE WHEN lang = 'es' THEN '数据与评估' ELSE '' END AS default_category,
  strftime(DATE '2024-01-01' + CAST(n_chars % 60 AS INTEGER), '%Y-%m-%d') AS published_date,
  'https://docs.example.org/' || source || '/' || doc_id AS url, lang AS region, lang, source, text FROM documents)"""


@query("text_clean", f"SELECT doc_id, sha256({sql_clean('text')}) AS clean_sha, length({sql_clean('text')}) AS n, sha256({sql_title('text')}) AS title_sha FROM documents")
def text_clean(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("t"), T.clean_title(F.col("text")).alias("title"))
    return docs.select("doc_id", F.sha2("t", 256).alias("clean_sha"), F.length("t").alias("n"), F.sha2("title", 256).alias("title_sha"))


@query("title_norm", f"SELECT doc_id, sha256({sql_norm('text')}) AS norm_sha, length({sql_norm('text')}) AS n FROM documents")
def title_norm(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.normal_title(F.col("text")).alias("t"))
    return docs.select("doc_id", F.sha2("t", 256).alias("norm_sha"), F.length("t").alias("n"))


@query("content_hash", "SELECT doc_id, sha256(coalesce(source, '') || '|' || coalesce(text, '') || '|' || coalesce(lang, '')) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sha_hex(F.col("source"), F.col("text"), F.col("lang")).alias("content_hash"))


@query("canonical_url", f"""WITH a AS (SELECT page_id, url, regexp_replace(trim(url), '^http://', 'https://') AS v FROM pages),
b AS (SELECT page_id, url, lower(regexp_extract(v, '^https://([^/?#]*)', 1)) AS host, {re_all("regexp_extract(v, '^https://[^/?#]*([^?#]*)', 1)", '/+', '/')} AS path,
  list_filter(string_split(regexp_extract(v, '[?]([^#]*)', 1), '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN {in_list(rules.TRACKING_PARAMS)}) AS kept FROM a)
SELECT page_id, url, 'https://' || host || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM b""")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", "url", T.canonical_url(F.col("url")).alias("canonical_url"))


DOMAINS = ["example.com", "ththth.example.net", "example.org"]


@query("domain_allow", f"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, host, {' OR '.join(f"host = {q(x)} OR ends_with(host, {q('.' + x)})" for x in DOMAINS)} AS allowed FROM h""")
def domain_allow(spark, d):
    domains = F.array(*[F.lit(x) for x in DOMAINS])
    return table(spark, d, "pages").select("page_id", T.url_host(F.col("url")).alias("host"), T.host_allowed(F.col("url"), domains).alias("allowed"))


@query("date_extract", f"""SELECT o_orderkey, strftime(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CAST(o_orderdate AS DATE)
  WHEN o_orderpriority <> '5-LOW' AND year(o_orderdate) >= 2000 THEN CAST(o_orderdate AS DATE) ELSE DATE '{AS_OF}' END, '%Y-%m-%d') AS found FROM orders""")
def date_extract(spark, d):
    day, p = F.col("o_orderdate"), F.col("o_orderpriority")
    told = (
        F.when(p == "1-URGENT", F.concat(F.lit("due "), F.date_format(day, "yyyy-M-d")))
        .when(p == "2-HIGH", F.concat(F.lit("发布日期："), F.date_format(day, "yyyy年M月d日")))
        .when(p == "3-MEDIUM", F.concat(F.lit("ref"), F.date_format(day, "yyyyMMdd")))
        .when(p == "4-NOT SPECIFIED", F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise("no date given")
    )
    found = T.first_date(told, F.lit(""), as_of=F.lit(AS_OF))
    return table(spark, d, "orders").select("o_orderkey", found.cast("string").alias("found"))


@query("doc_number", """SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN '发改环资〔' || year(o_orderdate) || '〕' || o_orderkey || '号' ELSE '' END AS number FROM orders""")
def doc_number(spark, d):
    year = F.date_format("o_orderdate", "yyyy")
    title = F.concat(F.lit("关于开展 试点的通知, 发改环资〔 "), year, F.lit("〕 "), F.col("o_orderkey").cast("string"), F.lit(" 号 (试行)"))
    return table(spark, d, "orders").select("o_orderkey", T.document_number(F.col("o_orderpriority"), title).alias("number"))


@query("event_key", f"""WITH {SQL_DOCS} SELECT doc_id, 'EVT-' || substr(sha256({sql_norm('text')} || '|' || published_date), 1, 16) AS event_key FROM docs""")
def event_key(spark, d):
    docs = doc_records(spark, d)
    return docs.select("doc_id", T.event_key(F.col("summary"), F.lit(""), F.col("published_date")).alias("event_key"))


@query("numeric_clues", f"""SELECT source, lang, count(*) AS records, count(*) FILTER (WHERE regexp_matches(text, {q(T.QUANTITY)})) AS with_quantity FROM documents GROUP BY source, lang""")
def numeric_clues(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("records"), F.count_if(T.has_quantity(F.col("text"))).alias("with_quantity"))


PUBLISHERS = [("BUILDING", "国家能源局", "国家"), ("MACHINERY", "某经济技术开发区", "园区"), ("FURNITURE", "广东省发展改革委", "地方"), ("AUTOMOBILE", "某县人民政府", "地方")]


@query("source_level", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN '行业' " + " ".join(f"WHEN c_mktsegment = '{s}' THEN '{lv}'" for s, _, lv in PUBLISHERS) + " ELSE '其他' END AS level FROM customer")
def source_level(spark, d):
    name = F.col("c_name")
    for segment, publisher, _ in PUBLISHERS:
        name = F.when(F.col("c_mktsegment") == segment, publisher).otherwise(name)
    scope = F.when(F.col("c_nationkey") == 3, " 行业 ").otherwise("other")
    return table(spark, d, "customer").select("c_custkey", S.source_level(name, scope).alias("level"))


@query("lenient_cast", f"""SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN p_retailprice * 10 WHEN 'LARGE' THEN p_retailprice END AS number,
  CASE p_type WHEN 'SMALL' THEN CAST(trunc(p_retailprice * 10) AS INTEGER) WHEN 'LARGE' THEN CAST(trunc(p_retailprice) AS INTEGER) ELSE 7 END AS whole,
  p_type IN ('PROMO', 'SMALL') AS flag, CASE p_type WHEN 'LARGE' THEN p_retailprice WHEN 'MEDIUM' THEN 0.0 END AS board FROM part""")
def lenient_cast(spark, d):
    k = F.col("p_type")
    text = (
        F.when(k == "SMALL", F.concat(F.lit(" "), F.format_number(F.col("p_retailprice") * 10, 2), F.lit(" ")))
        .when(k == "LARGE", F.col("p_retailprice").cast("string")).when(k == "MEDIUM", "").when(k == "PROMO", "nan").otherwise("about 70")
    )
    word = F.when(k == "PROMO", " Yes").when(k == "SMALL", "已确认").otherwise("no")
    return table(spark, d, "part").select("p_partkey", T.lenient_double(text).alias("number"), T.lenient_int(text, 7).alias("whole"), T.is_true(word).alias("flag"), T.board_number(text, blank_is_zero=True).alias("board"))


def sql_hits(body: str, r: rules.RelevanceRules) -> list[tuple[str, int, str]]:
    rows = [(t, w, rules.REASON_HIT % t) for t, w in r.positive.items()]
    return rows + [(t, -w, rules.REASON_WEAK % t) for t, w in r.negative.items()]


def sql_relevance(body: str, level: str, r: rules.RelevanceRules) -> tuple[str, str]:
    """(score, reasons) expressions over a lower-cased body and a level column."""
    hits = sql_hits(body, r)
    park, national = f"{level} = '园区'", f"({level} = '国家' AND {any_of(body, r.national_terms)})"
    impl, off = any_of(body, r.implementation), f"NOT {any_of(body, r.on_topic)}"
    score = " + ".join(f"CASE WHEN contains({body}, {q(t)}) THEN {w} ELSE 0 END" for t, w, _ in hits)
    score += f" + CASE WHEN {impl} THEN 2 ELSE 0 END + CASE WHEN {park} OR {national} THEN 2 ELSE 0 END - CASE WHEN {off} THEN 5 ELSE 0 END"
    items = [f"CASE WHEN contains({body}, {q(t)}) THEN {q(m)} END" for t, _, m in hits]
    items += [f"CASE WHEN {impl} THEN {q(rules.REASON_IMPLEMENTATION)} END", f"CASE WHEN {park} THEN {q(rules.REASON_PARK)} WHEN {national} THEN {q(rules.REASON_NATIONAL)} END", f"CASE WHEN {off} THEN {q(rules.REASON_OFF_TOPIC)} END"]
    kept = f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
    return f"CAST({score} AS INTEGER)", f"CASE WHEN len({kept}) = 0 THEN {q(rules.REASON_NONE)} ELSE array_to_string({kept}[1:7], '；') END"


SQL_LEVEL = "CASE WHEN scope <> '' THEN scope ELSE '其他' END"
SQL_BODY = f"lower({sql_title('title')} || ' ' || {sql_clean('summary')})"
_score, _reasons = sql_relevance("body", "level", CORPUS)


def sql_category(body: str, default: str, r: rules.RelevanceRules) -> str:
    parts = []
    for name, terms in r.categories:
        guard = f" AND {any_of(body, r.guards[name])}" if name in r.guards else ""
        parts.append(f"WHEN {any_of(body, terms)}{guard} THEN {q(name)}")
    return f"CASE {' '.join(parts)} WHEN {default} IN {in_list(rules.DEFAULTABLE_CATEGORIES)} THEN {default} ELSE {q(rules.CATCH_ALL_CATEGORY)} END"


@query("relevance_score", f"""WITH {SQL_DOCS}, b AS (SELECT doc_id, {SQL_BODY} AS body, {SQL_LEVEL} AS level FROM docs)
SELECT doc_id, {_score} AS relevance_score, {_reasons} AS relevance_reason FROM b""")
def relevance_score(spark, d):
    docs = doc_records(spark, d).withColumns({"title": T.clean_title(F.col("title")), "summary": T.clean_text(F.col("summary")), "level": S.source_level(F.col("publisher"), F.col("source_scope"))})
    return S.add_relevance(docs, "title", "summary", "level", CORPUS).select("doc_id", "relevance_score", "relevance_reason")


@query("category_first_match", f"""WITH {SQL_DOCS} SELECT doc_id, {sql_category(f"({sql_title('title')} || ' ' || {sql_clean('summary')})", 'default_category', CORPUS)} AS category FROM docs""")
def category_first_match(spark, d):
    docs = doc_records(spark, d)
    body = F.concat_ws(" ", T.clean_title(F.col("title")), T.clean_text(F.col("summary")))
    return docs.withColumn("_b", body).select("doc_id", S.category(F.col("_b"), F.col("default_category"), CORPUS).alias("category"))


SQL_CURATED = f"""{SQL_DOCS},
b AS (SELECT *, {SQL_BODY} AS body, {sql_title('title')} || ' ' || {sql_clean('summary')} AS plain, {sql_clean('summary')} AS clean_summary, {SQL_LEVEL} AS level, {sql_norm('title')} AS norm FROM docs),
s AS (SELECT *, {_score} AS relevance_score, {_reasons} AS relevance_reason, {sql_category('plain', 'default_category', CORPUS)} AS category FROM b),
curated AS (SELECT *, CASE WHEN relevance_score >= {CORPUS.minimum_score} THEN 'include' ELSE 'exclude' END AS relevance_status,
  'EVT-' || substr(sha256(norm || '|' || published_date), 1, 16) AS event_key,
  relevance_score + CASE WHEN level IN ('国家', '地方', '园区') THEN 2 ELSE 0 END + CASE WHEN length(clean_summary) >= 80 THEN 2 WHEN length(clean_summary) >= 40 THEN 1 ELSE 0 END + 2 AS quality_score FROM s)"""
_notes = " ".join(f"WHEN category = {q(k)} THEN {q(v)}" for k, v in rules.USAGE_NOTES.items())


@query("curate_record", f"""WITH {SQL_CURATED} SELECT doc_id, category, level AS source_level, relevance_score, relevance_status, relevance_reason, event_key, quality_score,
  CASE WHEN relevance_status = 'exclude' THEN {q(rules.EXCLUDED_NOTE)} {_notes} END AS why FROM curated""")
def curate_record(spark, d):
    out = S.curate(doc_records(spark, d), CORPUS)
    return out.select("doc_id", "category", "source_level", "relevance_score", "relevance_status", "relevance_reason", "event_key", "quality_score", "why")


@query("theme_counts", "WITH " + SQL_DOCS + " SELECT theme, count(*) AS value FROM (" + " UNION ALL ".join(f"SELECT {q(n)} AS theme FROM docs WHERE {any_of('text', t)}" for n, t in THEMES.items()) + ") GROUP BY theme")
def theme_counts(spark, d):
    return digest.theme_counts(doc_records(spark, d), F.col("summary"), THEMES)
