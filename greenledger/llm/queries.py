"""The operators as queries over the driver tables, and SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from greenledger.llm import alignment, common as C, langid, mixing, near_dedup, pii, posting_ann, ppm, ranked_search, suffix_dedup, toxicity, url_rules, winnowing
from greenledger.llm.line_index import LineIndex

QUERIES = {}
ORACLE: dict[str, str] = {}

LISTED = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digest(values: Column) -> Column:
    return F.sha2(F.array_join(values, ",").cast("binary"), 256)


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(0, length(h) // 2 - 49), lambda i: substr(h, 2 * i + 1, 100))) AS s, generate_subscripts(list_transform(range(0, length(h) // 2 - 49), lambda i: i), 1) - 1 AS i FROM d WHERE length(h) >= 100),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS dup FROM w),
b AS (SELECT doc_id, unnest(range(0, length(h) // 2)) AS i, unnest(list_transform(range(0, length(h) // 2), lambda i: substr(h, 2 * i + 1, 2))) AS x FROM d),
g AS (SELECT b.doc_id, b.i, x, coalesce(max(CAST(dup AS INT)) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.i = b.i),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
a AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, sha256(unhex(coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256 FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""


@query("op1_suffix_dedup", SUFFIX_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return found.select(C.given_id().alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


MIX_SQL = """
WITH n AS (SELECT coalesce(source, '') AS source, count(*) AS docs FROM documents GROUP BY 1),
r AS (SELECT source, sqrt(docs) / sum(sqrt(docs)) OVER () * sum(docs) OVER () / docs AS rate FROM n),
m AS (SELECT source, greatest(ceil(rate / 8), 1)::BIGINT AS parts, rate / greatest(ceil(rate / 8), 1) AS mean FROM r),
k AS (SELECT source, parts, mean, unnest(range(0, 65)) AS k FROM m),
c AS (SELECT source, parts, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below FROM k),
u AS (SELECT doc_id, m.source, unnest(range(1, parts + 1)) AS part FROM documents d JOIN m ON coalesce(d.source, '') = m.source),
h AS (SELECT doc_id, source, part, ('0x' || substr(md5('1:' || doc_id || ':' || part), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM u),
p AS (SELECT h.doc_id, h.source, h.part, count(*) FILTER (h.u >= c.below AND c.k < 64) AS v FROM h JOIN c ON c.source = h.source GROUP BY ALL),
t AS (SELECT doc_id, source, sum(v)::BIGINT AS copies FROM p GROUP BY ALL)
SELECT d.doc_id, t.source, d.lang, d.n_chars, sha256(coalesce(d.text, '')) AS text_sha256, copies, unnest(range(1, copies + 1)) AS copy FROM t JOIN documents d ON d.doc_id = t.doc_id AND coalesce(d.source, '') = t.source WHERE copies > 0
"""


@query("op2_poisson_mix", MIX_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Sources in proportion to the square root of their size, as many documents as there are.

    Whole documents are replicated and dealt out; what is returned is taken from the rows behind the shuffle, the text as its hash.
    """
    mixed = mixing.mix(table(spark, folder, "documents"))
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "lang", "n_chars", sha, F.col("draw.copies").alias("copies"), F.col("draw.copy").alias("copy"))


@query("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = C.remainder(F.col("doc_id"), 3) == 1
    model = langid.train(docs, learn=~held)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs with the label of the document that their last path segment names: block what is of low quality or toxic."""
    number = F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)(?:\\.html?)?/?(?:[?#].*)?$', 1) AS BIGINT)")
    bad = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("label"))
    return pages.select("url", number.alias("doc_id")).join(bad, "doc_id").select("url", "label")


@query("op4_url_rules")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = url_rules.mine(labelled_pages(pages, table(spark, folder, "labels")))
    return url_rules.judge(pages, rules, LISTED).select("page_id", "filter.host", "filter.path", "filter.rule", "filter.verdict")


LINE_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, trim({LOWER.replace("coalesce(text, '')", "line")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
h AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, h.first IS NOT NULL AND h.first < doc_id AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""


@query("op5_line_index", LINE_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches that together are the table are inserted one after the other; the second is deleted and inserted again."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    first, second = docs.filter(early), docs.filter(~early)
    index = LineIndex.empty(spark).insert(first).insert(second)
    index = index.delete(second.select("doc_id")).insert(second)
    found = index.clean(docs, refs=index.refs)
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.coalesce("lines.kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


@query("op6_near_dedup", NEAR_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.near_groups(table(spark, folder, "documents"), width=3, percent=85)
    component = F.coalesce("component.id", "_id")
    return found.select(C.given_id().alias("doc_id"), "n_shingles", F.nullif(component, F.lit(C.NO_ID)).alias("component_id"), (F.col("_id") == component).alias("kept"))


@query("op7_posting_ann")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return posting_ann.search(table(spark, folder, "embeddings"), F.col("_id") % 20 == 0, k=20)


WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
WINNOW_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format(LOWER)} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 11, 2)), lambda i: array_to_string(w[i : i + 12], ' '))) AS g FROM b WHERE len(w) > 0),
z AS (SELECT DISTINCT n FROM g),
t AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS g, generate_subscripts(range(1, len(w) - n + 2), 1) AS i FROM d, z WHERE len(w) >= n),
h AS (SELECT DISTINCT t.doc_id, t.i, t.n, g.item_id FROM t JOIN g ON g.n = t.n AND g.g = t.g),
x AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""


def words_hit(found: Column) -> Column:
    return F.aggregate(found["ranges"], F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])


def is_contaminated(found: Column) -> Column:
    """A twentieth of the words or more are benchmark words."""
    return (words_hit(found) > 0) & (20 * words_hit(found) >= found["n_words"])


@query("op8_winnowing", WINNOW_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = winnowing.contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    items = F.array_sort(F.transform("found.items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "found.n_words", words_hit(F.col("found")).alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        digest(items).alias("items_sha256"), is_contaminated(F.col("found")).alias("contaminated"),
    )


@query("op9_ppm_score")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = ppm.score_texts(docs, train=C.remainder(F.col("doc_id"), 10) != 0)
    return scored.select(C.given_id().alias("doc_id"), (C.remainder(C.given_id(), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op10_personal_data")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    texts = lambda spans: F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(C.given_id().alias("doc_id"), *map(count, pii.KINDS), digest(texts(base)).alias("base_sha256"), F.array_join(texts(F.col("spans")), ",").alias("spans"))


@query("op11_token_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = alignment.link_scores(alignment.align(table(spark, folder, "documents")))
    notation = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select(C.given_id().alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", notation.alias("groups_sha256"))


TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{TERMS}') AS w FROM documents),
t AS (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d WHERE len(w) > 0),
z AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '{TERMS}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
f AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
g AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, z GROUP BY term, docs),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score FROM q JOIN f USING (term) JOIN g USING (term), z GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50
"""


@query("op12_ranked_search", SEARCH_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, folder, "documents"))
    return ranked_search.search(index, table(spark, folder, "benchmark")).select("item_id", "rank", C.given_id().alias("doc_id"), "score")


@query("op13_toxicity")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = table(spark, folder, "documents"), C.remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, table(spark, folder, "labels").filter(~held))
    return toxicity.score_texts(docs, model).select(C.given_id().alias("doc_id"), (C.remainder(C.given_id(), 5) == 0).alias("held_out"), "score", "predicted", "hits")
