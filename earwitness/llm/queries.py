"""Registered queries of this package, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earwitness.llm import caps, decontaminate, html, jaccard, language, packing, phrases, pii, quality, secrets, toxicity, urls, whitening
from earwitness.llm.common import crc_fold, table
from earwitness.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query("op9_wu_manber_decontamination", """
WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(0), ' ', 'g'), '[^\\x01-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(0), ' ', 'g'), '[^\\x01-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT item, least(13, len(ws)) AS n, unnest([ws[i:i + least(13, len(ws)) - 1] for i in range(1, len(ws) - least(13, len(ws)) + 2)]) AS win FROM b WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS pos, unnest([ws[i:i + n - 1] for i in range(1, len(ws) - n + 2)]) AS win FROM w, lens WHERE len(ws) >= n),
h AS (SELECT DISTINCT doc_id, pos, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document, and which documents they contaminate."""
    found = decontaminate.benchmark_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", F.col("__out.n_words").alias("n_words"), decontaminate.n_hit().alias("n_hit"), F.size("__out.items").cast("long").alias("n_items"),
        _sha256(F.array_join("__out.items", ",")).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


@query("op7_parity_sketch_jaccard", """
WITH RECURSIVE w AS (SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws] ELSE [ws[i:i + 2] for i in range(1, len(ws) - 1)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      WHERE a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(na.n) + any_value(nb.n) - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents at 3-word shingles and a Jaccard similarity of 0.9."""
    return jaccard.components(table(spark, sf_dir, "documents"), "doc_id", words=3, percent=90)


@query("op10_random_indexing_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(crc_fold("doc_id", quality.PARAMS.folds) == quality.PARAMS.held_out, F.lit(False))
    return quality.scored(docs, model, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), F.col("__out.score").alias("score"), quality.accepted().cast("int").alias("predicted"))


@query("op3_randomness_secrets")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base patterns, and random-looking strings beyond them."""
    found = cut_lineage(secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]))
    spans = secrets.all_spans(secrets.thresholds(found))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind != "random")
    return found.select("doc_id", spans.alias("spans")).select(
        "doc_id", count("assign"), count("access"), count("hex"), _sha256(secrets.written(base)).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


@query("op8_vector_best_fit")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into sequences of 4096 tokens."""
    return packing.packed_documents(table(spark, sf_dir, "documents"), "doc_id")


@query("op1_rank_order_language")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False))
    learned = language.profiles(docs.where(~held_out).select(F.col("doc_id").alias("id"), "lang", "text"))
    found = language.predicted(docs.select("doc_id", "text"), learned, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), F.col("__out.lang").alias("lang_pred"), F.col("__out.score").alias("score"))


@query("op4_tree_scored_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"])
    return found.select("page_id", "url", F.col("__out.text").alias("text"), F.char_length("__out.text").cast("long").alias("n_chars"))


#: Rules of the contract: (verdict, host/path).
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _rank_sql(name: str, src: str, dst: str, seed: str, p: urls.RankParams = urls.PARAMS) -> str:
    """CTEs of the same PageRank, round by round."""
    parts = [f"{name}_w AS (SELECT {src} AS s, {dst} AS d, CAST({p.damping} AS DOUBLE) / count(*) OVER (PARTITION BY {src}) AS w FROM edges)",
             f"{name}_0 AS (SELECT host, {1 - p.damping} * {seed} / sum({seed}) OVER () AS r FROM shares WHERE {seed} > 0)"]
    for k in range(1, p.rounds + 1):
        parts.append(f"{name}_{k} AS MATERIALIZED (SELECT host, sum(r) AS r FROM (SELECT * FROM {name}_0 UNION ALL SELECT d, w * r FROM {name}_w JOIN {name}_{k - 1} ON host = s) GROUP BY host)")
    return ", ".join(parts)


def _host_sql(url: str) -> tuple[str, str]:
    """Host and path of a url."""
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    return f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


_URL_SQL = f"""
WITH rules(verdict, domain, prefix, rule) AS (VALUES {", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in URL_RULES)}),
placed AS (SELECT page_id, coalesce({_host_sql("url")[0]}, '') AS host, coalesce({_host_sql("url")[1]}, '') AS path, html FROM pages),
fits AS (SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS k
         FROM placed p JOIN rules r ON (p.host = r.domain OR ends_with(p.host, '.' || r.domain)) AND starts_with(p.path, r.prefix)),
ruled AS (SELECT p.page_id, p.host, p.path, f.rule, f.verdict FROM placed p LEFT JOIN fits f ON p.page_id = f.page_id AND f.k = 1),
shares AS (SELECT host, avg(CAST(verdict = 'allow' AS INT)) AS good, 1 - avg(CAST(verdict = 'allow' AS INT)) AS bad FROM ruled WHERE rule IS NOT NULL GROUP BY host),
hrefs AS (SELECT DISTINCT host, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS href FROM placed),
links AS (SELECT host AS src, CASE WHEN starts_with(href, '//') THEN 'x:' || href ELSE href END AS href FROM hrefs),
edges AS (SELECT DISTINCT src, {_host_sql("href")[0]} AS dst FROM links WHERE src <> '' AND {_host_sql("href")[0]} NOT IN ('', src)),
{_rank_sql("t", "src", "dst", "good")}, {_rank_sql("x", "dst", "src", "bad")},
worse AS (SELECT x.host FROM x_{urls.PARAMS.rounds} x LEFT JOIN t_{urls.PARAMS.rounds} t USING (host) WHERE round(x.r, 12) > coalesce(round(t.r, 12), 0))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM worse) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""


@query("op5_link_graph_urls", _URL_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


@query("op6_spherical_cap_duplicates", """
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings),
g AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.98 * a.n * b.n),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of one label at a cosine of 0.98."""
    return caps.linked(table(spark, sf_dir, "embeddings"))

#: The key of the registered query; a user passes a secret of their own.
SURROGATE_KEY = b"registered query"


@query("op2_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return pii.pseudonymised(table(spark, sf_dir, "documents"), SURROGATE_KEY)


@query("op11_recurrent_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(crc_fold("doc_id", toxicity.PARAMS.folds) == toxicity.PARAMS.held_out, F.lit(False))
    score = F.col("__out.score")
    return toxicity.scored(docs, net, ["doc_id"]).select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= toxicity.PARAMS.accept).cast("int").alias("predicted"))


@query("op12_cholesky_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding, whitened, a row for each of the first 32 components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"), "vec_id")


@query("op13_son_phrases", """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, d, unnest(regexp_split_to_array(x, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, [g for g in regexp_split_to_array(piece, '[ \\x09]') if g <> ''] AS ws FROM p),
total AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') for i in range(1, len(ws) - k + 2)]) AS phrase FROM w, range(1, 6) r(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
parts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f),
gone AS (SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, a, array_to_string(ws[1:k - 1], ' ') AS phrase FROM parts WHERE k > 2 UNION ALL SELECT lang, a, array_to_string(ws[2:k], ' ') FROM parts WHERE k > 2) s JOIN f USING (lang, phrase) WHERE s.a >= f.a),
cuts AS (SELECT lang, phrase, a, c, array_to_string(ws[1:c], ' ') AS front, array_to_string(ws[c + 1:k], ' ') AS rest FROM parts, range(1, 5) q(c) WHERE c < k),
scored AS (SELECT c.lang, c.phrase, c.a, c, x.a AS l, y.a AS r, n, (1000 * c.a * n) // (x.a * y.a) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.front JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN total ON total.lang = c.lang),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM worst w WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = w.lang AND gone.phrase = w.phrase))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language of the documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))
