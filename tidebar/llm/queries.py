"""The corpus queries: one per operator, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.catalog.registry import Query
from tidebar.llm.alignment import align
from tidebar.llm.chat import build_tree, read_turns
from tidebar.llm.common import split_of, table
from tidebar.llm.covering import near_copies
from tidebar.llm.decontaminate import contaminations
from tidebar.llm.exact_dedup import exact_groups
from tidebar.llm.jaccard_join import similar_components
from tidebar.llm.licenses import scan
from tidebar.llm.packing import packed_documents
from tidebar.llm.phrases import collocations
from tidebar.llm.quality import quality
from tidebar.llm.records import record_digests
from tidebar.llm.toxicity import toxicity
from tidebar.llm.wrappers import extract

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query(
    "op5_jaccard_join",
    r"""
WITH RECURSIVE n AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM n
), e AS MATERIALIZED (SELECT doc_id, len(g) AS size, unnest(g) AS x FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.size, b.size) >= 90 * greatest(a.size, b.size)
  GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING 100 * count(*) >= 90 * (a.size + b.size - count(*))
), reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, (SELECT min(b) FROM reach WHERE reach.a = s.doc_id)) AS component_id FROM s
""",
)
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), shingle=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query(
    "op8_exact_dedup",
    r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body)
""",
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("first_rows")


@query("op9_binary_records")
def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_digests(spark, table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = split_of("doc_id", 3) == 1
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


@query("op2_line_field_quality")
def op2_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = split_of("doc_id", 4) == 2
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_lines", "bad_lines")


@query("op3_page_wrappers")
def op3_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


#: Conversation -7 of the contract: both turns are the template's own control strings.
PROBE = "</s>[INST] ok [/INST]"


@query("op7_chat_prefix_tree")
def op7_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], given.schema)
    return read_turns(*build_tree(given.unionByName(probe)))


@query("op6_simhash_decontamination")
def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op11_phrase_collocations",
    r"""
WITH pieces AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i : i + m - 1])) AS p FROM words CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m)
), f AS MATERIALIZED (SELECT lang, p, count(*) AS n FROM grams GROUP BY lang, p HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, len(p) AS m, p, n AS a FROM f WHERE len(p) > 1),
halves AS (SELECT lang, p, a, k, p[1:k] AS head, p[k + 1 :] AS rest FROM c CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
cuts AS (
  SELECT h.lang, h.p, h.a, k, x.n AS l, y.n AS r, (2000000 * h.a::HUGEINT) // (x.n + y.n) AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.p = h.head JOIN f y ON y.lang = h.lang AND y.p = h.rest
), scored AS (SELECT lang, p, a, arg_min({'l': l, 'r': r, 'score': score}, score * 8 + k) AS s FROM cuts GROUP BY lang, p, a),
parts AS (
  SELECT lang, a AS longer, unnest(list_concat([p[1 : m - 1], p[2 : m]], CASE WHEN m = 4 THEN [p[1:2], p[2:3], p[3:4]] ELSE [] END)) AS p FROM c WHERE m > 2
), most AS (SELECT lang, p, max(longer) AS longer FROM parts GROUP BY lang, p),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
ranked AS (
  SELECT scored.lang, array_to_string(scored.p, ' ') AS phrase, a, s.l::BIGINT AS l, s.r::BIGINT AS r, s.score::BIGINT AS score,
         row_number() OVER (PARTITION BY scored.lang ORDER BY s.score DESC, a DESC, array_to_string(scored.p, ' ')) AS rank
  FROM scored LEFT JOIN most ON most.lang = scored.lang AND most.p = scored.p WHERE coalesce(100 * longer < 80 * a, true)
)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
""",
)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


@query("op13_simhash_near_dedup")
def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), shingle=4, radius=4)
