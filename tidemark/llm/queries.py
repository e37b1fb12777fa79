"""Queries pN_ over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import p1_linkage, p2_topn, p3_boilerplate, p4_clusters, p5_neighbours, p6_neardup, p7_lines, p8_packing, p9_mixing, p10_encoding
from tidemark.llm.common import read
from tidemark.session import Scratch, cut

#: Where the tokenizer's rank file is on every worker, unless the session's setting says otherwise.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RANKS_SETTING = "spark.tidemark.tokenizer.ranks"


def ranks(spark: SparkSession) -> str:
    return spark.conf.get(RANKS_SETTING, RANKS)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _p1(spark: SparkSession, sf_dir: str):
    scratch = Scratch(spark, "p1")
    history = p1_linkage.build_history(read(spark, sf_dir, "articles"), read(spark, sf_dir, "seen_articles"), scratch)
    batch = scratch.put(p1_linkage.prepare(read(spark, sf_dir, "incoming_articles")), "batch")
    return batch, p1_linkage.link(batch, history)


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows that repeat history or an earlier new row."""
    return _p1(spark, sf_dir)[1].cases.select(F.col("incoming_id").cast("long").alias("incoming_id"))


@query
def p1_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every incoming row after the batch, with the score of its best link."""
    return p1_linkage.representatives(*_p1(spark, sf_dir))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five articles of each cluster."""
    top = p2_topn.top_n(read(spark, sf_dir, "article_clusters"), "cluster_id", "article_id", "score", 5)
    return top.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("article_id").cast("long").alias("article_id"))


@query
def p2_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five with score and rank."""
    top = p2_topn.top_n(read(spark, sf_dir, "article_clusters"), "cluster_id", "article_id", "score", 5)
    return top.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("article_id").cast("long").alias("article_id"), F.col("score").cast("double").alias("score"), "rank")


_P2 = """
    SELECT cluster_id, article_id, score, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, article_id) AS rank
    FROM (SELECT cluster_id::BIGINT AS cluster_id, article_id::BIGINT AS article_id, max(score)::DOUBLE AS score FROM article_clusters
          WHERE score IS NOT NULL AND NOT isnan(score) AND cluster_id IS NOT NULL AND article_id IS NOT NULL GROUP BY 1, 2) x
    QUALIFY rank <= 5"""
ORACLE["p2_ranked"] = _P2
ORACLE["p2_found"] = f"SELECT cluster_id, article_id FROM ({_P2}) y"


def _p7(spark: SparkSession, sf_dir: str):
    return p7_lines.repeated_lines(read(spark, sf_dir, "articles"), "id", "source_id", "body")


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in five or more articles of their source."""
    return p7_lines.found_lines(_p7(spark, sf_dir)).select(F.col("id").cast("long").alias("article_id"), "line_no")


@query
def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without those lines."""
    found = p7_lines.found_lines(_p7(spark, sf_dir))
    return p7_lines.without_lines(read(spark, sf_dir, "articles"), "id", "body", found).withColumnRenamed("id", "article_id")


@query
def p7_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines with their excess over other sources; ``excess`` at a false-discovery rate of 1 %."""
    articles = read(spark, sf_dir, "articles")
    r = p7_lines.repeated_lines(articles, "id", "source_id", "body")
    lines = cut(r.lines)
    bound = p7_lines.excess_bound(p7_lines.tests(articles, "source_id", "body"), lines)
    return lines.select("source", "h1", "h2", "n_in", "n_out", F.round("llr", 6).alias("llr"), F.round("log10_p", 6).alias("log10_p"), (F.col("log10_p") <= bound).alias("excess"))


_P7 = r"""
    WITH piece AS (
        SELECT id, source_id, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line_no
        FROM articles WHERE id IS NOT NULL AND source_id IS NOT NULL AND body IS NOT NULL),
    keyed AS (SELECT id, source_id, line_no, trim(regexp_replace(lower(line), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) AS k FROM piece),
    hot AS (SELECT source_id, k FROM keyed WHERE k <> '' GROUP BY 1, 2 HAVING count(DISTINCT id) >= 5),
    found AS (SELECT id, line_no FROM keyed JOIN hot USING (source_id, k))"""
ORACLE["p7_found"] = _P7 + " SELECT id::BIGINT AS article_id, line_no::BIGINT AS line_no FROM found"
ORACLE["p7_clean"] = _P7 + """,
    gone AS (SELECT id, list(line_no) AS gone FROM found GROUP BY 1)
    SELECT a.id AS article_id, CASE WHEN g.gone IS NULL THEN a.body ELSE
        array_to_string(list_filter(string_split(a.body, chr(10)), lambda x, i: NOT list_contains(g.gone, i)), chr(10)) END AS body
    FROM articles a LEFT JOIN gone g ON g.id = a.id"""


def _p4(spark: SparkSession, sf_dir: str):
    return p4_clusters.groups_of(read(spark, sf_dir, "article_vectors"), "article_id", "embedding", "created_at")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups of four or more articles connected by cosines of 0.55 or more."""
    return _p4(spark, sf_dir).groups.select(F.col("id").alias("article_id"), "group_id")


@query
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group with its size and most typical members."""
    return p4_clusters.described(_p4(spark, sf_dir))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the five nearest of the other, at 0.80 or more."""
    return p5_neighbours.nearest_pairs(read(spark, sf_dir, "article_vectors"), "article_id", "embedding", "created_at")


_VECTORS = """
    latest AS (SELECT article_id, arg_max(embedding, row(created_at, embedding)) AS v FROM article_vectors GROUP BY 1),
    raw AS (SELECT article_id, v::DOUBLE[] AS v FROM latest WHERE v IS NOT NULL AND len(v) = 384
            AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    unit AS (SELECT article_id AS id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM raw WHERE list_dot_product(v, v) > 0),
    cosine AS (SELECT a.id AS id, b.id AS other, list_dot_product(a.v, b.v) AS cos FROM unit a JOIN unit b ON a.id <> b.id)"""
ORACLE["p4_found"] = f"""
    WITH RECURSIVE {_VECTORS},
    link AS MATERIALIZED (SELECT id, other FROM cosine WHERE cos >= 0.55),
    reach AS (SELECT id, id AS other FROM unit UNION SELECT r.id, l.other FROM reach r JOIN link l ON l.id = r.other),
    root AS (SELECT id, min(other) AS group_id, count(*) AS n FROM reach GROUP BY 1)
    SELECT id AS article_id, group_id FROM root WHERE n >= 4"""
ORACLE["p5_found"] = f"""
    WITH {_VECTORS},
    near AS (SELECT id, other FROM cosine WHERE cos >= 0.80 QUALIFY row_number() OVER (PARTITION BY id ORDER BY cos DESC, other) <= 5)
    SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM near"""


def _p6(spark: SparkSession, sf_dir: str):
    return p6_neardup.near_duplicates(read(spark, sf_dir, "articles"), "id", "body", width=3, sim=0.6)


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles whose three-word sequences have a Jaccard similarity of 0.6 or more."""
    return p6_neardup.document_pairs(_p6(spark, sf_dir))


@query
def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per article: its class and number of links, at five words and 0.8."""
    return p6_neardup.classes(p6_neardup.near_duplicates(read(spark, sf_dir, "articles"), "id", "body"))


def _p6_sql(width: int, sim: float) -> str:
    return rf"""
    norm AS (SELECT id, string_split(trim(regexp_replace(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}_\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]', '', 'g'),
             '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g')), ' ') AS w FROM articles WHERE body IS NOT NULL),
    piece AS (SELECT DISTINCT id, array_to_string(w[i:i + {width - 1}], ' ') AS p FROM (SELECT id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM norm)),
    size AS (SELECT id, count(*) AS n FROM piece GROUP BY 1),
    common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM piece a JOIN piece b ON a.p = b.p AND a.id < b.id GROUP BY 1, 2),
    pairs AS (SELECT id_a, id_b FROM common JOIN size x ON x.id = id_a JOIN size y ON y.id = id_b WHERE k >= {sim} * (x.n + y.n - k) - 1e-9)"""


ORACLE["p6_found"] = f"WITH {_p6_sql(3, 0.6)} SELECT id_a, id_b FROM pairs"


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of articles that are page furniture."""
    return p3_boilerplate.furniture_lines(read(spark, sf_dir, "articles"), "id", "title", "body").withColumnRenamed("id", "article_id")


@query
def p3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without these lines."""
    return p3_boilerplate.main_text(read(spark, sf_dir, "articles"), "id", "title", "body").withColumnRenamed("id", "article_id")


@query
def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every document, or of each piece of a document above 2,048 tokens."""
    return p8_packing.pack(read(spark, sf_dir, "documents"), "doc_id", "source", "text", ranks(spark))


@query
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, and how much of their room is used."""
    return p8_packing.report(cut(p8_pack(spark, sf_dir)))


def _p9(spark: SparkSession, sf_dir: str):
    return p9_mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"), "doc_id", "source", "text", ranks(spark))


@query
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen documents with repeats, in slot order of the mixture."""
    return _p9(spark, sf_dir).rows


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares per source."""
    return p9_mixing.shares(_p9(spark, sf_dir))


def _p10(spark: SparkSession, sf_dir: str):
    return p10_encoding.find_damage(read(spark, sf_dir, "documents"), "doc_id", "text")


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold text decoded with a wrong encoding."""
    return p10_encoding.damaged_documents(_p10(spark, sf_dir))


@query
def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These documents with their original text, as far as it can be had back."""
    return p10_encoding.restored(_p10(spark, sf_dir))
