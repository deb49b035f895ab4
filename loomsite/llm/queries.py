"""Queries of the llm operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsite.llm import clusters, components, graph_search, leakage, main_content, mixing, repeated_lines, splitting, toxicity
from loomsite.llm.vectors import usable_vectors
from loomsite.plans.stage import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "responses"))


def p2_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, d, "responses"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    links = components.duplicate_links(table(spark, d, "duplicate_pairs"), table(spark, d, "audit_pages"), table(spark, d, "pages"))
    return components.connected_components(links, "a", "b").withColumnRenamed("member", "page_id")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar other pages of every page."""
    vectors = usable_vectors(table(spark, d, "audit_pages"), "page_id", latest="encoded_at")
    return graph_search.nearest_vectors(vectors).select(F.col("id").alias("page_id"), F.col("neighbour").alias("neighbour_id"), "rank", "similarity")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p4_neighbours(spark, d).filter("similarity >= 0.75")
    return pairs.select(F.least("page_id", "neighbour_id").alias("page_a"), F.greatest("page_id", "neighbour_id").alias("page_b")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = main_content.main_content(table(spark, d, "responses"), table(spark, d, "embed_inputs"))
    return found.select("record_kind", "record_id", F.explode("keep").alias("line_no"))


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    return main_content.main_text(table(spark, d, "responses"), table(spark, d, "embed_inputs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).select("record_kind", "record_id").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "embed_inputs"), table(spark, d, "responses"))


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    return clusters.similarity_clusters(clusters.page_and_paragraph_vectors(table(spark, d, "audit_pages"), table(spark, d, "paragraphs")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    members = _clustered(spark, d)
    first = members.groupBy("kind", "cid").agg(F.min("id").alias("cluster_first"))
    return members.join(first, ["kind", "cid"]).select(F.col("kind").alias("record_kind"), "cluster_first", F.col("id").alias("record_id"))


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_summaries(_clustered(spark, d), table(spark, d, "pages"), table(spark, d, "paragraphs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    _, plan = mixing.planned(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return plan.filter("short").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    counted, plan = mixing.planned(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.mix_shares(mixing.mix(counted, plan), plan)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    counted, plan = mixing.planned(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.mix(counted, plan).select("doc_id", "source", "tokens", F.col("uses").cast("int").alias("uses"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxic_cases(_scores(spark, d))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.source_rates(_scores(spark, d))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_BARE = """(lower(regexp_extract(regexp_replace(regexp_replace(trim({0}), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^(?i:www)\\.', ''), '^([^/?#]*)', 1))
  || regexp_replace(substr(regexp_replace(regexp_replace(trim({0}), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^(?i:www)\\.', ''), length(regexp_extract(regexp_replace(regexp_replace(trim({0}), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^(?i:www)\\.', ''), '^([^/?#]*)', 1)) + 1), '/+$', ''))"""
_UNIT = "list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[])))"
_FINE = "len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_WORDS = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{Nd}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_LEAKS = f"""w as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
dw as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) as g from w where len(w) >= 12),
bw as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) as g from b where len(w) >= 12), lk as (select distinct doc_id, item_id from dw join bw using (g))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""with recursive u as (select distinct {_BARE.format('url')} as at, page_id from pages), l as (select page_a as a, page_b as b from duplicate_pairs
union all select x.page_id, u.page_id from (select page_id, unnest(duplicate_partners) as p from audit_pages) x join u on u.at = {_BARE.format('p.url')}),
e as (select distinct a, b from (select a, b from l union all select b, a from l) where a is not null and b is not null and a <> b),
r as (select a as page_id, a as g from e union select e.b, r.g from r join e on e.a = r.page_id)
select min(g) as group_id, page_id from r group by page_id""",
        "p7_found": f"""with a as (select page_id as id, arg_max(struct_pack(e := embedding), struct_pack(t := encoded_at, e := embedding)).e as embedding from audit_pages group by 1), q as (select para_id as id, max(embedding) as embedding from paragraphs where para_id is not null group by 1),
v as (select 'page' as k, id, {_UNIT} as v from a where {_FINE} union all select 'paragraph', id, {_UNIT} from q where {_FINE}),
n as (select x.k, x.id, count(*) as n, min(y.id) as f from v x join v y on x.k = y.k and list_dot_product(x.v, y.v) >= 0.75 group by 1, 2) select k as record_kind, f as cluster_first, id as record_id from n where n >= 5""",
        "p8_found": f"with {_LEAKS} select * from lk",
        "p8_items": f"with {_LEAKS} select item_id, count(*) as documents, min(doc_id) as first_doc from lk group by 1",
    }
