"""All rules of the technical audit as data: portable SQL conditions over one wide row per page.

A condition that is null doesn't hold. Columns of the wide row that an audit doesn't have are null; wide_defaults() adds
them. Lists that other operators made (`metadata_issues`, `canonical_issues`) become issues one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsite.operators.technical import SEVERITY

#: Limits of rules (fixed values).
GOOGLEBOT_BYTES, LARGE_HTML_BYTES, MOST_HOPS, FEW_WORDS = 2 * 1024 * 1024, 1024 * 1024, 5, 200

#: Rules (fixed values): category, severity (h, m, l), confidence, issue, condition. `n_` columns are normalised urls, `s_` their schemes.
RULES = f"""
internal_pages h 0.98 404_page | http_status = 404
internal_pages h 0.98 4xx_page | http_status between 400 and 499
internal_pages h 0.98 500_page | http_status = 500
internal_pages h 0.98 5xx_page | http_status between 500 and 599
internal_pages h 0.98 timed_out | status = 'timed_out'
internal_pages m 0.92 https_http_mixed_content | mixed_content_url_count > 0
redirects h 0.96 redirect_loop | status = 'redirect_loop'
redirects h 0.96 broken_redirect | n_requested <> n_target and http_status >= 400
redirects h 0.94 redirect_chain_too_long | redirect_hop_count > {MOST_HOPS}
redirects l 0.82 redirect_chain | redirect_hop_count > 1
redirects m 0.9 302_redirect | redirect_302_count > 0
redirects m 0.88 3xx_redirect | redirect_3xx_count > 0
redirects m 0.9 https_to_http_redirect | n_requested <> n_target and s_requested = 'https' and s_target = 'http'
redirects l 0.82 http_to_https_redirect | n_requested <> n_target and s_requested = 'http' and s_target = 'https'
redirects l 0.82 meta_refresh_redirect | meta_refresh_redirect
redirects l 0.8 redirect_target_changed | redirect_target_changed
indexability m 0.95 noindex_page | status = 'noindex'
indexability m 0.94 noindex_in_html_and_http_header | status = 'noindex' and noindex_source = 'meta+header'
indexability l 0.86 noindex_and_nofollow_page | status = 'noindex' and nofollow
indexability l 0.86 noindex_follow_page | status = 'noindex' and not coalesce(nofollow, false)
indexability m 0.94 nofollow_in_html_and_http_header | nofollow and nofollow_source = 'meta+header'
indexability m 0.9 nofollow_page | nofollow
indexability l 0.82 canonical_url_changed | canonical_changed
indexability l 0.84 indexable_page_became_non_indexable | previous_status = 'indexable' and current_status not in ('', 'indexable')
indexability l 0.84 noindex_page_became_indexable | previous_status = 'noindex' and current_status = 'indexable'
indexability h 0.9 page_size_exceeds_googlebot_s_2_mb_crawl_limit | html_weight_bytes > {GOOGLEBOT_BYTES}
other h 0.94 3xx_page_receives_organic_traffic | traffic > 0 and (http_status between 300 and 399 or redirect_3xx_count > 0 or n_requested <> n_target)
other h 0.96 403_page_receives_organic_traffic | traffic > 0 and http_status = 403
other h 0.96 4xx_page_receives_organic_traffic | traffic > 0 and http_status between 400 and 499
other h 0.94 double_slash_in_url | has_double_slash
other l 0.82 more_than_three_parameters_in_url | parameter_count > 3
other h 0.96 noindex_page_receives_organic_traffic | traffic > 0 and status = 'noindex'
other l 0.82 no_of_referring_domains_dropped | previous_referring_domains > 0 and coalesce(referring_domains, 0) < previous_referring_domains
other l 0.84 non_canonical_page_receives_organic_traffic | traffic > 0 and n_url <> n_canonical
other l 0.84 organic_traffic_dropped | previous_traffic > 0 and coalesce(traffic, 0) < previous_traffic
other l 0.84 pages_dropped_from_top_10 | previous_position > 0 and previous_position <= 10 and (coalesce(position, 0) <= 0 or position > 10)
other l 0.8 pages_to_submit_to_indexnow | indexnow_submission_recommended
other l 0.84 structured_data_has_google_rich_results_validation_error | google_rich_results_validation_error_count > 0
other l 0.84 structured_data_has_schema_org_validation_error | schema_org_validation_error_count > 0
other h 0.96 robots_txt_has_syntax_error | robots_txt_syntax_error_count > 0
other h 0.96 robots_txt_has_too_many_redirects_or_redirect_loop | robots_txt_redirect_loop_count > 0
other h 0.96 robots_txt_is_not_accessible | robots_txt_not_accessible_count > 0
other m 0.86 robots_txt_changed | robots_txt_changed_count > 0
other l 0.84 robots_txt_rules_disallow_to_crawl | robots_txt_disallow_count > 0
content l 0.8 indexable_h1_tag_changed | status = 'indexable' and h1_changed
content l 0.8 indexable_meta_description_changed | status = 'indexable' and description_changed
content l 0.82 indexable_page_and_serp_titles_do_not_match | status = 'indexable' and title_print <> '' and serp_title_print <> '' and title_print <> serp_title_print
content l 0.8 indexable_serp_title_changed | status = 'indexable' and serp_title_changed
content l 0.8 indexable_title_tag_changed | status = 'indexable' and title_changed
content l 0.82 indexable_pages_have_high_ai_content_levels | status = 'indexable' and (ai_content_level in ('high', 'very_high') or ai_content_score >= 0.8)
content l 0.8 indexable_word_count_changed | status = 'indexable' and word_count_changed
links h 0.92 indexable_canonical_url_has_no_incoming_internal_links | status = 'indexable' and n_url = n_canonical and coalesce(in_degree, 0) = 0
performance m 0.86 html_file_size_too_large | html_weight_bytes > {LARGE_HTML_BYTES}
performance m 0.72 very_heavy_page | weight_bucket = 'very_heavy'
performance l 0.68 heavy_page | weight_bucket = 'heavy'
performance l 0.72 render_blocking_resources | render_blocking_count > 0
performance m 0.84 content_is_not_sized_correctly | content_not_sized_correctly
performance m 0.86 document_uses_plugins | plugin_element_count > 0
performance m 0.86 font_size_too_small | small_font_size_count > 0
performance m 0.86 not_compressed | not_compressed
performance m 0.86 page_stopped_passing_cwv_requirements | page_stopped_passing_cwv
performance m 0.86 pages_with_poor_cls | cls_rating = 'poor' or (coalesce(cls_rating, '') not in ('good', 'needs_improvement') and cls_score > 0.25)
performance m 0.86 pages_with_poor_fid | fid_rating = 'poor' or (coalesce(fid_rating, '') not in ('good', 'needs_improvement') and fid_score > 300)
performance m 0.86 pages_with_poor_inp | inp_rating = 'poor' or (coalesce(inp_rating, '') not in ('good', 'needs_improvement') and inp_score > 500)
performance m 0.86 pages_with_poor_lcp | lcp_rating = 'poor' or (coalesce(lcp_rating, '') not in ('good', 'needs_improvement') and lcp_score > 4000)
performance m 0.84 slow_page | load_time_ms > 3000 or response_time_ms > 3000 or ttfb_ms > 1800
performance m 0.84 tap_targets_too_small_or_too_close_together | small_tap_target_count > 0
performance m 0.86 viewport_not_set | viewport_missing
social_tags m 0.86 open_graph_tags_incomplete | incomplete_open_graph
social_tags m 0.86 open_graph_url_not_matching_canonical | n_og <> n_canonical
social_tags m 0.86 twitter_card_incomplete | incomplete_twitter_card
social_tags l 0.8 open_graph_tags_missing | missing_open_graph
social_tags l 0.8 twitter_card_missing | missing_twitter_card
duplicates h 0.92 duplicate_pages_without_canonical | duplicate_without_canonical
localization h 0.9 hreflang_annotation_invalid | invalid_hreflang
localization h 0.9 more_than_one_page_for_same_language_in_hreflang | duplicate_hreflang_languages
localization h 0.9 html_lang_attribute_invalid | html_lang_attribute_invalid
localization m 0.86 hreflang_defined_but_html_lang_missing | hreflang_count > 0 and html_lang_missing
localization m 0.86 html_lang_attribute_missing | html_lang_missing
localization m 0.86 self_reference_hreflang_annotation_missing | self_reference_hreflang_annotation_missing
localization h 0.9 hreflang_and_html_lang_mismatch | hreflang_html_lang_mismatch
localization h 0.9 hreflang_to_non_canonical | hreflang_non_canonical_count > 0
localization h 0.9 hreflang_to_redirect_or_broken_page | hreflang_redirect_or_broken_count > 0
localization h 0.9 missing_reciprocal_hreflang_no_return_tag | missing_reciprocal_hreflang_count > 0
localization h 0.9 page_referenced_for_more_than_one_language_in_hreflang | hreflang_multi_language_count > 0
localization l 0.8 not_all_pages_from_hreflang_group_were_crawled | uncrawled_hreflang_count > 0
localization l 0.8 x_default_hreflang_annotation_missing | x_default_hreflang_annotation_missing
images h 0.94 image_broken | broken_image_count > 0
images h 0.92 page_has_broken_image | broken_image_count > 0
images h 0.9 image_file_size_too_large | large_image_count > 0
images m 0.88 https_page_links_to_http_image | http_image_count > 0
images m 0.88 image_redirects | redirected_image_count > 0
images m 0.86 page_has_redirected_image | redirected_image_count > 0
images m 0.88 missing_alt_text | missing_alt_text_count > 0
javascript h 0.94 javascript_broken | javascript_broken_count > 0
javascript h 0.92 page_has_broken_javascript | javascript_broken_count > 0
javascript m 0.88 https_page_links_to_http_javascript | http_javascript_count > 0
javascript m 0.88 javascript_redirects | redirected_javascript_count > 0
javascript m 0.86 page_has_redirected_javascript | redirected_javascript_count > 0
css m 0.9 css_broken | css_broken_count > 0
css m 0.88 page_has_broken_css | css_broken_count > 0
css m 0.86 css_file_size_too_large | large_css_count > 0
css m 0.88 css_redirects | redirected_css_count > 0
css m 0.86 page_has_redirected_css | redirected_css_count > 0
css m 0.88 https_page_links_to_http_css | http_css_count > 0
external_pages l 0.82 external_3xx_redirect | external_3xx_redirect_count > 0
external_pages l 0.86 external_4xx | external_4xx_count > 0
external_pages l 0.86 external_5xx | external_5xx_count > 0
external_pages l 0.84 external_time_out | external_time_out_count > 0
sitemaps h 0.92 3xx_redirect_in_sitemap | sitemap_redirect_count > 0
sitemaps h 0.94 4xx_page_in_sitemap | sitemap_4xx_count > 0
sitemaps h 0.94 5xx_page_in_sitemap | sitemap_5xx_count > 0
sitemaps h 0.92 noindex_page_in_sitemap | sitemap_noindex_count > 0
sitemaps h 0.92 non_canonical_page_in_sitemap | sitemap_non_canonical_count > 0
sitemaps h 0.94 page_from_sitemap_timed_out | sitemap_timeout_count > 0
sitemaps l 0.84 indexable_page_not_in_sitemap | sitemap_indexable_missing_count > 0
sitemaps l 0.82 page_in_multiple_sitemaps | sitemap_multiple_count > 0
sitemaps l 0.8 pages_added_to_sitemaps | sitemap_added_count > 0
sitemaps h 0.96 sitemap_has_syntax_error | sitemap_syntax_error_count > 0
sitemaps h 0.96 sitemap_is_not_accessible | sitemap_not_accessible_count > 0
sitemaps h 0.94 sitemap_larger_than_50mb | sitemap_too_large_count > 0
sitemaps h 0.94 sitemap_with_over_50k_urls | sitemap_too_many_urls_count > 0
sitemaps m 0.9 sitemap_in_the_wrong_format | sitemap_wrong_format_count > 0
sitemaps m 0.88 sitemap_includes_urls_out_of_its_scope | sitemap_out_of_scope_count > 0
sitemaps l 0.82 no_of_urls_in_sitemap_decreased | sitemap_url_count_decreased_count > 0
sitemaps l 0.8 pages_removed_from_sitemaps | sitemap_removed_count > 0
"""

#: Rules in two forms, for indexable pages and for others (fixed values): category, severities, confidences, issue, condition.
PAIRS = f"""
content hm 0.92 0.86 multiple_meta_description_tags | meta_description_tag_count > 1
content hm 0.92 0.86 multiple_title_tags | title_tag_count > 1
content ml 0.9 0.82 h1_tag_missing_or_empty | h1_count is not null and (h1_count = 0 or coalesce(trim(h1), '') = '')
content ll 0.82 0.8 multiple_h1_tags | h1_count > 1
content ml 0.86 0.8 low_word_count | word_count > 0 and word_count < {FEW_WORDS}
content mm 0.9 0.86 meta_description_tag_missing_or_empty | description_length = 0 or meta_description_tag_count = 0
content ml 0.86 0.8 meta_description_too_long | description_length > 160
content ml 0.86 0.8 meta_description_too_short | description_length > 0 and description_length < 50
content hm 0.94 0.86 title_tag_missing_or_empty | coalesce(trim(title), '') = '' or title_tag_count = 0
content ml 0.86 0.8 title_too_long | title_length > 65
content ml 0.86 0.8 title_too_short | title_length > 0 and title_length < 20
links hm 0.92 0.88 orphan_page_has_no_incoming_internal_links | in_degree = 0
links hm 0.94 0.9 https_page_has_internal_links_to_http | s_url = 'https' and internal_http_link_count > 0
links ll 0.86 0.82 http_page_has_internal_links_to_https | s_url = 'http' and internal_https_link_count > 0
links hm 0.94 0.9 page_has_links_to_broken_page | broken_internal_link_count > 0
links ml 0.9 0.82 page_has_links_to_redirect | redirect_internal_link_count > 0
links ml 0.88 0.82 redirected_page_has_no_incoming_internal_links | n_requested <> n_target and in_degree = 0
links hm 0.9 0.86 page_has_no_outgoing_links | internal_link_count = 0
links ml 0.9 0.82 page_has_nofollow_incoming_internal_links_only | incoming_nofollow_count > 0 and coalesce(incoming_dofollow_count, 0) = 0
links ll 0.84 0.82 page_has_nofollow_and_dofollow_incoming_internal_links | incoming_nofollow_count > 0 and incoming_dofollow_count > 0
links ll 0.84 0.82 page_has_nofollow_outgoing_internal_links | outgoing_nofollow_count > 0
links ll 0.82 0.8 page_has_only_one_dofollow_incoming_internal_link | incoming_dofollow_count = 1
"""

#: Severities of issues that the metadata operator lists, others medium; and severity and confidence of canonical ones (fixed values).
METADATA = {"missing_title": "high", "missing_canonical": "high", "canonical_external_host": "high", "short_title": "low", "long_title": "low", "short_description": "low", "long_description": "low", "incomplete_open_graph": "low", "missing_twitter_card": "low"}
CANONICAL = {
    "canonical_points_to_4xx": ("high", 0.96), "canonical_points_to_5xx": ("high", 0.96), "canonical_points_to_redirect": ("high", 0.96), "non_canonical_page_specified_as_canonical_one": ("medium", 0.9),
    "canonical_from_http_to_https": ("low", 0.86), "canonical_from_https_to_http": ("low", 0.86),
}
_LEVELS = {"h": "high", "m": "medium", "l": "low"}
_TEXTS = "url canonical_url requested_url redirect_target_url og_url title h1 status previous_status current_status noindex_source nofollow_source title_print serp_title_print ai_content_level weight_bucket cls_rating fid_rating inp_rating lcp_rating".split()
_FLAGS = (
    "nofollow meta_refresh_redirect redirect_target_changed canonical_changed indexnow_submission_recommended h1_changed description_changed serp_title_changed title_changed word_count_changed content_not_sized_correctly not_compressed "
    "page_stopped_passing_cwv viewport_missing incomplete_open_graph incomplete_twitter_card missing_open_graph missing_twitter_card duplicate_without_canonical invalid_hreflang duplicate_hreflang_languages html_lang_attribute_invalid "
    "html_lang_missing self_reference_hreflang_annotation_missing hreflang_html_lang_mismatch x_default_hreflang_annotation_missing"
).split()
_DERIVED = "has_double_slash parameter_count".split()


def rules() -> list[tuple[str, str, str, float, str]]:
    """(issue, category, severity, confidence, condition) of every rule with a condition."""
    out = []
    for line in filter(None, RULES.splitlines()):
        head, condition = line.split(" | ")
        category, level, sure, issue = head.split()
        out.append((issue, category, _LEVELS[level], float(sure), condition))
    for line in filter(None, PAIRS.splitlines()):
        head, condition = line.split(" | ")
        category, levels, *sure, issue = head.split()
        for level, s, prefix, state in zip(levels, sure, ("indexable", "not_indexable"), ("status = 'indexable'", "coalesce(status, '') <> 'indexable'")):
            out.append((f"{prefix}_{issue}", category, _LEVELS[level], float(s), f"{state} and ({condition})"))
    return out


def columns() -> tuple[list[str], list[str], list[str]]:
    """Texts, flags and numbers that the conditions read; normalised and derived columns are made by wide_defaults()."""
    import re

    words = {w for _, _, _, _, c in rules() for w in re.findall(r"[a-z_0-9]+", re.sub(r"'[^']*'", "", c)) if re.match(r"[a-z]", w)}
    other = {"and", "or", "not", "in", "is", "null", "coalesce", "trim", "between", "false", *_TEXTS, *_FLAGS, *_DERIVED}
    return _TEXTS, _FLAGS, sorted(w for w in words - other if not w.startswith(("n_", "s_")))


def normalized(url: Column) -> Column:
    """A url in lower case without fragment and trailing slashes; null where it is empty."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "#.*$", ""), "/+$", ""), F.lit(""))


def wide_defaults(rows: DataFrame) -> DataFrame:
    """rows with every column that the rules read: missing ones null, normalised urls, schemes and what the url says."""
    texts, flags, numbers = columns()
    have = set(rows.columns)
    kinds = [(texts, "string"), (flags, "boolean"), (numbers, "double"), (("metadata_issues", "canonical_issues"), "array<string>")]
    at = rows.withColumns({c: F.lit(None).cast(kind) for names, kind in kinds for c in names if c not in have})
    urls = {"url": "url", "canonical": "canonical_url", "requested": "requested_url", "target": "redirect_target_url", "og": "og_url"}
    at = at.withColumns({f"n_{k}": normalized(F.col(c)) for k, c in urls.items()})
    at = at.withColumns({f"s_{k}": F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), "^([a-zA-Z]+)://", 1)) for k, c in urls.items()})
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)
    return at.withColumns({"has_double_slash": F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).contains("//"), "parameter_count": F.size(F.filter(F.split(query, "&"), lambda x: x != ""))})


def all_issues(rows: DataFrame) -> DataFrame:
    """(url, issue, category, severity, confidence, impact) of wide page rows: all rules, and the issues other operators listed.

    A status that none of the rules names is an issue of its own. impact = severity weight x confidence x (1 + min(3, traffic / 1000)).
    """
    at = wide_defaults(rows.filter("url is not null"))
    one = lambda i, k, s, f: F.struct(i.alias("issue"), F.lit(k).alias("category"), s.alias("severity"), f.cast("double").alias("confidence"))
    made = F.array_compact(F.array(*(F.when(F.expr(c), one(F.lit(i), k, F.lit(s), F.lit(f))) for i, k, s, f, c in rules())))
    known = F.col("status").isin("timed_out", "redirect_loop", "noindex", "indexable", "")
    state = F.when(F.col("status").isNotNull() & ~known, F.array(one(F.col("status"), "indexability", F.lit("high"), F.lit(0.95))))
    of = lambda values, key, default: F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(default))
    meta = F.transform("metadata_issues", lambda i: one(i, "metadata", of(METADATA, i, "medium"), F.lit(0.9)))
    canon = F.transform(F.filter("canonical_issues", lambda i: i.isin(*CANONICAL)), lambda i: one(i, "indexability", of({k: v[0] for k, v in CANONICAL.items()}, i, "low"), of({k: v[1] for k, v in CANONICAL.items()}, i, 0.86)))
    none = F.slice(made, 1, 0)
    x = at.select("url", F.coalesce("traffic", F.lit(0)).alias("traffic"), F.explode(F.concat(made, *(F.coalesce(c, none) for c in (state, meta, canon)))).alias("x"))
    w = F.coalesce(F.create_map(*(F.lit(v) for kv in SEVERITY.items() for v in kv))[F.col("x.severity")], F.lit(25.0))
    return x.select("url", "x.issue", "x.category", "x.severity", "x.confidence", (w * F.col("x.confidence") * (1 + F.least(F.lit(3.0), F.col("traffic") / 1000))).alias("impact"))


def issue_catalog(spark) -> DataFrame:
    """(issue, scope, severity, importance): every rule's issue with its scope and how it is named to users."""
    names = {"high": "Error", "medium": "Warning", "low": "Notice"}
    more = [(i, "metadata", s) for i, s in METADATA.items()] + [(i, "indexability", s) for i, (s, _) in CANONICAL.items()]
    rows = sorted({(i, k, s) for i, k, s, _, _ in rules()} | set(more))
    return spark.createDataFrame([(i, k, s, names[s]) for i, k, s in rows], "issue string, scope string, severity string, importance string")
