"""The page reports: every rule pack over the stored pages, parsed once for each report.

Nesting, the order of elements and JSON are not SQL; the tests hold the packs against literal pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import urls as U
from auditloom.operators import element_rules, report_rules
from auditloom.operators.graph import cut_lineage
from auditloom.sources.elements import html_elements

from .content import FILLER, PLACEHOLDER
from .registry import query, table


def parsed(spark, sf_dir):
    """The pages, their elements and their facts; elements and facts are written once."""
    pages = table(spark, sf_dir, "pages").select("url", "html")
    elements = cut_lineage(html_elements(pages))
    return elements, cut_lineage(report_rules.page_facts(pages, elements))


@query()
def report_page_seo(spark, sf_dir):
    """Titles, descriptions, headings, topics and urls, and texts that several pages share."""
    elements, facts = parsed(spark, sf_dir)
    return report_rules.page_seo_rules(facts, elements).unionByName(report_rules.duplicate_rules(facts).where("category <> 'Open Graph'"))


@query()
def report_headings(spark, sf_dir):
    elements, _ = parsed(spark, sf_dir)
    return element_rules.heading_rules(elements)


@query()
def report_images(spark, sf_dir):
    elements, _ = parsed(spark, sf_dir)
    return report_rules.image_report_rules(elements)


@query()
def report_links(spark, sf_dir):
    elements, facts = parsed(spark, sf_dir)
    return report_rules.link_rules(facts, elements)


@query()
def report_social(spark, sf_dir):
    _, facts = parsed(spark, sf_dir)
    return report_rules.social_meta_rules(facts).unionByName(report_rules.duplicate_rules(facts).where("category = 'Open Graph'"))


@query()
def report_structured_data(spark, sf_dir):
    elements, facts = parsed(spark, sf_dir)
    return report_rules.structured_data_rules(facts, elements)


@query()
def report_hreflang(spark, sf_dir):
    elements, facts = parsed(spark, sf_dir)
    return report_rules.hreflang_rules(facts, report_rules.hreflang_alternates(elements))


@query()
def report_technical(spark, sf_dir):
    elements, facts = parsed(spark, sf_dir)
    return report_rules.technical_rules(facts, elements)


@query()
def report_accessibility(spark, sf_dir):
    """Names, labels and references of the element rules, and the landmarks, ARIA and media rules."""
    elements, facts = parsed(spark, sf_dir)
    return element_rules.accessibility_rules(elements).unionByName(report_rules.accessibility_report_rules(facts, elements))


@query()
def report_content(spark, sf_dir):
    """Rules on each page's main text, which need none of its elements."""
    pages = table(spark, sf_dir, "pages").select("url", "html", U.path(F.col("url")).alias("path"))
    return report_rules.content_rules(pages, PLACEHOLDER, FILLER)


@query()
def link_targets(spark, sf_dir):
    """Every link by kind with its label, and how many pages have it."""
    elements, _ = parsed(spark, sf_dir)
    links = report_rules.labelled_links(elements)
    return links.groupBy("kind", "target_url").agg(F.count_distinct("url").alias("pages"), F.count("*").alias("links"), F.min("label").alias("least_label"))
