"""Pages as news articles: declared article bodies, paragraphs, hosts and source tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import text as T


def paragraph_text(html: Column) -> Column:
    """The text of all paragraph elements, one space between words."""
    return T.strip_tags(F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), " "))


def declared_body(html: Column) -> Column:
    """The longest articleBody that the page's linked-data scripts declare at their top or in a graph; null if none."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    bodies = F.flatten(F.transform(scripts, lambda s: F.array(F.get_json_object(s, "$.articleBody"), F.get_json_object(s, "$['@graph'][0].articleBody"))))
    return F.array_max(F.transform(F.array_compact(bodies), lambda b: F.struct(F.length(b).alias("n"), b.alias("body"))))["body"]


def article_text(html: Column, least_words: int = 80) -> Column:
    """The declared body if it has ``least_words`` words, else the paragraphs if they have, else null."""
    def enough(c: Column) -> Column:
        return F.when(F.size(F.split(F.trim(c), r"\s+")) >= least_words, c)

    return F.coalesce(enough(declared_body(html)), enough(paragraph_text(html)))


def host(url: Column) -> Column:
    """Host of a web address without its port; empty if there is none."""
    return F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)


def source_tier(url: Column, tiers: list[tuple[str, str]], otherwise: str = "other") -> Column:
    """The first tier whose pattern the host matches; 'unknown' without an address."""
    cascade = F.lit(otherwise)
    for name, pattern in reversed(tiers):
        cascade = F.when(host(url).rlike(pattern), name).otherwise(cascade)
    return F.when(F.coalesce(url, F.lit("")) == "", "unknown").otherwise(cascade)
