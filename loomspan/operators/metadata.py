"""Structured metadata of pages: JSON-LD by variant paths, Open Graph, heading, and the cascade over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import money, text, urls
from loomspan.operators import extract

#: Types that a schema's fields are read from.
TYPES = {"Product": ("Product", "IndividualProduct"), "NewsArticle": ("NewsArticle", "Article", "ReportageNewsArticle", "BlogPosting"), "VideoObject": ("VideoObject",), "BreadcrumbList": ("BreadcrumbList",), "Event": ("Event", "MusicEvent", "SportsEvent", "TheaterEvent"), "FAQPage": ("FAQPage",)}


def objects(pages: DataFrame) -> DataFrame:
    """page_id, place, type, data (variant): the JSON-LD objects of a page - of lists and of @graph their members - in order;
    scripts that aren't JSON are left out."""
    scripts = extract.jsonld_scripts(pages).withColumn("v", F.try_parse_json("text")).filter("v is not null")
    members = F.coalesce(F.try_variant_get("v", "$['@graph']", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    rows = scripts.select("page_id", "xpath", F.posexplode(members).alias("i", "data"))
    kind = F.coalesce(F.try_variant_get("data", "$['@type'][0]", "string"), F.try_variant_get("data", "$['@type']", "string"))
    return rows.select("page_id", F.struct("xpath", "i").alias("place"), kind.alias("type"), "data")


def _s(path: str, most: int = 256) -> Column:
    return text.sanitize(F.try_variant_get("data", path, "string"), most)


def _first(rows: DataFrame, schema: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("place")
    return rows.filter(F.col("type").isin(*TYPES[schema])).withColumn("_n", F.row_number().over(w)).filter("_n = 1")


def _image() -> Column:
    url = F.coalesce(*[F.try_variant_get("data", p, "string") for p in ("$.image.url", "$.image[0].url", "$.image[0]", "$.image")])
    return F.when(urls.valid(url), url)


def products(pages: DataFrame) -> DataFrame:
    """page_id, name, price, currency, brand, rating, review_count, image_url of the first product of a page."""
    number = lambda *paths: money.to_float(F.coalesce(*[F.try_variant_get("data", p, "string") for p in paths]))
    aggregate = F.coalesce(F.try_variant_get("data", "$.offers['@type']", "string"), F.try_variant_get("data", "$.offers[0]['@type']", "string")) == "AggregateOffer"
    price = F.when(aggregate, F.coalesce(number("$.offers.offers[0].price"), number("$.offers.lowPrice", "$.offers[0].lowPrice", "$.offers.price"))).otherwise(number("$.offers.price", "$.offers[0].price"))
    rows = _first(objects(pages), "Product")
    return rows.select("page_id", _s("$.name").alias("name"), price.alias("price"), F.coalesce(_s("$.offers.priceCurrency", 200), _s("$.offers[0].priceCurrency", 200)).alias("currency"), F.coalesce(_s("$.brand.name"), _s("$.brand")).alias("brand"), number("$.aggregateRating.ratingValue").alias("rating"), F.bround(number("$.aggregateRating.reviewCount")).cast("long").alias("review_count"), _image().alias("image_url"))


def articles(pages: DataFrame) -> DataFrame:
    """page_id, headline, author, date_published, publisher, article_body, image_url of the first article of a page."""
    rows = _first(objects(pages), "NewsArticle")
    person = lambda k: F.coalesce(_s(f"$.{k}.name", 200), _s(f"$.{k}[0].name", 200), _s(f"$.{k}", 200))
    return rows.select("page_id", F.coalesce(_s("$.headline"), _s("$.name")).alias("headline"), person("author").alias("author"), money.date(_s("$.datePublished", 200)).alias("date_published"), person("publisher").alias("publisher"), _s("$.articleBody", 200).alias("article_body"), _image().alias("image_url"))


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """page_id, position, name, url: named crumbs of the first breadcrumb list, by position."""
    rows = _first(objects(pages), "BreadcrumbList").select("page_id", F.posexplode(F.try_variant_get("data", "$.itemListElement", "array<variant>")).alias("i", "data"))
    name = F.coalesce(_s("$.item.name", 200), _s("$.name", 200))
    url = F.coalesce(F.try_variant_get("data", "$.item['@id']", "string"), F.try_variant_get("data", "$.item.url", "string"), F.try_variant_get("data", "$.item", "string"))
    return rows.select("page_id", F.coalesce(F.try_variant_get("data", "$.position", "int"), F.lit(0)).alias("position"), "i", name.alias("name"), F.when(urls.valid(url), url).alias("url")).filter("name is not null and name <> ''")


def cascade(pages: DataFrame) -> DataFrame:
    """page_id, name, price, currency, image_url, source: JSON-LD before Open Graph before the first heading, field by field."""
    ld = products(pages).select("page_id", *[F.col(c).alias(f"l_{c}") for c in ("name", "price", "currency", "image_url")])
    og = extract.og_meta(pages).groupBy("page_id").agg(*[F.max(F.when(F.col("key") == f"og:{k}", F.col("value"))).alias(f"o_{k.replace(':', '_')}") for k in ("title", "image")])
    h1 = text.sanitize(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " "))
    heading = pages.select("page_id", F.when(F.length(h1).between(4, 299), h1).alias("h_name"))
    rows = heading.join(ld, "page_id", "left").join(og, "page_id", "left")
    source = F.when(F.col("l_name").isNotNull(), "json_ld").when(F.col("o_title").isNotNull(), "og").when(F.col("h_name").isNotNull(), "h1").otherwise("")
    return rows.select("page_id", F.coalesce("l_name", text.sanitize(F.col("o_title")), "h_name").alias("name"), F.col("l_price").alias("price"), F.col("l_currency").alias("currency"), F.coalesce("l_image_url", F.when(urls.valid(F.col("o_image")), F.col("o_image"))).alias("image_url"), source.alias("source"))
