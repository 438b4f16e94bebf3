"""Shop pages: product options, cart actions and navigation hints, from extracted elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan import terms
from loomspan.functions import urls
from loomspan.operators import diagnose, prompts

# Words of controls, by role.
TERMS = {
    "next_ref": ["next", "다음", "次へ", "suivant", "weiter", "下一页", "siguiente"],
    "prev_ref": ["previous", "prev", "이전", "前へ", "précédent", "zurück", "上一页", "anterior"],
    "load_more_ref": ["load more", "show more", "더보기", "もっと見る", "voir plus", "mehr anzeigen", "加载更多"],
    "submit_ref": ["submit", "send", "continue", "place order", "제출", "送信", "envoyer", "absenden", "提交"],
    "cancel_ref": ["cancel", "취소", "キャンセル", "annuler", "abbrechen", "取消"],
    "add_to_cart_ref": ["add to cart", "add to bag", "add to basket", "장바구니", "カートに入れる", "ajouter au panier", "in den warenkorb", "加入购物车"],
    "buy_now_ref": ["buy now", "바로구매", "今すぐ買う", "acheter maintenant", "jetzt kaufen", "立即购买"],
    "verify_ref": ["verify", "확인", "continue", "retry", "다시 시도"],
}
# Hints by page type.
HINTS = {
    "search_results": ["next_ref", "prev_ref", "load_more_ref"], "listing": ["next_ref", "prev_ref", "load_more_ref"], "checkout": ["submit_ref", "cancel_ref"], "form": ["submit_ref", "cancel_ref"],
    "product_detail": ["add_to_cart_ref", "buy_now_ref"], "blocked": ["verify_ref"],
}
UNAVAILABLE = ["sold out", "out of stock", "unavailable", "품절", "売り切れ", "épuisé", "ausverkauft", "缺货", "agotado"]
COLOR, SIZE = ["color", "colour", "색상", "カラー", "couleur", "farbe", "颜色"], ["size", "사이즈", "サイズ", "taille", "größe", "尺码"]


def _any(x: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | x.contains(t)
    return out


def hints(elements: DataFrame, types: DataFrame) -> DataFrame:
    """page_id and one column per hint: the first element of the page whose name holds one of the hint's terms, where the page's
    type has the hint."""
    lower = F.lower("name")
    rows = elements.join(types, "page_id")
    allowed = lambda hint: F.col("page_type").isin(*[t for t, some in HINTS.items() if hint in some])
    return rows.groupBy("page_id").agg(*[F.min(F.when(allowed(h) & _any(lower, t), F.col("ref"))).alias(h) for h, t in TERMS.items()])


def options(elements: DataFrame) -> DataFrame:
    """page_id, ref, kind, selection_order, value, available: the values of select elements."""
    lower = F.lower("name")
    kind = F.when(_any(lower, COLOR), "color").when(_any(lower, SIZE), "size").otherwise("other")
    rows = elements.filter("role = 'combobox'").select("page_id", "ref", kind.alias("kind"), F.explode("options").alias("value"))
    order = F.when(F.col("kind") == "color", 1).when(F.col("kind") == "size", 2).otherwise(3)
    return rows.select("page_id", "ref", "kind", order.alias("selection_order"), "value", (~_any(F.lower("value"), UNAVAILABLE)).alias("available"))


def blocked_reason(values: DataFrame, availability: DataFrame) -> DataFrame:
    """page_id, reason, available, unavailable: why a product can't be put into the cart; null if it can.

    ``availability``: page_id, availability, selected (kinds already chosen).
    """
    groups = values.groupBy("page_id", "ref", "kind").agg(F.bool_or("available").alias("any"), F.count_if("available").alias("yes"), F.count_if(~F.col("available")).alias("no"))
    page = groups.groupBy("page_id").agg(F.collect_set("kind").alias("kinds"), F.bool_or(~F.col("any")).alias("gone"), F.sum("yes").alias("available"), F.sum("no").alias("unavailable"))
    rows = availability.join(page, "page_id", "left")
    open_ = F.array_except(F.coalesce("kinds", F.array().cast("array<string>")), F.coalesce("selected", F.array().cast("array<string>")))
    reason = (
        F.when(F.col("availability").isin("out_of_stock", "sold_out"), "out_of_stock")
        .when(F.col("gone"), "all_sold_out")
        .when(F.size(open_) == 0, None)
        .when((F.size(open_) == 1) & F.array_contains(open_, "size"), "size_required")
        .when((F.size(open_) == 1) & F.array_contains(open_, "color"), "color_required")
        .otherwise("options_required")
    )
    return rows.select("page_id", reason.alias("reason"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("unavailable", F.lit(0)).alias("unavailable"))


def cards(pages: DataFrame, most: int = 15) -> DataFrame:
    """page_id, pos, name, price_text: cards of listing pages, from repeated list items with a price; the first of each name stays."""
    from pyspark.sql import Window

    item = F.regexp_extract_all("html", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(item).alias("i", "item"))
    words = F.trim(F.regexp_replace(F.regexp_replace("item", "<[^>]+>", " "), r"[ \t\r\n]+", " "))
    price = F.nullif(F.regexp_extract(words, r"((?:[$€£¥₩]\s?[0-9][0-9,.]*)|(?:[0-9][0-9,.]*\s?(?:원|円|元|€)))", 1), F.lit(""))
    rows = rows.select("page_id", "i", words.alias("words"), price.alias("price_text")).filter("price_text is not null")
    rows = rows.withColumn("name", F.trim(F.substring(F.regexp_replace("words", r"(?:[$€£¥₩]\s?[0-9][0-9,.]*)|(?:[0-9][0-9,.]*\s?(?:원|円|元|€))", ""), 1, 120)))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id", F.lower("name")).orderBy("i"))).filter("n = 1")
    placed = first.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("i")))
    return placed.filter(F.col("pos") <= most).select("page_id", "pos", "name", "price_text")


def _first(affordances: tuple[str, ...], words: tuple[str, ...], role: str | None = None) -> Column:
    """The first element of these affordances whose name holds one of the words."""
    fits = F.col("affordance").isin(*affordances) & F.lower("name").rlike(terms.any_of(tuple(w.lower() for w in words)))
    return F.min(F.when(fits & (F.col("role") == role) if role else fits, F.col("ref")))


def cart_actions(elements: DataFrame, selected: DataFrame) -> DataFrame:
    """page_id, refs of the cart's controls, prerequisites and flow_state. ``selected``: page_id, ref of selects with a choice made.

    A select of size or colour (any select with values) without a choice is a prerequisite.
    """
    chosen = selected.select("page_id", "ref", F.lit(True).alias("_chosen"))
    rows = elements.join(chosen, ["page_id", "ref"], "left")
    open_ = (F.col("role") == "combobox") & (F.size("options") > 0) & F.col("_chosen").isNull()
    out = rows.groupBy("page_id").agg(
        _first(("click",), terms.ADD_TO_CART).alias("add_to_cart_ref"),
        _first(("click",), terms.BUY_NOW).alias("buy_now_ref"),
        _first(("click", "toggle"), terms.WISHLIST).alias("wishlist_ref"),
        _first(("type", "select"), terms.QUANTITY).alias("quantity_ref"),
        F.transform(F.array_sort(F.collect_list(F.when(open_, F.struct("ref", "name")))), lambda x: F.concat(F.lit("Select "), x["name"])).alias("prerequisites"),
    )
    state = F.when(F.size("prerequisites") > 0, "select_options").when(F.col("add_to_cart_ref").isNotNull(), "ready_to_add").otherwise("unknown")
    return out.withColumn("flow_state", state)


def cart_state(html: Column) -> Column:
    """struct(confirmed, count): whether the page says that something was put into the cart, and the number on the cart's badge."""
    low = F.lower(html)
    badge = F.regexp_extract(low, r"(?:cart|basket|bag)[-_]?(?:count|badge|quantity)[^>]*>\s*(\d+)", 1)
    return F.struct(low.rlike(terms.any_of(tuple(w.lower() for w in terms.CART_CONFIRMATION))).alias("confirmed"), F.nullif(badge, F.lit("")).try_cast("int").alias("count"))


def search_summary(pages: DataFrame, elements: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, query, sort_ref, sort_options, cards, sponsored, current_page, total_pages of search pages. ``found``: their cards."""
    sort = (F.col("role") == "combobox") & F.lower("name").rlike(terms.any_of(tuple(w.lower() for w in terms.SORT)))
    control = elements.filter(sort).groupBy("page_id").agg(F.min(F.struct("ref", "options")).alias("s")).select("page_id", F.col("s.ref").alias("sort_ref"), F.slice("s.options", 1, 10).alias("sort_options"))
    counted = found.groupBy("page_id").agg(F.count("*").alias("cards"), F.count_if(diagnose.sponsored(F.coalesce("name", F.lit("")))).alias("sponsored"))
    base = pages.select("page_id", urls.search_query(F.col("url")).alias("query"), prompts.pages_of(F.coalesce("html", F.lit(""))).alias("p"))
    rows = base.join(control, "page_id", "left").join(counted, "page_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("page_id", "query", "sort_ref", "sort_options", zero("cards"), zero("sponsored"), "p.current_page", "p.total_pages")
