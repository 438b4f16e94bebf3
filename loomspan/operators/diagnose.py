"""What went wrong with a page or an action and what to try next: tables and ordered conditions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan import terms
from loomspan.functions import urls

# What to try, by page state and by kind of failure - (action, reason), best first.
PAGE_RECOVERY = {
    "bot_blocked": (("wait_for", "Wait for challenge to resolve"), ("navigate", "Try alternate URL")),
    "empty_results": (("navigate", "Try broader search"), ("scroll_page", "Check lazy-loaded results")),
    "out_of_stock": (("fetch_page", "Refresh to check stock"), ("navigate", "Search alternatives")),
    "login_required": (("execute_action", "Fill login form"), ("navigate", "Try public page")),
    "error_page": (("navigate", "Try different URL"), ("fetch_page", "Retry current page")),
    "age_verification": (("execute_action", "Accept age verification"),),
    "region_restricted": (("navigate", "Try alternate URL"),),
}
ACTION_RECOVERY = {
    "element_hidden": (("scroll_page", "Scroll to reveal element"), ("fetch_page", "Refresh refs")),
    "element_blocked": (("execute_action", "Dismiss overlay"), ("fetch_page", "Refresh refs")),
    "state_changed": (("fetch_page", "Page changed; refresh refs"),),
    "navigation_unexpected": (("fetch_page", "Unexpected navigation; refresh refs"),),
    "timeout_exceeded": (("wait_for", "Wait for page response"), ("fetch_page", "Rebuild after wait")),
}
# How error messages name a failure.
TIMEOUT, HIDDEN = r"(?i)timeout|timed?\s*out", r"(?i)not visible|hidden|not in the viewport|is not displayed"
BLOCKED, DETACHED = r"(?i)intercept|overlay|covered|obscured|another element", r"(?i)not attached|detached|removed from|no longer|disposed"
# Risk of tools (their names are this engine's own), and which elements an action suits (none named: any).
TOOL_RISK = {"fetch_page": "low", "execute_action": "medium", "fill_form": "medium", "fetch_pages": "high", "get_page_state": "low", "take_screenshot": "low", "navigate_back": "low", "scroll_page": "low", "wait_for": "low"}
AFFORDANCE = {"click": None, "type": ("type",), "select": ("select",), "press_key": None, "hover": None}
# Frameworks by their signal, in order, and how sure the two best known ones are.
FRAMEWORKS = ("nextjs", "nuxt", "react", "vue", "angular", "svelte")
CLOSE_SYMBOLS = ("×", "✕", "✖", "✗", "X", "x")
MOST_NAME = 50


def _steps(table: dict[str, tuple], key: Column) -> Column:
    kind = "array<struct<action:string,reason:string,priority:int>>"
    made = F.create_map(*[x for k, steps in table.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"), F.lit(i + 1).alias("priority")) for i, (a, r) in enumerate(steps)]))])
    return F.coalesce(made[key], F.array().cast(kind))


def page_recovery(state: Column) -> Column:
    return _steps(PAGE_RECOVERY, state)


def action_recovery(failure: Column) -> Column:
    return _steps(ACTION_RECOVERY, failure)


def action_failure(error: Column, before: Column, after: Column, timed_out: Column, severity: Column) -> Column:
    """struct(failure, confidence): time, then address, then what the message says, then what became of the page."""
    pick = lambda name, sure: F.struct(F.lit(name).alias("failure"), F.lit(sure).alias("confidence"))
    moved = (F.coalesce(before, F.lit("")) != "") & (F.coalesce(after, F.lit("")) != "") & (before != after)
    message = F.coalesce(error, F.lit(""))
    return (
        F.when(timed_out | message.rlike(TIMEOUT), pick("timeout_exceeded", 0.95))
        .when(moved & (severity == "major"), pick("navigation_unexpected", 0.90))
        .when(moved, pick("navigation_unexpected", 0.85))
        .when(message.rlike(HIDDEN), pick("element_hidden", 0.90))
        .when(message.rlike(BLOCKED), pick("element_blocked", 0.90))
        .when(message.rlike(DETACHED), pick("state_changed", 0.90))
        .when(F.coalesce(severity, F.lit("none")) != "none", pick("state_changed", 0.70))
        .otherwise(pick("state_changed", 0.50))
    )


def spa(html: Column) -> Column:
    """struct(framework, hydrated, has_skeleton, confidence) from what static HTML shows; null without a framework."""
    low = F.lower(F.coalesce(html, F.lit("")))
    signs = {"nextjs": "__next_data__|/_next/", "nuxt": "__nuxt__|/_nuxt/", "react": "data-reactroot|react-root", "vue": r"data-v-app|data-v-[0-9a-f]{8}", "angular": "ng-version", "svelte": r"svelte-[a-z0-9]+"}
    name = F.coalesce(*[F.when(low.rlike(signs[f]), F.lit(f)) for f in FRAMEWORKS])
    skeleton = low.rlike(r"class=[\"'][^\"']*(?:skeleton|shimmer|placeholder-glow)")
    body = F.length(F.trim(F.regexp_replace(F.regexp_replace(low, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>", ""), "<[^>]+>", " ")))
    return F.when(name.isNotNull(), F.struct(name.alias("framework"), (~(skeleton & (body < 100))).alias("hydrated"), skeleton.alias("has_skeleton"), F.when(name.isin("nextjs", "nuxt"), 0.85).otherwise(0.75).alias("confidence")))


def tool_risk(tool: Column, url: Column, active: Column) -> Column:
    """Risk of a call; fetching a page is high on the first navigation and whenever the authority changes."""
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in TOOL_RISK.items() for x in kv])[tool], F.lit("medium"))
    here, there = F.nullif(F.lower(urls.authority(url)), F.lit("")), F.nullif(F.lower(urls.authority(active)), F.lit(""))
    return F.when((tool == "fetch_page") & url.isNotNull(), F.when(here.isNull() | there.isNull() | (here != there), "high").otherwise("low")).otherwise(base)


def suits(action: Column, affordance: Column) -> Column:
    """Whether an action can be done on an element; null for an unknown action."""
    out = F.lit(None).cast("boolean")
    for name, kinds in AFFORDANCE.items():
        out = F.when(action == name, affordance.isin(*kinds) if kinds else F.lit(True)).otherwise(out)
    return out


def robots(urls_: DataFrame, rules: DataFrame) -> DataFrame:
    """(origin, url, path) and rules (origin, allow, pattern) -> with allowed: the longest pattern that matches decides, allow at a tie.

    '*' stands for any characters, a final '$' for the end. Joined by origin: a page meets the rules of its own origin only. No rule allows.
    """
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.?+^(){}\[\]|\\])", r"\\$1"), r"\*", ".*"), r"\$(?!$)", r"\\$"))
    hits = urls_.join(rules, "origin", "left").withColumn("_hit", F.coalesce(F.rlike("path", pattern), F.lit(False)) & (F.length("pattern") > 0))
    best = F.max(F.when(F.col("_hit"), F.struct(F.length("pattern").alias("n"), F.col("allow").alias("allow"))))
    return hits.groupBy("origin", "url", "path").agg(best.alias("_b")).select("origin", "url", F.coalesce("_b.allow", F.lit(True)).alias("allowed"))


def dismiss(buttons: DataFrame, tiers: dict[str, tuple[str, ...]], policy: str = "reject", confirmed: bool = True) -> DataFrame:
    """(page_id, ref, role, affordance, name) -> page_id, ref, tier of the button that closes a barrier.

    Tiers of words by policy, the first button of the first tier that has any; then, for a confirmed barrier, a bare closing sign.
    """
    order = {"accept": ("accept", "reject", "dismiss"), "dismiss": ("dismiss",)}.get(policy, ("reject", "accept", "dismiss"))
    name = F.lower("name")
    fits = (F.col("role") == "button") & F.col("affordance").isin("click", "toggle") & (F.length("name") <= MOST_NAME)
    rank = F.when(F.lit(confirmed) & F.trim("name").isin(*CLOSE_SYMBOLS), F.lit(len(order)))
    for k, tier in reversed(list(enumerate(order))):
        if tiers.get(tier):
            rank = F.when(name.rlike(terms.any_of(tiers[tier])), F.lit(k)).otherwise(rank)
    rows = buttons.filter(fits).withColumn("_k", rank).filter("_k is not null")
    names = F.create_map(*[F.lit(x) for k, t in enumerate((*order, "symbol")) for x in (k, t)])
    return rows.groupBy("page_id").agg(F.min(F.struct("_k", "ref")).alias("m")).select("page_id", "m.ref", names[F.col("m._k")].alias("tier"))


def sponsored(name: Column) -> Column:
    """Whether a card's name says that it is paid for; short Latin words count as whole words only."""
    words = "|".join(rf"\b{terms.any_of((t,))}\b" if t.isascii() else terms.any_of((t,)) for t in terms.SPONSORED)
    return name.rlike(f"(?i)(?:{words})")


def call_sequence(events: DataFrame, session: str, ts: str, tool: str, order: str) -> DataFrame:
    """Each call of a session: its number, and the seconds since the session's first call."""
    w = Window.partitionBy(session).orderBy(ts, order)
    first = F.first(ts).over(w.rowsBetween(Window.unboundedPreceding, 0))
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return events.select(session, order, F.row_number().over(w).alias("call"), F.col(tool).alias("tool"), F.round(seconds / 1e6, 3).alias("since_s"))


def stage_times(events: DataFrame, request: str, ts: str, stage: str, order: str) -> DataFrame:
    """Milliseconds of each stage of a request: until the next one begins; null for the last."""
    w = Window.partitionBy(request).orderBy(ts, order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.select(request, order, F.col(stage).alias("stage"), F.round((F.lead(micros).over(w) - micros) / 1e3, 3).alias("ms"))


def run_diagnosis(pages: DataFrame) -> DataFrame:
    """(page_id, state, antibot, spa) -> those with something to report, and what to try."""
    told = F.col("state").isNotNull() | F.col("antibot").isNotNull() | F.col("spa").isNotNull()
    steps = F.transform(page_recovery(F.col("state")), lambda s: F.concat(s["action"], F.lit(": "), s["reason"]))
    return pages.filter(told).select("page_id", "state", "antibot", F.col("spa.framework").alias("framework"), F.array_join(steps, "; ").alias("try"), F.col("state").isin("bot_blocked", "error_page").alias("evict"))
