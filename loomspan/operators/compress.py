"""Page compressors as one generic operator and a rule table: classify lines, cut, number, prefix budget, fall back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import windows


@dataclass(frozen=True)
class Style:
    """least: shortest line taken. cut: longest part kept. below: lines shorter than this are taken. terms: lines that hold one are
    taken (lower case unless ``exact``). first, tag: lines that hold one of ``first`` come before all others, tagged, outside the
    budget. indent: for lines taken by a term. numbered: prefix 'Qn. '."""

    least: int = 1
    cut: int = 200
    below: int = 0
    terms: tuple[str, ...] = ()
    exact: bool = False
    first: tuple[str, ...] = ()
    tag: str = ""
    indent: str = ""
    numbered: bool = False


# What counts on each page type.
STYLES: dict[str, Style] = {
    "default": Style(least=5, cut=300, below=1 << 30),
    "error": Style(least=3, below=1 << 30),
    "landing": Style(least=5, below=100),
    "documentation": Style(least=3, below=80, terms=("def ", "function ", "class ", "import ", "const ", "export ", "->", "=>", "return "), exact=True, indent="  "),
    "dashboard": Style(least=5, cut=300, below=80, terms=("total", "합계", "count", "average", "revenue", "users", "views", "매출", "건수", "analytics", "metric")),
    "help_faq": Style(least=5, below=120, terms=("?", "？"), numbered=True),
    "settings": Style(least=3, terms=("setting", "preference", "notification", "설정", "알림", "profile", "프로필", "account", "계정", "privacy", "개인정보", "language", "언어", "theme", "테마", "on", "off", "enable", "disable", "활성", "비활성")),
    "checkout": Style(cut=300, terms=("total", "합계", "소계", "subtotal", "合計", "step", "단계", "ステップ", "payment", "결제", "お支払い", "card", "카드", "shipping", "배송", "配送", "address", "주소", "order", "주문", "注文")),
    "login": Style(terms=("email", "password", "username", "이메일", "비밀번호", "아이디", "remember", "forgot", "소셜", "social", "google", "facebook", "apple", "kakao", "naver"), first=("error", "invalid", "incorrect", "실패", "오류", "잘못", "エラー"), tag="[error] "),
    "form": Style(terms=("name", "email", "phone", "이름", "이메일", "전화", "연락처", "message", "메시지", "comment", "submit", "제출", "등록", "label", "field", "select", "choose", "선택"), first=("error", "invalid", "required", "필수", "오류", "必須", "エラー"), tag="[validation] "),
}


def _has(x: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | x.contains(t)
    return out


def compress(lines: DataFrame, style: Style, budget_chars: int) -> DataFrame:
    """page_id, part, rank: the parts of each page's text in order, from lines (page_id, pos, line)."""
    line, lower = F.col("line"), F.lower("line")
    by_term = _has(line if style.exact else lower, style.terms)
    short = F.length(line) < style.below
    taken = lines.filter((F.length(line) >= style.least) & (short | by_term))
    part = F.substring(line, 1, style.cut)
    if style.indent:
        part = F.when(short, part).otherwise(F.concat(F.lit(style.indent), part))
    if style.numbered:
        taken = taken.withColumn("_q", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")))
        part = F.concat(F.lit("Q"), F.col("_q").cast("string"), F.lit(". "), part)
    rest = taken.select("page_id", "pos", part.alias("part"))
    if not style.first:
        kept = windows.prefix_budget(rest, "page_id", "pos", F.length("part") + 1, F.lit(budget_chars))
        return kept.select("page_id", "part", "pos")
    head = lines.filter(_has(lower, style.first)).select("page_id", "pos", F.concat(F.lit(style.tag), F.substring(line, 1, 200)).alias("part"))
    spent = head.groupBy("page_id").agg(F.sum(F.length("part") + 1).alias("spent"))
    rest = rest.join(spent, "page_id", "left").withColumn("_left", F.lit(budget_chars) - F.coalesce("spent", F.lit(0)))
    kept = windows.prefix_budget(rest, "page_id", "pos", F.length("part") + 1, F.col("_left"))
    return head.select("page_id", "part", (F.col("pos") - 1_000_000_000).alias("pos")).unionByName(kept.select("page_id", "part", "pos"))


def text_of(parts: DataFrame) -> DataFrame:
    return parts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("p")).select("page_id", F.concat_ws("\n", F.col("p.part")).alias("text"))


def by_type(lines: DataFrame, budget_chars: int) -> DataFrame:
    """page_id, text: each page in the style of its type; pages whose style takes nothing, and other types, in the default style.

    ``lines``: page_id, page_type, pos, line. One pass: a line is a part of its page's own style, of the default one, or both; the style
    is chosen by the page's type in each row. Then running sums by page, and one grouping.
    """
    line, lower, kind = F.col("line"), F.col("_lower"), F.col("page_type")
    own = {n: s for n, s in STYLES.items() if n != "default"}

    def choose(value, other):
        out = None
        for name, style in own.items():
            out = F.when(kind == name, value(style)) if out is None else out.when(kind == name, value(style))
        return out.otherwise(other)

    rows = lines.withColumn("_lower", F.lower("line"))
    short = F.length(line) < choose(lambda s: F.lit(s.below), F.lit(0))
    rows = rows.withColumn("_short", short)
    taken = choose(lambda s: (F.length(line) >= s.least) & (F.col("_short") | _has(line if s.exact else lower, s.terms)), F.lit(False))
    head = choose(lambda s: _has(lower, s.first), F.lit(False))
    cut = F.substring(line, F.lit(1), choose(lambda s: F.lit(s.cut), F.lit(200)))
    body = F.concat(F.when(F.col("_short"), F.lit("")).otherwise(choose(lambda s: F.lit(s.indent), F.lit(""))), cut)
    tagged = F.concat(choose(lambda s: F.lit(s.tag), F.lit("")), F.substring(line, 1, 200))
    plain = STYLES["default"]
    part = lambda cond, rank, text: F.when(cond, F.struct(F.lit(rank).alias("rank"), text.alias("part")))
    # rank 0: default style, 1: own style, 2: own style, outside the budget
    made = F.array_compact(F.array(part(F.length(line) >= plain.least, 0, F.substring(line, 1, plain.cut)), part(taken, 1, body), part(head, 2, tagged)))
    rows = rows.select("page_id", "page_type", "pos", F.explode(made).alias("m")).select("page_id", "page_type", "pos", "m.rank", "m.part")
    of = Window.partitionBy("page_id", "rank").orderBy("pos")
    numbered = F.concat(F.lit("Q"), F.row_number().over(of).cast("string"), F.lit(". "), "part")
    rows = rows.withColumn("part", F.when((F.col("rank") == 1) & kind.isin([n for n, s in own.items() if s.numbered]), numbered).otherwise(F.col("part")))
    rows = rows.withColumn("_run", F.sum(F.length("part") + 1).over(of.rowsBetween(Window.unboundedPreceding, 0)))
    spent = F.coalesce(F.sum(F.when(F.col("rank") == 2, F.length("part") + 1)).over(Window.partitionBy("page_id")), F.lit(0))
    rows = rows.withColumn("_left", F.when(F.col("rank") == 1, budget_chars - spent).otherwise(F.lit(budget_chars)))
    rows = rows.filter((F.col("rank") == 2) | (F.col("_run") <= F.col("_left")))
    best = F.max(F.col("rank") > 0).over(Window.partitionBy("page_id"))
    rows = rows.withColumn("_own", best).filter(F.col("_own") == (F.col("rank") > 0))
    return text_of(rows.withColumn("pos", F.when(F.col("rank") == 2, F.col("pos") - 1_000_000_000).otherwise(F.col("pos"))))
