"""Column expressions over one person row: texts, labels and display weights."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, functions as F

from tieweave.functions import values as V

_c = F.col


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _some(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def _labelled(label: str, c: Column) -> Column:
    return F.when(_some(c), F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))


def embed_text() -> Column:
    """Text an embedding model reads for a person."""
    return F.concat_ws(
        " | ",
        _c("name"),
        F.when(_filled(_c("bio")), _c("bio")),
        _labelled("Tags", _c("tags")),
        _labelled("Skills", _c("skills")),
        _labelled("Companies", _c("companies")),
        _labelled("Cities", _c("cities")),
        _labelled("Needs", _c("needs")),
    )


def rerank_text(bio_chars: int = 400) -> Column:
    """Text a pair scorer reads for a person."""

    def part(label: str, c: Column, n: int) -> Column:
        return F.when(_some(c), F.concat(F.lit(label), F.array_join(F.slice(c, 1, n), "、")))

    return F.concat_ws(
        " | ",
        _c("name"),
        F.when(_filled(_c("bio")), F.substring(_c("bio"), 1, max(80, bio_chars))),
        part("标签：", _c("tags"), 8),
        part("公司：", _c("companies"), 6),
        part("城市：", _c("cities"), 3),
    )


def search_haystack() -> Column:
    """Folded text of every field a goal's words may hit; fields never run together."""
    fields = [_c("name"), _c("bio"), _c("notes"), _c("tags"), _c("skills"), _c("companies"), _c("cities")]
    return F.lower(F.concat_ws("\u0001", *fields))


def industry(me_aware: bool = False) -> Column:
    """First industry bucket with a keyword in tags, companies, bio or notes."""
    hay = F.lower(
        F.concat_ws(
            " ",
            F.array_join(_c("tags"), " "),
            F.array_join(_c("companies"), " "),
            F.coalesce(_c("bio"), F.lit("")),
            F.coalesce(_c("notes"), F.lit("")),
        )
    )
    out = F.when(_c("is_me") if me_aware else F.lit(False), F.lit(V.ME_INDUSTRY[0]))
    for label, words, _ in V.INDUSTRIES:
        # Plain substring tests are several times faster than one alternation pattern.
        found = functools.reduce(operator.or_, [F.contains(hay, F.lit(w.lower())) for w in words])
        out = out.when(found, F.lit(label))
    return out.otherwise(F.lit(V.OTHER_INDUSTRY[0]))


def industry_colour(label: Column) -> Column:
    colours = dict([V.ME_INDUSTRY, *[(name, colour) for name, _, colour in V.INDUSTRIES]])
    lookup = F.create_map(*[F.lit(x) for pair in colours.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, label), F.lit(V.OTHER_INDUSTRY[1]))


def node_size(strength: Column, is_me: Column, on_path: Column | None = None, me_size: int = 42) -> Column:
    size = F.when(is_me, F.lit(me_size)).otherwise(14 + 4 * F.coalesce(strength, F.lit(1)))
    return size + F.when(on_path, 10).otherwise(0) if on_path is not None else size


def edge_width(strength: Column, on_path: Column | None = None) -> Column:
    width = 1.5 + strength * 1.2
    return width * F.when(on_path, 1.8).otherwise(1.0) if on_path is not None else width


def edge_alpha(strength: Column) -> Column:
    return 0.12 + strength * 0.06


def rationale(kind: Column, relevance: Column, hops: Column, path_strength: Column) -> Column:
    """One-line explanation of a ranked result."""
    attrs = F.concat_ws(
        ", ",
        F.when(_some(_c("tags")), F.concat(F.lit("tags="), F.array_join(F.slice(_c("tags"), 1, 3), "/"))),
        F.when(_some(_c("skills")), F.concat(F.lit("skills="), F.array_join(F.slice(_c("skills"), 1, 3), "/"))),
        F.when(_some(_c("companies")), F.concat(F.lit("at="), F.array_join(F.slice(_c("companies"), 1, 2), "/"))),
    )
    head = F.format_string(
        "kind=%s, relevance=%.2f, hops=%d, path_strength=%.0f",
        kind, relevance, hops.cast("int"), path_strength.cast("double"),
    )
    return F.concat(head, F.when(attrs != "", F.concat(F.lit(" ["), attrs, F.lit("]"))).otherwise(""))


def next_step(names: Column, between_two: bool = False) -> Column:
    """What to do next for a path given as its people's names, start to end."""
    first, last = F.get(names, F.lit(0)), F.element_at(names, -1)
    second = F.get(names, F.lit(1))
    middle = F.array_join(F.slice(names, 2, F.greatest(F.size(names) - 2, F.lit(0))), " → ")
    n = F.size(names)
    if between_two:
        return (
            F.when(n < 2, F.lit(""))
            .when(n == 2, F.concat(first, F.lit(" 与 "), last, F.lit(" 直接相识，可一步打通。")))
            .when(n == 3, F.concat(F.lit("请 "), middle, F.lit(" 居间引荐 "), first, F.lit(" ↔ "), last, F.lit("。")))
            .otherwise(F.concat(F.lit("沿 "), middle, F.lit(" 链路居间引荐 "), first, F.lit(" ↔ "), last, F.lit("。")))
        )
    return (
        F.when(n < 2, F.lit("先查看资料，再决定是否联系。"))
        .when(n == 2, F.concat(F.lit("下一步：直接联系 "), last, F.lit("。")))
        .when(n == 3, F.concat(F.lit("下一步：找 "), second, F.lit("，请他引荐 "), last, F.lit("。")))
        .otherwise(
            F.concat(F.lit("下一步：从 "), second, F.lit(" 起，沿 "), middle, F.lit(" 链路引荐到 "), last, F.lit("。"))
        )
    )


def context_line(contexts: Column, fallback: Column) -> Column:
    """Non-empty relation contexts along the path, else the rationale."""
    told = F.filter(contexts, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(told) > 0, F.array_join(told, " · ")).otherwise(F.coalesce(fallback, F.lit("")))


def headline() -> Column:
    """Who the person is, in one line."""
    company, city = F.get(_c("companies"), F.lit(0)), F.get(_c("cities"), F.lit(0))
    two = lambda c: F.array_join(F.slice(c, 1, 2), " · ")
    return (
        F.when(_c("is_me"), F.lit("你的网络中心 · 从这里发起搜索"))
        .when(_some(_c("companies")) & _some(_c("cities")), F.concat_ws(" · ", company, city))
        .when(_some(_c("companies")), company)
        .when(_some(_c("cities")), city)
        .when(_some(_c("skills")), two(_c("skills")))
        .when(_some(_c("tags")), two(_c("tags")))
        .otherwise(F.lit("点下方打开完整档案"))
    )


def talking_point() -> Column:
    """Why to look at the person, in one line."""
    two = lambda c: F.array_join(F.slice(c, 1, 2), " · ")
    return (
        F.when(_c("is_me"), F.lit("输入一句话目标，看推荐路径与引荐链"))
        .when(_some(_c("needs")), F.concat(F.lit("可能在找："), two(_c("needs"))))
        .when(_some(_c("skills")), F.concat(F.lit("可聊："), two(_c("skills"))))
        .when(_some(_c("tags")), F.concat(F.lit("关联："), two(_c("tags"))))
        .otherwise(F.lit("悬停速览 · 点按钮看结构化资料与关系"))
    )
