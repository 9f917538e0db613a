"""Readers: contact files, profile sheets, relation sheets, alias rules, golden sets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tieweave.functions import text as X
from tieweave.functions import values as V
from tieweave.schema import ATTRIBUTES

_null = lambda: F.lit(None).cast("string")


def read_table(spark: SparkSession, path: str, fmt: str = "csv", multiline: bool = False) -> DataFrame:
    """A sheet exported as CSV (all text), Parquet or JSON, with ``seq`` = place in the files.

    Within one file block rows are read in order, so (file, block, row) orders them
    however Spark groups the blocks into tasks.
    """
    reader = spark.read.option("header", True).option("inferSchema", False)
    if fmt == "csv":
        reader = reader.option("multiLine", multiline).option("escape", '"')
    df = reader.format(fmt).load(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select("*", place.alias("seq"))


def _last_contact(raw: DataFrame) -> list[Column]:
    """The day of the last contact where the rows tell it; what is no day is null."""
    return [F.try_to_date(F.trim(F.col("last_contact").cast("string")), "yyyy-MM-dd").alias("last_contact")] if "last_contact" in raw.columns else []


def clean_contacts(raw: DataFrame) -> DataFrame:
    """Contact file rows (network_id, seq and text columns) as typed person rows, with ``last_contact`` where the file has it."""
    if "name" not in raw.columns:
        raise ValueError("a contact file needs a 'name' column")
    cell = lambda c: F.col(c) if c in raw.columns else _null()
    return raw.select(
        "network_id", "seq", X.strip(F.col("name")).alias("name"),
        X.blank_to_null(cell("bio")).alias("bio"), X.blank_to_null(cell("notes")).alias("notes"),
        *[X.split_semicolon(cell(k)).alias(k) for k in ATTRIBUTES],
        F.lit(False).alias("is_wishlist"),
        X.strength_unclamped(cell("strength")).alias("strength"),
        X.blank_to_null(cell("context")).alias("context"),
        X.frequency_exact(cell("frequency")).alias("frequency"), *_last_contact(raw),
    ).filter(F.coalesce(F.col("name"), F.lit("")) != "")


# ------------------------------------------------------------------------ profile sheets


def header(raw: str | None) -> str:
    """Comparable form of a header: width-folded, without spaces, known aliases resolved."""
    plain = re.sub(r"\s+", "", unicodedata.normalize("NFKC", raw or ""))
    alias = re.sub(r"\s+", "", unicodedata.normalize("NFKC", V.H_VALUE_ALIAS))
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", V.H_VALUE)) if plain == alias else plain


def normalise_headers(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename columns only; the first of several equal headers wins, the rest keep their name."""
    names, origin = [], {}
    for raw in df.columns:
        name = header(raw)
        if name and name not in origin:
            origin[name] = raw
            names.append(name)
        else:
            names.append(raw)
    return df.toDF(*names), origin


def _core_bio(cell: Callable[[str], Column]) -> Column:
    def part(label: str, name: str) -> Column:
        value = X.clean_cell(cell(header(name)))
        tail = F.lit("/5") if name == V.H_VALUE else F.lit("")
        return F.when(value.isNotNull(), F.concat(F.lit(f"{label}："), value, tail))

    bio = F.concat_ws(" · ", *[part(label, name) for label, name in V.BIO_PARTS])
    return F.when(bio != "", bio)


@dataclass
class ColumnMapping:
    """Which normalised headers feed which person field.

    ``bio`` is a header or a function from a cell getter to a column.
    """

    name: str
    bio: str | Callable[[Callable[[str], Column]], Column] | None = None
    notes: str | None = None
    tags: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)
    cities: list[str] = field(default_factory=list)
    needs: list[str] = field(default_factory=list)
    strength_column: str | None = None
    context_column: str | None = None
    peers_column: str | None = None


def default_mapping() -> ColumnMapping:
    return ColumnMapping(
        name=header(V.H_NAME), bio=_core_bio, notes=header(V.H_NOTES),
        tags=[header(h) for h in (V.H_INDUSTRY, V.H_FEATURE, V.H_RESOURCE, V.H_CORE_TAG)],
        companies=[header(V.H_COMPANY)], cities=[header(V.H_CITY)], needs=[header(V.H_NEED)],
        strength_column=header(V.H_STRENGTH), context_column=header(V.H_CONTEXT), peers_column=header(V.H_PEERS),
    )


def known_headers() -> set[str]:
    names = (
        V.H_NAME, V.H_NOTES, V.H_STRENGTH, V.H_CONTEXT, V.H_PEERS, V.H_COMPANY, V.H_CITY, V.H_NEED, V.H_INDUSTRY,
        V.H_FEATURE, V.H_RESOURCE, V.H_CORE_TAG, V.H_AMOUNT, V.H_RISK, V.H_WINWIN, V.H_STAGE, V.H_INTEREST, V.H_VALUE,
        *V.H_HOUSEKEEPING,
    )
    return {header(n) for n in names}


def ignored_columns(df: DataFrame, internal: tuple[str, ...] = ("network_id", "seq")) -> DataFrame:
    """Columns no rule reads, with how many cells they fill: column_name, filled."""
    unknown = [c for c in df.columns if header(c) not in known_headers() and c not in internal]
    counts = df.agg(*[F.count(X.clean_cell(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(unknown)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(unknown)])
    if not unknown:
        return df.limit(0).select(F.lit("").alias("column_name"), F.lit(0).cast("long").alias("filled"))
    return counts.select(F.explode(rows).alias("r")).select("r.column_name", "r.filled")


def clean_profiles(df: DataFrame, mapping: ColumnMapping | None = None) -> DataFrame:
    """Profile sheet rows (normalised headers, network_id, seq) as typed person rows.

    A strength of 0 marks a wishlist contact; the row then carries no owner edge.
    """
    m = mapping or default_mapping()
    if m.name not in df.columns:
        raise ValueError(f"required column '{m.name}' not found")
    cell = lambda c: F.col(f"`{c}`") if c and c in df.columns else _null()
    bio = m.bio(cell) if callable(m.bio) else X.clean_cell(cell(m.bio))
    lists = {k: X.collect_items([cell(c) for c in getattr(m, k) if c in df.columns]) for k in ATTRIBUTES}
    strength = X.strength_0_5(cell(m.strength_column))
    return df.select(
        "network_id", "seq", X.clean_cell(cell(m.name)).alias("name"), bio.alias("bio"),
        X.clean_cell(cell(m.notes)).alias("notes"), *[v.alias(k) for k, v in lists.items()],
        (strength == 0).alias("is_wishlist"), strength.alias("strength"),
        X.clean_cell(cell(m.context_column)).alias("context"), X.clean_cell(cell(m.peers_column)).alias("peers"),
    ).filter(F.col("name").isNotNull())


def peer_mentions(profiles: DataFrame) -> DataFrame:
    """Peers named in profile rows: network_id, seq, name, peer, strength, context."""
    listed = profiles.filter(F.col("peers").isNotNull()).select(
        "network_id", "seq", "name", F.posexplode(X.split_peers(F.col("peers"))).alias("at", "raw")
    )
    # The parts feed two columns; as a column of their own they are cut out once.
    entry = listed.filter(X.is_peer_entry(F.col("raw"))).select(
        "network_id", F.struct("seq", "at").alias("seq"), "name", X.peer_name(F.col("raw")).alias("peer"), X.peer_parts(F.col("raw")).alias("parts")
    )
    return entry.select(
        "network_id", "seq", "name", "peer", F.coalesce(X.peer_strength(F.col("parts")), F.lit(V.DEFAULT_STRENGTH)).alias("strength"),
        X.peer_context(F.col("parts")).alias("context"),
    )


def read_relations(df: DataFrame) -> DataFrame:
    """Relation sheet rows under any accepted headers: network_id, seq, name, peer, ..., and ``last_contact`` where there is such a column."""
    by_name = {c.strip(): c for c in df.columns}

    def pick(key: str) -> Column:
        found = next((by_name[h] for h in V.RELATION_HEADERS[key] if h in by_name), None)
        return F.col(f"`{found}`") if found else _null()

    rows = df.select(
        "network_id", "seq", X.clean_cell(pick("a")).alias("name"), X.clean_cell(pick("b")).alias("peer"),
        X.strength_1_5(pick("strength")).alias("strength"), X.clean_cell(pick("context")).alias("context"),
        X.frequency_from_spelling(F.coalesce(X.clean_cell(pick("frequency")), F.lit(""))).alias("frequency"), *_last_contact(df),
    )
    return rows.filter(F.col("name").isNotNull() & F.col("peer").isNotNull())


# -------------------------------------------------------------------------- legacy layouts


def _plain(c: Column) -> Column:
    t = X.strip(c.cast("string"))
    return F.when(t.isNull() | F.lower(t).isin("nan", "none", "null"), F.lit("")).otherwise(t)


def _labelled(label: str, c: Column) -> Column:
    return F.when(_plain(c) != "", F.concat(F.lit(f"{label}: "), _plain(c)))


def _joined(sep: str, *cells: Column) -> Column:
    return F.concat_ws(sep, *[F.when(c != "", c) for c in cells])


def legacy_basic(df: DataFrame) -> DataFrame:
    """The old eight-column layout in today's thirteen columns."""
    col = lambda c: F.col(f"`{c}`") if c in df.columns else _null()
    blank = F.lit("")
    return df.select(
        col("序号").cast("string").alias("序号"), _plain(col(V.H_NAME)).alias(V.H_NAME), _plain(col(V.H_INDUSTRY)).alias(V.H_INDUSTRY),
        blank.alias(V.H_COMPANY), _plain(col(V.H_CONTEXT)).alias(V.H_CONTEXT), blank.alias(V.H_CITY),
        _plain(col(V.H_FEATURE)).alias(V.H_FEATURE), col(V.H_STRENGTH).cast("string").alias(V.H_STRENGTH),
        blank.alias(V.H_VALUE), _plain(col(V.H_NEED)).alias(V.H_NEED), blank.alias(V.H_RESOURCE), blank.alias(V.H_PEERS),
        F.coalesce(_labelled("能量", col("能量")), blank).alias(V.H_NOTES),
    )


def legacy_finance(df: DataFrame) -> DataFrame:
    """The old sixteen-column layout in today's thirteen columns.

    Long headers are found by their beginning. ``序号`` is the row number, which
    ``positions`` gives in file order.
    """
    def starts(prefix: str) -> Column:
        found = next((c for c in df.columns if c.startswith(prefix)), None)
        return F.col(f"`{found}`") if found else _null()

    col = lambda c: F.col(f"`{c}`") if c in df.columns else _null()
    blank = F.lit("")
    industry = _joined("；", _plain(col("行业")), _plain(starts("核心标签")))
    feature = _joined("；", _plain(col("可合作业务范围")), _plain(starts("风险承受能力")), _plain(starts("共赢性")), _plain(col("兴趣偏好")))
    notes = F.concat_ws(
        " · ", F.when(_plain(col("主要背景")) != "", _plain(col("主要背景"))),
        _labelled("单笔可投资金额", col("单笔可投资金额")), _labelled("关系阶段", starts("关系阶段")),
    )
    return df.select(
        col("序号").cast("string").alias("序号"), _plain(col(V.H_NAME)).alias(V.H_NAME), industry.alias(V.H_INDUSTRY),
        blank.alias(V.H_COMPANY), _plain(col("身份职位")).alias(V.H_CONTEXT), _plain(col("地域")).alias(V.H_CITY),
        feature.alias(V.H_FEATURE), starts("可信度").cast("string").alias(V.H_STRENGTH),
        starts("合作价值评分").cast("string").alias(V.H_VALUE), _plain(col(V.H_NEED)).alias(V.H_NEED),
        _plain(starts("资源类型")).alias(V.H_RESOURCE), blank.alias(V.H_PEERS), notes.alias(V.H_NOTES),
    )


# --------------------------------------------------------------------- rules and golden sets


def read_alias_rules(spark: SparkSession, path: str) -> DataFrame:
    """Alias rules from JSON files: ``{canonical: [..]}`` or ``[{canonical, aliases}]``."""
    return parse_alias_rules(spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw"))


def parse_alias_rules(raw: DataFrame) -> DataFrame:
    """(canonical, alias, source, group_ord, member_ord) from rule texts in ``raw``."""
    v = raw.select("raw", F.try_parse_json("raw").alias("v")).filter(F.col("v").isNotNull())
    keyed = v.filter(F.expr("schema_of_variant(v) like 'OBJECT%'")).select(
        F.posexplode(F.json_object_keys("raw")).alias("at", "key"), "v"
    ).select("at", F.trim("key").alias("canonical"), F.expr("try_cast(v as map<string, variant>)[key]").alias("list"))
    listed = v.filter(F.expr("schema_of_variant(v) like 'ARRAY%'")).select(
        F.posexplode(F.expr("try_cast(v as array<variant>)")).alias("at", "e")
    ).filter(F.expr("schema_of_variant(e) like 'OBJECT%'")).select(
        "at", F.trim(F.coalesce(F.expr("try_variant_get(e, '$.canonical', 'string')"), F.lit(""))).alias("canonical"),
        F.expr("try_variant_get(e, '$.aliases', 'variant')").alias("list"),
    ).filter("canonical <> ''")
    rows = keyed.unionByName(listed).withColumn("items", F.expr("try_cast(list as array<string>)")).filter("items is not null")
    # A canonical named twice keeps its first place and its last list.
    kept = rows.groupBy("canonical").agg(F.min("at").alias("group_ord"), F.max_by("items", "at").alias("items"))
    return kept.select(
        "canonical", "group_ord", F.posexplode(F.filter(F.transform("items", X.strip), lambda x: x != "")).alias("member_ord", "alias")
    ).select("canonical", "alias", F.lit("file").alias("source"), "group_ord", "member_ord")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries from JSON rows, as one row per named person.

    Rows: query_id, category, network_id, goal, kind (expected / forbidden), item.
    """
    schema = "id string, category string, owner string, goal string, expected_top3 array<string>, must_not_include array<string>"
    raw = spark.read.schema(schema).json(path)
    none = F.array().cast("array<string>")
    both = F.array(
        F.struct(F.lit("expected").alias("kind"), F.coalesce("expected_top3", none).alias("items")),
        F.struct(F.lit("forbidden").alias("kind"), F.coalesce("must_not_include", none).alias("items")),
    )
    return raw.select(
        F.col("id").alias("query_id"), "category", F.col("owner").alias("network_id"), "goal", F.explode(both).alias("k")
    ).select("query_id", "category", "network_id", "goal", "k.kind", F.explode("k.items").alias("item"))
