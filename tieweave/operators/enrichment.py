"""Model requests and answers as tables: attribute extraction, edge proposals, goals.

The model itself is reached through ``tieweave.operators.plugins``; everything here is
request rows in, or answer rows (``raw`` JSON text) in, typed rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieweave.functions import values as V
from tieweave.functions.text import merge_lists
from tieweave.operators import pseudonyms as N
from tieweave.operators.numbering import with_edge_ids
from tieweave.operators.folding import upsert_edges
from tieweave.operators.ranking import top_k
from tieweave.session import cut

NET = "network_id"


def json_text(raw: Column) -> Column:
    """Answer text without a surrounding code fence."""
    t = F.trim(raw)
    inner = F.ltrim(F.regexp_replace(F.trim(F.regexp_replace(t, "^`+|`+$", "")), "(?i)^json", ""))
    return F.when(t.startswith("```"), inner).otherwise(t)


def parsed(responses: DataFrame) -> DataFrame:
    """Adds ``v`` (the JSON object) and ``error`` (why there is none)."""
    t = json_text(F.col("raw"))
    v = F.try_parse_json(t)
    rows = responses.withColumn("v", v)
    kind = F.expr("schema_of_variant(v)")
    error = (
        F.when(F.coalesce(t, F.lit("")) == "", "empty answer")
        .when(F.col("v").isNull(), "not JSON")
        .when(~kind.startswith("OBJECT"), "not an object")
    )
    return rows.withColumn("error", error)


def clean_list(field: str) -> Column:
    """Stripped, distinct, non-empty text items of a JSON list; anything else is skipped."""
    items = f"try_variant_get(v, '$.{field}', 'array<variant>')"
    texts = F.expr(f"transform({items}, x -> if(schema_of_variant(x) = 'STRING', trim(try_variant_get(x, '$', 'string')), null))")
    none = F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(F.filter(texts, lambda x: x.isNotNull() & (x != ""))), none)


# --------------------------------------------------------------------------- extraction


def extraction_worklist(people: DataFrame, only_missing: bool = True, limit: int | None = None) -> DataFrame:
    """Contacts to extract for: those without companies or without cities."""
    rows = people.filter(~F.col("is_me"))
    if limit is not None:
        rows = top_k(rows, [NET], [F.col("name"), F.col("person_id")], limit, "_n").drop("_n")
    return rows.filter((F.size("companies") == 0) | (F.size("cities") == 0)) if only_missing else rows


def _field_texts(people: DataFrame) -> DataFrame:
    cols = [NET, "person_id"]
    single = people.select(*cols, F.explode(F.array(
        F.struct(F.lit("bio").alias("field"), F.col("bio").alias("text")), F.struct(F.lit("notes").alias("field"), F.col("notes").alias("text")),
    )).alias("s")).select(*cols, "s.field", F.lit(0).alias("at"), "s.text")
    lists = people.select(*cols, F.explode(F.array(
        F.struct(F.lit("tags").alias("field"), F.col("tags").alias("l")), F.struct(F.lit("cities").alias("field"), F.col("cities").alias("l")),
    )).alias("s")).select(*cols, "s.field", F.posexplode("s.l").alias("at", "text"))
    return single.unionByName(lists)


def extraction_requests(people: DataFrame, names: DataFrame, incoming: bool = False) -> DataFrame:
    """One pseudonymised JSON payload per person: network_id, person_id, payload.

    ``incoming`` people are not in the network yet: they are called P_NEW, and may bring
    ``known_companies`` / ``known_cities`` / ``known_tags`` of their own.
    """
    key = [NET, "person_id"]
    hidden = N.pseudonymise(_field_texts(people), names, [NET], [*key[1:], "field", "at"])
    ordered = lambda f: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("at", "text")))), lambda x: x["text"]
    )
    texts = hidden.groupBy(*key).agg(
        F.max(F.when(F.col("field") == "bio", F.col("text"))).alias("h_bio"), F.max(F.when(F.col("field") == "notes", F.col("text"))).alias("h_notes"),
        ordered("tags").alias("h_tags"), ordered("cities").alias("h_cities"),
    )
    known = {k: f"known_{k}" if f"known_{k}" in people.columns else k for k in ("companies", "cities", "tags")}
    links = people.select(*key, F.posexplode(known["companies"]).alias("at", "company"))
    shown = N.tokenise_companies(links, names, [NET]).groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"]).alias("h_companies")
    )
    rows = people.join(texts, key).join(shown, key, "left")
    if incoming:
        rows = rows.withColumn("_token", F.lit("P_NEW"))
    else:
        tokens = names.filter("kind = 'person'").select(NET, F.col("entity_id").alias("person_id"), F.col("token").alias("_token"))
        rows = rows.join(tokens, key)
    none = F.array().cast("array<string>")
    body = F.struct(
        F.col("_token").alias("person_token"),
        F.struct(F.col("h_bio").alias("bio"), F.col("h_notes").alias("notes"), F.col("h_tags").alias("raw_tags"), F.col("h_cities").alias("raw_cities")).alias("raw_text_fields"),
        F.struct(F.coalesce("h_companies", none).alias("companies"), F.col(known["cities"]).alias("cities"), F.col(known["tags"]).alias("tags")).alias("already_known"),
    )
    return rows.select(*key, F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def parse_extractions(responses: DataFrame, names: DataFrame) -> DataFrame:
    """Answers (network_id, person_id, raw) as four lists to add, plus ``error``.

    Company tokens become names again and unknown ones drop out; cities, titles and
    tags lose stray tokens, cities also lose words that are no city.
    """
    key = [NET, "person_id"]
    token = lambda x: x.rlike(N.ONLY_PERSON) | x.rlike(N.ONLY_COMPANY)
    rows = parsed(responses).select(
        *key, "error", F.filter(clean_list("companies"), lambda x: ~x.rlike(N.ONLY_PERSON)).alias("companies"),
        F.filter(clean_list("cities"), lambda x: ~token(x) & ~x.isin(*V.NOT_CITIES)).alias("add_cities"),
        F.filter(clean_list("titles"), lambda x: ~token(x)).alias("add_titles"),
        F.filter(clean_list("extra_tags"), lambda x: ~token(x)).alias("add_tags"),
    )
    items = rows.select(*key, F.posexplode("companies").alias("at", "text"))
    company = names.filter("kind = 'company'")
    real = N.restore(items, company, [NET], ["person_id", "at"], keep_unknown=False).withColumn("text", F.trim("text")).filter("text <> ''")
    first = real.groupBy(*key, "text").agg(F.min("at").alias("at"))
    lists = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("add_companies"))
    none = F.array().cast("array<string>")
    return rows.join(lists, key, "left").select(
        *key, F.coalesce("add_companies", none).alias("add_companies"), "add_cities", "add_titles", "add_tags", "error"
    )


def apply_extractions(people: DataFrame, diffs: DataFrame) -> DataFrame:
    """People with the lists added; titles go to the tags. ``touched`` marks changed rows."""
    rows = people.join(diffs.filter(F.col("error").isNull()).drop("error"), [NET, "person_id"], "left")
    new = {
        "companies": merge_lists(F.col("companies"), F.col("add_companies")),
        "cities": merge_lists(F.col("cities"), F.col("add_cities")),
        "tags": merge_lists(F.col("tags"), F.col("add_tags"), F.col("add_titles")),
    }
    added = F.lit(0)
    for c in ("add_companies", "add_cities", "add_titles", "add_tags"):
        added = added + F.coalesce(F.size(c), F.lit(0))
    touched = (added > 0) & ((new["companies"] != F.col("companies")) | (new["cities"] != F.col("cities")) | (new["tags"] != F.col("tags")))
    keep = [F.when(touched, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in people.columns]
    return rows.select(*keep, touched.alias("touched"))


def extraction_summary(diffs: DataFrame, applied: DataFrame) -> DataFrame:
    """Per network: answers, with additions, without, failed, people changed."""
    some = F.lit(False)
    for c in ("add_companies", "add_cities", "add_titles", "add_tags"):
        some = some | (F.size(c) > 0)
    failed = F.col("error").isNotNull()
    counts = diffs.groupBy(NET).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~failed & some).alias("with_additions"),
        F.count_if(~failed & ~some).alias("no_op"), F.count_if(failed).alias("failed"),
    )
    return counts.join(applied.groupBy(NET).agg(F.count_if("touched").alias("touched")), NET, "left")


# ----------------------------------------------------------------------- edge proposals


def edge_requests(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Pseudonymised narration per request: network_id, request_id, text. The roster is
    its own table (``pseudonyms.roster``), shared by all requests of a network."""
    return N.pseudonymise(texts.filter(F.trim("text") != ""), names, [NET], ["request_id"])


def parse_edge_answers(responses: DataFrame, names: DataFrame) -> DataFrame:
    """Proposed edges from answers (network_id, request_id, raw).

    Edges with the owner, an unknown token or equal ends are dropped; the first mention
    of a pair wins; strength and frequency outside their domain become null.
    """
    key, told = [NET, "request_id", "at"], ["context", "rationale"]
    # Answers are parsed once, and both texts get their names back together.
    first = cut(proposed_edges(responses, names))
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in told]))
    rows = first.select(*key, texts.alias("t")).select(*key, "t.*").filter("text is not null")
    back = N.restore(rows, names, [NET], [*key[1:], "column"]).groupBy(*key).agg(
        *[F.max(F.when(F.col("column") == c, F.col("text"))).alias(c) for c in told]
    )
    return first.drop(*told).join(back, key, "left")


def proposed_edges(responses: DataFrame, names: DataFrame) -> DataFrame:
    """The edges of ``parse_edge_answers`` before names are put back into context and rationale."""
    key = [NET, "request_id"]
    entries = parsed(responses).filter(F.col("error").isNull()).select(
        *key, F.posexplode(F.expr("try_variant_get(v, '$.edges', 'array<variant>')")).alias("at", "e")
    ).filter(F.expr("schema_of_variant(e) like 'OBJECT%'"))
    kind = lambda f: F.expr(f"schema_of_variant(try_variant_get(e, '$.{f}', 'variant'))")
    text = lambda f: F.trim(F.expr(f"try_variant_get(e, '$.{f}', 'string')"))
    told = lambda f: F.when((kind(f) == "STRING") & (text(f) != ""), text(f))
    token = lambda f: F.when((kind(f) == "STRING") & text(f).rlike(N.ONLY_PERSON) & (text(f) != "P000"), text(f))
    number = F.when(kind("strength") != "BOOLEAN", F.expr("try_variant_get(e, '$.strength', 'double')"))
    whole = F.when((number == F.floor(number)) & number.between(1, 5), number.cast("int"))
    spelled = (kind("strength") == "STRING") & ~text("strength").rlike(r"^\d+$")
    rows = entries.select(
        *key, "at", token("a").alias("a"), token("b").alias("b"), F.when(~F.coalesce(spelled, F.lit(False)), whole).alias("strength"),
        F.when(F.lower(text("frequency")).isin(*V.FREQUENCIES) & (kind("frequency") == "STRING"), F.lower(text("frequency"))).alias("frequency"),
        told("context").alias("context"), told("rationale").alias("rationale"),
    ).filter("a is not null and b is not null and a <> b")
    people = names.filter("kind = 'person'")
    end = lambda side: people.select(
        NET, F.col("token").alias(side), F.col("entity_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name")
    )
    both = rows.join(end("a"), [NET, "a"]).join(end("b"), [NET, "b"])
    return both.groupBy(*key, F.least("a_id", "b_id").alias("low_id"), F.greatest("a_id", "b_id").alias("high_id")).agg(
        F.min(F.struct("at", "a_id", "a_name", "b_id", "b_name", "strength", "frequency", "context", "rationale")).alias("w")
    ).select(*key, "low_id", "high_id", "w.*")


def unknown_mentions(responses: DataFrame) -> DataFrame:
    """Names in the narration that no contact has: network_id, request_id, mention."""
    return parsed(responses).filter(F.col("error").isNull()).select(NET, "request_id", F.explode(clean_list("unknown_mentions")).alias("mention"))


def attach_existing(proposals: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edge that already joins a proposed pair, if any."""
    known = pairs.select(
        NET, "low_id", "high_id", "edge_id", F.col("strength").alias("existing_strength"), F.col("source").alias("existing_source")
    )
    return proposals.join(known, [NET, "low_id", "high_id"], "left")


def proposal_context(proposals: DataFrame, neighbours: DataFrame) -> DataFrame:
    """All present edges of the people in proposals, as rows."""
    asked = proposals.select(NET, F.explode(F.array("low_id", "high_id")).alias("person_id")).distinct()
    return neighbours.join(asked, [NET, "person_id"], "left_semi")


def apply_proposals(edges: DataFrame, proposals: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted proposals become manual edges; also counts applied and skipped per network.

    Known edges keep id, introducer and further columns, new ones are numbered on.

    Proposals: network_id, source_id, target_id, strength, context, frequency, seq.
    """
    known = people.select(NET, "person_id")
    ok = (
        proposals.filter("source_id <> target_id")
        .join(known.withColumnRenamed("person_id", "source_id"), [NET, "source_id"], "left_semi")
        .join(known.withColumnRenamed("person_id", "target_id"), [NET, "target_id"], "left_semi")
    )
    cols = [NET, "source_id", "target_id", "strength", "context", "frequency", "source", "seq"]
    seq = F.struct(F.lit(1).alias("step"), F.col("seq").alias("at"))
    at = proposals.schema["seq"].dataType
    old = edges.withColumn("seq", F.struct(F.lit(0).alias("step"), F.lit(None).cast(at).alias("at"))).select(*cols)
    new = ok.withColumn("source", F.lit("manual")).withColumn("seq", seq).select(*cols)
    marked = proposals.select(NET, F.lit(0).alias("ok")).unionByName(ok.select(NET, F.lit(1).alias("ok")))
    counts = marked.groupBy(NET).agg(
        F.sum("ok").alias("applied"), (F.count_if(F.col("ok") == 0) - F.sum("ok")).alias("skipped")
    )
    return with_edge_ids(upsert_edges(old.unionByName(new)), edges), counts


# -------------------------------------------------------------------------------- goals


def parse_goals(responses: DataFrame) -> DataFrame:
    """Goal answers (goal_id, network_id, original, raw) as goal rows.

    Today's field names come first, older ones fill fields left empty; a text counts as
    a one-item list. A goal without a usable answer searches for its own words.
    """
    def listed(f: str) -> Column:
        kind = F.expr(f"schema_of_variant(try_variant_get(v, '$.{f}', 'variant'))")
        one = F.trim(F.expr(f"try_variant_get(v, '$.{f}', 'string')"))
        many = F.expr(f"transform(try_variant_get(v, '$.{f}', 'array<variant>'), x -> trim(try_variant_get(x, '$', 'string')))")
        none = F.array().cast("array<string>")
        kept = F.filter(many, lambda x: x.isNotNull() & (x != ""))
        return F.coalesce(F.when((kind == "STRING") & (one != ""), F.array(one)).when(kind.startswith("ARRAY"), kept), none)

    either = lambda new, old: F.when(F.size(listed(new)) > 0, listed(new)).otherwise(listed(old))
    said = lambda f: F.trim(F.coalesce(F.expr(f"try_variant_get(v, '$.{f}', 'string')"), F.lit("")))
    rows = parsed(responses)
    failed = F.col("error").isNotNull()
    none = F.array().cast("array<string>")
    usable = lambda c: F.when(failed, none).otherwise(c)
    return rows.select(
        "goal_id", NET, "original",
        F.when(failed, F.col("original")).otherwise(F.when(said("helper_description") != "", said("helper_description")).otherwise(said("summary"))).alias("summary"),
        usable(either("helper_roles", "roles")).alias("roles"), usable(either("helper_industries", "industries")).alias("industries"),
        usable(either("helper_skills", "skills")).alias("skills"),
        F.when(failed, F.array("original")).otherwise(either("topic_keywords", "keywords")).alias("keywords"),
        usable(listed("cities")).alias("cities"),
    )


def judge_requests(goals: DataFrame, candidates: DataFrame, people: DataFrame, head: int = 30, bio_chars: int = 400) -> DataFrame:
    """One pseudonymised judge payload per goal over its candidate head.

    Names and companies are numbered per goal, over the people of the head only.
    """
    from tieweave.operators.rerank import head_tokens

    heads = head_tokens(candidates, head).select("goal_id", NET, "person_id", "score", "rank", "token")
    full = heads.join(people.select(NET, "person_id", "name", "bio", "tags", "companies", "cities"), [NET, "person_id"])
    persons = full.select("goal_id", F.lit("person").alias("kind"), "name", "token", F.col("rank").alias("ord"))
    numbered = F.row_number().over(Window.partitionBy("goal_id").orderBy("name"))  # a head's companies only
    firms = full.select("goal_id", F.explode("companies").alias("name")).filter("name <> ''").distinct().withColumn("ord", numbered.cast("long"))
    firms = firms.select("goal_id", F.lit("company").alias("kind"), "name", F.format_string("C%03d", "ord").alias("token"), "ord")
    names = persons.unionByName(firms)
    bios = N.pseudonymise(full.select("goal_id", "person_id", F.col("bio").alias("text")), names, ["goal_id"], ["person_id"])
    links = full.select("goal_id", "person_id", F.posexplode("companies").alias("at", "company"))
    shown = N.tokenise_companies(links, names, ["goal_id"]).groupBy("goal_id", "person_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"]).alias("firms")
    )
    none = F.array().cast("array<string>")
    rows = full.join(bios, ["goal_id", "person_id"]).join(shown, ["goal_id", "person_id"], "left")
    item = F.struct(
        F.col("token").alias("id"), F.substring(F.coalesce("text", F.lit("")), 1, max(80, bio_chars)).alias("bio_excerpt"),
        F.slice("tags", 1, 8).alias("tags"), F.slice(F.coalesce("firms", none), 1, 6).alias("companies"),
        F.slice("cities", 1, 3).alias("cities"), F.round("score", 4).alias("hybrid_score"),
    )
    listed = rows.groupBy("goal_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]).alias("candidates")
    )
    intent = F.struct(
        "summary", F.col("roles").alias("helper_roles"), F.col("industries").alias("helper_industries"),
        F.col("skills").alias("helper_skills"), F.col("keywords").alias("topic_keywords"), "cities",
    )
    return goals.join(listed, "goal_id").select(
        "goal_id", F.size("candidates").alias("n"),
        F.to_json(F.struct(F.col("original").alias("goal"), intent.alias("intent"), "candidates"), {"ignoreNullFields": "false"}).alias("payload"),
    )
