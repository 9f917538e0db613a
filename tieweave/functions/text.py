"""Column expressions that clean cells and free text. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tieweave.functions import values as V


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(V.WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Contact files: only an empty cell is missing."""
    text = strip(c.cast("string"))
    return F.when(text != "", text)


def clean_cell(c: Column) -> Column:
    """Profile sheets: empty cells and words such as ``nan`` are missing."""
    text = strip(c.cast("string"))
    return F.when((text != "") & ~F.lower(text).isin(*V.EMPTY_WORDS), text)


def split_items(c: Column, pattern: str) -> Column:
    """Split into stripped, non-empty items; a missing cell gives an empty list."""
    items = F.transform(F.split(c, pattern), strip)
    empty = F.array().cast("array<string>")
    return F.coalesce(F.filter(items, lambda x: x != ""), empty)


def split_multi(c: Column) -> Column:
    return split_items(c, V.LIST_SEPARATORS)


def split_semicolon(c: Column) -> Column:
    return split_items(c, ";")


def split_peers(c: Column) -> Column:
    return split_items(c, V.PEER_SEPARATORS)


def collect_items(cells: list[Column]) -> Column:
    """Items of several cells, in order, each once."""
    if not cells:
        return F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*[split_multi(clean_cell(c)) for c in cells])))


def merge_lists(*lists: Column) -> Column:
    """Ordered union without empty items."""
    empty = F.array().cast("array<string>")
    joined = F.concat(*[F.coalesce(x, empty) for x in lists])
    return F.array_distinct(F.filter(joined, lambda x: x.isNotNull() & (x != "")))


def digits_clamped(digits: Column, low: int, high: int) -> Column:
    """Clamp an all-digit text of any length."""
    core = F.ltrim(digits, F.lit("0"))
    number = F.when(core == "", F.lit(0)).when(F.length(core) > 9, F.lit(high)).otherwise(
        core.try_cast("int")
    )
    return F.greatest(F.lit(low), F.least(F.lit(high), number))


def strength_0_5(c: Column) -> Column:
    """Whole-number text clamped to 0..5; anything else counts as 3."""
    text = strip(c.cast("string"))
    digits = F.regexp_extract(text, r"^[+-]?(\d+)$", 1)
    negative = text.startswith("-")
    return (
        F.when(text.isNull() | (digits == ""), F.lit(V.DEFAULT_STRENGTH))
        .when(negative, F.lit(0))
        .otherwise(digits_clamped(digits, 0, 5))
        .cast("int")
    )


def strength_1_5(c: Column) -> Column:
    """Relations sheet: clamped to 1..5, default 3."""
    text = clean_cell(c)
    digits = F.regexp_extract(text, r"^[+-]?(\d+)$", 1)
    return (
        F.when(text.isNull() | (digits == ""), F.lit(V.DEFAULT_STRENGTH))
        .when(text.startswith("-"), F.lit(1))
        .otherwise(digits_clamped(digits, 1, 5))
        .cast("int")
    )


def strength_unclamped(c: Column) -> Column:
    """Contact files: the number as written, 3 when absent or unreadable, null when no int holds it (such rows are refused)."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int")).otherwise(F.lit(V.DEFAULT_STRENGTH)).cast("int")


def frequency_from_spelling(c: Column) -> Column:
    """Profile sheets: many spellings, unknown ones mean yearly."""
    text = F.lower(strip(c))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, spellings in V.FREQUENCY_SPELLINGS.items():
        out = out.when(text.isin(*spellings), F.lit(name))
    return out.otherwise(F.lit(V.DEFAULT_FREQUENCY))


def frequency_exact(c: Column) -> Column:
    """Contact files: only the five names themselves."""
    text = F.lower(strip(c))
    return F.when(text.isin(*V.FREQUENCIES), text).otherwise(F.lit(V.DEFAULT_FREQUENCY))


def _half_width(raw: Column) -> Column:
    """A peer entry with one kind of brackets and no blanks at its end."""
    return F.regexp_replace(F.translate(raw, "（）", "()"), r"\s+$", "")


def _before_bracket(raw: Column) -> Column:
    return F.substring_index(_half_width(raw), "(", 1)


def _after_bracket(raw: Column) -> Column:
    """What follows the first bracket; null if there is none."""
    entry = _half_width(raw)
    at = F.instr(entry, "(")
    return F.when(at > 0, F.substring(entry, at + 1, F.length(entry)))


def is_peer_entry(raw: Column) -> Column:
    """``name`` or ``name(parts)``: a name without brackets and commas, and one closing bracket, at the end."""
    name, rest = _before_bracket(raw), _after_bracket(raw)
    closed = rest.isNull() | (F.instr(rest, ")") == F.length(rest)) & (F.length(rest) > 0)
    return (F.length(name) > 0) & ~name.rlike("[),，]") & closed


def peer_name(raw: Column) -> Column:
    return strip(_before_bracket(raw))


def peer_parts(raw: Column) -> Column:
    """What stands in the brackets of ``name(strength, context)``."""
    rest = F.coalesce(_after_bracket(raw), F.lit(""))
    return split_items(F.substring(rest, F.lit(1), F.greatest(F.length(rest) - 1, F.lit(0))), V.PEER_INSIDE_SEPARATORS)


def peer_strength(parts: Column) -> Column:
    """The first all-digit part, clamped to 1..5."""
    digits = F.get(F.filter(parts, lambda x: x.rlike(r"^\d+$")), F.lit(0))
    return F.when(digits.isNotNull(), digits_clamped(digits, 1, 5))


def peer_context(parts: Column) -> Column:
    """Every other part, joined."""
    first = F.array_position(F.transform(parts, lambda x: x.rlike(r"^\d+$")), F.lit(True)).cast("int") - 1
    context = F.array_join(F.filter(parts, lambda x, i: i != first), "/")
    return F.when(context != "", context)


def peer_entry(raw: Column) -> Column:
    """``name(strength, context)`` as a struct; null when the entry is malformed."""
    parts = peer_parts(raw)
    entry = F.struct(
        peer_name(raw).alias("name"), peer_strength(parts).alias("strength"), peer_context(parts).alias("context")
    )
    return F.when(is_peer_entry(raw), entry)


def scrub(text: Column) -> Column:
    """Mask identity numbers, bank cards, phones and e-mail addresses, in that order."""
    plain = F.coalesce(text, F.lit(""))
    # Most texts hold neither a long number nor an @; two cheap scans spare them the
    # boundary-aware patterns. All three number patterns need eleven digits in a row.
    out = F.regexp_replace(plain, V.WORD_START + V.ID_NUMBER + V.WORD_END, "[REDACTED_ID]")
    out = F.regexp_replace(out, V.WORD_START + V.CARD_NUMBER + V.WORD_END, "[REDACTED_CARD]")
    out = F.regexp_replace(out, V.WORD_START + V.PHONE_NUMBER + V.WORD_END, "$1****$2")
    numbers = F.when(plain.rlike("[0-9]{11}"), out).otherwise(plain)
    mails = F.regexp_replace(numbers, V.WORD_START + V.EMAIL + V.WORD_END, "$1***@$2")
    return F.when(F.contains(plain, F.lit("@")), mails).otherwise(numbers)


def edge_key(a: Column, b: Column) -> Column:
    return F.concat_ws("_", F.lit("e"), F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def bio_pairs(text: Column) -> Column:
    """``key：value · key：value`` as pairs; null unless every one of >= 2 segments parses."""
    grammar = r"^([^：:]{1,8})[：:]\s*(.+)$"
    segments = split_items(text, "[·・]")
    pairs = F.transform(
        segments,
        lambda s: F.struct(
            strip(F.regexp_extract(s, grammar, 1)).alias("key"),
            strip(F.regexp_extract(s, grammar, 2)).alias("value"),
        ),
    )
    sound = F.forall(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    return F.when((F.size(segments) >= 2) & sound, pairs)
