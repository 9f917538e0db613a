"""Where the words of a dictionary occur in texts: one scan of a text for each block of words.

The words of a scope are cut into blocks of bounded bytes and the texts of a scope into parts of
bounded bytes; each pair of a block and a part is one group. A task builds the automaton of the block
(a trie with failure links) and reads every text of the part once, however many words there are. There
is no list of words that one task or the driver has to hold whole, and no second way for large ones.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Bytes of the words of a block and of the texts of a part, about.
BLOCK_BYTES = 1 << 20
PART_BYTES = 16 << 20


def _parts(rows: DataFrame, scope: list[str], text: str, by: list[str], most: int, out: str) -> DataFrame:
    """Rows with a part number under which a scope has about ``most`` bytes, and the number of parts."""
    sizes = rows.groupBy(*scope).agg(F.ceil(F.sum(F.octet_length(text) + 16) / most).cast("int").alias("_n"))
    if not scope:
        dealt = rows.crossJoin(F.broadcast(sizes))  # one row
    else:
        named = [F.col(s).alias(f"_{s}") for s in scope]
        dealt = rows.join(sizes.select(*named, "_n"), [F.col(s) == F.col(f"_{s}") for s in scope]).drop(*[f"_{s}" for s in scope])
    return dealt.withColumn(out, F.pmod(F.xxhash64(*by), F.greatest("_n", F.lit(1))).cast("int")).withColumnRenamed("_n", f"{out}s")


def _each(parts: str):
    return F.explode(F.sequence(F.lit(0), F.greatest(F.col(parts), F.lit(1)) - 1))


def _scan(texts: pa.Table, words: pa.Table) -> pa.Table:
    from ahocorasick import STORE_INTS, Automaton

    automaton = Automaton(STORE_INTS)
    terms = words.column("term").to_pylist()
    for i, term in enumerate(terms):
        automaton.add_word(term, i)
    automaton.make_automaton()
    rows, starts, found = [], [], []
    for row, text in enumerate(texts.column("_text").to_pylist()):
        for end, i in automaton.iter(text):
            rows.append(row)
            starts.append(end - len(terms[i]) + 1)
            found.append(i)
    out = texts.drop_columns(["_text"]).take(pa.array(rows, pa.int64()))
    return out.append_column("term", words.column("term").take(pa.array(found, pa.int64()))).append_column("start", pc.cast(pa.array(starts, pa.int64()), pa.int32()))


def occurrences(texts: DataFrame, words: DataFrame, scope: list[str], keys: list[str], text: str = "text", block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """scope, keys, term, start (code points before it) of every place where a term of the scope stands in a text.

    Overlapping places all count. Null texts, empty texts and empty terms have none. ``keys`` tell the
    texts of a scope apart; further columns are not read.
    """
    terms = words.select(*scope, "term").filter(F.col("term") != "").distinct()
    named = texts.filter(F.length(text) > 0).select(*scope, *keys, F.col(text).alias("_text"))
    blocks = _parts(terms, scope, "term", ["term"], block_bytes, "_block")
    pieces = _parts(named, scope, "_text", keys, part_bytes, "_part")
    counts = lambda rows, out: rows.groupBy(*scope).agg(F.max(f"{out}s").alias(f"{out}s"))
    join = lambda a, b: a.join(b, scope) if scope else a.crossJoin(F.broadcast(b))
    left = join(pieces.drop("_parts"), counts(blocks, "_block")).withColumn("_block", _each("_blocks")).drop("_blocks")
    right = join(blocks.drop("_blocks"), counts(pieces, "_part")).withColumn("_part", _each("_parts")).drop("_parts")
    group = [*scope, "_block", "_part"]
    kept = [f for f in named.schema.fields if f.name != "_text"]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", term string, start int"
    order = [f.name for f in kept]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            empty = a.select(order).slice(0, 0) if a.num_rows or a.num_columns else a
            return empty.append_column("term", pa.array([], pa.string())).append_column("start", pa.array([], pa.int32()))
        return _scan(a.select([*order, "_text"]), b)

    # Both sides may stem from one table: columns of their own keep them apart.
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, shape)
