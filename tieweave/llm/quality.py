"""Quality rules by host: document measures, failure rates shrunk to a prior, host verdicts.

Every document is measured on its whole text. Failures are counted by host, each rate is
drawn to an empirical beta prior fitted over all hosts by moments, and hosts whose shrunk
rate passes the limit lose all their documents. Null texts have no words and fail the base;
null hosts count as one host; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tieweave.llm import text as tx
from tieweave.session import cut

MIN_WORDS = 50
#: Largest share of words, in per cent, that may lie in repeated windows.
MAX_REPEAT_PERCENT = 50
#: A host falls if its shrunk failure rate is beyond this.
HOST_LIMIT = 0.5
WINDOW = 3
SYMBOLS = "#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_text(counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(counts)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated_words(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words in windows that occur twice or more in their text. Exact: windows are numbered, not hashed."""
    n = len(codes)
    if n < WINDOW:
        return np.zeros(len(bounds) - 1, np.int64)
    owner = tx.owners(bounds)
    starts = np.flatnonzero(owner[: n - WINDOW + 1] == owner[WINDOW - 1 :])
    window = codes[starts]
    for k in range(1, WINDOW):
        window, _ = tx.ids(window * (codes.max() + 1) + codes[starts + k])
    window, distinct = tx.ids(window * len(bounds) + owner[starts])
    again = np.bincount(window, minlength=distinct)[window] > 1
    hit = np.zeros(n, bool)
    for k in range(WINDOW):
        hit[starts[again] + k] = True
    return _per_text(hit, bounds)


def _duplicate_lines(texts: pa.Array) -> np.ndarray:
    lines, bounds = tx.parts(texts, "\n")
    worded = pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0
    codes, _ = tx.coded(lines)
    owner = tx.owners(bounds)
    _, first = np.unique(codes * len(bounds) + owner, return_index=True)
    later = worded.copy()
    later[first] = False
    return _per_text(later, bounds)


_SYMBOL_TABLE = np.isin(np.arange(256), list(SYMBOLS.encode()))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the five measures of every whole text."""
    schema = docs.select(*keep).schema
    for c in MEASURES:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.slices(batches, "text"):
            blank = tx.translated(texts, tx.BLANK_SEPARATED)
            words, bounds = tx.parts(blank, " ")
            codes, _ = tx.coded(words)
            offsets = np.frombuffer(blank.buffers()[1], np.int32).astype(np.int64)
            data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
            first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
            own = data[first : first + offsets[-1]]
            spaces = _per_text(np.frombuffer(blank.buffers()[2], np.uint8)[: offsets[-1]] == tx.SPACE if offsets[-1] else own, offsets)
            chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) - spaces
            values = [np.diff(bounds), chars, _per_text(_SYMBOL_TABLE[own], offsets), _duplicate_lines(texts), _repeated_words(codes, bounds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(np.asarray(v, np.int64)) for v in values], names=[*keep, *MEASURES]
            )

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def base_rules() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
    }


def host_rates(failed: DataFrame, host: str, fail: str = "base_failed") -> DataFrame:
    """Per host: documents, failures, prior ``alpha`` and ``beta``, and the shrunk rate.

    The prior has the mean and the between-host variance of the rates, each host counting
    once. Hosts that agree fully give a prior that outweighs any host; hosts that differ as
    much as they can give none.
    """
    hosts = failed.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(fail).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("_m"), F.var_pop(rate).alias("_v"), F.avg(F.lit(1.0) / F.col("n_docs")).alias("_i"))
    spread = F.col("_m") * (1 - F.col("_m"))
    # What the finite counts add to the variance of the rates is not a difference between hosts.
    between = F.greatest(F.col("_v") - spread * F.col("_i"), F.lit(1e-6))
    weight = F.greatest(spread / between - 1, F.lit(0.0))
    prior = moments.select((F.col("_m") * weight).alias("alpha"), ((1 - F.col("_m")) * weight).alias("beta"))
    # The prior is one row.
    return hosts.crossJoin(F.broadcast(prior)).withColumn(
        "host_rate", (F.col("n_failed") + F.col("alpha")) / (F.col("n_docs") + F.col("alpha") + F.col("beta"))
    )


def judged(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents with measures, ``base_failed``, ``host_rate`` and ``kept``."""
    rules = base_rules()
    measured = measures(docs, list(dict.fromkeys([*keep, host])))
    flagged = measured.withColumns({f"rule_{n}": r for n, r in rules.items()})
    # Only ids, hosts and numbers are written here, never texts.
    flagged = cut(flagged.withColumn("base_failed", F.greatest(*[F.col(f"rule_{n}") for n in rules])))
    hosts = host_rates(flagged, host).select(F.col(host).alias("_host"), "host_rate")
    return (
        flagged.join(hosts, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
        .withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= limit))
    )
