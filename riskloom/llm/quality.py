"""Document rules and host rules for text quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import row_wise, text_bytes
from riskloom.session import materialize

MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
            "n_repeat_words": "long"}
LINES = {"n_lines": "long"}
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))


def _repeated(words: list[bytes], width: int = 5) -> int:
    """Words covered by windows of ``width`` words that occur at least twice."""
    grams = list(zip(*(words[i:] for i in range(width))))
    seen, twice = set(), set()
    if len(set(grams)) == len(grams):
        return 0
    for g in grams:
        (twice if g in seen else seen).add(g)
    covered, reach = 0, 0
    for i, g in enumerate(grams):
        if g in twice:
            covered += i + width - max(i, reach)
            reach = i + width
    return covered


def measure_text(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    solid = text.translate(None, _SPACES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = len(solid) - len(solid.translate(None, _SYMBOLS))
    return (len(words), len(solid.translate(None, _CONTINUED)), symbols, len(lines) - len(set(lines)),
            _repeated(words), len(lines))


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the measures and ``n_lines`` of each whole text, one row per row.

    A null or empty text has no words, lines or symbols.
    """
    def compute(batches):
        for batch in batches:
            found = [measure_text(x) for x in text_bytes(batch, text)]
            yield [list(x) for x in zip(*found)] or [[] for _ in (*MEASURES, *LINES)]

    return row_wise(docs, keep, text, MEASURES | LINES, compute)


def base_failed(min_words: int = 10, most_repeated_percent: int = 20):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words"))


def method_failed(most_symbols_percent: int = 10, word_length: tuple[int, int] = (3, 10), most_dup_lines_percent: int = 30):
    """The base rules, and rules on symbols per word, mean word length in characters, and duplicate lines."""
    least, most = word_length
    return (base_failed() | (100 * F.col("n_symbols") > most_symbols_percent * F.col("n_words"))
            | (F.col("word_chars") < least * F.col("n_words")) | (F.col("word_chars") > most * F.col("n_words"))
            | (100 * F.col("n_dup_lines") > most_dup_lines_percent * F.col("n_lines")))


def host_counts(measured: DataFrame, host: str = "source", failed=method_failed) -> DataFrame:
    """Documents and rule failures of each host; rows without a host are left out here."""
    return (measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
            .agg(F.count(F.lit(1)).alias("host_docs"), F.sum(failed().cast("long")).alias("host_failed")))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Moment fit of a beta prior to the hosts' failure rates.

    The variance of rates, weighted by documents, less what drawing alone would give, is
    the spread between hosts.  One row of sums comes to the driver.  No host or no spread
    gives a strong prior at the common rate.
    """
    n, k = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    row = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum(n).alias("n"), F.sum(k).alias("k"),
                    F.sum(k * k / n).alias("kk")).first()
    if not row["h"]:
        return 1.0, 1.0
    rate = min(max(row["k"] / row["n"], 1e-6), 1 - 1e-6)
    spread = row["kk"] / row["n"] - rate * rate - row["h"] * rate * (1 - rate) / row["n"]
    strength = min(max(rate * (1 - rate) / max(spread, 1e-12) - 1, 1.0), 1e6)
    return rate * strength, (1 - rate) * strength


def host_verdicts(hosts: DataFrame, most_failing: float = 0.5) -> DataFrame:
    """Each host's failure rate, shrunk by the prior, and whether it is over ``most_failing``."""
    alpha, beta = beta_prior(hosts)
    rate = (F.col("host_failed") + F.lit(alpha)) / (F.col("host_docs") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", rate > most_failing)


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", most_failing: float = 0.5) -> DataFrame:
    """``docs`` without rows that the base rules or the host rules over them reject; columns stay as they are."""
    columns = docs.columns
    wide = docs.select(F.struct(*[f"`{c}`" for c in columns]).alias("__row"), F.col(f"`{host}`").alias("__from"), F.col(f"`{text}`").alias("__text"))
    counted = measure(wide.select("__from", "__text"), ["__from"], "__text")
    judged = judge(measure(wide, ["__row", "__from"], "__text"), "__from", most_failing, counted, base_failed)
    return judged.where("kept").select("__row.*")


def judge(measured: DataFrame, host: str = "source", most_failing: float = 0.5, counted: DataFrame | None = None, failed=method_failed) -> DataFrame:
    """``measured`` with ``base_failed``, ``host_rejected`` and ``kept``.

    counted: a narrower table of the same rows to count hosts from, where ``measured`` is wide and not stored.
    failed: the document rules that ``kept`` and the host rates go by; ``base_failed`` is that of the base rules always.

    Host counts fold in each task before they move, so a host with a third of the rows is
    no burden; only rejected hosts are joined back.  A document without a host is judged
    by its own rules.
    """
    hosts = materialize(host_counts(measured if counted is None else counted, host, failed), "hosts")
    bad = host_verdicts(hosts, most_failing).where("host_rejected").select(F.col("host").alias("__host"), F.lit(True).alias("__bad"))
    judged = measured.join(bad, F.col(host) == F.col("__host"), "left")
    out = judged.withColumns({"base_failed": base_failed(), "host_rejected": F.coalesce("__bad", F.lit(False))})
    return out.withColumn("kept", ~failed() & ~F.col("host_rejected")).drop("__host", "__bad")
