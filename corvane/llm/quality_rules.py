"""Host-level quality rules: rule failures by host, rates shrunk by an empirical beta prior, verdicts joined back.

Per document: four rules (shorter than `min_words`, repetition, symbols, repeated lines). Per host: how many documents fail each rule. A
host with few documents says little about itself, so each rate is shrunk towards all hosts' mean by a beta prior whose
strength comes from the spread of the hosts' rates (method of moments). A host whose shrunk rate of any rule reaches
`host_limit` is rejected with all its documents.

Defined cases: a null text has no words (and fails "short"); an empty text likewise; a null host is no host: its
documents are judged on their own and it takes no part in the prior; repeated rows each count; an empty table gives an
empty result; with fewer than two hosts, or hosts of equal rates, the prior is as strong as `max_strength` documents.
Input columns of any name are carried in the struct `row`, so none can clash.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.rows import map_text
from corvane.scratch import stored

SYMBOLS = b"#*$%&|<>"
BROADCAST_ROWS, SALTS, MIN_WORDS = 1_000_000, 64, 50
RULES = ("short", "repetition", "symbols", "lines")
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measure(texts: list) -> list:
    """The counts of FIELDS for each text."""
    out = [[] for _ in range(6)]
    for b in texts:
        b = b or b""
        words = b.split()  # bytes.split() parts at \x20 and \x09-\x0D only
        n = len(words)
        joined = b"".join(words)
        repeated = 0
        if n > 3:
            windows = list(zip(words, words[1:], words[2:], strict=False))
            if len(set(windows)) < len(windows):
                seen, end = Counter(windows), 0
                for i, w in enumerate(windows):
                    if seen[w] > 1:
                        repeated += i + 3 - max(i, end)
                        end = i + 3
        lines = [x for x in b.split(b"\n") if x.strip()]
        for col, v in zip(out, (n, len(joined.decode("utf-8", "replace")), len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)), strict=True):
            col.append(v)
    return out


def failures(min_words: int = MIN_WORDS) -> dict:
    """Each rule as a column: true where a document fails it."""
    c = F.col
    return {"short": c("n_words") < min_words, "repetition": 100 * c("n_repeat_words") > 50 * c("n_words"), "symbols": 100 * c("n_symbols") > 20 * c("word_chars"), "lines": 100 * c("n_dup_lines") > 50 * c("n_lines")}


def host_rates(measured: DataFrame, min_words: int = MIN_WORDS, max_strength: float = 1e4) -> DataFrame:
    """Per host: n, the failures of each rule and its shrunk rate. `measured` has `host` and the columns of FIELDS."""
    by = measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *[F.sum(v.cast("long")).alias(f"f_{k}") for k, v in failures(min_words).items()])
    by = stored(by, "host-counts")
    rate = {k: F.col(f"f_{k}") / F.col("n") for k in RULES}
    spread = by.agg(*[f(v).alias(f"{a}_{k}") for k, v in rate.items() for a, f in (("m", F.avg), ("v", F.var_pop))]).first()  # one row
    shrunk = []
    for k in RULES:
        m, v = spread[f"m_{k}"] or 0.0, spread[f"v_{k}"] or 0.0
        strength = min(max(m * (1 - m) / v - 1, 1.0), max_strength) if v > 0 else max_strength
        shrunk.append(((F.col(f"f_{k}") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))).alias(f"rate_{k}"))
    return by.select("host", "n", *[f"f_{k}" for k in RULES], *shrunk)


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None, host_limit: float = 0.5, min_words: int = MIN_WORDS) -> DataFrame:
    """`row` (the carried columns), the counts of FIELDS, base_failed, host_rejected and kept, one row per input row.

    Without the text among the carried columns, the measured rows are narrow and written once to the shared folder: the
    host counts and the join back read that table. With it, no text is written: rows are measured once for the host
    counts, and again beside the verdicts. Rejected hosts are counted: up to BROADCAST_ROWS are broadcast, so no row
    moves; more are joined by salted host.
    """
    carry = list(docs.columns if carry is None else carry)
    inner = carry if host in carry else [*carry, host]
    measured = lambda c: map_text(docs, lambda: measure, FIELDS, text, c).withColumn("host", F.col("row")[host].cast("string"))
    rows = measured(inner) if text in carry else stored(measured(inner), "rules")
    bad = host_rates(measured([host]) if text in carry else rows, min_words).where(F.greatest(*[F.col(f"rate_{k}") for k in RULES]) >= host_limit).select("host", F.lit(True).alias("host_rejected"))
    rules = failures(min_words)
    base = F.coalesce(rules["short"] | rules["repetition"], F.lit(True))
    bad = stored(bad, "hosts")
    if bad.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(bad), "host", "left")
    else:  # the rows of a hot host go to `SALTS` places
        salted = bad.select("host", "host_rejected", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(salted, ["host", "salt"], "left")
    out = joined.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))).withColumn("base_failed", base)
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    return out.select(F.struct(*[F.col("row")[c].alias(c) for c in carry]).alias("row"), *[f.split()[0] for f in FIELDS.split(", ")], "base_failed", "host_rejected", "kept")
