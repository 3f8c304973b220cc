"""Host-level quality rules.

Rules are computed for each whole text with column expressions only; failures are summed up by
host; each host's failure rate is shrunk towards a beta prior fitted to all hosts by moments; hosts
whose shrunken rate is above a threshold are rejected, and that verdict is joined back.

Defined results: a null text has no words and fails; a null host has no verdict of its own and
does not count among the hosts. Very long texts are measured whole, inside their row; an empty table gives no rows and no prior. Repeated rows are separate documents. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuesheet.plans.session import stage

MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: A host is rejected if its shrunken share of failing documents is above this.
MAX_HOST_RATE = 0.5
SPACE = r"[\x20\x09-\x0D]"


def text_measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed).

    Repeated word triples are found inside the row: a triple's hash and its position share one long,
    a plain sort brings equal hashes together, and the words themselves confirm each match."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blanks = " \t\n\x0b\f\r"
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text.alias("t"),
        F.array_remove(F.split(text, f"{SPACE}+"), "").alias("w"),
    ).select(
        "doc_id", "host", "w", F.size("w").alias("n"), F.length(F.bin(F.size("w"))).cast("int").alias("bits"),
        F.char_length(F.translate("t", blanks, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    triples = words.select(
        "doc_id", "host", "w", "n", "bits", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""sort_array(transform(slice(w, 1, greatest(n - 2, 0)), (a, i) ->
            shiftleft(xxhash64(a, w[i + 1], w[i + 2]), bits) | cast(i as bigint)))""").alias("g"),
    )

    def same(a: str, b: str) -> str:
        p, q = (f"cast({x} & (shiftleft(1L, bits) - 1) as int)" for x in (a, b))
        equal = " and ".join(f"w[{p} + {k}] = w[{q} + {k}]" for k in range(3))
        return f"(shiftrightunsigned({a}, bits) = shiftrightunsigned({b}, bits) and {equal})"

    repeated = triples.select(
        "doc_id", "host", "n", "word_chars", "n_symbols", "n_dup_lines",
        F.expr(f"""sort_array(transform(filter(g, (x, i) ->
            (i > 0 and {same('x', 'g[i - 1]')}) or (i < n - 3 and {same('x', 'g[i + 1]')})),
            x -> x & (shiftleft(1L, bits) - 1)))""").alias("at"),
    )
    measured = repeated.select(
        "doc_id", "host", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.expr("""aggregate(at, named_struct('last', -3L, 'n', 0L), (a, p) ->
            named_struct('last', p, 'n', a.n + least(3L, p - a.last)), a -> a.n)""").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def host_verdicts(measures: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_kept) with empirical-Bayes rates.

    With mean m and variance v of the hosts' failure shares, the prior has strength m(1-m)/v - 1,
    at least 1; where v is 0 the hosts are alike and each takes the mean."""
    hosts = measures.filter("host is not null").groupBy("host").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    share = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(share).alias("m"), F.var_pop(share).alias("v")).select(
        "m", F.expr("if(v > 0, greatest(m * (1 - m) / v - 1, 1.0D), null)").alias("strength"))
    mean, strength = prior.select("m").scalar(), prior.select("strength").scalar()
    rate = F.coalesce((F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength), mean)
    return hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") <= max_rate)


def quality_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(doc_id, measures, base_failed, kept). The measures are written once and read by both branches."""
    measures = stage(text_measures(docs, host), "quality")
    # stored, so that the join can split a host with very many documents
    verdicts = stage(host_verdicts(measures, max_rate).select("host", "host_kept"), "hosts")
    return measures.join(verdicts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"),
    )
