"""Quality rules by host, in DataFrame functions alone.

Each document is measured and held against document rules. Failures are counted by host (``host_col``), each host's
failure rates are shrunk towards the corpus by an empirical beta prior, and a host whose shrunk rate is over a rule's
limit loses all its documents: the verdict joins back to them.

Words are runs of characters other than 0x20 and 0x09 to 0x0D. Defined results: a null text has no words; a null host
is no host, and its documents stand by their own rules; repeated rows are judged one by one; an empty table gives an
empty result. Extra columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text, written

#: The characters that count as symbols, and white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"

#: Bits of a packed word window that hold its position.
_BITS = 24


@dataclass(frozen=True)
class HostRule:
    """Documents failing ``fails`` (SQL over the measures) count against their host; over ``limit`` it is rejected."""

    name: str
    fails: str
    limit: float


#: A host is given up when nearly all that it has fails.
HOST_RULES = (
    HostRule("base", "base_failed", 0.9),
    HostRule("symbols", "n_words > 0 AND 10 * n_symbols > 3 * word_chars", 0.9),
    HostRule("dup_lines", "n_dup_lines > 30", 0.9),
)


def _windows(words: Column, n: Column) -> Column:
    """Each 3-word window as one long: 40 bits of its hash, then its position."""

    def pack(i: Column) -> Column:
        h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.shiftleft(F.shiftright(h, _BITS), _BITS).bitwiseOR(i.cast("long"))

    return F.when((n >= 3) & (n < 1 << _BITS), F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), pack))).otherwise(F.array().cast("array<bigint>"))


def _beside(items: Column, same) -> Column:
    """The items that equal the one before or after them under ``same``."""
    return F.filter(items, lambda x, i: F.coalesce(same(x, F.get(items, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(items, i + 1)), F.lit(False)))


def _covered(positions: Column) -> Column:
    """Words in the 3-word windows that begin at these positions, which ascend."""
    reach = F.transform(positions, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1) - p, F.lit(3))))
    return F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x)


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of every whole text.

    Repeated 3-word windows stand next to each other when the packed windows are sorted. Equal hashes are confirmed on
    the words; a text in which two different windows share 40 bits, or of 2**24 words or more, sorts the words themselves.
    """
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(*keep, clean_text(text_col).alias("_t"))
    step = step.select(
        *keep,
        F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
    )
    step = step.select(*keep, "word_chars", "n_symbols", "_w", F.size("_w").alias("_n"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"))
    step = step.withColumn("_p", _windows(F.col("_w"), F.col("_n")))
    step = step.withColumn("_d", _beside(F.col("_p"), lambda x, y: F.shiftright(x, _BITS) == F.shiftright(y, _BITS)))
    w, n, d = F.col("_w"), F.col("_n"), F.col("_d")
    at = lambda x: x.bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    def differs(x: Column, i: Column) -> Column:
        """This window has the hash of the one before it, but other words."""
        y = F.get(d, i - 1)
        words_differ = (F.get(w, at(x)) != F.get(w, at(y))) | (F.get(w, at(x) + 1) != F.get(w, at(y) + 1)) | (F.get(w, at(x) + 2) != F.get(w, at(y) + 2))
        return F.coalesce((F.shiftright(x, _BITS) == F.shiftright(y, _BITS)) & words_differ, F.lit(False))

    clash = F.size(F.filter(d, differs)) > 0
    whole = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    slow = F.array_sort(F.transform(_beside(whole, same), lambda x: x["i"]))
    quick = F.array_sort(F.transform(d, at))
    step = step.withColumn("_q", F.when((n >= 3) & (clash | (n >= 1 << _BITS)), slow).otherwise(quick))
    return step.select(*keep, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", _covered(F.col("_q")).alias("n_repeat_words"))


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def host_verdicts(measured: DataFrame, host_col: str = "source", rules: tuple[HostRule, ...] = HOST_RULES) -> DataFrame:
    """One row per host: its documents, shrunk failure rate by rule, and whether it is rejected.

    The prior of each rule is a beta distribution with the mean and variance of the hosts' rates (method of moments);
    its two numbers come to the driver. It weighs as much as one document at least, and as much as the corpus where
    hosts don't differ or there is one.
    """
    fails = [F.sum(F.expr(r.fails).cast("long")).cast("double").alias(f"k_{r.name}") for r in rules]
    hosts = measured.where(F.col(host_col).isNotNull()).groupBy(host_col).agg(F.count(F.lit(1)).cast("double").alias("n_docs"), *fails)
    hosts = written(hosts, "hosts")  # also lets a host with very many rows be dealt to several tasks when it is joined
    moments = [x for r in rules for x in (F.avg(F.col(f"k_{r.name}") / F.col("n_docs")).alias(f"m_{r.name}"), F.var_samp(F.col(f"k_{r.name}") / F.col("n_docs")).alias(f"v_{r.name}"))]
    found = hosts.agg(F.sum("n_docs").alias("n"), *moments).first()
    rates, bad = [], F.lit(False)
    for r in rules:
        m, v = found[f"m_{r.name}"] or 0.0, found[f"v_{r.name}"] or 0.0
        weight = (found["n"] or 1.0) if v <= 1e-12 else max(m * (1 - m) / v - 1, 1.0)
        rate = (F.col(f"k_{r.name}") + F.lit(m * weight)) / (F.col("n_docs") + F.lit(weight))
        rates.append(rate.alias(f"rate_{r.name}"))
        bad = bad | (rate > r.limit)
    return hosts.select(host_col, F.col("n_docs").cast("long"), *rates, bad.alias("host_rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: tuple[HostRule, ...] = HOST_RULES) -> DataFrame:
    """Measures, ``base_failed``, ``host_rejected`` and ``kept`` of every row."""
    measured = measures(docs, text_col, (id_col, host_col)).withColumn("base_failed", F.expr(BASE_FAILED))
    measured = written(measured, "measures")
    verdict = host_verdicts(measured, host_col, rules).select(host_col, "host_rejected")
    out = measured.join(verdict, host_col, "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def filter_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", rules: tuple[HostRule, ...] = HOST_RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. Each text is measured once; rows that fail alone go at once."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(host_col).alias("_host") if host_col in names else F.lit(None).cast("string").alias("_host"), F.col(text_col).alias("_whole"))
    measured = measures(rows, "_whole", ("_row", "_host")).withColumn("base_failed", F.expr(BASE_FAILED))
    measured = written(measured.withColumn("_row", F.when(~F.col("base_failed"), F.col("_row"))), "measures")
    bad = host_verdicts(measured, "_host", rules).where("host_rejected").select("_host")
    return measured.where(~F.col("base_failed")).join(bad, "_host", "left_anti").select("_row.*")
