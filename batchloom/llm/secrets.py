"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

All DataFrame expressions. Patterns give the base spans. Every other token of the secret alphabet is scored by the
log-likelihood ratio of its character pairs under a model of random strings and one of ordinary identifiers; both are
counted from labelled strings: random ones are the values of base spans and digests made by rule, identifiers are the
other words of all documents.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import free_name, materialize, named, table

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of 16 or more of ``[0-9a-f]``; shorter ones would be dropped anyway.
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: A token that the models judge, and its length at least.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z0-9+/_=-]{4,}"
#: Digests made by rule.
DIGESTS = 2_000
#: A token is a secret when random strings explain it better by this much: in all, and per character pair.
LEAST_RATIO = 6.0
LEAST_PER_PAIR = 0.2
_BLOCK = 128


def _before(lengths: Column) -> Column:
    """For each place the sum of all values before it, block by block, so that long arrays stay cheap."""
    block = F.lit(_BLOCK)
    n_blocks = F.ceil(F.size(lengths) / block).cast("int")
    starts = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda b: F.slice(lengths, b * block + 1, block))
    zero = F.lit(0).cast("int")
    total = lambda x: F.aggregate(x, zero, lambda a, v: a + v)
    sums = F.transform(blocks, total)
    return F.flatten(F.transform(blocks, lambda x, b: F.transform(
        x, lambda _, i: total(F.slice(sums, F.lit(1), b)) + total(F.slice(x, F.lit(1), i))
    )))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _spans(df: DataFrame, text: str, kind: str, pattern: str, may_match: Column, check: int = 0) -> DataFrame:
    """Add ``kind``: an array of ``(start, rank, kind, end, value)`` of all matches, in code points.

    Lengths of what lies between the matches and of the matches give their places. ``value`` is group ``check``.
    """
    source = F.when(may_match, named(text)).otherwise(F.lit(""))
    df = df.withColumn(f"_{kind}", source)
    df = df.withColumn("_m", _matches(F.col(f"_{kind}"), pattern))
    has = F.size("_m") > 0
    df = df.withColumn("_gaps", F.when(has, F.transform(
        F.split(f"_{kind}", pattern, -1), F.length)).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_lens", F.transform("_m", F.length))
    df = df.withColumn("_steps", F.zip_with(F.slice("_gaps", 1, F.size("_m")), "_lens", lambda a, b: a + b))
    values = F.when(has, _matches(F.col(f"_{kind}"), pattern, check)).otherwise(F.col("_m")) if check else F.col("_m")
    df = df.withColumn("_begin", _before(F.col("_steps"))).withColumn("_values", values)
    rank = KINDS.index(kind)
    made = F.transform("_m", lambda _, i: F.struct(
        (F.get("_begin", i) + F.get("_gaps", i)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
        (F.get("_begin", i) + F.get("_steps", i)).alias("end"), F.get("_values", i).alias("value"),
    ))
    return df.withColumn(kind, made).drop(f"_{kind}", "_m", "_gaps", "_lens", "_steps", "_begin", "_values")


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add ``assign``, ``access`` and ``hex``; matches that are too short are dropped after matching."""
    small = F.lower(named(text))
    word = small.contains("passw") | small.contains("secret") | small.contains("token") | small.contains("api")
    df = _spans(df, text, "assign", ASSIGN, word, 2)
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(s["value"]) >= 12))
    df = _spans(df, text, "access", ACCESS, named(text).contains("AKIA"))
    df = df.withColumn("access", F.filter("access", lambda s: s["end"] - s["start"] >= 18))
    return _spans(df, text, "hex", HEX, named(text).rlike(HEX))


def labelled_samples(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``token, label, n``: random strings (1) and ordinary identifiers (0).

    Identifiers are the words of all documents outside their base spans, whatever their ``key``; random strings are the
    values of those spans, and digests of numbers in hexadecimal, base 64 and capitals, so that a corpus without any has
    some.
    """
    texts = docs.select(named(text).alias("_t")).filter("_t IS NOT NULL")
    spans = base_spans(texts, "_t")
    values = spans.select(F.explode(F.concat("assign", "access", "hex")).alias("s")).select(F.col("s.value").alias("token"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("_t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = texts.select(F.explode(_matches(rest, WORD)).alias("token"))
    number = docs.sparkSession.range(DIGESTS).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("d"))
    b64 = F.rtrim(F.base64(F.unhex("d")), F.lit("="))
    made = number.select(F.explode(F.array(
        b64, F.substring("d", 1, 40), F.substring(F.upper(F.regexp_replace(b64, "[+/]", "")), 1, 20),
        F.substring(F.regexp_replace(b64, "[+/]", ""), 1, 32),
    )).alias("token"))
    random = values.union(made).select("token", F.lit(1).alias("label"))
    return random.union(words.select("token", F.lit(0).alias("label"))).groupBy("token", "label").agg(
        F.count("*").alias("n")
    )


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio per pair of alphabet characters, smoothed by half a count.

    Identifiers count once per distinct word, so that frequent words do not drown the others.
    """
    chars = F.filter(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c) > 0)
    split = samples.select("label", chars.alias("c")).filter("size(c) > 1")
    pairs = split.select("label", F.explode(F.zip_with(
        F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.concat(a, b)
    )).alias("pair"))
    counts = {(r.label, r.pair): r["count"] for r in pairs.groupBy("label", "pair").count().collect()}  # two per pair
    size, table_ = len(ALPHABET), []
    for a in ALPHABET:
        whole = [sum(counts.get((k, a + b), 0) for b in ALPHABET) + size / 2 for k in (0, 1)]
        for b in ALPHABET:
            word, rand = ((counts.get((k, a + b), 0) + 0.5) / whole[k] for k in (0, 1))
            table_.append(math.log(rand / word))
    return table_


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token of the alphabet: positive when random strings explain it better."""
    weights = F.from_json(F.lit(json.dumps(model)), "array<double>")  # folded to a constant
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), place)
    pair = F.zip_with(
        F.slice(places, F.lit(1), F.size(places) - 1), F.slice(places, F.lit(2), F.size(places) - 1),
        lambda a, b: F.element_at(weights, (a - 1) * len(ALPHABET) + b),
    )
    return F.aggregate(pair, F.lit(0.0), lambda s, x: s + x)


def scan(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of ``(start, rank, kind, end, value)`` sorted by place, then kind.

    Base spans stay; a token the models call random is added where no base span touches it. A null text is empty.
    """
    name = free_name(docs, "secrets")
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("_row"), F.coalesce(named(text), F.lit("")).alias("_t"))
    rows = base_spans(rows, "_t").withColumn("_base", F.concat("assign", "access", "hex")).drop("assign", "access", "hex")
    rows = _spans(rows, "_t", "markov", CANDIDATE, named("_t").rlike(CANDIDATE))
    free = F.filter("markov", lambda s: ~F.exists("_base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    rows = rows.withColumn("markov", free)
    judged = F.transform("markov", lambda s: F.struct(s.alias("s"), ratio(s["value"], model).alias("r")))
    pairs = lambda x: F.length(x["s"]["value"]) - 1
    rows = rows.withColumn("_judged", judged)
    added = F.transform(F.filter(
        "_judged", lambda x: (x["r"] >= LEAST_RATIO) & (x["r"] >= LEAST_PER_PAIR * pairs(x))
    ), lambda x: x["s"])
    return rows.withColumn("_all", F.array_sort(F.concat(F.col("_base"), added))).select("_row.*", F.col("_all").alias(name))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(materialize(labelled_samples(docs, "doc_id", "text"), "samples"))
    found = scan(docs, model).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col("secrets")).alias("spans"), count("markov").alias("n_markov"),
    )
