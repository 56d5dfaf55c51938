"""Secret scan with DataFrame functions only: fixed patterns, and character Markov models of random strings and of
ordinary identifiers compared by log-likelihood ratio.

Both models are first-order chains over ``ALPHABET`` plus one mark for either end, with add-one smoothing, trained
from labelled tokens (token, secret): see ``training_tokens``. A candidate is a run of at least ``MIN_CHARS`` (a
parameter of ``secrets``) ``CANDIDATE`` characters of any kinds: the models alone decide. It is a secret if its mean log-likelihood ratio per step is at
least ``THRESHOLD`` and it doesn't overlap a span of the fixed patterns, which always stay.

Positions come from ``split`` and ``regexp_extract_all`` with one pattern: the parts between the matches and the
matches add up to the text, so running lengths are code point offsets. No UDF and no Arrow is involved.

Cases: null text counts as empty; no match gives zero counts, an empty ``spans`` and the digest of the empty string;
very long texts are read whole, in time that grows with the text and with matches to the power 1.5; an empty table gives
no rows; spans of two kinds that start together stand in the order of kinds.
No labelled tokens at all leave both models uniform, so that nothing beyond the fixed patterns is found. Repeated
rows keep one result each. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.base import numbers, table, text_of

# Fixed patterns, in the order of kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]"
#: Least length of a candidate: of shorter runs the mean ratio says little.
MIN_CHARS = 16
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
#: Words of ordinary identifiers, for corpora whose own words don't show them.
ORDINARY = (
    "account action active address amount application array attribute average balance batch buffer builder button cache callback category change channel character children client collection column command "
    "component config configuration connection constant container content context controller convert counter create current customer database default delete description device dictionary directory document "
    "element enabled environment error event exception expected factory feature field filter format function generator global group handler header height history identifier image index information initial "
    "instance integer interface internal international invoice iterator language layout length library license listener local location manager maximum memory message method minimum module network notification "
    "number object offset operation option order organization package parameter parent parser pattern payment permission platform pointer position previous priority process product profile project property "
    "protocol provider quantity query queue random range record reference register repository request resource response result return schedule schema section selected sequence server service session setting "
    "shipping source standard status storage string structure subscription summary support system table target template temporary test timeout timestamp transaction transform update upload user utility "
    "validate value variable version view virtual visible warning width window worker"
).split()
#: Mean log-likelihood ratio per step from which a candidate counts as random.
THRESHOLD = 0.5
#: Documents that the labelled tokens are taken from: those whose hashed id comes first.
TRAINING_DOCS = 400
#: Random strings made for the sample, in equal parts base 64, base 36 and hexadecimal.
RANDOM_STRINGS = 3000
#: Ordinary identifiers made with dates, times and numbers.
NUMBERED = 20_000


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start,stop,hit>> of the leftmost, non-overlapping matches.

    Running lengths are summed in blocks of about the square root of the number of matches: an array grows by copies,
    so one of all matches would take quadratic time.
    """
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.transform(parts, F.length), 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    kind = "array<struct<start:int,stop:int,hit:string>>"
    empty = F.from_json(F.lit("[]"), kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.length(x["hit"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("hit")))).alias("out"))

    def blocks(pairs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(pairs), size), lambda at: F.slice(pairs, at, size))

    def whole(acc: Column, block: Column) -> Column:
        block_sum = F.aggregate(block, F.struct(acc["now"]["at"].alias("at"), empty.alias("out")), step)
        return F.struct(block_sum.alias("now"), F.concat(acc["done"], F.array(acc["now"]["out"])).alias("done"))

    start = F.struct(F.struct(F.lit(0).alias("at"), empty.alias("out")).alias("now"), F.from_json(F.lit("[]"), f"array<{kind}>").alias("done"))
    one = F.transform(F.array(pairs), lambda p: F.aggregate(blocks(p), start, whole, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]["out"])))))
    return F.when(text.rlike(pattern), F.get(one, 0)).otherwise(empty)


def _steps(token: Column) -> Column:
    """Indices of a token's steps in the flat table of transitions, its two ends included."""
    n = len(ALPHABET) + 1
    place = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    at = F.concat(F.array(F.lit(0)), place, F.array(F.lit(0)))
    return F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: a * n + b)


def numbered(spark: SparkSession, rows: int = NUMBERED) -> DataFrame:
    """Seeded ordinary identifiers (token) with dates, times, versions, counters, part numbers and repeated characters."""
    draw = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    pad = lambda value, n: F.lpad(value.cast("string"), n, "0")
    digits = lambda seed, n: pad(draw(seed, 10**n), n)
    word = lambda seed: F.get(F.split(F.lit(" ".join(ORDINARY)), " "), draw(seed, len(ORDINARY)))
    year, month, day = pad(draw(1, 60) + 1980, 4), pad(draw(2, 12) + 1, 2), pad(draw(3, 28) + 1, 2)
    hour, minute, second = pad(draw(4, 24), 2), pad(draw(5, 60), 2), pad(draw(6, 60), 2)
    letters = F.substring(F.upper(word(9)), 1, 2)
    repeated = F.repeat(F.substring(F.lit(ALPHABET), draw(10, len(ALPHABET)) + 1, F.lit(1)), draw(11, 160) + 30)
    forms = [
        F.concat_ws("-", year, month, F.concat(day, F.lit("T"), hour), minute, F.concat(second, F.lit("Z"))),
        F.concat_ws("-", year, month, F.concat(day, F.lit("T"), hour), minute, second, F.concat(digits(12, 4), F.lit("Z"))),
        F.concat(year, month, day, F.lit("T"), hour, minute, second, F.lit("Z")),
        F.concat(year, month, day, hour, minute, second, digits(12, 3)),
        F.concat_ws("_", word(7), F.concat(year, month, day), F.concat(hour, minute, second)),
        F.concat_ws("/", word(7), year, month, day, F.concat(word(8), F.lit("-"), digits(12, 5))),
        F.concat_ws("-", letters, digits(12, 4), digits(13, 6), digits(14, 2)),
        F.concat_ws("-", word(7), word(8), F.concat(F.lit("v"), draw(12, 10)), digits(13, 2)),
        F.concat(F.initcap(word(7)), F.initcap(word(8)), draw(12, 10), F.initcap(word(9))),
        F.concat(F.initcap(word(7)), F.initcap(word(8)), F.initcap(word(9)), F.initcap(word(15))),
        F.concat_ws("_", F.upper(word(7)), F.upper(word(8)), digits(12, 3)),
        F.concat_ws("=", word(7), F.concat(digits(12, 6), digits(13, 6))),
        F.concat(digits(12, 8), digits(13, 8)),
        F.concat(repeated, F.when(draw(12, 2) == 1, draw(13, 10).cast("string")).otherwise(F.lit(""))),
    ]
    return spark.range(rows).select(F.get(F.array(*forms), F.pmod("id", F.lit(len(forms))).cast("int")).alias("token"))


def training_tokens(docs: DataFrame, most_docs: int = TRAINING_DOCS, random_strings: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled tokens (token, secret): seeded random strings and the values that fixed patterns found are secrets;
    other words of six and more characters of a bounded number of documents, alone, in capitals and joined as identifiers are, and
    pairs of ``ORDINARY`` words are ordinary identifiers, as those of ``numbered`` are."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    ids = keyed.filter("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(most_docs)
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    clean = F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = few.select(F.explode(F.array_distinct(F.regexp_extract_all(clean, F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_-]{6,}(?![A-Za-z0-9+/_=-])"), F.lit(0)))).alias("token"))
    ordinary = words.select(F.explode(F.array("token", F.upper("token"), F.concat("token", F.lit("_"), F.lower("token")), F.concat(F.lower("token"), F.initcap("token")), F.concat("token", F.lit("-"), F.lower("token"), F.lit("2")))).alias("token"), F.lit(0).alias("secret"))
    hits = few.select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))).alias("token"))
    seeds = spark.range(random_strings).select(F.sha2(F.col("id").cast("string"), 256).alias("hex"), F.col("id"))
    base64 = F.regexp_replace(F.substring(F.base64(F.unhex("hex")), 1, 40), "=", "")
    base36 = F.concat(*[F.conv(F.substring("hex", 1 + 12 * i, 12), 16, 36) for i in range(4)])
    made = seeds.select(F.when(F.col("id") % 3 == 0, base64).when(F.col("id") % 3 == 1, base36).otherwise(F.substring("hex", 1, 40)).alias("token"))
    fixed = [t for k in (1, 7, 31, 53) for a, b in zip(ORDINARY, ORDINARY[k:] + ORDINARY[:k], strict=True) for t in (f"{a}_{b}", a + b.title(), a.title() + b.title() + "2", f"{a}-{b}-v1", f"{a}/{b}", f"{a}_{b}".upper())]
    ordinary = ordinary.unionByName(spark.range(1).select(F.explode(F.split(F.lit(" ".join(fixed)), " ")).alias("token"), F.lit(0).alias("secret")))
    ordinary = ordinary.unionByName(numbered(spark).withColumn("secret", F.lit(0)))
    return ordinary.unionByName(hits.filter(F.length("token") >= MIN_CHARS).unionByName(made).withColumn("secret", F.lit(1)))


def train(tokens: DataFrame) -> list[float]:
    """Flat table of log-likelihood ratios for each step; what reaches the driver is two counts for each cell at most."""
    n = len(ALPHABET) + 1
    counts = tokens.filter("token is not null and secret is not null").select("secret", F.explode(_steps(F.col("token"))).alias("step")).groupBy("step").agg(F.sum(F.when(F.col("secret") > 0, 1).otherwise(0)).alias("yes"), F.sum(F.when(F.col("secret") > 0, 0).otherwise(1)).alias("no")).collect()
    yes, no = [1.0] * (n * n), [1.0] * (n * n)
    for r in counts:
        yes[r.step] += r.yes
        no[r.step] += r.no
    table = []
    for a in range(n):
        p, q = sum(yes[a * n : a * n + n]), sum(no[a * n : a * n + n])
        table += [math.log(yes[a * n + b] / p) - math.log(no[a * n + b] / q) for b in range(n)]
    return table


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio per step."""
    cells = numbers(table)
    total = F.aggregate(_steps(token), F.lit(0.0), lambda acc, i: acc + F.get(cells, i))
    return total / (F.length(token) + 1)


def _kind(found: Column, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop")))


def _line(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secrets(docs: DataFrame, table: list[float], threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of every text."""
    text = F.col("text")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    found = found.select(
        "doc_id",
        F.filter(_found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 1)) >= LEAST_VALUE).alias("assign"),
        _found(text, ACCESS).alias("access"),
        _found(text, HEX).alias("hex"),
        _found(text, f"{CANDIDATE}{{{min_chars},}}").alias("candidates"),
    )
    base = F.concat(_kind(F.col("assign"), 0), _kind(F.col("access"), 1), _kind(F.col("hex"), 2))
    found = found.withColumn("base", base)
    apart = F.filter("candidates", lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    found = found.withColumn("markov", _kind(F.filter(apart, lambda x: ratio(x["hit"], table) >= threshold), 3))
    count = lambda name: F.size(name).cast("long").alias(f"n_{name}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("markov"), F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.concat("base", "markov")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets(docs, train(training_tokens(docs)))
