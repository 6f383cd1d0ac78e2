"""Secret scans with DataFrame functions only: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Patterns give the base spans. Further candidates are long runs of identifier characters that hold a letter; a candidate
whose mean log-likelihood ratio per transition (random strings against ordinary identifiers) passes the threshold becomes a ``markov``
span, unless it overlaps a base span. Runs without a digit, which long words are too, have a stricter threshold and must vary, so that
a letter said many times isn't one. Both models are character bigrams with add-one smoothing, trained from labelled samples.

Nulls and empty texts have no spans. Positions count code points. Repeated rows give repeated results, and extra columns stay (``scan``
replaces columns of its own names).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns, by kind in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
LEAST_VALUE = 8
KINDS = ("assign", "access", "hex", "markov")

#: Candidates of the models, and the models' symbols; any other character is symbol 0.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WIDTH = len(SYMBOLS) + 1
#: Nats per transition above which a candidate counts as random.
THRESHOLD = 0.25
#: The same for candidates without a digit, and the distinct characters that such a one must have.
LETTERS = 1.5
VARIED = 8
#: Bounds of the labelled samples: generated strings of each kind, and documents whose words are the ordinary identifiers.
SAMPLE_STRINGS = 3000
SAMPLE_DOCS = 400


def random_strings(spark: SparkSession, n: int = SAMPLE_STRINGS) -> DataFrame:
    """Labelled random strings: base64, hexadecimal and upper-case keys from a hash of a counter."""
    raw = spark.range(n, numPartitions=1).select(F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256).alias("h"))
    b64 = F.regexp_replace(F.base64(F.unhex("h")), "=", "")
    return raw.select(F.explode(F.array(b64, F.substring("h", 1, 40), F.substring(F.upper(F.translate(b64, "+/", "XZ")), 1, 20))).alias("token"))


def ordinary_identifiers(docs: DataFrame, n: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled ordinary identifiers: words of a bounded sample of documents (those with the smallest hashes of their texts), alone, joined, in camel case, and numbered."""
    hashed = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("_h"), "text")
    chosen = hashed.groupBy("_h").count().orderBy("_h").limit(n).select("_h")
    sample = hashed.join(F.broadcast(chosen), "_h").groupBy("_h").agg(F.min("text").alias("text"))
    word = sample.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,20}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("w"))
    number = F.pmod(F.hash("w"), F.lit(1000)).cast("string")
    low = F.lower("w")
    return word.select(F.explode(F.array("w", F.concat(low, F.lit("_"), low), F.concat(low, F.initcap(low)), F.concat(low, F.lit("-"), number))).alias("token"))


def train(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, as a flat WIDTH x WIDTH table; both frames have a column ``token``. Only counts of the WIDTH² transitions come to the driver."""

    def model(tokens: DataFrame) -> list[float]:
        chars = tokens.where(F.length("token") >= 2).select(F.regexp_extract_all("token", F.lit("(?s)."), F.lit(0)).alias("c"))
        code = F.transform("c", lambda c: F.instr(F.lit(SYMBOLS), c))
        pairs = chars.select(code.alias("k")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("k") - 1), lambda i: F.get("k", i - 1) * WIDTH + F.get("k", i))).alias("pair"))
        counts = [1.0] * (WIDTH * WIDTH)
        for r in pairs.groupBy("pair").count().collect():
            counts[r["pair"]] += r["count"]
        sums = [sum(counts[i * WIDTH : (i + 1) * WIDTH]) for i in range(WIDTH)]
        return [c / sums[i // WIDTH] for i, c in enumerate(counts)]

    import math

    return [math.log(a / b) for a, b in zip(model(random), model(ordinary), strict=True)]


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions, 0 for fewer than two characters."""
    # one literal, which the optimiser folds, so that no row builds the table again
    weights = F.expr("array(" + ",".join(f"{x:.6f}D" for x in table) + ")")
    codes = F.transform(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(SYMBOLS), c))
    # one value at a time: the state keeps the last code and the sum
    state = F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.when(s["last"] < 0, 0.0).otherwise(F.get(weights, s["last"] * WIDTH + c))).alias("sum")))
    return state["sum"] / F.greatest(F.length(token) - 1, F.lit(1))


def looks_random(token: Column, table: list[float], threshold: float = THRESHOLD, letters: float = LETTERS) -> Column:
    digit = token.rlike("[0-9]")
    varied = F.size(F.array_distinct(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)))) >= VARIED
    return (digit | varied) & (ratio(token, table) > F.when(digit, threshold).otherwise(letters))


def _spans(text: Column, pattern: str, found: Column, kind: str, keep) -> Column:
    """Spans of all matches that ``keep`` admits. Where a match starts follows from the lengths of the matches and of the pieces between them."""
    order = KINDS.index(kind)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(found, F.length)
    # one pass over (gap, size): the state keeps where the last match ended and the starts so far; the gap after the last match adds a start that isn't used
    start = lambda s, x: s["end"] + x["gap"]
    state = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), sizes.alias("size")), F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts")),
        lambda s, x: F.struct((start(s, x) + F.coalesce(x["size"], F.lit(0))).alias("end"), F.array_append(s["starts"], start(s, x)).alias("starts")),
    )
    begin = state["starts"]
    made = F.transform(found, lambda m, i: F.struct(F.get(F.col(f"_b_{kind}"), i).alias("start"), F.lit(order).alias("rank"), (F.get(F.col(f"_b_{kind}"), i) + F.length(m)).alias("end"), keep(m, i).alias("keep")))
    return begin, made


def scan(docs: DataFrame, table: list[float], threshold: float = THRESHOLD, letters: float = LETTERS) -> DataFrame:
    """Adds ``base`` and ``extra``: arrays of (start, rank, end), where rank is the kind's place in KINDS."""
    text = F.coalesce("text", F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": CANDIDATE}
    names = [c for c in docs.columns if c not in ("base", "extra")]
    d = docs.select(*names, *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in patterns.items()))
    d = d.select(
        *names, *(f"_m_{k}" for k in KINDS), F.transform("_m_assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE).alias("_k_assign"), F.transform("_m_markov", lambda m: looks_random(m, table, threshold, letters)).alias("_k_markov")
    )
    wanted = {"assign": F.exists("_k_assign", lambda k: k), "access": F.size("_m_access") > 0, "hex": F.size("_m_hex") > 0, "markov": F.exists("_k_markov", lambda k: k)}
    keep = {"assign": lambda m, i: F.get(F.col("_k_assign"), i), "markov": lambda m, i: F.get(F.col("_k_markov"), i)}
    made = {k: _spans(text, patterns[k], F.col(f"_m_{k}"), k, keep.get(k, lambda m, i: F.lit(True))) for k in KINDS}
    kept = [*(f"_m_{k}" for k in KINDS), "_k_assign", "_k_markov"]
    d = d.select(*names, *kept, *(F.when(wanted[k], made[k][0]).alias(f"_b_{k}") for k in KINDS))
    spans = {k: F.when(F.col(f"_b_{k}").isNull(), F.array().cast("array<struct<start:int,rank:int,end:int>>")).otherwise(F.transform(F.filter(made[k][1], lambda s: s["keep"]), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))) for k in KINDS}
    d = d.select(*names, F.array_sort(F.concat(spans["assign"], spans["access"], spans["hex"])).alias("base"), spans["markov"].alias("_extra"))
    clear = F.filter("_extra", lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return d.select(*names, "base", clear.alias("extra"))


def written_out(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_markov_secrets(docs: DataFrame) -> DataFrame:
    table = train(random_strings(docs.sparkSession), ordinary_identifiers(docs))
    found = scan(docs.select("doc_id", "text"), table)
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(written_out(F.col("base")).cast("binary"), 256).alias("base_sha256"), written_out(F.array_sort(F.concat("base", "extra"))).alias("spans"), F.size("extra").cast("long").alias("n_markov"))
