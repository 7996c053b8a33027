"""Secret scans with DataFrame functions only: fixed patterns, and a randomness test battery for all tokens.

The battery takes every run of at least 20 characters of encoded data, those inside base spans too. It infers the
encoding, then tests the alphabet's uniformity (chi-squared over symbols, and shares of character classes), runs above and
below the middle of the alphabet, and serial correlation. Each token's smallest p-value, corrected for their number, says
how unlike random data it is; random data have any p-value alike often.

Within each class of length, false discoveries are controlled twice over all tokens of the corpus: the Benjamini-Hochberg
procedure rejects tokens as structured, and of the others those with the larger p-values are reported, as far as the
estimated share of structured tokens among them is within the level. That estimate compares the number reported with what
random tokens alone would give, whose number follows from the p-values above a tenth.

Matches are located by sums over the gaps between them, in rows of their own, so the work is linear in their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, save

#: The patterns and least lengths of the base kinds, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGN = 12
#: Tokens that the battery tests.
LEAST = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
FDR = 0.05
#: Bins of p-values, ten to a power of ten; the first TENTH of them are those above a tenth.
_BINS, _TENTH = 300, 10
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by name: alphabet. The first whose alphabet holds a token is taken.
ENCODINGS = {
    "hex": _DIGIT + "abcdef",
    "HEX": _DIGIT + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGIT + _LOWER,
    "BASE36": _DIGIT + _UPPER,
    "base62": _UPPER + _LOWER + _DIGIT,
    "base64": _UPPER + _LOWER + _DIGIT + "+/",
    "base64url": _UPPER + _LOWER + _DIGIT + "-_",
}
#: Expected shares need this many symbols at least, so shorter tokens of large alphabets are not judged.
_LEAST_BITS = 80
_CLASSES = {"digits": _DIGIT, "lower": _LOWER, "upper": _UPPER}
_MATCHES = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN}


def _matches(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, m_*, g_*): the matches of each pattern in a row's text, and the lengths of the gaps before them.

    Written once, so that no later step runs the patterns again.
    """
    d = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in _MATCHES.items()))
    gaps = [F.when(F.size(f"m_{k}") > 0, F.transform(F.split("text", p, -1), F.length)).alias(f"g_{k}") for k, p in _MATCHES.items()]
    return save(d.select("rid", "doc_id", *(f"m_{k}" for k in _MATCHES), *gaps), "matches")


def _located(found: DataFrame) -> DataFrame:
    """(rid, k, s, e, m): each match and its place in code points, without assignments whose value is too short."""
    sides = F.array(*(F.struct(F.lit(i).alias("k"), F.col(f"m_{k}").alias("m"), F.col(f"g_{k}").alias("g")) for i, k in enumerate(_MATCHES)))
    each = found.select("rid", F.explode(F.filter(sides, lambda x: F.size(x["m"]) > 0)).alias("x"))
    rows = each.select("rid", F.col("x.k").alias("k"), F.posexplode(F.arrays_zip(F.col("x.m").alias("m"), F.slice("x.g", F.lit(1), F.size("x.m")).alias("g")))).select("rid", "k", "pos", F.col("col.m").alias("m"), F.col("col.g").alias("g"))
    so_far = Window.partitionBy("rid", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("e", F.sum(F.col("g") + F.length("m")).over(so_far)).select("rid", "k", (F.col("e") - F.length("m")).cast("long").alias("s"), F.col("e").cast("long").alias("e"), "m")
    short = (F.col("k") == 0) & (F.length(F.regexp_extract("m", ASSIGN, 2)) < LEAST_ASSIGN)
    return save(placed.where(~short), "spans")


def _erfc(z: Column) -> Column:
    """Two-sided normal tail of z >= 0 (Abramowitz and Stegun, 7.1.26)."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-30))


def _alphabets() -> Column:
    """The first encoding that holds the token t: its alphabet, the same as lower and upper half, and its classes."""
    out = F.lit(None)
    for alphabet in reversed(list(ENCODINGS.values())):
        half = len(alphabet) // 2
        row = F.struct(F.lit(alphabet).alias("abc"), F.lit("0" * half + "1" * (len(alphabet) - half)).alias("half"), *(F.lit("".join(c for c in alphabet if c in g)).alias(n) for n, g in _CLASSES.items()))
        out = F.when(F.col("t").rlike("^[" + alphabet.replace("-", r"\-") + "]+$"), row).otherwise(out)
    return out


def _tested(tokens: DataFrame) -> DataFrame:
    """Adds p, from 0 (structured) to 1, to rows with a token t without padding; drops those that can't be judged."""
    d = tokens.withColumn("a", _alphabets()).where("a is not null").select("*", "a.*").drop("a")
    d = d.withColumns({"n": F.length("t").cast("double"), "c": F.length("abc").cast("double")})
    d = d.where(F.col("n") * F.floor(F.log2("c")) >= _LEAST_BITS)
    n, c, t = F.col("n"), F.col("c"), F.col("t")
    without = lambda chars: F.length(F.call_function("translate", t, chars, F.lit("")))
    counts = F.transform(F.split("abc", "(?!^)"), lambda a: n - F.length(F.replace(t, a, F.lit(""))))
    d = d.withColumns({
        "squares": F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x),
        "bits": F.call_function("translate", t, F.col("abc"), F.col("half")),
        "v": F.transform(F.split("t", "(?!^)"), lambda x: F.instr(F.col("abc"), x).cast("double")),
        # a class that the alphabet lacks, or is all of it, tests nothing
        **{f"z_{k}": F.when((F.length(k) > 0) & (F.length(k) < c), F.try_divide(F.abs(n - without(F.col(k)) - n * F.length(k) / c), F.sqrt(n * F.length(k) / c * (1 - F.length(k) / c)))) for k in _CLASSES},
    })
    classes = [F.col(f"z_{k}") for k in _CLASSES]
    bits, total = F.col("bits"), lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    later = F.concat(F.slice("v", F.lit(2), F.size("v")), F.slice("v", F.lit(1), F.lit(1)))
    d = d.withColumns({
        "ones": n - F.length(F.replace(bits, F.lit("1"), F.lit(""))),
        "turns": (2 * n - F.length(F.replace(bits, F.lit("01"), F.lit(""))) - F.length(F.replace(bits, F.lit("10"), F.lit("")))) / 2,
        "total": total(F.col("v")),
        "square": total(F.transform("v", lambda x: x * x)),
        "lagged": total(F.zip_with("v", later, lambda x, y: x * y)),
    })
    mean, spread = 2 * F.col("ones") * (n - F.col("ones")) / n, n * F.col("square") - F.col("total") * F.col("total")
    chi = F.abs((F.col("squares") * c / n - n - (c - 1)) / F.sqrt(2.0 * (c - 1) * (n - 1) / n))
    runs = F.when(mean > 1, F.try_divide(F.abs(F.col("turns") - mean), F.sqrt(mean * (mean - 1) / (n - 1)))).otherwise(F.lit(30.0))
    serial = F.when(spread > 0, F.abs(F.try_divide(n * F.col("lagged") - F.col("total") * F.col("total"), spread) + 1 / (n - 1)) * F.sqrt(n)).otherwise(F.lit(30.0))
    tests = 3 + sum(x.isNotNull().cast("int") for x in classes)
    d = d.withColumn("least", F.least(_erfc(F.greatest(chi, runs, serial, *classes)), F.lit(1 - 1e-12)))
    return d.withColumn("p", -F.expm1(tests * F.log1p(-F.col("least")))).select(*tokens.columns, "p")


def _parts(m: Column, s: Column) -> Column:
    """Array of (s, e, t), t without padding, of a match m at s: the whole, or if no encoding holds it, the runs of at
    least LEAST characters between + and /, and those between - and _; runs of the two kinds may overlap."""
    body = F.rtrim(m, F.lit("="))
    whole = F.array(F.struct(s.alias("s"), (s + F.length(m)).alias("e"), body.alias("t")))
    runs = []
    for cut in (r"[+/]", r"[_-]"):
        zero = F.struct(s.alias("at"), F.array().cast("array<struct<s:bigint,e:bigint,t:string>>").alias("a"))

        def step(acc, t):
            e = acc["at"] + F.length(t)
            own = F.when(F.length(t) >= LEAST, F.array(F.struct(acc["at"].alias("s"), e.alias("e"), t.alias("t")))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,t:string>>"))
            return F.struct((e + 1).alias("at"), F.concat(acc["a"], own).alias("a"))

        runs.append(F.aggregate(F.split(body, cut, -1), zero, step)["a"])
    # the last run has the match's padding
    end = s + F.length(body)
    padded = F.transform(F.concat(*runs), lambda x: F.struct(x["s"].alias("s"), F.when(x["e"] == end, s + F.length(m)).otherwise(x["e"]).alias("e"), x["t"].alias("t")))
    return F.when(body.rlike("[+/]") & body.rlike("[_-]"), F.array_sort(padded)).otherwise(whole)


def _tokens(spans: DataFrame) -> DataFrame:
    """(rid, s, e, inside, stratum, bin): the tokens that the battery judges; inside: a base span overlaps."""
    parts = spans.where(F.col("k") == len(KINDS)).select("rid", F.explode(_parts(F.col("m"), F.col("s"))).alias("x")).select("rid", "x.*")
    judged = _tested(parts).select("rid", "s", "e", F.least(F.floor(F.log2(F.length("t").cast("double"))), F.lit(15)).cast("int").alias("stratum"), F.least(F.floor(-10 * F.log10(F.greatest("p", F.lit(1e-30)))), F.lit(_BINS)).cast("int").alias("bin"))
    # in the order of where base spans start and tokens end, the furthest end of a base span so far
    base = spans.where(F.col("k") < len(KINDS)).select("rid", F.col("s").alias("at"), F.lit(1).alias("turn"), F.col("e").alias("reach"))
    both = judged.withColumns({"at": F.col("e"), "turn": F.lit(0)}).unionByName(base, allowMissingColumns=True)
    so_far = Window.partitionBy("rid").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    marked = both.withColumn("inside", F.coalesce(F.max("reach").over(so_far) > F.col("s"), F.lit(False))).where("stratum is not null")
    return save(marked.select("rid", "s", "e", "inside", "stratum", "bin"), "tokens")


def limits(counts: list[tuple[int, int, int]], level: float = FDR) -> dict[int, int]:
    """For each class of length the bin below which tokens are reported, from (class, bin, number of tokens).

    Of r random tokens, r * (1 - p) have p-values above p, so those above a tenth say what r is; structured tokens are taken
    to lie below. Bins are reported as far as they hold no more than random tokens give, the level's share and one standard
    error; and none that Benjamini-Hochberg rejects.
    """
    out: dict[int, int] = {}
    for stratum in {s for s, _, _ in counts}:
        own = sorted((b, n) for s, b, n in counts if s == stratum)
        total, seen, rejected = sum(n for _, n in own), 0, _BINS + 1
        for b, n in reversed(own):
            seen += n
            if 10 ** (-b / 10) <= level * seen / total:  # the largest p-value of the bin
                rejected = b
        above = lambda b: 1 - 10 ** (-(b + 1) / 10)  # noqa: E731  share of random tokens in the bins up to b
        random = sum(n for b, n in own if b < _TENTH) / above(_TENTH - 1)
        seen, best = 0, 0
        for b, n in own:
            seen += n
            if seen - random * above(b) <= level * seen + seen**0.5:
                best = b + 1
        out[stratum] = min(best, rejected)
    return out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, n_confirmed) for each row of (doc_id, text).

    Base kinds are the leftmost non-overlapping matches of their patterns, without those too short. ``random`` spans are
    tokens that the battery reports and that no base span overlaps; of a token that no encoding holds, its runs between +
    and / and those between - and _, which may overlap. Reported tokens that a base span overlaps are n_confirmed. Spans
    are kind:start:end in code points, end exclusive, by start and kind, comma-joined; base_sha256 is of the base spans
    alone. A null text is empty and has no spans. Every row of the input, repeated ones and those without id too, has one
    row; an empty table gives none. Other columns are ignored.
    """
    found = _matches(docs)
    spans = _located(found)
    tokens = _tokens(spans)
    counts = tokens.groupBy("stratum", "bin").count().collect()  # at most 16 * 301 rows
    reported = F.lit(False)
    for stratum, below in limits([tuple(r) for r in counts]).items():
        reported = reported | ((F.col("stratum") == stratum) & (F.col("bin") < below))
    kept = tokens.where(reported).select("rid", "s", F.lit(len(KINDS)).alias("k"), "e", "inside")
    everything = spans.where(F.col("k") < len(KINDS)).select("rid", "s", "k", "e", F.lit(False).alias("inside")).unionByName(kept)
    shown = F.when(~F.col("inside"), F.struct("s", "k", "e"))
    kind = lambda i: F.count_if((F.col("k") == i) & ~F.col("inside"))
    per = everything.groupBy("rid").agg(F.array_sort(F.collect_list(shown)).alias("all"), *(kind(i).alias(f"n_{k}") for i, k in enumerate((*KINDS, "random"))), F.count_if("inside").alias("n_confirmed"))
    names = F.array(*map(F.lit, (*KINDS, "random")))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    texts = per.select("rid", joined(F.filter("all", lambda x: x["k"] < len(KINDS))).alias("base"), joined(F.col("all")).alias("spans"), *(c for c in per.columns if c.startswith("n_")))
    rows = found.select("rid", "doc_id").join(texts, "rid", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", *(number(f"n_{k}") for k in KINDS), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), number("n_random"), number("n_confirmed"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan_secrets(read_table(spark, sf_dir, "documents"))
