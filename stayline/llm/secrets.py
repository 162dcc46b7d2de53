"""Secret scans with DataFrame functions only.

Base kinds are found by pattern. Further candidates are tokens of 16 characters or more, with
the padding behind them; their encoding is inferred, and a battery of four tests asks whether the token could be a
uniformly random string of that encoding: chi-squared uniformity of the alphabet, the
number of runs above and below the middle of the alphabet, the serial correlation of
neighbours, and the shares of capitals, small letters and other signs. The four p-values are combined by Fisher's method. Which tokens are rejected
as not random is decided by the false-discovery procedure of Benjamini and Hochberg over
all documents, within each encoding and length band, so that short tokens, for which the
tests have little power, do not set the bar for long ones. What is not rejected is a secret.

Positions are code points, ends exclusive. Defined results: a null text counts as empty,
without spans; repeated rows each give their result; other columns stay as they are,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.session import stage

KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_TOKEN = 8, 16, 16
#: The base patterns, letters of the keywords in either case. The least length
#: of hex and access belongs to the pattern, since their matches are whole runs either way.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}",
    "random": rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}=*",
}
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Which tokens an encoding fits, and its alphabet in the order of values; the first fit counts.
ENCODINGS = (
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[a-z0-9]+$", _DIGITS + _LOWER),
    (r"^[A-Z0-9]+$", _DIGITS + _UPPER),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    (r"^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    (r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
)
FALSE_DISCOVERY = 0.01
#: Bins of -log10 p: so many for each power of ten, up to the largest power kept apart.
_PER_POWER, _MOST_POWER = 20, 30
_CHUNK = 256
_MATCHES, _PLACES = "__matches", "__places"
REDACTED = "[redacted]"


def _places(kind: str) -> Column:
    """Spans of the matches of ``kind``: lengths of matches and of the pieces between them,
    summed up. Chunks keep the cost of appending linear in the number of matches."""
    whole, cut, value = (F.col(_MATCHES)[kind][name] for name in ("whole", "cut", "value"))

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.get(cut, i))
        end = start + F.length(F.get(whole, i))
        span = F.struct(start.alias("start"), end.alias("end"), F.get(value, i).alias("token"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    one = "array<struct<start:int,end:int,token:string>>"

    def chunk(state: Column, c: Column) -> Column:
        first = c * _CHUNK
        inner = F.aggregate(
            F.sequence(first, F.least(first + _CHUNK, F.size(whole)) - 1),
            F.struct(state["at"].alias("at"), F.array().cast(one).alias("spans")),
            step,
        )
        return F.struct(inner["at"].alias("at"), F.concat(state["spans"], F.array(inner["spans"])).alias("spans"))

    chunks = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / _CHUNK).cast("int")),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{one}>").alias("spans")),
        chunk,
        lambda state: F.flatten(state["spans"]),
    )
    return F.when(F.size(whole) > 0, chunks).otherwise(F.array().cast(one))


def _typed(places: Column, kind: str) -> Column:
    number = F.lit(KINDS.index(kind))
    return F.transform(places, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))


def _two_sided(z: Column) -> Column:
    """Normal tail on both sides, 1.2e-7 in relative terms (the usual rational exponent)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    series = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        series = series * t + c
    return F.greatest(t * F.exp(-x * x + series), F.lit(1e-300))


def _fisher(token: Column) -> Column:
    """(encoding, length band, bin of -log10 p) of a token, p that of the whole battery."""
    encoding = F.coalesce(*[F.when(token.rlike(p), F.lit(i)) for i, (p, _) in enumerate(ENCODINGS)], F.lit(-1))
    alphabet = F.coalesce(*[F.when(token.rlike(p), F.lit(a)) for p, a in ENCODINGS], F.lit(_UPPER + _LOWER + _DIGITS + "+/-_"))

    def battery(known: Column) -> Column:
        token, alphabet, n = known["token"], known["alphabet"], known["n"].cast("double")
        k = F.length(alphabet).cast("double")
        squares = F.aggregate(
            F.split(alphabet, ""),
            F.lit(0.0),
            lambda total, c: total + F.pow(F.length(token) - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)),
        )
        middle, spread = (k - 1) / 2, (k * k - 1) / 12

        def neighbour(state: Column, c: Column) -> Column:
            x = F.instr(alphabet, c) - 1 - middle
            first = state["x"].isNull()
            return F.struct(
                x.alias("x"),
                (state["turns"] + F.when(~first & ((x > 0) != (state["x"] > 0)), 1.0).otherwise(0.0)).alias("turns"),
                (state["products"] + F.coalesce(x * state["x"], F.lit(0.0))).alias("products"),
            )

        start = F.struct(F.lit(None).cast("double").alias("x"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("products"))
        walked = F.aggregate(F.split(token, ""), start, neighbour)

        def off(signs: str) -> Column:
            share = F.length(F.regexp_replace(alphabet, signs, "")) / k
            seen = F.length(F.regexp_replace(token, signs, ""))
            return F.when(share > 0, F.pow(seen - n * share, F.lit(2.0)) / (n * share)).otherwise(0.0)

        both = alphabet.rlike("[A-Z]") & alphabet.rlike("[a-z]")
        mixture = off("[^A-Z]") + off("[^a-z]") + off("[A-Za-z]")
        return F.struct(
            known["encoding"].alias("encoding"),
            n.alias("n"),
            k.alias("k"),
            (k / n * squares - n).alias("statistic"),
            walked["turns"].alias("turns"),
            (walked["products"] / spread).alias("products"),
            both.alias("both"),
            mixture.alias("mixture"),
        )

    def combined(t: Column) -> Column:
        n, k = t["n"], t["k"]
        # chi-squared: exact mean and variance under the multinomial, gamma of the same moments
        variance = 2 * (k - 1) * (n - 1) / n
        freedom = 2 * (k - 1) * (k - 1) / variance
        ratio = F.greatest(t["statistic"], F.lit(0.0)) / (k - 1)
        z = (F.pow(ratio, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
        tail = _two_sided(z) / 2
        uniform = F.greatest(F.when(z > 0, tail).otherwise(1 - tail), F.lit(1e-300))
        runs = _two_sided((t["turns"] - (n - 1) / 2) / (F.sqrt(n - 1) / 2))
        serial = _two_sided(t["products"] / F.sqrt(n - 1))
        # three classes of signs have two degrees of freedom, two classes one
        mixture = F.when(t["both"], F.exp(-t["mixture"] / 2)).otherwise(_two_sided(F.sqrt(t["mixture"])))
        mixture = F.least(F.greatest(mixture, F.lit(1e-300)), F.lit(1.0))
        half = -(F.log(uniform) + F.log(runs) + F.log(serial) + F.log(mixture))
        power = (half - F.log(1 + half + half * half / 2 + half * half * half / 6)) / math.log(10)
        return F.struct(
            t["encoding"].alias("encoding"),
            F.floor(F.log2(n)).cast("int").alias("band"),
            F.floor(F.least(F.greatest(power, F.lit(0.0)), F.lit(float(_MOST_POWER))) * _PER_POWER).cast("int").alias("bin"),
        )

    given = F.struct(token.alias("token"), alphabet.alias("alphabet"), F.length(token).alias("n"), encoding.alias("encoding"))
    # transform over one element names a value once, so that it is computed once
    return F.get(F.transform(F.transform(F.array(given), battery), combined), F.lit(0))


def find_places(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column of the places by kind; candidates carry their tests."""
    text = F.coalesce("text", F.lit(""))
    signs = {
        "assign": F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": F.lit(True),
        "random": F.lit(True),
    }
    names = docs.columns
    whole = {
        k: F.when(signs[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
        for k, p in PATTERNS.items()
    }
    found = docs.select(*names, F.struct(*[c.alias(k) for k, c in whole.items()]).alias(_MATCHES))

    def parts(kind: str) -> Column:
        matches = F.col(_MATCHES)[kind]
        group = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1)) if kind == "assign" else matches
        cut = F.split(text, PATTERNS[kind], -1)
        some = F.size(matches) > 0
        return F.struct(matches.alias("whole"), F.when(some, group).alias("value"), F.when(some, cut).alias("cut"))

    found = found.select(*names, F.struct(*[parts(k).alias(k) for k in KINDS]).alias(_MATCHES))
    found = found.select(*names, F.struct(*[_places(k).alias(k) for k in KINDS]).alias(_PLACES))
    places = {k: F.col(_PLACES)[k] for k in KINDS}
    places["assign"] = F.filter(places["assign"], lambda s: F.length(s["token"]) >= LEAST_ASSIGN)
    base = F.flatten(F.array(*[_typed(places[k], k) for k in KINDS[:3]]))
    found = found.select(
        *names, F.struct(F.array_sort(base).alias("base"), places["random"].alias("random")).alias(_PLACES)
    )
    outside = F.filter(
        F.col(_PLACES)["random"],
        lambda c: ~F.exists(F.col(_PLACES)["base"], lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    tested = F.transform(
        outside, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _fisher(F.rtrim(c["token"], F.lit("="))).alias("test"))
    )
    return found.select(*names, F.struct(F.col(_PLACES)["base"].alias("base"), tested.alias("random")).alias(_PLACES))


def rejected_from(found: DataFrame, level: float = FALSE_DISCOVERY) -> dict[tuple[int, int], int]:
    """By encoding and length band: the bin of p from which tokens are rejected as not random.

    Counts by bin are summed up over all documents; only their few hundred sums for each of
    at most some hundred strata come to the driver.
    """
    rows = (
        found.select(F.explode(F.col(_PLACES)["random"]["test"]).alias("t"))
        .groupBy("t.encoding", "t.band", "t.bin")
        .count()
        .collect()
    )
    strata: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows:
        strata.setdefault((r.encoding, r.band), {})[r.bin] = r["count"]
    bars = {}
    for stratum, bins in strata.items():
        total, below, bar = sum(bins.values()), 0, _PER_POWER * _MOST_POWER + 1
        for b in sorted(bins, reverse=True):
            below += bins[b]
            if 10 ** (-b / _PER_POWER) <= below * level / total:
                bar = b
        bars[stratum] = bar
    return bars


def all_spans(found: DataFrame, bars: dict[tuple[int, int], int]) -> DataFrame:
    """``found`` with its places replaced by ``base`` and ``spans``: (start, kind, end), sorted."""
    bar = F.lit(0)
    if bars:
        known = F.create_map(*[F.lit(x) for (e, b), v in sorted(bars.items()) for x in (e * 1000 + b, v)])

        def bar_of(test: Column) -> Column:
            return F.coalesce(F.element_at(known, test["encoding"] * 1000 + test["band"]), bar)
    else:

        def bar_of(test: Column) -> Column:
            return bar

    secret = _typed(F.filter(F.col(_PLACES)["random"], lambda c: c["test"]["bin"] < bar_of(c["test"])), "random")
    base = F.col(_PLACES)["base"]
    names = [c for c in found.columns if c != _PLACES]
    return found.select(*names, F.struct(base.alias("base"), F.array_sort(F.concat(base, secret)).alias("spans")).alias(_PLACES))


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def digest(found: DataFrame, bars: dict[tuple[int, int], int]) -> DataFrame:
    """doc_id, counts by base kind, the hash of the base spans, and all spans as text."""
    spans = all_spans(found.select("doc_id", _PLACES), bars)
    base = F.col(_PLACES)["base"]

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in KINDS[:3]]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(F.col(_PLACES)["spans"]).alias("spans"),
    )


def redact(docs: DataFrame, level: float = FALSE_DISCOVERY) -> DataFrame:
    """``docs`` with every secret span replaced by REDACTED, and n_chars brought up to date.

    The places are staged with the rows: both the counts for the bars and the new texts read
    them, and neither plan then holds the patterns and tests.
    """
    found = stage(find_places(docs), "places")
    spans = all_spans(found, rejected_from(found, level))
    text = F.col("text")

    def step(state: Column, s: Column) -> Column:
        new = s["start"] >= state["at"]
        between = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(new, F.concat(state["parts"], F.array(between, F.lit(REDACTED)))).otherwise(state["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate(
        F.col(_PLACES)["spans"],
        start,
        step,
        lambda state: F.concat(F.array_join(state["parts"], ""), F.substr(text, state["at"] + 1, F.length(text))),
    )
    some = F.size(F.col(_PLACES)["spans"]) > 0
    changed = spans.withColumn("text", F.when(some, clean).otherwise(text))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
