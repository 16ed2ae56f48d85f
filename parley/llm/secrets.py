"""Secrets in texts: known forms, and strings that pass a battery of randomness tests (operator 3).

Long strings of letters, digits and signs are judged against the alphabet they seem to be drawn from
(hexadecimal, base 32, 36 or 64): a chi-squared test of equal use of its symbols, a runs test of
upper and lower half, and a test of serial correlation, joined by Fisher's rule into one
probability. Random strings have probabilities spread evenly from 0 to 1, ordinary ones near 0. For each
class of length, the counts of all strings of the corpus tell how many are random, and the
threshold is the lowest at which the estimated share of ordinary strings among the accepted ones stays
below `q`: short strings, which the tests can tell apart less well, have to do better. All of
it is DataFrame functions; a text is read once and only a table of spans goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stash

# Fixed patterns of the known forms; a failing match is dropped and not tried again.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_MIN = 6

#: Strings that are tested.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Form of a string, its alphabet; the first that fits counts.
ALPHABETS = (
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^(?=.*[0-9])[0-9a-z]+$", _DIGITS + _LOWER),
    (r"^(?=.*[0-9])[0-9A-Z]+$", _DIGITS + _UPPER),
    (r"", _UPPER + _LOWER + _DIGITS + "+/"),
)
#: Lengths at which the classes after the first begin.
LENGTHS = (28, 40, 64)
Q = 0.1
BINS = 50


def spans(text: Column, pattern: str, keep=None, group: int = 0) -> Column:
    """Start and end, in code points, and text of all matches, as an array of structs.

    `keep`, from the text of `group` to a condition, drops matches.
    """
    lengths = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(lengths.alias("gap"), whole.alias("match"), parts.alias("part"))
    rows = F.slice(rows, F.lit(1), F.size(whole))
    kind = "array<struct<start:int,end:int,match:string,part:string>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def add(state: Column, row: Column) -> Column:
        start = state["at"] + row["gap"]
        end = start + F.length(row["match"])
        this = F.struct(
            start.alias("start"), end.alias("end"), row["match"].alias("match"),
            row["part"].alias("part"),
        )
        ok = F.lit(True) if keep is None else keep(row["part"])
        more = F.concat(state["out"], F.when(ok, F.array(this)).otherwise(F.array().cast(kind)))
        return F.struct(end.alias("at"), more.alias("out"))

    found = F.aggregate(rows, first, add, lambda s: s["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind))


def _tail(z: Column) -> Column:
    """Probability beyond z of the normal distribution, by a logistic approximation."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _pick(token: Column, values) -> Column:
    out = F.lit(values[-1])
    for (form, _), value in reversed(list(zip(ALPHABETS[:-1], values, strict=False))):
        out = F.when(token.rlike(form), F.lit(value)).otherwise(out)
    return out


def randomness(token: Column) -> Column:
    """The probability of so uneven a string, were it drawn evenly from its alphabet."""
    plain = F.translate(token, "-_", "+/")
    alphabet = _pick(plain, [a for _, a in ALPHABETS])
    k = _pick(plain, [float(len(a)) for _, a in ALPHABETS])
    n = F.length(plain).cast("double")
    values = F.transform(F.split(plain, ""), lambda c: F.position(c, alphabet) - 1)
    values = F.filter(values, lambda v: v >= 0)
    # Values and their alphabet are worked out once and handed on as a struct in an array.
    given = F.array(F.struct(values.alias("v"), k.alias("k"), n.alias("n")))

    def judge(g: Column) -> Column:
        v, k, n = g["v"], g["k"], g["n"]
        squares = F.aggregate(
            F.sequence(F.lit(0), k.cast("int") - 1),
            F.lit(0.0),
            lambda s, x: s + F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2)),
        )
        df = k - 1
        uneven = (F.cbrt((k / n * squares - n) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        half = k / 2
        start = F.struct(
            F.lit(-1).alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("product")
        )
        middle, spread = (k - 1) / 2, (k * k - 1) / 12

        def step(s: Column, x: Column) -> Column:
            later = s["last"] >= 0
            turned = later & ((s["last"] >= half) != (x >= half))
            product = (s["last"] - middle) * (x - middle) / spread
            return F.struct(
                x.alias("last"),
                (s["runs"] + F.when(turned, 1.0).otherwise(0.0)).alias("runs"),
                (s["product"] + F.when(later, product).otherwise(0.0)).alias("product"),
            )

        walk = F.aggregate(v, start, step)
        runs = (walk["runs"] - 1 - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
        serial = walk["product"] / F.sqrt(n - 1)
        p = [_tail(uneven), 2 * _tail(F.abs(runs)), 2 * _tail(F.abs(serial))]
        x = -2 * sum((F.ln(F.greatest(q, F.lit(1e-300))) for q in p[1:]), F.ln(p[0]))
        # The tail of chi-squared with six degrees of freedom.
        return F.exp(-x / 2) * (1 + x / 2 + x * x / 8)

    return F.transform(given, judge)[0]


def length_class(length: Column) -> Column:
    return sum((F.when(length >= n, 1).otherwise(0) for n in LENGTHS), F.lit(0))


def thresholds(counts: list[tuple[int, int, int]], q: float = Q) -> dict[int, float]:
    """From (class, bin, count): the least probability to accept, for classes that have one.

    The upper half of the bins, which ordinary strings hardly reach, tells the number of random ones.
    """
    out = {}
    for c in {c for c, _, _ in counts}:
        bins = [0] * BINS
        for of, b, n in counts:
            if of == c:
                bins[b] += n
        random = sum(bins[BINS // 2 :]) * 2
        for b in range(BINS):
            accepted = sum(bins[b:])
            expected = random * (1 - b / BINS)
            if accepted and 1 - expected / accepted <= q:
                out[c] = b / BINS
                break
    return out


def find_secrets(
    docs: DataFrame, q: float = Q, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The secrets of each text, as spans.

    One row per row of `docs`: `doc_id`, the counts `n_assign`, `n_access`, `n_hex` and `n_random`, and `base`
    and `found`, arrays of `start`, `kind_order`, `end`, `kind` of the known forms alone, and of these and
    the random strings that overlap none of them; both in order of start and kind. Places are code points, ends
    exclusive. A null text counts as empty and has none; null and repeated ids and other columns do no harm;
    an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    long_enough = lambda value: F.length(value) >= ASSIGN_MIN
    kind = "array<struct<start:int,kind_order:int,end:int,kind:string>>"

    def as_kind(name: str) -> Column:
        return F.transform(
            F.col(f"_{name}"),
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind_order"),
                s["end"].alias("end"), F.lit(name).alias("kind"),
            ),
        ).cast(kind)

    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        spans(text, ASSIGN, long_enough, group=2).alias("_assign"),
        spans(text, ACCESS).alias("_access"),
        spans(text, HEX).alias("_hex"),
        spans(text, CANDIDATE, lambda t: ~t.rlike("^[0-9]+$")).alias("_tested"),
    ).select(
        "doc_id",
        F.array_sort(F.concat(*(as_kind(k) for k in KINDS[:3]))).alias("base"),
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.transform(
            "_tested",
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                length_class(s["end"] - s["start"]).alias("class"),
                randomness(s["match"]).alias("p"),
            ),
        ).alias("tested"),
    )
    read = stash(read, "secrets")
    one = F.col("one")
    # At most a row for each class of length and bin.
    counts = (
        read.select(F.explode("tested").alias("one"))
        .groupBy(
            one["class"].alias("class"),
            F.least(F.floor(one["p"] * BINS), F.lit(BINS - 1)).alias("bin"),
        )
        .count()
        .collect()
    )
    least = thresholds([(r[0], r[1], r[2]) for r in counts], q)

    def accepted(s: Column) -> Column:
        ok = F.lit(False)
        for c, p in least.items():
            ok = ok | ((s["class"] == c) & (s["p"] >= p))
        clear = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return ok & clear

    random = F.transform(
        F.filter("tested", accepted),
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(3).alias("kind_order"), s["end"].alias("end"),
            F.lit(KINDS[3]).alias("kind"),
        ),
    ).cast(kind)
    return read.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.size(random).cast("long").alias("n_random"),
        "base",
        F.array_sort(F.concat("base", random)).alias("found"),
    )


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, parted by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
