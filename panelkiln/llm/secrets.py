"""Operator 1, secret scans: fixed forms, and a battery of randomness tests with length-aware false-discovery control (native expressions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.shared import cut, table

#: The contract's forms. Runs of hex digits and of access keys are asked for with their least length, which finds the same spans.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")

#: Candidates of the battery: whole runs of the characters of the encodings.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: Encodings, narrowest first: name, form, alphabet, sizes of the alphabet's classes in order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", r"\A[0-9a-f]+\z", DIGITS + "abcdef", (10, 6)),
    ("hex_upper", r"\A[0-9A-F]+\z", DIGITS + "ABCDEF", (10, 6)),
    ("base32", r"\A[A-Z2-7]+\z", UPPER + "234567", (26, 6)),
    ("base62", r"\A[A-Za-z0-9]+\z", DIGITS + UPPER + LOWER, (10, 26, 26)),
    ("base64", r"\A[A-Za-z0-9+/]+\z", DIGITS + UPPER + LOWER + "+/", (10, 26, 26, 2)),
    ("base64url", r"\A[A-Za-z0-9_-]+\z", DIGITS + UPPER + LOWER + "_-", (10, 26, 26, 2)),
)
#: Spans are built in blocks of so many, so that thousands in a long text stay cheap.
BLOCK = 256
#: Bins of p-values in the corpus histogram.
BINS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _located(text: Column, form: str, keep: Column | None, extra: Callable[[Column], Column]) -> Column:
    """All leftmost non-overlapping matches of a form with their places in code points: array of (start, end, x), x of extra(match).

    Matches and the gaps between them, which split() gives, make up the text; running sums of their lengths are the places.
    """
    gaps = F.transform(F.split(text, form, -1), lambda g: F.length(g))
    found = keep if keep is not None else F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda m: F.struct(F.length(m).alias("n"), extra(m).alias("x")))
    steps = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), lambda s: s["m"].isNotNull())
    span = lambda at, s: F.struct((at + s["g"]).alias("start"), (at + s["g"] + s["m"]["n"]).alias("end"), s["m"]["x"].alias("x"))

    def block(at: Column, some: Column, none: Column) -> Column:
        return F.aggregate(
            some, F.struct(at.alias("at"), none.alias("out")),
            lambda acc, s: F.struct((acc["at"] + s["g"] + s["m"]["n"]).alias("at"), F.concat(acc["out"], F.array(span(acc["at"], s))).alias("out")),
        )

    def whole(steps: Column) -> Column:
        none = F.slice(F.transform(steps, lambda s: span(F.lit(0), s)), 1, 0)
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.slice(F.array(none), 1, 0).alias("outs"))
        grown = F.aggregate(blocks, start, lambda acc, b: let(block(acc["at"], b, none), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["outs"], F.array(r["out"])).alias("outs"))))
        return F.flatten(grown["outs"])

    return let(steps, whole)


def base_spans(text: Column) -> Column:
    """array of (start, kind, end), kind 0 to 2 as listed, sorted."""
    kind = lambda k: lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    keep = F.zip_with(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)), values, lambda m, v: F.struct(F.length(m).alias("n"), (F.length(v) >= 6).alias("x")))
    assign = F.when(text.rlike(ASSIGN), kind(0)(F.filter(_located(text, ASSIGN, keep, F.length), lambda s: s["x"]))).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), kind(1)(_located(text, ACCESS, None, F.length))).otherwise(none)
    hexes = F.when(text.rlike(HEX), kind(2)(_located(text, HEX, None, F.length))).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


def _tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by the logistic form with a cubic term (to 2e-4 in the middle, falling monotonically beyond)."""
    a = F.least(F.abs(z), F.lit(20.0))
    return F.lit(2.0) / (F.lit(1.0) + F.exp(a * 1.5976 + a * a * a * 0.070566))


def _battery(codes: Column, k: int, classes: tuple[int, ...]) -> Column:
    """Chance that a uniformly random row of codes looks as odd as this one, by the oddest of four tests (Sidak)."""
    n = F.size(codes).cast("double")
    ends = [sum(classes[: i + 1]) for i in range(len(classes))]
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    # Alphabet uniformity by classes: few cells, so it holds for short tokens too.
    coarse = F.lit(0.0)
    within = lambda lo, hi: F.size(F.filter(codes, lambda c: (c >= lo) & (c < hi)))
    for size, end in zip(classes, ends, strict=True):
        o = within(end - size, end)
        e = n * (size / k)
        coarse = coarse + (o - e) * (o - e) / e
    df = len(classes) - 1
    cube = lambda chi, d: (F.cbrt(F.greatest(chi, F.lit(0.0)) / d) - (1 - 2 / (9 * d))) / (2 / (9 * d)) ** 0.5  # noqa: E731  Wilson and Hilferty
    z1 = F.greatest(cube(coarse, df), F.lit(0.0))
    # And by single characters, with the exact mean and variance under uniformity.
    squares = total(F.transform(F.array_distinct(codes), lambda v: F.pow(F.size(F.filter(codes, lambda c: c == v)).cast("double"), F.lit(2.0))))
    z2 = F.greatest((squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n), F.lit(0.0))
    # Runs above and below the middle.
    high = F.transform(codes, lambda c: (c >= k // 2).cast("int"))
    n1 = F.aggregate(high, F.lit(0), lambda a, x: a + x).cast("double")
    n2 = n - n1
    pairs = lambda xs: F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = let(high, lambda h: F.size(F.filter(pairs(h), lambda p: p["a"] != p["b"])) + 1)
    both = 2 * n1 * n2
    var = both * (both - n) / (n * n * (n - 1))
    z3 = F.when(var > 0, (runs - both / n - 1) / F.sqrt(var)).otherwise(F.lit(20.0))
    # Serial correlation of neighbours.
    mean = total(F.transform(codes, lambda c: c.cast("double"))) / n
    z4 = let(mean, lambda m: let(
        F.struct(
            total(F.transform(codes, lambda c: (c - m) * (c - m))).alias("v"),
            total(F.transform(pairs(codes), lambda p: (p["a"] - m) * (p["b"] - m))).alias("s"),
        ),
        lambda r: F.when(r["v"] > 0, (r["s"] / r["v"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(20.0)),
    ))
    # The chi-squared tests count one side only.
    least = F.least(F.when(z1 > 0, _tail(z1) / 2).otherwise(F.lit(0.5)), F.when(z2 > 0, _tail(z2) / 2).otherwise(F.lit(0.5)), _tail(z3), _tail(z4))
    return F.lit(1.0) - F.pow(F.lit(1.0) - least, F.lit(4.0))


def _tested(token: Column) -> Column:
    """(encoding number or null, p) of a token. Digits alone can't be told from numbers and have p 0."""
    number = p = None

    def chance(alphabet: str, classes: tuple[int, ...]) -> Column:
        place = F.create_map(*[F.lit(x) for k, c in enumerate(alphabet) for x in (c, k)])
        codes = F.transform(F.split(token, ""), lambda c: F.try_element_at(place, c))
        return let(codes, lambda c: _battery(c, len(alphabet), classes))

    for i, (_, form, alphabet, classes) in enumerate(ENCODINGS):
        is_it = token.rlike(form)
        value = chance(alphabet, classes)
        number = F.when(is_it, F.lit(i)) if number is None else number.when(is_it, F.lit(i))
        p = F.when(token.rlike(r"\A[0-9]+\z"), F.lit(0.0)).when(is_it, value) if p is None else p.when(is_it, value)
    return F.struct(number.alias("enc"), p.alias("p"))


def candidate_spans(text: Column) -> Column:
    """array of (start, end, x), x of encoding number, p and length class (log2): what the battery says of each candidate."""
    none = F.array().cast("array<struct<start:int,end:int,x:struct<enc:int,p:double,size:int>>>")
    about = lambda m: let(_tested(m), lambda t: F.struct(t["enc"].alias("enc"), F.coalesce(t["p"], F.lit(0.0)).alias("p"), F.floor(F.log2(F.length(m).cast("double"))).cast("int").alias("size")))
    return F.when(text.rlike(CANDIDATE), _located(text, CANDIDATE, None, about)).otherwise(none)


def scanned(docs: DataFrame) -> DataFrame:
    """docs with _base and _found."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"_base": base_spans(text), "_found": candidate_spans(text)})


def thresholds(found: DataFrame, share: float = 0.05, least_p: float = 0.01) -> list[tuple[int, int, float]]:
    """For each encoding and length class the p above which its candidates count as random: (encoding, class, threshold).

    Random tokens have p-values spread evenly; structured ones lie near 0. From the upper half of the histogram of all of the corpus's
    candidates comes the number of random ones; of those above a threshold, what exceeds the random ones expected there is
    false. The lowest threshold, from `least_p` up, whose estimated share of false ones is at most `share` is taken. Short tokens
    look random more easily: each class of lengths has its own histogram. The histogram has at most encodings * 31 * BINS rows.
    """
    x = F.col("x.x")
    hist = (
        found.select(F.explode("_found").alias("x")).filter(x["enc"].isNotNull())
        .groupBy(x["enc"].alias("enc"), x["size"].alias("size"), F.least(F.floor(x["p"] * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count().collect()
    )
    by: dict[tuple[int, int], list[int]] = {}
    for r in hist:
        by.setdefault((r["enc"], r["size"]), [0] * BINS)[r["bin"]] += r["count"]
    out = []
    for (enc, size), n in sorted(by.items()):
        random = sum(n[BINS // 2 :]) * 2
        for b in range(BINS):
            above = sum(n[b:])
            if above == 0 or above - random * (1 - b / BINS) <= share * above:
                out.append((enc, size, max(least_p, b / BINS)))
                break
    return out


def all_spans(limits: list[tuple[int, int, float]]) -> Column:
    """Base spans and those of candidates over their threshold, sorted: array of (start, kind, end); kinds from 3 are the encodings."""
    def over(s: Column) -> Column:
        ok = F.lit(False)
        for enc, size, p in limits:
            ok = ok | ((s["x"]["enc"] == enc) & (s["x"]["size"] == size) & (s["x"]["p"] >= p))
        return ok

    more = F.transform(F.filter("_found", over), lambda s: F.struct(s["start"].alias("start"), (s["x"]["enc"] + len(BASE_KINDS)).alias("kind"), s["end"].alias("end")))
    return F.array_sort(F.concat("_base", more))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(x) for x in (*BASE_KINDS, *(f"random_{e[0]}" for e in ENCODINGS))])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Base spans are the whole matches of the fixed forms, in code points, end exclusive; the battery adds spans of kind random_<encoding>, also where
    a base span lies. Null and empty texts have no spans. Texts are read whole and once; what goes on is spans. Repeated rows are scanned each; an empty
    table gives no rows.
    """
    spans = cut(scanned(docs.select(F.col(id_col).alias("doc_id"), "text")).select("doc_id", "_base", "_found"))
    n = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    full = all_spans(thresholds(spans))
    return spans.withColumn("_all", full).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(as_text(F.col("_base")), 256).alias("base_sha256"), as_text(F.col("_all")).alias("spans"),
        F.size(F.filter("_all", lambda s: s["kind"] >= len(BASE_KINDS))).cast("long").alias("n_random"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


#: What stands in a text for a secret.
REDACTED = "[SECRET]"


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """All documents, each secret's span (overlapping ones merged) replaced by a mark; n_chars is that of the new text. Null texts stay null."""
    limits = thresholds(cut(scanned(docs.select("text")).select("_found")))
    text = F.col("text")

    def clean(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            piece = F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(REDACTED))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

        done = F.aggregate(spans, start, step)
        return let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substr(text, d["at"] + 1, F.length(text))))

    # The documents' own columns go along as one, so that none can clash.
    held = scanned(docs.select(F.struct(*docs.columns).alias("_doc"), "text")).withColumn("_all", all_spans(limits))
    held = held.withColumn("_new", F.when(F.size("_all") > 0, clean(F.col("_all"))).otherwise(text))
    own = lambda c: F.col("_doc").getField(c)
    n_chars = lambda c: F.when(F.size("_all") > 0, F.length("_new").cast("long")).otherwise(own(c))
    return held.select(*[(F.col("_new") if c == "text" else n_chars(c) if c == "n_chars" else own(c)).alias(c) for c in docs.columns])
