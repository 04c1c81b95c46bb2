"""Operator 9, URL filtering by association rules (native expressions and Spark's FP-growth)."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.shared import cut, table

#: The contract's rules, (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: No more mined rules than this are inlined as an index; beyond it the index is a joined table.
INLINE_RULES = 512


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), upper, lower)


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does. Ties can't be: equal texts are the same rule."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def url_tokens() -> Column:
    """Distinct tokens of a URL: scheme, host suffixes, path words that aren't numbers, file ending, query keys, fragment or not."""
    return F.expr(r"""
    array_distinct(filter(concat(
      array(concat('scheme:', lower(regexp_extract(_url, '(?s)\\A(.*?)://', 1)))),
      transform(split(host, '[.]'), x -> concat('host:', x)),
      transform(filter(split(path, '/'), x -> x <> '' and not x rlike '\\A[0-9]+([.][a-z]+)?\\z'), x -> concat('path:', x)),
      array(if(path rlike '[.][a-zA-Z0-9]+\\z', concat('end:', lower(regexp_extract(path, '[.]([a-zA-Z0-9]+)\\z', 1))), null)),
      transform(regexp_extract_all(coalesce(_url, ''), '[?&]([^=&#]+)', 1), x -> concat('key:', x))
    ), x -> x is not null))
    """)


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules (id, items, verdict, confidence, support) mined by FP-growth from rows of items and verdict.

    Single consequents only, as FP-growth makes them. A rule stays if its support and confidence reach the limits and no rule with fewer
    of its items, the same verdict and as high a confidence exists.
    """
    mark = F.concat(F.lit("verdict:"), F.col("verdict"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(
        labelled.select(F.array_append("tokens", mark).alias("items"))
    )
    found = (
        model.associationRules.filter((F.size("consequent") == 1) & F.col("consequent")[0].startswith("verdict:"))
        .filter(~F.exists("antecedent", lambda x: x.startswith("verdict:")))
        .select(F.array_sort("antecedent").alias("items"), F.regexp_replace(F.col("consequent")[0], "^verdict:", "").alias("verdict"), "confidence", "support")
    )
    return cut(found)


def minimal_rules(found: list) -> list:
    """Drops a rule if another one with a part of its items has the same verdict and at least its confidence."""
    kept: list = []
    for r in sorted(found, key=lambda r: (len(r["items"]), -r["confidence"], r["items"], r["verdict"])):
        if not any(k["verdict"] == r["verdict"] and set(k["items"]) <= set(r["items"]) and k["confidence"] >= r["confidence"] for k in kept):
            kept.append(r)
    return kept


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined (the mined rule used, else null).

    A page that a given rule fits has that rule's verdict. Those pages are the labels from which FP-growth mines combinations of
    URL tokens; any other page takes the verdict of the strongest mined rule whose items it all has (confidence, then support,
    then more items, then the items' order), and is allowed where none matches. Null URLs, URLs without :// and empty ones have an empty
    host and path. Repeated rows are judged each. Without labels nothing is mined and all pages are allowed. The
    number of mined rules depends on min_support, not on the number of pages.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    base = base.withColumns({"host": url_host(F.col("_url")), "path": url_path(F.col("_url"))})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": name, "given": verdict, "tokens": url_tokens()})
    labelled = base.filter("given is not null").select("tokens", F.col("given").alias("verdict"))
    found = mine_rules(labelled, min_support, min_confidence)
    strongest = lambda rs: sorted(rs, key=lambda r: (-r["confidence"], -r["support"], -len(r["items"]), r["items"], r["verdict"]))
    if found.count() > 20 * INLINE_RULES:
        return _by_join(base, found)
    best = strongest(minimal_rules(found.collect()))
    if not best:
        return base.select("page_id", "host", "path", "rule", F.coalesce("given", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("mined"))
    if len(best) > INLINE_RULES:
        return _by_join(base, pages.sparkSession.createDataFrame(best, found.schema))
    # Inverted index: token -> numbers of the rules that hold it, rules numbered from the strongest.
    index: dict[str, list[int]] = {}
    for k, r in enumerate(best):
        for x in r["items"]:
            index.setdefault(x, []).append(k)
    as_map = F.create_map(*[c for t, ks in sorted(index.items()) for c in (F.lit(t), F.array(*map(F.lit, ks)))])
    needs = F.array(*[F.lit(len(r["items"])) for r in best])
    hits = F.flatten(F.transform("tokens", lambda t: F.coalesce(F.try_element_at(F.col("_index"), t), F.array().cast("array<int>"))))
    judged = base.withColumn("_index", as_map).withColumn("_hits", hits).withColumn("_needs", needs)
    first = F.expr("array_min(filter(array_distinct(_hits), k -> size(filter(_hits, x -> x = k)) = _needs[k]))")
    judged = judged.withColumn("_first", F.when(F.col("given").isNull(), first))
    verdicts, names = F.array(*[F.lit(r["verdict"]) for r in best]), F.array(*[F.lit(" & ".join(r["items"])) for r in best])
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("given", F.get(verdicts, F.col("_first")), F.lit("allow")).alias("verdict"), F.get(names, F.col("_first")).alias("mined"),
    )


def _by_join(base: DataFrame, found: DataFrame) -> DataFrame:
    """The same by an index kept as a table, for rule sets that are too many to inline: (token, rule) rows meet the tokens by hash join.

    Of the rules that minimal_rules drops, those weaker than the rule that stands for them are never the strongest. The others equal it in confidence and
    support; so do all rules between the two, so a rule goes if one without one of its items equals it.
    """
    base = cut(base.withColumn("_row", F.monotonically_increasing_id()))
    key = ["items", "verdict", "confidence", "support"]
    less = found.withColumn("_less", F.explode(F.transform("items", lambda x: F.array_remove("items", x)))).select(F.col("items").alias("_whole"), F.col("_less").alias("items"), *key[1:])
    beaten = less.join(found.select(key), key, "left_semi").select(F.col("_whole").alias("items"), "verdict").distinct()
    rules = cut(found.join(beaten, ["items", "verdict"], "left_anti").withColumn("_rule", F.xxhash64("items", "verdict")))
    index = rules.select(F.explode("items").alias("token"), "_rule", F.size("items").alias("need"), "items", "verdict", "confidence", "support")
    strength = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("p"), (-F.col("need")).alias("n"), "items", "verdict")
    best = (
        base.filter("given is null").select("_row", F.explode("tokens").alias("token")).join(index, "token")
        .groupBy("_row", "_rule").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"), F.first(strength).alias("s")).filter("n = need")
        .groupBy("_row").agg(F.min("s").alias("s"))
    )
    return base.join(best, "_row", "left").select("page_id", "host", "path", "rule", F.coalesce("given", "s.verdict", F.lit("allow")).alias("verdict"), F.when(F.col("s").isNotNull(), F.concat_ws(" & ", "s.items")).alias("mined"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
